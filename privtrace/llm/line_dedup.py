"""Line deduplication within a bound of edits: deletion neighbourhoods and shared segments joined as hashed keys.

A line goes if an earlier line, by (doc_id, line number), equals it or is
within the bound (characters inserted, deleted or replaced). The bound follows
the length: ``edits`` for lines of ``min_chars`` characters or more,
``short_edits`` for shorter ones; for two lines the smaller of theirs holds.
Equal lines meet in one aggregation of 128-bit keys. Two lines within one edit
have a common deletion variant: the same variant from the same place if a
character was replaced, or one line is a variant of the other. So variants are
emitted as hashed keys and equal ones joined. A bucket of replaced characters
holds lines that are all within one edit, and in the other buckets only a line
and its own variants matter, so the earliest line of a bucket stands for all
earlier ones and no bucket is expanded into pairs. What is found is verified on
the lines.

A line of n characters has n variants, so most lines are first shown to have no
partner: the same neighbourhood is formed with a quarter of the line deleted
instead of a character (two lines within one edit agree in all but one
quarter), which takes eight keys a line. Only lines that share such a key emit
variants, and only for the places inside that quarter.

Under a bound k of two or more that serves the short lines, up to one character
more than they have. The others are compared by segments: of k + 1 segments of the shorter line one stands unchanged in the other, and the places
it can stand at follow from its number and the two lengths. Lines that share
such a segment are verified, first against the earliest line of the segment and
then, if still open, against all earlier ones where a segment has at most
``WIDE`` lines. The lines of wider ones, such as a common passage has, are
never paired: they are cut into more and more pieces, of which at most k hold
the edits, and meet in what the other pieces keep. When these windows are short
they emit deletion variants, with places for replaced characters, keyed so that
all lines facing each other under a key are within the bound; the earliest
decides. A line that alone keeps something falls out at every step.

Cases: null and empty texts have one empty line. Lines without a word are never
dropped. Documents with a null id have their lines compared after all others; of
equal lines of one (doc_id, line number), which repeated rows bring, all stay
or go together. An empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b
from itertools import accumulate, combinations, product
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .rows import WORD, texts

MIN_CHARS = 20
PARTS = 4
#: The bounds of the query, for lines of MIN_CHARS characters or more and for shorter ones.
EDITS, SHORT_EDITS = 2, 1

#: Lines of a segment that are compared pair by pair; wider ones are narrowed.
WIDE = 32
#: Characters of a window that emits variants.
LAST = 4

_B1, _B2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd, so that they have inverses modulo 2**64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of a base modulo 2**64, as many as the longest line so far needs."""

    def __init__(self, base: int):
        self.base, self.back = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.table = np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.table) < n:
            with np.errstate(over="ignore"):
                step = np.multiply.reduce(np.full(len(self.table), self.base))
                self.table = np.concatenate([self.table, self.table * step])
        return self.table[:n]


def variant_keys(line: str, first: int, stop: int, powers: tuple[_Powers, _Powers]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit keys of the line itself and of its variants without the characters first..stop-1, as (high, low).

    The weight of a character is its place's power of a base, so a variant is
    the sum before the place plus the sum behind it, moved by one power.
    """
    chars = _mix(np.frombuffer(line.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1))
    n, out = len(chars), []
    with np.errstate(over="ignore"):
        for p in powers:
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(chars * p.upto(n), dtype=np.uint64)])
            at = np.arange(first, stop)
            out.append(_mix(np.concatenate([sums[n:], sums[at] + (sums[n] - sums[at + 1]) * p.back])))
    return out[0], out[1]


def _emit(batches):
    """Rows of (doc_id, line_no, k1, k2, kind): 0 the line itself, 1 a variant of it, 2 a variant with its place."""
    import pyarrow as pa

    powers = _Powers(_B1), _Powers(_B2)

    def rows(b, who, k1, k2, kinds):
        take = pa.array(np.concatenate(who))
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id").take(take), b.column("line_no").take(take), pa.array(np.concatenate(k1).view(np.int64)),
             pa.array(np.concatenate(k2).view(np.int64)), pa.array(np.concatenate(kinds))],
            names=["doc_id", "line_no", "k1", "k2", "kind"])

    for b in batches:
        who, k1, k2, kinds, made = [], [], [], [], 0
        for row, (line, n, part) in enumerate(zip(b.column("line").to_pylist(), b.column("size").to_pylist(), b.column("part").to_pylist(), strict=True)):
            first, stop = n * part // PARTS, n * (part + 1) // PARTS
            # of a line one longer than its class the places of the part reach one further
            stop = min(len(line), stop + len(line) - n)
            one, two = variant_keys(line, first, stop, powers)
            place = np.arange(first, stop, dtype=np.uint64) * np.uint64(_B1) + np.uint64(len(line))
            k1 += [one, _mix(one[1:] ^ _mix(place))]
            k2 += [two, two[1:]]
            kinds.append(np.repeat(np.array([0, 1, 2], np.int8), [1, stop - first, stop - first]))
            who.append(np.full(len(one) + stop - first, row))
            made += len(who[-1])
            if made > 200_000:
                yield rows(b, who, k1, k2, kinds)
                who, k1, k2, kinds, made = [], [], [], [], 0
        if who:
            yield rows(b, who, k1, k2, kinds)


def _part_key(line: Column, size: Column, part: int) -> Column:
    """Hash of what a line keeps without one part, when lines of ``size`` characters are its class."""
    first, stop = F.floor(size * part / PARTS).cast("int"), F.floor(size * (part + 1) / PARTS).cast("int")
    rest = size - stop
    tail = F.substring(line, F.length(line) - rest + 1, F.greatest(rest, F.lit(0)))
    return F.xxhash64(F.lit(part), size, F.substring(line, F.lit(1), first), tail)


def _segment_keys(line: Column, n: Column, edits: int, min_chars: int) -> dict[str, Column]:
    """Hashes of the segments of a line and of the places where segments of a line up to ``edits`` shorter can stand.

    Up to the first unchanged segment i there are at most i edits, behind it at
    most edits - i, which bounds its shift from both ends. Null if the shorter
    line would have fewer than ``min_chars`` characters.
    """
    out = {}
    for less in range(edits + 1):
        size = n - less
        for i in range(edits + 1):
            first, stop = F.floor(size * i / (edits + 1)).cast("int"), F.floor(size * (i + 1) / (edits + 1)).cast("int")
            for shift in range(max(-i, less - edits + i), min(i, less + edits - i) + 1):
                key = F.xxhash64(F.lit(i), size, F.substring(line, first + shift + 1, stop - first))
                out[f"s{less}_{i}_{shift - less + edits}"] = F.when(size >= min_chars, key)
    return out


def _shifts(less: int, windows: int, edits: int) -> Iterator[tuple[int, ...]]:
    """How far the text behind each window can be moved if every window holds an edit and there are at most ``edits``."""
    for steps in product(range(-edits, edits + 1), repeat=windows):
        if sum(steps) == less and sum(max(1, abs(x)) for x in steps) <= edits:
            yield tuple(accumulate(steps))


def _choices(inside: list[int] | None, pieces: int, edits: int) -> Iterator[tuple[int, ...]]:
    """The sets of up to ``edits`` pieces that can hold the edits; if those of half as many pieces are known, with a half of each."""
    of = range(pieces) if not inside else [2 * c + half for c in inside for half in (0, 1)]
    for k in range(len(inside) if inside else 1, edits + 1):
        yield from (c for c in combinations(of, k) if not inside or {x // 2 for x in c} == set(inside))


def contexts(line: str, size: int, pieces: int, inside: list[int] | None, edits: int) -> Iterator[tuple[bytes, tuple[int, ...], list[str]]]:
    """(key, windows, what stands in them) of a line beside lines of ``size`` characters, cut into pieces: the key is of all else.

    An edit belongs to the piece of the shorter line that it stands in; one at the very end to the last piece.
    """
    at = [size * i // pieces for i in range(pieces + 1)]
    for chosen in _choices(inside, pieces, edits):
        for moved in _shifts(len(line) - size, len(chosen), edits):
            kept, content, done, shift = [], [], 0, 0
            for c, after in zip(chosen, moved, strict=True):
                kept.append(line[done:at[c] + shift])
                done = at[c + 1] + after
                if done < at[c] + shift:
                    break
                content.append(line[at[c] + shift:done])
                shift = after
            else:
                kept.append(line[done:])
                # sizes, pieces and windows fix where the kept parts end
                text = f"{size},{pieces},{chosen}|" + "".join(kept)
                yield blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), chosen, content


def facing_keys(key: bytes, content: list[str], edits: int) -> Iterator[tuple[bytes, int]]:
    """(key, side) of the variants of the windows: lines of side 1 face those of side 2, lines of side 0 each other.

    If x characters of the one and y of the other line are deleted and the rest
    agrees but for z places, the lines are within x + y + z edits.
    """
    chars = [(w, c) for w, text in enumerate(content) for c in text]
    for x in range(edits + 1):
        for y in range(min(x, edits - x) + 1):
            for side, deleted in ([(0, x)] if x == y else [(1, x), (2, y)]):
                for rest in combinations(chars, len(chars) - deleted) if deleted <= len(chars) else ():
                    for places in combinations(range(len(rest)), min(edits - x - y, len(rest))):
                        left = [(w, "" if i in places else c) for i, (w, c) in enumerate(rest)]
                        yield blake2b(key + repr((x, y, left)).encode("utf-8", "surrogatepass"), digest_size=16).digest(), side


def _narrowed(lines: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """Pairs (l1, l2, o1, o2) of open lines and earlier ones within ``edits``: the earliest under a key, for every line that has one.

    ``lines`` has l1, l2, first, open and line. A round doubles the pieces; it
    forms no pairs, and what reaches the next one shares a key with an open line.
    """
    import pyarrow as pa

    kind = lines.schema["first"].dataType.simpleString()
    names = ["l1", "l2", "first", "open"]

    def keep(b, take):
        return [b.column(x).take(pa.array(take, pa.int64())) for x in names]

    def cut_up(pieces: int):
        def run(batches):
            for b in batches:
                for at in range(len(b)):
                    line, known = b.column("line")[at].as_py(), b.column("known")[at].as_py()
                    todo = [(k["size"], k["windows"]) for k in known] if known else [(n, None) for n in range(max(len(line) - edits, min_chars), len(line) + 1)]
                    rows = [(size, *c) for size, inside in todo for c in contexts(line, size, pieces, inside, edits)]
                    marks = [[int.from_bytes(blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) for x in r[3]] for r in rows]
                    last = [r[0] <= LAST * pieces for r in rows]
                    yield pa.RecordBatch.from_arrays(
                        [*keep(b, [at] * len(rows)), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[0] for r in rows], pa.int32()),
                         pa.array([r[2] for r in rows], pa.list_(pa.int32())), pa.array(marks, pa.list_(pa.int64())), pa.array(last, pa.bool_()),
                         pa.array([r[3] if x else None for r, x in zip(rows, last, strict=True)], pa.list_(pa.string()))],
                        names=[*names, "key", "size", "windows", "marks", "last", "content"])
        return run

    def emit(batches):
        for b in batches:
            for at in range(len(b)):
                rows = [*set(facing_keys(b.column("key")[at].as_py(), b.column("content")[at].as_py(), edits))]
                yield pa.RecordBatch.from_arrays(
                    [*keep(b, [at] * len(rows)), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32())], names=[*names, "key", "side"])

    found, known, pieces = None, None, edits + 2
    first = f"l1 long, l2 long, first {kind}, open boolean, key binary"
    while True:
        now = lines.withColumn("known", F.lit(None).cast("array<struct<size:int,windows:array<int>>>")) if known is None else lines.join(known, ["l1", "l2"])
        entries = cut(now.mapInArrow(cut_up(pieces), f"{first}, size int, windows array<int>, marks array<long>, last boolean, content array<string>"), "pieces")
        # lines under a key that differ in every window; where a window is the same in all, fewer windows say as much
        differ = [F.coalesce(F.min(F.get("marks", F.lit(i))) != F.max(F.get("marks", F.lit(i))), F.lit(True)) for i in range(edits)]
        shared = entries.groupBy("key").agg(F.min("first").alias("e"), F.max(F.when(F.col("open"), F.col("first"))).alias("o"), reduce(and_, differ).alias("d"))
        shared = shared.where("e < o AND d").select("key")
        entries = cut(entries.join(shared.hint("merge"), "key"), "shared_pieces")
        ready = entries.where("last").mapInArrow(emit, f"{first}, side int").distinct()
        ready = cut(ready, "piece_variants")
        earliest = ready.groupBy("key").agg(*[
            F.min(F.when(F.col("side") == side, F.struct("first", "l1", "l2"))).alias(f"e{side}") for side in (0, 1, 2)])
        faced = F.when(F.col("side") == 0, F.col("e0")).when(F.col("side") == 1, F.col("e2")).otherwise(F.col("e1"))
        met = ready.where("open").join(earliest.hint("merge"), "key").withColumn("e", faced).where("e.first < first")
        met = cut(met.select("l1", "l2", F.col("e.l1").alias("o1"), F.col("e.l2").alias("o2")).distinct(), "faced")
        found = met if found is None else found.union(met)
        more = entries.where("NOT last").select("l1", "l2", F.struct("size", "windows").alias("k"))
        known = cut(more.groupBy("l1", "l2").agg(F.collect_set("k").alias("known")).hint("merge"), "known")
        if known.isEmpty():
            return found
        pieces *= 2


def _near_earlier(firsts: DataFrame, settled: DataFrame, keyed: DataFrame, names: list[str], edits: int, min_chars: int) -> DataFrame:
    """Keys (l1, l2) of the lines of ``firsts`` that are not among ``settled`` and have an earlier line within ``edits``."""
    # narrow rows while all keys are there; lines of equal l1 are told apart afterwards
    entries = firsts.select("l1", F.explode(F.array_distinct(F.array(*names))).alias("key")).where("key IS NOT NULL")
    shared = entries.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    found = cut(entries.join(shared, "key"), "segments")
    lines = firsts.select("l1", "l2", "first").join(settled.withColumn("done", F.lit(True)), ["l1", "l2"], "left")
    lines = lines.select("l1", "l2", "first", F.col("done").isNull().alias("open"))
    entries = cut(found.join(lines, "l1"), "entries")
    shared = entries.groupBy("key").agg(F.min("first").alias("earliest"), F.max(F.when(F.col("open"), F.col("first"))).alias("latest")).where("earliest < latest")
    members = cut(entries.join(shared, "key").where(F.col("first") <= F.col("latest")).drop("latest"), "members")
    own = members.select("l1", "l2").distinct().hint("merge")
    wanted = cut(keyed.select("l1", "l2", "line").join(own, ["l1", "l2"], "left_semi").dropDuplicates(["l1", "l2"]), "segment_lines")

    def verified(pairs: DataFrame) -> DataFrame:
        a = wanted.select("l1", "l2", F.col("line").alias("a"))
        b = wanted.select(F.col("l1").alias("o1"), F.col("l2").alias("o2"), F.col("line").alias("b"))
        return pairs.distinct().join(a, ["l1", "l2"]).join(b, ["o1", "o2"]).where(F.levenshtein("a", "b", edits).between(0, edits)).select("l1", "l2").distinct()

    open_ = members.where("open AND earliest < first")
    # of several lines at one place all are heads; they are as many as repeated rows make them
    heads = members.where("first = earliest").select("key", F.col("l1").alias("o1"), F.col("l2").alias("o2"))
    near = cut(verified(open_.join(heads, "key").select("l1", "l2", "o1", "o2")), "near_heads")
    rest = cut(open_.join(near.hint("merge"), ["l1", "l2"], "left_anti").select("key", "l1", "l2", "first"), "rest")
    others = members.where("earliest < first").select("key", F.col("l1").alias("o1"), F.col("l2").alias("o2"), F.col("first").alias("other"))
    others = others.join(rest.select("key").distinct().hint("merge"), "key", "left_semi")
    sizes = cut(others.groupBy("key").agg((F.count("*") > WIDE).alias("wide")), "widths")
    narrow, wide = sizes.where("NOT wide").select("key"), sizes.where("wide").select("key").hint("merge")
    pairs = rest.join(narrow, "key").join(others, "key").where("other < first").select("l1", "l2", "o1", "o2")
    near = cut(near.union(verified(pairs)), "near_pairs")

    # lines of wide segments, the open ones among them, and all that are earlier than one of these
    still = rest.join(wide, "key", "left_semi").join(near.hint("merge"), ["l1", "l2"], "left_anti")
    still = cut(still, "still")
    if still.isEmpty():
        return near
    latest = still.groupBy("key").agg(F.max("first").alias("latest"))
    ours = others.join(latest.hint("merge"), "key").where("other <= latest").select(F.col("o1").alias("l1"), F.col("o2").alias("l2"), F.col("other").alias("first")).distinct()
    ours = ours.join(still.select("l1", "l2").distinct().withColumn("open", F.lit(True)).hint("merge"), ["l1", "l2"], "left").withColumn("open", F.coalesce("open", F.lit(False)))
    ours = cut(ours.join(wanted.hint("merge"), ["l1", "l2"]).repartition("l1", "l2"), "wide_lines")
    return near.union(verified(_narrowed(ours, edits, min_chars)))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, edits: int = 1, short_edits: int = 0) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, dropped (numbers of the dropped lines, from 0).

    ``edits`` is 1 or more, ``short_edits`` 0 or 1.
    """
    if edits < 1 or short_edits not in (0, 1):
        raise ValueError("edits is 1 or more, short_edits 0 or 1")
    rows = texts(docs, id_col, text_col)
    lines = rows.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    worded = lines.where(F.regexp_like("line", F.lit(WORD)))
    n = F.length("line")
    keyed = worded.withColumns({"l1": F.xxhash64("line"), "l2": F.xxhash64(F.lit(1), F.col("line")), "n": n})
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line_no")
    part_keys = {f"p{s}_{q}": _part_key(F.col("line"), n - s, q) for s in (0, 1) for q in range(PARTS)}
    if edits > 1:  # segments find the longer lines' neighbours
        part_keys = {name: F.when(n <= min_chars, key) for name, key in part_keys.items()}
    segment_keys = _segment_keys(F.col("line"), n, edits, min_chars) if edits > 1 else {}
    firsts = cut(keyed.withColumns(part_keys | segment_keys).groupBy("l1", "l2").agg(
        F.min(order).alias("first"), F.min("n").alias("n"), *[F.min(k).alias(k) for k in part_keys | segment_keys]), "firsts")

    # lines that agree with another one in all but one part
    entries = F.explode(F.array(*[
        F.struct(F.col(f"p{s}_{q}").alias("key"), ((F.col("n") - s) * PARTS + q).alias("code")) for s in (0, 1) for q in range(PARTS)]))
    parts = firsts.where((F.col("n") >= (0 if short_edits else min_chars)) & ((F.col("n") <= min_chars) | F.lit(edits == 1)))
    parts = parts.select("first.doc_id", "first.line_no", entries.alias("e")).select("doc_id", "line_no", "e.*")
    shared = parts.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    near = parts.join(shared, "key").select("doc_id", "line_no", "code").distinct()
    near = cut(near.select("doc_id", "line_no", F.floor(F.col("code") / PARTS).cast("int").alias("size"), (F.col("code") % PARTS).alias("part")), "near")
    own = near.select("doc_id", "line_no").distinct()
    at = [F.col("doc_id").eqNullSafe(F.col("__id")), F.col("line_no") == F.col("__no")]
    # these rows grow with the data and are not to be broadcast, however few they are
    wanted = cut(worded.join(own.select(F.col("doc_id").alias("__id"), F.col("line_no").alias("__no")).hint("merge"), at, "left_semi")
                 .dropDuplicates(["doc_id", "line_no"]), "lines")
    w = wanted.select(F.col("doc_id").alias("__id"), F.col("line_no").alias("__no"), "line")
    candidates = near.join(w, at).select("doc_id", "line_no", "size", "part", "line")

    # variants as keys; the earliest line and the earliest variant of every bucket
    kind = rows.schema["doc_id"].dataType.simpleString()
    emitted = cut(candidates.mapInArrow(_emit, f"doc_id {kind}, line_no int, k1 long, k2 long, kind byte").distinct(), "variants")
    earliest = emitted.groupBy("k1", "k2").agg(
        F.min(F.when(F.col("kind") != 1, order)).alias("line_or_place"), F.min(F.when(F.col("kind") == 1, order)).alias("variant"))
    earliest = earliest.where("line_or_place IS NOT NULL")
    facing = F.when(F.col("kind") == 0, F.col("variant")).otherwise(F.col("line_or_place"))
    found = emitted.join(earliest, ["k1", "k2"]).select("doc_id", "line_no", order.alias("own"), facing.alias("other")).where("other < own")
    pairs = found.select("doc_id", "line_no", F.col("other.doc_id").alias("o_id"), F.col("other.line_no").alias("o_no")).distinct()

    # verify
    a = wanted.select(F.col("doc_id").alias("__id"), F.col("line_no").alias("__no"), F.col("line").alias("a"))
    b = wanted.select(F.col("doc_id").alias("__oid"), F.col("line_no").alias("__ono"), F.col("line").alias("b"))
    checked = (pairs.join(a, at).join(b, [F.col("o_id").eqNullSafe(F.col("__oid")), F.col("o_no") == F.col("__ono")])
               .where(F.levenshtein("a", "b", 1).between(0, 1)).select("doc_id", "line_no").distinct())
    copies = cut(checked, "copies")

    # a line stays if it is the first of its equals and no earlier line is near
    first = firsts.join(
        copies.select(F.col("doc_id").alias("__id"), F.col("line_no").alias("__no")),
        [F.col("first.doc_id").eqNullSafe(F.col("__id")), F.col("first.line_no") == F.col("__no")], "left")
    if edits > 1:
        settled = first.where("__no IS NOT NULL").select("l1", "l2").distinct()
        far = cut(_near_earlier(firsts, settled, keyed, list(segment_keys), edits, min_chars), "far_copies").withColumn("far", F.lit(True))
        first = first.join(far, ["l1", "l2"], "left").withColumn("__no", F.coalesce("__no", F.when(F.col("far"), F.lit(0))))
    first = first.select("l1", "l2", F.when(F.col("__no").isNull(), F.col("first")).alias("first"))
    here = keyed.select("l1", "l2", "doc_id", "line_no")
    gone = here.join(first, ["l1", "l2"]).where(F.col("first").isNull() | (order != F.col("first"))).select("doc_id", "line_no")
    dropped = gone.groupBy(F.col("doc_id").alias("__id")).agg(F.array_sort(F.collect_set("line_no")).alias("dropped"))
    counts = rows.select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"))
    none = F.array().cast("array<int>")
    out = counts.join(dropped, F.col("doc_id").eqNullSafe(F.col("__id")), "left").withColumn("dropped", F.coalesce("dropped", none))
    return out.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "dropped")


def without_dropped(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The texts of (doc_id, text) ``docs`` without the lines that ``decisions`` drop: doc_id, text."""
    import pyarrow as pa

    gone = decisions.where("n_dropped > 0").select(F.col("doc_id").alias("__id"), "dropped").dropDuplicates(["__id"])
    rows = texts(docs)
    both = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")), "left").select("doc_id", "text", "dropped")

    def run(batches):
        for b in batches:
            out = []
            for text, drop in zip(b.column("text").to_pylist(), b.column("dropped").to_pylist(), strict=True):
                drop = set(drop or ())
                out.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop) if drop else text)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return both.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
