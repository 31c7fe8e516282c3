"""Which texts hold which values: an exact containment join.

A value is found through its rarest gram of 8, 4, 2 or 1 bytes, its anchor. One
Arrow-batched scan reads the texts once, looks at the grams of all sizes where
they stand in the batch's buffer, and lets only those through that pass two bit
arrays of the anchors: one of the grams, one of grams with their keys. What is
left meets the anchors in an equi-join on (keys, gram); values found that way
are verified in the texts of their events only.

The bit arrays are built by one aggregation and sized for a false-positive rate
of 1/16 up to 2**MOST_BITS bits; beyond that more grams pass, and the join
decides about them as it does about all. So the plan is the same for a vault of
any size, no value and no text is dropped, and a key that holds a third of all
rows is spread by its grams. Events may be repeated: each row is found by itself.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Bytes of a gram; each fits into a 64-bit number as it is.
GRAM_SIZES = (8, 4, 2, 1)
#: Upper and lower bound of a bit array's size, as powers of two.
MOST_BITS, LEAST_BITS = 27, 16
#: Bytes of text that are looked at together.
STEP = 1 << 21

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


class ValueIndex:
    """Anchors of the distinct values per key, built once and then used on any number of texts."""

    def __init__(self, vault: DataFrame, on=(), value: str = "value", case_sensitive: bool = False):
        self.on = list(on)
        self.case_sensitive = case_sensitive
        norm = F.col(value) if case_sensitive else F.lower(F.col(value))
        values = vault.select(*self.on, norm.alias("__v")).where(F.length("__v") > 0).distinct()
        self.anchors = cut(_anchors(cut(values, "values"), self.on), "anchors")
        sizes = {r[0]: r[1] for r in self.anchors.groupBy("__q").count().collect()}  # at most len(GRAM_SIZES) rows
        self.sizes = sorted(sizes)
        self.filters = _filters(self.anchors, self.on, sum(sizes.values())) if sizes else None

    def hits(self, events: DataFrame, text: str = "text", event_id: str = "event_id") -> DataFrame:
        """Event columns (without the text) and ``__v``, the normalised value found."""
        cols = [c for c in events.columns if c != text]
        norm = F.col(text) if self.case_sensitive else F.lower(F.col(text))
        ev = events.select(*cols, norm.alias("__t"))
        if not self.sizes:
            return ev.select(*cols).withColumn("__v", F.lit(None).cast("string")).where(F.lit(False))
        ids = list(dict.fromkeys(self.on + [event_id]))
        pieces = self._pieces(ev.select(*ids, _key(self.on), "__t"), ids)
        found = pieces.join(self.anchors, self.on + ["__q", "__g"]).groupBy(*ids).agg(F.collect_set("__v").alias("__vs"))
        kept = F.filter("__vs", lambda v: F.contains(F.col("__t"), v))
        return ev.join(found, ids).select(*cols, F.explode(kept).alias("__v"))

    def _pieces(self, texts: DataFrame, ids: list[str]) -> DataFrame:
        """(ids, __q, __g): the grams of each text that may be anchors of its key."""
        held, sizes = texts.sparkSession.sparkContext.broadcast(self.filters), self.sizes
        kinds = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in ids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            plain, keyed = held.value
            for b in batches:
                if not b.num_rows:
                    continue
                keys = b.column("__k").to_numpy(zero_copy_only=False).view(np.uint64)
                out = [[], [], []]
                for q, rows, grams in _each_gram(b.column("__t"), sizes, lambda g, q: _passes(plain, g, _salt(q))):
                    ok = _passes(keyed, grams, keys[rows] + _salt(q))
                    # a gram counts once per text
                    seen = np.unique(np.stack([rows[ok], grams[ok].view(np.int64)]), axis=1) if ok.any() else None
                    if seen is not None:
                        out[0].append(seen[0])
                        out[1].append(np.full(seen.shape[1], q, np.int32))
                        out[2].append(seen[1])
                if out[0]:
                    rows, q, g = map(np.concatenate, out)
                    cols = [b.column(c).take(pa.array(rows)) for c in ids]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(q), pa.array(g)], names=[*ids, "__q", "__g"])

        # a text over several blocks of STEP may name a gram twice; the aggregation behind the join folds it
        return texts.mapInArrow(run, f"{kinds}, __q int, __g bigint")

    def attach(self, hits: DataFrame, vault: DataFrame, value: str = "value") -> DataFrame:
        """Vault columns for the values found."""
        norm = F.col(value) if self.case_sensitive else F.lower(F.col(value))
        return hits.join(vault.withColumn("__v", norm), self.on + ["__v"]).drop("__v")


def contains_join(
    events: DataFrame,
    vault: DataFrame,
    on: list[str],
    *,
    text: str = "text",
    value: str = "value",
    event_id: str = "event_id",
    case_sensitive: bool = False,
) -> DataFrame:
    """Event columns (without the text) joined with vault columns wherever the text contains the value."""
    index = ValueIndex(vault, on, value, case_sensitive)
    return index.attach(index.hits(events, text, event_id), vault, value)


# --- grams ---------------------------------------------------------------------

def _key(on: list[str]):
    """Number of the keys, the same for the same values whatever their integer type."""
    return F.xxhash64(*[F.col(k).cast("string") for k in on], F.lit(0)).alias("__k")


def _salt(q: int) -> np.uint64:
    return np.uint64(q) << np.uint64(57)


def _slots(grams: np.ndarray, salt, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (grams ^ salt) * _ODD[0]
        x ^= x >> np.uint64(32)
        x *= _ODD[1]
    return x >> np.uint64(64 - bits)


def _passes(words: np.ndarray, grams: np.ndarray, salt) -> np.ndarray:
    at = _slots(grams, salt, len(words).bit_length() + 5)
    return (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def _each_gram(texts: pa.Array, sizes, keep=None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, rows, grams) of the grams in the texts' UTF-8, block by block; ``keep`` filters them first."""
    t = texts.fill_null("").cast(pa.large_binary())
    ends = np.frombuffer(t.buffers()[1], np.int64)[t.offset:t.offset + len(t) + 1]
    first, last = int(ends[0]), int(ends[-1])
    data = t.buffers()[2]
    for q in sizes:
        for lo in range(first, last - q + 1, STEP):
            n = min(STEP, last - q + 1 - lo)
            grams = np.ndarray((n,), f"<u{q}", data, lo, (1,)).astype(np.uint64)
            if keep is not None:
                at = np.flatnonzero(keep(grams, q))
                grams = grams[at]
                at += lo
            else:
                at = np.arange(lo, lo + n)
            rows = np.searchsorted(ends, at, "right") - 1
            inside = at + q <= ends[rows + 1]
            if inside.any():
                yield q, rows[inside], grams[inside]


def _anchors(values: DataFrame, on: list[str]) -> DataFrame:
    """(keys, __v, __q, __g): of each value's grams, of the largest size that it has, the rarest in the vault."""
    bytes_ = F.octet_length("__v")
    sized = values.withColumn("__q", F.lit(GRAM_SIZES[-1]))
    for q in reversed(GRAM_SIZES[:-1]):
        sized = sized.withColumn("__q", F.when(bytes_ >= q, F.lit(q)).otherwise(F.col("__q")))
    keep = [*on, "__v", "__q"]
    kinds = ", ".join(f"`{c}` {sized.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            wanted = b.column("__q").to_numpy()
            for q, rows, grams in _each_gram(b.column("__v"), GRAM_SIZES):
                own = wanted[rows] == q
                if own.any():
                    seen = np.unique(np.stack([rows[own], grams[own].view(np.int64)]), axis=1)
                    cols = [b.column(c).take(pa.array(seen[0])) for c in keep]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(seen[1])], names=[*keep, "__g"])

    pieces = sized.select(*keep).mapInArrow(run, f"{kinds}, __g bigint")
    freq = pieces.groupBy("__q", "__g").agg(F.count(F.lit(1)).alias("__n"))
    return pieces.join(freq, ["__q", "__g"]).groupBy(*keep).agg(F.min_by("__g", F.struct("__n", F.xxhash64("__g"))).alias("__g"))


def _filters(anchors: DataFrame, on: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The bit arrays (as 64-bit words) of the anchors' grams, and of their grams with their keys."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = b.column("__g").to_numpy().view(np.uint64)
            keys = b.column("__k").to_numpy().view(np.uint64)
            salt = b.column("__q").to_numpy().astype(np.uint64) << np.uint64(57)
            with np.errstate(over="ignore"):
                at = np.concatenate([_slots(grams, salt, bits), _slots(grams, keys + salt, bits)])
            kind = np.repeat(np.arange(2, dtype=np.int32), len(grams))
            word, bit = (at >> np.uint64(6)).astype(np.int32), np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(word), pa.array(bit.view(np.int64))], names=["kind", "word", "bits"])

    made = anchors.select("__q", "__g", _key(on)).mapInArrow(run, "kind int, word int, bits bigint")
    # at most 2 ** (MOST_BITS - 6) words of each kind
    got = made.groupBy("kind", "word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros((2, 1 << (bits - 6)), np.uint64)
    out[got["kind"].to_numpy(), got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out[0], out[1]
