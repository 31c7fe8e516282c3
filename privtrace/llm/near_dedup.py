"""Near-duplicate documents: fast similarity sketching, banding, exact verification.

A document's set is its distinct shingles of ``width`` words (A-Z lower-cased).
The sketch has ``COORDS`` coordinates and is filled in rounds: in round i every
shingle is hashed into one coordinate with the value i + hash, and a coordinate
keeps its smallest value. After COORDS such rounds, round COORDS + j puts all
shingles into coordinate j, so every coordinate is filled whatever the set's
size; as soon as all are filled the rest cannot change anything and is left
out. Two sets agree in a coordinate with a probability that equals their
similarity, and the count of agreements is concentrated around it as if the
coordinates were independent.

The coordinates are cut into ``COORDS / ROWS`` bands. Texts with equal sets are
one class, named by its smallest id; classes that share a band are candidates.
A bucket is not expanded into pairs. Its most popular member, the one with most
companions over all bands, is its centre c; every member is verified against
the centre on the full sets, and links are joined to components. A pair x, y of
one bucket with x not linked to c can still be linked, but only within bounds.
With r(x) elements of c missing in x and k common elements outside c, the
intersection has at most |c| - max(r(x), r(y)) + k elements. So either k must
reach a known number, and the pair is found and counted by its common elements
outside c; or the pair passes with k = 0, which needs a y smaller than c, found
by size. Only pairs that pass the bound are verified. No candidate is lost: two
classes of one bucket are joined already, ruled out by the bound, or verified.
A pair of similarity 0.8 shares no band with a probability of
(1 - 0.8**5)**40 = 1e-7; nothing else is approximate but the 64-bit names of shingles.

Cases: null and empty texts, and texts without a word, have no shingle, are
linked with nothing and are kept. A text of fewer words than ``width`` has one
shingle, the whole of it. A row whose id is null is linked with nothing. Rows
repeated with one id share its component. An empty table gives an empty result.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .rows import components, map_texts, texts

ROWS = 5
BANDS = 40
COORDS = ROWS * BANDS
THRESHOLD = 80

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_MUL = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(2**64 - 1)
_VALUE = np.uint64(2**48 - 1)
#: Words whose hashes a task remembers.
_KNOWN = 200_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = _mix(np.arange(1, 2 * COORDS + 1, dtype=np.uint64) * _MUL)
_BAND = _mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class _Hashes(dict):
    """Word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _KNOWN:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, width: int, hashes: dict) -> np.ndarray:
    """The sorted distinct 64-bit names of a text's shingles."""
    words = text.encode().translate(_LOWER).split()  # bytes split at the six ASCII white-space characters
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    w = min(width, n)
    out = np.full(n - w + 1, w, np.uint64)
    for i in range(w):
        out = _mix(out * _MUL + h[i:n - w + 1 + i])
    return np.unique(out)


def sketch(s: np.ndarray) -> np.ndarray:
    """The coordinates of a non-empty set."""
    out = np.full(COORDS, _EMPTY, np.uint64)
    step, first = max(1, 2 * COORDS // len(s)), 0
    while first < COORDS and (out == _EMPTY).any():
        rounds = np.arange(first, min(COORDS, first + step))
        h = _mix(s[None, :] ^ _SEEDS[rounds, None])
        coord = ((h >> np.uint64(48)) * np.uint64(COORDS)) >> np.uint64(16)
        value = (rounds.astype(np.uint64)[:, None] << np.uint64(48)) | (h & _VALUE)
        np.minimum.at(out, coord.ravel().astype(np.int64), value.ravel())
        first += step
        step *= 2
    for j in np.flatnonzero(out == _EMPTY):
        h = _mix(s ^ _SEEDS[COORDS + j])
        out[j] = (np.uint64(COORDS + j) << np.uint64(48)) | (h & _VALUE).min()
    return out


def bands(s: np.ndarray) -> np.ndarray:
    rows = sketch(s).reshape(BANDS, ROWS)
    key = _BAND
    for i in range(ROWS):
        key = _mix(key * _MUL + rows[:, i])
    return key.view(np.int64)


def _sketcher(width: int):
    def start():
        import hashlib

        hashes = _Hashes()

        def each(batch: list[str]) -> list:
            sizes, names, keys = [], [], []
            for t in batch:
                s = shingles(t, width, hashes)
                sizes.append(len(s))
                names.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(bands(s) if len(s) else None)
            return [sizes, names, keys]
        return each
    return start


def _sets(width: int):
    def start():
        hashes = _Hashes()
        return lambda batch: [[shingles(t, width, hashes).tobytes() for t in batch]]
    return start


def linked(a: bytes, b: bytes, threshold: int = THRESHOLD) -> bool:
    """Whether 100 * intersection >= threshold * union, on full sets."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= threshold * (len(x) + len(y) - both)


def _verify(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    import pyarrow as pa

    def run(batches):
        for r in batches:
            ok = [linked(p, q, threshold) for p, q in zip(r.column("x").to_pylist(), r.column("y").to_pylist(), strict=True)]
            yield r.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    x = sets.select(F.col("rep").alias("a"), F.col("set").alias("x"))
    y = sets.select(F.col("rep").alias("b"), F.col("set").alias("y"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    return both.mapInArrow(run, f"a {kind}, b {kind}")


def _compare(sets: DataFrame, threshold: int) -> DataFrame:
    """Centres a and members b: their sizes, whether they are linked, how much of a is missing in b, and what b has besides."""
    import pyarrow as pa

    def run(batches):
        for r in batches:
            out = []
            for p, q in zip(r.column("x").to_pylist(), r.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                extra = np.setdiff1d(y, x, assume_unique=True)
                both = len(y) - len(extra)
                out.append((len(x), len(y), 100 * both >= threshold * (len(x) + len(y) - both), len(x) - both, extra.view(np.int64)))
            cols = [list(c) for c in zip(*out, strict=True)] if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [r.column("a"), r.column("b"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                names=["a", "b", "na", "nb", "linked", "missing", "extra"])

    kind = sets.schema["a"].dataType.simpleString()
    # written, so that the join stands on shuffles that Spark can split where one centre has very many members
    centres = cut(sets.where("a = b").select("a", F.col("set").alias("x")).dropDuplicates(["a"]), "centres")
    both = sets.where("a <> b").withColumnRenamed("set", "y").join(centres, "a")
    return both.select("a", "b", "x", "y").mapInArrow(
        run, f"a {kind}, b {kind}, na long, nb long, linked boolean, missing long, extra array<long>")


def _sets_of(docs: DataFrame, stars: DataFrame, width: int) -> DataFrame:
    """(a, b, set): the set of every member b beside its centre a, and of every centre beside itself; written to the shared folder.

    The texts are dealt out by id once. The pairs grow with the data and are
    not to be broadcast, however few they are.
    """
    need = stars.select("a", "b").union(stars.select("a", F.col("a"))).distinct()
    rows = docs.join(need.hint("merge"), docs.doc_id == need.b).select("a", "b", "text")
    return cut(map_texts(rows, "set binary", _sets(width)), "sets")


#: Sizes of one class differ by less than this factor.
_CLASS = 1.02


def _open_pairs(stars: DataFrame, label: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of members of one centre, not both linked to it, that may be linked by the bound."""
    t, u = F.lit(threshold), F.lit(100 + threshold)
    loose = stars.where("NOT linked").select("a").distinct()
    open_ = stars.join(loose, "a", "left_semi").select(F.col("a").alias("c"), F.col("b").alias("m"), F.col("na").alias("nc"), "nb", "linked", "missing", "extra")
    open_ = cut(open_.join(label, F.col("m") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "m")).drop("node", "component"), "open")

    def may(common):
        """Different components, not both linked, compatible sizes, and the bound with ``common`` elements outside c."""
        return ((F.col("p_comp") != F.col("q_comp")) & ~(F.col("p_linked") & F.col("q_linked"))
                & (F.lit(100) * F.least("p_nb", "q_nb") >= t * F.greatest("p_nb", "q_nb"))
                & (u * (F.col("nc") - F.greatest("p_missing", "q_missing") + common) >= t * (F.col("p_nb") + F.col("q_nb"))))

    # by common elements outside the centre; those of one member only cannot be common
    each = open_.select("c", "m", F.explode("extra").alias("s"))
    common = cut(each.join(each.groupBy("c", "s").agg(F.count("*").alias("k")).where("k > 1").select("c", "s"), ["c", "s"]), "common")
    useful = common.groupBy("c", "m").agg(F.count("*").alias("useful"))
    some = common.join(open_.drop("extra").join(useful, ["c", "m"]), ["c", "m"])
    p = some.select("c", "s", "nc", *[F.col(x).alias(f"p_{x}") for x in ("m", "nb", "linked", "missing", "comp", "useful")])
    q = some.select("c", "s", *[F.col(x).alias(f"q_{x}") for x in ("m", "nb", "linked", "missing", "comp", "useful")])
    met = p.join(q, ["c", "s"]).where((F.col("p_m") < F.col("q_m")) & may(F.least("p_useful", "q_useful")))
    counted = met.groupBy("c", "p_m", "q_m").agg(F.count("*").alias("k"), *[F.first(x).alias(x) for x in ("nc", "p_nb", "q_nb", "p_missing", "q_missing")])
    by_common = counted.where(u * (F.col("nc") - F.greatest("p_missing", "q_missing") + F.col("k")) >= t * (F.col("p_nb") + F.col("q_nb")))

    # by size: the other one must fit into the room that an unlinked member leaves
    size_class = lambda n: F.floor(F.log(n.cast("double")) / float(np.log(_CLASS))).cast("int")
    room = F.floor((u * (F.col("nc") - F.col("missing")) - t * F.col("nb")) / t)
    least = F.ceil(t * F.col("nb") / F.lit(100))
    big = open_.where("NOT linked").withColumn("room", room).where(F.col("room") >= least)
    big = big.withColumn("class", F.explode(F.sequence(size_class(least), size_class(F.col("room")))))
    p = big.select("c", "class", "nc", *[F.col(x).alias(f"p_{x}") for x in ("m", "nb", "linked", "missing", "comp")])
    q = open_.withColumn("class", size_class(F.col("nb"))).select("c", "class", *[F.col(x).alias(f"q_{x}") for x in ("m", "nb", "linked", "missing", "comp")])
    by_size = p.join(q, ["c", "class"]).where(may(F.lit(0)))
    both = by_common.select("p_m", "q_m").union(by_size.select("p_m", "q_m"))
    return both.select(F.least("p_m", "q_m").alias("a"), F.greatest("p_m", "q_m").alias("b")).distinct()


def near_dedup(
    docs: DataFrame, width: int = 5, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    ``threshold`` is in hundredths; bands are laid out for 80 and more.
    """
    rows = texts(docs, id_col, text_col)
    sketched = cut(map_texts(rows, "n_shingles long, name binary, bands array<long>", _sketcher(width)), "sketches")
    some = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut(some.groupBy("name").agg(F.min("doc_id").alias("rep")), "classes")
    banded = (some.join(classes, (some.name == classes.name) & (F.col("doc_id") == F.col("rep")))
              .select("rep", F.explode("bands").alias("key")))
    several = banded.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    shared = cut(banded.join(several, "key"), "buckets")
    popular = shared.groupBy("rep").agg(F.sum("members").alias("popularity"))
    ranked = shared.select("key", "rep").join(popular, "rep")
    centre = ranked.groupBy("key").agg(F.max(F.struct("popularity", "rep")).alias("top")).select("key", F.col("top.rep").alias("c"))
    stars = cut(shared.select("key", "rep").join(centre, "key").where("rep <> c").select(F.col("c").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    sets = _sets_of(rows, stars, width)
    compared = cut(_compare(sets, threshold), "compared")
    links = compared.where("linked").select("a", "b")
    label = cut(components(links), "components")
    more = cut(_open_pairs(compared, label, threshold), "pairs")
    if not more.isEmpty():
        named = sets.select(F.col("b").alias("rep"), "set").dropDuplicates(["rep"])
        label = cut(components(links.union(_verify(more, named, threshold))), "components")

    of_class = classes.join(label, F.col("rep") == F.col("node"), "left").select(
        F.col("name").alias("__name"), F.coalesce("component", "rep").alias("component_id"))
    out = sketched.join(of_class, (F.col("name") == F.col("__name")) & F.col("doc_id").isNotNull(), "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, width: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that resemble an earlier one of their component."""
    gone = near_dedup(docs, width, threshold).where("NOT kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__id"), "left_anti").select(docs.columns)
