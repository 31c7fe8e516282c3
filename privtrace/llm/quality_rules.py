"""Quality rules: statistics of a text, plain limits, and an isolation forest over the statistics.

The base rules reject short texts and texts in which eight-word windows repeat.
For the rest an isolation forest judges the statistics: random splits isolate
unusual documents early, so a short mean path marks an anomaly. The splits are
drawn inside the box of all labelled rows of good quality; how many of these
rows reach a node is counted over all of them, and a node that holds no more
than one in ``SAMPLE`` is a leaf. The limit on the anomaly score is the one that
best parts all labelled rows. Spark counts; the driver sees one number per node.

Cases: null and empty texts have no words and fail the base rules. Labels that
are null or without a document are left out; without any labelled row of good
quality, or without one of bad quality, the forest rejects nothing. Repeated
rows get equal verdicts, an empty table an empty result.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import running
from ..session import cut
from .rows import map_texts, texts

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30
SYMBOLS = "#*$%&|<>"
TREES = 100
#: Rows that a tree's depth and leaves are made for; more rows are weighed down to as many.
SAMPLE = 256
SEED = 7

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: Further statistics for the forest.
MORE = "n_chars long, n_upper long, n_letters long, n_distinct long, n_same_next long, n_bare long, n_marked long"


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """How many positions lie in windows that occur twice or more.

    Windows are named exactly: names of two neighbours of half the length are
    paired and numbered anew, three times for eight words.
    """
    n = len(ids)
    if n <= window:
        return 0
    names, size = ids.astype(np.int64), 1
    while size < window:
        left, right = names[:-size], names[size:]
        names = np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1]
        size *= 2
    count = np.bincount(names)
    twice = np.flatnonzero(count[names] > 1)
    if not len(twice):
        return 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str) -> tuple[int, ...]:
    """The numbers of ``BASE`` and ``MORE`` for one text."""
    data = text.encode()
    words = data.split()  # bytes split at the six ASCII white-space characters
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    chars = len(text)
    spaces = sum(map(text.count, " \t\n\v\f\r"))
    upper = sum(map(str.isupper, text))
    letters = sum(map(str.isalpha, text))
    same = int((ids[1:] == ids[:-1]).sum())
    distinct = list(number)
    kind = np.fromiter((not w.translate(None, _PUNCT) for w in distinct), bool, len(distinct))
    marked = np.fromiter((w[-1] in _MARKS for w in distinct), bool, len(distinct))
    return (len(words), chars - spaces, symbols, len(lines) - len(set(lines)), repeated_words(ids),
            chars, upper, letters, len(number), same, int(kind[ids].sum()) if len(ids) else 0, int(marked[ids].sum()) if len(ids) else 0)


_PUNCT = bytes(i for i in range(33, 127) if not chr(i).isalnum())
_MARKS = frozenset(b"#*$%&|<>!")


def _start():
    return lambda batch: list(zip(*map(statistics, batch), strict=True)) if batch else [[]] * 12


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and all statistics of each whole text."""
    return map_texts(texts(docs, id_col, text_col), f"{BASE}, {MORE}", _start)


def shares(s: np.ndarray) -> np.ndarray:
    """The forest's inputs, from rows of statistics: shares that do not depend on a text's length."""
    words, chars, symbols, dups, repeats, n, upper, letters, distinct, same, bare, marked = s.T.astype(np.float64)
    w, c = np.maximum(words, 1), np.maximum(chars, 1)
    return np.column_stack([
        symbols / w, repeats / w, upper / np.maximum(letters, 1), 1 - letters / c, same / w, bare / w, marked / w,
        np.minimum(chars / w, 40)])


#: Names of the forest's inputs in a table.
SHARES = [f"s{i}" for i in range(8)]


@dataclass
class Forest:
    """Complete trees as arrays in heap order: feature (-1 for a leaf), value; ``rest`` is the path a leaf still adds."""

    feature: np.ndarray
    value: np.ndarray
    rest: np.ndarray
    norm: float
    limit: float = float("inf")

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores in (0, 1): 2 ** (-mean path / expected path)."""
        total = np.zeros(len(x))
        depth = np.floor(np.log2(np.arange(self.feature.shape[1]) + 1))
        for at, rest in zip(self.leaves(x), self.rest, strict=True):
            total += (depth + rest)[at]
        return 2.0 ** (-total / len(self.feature) / self.norm)

    def leaves(self, x: np.ndarray):
        """The leaf of every row, tree by tree."""
        rows = np.arange(len(x))
        for f, v in zip(self.feature, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            while True:
                split = f[at]
                inner = split >= 0
                if not inner.any():
                    break
                at = np.where(inner, 2 * at + 1 + (x[rows, np.maximum(split, 0)] >= v[at]), at)
            yield at

    def masses(self, x: np.ndarray) -> np.ndarray:
        """How many rows end in each leaf, a line per tree."""
        return np.array([np.bincount(at, minlength=self.feature.shape[1]) for at in self.leaves(x)])


def _expected(n: np.ndarray) -> np.ndarray:
    """Mean path of a failed search among n points; n may be a fraction."""
    n = np.maximum(np.asarray(n, np.float64), 1.0)
    long = 2 * (np.log(np.maximum(n - 1, 1e-9)) + 0.5772156649) - 2 * (n - 1) / n
    return np.maximum(np.minimum(1.0, n - 1), long)


def plant(low: np.ndarray, high: np.ndarray, n: int, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> Forest:
    """Trees of random splits for ``n`` rows inside the box; a split value may lie outside what the rows hold."""
    rng = np.random.default_rng(seed)
    sample = min(sample, n)
    deep = max(1, int(np.ceil(np.log2(max(2, sample)))))
    margin = np.maximum(high - low, 0.05)
    size, inner = 2 ** (deep + 1) - 1, 2**deep - 1
    feature, value = np.full((trees, size), -1), np.zeros((trees, size))
    every = np.arange(trees)
    boxes = {0: (np.tile(low - margin, (trees, 1)), np.tile(high + margin, (trees, 1)))}
    for at in range(inner):
        lo, hi = boxes.pop(at)
        j = rng.integers(len(low), size=trees)
        split = rng.uniform(lo[every, j], hi[every, j])
        feature[:, at], value[:, at] = j, split
        up, down = hi.copy(), lo.copy()
        up[every, j] = down[every, j] = split
        boxes[2 * at + 1], boxes[2 * at + 2] = (lo, up), (down, hi)
    return Forest(feature, value, np.zeros((trees, size)), max(1.0, float(_expected(sample))))


def weigh(forest: Forest, mass: np.ndarray, sample: int = SAMPLE) -> Forest:
    """The forest with leaves where few rows are left; ``mass`` counts the rows at its lowest nodes."""
    mass = mass.astype(np.float64)
    for at in range(mass.shape[1] - 1, 0, -1):
        mass[:, (at - 1) // 2] += mass[:, at]
    n = mass[:, :1]
    mass = mass * (np.minimum(n, sample) / n)
    feature = np.where(mass <= 1 + 1e-9, -1, forest.feature)
    rest = np.where(feature < 0, _expected(mass), 0.0)
    return Forest(feature, forest.value, rest, forest.norm)


def grow(x: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> Forest:
    """An isolation forest on the rows of ``x``."""
    forest = plant(x.min(0), x.max(0), len(x), trees, sample, seed)
    return weigh(forest, forest.masses(x), sample)


def _grown(good: DataFrame) -> Forest | None:
    """``grow`` over a table of ``SHARES``: its box and the masses of its leaves are aggregates."""
    import pyarrow as pa

    box = good.agg(F.count("*"), *[F.min(c) for c in SHARES], *[F.max(c) for c in SHARES]).first()
    if not box[0]:
        return None
    forest = plant(np.array(box[1:9], np.float64), np.array(box[9:], np.float64), box[0])

    def count(batches):
        mass = None
        for b in batches:
            m = forest.masses(_matrix(b))
            mass = m if mass is None else mass + m
        if mass is not None:
            at = np.flatnonzero(mass)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(mass.ravel()[at])], names=["node", "n"])

    mass = np.zeros(forest.feature.size, np.int64)
    for r in good.select(*SHARES).mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).collect():
        mass[r["node"]] = r["n"]
    return weigh(forest, mass.reshape(forest.feature.shape))


def _matrix(b) -> np.ndarray:
    return np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in SHARES]) if b.num_rows else np.empty((0, len(SHARES)))


def calibrate(forest: Forest, rows: DataFrame) -> float | None:
    """The score that best parts good from bad rows: the most of both rates together, in the middle of a gap.

    At most one good row in a hundred may lie above it. None without good or without bad rows.
    """
    import pyarrow as pa

    def score(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(forest.scores(_matrix(b)), pa.float64()), b.column("label")], names=["score", "label"])

    points = cut(rows.mapInArrow(score, "score double, label int").groupBy("score").agg(
        F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad")), "scores")
    g, b = points.agg(F.sum("good"), F.sum("bad")).first()
    if not g or not b:
        return None
    seen = running(points, [], "score", {"g": ("sum", F.col("good")), "b": ("sum", F.col("bad"))}, ties=[])
    big = lambda c: F.col(c).cast("decimal(18,0)")
    gain = big("g") * F.lit(b).cast("decimal(18,0)") - big("b") * F.lit(g).cast("decimal(18,0)")
    lost = 100 * (F.lit(g) - F.col("g")) <= F.lit(g)
    best = seen.where(lost).orderBy(gain.desc(), "score").select("score").first()["score"]
    above = points.where(F.col("score") > best).agg(F.min("score")).first()[0]
    return best + 1e-9 if above is None else (best + above) / 2


def fit(measured: DataFrame, labels: DataFrame, label_col: str = "quality") -> Forest | None:
    """A calibrated forest from all labelled rows that pass the base rules."""
    import pyarrow as pa

    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("label"))
    joined = measured.join(known, "doc_id").where(~base_failed()).drop("doc_id")
    names = joined.columns

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = shares(np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in names[:-1]]))
                yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in x.T], b.column("label")], names=[*SHARES, "label"])

    rows = cut(joined.mapInArrow(run, ", ".join(f"{c} double" for c in SHARES) + ", label int"), "labelled")
    forest = _grown(rows.where("label = 1"))
    if forest is None:
        return None
    limit = calibrate(forest, rows)
    if limit is None:
        return None
    forest.limit = limit
    return forest


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEATED) * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, the five base numbers, anomaly, base_failed, kept."""
    import pyarrow as pa

    measured = cut(measure(docs, id_col, text_col), "statistics")
    forest = fit(measured, labels)
    names = [c for c in measured.columns if c != "doc_id"]
    base = [x.split()[0] for x in BASE.split(", ")]

    def run(batches):
        for b in batches:
            s = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in names]) if b.num_rows else np.empty((0, len(names)))
            score = forest.scores(shares(s)) if forest is not None else np.zeros(len(s))
            cols = [b.column("doc_id"), *(b.column(c) for c in base), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *base, "anomaly"])

    kind = measured.schema["doc_id"].dataType.simpleString()
    limit = forest.limit if forest is not None else float("inf")
    out = measured.mapInArrow(run, f"doc_id {kind}, {BASE}, anomaly double").withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= limit))
