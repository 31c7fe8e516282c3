"""Quality classifier: supervised word and character n-gram vectors.

A document is the mean of the vectors of its features: each word and the
character n-grams of the word with its borders, hashed into one table; a word
that repeats the one before it is one feature of its own. A
softmax layer over the mean gives the classes. The table and the layer are
learned together by plain stochastic gradient descent in numpy, on a bounded
sample of labelled rows. Each word's features enter the score as one sum, so
the distinct words of a block of texts are scored once, all together in numpy;
the whole text counts. In the fit a text with more than 65,535 of one feature
keeps the shares of its features, rounded.

Labels, language, source and id never enter a score; the id only decides which
labelled rows are held out (crc32 of the id as text, modulo 5, is 0).

Cases: null and empty texts, and texts without words, have the mean 0 and get
the score that the layer's bias gives. Labels that are null, or of documents
that are absent, are left out; a document with several labels counts as 1 if at
least half of them are 1. Without any label every score is 0.5. A null id is
not held out. Repeated rows get equal scores, an empty table an empty result.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .chunks import byte_blocks, numbered_words, ragged
from .rows import map_texts, texts

#: Labelled rows that the fit uses at most, the first by a hash of their id.
MAX_ROWS = 3000
#: Rows of the table of vectors, and so the most features that a labelled row can send to the driver.
BUCKETS = 1 << 15
DIM = 12
GRAMS = (3, 4)
EPOCHS = 8
RATE = 0.4
PREDICT = 0.3
#: Bytes of text scored together.
BLOCK = 1 << 20
#: Stands for a repeated word; white space keeps it apart from all words.
AGAIN = b" again "


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every feature of some words: the word itself and its character n-grams."""
    from zlib import crc32

    which = [np.arange(len(words))]
    bucket = [np.fromiter((crc32(w) % BUCKETS for w in words), np.int64, len(words))]
    # the n-grams of all words are hashed together
    bordered = [f"<{w.decode()}>" if w != AGAIN else "" for w in words]
    points = np.frombuffer("".join(bordered).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, bordered), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    for n in GRAMS:
        many = np.maximum(sizes - n + 1, 0)
        at = ragged(np.arange(len(points)), starts, many)
        h = np.full(len(at), n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                h = (h ^ points[at + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        which.append(np.repeat(np.arange(len(words)), many))
        bucket.append((h % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(which), np.concatenate(bucket)


def word_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Numbers, rows and distinct words; a word that repeats the one before it counts as ``AGAIN`` instead."""
    number, row, words = numbered_words(texts)
    again = np.zeros(len(number), bool)
    again[1:] = (number[1:] == number[:-1]) & (row[1:] == row[:-1])
    return np.where(again, len(words), number), row, [*words, AGAIN]


def counted(text: str) -> dict[bytes, int]:
    """How often each word stands in one text."""
    number, _, words = word_counts(pa.array([text], pa.string()))
    return {words[i]: int(n) for i, n in zip(*np.unique(number, return_counts=True))}


@dataclass
class Model:
    """What a feature adds to the margin, and the layer's bias."""

    gain: np.ndarray
    bias: float

    def scores(self, batch: list[str] | pa.Array) -> np.ndarray:
        out = []
        for texts_ in byte_blocks(batch if isinstance(batch, pa.Array) else pa.array(batch, pa.string()), BLOCK):
            number, row, words = word_counts(texts_)
            which, bucket = features(words)
            gain = np.bincount(which, self.gain[bucket], len(words))
            many = np.bincount(which, minlength=len(words))
            total = np.bincount(row, gain[number], len(texts_))
            n = np.bincount(row, many[number], len(texts_))
            margin = self.bias + np.divide(total, n, out=np.zeros(len(texts_)), where=n > 0)
            out.append(1 / (1 + np.exp(-np.clip(margin, -700, 700))))
        return np.concatenate(out) if out else np.zeros(0)


def train(bags: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 1) -> Model:
    """Fit the vectors and the softmax layer to (buckets, counts, label) of documents."""
    if not bags:
        return Model(np.zeros(BUCKETS), 0.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    shares = [(ids, (counts / counts.sum()).astype(np.float32)[:, None], label) for ids, counts, label in bags if len(ids)]
    steps, total = 0, EPOCHS * max(1, len(shares))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(shares)):
            ids, share, label = shares[i]
            rate = RATE * (1 - steps / total)
            rows = vectors[ids]
            mean = (rows * share).sum(0)
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            down = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= rate * 0.1 * p
            # a row moves with its share; scaled up, as a document has very many features
            vectors[ids] = rows - rate * np.minimum(share * len(ids), 5.0) * down
            steps += 1
    side = layer[:, 1] - layer[:, 0]
    return Model((vectors @ side).astype(np.float64), float(bias[1] - bias[0]))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and how often each occurs; beyond 16 bits all counts of the text are scaled down alike."""
    number, _, words = word_counts(pa.array([text], pa.string()))
    which, bucket = features(words)
    times = np.bincount(number, minlength=len(words))
    counts = np.bincount(bucket, times[which], BUCKETS)
    ids = np.flatnonzero(counts)
    counts = counts[ids]
    if len(counts) and counts.max() > 65535:
        counts = np.maximum(1, np.rint(counts * (65535 / counts.max())))
    return ids.astype(np.uint16), counts.astype(np.uint16)


def _bags():
    def each(batch: list[str]) -> list:
        got = [bag(t) for t in batch]
        return [[i.tobytes() for i, _ in got], [c.tobytes() for _, c in got]]
    return each


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Learn from at most ``max_rows`` labelled rows that are not held out.

    Their features are counted in tasks, in at most ``BUCKETS`` pairs of two
    bytes each a row, so what reaches the driver in the one job is bounded by
    rows, not by lengths of texts.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("label"))
    # labels of absent documents must not use up the sample
    present = docs.select(F.col("doc_id").alias("__id"))
    known = known.join(present, F.col("doc_id") == F.col("__id"), "left_semi")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # the limit bounds what is broadcast
    rows = texts(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")
    # one row per id, even where rows repeat
    got = map_texts(rows, "ids binary, counts binary", _bags).groupBy("doc_id").agg(F.min(F.struct("label", "ids", "counts")).alias("b")).collect()
    bags = sorted((r.doc_id, r.b.label, bytes(r.b.ids), bytes(r.b.counts)) for r in got)
    return train([(np.frombuffer(i, np.uint16).astype(np.int32), np.frombuffer(c, np.uint16).astype(np.float32), label) for _, label, i, c in bags])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    def start():
        return lambda batch: [model.scores(batch)]

    out = map_texts(texts(docs, id_col, text_col), "score double", start, arrow=True)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, scored in the same pass.

    A text goes to Python once and comes back with its row; only a column that
    is no string is sent beside its text.
    """
    model = fit(docs, labels)

    def start():
        return lambda batch: [model.scores(batch.fill_null(""))]

    text, mine = "text", docs
    if docs.schema["text"].dataType != StringType():
        text, mine = "__text", docs.withColumn("__text", F.col("text").cast("string"))
    return map_texts(mine, "__score double", start, text, arrow=True, stay=True).where(F.col("__score") >= PREDICT).select(docs.columns)
