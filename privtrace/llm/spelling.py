"""Spelling variants: words one edit apart, found by search schemes on bidirectional FM-indexes.

One edit leaves either the first or the second half of a word as it is. So a
word is searched twice in the vocabulary, every word of which stands between
delimiters: once its first half is matched exactly, from the middle to the left
delimiter, and the match is extended over the second half to the right with
exactly one error; once the other way round. A state is a pair of suffix-rank
intervals of the text and its reverse that are kept in step, and all words of a
cell are searched at once by numpy.

The vocabulary is dealt by the half that has to match: a word stands in the
shards of the halves by which near words can look for it, so that a word asks
the one shard of each of its halves. A shard above the bound of a cell is dealt
into a grid of cells, blocks of its vocabulary by blocks of its queries. Each
cell is a task's work for a moment, of bounded size, whatever half is frequent.

Cases: a null text has no word, a null id is written as the empty string.
Words of any length are searched; one that is longer than a cell's bound is a
cell of its own. Repeated rows count again. Ties of the most frequent near word
go to the smaller word. An empty table gives no row. Other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: What counts as a run of letters.
RUN = "[A-Za-zÀ-ÿ]+"
#: Characters of vocabulary in a cell.
CELL = 120_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class BiIndex:
    """Bidirectional FM-index of words, each between delimiters.

    ``below[i, c]`` counts the symbols smaller than c in the first i symbols of
    the transform, which gives both the next interval and the shift of its
    mirror image.
    """

    def __init__(self, words: list[str]):
        text = "\0" + "\0".join(words) + "\0"
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        self.letters, codes = np.unique(points, return_inverse=True)
        self.codes = codes.astype(np.int32)
        starts = np.flatnonzero(points == 0)
        self.word_at = np.full(len(points), -1, np.int32)
        self.word_at[starts[:-1]] = np.arange(len(words))
        order = self._order(self.codes)
        self.below = self._counts(self.codes, order)
        self.mirror = self._counts(self.codes[::-1], self._order(self.codes[::-1]))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.codes, minlength=len(self.letters)))]).astype(np.int64)
        self.order, self.n = order, len(points)

    @staticmethod
    def _order(codes: np.ndarray) -> np.ndarray:
        """Ranks of the rotations, by doubling."""
        rank, step, n = codes.astype(np.int64), 1, len(codes)
        while True:
            key = rank * (int(rank.max()) + 1) + np.roll(rank, -step)
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank = np.empty(n, np.int64)
            rank[order] = new
            step *= 2
            if new[-1] == n - 1 or step >= n:
                return order

    def _counts(self, codes: np.ndarray, order: np.ndarray) -> np.ndarray:
        last = codes[order - 1]
        out = np.zeros((len(codes) + 1, len(self.letters) + 1), np.int32)
        out[np.arange(1, len(codes) + 1), last + 1] = 1
        np.cumsum(out, axis=0, out=out)
        np.cumsum(out, axis=1, out=out)
        return out

    def extend(self, lo, mirror, size, c, right: bool):
        """The intervals after one more symbol at the right or left end."""
        table = self.mirror if right else self.below
        own, other = (mirror, lo) if right else (lo, mirror)
        end = own + size
        at, to = table[own, c], table[end, c]
        now = table[end, c + 1] - to - (table[own, c + 1] - at)
        own = self.first[c] + table[own, c + 1] - at
        other = other + (to - at)
        return (other, own, now) if right else (own, other, now)

    def every(self, lo, mirror, size, right: bool):
        """For every state and symbol that occurs there: (state, symbol, lo, mirror, size)."""
        table = self.mirror if right else self.below
        own = mirror if right else lo
        found = np.diff(table[own + size], axis=1) - np.diff(table[own], axis=1)
        state, c = np.nonzero(found)
        return (state, c, *self.extend(lo[state], mirror[state], size[state], c, right))

    def codes_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, one word per row, -1 beyond its end and -2 for letters that the index lacks; lengths)."""
        sizes = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        flat = np.where(self.letters[at] == points, at, -2)
        out = np.full((len(words), int(sizes.max(initial=0)) + 1), -1, np.int64)
        out[np.repeat(np.arange(len(words)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        return out, sizes

    def near(self, words: list[str], first: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word found) for words at exactly one edit, whose first (or second) half is that of the query.

        Every pair stands once.
        """
        q, sizes = self.codes_of(words)
        half, rows = sizes // 2, np.arange(len(words))
        # the exact half, from the middle outwards, then its delimiter
        lo, mirror, size = np.zeros_like(rows), np.zeros_like(rows), np.full_like(rows, self.n)
        length = half if first else sizes - half
        for k in range(int(length.max(initial=0)) + 1):
            live = np.flatnonzero((size > 0) & (k <= length))
            at = half[live] - 1 - k if first else half[live] + k
            c = np.where(k == length[live], 0, q[live, np.clip(at, 0, q.shape[1] - 1)])
            lost = c < 0
            c[lost] = 0
            got = self.extend(lo[live], mirror[live], size[live], c, right=not first)
            lo[live], mirror[live] = got[0], got[1]
            size[live] = np.where(lost, 0, got[2])
        # the other half, with states (query, next position, errors left, intervals)
        alive = np.flatnonzero(size > 0)
        at = half[alive] if first else half[alive] - 1
        state = (alive, at, np.ones_like(alive), lo[alive], mirror[alive], size[alive])
        step, found = (1 if first else -1), []
        for _ in range(int(sizes.max(initial=0)) + 3):
            query, at, left, lo, mirror, size = state
            if not len(query):
                break
            over = (at >= sizes[query]) if first else (at < 0)
            want = np.where(over, 0, q[query, np.clip(at, 0, q.shape[1] - 1)])
            parts = []
            # the symbol that stands there; behind the last one the delimiter ends the word
            ok = np.flatnonzero((want >= 0) & (~over | (left == 0)))
            got = self.extend(lo[ok], mirror[ok], size[ok], want[ok], right=first)
            keep = got[2] > 0
            ends = over[ok] & keep
            # a whole word between delimiters stands in one place: its row names the left one
            found.append((query[ok][ends], self.word_at[self.order[got[0][ends]]]))
            go = keep & ~over[ok]
            parts.append((query[ok][go], at[ok][go] + step, left[ok][go], *(x[go] for x in got)))
            err = np.flatnonzero(left > 0)
            if len(err):
                # one symbol of the query is left out
                out = err[~over[err]]
                parts.append((query[out], at[out] + step, np.zeros_like(out), lo[out], mirror[out], size[out]))
                # another symbol in its place, or one more
                s, c, *got = self.every(lo[err], mirror[err], size[err], right=first)
                s = err[s]
                inside = c > 0
                other = inside & ~over[s] & (c != want[s])
                parts.append((query[s][other], at[s][other] + step, np.zeros(other.sum(), np.int64), *(x[other] for x in got)))
                # one more of the same symbol as the next gives what the next round gives: once is enough
                more = inside & (over[s] | (c != want[s]))
                parts.append((query[s][more], at[s][more], np.zeros(more.sum(), np.int64), *(x[more] for x in got)))
            state = tuple(np.concatenate([p[i] for p in parts]) for i in range(6))
        a = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        b = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        # the text is a circle: its last delimiter and its first one would be an empty word
        a, b = a[b >= 0], b[b >= 0]
        pairs = np.unique(a.astype(np.int64) * (len(self.word_at) + 1) + b)
        return pairs // (len(self.word_at) + 1), pairs % (len(self.word_at) + 1)


# --- counting -----------------------------------------------------------------

def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97) -> Column:
    """The runs of a document, A-Z lower-cased; where ``every`` divides crc32 of id:run one letter is left out."""
    low = F.translate(F.col("__run"), UPPER, LOWER)
    h = F.crc32(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), low).cast("binary"))
    at = F.pmod(h, F.length(low)).cast("int")
    less = F.concat(F.substring(low, F.lit(1), at), F.substring(low, at + 2, F.length(low)))
    return F.when(h % every == 0, less).otherwise(low)


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5, min_count: int = 3,
          every: int = 97) -> DataFrame:
    """(word, n) of the distinct words that are long and frequent enough."""
    runs = docs.select(F.col(id_col).alias("__id"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"({RUN})"), F.lit(1))).alias("__run"))
    each = runs.where(F.length("__run") >= min_length).select(occurrences(runs, "__id", every=every).alias("word"))
    return (each.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_count))


# --- search -------------------------------------------------------------------

def _halves(word: Column, first: bool) -> Column:
    """The halves, as a query of one less, as many or one more code points would have them, that the word agrees with."""
    n = F.length(word)
    if first:
        cuts = [F.floor((n + d) / 2).cast("int") for d in (-1, 0, 1)]
        return F.array_distinct(F.transform(F.array(*cuts), lambda k: F.substring(word, F.lit(1), k)))
    cuts = [F.ceil((n + d) / 2).cast("int") for d in (-1, 0, 1)]
    return F.array_distinct(F.transform(F.array(*cuts), lambda k: F.substring(word, n - k + 1, k)))


def near_words(vocabulary: DataFrame, cell: int = CELL) -> DataFrame:
    """word, n_near, best (struct n, word) for the words of (word, n) that have near ones."""
    n_words, size = vocabulary.agg(F.count(F.lit(1)), F.sum(F.length("word") + 1)).first()
    shards = max(1, -(-4 * (size or 0) // cell))
    # half-filled shards leave room for chance
    shards = shards * 2 if shards > 1 else 1
    half = F.floor(F.length("word") / 2).cast("int")
    own = [F.substring("word", F.lit(1), half), F.substring("word", half + 1, F.length("word"))]
    rows = None
    for first in (True, False):
        entry = vocabulary.select("word", "n", F.lit(first).alias("first"), F.lit(False).alias("query"), F.explode(_halves(F.col("word"), first)).alias("half"))
        ask = vocabulary.select("word", "n", F.lit(first).alias("first"), F.lit(True).alias("query"), own[0 if first else 1].alias("half"))
        part = entry.union(ask)
        rows = part if rows is None else rows.union(part)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("half"), F.lit(shards)).cast("long")).drop("half")
    # a word may come into a shard by two of its halves
    rows = cut(rows.distinct(), "spelling-rows")
    full = rows.groupBy("first", "shard", "query").agg(F.sum(F.length("word") + 1).alias("size"))
    grid = full.groupBy("first", "shard").agg(
        *[F.coalesce(F.ceil(F.max(F.when(F.col("query") == q, F.col("size"))) / cell), F.lit(0)).alias(name)
          for q, name in ((False, "blocks"), (True, "asks"))]).where("blocks > 0 and asks > 0")
    g = rows.join(grid.withColumnsRenamed({"first": "__f", "shard": "__s"}),
                  (F.col("first") == F.col("__f")) & (F.col("shard") == F.col("__s"))).drop("__f", "__s")
    mine = F.pmod(F.xxhash64("word", F.lit(1)), F.when(F.col("query"), F.col("asks")).otherwise(F.col("blocks")))
    over = F.when(F.col("query"), F.col("blocks")).otherwise(F.col("asks"))
    dealt = g.select("first", "shard", "query", "word", "n", mine.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), over - 1)).alias("other"))
    dealt = dealt.select("first", "shard", F.when(F.col("query"), F.col("other")).otherwise(F.col("own")).alias("block"),
                         F.when(F.col("query"), F.col("own")).otherwise(F.col("other")).alias("ask"), "query", "word", "n")
    cell_key = ["first", "shard", "block", "ask"]
    n_tasks = int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = dealt.repartition(max(n_tasks, 1), *cell_key).sortWithinPartitions(*cell_key)
    best = cells.mapInArrow(search_cells, "word string, n_near long, n long, near string")
    return best.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min_by(F.struct("n", F.col("near").alias("word")), F.struct(-F.col("n"), "near")).alias("best"))


def search_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Searches cell by cell; the rows come sorted by cell, and one cell at a time is held."""
    def done(key, got):
        entries, asks = got
        names = ["word", "n_near", "n", "near"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        result = [[], [], [], []]
        if entries and asks:
            first = key[0]
            index = BiIndex([w for w, _ in entries])
            queries = [w for w, _ in asks]
            a, b = index.near(queries, first)
            rows: dict[int, list] = {}
            for i, j in zip(a.tolist(), b.tolist()):
                q, (w, n) = queries[i], entries[j]
                # a pair that agrees in both halves belongs to the first
                if not first and q[:len(q) // 2] == w[:len(q) // 2]:
                    continue
                now = rows.get(i)
                if now is None:
                    rows[i] = [1, n, w]
                else:
                    now[0] += 1
                    if (-n, w) < (-now[1], now[2]):
                        now[1:] = n, w
            result = [[queries[i] for i in rows], *([r[k] for r in rows.values()] for k in range(3))]
        return pa.record_batch([pa.array(x, k) for x, k in zip(result, kinds)], names=names)

    key, got = None, ([], [])
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("first", "shard", "block", "ask", "query", "word", "n")]
        for f, s, block, ask, query, word, n in zip(*cols):
            if (f, s, block, ask) != key:
                if key is not None:
                    yield done(key, got)
                key, got = (f, s, block, ask), ([], [])
            got[query].append((word, n))
    if key is not None:
        yield done(key, got)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms are followed to the last, by doubling.

    A form is at least twice as frequent, so chains are short and have no
    circle. The driver sees one number per round.
    """
    now = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = now.select(F.col("word").alias("__w"), F.col("root").alias("__r"))
        both = now.join(up, F.col("root") == F.col("__w"), "left")
        now = cut(both.select("word", F.coalesce("__r", "root").alias("root"), F.col("__r").isNotNull().alias("moved")), "roots")
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")
        now = now.drop("moved")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5, min_count: int = 3,
                      every: int = 97, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    vocabulary = cut(words(docs, id_col, text_col, min_length, min_count, every), "vocabulary")
    near = near_words(vocabulary).withColumnRenamed("word", "__w")
    has = F.col("best.n") >= ratio * F.col("n")
    all_words = cut(vocabulary.join(near, F.col("word") == F.col("__w"), "left").select(
        "word", F.when(has, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(has, F.col("best.n")).alias("form_n")), "spelling")
    last = roots(all_words.where(F.col("form").isNotNull())).withColumnRenamed("word", "__w")
    return all_words.join(last, F.col("word") == F.col("__w"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE_SQL = """
WITH RECURSIVE bits AS (
  SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)::BIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384)) AS v FROM range(256) t(i)),
tab AS (SELECT list(v ORDER BY i) AS t FROM bits),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
d AS (SELECT doc_id, run, count(*) AS k, coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run),
-- the UTF-8 bytes of a code point below 256
h AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(s, ''), lambda c:
      CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c) >> 6)::BIGINT, 128 + (unicode(c) & 63)::BIGINT] END))),
    lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) AS h
  FROM d, tab),
w AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, k FROM h),
v AS (SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i) || '|' || substr(word, i + 2) AS gap, substr(word, 1, i) || substr(word, i + 2) AS less
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.gap = b.gap AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN v b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN v b ON a.less = b.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS top, min(CASE WHEN n = m THEN other END) AS other
  FROM (SELECT *, max(n) OVER (PARTITION BY word) AS m FROM near) GROUP BY word),
f AS (
  SELECT v.word, v.n, CASE WHEN top >= 2 * v.n THEN other END AS form, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * v.n THEN top END AS form_n
  FROM v LEFT JOIN best USING (word)),
walk AS (
  SELECT word, coalesce(form, word) AS at_word, form IS NULL AS done FROM f
  UNION ALL
  SELECT k.word, coalesce(f.form, f.word), f.form IS NULL FROM walk k JOIN f ON f.word = k.at_word WHERE NOT k.done)
SELECT f.word, f.form, k.at_word AS root, f.n, f.n_near, f.form_n FROM f JOIN walk k ON k.word = f.word AND k.done
"""
