"""Helpers the operators share: private column names, Arrow row maps, running sums, component labels."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .chunks import byte_blocks

#: What the contracts call a word: white space is the six ASCII characters only.
WORD = r"[^\x20\x09-\x0D]+"


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_as: str = "doc_id") -> DataFrame:
    """Only the id and the text, under fixed names; a null text becomes the empty one.

    Other columns are dropped, so that no name of theirs can clash.
    """
    return docs.select(F.col(id_col).alias(id_as), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _give_back() -> None:
    """Return free memory to the system: a worker lives on, beside others."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


#: Bytes of text that ``map_texts`` hands over and sends back at once.
SLICE = 4 << 20


def map_texts(df: DataFrame, schema: str, start: Callable[[], Callable[[list[str]], list]], text: str = "text", arrow: bool = False,
              stay: bool = False) -> DataFrame:
    """Add columns computed from ``text`` slice by slice; the other columns pass through and the text goes.

    With ``arrow`` the function gets the texts as they came, an Arrow array.
    With ``stay`` the text stays, so that it need not be sent twice.

    ``start`` runs once per task and returns a function from a list of texts to
    one list (or Arrow array) per column of ``schema``. Spark's batch may be all
    rows of a task; it is worked on and sent back in slices of ``SLICE`` bytes,
    and a longer text is a slice of its own.
    """
    keep = [f for f in df.schema.fields if stay or f.name != text]
    made = df.sparkSession.createDataFrame([], schema).schema
    out = type(made)([*keep, *made.fields])
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        each = start()
        kinds = [to_arrow_type(f.dataType) for f in made.fields]
        for whole in batches:
            at = 0
            for got in byte_blocks(whole.column(whole.schema.get_field_index(text)), SLICE):
                b = whole.slice(at, len(got))
                at += len(got)
                new = each(got if arrow else got.to_pylist())
                cols = [b.column(b.schema.get_field_index(n)) for n in names]
                cols += [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(new, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, *(f.name for f in made.fields)])
            _give_back()

    return df.mapInArrow(run, out)


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, total: str | None = None) -> DataFrame:
    """Add the sum of ``value`` over the earlier rows of the same keys (and over all of them as ``total``), for groups of any size.

    The rows are dealt into ranges of (keys, order), so that a key with a third
    of all rows covers many tasks. A row of totals per key and range gives each
    range its start; inside a range a window adds up. ``order`` must be total
    for a defined result.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, *keys, *order).withColumn("__range", F.spark_partition_id()), "ranged")
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (ranged.groupBy(*keys, "__range").agg(F.sum(value).alias("__sum"))
              .withColumn("__start", F.coalesce(F.sum("__sum").over(before), F.lit(0))))
    if total:
        starts = starts.withColumn(total, F.sum("__sum").over(Window.partitionBy(*keys)))
    s = starts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__range").alias("__r"), "__start",
                      *[total] * bool(total))
    on = F.col("__range") == F.col("__r")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(s, on).withColumn(name, F.col("__start") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return out.drop("__range", "__r", "__start", *[f"__k{i}" for i in range(len(keys))])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b) reaches.

    Rounds of the large-star and small-star steps: every node's neighbours are
    tied to the smallest one until nothing changes. A round is two aggregations
    joined back to the edges, written to the shared folder; the number of
    rounds grows with the logarithm of the longest chain. The driver sees one
    row of checksums per round.
    """
    def ends(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b"), F.col("a")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = ends(e) if large else e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("m", "u").alias("m"))
        out = both.join(least, F.col("u") == F.col("n"))
        tied = out.where("v > u" if large else "v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
        if not large:
            tied = tied.union(least.select(F.col("m"), F.col("n")))
        return tied.where("a <> b").distinct()

    now, seen = cut(edges.select("a", "b").where("a <> b").distinct(), "links"), None
    while True:
        now = cut(star(star(now, True), False), "links")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        now.select(F.col("a"), F.col("a")).distinct())


def words_of(text: Column) -> Column:
    """How many words a text has."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")
