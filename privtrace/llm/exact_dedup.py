"""Exact deduplication with an extendible-hash index on shared files.

Key of a text: 64 bits of xxhash. The directory starts with one bucket and
doubles while a bucket holds more distinct keys than its capacity; only the
overfull buckets split, so buckets have their own depths. The index is a table
in the shared folder, dealt to owner tasks by ranges of buckets; an owner
chains the distinct texts that collide under one key. Distinct texts are told
apart by Spark's grouping on (key, text), which compares bytes and combines
copies before the shuffle, so a group of any size arrives as one row per task.
Looking a document up needs its key only, as long as one text stands under that
key: then all documents of the key have been compared with it. Where a chain is
longer, the text itself decides.

Cases: a null text counts as empty; empty texts are equal to one another. Of
repeated rows (same id and text) one is kept. A null id loses to any other; a
group with null ids only keeps one of its rows, with a null keep_id. An empty
table gives an empty result.
"""
from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .rows import texts

#: Distinct keys a bucket may hold before it splits.
CAPACITY = 100_000
#: The directory doubles no further; keys that agree in so many bits are chained.
MAX_DEPTH = 40


def _prefix(key: str, depth: Column | int) -> Column:
    """The leading ``depth`` bits of a key."""
    d = F.lit(depth) if isinstance(depth, int) else depth
    return F.when(d == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", F.col(key), (F.lit(64) - d).cast("int")))


def build_directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """The directory of the distinct ``key`` values: (bucket, depth), and the global depth.

    A bucket is a prefix of as many bits as its own depth says; it stands for
    all slots of the directory that begin with it. Counting is done by Spark; each doubling
    sends one flag to the driver. Counts of all depths come from one table of
    leaves, 64 times as many as buckets are expected.
    """
    spark = keys.sparkSession
    fine = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, keys.count()) / capacity))) + 6)
    leaves = cut(keys.groupBy(_prefix("key", fine).alias("leaf")).agg(F.count("*").alias("n")), "leaves")
    full = spark.createDataFrame([(0,)], "prefix long")
    done, depth = None, 0
    while True:
        if depth <= fine:
            counted = leaves.groupBy(F.shiftright("leaf", fine - depth).alias("prefix")).agg(F.sum("n").alias("n"))
        else:
            counted = keys.groupBy(_prefix("key", depth).alias("prefix")).agg(F.count("*").alias("n"))
        counted = cut(counted.join(full, "prefix").select("prefix", F.lit(depth).alias("depth"), (F.col("n") > capacity).alias("over")), "buckets")
        settled = counted.where(~F.col("over") | F.lit(depth >= MAX_DEPTH)).select("prefix", "depth")
        done = settled if done is None else done.union(settled)
        if depth >= MAX_DEPTH or counted.where("over").isEmpty():
            break
        depth += 1
        half = counted.where("over")
        full = half.select((F.col("prefix") * 2).alias("prefix")).union(half.select(F.col("prefix") * 2 + 1))
    return done.select(F.col("prefix").alias("bucket"), "depth"), depth


def build_index(docs: DataFrame, key: Callable[[Column], Column] = F.xxhash64, capacity: int = CAPACITY) -> DataFrame:
    """The index of (doc_id, text) rows, written to the shared folder.

    One row per distinct text: bucket, depth, key, chain (its place among the
    texts of the key), chained (how many these are), keep_id, group_size.
    """
    groups = (docs.withColumn("key", key("text")).groupBy("key", "text")
              .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    entries = cut(groups.select("key", F.length("text").alias("size"), "keep_id", "group_size"), "entries")
    directory, depth = build_directory(entries.select("key").distinct(), capacity)
    levels = directory.select("depth").distinct()
    local = [r[0] for r in levels.collect()]  # at most MAX_DEPTH numbers
    tries = F.array(*[F.struct(_prefix("key", d).alias("bucket"), F.lit(d).alias("depth")) for d in sorted(local) or [0]])
    found = (entries.withColumn("at", F.explode(tries)).select("*", "at.bucket", "at.depth").drop("at")
             .join(directory, ["bucket", "depth"]))
    owners = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = _first_key()
    owned = found.withColumn("start", first).repartitionByRange(owners, "start", "key")
    chain = Window.partitionBy("start", "key")
    return cut(owned.withColumn("chain", F.row_number().over(chain.orderBy("size", "keep_id")))
               .withColumn("chained", F.count("*").over(chain)).drop("start").sortWithinPartitions("depth", "bucket", "key"), "index")


def _first_key() -> Column:
    """The smallest key of a row's bucket, which orders buckets along the key space."""
    return F.expr("CASE WHEN depth = 0 THEN 0L ELSE shiftleft(bucket, 64 - depth) END")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    key: Callable[[Column], Column] = F.xxhash64, capacity: int = CAPACITY,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, chain."""
    rows = texts(docs, id_col, text_col)
    index = build_index(rows, key, capacity)
    seen = (rows.select("doc_id", key("text").alias("key"), F.sha2("text", 256).alias("text_sha256"))
            .groupBy("doc_id", "key", "text_sha256").agg(F.count("*").alias("n")))
    cols = ["doc_id", "keep_id", "group_size", "text_sha256", "chain", "n"]
    out = seen.join(index.where("chained = 1"), "key").select(*cols)
    chained = index.where("chained > 1")
    if not chained.isEmpty():
        out = out.union(_compare(rows, chained.select("key").distinct(), key).select(*cols))
    first = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")
    return out.select("*", first).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        "text_sha256", "chain")


def _compare(rows: DataFrame, keys: DataFrame, key: Callable[[Column], Column]) -> DataFrame:
    """Rows whose key several texts share, matched by their bytes."""
    some = rows.withColumn("key", key("text")).join(keys, "key", "left_semi")
    order = Window.partitionBy("key").orderBy(F.length("text"), "keep_id", "text")
    groups = (some.groupBy("key", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
              .withColumn("chain", F.row_number().over(order)))
    one = some.groupBy("key", "text", "doc_id").agg(F.count("*").alias("n"))
    return one.join(groups, ["key", "text"]).withColumn("text_sha256", F.sha2("text", 256))


def drop_copies(docs: DataFrame, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``docs`` without the copies, all its columns kept.

    The kept rows are found by (id, key, digest), which are joined back to the
    texts. Rows that repeat whole are made one.
    """
    mine = docs.withColumn("__text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    mine = mine.withColumn("__key", key("__text")).withColumn("__sha", F.sha2("__text", 256)).drop("__text")
    found = exact_dedup(docs, key=key).where("kept")
    stay = found.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__stay"))
    out = mine.join(stay, F.col("__sha").eqNullSafe(F.col("__stay")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    twice = cut(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__id")), "twice")
    if twice.isEmpty():
        return out.select(docs.columns)
    is_twice = F.col("doc_id").eqNullSafe(F.col("__id"))
    many = out.join(twice, is_twice, "left_semi").dropDuplicates(["doc_id", "__key", "__sha"])
    return out.join(twice, is_twice, "left_anti").union(many).select(docs.columns)
