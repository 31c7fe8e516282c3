"""Mixing sources to target weights by weighted sampling without replacement.

Every document gets the key -ln(u) / w: u a fixed uniform number of its id, w
its quality weight. Within a source documents are taken in the order of the
keys, so that the chance to come early follows the weight. A source's target is
a word budget. Complete epochs over the source come first; what is left of the
budget is filled from the front of the order, by a running sum. The document at
the edge of the budget is taken up to the budget.

Cases: a null text has no words and is never taken; a null source is a source,
the last one; a null id has its own fixed u. Ties of keys are broken by id and
size. Repeated rows count as documents of their own. A table without words has
targets 0, an empty table an empty result.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .rows import WORD, running_sum, words_of

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Fixed salt of the uniform numbers.
SALT = "mix"
#: Symbols that lower a document's quality weight.
SYMBOLS = "#*$%&|<>!"


def uniform(id_col: Column, salt: str = SALT) -> Column:
    """A number in (0, 1) that depends on the id only: 52 bits of its md5."""
    digits = F.substring(F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(f":{salt}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)


def symbol_weight(text: Column) -> Column:
    """Quality weight in (0, 1]: 1 / (1 + 10 * share of symbols)."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.lit(1.0) / (F.lit(1.0) + F.lit(10.0) * symbols / F.greatest(F.length(text), F.lit(1)))


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to (source, source_size): the share by weight, capped, the excess reshared.

    A round caps every source above its limit and shares the rest anew; each
    round reads two sums on the driver.
    """
    ranked = sources.withColumn("__rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    now = cut(ranked.withColumn("__w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int")).cast("long"))
              .withColumn("__cap", F.col("source_size") * max_epochs).drop("__rank"), "sources")
    total = now.agg(F.sum("source_size")).first()[0] or 0
    capped = F.lit(False)
    while True:
        held, open_w = now.agg(F.sum(F.when(capped, F.col("__cap")).otherwise(0)), F.sum(F.when(capped, 0).otherwise(F.col("__w")))).first()
        left, open_w = total - (held or 0), open_w or 1
        share = F.lit(left).cast("long") * F.col("__w") / F.lit(open_w)
        over = ~capped & (share > F.col("__cap"))
        if now.where(over).isEmpty():
            target = F.when(capped, F.col("__cap").cast("double")).otherwise(share.cast("double"))
            return now.select("source", "source_size", target.alias("target"))
        now = cut(now.withColumn("__capped", capped | over), "sources")
        capped = F.col("__capped")


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, quality: Column | None = None,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", salt: str = SALT,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, epochs, taken.

    ``quality`` is a positive weight over the columns of ``docs``; without it
    the share of symbols in the text gives one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    weight = symbol_weight(text) if quality is None else quality
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words_of(text).alias("size"),
        (-F.log(uniform(F.col(id_col), salt)) / weight).alias("__key"))
    rows = cut(rows, "sizes")
    want = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs), "targets")
    placed = running_sum(rows, ["source"], ["__key", "doc_id", "size"], "size", "__before")
    want = want.select(F.col("source").alias("__source"), "source_size", "target")
    out = placed.join(want, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    out = out.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    rest = F.floor(F.col("target") + 0.5).cast("long") - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("__before")))
    return out.select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + part).alias("taken"))


def mixed_documents(docs: DataFrame, whole: bool = False, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken.

    The copy of a document at the edge of its source's budget holds its leading
    words up to the budget; with ``whole`` it is taken whole, beyond the budget.
    Documents that the mix does not take are absent. Of
    rows that repeat whole, each gets the largest share of them.
    """
    told = (mix(docs, **options).where("taken > 0")
            .groupBy(F.col("doc_id").alias("__id"), F.col("size").alias("__size"), F.col("source").alias("__source"))
            .agg(F.max("taken").alias("__taken"), F.max("epochs").alias("__epochs")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    mine = docs.withColumn("__n", words_of(text))
    on = (F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__n") == F.col("__size"))
          & F.col("source").cast("string").eqNullSafe(F.col("__source")))
    part = F.col("__taken") - F.col("__epochs") * F.col("__n")
    if whole:
        part = F.when(part > 0, F.col("__n")).otherwise(F.lit(0))
    copies = F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("__epochs"), F.lit(1).cast("long"))), lambda i: F.col("__n"))
    copies = F.concat(F.when(F.col("__epochs") > 0, copies).otherwise(F.array().cast("array<bigint>")),
                      F.when(part > 0, F.array(part.cast("long"))).otherwise(F.array().cast("array<bigint>")))
    out = mine.join(told, on).withColumn("__take", F.explode(copies))
    words = F.slice(F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"), F.lit(1), F.col("__take").cast("int"))
    out = out.withColumn("text", F.when(F.col("__take") == F.col("__n"), F.col("text")).otherwise(F.array_join(words, "")))
    return out.select(docs.columns)


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         -ln((('0x' || substr(md5(doc_id::VARCHAR || ':{SALT}'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
           / (1.0::DOUBLE / (1.0::DOUBLE + 10.0::DOUBLE * (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '{SYMBOLS}', '')))
                     / greatest(length(coalesce(text, '')), 1))) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
c AS (SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST) AS i FROM r),
p AS (SELECT i, source, source_size, w,
        (SELECT sum(source_size) FROM c) - coalesce(sum(3 * source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_words,
        sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w
      FROM c),
f AS (SELECT min(i) AS i0 FROM p WHERE 3 * source_size * left_w >= left_words * w),
t AS (SELECT source, source_size,
        CASE WHEN i < (SELECT i0 FROM f) THEN (3 * source_size)::DOUBLE
             ELSE (SELECT left_words FROM p WHERE i = (SELECT i0 FROM f))::DOUBLE * w / (SELECT left_w FROM p WHERE i = (SELECT i0 FROM f)) END AS target
      FROM p),
x AS (SELECT d.doc_id, d.size, t.source_size::BIGINT AS source_size, t.target, d.source,
        CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS epochs,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target, epochs,
       (epochs * size + greatest(0, least(size, floor(target + 0.5)::BIGINT - epochs * source_size - before)))::BIGINT AS taken
FROM x
"""
