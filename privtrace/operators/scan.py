"""Running aggregates over groups of any size.

A window ``partitionBy(key).orderBy(x)`` sorts a whole group in one task. Here
the rows are dealt into ranges of (keys, order) instead, as many as there are
shuffle partitions; Spark samples the bounds, so a key with a third of all rows
covers a third of the ranges. Ranges are scanned in parallel, and the carry of
all earlier ranges of the key is added. The result is the exact one.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

_CARRY = {"sum": F.sum, "max": F.max, "count": F.sum}


def with_range(df: DataFrame, keys: list[str], order: list[str], name: str = "__range") -> DataFrame:
    """Add a range number that rises along (keys, order); the table is written, so that the number stays with the row."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *keys, *order).withColumn(name, F.spark_partition_id()), "ranges")


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    aggs: dict[str, tuple],
    ties: list[str] | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """Add running aggregates along ``order``: name -> (``sum``, ``max`` or ``count``, expression[, inclusive]).

    ``ties`` breaks equal order values; without ties equal values are peers and
    see the same result: they are aggregated first, and the result is joined back.
    """
    keys = list(keys)
    ins = {}
    for n, spec in aggs.items():
        fn, e = spec[0], spec[1]
        e = F.when(e.isNotNull(), 1).otherwise(0) if fn == "count" else e
        ins[n] = (fn, e, spec[2] if len(spec) > 2 else inclusive)
    if ties is None:
        if not all(incl for _, _, incl in ins.values()):
            raise ValueError("exclusive running aggregates need tie columns; aggregate peers first")
        peers = df.groupBy(*keys, order).agg(*[_CARRY[fn](e).alias(f"__p_{n}") for n, (fn, e, _) in ins.items()])
        run = running(peers, keys, order, {n: ("max" if fn == "max" else "sum", F.col(f"__p_{n}")) for n, (fn, _, _) in ins.items()}, ties=[])
        right = run.select(*[F.col(c).alias(f"__j_{c}") for c in [*keys, order]], *ins)
        on = None
        for c in [*keys, order]:
            same = F.col(c).eqNullSafe(F.col(f"__j_{c}"))
            on = same if on is None else on & same
        return df.join(right, on).drop(*[f"__j_{c}" for c in [*keys, order]])
    dealt = with_range(df, keys, [order, *ties])
    totals = dealt.groupBy(*keys, "__range").agg(*[_CARRY[fn](e).alias(f"__t_{n}") for n, (fn, e, _) in ins.items()])
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__range").alias("__r"),
        *[_CARRY[fn](f"__t_{n}").over(before).alias(f"__c_{n}") for n, (fn, _, _) in ins.items()])
    on = F.col("__range") == F.col("__r")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    out = dealt.join(carry, on)
    base = Window.partitionBy(*keys, "__range").orderBy(order, *ties)
    for n, (fn, e, incl) in ins.items():
        w = base.rowsBetween(Window.unboundedPreceding, 0 if incl else -1)
        local, c = _CARRY[fn](e).over(w), F.col(f"__c_{n}")
        out = out.withColumn(n, F.greatest(local, c) if fn == "max" else F.coalesce(local, F.lit(0)) + F.coalesce(c, F.lit(0)))
    return out.drop("__range", "__r", *[f"__k_{k}" for k in keys], *[f"__c_{n}" for n in ins])
