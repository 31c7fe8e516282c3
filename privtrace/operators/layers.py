"""Pareto layers of groups of any size, block by block along diagonals.

The distinct points of a group are dealt into a grid: ranges along (cost up,
utility down) by ranges along (utility down, cost up), both of equal depth.
Every point that dominates another one comes earlier in both orders, so a block
needs nothing but what lies to its left, above it and beyond both:

* of the blocks to the left the highest utility of each layer,
* of the blocks above the lowest cost of each layer,
* of all blocks beyond both only the highest layer.

Blocks of one diagonal are ranked in parallel, each in a task of bounded size;
what they carry goes to their right and lower neighbours. A grid of k by k blocks
takes 2k - 1 rounds, whatever the number of layers. Small groups are a grid of
one block and take part in the same first round.
"""
from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .scan import running

#: Points of a block, on average.
BLOCK = 100_000

_INF = float("inf")


def rank_block(points: list[tuple[float, float]], carried: list[tuple[float, float, int]]) -> list[int]:
    """Layers of ``points``, which come sorted by (cost, -utility), given ``carried`` points of known layer.

    ``worst[l]`` is the negated highest utility of the points so far whose layer
    is above l; it rises with l.
    """
    worst: list[float] = []

    def enter(utility: float, layer: int) -> None:
        at = layer - 1
        worst.extend([_INF] * (layer - len(worst)))
        # a point of a layer has points of all lower layers over it
        while at >= 0 and worst[at] > -utility:
            worst[at] = -utility
            at -= 1

    out, waiting = [], sorted(carried)
    k = 0
    for cost, utility in points:
        while k < len(waiting) and waiting[k][0] <= cost:
            enter(waiting[k][1], waiting[k][2])
            k += 1
        layer = bisect_right(worst, -utility) + 1  # below as many layers that hold a point of at least that utility
        out.append(layer)
        enter(utility, layer)
    return out


def carry(points: list[tuple[float, float]], layers: list[int], carried: list[tuple[float, float, int]]):
    """What a block with these points hands on: (right, down, beyond).

    To the right the highest utility of each layer, at cost -inf; down the
    lowest cost, at utility inf; beyond both the highest layer.
    """
    side, down, most = {}, {}, 0
    for (cost, utility), layer in zip(points, layers):
        side[layer] = max(side.get(layer, -_INF), utility)
        down[layer] = min(down.get(layer, _INF), cost)
        most = max(most, layer)
    for cost, utility, layer in carried:
        most = max(most, layer)
        if cost == -_INF and utility != _INF:
            side[layer] = max(side.get(layer, -_INF), utility)
        if utility == _INF and cost != -_INF:
            down[layer] = min(down.get(layer, _INF), cost)
    return ([(-_INF, u, n) for n, u in side.items()], [(c, _INF, n) for n, c in down.items()],
            [(-_INF, _INF, most)] if most else [])


def _grid(distinct: DataFrame, keys: list[str], block: int) -> tuple[DataFrame, int]:
    """The points with their place (i, j) in the grid, and the largest number of ranges."""
    sizes = distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    sizes = cut(sizes.withColumn("__k", F.ceil(F.sqrt(F.col("__n") / F.lit(block))).cast("int")), "layer-sizes")
    most = sizes.agg(F.max("__k")).first()[0] or 1
    if most == 1:
        return distinct.withColumns({"__i": F.lit(0), "__j": F.lit(0), "__k": F.lit(1)}), 1
    named = sizes.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__n", "__k")
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        on = same if on is None else on & same
    p = distinct.join(named, on).drop(*[f"__k_{k}" for k in keys])
    p = p.withColumns({"__down": -F.col("utility"), "__one": F.lit(1).cast("long")})
    p = running(p, keys, "cost", {"__a": ("sum", F.col("__one"), False)}, ties=["__down"])
    p = running(p, keys, "__down", {"__b": ("sum", F.col("__one"), False)}, ties=["cost"])
    place = lambda r: F.floor(F.coalesce(F.col(r), F.lit(0)) * F.col("__k") / F.col("__n")).cast("int")
    return p.withColumns({"__i": place("__a"), "__j": place("__b")}).drop("__n", "__down", "__one", "__a", "__b"), most


def pareto_layers(points: DataFrame, by=(), block: int = BLOCK) -> DataFrame:
    """Rank of every point: 1 = frontier, 2 = frontier of the rest, ...

    The rank is the length of the longest chain of dominating points. Equal
    points have equal ranks. Points without cost or utility are left out.
    """
    by = list(by)
    distinct = points.where(F.col("cost").isNotNull() & F.col("utility").isNotNull()).select(
        *by, F.col("cost").cast("double").alias("cost"), F.col("utility").cast("double").alias("utility")).distinct()
    keyed = distinct if by else distinct.withColumn("__g", F.lit(0))
    keys = by or ["__g"]
    placed, most = _grid(keyed.select(*keys, "cost", "utility"), keys, block)
    names = [*keys, "__i", "__j", "__k", "cost", "utility"]
    placed = placed.select(*names)
    if most > 1:
        placed = cut(placed, "layer-points")
    schema = T.StructType([*placed.schema.fields, T.StructField("__kind", T.IntegerType()), T.StructField("layer", T.IntegerType())])
    columns = [f.name for f in schema.fields]

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        head = [None if pd.isna(x) else x for x in (pdf[k].iloc[0] for k in keys)]
        i, j, last = (int(pdf[c].iloc[0]) for c in ("__i", "__j", "__k"))
        own = pdf[pdf["__kind"] == 0].assign(down=lambda x: -x["utility"]).sort_values(["cost", "down"])
        pts = list(zip(own["cost"].tolist(), own["utility"].tolist()))
        old = pdf[pdf["__kind"] != 0]
        carried = list(zip(old["cost"].tolist(), old["utility"].tolist(), old["layer"].astype(int).tolist()))
        layers = rank_block(pts, carried)
        rows = [(*head, i, j, last, c, u, 0, n) for (c, u), n in zip(pts, layers)]
        if last > 1:
            for (di, dj), some in zip(((1, 0), (0, 1), (1, 1)), carry(pts, layers, carried)):
                if i + di < last and j + dj < last:
                    rows += [(*head, i + di, j + dj, last, c, u, 1, n) for c, u, n in some]
        return pd.DataFrame(rows, columns=columns).astype({"__i": "int32", "__j": "int32", "__k": "int32", "__kind": "int32", "layer": "int32"})

    fresh = placed.withColumns({"__kind": F.lit(0), "layer": F.lit(None).cast("int")}).select(*columns)
    ranked, before = None, []
    for diagonal in range(2 * most - 1):
        todo = fresh.where(F.col("__i") + F.col("__j") == diagonal) if most > 1 else fresh
        # carried rows come from the last diagonal and, beyond a corner, from the one before
        for old in before:
            todo = todo.unionByName(old.where((F.col("__kind") == 1) & (F.col("__i") + F.col("__j") == diagonal)))
        made = todo.groupBy(*keys, "__i", "__j").applyInPandas(rank, schema)
        made = cut(made, "layers") if most > 1 else made
        before = [*before[-1:], made]
        part = made.where("__kind = 0").select(*keys, "cost", "utility", "layer")
        ranked = part if ranked is None else ranked.unionByName(part)
    names = [f"__r{i}" for i in range(len(by))]
    right = ranked.select(*[F.col(c).alias(n) for c, n in zip(by, names)], F.col("cost").alias("__cost"), F.col("utility").alias("__utility"), "layer")
    on = (F.col("cost").cast("double") == F.col("__cost")) & (F.col("utility").cast("double") == F.col("__utility"))
    for c, n in zip(by, names):
        on = on & F.col(c).eqNullSafe(F.col(n))
    return points.join(right, on).drop("__cost", "__utility", *names)
