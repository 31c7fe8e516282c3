"""Running aggregates and trade-off operators against brute force."""
import random

import pytest
from pyspark.sql import functions as F

from privtrace.operators import pareto
from privtrace.operators.scan import running


def test_running_with_hot_group(spark):
    r = random.Random(2)
    rows = [("hot" if i % 3 else f"k{i % 5}", i, r.randint(-5, 5)) for i in r.sample(range(5000), 900)]
    df = spark.createDataFrame(rows, "k string, o long, x long")
    out = running(df, ["k"], "o", {"s": ("sum", F.col("x")), "m": ("max", F.col("x"), False), "c": ("count", F.col("x"))}, ties=[])
    got = {(x.k, x.o): (x.s, x.m, x.c) for x in out.collect()}
    for k, o, _ in rows:
        before = [x for kk, oo, x in rows if kk == k and oo < o]
        upto = [x for kk, oo, x in rows if kk == k and oo <= o]
        assert got[(k, o)] == (sum(upto), max(before) if before else None, len(upto))


def test_running_peers(spark):
    rows = [("a", i // 4, 1) for i in range(100)]
    out = running(spark.createDataFrame(rows, "k string, o long, x long"), ["k"], "o", {"s": ("sum", F.col("x"))})
    assert {(r.o, r.s) for r in out.collect()} == {(i, 4 * (i + 1)) for i in range(25)}


def points(spark, n=200, seed=7, grid=20):
    r = random.Random(seed)
    rows = [("g" if i % 3 else "h", f"p{i}", r.randint(0, grid) / grid, r.randint(0, grid) / grid) for i in range(n)]
    return rows, spark.createDataFrame(rows, "grp string, name string, cost double, utility double")


def dominates(a, b):
    return a[2] <= b[2] and a[3] >= b[3] and (a[2] < b[2] or a[3] > b[3])


def test_frontier(spark):
    rows, df = points(spark)
    want = {p[1] for p in rows if not any(q[0] == p[0] and dominates(q, p) for q in rows)}
    assert {x.name for x in pareto.pareto_frontier(df, ["grp"]).collect()} == want
    want = {p[1] for p in rows if not any(dominates(q, p) for q in rows)}
    assert {x.name for x in pareto.pareto_frontier(df).collect()} == want


@pytest.mark.parametrize("max_group", [500_000, 1])
def test_layers_both_ways(spark, max_group):
    rows, df = points(spark, 60, grid=6)
    rest, want, layer = list(rows), {}, 1
    while rest:
        top = [p for p in rest if not any(q[0] == p[0] and dominates(q, p) for q in rest)]
        want.update({p[1]: layer for p in top})
        rest, layer = [p for p in rest if p not in top], layer + 1
    got = {x.name: x.layer for x in pareto.pareto_layers(df, ["grp"], max_group).collect()}
    assert got == want


def test_areas_by_hand(spark):
    one = spark.createDataFrame([("a", 0.2, 0.8)], "name string, cost double, utility double")
    assert abs(pareto.pareto_auc(one).first().auc - 0.64) < 1e-9
    two = spark.createDataFrame([("a", 0.2, 0.5), ("b", 0.6, 0.9), ("c", 0.7, 0.6)], "name string, cost double, utility double")
    assert abs(pareto.pareto_auc(two).first().auc - (0.05 + 0.4 * 0.7 + 0.4 * 0.9)) < 1e-9
    assert abs(pareto.hypervolume(two).first().hypervolume - (0.4 * 0.5 + 0.4 * 0.9)) < 1e-9
    none = two.where("cost > 5")
    assert pareto.hypervolume(none).first().hypervolume == 0.0
    assert pareto.optimal_point(two, max_cost=0.5).first().name == "a"
