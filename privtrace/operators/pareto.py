"""Privacy / utility trade-off: frontier, areas, layers, orderings.

Points are (by.., name, cost, utility): cost should be low, utility high.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .layers import pareto_layers  # noqa: F401
from .scan import running


def _steps(points: DataFrame, by) -> DataFrame:
    """Distinct frontier steps (by.., cost, utility).

    A point stays when it has the highest utility at its own cost and beats
    every lower cost: one partial aggregation and a running maximum.
    """
    by = list(by)
    peers = points.groupBy(*by, "cost").agg(F.max("utility").alias("utility"))
    run = running(peers, by, "cost", {"__best": ("max", F.col("utility"))}, ties=[], inclusive=False)
    return run.where(F.col("__best").isNull() | (F.col("utility") > F.col("__best"))).drop("__best")


def pareto_frontier(points: DataFrame, by=()) -> DataFrame:
    """Non-dominated points; equal points all stay."""
    return points.join(_steps(points, by), [*by, "cost", "utility"], "left_semi")


def with_optimal_flag(points: DataFrame, by=()) -> DataFrame:
    keys = [*by, "cost", "utility"]
    return points.join(_steps(points, by).withColumn("__f", F.lit(True)), keys, "left").withColumn(
        "is_optimal", F.coalesce("__f", F.lit(False))).drop("__f")


def _with_previous(steps: DataFrame, by) -> DataFrame:
    """On a frontier cost and utility rise together, so running maxima give the step before."""
    return running(steps, list(by), "cost", {"pc": ("max", F.col("cost")), "pu": ("max", F.col("utility"))}, ties=[], inclusive=False)


def pareto_auc(points: DataFrame, by=(), max_cost: float = 1.0, normalize: bool = True) -> DataFrame:
    """Trapezoid area under the frontier: triangle up to the first point, tail after the last; one point: a rectangle."""
    by = list(by)
    steps = _steps(points, by)
    n = points.join(steps, [*by, "cost", "utility"], "left_semi").groupBy(*by).agg(F.count(F.lit(1)).alias("n_points"))
    prev = _with_previous(steps, by)
    part = F.when(F.col("pc").isNull(), F.col("cost") * F.col("utility") / 2).otherwise(
        (F.col("cost") - F.col("pc")) * (F.col("utility") + F.col("pu")) / 2)
    g = prev.groupBy(*by).agg(F.sum(part).alias("mid"), F.max("cost").alias("lc"), F.max("utility").alias("lu"))
    g = g.join(n, by) if by else g.withColumn("n_points", n.scalar())
    tail = F.when(F.col("lc") < max_cost, (max_cost - F.col("lc")) * F.col("lu")).otherwise(0.0)
    area = F.when(F.col("n_points") == 1, (max_cost - F.col("lc")) * F.col("lu")).otherwise(F.col("mid") + tail)
    return g.select(*by, "n_points", (area / max_cost if normalize else area).alias("auc"))


def hypervolume(points: DataFrame, by=(), ref=(1.0, 0.0)) -> DataFrame:
    """Area dominated relative to a reference point (cost, utility)."""
    by = list(by)
    rx, ry = ref
    steps = _steps(points, by)
    inside = steps.where((F.col("cost") < rx) & (F.col("utility") > ry))
    prev = _with_previous(inside, by)
    part = F.when(F.col("pc").isNull(), 0.0).otherwise((F.col("cost") - F.col("pc")) * (F.col("pu") - ry))
    g = prev.groupBy(*by).agg(F.sum(part).alias("mid"), F.max("cost").alias("lc"), F.max("utility").alias("lu"))
    hv = g.select(*by, (F.col("mid") + (rx - F.col("lc")) * (F.col("lu") - ry)).alias("hypervolume"))
    if not by:
        return hv.select(F.coalesce("hypervolume", F.lit(0.0)).alias("hypervolume"))
    return points.select(*by).distinct().join(hv, by, "left").select(*by, F.coalesce("hypervolume", F.lit(0.0)).alias("hypervolume"))


def optimal_point(points: DataFrame, by=(), max_cost=None, min_utility=None) -> DataFrame:
    """Frontier point nearest to (0, 1) among those that meet the limits."""
    f = pareto_frontier(points, by)
    if max_cost is not None:
        f = f.where(F.col("cost") <= max_cost)
    if min_utility is not None:
        f = f.where(F.col("utility") >= min_utility)
    d = F.sqrt(F.col("cost") * F.col("cost") + (F.col("utility") - 1) * (F.col("utility") - 1))
    return f.withColumn("distance", d).groupBy(*by).agg(
        F.min_by(F.struct("name", "cost", "utility", "distance"), F.struct("distance", "cost", "name")).alias("b")
    ).select(*by, "b.*")


def pareto_point(run_metrics: DataFrame, use_wls: bool = False, name: str = "run") -> DataFrame:
    return run_metrics.select(F.col(name).alias("name"), F.col("wls" if use_wls else "elr").alias("cost"), F.col("tsr").alias("utility"))


def top_models(stats: DataFrame, order: str = "n", k: int = 5) -> DataFrame:
    """A top-k report over one row per model."""
    return stats.orderBy(F.col(order).desc(), "model").limit(k)


def first_k_canaries(canaries: DataFrame, k: int = 5, order: str = "record_idx") -> DataFrame:
    """First k canaries per scenario; Spark limits groups before the shuffle."""
    w = Window.partitionBy("scenario_id").orderBy(order, "canary")
    return canaries.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def event_order(events: DataFrame, by=("scenario_id",), seq: str = "seq", flag: str = "leaked") -> DataFrame:
    """Adds the event before, the leaks so far (this one included), and whether this is the first leak."""
    hit = F.when(F.col(flag), 1).otherwise(0)
    r = running(events, list(by), seq, {"leaks_so_far": ("sum", hit), "prev_seq": ("max", F.col(seq), False)}, ties=[])
    return r.withColumn("is_first_leak", F.col(flag) & (F.col("leaks_so_far") == 1))
