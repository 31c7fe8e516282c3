"""Column expressions for rates and intervals."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

Z95, Z99 = 1.96, 2.576


def wilson_ci(k, n, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval for k hits in n trials, as fractions; (0, 0) for n = 0."""
    k, n = col(k).cast("double"), col(n).cast("double")
    p = k / n
    denom = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denom
    margin = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denom
    lo = F.when(n > 0, F.greatest(F.lit(0.0), centre - margin)).otherwise(0.0)
    hi = F.when(n > 0, F.least(F.lit(1.0), centre + margin)).otherwise(0.0)
    return lo, hi


def pct(flag) -> Column:
    """Share of true rows in percent (aggregate)."""
    return F.avg(F.coalesce(col(flag), F.lit(False)).cast("int")) * 100


def count_true(flag) -> Column:
    return F.count_if(F.coalesce(col(flag), F.lit(False)))


def mean_ci_cols(mean, std, n, z: float = Z95) -> tuple[Column, Column, Column]:
    """(std, lower, upper): normal interval clamped to [0, 1]; one value has no spread."""
    mean, n = col(mean), col(n)
    sd = F.when(n > 1, col(std)).otherwise(F.lit(0.0))
    margin = z * sd / F.sqrt(n.cast("double"))
    lo = F.when(n > 1, F.greatest(F.lit(0.0), mean - margin)).otherwise(mean)
    hi = F.when(n > 1, F.least(F.lit(1.0), mean + margin)).otherwise(mean)
    return sd, lo, hi
