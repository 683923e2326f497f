"""Mass assignment to a periodic grid as sums by cell, and statistics of the density contrast."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def _cell(axis: str, box: float, ngrid: int) -> Column:
    return F.col(axis).cast("double") / F.lit(box / ngrid)


def _wrap(i: Column, ngrid: int) -> Column:
    return F.pmod(i, F.lit(ngrid)).cast("int")


def ngp(df: DataFrame, ngrid: int, box: float, weight: Column | None = None, nearest: str = "floor") -> DataFrame:
    """(ix, iy, iz, rho): each particle in its cell. nearest: floor, or rint for the cell of the nearest grid point."""
    if nearest not in ("floor", "rint"):
        raise ValueError(f"Unknown cell rule {nearest!r}")
    step = F.floor if nearest == "floor" else F.rint
    at = [_wrap(step(_cell(c, box, ngrid)).cast("long"), ngrid).alias(f"i{c}") for c in AXES]
    rho = F.count("*").cast("double") if weight is None else F.sum("w")
    rows = df.select(*at) if weight is None else df.select(*at, weight.cast("double").alias("w"))
    return rows.groupBy("ix", "iy", "iz").agg(rho.alias("rho"))


def cic(df: DataFrame, ngrid: int, box: float, weight: Column | None = None) -> DataFrame:
    """(ix, iy, iz, rho): each particle shared by the eight cells around it; partial sums are made before the shuffle."""
    mass = F.lit(1.0) if weight is None else weight.cast("double")
    u = df.select(*[_cell(c, box, ngrid).alias(c) for c in AXES], mass.alias("m"))
    u = u.select("m", *[F.floor(c).cast("long").alias(f"i{c}") for c in AXES], *[(F.col(c) - F.floor(c)).alias(f"d{c}") for c in AXES])
    corners = []
    for sides in ((a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)):
        share = F.col("m")
        for c, s in zip(AXES, sides, strict=True):
            share = share * (F.col(f"d{c}") if s else 1.0 - F.col(f"d{c}"))
        corners.append(F.struct(*[_wrap(F.col(f"i{c}") + s, ngrid).alias(f"i{c}") for c, s in zip(AXES, sides, strict=True)], share.alias("w")))
    return u.select(F.explode(F.array(*corners)).alias("c")).groupBy("c.ix", "c.iy", "c.iz").agg(F.sum("c.w").alias("rho"))


def to_grid(df: DataFrame, ngrid: int, box: float, assignment: str = "cic", weight: Column | None = None) -> DataFrame:
    if ngrid <= 0 or box <= 0:
        raise ValueError("Grid and box must be positive")
    if assignment.lower() not in ("cic", "ngp"):
        raise ValueError(f"Unknown assignment {assignment!r}")
    return (cic if assignment.lower() == "cic" else ngp)(df, ngrid, box, weight)


def density_stats(cells: DataFrame, ngrid: int, n_particles: Column | None = None) -> DataFrame:
    """One row of statistics over all cells of the grid, those without particles included; population variances."""
    n3 = float(ngrid**3)
    s = cells.agg(F.coalesce(F.sum("rho"), F.lit(0.0)).alias("total"), F.coalesce(F.sum(F.col("rho") * F.col("rho")), F.lit(0.0)).alias("squares"))
    mean, n = F.col("total") / n3, F.col("total") if n_particles is None else n_particles
    var = F.col("squares") / n3 - F.col("mean_density") * F.col("mean_density")
    s = s.withColumn("mean_density", mean).withColumn("density_variance", var)
    m, v = F.col("mean_density"), F.col("density_variance")
    return s.select(
        "mean_density", "density_variance", F.when(m > 0, 0.0).alias("delta_mean"), F.when(m > 0, v / (m * m)).alias("delta_variance"), F.when(m > 0, F.sqrt(v) / m).alias("delta_std"),
        F.when(m > 0, n / (m * n3)).alias("theoretical_shot_noise_variance"), F.when(n > 0, n3 / n).alias("theoretical_variance"), F.when(m > 0, (n3 - 1) * v / m).alias("variance_chi2_statistic"), n.alias("particle_count"),
    )


def chi2_tail(value: float, freedom: float) -> float:
    """The upper tail of chi-squared by the cube-root normal approximation; good to 1e-3 for more than 30 degrees."""
    if not freedom > 0 or math.isnan(value):
        return math.nan
    spread = 2 / (9 * freedom)
    return 0.5 * math.erfc(((value / freedom) ** (1 / 3) - (1 - spread)) / math.sqrt(2 * spread))
