"""Selection of particles: shifts, periodic copies, boxes, shells, output steps, datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.sources.formats import DATASETS

AXES = ("x", "y", "z")


def shifted(df: DataFrame, offset: float) -> DataFrame:
    """Coordinates less a format's offset, in their own type."""
    return df.withColumns({c: F.col(c) - F.lit(offset).cast(df.schema[c].dataType) for c in AXES if c in df.columns}) if offset else df


def tiled(df: DataFrame) -> DataFrame:
    """Each row under the eight shifts of half a box in each direction: one row to eight, without a join."""
    shifts = F.array(*[F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(f"d{c}") for c, v in zip(AXES, s, strict=True)]) for s in _eight()])
    out = df.withColumn("_s", F.explode(shifts))
    return out.withColumns({c: F.col(c) + F.col(f"_s.d{c}") for c in AXES}).drop("_s")


def _eight() -> list[tuple[float, float, float]]:
    return [(a, b, c) for a in (-0.5, 0.5) for b in (-0.5, 0.5) for c in (-0.5, 0.5)]


def in_box(bounds: Sequence[tuple[float, float]]) -> Column:
    """lo < c <= hi on each axis."""
    out = F.lit(True)
    for c, (lo, hi) in zip(AXES, bounds, strict=False):
        out = out & (F.col(c) > F.lit(float(lo))) & (F.col(c) <= F.lit(float(hi)))
    return out


def radius() -> Column:
    x, y, z = (F.col(c).cast("double") for c in AXES)
    return F.sqrt(x * x + y * y + z * z)


def in_shell(lo: float, hi: float) -> Column:
    return (radius() > F.lit(float(lo))) & (radius() <= F.lit(float(hi)))


def boxed(df: DataFrame, bounds: Sequence[tuple[float, float]]) -> DataFrame:
    """Rows in a box, and in a shell if a fourth range is given; without all three coordinates nothing is filtered."""
    if not set(AXES) <= set(df.columns):
        return df
    out = df.filter(in_box(bounds))
    return out.filter(in_shell(*bounds[3])) if len(bounds) > 3 else out


def widened(bounds: Sequence[tuple[float, float]], offset: float = 0.0) -> list[tuple[float, float]]:
    """A box in coordinates before the shift, a little wider than single precision needs: what a scan may leave out lies beyond."""
    return [(lo + offset - 1e-5 * (1 + abs(lo)), hi + offset + 1e-5 * (1 + abs(hi))) for lo, hi in list(bounds)[:3]]


def dataset_columns(name: str) -> list[str]:
    if name not in DATASETS:
        raise ValueError(f"Unknown dataset {name!r}: one of {sorted(DATASETS)}")
    return DATASETS[name]


def project(df: DataFrame, dataset: str, *more: str) -> DataFrame:
    return df.select(*dataset_columns(dataset), *more)


def nearest_steps(spark: SparkSession, steps: DataFrame, redshifts: Sequence[float]) -> DataFrame:
    """(box, z_requested, step, z_out): for each requested redshift the step that is nearest, the lowest of equals."""
    asked = spark.createDataFrame([(i, float(z)) for i, z in enumerate(redshifts)], "box int, z_requested double")
    far = F.struct(F.abs(F.col("z") - F.col("z_requested")), F.col("step"))
    # steps are a log of a few thousand rows at most; requests are arguments
    return steps.crossJoin(F.broadcast(asked)).groupBy("box", "z_requested").agg(F.min_by("step", far).alias("step"), F.min_by("z", far).alias("z_out"))


def lightcone_steps(steps: DataFrame, zmax: float) -> DataFrame:
    """(step, z, z_before) of steps whose shell can hold particles; step 0 has no shell."""
    before = F.lag("z").over(Window.orderBy("step"))
    return steps.withColumn("z_before", before).filter((F.col("step") >= 1) & (F.col("z") <= F.lit(float(zmax))))


def outside(box: float) -> Column:
    """Whether a particle isn't in [0, box) on each axis; a coordinate that is null isn't."""
    out = F.lit(False)
    for c in AXES:
        out = out | F.col(c).isNull() | (F.col(c) < 0) | (F.col(c) >= F.lit(float(box)))
    return out


def check_bounds(df: DataFrame, box: float) -> int:
    """The number of particles; raises if there are none, or one outside [0, box)."""
    r = df.agg(F.count("*").alias("n"), F.count_if(outside(box)).alias("beyond")).first()
    if not r["n"]:
        raise ValueError("No particles")
    if r["beyond"]:
        raise ValueError(f"{r['beyond']} particles are outside [0, {box})")
    return r["n"]


def halo_mass(npart: Column, omega_m: float, box_gpc: float, ngrid: int) -> Column:
    """Mass of a halo from its particles."""
    return npart * F.lit(2.775e20 * omega_m * box_gpc**3 / ngrid**3)


def slab_rank(y: Column, box: float, ngrid: int, ranks: int) -> Column:
    """The rank whose slab along y holds a particle."""
    height = max(1, ngrid // ranks)
    return F.least(F.greatest((F.floor(y / F.lit(box) * F.lit(float(ngrid))) / F.lit(height)).cast("int"), F.lit(0)), F.lit(ranks - 1))
