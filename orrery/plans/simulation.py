"""A simulation's outputs as DataFrames: snapshots, light cones and halos by box, redshift and dataset; spectra of them."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.cosmology import Cosmology
from orrery.functions.presets import DEFAULT_COSMOLOGY
from orrery.operators import select, spectrum
from orrery.sources import formats, metadata


class SimulationData:
    """Reads what a parameter file names. Files of a step are its chunks up to the first gap."""

    def __init__(self, spark: SparkSession, parameter_file: str, cosmology: str = DEFAULT_COSMOLOGY, chi_in_h_units: bool = False, first_chunk_only: bool = False):
        self.spark, self.first_chunk_only = spark, first_chunk_only
        self.params = metadata.load_parameters(spark, parameter_file)
        self.steps = metadata.step_log(spark, self.params.namespace + ".log")
        self.cosmology = Cosmology(cosmology, h=self.params.h, omegam=self.params.omegam)
        self.chiofz = self.cosmology.chi_interpolator()
        self.units = self.params.h if chi_in_h_units else 1.0

    def parameters(self) -> dict:
        return self.params.as_columns()

    def shell(self, z_lo: float, z_hi: float) -> tuple[float, float]:
        """Radii of a shell between two redshifts, in box sides."""
        lo, hi = (float(self.chiofz(z)) * self.units / self.params.boxsize for z in (z_lo, z_hi))
        return lo, hi

    def _files(self, fmt: formats.Format, step: int) -> list[str]:
        found = formats.chunk_files(fmt, self.params.namespace, step)
        return found[:1] if self.first_chunk_only else found

    def _scan(self, fmt: formats.Format, steps: Sequence[int], dataset: str, within=()) -> DataFrame:
        """Rows of the files of these steps; `within` is in the file's own coordinates."""
        files = [(f, s) for s in steps for f in self._files(fmt, s)]
        columns = select.dataset_columns(dataset)
        if missing := set(columns) - set(fmt.schema.names):
            raise ValueError(f"{fmt.name} files have no {sorted(missing)}")
        return formats.read_records(self.spark, fmt.name, [f for f, _ in files], [s for _, s in files], columns, within=within)

    def fetch(self, bbox: Sequence[tuple[float, float]], dataset: str = "xvp", filetype: str = "tps", lightcone: bool = False, redshifts: Sequence[float] = (0.0,)) -> DataFrame:
        """Rows in a box. Snapshots have (box, z_requested, z_out), a box for each requested redshift; light cones are the union of their steps."""
        fmt = formats.format_of(filetype)
        select.dataset_columns(dataset)
        return self._lightcone(fmt, dataset, bbox) if lightcone else self._snapshots(fmt, dataset, bbox, redshifts)

    def _lightcone(self, fmt: formats.Format, dataset: str, bbox) -> DataFrame:
        steps = select.lightcone_steps(self.steps, self.params.zmax).orderBy("step").collect()  # a log of output times
        if fmt.sliced:
            return select.boxed(self._scan(fmt, [s["step"] for s in steps], dataset, select.widened(bbox)), bbox)
        # one scan of all steps: each row meets the shell of its step
        shells = [(s["step"], *self.shell(s["z"], s["z_before"])) for s in steps]
        table = self.spark.createDataFrame(shells, "step int, shell_lo double, shell_hi double")
        rows = self._scan(fmt, [s["step"] for s in steps], dataset).join(F.broadcast(table), "step")
        out = select.boxed(select.tiled(rows), bbox)
        if set(select.AXES) <= set(out.columns):
            out = out.filter((select.radius() > F.col("shell_lo")) & (select.radius() <= F.col("shell_hi")))
        return out.drop("shell_lo", "shell_hi")

    def _snapshots(self, fmt: formats.Format, dataset: str, bbox, redshifts: Sequence[float]) -> DataFrame:
        if fmt.name == "lcp":
            raise ValueError("Light-cone files hold no snapshots")
        boxes = select.nearest_steps(self.spark, self.steps.filter("z IS NOT NULL"), redshifts)
        chosen = boxes.orderBy("box").collect()  # as many as were requested
        usable = sorted({r["step"] for r in chosen if r["step"] >= 1})
        rows = select.boxed(select.shifted(self._scan(fmt, usable, dataset, select.widened(bbox, fmt.offset)), fmt.offset), bbox)
        table = self.spark.createDataFrame([tuple(r) for r in chosen], "box int, z_requested double, step int, z_out double")
        return rows.join(F.broadcast(table), "step")

    def matter_power(self, bbox: Sequence[tuple[float, float]], ngrid: int = 256, subtract_shot_noise: bool = False, rebase: bool = False, assignment: str = "cic", **fetch) -> tuple[DataFrame, DataFrame]:
        """(spectrum, statistics) of the first box. The box's side is the width of bbox along x."""
        rows = self.fetch(bbox, **({"dataset": "xp"} | fetch))
        if "box" in rows.columns:
            rows = rows.filter("box = 0")
        if rebase:
            rows = rows.withColumns({c: F.col(c) - F.lit(float(lo)) for c, (lo, _) in zip("xyz", bbox, strict=False)})
        return spectrum.power_spectrum(rows, ngrid, float(bbox[0][1] - bbox[0][0]), assignment, subtract_shot_noise=subtract_shot_noise)

    def load(self, snapshot: str, dataset: str = "xvp", auto_bbox: bool = True, bbox=None) -> DataFrame:
        """The snapshot at redshift 0 in a box, by default the whole one."""
        if not Path(snapshot).exists():
            raise FileNotFoundError(snapshot)
        side = float(self.params.boxsize) if auto_bbox else 1000.0
        return self.fetch(bbox or [(0.0 if auto_bbox else -side, side)] * 3, dataset)


def rescaled(df: DataFrame, box: float) -> DataFrame:
    """Box units to [0, box)."""
    return df.withColumns({c: F.col(c).cast("double") * F.lit(box * (1 - 1e-6)) for c in select.AXES})
