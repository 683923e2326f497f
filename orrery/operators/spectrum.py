"""Power spectra: a distributed transform of the density contrast, modes, windows, bins, statistics.

The transform takes two shuffles. Planes of equal iy are transformed along z and x; columns of equal kz are then transformed along y. A
task holds one plane of n * n numbers. For spectra, modes are binned where they are made, so that only sums by bin are shuffled afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import density_stats, to_grid
from .select import check_bounds


def wave_numbers(ngrid: int, box: float) -> tuple[np.ndarray, np.ndarray]:
    """(k along x and y, k along z) of a real transform."""
    return 2 * np.pi * np.fft.fftfreq(ngrid, box / ngrid), 2 * np.pi * np.fft.rfftfreq(ngrid, box / ngrid)


def default_edges(ngrid: int, box: float) -> np.ndarray:
    """Logarithmic edges from the fundamental mode to the Nyquist frequency."""
    n = max(5, min(80, ngrid // 2))
    return np.logspace(np.log10(2 * np.pi / box), np.log10(np.pi * ngrid / box), n + 1)


def _sinc(x: np.ndarray) -> np.ndarray:
    return np.sinc(x / np.pi)


def window(assignment: str, spacing: float, *k: np.ndarray) -> np.ndarray | float:
    """The window of an assignment; 1 for one that isn't known."""
    power = {"cic": 2, "ngp": 1}.get(assignment.lower(), 0)
    out: np.ndarray | float = 1.0
    for axis in k:
        out = out * _sinc(axis * spacing / 2) ** power
    return out


def _planes(ngrid: int, mean: float) -> Callable[[tuple, pa.Table], pa.Table]:
    half = ngrid // 2 + 1

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        ix, iz, rho = (rows[c].to_numpy() for c in ("ix", "iz", "rho"))
        real = ix >= 0
        plane = np.bincount(ix[real].astype(np.int64) * ngrid + iz[real], weights=rho[real], minlength=ngrid * ngrid).reshape(ngrid, ngrid)
        out = np.fft.fft(np.fft.rfft(plane / mean - 1, axis=1), axis=0)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(part.T).ravel()), ngrid).cast(pa.list_(pa.float64())) for part in (out.real, out.imag)]
        return pa.table({"kz": pa.array(np.arange(half), pa.int32()), "iy": pa.array(np.full(half, key[0].as_py()), pa.int32()), "re": lists[0], "im": lists[1]})

    return run


def _column(rows: pa.Table, ngrid: int) -> np.ndarray:
    """(kx, ky) of one kz."""
    flat = rows.sort_by("iy")
    both = [np.array(flat[c].combine_chunks().flatten()).reshape(ngrid, ngrid) for c in ("re", "im")]
    return np.fft.fft(both[0] + 1j * both[1], axis=0).T


def _half_transformed(cells: DataFrame, ngrid: int, mean: float) -> DataFrame:
    # a plane without particles still has a contrast of -1
    skeleton = cells.sparkSession.range(ngrid).select(F.lit(-1).alias("ix"), F.col("id").cast("int").alias("iy"), F.lit(-1).alias("iz"), F.lit(0.0).alias("rho"))
    every = cells.select("ix", "iy", "iz", F.col("rho").cast("double").alias("rho")).unionAll(skeleton)
    return every.groupBy("iy").applyInArrow(_planes(ngrid, mean), "kz int, iy int, re array<double>, im array<double>")


def grid_mean(cells: DataFrame, ngrid: int) -> float:
    total = cells.agg(F.sum("rho")).first()[0] or 0.0
    if total <= 0:
        raise ValueError("The mean density must be positive")
    return total / ngrid**3


def modes(cells: DataFrame, ngrid: int, mean: float | None = None) -> DataFrame:
    """(kx, ky, kz, re, im): the transform of the contrast; kx, ky and kz are indices of the half space."""
    mean = grid_mean(cells, ngrid) if mean is None else mean

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        out = _column(rows, ngrid)
        kx, ky = (i.ravel().astype(np.int32) for i in np.indices(out.shape))
        return pa.table({"kx": kx, "ky": ky, "kz": np.full(kx.size, key[0].as_py(), np.int32), "re": out.real.ravel(), "im": out.imag.ravel()})

    return _half_transformed(cells, ngrid, mean).groupBy("kz").applyInArrow(run, "kx int, ky int, kz int, re double, im double")


def field(transformed: DataFrame, ngrid: int) -> DataFrame:
    """(ix, iy, iz, value) of modes (kx, ky, kz, re, im): the inverse of `modes`, by the same two shuffles in reverse."""
    half = ngrid // 2 + 1

    def columns(key: tuple, rows: pa.Table) -> pa.Table:
        plane = np.zeros((ngrid, ngrid), dtype=complex)
        plane[rows["kx"].to_numpy(), rows["ky"].to_numpy()] = rows["re"].to_numpy() + 1j * rows["im"].to_numpy()
        out = np.fft.ifft(plane, axis=1).T
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(part).ravel()), ngrid).cast(pa.list_(pa.float64())) for part in (out.real, out.imag)]
        return pa.table({"iy": pa.array(np.arange(ngrid), pa.int32()), "kz": pa.array(np.full(ngrid, key[0].as_py()), pa.int32()), "re": lists[0], "im": lists[1]})

    def planes(key: tuple, rows: pa.Table) -> pa.Table:
        out = np.zeros((ngrid, half), dtype=complex)
        for kz, re, im in zip(rows["kz"].to_pylist(), rows["re"], rows["im"], strict=True):
            out[:, kz] = np.array(re.values) + 1j * np.array(im.values)
        values = np.fft.irfft(np.fft.ifft(out, axis=0), n=ngrid, axis=1)
        ix, iz = (i.ravel().astype(np.int32) for i in np.indices(values.shape))
        return pa.table({"ix": ix, "iy": np.full(ix.size, key[0].as_py(), np.int32), "iz": iz, "value": values.ravel()})

    turned = transformed.groupBy("kz").applyInArrow(columns, "iy int, kz int, re array<double>, im array<double>")
    return turned.groupBy("iy").applyInArrow(planes, "ix int, iy int, iz int, value double")


def binned(cells: DataFrame, ngrid: int, box: float, edges: Sequence[float] | None = None, correct: str | None = None, mean: float | None = None) -> DataFrame:
    """(bin, k, p, n_modes) by ascending k: mean wave number and power by bin, counts over the half space; empty bins have no row.

    correct: the assignment whose window is divided out.
    """
    mean = grid_mean(cells, ngrid) if mean is None else mean
    edges = default_edges(ngrid, box) if edges is None else np.asarray(edges, dtype=float)
    along, up = wave_numbers(ngrid, box)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        kx, ky, kz = along[:, None], along[None, :], up[key[0].as_py()]
        k = np.sqrt(kx**2 + ky**2 + kz**2)
        power = np.abs(_column(rows, ngrid)) ** 2 * (box**3 / float(ngrid) ** 6)
        if correct:
            power = power / (window(correct, box / ngrid, kx, ky, np.array(kz)) ** 2 + 1e-16)
        k, power = k.ravel(), power.ravel()
        which = np.digitize(k, edges)
        keep = (k > 0) & (which > 0) & (which < edges.size)
        n = edges.size
        sums = [np.bincount(which[keep], weights=w, minlength=n) for w in (k[keep], power[keep], np.ones(int(keep.sum())))]
        some = np.flatnonzero(sums[2])
        return pa.table({"bin": some.astype(np.int32), "k": sums[0][some].astype(float), "p": sums[1][some].astype(float), "n": sums[2][some].astype(np.int64)})

    parts = _half_transformed(cells, ngrid, mean).groupBy("kz").applyInArrow(run, "bin int, k double, p double, n long")
    out = parts.groupBy("bin").agg((F.sum("k") / F.sum("n")).alias("k"), (F.sum("p") / F.sum("n")).alias("p"), F.sum("n").alias("n_modes"))
    return out.coalesce(1).sortWithinPartitions("bin")  # a row for each bin, by ascending k


def bin_modes(df: DataFrame, edges: Sequence[float]) -> DataFrame:
    """(bin, k, p, n_modes) of a table of modes (k, p), in columns only: the bin is the number of edges at or below k."""
    bounds = F.array(*[F.lit(float(e)) for e in edges])
    which = F.size(F.filter(bounds, lambda e: e <= F.col("k")))
    rows = df.filter("k > 0").select(which.alias("bin"), "k", "p").filter((F.col("bin") > 0) & (F.col("bin") < len(edges)))
    return rows.groupBy("bin").agg(F.avg("k").alias("k"), F.avg("p").alias("p"), F.count("*").alias("n_modes"))


def power_spectrum(
    df: DataFrame, ngrid: int, box: float, assignment: str = "cic", edges: Sequence[float] | None = None, correct_window: bool = False, subtract_shot_noise: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(spectrum, statistics) of particles in [0, box)."""
    if ngrid <= 0 or box <= 0:
        raise ValueError("Grid and box must be positive")
    n = check_bounds(df, box)
    cells = to_grid(df, ngrid, box, assignment)
    out = binned(cells, ngrid, box, edges, assignment if correct_window else None, n / ngrid**3)
    if subtract_shot_noise:
        out = out.withColumn("p", F.col("p") - F.lit(box**3 / n))
    return out, density_stats(cells, ngrid, F.lit(float(n)))


def frequencies(ngrid: int, box: float) -> tuple[float, float, float]:
    """(fundamental, Nyquist, cutoff)."""
    top = math.pi / (box / ngrid)
    return 2 * math.pi / box, top, 0.5 * top


def bin_status(ngrid: int, box: float) -> Column:
    return F.when(F.col("k") <= F.lit(frequencies(ngrid, box)[2]), "valid").otherwise("aliased")


def analysis(spectrum: DataFrame, ngrid: int, box: float) -> DataFrame:
    """One row: frequencies, bins in all and valid ones, the range of the power, modes."""
    low, top, cut = frequencies(ngrid, box)
    valid = F.count_if((F.col("k") <= F.lit(cut)) & (F.col("n_modes") > 100))
    out = spectrum.agg(F.count("*").alias("total_bins"), valid.alias("valid_bins"), F.min("p").alias("min_power"), F.max("p").alias("max_power"), F.sum("n_modes").alias("total_modes"))
    return out.select(F.lit(low).alias("k_fundamental"), F.lit(top).alias("k_nyquist"), F.lit(cut).alias("k_cutoff"), F.lit(box / ngrid).alias("cell_size"), "*")


def density_check(stats: DataFrame, n_particles: int, box: float, ngrid: int) -> DataFrame:
    """stats with the mean density by volume over that of the particle count, and whether they differ by more than a tenth."""
    ratio = F.col("mean_density") * F.lit((ngrid / box) ** 3) / F.lit(n_particles / box**3)
    return stats.withColumn("density_ratio", ratio).withColumn("density_differs", F.abs(ratio - 1) > 0.1)


def validation(spectrum: DataFrame) -> DataFrame:
    """One row of checks. A spectrum has a row for each bin, so that one window over it is small."""
    steps = spectrum.withColumn("step", F.col("k") - F.lag("k").over(Window.orderBy("bin")))
    out = steps.agg(
        F.bool_and(F.col("p") > 0).alias("positive_power"), F.bool_and(F.coalesce(F.col("step") > 0, F.lit(True))).alias("monotonic_k"), F.bool_and(F.col("n_modes") >= 0).alias("positive_modes"),
        ((F.min("p") > 1e-10) & (F.max("p") < 1e10)).alias("reasonable_range"),
    )
    return out.withColumn("all_passed", F.col("positive_power") & F.col("monotonic_k") & F.col("positive_modes") & F.col("reasonable_range"))
