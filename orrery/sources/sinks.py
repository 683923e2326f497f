"""Text and JSON outputs: spectra, transfer functions, rendered templates, state files. All of these are small."""

from __future__ import annotations

import json
import os
import shutil
import subprocess
from collections.abc import Callable
from pathlib import Path
from string import Template

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.cosmology import Cosmology
from orrery.operators.spectrum import analysis, bin_status, frequencies


class TemplateError(ValueError):
    """A template that can't be rendered."""


def spectrum_lines(spectrum: DataFrame, ngrid: int, box: float) -> DataFrame:
    """(bin, line) of bins with modes. Exponents have two digits."""
    digits = F.format_string("%.6e", "p")
    line = F.concat_ws(" ", F.format_string("%.6f", "k"), digits, F.col("n_modes").cast("string"), bin_status(ngrid, box))
    return spectrum.filter("n_modes > 0").select("bin", line.alias("line"))


def write_spectrum(spectrum: DataFrame, path: str | None, ngrid: int, box: float, assignment: str, n_particles: int) -> str:
    path = path or f"power_spectrum_ngrid{ngrid}_{assignment}.txt"
    a, (low, top, cut) = analysis(spectrum, ngrid, box).first(), frequencies(ngrid, box)
    head = [
        "Power Spectrum Analysis Results", f"Grid size: {ngrid}³", f"Box size: {box:.1f} Mpc/h", f"Assignment: {assignment.upper()}", f"Cell size: {box / ngrid:.6f} Mpc/h", f"Fundamental mode: {low:.6f} h/Mpc",
        f"Nyquist frequency: {top:.6f} h/Mpc", f"Cutoff frequency: {cut:.6f} h/Mpc", f"Total particles: {n_particles:,}", f"Total modes: {a['total_modes']:,}", f"Valid k-bins: {a['valid_bins']}", "", "Columns: k[h/Mpc] P(k)[(Mpc/h)³] N_modes Status",
    ]
    rows = [r["line"] for r in spectrum_lines(spectrum, ngrid, box).orderBy("bin").collect()]
    Path(path).write_text("\n".join([f"# {h}".rstrip() for h in head] + rows) + "\n")
    return path


def write_transfer(cosmo: Cosmology, path: str) -> None:
    k, _, t = cosmo.table()
    np.savetxt(path, np.transpose([k, t]), fmt="%1.8e", header=cosmo.summary() + "\n\nColumn 1: k [h/Mpc]\nColumn 2: T(k) = sqrt(P(k) / (As (k / k_pivot)^ns))")


def render(template: str, values: dict) -> str:
    """A template with all of its names filled in; a name without a value is an error."""
    try:
        return Template(template).substitute({k: str(v) for k, v in values.items()})
    except (KeyError, ValueError) as e:
        raise TemplateError(f"template: {e}") from e


def run_values(params: dict, cosmo: Cosmology, redshift: float, out: str, transfer: str) -> dict[str, str]:
    """Values of a run's parameter file."""
    w0, wa = params.get("w0", cosmo.params.get("w0", -1.0)), params.get("wa", cosmo.params.get("wa", 0.0))
    evolves = w0 != -1.0 or wa != 0.0
    digits = {"dSpectral": cosmo.params["ns"], "h": cosmo.params["h"], "dOmega0": cosmo.omega_m, "dLambda": 0.0 if evolves else cosmo.omega_l, "dOmegaDE": cosmo.omega_l if evolves else 0.0, "dSigma8": cosmo.sigma8(), "w0": w0, "wa": wa}
    wide = {k: f"{params[k]:<4}" for k in ("nGrid", "dBoxSize")}
    plain = {k: str(params.get(k, "")) for k in ("dRedFrom", "iLPT", "dRedTo", "nSteps", "iOutInterval")}
    return {"achOutName": out, "achTfFile": transfer, "dRedshiftLCP": f"{redshift:.2f}"} | {k: f"{v:.6f}" for k, v in digits.items()} | wide | plain


def write_state(path: str, status: str, states: DataFrame, now: str) -> None:
    """The whole state, put in place at once."""
    rows = states.collect()
    data = {"status": status, "job_ids": {r["name"]: r["job_id"] for r in rows if r["job_id"]}, "simulation_status": {r["name"]: r["status"] for r in rows}, "last_updated": now}
    Path(f"{path}.new").write_text(json.dumps(data, indent=2))
    os.replace(f"{path}.new", path)


def run_folder(base: str, name: str, scratch: str | None = None) -> Path:
    """The folder of a run, with a link to its scratch folder; what is there stays."""
    if len(Path(base).resolve().parts) < 3:
        raise ValueError(f"{base} is too close to the root")
    out = Path(base, name)
    out.mkdir(parents=True, exist_ok=True)
    if scratch:
        target = Path(scratch, name)
        target.mkdir(parents=True, exist_ok=True)
        if not (out / "output").exists():
            (out / "output").symlink_to(target)
    return out


def copy_script(source: str, to: str) -> None:
    shutil.copy(source, to)
    os.chmod(to, 0o755)


def submit_job(script: str, runner: Callable[[list[str]], str] | None = None) -> str | None:
    """The id of a submitted job; runner takes a command and gives its output."""
    run = runner or (lambda cmd: subprocess.run(cmd, capture_output=True, text=True, check=True).stdout)
    words = run(["sbatch", script]).split()
    return words[-1] if words[:3] == ["Submitted", "batch", "job"] else None


def queue_codes(states: DataFrame, runner: Callable[[list[str]], str] | None = None) -> DataFrame:
    """(job_id, code) of the jobs of states that the queue still knows: one command for each job of a campaign."""
    run = runner or (lambda cmd: subprocess.run(cmd, capture_output=True, text=True, check=True, timeout=10).stdout)
    found = []
    for r in states.select("job_id").filter("job_id IS NOT NULL AND job_id NOT IN ('', 'N/A')").distinct().collect():
        try:
            code = run(["squeue", "-j", r["job_id"], "-h", "-o", "%T"]).strip()
        except (OSError, subprocess.SubprocessError) as e:
            print(f"job {r['job_id']}: {e}")
            continue
        if code:
            found.append((r["job_id"], code))
    return states.sparkSession.createDataFrame(found, "job_id string, code string")
