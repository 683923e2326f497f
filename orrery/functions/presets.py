"""Presets of simulations and cosmologies, categories of parameters: fixed values, and small tables of them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Box, grid, nodes, GPUs a node (none: not set), time limit.
SIMULATIONS = {
    "S0-test": {"dBoxSize": 525, "nGrid": 700, "nodes": 1, "tlimit": "12:00:00"},
    "S0-validation": {"dBoxSize": 1050, "nGrid": 1400, "nodes": 2, "gpupern": 4, "tlimit": "48:00:00"},
    "S0-scaling": {"dBoxSize": 2100, "nGrid": 2800, "nodes": 16, "gpupern": 4, "tlimit": "48:00:00"},
    "S0-production": {"dBoxSize": 5250, "nGrid": 7000, "nodes": 250, "gpupern": 4, "tlimit": "48:00:00"},
}
#: What a run has besides its preset.
RUN = {"nodes": 2, "cpupert": 128, "gpupern": 4, "tlimit": "48:00:00", "dBoxSize": 1050, "nGrid": 1400, "iLPT": 3, "dRedFrom": 12.0, "iOutInterval": 1, "simname": "S0-test", "jobname_template": "N{nGrid}-L{dBoxSize}-{gpupern}gpus"}
DEFAULT_COSMOLOGY = "desi-dr2-planck-act-mnufree"
_BASE = {"h": 0.68906658, "ombh2": 0.022597077, "omch2": 0.11788858, "As": 2.1302742e-09, "ns": 0.97278164, "TCMB": 2.72548, "omegak": 0.0, "sigma8": None, "mnu": 0.0, "nnu": 3.044, "tau": 0.0543, "numnu": 3, "harchy": "normal", "k0phys": 0.05}
#: Parameters of cosmologies.
COSMOLOGIES = {
    DEFAULT_COSMOLOGY: _BASE,
    "euclid-flagship": {"h": 0.67, "omegam": 0.32, "omegab": 0.049, "sigma8": 0.831, "As": 2.1e-9, "ns": 0.96, "mnu": 0.0587, "TCMB": 2.72548, "omegak": 0.0, "nnu": 3.044, "tau": 0.0543, "numnu": 1, "harchy": "normal", "k0phys": 0.05},
    "planck18": {"h": 0.6736, "ombh2": 0.02237, "omch2": 0.12, "As": 2.1e-9, "ns": 0.9649, "TCMB": 2.72548, "omegak": 0.0, "sigma8": None, "mnu": 0.06, "nnu": 3.046, "tau": 0.0544, "numnu": 3, "harchy": "normal", "k0phys": 0.05},
    "lcdm": _BASE | {"description": "A cosmological constant, with the densities of the default"},
    "wcdm": _BASE | {"w0": -0.838, "wa": -0.62, "description": "Dark energy whose equation of state changes with time"},
    "phicdm": _BASE | {"phi_model": "quintessence", "phi_params": {"potential": "exponential", "lambda_phi": 0.1}, "description": "Dark energy as a scalar field with an exponential potential"},
}
#: Names of parameters by category; a name that is in two belongs to the first.
CATEGORIES = {
    "cosmological": (
        "cosmology", "cosmo", "h", "H0", "omegam", "omegab", "omegac", "omegal", "omegak", "ombh2", "omch2", "sigma8", "As", "ns", "mnu", "nnu", "numnu", "tau", "TCMB",
        "harchy", "k0phys", "w0", "wa", "phi_model", "phi_params", "effective_h", "effective_omegam", "effective_omegal", "effective_sigma8", "effective_ns",
        "omegal_calculated", "omegam_calculated", "sigma8_final", "sigma8_calculated_by_camb_before_norm", "sigma8_normalization_factor_applied",
    ),
    "slurm": (
        "account", "partition", "qos", "nodes", "cpupert", "gpupern", "mem", "tlimit", "time_limit", "timelimit", "email", "mail_type", "mail_user", "job_name",
        "jobname", "jobname_template", "jobname_actual", "output", "error", "stdout", "stderr", "constraint", "reservation", "sbatch", "interact", "interactive",
        "rundir", "scrdir", "scratch",
    ),
    "simulation": (
        "simname", "sim_preset", "N", "L", "nGrid", "dBoxSize", "boxsize", "dRedFrom", "dRedTo", "dRedshiftLCP", "nSteps", "nsteps", "iOutInterval", "iLPT", "dSigma8",
        "dSpectral", "dOmega0", "dLambda", "dOmegaDE", "w0", "wa", "achOutName", "achTfFile", "bDoHalo", "bDumpFrame", "bDoGas", "bDoStar", "bFeedback", "bOverwrite",
        "seed", "random_seed", "output_dir", "scratch_dir",
    ),
}


def cosmology(name: str, **changes) -> dict:
    """A cosmology with changes; densities follow from each other and h. An unknown name gives the default, with a warning."""
    if name not in COSMOLOGIES:
        print(f"Warning: no cosmology {name!r}; {DEFAULT_COSMOLOGY!r} is used")
        name = DEFAULT_COSMOLOGY
    p = COSMOLOGIES[name] | changes
    h2 = p["h"] ** 2
    if {"omegam", "omegab", "h"} & set(changes) or "ombh2" not in p or "omch2" not in p:
        omegab = p["omegab"] if "omegab" in p else p["ombh2"] / h2
        omegam = p["omegam"] if "omegam" in p else (p["ombh2"] + p["omch2"]) / h2
        p |= {"omegab": omegab, "omegam": omegam, "ombh2": omegab * h2, "omch2": (omegam - omegab) * h2}
    if p.get("mnu", 0) > 0 and p.get("numnu", 0) == 0:
        p["numnu"] = 1
    return p


def typed(text: str) -> int | float | str:
    """A parameter from a command line: digits are whole numbers, decimals are numbers, all else is text."""
    if text.isdigit():
        return int(text)
    try:
        return float(text)
    except ValueError:
        return text


def check_run(params: dict) -> None:
    """Raises unless grid, nodes and GPUs are positive whole numbers and the box is a positive number."""
    value = {k: typed(v) if isinstance(v, str) else v for k, v in params.items()}
    bad = [k for k in ("nGrid", "nodes", "gpupern") if not (isinstance(value.get(k), int) and value[k] > 0)]
    if not (isinstance(value.get("dBoxSize"), (int, float)) and value["dBoxSize"] > 0):
        bad.append("dBoxSize")
    if bad:
        raise ValueError(f"Not positive numbers: {bad}")


def preset_table(spark: SparkSession, presets: dict[str, dict]) -> DataFrame:
    """(name, params): values as text, nested ones as JSON."""
    text = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v)
    return spark.createDataFrame([(n, {k: text(v) for k, v in p.items() if v is not None}) for n, p in presets.items()], "name string, params map<string,string>")


def category(name: Column) -> Column:
    """The category of a parameter by its name, else other."""
    out = F.lit("other")
    for kind in reversed(CATEGORIES):
        out = F.when(name.isin(*CATEGORIES[kind]), kind).otherwise(out)
    return out


def of_category(params: Column, kind: str) -> Column:
    """The entries of a map of one category; simulation parameters keep what simulations share with cosmologies."""
    if kind == "simulation":
        return F.map_filter(params, lambda k, _: k.isin(*CATEGORIES["simulation"]))
    return F.map_filter(params, lambda k, _: category(k) == kind)


def separation(params: DataFrame, column: str = "params") -> DataFrame:
    """Counts by category of each row's map; valid with some cosmological parameters and some others."""
    kinds = [*CATEGORIES, "other"]
    out = params
    for kind in kinds:
        out = out.withColumn(f"n_{kind}", F.size(F.map_filter(F.col(column), lambda k, _: category(k) == kind)))  # noqa: B023
    total = sum((F.col(f"n_{k}") for k in kinds[1:]), F.col(f"n_{kinds[0]}"))
    return out.withColumn("total", total).withColumn("valid", (F.col("n_cosmological") > 0) & (F.col("total") > F.col("n_cosmological")))


def merged(*maps: Column) -> Column:
    """Maps as one, later entries win; null maps are empty."""
    out = F.coalesce(maps[0], F.create_map().cast("map<string,string>"))
    for m in maps[1:]:
        later = F.coalesce(m, F.create_map().cast("map<string,string>"))
        names = F.map_keys(later)
        out = F.map_concat(F.map_filter(out, lambda k, _: ~F.array_contains(names, k)), later)  # noqa: B023
    return out


def job_name(template: Column, grid: Column, box: Column, gpus: Column, simname: Column) -> Column:
    """The name of a job; a template without braces is the name itself."""
    filled = template
    for key, value in (("nGrid", grid), ("dBoxSize", box), ("gpupern", gpus)):
        filled = F.replace(filled, F.lit("{" + key + "}"), value.cast("string"))
    whole = grid.isNotNull() & box.isNotNull() & gpus.isNotNull()
    return F.when(~F.contains(template, F.lit("{")), template).when(whole, filled).otherwise(F.concat(F.lit("run_"), F.coalesce(simname, F.lit("default"))))


def node_count(grid: Column) -> Column:
    """Nodes of a run: 2 (grid / 1400)^3."""
    r = grid.cast("double") / F.lit(1400.0)
    return F.lit(2.0) * r * r * r


def dark_energy(w0: Column, wa: Column, omegal: Column) -> tuple[Column, Column]:
    """(dLambda, dOmegaDE): the density goes to the second where the equation of state isn't that of a constant."""
    evolves = F.coalesce(w0 != -1.0, F.lit(False)) | F.coalesce(wa != 0.0, F.lit(False))
    of = F.coalesce(omegal, F.lit(0.7))
    return F.when(evolves, 0.0).otherwise(of), F.when(evolves, of).otherwise(0.0)


def redshift_list(values: Column) -> tuple[Column, Column]:
    """(targets, steps) as lists in text: distinct redshifts from high to low with four decimals, and a step for each."""
    order = F.sort_array(F.array_distinct(values), asc=False)
    text = F.concat(F.lit("["), F.concat_ws(", ", F.transform(order, lambda z: F.format_string("%.4f", z))), F.lit("]"))
    return text, F.concat(F.lit("["), F.concat_ws(", ", F.transform(order, lambda _: F.lit("1"))), F.lit("]"))
