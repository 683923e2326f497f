"""Text sources: parameter files, step logs, campaign files, state files, tables, and the discovery of outputs."""

from __future__ import annotations

import datetime
from dataclasses import dataclass
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import storage

#: Field of the parameters, key in the file, kind.
REQUIRED = (("namespace", "achOutName", "str"), ("zmax", "dRedshiftLCP", "float"), ("boxsize", "dBoxSize", "int"), ("nsteps", "nSteps", "int"), ("omegam", "dOmega0", "float"), ("h", "h", "float"), ("ngrid", "nGrid", "int"))


def parameter(content: Column, key: str, kind: str) -> Column:
    """A parameter in a file's text, null if it isn't there. The key isn't anchored: it also matches as the end of a longer key."""
    k = "".join("\\" + c if not (c.isalnum() or c == "_") else c for c in key)
    if kind == "str":
        return F.nullif(F.regexp_extract(content, rf"""{k}\s*=\s*["']([^"']+)["']""", 1), F.lit(""))
    if kind == "float":
        return F.regexp_extract(content, rf"{k}\s*=\s*([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)", 1).try_cast("double")
    if kind != "int":
        raise ValueError(f"Unknown kind {kind!r}")
    listed = F.regexp_extract(content, rf"{k}\s*=\s*\[([^\]]+)\]", 1)
    numbers = F.transform(F.filter(F.split(listed, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("long"))
    total = F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(listed != "", total).otherwise(F.regexp_extract(content, rf"{k}\s*=\s*([-+]?\d+)", 1).try_cast("long"))


def parse_parameters(files: DataFrame, content: str = "value") -> DataFrame:
    """The required parameters of each file, and the keys that are missing."""
    out = files.select("*", *[parameter(F.col(content), key, kind).alias(name) for name, key, kind in REQUIRED])
    return out.withColumn("missing", F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(k)) for n, k, _ in REQUIRED])))


@dataclass(frozen=True)
class Parameters:
    namespace: str
    zmax: float
    boxsize: int
    nsteps: int
    omegam: float
    h: float
    ngrid: int

    def as_columns(self) -> dict[str, float | int | str]:
        """The parameters under the names that gridding uses, the box under both of its names."""
        return {"box_size": self.boxsize, "dBoxSize": self.boxsize, "nGrid": self.ngrid, "h": self.h, "omega_m": self.omegam, "namespace": self.namespace}


def load_parameters(spark: SparkSession, path: str) -> Parameters:
    if storage.file_size(path) is None:
        raise FileNotFoundError(f"Parameter file not found: {path}")
    row = parse_parameters(spark.read.text(path, wholetext=True)).first()
    if row["missing"]:
        raise ValueError(f"Missing required parameters: {row['missing']}")
    return Parameters(**{n: row[n] for n, _, _ in REQUIRED})


def step_log(spark: SparkSession, path: str) -> DataFrame:
    """(step, z): the second column of a log; rows count as steps from 0."""
    if storage.file_size(path) is None:
        raise FileNotFoundError(f"Log file not found: {path}")
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")) != "")))
    return whole.select(F.col("pos").alias("step"), F.split(F.trim(F.regexp_replace("col", r"\s+", " ")), " ")[1].try_cast("double").alias("z"))


def two_columns(spark: SparkSession, path: str) -> DataFrame:
    """(k, value) of a text table; lines with # are comments."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("line")).filter("line <> '' AND NOT startswith(line, '#')")
    return lines.select(F.split("line", " ")[0].cast("double").alias("k"), F.split("line", " ")[1].cast("double").alias("value"))


VARIANT = T.StructType([
    T.StructField("ordinal", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("cosmology", T.StringType()), T.StructField("resolution", T.StringType()), T.StructField("priority", T.IntegerType()),
    T.StructField("dependencies", T.ArrayType(T.StringType())), T.StructField("submission_deadline", T.TimestampType()), T.StructField("custom_params", T.MapType(T.StringType(), T.StringType())), T.StructField("comment", T.StringType()),
])


def _time(value) -> datetime.datetime | None:
    return value if value is None or isinstance(value, datetime.datetime) else datetime.datetime.fromisoformat(str(value))


def campaign_file(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(settings, variants) of a campaign's YAML file."""
    if not Path(path).exists():
        raise FileNotFoundError(f"Campaign config file not found: {path}")
    data = yaml.safe_load(Path(path).read_text())
    rows = [
        (i, v["name"], v["cosmology"], v["resolution"], v.get("priority", 50), list(v.get("dependencies") or []), _time(v.get("submission_deadline")), {k: str(x) for k, x in (v.get("custom_params") or {}).items()}, v.get("comment"))
        for i, v in enumerate(data.pop("variants", []))
    ]
    settings = {"max_concurrent_jobs": 10, "base_params": {}, "output_dir": None, "scratch_dir": None} | data
    settings["global_deadline"] = _time(settings.get("global_deadline"))
    return settings, spark.createDataFrame(rows, VARIANT)


STATE = "status string, job_ids map<string,string>, simulation_status map<string,string>, last_updated string"


def explode_state(state: DataFrame) -> DataFrame:
    """(name, status, job_id) of a state row; a broken state gives no rows."""
    status = state.select(F.explode("simulation_status").alias("name", "status"), "job_ids")
    return status.select("name", "status", F.element_at("job_ids", F.col("name")).alias("job_id"))


def state_file(spark: SparkSession, path: str) -> DataFrame:
    if not Path(path).exists():
        return spark.createDataFrame([], "name string, status string, job_id string")
    return explode_state(spark.read.text(path, wholetext=True).select(F.from_json("value", STATE).alias("s")).filter("s IS NOT NULL").select("s.*"))


def newest_output(spark: SparkSession, folder: str, variant: str) -> str | None:
    """The newest output of a variant: a typed file, else a numbered snapshot that isn't of another type."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    typed = name.rlike(r"\.(tps|lcp|fof)$")
    numbered = name.startswith(variant + ".") & name.rlike(r"\.[0-9]") & ~name.rlike(r"\.(fofstats|hpb|lcp)")
    ranked = files.select("path", "modificationTime", F.when(typed, 2).when(numbered, 1).alias("rank")).filter("rank IS NOT NULL")
    return ranked.agg(F.max_by("path", F.struct("rank", "modificationTime", "path"))).first()[0]


def campaign_states(spark: SparkSession, folder: str) -> DataFrame:
    """(path, status) of all campaigns below a folder."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "campaign_state.json").text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", STATE)["status"].alias("status")).distinct()


def contiguous_prefix(files: DataFrame, chunk: str = "chunk") -> DataFrame:
    """Chunks 0, 1, 2 up to the first gap; the table has a row for each file of a step."""
    place = F.row_number().over(Window.orderBy(chunk)) - 1
    return files.withColumn("place", place).filter(F.col("place") == F.col(chunk)).drop("place")
