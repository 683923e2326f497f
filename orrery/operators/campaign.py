"""Scheduling of simulation variants as relational queries over two small tables.

variants: (ordinal, name, cosmology, resolution, priority, dependencies, submission_deadline, custom_params, comment)
states: (name, status, job_id); a variant without a row is not submitted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.presets import COSMOLOGIES, SIMULATIONS, merged

#: States of a variant; what a queue's codes mean.
STATUSES = ("not_submitted", "queued", "running", "completed", "failed", "cancelled")
CODES = {"PENDING": "queued", "PD": "queued", "RUNNING": "running", "R": "running", "COMPLETED": "completed", "CD": "completed", "FAILED": "failed", "F": "failed", "TIMEOUT": "failed", "TO": "failed", "CANCELLED": "cancelled", "CA": "cancelled"}


def with_status(variants: DataFrame, states: DataFrame) -> DataFrame:
    return variants.join(states, "name", "left").withColumn("status", F.coalesce("status", F.lit(STATUSES[0])))


def by_priority(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("priority"), "ordinal")


def submittable(variants: DataFrame, states: DataFrame, now: Column) -> DataFrame:
    """Variants that aren't submitted, whose deadline hasn't passed and all of whose dependencies are completed."""
    open_ = with_status(variants, states).filter((F.col("status") == STATUSES[0]) & (F.col("submission_deadline").isNull() | (now <= F.col("submission_deadline"))))
    needs = variants.select("name", F.explode("dependencies").alias("needs"))
    done = states.filter("status = 'completed'").select(F.col("name").alias("needs"))
    waiting = needs.join(done, "needs", "left_anti").select("name").distinct()
    return by_priority(open_.join(waiting, "name", "left_anti"))


def to_submit(ready: DataFrame, running: int, most_running: int, most: int | None = None) -> DataFrame:
    """The first of the ready variants: at most `most`, and until `most_running` run; one is always sent."""
    place = F.row_number().over(Window.orderBy(F.desc("priority"), "ordinal"))
    room = max(1, most_running - running)
    return ready.withColumn("place", place).filter(F.col("place") <= min(room, most or room)).drop("place")


def running_jobs(states: DataFrame) -> DataFrame:
    return states.agg(F.count_if(F.col("status").isin("queued", "running")).alias("n_running"))


def of_status(variants: DataFrame, states: DataFrame, status: str | None = None) -> DataFrame:
    rows = with_status(variants, states)
    return by_priority(rows if status is None else rows.filter(F.col("status") == status))


def from_queue(states: DataFrame, queue: DataFrame) -> DataFrame:
    """states after a look at the queue (job_id, code); unknown codes and jobs leave them as they are."""
    new = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])[F.col("code")]
    return states.join(queue, "job_id", "left").select("name", F.coalesce(new, "status").alias("status"), "job_id")


def summary(variants: DataFrame, states: DataFrame) -> DataFrame:
    """One row: how many variants, in each state, and the share that is completed."""
    counts = states.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    total = variants.agg(F.count("*").alias("total_variants"))
    rate = F.when(F.col("total_variants") > 0, F.col("completed") / F.col("total_variants")).otherwise(0.0)
    return total.crossJoin(counts).withColumn("completion_rate", rate)  # a row each


def _left(value: Column, width: int) -> Column:
    """Padded to a width, never cut."""
    return F.rpad(value, F.greatest(F.length(value), F.lit(width)), F.lit(" "))


def report_rows(variants: DataFrame, states: DataFrame) -> DataFrame:
    """(ordinal, line): the table of a report."""
    rows = with_status(variants, states)
    parts = [_left(F.col("name"), 20), _left(F.col("cosmology"), 15), _left(F.col("resolution"), 15), _left(F.col("status"), 12), _left(F.col("priority").cast("string"), 8), _left(F.coalesce("job_id", F.lit("N/A")), 12)]
    place = F.row_number().over(Window.orderBy(F.desc("priority"), "ordinal"))
    return rows.select(place.alias("place"), F.concat_ws(" ", *parts).alias("line"))


def report(settings: dict, variants: DataFrame, states: DataFrame) -> str:
    s = summary(variants, states).first()
    name = settings["name"]
    lines = [f"Campaign: {name}", "=" * (len(name) + 10), f"Description: {settings.get('description', '')}", f"Status: {settings.get('status', 'planning')}", f"Progress: {s['completed']}/{s['total_variants']} ({s['completion_rate']:.1%})", "", "Status Breakdown:"]
    lines += [f"  {label + ':':<14} {s[k]:3d}" for label, k in (("Completed", "completed"), ("Running", "running"), ("Queued", "queued"), ("Not Submitted", "not_submitted"), ("Failed", "failed"), ("Cancelled", "cancelled"))]
    head = " ".join(f"{h:<{w}}" for h, w in (("Name", 20), ("Cosmology", 15), ("Resolution", 15), ("Status", 12), ("Priority", 8), ("Job ID", 12)))
    lines += ["", "Simulation Variants:", "-" * 90, head, "-" * 90]
    return "\n".join(lines + [r["line"] for r in report_rows(variants, states).orderBy("place").collect()])


def problems(variants: DataFrame) -> DataFrame:
    """(name, problem) of variants that break a rule."""
    unknown = [variants.filter(~F.col(c).isin(*known)).select("name", F.lit(f"unknown {c}").alias("problem")) for c, known in (("cosmology", COSMOLOGIES), ("resolution", SIMULATIONS))]
    twice = variants.groupBy("name").count().filter("count > 1").select("name", F.lit("duplicate name").alias("problem"))
    return unknown[0].unionAll(unknown[1]).unionAll(twice)


def check(variants: DataFrame) -> None:
    if variants.isEmpty():
        raise ValueError("A campaign needs at least one variant")
    if found := problems(variants).collect():
        raise ValueError("; ".join(f"{r['name']}: {r['problem']}" for r in found))


def run_parameters(variants: DataFrame, base: Column, presets: DataFrame) -> DataFrame:
    """variants with params: base, then the resolution's preset, then custom ones; names of cosmology, simulation and job are set last."""
    names = F.create_map(F.lit("cosmo"), F.col("cosmology"), F.lit("simname"), F.col("resolution"), F.lit("jobname_template"), F.col("name"))
    preset = presets.select(F.col("name").alias("resolution"), F.col("params").alias("preset"))
    return variants.join(F.broadcast(preset), "resolution", "left").withColumn("params", merged(base, F.col("preset"), F.col("custom_params"), names)).drop("preset")
