"""Command line: `python -m orrery.cli campaign.yaml status|list|submit|create|cancel|summary ...`, `python -m orrery.cli folder find` for the campaigns
below a folder, `python -m orrery.cli folder run --set nGrid=700 ...` for a single simulation. State is a JSON file beside the campaign's file.

Where SCRATCH, CFS, USER and pkdgravemail are set, they give the folders of runs and the address of the job's mail.
"""

from __future__ import annotations

import argparse
import datetime
import json
import os
import time
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import presets
from orrery.functions.cosmology import Cosmology, outer_redshift
from orrery.operators import campaign
from orrery.sources import metadata, sinks

#: The parts of a run's parameter file and job script that are filled in.
PARAMETER_FILE = "\n".join(
    ['achOutName      = "${achOutName}"', 'achTfFile       = "${achTfFile}"']
    + [f"{k:<15} = ${{{k}}}" for k in ("dRedshiftLCP", "dBoxSize", "nGrid", "iLPT", "dRedFrom", "h", "dOmega0", "dLambda", "dOmegaDE", "dSigma8", "dSpectral", "w0", "wa", "nSteps", "dRedTo", "iOutInterval")]
)
JOB_SCRIPT = "#!/bin/bash\n" + "\n".join(f"#SBATCH {x}" for x in ("-t ${tlimit}", "--mail-user=${email}", "--gpus-per-node=${gpupern}", "--cpus-per-task=${cpupert}", "-N ${nodes}", "-J ${jobname}", "--output=log-${jobname}.%j.oe")) + "\n\n${runcmd}\n"
#: Runs the simulation with a parameter file; its output goes to a log.
RUN_SCRIPT = '#!/bin/bash\nset -e\nsrun "${SIMULATION:-simulation}" "$1" > "$2" 2>&1\n'


def environment() -> dict[str, str]:
    """Folders and address from the environment, each with a default."""
    user, cfs, scratch = (os.environ.get(k, d) for k, d in (("USER", "default_user"), ("CFS", "/tmp/cfs"), ("SCRATCH", "/tmp/scratch")))
    return {"rundir": f"{cfs}/cosmosim/slac/{user}/pkdgrav3/runs", "scrdir": f"{scratch}/pkdgrav3/runs", "email": os.environ.get("pkdgravemail", "user@example.com")}


def write_run(folder: Path, name: str, params: dict) -> Path:
    """The files of a run in its folder: transfer function, parameter file, job script, run script. Gives the job script."""
    presets.check_run(params)
    cosmo = Cosmology(params["cosmo"])
    sinks.write_transfer(cosmo, str(folder / f"{name}.transfer"))
    targets = {"dRedTo": "[0.0]", "nSteps": "[1]"} | params
    values = sinks.run_values(targets, cosmo, outer_redshift(cosmo, float(params["dBoxSize"])), f"{folder}/output/{name}", str(folder / f"{name}.transfer"))
    (folder / f"{name}.par").write_text(sinks.render(PARAMETER_FILE, values))
    master = folder / "master.sh"
    master.write_text(RUN_SCRIPT)
    sinks.copy_script(str(master), str(folder / "run.sh"))
    master.unlink()
    script = folder / f"{name}.sbatch"
    script.write_text(sinks.render(JOB_SCRIPT, {"email": environment()["email"]} | params | {"jobname": name, "runcmd": f"./run.sh {name}.par {name}.log"}))
    return script


class Campaign:
    """Variants of a campaign's file and their states. Jobs go through `runner`, a function from a command to its output."""

    def __init__(self, spark: SparkSession, path: str, runner: Callable[[list[str]], str] | None = None):
        self.spark, self.runner = spark, runner
        self.settings, self.variants = metadata.campaign_file(spark, path)
        campaign.check(self.variants)
        self.folder = Path(self.settings.get("output_dir") or Path(path).parent)
        self.state_path = str(self.folder / "campaign_state.json")
        self.states = metadata.state_file(spark, self.state_path)

    def parameters(self, name: str) -> dict[str, str]:
        base = F.create_map(*[F.lit(str(x)) for kv in (presets.RUN | (self.settings.get("base_params") or {})).items() for x in kv])
        rows = campaign.run_parameters(self.variants.filter(F.col("name") == name), base, presets.preset_table(self.spark, presets.SIMULATIONS)).collect()
        if not rows:
            raise ValueError(f"Unknown variant: {name}")
        return rows[0]["params"]

    def create(self, name: str) -> Path:
        """The files of a variant's run: transfer function, parameter file, job script."""
        return write_run(sinks.run_folder(str(self.folder), name, self.settings.get("scratch_dir")), name, self.parameters(name))

    def _set(self, name: str, status: str, job: str | None) -> None:
        rows = [tuple(r) for r in self.states.collect() if r["name"] != name] + [(name, status, job)]
        self.states = self.spark.createDataFrame(rows, "name string, status string, job_id string")
        sinks.write_state(self.state_path, "submitting", self.states, datetime.datetime.now().isoformat())

    def submit(self, most: int | None = None, dry_run: bool = False, no_submit: bool = False) -> list[str]:
        """Names of the variants that were submitted (or would be), by priority."""
        ready = campaign.submittable(self.variants, self.states, F.current_timestamp())
        if dry_run or no_submit:
            chosen = campaign.by_priority(ready).limit(most) if most else ready
        else:
            running = campaign.running_jobs(self.states).first()[0]
            chosen = campaign.by_priority(campaign.to_submit(ready, running, self.settings["max_concurrent_jobs"], most))
        names = [r["name"] for r in chosen.collect()]
        for name in names if not dry_run else []:
            try:
                script = self.create(name)
                if not no_submit:
                    self._set(name, "queued", sinks.submit_job(str(script), self.runner))
            except (OSError, ValueError) as e:
                print(f"{name}: {e}")
                self._set(name, "failed", None)
        return names

    def update(self, queue: DataFrame | None = None) -> None:
        """States after a look at the queue; `queue` (job_id, code) stands for it where it is known."""
        queue = sinks.queue_codes(self.states, self.runner) if queue is None else queue
        rows = [tuple(r) for r in campaign.from_queue(self.states, queue).select("name", "status", "job_id").collect()]
        self.states = self.spark.createDataFrame(rows, "name string, status string, job_id string")
        sinks.write_state(self.state_path, "running", self.states, datetime.datetime.now().isoformat())

    def cancel(self, name: str) -> None:
        job = {r["name"]: r["job_id"] for r in self.states.collect()}.get(name)
        if job and self.runner:
            self.runner(["scancel", job])
        self._set(name, "cancelled", job)

    def report(self) -> str:
        return campaign.report(self.settings, self.variants, self.states)


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None, runner: Callable[[list[str]], str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="orrery", description="Campaigns of simulation variants")
    parser.add_argument("campaign", help="a campaign's file, or a folder for find and run")
    parser.add_argument("verb", choices=["status", "list", "submit", "create", "cancel", "summary", "find", "run"])
    parser.add_argument("--variant")
    parser.add_argument("--status", choices=campaign.STATUSES)
    parser.add_argument("--max", type=int)
    parser.add_argument("--dry-run", action="store_true")
    parser.add_argument("--no-submit", action="store_true")
    parser.add_argument("--no-update", action="store_true", help="status without a look at the queue")
    parser.add_argument("--watch", type=float, help="status again and again, after so many seconds")
    parser.add_argument("--times", type=int, help="how often to watch; without end by default")
    parser.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="a parameter of a single simulation")
    parser.add_argument("--preset", choices=presets.SIMULATIONS, default="S0-test")
    parser.add_argument("--cosmology", choices=presets.COSMOLOGIES, default=presets.DEFAULT_COSMOLOGY)
    given = parser.parse_args(args)
    if given.verb == "run":
        print(single(given.campaign, given.variant or given.preset, given.preset, given.cosmology, given.set, None if given.no_submit or given.dry_run else runner or sinks.submit_job))
        return 0
    spark = spark or SparkSession.builder.appName("orrery").getOrCreate()
    if given.verb == "find":
        print("\n".join(f"{r['path']} {r['status']}" for r in metadata.campaign_states(spark, given.campaign).orderBy("path").collect()))
        return 0
    c = Campaign(spark, given.campaign, runner)
    if given.verb == "status":
        left = given.times or -1
        while True:
            if not given.no_update:
                c.update()
            print(c.report())
            left -= 1
            if not given.watch or not left:
                break
            time.sleep(given.watch)
    elif given.verb == "list":
        print("\n".join(f"{r['name']} {r['status']}" for r in campaign.of_status(c.variants, c.states, given.status).collect()))
    elif given.verb == "summary":
        print(json.dumps(campaign.summary(c.variants, c.states).first().asDict()))
    elif given.verb == "create":
        print(c.create(given.variant))
    elif given.verb == "cancel":
        c.cancel(given.variant)
    else:
        print("\n".join(c.submit(given.max, given.dry_run, given.no_submit)))
    return 0


def single(base: str, name: str, preset: str, cosmology: str, changes: Sequence[str], submit: Callable | None = None) -> str:
    """A simulation of its own: its files, and its job if `submit` is given. Parameters are the preset's, with changes NAME=VALUE."""
    changed = {k: presets.typed(v) for k, _, v in (c.partition("=") for c in changes)}
    params = presets.RUN | presets.SIMULATIONS[preset] | {"cosmo": cosmology, "simname": preset} | changed
    script = write_run(sinks.run_folder(base, name, environment()["scrdir"] if "SCRATCH" in os.environ else None), name, params)
    if submit is None:
        return str(script)
    job = sinks.submit_job(str(script), None if submit is sinks.submit_job else submit)
    return f"{script} {job}"


if __name__ == "__main__":
    raise SystemExit(main())
