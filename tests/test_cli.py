"""Campaigns from the command line, with a stand-in for the queue."""

from __future__ import annotations

import json

import pytest

from orrery import cli

TEXT = """
name: two
description: a campaign
max_concurrent_jobs: 2
base_params: {email: me@x}
variants:
- {name: v1, cosmology: lcdm, resolution: S0-validation, priority: 80}
- {name: v2, cosmology: wcdm, resolution: S0-test, priority: 60, dependencies: [v1], custom_params: {nGrid: 64}}
- {name: v3, cosmology: planck18, resolution: S0-test, priority: 70}
"""


@pytest.fixture
def path(tmp_path):
    (tmp_path / "c.yaml").write_text(TEXT)
    return tmp_path / "c.yaml"


def test_campaign_life(spark, path, capsys):
    calls = []

    def runner(cmd):
        calls.append(cmd)
        return f"Submitted batch job {100 + len(calls)}\n"

    c = cli.Campaign(spark, str(path), runner)
    assert c.submit(dry_run=True) == ["v1", "v3"] and not calls
    assert c.submit(most=1, no_submit=True) == ["v1"] and c.states.count() == 0
    folder = path.parent / "v1"
    text = (folder / "v1.par").read_text()
    assert "nGrid           = 1400" in text and "dBoxSize        = 1050" in text and "#SBATCH -N 2" in (folder / "v1.sbatch").read_text()
    assert c.submit() == ["v1", "v3"] and len(calls) == 2
    again = cli.Campaign(spark, str(path), runner)
    assert sorted(tuple(r) for r in again.states.collect()) == [("v1", "queued", "101"), ("v3", "queued", "102")]
    again.update(spark.createDataFrame([("101", "COMPLETED"), ("102", "R")], "job_id string, code string"))
    assert again.submit() == ["v2"] and again.parameters("v2")["nGrid"] == "64"
    assert "w0              = -0.838000" in (path.parent / "v2" / "v2.par").read_text()
    again.cancel("v3")
    assert calls[-1] == ["scancel", "102"] and "Cancelled:       1" in again.report()
    with pytest.raises(ValueError):
        again.create("none")
    assert cli.main([str(path), "summary"], spark) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["completed"] == 1
    cli.main([str(path), "list", "--status", "completed"], spark)
    cli.main([str(path), "status"], spark)
    out = capsys.readouterr().out
    assert out.startswith("v1 completed") and "Progress: 1/3 (33.3%)" in out


def test_queue_is_polled_and_watched(spark, path, capsys):
    answers = {"1": "RUNNING\n", "2": "", "3": "CD\n"}

    def runner(cmd):
        return answers[cmd[2]] if cmd[0] == "squeue" else "Submitted batch job 9\n"

    c = cli.Campaign(spark, str(path), runner)
    for name, job in (("v1", "1"), ("v2", "2"), ("v3", "3")):
        c._set(name, "queued", job)
    c.update()
    # a job that the queue doesn't know keeps its state
    assert sorted(tuple(r) for r in c.states.collect()) == [("v1", "running", "1"), ("v2", "queued", "2"), ("v3", "completed", "3")]
    answers["1"] = "TIMEOUT\n"
    assert cli.main([str(path), "status", "--watch", "0.01", "--times", "2"], spark, runner) == 0
    assert capsys.readouterr().out.count("Failed:          1") == 2
    cli.main([str(path), "cancel", "--variant", "v2"], spark, runner)
    cli.main([str(path.parent), "find"], spark)
    assert "campaign_state.json submitting" in capsys.readouterr().out


def test_single_simulation(tmp_path, capsys, monkeypatch):
    monkeypatch.delenv("SCRATCH", raising=False)
    monkeypatch.setenv("pkdgravemail", "a@b")
    assert cli.main([str(tmp_path), "run", "--variant", "alone", "--preset", "S0-test", "--cosmology", "planck18", "--set", "nGrid=128", "--no-submit"]) == 0
    folder = tmp_path / "alone"
    assert "nGrid           = 128" in (folder / "alone.par").read_text() and "--mail-user=a@b" in (folder / "alone.sbatch").read_text()
    assert (folder / "run.sh").stat().st_mode & 0o100
    capsys.readouterr()
    cli.main([str(tmp_path), "run", "--variant", "sent"], runner=lambda cmd: "Submitted batch job 77\n")
    assert capsys.readouterr().out.strip().endswith("77")
    assert cli.environment()["scrdir"] == "/tmp/scratch/pkdgrav3/runs"
