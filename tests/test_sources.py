"""Binary files, parameter files, logs, campaign and state files, discovery, and the fetch that stands on them."""

from __future__ import annotations

import json
import os
import struct

import numpy as np
import pytest

from orrery.plans.simulation import SimulationData
from orrery.sources import formats, metadata

STEPS = 3


def _records(kind: str, rng: np.random.Generator, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=formats.FORMATS[kind].record)
    low, high = (-0.5, 0.5) if kind != "lcp" else (-2.0, 2.0)
    for c in "xyz":
        out[c] = rng.uniform(low, high, n)
        out["v" + c] = rng.normal(0, 100, n)
    if kind == "fof":
        out["npart"] = rng.choice([10, 50, 100, 500, 1000, 5000], n)
        out["dum1"] = np.arange(3)
    else:
        out["mass"] = 1e10
    return out


@pytest.fixture(scope="module")
def simulation(tmp_path_factory):
    root = tmp_path_factory.mktemp("run")
    ns, rng, rows = str(root / "test_sim"), np.random.default_rng(1), {}
    for step in range(1, STEPS + 1):
        for kind, chunks, n in (("tps", 2, 45), ("lcp", 4, 16), ("fof", 3, 6)):
            fmt = formats.FORMATS[kind]
            for chunk in range(chunks):
                data = _records(kind, rng, n)
                head = struct.pack(">d6i", 1.0, n, 3, 0, n, 0, 0) if kind == "tps" else b""
                with open(fmt.file_name(ns, step, chunk), "wb") as f:
                    f.write(head + data.tobytes())
                rows[kind, step, chunk] = data
    (root / "test_sim.log").write_text("# step z\n0 3.0 x\n1 1.0 x\n2   0.5 x\n3 0.0 x\n")
    par = root / "test_sim.par"
    par.write_text(f'achOutName = "{ns}"\ndRedshiftLCP = 0.8 # outer\ndBoxSize = 1000\nnSteps = [1, 1, 1]\ndOmega0 = 3.2e-1\nh = 0.67\nnGrid = 64\n')
    return {"par": str(par), "ns": ns, "rows": rows}


def test_record_sizes():
    assert {k: f.record.itemsize for k, f in formats.FORMATS.items()} == {"tps": 36, "lcp": 40, "fof": 136}
    assert formats.FORMATS["tps"].rows_in(1652) == 45
    assert formats.FORMATS["fof"].rows_in(816) == 6
    with pytest.raises(ValueError):
        formats.FORMATS["tps"].rows_in(1653)
    assert formats.FORMATS["tps"].file_name("a", 7, 0) == "a.00007" and formats.FORMATS["tps"].file_name("a", 7, 2) == "a.00007.2"
    assert formats.FORMATS["fof"].file_name("a", 7, 0) == "a.00007.fofstats.0"


@pytest.mark.parametrize("kind", ["tps", "lcp", "fof"])
@pytest.mark.parametrize("split", [100, 1 << 20])
def test_scan_reads_every_record_of_every_chunk(spark, simulation, kind, split):
    fmt = formats.FORMATS[kind]
    files = formats.chunk_files(fmt, simulation["ns"], 2)
    got = formats.read_records(spark, kind, files, [2] * len(files), split=max(split, fmt.record.itemsize)).toPandas()
    want = np.concatenate([v for (k, s, _), v in sorted(simulation["rows"].items()) if (k, s) == (kind, 2)])
    assert len(got) == len(want) and set(got["step"]) == {2}
    for c in ("x", "vz"):
        assert np.array_equal(np.sort(got[c].to_numpy()), np.sort(want[c].astype("f4")))
    if kind == "fof":
        assert list(got["dum1"].iloc[0]) == [0, 1, 2] and got["npart"].dtype == np.int32


def test_missing_files_and_gaps(spark, simulation, tmp_path):
    assert formats.read_records(spark, "tps", []).count() == 0
    for chunk in (0, 1, 3):
        (tmp_path / f"a.00001.lcp.{chunk}").write_bytes(b"")
    assert len(formats.chunk_files(formats.FORMATS["lcp"], str(tmp_path / "a"), 1)) == 2
    assert formats.steps_on_disk(simulation["ns"]) == [1, 2, 3]


def test_parameters_and_log(spark, simulation, tmp_path):
    p = metadata.load_parameters(spark, simulation["par"])
    assert (p.zmax, p.boxsize, p.nsteps, p.omegam, p.h, p.ngrid) == (0.8, 1000, 3, 0.32, 0.67, 64)
    assert p.as_columns()["box_size"] == p.as_columns()["dBoxSize"] == 1000
    log = metadata.step_log(spark, simulation["ns"] + ".log").orderBy("step").collect()
    assert [tuple(r) for r in log] == [(0, 3.0), (1, 1.0), (2, 0.5), (3, 0.0)]
    (tmp_path / "bad.par").write_text("h = 0.7\n")
    with pytest.raises(ValueError, match="achOutName.*nGrid"):
        metadata.load_parameters(spark, str(tmp_path / "bad.par"))
    with pytest.raises(FileNotFoundError):
        metadata.load_parameters(spark, str(tmp_path / "none.par"))


def test_keys_match_as_endings(spark):
    row = spark.createDataFrame([("bigh = 2.5\nh = 0.7\nn = 12.5",)], "value string")
    got = row.select(metadata.parameter(row["value"], "h", "float"), metadata.parameter(row["value"], "n", "int"), metadata.parameter(row["value"], "q", "str")).first()
    assert tuple(got) == (2.5, 12, None)


def test_snapshots(spark, simulation):
    data = SimulationData(spark, simulation["par"])
    box = [(0.2, 0.9), (0.0, 0.7), (0.1, 1.0)]
    got = data.fetch(box, "xvp", "tps", redshifts=[0.0, 0.1]).toPandas()
    assert {"x", "y", "z", "vx", "vy", "vz", "box"} <= set(got.columns) and set(got["z_out"]) == {0.0} and sorted(set(got["box"])) == [0, 1]
    want = np.concatenate([v for (k, s, _), v in sorted(simulation["rows"].items()) if (k, s) == ("tps", 3)])
    xyz = [want[c].astype("f4") + np.float32(0.5) for c in "xyz"]
    inside = np.logical_and.reduce([(v > lo) & (v <= hi) for v, (lo, hi) in zip(xyz, box, strict=True)])
    assert (got["box"] == 0).sum() == (got["box"] == 1).sum() == inside.sum() > 0
    small = data.fetch([(0.4, 0.6)] * 3, "xp").count()
    assert small <= data.fetch([(0.1, 0.9)] * 3, "xp").count()


def test_halos_and_projections(spark, simulation):
    data = SimulationData(spark, simulation["par"])
    halos = data.fetch([(-1, 2)] * 3, "xvh", "fof").toPandas()
    assert len(halos) == 18 and halos["npart"].between(10, 5000).all()
    assert data.fetch([(-1, 2)] * 3, "xp").count() == data.fetch([(-1, 2)] * 3, "xvp").count() == 90
    first = SimulationData(spark, simulation["par"], first_chunk_only=True)
    assert first.fetch([(-1, 2)] * 3, "xvh", "fof").count() == 6
    with pytest.raises(ValueError):
        data.fetch([(-1, 2)] * 3, "xvh", "tps")


def test_light_cones(spark, simulation):
    data = SimulationData(spark, simulation["par"])
    got = data.fetch([(-2, 2)] * 3, "xvp", "lcp", lightcone=True)
    # steps 2 and 3 are inside the outer redshift; light-cone files aren't tiled
    assert got.count() == 2 * 4 * 16 and {r["step"] for r in got.select("step").distinct().collect()} == {2, 3}
    tiled = data.fetch([(-1, 1)] * 3, "xp", "tps", lightcone=True).toPandas()
    r = np.sqrt((tiled[["x", "y", "z"]].astype(float) ** 2).sum(axis=1))
    assert len(tiled) and (r <= data.shell(0.0, 1.0)[1]).all()


def test_empty_box_and_errors(spark, simulation):
    data = SimulationData(spark, simulation["par"])
    none = data.fetch([(5000, 6000)] * 3, "xvp")
    assert none.count() == 0 and {"x", "vz"} <= set(none.columns)
    for bad in ({"dataset": "xyz"}, {"filetype": "abc"}, {"filetype": "lcp"}):
        with pytest.raises(ValueError):
            data.fetch([(0, 1)] * 3, **bad)
    with pytest.raises(ValueError):
        data.matter_power([(0, 5)] * 3, ngrid=0)
    spectrum, stats = data.matter_power([(0.0, 1.0)] * 3, ngrid=8, assignment="ngp")
    assert spectrum.count() > 0 and stats.first()["particle_count"] == 90


def test_campaign_and_state_files(spark, tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("name: c\ndescription: d\nglobal_deadline: '2025-12-31T00:00:00'\nvariants:\n- {name: a, cosmology: lcdm, resolution: S0-test}\n- {name: b, cosmology: wcdm, resolution: S0-test, priority: 60, dependencies: [a], submission_deadline: '2025-06-01T00:00:00', custom_params: {nGrid: 10}}\n")
    settings, variants = metadata.campaign_file(spark, str(path))
    rows = variants.orderBy("ordinal").collect()
    assert settings["name"] == "c" and settings["max_concurrent_jobs"] == 10 and settings["global_deadline"].year == 2025
    assert [(r["name"], r["priority"], r["dependencies"], r["custom_params"]) for r in rows] == [("a", 50, [], {}), ("b", 60, ["a"], {"nGrid": "10"})]
    state = tmp_path / "campaign_state.json"
    state.write_text(json.dumps({"status": "planning", "job_ids": {"a": "17"}, "simulation_status": {"a": "queued", "b": "failed"}, "last_updated": "x"}))
    assert sorted(tuple(r) for r in metadata.state_file(spark, str(state)).collect()) == [("a", "queued", "17"), ("b", "failed", None)]
    state.write_text("{broken")
    assert metadata.state_file(spark, str(state)).count() == 0
    assert metadata.state_file(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(FileNotFoundError):
        metadata.campaign_file(spark, str(tmp_path / "none.yaml"))


def test_discovery(spark, tmp_path):
    out = tmp_path / "output"
    out.mkdir()
    for i, name in enumerate(["v.00001", "v.00002", "v.00003.lcp.0", "w.00009"]):
        (out / name).write_bytes(b"x")
        os.utime(out / name, (1000 + i, 1000 + i))
    assert metadata.newest_output(spark, str(tmp_path), "v").endswith("v.00002")
    (out / "old.tps").write_bytes(b"x")
    os.utime(out / "old.tps", (1, 1))
    assert metadata.newest_output(spark, str(tmp_path), "v").endswith("old.tps")
    (tmp_path / "campaign_state.json").write_text('{"status": "running"}')
    assert [r["status"] for r in metadata.campaign_states(spark, str(tmp_path)).collect()] == ["running"]


def test_two_columns_and_synthetic(spark, tmp_path):
    (tmp_path / "t.dat").write_text("# k T\n1e-3   2.5\n  2.0 3.0\n")
    assert [tuple(r) for r in metadata.two_columns(spark, str(tmp_path / "t.dat")).collect()] == [(0.001, 2.5), (2.0, 3.0)]
    p = formats.synthetic_particles(spark, 2000, 100.0).toPandas()
    assert len(p) == 2000 and p["x"].between(0, 100).all() and abs(p["y"].mean() - 50) < 3


@pytest.mark.parametrize("kind", ["tps", "lcp", "fof"])
def test_files_that_were_written_are_read_back(spark, tmp_path, kind):
    fmt, name = formats.FORMATS[kind], f"file://{tmp_path}/sim"
    rng = np.random.default_rng(3)
    rows = [(*map(float, rng.uniform(-0.5, 0.5, 6).astype("f4")), i) for i in range(500)]
    df = spark.createDataFrame(rows, "x float, y float, z float, vx float, vy float, vz float, npart int").repartition(3)
    formats.write_records(df, kind, name, 4)
    files = formats.chunk_files(fmt, name, 4)
    assert len(files) == 3 and formats.particle_count(fmt, files) == 500 and formats.steps_on_disk(name) == [4]
    names = ["x", "vz"] + (["npart"] if kind == "fof" else [])
    got = formats.read_records(spark, kind, files, [4] * 3, names, split=4000).select(*names).collect()
    assert sorted(tuple(r) for r in got) == sorted((r[0], r[5], r[6])[: len(names)] for r in rows)
    within = formats.read_records(spark, kind, files, [4] * 3, ["x", "y"], within=[(-0.1, 0.2), (0.0, 0.5), (-1, 1)])
    assert within.count() == sum(-0.1 <= r[0] <= 0.2 and 0 <= r[1] <= 0.5 for r in rows)


def test_shells_follow_the_density_of_the_file(spark, simulation, tmp_path):
    from orrery.functions.cosmology import Cosmology

    text = open(simulation["par"]).read()
    radii = []
    for density in (0.2, 0.5):
        path = tmp_path / f"{density}.par"
        path.write_text(text.replace("3.2e-1", str(density)))
        data = SimulationData(spark, str(path))
        radii.append(data.shell(0.5, 1.0)[1])
        assert radii[-1] == pytest.approx(float(Cosmology(h=0.67, omegam=density).z2chi(1.0)) / 1000, rel=1e-4)
    assert radii[0] > 1.1 * radii[1]
