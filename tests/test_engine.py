"""Gridding and spectra against NumPy and theory; cosmology; campaigns; outputs; streams; every query against its SQL."""

from __future__ import annotations

import datetime
import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from orrery.functions import presets
from orrery.functions.cosmology import Cosmology, chi_of_z, outer_redshift
from orrery.operators import campaign, grid, select, spectrum
from orrery.plans import file_queries
from orrery.sources import formats, metadata, sinks

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def noise(spark):
    rng = np.random.default_rng(42)
    xyz = rng.random((50_000, 3), dtype=np.float32) * np.float32(100 * (1 - 1e-6))
    return spark.createDataFrame(pd.DataFrame(xyz, columns=list("xyz"))).cache(), xyz.astype(float)


def test_white_noise(noise):
    df, _ = noise
    rows, stats = spectrum.power_spectrum(df, 64, 100.0, "ngp")
    p, s = rows.orderBy("bin").toPandas(), stats.first()
    level = 100.0**3 / 50_000
    assert 0.7 < np.average(p["p"], weights=p["n_modes"]) / level < 1.3
    assert abs(s["delta_mean"]) < 0.01 and 0.5 < s["delta_variance"] / (64**3 / 50_000) < 2
    assert (np.abs(p["p"] / level - 1) * np.sqrt(p["n_modes"] / 2) > 3).mean() <= 0.1
    assert grid.chi2_tail(s["variance_chi2_statistic"], 64**3 - 1) >= 0.01


def test_transform_equals_numpy(noise):
    df, xyz = noise
    cells = grid.ngp(df, 16, 100.0)
    rho = np.zeros((16, 16, 16))
    np.add.at(rho, tuple(np.floor(xyz / (100 / 16)).astype(int).T), 1)
    want = np.fft.rfftn(rho / rho.mean() - 1)
    got = np.zeros_like(want)
    for r in spectrum.modes(cells, 16).toPandas().itertuples():
        got[r.kx, r.ky, r.kz] = complex(r.re, r.im)
    assert np.allclose(got, want, atol=1e-8)
    back = spectrum.field(spectrum.modes(cells, 16), 16).toPandas()
    value = np.zeros((16, 16, 16))
    value[back["ix"], back["iy"], back["iz"]] = back["value"]
    assert len(back) == 16**3 and np.allclose(value, rho / rho.mean() - 1, atol=1e-8)
    stats = spectrum.density_check(grid.density_stats(cells, 16), 50_000, 100.0, 16).first()
    assert stats["density_ratio"] == pytest.approx(1) and not stats["density_differs"]


def test_empty_planes_and_conservation(spark):
    one = spark.createDataFrame([(99.9, 0.1, 50.0)], "x double, y double, z double")
    assert abs(grid.cic(one, 8, 100.0).agg(F.sum("rho")).first()[0] - 1) < 1e-12
    assert {(r["ix"], r["iy"], r["iz"]) for r in grid.ngp(one, 8, 100.0).collect()} == {(7, 0, 4)}
    rows = spectrum.binned(grid.ngp(one, 8, 100.0), 8, 100.0).toPandas()
    assert np.allclose(rows["p"], 100.0**3)  # a single particle has the same power in every mode
    assert {(r["ix"], r["iy"], r["iz"]) for r in grid.ngp(one, 8, 100.0, nearest="rint").collect()} == {(0, 0, 4)}


def test_window_and_errors(noise, spark):
    df, _ = noise
    raw, flat = (spectrum.power_spectrum(df, 16, 100.0, "cic", correct_window=c)[0].orderBy("bin").toPandas() for c in (False, True))
    assert (flat["p"] >= raw["p"]).all() and (flat["n_modes"] == raw["n_modes"]).all()
    for bad in (lambda: grid.to_grid(df, 0, 1.0), lambda: grid.to_grid(df, 8, 1.0, "tsc"), lambda: select.check_bounds(df, 50.0), lambda: select.check_bounds(df.limit(0), 50.0), lambda: spectrum.grid_mean(df.limit(0).withColumn("rho", F.lit(1.0)), 8)):
        with pytest.raises(ValueError):
            bad()


def test_validation_flags(spark):
    ok = spark.createDataFrame([(1, 0.1, 5.0, 10), (2, 0.2, 4.0, 20)], "bin int, k double, p double, n_modes long")
    assert spectrum.validation(ok).first()["all_passed"]
    bad = spark.createDataFrame([(1, 0.3, -5.0, 10), (2, 0.2, 4.0, 20)], "bin int, k double, p double, n_modes long")
    r = spectrum.validation(bad).first()
    assert not r["positive_power"] and not r["monotonic_k"] and r["positive_modes"] and not r["all_passed"]


def test_edges_keep_numpy_digits():
    for n, box in ((8, 100.0), (64, 100.0), (128, 1000.0)):
        edges = spectrum.default_edges(n, box)
        assert len(edges) == max(5, min(80, n // 2)) + 1 and edges[0] == pytest.approx(2 * np.pi / box)


def test_cosmology(spark, tmp_path):
    c = Cosmology("planck18")
    assert c.z2chi(1.0) == pytest.approx(3400, rel=0.02) and c.chi2z(c.z2chi(0.7)) == pytest.approx(0.7, abs=1e-6)
    assert 0.7 < c.sigma8() < 0.95 and Cosmology("euclid-flagship").sigma8() == pytest.approx(0.831, rel=1e-3)
    assert c.omega_m + c.omega_l + c.omega_r == pytest.approx(1)
    assert Cosmology("wcdm", use_w=True).z2chi(1.0) != pytest.approx(Cosmology("wcdm").z2chi(1.0), rel=1e-4)
    df = spark.createDataFrame([(0.0,), (0.5,), (5.0,), (2000.0,)], "z double")
    got = [r[0] for r in df.select(chi_of_z(F.col("z"), c)).collect()]
    assert np.allclose(got, c.z2chi(np.array([0.0, 0.5, 5.0, 2000.0])))
    steps = c.chi_interpolator()  # linear between 1000 scale factors, and on beyond the last
    knots = 1 / np.logspace(-np.log10(1101), 0, 1000) - 1
    assert steps(knots[500]) == pytest.approx(c.z2chi(knots[500])) and steps((knots[500] + knots[501]) / 2) == pytest.approx((c.z2chi(knots[500]) + c.z2chi(knots[501])) / 2)
    assert steps(1200) > steps(1100)
    assert outer_redshift(c, 1050) == pytest.approx(float(c.chi2z(0.98 * 1050 / 0.6736)))
    sinks.write_transfer(c, str(tmp_path / "t.dat"))
    table = metadata.two_columns(spark, str(tmp_path / "t.dat"))
    assert table.count() == 400 and table.agg(F.min("k")).first()[0] == pytest.approx(5e-5)
    k, power, t = c.table()
    assert (np.diff(t) < 0).mean() > 0.9 and 0.01 < k[power.argmax()] < 0.03


def test_presets():
    assert (presets.typed("12"), presets.typed("1.5"), presets.typed("a")) == (12, 1.5, "a")
    presets.check_run({"nGrid": "64", "nodes": 1, "gpupern": 4, "dBoxSize": 10.5})
    for bad in ({"nGrid": 0}, {"nodes": "x"}, {"dBoxSize": -1}):
        with pytest.raises(ValueError):
            presets.check_run({"nGrid": 64, "nodes": 1, "gpupern": 4, "dBoxSize": 10} | bad)
    assert presets.cosmology("nothing")["h"] == pytest.approx(0.68906658)
    assert presets.cosmology("planck18", h=0.7)["omegam"] == pytest.approx((0.02237 + 0.12) / 0.49)
    assert presets.cosmology("lcdm", mnu=0.1, numnu=0)["numnu"] == 1
    assert presets.SIMULATIONS["S0-production"] == {"dBoxSize": 5250, "nGrid": 7000, "nodes": 250, "gpupern": 4, "tlimit": "48:00:00"}


@pytest.fixture
def two(spark):
    rows = [(0, "v1", "lcdm", "S0-test", 80, [], None, {}, None), (1, "v2", "wcdm", "S0-test", 60, ["v1"], None, {}, None), (2, "v3", "lcdm", "S0-test", 90, ["none"], None, {}, None), (3, "v4", "lcdm", "S0-test", 80, [], datetime.datetime(2020, 1, 1), {}, None)]
    return spark.createDataFrame(rows, metadata.VARIANT)


def _states(spark, *rows):
    return spark.createDataFrame(list(rows), "name string, status string, job_id string")


def test_readiness(spark, two):
    now = F.lit(datetime.datetime(2025, 1, 1))
    names = lambda *s: [r["name"] for r in campaign.submittable(two, _states(spark, *s), now).collect()]
    assert names() == ["v1"]
    assert names(("v1", "completed", "1")) == ["v2"]
    assert names(("v1", "running", "1")) == []
    ready = two.filter("name <> 'v3'")
    assert [r["name"] for r in campaign.to_submit(ready, 9, 10).collect()] == ["v1"]
    assert [r["name"] for r in campaign.to_submit(ready, 20, 10).collect()] == ["v1"]  # one always goes
    assert [r["name"] for r in campaign.to_submit(ready, 0, 10, 2).collect()] == ["v1", "v4"]
    assert [r["name"] for r in campaign.of_status(two, _states(spark)).collect()] == ["v3", "v1", "v4", "v2"]


def test_report_and_state(spark, two, tmp_path):
    states = _states(spark, ("v1", "completed", "7"), ("v2", "running", None))
    text = campaign.report({"name": "c", "description": "d"}, two, states)
    assert "Completed:       1" in text and "Running:         1" in text and "Progress: 1/4 (25.0%)" in text
    assert f"{'v1':<20} {'lcdm':<15} {'S0-test':<15} {'completed':<12} {80:<8} {'7':<12}" in text
    sinks.write_state(str(tmp_path / "s.json"), "running", states, "now")
    assert sorted(map(tuple, metadata.state_file(spark, str(tmp_path / "s.json")).collect())) == sorted(map(tuple, states.collect()))
    queue = spark.createDataFrame([("7", "CA")], "job_id string, code string")
    assert {r["name"]: r["status"] for r in campaign.from_queue(states, queue).collect()} == {"v1": "cancelled", "v2": "running"}


def test_campaign_rules(spark, two):
    campaign.check(two)
    for bad in (two.limit(0), two.unionAll(two.limit(1)), two.withColumn("cosmology", F.lit("x"))):
        with pytest.raises(ValueError):
            campaign.check(bad)


def test_rendering(tmp_path):
    c = Cosmology("wcdm")
    values = sinks.run_values(presets.RUN | {"dRedTo": "[0.0]", "nSteps": "[1]"}, c, 0.4567, "/out", "t.dat")
    text = sinks.render("dBoxSize        = ${dBoxSize} #\nnGrid           = ${nGrid} #\nz=${dRedshiftLCP} ${dLambda} ${dOmegaDE}", values)
    assert "nGrid           = 1400" in text and "dBoxSize        = 1050" in text and "z=0.46 0.000000 0.7" in text
    with pytest.raises(sinks.TemplateError):
        sinks.render("${missing}", {})
    folder = sinks.run_folder(str(tmp_path / "runs"), "a", str(tmp_path / "scratch"))
    assert (folder / "output").is_symlink() and sinks.run_folder(str(tmp_path / "runs"), "a") == folder
    (tmp_path / "s.sh").write_text("#!/bin/sh\n")
    sinks.copy_script(str(tmp_path / "s.sh"), str(folder / "run.sh"))
    assert os.access(folder / "run.sh", os.X_OK)
    assert sinks.submit_job("x", lambda cmd: "Submitted batch job 123\n") == "123" and sinks.submit_job("x", lambda cmd: "no") is None


def test_spectrum_file(noise, tmp_path):
    df, _ = noise
    rows, _ = spectrum.power_spectrum(df, 16, 100.0, "ngp")
    path = sinks.write_spectrum(rows, str(tmp_path / "p.txt"), 16, 100.0, "ngp", 50_000)
    lines = open(path).read().splitlines()
    data = [x.split() for x in lines if not x.startswith("#")]
    assert "# Grid size: 16³" in lines and len(data) == rows.count() and all(len(x) == 4 and x[3] in ("valid", "aliased") for x in data)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def _cells(df):
    names = sorted(df.columns)
    text = lambda v: "null" if v is None or v is pd.NA or v != v else repr(float(v)) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)
    return names, sorted(tuple(text(v) for v in row) for row in df[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(file_queries.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = file_queries.QUERIES[name](spark, SMALL).toPandas()
    assert _cells(got) == _cells(duck.execute(file_queries.SQL[name]).df())


def test_more_particles_make_more_chunks_and_no_larger_ones(spark, monkeypatch):
    made, count = [], formats.particle_count
    monkeypatch.setattr(formats, "particle_count", lambda fmt, files: made.extend(count(fmt, [f]) for f in files) or count(fmt, files))
    monkeypatch.setattr(file_queries, "CHUNK_ROWS", 500, raising=False)
    got = file_queries.QUERIES["q_particle_count"](spark, SMALL).collect()
    n = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    assert [tuple(r) for r in got] == [(24, n, True)]
    assert len(made) == -(-n // 500) and sum(made) == n and max(made) <= 600


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
