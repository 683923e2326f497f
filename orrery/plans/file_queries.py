"""Queries that go through files: binary particle files that are written and read back, logs, parameter and campaign files, states, streams.

Each writes what it reads below the folder that driver and executors share.
"""

from __future__ import annotations

import json
import uuid

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.cosmology import Cosmology
from orrery.operators import campaign, grid, select, spectrum
from orrery.sources import formats, metadata, sinks, storage
from orrery.streaming import gridding

from .registry import (
    EDGES, HALOS, L, N, QUERIES, SQL, STATES, STEPS, VARIANTS, _COSMOLOGY, _BINS, _spot, _X, _Y, _Z, bins_sql, box_sql, distance_sql, halos, lookup_sql, modes_sql, ngp_sql, num, particles, particles_sql, query,
    rounded, rounded_sql, states, steps, table, variants,
)
from .simulation import SimulationData

__all__ = ["QUERIES", "SQL"]

#: The parameter file of the queries' run; its density isn't the preset's.
RUN = {"zmax": 2.0, "boxsize": 3000, "omegam": 0.4, "h": 0.67, "ngrid": 64}


def _write(path: str, text: str) -> None:
    store, inside = storage.opened(path)
    store.create_dir(inside.rpartition("/")[0])
    with store.open_output_stream(inside) as f:
        f.write(text.encode())


def _folder(spark: SparkSession) -> str:
    return f"{storage.shared_folder(spark)}/run-{uuid.uuid4().hex}"


def _run(spark: SparkSession, sf: str, **files: tuple[DataFrame, tuple[int, ...]]) -> SimulationData:
    """A run whose log has the steps of the nations and whose files of each format hold the given rows at the given steps."""
    name = _folder(spark) + "/sim"
    log = [f"{r['step']} {r['z']!r} x" for r in steps(spark, sf).orderBy("step").collect()]  # a log of output times
    _write(name + ".log", "# step redshift\n" + "\n".join(log) + "\n")
    _write(name + ".par", f'achOutName = "{name}"\ndRedshiftLCP = {RUN["zmax"]}\ndBoxSize = {RUN["boxsize"]}\nnSteps = [{len(log)}]\ndOmega0 = {RUN["omegam"]}\nh = {RUN["h"]}\nnGrid = {RUN["ngrid"]}\n')
    for kind, (rows, at) in files.items():
        for step in at:
            formats.write_records(rows, kind, name, step)
    return SimulationData(spark, name + ".par")


def _single(rows: DataFrame, *names: str) -> DataFrame:
    return rows.select(*[F.col(c).cast("float").alias(c) for c in names])


def _doubles(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in names})


_MOVES = ("x", "y", "z", "vx", "vy", "vz")
_FLOATS = ", ".join(f"CAST({c} AS FLOAT) AS {c}" for c in _MOVES)
_BACK = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _MOVES)
#: Files of snapshots have their middle at 0; readers move it to 0.5, in single precision.
_SNAPSHOT = f"SELECT {', '.join(f'{c} - CAST(-0.5 AS FLOAT) AS {c}' for c in 'xyz')}, vx, vy, vz FROM (SELECT {_FLOATS} FROM ({particles_sql(1.0, 0.5)}))"
_UNIT = [(0.1, 0.6), (0.05, 0.75), (0.0, 0.5)]


@query("q_tps_scan", f"SELECT box, z_out, {_BACK} FROM ({_SNAPSHOT}) CROSS JOIN (VALUES (0, CAST(0.125 AS DOUBLE)), (1, CAST(0.125 AS DOUBLE)), (2, CAST(0 AS DOUBLE))) b(box, z_out) WHERE {box_sql(_UNIT)}")
def _(spark, sf):
    data = _run(spark, sf, tps=(_single(particles(spark, sf, 1.0, 0.5), *_MOVES), (23, 24)))
    return _doubles(data.fetch(_UNIT, "xvp", "tps", redshifts=[0.1, 0.125, 0.0]).select("box", "z_out", *_MOVES), *_MOVES)


@query("q_lcp_scan", f"SELECT step, {_BACK} FROM (SELECT {_FLOATS} FROM ({particles_sql(1.0, 0.5)})) CROSS JOIN (VALUES (20), (22)) s(step) WHERE {box_sql([(-0.4, 0.4), (-0.3, 0.3), (-0.5, 0.2)])}")
def _(spark, sf):
    data = _run(spark, sf, lcp=(_single(particles(spark, sf, 1.0, 0.5), *_MOVES), (2, 20, 22)))  # step 2 lies beyond the light cone
    return _doubles(data.fetch([(-0.4, 0.4), (-0.3, 0.3), (-0.5, 0.2)], "xvp", "lcp", lightcone=True).select("step", *_MOVES), *_MOVES)


@query("q_fof_scan", f"SELECT {_BACK}, CAST(npart AS INT) AS npart FROM (SELECT {', '.join(f'CAST({c} / {num(L)} - {num(0.5)} AS FLOAT) - CAST(-0.5 AS FLOAT) AS {c}' for c in 'xyz')}, CAST(vx AS FLOAT) AS vx, CAST(vy AS FLOAT) AS vy, CAST(vz AS FLOAT) AS vz, npart FROM ({HALOS})) WHERE {box_sql(_UNIT)}")
def _(spark, sf):
    rows = halos(spark, sf).withColumns({c: F.col(c) / F.lit(L) - F.lit(0.5) for c in "xyz"})
    rows = rows.select(*[F.col(c).cast("float").alias(c) for c in _MOVES], F.col("npart").cast("int").alias("npart"))
    return _doubles(_run(spark, sf, fof=(rows, (24,))).fetch(_UNIT, "xvh", "fof", redshifts=[0.0]).select(*_MOVES, "npart"), *_MOVES)


#: Shells of the run's cosmology, linear between 1000 scale factors.
_RUN_COSMOLOGY = Cosmology(h=RUN["h"], omegam=RUN["omegam"])
_KNOTS = "SELECT 1 / power(CAST(10 AS DOUBLE), -(log10(CAST(1101 AS DOUBLE)) * (999 - i) / 999)) - 1 AS z FROM range(1000) r(i)"


def chiofz_sql(rows: str) -> str:
    """chi of z by knots at equal steps of log a, whose distances come from the full table."""
    knots = f"SELECT z AS x, chi AS y FROM ({lookup_sql(f'SELECT z FROM ({_KNOTS})', 'z', distance_sql(_RUN_COSMOLOGY), 'chi')})"
    return lookup_sql(rows, "z", knots, "chi")


@query("q_chiofz", f"SELECT step, z, round(chi, 5) AS chi, round(chi * {num(1 / RUN['boxsize'])}, 9) AS r FROM ({chiofz_sql(STEPS)})")
def _(spark, sf):
    data = _run(spark, sf)
    from orrery.functions.cosmology import applied

    chi = applied(F.col("z"), data.chiofz)
    return data.steps.select("step", "z", F.round(chi, 5).alias("chi"), F.round(chi / float(RUN["boxsize"]), 9).alias("r"))


_TILES = " CROSS JOIN ".join(f"(VALUES (CAST(-0.5 AS FLOAT)), (CAST(0.5 AS FLOAT))) t{c}(d{c})" for c in "xyz")
_CONE = [(-0.8, 0.9), (-0.9, 0.7), (-0.6, 0.8)]
_SHELLS = f"SELECT a.step, a.chi * {num(1 / RUN['boxsize'])} AS lo, b.chi * {num(1 / RUN['boxsize'])} AS hi FROM ({chiofz_sql(STEPS)}) a JOIN ({chiofz_sql(STEPS)}) b ON b.step = a.step - 1 WHERE a.step IN (20, 21)"
_CONE_R = "sqrt(CAST(x AS DOUBLE) * CAST(x AS DOUBLE) + CAST(y AS DOUBLE) * CAST(y AS DOUBLE) + CAST(z AS DOUBLE) * CAST(z AS DOUBLE))"


@query("q_lightcone_tps", f"SELECT s.step, round({_CONE_R}, 5) AS r, count(*) AS n FROM (SELECT x + dx AS x, y + dy AS y, z + dz AS z FROM (SELECT {_FLOATS} FROM ({particles_sql(1.0, 0.5)})) CROSS JOIN {_TILES}) p JOIN ({_SHELLS}) s ON {_CONE_R} > lo AND {_CONE_R} <= hi WHERE {box_sql(_CONE)} GROUP BY 1, 2")
def _(spark, sf):
    data = _run(spark, sf, tps=(_single(particles(spark, sf, 1.0, 0.5), *_MOVES), (20, 21)))
    rows = data.fetch(_CONE, "xp", "tps", lightcone=True)
    return rows.groupBy("step", F.round(select.radius(), 5).alias("r")).agg(F.count("*").alias("n"))


@query("q_step_log", f"SELECT step, z FROM ({STEPS})")
def _(spark, sf):
    return _run(spark, sf).steps.select("step", "z")


@query("q_parameter_names", f"SELECT * FROM (VALUES ('box_size', CAST(3000 AS DOUBLE)), ('dBoxSize', CAST(3000 AS DOUBLE)), ('nGrid', CAST(64 AS DOUBLE)), ('h', {num(0.67)}), ('omega_m', {num(0.4)})) t(name, value)")
def _(spark, sf):
    p = _run(spark, sf).parameters()
    return spark.createDataFrame([(k, float(v)) for k, v in p.items() if k != "namespace"], "name string, value double")


#: Records of a chunk file of q_particle_count, about: more rows make more chunks, and no larger ones.
#: Beyond 200 chunks (spark.shuffle.sort.bypassMergeThreshold) the shuffle holds rows back and may spill.
CHUNK_ROWS = 1 << 22


@query("q_particle_count", "SELECT CAST(24 AS INT) AS step, count(*) AS n, true AS several FROM lineitem")
def _(spark, sf):
    rows = _single(particles(spark, sf, 1.0, 0.5), "x", "y", "z")
    chunks = max(3, -(-rows.count() // CHUNK_ROWS))  # three at least, so that several files are counted
    data = _run(spark, sf, tps=(rows.repartition(chunks), (24,)))
    fmt = formats.FORMATS["tps"]
    at = [(s, files := formats.chunk_files(fmt, data.params.namespace, s), formats.particle_count(fmt, files)) for s in formats.steps_on_disk(data.params.namespace)]
    return spark.createDataFrame([(s, n, len(files) == chunks) for s, files, n in at], "step int, n long, several boolean")


@query("q_synthetic", "SELECT count(*) AS n, true AS inside, true AS different FROM lineitem")
def _(spark, sf):
    rows = formats.synthetic_particles(spark, table(spark, sf, "lineitem").count(), 1050.0)
    return rows.agg(F.count("*").alias("n"), (F.count_if(select.outside(1050.0)) == 0).alias("inside"), (F.stddev("x") > 290).alias("different"))


@query("q_shifted", f"SELECT ok, ln, round(x + {num(0.5)}, 9) AS x, round(y + {num(0.5)}, 9) AS y FROM ({particles_sql(1.0, 0.5)})")
def _(spark, sf):
    return select.shifted(particles(spark, sf, 1.0, 0.5), -0.5).select("ok", "ln", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query("q_slab_grid", f"SELECT CAST(least(greatest(floor(iy / 5), 0), 2) AS INT) AS rank, count(*) AS cells, sum(rho) AS mass FROM ({ngp_sql()}) GROUP BY 1")
def _(spark, sf):
    cells = grid.ngp(particles(spark, sf), N, L)
    rank = select.slab_rank(F.col("iy") * F.lit(L / N) + F.lit(L / N / 2), L, N, 3)
    return cells.groupBy(rank.alias("rank")).agg(F.count("*").alias("cells"), F.sum("rho").alias("mass"))


_SINGLE = f"SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in 'xyz')} FROM ({_SNAPSHOT}) WHERE x > 0 AND y > 0 AND z > 0"
_UNIT_EDGES = [float(e) for e in spectrum.default_edges(N, 1.0)]


@query("q_matter_power", f"SELECT bin, round(k, 5) AS k, round(p * 1e6, 4) AS p, n_modes FROM ({bins_sql(modes_sql(ngp_sql(rows=_SINGLE, side=1.0), side=1.0), _UNIT_EDGES)})")
def _(spark, sf):
    data = _run(spark, sf, tps=(_single(particles(spark, sf, 1.0, 0.5), *_MOVES), (24,)))
    out = data.matter_power([(0.0, 1.0)] * 3, N, assignment="ngp")[0]
    return out.select("bin", F.round("k", 5).alias("k"), F.round(F.col("p") * 1e6, 4).alias("p"), "n_modes")


@query("q_inverse_transform", f"SELECT ix, iy, iz, round(rho / (SELECT count(*) / {num(N**3)} FROM lineitem) - 1, 6) AS value FROM ({ngp_sql()})")
def _(spark, sf):
    cells = grid.ngp(particles(spark, sf), N, L)
    back = spectrum.field(spectrum.modes(cells, N), N)
    return back.join(cells, ["ix", "iy", "iz"], "left_semi").select("ix", "iy", "iz", (F.round("value", 6) + F.lit(0.0)).alias("value"))


@query("q_outer_redshift", f"SELECT n_nationkey, round(z, 6) AS z FROM ({lookup_sql(f'SELECT n_nationkey, 0.98 * (500 + 100 * n_nationkey) / {num(_COSMOLOGY.params["h"])} AS chi FROM nation', 'chi', f'SELECT y AS x, x AS y FROM ({distance_sql(_COSMOLOGY)})', 'z')})")
def _(spark, sf):
    from orrery.functions.cosmology import z_of_chi

    box = F.lit(0.98) * (500 + 100 * F.col("n_nationkey")) / F.lit(_COSMOLOGY.params["h"])
    return table(spark, sf, "nation").select("n_nationkey", F.round(z_of_chi(box, _COSMOLOGY), 6).alias("z"))


# --- text files --------------------------------------------------------------------------------------------------------


@query("q_two_columns", "SELECT n_nationkey / CAST(8 AS DOUBLE) AS k, CAST(n_regionkey AS DOUBLE) AS value FROM nation")
def _(spark, sf):
    path = _folder(spark) + "/table.dat"
    rows = table(spark, sf, "nation").selectExpr("n_nationkey / 8D AS k", "n_regionkey AS v").collect()  # a table of a few lines
    _write(path, "# k value\n\n" + "".join(f"  {r['k']:.6e}\t{r['v']}\n" for r in rows))
    return metadata.two_columns(spark, path)


@query("q_state_file", f"SELECT name, status, job_id FROM ({STATES})")
def _(spark, sf):
    path = _folder(spark) + "/campaign_state.json"
    _write(path, "{}")
    sinks.write_state(path, "running", states(spark, sf), "2025-01-01T00:00:00")
    return metadata.state_file(spark, path)


@query("q_spectrum_file", f"SELECT bin, round(k, 5) AS k, n_modes FROM ({_BINS})")
def _(spark, sf):
    path = _folder(spark) + "/spectrum.txt"
    rows = particles(spark, sf)
    out = spectrum.power_spectrum(rows, N, L, "ngp")[0]
    _write(path, "")
    sinks.write_spectrum(out, path, N, L, "ngp", rows.count())
    lines = spark.read.text(path).filter("NOT startswith(value, '#')").select(F.split("value", " ").alias("v"))
    read = lines.select(F.col("v")[0].cast("double").alias("k"), F.col("v")[2].cast("long").alias("n_modes"))
    return read.select(F.size(F.filter(F.array(*[F.lit(e) for e in EDGES]), lambda e: e <= F.col("k") + 1e-6)).alias("bin"), F.round("k", 5).alias("k"), "n_modes")


@query("q_campaign_file", f"SELECT v.ordinal, v.name, v.cosmology, v.resolution, v.priority, coalesce(d.name, '') AS needed, strftime(v.submission_deadline, '%Y-%m-%d') AS day, '7' AS seed FROM ({VARIANTS}) v LEFT JOIN ({VARIANTS}) d ON d.ordinal = v.needs")
def _(spark, sf):
    path = _folder(spark) + "/campaign.yaml"
    rows = variants(spark, sf).orderBy("ordinal").collect()  # a campaign's few variants
    listed = [{"name": r["name"], "cosmology": r["cosmology"], "resolution": r["resolution"], "priority": r["priority"], "dependencies": list(r["dependencies"]), "submission_deadline": r["submission_deadline"].isoformat(), "custom_params": dict(r["custom_params"])} for r in rows]
    _write(path, yaml.safe_dump({"name": "nations", "description": "d", "variants": listed}))
    out = metadata.campaign_file(spark, path)[1]
    return out.select("ordinal", "name", "cosmology", "resolution", "priority", F.array_join("dependencies", ",").alias("needed"), F.date_format("submission_deadline", "yyyy-MM-dd").alias("day"), F.col("custom_params")["seed"].alias("seed"))


@query("q_campaign_states", "SELECT r_name AS name, CASE WHEN r_regionkey % 2 = 0 THEN 'completed' ELSE 'running' END AS status FROM region")
def _(spark, sf):
    root = _folder(spark)
    for r in table(spark, sf, "region").collect():  # a folder for each campaign
        _write(f"{root}/{r['r_regionkey']}-{r['r_name'].replace(' ', '_')}/campaign_state.json", json.dumps({"status": "completed" if r["r_regionkey"] % 2 == 0 else "running", "name": r["r_name"]}))
    found = metadata.campaign_states(spark, root)
    return found.select(F.replace(F.regexp_extract("path", r"/[0-9]+-([^/]+)/campaign_state.json", 1), F.lit("_"), F.lit(" ")).alias("name"), "status")


@query("q_newest_output", "SELECT r_name AS name, CASE WHEN r_regionkey % 2 = 0 THEN 'tps' ELSE '00003' END AS ending FROM region")
def _(spark, sf):
    root, out = _folder(spark), []
    for r in table(spark, sf, "region").collect():
        folder = f"{root}/{r['r_regionkey']}"
        for name in ("v.00001", "v.00002.lcp.0", "v.00003", "v.00003.fofstats.0", *(["a.tps"] if r["r_regionkey"] % 2 == 0 else [])):
            _write(f"{folder}/{name}", "x")
        out.append((r["r_name"], (metadata.newest_output(spark, folder, "v") or "").rsplit(".", 1)[-1]))
    return spark.createDataFrame(out, "name string, ending string")


@query("q_queue_poll", f"SELECT name, CASE WHEN job_id IS NULL THEN status WHEN CAST(job_id AS INT) % 4 = 1 THEN 'running' WHEN CAST(job_id AS INT) % 4 = 3 THEN 'failed' ELSE status END AS status FROM ({STATES})")
def _(spark, sf):
    answer = {1: "R\n", 3: "TIMEOUT\n"}
    rows = states(spark, sf)
    queue = sinks.queue_codes(rows, lambda command: answer.get(int(command[2]) % 4, "ODD"))
    return campaign.from_queue(rows, queue).select("name", "status")


# --- streams -----------------------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "lineitem").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/lineitem.parquet*").selectExpr(*[f"{_spot(h, L)} AS {c}" for c, h in zip("xyz", (_X, _Y, _Z), strict=True)])


@query("q_stream_spectrum", rounded_sql(_BINS))
def _(spark, sf):
    return rounded(gridding.latest(gridding.spectra_to_table(_stream(spark, sf), N, L, "ngp", _folder(spark) + "/spectra")))
