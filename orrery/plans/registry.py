"""All queries by name, with the SQL that gives the same rows.

Particles, halos, output steps and variants are views over the generic tables: particles over lineitem, halos over customers and
their orders, steps and variants over nations.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import presets
from orrery.functions.cosmology import Cosmology, chi_of_z, z_of_chi
from orrery.operators import campaign, grid, select, spectrum
from orrery.sources import metadata, sinks, storage
from orrery.streaming.gridding import grid_to_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
N, L = 16, 100.0
N_FINE = 32


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def num(x: float) -> str:
    """A double in both dialects."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- views -------------------------------------------------------------------------------------------------------------


def _spot(hash_: str, side: float) -> str:
    return f"CAST(({hash_}) % 1000003 AS DOUBLE) / CAST(1000003 AS DOUBLE) * {num(side)}"


_X, _Y, _Z = "l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31", "l_partkey * 6151 + l_orderkey * 17 + l_linenumber", "l_suppkey * 49157 + l_orderkey * 12289 + l_linenumber * 3"
_KEYS = "l_orderkey AS ok, l_linenumber AS ln"


def particles_sql(side: float = L, shift: float = 0.0) -> str:
    xyz = ", ".join(f"{_spot(h, side)} - {num(shift)} AS {c}" for c, h in zip("xyz", (_X, _Y, _Z), strict=True))
    return f"SELECT {_KEYS}, {xyz}, l_quantity AS vx, l_discount AS vy, l_tax AS vz FROM lineitem"


def particles(spark: SparkSession, sf: str, side: float = L, shift: float = 0.0) -> DataFrame:
    xyz = [f"{_spot(h, side)} - {num(shift)} AS {c}" for c, h in zip("xyz", (_X, _Y, _Z), strict=True)]
    return table(spark, sf, "lineitem").selectExpr("l_orderkey AS ok", "l_linenumber AS ln", *xyz, "l_quantity AS vx", "l_discount AS vy", "l_tax AS vz")


_HALO = [f"CAST((c_custkey * {m}) % 10007 AS DOUBLE) / CAST(10007 AS DOUBLE) * {num(L)} AS {c}" for c, m in (("x", 7919), ("y", 6151), ("z", 4391))]


def halos(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("npart"))
    at = table(spark, sf, "customer").selectExpr("c_custkey", *_HALO, "c_acctbal AS vx", "c_acctbal AS vy", "c_acctbal AS vz")
    return at.join(n, F.col("c_custkey") == F.col("o_custkey")).drop("o_custkey")


HALOS = f"SELECT c_custkey, {', '.join(_HALO)}, c_acctbal AS vx, c_acctbal AS vy, c_acctbal AS vz, npart FROM customer JOIN (SELECT o_custkey, count(*) AS npart FROM orders GROUP BY 1) ON o_custkey = c_custkey"
_STEP = "n_nationkey AS step, CAST(24 - n_nationkey AS DOUBLE) / CAST(8 AS DOUBLE) AS z"
STEPS = f"SELECT {_STEP} FROM nation"


def steps(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").selectExpr(*[x.strip() for x in _STEP.split(", ")])


_COSMO = "element_at(array('lcdm', 'wcdm', 'phicdm', 'planck18'), n_nationkey % 4 + 1)"
_SIZE = "element_at(array('S0-test', 'S0-validation', 'S0-scaling'), n_nationkey % 3 + 1)"
_VARIANT = (
    "n_nationkey AS ordinal, n_name AS name, {cosmo} AS cosmology, {size} AS resolution, (n_nationkey * 37) % 10 * 10 AS priority, "
    "CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey - n_nationkey % 5 END AS needs, CASE WHEN n_nationkey % 6 = 1 THEN TIMESTAMP '2025-01-01 00:00:00' ELSE TIMESTAMP '2025-06-01 00:00:00' END AS submission_deadline"
)
VARIANTS = f"SELECT {_VARIANT.format(cosmo=_COSMO.replace('element_at(array(', 'list_extract(list_value('), size=_SIZE.replace('element_at(array(', 'list_extract(list_value('))} FROM nation"
_STATE = "CASE n_nationkey % 10 WHEN 0 THEN 'completed' WHEN 5 THEN 'running' WHEN 7 THEN 'queued' WHEN 9 THEN 'failed' END"
STATES = f"SELECT n_name AS name, {_STATE} AS status, CASE WHEN n_nationkey % 2 = 1 THEN CAST(1000 + n_nationkey AS VARCHAR) END AS job_id FROM nation WHERE {_STATE} IS NOT NULL"
WITH_STATUS = f"SELECT v.*, coalesce(s.status, 'not_submitted') AS status, s.job_id FROM ({VARIANTS}) v LEFT JOIN ({STATES}) s USING (name)"
NOW = "TIMESTAMP '2025-03-01 00:00:00'"


def variants(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation")
    nation.createOrReplaceTempView("_nation_view")
    rows = spark.sql(f"SELECT {_VARIANT.format(cosmo=_COSMO, size=_SIZE)} FROM _nation_view")
    names = rows.select(F.col("ordinal").alias("needs"), F.col("name").alias("needed"))
    rows = rows.join(names, "needs", "left").withColumn("dependencies", F.array_compact(F.array("needed"))).drop("needs", "needed")
    return rows.withColumn("custom_params", F.create_map(F.lit("nGrid"), F.col("ordinal").cast("string"), F.lit("seed"), F.lit("7")))


def states(spark: SparkSession, sf: str) -> DataFrame:
    job = F.when(F.col("n_nationkey") % 2 == 1, (F.col("n_nationkey") + 1000).cast("string"))
    return table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.expr(_STATE).alias("status"), job.alias("job_id")).filter("status IS NOT NULL")


# --- selection ---------------------------------------------------------------------------------------------------------

BOX = [(10.0, 60.0), (5.0, 75.0), (0.0, 50.0)]


def box_sql(bounds=BOX) -> str:
    return " AND ".join(f"{c} > {num(lo)} AND {c} <= {num(hi)}" for c, (lo, hi) in zip("xyz", bounds, strict=True))


@query("q_bbox_xp", f"SELECT ok, ln, x, y, z FROM ({particles_sql()}) WHERE {box_sql()}")
def _(spark, sf):
    return select.project(select.boxed(particles(spark, sf), BOX), "xp", "ok", "ln")


@query("q_bbox_xvp", f"SELECT ok, ln, x, y, z, vx, vy, vz FROM ({particles_sql()}) WHERE {box_sql()}")
def _(spark, sf):
    return select.project(select.boxed(particles(spark, sf), BOX), "xvp", "ok", "ln")


@query("q_bbox_halo", f"SELECT c_custkey, x, y, z, vx, vy, vz, npart FROM ({HALOS}) WHERE {box_sql()}")
def _(spark, sf):
    return select.project(select.boxed(halos(spark, sf), BOX), "xvh", "c_custkey")


_UNIT_BOX = [(-0.9, 0.9), (-0.8, 0.7), (-0.6, 0.9)]
_TILE = " CROSS JOIN ".join(f"(VALUES (CAST(-0.5 AS DOUBLE)), (CAST(0.5 AS DOUBLE))) t{c}(d{c})" for c in "xyz")
_TILED = f"SELECT ok, ln, x + dx AS x, y + dy AS y, z + dz AS z FROM ({particles_sql(1.0, 0.5)}) CROSS JOIN {_TILE}"
_R = "sqrt(x * x + y * y + z * z)"


@query("q_shell_tile8", f"SELECT ok, ln, round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z, round({_R}, 6) AS r FROM ({_TILED}) WHERE {box_sql(_UNIT_BOX)} AND {_R} > {num(0.3)} AND {_R} <= {num(0.7)}")
def _(spark, sf):
    rows = select.boxed(select.tiled(particles(spark, sf, 1.0, 0.5)), [*_UNIT_BOX, (0.3, 0.7)])
    return rows.select("ok", "ln", *[F.round(c, 9).alias(c) for c in "xyz"], F.round(select.radius(), 6).alias("r"))


_ASKED = (0.0, 0.1, 0.0625, 1.0, 2.99, 7.0)
_ASKED_SQL = ", ".join(f"({i}, {num(z)})" for i, z in enumerate(_ASKED))


@query("q_nearest_step", f"SELECT box, z_requested, step, z AS z_out FROM (SELECT *, row_number() OVER (PARTITION BY box ORDER BY abs(z - z_requested), step) AS rn FROM ({STEPS}) CROSS JOIN (VALUES {_ASKED_SQL}) a(box, z_requested)) WHERE rn = 1")
def _(spark, sf):
    return select.nearest_steps(spark, steps(spark, sf), _ASKED).select("box", "z_requested", "step", "z_out")


@query("q_lightcone_steps", f"SELECT * FROM (SELECT step, z, lag(z) OVER (ORDER BY step) AS z_before FROM ({STEPS})) WHERE step >= 1 AND z <= {num(2.0)}")
def _(spark, sf):
    return select.lightcone_steps(steps(spark, sf), 2.0).select("step", "z", "z_before")


_COSMOLOGY = Cosmology()


def distance_sql(c: Cosmology) -> str:
    """(x, y): redshifts and comoving distances, by Simpson sums over 10,000 logarithmic steps."""
    inverse = lambda z: f"1 / sqrt({num(c.omega_m)} * power(1 + {z}, 3) + {num(c.omega_r)} * power(1 + {z}, 4) + {num(c.omega_k)} * power(1 + {z}, 2) + {num(c.omega_l)})"
    step = f"(z - b) * ({inverse('z')} + {inverse('b')} + 4 * {inverse('((z + b) / 2)')}) / 6"
    grid_ = "SELECT z, coalesce(lag(z) OVER (ORDER BY z), 0) AS b FROM (SELECT power(CAST(10 AS DOUBLE), -5 + i * (log10(CAST(1100 AS DOUBLE)) + 5) / 9999) AS z FROM range(10000) r(i))"
    return f"SELECT z AS x, sum({step}) OVER (ORDER BY z) * {num(299792.458 / (100 * c.params['h']))} AS y FROM ({grid_})"


def lookup_sql(rows: str, column: str, points: str, out: str) -> str:
    """Linear interpolation between points (x, y); below the first and above the last the end holds."""
    t = f"SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1, first_value(y) OVER (ORDER BY x) AS least FROM ({points})"
    value = f"CASE WHEN t.x0 IS NULL THEN (SELECT min_by(y, x) FROM ({points})) WHEN t.x1 IS NULL THEN t.y0 ELSE t.y0 + (r.{column} - t.x0) * (t.y1 - t.y0) / (t.x1 - t.x0) END"
    return f"SELECT r.*, {value} AS {out} FROM ({rows}) r ASOF LEFT JOIN ({t}) t ON r.{column} >= t.x0"


@query("q_step_shells", f"SELECT step, z, round(chi / {num(1050)}, 6) AS r FROM ({lookup_sql(STEPS, 'z', distance_sql(_COSMOLOGY), 'chi')}) WHERE step >= 1")
def _(spark, sf):
    return steps(spark, sf).filter("step >= 1").select("step", "z", F.round(chi_of_z(F.col("z"), _COSMOLOGY) / 1050.0, 6).alias("r"))


_CHI = "SELECT c_custkey, CAST(c_custkey % 7000 AS DOUBLE) AS chi FROM customer"


@query("q_chi_to_z", f"SELECT c_custkey, round(z, 6) AS z FROM ({lookup_sql(_CHI, 'chi', f'SELECT y AS x, x AS y FROM ({distance_sql(_COSMOLOGY)})', 'z')})")
def _(spark, sf):
    rows = table(spark, sf, "customer").selectExpr("c_custkey", "CAST(c_custkey % 7000 AS DOUBLE) AS chi")
    return rows.select("c_custkey", F.round(z_of_chi(F.col("chi"), _COSMOLOGY), 6).alias("z"))


@query("q_distance_round_trip", f"SELECT step, z, true AS same FROM ({STEPS}) WHERE step < 24")
def _(spark, sf):
    rows = steps(spark, sf).filter("step < 24")
    back = z_of_chi(chi_of_z(F.col("z"), _COSMOLOGY), _COSMOLOGY)
    return rows.select("step", "z", (F.abs(back - F.col("z")) < 1e-9).alias("same"))


@query("q_halo_mass", f"SELECT c_custkey, npart, round(log10(npart * {num(2.775e20 * 0.3 * 1.05**3 / 1400**3)}), 8) AS log_mass FROM ({HALOS})")
def _(spark, sf):
    mass = select.halo_mass(F.col("npart"), 0.3, 1.05, 1400)
    return halos(spark, sf).select("c_custkey", "npart", F.round(F.log10(mass), 8).alias("log_mass"))


@query("q_particle_bounds", f"SELECT count(*) AS n, {', '.join(f'{f}({c}) AS {f}_{c}' for c in 'xyz' for f in ('min', 'max'))} FROM ({particles_sql()})")
def _(spark, sf):
    rows = particles(spark, sf)
    return rows.agg(F.count("*").alias("n"), *[g(c).alias(f"{f}_{c}") for c in "xyz" for f, g in (("min", F.min), ("max", F.max))])


@query("q_slab_ranks", f"SELECT CAST(least(greatest(floor(floor(y / {num(L)} * {num(N)}) / 5), 0), 2) AS INT) AS rank, count(*) AS n FROM ({particles_sql()}) GROUP BY 1")
def _(spark, sf):
    return particles(spark, sf).select(select.slab_rank(F.col("y"), L, N, 3).alias("rank")).groupBy("rank").agg(F.count("*").alias("n"))


@query("q_rescale", f"SELECT ok, ln, round(x * {num(1050 * (1 - 1e-6))}, 5) AS x FROM ({particles_sql(1.0)})")
def _(spark, sf):
    from orrery.plans.simulation import rescaled

    return rescaled(particles(spark, sf, 1.0), 1050.0).select("ok", "ln", F.round("x", 5).alias("x"))


@query("q_chunk_prefix", "SELECT chunk FROM (SELECT chunk, row_number() OVER (ORDER BY chunk) - 1 AS place FROM (SELECT n_nationkey AS chunk FROM nation WHERE n_nationkey <> 13)) WHERE chunk = place")
def _(spark, sf):
    return metadata.contiguous_prefix(table(spark, sf, "nation").filter("n_nationkey <> 13").select(F.col("n_nationkey").alias("chunk")))


# --- gridding ----------------------------------------------------------------------------------------------------------


def ngp_sql(n: int = N, rows: str | None = None, side: float = L) -> str:
    at = ", ".join(f"CAST(floor({c} / {num(side / n)}) AS INT) % {n} AS i{c}" for c in "xyz")
    return f"SELECT ix, iy, iz, CAST(count(*) AS DOUBLE) AS rho FROM (SELECT {at} FROM ({rows or particles_sql()})) GROUP BY 1, 2, 3"


def cic_sql(n: int = N) -> str:
    u = ", ".join(f"{c} / {num(L / n)} AS u{c}" for c in "xyz")
    parts = ", ".join(f"CAST(floor(u{c}) AS INT) AS low{c}, u{c} - floor(u{c}) AS d{c}" for c in "xyz")
    corners = " CROSS JOIN ".join(f"(VALUES (0), (1)) s{c}(s{c})" for c in "xyz")
    cells = ", ".join(f"(low{c} + s{c}) % {n} AS i{c}" for c in "xyz")
    weight = " * ".join(f"(CASE WHEN s{c} = 1 THEN d{c} ELSE 1 - d{c} END)" for c in "xyz")
    return f"SELECT ix, iy, iz, sum(w) AS rho FROM (SELECT {cells}, {weight} AS w FROM (SELECT {parts} FROM (SELECT {u} FROM ({particles_sql()}))) CROSS JOIN {corners}) GROUP BY 1, 2, 3"


@query("q_ngp_grid", ngp_sql())
def _(spark, sf):
    return grid.ngp(particles(spark, sf), N, L)


@query("q_cic_grid", f"SELECT ix, iy, iz, round(rho, 6) AS rho FROM ({cic_sql()})")
def _(spark, sf):
    return grid.cic(particles(spark, sf), N, L).withColumn("rho", F.round("rho", 6))


@query("q_weighted_grid", f"SELECT ix, iy, iz, round(sum(vx), 4) AS rho FROM (SELECT {', '.join(f'CAST(floor({c} / {num(L / N)}) AS INT) % {N} AS i{c}' for c in 'xyz')}, vx FROM ({particles_sql()})) GROUP BY 1, 2, 3")
def _(spark, sf):
    return grid.ngp(particles(spark, sf), N, L, F.col("vx")).withColumn("rho", F.round("rho", 4))


def stats_sql(cells: str, n: int = N) -> str:
    return (
        f"SELECT round(m, 8) AS mean_density, round(v, 6) AS density_variance, round(v / (m * m), 8) AS delta_variance, round(t / (m * {num(n**3)}), 8) AS theoretical_shot_noise_variance, round({num(n**3)} / t, 8) AS theoretical_variance "
        f"FROM (SELECT t, t / {num(n**3)} AS m, q / {num(n**3)} - (t / {num(n**3)}) * (t / {num(n**3)}) AS v FROM (SELECT sum(rho) AS t, sum(rho * rho) AS q FROM ({cells})))"
    )


@query("q_density_stats", stats_sql(ngp_sql()))
def _(spark, sf):
    s = grid.density_stats(grid.ngp(particles(spark, sf), N, L), N)
    return s.select(*[F.round(c, 6 if c == "density_variance" else 8).alias(c) for c in ("mean_density", "density_variance", "delta_variance", "theoretical_shot_noise_variance", "theoretical_variance")])


@query("q_stream_grid_equals_batch", ngp_sql())
def _(spark, sf):
    schema = table(spark, sf, "lineitem").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/lineitem.parquet*")
    rows = stream.selectExpr(*[f"{_spot(h, L)} AS {c}" for c, h in zip("xyz", (_X, _Y, _Z), strict=True)])
    return grid_to_table(rows, N, L, "ngp", f"{storage.shared_folder(spark)}/stream-{uuid.uuid4().hex}/grid")


# --- spectra -----------------------------------------------------------------------------------------------------------


def modes_sql(cells: str, n: int = N, correct: str | None = None, side: float = L) -> str:
    """(k, p) of the half space, by a separable transform in three steps."""
    along, up = spectrum.wave_numbers(n, side)
    turn = lambda a, b: f"{num(2 * np.pi / n)} * (({a} * {b}) % {n})"
    axis = lambda name, ks: f"(VALUES {', '.join(f'({i}, {num(k)})' for i, k in enumerate(ks))}) {name}(i{name}, k{name})"
    every = f"(SELECT range AS i FROM range({n}))"
    dense = f"SELECT a.i AS ix, b.i AS iy, c.i AS iz, coalesce(rho, 0) / (SELECT sum(rho) / {num(n**3)} FROM g) - 1 AS d FROM {every} a CROSS JOIN {every} b CROSS JOIN {every} c LEFT JOIN g ON g.ix = a.i AND g.iy = b.i AND g.iz = c.i"
    s1 = f"SELECT ix, iy, k.i AS kz, sum(d * cos({turn('iz', 'k.i')})) AS re, -sum(d * sin({turn('iz', 'k.i')})) AS im FROM dense CROSS JOIN (SELECT range AS i FROM range({n // 2 + 1})) k GROUP BY 1, 2, 3"

    def step(source: str, index: str, keep: str, out: str) -> str:
        t = turn(index, "k.i")
        return f"SELECT {keep}, k.i AS {out}, sum(re * cos({t}) + im * sin({t})) AS re, sum(im * cos({t}) - re * sin({t})) AS im FROM {source} CROSS JOIN {every} k GROUP BY ALL"

    w = "1"
    if correct:
        sinc = lambda k: f"(CASE WHEN {k} = 0 THEN 1 ELSE sin({k} * {num(side / n / 2)}) / ({k} * {num(side / n / 2)}) END)"
        one = " * ".join(sinc(k) for k in ("kx", "ky", "kz"))
        w = f"(power({one}, {4 if correct == 'cic' else 2}) + {num(1e-16)})"
    return (
        f"WITH g AS ({cells}), dense AS ({dense}), s1 AS ({s1}), s2 AS ({step('s1', 'ix', 'iy, kz', 'kx')}), s3 AS ({step('s2', 'iy', 'kx, kz', 'ky')}) "
        f"SELECT sqrt(kx * kx + ky * ky + kz * kz) AS k, (re * re + im * im) * {num(side**3 / n**6)} / {w} AS p "
        f"FROM (SELECT x.kx, y.ky, z.kz, re, im FROM s3 JOIN {axis('x', along)} ON x.ix = s3.kx JOIN {axis('y', along)} ON y.iy = s3.ky JOIN {axis('z', up)} ON z.iz = s3.kz)"
    )


def bins_sql(modes: str, edges) -> str:
    table_ = ", ".join(f"({i}, {num(a)}, {num(b)})" for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False), 1))
    return f"SELECT bin, avg(k) AS k, avg(p) AS p, count(*) AS n_modes FROM ({modes}) JOIN (VALUES {table_}) e(bin, lo, hi) ON k >= lo AND k < hi WHERE k > 0 GROUP BY bin"


def rounded_sql(bins: str) -> str:
    return f"SELECT bin, round(k, 6) AS k, round(p, 4) AS p, n_modes FROM ({bins})"


def rounded(df: DataFrame) -> DataFrame:
    return df.select("bin", F.round("k", 6).alias("k"), F.round("p", 4).alias("p"), "n_modes")


EDGES = [float(e) for e in spectrum.default_edges(N, L)]
OWN_EDGES = [0.1, 0.15, 0.2, 0.3, 0.4, 0.6]
_BINS = bins_sql(modes_sql(ngp_sql()), EDGES)


@query("q_pk_ngp", rounded_sql(_BINS))
def _(spark, sf):
    return rounded(spectrum.power_spectrum(particles(spark, sf), N, L, "ngp")[0])


@query("q_pk_cic", rounded_sql(bins_sql(modes_sql(cic_sql()), EDGES)))
def _(spark, sf):
    return rounded(spectrum.power_spectrum(particles(spark, sf), N, L, "cic")[0])


@query("q_pk_window", rounded_sql(bins_sql(modes_sql(ngp_sql(), correct="ngp"), EDGES)))
def _(spark, sf):
    return rounded(spectrum.power_spectrum(particles(spark, sf), N, L, "ngp", correct_window=True)[0])


@query("q_pk_window_cic", rounded_sql(bins_sql(modes_sql(cic_sql(), correct="cic"), EDGES)))
def _(spark, sf):
    return rounded(spectrum.power_spectrum(particles(spark, sf), N, L, "cic", correct_window=True)[0])


@query("q_pk_shot", f"SELECT bin, round(k, 6) AS k, round(p - {num(L**3)} / (SELECT count(*) FROM lineitem), 4) AS p, n_modes FROM ({_BINS})")
def _(spark, sf):
    return rounded(spectrum.power_spectrum(particles(spark, sf), N, L, "ngp", subtract_shot_noise=True)[0])


@query("q_pk_custom_bins", rounded_sql(bins_sql(modes_sql(ngp_sql()), OWN_EDGES)))
def _(spark, sf):
    return rounded(spectrum.power_spectrum(particles(spark, sf), N, L, "ngp", edges=OWN_EDGES)[0])


@query("q_pk_fine", rounded_sql(bins_sql(modes_sql(cic_sql(N_FINE), N_FINE), [float(e) for e in spectrum.default_edges(N_FINE, L)])))
def _(spark, sf):
    return rounded(spectrum.power_spectrum(particles(spark, sf), N_FINE, L, "cic")[0])


@query("q_modes", f"SELECT round(k, 6) AS k, round(p, 4) AS p FROM ({modes_sql(ngp_sql())}) WHERE k > 0")
def _(spark, sf):
    cells = grid.ngp(particles(spark, sf), N, L)
    along, up = spectrum.wave_numbers(N, L)
    pick = lambda ks, i: F.element_at(F.array(*[F.lit(float(k)) for k in ks]), F.col(i) + 1)
    x, y, z = pick(along, "kx"), pick(along, "ky"), pick(up, "kz")
    power = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) * F.lit(L**3 / N**6)
    rows = spectrum.modes(cells, N).select(F.sqrt(x * x + y * y + z * z).alias("k"), power.alias("p"))
    return rows.filter("k > 0").select(F.round("k", 6).alias("k"), F.round("p", 4).alias("p"))


@query("q_bin_modes", f"SELECT bin, round(avg(k), 6) AS k, round(avg(p), 4) AS p, count(*) AS n_modes FROM (SELECT l_quantity / {num(100)} AS k, l_extendedprice AS p FROM lineitem) JOIN (VALUES {', '.join(f'({i}, {num(a)}, {num(b)})' for i, (a, b) in enumerate(zip(OWN_EDGES, OWN_EDGES[1:], strict=False), 1))}) e(bin, lo, hi) ON k >= lo AND k < hi GROUP BY bin")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_quantity") / 100.0).alias("k"), F.col("l_extendedprice").alias("p"))
    return rounded(spectrum.bin_modes(rows, OWN_EDGES))


@query("q_default_k_bins", "SELECT CAST(i AS INT) AS edge, round(power(CAST(10 AS DOUBLE), log10(2 * pi() / 100) + i * (log10(pi() * 64 / 100) - log10(2 * pi() / 100)) / 32), 9) AS k FROM range(33) r(i)")
def _(spark, sf):
    return spark.createDataFrame([(i, float(e)) for i, e in enumerate(spectrum.default_edges(64, L))], "edge int, k double").select("edge", F.round("k", 9).alias("k"))


def _spectrum_table(spark, sf) -> DataFrame:
    return spectrum.power_spectrum(particles(spark, sf), N, L, "ngp")[0]


_LOW, _TOP, _CUT = spectrum.frequencies(N, L)


@query(
    "q_pk_analysis",
    f"SELECT round({num(_LOW)}, 8) AS k_fundamental, round({num(_TOP)}, 8) AS k_nyquist, round({num(_CUT)}, 8) AS k_cutoff, {num(L / N)} AS cell_size, count(*) AS total_bins, count(*) FILTER (WHERE k <= {num(_CUT)} AND n_modes > 100) AS valid_bins, "
    f"round(min(p), 4) AS min_power, round(max(p), 4) AS max_power, CAST(sum(n_modes) AS BIGINT) AS total_modes FROM ({_BINS})",
)
def _(spark, sf):
    out = spectrum.analysis(_spectrum_table(spark, sf), N, L)
    return out.select(*[F.round(c, 8).alias(c) for c in ("k_fundamental", "k_nyquist", "k_cutoff")], "cell_size", "total_bins", "valid_bins", F.round("min_power", 4).alias("min_power"), F.round("max_power", 4).alias("max_power"), "total_modes")


@query(
    "q_pk_validate",
    f"SELECT a AS positive_power, b AS monotonic_k, c AS positive_modes, d AS reasonable_range, a AND b AND c AND d AS all_passed FROM (SELECT bool_and(p > 0) AS a, bool_and(coalesce(k > before, true)) AS b, bool_and(n_modes >= 0) AS c, "
    f"min(p) > {num(1e-10)} AND max(p) < {num(1e10)} AS d FROM (SELECT *, lag(k) OVER (ORDER BY bin) AS before FROM ({_BINS})))",
)
def _(spark, sf):
    return spectrum.validation(_spectrum_table(spark, sf))


@query("q_pk_lines", f"SELECT bin, printf('%.6f', k) AS k_text, n_modes, CASE WHEN k <= {num(_CUT)} THEN 'valid' ELSE 'aliased' END AS status FROM ({_BINS})")
def _(spark, sf):
    parts = F.split("line", " ")
    return sinks.spectrum_lines(_spectrum_table(spark, sf), N, L).select("bin", parts[0].alias("k_text"), parts[2].cast("long").alias("n_modes"), parts[3].alias("status"))


# --- parameters --------------------------------------------------------------------------------------------------------

_FILES = (
    "n_nationkey, concat('achOutName = \"/run/', n_name, '\"\ndRedshiftLCP = ', CAST(n_nationkey AS {text}), '.25e0 # outer\ndBoxSize = 10', CAST(n_nationkey AS {text}), '\nnSteps = ', CASE WHEN n_nationkey % 2 = 0 THEN '[1, 2, 3]' ELSE '12.5' END, '\ndOmega0 = -.3\nh = 0.7\n', "
    "CASE WHEN n_nationkey % 7 = 3 THEN '' ELSE 'nGrid = 1400' END) AS value"
)


def _regex(key: str, form: str) -> str:
    return f"regexp_extract(value, '{key}\\s*=\\s*{form}', 1)"


_LIST = _regex("nSteps", r"\[([^\]]+)\]")


@query(
    "q_param_parse",
    f"SELECT n_nationkey, nullif({_regex('achOutName', chr(34) + '([^' + chr(34) + ']+)' + chr(34))}, '') AS namespace, CAST({_regex('dRedshiftLCP', r'([-+]?[0-9]*[.]?[0-9]+(?:[eE][-+]?[0-9]+)?)')} AS DOUBLE) AS zmax, CAST({_regex('dBoxSize', '([-+]?[0-9]+)')} AS BIGINT) AS boxsize, "
    f"CASE WHEN {_LIST} <> '' THEN CAST(list_sum(list_transform(string_split({_LIST}, ','), lambda x: CAST(trim(x) AS BIGINT))) AS BIGINT) ELSE CAST({_regex('nSteps', '([-+]?[0-9]+)')} AS BIGINT) END AS nsteps, coalesce(TRY_CAST(nullif({_regex('nGrid', '([-+]?[0-9]+)')}, '') AS BIGINT), -1) AS ngrid "
    f"FROM (SELECT {_FILES.format(text='VARCHAR')} FROM nation)",
)
def _(spark, sf):
    nation = table(spark, sf, "nation").selectExpr(*_split_alias(_FILES.format(text="STRING")))
    return metadata.parse_parameters(nation).select("n_nationkey", "namespace", "zmax", "boxsize", "nsteps", F.coalesce("ngrid", F.lit(-1).cast("long")).alias("ngrid"))


def _split_alias(text: str) -> list[str]:
    first, rest = text.split(", ", 1)
    return [first, rest]


#: Names of parameters by the number of a nation, and what category each must get.
_KINDS = {"h": "cosmological", "w0": "cosmological", "ombh2": "cosmological", "phi_model": "cosmological", "nodes": "slurm", "mail_user": "slurm", "jobname_template": "slurm", "nGrid": "simulation", "iLPT": "simulation", "dOmega0": "simulation", "seed": "simulation", "unknown": "other", "rundirs": "other"}
_NAME = f"list_extract(list_value({', '.join(repr(n) for n in _KINDS)}), n_nationkey % {len(_KINDS)} + 1)"
_KIND = f"list_extract(list_value({', '.join(repr(k) for k in _KINDS.values())}), n_nationkey % {len(_KINDS)} + 1)"


def _named(spark: SparkSession, sf: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(n) for n in _KINDS]), F.col("n_nationkey") % len(_KINDS) + 1)
    return table(spark, sf, "nation").select("n_nationkey", "n_regionkey", name.alias("name"))


@query("q_param_categories", f"SELECT n_nationkey, {_NAME} AS name, {_KIND} AS category FROM nation")
def _(spark, sf):
    return _named(spark, sf).select("n_nationkey", "name", presets.category(F.col("name")).alias("category"))


@query(
    "q_param_counts",
    f"SELECT n_regionkey, {', '.join(f"count(DISTINCT name) FILTER (WHERE category = '{k}') AS n_{k}" for k in ('cosmological', 'slurm', 'simulation', 'other'))}, count(DISTINCT name) AS total, "
    f"count(DISTINCT name) FILTER (WHERE category = 'cosmological') BETWEEN 1 AND count(DISTINCT name) - 1 AS valid FROM (SELECT n_regionkey, {_NAME} AS name, {_KIND} AS category FROM nation) GROUP BY 1",
)
def _(spark, sf):
    maps = _named(spark, sf).groupBy("n_regionkey").agg(F.map_from_entries(F.transform(F.collect_set("name"), lambda n: F.struct(n, F.lit("1")))).alias("params"))  # a few names
    return presets.separation(maps).drop("params").select("n_regionkey", *[F.col(f"n_{k}").cast("long").alias(f"n_{k}") for k in ("cosmological", "slurm", "simulation", "other")], F.col("total").cast("long").alias("total"), "valid")


@query(
    "q_param_merge",
    f"SELECT name, key, value FROM (SELECT name, CASE WHEN key = 'nGrid' THEN CAST(ordinal AS VARCHAR) WHEN key = 'seed' THEN '7' WHEN key = 'simname' THEN resolution WHEN key = 'cosmo' THEN cosmology WHEN key = 'nodes' AND resolution = 'S0-test' THEN '1' WHEN key = 'nodes' AND resolution = 'S0-validation' THEN '2' WHEN key = 'nodes' THEN '16' ELSE 'me@x' END AS value, key FROM ({VARIANTS}) CROSS JOIN (VALUES ('nGrid'), ('seed'), ('simname'), ('cosmo'), ('nodes'), ('email')) k(key))",
)
def _(spark, sf):
    base = F.create_map(F.lit("email"), F.lit("me@x"), F.lit("nodes"), F.lit("99"))
    out = campaign.run_parameters(variants(spark, sf), base, presets.preset_table(spark, presets.SIMULATIONS))
    return out.select("name", F.explode("params").alias("key", "value")).filter(F.col("key").isin("nGrid", "seed", "simname", "cosmo", "nodes", "email"))


@query("q_jobname", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'plain' WHEN n_nationkey % 4 = 1 THEN 'run_S0' ELSE concat('N', n_nationkey * 100, '-L', n_nationkey, '-4gpus') END AS job FROM nation")
def _(spark, sf):
    key = F.col("n_nationkey")
    template = F.when(key % 3 == 0, "plain").otherwise("N{nGrid}-L{dBoxSize}-{gpupern}gpus")
    return table(spark, sf, "nation").select("n_nationkey", presets.job_name(template, key * 100, key, F.when(key % 4 != 1, F.lit(4)), F.lit("S0")).alias("job"))


@query("q_node_scaling", f"SELECT n_nationkey, round({num(2)} * power(n_nationkey * {num(700)} / {num(1400)}, 3), 6) AS nodes FROM nation")
def _(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.round(presets.node_count(F.col("n_nationkey") * 700), 6).alias("nodes"))


_W = "CASE WHEN n_nationkey % 3 = 0 THEN NULL WHEN n_nationkey % 3 = 1 THEN CAST(-1 AS DOUBLE) ELSE CAST(-0.838 AS DOUBLE) END"
_WA = "CASE WHEN n_nationkey % 4 = 0 THEN CAST(-0.62 AS DOUBLE) WHEN n_nationkey % 4 = 1 THEN NULL ELSE CAST(0 AS DOUBLE) END"


@query(
    "q_wcdm_switch",
    f"SELECT n_nationkey, CASE WHEN e THEN CAST(0 AS DOUBLE) ELSE {num(0.69)} END AS lambda_, CASE WHEN e THEN {num(0.69)} ELSE CAST(0 AS DOUBLE) END AS dark FROM (SELECT n_nationkey, coalesce({_W} <> -1, false) OR coalesce({_WA} <> 0, false) AS e FROM nation)",
)
def _(spark, sf):
    a, b = presets.dark_energy(F.expr(_W), F.expr(_WA), F.lit(0.69))
    return table(spark, sf, "nation").select("n_nationkey", a.alias("lambda_"), b.alias("dark"))


_DENSITIES = ", ".join(f"('{n}', {v})" for n, v in {
    "desi-dr2-planck-act-mnufree": "(0.022597077 + 0.11788858) / power(0.68906658, 2)", "euclid-flagship": "0.32", "planck18": "(0.02237 + 0.12) / power(0.6736, 2)",
    "lcdm": "(0.022597077 + 0.11788858) / power(0.68906658, 2)", "wcdm": "(0.022597077 + 0.11788858) / power(0.68906658, 2)", "phicdm": "(0.022597077 + 0.11788858) / power(0.68906658, 2)",
}.items())


@query("q_omegas", f"SELECT name, round(CAST(om AS DOUBLE), 8) AS omega_m FROM (VALUES {_DENSITIES}) t(name, om)")
def _(spark, sf):
    rows = [(n, *[float(presets.cosmology(n)[k]) for k in ("ombh2", "omch2", "h")]) for n in presets.COSMOLOGIES]
    df = spark.createDataFrame(rows, "name string, ombh2 double, omch2 double, h double")
    return df.select("name", F.round((F.col("ombh2") + F.col("omch2")) / (F.col("h") * F.col("h")), 8).alias("omega_m"))


@query("q_redshift_list", f"SELECT concat('[', string_agg(printf('%.4f', z), ', ' ORDER BY z DESC), ']') AS targets, concat('[', string_agg('1', ', '), ']') AS steps FROM (SELECT DISTINCT z FROM ({STEPS}))")
def _(spark, sf):
    rows = steps(spark, sf)
    targets, ones = presets.redshift_list(F.collect_set("z"))  # a log of output times
    return rows.agg(targets.alias("targets"), ones.alias("steps"))


@query("q_presets", "SELECT * FROM (VALUES ('S0-test', 525, 700, 1, '12:00:00'), ('S0-validation', 1050, 1400, 2, '48:00:00'), ('S0-scaling', 2100, 2800, 16, '48:00:00'), ('S0-production', 5250, 7000, 250, '48:00:00')) t(name, box, grid, nodes, tlimit)")
def _(spark, sf):
    p = F.col("params")
    return presets.preset_table(spark, presets.SIMULATIONS).select("name", *[p[k].cast("int").alias(a) for k, a in (("dBoxSize", "box"), ("nGrid", "grid"), ("nodes", "nodes"))], p["tlimit"].alias("tlimit"))


# --- campaigns ---------------------------------------------------------------------------------------------------------

_READY = f"SELECT * FROM ({WITH_STATUS}) v WHERE status = 'not_submitted' AND (submission_deadline IS NULL OR {NOW} <= submission_deadline) AND (needs IS NULL OR EXISTS (SELECT 1 FROM ({WITH_STATUS}) d WHERE d.ordinal = v.needs AND d.status = 'completed'))"


@query("q_submittable", f"SELECT ordinal, name, priority FROM ({_READY})")
def _(spark, sf):
    return campaign.submittable(variants(spark, sf), states(spark, sf), F.expr(NOW)).select("ordinal", "name", "priority")


@query("q_submit_cap", f"SELECT name, priority FROM ({_READY}) QUALIFY row_number() OVER (ORDER BY priority DESC, ordinal) <= 2")
def _(spark, sf):
    ready = campaign.submittable(variants(spark, sf), states(spark, sf), F.expr(NOW))
    running = campaign.running_jobs(states(spark, sf)).first()[0]
    return campaign.to_submit(ready, running, running + 2, 3).select("name", "priority")


@query("q_variant_filter", f"SELECT ordinal, name, status FROM ({WITH_STATUS}) WHERE status = 'not_submitted'")
def _(spark, sf):
    return campaign.of_status(variants(spark, sf), states(spark, sf), "not_submitted").select("ordinal", "name", "status")


@query("q_campaign_summary", f"SELECT (SELECT count(*) FROM nation) AS total_variants, {', '.join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in campaign.STATUSES)}, round(count(*) FILTER (WHERE status = 'completed') / (SELECT count(*) FROM nation), 6) AS completion_rate FROM ({STATES})")
def _(spark, sf):
    return campaign.summary(variants(spark, sf), states(spark, sf)).withColumn("completion_rate", F.round("completion_rate", 6))


_PAD = lambda c, n: f"rpad({c}, CAST(greatest(length({c}), {n}) AS INT), ' ')"


@query("q_report_rows", f"SELECT CAST(row_number() OVER (ORDER BY priority DESC, ordinal) AS INT) AS place, concat_ws(' ', {_PAD('name', 20)}, {_PAD('cosmology', 15)}, {_PAD('resolution', 15)}, {_PAD('status', 12)}, {_PAD('CAST(priority AS VARCHAR)', 8)}, {_PAD("coalesce(job_id, 'N/A')", 12)}) AS line FROM ({WITH_STATUS})")
def _(spark, sf):
    return campaign.report_rows(variants(spark, sf), states(spark, sf))


_CODE = "CASE CAST(job_id AS INT) % 4 WHEN 1 THEN 'R' WHEN 3 THEN 'TIMEOUT' ELSE 'XX' END"


@query("q_queue_status", f"SELECT name, CASE WHEN job_id IS NULL THEN status WHEN CAST(job_id AS INT) % 4 = 1 THEN 'running' WHEN CAST(job_id AS INT) % 4 = 3 THEN 'failed' ELSE status END AS status FROM ({STATES})")
def _(spark, sf):
    rows = states(spark, sf)
    queue = rows.filter("job_id IS NOT NULL").select("job_id", F.expr(_CODE).alias("code"))
    return campaign.from_queue(rows, queue).select("name", "status")


@query("q_variant_problems", "SELECT name, 'duplicate name' AS problem FROM (SELECT r_name AS name FROM nation JOIN region ON r_regionkey = n_regionkey) GROUP BY name HAVING count(*) > 1")
def _(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    rows = nation.join(region, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("name"), F.lit("lcdm").alias("cosmology"), F.lit("S0-test").alias("resolution"))
    return campaign.problems(rows)


@query("q_state_json", f"SELECT name, status, job_id FROM ({STATES})")
def _(spark, sf):
    rows = states(spark, sf).groupBy().agg(F.map_from_entries(F.collect_list(F.struct("name", "status"))).alias("simulation_status"), F.map_from_entries(F.collect_list(F.struct("name", "job_id"))).alias("job_ids"))  # a campaign's few variants
    text = rows.select(F.to_json(F.struct("simulation_status", "job_ids"), {"ignoreNullFields": "false"}).alias("value"))
    return metadata.explode_state(text.select(F.from_json("value", metadata.STATE).alias("s")).select("s.*"))
