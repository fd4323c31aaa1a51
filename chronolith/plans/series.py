"""Queries of the scalar expressions, series operators and descriptors, over recordings derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.functions import labels as L
from chronolith.operators import series as S
from chronolith.plans.registry import query
from chronolith.sources import demo

DAY = 86_400_000_000


def r(column, digits: int = 6):
    return F.round(column, digits)


KIND_SQL = """CASE WHEN label IS NULL THEN 'unknown' WHEN label = 0 THEN 'normal' WHEN label >= 1 AND label < 100 THEN 'steady'
 WHEN label >= 101 AND label < 200 THEN 'transient' ELSE 'unknown' END"""


@query("e1_labels", demo.with_samples(f"""
SELECT rid, series, {KIND_SQL} AS kind,
 CASE WHEN label BETWEEN 1 AND 99 THEN label WHEN label BETWEEN 101 AND 199 THEN label - 100 END AS fault_no,
 CASE WHEN label IS NULL THEN 'Unknown' WHEN label = 0 THEN 'Normal Operation'
  WHEN label % 100 = 2 THEN 'Failure' ELSE 'Class ' || (label % 100) END || CASE WHEN label > 100 THEN ' - Transient' ELSE '' END AS name,
 CASE WHEN label = 0 THEN 0 WHEN label BETWEEN 1 AND 99 THEN 2 WHEN label > 100 THEN 1 ELSE 3 END AS period,
 coalesce(label, -1) AS code FROM samples"""))
def e1_labels(spark, sf):
    x = demo.samples(spark, sf)
    label = F.col("label")
    return x.select("rid", "series", L.label_kind(label).alias("kind"), L.label_fault(label).alias("fault_no"), L.label_name(label, {2: "Failure"}).alias("name"), L.period_code(label).alias("period"), L.label_code(label).alias("code"))


@query("e7_plausible", demo.with_samples("""
SELECT entity, count(raw) FILTER (raw < 0 OR raw > 100) AS n_implausible, round(min(raw) FILTER (raw BETWEEN 0 AND 100), 6) AS low,
 round(max(raw) FILTER (raw BETWEEN 0 AND 100), 6) AS high, bool_or(raw < 0 OR raw > 100) AS outside,
 coalesce(max(raw) - min(raw) <= 1e-4 * greatest(abs((max(raw) + min(raw)) / 2), 1.0), false) AS flat,
 CASE WHEN count(value) = 0 OR count(value) < 0.5 * count(*) THEN 0
   WHEN max(value) - min(value) <= 1e-4 * greatest(abs((max(value) + min(value)) / 2), 1.0) THEN 1 ELSE 2 END AS state FROM samples GROUP BY entity"""))
def e7_plausible(spark, sf):
    x = demo.samples(spark, sf)
    low, high = L.bounds(F.lit("%"))
    ok = L.plausible(F.col("raw"), low, high)
    out = x.groupBy("entity").agg(F.count_if(F.col("raw").isNotNull() & ok.isNull()).alias("n_implausible"), F.min(ok).alias("low"), F.max(ok).alias("high"), F.min("raw").alias("a"), F.max("raw").alias("b"), F.count("value").alias("n"), F.count(F.lit(1)).alias("total"), F.min("value").alias("va"), F.max("value").alias("vb"))
    return out.select("entity", "n_implausible", r("low").alias("low"), r("high").alias("high"), L.outside_range(F.col("a"), F.col("b"), low, high).alias("outside"), L.is_flat(F.col("a"), F.col("b")).alias("flat"), L.sensor_state(F.col("n"), F.col("total"), F.col("va"), F.col("vb"), F.lit(False), 0.5).alias("state"))


@query("e18_z_scores", demo.with_samples("""
SELECT rid, series, round(CASE WHEN value IS NULL THEN NULL WHEN max(value) OVER w = min(value) OVER w THEN 0
 ELSE (value - avg(value) OVER w) / stddev_pop(value) OVER w END, 6) AS z,
 round((us - min(us) OVER w) / 3.6e9, 6) AS hours FROM samples WHERE label IS NOT NULL WINDOW w AS (PARTITION BY series)"""))
def e18_z_scores(spark, sf):
    from pyspark.sql import Window

    x = S.z_score(demo.samples(spark, sf).where("label is not null"))
    hours = L.relative_hours(F.col("us"), F.min("us").over(Window.partitionBy("series")))
    return x.select("rid", "series", r("z").alias("z"), r(hours).alias("hours"))


@query("e14_scoped_slice", demo.with_samples("""
SELECT series, fault, count(*) AS n, round(sum(value) * 1e-6, 9) AS total FROM samples
WHERE fault IN (1, 2) AND us BETWEEN 1704844800000000 AND 1705708800000000 GROUP BY series, fault"""))
def e14_scoped_slice(spark, sf):
    x = demo.samples(spark, sf).where(F.col("fault").isin(1, 2) & F.col("us").between(1704844800000000, 1705708800000000))
    return x.groupBy("series", "fault").agg(F.count(F.lit(1)).alias("n"), r(F.sum(L.shown(F.col("value"), F.lit("Pa"))), 9).alias("total"))


@query("q1_sampling_step", demo.with_samples("""
SELECT series, coalesce(quantile_cont(gap, 0.5) FILTER (gap > 0), 1000000)::DOUBLE AS step_us FROM
 (SELECT series, us - lag(us) OVER (PARTITION BY series ORDER BY us, rid) AS gap FROM samples) GROUP BY series"""))
def q1_sampling_step(spark, sf):
    return S.sampling_step(demo.samples(spark, sf))


KINDS = """, d AS (SELECT *, value - lag(value) OVER w AS d, 1e-6 * greatest(max(abs(value)) OVER (PARTITION BY series), 1e-12) AS tol,
  count(value) OVER (PARTITION BY series) AS n FROM samples WINDOW w AS (PARTITION BY series ORDER BY us, rid)),
d2 AS (SELECT *, lead(d) OVER (PARTITION BY series ORDER BY us, rid) AS nx FROM d),
kinds AS (SELECT *, CASE WHEN value IS NULL THEN -1 WHEN n < 2 THEN 0 WHEN abs(d) <= tol THEN 2
  WHEN abs(nx - d) <= tol AND NOT coalesce(abs(nx) <= tol, false) THEN 1 ELSE 0 END AS kind FROM d2)
"""


@query("q2_sample_kinds", demo.with_samples(KINDS + "SELECT series, rid, kind FROM kinds"))
def q2_sample_kinds(spark, sf):
    return S.sample_kinds(demo.samples(spark, sf)).select("series", "rid", "kind")


@query("q3_sampling", demo.with_samples(KINDS + """, st AS (SELECT series, coalesce(quantile_cont(gap, 0.5) FILTER (gap > 0), 1000000) AS step_us FROM
 (SELECT series, us - lag(us) OVER (PARTITION BY series ORDER BY us, rid) AS gap FROM samples) GROUP BY series),
c AS (SELECT series, count(*) FILTER (kind <> -1) AS n_valid, count(*) FILTER (kind = 0) AS n_genuine, count(*) FILTER (kind = 1) AS n_interpolated,
 count(*) FILTER (kind = 2) AS n_held, max(i) FILTER (kind = 0) - min(i) FILTER (kind = 0) AS span FROM
 (SELECT *, row_number() OVER (PARTITION BY series ORDER BY us, rid) AS i FROM kinds) GROUP BY series)
SELECT series, n_valid, n_genuine, n_interpolated, n_held, round(CASE WHEN n_genuine > 1 THEN span * step_us / 1e6 / (n_genuine - 1) END, 4) AS spacing_s,
 round(CASE WHEN n_valid > 0 THEN n_genuine / n_valid ELSE 0 END, 6) AS genuine_share,
 round(CASE WHEN n_valid > 0 THEN (n_interpolated + n_held) / n_valid ELSE 0 END, 6) AS filled_share, n_interpolated + n_held AS n_filled FROM c JOIN st USING (series)"""))
def q3_sampling(spark, sf):
    x = demo.samples(spark, sf)
    out = S.sampling_summary(S.sample_kinds(x), S.sampling_step(x))
    return out.withColumns({"spacing_s": r("spacing_s", 4), "genuine_share": r("genuine_share"), "filled_share": r("filled_share")})


GRID = f""", f AS (SELECT series, min(us) AS a, max(us) AS b FROM samples GROUP BY series),
cells AS (SELECT series, unnest(range(0, (b - a) // {DAY} + 1)) AS cell FROM f),
v AS (SELECT series, (us - a) // {DAY} AS cell, max_by(value, (us, rid)) AS value0, arg_max_null(value, struct_pack(u := us, r := rid)) AS value FROM samples JOIN f USING (series) GROUP BY ALL),
grid AS (SELECT series, cell, value FROM cells LEFT JOIN v USING (series, cell))
"""
GRID = GRID.replace("max_by(value, (us, rid)) AS value0, ", "")


@query("q5_grid_filled", demo.with_samples(GRID + """, k AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN cell END IGNORE NULLS) OVER w AS ax, last_value(value IGNORE NULLS) OVER w AS ay,
 first_value(CASE WHEN value IS NOT NULL THEN cell END IGNORE NULLS) OVER u AS bx, first_value(value IGNORE NULLS) OVER u AS b_y FROM grid
 WINDOW w AS (PARTITION BY series ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), u AS (PARTITION BY series ORDER BY cell ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT series, cell, value, round(coalesce(value, CASE WHEN bx > ax THEN ay + (b_y - ay) * (cell - ax) / (bx - ax) END, ay, b_y), 6) AS filled FROM k"""))
def q5_grid_filled(spark, sf):
    return S.fill_linear(S.uniform_grid(demo.samples(spark, sf), DAY)).withColumn("filled", r("filled"))


@query("q7_detrended", demo.with_samples(""", m AS (SELECT series, rid, raw, us / 3.6e9 AS h FROM samples),
c AS (SELECT *, h - avg(h) OVER w AS dx, raw - avg(raw) OVER w AS dy FROM m WINDOW w AS (PARTITION BY series))
SELECT series, rid, round(dy - CASE WHEN sum(dx * dx) OVER w > 0 THEN sum(dx * dy) OVER w / sum(dx * dx) OVER w ELSE 0 END * dx, 4) AS rest FROM c WINDOW w AS (PARTITION BY series)"""))
def q7_detrended(spark, sf):
    x = demo.samples(spark, sf).withColumn("h", F.col("us") / 3.6e9)
    return S.detrend(x, "raw", "h").select("series", "rid", r("rest", 4).alias("rest"))


@query("q8_prepared", demo.with_samples("""
SELECT series, count(*) AS n, count(value) AS n_valid, count(*) >= 12 AND count(value) >= 12 AND count(value) >= 0.5 * count(*)
 AND NOT coalesce(max(value) - min(value) <= 1e-4 * greatest(abs((max(value) + min(value)) / 2), 1.0), true) AS ok FROM samples GROUP BY series"""))
def q8_prepared(spark, sf):
    return S.prepared(demo.samples(spark, sf), 12)


@query("q9_filled_edges", demo.with_samples("""
SELECT series, rid, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY us, rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 first_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY us, rid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM samples"""))
def q9_filled_edges(spark, sf):
    return S.fill_edges(demo.samples(spark, sf)).select("series", "rid", "filled")


@query("q10_even_stride", """SELECT user_id AS entity, event_id AS rid FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
 count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE i % ceil(n / 10.0)::BIGINT = 0""")
def q10_even_stride(spark, sf):
    return S.even_stride(demo.events(spark, sf), 10, 1, ("entity",), 10).select("entity", "rid")


@query("q12_decimated", """WITH e AS (SELECT user_id AS entity, event_id, value, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT entity, ((i + 1) * least(40, n) - 1) // n AS block, avg(value) AS v FROM e WHERE n >= 32 GROUP BY ALL)
SELECT entity, block, round((v - avg(v) OVER w) / stddev_pop(v) OVER w, 6) AS z FROM b WINDOW w AS (PARTITION BY entity)""")
def q12_decimated(spark, sf):
    x = S.decimate(demo.events(spark, sf).withColumnRenamed("raw", "value"), 40, by=("entity",))
    return x.withColumn("z", r("z"))


SNR = """SELECT series, CASE WHEN n >= 3 AND e > 0 THEN v / e WHEN n >= 3 AND v > 0 THEN 'inf'::DOUBLE END AS snr FROM
 (SELECT series, count(*) AS n, var_pop(value) AS v, avg(d * d) / 2 AS e FROM (SELECT series, value, value - lag(value) OVER (PARTITION BY series ORDER BY us, rid) AS d
  FROM samples WHERE value IS NOT NULL) GROUP BY series)"""


@query("f5_signal_to_noise", demo.with_samples(f", s AS ({SNR}) SELECT series, round(snr, 6) AS snr FROM s"))
def f5_signal_to_noise(spark, sf):
    return S.signal_to_noise(demo.samples(spark, sf)).withColumn("snr", r("snr"))


def moments_sql(source: str, by: str = "series", value: str = "value", digits: int = 8, shift: float = 0.0) -> str:
    """The moments of value by `by`; shift moves shapes off ties of the rounding, where the last bit of a double would decide."""
    return f"""SELECT {by}, n, round(CASE WHEN low = high THEN low ELSE m END, 6) AS mean, round(CASE WHEN low = high THEN 0 ELSE s END, 6) AS std,
 round(CASE WHEN low < high AND n >= 8 THEN m3 / (s * s * s) END + {shift}, {digits}) AS skew, round(CASE WHEN low < high AND n >= 8 THEN m4 / (s * s * s * s) - 3 END + {shift}, {digits}) AS kurtosis,
 round(q[1], 6) AS q05, round(q[2], 6) AS q25, round(q[3], 6) AS median, round(q[4], 6) AS q75, round(q[5], 6) AS q95, low, high FROM
 (SELECT {by}, count({value}) AS n, avg({value}) AS m, stddev_pop({value}) AS s, avg(power({value} - c, 3)) AS m3, avg(power({value} - c, 4)) AS m4,
  quantile_cont({value}, [0.05, 0.25, 0.5, 0.75, 0.95]) AS q, min({value}) AS low, max({value}) AS high
  FROM (SELECT *, avg({value}) OVER (PARTITION BY {by}) AS c FROM {source}) GROUP BY {by})"""


def rounded_moments(df):
    return df.withColumns({**{c: r(c) for c in ("mean", "std", "q05", "q25", "median", "q75", "q95")}, "skew": r("skew", 8), "kurtosis": r("kurtosis", 8)})


@query("f1_moments", demo.with_samples(moments_sql("samples")))
def f1_moments(spark, sf):
    return rounded_moments(S.moments(demo.samples(spark, sf)))


@query("f8_statistics_table", f"WITH {demo.SQL}{KINDS}, g AS (SELECT entity, value AS v FROM kinds WHERE kind = 0) {moments_sql('g', 'entity', 'v')}")
def f8_statistics_table(spark, sf):
    x = S.sample_kinds(demo.samples(spark, sf)).where("kind = 0").withColumn("value", L.shown(F.col("value"), F.lit("%")))
    return rounded_moments(S.moments(x, by=("entity",)))


def acf_sql(source: str, by: str, value: str, step: str, longest_s: float) -> str:
    """Common tables acf (by, lag, rho, step_us), and half (by, acf_half_s) of the readings of source; step has by, step_us."""
    return f"""acv AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY us, rid) - 1 AS i, avg({value}) OVER w AS m, count(*) OVER w AS n FROM {source} JOIN {step} USING ({by}) WHERE {value} IS NOT NULL
 WINDOW w AS (PARTITION BY {by}) QUALIFY min({value}) OVER w < max({value}) OVER w),
acs AS (SELECT a.{by}, a.step_us, b.i - a.i AS lag, sum((a.{value} - a.m) * (b.{value} - b.m)) AS s FROM acv a JOIN acv b ON a.{by} = b.{by}
 AND b.i BETWEEN a.i AND a.i + least(greatest(1, floor({longest_s} * 1e6 / a.step_us)), a.n - 1) GROUP BY ALL),
acf AS (SELECT {by}, step_us, lag, s / first_value(s) OVER w AS rho, lag(s) OVER w / first_value(s) OVER w AS bef FROM acs WINDOW w AS (PARTITION BY {by} ORDER BY lag)),
half AS (SELECT {by}, coalesce(arg_min((lag - 1 + (bef - 0.5) / (bef - rho)) * step_us / 1e6, lag) FILTER (lag > 0 AND rho <= 0.5), 'inf'::DOUBLE) AS acf_half_s FROM acf GROUP BY {by})
"""


def horner(k: tuple[float, ...], x: str) -> str:
    out = repr(k[0])
    for v in k[1:]:
        out = f"({out} * {x} + {v!r})"
    return out


def normality_sql(source: str, by: str, value: str) -> str:
    """Common table fit (by, slope, offset, scatter, gaussian) of the readings of source."""
    ratio = lambda k, x: f"{horner(k[0], x)} / {horner(k[1], x)}"
    return f"""gv AS (SELECT {by}, {value} AS v FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY us, rid) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS a FROM {source} WHERE {value} IS NOT NULL) WHERE i % ceil(a / 50000.0)::BIGINT = 0),
gd AS (SELECT {by}, count(*) OVER w AS n, power((v - avg(v) OVER w) / stddev_pop(v) OVER w, 2) AS d FROM gv WINDOW w AS (PARTITION BY {by}) QUALIFY count(*) OVER w >= 8 AND min(v) OVER w < max(v) OVER w),
gp AS (SELECT *, (1 + (row_number() OVER (PARTITION BY {by} ORDER BY d) - 0.5) / n) / 2 AS p FROM gd),
gq AS (SELECT *, sqrt(-2 * ln(1 - p)) AS t, (p - 0.5) * (p - 0.5) AS r FROM gp),
gf AS (SELECT {by}, n, d, power(CASE WHEN p > 1 - 0.02425 THEN -{ratio(L.TAIL, "t")} ELSE {ratio(L.MIDDLE, "r")} * (p - 0.5) END, 2) * (n + 1) / n AS f FROM gq),
gr AS (SELECT {by}, count(*) AS n, regr_slope(f, d) AS slope, regr_intercept(f, d) AS a, avg(f) AS f, regr_syy(f, d) AS syy, regr_sxy(f, d) AS sxy, regr_sxx(f, d) AS sxx FROM gf GROUP BY {by}),
fit AS (SELECT *, scatter < 0.15 AND abs("offset") <= 0.05 AND abs(slope - 1) <= 0.2 AS gaussian FROM (SELECT {by}, slope, a / f AS "offset", sqrt(greatest(0, syy - sxy * sxy / sxx) / greatest(n - 2, 1)) / f AS scatter FROM gr WHERE sxx > 0))
"""


def step_sql(source: str, by: str) -> str:
    return f"""SELECT {by}, coalesce(quantile_cont(gap, 0.5) FILTER (gap > 0), 1000000)::DOUBLE AS step_us FROM (SELECT {by}, us - lag(us) OVER (PARTITION BY {by} ORDER BY us, rid) AS gap FROM {source}) GROUP BY {by}"""


def acf_rows(spark, sf):
    x = demo.events(spark, sf).withColumnRenamed("raw", "value")
    return x, S.sampling_step(x, ("entity",))


ACF_SQL = f", st AS ({step_sql('ev', 'entity')}), " + acf_sql("ev", "entity", "raw", "st", 1e7)


@query("f3_autocorrelation", demo.with_samples(ACF_SQL + "SELECT entity, lag, round(rho, 6) AS rho FROM acf"))
def f3_autocorrelation(spark, sf):
    x, step = acf_rows(spark, sf)
    return S.autocorrelation(x, step, by=("entity",), longest_s=1e7).select("entity", "lag", r("rho").alias("rho"))


@query("f4_acf_half", demo.with_samples(ACF_SQL + "SELECT entity, round(acf_half_s, 3) AS acf_half_s FROM (SELECT DISTINCT entity FROM ev) LEFT JOIN half USING (entity)"))
def f4_acf_half(spark, sf):
    x, step = acf_rows(spark, sf)
    return S.autocorrelation_half(x, step, by=("entity",), longest_s=1e7).withColumn("acf_half_s", r("acf_half_s", 3))


NORMAL_OUT = """round(slope, 6) AS slope, round("offset", 6) AS "offset", round(scatter, 6) AS scatter, gaussian"""


@query("f6_gaussianity", demo.with_samples(", " + normality_sql("ev", "entity", "raw") + f"SELECT entity, {NORMAL_OUT} FROM fit"))
def f6_gaussianity(spark, sf):
    x = S.gaussianity(demo.events(spark, sf), "raw", ("entity",))
    return x.withColumns({c: r(c) for c in ("slope", "offset", "scatter")})


def described_sql(name: str, source: str, step: str, digits: int = 8, shift: float = 0.0) -> str:
    """Common table `name`: the descriptors of samples.value by series in source, whose steps stand in step."""
    snr = SNR.replace("FROM samples", f"FROM {source}")
    return f"""{name} AS (WITH mo AS ({moments_sql(source, digits=digits, shift=shift)}), sn AS ({snr}), {acf_sql(source, "series", "value", step, 21600.0)}, {normality_sql(source, "series", "value")}
 SELECT mo.*, round(snr + {shift}, {digits}) AS snr, round(acf_half_s, 6) AS acf_half_s, {NORMAL_OUT} FROM mo LEFT JOIN sn USING (series) LEFT JOIN (SELECT series, half.acf_half_s FROM {step} LEFT JOIN half USING (series)) USING (series) LEFT JOIN fit USING (series))
"""


PROFILE_SQL = KINDS + f""", st AS ({step_sql("samples", "series")}),
co AS (SELECT series, count(*) FILTER (kind <> -1) AS n_valid, count(*) FILTER (kind = 0) AS n_genuine, count(*) FILTER (kind = 1) AS n_interpolated,
 count(*) FILTER (kind = 2) AS n_held, max(i) FILTER (kind = 0) - min(i) FILTER (kind = 0) AS span FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY us, rid) AS i FROM kinds) GROUP BY series),
su AS (SELECT *, CASE WHEN n_genuine > 1 THEN span * step_us / 1e6 / (n_genuine - 1) END AS spacing FROM co JOIN st USING (series)),
gs AS (SELECT series, spacing * 1e6 AS step_us FROM su WHERE spacing > 0), gx AS (SELECT series, us, rid, value FROM kinds WHERE kind = 0), ax AS (SELECT series, us, rid, value FROM samples),
""" + described_sql("da", "ax", "st") + ", " + described_sql("dg", "gx", "gs")
GENUINE_COLUMNS = ("n", "mean", "std", "skew", "kurtosis", "q05", "q25", "median", "q75", "q95", "low", "high", "snr", "acf_half_s", "slope", "offset", "scatter", "gaussian")


@query("f9_profiles", demo.with_samples(PROFILE_SQL + """SELECT 0::BIGINT AS n_implausible, n_valid, n_genuine, n_interpolated, n_held, n_interpolated + n_held AS n_filled, round(spacing, 4) AS spacing_s,
 round(CASE WHEN n_valid > 0 THEN n_genuine / n_valid ELSE 0 END, 6) AS genuine_share, round(CASE WHEN n_valid > 0 THEN (n_interpolated + n_held) / n_valid ELSE 0 END, 6) AS filled_share, da.*, """
 + ", ".join(f'dg."{c}" AS g_{c}' for c in GENUINE_COLUMNS) + " FROM su JOIN da USING (series) LEFT JOIN dg USING (series)"))
def f9_profiles(spark, sf):
    out = S.profile(demo.samples(spark, sf), 0.0, 1000.0)
    for g in ("", "g_"):
        digits = {c: 6 for c in ("mean", "std", "q05", "q25", "median", "q75", "q95", "slope", "offset", "scatter")} | {"skew": 8, "kurtosis": 8, "snr": 8, "acf_half_s": 6}
        out = out.withColumns({g + c: r(g + c, d) for c, d in digits.items()})
    return out.withColumns({"spacing_s": r("spacing_s", 4), "genuine_share": r("genuine_share"), "filled_share": r("filled_share")})


@query("f13_problem_counts", demo.with_samples("""
SELECT fault, count(DISTINCT series) AS n_series, count(DISTINCT series) FILTER (raw > 200) AS n_implausible, count(*) FILTER (raw > 200) AS readings FROM samples GROUP BY fault"""))
def f13_problem_counts(spark, sf):
    x = demo.samples(spark, sf)
    odd = L.plausible(F.col("raw"), F.lit(0.0), F.lit(200.0)).isNull()
    return x.groupBy("fault").agg(F.count_distinct("series").alias("n_series"), F.count_distinct(F.when(odd, F.col("series"))).alias("n_implausible"), F.count_if(odd).alias("readings"))
