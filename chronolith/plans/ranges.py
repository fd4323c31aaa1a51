"""Queries of scans in ranges: the events of a fifth of all entities are one series, five series in all, none in one task."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.operators import segments as G
from chronolith.plans.registry import query
from chronolith.plans.series import r
from chronolith.sources import demo

LONG_SQL = """, x AS (SELECT entity % 5 AS series, us, rid, code AS label, CASE WHEN rid % 11 <> 0 THEN floor(raw / 5) * 5.0 END AS value, raw, event_type FROM ev)
"""


def long_series(spark, sf):
    value = F.when(F.col("rid") % 11 != 0, F.floor(F.col("raw") / 5) * 5.0)
    return demo.events(spark, sf).select((F.col("entity") % 5).alias("series"), "us", "rid", F.col("code").alias("label"), value.alias("value"), "raw", "event_type")


@query("r1_runs_in_ranges", demo.with_samples(LONG_SQL + """, c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR label <> lag(label) OVER w THEN 1 ELSE 0 END AS ch FROM x WINDOW w AS (PARTITION BY series ORDER BY us, rid)),
g AS (SELECT *, sum(ch) OVER (PARTITION BY series ORDER BY us, rid) AS run FROM c)
SELECT series, run::BIGINT AS run, min(us) AS start, max(us) AS last, any_value(label) AS value, count(*) AS n FROM g GROUP BY series, run"""))
def r1_runs_in_ranges(spark, sf):
    return G.runs(long_series(spark, sf))


@query("q1_steps_in_ranges", demo.with_samples(LONG_SQL + """SELECT series, count(gap) AS n, quantile_cont(gap, 0.5)::DOUBLE AS step_us FROM
 (SELECT series, us - lag(us) OVER (PARTITION BY series ORDER BY us, rid) AS gap FROM x) WHERE gap > 0 GROUP BY series"""))
def q1_steps_in_ranges(spark, sf):
    return G.quantiles(G.gaps(long_series(spark, sf)).where("gap > 0"), "gap", {"step_us": 0.5})


@query("q2_kinds_in_ranges", demo.with_samples(LONG_SQL + """, d AS (SELECT *, value - lag(value) OVER w AS d, lead(value) OVER w - value AS nx, 1e-6 * greatest(max(abs(value)) OVER (PARTITION BY series), 1e-12) AS tol,
  count(value) OVER (PARTITION BY series) AS n FROM x WINDOW w AS (PARTITION BY series ORDER BY us, rid))
SELECT series, rid, CASE WHEN value IS NULL THEN -1 WHEN n < 2 THEN 0 WHEN abs(d) <= tol THEN 2 WHEN abs(nx - d) <= tol AND NOT coalesce(abs(nx) <= tol, false) THEN 1 ELSE 0 END AS kind FROM d"""))
def q2_kinds_in_ranges(spark, sf):
    return G.sample_kinds(long_series(spark, sf)).select("series", "rid", "kind")


@query("w1_cut_in_ranges", demo.with_samples(LONG_SQL + """, k1 AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR label <> lag(label) OVER w OR (value IS NULL) <> (lag(value) OVER w IS NULL) THEN 1 ELSE 0 END AS ch FROM x WINDOW w AS (PARTITION BY series ORDER BY us, rid)),
k2 AS (SELECT *, sum(ch) OVER (PARTITION BY series ORDER BY us, rid) AS run FROM k1),
k3 AS (SELECT *, (row_number() OVER (PARTITION BY series, run ORDER BY us, rid) - 1) % 3 AS "at" FROM k2 WHERE value IS NOT NULL)
SELECT series, rid, "at"::INT AS "at", (sum(("at" = 0)::INT) OVER (PARTITION BY series ORDER BY us, rid) - 1)::BIGINT AS window FROM k3"""))
def w1_cut_in_ranges(spark, sf):
    rows = long_series(spark, sf).withColumn("keep", F.col("value").isNotNull())
    return G.cut(rows, 3, "keep").select("series", "rid", "at", "window")


SHARES = {"q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95}


@query("f2_quantiles_in_ranges", "SELECT event_type, count(value) AS n, " + ", ".join(f"round(quantile_cont(value, {p}), 6) AS {n}" for n, p in SHARES.items()) + " FROM events GROUP BY event_type")
def f2_quantiles_in_ranges(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_type", "value")
    return G.quantiles(rows, "value", SHARES, ("event_type",)).select("event_type", "n", *[r(n).alias(n) for n in SHARES])
