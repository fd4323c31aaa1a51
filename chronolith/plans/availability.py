"""Queries of availability and data quality, over daily means of the event types as channels."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.operators import availability as A
from chronolith.operators import intervals as I
from chronolith.operators import quality as K
from chronolith.operators import series as S
from chronolith.plans.intervals import CAT_SQL, cat
from chronolith.plans.registry import query
from chronolith.plans.series import r
from chronolith.sources import demo

TYPES = list(demo.TYPES)


def long(spark, sf):
    return A.unpivoted(demo.daily(spark, sf), ["entity", "us"], TYPES)


def fact(spark, sf):
    rows = A.facts(long(spark, sf), ["entity"], 0.0, 150.0, ["view"], 0.3)
    return rows.withColumn("grp", F.col("entity") % 5)


FACT_SQL = """, fact AS (SELECT entity, channel, count(*) AS total, count(value) AS n_valid, min(value) AS low, max(value) AS high, count(*) FILTER (value > 150) AS n_implausible,
 coalesce(max(value) > 150, false) AS implausible, CASE WHEN count(value) = 0 OR count(value) < 0.3 * count(*) THEN 0
 WHEN channel <> 'view' AND max(value) - min(value) <= 1e-4 * greatest(abs((max(value) + min(value)) / 2), 1.0) THEN 1 ELSE 2 END AS state, entity % 5 AS grp FROM chan GROUP BY entity, channel)
"""
GROUPED_SQL = FACT_SQL + """, grouped AS (SELECT CASE WHEN grouping(grp) = 1 THEN 'all' ELSE grp::VARCHAR END AS grp, channel, count(*) AS n_bars, sum(total)::BIGINT AS n_samples,
 sum(CASE state WHEN 2 THEN n_valid ELSE 0 END)::BIGINT AS live, sum(CASE state WHEN 1 THEN n_valid ELSE 0 END)::BIGINT AS frozen, (sum(total) - sum(CASE WHEN state > 0 THEN n_valid ELSE 0 END))::BIGINT AS absent,
 count(*) FILTER (state = 0) AS bars_absent, count(*) FILTER (state = 1) AS bars_frozen, count(*) FILTER (state = 2) AS bars_live, count(*) FILTER (implausible) AS bars_implausible,
 min(low) AS low, max(high) AS high FROM fact GROUP BY GROUPING SETS ((grp, channel), (channel)))
"""


@query("a2_facts", demo.with_daily(FACT_SQL + "SELECT entity, channel, total, n_valid, round(low, 6) AS low, round(high, 6) AS high, n_implausible, implausible, state FROM fact"))
def a2_facts(spark, sf):
    return fact(spark, sf).drop("grp").withColumns({"low": r("low"), "high": r("high")})


@query("a3_grouped", demo.with_daily(GROUPED_SQL + "SELECT * REPLACE (round(low, 6) AS low, round(high, 6) AS high), round(coalesce(live / nullif(n_samples, 0), 0), 6) AS live_share, round(coalesce(frozen / nullif(n_samples, 0), 0), 6) AS frozen_share, round(coalesce(bars_live / nullif(n_bars, 0), 0), 6) AS bar_share FROM grouped"))
def a3_grouped(spark, sf):
    out = A.shares(A.grouped(fact(spark, sf), "grp"))
    return out.withColumns({c: r(c) for c in ("low", "high", "live_share", "frozen_share", "bar_share")})


@query("a6_coverage_order", demo.with_daily(GROUPED_SQL + "SELECT channel, row_number() OVER (ORDER BY live / n_samples DESC, channel) AS rank FROM grouped WHERE grp = 'all'"))
def a6_coverage_order(spark, sf):
    return A.coverage_order(A.shares(A.grouped(fact(spark, sf), "grp")).where("grp = 'all'"))


def pairs_sql() -> str:
    parts = [f"SELECT entity, '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM daily GROUP BY entity" for i, a in enumerate(TYPES) for b in TYPES[i:]]
    return ", pc AS (" + " UNION ALL ".join(parts) + ")"


@query("a10_pair_counts", demo.with_daily(pairs_sql() + " SELECT entity, a, b, n FROM pc"))
def a10_pair_counts(spark, sf):
    return A.pair_counts(demo.daily(spark, sf), ["entity"], TYPES)


@query("a11_pair_coverage", demo.with_daily(FACT_SQL + pairs_sql() + """ SELECT a, b, sum(n)::BIGINT AS samples, count(*) FILTER (n > 0) AS bars FROM pc
 JOIN fact x ON x.entity = pc.entity AND x.channel = a AND x.state = 2 JOIN fact y ON y.entity = pc.entity AND y.channel = b AND y.state = 2 GROUP BY a, b"""))
def a11_pair_coverage(spark, sf):
    return A.pair_coverage(A.pair_counts(demo.daily(spark, sf), ["entity"], TYPES), fact(spark, sf), "entity")


@query("a13_seriation")
def a13_seriation(spark, sf):
    pairs = A.pair_coverage(A.pair_counts(demo.daily(spark, sf), ["entity"], TYPES), fact(spark, sf), "entity", False)
    order = A.seriation([tuple(x) for x in pairs.select("a", "b", "samples").collect()])
    return spark.createDataFrame([(c, i) for i, c in enumerate(order)], "channel string, place int")


@query("a14_recorded_counts", demo.with_daily(FACT_SQL + "SELECT channel, grp, count(DISTINCT entity) FILTER (n_valid > 0) AS recorded, count(DISTINCT entity) FILTER (state = 2) AS live FROM fact GROUP BY channel, grp"))
def a14_recorded_counts(spark, sf):
    return fact(spark, sf).groupBy("channel", "grp").agg(F.count_distinct(F.when(F.col("n_valid") > 0, F.col("entity"))).alias("recorded"), F.count_distinct(F.when(F.col("state") == 2, F.col("entity"))).alias("live"))


@query("a15_best_channel", demo.with_daily(GROUPED_SQL + "SELECT channel, live FROM grouped WHERE grp = 'all' ORDER BY channel = 'view', live DESC, channel LIMIT 1"))
def a15_best_channel(spark, sf):
    return A.best_channel(A.grouped(fact(spark, sf), "grp").where("grp = 'all'"), ["view"])


@query("a16_entity_summary", demo.with_samples(CAT_SQL + """, o AS (SELECT entity, count(DISTINCT s) AS k FROM (SELECT entity, a AS s FROM pairs UNION ALL SELECT entity, b FROM pairs) GROUP BY entity),
l AS (SELECT entity, max(k) AS lanes FROM (SELECT entity, (SELECT count(*) FROM cat o WHERE o.entity = c.entity AND o.start <= c.start AND o."end" >= c.start) AS k FROM cat c) GROUP BY entity)
SELECT c.entity, count(*) AS instances, coalesce(any_value(o.k), 0) AS overlapping, any_value(l.lanes) AS lanes, round(sum(("end" - start) / 3.6e9), 4) AS hours, sum(n_samples)::BIGINT AS samples FROM cat c LEFT JOIN o USING (entity) JOIN l USING (entity) GROUP BY c.entity"""))
def a16_entity_summary(spark, sf):
    rows = cat(spark, sf)
    return A.entity_summary(rows, I.overlaps(rows), I.lane_counts(rows)).withColumn("hours", r("hours", 4))


@query("a17_channel_stats", demo.with_daily(FACT_SQL + "SELECT channel, sum(n_valid)::BIGINT AS n_valid, sum(total)::BIGINT AS n_total, round(100 * sum(n_valid) / sum(total), 6) AS coverage, round(max(high) - min(low), 6) AS delta, max(high) - min(low) <= 1e-4 * greatest(abs((max(high) + min(low)) / 2), 1.0) AS flat FROM fact GROUP BY channel"))
def a17_channel_stats(spark, sf):
    from chronolith.functions.labels import is_flat

    out = A.sensor_stats(long(spark, sf), ["entity"]).groupBy("channel").agg(F.sum("n_valid").alias("n_valid"), F.sum("total").alias("n_total"), F.min("low").alias("low"), F.max("high").alias("high"))
    return out.select("channel", "n_valid", "n_total", r(100 * F.col("n_valid") / F.col("n_total")).alias("coverage"), r(F.col("high") - F.col("low")).alias("delta"), is_flat(F.col("low"), F.col("high")).alias("flat"))


@query("f12_profile_matrix", demo.with_daily(FACT_SQL + """SELECT entity, max(n_valid) FILTER (channel = 'click') AS click, max(n_valid) FILTER (channel = 'error') AS error, max(n_valid) FILTER (channel = 'purchase') AS purchase,
 max(n_valid) FILTER (channel = 'signup') AS signup, max(n_valid) FILTER (channel = 'view') AS view FROM fact GROUP BY entity"""))
def f12_profile_matrix(spark, sf):
    return fact(spark, sf).groupBy("entity").pivot("channel", TYPES).agg(F.max("n_valid"))


def breaks(spark, sf):
    return K.order_breaks(demo.daily(spark, sf), ["purchase", "signup", "error"], 20.0, 0.0, 300.0, key="entity")


BREAKS_SQL = """, pr AS (SELECT entity, count(purchase) >= 2 AND max(purchase) > min(purchase) AS p, count(signup) >= 2 AND max(signup) > min(signup) AS s, count(error) >= 2 AND max(error) > min(error) AS e FROM daily GROUP BY entity),
cmp AS (SELECT entity, 'purchase' AS up, 'signup' AS down, purchase AS u, signup AS d FROM daily JOIN pr USING (entity) WHERE p AND s
 UNION ALL SELECT entity, 'signup', 'error', signup, error FROM daily JOIN pr USING (entity) WHERE s AND e UNION ALL SELECT entity, 'purchase', 'error', purchase, error FROM daily JOIN pr USING (entity) WHERE p AND e AND NOT s),
br AS (SELECT entity, up, down, count(*) AS compared, count(*) FILTER (d - u > 20) AS broken, max(d - u) AS worst FROM cmp WHERE u IS NOT NULL AND d IS NOT NULL AND u <= 300 AND d <= 300 GROUP BY entity, up, down)
"""


@query("k2_order_breaks", demo.with_daily(BREAKS_SQL + "SELECT entity, up, down, compared, broken, round(worst, 6) AS worst, round(broken / compared, 6) AS share FROM br WHERE broken / compared > 0.01"))
def k2_order_breaks(spark, sf):
    return breaks(spark, sf).withColumns({"worst": r("worst"), "share": r("share")})


@query("k3_partners", demo.with_daily(BREAKS_SQL + """SELECT entity, channel, string_agg(DISTINCT other, ',' ORDER BY other) AS partners FROM (SELECT entity, up AS channel, down AS other FROM br WHERE broken / compared > 0.01
 UNION ALL SELECT entity, down, up FROM br WHERE broken / compared > 0.01) GROUP BY entity, channel"""))
def k3_partners(spark, sf):
    return K.partners(breaks(spark, sf), "entity").withColumn("partners", F.array_join("partners", ","))


@query("a9_conflict_pairs", demo.with_daily(BREAKS_SQL + "SELECT least(up, down) AS a, greatest(up, down) AS b, count(*) AS bars FROM br WHERE broken / compared > 0.01 GROUP BY ALL"))
def a9_conflict_pairs(spark, sf):
    return breaks(spark, sf).groupBy(F.least("up", "down").alias("a"), F.greatest("up", "down").alias("b")).agg(F.count(F.lit(1)).alias("bars"))


@query("k4_near_changes", demo.with_samples(""", c AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER w AND row_number() OVER w > 1 THEN us END AS c FROM samples WINDOW w AS (PARTITION BY series ORDER BY us, rid))
SELECT series, rid, coalesce(us - max(c) OVER (PARTITION BY series ORDER BY us, rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 3600000000, false)
 OR coalesce(min(c) OVER (PARTITION BY series ORDER BY us, rid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - us <= 3600000000, false) AS near FROM c"""))
def k4_near_changes(spark, sf):
    return K.near_changes(demo.samples(spark, sf), within_us=3_600_000_000).select("series", "rid", "near")


RULES = [(4, "all", True, ["v_click", "v_error"]), (3, "any", False, ["v_click", "v_view"]), (2, "all", False, ["v_view"])]


def valves(spark, sf):
    wide = demo.daily(spark, sf)
    return wide.select("entity", "us", "state", *[F.when(F.col(c).isNotNull(), F.col(c) > 20).alias(f"v_{c}") for c in ("click", "error", "view")])


VALVES_SQL = ", vv AS (SELECT entity, us, state, click > 20 AS c, error > 20 AS e, view > 20 AS v FROM daily)"


@query("k5_state_breaks", demo.with_daily(VALVES_SQL + """, t AS (SELECT entity, 0 AS rule, coalesce(NOT c, false) OR coalesce(NOT e, false) AS broken FROM vv WHERE state = 4 AND (c IS NOT NULL OR e IS NOT NULL)
 UNION ALL SELECT entity, 1, c AND v FROM vv WHERE state = 3 AND c IS NOT NULL AND v IS NOT NULL UNION ALL SELECT entity, 2, v FROM vv WHERE state = 2 AND v IS NOT NULL)
SELECT entity, rule, count(*) AS tested, count(*) FILTER (broken) AS broken, round(count(*) FILTER (broken) / count(*), 6) AS share FROM t GROUP BY entity, rule HAVING count(*) FILTER (broken) / count(*) > 0.01"""))
def k5_state_breaks(spark, sf):
    return K.state_breaks(valves(spark, sf), RULES, key="entity").withColumn("share", r("share"))


@query("k6_states_by_valve", demo.with_daily(VALVES_SQL + """, u AS (SELECT entity, state, 'v_click' AS valve, c AS x FROM vv UNION ALL SELECT entity, state, 'v_error', e FROM vv UNION ALL SELECT entity, state, 'v_view', v FROM vv)
SELECT entity, valve, CASE WHEN x THEN 'open' WHEN NOT x THEN 'closed' ELSE 'unknown' END AS reading, string_agg(DISTINCT state, ',' ORDER BY state) AS states FROM u GROUP BY ALL"""))
def k6_states_by_valve(spark, sf):
    return K.states_by_valve(valves(spark, sf), ["v_click", "v_error", "v_view"], key="entity").withColumn("states", F.array_join(F.transform("states", lambda s: s.cast("string")), ","))


def cleaned(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    stats = rows.groupBy(F.col("l_suppkey").alias("event"), F.col("l_returnflag").alias("channel")).agg(F.avg("l_extendedprice").alias("mean"), F.stddev_pop("l_extendedprice").alias("std"))
    stats = stats.withColumns({c: F.when((F.col("channel") != "R") | (F.col("event") % 4 == 0), F.col(c)) for c in ("mean", "std")})
    return K.robust_cleaning(stats, 0.5)


CLEAN_SQL = """WITH s0 AS (SELECT l_suppkey AS event, l_returnflag AS channel, avg(l_extendedprice) AS mean, stddev_pop(l_extendedprice) AS std FROM lineitem GROUP BY ALL),
s AS (SELECT event, channel, CASE WHEN channel <> 'R' OR event % 4 = 0 THEN mean END AS mean, CASE WHEN channel <> 'R' OR event % 4 = 0 THEN std END AS std FROM s0),
q AS (SELECT channel, quantile_cont(mean, 0.25) AS m1, quantile_cont(mean, 0.75) AS m3, quantile_cont(std, 0.25) AS s1, quantile_cont(std, 0.75) AS s3, count(*) FILTER (mean IS NULL) / count(*) >= 0.6 AS dropped FROM s GROUP BY channel),
f AS (SELECT s.*, dropped, NOT dropped AND coalesce(mean < m1 - 0.5 * (m3 - m1) OR mean > m3 + 0.5 * (m3 - m1), false) AS by_mean,
 NOT dropped AND coalesce(std < greatest(s1 - 0.5 * (s3 - s1), 1e-6) OR std > s3 + 0.5 * (s3 - s1), false) AS by_std FROM s JOIN q USING (channel))
"""


@query("k7_robust_cleaning", CLEAN_SQL + "SELECT event, channel, round(mean, 4) AS mean, round(std, 4) AS std, by_mean, by_std, by_mean OR by_std AS discard, dropped FROM f")
def k7_robust_cleaning(spark, sf):
    return cleaned(spark, sf)[0].withColumns({"mean": r("mean", 4), "std": r("std", 4)})


@query("k8_kept_share", CLEAN_SQL + "SELECT event, round(count(*) FILTER (std > 0 AND NOT by_mean AND NOT by_std AND NOT dropped) / nullif(count(*) FILTER (std > 0), 0), 6) AS kept FROM f GROUP BY event")
def k8_kept_share(spark, sf):
    return K.kept_share(cleaned(spark, sf)[0]).withColumn("kept", r("kept"))


@query("k9_reasons", CLEAN_SQL + """SELECT event, string_agg(channel || ' by ' || concat_ws(' and ', CASE WHEN by_mean THEN 'mean' END, CASE WHEN by_std THEN 'std' END), ', ' ORDER BY channel) AS why FROM f WHERE by_mean OR by_std GROUP BY event""")
def k9_reasons(spark, sf):
    return K.reasons(cleaned(spark, sf)[0])


CONFLICT_SQL = """, t AS (SELECT entity, 0 AS rule, coalesce(NOT c, false) OR coalesce(NOT e, false) AS broken FROM vv WHERE state = 4 AND (c IS NOT NULL OR e IS NOT NULL)
 UNION ALL SELECT entity, 1, c AND v FROM vv WHERE state = 3 AND c IS NOT NULL AND v IS NOT NULL UNION ALL SELECT entity, 2, v FROM vv WHERE state = 2 AND v IS NOT NULL),
tb AS (SELECT entity, rule FROM t GROUP BY entity, rule HAVING count(*) FILTER (broken) / count(*) > 0.01),
cf AS (SELECT entity, channel, list_sort(list(DISTINCT code)) AS conflicts FROM tb JOIN (VALUES (0, 4, 'click'), (0, 4, 'error'), (1, 3, 'click'), (1, 3, 'view'), (2, 2, 'view')) AS m(rule, code, channel) USING (rule) GROUP BY ALL),
pa AS (SELECT entity, channel, list_sort(list(DISTINCT other)) AS partners FROM (SELECT entity, up AS channel, down AS other FROM br WHERE broken / compared > 0.01 UNION ALL SELECT entity, down, up FROM br WHERE broken / compared > 0.01) GROUP BY entity, channel),
kd AS (SELECT *, value - lag(value) OVER w AS d, 1e-6 * greatest(max(abs(value)) OVER (PARTITION BY entity, channel), 1e-12) AS tol, count(value) OVER (PARTITION BY entity, channel) AS n FROM chan WINDOW w AS (PARTITION BY entity, channel ORDER BY us)),
kx AS (SELECT *, lead(d) OVER (PARTITION BY entity, channel ORDER BY us) AS nx FROM kd),
sm AS (SELECT entity, channel, count(*) FILTER (value IS NOT NULL AND (n < 2 OR (NOT coalesce(abs(d) <= tol, false) AND NOT (coalesce(abs(nx - d) <= tol, false) AND NOT coalesce(abs(nx) <= tol, false))))) AS n_genuine, count(value) AS nv FROM kx GROUP BY ALL),
mf AS (SELECT f.*, n_genuine, nv - n_genuine AS n_filled, partners IS NOT NULL AS out_of_order, conflicts IS NOT NULL AS against_state, coalesce(partners, []) AS partners, coalesce(conflicts, []) AS conflicts
 FROM fact f JOIN sm USING (entity, channel) LEFT JOIN pa USING (entity, channel) LEFT JOIN cf USING (entity, channel))
"""
MEASURED_SQL = FACT_SQL + BREAKS_SQL + VALVES_SQL + CONFLICT_SQL


def measured(spark, sf):
    rows = A.unpivoted(demo.daily(spark, sf), ["entity", "us", "rid"], TYPES)
    by = ("entity", "channel")
    sampling = S.sampling_summary(S.sample_kinds(rows, by=by), S.sampling_step(rows, by), by)
    broken = K.state_breaks(valves(spark, sf), RULES, key="entity")
    conflicts = K.state_conflicts(broken, RULES, {f"v_{c}": c for c in TYPES}, "entity")
    return A.measured(fact(spark, sf), sampling, K.partners(breaks(spark, sf), "entity"), conflicts, ["entity"])


def listed(*columns: str) -> dict:
    return {c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in columns}


@query("a2_measured_facts", demo.with_daily(MEASURED_SQL + "SELECT entity, channel, total, n_valid, n_implausible, state, n_genuine, n_filled, out_of_order, against_state, array_to_string(partners, ',') AS partners, array_to_string(conflicts, ',') AS conflicts FROM mf"))
def a2_measured_facts(spark, sf):
    return measured(spark, sf).drop("grp", "low", "high", "implausible").withColumns(listed("partners", "conflicts"))


@query("a3_measured_groups", demo.with_daily(MEASURED_SQL + """SELECT CASE WHEN grouping(grp) = 1 THEN 'all' ELSE grp::VARCHAR END AS grp, channel, count(*) AS n_bars, sum(total)::BIGINT AS n_samples,
 sum(CASE state WHEN 2 THEN n_valid ELSE 0 END)::BIGINT AS live, sum(CASE state WHEN 2 THEN n_genuine ELSE 0 END)::BIGINT AS genuine, sum(CASE state WHEN 2 THEN n_filled ELSE 0 END)::BIGINT AS filled,
 count(*) FILTER (out_of_order) AS bars_out_of_order, count(*) FILTER (against_state) AS bars_against_state,
 array_to_string(list_sort(list_distinct(flatten(list(partners)))), ',') AS partners, array_to_string(list_sort(list_distinct(flatten(list(conflicts)))), ',') AS conflicts,
 round(coalesce(sum(CASE state WHEN 2 THEN n_filled ELSE 0 END) / nullif(sum(total), 0), 0), 6) AS filled_share,
 round(sum(CASE state WHEN 2 THEN n_genuine ELSE 0 END) / nullif(sum(CASE state WHEN 2 THEN n_genuine + n_filled ELSE 0 END), 0), 6) AS measured_share,
 round(86400 * sum(CASE state WHEN 2 THEN n_valid ELSE 0 END) / nullif(sum(CASE state WHEN 2 THEN n_genuine ELSE 0 END), 0), 4) AS spacing_s FROM mf GROUP BY GROUPING SETS ((grp, channel), (channel))"""))
def a3_measured_groups(spark, sf):
    x = A.shares(A.grouped(measured(spark, sf), "grp"), 86_400.0).withColumns(listed("partners", "conflicts"))
    kept = ("grp", "channel", "n_bars", "n_samples", "live", "genuine", "filled", "bars_out_of_order", "bars_against_state", "partners", "conflicts")
    return x.select(*kept, r("filled_share").alias("filled_share"), r("measured_share").alias("measured_share"), r("spacing_s", 4).alias("spacing_s"))


@query("a7_reordered", demo.with_daily(GROUPED_SQL + """SELECT g.grp, g.channel, n_bars, live, rank AS column_place FROM grouped g JOIN (SELECT channel, row_number() OVER (ORDER BY live / n_samples DESC, channel) AS rank FROM grouped WHERE grp = 'all') o USING (channel)"""))
def a7_reordered(spark, sf):
    table = A.grouped(fact(spark, sf), "grp")
    return A.reordered(table, A.coverage_order(A.shares(table).where("grp = 'all'"))).select("grp", "channel", "n_bars", "live", "column_place")


@query("s6_sensor_stats", demo.with_daily("SELECT entity, channel, count(*) AS total, count(value) AS n_valid, round(min(value), 6) AS low, round(max(value), 6) AS high FROM chan GROUP BY entity, channel"))
def s6_sensor_stats(spark, sf):
    return A.sensor_stats(long(spark, sf), ["entity"]).withColumns({"low": r("low"), "high": r("high")})
