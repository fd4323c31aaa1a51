"""Further queries: listings, filters, orders, pools and scopes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronolith.functions import labels as L
from chronolith.operators import availability as A
from chronolith.operators import distribution as D
from chronolith.operators import intervals as I
from chronolith.operators import maps as M
from chronolith.operators import outputs as G
from chronolith.operators import series as S
from chronolith.operators import windows as W
from chronolith.operators.ordering import earliest, ranked
from chronolith.plans.availability import FACT_SQL, GROUPED_SQL, TYPES, fact, pairs_sql
from chronolith.plans.intervals import CAT_SQL, GROUPS_SQL, cat, grouped, groups_sql
from chronolith.plans.maps import AGREE, VERDICT_SQL, parts, points
from chronolith.plans.registry import query
from chronolith.plans.series import KINDS, moments_sql, r, rounded_moments
from chronolith.plans.windows import CUT_SQL, LOMB_SQL, lomb, placed
from chronolith.sources import demo
from chronolith.sources.recordings import state_name


@query("a8_channel_shares", demo.with_daily(FACT_SQL + """SELECT state, sum(n_valid)::BIGINT AS samples, count(*) AS bars, bool_or(implausible) AS implausible FROM fact WHERE channel = 'error' AND grp IN (1, 2) GROUP BY state"""))
def a8_channel_shares(spark, sf):
    x = fact(spark, sf).where("channel = 'error' and grp in (1, 2)")
    return x.groupBy("state").agg(F.sum("n_valid").alias("samples"), F.count(F.lit(1)).alias("bars"), F.bool_or("implausible").alias("implausible"))


@query("a12_pair_order", demo.with_daily(pairs_sql() + " SELECT a AS channel, row_number() OVER (ORDER BY sum(n) DESC, a) AS rank FROM pc WHERE a = b GROUP BY a"))
def a12_pair_order(spark, sf):
    own = A.pair_counts(demo.daily(spark, sf), ["entity"], TYPES).where("a = b").groupBy(F.col("a").alias("channel")).agg(F.sum("n").alias("n"))
    return own.select("channel", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "channel")).alias("rank"))


@query("a18_feature_table", demo.with_daily(FACT_SQL + "SELECT channel, count(*) FILTER (n_valid > 0) AS recorded, count(*) FILTER (implausible) AS implausible, count(*) AS blocks FROM fact WHERE grp = 3 GROUP BY channel"))
def a18_feature_table(spark, sf):
    return fact(spark, sf).where("grp = 3").groupBy("channel").agg(F.count_if(F.col("n_valid") > 0).alias("recorded"), F.count_if("implausible").alias("implausible"), F.count(F.lit(1)).alias("blocks"))


@query("c5_dot_thinning", "SELECT event_id AS rid FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE i % ceil(n / 20.0)::BIGINT = 0")
def c5_dot_thinning(spark, sf):
    """At most 20 dots of each entity's cloud, in even strides."""
    return S.even_stride(demo.events(spark, sf), 20, 1, ("entity",), 20).select("rid")


@query("c6_bin_lookup", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity BETWEEN 5 AND 45 THEN least(floor((l_quantity - 5) / 40.0 * 8), 7)::INT ELSE -1 END AS bin FROM lineitem")
def c6_bin_lookup(spark, sf):
    x = spark.read.parquet(f"{sf}/lineitem.parquet")
    return x.select("l_orderkey", "l_linenumber", F.coalesce(D.bin_of(F.col("l_quantity").cast("double"), F.lit(5.0), F.lit(45.0), 8), F.lit(-1)).alias("bin"))


@query("c7_default_pair", demo.with_daily(FACT_SQL + "SELECT channel, count(*) FILTER (state = 2) AS live FROM fact WHERE channel <> 'view' GROUP BY channel ORDER BY live DESC, channel LIMIT 2"))
def c7_default_pair(spark, sf):
    return fact(spark, sf).where("channel <> 'view'").groupBy("channel").agg(F.count_if(F.col("state") == 2).alias("live")).orderBy(F.desc("live"), "channel").limit(2)


@query("e13_titles", demo.with_samples(GROUPS_SQL + "SELECT entity, bar, printf('WELL-%05d', entity) AS name, min(series)::VARCHAR || CASE WHEN count(*) > 1 THEN ' +' || (count(*) - 1) ELSE '' END AS title FROM grp GROUP BY entity, bar"))
def e13_titles(spark, sf):
    x = grouped(spark, sf).groupBy("entity", "bar").agg(F.min("series").alias("s"), F.count(F.lit(1)).alias("n"))
    more = F.when(F.col("n") > 1, F.concat(F.lit(" +"), (F.col("n") - 1).cast("string"))).otherwise("")
    return x.select("entity", "bar", F.format_string("WELL-%05d", "entity").alias("name"), F.concat(F.col("s").cast("string"), more).alias("title"))


@query("e16_genuine_only", demo.with_samples(KINDS + "SELECT series, count(*) AS n, round(avg(value), 6) AS mean FROM kinds WHERE kind = 0 GROUP BY series"))
def e16_genuine_only(spark, sf):
    return S.sample_kinds(demo.samples(spark, sf)).where("kind = 0").groupBy("series").agg(F.count(F.lit(1)).alias("n"), r(F.avg("value")).alias("mean"))


@query("e19_plausible_extent", demo.with_samples("SELECT series, coalesce(min(raw) FILTER (raw BETWEEN 20 AND 60), min(raw)) AS low, coalesce(max(raw) FILTER (raw BETWEEN 20 AND 60), max(raw)) AS high FROM samples GROUP BY series"))
def e19_plausible_extent(spark, sf):
    ok = L.plausible(F.col("raw"), F.lit(20.0), F.lit(60.0))
    return demo.samples(spark, sf).groupBy("series").agg(F.coalesce(F.min(ok), F.min("raw")).alias("low"), F.coalesce(F.max(ok), F.max("raw")).alias("high"))


@query("e21_entity_filters", demo.with_samples(CAT_SQL + "SELECT DISTINCT entity FROM cat WHERE entity IN (SELECT entity FROM pairs) AND entity IN (SELECT entity FROM samples WHERE label = 2)"))
def e21_entity_filters(spark, sf):
    rows = cat(spark, sf)
    with_fault = demo.samples(spark, sf).where("label = 2").select("entity")
    return rows.select("entity").distinct().join(I.overlaps(rows).select("entity"), "entity", "left_semi").join(with_fault, "entity", "left_semi")


@query("f10_profile_frame", demo.with_daily(FACT_SQL + "SELECT d.entity, t.channel, coalesce(f.n_valid, 0) AS n_valid, coalesce(f.state, 0) AS state FROM (SELECT DISTINCT entity FROM daily) d CROSS JOIN (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view', 'absent']) AS channel) t LEFT JOIN fact f ON f.entity = d.entity AND f.channel = t.channel"))
def f10_profile_frame(spark, sf):
    own = fact(spark, sf)
    grid = own.select("entity").distinct().select("entity", F.explode(F.array(*map(F.lit, [*TYPES, "absent"]))).alias("channel"))
    return grid.join(own, ["entity", "channel"], "left").select("entity", "channel", F.coalesce("n_valid", F.lit(0)).alias("n_valid"), F.coalesce("state", F.lit(0)).alias("state"))


@query("f11_profile_scopes", demo.with_samples(GROUPS_SQL + ", u AS (SELECT 'instance' AS scope, series::VARCHAR AS key, value FROM samples UNION ALL SELECT 'labelled', series::VARCHAR, value FROM samples WHERE label IS NOT NULL UNION ALL SELECT 'bar', g.entity || '-' || bar, value FROM grp g JOIN samples USING (series)), k AS (SELECT scope || ':' || key AS id, value FROM u) " + moments_sql("k", "id")))
def f11_profile_scopes(spark, sf):
    bar = grouped(spark, sf).select("series", F.concat(F.lit("bar:"), F.concat_ws("-", "entity", "bar")).alias("_bar"))
    series = F.col("series").cast("string")
    # a sample is read once and goes to all that it is part of
    if_ = lambda test, id_: F.when(test, F.array(id_)).otherwise(F.array().cast("array<string>"))
    scopes = F.concat(F.array(F.concat(F.lit("instance:"), series)), if_(F.col("label").isNotNull(), F.concat(F.lit("labelled:"), series)), if_(F.col("_bar").isNotNull(), F.col("_bar")))
    rows = demo.samples(spark, sf).join(bar, "series", "left").select(F.explode(scopes).alias("id"), "value")
    return rounded_moments(S.moments(rows, by=("id",)))


@query("g1_agrees", demo.with_samples("SELECT series, rid, CASE WHEN label IS NOT NULL AND rid % 13 <> 0 THEN (raw > 20) = (label <> 0) END AS detection, CASE WHEN label IS NOT NULL AND rid % 13 <> 0 THEN (raw > 20)::INT = CASE WHEN label > 100 THEN label - 100 ELSE label END END AS classification FROM samples"))
def g1_agrees(spark, sf):
    v = F.when(F.col("rid") % 13 != 0, (F.col("raw") > 20).cast("int"))
    return demo.samples(spark, sf).select("series", "rid", G.agrees(v, F.col("label"), F.col("fault")).alias("detection"), G.agrees(v, F.col("label"), F.col("fault"), "classification").alias("classification"))


@query("g4_class_runs", demo.with_samples(VERDICT_SQL + 'SELECT v.series, v.start, v."end", CASE WHEN v.value = 0 THEN 0 ELSE c.fault END AS value FROM ver v JOIN (SELECT DISTINCT series, fault FROM samples) c USING (series) WHERE v.value IS NOT NULL'))
def g4_class_runs(spark, sf):
    x = demo.samples(spark, sf).withColumn("verdict", F.when(F.col("rid") % 13 != 0, (F.col("raw") > 20).cast("int")))
    runs = I.label_segments(x, "verdict", ("series", "fault")).where("value is not null")
    return G.as_class_runs(runs).select("series", "start", "end", "value")


@query("g6_sorted_by_agreement", demo.with_samples(VERDICT_SQL + AGREE + "SELECT series, row_number() OVER (ORDER BY round(agreed / nullif(compared, 0), 6) ASC NULLS LAST, series) AS place FROM ag"))
def g6_sorted_by_agreement(spark, sf):
    share = G.agreement(parts(spark, sf), ["series"]).select("series", r("share").alias("share"))
    return ranked(share, [F.asc_nulls_last("share"), F.asc("series")], "place").select("series", "place")


@query("h6_scaled_density", LOMB_SQL + "SELECT entity, k::INT AS k, round(density / 1000, 1) AS density, round(explained, 6) AS explained, span_s FROM spec")
def h6_scaled_density(spark, sf):
    return lomb(spark, sf).select("entity", "k", r(F.col("density") / 1000, 1).alias("density"), r("explained").alias("explained"), "span_s")


@query("h10_pooled_spectra", LOMB_SQL + """, sp AS (SELECT ln(min(period)) AS a, ln(max(period)) AS b FROM spec), g AS (SELECT point, exp(a + (b - a) * point / 39) AS x FROM sp, (SELECT unnest(range(0, 40)) AS point)),
n AS (SELECT *, lead(period) OVER w AS p1, lead(density) OVER w AS v1 FROM spec WINDOW w AS (PARTITION BY entity ORDER BY period))
SELECT entity % 5 AS pool, point, round(avg(coalesce(density + (v1 - density) * (x - period) / (p1 - period), density)) / 1000, 1) AS density, count(*) AS n
FROM n JOIN g ON x >= period * (1 - 1e-9) AND x < coalesce(p1 * (1 - 1e-9), period * (1 + 1e-9)) GROUP BY 1, 2""")
def h10_pooled_spectra(spark, sf):
    pooled = D.average_spectra(lomb(spark, sf), ["entity"], F.col("entity") % 5, value="density")
    return pooled.select(F.col("grp").alias("pool"), "point", r(F.col("value") / 1000, 1).alias("density"), "n")


@query("l2_top_channels", demo.with_daily(FACT_SQL + "SELECT entity, channel FROM (SELECT entity, channel, row_number() OVER (PARTITION BY entity ORDER BY n_valid DESC, channel) AS k FROM fact) WHERE k <= 2"))
def l2_top_channels(spark, sf):
    k = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("n_valid"), "channel"))
    return fact(spark, sf).withColumn("k", k).where("k <= 2").select("entity", "channel")


@query("j9_unseen", demo.with_samples(CAT_SQL + "SELECT series FROM cat WHERE \"end\" >= 1705276800000000"))
def j9_unseen(spark, sf):
    """The recordings that a catalogue made at one moment does not hold as they are now: those that ended since."""
    rows = cat(spark, sf)
    cached = rows.where("end < 1705276800000000").select("series", "n_samples")
    return rows.join(cached, ["series", "n_samples"], "left_anti").select("series")


@query("j12_shared_channels", demo.with_daily(FACT_SQL + "SELECT grp, channel, count(DISTINCT entity) FILTER (n_valid > 0) = count(DISTINCT entity) AS shared FROM fact GROUP BY grp, channel"))
def j12_shared_channels(spark, sf):
    return fact(spark, sf).groupBy("grp", "channel").agg((F.count_distinct(F.when(F.col("n_valid") > 0, F.col("entity"))) == F.count_distinct("entity")).alias("shared"))


DENSITY_SQL = """WITH RECURSIVE p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings), d AS (SELECT q.id AS a, p.id AS b, list_distance(q.x, p.x) AS d FROM p q JOIN p ON p.id <> q.id),
rad AS (SELECT median(d) AS r FROM (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM d) WHERE k = 5),
near AS MATERIALIZED (SELECT a, b, d FROM d, rad WHERE d <= r), core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) + 1 >= 5),
links AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach AS (SELECT id, id AS root FROM core UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id),
own AS (SELECT id, min(root) AS cluster FROM reach GROUP BY id),
edge AS (SELECT a AS id, arg_min(cluster, struct_pack(d := d, b := b)) AS cluster FROM near JOIN own ON own.id = near.b GROUP BY a)
SELECT p.id, coalesce(own.cluster, edge.cluster, -1) AS cluster FROM p LEFT JOIN own ON own.id = p.id LEFT JOIN edge ON edge.id = p.id"""


@query("m10_density_clusters", DENSITY_SQL)
def m10_density_clusters(spark, sf):
    return M.density_clusters(points(spark, sf))


@query("r3_reach", demo.with_samples("SELECT series, CASE WHEN max(label BETWEEN 1 AND 99) THEN 'steady' WHEN max(label > 100) THEN 'transient' ELSE 'normal' END AS reach FROM (SELECT series, coalesce(label, 0) AS label FROM samples) GROUP BY series"))
def r3_reach(spark, sf):
    return I.reach(demo.samples(spark, sf))


@query("r10_join_among", demo.with_samples(CAT_SQL + ", far AS (SELECT *, entity || reach AS er FROM cat)" + groups_sql("far", "er") + "SELECT entity, reach, series, bar FROM grp"))
def r10_join_among(spark, sf):
    """The bars among the recordings that reach alike: normal ones, transients, steady faults."""
    return I.join_groups(cat(spark, sf), ("entity", "reach")).select("entity", "reach", "series", "bar")


@query("r22_alignments", "SELECT k AS fault, unnest(CASE WHEN k = 0 THEN ['start'] WHEN k IN (1, 2) THEN ['start', 'steady', 'transient'] ELSE ['start', 'steady'] END) AS alignment FROM (SELECT DISTINCT user_id % 5 AS k FROM events)")
def r22_alignments(spark, sf):
    x = demo.events(spark, sf).select((F.col("entity") % 5).alias("fault")).distinct()
    ways = F.filter(F.array(F.lit("start"), F.when(F.col("fault") != 0, "steady"), F.when(F.col("fault").isin(1, 2), "transient")), lambda w: w.isNotNull())
    return x.select("fault", F.explode(ways).alias("alignment"))


@query("r24_merged_by_group", demo.with_samples(GROUPS_SQL + "SELECT g.fault, g.entity, count(DISTINCT us) AS n, count(DISTINCT bar) AS bars FROM grp g JOIN samples USING (series) GROUP BY g.fault, g.entity"))
def r24_merged_by_group(spark, sf):
    rows = demo.samples(spark, sf).join(grouped(spark, sf).select("series", "bar"), "series")
    return rows.groupBy("fault", "entity").agg(F.count_distinct("us").alias("n"), F.count_distinct("bar").alias("bars"))


@query("w3_series_pass", demo.with_samples(CUT_SQL + "SELECT series, rid, value, keep FROM k0"))
def w3_series_pass(spark, sf):
    x = demo.samples(spark, sf)
    return I.repeated_samples(x, I.catalogue(x)).select("series", "rid", "value", (~F.col("repeated")).alias("keep"))


@query("w7_separation_by_group", demo.with_samples(CUT_SQL + """, w AS (SELECT any_value(fault) AS fault, round(avg(value), 6) AS v, any_value(label) > 0 AS e FROM placed WHERE label IS NOT NULL GROUP BY series, win HAVING count(value) > 0),
t AS (SELECT fault, v, count(*) FILTER (e) AS e, count(*) FILTER (NOT e) AS n FROM w GROUP BY ALL), u AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY fault ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM t)
SELECT fault, round(2 * abs(sum(e * (below + n / 2)) / (sum(e) * sum(n)) - 0.5), 6) AS separation FROM u GROUP BY fault"""))
def w7_separation_by_group(spark, sf):
    x = placed(spark, sf).where("label is not null").groupBy("series", "window").agg(F.first("fault").alias("fault"), r(F.avg("value")).alias("v"), F.first("label").alias("label")).where("v is not null")
    return W.auc(x, "v", F.col("label") > 0, ["fault"]).select("fault", r("separation").alias("separation"))


@query("w10_window_at", demo.with_samples(CUT_SQL + ', w AS (SELECT series, win, min(us) AS a, max(us) AS b FROM placed GROUP BY series, win) SELECT series, win::BIGINT AS "window" FROM w WHERE a <= 1705276800000000 AND b >= 1705276800000000'))
def w10_window_at(spark, sf):
    return W.windows(placed(spark, sf), 3).where("start <= 1705276800000000 and last >= 1705276800000000").select("series", "window")


UNITS = {"view": "Pa", "click": "°C", "error": "%", "purchase": "m³/s", "signup": "-"}


@query("e6_unit_ranges", demo.with_samples("""SELECT event_type, count(*) AS n, count(*) FILTER (NOT raw BETWEEN low AND high) AS n_implausible, round(min(raw) FILTER (raw BETWEEN low AND high) * scale, 9) AS low, round(max(raw) FILTER (raw BETWEEN low AND high) * scale, 9) AS high FROM ev
 JOIN (VALUES ('view', 0.0, 1e8, 1e-6), ('click', -50.0, 250.0, 1.0), ('error', 0.0, 100.0, 1.0), ('purchase', 0.0, 10.0, 1.0), ('signup', -1e8, 1e8, 1.0)) AS u(event_type, low, high, scale) USING (event_type) GROUP BY event_type, scale"""))
def e6_unit_ranges(spark, sf):
    """Plausible and shown readings where each event type has a unit of its own."""
    unit = F.create_map(*[F.lit(x) for item in UNITS.items() for x in item])[F.col("event_type")]
    x = demo.events(spark, sf).withColumn("unit", unit)
    ok = L.plausible(F.col("raw"), *L.bounds(F.col("unit")))
    shown = L.shown(ok, F.col("unit"))
    return x.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("raw").isNotNull() & ok.isNull()).alias("n_implausible"), r(F.min(shown), 9).alias("low"), r(F.max(shown), 9).alias("high"))


@query("e11_valve_positions", demo.with_samples("SELECT series, rid, CASE label WHEN 1 THEN true WHEN 0 THEN false END AS valve, CASE WHEN raw BETWEEN 0 AND 100 THEN raw > 0 END AS choke FROM samples"))
def e11_valve_positions(spark, sf):
    return demo.samples(spark, sf).select("series", "rid", L.valve_open(F.col("label")).alias("valve"), L.valve_open(F.col("raw"), True).alias("choke"))


@query("e3_state_names", demo.with_samples("SELECT coalesce(CASE code WHEN 0 THEN 'Open' WHEN 1 THEN 'Shut-In' WHEN 2 THEN 'Flushing Diesel' WHEN 3 THEN 'Flushing Gas' WHEN 4 THEN 'Bullheading' END, 'Unknown') AS name, count(*) AS n FROM (SELECT CASE WHEN rid % 9 = 0 THEN NULL WHEN rid % 10 = 0 THEN 77 ELSE code END AS code FROM ev) GROUP BY 1"))
def e3_state_names(spark, sf):
    code = F.when(F.col("rid") % 9 == 0, None).when(F.col("rid") % 10 == 0, 77).otherwise(F.col("code"))
    return demo.events(spark, sf).groupBy(state_name(code).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("l1_catalogue_order", demo.with_samples(CAT_SQL + "SELECT series, row_number() OVER (ORDER BY entity, start, series) AS place FROM cat"))
def l1_catalogue_order(spark, sf):
    return ranked(cat(spark, sf), [F.asc("entity"), F.asc("start"), F.asc("series")], "place").select("series", "place")


@query("l3_caps", demo.with_samples(CAT_SQL + "SELECT fault, series FROM (SELECT fault, series, row_number() OVER (PARTITION BY fault ORDER BY start, series) AS k FROM cat) WHERE k <= 24"))
def l3_caps(spark, sf):
    """The earliest 24 recordings of each fault, which a view draws over each other."""
    return earliest(cat(spark, sf), ["fault"], ["start", "series"], 24).select("fault", "series")
