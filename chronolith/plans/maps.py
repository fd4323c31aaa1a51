"""Queries of the recordings' map, model outputs and the control chart."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.operators import distribution as D
from chronolith.operators import intervals as I
from chronolith.operators import maps as M
from chronolith.operators import outputs as G
from chronolith.operators import scaling
from chronolith.operators import series as S
from chronolith.plans.availability import FACT_SQL, TYPES, fact
from chronolith.plans.intervals import CAT_SQL, RUNS_SQL, cat
from chronolith.plans.registry import query
from chronolith.plans.series import ACF_SQL, SNR, acf_rows, r
from chronolith.sources import demo


def points(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("cls"), (F.col("vec_id") % 5).alias("entity"), F.col("embedding").alias("x"))


P_SQL = "WITH p AS (SELECT vec_id AS id, label AS cls, vec_id % 5 AS entity, embedding::DOUBLE[] AS x FROM embeddings), d AS (SELECT q.id AS a, p.id AS b, q.cls AS a_cls, p.cls AS b_cls, q.entity AS a_entity, p.entity AS b_entity, list_distance(q.x, p.x) AS d FROM p q JOIN p ON p.id <> q.id WHERE q.id % 50 = 0) "


@query("m5_distances", P_SQL + "SELECT a, b, round(d, 6) AS d FROM d")
def m5_distances(spark, sf):
    p = points(spark, sf)
    return M.distances(p.where("id % 50 = 0"), p, ()).select("a", "b", r("d").alias("d"))


@query("m16_neighbour_agreement", P_SQL + """, k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k, row_number() OVER (PARTITION BY a, a_entity <> b_entity ORDER BY d, b) AS o FROM d)
SELECT count(*) FILTER (k = 1) AS n, round(avg((a_entity = b_entity)::INT) FILTER (k = 1), 6) AS same_entity, round(avg((a_cls = b_cls)::INT) FILTER (k = 1), 6) AS same_class,
 round(avg((a_cls = b_cls)::INT) FILTER (o = 1 AND a_entity <> b_entity), 6) AS same_class_elsewhere FROM k""")
def m16_neighbour_agreement(spark, sf):
    p = points(spark, sf)
    out = M.neighbour_agreement(p.where("id % 50 = 0"), p)
    return out.select("n", *[r(c).alias(c) for c in ("same_entity", "same_class", "same_class_elsewhere")])


@query("m17_neighbourhood_kept", """WITH p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings), d AS (SELECT q.id AS a, p.id AS b, list_distance(q.x, p.x) AS d, list_distance(q.x[1:32], p.x[1:32]) AS h FROM p q JOIN p ON p.id <> q.id WHERE q.id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS kd, row_number() OVER (PARTITION BY a ORDER BY h, b) AS kh FROM d)
SELECT a, round(count(*) FILTER (kd <= 10 AND kh <= 10) / 10, 6) AS kept FROM k GROUP BY a""")
def m17_neighbourhood_kept(spark, sf):
    p = points(spark, sf)
    half = p.withColumn("x", F.slice("x", 1, 32))
    near = lambda q: M.nearest_points(q.where("id % 50 = 0"), q, 10)
    return M.neighbourhood_kept(near(p), near(half), 10).withColumn("kept", r("kept"))


@query("m13_typicality", """WITH p AS (SELECT vec_id AS id, label AS cls, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id % 4 = 0),
s AS (SELECT a.id, a.cls, sum(list_distance(a.x, b.x)) AS d, count(*) AS m FROM p a JOIN p b ON a.cls = b.cls GROUP BY a.id, a.cls),
md AS (SELECT cls, arg_min(id, struct_pack(a := round(d, 9), b := id)) AS medoid, any_value(m) AS m FROM s GROUP BY cls),
t AS (SELECT p.id, p.cls, medoid, m, list_distance(p.x, c.x) AS d FROM p JOIN md USING (cls) JOIN p c ON c.id = medoid)
SELECT id, cls, medoid, round(d, 6) AS distance, round(CASE WHEN m > 1 THEN 1 - (row_number() OVER (PARTITION BY cls ORDER BY d, id) - 1) / (m - 1) END, 6) AS typical FROM t""".replace(" WHERE vec_id % 4 = 0", ""))
def m13_typicality(spark, sf):
    return M.typicality(points(spark, sf)).withColumns({"distance": r("distance"), "typical": r("typical")})


PLANE_SQL = """WITH p AS (SELECT vec_id // 64 AS grp, vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
s AS (SELECT grp, avg(x) AS mx, avg(y) AS my, var_pop(x) + var_pop(y) AS v, atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) / 2 AS t FROM p GROUP BY grp HAVING count(*) > 1),
c AS (SELECT grp, id, (x - mx) * cos(t) + (y - my) * sin(t) AS c1, (y - my) * cos(t) - (x - mx) * sin(t) AS c2, v FROM p JOIN s USING (grp)),
g AS (SELECT grp, var_pop(c1) / any_value(v) AS e1, var_pop(c2) / any_value(v) AS e2, sign(arg_min(c1, struct_pack(a := -round(abs(c1), 9), b := id))) AS s1, sign(arg_min(c2, struct_pack(a := -round(abs(c2), 9), b := id))) AS s2 FROM c GROUP BY grp)
SELECT grp, id, round(c1 * s1, 6) AS c1, round(c2 * s2, 6) AS c2, round(e1, 6) AS e1, round(e2, 6) AS e2 FROM c JOIN g USING (grp)"""


@query("m7_classical_scaling", PLANE_SQL)
def m7_classical_scaling(spark, sf):
    """Of every 64 points in the plane of their first two components, the table of distances gives back the plane's principal axes."""
    p = points(spark, sf).select(F.floor(F.col("id") / 64).alias("grp"), "id", F.col("x")[0].cast("double").alias("px"), F.col("x")[1].cast("double").alias("py"))
    q = p.select("grp", F.col("id").alias("b"), F.col("px").alias("qx"), F.col("py").alias("qy"))
    pairs = p.join(q, "grp").where(F.col("id") < F.col("b"))
    pairs = pairs.select("grp", F.col("id").alias("a"), "b", F.sqrt((F.col("px") - F.col("qx")) ** 2 + (F.col("py") - F.col("qy")) ** 2).alias("d"))
    return scaling.classical(pairs, by="grp").select("grp", "id", *[r(c).alias(c) for c in ("c1", "c2", "e1", "e2")])


@query("m6_principal")
def m6_principal(spark, sf):
    scores, _ = M.principal(points(spark, sf))
    return scores


@query("m8_clusters")
def m8_clusters(spark, sf):
    return M.clustered(points(spark, sf), 10)


@query("m9_mixture")
def m9_mixture(spark, sf):
    p = points(spark, sf)
    scores, _ = M.principal(p, 3)
    low = p.drop("x").join(scores, "id").withColumn("x", F.array("pc1", "pc2", "pc3"))
    return M.clustered(low, 4, "mixture")


@query("m11_silhouette", """WITH p AS (SELECT vec_id AS id, label AS cls, embedding::DOUBLE[] AS x FROM embeddings WHERE label >= 0),
m AS (SELECT a.id, a.cls, b.cls AS other, avg(list_distance(a.x, b.x)) AS d FROM p a JOIN p b ON a.id <> b.id GROUP BY ALL),
o AS (SELECT id, min(d) FILTER (cls = other) AS a, min(d) FILTER (cls <> other) AS b FROM m GROUP BY id)
SELECT id, round(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS s FROM o""")
def m11_silhouette(spark, sf):
    from pyspark.sql import functions as F_

    return M.silhouette(points(spark, sf), "cls").withColumn("s", F_.round("s", 6))


@query("m12_agreement", """WITH t AS (SELECT label AS a, vec_id % 5 AS b, count(*)::DOUBLE AS n FROM embeddings GROUP BY ALL), c AS (SELECT sum(n*(n-1)/2) AS ij, sum(n) AS n, sum(n*ln(n)) AS h FROM t),
x AS (SELECT sum(m*(m-1)/2) AS pa, sum(m*ln(m)) AS ha FROM (SELECT sum(n) AS m FROM t GROUP BY a)), y AS (SELECT sum(m*(m-1)/2) AS pb, sum(m*ln(m)) AS hb FROM (SELECT sum(n) AS m FROM t GROUP BY b))
SELECT round((ij - pa*pb/(n*(n-1)/2)) / ((pa+pb)/2 - pa*pb/(n*(n-1)/2)), 6) AS ari, round(2*((ln(n)-ha/n)+(ln(n)-hb/n)-(ln(n)-h/n))/((ln(n)-ha/n)+(ln(n)-hb/n)), 6) AS nmi FROM c, x, y""")
def m12_agreement(spark, sf):
    out = M.agreement(points(spark, sf), "cls", "entity")
    return out.select(r("ari").alias("ari"), r("nmi").alias("nmi"))


@query("m14_novelty", """WITH p AS (SELECT vec_id AS id, label AS cls, embedding::DOUBLE[] AS x FROM embeddings), k AS (SELECT * FROM p WHERE cls = 0),
v AS (SELECT sum(v) AS v FROM (SELECT var_pop(y) AS v FROM (SELECT unnest(x) AS y, generate_subscripts(x, 1) AS i FROM k) GROUP BY i)),
s AS (SELECT p.id, p.cls, avg(exp(-pow(list_distance(p.x, k.x), 2) / v.v)) AS score FROM p, k, v GROUP BY ALL),
l AS (SELECT quantile_cont(score, 0.05) AS q FROM s WHERE cls = 0)
SELECT id, cls, round(score, 6) AS score, score < q AS anomalous, CASE WHEN cls = 0 THEN score < q ELSE score >= q END AS disagrees FROM s, l WHERE (SELECT count(*) FROM k) >= 8""")
def m14_novelty(spark, sf):
    return M.novelty(points(spark, sf)).withColumn("score", r("score"))


@query("m18_past_predictor", demo.with_samples(CAT_SQL + """, cc AS (SELECT series, entity, (series // 3) % 4 AS fault, start FROM cat), h AS (SELECT a.series, b.fault AS p, count(*) AS n, max(struct_pack(s := b.start, t := b.series)) AS last FROM cc a JOIN cc b ON a.entity = b.entity AND (b.start < a.start OR (b.start = a.start AND b.series < a.series)) GROUP BY ALL)
SELECT cc.series, cc.fault, (SELECT arg_max(p, struct_pack(n := n, l := last)) FROM h WHERE h.series = cc.series) AS predicted FROM cc"""))
def m18_past_predictor(spark, sf):
    return M.past_predictor(cat(spark, sf).withColumn("fault", F.floor(F.col("series") / 3) % 4))


@query("m19_chance", "SELECT round(sum(n*(n-1)) / (sum(n)*(sum(n)-1)), 6) AS chance FROM (SELECT label, count(*)::DOUBLE AS n FROM embeddings GROUP BY label)")
def m19_chance(spark, sf):
    return M.chance_agreement(points(spark, sf), "cls").withColumn("chance", r("chance"))


@query("m20_fit_box", """WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), s AS (SELECT min(x) AS x0, min(y) AS y0, least(100 / (max(x) - min(x)), 60 / (max(y) - min(y))) AS k FROM p)
SELECT id, round((x - x0) * k, 6) AS bx, round((y - y0) * k, 6) AS by FROM p, s""")
def m20_fit_box(spark, sf):
    p = points(spark, sf).select("id", F.col("x")[0].cast("double").alias("px"), F.col("x")[1].cast("double").alias("py"))
    return M.fit_box(p, "px", "py", 100.0, 60.0).select("id", r("bx").alias("bx"), r("by").alias("by"))


FEATURES_SQL = FACT_SQL + """, st AS (SELECT entity AS id, channel, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS std FROM chan GROUP BY ALL),
l AS (SELECT channel FROM st GROUP BY channel HAVING count(*) FILTER (n > 0 AND std > 0) >= 0.5 * count(*)),
f AS (SELECT id, channel || ' | mean' AS feature, CASE WHEN n > 0 AND std > 0 THEN mean END AS v FROM st SEMI JOIN l USING (channel) UNION ALL SELECT id, channel || ' | std', CASE WHEN n > 0 AND std > 0 THEN std END FROM st SEMI JOIN l USING (channel)),
i AS (SELECT id, feature, coalesce(v, median(v) OVER (PARTITION BY feature), 0) AS v, v IS NULL AS missing FROM f)
"""


def imputed(spark, sf):
    from chronolith.plans.availability import long

    stats = long(spark, sf).groupBy(F.col("entity").alias("id"), "channel").agg(F.count("value").alias("n_valid"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return M.imputed(M.features(stats, ["mean", "std"]))


@query("m1_features", demo.with_daily(FEATURES_SQL + """SELECT id, feature, round((v - avg(v) OVER w) / stddev_pop(v) OVER w, 6) AS value, missing FROM i WINDOW w AS (PARTITION BY feature)"""))
def m1_features(spark, sf):
    return M.standardised(imputed(spark, sf)).select("id", "feature", r("value").alias("value"), "missing")


@query("m3_imputed_shares", demo.with_daily(FEATURES_SQL + "SELECT id, round(avg(missing::INT), 6) AS share FROM i GROUP BY id"))
def m3_imputed_shares(spark, sf):
    return M.imputed_share(imputed(spark, sf)).withColumn("share", r("share"))


#: Warping by cells, row after row of a pair's table: the last values of a row and one more are kept, the newest at the end.
WARPED_SQL = """WITH RECURSIVE e AS (SELECT user_id AS entity, value, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
bk AS (SELECT entity, ((i + 1) * least(40, n) - 1) // n AS block, avg(value) AS v FROM e WHERE n >= 32 GROUP BY ALL),
sc AS (SELECT entity, block, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS z FROM bk WINDOW w AS (PARTITION BY entity)),
arr AS (SELECT entity AS id, entity // 10 AS cls, list(z ORDER BY block) AS z FROM sc GROUP BY entity),
wd AS (SELECT cls, greatest(1, round_even(0.1 * max(len(z)), 0))::INT AS w FROM arr GROUP BY cls),
pr AS (SELECT x.cls, x.id AS a, y.id AS b, x.z AS x, y.z AS y, len(y.z) AS m, len(x.z) * len(y.z) AS total, w FROM arr x JOIN arr y ON x.cls = y.cls AND x.id < y.id JOIN wd ON wd.cls = x.cls),
st AS (SELECT cls, a, b, x, y, m, total, w, 0::BIGINT AS k, list_transform(range(m + 1), lambda i: 'inf'::DOUBLE) AS last FROM pr
 UNION ALL SELECT cls, a, b, x, y, m, total, w, k + 1, list_append(last[2:], CASE WHEN abs(k // m - k % m) > w THEN 'inf'::DOUBLE ELSE (x[k // m + 1] - y[k % m + 1]) ** 2
   + CASE WHEN k = 0 THEN 0 WHEN k % m = 0 THEN last[2] ELSE least(last[1], last[2], last[-1]) END END) FROM st WHERE k < total)
SELECT cls, a, b, round(sqrt(last[-1]), 6) AS d FROM st WHERE k = total"""


@query("m15_warped", WARPED_SQL)
def m15_warped(spark, sf):
    x = S.decimate(demo.events(spark, sf).withColumnRenamed("raw", "value"), 40, by=("entity",))
    z = x.groupBy("entity").agg(F.transform(F.sort_array(F.collect_list(F.struct("block", "z"))), lambda p: p.z).alias("z"))
    return M.warped(z.select(F.col("entity").alias("id"), F.floor(F.col("entity") / 10).alias("cls"), "z")).withColumn("d", r("d"))


VERDICT_SQL = RUNS_SQL + """, vs AS (SELECT samples.*, CASE WHEN rid % 13 <> 0 THEN (raw > 20)::INT END AS verdict FROM samples),
vc AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR verdict IS DISTINCT FROM lag(verdict) OVER w THEN 1 ELSE 0 END AS ch FROM vs WINDOW w AS (PARTITION BY series ORDER BY us, rid)),
vg AS (SELECT *, sum(ch) OVER (PARTITION BY series ORDER BY us, rid) AS run FROM vc),
vr AS (SELECT series, run, min(us) AS start, max(us) AS last, any_value(verdict) AS value FROM vg GROUP BY series, run),
ver AS (SELECT series, start, coalesce(lead(start) OVER (PARTITION BY series ORDER BY run), trunc(last + step_us)::BIGINT) AS "end", value FROM vr JOIN st USING (series)),
pt AS (SELECT s.series, s.fault, greatest(s.start, v.start) AS start, least(s."end", v."end") AS "end", v.value AS verdict, s.value AS value,
 CASE WHEN v.value IS NOT NULL AND s.value IS NOT NULL THEN (v.value <> 0) = (s.value <> 0) END AS agrees FROM seg s JOIN ver v ON v.series = s.series AND v.start < s."end" AND s.start < v."end")
"""


def parts(spark, sf):
    x = demo.samples(spark, sf).withColumn("verdict", F.when(F.col("rid") % 13 != 0, (F.col("raw") > 20).cast("int")))
    return G.split(I.label_segments(x, "verdict"), I.label_segments(x))


@query("g5_verdict_split", demo.with_samples(VERDICT_SQL + 'SELECT series, start, "end", verdict, value, agrees FROM pt'))
def g5_verdict_split(spark, sf):
    return parts(spark, sf)


AGREE = """, ag AS (SELECT series, sum(CASE WHEN verdict IS NOT NULL THEN ("end" - start) / 1e6 ELSE 0 END) AS scored, sum(CASE WHEN agrees IS NOT NULL THEN ("end" - start) / 1e6 ELSE 0 END) AS compared,
 sum(CASE WHEN agrees THEN ("end" - start) / 1e6 ELSE 0 END) AS agreed FROM pt GROUP BY series)
"""


@query("g2_agreement", demo.with_samples(VERDICT_SQL + AGREE + "SELECT series, round(scored, 6) AS scored, round(compared, 6) AS compared, round(agreed, 6) AS agreed, round(agreed / nullif(compared, 0), 6) AS share FROM ag"))
def g2_agreement(spark, sf):
    out = G.agreement(parts(spark, sf), ["series"])
    return out.select("series", *[r(c).alias(c) for c in ("scored", "compared", "agreed")], r("share").alias("share"))


@query("g3_agreement_members", demo.with_samples(VERDICT_SQL + "SELECT fault, round(sum(CASE WHEN agrees THEN (\"end\" - start) / 1e6 ELSE 0 END) / sum(CASE WHEN agrees IS NOT NULL THEN (\"end\" - start) / 1e6 ELSE 0 END), 6) AS share FROM pt GROUP BY fault"))
def g3_agreement_members(spark, sf):
    known = cat(spark, sf).select("series", "fault")
    return G.agreement(parts(spark, sf).join(known, "series"), ["fault"]).select("fault", r("share").alias("share"))


@query("g7_training_channels", demo.with_daily("""SELECT channel FROM (SELECT channel, entity % 3 AS g, count(value) AS n, stddev_pop(value) AS s FROM chan GROUP BY ALL) GROUP BY channel HAVING min(n) >= 50 AND min(s) > 0"""))
def g7_training_channels(spark, sf):
    return G.training_channels(demo.daily(spark, sf).withColumn("g", F.col("entity") % 3), TYPES, "g", 50)


CHART_CHANNELS = ["x", "y", "z"]


def chart_rows(spark, sf):
    x = spark.read.parquet(f"{sf}/lineitem.parquet")
    return x.select((F.col("l_suppkey") % 3).alias("grp"), "l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"), F.col("l_discount").cast("double").alias("z"), "l_returnflag")


@query("g8_chart")
def g8_chart(spark, sf):
    return G.fit_chart(chart_rows(spark, sf).where("l_returnflag = 'N'"), CHART_CHANNELS, "grp").select("grp", "t2_limit", "q_limit", F.size("variance").alias("components"))


@query("g9_chart_labels")
def g9_chart_labels(spark, sf):
    rows = chart_rows(spark, sf)
    model = G.fit_chart(rows.where("l_returnflag = 'N'"), CHART_CHANNELS, "grp")
    return G.chart_labels(rows.where("l_returnflag <> 'N'").withColumn("grp", F.col("grp").cast("long")), model, CHART_CHANNELS).select("l_orderkey", "l_linenumber", "grp", "label", "score")


@query("b7_coverage_facts", demo.with_daily(FACT_SQL + """SELECT channel, sum(n_valid) FILTER (state = 2)::BIGINT AS live, coalesce(sum(n_valid) FILTER (state = 1), 0)::BIGINT AS frozen, (sum(total) - coalesce(sum(n_valid) FILTER (state > 0), 0))::BIGINT AS missing,
 coalesce(sum(n_implausible) FILTER (state = 2), 0)::BIGINT AS problems, count(*) FILTER (state = 2) AS bars_live, row_number() OVER (ORDER BY sum(n_valid) FILTER (state = 2) DESC, channel) AS rank FROM fact GROUP BY channel"""))
def b7_coverage_facts(spark, sf):
    from pyspark.sql import Window

    s, n = F.col("state"), F.col("n_valid")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = fact(spark, sf).groupBy("channel").agg(F.sum(F.when(s == 2, n)).alias("live"), total(F.when(s == 1, n)).alias("frozen"), (F.sum("total") - total(F.when(s > 0, n))).alias("missing"), total(F.when(s == 2, F.col("n_implausible"))).alias("problems"), F.count_if(s == 2).alias("bars_live"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("live"), "channel")))


@query("b15_channel_pairs", demo.with_daily(FACT_SQL + """SELECT grp, channel, k AS rank FROM (SELECT grp, channel, row_number() OVER (PARTITION BY grp ORDER BY sum(n_valid) DESC, channel) AS k FROM fact WHERE channel <> 'view' GROUP BY grp, channel HAVING min(n_valid) > 0) WHERE k <= 2"""))
def b15_channel_pairs(spark, sf):
    from pyspark.sql import Window

    recorded = fact(spark, sf).where("channel <> 'view'").groupBy("grp", "channel").agg(F.sum("n_valid").alias("n"), F.min("n_valid").alias("s")).where("s > 0")
    return recorded.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("n"), "channel"))).where("rank <= 2").select("grp", "channel", "rank")


@query("b10_correlated_pairs", """SELECT l_returnflag AS period, count(*) AS n, round(corr(l_quantity::DOUBLE, l_discount::DOUBLE), 6) AS r FROM lineitem GROUP BY 1""")
def b10_correlated_pairs(spark, sf):
    x = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_returnflag").alias("period"), F.col("l_quantity").cast("double").alias("q"), F.col("l_discount").cast("double").alias("d"))
    return x.groupBy("period").agg(F.count(F.lit(1)).alias("n"), r(D.pearson("q", "d")).alias("r"))


@query("g10_scoring_report", """WITH x AS (SELECT l_suppkey AS grp, l_suppkey * 10 + l_linenumber AS recording, l_linenumber, l_returnflag, l_quantity::DOUBLE AS a, l_extendedprice::DOUBLE AS b, l_discount::DOUBLE AS c FROM lineitem),
m AS (SELECT grp, count(*) AS training_samples, count(*) >= 200 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 AND stddev_pop(c) > 0 AS scored FROM x WHERE l_returnflag = 'N' AND a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL GROUP BY grp)
SELECT grp, recording, coalesce(training_samples, 0) AS training_samples, coalesce(scored, false) AS scored FROM (SELECT DISTINCT grp, recording FROM x WHERE l_linenumber IN (1, 3)) LEFT JOIN m USING (grp)""")
def g10_scoring_report(spark, sf):
    return scored_recordings(spark, sf)[1]


def scored_recordings(spark, sf):
    """Recordings are a supplier's lines of one number; the model of a supplier is fitted on the lines with flag N."""
    x = spark.read.parquet(f"{sf}/lineitem.parquet")
    readings = [F.col(c).cast("double").alias(n) for n, c in zip(CHART_CHANNELS, ("l_quantity", "l_extendedprice", "l_discount"))]
    entity = F.col("l_suppkey").cast("long")
    rows = x.select(entity.alias("entity"), (entity * 10 + F.col("l_linenumber")).alias("recording"), "l_linenumber", "l_returnflag", *readings)
    return G.scoring_job(rows, CHART_CHANNELS, "recording", "entity", F.col("l_returnflag") == "N", F.col("l_linenumber").isin(1, 3), 200)


M2_SQL = ACF_SQL + ", sn AS (" + SNR.replace("series", "entity").replace("samples", "(SELECT entity, us, rid, raw AS value FROM ev)") + """), sp AS (SELECT entity, (max(us) - min(us)) / 1e6 / count(*) AS spacing, count(*) AS n, stddev_pop(raw) AS std FROM ev GROUP BY entity)
, f AS (SELECT sp.entity AS id, n > 0 AND std > 0 AS live, acf_half_s, snr, spacing, std FROM sp LEFT JOIN half USING (entity) LEFT JOIN sn USING (entity)),
u AS (SELECT id, 'raw | acf' AS feature, CASE WHEN live THEN log10(greatest(1, least(acf_half_s, 216000))) END AS value FROM f UNION ALL SELECT id, 'raw | snr', CASE WHEN live THEN log10(greatest(1e-3, least(snr, 1e9))) END FROM f
 UNION ALL SELECT id, 'raw | spacing', CASE WHEN live THEN log10(greatest(spacing, 1)) END FROM f UNION ALL SELECT id, 'raw | std', CASE WHEN live THEN std END FROM f)
SELECT id, feature, round(value, 6) AS value FROM u"""


@query("m2_transforms", demo.with_samples(M2_SQL))
def m2_transforms(spark, sf):
    x, step = acf_rows(spark, sf)
    by = ("entity",)
    stats = x.groupBy("entity").agg(F.count("value").alias("n_valid"), F.stddev_pop("value").alias("std"), ((F.max("us") - F.min("us")) / 1e6 / F.count(F.lit(1))).alias("spacing"))
    stats = stats.join(S.autocorrelation_half(x, step, by=by, longest_s=1e7).withColumnRenamed("acf_half_s", "acf"), "entity", "left").join(S.signal_to_noise(x, by=by), "entity", "left")
    out = M.features(stats.withColumnRenamed("entity", "id").withColumn("channel", F.lit("raw")), ["acf", "snr", "spacing", "std"], 0.0)
    return out.withColumn("value", r("value"))
