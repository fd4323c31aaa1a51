"""Queries of windows, separation, distributions, spectra and clouds."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.functions import labels as L
from chronolith.operators import distribution as D
from chronolith.operators import spectra as P
from chronolith.operators import intervals as I
from chronolith.operators import series as S
from chronolith.operators import windows as W
from chronolith.plans.intervals import CAT_SQL, cat
from chronolith.plans.registry import query
from chronolith.plans.series import KINDS, moments_sql, r, rounded_moments
from chronolith.sources import demo
from chronolith.sources.shared import stored

SIZE = 3

#: Runs of entities, cut into windows of three events; repeated samples of overlapping recordings are dropped.
CUT_SQL = CAT_SQL + """, q AS (SELECT series AS s, max("end") OVER (PARTITION BY entity ORDER BY start, "end", series ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM cat),
k0 AS (SELECT samples.*, NOT coalesce(us <= e, false) AS keep FROM samples JOIN q ON q.s = samples.series),
k1 AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR label IS DISTINCT FROM lag(label) OVER w OR keep <> lag(keep) OVER w THEN 1 ELSE 0 END AS ch FROM k0 WINDOW w AS (PARTITION BY series ORDER BY us, rid)),
k2 AS (SELECT *, sum(ch) OVER (PARTITION BY series ORDER BY us, rid) AS run2 FROM k1),
k3 AS (SELECT *, (row_number() OVER (PARTITION BY series, run2 ORDER BY us, rid) - 1) % 3 AS "at" FROM k2 WHERE keep),
placed AS (SELECT *, sum(("at" = 0)::INT) OVER (PARTITION BY series ORDER BY us, rid) - 1 AS win FROM k3)
"""


def placed(spark, sf):
    x = I.repeated_samples(demo.samples(spark, sf), cat(spark, sf)).withColumn("keep", ~F.col("repeated"))
    return W.cut(x, SIZE, "keep")


@query("w1_cut", demo.with_samples(CUT_SQL + "SELECT series, rid, win::BIGINT AS window, \"at\" FROM placed"))
def w1_cut(spark, sf):
    return placed(spark, sf).select("series", "rid", "window", "at")


@query("w2_windows", demo.with_samples(CUT_SQL + """SELECT series, win::BIGINT AS window, min(us) AS start, any_value(label) AS label, count(*) AS n_valid, round(1 - count(value) / count(*), 6) AS nan_share,
 count(*) < 3 AS padded, coalesce(sum(value), 0) AS total FROM placed GROUP BY series, win"""))
def w2_windows(spark, sf):
    out = W.windows(placed(spark, sf), SIZE)
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    return out.select("series", "window", "start", "label", "n_valid", r("nan_share").alias("nan_share"), "padded", total.alias("total"))


@query("w4_described", demo.with_samples(CUT_SQL + ", p AS (SELECT series * 1000 + win AS id, value FROM placed) " + moments_sql("p", "id")))
def w4_described(spark, sf):
    x = placed(spark, sf).withColumn("id", F.col("series") * 1000 + F.col("window"))
    return rounded_moments(S.moments(x, by=("id",)))


@query("w5_complete", demo.with_samples(CUT_SQL + "SELECT series, win::BIGINT AS window FROM placed GROUP BY series, win HAVING any_value(label) IN (0, 2) AND count(*) = 3 AND count(value) = 3"))
def w5_complete(spark, sf):
    return W.complete(W.windows(placed(spark, sf), SIZE), [0, 2]).select("series", "window")


@query("w9_neighbour_breaks", demo.with_samples(CUT_SQL + """, w AS (SELECT series, win, min(us) AS start, max(us) AS last FROM placed GROUP BY series, win)
SELECT series, win::BIGINT AS window, coalesce(start - lag(last) OVER (PARTITION BY series ORDER BY win) > 86400000000, false) AS breaks FROM w"""))
def w9_neighbour_breaks(spark, sf):
    return W.neighbour_breaks(W.windows(placed(spark, sf), SIZE), 86_400_000_000).select("series", "window", "breaks")


@query("w11_page", demo.with_samples(CUT_SQL + "SELECT series, win::BIGINT AS window FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY win) AS k FROM (SELECT DISTINCT series, win FROM placed)) WHERE k BETWEEN 5 AND 8"))
def w11_page(spark, sf):
    return W.page(W.windows(placed(spark, sf), SIZE), 1, 4).select("series", "window")


AUC_SQL = """WITH k AS (SELECT user_id % 10 AS grp, floor(value) AS v, event_type = 'error' AS e FROM events WHERE event_type IN ('error', 'view')),
t AS (SELECT grp, v, count(*) FILTER (e) AS e, count(*) FILTER (NOT e) AS n FROM k GROUP BY grp, v),
u AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY grp ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM t),
a AS (SELECT grp, sum(e)::BIGINT AS n_event, sum(n)::BIGINT AS n_normal, sum(e * (below + n / 2)) / (sum(e) * sum(n)) AS auc FROM u GROUP BY grp HAVING sum(e) >= 5 AND sum(n) >= 5)
SELECT grp, n_event, n_normal, round(auc, 6) AS auc, round(2 * abs(auc - 0.5), 6) AS separation FROM a"""


@query("w6_auc", AUC_SQL)
def w6_auc(spark, sf):
    x = demo.events(spark, sf).where("event_type in ('error', 'view')").select((F.col("entity") % 10).alias("grp"), F.floor("raw").cast("double").alias("v"), F.col("event_type").alias("t"))
    return W.auc(x, "v", F.col("t") == "error", ["grp"]).withColumns({"auc": r("auc"), "separation": r("separation")})


#: Suppliers are wells, their lines in order of shipping the samples, those of the second half of a year the event; readings are missing here and there.
WELLS_SQL = """WITH li AS (SELECT l_suppkey AS well, l_orderkey AS o, l_linenumber AS n, l_shipdate AS d, (month(l_shipdate) > 6)::INT AS label, CASE WHEN (l_orderkey + l_suppkey) % 5 <> 0 THEN l_quantity::DOUBLE END AS quantity,
 CASE WHEN (3 * l_orderkey + l_suppkey) % 7 <> 0 THEN l_extendedprice::DOUBLE END AS price, CASE WHEN (l_linenumber + l_suppkey) % 6 <> 0 THEN l_discount::DOUBLE END AS discount FROM lineitem),
cv AS (SELECT well, channel, v, o, n, d, label FROM li UNPIVOT INCLUDE NULLS (v FOR channel IN (quantity, price, discount))),
bst AS (SELECT well, channel FROM (SELECT well, channel, row_number() OVER (PARTITION BY well ORDER BY count(v) DESC, channel) AS k FROM cv GROUP BY well, channel) WHERE k = 1),
x0 AS (SELECT cv.* FROM cv JOIN bst USING (well, channel)),
x1 AS (SELECT *, CASE WHEN label = lag(label) OVER w THEN 0 ELSE 1 END AS c FROM x0 WINDOW w AS (PARTITION BY well ORDER BY d, o, n)),
x2 AS (SELECT *, sum(c) OVER (PARTITION BY well ORDER BY d, o, n) AS run FROM x1),
x3 AS (SELECT *, row_number() OVER (PARTITION BY well, run ORDER BY d, o, n) - 1 AS i FROM x2),
x4 AS (SELECT size, well, channel, run, i // size AS win, label, i, v, v - lag(v) OVER (PARTITION BY size, well, run, i // size, v IS NULL ORDER BY i) AS dv FROM x3, (VALUES (8), (16), (32)) z(size)),
x5 AS (SELECT *, avg(v) OVER p AS m, count(*) OVER p AS rows_ FROM x4 WINDOW p AS (PARTITION BY size, well, run, win)),
x6 AS (SELECT size, well, channel, any_value(label) AS label, count(v) AS k, min(v) AS low, max(v) AS high, any_value(m) AS mean, avg((v - m) ** 2) AS m2, avg((v - m) ** 3) AS m3, avg((v - m) ** 4) AS m4, avg(dv * dv) AS dd,
 quantile_cont(v, [0.05, 0.25, 0.5, 0.75, 0.95]) AS q FROM x5 WHERE rows_ = size GROUP BY size, well, channel, run, win),
x7 AS (SELECT size, well, channel, label, CASE WHEN low = high THEN low ELSE mean END AS mean, CASE WHEN low = high THEN 0 ELSE sqrt(m2) END AS std, CASE WHEN low < high AND k >= 8 THEN m3 / m2 ** 1.5 END AS skew, CASE WHEN low < high AND k >= 8 THEN m4 / m2 ** 2 - 3 END AS kurtosis,
 q[1] AS q05, q[2] AS q25, q[3] AS median, q[4] AS q75, q[5] AS q95, low, high, CASE WHEN low < high AND k >= 8 THEN m2 / (dd / 2) END AS snr FROM x6),
x8 AS (SELECT size, well, channel, label, stat, round(v, 6) AS v FROM (UNPIVOT x7 ON mean, std, skew, kurtosis, q05, q25, median, q75, q95, low, high, snr INTO NAME stat VALUE v)),
t AS (SELECT size, well, channel, stat, v, count(*) FILTER (label <> 0) AS e, count(*) FILTER (label = 0) AS n FROM x8 GROUP BY ALL),
u AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY size, well, stat ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM t),
study AS (SELECT well, channel, size, stat, sum(e)::BIGINT AS n_event, sum(n)::BIGINT AS n_normal, 2 * abs(sum(e * (below + n / 2)) / (sum(e) * sum(n)) - 0.5) AS separation FROM u GROUP BY ALL HAVING sum(e) >= 5 AND sum(n) >= 5)
"""


def study(spark, sf):
    from pyspark.sql import Window

    x = spark.read.parquet(f"{sf}/lineitem.parquet")
    o, k, n = F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_linenumber")
    quantity, price, discount = F.when((o + k) % 5 != 0, F.col("l_quantity")), F.when((3 * o + k) % 7 != 0, F.col("l_extendedprice")), F.when((n + k) % 6 != 0, F.col("l_discount"))
    rows = x.select(k.alias("well"), o.alias("o"), n.alias("n"), F.col("l_shipdate").alias("d"), (F.month("l_shipdate") > 6).cast("int").alias("label"), quantity.cast("double").alias("quantity"), price.cast("double").alias("price"), discount.cast("double").alias("discount"))
    # counts of all channels at once say which one of a well is covered best
    channels = ("discount", "price", "quantity")
    counts = rows.groupBy("well").agg(*[F.count(c).alias(c) for c in channels])
    best = counts.select("well", F.greatest(*channels).alias("_m"), *channels).select("well", F.coalesce(*[F.when(F.col(c) == F.col("_m"), c) for c in channels]).alias("channel"))
    value = F.coalesce(*[F.when(F.col("channel") == c, F.col(c)) for c in channels])
    return W.separation_study(rows.join(best, "well").withColumn("value", value), (8, 16, 32), ("well", "channel"), ("d", "o", "n"))


@query("b14_separation_study", WELLS_SQL + "SELECT well, channel, size, stat, n_event, n_normal, round(separation, 6) AS separation FROM study")
def b14_separation_study(spark, sf):
    """Of each well's best covered channel, how well twelve statistics of windows of three sizes tell events from normal operation."""
    return study(spark, sf).withColumn("separation", r("separation"))


@query("b14_best_statistics", WELLS_SQL + "SELECT well, size, stat, round(separation, 6) AS separation FROM study QUALIFY row_number() OVER (PARTITION BY well, size ORDER BY round(separation, 9) DESC, stat) = 1")
def b14_best_statistics(spark, sf):
    return W.best_statistics(study(spark, sf), ["well", "size"]).withColumn("separation", r("separation"))


@query("b14_wins", WELLS_SQL + """, f AS (SELECT size, stat FROM study QUALIFY row_number() OVER (PARTITION BY well, size ORDER BY round(separation, 9) DESC, stat) = 1)
SELECT size, stat, (SELECT count(*) FROM f WHERE f.size = study.size AND f.stat = study.stat) AS wins, round(median(separation), 6) AS median FROM study GROUP BY size, stat""")
def b14_wins(spark, sf):
    return W.wins(stored(study(spark, sf), "study"), ["well"]).withColumn("median", r("median"))


@query("h1_histogram", """WITH s AS (SELECT user_id % 10 AS grp, event_type AS kind, value FROM events), x AS (SELECT grp, min(value) AS a, max(value) AS b FROM s GROUP BY grp),
c AS (SELECT grp, kind, least(floor((value - a) / (b - a) * 20), 19)::INT AS bin, count(*) AS n FROM s JOIN x USING (grp) GROUP BY ALL),
g AS (SELECT DISTINCT grp, kind, unnest(range(20))::INT AS bin FROM s) SELECT grp, kind, bin, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (grp, kind, bin)""")
def h1_histogram(spark, sf):
    return D.histogram(hist_rows(spark, sf), "raw", 20, ["grp"], "kind")


def hist_rows(spark, sf):
    return demo.events(spark, sf).select((F.col("entity") % 10).alias("grp"), F.col("event_type").alias("kind"), "raw")


@query("h1_histogram_edges", """SELECT user_id % 10 AS grp, CASE WHEN value >= 0 AND value < 25 THEN 0 WHEN value >= 25 AND value < 50 THEN 1 WHEN value >= 50 AND value <= 100 THEN 2 ELSE -1 END AS bin, count(*) AS n FROM events GROUP BY ALL""")
def h1_histogram_edges(spark, sf):
    return D.histogram_edges(hist_rows(spark, sf), "raw", [0, 25, 50, 100], ["grp"])


@query("h1_histogram_facts", """SELECT user_id % 10 AS grp, count(*) FILTER (value BETWEEN 5 AND 150) AS n, count(*) FILTER (value < 5 OR value > 150) AS left_out,
 round(avg(value) FILTER (value BETWEEN 5 AND 150), 6) AS mean, round(quantile_cont(value, 0.5) FILTER (value BETWEEN 5 AND 150), 6) AS median FROM events GROUP BY grp HAVING count(*) FILTER (value BETWEEN 5 AND 150) > 0""")
def h1_histogram_facts(spark, sf):
    return D.histogram_facts(hist_rows(spark, sf), "raw", ["grp"], 5.0, 150.0).withColumns({"mean": r("mean"), "median": r("median")})


@query("h2_peaks", """WITH s AS (SELECT user_id % 10 AS grp, value FROM events), x AS (SELECT grp, min(value) AS a, max(value) AS b FROM s GROUP BY grp),
c AS (SELECT grp, least(floor((value - a) / (b - a) * 20), 19)::INT AS bin, count(*) AS n FROM s JOIN x USING (grp) GROUP BY ALL)
SELECT grp, sum(n)::BIGINT AS total, arg_max(bin, struct_pack(a := n, b := -bin)) AS peak FROM c GROUP BY grp""")
def h2_peaks(spark, sf):
    return D.peak(D.histogram(hist_rows(spark, sf), "raw", 20, ["grp"], "kind"), ["grp"])


@query("h3_shared_edges", """WITH x AS (SELECT min(value) AS a, max(value) AS b FROM events) SELECT event_type AS kind, least(floor((value - a) / (b - a) * 16), 15)::INT AS bin, count(*) AS n FROM events, x GROUP BY ALL""")
def h3_shared_edges(spark, sf):
    return D.histogram(hist_rows(spark, sf), "raw", 16, [], "kind").where("n > 0")


@query("w8_density", """WITH x AS (SELECT event_type, quantile_cont(value, 0.005) AS a, quantile_cont(value, 0.995) AS b FROM events GROUP BY event_type)
SELECT event_type AS kind, least(floor((value - a) / (b - a) * 40), 39)::INT AS bin, count(*) AS n FROM events JOIN x USING (event_type) WHERE value BETWEEN a AND b GROUP BY ALL""")
def w8_density(spark, sf):
    x = hist_rows(spark, sf)
    span = x.groupBy("kind").agg(F.percentile("raw", [0.005, 0.995]).alias("q"))
    at = x.join(span, "kind")
    return at.groupBy("kind", D.bin_of(F.col("raw"), F.col("q")[0], F.col("q")[1], 40).alias("bin")).agg(F.count(F.lit(1)).alias("n")).where("bin is not null")


LOMB_SQL = """WITH e0 AS (SELECT user_id AS entity, value AS y, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events WHERE value IS NOT NULL),
f0 AS (SELECT entity, count(*) AS n, min(us) AS t0, (max(us) - min(us)) / 1e6 AS span, avg(y) AS mean, var_pop(y) AS yy, greatest(2 * median(gap) / 1e6, 2) AS a FROM e0 GROUP BY entity HAVING count(*) >= 8),
f AS (SELECT *, CASE WHEN span <= a THEN 2 * a ELSE span END AS b FROM f0),
p AS (SELECT entity, k, 10 ** (log10(a) + (log10(b) - log10(a)) * k / 399) AS period FROM f, range(400) r(k)),
e AS (SELECT entity, (us - t0) / 1e6 AS t, y - mean AS y FROM e0 JOIN f USING (entity)),
m0 AS (SELECT entity, k, period, y, cos(2 * pi() / period * t) AS c, sin(2 * pi() / period * t) AS s FROM e JOIN p USING (entity)),
m AS (SELECT entity, k, period, avg(c * c) - avg(c) ** 2 AS cc, avg(s * s) - avg(s) ** 2 AS ss, avg(c * s) - avg(c) * avg(s) AS cs, avg(y * c) AS yc, avg(y * s) AS ys FROM m0 GROUP BY ALL),
x AS (SELECT entity, k, period, yy, span, (ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / (yy * (cc * ss - cs * cs)) AS v FROM m JOIN f USING (entity)),
q AS (SELECT entity, k, period, yy, round(span) AS span_s, CASE WHEN isfinite(v) THEN greatest(0, least(1, v)) ELSE 0 END AS explained FROM x),
area AS (SELECT entity, sum(v) AS area FROM (SELECT entity, (explained + lead(explained) OVER w) / 2 * (1 / period - 1 / lead(period) OVER w) AS v FROM q WINDOW w AS (PARTITION BY entity ORDER BY k)) GROUP BY entity),
spec AS (SELECT entity, k, period, explained, CASE WHEN area > 0 THEN explained * yy / area ELSE explained END AS density, span_s FROM q JOIN area USING (entity))
"""


def lomb(spark, sf):
    return P.periodogram(demo.events(spark, sf), "raw", ("entity",))


@query("h5_lomb_scargle", LOMB_SQL + "SELECT entity, k::INT AS k, round(period, 3) AS period, round(explained, 6) AS explained FROM spec")
def h5_lomb_scargle(spark, sf):
    return lomb(spark, sf).select("entity", "k", r("period", 3).alias("period"), r("explained").alias("explained"))


@query("h7_dominant_period", LOMB_SQL + "SELECT entity, round(arg_max(period, struct_pack(a := density, b := -k)), 3) AS period, round(arg_max(explained, struct_pack(a := density, b := -k)), 6) AS explained FROM spec WHERE period <= span_s / 4 GROUP BY entity")
def h7_dominant_period(spark, sf):
    return P.dominant_period(lomb(spark, sf), ["entity"]).select("entity", r("period", 3).alias("period"), r("explained").alias("explained"))


@query("h8_log_bins", LOMB_SQL + """, z AS (SELECT entity, min(log10(period)) AS a, max(log10(period)) AS b FROM spec GROUP BY entity)
SELECT entity, least(floor((log10(period) - a) / (b - a) * 160), 159)::INT AS bin, round(10 ** (any_value(a) + any_value(b - a) * (any_value(least(floor((log10(period) - a) / (b - a) * 160), 159)) + 0.5) / 160), 3) AS center, round(avg(density) / 1000, 1) AS density
FROM spec JOIN z USING (entity) GROUP BY ALL""")
def h8_log_bins(spark, sf):
    return P.log_bands(lomb(spark, sf), ["entity"]).select("entity", "bin", r("center", 3).alias("center"), r(F.col("density") / 1000, 1).alias("density"))


WELCH_SQL = """, wf AS (SELECT entity, min(us) AS a, max(us) AS b FROM ev GROUP BY entity), wc AS (SELECT entity, unnest(range(0, (b - a) // 21600000000 + 1)) AS cell FROM wf),
wv AS (SELECT entity, (us - a) // 21600000000 AS cell, arg_max_null(raw, struct_pack(u := us, r := rid)) AS v FROM ev JOIN wf USING (entity) GROUP BY ALL),
wk AS (SELECT entity, cell, v, last_value(CASE WHEN v IS NOT NULL THEN cell END IGNORE NULLS) OVER w AS ax, last_value(v IGNORE NULLS) OVER w AS ay,
 first_value(CASE WHEN v IS NOT NULL THEN cell END IGNORE NULLS) OVER u AS bx, first_value(v IGNORE NULLS) OVER u AS b_y FROM wc LEFT JOIN wv USING (entity, cell)
 WINDOW w AS (PARTITION BY entity ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), u AS (PARTITION BY entity ORDER BY cell ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
wg AS (SELECT entity, cell, coalesce(v, CASE WHEN bx > ax THEN ay + (b_y - ay) * (cell - ax) / (bx - ax) END, ay, b_y) AS y FROM wk),
wn AS (SELECT entity, count(*) AS n, least(count(*), 32) AS size, greatest(1, least(count(*), 32) // 2) AS hop FROM wg GROUP BY entity HAVING count(*) >= 4 AND count(y) = count(*)),
ws AS (SELECT entity, size, hop, unnest(range(0, (n - size) // hop + 1)) AS seg FROM wn),
wp AS (SELECT entity, seg, size, cell - seg * hop AS t, y FROM ws JOIN wg USING (entity) WHERE cell >= seg * hop AND cell < seg * hop + size),
wd AS (SELECT p.entity, p.seg, p.size, t, (y - (s * t + i)) * (0.5 - 0.5 * cos(2 * pi() * t / (p.size - 1))) AS y, power(0.5 - 0.5 * cos(2 * pi() * t / (p.size - 1)), 2) AS h FROM wp p
 JOIN (SELECT entity, seg, regr_slope(y, t) AS s, regr_intercept(y, t) AS i FROM wp GROUP BY ALL) USING (entity, seg)),
wx AS (SELECT entity, seg, size, k, (power(sum(y * cos(2 * pi() * k * t / size)), 2) + power(sum(y * sin(2 * pi() * k * t / size)), 2)) * 21600 / sum(h) * CASE WHEN 2 * k = size THEN 1 ELSE 2 END AS p
 FROM wd, (SELECT unnest(range(1, 17)) AS k) WHERE k <= size // 2 GROUP BY entity, seg, size, k),
welch AS (SELECT entity, size * 21600.0 / k AS period, avg(p) AS psd FROM wx GROUP BY entity, size, k)
"""


def welch(spark, sf):
    return D.welch(demo.events(spark, sf).withColumnRenamed("raw", "value"), 21_600_000_000, 32, by=("entity",))


@query("h4_welch", demo.with_samples(WELCH_SQL + "SELECT entity, round(period, 3) AS period, round(psd, 1) AS psd FROM welch"))
def h4_welch(spark, sf):
    return welch(spark, sf).select("entity", r("period", 3).alias("period"), r("psd", 1).alias("psd"))


@query("h9_average_spectra", demo.with_samples(WELCH_SQL + """, sp AS (SELECT ln(min(period)) AS a, ln(max(period)) AS b FROM welch), g AS (SELECT point, a + (b - a) * point / 39 AS x FROM sp, (SELECT unnest(range(0, 40)) AS point)),
n AS (SELECT *, lead(period) OVER w AS p1, lead(psd) OVER w AS v1 FROM welch WINDOW w AS (PARTITION BY entity ORDER BY period))
SELECT entity % 5 AS grp, point, round(exp(x), 3) AS period, round(avg(coalesce(psd + (v1 - psd) * (exp(x) - period) / (p1 - period), psd)), 1) AS value, count(*) AS n
FROM n JOIN g ON exp(x) >= period * (1 - 1e-9) AND exp(x) < coalesce(p1 * (1 - 1e-9), period * (1 + 1e-9)) GROUP BY entity % 5, point, x"""))
def h9_average_spectra(spark, sf):
    x = D.average_spectra(welch(spark, sf), ["entity"], F.col("entity") % 5)
    return x.withColumns({"period": r("period", 3), "value": r("value", 1)})


@query("c1_cloud", demo.with_samples(KINDS + """SELECT series, rid, kind = 0 AS genuine, CASE WHEN label = 0 THEN 0 WHEN label BETWEEN 1 AND 99 THEN 2 WHEN label > 100 THEN 1 ELSE 3 END AS period, round((us - a) / 1e6, 3) AS seconds FROM
 (SELECT *, row_number() OVER (PARTITION BY series ORDER BY us, rid) - 1 AS i, count(*) OVER (PARTITION BY series) AS m, min(us) OVER (PARTITION BY series) AS a FROM kinds) WHERE i % ceil(m / 4.0)::BIGINT = 0"""))
def c1_cloud(spark, sf):
    return D.cloud(demo.samples(spark, sf), 4, 1, least=4).select("series", "rid", "genuine", "period", r("seconds", 3).alias("seconds"))


@query("c3_density", """WITH s AS (SELECT l_suppkey % 5 AS grp, l_quantity AS x, l_extendedprice AS y FROM lineitem), m AS (SELECT grp, min(x) AS xa, max(x) AS xb, min(y) AS ya, max(y) AS yb FROM s GROUP BY grp)
SELECT grp, least(floor((x - xa) / (xb - xa) * 120), 119)::INT AS bx, least(floor((y - ya) / (yb - ya) * 120), 119)::INT AS by_, count(*) AS n FROM s JOIN m USING (grp) GROUP BY ALL""")
def c3_density(spark, sf):
    x = items(spark, sf)
    return D.density(x, "x", "y", 120, ["grp"])


def items(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").select((F.col("l_suppkey") % 5).alias("grp"), F.col("l_returnflag").alias("period"), F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"), F.col("l_discount").alias("z"))


@query("b16_correlations", """SELECT period, grp, count(*) AS n, round(corr(x, y), 6) AS r, CASE WHEN grp IS NULL THEN 1 ELSE 0 END AS level, count(*) < 30 AS few FROM
 (SELECT l_suppkey % 5 AS grp, l_returnflag AS period, l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y FROM lineitem) GROUP BY GROUPING SETS ((period), (period, grp))""")
def b16_correlations(spark, sf):
    out = D.correlations(items(spark, sf), "x", "y", [["period"], ["period", "grp"]])
    return out.withColumns({"r": r("r"), "level": F.col("level").cast("int")})


@query("c2_pair_rows", demo.with_daily("SELECT state % 2 AS period, count(*) AS candidates, count(*) FILTER (purchase < 100) AS n, round(corr(purchase, view) FILTER (purchase < 100), 6) AS r FROM daily WHERE purchase IS NOT NULL AND view IS NOT NULL GROUP BY 1"))
def c2_pair_rows(spark, sf):
    x = demo.daily(spark, sf).where("purchase is not null and view is not null").withColumn("p", L.plausible(F.col("purchase"), F.lit(0.0), F.lit(99.999999)))
    return x.groupBy((F.col("state") % 2).alias("period")).agg(F.count(F.lit(1)).alias("candidates"), F.count("p").alias("n"), r(D.pearson("p", "view")).alias("r"))
