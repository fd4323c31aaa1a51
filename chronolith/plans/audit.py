"""Queries of the audit reports, over recordings derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.functions import labels as L
from chronolith.operators import audit as A
from chronolith.operators import intervals as I
from chronolith.plans.intervals import GROUPS_SQL, MERGED_SQL, RUNS_SQL, grouped
from chronolith.plans.registry import query
from chronolith.plans.series import KIND_SQL, r
from chronolith.sources import demo
from chronolith.sources.shared import stored


@query("b1_overlap_facts", demo.with_samples(GROUPS_SQL + """, o AS (SELECT a AS s, entity FROM pairs UNION SELECT b, entity FROM pairs)
SELECT (SELECT count(*) FROM pairs) AS pairs, (SELECT count(*) FROM bad) AS collisions, (SELECT count(DISTINCT s) FROM o) AS n_series, (SELECT count(DISTINCT entity) FROM o) AS entities,
 (SELECT count(*) FROM samples) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT entity, us FROM samples)) AS n_distinct,
 (SELECT count(*) FROM pairs p JOIN cat x ON x.series = p.a JOIN cat y ON y.series = p.b WHERE x.fault <> y.fault) AS pairs_across, (SELECT count(*) FROM (SELECT entity, bar FROM grp GROUP BY 1, 2 HAVING count(*) > 1)) AS joined_bars"""))
def b1_overlap_facts(spark, sf):
    x = demo.samples(spark, sf)
    bars = grouped(spark, sf)
    pairs = stored(I.agreements(bars), "pairs")
    faults = bars.select(F.col("series").alias("b"), F.col("fault").alias("_b"))
    across = pairs.join(bars.select(F.col("series").alias("a"), F.col("fault").alias("_a")), "a").join(faults, "b").agg(F.count_if(F.col("_a") != F.col("_b")).alias("pairs_across"))
    joined = bars.groupBy("entity", "bar").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("joined_bars"))
    met = pairs.select("entity", F.explode(F.array("a", "b")).alias("s"))
    facts = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(~F.col("agree")).alias("collisions"))
    who = met.agg(F.count_distinct("s").alias("n_series"), F.count_distinct("entity").alias("entities"))
    size = x.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("entity", "us").alias("n_distinct"))
    one = lambda df: df.withColumn("_k", F.lit(0))
    return one(facts).join(one(who), "_k").join(one(size), "_k").join(one(across), "_k").join(one(joined), "_k").drop("_k")


@query("b2_label_time_shares", demo.with_samples(RUNS_SQL + f""", k AS (SELECT fault, ("end" - start) / 1e6 AS s, {KIND_SQL.replace('label', 'value')} AS kind FROM seg)
SELECT fault, kind, round(sum(s), 0) AS seconds, round(sum(s) / sum(sum(s)) OVER (PARTITION BY fault), 6) AS share, count(*) AS n_runs FROM k GROUP BY fault, kind"""))
def b2_label_time_shares(spark, sf):
    """Seconds under each kind of label, and their shares, for every class."""
    from pyspark.sql import Window

    seg = I.label_segments(demo.samples(spark, sf), by=("fault", "series"))
    rows = seg.groupBy("fault", L.label_kind(F.col("value")).alias("kind")).agg(F.sum((F.col("end") - F.col("start")) / 1e6).alias("s"), F.count(F.lit(1)).alias("n_runs"))
    share = F.col("s") / F.sum("s").over(Window.partitionBy("fault"))
    return rows.select("fault", "kind", r("s", 0).alias("seconds"), r(share).alias("share"), "n_runs")


@query("b3_joined_time_shares", demo.with_samples(MERGED_SQL + f""", k AS (SELECT c.fault, (m."end" - m.start) / 1e6 AS s, {KIND_SQL.replace('label', 'value')} AS kind FROM merged m JOIN cat c ON c.series = m.source)
SELECT fault, kind, round(sum(s), 0) AS seconds, round(sum(s) / sum(sum(s)) OVER (PARTITION BY fault), 6) AS share FROM k GROUP BY fault, kind"""))
def b3_joined_time_shares(spark, sf):
    """Seconds under each kind of label with each instant once, by the class of the recording that speaks for it."""
    from pyspark.sql import Window

    bars = grouped(spark, sf)
    m = I.merge_runs(bars).join(bars.select(F.col("series").alias("source"), "fault"), "source")
    rows = m.groupBy("fault", L.label_kind(F.col("value")).alias("kind")).agg(F.sum((F.col("end") - F.col("start")) / 1e6).alias("s"))
    return rows.select("fault", "kind", r("s", 0).alias("seconds"), r(F.col("s") / F.sum("s").over(Window.partitionBy("fault"))).alias("share"))


#: Label tracks before recordings are joined (one for each file) and after (one for each bar).
TRACKS_SQL = MERGED_SQL + """, h0 AS (SELECT *, CASE WHEN value IS NOT DISTINCT FROM lag(value) OVER w AND start = lag("end") OVER w THEN 0 ELSE 1 END AS c FROM merged WINDOW w AS (PARTITION BY entity, bar ORDER BY start)),
h1 AS (SELECT *, sum(c) OVER (PARTITION BY entity, bar ORDER BY start) AS k FROM h0),
hist AS (SELECT entity, bar, min(start) AS start, max("end") AS "end", any_value(value) AS value, list_sort(list(DISTINCT fault)) AS folders FROM h1 JOIN (SELECT series AS source, fault FROM cat) USING (source) GROUP BY entity, bar, k),
tracks AS (SELECT 'file' AS stage, entity, series AS track, start, "end", value, [fault] AS folders FROM seg UNION ALL SELECT 'joined', entity, bar, start, "end", value, folders FROM hist)
"""


def tracks(spark, sf):
    """stage (file or joined), entity, track (the recording or bar), start, end, value, folders (faults of the recordings that supply it)."""
    bars = grouped(spark, sf)
    faults = bars.select(F.col("series").alias("source"), "fault")
    files = bars.select(F.lit("file").alias("stage"), "entity", F.col("series").alias("track"), F.explode("runs").alias("r"), F.array("fault").alias("folders"))
    files = files.select("stage", "entity", "track", "r.start", "r.end", "r.value", "folders")
    h = I.history(I.merge_runs(bars)).withColumn("source", F.explode("sources")).join(faults, "source")
    h = h.groupBy("entity", "bar", "start", "end", "value").agg(F.sort_array(F.collect_set("fault")).alias("folders"))
    return files.unionByName(h.select(F.lit("joined").alias("stage"), "entity", F.col("bar").alias("track"), "start", "end", "value", "folders"))


GAPS_SQL = """, n AS (SELECT *, lag(value) OVER w AS b, lead(value) OVER w AS a, row_number() OVER w AS k, count(*) OVER (PARTITION BY stage, entity, track) AS c, ("end" - start) / 1e6 AS s FROM tracks WINDOW w AS (PARTITION BY stage, entity, track ORDER BY start)),
p AS (SELECT *, CASE WHEN k = 1 THEN 'head' WHEN k = c THEN 'tail' WHEN a = b THEN 'seam' ELSE 'change' END AS place FROM n WHERE value IS NULL)
"""


@query("b4_unlabeled_gaps", demo.with_samples(TRACKS_SQL + GAPS_SQL + """SELECT stage, place, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY stage), 6) AS share, round(min(s), 6) AS least, round(median(s), 6) AS middle, round(max(s), 6) AS most FROM p GROUP BY stage, place"""))
def b4_unlabeled_gaps(spark, sf):
    """Stretches without a label at a track's ends, between equal and between different labels, before and after recordings are joined."""
    from pyspark.sql import Window

    s = (F.col("end") - F.col("start")) / 1e6
    out = beside(tracks(spark, sf)).where("value is null").groupBy("stage", "place").agg(F.count(F.lit(1)).alias("n"), r(F.min(s), 6).alias("least"), r(F.percentile(s, 0.5), 6).alias("middle"), r(F.max(s), 6).alias("most"))
    return out.withColumn("share", r(F.col("n") / F.sum("n").over(Window.partitionBy("stage"))))


def beside(rows):
    """Tracks with was and becomes, the labels before and after, and the place of each run."""
    from pyspark.sql import Window

    key = ["stage", "entity", "track"]
    w = Window.partitionBy(*key).orderBy("start")
    at = rows.withColumns({"was": F.lag("value").over(w), "becomes": F.lead("value").over(w), "_k": F.row_number().over(w), "_c": F.count(F.lit(1)).over(Window.partitionBy(*key))})
    place = F.when(F.col("_k") == 1, "head").when(F.col("_k") == F.col("_c"), "tail").when(F.col("was") == F.col("becomes"), "seam").otherwise("change")
    return at.withColumn("place", place).drop("_k", "_c")


@query("b5_returns_to_normal", demo.with_samples(TRACKS_SQL + """, n AS (SELECT *, lag(value) OVER w AS b, lag("end") OVER w AS e, lag(folders) OVER w AS f FROM tracks WHERE value IS NOT NULL WINDOW w AS (PARTITION BY stage, entity, track ORDER BY start))
SELECT stage, entity, track, start, b AS was, round((start - e) / 1e6, 6) AS delay_s, array_to_string(list_sort(list_distinct(list_concat(f, folders))), ' ') AS folders FROM n WHERE value = 0 AND b <> 0"""))
def b5_returns_to_normal(spark, sf):
    """Where normal operation follows an event, within a file and along a joined history, how long after, and the folders of both."""
    from pyspark.sql import Window

    w = Window.partitionBy("stage", "entity", "track").orderBy("start")
    known = tracks(spark, sf).where("value is not null").withColumns({"was": F.lag("value").over(w), "e": F.lag("end").over(w), "f": F.lag("folders").over(w)})
    folders = F.array_join(F.array_sort(F.array_distinct(F.concat("f", "folders"))), " ")
    return known.where("value = 0 and was <> 0").select("stage", "entity", "track", "start", "was", r((F.col("start") - F.col("e")) / 1e6, 6).alias("delay_s"), folders.alias("folders"))


@query("b6_label_changes", demo.with_samples(TRACKS_SQL + GAPS_SQL + """, z AS (SELECT *, start - ("end" - start) AS view_from, "end" + ("end" - start) AS view_to FROM p WHERE place = 'change' AND a <> b),
u AS (SELECT z.stage, z.entity, z.track, z.start, count(s.value) AS n FROM z LEFT JOIN samples s ON s.entity = z.entity AND s.us BETWEEN z.view_from AND z.view_to GROUP BY ALL)
SELECT stage, entity, track, start, "end", b AS was, a AS becomes, view_from, view_to, CASE WHEN n > 1 THEN 'value' ELSE 'raw' END AS channel FROM z JOIN u USING (stage, entity, track, start)"""))
def b6_label_changes(spark, sf):
    """Labels that differ on either side of a stretch without one, with the span to view them in and the first channel that moves there."""
    width = F.col("end") - F.col("start")
    z = beside(tracks(spark, sf)).where("value is null and place = 'change' and was <> becomes").withColumns({"view_from": F.col("start") - width, "view_to": F.col("end") + width})
    z = stored(z, "changes")  # read twice
    day = 86_400_000_000
    days = z.withColumn("_d", F.explode(F.sequence(F.floor(F.col("view_from") / day), F.floor(F.col("view_to") / day))))
    x = demo.samples(spark, sf).where("value is not null").select("entity", F.col("us").alias("_t"), F.floor(F.col("us") / day).alias("_d"))
    seen = days.join(x, ["entity", "_d"]).where(F.col("_t").between(F.col("view_from"), F.col("view_to"))).groupBy("stage", "entity", "track", "start").agg(F.count(F.lit(1)).alias("_n"))
    out = z.join(seen, ["stage", "entity", "track", "start"], "left")
    return out.select("stage", "entity", "track", "start", "end", "was", "becomes", "view_from", "view_to", F.when(F.col("_n") > 1, "value").otherwise("raw").alias("channel"))


#: Readings in three units; the derived recordings have a sample every few hours, so their last stretch is three days, not an hour.
HOURS = 72
READ_SQL = f""", rd AS (SELECT series, entity, fault, us, rid, label, 'pressure' AS channel, 'Pa' AS unit, raw * 2e4 AS reading FROM samples UNION ALL SELECT series, entity, fault, us, rid, label, 'temperature', '°C', value * 3 - 60 FROM samples
 UNION ALL SELECT series, entity, fault, us, rid, label, 'valve', '%', (rid * 7 % 130)::DOUBLE - 10 FROM samples),
rg AS (SELECT * FROM (VALUES ('Pa', 0.0, 1e8, 1e4), ('°C', -50.0, 250.0, 0.1), ('%', 0.0, 100.0, 1.0)) t(unit, low, high, band)),
ok AS (SELECT rd.*, band, CASE WHEN reading BETWEEN low AND high THEN reading END AS v, fault > 0 AND coalesce(label IN (fault, fault + 100), false) AS ev FROM rd JOIN rg USING (unit)),
os AS (SELECT series, min(us) FILTER (ev) AS onset, max(us) FILTER (ev) AS last FROM ok GROUP BY series HAVING count(*) FILTER (ev) > 0),
ns AS (SELECT series, max(us) AS calm FROM ok JOIN os USING (series) WHERE label = 0 AND us < onset GROUP BY series),
mv AS (SELECT series, channel, unit, any_value(fault) AS fault, any_value(entity) AS entity, any_value(band) AS band, any_value(onset) AS onset, any_value(last) AS last,
 median(v) FILTER (label = 0 AND us < onset AND us > calm - {HOURS} * 3600000000) AS before, median(v) FILTER (ev AND us > last - {HOURS} * 3600000000) AS after,
 quantile_cont(v, 0.95) FILTER (ev) - quantile_cont(v, 0.05) FILTER (ev) AS swing FROM ok JOIN os USING (series) LEFT JOIN ns USING (series) GROUP BY series, channel, unit),
mw AS (SELECT *, after - before AS move, CASE WHEN after - before > band THEN 1 WHEN after - before < -band THEN -1 WHEN after - before IS NOT NULL THEN 0 END AS way FROM mv),
ex AS (SELECT fault, channel, CASE WHEN (fault + k) % 2 = 0 THEN 1 ELSE -1 END AS sign FROM range(1, 5) f(fault), (VALUES ('pressure', 0), ('temperature', 1), ('valve', 2)) c(channel, k))
"""


def readings(spark, sf):
    x = demo.samples(spark, sf)
    one = lambda channel, unit, v: F.struct(F.lit(channel).alias("channel"), F.lit(unit).alias("unit"), v.cast("double").alias("reading"))
    three = F.array(one("pressure", "Pa", F.col("raw") * 2e4), one("temperature", "°C", F.col("value") * 3 - 60), one("valve", "%", F.col("rid") * 7 % 130 - 10))
    return x.select("series", "entity", "fault", "us", "rid", "label", F.inline(three))


def expected(spark):
    """The way each channel goes in each fault."""
    return spark.createDataFrame([(f, c, 1 if (f + k) % 2 == 0 else -1) for f in range(1, 5) for k, c in enumerate(("pressure", "temperature", "valve"))], "fault long, channel string, sign int")


@query("b8_extreme_readings", demo.with_samples(READ_SQL + """, b AS (SELECT rd.*, greatest(low - reading, reading - high) AS beyond FROM rd JOIN rg USING (unit))
SELECT fault, channel, round(arg_max(reading, struct_pack(a := beyond, b := -rid)), 6) AS reading, arg_max(rid, struct_pack(a := beyond, b := -rid)) AS rid, round(max(beyond), 6) AS beyond FROM b WHERE beyond > 0 GROUP BY fault, channel"""))
def b8_extreme_readings(spark, sf):
    return A.extremes(readings(spark, sf), ["fault", "channel"]).withColumns({"reading": r("reading"), "beyond": r("beyond")})


@query("b9_moves", demo.with_samples(READ_SQL + "SELECT series, channel, fault, round(before, 6) AS before, round(after, 6) AS after, round(move, 6) AS move, round(swing, 6) AS swing FROM mw"))
def b9_moves(spark, sf):
    return moves(spark, sf).select("series", "channel", "fault", *[r(c).alias(c) for c in ("before", "after", "move", "swing")])


def moves(spark, sf):
    return A.moves(readings(spark, sf), HOURS)


@query("b11_signatures", demo.with_samples(READ_SQL + """SELECT fault, channel, sign, count(way) AS total, count(*) FILTER (way = sign) AS matches, count(*) FILTER (way = -sign) AS against, count(*) FILTER (way IS NULL) AS lacking FROM mw JOIN ex USING (fault, channel) GROUP BY ALL"""))
def b11_signatures(spark, sf):
    return A.signatures(moves(spark, sf), expected(spark))


@query("b12_rates", demo.with_samples(READ_SQL + """, rt AS (SELECT *, CASE WHEN last > onset THEN move / ((last - onset) / 86400000000) END AS rate FROM mw)
SELECT fault, entity, channel, count(rate) AS n, round(median(rate), 6) AS rate FROM rt GROUP BY ALL"""))
def b12_rates(spark, sf):
    """How fast a channel moves for each day of an event, by entity."""
    return A.rates(moves(spark, sf)).withColumn("rate", r("rate"))


@query("b12_swings", demo.with_samples(READ_SQL + """, ag AS (SELECT fault, count(*) FILTER (way = -sign) AS against FROM mw JOIN ex USING (fault, channel) GROUP BY fault)
SELECT fault, round(median(swing), 6) AS median_swing, count(*) FILTER (swing > 1e6) AS wide, count(*) AS n, any_value(against) AS against FROM mw JOIN ag USING (fault) WHERE unit = 'Pa' GROUP BY fault"""))
def b12_swings(spark, sf):
    """Of each fault the swing of pressures, how many swing over 1 MPa, and how many moves go against the sources."""
    moved = stored(moves(spark, sf), "moves")
    against = A.signatures(moved, expected(spark)).groupBy("fault").agg(F.sum("against").alias("against"))
    return moved.where("unit = 'Pa'").groupBy("fault").agg(r(F.percentile("swing", 0.5)).alias("median_swing"), F.count_if(F.col("swing") > 1e6).alias("wide"), F.count(F.lit(1)).alias("n")).join(against, "fault")


@query("b13_dominant_state", demo.with_samples(f""", k AS (SELECT fault, {KIND_SQL} AS period, rid % 3 AS state, count(*) AS n FROM samples GROUP BY ALL)
SELECT fault, period, sum(n)::BIGINT AS n, arg_max(state, struct_pack(a := n, b := -state)) AS dominant, round(max(n) / sum(n), 6) AS share FROM k GROUP BY fault, period"""))
def b13_dominant_state(spark, sf):
    x = demo.samples(spark, sf).groupBy("fault", L.label_kind(F.col("label")).alias("period"), (F.col("rid") % 3).alias("state")).agg(F.count(F.lit(1)).alias("k"))
    return x.groupBy("fault", "period").agg(F.sum("k").alias("n"), F.max_by("state", F.struct("k", -F.col("state"))).alias("dominant"), r(F.max("k") / F.sum("k")).alias("share"))
