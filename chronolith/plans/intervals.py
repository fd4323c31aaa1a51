"""Queries of the interval algebra, over recordings derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.operators import intervals as I
from chronolith.plans.registry import query
from chronolith.plans.series import KIND_SQL, r
from chronolith.sources import demo
from chronolith.sources.shared import stored

RUNS_SQL = """, c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR label IS DISTINCT FROM lag(label) OVER w THEN 1 ELSE 0 END AS ch FROM samples WINDOW w AS (PARTITION BY series ORDER BY us, rid)),
g AS (SELECT *, sum(ch) OVER (PARTITION BY series ORDER BY us, rid) AS run FROM c),
runs AS (SELECT series, any_value(entity) AS entity, any_value(fault) AS fault, run, min(us) AS start, max(us) AS last, any_value(label) AS value, count(*) AS n FROM g GROUP BY series, run),
st AS (SELECT series, coalesce(quantile_cont(gap, 0.5) FILTER (gap > 0), 1000000) AS step_us FROM
 (SELECT series, us - lag(us) OVER (PARTITION BY series ORDER BY us, rid) AS gap FROM samples) GROUP BY series),
seg AS (SELECT series, entity, fault, run, start, coalesce(lead(start) OVER (PARTITION BY series ORDER BY run), trunc(last + step_us)::BIGINT) AS "end", value FROM runs JOIN st USING (series))
"""
CAT_SQL = f"""{RUNS_SQL}, cat AS (SELECT series, entity, fault, min(us) AS start, max(us) AS "end", count(*) AS n_samples, count(value) AS n_valid, min(value) AS low, max(value) AS high,
 CASE coalesce(max(CASE {KIND_SQL} WHEN 'steady' THEN 2 WHEN 'transient' THEN 1 WHEN 'normal' THEN 0 END), 0) WHEN 2 THEN 'steady' WHEN 1 THEN 'transient' ELSE 'normal' END AS reach
 FROM samples GROUP BY series, entity, fault),
pairs AS (SELECT a.entity, a.series AS a, b.series AS b FROM cat a JOIN cat b ON a.entity = b.entity AND (a.start < b.start OR (a.start = b.start AND a.series < b.series)) AND b.start <= a."end"),
bad AS (SELECT DISTINCT p.entity, p.a, p.b FROM pairs p JOIN seg x ON x.series = p.a JOIN seg y ON y.series = p.b AND x.start < y."end" AND y.start < x."end" WHERE x.value <> y.value)
"""


def groups_sql(source: str = "cat", key: str = "entity", name: str = "grp") -> str:
    """Common tables that end in name: source with bar. An entity's recordings are taken one by one in order of start, with the
    list of the bars so far."""
    return f""", {name}_o AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY start, series) AS k FROM {source}),
{name}_p AS (SELECT y.{key} AS e, y.k, list(x.k) AS met, list(x.k) FILTER (b.a IS NOT NULL) AS torn FROM {name}_o y JOIN {name}_o x ON x.{key} = y.{key} AND x.entity = y.entity AND x.k < y.k AND y.start <= x."end"
 LEFT JOIN bad b ON b.a = x.series AND b.b = y.series GROUP BY y.{key}, y.k),
{name}_n AS (SELECT o.{key} AS e, o.k, coalesce(met, []) AS met, coalesce(torn, []) AS torn FROM {name}_o o LEFT JOIN {name}_p p ON p.e = o.{key} AND p.k = o.k),
{name}_w AS (SELECT DISTINCT {key} AS e, 0::BIGINT AS k, []::BIGINT[] AS bars FROM {source}
 UNION ALL SELECT w.e, n.k, list_append(w.bars, coalesce(list_min(list_filter(list_transform(n.met, lambda i: w.bars[i]), lambda x: NOT list_contains(list_transform(n.torn, lambda i: w.bars[i]), x))), coalesce(list_max(w.bars) + 1, 0)))
 FROM {name}_w w JOIN {name}_n n ON n.e = w.e AND n.k = w.k + 1),
{name}_b AS (SELECT e, arg_max(bars, k) AS bars FROM {name}_w GROUP BY e),
{name} AS (SELECT o.* EXCLUDE (k), b.bars[o.k] AS bar FROM {name}_o o JOIN {name}_b b ON b.e = o.{key})
"""


GROUPS_SQL = CAT_SQL + groups_sql()


def cat(spark, sf):
    """The catalogue, written once, as a query reads it more than once."""
    return stored(I.catalogue(demo.samples(spark, sf)), "catalogue")


def grouped(spark, sf):
    """The catalogue with the bars of its recordings, written once."""
    return stored(I.join_groups(cat(spark, sf)), "grouped")


@query("r1_runs", demo.with_samples(RUNS_SQL + "SELECT series, run, start, last, value, n FROM runs"))
def r1_runs(spark, sf):
    return I.runs(demo.samples(spark, sf))


@query("r2_segments", demo.with_samples(RUNS_SQL + 'SELECT series, run, start, "end", value FROM seg'))
def r2_segments(spark, sf):
    return I.label_segments(demo.samples(spark, sf))


@query("r4_durations", demo.with_samples(RUNS_SQL + f""", k AS (SELECT series, ("end" - start) / 1e6 AS s, {KIND_SQL.replace('label', 'value')} AS kind FROM seg)
SELECT series, round(coalesce(sum(s) FILTER (kind = 'normal'), 0), 6) AS normal, round(coalesce(sum(s) FILTER (kind = 'transient'), 0), 6) AS transient,
 round(coalesce(sum(s) FILTER (kind = 'steady'), 0), 6) AS steady, round(coalesce(sum(s) FILTER (kind = 'unknown'), 0), 6) AS unknown FROM k GROUP BY series"""))
def r4_durations(spark, sf):
    out = I.period_seconds(I.label_segments(demo.samples(spark, sf)))
    return out.select("series", *[r(c).alias(c) for c in ("normal", "transient", "steady", "unknown")])


@query("s5_catalogue", demo.with_samples(CAT_SQL + """SELECT series, entity, fault, start, "end", n_samples, n_valid, low, high, reach, round(("end" - start) / 3.6e9, 6) AS hours,
 (SELECT count(*) FROM seg WHERE seg.series = cat.series) AS n_runs FROM cat"""))
def s5_catalogue(spark, sf):
    return I.catalogue(demo.samples(spark, sf)).withColumns({"hours": r("hours"), "n_runs": F.size("runs")}).drop("runs")


@query("r5_overlaps", demo.with_samples(CAT_SQL + "SELECT entity, a, b FROM pairs"))
def r5_overlaps(spark, sf):
    return I.overlaps(cat(spark, sf))


@query("r6_agreements", demo.with_samples(CAT_SQL + "SELECT p.entity, p.a, p.b, bad.a IS NULL AS agree FROM pairs p LEFT JOIN bad ON p.a = bad.a AND p.b = bad.b"))
def r6_agreements(spark, sf):
    return I.agreements(cat(spark, sf))


@query("r7_join_groups", demo.with_samples(GROUPS_SQL + "SELECT entity, series, bar FROM grp"))
def r7_join_groups(spark, sf):
    return I.join_groups(cat(spark, sf)).select("entity", "series", "bar")


@query("r8_bars", demo.with_samples(GROUPS_SQL + """SELECT entity, bar, min(start) AS start, max("end") AS "end", arg_max(fault, struct_pack(a := CASE reach WHEN 'steady' THEN 2 WHEN 'transient' THEN 1 ELSE 0 END, b := fault <> 0, c := -start, d := -series)) AS lead,
 count(*) AS n_members, count(DISTINCT fault) AS n_colours, arg_min(series, struct_pack(a := start, b := series)) AS first, sum(n_samples)::BIGINT AS n_rows, round((max("end") - min(start)) / 3.6e9, 6) AS hours FROM grp GROUP BY entity, bar"""))
def r8_bars(spark, sf):
    out = I.bars(grouped(spark, sf))
    return out.withColumns({"hours": r("hours"), "n_colours": F.size("colours")}).drop("colours")


@query("r9_distinct_samples", demo.with_samples(GROUPS_SQL + """, til AS (SELECT g.entity, g.bar, g.series, g.start, g."end", g.n_samples, (SELECT max("end") FROM seg WHERE seg.series = g.series) AS t FROM grp g),
cov AS (SELECT entity, bar, sum(greatest(0, t - greatest(start, m))) AS covered FROM (SELECT *, coalesce(max(t) OVER (PARTITION BY entity, bar ORDER BY start, series ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start) AS m FROM til) GROUP BY entity, bar),
ins AS (SELECT g.entity, bar, count(DISTINCT us) AS n_instants FROM grp g JOIN samples s USING (series) GROUP BY g.entity, bar)
SELECT entity, bar, sum(n_samples)::BIGINT AS n_samples, CASE WHEN count(*) = 1 THEN sum(n_samples)::BIGINT ELSE round_even(any_value(covered) / arg_min(t - "end", struct_pack(a := start, b := series)), 0)::BIGINT END AS n_distinct, any_value(n_instants) AS n_instants
FROM til JOIN cov USING (entity, bar) JOIN ins USING (entity, bar) GROUP BY entity, bar"""))
def r9_distinct_samples(spark, sf):
    rows = grouped(spark, sf)
    return I.distinct_samples(rows).join(I.distinct_instants(demo.samples(spark, sf), rows), ["entity", "bar"])


@query("r11_stitched", demo.with_samples(GROUPS_SQL + """, bb AS (SELECT entity, bar, min(start) AS start, max("end") AS "end", sum(n_samples)::BIGINT AS n_rows, arg_min(series, struct_pack(a := start, b := series)) AS first FROM grp GROUP BY entity, bar),
bo AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY start, first) AS k FROM bb),
lw AS (SELECT DISTINCT entity, 0::BIGINT AS k, []::BIGINT[] AS ends, -1::BIGINT AS lane FROM bb
 UNION ALL SELECT w.entity, o.k, CASE WHEN l.p > len(w.ends) THEN list_append(w.ends, o."end") ELSE list_transform(w.ends, lambda x, i: CASE WHEN i = l.p THEN o."end" ELSE x END) END, l.p - 1
 FROM lw w JOIN bo o ON o.entity = w.entity AND o.k = w.k + 1, LATERAL (SELECT coalesce(list_min(list_filter(range(1, len(w.ends) + 1), lambda i: w.ends[i] < o.start)), len(w.ends) + 1) AS p) l)
SELECT entity, lane::INT AS lane, count(*) AS pieces, round(sum((o."end" - o.start) / 3.6e9), 6) AS hours, sum(n_rows)::BIGINT AS n_rows, min(start) AS start, max("end") AS "end" FROM lw JOIN bo o USING (entity, k) GROUP BY entity, lane"""))
def r11_stitched(spark, sf):
    return I.stitched(stored(I.bars(grouped(spark, sf)), "bars")).withColumn("hours", r("hours"))


@query("r12_coverage", demo.with_samples(CAT_SQL + """, e AS (SELECT entity, t, sum(d) AS d FROM (SELECT entity, start AS t, 1 AS d FROM cat UNION ALL SELECT entity, "end", -1 FROM cat) GROUP BY entity, t)
SELECT * FROM (SELECT entity, t AS start, lead(t) OVER w AS "end", (sum(d) OVER w)::BIGINT AS depth FROM e WINDOW w AS (PARTITION BY entity ORDER BY t)) WHERE "end" IS NOT NULL"""))
def r12_coverage(spark, sf):
    return I.coverage(cat(spark, sf))


@query("r13_lanes", demo.with_samples(CAT_SQL + """, p AS (SELECT entity, (SELECT count(*) FROM cat o WHERE o.entity = c.entity AND o.start <= c.start AND o."end" >= c.start) AS depth FROM cat c)
SELECT entity, max(depth)::BIGINT AS lanes, max(depth)::BIGINT AS packed FROM p GROUP BY entity"""))
def r13_lanes(spark, sf):
    rows = cat(spark, sf)
    packed = I.pack_lanes(rows).join(rows, "series").groupBy("entity").agg((F.max("lane") + 1).alias("packed"))
    return I.lane_counts(rows).join(packed, "entity")


@query("r14_merged_samples", demo.with_samples(GROUPS_SQL + """, m AS (SELECT g.entity, bar, us, value, label, struct_pack(a := g.start, b := g.series, c := rid) AS o FROM grp g JOIN samples s USING (series))
SELECT entity, bar, us, arg_min(value, o) AS value, arg_min(label, o) AS label FROM m GROUP BY entity, bar, us""".replace("arg_min(value, o)", "arg_min(value, o) FILTER (value IS NOT NULL)").replace("arg_min(label, o)", "arg_min(label, o) FILTER (label IS NOT NULL)")))
def r14_merged_samples(spark, sf):
    rows = grouped(spark, sf)
    return I.merge_samples(demo.samples(spark, sf), rows, ["value", "label"])


MERGED_SQL = GROUPS_SQL + """, own AS (SELECT g.entity, g.bar, g.series, g.start AS s, seg.start, seg."end", seg.value FROM grp g JOIN seg USING (series)),
ed AS (SELECT DISTINCT entity, bar, t FROM (SELECT entity, bar, start AS t FROM own UNION ALL SELECT entity, bar, "end" FROM own)),
cell AS (SELECT entity, bar, t AS f, lead(t) OVER (PARTITION BY entity, bar ORDER BY t) AS u FROM ed),
told AS (SELECT c.entity, c.bar, f, u, arg_min(series, struct_pack(a := value IS NULL, b := s, c := series)) AS source FROM cell c JOIN own o ON o.entity = c.entity AND o.bar = c.bar AND o.start <= f AND f < o."end" WHERE u IS NOT NULL GROUP BY c.entity, c.bar, f, u),
told2 AS (SELECT t.*, o.value FROM told t JOIN own o ON o.series = t.source AND o.bar = t.bar AND o.start <= f AND f < o."end"),
mk AS (SELECT *, CASE WHEN value IS NOT DISTINCT FROM lag(value) OVER w AND source = lag(source) OVER w AND f = lag(u) OVER w THEN 0 ELSE 1 END AS c FROM told2 WINDOW w AS (PARTITION BY entity, bar ORDER BY f)),
mg AS (SELECT *, sum(c) OVER (PARTITION BY entity, bar ORDER BY f) AS k FROM mk),
merged AS (SELECT entity, bar, min(f) AS start, max(u) AS "end", any_value(value) AS value, any_value(source) AS source FROM mg GROUP BY entity, bar, k)
"""


@query("r15_merged_runs", demo.with_samples(MERGED_SQL + 'SELECT entity, bar, start, "end", value, source FROM merged'))
def r15_merged_runs(spark, sf):
    return I.merge_runs(grouped(spark, sf))


@query("r16_history", demo.with_samples(MERGED_SQL + """, h AS (SELECT *, CASE WHEN value IS NOT DISTINCT FROM lag(value) OVER w AND start = lag("end") OVER w THEN 0 ELSE 1 END AS c FROM merged WINDOW w AS (PARTITION BY entity, bar ORDER BY start)),
h2 AS (SELECT *, sum(c) OVER (PARTITION BY entity, bar ORDER BY start) AS k FROM h)
SELECT entity, bar, min(start) AS start, max("end") AS "end", any_value(value) AS value, count(DISTINCT source) AS n_sources FROM h2 GROUP BY entity, bar, k"""))
def r16_history(spark, sf):
    return I.history(I.merge_runs(grouped(spark, sf))).withColumn("n_sources", F.size("sources")).drop("sources")


@query("r17_repeated_samples", demo.with_samples(CAT_SQL + """, q AS (SELECT series, max("end") OVER (PARTITION BY entity ORDER BY start, "end", series ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM cat)
SELECT series, rid, coalesce(us <= e, false) AS repeated FROM samples JOIN q USING (series)"""))
def r17_repeated_samples(spark, sf):
    return I.repeated_samples(demo.samples(spark, sf), cat(spark, sf)).select("series", "rid", "repeated")


BLOCKS_SQL = CAT_SQL + """, bk AS (SELECT *, coalesce((start - max("end") OVER (PARTITION BY entity ORDER BY start, series ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 43200000000)::INT, 1) AS nw FROM cat),
bl AS (SELECT *, sum(nw) OVER (PARTITION BY entity ORDER BY start, series) - 1 AS block FROM bk),
ax AS (SELECT entity, block, min(start) AS block_start, max("end") AS block_end FROM bl GROUP BY entity, block),
a2 AS (SELECT *, (block_end - block_start) / 3.6e9 AS h, 0.12 * greatest(sum((block_end - block_start) / 3.6e9) OVER (PARTITION BY entity), 1) / greatest(count(*) OVER (PARTITION BY entity) - 1, 1) AS gap FROM ax),
axis AS (SELECT *, coalesce(sum(h + gap) OVER (PARTITION BY entity ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x0 FROM a2)
"""


@query("r18_time_axis", demo.with_samples(BLOCKS_SQL + "SELECT entity, block::BIGINT AS block, block_start, block_end, round(x0, 6) AS x0, round(x0 + h, 6) AS x1 FROM axis"))
def r18_time_axis(spark, sf):
    return I.block_axis(I.time_blocks(cat(spark, sf))).withColumns({"x0": r("x0"), "x1": r("x1")})


@query("r19_to_axis", demo.with_samples(BLOCKS_SQL + """SELECT entity, rid, round(x0 + (us - block_start) / 3.6e9, 6) AS x FROM (SELECT ev.entity, rid, us, x0, block_start, row_number() OVER (PARTITION BY ev.entity, rid ORDER BY block_start DESC) AS k
 FROM ev JOIN axis ON axis.entity = ev.entity AND block_start <= us) WHERE k = 1"""))
def r19_to_axis(spark, sf):
    axis = I.block_axis(I.time_blocks(cat(spark, sf)))
    return I.to_axis(demo.events(spark, sf).select("entity", "us", "rid"), axis).select("entity", "rid", r("x").alias("x"))


@query("r20_block_facts", demo.with_samples(BLOCKS_SQL + """SELECT entity, count(*) AS blocks, round(sum(h), 6) AS recorded_hours, count(DISTINCT (block_start // 86400000000)) AS start_days, round(greatest(max(h), 1 / 60), 6) AS longest FROM axis GROUP BY entity"""))
def r20_block_facts(spark, sf):
    axis = I.block_axis(I.time_blocks(cat(spark, sf)))
    h = F.col("x1") - F.col("x0")
    return axis.groupBy("entity").agg(F.count(F.lit(1)).alias("blocks"), r(F.sum(h)).alias("recorded_hours"), F.count_distinct(F.floor(F.col("block_start") / 86_400_000_000)).alias("start_days"), r(F.greatest(F.max(h), F.lit(1 / 60))).alias("longest"))


@query("r21_onsets", demo.with_samples("""SELECT series, min(us) AS start, min(us) FILTER (label = fault + 100) AS transient, min(us) FILTER (label = fault) AS steady FROM samples GROUP BY series"""))
def r21_onsets(spark, sf):
    return I.onsets(demo.samples(spark, sf))


@query("r23_aligned", demo.with_samples(""", o AS (SELECT series, min(us) FILTER (label = fault) AS t FROM samples GROUP BY series)
SELECT series, rid, round((us - t) / 3.6e9, 6) AS hours FROM samples JOIN o USING (series) WHERE t IS NOT NULL"""))
def r23_aligned(spark, sf):
    x = demo.samples(spark, sf)
    return I.aligned(x, I.onsets(x)).select("series", "rid", r("hours").alias("hours"))


@query("r25_seams", demo.with_samples(GROUPS_SQL + "SELECT entity, bar, start AS at FROM (SELECT *, row_number() OVER (PARTITION BY entity, bar ORDER BY start, series) AS k FROM grp) WHERE k > 1"))
def r25_seams(spark, sf):
    return I.seams(grouped(spark, sf))


@query("r26_mask_spans", demo.with_samples(""", f AS (SELECT series, us, rid, coalesce(value > 50, false) AS flag, coalesce(lead(us) OVER w, us + 1000000) AS nx FROM samples WINDOW w AS (PARTITION BY series ORDER BY us, rid)),
c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR flag <> lag(flag) OVER w THEN 1 ELSE 0 END AS ch FROM f WINDOW w AS (PARTITION BY series ORDER BY us, rid)),
g AS (SELECT *, sum(ch) OVER (PARTITION BY series ORDER BY us, rid) AS run FROM c)
SELECT series, min(us) AS start, max(nx) AS "end" FROM g GROUP BY series, run HAVING bool_and(flag)"""))
def r26_mask_spans(spark, sf):
    x = demo.samples(spark, sf).withColumn("flag", F.coalesce(F.col("value") > 50, F.lit(False)))
    return I.mask_spans(x, "flag")
