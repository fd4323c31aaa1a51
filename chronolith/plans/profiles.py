"""The profile pass over recordings of two readings, a valve and a declared channel that none records, and the table of features from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.operators import profiles as P
from chronolith.plans.intervals import GROUPS_SQL, grouped
from chronolith.plans.registry import query
from chronolith.plans.series import KINDS, described_sql, r, step_sql
from chronolith.sources import demo

CHANNELS = (("value", 0.0, 150.0, False), ("raw", 0.0, 150.0, False), ("valve", 0.0, 1.0, True), ("absent", 0.0, 1.0, False))
RULES = [(1, "all", True, ["open"])]
DIGITS = {c: 6 for c in ("mean", "std", "q05", "q25", "median", "q75", "q95", "low", "high", "slope", "offset", "scatter", "acf_half_s")} | {"skew": 6, "kurtosis": 6, "snr": 6}
#: Readings in steps give shapes such as 0.8203125, half-way between two rounded values; both sides move off such ties.
SHAPES, SHIFT = ("skew", "kurtosis", "snr"), 1.3e-8

FRAMES_SQL = GROUPS_SQL + """, fs AS (SELECT series, us, rid, label, value, raw, CASE WHEN rid % 5 <> 0 THEN (rid % 2)::DOUBLE END AS valve, (pos % 3)::INT AS state FROM samples),
lone AS (SELECT entity, bar FROM grp GROUP BY entity, bar HAVING count(*) = 1),
mm AS (SELECT g.entity, g.bar, fs.*, struct_pack(a := g.start, b := g.series, c := rid) AS o FROM grp g JOIN fs USING (series) ANTI JOIN lone USING (entity, bar)),
fr AS (SELECT 'instance:' || series AS unit, us, rid, value, raw, valve, state FROM fs UNION ALL SELECT 'labelled:' || series, us, rid, value, raw, valve, state FROM fs WHERE label IS NOT NULL
 UNION ALL SELECT 'bar:' || g.entity || '-' || g.bar, us, rid, value, raw, valve, state FROM grp g JOIN lone USING (entity, bar) JOIN fs USING (series)
 UNION ALL SELECT 'bar:' || entity || '-' || bar, us, us, arg_min(value, o) FILTER (value IS NOT NULL), arg_min(raw, o) FILTER (raw IS NOT NULL), arg_min(valve, o) FILTER (valve IS NOT NULL), arg_min(state, o) FILTER (state IS NOT NULL) FROM mm GROUP BY entity, bar, us),
un AS (SELECT DISTINCT 'instance:' || series AS unit FROM fs UNION ALL SELECT DISTINCT 'labelled:' || series FROM fs UNION ALL SELECT DISTINCT 'bar:' || entity || '-' || bar FROM grp),
op AS (SELECT unit, count(*) FILTER (raw - value > 2) AS broken, count(*) AS compared FROM fr WHERE raw BETWEEN 0 AND 150 AND value BETWEEN 0 AND 150 GROUP BY unit
 HAVING broken > 0.01 * compared),
pr AS (SELECT unit FROM fr GROUP BY unit HAVING count(*) FILTER (raw BETWEEN 0 AND 150) >= 2 AND count(*) FILTER (value BETWEEN 0 AND 150) >= 2 AND max(raw) FILTER (raw BETWEEN 0 AND 150) > min(raw) FILTER (raw BETWEEN 0 AND 150)
 AND max(value) FILTER (value BETWEEN 0 AND 150) > min(value) FILTER (value BETWEEN 0 AND 150)),
oo AS (SELECT unit, broken FROM op SEMI JOIN pr USING (unit)),
ag AS (SELECT unit, count(*) FILTER (valve <> 1) AS broken, count(*) AS tested FROM fr WHERE state = 1 AND valve IS NOT NULL GROUP BY unit HAVING broken > 0.01 * tested),
u AS (SELECT unit || '|value' AS series, us, rid, value AS own, CASE WHEN value BETWEEN 0 AND 150 THEN value END AS value, false AS enumerated FROM fr
 UNION ALL SELECT unit || '|raw', us, rid, raw, CASE WHEN raw BETWEEN 0 AND 150 THEN raw END, false FROM fr UNION ALL SELECT unit || '|valve', us, rid, valve, valve, true FROM fr UNION ALL SELECT unit || '|absent', us, rid, NULL, NULL, false FROM fr),
grid AS (SELECT unit, c AS channel, unit || '|' || c AS series FROM un CROSS JOIN (SELECT unnest(['value', 'raw', 'valve', 'absent']) AS c)),
conf AS (SELECT g.*, CASE WHEN channel IN ('value', 'raw') THEN coalesce(oo.broken, 0) ELSE 0 END AS n_out_of_order, CASE WHEN oo.broken > 0 AND channel = 'value' THEN 'raw' WHEN oo.broken > 0 AND channel = 'raw' THEN 'value' ELSE '' END AS order_partners,
 CASE WHEN channel = 'valve' THEN coalesce(ag.broken, 0) ELSE 0 END AS n_against_state, CASE WHEN ag.broken > 0 AND channel = 'valve' THEN '1' ELSE '' END AS state_conflicts FROM grid g LEFT JOIN oo USING (unit) LEFT JOIN ag USING (unit)),
im AS (SELECT series, count(*) AS n_total, count(value) AS n_valid, count(*) FILTER (own IS NOT NULL AND value IS NULL) AS n_implausible, bool_or(enumerated) AS enumerated FROM u GROUP BY series)
"""

COUNTED_SQL = FRAMES_SQL + KINDS.replace("FROM samples", "FROM u").replace("kinds AS (", "kinds0 AS (") + f""", kinds AS (SELECT * REPLACE (CASE WHEN enumerated AND value IS NOT NULL THEN 0 ELSE kind END AS kind) FROM kinds0),
steps AS ({step_sql("u", "series")}),
co AS (SELECT series, count(*) FILTER (kind = 0) AS n_genuine, count(*) FILTER (kind = 1) AS n_interpolated, count(*) FILTER (kind = 2) AS n_held, max(i) FILTER (kind = 0) - min(i) FILTER (kind = 0) AS span
 FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY us, rid) AS i FROM kinds) GROUP BY series),
su AS (SELECT *, CASE WHEN n_genuine > 1 AND NOT enumerated THEN span * step_us / 1e6 / (n_genuine - 1) END AS spacing FROM co JOIN steps USING (series) JOIN im USING (series)),
gs AS (SELECT series, coalesce(spacing * 1e6, step_us) AS step_us FROM su WHERE NOT enumerated AND n_genuine < n_valid), gx AS (SELECT series, us, rid, value FROM kinds SEMI JOIN gs USING (series) WHERE kind = 0), ax AS (SELECT series, us, rid, value FROM u),
""" + described_sql("da", "ax", "steps", 6, SHIFT) + ", " + described_sql("dg", "gx", "gs", 6, SHIFT)


def rounded_sql(c: str, digits: dict[str, int]) -> str:
    return f"round({c[0]}.\"{c[1]}\", {digits[c[1]]})" if c[1] in digits else f'{c[0]}."{c[1]}"'


PASS_SQL = COUNTED_SQL + """SELECT conf.unit, split_part(conf.unit, ':', 1) AS scope, channel, n_out_of_order, order_partners, n_against_state, state_conflicts, spacing AS spacing_s, """ + ", ".join(f"coalesce(su.{c}, 0) AS {c}" for c in P.COUNTS) + ", " + ", ".join(
    f'{rounded_sql(("da", c), DIGITS)} AS "{c}", CASE WHEN enumerated OR n_genuine = n_valid THEN {rounded_sql(("da", c), DIGITS)} ELSE {rounded_sql(("dg", c), DIGITS)} END AS "g_{c}"' for c in P.MEASURES
) + " FROM conf LEFT JOIN su USING (series) LEFT JOIN da USING (series) LEFT JOIN dg USING (series)"


def recordings(spark, sf):
    """The catalogue with bars; a recording's stamp is what its file's size and time would be."""
    rows = grouped(spark, sf)
    whole = ~F.exists("runs", lambda x: x.value.isNull())
    return rows.select("series", "entity", "bar", "start", F.concat_ws(":", "n_samples", "end").alias("stamp"), whole.alias("whole"))


def wide(spark, sf):
    x = demo.samples(spark, sf)
    valve = F.when(F.col("rid") % 5 != 0, (F.col("rid") % 2).cast("double"))
    return x.select("series", "entity", "us", "rid", "label", "value", "raw", valve.alias("valve"), (F.col("pos") % 3).cast("int").alias("state"))


def conflicts(rows):
    ordered = P.out_of_order(rows, ["value", "raw"], 2.0, 0.0, 150.0)
    return ordered, P.against_state(rows.withColumn("open", F.col("valve") > 0.5), RULES, {"open": "valve"})


def profiled(spark, sf, described: bool = True):
    samples = wide(spark, sf)
    return P.profile_pass(recordings(spark, sf), lambda series: samples.join(series, "series", "left_semi"), CHANNELS, ("state",), conflicts, described=described)


@query("f11_profile_pass", demo.with_samples(PASS_SQL))
def f11_profile_pass(spark, sf):
    out = profiled(spark, sf)
    return out.withColumns({g + c: r(F.col(g + c) + (SHIFT if c in SHAPES else 0.0), d) for g in ("", "g_") for c, d in DIGITS.items()}).drop("digest")


@query("a18_features_with_conflicts", demo.with_samples(FRAMES_SQL + """SELECT channel, count(*) AS blocks, count(*) FILTER (n_valid > 0) AS recorded, count(*) FILTER (n_implausible > 0) AS implausible, count(*) FILTER (n_out_of_order > 0) AS out_of_order,
 coalesce(string_agg(DISTINCT nullif(order_partners, ''), ','), '') AS partners, count(*) FILTER (n_against_state > 0) AS against_state, coalesce(string_agg(DISTINCT nullif(state_conflicts, ''), ','), '') AS states FROM conf LEFT JOIN im USING (series) WHERE unit LIKE 'bar:%' GROUP BY channel"""))
def a18_features_with_conflicts(spark, sf):
    return P.feature_table(profiled(spark, sf, described=False).where("scope = 'bar'"))
