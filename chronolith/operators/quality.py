"""Data-quality rules over wide frames (series, us, rid, a column for each channel) and their statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.operators.series import ordered


def order_breaks(wide: DataFrame, chain: list[str], margin: float, low: float, high: float, least: int = 2, reported: float = 0.01, gates: dict[str, list[str]] | None = None, pairs: list[tuple[str, str, list[str]]] = (), key: str = "series") -> DataFrame:
    """key, up, down, compared, broken, worst, share of consecutive present channels of a chain whose values ought to fall, and of
    further pairs (up, down, gates).

    A channel is present in a series with `least` plausible readings that are not all the same. A pair is compared where both
    readings are plausible and no gate of the downstream channel or pair reads 0; broken where the downstream one is higher by more
    than margin; reported where more than the share `reported` is broken."""
    from chronolith.functions.labels import plausible

    every = list(dict.fromkeys([*chain, *(c for up, down, _ in pairs for c in (up, down))]))
    ok = {c: plausible(F.col(c), F.lit(low), F.lit(high)) for c in every}
    present = wide.groupBy(key).agg(*[((F.count(ok[c]) >= least) & (F.max(ok[c]) > F.min(ok[c]))).alias(c) for c in every])
    names = F.filter(F.array(*[F.when(F.col(c), F.lit(c)) for c in chain]), lambda x: x.isNotNull())
    met = F.arrays_zip(F.slice("_names", F.lit(1), F.greatest(F.size("_names") - 1, F.lit(0))).alias("up"), F.slice("_names", F.lit(2), F.greatest(F.size("_names") - 1, F.lit(0))).alias("down"))
    further = [F.when(F.coalesce(F.col(up) & F.col(down), F.lit(False)), F.struct(F.lit(up).alias("up"), F.lit(down).alias("down"))) for up, down, _ in pairs]
    both = F.concat(met, F.filter(F.array(*further), lambda x: x.isNotNull())) if further else met
    found = present.withColumn("_names", names).select(key, F.explode(both).alias("p")).select(key, F.col("p.up").alias("_up"), F.col("p.down").alias("_down"))
    pick = lambda which: reduce(lambda acc, c: F.when(F.col(which) == c, ok[c]).otherwise(acc), every, F.lit(None).cast("double"))
    zero = lambda gates_: reduce(lambda acc, g: acc | (F.col(g) == 0), gates_, F.lit(False))
    shut = reduce(lambda acc, g: acc | ((F.col("_down") == g[0]) & zero(g[1])), (gates or {}).items(), F.lit(False))
    shut = reduce(lambda acc, p: acc | ((F.col("_up") == p[0]) & (F.col("_down") == p[1]) & zero(p[2])), pairs, shut)
    rows = wide.join(found, key).withColumns({"_u": pick("_up"), "_d": pick("_down")}).where(F.col("_u").isNotNull() & F.col("_d").isNotNull() & ~F.coalesce(shut, F.lit(False)))
    gap = F.col("_d") - F.col("_u")
    out = rows.groupBy(key, F.col("_up").alias("up"), F.col("_down").alias("down")).agg(F.count(F.lit(1)).alias("compared"), F.count_if(gap > margin).alias("broken"), F.max(gap).alias("worst"))
    return out.withColumn("share", F.col("broken") / F.col("compared")).where(F.col("share") > reported)


def partners(breaks: DataFrame, key: str = "series") -> DataFrame:
    """key, channel, partners: the channels that each broken channel stands against."""
    both = breaks.select(key, F.explode(F.array(F.struct(F.col("up").alias("channel"), F.col("down").alias("other")), F.struct(F.col("down").alias("channel"), F.col("up").alias("other")))).alias("p"))
    return both.groupBy(key, "p.channel").agg(F.sort_array(F.collect_set("p.other")).alias("partners"))


def near_changes(samples: DataFrame, value: str = "label", within_us: int = 300_000_000, by: tuple[str, ...] = ("series",)) -> DataFrame:
    """samples with near: within so many micros of a change of the label, a missing label being a value of its own."""
    w = ordered(*by)
    change = F.when(~F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), F.col("us"))
    rows = samples.withColumn("_c", change)
    before = F.last("_c", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_c", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = F.coalesce(F.col("us") - before <= within_us, F.lit(False)) | F.coalesce(after - F.col("us") <= within_us, F.lit(False))
    return rows.withColumn("near", near).drop("_c")


def state_breaks(wide: DataFrame, rules: list[tuple[int, str, bool, list[str]]], state: str = "state", reported: float = 0.01, key: str = "series") -> DataFrame:
    """key, rule, tested, broken, share of rules (state, all or any, open, valves) over boolean valve columns.

    An "all" rule is tested where any valve says something and broken where one says the opposite; an "any" rule is tested where
    all say something and broken where all say the opposite."""
    parts = []
    for i, (code, kind, wanted, valves) in enumerate(rules):
        said = [F.col(v).isNotNull() for v in valves]
        against = [F.coalesce(F.col(v) != F.lit(wanted), F.lit(False)) for v in valves]
        fold = (lambda x, y: x | y) if kind == "all" else (lambda x, y: x & y)
        tested = (F.col(state) == code) & reduce(fold, said)
        parts.append(F.struct(F.lit(i).alias("rule"), tested.alias("tested"), (tested & reduce(fold, against)).alias("broken")))
    rows = wide.select(key, F.explode(F.array(*parts)).alias("t")).where("t.tested")
    out = rows.groupBy(key, "t.rule").agg(F.count(F.lit(1)).alias("tested"), F.count_if(F.col("t.broken")).alias("broken"))
    return out.withColumn("share", F.col("broken") / F.col("tested")).where(F.col("share") > reported)


def state_conflicts(broken: DataFrame, rules: list[tuple[int, str, bool, list[str]]], channel_of: dict[str, str], key: str = "series") -> DataFrame:
    """key, channel, conflicts: the states whose broken rules name the channel's valve, in order."""
    named = F.array(*[F.struct(F.lit(code).alias("code"), F.array(*[F.lit(channel_of[v]) for v in valves]).alias("channels")) for code, _, _, valves in rules])
    rows = broken.select(key, F.get(named, F.col("rule")).alias("r")).select(key, "r.code", F.explode("r.channels").alias("channel"))
    return rows.groupBy(key, "channel").agg(F.array_sort(F.collect_set("code")).alias("conflicts"))


def states_by_valve(wide: DataFrame, valves: list[str], state: str = "state", key: str = "series") -> DataFrame:
    """key, valve, reading, states: in which states each valve stood open or closed, or said nothing."""
    texts = [F.when(F.col(v), "open").when(~F.col(v), "closed").otherwise("unknown") for v in valves]
    rows = wide.select(key, F.col(state).alias("state"), F.explode(F.array(*[F.struct(F.lit(v).alias("valve"), t.alias("reading")) for v, t in zip(valves, texts)])).alias("v"))
    return rows.groupBy(key, "v.valve", "v.reading").agg(F.sort_array(F.collect_set("state")).alias("states"))


def robust_cleaning(events: DataFrame, k: float = 3.0, floor: float = 1e-6, missing_share: float = 0.6, exempt: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """events (event, channel, mean, std; null where the channel was not live) with by_mean, by_std, discard; and channel, dropped.

    A channel missing in at least missing_share of the events is dropped. An event's mean or deviation outside k interquartile ranges of
    the channel's discards it; the lower bound of deviations is at least `floor`. Exempt channels never discard."""
    listed = F.col("channel").isin(*exempt) if exempt else F.lit(False)
    q = events.groupBy("channel").agg(F.percentile("mean", [0.25, 0.75]).alias("_m"), F.percentile("std", [0.25, 0.75]).alias("_s"), (F.count_if(F.col("mean").isNull()) / F.count(F.lit(1))).alias("missing"))
    q = q.withColumn("dropped", F.col("missing") >= missing_share)
    reach = lambda c: k * (F.col(c)[1] - F.col(c)[0])
    rows = events.join(q, "channel")
    by_mean = (F.col("mean") < F.col("_m")[0] - reach("_m")) | (F.col("mean") > F.col("_m")[1] + reach("_m"))
    by_std = (F.col("std") < F.greatest(F.col("_s")[0] - reach("_s"), F.lit(floor))) | (F.col("std") > F.col("_s")[1] + reach("_s"))
    live = ~listed & ~F.col("dropped")
    flagged = rows.withColumns({"by_mean": live & F.coalesce(by_mean, F.lit(False)), "by_std": live & F.coalesce(by_std, F.lit(False))})
    flagged = flagged.withColumn("discard", F.col("by_mean") | F.col("by_std")).select(*events.columns, "by_mean", "by_std", "discard", "dropped")
    return flagged, q.select("channel", "missing", "dropped")


def kept_share(flagged: DataFrame) -> DataFrame:
    """event, kept: the share of its live channels that are neither dropped nor discarded."""
    live = F.col("mean").isNotNull() & (F.col("std") > 0)
    return flagged.groupBy("event").agg((F.count_if(live & ~F.col("discard") & ~F.col("dropped")) / F.nullif(F.count_if(live), F.lit(0))).alias("kept"))


def reasons(flagged: DataFrame) -> DataFrame:
    """event, why: the channels that discard it and how, in order."""
    how = F.concat_ws(" and ", F.when(F.col("by_mean"), "mean"), F.when(F.col("by_std"), "std"))
    return flagged.where("discard").groupBy("event").agg(F.array_join(F.sort_array(F.collect_list(F.format_string("%s by %s", F.col("channel"), how))), ", ").alias("why"))

