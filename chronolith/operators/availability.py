"""Which channels were recorded where: long frames of bar, grp, channel and value, or wide ones with a column for each channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions.labels import outside_range, plausible, sensor_state


def unpivoted(wide: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    return wide.unpivot(keys, channels, "channel", "value")


def sensor_stats(long: DataFrame, keys: list[str]) -> DataFrame:
    """keys, channel, total, n_valid, low, high: a row for each channel, also where it was never recorded. NaN counts as missing; -0 is 0."""
    v = F.nanvl(F.col("value").cast("double"), F.lit(None)) + 0.0
    return long.groupBy(*keys, "channel").agg(F.count(F.lit(1)).alias("total"), F.count(v).alias("n_valid"), F.min(v).alias("low"), F.max(v).alias("high"))


def facts(long: DataFrame, keys: list[str], low: float, high: float, enumerated: list[str] = (), threshold: float = 0.0) -> DataFrame:
    """sensor_stats with state (0 absent, 1 frozen, 2 live), n_implausible and implausible."""
    ok = plausible(F.col("value"), F.lit(low), F.lit(high))
    odd = long.groupBy(*keys, "channel").agg(F.count_if(F.col("value").isNotNull() & ok.isNull()).alias("n_implausible"))
    stats = sensor_stats(long, keys)
    listed = F.col("channel").isin(*enumerated) if enumerated else F.lit(False)
    state = sensor_state(F.col("n_valid"), F.col("total"), F.col("low"), F.col("high"), listed, threshold)
    return stats.join(odd, [*keys, "channel"]).withColumns({"state": state, "implausible": outside_range(F.col("low"), F.col("high"), F.lit(low), F.lit(high))})


def measured(fact: DataFrame, sampling: DataFrame, partners: DataFrame, conflicts: DataFrame, keys: list[str]) -> DataFrame:
    """fact with n_genuine and n_filled readings (0 where unknown), partners (the channels it stands against in order) and conflicts (the
    states it speaks against), both empty arrays where there is nothing, and whether it is out_of_order or against_state.

    sampling: keys, channel, n_genuine, n_filled; partners: keys, channel, partners; conflicts: keys, channel, conflicts."""
    on = [*keys, "channel"]
    out = fact.join(sampling.select(*on, "n_genuine", "n_filled"), on, "left").join(partners, on, "left").join(conflicts, on, "left")
    said = F.col("partners").isNotNull().alias("out_of_order"), F.col("conflicts").isNotNull().alias("against_state")
    nothing = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c)
    known = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_genuine", "n_filled")]
    return out.select(*fact.columns, *known, *said, nothing("partners"), nothing("conflicts"))


def _measured_totals() -> list[Column]:
    """Only a live channel's readings are split into measurements and filled ones: a frozen one counts as frozen."""
    live = lambda c: F.sum(F.when(F.col("state") == 2, F.col(c)).otherwise(0))
    names = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    return [live("n_genuine").alias("genuine"), live("n_filled").alias("filled"), F.count_if("out_of_order").alias("bars_out_of_order"), names("partners").alias("partners"), F.count_if("against_state").alias("bars_against_state"), names("conflicts").alias("conflicts")]


def _totals() -> list[Column]:
    n, state = F.col("n_valid"), F.col("state")
    live, frozen = F.sum(F.when(state == 2, n).otherwise(0)), F.sum(F.when(state == 1, n).otherwise(0))
    bars = [F.count_if(state == k).alias(f"bars_{name}") for k, name in enumerate(("absent", "frozen", "live"))]
    return [F.count(F.lit(1)).alias("n_bars"), F.sum("total").alias("n_samples"), live.alias("live"), frozen.alias("frozen"), (F.sum("total") - live - frozen).alias("absent"), *bars, F.count_if(F.col("implausible")).alias("bars_implausible"), F.min("low").alias("low"), F.max("high").alias("high")]


def grouped(fact: DataFrame, key: str, total: str = "all") -> DataFrame:
    """key, channel and the samples and bars in each state; a last group `total` sums all, in the same aggregation. Of a measured fact also
    the measurements and filled readings, the bars out of order and against a state, and with what."""
    further = _measured_totals() if "n_genuine" in fact.columns else []
    sets = fact.groupingSets([[key, "channel"], ["channel"]], key, "channel").agg(*_totals(), *further, F.grouping(key).alias("_g"))
    return sets.withColumn(key, F.when(F.col("_g") == 1, total).otherwise(F.col(key).cast("string"))).drop("_g")


def shares(table: DataFrame, step_s: float = 1.0) -> DataFrame:
    """The share of samples and of bars that are live; 0 where there is none. Of a measured table also the share of filled samples, and, null
    where there is no measurement, the share of live samples that are measurements and the seconds of live signal per measurement."""
    over = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    out = table.withColumns({"live_share": over("live", "n_samples"), "frozen_share": over("frozen", "n_samples"), "bar_share": over("bars_live", "n_bars")})
    if "genuine" in table.columns:
        per = lambda a, b: a / F.nullif(b, F.lit(0))
        out = out.withColumns({"filled_share": over("filled", "n_samples"), "measured_share": per(F.col("genuine"), F.col("genuine") + F.col("filled")), "spacing_s": per(F.col("live") * step_s, F.col("genuine"))})
    return out


def coverage_order(total: DataFrame) -> DataFrame:
    """channel, rank by live share, then name. One row for each channel."""
    return total.select("channel", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("live_share"), "channel")).alias("rank"))


def reordered(table: DataFrame, order: DataFrame, name: str = "column_place") -> DataFrame:
    """table with the place of its channel in a coverage order (channel, rank), as a column of its own; channels outside the order come last, null."""
    return table.join(order.select("channel", F.col("rank").alias(name)), "channel", "left")


def pair_counts(wide: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    """keys, a, b, n: rows in which both channels have a reading, a up to b in the given order; one aggregation for all pairs."""
    pairs = [(a, b) for i, a in enumerate(channels) for b in channels[i:]]
    counts = wide.groupBy(*keys).agg(*[F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("n")) for i, (a, b) in enumerate(pairs)])
    return counts.select(*keys, F.explode(rows).alias("p")).select(*keys, "p.a", "p.b", "p.n")


def pair_coverage(counts: DataFrame, states: DataFrame, key: str, live_only: bool = True) -> DataFrame:
    """a, b, samples, bars: over the bars, of those in which both channels are live."""
    if live_only:
        live = states.where("state = 2").select(key, "channel")
        counts = counts.join(live.withColumnRenamed("channel", "a"), [key, "a"]).join(live.withColumnRenamed("channel", "b"), [key, "b"])
    return counts.groupBy("a", "b").agg(F.sum("n").alias("samples"), F.count_if(F.col("n") > 0).alias("bars"))


def seriation(coverage: list[tuple[str, str, int]]) -> list[str]:
    """Channels ordered so that those often recorded together stand together: by the second eigenvector of the Laplacian of their
    similarities. Takes the pairs of the channels, a few dozen; channels without readings come last."""
    import numpy as np

    own = {a: n for a, b, n in coverage if a == b}
    known = sorted((c for c in own if own[c]), key=lambda c: (-own[c], c))
    if len(known) < 3:
        return known + sorted(c for c in own if not own[c])
    at = {c: i for i, c in enumerate(known)}
    s = np.zeros((len(known), len(known)))
    for a, b, n in coverage:
        if a in at and b in at and a != b:
            s[at[a], at[b]] = s[at[b], at[a]] = n / min(own[a], own[b])
    _, vectors = np.linalg.eigh(np.diag(s.sum(axis=0)) - s)
    v = vectors[:, 1] * (1 if vectors[0, 1] <= 0 else -1)
    return [known[i] for i in np.argsort(v, kind="stable")] + sorted(c for c in own if not own[c])


def best_channel(total: DataFrame, enumerated: list[str] = ()) -> DataFrame:
    """The channel to show first: an analog one, then the most live, then by name."""
    listed = F.col("channel").isin(*enumerated) if enumerated else F.lit(False)
    return total.orderBy(listed, F.desc("live"), "channel").limit(1).select("channel", "live")


def entity_summary(cat: DataFrame, pairs: DataFrame, lanes: DataFrame) -> DataFrame:
    """entity, instances, overlapping, lanes, hours, samples."""
    met = pairs.select("entity", F.explode(F.array("a", "b")).alias("s")).groupBy("entity").agg(F.count_distinct("s").alias("overlapping"))
    own = cat.groupBy("entity").agg(F.count(F.lit(1)).alias("instances"), F.sum("hours").alias("hours"), F.sum("n_samples").alias("samples"))
    return own.join(met, "entity", "left").join(lanes, "entity").withColumn("overlapping", F.coalesce("overlapping", F.lit(0)))
