"""Profiles of all channels of recordings, of their labelled parts and of the bars they join to, kept from one pass to the next.

A unit is what is profiled: "instance:<series>", "labelled:<series>" or "bar:<entity>-<bar>", with a digest of the files it is made from.
Channels are (name, low, high, enumerated); a wide frame lacks some of them, and has a column for each other."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions.labels import plausible
from chronolith.operators import described as D
from chronolith.operators import quality as K
from chronolith.operators import series as S
from chronolith.operators.intervals import merge_samples
from chronolith.sources.shared import stored

Channel = tuple[str, float, float, bool]
KEYS = ("unit", "channel")
#: Rows of a unit that is profiled where its rows are; the code of a reading outside its channel's range.
SHORT, IMPLAUSIBLE = 4096, -2
COUNTS = ("n_total", "n_valid", "n_implausible", "n_genuine", "n_interpolated", "n_held")
MEASURES = ("mean", "std", "skew", "kurtosis", "q05", "q25", "median", "q75", "q95", "low", "high", "snr", "acf_half_s", "slope", "offset", "scatter", "gaussian")


def _any(tests: list[Column]) -> Column:
    return F.coalesce(reduce(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), tests), F.lit(False))


def out_of_order(wide: DataFrame, chain: list[str], margin: float, low: float, high: float, reported: float = 0.01, gates: dict[str, list[str]] | None = None, key: str = "unit") -> DataFrame:
    """key, channel, n_out_of_order, order_partners: samples in which a reported pair of the channel is broken, a sample once however
    many pairs, and the other channels of those pairs. Channels without a reported pair have no row."""
    broken = K.order_breaks(wide, chain, margin, low, high, reported=reported, gates=gates, key=key)
    told = broken.groupBy(key).agg(F.collect_set(F.concat_ws(">", "up", "down")).alias("_told"))  # pairs of a chain, a few
    ok = {c: plausible(F.col(c), F.lit(low), F.lit(high)) for c in chain}

    def test(up: str, down: str) -> Column:
        shut = [F.col(g) == 0 for g in (gates or {}).get(down, [])]
        return F.array_contains("_told", f"{up}>{down}") & (ok[down] - ok[up] > margin) & ~(_any(shut) if shut else F.lit(False))

    pairs = list(combinations(chain, 2))
    each = [F.struct(F.lit(c).alias("channel"), F.col(f"_n{i}").alias("n_out_of_order")) for i, c in enumerate(chain)]
    sums = wide.join(told, key).groupBy(key).agg(*[F.count_if(_any([test(*p) for p in pairs if c in p])).alias(f"_n{i}") for i, c in enumerate(chain)])
    counts = sums.select(key, F.explode(F.array(*each)).alias("c")).select(key, "c.*")
    return counts.join(K.partners(broken, key).withColumn("order_partners", F.array_join("partners", ",")).drop("partners"), [key, "channel"])


def against_state(wide: DataFrame, rules: list[tuple[int, str, bool, list[str]]], channel_of: dict[str, str], state: str = "state", reported: float = 0.01, key: str = "unit") -> DataFrame:
    """key, channel, n_against_state, state_conflicts: samples in which a reported rule that names the channel's valve is broken, a
    sample once, and the states of those rules. Channels without a reported rule have no row."""
    broken = K.state_breaks(wide, rules, state, reported, key)
    told = broken.groupBy(key).agg(F.collect_set("rule").alias("_told"))

    def test(i: int) -> Column:
        code, kind, wanted, valves = rules[i]
        against = [F.coalesce(F.col(v) != F.lit(wanted), F.lit(False)) for v in valves]
        fold = (lambda a, b: a | b) if kind == "all" else (lambda a, b: a & b)
        return F.array_contains("_told", i) & (F.col(state) == code) & reduce(fold, against)

    named = sorted({v for _, _, _, valves in rules for v in valves})
    sums = wide.join(told, key).groupBy(key).agg(*[F.count_if(_any([test(i) for i, rule in enumerate(rules) if v in rule[3]])).alias(f"_n{j}") for j, v in enumerate(named)])
    each = [F.struct(F.lit(channel_of[v]).alias("channel"), F.col(f"_n{j}").alias("n_against_state")) for j, v in enumerate(named)]
    counts = sums.select(key, F.explode(F.array(*each)).alias("c")).select(key, "c.*")
    states = K.state_conflicts(broken, rules, channel_of, key).withColumn("state_conflicts", F.array_join(F.transform("conflicts", lambda c: c.cast("string")), ","))
    return counts.join(states.drop("conflicts"), [key, "channel"])


def kinds(wide: DataFrame, channels: Sequence[Channel]) -> DataFrame:
    """unit, us, rid, gap, at and, for the i-th channel, own_i (its reading, NaN and those of a channel that the frame lacks being null), v_i (if
    plausible) and kind_i, as `series.sample_kinds` has it; of an enumerated channel every reading is a measurement.

    The channels of a unit stand at the same times: its rows are sorted once for all of them, and its steps and places are one."""
    w, whole = S.ordered("unit"), Window.partitionBy("unit")
    own = lambda c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)) if c in wide.columns else F.lit(None).cast("double")
    rows = wide.select("unit", "us", "rid", *[own(c).alias(f"own_{i}") for i, (c, *_) in enumerate(channels)])
    rows = rows.withColumns({f"v_{i}": plausible(F.col(f"own_{i}"), F.lit(float(low)), F.lit(float(high))) for i, (_, low, high, _) in enumerate(channels)})
    here = range(len(channels))
    v, d, n, most, after = ([F.col(f"{c}_{i}") for i in here] for c in ("v", "_d", "_n", "_most", "_after"))
    facts = {"at": F.row_number().over(w), "gap": F.col("us") - F.lag("us").over(w)}
    rows = rows.withColumns(facts | {f"_d_{i}": v[i] - F.lag(v[i]).over(w) for i in here} | {f"_n_{i}": F.count(v[i]).over(whole) for i in here} | {f"_most_{i}": F.max(F.abs(v[i])).over(whole) for i in here})
    rows = rows.withColumns({f"_after_{i}": F.lead(d[i]).over(w) for i in here})
    kind = lambda i: S.kind_of(v[i], d[i], after[i], n[i], most[i])
    told = [F.when(v[i].isNotNull(), S.GENUINE).otherwise(S.MISSING) if e else kind(i) for i, (*_, e) in enumerate(channels)]
    return rows.select("unit", "us", "rid", "gap", "at", *[f"own_{i}" for i in here], *v, *[k.cast("int").alias(f"kind_{i}") for i, k in enumerate(told)])


def summaries(told: DataFrame, channels: Sequence[Channel]) -> DataFrame:
    """unit, channel, enumerated, counts, spacing_s, step_us of what `kinds` tells, in one aggregation of a unit's rows."""
    sums = [F.coalesce(F.percentile(F.when(F.col("gap") > 0, F.col("gap")), 0.5), F.lit(1e6)).alias("step_us"), F.count(F.lit(1)).alias("n_total")]
    for i in range(len(channels)):
        own, v, kind = (F.col(f"{c}_{i}") for c in ("own", "v", "kind"))
        genuine = F.when(kind == S.GENUINE, F.col("at"))
        of = {"n_valid": v.isNotNull(), "n_implausible": own.isNotNull() & v.isNull(), "n_genuine": kind == S.GENUINE, "n_interpolated": kind == S.INTERPOLATED, "n_held": kind == S.HELD}
        sums += [F.struct(*[F.count_if(test).alias(c) for c, test in of.items()], (F.max(genuine) - F.min(genuine)).alias("_span")).alias(f"_{i}")]
    each = [F.struct(F.lit(c).alias("channel"), F.lit(bool(e)).alias("enumerated"), F.col(f"_{i}").alias("s")) for i, (c, *_, e) in enumerate(channels)]
    out = told.groupBy("unit").agg(*sums).select("unit", "step_us", "n_total", F.explode(F.array(*each)).alias("c")).select("unit", "step_us", "n_total", "c.channel", "c.enumerated", "c.s.*")
    spacing = F.when(~F.col("enumerated") & (F.col("n_genuine") > 1), F.col("_span") * F.col("step_us") / 1e6 / (F.col("n_genuine") - 1))
    return out.select(*KEYS, "enumerated", *COUNTS, spacing.alias("spacing_s"), "step_us")


def profiles(wide: DataFrame, channels: Sequence[Channel], described: bool = True) -> DataFrame:
    """unit, channel, counts, spacing_s and, if described, the measures of all plausible readings and (g_ columns) of the measured ones.

    Of an enumerated channel every reading is a measurement, without a spacing, and both sets of measures are one; so they are where all
    readings are measured. Elsewhere the step of the measured ones is their spacing, or else the sampling step. A unit of up to SHORT rows
    is profiled where its sorted rows are; the rows of longer ones are dealt and sorted for each descriptor, so that no task holds them."""
    if not described:
        return summaries(kinds(wide, channels), channels).select(*KEYS, *COUNTS, "spacing_s")
    long = stored(wide.groupBy("unit").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > SHORT).select("unit"), "long")
    if long.isEmpty():
        return along(kinds(wide, channels), channels)
    of = lambda how: wide.join(long, "unit", how)
    return along(kinds(of("left_anti"), channels), channels).unionByName(apart(of("left_semi"), channels))


def along(told: DataFrame, channels: Sequence[Channel]) -> DataFrame:
    """`profiles` of what `kinds` tells of units that a task may hold, a batch of units at a time along their sorted rows."""
    measured = [c for c in MEASURES if c != "gaussian"]
    fields = ["unit string", "channel string", *[f"{c} long" for c in COUNTS], "spacing_s double"]
    fields += [f"{g}{c} double" for g in ("", "g_") for c in measured] + [f"{g}gaussian boolean" for g in ("", "g_")]
    names = [f.split()[0] for f in fields]
    code = lambda i: F.when(F.col(f"own_{i}").isNotNull() & F.col(f"v_{i}").isNull(), IMPLAUSIBLE).otherwise(F.col(f"kind_{i}"))
    rows = told.sortWithinPartitions("unit", *S.ORDER).select("unit", "at", "gap", *[f"v_{i}" for i in range(len(channels))], *[code(i).cast("byte").alias(f"kind_{i}") for i in range(len(channels))])

    def profile(part):
        import numpy as np
        import pyarrow as pa

        number = lambda c: part.column(c).to_numpy(zero_copy_only=False)
        at, gap = number("at"), number("gap").astype(float)
        starts = np.flatnonzero(at == 1)
        n, of = np.diff(np.append(starts, len(at))), np.cumsum(at == 1) - 1
        unit, count = part.column("unit").take(pa.array(starts)), lambda x: np.bincount(of[x], minlength=len(starts))
        positive = gap > 0
        steps, some = count(positive), count(positive) > 0
        step = np.full(len(starts), 1e6)
        ranked = gap[positive][np.lexsort((gap[positive], of[positive]))]
        step[some] = D.quantile(ranked, (np.cumsum(steps) - steps)[some], steps[some], 0.5)
        for i, (channel, *_, enumerated) in enumerate(channels):
            v, kind = number(f"v_{i}").astype(float), number(f"kind_{i}")
            genuine, valid = kind == S.GENUINE, kind >= S.GENUINE
            sums = {"n_total": n, "n_valid": count(valid), "n_implausible": count(kind == IMPLAUSIBLE), "n_genuine": count(genuine), "n_interpolated": count(kind == S.INTERPOLATED), "n_held": count(kind == S.HELD)}
            spacing = np.full(len(starts), np.nan)
            several = (sums["n_genuine"] > 1) & (not enumerated)
            if several.any():
                first, last = np.where(genuine, at, len(at) + 1), np.where(genuine, at, 0)
                span = np.maximum.reduceat(last, starts) - np.minimum.reduceat(first, starts)
                spacing[several] = span[several] * step[several] / 1e6 / (sums["n_genuine"][several] - 1)
            every = D.of_each(v, valid, of, step, MEASURES)
            same = (sums["n_genuine"] == sums["n_valid"]) | bool(enumerated)
            own = D.of_each(v, genuine & ~same[of], of, np.where(np.isnan(spacing), step, spacing * 1e6), MEASURES)
            own = {c: np.where(same, every[c], own[c]) for c in MEASURES}
            columns = [unit, pa.array([channel] * len(starts)), *[pa.array(sums[c], pa.int64()) for c in COUNTS], pa.array(spacing, from_pandas=True)]
            columns += [pa.array(x[c], from_pandas=True) for x in (every, own) for c in measured]
            columns += [pa.array(x["gaussian"] == 1, mask=np.isnan(x["gaussian"])) for x in (every, own)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def walk(batches):
        import numpy as np
        import pyarrow as pa

        held = []
        for batch in batches:
            starts = np.flatnonzero(batch.column("at").to_numpy() == 1)
            if held and len(starts):  # a unit's rows end where the next one begins
                yield from profile(pa.concat_batches([*held, batch.slice(0, starts[-1])]))
                held = []
                batch = batch.slice(starts[-1])
            elif len(starts) and starts[-1] > 0:
                yield from profile(batch.slice(0, starts[-1]))
                batch = batch.slice(starts[-1])
            held.append(batch)
        held = [b for b in held if b.num_rows]
        if held:
            yield from profile(pa.concat_batches(held))

    return rows.mapInArrow(walk, ", ".join(fields)).select(*KEYS, *COUNTS, "spacing_s", *MEASURES, *[f"g_{c}" for c in MEASURES])


def apart(wide: DataFrame, channels: Sequence[Channel]) -> DataFrame:
    """`profiles` by a shuffle and a sort for each descriptor of each channel."""
    told = stored(kinds(wide, channels), "kinds")
    summary = stored(summaries(told, channels), "sampling")
    own = summary.where(~F.col("enumerated") & (F.col("n_genuine") < F.col("n_valid")))
    spacing = own.select(*KEYS, F.coalesce(F.col("spacing_s") * 1e6, F.col("step_us")).alias("step_us"))
    cells = [F.struct(F.lit(c).alias("channel"), F.col(f"v_{i}").alias("_v"), F.col(f"kind_{i}").alias("kind")) for i, (c, *_) in enumerate(channels)]
    long = told.select("unit", "us", "rid", F.explode(F.array(*cells)).alias("c")).select("unit", "us", "rid", "c.*").where("_v is not null")
    measured = long.where(F.col("kind") == S.GENUINE).join(own.select(*KEYS), list(KEYS), "left_semi")
    grid = S.descriptors(long, summary.select(*KEYS, "step_us"), "_v", KEYS).drop("n")
    g = S.descriptors(measured, spacing, "_v", KEYS).drop("n")
    g = g.select(*KEYS, *[F.col(c).alias(f"g_{c}") for c in MEASURES])
    same = F.col("enumerated") | (F.col("n_genuine") == F.col("n_valid"))
    out = summary.join(grid, list(KEYS), "left").join(g, list(KEYS), "left")
    return out.select(*KEYS, *COUNTS, "spacing_s", *MEASURES, *[F.when(same, F.col(c)).otherwise(F.col(f"g_{c}")).alias(f"g_{c}") for c in MEASURES])


def units(recordings: DataFrame) -> DataFrame:
    """unit, scope, digest, source of all units of recordings (series, entity, bar, stamp, whole: labelled throughout).

    stamp changes with a recording's file. A labelled part that is the whole recording, and a bar of one recording, have that recording's
    profile: source names its unit."""
    text = F.col("series").cast("string")
    instance = F.concat(F.lit("instance:"), text)
    each = recordings.select(instance.alias("unit"), F.lit("instance").alias("scope"), F.sha1(F.col("stamp")).alias("digest"), F.lit(None).cast("string").alias("source"))
    labelled = recordings.select(F.concat(F.lit("labelled:"), text).alias("unit"), F.lit("labelled").alias("scope"), F.sha1(F.col("stamp")).alias("digest"), F.when(F.col("whole"), instance).alias("source"))
    members = F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", text, "stamp"))), "\n")
    bars = recordings.groupBy("entity", "bar").agg(F.sha1(members).alias("digest"), F.count(F.lit(1)).alias("_n"), F.min(instance).alias("_one"))
    bars = bars.select(F.concat(F.lit("bar:"), F.concat_ws("-", "entity", "bar")).alias("unit"), F.lit("bar").alias("scope"), "digest", F.when(F.col("_n") == 1, F.col("_one")).alias("source"))
    return each.unionByName(labelled).unionByName(bars)


def frames(wide: DataFrame, recordings: DataFrame, own: DataFrame, columns: list[str]) -> DataFrame:
    """unit, us, rid and the columns of the units in own: the recordings, their labelled samples, and merged samples of bars (rid is the time)."""
    text = F.col("series").cast("string")
    of = lambda scope: own.where(F.col("scope") == scope).select("unit")
    rows = wide.withColumn("unit", F.concat(F.lit("instance:"), text)).join(of("instance"), "unit", "left_semi").select("unit", "us", "rid", *columns)
    known = wide.where("label is not null").withColumn("unit", F.concat(F.lit("labelled:"), text)).join(of("labelled"), "unit", "left_semi")
    bar = F.concat(F.lit("bar:"), F.concat_ws("-", "entity", "bar"))
    members = recordings.withColumn("unit", bar).join(of("bar"), "unit", "left_semi")
    merged = merge_samples(wide, members, columns).select(bar.alias("unit"), "us", F.col("us").alias("rid"), *columns)
    return rows.unionByName(known.select("unit", "us", "rid", *columns)).unionByName(merged)


def profile_pass(
    recordings: DataFrame,
    scan: Callable[[DataFrame], DataFrame],
    channels: Sequence[Channel],
    extra: Sequence[str] = (),
    conflicts: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None,
    cached: DataFrame | None = None,
    described: bool = True,
) -> DataFrame:
    """unit, scope, digest, channel and a profile for each unit and declared channel, recorded or not.

    recordings: series, entity, bar, start, stamp, whole. scan gives the wide samples (series, entity, us, rid, label, channels, extra) of a
    table of series. conflicts gives, of a wide frame by unit, the tables of `out_of_order` and `against_state`. Units that `cached`, an earlier
    result, holds with the same digest are kept from there, and only the recordings of the others are scanned. No recordings, no rows."""
    recordings = stored(recordings, "recordings")
    every = stored(units(recordings), "units")
    fresh = every if cached is None else every.join(cached.select("unit", "digest").distinct(), ["unit", "digest"], "left_anti")
    fresh = stored(fresh, "fresh")
    own = fresh.where("source is null")
    text = F.col("series").cast("string")
    named = recordings.select("series", F.explode(F.array(F.concat(F.lit("instance:"), text), F.concat(F.lit("labelled:"), text), F.concat(F.lit("bar:"), F.concat_ws("-", "entity", "bar")))).alias("unit"))
    wide = scan(named.join(own, "unit", "left_semi").select("series").distinct())
    columns = [c for c in dict.fromkeys([*(c for c, *_ in channels), *extra]) if c in wide.columns]
    rows = stored(frames(wide, recordings, own, columns), "frames")
    # a profile goes with the units that it is lent to, so that it is not shuffled again for them
    lent = fresh.where("source is not null").groupBy(F.col("source").alias("unit")).agg(F.collect_list(F.struct("unit", "digest")).alias("_lent"))
    made = own.join(lent, "unit", "left").select("unit", "digest", "_lent", F.explode(F.array(*[F.lit(c) for c, *_ in channels])).alias("channel"))
    made = made.join(profiles(rows, channels, described), list(KEYS), "left")
    for part in conflicts(rows) if conflicts else ():
        made = made.join(part, list(KEYS), "left")
    if not conflicts:
        made = made.withColumns({n: F.lit(None).cast(t) for n, t in (("n_out_of_order", "long"), ("order_partners", "string"), ("n_against_state", "long"), ("state_conflicts", "string"))})
    numbers = [*COUNTS, "n_out_of_order", "n_against_state"]
    made = stored(made.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in numbers} | {c: F.coalesce(c, F.lit("")) for c in ("order_partners", "state_conflicts")}), "profiles")
    known = made
    if cached is not None:
        known = made.unionByName(cached.join(every, ["unit", "digest"], "left_semi").join(lent, "unit", "left").select(made.columns))
    itself = F.array(F.struct("unit", "digest"))
    out = known.withColumn("_to", F.explode(F.concat(itself, F.coalesce("_lent", F.slice(itself, 1, 0)))))
    out = out.withColumns({"unit": F.col("_to.unit"), "digest": F.col("_to.digest")}).drop("_to", "_lent")
    return out.withColumn("scope", F.substring_index("unit", ":", 1))


def feature_table(profiled: DataFrame, by: tuple[str, ...] = ("channel",)) -> DataFrame:
    """by, blocks, and in how many of them a channel is recorded, implausible, out of order (and with which partners), against a state (and which)."""
    split = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col(c) != "", F.split(c, ",")))))), ",")
    count = lambda c: F.count_if(F.col(c) > 0)
    return profiled.groupBy(*by).agg(
        F.count(F.lit(1)).alias("blocks"), count("n_valid").alias("recorded"), count("n_implausible").alias("implausible"), count("n_out_of_order").alias("out_of_order"),
        split("order_partners").alias("partners"), count("n_against_state").alias("against_state"), split("state_conflicts").alias("states"),
    )
