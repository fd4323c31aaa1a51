"""Scans along ordered rows in ranges, so that no task holds a whole series, and exact quantiles on them.

`dealt` cuts the order of (by, order) into ranges of about equal size and writes them; a segment is what one range holds of one series, so that
there are at most as many segments as series and ranges together. Within a segment windows do the work; what crosses its bounds (the rows
beside it, sums and maxima so far, facts of the whole series) is carried by a table of one row for each segment. Rows whose series is
null are left out; rows equal in all of (by, order) stand in no defined order, as in any window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.operators.series import GENUINE, HELD, INTERPOLATED, MISSING, ORDER
from chronolith.sources.shared import stored

SEGMENT = "_segment"


def dealt(rows: DataFrame, by: tuple[str, ...] = ("series",), order: tuple[str, ...] = ORDER, parts: int | None = None) -> DataFrame:
    """rows with _segment, dealt by ranges of (by, order) and written; `parts` ranges, or as many as the session's shuffle partitions."""
    keys = [F.col(c) for c in (*by, *order)]
    out = rows.dropna(subset=list(by))
    out = out.repartitionByRange(parts, *keys) if parts else out.repartitionByRange(*keys)
    return stored(out.withColumn(SEGMENT, F.spark_partition_id()), "segments")


def scan(
    rows: DataFrame,
    by: tuple[str, ...] = ("series",),
    order: tuple[str, ...] = ORDER,
    beside: tuple[str, ...] = (),
    so_far: dict[str, tuple[Callable, Column]] | None = None,
    whole: dict[str, tuple[Callable, Column]] | None = None,
) -> DataFrame:
    """Dealt rows with what windows over whole series would give.

    beside: columns whose values in the rows before and after come as structs prev and next, null at a series' ends.
    so_far: name -> (F.sum or F.max, column), folded up to and with the row; whole: the same over the series, F.min too."""
    so_far, whole = so_far or {}, whole or {}
    own, at = F.struct(*beside) if beside else F.lit(None), F.struct(*order)
    facts = [F.min_by(own, at).alias("_first"), F.max_by(own, at).alias("_last")] if beside else []
    facts += [fold(column).alias(f"_own_{name}") for name, (fold, column) in {**so_far, **whole}.items()]
    series = Window.partitionBy(*by)
    before = series.orderBy(SEGMENT)
    carried = [F.lag("_last").over(before).alias("_prev"), F.lead("_first").over(before).alias("_next")] if beside else []
    carried += [fold(f"_own_{name}").over(before.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_to_{name}") for name, (fold, _) in so_far.items()]
    carried += [fold(f"_own_{name}").over(series).alias(name) for name, (fold, _) in whole.items()]
    edges = rows.groupBy(*by, SEGMENT).agg(*(facts or [F.count(F.lit(1)).alias("_n")])).select(*by, SEGMENT, *carried)
    within = Window.partitionBy(*by, SEGMENT).orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    if beside:  # a struct is never null, so a missing neighbour is one beyond the segment
        out |= {"prev": F.coalesce(F.lag(own).over(within), F.col("_prev")), "next": F.coalesce(F.lead(own).over(within), F.col("_next"))}
    for name, (fold, column) in so_far.items():
        here, earlier = fold(column).over(upto), F.col(f"_to_{name}")
        out[name] = F.greatest(here, earlier) if fold is F.max else F.coalesce(here + earlier, here, earlier)
    both = rows.join(edges, [*by, SEGMENT]).withColumns(out) if out else rows.join(edges, [*by, SEGMENT])
    return both.drop("_prev", "_next", *[f"_to_{name}" for name in so_far])


def runs(samples: DataFrame, value: str = "label", by: tuple[str, ...] = ("series",), parts: int | None = None) -> DataFrame:
    """As `intervals.runs`: by, run, start, last, value, n of the stretches of one value, a missing value being one."""
    rows = dealt(samples.select(*by, *ORDER, F.col(value).alias("_v")), by, parts=parts)
    rows = scan(rows, by, beside=("_v",))
    change = F.col("prev").isNull() | ~F.col("_v").eqNullSafe(F.col("prev._v"))
    rows = scan(rows.withColumn("_c", change.cast("long")), by, so_far={"run": (F.sum, F.col("_c"))})
    return rows.groupBy(*by, "run").agg(F.min("us").alias("start"), F.max("us").alias("last"), F.first("_v").alias("value"), F.count(F.lit(1)).alias("n"))


def gaps(samples: DataFrame, by: tuple[str, ...] = ("series",), parts: int | None = None) -> DataFrame:
    """by, us, rid, gap: micros since the sample before, null for the first."""
    rows = scan(dealt(samples.select(*by, *ORDER), by, parts=parts), by, beside=("us",))
    return rows.select(*by, *ORDER, (F.col("us") - F.col("prev.us")).alias("gap"))


def sample_kinds(samples: DataFrame, value: str = "value", by: tuple[str, ...] = ("series",), tolerance: float = 1e-6, parts: int | None = None) -> DataFrame:
    """As `series.sample_kinds`: samples with kind, -1 missing, 0 genuine, 1 interpolated, 2 held."""
    v = F.col(value)
    rows = scan(dealt(samples, by, parts=parts), by, beside=(value,), whole={"_most": (F.max, F.abs(v)), "_n": (F.sum, v.isNotNull().cast("long"))})
    tol = tolerance * F.greatest(F.col("_most"), F.lit(1e-12))
    step, ahead = v - F.col("prev")[value], F.col("next")[value] - v
    flat = lambda d: F.coalesce(F.abs(d) <= tol, F.lit(False))
    straight = F.coalesce(F.abs(ahead - step) <= tol, F.lit(False))
    kind = F.when(v.isNull(), MISSING).when(F.col("_n") < 2, GENUINE).when(flat(step), HELD).when(straight & ~flat(ahead), INTERPOLATED).otherwise(GENUINE)
    return rows.withColumn("kind", kind.cast("int")).select(*samples.columns, "kind")


def cut(samples: DataFrame, size: int, keep: str | None = None, label: str = "label", by: tuple[str, ...] = ("series",), parts: int | None = None) -> DataFrame:
    """As `windows.cut`: the kept samples with window and at, consecutive windows of `size` samples of one label."""
    if size < 1:
        raise ValueError("a window has at least one sample")
    kept = F.col(keep) if keep else F.lit(True)
    rows = dealt(samples.withColumns({"_l": F.col(label), "_k": kept}), by, parts=parts)
    rows = scan(rows, by, beside=("_l", "_k"), so_far={"_i": (F.sum, F.lit(1).cast("long"))})
    change = F.col("prev").isNull() | ~F.col("_l").eqNullSafe(F.col("prev._l")) | ~F.col("_k").eqNullSafe(F.col("prev._k"))
    rows = scan(rows.withColumn("_from", F.when(change, F.col("_i"))).drop("prev", "next"), by, so_far={"_begin": (F.max, F.col("_from"))})
    rows = rows.where("_k").withColumn("at", ((F.col("_i") - F.col("_begin")) % size).cast("int"))
    rows = scan(rows, by, so_far={"_w": (F.sum, (F.col("at") == 0).cast("long"))})
    return rows.select(*samples.columns, "at", (F.col("_w") - 1).alias("window"))


def quantiles(rows: DataFrame, value: str, shares: dict[str, float], by: tuple[str, ...] = ("series",), parts: int | None = None) -> DataFrame:
    """by, n and, by name, the exact quantiles of the values, on the line between the two nearest ranks; null without a value.

    Equal values are counted together before they are shuffled, distinct ones ranked along ranges: no task holds a group, and ties
    cost one row. A NaN counts as the greatest value."""
    if not all(0 <= p <= 1 for p in shares.values()):
        raise ValueError("a share lies from 0 to 1")
    v = F.col(value).cast("double")
    counted = rows.select(*by, v.alias("_v")).where("_v is not null").groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    ranked = scan(dealt(counted, by, ("_v",), parts), by, ("_v",), so_far={"_to": (F.sum, F.col("_n"))}, whole={"_all": (F.sum, F.col("_n"))})
    picks = []
    for i, p in enumerate(shares.values()):
        place = F.lit(float(p)) * (F.col("_all") - 1)
        for side, rank in (("a", F.floor(place)), ("b", F.ceil(place))):
            here = (rank < F.col("_to")) & (rank >= F.col("_to") - F.col("_n"))
            picks.append(F.max(F.when(here, F.col("_v"))).alias(f"_{side}{i}"))
    found = ranked.groupBy(*by).agg(F.max("_all").alias("n"), *picks)
    out = []
    for i, (name, p) in enumerate(shares.items()):
        place = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.col(f"_a{i}"), F.col(f"_b{i}")
        out.append(F.when(low == high, low).otherwise(low + (high - low) * (place - F.floor(place))).alias(name))
    empty = rows.dropna(subset=list(by)).select(*by).distinct()
    return empty.join(found, list(by), "left").select(*by, F.coalesce("n", F.lit(0).cast("long")).alias("n"), *out)
