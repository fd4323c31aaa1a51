"""Windows of one label, their statistics, and how well a statistic tells event from normal windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.operators.series import ordered


def cut(samples: DataFrame, size: int, keep: str | None = None, label: str = "label", by: tuple[str, ...] = ("series",)) -> DataFrame:
    """The samples with window (number in its series) and at (place in its window): consecutive windows of `size` samples of one label.

    A dropped sample (keep false) ends a run and is left out; the last window of a run may be short."""
    if size < 1:
        raise ValueError("a window has at least one sample")
    w = ordered(*by)
    kept = F.col(keep) if keep else F.lit(True)
    change = (F.row_number().over(w) == 1) | ~F.col(label).eqNullSafe(F.lag(label).over(w)) | ~kept.eqNullSafe(F.lag(kept).over(w))
    rows = samples.withColumn("_c", change.cast("int")).withColumn("_run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(kept)
    rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*by, "_run").orderBy("us", "rid")) - 1)
    rows = rows.withColumn("at", (F.col("_i") % size).cast("int"))
    return rows.withColumn("window", F.sum((F.col("at") == 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_c", "_run", "_i")


def windows(placed: DataFrame, size: int, value: str = "value", label: str = "label", by: tuple[str, ...] = ("series",)) -> DataFrame:
    """One row for each window: start, label, n_valid (samples), nan_share, padded, values (zeros after the last sample)."""
    own = F.sort_array(F.collect_list(F.struct("at", F.col(value).alias("v"))))
    out = placed.groupBy(*by, "window").agg(F.min("us").alias("start"), F.max("us").alias("last"), F.first(label).alias("label"), F.count(F.lit(1)).alias("n_valid"), (1 - F.count(value) / F.count(F.lit(1))).alias("nan_share"), own.alias("_v"))
    padded = F.col("n_valid") < size
    values = F.concat(F.transform("_v", lambda x: x.v), F.array_repeat(F.lit(0.0), (size - F.col("n_valid")).cast("int")))
    return out.withColumns({"padded": padded, "values": values}).drop("_v")


def complete(w: DataFrame, labels: list[int] | None = None, whole: bool = True, gaps: bool = False) -> DataFrame:
    """The windows with a known label (of `labels`), whole ones, without missing readings."""
    out = w.where(F.col("label").isNotNull())
    if labels is not None:
        out = out.where(F.col("label").isin(labels))
    if whole:
        out = out.where(~F.col("padded"))
    return out if gaps else out.where(F.col("nan_share") == 0)


def neighbour_breaks(w: DataFrame, tolerance_us: int, by: tuple[str, ...] = ("series",)) -> DataFrame:
    """w with breaks: the window begins later than tolerance after the last sample of the one before."""
    before = F.lag("last").over(Window.partitionBy(*by).orderBy("window"))
    return w.withColumn("breaks", F.coalesce(F.col("start") - before > tolerance_us, F.lit(False)))


def page(w: DataFrame, number: int, size: int = 12, by: tuple[str, ...] = ("series",)) -> DataFrame:
    """The windows of one page of each series."""
    k = F.row_number().over(Window.partitionBy(*by).orderBy("window"))
    return w.withColumn("_k", k).where((F.col("_k") > number * size) & (F.col("_k") <= (number + 1) * size)).drop("_k")


def auc(rows: DataFrame, score: str, event: Column, by: list[str], least: int = 5) -> DataFrame:
    """by, n_event, n_normal, auc, separation of finite scores: the share of pairs in which the event's score is higher, ties as half; separation is 2 |auc - 0.5|.

    Groups with under `least` of either are left out. Equal scores are counted together before ranks are summed."""
    known = rows.where(F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf")) & event.isNotNull()).withColumn("_e", event)
    ties = known.groupBy(*by, score).agg(F.count_if("_e").alias("e"), F.count_if(~F.col("_e")).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = ties.withColumn("w", F.col("e") * (below + F.col("n") / 2)).groupBy(*by).agg(F.sum("e").alias("n_event"), F.sum("n").alias("n_normal"), F.sum("w").alias("w"))
    out = out.where((F.col("n_event") >= least) & (F.col("n_normal") >= least)).withColumn("auc", F.col("w") / (F.col("n_event") * F.col("n_normal"))).drop("w")
    return out.withColumn("separation", 2 * F.abs(F.col("auc") - 0.5))


#: Samples of a task that cuts windows.
SAMPLES = 250_000
#: What is told of a window.
STATISTICS = ("mean", "std", "skew", "kurtosis", "q05", "q25", "median", "q75", "q95", "low", "high", "snr")


def ranked_auc(rows: DataFrame, score: str, event: Column, by: list[str], least: int = 5) -> DataFrame:
    """As `auc`, by ranks of all scores along one sort, for scores that are seldom equal: nothing is gained by counting equal ones before."""
    known = rows.where(F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf")) & event.isNotNull()).withColumn("_e", event)
    w = Window.partitionBy(*by).orderBy(score)
    # the mean of the ranks of equal scores lies between the first of them and the last
    known = known.withColumn("_r", F.rank().over(w) + F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    out = known.groupBy(*by).agg(F.count_if("_e").alias("n_event"), F.count_if(~F.col("_e")).alias("n_normal"), F.sum(F.when(F.col("_e"), F.col("_r"))).alias("_r"))
    out = out.where((F.col("n_event") >= least) & (F.col("n_normal") >= least))
    above = (F.col("_r") - F.col("n_event") * (F.col("n_event") + 1)) / 2
    out = out.withColumn("auc", above / (F.col("n_event") * F.col("n_normal"))).drop("_r")
    return out.withColumn("separation", 2 * F.abs(F.col("auc") - 0.5))


def statistics(v: np.ndarray, least: int = 8) -> np.ndarray:
    """STATISTICS (columns) of windows of readings (rows of v), NaN being a missing one. A flat window has its value as mean and no deviation; flat windows
    and those of under `least` readings have neither skew nor kurtosis nor signal to noise; without a reading all are NaN."""
    here = ~np.isnan(v)
    k = here.sum(axis=1)
    n = np.maximum(k, 1)
    total = lambda x: np.add.reduce(np.where(here, x, 0.0).T.copy(), axis=0)  # noqa: E731  one reading after the other, as SQL adds
    ranked = np.sort(v, axis=1)
    row = np.arange(len(v))
    low, high = ranked[:, 0], ranked[row, n - 1]
    mean = total(v) / n
    away = v - mean[:, None]
    square = away * away
    m2, m3, m4 = total(square) / n, total(square * away) / n, total(square * square) / n
    before, steps = v[:, 0].copy(), np.zeros(len(v))
    for x in v.T[1:]:
        step = x - before
        steps += np.where(np.isnan(step), 0.0, step * step)
        before = np.where(np.isnan(x), before, x)
    noise = steps / np.maximum(k - 1, 1) / 2

    def quantile(share: float) -> np.ndarray:
        place = (n - 1) * share
        below = np.floor(place).astype(np.int64)
        a, b = ranked[row, below], ranked[row, np.minimum(below + 1, n - 1)]
        return a + (b - a) * (place - below)

    flat = low == high
    told = ~flat & (k >= least)
    with np.errstate(divide="ignore", invalid="ignore"):
        skew, kurtosis, snr = m3 / np.power(m2, 1.5), m4 / (m2 * m2) - 3, np.where(noise > 0, m2 / noise, np.inf)
    out = {"mean": np.where(flat, low, mean), "std": np.where(flat, 0.0, np.sqrt(m2)), "skew": np.where(told, skew, np.nan), "kurtosis": np.where(told, kurtosis, np.nan)}
    out |= {name: quantile(q) for name, q in (("q05", 0.05), ("q25", 0.25), ("median", 0.5), ("q75", 0.75), ("q95", 0.95))} | {"low": low, "high": high, "snr": np.where(told & (k >= 3), snr, np.nan)}
    return np.where((k > 0)[:, None], np.column_stack([out[c] for c in STATISTICS]), np.nan)


def rounded(v: np.ndarray, digits: int) -> np.ndarray:
    """v to so many decimals, halves away from zero, as SQL rounds; no zero is negative."""
    with np.errstate(over="ignore", invalid="ignore"):
        far = np.abs(v) * 10.0**digits
        whole = np.floor(far)
        near = np.copysign((whole + (far - whole >= 0.5)) / 10.0**digits, v) + 0.0
    return np.where(np.isfinite(far), near, v)


def described(samples: DataFrame, sizes: tuple[int, ...], value: str = "value", label: str = "label", by: tuple[str, ...] = ("series",), order: tuple[str, ...] = ("us", "rid"), least: int = 8, digits: int = 6) -> DataFrame:
    """by, size, event (the label is not 0), told: STATISTICS, to `digits` decimals, of the complete windows of one label, of each size; the sizes divide the largest.

    The samples come dealt by whole series. They are sorted once and walked in batches; of a run that goes on, what lies after its last window of the
    largest size waits for the next batch. Samples alike in `order` go by label and value, so that how the input lies does not tell; nulls come last."""
    largest, kinds = max(sizes), dict(samples.dtypes)

    def walk(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def changes(column):
            a, b = column.slice(1), column.slice(0, len(column) - 1)
            other = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
            return other | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))

        def told(rows, closed):
            """Windows of rows, and the row from which they wait."""
            new = np.ones(rows.num_rows, bool)
            new[1:] = np.logical_or.reduce([changes(rows.column(c)) for c in (*by, "label")])
            begins = np.flatnonzero(new)
            lengths = np.diff(np.append(begins, rows.num_rows))
            if not closed:
                lengths[-1] -= lengths[-1] % largest
            v = rows.column("_v").to_numpy(zero_copy_only=False)
            event = rows.column("_e").to_numpy(zero_copy_only=False)
            out = []
            for size in sizes:
                m = lengths // size
                starts = np.repeat(begins, m) + size * (np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m))
                if len(starts):
                    found = pa.array(rounded(statistics(v[starts[:, None] + np.arange(size)], least), digits).ravel())
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1, dtype=np.int32) * len(STATISTICS)), found)
                    own = [rows.column(c).take(pa.array(starts)) for c in by]
                    out.append(pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(starts), size, np.int32)), pa.array(event[starts]), lists], names=[*by, "size", "event", "told"]))
            return out, begins[-1] + lengths[-1]

        held = None
        for batch in batches:
            rows = pa.concat_batches([held, batch]) if held is not None and held.num_rows else batch
            if rows.num_rows:
                found, rest = told(rows, False)
                held = rows.slice(rest)
                yield from found
        if held is not None and held.num_rows:
            yield from told(held, True)[0]

    at = [F.asc_nulls_last(c) for c in (*order, "label", "_v")]
    known = samples.withColumns({"label": F.col(label), "_e": F.col(label) != 0, "_v": F.col(value).cast("double")}).sortWithinPartitions(*by, *at)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "size int, event boolean, told array<double>"])
    return known.select(*by, "label", "_e", "_v").mapInArrow(walk, schema)


def separation_study(samples: DataFrame, sizes: tuple[int, ...] = (256, 512, 1024), by: tuple[str, ...] = ("series",), order: tuple[str, ...] = ("us", "rid"), least: int = 8, digits: int = 6) -> DataFrame:
    """by, size, stat, n_event, n_normal, separation: how well each of STATISTICS tells the complete windows of an event (label not 0) from normal ones.

    Each size is twice the one before; the samples are sorted and cut once, for all sizes. Statistics are compared to `digits` decimals. Pairs of under
    five windows of either kind are left out.

    Samples are counted first and dealt, whole series each, over as many tasks as that takes at about SAMPLES: sorting, cutting and telling keep to one
    task's series, and its memory does not grow with the input. Windows are dealt likewise, a row each, and their statistics become rows where they are."""
    if any(b != 2 * a for a, b in zip(sizes, sizes[1:])):
        raise ValueError("each size must be twice the one before")
    known = samples.where("label is not null")
    parts = max(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known.count() // SAMPLES))
    found = described(known.repartition(parts, *by), sizes, by=by, order=order, least=least, digits=digits).repartition(parts, *by)
    rows = found.select(*by, "size", "event", F.posexplode("told").alias("_at", "v"))
    stat = F.get(F.array(*[F.lit(s) for s in STATISTICS]), F.col("_at"))
    return ranked_auc(rows, "v", F.col("event"), [*by, "size", "_at"]).select(*by, "size", stat.alias("stat"), "n_event", "n_normal", "separation")


def best_statistics(study: DataFrame, by: list[str]) -> DataFrame:
    """by, stat, separation: the statistic that separates best, of equal ones the first by name."""
    order = Window.partitionBy(*by).orderBy(F.desc(F.round("separation", 9)), "stat")
    return study.withColumn("_k", F.row_number().over(order)).where("_k = 1").select(*by, "stat", "separation")


def wins(study: DataFrame, by: list[str]) -> DataFrame:
    """size, stat, wins, median: of how many of `by` a statistic is the best at a size, and the median of its separations."""
    first = best_statistics(study, [*by, "size"]).groupBy("size", "stat").agg(F.count(F.lit(1)).alias("_w"))
    middle = study.groupBy("size", "stat").agg(F.percentile("separation", 0.5).alias("median"))
    return middle.join(first, ["size", "stat"], "left").select("size", "stat", F.coalesce("_w", F.lit(0)).alias("wins"), "median")
