"""Model outputs against labels, and the control chart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions.labels import label_fault, label_kind
from chronolith.operators.intervals import intersections
from chronolith.operators.segments import quantiles
from chronolith.sources.shared import stored


def agrees(verdict: Column, label: Column, fault: Column, kind: str = "detection") -> Column:
    """Whether a verdict agrees with a label; null where either is unknown. A detection says event or not; a classification names the fault, or 0."""
    known = verdict.isNotNull() & (label_kind(label) != "unknown")
    if kind == "detection":
        out = (verdict != 0) == (label_kind(label) != "normal")
    else:
        out = verdict == F.coalesce(label_fault(label), F.lit(0))
    return F.when(known, out)


def split(verdicts: DataFrame, segments: DataFrame, kind: str = "detection") -> DataFrame:
    """series, start, end, verdict, value, agrees: the verdict runs cut at the bounds of the label runs."""
    out = intersections(verdicts, segments).withColumnsRenamed({"a": "verdict", "b": "value"})
    return out.withColumn("agrees", agrees(F.col("verdict"), F.col("value"), F.lit(0), kind))


def agreement(parts: DataFrame, by: list[str]) -> DataFrame:
    """by, scored, compared, agreed (seconds) and share."""
    s = (F.col("end") - F.col("start")) / 1e6
    sums = parts.groupBy(*by).agg(F.sum(F.when(F.col("verdict").isNotNull(), s).otherwise(0.0)).alias("scored"), F.sum(F.when(F.col("agrees").isNotNull(), s).otherwise(0.0)).alias("compared"), F.sum(F.when(F.col("agrees"), s).otherwise(0.0)).alias("agreed"))
    return sums.withColumn("share", F.col("agreed") / F.nullif(F.col("compared"), F.lit(0.0)))


def as_class_runs(verdicts: DataFrame, kind: str = "detection") -> DataFrame:
    """verdicts (series, fault, start, end, value) as class runs: a detection names its recording's fault."""
    return verdicts.withColumn("value", F.when(F.col("value") == 0, 0).otherwise(F.col("fault") if kind == "detection" else F.col("value")))


def training_channels(wide: DataFrame, channels: list[str], by: str, least: int) -> DataFrame:
    """The channels with at least `least` readings that move in every group."""
    live = wide.groupBy(by).agg(*[((F.count(c) >= least) & (F.stddev_pop(c) > 0)).alias(c) for c in channels])
    all_ = live.agg(*[F.min(F.coalesce(F.col(c), F.lit(False)).cast("int")).alias(c) for c in channels])
    return all_.select(F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("ok")) for c in channels])).alias("p")).where("p.ok = 1").select("p.channel")


CHART = "grp long, channels array<string>, mean array<double>, std array<double>, loadings array<array<double>>, variance array<double>"


def fit_chart(training: DataFrame, channels: list[str], by: str, kept: float = 0.9, least: int = 600, limit: float = 0.99) -> DataFrame:
    """grp, mean, std, loadings, variance, t2_limit, q_limit of a principal-component chart of each group's complete rows.

    Means and covariances are sums that Spark combines; the small eigenproblem of a group is solved in a task; the limits
    are exact quantiles of the training rows' own statistics, ranked along ranges of them. Groups with under `least` complete rows, or a channel that never moves, have none."""
    import numpy as np
    import pandas as pd

    rows = training.dropna(subset=channels)
    pairs = [(i, j) for i in range(len(channels)) for j in range(i, len(channels))]
    sums = rows.groupBy(F.col(by).cast("long").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in channels]).alias("mean"), F.array(*[F.covar_pop(channels[i], channels[j]) for i, j in pairs]).alias("cov")).where(F.col("n") >= least)

    def solve(frames):
        for x in frames:
            out = []
            for g, mean, cov in zip(x["grp"], x["mean"], x["cov"]):
                p = len(channels)
                c = np.zeros((p, p))
                for (i, j), v in zip(pairs, cov):
                    c[i, j] = c[j, i] = v
                std = np.sqrt(np.diag(c))
                if p < 2 or not (std > 0).all():
                    continue
                value, vector = np.linalg.eigh(c / np.outer(std, std))
                value, vector = value[::-1], vector[:, ::-1]
                # components are taken while those before them explain less than asked, but never all of them
                short = [i for i in range(p) if value[:i].sum() < kept * value.sum()]
                k = min(len(short), p - 1)
                out.append((g, channels, list(mean), std.tolist(), vector[:, :k].T.tolist(), value[:k].tolist()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CHART.split(", ")])

    # written, so that its size is known: rows then meet a small one without being gathered by group
    model = stored(sums.mapInPandas(solve, CHART), "model")
    own = scored(rows.withColumn("grp", F.col(by).cast("long")), model, channels).select("grp", "t2", "q")
    each = quantiles(own.unpivot("grp", ["t2", "q"], "statistic", "v"), "v", {"limit": limit}, ("grp", "statistic"))
    limits = each.groupBy("grp").agg(*[F.max(F.when(F.col("statistic") == c, F.col("limit"))).alias(f"{c}_limit") for c in ("t2", "q")])
    return stored(model.join(limits, "grp"), "chart")


def scored(rows: DataFrame, model: DataFrame, channels: list[str]) -> DataFrame:
    """rows (with grp) with t2 and q; a channel without a reading stands at the training mean."""
    both = rows.join(model, "grp")
    z = F.array(*[F.coalesce((F.col(c) - F.col("mean")[i]) / F.col("std")[i], F.lit(0.0)) for i, c in enumerate(channels)])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    both = both.withColumn("_z", z).withColumn("_s", F.transform("loadings", lambda w: dot(w, F.col("_z"))))
    t2 = F.aggregate(F.zip_with("_s", "variance", lambda s, v: s * s / v), F.lit(0.0), lambda a, b: a + b)
    q = dot(F.col("_z"), F.col("_z")) - dot(F.col("_s"), F.col("_s"))
    return both.withColumns({"t2": t2, "q": F.greatest(q, F.lit(0.0))}).drop("_z", "_s")


def chart_labels(rows: DataFrame, model: DataFrame, channels: list[str]) -> DataFrame:
    """rows with label (1 beyond either limit) and score (the larger ratio to its limit, three decimals)."""
    out = scored(rows, model, channels)
    ratio = F.greatest(F.col("t2") / F.greatest("t2_limit", F.lit(1e-12)), F.col("q") / F.greatest("q_limit", F.lit(1e-12)))
    return out.withColumns({"label": (ratio > 1).cast("tinyint"), "score": F.round(ratio, 3).cast("float")}).drop("channels", "mean", "std", "loadings", "variance", "t2", "q", "t2_limit", "q_limit")


def scoring_job(rows: DataFrame, channels: list[str], key: str, by: str, normal: Column, chosen: Column | None = None, least: int = 600) -> tuple[DataFrame, DataFrame]:
    """Scores the chosen recordings (all, without a choice) by a chart for each `by`, fitted on its normal rows: by entity one model for all its
    recordings, by the recording itself (by = key) one for each. Fitting takes all normal rows, also of recordings that are not chosen.

    Two frames: the chosen rows whose group has a model, with label and score; and key, grp, training_samples, scored of every chosen
    recording, where one without a model is skipped (scored false)."""
    rows = rows.withColumn("grp", F.col(by).cast("long"))
    model = fit_chart(rows.where(normal), channels, by, least=least)
    kept = rows if chosen is None else rows.where(chosen)
    trained = rows.where(normal).dropna(subset=channels).groupBy("grp").agg(F.count(F.lit(1)).alias("training_samples"))
    report = kept.select(key, "grp").distinct().join(trained, "grp", "left").join(model.select("grp", F.lit(True).alias("_m")), "grp", "left")
    report = report.select(key, "grp", F.coalesce("training_samples", F.lit(0)).alias("training_samples"), F.coalesce("_m", F.lit(False)).alias("scored"))
    return chart_labels(kept, model, channels), report
