"""What an event does to the readings: moves, swings, their directions against a table of expected ones, rates; and readings beyond their range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions.labels import DEFAULT_OFFSET, bounds, plausible

#: Least move that counts as one, by unit (fixed values).
DEAD_BAND = {"Pa": 1e4, "°C": 0.1, "%": 1.0}
HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000


def moves(rows: DataFrame, hours: float = 1.0, offset: int = DEFAULT_OFFSET) -> DataFrame:
    """series, channel, unit, fault, entity, onset, last, before, after, move, swing of every recording of an event.

    rows: series, entity, fault, us, label, channel, unit, reading. The event is what carries the recording's fault, steady or transient, from
    its onset; move is the median of the last `hours` of the event less the median of the last `hours` of normal operation before the
    onset, swing the 95th less the 5th percentile over the event. Only plausible readings count; without any on one side a move is null."""
    event = (F.col("fault") > 0) & F.col("label").isin(F.col("fault"), F.col("fault") + offset)
    at = rows.withColumn("_e", F.coalesce(event, F.lit(False)))
    span = at.where("_e").groupBy("series").agg(F.min("us").alias("onset"), F.max("us").alias("last"))
    known = at.join(span, "series")
    normal = (F.col("label") == 0) & (F.col("us") < F.col("onset"))
    calm = known.where(normal).groupBy("series").agg(F.max("us").alias("_calm"))
    known = known.join(calm, "series", "left").withColumn("_v", plausible(F.col("reading").cast("double"), *bounds(F.col("unit"))))
    width = F.lit(int(hours * HOUR_US))
    after = F.when(F.col("_e") & (F.col("us") > F.col("last") - width), F.col("_v"))
    before = F.when(normal & (F.col("us") > F.col("_calm") - width), F.col("_v"))
    over = F.percentile(F.when(F.col("_e"), F.col("_v")), [0.05, 0.95])
    out = known.groupBy("series", "channel", "unit", "fault", "entity", "onset", "last").agg(F.percentile(before, 0.5).alias("before"), F.percentile(after, 0.5).alias("after"), over.alias("_q"))
    return out.withColumns({"move": F.col("after") - F.col("before"), "swing": F.col("_q")[1] - F.col("_q")[0]}).drop("_q")


def direction(move: Column, unit: Column) -> Column:
    """1 up, -1 down, 0 within the unit's dead band (any move counts for a unit without one); null without a move."""
    band = F.lit(0.0)
    for name, width in DEAD_BAND.items():
        band = F.when(unit == name, width).otherwise(band)
    return F.when(move > band, 1).when(move < -band, -1).when(move.isNotNull(), 0)


def signatures(moved: DataFrame, expected: DataFrame) -> DataFrame:
    """fault, channel, sign, total, matches, against, lacking: of the recordings of a fault, how many moves of a channel go the way that the
    sources (fault, channel, sign) say, how many the other way, of all with a move, and how many have none."""
    way = direction(F.col("move"), F.col("unit"))
    rows = moved.join(expected, ["fault", "channel"]).withColumn("_w", way)
    return rows.groupBy("fault", "channel", "sign").agg(F.count("_w").alias("total"), F.count_if(F.col("_w") == F.col("sign")).alias("matches"), F.count_if(F.col("_w") == -F.col("sign")).alias("against"), F.count_if(F.col("_w").isNull()).alias("lacking"))


def rates(moved: DataFrame) -> DataFrame:
    """fault, entity, channel, n, rate: the median over an entity's events of a channel's move for each day from onset to end."""
    days = (F.col("last") - F.col("onset")) / DAY_US
    rate = F.when(days > 0, F.col("move") / days)
    return moved.groupBy("fault", "entity", "channel").agg(F.count(rate).alias("n"), F.percentile(rate, 0.5).alias("rate"))


def extremes(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, reading, rid, beyond: the reading that lies farthest outside its unit's range, on either side (of equally far ones the least rid)."""
    low, high = bounds(F.col("unit"))
    beyond = F.greatest(low - F.col("reading"), F.col("reading") - high)
    out = rows.withColumn("_b", beyond).where("_b > 0")
    order = F.struct("_b", -F.col("rid"))
    return out.groupBy(*by).agg(F.max_by("reading", order).alias("reading"), F.max_by("rid", order).alias("rid"), F.max("_b").alias("beyond"))
