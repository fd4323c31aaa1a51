"""Recordings derived from the events table, in Spark and as SQL with the same rows.

Users are entities. A recording (series) is a run of 12 of a user's events; every second one begins with copies of the last four
events of the one before, so that recordings overlap. A user may have 12 million events before the numbers of recordings meet. Labels, missing values and steps follow from the event's id and type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Label codes of the event types; added to a transient's label.
CODES = {"view": 0, "click": 1, "error": 2, "purchase": 3}
OTHER, OFFSET = 4, 100


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, us (micros since 1970), rid, event_type, raw, code, pos (place among the entity's events)."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    code = F.lit(OTHER)
    for name, value in CODES.items():
        code = F.when(F.col("event_type") == name, value).otherwise(code)
    rows = rows.select(F.col("user_id").alias("entity"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("rid"), "event_type", F.col("value").alias("raw"), code.alias("code"))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("entity").orderBy("us", "rid")) - 1)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, entity, fault, us, rid, pos, value (in steps, with gaps), raw, label of every sample."""
    own = events(spark, sf_dir)
    slice_ = F.floor(F.col("pos") / 12)
    both = F.when((F.col("pos") % 12 >= 8) & (slice_ % 2 == 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = own.select("*", F.explode(both).alias("copy")).withColumn("slice", slice_ + F.col("copy"))
    code = F.col("code")
    label = (
        F.when(F.col("rid") % 7 == 0, None)
        .when((F.col("copy") == 1) & (F.col("entity") % 4 == 0), (code + 1) % 5)
        .when((code > 0) & (F.col("rid") % 3 == 0), code + OFFSET)
        .otherwise(code)
    )
    value = F.when(F.col("rid") % 11 != 0, F.floor(F.col("raw") / 5) * 5.0)
    return rows.select((F.col("entity") * 1_000_000 + F.col("slice")).alias("series"), "entity", (F.col("entity") % 5).alias("fault"), "us", "rid", "pos", value.alias("value"), "raw", label.cast("int").alias("label"))


SQL = """
ev AS (SELECT user_id AS entity, epoch_us(ts) AS us, event_id AS rid, event_type, value AS raw,
  CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS code,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
one AS (SELECT entity, pos // 12 AS slice, us, rid, raw, code, pos, 0 AS copy FROM ev
  UNION ALL SELECT entity, pos // 12 + 1, us, rid, raw, code, pos, 1 FROM ev WHERE pos % 12 >= 8 AND (pos // 12) % 2 = 0),
samples AS (SELECT entity * 1000000 + slice AS series, entity, entity % 5 AS fault, us, rid, pos,
  CASE WHEN rid % 11 <> 0 THEN floor(raw / 5) * 5.0 END AS value, raw,
  CASE WHEN rid % 7 = 0 THEN NULL WHEN copy = 1 AND entity % 4 = 0 THEN (code + 1) % 5
    WHEN code > 0 AND rid % 3 = 0 THEN code + 100 ELSE code END AS label FROM one)
"""


def with_samples(body: str) -> str:
    """SQL that may use ev and samples, body's own common tables first."""
    return f"WITH RECURSIVE {SQL}{body}"


TYPES = ("click", "error", "purchase", "signup", "view")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide recordings: entity, us, rid, state and for each event type the day's mean value, null without such an event."""
    day = 86_400_000_000
    rows = events(spark, sf_dir).withColumn("d", F.floor(F.col("us") / day))
    own = [F.avg(F.when(F.col("event_type") == t, F.col("raw"))).alias(t) for t in TYPES]
    out = rows.groupBy("entity", "d").agg(*own, F.max("code").alias("state"))
    return out.select("entity", (F.col("d") * day).alias("us"), F.col("d").alias("rid"), "state", *TYPES)


DAILY_SQL = """
daily AS (SELECT entity, us // 86400000000 * 86400000000 AS us, us // 86400000000 AS rid, max(code) AS state, avg(raw) FILTER (event_type = 'click') AS click, avg(raw) FILTER (event_type = 'error') AS error,
 avg(raw) FILTER (event_type = 'purchase') AS purchase, avg(raw) FILTER (event_type = 'signup') AS signup, avg(raw) FILTER (event_type = 'view') AS view FROM ev GROUP BY entity, us // 86400000000),
chan AS (SELECT entity, us, 'click' AS channel, click AS value FROM daily UNION ALL SELECT entity, us, 'error', error FROM daily UNION ALL SELECT entity, us, 'purchase', purchase FROM daily
 UNION ALL SELECT entity, us, 'signup', signup FROM daily UNION ALL SELECT entity, us, 'view', view FROM daily)
"""


def with_daily(body: str) -> str:
    return f"WITH {SQL}, {DAILY_SQL}{body}"
