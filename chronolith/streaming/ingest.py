"""New recordings as a stream: each file's catalogue row as it lands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from chronolith.operators.intervals import catalogue
from chronolith.sources.recordings import NAME, _keys


def samples(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The samples of files that land under root, as an unbounded table."""
    raw = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "WELL-*.parquet").parquet(root)
    keys = _keys(F.col("_metadata.file_path"))
    us = F.unix_micros(F.col("timestamp").cast("timestamp"))
    sensors = [f.name for f in schema if f.name not in ("timestamp", "class", "state")]
    rows = raw.where(F.col("_metadata.file_path").rlike(NAME))
    return rows.select(F.regexp_replace(keys["file"], r"\.parquet$", "").alias("series"), keys["entity"].alias("entity"), keys["fault"].alias("fault"), us.alias("us"), us.alias("rid"), *[F.col(f"`{c}`") for c in sensors], F.col("class").alias("label"))


def catalogue_stream(stream: DataFrame, channel: str, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the catalogue rows of each batch's files to `out`; a file is whole in one batch. A rerun batch replaces its own rows."""

    def add(batch: DataFrame, number: int) -> None:
        catalogue(batch.withColumn("value", F.col(f"`{channel}`"))).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
