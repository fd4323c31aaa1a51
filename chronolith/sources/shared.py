"""Tables that are written once and read again, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local session (tests) has a folder of its own, deleted at the end of
    the process; a cluster has none, as its executors would each write to their own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN_DIR:
        path = tempfile.mkdtemp(prefix="chronolith-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _OWN_DIR.append("file://" + path)
    return _OWN_DIR[0]


def session_dir(spark: SparkSession) -> str:
    """The folder, inside the shared one, of what this application writes."""
    return f"{shared_dir(spark)}/chronolith-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again: its lineage ends at files that outlive an executor."""
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> bool:
    """Deletes all that `stored` wrote in this application; frames read from it can then not be read again."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
