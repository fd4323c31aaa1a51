"""Recordings as files: <root>/<class>/WELL-<entity>_<yyyyMMddHHmmss>.parquet, and tables derived from them."""

from __future__ import annotations

import configparser
import datetime as dt
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAME = r"WELL-(\d+)_(\d{14})\.parquet$"
LABELS = ("class", "state")
TIMES = ("timestamp",)
#: The channels of the dataset in its order with their units, when a dataset declares none; "-" is an enumerated state.
CHANNELS = (
    ("ABER-CKGL", "%"),
    ("ABER-CKP", "%"),
    ("ESTADO-DHSV", "-"),
    ("ESTADO-M1", "-"),
    ("ESTADO-M2", "-"),
    ("ESTADO-PXO", "-"),
    ("ESTADO-SDV-GL", "-"),
    ("ESTADO-SDV-P", "-"),
    ("ESTADO-W1", "-"),
    ("ESTADO-W2", "-"),
    ("ESTADO-XO", "-"),
    ("P-ANULAR", "Pa"),
    ("P-JUS-BS", "Pa"),
    ("P-JUS-CKGL", "Pa"),
    ("P-JUS-CKP", "Pa"),
    ("P-MON-CKGL", "Pa"),
    ("P-MON-CKP", "Pa"),
    ("P-MON-SDV-P", "Pa"),
    ("P-PDG", "Pa"),
    ("PT-P", "Pa"),
    ("P-TPT", "Pa"),
    ("QBS", "m³/s"),
    ("QGL", "m³/s"),
    ("T-JUS-CKP", "°C"),
    ("T-MON-CKP", "°C"),
    ("T-PDG", "°C"),
    ("T-TPT", "°C"),
)
#: Where a sensor is mounted, and the names of the wells' states (fixed values).
PLACEMENTS = {
    "Topside": ("ABER-CKGL", "ABER-CKP", "ESTADO-SDV-GL", "ESTADO-SDV-P", "P-JUS-BS", "P-JUS-CKGL", "P-JUS-CKP", "P-MON-CKGL", "P-MON-CKP", "P-MON-SDV-P", "QBS", "QGL", "T-JUS-CKP", "T-MON-CKP"),
    "Seabed": ("ESTADO-M1", "ESTADO-M2", "ESTADO-PXO", "ESTADO-W1", "ESTADO-W2", "ESTADO-XO", "P-ANULAR", "PT-P", "P-TPT", "T-TPT"),
    "Subsurface": ("ESTADO-DHSV", "P-PDG", "T-PDG"),
}
STATE_NAMES = ("Open", "Shut-In", "Flushing Diesel", "Flushing Gas", "Bullheading", "Closed With Diesel", "Closed With Gas", "Restart", "Depressurization")
UNITS = {"oC": "°C", "m3/s": "m³/s"}


def _keys(path: Column) -> dict[str, Column]:
    return {
        "fault": F.regexp_extract(path, r"/(\d+)/[^/]+$", 1).cast("int"),
        "entity": F.regexp_extract(path, NAME, 1).cast("int"),
        "file": F.regexp_extract(path, r"([^/]+)$", 1),
        "stamp": F.to_timestamp(F.regexp_extract(path, NAME, 2), "yyyyMMddHHmmss"),
    }


def files(spark: SparkSession, root: str) -> DataFrame:
    """One row for each recording's file: path, size, modified, fault, entity, file, stamp. Other files are ignored."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "WELL-*.parquet").load(root)
    rows = raw.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return rows.withColumns(_keys(F.col("path"))).where(F.col("path").rlike(NAME))


def load(spark: SparkSession, root: str, columns: list[str] | None = None) -> DataFrame:
    """The samples of all recordings with series, entity, fault, us and rid; a channel that a file lacks is null, NaN is null.

    With `columns` only those channels are read; an unknown one is a column of nulls. Times in nanoseconds are read as microseconds."""
    key = "spark.sql.legacy.parquet.nanosAsLong"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")  # while the footers are read; the schema holds it from then on
    try:
        found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "WELL-*.parquet").option("mergeSchema", "true").parquet(root)
    finally:
        spark.conf.set(key, before)
    raw = found
    path = F.col("_metadata.file_path")
    keys = _keys(path)
    time = next((c for c in raw.columns if c in TIMES or c.startswith("__index_level_")), None)
    kind = raw.schema[time].dataType
    us = F.floor(F.col(f"`{time}`") / 1000) if isinstance(kind, T.LongType) else F.unix_micros(F.col(f"`{time}`").cast("timestamp"))
    sensors = [c for c in raw.columns if c not in LABELS and c != time and not c.startswith("__index_level_")]
    wanted = sensors if columns is None else columns
    value = lambda c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)) if c in sensors else F.lit(None).cast("double")
    label = lambda c: (F.col(f"`{c}`") if c in raw.columns else F.lit(None)).cast("smallint")
    out = raw.select(F.regexp_replace(keys["file"], r"\.parquet$", "").alias("series"), keys["entity"].alias("entity"), keys["fault"].alias("fault"), us.alias("us"), us.alias("rid"), *[value(c).alias(c) for c in wanted], label("class").alias("label"), label("state").alias("state"))
    return out.where(F.col("entity").isNotNull())


def properties(text: str, section: str = "PARQUET_FILE_PROPERTIES") -> list[tuple[str, str]]:
    """(name, text) of the columns that an INI text describes, in its order; none without the section."""
    ini = configparser.ConfigParser(interpolation=None)
    ini.optionxform = str
    ini.read_string(text)
    return ini.items(section) if ini.has_section(section) else []


def channels(spark: SparkSession, declared: str | None = None) -> DataFrame:
    """channel, ord, unit, description, enumerated, low, high, placement: declared in an INI text, or the defaults.

    A declaration is a description and, in brackets at its end, a unit or a list of states; labels and times are no channels."""
    from chronolith.functions.labels import bounds

    told = properties(declared) if declared else [(n, f"[{u}]") for n, u in CHANNELS]
    rows = spark.createDataFrame([(n, i, t) for i, (n, t) in enumerate(r for r in told if r[0] not in LABELS + TIMES)], "channel string, ord int, text string")
    part = lambda k: F.regexp_extract("text", r"^(.*?)\s*(?:\[([^\]]*)\])?\s*$", k)
    rows = rows.withColumns({"description": part(1), "_in": part(2)})
    states = F.col("_in").rlike(",| or ") | (F.col("_in") == "-")
    named = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    place = F.create_map(*[F.lit(x) for p, names in PLACEMENTS.items() for n in names for x in (n, p)])
    rows = rows.withColumns({"enumerated": states, "unit": F.when(states, "-").otherwise(F.coalesce(named[F.col("_in")], F.col("_in"))), "placement": place[F.col("channel")]})
    low, high = bounds(F.col("unit"))
    return rows.select("channel", "ord", "unit", "description", "enumerated", low.cast("double").alias("low"), high.cast("double").alias("high"), "placement")


def state_name(state: Column) -> Column:
    """The name of a well's state; Unknown beyond the listed ones."""
    return F.coalesce(F.get(F.array(*map(F.lit, STATE_NAMES)), state.cast("int")), F.lit("Unknown"))


def events(spark: SparkSession, names: dict[int, tuple[str, bool]]) -> DataFrame:
    """label, name, has_transient of the event classes."""
    return spark.createDataFrame([(k, n, t) for k, (n, t) in sorted(names.items())], "label int, name string, has_transient boolean")


def digest(listing: DataFrame) -> DataFrame:
    """digest: sha1 of the ordered lines class/file:size:modified. Lines are as many as files."""
    line = F.format_string("%s/%s:%s:%s", F.col("fault"), F.col("file"), F.col("size"), F.unix_micros("modified"))
    return listing.agg(F.sha1(F.array_join(F.sort_array(F.collect_list(line)), "\n")).alias("digest"))


def changed(listing: DataFrame, cached: DataFrame) -> DataFrame:
    """The files of the listing that the cache lacks or knows with another size or time."""
    return listing.join(cached, ["fault", "file", "size", "modified"], "left_anti")


def refreshed(spark: SparkSession, root: str, cached: DataFrame, scan) -> DataFrame:
    """cached without the rows of changed and vanished files, and `scan` of the changed ones. cached has fault, file, size, modified."""
    listing = files(spark, root)
    kept = cached.join(listing.select("fault", "file", "size", "modified"), ["fault", "file", "size", "modified"], "left_semi")
    return kept.unionByName(scan(changed(listing, cached)), allowMissingColumns=True)


def save_derived(df: DataFrame, path: str, stamp: str, version: int) -> None:
    """Writes a derived table; the digest of what it was made from and its version stand in the schema, also of an empty table."""
    first = df.columns[0]
    df.withMetadata(first, df.schema[first].metadata | {"digest": stamp, "version": version}).write.mode("overwrite").parquet(path)


def load_derived(spark: SparkSession, path: str, stamp: str, version: int) -> DataFrame | None:
    """The derived table if it was made from the same files by the same version, else None."""
    try:
        df = spark.read.parquet(path)
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(error) or "does not exist" in str(error):
            return None
        raise
    made = df.schema[0].metadata
    return df if (made.get("digest"), made.get("version")) == (stamp, version) else None


def model_outputs(spark: SparkSession, root: str) -> tuple[dict, DataFrame]:
    """The description in model.json (name, kind, labels, and optionally label and score columns) and the outputs: fault, series, us, verdict, score."""
    meta = spark.read.option("multiLine", "true").json(f"{root}/model.json").first().asDict(recursive=True)
    missing = [k for k in ("name", "kind", "labels") if meta.get(k) is None]
    if missing or meta["kind"] not in ("detection", "classification"):
        raise ValueError(f"model.json lacks {missing}, or its kind is unknown")
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "WELL-*.parquet").parquet(root)
    label, score = meta.get("label_column") or "label", meta.get("score_column") or "score"
    keys = _keys(F.col("_metadata.file_path"))
    us = F.unix_micros(F.col("timestamp").cast("timestamp"))
    said = F.col(score).cast("float") if score in raw.columns else F.lit(None).cast("float")
    return meta, raw.select(keys["fault"].alias("fault"), F.regexp_replace(keys["file"], r"\.parquet$", "").alias("series"), us.alias("us"), F.col(label).cast("tinyint").alias("verdict"), said.alias("score"))


def save_outputs(df: DataFrame, path: str, spec: dict | None = None, provenance: dict | None = None) -> dict:
    """Writes model outputs (fault, series, us, verdict, score), one file for each recording, and returns the description stamped on them.

    Times are delta encoded, all is zstd. The description (name, kind, labels, ...) with its provenance, the time of writing and the
    number of recordings stands in every file's schema. An empty table is one empty file."""
    n = df.select("fault", "series").distinct().count()
    source = {**(spec or {}).get("provenance", {}), **(provenance or {}), "written_at": dt.datetime.now(dt.UTC).isoformat(timespec="seconds"), "instances": n}
    complete = {**(spec or {}), "provenance": source}
    kinds = {c: df.schema[c].dataType.simpleString() for c in ("fault", "series")}
    rows = df.withMetadata("us", {"model": json.dumps(complete), "keys": json.dumps(kinds)})
    rows = rows.repartition("fault", "series").sortWithinPartitions("fault", "series", "us")
    writer = rows.write.mode("overwrite").option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false")
    (writer.partitionBy("fault", "series") if n else writer).parquet(path)
    return complete


def saved_outputs(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """The stamped description of what `save_outputs` wrote, and the outputs."""
    df = spark.read.parquet(path)
    stamp = df.schema["us"].metadata if "us" in df.columns else {}
    if "model" not in stamp:
        raise ValueError(f"{path} has no description of a model")
    keys = json.loads(stamp["keys"])
    rest = [c for c in df.columns if c not in keys]
    return json.loads(stamp["model"]), df.select(*[F.col(c).cast(t).alias(c) for c, t in keys.items()], *rest)


def export_table(df: DataFrame, path: str) -> None:
    """A table as tab-separated text with a header."""
    df.write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)
