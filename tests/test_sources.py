"""Recordings as files, derived tables, model outputs and the stream."""

import datetime as dt
import json
import os
import time

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from chronolith.operators import intervals as I
from chronolith.sources import recordings as R
from chronolith.streaming import ingest

T0 = dt.datetime(2017, 2, 1, 1)


def write(root, entity, fault, hours, n, label, **columns):
    start = T0 + dt.timedelta(hours=hours)
    folder = root / str(fault)
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / f"WELL-{entity:05d}_{start:%Y%m%d%H%M%S}.parquet"
    data = {"timestamp": pa.array([start + dt.timedelta(seconds=i) for i in range(n)], pa.timestamp("us"))}
    data |= {k: pa.array([v(i) if callable(v) else v for i in range(n)], pa.float64()) for k, v in columns.items()}
    data |= {"class": pa.array([label] * n, pa.int16()), "state": pa.array([0] * n, pa.int16())}
    pq.write_table(pa.table(data), path)
    return path


@pytest.fixture
def root(tmp_path):
    root = tmp_path / "data"
    for h in (0, 1, 2):
        write(root, 1, 0, h, 7200, 0, **{"P-PDG": lambda i: 1e7 + i, "T-TPT": 118.5})
    write(root, 2, 9, 0, 600, 9, **{"P-PDG": lambda i: float("nan") if i < 300 else 2.0, "QGL": lambda i: i})
    (root / "9" / "SIMULATED_00001.parquet").write_text("not parquet")
    return root


def test_files_and_load(spark, root):
    listing = R.files(spark, str(root))
    assert sorted((r.entity, r.fault) for r in listing.collect()) == [(1, 0)] * 3 + [(2, 9)]
    x = R.load(spark, str(root))
    assert x.count() == 3 * 7200 + 600 and x.where("entity = 2 and `P-PDG` is not null").count() == 300
    assert x.where("entity = 1 and QGL is not null").count() == 0
    few = R.load(spark, str(root), ["T-TPT", "ABSENT"])
    assert "P-PDG" not in few.columns and few.where("ABSENT is not null").count() == 0
    from pyspark.sql import functions as F

    cat = I.catalogue(x.select(F.col("series"), "entity", "fault", "us", "rid", F.col("`P-PDG`").alias("value"), "label"))
    bars = I.bars(I.join_groups(cat.withColumn("series", F.xxhash64("series"))))
    assert sorted((r.entity, r.n_members) for r in bars.collect()) == [(1, 3), (2, 1)]


def test_nanoseconds(spark, tmp_path):
    folder = tmp_path / "1"
    folder.mkdir()
    pd.DataFrame({"P-PDG": [1.0, None], "class": [0, 0]}, index=pd.DatetimeIndex(pd.to_datetime(["2020-01-01", "2020-01-02"]).astype("datetime64[ns]"), name="timestamp")).to_parquet(folder / "WELL-00003_20200101000000.parquet")
    x = R.load(spark, str(tmp_path)).orderBy("us").collect()
    assert [r.us for r in x] == [1577836800000000, 1577923200000000] and [r["P-PDG"] for r in x] == [1.0, None]


def test_refresh_and_derived(spark, root, tmp_path):
    scanned = []

    def scan(files):
        scanned.append(files.count())
        return files

    first = R.files(spark, str(root))
    first.write.parquet(str(tmp_path / "cache"))
    cached = spark.read.parquet(str(tmp_path / "cache"))
    assert R.changed(R.files(spark, str(root)), cached).count() == 0
    before = R.digest(first).first().digest
    time.sleep(1.1)
    path = write(root, 2, 9, 0, 700, 9, **{"P-PDG": 1.0})
    os.utime(path)
    again = R.refreshed(spark, str(root), cached, scan)
    assert scanned == [1] and again.count() == 4 and R.digest(R.files(spark, str(root))).first().digest != before
    R.save_derived(spark.range(3), str(tmp_path / "d"), before, 1)
    assert R.load_derived(spark, str(tmp_path / "d"), before, 1).count() == 3
    R.save_derived(spark.range(0), str(tmp_path / "empty"), before, 1)
    assert R.load_derived(spark, str(tmp_path / "empty"), before, 1).count() == 0 and R.load_derived(spark, str(tmp_path / "empty"), before, 2) is None
    assert R.load_derived(spark, str(tmp_path / "d"), "other", 1) is None and R.load_derived(spark, str(tmp_path / "none"), before, 1) is None


def test_dimensions(spark):
    assert R.channels(spark).count() == 27
    ini = "[PARQUET_FILE_PROPERTIES]\nP-PDG = Pressure at the gauge [Pa]\nT-TPT = Temperature [oC]\nESTADO-W1 = Valve [0, 0.5, or 1]\nclass = Label\n"
    got = {r.channel: (r.unit, r.enumerated, r.low, r.high) for r in R.channels(spark, ini).collect()}
    assert got == {"P-PDG": ("Pa", False, 0, 1e8), "T-TPT": ("°C", False, -50, 250), "ESTADO-W1": ("-", True, -1e8, 1e8)}
    assert [r.description for r in R.channels(spark, ini).orderBy("ord").collect()] == ["Pressure at the gauge", "Temperature", "Valve"]
    assert R.channels(spark, "[OTHER]\na = b\n").count() == 0
    one = R.channels(spark).where("channel = 'ESTADO-M1'").first()
    assert (one.ord, one.unit, one.enumerated, one.description, one.placement) == (3, "-", True, "", "Seabed")


def test_model_outputs(spark, tmp_path):
    write(tmp_path / "m", 1, 0, 0, 10, 0, verdict=1.0, score=0.5)
    (tmp_path / "m" / "model.json").write_text(json.dumps({"name": "x", "kind": "detection", "labels": "0/1", "label_column": "verdict"}))
    meta, out = R.model_outputs(spark, str(tmp_path / "m"))
    assert meta["kind"] == "detection" and {(r.verdict, r.score) for r in out.collect()} == {(1, 0.5)}
    R.save_outputs(out, str(tmp_path / "saved"))
    assert spark.read.parquet(str(tmp_path / "saved")).count() == 10
    R.export_table(out, str(tmp_path / "tsv"))
    assert spark.read.option("sep", "\t").option("header", "true").csv(str(tmp_path / "tsv")).count() == 10
    (tmp_path / "m" / "model.json").write_text(json.dumps({"name": "x", "kind": "guess", "labels": "0"}))
    with pytest.raises(ValueError):
        R.model_outputs(spark, str(tmp_path / "m"))


def test_outputs_carry_their_provenance(spark, tmp_path):
    from pyspark.sql import functions as F

    where = str(tmp_path / "out")
    rows = spark.range(6000).select((F.col("id") % 2).cast("int").alias("fault"), (F.col("id") % 3).cast("string").alias("series"), (F.lit(1_600_000_000_000_000) + F.col("id") * 1_000_000).alias("us"), F.lit(1).cast("tinyint").alias("verdict"), F.lit(0.5).cast("float").alias("score"))
    spec = {"name": "chart", "kind": "detection", "labels": "0/1", "provenance": {"producer": "a", "note": "b"}}
    wrote = R.save_outputs(rows, where, spec, {"producer": "c"})
    meta, back = R.saved_outputs(spark, where)
    assert meta == wrote and meta["name"] == "chart" and meta["provenance"]["instances"] == 6
    assert (meta["provenance"]["producer"], meta["provenance"]["note"]) == ("c", "b") and dt.datetime.fromisoformat(meta["provenance"]["written_at"]).tzinfo
    assert sorted(back.select(rows.columns).collect()) == sorted(rows.collect()) and dict(back.dtypes)["series"] == "string"
    files = sorted((tmp_path / "out").rglob("*.parquet"))
    assert len(files) == 6
    for f in files:
        column = {c.path_in_schema: c for c in (pq.ParquetFile(f).metadata.row_group(0).column(i) for i in range(3))}["us"]
        assert column.compression == "ZSTD" and "DELTA_BINARY_PACKED" in column.encodings and column.total_compressed_size < 400
    R.save_outputs(rows.limit(0), where, spec)
    meta, back = R.saved_outputs(spark, where)
    assert meta["provenance"]["instances"] == 0 and back.count() == 0 and set(back.columns) == set(rows.columns)
    spark.range(2).write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError):
        R.saved_outputs(spark, str(tmp_path / "other"))


def test_stream(spark, root, tmp_path):
    schema = spark.read.parquet(str(next((root / "0").glob("*.parquet")))).schema

    def run():
        ingest.catalogue_stream(ingest.samples(spark, str(root), schema), "P-PDG", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert run() == 4
    write(root, 5, 1, 50, 60, 1, **{"P-PDG": 3.0, "T-TPT": 1.0})
    assert run() == 5
