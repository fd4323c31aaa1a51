"""The separation study against its SQL, on tables that hold windows without a reading."""

import datetime as dt
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.operators import windows as W
from chronolith.plans import registry
from tests.test_oracles import table

LINEITEM = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


def lines(wells=3, n=700):
    """Lines of half years of 50 each; (3 * order + well) % 7 is 0 in a stretch of each well, whose prices are then all missing."""
    out = []
    for well in range(1, wells + 1):
        for t in range(n):
            order = 7 * t - 5 * well if 120 <= t < 170 else 7 * t + t % 5
            day = dt.datetime(1995 + t // 100, 1 if t % 100 < 50 else 7, 1 + t % 25)
            out.append((order, 1, well, t % 7, float(t * 37 % 50), float(t * 7919 % 9973) + well, t * 3 % 11 / 100, 0.0, "A", "F", day))
    return out


def both(spark, folder, rows, name, sql=None):
    spark.createDataFrame(rows, LINEITEM).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    df = registry.QUERIES[name](spark, str(folder))
    got = table(df.columns, [tuple(r) for r in df.collect()])
    db = duckdb.connect()
    db.execute("set timezone='UTC'")
    db.execute(f"create view lineitem as select * from '{folder}/lineitem.parquet/*.parquet'")
    rel = db.sql(sql or registry.ORACLES[name])
    return got, table(rel.columns, rel.fetchall())


def test_a_window_without_a_reading_has_no_statistics(spark, tmp_path):
    x = spark.createDataFrame([(1, t, t, 0, None if t < 8 else float(t)) for t in range(16)], "series long, us long, rid long, label int, value double")
    empty, full = (dict(zip(W.STATISTICS, r.told)) for r in W.described(x.coalesce(1), (8,)).collect())
    assert all(math.isnan(v) for v in empty.values()) and full["mean"] == 11.5
    got, want = both(spark, tmp_path, lines(), "b14_separation_study")
    assert len(want[1]) > 30 and got == want


def samples(spark, wells=5, n=900, seed=8):
    rng = np.random.default_rng(seed)
    rows = [(w, t, t, int(t // (41 + w) % 2), None if rng.random() < 0.2 else float(rng.integers(0, 40)) / 4) for w in range(wells) for t in range(n)]
    return spark.createDataFrame(rows, "series long, us long, rid long, label int, value double"), rows


def test_windows_that_lie_across_batches(spark):
    x, rows = samples(spark)
    key = lambda df: sorted((r.series, r.size, r.event, tuple(None if math.isnan(v) else v for v in r.told)) for r in df.collect())
    dealt = x.repartition(3, "series")
    whole = key(W.described(dealt, (8, 16, 32)))
    for batch in ("1", "7", "32", "100"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            assert key(W.described(dealt, (8, 16, 32))) == whole
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # by hand: runs of 41 + w samples, the last one shorter
    runs = [min(41 + w, 900 - a) for w in range(5) for a in range(0, 900, 41 + w)]
    assert [sum(size == s for _, s, _, _ in whole) for size in (8, 16, 32)] == [sum(n // size for n in runs) for size in (8, 16, 32)]
    first = [v for w, t, _, _, v in rows if w == 2 and t < 8 and v is not None]
    own = [dict(zip(W.STATISTICS, r[3])) for r in whole if r[:3] == (2, 8, False)]
    assert any((w["median"], w["low"], w["high"]) == (np.median(first), min(first), max(first)) and w["mean"] == pytest.approx(np.mean(first), abs=1e-6) for w in own)


def test_halves_are_rounded_away_from_zero():
    v = np.array([0.5, -0.5, 1.5, 2.4999, -1e-9, np.inf, np.nan, 1e308])
    got = W.rounded(v, 0)
    assert got[:5].tolist() == [1.0, -1.0, 2.0, 2.0, 0.0] and not np.signbit(got[4]) and got[5] == np.inf and np.isnan(got[6]) and got[7] == 1e308
    assert W.rounded(np.array([0.0078125]), 6)[0] == 0.007813


def test_auc_by_ranks_equals_auc_by_ties(spark):
    rng = np.random.default_rng(9)
    rows = [(int(g), float(v), bool(e)) for g, v, e in zip(rng.integers(0, 4, 600), rng.integers(0, 9, 600), rng.random(600) < 0.3)] + [(0, float("nan"), True), (1, None, False), (2, float("inf"), True), (9, 1.0, True)]
    x = spark.createDataFrame(rows, "g int, v double, e boolean")
    assert sorted(W.ranked_auc(x, "v", F.col("e"), ["g"]).collect()) == sorted(W.auc(x, "v", F.col("e"), ["g"]).collect())


def test_study_sorts_its_samples_once(spark):
    x, _ = samples(spark)
    plan = W.separation_study(x, (8, 16, 32))._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("MapInArrow") == 1 and plan.count("Sort [") == 2 and plan.count("Exchange") == 2
    assert W.separation_study(x.where("series > 100"), (8, 16)).collect() == []


def test_tied_lines_go_by_value_however_they_lie(spark, tmp_path):
    """Lines of one order, number and day are in no order by the registered SQL alone; ours is that of the SQL with the value as last key."""
    name, tied = "b14_separation_study", []
    for i, r in enumerate(lines()):
        # every 40th line is there twice more, with other readings; orders are null in places, and come last
        order = None if i % 97 == 5 else r[0]
        tied += [(order, *r[1:4], r[4] + 31 * j % 50, r[5] * (1 + j % 3), *r[6:]) for j in (range(3) if i % 40 in (7, 8) else (0,))]
    closed = registry.ORACLES[name].replace("ORDER BY d, o, n)", "ORDER BY d, o, n, v)")
    assert closed.count("ORDER BY d, o, n, v)") == 3
    there, want = both(spark, tmp_path / "there", tied, name, closed)
    back, _ = both(spark, tmp_path / "back", tied[::-1], name, closed)
    assert len(want[1]) > 30 and there == want and back == want
