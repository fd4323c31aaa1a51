"""The profile pass: hand-worked units, reuse, and a second pass that scans only what has changed."""

import pytest
from pyspark.sql import functions as F

from chronolith.operators import profiles as P

CHANNELS = (("up", 0.0, 100.0, False), ("down", 0.0, 100.0, False), ("valve", 0.0, 1.0, True), ("gone", 0.0, 1.0, False))


@pytest.fixture(scope="module")
def samples(spark):
    """Recordings 1 and 2 overlap in one bar, 3 is alone; of 1 the last four samples have no label. down breaks the order at times 3 and 4."""
    rows = []
    for series, start, n in ((1, 0, 10), (2, 6, 10), (3, 100, 12)):
        for i in range(start, start + n):
            up = None if series == 1 and i == 9 else float(i * i % 50)
            rows.append((series, 1, i * 1_000_000, i, None if series == 1 and i > 5 else 0, up, 60.0 if i in (3, 4) else 1.0 if i % 2 else 0.5, float(i % 2) if i != 5 else None, 1 if i < 8 else 0))
    rows[-1] = (*rows[-1][:5], 1e12, *rows[-1][6:])
    return spark.createDataFrame(rows, "series long, entity long, us long, rid long, label int, up double, down double, valve double, state int")


def listing(spark, stamps=("a", "b", "c")):
    return spark.createDataFrame([(1, 1, 0, 0, stamps[0], False), (2, 1, 0, 6_000_000, stamps[1], True), (3, 1, 1, 100_000_000, stamps[2], True)], "series long, entity long, bar long, start long, stamp string, whole boolean")


def conflicts(rows):
    return P.out_of_order(rows, ["up", "down"], 2.0, 0.0, 100.0), P.against_state(rows.withColumn("open", F.col("valve") > 0.5), [(1, "all", True, ["open"])], {"open": "valve"})


def run(samples, recordings, cached=None):
    seen = []

    def scan(series):
        seen.append(sorted(r.series for r in series.collect()))
        return samples.join(series, "series", "left_semi")

    out = P.profile_pass(recordings, scan, CHANNELS, ("state",), conflicts, cached)
    return out, seen[0]


def key(df):
    return sorted((tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect()))


def test_pass_and_refresh(spark, samples, tmp_path):
    first, scanned = run(samples, listing(spark))
    assert scanned == [1, 2, 3]
    first.write.parquet(str(tmp_path / "kept"))
    kept = spark.read.parquet(str(tmp_path / "kept"))
    got = {(r.unit, r.channel): r for r in kept.collect()}
    assert len(got) == kept.count() == (3 + 3 + 2) * 4
    bar = got["bar:1-0", "up"]
    assert (bar.n_total, bar.n_valid, bar.n_implausible) == (16, 16, 0)  # what 1 lacks at 9, 2 has
    assert got["instance:1", "up"].n_valid == 9 and got["labelled:1", "up"].n_total == 6
    assert got["instance:3", "up"].n_implausible == 1 and got["instance:3", "up"].n_valid == 11
    one = got["instance:1", "down"]
    # up is 0 1 4 9 16 25 36 49 14: below down less two at 3 and 4 only
    assert (one.n_out_of_order, one.order_partners, got["instance:1", "up"].n_out_of_order) == (2, "up", 2)
    assert (got["instance:3", "up"].n_out_of_order, got["instance:3", "up"].order_partners) == (0, "")
    valve = got["instance:1", "valve"]
    assert (valve.n_against_state, valve.state_conflicts) == (4, "1")  # closed at 0 2 4 6, told nothing at 5
    assert (valve.n_genuine, valve.n_held, valve.spacing_s) == (valve.n_valid, 0, None) and valve.g_mean == valve.mean
    gone = got["instance:1", "gone"]
    assert (gone.n_total, gone.n_valid, gone.mean) == (10, 0, None)
    for unit in ("labelled:3", "bar:1-1"):
        assert got[unit, "up"].mean == got["instance:3", "up"].mean and got[unit, "up"].scope == unit.split(":")[0]

    again, scanned = run(samples, listing(spark), kept)
    assert scanned == [] and key(again) == key(kept)
    changed = samples.withColumn("up", F.when((F.col("series") == 3) & (F.col("us") == 100_000_000), 7.5).otherwise(F.col("up")))
    third, scanned = run(changed, listing(spark, ("a", "b", "new")), kept)
    assert scanned == [3] and key(third) == key(run(changed, listing(spark, ("a", "b", "new")))[0])
    fourth, scanned = run(samples, listing(spark).where("series <> 2"), kept)  # a vanished file: its bar has one member now
    assert scanned == [] and key(fourth) == key(run(samples, listing(spark).where("series <> 2"))[0])


def test_empty(spark, samples):
    assert P.profile_pass(listing(spark).limit(0), lambda s: samples.join(s, "series", "left_semi"), CHANNELS, described=False).count() == 0


def test_two_pairs_count_a_sample_once(spark):
    wide = spark.createDataFrame([(1, i, 5.0 + i, 20.0 + i, 40.0 if i else 1.0, 1.0 if i != 2 else 0.0) for i in range(4)], "unit int, us int, a double, b double, c double, gate double")
    got = {r.channel: (r.n_out_of_order, r.order_partners) for r in P.out_of_order(wide, ["a", "b", "c"], 2.0, 0.0, 100.0).collect()}
    assert got == {"a": (4, "b"), "b": (4, "a,c"), "c": (3, "b")}
    gated = {r.channel: r.n_out_of_order for r in P.out_of_order(wide, ["a", "b", "c"], 2.0, 0.0, 100.0, gates={"c": ["gate"]}).collect()}
    assert gated == {"a": 4, "b": 4, "c": 2}
