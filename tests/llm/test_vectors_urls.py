"""URL filters, hard negatives and vector codes against brute force."""

import fnmatch
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm import codes, negatives, queries, urls, vectors

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, label int, vector array<float>"
NAN, INF = math.nan, math.inf


@pytest.mark.parametrize("name", ["op11_url_filter", "op12_hard_negatives", "op13_vector_codes"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str) != []


# URL filters
def judge(url, rules=urls.RULES, blocked=urls.BLOCKED):
    """host, path, rule, verdict, one rule after another."""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    tails = [host, *(host[i + 1 :] for i, c in enumerate(host) if c == ".")]
    glob = lambda text, g: fnmatch.fnmatchcase(text, g.replace("[", "[[]"))
    fits = [r for r in rules if any(glob(t, r.host) for t in tails) and glob(path, r.path + "*")]
    best = max(fits, key=lambda r: len(r.name), default=None)
    if best:
        return host, path, best.name, best.verdict
    return host, path, None, "block" if any(glob(t, b) for t in tails for b in blocked) else "allow"


ODD_URLS = [None, "", "no scheme", "://", "http://", "HTTP://A.NET/x", "http://net/", "http://net", "http://a.net?q", "x://a.bnet/", "http://example.net/en", "http://example.net/en/", "http://m.example.net/en/1#t", "http://Example.COM/de/?x=http://b.net/", "http://org/fr/", "http://a://b.net/", "http://spam.org/fr/1", "http://é.casino-ü.org/x", "http://a.pills", "http://a.example.org/pills", "http://x\0y.net/", "http://adult-x.y", "http://xadult-.y", "a\nb://c\nd.net/e\nf?g", "http://user@Host.net:80/", "http://😀.net/en/", "http://.net/", "http://a..net/"]


def test_odd_urls(spark):
    data = [(i, u) for i, u in enumerate([*ODD_URLS, ODD_URLS[6], "http://" + "a." * 60_000 + "net/", "http://spam.com/" + "x" * 300_000])]
    df = spark.createDataFrame([*data, (None, "http://a.net/")], "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "rule", "verdict", "said")}).withColumn("more", F.create_map(F.lit("a"), F.lit(1)))
    got = {r.page_id: tuple(r)[1:] for r in urls.judged(df).collect()}
    assert got == {i: judge(u) for i, u in [*data, (None, "http://a.net/")]}
    kept = urls.allowed(df)
    assert kept.columns == df.columns and {r.page_id for r in kept.collect()} == {i for i, v in got.items() if v[3] == "allow"}
    assert urls.judged(df.limit(0)).count() == urls.allowed(df.limit(0)).count() == 0


def test_globs_by_brute_force(spark):
    rng = random.Random(5)
    text = lambda most, letters: "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))
    rules = tuple({r.name: r for r in (urls.Rule(text(7, "ab.*?"), "/" + text(5, "ab/*?"), rng.choice(("block", "allow"))) for _ in range(60))}.values())
    rules = tuple({len(r.name) * 1000 + i: r for i, r in enumerate(rules)}.values())
    assert len(urls.Automaton([(r.host, r.path) for r in rules]).step[0]) > 4
    data = [(i, f"http://{text(9, 'aAb.')}/{text(9, 'ab/c')}") for i in range(700)]
    got = {r.page_id: tuple(r)[1:] for r in urls.judged(spark.createDataFrame(data, "page_id long, url string"), rules, ("b*a",)).collect()}
    assert got == {i: judge(u, rules, ("b*a",)) for i, u in data}
    assert len({g[2] for g in got.values()}) > 15 and {g[3] for g in got.values() if g[2] is None} == {"allow", "block"}


def test_batches_of_urls_change_nothing(spark, monkeypatch):
    automaton = urls.Automaton([(r.host, r.path) for r in urls.RULES])
    hosts, paths = zip(*(judge(u)[:2] for u in ODD_URLS))
    one = np.concatenate([automaton.fits([h], [p]) for h, p in zip(hosts, paths)])
    assert (automaton.fits(list(hosts), list(paths)) == one).all() and one.any(axis=0).all()


# hard negatives
def mined(data, anchors, k=5, low=80):
    rows = [(i, v, label, [math.floor(256 * float(np.float32(x))) for x in v_]) for i, (v, label, v_) in enumerate(data) if label is not None and v_ is not None and all(x is not None and math.isfinite(x) for x in v_)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    late = lambda v: math.inf if v is None else v
    out = []
    for i, vec_id, label, v in rows:
        if vec_id is None or not anchors(vec_id):
            continue
        scored = sorted(((-dot(v, w), late(j), n) for n, j, _, w in rows if n != i))
        labels, ids = {n: l for n, _, l, _ in rows}, {n: j for n, j, _, _ in rows}
        for s, _, n in [x for x in scored if labels[x[2]] == label][:k]:
            fit = [x for x in scored if labels[x[2]] != label and low * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(vec_id, ids[n], r, ids[m], -s, -t) for r, (t, _, m) in enumerate(fit, 1)]
    return sorted(out, key=str)


def test_negatives_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 0.3, (4, 12))
    data = [(i, int(rng.integers(3)), (np.round((centres[rng.integers(4)] + rng.normal(0, 0.1, 12)) * 16) / 16).tolist()) for i in range(900)]
    data += [(-14, 1, data[0][2]), (None, 2, data[3][2]), (7, 0, data[7][2]), (20, None, data[0][2]), (901, 1, None), (903, 1, [0.1, None] * 6), (904, 1, [NAN] * 12), (905, 2, [INF] * 12), (20, 2, data[3][2]), (906, 1, []), (907, 1, [0.5] * 5), (40, 9, [0.25] * 12), (60, 8, [0.0] * 12)]
    df = spark.createDataFrame(data, VECTORS).repartition(5).withColumns({c: F.lit("x") for c in ("row", "v", "anchor", "window", "score", "rank")})
    want = mined(data, lambda i: i % 20 == 0)
    assert len(want) > 300
    for rows, first in ((8192, 128), (13, 2)):
        monkeypatch.setattr(negatives, "ROWS", rows)
        monkeypatch.setattr(negatives, "FIRST", first)
        got = negatives.mine(df, F.col("vec_id") % 20 == 0)
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert negatives.mine(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert negatives.mine(df.where("label = 9"), F.col("vec_id") % 20 == 0).count() == 0


def test_reading_ends_early():
    """Rows that cannot enter a window any more are not scored."""
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.integers(-50, 50, (4000, 6)), np.full((9, 6), 200)])
    lists = negatives.Lists(np.arange(4009), np.arange(4009), np.zeros(4009), v)
    seen = []
    windows = negatives.Windows([negatives.LEAST], [negatives.MOST], [[]])
    windows_take = negatives.Windows.take

    class Counted(negatives.Windows):
        def take(self, scores, *rest):
            seen.extend(scores.tolist())
            windows_take(self, scores, *rest)

    windows = Counted(*windows)
    a = np.array([3, 1, 2, 5, 1, 1])
    lists.search(a, -1, lists.thresholds(a[None])[0], windows, 5, None)
    assert [x[1] for x in windows.best[0]] == [4000, 4001, 4002, 4003, 4004] and len(seen) < 900


# vector codes
def coded(data, entries=256, rounds=4):
    kept = [(v, label, [math.floor(1024 * float(np.float32(x))) for x in v_]) for v, label, v_ in data if v_ is not None and all(x is not None and math.isfinite(x) for x in v_)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = -(-max(len(r[2]) for r in kept) // 4)
    parts = [[(r[2] + [0] * 4 * width)[p * width : (p + 1) * width] for p in range(4)] for r in kept]
    books = [[x[p] for x in parts[:entries]] for p in range(4)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(4):
            home = [near(x[p], books[p])[1] for x in parts]
            for e in range(len(books[p])):
                own = [x[p] for x, h in zip(parts, home) if h == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    found = [[near(x[p], books[p]) for p in range(4)] for x in parts]
    errors = [sum(d for d, _ in f) for f in found]
    sha = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{e:02x}" for _, e in f), err, sum(x for x, s in zip(errors, kept) if s[1] == r[1]), sha) for r, f, err in zip(kept, found, errors)), key=str)


def test_codes_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    data = [(i, None if i % 9 == 0 else int(rng.integers(4)), (np.round(rng.normal(0, 0.2, 12) * 32) / 32).tolist()) for i in range(400)]
    data += [(-3, 1, data[0][2]), (None, None, data[1][2]), (5, 2, data[9][2]), (700, 1, None), (701, 1, [0.1, None] * 6), (702, 1, [NAN] * 12), (703, 2, [INF] * 12), (704, 2, [0.5] * 10), (705, 2, []), (-9, 3, data[0][2]), (6, 3, [-x for x in data[6][2]])]
    df = spark.createDataFrame(data, VECTORS).repartition(5).withColumns({c: F.lit("x") for c in ("v", "code", "error", "_label", "part", "entry", "n", "total")})
    got = lambda d: sorted(map(tuple, codes.compress(d).collect()), key=str)
    assert got(df) == coded(data)
    few = [d for d in data if (d[0] or 0) < 60]
    assert got(df.where("vec_id < 60 or vec_id is null")) == coded(few)
    monkeypatch.setattr(codes, "BROADCAST_MOST", 0)
    assert got(df.where("vec_id < 60 or vec_id is null")) == coded(few)
    assert codes.compress(df.limit(0)).count() == codes.compress(df.where("vec_id = 700")).count() == 0
    hollow = df.where("vec_id = 705")
    assert [tuple(r)[:4] for r in codes.compress(hollow.unionAll(hollow)).collect()] == [(705, "00000000", 0, 0)] * 2


def test_trees_find_the_nearest_and_leave_out_subtrees():
    rng = np.random.default_rng(9)
    for points in (rng.integers(-40, 40, (256, 3)), rng.integers(-2, 3, (256, 2)), np.zeros((200, 4), np.int64), rng.integers(-(1 << 26), 1 << 26, (256, 4)), np.repeat(rng.integers(-9, 9, (16, 2)) * 100, 16, axis=0) + rng.integers(-3, 4, (256, 2))):
        asked = np.concatenate([points, rng.integers(points.min() - 1, points.max() + 2, (500, points.shape[1]))])
        d = np.array([[sum((int(x) - int(y)) ** 2 for x, y in zip(a, b)) for b in points] for a in asked], dtype=object)
        entry, best, computed = codes.nearest(codes.Gnat(points, np.arange(len(points))), asked)
        assert (best == d.min(axis=1)).all() and (entry == [row.tolist().index(min(row)) for row in d]).all()
    assert computed < 0.5 * d.size


def test_components_end_at_a_bound(spark):
    df = spark.createDataFrame([([1e300, -1e300, 0.5, -0.5],), ([NAN],), (None,), ([],)], "v array<double>")
    got = df.select(vectors.finite(F.col("v")).alias("ok"), vectors.scaled(F.col("v"), 3).alias("x")).collect()
    assert [r.ok for r in got] == [True, False, False, True] and got[0].x == [vectors.LARGEST, -vectors.LARGEST, 1, -2]
