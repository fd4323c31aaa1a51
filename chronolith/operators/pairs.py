"""Work on all pairs of two tables of points, dealt over tasks as a grid.

Either side is cut into blocks of at most BLOCK points, and one group compares one block with one of the other side: a group's memory is two
blocks and one tile of distances, whatever the number of points, and a point is sent once for each block of the other side.

Squared distances come from a matrix product of the centred points; where they are small beside the points' squared lengths, so that digits
would be lost, and where they are not finite, they are taken again from the differences. Missing points (null, or with a null component) have no distance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.sources.shared import stored

#: Points of a block at most; blocks of a side while there are LEAST points for each of them; points of either side of a tile.
BLOCK, WAYS, LEAST = 32_768, 8, 1024
TALL, WIDE = 256, 1024
#: Share of the squared lengths below which a squared distance is taken from the differences; widening of bounds, far over what rounding can do.
NEAR, SLACK = 1e-3, 1e-9


def whole(x: Column) -> Column:
    """x, or null if it has a null component."""
    return F.when(~F.exists(x, lambda v: v.isNull()), x)


def differences(q: np.ndarray, p: np.ndarray, who: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Squared distances of the rows `who` of q from the rows `other` of p, one by one, by differences."""
    out = np.empty(len(who))
    for i in range(0, len(who), 1 << 14):
        part = slice(i, i + (1 << 14))
        out[part] = ((q[who[part]] - p[other[part]]) ** 2).sum(axis=1)
    return out


def tiles(q: np.ndarray, p: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """The squared distances of the rows of q and those of p, tile by tile."""
    with np.errstate(all="ignore"):
        middle = p.mean(axis=0)
        middle = np.where(np.isfinite(middle), middle, 0.0)
        a, b = q - middle, p - middle
        a_size, b_size = (a * a).sum(axis=1), (b * b).sum(axis=1)
        for j in range(0, len(b), WIDE):
            to = slice(j, min(j + WIDE, len(b)))
            turned = np.ascontiguousarray(b[to].T)
            for i in range(0, len(a), TALL):
                of = slice(i, min(i + TALL, len(a)))
                size = a_size[of, None] + b_size[to]
                d = a[of] @ turned
                d *= -2.0
                d += size
                size *= NEAR
                who, other = np.nonzero(~(d > size))
                if len(who):
                    d[who, other] = differences(q, p, i + who, j + other)
                yield of, to, d


def grid(asked: DataFrame, held: DataFrame, order: str | None = None) -> DataFrame:
    """Both tables (key, x and others; compared within a key) for groups by key, _q, _p: each row once for each block of the other side, with
    _asked. Held points of a key are dealt to blocks in order of the column `order`, so that a block has few of its values."""
    count = lambda df, name: df.groupBy("key").agg(F.count(F.lit(1)).alias(name))
    blocks = lambda n: F.greatest(F.ceil(F.col(n) / BLOCK), F.least(F.lit(WAYS), F.ceil(F.col(n) / LEAST))).cast("long")
    sizes = stored(count(asked, "_n").join(count(held, "_m"), "key").select("key", "_m", blocks("_n").alias("_qs"), blocks("_m").alias("_ps")), "blocks")
    mixed = lambda df: F.xxhash64(*df.columns)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    q = asked.join(sizes, "key").withColumn("_q", F.pmod(mixed(asked), F.col("_qs"))).withColumn("_p", every("_ps"))
    if order is None:
        p = held.join(sizes, "key").withColumn("_p", F.pmod(mixed(held), F.col("_ps")))
    else:
        own = held.groupBy("key", order).agg(F.count(F.lit(1)).alias("_g"))
        before = F.sum("_g").over(Window.partitionBy("key").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
        own = stored(own.withColumn("_s", F.coalesce(before, F.lit(0))), "starts")
        place = F.col("_s") + F.pmod(mixed(held), F.col("_g"))
        p = held.join(own, ["key", order]).join(sizes, "key").withColumn("_p", F.floor(place * F.col("_ps") / F.col("_m")).cast("long"))
    p = p.withColumn("_q", every("_qs"))
    drop = ("_n", "_m", "_qs", "_ps", "_g", "_s")
    return q.drop(*drop).withColumn("_asked", F.lit(True)).unionByName(p.drop(*drop).withColumn("_asked", F.lit(False)), allowMissingColumns=True)


def matrix(x: pa.Array) -> np.ndarray:
    """The points as rows; a missing one is not a number in all components."""
    known = np.asarray(x.is_valid())
    flat = np.asarray(x.flatten(), dtype=np.float64)
    if not known.any():
        return np.full((len(x), 0), np.nan)
    out = np.full((len(x), len(flat) // known.sum()), np.nan)
    out[known] = flat.reshape(int(known.sum()), -1)
    return out


def sides(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, pa.Table]:
    table = pa.Table.from_batches(list(batches)).combine_chunks()
    asked = table.column("_asked")
    return table.filter(asked), table.filter(pc.invert(asked))


def column(table: pa.Table, name: str) -> pa.Array:
    return table.column(name).combine_chunks() if table.column(name).num_chunks != 1 else table.column(name).chunk(0)


def sums(asked: DataFrame, held: DataFrame, kernel: Callable[[np.ndarray], np.ndarray] = np.sqrt) -> DataFrame:
    """spot, grp, s: for each asked point (key, spot, x) and each grp of the held ones of its key (key, grp, x, n), the sum of n times the kernel of
    the squared distance. No null is among them."""
    kind = dict(held.dtypes)["grp"]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(batches)
        if not (len(a) and len(b)):
            return
        b = b.sort_by("grp")
        grp, n = column(b, "grp"), np.asarray(column(b, "n"), dtype=np.float64)
        code = np.asarray(pc.rank(grp, sort_keys="ascending", tiebreaker="dense"), dtype=np.int64) - 1
        first = np.flatnonzero(np.diff(code, prepend=-1))
        out = np.zeros((len(a), len(first)))
        for of, to, d in tiles(matrix(column(a, "x")), matrix(column(b, "x"))):
            met = code[to]
            d = kernel(d)
            d *= n[to]
            out[of, met[0] : met[-1] + 1] += np.add.reduceat(d, np.flatnonzero(np.diff(met, prepend=-1)), axis=1)
        spot, names = column(a, "spot"), grp.take(pa.array(first))
        for k in range(len(first)):
            yield pa.RecordBatch.from_arrays([spot, pa.repeat(names[k], len(spot)), pa.array(out[:, k])], names=["spot", "grp", "s"])

    both = grid(asked.select("key", "spot", "x"), held.select("key", "grp", "x", "n"), "grp")
    parts = both.groupBy("key", "_q", "_p").applyInArrow(summed, f"spot long, grp {kind}, s double")
    return parts.groupBy("spot", "grp").agg(F.sum("s").alias("s"))


def spots(points: DataFrame, *by: str) -> DataFrame:
    """spot, by, x, n: equal points (of equal `by`) once, with their number; missing points are left out. Written, so that a spot keeps its number."""
    rows = points.select(*by, whole(F.col("x")).alias("x")).where("x is not null").groupBy(*by, "x").agg(F.count(F.lit(1)).alias("n"))
    return stored(rows.withColumn("spot", F.monotonically_increasing_id()), "spots")


def codes(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for the values of a and b, equal where the values are; -1 for null."""
    both = pa.chunked_array([a, b]).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
    return both[: len(a)], both[len(a) :]


def met(asked: DataFrame, held: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """a, b, d and a_, b_ of the columns `also`: every pair of an asked and a held point (id, x, also) of different ids; d is null where one is missing.
    A group gives its pairs out tile by tile."""
    kinds = dict(held.dtypes)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, p = sides(batches)
        if not (len(q) and len(p)):
            return
        x, y = matrix(column(q, "x")), matrix(column(p, "x"))
        x_known, y_known = np.asarray(column(q, "x").is_valid()), np.asarray(column(p, "x").is_valid())
        dims = max(x.shape[1], y.shape[1])
        x, y = (m if m.shape[1] == dims else np.full((len(m), dims), np.nan) for m in (x, y))
        q_id, p_id = codes(column(q, "id"), column(p, "id"))
        for of, to, d in tiles(x, y):
            who, other = np.nonzero((q_id[of, None] != p_id[to]) & (q_id[of, None] >= 0) & (p_id[to] >= 0))
            d = np.sqrt(d[who, other])
            who, other = who + of.start, other + to.start
            none = ~(x_known[who] & y_known[other])
            columns = [column(q, "id").take(pa.array(who)), column(p, "id").take(pa.array(other)), pa.array(d, mask=none)]
            for c in also:
                columns += [column(q, c).take(pa.array(who)), column(p, c).take(pa.array(other))]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "d", *[f"{s}_{c}" for c in also for s in "ab"]])

    key = F.lit(0).alias("key")
    ready = lambda df: df.select(key, "id", whole(F.col("x")).alias("x"), *also)
    schema = ", ".join([f"a {kinds['id']}, b {kinds['id']}, d double", *[f"{s}_{c} {kinds[c]}" for c in also for s in "ab"]])
    return grid(ready(asked), ready(held)).groupBy("key", "_q", "_p").applyInArrow(found, schema)


def least(asked: DataFrame, held: DataFrame, k: int, apart: str | None = None) -> DataFrame:
    """a, b, d, rank: the k nearest held points (id, x) of every asked one, of other ids, ties by id; with `apart`, of other values in that column. Missing
    points take no part. A group gives out k points for each asked one: those not beyond the k-th by the quick distances, ranked by differences."""
    kind = dict(held.dtypes)["id"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, p = sides(batches)
        if not (len(q) and len(p)):
            return
        x, y = matrix(column(q, "x")), matrix(column(p, "x"))
        marks = [codes(column(q, c), column(p, c)) for c in ("id", *([apart] if apart else []))]
        bound = np.full((len(x), k), np.inf)
        hits = []
        for of, to, d in tiles(x, y):
            fits = np.ones(d.shape, bool)
            for m, n in marks:
                # as in SQL, nothing differs from null
                fits &= (m[of, None] != n[to]) & (m[of, None] >= 0) & (n[to] >= 0)
            inf = np.where(fits & ~np.isnan(d), d, np.inf)
            bound[of] = np.partition(np.concatenate([bound[of], np.partition(inf, k - 1, axis=1)[:, :k] if inf.shape[1] > k else inf], axis=1), k - 1, axis=1)[:, :k]
            who, other = np.nonzero(fits & ~(d > bound[of, k - 1 :] * (1 + SLACK)))
            hits.append((who + of.start, other + to.start))
        a, b = (np.concatenate(c) for c in zip(*hits))
        d = np.sqrt(differences(x, y, a, b))
        place = np.lexsort((np.asarray(pc.rank(column(p, "id")))[b], d, a))
        a, b, d = a[place], b[place], d[place]
        start = np.flatnonzero(np.diff(a, prepend=-1))
        first = np.arange(len(a)) - np.repeat(start, np.diff(start, append=len(a))) < k
        a, b, d = a[first], b[first], d[first]
        yield pa.RecordBatch.from_arrays([column(q, "id").take(pa.array(a)), column(p, "id").take(pa.array(b)), pa.array(d)], names=["a", "b", "d"])

    also = [apart] if apart else []
    ready = lambda df: df.select(F.lit(0).alias("key"), "id", whole(F.col("x")).alias("x"), *also).where("x is not null")
    parts = grid(ready(asked), ready(held)).groupBy("key", "_q", "_p").applyInArrow(found, f"a {kind}, b {kind}, d double")
    return parts.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).where(F.col("rank") <= k)
