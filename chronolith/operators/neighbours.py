"""Neighbours of points without all pairs: pivots cut the space into cells, cells into rings, and the triangle inequality says which rings
can hold a neighbour.

A point belongs to the cell of its nearest pivot, and in it to a ring by its distance from the pivot. Within b of a point x, cell c can
hold only points whose distances from its pivot p are between d(x, p) - b and d(x, p) + b, and none at all if d(x, p) is more than 2 b
over the distance of x from its own pivot. A point is sent to those rings only, and compared there. All comparisons are exact; nothing
is left out. In spaces of many dimensions distances are alike, and most rings are met: rings are therefore held together in blocks, and a
query is sent once to a block, with the numbers of the rings that it meets there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.operators.pairs import column, differences, matrix, sides, tiles
from chronolith.sources.shared import stored

#: Pivots at most; points of a ring on average, and points sent to a block that are compared in one task, at most about; distances held at once.
PIVOTS, RING, SENT, AT_ONCE = 1024, 1024, 16_384, 1 << 21
#: Points of a block of rings at least and at most, about, and blocks wanted.
BLOCK, BLOCKS = (1024, 16_384), 16
#: Relative widening of bounds on distances, far over what rounding can do.
SLACK = 1e-9


class Space(NamedTuple):
    """The pivots, and of each one's cell the least and greatest distance from it and the number of rings. Rings are numbered along the cells;
    `block` is each ring's block."""

    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rings: np.ndarray
    block: np.ndarray

    def number(self, cell: np.ndarray, ring: np.ndarray) -> np.ndarray:
        return (np.cumsum(self.rings) - self.rings)[cell] + ring

    def ring(self, cell: np.ndarray, d: np.ndarray) -> np.ndarray:
        wide = np.maximum(self.high[cell] - self.low[cell], 1e-300)
        place = np.floor((d - self.low[cell]) / wide * self.rings[cell])
        return np.clip(place, 0, self.rings[cell] - 1).astype(np.int64)


class Cells(NamedTuple):
    """rows: id, x, cell, ring, number (of the ring), block; and the space they lie in."""

    rows: DataFrame
    space: Space


def _matrix(x: pd.Series) -> np.ndarray:
    return np.array(x.to_list(), dtype=np.float64).reshape(len(x), -1)


def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of a and those of b, by differences, so that equal points are at 0."""
    out = np.empty((len(a), len(b)))
    step = max(1, AT_ONCE // max(1, len(b) * a.shape[1]))
    for i in range(0, len(a), step):
        out[i : i + step] = np.sqrt(((a[i : i + step, None] - b[None]) ** 2).sum(axis=2))
    return out


def cells(points: DataFrame, pivots: int = PIVOTS) -> Cells:
    """The points (id, x; equal lengths, no nulls) in cells and rings. Pivots are about the root of the points' number, at most `pivots`, drawn by a hash."""
    rows = stored(points.select("id", F.transform("x", lambda v: v.cast("double")).alias("x")), "points")
    n = rows.count()
    most = max(1, min(pivots, math.isqrt(max(1, n))))
    drawn = rows.orderBy(F.xxhash64("x"), "id").limit(most).select("x").collect()
    at = np.unique(np.array([r.x for r in drawn], dtype=np.float64).reshape(len(drawn), -1), axis=0) if drawn else np.zeros((0, 0))

    def placed(batches):
        for b in batches:
            for i in range(0, len(b), 4096):
                part = b.iloc[i : i + 4096]
                d = between(_matrix(part["x"]), at)
                cell = d.argmin(axis=1)
                yield pd.DataFrame({"id": part["id"], "x": part["x"], "cell": cell, "d": d[np.arange(len(part)), cell]})

    kind = dict(rows.dtypes)["id"]
    own = stored(rows.mapInPandas(placed, f"id {kind}, x array<double>, cell long, d double"), "cells")
    low, high, rings = np.zeros(len(at)), np.zeros(len(at)), np.ones(len(at), np.int64)
    for r in own.groupBy("cell").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count(F.lit(1)).alias("n")).collect():  # one row a pivot
        low[r.cell], high[r.cell], rings[r.cell] = r.low, r.high, -(-r.n // RING)
    space = Space(at, low, high, rings, np.zeros(rings.sum(), np.int64))

    def ringed(batches):
        for b in batches:
            ring = space.ring(b["cell"].to_numpy(), b["d"].to_numpy()) if len(b) else np.zeros(0, np.int64)
            yield b.assign(ring=ring, number=space.number(b["cell"].to_numpy(), ring) if len(b) else ring)

    ringed_ = stored(own.mapInPandas(ringed, f"id {kind}, x array<double>, cell long, d double, ring long, number long"), "rings")
    held = np.zeros(rings.sum(), np.int64)
    for r in ringed_.groupBy("number").agg(F.count(F.lit(1)).alias("n")).collect():  # one row a ring
        held[r.number] = r.n
    size = min(max(n // BLOCKS, BLOCK[0]), BLOCK[1])
    space = space._replace(block=(np.cumsum(held) - held) // size)
    blocks = rows.sparkSession.createDataFrame([(i, int(b)) for i, b in enumerate(space.block)], "number long, block long")
    return Cells(ringed_.join(F.broadcast(blocks), "number"), space)


def targets(queries: DataFrame, known: Cells) -> DataFrame:
    """block, id, x, bound, rings: each query (id, x, bound) once for every block with a ring that can hold a point within its bound, and the
    numbers of those rings."""
    kind, space = dict(queries.dtypes)["id"], known.space

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 1024):
                part = b.slice(i, 1024)
                bound = np.asarray(part.column("bound")) * (1 + SLACK)
                d = between(matrix(part.column("x")), space.pivots)
                near = d.min(axis=1)
                slack = SLACK * (d + space.high)
                fits = (d - bound[:, None] <= space.high + slack) & (d + bound[:, None] >= space.low - slack) & (d - near[:, None] <= 2 * bound[:, None] + slack)
                who, cell = np.nonzero(fits)
                reach, far = bound[who] + slack[who, cell], d[who, cell]
                first, last = space.ring(cell, far - reach), space.ring(cell, np.minimum(far + reach, space.high[cell]))
                times = last - first + 1
                at = np.repeat(np.arange(len(who)), times)
                number = space.number(cell[at], np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times) + first[at])
                query, block = who[at], space.block[number]
                new = np.flatnonzero((np.diff(query, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
                rings = pa.ListArray.from_arrays(pa.array(np.append(new, len(query)), pa.int32()), pa.array(number, pa.int64()))
                own = part.take(pa.array(query[new]))
                yield pa.RecordBatch.from_arrays([pa.array(block[new]), own.column("id"), own.column("x"), own.column("bound"), rings], names=["block", "id", "x", "bound", "rings"])

    return queries.select("id", "x", "bound").mapInArrow(sent, f"block long, id {kind}, x array<double>, bound double, rings array<long>")


def compared(sent: DataFrame, known: Cells) -> int:
    """The pairs that are compared for queries that were sent to rings."""
    n = sent.select(F.explode("rings").alias("number")).groupBy("number").agg(F.count(F.lit(1)).alias("n"))
    n = n.join(known.rows.groupBy("number").agg(F.count(F.lit(1)).alias("m")), "number")
    return int(n.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0)


def within(queries: DataFrame, known: Cells, k: int | None = None) -> DataFrame:
    """a, b, d: for each query (id, x, bound) the other points within its bound; with k, of those the k nearest, ties by id.

    A block that many queries meet is dealt over several tasks."""
    sent = stored(targets(queries, known), "sent")
    parts = sent.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / SENT).cast("long").alias("parts"))
    asked = sent.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).select("block", "part", "id", "x", "bound", "rings")
    held = known.rows.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("block", "part", "id", "x", "number")
    kind = dict(queries.dtypes)["id"]
    both = asked.withColumn("_asked", F.lit(True)).unionByName(held.withColumn("_asked", F.lit(False)), allowMissingColumns=True)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, p = sides(batches)
        if not (len(q) and len(p)):
            return
        p = p.sort_by("number")
        x, y, bound = matrix(column(q, "x")), matrix(column(p, "x")), np.asarray(column(q, "bound"))
        own, ids = column(q, "id"), column(p, "id")
        codes = pa.chunked_array([own, ids]).combine_chunks().dictionary_encode().indices.to_numpy()
        q_code, p_code = codes[: len(own)], codes[len(own) :]
        lists = column(q, "rings")
        wanted, asker = np.asarray(lists.flatten()), np.repeat(np.arange(len(x)), np.asarray(lists.value_lengths()))
        order = np.argsort(wanted, kind="stable")
        wanted, asker = wanted[order], asker[order]
        numbers = np.asarray(column(p, "number"))
        limit = (bound * (1 + SLACK)) ** 2
        found = []
        most = 2 * len(wanted) > len(x) * len(np.unique(numbers))  # most rings are met: the block is met as one
        for ring in np.unique(numbers) if not most else numbers[:1]:
            who = asker[slice(*np.searchsorted(wanted, [ring, ring + 1]))]
            low, high = np.searchsorted(numbers, [ring, ring + 1])
            if most:
                who, low, high = np.arange(len(x)), 0, len(y)
            if not len(who):
                continue
            for of, to, d in tiles(x[who], y[low:high]):
                # what is not a number is not within any bound
                a, b = np.nonzero(d <= limit[who[of], None])
                a, b = who[of][a], b + low + to.start
                other = q_code[a] != p_code[b]
                found.append((a[other], b[other]))
        a, b = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        d = np.sqrt(differences(x, y, a, b))
        fits = d <= bound[a]
        a, b, d = a[fits], b[fits], d[fits]
        if k is not None and len(a):
            place = np.lexsort((np.asarray(pc.rank(ids))[b], d, a))
            a, b, d = a[place], b[place], d[place]
            start = np.flatnonzero(np.diff(a, prepend=-1))
            fits = np.arange(len(a)) - np.repeat(start, np.diff(start, append=len(a))) < k
            a, b, d = a[fits], b[fits], d[fits]
        for i in range(0, len(a), AT_ONCE):
            yield pa.RecordBatch.from_arrays([own.take(pa.array(a[i : i + AT_ONCE])), ids.take(pa.array(b[i : i + AT_ONCE])), pa.array(d[i : i + AT_ONCE])], names=["a", "b", "d"])

    found = both.groupBy("block", "part").applyInArrow(search, f"a {kind}, b {kind}, d double")
    if k is None:
        return found
    return found.withColumn("_k", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).where(F.col("_k") <= k).drop("_k")


def bounded(known: Cells, k: int) -> DataFrame:
    """id, x, bound: every point with a distance within which it has k others, the k-th of its own block; infinite where the block is too small."""
    kind = dict(known.rows.dtypes)["id"]

    def of_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        # a block is met in pieces: any k others give a bound
        for i in range(0, len(rows), 2 * BLOCK[1]):
            part = rows.slice(i, 2 * BLOCK[1])
            x = matrix(column(part, "x"))
            least = np.full((len(x), k + 1), np.inf)
            for of, _, d in tiles(x, x):
                least[of] = np.partition(np.concatenate([least[of], d], axis=1), k, axis=1)[:, : k + 1]
            bound = np.sqrt(least[:, k]) * (1 + SLACK)
            yield pa.RecordBatch.from_arrays([column(part, "id"), column(part, "x"), pa.array(bound)], names=["id", "x", "bound"])

    return known.rows.select("block", "id", "x").groupBy("block").applyInArrow(of_block, f"id {kind}, x array<double>, bound double")


def nearest(known: Cells, k: int, queries: DataFrame | None = None) -> DataFrame:
    """a, b, d: the k nearest other points of every point (or of `queries`, a selection of ids), ties by id."""
    asked = stored(bounded(known, k), "bounded")
    if queries is not None:
        asked = asked.join(queries.select("id"), "id", "left_semi")
    return within(asked, known, k)
