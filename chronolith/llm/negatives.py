"""Hard negatives, found by the threshold algorithm.

A task holds its rows in blocks, and a block keeps one list for each dimension, sorted by that component. For an anchor the lists
are read from the end that its component's sign favours, all to the same depth; a row met in any list is scored by its integer
product with the anchor. What has not been met scores at most the threshold, the sum of the anchor's components times the last
values read. Reading ends once the threshold is strictly under the least score that could still enter any of the anchor's
windows: its k-th best, or the window's lower end while there are fewer than k. Equal scores are so never cut off.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.llm.common import stored, table
from chronolith.llm.vectors import finite, matrix, products, scaled

POSITIVES = NEGATIVES = 5
#: A negative scores at least LOW / 100 of its positive, and at most as much.
LOW, SCALE = 80, 256
#: Components of the anchors that go to all tasks at once, or of a block's rows, and rows of either at most; entries of each list that are read first.
COMPONENTS, ROWS, FIRST = 1 << 22, 8192, 128
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class Windows(NamedTuple):
    """What an anchor looks for: scores from low to high, and the k best so far (score, id, row), the best first."""

    low: list[int]
    high: list[int]
    best: list[list[tuple[int, int, int]]]

    def bound(self, k: int) -> int:
        """The least score that may still enter a window."""
        return min(b[-1][0] if len(b) == k else low for low, b in zip(self.low, self.best))

    def take(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> None:
        for low, high, best in zip(self.low, self.high, self.best):
            least = max(low, best[-1][0]) if len(best) == k else low
            at = np.flatnonzero((scores >= least) & (scores <= high))
            if len(at) > k:  # all that tie with the k-th stay
                at = at[scores[at] >= -np.partition(-scores[at], k - 1)[k - 1]]
            if len(at):
                best += zip(scores[at].tolist(), ids[at].tolist(), rows[at].tolist())
                best.sort(key=lambda x: (-x[0], x[1], x[2]))
                del best[k:]


class Lists:
    """A block's rows, with each dimension's rows in the order of their components."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, v: np.ndarray):
        self.rows, self.ids, self.labels, self.v = rows, ids, labels, v
        self.order = np.argsort(v, axis=0, kind="stable").T
        self.depths = [d for d in (FIRST << i for i in range(64)) if d < len(v)][:64] + [len(v)]
        low = [np.take_along_axis(v, self.order[:, d - 1][None], axis=0)[0] for d in self.depths]
        high = [np.take_along_axis(v, self.order[:, len(v) - d][None], axis=0)[0] for d in self.depths]
        self.ends = np.array(low), np.array(high)

    def thresholds(self, anchors: np.ndarray) -> np.ndarray:
        """For each anchor and depth, the most that an unmet row can score."""
        return products(np.minimum(anchors, 0), self.ends[0]) + products(np.maximum(anchors, 0), self.ends[1])

    def search(self, a: np.ndarray, row: int, thresholds: np.ndarray, windows: Windows, k: int, other_than: int | None) -> None:
        """Reads until no unmet row can enter a window. The anchor's own row, and rows labelled other_than, never do."""
        n, up, down = len(self.v), np.flatnonzero(a > 0), np.flatnonzero(a < 0)
        met, done, before = np.zeros(n, bool), np.zeros(n, bool), 0
        for depth, threshold in zip(self.depths, thresholds.tolist()):
            if depth == n:
                met[:] = True
            else:
                met[self.order[up, n - depth : n - before]] = True
                met[self.order[down, before:depth]] = True
            fresh = np.flatnonzero(met & ~done & (self.rows != row) & (True if other_than is None else self.labels != other_than))
            if len(fresh):
                windows.take(products(self.v[fresh], a[None])[:, 0], self.ids[fresh], self.rows[fresh], k)
            if threshold < windows.bound(k):
                return
            done |= met
            before = depth


class Anchors(NamedTuple):
    """A bounded set of anchors, sent to all tasks: their rows, labels, vectors, and windows (scores from low to high) with the
    positives these stand for, none while the positives themselves are looked for."""

    rows: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    windows: list[list[tuple[int, int, int, int]]] | None


def at_once(width: int) -> int:
    """Anchors of a set, and rows of a block (less than twice as many)."""
    return max(1, min(ROWS, COMPONENTS // max(1, width)))


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    held, n = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, at_once(width)):
            held.append(batch.slice(start, at_once(width)))
            n += held[-1].num_rows
            if n >= at_once(width):
                yield _columns(pa.Table.from_batches(held), width)
                held, n = [], 0
    if n:
        yield _columns(pa.Table.from_batches(held), width)


def _columns(rows: pa.Table, width: int) -> tuple[np.ndarray, ...]:
    row, vec_id, label, v = (rows.column(c).combine_chunks() for c in ("row", "vec_id", "label", "v"))
    return row.to_numpy(), vec_id.to_numpy(), label.to_numpy(), matrix(v, width)


def _mined(anchors: Callable[[], Anchors], width: int, k: int):
    """For each anchor and window, the k best of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = anchors()
        mine = known.windows is None
        windows = [Windows([LEAST], [MOST], [[]]) if mine else Windows([w[2] for w in ws], [w[3] for w in ws], [[] for _ in ws]) for ws in (known.windows or [[]] * len(known.rows))]
        for rows, ids, labels, v in _blocks(batches, width):
            # positives are looked for among the rows of the anchor's label, whose lists they have to themselves
            for label in np.unique(labels) if mine else [None]:
                own = np.flatnonzero(labels == label) if mine else np.arange(len(rows))
                asked = np.flatnonzero(known.labels == label) if mine else np.arange(len(known.rows))
                if not len(asked):
                    continue
                lists = Lists(rows[own], ids[own], labels[own], v[own])
                thresholds = lists.thresholds(known.v[asked])
                for i, t in zip(asked.tolist(), thresholds):
                    if windows[i].best:
                        lists.search(known.v[i], int(known.rows[i]), t, windows[i], k, None if mine else int(known.labels[i]))
        out = [(int(known.rows[i]), w, *x) for i, ws in enumerate(windows) for w, best in enumerate(ws.best) for x in best]
        columns = zip(*out) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor", "window", "score", "vec_id", "row"])

    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and window, with their place; tasks drop the others before the shuffle."""
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def prepared(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """row (its own number, negative where vec_id is null), vec_id, label, v of the rows that take part, dealt evenly and written."""
    known = rows.where(F.col("label").isNotNull() & finite(F.col("vector")))
    whole = known.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), scaled(F.col("vector"), scale).alias("v"))
    number = F.monotonically_increasing_id()
    row = F.when(F.col("vec_id").isNull(), -1 - number).otherwise(number)
    dealt = stored(whole.select(row.alias("row"), F.coalesce("vec_id", F.lit(MOST)).alias("vec_id"), "label", "v"), "negatives-numbered")
    # as many parts as cores to search in; a few rows hold much work
    spark = dealt.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return stored(dealt.repartition(parts, F.xxhash64("row")), "negatives-rows")


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, from rows (vec_id, label, vector).

    Anchors are the rows for which is_anchor (of vec_id and label) is true. A row's score is its integer product with the anchor, components floor(scale * x);
    higher scores come first, ties by smaller vec_id, a null one last. An anchor's positives are its first other rows of the same label; for
    each, its negatives are the first rows of other labels with low / 100 of the positive's score at least and the positive's at most.

    Rows with a null label or vector, or with a null or non-finite component, take no part. Shorter vectors are filled up with zeros, so an empty
    one scores 0. Rows that repeat are rows of their own, an anchor that repeats has its results for each. Components end at
    vectors.LARGEST. Other columns are ignored; an empty table, and anchors with no positive or no negative, give no rows.

    Anchors go to the tasks in sets of a bounded size, each set against all rows; a task sends the k best of its rows for each anchor.
    """
    held = prepared(rows, scale)
    spark = held.sparkSession
    width = held.agg(F.max(F.size("v"))).first()[0] or 0
    vec_id = F.when(F.col("row") >= 0, F.col("vec_id"))
    asking = stored(held.withColumn("vec_id", vec_id).where(is_anchor), "negatives-anchors")
    n = asking.count()
    sets = math.ceil(n / at_once(width))
    out = None
    for i in range(sets):
        own = asking.where(F.pmod(F.xxhash64("row", F.lit(3)), F.lit(sets)) == i).toArrow()
        a = Anchors(own.column("row").to_numpy(), own.column("label").to_numpy(), matrix(own.column("v").combine_chunks(), width), None)
        if not len(a.rows):
            continue
        sent = spark.sparkContext.broadcast(a)
        schema = "anchor long, window long, score long, vec_id long, row long"
        first = stored(_first(held.mapInArrow(_mined(lambda s=sent: s.value, width, positives), schema), positives), "negatives-positives")
        windows: dict[int, list] = {int(r): [] for r in a.rows}
        for r in first.orderBy("anchor", "rank").collect():  # at most `positives` for each anchor of the set
            windows[r.anchor].append((r["rank"], r.row, -(-low * r.score // 100), r.score))
        again = spark.sparkContext.broadcast(a._replace(windows=[windows[int(r)] for r in a.rows]))
        second = stored(_first(held.mapInArrow(_mined(lambda s=again: s.value, width, negatives), schema), negatives), "negatives-found")
        sent.destroy()
        again.destroy()
        said = first.select("anchor", (F.col("rank") - 1).cast("long").alias("window"), F.when(F.col("row") >= 0, F.col("vec_id")).alias("positive_id"), F.col("score").alias("positive_score"))
        negative = second.select("anchor", "window", "rank", F.when(F.col("row") >= 0, F.col("vec_id")).alias("negative_id"), F.col("score").alias("negative_score"))
        named = asking.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
        done = negative.join(said, ["anchor", "window"]).join(named, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        out = done if out is None else out.unionByName(done)
    return out if out is not None else spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def query(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), F.col("embedding").alias("vector"))
    return mine(rows, F.col("vec_id") % 100 == 0)


SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other_id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 80 * positive_score AND 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 5
"""
