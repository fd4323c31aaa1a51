"""Vector codes: product quantisation whose nearest entries are found in geometric near-neighbour access trees.

A vector is cut into four parts, each with a codebook. A node of a codebook's tree has split points; every other entry belongs to
the nearest of these, its child, and for each split point and child the node keeps the range of the distances between them. A part's
distances to the split points and the nearest entry so far then exclude every child whose range lies strictly outside. Distances are
compared as doubles widened to either side, so nothing is excluded by rounding; what is left is compared by its integer squared
distance, and of equal ones the lower index is taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import stored, table
from chronolith.llm.vectors import finite, matrix, scaled, squares

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Split points of a node; entries up to which a child is compared one by one; rows that are looked up at once.
SPLITS, LEAF, AT_ONCE = 16, 16, 4096
#: Relative widening of a distance, far over what rounding can do.
SLACK = 1e-9
#: Rows of labels' sums up to which they are broadcast; beyond, an ordinary join.
BROADCAST_MOST = 500_000


class Gnat:
    """A node over some entries (places in points) of a codebook."""

    def __init__(self, points: np.ndarray, members: np.ndarray):
        self.points, self.members, self.children = points, members, []
        if len(members) <= LEAF:
            return
        d = squares(points[members], points[members])
        splits, gap = [0], d[0].copy()
        while len(splits) < SPLITS and gap.max() > 0:  # each split point is the entry farthest from those before
            splits.append(int(gap.argmax()))
            gap = np.minimum(gap, d[splits[-1]])
        if len(splits) == 1:  # all entries are equal
            return
        home = d[splits].argmin(axis=0)
        home[splits] = np.arange(len(splits))
        ranges = np.sqrt(d[splits].astype(np.float64))
        self.low = np.array([ranges[:, home == j].min(axis=1) for j in range(len(splits))]).T * (1 - SLACK)
        self.high = np.array([ranges[:, home == j].max(axis=1) for j in range(len(splits))]).T * (1 + SLACK)
        self.splits = members[splits]
        inner = np.ones(len(members), bool)
        inner[splits] = False
        self.children = [Gnat(points, members[inner & (home == j)]) for j in range(len(splits))]

    def search(self, asked: np.ndarray, rows: np.ndarray, best: np.ndarray, entry: np.ndarray) -> int:
        """Brings best (squared distances) and entry of some rows of asked up to date; returns how many distances were computed."""
        here = self.splits if self.children else self.members
        if not len(rows) or not len(here):
            return 0
        d, computed = squares(asked[rows], self.points[here]), len(rows) * len(here)
        order = np.argsort(here)  # the first of the least is then the lowest index
        at = order[d[:, order].argmin(axis=1)]
        least, found = d[np.arange(len(rows)), at], here[at]
        closer = (least < best[rows]) | ((least == best[rows]) & (found < entry[rows]))
        best[rows[closer]], entry[rows[closer]] = least[closer], found[closer]
        far = np.sqrt(d.astype(np.float64))
        for j, child in enumerate(self.children):
            reach = np.sqrt(best[rows].astype(np.float64))[:, None] * (1 + SLACK)
            out = ((far * (1 + SLACK) + reach) * (1 + SLACK) < self.low[:, j]) | (far * (1 - SLACK) > (self.high[:, j] + reach) * (1 + SLACK))
            computed += child.search(asked, rows[~out.any(axis=1)], best, entry)
        return computed


def nearest(tree: Gnat, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of asked the nearest entry (the lowest of equally near ones), its squared distance, and how many distances were computed."""
    best, entry = np.full(len(asked), np.iinfo(np.int64).max), np.full(len(asked), len(tree.points))
    return entry, best, tree.search(asked, np.arange(len(asked)), best, entry)


def trees(books: np.ndarray) -> list[Gnat]:
    return [Gnat(book, np.arange(len(book))) for book in books]


def _encoded(batch: pa.RecordBatch, found: list[Gnat]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """For AT_ONCE rows: the rows, their parts (row, part, component), entries and squared distances (row, part)."""
    width = found[0].points.shape[1]
    for start in range(0, batch.num_rows, AT_ONCE):
        rows = batch.slice(start, AT_ONCE)
        parts = matrix(rows.column("v"), PARTS * width).reshape(len(rows), PARTS, width)
        near = [nearest(tree, parts[:, p]) for p, tree in enumerate(found)]
        yield rows, parts, np.stack([x[0] for x in near], axis=1), np.stack([x[1] for x in near], axis=1)


def _sums(books: np.ndarray):
    """Number and sum of the parts that each entry is nearest to, over a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total, count = trees(books), np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for _, parts, entries, _ in _encoded(batch, found):
                for p in range(PARTS):
                    np.add.at(total[p], entries[:, p], parts[:, p])
                    count[p] += np.bincount(entries[:, p], minlength=books.shape[1])
        p, e = np.nonzero(count)
        columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "total"])

    return run


def _codes(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = trees(books)
        for batch in batches:
            for rows, _, entries, errors in _encoded(batch, found):
                code = [bytes(x).hex() for x in entries.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("label"), pa.array(code), pa.array(errors.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    return run


def prepared(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v of the rows with a whole vector, written."""
    kept = rows.where(finite(F.col("vector")))
    return stored(kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), scaled(F.col("vector"), scale).alias("v")), "codes-rows")


def first_books(held: DataFrame, width: int, entries: int = ENTRIES) -> np.ndarray:
    """The codebooks (part, entry, component) at the start: the parts of the rows with the smallest vec_ids, null ones last."""
    first = held.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").toArrow()
    v = matrix(first.column("v").combine_chunks(), PARTS * width)
    return v.reshape(len(v), PARTS, width).transpose(1, 0, 2)


def moved(held: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: each entry is the mean, rounded down, of the parts it is nearest to; unused ones stay. A task sends
    one row an entry, and the driver gets one."""
    width = books.shape[2]
    sums = held.mapInArrow(_sums(books), "part int, entry int, n long, total array<long>")
    total = F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(width)]) if width else F.array()
    out = books.copy()
    for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), total.alias("total")).collect():
        out[r.part, r.entry] = [x // r.n for x in r.total]
    return out


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def train(held: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks of prepared rows; without rows they have no entries."""
    width = -(-(held.agg(F.max(F.size("v"))).first()[0] or 0) // PARTS)
    books = first_books(held, width, entries)
    for _ in range(rounds if books.size else 0):
        books = moved(held, books)
    return books


def compress(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code (an entry of each part, two hex digits each), error (squared distances summed over the parts), label_error (errors summed
    over the rows of a label, those without one together) and codebooks_sha256, from rows (vec_id, label, vector).

    Rows without a vector, or with a null or non-finite component, go. Vectors shorter than the longest, or than a multiple of four, are filled
    up with zeros; components end at vectors.LARGEST. Rows that repeat, and null ids, are encoded like any other; rows of equal id start the
    codebooks in the order of their vectors; fewer rows than entries make smaller codebooks; other columns are ignored; an empty table gives no
    rows. The codebooks, of a fixed size, are all that passes through the driver.
    """
    held = prepared(rows, scale)
    books = train(held, entries, rounds)
    if not books.shape[1]:
        return held.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = stored(held.mapInArrow(_codes(books), "vec_id long, label string, code string, error long"), "codes")
    by_label = stored(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "codes-labels")
    sums = F.broadcast(by_label) if by_label.count() <= BROADCAST_MOST else by_label
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector")))


def _sql() -> str:
    rounds = []
    near = """near{i} AS MATERIALIZED (
  SELECT id, p, any_value(x) AS x, min(struct_pack(d := xx + cc - 2 * list_inner_product(x, c), e := e)) AS b FROM parts JOIN book{i} USING (p) GROUP BY id, p)"""
    for i in range(ROUNDS):
        rounds.append(near.format(i=i))
        rounds.append(f"""sums{i} AS (
  SELECT p, e, list(m ORDER BY k) AS c FROM (SELECT p, b.e AS e, k, floor(sum(x[k]) / count(*)) AS m FROM near{i}, range(1, 1 + (SELECT max(len(x)) FROM parts)) r(k) GROUP BY ALL) GROUP BY p, e)""")
        rounds.append(f"""book{i + 1} AS MATERIALIZED (
  SELECT p, e, c, list_inner_product(c, c) AS cc FROM (SELECT p, e, coalesce(s.c, b.c) AS c FROM book{i} b LEFT JOIN sums{i} s USING (p, e)))""")
    rounds.append(near.format(i=ROUNDS))
    return f"""
WITH kept AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT id, p, x, list_inner_product(x, x) AS xx
  FROM (SELECT id, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS x FROM kept, range({PARTS}) r(p))),
book0 AS MATERIALIZED (SELECT p, id - 1 AS e, x AS c, xx AS cc FROM parts WHERE id <= {ENTRIES}),
{", ".join(rounds)},
coded AS (
  SELECT id, string_agg(format('{{:02x}}', b.e), '' ORDER BY p) AS code, sum(b.d)::BIGINT AS error FROM near{ROUNDS} GROUP BY id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(c[k]::BIGINT::VARCHAR, ',' ORDER BY p, e, k)) FROM book{ROUNDS}, range(1, 1 + (SELECT max(len(x)) FROM parts)) r(k)) AS codebooks_sha256
FROM coded JOIN kept USING (id)
"""


SQL = _sql()
