"""Classical scaling of a distance table: coordinates whose distances are as near the table's as any in so few dimensions.

The table is never made a matrix. With S the squared distances and V a few columns that sum to zero, the doubly centred table times V
is -1/2 S V, centred again: one join of the pairs with the points' columns and one sum. A block of columns is multiplied so again and
again and made orthonormal (subspace iteration); its small matrices, a few numbers a group, give Rayleigh quotients, with their signs, and
the residuals that say when the wanted axes stand still.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.sources.shared import stored

#: Columns that are carried beside the wanted ones, so that these settle sooner; rounds; residual over the largest eigenvalue at the end.
SPARE, ROUNDS, TOLERANCE = 4, 100, 1e-7
#: Points up to which the columns are broadcast to the pairs; beyond, an ordinary join.
BROADCAST_MOST = 1_000_000


def _turn(gram: np.ndarray, product: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """From Y'Y and V'Y of orthonormal V and Y = BV: what makes Y orthonormal, the rotation of V to its Ritz vectors and their values,
    the wanted (largest positive) ones first, and the residual of the wanted ones over the largest value."""
    length, u = np.linalg.eigh((gram + gram.T) / 2)
    made = np.where(length > max(length.max(initial=0.0), 0.0) * 1e-24, 1 / np.sqrt(np.maximum(length, 1e-300)), 0.0)
    theta, q = np.linalg.eigh((product + product.T) / 2)
    order = np.argsort(-theta)
    theta, q = theta[order], q[:, order]
    largest = np.abs(theta).max(initial=0.0)
    left = np.maximum(np.diag(q.T @ gram @ q) - theta**2, 0.0)[:k]
    wanted = theta[:k] > largest * 1e-9
    gap = float(np.sqrt(left[wanted].max(initial=0.0)) / largest) if largest else 0.0
    return u * made, q, theta, gap


def _dot(row: list[Column], by: Column, at: int, m: int) -> Column:
    """Column `at` of row times a matrix, m x m, row after row, in one array."""
    out = F.lit(0.0)
    for i, x in enumerate(row):
        out = out + x * F.get(by, F.lit(i * m + at))
    return out


def classical(pairs: DataFrame, k: int = 2, by: str | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(by), id, c1 ... ck, e1 ... ek: coordinates, the axis of the largest eigenvalue first, and the share of each in the trace.

    pairs: (by), a, b, d, each pair of two points once, in either order; of each group's points all pairs must be there, else it is an
    error. An axis whose eigenvalue is not positive is dropped: its coordinates and share are 0. On each axis the coordinate farthest from
    0 is positive (of equally far ones that of the least id). Groups are scaled each for itself, all in the same jobs."""
    spark, g = pairs.sparkSession, F.col(by) if by else F.lit(0)
    rows = pairs.select(g.alias("g"), "a", "b", (F.col("d").cast("double") * F.col("d")).alias("s"))
    both = stored(rows.unionByName(rows.select("g", F.col("b").alias("a"), F.col("a").alias("b"), "s")), "scaling-pairs")
    sizes = both.groupBy("g", "a").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("s")).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("s").alias("s"))
    sizes = stored(sizes.select("g", "n", "least", "most", (F.col("s") / (2 * F.col("n"))).alias("trace")), "scaling-sizes")
    if sizes.where("least <> n - 1 or most <> n - 1").limit(1).count():
        raise ValueError("a distance table needs every pair of its points once")
    m = k + SPARE
    names, made = [f"v{i}" for i in range(m)], [f"y{i}" for i in range(m)]
    seeds = [(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1 << 20)) / float(1 << 20) - 0.5).alias(f"y{i}") for i in range(m)]
    points = both.select("g", F.col("a").alias("id")).distinct().select("g", "id", *[F.lit(0.0).alias(v) for v in names], *seeds)
    few = both.select("g", "a").distinct().count() <= BROADCAST_MOST

    def small(df: DataFrame) -> DataFrame:
        """Each group's m x m matrices, of its columns less their means."""
        product = lambda xs: F.array(*[F.sum(F.col(x) * F.col(y)) for x in xs for y in made])
        sums = df.groupBy("g").agg(product(made).alias("gram"), product(names).alias("product"), F.array(*[F.avg(y) for y in made]).alias("mean"), F.count(F.lit(1)).alias("n"))

        def solved(batches):
            for b in batches:
                found = [_turn(np.reshape(x, (m, m)) - n * np.outer(c, c), np.reshape(y, (m, m)), k) for x, y, c, n in zip(b.gram, b["product"], b["mean"], b.n)]
                yield pd.DataFrame({"g": b.g, "mean": b["mean"], "w": [f[0].ravel() for f in found], "q": [f[1].ravel() for f in found], "theta": [f[2] for f in found], "gap": [f[3] for f in found]})

        return stored(sums.mapInPandas(solved, f"g {dict(df.dtypes)['g']}, mean array<double>, w array<double>, q array<double>, theta array<double>, gap double"), "scaling-small")

    state = stored(points, "scaling")
    for i in range(rounds + 1):
        turn = small(state)
        if i == rounds or (turn.agg(F.max("gap")).first()[0] or 0.0) <= tolerance and i > 1 or not i and turn.isEmpty():
            break
        less = [F.col(y) - F.get("mean", F.lit(j)) for j, y in enumerate(made)]
        now = state.join(turn, "g").select("g", "id", *[_dot(less, F.col("w"), j, m).alias(names[j]) for j in range(m)])
        now = stored(now, "scaling-columns")
        other = now.withColumnRenamed("id", "b")
        summed = both.join(F.broadcast(other) if few else other, ["g", "b"]).groupBy("g", F.col("a").alias("id")).agg(*[(F.sum(F.col("s") * F.col(names[j])) / -2).alias(made[j]) for j in range(m)])
        state = stored(now.join(summed, ["g", "id"]), "scaling")
    share = lambda j: F.greatest(F.get("theta", F.lit(j)), F.lit(0.0))
    positive = lambda j: F.get("theta", F.lit(j)) > F.get("theta", F.lit(0)) * 1e-9
    at = state.join(turn, "g").join(sizes.select("g", "trace"), "g")
    axis = lambda j: F.when(positive(j), _dot([F.col(v) for v in names], F.col("q"), j, m) * F.sqrt(share(j))).otherwise(0.0)
    shares = [F.when(positive(j) & (F.col("trace") > 0), share(j) / F.col("trace")).otherwise(0.0).alias(f"e{j + 1}") for j in range(k)]
    placed = stored(at.select("g", "id", *[axis(j).alias(f"c{j + 1}") for j in range(k)], *shares), "scaling-placed")
    side = placed.groupBy("g").agg(*[F.min_by(f"c{j + 1}", F.struct(-F.round(F.abs(f"c{j + 1}"), 9), "id")).alias(f"s{j + 1}") for j in range(k)])
    turned = [(F.col(f"c{j + 1}") * F.when(F.col(f"s{j + 1}") < 0, -1.0).otherwise(1.0)).alias(f"c{j + 1}") for j in range(k)]
    return placed.join(side, "g").select(*([F.col("g").alias(by)] if by else []), "id", *turned, *[f"e{j + 1}" for j in range(k)])
