"""What the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.sources.shared import stored  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def map_arrow(df: DataFrame, rows_of: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield rows_of(batch)

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The strings' bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points in a row (uint32), and where each text begins (one more: the end)."""
    joined = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return joined, np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))


def slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbours whose lengths add up to about `most`; a longer one stands alone."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_rows(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def sample_hash(column: str | Column = "doc_id", seed: int = 7) -> Column:
    """A number from 0 to 1 for each value, the same in every run."""
    return F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each place of an array of int, step over all values up to it, from 0; in pieces of about the root of their number, as an
    array that grows is copied at each step."""
    none = F.expr("cast(array() as array<int>)")

    def over(part: Column, first: Column) -> Column:
        grown = lambda acc, x: let(step(acc.at, x), lambda at: F.struct(at.alias("at"), F.concat(acc.out, F.array(at)).alias("out")))
        return F.aggregate(part, F.struct(first.alias("at"), none.alias("out")), grown, lambda acc: acc.out)

    def pieces(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        return let(width, lambda w: F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / w).cast("int")), lambda i: F.slice(v, i * w + 1, w)))

    def joined(parts: Column) -> Column:
        ends = over(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), step)), F.lit(0))
        return let(ends, lambda at: F.flatten(F.transform(parts, lambda p, i: over(p, F.when(i > 0, F.get(at, i - 1)).otherwise(0)))))

    return let(values, lambda v: F.when(F.size(v) > 0, let(pieces(v), joined)).otherwise(none))
