"""Document fingerprints by locally consistent parsing.

Each level turns a row of names into a shorter one. Runs of one name become one name. Deterministic coin tossing then
labels every name by the lowest bit in which it differs from its left neighbour, twice, so that labels are few and
neighbours differ; phrases begin where the label is a local maximum, and a phrase's name is a hash of its names. All of
this looks at a few neighbours only, so equal substrings get equal phrases, but for a few at their ends, wherever they
stand. A document's fingerprint is the bottom-k sketch of its phrase names on the upper levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import code_points, map_arrow, mix64, slices, table, text_rows

#: Levels, those whose names are sketched, names in a sketch, code points worked on at a time.
LEVELS, SKETCHED, K, AT_ONCE = 3, (2, 3), 64, 150_000
BASE = 0x9E3779B97F4A7C15
LEAST = -(1 << 63)
#: Rows of the sample for each bucket; low bits of a row's place that are its own; bytes of texts that are compared at once.
SAMPLE, OWN_BITS, TEXTS_AT_ONCE = 32, (1 << 24) - 1, 1 << 22


def _second_labels() -> np.ndarray:
    a = np.arange(132, dtype=np.uint16)
    d = a[:, None] ^ a[None, :]
    low = d & -d
    place = np.bitwise_count((low - 1).astype(np.uint16))
    out = 2 * place + ((a[None, :] & low) != 0)
    return np.where(d == 0, 17, out).astype(np.uint8).ravel()


_LABELS = _second_labels()
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        with np.errstate(over="ignore"):
            for key, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                x = np.full(n, base, np.uint64)
                x[:1] = 1
                _POWERS[key] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def parse_level(names: np.ndarray, firsts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One level over the names of several documents in a row. firsts: where the (non-empty) documents begin; at: each
    name's place in its text. Returns the phrases' names, firsts and places."""
    new = np.empty(len(names), bool)
    np.not_equal(names[1:], names[:-1], out=new[1:])
    new[firsts] = True
    run = np.flatnonzero(new)
    s = names[run]
    length = np.diff(np.append(run, len(names)))
    long = np.flatnonzero(length > 1)
    s[long] = mix64(s[long] + length[long].astype(np.uint64) * np.uint64(BASE))
    first = np.searchsorted(run, firsts)

    d = s.copy()
    d[1:] ^= s[:-1]
    d[first] = s[first]
    low = d & (~d + np.uint64(1))
    label = np.bitwise_count(low - np.uint64(1)) * np.uint8(2)
    label += (s & low) != 0
    pair = np.empty(len(s), np.uint16)
    pair[1:] = label[:-1]
    pair[first] = 131
    pair *= np.uint16(132)
    pair += label
    label = _LABELS[pair]

    cut = np.empty(len(s), bool)
    np.greater(label[1:], label[:-1], out=cut[1:])
    cut[:-1] &= label[:-1] >= label[1:]
    last = np.append(first[1:], len(s)) - 1
    cut[last] = False
    cut[first] = True
    begin = np.flatnonzero(cut)
    up, down = _powers(len(s))
    phrase = np.add.reduceat(s * up[: len(s)], begin) * down[begin]
    return mix64(phrase + np.uint64(BASE)), np.searchsorted(begin, first), at[run[begin]]


def parse(texts: list[str], levels: int = LEVELS) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """level, names, document (position in texts) and place of every phrase, level by level."""
    joined, bounds = code_points(texts)
    if not len(joined):
        return
    owners = np.flatnonzero(np.diff(bounds))
    firsts, names = bounds[owners], joined.astype(np.uint64) + np.uint64(1)
    at = np.arange(len(joined)) - np.repeat(bounds[:-1], np.diff(bounds))
    for level in range(1, levels + 1):
        names, firsts, at = parse_level(names, firsts, at)
        yield level, names, np.repeat(owners, np.diff(np.append(firsts, len(names)))), at


def sketches(texts: list[str]) -> list[np.ndarray]:
    """The K least 32-bit phrase names of each text, ascending; none for an empty text."""
    out: list[np.ndarray] = []
    for a, b in slices(list(map(len, texts)), AT_ONCE):
        keys = [(doc.astype(np.uint64) << np.uint64(32)) | (names >> np.uint64(32)) for level, names, doc, _ in parse(texts[a:b]) if level in SKETCHED]
        found = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        ends = np.searchsorted(found, np.arange(b - a + 1, dtype=np.uint64) << np.uint64(32))
        names = found.astype(np.uint32)
        out += [names[i : min(j, i + K)] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
    return out


def fingerprint(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """The share of common names among the K least of both sketches together; two empty ones are alike."""
    both = np.union1d(x, y)[:K]
    if not len(both):
        return 1.0
    return float(np.isin(both, np.intersect1d(x, y, assume_unique=True), assume_unique=True).sum() / len(both))


def _phrases(batch: pa.RecordBatch, levels: int) -> pa.RecordBatch:
    ids, texts = np.array(batch.column("doc_id").to_pylist(), dtype=object), text_rows(batch)
    parts = [(np.full(len(n), level, np.int32), n.view(np.int64), doc, at) for level, n, doc, at in parse(texts, levels)]
    level, names, doc, at = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int32), *[np.zeros(0, np.int64)] * 3)
    return pa.RecordBatch.from_arrays([pa.array(ids[doc].tolist(), pa.int64()), pa.array(level), pa.array(at), pa.array(names)], names=["doc_id", "level", "start", "name"])


def phrases(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, level, start (code points), name of every phrase: the parse itself. Null and empty texts have no phrases."""
    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), partial(_phrases, levels=levels), "doc_id long, level int, start long, name long")


def beside_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, text with bucket, key, within and extra, dealt and sorted so that each row's follower in its bucket is the next document
    by descending doc_id; at a bucket's end stands, marked extra, the first row of the next bucket.

    Rows of one id follow each other by a hash of their texts, and those without one come last, by the same; the hash's low bits are the
    row's own, so that neither a hot id nor many copies of one row must share a bucket. Buckets are cut by a sample of SAMPLE rows a bucket;
    the sample and each bucket's first row, numbers alone, pass through the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit(OWN_BITS))
    within = F.xxhash64("text").bitwiseAND(F.lit(~OWN_BITS)).bitwiseOR(own)
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(LEAST))).withColumn("within", within)
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = SAMPLE * buckets / max(1, docs.count())
    drawn = F.pmod(F.xxhash64("within", "key"), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30)))
    sample = sorted(((-r.key, r.within) for r in rows.where(drawn).select("key", "within").collect()))
    bounds = [sample[i * len(sample) // buckets] for i in range(1, buckets)] if len(sample) >= buckets else sample
    rows = rows.withColumn("bucket", _places([-k for k, _ in bounds], [w for _, w in bounds]))
    first = F.max(F.struct("key", (-1 - F.col("within")).alias("within")))  # of the greatest keys the least within
    tops = sorted(rows.groupBy("bucket").agg(first.alias("top")).collect())
    above = [(r.top.key, -1 - r.top.within, tops[i - 1].bucket) for i, r in enumerate(tops)]  # the first row of all follows the last
    after = F.broadcast(spark.createDataFrame(above, "top long, top_within long, above int"))
    both = rows.join(after, (rows.key == after.top) & (rows.within == after.top_within), "left")
    both = both.withColumn("to", F.explode(F.expr("if(above is null, array(struct(bucket, 0 as extra)), array(struct(bucket, 0 as extra), struct(above as bucket, 1 as extra)))")))
    both = both.select("doc_id", "text", "key", "within", "to.bucket", "to.extra")
    return both.repartition(F.col("bucket")).sortWithinPartitions("bucket", "extra", F.desc("key"), "within")


def _places(keys: list[int], withins: list[int]) -> Column:
    """How many of the bounds, sorted by descending key and then within, do not come after a row: a binary search."""
    if not keys:
        return F.lit(0)
    k, w = (F.array(*map(F.lit, x)) for x in (keys, withins))

    def step(at: Column, _: Column) -> Column:
        middle = F.shiftright(at.low + at.high, 1)
        upto = (F.get(k, middle) > F.col("key")) | ((F.get(k, middle) == F.col("key")) & (F.get(w, middle) <= F.col("within")))
        going = at.low < at.high
        return F.struct(F.when(going & upto, middle + 1).otherwise(at.low).alias("low"), F.when(going & ~upto, middle).otherwise(at.high).alias("high"))

    steps = F.sequence(F.lit(0), F.lit(len(keys).bit_length()))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(keys)).alias("high")), step, lambda at: at.low)


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _against_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple | None = None
    for batch in batches:
        lengths = pc.binary_length(batch.column("text")).fill_null(0).to_pylist()
        for a, b in slices(lengths, TEXTS_AT_ONCE):
            rows = batch.slice(a, b - a)
            texts = text_rows(rows)
            own = sketches(texts)
            rows = list(zip(rows.column("bucket").to_pylist(), rows.column("extra").to_pylist(), rows.column("doc_id").to_pylist(), texts, own))
            rows = [held, *rows] if held else rows
            held = rows[-1]
            pairs = [(x, y) for x, y in zip(rows, rows[1:]) if x[0] == y[0] and not x[1]]
            if pairs:
                yield _compared(pairs)


def _compared(pairs: list[tuple[tuple, tuple]]) -> pa.RecordBatch:
    edited = [x[3][: len(x[3]) - len(x[3]) // 3] + y[3][: len(x[3]) // 3] for x, y in pairs]
    found = sketches(edited)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([x[2] for x, _ in pairs], pa.int64()),
            pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
            pa.array([fingerprint(x[4]) for x, _ in pairs], pa.string()),
            pa.array([fingerprint(f) for f in found], pa.string()),
            pa.array([likeness(x[4], f) for (x, _), f in zip(pairs, found)], pa.float64()),
            pa.array([likeness(x[4], y[4]) for x, y in pairs], pa.float64()),
        ],
        names=[c.split()[0] for c in EDITED.split(", ")],
    )


def fingerprint_edits(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Each document's fingerprint beside that of its edited text (its last third replaced by the head of the next document,
    by descending doc_id, the first after the last) and their likenesses. Null texts count as empty; repeated rows each
    give a row; other columns are ignored; an empty table gives no rows."""
    return beside_next(docs, buckets).mapInArrow(_against_next, EDITED)


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
