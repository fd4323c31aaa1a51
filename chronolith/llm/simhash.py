"""Near-duplicate documents by SimHash, candidates found through the anchor points of a covering code.

A fingerprint is 64 bits wide. Two fingerprints at most `T` = 4 bits apart differ by at most 2 bits in one of their
32-bit halves, so each half is searched on its own. In a half, anchors are the words of a product of perfect covering
codes (binary Golay code, 23 bits, radius 3; Hamming codes, 7 bits, radius 1; every word of the remaining bits, radius
0). Two words 2 bits apart have a midpoint 1 bit from either; the anchor within the covering radius of the midpoint is
within radius + 1 of both. So a fingerprint is sent to every anchor within the covering radius plus 1, for a product:
to those whose excess over the radii, summed over its blocks, is at most 1. Every linked pair meets at an anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import map_arrow, stored, utf8, whole
from chronolith.llm.components import components

SEED, SHINGLE, T = 42, 4, 4
#: Fingerprints up to which the Golay blocks keep the anchors' groups small; beyond, finer codes are taken.
FEW, MANY = 30_000_000, 1_000_000_000
#: Anchors' groups of at most so many rows are compared by shifts; larger ones by search from one fingerprint to the next.
SHIFTS = 12


def fingerprint(text: bytes) -> int:
    """The SimHash of one text."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip((ends - lengths).tolist(), ends[SHINGLE - 1 :].tolist())], dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        bits = np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = np.array([fingerprint(x) for x in utf8(batch.column("text"))], dtype=np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every document; a null text counts as empty."""
    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _fingerprints, "doc_id long, fp long")


def _fingerprints_and_more(batch: pa.RecordBatch) -> pa.RecordBatch:
    return _fingerprints(batch).append_column("h", batch.column("h")).append_column("n", batch.column("n"))


class Block:
    """A perfect code of `width` bits, given by its parity-check columns, with covering radius `radius`."""

    def __init__(self, width: int, columns: list[int], radius: int):
        self.width, self.radius = width, radius
        n = 1 << max(1, max(columns, default=0).bit_length())
        self.low_bits = (width + 1) // 2
        self.low = self._sums(columns[: self.low_bits])
        self.high = self._sums(columns[self.low_bits :])
        found: list[list[list[int]]] = [[[], []] for _ in range(n)]
        for pattern, syndrome, weight in self._patterns(columns, radius + 1):
            found[syndrome][max(0, weight - radius)].append(pattern)
        self.nearest = np.array([x[0][0] if x[0] else 0 for x in found], np.uint32)
        most = max(len(x[1]) for x in found)
        self.next = np.array([x[1] + [-1] * (most - len(x[1])) for x in found], np.int64).reshape(n, most)

    @staticmethod
    def _sums(columns: list[int]) -> np.ndarray:
        out = np.zeros(1, np.uint32)
        for c in columns:
            out = np.concatenate([out, out ^ np.uint32(c)])
        return out

    @staticmethod
    def _patterns(columns: list[int], most: int) -> Iterator[tuple[int, int, int]]:
        level = [(0, 0, -1)]
        yield 0, 0, 0
        for weight in range(1, most + 1):
            level = [(p | 1 << i, s ^ c, i) for p, s, last in level for i, c in enumerate(columns) if i > last]
            yield from ((p, s, weight) for p, s, _ in level)

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.low[words & np.uint32((1 << self.low_bits) - 1)] ^ self.high[words >> np.uint32(self.low_bits)]


def _golay_columns() -> list[int]:
    out, x = [], 1
    for _ in range(23):
        out.append(x)
        x <<= 1
        if x >> 11:
            x ^= 0xC75
    return out


@lru_cache(maxsize=None)
def code(kind: str) -> tuple[Block, ...]:
    """The blocks of a half's 32 bits. coarse: 2^21 anchors, 14 for a fingerprint on average; fine: 2^26, 25; finest: 2^29, 29."""
    hamming = lambda: Block(7, list(range(1, 8)), 1)
    free = lambda n: Block(n, [0] * n, 0)
    return {"coarse": lambda: (Block(23, _golay_columns(), 3), free(9)), "fine": lambda: (hamming(), hamming(), free(18)), "finest": lambda: (hamming(), free(25))}[kind]()


def anchors(words: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """For the 32-bit halves `words`: positions in `words` and anchors, one for each anchor within the radius plus 1."""
    at, parts, base = 0, [], np.zeros(len(words), np.uint32)
    for block in code(kind):
        own = (words >> np.uint32(at)) & np.uint32((1 << block.width) - 1)
        syndrome = block.syndrome(own)
        near = own ^ block.nearest[syndrome]
        base |= near << np.uint32(at)
        parts.append((at, block, own, syndrome, near))
        at += block.width
    who, found = [np.arange(len(words))], [base]
    for at, block, own, syndrome, near in parts:
        other = block.next[syndrome]
        rows, cols = np.nonzero(other >= 0)
        who.append(rows)
        moved = own[rows] ^ other[rows, cols].astype(np.uint32) ^ near[rows]
        found.append(base[rows] ^ (moved << np.uint32(at)))
    return np.concatenate(who), np.concatenate(found)


def _replicate(kind: str):
    def rows_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        keys, at = [], []
        for half in (0, 1):
            who, anchor = anchors((fp >> np.uint64(32 * half)).astype(np.uint32), kind)
            keys.append(anchor.astype(np.int64) | half << 32)
            at.append(who)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(fp[np.concatenate(at)].view(np.int64))], names=["anchor", "fp"])

    return rows_of


def _search(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links (places in fps) that join what is linked among fps: from a fingerprint to all within T that nothing reached before. Copies
    of one text leave the rest at once, so a group costs about its size times its number of unlinked parts."""
    links, rest, todo = [], np.arange(1, len(fps)), [0]
    while True:
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count(fps[rest] ^ fps[x]) <= T
            if near.any():
                hit = rest[near].tolist()
                links += [(x, y) for y in hit]
                todo += hit
                rest = rest[~near]
        if not len(rest):
            return links
        todo, rest = [int(rest[0])], rest[1:]


def linked(keys: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Pairs of places (n x 2) whose fingerprints are at most T bits apart, within the groups of equal, sorted keys."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(keys)])))
    small = np.flatnonzero(np.repeat(sizes <= SHIFTS, sizes))
    out = [np.zeros((0, 2), np.int64)]
    k, f = keys[small], fps[small]
    for shift in range(1, int(min(SHIFTS, sizes.max(initial=1)))):
        a = np.flatnonzero(k[shift:] == k[:-shift])
        a = a[np.bitwise_count(f[a] ^ f[a + shift]) <= T]
        out.append(np.stack([small[a], small[a + shift]], axis=1))
    for i in np.flatnonzero(sizes > SHIFTS):
        found = _search(fps[starts[i] : starts[i] + sizes[i]])
        if found:
            out.append(np.array(found) + starts[i])
    return np.concatenate(out)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by anchor; a group may reach over batches, and only the last group is carried on."""
    held: list[tuple[np.ndarray, ...]] = []

    def out(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        pairs = np.unique(np.sort(fps[linked(keys, fps)].view(np.int64).reshape(-1, 2), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["a", "b"])

    for batch in batches:
        k, f = batch.column("anchor").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
        if not len(k):
            continue
        held.append((k, f))
        if k[0] == k[-1] and held[0][0][0] == k[0]:
            continue
        keys, fps = (np.concatenate(x) for x in zip(*held))
        cut = int(np.searchsorted(keys, keys[-1]))
        yield out(keys[:cut], fps[:cut])
        held = [(keys[cut:], fps[cut:])]
    if held:
        yield out(*(np.concatenate(x) for x in zip(*held)))


def links(distinct: DataFrame, kind: str) -> DataFrame:
    """Pairs a < b of the distinct fingerprints (fp), enough of them to join whatever is linked."""
    sent = map_arrow(distinct.select("fp"), _replicate(kind), "anchor long, fp long")
    return sent.repartition(F.col("anchor")).sortWithinPartitions("anchor").mapInArrow(_links, "a long, b long")


def kind_of(n: int) -> str:
    """The codes for n distinct fingerprints."""
    return "coarse" if n <= FEW else "fine" if n <= MANY else "finest"


def _rooted(distinct: DataFrame) -> DataFrame:
    """The distinct fingerprints, whole rows, with root: the least fingerprint, as a signed number, that links reach."""
    root = components(links(distinct, kind_of(distinct.count()))).select(F.col("node").alias("_node"), "root")
    return distinct.join(root, distinct.fp == root._node, "left").select(*distinct.columns, F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for each row of docs: the smallest doc_id that links of at most T bits reach, itself included.

    Null texts count as empty, and all texts without a word share the fingerprint zero. Repeated rows and equal texts fall
    into one component. Any long is an id. A null doc_id is carried through and never names a component unless all of it have none (then
    null). Other columns are ignored; an empty table gives no rows.
    """
    own = stored(fingerprints(docs), "simhash")
    distinct = stored(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    # a component's fingerprints are dealt over as many parts as a shuffle has, and the parts' least ids joined: a hot one stays split
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rooted = stored(_rooted(distinct).withColumn("part", F.pmod(F.xxhash64("fp"), F.lit(parts))), "simhash-rooted")
    by_part = stored(rooted.groupBy("root", "part").agg(F.min("first").alias("least")), "simhash-parts")
    named = by_part.groupBy("root").agg(F.min("least").alias("component_id"))
    named = by_part.select("root", "part").join(named, "root")
    ids = rooted.join(named, ["root", "part"]).select(F.col("fp").alias("_fp"), "component_id")
    return own.join(stored(ids, "simhash-ids"), F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    from chronolith.llm.common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents without near copies: of each component, the row of the least doc_id (null after all others), fingerprint and
    text's hash stays, and of rows equal in these the first. All columns stay, whatever their names and types; null and empty texts are
    copies of one another; an empty table stays empty.

    Rows are written with a number of their own, by which the kept ones are found again. So rows without an id, or with one id and
    different texts, are documents of their own, and components are those of fingerprints: a repeated id links nothing. Whole rows are
    shuffled once, and never sorted by their columns.
    """
    rows = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("n")), "simhash-rows")
    text = F.col("row.text").cast("string")
    texts = rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), "n")
    own = map_arrow(texts, _fingerprints_and_more, "doc_id long, fp long, h long, n long")
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "fp", "h", "n")
    rooted = _rooted(stored(own.groupBy("fp").agg(F.min(order).alias("least")), "simhash-distinct"))
    first = stored(rooted.groupBy("root").agg(F.min("least").alias("least")).select("least.n"), "simhash-first")
    # a merge join at every size: the kept numbers grow with the documents
    return rows.join(first.hint("merge"), "n", "left_semi").select("row.*")
