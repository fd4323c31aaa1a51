"""Bound-certified best-fit packing of tokenised documents into sequences.

Documents become token ids plus an end id; only longer ones are cut, into full sequences and one shorter first piece.
Full pieces are sequences of their own. The other pieces are dealt into groups by a hash; each group is packed by
best-fit decreasing, and a lower bound from dual feasible functions certifies its number of bins. Groups with more bins
than their bound exchange documents: the pieces of their bins that are not full meet those of other such groups, and
best fit decreasing runs again, on fewer and fuller groups, for as many rounds as asked. A rerun counts only where it needs fewer bins.
"""

from __future__ import annotations

import base64
import json
import logging
import math
import zlib
from functools import lru_cache, partial
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import map_arrow, stored, table

LOG = logging.getLogger(__name__)
CAPACITY, END = 1024, 2
#: Pieces of a group, on average (half as many in a rerun); rounds.
GROUP, ROUNDS = 4096, 3


def added_tokens(ranks_path: str) -> dict[str, int]:
    """The added tokens of the tokenizer file that lies beside a ranks file, if there is one."""
    beside = Path(ranks_path).with_suffix(".json")
    return {t["content"]: t["id"] for t in json.loads(beside.read_text("utf-8"))["added_tokens"]} if beside.exists() else {}


@lru_cache(maxsize=2)
def encoder(ranks_path: str):
    """The byte-level BPE of a ranks file, with the added tokens of its tokenizer."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added_tokens(ranks_path))


@lru_cache(maxsize=2)
def slow_encoder(ranks_path: str):
    """The tokenizer file that lies beside a ranks file."""
    import tokenizers

    return tokenizers.Tokenizer.from_file(str(Path(ranks_path).with_suffix(".json")))


def encoded(text: str, ranks_path: str) -> np.ndarray:
    """The ids of a text. A run of some 700,000 characters of white space is more than the fast encoder's pattern can step back
    over; the tokenizer itself then encodes the text, to the same ids."""
    try:
        return encoder(ranks_path).encode_to_numpy(text, allowed_special="all")
    except ValueError:
        return np.array(slow_encoder(ranks_path).encode(text, add_special_tokens=False).ids, np.uint32)


def tokenizer_path() -> str:
    """The ranks of the vocabulary of byte_bpe_50k.json, which gives the same ids several times faster."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: whole, or a first piece of n mod capacity and full ones."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * (first > 0) + [(s, capacity) for s in range(first, n, capacity)]


def _tokenise(batch: pa.RecordBatch, ranks_path: str, capacity: int, with_ids: bool) -> pa.RecordBatch:
    doc_ids, out = batch.column("doc_id").to_pylist(), ([], [], [], [], [], [])
    for doc_id, text in zip(doc_ids, batch.column("text").to_pylist()):
        ids = np.append(encoded(text, ranks_path) if text else np.zeros(0, np.uint32), END).astype("<u4")
        for k, (start, length) in enumerate(cuts(len(ids), capacity)):
            raw = ids[start : start + length].tobytes()
            for column, x in zip(out, (doc_id, k, start, length, zlib.crc32(raw), raw if with_ids else None)):
                column.append(x)
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    keep = len(names) - (not with_ids)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in list(zip(out, types))[:keep]], names=names[:keep])


def pieces(docs: DataFrame, ranks_path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian 32-bit) of every piece. A null text has the end id alone."""
    rows = partial(_tokenise, ranks_path=ranks_path or tokenizer_path(), capacity=capacity, with_ids=with_ids)
    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), rows, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The bin and offset of each item, and the number of bins. Ties keep their order."""
    bins, offsets, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    space: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: a bin has room for r
    sizes = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = sizes[i]
        if fits := mask >> size:
            room = size + (fits & -fits).bit_length() - 1
            b = space[room].pop()
            if not space[room]:
                mask ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - room
        if room > size:
            space[room - size].append(b)
            mask |= 1 << (room - size)
    return bins, offsets, n


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest of the bounds that dual feasible functions give: f_e counts items over capacity - e as a whole bin and drops
    those under e; u_k rounds by multiples of capacity / (k + 1)."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int(count @ x) // capacity)
    total, number = np.cumsum(count * x), np.cumsum(count)
    for e in range(1, capacity // 2 + 1):
        large = int(number[-1] - number[capacity - e])
        middle = int(total[capacity - e] - total[e - 1])
        best = max(best, large + -(-middle // capacity))
    for k in range(1, 64):
        whole = (k + 1) * x % capacity == 0
        u = np.where(whole, x * k, (k + 1) * x // capacity * capacity)  # times k
        best = max(best, -(-int(count @ u) // (capacity * k)))
    return best


def _pack(rows: pd.DataFrame, capacity: int, turn: int) -> pd.DataFrame:
    lengths = rows["length"].to_numpy()
    bins, offsets, n = best_fit_decreasing(lengths, capacity)
    bound = lower_bound(lengths, capacity)
    group = int(rows["grp"].iloc[0])
    before = rows["sequence_id"].nunique()
    if turn and before <= n:
        rows["bound"] = bound
        return rows.assign(turn=turn, gap=before > bound, grp=group)
    filled = np.bincount(bins, weights=lengths, minlength=n)
    return rows.assign(sequence_id=((group << 24 | bins) << 3 | turn) << 1 | 1, offset=offsets, full=filled[bins] == capacity, gap=n > bound, bound=bound, turn=turn)


PLACED = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, grp long, sequence_id long, offset long, full boolean, gap boolean, bound long, turn int"


def numbered(cut: DataFrame) -> DataFrame:
    return cut.withColumn("row", F.monotonically_increasing_id())


def place(cut: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """The pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset; also grp, turn and bound: the group
    that placed the piece, in which round, and its certified least number of bins.

    Pieces are dealt into groups by row, a number of their own, which they get here unless they have one: so pieces of any equal keys, or without
    an id, are placed one by one and fill no group. Lengths are from 1 to capacity. An empty table gives no rows.
    """
    if "row" not in cut.columns:
        cut = stored(numbered(cut), "pieces")
    whole = cut.where(F.col("length") == capacity).select("*", F.lit(0).cast("long").alias("grp"), (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("full"), F.lit(False).alias("gap"), F.lit(1).cast("long").alias("bound"), F.lit(-1).alias("turn"))
    todo = cut.where(F.col("length") < capacity)
    n = todo.count()
    groups = max(1, math.ceil(n / group))
    todo = todo.select("*", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(groups)).alias("grp"), F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(False).alias("full"), F.lit(False).alias("gap"), F.lit(0).cast("long").alias("bound"), F.lit(0).alias("turn"))
    done = whole.select(*[c.split()[0] for c in PLACED.split(", ")])
    for turn in range(rounds):
        placed = stored(todo.groupBy("grp").applyInPandas(partial(_pack, capacity=capacity, turn=turn), PLACED), "packed")
        again = F.col("gap") & ~F.col("full")
        gaps, rows = placed.where(again).agg(F.countDistinct("grp"), F.count(F.lit(1))).first()
        left = certified(placed).agg(F.sum("bins"), F.sum("bound"), F.count_if(F.col("bins") > F.col("bound"))).first()
        LOG.info("packing, round %d: %s bins, certified to need %s at least; %s groups have more than their bound", turn, *left)
        if gaps < 2 or turn == rounds - 1:
            return done.unionByName(placed)
        done = done.unionByName(placed.where(~again))
        # whole bins move, so that a rerun can be held against the bins it had
        groups = math.ceil(2 * rows / group)
        todo = placed.where(again).withColumn("grp", F.pmod(F.xxhash64("sequence_id", F.lit(turn)), F.lit(groups)))
    return done


def certified(placed: DataFrame) -> DataFrame:
    """grp, turn, bins, bound: of each group of a round, the bins it needs and the number it is certified to need at least."""
    return placed.groupBy("grp", "turn").agg(F.countDistinct("sequence_id").alias("bins"), F.max("bound").alias("bound"))


def pack(docs: DataFrame, ranks_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of docs (doc_id, text; other columns are
    ignored). Repeated rows and a null doc_id are packed like any other."""
    cut = stored(numbered(pieces(docs, ranks_path, capacity)), "pieces")
    return place(cut, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _join(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("offset")
    return pd.DataFrame({"sequence_id": rows["sequence_id"].iloc[:1], "ids": [b"".join(rows["ids"])], "doc_ids": [rows["doc_id"].tolist()]})


def sequences(docs: DataFrame, ranks_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (little-endian 32-bit, at most capacity), doc_ids in their order.

    A null text is the end id alone; rows that repeat, and null ids, are packed like any other; other columns are ignored; an empty table
    gives no rows."""
    cut = stored(numbered(pieces(docs, ranks_path, capacity, with_ids=True)), "pieces")
    placed = place(cut.drop("ids"), capacity).select("row", "sequence_id", "offset")
    both = placed.join(cut.select("row", "ids", "doc_id"), "row")
    return both.select("sequence_id", "offset", "ids", "doc_id").groupBy("sequence_id").applyInPandas(_join, "sequence_id long, ids binary, doc_ids array<long>")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
