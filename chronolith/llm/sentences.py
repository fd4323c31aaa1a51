"""Substring dedup by sliding sentence spans.

Every run of several consecutive sentences is hashed: from each sentence on, the shortest run of at least RUN sentences
and WORDS words. As a passage may begin or end inside a long sentence, an additional rule hashes the run of PART_WORDS words from each part
of a long sentence on, cut where its own words say. The hashes, of 96 bits, meet over the corpus; the occurrence of the
least (doc_id, text's hash, place) is a span's first, and what any other occurrence covers is removed: whole sentences and, by the
additional rule, at the edges of a passage the repeated part of a long one.

Only the first occurrence in a batch of texts goes to the shuffle under its hash: all others in the batch are known not to be the first. So a
passage that very many documents share is as many rows as there are batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.llm.common import code_points, map_arrow, mix64, slices, stored, table, text_rows

#: Sentences and words that a run has at least.
RUN, WORDS = 2, 30
#: Words of a run of the additional rule at least, and of a sentence that it does not cut. A longer one is cut after every word whose
#: letters' code points add up to a multiple of CUT, and every LONGEST words after such a cut, alike wherever in a sentence a passage begins.
PART_WORDS, LONGEST, CUT = 36, 16, 8
#: Code points split at a time, and whose spans are compared before the shuffle.
AT_ONCE, TOGETHER = 200_000, 8_000_000
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    """Code points up to 0x3000 in lower case, those that have one of one code point."""
    return np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in map(chr, range(0x3000))], np.uint32)


@lru_cache(maxsize=8)
def _powers_of(size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(size, b, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers_of(1 << max(16, int(n).bit_length()), base)


class Sentences:
    """The sentences of several texts in a row. A sentence ends after a stop before white space, or after a line feed; those without a
    word are none; the white space before a sentence, and all before the first one of a text, is its own."""

    def __init__(self, texts: list[str]):
        # a line feed after every text ends its last sentence
        x, bounds = code_points([t + "\n" for t in texts])
        self.x = np.where(x < 0x3000, _lower()[np.minimum(x, 0x2FFF)], x)
        self.space = (x == 32) | ((x >= 9) & (x <= 13))
        begin = ~self.space
        begin[1:] &= self.space[:-1]
        self.word_at = np.flatnonzero(begin)
        stop = x == 10
        stop[:-1] |= ((x == 46) | (x == 33) | (x == 63))[:-1] & self.space[1:]
        stops = np.flatnonzero(stop)
        which = np.searchsorted(stops, self.word_at)
        #: of each sentence: its first word, its place from and to, its text
        self.first = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1]))) if len(which) else which
        self.doc = np.searchsorted(bounds, self.word_at[self.first], side="right") - 1
        own = which[self.first]
        lead = np.concatenate(([True], self.doc[1:] != self.doc[:-1])) if len(own) else np.zeros(0, bool)
        self.start = np.where(lead, 0, stops[np.maximum(own - 1, 0)] + 1 - bounds[self.doc])
        self.end = np.minimum(stops[own] + 1, bounds[self.doc + 1] - 1) - bounds[self.doc]
        self.bounds = bounds

    def spans(self, run: int, words: int, part_words: int) -> tuple[np.ndarray, ...]:
        """text, start, end (places in it) and two hashes of every run, each once."""
        n = len(self.word_at)
        if not n:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
        up, down = _powers(len(self.x), BASES[0])
        value = (self.x.astype(np.uint64) + np.uint64(1)) * up[: len(self.x)]
        value[self.space] = 0
        word = mix64(np.add.reduceat(value, self.word_at) * down[self.word_at])
        total = np.add.reduceat(np.where(self.space, 0, self.x).astype(np.int64), self.word_at)

        opens = np.zeros(n, bool)
        opens[self.first] = True
        size = np.diff(np.append(self.first, n))
        long = np.repeat(size > LONGEST, size)
        mark = opens.copy()
        mark[1:] |= total[:-1] % CUT == 0
        since = np.arange(n) - np.maximum.accumulate(np.where(mark, np.arange(n), 0))
        parts = np.flatnonzero(opens | long & (mark | (since % LONGEST == 0)))
        parts_doc = np.searchsorted(self.bounds, self.word_at[parts], side="right") - 1

        a, b = self._runs(self.first, self.doc, run, words)
        c, d = self._runs(parts, parts_doc, 2, part_words)
        held = long[c]
        both = np.unique(np.concatenate((a, c[held])) * np.int64(n + 1) + np.concatenate((b, d[held])))
        a, b = both // (n + 1), both % (n + 1)
        doc = np.searchsorted(self.bounds, self.word_at[a], side="right") - 1
        sentence = np.searchsorted(self.first, a, side="right") - 1
        last = np.searchsorted(self.first, b - 1, side="right") - 1
        ends = np.concatenate((opens, [True]))[b]
        start = np.where(opens[a], self.start[sentence], self.word_at[a] - self.bounds[doc])
        end = np.where(ends, self.end[last], np.append(self.word_at, 0)[b] - self.bounds[doc])
        return doc, start, end, *(self._hash(word, a, b, base) for base in BASES)

    @staticmethod
    def _hash(word: np.ndarray, a: np.ndarray, b: np.ndarray, base: int) -> np.ndarray:
        up, down = _powers(len(word) + 1, base)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(word + np.uint64(base)) * up[: len(word)], dtype=np.uint64)))
        return mix64((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))

    def _runs(self, first: np.ndarray, doc: np.ndarray, run: int, words: int) -> tuple[np.ndarray, np.ndarray]:
        """The words from and to of the shortest run from each part on (parts begin at first), where its text is long enough for one."""
        edges = np.append(first, len(self.word_at))
        to = np.maximum(np.searchsorted(edges, first + words), np.arange(len(first)) + run)
        fits = np.flatnonzero(to <= np.searchsorted(doc, doc, side="right"))
        return first[fits], edges[to[fits]]


def split(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences that hold a word, in code points."""
    s = Sentences([text])
    return list(zip(s.start.tolist(), s.end.tolist()))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, h (hash of the text): id and hash tell texts apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"))


SPANS = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("place", pa.int64()), ("name", pa.int64()), ("check", pa.int32())])


def _firsts(late: np.ndarray, ids: np.ndarray, h: np.ndarray, place: np.ndarray, name: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of hash and occurrence, each occurrence once, and which of them are not the first under their hash."""
    order = np.argsort(name, kind="stable")
    same = name[order[1:]] == name[order[:-1]]
    again = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    few = order[again]
    few = few[np.lexsort((place[few], h[few], ids[few], late[few], check[few], name[few]))]
    equal = np.zeros((2, len(few)), bool)
    equal[0, 1:] = (name[few[1:]] == name[few[:-1]]) & (check[few[1:]] == check[few[:-1]])
    equal[1, 1:] = equal[0, 1:] & np.logical_and.reduce([v[few[1:]] == v[few[:-1]] for v in (late, ids, h, place)])
    kept = ~equal[1]
    return np.concatenate((order[~again], few[kept])), np.concatenate((np.zeros(int((~again).sum()), bool), equal[0][kept]))


def _spans(batches: Iterator[pa.RecordBatch], rule: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = text_rows(batch)
        late = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        ids, hashes = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("h").to_numpy()
        for x, y in slices(list(map(len, texts)), TOGETHER):
            parts = []
            for i, j in slices(list(map(len, texts[x:y])), AT_ONCE):
                doc, start, end, name, check = Sentences(texts[x + i : x + j]).spans(*rule)
                parts.append((doc + x + i, start << 32 | end, name.view(np.int64), (check >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            doc, place, name, check = map(np.concatenate, zip(*parts))
            if not len(doc):
                continue
            rows, later = _firsts(late[doc], ids[doc], hashes[doc], place, name, check)
            doc = doc[rows]
            # those known to be later are dealt anywhere
            name = np.where(later, mix64((hashes[doc] + place[rows]).view(np.uint64)).view(np.int64), name[rows])
            columns = [pa.array(ids[doc], mask=late[doc]), pa.array(hashes[doc]), pa.array(place[rows]), pa.array(name), pa.array(check[rows], mask=later)]
            yield pa.RecordBatch.from_arrays(columns, schema=SPANS)


def spans(docs: DataFrame, run: int = RUN, words: int = WORDS, part_words: int = PART_WORDS) -> DataFrame:
    """doc_id, h (hash of the text), place (start and end, 32 bits each), name and check (its hash) of every run. check is null, and name any
    number, where another row of the same hash comes before. Null and empty texts have none."""
    return keyed(docs).mapInArrow(partial(_spans, rule=(run, words, part_words)), "doc_id long, h long, place long, name long, check int")


def repeats(own: DataFrame) -> DataFrame:
    """doc_id, h, covered (array of start, end): of the spans own, the non-first repeated ones of each text that has any."""
    # null ids come after all others; the rows under one hash are at most as many as batches
    w = Window.partitionBy("name").orderBy("check", F.col("doc_id").isNull(), "doc_id", "h", "place")
    before = lambda c: F.lag(c).over(w)
    itself = before("doc_id").eqNullSafe(F.col("doc_id")) & (before("h") == F.col("h")) & (before("place") == F.col("place"))
    later = own.withColumn("later", F.col("check").isNull() | ((before("check") == F.col("check")) & ~itself)).where("later")
    return later.groupBy("doc_id", "h").agg(F.collect_set("place").alias("covered"))


def merged(spans_: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, those that touch put together."""
    out: list[list[int]] = []
    for a, b in sorted(spans_):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _rewrite(batch: pa.RecordBatch, rule: tuple[int, int, int]) -> pa.RecordBatch:
    texts, again, covered = text_rows(batch), batch.column("again").to_pylist(), batch.column("covered").to_pylist()
    n, removed, cuts = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [[] for _ in texts]
    for i, j in slices(list(map(len, texts)), AT_ONCE):
        s = Sentences(texts[i:j])
        n[i:j] = np.bincount(s.doc, minlength=j - i)
        edges = np.searchsorted(s.doc, np.arange(j - i + 1))
        if any(again[i:j]):
            doc, start, end, *_ = s.spans(*rule)
        for k in range(i, j):
            if again[k]:
                own = doc == k - i
                cuts[k] = merged(list(zip(start[own].tolist(), end[own].tolist())))
            elif covered[k]:
                cuts[k] = merged([(c >> 32, c & 0xFFFFFFFF) for c in covered[k]])
            if cuts[k]:
                a, b = (np.array(x) for x in zip(*cuts[k]))
                own = slice(edges[k - i], edges[k - i + 1])
                # sentences of which a part goes: the first cut that ends after their start begins before their end
                at = np.searchsorted(b, s.start[own], side="right")
                removed[k] = int((np.append(a, np.iinfo(np.int64).max)[at] < s.end[own]).sum())
    said = []
    for text, old, cut in zip(texts, batch.column("text").to_pylist(), cuts):
        edges = [0, *(x for c in cut for x in c), len(text)]
        said.append("".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])) if cut else old)
    where = [[{"start": a, "end": b} for a, b in cut] for cut in cuts]
    columns = [batch.column("doc_id"), pa.array(said, pa.string()), pa.array(n), pa.array(removed), pa.array(where, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "n_sentences", "n_removed", "removed"])


def remove_repeats(docs: DataFrame, run: int = RUN, words: int = WORDS, part_words: int = PART_WORDS) -> DataFrame:
    """doc_id, text without what repeats, n_sentences, n_removed (sentences that lose a part or go), removed (array of start, end in the old text).

    Every row is a text of its own: texts under one id, or without an id, are told apart by their hash, and of rows equal in
    both one counts as the first and all runs of the others are repeats. A null id stands after all others. Null texts stay
    null. Other columns are ignored; an empty table gives no rows.
    """
    found = repeats(spans(docs, run, words, part_words)).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "covered")
    rows = keyed(docs)
    equal = stored(rows.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")), "equal")
    none = F.expr("cast(null as array<bigint>)")
    same = lambda x: rows.doc_id.eqNullSafe(x._id) & (rows.h == x._h)
    copies = None
    if not equal.isEmpty():
        # written with their numbers, so that the same one is the first wherever they are read
        numbered = stored(rows.join(equal, same(equal), "left_semi").withColumn("number", F.monotonically_increasing_id()), "equal-rows")
        one = stored(numbered.groupBy("doc_id", "h").agg(F.min("number").alias("number")).select(F.col("number").alias("_number")), "equal-first")
        lead = numbered.join(one, numbered.number == one._number, "left_semi").select("doc_id", "text", "h")
        copies = numbered.join(one, numbered.number == one._number, "left_anti").select("doc_id", "text", none.alias("covered"), F.lit(True).alias("again"))
        rows = rows.join(equal, same(equal), "left_anti").select("doc_id", "text", "h").unionAll(lead)
    joined = rows.join(found, same(found), "left").select("doc_id", "text", "covered", F.lit(False).alias("again"))
    out = joined if copies is None else joined.unionAll(copies)
    return map_arrow(out, partial(_rewrite, rule=(run, words, part_words)), "doc_id long, text string, n_sentences long, n_removed long, removed array<struct<start:long,end:long>>")


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
