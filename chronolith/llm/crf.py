"""Quality by line sequence labelling: a linear-chain conditional random field marks each line content or boilerplate.

The field is trained here, on a bounded sample of labelled documents (every line of a good document is content, every line
of a bad one boilerplate), by its exact likelihood. Viterbi decoding labels the lines of a document together; the
share of characters in content lines decides whether the document stays.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import code_points, map_arrow, mix64, sample_hash, slices, table, text_rows
from chronolith.llm.lcp import _powers

#: Labelled documents that a model is fitted on at most; least content share of a kept document; code points at a time.
SAMPLE, SHARE, AT_ONCE = 2000, 0.5, 200_000
#: Base rules: fewest words, and largest percentage of words in repeated windows.
FEWEST, REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"
SPACE, SYMBOL, UPPER, LETTER, DIGIT, STOP, MARK = 1, 2, 4, 8, 16, 32, 64
FEATURES = ("one", "letters", "upper", "digits", "symbols", "marks", "stop", "repeated", "again", "empty", "short", "long", "wordy", "first", "last")


def _classes() -> np.ndarray:
    """What each code point up to 0x3000 is, as bits; those beyond count as letters."""
    out = np.zeros(0x3001, np.uint8)
    for i in range(0x3000):
        c = chr(i)
        out[i] = (c in " \t\n\r\x0b\x0c") * SPACE | (c in SYMBOLS) * SYMBOL | c.isupper() * UPPER | c.isalpha() * LETTER | c.isdigit() * DIGIT | (c in ".!?,;:") * STOP | (c in "!?") * MARK
    out[0x3000] = LETTER
    return out


_CLASS = _classes()


def _runs(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values from each start to the next; starts ascend, and values is not empty."""
    return np.add.reduceat(values, starts, dtype=np.int64)


class Lines:
    """Counts and features of the lines of several texts in a row. Every text has at least one line, which may be empty."""

    def __init__(self, texts: list[str]):
        # a line feed after every text ends its last line
        x, bounds = code_points([t + "\n" for t in texts])
        kind = _CLASS[np.minimum(x, 0x3000)]
        space = (kind & SPACE) != 0
        ends = np.flatnonzero(x == 10)
        self.starts = np.concatenate(([0], ends[:-1] + 1))
        self.size = ends - self.starts
        self.doc = np.searchsorted(bounds, self.starts, side="right") - 1
        self.firsts = np.searchsorted(self.starts, bounds[:-1])
        n, n_lines, n_docs = len(x), len(ends), len(texts)

        begin = ~space
        begin[1:] &= space[:-1]
        word_at = np.flatnonzero(begin)
        word_line = np.searchsorted(self.starts, word_at, side="right") - 1
        word_doc = self.doc[word_line]
        line = lambda mask: _runs(mask, self.starts)
        self.words = np.bincount(word_line, minlength=n_lines)
        self.n_words = np.bincount(word_doc, minlength=n_docs)
        inside = line(~space)
        symbols = line((kind & SYMBOL) != 0)
        per_doc = lambda v: np.bincount(self.doc, weights=v, minlength=n_docs).astype(np.int64)
        self.word_chars, self.n_symbols = per_doc(inside), per_doc(symbols)

        up, down = _powers(n)
        value = (x.astype(np.uint64) + np.uint64(1)) * up[:n]
        line_hash = mix64(np.add.reduceat(value, self.starts) * down[self.starts] + self.size.astype(np.uint64))
        has_word = self.words > 0
        key = mix64(line_hash ^ mix64(self.doc.astype(np.uint64) + np.uint64(1)))
        key[~has_word] = mix64(np.arange(n_lines, dtype=np.uint64))[~has_word]
        order = np.argsort(key, kind="stable")
        again = np.zeros(n_lines, bool)
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        again &= has_word
        self.n_dup_lines = per_doc(again)

        value[space] = 0
        repeated = np.zeros(len(word_at), bool)
        if len(word_at) > 2:
            h = mix64(np.add.reduceat(value, word_at) * down[word_at])
            windows = mix64(h[:-2] * np.uint64(3) + mix64(h[1:-1]) * np.uint64(5) + mix64(h[2:] + np.uint64(9)))
            windows = mix64(windows ^ mix64(word_doc[:-2].astype(np.uint64) + np.uint64(1)))
            fits = np.flatnonzero(word_doc[:-2] == word_doc[2:])
            windows = windows[fits]
            order = np.argsort(windows)
            same = windows[order[1:]] == windows[order[:-1]]
            twice = np.zeros(len(fits), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            at = fits[twice]
            repeated[at] = repeated[at + 1] = repeated[at + 2] = True
        self.n_repeat_words = np.bincount(word_doc[repeated], minlength=n_docs)

        letters = line((kind & LETTER) != 0)
        some, chars = np.maximum(self.words, 1), np.maximum(inside, 1)
        final = np.zeros(n_lines, bool)
        final[self.size > 0] = (kind[ends[self.size > 0] - 1] & STOP) != 0
        first = np.zeros(n_lines, bool)
        first[self.firsts] = True
        last = np.zeros(n_lines, bool)
        last[np.append(self.firsts[1:], n_lines) - 1] = True
        self.inside = inside
        self.x = np.stack([np.ones(n_lines), letters / chars, line((kind & UPPER) != 0) / np.maximum(letters, 1), line((kind & DIGIT) != 0) / chars, np.minimum(1, symbols / some), np.minimum(1, line((kind & MARK) != 0) / some), final, np.bincount(word_line[repeated], minlength=n_lines) / some, again, self.words == 0, (self.words > 0) & (self.words < 4), self.words > 60, np.minimum(1, inside / some / 20), first, last], axis=1)


def _steps(firsts: np.ndarray, n: int):
    """For each place in a document, the rows at that place and the ordinals of their documents, longest documents first."""
    size = np.diff(np.append(firsts, n))
    order = np.argsort(-size, kind="stable")
    start, length = firsts[order], size[order]
    for t in range(int(length[0]) if len(length) else 0):
        m = int(np.searchsorted(-length, -t, side="left"))
        yield t, start[:m] + t, m


def viterbi(x: np.ndarray, firsts: np.ndarray, weights: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best labels (1: content) of the rows of x, whose documents begin at firsts; ties go to content."""
    e = np.stack([np.zeros(len(x)), x @ weights], axis=1)
    back = np.zeros((len(x), 2), np.int8)
    best = np.zeros((len(firsts), 2))
    steps = list(_steps(firsts, len(x)))
    for t, rows, m in steps:
        if t == 0:
            best = e[rows].copy()
            continue
        through = best[:m, :, None] + moves[None]
        came = (through[:, 1] >= through[:, 0]).astype(np.int8)
        back[rows] = came
        best[:m] = np.maximum(through[:, 0], through[:, 1]) + e[rows]
    out = np.zeros(len(x), np.int8)
    now = (best[:, 1] >= best[:, 0]).astype(np.int8)
    for t, rows, m in reversed(steps):
        out[rows] = now[:m]
        now[:m] = back[rows, now[:m]]
    return out


def fit(texts: list[str], good: list[int], rounds: int = 120, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and moves of the field, by gradient ascent on its likelihood with forward and backward sums. Classes weigh alike."""
    parts, firsts, doc, n = [], [], [], 0
    for i, j in slices(list(map(len, texts)), AT_ONCE):
        lines = Lines(texts[i:j])
        parts.append(lines.x)
        firsts.append(lines.firsts + n)
        doc.append(lines.doc + i)
        n += len(lines.x)
    x, firsts, y = np.concatenate(parts), np.concatenate(firsts), np.array(good)[np.concatenate(doc)]
    share = np.clip(np.bincount(np.array(good), minlength=2) / max(1, len(good)), 1e-3, 1)
    worth = (0.5 / share)[np.array(good)]
    w, moves = np.zeros(x.shape[1]), np.zeros((2, 2))
    steps = list(_steps(firsts, len(x)))
    order = np.argsort(-np.diff(np.append(firsts, len(x))), kind="stable")
    worth = worth[order]
    mean, square = [np.zeros_like(w), np.zeros_like(moves)], [np.zeros_like(w), np.zeros_like(moves)]
    for turn in range(1, rounds + 1):
        e = np.stack([np.zeros(len(x)), x @ w], axis=1)
        a, b = np.zeros((len(x), 2)), np.zeros((len(x), 2))
        for t, rows, m in steps:
            a[rows] = e[rows] + (np.logaddexp(a[rows - 1, :1] + moves[:1], a[rows - 1, 1:] + moves[1:]) if t else 0)
        for t, rows, _ in reversed(steps[1:]):
            into = e[rows] + b[rows]
            b[rows - 1] = np.logaddexp(moves[None, :, 0] + into[:, :1], moves[None, :, 1] + into[:, 1:])
        z = np.logaddexp.reduce(a + b, axis=1)
        per_line = np.empty(len(x))
        for _, rows, m in steps:
            per_line[rows] = worth[:m]
        p = np.exp(a[:, 1] + b[:, 1] - z)
        gw = (per_line * (y - p)) @ x - penalty * len(x) * w
        gm = np.zeros((2, 2))
        for t, rows, m in steps[1:]:
            joint = np.exp(a[rows - 1][:, :, None] + moves[None] + (e + b)[rows][:, None, :] - z[rows][:, None, None])
            seen = np.zeros((m, 2, 2))
            seen[np.arange(m), y[rows - 1], y[rows]] = 1
            gm += ((seen - joint) * worth[:m, None, None]).sum(axis=0)
        gm -= penalty * len(x) * moves
        for k, (p_, g) in enumerate(((w, gw / len(x)), (moves, gm / len(x)))):
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            p_ += 0.15 * (mean[k] / (1 - 0.9**turn)) / (np.sqrt(square[k] / (1 - 0.99**turn)) + 1e-9)
    return w, moves


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, seed: int = 7) -> list[tuple[str, int]]:
    """(text, label) of at most `most` documents of each label 0 and 1, those of the least hashes; only ids are joined at
    large, and only the sample's texts are read out."""
    rows = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    rows = rows.withColumn("r", sample_hash("id", seed))
    ids = [x for y in (0, 1) for x in rows.where(F.col("y") == y).orderBy("r", "id").limit(most).collect()]
    if not ids:
        return []
    chosen = docs.sparkSession.createDataFrame([(x.id, x.y) for x in ids], "id long, y int")
    found = docs.join(F.broadcast(chosen), docs.doc_id == chosen.id).select(docs.doc_id, F.coalesce(docs.text, F.lit("")).alias("text"), "y")
    # of texts under one id the least, so that every run learns from the same ones
    one = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    return [(x.text, x.y) for x in sorted(one.collect(), key=lambda x: x.doc_id)]


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """A model from labels.quality, over at most `most` documents of either label. Without both labels everything is content."""
    rows = labelled_sample(docs, labels, "quality", most)
    if len({y for _, y in rows}) < 2:
        return np.zeros(len(FEATURES)), np.zeros((2, 2))
    return fit(*map(list, zip(*rows)))


def _label(batch: pa.RecordBatch, model: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    texts, ids, out = text_rows(batch), batch.column("doc_id").to_pylist(), ([], [], [], [])
    for a, b in slices(list(map(len, texts)), AT_ONCE):
        lines = Lines(texts[a:b])
        found = viterbi(lines.x, lines.firsts, *model)
        for column, v in zip(out, ([ids[a + d] for d in lines.doc], (np.arange(len(found)) - lines.firsts[lines.doc]).tolist(), lines.size.tolist(), (found == 1).tolist())):
            column += v
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.bool_())], names=["doc_id", "line", "n_chars", "content"])


def line_labels(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, line (from 0), n_chars, content of every line; an empty or null text has one empty line."""
    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), partial(_label, model=model), "doc_id long, line long, n_chars long, content boolean")


RULED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def _rule(batch: pa.RecordBatch, model: tuple[np.ndarray, np.ndarray], share: float) -> pa.RecordBatch:
    texts, parts = text_rows(batch), []
    for a, b in slices(list(map(len, texts)), AT_ONCE):
        lines = Lines(texts[a:b])
        found = viterbi(lines.x, lines.firsts, *model)
        total = np.bincount(lines.doc, weights=lines.inside, minlength=b - a)
        content = np.bincount(lines.doc, weights=lines.inside * (found == 1), minlength=b - a) / np.maximum(total, 1)
        failed = (lines.n_words < FEWEST) | (100 * lines.n_repeat_words > REPEATED * lines.n_words)
        parts.append((lines.n_words, lines.word_chars, lines.n_symbols, lines.n_dup_lines, lines.n_repeat_words, failed, ~failed & (content >= share), content))
    columns = [pa.array(np.concatenate(x)) for x in zip(*parts)]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=[c.split()[0] for c in RULED.split(", ")])


def rule(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], share: float = SHARE) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and content_share of every document.

    Null texts count as empty: no words, so the base fails. Rows that repeat, and null ids, give a row each; other columns
    are ignored; an empty table gives no rows.
    """
    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), partial(_rule, model=model, share=share), RULED)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rule(docs, train(docs, table(spark, sf_dir, "labels")))
