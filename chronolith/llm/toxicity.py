"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words counts the runs of four letters that both hold as subsequences of at most WINDOW letters, each weighted by DECAY
to the power of its gaps, over the words' norms, so that inserted letters and gaps weaken a match and do not break it; the ends of a
word count as letters. The kernel of two sentences adds up that of their words. Landmarks are words of the labelled sentences; the
Nyström map of a sentence is its kernel values with them, whitened, and a linear support vector machine on that map is trained on
sentences, each labelled as its document is. The machine's decision is linear in the subsequences, so a table of weights scores whole
corpora: a document by the evidence of its sentences, on a curve fitted on the labelled documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import code_points, map_arrow, mix64, slices, table, text_rows
from chronolith.llm.crf import labelled_sample
from chronolith.llm.language import letters
from chronolith.llm.lcp import _powers

#: Labelled documents of either label at most, landmarks, sentences of either label in a round of training, rounds, code points at a time.
SAMPLE, LANDMARKS, SENTENCES, ROUNDS, AT_ONCE = 2000, 256, 5000, 8, 200_000
#: Letters a subsequence may span, its decay by each gap, buckets of the table of subsequences.
WINDOW, DECAY, BUCKETS = 6, 0.6, 1 << 20
STEPS = [(i, j, k, DECAY ** (k - 3)) for i, j, k in combinations(range(1, WINDOW), 3)]
#: What stands for the begin and the end of a word, which no letter is.
BEGIN, FINISH = 2, 3
#: Decisions over which a sentence is evidence; the machine's margin lies between the two.
LEVELS = (-1.0, 0.0)
SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n")
#: What an example's loss weighs on average against the machine's norm.
COST = 0.15
#: What a clean document taken for a toxic one weighs against the reverse.
CLEAN = 1.5


class Words:
    """The words of several texts in a row, as lower-case letters of any script: marks inside a word are dropped, words of single letters
    that follow each other are one word, and a letter stands at most twice in a row. doc: each word's text."""

    def __init__(self, texts: list[str]):
        x, bounds = code_points([t + "\n" for t in texts])
        low = letters(x)
        at = np.flatnonzero(low)
        gap = np.cumsum((x == 32) | ((x >= 9) & (x <= 13)))[at]
        doc = np.searchsorted(bounds, at, side="right") - 1
        low = low[at]
        if len(low) > 2:
            same = (low[1:] == low[:-1]) & (gap[1:] == gap[:-1])
            kept = np.concatenate(([True, True], ~(same[1:] & same[:-1])))
            low, gap, doc = low[kept], gap[kept], doc[kept]
        new = np.ones(len(low), bool)
        if len(low) > 1:
            new[1:] = gap[1:] != gap[:-1]
            first = np.flatnonzero(new)
            single = np.diff(np.append(first, len(low))) == 1
            merge = single[1:] & single[:-1] & (gap[first[1:]] - gap[first[:-1]] == 1) & (doc[first[1:]] == doc[first[:-1]])
            new[first[1:][merge]] = False
        self.letters, self.starts = low, np.flatnonzero(new)
        self.sizes = np.diff(np.append(self.starts, len(low)))
        self.doc = doc[self.starts] if len(self.starts) else np.zeros(0, np.int64)

    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        up, down = _powers(len(self.letters))
        return mix64(np.add.reduceat(self.letters.astype(np.uint64) * up[: len(self.letters)], self.starts) * down[self.starts] + self.sizes.astype(np.uint64))

    def text(self, i: int) -> np.ndarray:
        return self.letters[self.starts[i] : self.starts[i] + self.sizes[i]]


def framed(low: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with a begin before and two ends behind each; where they start, and how many symbols are left at each place."""
    full = sizes + 3
    at = np.concatenate(([0], np.cumsum(full)[:-1])).astype(np.int64)
    out = np.full(int(full.sum()) + WINDOW, FINISH, np.uint32)
    out[at] = BEGIN
    inside = np.repeat(at + 1 - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(int(sizes.sum()))
    out[inside] = low
    return out, at, np.repeat(at + full, full) - np.arange(int(full.sum()))


def buckets(x: np.ndarray, n: int):
    """bucket, weight and last offset of the subsequences that begin at each of the first n places."""
    m = np.uint32(0x9E3779B1)
    first = x[:n] * m
    for i, j, k, weight in STEPS:
        h = ((first + x[i : n + i]) * m + x[j : n + j]) * m + x[k : n + k]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        yield (h >> np.uint32(12)).astype(np.int32), weight, k


def norms(sizes: np.ndarray) -> np.ndarray:
    """The norm of a word of that many letters whose subsequences are all different."""
    return np.sqrt(sum(np.maximum(sizes + 3 - k, 0) * w * w for *_, k, w in STEPS) + 1e-9).astype(np.float32)


def word_values(low: np.ndarray, starts: np.ndarray, sizes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each word, the sum of weight over its subsequences, over its norm."""
    if not len(starts):
        return np.zeros(0, np.float32)
    x, at, left = framed(low, starts, sizes)
    total = np.zeros(len(left), np.float32)
    for bucket, worth, k in buckets(x, len(left)):
        value = weight[bucket] * np.float32(worth)
        value[left <= k] = 0
        total += value
    return np.add.reduceat(total, at) / norms(sizes)


def sparse(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word, bucket, value of the words' normalised vectors, in order of the words."""
    sizes = np.array([len(w) for w in words], np.int64)
    x, _, left = framed(np.concatenate(words), np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    who = np.repeat(np.arange(len(words)), sizes + 3)
    keys, worth = [], []
    for bucket, w, k in buckets(x, len(left)):
        fits = np.flatnonzero(left > k)
        keys.append(who[fits] * BUCKETS + bucket[fits])
        worth.append(np.full(len(fits), w))
    known, back = np.unique(np.concatenate(keys), return_inverse=True)
    value, word = np.bincount(back, weights=np.concatenate(worth), minlength=len(known)), known // BUCKETS
    return word, known % BUCKETS, value / norms(sizes)[word]


class Landmarks:
    """Words, the whitening of their kernel, and their vectors over the buckets that any of them holds."""

    def __init__(self, words: list[np.ndarray]):
        word, bucket, value = sparse(words)
        self.known, column = np.unique(bucket, return_inverse=True)
        self.rows = np.zeros((len(self.known), len(words)), np.float32)
        self.rows[column, word] = value
        self.place = np.full(BUCKETS, -1, np.int32)
        self.place[self.known] = np.arange(len(self.known))
        lengths, vectors = np.linalg.eigh((self.rows.T @ self.rows).astype(float))
        self.white = vectors * (1 / np.sqrt(np.maximum(lengths, 1e-3)))

    def map(self, words: list[np.ndarray], at_once: int = 100) -> np.ndarray:
        """The Nyström map of each word: its kernel with each landmark, whitened."""
        out = np.zeros((len(words), self.rows.shape[1]), np.float32)
        for i in range(0, len(words), at_once):
            word, bucket, value = sparse(words[i : i + at_once])
            at = self.place[bucket]
            held = np.flatnonzero(at >= 0)
            word, at, value = word[held], at[held], value[held]
            if len(word):
                first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
                out[i + word[first]] = np.add.reduceat(self.rows[at] * value[:, None].astype(np.float32), first, axis=0)
        return out @ self.white.astype(np.float32)

    def weights(self, v: np.ndarray) -> np.ndarray:
        """The table of bucket weights of a machine on the map."""
        out = np.zeros(BUCKETS, np.float32)
        out[self.known] = self.rows @ (self.white @ v)
        return out


def _svm(z: np.ndarray, y: np.ndarray, cost: float, rounds: int = 30) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton's steps on the examples inside the margin. Losses weigh cost in sum, either class the half."""
    x = np.concatenate([z, np.ones((len(z), 1), z.dtype)], axis=1)
    worth = cost * np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    ridge = np.diag(np.append(np.ones(z.shape[1]), 1e-6))
    w, inside = np.zeros(x.shape[1]), np.ones(len(x), bool)
    for _ in range(rounds):
        own, pull = x[inside], worth[inside]
        w = np.linalg.solve(ridge + own.T @ (own * pull[:, None]), own.T @ (pull * y[inside]))
        before, inside = inside, y * (x @ w) < 1
        if (before == inside).all():
            break
    return w[:-1], float(w[-1])


@dataclass
class Model:
    weight: np.ndarray  # of each bucket
    bias: float
    curve: np.ndarray  # from a text's evidence to its score's logit


EMPTY = Model(np.zeros(BUCKETS, np.float32), 0.0, np.array([0.0] * (len(LEVELS) + 2) + [-30.0]))


class Vocabulary:
    """The different words of sentences, and in how many contexts (with the words before and after) toxic sentences alone, and clean ones,
    have each: near copies of a sentence share most contexts and so tell little more than one of them. Gathered a few sentences at a time."""

    def __init__(self, sentences: list[str], toxic: np.ndarray):
        parts, seen = [], []
        for a, b in slices(list(map(len, sentences)), AT_ONCE):
            w = Words(sentences[a:b])
            h = w.hashes()
            same = np.zeros(len(h) + 1, bool)
            same[1:-1] = w.doc[1:] == w.doc[:-1]
            before, after = np.where(same[:-1], np.roll(h, 1), np.uint64(0)), np.where(same[1:], np.roll(h, -1), np.uint64(0))
            seen.append((mix64(h + mix64(before * np.uint64(3) + np.uint64(1)) + mix64(after * np.uint64(5) + np.uint64(2))), h, toxic[a + w.doc]))
            known, first = np.unique(h, return_index=True)
            parts.append((known, w.sizes[first], b"".join(w.text(i).tobytes() for i in first)))
        known, sizes = (np.concatenate(x) for x in list(zip(*parts))[:2]) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        letters = np.frombuffer(b"".join(p[2] for p in parts), np.uint32)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        known, first = np.unique(known, return_index=True)
        context, word, bad = (np.concatenate(x) for x in zip(*seen))
        _, at, which = np.unique(context, return_index=True, return_inverse=True)
        clean = np.bincount(which, weights=1 - bad) > 0
        word = np.searchsorted(known, word[at])
        self.known = known
        self.bad, self.good = (np.bincount(word, weights=v, minlength=len(known)) for v in (~clean, clean))
        self.sizes = sizes[first]
        self.letters = letters[np.repeat(starts[first] - np.concatenate(([0], np.cumsum(self.sizes)[:-1])), self.sizes) + np.arange(self.sizes.sum())]
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1])).astype(np.int64)

    def text(self, i: int) -> np.ndarray:
        return self.letters[self.starts[i] : self.starts[i] + self.sizes[i]]


class Told:
    """The words of sentences, by their places in a vocabulary."""

    def __init__(self, sentences: list[str], words: Vocabulary):
        parts = [np.zeros((2, 0), np.int64)]
        for a, b in slices(list(map(len, sentences)), AT_ONCE):
            w = Words(sentences[a:b])
            parts.append(np.stack([a + w.doc, np.searchsorted(words.known, w.hashes())]))
        self.sentence, self.word = np.concatenate(parts, axis=1)
        self.starts = np.searchsorted(self.sentence, np.arange(len(sentences) + 1))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Of each sentence, its words' values added up."""
        return np.bincount(self.sentence, weights=values[self.word], minlength=len(self.starts) - 1)

    def words(self, sentences: np.ndarray) -> np.ndarray:
        """The words of some sentences."""
        return np.concatenate([np.zeros(0, np.int64), *(self.word[self.starts[s] : self.starts[s + 1]] for s in sentences.tolist())])

    def rows(self, sentences: np.ndarray, values: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of some sentences, their words' vectors (at the words' places in values) added up."""
        out = np.zeros((len(sentences), values.shape[1]))
        for i, s in enumerate(sentences.tolist()):
            out[i] = values[place[self.word[self.starts[s] : self.starts[s + 1]]]].sum(axis=0)
        return out


def parts_of(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The sentences of the texts, and the text of each."""
    found = [SENTENCE_END.split(t) for t in texts]
    return [s for x in found for s in x], np.repeat(np.arange(len(texts)), [len(x) for x in found])


def decisions(sentences: list[str], weight: np.ndarray, bias: float) -> np.ndarray:
    """The machine's decision for each sentence, w.x + b: its words' values, added up, and the bias."""
    out = []
    for a, b in slices(list(map(len, sentences)), AT_ONCE):
        w = Words(sentences[a:b])
        out.append(np.bincount(w.doc, weights=word_values(w.letters, w.starts, w.sizes, weight), minlength=b - a) + bias)
    return np.concatenate(out) if out else np.zeros(0)


def evidence(texts: list[str], weight: np.ndarray, bias: float) -> np.ndarray:
    """Of each text, from its sentences' decisions: how far they lie over each of LEVELS, added up; the greatest decision; the number of
    sentences; 1. Sums and number are logarithms. A text without a sentence is one of the sentence without a word."""
    out = np.zeros((len(texts), len(LEVELS) + 3))
    out[:, -1] = 1
    for a, b in slices(list(map(len, texts)), AT_ONCE):
        said, owner = parts_of(texts[a:b])
        f = decisions(said, weight, bias)
        for k, level in enumerate(LEVELS):
            out[a:b, k] = np.log1p(np.bincount(owner, weights=np.maximum(f - level, 0), minlength=b - a))
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        out[a:b, -3] = np.maximum.reduceat(f, first)
        out[a:b, -2] = np.log1p(np.bincount(owner, minlength=b - a))
    return out


def fit(texts: list[str], toxic: list[int], seed: int = 3) -> Model:
    """A model of the labelled texts; EMPTY unless both labels occur."""
    docs = np.array(toxic)
    if len(set(docs.tolist())) < 2:
        return EMPTY
    rng = np.random.default_rng(seed)
    # each sentence once, so that copies tell no more than one text; clean if any clean document has it
    label: dict[str, int] = {}
    said, owner = parts_of(texts)
    for sentence, bad in zip(said, docs[owner].tolist()):
        label[sentence] = min(bad, label.get(sentence, 1))
    all_said, said, y = said, list(label), np.array(list(label.values()))
    order = {s: i for i, s in enumerate(said)}
    words = Vocabulary(said, y)
    if not len(words.sizes) or not y.any():
        return EMPTY
    # landmarks: the words that tell the labels apart best, and the commonest
    bad, good = words.bad, words.good
    share = bad.sum() / max(1.0, (bad + good).sum())
    tells = bad * np.log(np.maximum(bad, 1e-9) / ((bad + good) * share)) + good * np.log(np.maximum(good, 1e-9) / ((bad + good) * (1 - share)))
    tells = np.where(bad * (1 - share) > good * share, tells, -1)
    first = np.argsort(-tells, kind="stable")[: LANDMARKS // 2]
    common = np.argsort(-(bad + good), kind="stable")
    landmarks = np.unique(np.concatenate((first, common[: LANDMARKS // 2])))
    told = Told(said, words)
    clean_at = rng.permutation(np.flatnonzero(y == 0))
    # a toxic document need not be toxic in every sentence: after the first round those count that decide for it
    of_toxic = docs[owner] == 1
    bags = np.unique(np.stack([owner[of_toxic], [order[s] for s, t in zip(all_said, of_toxic.tolist()) if t]]), axis=1)
    bags = bags[:, y[bags[1]] == 1]
    chosen = {1: rng.permutation(np.flatnonzero(y == 1))[:SENTENCES], 0: clean_at[: SENTENCES // 2]}
    for turn in range(ROUNDS):
        if turn:
            value = word_values(words.letters, words.starts, words.sizes, marks.weights(v))
            f = told.sums(value) + bias
            chosen[0] = np.unique(np.concatenate((clean_at[: SENTENCES // 4], clean_at[np.argsort(-f[clean_at], kind="stable")[: SENTENCES // 2]])))
            best = np.lexsort((-f[bags[1]], bags[0]))
            first = best[np.flatnonzero(np.diff(bags[0][best], prepend=-1))]
            chosen[1] = np.unique(np.concatenate((bags[1][first], bags[1][f[bags[1]] >= 1])))[:SENTENCES]
        if turn < 2:
            if turn:  # as further landmarks, the clean words that look most toxic
                hard = np.argsort(-np.where(bad * (1 - share) < good * share, value, -np.inf), kind="stable")[: LANDMARKS // 4]
                landmarks = np.unique(np.concatenate((landmarks, hard)))
            marks = Landmarks([words.text(i) for i in landmarks.tolist()])
            by_word, place = np.zeros((0, len(landmarks)), np.float32), np.full(len(words.sizes), -1)
        at = np.concatenate((chosen[1], chosen[0]))
        # a word is mapped once, as long as the landmarks stay
        new = np.unique(told.words(at))
        new = new[place[new] < 0]
        place[new] = np.arange(len(by_word), len(by_word) + len(new))
        by_word = np.concatenate((by_word, marks.map([words.text(i) for i in new.tolist()])))
        v, bias = _svm(told.rows(at, by_word, place), np.where(y[at] == 1, 1.0, -1.0), COST * len(at))
    weight, bias = marks.weights(v), float(bias)
    curve = _curve(evidence(texts, weight, bias), docs)
    return Model(weight, bias, curve)


def _curve(x: np.ndarray, y: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Logistic regression by Newton's steps; clean documents weigh CLEAN times as much as toxic ones, in sum."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    x, w = x / scale, np.zeros(x.shape[1])
    worth = np.where(y == 1, len(y) / max(1, y.sum()), CLEAN * len(y) / max(1, (1 - y).sum())) / (1 + CLEAN)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (worth * (p - y)) + 1e-3 * w
        bend = (x * (worth * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w = w - np.linalg.solve(bend, slope)
    return w / scale


def train(docs: DataFrame, labels: DataFrame, where=None, most: int = SAMPLE) -> Model:
    """A model of labels.toxic over at most `most` documents of either label, of those that `where` admits (on doc_id)."""
    rows = labelled_sample(docs, labels if where is None else labels.where(where), "toxic", most)
    return fit(*map(list, zip(*rows))) if rows else EMPTY


def scores(texts: list[str], model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(evidence(texts, model.weight, model.bias) @ model.curve, -30, 30)))


def _score(batch: pa.RecordBatch, model: Model) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(text_rows(batch), model), pa.float64())], names=["doc_id", "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) of every document, whole texts: the curve's value for its sentences.

    Null and empty texts score as a text of one sentence without a word. Rows that repeat, and null ids, give a row each; without
    labels of both kinds every score is 0 (but for 1e-13); an empty table gives no rows.
    """
    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), partial(_score, model=model), "doc_id long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    found = score(docs, train(docs, table(spark, sf_dir, "labels"), fold != 0))
    return found.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
