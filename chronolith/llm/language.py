"""Language identification by nearest centroids of normalised TF-IDF n-gram vectors.

Texts become counts of hashed character bigrams and trigrams of their words. Each language has several centroids,
clustered from a bounded sample of labelled documents; a document's language is that of the centroid with the greatest cosine. How far its
own documents lie from a centroid is measured on documents that took no part in the clustering, whole and cut to several
lengths, as short texts lie farther; a document that lies farther from its centroid than these, for its length, is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import code_points, map_arrow, sample_hash, slices, table, text_rows

#: Sampled documents of a language at most, of all languages at most (each then gets its part), centroids of each, hashed n-grams, code points at a time.
SAMPLE, TOTAL, CENTROIDS, DIM, AT_ONCE = 600, 60_000, 4, 8192, 200_000
#: Every so many of a language's sampled documents measures distances; different n-grams at which lengths are told apart; deviations under the mean cosine
#: from which a document is rejected; least number of measurements that a centroid, or else its language, has of its own.
HELD, LENGTHS, DEVIATIONS, FEWEST = 4, (32, 96, 256, 768), 4.5, 12
#: Share of a language's documents that a centroid stands for at least; smaller groups are stray texts under a wrong label.
STRAY = 0.02
#: Languages up to which their counts are broadcast to the documents; beyond, an ordinary join.
BROADCAST_MOST = 100_000
UNKNOWN = "und"


def _fold() -> np.ndarray:
    """Each code point up to 0x3000 in lower case; 0 for what is no letter."""
    out = np.zeros(0x3000, np.uint32)
    for i in range(0x3000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low[0])
    return out


_FOLD = _fold()


def letters(x: np.ndarray) -> np.ndarray:
    """Code points in lower case, 0 for those that are no letters. Beyond 0x3000, letters as Unicode has them."""
    out = np.where(x < 0x3000, _FOLD[np.minimum(x, 0x2FFF)], x)
    far = np.flatnonzero(x >= 0x3000)
    if len(far):
        known, back = np.unique(x[far], return_inverse=True)
        out[far] = np.where(np.array([chr(c).isalpha() for c in known]), known, 0)[back]
    return out


def vectors(texts: list[str], dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """Counts (texts x dim, float32) of the hashed bigrams and trigrams inside words and at their edges; and the letters of each text."""
    x, bounds = code_points([" " + t + " " for t in texts])
    c = letters(x)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(bounds))
    n_letters = np.bincount(doc, weights=c > 0, minlength=len(texts)).astype(np.int64)
    some = c > 0
    two = np.flatnonzero((some[1:] | some[:-1]) & (doc[1:] == doc[:-1]))
    three = np.flatnonzero(some[1:-1] & (doc[2:] == doc[:-2]))
    m = np.uint32(0x9E3779B1)
    h2 = ((c[two] * np.uint32(31) + c[two + 1]) * m) >> np.uint32(8)
    h3 = (((c[three] * np.uint32(1009) + c[three + 1]) * np.uint32(2003) + c[three + 2]) * m) >> np.uint32(8)
    at = np.concatenate((doc[two] * dim + h2 % dim, doc[three] * dim + h3 % dim))
    return np.bincount(at, minlength=len(texts) * dim).reshape(len(texts), dim).astype(np.float32), n_letters


@dataclass
class Model:
    names: list[str]  # of each centroid's language
    centroids: np.ndarray  # unit rows
    idf: np.ndarray
    reject: np.ndarray  # for each centroid and length: cosines under which a document is none of its language


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(counts) * idf)


def _cluster(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; begins with the vector nearest the mean, then the ones farthest from those taken."""
    centre = [v[int(np.argmax(v @ _unit(v.mean(axis=0, keepdims=True))[0]))]]
    while len(centre) < min(k, len(v)):
        centre.append(v[int(np.argmin(np.max(v @ np.array(centre).T, axis=1)))])
    c = np.array(centre)
    for _ in range(rounds):
        own = np.argmax(v @ c.T, axis=1)
        c = _unit(np.array([v[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))]))
    share = np.bincount(np.argmax(v @ c.T, axis=1), minlength=len(c)) / len(v)
    return c[share >= min(STRAY, share.max())]


def _counted(texts: list[str], dim: int) -> tuple[np.ndarray, np.ndarray]:
    found = [vectors(texts[a:b], dim) for a, b in slices(list(map(len, texts)), AT_ONCE)]
    return (np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])) if found else (np.zeros((0, dim), np.float32), np.zeros(0, np.int64))


def length_of(counts: np.ndarray) -> np.ndarray:
    """The length of texts, by their different n-grams, so that a word said over and over is a short text."""
    return np.searchsorted(LENGTHS, np.count_nonzero(counts, axis=1), side="right")


def fit(texts: list[str], langs: list[str], k: int = CENTROIDS, dim: int = DIM) -> Model:
    seen: dict[str, int] = {}
    held = []
    for name in langs:
        seen[name] = seen.get(name, 0) + 1
        held.append(seen[name] % HELD == 0)
    counts, n_letters = _counted([t for t, h in zip(texts, held) if not h], dim)
    kept = n_letters > 0
    if not kept.any():
        return Model([], np.zeros((0, dim), np.float32), np.ones(dim, np.float32), np.zeros((0, len(LENGTHS) + 1)))
    counts, own = counts[kept], np.array([x for x, h in zip(langs, held) if not h])[kept]
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    v = weigh(counts, idf)
    names, centroids = [], []
    for name in sorted(set(own.tolist())):
        found = _cluster(v[own == name], k)
        names += [name] * len(found)
        centroids.append(found)
    centroids = np.concatenate(centroids)
    del counts, v
    return Model(names, centroids, idf, _distances(names, centroids, idf, [(t, x) for t, x, h in zip(texts, langs, held) if h]))


def _distances(names: list[str], centroids: np.ndarray, idf: np.ndarray, held: list[tuple[str, str]]) -> np.ndarray:
    """Mean less DEVIATIONS deviations of the cosines that held-out texts, and their beginnings of several lengths, have with the nearest centroid of
    their language; where a centroid has few of a length its language's stand for them, then those of all, then none are rejected."""
    known, top, at, size = np.array(names), [], [], []
    cut = [(t[:n], x) for t, x in held for n in (*[m // 3 for m in LENGTHS], len(t))]
    for a, b in slices([len(t) for t, _ in cut], AT_ONCE):
        for i in range(a, b, 128):
            part = cut[i : min(b, i + 128)]
            counts, n_letters = vectors([t for t, _ in part], len(idf))
            cosine = weigh(counts, idf) @ centroids.T
            cosine[np.array([x for _, x in part])[:, None] != known[None]] = -1
            best = np.argmax(cosine, axis=1)
            fits = (n_letters > 0) & (cosine[np.arange(len(part)), best] >= 0)
            top += cosine[np.arange(len(part)), best][fits].tolist()
            at += best[fits].tolist()
            size += length_of(counts[fits]).tolist()
    top, at, size = np.array(top), np.array(at, int), np.array(size, int)
    out = np.zeros((len(names), len(LENGTHS) + 1))
    for c in range(len(names)):
        for n in range(len(LENGTHS) + 1):
            for pool in (at == c, known[at] == known[c], np.ones(len(at), bool)):
                x = top[pool & (size == n)]
                if len(x) >= FEWEST:
                    out[c, n] = max(0.0, x.mean() - DEVIATIONS * x.std())
                    break
    return out


def train(docs: DataFrame, where=None, most: int = SAMPLE, total: int = TOTAL) -> Model:
    """A model of documents with text and lang, of those that `where` admits: of each language the `most` of the least hashes,
    in expectation, fewer where all languages would have more than `total`."""
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and doc_id is not null")
    if where is not None:
        rows = rows.where(where)
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    n = counts.count()
    each = min(most, total / max(1, n))
    # one number for each language
    counts = F.broadcast(counts) if n <= BROADCAST_MOST else counts
    drawn = rows.where(F.col("text").isNotNull()).join(counts, "lang").where(sample_hash("doc_id", 8) < each / F.col("n")).select("doc_id", "lang", "text").collect()
    found = sorted(drawn, key=lambda r: (r.doc_id, r.lang, r.text))
    return fit([r.text for r in found], [r.lang for r in found])


def _predict(batch: pa.RecordBatch, model: Model) -> pa.RecordBatch:
    texts, names, scores, out = text_rows(batch), [], [], []
    for a, b in slices(list(map(len, texts)), AT_ONCE):
        for at in range(a, b, 128):
            counts, n_letters = vectors(texts[at : min(b, at + 128)], len(model.idf))
            if len(model.names):
                cosine = weigh(counts, model.idf) @ model.centroids.T
                best = np.argmax(cosine, axis=1)
                top = np.where(n_letters > 0, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0)
            else:
                best, top = np.zeros(len(counts), int), np.zeros(len(counts))
            known = (n_letters > 0) & bool(model.names)
            names += [model.names[i] if y else UNKNOWN for i, y in zip(best.tolist(), known.tolist())]
            scores += top.tolist()
            limit = model.reject[best, length_of(counts)] if len(model.names) else 0.0
            out += (~known | (top <= limit)).tolist()
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (greatest cosine), rejected of every document.

    A null text, or one without a letter, is `und`, with score 0, and rejected, as is every text when the model learnt nothing. Ties go to
    the first language by name. Rows that repeat, and null ids, give a row each; an empty table gives no rows.
    """
    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), partial(_predict, model=model), "doc_id long, lang_pred string, score double, rejected boolean")


def fold(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs, fold(4) != 2))
    return found.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def _with_verdict(batch: pa.RecordBatch, model: Model) -> pa.RecordBatch:
    rejected = _predict(batch, model).column("rejected")
    return batch.filter(pc.invert(rejected))


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, whole rows with all their columns, that the model does not reject: null and empty texts go, rows that repeat stay
    or go alike, an empty table stays empty."""
    return map_arrow(docs, partial(_with_verdict, model=model), docs.schema)
