"""Every operator against a brute-force version, a round trip or held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chronolith.llm import chat, components, crf, language, lcp, mixing, packing, pii, sentences, simhash, toxicity

from .conftest import rows, words


# fingerprints
def test_lcp_is_local():
    core = words(1, 400)
    names = [{int(n) for level, ns, _, _ in lcp.parse([t]) if level == 3 for n in ns} for t in ("shift " + core + words(2, 50), words(3, 90) + core)]
    own = {int(n) for level, ns, _, _ in lcp.parse([core]) if level == 3 for n in ns}
    assert len(own & names[0] & names[1]) > 0.9 * len(own)


def test_lcp_batches_change_nothing(monkeypatch):
    texts = [words(i, 5 + i) for i in range(40)] + ["", "aaaa" * 30]
    whole = [lcp.fingerprint(s) for s in lcp.sketches(texts)]
    monkeypatch.setattr(lcp, "AT_ONCE", 60)
    assert [lcp.fingerprint(s) for s in lcp.sketches(texts)] == whole
    assert whole == [lcp.fingerprint(lcp.sketches([t])[0]) for t in texts]


def test_edits_follow_descending_ids(docs):
    data = [(i * 7 % 101, words(i, 1 + i % 40), "en", "s", 0) for i in range(101)]
    found = {r.doc_id: r for r in lcp.fingerprint_edits(docs(data).repartition(5), 9).collect()}
    text = {d[0]: d[1] for d in data}
    ids = sorted(text, reverse=True)
    for i, d in enumerate(ids):
        t, n = text[d], text[ids[(i + 1) % len(ids)]]
        edited = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        assert found[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert found[d].near_edited == lcp.likeness(*lcp.sketches([t, edited]))


# chat
def turns(spark, data):
    return spark.createDataFrame(data, "conv_id long, turn long, role string, parts " + f"array<{chat.PART}>")


def test_chat_round_trip(spark):
    texts = ["", "a <|turn|>assistant\nx<|end|>\n", "&lt; [INST] &amp; &#91;", "<s></s>", "line\nline\r\n", "😀"] * 9
    data = [(1, i, "assistant" if i % 2 else "us\ner<|", [("text", t, None, None)]) for i, t in enumerate(texts)]
    out = chat.format_chats(turns(spark, data)).select("*", chat.read_back(F.col("formatted")).alias("back"), chat.under_loss(F.col("formatted"), F.col("loss")).alias("said")).first()
    assert [(b.role, b.content) for b in out.back] == [(d[2], d[3][0][1]) for d in data]
    assert out.said == "".join(t for i, t in enumerate(texts) if i % 2) and out.n_turns == len(texts)


def test_chat_parts(spark):
    parts = [("text", "see ", None, None), ("image", None, "a<b.png", 10.0), None, ("audio", None, "s.wav", 100.0), ("text", "end", None, None)]
    out = chat.format_chats(turns(spark, [(1, 0, "user", [("document", None, "d", 8.0)]), (1, 1, "assistant", parts), (2, None, None, None)])).where("conv_id = 1").first()
    assert [(a.type, a.ref, a.tokens) for a in out.attachments] == [("document", "d", 4), ("image", "a<b.png", 12), ("audio", "s.wav", 5)]
    for a in out.attachments:
        assert out.formatted[a.start :].startswith(f"<|{a.type}:")
    assert out.expanded_tokens == 21


# mixing
def test_rake_meets_targets(docs):
    data = [(i, words(i, 30 + i % 50), ("en", "fr")[i % 3 == 0], f"s{i % 4 + (i % 7 == 0)}", 0) for i in range(400)]
    targets = {"source": 0.5, "lang": {"en": 0.4, "fr": 0.6}, "topic": 1.0}
    rows_ = mixing.mix(docs(data), targets).toPandas()
    own = rows_.groupby("source").tokens.sum()
    goal = (own / own.sum()) ** 0.5
    goal /= goal.sum()
    weighed = rows_.tokens * rows_.weight
    share = weighed.groupby(rows_.source).sum() / weighed.sum()
    assert np.allclose(share, goal[share.index], atol=1e-5)
    assert np.isclose(weighed[rows_.lang == "en"].sum() / weighed.sum(), 0.4, atol=1e-5)
    assert rows_.probability.max() == pytest.approx(1) and rows_.sampled.mean() == pytest.approx(rows_.probability.mean(), abs=0.08)
    kept = {r.doc_id for r in mixing.sampled(docs(data), targets).collect()}
    assert kept == set(rows_.doc_id[rows_.sampled])


def test_small_sources_do_not_set_the_rate(docs):
    data = [(i, words(i, 30 + i % 50), ("en", "fr")[i % 3 == 0], f"s{i % 4}", 0) for i in range(400)]
    for tail in ([], [(1000, "just three words", "en", "tiny", 0)], [(1000, "just three words", "en", None, 0)]):
        rows_ = mixing.mix(docs(data + tail), {"source": 0.3, "lang": {"en": 0.5, "fr": 0.5}, "topic": 1.0}).toPandas()
        kept = (rows_.tokens * rows_.probability).sum() / rows_.tokens.sum()
        assert kept > 0.499 and rows_.sampled.mean() > 0.4 and rows_.probability.between(0, 1).all()
        # what is under 1 keeps the proportion of the weights
        under = rows_[rows_.probability < 1]
        assert np.ptp(under.probability / under.weight) < 1e-9
        if tail:
            assert kept == pytest.approx(mixing.RATE) and rows_.probability[rows_.doc_id == 1000].item() == 1


def test_fit_reports(spark):
    cells = spark.createDataFrame([("a", "en", "prose", 1000), ("b", "en", "prose", 600), ("c", "en", "prose", 2)], "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 0.4, "b": 0.4, "c": 0.2}, "lang": 1.0, "topic": 1.0}
    found = mixing.fit(cells, targets)
    # c keeps its 2 tokens, a and b share the other 799 alike
    assert found.gap < 1e-6 and found.kept == pytest.approx(0.5) and found.kept_gap == pytest.approx(0.2 - 2 / 801)
    everything = mixing.fit(cells, targets, rate=1.0)
    assert everything.kept == pytest.approx(1.0)


# quality
def test_counts_by_brute_force(docs):
    rng = random.Random(5)
    texts = ["\n".join(" ".join(rng.choice(["a", "bb", "c#", "$", "d|e", "é\xa0f"]) for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(1, 9))) for _ in range(80)]
    found = crf.rule(docs(rows(*texts)), (np.zeros(len(crf.FEATURES)), np.zeros((2, 2)))).collect()
    for r in found:
        t = texts[r.doc_id - 1]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(zip(w, w[1:], w[2:]))
        covered = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines, seen, again = t.split("\n"), set(), 0
        for line in lines:
            if re.search(r"[^\x20\x09-\x0D]", line):
                again += line in seen
                seen.add(line)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(covered))


def test_viterbi_by_brute_force():
    from itertools import product

    rng = np.random.default_rng(2)
    x, w, moves = rng.normal(size=(11, 3)), rng.normal(size=3), rng.normal(size=(2, 2))
    firsts = np.array([0, 1, 5])
    got = crf.viterbi(x, firsts, w, moves)
    for a, b in zip(firsts, [1, 5, 11]):
        e = x[a:b] @ w
        worth = lambda y: sum(e[i] * y[i] for i in range(len(y))) + sum(moves[p, q] for p, q in zip(y, y[1:]))
        assert worth(got[a:b]) == pytest.approx(max(map(worth, product((0, 1), repeat=b - a))))


def test_crf_learns(docs):
    good = [words(i, 60) + ".\n" + words(i + 500, 60) + "." for i in range(60)]
    bad = ["\n".join(" ".join(f"{w}{random.Random(i).choice('#$%')}" for w in words(i + 900 + j, 30).split()) for j in range(4)) for i in range(30)]
    model = crf.fit(good[:40] + bad[:20], [1] * 40 + [0] * 20)
    out = crf.rule(docs(rows(*good[40:], *bad[20:])), model).orderBy("doc_id").collect()
    assert [r.kept for r in out] == [True] * 20 + [False] * 10


# near duplicates
def test_anchors_meet():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**32, 2000, dtype=np.uint64).astype(np.uint32)
    for kind in ("coarse", "fine", "finest"):
        for flips in (0, 1, 2):
            y = x.copy()
            for _ in range(flips):
                y ^= np.uint32(1) << rng.integers(0, 32, len(x)).astype(np.uint32)
            a, b = (dict.fromkeys(zip(*(v.tolist() for v in simhash.anchors(z, kind)))) for z in (x, y))
            assert len({w for w, k in b if (w, k) in a}) == len(x)


def test_simhash_by_definition():
    text = b"The cat  sat on\tthe mat and The cat sat on a hat"
    w = text.lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(len(w) - 3)]
    assert simhash.fingerprint(text) == sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))
    assert simhash.fingerprint(b"") == 0 and simhash.fingerprint(b" A b ") == xxhash.xxh64_intdigest(b"a b", 42)


def test_components_by_brute_force(docs):
    rng = random.Random(4)
    base = [words(i, 120).split() for i in range(25)]
    texts = []
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            w[rng.randrange(len(w))] = "zz"
        texts.append(" ".join(w))
    texts += [None, "", "  "]
    data = rows(*texts)
    rng.shuffle(data)
    out = {r.doc_id: r for r in simhash.near_duplicates(docs(data)).collect()}
    fp = {d: simhash.fingerprint((t or "").encode()) for d, t, *_ in data}
    label = {d: d for d in fp}
    changed = True
    while changed:
        changed = False
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= 4 and label[b] < label[a]:
                    label[a], changed = label[b], True
    assert {d: r.component_id for d, r in out.items()} == label
    assert sorted(r.doc_id for r in simhash.keep_first(docs(data)).collect()) == sorted(set(label.values()))


def test_kept_rows_without_or_with_repeated_ids(docs):
    text = [words(300 + i, 60) for i in range(9)]
    near = text[0] + " "
    data = [(None, text[0]), (None, near), (None, text[1]), (None, text[2]), (None, text[2]), (4, text[2]), (5, text[3]), (5, text[4]), (5, text[4]), (9, text[3]), (3, text[4]), (7, text[5]), (5, text[5]), (5, text[6]), (2, text[6] + " ")]
    left = simhash.keep_first(docs([(d, t, "en", "s", 0) for d, t in data])).collect()
    got = Counter((r.doc_id, r.text.strip()) for r in left)
    assert got == Counter([(None, text[0]), (None, text[1]), (4, text[2]), (5, text[3]), (3, text[4]), (5, text[5]), (2, text[6])])
    # the row of a component stays the same one, whatever the order of the rows
    again = simhash.keep_first(docs([(d, t, "en", "s", 0) for d, t in reversed(data)]).repartition(5)).collect()
    assert Counter(map(tuple, left)) == Counter(map(tuple, again))


def test_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 90)] + [(200, 201), (5, 5)], "a long, b long")
    assert {r.node: r.root for r in components.components(links).collect()} == {**{i: 0 for i in range(91)}, 200: 200, 201: 200}


def test_large_group_is_searched():
    rng = np.random.default_rng(3)
    f = (np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)))
    pairs = simhash.linked(np.zeros(301, np.int64), np.append(f, ~np.uint64(0)))
    assert set(pairs.ravel().tolist()) == set(range(300)) and len(pairs) < 301


# toxicity
def brute_vector(word):
    """The word's subsequences of four symbols, with their weights, by the definition."""
    from itertools import combinations

    x, out = "<" + word + ">>", Counter()
    for i in range(len(x)):
        for a, b, c in combinations(range(i + 1, min(len(x), i + toxicity.WINDOW)), 3):
            out[x[i] + x[a] + x[b] + x[c]] += toxicity.DECAY ** (c - i - 3)
    return out


def test_kernel_by_brute_force():
    said = ["idiot", "idxiot", "a", "ass", "идиот", "trash", "thrash", "été"]
    w = toxicity.Words(said)
    marks = toxicity.Landmarks([w.text(i) for i in range(len(said))])
    got = marks.rows.T @ marks.rows
    for i, a in enumerate(said):
        for j, b in enumerate(said):
            x, y = brute_vector(a), brute_vector(b)
            assert got[i, j] == pytest.approx(sum(v * y[k] for k, v in x.items()) / (norm(len(a)) * norm(len(b))), abs=1e-4), (a, b)
    table = np.random.default_rng(1).normal(size=toxicity.BUCKETS).astype(np.float32)
    word, bucket, value = toxicity.sparse([w.text(i) for i in range(len(said))])
    assert toxicity.word_values(w.letters, w.starts, w.sizes, table) == pytest.approx(np.bincount(word, weights=value * table[bucket]), abs=1e-4)


def norm(n):
    return math.sqrt(sum(max(0, n + 3 - k) * worth**2 for *_, k, worth in toxicity.STEPS))


def test_words_are_letters():
    text = lambda s: ["".join(map(chr, w.text(i))) for w in [toxicity.Words([s])] for i in range(len(w.starts))]
    assert text("You m.o.r.o.n, you  a m o r o n x1y") == ["you", "moron", "you", "amoron", "xy"]
    assert text("stuuuupid ÉTÉ идиот 漢字 -- 12") == ["stuupid", "été", "идиот", "漢字"] and text("") == text(" \n") == []


def test_svm_is_the_least_loss():
    rng = np.random.default_rng(2)
    z, y = rng.normal(size=(60, 4)), np.where(rng.random(60) < 0.3, 1.0, -1.0)
    worth = 5.0 * np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    loss = lambda v, b: 0.5 * v @ v + 0.5 * (worth * np.maximum(0, 1 - y * (z @ v + b)) ** 2).sum()
    v, b = toxicity._svm(z, y, 5.0)
    assert all(loss(v, b) <= loss(v + rng.normal(size=4) * s, b + rng.normal() * s) for s in (1e-3, 0.01, 0.3) for _ in range(50))


def test_gapped_insults():
    rng = random.Random(1)
    bad = ["moron", "worthless", "pathetic", "ass"]
    clean = [words(i, 40) + "." for i in range(300)]
    toxic = [" ".join(w if rng.random() > 0.1 else rng.choice(bad) for w in words(i + 1000, 40).split()) + " " + rng.choice(bad) + "." for i in range(150)]
    model = toxicity.fit(clean[:200] + toxic[:100], [0] * 200 + [1] * 100)
    p = toxicity.scores(clean[200:] + toxic[100:], model) >= 0.5
    assert p[100:].mean() > 0.95 and p[:100].mean() < 0.05
    # insults with a letter put in or doubled, or spelt with stops
    def hide(w):
        i = rng.randrange(1, len(w))
        return rng.choice([".".join(w), w[:i] + rng.choice("xqz*-") + w[i:], w[:i] + w[i - 1] + w[i:]])

    hidden = [" ".join(w if rng.random() > 0.1 else hide(rng.choice(bad)) for w in words(i + 3000, 40).split()) + " " + hide(rng.choice(bad)) + "." for i in range(80)]
    assert (toxicity.scores(hidden, model) >= 0.5).mean() > 0.9
    assert (toxicity.scores(["no labels", ""], toxicity.fit(clean[:9], [0] * 9)) < 1e-9).all()


@pytest.mark.parametrize("sf, recall, wrong", [("0.01", 0.75, 0.06), ("0.1", 0.87, 0.02)])
def test_held_out_toxicity(spark, sf, recall, wrong):
    found = toxicity.query(spark, f"/root/testdata/sf{sf}")
    labels = spark.read.parquet(f"/root/testdata/sf{sf}/labels.parquet").where("toxic is not null")
    rate = {r.toxic: r.rate for r in found.where("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("rate")).collect()}
    assert rate[1] >= recall and rate[0] <= wrong


# sentences
def plain_sentences(text):
    """(start, end, words with their places) of each sentence, by the definition."""
    out, at = [], 0
    for end in [m.end() for m in re.finditer(r"[.!?]+(?=[ \t\n\v\f\r])|\n", text)] + [len(text)]:
        found = [(m.start() + at, m[0].lower()) for m in re.finditer(r"[^ \t\n\v\f\r]+", text[at:end])]
        if found:
            out.append((at if out else 0, end, found))
        at = end
    return out


def plain_spans(text):
    """(start, end, words) of each run of whole sentences, and of each run with parts of long ones."""
    whole = [(a, b, [w for _, w in ws], False) for a, b, ws in plain_sentences(text)]
    parts = []
    for a, b, ws in plain_sentences(text):
        edges, since = [0], 0
        for i in range(1, len(ws)):
            since += 1
            told = sum(map(ord, ws[i - 1][1])) % 8 == 0
            if len(ws) > 16 and (told or since % 16 == 0):
                edges.append(i)
            since = 0 if told else since
        for i, j in zip(edges, [*edges[1:], len(ws)]):
            parts.append((a if i == 0 else ws[i][0], b if j == len(ws) else ws[j][0], [w for _, w in ws[i:j]], len(ws) > 16))
    out = set()
    for units, least in ((whole, 30), (parts, 36)):
        for i in range(len(units)):
            j = i
            while j < len(units) and (j - i < 2 or sum(len(u[2]) for u in units[i:j]) < least):
                j += 1
            run = units[i:j]
            if len(run) >= 2 and sum(len(u[2]) for u in run) >= least and (units is whole or run[0][3]):
                out.add((run[0][0], run[-1][1], " ".join(w for u in run for w in u[2])))
    return sorted(out)


def brute_cuts(order):
    """Of texts in the order of their ids: the code points that go."""
    occurrences: dict = {}
    for d, t in enumerate(order):
        for a, b, said in plain_spans(t or ""):
            occurrences.setdefault(said, []).append((d, a, b))
    gone = [set() for _ in order]
    for places in occurrences.values():
        first = min((d, a) for d, a, _ in places)
        for d, a, b in places:
            if (d, a) != first:
                gone[d] |= set(range(a, b))
    return gone


def sayings(seed, n):
    rng = random.Random(seed)
    return " ".join(w + rng.choice([".", ".\n", "!", " .", ",", "", "", "", "", "", ""]) for w in words(seed, n).split())


def test_spans_by_definition():
    texts = [sayings(i, 5 + 30 * i) for i in range(12)] + ["", " \n \n", "\n\n" + sayings(50, 90), words(60, 150), "É è. " * 40, "a.b.c d! " * 30 + "İx.  Y"]
    s = sentences.Sentences(texts)
    doc, start, end, name, check = s.spans(2, 30, 36)
    names: dict = {}
    for i, t in enumerate(texts):
        want = plain_spans(t)
        mine = np.flatnonzero(doc == i)
        assert sorted(zip(start[mine].tolist(), end[mine].tolist())) == [(a, b) for a, b, _ in want]
        said = {(a, b): w for a, b, w in want}
        for k in mine.tolist():
            names.setdefault((int(name[k]), int(check[k])), set()).add(said[int(start[k]), int(end[k])])
        assert sentences.split(t) == [(a, b) for a, b, _ in plain_sentences(t)]
    assert all(len(v) == 1 for v in names.values()) and len(names) == len(set().union(*names.values()))


def without(text, gone):
    return text and "".join(c for i, c in enumerate(text) if i not in gone)


def test_repeats_by_brute_force(docs):
    passage = sayings(900, 70)
    texts = {i: f"{sayings(i + 10, 40)} {words(i + 70, i % 7)} {passage if i % 3 == 0 else sayings(i + 99, 60)} {sayings(i + 40, 25)}\nThe end." for i in range(1, 40)}
    out = {r.doc_id: r for r in sentences.remove_repeats(docs([(d, t, "en", "s", 0) for d, t in texts.items()])).collect()}
    gone = dict(zip(sorted(texts), brute_cuts([texts[d] for d in sorted(texts)])))
    assert sum(map(bool, gone.values())) == 12
    for d, r in out.items():
        assert r.text == without(texts[d], gone[d])
        assert r.n_sentences == len(plain_sentences(texts[d])) and r.n_removed == sum(any(x in gone[d] for x in range(a, b)) for a, b, _ in plain_sentences(texts[d]))
        assert {x for c in r.removed for x in range(c.start, c.end)} == gone[d]


def test_repeats_of_null_and_repeated_ids(docs):
    a, b, c = (". ".join(words(500 + 10 * k + i, 13) for i in range(3)) + "." for k in range(3))
    own = [words(600 + i, 32) + ".\n" for i in range(12)]
    texts = [(7, own[0] + a), (7, own[1] + a), (7, own[2] + b), (None, own[3] + b), (None, own[4] + b), (None, own[5] + c), (None, own[6] + c), (None, own[7]), (None, own[7]), (None, own[7]), (3, own[8] + own[9]), (3, own[8] + own[9]), (4, own[9]), (None, None), (7, None)]
    df = docs([(d, t, "en", "s", 0) for d, t in texts]).repartition(3)
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(texts, key=lambda x: (x[0] is None, x[0] or 0, hashes[x[1]] if x[1] else 0))
    gone = brute_cuts([t for _, t in order])
    assert sum(map(bool, gone)) >= 5
    wanted = Counter((d, without(t, g)) for (d, t), g in zip(order, gone))
    assert Counter((r.doc_id, r.text) for r in sentences.remove_repeats(df).collect()) == wanted


# language
def test_languages_are_told(docs):
    import itertools

    data = [(i, " ".join(random.Random(i).choice(ws) for _ in range(40)), lang, "s", 0) for i, (lang, ws) in zip(range(400), itertools.cycle([("en", ["the", "thing", "whether", "this", "other"]), ("fr", ["être", "très", "où", "çà", "mère"]), ("de", ["über", "schön", "nicht", "weiß", "zwischen"])]))]
    df = docs(data + [(900, "123 !!", "en", "s", 0), (901, None, None, "s", 0), (902, "漢字漢字", "en", "s", 0)])
    model = language.train(df, (language.fold(4) != 2) & (F.col("doc_id") < 900))
    out = {r.doc_id: r for r in language.identify(df, model).collect()}
    held = [d for d in data if zlib.crc32(str(d[0]).encode()) % 4 == 2]
    assert held and all(out[d[0]].lang_pred == d[2] and not out[d[0]].rejected for d in held)
    assert out[900].lang_pred == out[901].lang_pred == "und" and out[902].rejected and out[902].lang_pred in ("en", "fr", "de")
    assert {r.doc_id for r in language.keep_identified(df, model).collect()} == {d[0] for d in data}


def test_foreign_texts_are_rejected(spark):
    """Each language of the tables in turn is left out of the training; its texts of some length must mostly go, the others stay."""
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang is not null and length(text) > 200")
    for foreign in ("en", "de"):
        model = language.train(df.where(F.col("lang") != foreign), language.fold(4) != 2)
        rate = {r.out: r.rate for r in language.identify(df.where(language.fold(4) == 2), model).join(df.select("doc_id", (F.col("lang") == foreign).alias("out")), "doc_id").groupBy("out").agg(F.avg(F.col("rejected").cast("int")).alias("rate")).collect()}
        assert rate[True] > 0.8 and rate[False] < 0.01, (foreign, rate)


def test_language_by_brute_force(docs):
    """n-grams, weights and the nearest centroid by their definitions."""
    def grams(text):
        out, low = Counter(), [c if c.isalpha() else None for c in (" " + text + " ").lower()]
        for a, b in zip(low, low[1:]):
            out[a, b] += bool(a or b)
        for a, b, c in zip(low, low[1:], low[2:]):
            out[a, b, c] += bool(b)
        return {g: n for g, n in out.items() if n}

    def bucket(g):
        x = [ord(c) if c else 0 for c in g]
        low = 0xFFFFFFFF
        h = (x[0] * 31 + x[1]) if len(x) == 2 else (((x[0] * 1009 + x[1]) & low) * 2003 + x[2])
        return (((h & low) * 0x9E3779B1 & low) >> 8) % language.DIM

    texts = [words(i, 30) for i in range(20)] + ["çà été " * 9, "über weiß " * 8]
    model = language.fit(texts, ["a"] * 20 + ["b", "c"])
    out = language.identify(docs(rows(*texts, "", "9 9")), model).orderBy("doc_id").collect()
    for r, t in zip(out, texts):
        v = np.zeros(language.DIM)
        for g, n in grams(t).items():
            v[bucket(g)] += n
        v = np.log1p(v) * model.idf
        cosine = model.centroids @ v / np.linalg.norm(v)
        assert r.lang_pred == model.names[int(np.argmax(cosine))] and r.score == pytest.approx(min(1, cosine.max()), abs=1e-4)
    assert [r.lang_pred for r in out[-2:]] == ["und", "und"] and all(r.rejected for r in out[-2:])


# packing
def test_ids_are_the_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    e = packing.encoder(packing.tokenizer_path())
    for text in [words(1, 300), "", " \n\n  x\t", "don't I'LL 1234 ١٢ <|endoftext|>", "é" * 90, "a" * 4000, " " * 500, "𝒳😀​　"]:
        assert e.encode_to_numpy(text, disallowed_special=()).tolist() == t.encode(text, add_special_tokens=False).ids


def test_added_tokens_are_the_tokenizers(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>\n x", "a  <|endoftext|>  b", "<|endoftext|", "é<|endoftext|>'s", "<|ENDOFTEXT|>", words(1, 40)]
    out = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.pieces(docs(rows(*texts)), with_ids=True).collect()}
    assert t.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    for i, text in enumerate(texts, 1):
        assert out[i] == [*t.encode(text, add_special_tokens=False).ids, packing.END]


def test_bound_never_exceeds_and_bins_hold():
    rng = np.random.default_rng(1)
    for n, high in ((300, 1024), (200, 400), (90, 1024), (1, 5)):
        lengths = rng.integers(1, high, n)
        bins, offsets, k = packing.best_fit_decreasing(lengths, 1024)
        assert packing.lower_bound(lengths, 1024) <= k and max(np.bincount(bins, weights=lengths)) <= 1024
        for b in range(k):
            at = np.sort(offsets[bins == b])
            assert at[0] == 0 and (np.cumsum(lengths[bins == b][np.argsort(offsets[bins == b])])[:-1] == at[1:]).all()
    assert packing.lower_bound(np.array([600] * 7 + [100]), 1024) == 7
    assert packing.lower_bound(np.array([342] * 6), 1024) == 3


def test_groups_exchange(spark):
    rng = np.random.default_rng(5)
    data = [(i, 0, 0, int(n), 0) for i, n in enumerate(rng.integers(200, 700, 600))]
    cut = spark.createDataFrame(data, "doc_id long, piece int, start long, length long, ids_crc32 long")
    small, once = (packing.place(cut, group=20, rounds=r).toPandas() for r in (3, 1))
    for x in (small, once):
        assert len(x) == 600 and x.groupby("sequence_id").length.sum().max() <= 1024
        for _, s in x.sort_values("offset").groupby("sequence_id"):
            assert (s.offset.values == s.length.cumsum().values - s.length.values).all()
    assert small.sequence_id.nunique() <= once.sequence_id.nunique()


def spark_pieces(docs):
    return packing.pieces(docs([(None, "the same words here", "en", "s", 0)] * 600))


def test_sequences_hold_their_documents(docs):
    data = rows(*[words(i, 10 + 40 * i) for i in range(20)], words(3, 3000), None)
    out = packing.sequences(docs(data)).collect()
    got = sorted(x for r in out for x in np.frombuffer(r.ids, "<u4").tolist())
    e = packing.encoder(packing.tokenizer_path())
    assert got == sorted(x for d in data for x in [*e.encode_ordinary(d[1] or ""), 2]) and max(len(r.ids) for r in out) <= 4096
    # one id, or none, for all rows: no group is larger than others
    placed = packing.place(spark_pieces(docs), 1024, group=20, rounds=1)
    assert max(r['count'] for r in placed.where('grp > 0').groupBy('grp').count().collect()) < 80


# personal data
def test_base_by_brute_force(docs):
    rng = random.Random(9)
    atoms = ["a.b@c.d", "x@y", "1.2.3.4", "256.1.1.1", "001.2.3.255.7", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (23) 456-78901", "+12", "é", " ", "@", ".", "-", "12", "_", "a@b.c..d@e.f", "+", "9" * 17, "\n", "x1.2.3.4y", "a@b.c_d@e.f"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(1, 14))) for _ in range(300)]
    out = {r.doc_id: r.spans for r in pii.found(docs(rows(*texts))).select("doc_id", pii.listed(F.col("base")).alias("spans")).collect()}
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def passes(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    for i, t in enumerate(texts, 1):
        assert out[i] == ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in patterns.items() for m in re.finditer(p, t) if passes(k, m[0])), t


def test_telling_words_are_found(docs):
    texts = [f"{words(i, 20)} contact Zanzibar via boss@corp.com today {words(i + 70, 20)}" for i in range(4)] + [words(i + 200, 30) + " contact today" for i in range(60)]
    out = {r.doc_id: r for r in pii.protected(docs(rows(*texts))).collect()}
    for d in range(1, 5):
        told = [texts[d - 1][t.s : t.e].lower() for t in out[d].terms]
        assert "zanzibar" in told and "contact" not in told and "today" not in told
    assert not any(out[d].terms for d in range(5, 65))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(rows(*texts))).collect()}
    assert all("boss@" not in t and "Zanzibar" not in t for t in clean.values()) and "[EMAIL]" in clean[1] and clean[9] == texts[8]


def test_zero_octets(docs):
    good = ["10.0.0.1", "0.0.0.0", "000.1.2.3", "192.168.0.1", "10.20.30.0", "00.0255.000.1"]
    bad = ["256.0.0.1", "0.0.0", "0.0.0.1000"]
    texts = [f"é at {x} now" for x in good + bad]
    out = {r.doc_id: r.spans for r in pii.found(docs(rows(*texts))).select("doc_id", pii.listed(F.col("base")).alias("spans")).collect()}
    assert [out[i] for i in range(1, len(texts) + 1)] == [f"ip:5:{5 + len(x)}" for x in good] + [""] * len(bad)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(rows(*texts))).collect()}
    assert all("[IP]" in clean[i] for i in range(1, len(good) + 1))


def test_any_long_is_an_id(docs):
    top = (1 << 63) - 1
    data = [(1 << 62 | 1, words(1, 60)), (1 << 62 | 2, words(2, 60)), (5, words(3, 60)), (top, words(4, 60)), (-top - 1, words(4, 60) + " "), (None, words(5, 60)), (top - 1, words(5, 60)), (None, words(6, 60)), (None, words(6, 60) + "\n")]
    df = docs([(d, t, "en", "s", 0) for d, t in data])
    found = Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert found == Counter([(1 << 62 | 1, 1 << 62 | 1), (1 << 62 | 2, 1 << 62 | 2), (5, 5), (top, -top - 1), (-top - 1, -top - 1), (None, top - 1), (top - 1, top - 1), (None, None), (None, None)])
    left = Counter((r.doc_id, r.text.strip()) for r in simhash.keep_first(df).collect())
    assert left == Counter([(d, t.strip()) for d, t in data[:3]] + [(-top - 1, words(4, 60)), (top - 1, words(5, 60)), (None, words(6, 60))])


LETTERS = r"[^\W\d_]"


def brute_terms(texts, base):
    """The told words of each text, and their shares: from the spans of the base, by whole passes over all texts."""
    import math

    def runs(t, first=0):
        out = []
        for token in re.finditer(r"[^ \t\n\r\f\x0b]+", t):
            if "@" not in token[0]:
                out += [(m[0].lower(), m.start() + token.start() + first, m.end() + token.start() + first) for m in re.finditer(LETTERS + "{2,}", token[0])]
        return out

    near = [{(t[s:e].lower(), w) for _, s, e in spans for w, _, _ in runs(t)} for t, spans in zip(texts, base)]
    holds = [{t[s:e].lower() for _, s, e in spans} for t, spans in zip(texts, base)]
    anywhere = [set(re.findall(LETTERS + "+", t.lower())) for t in texts]
    n, share = len(texts), {}
    for e, w in set().union(*near):
        have = [i for i, p in enumerate(near) if (e, w) in p]
        if len({texts[i] for i in have}) >= 2 and len(have) < n:
            n_e, n_w, n_b = sum(e in h for h in holds), sum(w in a for a in anywhere), len(have)
            share[e, w] = math.log(n * n_b / (n_e * n_w)) / -math.log(n_b / n)
    told = []
    for t, h in zip(texts, holds):
        mine = {}
        for (e, w), x in share.items():
            if e in h and x >= pii.GENERALISE:
                mine[w] = max(x, mine.get(w, 0))
        told.append([(s, e, mine[w]) for w, s, e in runs(t) if w in mine] if h else [])
    return told


def test_terms_by_brute_force(docs):
    rng = random.Random(3)
    people = [(f"Name{chr(65 + i)}x Ort{chr(97 + i)}", f"p{i}@mail.org", f"10.0.{i}.7", f"+49 30 1234{i:03d}") for i in range(12)]
    texts = []
    for i in range(90):
        t = words(i, 25)
        if i % 2:
            who = rng.choice(people)
            said = [who[0], "write to", who[1], "or", who[2], words(i + 500, 12), who[0].upper(), "é" + who[3], "today"]
            t += " " + rng.choice([" ", "\n"]).join(said) + " " + words(i + 900, 20) + rng.choice(["", " " + who[0] + " again@here"])
        texts.append(t)
    out = {r.doc_id: r for r in pii.protected(docs(rows(*texts, texts[1], None))).collect()}
    texts += [texts[1], ""]
    base = [{(b.k, b.s, b.e) for b in out[i + 1].base} for i in range(len(texts))]
    told = brute_terms(texts, base)
    assert sum(map(len, told)) > 100
    for i in range(len(texts)):
        assert [(t.s, t.e, pytest.approx(t.share)) for t in out[i + 1].terms] == told[i], texts[i]
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(rows(*texts))).collect()}
    for i, t in enumerate(texts):
        edits = sorted([(s, e, f"[{pii.KINDS[k].upper()}]") for k, s, e in base[i]] + [(s, e, "" if x >= pii.REMOVE else "[NAME]" if t[s].isupper() else "[WORD]") for s, e, x in told[i]])
        said, at = "", 0
        for s, e, to in edits:
            if s >= at:
                said += t[at:s] + to
            at = max(at, e)
        assert clean[i + 1] == said + t[at:]


def test_many_entities_cost_their_number(docs):
    import time

    log = "\n".join(f"10.{i >> 16 & 255}.{i >> 8 & 255}.{i & 255} GET é{i} done" for i in range(40_000))
    began = time.time()
    out = {r.doc_id: r for r in pii.sanitise(docs([(1, log, "en", "s", 0), (2, "no data", "en", "s", 0)])).collect()}
    assert out[1].text == "\n".join(f"[IP] GET é{i} done" for i in range(40_000)) and out[2].text == "no data"
    assert time.time() - began < 120


def test_sanitise_keeps_rows_and_columns(docs):
    data = [(1, "mail a@b.cd now", "en", "s", 0), (1, "mail a@b.cd now", "en", "s", 0), (None, "ip 1.2.3.4", None, None, None), (1, "other 1.2.3.4", "fr", "t", 1), (2, None, "en", "s", 0), (3, "", "en", "s", 0)]
    df = docs(data, extra=True).withColumns({"hash": F.lit("y"), "id": F.lit("z"), "row": F.lit(1), "edits": F.lit(2), "_own": F.lit(3), "_terms": F.lit(4)})
    out = pii.sanitise(df)
    assert out.schema == df.schema
    got = Counter((r.doc_id, r.text, r.lang) for r in out.collect())
    assert got == Counter([(1, "mail [EMAIL] now", "en"), (1, "mail [EMAIL] now", "en"), (None, "ip [IP]", None), (1, "other [IP]", "fr"), (2, None, "en"), (3, "", "en")])
    assert {tuple(r)[5:] for r in out.collect()} == {tuple(r)[5:] for r in df.collect()}
