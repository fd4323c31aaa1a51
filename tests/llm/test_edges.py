"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import pytest

import corpus_pipeline
from chronolith.llm import chat, components, crf, language, lcp, mixing, packing, pii, sentences, simhash, toxicity

from chronolith.llm.common import stored

from .conftest import rows, words

LONG = words(1, 30_000)
BLANK = "a" + " " * 1_000_000 + "b"
ODD = [*rows(None, "", " \n\t ", "one", "é ü 漢字 😀", words(2, 80), words(2, 80), LONG, "x" * 50_000, "1" * 20_000, "a@" * 3000, BLANK), (11, None, None, None, None), (6, words(2, 80), "en", "s", 1), (None, "no id here", None, None, None), (None, None, "fr", None, None)]

MODEL = crf.fit([words(3, 200), "# $ %\n# $ %\n" * 9], [1, 0])
LANGUAGE = language.fit([words(4, 100), "çé èà ùê " * 30], ["en", "fr"])
TOXIC = toxicity.fit([f"{words(i, 20)} moronic fool {words(i + 50, 9)}." for i in range(30)] + [f"{words(i + 100, 30)}." for i in range(30)], [1] * 30 + [0] * 30)

OPERATORS = {
    "lcp": lambda d: lcp.fingerprint_edits(d),
    "phrases": lambda d: lcp.phrases(d).select("doc_id").distinct(),
    "mixing": lambda d: mixing.mix(d),
    "sampled": lambda d: mixing.sampled(d),
    "crf": lambda d: crf.rule(d, MODEL),
    "lines": lambda d: crf.line_labels(d, MODEL),
    "simhash": lambda d: simhash.near_duplicates(d),
    "keep_first": lambda d: simhash.keep_first(d),
    "toxicity": lambda d: toxicity.score(d, TOXIC),
    "sentences": lambda d: sentences.remove_repeats(d),
    "language": lambda d: language.identify(d, LANGUAGE),
    "keep_identified": lambda d: language.keep_identified(d, LANGUAGE),
    "packing": lambda d: packing.pack(d),
    "pii": lambda d: pii.protected(d),
    "sanitise": lambda d: pii.sanitise(d),
}
ONE_EACH = ("lcp", "mixing", "crf", "simhash", "toxicity", "sentences", "language", "pii", "sanitise")


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(docs, name):
    out = OPERATORS[name](docs(ODD)).collect()
    if name in ONE_EACH:
        assert len(out) == len(ODD)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, name):
    assert OPERATORS[name](docs([])).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names(docs, name):
    data = rows("one two three", words(5, 70), None)
    out = OPERATORS[name](docs(data, extra=True))
    assert out.select("doc_id").count() == out.count()
    assert out.count() == OPERATORS[name](docs(data)).count()


def test_values_of_odd_rows(docs):
    """Every stage that keeps rows keeps the right ones, with the caller's columns as they were."""
    data = [(1 << 62 | 5, words(40, 60), "en", "s", 1), (None, words(41, 60), "en", "s", 1), (None, words(42, 60), None, None, None), (7, words(43, 60), "en", "s", 1), (7, words(44, 60), "en", "s", 1), (7, words(44, 60), "en", "s", 1), (3, None, "en", "s", 1), (4, "", "en", "s", 1)]
    df = docs(data, extra=True)
    got = lambda out: sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    known = [d[:2] for d in data if d[1]]
    assert got(language.keep_identified(df, language.fit([d[1] for d in data[:5]] * 20, ["en"] * 100))) == sorted(known, key=str)
    once = [*known[:4], known[4], (3, None)]
    assert got(simhash.keep_first(df)) == sorted(once, key=str)
    assert got(pii.sanitise(df)) == sorted((d[:2] for d in data), key=str)
    everything = mixing.sampled(df, {"source": 1.0, "lang": 1.0, "topic": 1.0})
    assert got(everything) == sorted((d[:2] for d in data), key=str)
    for out in (everything, pii.sanitise(df), simhash.keep_first(df)):
        assert out.columns == df.columns and {tuple(r)[5:] for r in out.collect()} == {tuple(r)[5:] for r in df.collect()}


def test_stages_keep_rows_without_ids_and_columns_of_any_type(spark, tmp_path):
    """Half of the rows have no id, one text is a million spaces, one column is a map: each stage decides row by row, and drops no column."""
    from pyspark.sql import functions as F

    data = [(None if i % 2 else i, words(60 + i, 70), "en", f"s{i % 3}", i) for i in range(80)]
    data += [(None, words(60, 70), "en", "s0", 80), (900, BLANK + words(300, 40), "en", "s1", 81), (901, "mail a@b.cd " + words(301, 60), "en", "s2", 82)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("more", F.create_map(F.lit("k"), F.col("n_chars"))).withColumns({c: F.lit("x") for c in ("n", "row", "h", "draw", "probability", "grp")})
    stages = dict(corpus_pipeline.STAGES)
    named = {}
    for name in list(stages)[:-1]:
        docs_out = stages[name](spark, docs, str(tmp_path))
        assert docs_out.columns == docs.columns and docs_out.schema["more"].dataType == docs.schema["more"].dataType
        named[name] = {r.more["k"]: (r.doc_id, r.text) for r in docs_out.collect()}
        docs_out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert len(named["language"]) >= 80  # clean documents stay
    # the copy of 0's text has no id, and 0 stays
    assert set(named["near_copies"]) == set(named["language"]) - {80}
    assert set(named["personal_data"]) == set(named["near_copies"]) and named["personal_data"][82][1].startswith("mail [EMAIL] ")
    kept = named["mixture"]
    assert 10 < sum(k % 2 for k in kept) and 10 < sum(1 - k % 2 for k in kept)
    packed = stages["packing"](spark, docs, str(tmp_path)).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= packing.CAPACITY
    assert packed[packed.piece == 0].doc_id.isna().sum() == sum(v[0] is None for v in kept.values())


def test_documents_without_ids_are_drawn_one_by_one(docs):
    data = [(None if i < 300 else i, words(i, 20 + i % 30), "en", ("a", "b")[i % 4 == 0], 0) for i in range(600)]
    out = mixing.mix(docs(data), {"source": {"a": 0.3, "b": 0.7}, "lang": 1.0, "topic": 1.0}).toPandas()
    a = out[out.source == "a"]
    assert 0.1 < a.probability.max() < 0.9
    for rows_ in (a[a.doc_id.isna()], a[a.doc_id.notna()]):
        assert abs(rows_.sampled.mean() - rows_.probability.mean()) < 0.1


def test_hot_ids_share_no_bucket(spark):
    """Rows without an id, and copies of one row, are dealt over buckets, and each still meets the one that follows it."""
    from pyspark.sql import functions as F

    data = [(None, words(i, 12)) for i in range(700)] + [(5, "the same text again")] * 500 + [(7, words(i, 12)) for i in range(800, 1000)] + [(i, words(i, 12)) for i in range(1000, 1600)]
    docs = stored(spark.createDataFrame(data, "doc_id long, text string"), "hot")
    dealt = lcp.beside_next(docs, 20).groupBy("bucket").agg(F.count_if(F.col("extra") == 0).alias("n")).collect()
    assert max(r.n for r in dealt) < 260 and sum(r.n for r in dealt) == len(data)
    out = lcp.fingerprint_edits(docs, 20).toPandas()
    assert len(out) == len(data) and out.doc_id.isna().sum() == 700
    same = out[out.doc_id == 5]
    assert (same.near_next == 1).sum() == 499  # each copy but the last is followed by a copy


TURNS = f"conv_id long, turn long, role string, parts array<{chat.PART}>, chunk string, ends string, ts string, attachments string"


def test_odd_turns(spark):
    part = lambda t: [("text", t, None, None)]
    data = [(None, 0, "user", part("a")), (None, None, "assistant", part("b")), (1, None, None, part(None)), (1, None, "assistant", part("z")), (1, 2, "assistant", part("x")), (1, 2, "assistant", part("x")), (2, 0, "user", None), (2, 1, "assistant", []), (3, 0, "assistant", [None])]
    df = spark.createDataFrame([(*d, "x", "x", "x", "x") for d in data], TURNS)
    from pyspark.sql import functions as F

    out = {r.conv_id: r for r in chat.format_chats(df).select("*", chat.read_back(F.col("formatted")).alias("back"), chat.under_loss(F.col("formatted"), F.col("loss")).alias("said")).collect()}
    assert {k: [tuple(b) for b in v.back] for k, v in out.items()} == {None: [("assistant", "b"), ("user", "a")], 1: [("", ""), ("assistant", "z"), ("assistant", "x"), ("assistant", "x")], 2: [("user", ""), ("assistant", "")], 3: [("assistant", "")]}
    assert {k: v.said for k, v in out.items()} == {None: "b", 1: "zxx", 2: "", 3: ""}
    assert chat.format_chats(df.limit(0)).count() == 0


def test_many_turns_without_numbers_cost_their_number(spark):
    import time

    rows_ = spark.range(20_000).selectExpr("1L as conv_id", "cast(null as long) as turn", "if(id % 2 = 0, 'user', 'assistant') as role", f"array(cast(named_struct('type', 'text', 'text', cast(id as string), 'ref', null, 'size', null) as {chat.PART})) as parts")
    began = time.time()
    out = chat.format_chats(rows_).first()
    assert out.n_turns == 20_000 and len(out.loss) == 10_000 and time.time() - began < 60


def test_sequences_and_components(spark, docs):
    held = packing.sequences(docs([(None, "a b", None, None, None), (None, "a b", None, None, None), (3, None, "en", "s", 0)], extra=True)).collect()
    assert sorted((x for r in held for x in r.doc_ids), key=str) == [3, None, None] and packing.sequences(docs([])).count() == 0
    links = spark.createDataFrame([(1, 2), (2, 1), (2, 2), (7, 5), (5, 3), (9, 9)], "a long, b long")
    assert {tuple(r) for r in components.components(links).collect()} == {(1, 1), (2, 1), (7, 3), (5, 3), (3, 3)}
    assert components.components(links.limit(0)).count() == 0


def test_training_on_odd_tables(spark, docs):
    """Null ids, texts and labels, repeated rows and empty tables: every model can be trained, and an empty one says nothing."""
    data = [*rows(*(f"{words(i, 40)}." for i in range(30))), (None, None, None, None, None), (3, None, "en", "s", 1), (4, words(4, 30), "en", "s", 1)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 20)] + [(None, 1, 1), (5, None, None), (5, 1, 0)], "doc_id long, quality int, toxic int")
    for d, l in ((docs(data, extra=True), labels), (docs([]), labels), (docs(data), labels.limit(0))):
        assert 0 <= min(r.score for r in toxicity.score(docs(data), toxicity.train(d, l)).collect())
        assert crf.rule(docs(data), crf.train(d, l)).count() == len(data)
        assert language.identify(docs(data), language.train(d)).count() == len(data)
