import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(n))


def rows(*texts, start=1):
    return [(start + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture
def docs(spark):
    def make(data, extra=False):
        df = spark.createDataFrame(data, SCHEMA)
        if extra:
            from pyspark.sql import functions as F

            names = ("hash", "id", "row", "edits", "part", "root", "pairs", "words", "_p", "_source", "_lang", "_topic", "_keep", "_own", "_terms", "line", "turn", "length", "start", "piece", "rejected", "lang_pred", "cell", "fp", "anchor", "node", "bucket", "key", "extra", "h", "base", "terms", "name", "place", "size", "tokens", "topic", "weight", "grp", "component_id", "ids", "score", "chunk", "_id", "_h", "u", "v")
            df = df.withColumns({n: F.lit("x") for n in names})
        return df

    return make
