import corpus_pipeline as P
from chronolith.llm import language, mixing, packing, pii, simhash


def test_stages_and_run(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    folder = str(tmp_path)
    src.write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = language.train(docs)
    rejected = {r.doc_id for r in language.identify(docs, model).where("rejected").collect()}
    seen, kept = docs, {r.doc_id for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, seen, folder)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{folder}/{name}")
        out = spark.read.parquet(f"{folder}/{name}")
        ids = {r.doc_id for r in out.collect()}
        if name == "language":
            assert ids == kept - rejected
        if name == "near_copies":
            groups = simhash.near_duplicates(seen).collect()
            assert ids == {r.component_id for r in groups}
        if name == "personal_data":
            assert ids == kept and pii.found(out).where("size(base) > 0").count() == 0
        if name == "mixture":
            assert ids == {r.doc_id for r in mixing.mix(seen).where("sampled").collect()}
        seen, kept = out, ids
    packed = P.STAGES[-1][1](spark, seen, folder).toPandas()
    assert set(packed.doc_id) == kept and packed.groupby("sequence_id").length.sum().max() <= packing.CAPACITY
    run = P.run(spark, folder).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert run[key].sort_values(key).values.tolist() == packed[key].sort_values(key).values.tolist()
