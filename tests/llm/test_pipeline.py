import corpus_pipeline
from symbolgraph.llm import queries

TESTDATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    extra = spark.createDataFrame([(10_000, "12 34", "en", "s", 5), (10_001, None, "en", "s", None)], docs.schema)
    docs, columns = docs.unionByName(extra), docs.columns
    counts = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, TESTDATA).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        assert after.columns == columns, name
        assert after.select("doc_id").exceptAll(docs.select("doc_id")).isEmpty()
        docs = after
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True)
    assert counts[0] - counts[1] >= 2 and counts[3] == counts[4] > counts[5] > 0


def test_run_and_queries(spark):
    assert corpus_pipeline.run(spark, TESTDATA).count() > 0
    assert set(queries.QUERIES) == {"op1_secrets", "op2_simhash", "op3_urlfilter", "op4_htmltext", "op5_mixing", "op6_ann", "op7_langid", "op8_toxicity", "op9_quality", "op10_decontam", "op11_packing", "op12_divergence", "op13_codes"}
