import corpus_pipeline
from llm_helpers import prose


def test_stages_take_effect_on_each_others_rows(spark, tmp_path):
    clean = {k: prose(k, 80) for k in range(40)}
    item = prose(900, 25)
    rows = [(k, t, "s") for k, t in clean.items()]
    rows += [(50, clean[3], "s"), (3, clean[3], "s"), (51, "too short", "s"), (52, None, "s"), (53, "a b c d e " * 20, "s"),
             (54, clean[7][:100] + " " + item + " " + prose(901, 40), "s"), (55, prose(55, 60) + " token=" + "k" * 20, "s"), (None, prose(77, 60), "s")]
    schema = "doc_id long, text string, source string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1) for k in clean], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.keep(stage(spark, docs, str(tmp_path)))
        assert docs.columns == ["doc_id", "text", "source"], name
        seen[name] = sorted(r.doc_id if r.doc_id is not None else -1 for r in docs.collect())
    assert seen["quality"] == sorted([-1, *clean, 3, 50, 54, 55])
    assert seen["near_dedup"] == sorted([-1, *clean, 54, 55])
    assert seen["decontamination"] == seen["secrets"] == sorted([-1, *clean, 55])
    assert "[secret]" in docs.filter("doc_id = 55").first().text
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in packed) == seen["secrets"]


def test_an_empty_table_gives_no_rows(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string"), ("labels", "doc_id long, quality int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
