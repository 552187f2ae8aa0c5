import corpus_pipeline


def test_stages_over_tables(spark, corpus, tmp_path):
    docs = corpus.filter("doc_id is not null")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 != 0), 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, corpus.filter("doc_id = 5").first().text)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "benchmark_free", "without_secrets", "packed"]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns, name
        assert out.count() <= now.count()
        now = out
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and all(r.offset + r.length <= 2048 for r in rows)


def test_pipeline_of_nothing(spark, nothing, tmp_path):
    nothing.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
