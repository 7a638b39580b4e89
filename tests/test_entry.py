import __spark_entry__ as entry


def test_registry():
    names, sql = set(entry.queries()), set(entry.oracle_sql())
    assert sql <= names and len(names) >= 50


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "chunk_id", "score", "rank"]


def test_streaming_resumes(spark, tmp_path):
    from textloom.streaming.ingest import ingest_available

    src, path = f"{tmp_path}/src", f"file://{tmp_path}/i"
    df = spark.createDataFrame([(1, "one two", "en"), (2, "three", "en"), (2, "three", "en")], "doc_id long, text string, lang string")
    df.filter("doc_id = 1").write.parquet(src)
    assert ingest_available(spark, src, df.schema, path, id_col="doc_id").corpus_stats.first()["n_chunks"] == 1
    df.write.mode("append").parquet(src)
    got = ingest_available(spark, src, df.schema, path, id_col="doc_id")
    assert got.corpus_stats.first()["n_chunks"] == 2 and got.postings.count() == 3
