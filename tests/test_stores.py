"""Segment stores: index, vectors, caches, checkpoints, JSON exports, file scans."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from textloom.operators import embedding, index, search, vectors
from textloom.sources import readers, store
from textloom.streaming import ingest

DOCS = [(1, "red fox red"), (2, "blue fox"), (3, "green bird sings"), (4, "")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, text string")


def postings(i):
    return {(r["term"], r["chunk_id"], r["tf"], r["doc_length"]) for r in i.postings.collect()}


def test_appending_equals_one_build(spark, tmp_path):
    path = f"file://{tmp_path}/i"
    assert not index.exists(spark, path)
    assert index.append_new(path, frame(spark, DOCS[:2])) == 2
    assert index.append_new(path, frame(spark, DOCS[1:] + DOCS[2:3])) == 1
    assert index.append_new(path, frame(spark, DOCS)) == 0
    got, want = index.load(spark, path), index.build(frame(spark, DOCS))
    assert postings(got) == postings(want) and len(store.segments(spark, path)) == 2
    assert {tuple(r) for r in got.term_stats.collect()} == {tuple(r) for r in want.term_stats.collect()}
    assert got.corpus_stats.first() == want.corpus_stats.first()
    index.compact(spark, path)
    assert len(store.segments(spark, path)) == 1 and postings(index.load(spark, path)) == postings(want)
    assert store.vacuum(spark, path) > 0 and postings(index.load(spark, path)) == postings(want)


def test_a_loss_before_the_commit_changes_nothing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/i"
    index.append_new(path, frame(spark, DOCS[:1]))
    before = postings(index.load(spark, path))
    monkeypatch.setattr(index.store, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        index.append_new(path, frame(spark, DOCS))
    monkeypatch.undo()
    assert postings(index.load(spark, path)) == before
    assert index.append_new(path, frame(spark, DOCS)) == 2


def test_only_one_writer_makes_a_commit(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    store.commit(spark, path, ["a"])
    at = store.last(spark, path)
    store.commit(spark, path, ["a", "b"], at)
    with pytest.raises(Exception, match="exists"):
        store.commit(spark, path, ["a", "c"], at)
    assert store.segments(spark, path) == ["a", "b"]
    store.drop(spark, path)
    assert store.segments(spark, path) is None


def test_json_export_and_migration(spark, tmp_path):
    built = index.build(frame(spark, [(i, f"word{i % 7} and more") for i in range(40)]))
    index.save_json(built, f"{tmp_path}/json", chunks_per_file=9)
    found = sorted((tmp_path / "json").glob("*.json"))
    assert len(found) > 1 and all(json.loads(f.read_text())["version"] == 1 for f in found)
    counts = index.migrate_json(spark, f"{tmp_path}/json", f"file://{tmp_path}/i")
    assert counts == {"source": 40, "stored": 40} and postings(index.load(spark, f"file://{tmp_path}/i")) == postings(built)
    (tmp_path / "bad.json").write_text('{"version": 2, "chunks": [{"chunk_id": 1, "text": "a"}]}')
    with pytest.raises(ValueError, match="version"):
        index.migrate_json(spark, f"{tmp_path}/bad.json", f"file://{tmp_path}/x")


def test_vectors(spark, tmp_path):
    path, schema = f"file://{tmp_path}/v", "chunk_id string, embedding array<double>, payload string"
    with pytest.raises(FileNotFoundError):
        vectors.load(spark, path)
    vectors.ensure(spark, path, 2)
    assert vectors.exists(spark, path) and vectors.load(spark, path).count() == 0
    assert vectors.upsert(path, spark.createDataFrame([("a", [1.0, 0.0], "p"), ("b", [0.0, 1.0], "q")], schema)) == 2
    assert vectors.upsert(path, spark.createDataFrame([("b", [1.0, 1.0], "r"), ("c", [2.0, 0.0], "s")], schema)) == 2
    got = {r["chunk_id"]: r for r in vectors.load(spark, path).collect()}
    assert {k: list(r["embedding"]) for k, r in got.items()} == {"a": [1, 0], "b": [1, 1], "c": [2, 0]}
    assert all(r["point_id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, k)) for k, r in got.items())
    for bad in ([("d", [1.0], "")], [("d", [1.0, 2.0], ""), ("d", [1.0, 3.0], "")]):
        with pytest.raises(ValueError, match="points need"):
            vectors.upsert(path, spark.createDataFrame(bad, schema))
    q = spark.createDataFrame([(1, [1.0, 0.1])], "query_id long, embedding array<double>")
    assert [r["chunk_id"] for r in search.knn(q, vectors.load(spark, path), 2).orderBy("rank").collect()] == ["a", "c"]
    vectors.ensure(spark, path, 3, recreate=True)
    assert vectors.load(spark, path).count() == 0


def test_embedding_cache(spark, tmp_path):
    key = lambda c: embedding.cache_key("m", "passage", True, c)
    empty = spark.createDataFrame([], "key string, embedding array<double>")
    docs = frame(spark, [(1, "a b"), (2, "a b"), (3, "c")])
    out, new = embedding.embed_cached(docs, "text", empty, lambda t: embedding.hash_vector(t, 8), key)
    assert new.count() == 2 and out.filter("embedding IS NULL").count() == 0
    path = f"file://{tmp_path}/c"
    for _ in range(2):
        embedding.save_cache(spark, path, new)
    cache = embedding.load_cache(spark, path)
    assert cache.count() == 2
    r = embedding.cache_report(frame(spark, [(1, "a b"), (2, "new"), (3, "new")]), "text", cache, key).first()
    assert (r["requests"], r["hits"], r["misses"]) == (3, 2, 1)


def test_models_are_checked(spark):
    docs = frame(spark, [(i, f"t{i}") for i in range(7)])
    good = embedding.model_embedding(F.col("text"), lambda: lambda ts: [[float(len(t)), 1.0] for t in ts], dim=2, batch=3)
    assert [list(r[0]) for r in docs.orderBy("chunk_id").select(good).collect()] == [[11.0, 1.0]] * 7
    bad = embedding.model_embedding(F.col("text"), lambda: lambda ts: [[1.0]], batch=3)
    with pytest.raises(Exception, match="don't match"):
        docs.select(bad).collect()


def test_checkpoints(spark, tmp_path):
    path, of = f"file://{tmp_path}/p", {"dataset": "d", "config": "c", "split": "s"}
    assert ingest.load_checkpoint(spark, path, **of) is None
    for last in (4, 9):
        ingest.save_checkpoint(spark, path, **of, last_row=last, records=last + 1)
    got = ingest.load_checkpoint(spark, path, **of)
    assert got["last_row"] == 9 and got["counts"] == {"records": 10}
    assert ingest.load_checkpoint(spark, path, dataset="other", config="c", split="s") is None
    ingest.reset_checkpoint(spark, path)
    assert ingest.load_checkpoint(spark, path, **of) is None


def test_progress(spark, tmp_path):
    docs, seen = spark.createDataFrame([(1, "a b", "en"), (2, "c", "en"), (2, "c", "de")], "doc_id long, text string, lang string"), []
    docs.coalesce(1).write.parquet(f"{tmp_path}/src")
    path = f"file://{tmp_path}/i"
    ingest.ingest_available(spark, f"{tmp_path}/src", docs.schema, path, id_col="doc_id", progress=seen.append)
    assert seen == [{"batch": 0, "records": 3, "added": 2, "skipped": 1}]
    assert [tuple(r) for r in ingest.progress_of(spark, path).collect()] == [(0, 3, 2, 1)]


def test_file_scan(spark, tmp_path):
    schema = "query_id string, target_lang string"
    for name, rows in (("b", [("3", "x")]), ("a", [("1", "x"), ("2", None)]), ("c", [])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/raw/{name}")
    (tmp_path / "raw" / "d.parquet").write_bytes(b"no parquet file")
    raw = readers.with_row_index(readers.raw_records(spark, f"{tmp_path}/raw"))
    assert [(r["row_index"], r["query_id"]) for r in raw.orderBy("row_index").collect()] == [(0, "1"), (1, "2"), (2, "3")]
    assert [r["query_id"] for r in readers.after_row(raw, 1).collect()] == ["3"]
    report = {r["file"].rsplit("/", 2)[-2 if "part-" in r["file"] else -1]: (r["rows"], r["failed"]) for r in readers.file_report(spark, f"{tmp_path}/raw").collect()}
    assert report["a"] == (2, False) and report["b"] == (1, False) and report["d.parquet"] == (0, True) and report.get("c", (0, False)) == (0, False)


def test_discovery(spark):
    root = "file:/data/set"
    names = ["validation/hinval.parquet", "data/validation-0.parquet", "data/de/validation-0.parquet", "fr/validation-0.parquet", "fr/train-0.parquet", "validation/readme.md", "x/validation/a.parquet"]
    listing = spark.createDataFrame([(f"{root}/{n}",) for n in names + names[:1]], "path string")
    found = lambda config: [r["file"] for r in readers.discover(listing, root, "validation", config).collect()]
    assert found("de") == ["data/de/validation-0.parquet", "data/validation-0.parquet", "validation/hinval.parquet"]
    assert found("fr") == ["data/validation-0.parquet", "fr/validation-0.parquet", "validation/hinval.parquet"]
    assert [r[0] for r in readers.configurations(listing, root, "validation").collect()] == ["de", "default", "fr"]


def test_loader_config():
    c = readers.LoaderConfig("set")
    assert c.resolved(50).backend == "sample" and c.resolved(101).backend == "files" and c.resolved(None).backend == "files" and c.resolved(5, " Files ").backend == "files"
    for bad in ({"dataset_name": " "}, {"dataset_name": "a", "split": ""}, {"dataset_name": "a", "sample_size": -1}, {"dataset_name": "a", "backend": "other"}):
        with pytest.raises(ValueError):
            readers.LoaderConfig(**bad)


def test_load_by_config(spark, tmp_path):
    spark.createDataFrame([(str(i),) for i in range(5)], "query_id string").coalesce(1).write.parquet(f"{tmp_path}/raw")
    c = readers.LoaderConfig("set")
    assert readers.load(spark, f"{tmp_path}/raw", c.resolved(3)).count() == 3 and readers.load(spark, f"{tmp_path}/raw", c.resolved(None)).count() == 5
    with pytest.raises(ValueError):
        readers.first_rows(frame(spark, DOCS), 101, "chunk_id")


def test_json_records_and_dictionaries(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"query_id": "1"}\nno json\n')
    raw = readers.raw_json(spark, f"{tmp_path}/r.json")
    assert raw.cache().filter("_corrupt_record IS NOT NULL").count() == 1
    (tmp_path / "t.json").write_text(json.dumps({"b": ["x", "y"], "a": []}))
    assert [tuple(r) for r in readers.term_dictionary(spark, f"{tmp_path}/t.json").collect()] == [(0, "b", ["x", "y"]), (1, "a", [])]
    (tmp_path / "p.json").write_text('{"source": "hi", "target": "en", "phrase": "a", "translation": "b"}\n')
    assert readers.phrase_dictionary(spark, f"{tmp_path}/p.json").first()["translation"] == "b"
