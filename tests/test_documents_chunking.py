import hashlib
import json
import random

from pyspark.sql import functions as F

from textloom.operators import chunking, documents


def chunks(spark, texts, config, **kw):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "document_id string, text string")
    return [r for r in chunking.chunk_documents(df, config, **kw).orderBy("document_id", "chunk_index").collect()]


def test_fixed(spark):
    c = chunking.ChunkConfig(4, 1, strategy="fixed")
    got = chunks(spark, ["one two three four five six seven eight nine ten"], c)
    assert [r["text"] for r in got] == ["one two three four", "four five six seven", "seven eight nine ten"]
    want = hashlib.sha1(json.dumps(["0", "fixed", 1, "four five six seven"], separators=(",", ":")).encode()).hexdigest()[:20]
    assert got[1]["chunk_id"] == f"0--fixed-0001-{want}"


def test_fixed_short_tail(spark):
    assert [r["text"] for r in chunks(spark, ["a b c d e f g"], chunking.ChunkConfig(3, 0, min_size=2, strategy="fixed"))] == ["a b c", "d e f", "e f g"]


def test_sentence(spark):
    c = chunking.ChunkConfig(5, 0, strategy="sentence")
    assert [r["text"] for r in chunks(spark, ["One two. Three four five. Six seven."], c)] == ["One two. Three four five.", "Six seven."]
    assert len(chunks(spark, ["a b c d e f g h"], chunking.ChunkConfig(3, 0, strategy="sentence"))) == 3


def test_repeats_close_up(spark):
    assert [r["text"] for r in chunks(spark, ["Repeat this. Repeat this."], chunking.ChunkConfig(2, 0))] == ["Repeat this."]


def test_semantic(spark):
    vectors = lambda ss: [[1, 0], [1, 0], [0, 1], [0, 1]]
    got = chunks(spark, ["A b. C d. E f. G h."], chunking.ChunkConfig(64, 0, threshold=0.8, strategy="semantic"), embed=vectors)
    assert [r["text"] for r in got] == ["A b. C d.", "E f. G h."]


def packed(sentences, most, overlap):
    out, cur, n = [], [], 0
    for s in sentences:
        k = len(s.split())
        if cur and n + k > most:
            out.append(" ".join(cur))
            keep, m = [], 0
            for p in reversed(cur):
                if m + len(p.split()) > overlap:
                    break
                keep, m = [p, *keep], m + len(p.split())
            cur, n = keep, m
        cur, n = [*cur, s], n + k
    return [*out, " ".join(cur)] if cur else out


def test_sentence_overlap_against_plain_python(spark):
    rng = random.Random(4)
    texts = [[" ".join(f"w{rng.randrange(10**9)}" for _ in range(rng.randint(1, 5))) + "." for _ in range(rng.randint(1, 12))] for _ in range(40)]
    got = chunks(spark, [" ".join(t) for t in texts], chunking.ChunkConfig(9, 4, strategy="sentence"))
    for i, t in enumerate(texts):
        assert [r["text"] for r in got if r["document_id"] == str(i)] == packed(t, 9, 4)


def test_normalize(spark):
    rows = [
        ("42", "hin_Deva", ([1, 0], ["one", "two"], ["एक ", " "])),
        ("43", None, ([], ["  ", None], [])),
        ("44", None, None),
    ]
    df = spark.createDataFrame(rows, "query_id string, target_lang string, passages struct<is_selected:array<int>,English_passages:array<string>,Translated_passages:array<string>>")
    got = documents.normalize_records(df, dataset_name="d").orderBy("source.passage_index").collect()
    assert [(r["text"], r["source"]["text_source"], r["source"]["is_selected"]) for r in got] == [("एक", "translated", 1), ("two", "english_fallback", 0)]
    want = hashlib.sha1(json.dumps(["d", "default", "validation", "42", 1, "two"]).encode()).hexdigest()[:20]
    assert got[1]["document_id"] == f"doc-{want}"


def test_deduplicate(spark):
    df = spark.createDataFrame([(3, "en", "A b"), (1, "en", "a B"), (2, None, "a b"), (4, None, "A B")], "id int, language string, text string")
    assert sorted(r[0] for r in documents.deduplicate(df, "id").collect()) == [1, 2]
    assert documents.allow_languages(df, ["de"]).count() == 2
    assert documents.ingest_counts(df.filter(F.lit(False)), "id").first().asDict() == {"records": 0, "empties": 0, "duplicates": 0, "kept": 0}
