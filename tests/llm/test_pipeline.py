import random

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"
LABELS = "doc_id long, quality int, toxic int"
GOOD = " ".join(f"word{i}" for i in range(60))
BIG = 2**53 + 1
DOCS = [
    (1, GOOD), (2, GOOD), (3, GOOD + " more"), (4, "you total idiot"), (5, "write to a@b.co please"), (6, None), (7, ""), (8, " \n"), (8, "the same id"), (8, "another text"), (BIG, "one text"), (BIG, "one text"),
    (None, "one text"), (None, "no id"), (None, "no id"), (None, GOOD + " end"), (9, "call john at example dot com now"), (10, " ".join(f"long{i}" for i in range(30_000))),
]


def word(rng):
    return "".join(rng.choice("abcdefghklmnoprstuvw") for _ in range(rng.randint(3, 9)))


def train():
    rng = random.Random(5)
    rows = []
    for i in range(160):
        text = [word(rng) for _ in range(30)]
        if i % 2:
            text[rng.randrange(30)] = rng.choice(["idiot", "idiots", "moron"])
        rows.append((1000 + i, " ".join(text), i % 2))
    return rows


def tables(spark, path, docs, labelled=True):
    rows = [(i, t, "en", "s", len(t or ""), "x") for i, t in docs + [r[:2] for r in train()]]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in train()] if labelled else [], LABELS).write.parquet(f"{path}/labels.parquet")


def stages(spark, cp, path):
    """Rows (doc_id, text) after each of the first four stages, and the last stage's rows."""
    out, docs = [], spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in cp.STAGES:
        got = stage(spark, docs, path)
        if name != cp.STAGES[-1][0]:
            assert got.columns == docs.columns
        got.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        out.append(docs.collect())
    return out


def test_stages(spark, tmp_path):
    cp = pytest.importorskip("corpus_pipeline")
    tables(spark, tmp_path, DOCS)
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "pii", "best_fit_packing"]
    toxic, exact, near, pii, packed = stages(spark, cp, str(tmp_path))
    own = lambda rows: sorted(((r["doc_id"], r["text"]) for r in rows if r["doc_id"] is None or not 1000 <= r["doc_id"] < 2000), key=str)
    left = [d for d in DOCS if d[0] != 4]
    assert own(toxic) == sorted(left, key=str) and sum(1000 <= (r["doc_id"] or 0) < 2000 for r in toxic) in range(75, 90)
    for gone in ((2, GOOD), (7, ""), (BIG, "one text"), (None, "one text"), (None, "no id")):
        left.remove(gone)  # the null text of 6 and the empty one of 7 are one, and 6 comes first
    assert own(exact) == sorted(left, key=str)
    for gone in ((3, GOOD + " more"), (None, GOOD + " end")):
        left.remove(gone)
    assert own(near) == sorted(left, key=str)
    masked = {"write to a@b.co please": "write to <EMAIL> please", "call john at example dot com now": "call <EMAIL> now"}
    assert own(pii) == sorted(((i, masked.get(t, t)) for i, t in left), key=str) and all(r["n_chars"] == len(r["text"]) for r in pii if r["text"] is not None)
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    plain, ids = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json")), {}
    for r in sorted(packed, key=lambda r: r["start"]):
        ids.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    for i in (1, 5, 9, 10, BIG):
        text = next(r["text"] for r in pii if r["doc_id"] == i)
        assert ids[i] == [*plain.encode(text, add_special_tokens=False).ids, 2]
    assert sum(map(len, ids.values())) == sum(len(plain.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in pii)
    assert sorted(map(len, [packed, cp.run(spark, str(tmp_path)).collect()])) == [len(packed)] * 2


def test_stages_without_labels_or_rows(spark, tmp_path):
    cp = pytest.importorskip("corpus_pipeline")
    tables(spark, f"{tmp_path}/a", DOCS, labelled=False)
    toxic = cp.STAGES[0][1](spark, spark.read.parquet(f"{tmp_path}/a/documents.parquet"), f"{tmp_path}/a")
    assert toxic.count() == len(DOCS) + 160
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/b/labels.parquet")
    assert cp.run(spark, f"{tmp_path}/b").count() == 0
