"""Null and large ids, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from textloom.llm import byte_bpe, cross_entropy, exact_dedup, jaccard_join, packing, pii, quality, spotsigs, token_files

tokenizers = pytest.importorskip("public_tokenizers")
BIG = 2**53 + 1
#: Column names that the operators use themselves.
SCHEMA = "doc_id long, text string, score string, n long, keep_id string, _key string, kind string, part string"
WORDS, RANKS = "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"
LONG = " ".join(f"word{i % 997} {i}" for i in range(60_000))
TEXTS = [(None, "write to a@b.co"), (BIG, "write to a@b.co"), (BIG + 2, None), (BIG + 4, ""), (BIG + 6, LONG), (7, "one two"), (7, "one two"), (7, "other words"), (None, None), (8, " \n\t ")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", "z", "k", "p") for i, t in rows], SCHEMA)


def labels(spark, column):
    return spark.createDataFrame([(7, 1), (7, 0), (BIG, 0), (None, 1), (BIG + 2, None)], f"doc_id long, {column} int")


def byte_path():
    return tokenizers.path(RANKS)


def word_path():
    return tokenizers.path(WORDS)


OPERATORS = {
    "quality": lambda s, d: quality.classify(d, labels(s, "quality")),
    "dedup": lambda s, d: exact_dedup.exact_dedup(d),
    "token_files": lambda s, d: token_files.stored_ids(d, word_path()),
    "pii": lambda s, d: pii.detect(d),
    "cross_entropy": lambda s, d: cross_entropy.difference(d, labels(s, "quality")),
    "jaccard": lambda s, d: jaccard_join.jaccard_classes(d),
    "spotsigs": lambda s, d: spotsigs.edited_likeness(d),
    "bpe": lambda s, d: byte_bpe.round_trip(d, byte_path()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(spark, name):
    got = OPERATORS[name](spark, frame(spark, TEXTS)).select("doc_id").collect()
    assert Counter(r[0] for r in got) == Counter(i for i, _ in TEXTS)
    assert OPERATORS[name](spark, frame(spark, [])).count() == 0


@pytest.mark.parametrize("model", [False, True])
def test_packing_against_first_principles(spark, model):
    """Each token of each row once, bins by best fit within each shard: the packing that the lengths of a shard give."""
    from tokenizers import Tokenizer

    rng = random.Random(4)
    rows = TEXTS + [(100 + i, " ".join(rng.choice(["one", "two"]) for _ in range(rng.choice([0, 3, 500, 900])))) for i in range(150)]
    plain = Tokenizer.from_file(word_path())
    tokens = lambda t: [*plain.encode(t or "", add_special_tokens=False).ids, 2] if model else [0] * (len((t or "").split()) + 1)
    got = packing.best_fit(frame(spark, rows), shard_tokens=100_000, model_path=word_path() if model else None).collect()
    want = Counter((i, k, k * 8192, tuple(x[k * 8192 : (k + 1) * 8192])) for i, t in rows for x in [tokens(t)] for k in range(-(-len(x) // 8192)))
    held = lambda r: tuple(np.frombuffer(r["ids"], "<u4").tolist()) if model else (0,) * r["n_tokens"]
    assert Counter((r["doc_id"], r["piece"], r["start"], held(r)) for r in got) == want and all(len(held(r)) == r["n_tokens"] for r in got)
    shards = {}
    for r in got:
        shards.setdefault(r["bin_id"] >> 32, {}).setdefault(r["bin_id"], []).append(r)
    for bins in shards.values():
        lengths = np.array(sorted((r["n_tokens"] for b in bins.values() for r in b), reverse=True))
        assert sorted(sum(r["n_tokens"] for r in b) for b in bins.values()) == sorted(packing.best_packing(lengths, packing.SIZES)[1].tolist())
        for b in bins.values():
            used = sum(r["n_tokens"] for r in b)
            assert sorted(r["position"] for r in b) == list(range(len(b))) and {r["bin_tokens"] for r in b} == {used}
            assert {r["capacity"] for r in b} == {min(s for s in packing.SIZES if s >= used)}
    assert packing.best_fit(frame(spark, []), model_path=word_path() if model else None).count() == 0


def test_stored_ids_against_the_library(spark):
    from tokenizers import Tokenizer

    plain, rng = Tokenizer.from_file(word_path()), random.Random(5)
    rows = [(i, " ".join(rng.choice(["Word,", "don't", "<|endoftext|>", "x<|startoftext|>.", "é́", "42", "\n", "日本"]) for _ in range(rng.randint(0, 30)))) for i in rng.sample(range(1000), 80)]
    rows += [(2000, None), (2001, LONG), (2002, rows[0][1])]
    got = {r["doc_id"]: r for r in token_files.stored_ids(frame(spark, rows), word_path()).collect()}
    start = 0
    for i, t in sorted(rows):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_shards_replace_those_of_a_lost_attempt(spark, tmp_path):
    docs = frame(spark, [(1, "one"), (2, "two")]).coalesce(1)
    first = token_files.write_shards(docs, f"file://{tmp_path}/s", word_path()).collect()
    assert token_files.write_shards(docs, f"file://{tmp_path}/s", word_path()).collect() == first
    manifest = spark.createDataFrame(first)
    wanted = spark.createDataFrame([(1,), (1,), (None,), (99,)], "doc_id long")
    assert [r["doc_id"] for r in token_files.fetch(spark, manifest, wanted).collect()] == [1]


def test_quality_against_its_definition(spark):
    """Scores by hand from the fitted weights: each row's features, expanded, through the logistic curve."""
    rng = random.Random(2)
    rows = [(i, "Good text here, with words. " * rng.randint(1, 9) if i % 3 else "BAD!! " * rng.randint(1, 9)) for i in range(90)]
    docs = frame(spark, rows + TEXTS)
    known = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)], "doc_id long, quality int")
    got = quality.classify(docs, known).collect()
    used = sorted(i for i in range(90) if zlib.crc32(str(i).encode()) % 5)
    text = {i: min([t for j, t in rows + TEXTS if j == i and t is not None] or [""], key=quality.features) for i in used}
    model = quality.fit(np.array([quality.features(text[i]) for i in used]), np.array([int(i % 3 > 0) for i in used]))
    want = Counter((i, round(float(model.probability(np.array([quality.features(t)]))[0]), 9)) for i, t in rows + TEXTS)
    assert Counter((r["doc_id"], round(r["score"], 9)) for r in got) == want
    latent = sorted(float(model.latent(np.array([quality.features(t)]))[0]) for _, t in rows + TEXTS)
    assert abs(sum(not r["kept"] for r in got) - 0.15 * len(latent)) <= 1 + latent.count(latent[int(0.15 * len(latent))])


def test_drop_copies_keeps_one_row_of_each_text(spark):
    rows = [(3, "b"), (5, "a"), (5, "b"), (5, "a"), (None, "b"), (None, "zz"), (None, "zz"), (9, None), (4, ""), (6, " a"), (6, "\ta")]
    left = exact_dedup.drop_copies(frame(spark, rows))
    assert left.columns == frame(spark, rows).columns
    assert sorted(((r["doc_id"], r["text"].strip() if r["text"] else "") for r in left.collect()), key=str) == sorted([(3, "b"), (5, "a"), (None, "zz"), (4, ""), (6, "a")], key=str)
    assert exact_dedup.drop_copies(frame(spark, [])).count() == 0


def test_keep_first_keeps_one_row_of_each_group(spark):
    base = [f"w{i}" for i in range(60)]
    near = [*base[:-1], "other"]
    rows = [(3, " ".join(base)), (3, " ".join(base)), (None, " ".join(near)), (5, " ".join(near)), (5, "something else that is short"), (None, "alone without an id"), (7, None), (8, ""), (8, "")]
    left = jaccard_join.keep_first(frame(spark, rows))
    assert left.columns == frame(spark, rows).columns
    assert sorted(((r["doc_id"], (r["text"] or "")[:9]) for r in left.collect()), key=str) == sorted([(3, "w0 w1 w2 "), (5, "something"), (None, "alone wit"), (7, ""), (8, "")], key=str)
    assert jaccard_join.keep_first(frame(spark, [])).count() == 0


def test_redact_keeps_rows(spark):
    left = pii.redact(frame(spark, TEXTS)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in left) == Counter((i, t and t.replace("a@b.co", "<EMAIL>")) for i, t in TEXTS)
    assert pii.redact(frame(spark, [])).count() == 0


def test_pii_spans_of_long_texts():
    text = "call john at example dot com or a@b.co, " * 4000
    base, added = pii.all_spans(text)
    assert len(base) == len(added) == 4000 and text[added[-1][1] : added[-1][2]] == "john at example dot com"


@pytest.mark.parametrize("text", ["schreib an max ät firma punkt de bitte", "max at firma punkt de", "ana arroba correo punto es", "luc arobase poste point fr", "ana [arroba] correo [punto] es", "jean point dupont arobase poste point fr"])
def test_disguises_of_other_languages(text):
    _, added = pii.all_spans(text)
    assert [k for k, _, _ in added] == ["email"]


@pytest.mark.parametrize("text", ["it broke at that point in time", "look at boiling point in it", "at this point of view", "un punto de vista", "auf den punkt gebracht", "at the dot in it"])
def test_no_disguise(text):
    assert pii.all_spans(text) == ([], [])


def test_copy_against_a_list_of_spans():
    """Spans of rewritten texts against one source span kept for each character."""
    rng = random.Random(8)
    for _ in range(400):
        text = "".join(rng.choice("abc de") for _ in range(rng.randint(1, 30)))
        copy, plain, spans = pii.Copy(text), text, [(i, i + 1) for i in range(len(text))]
        for _ in range(rng.randint(1, 4)):
            cuts = sorted(rng.sample(range(len(plain) + 1), min(len(plain) + 1, 2 * rng.randint(0, 3))))
            edits = [(a, b, rng.choice(["", "x", "yz"])) for a, b in zip(cuts[::2], cuts[1::2], strict=False) if b > a]
            copy.rewrite(edits)
            for a, b, new in reversed(edits):
                plain, spans = plain[:a] + new + plain[b:], spans[:a] + [(spans[a][0], spans[b - 1][1])] * len(new) + spans[b:]
        assert copy.text == plain
        for _ in range(10 if plain else 0):
            a = rng.randrange(len(plain))
            b = rng.randint(a + 1, len(plain))
            assert copy.source(a, b) == (spans[a][0], spans[b - 1][1])


def murmur(data: bytes, seed: int) -> int:
    """Spark's 32-bit hash of bytes: Murmur3, with the bytes beyond the last whole word mixed one by one."""
    m = 0xFFFFFFFF
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & m
    mix = lambda h, k: (rot(h ^ (rot(k * 0xCC9E2D51 & m, 15) * 0x1B873593 & m), 13) * 5 + 0xE6546B64) & m
    h, whole = seed & m, len(data) // 4 * 4
    for i in range(0, whole, 4):
        h = mix(h, int.from_bytes(data[i : i + 4], "little"))
    for b in data[whole:]:
        h = mix(h, (b - 256 if b > 127 else b) & m)
    h ^= len(data)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & m
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def spots(text):
    import regex

    words, out = [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w], set()
    for i, w in enumerate(words):
        if w in spotsigs.ANCHORS:
            h = murmur(w.encode(), 42)
            for x in [x for x in words[i + 1 : i + 9] if x not in spotsigs.ANCHORS][:3]:
                h = murmur(x.encode(), h)
            out.add(h)
        else:
            out.add(murmur(w.encode(), 42))
    return out


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def spot_texts():
    rng = random.Random(12)
    word = lambda: rng.choice(["the", "of", "la", "der"]) if rng.random() < 0.3 else f"w{rng.randrange(500)}é"
    texts = [" ".join(word() for _ in range(rng.choice([1, 3, 12, 90]))) for _ in range(30)]
    texts += [t + " more" for t in texts[:10]] + [texts[4], None, "", "...", LONG[:50_000]]
    return [(i, t) for i, t in enumerate(texts)]


def test_fingerprints_against_brute_force(spark):
    rows = spot_texts()
    got = {r["doc_id"]: r for r in spotsigs.edited_likeness(frame(spark, rows)).collect()}
    written = lambda s: ",".join(map(str, sorted(s)))
    for i, t in rows:
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        cut = len(t) // 4
        own, edited = spots(t), spots(t[: len(t) - cut] + after[:cut])
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (written(own), written(edited))
        assert (got[i]["near_edited"], got[i]["near_next"]) == pytest.approx((alike(own, edited), alike(own, spots(after))))


def test_near_classes_against_brute_force(spark):
    rows = [*spot_texts(), (4, "quite another text of that id"), (None, "w1 w2")]
    sets = [(i, spots(t or "")) for i, t in rows if i is not None]
    link = lambda x, y: bool(x) and bool(y) and alike(x, y) >= 0.8 - 1e-9
    want, reach = Counter(), [{k} for k in range(len(sets))]
    for k in range(len(sets)):
        todo = [k]
        while todo:
            x = todo.pop()
            for y in range(len(sets)):
                if y not in reach[k] and link(sets[x][1], sets[y][1]):
                    reach[k].add(y)
                    todo.append(y)
    for k, (i, s) in enumerate(sets):
        want[i, len(s), sum(link(s, y) for j, (_, y) in enumerate(sets) if j != k), min(sets[j][0] for j in reach[k])] += 1
    got = spotsigs.near_classes(frame(spark, rows))
    assert Counter(tuple(r) for r in got.select("doc_id", "n_signatures", "n_links", "component_id").collect()) == want
    assert spotsigs.near_classes(frame(spark, [])).count() == 0


def test_fingerprints_are_native(spark):
    for df in (spotsigs.edited_likeness(frame(spark, TEXTS)), spotsigs.near_classes(frame(spark, TEXTS))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan


def test_work_path_needs_a_shared_folder(spark, monkeypatch):
    from textloom.llm import common

    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.work_path(Session, "x")
