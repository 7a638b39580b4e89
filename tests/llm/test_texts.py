"""Toxicity, quality, personal data, byte BPE, token shards, cross-entropy, packing, fingerprints."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from textloom.llm import byte_bpe, cross_entropy, packing, pii, quality, spotsigs, token_files, toxicity

tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, score string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], SCHEMA)


def test_kernel_tolerates_gaps():
    marks = toxicity.Landmarks(["idiot"])
    got = marks(["idiot", "xidiotx", "idxiot", "idea", "a" * 60 + "idiot"])
    value = {i: v[0] for i, v in got.items()}
    assert value[0] == pytest.approx(1) and value[1] == pytest.approx(1) and 0.3 < value[2] < 1 and 3 not in value and value[4] == pytest.approx(1)


def slow_kernel(s, t, p, d):
    from itertools import combinations

    f = lambda x: [(tuple(x[i] for i in c), d ** (c[-1] - c[0] + 1)) for c in combinations(range(len(x)), p)]
    return sum(a * b for u, a in f(s) for v, b in f(t) if u == v)


def test_kernel_against_its_definition():
    for s, t in (("gatta", "cata"), ("aaaa", "aaa"), ("abc", "xyz")):
        got = toxicity.kernel(toxicity._letters([s], 8), toxicity._letters([t], 8), 3, 0.6)[0]
        assert got == pytest.approx(slow_kernel(s, t, 3, 0.6))


def test_kernel_is_cut_by_its_value_only():
    marks = toxicity.Landmarks(["idiot", "moron", "stupid"])
    rng = random.Random(9)
    words = ["idxxioyyt", "moxxroyyn", "", "abc"]
    for _ in range(600):
        w = list(rng.choice(marks.strings))
        for _ in range(rng.randint(0, 5)):
            w.insert(rng.randrange(len(w) + 1), rng.choice("idotmrnxyz"))
        words.append("".join(w))
    got = marks(words)
    assert 0 in got and 1 in got
    for i, w in enumerate(words):
        for k, s in enumerate(marks.strings):
            want = min(1, slow_kernel(w, s, 4, 0.6) / slow_kernel(s, s, 4, 0.6))
            assert got.get(i, {}).get(k, 0) == (pytest.approx(want) if want >= 0.1 else 0)


@pytest.mark.parametrize("text", ["you i  d  i  o  t now", "i - d - i - o - t", "i. d. i. o. t.", "i . d . i . o . t", "so i d i o t"])
def test_spelled_words(text):
    ((got, n),) = toxicity.Reader(toxicity.Landmarks(["idiot"])).sentences([text])
    assert got == [({0: pytest.approx(1)}, 1)] and n == len(text.split(" "))


def test_single_letters_keep_sentences_apart():
    ((got, _),) = toxicity.Reader(toxicity.Landmarks(["idiot", "moron"])).sentences(["an idiot in plan b. I saw a moron and an idiot"])
    assert got == [({0: pytest.approx(1)}, 1), ({0: pytest.approx(1), 1: pytest.approx(1)}, 2)]


def toxic_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(3, 9)))
    rows = []
    for i in range(240):
        w = [word() for _ in range(40)]
        if i % 3 == 0:
            w[rng.randrange(40)] = rng.choice(["idiot", "moron", "idiots"])
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    return rows


def test_toxicity(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, ""), (901, "", ""), (902, "you i d i o t now", "")], SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    held = [(got[i]["predicted"], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(p == y for p, y in held) / len(held) > 0.95 and got[900]["score"] == got[901]["score"] and got[902]["predicted"] == 1
    assert {tuple(r) for r in toxicity.classify(docs, labels.limit(0)).select("score", "predicted").collect()} == {(0.0, 0)}
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns and toxicity.drop_toxic(docs, labels.limit(0)).count() == docs.count()
    assert toxicity.classify(docs.limit(0), labels).count() == 0 == toxicity.drop_toxic(docs.limit(0), labels).count()


def test_toxicity_edges(spark):
    """Null ids beside large ones, repeated rows and ids, very long texts, labels that repeat, against scores by hand."""
    rows, big = toxic_rows(), 2**53 + 1
    long = "quiet words " * 60_000
    odd = [(None, "an idiot", ""), (big, "an idiot", ""), (big, "an idiot", ""), (big + 2, long + "idiot", ""), (big + 4, long, ""), (5, None, ""), (None, None, "")]
    docs = spark.createDataFrame([(i, t, "") for i, t, _ in rows] + odd, SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    assert "idiot" in model.marks.strings and "moron" in model.marks.strings
    reader = toxicity.Reader(model.marks)
    want = Counter((i, round(model.scores(list(reader.sentences([t or ""])))[0], 12)) for i, t, _ in [(i, t, "") for i, t, _ in rows] + odd)
    assert Counter((r[0], round(r[1], 12)) for r in toxicity.classify(docs, labels).select("doc_id", "score").collect()) == want
    left = Counter((r[0], r[1]) for r in toxicity.drop_toxic(docs, labels).select("doc_id", "text").collect())
    assert left[5, None] == 1 and left[None, None] == 1 and not left[big, "an idiot"] and not left[None, "an idiot"] and left[big + 4, long]
    sample = toxicity.labelled_sample(docs.unionByName(docs), labels, "toxic", toxicity.F.lit(True), (20, 10)).collect()
    assert len(sample) == 30 and len({r["doc_id"] for r in sample}) == 30


def test_landmarks_ignore_copies(spark):
    word = random.Random(5)
    text = lambda: " ".join(f"{word.choice('bcdfg')}{word.randrange(10**6)}" for _ in range(12))
    copied = text() + " passage " + text()
    rows = [(i, copied, 1) for i in range(40)] + [(100 + i, f"{text()} moron {text()}", 1) for i in range(20)] + [(200 + i, text(), 0) for i in range(60)]
    found = {g: (t, c) for g, t, c in toxicity.candidates(spark.createDataFrame(rows, "doc_id long, text string, y int"), 4, 500)}
    assert found["moron"] == (20, 0) and "passage" not in found


def test_bradley_terry(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] - x[:, 1] > 0).astype(int)
    m = quality.fit(x, y)
    assert ((m.probability(x) > 0.5) == (y == 1)).mean() > 0.95
    rows = [(i, "Good text here, with words." * 3 if i % 2 else "BAD!! BAD!! " * 9, i % 2) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "") for i, t, _ in rows] + [(99, None, ""), (98, "", "")], SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert all(got[i]["predicted"] == y for i, _, y in rows) and got[98]["score"] == got[99]["score"]
    assert quality.classify(docs.limit(0), labels.limit(0)).count() == 0


def test_pii_base_against_patterns():
    email, ip, card = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+")
    rng = random.Random(1)
    for _ in range(5000):
        t = "".join(rng.choice(["@", ".", "a", "b1", "1", "23", "255", "-", " ", "+", "(", ")", "4111111111111111", "x@y.z", "é", "10.0.0.1"]) for _ in range(rng.randint(0, 25)))
        want = [("email", *m.span()) for m in email.finditer(t)]
        want += [("ip", *m.span()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in card.finditer(t):
            d = re.sub("[^0-9]", "", m[0])
            if 13 <= len(d) <= 19 and pii.luhn(d):
                want.append(("card", *m.span()))
        want += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]
        assert pii.plain_spans(t) == want


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john [at] example [dot] com now", "email", "john [at] example [dot] com"), ("see john at example dot com", "email", "john at example dot com"), ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("call plus one two three four five six seven eight nine", "phone", "plus one two three four five six seven eight nine"), ("４111 1111 1111 1111", "card", "４111 1111 1111 1111"), ("192 dot 168 dot 0 dot 1", "ip", "192 dot 168 dot 0 dot 1"),
    ],
)
def test_pii_disguises(text, kind, found):
    base, added = pii.all_spans(text)
    assert [(k, text[a:b]) for k, a, b in base + added] == [(kind, found)]


@pytest.mark.parametrize(
    ("text", "left"),
    [
        ("to jоhn@example.com now", "to <EMAIL> now"), ("jane.dоe@example.com", "<EMAIL>"), ("ask anna at example dot ch", "ask <EMAIL>"), ("anna at mail dot example dot ca, hi", "<EMAIL>, hi"),
        ("see john dot doe at example dot com", "see <EMAIL>"), ("j dot r dot doe [at] example [dot] com", "<EMAIL>"), ("look at the dot in it", "look at the dot in it"), ("a b@c.de and d@e.fr", "a <EMAIL> and <EMAIL>"),
    ],
)
def test_pii_whole_addresses(text, left):
    base, added = pii.all_spans(text)
    assert pii.masked(text, base + added) == left and set(pii.plain_spans(text)) == set(base)


def test_pii_frames(spark):
    df = frame(spark, [None, "", "a@b.co", "look at the dot on it", "a@b.co"])
    got = [r for r in pii.detect(df).orderBy("doc_id").collect()]
    assert [r["spans"] for r in got] == ["", "", "email:0:6", "", "email:0:6"] and got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert [r["text"] for r in pii.redact(df).orderBy("doc_id").collect()] == [None, "", "<EMAIL>", "look at the dot on it", "<EMAIL>"]


ODD = [" ", "  ", "\n", "\t", "'", "s", "t", "re", "ve", "ll", "d", "a", "A", "é", "1", "!", "日本", "😀", "'S", "\x1c", " 's", "\n's", "''s", "İ", "...", "don't", "́"]


def test_byte_bpe(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coder = byte_bpe.ByteBPE.from_file(open(path, "rb").read())
    own = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    rng = random.Random(2)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + ["ab" * 3000]
    for t, ids in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(t) and coder.decode(ids) == t.encode()
        assert coder.offsets(ids)[-1] == len(t.encode())
    got = byte_bpe.round_trip(frame(spark, [None, "", "a b"]), path).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == [0, 0, 2] and got[2]["decoded_sha256"] == hashlib.sha256(b"a b").hexdigest()
    pair = byte_bpe.decode(byte_bpe.encode(frame(spark, ["x y"]), path), path).first()
    assert bytes(pair["decoded"]) == b"x y"


def test_word_coder():
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    coder, plain = token_files.WordCoder(open(path, "rb").read()), Tokenizer.from_file(path)
    rng = random.Random(3)
    signs = ["Word", "wörd", "ÄÖ", "µ", "x1", ", ", ". ", ".\n", ",", ".", "! ", "'s ", "_", "$", "ß", "<|endoftext|>", "<|ENDOFTEXT|>", "\x85", "\xa0", "²", "İ", "Σ "]
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + ["word, Word. " * 50, "z" * 500]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 8))) for _ in range(6000)]
    for t, ids in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_shards(spark, tmp_path):
    path = tokenizers.path("word_bpe_49k.json")
    texts = [None, "", "one two", "three " * 40, "one two"]
    manifest = token_files.write_shards(frame(spark, texts), f"file://{tmp_path}/s", path, frame_ids=16)
    got = token_files.read_shards(manifest, zlib.crc32).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == [1, 1, 3, 41, 3] and [r["start"] for r in got] == [0, 1, 2, 5, 46]
    wanted = spark.createDataFrame([(3,), (1,), (77,)], "doc_id long")
    assert {r["doc_id"]: len(r["ids"]) for r in token_files.fetch(spark, manifest, wanted).collect()} == {3: 41, 1: 1}
    assert token_files.write_shards(frame(spark, []), f"file://{tmp_path}/e", path).count() == 0
    shard = next((tmp_path / "s").glob("*.tlz"))
    raw = bytearray(shard.read_bytes())
    raw[12] ^= 255
    shard.write_bytes(raw)
    with pytest.raises(Exception):  # noqa: B017
        list(token_files.ShardReader(token_files._Source(f"file://{shard}")).documents())


def test_cross_entropy(spark):
    texts = ["the cat sat on the mat"] * 20 + ["dog runs far away now"] * 20 + [None, "", "the cat sat"]
    df = frame(spark, texts)
    good = spark.createDataFrame([(i,) for i in range(20)], "doc_id long")
    got = {r["doc_id"]: r for r in cross_entropy.difference(df, good).collect()}
    assert got[42]["score"] > 0 > got[25]["score"] and got[40]["n_tokens"] == 0 and got[41]["score"] == 0
    assert cross_entropy.difference(df.limit(0), good).count() == 0
    assert all(r["target_loss"] == 0 or r["target_loss"] > 0 for r in cross_entropy.difference(df, good.limit(0)).collect())


def test_cross_entropy_counts_every_word_and_pair(spark):
    rng = random.Random(4)
    word = lambda: f"w{int(rng.paretovariate(0.7)) if rng.random() < 0.6 else rng.randrange(40000)}"
    texts = [" ".join(word() for _ in range(rng.choice([0, 1, 60, 200]))) for _ in range(500)] + [None, " ".join(word() for _ in range(20_000))]
    texts += [texts[7], texts[8], texts[8]]
    good = {i for i in range(500) if i % 7 == 0}
    n, first, follow = ([Counter(), Counter()] for _ in range(3))
    pairs = [Counter(), Counter()]
    for i, t in enumerate(texts):
        w = (t or "").split()
        for k in range(1 + (i in good)):
            n[k].update(w)
            first[k].update(["", *w][:-1] if w else [])
            pairs[k].update(zip(["", *w], w, strict=False))
    for k in (0, 1):
        follow[k].update(a for a, _ in pairs[k])
    assert len(n[0]) > 8300

    def loss(k, a, b):
        own = (n[k][b] + 0.5) / (sum(n[k].values()) + 0.5 * len(n[0]))
        return -np.log(own if not first[k][a] else (0.75 * follow[k][a] * own + max(pairs[k][a, b] - 0.75, 0)) / first[k][a])

    ids = spark.createDataFrame([(i,) for i in good], "doc_id long")
    rows = cross_entropy.difference(frame(spark, texts), ids.unionByName(ids), block_tokens=5000).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = (texts[r["doc_id"]] or "").split()
        want = [sum(loss(k, a, b) for a, b in zip(["", *w], w, strict=False)) / max(1, len(w)) for k in (1, 0)]
        assert (r["n_tokens"], r["target_loss"], r["background_loss"]) == pytest.approx((len(w), *want)) and r["score"] == pytest.approx(want[1] - want[0])


def test_packing(spark):
    rng = random.Random(1)
    n = [rng.randint(0, 40) for _ in range(300)] + [200, 129]
    df = frame(spark, [" ".join("w" * k) if k else None for k in n])
    got = packing.best_fit(df, sizes=(16, 32, 64), shard_tokens=2000).toPandas()
    assert got.groupby("doc_id")["n_tokens"].sum().to_dict() == {i: k + 1 for i, k in enumerate(n)}
    bins = got.groupby("bin_id").agg(cap=("capacity", "first"), used=("n_tokens", "sum"), said=("bin_tokens", "first"))
    assert (bins.used == bins.said).all() and (bins.cap == [next(s for s in (16, 32, 64) if s >= u) for u in bins.used]).all()
    assert bins.used.sum() / bins.cap.sum() > 0.95 and packing.best_fit(df.limit(0)).count() == 0


def test_packing_tries_every_set_of_sizes():
    rng = random.Random(12)
    for _ in range(60):
        n = np.array(sorted((min(8192, int(rng.lognormvariate(6, 1.2)) + 1) for _ in range(rng.randint(3, 60))), reverse=True))
        _, used = packing.best_packing(n, packing.SIZES)
        least = min(packing.packed(n, c, packing.SIZES)[2] for k in range(1, 1 + len(packing.SIZES)) for c in combinations(packing.SIZES, k))
        assert sum(packing.cost(packing.fitted(int(u), packing.SIZES)) for u in used) == least


def test_edited_likeness(spark):
    rng = random.Random(6)
    common = ["the", "of", "and", "der", "la"]
    text = lambda k: " ".join(rng.choice(common) if rng.random() < 0.3 else f"w{rng.randrange(9999)}" for _ in range(k))
    texts = [text(rng.choice([1, 5, 80, 300])) for _ in range(40)] + [None, ""]
    texts += [texts[3]]
    got = spotsigs.edited_likeness(frame(spark, texts)).orderBy("doc_id").collect()
    plain = [t or "" for t in texts]
    for i, r in enumerate(got):
        t, nxt = plain[i], plain[(i + 1) % len(plain)]
        q = len(t) // 4
        assert r["edited_sha256"] == hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest() and r["n_chars"] == len(t)
    assert got[3]["fingerprint"] == got[-1]["fingerprint"] and got[40]["fingerprint"] == "" and got[40]["near_next"] == 1.0
    assert spotsigs.edited_likeness(frame(spark, [])).count() == 0
    one = spotsigs.edited_likeness(frame(spark, ["the cat sat down"])).first()
    assert one["near_next"] == 1.0


def test_near_fingerprints(spark):
    rng = random.Random(8)
    base = [sorted(rng.sample(range(1000), 30)) for _ in range(5)]
    sets = [sorted(set(b) - set(rng.sample(b, k)) | set(rng.sample(range(1000, 2000), k))) for b in base for k in (0, 0, 1, 2, 3, 5)] + [[], []]
    members, pairs = spotsigs.near_fingerprints(spark.createDataFrame(list(enumerate(sets)), "doc_id long, signature array<int>"))
    rep = {r["doc_id"]: r["rep"] for r in members.collect()}
    assert all(sets[i] == sets[j] and j == min(k for k in rep if sets[k] == sets[i]) for i, j in rep.items())
    want = {(i, j) for i in set(rep.values()) for j in set(rep.values()) if i < j and sets[i] and len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want


@pytest.mark.parametrize("size", [63, 127, 500])
def test_fingerprints_of_near_copies_at_any_length(spark, size):
    words = [f"w{i}" for i in range(size)]
    mixed = [w if i % 4 else "the" for i, w in enumerate(words)]
    texts = [" ".join(x) for w in (words, mixed) for x in (w, [*w, "more"])]
    prints = spotsigs.fingerprints(frame(spark, texts))
    _, pairs = spotsigs.near_fingerprints(prints, 0.8)
    assert {(r["a"], r["b"]) for r in pairs.collect()} >= {(0, 1), (2, 3)}
