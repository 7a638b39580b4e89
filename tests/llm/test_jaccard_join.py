import random
import re

import numpy as np
import pytest

from textloom.llm import components as C
from textloom.llm import jaccard_join as J


def brute(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def rows(count=300):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 5, 6, 8, 12, 30, 60]))] for _ in range(12)]
    out = []
    for k in range(count):
        b = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            b[rng.randrange(len(b))] = f"w{rng.randrange(400)}"
        out.append((k, " ".join(b)))
    return [*out, (700, None), (701, ""), (702, "  \n"), (703, out[3][1].upper()), (704, out[3][1] + " ")]


@pytest.mark.parametrize(("n", "num", "den", "options"), [(4, 85, 100, {}), (2, 8, 10, {}), (2, 8, 10, {"region_shingles": 60, "block_shingles": 40})])
def test_against_brute_force(spark, n, num, den, options):
    data = rows()
    got = J.jaccard_classes(spark.createDataFrame(data, "doc_id long, text string"), n=n, num=num, den=den, **options).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(data, n, num, den)


def test_edges(spark):
    schema = "doc_id long, text string, component_id string"
    assert J.jaccard_classes(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f", ""), (2, "a b c d e f", ""), (9, "a b c d e f", ""), (9, "x y z", ""), (9, "x y z", ""), (4, "x y z", "")], schema)
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in J.jaccard_classes(df).collect())
    assert [g for g in got if g[0] == "None"] == [("None", "None")] and ("2", "2") in got and len(got) == 6
    kept = J.keep_first(spark.createDataFrame(rows(), "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in brute(rows(), 5, 8, 10).items() if i == c}


def test_null_id_before_a_linked_text(spark):
    words = [f"w{i}" for i in range(60)]
    near = [*words[:59], "other"]
    df = spark.createDataFrame([(None, " ".join(words)), (7, " ".join(words)), (8, " ".join(near))], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["component_id"] for r in J.jaccard_classes(df, n=2, num=8, den=10).collect()}
    assert got == {None: None, 7: 7, 8: 7}
    # the row without an id is a copy like others and comes after them
    assert {r["doc_id"] for r in J.keep_first(df, n=2, num=8, den=10).collect()} == {7}


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (102, 100), (7, 7), (50, 50)]
    got = {r["node"]: r["component"] for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100, 50: 50}


def test_a_region_gives_fewer_links_than_it_has_members():
    rng = np.random.default_rng(3)
    base = np.arange(100)
    sets = [np.unique(np.concatenate((rng.choice(base, 88, replace=False), rng.integers(1000, 1100, 4)))).astype(np.uint64) for _ in range(200)]
    a, b = (np.concatenate(x).tolist() for x in zip(*J.Region(list(range(200)), sets, 8, 10).links(), strict=True))
    assert 0 < len(a) < 200

    def parts(edges):
        label = list(range(200))
        for x, y in edges:
            label = [label[x] if v == label[y] else v for v in label]
        return [label.index(v) for v in label]

    like = lambda x, y: 10 * len(np.intersect1d(x, y)) >= 8 * len(np.union1d(x, y))
    assert parts(zip(a, b, strict=True)) == parts([(i, j) for i in range(200) for j in range(i) if like(sets[i], sets[j])])


def test_repeated_ids_with_texts_that_have_no_words(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (1, " "), (1, None), (2, " ".join([*words[:59], "other"])), (2, ""), (3, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in J.jaccard_classes(df, n=2, num=8, den=10).collect()}
    assert got == {(1, 59): 1, (1, 0): 1, (2, 59): 1, (2, 0): 2, (3, 0): 3}


def test_profiles_part_what_cannot_link():
    rng = np.random.default_rng(4)
    sets = []
    for size in (1, 5, 30, 130, 300, 900):
        for _ in range(6):
            own = rng.integers(0, 1 << 64, size, dtype=np.uint64)
            sets += [np.unique(np.concatenate((own[: size - cut], rng.integers(0, 1 << 64, cut, dtype=np.uint64)))) for cut in (0, size // 20, size // 9, size // 7, size // 2)]
    sets.sort(key=len)
    part = J.alike(np.array([len(s) for s in sets]), [J.profile(s) for s in sets], 8, 10)
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if 10 * len(np.intersect1d(sets[i], sets[j])) >= 8 * len(np.union1d(sets[i], sets[j]))]
    assert len(linked) > 30 and all(part[i] == part[j] for i, j in linked)
    assert len(np.unique(part)) >= 36  # no two of the 36 texts that have nothing in common


def test_texts_that_meet_by_chance_are_not_sent(spark, monkeypatch):
    # 400 texts share one five-word line and nothing else; ten have a near copy each
    rng, line = random.Random(6), "under the terms of licence"
    own = [[f"w{rng.randrange(10**6)}" for _ in range(90)] for _ in range(400)]
    data = [(i, f"{line} {' '.join(w)}") for i, w in enumerate(own)] + [(1000 + i, f"{line} {' '.join(w[:-1])} other") for i, w in enumerate(own[:10])]
    sent, joined = [], J._joined
    monkeypatch.setattr(J, "_joined", lambda rows, *a: sent.append(rows.count()) or joined(rows, *a))
    monkeypatch.setattr(J, "_large", None)  # the line's region is over the limit, its parts are not
    df = spark.createDataFrame(data, "doc_id long, text string")
    for options in ({}, {"block_buckets": 1 << 10}):
        sent.clear()
        got = {r["doc_id"]: r["component_id"] for r in J.jaccard_classes(df, region_shingles=1000, **options).collect()}
        assert got == {i: i % 1000 for i, _ in data}
        assert sent == [20]
