"""Exact n-gram Jaccard join in the metric space of shingle sets, with components of the links.

Jaccard distance is a metric, so a pivot p bounds every pair: |d(x,p) - d(y,p)| <= d(x,y). In text almost all
distances are close to 1, where Voronoi regions around sampled pivots replicate everything; pivots must lie near
what they split. They are therefore seeded without loss. Sets x and y of sizes n <= m with similarity of at least
t differ in at most k = floor((1-t)/(1+t) * (n+m)) shingles. The space of shingle hashes is cut into more than k
ranges; x and y then agree on one of the first k + 1 ranges that either fills (each range that differs costs one
of the k). Sets that agree on a range share a cell; the cell's least document is its pivot, and all cells of a
pivot are its region. Each linked pair lies in one region.

Texts also meet by chance, in cells of a single common shingle, and ever more of them the larger the corpus is. So
before any text is sent, a region is split by its members' profiles, the counts of their shingles in buckets: the
sum of differences of two profiles is at most the number of shingles in which the sets differ. Members that this
bound lets link, directly or over others, stay together, under the least of them as their pivot; a member that can
link with no other is dropped. No link is lost by it. A region is then joined exactly:

1. distances to the pivot; members within the radius link to it, so they are connected among themselves;
2. others (Z) can link only to others or to members in a window: d(y,p) >= min d(z,p) - radius. Z and the
   window's members, replicated from the core, form a smaller region with a pivot out of Z; and so on.

Small regions do this in memory. In a large one the first step is distributed; a remainder that is still large
is cut into rings of the pivot distance, each as wide as the radius, so that only neighbouring rings are joined,
block against block. Equal sets are one point throughout: their documents join through their digest.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import one_of_each, ship, shuffle_width, staged
from textloom.llm.components import components

_U = np.uint64
_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], _U)
_CACHE_WORDS, _SEEN_SETS = 1 << 18, 1 << 16
_ROW_SETS, _REGION_SHINGLES, _BLOCK_SHINGLES = 512, 1 << 20, 1 << 18
_BUCKET_SHINGLES, _LEAST_BUCKETS, _BLOCK_BUCKETS = 8, 32, 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that scatters its input."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Distinct word n-grams of a text as sorted 64-bit hashes."""

    def __init__(self, n: int):
        self.n, self.words = n, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, _U)
        known = self.words
        if len(known) > _CACHE_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), _U, len(words))
        k = min(self.n, len(words))
        total = np.full(len(words) - k + 1, k, _U)
        for i in range(k):
            total += mixed(h[i : len(h) - k + 1 + i] + _WEIGHTS[i % 8]) * (_WEIGHTS[i % 8] + _U(2 * (i // 8)))
        return np.unique(mixed(total))


class Cells:
    """Cell keys of a set such that any two sets of similarity num/den or more share one, unless they are equal."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        tops, low = [], 1
        while low < 1 << 40:
            high = max(low + 1, low * 3 // 2)
            tops.append(high - 1)
            low = high
        self.tops = np.array(tops)

    def differing(self, n: int, m: int) -> int:
        return (self.den - self.num) * (n + m) // (self.den + self.num)

    @functools.lru_cache(maxsize=4096)  # noqa: B019
    def plan(self, n: int) -> list[tuple[int, int, int]]:
        """(class, ranges, k) for each size class in which a set of n shingles may be or meet a larger set."""
        out, most = [], n * self.den // self.num
        c = int(np.searchsorted(self.tops, n))
        while c == 0 or self.tops[c - 1] + 1 <= max(n, most):
            top = int(self.tops[c])
            if k := self.differing(n, min(top, most)):
                widest = self.differing(top, top) + 1
                out.append((c, widest + max(2, widest // 12), k))
            c += 1
        return out

    def __call__(self, s: np.ndarray) -> np.ndarray:
        keys, scattered = [], None
        for c, ranges, k in self.plan(len(s)):
            if scattered is None:
                scattered = mixed(s + _WEIGHTS[5])
            part = ((s >> _U(32)) * _U(ranges)) >> _U(32)
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            sums = np.add.reduceat(scattered, first)
            tag = part[first] + _U(c << 40)
            keys.append(mixed(sums[: k + 1] ^ mixed(tag[: k + 1] + _WEIGHTS[6])))
            if len(first) <= k:  # too few ranges are filled to promise a shared one: single shingles, for pairs of two such sets
                keys.append(mixed(s[: k + 1] ^ _U(c << 40) ^ _WEIGHTS[7]))
        return np.concatenate(keys) if keys else np.zeros(0, _U)


def buckets(n: int) -> int:
    """Buckets of the profile of a set of n shingles: a power of two, which never falls as n grows."""
    return max(_LEAST_BUCKETS, 1 << max(0, -(-n // _BUCKET_SHINGLES) - 1).bit_length())


def profile(s: np.ndarray) -> np.ndarray:
    """How many shingles of a set lie in each bucket of the hash space; 255 stands for more."""
    b = buckets(len(s))
    return np.minimum(np.bincount((s >> _U(65 - b.bit_length())).astype(np.int64), minlength=b), 255).astype(np.uint8)


def alike(sizes: np.ndarray, profiles: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """A part for each set, given in ascending order of size: sets whose profiles permit a link are in one part.

    Sets of similarity num/den or more differ in at most (den-num)/(den+num) of their sizes' sum, and the sum of
    differences of two profiles never exceeds that number, nor does it where buckets are put together or counts cut.
    """
    count = len(sizes)
    part, ends = np.arange(count), np.searchsorted(sizes * num, sizes * den, "right")
    widths = np.array([len(x) for x in profiles])
    for width in np.unique(widths).tolist():
        low, high = np.searchsorted(widths, [width, width + 1]).tolist()
        rows = np.stack([x.reshape(width, -1).sum(axis=1, dtype=np.int32) for x in profiles[low : int(ends[high - 1])]])
        step = max(1, _BLOCK_BUCKETS // width)
        for i in range(low, high):
            others = i + 1 + np.flatnonzero(part[i + 1 : ends[i]] != part[i])
            for at in range(0, len(others), step):
                some = others[at : at + step]
                apart = np.abs(rows[some - low] - rows[i - low]).sum(axis=1)
                near = some[apart * (den + num) <= (den - num) * (sizes[some] + sizes[i])]
                if len(near):
                    part[np.isin(part, part[near])] = part[i]
    return part


def _sketches(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (digest of the set), profile, keys (none where doc_id is null or this task has already given the set's)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, cells, seen = Shingler(n), Cells(num, den), set()
        for batch in batches:
            for at in range(0, batch.num_rows, _ROW_SETS):
                part = batch.slice(at, _ROW_SETS)
                sizes, digests, profiles, flat, cuts = [], [], [], [], [0]
                for known, text in zip(part.column(0).is_valid().to_pylist(), part.column(1).to_pylist(), strict=True):
                    s = shingle(text)
                    digest = (len(s), int(mixed(s + _WEIGHTS[0]).sum(dtype=_U)), int(mixed(s + _WEIGHTS[1]).sum(dtype=_U)))
                    new = known and len(s) > 0 and digest not in seen
                    if new:
                        if len(seen) >= _SEEN_SETS:
                            seen.clear()
                        seen.add(digest)
                        flat.append(cells(s))
                        cuts.append(cuts[-1] + len(flat[-1]))
                    else:
                        cuts.append(cuts[-1])
                    sizes.append(len(s))
                    digests.append(digest[1:])
                    profiles.append(profile(s).tobytes() if known and len(s) else None)
                keys = np.concatenate(flat).view(np.int64) if flat else np.zeros(0, np.int64)
                d = np.array(digests, _U).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(keys))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(profiles, pa.binary()), lists], ["doc_id", "n_shingles", "d1", "d2", "profile", "keys"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, profile binary, keys array<long>")


def _cells(points: DataFrame) -> DataFrame:
    """(p, doc_id): each document with the least one of every cell that both are in, but for itself.

    Rows of points (doc_id, keys) are sorted by cell and document over all tasks, so a cell of any size spreads over
    as many as it fills. A task knows the least document of each cell but its first, which may have begun in a task
    before it; those it marks, and the least is looked up among the tasks' last cells, one row for each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "head", "last", "p", "doc_id"]
        part, first, key, least = TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids = (np.asarray(batch.column(i)) for i in (0, 1))
            begins = np.concatenate((keys[:1] != key if key is not None else [True], keys[1:] != keys[:-1]))
            at = np.maximum.accumulate(np.where(begins, np.arange(len(keys)), -1))
            p = np.where(at < 0, 0 if least is None else least, ids[at])
            first = int(keys[0]) if first is None else first
            key, least = int(keys[-1]), int(p[-1])
            head = keys == first
            use = head | (p != ids)
            n = int(use.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part), pa.int32()), pa.array(np.where(head[use], first, 0), mask=~head[use]), pa.nulls(n, pa.int64()), pa.array(p[use]), pa.array(ids[use])], names)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first]), pa.array([key]), pa.array([least]), pa.nulls(1, pa.int64())], names)

    rows = points.select(F.explode("keys").alias("key"), "doc_id")
    rows = rows.repartitionByRange(shuffle_width(points.sparkSession), "key", "doc_id").sortWithinPartitions("key", "doc_id")
    got = staged(rows.mapInArrow(run, "part int, head long, last long, p long, doc_id long"), "cells")
    ends = got.filter("last IS NOT NULL")
    begun = ends.groupBy("last").agg(F.min("p").alias("least")).join(ends.select("part", "head"), F.col("last") == F.col("head")).select("part", "least")
    met = got.filter("last IS NULL").join(F.broadcast(begun), "part", "left")  # one row for each task
    return met.select(F.when(F.col("head").isNull(), F.col("p")).otherwise(F.least("least", "p")).alias("p"), "doc_id").filter("p <> doc_id").distinct()


def _split(members: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """(p, x): the parts of two or more that alike makes of each region in members (p, x, n, profile), under their least x.

    A region whose profiles have more than block buckets is compared block against block.
    """

    def parts(ids: list[int], sizes: list[int], raw: list[bytes]) -> Iterator[pa.RecordBatch]:
        if len(ids) < 2:
            return
        part = alike(np.array(sizes, np.int64), [np.frombuffer(x, np.uint8) for x in raw], num, den)
        _, of, held = np.unique(part, return_inverse=True, return_counts=True)
        x = np.array(ids, np.int64)
        least = np.full(len(held), np.iinfo(np.int64).max)
        np.minimum.at(least, of, x)
        if (use := held[of] > 1).any():
            yield pa.RecordBatch.from_arrays([pa.array(least[of][use]), pa.array(x[use])], ["p", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sizes, raw = None, [], [], []
        for batch in batches:
            for region, x, n, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if region != key:
                    yield from parts(ids, sizes, raw)
                    key, ids, sizes, raw = region, [], [], []
                ids.append(x)
                sizes.append(n)
                raw.append(own)
        yield from parts(ids, sizes, raw)

    blocks = members.groupBy("p").agg(F.ceil(F.sum(F.greatest(F.lit(_LEAST_BUCKETS), F.col("n") * 2 / _BUCKET_SHINGLES)) / block).cast("int").alias("blocks"))
    k = F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int")
    regions = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.concat_ws(":", "p", F.least(k, j), F.greatest(k, j)))
    dealt = members.join(blocks, "p").select(F.explode(regions).alias("region"), "x", "n", "profile")
    placed = dealt.repartition(shuffle_width(members.sparkSession), "region").sortWithinPartitions("region", "n")
    return placed.mapInArrow(run, "p long, x long").distinct()


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id and set (sorted hashes as bytes) of each of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROW_SETS):
                part = batch.slice(at, _ROW_SETS)
                raw = pa.array([shingle(t).tobytes() for t in part.column(1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), raw], ["doc_id", "set"])

    return docs.mapInArrow(run, "doc_id long, set binary").filter("octet_length(set) > 0")


class Region:
    """Sets of a region as one array of codes."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], num: int, den: int):
        self.ids, self.num, self.den = np.array(ids, np.int64), num, den
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        vocabulary, codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.codes, self.held = codes, np.zeros(len(vocabulary), np.int64)

    def shared(self, p: int, of: np.ndarray) -> np.ndarray:
        """Shingles that member p shares with each member in of."""
        own = self.codes[self.starts[p] : self.starts[p + 1]]
        self.held[own] = 1
        if len(of) == len(self.ids):
            out = np.add.reduceat(self.held[self.codes], self.starts[:-1])
        else:
            sizes = self.sizes[of]
            ends = np.cumsum(sizes)
            at = np.arange(ends[-1]) + np.repeat(self.starts[of] - (ends - sizes), sizes)
            out = np.add.reduceat(self.held[self.codes[at]], ends - sizes)
        self.held[own] = 0
        return out

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links enough to connect all that is linked: pivot, window, smaller region, until none is left.

        Of links that a pivot finds only those are given that connect what was not connected yet, so a region of n
        members gives fewer than n, however alike they are; and what is one component needs no further pivot.
        """
        radius, here = 1 - self.num / self.den, np.arange(len(self.ids))
        p, part = 0, np.arange(len(self.ids))
        while len(here) > 1 and (part[here] != part[here[0]]).any():
            others = here[here != p]
            inter = self.shared(p, others)
            union = self.sizes[others] + self.sizes[p] - inter
            near = self.den * inter >= self.num * union
            parts, first = np.unique(part[others[near]], return_index=True)
            new = first[parts != part[p]]
            if len(new):
                yield np.full(len(new), self.ids[p]), self.ids[others[near][new]]
                part[np.isin(part, parts)] = part[p]
            far = others[~near]
            if not len(far):
                return
            d = 1 - inter / union
            window = others[near & (d >= d[~near].min() - radius - 1e-9)]
            p, here = far[0], np.concatenate((far, window))


def _joined(rows: DataFrame, num: int, den: int, n: int | None = None) -> DataFrame:
    """Links of each region in rows (region string, pivot boolean, doc_id, body); a region's rows stream by, the pivot's first.

    body is a set as bytes, or with n a text: that is smaller, as hashes don't compress, and its shingles are made here.
    Rows without shingles (of an id that also has a text with some) are left out.
    """

    def links(ids: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found = list(Region(ids, sets, num, den).links()) if len(ids) > 1 else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Shingler(n) if n else lambda x: np.frombuffer(x, _U)
        key, ids, sets = None, [], []
        for batch in batches:
            for at in range(0, batch.num_rows, _ROW_SETS):
                part = batch.slice(at, _ROW_SETS)
                for region, doc_id, x in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    if region != key:
                        yield from links(ids, sets)
                        key, ids, sets = region, [], []
                    if len(s := made(x)):
                        ids.append(doc_id)
                        sets.append(s)
        yield from links(ids, sets)

    placed = rows.repartition(shuffle_width(rows.sparkSession), "region").sortWithinPartitions("region", F.desc("pivot"), "doc_id")
    return placed.select("region", "doc_id", "body").mapInArrow(run, "a long, b long")


def _large(pairs: DataFrame, sets: DataFrame, num: int, den: int, limit: int, block: int) -> DataFrame:
    """Links within regions too large for one task. pairs: p, x (the pivot's own row included)."""
    radius = 1 - num / den
    own = sets.withColumnRenamed("doc_id", "x")
    pivot = sets.select(F.col("doc_id").alias("p"), F.col("set").alias("pivot_set"))

    def shared(a: pa.Array, b: pa.Array) -> pa.Array:
        sets = (np.frombuffer(x, _U) for x in a.to_pylist()), (np.frombuffer(x, _U) for x in b.to_pylist())
        return pa.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets, strict=True)], pa.int64())

    inter = F.arrow_udf(shared, "long")
    size = lambda c: F.octet_length(c) / 8
    met = pairs.filter("p <> x").join(own, "x").join(pivot, "p").select("p", "x", size("set").cast("long").alias("n"), size("pivot_set").cast("long").alias("m"), inter("set", "pivot_set").alias("i"))
    met = staged(met.withColumn("near", F.expr(f"{den} * i >= {num} * (n + m - i)")).withColumn("d", F.expr("1D - i / (n + m - i)")), "pivot_distances")
    star = met.filter("near").select(F.col("p").alias("a"), F.col("x").alias("b"))
    edge = met.filter("NOT near").groupBy("p").agg(F.min("d").alias("least"))
    left = met.join(edge, "p").filter(F.expr(f"NOT near OR d >= least - {radius} - 1e-9")).select("p", "x", "n", "d")
    ringed = staged(left.withColumn("ring", F.floor(F.col("d") / radius)), "remainders")
    totals = ringed.groupBy("p").agg(F.sum("n").alias("total"))
    small = ringed.join(totals.filter(F.col("total") <= limit), "p").select(F.col("p").cast("string").alias("region"), "x")
    over = ringed.join(totals.filter(F.col("total") > limit).select("p"), "p", "left_semi")
    blocks = over.groupBy("p", "ring").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / block)).cast("int").alias("blocks"))
    beside = blocks.select("p", (F.col("ring") - 1).alias("ring"), F.col("blocks").alias("next_blocks"))
    dealt = (
        over.join(blocks, ["p", "ring"])
        .join(beside, ["p", "ring"], "left")
        .join(blocks.select("p", (F.col("ring") + 1).alias("ring"), F.col("blocks").alias("last_blocks")), ["p", "ring"], "left")
        .withColumn("k", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int"))
    )
    inside = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.concat_ws(":", "p", "ring", F.least("k", j), "ring", F.greatest("k", j)))
    up = F.when(F.col("next_blocks").isNull(), F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.col("next_blocks") - 1), lambda j: F.concat_ws(":", "p", "ring", "k", F.col("ring") + 1, j)))
    down = F.when(F.col("last_blocks").isNull(), F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.col("last_blocks") - 1), lambda j: F.concat_ws(":", "p", F.col("ring") - 1, j, "ring", "k")))
    blocked = dealt.select(F.explode(F.array_distinct(F.concat(inside, up, down))).alias("region"), "x")
    rows = small.unionByName(blocked).join(own, "x").select("region", F.lit(False).alias("pivot"), F.col("x").alias("doc_id"), F.col("set").alias("body"))
    return star.unionByName(_joined(rows, num, den))


def jaccard_classes(
    docs: DataFrame, *, n: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text", region_shingles: int = _REGION_SHINGLES, block_shingles: int = _BLOCK_SHINGLES, block_buckets: int = _BLOCK_BUCKETS
) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, the smallest doc_id reachable by links.

    A text's words are what lies between ASCII white space, A-Z in lower case; its set holds its distinct n-word
    shingles, or the whole sequence where it has fewer words. Two documents link when den * |intersection| >=
    num * |union|. A null, empty or blank text has no shingles and links with nothing: it is its own component.
    Rows that repeat a text are one point. Rows that repeat a doc_id with other texts are one document with all
    their links. A row without an id has n_shingles, no component, and links with nothing. An empty table gives
    an empty result. Other columns are ignored. Shingles are compared by their 64-bit hashes.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = staged(_sketches(texts, n, num, den), "sketches")
    points = sketch.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = staged(points.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("profile").alias("profile")), "classes")
    same = ["d1", "d2", "n_shingles"]
    reps = points.join(classes, same).select("doc_id", "rep").distinct()
    met = staged(_cells(points), "met")
    pairs = (
        met.join(reps.select("doc_id", F.col("rep").alias("x")), "doc_id")
        .join(reps.select(F.col("doc_id").alias("p"), F.col("rep").alias("q")), "p")
        .filter("q <> x")
        .select(F.col("q").alias("p"), "x")
        .distinct()
    )
    pairs = staged(pairs, "regions")
    members = pairs.unionByName(pairs.select("p", F.col("p").alias("x")).distinct())
    members = members.join(classes.select(F.col("rep").alias("x"), F.col("n_shingles").alias("n"), "profile"), "x")
    members = staged(_split(members, num, den, block_buckets), "parts")
    held = classes.groupBy(F.col("rep").alias("x")).agg(F.sum("n_shingles").alias("n"))
    sizes = members.join(held, "x").groupBy("p").agg(F.sum("n").alias("total"))
    members = staged(members.join(sizes, "p").withColumn("large", F.col("total") > region_shingles), "members")
    # a text goes once to each of its regions
    homes = members.filter("NOT large").groupBy(F.col("x").alias("doc_id")).agg(F.collect_list("p").alias("regions"))
    sent = texts.join(homes.hint("merge"), "doc_id").select(F.explode("regions").alias("p"), "doc_id", F.col("text").alias("body"))
    links = _joined(sent.select(F.col("p").cast("string").alias("region"), (F.col("p") == F.col("doc_id")).alias("pivot"), "doc_id", "body"), num, den, n)
    far = members.filter("large").select("p", "x")
    if not far.isEmpty():
        own = far.select(F.col("x").alias("doc_id")).distinct()
        sets = staged(_sets(texts.join(own.hint("merge"), "doc_id"), n), "sets")
        links = links.unionByName(_large(far, sets, num, den, region_shingles, block_shingles))
    found = components(links)
    labelled = classes.join(found, F.col("rep") == F.col("node"), "left").select(*same, F.coalesce("component", "rep").alias("component"))
    return (
        sketch.select("doc_id", *same)
        .join(labelled, same, "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    )


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of docs, with all its columns, for each component of rows whose texts link: that with the smallest id.

    A row is known by its id and text. Rows without an id take part and come after all others. Null, empty and blank
    texts link with nothing, so such rows stay, one for each id and text; of rows that repeat an id and a text one
    stays. An empty table gives an empty result. Rows are told apart by 64-bit hashes.
    """
    key = F.xxhash64(id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), key.alias("key"))
    of = jaccard_classes(rows, id_col="key", **options).groupBy(F.col("doc_id").alias("key")).agg(F.first("component_id").alias("component"))
    known = rows.groupBy("key").agg(F.first("id").alias("id"), F.count(F.lit(1)).alias("n"))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "n")).alias("least")
    return one_of_each(docs, key, of.join(known, "key").groupBy("component").agg(least).select("least.key", "least.n"))
