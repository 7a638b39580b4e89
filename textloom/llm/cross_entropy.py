"""Cross-entropy difference of two n-gram models that share one vocabulary.

The background model counts all documents, the target model those marked as target. Both are bigram models with
absolute discounting over all words and all bigrams of the corpus; what the discount holds back goes to the word's own
frequency, so each context sums to 1. A document scores the mean over its tokens of the background's loss less the
target's: higher is more like the target.

No model is ever held in one place, and nothing is cut: tables grow with the corpus over as many shards as the shuffle
has partitions. Documents are cut into blocks of tokens. Blocks and shards then write to each other, in packed arrays:

1. a block sends the hashes of its distinct words to the words' shards, which number all words, frequent ones first;
2. a block sends its distinct bigrams, as numbers in ascending order, to the bigrams' shards, and its words' counts;
3. bigrams' shards add up, answer each block in the order it asked, and tell the words' shards how many different
   words follow each; these add up and answer too;
4. a block scores its documents by the answers.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import ship, shuffle_width, staged
from textloom.llm.jaccard_join import mixed

_BLOCK, _U = 1 << 20, np.uint64
_SENT = pa.schema([("kind", pa.string()), ("block", pa.string()), ("shard", pa.int32()), ("body", pa.binary())])
_PLAIN = "kind string, block string, shard int, body binary"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative integers, each as narrow as it can be, byte by byte of all its items."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a, np.min_scalar_type(int(a.max(initial=0))))
        out += (struct.pack("<BQ", a.itemsize, len(a)), np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def _unpack(body: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(body), 0, []
    while at < len(raw):
        size, n = struct.unpack_from("<BQ", raw, at)
        at += 9
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{size}").reshape(n))
        at += n * size
    return out


def _steps(keys: np.ndarray) -> np.ndarray:
    """Ascending integers as the steps between them; np.cumsum undoes it."""
    return np.diff(keys, prepend=keys.dtype.type(0))


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit hash: equal ranges."""
    return (((keys >> _U(32)) * _U(shards)) >> _U(32)).astype(np.int64)


def _parcels(shard: np.ndarray, shards: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order that puts shards together, else as it was, and (shard, from, to) of those that get something."""
    order = np.argsort(shard.astype(np.min_scalar_type(shards)), kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1)).tolist()
    return order, [(s, i, j) for s, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]


def _home(number: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of a word's number and its place there; 0, the start of a document, lives at place 0 of the last shard."""
    return (number + shards - 1) % shards, (number + shards - 1) // shards


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _blocks(docs: DataFrame, shards: int, block_tokens: int) -> DataFrame:
    """Rows of docs (doc_id, text) in blocks: kind, block, shard, body, ids.

    A ``doc`` row has a block's ids, texts' lengths and its words as places among the block's distinct words, these in
    order of their hashes; a ``word`` row has a shard's hashes and counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        ids, held, schema, waiting = [], [], None, 0

        def settle() -> pa.RecordBatch:
            nonlocal known, ids, held, waiting
            block, sizes = uuid.uuid4().hex, np.fromiter(map(len, held), np.int64, len(held))
            hashes, back = np.unique(np.fromiter(map(xxhash.xxh64_intdigest, known), _U, len(known)), return_inverse=True)
            local = back[np.concatenate(held)] if held else np.zeros(0, np.int64)
            counts = np.bincount(local, minlength=len(hashes))
            rows = [("doc", block, 0, _pack(sizes, local), ids)]
            rows += [("word", block, s, _pack(hashes[i:j], counts[i:j]), None) for s, i, j in _parcels(_shard(hashes, shards), shards)[1]]
            known, ids, held, waiting = {}, [], [], 0
            return _rows(rows, schema)

        for batch in batches:
            schema = schema or _SENT.append(pa.field("ids", pa.list_(batch.schema.field(0).type)))
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = (text or "").encode().split()
                for w in set(found).difference(known):
                    known[w] = len(known)
                ids.append(key)
                held.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
                waiting += len(found) + 1
                if waiting >= block_tokens:
                    yield settle()
        if ids:
            yield settle()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"{_PLAIN}, ids array<{kind}>")


def _number(shards: int):
    """Of a shard's ``word`` rows: ``id`` answers, the words' numbers from 1; frequent words have small ones."""

    def run(t: pa.Table) -> pa.Table:
        parts = [_unpack(b) for b in t["body"].to_pylist()]
        u, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        total = np.bincount(back, np.concatenate([p[1] for p in parts]), len(u))
        place = np.empty(len(u), np.int64)
        place[np.argsort(-total, kind="stable")] = np.arange(len(u))
        answers = np.split(place[back], np.cumsum([len(p[0]) for p in parts])[:-1])
        shard = t["shard"].to_pylist()
        return pa.Table.from_batches([_rows([("id", b, s, _pack(at * shards + s + 1)) for b, s, at in zip(t["block"].to_pylist(), shard, answers, strict=True)], _SENT)])

    return run


class _Block:
    """A block's documents, words in order of their numbers (0, the start, first) and distinct bigrams."""

    def __init__(self, rows: list[dict], shards: int):
        self.rows, self.shards = rows, shards
        doc = next(r for r in rows if r["kind"] == "doc")
        self.n, local = (x.astype(np.int64) for x in _unpack(doc["body"]))
        self.numbers = np.concatenate([np.zeros(1, np.int64), *self.answers("id", 1)]).astype(np.int64)
        order = np.argsort(self.numbers)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.numbers = self.numbers[order]
        self.cur = place[local + 1]
        self.prev = np.concatenate([np.zeros(1, np.int64), self.cur[:-1]])[: len(self.cur)]
        full = self.n[self.n > 0]
        self.prev[np.cumsum(full) - full] = 0
        code, self.pair_of, self.pair_n = np.unique(self.prev * len(order) + self.cur, return_inverse=True, return_counts=True)
        self.a, self.b = code // len(order), code % len(order)
        keys = mixed(mixed(self.numbers[self.a].astype(_U) + _U(1)) + self.numbers[self.b].astype(_U))
        self.pair_order, self.pair_parcels = _parcels(_shard(keys, shards), shards)
        shard, self.places = _home(self.numbers, shards)
        self.word_order, self.word_parcels = _parcels(shard, shards)

    def answers(self, kind: str, width: int) -> list[np.ndarray]:
        """The arrays of this block's rows of a kind, each joined over the shards."""
        own = [_unpack(r["body"]) for r in sorted((r for r in self.rows if r["kind"] == kind), key=lambda r: r["shard"])]
        return [np.concatenate(x) for x in zip(*own, strict=True)] or [np.zeros(0, np.int64)] * width


def _ask(shards: int):
    """Of a block's rows: ``pair`` rows (numbers of both words, n, n_target) and ``word`` rows (places, counts as word and as context, each in all and in target documents)."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        k = _Block(rows, shards)
        mark = np.zeros(len(k.n), bool)
        mark[[i for r in rows if r["kind"] == "target" for i in r["at"]]] = True
        target = np.repeat(mark, k.n).astype(float)
        count = lambda at, size, w=None: np.bincount(at, w, size).astype(np.int64)
        m, name, out = len(k.numbers), rows[0]["block"], []
        pair = k.numbers[k.a], k.numbers[k.b], k.pair_n, count(k.pair_of, len(k.a), target)
        for s, i, j in k.pair_parcels:
            a, *rest = (x[k.pair_order[i:j]] for x in pair)
            out.append(("pair", name, s, _pack(_steps(a), *rest)))
        word = k.places, count(k.cur, m), count(k.cur, m, target), count(k.prev, m), count(k.prev, m, target)
        for s, i, j in k.word_parcels:
            a, *rest = (x[k.word_order[i:j]] for x in word)
            out.append(("word", name, s, _pack(_steps(a), *rest)))
        return pa.Table.from_batches([_rows(out, _SENT)])

    return run


def _add_pairs(shards: int):
    """Of a shard's ``pair`` rows: ``pair`` answers (n and n_target in all), and ``kinds`` rows (places of contexts, how many words follow each, in all and in target documents)."""

    def run(t: pa.Table) -> pa.Table:
        parts = [_unpack(b) for b in t["body"].to_pylist()]
        a = np.concatenate([np.cumsum(p[0], dtype=np.int64) for p in parts])
        b, n, n_target = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
        u, first, back = np.unique(mixed(mixed(a.astype(_U) + _U(1)) + b.astype(_U)), return_index=True, return_inverse=True)
        total = [np.bincount(back, x, len(u)).astype(np.int64) for x in (n, n_target)]
        asked = zip(t["block"].to_pylist(), t["shard"].to_pylist(), np.split(back, np.cumsum([len(p[0]) for p in parts])[:-1]), strict=True)
        rows = [("pair", block, s, _pack(total[0][at], total[1][at])) for block, s, at in asked]
        contexts, of = np.unique(a[first], return_inverse=True)
        kinds = [np.bincount(of, w, len(contexts)).astype(np.int64) for w in (None, (total[1] > 0).astype(float))]
        shard, place = _home(contexts, shards)
        order, parcels = _parcels(shard, shards)
        rows += [("kinds", None, s, _pack(_steps(place[order[i:j]]), *(x[order[i:j]] for x in kinds))) for s, i, j in parcels]
        return pa.Table.from_batches([_rows(rows, _SENT)])

    return run


def _add_words(t: pa.Table) -> pa.Table:
    """Of a shard's ``word`` and ``kinds`` rows: ``word`` answers (the four counts and both kinds), and one ``total`` row (words, tokens, those of target)."""
    parts = [_unpack(b) for b in t["body"].to_pylist()]
    places = [np.cumsum(p[0], dtype=np.int64) for p in parts]
    total = np.zeros((6, 1 + max(int(x[-1]) for x in places)), np.int64)
    for p, at in zip(parts, places, strict=True):
        total[slice(0, 4) if len(p) == 5 else slice(4, 6), at] += np.array(p[1:], np.int64)  # a part names a word once
    asked = zip(t["kind"].to_pylist(), t["block"].to_pylist(), t["shard"].to_pylist(), places, strict=True)
    rows = [("word", block, s, _pack(*total[:, at]), None, None, None) for kind, block, s, at in asked if kind == "word"]
    rows.append(("total", None, 0, None, int((total[0] > 0).sum()), int(total[0].sum()), int(total[1].sum())))
    return pa.Table.from_batches([_rows(rows, pa.schema([*_SENT, ("v", pa.int64()), ("n", pa.int64()), ("n_target", pa.int64())]))])


def _score_block(shards: int, v: int, tokens: tuple[int, int], discount: float):
    def run(t: pa.Table) -> pa.Table:
        at = t["kind"].to_pylist().index("doc")
        ids = t["ids"].take([at]).combine_chunks().flatten()
        k = _Block(t.select(["kind", "block", "shard", "body"]).to_pylist(), shards)
        pair, word = np.empty((2, len(k.a))), np.empty((6, len(k.numbers)))
        pair[:, k.pair_order] = k.answers("pair", 2)
        word[:, k.word_order] = k.answers("word", 6)
        doc, losses = np.repeat(np.arange(len(k.n)), k.n), []
        for m in (1, 0):
            context, kinds = word[2 + m][k.a], word[4 + m][k.a]
            left = np.where(context > 0, discount * kinds / np.maximum(context, 1), 1.0)
            p = left * (word[m][k.b] + 0.5) / (tokens[m] + 0.5 * v) + np.maximum(pair[m] - discount, 0) / np.maximum(context, 1)
            losses.append(np.bincount(doc, -np.log(p)[k.pair_of], len(k.n)) / np.maximum(k.n, 1))
        return pa.table({"doc_id": ids, "n_tokens": k.n, "target_loss": losses[0], "background_loss": losses[1], "score": losses[1] - losses[0]})

    return run


def difference(docs: DataFrame, target_ids: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", discount: float = 0.75, block_tokens: int = _BLOCK) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of all rows of docs, with the rows whose id is in target_ids.doc_id as target.

    Null texts count as empty; very long texts are read whole; rows that repeat count each time; a null id is never
    target. With no target rows, or an empty table, the target model is flat over the vocabulary; without tokens all
    figures are 0. Other columns are ignored. Words and pairs are told apart by 64-bit hashes. Of target_ids only ids
    are joined, with ids: no text is shuffled.
    """
    spark = docs.sparkSession
    ship(spark)
    shards = shuffle_width(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sent = staged(_blocks(rows, shards, block_tokens), "blocks")
    own = sent.filter("kind = 'doc'").select("kind", "block", "shard", "body", "ids")
    marked = target_ids.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("id")).distinct()
    hit = own.select("block", F.posexplode("ids").alias("pos", "id")).join(marked, "id").groupBy("block").agg(F.collect_list("pos").alias("at"))
    ids = staged(sent.filter("kind = 'word'").select("kind", "block", "shard", "body").groupBy("shard").applyInArrow(_number(shards), _PLAIN), "numbers")
    met = own.drop("ids").unionByName(ids).unionByName(hit.withColumn("kind", F.lit("target")), allowMissingColumns=True)
    asked = staged(met.groupBy("block").applyInArrow(_ask(shards), _PLAIN), "asked")
    pairs = staged(asked.filter("kind = 'pair'").groupBy("shard").applyInArrow(_add_pairs(shards), _PLAIN), "pairs")
    words = asked.filter("kind = 'word'").unionByName(pairs.filter("kind = 'kinds'"))
    words = staged(words.groupBy("shard").applyInArrow(_add_words, f"{_PLAIN}, v long, n long, n_target long"), "words")
    v, n, n_target = (x or 0 for x in words.filter("kind = 'total'").agg(F.sum("v"), F.sum("n"), F.sum("n_target")).first())
    answers = ids.unionByName(pairs.filter("kind = 'pair'")).unionByName(words.filter("kind = 'word'").select("kind", "block", "shard", "body"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, score double"
    return own.unionByName(answers, allowMissingColumns=True).groupBy("block").applyInArrow(_score_block(shards, v, (n, n_target), discount), schema)
