"""Best-fit packing of documents into training sequences of several permitted lengths.

Documents are dealt to shards by a hash of their id, as many as the tokens need at ``shard_tokens`` each, and each
shard is packed on its own: a shard holds thousands of bins, so what packing apart wastes is a bin or so in
thousands. Within a shard only counts of lengths matter, so the state is bounded by the largest length, not by the
documents. Longest first, a piece goes to the open bin with the least room that still holds it; where none does, a
bin opens whose size costs least for what it may come to hold. In the end each bin shrinks to the smallest
permitted size that its contents fill. Every shard tries each subset of sizes it may open and keeps the cheapest.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import ship, shuffle_width, staged
from textloom.llm.token_files import _coder

#: Permitted sequence lengths.
SIZES = (512, 1024, 2048, 4096, 8192)
#: What a sequence costs beside its tokens: a fixed share, and attention, which doubles the cost at ATTENTION tokens.
OVERHEAD, ATTENTION = 16, 16384


def token_lengths(text) -> object:
    """Tokens of a text: its runs of non-white-space, and one that ends the document."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + F.lit(1).cast("long")


class Bins:
    """Open bins by room left; the least room that holds a piece is found by bisection over the rooms in use."""

    def __init__(self):
        self.rooms: list[int] = []
        self.at: dict[int, list[int]] = {}

    def put(self, room: int, bin_id: int) -> None:
        if room not in self.at:
            insort(self.rooms, room)
            self.at[room] = []
        self.at[room].append(bin_id)

    def take(self, length: int) -> tuple[int, int] | None:
        """The bin with the least room of at least length; of those the one filled last."""
        k = bisect_left(self.rooms, length)
        if k == len(self.rooms):
            return None
        room = self.rooms[k]
        bin_id = self.at[room].pop()
        if not self.at[room]:
            del self.at[room], self.rooms[k]
        return room, bin_id


def cost(size: int) -> int:
    return size + size * size // ATTENTION + OVERHEAD


def fitted(used: int, sizes: tuple[int, ...]) -> int:
    return sizes[bisect_left(sizes, used)]


def packed(lengths: np.ndarray, openable: tuple[int, ...], sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin of each piece, contents of each bin, and the cost after downsizing. Pieces must come longest first."""
    bins, where, used, capacity = Bins(), np.zeros(len(lengths), np.int64), [], []
    for i, n in enumerate(lengths.tolist()):
        found = bins.take(n)
        if found is None:
            # the least cost a token, were the bin filled by pieces of this length
            size = min((s for s in openable if s >= n), key=lambda s: (cost(s) / (s - s % n), s), default=fitted(n, sizes))
            found = (size, len(used))
            used.append(0)
            capacity.append(size)
        room, b = found
        where[i] = b
        used[b] += n
        if room > n:
            bins.put(room - n, b)
    filled = np.array(used, np.int64)
    return where, filled, sum(cost(fitted(u, sizes)) for u in used)


def best_packing(lengths: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The cheapest packing over all sets of sizes that may be opened."""
    choices = sorted(c for k in range(1, len(sizes) + 1) for c in combinations(sizes, k))
    best = min((packed(lengths, c, sizes) for c in choices), key=lambda x: x[2])
    return best[0], best[1]


def _pieces_of_ids(docs: DataFrame, model_path: str, end_id: int, top: int) -> DataFrame:
    """doc_id, piece, start, n_tokens and ids of each piece of up to top tokens of docs (doc_id, text).

    ids are little-endian unsigned integers of 16 bits each where the vocabulary and end_id fit in them, else of 32:
    the bytes of ids, over n_tokens, tell which.
    """
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(open(model_path, "rb").read())
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(model.value)
        kind = np.dtype("<u2" if max(len(coder.closes), end_id + 1) <= 1 << 16 else "<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                raw = [np.frombuffer(x + end, "<u4").astype(kind) for x in coder.encode([t or "" for t in part.column(1).to_pylist()])]
                cuts = [(i, k, x[a : a + top].tobytes()) for i, x in enumerate(raw) for k, a in enumerate(range(0, len(x), top))]
                row, piece, ids = zip(*cuts, strict=True)
                piece = np.array(piece, np.int64)
                out = part.column(0).take(pa.array(row)), pa.array(piece), pa.array(piece * top), pa.array([len(x) // kind.itemsize for x in ids], pa.int64()), pa.array(ids, pa.binary())
                yield pa.RecordBatch.from_arrays(list(out), ["doc_id", "piece", "start", "n_tokens", "ids"])

    return docs.mapInArrow(run, "doc_id long, piece long, start long, n_tokens long, ids binary")


def best_fit(
    docs: DataFrame, *, sizes: tuple[int, ...] = SIZES, shard_tokens: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text",
    lengths: DataFrame | None = None, model_path: str | None = None, end_id: int = 2,
) -> DataFrame:
    """One row for each piece of a document: bin_id, capacity, bin_tokens, position, doc_id, piece, start, n_tokens.

    Tokens are a text's words and an end mark; with model_path, a vocabulary of the tokenizers library, they are its ids
    and end_id, and each row has its piece's ids beside (binary, little-endian unsigned 32-bit). lengths (doc_id,
    n_tokens) stands in for the texts where token counts are known.

    A document of up to the largest size is one piece; a longer one is cut into pieces of that size and a rest, so
    no token is lost (start is the piece's first token in its document). A bin_id names a bin in all shards; its
    pieces lie in order of position; capacity is the smallest permitted size that holds bin_tokens. A null or empty
    text has one token, its end. Rows that repeat an id are packed each on its own; null ids are packed too. An
    empty table gives no bins. Other columns are ignored.
    """
    sizes = tuple(sorted(sizes))
    ship(docs.sparkSession)
    top = sizes[-1]
    if model_path is not None:
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        # rows are numbered as they lie in the written table, so that repeated ones spread over the shards
        pieces = staged(_pieces_of_ids(texts, model_path, end_id, top), "pieces").withColumn("copy", F.monotonically_increasing_id())
        total = pieces.agg(F.sum("n_tokens")).first()[0] or 0
    else:
        have = lengths if lengths is not None else docs.select(F.col(id_col).cast("long").alias("doc_id"), token_lengths(F.col(text_col)).alias("n_tokens"))
        total = have.agg(F.sum("n_tokens")).first()[0] or 0
        # repeated rows are counted first and numbered, so that a hot id spreads over the shards too
        copies = have.groupBy("doc_id", "n_tokens").count().select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))).alias("copy"))
        pieces = copies.select(
            "doc_id",
            "copy",
            F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n_tokens") / top).cast("long") - 1)).alias("piece"),
            F.col("n_tokens").alias("whole"),
        ).select("doc_id", "copy", "piece", (F.col("piece") * top).alias("start"), F.least(F.lit(top).cast("long"), F.col("whole") - F.col("piece") * top).alias("n_tokens"))
    shards = max(1, -(-int(total) // shard_tokens))
    salted = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_tokens", "copy", "piece"), F.lit(shards)).cast("int")).drop("copy")
    own = [c for c in ("doc_id", "piece", "start", "n_tokens", "ids") if c in salted.columns]

    def done(rows: list[pa.RecordBatch]) -> pa.Table:
        t = pa.Table.from_batches(rows)
        rows.clear()
        t = t.take(pc.sort_indices(t, sort_keys=[("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]))
        where, used = best_packing(np.asarray(t["n_tokens"]), sizes)
        caps = np.array([fitted(int(u), sizes) for u in used], np.int64)
        order, position = np.argsort(where, kind="stable"), np.empty(len(where), np.int64)
        begins = np.searchsorted(where[order], where[order])
        position[order] = np.arange(len(where)) - begins
        if "ids" in own:
            held = zip(t["ids"].to_pylist(), t["n_tokens"].to_pylist(), strict=True)
            t = t.set_column(t.schema.get_field_index("ids"), "ids", pa.array([np.frombuffer(x, f"<u{len(x) // n}").astype("<u4").tobytes() for x, n in held], pa.binary()))
        shard = np.int64(t["shard"][0].as_py()) << np.int64(32)
        return pa.table([pa.array(shard + where), pa.array(caps[where]), pa.array(used[where]), pa.array(position), *(t[c] for c in own)], names=["bin_id", "capacity", "bin_tokens", "position", *own])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            shard, at = np.asarray(batch.column(0)), 0
            for stop in [*(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]:
                if at < stop:
                    if rows and shard[at] != key:
                        yield from done(rows).to_batches()
                    key = shard[at]
                    rows.append(batch.slice(at, stop - at))
                at = stop
        if rows:
            yield from done(rows).to_batches()

    width = min(shards, max(shuffle_width(docs.sparkSession), 1))
    placed = salted.repartition(width, "shard").sortWithinPartitions("shard").select("shard", *own)
    schema = "bin_id long, capacity long, bin_tokens long, position long, doc_id long, piece long, start long, n_tokens long"
    return placed.mapInArrow(pack, schema + ", ids binary" * ("ids" in own))
