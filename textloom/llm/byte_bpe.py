"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Pieces are found without a regular expression. A batch of texts becomes one array of code points, each mapped to a
class: letter, number, white space, other, or the edge between texts. The splitter is an automaton whose state is
the run that a character continues; the transition function of a character either keeps the state (same class as
its neighbour) or resets it to a constant. Such functions compose associatively to "the last reset so far", so one
prefix scan (a running maximum of reset positions) gives every run's start, one suffix scan its end, and the rest
(a space glued to the run after it, the last of several white spaces, contractions) reads only neighbours.
The slices between boundaries go through a cache of merged pieces; byte offsets are kept for each token.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import held, per_text, ship

LETTER, NUMBER, SPACE, OTHER, EDGE = range(5)
_EDGE_CP = sys.maxunicode + 1
#: Unicode's White_Space, as first and last of each range.
_WHITE = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
_CHUNK_CHARS, _CACHE_ENTRIES, _CACHED_BYTES = 1 << 19, 1 << 18, 64
_TABLES: dict[str, object] = {}


def code_classes() -> np.ndarray:
    """The class of every code point, and of the edge mark after the last."""
    if "classes" not in _TABLES:
        kinds = {"L": LETTER, "N": NUMBER}
        out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        for a, b in _WHITE:
            out[a : b + 1] = SPACE
        _TABLES["classes"] = np.append(out, np.uint8(EDGE))
    return _TABLES["classes"]


def boundaries(cps: np.ndarray) -> np.ndarray:
    """True where a piece starts. cps: texts' code points with an edge mark before, between and after them."""
    cls = code_classes()[cps]
    n = len(cls)
    at = np.arange(n)
    reset = np.ones(n, bool)
    reset[1:] = (cls[1:] != cls[:-1]) | (cls[1:] == EDGE)
    first = np.maximum.accumulate(np.where(reset, at, 0))
    closes = np.append(reset[1:], True)
    white = cls == SPACE
    before = np.append(np.uint8(EDGE), cls[:-1])
    after = np.append(cls[1:], np.uint8(EDGE))
    blank_before = np.append(False, cps[:-1] == 0x20)
    start = reset & ~blank_before
    # a run of white space that a text goes on after: its last character stands alone or leads the next run
    start |= white & closes & (after != EDGE)
    start |= white & (at == first)
    start |= ~white & reset & (before == SPACE) & ~blank_before
    quote = np.flatnonzero((cps == 0x27) & reset & ~blank_before)
    if len(quote):
        x = cps[np.minimum(quote + 1, n - 1)]
        y = cps[np.minimum(quote + 2, n - 1)]
        is_ = lambda v, c: v == ord(c)
        two = is_(x, "s") | is_(x, "t") | is_(x, "m") | is_(x, "d")
        three = ((is_(x, "r") | is_(x, "v")) & is_(y, "e")) | (is_(x, "l") & is_(y, "l"))
        start[quote[two] + 1] = False
        start[np.minimum(quote[two] + 2, n - 1)] = True
        start[quote[three] + 1] = False
        start[np.minimum(quote[three] + 3, n - 1)] = True
        # white space right after a contraction keeps its own rule
        for ends in (quote[two] + 2, quote[three] + 3):
            ends = ends[ends < n]
            start[ends] = True
    return start


class _Merged(dict):
    """Piece to its ids; what is absent is merged when asked for."""

    def __init__(self, coder: ByteBPE):
        super().__init__()
        self.coder = coder

    def __missing__(self, piece: bytes) -> bytes:
        ids = np.array(self.coder.merge(piece), "<u4").tobytes()
        if len(piece) <= _CACHED_BYTES:
            if len(self) >= _CACHE_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids


class ByteBPE:
    """Encoder and decoder for a table of ranks, bytes to id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.parts = {i: b for b, i in ranks.items()}
        self.cache = _Merged(self)

    @classmethod
    def from_file(cls, data: bytes) -> ByteBPE:
        return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())})

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece: the adjacent pair of least rank is merged, the leftmost first, until none is known."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        if n <= _CACHED_BYTES:
            return self._merge_short(piece)
        end, prev, nxt = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            alive[j], end[i], nxt[i] = False, stop, nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
                if (r := ranks.get(piece[i : end[nxt[j]]])) is not None:
                    heapq.heappush(heap, (r, i, end[nxt[j]]))
            if prev[i] >= 0 and (r := ranks.get(piece[prev[i] : stop])) is not None:
                heapq.heappush(heap, (r, prev[i], stop))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def _merge_short(self, piece: bytes) -> list[int]:
        get, none = self.ranks.get, len(self.ranks) + 256
        cuts = list(range(len(piece) + 1))
        pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            del cuts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get(piece[cuts[i] : cuts[i + 2]], none)
            if i:
                pairs[i - 1] = get(piece[cuts[i - 1] : cuts[i + 1]], none)
        return [self.ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers; texts go through in chunks."""
        at = 0
        while at < len(texts):
            stop, chars = at, 0
            while stop < len(texts) and (stop == at or chars + len(texts[stop]) <= _CHUNK_CHARS):
                chars += len(texts[stop])
                stop += 1
            yield from self._chunk(texts[at:stop])
            at = stop

    def _chunk(self, texts: list[str]) -> Iterator[bytes]:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        edges = np.concatenate(([0], np.cumsum(lengths + 1)))
        cps = np.full(edges[-1] + 1, _EDGE_CP, np.uint32)
        inside = np.ones(len(cps), bool)
        inside[edges] = False
        cps[inside] = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        start = boundaries(cps)
        width = np.where(cps == _EDGE_CP, 0, 1 + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000))
        offset = np.concatenate(([0], np.cumsum(width)))
        start[edges] = False
        first = np.flatnonzero(start)
        bytes_at = offset[first].tolist()
        pieces_to = np.searchsorted(first, edges).tolist()
        raw = "".join(texts).encode()
        bytes_at.append(len(raw))
        merged = self.cache.__getitem__
        for k in range(len(texts)):
            cuts = bytes_at[pieces_to[k] : pieces_to[k + 1] + 1]
            yield b"".join(map(merged, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))

    def offsets(self, ids: bytes) -> np.ndarray:
        """The byte at which each token starts, and the length of the whole."""
        sizes = np.fromiter((len(self.parts[i]) for i in np.frombuffer(ids, "<u4").tolist()), np.int64)
        return np.concatenate(([0], np.cumsum(sizes)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.parts.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _coder(data: bytes) -> ByteBPE:
    """One coder for a table of ranks and worker process."""
    return held("byte_bpe", hashlib.sha256(data).hexdigest(), lambda: ByteBPE.from_file(data))


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, ids (binary, little-endian unsigned 32-bit), n_tokens.

    A null text is empty and has no ids; very long texts are read whole. Rows may repeat and ids may be null; an empty
    table gives an empty result; other columns are ignored. The rank file is read on the driver and broadcast (its size
    is the file's, under a megabyte here); nothing is shuffled.
    """
    data = docs.sparkSession.sparkContext.broadcast(open(ranks_path, "rb").read())

    def make():
        coder = _coder(data.value)

        def run(texts: list[str]) -> list:
            ids = list(coder.encode(texts))
            return [ids, [len(x) // 4 for x in ids]]

        return run

    return per_text(docs, "ids binary, n_tokens long", make, id_col, text_col)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Rows of ``encode`` with decoded (binary) beside them."""
    ship(encoded.sparkSession)
    data = encoded.sparkSession.sparkContext.broadcast(open(ranks_path, "rb").read())

    def back(ids: pa.Array) -> pa.Array:
        coder = _coder(data.value)
        return pa.array([None if x is None else coder.decode(x) for x in ids.to_pylist()], pa.binary())

    return encoded.withColumn("decoded", F.arrow_udf(back, "binary")("ids"))


def round_trip(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 (the digest of what the ids decode to) for each row of docs.

    Rows as in ``encode``. Encoding and decoding share one worker, and only digests leave it.
    """
    data = docs.sparkSession.sparkContext.broadcast(open(ranks_path, "rb").read())

    def make():
        coder = _coder(data.value)

        def run(texts: list[str]) -> list:
            rows = [(len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()) for ids in coder.encode(texts)]
            return list(zip(*rows, strict=True))

        return run

    return per_text(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string", make, id_col, text_col, rows=2048)
