"""Token ids in shards of independent zstandard frames that a reader can seek in.

A shard is a sequence of zstandard frames, so any zstandard tool decompresses it:

* data frames, each the little-endian unsigned 32-bit ids of whole documents, closed once it holds ``frame_ids``;
* a skippable frame with the document index: count, then for each document its id, a validity byte, its number of
  ids and its frame, and the CRC-32 of all that;
* a skippable frame with the seek table of the public zstandard seekable format: for each data frame its
  compressed size, its size and the low 32 bits of the XXH64 of its content; then the number of frames, a
  descriptor byte and the format's magic number, last in the file.

A reader takes the table from the file's end, then fetches and decompresses only the frames of the documents asked
for, checking each. Shards hold documents in ascending order of doc_id, and shard k comes before shard k + 1.
"""

from __future__ import annotations

import hashlib
import itertools
import operator
import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import held, ship, shuffle_width, staged, work_path

#: Fixed values of the public formats.
_SKIP_TABLE, _SKIP_INDEX, _SEEKABLE = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
_CHUNK_CHARS, _CACHE_ENTRIES, _CACHED_CHARS = 1 << 20, 1 << 19, 64
#: Signs that may follow a word; none begins or continues a contraction.
_SIGNS = ".,!?;:$%&*#|"
#: Of the first 256 code points, those that are no letter, number or white space.
_SIGN = np.array([unicodedata.category(c := chr(i))[0] not in "LN" and not (c.isspace() and i not in range(0x1C, 0x20)) for i in range(256)])
_UNSIGNED = operator.methodcaller("rstrip", _SIGNS)


def _eased(text: str) -> str:
    """A text with the same ids and fewer different words: lower case, and commas and stops apart, where that is safe.

    The vocabulary's normaliser lowers all but special tokens, and for Latin-1 as Python does. A sign that stands alone
    is a piece of its own; where two signs meet, they are one piece and the text is only lowered.
    """
    if "<|" in text:
        return text
    try:
        sign = _SIGN[np.frombuffer(text.encode("latin-1"), np.uint8)]
    except UnicodeEncodeError:
        return text
    text = text.lower()
    if (sign[1:] & sign[:-1]).any():
        return text
    return text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " .\n")


class _Either(dict):
    """A dictionary that asks another for what it lacks."""

    def __init__(self, own: dict, other: dict):
        super().__init__(own)
        self.other = other

    def __missing__(self, key):
        return self.other[key]


class WordCoder:
    """The tokenizers library behind a cache of words.

    No piece of the vocabulary's splitter spans a space or line feed, and its normaliser reads no further than a
    piece's own characters, so the words between them are encoded apart and their ids joined. A word of letters and
    the signs after it are two pieces. Unknown words of letters go to the library many to a text: each is one piece,
    and the last token of a piece is marked in the vocabulary.
    """

    def __init__(self, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(model)
        self.cache: dict[str, bytes] = {"": b""}
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _encoded(self, texts: list[str], size: int) -> Iterator[np.ndarray]:
        """The library's ids, size texts at a time: its own results are many times as large."""
        for at in range(0, len(texts), size):
            for got in self.tokenizer.encode_batch_fast(texts[at : at + size], add_special_tokens=False):
                yield np.array(got.ids, "<u4")

    def _apart(self, words: list[str]) -> Iterator[bytes]:
        for ids in self._encoded(words, 4096):
            yield ids.tobytes()

    def _together(self, words: list[str]) -> Iterator[bytes]:
        """The ids of words of letters."""
        groups = [words[a : a + 256] for a in range(0, len(words), 256)]
        for group, ids in zip(groups, self._encoded([" ".join(g) for g in groups], 16), strict=True):
            ends = (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
            if len(ends) != len(group):  # a letter became more than one piece
                yield from self._apart(group)
                continue
            raw = ids.tobytes()
            yield from (raw[a:b] for a, b in zip([0, *ends], ends))

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of unknown words."""
        plain = list(map(operator.and_, map(str.isalpha, new), map(operator.eq, map(str.lower, new), new)))
        together = list(itertools.compress(new, plain))
        got = dict(zip(together, self._together(together), strict=True))
        new = list(itertools.compress(new, map(operator.not_, plain)))
        if not new:
            return got
        cores = list(map(_UNSIGNED, new))
        low = list(map(str.lower, cores))
        letters = list(map(str.isalpha, low))
        # what isn't ASCII is left for the library to lower
        keys = [(x if x.isascii() else c) if y else w for x, c, y, w in zip(low, cores, letters, new, strict=True)]
        tails = [w[len(c) :] if y else "" for w, c, y in zip(new, cores, letters, strict=True)]
        known = self.cache
        together = [w for w in set(itertools.compress(keys, letters)).difference(known) if w not in got]
        apart = list(set(itertools.compress(keys, map(operator.not_, letters))).union(tails).difference(known))
        got |= dict(zip(together, self._together(together), strict=True)) | dict(zip(apart, self._apart(apart), strict=True))
        find = _Either(got, known).__getitem__
        got |= dict(zip(new, map(bytes.__add__, map(find, keys), map(find, tails)), strict=True))
        return got

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        at = 0
        while at < len(texts):
            stop, chars = at, 0
            while stop < len(texts) and (stop == at or chars + len(texts[stop]) <= _CHUNK_CHARS):
                chars += len(texts[stop])
                stop += 1
            split = [_eased(t).replace("\n", " ").split(" ") for t in texts[at:stop]]
            if len(self.cache) > _CACHE_ENTRIES:
                self.cache = {"": b""}
            new = list(set(itertools.chain.from_iterable(split)).difference(self.cache))
            known, once = self.cache, {}
            learnt = self._learn(new)
            if max(map(len, learnt), default=0) <= _CACHED_CHARS:
                known |= learnt
            else:
                for word, ids in learnt.items():
                    (known if len(word) <= _CACHED_CHARS else once)[word] = ids
            look = (lambda w: known[w] if w in known else once[w]) if once else known.__getitem__
            for words in split:
                yield b"".join(map(look, words))
            at = stop


def _coder(model: bytes) -> WordCoder:
    return held("word_bpe", hashlib.sha256(model).hexdigest(), lambda: WordCoder(model))


class ShardWriter:
    def __init__(self, out, frame_ids: int = 1 << 18, level: int = 3):
        self.out, self.limit, self.zstd = out, 4 * frame_ids, zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=True)
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int, int]] = []
        self.open: list[bytes] = []
        self.held = self.ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.held and self.held + len(ids) > self.limit:
            self.flush()
        self.docs.append((0 if doc_id is None else doc_id, doc_id is not None, len(ids) // 4, len(self.frames)))
        self.open.append(ids)
        self.held += len(ids)
        self.ids += len(ids) // 4

    def flush(self) -> None:
        if self.open:
            raw = b"".join(self.open)
            packed = self.zstd.compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.open, self.held = [], 0

    def close(self) -> None:
        self.flush()
        columns = list(zip(*self.docs, strict=True)) or [()] * 4
        index = struct.pack("<Q", len(self.docs)) + b"".join(np.array(c, t).tobytes() for c, t in zip(columns, ("<i8", "u1", "<u8", "<u4"), strict=True))
        index += struct.pack("<I", zlib.crc32(index))
        self.out.write(struct.pack("<II", _SKIP_INDEX, len(index)) + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIP_TABLE, len(table)) + table)


class ShardReader:
    """Random access to a shard; source has size() and read_at(length, offset)."""

    def __init__(self, source):
        self.source, end = source, source.size()
        count, descriptor, magic = struct.unpack("<IBI", source.read_at(9, end - 9))
        if magic != _SEEKABLE or descriptor != 0x80:
            raise ValueError("not a seekable shard")
        at = end - 9 - 12 * count - 8
        head = struct.unpack("<II", source.read_at(8, at))
        if head != (_SKIP_TABLE, 12 * count + 9):
            raise ValueError("broken seek table")
        self.frames = np.frombuffer(source.read_at(12 * count, at + 8), "<u4").reshape(-1, 3).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.frames[:, 0])))
        skip, length = struct.unpack("<II", source.read_at(8, int(self.starts[-1])))
        index = source.read_at(length, int(self.starts[-1]) + 8)
        if skip != _SKIP_INDEX or struct.unpack("<I", index[-4:])[0] != zlib.crc32(index[:-4]):
            raise ValueError("broken document index")
        (n,) = struct.unpack("<Q", index[:8])
        cuts = np.cumsum([8, 8 * n, n, 8 * n, 4 * n])
        self.doc_ids, self.valid, self.counts, self.frame_of = (np.frombuffer(index[a:b], t) for a, b, t in zip(cuts, cuts[1:], ("<i8", "u1", "<u8", "<u4")))
        self.counts = self.counts.astype(np.int64)

    def frame(self, k: int) -> bytes:
        size, raw_size, check = (int(x) for x in self.frames[k])
        raw = zstandard.ZstdDecompressor().decompress(self.source.read_at(size, int(self.starts[k])))
        if len(raw) != raw_size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} fails its checksum")
        return raw

    def documents(self, wanted: np.ndarray | None = None) -> Iterator[tuple[int | None, bytes, int]]:
        """(doc_id, ids, ids of the shard before it); wanted: positions in the shard, ascending."""
        before = np.concatenate(([0], np.cumsum(self.counts)))
        first = np.searchsorted(self.frame_of, np.arange(len(self.frames)))
        last, raw = -1, b""
        for i in range(len(self.counts)) if wanted is None else wanted.tolist():
            if (k := int(self.frame_of[i])) != last:
                last, raw = k, self.frame(k)
            a = 4 * int(before[i] - before[first[k]])
            yield (int(self.doc_ids[i]) if self.valid[i] else None), raw[a : a + 4 * int(self.counts[i])], int(before[i])


class _Source:
    def __init__(self, path: str):
        store, inner = pafs.FileSystem.from_uri(path)
        self.file = store.open_input_file(inner)

    def size(self) -> int:
        return self.file.size()

    def read_at(self, length: int, offset: int) -> bytes:
        return self.file.read_at(length, offset)


def write_shards(
    docs: DataFrame, path: str, model_path: str, *, end_id: int = 2, frame_ids: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode docs, each followed by end_id, into shards under path, and return the manifest: part, path, n_docs,
    n_ids, offset (ids in all shards before).

    A null or empty text has its end id alone; strings of the vocabulary's special tokens in a text become those, as the
    library does it. Very long texts are written whole, each in one frame. Null ids come first; rows that share an id are
    ordered by their text's hash, so a repeated id can't overfill a range. Other columns are ignored. An empty table gives
    no shards. A shard appears under its name
    only when whole, so a task that is lost and run again replaces it with the same bytes.
    """
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(open(model_path, "rb").read())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        head = next(batches, None)
        if head is None:
            return
        task = TaskContext.get()
        store, root = pafs.FileSystem.from_uri(path)
        name, end = f"part-{task.partitionId():06d}.tlz", np.array([end_id], "<u4").tobytes()
        draft, final = f"{root}/_{name}.{task.taskAttemptId()}", f"{root}/{name}"
        store.create_dir(root, recursive=True)
        coder = _coder(model.value)
        with store.open_output_stream(draft) as out:
            shard = ShardWriter(out, frame_ids)
            for batch in itertools.chain([head], batches):
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    texts = [t or "" for t in part.column(1).to_pylist()]
                    for doc_id, got in zip(part.column(0).to_pylist(), coder.encode(texts), strict=True):
                        shard.add(doc_id, got + end)
            shard.close()
        if store.get_file_info(final).type != pafs.FileType.NotFound:
            store.delete_file(final)  # of an attempt that was lost after its shard was whole; not all stores replace files
        store.move(draft, final)
        row = [task.partitionId()], [f"{path}/{name}"], [len(shard.docs)], [shard.ids]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["part", "path", "n_docs", "n_ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(shuffle_width(spark), F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie)
    manifest = staged(ordered.mapInArrow(write, "part int, path string, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("offset", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def read_shards(manifest: DataFrame, per_document) -> DataFrame:
    """The documents of a manifest's shards: doc_id, start, n_tokens, and value, per_document of the ids' bytes as a long.

    Each row that was written gives one, those with null or repeated ids too; an empty manifest gives none. A shard's
    documents leave as they are read, so long ones or many don't add up.
    """
    ship(manifest.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "value"]
        for batch in batches:
            for path, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = ((doc_id, offset + at, len(ids) // 4, per_document(ids)) for doc_id, ids, at in ShardReader(_Source(path)).documents())
                while part := list(itertools.islice(rows, 8192)):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*part, strict=True)], names)

    spread = manifest.select("part", "path", "offset").repartition(shuffle_width(manifest.sparkSession), "part").select("path", "offset")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, value long")


def fetch(spark: SparkSession, manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ids (array of long) of the documents in wanted.doc_id; of each shard only their frames are read.

    wanted is joined to the shards' indexes, so it may be large; ids in it that repeat count once, null or unknown ones
    not at all. An id that several rows were written with gives each of them. Nothing wanted, or an empty manifest, gives
    no rows.
    """
    ship(spark)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                shard = ShardReader(_Source(path))
                ids = shard.doc_ids[shard.valid.astype(bool)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(ids), pa.string()), pa.array(ids)], ["path", "doc_id"])

    def take(t: pa.Table) -> pa.Table:
        shard = ShardReader(_Source(t["path"][0].as_py()))
        at = np.flatnonzero(np.isin(shard.doc_ids, np.asarray(t["doc_id"])) & shard.valid.astype(bool))
        ids, raw = zip(*((i, np.frombuffer(x, "<u4").astype(np.int64)) for i, x, _ in shard.documents(at)), strict=True)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "ids": pa.array(raw, pa.list_(pa.int64()))})

    index = manifest.select("path").mapInArrow(spans, "path string, doc_id long")
    return index.join(wanted.select("doc_id").distinct(), "doc_id").groupBy("path").applyInArrow(take, "doc_id long, ids array<long>")


def stored_ids(docs: DataFrame, model_path: str, end_id: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for each row of docs, as read back from the shards written for it."""
    manifest = write_shards(docs, work_path(docs.sparkSession, "shards"), model_path, end_id=end_id)
    return read_shards(manifest, zlib.crc32).withColumnRenamed("value", "ids_crc32")
