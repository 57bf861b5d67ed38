"""Token ids in binary files of fixed bit width.

A file holds the ids of documents in key order, each in the least number of bits that tells the
vocabulary's ids apart. 64 ids fill ``bits`` little-endian 64-bit words, so whole blocks are packed and
unpacked by a few shifts of numpy columns, and a document's ids are read without the blocks before it.

Layout: magic (8 bytes), bits and ids per block (32 bits each); the blocks, the last one filled up to 64 ids;
the keys as an Arrow stream; each document's first id and the number of all ids; each block's offset and the
end of the last; then the offsets of these three parts and the numbers of documents, blocks and ids (64 bits each).
"""

from __future__ import annotations

import sys
import types
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from communitylens.llm.store import written
from communitylens.session import checkpoint_dir

MAGIC = b"packed\x00\x01"
#: Ids in a block, a multiple of 64.
BLOCK = 1 << 14
#: Ids that a reader unpacks at once, for many documents together.
READ_IDS = 1 << 20
#: Pieces that a worker process remembers at most; beyond them it keeps those of at most SHORT characters.
MEMORY, SHORT = 600_000, 7
#: Characters of a piece that is remembered at most.
LONG = 48
#: Marks that are pre-tokens of their own behind a letter.
MARKS = ".,;:!?"


def width(vocabulary: int) -> int:
    """Bits that tell ``vocabulary`` ids apart."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each, filled up with zeros to a multiple of 64 ids."""
    groups = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    groups.reshape(-1)[:len(ids)] = ids
    out = np.zeros((len(groups), bits), "<u8")
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        out[:, word] |= groups[:, k] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= groups[:, k] >> np.uint64(64 - shift)
    return out.tobytes()


def unpack(data: bytes, bits: int) -> np.ndarray:
    """The ids of ``pack``, a multiple of 64 of them, as 32-bit numbers."""
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    out = np.empty((len(words), 64), "<u4")
    mask = np.uint64((1 << bits) - 1)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        ids = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            ids = ids | words[:, word + 1] << np.uint64(64 - shift)
        out[:, k] = ids & mask
    return out.reshape(-1)


def _filesystem(folder: str):
    """File system and path of a folder that Spark names."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder[len("file:"):].lstrip("/")
    elif folder.startswith("s3a:"):
        folder = "s3:" + folder[len("s3a:"):]
    return fs.FileSystem.from_uri(folder)


class Writer:
    """Writes one file, block by block; holds one block and the index."""

    def __init__(self, folder: str, bits: int, name: str | None = None):
        system, path = _filesystem(folder)
        system.create_dir(path, recursive=True)
        self.name = name or f"{uuid.uuid4().hex}.ids"
        self.file = system.open_output_stream(f"{path}/{self.name}")
        self.file.write(MAGIC + np.array([bits, BLOCK], "<u4").tobytes())
        self.bits, self.at = bits, len(MAGIC) + 8
        self.waiting, self.n_waiting, self.n_ids = [], 0, 0
        self.keys, self.sizes, self.offsets = [], [], [self.at]

    def add(self, keys: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Append documents: their keys, their numbers of ids, and all these ids."""
        self.keys.append(keys)
        self.sizes.append(np.asarray(sizes, "<i8"))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= BLOCK:
            ids = np.concatenate(self.waiting)
            whole = len(ids) // BLOCK * BLOCK
            for first in range(0, whole, BLOCK):
                self._block(ids[first:first + BLOCK])
            self.waiting, self.n_waiting = [ids[whole:].copy()], len(ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.file.write(data)
        self.at += len(data)
        self.offsets.append(self.at)

    def close(self) -> tuple[str, int, int]:
        """Write what is left and the index; (name, documents, ids)."""
        if self.n_waiting:
            self._block(np.concatenate(self.waiting))
        keys = pa.chunked_array(self.keys)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("key", keys.type)])) as stream:
            stream.write_table(pa.table({"key": keys}))
        parts = [
            sink.getvalue().to_pybytes(),
            np.concatenate([np.zeros(1, "<i8"), np.cumsum(np.concatenate(self.sizes), dtype="<i8")]).tobytes(),
            np.array(self.offsets, "<i8").tobytes(),
        ]
        places = np.cumsum([self.at] + [len(p) for p in parts])
        tail = np.array([*places[:3], len(keys), len(self.offsets) - 1, self.n_ids], "<i8")
        self.file.write(b"".join(parts) + tail.tobytes())
        self.file.close()
        return self.name, len(keys), self.n_ids


class Reader:
    """Random access to one file by document or by id number."""

    def __init__(self, folder: str, name: str):
        system, path = _filesystem(folder)
        self.file = system.open_input_file(f"{path}/{name}")
        head, size = self.file.read_at(len(MAGIC) + 8, 0), self.file.size()
        if head[:len(MAGIC)] != MAGIC:
            raise ValueError(f"{name} is no file of packed ids")
        self.bits, self.block = (int(x) for x in np.frombuffer(head, "<u4", 2, len(MAGIC)))
        keys, starts, offsets, self.n_docs, n_blocks, self.n_ids = (
            int(x) for x in np.frombuffer(self.file.read_at(48, size - 48), "<i8"))
        self.keys = pa.ipc.open_stream(self.file.read_at(starts - keys, keys)).read_all().column("key")
        self.starts = np.frombuffer(self.file.read_at(offsets - starts, starts), "<i8")
        self.offsets = np.frombuffer(self.file.read_at(8 * (n_blocks + 1), offsets), "<i8")

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids number first to last (exclusive); only the blocks that hold them are read."""
        if first >= last:
            return np.zeros(0, "<u4")
        low, high = first // self.block, -(-last // self.block)
        at = int(self.offsets[low])
        ids = unpack(self.file.read_at(int(self.offsets[high]) - at, at), self.bits)
        return ids[first - low * self.block:last - low * self.block]

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document."""
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def runs(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first document, last, their ids) over the file, about READ_IDS ids at a time."""
        first = 0
        while first < self.n_docs:
            last = int(np.searchsorted(self.starts, self.starts[first] + READ_IDS, side="right")) - 1
            last = min(self.n_docs, max(last, first + 1))
            yield first, last, self.ids(int(self.starts[first]), int(self.starts[last]))
            first = last


class Encoder(dict):
    """Ids of texts as the tokenizers library gives them, by piece of text, remembering pieces.

    Pre-tokens hold no blanks or line ends and pieces of text between these do not influence each other, so
    each distinct piece is encoded once. Letters that are their own normal form but for case, alone or before
    marks, go to the library's merge model directly, all other pieces through its whole chain.
    """

    def __init__(self, path: str):
        import tokenizers

        super().__init__()
        self.library = tokenizers.Tokenizer.from_file(path)
        self.merged = self.library.model.tokenize
        self.plain = frozenset(chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)) if c not in (0xD7, 0xF7))
        printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(printable)]
        signs = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
        self.signs = {ord(c): "".join(signs[b] for b in c.encode()) for c in self.plain}  # letters as characters for their bytes

    @property
    def vocabulary(self) -> int:
        return self.library.get_vocab_size(with_added_tokens=True)

    def __missing__(self, piece: str) -> bytes:
        word = piece.rstrip(MARKS)
        if word and len(word) < len(piece):
            coded = self[word] + self[piece[len(word):]] if word[-1] in self.plain else self._whole(piece)
        elif word.isalpha() and (word.isascii() or self.plain.issuperset(word)):
            low = word.lower()
            if low != word:
                coded = self[low]
            else:
                coded = array("I", [t.id for t in self.merged(word if word.isascii() else word.translate(self.signs))]).tobytes()
        else:
            coded = self._whole(piece)
        if len(piece) <= LONG:
            self[piece] = coded
        return coded

    def _whole(self, piece: str) -> bytes:
        return array("I", self.library.encode_batch_fast([piece], add_special_tokens=False)[0].ids).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit numbers."""
        if len(self) > MEMORY:  # short pieces are the ones that come again
            short = {piece: coded for piece, coded in self.items() if len(piece) <= SHORT}
            self.clear()
            if len(short) <= MEMORY // 2:
                self.update(short)
        return [b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))) for text in texts]


def _encoder(path: str) -> Encoder:
    """The worker process's encoder of a file; it keeps its pieces from task to task."""
    kept = sys.modules.setdefault("_packed_encoders", types.ModuleType("_packed_encoders"))
    if path not in vars(kept):
        vars(kept)[path] = Encoder(path)
    return vars(kept)[path]


def _one_thread() -> None:
    """A task has one core: keep the library from starting threads of its own."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def write(df: DataFrame, folder: str, path: str, key: str = "doc_id", end: int | None = 1, rows: int = 500) -> DataFrame:
    """Encode ``text`` of every row and write the ids in key order; returns the table of files.

    df needs ``key`` and text; other columns are not used. A null text is empty: only the end id is written
    (nothing where ``end`` is None). Null keys come first; rows with one key are ordered by a hash of their
    text and are dealt to several files where they are many. Files hold ranges of keys; ``part`` is a file's place
    in the order. A file belongs to the data once it is in the returned table, which is written by Spark: files of
    failed attempts are never named there; ``first`` is its first key. ``rows`` texts are encoded at a time.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        _one_thread()
        writer = None
        coder = _encoder(path)
        bits, ending = width(max(coder.vocabulary, (end or 0) + 1)), b"" if end is None else np.array([end], "<u4").tobytes()
        for batch in batches:
            for first in range(0, batch.num_rows, rows):
                part = batch.slice(first, rows)
                coded = [c + ending for c in coder([t or "" for t in part.column("text").to_pylist()])]
                writer = writer or Writer(folder, bits)
                writer.add(part.column(key), np.array([len(c) // 4 for c in coded]), np.frombuffer(b"".join(coded), "<u4"))
        if writer:
            name, n_docs, n_ids = writer.close()
            yield pa.RecordBatch.from_arrays([
                pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name]), pa.array([n_docs]), pa.array([n_ids]),
                writer.keys[0].slice(0, 1)], ["part", "name", "n_docs", "n_ids", "first"])

    keyed = df.select(
        F.col(key), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("print"),
        F.monotonically_increasing_id().alias("row"))
    order = [F.asc_nulls_first(key), F.asc("print"), F.asc("row")]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select(key, "text")
    return written(ordered.mapInArrow(run, f"part int, name string, n_docs bigint, n_ids bigint, first {kind}"))


def read(spark: SparkSession, folder: str, files: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start (ids of all documents before it) and ids (little-endian 32-bit numbers) of every document.

    ``files`` is the table that ``write`` returned. Each file is one task's work and is read in runs of blocks.
    """
    rows = sorted(files.select("part", "name", "n_ids").collect())  # one row a file
    starts = np.concatenate([[0], np.cumsum([r.n_ids for r in rows], dtype=np.int64)]).tolist()
    shared = spark.sparkContext.broadcast([(r.name, start) for r, start in zip(rows, starts[:-1], strict=True)])
    kind = files.schema["first"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                name, before = shared.value[k]
                reader = Reader(folder, name)
                for first, last, ids in reader.runs():
                    starts = reader.starts[first:last + 1]
                    data = pa.py_buffer(np.ascontiguousarray(ids))
                    places = pa.py_buffer((starts - starts[0]) * 4)
                    yield pa.RecordBatch.from_arrays([
                        reader.keys.slice(first, last - first).combine_chunks(), pa.array(starts[:-1] + before),
                        pa.Array.from_buffers(pa.large_binary(), last - first, [None, places, data]).cast(pa.binary()),
                    ], [key, "start", "ids"])

    return spark.range(0, len(rows), 1, max(1, len(rows))).mapInArrow(run, f"{key} {kind}, start bigint, ids binary")


def folder_for(spark: SparkSession) -> str:
    """A new folder for files under ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark)}/ids-{uuid.uuid4().hex}"
