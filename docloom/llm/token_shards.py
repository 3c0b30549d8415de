"""Token-id shards as sorted string tables.

Documents are range-partitioned and sorted by key, and within a key by a hash of the text, so the shards in order hold the corpus in ascending key order and a key of many rows can be in several. A shard file holds:

* data blocks of about ``block_bytes``: entries (shared key bytes, other key bytes, value bytes as varints; the other key bytes; the value), a restart point
  with a whole key every ``RESTART`` entries, the restart offsets, their number, and a CRC-32;
* a sparse index: per block its last key, offset, size, CRC, the documents and the ids before it;
* a Bloom filter over the keys (10 bits a key, 7 probes);
* a footer of fixed size that tells where these are, the documents, the ids, the bytes an id takes, and a magic number.

A key is the big-endian identifier with its sign bit flipped, so bytes sort as numbers do; a null identifier is the empty key and sorts first. Equal keys are
kept, next to each other, and a lookup returns all of them. A null text is empty and has the end id only; an empty table gives no shard.

Each task attempt writes files of its own name, and only the manifest, written once the tasks have ended, names the files that count: a task that is
lost and run again leaves at most an unnamed file. Files are written and read through ``pyarrow.fs``, by the scheme of the shared folder.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bpe import encoder
from ._frames import column, keyed_text, partitions, shared_path, written
from ._words import slices

MAGIC = b"DLSSTAB1"
RESTART = 16
PROBES = 7
BITS_PER_KEY = 10
_FOOTER = struct.Struct("<QQQQQQQ8s")
_MANIFEST = "part int, seq int, path string, first binary, last binary, docs long, tokens long, bytes long"
_TYPES = (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    a = (a * 0x9E3779B97F4A7C15 + b) & ((1 << 64) - 1)
    return [(a + i * b) % bits for i in range(PROBES)]


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class ShardWriter:
    """Streams sorted entries to one file; holds one block and the keys' filter positions in memory."""

    def __init__(self, path: str, width: int, block_bytes: int = 1 << 16) -> None:
        self.path, self.width, self.block_bytes = path, width, block_bytes
        store, where = open_store(path)
        self.out = store.open_output_stream(where)
        self.block, self.restarts, self.entries, self.last = bytearray(), [], 0, b""
        self.index: list[tuple[bytes, int, int, int, int, int]] = []
        self.keys: list[bytes] = []
        self.size = self.docs = self.tokens = self.block_docs = self.block_tokens = 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.entries % RESTART:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.entries += 1
        if not self.keys or self.last != key:
            self.keys.append(key)
        self.last = key
        self.docs += 1
        self.tokens += len(value) // self.width
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if not self.entries:
            return
        data = bytes(self.block) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
        self.index.append((self.last, self.size, len(data), zlib.crc32(data), self.block_docs, self.block_tokens))
        self.out.write(data)
        self.size += len(data)
        self.block, self.restarts, self.entries = bytearray(), [], 0
        self.block_docs, self.block_tokens = self.docs, self.tokens

    def close(self) -> int:
        self._flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QQIQQ", *rest) for k, *rest in self.index)
        bits = max(64, -(-len(self.keys) * BITS_PER_KEY // 8) * 8)
        bloom = np.zeros(bits, bool)
        for key in self.keys:
            bloom[_probes(key, bits)] = True
        packed = np.packbits(bloom).tobytes()
        self.out.write(index)
        self.out.write(packed)
        self.out.write(_FOOTER.pack(self.size, len(index), self.size + len(index), len(packed), self.docs, self.tokens, self.width, MAGIC))
        self.out.close()
        return self.size + len(index) + len(packed) + _FOOTER.size


class ShardReader:
    """Reads footer, index and filter at once, and blocks as they are asked for."""

    def __init__(self, path: str) -> None:
        store, where = open_store(path)
        self.file = store.open_input_file(where)
        end = self.file.size()
        at, size, bloom_at, bloom_size, self.docs, self.tokens, self.width, magic = _FOOTER.unpack(self._at(end - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token shard")
        raw, self.blocks, i = self._at(at, size), [], 0
        while i < len(raw):
            n, i = _read_varint(raw, i)
            key, i = raw[i : i + n], i + n
            self.blocks.append((key, *struct.unpack_from("<QQIQQ", raw, i)))
            i += 36
        self.lasts = [b[0] for b in self.blocks]
        self.bloom, self.bits = self._at(bloom_at, bloom_size), bloom_size * 8

    def _at(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _block(self, i: int) -> bytes:
        _, at, size, crc, _, _ = self.blocks[i]
        data = self._at(at, size)
        if zlib.crc32(data) != crc:
            raise ValueError(f"block {i} is damaged")
        return data

    @staticmethod
    def _entries(data: bytes, at: int, end: int, key: bytes = b"") -> Iterator[tuple[bytes, bytes]]:
        while at < end:
            shared, at = _read_varint(data, at)
            other, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + other]
            at += other
            yield key, data[at : at + size]
            at += size

    def _scan(self, i: int, least: bytes = b"") -> Iterator[tuple[bytes, bytes]]:
        data = self._block(i)
        n = struct.unpack_from("<I", data, len(data) - 4)[0]
        end = len(data) - 4 - 4 * n
        restarts = struct.unpack_from(f"<{n}I", data, end)
        at = 0
        if least:  # the last restart whose key is smaller

            def restart_key(j: int) -> bytes:
                _, a = _read_varint(data, restarts[j])
                size, a = _read_varint(data, a)
                _, a = _read_varint(data, a)
                return data[a : a + size]

            at = restarts[max(0, bisect.bisect_left(range(n), least, key=restart_key) - 1)]
        return self._entries(data, at, end)

    def maybe(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _probes(key, self.bits))

    def get(self, key: bytes) -> list[np.ndarray]:
        """The id lists under ``key``, by Bloom filter, binary search of the index and of the block's restarts."""
        found: list[np.ndarray] = []
        if not self.maybe(key):
            return found
        for i in range(bisect.bisect_left(self.lasts, key), len(self.blocks)):
            for k, value in self._scan(i, key):
                if k > key:
                    return found
                if k == key:
                    found.append(self.ids(value))
        return found

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, "<u2" if self.width == 2 else "<u4").astype("<u4")

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.blocks)):
            for key, value in self._scan(i):
                yield key, self.ids(value)


def write_shards(docs: DataFrame, vocabulary: str, end_id: int, directory: str | None = None, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, shard_bytes: int = 256 << 20) -> DataFrame:
    """Writes the ids of every whole text, each followed by ``end_id``, and returns the manifest: part, seq (their order is the key order), path, first and last key, docs, tokens, bytes.

    ``shards``: key ranges, by default spark.sql.shuffle.partitions; a range of over ``shard_bytes`` has several files.
    """
    spark = docs.sparkSession
    directory = directory or shared_path(spark, "token-shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, writer, rows = TaskContext.get().partitionId(), 0, None, []
        tool = encoder(vocabulary)
        width = 2 if max(tool.tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else 4
        kind, end = ("<u2" if width == 2 else "<u4"), np.array([end_id])

        def close() -> None:
            rows.append((part, seq, writer.path, writer.keys[0], writer.last, writer.docs, writer.tokens, writer.close()))

        for batch in batches:
            for at, to in slices(batch.column(1)):
                ids, counts = tool.encode(batch.column(1).slice(at, to - at).to_pylist())
                ids, ends = ids.astype(kind), np.cumsum(counts)
                for doc_id, last, n in zip(batch.column(0).slice(at, to - at).to_pylist(), ends, counts, strict=True):
                    if writer is None:
                        if seq == 0:
                            store, where = open_store(directory)
                            store.create_dir(where, recursive=True)
                        writer = ShardWriter(f"{directory}/{part:06d}-{seq:04d}-{uuid.uuid4().hex}.sst", width)
                    writer.add(key_of(doc_id), np.concatenate([ids[last - n : last], end]).astype(kind).tobytes())
                    if writer.size >= shard_bytes:
                        close()
                        writer, seq = None, seq + 1
        if writer is not None:
            close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], ["part", "seq", "path", "first", "last", "docs", "tokens", "bytes"])

    part = keyed_text(docs, id_col, text_col)
    order = ("doc_id", F.xxhash64("text"))  # so that a key of many rows is cut, too
    ranged = part.repartitionByRange(shards or partitions(spark), *order).sortWithinPartitions(*order)
    return written(ranged.mapInArrow(run, _MANIFEST), "token-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every document in the shards: doc_id, start (ids of all documents before it, in key order), n_tokens, ids array<int>."""
    spark = manifest.sparkSession
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard file
    placed = manifest.withColumn("before", F.coalesce(F.sum("tokens").over(order), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                values: list[np.ndarray] = []
                held = 0

                def out() -> pa.RecordBatch:
                    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values).astype(np.int32)))
                    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), ids], ["doc_id", "start", "n_tokens", "ids"])

                for key, ids in ShardReader(path):
                    rows.append((id_of(key), start, len(ids)))
                    values.append(ids)
                    start += len(ids)
                    held += len(ids)
                    if held >= 1 << 19:
                        yield out()
                        rows, values, held = [], [], 0
                if rows:
                    yield out()

    spread = placed.select("path", "before").repartition(partitions(spark), "path")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids array<int>")


def lookup(manifest: DataFrame, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The ids of the documents that ``keys`` asks for (doc_id, ids): each key goes to the shards whose range holds it, and there through filter, index and block."""
    shards = [(bytes(r["first"]), bytes(r["last"]), r["path"]) for r in manifest.orderBy("part", "seq").select("first", "last", "path").collect()]  # one row a shard file
    lasts = [s[1] for s in shards]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id in batch.column(0).to_pylist():
                key = key_of(doc_id)
                for i in range(bisect.bisect_left(lasts, key), len(shards)):
                    if shards[i][0] > key:
                        break
                    out.append((shards[i][2], doc_id))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64())], ["path", "doc_id"])

    def read(asked: pa.Table) -> pa.Table:
        reader = ShardReader(asked.column("path")[0].as_py())
        found = [(i, ids.tolist()) for i in asked.column("doc_id").to_pylist() for ids in reader.get(key_of(i))]
        return pa.table({"doc_id": pa.array([f[0] for f in found], pa.int64()), "ids": pa.array([f[1] for f in found], pa.list_(pa.int32()))})

    wanted = keys.select(column(keys, id_col).cast("long").alias("doc_id")).distinct()
    return wanted.mapInArrow(route, "path string, doc_id long").groupBy("path").applyInArrow(read, "doc_id long, ids array<int>")
