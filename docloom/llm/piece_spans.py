"""SentencePiece encoding and decoding that keeps track of the original bytes.

The text is normalised here as the model says: at every place the longest prefix in the compiled character map (a double-array trie) is replaced, anything else is
copied, white space is escaped, and for each byte of the result the byte of the text that it came from is recorded. The pieces, laid end to end, are the
normalised text; their ends, looked up in that record, give each piece's span of original bytes. Ids and decoded text are the library's own.

Defined results: a null text is empty; an empty text has no pieces and decodes to an empty text; an unknown piece (models without byte fallback) covers what lies between
its known neighbours. Repeated rows and keys are encoded row by row; extra columns are passed over.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._frames import keyed_text
from ._words import slices, text_buffers

SPACE = "▁".encode()
SCHEMA = "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string"


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol buffer message: number and value (int, or bytes of a length-delimited or fixed field)."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 0x7F) << shift
            if b < 0x80:
                return n
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + size]
            at += size


class CharacterMap:
    """The compiled map: its size, the trie's 32-bit units, then the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.replacements = blob[4 + size :]

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest mapped prefix of ``data[at:]``."""
        units, found = self.units, None
        node = (units[0] >> 10) << ((units[0] & 0x200) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        end = self.replacements.index(b"\0", found[1])
        return found[0], self.replacements[found[1] : end]


@dataclass
class Model:
    """What the normaliser needs of a model file."""

    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # bytes of each piece; -1: unknown, 0: control
    bytes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # the byte that a piece stands for, or -1
    pieces: list[bytes] = field(default_factory=list)
    symbols: list[bytes] = field(default_factory=list)
    map: CharacterMap = field(default_factory=lambda: CharacterMap(b""))
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    suffix: bool = False

    @classmethod
    def read(cls, path: str) -> Model:
        with open(path, "rb") as f:
            data = f.read()
        model, sizes, bytes_ = cls(), [], []
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                name, kind = piece.get(1, b""), piece.get(3, 1)
                model.pieces.append(name)
                sizes.append({2: -1, 3: 0, 6: 1}.get(kind, len(name)))
                bytes_.append(int(name[1:-1], 16) if kind == 6 else -1)
                if kind == 4:
                    model.symbols.append(name)
            elif number == 2:
                model.suffix = bool(dict(_fields(value)).get(24, 0))
            elif number == 3:
                spec = dict(_fields(value))
                if 2 in spec:
                    model.map = CharacterMap(spec[2])
                for k, name in ((3, "dummy_prefix"), (4, "squeeze"), (5, "escape")):
                    setattr(model, name, bool(spec.get(k, getattr(model, name))))
        model.sizes, model.bytes = np.array(sizes, np.int64), np.array(bytes_, np.int64)
        return model

    @property
    def plain(self) -> bool:
        """Nothing but a prefix and escaped spaces changes."""
        return not self.map and not self.squeeze and self.escape and self.dummy_prefix and not self.suffix

    def _step(self, data: bytes, at: int) -> tuple[int, bytes]:
        """How many bytes at ``at`` are read, and what they become."""
        for symbol in self.symbols:
            if symbol and data.startswith(symbol, at):
                return len(symbol), symbol
        if self.map and (hit := self.map.longest(data, at)):
            return hit
        size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
        return size, data[at : at + size]

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each (and for their end) the original byte it came from."""
        at, end = 0, len(data)
        if self.squeeze:
            while at < end:
                size, out = self._step(data, at)
                if out != b" ":
                    break
                at += size
        if at >= end:
            return b"", np.array([0])
        mark = SPACE if self.escape else b" "
        result, origin = bytearray(), []

        def put(piece: bytes, *sources: int) -> None:
            for j, byte in enumerate(piece):
                source = sources[min(j, len(sources) - 1)]
                new = mark if byte == 0x20 else bytes([byte])
                result.extend(new)
                origin.extend([source] * len(new))

        if self.dummy_prefix and not self.suffix:
            put(b" ", at)
        was_space = self.squeeze
        while at < end:
            size, out = self._step(data, at)
            copied = out == data[at : at + size]
            if self.squeeze:
                while was_space and out.startswith(b" "):
                    out = out[1:]
            if out:
                put(out, *(range(at + size - len(out), at + size) if copied else (at,)))
                was_space = out.endswith(b" ")
            at += size
            if not self.squeeze:
                was_space = False
        if self.squeeze:
            while result.endswith(mark):
                del result[-len(mark) :]
                end = origin[-len(mark)]
                del origin[-len(mark) :]
        if self.dummy_prefix and self.suffix:
            put(b" ", end)
        return bytes(result), np.array([*origin, end])


_TOOLS: dict[str, tuple] = {}


def _tool(path: str) -> tuple:
    if path not in _TOOLS:
        import sentencepiece

        _TOOLS[path] = sentencepiece.SentencePieceProcessor(model_file=path), Model.read(path)
    return _TOOLS[path]


def _piece_sizes(model: Model, ids: list[int], normal: bytes) -> np.ndarray:
    """Bytes of each piece; an unknown one reaches to the next place from which its right neighbour reads on."""
    sizes = model.sizes[ids]
    at = 0
    for i in range(len(ids)):
        if sizes[i] < 0:
            after = next((model.pieces[j] for j in ids[i + 1 :] if model.sizes[j] > 1), b"")
            to = normal.find(after, at + 1) if after else len(normal)
            sizes[i] = (to if to >= 0 else len(normal)) - at
        at += int(sizes[i])
    return sizes


def spans(model: Model, texts: list[str], ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte, in the original UTF-8, of every piece of ``texts``, one text after another. Of a character in single bytes the last has the whole span, as the library has it."""
    begin, end = _spans(model, texts, ids)
    flat = np.fromiter((i for x in ids for i in x), np.int64, len(begin))
    value = model.bytes[flat] if len(flat) else flat
    alone = np.flatnonzero(value >= 0)
    if len(alone):
        lead = np.maximum.accumulate(np.where((value[alone] & 0xC0) != 0x80, np.arange(len(alone)), 0))
        begin[alone] = begin[alone][lead]
        more = alone[:-1][(np.diff(lead) == 0) & (np.diff(alone) == 1)]  # another byte of the character follows
        end[more] = begin[more]
    return begin, end


def _spans(model: Model, texts: list[str], ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([len(x) for x in ids], np.int64)
    flat = np.fromiter((i for x in ids for i in x), np.int64, int(counts.sum()))
    sizes = model.sizes[flat]
    if model.plain and not (sizes < 0).any():
        data, offsets = text_buffers(pa.array(texts, pa.large_string()))
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        width = np.where(data == 0x20, len(SPACE), 1)
        filled = offsets[:-1] < offsets[1:]
        width[offsets[:-1][filled]] += len(SPACE)
        origin = np.repeat(np.arange(len(data)), width)
        lengths = np.concatenate([[0], np.cumsum(width)])[offsets]
        to = np.cumsum(sizes)
        ends_at = np.concatenate([[0], to])[np.concatenate([[0], np.cumsum(counts)])]
        if (ends_at == lengths).all():
            first = np.repeat(offsets[:-1], counts)
            last = np.repeat(offsets[1:], counts)
            finish = np.repeat(lengths[1:], counts)
            source = np.append(origin, 0)
            begin = source[to - sizes] - first
            end = np.where(to == finish, last, source[np.minimum(to, len(origin))]) - first
            return begin, end
    begins, ends = [], []
    for text, own in zip(texts, ids, strict=True):
        normal, origin = model.normalise(text.encode())
        to = np.minimum(np.cumsum(_piece_sizes(model, own, normal)), len(normal))
        begins.append(origin[np.concatenate([[0], to[:-1]]).astype(np.int64)] if own else np.zeros(0, np.int64))
        ends.append(origin[to.astype(np.int64)] if own else np.zeros(0, np.int64))
    return np.concatenate([np.zeros(0, np.int64), *begins]), np.concatenate([np.zeros(0, np.int64), *ends])


def encode_decode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its ids, the original byte span of each piece, and the text that the ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, model = _tool(model_file)
        for batch in batches:
            for at, to in slices(batch.column(1)):
                texts = batch.column(1).slice(at, to - at).to_pylist()
                ids = tool.encode(texts, num_threads=1)
                begin, end = spans(model, texts, ids)
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32))
                flat = np.fromiter((i for x in ids for i in x), np.int32, len(begin))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (flat, begin, end)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), *lists, pa.array(tool.decode(ids, num_threads=1), pa.string())], ["doc_id", "ids", "begins", "ends", "decoded"])

    return keyed_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
