"""Packing of token pieces into fixed-length sequences as a cutting-stock problem, solved by column generation.

1. Every document is cut into full pieces of ``capacity`` ids and one rest. Only rests need packing: a full piece is a sequence.
2. The histogram of rest lengths, in classes of ``unit`` ids (at most capacity / unit numbers, whatever the corpus), goes to the driver.
3. A linear program over patterns (how many rests of each class share a sequence) is solved there by the revised simplex method. Its columns are priced by an unbounded
   knapsack dynamic program; generation stops when Farley's bound shows the program within ``gap`` of its optimum.
4. Patterns are rounded down; what the roundings leave over is packed by first fit, largest first.
5. Documents are ranked within their class, in (class, salt) groups plus group offsets, so that no class, however common, is one task's work; a
   rank gives pattern, sequence and slot by binary search in the rounded plan.

Defined results: a null text is empty and has the end id only; an empty table gives no rows; repeated rows and keys are pieces of their own, ordered by
key, place and checksum; extra columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bpe import encoder
from ._frames import keyed_text, partitions, written
from ._words import slices

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>"


@dataclass(frozen=True)
class Plan:
    """Rounded patterns as ranges of ranks: ranks from ``base`` of ``kind`` fill sequences from ``first``, ``each`` of them in one, from ``slot`` on."""

    kind: np.ndarray
    base: np.ndarray
    each: np.ndarray
    first: np.ndarray
    slot: np.ndarray
    sequences: int
    bound: float


def _knapsack(weights: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: an unbounded knapsack by dynamic programming over the used capacity."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    live = np.flatnonzero(values > 1e-12)
    order = live[np.argsort(weights[live], kind="stable")]
    w, v = weights[order], values[order]
    upto = np.searchsorted(w, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            gains = best[c - w[:k]] + v[:k]
            i = int(gains.argmax())
            if gains[i] > best[c] + 1e-12:
                best[c], took[c] = gains[i], order[i]
    counts, c = np.zeros(len(weights)), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[took[c]] += 1
            c -= weights[took[c]]
    return float(best[capacity]), counts


def _inverted(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan inversion with row exchanges: a few hundred rows need no threaded library, whose threads would compete with the session's."""
    n = len(matrix)
    a = np.hstack([matrix, np.eye(n)])
    for i in range(n):
        best = i + int(np.abs(a[i:, i]).argmax())
        if best != i:
            a[[i, best]] = a[[best, i]]
        a[i] /= a[i, i]
        factors = a[:, i].copy()
        factors[i] = 0
        rows = np.flatnonzero(factors)
        a[rows] -= factors[rows, None] * a[i]
    return a[:, n:]


def cutting_stock(weights: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-4, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray, float]:
    """Patterns (rows), how often each is cut in the linear program, and a lower bound on the sequences."""
    n = len(weights)
    basis = np.diag((capacity // weights).astype(float))  # columns are patterns
    inverse = np.diag(1 / np.diag(basis))
    cost, amount, bound = np.ones(n), demand / np.diag(basis), 0.0
    for step in range(rounds):
        duals = (cost[:, None] * inverse).sum(axis=0)
        total = float((cost * amount).sum())
        if duals.min() < -1e-9:  # more of this class than asked for is allowed
            entering, price = np.zeros(n), 0.0
            entering[int(duals.argmin())] = -1.0
        else:
            value, entering = _knapsack(weights, duals, capacity)
            price = 1.0
            bound = max(bound, total / max(value, 1e-12))
            if value <= 1 + 1e-9 or total - bound <= gap * total:
                break
        held = np.flatnonzero(entering)
        direction = (inverse[:, held] * entering[held]).sum(axis=1)
        ratios = np.where(direction > 1e-11, amount / np.where(direction > 1e-11, direction, 1), np.inf)
        out = int(ratios.argmin())
        if not np.isfinite(ratios[out]):
            break
        basis[:, out], cost[out] = entering, price
        if step % 200 == 199:
            inverse = _inverted(basis)
            amount = np.maximum((inverse * demand).sum(axis=1), 0)
        else:
            row = inverse[out] / direction[out]
            inverse -= np.outer(direction, row)
            inverse[out] = row
            amount = np.maximum(amount - direction * ratios[out], 0)
            amount[out] = ratios[out]
    real = cost > 0
    return basis[:, real].T.round().astype(np.int64), amount[real], bound


def _first_fit(weights: np.ndarray, left: np.ndarray, capacity: int) -> list[np.ndarray]:
    """What roundings left over, largest first, each into the first sequence with room."""
    free, rows = np.zeros(0, np.int64), []
    for i in np.argsort(-weights, kind="stable"):
        n, w = int(left[i]), int(weights[i])
        while n:
            fits = np.flatnonzero(free >= w)
            if not len(fits):
                free = np.append(free, capacity)
                rows.append(np.zeros(len(weights), np.int64))
                fits = np.array([len(free) - 1])
            k = min(n, int(free[fits[0]]) // w)
            free[fits[0]] -= k * w
            rows[fits[0]][i] += k
            n -= k
    return rows


def plan(histogram: dict[int, int], capacity_units: int, gap: float = 1e-4) -> Plan:
    """``histogram``: pieces by class; a class is its length in units, rounded up."""
    kinds = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[int(k)] for k in kinds], np.int64)
    rows: list[np.ndarray] = []
    times: list[int] = []
    bound = 0.0
    if len(kinds):
        patterns, amount, bound = cutting_stock(kinds, demand.astype(float), capacity_units, gap)
        whole = np.floor(amount + 1e-6).astype(np.int64)
        left = demand - (whole[:, None] * patterns).sum(axis=0)
        for p, m in zip(patterns, whole, strict=True):
            if m > 0:
                rows.append(p)
                times.append(int(m))
        extra = _first_fit(kinds, np.maximum(left, 0), capacity_units)
        rows += extra
        times += [1] * len(extra)
    out: list[tuple[int, int, int, int, int]] = []
    used, first = np.zeros(len(kinds), np.int64), 0
    for p, m in zip(rows, times, strict=True):
        slot = 0
        for i in np.flatnonzero(p):
            out.append((int(kinds[i]), int(used[i]), int(p[i]), first, slot))
            used[i] += m * p[i]
            slot += int(p[i])
        first += m
    out.sort()
    columns = [np.array([r[j] for r in out], np.int64) for j in range(5)]
    return Plan(*columns, first, bound)


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", keep_space: bool = False, ids: bool = True) -> DataFrame:
    """The pieces of every whole text: full ones of ``capacity`` ids and a rest. Without ``ids`` that column is null, its checksum is there all the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary, keep_space)
        for batch in batches:
            for at, to in slices(batch.column(1)):
                flat, counts = tool.encode(batch.column(1).slice(at, to - at).to_pylist())
                rows: list[tuple] = []
                parts: list[np.ndarray] = []
                done = 0
                for doc_id, n in zip(batch.column(0).slice(at, to - at).to_pylist(), counts, strict=True):
                    own = np.append(flat[done : done + n], end_id).astype("<u4")
                    done += n
                    for start in range(0, len(own), capacity):
                        piece = own[start : start + capacity]
                        rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(own)))
                        parts.append(piece)
                columns = [pa.array([r[j] for r in rows], pa.int64()) for j in range(5)]
                offsets = pa.array(np.concatenate([[0], np.cumsum([r[2] for r in rows])]).astype(np.int32))
                held = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts).astype(np.int32))) if ids else pa.nulls(len(rows), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*columns, held], [x.split()[0] for x in PIECES.split(", ")])

    return keyed_text(docs, id_col, text_col).mapInArrow(run, PIECES)


def pack(pieces: DataFrame, capacity: int = 2048, unit: int = 8, gap: float = 1e-4, salts: int | None = None, late: tuple[str, ...] = ()) -> DataFrame:
    """``pieces`` (at least doc_id, start, length, ids_crc32; at most ``capacity`` long) with sequence_id and offset.

    ``unit``: lengths are rounded up to it for the plan only. ``salts``: groups in which a class is ranked, by default spark.sql.shuffle.partitions. ``late``: large columns, which are joined to the placed pieces
    at the end instead of being carried along.
    """
    spark = pieces.sparkSession
    names = pieces.columns
    whole = written(pieces.withColumn("__piece", F.monotonically_increasing_id()), "pieces")
    pieces = whole.drop(*late)
    kind = F.least(F.ceil(F.col("length") / unit), F.lit(capacity // unit)).cast("long")
    salt = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts or partitions(spark)))
    marked = pieces.withColumns({"__kind": kind, "__salt": salt})
    rows = marked.groupBy("__kind", "__salt").agg(F.count("*").alias("__n"))
    histogram = {r["__kind"]: r["n"] for r in rows.groupBy("__kind").agg(F.sum("__n").alias("n")).collect()}  # at most capacity / unit rows
    made = plan(histogram, capacity // unit, gap)
    big = 1 << 44
    starts = made.kind * big + made.base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = b.column(b.schema.get_field_index("__kind")).to_numpy()
            ranks = b.column(b.schema.get_field_index("__rank")).to_numpy()
            i = np.searchsorted(starts, kinds * big + ranks, side="right") - 1
            turn, place = np.divmod(ranks - made.base[i], made.each[i])
            kept = [x.name for x in b.schema if x.name not in ("__kind", "__rank")]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in kept), pa.array(made.first[i] + turn), pa.array(made.slot[i] + place)], [*kept, "sequence_id", "__slot"])

    before = rows.withColumn("__before", F.sum("__n").over(Window.partitionBy("__kind").orderBy("__salt")) - F.col("__n")).drop("__n")
    within = Window.partitionBy("__kind", "__salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = marked.withColumn("__in", F.row_number().over(within)).join(before, ["__kind", "__salt"]).withColumn("__rank", F.col("__before") + F.col("__in") - 1)
    ranked = ranked.select("__kind", "__rank", *pieces.columns)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    placed = ranked.mapInArrow(run, f"{fields}, sequence_id long, __slot long")
    order = Window.partitionBy("sequence_id").orderBy("__slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("offset", F.sum("length").over(order) - F.col("length"))
    if late:
        placed = placed.join(whole.select("__piece", *late), "__piece")
    return placed.select(*names, "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, unit: int = 8) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    return pack(token_pieces(docs, vocabulary, end_id, capacity, id_col, text_col, ids=ids), capacity, unit, late=("ids",) if ids else ())
