"""Links: connected components over DataFrames, and within a group in memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import written


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``links`` (a, b) to (node, root): every node's least node in reach, by alternating large and small stars until only stars are left;
    the rounds needed grow with the logarithm of the longest path, and running out of them is an error.

    Each star step takes a minimum by node, combined before the shuffle, and joins it back one to many. The minima of large stars are written first, so both sides of their join are only shuffled and Spark can split
    a hot node; the links of every round are written, too. Only stars are left when no node has two lower neighbours and every minimum is one of itself: the minima are then the result.
    """
    now = written(links.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    for _ in range(rounds):
        both = now.select("a", "b", F.lit(0).alias("lower")).union(now.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(1)))
        least = written(both.groupBy("a").agg(F.min("b").alias("m"), F.sum("lower").alias("lower")).select("a", F.least("a", "m").alias("m"), "lower"), "least")
        seen = least.agg(F.max("lower").alias("lower"), F.count_if(F.col("a") == F.col("m")).alias("roots"), F.countDistinct("m").alias("minima")).first()
        if (seen["lower"] or 0) <= 1 and seen["minima"] == seen["roots"]:
            return least.select(F.col("a").alias("node"), F.col("m").alias("root"))
        lower = now.join(least, "a").select(F.col("b").alias("u"), F.col("m").alias("v"))  # a < b always: the lower neighbours of b
        roots = lower.groupBy("u").agg(F.min("v").alias("m"))
        small = lower.join(roots, "u").select("m", F.col("v").alias("w")).filter(F.col("m") != F.col("w")).union(roots.select("m", F.col("u").alias("w")))
        now = written(small.select(F.col("m").alias("a"), F.col("w").alias("b")).distinct(), "links")
    raise RuntimeError(f"links still change after {rounds} rounds")


def connect(n: int, linked: Callable[[int], np.ndarray], asked: np.ndarray | None = None) -> np.ndarray:
    """Component labels of n records, where ``linked(i)`` gives all records linked with i.

    Only records outside the largest component are asked for their links, until the others are all in one: of two records in different components one has been asked, so no link is
    missed, and a group of near copies takes few comparisons. ``asked``: records of which alone links are wanted.
    """
    label = np.arange(n)
    todo = np.ones(n, bool) if asked is None else asked.copy()
    while True:
        sizes = np.bincount(label, minlength=n)
        waiting = np.flatnonzero(todo)
        if asked is None:
            waiting = waiting[label[waiting] != sizes.argmax()] if sizes.max() > 1 else waiting
        if not len(waiting) or sizes.max() == n:
            return label
        i = int(waiting[0])
        todo[i] = False
        met = np.unique(label[np.append(linked(i), i)])
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables that hold whole groups, of batches sorted by their first ``keys`` columns."""
    held: list[pa.RecordBatch] = []

    def key(b: pa.RecordBatch, i: int) -> tuple:
        return tuple(b.column(j)[i].as_py() for j in range(keys))

    for batch in batches:
        if not batch.num_rows:
            continue
        last = key(batch, batch.num_rows - 1)
        if held and key(held[-1], held[-1].num_rows - 1) == last == key(batch, 0):
            held.append(batch)
            continue
        low, high = 0, batch.num_rows - 1  # the first row of the last group
        while low < high:
            mid = (low + high) // 2
            if key(batch, mid) == last:
                high = mid
            else:
                low = mid + 1
        done = [*held, batch.slice(0, low)] if low else held
        if sum(b.num_rows for b in done):
            yield pa.Table.from_batches(done).combine_chunks()
        held = [batch.slice(low)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def edges_of(*columns: pa.ChunkedArray) -> np.ndarray:
    """Where groups begin in columns sorted by group, and the number of rows."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        values = c.to_numpy(zero_copy_only=False)
        new[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(new), n)
