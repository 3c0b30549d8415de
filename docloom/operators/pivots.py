"""Exact nearest vectors by cosine, in cells around pivots: the triangle inequality decides which cells a query visits.

Vectors are brought to length 1, where the cosine falls as the Euclidean distance grows. Pivots are centres of a bounded sample; every vector goes to the cell of its nearest pivot. No vector of a cell is nearer to query q

* than the ring of the cell's distances to its pivot is to d(q, pivot), nor
* than the plane between the two pivots, (d(q, pivot)^2 - d(q, own pivot)^2) / 2 d(pivot, own pivot).

Neighbouring cells share a bucket, so that a query is sent once for many cells. It first meets the bucket of its own cell, that cell first, whose k-th neighbour bounds how far it has to look; then it is sent to the buckets
with a cell that can hold something nearer, and meets those cells only, and of them the vectors whose distance to the pivot is within its bound. The sample decides how much is pruned, never what is found.

Equal vectors are one: a class keeps the k + 1 smallest identifiers, so copies of a third of all rows are compared once. A crowded cell is split into parts, and the queries of a part into several tasks, so neither a crowded
cell nor a hot query group is one task; a task holds one part and a few queries at a time. Where vectors have no clusters nothing can be pruned, and all pairs are computed, as any exact method would.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import saved

#: Pivots at most, and rows of the sample that they are the centres of.
MOST_PIVOTS, SAMPLE_ROWS = 1024, 16_384
#: What rounding may change in a distance of unit vectors.
_SLACK = 1e-6


def finite(name: str):
    """Whether a vector can be compared."""
    return F.col(name).isNotNull() & ~F.exists(name, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def unit_rows(column: pa.Array) -> np.ndarray:
    """Rows of a list column as doubles of length 1; a vector of zeros stays."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` to all of ``b``."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0))


def centres(sample: np.ndarray, n: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """k-means centres of a sample, begun at rows drawn by their squared distance to those drawn before."""
    rng = np.random.default_rng(seed)
    picked = [sample[0]]
    gap = distances(sample, sample[:1])[:, 0] ** 2
    while len(picked) < n and gap.sum() > 1e-12:
        picked.append(sample[rng.choice(len(sample), p=gap / gap.sum())])
        gap = np.minimum(gap, distances(sample, picked[-1][None])[:, 0] ** 2)
    at = np.array(picked)
    for _ in range(rounds):
        near = distances(sample, at).argmin(1)
        at = np.array([sample[near == i].mean(0) if (near == i).any() else at[i] for i in range(len(at))])
    return at


def _placed(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(key, unit, cell, far): the nearest pivot and the distance to it, of (key, embedding)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u = unit_rows(b.column(1))
                d = distances(u, pivots)
                cell = d.argmin(1)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(u.ravel()), u.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(u)), cell])], ["key", "unit", "cell", "far"])

    kind = vectors.schema["key"].dataType.simpleString()
    return vectors.mapInArrow(place, f"key {kind}, unit array<double>, cell int, far double")


class _Cells:
    """Pivots, and of each cell the number of vectors, the ring of their distances, its bucket; of each bucket the number of its parts."""

    def __init__(self, pivots: np.ndarray, counts: dict[int, tuple[int, float, float]], part_rows: int) -> None:
        self.pivots, self.between = pivots, distances(pivots, pivots)
        self.full = np.array(sorted(counts))  # cells that hold any vector
        n, self.low, self.high = np.zeros(len(pivots), np.int64), np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
        for cell, (rows, low, high) in counts.items():
            n[cell], self.low[cell], self.high[cell] = rows, low, high
        self.bucket, self.parts = np.full(len(pivots), -1), []
        for cell in self.full[np.argsort(-n[self.full])]:  # a crowded cell begins a bucket, its nearest neighbours fill it up
            if self.bucket[cell] < 0:
                free = [c for c in self.full[np.argsort(self.between[cell][self.full], kind="stable")] if self.bucket[c] < 0]
                room = np.cumsum(n[free]) <= max(part_rows, n[cell])
                self.bucket[[c for c, fits in zip(free, room, strict=True) if fits]] = len(self.parts)
                self.parts.append(int(-(-n[cell] // part_rows)))

    def nearest_full(self, unit: np.ndarray) -> np.ndarray:
        return self.full[distances(unit, self.pivots[self.full]).argmin(1)]

    def least(self, to: np.ndarray, cells: np.ndarray, own: np.ndarray, far: np.ndarray) -> np.ndarray:
        """How near a vector of a cell can be to a query at least. ``to``: distances of queries to the pivots of ``cells``; ``own``, ``far``: a query's nearest pivot, and the distance to it."""
        ring = np.maximum(to - self.high[cells][None, :], self.low[cells][None, :] - to)
        gap = self.between[own][:, cells]
        return np.maximum(ring, np.where(gap > 1e-9, (to**2 - far[:, None] ** 2) / np.maximum(2 * gap, 1e-12), 0))


def _reach(kth: np.ndarray) -> np.ndarray:
    """The distance of the cosine ``kth``, with what rounding may add."""
    return np.sqrt(np.maximum(2 - 2 * kth, 0)) + 2 * _SLACK


def _answers(at: _Cells, corpus: tuple, rows: pa.RecordBatch, k: int, floor: float) -> pa.RecordBatch:
    """(query, key, similarity, cost) of a few queries against one part: all that may be among the ``k`` + 1 best."""
    keys, m, far, edges, cells = corpus
    q, own, own_far, home = unit_rows(rows.column("unit")), *(rows.column(c).to_numpy() for c in ("cell", "far", "home"))
    bound, kth = rows.column("bound").to_numpy().copy(), np.full(len(q), -np.inf)
    top = np.full((len(q), k + 1), -np.inf)
    found, cost = [], 0

    def meet(some: np.ndarray, low: int, high: int) -> None:
        nonlocal cost
        similar = q[some] @ m[low:high].T
        cost += similar.size
        top[some] = np.partition(np.concatenate([top[some], similar], axis=1), -(k + 1), axis=1)[:, -(k + 1) :]
        kth[some] = top[some].min(axis=1)
        bound[some] = np.minimum(bound[some], _reach(np.maximum(np.maximum(kth[some], floor), -1.0)))
        row, place = np.nonzero(similar >= np.maximum(kth[some], floor)[:, None])
        found.append((some[row], low + place, similar[row, place]))

    for i, cell in enumerate(cells):
        if len(mine := np.flatnonzero(home == cell)):
            meet(mine, edges[i], edges[i + 1])
    to = distances(q, at.pivots[cells])
    least = at.least(to, cells, own, own_far)
    for i, cell in enumerate(cells):
        some = np.flatnonzero((least[:, i] <= bound + _SLACK) & (home != cell))
        if len(some):
            ring = far[edges[i] : edges[i + 1]]
            low, high = np.searchsorted(ring, (to[some, i] - bound[some]).min() - _SLACK), np.searchsorted(ring, (to[some, i] + bound[some]).max() + _SLACK, side="right")
            if high > low:
                meet(some, edges[i] + low, edges[i] + high)
    row, place, similar = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    best = similar >= kth[row]
    costs = np.zeros(int(best.sum()), np.int64)
    costs[:1] = cost
    return pa.RecordBatch.from_arrays([rows.column("key").take(pa.array(row[best])), keys.take(pa.array(place[best])), pa.array(similar[best]), pa.array(costs)], ["query", "key", "similarity", "cost"])


def _searched(at: _Cells, k: int, floor: float, few: int = 256):
    """Searches rows (bucket, part, turn, kind, key, unit, cell, far, home, bound), sorted so that a part's corpus, by cell and distance to its pivot, comes before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, corpus = None, [], None
        for b in batches:
            places = np.stack([b.column(c).to_numpy() for c in ("bucket", "part", "turn", "kind")], axis=1)
            edges = np.flatnonzero(np.r_[True, (places[1:] != places[:-1]).any(1), True]) if b.num_rows else [0]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                rows, here = b.slice(i, j - i), tuple(places[i].tolist())
                if here[:3] != group:
                    group, held, corpus = here[:3], [], None
                if here[3] == 0:
                    held.append(rows)
                    continue
                if held:
                    whole = pa.Table.from_batches(held).combine_chunks()
                    cell = whole["cell"].to_numpy()
                    cuts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
                    corpus, held = (whole["key"].combine_chunks(), unit_rows(whole["unit"].combine_chunks()), whole["far"].to_numpy(), cuts, cell[cuts[:-1]]), []
                if corpus is not None:
                    for start in range(0, rows.num_rows, few):
                        yield _answers(at, corpus, rows.slice(start, few), k, floor)

    return run


def nearest_classes(corpus: DataFrame, queries: DataFrame, k: int, floor: float = -1.0, part_rows: int = 16_384, task_queries: int = 16_384) -> tuple[DataFrame, DataFrame]:
    """(query, key, similarity) that holds the ``k`` + 1 most alike rows of ``corpus`` (key, embedding) for each of ``queries`` (key, embedding), ties included, and a table of costs (cost: cosines computed).

    All vectors have one length.
    """
    spark = corpus.sparkSession
    kind = corpus.schema["key"].dataType.simpleString()
    first = corpus.select(F.size("embedding").alias("n")).first()
    if first is None:
        none = spark.createDataFrame([], f"query {kind}, key {kind}, similarity double, cost long")
        return none.select("query", "key", "similarity"), none.select("cost")
    width = 8 * max(first["n"], 1)
    rows, most, part_rows = corpus.count(), max(256, min(SAMPLE_ROWS, (64 << 20) // width)), max(1, min(part_rows, (64 << 20) // width))
    sample = corpus.sample(min(1.0, 1.2 * most / rows), seed=11).limit(most).select("embedding").collect() or corpus.limit(1).select("embedding").collect()  # at most 64 MB; decides the pruning only
    pivots = centres(unit_rows(pa.array([r["embedding"] for r in sample], pa.list_(pa.float64()))), int(min(MOST_PIVOTS, max(1, rows**0.5 / 2))))
    stored = saved(_placed(corpus, pivots))
    counts = {r["cell"]: (r["n"], r["low"], r["high"]) for r in stored.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect()}  # a row a pivot
    at = _Cells(pivots, counts, part_rows)

    def with_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the nearest cell that holds any vector."""
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.nearest_full(unit_rows(b.column("unit"))).astype(np.int32))], [*b.schema.names, "home"])

    def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries to the buckets, but that of their home, with a cell that their bound reaches."""
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                own, far, home, bound = (part.column(c).to_numpy() for c in ("cell", "far", "home", "bound"))
                reached = at.least(distances(unit_rows(part.column("unit")), pivots[at.full]), at.full, own, far) <= bound[:, None] + _SLACK
                to = np.zeros((part.num_rows, len(at.parts)), bool)
                row, column = np.nonzero(reached)
                to[row, at.bucket[at.full[column]]] = True
                to[np.arange(part.num_rows), at.bucket[home]] = False
                row, bucket = np.nonzero(to)
                yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), *(c.take(pa.array(row)) for c in part.columns)], ["bucket", *part.schema.names])

    def round_of(visiting: DataFrame) -> DataFrame:
        """Sends queries to all parts of their buckets; where a bucket has many queries, its parts are copied for several tasks."""
        visiting = saved(visiting)
        crowd = {r["bucket"]: -(-r["count"] // task_queries) for r in visiting.groupBy("bucket").count().collect()}  # a row a bucket
        plan = spark.createDataFrame([(b, at.parts[b], n) for b, n in crowd.items()], "bucket int, parts int, turns int")
        of_cells = spark.createDataFrame([(int(c), int(at.bucket[c])) for c in at.full], "cell int, bucket int")
        salt = lambda n, seed: F.pmod(F.xxhash64("key", F.lit(seed)), F.col(n)).cast("int")
        to = visiting.join(F.broadcast(plan), "bucket").withColumn("turn", salt("turns", 3)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        of = stored.join(F.broadcast(of_cells), "cell").join(F.broadcast(plan), "bucket").withColumn("part", salt("parts", 5)).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
        place, held = ["bucket", "part", "turn"], ["key", "unit", "cell", "far"]
        both = of.select(*place, F.lit(0).alias("kind"), *held, F.col("cell").alias("home"), F.lit(0.0).alias("bound")).union(to.select(*place, F.lit(1), *held, "home", "bound"))
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return saved(both.repartition(n, *place).sortWithinPartitions(*place, "kind", "cell", "far").mapInArrow(_searched(at, k, floor), f"query {kind}, key {kind}, similarity double, cost long"))

    columns = f"key {kind}, unit array<double>, cell int, far double, home int"
    asked = saved(_placed(queries, pivots).mapInArrow(with_home, columns))
    bucket_of = F.element_at(F.array(*map(F.lit, at.bucket.tolist())), F.col("home") + 1).cast("int")
    own = round_of(asked.select(bucket_of.alias("bucket"), "*", F.lit(4.0).alias("bound")))
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "key")
    last = own.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") == k + 1).select(F.col("query").alias("key"), F.col("similarity").alias("kth"))
    least = F.greatest(F.coalesce("kth", F.lit(-1.0)), F.lit(float(max(floor, -1.0))))
    bounded = asked.join(last, "key", "left").withColumn("bound", F.sqrt(F.greatest(2 - 2 * least, F.lit(0.0))) + 2 * _SLACK).select("key", "unit", "cell", "far", "home", "bound")
    others = round_of(bounded.mapInArrow(onward, f"bucket int, {columns}, bound double"))
    found = own.union(others)
    return found.select("query", "key", "similarity"), found.select("cost")


def nearest_by_pivots(vectors: DataFrame, queries: DataFrame, k: int, floor: float = -1.0, skip_self: bool = True, part_rows: int = 16_384, task_queries: int = 16_384, costs: list | None = None) -> DataFrame:
    """query_id, id, similarity, rank: the ``k`` most alike by cosine, exactly, of ``vectors`` (id, embedding); ties go to smaller identifiers. Vectors that are null or hold a null or a number that isn't finite are left out; all others have one length.

    ``costs``: gets the number of cosines computed.
    """
    members = vectors.filter(finite("embedding")).select("id", F.xxhash64("embedding").alias("h"), "embedding")
    firsts = members.withColumn("turn", F.row_number().over(Window.partitionBy("h", "embedding").orderBy("id"))).filter(F.col("turn") <= k + 1)  # a limit a group, which Spark applies before its shuffle, too
    classes = saved(firsts.groupBy("h", "embedding").agg(F.min("id").alias("key"), F.array_sort(F.collect_list("id")).alias("ids")))  # k + 1 identifiers at most
    asking = queries.filter(finite("embedding")).select("id", "embedding")
    asked = saved(asking.groupBy("embedding").agg(F.min("id").alias("key")))
    found, cost = nearest_classes(classes.select("key", "embedding"), asked.select("key", "embedding"), k, floor, part_rows, task_queries)
    if costs is not None:
        costs.append(cost.agg(F.sum("cost")).first()[0] or 0)
    best = Window.partitionBy("query").orderBy(F.desc("similarity"), "key")
    few = found.withColumn("turn", F.row_number().over(best)).filter(F.col("turn") <= k + 1)  # each class brings an identifier at least, and one may be the query itself
    each = few.join(classes.select("key", "ids"), "key").groupBy("query").agg(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("similarity")).alias("s"), i.alias("id"))))).alias("near"))
    named = asking.join(asked, "embedding").select(F.col("id").alias("query_id"), F.col("key").alias("query")).join(each, "query")
    others = F.filter("near", lambda x: x["id"] != F.col("query_id")) if skip_self else F.col("near")
    top = named.select("query_id", F.posexplode(F.slice(F.array_sort(others), 1, k)).alias("rank", "x"))
    out = top.select("query_id", F.col("x.id").alias("id"), (-F.col("x.s")).alias("similarity"), (F.col("rank") + 1).alias("rank"))
    return out.filter(F.col("similarity") >= floor)
