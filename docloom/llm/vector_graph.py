"""Approximate nearest neighbours by hierarchical navigable small-world graphs, one for each shard of distinct vectors.

Equal vectors become one point with its smallest identifiers (one more than are asked for: enough for any result), so a vector that a third of all rows share is one point.
Points are dealt by length and a hash of the vector to shards of about ``shard_rows``. A shard's points get random levels and are inserted by level, so a layer is the first points, and those of the layer above
come first. Points are inserted in blocks: each searches the graph that is there, from where the layers above lead, and looks at the points of its own block before it. Its links are chosen from what
it met, by the rule that a link must be nearer than any link already chosen is to it; the points it links to link back, and choose anew where they have too many. A graph is stored as flat neighbour
arrays, padded with -1, in a table in the shared folder.

Each shard then streams over the blocks of queries of its length with a beam search in step for a whole block; what is found is ranked anew in double precision, and the shards' results are merged
by distance and identifier.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, take no part; a query among them gets no rows. Between vectors of different lengths there is no distance, so a query's candidates are those of its own length.
Rows that repeat an identifier and its vector count once. Ties go to smaller identifiers. With fewer candidates than asked for, all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._frames import column, partitions, small_batches, written

GRAPH = "width int, shard int, points int, vectors binary, members array<array<long>>, layers array<binary>"
LINKS = 16
_BLOCK = 512
_FIRST = 64


def _choose(points: np.ndarray, near: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
    """For each row of candidates ``near`` (ascending by distance ``far``; -1: none) the chosen ``most``, padded with -1."""
    rows, width = near.shape
    own = points[np.maximum(near, 0)]
    norms = np.einsum("ijk,ijk->ij", own, own)
    between = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(own, own.transpose(0, 2, 1))
    chosen = np.zeros((rows, width), bool)
    for j in range(width):
        blocked = (chosen & (between[:, j, :] < far[:, j, None])).any(axis=1)
        chosen[:, j] = (near[:, j] >= 0) & ~blocked & (chosen.sum(axis=1) < most)
    spare = (near >= 0) & ~chosen  # fills what the rule leaves empty
    rank = np.where(chosen, 0, np.where(spare, 1, 2)) * width + np.arange(width)
    order = np.argsort(rank, axis=1)[:, :most]
    out = np.take_along_axis(near, order, axis=1)
    return np.where(np.take_along_axis(chosen | spare, order, axis=1), out, -1)


def _sorted(ids: np.ndarray, far: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(far, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(far, order, axis=1)


def _link_back(points: np.ndarray, graph: np.ndarray, source: np.ndarray, target: np.ndarray) -> None:
    """Adds links from ``target`` to ``source``; a point with more than it has room for chooses among all."""
    most = graph.shape[1]
    gap = ((points[source] - points[target]) ** 2).sum(axis=1)
    order = np.lexsort((gap, target))
    source, target, gap = source[order], target[order], gap[order]
    own, first, place = np.unique(target, return_index=True, return_inverse=True)
    rank = np.arange(len(target)) - first[place]
    held = rank < most  # the nearest of a block's links to one point
    ids, far = np.full((len(own), 2 * most), -1), np.full((len(own), 2 * most), np.inf, np.float32)
    ids[:, :most] = graph[own]
    d = points[np.maximum(graph[own], 0)] - points[own][:, None, :]
    far[:, :most] = np.where(graph[own] >= 0, np.einsum("ijk,ijk->ij", d, d), np.inf)
    ids[place[held], most + rank[held]], far[place[held], most + rank[held]] = source[held], gap[held]
    ids, far = _sorted(ids, far, 2 * most)
    full = (ids >= 0).sum(axis=1) > most
    new = ids[:, :most]
    if full.any():
        new[full] = _choose(points, ids[full], far[full], most)
    graph[own] = new


def _layer(points: np.ndarray, above: list[np.ndarray], links: int, beam: int) -> np.ndarray:
    """Neighbour array of the layer of ``points``, whose layers ``above`` (from the lowest up) hold its first points."""
    n = len(points)
    graph = np.full((n, 2 * links), -1, np.int32)
    norms = (points * points).sum(axis=1)
    a = 0
    while a < n:
        b = min(n, a + (min(_BLOCK, a) or _FIRST))
        d = np.maximum(norms[a:b, None] + norms[None, a:b] - 2 * (points[a:b] @ points[a:b].T), 0)
        d[np.triu_indices(b - a)] = np.inf  # only what comes before
        near, far = _sorted(np.broadcast_to(np.arange(a, b), d.shape), d, beam)
        if a:
            start = _entries(points, above, points[a:b])
            met, gaps = _beam(points[:a], graph[:a], points[a:b], np.where(start < a, start, 0)[:, :1], beam)
            near, far = _sorted(np.concatenate([met, near], axis=1), np.concatenate([gaps, far], axis=1), beam)
        near = np.where(np.isfinite(far), near, -1)
        picked = _choose(points, near, far, links)
        graph[a:b, : picked.shape[1]] = picked
        source, place = np.nonzero(picked >= 0)
        if len(source):
            _link_back(points, graph, source + a, picked[source, place])
        a = b
    return graph


def build(points: np.ndarray, links: int = LINKS, beam: int = 64, seed: int = 7) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of insertion, and the neighbour arrays of the layers from the lowest up, by place in that order."""
    n = len(points)
    levels = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(links)).astype(int)
    order = np.argsort(-levels, kind="stable")
    points = np.ascontiguousarray(points[order].astype(np.float32))
    layers: list[np.ndarray] = []
    for level in range(int(levels.max(initial=0)), -1, -1):
        layers.insert(0, _layer(points[: int((levels >= level).sum())], layers, links, beam))
    return order, layers


def _beam(points: np.ndarray, graph: np.ndarray, queries: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search in step for a block of queries: points and squared distances, ascending, padded with -1 and infinity."""
    q = len(queries)
    seen = np.zeros((q, len(points) + 1), bool)  # the last column takes the padding
    ids = np.full((q, beam), -1)
    dist = np.full((q, beam), np.inf, np.float32)
    done = np.ones((q, beam), bool)

    def gaps(found: np.ndarray) -> np.ndarray:
        d = points[np.maximum(found, 0)] - queries[:, None, :]
        return np.where(found >= 0, np.einsum("ijk,ijk->ij", d, d), np.inf)

    k = min(start.shape[1], beam)
    ids[:, :k] = start[:, :k]
    dist[:, :k] = gaps(start[:, :k])
    done[:, :k] = start[:, :k] < 0
    np.put_along_axis(seen, start[:, :k], True, axis=1)
    while True:
        open_ = np.where(done, np.inf, dist)
        best = open_.argmin(axis=1)
        live = np.isfinite(open_[np.arange(q), best])
        if not live.any():
            break
        node = np.where(live, ids[np.arange(q), best], -1)
        done[np.arange(q), best] = True
        found = np.where((node >= 0)[:, None], graph[node], -1)
        new = (found >= 0) & ~np.take_along_axis(seen, found, axis=1)
        found = np.where(new, found, -1)
        np.put_along_axis(seen, found, True, axis=1)
        seen[:, -1] = False
        both = np.concatenate([ids, found], axis=1)
        far = np.concatenate([dist, gaps(found)], axis=1)
        flags = np.concatenate([done, found < 0], axis=1)
        keep = np.argsort(far, axis=1, kind="stable")[:, :beam]
        ids, dist, done = (np.take_along_axis(x, keep, axis=1) for x in (both, far, flags))
    return ids, dist


def _entries(points: np.ndarray, above: list[np.ndarray], queries: np.ndarray) -> np.ndarray:
    """Where to begin a layer: what the layers above it lead to, padded with -1."""
    start = np.zeros((len(queries), 1), np.int64)
    for graph in reversed(above):
        start = _beam(points[: len(graph)], graph, queries, start, 8)[0][:, :4]
    return start


def search(points: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, beam: int) -> np.ndarray:
    """The ``beam`` points nearest to each query that the graph leads to, padded with -1."""
    return _beam(points, layers[0], queries, _entries(points, layers[1:], queries), beam)[0]


def _valid(vector: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0)


def vectors_of(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vector array<double>, width of the rows that take part."""
    rows = df.select(column(df, id_col).cast("long").alias("vec_id"), column(df, vector_col).cast("array<double>").alias("vector"))
    return rows.filter(F.col("vec_id").isNotNull() & _valid(F.col("vector"))).withColumn("width", F.size("vector"))


def build_graphs(rows: DataFrame, k: int = 10, shard_rows: int = 16384, links: int = LINKS, beam: int = 64) -> DataFrame:
    """The graph table of ``rows`` (vec_id, vector, width): one row a shard."""
    small_batches(rows.sparkSession)
    smallest = Window.partitionBy("vector").orderBy("vec_id")
    ranked = rows.distinct().withColumn("rank", F.row_number().over(smallest)).filter(F.col("rank") <= k + 1)  # limited before the shuffle, too
    points = written(ranked.groupBy("vector", "width").agg(F.sort_array(F.collect_list("vec_id")).alias("members")), "points")
    shards = written(points.groupBy(F.col("width").alias("of_width")).agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards")), "widths")  # a row a length

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("first", "ascending")]).combine_chunks()
        lists = table.column("vector").chunk(0)
        vectors = lists.flatten().to_numpy().reshape(len(lists), -1)
        order, layers = build(vectors, links, beam, seed=len(lists))
        members = table.column("members").chunk(0).take(pa.array(order))
        held = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), members)
        row = [*(pa.array([table.column(n)[0].as_py()], pa.int32()) for n in ("width", "shard")), pa.array([len(order)], pa.int32()), pa.array([vectors[order].tobytes()], pa.binary()), held]
        return pa.Table.from_arrays([*row, pa.array([[x.tobytes() for x in layers]], pa.list_(pa.binary()))], ["width", "shard", "points", "vectors", "members", "layers"])

    dealt = points.join(shards, F.col("width") == F.col("of_width")).withColumn("shard", F.pmod(F.xxhash64("vector"), F.col("shards")).cast("int"))
    dealt = dealt.select("width", "shard", "vector", "members", F.col("members")[0].alias("first"))
    return written(dealt.groupBy("width", "shard").applyInArrow(run, GRAPH), "graphs")


def search_graphs(graphs: DataFrame, queries: DataFrame, k: int = 10, beam: int = 256, links: int = LINKS, block_rows: int = 512) -> DataFrame:
    """The ``k`` nearest found of each of ``queries`` (vec_id, vector, width), without the query's own identifier: query_id, rank, vec_id, score."""
    spark = graphs.sparkSession
    small_batches(spark)
    names = ["width", "shard", "block", "points", "vectors", "members", "layers", "asked", "sought"]
    numbered = queries.distinct().withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-queries.count() // block_rows)))).cast("int"))
    blocks = numbered.groupBy("width", "block").agg(F.collect_list(F.struct("vec_id", "vector")).alias("rows"))  # about block_rows rows each
    sent = blocks.join(graphs.select("width", "shard"), "width").select("width", "shard", "block", F.col("rows.vec_id").alias("asked"), F.flatten("rows.vector").alias("sought"))
    both = graphs.withColumn("block", F.lit(-1)).unionByName(sent, allowMissingColumns=True).select(*names)
    dealt = both.repartition(partitions(spark), "width", "shard").sortWithinPartitions("width", "shard", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = exact = flat = starts = np.zeros(0)
        layers: list[np.ndarray] = []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(j).slice(i, 1) for j, n in enumerate(names)}
                if row["block"][0].as_py() < 0:  # a shard's graph comes before its blocks
                    exact = np.frombuffer(row["vectors"][0].as_py()).reshape(row["points"][0].as_py(), -1)
                    points = exact.astype(np.float32)
                    layers = [np.frombuffer(x, np.int32).reshape(-1, 2 * links) for x in row["layers"][0].as_py()]
                    members = row["members"].flatten()
                    flat, starts = members.flatten().to_numpy(), np.concatenate([[0], np.cumsum(members.value_lengths().to_numpy())])
                    continue
                asked = row["asked"].flatten().to_numpy()
                sought = row["sought"].flatten().to_numpy().reshape(len(asked), -1)
                found = search(points, layers, sought.astype(np.float32), beam)
                out: list[tuple[np.ndarray, ...]] = []
                for own, vector, near in zip(asked, sought, found, strict=True):
                    near = near[near >= 0]
                    gap = np.sqrt(np.cumsum((exact[near] - vector) ** 2, axis=1)[:, -1])  # added component by component
                    sizes = starts[near + 1] - starts[near]
                    ids = flat[np.repeat(starts[near] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
                    gap = np.repeat(gap, sizes)
                    other = ids != own
                    ids, gap = ids[other], gap[other]
                    best = np.lexsort((ids, gap))[:k]
                    out.append((np.full(len(best), own), ids[best], gap[best]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    hits = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    merged = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return hits.distinct().withColumn("rank", F.row_number().over(merged)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def nearest(df: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 16384, beam: int = 256) -> DataFrame:
    """The ``k`` nearest of every row whose identifier is divisible by ``every``, among all rows."""
    rows = vectors_of(df, id_col, vector_col)
    graphs = build_graphs(rows, k, shard_rows)
    return search_graphs(graphs, rows.filter(F.col("vec_id") % every == 0), k, beam)
