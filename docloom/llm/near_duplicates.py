"""Near duplicates by chosen-path set similarity join over minwise tokens.

A document's set is its distinct ``size``-word shingles (ASCII letters lower-cased). Documents of equal sets are one class, whatever their number. Classes carry ``tokens`` minwise
tokens. ``trees`` independent trees branch all classes: at the root by one selected minwise token, and a node of more than ``leaf`` classes again, by one or two tokens selected for that node among
those that its path has not used (two on the first ``wide`` levels, then one or two in turn), for as long as there are such nodes. A pair of similarity s meets at a root's child in a tree with probability s, so all 10 trees miss
a pair of 0.8 with probability 1e-7. Small nodes are compared exhaustively on the tokens: ``least`` of them must agree, which a pair of 0.8 fails with probability below 1e-5. All members of a node whose path
has used ``least`` tokens agree in these, so it is linked without a comparison.

In a large node all are first compared with one member, its hub; those that agree in ``near`` tokens are candidates, tied to it by a link. All tied members of a node are in one candidate cluster, so they
need not meet each other again, only the rest: a node without a rest is done, and one with a rest of at most ``leaf`` is dealt to small nodes, each with a share of the tied members and the whole rest.
Only a node with a larger rest branches, with all its members; in its children the hub is one of those tied before. So a large group of near copies isn't branched again and again, and no pair is parted by it.
What is linked so makes candidate clusters, whose full sets are then compared exhaustively: links are decided by the sets alone.

A cluster of more than ``cluster`` classes is dealt to chunks that all hold its least member; what is left outside its largest component is compared
with all chunks in blocks. So no group is one task's, no pairs are listed (each group gives at most one link a member), and no partner is capped.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing; fewer than ``size`` words are one shingle. Rows that repeat a key
are rows of their own; all rows of a class and all linked classes share the smallest key. A null key stays and is smaller than none. Extra columns are passed over by the report and kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._frames import column, keyed_text, partitions, written
from ._graph import components, connect, edges_of, runs
from ._words import LOWER, chained, hashes, mix, slices, within, words

_ODD = np.random.default_rng(20231114).integers(1, 2**63, 128, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = words(texts)
    h = hashes(LOWER[w.data], w.starts, w.ends)
    first = within(w, size)
    whole = chained(h, size)[first]
    at = np.searchsorted(first, w.firsts)
    out = []
    for i, n in enumerate(w.counts):
        if 0 < n < size:
            k = w.firsts[i]
            out.append(mix(chained(h[k : k + n], int(n)) ^ np.uint64(n * 0x9E3779B9)))
        else:
            out.append(np.unique(whole[at[i] : at[i + 1]]))
    return out


def _signed(texts: pa.Array, size: int, tokens: int) -> tuple[list[int], list[bytes | None], np.ndarray]:
    counts, keys, marks = [], [], []
    for at, to in slices(texts):
        sets = shingle_sets(texts.slice(at, to - at), size)
        sizes = np.array([len(s) for s in sets])
        counts += sizes.tolist()
        keys += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        out = np.zeros((len(sets), tokens), np.int32)
        filled = np.flatnonzero(sizes)
        if len(filled):
            flat = np.concatenate(sets)
            starts = (np.cumsum(sizes) - sizes)[filled]
            for t in range(tokens):
                out[filled, t] = (np.minimum.reduceat(flat * _ODD[t], starts) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        marks.append(out)
    return counts, keys, np.concatenate(marks) if marks else np.zeros((0, tokens), np.int32)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, width) if len(column) else np.zeros((0, width), np.int32)


def document_classes(docs: DataFrame, size: int = 4, tokens: int = 32) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_class (null: empty set), marks (minwise tokens) of each row of ``docs`` (doc_id, text, text_hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, keys, marks = _signed(b.column(1), size, tokens)
            held = pa.FixedSizeListArray.from_arrays(pa.array(marks.ravel()), tokens).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), held], ["doc_id", "text_hash", "n_shingles", "set_class", "marks"])

    return docs.select("doc_id", "text", "text_hash").mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_class binary, marks array<int>")


def _class_name(least_id: Column, set_class: Column) -> Column:
    """A class's name in order of its least key (null: last), so the least name of a component holds the least key of it; then the hash of the set."""
    flipped = F.lpad(F.hex(least_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.unhex(F.when(least_id.isNull(), "01").otherwise("00")), F.unhex(F.coalesce(flipped, F.lit("0" * 16))), set_class)


def _least_id(c: Column) -> Column:
    value = F.conv(F.hex(F.substring(c, 2, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    return F.when(F.hex(F.substring(c, 1, 1)) == "00", value)


def _leaves(classes: DataFrame, trees: int, leaf: int, wide: int, tokens: int, near: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Members of small nodes (node, c), and candidate links (a, b) of large nodes with their hubs. ``used``: the tokens that a node's path has selected, as bits; ``tied``: linked, on that path, with all others that are tied."""
    at = classes.select("c", F.posexplode(F.slice("marks", 1, trees)).alias("tree", "token")).select("c", F.xxhash64("tree", "token").alias("node"), F.expr("shiftleft(1L, tree)").alias("used"), F.lit(False).alias("tied"))
    small: list[DataFrame] = []
    links: list[DataFrame] = [classes.select(F.col("c").alias("a"), F.col("c").alias("b")).limit(0)]
    free = F.expr(f"filter(sequence(0, {tokens - 1}), p -> (used & shiftleft(1L, p)) = 0)")
    for level in range(least + 1):  # each level uses one more token
        # Written, so that the join has nothing but shuffles below it, and Spark can split a node of many members.
        hub = F.min_by("c", F.struct(~F.col("tied"), F.xxhash64("c", "node"))) if level else F.min("c")  # a new one in a child
        sizes = written(at.groupBy("node").agg(F.count("*").alias("count"), hub.alias("hub"), F.bool_and("tied").alias("done")).filter("count > 1 and not done").drop("done"), "node-sizes")
        placed = written(at.join(sizes, "node"), "nodes")
        small.append(placed.filter(F.col("count") <= leaf).select("node", "c"))
        alike = F.bit_count("used") >= least
        links.append(placed.filter((F.col("count") > leaf) & alike).select(F.col("hub").alias("a"), F.col("c").alias("b")))
        large = placed.filter((F.col("count") > leaf) & ~alike)
        if large.isEmpty():
            break
        hubs = written(large.filter(F.col("c") == F.col("hub")).select("node", "c").join(classes.select("c", F.col("marks").alias("hub_marks")), "c").select("node", "hub_marks"), "hubs")
        met = large.join(classes.select("c", "marks"), "c").join(hubs, "node")
        near_hub = F.size(F.filter(F.zip_with("marks", "hub_marks", lambda x, y: x == y), lambda x: x)) >= near
        met = written(met.select("node", "c", "hub", "used", "count", near_hub.alias("near_hub"), (F.col("tied") | near_hub).alias("tied"), "marks"), "nodes")
        links.append(met.filter(F.col("near_hub") & (F.col("c") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("c").alias("b")))
        rests = written(met.filter(~F.col("tied")).groupBy("node").agg(F.count("*").alias("rest")), "rests")
        open_ = met.join(rests, "node")
        shares = F.ceil((F.col("count") - F.col("rest")) / leaf).cast("int")
        own = F.when(F.col("tied"), F.array(F.pmod(F.xxhash64("c"), shares).cast("int"))).otherwise(F.sequence(F.lit(0), shares - 1))
        dealt = open_.filter(F.col("rest") <= leaf).withColumn("share", F.explode(own)).select(F.xxhash64("node", F.lit("share"), "share").alias("node"), "c")
        small.append(written(dealt, "shares"))
        turn = lambda j: F.xxhash64("node", F.lit(j))
        first = F.pmod(turn(0), F.size("free"))
        other = F.pmod(first + 1 + F.pmod(turn(1), F.size("free") - 1), F.size("free"))
        two = F.lit(level < wide) | (F.pmod(turn(2), F.lit(2)) == 0)
        picks = F.when(two, F.array(first, other)).otherwise(F.array(first))
        picked = open_.filter(F.col("rest") > leaf).withColumn("free", free).withColumn("p", F.explode(F.transform(picks, lambda i: F.get("free", i.cast("int")))))
        at = written(picked.select("c", F.xxhash64("node", "p", F.element_at("marks", F.col("p") + 1)).alias("node"), F.expr("used | shiftleft(1L, p)").alias("used"), "tied"), "branches")
        if at.isEmpty():
            break
    return _union(small), _union(links)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def _candidates(classes: DataFrame, small: DataFrame, tokens: int, least: int) -> DataFrame:
    """Links (a, b) between classes whose tokens agree often enough: at most one a member of a node, with the least that it is linked with there."""
    marks = small.groupBy("node").agg(F.bit_xor(F.xxhash64("c")).alias("x"), F.count("*").alias("n"))
    once = marks.groupBy("x", "n").agg(F.min("node").alias("node")).select("node")  # nodes of the same members are compared once
    rows = small.join(once, "node").join(classes.select("c", "marks"), "c").select("node", "c", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 1):
            marks, names = _matrix(table.column("marks"), tokens), table.column("c").combine_chunks()
            edges = edges_of(table.column("node"))
            starts, sizes = edges[:-1], np.diff(edges)
            two = starts[sizes == 2]
            hit = two[(marks[two] == marks[two + 1]).sum(axis=1) >= least]
            a, b = [hit], [hit + 1]
            for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
                own = marks[s : s + n]
                label = connect(int(n), lambda i, own=own: np.flatnonzero((own == own[i]).sum(axis=1) >= least))
                moved = np.flatnonzero(label != np.arange(n))
                a.append(s + label[moved])
                b.append(s + moved)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(np.concatenate(a))), names.take(pa.array(np.concatenate(b)))], ["a", "b"])

    dealt = rows.repartition(partitions(small.sparkSession), "node").sortWithinPartitions("node", "c")
    return dealt.mapInArrow(run, "a binary, b binary")


class _Sets:
    """Full sets of one group, with an inverted index over them."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        _, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(self.ids, kind="stable")
        self.owner = owner[order]
        self.posts = np.concatenate([[0], np.cumsum(np.bincount(self.ids))])

    def linked(self, i: int, percent: int) -> np.ndarray:
        own = self.ids[self.starts[i] : self.starts[i + 1]]
        first, last = self.posts[own], self.posts[own + 1]
        n = last - first
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(self.owner[at], minlength=len(self.sizes))
        return np.flatnonzero((100 * shared >= percent * (self.sizes[i] + self.sizes - shared)) & (shared > 0))


def _compared(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of rows (cluster, chunk, c, wanted, members): within each (cluster, chunk), those of the wanted, or of all where none is, as one of each b with the least of its component there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 2):
            names = table.column("c").combine_chunks()
            wanted = table.column("wanted").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in table.column("members").to_pylist()]
            edges = edges_of(table.column("cluster"), table.column("chunk"))
            a, b = [], []
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                group, asked = _Sets(sets[s:e]), wanted[s:e]
                label = connect(int(e - s), lambda i, group=group: group.linked(i, percent), asked if asked.any() else None)
                moved = np.flatnonzero(label != np.arange(e - s))
                a.append(s + label[moved])
                b.append(s + moved)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(np.concatenate(a))), names.take(pa.array(np.concatenate(b)))], ["a", "b"])

    dealt = rows.select("cluster", "chunk", "c", "wanted", "members").repartition(partitions(rows.sparkSession), "cluster", "chunk").sortWithinPartitions("cluster", "chunk", "c")
    return dealt.mapInArrow(run, "a binary, b binary")


def _verified(docs: DataFrame, clusters: DataFrame, size: int, percent: int, cluster: int) -> DataFrame:
    """The components (node, root) of the links that the full sets confirm, within ``clusters`` (node, root). A node that is not given is its own root."""
    counts = clusters.groupBy("root").agg(F.count("*").alias("n"))
    chunks = F.ceil(F.col("n") / cluster).cast("int")
    wanted = clusters.join(counts, "root").select(F.col("node").alias("c"), F.col("root").alias("cluster"), chunks.alias("chunks"), _least_id(F.col("node")).alias("least_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.schema.get_field_index("text")
            for at, to in slices(b.column(text)):
                part = b.slice(at, to - at)
                sets = shingle_sets(part.column(text), size)
                same = [len(s) > 0 and hashlib.blake2b(s.tobytes(), digest_size=16).digest() == c[9:] for s, c in zip(sets, part.column(0).to_pylist(), strict=True)]
                held = pa.array([s.tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], held], ["c", "cluster", "chunks", "members"]).filter(pa.array(same, pa.bool_()))

    # By a shuffle at any size: few wanted rows would be broadcast, many not.
    texts = wanted.hint("merge").join(docs, docs["doc_id"].eqNullSafe(wanted["least_id"])).select("c", "cluster", "chunks", "text")
    sets = written(texts.mapInArrow(run, "c binary, cluster binary, chunks int, members binary").dropDuplicates(["c"]), "sets")
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    own = F.when(F.col("c") == F.col("cluster"), every).otherwise(F.array(F.pmod(F.xxhash64("c"), F.col("chunks")).cast("int")))
    rows = sets.withColumns({"chunk": F.explode(own), "wanted": F.lit(False)})
    # Chunks have only the cluster's least member in common, and each b has the least of its component there: a is b's component over all chunks.
    links = written(_compared(rows, percent), "confirmed")
    label = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    split = sets.filter("chunks > 1")
    if split.isEmpty():
        return label
    # Clusters in chunks: what lies outside the largest component is compared with every chunk, in blocks; these links are between components.
    known = split.join(links, split["c"] == links["b"], "left").withColumn("root", F.coalesce("a", "c")).select("c", "cluster", "chunks", "members", "root")
    known = written(known, "chunked")
    of = known.groupBy("cluster", "root").count()
    largest = of.groupBy("cluster").agg(F.max_by("root", F.struct("count", "root")).alias("largest"))
    rest = known.join(largest, "cluster").filter(F.col("root") != F.col("largest")).drop("largest")
    blocks = rest.groupBy("cluster").agg(F.ceil(F.count("*") / cluster).cast("int").alias("blocks"))
    rest = rest.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("c", F.lit(1)), F.col("blocks")).cast("int"))
    asked = rest.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("wanted", F.lit(True))
    met = known.join(blocks, "cluster").withColumn("piece", F.pmod(F.xxhash64("c"), F.col("chunks")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("wanted", F.lit(False))
    named = ["cluster", (F.col("block") * F.col("chunks") + F.col("piece")).cast("int").alias("chunk"), F.col("root").alias("c"), "wanted", "members"]
    joined = components(_compared(asked.select(*named).union(met.select(*named)), percent)).select(F.col("node").alias("own"), F.col("root").alias("joined"))
    return label.join(joined, label["root"] == joined["own"], "left").select("node", F.coalesce("joined", "root").alias("root")).union(joined)


def _resolved(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str, trees: int = 10, tokens: int = 32, least: int = 15, leaf: int = 512, wide: int = 3, cluster: int = 1024) -> DataFrame:
    """doc_id, text_hash, n_shingles, root (the component, null for an empty set) and component_id of every row."""
    own = keyed_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    rows = written(document_classes(own, size, tokens), "classes")
    sets = rows.filter("n_shingles > 0").groupBy("set_class").agg(F.min("doc_id").alias("least_id"), F.first("marks").alias("marks"))
    classes = written(sets.select(_class_name(F.col("least_id"), F.col("set_class")).alias("c"), "set_class", "marks"), "sets")
    small, links = _leaves(classes, trees, leaf, wide, tokens, near=least - 3, least=least)
    clusters = components(_candidates(classes, small, tokens, least).union(links))
    linked = _verified(own, clusters, size, percent, cluster)
    root = F.coalesce("root", "c")
    by_class = classes.select("c", "set_class").join(linked, F.col("c") == F.col("node"), "left").select("set_class", root.alias("root"), _least_id(root).alias("component_id"))
    by_class = written(by_class, "resolved")
    out = rows.join(by_class, "set_class").select("doc_id", "text_hash", "n_shingles", "root", "component_id")
    bare = rows.filter(F.col("set_class").isNull())  # not joined: they would all have one key
    return out.union(bare.select("doc_id", "text_hash", "n_shingles", F.lit(None).cast("binary"), "doc_id"))


def near_duplicate_classes(docs: DataFrame, size: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **tuning: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row: rows are linked where 100 * intersection >= percent * union of their sets. ``tuning``: the parameters of ``_resolved``."""
    out = _resolved(docs, size, percent, id_col, text_col, **tuning)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all columns: that of the least key, and of several with it that of least text hash. A null key comes after all others. Rows with an empty set all stay."""
    rows = written(_resolved(docs, size, percent, id_col, text_col).select("doc_id", "text_hash", "root"), "linked-rows")
    first = rows.filter("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"))
    kept = first.select("first.doc_id", "first.text_hash", F.lit(False).alias("bare")).union(rows.filter("root is null").select("doc_id", "text_hash", F.lit(True)).distinct())
    kept = written(kept.select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"), "bare"), "kept")
    own = docs.select(F.struct("*").alias("row"), column(docs, id_col).cast("long").alias("key"), F.xxhash64(F.coalesce(column(docs, text_col), F.lit(""))).alias("hash"))  # whatever the columns' names
    found = own.join(kept, F.col("key").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("kept_hash")))
    turn = F.row_number().over(Window.partitionBy("key", "hash").orderBy("hash"))  # equal rows; limited before the shuffle
    once = found.filter("not bare").withColumn("turn", turn).filter("turn = 1").select("row.*")
    return once.union(found.filter("bare").select("row.*"))
