"""Similarity joins on fingerprints, entities and vectors; deduplication in the order of arrival."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.similarity import DUPLICATE_DISTANCE, simhash_bits
from .graphs import components
from .ranking import nearest_vectors
from .storage import saved, shared_path, shared_root  # noqa: F401  also read from here

_WHOLE = (1 << 64) - 1
ECHO_WINDOW_MS = 72 * 3_600_000
ECHO_TYPES = ("model", "company", "product", "paper", "benchmark")


def _masks(most: int, blocks: int = 6) -> list[int]:
    """Signed 64-bit masks of all choices of blocks - most blocks: fingerprints at most ``most`` bits apart agree under one."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    whole = [sum(c) for c in combinations(block, blocks - most)]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def band_pairs(fingerprints: DataFrame, most: int = DUPLICATE_DISTANCE) -> DataFrame:
    """a, b (a < b), distance of all pairs at most three bits apart, of (id, simhash).

    Equal fingerprints are one class, led by the smallest identifier, and linked to it alone, so a text that a third of all rows share makes no square. Fingerprints at most three bits apart agree in
    three of six blocks of bits, so classes meet in an equi-join on every choice of three blocks, of 32 bits or so; each pair is made once, at its first choice. An empty text's fingerprint of zeros never takes part.
    The joins name a shuffle: Spark takes the twenty rows of a class for one when it looks for tables to send through the driver.
    """
    rows = fingerprints.filter((F.length("simhash") == 16) & (F.col("simhash") != "0" * 16)).select("id", "simhash")
    classes = rows.groupBy("simhash").agg(F.min("id").alias("first"))
    copies = rows.join(classes.hint("shuffle_merge"), "simhash").filter(F.col("id") != F.col("first")).select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(0).alias("distance"))
    masks = _masks(most)
    coded = classes.select(F.col("first").alias("id"), simhash_bits(F.col("simhash")).alias("bits"))
    keyed = coded.withColumn("k", F.explode(F.array(*(F.struct(F.lit(i).alias("choice"), F.col("bits").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)))))
    left, right = (keyed.select(F.col("id").alias(n), F.col("bits").alias(f"{n}_bits"), "k.choice", "k.key") for n in ("a", "b"))
    apart = F.col("a_bits").bitwiseXOR(F.col("b_bits"))
    first = F.coalesce(*(F.when(apart.bitwiseAND(F.lit(m)) == 0, i) for i, m in enumerate(masks)))
    met = left.join(right.hint("shuffle_merge"), ["choice", "key"]).filter((F.col("a") < F.col("b")) & (F.bit_count(apart) <= most) & (first == F.col("choice")))
    return met.select("a", "b", F.bit_count(apart).cast("int").alias("distance")).union(copies)


class KnownFingerprints:
    """A stored corpus of fingerprints that batches are held against without shuffling it.

    Each distinct fingerprint is stored once for every choice of three of its six blocks of bits, in a table bucketed and sorted by (choice, key) in the shared folder, registered in the catalogue as ``name``. A join on
    these columns takes the buckets as they lie: only the batch is shuffled. A batch that is added brings its own files to the buckets; a class keeps its two smallest identifiers, so that a row can be told from itself.
    """

    def __init__(self, spark: SparkSession, name: str, most: int = DUPLICATE_DISTANCE, buckets: int = 64) -> None:
        self.spark, self.name, self.most, self.buckets = spark, name, most, buckets
        self.masks = _masks(most)

    @staticmethod
    def _valid(fingerprints: DataFrame) -> DataFrame:
        return fingerprints.filter((F.length("simhash") == 16) & (F.col("simhash") != "0" * 16)).select("id", simhash_bits(F.col("simhash")).alias("bits"))

    def add(self, fingerprints: DataFrame) -> None:
        """Stores (id, simhash); empty texts' fingerprints of zeros and malformed ones never match and are left out."""
        turn = Window.partitionBy("bits").orderBy("id")
        classes = self._valid(fingerprints).withColumn("turn", F.row_number().over(turn)).filter("turn <= 2").groupBy("bits").agg(F.min("id").alias("first"), F.max("id").alias("second"))
        path = {} if self.spark.catalog.tableExists(self.name) else {"path": shared_path(self.spark, "known")}
        rows = _keyed(classes, self.masks).repartition(self.buckets, "choice", "key")
        rows.write.bucketBy(self.buckets, "choice", "key").sortBy("choice", "key").options(**path).mode("append").saveAsTable(self.name)

    def candidates(self, queries: DataFrame) -> DataFrame:
        """bits, distance, match: stored identifiers in reach of the distinct fingerprints of ``queries``, two of a class at most. A pair that agrees under several choices is taken at its first."""
        asked = _keyed(self._valid(queries).select("bits").distinct(), self.masks)
        known = self.spark.table(self.name).select("choice", "key", F.col("bits").alias("k_bits"), "first", "second")
        apart = F.col("bits").bitwiseXOR(F.col("k_bits"))
        first = F.coalesce(*(F.when(apart.bitwiseAND(F.lit(m)) == 0, i) for i, m in enumerate(self.masks)))
        met = asked.hint("shuffle_merge").join(known, ["choice", "key"]).filter((F.bit_count(apart) <= self.most) & (first == F.col("choice")))
        return met.select("bits", F.bit_count(apart).cast("int").alias("distance"), F.explode(F.array_distinct(F.array("first", "second"))).alias("match"))

    def nearest(self, queries: DataFrame) -> DataFrame:
        """id, match, distance: the nearest stored fingerprint of each of ``queries`` (id, simhash) but its own row's; ties go to the smaller identifier. Queries without one are left out."""
        order = Window.partitionBy("bits").orderBy("distance", "match")
        two = self.candidates(queries).distinct().withColumn("turn", F.row_number().over(order)).filter("turn <= 3")  # the row itself may be stored twice, once a batch
        pairs = self._valid(queries).join(two, "bits").filter(F.col("id") != F.col("match"))
        return pairs.groupBy("id").agg(F.min(F.struct("distance", "match")).alias("x")).select("id", "x.match", "x.distance")


def window_pairs(left: DataFrame, right: DataFrame, key: str, time: str, span_ms: int = ECHO_WINDOW_MS) -> DataFrame:
    """Pairs (a, b) of rows (id, key, time) of equal key at most ``span_ms`` apart.

    Time is cut into buckets of the span; a left row looks into its own and both neighbours, so the join has keys that spread a frequent entity over time, and the exact bound is a residual.
    """
    a = left.select(F.col("id").alias("a"), F.col(key).alias("k"), F.col(time).alias("a_time")).withColumn("bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("a_time") / span_ms) + d)))
    b = right.select(F.col("id").alias("b"), F.col(key).alias("k"), F.col(time).alias("b_time")).withColumn("bucket", F.floor(F.col("b_time") / span_ms))
    return a.join(b, ["k", "bucket"]).filter((F.col("a") != F.col("b")) & (F.abs(F.col("a_time") - F.col("b_time")) <= span_ms)).select("a", "b").distinct()


def echo_candidates(items: DataFrame, types: tuple[str, ...] = ECHO_TYPES, span_ms: int = ECHO_WINDOW_MS) -> DataFrame:
    """Pairs of items within 72 hours that share an entity of a telling type."""
    telling = F.filter(F.coalesce(F.col("entities"), F.array()), lambda e: e["type"].isin(*types))
    rows = items.select("id", F.coalesce("published_ms", "captured_ms").alias("at"), F.explode(F.array_distinct(F.transform(telling, lambda e: e["name"]))).alias("entity"))
    return window_pairs(rows, rows, "entity", "at", span_ms)


def max_similarity(vectors: DataFrame) -> DataFrame:
    """id, max_similarity: each vector's greatest cosine with another."""
    return nearest_vectors(vectors, vectors, 1).select(F.col("query_id").alias("id"), F.col("similarity").alias("max_similarity"))


def centroids(vectors: DataFrame, key: str) -> DataFrame:
    """Per ``key`` the mean of ``embedding``, brought to length 1."""
    parts = vectors.select(key, F.posexplode("embedding").alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return rows.select(key, F.transform("v", lambda e: F.when(F.col("norm") > 0, e["x"] / F.col("norm")).otherwise(e["x"])).alias("centroid"))


def _keyed(classes: DataFrame, masks: list[int]) -> DataFrame:
    """choice, key of every choice of blocks, before the columns of ``classes`` (bits, ...): classes in reach of one another meet under one of them."""
    choices = F.array(*(F.struct(F.lit(i).alias("choice"), F.col("bits").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)))
    return classes.withColumn("k", F.explode(choices)).select("k.choice", "k.key", *classes.columns)


def _in_order(masks: list[int], most: int):
    """Settles components, each with its items in their order of arrival: of rows (root, kind, x, y, bits, seq), sorted by root and kind, matches (0: x before y) and items (1: x, of class bits), the canonical items."""

    def settle(earlier: dict, items: list) -> list[str]:
        canonical, held, reach = set(), set(), defaultdict(list)
        for _, item, bits in sorted(items):
            beaten = bits is not None and (bits in held or any((bits ^ other).bit_count() <= most for i, m in enumerate(masks) for other in reach.get((i, bits & m), ())))
            if beaten or any(e in canonical for e in earlier.get(item, ())):
                continue
            canonical.add(item)
            if bits is not None and bits not in held:
                held.add(bits)
                for i, m in enumerate(masks):
                    reach[i, bits & m].append(bits)
        return [x for _, x, _ in items if x in canonical]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, earlier, items = None, defaultdict(list), []
        for b in batches:
            done: list[str] = []
            for root, kind, x, y, bits, seq, key in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if root != at:
                    done += settle(earlier, items)
                    at, earlier, items = root, defaultdict(list), []
                if kind == 0:
                    earlier[y].append(x)
                else:
                    items.append(((seq, key), x, None if bits is None else bits & _WHOLE))
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["x"])
        yield pa.RecordBatch.from_arrays([pa.array(settle(earlier, items), pa.string())], ["x"])

    return run


def _canonical(items: DataFrame, older: DataFrame, most: int, most_rows: int) -> DataFrame:
    """The canonical of ``items`` (id, seq, bits or null): id. ``older``: a before b.

    Of a class only items that have matches of their own, and the first of the others, can be canonical: what beats that one beats the others, too. Components are made over matches and over classes that share a block key with
    the least class of the key, so a crowd of near classes makes no pairs; they may hold more than what really matches, never less. The first ``most_rows`` open items of each component are settled in their order by
    one task; what these beat, found by joins, is settled with them, and what is left goes on in the same way.
    """
    spark, masks = items.sparkSession, _masks(most)
    linked = older.select(F.col("a").alias("id")).union(older.select("b")).distinct().withColumn("linked", F.lit(True))
    marked = items.join(linked.hint("shuffle_merge"), "id", "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    firsts = marked.filter("bits is not null and not linked").groupBy("bits").agg(F.min(F.struct("seq", "id")).alias("at"))
    some = saved(marked.filter("linked").select("id", "seq", "bits", "linked").union(firsts.select("at.id", "at.seq", "bits", F.lit(False))))
    keyed = saved(_keyed(some.filter("bits is not null").select("bits").distinct(), masks))
    hubs = keyed.groupBy("choice", "key").agg(F.min("bits").alias("hub"), F.max("bits").alias("other"), F.count("*").alias("n")).filter("n > 1")
    alike = (F.col("n") > 2) | (F.bit_count(F.col("hub").bitwiseXOR(F.col("other"))) <= most)
    near = saved(keyed.join(hubs.filter(alike).select("choice", "key", "hub").hint("shuffle_merge"), ["choice", "key"]).filter("bits <> hub").select("bits", "hub").distinct())
    item, of = (lambda c: F.concat(F.lit("i"), F.col(c).cast("string"))), (lambda c: F.concat(F.lit("c"), F.col(c).cast("string")))
    met = near.select("bits").union(near.select("hub")).union(some.filter("linked and bits is not null").select("bits")).distinct()
    free = some.filter("not linked").join(met.hint("shuffle_merge"), "bits", "left_anti").select("id").union(marked.filter("bits is null and not linked").select("id"))  # nothing can match these
    links = some.join(met.hint("shuffle_merge"), "bits").select(item("id").alias("a"), of("bits").alias("b")).union(near.select(of("bits"), of("hub"))).union(older.select(item("a"), item("b")))
    open_ = saved(some.withColumn("node", item("id")).join(components(links).hint("shuffle_merge"), "node").select("id", "seq", "bits", "root"))
    kind, n = items.schema["id"].dataType.simpleString(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = free
    while not open_.isEmpty():
        turn = F.row_number().over(Window.partitionBy("root").orderBy("seq", "id"))
        heads = saved(open_.withColumn("turn", turn).filter(F.col("turn") <= most_rows).drop("turn"))
        matches = older.join(heads.select(F.col("id").alias("b"), "root").hint("shuffle_merge"), "b")
        null = lambda t: F.lit(None).cast(t)
        rows = heads.select("root", F.lit(1).alias("kind"), F.col("id").cast("string").alias("x"), null("string").alias("y"), "bits", "seq", F.col("id").alias("key")).union(
            matches.select("root", F.lit(0), F.col("a").cast("string"), F.col("b").cast("string"), null("long"), null("long"), null(kind))
        )
        new = saved(rows.repartition(n, "root").sortWithinPartitions("root", "kind").mapInArrow(_in_order([m & _WHOLE for m in masks], most), "x string").select(F.col("x").cast(kind).alias("id")))
        found = found.union(new)
        rest = open_.join(heads.select("id").hint("shuffle_merge"), "id", "left_anti")
        if rest.isEmpty():
            break
        classes = heads.join(new.hint("shuffle_merge"), "id").filter("bits is not null").select("bits").distinct()
        reach = _in_reach(rest.filter("bits is not null").select("bits").distinct(), classes, most).select("bits").distinct()
        beaten = rest.join(reach.hint("shuffle_merge"), "bits").select("id").union(older.join(new.withColumnRenamed("id", "a").hint("shuffle_merge"), "a").select(F.col("b").alias("id")))
        open_ = saved(rest.join(beaten.distinct().hint("shuffle_merge"), "id", "left_anti"))
    return found


def _in_reach(classes: DataFrame, others: DataFrame, most: int) -> DataFrame:
    """bits, other, distance: which of ``others`` (bits) are at most ``most`` bits from each of ``classes`` (bits), itself included. By a shuffle: Spark takes the twenty rows of a class for one."""
    masks = _masks(most)
    right = _keyed(others, masks).select("choice", "key", F.col("bits").alias("other"))
    apart = F.col("bits").bitwiseXOR(F.col("other"))
    first = F.coalesce(*(F.when(apart.bitwiseAND(F.lit(m)) == 0, i) for i, m in enumerate(masks)))
    met = _keyed(classes, masks).join(right.hint("shuffle_merge"), ["choice", "key"]).filter((F.bit_count(apart) <= most) & (first == F.col("choice")))
    return met.select("bits", "other", F.bit_count(apart).cast("int").alias("distance"))


def first_come(nodes: DataFrame, edges: DataFrame | None = None, fingerprints: DataFrame | None = None, most: int = DUPLICATE_DISTANCE, most_rows: int = 200_000) -> DataFrame:
    """Which items are canonical: an item is, unless an *earlier canonical* item matches it.

    ``nodes``: id, seq. ``edges``: a, b, weight (smaller is nearer), in either direction. ``fingerprints``: id, simhash; items at most ``most`` bits apart match, their distance is the weight. Returns id,
    duplicate_of (null: canonical), the nearest canonical earlier match, ties to the smaller identifier. Items are settled a component of matches at a time, so a long chain takes no more rounds than a short one.

    Equal fingerprints are one class, which has one canonical item at most. Classes are only paired with canonical ones, which are out of reach of each other, so neither a text that a third of all rows share nor a crowd
    of near texts makes a square. All joins name a shuffle, as tables that are small as files would go through the driver.
    """
    if most_rows < 1:
        raise ValueError("a task must settle one item at least")
    order, at = nodes.select("id", "seq"), F.struct("seq", "id")
    if edges is None:
        edges = order.filter("false").select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("weight"))
    if fingerprints is None:
        fingerprints = order.filter("false").select("id", F.lit("").alias("simhash"))
    both = edges.select("a", "b", F.col("weight").cast("double").alias("weight"))
    both = both.union(both.select("b", "a", "weight"))
    older = both.join(order.select(F.col("id").alias("a"), F.col("seq").alias("a_seq")).hint("shuffle_merge"), "a").join(order.select(F.col("id").alias("b"), F.col("seq").alias("b_seq")).hint("shuffle_merge"), "b")
    older = saved(older.filter((F.col("a_seq") < F.col("b_seq")) | ((F.col("a_seq") == F.col("b_seq")) & (F.col("a") < F.col("b")))).groupBy("a", "b").agg(F.min("weight").alias("weight")))
    valid = fingerprints.filter((F.length("simhash") == 16) & (F.col("simhash") != "0" * 16)).select("id", simhash_bits(F.col("simhash")).alias("bits"))
    items = saved(order.filter("id is not null").join(valid.hint("shuffle_merge"), "id", "left"))
    best = saved(items.join(_canonical(items, older, most, most_rows).hint("shuffle_merge"), "id"))
    heads = best.filter("bits is not null").groupBy("bits").agg(F.min(F.struct("seq", "id")).alias("at"))  # one a class, but for items that have no fingerprint
    near = _in_reach(items.filter("bits is not null").select("bits").distinct(), heads.select("bits"), most)
    choices = near.join(heads.select(F.col("bits").alias("other"), "at").hint("shuffle_merge"), "other").select("bits", F.struct(F.col("distance").cast("double").alias("weight"), F.col("at.id").alias("a"), "at").alias("c"))
    choices = choices.groupBy("bits").agg(F.collect_list("c").alias("choices"))  # canonical classes in reach of one class, and of none of each other
    alike = items.join(choices.hint("shuffle_merge"), "bits").select("id", F.array_min(F.filter("choices", lambda c: c["at"] < at)).alias("x")).filter("x is not null").select("id", "x.weight", "x.a")
    linked = older.join(best.select(F.col("id").alias("a")).hint("shuffle_merge"), "a").select(F.col("b").alias("id"), "weight", "a")
    parents = alike.union(linked).groupBy("id").agg(F.min(F.struct("weight", "a")).alias("x"))
    return order.join(parents.hint("shuffle_merge"), "id", "left").select("id", F.col("x.a").alias("duplicate_of"))


def last_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the last by ``order`` (descending columns)."""
    return rows.withColumn("__turn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__turn = 1").drop("__turn")
