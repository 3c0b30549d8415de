"""A keyword index in segments: postings in blocks with bounds, top-k search that skips blocks, updates without rebuilding.

A segment holds the documents of one batch, dealt to groups of about ``GROUP`` documents of like length. A block is the postings of one term in one group, with the largest weight and the smallest length in it, which bound
the term's share of any score in the group, whatever the corpus' mean length is by then. A search first sums these bounds by group; it scores the groups of the highest bounds, and then only the groups whose bound
reaches the k-th score found, so the postings of all others are never read.

A batch adds a segment, a deletion marks: identifiers with the number of the first segment in which they would live again, and what the frequencies of terms lose. An update is both. ``merged`` rewrites what lives into one
segment. An index is immutable, so a reader keeps what it has opened; ``manifest`` describes it in a few lines of JSON.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranking import COLUMN_WEIGHTS, B, K1
from .storage import shared_path

GROUP = 512
_FORWARD = "id string, length long, terms array<struct<term string, tf double>>"
_BLOCKS = "term string, group long, documents int, largest double, shortest long, postings array<struct<id string, tf double, length long>>"


def _counted(weights: list[float]):
    """Of (id, token arrays): id, length, and the weight of each term, in order; a document's counts never leave its row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, tfs, offsets, lengths = [], [], [0], []
            for arrays in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                total: Counter[str] = Counter()
                for tokens, weight in zip(arrays, weights, strict=True):
                    for term, n in Counter(tokens).items():
                        if term is not None:
                            total[term] += n * weight
                lengths.append(sum(map(len, arrays)))
                terms += (own := sorted(total))
                tfs += [total[t] for t in own]
                offsets.append(len(terms))
            pairs = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(tfs, pa.float64())], ["term", "tf"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)], ["id", "length", "terms"])

    return count


@dataclass(frozen=True)
class Segment:
    """``path``: folder of the tables ``forward`` and ``blocks``; ``number``: later ones are newer."""

    path: str
    number: int


@dataclass(frozen=True)
class Deletion:
    """``path``: folder of the tables ``ids`` and ``losses``; documents of segments before ``below`` are gone."""

    path: str
    below: int


@dataclass(frozen=True)
class SegmentedIndex:
    segments: tuple[Segment, ...] = ()
    deletions: tuple[Deletion, ...] = ()
    documents: int = 0
    words: int = 0

    def manifest(self) -> str:
        return json.dumps({"segments": [vars(s) for s in self.segments], "deletions": [vars(d) for d in self.deletions], "documents": self.documents, "words": self.words})

    @staticmethod
    def opened(manifest: str) -> SegmentedIndex:
        given = json.loads(manifest)
        return SegmentedIndex(tuple(Segment(**s) for s in given["segments"]), tuple(Deletion(**d) for d in given["deletions"]), given["documents"], given["words"])

    # Reading

    def _tables(self, spark: SparkSession, table: str, schema: str) -> DataFrame:
        """A table of all segments, with the number of the segment."""
        out = spark.createDataFrame([], schema).withColumn("segment", F.lit(0))
        for s in self.segments:
            out = out.union(spark.read.schema(schema).parquet(f"{s.path}/{table}").withColumn("segment", F.lit(s.number)))
        return out

    def _gone(self, spark: SparkSession) -> DataFrame:
        """id, below: in segments before ``below`` the document is gone."""
        out = spark.createDataFrame([], "id string, below int")
        for d in self.deletions:
            out = out.union(spark.read.schema("id string").parquet(f"{d.path}/ids").withColumn("below", F.lit(d.below)))
        return out.groupBy("id").agg(F.max("below").alias("below"))

    def living(self, spark: SparkSession) -> DataFrame:
        """The documents that are there: id, length, terms."""
        rows = self._tables(spark, "forward", _FORWARD).join(self._gone(spark), "id", "left")
        return rows.filter(F.coalesce("below", F.lit(-1)) <= F.col("segment")).drop("below", "segment")

    # Changing

    def with_documents(self, documents: DataFrame, columns: dict[str, float] = COLUMN_WEIGHTS) -> SegmentedIndex:
        """Adds documents (id, token arrays); those whose identifiers are there already take the place of the old ones."""
        tokens = [F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c) for c in columns]
        rows = documents.select(F.col("id").cast("string").alias("id"), *tokens)
        return self._with_forward(rows.mapInArrow(_counted(list(columns.values())), _FORWARD))

    def _with_forward(self, forward: DataFrame) -> SegmentedIndex:
        spark = forward.sparkSession
        number = 1 + max((s.number for s in self.segments), default=0)
        path = shared_path(spark, "segment")
        forward.write.parquet(f"{path}/forward")
        rows = spark.read.schema(_FORWARD).parquet(f"{path}/forward")
        alike = F.floor(F.log2(F.greatest(F.col("length"), F.lit(1)).cast("double")) * 4)
        sizes = {r["c"]: -(-r["n"] // GROUP) for r in rows.groupBy(alike.alias("c")).agg(F.count("*").alias("n")).collect()}  # at most four rows a doubling of the length
        parts = F.create_map(*(F.lit(x) for c, n in sizes.items() for x in (c, n)))[alike] if sizes else F.lit(1)
        group = (alike * (1 << 40) + F.pmod(F.xxhash64("id"), parts)).cast("long")
        postings = rows.select("id", "length", group.alias("group"), F.explode("terms").alias("t")).select("t.term", "group", F.struct("id", "t.tf", "length").alias("p"))
        blocks = postings.groupBy("term", "group").agg(F.count("*").cast("int").alias("documents"), F.max("p.tf").alias("largest"), F.min("p.length").alias("shortest"), F.collect_list("p").alias("postings"))  # a group's documents
        blocks.sortWithinPartitions("term", "group").write.parquet(f"{path}/blocks")  # in order of terms, so that a search reads the pages of its terms
        fresh = replace(self, segments=(*self.segments, Segment(path, number)))
        known = self.without(rows.select("id")) if self.segments else self
        stats = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).first()
        return replace(fresh, deletions=known.deletions, documents=known.documents + stats["n"], words=known.words + stats["words"])

    def without(self, ids: DataFrame) -> SegmentedIndex:
        """Marks documents (id) as gone; identifiers that aren't there are passed over."""
        spark = ids.sparkSession
        path = shared_path(spark, "deletion")
        lost = self.living(spark).join(ids.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi")
        lost.write.parquet(f"{path}/lost")
        lost = spark.read.schema(_FORWARD).parquet(f"{path}/lost")
        lost.select("id").write.parquet(f"{path}/ids")
        lost.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("n")).repartitionByRange(4, "term").sortWithinPartitions("term").write.parquet(f"{path}/losses")
        stats = lost.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).first()
        below = 1 + max((s.number for s in self.segments), default=0)
        return replace(self, deletions=(*self.deletions, Deletion(path, below)), documents=self.documents - stats["n"], words=self.words - stats["words"])

    def merged(self, spark: SparkSession) -> SegmentedIndex:
        """One segment of all that lives, without marks."""
        return SegmentedIndex()._with_forward(self.living(spark))

    # Searching

    def search(self, spark: SparkSession, terms: list[str], k: int, every: bool = True, costs: dict | None = None) -> DataFrame:
        """id, score: the ``k`` best documents by BM25 that hold all ``terms`` (or any), exactly; ties go to smaller identifiers. ``costs`` gets how many blocks of these terms there are, and how many were read."""
        terms = list(dict.fromkeys(terms))
        if not terms or not self.documents or k < 1:
            return spark.createDataFrame([], "id string, score double")
        mean, wanted = max(self.words / self.documents, 1e-9), F.col("term").isin(*terms)
        bounds = self._tables(spark, "blocks", _BLOCKS).filter(wanted).select("term", "segment", "group", "documents", "largest", "shortest")  # the postings aren't read
        seen = {r["term"]: r["n"] for r in bounds.groupBy("term").agg(F.sum("documents").alias("n")).collect()}  # a row a term of the query
        for d in self.deletions:
            for r in spark.read.schema("term string, n long").parquet(f"{d.path}/losses").filter(wanted).collect():
                seen[r["term"]] = seen.get(r["term"], 0) - r["n"]
        idf = {t: max(math.log((self.documents - seen.get(t, 0) + 0.5) / (seen.get(t, 0) + 0.5)), 1e-6) for t in terms}
        weight = F.create_map(*(F.lit(x) for t in terms for x in (t, idf[t])))[F.col("term")]

        def share(tf: Column, length: Column) -> Column:
            return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))

        need = len(terms) if every else 1
        groups = bounds.groupBy("segment", "group").agg((F.sum(share(F.col("largest"), F.col("shortest"))) * (1 + 1e-9)).alias("bound"), F.count("*").alias("blocks")).filter(F.col("blocks") >= need).cache()
        gone = self._gone(spark)

        def scored(some: DataFrame) -> DataFrame:
            blocks = self._tables(spark, "blocks", _BLOCKS).filter(wanted).join(F.broadcast(some.select("segment", "group")), ["segment", "group"])  # a pair for each group of 512 documents at most
            hits = blocks.select("term", "segment", F.explode("postings").alias("p")).select("segment", "p.id", share(F.col("p.tf"), F.col("p.length")).alias("share"))
            found = hits.groupBy("segment", "id").agg(F.sum("share").alias("score"), F.count("*").alias("n")).filter(F.col("n") >= need)
            return found.join(gone, "id", "left").filter(F.coalesce("below", F.lit(-1)) <= F.col("segment")).select("id", "score")

        try:
            probe = groups.orderBy(F.desc("bound"), "segment", "group").limit(max(2, -(-2 * k // GROUP)))
            first = [(r["id"], r["score"]) for r in scored(probe).orderBy(F.desc("score"), "id").limit(k).collect()]
            least = first[-1][1] if len(first) == k else -1.0
            rest = groups.join(F.broadcast(probe.select("segment", "group")), ["segment", "group"], "left_anti").filter(F.col("bound") >= least)
            second = [(r["id"], r["score"]) for r in scored(rest).filter(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(k).collect()]
            if costs is not None:
                total = lambda df: df.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
                costs |= {"blocks": bounds.count(), "read": total(probe) + total(rest)}
        finally:
            groups.unpersist()
        best = sorted([*first, *second], key=lambda r: (-r[1], r[0]))[:k]
        return spark.createDataFrame(best, "id string, score double")
