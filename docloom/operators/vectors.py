"""A vector index that changes: segments of vectors, deletions as marks, compaction.

``put`` adds a segment, whose vectors take the place of older ones of the same identifier; ``without`` marks identifiers as gone up to the newest segment; both write what they bring and nothing else. Reading keeps of each
identifier the newest vector that no mark covers; ``compacted`` writes these as one segment. An index is immutable, so a reader keeps what it has opened; ``manifest`` describes it in a few lines of JSON.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pivots import finite
from .ranking import nearest_vectors
from .storage import shared_path


@dataclass(frozen=True)
class VectorIndex:
    """``segments``: (path, number); ``deletions``: (path, number of the newest segment they cover). All vectors have ``length`` numbers."""

    length: int
    id_type: str = "long"
    segments: tuple[tuple[str, int], ...] = ()
    deletions: tuple[tuple[str, int], ...] = ()

    def manifest(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def opened(manifest: str) -> VectorIndex:
        given = json.loads(manifest)
        return VectorIndex(**given | {n: tuple(tuple(x) for x in given[n]) for n in ("segments", "deletions")})

    def _read(self, spark: SparkSession, stored: tuple[tuple[str, int], ...], columns: str) -> DataFrame:
        out = spark.createDataFrame([], columns).withColumn("number", F.lit(0))
        for path, number in stored:
            out = out.union(spark.read.schema(columns).parquet(path).withColumn("number", F.lit(number)))
        return out

    def put(self, rows: DataFrame, duplicate_col: str | None = None) -> VectorIndex:
        """Sets the vectors of (id, embedding). Null identifiers, vectors of another length or with anything but finite numbers, and rows that are duplicates of others (``duplicate_col`` not null) are left out; of rows
        that repeat an identifier the greatest vector counts."""
        fits = F.col("id").isNotNull() & finite("embedding") & (F.size("embedding") == self.length)
        kept = rows.filter(fits & F.col(duplicate_col).isNull() if duplicate_col else fits)
        path, number = shared_path(rows.sparkSession, "vectors"), 1 + max((n for _, n in self.segments), default=0)
        kept.select(F.col("id").cast(self.id_type).alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).groupBy("id").agg(F.max("embedding").alias("embedding")).write.parquet(path)
        return replace(self, segments=(*self.segments, (path, number)))

    def without(self, ids: DataFrame) -> VectorIndex:
        """Takes out identifiers (id); unknown ones are passed over."""
        path = shared_path(ids.sparkSession, "gone")
        ids.select(F.col("id").cast(self.id_type).alias("id")).filter("id is not null").distinct().write.parquet(path)
        return replace(self, deletions=(*self.deletions, (path, max((n for _, n in self.segments), default=0))))

    def living(self, spark: SparkSession) -> DataFrame:
        """id, embedding: the newest vector of each identifier that is there."""
        rows = self._read(spark, self.segments, f"id {self.id_type}, embedding array<double>")
        gone = self._read(spark, self.deletions, f"id {self.id_type}").groupBy("id").agg(F.max("number").alias("upto"))
        newest = rows.groupBy("id").agg(F.max_by("embedding", "number").alias("embedding"), F.max("number").alias("number"))
        return newest.join(gone, "id", "left").filter(F.col("number") > F.coalesce("upto", F.lit(-1))).select("id", "embedding")

    def compacted(self, spark: SparkSession) -> VectorIndex:
        return VectorIndex(self.length, self.id_type).put(self.living(spark))

    def nearest(self, queries: DataFrame, k: int, floor: float = -1.0) -> DataFrame:
        """query_id, id, similarity, rank of ``queries`` (id, embedding), exactly, each but itself."""
        return nearest_vectors(self.living(queries.sparkSession), queries, k, floor)
