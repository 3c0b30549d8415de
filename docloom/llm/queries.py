"""The registered queries of the training-data operators: each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import spread
from .oracles import SQL  # noqa: F401  read by __spark_entry__

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a small one of texts over all cores, as one row group would be one task."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .backoff_scores import whole_scores

    scores = whole_scores(table(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_words", *(F.round(c, 6).alias(c) for c in ("log_score", "mean_log_score")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    packed = pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1, capacity=2048, ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_piece_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_spans import encode_decode

    coded = encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.array_max("ends"), F.lit(0)).cast("long").alias("n_bytes"),
    )


def op4_ordinal_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ordinal_classifier import fit_on, grade_documents, graded

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return grade_documents(docs, fit_on(docs, labels, graded(labels)))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(3)
        values, offsets = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
        crc = [zlib.crc32(values[i:j].tobytes()) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.array(crc, np.int64))], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_shards import read_shards, write_shards

    manifest = write_shards(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2)
    return read_shards(manifest).mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_content import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_duplicates import near_duplicate_classes

    return near_duplicate_classes(table(spark, sf_dir, "documents"), size=4, percent=80)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_report

    return quality_report(table(spark, sf_dir, "documents")).withColumns({c: F.round(c, 6) for c in ("chars_distance", "words_distance")})


def op9_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_graph import nearest

    return nearest(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"), window=50).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .secret_scan import find_secrets, secret_digest

    return secret_digest(find_secrets(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance_resampling import resample

    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), order=1, buckets=10_000, seed="2024", percent=10, least_words=20)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"), family=20, head_turns=3)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_backoff_scores, op2_packing, op3_piece_spans, op4_ordinal_classifier, op5_token_shards, op6_html_content, op7_near_duplicates, op8_quality_rules, op9_vector_graph, op10_substring_dedup, op11_secret_scan, op12_importance_resampling, op13_conversation_trie)}
