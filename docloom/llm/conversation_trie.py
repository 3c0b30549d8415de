"""A prefix trie of rebuilt conversations, merged family first.

Conversations whose ids share ``id - id % family`` form a family: the first turns of its base conversation open those of all others. The turns of a family meet by base id, are rebuilt there and combined into a small trie;
only nodes of these are shuffled to be merged into the trie of all.

A turn is known by a 128-bit digest of its role and text, a node by the exclusive or of 128-bit hashes of (position, turn) of its path, so that a path can be computed in pieces: no text is shuffled, and a chance
meeting of two of n nodes has a probability of about n * n / 2 ** 129.

Sums over subtrees need no walk through the trie: every node belongs to its smallest member, a conversation owns the last nodes of its path, and the nodes below x are those that the members of x own, less what the
smallest member owns above x. So they are sums over members, and the work doesn't depend on the depth.

No turn is held together with all others of its conversation: turns are sorted by ranges and go on in segments, which Spark may cut anywhere; positions and path hashes of a cut conversation are carried from segment to
segment. The members that end at a node are hashed as a stream of chunks.

Nulls: rows without a conversation id belong to none and are left out; a null turn comes first, a null role or text is empty. Turns of equal number are ordered by role, then by the SHA-256 of their text; repeated
rows are turns of their own. Other columns, whatever their names, are left out. An empty table has no root, as it has no member, and gives no rows. Remainders of negative ids are negative or nought, as in SQL.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._frames import column, partitions, small_batches, written
from ._words import mix

_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
#: Segments of one conversation that stay with its family; later ones are combined elsewhere.
_NEAR = 1 << 16
#: Bytes of conversation ids in one chunk of a stream to be hashed.
_CHUNK = 1 << 20

_SEGMENTS = "conv_id long, part int, seq long, n long, digests binary, words array<long>, whole boolean"
_NODES = "base long, h1 long, h2 long, p1 long, p2 long, depth long, words long, before long, members array<long>, ends array<struct<conv_id long, total long>>"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted turns (conv_id, digest, words): one row for each stretch of a conversation within a batch. The first and the last of a batch may go on elsewhere and count as cut."""
    part, seq = TaskContext.get().partitionId(), 0
    for b in batches:
        if not b.num_rows:
            continue
        conv = b.column(0).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1], True])
        digests, n = b.column(1).cast(pa.binary()), len(edges) - 1
        raw = b"".join(digests.to_pylist())
        whole = np.ones(n, bool)
        whole[[0, -1]] = False
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(conv[edges[:-1]]),
                pa.array(np.full(n, part, np.int32)),
                pa.array(np.arange(seq, seq + n)),
                pa.array(np.diff(edges)),
                pa.array([raw[16 * i : 16 * j] for i, j in zip(edges[:-1], edges[1:], strict=True)], pa.binary()),
                pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), b.column(2)),
                pa.array(whole),
            ],
            ["conv_id", "part", "seq", "n", "digests", "words", "whole"],
        )
        seq += n


def taken_turns(conv_id: int, head_turns: int) -> int:
    """How many turns of the base conversation open this one: 0 to ``head_turns``."""
    return zlib.crc32(str(conv_id).encode()) % (head_turns + 1)


def _rebuilt(row: dict, head_turns: int) -> tuple[int, bytes, list[int]]:
    """Turns before this segment of the rebuilt conversation, and the digests and words of the turns that the segment adds; the first brings those of the base conversation."""
    heads = [(h["digests"], h["words"]) for h in row["heads"] or []]
    head, head_words = b"".join(d for d, _ in heads), [w for _, ws in heads for w in ws]
    h = taken_turns(row["conv_id"], head_turns)
    used, start = min(h, len(head_words)), row["start"]
    skip = max(0, h - start)
    digests, words = row["digests"][16 * skip :], row["words"][skip:]
    if start == 0:
        return 0, head[: 16 * used] + digests, head_words[:used] + words
    return used + max(0, start - h), digests, words


def _hashed(place: np.ndarray, digests: bytes) -> np.ndarray:
    """128-bit hashes, as two columns, of turns at their places in a path."""
    d = np.frombuffer(digests, np.uint64).reshape(-1, 2)
    p = place.astype(np.uint64)
    one = mix(mix(d[:, 0] ^ mix(p * _K[0] + _K[1])) + d[:, 1] * _K[2])
    two = mix(mix(d[:, 1] ^ mix(p * _K[3] + _K[2])) + d[:, 0] * _K[0])
    return np.stack([one, two], axis=1)


def _paths(row: dict, head_turns: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Of a segment: the hashes of its nodes in turn, after that of what came before; words of the turns, after nought; and the depth before it."""
    depth, digests, words = _rebuilt(row, head_turns)
    each = _hashed(np.arange(depth + 1, depth + 1 + len(words)), digests)
    carry = np.array([[row["x1"], row["x2"]]], np.int64).view(np.uint64)
    return np.bitwise_xor.accumulate(np.concatenate([carry, each])), np.array([0, *words], np.int64), depth


def _positioned(turns: DataFrame, family: int, head_turns: int) -> DataFrame:
    """Segments with their base, the first turns of the base conversation, and what earlier segments of the conversation carry into them."""
    spark = turns.sparkSession
    order = ("conv_id", F.asc_nulls_first("turn"), "role", "text_hash", "words")
    ranges = turns.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    segments = written(ranges.select("conv_id", F.expr("substring(unhex(sha2(concat(text_hash, cast(role AS binary)), 256)), 1, 16)").alias("digest"), "words").mapInArrow(_segments, _SEGMENTS), "segments")
    segments = segments.withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
    earlier = Window.partitionBy("conv_id").orderBy("part", "seq")
    cut = segments.filter(~F.col("whole"))
    cut = cut.withColumns({"start": F.coalesce(F.sum("n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "last": F.lead("n").over(earlier).isNull()})
    whole = segments.filter("whole").withColumns({"start": F.lit(0).cast("long"), "last": F.lit(True)})
    starts = [s.filter((F.col("conv_id") == F.col("base")) & (F.col("start") < head_turns)) for s in (whole, cut)]
    bits, few = F.expr(f"substring(digests, 1, {16 * head_turns})").alias("digests"), F.slice("words", 1, head_turns).alias("words")
    heads = starts[0].union(starts[1]).groupBy("base").agg(F.array_sort(F.collect_list(F.struct("start", bits, few))).alias("heads"))  # at most one segment for each of these turns

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            ends = [(x[-1].view(np.int64).tolist(), int(w.sum())) for x, w, _ in (_paths(r | {"x1": 0, "x2": 0}, head_turns) for r in rows)]
            own = [pa.array([x[0] for x, _ in ends], pa.int64()), pa.array([x[1] for x, _ in ends], pa.int64()), pa.array([w for _, w in ends], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *own], [*b.schema.names, "own1", "own2", "own_words"])

    joined = cut.join(heads, "base", "left")
    summed = joined.mapInArrow(add_up, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema) + ", own1 long, own2 long, own_words long")
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    carried = summed.withColumns({"x1": F.coalesce(F.bit_xor("own1").over(before), none), "x2": F.coalesce(F.bit_xor("own2").over(before), none), "before": F.coalesce(F.sum("own_words").over(before), none)})
    columns = ["conv_id", "base", "start", "last", "digests", "words", "heads", "x1", "x2", "before"]
    return whole.join(heads, "base", "left").withColumns({"x1": none, "x2": none, "before": none}).select(columns).union(carried.select(columns))


def _family_tries(head_turns: int):
    """Combines segments, sorted by base, into the nodes of family tries: a node's members of one batch become one row, and rows of a family that batches cut apart are merged with all others later."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes: dict[tuple[int, int, int], list] = {}
            for row in b.to_pylist():
                path, words, depth = _paths(row, head_turns)
                hashes, through = path.view(np.int64).tolist(), (row["before"] + np.cumsum(words)).tolist()
                first = 0 if row["start"] == 0 else 1  # the root is the first segment's
                for i in range(first, len(hashes)):
                    up = hashes[i - 1] if i else [None, None]
                    node = nodes.setdefault((row["base"], *hashes[i]), [*up, depth + i, int(words[i]), through[i - 1] if i else 0, [], []])
                    node[5].append(row["conv_id"])
                if row["last"]:
                    end = nodes.setdefault((row["base"], *hashes[-1]), [None, None, None, None, None, [], []])  # a segment without a turn of its own ends where an earlier one did
                    end[6].append({"conv_id": row["conv_id"], "total": through[-1]})
            rows = [[*key, *node] for key, node in nodes.items()]
            schema = pa.schema([*((c, pa.int64()) for c in ("base", "h1", "h2", "p1", "p2", "depth", "words", "before")), ("members", pa.list_(pa.int64())), ("ends", pa.list_(pa.struct([("conv_id", pa.int64()), ("total", pa.int64())])))])
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return combine


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (h1, h2, conv_id), sorted: runs of one node's ids as comma-joined text, cut at ``_CHUNK`` bytes and at the ends of batches."""
    for b in batches:
        if not b.num_rows:
            continue
        a, c, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        edges = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (c[1:] != c[:-1]), True])
        cuts = [k for i, j in zip(edges[:-1], edges[1:], strict=True) for k in range(i, j, _CHUNK // 20)] + [b.num_rows]
        texts = [",".join(map(str, ids[i:j].tolist())) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        at = np.array(cuts[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(c[at]), pa.array(ids[at]), pa.array(texts)], ["h1", "h2", "first", "ids"])


def _streamed_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (h1, h2, first, ids), sorted: the SHA-256 of each node's ids, joined by commas; one chunk at a time is held."""
    node, sha = None, None

    def out(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.string())], ["h1", "h2", "ends_sha256"])

    for b in batches:
        done = []
        for h1, h2, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
            if (h1, h2) == node:
                sha.update(b"," + ids.encode())
                continue
            if node:
                done.append((*node, sha.hexdigest()))
            node, sha = (h1, h2), hashlib.sha256(ids.encode())
        yield out(done)
    if node:
        yield out([(*node, sha.hexdigest())])


def conversation_trie(conversations: DataFrame, family: int = 20, head_turns: int = 3) -> DataFrame:
    """One row a node of the trie of rebuilt conversations.

    Conversation c is rebuilt from the first h turns of conversation c - c % family, h = crc32(decimal c) % (head_turns + 1), and its own turns after its first h. Columns: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens (over the subtree: members but one, times the words of the node's turn), ends_sha256 (of the ids of members that end here).
    """
    spark = conversations.sparkSession
    small_batches(spark)
    source = conversations.select(*(column(conversations, c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string")))).filter("conv_id IS NOT NULL")
    text = F.coalesce("text", F.lit(""))
    turns = source.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.unhex(F.sha2(text, 256)).alias("text_hash"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    segments = _positioned(turns, family, head_turns).withColumn("stretch", F.expr(f"start div {_NEAR}"))
    tries = written(segments.repartition(partitions(spark), "base", "stretch").sortWithinPartitions("base", "conv_id", "start").drop("stretch").mapInArrow(_family_tries(head_turns), _NODES), "families")

    n, ended = F.sum(F.size("members").cast("long")), F.sum(F.size("ends").cast("long"))
    merged = tries.groupBy("h1", "h2").agg(F.min(F.array_min("members")).alias("conv_id"), F.max("words").alias("words"), (n == ended).cast("long").alias("childless"))
    owners = merged.groupBy("conv_id").agg(F.sum("words").alias("own"), F.sum("childless").alias("leaves"))
    ends = tries.select("base", "h1", "h2", F.explode("ends").alias("end")).select("base", "h1", "h2", "end.*")
    members = ends.join(owners, "conv_id", "left").select("base", "conv_id", F.struct("total", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("leaves", F.lit(0)).alias("leaves")).alias("of"))
    families = members.groupBy("base").agg(F.map_from_entries(F.collect_list(F.struct("conv_id", "of"))).alias("of"))  # ids of one base: fewer than twice the family

    def total(field: str):
        return F.aggregate("members", F.lit(0).cast("long"), lambda s, m: s + F.col("of")[m][field])

    least = F.array_min("members")
    sums = tries.join(families, "base").select("h1", "h2", "p1", "p2", "depth", "words", "before", F.size("members").cast("long").alias("n"), total("total").alias("total"), total("own").alias("own"), total("leaves").alias("leaves"), F.struct(least.alias("conv_id"), (F.col("of")[least]["total"] - F.col("of")[least]["own"]).alias("above")).alias("owner"))
    nodes = written(
        sums.groupBy("h1", "h2")
        .agg(*(F.max(c).alias(c) for c in ("p1", "p2", "depth", "words", "before")), *(F.sum(c).alias(c) for c in ("n", "total", "own", "leaves")), F.min(F.when(F.col("n") > 0, F.col("owner"))).alias("owner"))
        .select("h1", "h2", "p1", "p2", "depth", F.col("owner.conv_id").alias("conv_id"), "n", "leaves", (F.col("total") - F.col("n") * F.col("before") - (F.col("own") + F.col("owner.above") - F.col("before"))).alias("saved")),
        "nodes",
    )
    sorted_ends = ends.select("h1", "h2", "conv_id").repartitionByRange(partitions(spark), "h1", "h2", "conv_id").sortWithinPartitions("h1", "h2", "conv_id")
    chunks = sorted_ends.mapInArrow(_chunks, "h1 long, h2 long, first long, ids string")
    hashed = chunks.repartition(partitions(spark), "h1", "h2").sortWithinPartitions("h1", "h2", "first").mapInArrow(_streamed_hashes, "h1 long, h2 long, ends_sha256 string")
    children = nodes.filter(F.col("p1").isNotNull()).groupBy("p1", "p2").agg(F.count("*").alias("n_children")).select(F.col("p1").alias("h1"), F.col("p2").alias("h2"), "n_children")
    parents = nodes.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return (
        nodes.join(hashed, ["h1", "h2"], "left").join(children, ["h1", "h2"], "left").join(parents, ["p1", "p2"], "left")
        .select("conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
    )
