"""Removal of repeated passages by prefix-partitioned suffix trees over words.

A window is ``window`` consecutive words of one document. A word goes if a window over it also starts in a document of smaller key.

1. Documents of equal word sequences are one class, led by its smallest key; all others in it lose every word (if they have a window at all).
2. Suffixes are sampled: of the ``PREFIX``-word prefixes in a window, the least by hash (the first, if it repeats) is its anchor. Equal windows have equal anchors at
   equal places, so comparing the suffixes at anchors, with the words before them, finds every repeated window. About one word in 22 is an anchor.
3. Prefixes of one class only are dropped by an aggregate that is combined before its shuffle. Only classes with a shared prefix send their text on, once.
4. An anchor's block is the run of words under all its windows. Equal blocks become one, led by its smallest key: others lose the whole block.
5. Blocks are partitioned by prefixes of variable length. A prefix with at most ``group`` distinct blocks is a group in memory. One with more is too short: its blocks are halved, by how far a window begins before the
   anchor. All windows of a half have more words in common than those of the whole, and these are the longer prefix; equal halves become one again. Halves are halved, where still needed, down to single windows, of which equal ones
   are one. So no group, however common its passage, is collected, and only the blocks of too short prefixes are sent on.
6. The suffix tree of a group is built in memory, in array form: its suffixes, from every window to the end of its block, in order (by naming runs of 1, 2, 4, ... words), and the words that neighbours have in common. An
   internal node is a run of suffixes with so many words in common; each of ``window`` words or more is a repeat, owned by the smallest key below it, and its other leaves are lost windows.
7. The windows lost are united for each document, to maximal spans.

Defined results: null text is empty; fewer words than a window lose nothing. A null key is smaller than any other. Rows of one key never take words from each other; rows that repeat key
and text get the same result. Extra columns are passed over by the report and kept by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._frames import column, keyed_text, partitions, written
from ._graph import runs
from ._words import Words, chained, hashes, mix, slices, within, words

PREFIX = 8
_LEAST = -(1 << 63)
_STEPS = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9FB21C651E98DF25))


def _powers(step: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        k = min(done, n - done)
        out[done : done + k] = out[:k] * np.uint64(int(out[done - 1]) * int(step) & (1 << 64) - 1)
        done += k
    return out


def run_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each run h[start:end] of any length."""
    step = _STEPS[which]
    inverse = np.uint64(pow(int(step), -1, 1 << 64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(which)) * _powers(step, len(h)), dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * _powers(inverse, len(h) + 1)[starts] ^ mix((ends - starts).astype(np.uint64) + np.uint64(77)))


def anchors(w: Words, h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prefix hash of each anchor, the first and last window (by first word) that it stands for, and its own first word."""
    first = within(w, window)
    none = np.zeros(0, np.int64)
    if not len(first):
        return none.astype(np.uint64), none, none, none
    g = chained(h, PREFIX)
    bits = np.uint64(max(24, len(g).bit_length()))
    least = ((g >> bits) << bits) | np.arange(len(g), dtype=np.uint64)
    span, reach = window - PREFIX + 1, 1
    while 2 * reach <= span:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    if span > reach:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    at = (least[first] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero((at[1:] != at[:-1]) | (first[1:] != first[:-1] + 1)) + 1
    begin = np.concatenate([[0], new])
    end = np.concatenate([new, [len(first)]]) - 1
    return g[at[begin]], first[begin], first[end], at[begin]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _joined(text: str | None) -> bytes:
    return b" ".join((text or "").encode().split())  # bytes are split at exactly the six separators


def _scanned(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(batch.column(1)):
                part = batch.column(1).slice(at, to - at)
                w = words(part)
                h = hashes(w.data, w.starts, w.ends)
                prefix, lo, _, _ = anchors(w, h, window)
                where = np.searchsorted(lo, w.firsts)
                keys, shas = [], []
                for text, n in zip(part.to_pylist(), w.counts, strict=True):
                    whole = _joined(text)
                    keys.append(hashlib.blake2b(whole, digest_size=16).digest() if n >= window else None)
                    shas.append(hashlib.sha256(whole).hexdigest())
                lists = [np.unique(_signed(prefix[i:j])) for i, j in zip(where[:-1], where[1:], strict=True)]
                held = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *lists])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), batch.column(2).slice(at, to - at), pa.array(w.counts.astype(np.int64)), pa.array(keys, pa.binary()), pa.array(shas), held], ["doc_id", "text_hash", "n_words", "words_class", "words_sha256", "prefixes"])

    return run, "doc_id long, text_hash long, n_words long, words_class binary, words_sha256 string, prefixes array<long>"


def _contents(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    raw = data.tobytes()
    return pa.array([b" ".join(raw[a:b].split()) for a, b in zip(starts, ends, strict=True)], pa.binary())


def _blocks(window: int):
    """Blocks of the wanted prefixes of each class. ``anchor``: its place in the block; ``near`` and ``far``: how many words before it windows begin, at least and at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(batch.column(2)):
                part = batch.slice(at, to - at)
                w = words(part.column(2))
                h = hashes(w.data, w.starts, w.ends)
                prefix, lo, hi, anchor = anchors(w, h, window)
                owner = np.searchsorted(w.firsts, lo, side="right") - 1
                wanted = part.column(3)
                flat, offsets = wanted.flatten().to_numpy(), np.concatenate([[0], np.cumsum(wanted.value_lengths().to_numpy())])
                keep = np.zeros(len(lo), bool)
                begin = np.searchsorted(owner, np.arange(to - at + 1))
                for i in range(to - at):
                    mine = slice(begin[i], begin[i + 1])
                    keep[mine] = np.isin(_signed(prefix[mine]), flat[offsets[i] : offsets[i + 1]])
                prefix, lo, hi, anchor, owner = prefix[keep], lo[keep], hi[keep], anchor[keep], owner[keep]
                block = _signed(run_hashes(h, lo, hi + window)) if len(lo) else np.zeros(0, np.int64)
                take, whole = pa.array(owner), np.ones(len(lo), np.int32)
                numbers = ((lo - w.firsts[owner]), hi - lo + 1, anchor - lo, 0 * whole, (window - PREFIX) * whole)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(prefix)), pa.array(block), part.column(0).take(take), part.column(1).take(take), *(pa.array(x.astype(np.int32)) for x in numbers), _contents(w.data, w.starts[lo], w.ends[hi + window - 1])], ["prefix", "block", "c", "least_id", "at", "n", "anchor", "near", "far", "content"])

    return run, "prefix long, block long, c binary, least_id long, at int, n int, anchor int, near int, far int, content binary"


def _halves(window: int):
    """Both halves of each block (prefix, block, owner, n, anchor, near, far, content), by how far before the anchor windows begin, under their longer prefixes."""
    names = ["prefix", "block", "in_prefix", "in_block", "least_id", "at", "n", "anchor", "near", "far", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = words(b.column(7).cast(pa.large_binary()).cast(pa.large_string()))
            h = hashes(w.data, w.starts, w.ends)
            n, anchor, near, far = (b.column(j).to_numpy().astype(np.int64) for j in (3, 4, 5, 6))
            middle = (near + far + 1) // 2
            for low, high in ((near, middle - 1), (middle, far)):
                first, last = np.maximum(anchor - high, 0), np.minimum(anchor - low, n - 1)  # windows
                some = np.flatnonzero((first <= last) & (low <= high))
                first, last, low_, high_, at = first[some], last[some], low[some], high[some], w.firsts[some]
                begin, end = at + anchor[some] - low_, at + anchor[some] - high_ + window  # what all windows of a half have in common
                prefix = mix(run_hashes(h, begin, end) ^ mix((low_ * 4096 + high_ + 1).astype(np.uint64))) if len(some) else np.zeros(0, np.uint64)
                block = run_hashes(h, at + first, at + last + window) if len(some) else np.zeros(0, np.uint64)
                take = pa.array(some)
                numbers = (first, last - first + 1, anchor[some] - first, low_, high_)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(prefix)), pa.array(_signed(block)), *(b.column(j).take(take) for j in range(3)), *(pa.array(x.astype(np.int32)) for x in numbers), _contents(w.data, w.starts[at + first], w.ends[at + last + window - 1])], names)

    return run, "prefix long, block long, in_prefix long, in_block long, least_id long, at int, n int, anchor int, near int, far int, content binary"


def suffix_tree(h: np.ndarray, firsts: np.ndarray, leaves: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``leaves`` (places in ``h``, in texts ``owner`` that begin at ``firsts``) in order, each to the end of its text, and how many words each has in common with the next.

    Runs of 1, 2, 4, ... words are named in order, a name for each distinct run; every text ends with a word of its own.
    """
    texts = len(firsts) - 1
    sizes = np.diff(firsts)
    place = np.arange(len(h)) + np.repeat(np.arange(texts), sizes)
    names = np.zeros(len(h) + texts, np.int64)
    distinct, names[place] = np.unique(h, return_inverse=True)
    names[firsts[1:] + np.arange(texts)] = len(distinct) + np.arange(texts)
    levels, size = [names], 1
    while size <= int(sizes.max(initial=0)):
        after = np.concatenate([names[size:], np.full(min(size, len(names)), -1)]) + 1
        names = np.unique(names * (int(after.max(initial=0)) + 1) + after, return_inverse=True)[1].astype(np.int64)
        levels.append(names)
        size *= 2
    at = leaves + owner
    order = np.argsort(names[at], kind="stable")
    a, b = at[order[:-1]], at[order[1:]]
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 2, -1, -1):
        common += (levels[k][a + common] == levels[k][b + common]).astype(np.int64) << k
    return order, common


def _subtrees(window: int):
    """Lost windows of each block: leaves of a node of ``window`` words or more, below which another block of smaller key has a leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 1):
            owner = table.column("owner").to_numpy()
            n = table.column("n").to_numpy().astype(np.int64)
            w = words(table.column("content").combine_chunks().cast(pa.large_binary()).cast(pa.large_string()))
            h = hashes(w.data, w.starts, w.ends)
            before = np.cumsum(n) - n
            of = np.repeat(np.arange(len(n)), n)
            place = np.arange(int(n.sum())) - before[of]
            order, common = suffix_tree(h, w.firsts, w.firsts[of] + place, of)
            first = np.flatnonzero(np.append(True, common < window))  # each node's first leaf
            least = np.minimum.reduceat(owner[of[order]], first)
            lost = np.zeros(len(order), bool)
            lost[order] = owner[of[order]] > np.repeat(least, np.diff(np.append(first, len(order))))
            found = np.flatnonzero(np.bincount(of[lost], minlength=len(n)))
            counts = np.bincount(of[lost], minlength=len(n))[found]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(place[lost].astype(np.int32)))
            take = pa.array(found)
            yield pa.RecordBatch.from_arrays([table.column(0).combine_chunks().take(take), table.column(1).combine_chunks().take(take), lists], ["prefix", "block", "lost"])

    return run, "prefix long, block long, lost array<int>"


def _whole() -> Column:
    """Whether all windows of a member's block go."""
    return F.col("least_id") > F.col("owner")


def _lost(found: DataFrame, decided: DataFrame) -> DataFrame:
    """The members of ``found`` that lose windows, with the owner and lost windows of their block; both sides are tables, so Spark can split a block of many members."""
    return found.drop("content").join(decided, ["prefix", "block"]).filter(_whole() | F.col("lost").isNotNull())


def _decided(found: DataFrame, window: int, group: int) -> DataFrame:
    """prefix, block, owner, lost of each distinct block: all its windows are lost to others than the owner, and those in ``lost`` to the owner as well."""
    spark = found.sparkSession
    first = lambda *names: [F.first(n).alias(n) for n in names]
    blocks = written(found.groupBy("prefix", "block").agg(F.min("least_id").alias("owner"), *first("n", "anchor", "near", "far", "content")), "distinct-blocks")
    sizes = written(blocks.groupBy("prefix").agg(F.count("*").alias("size")).filter("size > 1"), "prefix-sizes")
    sized = blocks.join(sizes, "prefix")
    small = sized.filter(F.col("size") <= group).select("prefix", "block", "owner", "n", "content").repartition(partitions(spark), "prefix").sortWithinPartitions("prefix")
    lost = small.mapInArrow(*_subtrees(window))
    if not sizes.filter(F.col("size") > group).isEmpty():
        large = sized.filter(F.col("size") > group).select("prefix", "block", "owner", "n", "anchor", "near", "far", "content")
        halves = written(large.mapInArrow(*_halves(window)), "halves")
        starts = F.when(_whole(), F.sequence("at", F.col("at") + F.col("n") - 1)).otherwise(F.transform("lost", lambda x: x + F.col("at")))
        inner = _lost(halves, _decided(halves, window, group)).select(F.col("in_prefix").alias("prefix"), F.col("in_block").alias("block"), starts.alias("starts"))
        lost = lost.union(inner.groupBy("prefix", "block").agg(F.flatten(F.collect_list("starts")).alias("lost")))  # at most two halves of ``window`` windows together
    return written(blocks.select("prefix", "block", "owner").join(lost, ["prefix", "block"], "left"), "decided")


def _cut(window: int):
    """What is left of a class's text: its lost windows' words cut out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, texts, spans = [], [], []
            for text, cuts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                own = (text or "").encode().split()
                marks = np.zeros(len(own) + 1, np.int64)
                for cut in cuts:
                    starts, upto = cut["starts"], cut["upto"]
                    for s in starts if upto is None else range(starts[0], starts[0] + upto):
                        marks[s] += 1
                        marks[min(s + window, len(own))] -= 1
                gone = np.cumsum(marks[:-1]) > 0
                removed.append(int(gone.sum()))
                texts.append(b" ".join(x for x, g in zip(own, gone, strict=True) if not g))
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).tolist()
                spans.append([{"start": a, "words": z - a} for a, z in zip(edges[::2], edges[1::2], strict=True)])
            held = pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), held], ["c", "n_removed", "kept_text", "kept_sha256", "spans"])

    return run, "c binary, n_removed long, kept_text string, kept_sha256 string, spans array<struct<start:int,words:int>>"


def repeated_passages(docs: DataFrame, window: int = 50, group: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_words, n_removed, kept_sha256, kept_text (null: nothing removed), spans (start, words) of what goes, of every row."""
    own = keyed_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    rows = written(own.mapInArrow(*_scanned(window)), "scanned")
    rank = F.coalesce("doc_id", F.lit(_LEAST))
    classes = rows.filter(F.col("words_class").isNotNull()).groupBy(F.col("words_class").alias("c")).agg(F.min(rank).alias("least_id"), F.first("prefixes").alias("prefixes"))
    classes = written(classes, "word-classes")
    # Prefixes of at least two classes, then the classes that hold them.
    seen = classes.select("c", F.explode("prefixes").alias("prefix"))
    shared = written(seen.groupBy("prefix").agg(F.count("*").alias("n")).filter("n > 1").select("prefix"), "shared-prefixes")
    wanted = seen.join(shared, "prefix").groupBy("c").agg(F.collect_set("prefix").alias("wanted"))  # at most one a word of one document
    led = classes.drop("prefixes").join(wanted, "c")
    texts = led.join(own.select("doc_id", "text"), F.col("least_id") == F.coalesce(own["doc_id"], F.lit(_LEAST))).select("c", "least_id", "text", "wanted")

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = [hashlib.blake2b(_joined(t), digest_size=16).digest() == c for c, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield b.filter(pa.array(same, pa.bool_()))

    led = written(texts.mapInArrow(right, texts.schema).dropDuplicates(["c"]), "shared-texts")
    found = written(led.mapInArrow(*_blocks(window)), "blocks")
    # Every member of a block: all its windows if the block is led by a smaller key, else those lost.
    starts = F.when(_whole(), F.array("at")).otherwise(F.transform("lost", lambda x: x + F.col("at")))
    taken = _lost(found, _decided(found, window, group)).select("c", F.struct(starts.alias("starts"), F.when(_whole(), F.col("n")).alias("upto")).alias("cut"))
    taken = taken.groupBy("c").agg(F.collect_list("cut").alias("cuts"))  # the anchors of one document
    cut = led.select("c", "text").join(taken, "c").select("c", "text", "cuts").mapInArrow(*_cut(window))
    decided = written(classes.select("c", "least_id").join(cut, "c", "left"), "decided-texts")
    copy = rank > F.col("least_id")
    every = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("words")))
    out = rows.join(decided, rows["words_class"] == decided["c"]).select(
        "doc_id",
        "text_hash",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "words_sha256")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
        F.when(copy, every).otherwise(F.coalesce("spans", F.slice(every, 1, 0))).alias("spans"),
    )
    short = rows.filter(F.col("words_class").isNull())  # not joined: they would all have one key
    return out.union(short.select("doc_id", "text_hash", "n_words", F.lit(0).cast("long"), "words_sha256", F.lit(None).cast("string"), F.slice(every, 1, 0)))


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """``docs`` with their columns, repeated passages cut out of the texts; a text that loses nothing stays as it is, one that loses all is empty."""
    report = repeated_passages(docs, window, id_col=id_col, text_col=text_col).filter("n_removed > 0")
    changed = report.select(F.col("doc_id").alias("changed_id"), F.col("text_hash").alias("changed_hash"), F.col("kept_text").alias("new_text")).dropDuplicates(["changed_id", "changed_hash"])
    rows = docs.select(F.struct("*").alias("row"), column(docs, id_col).cast("long").alias("key"), F.xxhash64(F.coalesce(column(docs, text_col), F.lit(""))).alias("hash"))  # whatever the columns' names
    joined = rows.join(changed, F.col("key").eqNullSafe(F.col("changed_id")) & (F.col("hash") == F.col("changed_hash")), "left")
    old = lambda name: F.col("row").getField(name)
    swapped = {text_col: F.coalesce("new_text", old(text_col))}
    if chars_col:
        swapped[chars_col] = F.when(F.col("new_text").isNotNull(), F.length("new_text").cast(docs.schema[chars_col].dataType)).otherwise(old(chars_col))
    return joined.select(*(swapped.get(c, old(c)).alias(c) for c in docs.columns))
