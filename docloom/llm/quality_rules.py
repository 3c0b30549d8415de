"""Quality rules: base counts of a document, and the divergence of its histograms from references of its language.

Two histograms are compared by Jensen-Shannon distance (base 2, 0 to 1): character classes, and common words. The
references are counted over *all* documents of a language. Its common words are all that make at least 1 / ``COMMON`` of its words, so there are at most ``COMMON`` of them; the others count as one.
A reference has at most ``COMMON`` + 9 numbers, whatever the corpus. References of up to ``MOST_LANGUAGES`` languages go to the tasks; those of more are joined to the documents by language.

Minimum-length guard: a document of fewer than ``min_words`` words is never rejected for its divergence (the base rule's bound is lower), and the bounds leave room for the
sampling noise of two histograms of n and N words: the distance to be expected is about sqrt(k * (1 / n + 1 / N) / (8 ln 2)), where k is the number of bins that n words fill, the sum of min(1, n p) over
the reference's shares p. So a short document or a small reference rejects little, by the same rule as long ones.

Defined results: null text or text without words has all counts 0, fails the base rules (fewer than 50 words) and is not kept. A null language is a language
of its own. Repeated rows and repeated keys are judged row by row; extra columns are passed over by the report and kept by the filter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import column, small_batches, written
from ._words import SPACE, chained, hashes, mix, per_document, slices, within, words

#: A common word makes at least one in so many words of its language.
COMMON = 500
MOST_LANGUAGES = 1024
_HELD = 1 << 21
#: Character classes by leading byte: lower case, upper case, digit, space, sentence mark, other mark, symbol, other scripts' letters.
_CLASS = np.full(256, 7, np.int64)
_CLASS[np.arange(0x61, 0x7B)] = 0
_CLASS[np.arange(0x41, 0x5B)] = 1
_CLASS[np.arange(0x30, 0x3A)] = 2
_CLASS[np.arange(0x00, 0x21)] = 3
_CLASS[[ord(c) for c in ".,;:!?'\"-"]] = 4
_CLASS[[ord(c) for c in "()[]{}/\\_~`^@+="]] = 5
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 6
_CLASS[np.arange(0x80, 0xC0)] = 8  # inside a character
CLASSES = 8
_SYMBOL = _CLASS == 6


@dataclass(frozen=True)
class Rules:
    min_words: int = 80
    #: Greatest distance of the character classes, and of the common words, and how much of the distance to be expected is added.
    chars_bound: float = 0.12
    words_bound: float = 0.15
    noise: float = 1.25


def _counted(texts: pa.Array) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    """For runs of rows: histograms (classes, word bins) and the words themselves."""
    for at, to in slices(texts):
        w = words(texts.slice(at, to - at))
        n = to - at
        kinds = _CLASS[w.data]
        owner = np.repeat(np.arange(n), np.diff(w.offsets))
        chars = np.bincount(owner * 9 + kinds, minlength=n * 9).reshape(n, 9)[:, :CLASSES]
        yield at, to, {"words": w, "hash": hashes(w.data, w.starts, w.ends), "chars": chars, "owner": owner}


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(keys, return_inverse=True)
    return found, np.bincount(place, weights=counts, minlength=len(found)).astype(np.int64)


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task by language: kind 0, character classes; 1, words by hash; 2, all words."""
    total: dict = {}
    held = 0

    def flush(names: list) -> Iterator[pa.RecordBatch]:
        for name in names:
            chars, keys, counts = total.pop(name)
            keys, counts = _summed(np.concatenate(keys), np.concatenate(counts))
            n = len(keys)
            kinds = np.repeat([0, 1, 2], [CLASSES, n, 1]).astype(np.int32)
            every = np.concatenate([np.arange(CLASSES), keys.view(np.int64), [0]])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(kinds), pa.string()), pa.array(kinds), pa.array(every), pa.array(np.concatenate([chars, counts, [counts.sum()]]).astype(np.int64))], ["lang", "kind", "key", "n"])

    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        for at, to, c in _counted(batch.column(1)):
            part, docs = langs[at:to], c["words"].docs()
            for name in dict.fromkeys(part):
                mine = np.array([x == name for x in part])
                keys, counts = np.unique(c["hash"][mine[docs]], return_counts=True)
                chars, all_keys, all_counts = total.setdefault(name, (np.zeros(CLASSES, np.int64), [], []))
                chars += c["chars"][mine].sum(axis=0)
                all_keys.append(keys)
                all_counts.append(counts)
                held += len(keys)
            if held > _HELD:
                for name, (chars, keys, counts) in total.items():
                    k, n = _summed(np.concatenate(keys), np.concatenate(counts))
                    total[name] = chars, [k], [n]
                held = sum(len(k[0]) for _, k, _ in total.values())
                if held > _HELD // 2:
                    yield from flush(list(total))
                    held = 0
    yield from flush(list(total))


def language_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts over all documents, one row a language: lang, chars (by class), keys (hashes of its common words) and counts, words (all)."""
    part = docs.select(column(docs, lang_col).cast("string").alias("lang"), column(docs, text_col).alias("text"))
    sums = written(part.mapInArrow(_histograms, "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")), "histograms")
    words_of = sums.filter("kind = 2").select(F.col("lang").alias("of_lang"), F.col("n").alias("words"))
    if words_of.count() <= MOST_LANGUAGES:
        words_of = F.broadcast(words_of)
    common = sums.filter("kind = 1").join(words_of, F.col("lang").eqNullSafe(F.col("of_lang"))).filter(F.col("n") * COMMON >= F.col("words")).select("lang", "kind", "key", "n")
    kept = common.union(sums.filter("kind <> 1").select("lang", "kind", "key", "n"))
    of = lambda kind, what: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("key", "n")))), lambda x: x[what])
    return kept.groupBy("lang").agg(of(0, "n").alias("chars"), of(1, "key").alias("keys"), of(1, "n").alias("counts"), F.max(F.when(F.col("kind") == 2, F.col("n"))).alias("words"))


def _reference(chars: list[int], keys: list[int], counts: list[int], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Class shares, common words' hashes (ascending) and their shares (the last: all other words), and the number of words."""
    hashed = np.array(keys, np.int64).view(np.uint64)
    order = np.argsort(hashed)
    counts = np.array(counts, float)[order]
    shares = np.append(counts, words - counts.sum())
    chars = np.array(chars, float)
    return chars / max(chars.sum(), 1), hashed[order], shares / max(words, 1), words


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (the square root of the divergence in bits) of each row of ``p`` from ``q``."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def expected(shares: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """The distance that sampling alone is expected to make, between histograms of ``n`` and ``size`` words."""
    filled = np.minimum(1, n[:, None] * shares).sum(axis=1)
    return np.sqrt(filled * (1 / np.maximum(n, 1) + 1 / max(size, 1)) / (8 * np.log(2)))


def _judged(texts: pa.Array, langs: list, table: dict, rules: Rules) -> dict[str, np.ndarray]:
    parts: list[dict[str, np.ndarray]] = []
    for at, to, c in _counted(texts):
        w, h, n = c["words"], c["hash"], to - at
        docs, n_words = w.docs(), w.counts
        first = within(w, 3)
        repeated = np.zeros(len(h), bool)
        if len(first):
            keys = mix(chained(h, 3)[first] ^ (docs[first].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
            order = np.argsort(keys)
            same = keys[order][1:] == keys[order][:-1]
            twice = np.zeros(len(keys), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            for j in range(3):
                repeated[first[twice] + j] = True
        lines = []
        for text in texts.slice(at, n).to_pylist():
            seen: set[str] = set()
            dup = 0
            for line in (text or "").split("\n"):
                if line in seen:
                    dup += 1
                elif line.strip(" \t\n\r\x0b\x0c"):
                    seen.add(line)
            lines.append(dup)
        out = {
            "n_words": n_words.astype(np.int64),
            "word_chars": per_document(((w.data & 0xC0) != 0x80) & ~SPACE[w.data], w.offsets),
            "n_symbols": per_document(_SYMBOL[w.data], w.offsets),
            "n_dup_lines": np.array(lines, np.int64),
            "n_repeat_words": per_document(repeated, w.firsts),
            "chars_distance": np.zeros(n),
            "words_distance": np.zeros(n),
            "chars_noise": np.zeros(n),
            "words_noise": np.zeros(n),
        }
        part = langs[at:to]
        for name in dict.fromkeys(part):
            if (ref := table.get(name)) is None:
                continue
            mine = np.array([x == name for x in part])
            chars, common, shares, size = ref
            own_words = mine[docs]
            own, of = h[own_words], docs[own_words]
            place = np.minimum(np.searchsorted(common, own), max(len(common) - 1, 0))
            place = np.where(common[place] == own, place, len(common)) if len(common) else np.zeros(len(own), np.int64)
            counts = np.bincount(of * (len(common) + 1) + place, minlength=n * (len(common) + 1)).reshape(n, -1)[mine]
            kinds = c["chars"][mine]
            out["chars_distance"][mine] = jensen_shannon(kinds / np.maximum(kinds.sum(axis=1, keepdims=True), 1), chars)
            out["words_distance"][mine] = jensen_shannon(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1), shares)
            out["chars_noise"][mine] = expected(chars, n_words[mine], size)
            out["words_noise"][mine] = expected(shares, n_words[mine], size)
        parts.append(out)
    if not parts:
        empty = np.zeros(0, np.int64)
        parts = [{k: empty for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} | {k: np.zeros(0) for k in ("chars_distance", "words_distance", "chars_noise", "words_noise")}]
    out = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    n = out["n_words"]
    over = lambda what, bound: out[f"{what}_distance"] > bound + rules.noise * out.pop(f"{what}_noise")
    diverges = (over("chars", rules.chars_bound) | over("words", rules.words_bound)) & (n >= rules.min_words)
    out["base_failed"] = (n < 50) | (100 * out["n_repeat_words"] > 50 * n)
    out["kept"] = ~out["base_failed"] & ~diverges
    return out


_REPORT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars_distance double, words_distance double, base_failed boolean, kept boolean"


def _with_references(docs: DataFrame, text: str, lang: str, rules: Rules) -> tuple[DataFrame, Callable]:
    """``docs``, with references beside them where there are too many languages to hand out, and a function that judges a batch of it."""
    references = written(language_references(docs, text, lang), "references")
    text_at, lang_at, width = docs.columns.index(text), docs.columns.index(lang), len(docs.columns)
    names = lambda b: [x if x is None else str(x) for x in b.column(lang_at).to_pylist()]
    if references.count() <= MOST_LANGUAGES:
        table = {r["lang"]: _reference(r["chars"], r["keys"], r["counts"], r["words"]) for r in references.collect()}
        return docs, lambda b: _judged(b.column(text_at), names(b), table, rules)
    own = references.select(F.struct("chars", "keys", "counts", "words").alias("__reference"), F.col("lang").alias("__lang"))

    def judge(b: pa.RecordBatch) -> dict[str, np.ndarray]:
        langs = names(b)
        first = {lang: i for i, lang in reversed(list(enumerate(langs)))}
        return _judged(b.column(text_at), langs, {lang: _reference(**r) for lang, i in first.items() if (r := b.column(width)[i].as_py()) is not None}, rules)

    key = column(docs, lang).cast("string")
    return docs.join(own, key.eqNullSafe(own["__lang"]), "left").drop("__lang"), judge


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """One row per document with its counts, distances and verdict."""
    small_batches(docs.sparkSession)
    part = docs.select(column(docs, id_col).alias("doc_id"), column(docs, text_col).alias("text"), column(docs, lang_col).cast("string").alias("lang"))
    rows, judge = _with_references(part, "text", "lang", rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = judge(b)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x) for x in out.values())], ["doc_id", *out])

    return rows.mapInArrow(run, f"doc_id {part.schema['doc_id'].dataType.simpleString()}, {_REPORT}")


def quality_filter(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    small_batches(docs.sparkSession)
    rows, judge = _with_references(docs, text_col, lang_col, rules)
    width = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = b.filter(pa.array(judge(b)["kept"]))
            yield kept if b.num_columns == width else kept.select(range(width))

    return rows.mapInArrow(run, docs.schema)
