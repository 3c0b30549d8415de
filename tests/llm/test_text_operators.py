"""Operators on documents against brute-force versions, on messy and empty tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pt = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(frame):
    return [(r["doc_id"], r["text"] or "", r["lang"]) for r in frame.select("doc_id", "text", "lang").collect()]


def ordered(rows):
    return sorted(rows, key=repr)


def test_words_kernel_matches_the_pattern(messy):
    import pyarrow as pa

    from docloom.llm._words import hashes, slices, words

    texts = [t for _, t, _ in rows_of(messy)]
    array = pa.array(texts)
    found, by_word = [], {}
    for a, b in slices(array, 2000):
        w = words(array.slice(a, b - a))
        h = hashes(w.data, w.starts, w.ends)
        for i in range(b - a):
            found.append([w.data[s:e].tobytes().decode() for s, e in zip(w.starts[w.firsts[i] : w.firsts[i + 1]], w.ends[w.firsts[i] : w.firsts[i + 1]], strict=True)])
        for s, e, x in zip(w.starts, w.ends, h, strict=True):
            assert by_word.setdefault(w.data[s:e].tobytes(), x) == x
    assert found == [WORD.findall(t) for t in texts]
    assert len(set(by_word.values())) == len(by_word)


def test_op8_base_counts(spark, messy, empty):
    from docloom.llm.quality_rules import quality_filter, quality_report

    expected = []
    for i, t, _ in rows_of(messy):
        w = WORD.findall(t)
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        marked = {j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(marked) > 50 * len(w)
        expected.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(marked), failed))
    got = quality_report(messy).collect()
    assert ordered(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in got) == ordered(expected)
    assert all(not r["kept"] for r in got if r["base_failed"])
    kept = quality_filter(messy)
    assert kept.columns == messy.columns and kept.count() == sum(r["kept"] for r in got)
    assert quality_report(empty).count() == 0 and quality_filter(empty).count() == 0


def test_op8_divergence(spark):
    from conftest import prose  # noqa: PLC0415

    from docloom.llm.quality_rules import jensen_shannon, quality_report

    rows = [(i, prose(i, 150), "en") for i in range(60)] + [(100, " ".join(f"zz{i}%%%" for i in range(150)), "en"), (101, "odd &&& " * 10, "en"), (102, "rare language text " * 30, "xx")]
    got = {r["doc_id"]: r for r in quality_report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[100]["kept"] and not got[100]["base_failed"] and sum(got[i]["kept"] for i in range(60)) == 60
    assert got[102]["chars_distance"] == 0
    assert jensen_shannon(np.array([[1.0, 0], [0.5, 0.5]]), np.array([0.0, 1])) == pytest.approx([1, math.sqrt(0.5 * (0.5 * 1 + 0.5 * math.log2(2 / 3) + math.log2(4 / 3)))])


def test_op8_verdicts_against_brute_force(spark, monkeypatch):
    """References, distances and verdicts of four languages, one of them small, counted word by word; with references handed out and joined."""
    from conftest import prose

    from docloom.llm import quality_rules as q

    rows = [(i, prose(i, 40 + 3 * i), "en") for i in range(50)] + [(100 + i, " ".join(f"zz{i * j}%%%" for j in range(60 + 30 * i)), ("en", "de", None)[i % 3]) for i in range(9)]
    rows += [(200 + i, prose(i, 90) + " 12 (ab) É! x#", "de") for i in range(9)] + [(300, "nur ein wort " * 30, "sv"), (301, "", None), (302, None, "en")]
    classes = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "".join(map(chr, range(33))), ".,:;!?'\"-", "()[]{}/\\_~`^@+=", "#*$%&|<>"]
    kind = {c: k for k, chars in enumerate(classes) for c in chars}
    chars, words_of = {}, {}
    for _, t, lang in rows:
        chars.setdefault(lang, Counter()).update(kind.get(c, 7) for c in t or "")
        words_of.setdefault(lang, Counter()).update(WORD.findall(t or ""))

    def distance(a, b, keys):
        p, r = (np.array([x[k] for k in keys], float) / max(sum(x.values()), 1) for x in (a, b))
        m = (p + r) / 2
        return math.sqrt(max(sum(x * math.log2(x / y) for x, y in zip([*p, *r], [*m, *m], strict=True) if x) / 2, 0))

    want = {}
    for i, t, lang in rows:
        total = sum(words_of[lang].values())
        common = {w for w, n in words_of[lang].items() if n * q.COMMON >= total}
        fold = lambda c, common=common: Counter({w: n for w, n in c.items() if w in common}) + Counter({"": sum(n for w, n in c.items() if w not in common)})
        own = Counter(WORD.findall(t or ""))
        n = sum(own.values())
        far = distance(Counter(kind.get(c, 7) for c in t or ""), chars[lang], range(8)), distance(fold(own), fold(words_of[lang]), [*sorted(common), ""])
        noise = [math.sqrt(sum(min(1, n * x / max(sum(c.values()), 1)) for x in c.values()) * (1 / max(n, 1) + 1 / max(total, 1)) / (8 * math.log(2))) for c in (chars[lang], fold(words_of[lang]))]
        want[i] = far, n >= 80 and (far[0] > 0.12 + 1.25 * noise[0] or far[1] > 0.15 + 1.25 * noise[1])
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for most in (1024, 1):
        monkeypatch.setattr(q, "MOST_LANGUAGES", most)
        got = {r["doc_id"]: r for r in q.quality_report(frame).collect()}
        for i, (far, diverges) in want.items():
            assert (got[i]["chars_distance"], got[i]["words_distance"]) == pytest.approx(far, abs=1e-9)
            assert got[i]["kept"] == (not diverges and not got[i]["base_failed"])
        kept = q.quality_filter(frame)
        assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {i for i in got if got[i]["kept"]}
    assert any(d for _, d in want.values()) and not any(d for i, (_, d) in want.items() if i in (100, 300))


def test_op7_components(spark, messy, empty):
    from docloom.llm.near_duplicates import keep_one, near_duplicate_classes

    rows = rows_of(messy)
    sets = []
    for _, t, _ in rows:
        w = WORD.findall(t.translate(FOLD))
        sets.append({tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                parent[find(a)] = find(b)
    groups: dict[int, list] = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {g: (min((x for x in v if x is not None), default=None)) for g, v in groups.items()}
    expected = [(rows[i][0], len(sets[i]), least[find(i)] if sets[i] else rows[i][0]) for i in range(len(rows))]
    # Small leaves and clusters take the branching, hub, chunk and rest paths too.
    for sizes in ({}, {"leaf": 2, "cluster": 2}, {"leaf": 1, "cluster": 1, "wide": 0}):
        got = near_duplicate_classes(messy, **sizes).collect()
        assert ordered((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == ordered(expected), sizes
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    # One row of each component stays; rows without words all stay.
    kept = keep_one(messy, size=4)
    first = {g: min((i is None, i or 0) for i in v) for g, v in groups.items() if sets[g]}
    want = sorted([*first.values(), *((rows[i][0] is None, rows[i][0] or 0) for i in range(len(rows)) if not sets[i])])
    assert kept.columns == messy.columns and sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == want
    assert near_duplicate_classes(empty).count() == 0 and keep_one(empty).count() == 0


def test_op7_keep_one_by_text(spark):
    from conftest import prose

    from docloom.llm.near_duplicates import keep_one

    a, u, v = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(1, a), (2, a), (2, u), (None, v), (None, prose(4, 60)), (None, v), (5, v + " tail"), (6, None), (6, "")]
    got = sorted(((r["doc_id"], r["text"]) for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(1, a), (2, u), (5, v + " tail"), (None, prose(4, 60)), (6, None), (6, "")], key=repr)


def test_op7_large_group_in_chunks(spark):
    import random

    from docloom.llm.near_duplicates import near_duplicate_classes

    rng = random.Random(2)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(80):
        w = list(base)
        for j in rng.sample(range(120), rng.choice([0, 1, 2, 3])):
            w[j] = f"e{i}_{j}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"{i}_{j}" for j in range(30))) for i in range(20)]
    f = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {r["doc_id"]: r["component_id"] for r in near_duplicate_classes(f).collect()}
    split = {r["doc_id"]: r["component_id"] for r in near_duplicate_classes(f, leaf=8, cluster=10).collect()}
    assert plain == split


def test_op7_near_copies_do_not_branch_again(spark, monkeypatch):
    """A large group of near copies, of which some lie far from any one member, takes about one row a class and tree, and its components are those of brute force."""
    import random

    from docloom.llm import near_duplicates as nd

    rng = random.Random(3)
    base, rows, sets = [f"b{i}" for i in range(150)], [], []
    for i in range(90):
        w = list(base)
        for j in rng.sample(range(150), rng.randint(0, 5)):
            w[j] = f"e{i}_{j}"
        rows.append((i, " ".join(w)))
        sets.append({tuple(w[k : k + 4]) for k in range(147)})
    least = list(range(90))
    for _ in range(12):
        for a in range(90):
            for b in range(90):
                n = len(sets[a] & sets[b])
                if least[b] < least[a] and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                    least[a] = least[b]
    met, plain = [], nd._candidates
    monkeypatch.setattr(nd, "_candidates", lambda classes, small, *a: met.append(small.count()) or plain(classes, small, *a))
    got = nd.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"), leaf=16, cluster=20)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == dict(enumerate(least))
    assert met[0] <= 2 * 10 * 90


def test_components_end_at_stars(spark, monkeypatch):
    import random

    from docloom.llm import _graph

    tables, plain = [], _graph.written
    monkeypatch.setattr(_graph, "written", lambda df, what: tables.append(what) or plain(df, what))
    rng = random.Random(5)
    stars = [(k, k + i) for k in range(0, 100, 10) for i in range(1, 10)]
    for links, most in ((stars, 2), ([(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(40)], 20), ([], 2)):
        tables.clear()
        got = {r["node"]: r["root"] for r in _graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
        root = {x: x for a, b in links if a != b for x in (a, b)}
        for _ in root:
            for a, b in links:
                if a != b:
                    root[a] = root[b] = min(root[a], root[b])
        assert got == root and len(tables) <= most, (links, tables)


def test_op10_windows(spark, messy, empty):
    from docloom.llm.substring_dedup import remove_repeats, repeated_passages

    rows = rows_of(messy)
    rank = lambda i: -(1 << 63) if i is None else i
    least: dict[tuple, int] = {}
    for i, t, _ in rows:
        w = WORD.findall(t)
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            least[key] = min(least.get(key, rank(i)), rank(i))
    expected = []
    for i, t, _ in rows:
        w = WORD.findall(t)
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if least[tuple(w[k : k + 50])] < rank(i):
                gone[k : k + 50] = [True] * 50
        expected.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    for group in (2048, 3, 1):
        got = repeated_passages(messy, group=group).collect()
        assert all(sum(x["words"] for x in r["spans"]) == r["n_removed"] for r in got)
        assert ordered((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == ordered(expected)
    cut = remove_repeats(messy, chars_col="n_chars")
    assert cut.columns == messy.columns and cut.count() == messy.count()
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect() if r["text"] is not None)
    assert repeated_passages(empty).count() == 0 and remove_repeats(empty).count() == 0


def test_op10_short_prefixes_are_split(spark):
    """A passage in many surroundings, and texts of few words: more blocks at a prefix than a group may have."""
    import random

    from docloom.llm.substring_dedup import repeated_passages, suffix_tree

    rng = random.Random(6)
    passage = [f"p{i}" for i in range(55)]
    rows = []
    for i in range(60):
        own = [f"v{rng.randrange(40)}" for _ in range(rng.randint(0, 70))]
        rows.append((i, " ".join(own[: len(own) // 2] + passage[rng.randint(0, 3) :] + own[len(own) // 2 :])))
    rows += [(100 + i, " ".join(rng.choice("ab") for _ in range(rng.randint(50, 300)))) for i in range(12)] + [(200 + i, "same " * rng.randint(49, 130)) for i in range(8)]
    least: dict = {}
    split = {i: t.split() for i, t in rows}
    for i, w in split.items():
        for k in range(len(w) - 49):
            least.setdefault(tuple(w[k : k + 50]), i)
    want = {}
    for i, w in split.items():
        gone = {j for k in range(len(w) - 49) if least[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        want[i] = [j for j in range(len(w)) if j in gone]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for group in (2048, 8, 1):
        got = repeated_passages(frame, group=group).collect()
        assert {r["doc_id"]: [j for x in r["spans"] for j in range(x["start"], x["start"] + x["words"])] for r in got} == want
    texts = [w.encode() for w in ("banana", "anan", "nab")]
    flat = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    firsts = np.cumsum([0] + [len(x) for x in texts])
    owner = np.repeat(np.arange(3), np.diff(firsts))
    order, common = suffix_tree(flat, firsts, np.arange(len(flat)), owner)
    suffixes = [texts[owner[j]][j - firsts[owner[j]] :] for j in range(len(flat))]
    for a, b, n in zip(order[:-1], order[1:], common, strict=True):
        shared = next((k for k, (x, y) in enumerate(zip(suffixes[a], suffixes[b], strict=False)) if x != y), min(len(suffixes[a]), len(suffixes[b])))
        assert n == shared and (suffixes[a][shared:] == b"" or suffixes[b][shared:] == b"" or suffixes[a] < suffixes[b])


def test_op1_backoff(spark, messy, empty):
    """Documents under the counts of other documents, with backoff over several orders; and the corpus under its own counts."""
    from docloom.llm.backoff_scores import backoff_scores, ngram_counts, whole_scores

    docs: dict = {}
    for i, t, _ in rows_of(messy):
        docs.setdefault(i, []).append(WORD.findall(t.translate(FOLD)))
    for known in (messy, messy.filter("doc_id < 8")):
        texts = [WORD.findall(t.translate(FOLD)) for _, t, _ in rows_of(known)]
        for order, least in ((1, 1), (2, 1), (3, 1), (3, 2)):
            table = Counter(tuple(w[j : j + k]) for w in texts for k in range(1, order + 1) for j in range(len(w) - k + 1))
            table[()] = sum(map(len, texts))

            def score(w, order=order, least=least, table=table):
                out = 0.0
                for j in range(len(w)):
                    longest = min(order, j + 1)
                    k = next(k for k in range(longest, 0, -1) if k == 1 or table[tuple(w[j - k + 1 : j + 1])] >= least)
                    gram = tuple(w[j - k + 1 : j + 1])
                    out += math.log(max(table[gram], 1) / max(table[gram[:-1]], 1)) + (longest - k) * math.log(0.4)
                return out

            results = [backoff_scores(messy, ngram_counts(known, order), order, least)]
            if known is messy and (order, least) == (2, 1):
                results.append(whole_scores(messy))
            for frame in results:
                got = {r["doc_id"]: r for r in frame.collect()}
                assert set(got) == set(docs)
                for i, parts in docs.items():
                    assert got[i]["n_words"] == sum(map(len, parts))
                    assert got[i]["log_score"] == pytest.approx(sum(map(score, parts)), rel=1e-9, abs=1e-9)
                    assert (got[i]["mean_log_score"] is None) == (got[i]["n_words"] == 0)
    assert whole_scores(empty).count() == 0 and backoff_scores(empty, ngram_counts(messy)).count() == 0
    assert backoff_scores(messy, ngram_counts(empty)).count() == len(docs)


def test_op1_scores_count_every_word(spark, messy, empty, tmp_path):
    """More distinct words than any fixed vocabulary holds, each seen twice and each in bigrams of its own."""
    from docloom.llm.queries import op1_backoff_scores

    n = 70_000
    lines = [" ".join(f"u{j}" for j in range(a, a + 1000)) for a in range(0, n, 1000)]
    rows = [(i, t, None, None) for i, t in enumerate(lines + lines)]
    many = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for k, frame in enumerate((many, messy)):
        docs: dict = {}
        for i, t, _ in rows_of(frame):
            docs.setdefault(i, []).append(WORD.findall(t.translate(FOLD)))
        every = [x for parts in docs.values() for x in parts]
        uni, pairs = Counter(w for x in every for w in x), Counter(p for x in every for p in zip(x, x[1:], strict=False))
        total = sum(uni.values())
        want = {i: sum(math.log(pairs[x[j - 1], w] / uni[x[j - 1]]) if j else math.log(uni[w] / total) for x in parts for j, w in enumerate(x)) for i, parts in docs.items()}
        frame.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        got = {r["doc_id"]: r for r in op1_backoff_scores(spark, f"{tmp_path}/{k}").collect()}
        assert set(got) == set(docs)
        for i, parts in docs.items():
            assert got[i]["n_words"] == sum(map(len, parts))
            assert got[i]["log_score"] == pytest.approx(want[i], abs=1e-6)
            assert (got[i]["mean_log_score"] is None) == (got[i]["n_words"] == 0)
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op1_backoff_scores(spark, f"{tmp_path}/none").count() == 0


def test_op1_scores_use_bigrams_seen_once(spark, tmp_path):
    from docloom.llm.queries import op1_backoff_scores

    spark.createDataFrame([(1, "a b a c"), (2, "b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["log_score"] for r in op1_backoff_scores(spark, str(tmp_path)).collect()}
    assert got == {1: pytest.approx(math.log(2 / 5) + math.log(1 / 2) + math.log(1 / 2) + math.log(1 / 2), abs=1e-6), 2: pytest.approx(math.log(2 / 5), abs=1e-6)}


def test_chunk_encoder_equals_the_library():
    import random

    from docloom.llm._bpe import ChunkEncoder

    rng = random.Random(4)
    texts = ["".join(rng.choice("abcDé ,.'\"\n\t \x1c²½3_-ßΣσ中文́≠ <|endoftext|>") for _ in range(rng.randint(0, 50))) for _ in range(3000)] + ["foo<|endoftext|> bar", "", None]
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        tool = ChunkEncoder(pt.path(name), spaced, cached=500)
        for a in range(0, len(texts), 300):  # over several generations of the cache
            ids, counts = tool.encode(texts[a : a + 300])
            want = [e.ids for e in tool.tokenizer.encode_batch_fast([t or "" for t in texts[a : a + 300]], add_special_tokens=False)]
            assert ids.tolist() == [i for x in want for i in x] and counts.tolist() == [len(x) for x in want]


def test_chunk_encoder_cuts_after_no_letter_that_joins_a_mark():
    """Every Latin letter before every ASCII mark, and U+0130 among others."""
    import random
    import string

    from docloom.llm._bpe import ChunkEncoder

    rng = random.Random(8)
    texts = [chr(c) + m for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250)) for m in string.punctuation]
    texts += ["".join(rng.choice("abİIı ,.'\"!é\n") for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        tool = ChunkEncoder(pt.path(name), spaced)
        ids, counts = tool.encode(texts)
        want = [e.ids for e in tool.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_op5_round_trip(spark, messy, empty):
    from tokenizers import Tokenizer

    from docloom.llm.token_shards import lookup, read_shards, write_shards

    tool = Tokenizer.from_file(pt.path("byte_bpe_50k.json"))
    want = ordered((i, tool.encode(t, add_special_tokens=False).ids + [2]) for i, t, _ in rows_of(messy))
    manifest = write_shards(messy, pt.path("byte_bpe_50k.json"), 2, shards=3, shard_bytes=4096)
    got = read_shards(manifest).collect()
    assert ordered((r["doc_id"], r["ids"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    keys = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert keys == sorted(keys, key=lambda k: -(1 << 70) if k is None else k)
    asked = spark.createDataFrame([(7,), (11,), (999,), (None,), (-5,)], "doc_id long")
    assert ordered((r["doc_id"], r["ids"]) for r in lookup(manifest, asked).collect()) == [x for x in want if x[0] in (7, 11, None, -5)]
    assert read_shards(write_shards(empty, pt.path("byte_bpe_50k.json"), 2)).count() == 0


def test_op2_pieces_and_packing(spark, messy, empty):
    from tokenizers import Tokenizer

    from docloom.llm.packing import cutting_stock, pack_documents

    tool = Tokenizer.from_file(pt.path("word_bpe_49k.json"))
    want = Counter()
    for i, t, _ in rows_of(messy):
        want[i, tuple(tool.encode(t, add_special_tokens=False).ids + [1])] += 1
    got = pack_documents(messy, pt.path("word_bpe_49k.json"), 1, capacity=256, unit=4).collect()
    by_sequence: dict = {}
    for r in got:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    whole = Counter()
    for (i, ids), n in want.items():
        for start in range(0, len(ids), 256):
            whole[i, start, ids[start : start + 256], len(ids)] += n
    assert Counter((r["doc_id"], r["start"], tuple(r["ids"]), r["doc_tokens"]) for r in got) == whole
    ideal = sum(len(ids) * n for (_, ids), n in want.items()) / 256
    assert len(by_sequence) <= ideal * 1.1 + 2
    assert pack_documents(empty, pt.path("word_bpe_49k.json"), 1).count() == 0
    patterns, amount, bound = cutting_stock(np.array([3, 5, 7]), np.array([10.0, 10, 10]), 15)
    assert (patterns @ np.array([3, 5, 7]) <= 15).all() and (amount @ patterns >= 10 - 1e-6).all() and amount.sum() == pytest.approx(bound, rel=1e-3)


def test_op3_spans(spark, messy, empty):
    import sentencepiece

    from docloom.llm.piece_spans import encode_decode

    tool = sentencepiece.SentencePieceProcessor(model_file=pt.path("piece_bpe_32k.model"))
    got = encode_decode(messy, pt.path("piece_bpe_32k.model")).collect()
    assert ordered((r["doc_id"], r["ids"], r["decoded"]) for r in got) == ordered((i, tool.encode(t), tool.decode(tool.encode(t))) for i, t, _ in rows_of(messy))
    texts = Counter((i, t) for i, t, _ in rows_of(messy))
    for r in got:
        if r["ids"]:
            assert r["begins"][0] == 0 and r["begins"][1:] == r["ends"][:-1] and any(r["ends"][-1] == len(t.encode()) for i, t in texts if i == r["doc_id"])
    assert encode_decode(empty, pt.path("piece_bpe_32k.model")).count() == 0


def test_op3_character_map():
    import struct

    from docloom.llm.piece_spans import CharacterMap, Model

    table = {b"ab": b"X", b"abc": b"YZ", b"\xc3\xa9": b"e", b" ": b"  "}
    # A double array by first fit: units of (offset, label), leaves of values.
    texts, values = bytearray(), {}
    for k, v in table.items():
        values[k] = len(texts)
        texts += v + b"\0"
    units, used = [0] * 4096, {0}

    def place(prefix: bytes, node: int) -> None:
        children = sorted({k[len(prefix)] for k in table if len(k) > len(prefix) and k.startswith(prefix)})
        leaf = prefix in table
        offset = next(o for o in range(1, 2048) if all((node ^ o ^ c) not in used for c in [*children, *([0] if leaf else [])]))
        units[node] |= offset << 10 | leaf << 8
        base = node ^ offset
        for c in [*children, *([0] if leaf else [])]:
            used.add(base ^ c)
        if leaf:
            units[base] = values[prefix] | 1 << 31
        for c in children:
            units[base ^ c] = c
            place(prefix + bytes([c]), base ^ c)

    place(b"", 0)
    raw = struct.pack(f"<{len(units)}I", *units)
    tree = CharacterMap(struct.pack("<I", len(raw)) + raw + bytes(texts))
    model = Model(map=tree, squeeze=False)
    assert model.normalise("abcab aé".encode()) == (b"\xe2\x96\x81YZX\xe2\x96\x81\xe2\x96\x81ae", pytest.approx([0, 0, 0, 0, 0, 3, 5, 5, 5, 5, 5, 5, 6, 7, 9]))
    assert Model(map=tree, squeeze=True).normalise(b"  ab ")[0] == b"\xe2\x96\x81X"


def test_op4_grades(spark, messy, empty):
    import random

    from conftest import prose

    from docloom.llm.ordinal_classifier import fit, fit_on, grade_documents, graded, keep_graded

    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        kind = rng.choice([0, 1, 2, 2, 2])
        t = prose(i, 80)
        if kind == 0:
            t = t.replace(" ", "%%% ")
        if kind == 1:
            t += " vile nasty awful"
        rows.append((i, t))
        if i < 600:
            labels.append((i, int(kind > 0), int(kind == 1)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels + [(5000, 1, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    model = fit_on(docs, table, graded(table))
    assert list(model.thresholds) == sorted(model.thresholds)
    got = {r["doc_id"]: r for r in grade_documents(docs, model).collect()}
    bad = lambda t: "%%%" in t or "vile" in t
    assert np.mean([got[i]["kept"] != bad(t) for i, t in rows if i >= 600]) > 0.97
    toxic = np.mean([got[i]["expected_grade"] for i, t in rows if i >= 600 and "vile" in t])
    junk = np.mean([got[i]["expected_grade"] for i, t in rows if i >= 600 and "%%%" in t])
    assert junk < toxic < 1.7
    scored = grade_documents(messy, model)
    assert scored.count() == messy.count() and not scored.filter("doc_id = 5").first()["kept"]
    assert keep_graded(messy, model).columns == messy.columns
    assert fit(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)) is None
    nothing = fit_on(empty, table, graded(table))
    assert nothing is None and all(r["kept"] and r["expected_grade"] is None for r in grade_documents(messy, nothing).collect())
    assert grade_documents(empty, model).count() == 0


def test_op3_spans_are_the_librarys(tmp_path):
    """Of the vocabulary as it is, and with compiled character maps and squeezed spaces put into it."""
    import random

    import sentencepiece

    from docloom.llm.piece_spans import Model, spans

    with open(pt.path("piece_bpe_32k.model"), "rb") as f:
        base = f.read()
    squeezed = bytes([0x1A, 2, 0x20, 1])  # a normaliser's field 4
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab cdéßﬁＡ①½㌔ \n\t　​ 日本ﾞｶ😀\U0001f9ffx.,12▁Å") for _ in range(rng.randint(0, 30))) for _ in range(400)] + ["", " ", "  a  b ", "a", "​", "①  "]
    maps = [b"", *(sentencepiece.SentencePieceNormalizer(rule_name=r).serialized_model_proto() for r in ("nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf"))]
    for k, extra in enumerate([*maps, *(m + squeezed for m in maps)]):
        path = tmp_path / f"{k}.model"
        path.write_bytes(base + extra)  # a later part of a message is merged into it
        tool, model = sentencepiece.SentencePieceProcessor(model_file=str(path)), Model.read(str(path))
        assert bool(model.map) == (k % 4 > 0) and model.squeeze == (k > 3)
        ids = [tool.encode(t) for t in texts]
        begin, end = spans(model, texts, ids)
        want = [(p.begin, p.end) for t in texts for p in tool.encode(t, return_type="proto").pieces]
        assert list(zip(begin.tolist(), end.tolist(), strict=True)) == want
