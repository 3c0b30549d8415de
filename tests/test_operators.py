"""Operators against brute force and stated behaviour."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import export, filters, library, matching, ranking, terms
from docloom.schema import SearchQuery, parameters


def test_cursor_and_parameters():
    assert filters.decode_cursor(filters.encode_cursor(40)) == 40
    assert filters.decode_cursor("garbage!") == 0 and filters.decode_cursor(None) == 0 and filters.decode_cursor(filters.encode_cursor(10**9)) == 100_000
    q = parameters({"q": "x", "states": "inbox,nonsense", "limit": "9999", "starred": "1", "min_score": "x"})
    assert q.states == ("inbox",) and q.limit == 200 and q.starred and q.min_score is None and q.resolved_sort == "relevance"


def test_rejection(spark):
    f = spark.createDataFrame([("https://a", "a long enough title", "me"), ("x", "t", "me"), ("https://a", "", "me"), ("https://a", "short", "me"), ("https://a", "a casino advert here", "me"), ("https://a", "a long enough title", "@Spam")], "url string, title string, handle string")
    f = f.withColumns({"summary": F.lit(None).cast("string"), "content": F.lit(None).cast("string"), "media": F.lit(None).cast("array<string>")})
    reason = filters.rejection({c: F.col(c) for c in f.columns}, ("Casino",), ("spam",))
    assert [r[0] for r in f.select(reason).collect()] == [None, "missing url", "no text", "too short", "muted keyword: casino", "muted author"]


def test_band_pairs_find_all_within_three_bits(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    values = [base, base, 0, 0] + [base ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (1, 2, 3, 3, 4, 8)] + [rng.getrandbits(64) for _ in range(40)]
    rows = [(i, f"{v:016x}") for i, v in enumerate(values)]
    found = matching.band_pairs(spark.createDataFrame(rows, "id long, simhash string")).collect()
    expected, first = set(), {}
    for i, v in enumerate(values):
        if v and v in first:
            expected.add((first[v], i, 0))
        first.setdefault(v, i)
    lead = sorted((i, v) for v, i in first.items() if v)
    expected |= {(i, j, (v ^ w).bit_count()) for i, v in lead for j, w in lead if i < j and (v ^ w).bit_count() <= 3}
    assert {(r["a"], r["b"], r["distance"]) for r in found} == expected


def test_fingerprints_meet_by_shuffles(spark):
    """A stored table that looks small isn't sent through the driver: each class is twenty rows of the join."""
    rows = matching.saved(spark.createDataFrame([(i, f"{i << 7 | 1:016x}") for i in range(64)], "id long, simhash string"))
    plan = matching.band_pairs(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan
    assert {(r["a"], r["b"]) for r in matching.band_pairs(rows).collect()} == {(a, b) for a in range(64) for b in range(a + 1, 64) if (a ^ b).bit_count() <= 3}


def test_first_come(spark):
    rng = random.Random(5)
    n = 40
    edges = [(a, b, rng.randint(1, 5)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.08]
    near = {}
    for a, b, w in edges:
        near.setdefault(b, []).append((w, a))
    expected = {}
    for i in range(n):
        earlier = [(w, a) for w, a in near.get(i, []) if expected[a] is None]
        expected[i] = min(earlier)[1] if earlier else None
    nodes = spark.createDataFrame([(i, i) for i in range(n)], "id long, seq long")
    got = matching.first_come(nodes, spark.createDataFrame([(b, a, w) for a, b, w in edges], "a long, b long, weight long"))
    assert {r["id"]: r["duplicate_of"] for r in got.collect()} == expected


def test_first_come_compares_every_copy(spark):
    """Copies of a text that is near an earlier one, in an order of arrival that is not that of the identifiers, with links besides."""
    rng = random.Random(11)
    base = rng.getrandbits(64)
    kinds = [base, base ^ 3, base ^ 3 ^ (7 << 20), base ^ (15 << 40), 0, *(rng.getrandbits(64) for _ in range(3))]
    rows = [(i, s, kinds[k]) for (i, k), s in zip([(9, 0), (2, 1), (3, 1), (4, 1), *((10 + i, rng.randrange(len(kinds))) for i in range(60))], range(64), strict=True)]
    edges = [(a, b, 10.5) for a, b in ((rng.choice(rows)[0], rng.choice(rows)[0]) for _ in range(12)) if a != b]
    for links in ([], edges):
        expected: dict = {}
        done: list = []
        for i, _, v in rows:  # in the order of arrival
            found = [((v ^ w).bit_count(), j) for j, w in done if v and w and (v ^ w).bit_count() <= 3 and expected[j] is None]
            found += [(weight, j) for j, _ in done for a, b, weight in links if {a, b} == {i, j} and expected[j] is None]
            expected[i] = min(found)[1] if found else None
            done.append((i, v))
        nodes = spark.createDataFrame([(i, s, f"{v:016x}") for i, s, v in rows], "id long, seq long, simhash string")
        got = matching.first_come(nodes.select("id", "seq"), spark.createDataFrame(links, "a long, b long, weight double"), nodes.select("id", "simhash"))
        assert {r["id"]: r["duplicate_of"] for r in got.collect()} == expected
    assert [expected[i] for i in (9, 2, 3, 4)] == [None, 9, 9, 9]


def test_ingestion_folds_copies_near_an_earlier_text(spark):
    from docloom.plans.ingestion import duplicates

    a, b = f"{0xABCDEF0123456789:016x}", f"{0xABCDEF0123456789 ^ 3:016x}"
    rows = [("9", 0, a), ("2", 1, b), ("3", 2, b), ("4", 3, b)]
    items = spark.createDataFrame([(i, s, i, h, [1.0, 0.0], [], 0, 0) for i, s, h in rows], "id string, seq long, url_hash string, simhash string, embedding array<float>, entities array<struct<name:string,type:string>>, published_ms long, captured_ms long")
    assert {r["id"]: r["duplicate_of"] for r in duplicates(items).collect()} == {"9": None, "2": "9", "3": "9", "4": "9"}


def test_window_pairs(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice("ab"), rng.randint(0, 1000)) for i in range(60)]
    f = spark.createDataFrame(rows, "id long, k string, at long")
    got = {(r["a"], r["b"]) for r in matching.window_pairs(f, f, "k", "at", 50).collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and a[1] == b[1] and abs(a[2] - b[2]) <= 50}


def test_nearest_vectors_and_floor(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(50, 8))
    f = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<float>")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    got = ranking.nearest_vectors(f, f.filter("id < 5"), 3, block_rows=2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"]) for r in got] == [(q, int(i)) for q in range(5) for i in np.argsort(-sims[q])[:3]]
    assert ranking.nearest_vectors(f, f.filter("id < 5"), 3, floor=1.5).count() == 0


def test_query_compiler():
    C = ranking.Clause
    assert ranking.compile_query('"exact phrase" go spark') == [C([("exact", "phrase")]), C([("go",)]), C([("spark",)], True)]
    assert ranking.compile_query("gpt-5") == [C([("gpt", "5")], True)]
    assert ranking.compile_query("怎么降低推理成本") == [C([("降低", "低推", "推理"), ("推理", "理成", "成本")])]
    assert ranking.compile_query('") OR *') in ([], [C([("or",)])])
    assert ranking.compile_query("") == []
    assert ranking.highlight_terms('the "big cat" spark 推理') == ["big cat", "spark", "推理"]


def documents(spark, rows):
    f = spark.createDataFrame([(str(i), t) for i, t in enumerate(rows)], "id string, t string")
    empty = F.array().cast("array<string>")
    from docloom.functions.text import cjk_bigrams

    return f.select("id", empty.alias("title"), ranking.fold_tokens(F.col("t")).alias("body"), empty.alias("author"), empty.alias("tags"), cjk_bigrams(F.col("t")).alias("cjk"))


def test_keyword_search(spark):
    d = documents(spark, ["The GPT-5 release", "gpt and 5 apart: gpt x 5", "Café crème", "怎样降低模型推理成本", "unrelated"])
    ids = lambda q, **k: [r["id"] for r in ranking.keyword_search(d, q, 10, **k).orderBy("rank").collect()]
    assert ids("gpt-5") == ["0"]
    assert ids("cafe") == ["2"]
    assert ids("推理成本") == ["3"]
    assert ids("gpt unrelated") == [] and set(ids("gpt unrelated", relax=True)) == {"0", "1", "4"}


def test_fusion_and_diversity(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, rank int")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "id string, rank int")
    r = ranking.reciprocal_rank_fusion({"keyword": a, "semantic": b}).collect()
    assert [x["id"] for x in r] == ["y", "x", "z"] and [x["matched_by"] for x in r] == ["both", "keyword", "semantic"]
    v = np.array([[1.0, 0], [0.99, 0.05], [0, 1.0]])
    assert ranking.maximal_marginal_relevance(np.array([1.0, 0.95, 0.6]), v, 0.5, 2) == [0, 2]
    assert ranking.maximal_marginal_relevance(np.array([1.0, 0.95, 0.6]), v, 1.0, 2) == [0, 1]
    assert ranking.interleave(list("aaab"), lambda x: x) == list("aaba")


def test_shared_terms_and_last_wins(spark):
    a = spark.createDataFrame([(1, ["x", "y", "y"]), (2, ["z"])], "id int, tokens array<string>")
    assert [tuple(r) for r in terms.shared_terms(a, a, 0.5).orderBy("a").collect()] == [(1, 1, 1.0), (2, 2, 1.0)]
    f = spark.createDataFrame([("u", 1), ("u", 3), ("v", 2)], "k string, n int")
    assert {tuple(r) for r in matching.last_wins(f, ["k"], [F.desc("n")]).collect()} == {("u", 3), ("v", 2)}


def test_shared_terms_make_no_rows_below_the_bound(spark, monkeypatch):
    """Against plain sets, with null and empty lists, in one pass and in several; pairs that share too little aren't shuffled."""
    rng = random.Random(8)
    some = lambda n: [[rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(0, 9))] for _ in range(n)]
    left, right = list(enumerate([*some(120), None, ["z", None]])), [(f"r{i}", t) for i, t in enumerate([*some(30), None, ["z", None]])]
    frames = spark.createDataFrame(left, "id long, tokens array<string>"), spark.createDataFrame(right, "id string, tokens array<string>")
    want = set()
    for (a, s), (b, t) in ((x, y) for x in left for y in right if x[1] and y[1]):
        shared = (set(s) & set(t)) - {None}
        if shared and len(shared) / len(set(s) | set(t)) >= 0.3 and None not in (*s, *t):
            want.add((a, b, len(shared) / len(set(s) | set(t))))
    nulls = {(121, "r31", 1 / 3)}  # an unknown token counts on both sides and is shared by none
    for per_pass in (terms.PER_PASS, 20):
        monkeypatch.setattr(terms, "PER_PASS", per_pass)
        pairs = terms.shared_terms(*frames, 0.3)
        got = {tuple(r) for r in pairs.collect()}
        assert {r for r in got if r[0] != 121 and r[1] != "r31"} == want and nulls <= got
        assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert terms.shared_terms(frames[0], frames[1].limit(0), 0.3).count() == 0



def test_library(spark):
    from docloom.schema import COLLECTION_ITEM, SOURCE

    members = spark.createDataFrame([("c", "i1", 1.0, "old", 5)], COLLECTION_ITEM)
    added = spark.createDataFrame([("c", "i1", None, 9), ("c", "i2", "n", 9), ("d", "i1", None, 9)], "collection_id string, item_id string, note string, added_ms long")
    got = {(r["collection_id"], r["item_id"]): (r["position"], r["note"]) for r in library.add_to_collection(members, added).collect()}
    assert got == {("c", "i1"): (1.0, "old"), ("c", "i2"): (2.0, "n"), ("d", "i1"): (1.0, None)}
    assert library.stored_query("{broken") == SearchQuery()
    assert library.stored_query('{"q": "x", "tags": ["a"], "unknown": 1}').tags == ("a",)
    sources = spark.createDataFrame([("s", "rss", "http://f?a=1&b", 'A "b"', True, 60, 1.0, None, [], [], [], 0, 0, None)], SOURCE)
    assert library.due(sources, 60_000).count() == 1 and library.due(sources, 59_999).count() == 0
    assert 'text="A &quot;b&quot;"' in export.opml(sources).first()["opml"] and "a=1&amp;b" in export.opml(sources).first()["opml"]
    ran = library.record_run(sources, spark.createDataFrame([("s", 70, 3, "late")], "id string, ran_ms long, added long, error string")).first()
    assert (ran["last_run_ms"], ran["items_total"], ran["last_error"]) == (70, 3, "late")


def test_csv_escape(spark):
    f = spark.createDataFrame([('a,"b"',), ("plain",), (None,)], "t string")
    assert [r[0] for r in f.select(export.csv_escape(F.col("t"))).collect()] == ['"a,""b"""', "plain", ""]


@pytest.mark.parametrize("days", [1, 10, 365])
def test_buckets(days):
    from docloom.operators.analytics import bucket_count, bucket_size

    assert bucket_size(0, days * 86_400_000, bucket_count(days)) >= 3_600_000


def test_index_finds_what_a_scan_finds(spark):
    rows = [(f"d{i}", [w for w in ("red blue green vector search index " * (i % 3 + 1)).split()][i % 4 :], ["tag", f"t{i % 2}"]) for i in range(12)] + [("d12", [], [])]
    documents = spark.createDataFrame(rows, "id string, body array<string>, tags array<string>")
    columns = {"body": 1.0, "tags": 4.0}
    index = ranking.build_index(documents, columns)
    for q in ("vector", '"vector search"', '"search vector"', "vec gre", '"blue green" t1', "zzz green", "zzz"):
        for relax in (False, True):
            want = [(r["id"], round(r["score"], 9), r["rank"]) for r in ranking.keyword_search(documents, q, 8, relax, columns).collect()]
            assert [(r["id"], round(r["score"], 9), r["rank"]) for r in ranking.indexed_search(index, q, 8, relax).collect()] == want
    assert ranking.indexed_search(index, '"search vector"', 8).count() == 0 < ranking.indexed_search(index, '"vector search"', 8).count()
    assert ranking.indexed_search(ranking.build_index(documents.limit(0), columns), "vector", 8).count() == 0


def _greedy(rows, links):
    """Items (id, seq, fingerprint) in the order of arrival, each against all that came before."""
    expected, done = {}, []
    for i, _, v in sorted(rows, key=lambda r: (r[1], r[0])):
        found = [((v ^ w).bit_count(), j) for j, w in done if v and w and (v ^ w).bit_count() <= 3 and expected[j] is None]
        found += [(weight, j) for j, _ in done for a, b, weight in links if {a, b} == {i, j} and expected[j] is None]
        expected[i] = min(found)[1] if found else None
        done.append((i, v))
    return expected


def _first_come(spark, rows, links, **more):
    nodes = spark.createDataFrame([(i, s, f"{v:016x}") for i, s, v in rows], "id long, seq long, simhash string")
    got = matching.first_come(nodes.select("id", "seq"), spark.createDataFrame(links, "a long, b long, weight double"), nodes.select("id", "simhash"), **more)
    return {r["id"]: r["duplicate_of"] for r in got.collect()}


def test_first_come_over_a_long_chain(spark, monkeypatch):
    """A chain of 200, each three bits from the next: as many tables as for a chain of 8, but for rounds that grow with its logarithm."""
    import time

    from docloom.operators import graphs

    def chain(n):
        out, v = [], 0x123456789ABCDEF0
        for i in range(n):
            out.append((i, i, v))
            for b in range(3):
                v ^= 1 << (3 * i + b) % 64 if i % 64 < 21 else 1 << (7 * i + 11 * b) % 64
        return out

    tables = []
    for module in (matching, graphs):
        keep = module.saved
        monkeypatch.setattr(module, "saved", lambda df, keep=keep: (tables.append(1), keep(df))[1])
    links = [(i, i + 1, 10.5) for i in range(0, 199)]
    counts = []
    for n in (8, 200):
        tables.clear()
        began = time.perf_counter()
        rows = chain(n)
        assert _first_come(spark, rows, [x for x in links if x[1] < n]) == _greedy(rows, [x for x in links if x[1] < n])
        assert time.perf_counter() - began < 60
        counts.append(len(tables))
    assert counts[1] <= counts[0] + 12 and counts[1] <= 32, counts


def test_first_come_joins_by_shuffles(spark, monkeypatch):
    """Stored tables that look small aren't sent through the driver: a class is twenty rows of some joins."""
    from docloom.operators import graphs

    rows = [(i, 0, i // 2 << 7 | 1) for i in range(24)]
    stored = matching.saved(spark.createDataFrame([(i, s, f"{v:016x}") for i, s, v in rows], "id long, seq long, simhash string"))
    plans, plan = [], lambda df: df._jdf.queryExecution().executedPlan().toString()
    for module in (matching, graphs):
        keep = module.saved
        monkeypatch.setattr(module, "saved", lambda df, keep=keep: (plans.append(plan(df)), keep(df))[1])
    got = matching.first_come(stored.select("id", "seq"), fingerprints=stored.select("id", "simhash"))
    plans.append(plan(got))
    assert sum(p.count("SortMergeJoin") for p in plans) > 10 and not [p for p in plans if "Broadcast" in p]
    assert {r["id"]: r["duplicate_of"] for r in got.collect()} == _greedy(rows, [])


def test_first_come_components_over_the_bound(spark):
    """The same result by components and in rounds, with hot classes, links, and equal times."""
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    rows = [(i, rng.randrange(25), rng.choice(base) ^ (rng.choice([0, 0, 1, 3, 7, 96, 15 << 30]))) for i in range(90)] + [(100 + i, 30, base[0]) for i in range(30)] + [(200, 1, 0), (201, 2, 0)]
    links = [(a, b, 10.5) for a, b in ((rng.choice(rows)[0], rng.choice(rows)[0]) for _ in range(25)) if a != b]
    want = _greedy(rows, links)
    with pytest.raises(ValueError, match="at least"):
        _first_come(spark, rows, links, most_rows=0)
    for most_rows in (200_000, 40):
        assert _first_come(spark, rows, links, most_rows=most_rows) == want
