"""Column functions against their stated behaviour."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.functions import display, lexicon, scoring, similarity, text, urls


def one(spark, column, **values):
    """The value of ``column`` over one row of ``values``."""
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items()))
    return frame.select(column.alias("x")).first()["x"]





@pytest.mark.parametrize(
    ("given", "pairs"), [("大模型推理", ["大模", "模型", "型推", "推理"]), ("a 猫 b", ["猫"]), ("", []), (None, []), ("推理x成本", ["推理", "成本"])]
)
def test_cjk_bigrams(spark, given, pairs):
    assert one(spark, text.cjk_bigrams(F.col("t")), t=given) == pairs


def test_tokenize(spark):
    assert one(spark, text.tokenize(F.col("t")), t="The GPT-5 model, like C++ and 模型推理!") == ["gpt-5", "model", "c++", "模型", "型推", "推理"]
    assert one(spark, text.tokenize(F.col("t"), keep_stopwords=True), t="the cat") == ["the", "cat"]
    assert one(spark, text.tokenize(F.col("t")), t=None) == []


@pytest.mark.parametrize(("given", "lang"), [("hello there", "en"), ("これはペンです", "ja"), ("안녕하세요", "ko"), ("这是中文文本", "zh"), ("привет мир", "ru"), ("", "und"), ("12345", "und"), (None, "und")])
def test_detect_lang(spark, given, lang):
    assert one(spark, text.detect_lang(F.col("t")), t=given) == lang


def test_reading_time(spark):
    assert one(spark, text.reading_time_sec(F.col("t")), t="word " * 238) == 60
    assert one(spark, text.reading_time_sec(F.col("t")), t="hi") == 5
    assert one(spark, text.reading_time_sec(F.col("t")), t="  ") == 0


def test_html_to_text(spark):
    html = "<style>x</style><p>A &amp; B<br>c</p><script>no()</script><!-- no --><div>d&#65;</div>"
    assert one(spark, text.html_to_text(F.col("t"), numeric_references=True), t=html) == "A & B\nc\n\ndA"
    assert one(spark, text.html_to_text(F.col("t")), t=None) == ""


def test_truncate_and_excerpt(spark):
    assert one(spark, text.truncate(F.col("t"), 11), t="hello brave world") == "hello brave…"
    assert one(spark, text.truncate(F.col("t"), 3), t="模型推理") == "模型推…"
    assert one(spark, text.truncate(F.col("t"), 50), t="short") == "short"
    assert one(spark, text.excerpt(F.col("t")), t="# Head\n**bold** [link](http://x) ![i](u)") == "Head bold link"


def test_noise(spark):
    bait = one(spark, text.noise(F.col("t")), t="RT this and follow me!!!!! Free course, DM me. 10 tools that you need. #a #b #c #d #e #f")
    plain = one(spark, text.noise(F.col("t")), t="We measured throughput on the new cluster and describe the methodology.")
    assert bait["score"] > 0.8 and {"follow-bait", "giveaway", "listicle-bait", "hashtag-stuffing", "exclamatory"} <= set(bait["reasons"])
    assert plain["score"] == 0 and plain["reasons"] == []
    assert one(spark, text.noise(F.col("t")), t="模型 follow me模型")["score"] == pytest.approx(0.3)


def test_snippet_and_highlight(spark):
    assert one(spark, text.snippet(F.col("t"), ["needle"], 5), t="a haystack with a needle inside it") == "…th a needl…"
    assert one(spark, text.highlighted(F.col("t"), ["ab", "abc"]), t="xABCab") == "x<mark>ABC</mark><mark>ab</mark>"


@pytest.mark.parametrize(("given", "n"), [("1.2K", 1200), ("3.4M", 3_400_000), ("5B", 5_000_000_000), ("1,234", 1234), ("1.2万", 12_000), ("3亿", 300_000_000), ("10+", 10), ("many", None), (None, None)])
def test_parse_compact(spark, given, n):
    assert one(spark, text.parse_compact(F.col("t")), t=given) == n


def test_keywords_and_summary(spark):
    found = one(spark, text.keywords(F.col("t"), 3), t="shuffle shuffle shuffle partition partition join")
    assert [k["term"] for k in found] == ["shuffle", "partition", "join"] and found[0]["weight"] == 1
    long = "Shuffle partitions decide the cost of a join in Spark. Nothing else here is about that subject at all. A shuffle with 200 partitions is the default in Spark."
    assert one(spark, text.extractive_summary(F.col("t"), 1), t=long) in long
    assert one(spark, text.extractive_summary(F.col("t")), t=None) == ""


@pytest.mark.parametrize(
    ("given", "url"),
    [
        ("https://twitter.com/someone/status/123?s=20", "https://x.com/someone/status/123"),
        ("mobile.twitter.com/someone/status/123/photo/1", "https://x.com/someone/status/123"),
        ("https://youtu.be/abc?t=5", "https://www.youtube.com/watch?v=abc"),
        ("http://www.Example.com:80/a/?utm_source=x&b=2&a=1#top", "https://example.com/a?a=1&b=2"),
        ("https://arxiv.org/pdf/2401.01234v3", "https://arxiv.org/abs/2401.01234"),
        ("https://old.reddit.com/r/Spark/comments/abc1/title/", "https://www.reddit.com/r/Spark/comments/abc1"),
        ("https://www.xiaohongshu.com/discovery/item/64AB0000000000000000000F?xsec_token=z", "https://www.xiaohongshu.com/explore/64ab0000000000000000000f"),
        ("https://news.ycombinator.com/item?id=1&p=2", "https://news.ycombinator.com/item?id=1"),
        ("  ", ""),
        ("not a url", "not a url"),
        ("http://[broken", "http://[broken"),
    ],
)
def test_canonical_url(given, url):
    assert urls.canonical(given)[0] == url


def test_urls_on_spark(spark):
    assert one(spark, urls.canonical_url(F.col("t"))["source_id"], t="https://github.com/apache/spark/") == "apache/spark"
    assert one(spark, urls.same_content(F.col("t"), F.lit("https://x.com/a/status/1")), t="https://twitter.com/a/status/1?s=1") is True
    assert one(spark, urls.root_domain(F.col("t")), t="www.news.bbc.co.uk") == "bbc.co.uk"
    assert one(spark, urls.display_url(F.col("t"), 12), t="https://www.example.com/path/long") == "example.com…"


def test_display(spark):
    shown = [one(spark, display.compact_number(F.col("n")), n=float(n)) for n in (950, 1500, 15_400, 3_400_000, 2e9)]
    assert shown == ["950", "1.5K", "15K", "3.4M", "2B"]
    assert [one(spark, display.time_ago(F.col("n"), F.lit(0)), n=-1000 * s) for s in (10, 300, 7200, 3 * 86400, 400 * 86400)] == ["now", "5m", "2h", "3d", "1y"]
    assert [one(spark, display.score_band(F.col("n")), n=n) for n in (80, 62, 40, 39)] == ["critical", "high", "medium", "low"]
    assert one(spark, text.slugify(F.col("t")), t=" Hello, 世界! ") == "hello-世界"
    assert one(spark, display.initials(F.col("t")), t="ada king lovelace") == "AL"
    hue = 2166136261
    for c in "abc":
        hue = (hue ^ ord(c)) * 16777619 & 0xFFFFFFFF
    assert one(spark, display.string_hue(F.col("t")), t="abc") == hue % 360


def test_compact_numbers_round_as_printf(spark):
    """Every price to the cent that lies on or beside a half, and ties, as printf rounds their exact values."""
    prices = [c / 100 for k in range(10, 100) for c in range(k * 10_000 + 4_998, k * 10_000 + 5_003)]
    values = [sign * p * unit for p in (*prices, 1000.0, 9999.99, 9950.0, 9949.99) for unit in (1, 1000) for sign in (1, -1) if 1000 <= p < 10_000]
    rows = spark.createDataFrame([(v,) for v in values], "n double").select("n", display.compact_number(F.col("n")).alias("shown")).collect()
    want = lambda n: f"{n / (unit := 1e3 if abs(n) < 1e6 else 1e6):.1f}".removesuffix(".0") + ("K" if unit == 1e3 else "M")
    assert len(rows) > 1_500 and [(r["n"], r["shown"]) for r in rows if r["shown"] != want(r["n"])] == []
    assert {n: r["shown"] for r in rows if (n := r["n"]) in (1150.0, 1250.0, 1750.0, -1250.0)} == {1150.0: "1.1K", 1250.0: "1.2K", 1750.0: "1.8K", -1250.0: "-1.2K"}


def naive_simhash(tokens):
    def fnv(s):
        h = 0xCBF29CE484222325
        for c in s:
            h = (h ^ ord(c)) * 0x100000001B3 & (1 << 64) - 1
        return h

    votes = [0] * 64
    for feature, weight in [(t, 1) for t in tokens] + [(a + "\x01" + b, 2) for a, b in zip(tokens, tokens[1:], strict=False)]:
        for bit in range(64):
            votes[bit] += weight if fnv(feature) >> bit & 1 else -weight
    return f"{sum(1 << b for b in range(64) if votes[b] > 0):016x}"


def test_simhash(spark):
    words = "spark plans queries and runs them over many partitions of data".split()
    assert f"{int(similarity.simhashes(pa.array([[], words, None, words[:1]]))[1]):016x}" == naive_simhash(words)
    assert one(spark, similarity.simhash(F.col("t")), t="") == "0" * 16
    assert one(spark, similarity.hamming(F.col("t"), F.lit("f" * 16)), t="0" * 16) == 64
    assert one(spark, similarity.hamming(F.col("t"), F.lit("00000000000000f1")), t="00000000000000f0") == 1
    assert one(spark, similarity.hamming(F.col("t"), F.lit("xyz")), t="0" * 16) == 64
    assert one(spark, similarity.simhash_bands(F.col("t")), t="0123456789abcdef") == ["0:0123", "1:4567", "2:89ab", "3:cdef"]


def test_vectors(spark):
    f = spark.createDataFrame([([3.0, 4.0], [6.0, 8.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    r = f.select(similarity.cosine(F.col("a"), F.col("b")).alias("same"), similarity.cosine(F.col("a"), F.col("z")).alias("zero"), similarity.normalise(F.col("a")).alias("unit"), similarity.normalise(F.col("z")).alias("still")).first()
    assert r["same"] == pytest.approx(1) and r["zero"] == 0 and r["unit"] == pytest.approx([0.6, 0.8]) and r["still"] == [0, 0]
    near, far = similarity.embed_tokens("fast vector search engine".split()), similarity.embed_tokens("vector search engines fast".split())
    other = similarity.embed_tokens("banana bread recipe".split())
    assert near @ far > 0.5 > near @ other and np.linalg.norm(near) == pytest.approx(1, abs=1e-5)
    centres = similarity.interest_clusters(np.array([[1, 0], [0.99, 0.1], [0, 1], [0.1, 0.99]]), 2)
    assert len(centres) == 2 and abs(centres[0] @ centres[1]) < 0.5


def test_lexicon():
    names = {e["name"] for e in lexicon.entities_in(lexicon.DEFAULT, "We ran MMLU on pyspark with RAG; storage ragged.")}
    assert names == {"MMLU", "Apache Spark", "RAG"}
    assert lexicon.classify(lexicon.DEFAULT, "Quantization and latency", "inference inference kv cache") == ["inference"]
    assert lexicon.classify(lexicon.DEFAULT, "", "") == []
    assert lexicon.classify(lexicon.DEFAULT, "", "how to search", 4, for_query=True) == ["retrieval"]


def score(spark, **given):
    import dataclasses

    base = {"source": "hackernews", "kind": "article", "text": "", "points": 100, "comments": 50, "published": 0, "followers": 1000}
    row = base | given
    frame = spark.createDataFrame([tuple(row.values())], "source string, kind string, text string, points long, comments long, published long, followers long")
    metrics = F.struct(*((F.col(c) if c in row else F.lit(None).cast("bigint")).alias(c) for c in scoring.COUNTERS))
    settings = dataclasses.replace(scoring.Settings(now_ms=36 * scoring.HOUR_MS))
    return scoring.with_scores(frame, settings, F.col("source"), F.col("kind"), F.col("text"), metrics, F.col("published"), F.col("followers"), F.lit(0.0), F.lit(False), F.lit(0), F.lit(None).cast("double"), F.lit(0.0), F.lit(0)).first()


def test_scores(spark):
    good = score(spark, text="We measured a 12% gain. However, the ablation on https://github.com/a/b shows caveats. " * 5, kind="paper")
    bait = score(spark, text="Follow me and RT this!!!!! Insane giveaway, DM me", kind="post")
    assert good["score"] > bait["score"] + 5 and 0 <= bait["score"] <= 100
    assert good["breakdown"]["recency"] == pytest.approx(0.5) and good["breakdown"]["relevance"] == 0.5
    assert any("noise" in r for r in bait["reasons"]) and "+ source" in bait["reasons"]
