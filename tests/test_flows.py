"""Ingestion, search, digests, sources and streams, end to end on small inputs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from docloom.functions.scoring import Settings
from docloom.plans import digest, ingestion, search
from docloom.schema import INGEST, ITEM, SearchQuery
from docloom.sources import captures, connectors, feeds

HOUR = 3_600_000
NOW = 100 * HOUR


def batch(spark, rows):
    names = [f.name for f in INGEST]
    frame = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], INGEST)
    order = {r["url"]: i for i, r in enumerate(rows)}
    return frame.withColumn("seq", F.create_map(*(F.lit(x) for kv in order.items() for x in kv))[F.col("url")].cast("long"))


BODY = "We measured how shuffle partitions change the cost of a join in Spark over large tables, and describe the benchmark methodology in detail. "
ROWS = [
    {"url": "https://a.example/1", "source": "web", "kind": "article", "title": "Shuffle costs in Spark", "content": BODY * 3, "published_ms": 90 * HOUR, "tags": ["spark"], "author": {"name": "Ann", "handle": "ann"}},
    {"url": "https://b.example/2?utm_source=x", "source": "web", "kind": "article", "title": "Shuffle costs in Spark", "content": BODY * 3, "published_ms": 91 * HOUR},
    {"url": "https://c.example/3", "source": "manual", "kind": "note", "title": "烹饪笔记与食谱", "content": "今天学习如何做面包和汤,记录下来方便以后查看。", "published_ms": 92 * HOUR},
    {"url": "x", "source": "web", "title": "bad url row here"},
    {"url": "https://d.example/4", "source": "nowhere", "title": "unknown source kind here"},
]


@pytest.fixture(scope="module")
def table(spark):
    empty = spark.createDataFrame([], ITEM)
    out = ingestion.run(empty, batch(spark, ROWS), Settings(now_ms=NOW))
    return ingestion.saved(out.items), {r["outcome"]: r["n"] for r in out.results.collect()}


def test_ingest(table):
    items, results = table
    assert results == {"received": 5, "created": 2, "duplicates": 1, "rejected": 2}
    rows = {r["url"]: r for r in items.collect()}
    first, copy, note = rows["https://a.example/1"], rows["https://b.example/2"], rows["https://c.example/3"]
    assert copy["duplicate_of"] == first["id"] and copy["score"] == 0 and copy["state"] == "archived" and copy["embedding"] is None
    assert first["duplicate_of"] is None and first["echo_count"] == 1 and note["state"] == "inbox" and note["lang"] == "zh"


def test_reingest_keeps_user_state(spark, table):
    items, _ = table
    acted = items.withColumn("starred", F.lit(True)).withColumn("state", F.when(F.col("duplicate_of").isNull(), "saved").otherwise(F.col("state")))
    again = ingestion.run(acted, batch(spark, [{**ROWS[0], "title": "", "tags": ["new"], "state": "inbox"}]), Settings(now_ms=NOW + HOUR))
    assert {r["outcome"]: r["n"] for r in again.results.collect()}["updated"] == 1
    row = again.items.filter("url = 'https://a.example/1'").first()
    assert row["title"] and row["state"] == "saved" and row["starred"] and row["tags"] == ["spark", "new"] and row["duplicate_of"] is None and row["score"] > 0
    assert again.items.count() == items.count()


def test_search_and_digest(spark, table):
    items, _ = table
    page = search.search(items, SearchQuery(q="shuffle join", limit=5), with_facets=True)
    assert [r["url"] for r in page.items.collect()] == ["https://a.example/1"] and page.total == 1 and page.facets.count() > 0
    assert search.search(items, SearchQuery(q="如何做面包")).items.first()["url"] == "https://c.example/3"
    assert search.search(items, SearchQuery(limit=1)).cursor is not None
    assert search.ask(items, [("user", "shuffle join costs")]).first()["n"] == 1
    row = digest.generate(items, NOW, hours=24).first()
    assert row["title"] == "Daily digest" and len(row["item_ids"]) == 2 and digest.sections(row["body"])
    assert digest.is_due(None, 30 * HOUR, 5) and not digest.is_due(29 * HOUR, 30 * HOUR, 5)


def test_actions_and_authors(spark, table):
    items, _ = table
    ident = items.filter("url = 'https://a.example/1'").first()["id"]
    ledger = spark.createDataFrame([(1, 10, "item.save", ident, "c1", None), (2, 20, "item.archived", ident, "c2", None), (3, 15, "item.star", ident, "c1", None), (4, 30, "item.read", ident, "c3", "5")], "seq long, ts_ms long, type string, item_id string, call_id string, value string")
    row = ingestion.apply_actions(items, ledger).filter(F.col("id") == ident).first()
    assert (row["state"], row["starred"], row["read_ms"]) == ("archived", True, 30)
    stats = ingestion.author_stats(items, ledger).first()
    assert (stats["handle"], stats["seen"], stats["saved"], stats["dismissed"]) == ("ann", 1, 1, 1)
    assert ingestion.delete(items, items.filter(F.col("id") == ident)).filter("duplicate_of is not null").count() == 0
    assert ingestion.rescore(items, Settings(now_ms=NOW)).count() == items.count()


RSS = """<rss><channel><title>Feed</title><item><title><![CDATA[One & only]]></title><link>https://f.example/1</link><description>&lt;p&gt;Hi&lt;/p&gt;</description><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate><category>a</category><category>b</category>
<enclosure url="https://f.example/i.jpg"/></item><item><title>no link</title></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Two</title><link rel="self" href="https://f.example/self"/><link rel="alternate" type="text/html" href="https://f.example/2"/><author><name>Bo</name></author><published>2024-01-02T03:04:05Z</published>
<category term="c"/></entry></feed>"""


def test_feeds(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    (tmp_path / "b.xml").write_text(ATOM)
    rows = {r["link"]: r for r in feeds.read_feeds(spark, str(tmp_path)).collect()}
    assert set(rows) == {"https://f.example/1", "https://f.example/2"}
    one, two = rows["https://f.example/1"], rows["https://f.example/2"]
    assert one["title"] == "One & only" and one["published_ms"] == two["published_ms"] == 1704164645000 and one["categories"] == ["a", "b"] and one["enclosure"] == "https://f.example/i.jpg"
    assert two["author"] == "Bo" and two["categories"] == ["c"]
    items = connectors.run(spark, "rss", str(tmp_path), include=("one",)).collect()
    assert len(items) == 1 and items[0]["summary"] == "Hi"
    assert feeds.feed_date("garbage") is None and feeds.entries("not a feed") == []


def test_connectors(spark, tmp_path):
    (tmp_path / "hn.json").write_text(json.dumps({"hits": [{"objectID": "1", "title": "Ask", "points": 30, "num_comments": 3, "created_at_i": 5, "author": "z"}, {"objectID": "2", "title": "Low", "points": 3}]}))
    rows = connectors.run(spark, "hackernews", str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0]["kind"] == "discussion" and rows[0]["published_ms"] == 5000 and rows[0]["metrics"]["points"] == 30
    with pytest.raises(ValueError, match="no connector"):
        connectors.run(spark, "youtube", str(tmp_path))
    assert connectors.github_queries("a OR b") == ["a", "b"] and connectors.github_queries("") == ["topic:llm"]


POST = {"data": {"noise": [1, {"x": {"result": {"__typename": "Tweet", "rest_id": "9", "core": {"user_results": {"result": {"legacy": {"screen_name": "bob", "name": "Bob", "followers_count": 5}}}}, "views": {"count": "1,200"},
        "legacy": {"full_text": "short https://t.co/a", "id_str": "9", "favorite_count": 3, "entities": {"urls": [{"url": "https://t.co/a", "expanded_url": "https://real.example/x"}]}, "created_at": "Tue Jan 02 03:04:05 +0000 2024"},
        "quoted_status_result": {"result": {"legacy": {"full_text": "a quoted post here", "id_str": "8"}}}}}}]}}


def test_captures(spark):
    rows = {r[0]: dict(zip(captures.CAPTURED.fieldNames(), r, strict=True)) for r in captures.posts(json.dumps(POST))}
    assert set(rows) == {"https://x.com/bob/status/9", "https://x.com/i/status/8"}
    assert rows["https://x.com/bob/status/9"]["content"] == "short https://real.example/x" and rows["https://x.com/bob/status/9"]["views"] == 1200
    note = {"items": [{"note_card": {"note_id": "64ab00000000000000000001", "title": "标题", "type": "normal", "time": 1704164645, "interact_info": {"liked_count": "1.2万"}, "image_list": [{"url": "http://i"}]}}]}
    f = spark.createDataFrame([(json.dumps(note),), ("{broken",)], "payload string")
    got = captures.from_captures(f, "payload", "notes").collect()
    assert len(got) == 1 and got[0]["likes"] == 12_000 and got[0]["published_ms"] == 1704164645000 and got[0]["media"] == ["http://i"]
    deep = node = {}
    for _ in range(40):
        node["n"] = {}
        node = node["n"]
    node["full_text"] = "too deep to be found"
    assert captures.posts(json.dumps(deep)) == []


def test_article(spark):
    html = '<html><head><title>T</title><meta property="og:title" content="Meta"><script type="application/ld+json">{"@type":"NewsArticle","headline":"Linked","author":[{"name":"Cy"}]}</script></head><body><nav><a href="/">menu</a></nav><article><h1>Head</h1><p>First paragraph of the text.</p><p>Second.</p></article><div class="sidebar">more</div></body></html>'
    got = captures.article(html)
    assert got["title"] == "Linked" and got["author"] == "Cy" and "First paragraph" in got["content"] and "menu" not in got["content"]
    assert spark.createDataFrame([(html,), (None,)], "h string").select(captures.captured_article("h")["title"]).collect()[0][0] == "Linked"


def test_ingest_stream(spark, tmp_path):
    from docloom.streaming import ingest_stream

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join(json.dumps({"url": u, "seq": i, "v": v}) for i, (u, v) in enumerate([("a", 1), ("b", 2), ("a", 3)])))
    seen: list = []
    rows = spark.readStream.schema("url string, seq long, v int").json(str(source))
    ingest_stream(rows, lambda df, n: seen.extend((r["url"], r["v"]) for r in df.collect()), str(tmp_path / "state")).awaitTermination()
    assert sorted(seen) == [("a", 3), ("b", 2)]


def test_rendered_pages():
    page = '<main><article data-testid="tweet"><div data-testid="User-Name">Bob @bob</div><a href="/bob/status/42">t</a><time datetime="2024-01-02T03:04:05Z"></time><div data-testid="tweetText">A post with <b>bold</b> words</div><button data-testid="like" aria-label="1.2K likes"></button><img src="https://pbs.twimg.com/a.jpg"></article><article>none</article></main>'
    row = dict(zip(captures.CAPTURED.fieldNames(), captures.posts_of_page(page)[0], strict=True))
    assert row["url"] == "https://x.com/bob/status/42" and row["content"] == "A post with bold words" and row["likes"] == 1200 and row["published_ms"] == 1704164645000 and row["author_name"] == "Bob"
    stub = '<section class="note-item"><a href="/explore/64ab00000000000000000001">x</a><span class="title">标题</span><span class="count">1.2万</span></section>'
    full = '<div class="note-container"><a href="/explore/64AB00000000000000000001">x</a><div class="title">标题</div><div class="desc">正文很长</div></div>'
    rows = captures.notes_of_page(stub + full)
    assert len(rows) == 1 and "正文" in rows[0][5] and captures.notes_of_page(stub)[0][11] == 12_000
    assert captures.posts_of_page(None) == []


def test_profile_and_detail(spark, table):
    from docloom.operators import library
    from docloom.schema import COLLECTION, COLLECTION_ITEM, HIGHLIGHT

    items, _ = table
    kept = items.withColumn("state", F.when(F.col("duplicate_of").isNull(), "saved").otherwise(F.col("state")))
    vectors, words = ingestion.interest_profile(kept, ("spark joins",))
    assert len(vectors) == 3 and "spark joins" in words
    ident = items.filter("url = 'https://a.example/1'").first()["id"]
    detail = library.item_detail(items, ident, spark.createDataFrame([("h", ident, "mark", None, None, 1)], HIGHLIGHT), spark.createDataFrame([("c", "Reading", None, None, 1.0, None, 0)], COLLECTION), spark.createDataFrame([("c", ident, 1.0, None, 0)], COLLECTION_ITEM)).first()
    assert detail["highlights"][0]["text"] == "mark" and detail["collections"] == ["Reading"]
    assert "[1] Shuffle costs" in search.context_block(items.filter(F.col("id") == ident))
    assert ingestion.backfill(items).filter("duplicate_of is null and embedding is null").count() == 0


def test_first_seen_stream(spark, tmp_path):
    from docloom.streaming import first_seen

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join(json.dumps({"url": u, "full": f, "v": v}) for v, (u, f) in enumerate([("a", False), ("a", False), ("b", True), ("a", True), ("a", True)])))
    rows = spark.readStream.schema("url string, full boolean, v int").json(str(source))
    first_seen(rows).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["url"], r["full"]) for r in spark.read.schema(rows.schema).parquet(str(tmp_path / "out")).collect())
    assert got == [("a", False), ("a", True), ("b", True)]


def test_refresh_keeps_errors_with_their_source(spark):
    from docloom.plans.refresh import tick

    rows = [("a", "rss", True, 600, 0, 5, None), ("b", "rss", True, 600, None, None, "old"), ("c", "rss", False, 600, 0, 1, None), ("d", "rss", True, 600, 9_999_000, 2, "kept")]
    sources = spark.createDataFrame(rows, "id string, kind string, enabled boolean, interval_sec long, last_run_ms long, items_total long, last_error string")

    def fetch(source):
        if source["id"] == "b":
            raise ValueError("no feed")
        return spark.range(3)

    got = {r["id"]: (r["last_run_ms"], r["items_total"], r["last_error"]) for r in tick(sources, 10_000_000, fetch, lambda s, f: f.count()).collect()}
    assert got == {"a": (10_000_000, 8, None), "b": (10_000_000, 0, "ValueError: no feed"), "c": (0, 1, None), "d": (9_999_000, 2, "kept")}


def test_highlights_and_digests(spark):
    from docloom.operators.library import new_highlights
    from docloom.plans.digest import stored, template
    from docloom.schema import DIGEST, HIGHLIGHT

    none = spark.createDataFrame([], HIGHLIGHT)
    added = spark.createDataFrame([("h1", "i", "text", None, None, 1), ("h2", "i", " ", None, None, 2), ("h3", "i", "x" * 10_001, None, None, 3), ("h4", "i", None, None, None, 4)], HIGHLIGHT)
    table, refused = new_highlights(none, added)
    assert [r["id"] for r in table.collect()] == ["h1"] and {(r["id"], r["reason"]) for r in refused.collect()} == {("h2", "no text"), ("h3", "too long"), ("h4", "no text")}
    digests = spark.createDataFrame([("x", "t", 0, 10, "b", [], 10), ("y", "t", 0, 30, "b", [], 30), ("z", "t", 0, 20, "b", [], 20)], DIGEST)
    assert [r["id"] for r in stored(digests).collect()] == ["y", "z", "x"] and stored(digests, limit=1).first()["id"] == "y" and stored(digests, "z").count() == 1
    assert template([]) == "No items in this period."


def test_demo_rows_go_through_ingestion(spark):
    from docloom.functions.scoring import Settings
    from docloom.plans.ingestion import run
    from docloom.schema import ITEM
    from docloom.sources.demo import demo_rows

    now = 1_700_000_000_000
    rows = demo_rows(spark, now)
    assert rows.count() == 36 and rows.select("url").distinct().count() == 36
    done = run(spark.createDataFrame([], ITEM), rows, Settings(now_ms=now))
    counts = {r["outcome"]: r["n"] for r in done.results.collect()}
    assert counts["received"] == 36 and counts["duplicates"] >= 5 and counts["created"] + counts["duplicates"] + counts["rejected"] == 36


def test_post_author_is_the_first_with_a_name():
    """A person without handle and name is passed over for the next place that has one."""
    node = {"rest_id": "5", "core": {"user_results": {"result": {"legacy": {"followers_count": 3}}}}, "legacy": {"full_text": "a post by bob of some words", "id_str": "5", "user": {"screen_name": "bob", "followers_count": 7}}}
    row = dict(zip(captures._FIELDS, captures.post_row(node), strict=True))
    assert (row["author_handle"], row["author_name"], row["followers"], row["url"]) == ("bob", "bob", 7, "https://x.com/bob/status/5")
    del node["legacy"]["user"]
    assert dict(zip(captures._FIELDS, captures.post_row(node), strict=True))["author_handle"] == "i"


def test_stored_content_decodes_numeric_references(spark):
    from docloom.functions.text import normalise_text

    frame = spark.createDataFrame([("<p>It&#8217;s &amp; &#x41;</p>",), ("plain &#65; text",)], "t string")
    assert [r[0] for r in frame.select(normalise_text(F.col("t"))).collect()] == ["It’s & A", "plain &#65; text"]
