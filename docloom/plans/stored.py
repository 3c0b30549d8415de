"""Registered queries over stored structures that change or prune (versioned tables, pivots, bucketed keys, index segments, standing searches, bitmaps, seek cursors), sightings, lexicons and feeds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import Entity, Lexicon, entities_of
from ..operators import filters
from ..operators.bitmaps import bitmap_index
from ..operators.matching import KnownFingerprints
from ..operators.pivots import nearest_by_pivots
from ..operators.seek import clustered
from ..operators.segments import SegmentedIndex
from ..operators.standing import standing_counts
from ..operators.storage import saved, shared_path
from ..operators.vectors import VectorIndex
from ..operators.versions import Change, Store, removal, upsert
from ..schema import SearchQuery
from ..sources.connectors import feed_items
from ..sources.feeds import entries_of
from ..streaming import first_seen_within, keeping_state
from .queries import _COSINE, BODY, HOUR, ITEMS, SQL, _upsert_columns, _upsert_inputs, _vectors, items_of, query, simhash_docs, table, texts

_UPSERTED = SQL["upsert_items"]


@query(f"""SELECT 'first' AS version, sha256('https://example.org/' || doc_id) AS url_hash, substr(text, 1, 60) AS title, array_to_string(['t' || (doc_id % 3), 't' || (doc_id % 5 + 3)], ',') AS tags, CAST(doc_id % 900 AS INTEGER) AS secs, 'old' AS state FROM documents
  UNION ALL SELECT 'second', * FROM ({_UPSERTED}) UNION ALL SELECT 'third', u.* FROM ({_UPSERTED}) u ANTI JOIN (SELECT sha256('https://example.org/' || doc_id) AS url_hash FROM labels WHERE toxic = 1) t USING (url_hash)""")
def upsert_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A versioned table of items at three versions: as filled, after an upsert, after a removal, all read at the end."""
    from ..schema import ITEM
    from .ingestion import upserted

    old, new = _upsert_inputs(spark, sf_dir)
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.sha2(F.concat(F.lit("https://example.org/"), "doc_id"), 256).alias("url_hash"))
    store = Store(spark, shared_path(spark, "items"))
    store.create("items", ITEM, "url_hash", buckets=16)
    versions = [store.transact({"items": c}) for c in (Change(old, upsert("url_hash")), Change(new, upserted), Change(toxic, removal("url_hash")))]
    tables = [_upsert_columns(store.snapshot(v).table("items")).select(F.lit(name).alias("version"), "*") for name, v in zip(("first", "second", "third"), versions, strict=True)]
    return tables[0].union(tables[1]).union(tables[2])


@query(SQL["novelty_maxsim"])
def novelty_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's greatest cosine with another, through cells around pivots."""
    vectors = _vectors(spark, sf_dir)
    best = nearest_by_pivots(vectors, vectors, 1)
    return best.select(F.col("query_id").alias("id"), F.round("similarity", 6).alias("max_similarity"))


@query(f"""SELECT query_id, id, round(s, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, {_COSINE} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COSINE} DESC, b.vec_id) AS rank
  FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id) WHERE rank <= 8""")
def neighbour_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight most alike others of every vector."""
    vectors = _vectors(spark, sf_dir)
    return nearest_by_pivots(vectors, vectors, 8).withColumn("similarity", F.round("similarity", 6))


@query(SQL["known_near_duplicates"])
def known_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the nearest other of a stored, bucketed corpus."""
    hashed = saved(simhash_docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "simhash"))
    known = KnownFingerprints(spark, f"known_{uuid.uuid4().hex}")
    known.add(hashed)
    return known.nearest(hashed)


_ASKED = ("the", "of", "and")
_CHANGED = """d AS (SELECT 'd' || doc_id AS id, CASE WHEN quality = 0 THEN text || ' the end of this and that' ELSE text END AS text FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0 UNION ALL SELECT 'b' || item_id, text FROM benchmark)"""
_EXACT = f"""{_CHANGED}, k AS (SELECT id, len(w) AS length, {", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS t{i}" for i, t in enumerate(_ASKED))} FROM (SELECT id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM d)),
  s AS (SELECT count(*) AS n, avg(length) AS mean, {", ".join(f"count(*) FILTER (t{i} > 0) AS f{i}" for i in range(len(_ASKED)))} FROM k),
  b AS (SELECT id, {" + ".join(f"greatest(ln((n - f{i} + 0.5) / (f{i} + 0.5)), 1e-6) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * length / mean))" for i in range(len(_ASKED)))} AS score FROM k, s WHERE t0 > 0 AND t1 > 0 AND t2 > 0)"""


@query(f"WITH {_EXACT}, r AS (SELECT id, round(score, 6) AS score FROM b ORDER BY b.score DESC, id LIMIT 25) SELECT 'segments' AS kept, * FROM r UNION ALL SELECT 'merged', * FROM r")
def index_after_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 from an index that was filled, changed by three batches (new texts, deletions, updates), and merged."""
    words = lambda rows, key: rows.select(key.alias("id"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("body"))
    key = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    labels = table(spark, sf_dir, "labels")
    docs = texts(spark, sf_dir)
    poor = docs.join(labels.filter("quality = 0").select("doc_id"), "doc_id").withColumn("text", F.concat("text", F.lit(" the end of this and that")))
    index = SegmentedIndex().with_documents(words(docs, key), BODY)
    index = index.with_documents(words(table(spark, sf_dir, "benchmark"), F.concat(F.lit("b"), F.col("item_id").cast("string"))), BODY)
    index = index.with_documents(words(poor, key), BODY).without(labels.filter("toxic = 1").select(key.alias("id")))
    found = [i.search(spark, list(_ASKED), 25).select(F.lit(name).alias("kept"), "id", F.round("score", 6).alias("score")) for name, i in (("segments", index), ("merged", index.merged(spark)))]
    return found[0].union(found[1])


@query(f"""{ITEMS}, s AS (SELECT event_id, 't' || (event_id % 8) AS tag, ['en', 'fr', 'de', 'es'][CAST(event_id % 4 AS INTEGER) + 1] AS lang, 'a' || (event_id % 61) AS handle, CAST(event_id % 90 AS DOUBLE) AS least, event_id % 5 AS what, user_id * {HOUR} AS since FROM events)
  SELECT 's' || event_id AS search_id, count(items.id) AS n FROM s LEFT JOIN items ON NOT twin AND state <> 'trash' AND published_ms > since AND (what <> 0 OR list_contains(tags, tag) AND score >= least) AND (what <> 1 OR s.lang = items.lang AND list_contains(tags, tag))
    AND (what <> 2 OR s.handle = items.handle) AND (what <> 3 OR score >= least) AND (what <> 4 OR s.handle = items.handle AND s.lang = items.lang AND starred) GROUP BY event_id""")
def standing_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One saved search for each event, five kinds of them, held against all items."""
    e = F.col("event_id")
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    tag, handle = text(F.concat(F.lit("t"), (e % 8).cast("string"))), text(F.concat(F.lit("a"), (e % 61).cast("string")))
    lang = text(F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "es"))), (e % 4 + 1).cast("int")))
    least = (e % 90).cast("string")
    kinds = [
        F.concat(F.lit('{"tags": ['), tag, F.lit('], "min_score": '), least, F.lit("}")),
        F.concat(F.lit('{"tags": ['), tag, F.lit('], "lang": '), lang, F.lit("}")),
        F.concat(F.lit('{"authors": ['), handle, F.lit("]}")),
        F.concat(F.lit('{"min_score": '), least, F.lit("}")),
        F.concat(F.lit('{"authors": ['), handle, F.lit('], "starred": true, "lang": '), lang, F.lit("}")),
    ]
    query = F.element_at(F.array(*kinds), (e % 5 + 1).cast("int"))
    searches = table(spark, sf_dir, "events").select(F.concat(F.lit("s"), e.cast("string")).alias("id"), query.alias("query"), (F.col("user_id") * HOUR).alias("last_seen_ms"))
    return standing_counts(items_of(spark, sf_dir), searches)


_FACETS = SQL["facets_four_dims"]
_UNDER = {"all": [], "german": [("topic", "de")], "tagged": [("topic", "de"), ("tag", "t1")]}


def _facets_under(wanted: list[tuple[str, str]]) -> str:
    tests = "".join(f" AND list_contains({'topics' if d == 'topic' else 'tags'}, '{v}')" for d, v in wanted)
    return _FACETS.replace("state <> 'trash')", f"state <> 'trash'{tests})")


@query(" UNION ALL ".join(f"SELECT '{name}' AS under, * FROM ({_facets_under(wanted)})" for name, wanted in _UNDER.items()))
def facets_by_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets in four dimensions under three filters, from one index: the items are read once."""
    fits = filters.matching(items_of(spark, sf_dir), SearchQuery())
    index = bitmap_index(fits, {"source": F.col("source"), "topic": F.col("topics"), "tag": F.col("tags"), "author": F.col("author.handle")})
    parts = [index.facets(wanted, {"source": 12, "topic": 16, "tag": 16, "author": 12}).select(F.lit(name).alias("under"), "facet", "value", "n") for name, wanted in _UNDER.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"""{ITEMS}, r AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS place, count(*) OVER () AS n FROM items WHERE NOT twin AND state <> 'trash') SELECT id, score, CAST((place - 1) // ((n + 19) // 20) AS INTEGER) AS page FROM r""")
def seek_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items by score in twenty pages, each begun at the last one's cursor."""
    fits = filters.matching(items_of(spark, sf_dir), SearchQuery()).select("id", "score")
    pages = clustered(fits, "score", ranges=40)
    limit, out, cursor, number = max(1, (sum(n for _, _, n in pages.parts) + 19) // 20), None, None, 0
    while True:
        rows, cursor = pages.page(limit, cursor)
        rows = rows.withColumn("page", F.lit(number))
        out, number = rows if out is None else out.union(rows), number + 1
        if cursor is None:
            return out


@query("""WITH v AS (SELECT vec_id, CASE WHEN label = 4 THEN list_transform(embedding::DOUBLE[], lambda x: -x) ELSE embedding::DOUBLE[] END AS e FROM embeddings WHERE label <> 2),
  n AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(a.e, b.e) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.vec_id) AS rank FROM v a JOIN v b ON a.vec_id <> b.vec_id)
  SELECT query_id, id, round(s, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM n WHERE rank <= 3""")
def vectors_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest of all vectors in an index that was filled, partly set anew, thinned, partly filled again, and compacted."""
    vectors = _vectors(spark, sf_dir)
    turned = vectors.filter("label in (2, 4)").withColumn("embedding", F.transform("embedding", lambda x: -x))
    length = vectors.select(F.max(F.size("embedding"))).first()[0] or 1
    index = VectorIndex(length).put(vectors).put(turned).without(vectors.filter("label in (2, 7)").select("id")).put(vectors.filter("label = 7")).compacted(spark)
    return index.nearest(index.living(spark), 3).withColumn("similarity", F.round("similarity", 6))


@query("""WITH e AS (SELECT event_id, user_id, ts, event_type = 'purchase' AS body, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '12 hours', true) AS gap FROM events),
  r AS (SELECT *, sum(gap::INT) OVER (PARTITION BY user_id ORDER BY ts, NOT body, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e),
  s AS (SELECT *, row_number() OVER w AS place, sum(body::INT) OVER w AS fulls FROM r WINDOW w AS (PARTITION BY user_id, run ORDER BY ts, NOT body, event_id))
  SELECT event_id, 'https://example.org/u' || user_id AS url, body FROM s WHERE place = 1 OR body AND fulls = 1""")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as sightings of their user's page, a purchase being a full body, in four slices of time, each a micro-batch: the first sighting and one upgrade, anew after twelve hours without any."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("https://example.org/u"), F.col("user_id").cast("string")).alias("url"), (F.col("event_type") == "purchase").alias("full"), "ts")
    root, day = shared_path(spark, "sightings"), F.unix_date(F.col("ts").cast("date"))
    first, last = e.select(F.min(day), F.max(day)).first()
    e.withColumn("slice", F.when(day.isNotNull(), F.floor((day - (first or 0)) * 4 / ((last or 0) - (first or 0) + 1)))).write.partitionBy("slice").parquet(f"{root}/slices")
    kept = spark.read.schema(e.withColumn("slice", F.lit(0)).schema).parquet(f"{root}/slices")
    for k in range(4):  # files of a later slice are newer, which is the order in which a stream takes them
        kept.filter(F.col("slice") == k).drop("slice").coalesce(1).write.mode("append").parquet(f"{root}/in")
    rows = first_seen_within(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in"), "12 hours", ties=("event_id",))
    writer = rows.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True)
    keeping_state(spark, writer.start).awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{root}/out").select("event_id", "url", F.col("full").alias("body"))


LEXICON_WORDS = 5_000


@query(f"""WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS w FROM documents), k AS (SELECT w FROM t GROUP BY w ORDER BY count(*) DESC, w LIMIT {LEXICON_WORDS}),
  h AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM documents) SEMI JOIN k USING (w))
  SELECT doc_id, count(w) AS n, md5(coalesce(string_agg(w, ',' ORDER BY w), '')) AS names_md5 FROM documents LEFT JOIN h USING (doc_id) GROUP BY doc_id""")
def entity_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities in each whole document, of a lexicon of the 5,000 most frequent words of four letters or more; the size of the lexicon is fixed, so the driver may hold it."""
    docs = texts(spark, sf_dir)
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("w")).groupBy("w").count()
    common = [r["w"] for r in words.orderBy(F.desc("count"), "w").limit(LEXICON_WORDS).collect()]
    lexicon = Lexicon(entities=tuple(Entity(w, "word") for w in common))
    names = F.transform(entities_of(F.col("text"), lexicon, limit=None, reach=None), lambda e: e["name"])
    return docs.select("doc_id", names.alias("names")).select("doc_id", F.size("names").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("names"), ",")).alias("names_md5"))


@query("""SELECT url, 'Page ' || page_id || ' & <more>' AS title, 'About page ' || page_id || ' – "' || page_id % 9 || '"' AS summary, CASE WHEN page_id % 3 < 2 THEN 'Whole text of ' || page_id ELSE 'About page ' || page_id || ' – "' || page_id % 9 || '"' END AS content,
  'Ann ' || page_id % 11 AS author, page_id % 20000 * 86400000 + 16200000 AS published_ms, 'c' || page_id % 7 || ',R&D' AS tags FROM pages""")
def feed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as entries of RSS, Atom and RDF feeds, forty a feed, read back as ingest rows."""
    n, number = F.col("page_id"), F.col("page_id").cast("string")
    day = F.date_add(F.lit("1970-01-01").cast("date"), (n % 20_000).cast("int"))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    url = F.replace("url", F.lit("&"), F.lit("&amp;"))
    title = text("<title>Page ", number, " &amp; &lt;more&gt;</title>")
    about = text("<![CDATA[<p>About page <b>", number, "</b> &#8211; &quot;", (n % 9).cast("string"), "&quot;</p>]]>")
    author, kind = text("Ann ", (n % 11).cast("string")), text("c", (n % 7).cast("string"))
    body = text("&lt;p&gt;Whole text of ", number, "&lt;/p&gt;")
    rss = text("<item>", title, "<link>", url, "</link><description>", about, "</description><content:encoded>", body, "</content:encoded><dc:creator>", author, "</dc:creator><pubDate>", F.date_format(day, "EEE, dd MMM yyyy"), " 06:30:00 +0200</pubDate><category>", kind, "</category><category>R&amp;D</category></item>")
    atom = text("<entry>", title, '<link rel="self" href="https://feed.example/"/><link rel="alternate" type="text/html" href="', url, '"/><summary>', about, "</summary><content type=\"html\">", body, "</content><author><name>", author, "</name></author><updated>", day.cast("string"), 'T04:30:00Z</updated><category term="', kind, '"/><category term="R&amp;D"/></entry>')
    rdf = text('<item rdf:about="', url, '">', title, "<link>", url, "</link><description>", about, "</description><dc:creator>", author, "</dc:creator><dc:date>", day.cast("string"), "T04:30:00+00:00</dc:date><category>", kind, "</category><category>R&amp;D</category></item>")
    kinds = F.create_map(F.lit(0), F.lit("<rss><channel><title>All</title>"), F.lit(1), F.lit("<feed><title>All</title>"), F.lit(2), F.lit("<rdf:RDF>"))
    part = (n % 3).cast("int")
    entries = table(spark, sf_dir, "pages").select(part.alias("part"), F.floor(n / 120).alias("feed"), F.when(part == 0, rss).when(part == 1, atom).otherwise(rdf).alias("entry"))
    feeds = entries.groupBy("part", "feed").agg(F.array_join(F.collect_list("entry"), "\n").alias("entries")).select(F.concat_ws("/", "part", "feed").alias("path"), F.concat(kinds[F.col("part")], "entries").alias("xml"))
    return feed_items(entries_of(feeds)).select("url", "title", "summary", "content", F.col("author.name").alias("author"), "published_ms", F.array_join("tags", ",").alias("tags"))
