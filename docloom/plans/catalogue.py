"""More registered queries: search over all index columns, the library's tables, export, display and hashing, each over whole tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import display, scoring, similarity, text, urls
from ..operators import analytics, export, filters, library, matching, ranking
from ..schema import BREAKDOWN, ENTITIES, ENTITY_TYPES, METRICS, SearchQuery, violations
from . import ingestion
from .queries import ALL_TOKENS, BODY, DEPTH, EVENT_MS, HOUR, ITEMS, NOISE, NOISE_FROM, SQL, TOKENS, _ACTIONS, _COSINE, _WORDS, _documents, _events, items_of, query, table, texts
from .search import ask, search, similar

_TYPES = "['" + "','".join(ENTITY_TYPES) + "']"


def full_items(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """The items with entities, counters, times, followers, and the vectors of equal number."""
    number = F.substring("id", 2, 8).cast("long")
    kind = F.element_at(F.array(*map(F.lit, ENTITY_TYPES)), (number % len(ENTITY_TYPES) + 1).cast("int"))
    entity = F.struct(kind.alias("type"), F.concat(F.lit("e"), (number % 11).cast("string")).alias("name"), F.lit(0.5).alias("confidence"))
    author = F.struct("author.name", "author.handle", (number * 10).alias("followers"), F.lit(False).alias("verified"))
    vectors = table(spark, sf_dir, "embeddings").select(F.format_string("d%08d", "vec_id").alias("id"), "embedding")
    items = items_of(spark, sf_dir, docs).withColumns({"entities": F.array(entity).cast(ENTITIES), "author": author, "metrics": F.lit(None).cast(METRICS), "echo_count": F.lit(0), "breakdown": F.lit(None).cast(BREAKDOWN), "updated_ms": F.col("captured_ms")})
    return items.join(vectors, "id", "left")


# Search over all index columns, and from a stored index.

_FOLD = "translate(lower({}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"
_CUT = "regexp_extract_all({}, '[\\p{{L}}\\p{{N}}]+')"


def _index(words: tuple[str, ...], every: bool = True) -> str:
    cut = lambda x: _CUT.format(_FOLD.format(x))
    columns = {"title": cut("substr(text, 1, 60)"), "body": cut("substr(text, 1, 300) || ' ' || text"), "author": cut("handle"), "tags": cut("array_to_string(tags, ' ') || ' ' || array_to_string(topics, ' ')")}
    weights = {"title": 10.0, "body": 1.0, "author": 3.0, "tags": 4.0}
    counts = ", ".join(" + ".join(f"{w} * len(list_filter({c}, lambda x: starts_with(x, '{word}')))" for c, w in weights.items()) + f" AS t{i}" for i, word in enumerate(words))
    frequency = ", ".join(f"count(*) FILTER (t{i} > 0) AS f{i}" for i in range(len(words)))
    score = " + ".join(f"greatest(ln((n - f{i} + 0.5) / (f{i} + 0.5)), 1e-6) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * length / mean))" for i in range(len(words)))
    passing = (" AND " if every else " OR ").join(f"t{i} > 0" for i in range(len(words)))
    return f"""{ITEMS}, c AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in columns.items())} FROM (SELECT id, doc_id, text, handle, tags, topics FROM items WHERE NOT twin AND state <> 'trash')),
  k AS (SELECT id, doc_id, text, len(title) + len(body) + len(author) + len(c.tags) AS length, {counts} FROM (SELECT * EXCLUDE (tags, topics), {columns["tags"]} AS tags FROM c) c),
  s AS (SELECT count(*) AS n, avg(length) AS mean, {frequency} FROM k), bm AS (SELECT id, doc_id, text, {score} AS score FROM k, s WHERE {passing})"""


_PAGE = "SELECT CAST(row_number() OVER (ORDER BY score DESC, id) - 1 AS INTEGER) AS position, id, round(1.2 / (60 + row_number() OVER (ORDER BY score DESC, id)), 9) AS fused, 'keyword' AS matched_by FROM bm ORDER BY score DESC, id LIMIT 20"


def _page(items: DataFrame, q: str) -> DataFrame:
    return search(items, SearchQuery(q=q, mode="keyword", limit=20)).items.select("position", "id", F.round("fused", 9).alias("fused"), "matched_by")


@query(f"WITH RECURSIVE {_index(('tion', 'the'))[5:]} {_PAGE}")
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(full_items(spark, sf_dir, texts(spark, sf_dir)), "tion the")


@query(f"WITH RECURSIVE {_index(('zzzzqq', 'ment'), every=False)[5:]} {_PAGE}")
def search_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No item has both words, so any of them counts."""
    return _page(full_items(spark, sf_dir, texts(spark, sf_dir)), "zzzzqq ment")


@query(SQL["bm25_keyword"])
def indexed_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword search from a stored index of all documents."""
    index = ranking.build_index(_documents(spark, sf_dir), BODY)
    return ranking.indexed_search(index, " ".join(_WORDS), 25).withColumn("score", F.round("score", 6))


@query(f"WITH RECURSIVE {_index(('tion', 'ment'))[5:]} SELECT CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS n, id, substr(text, 1, 60) AS title, 'https://example.org/' || doc_id AS url FROM bm ORDER BY score DESC, id LIMIT 12")
def ask_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = full_items(spark, sf_dir, texts(spark, sf_dir)).withColumn("embedding", F.lit(None).cast("array<float>"))
    return ask(items, [("user", "first"), ("assistant", "?"), ("user", "tion ment")]).drop("snippet")


@query(f"""{ITEMS}, v AS (SELECT id, embedding FROM items JOIN embeddings ON vec_id = doc_id WHERE NOT twin AND state <> 'trash'), q AS (SELECT embedding FROM embeddings WHERE vec_id = 10), s AS (SELECT v.id, {_COSINE.replace('a.', 'v.').replace('b.', 'q.')} AS s FROM v, q WHERE v.id <> 'd00000010')
  SELECT id, round(s, 6) AS similarity FROM s WHERE s >= 0.2 ORDER BY s DESC, id LIMIT 8""")
def similar_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(full_items(spark, sf_dir), "d00000010").select("id", F.round("similarity", 6).alias("similarity"))


@query(f"""{ITEMS}, o AS (SELECT id, score, len(list_intersect(topics, ['fr', 'p1'])) + CASE WHEN doc_id % 11 IN (3, 4) THEN 1 ELSE 0 END AS overlap FROM items)
  SELECT id, CAST(overlap AS INTEGER) AS overlap, CAST(row_number() OVER (ORDER BY overlap DESC, score DESC, id) AS INTEGER) AS rank FROM o WHERE overlap > 0 ORDER BY rank LIMIT 60""")
def concept_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.concept_search(full_items(spark, sf_dir), ["fr", "p1"], ["e3", "e4"], 60)


_WHOLE = "concat_ws(chr(10), substr(text, 1, 60), substr(text, 1, 300), text)"


@query(f"""{ITEMS.replace(' FROM documents)', ' FROM (SELECT * REPLACE (' + _WHOLE + ' AS text) FROM documents))')}, v AS (SELECT i.id, e.embedding FROM items i JOIN embeddings e ON e.vec_id = i.doc_id WHERE NOT twin),
  m AS (SELECT a.id, max({_COSINE}) AS likeness FROM v a JOIN v b ON a.id <> b.id GROUP BY a.id), n AS (SELECT doc_id, {NOISE} AS noise FROM {NOISE_FROM.replace('FROM documents', 'FROM (SELECT doc_id, text FROM items)')}),
  d AS (SELECT id, doc_id, twin, score AS old, {DEPTH} AS depth FROM (SELECT *, len({ALL_TOKENS}) AS n, len(list_distinct({TOKENS})) AS u FROM items)),
  s AS (SELECT d.id, twin, old, (0.5 * 0.26 + least(1.0, greatest(0.0, 1 - least(1.0, greatest(0.0, coalesce(likeness, 0))))) * 0.14 + depth * 0.15 + pow(0.5, greatest(0.0, (1200 - d.doc_id) * 1.0) / 36) * 0.1
    + 0.55 * least(1.0, ln(1 + d.doc_id * 10.0) / ln(2000001.0)) * 0.13) * (1 - least(0.3, noise * 0.4)) AS x FROM d JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.id = d.id)
  SELECT id, CASE WHEN twin THEN old ELSE floor(least(1.0, greatest(0.0, x)) * 100 + 0.5) END AS score FROM s""")
def rescored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scores anew, novelty against all other canonical items included."""
    return ingestion.rescore(full_items(spark, sf_dir, texts(spark, sf_dir)), scoring.Settings(now_ms=1200 * HOUR)).select("id", "score")


@query()
def interest_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres of the latest saved items' vectors; how many count is the profile's own limit."""
    centres, _ = ingestion.interest_profile(full_items(spark, sf_dir))
    return spark.createDataFrame(list(enumerate(centres)), "cluster int, centre array<double>")


# Joins and aggregates of items.


@query(f"""{ITEMS}, e AS (SELECT id, doc_id, 'e' || (doc_id % 11) AS name FROM items WHERE {_TYPES}[CAST(doc_id % 8 AS INT) + 1] IN ('model', 'company', 'product', 'paper', 'benchmark'))
  SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.name = b.name AND a.id < b.id AND b.doc_id - a.doc_id <= 72""")
def echo_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.echo_candidates(full_items(spark, sf_dir)).filter("a < b")


@query(f"SELECT 'e' || (doc_id % 11) AS name, {_TYPES}[CAST(doc_id % 8 AS INT) + 1] AS type, count(*) AS n FROM documents GROUP BY 1, 2 ORDER BY n DESC, name, type LIMIT 40")
def entity_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.entity_counts(full_items(spark, sf_dir))


@query(f"""{ITEMS}, f AS (SELECT * FROM items WHERE NOT twin AND state <> 'trash'), v AS (SELECT 'source' AS facet, source AS value, 1000000 AS most FROM f UNION ALL SELECT 'topic', unnest(topics), 60 FROM f UNION ALL SELECT 'tag', unnest(tags), 100 FROM f UNION ALL SELECT 'author', handle, 80 FROM f),
  g AS (SELECT facet, value, most, count(*) AS n FROM v GROUP BY ALL) SELECT facet, value, n FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS turn FROM g) WHERE turn <= most""")
def facet_value_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.facet_values(items_of(spark, sf_dir))


@query(f"""{ITEMS}, l AS (SELECT printf('d%08d', user_id) AS id, event_type, event_id FROM events), a AS (SELECT handle, count(DISTINCT CASE WHEN event_type = 'purchase' THEN event_id END) AS saved, count(DISTINCT CASE WHEN event_type = 'error' THEN event_id END) AS dismissed FROM l JOIN items USING (id) GROUP BY handle),
  s AS (SELECT handle, count(*) AS seen, arg_max(doc_id * 10, published_ms) AS followers FROM items WHERE NOT twin GROUP BY handle) SELECT s.handle, seen, coalesce(saved, 0) AS saved, coalesce(dismissed, 0) AS dismissed, followers FROM s LEFT JOIN a USING (handle)""")
def author_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*(F.lit(x) for kv in _ACTIONS.items() for x in kv))
    ledger = _events(spark, sf_dir).select(kinds[F.col("event_type")].alias("type"), F.format_string("d%08d", "user_id").alias("item_id"), F.col("event_id").cast("string").alias("call_id"))
    return ingestion.author_stats(full_items(spark, sf_dir), ledger).drop("name")


@query(f"{ITEMS} SELECT id FROM items WHERE NOT twin AND state <> 'trash' AND source IN ('src1', 'src2', 'src7') AND kind IN ('paper', 'note', 'video') AND handle IN ('a4', 'a17', 'a27', 'a32')")
def candidate_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.matching(items_of(spark, sf_dir).withColumn("source", F.col("source")), SearchQuery(sources=("src1", "src2", "src7"), kinds=("paper", "note", "video"), authors=("a4", "a17", "a27", "a32"))).select("id")


@query(f"{ITEMS} SELECT id, score FROM items WHERE NOT twin AND state IN ('saved', 'inbox') AND list_contains(topics, 'de') AND score >= 30")
def smart_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "labels").select(F.lit("none").alias("collection_id"), F.format_string("d%08d", "doc_id").alias("item_id"))
    return library.smart_collection(items_of(spark, sf_dir), members, '{"states": ["saved", "inbox", "unknown"], "topics": ["de"], "min_score": 30}').select("id", "score")


# The library: collections, sources, tags, trash.


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(F.concat(F.lit("c"), F.col("quality").cast("string")).alias("collection_id"), F.format_string("d%08d", n).alias("item_id"), (n % 7).cast("double").alias("position"), F.lit(None).cast("string").alias("note"), (n * HOUR).alias("added_ms"))


@query(f"{ITEMS} SELECT id, CAST(doc_id % 7 AS DOUBLE) AS position FROM items JOIN labels USING (doc_id) WHERE quality = 1")
def collection_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.collection_items(items_of(spark, sf_dir), _members(spark, sf_dir), "c1").select("id", "position")


@query("SELECT 'c' || quality AS collection_id, count(*) AS n FROM labels GROUP BY 1")
def collection_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.collection_counts(_members(spark, sf_dir))


@query("""WITH m AS (SELECT 'c' || quality AS collection_id, doc_id, doc_id % 7 AS position, CAST(NULL AS VARCHAR) AS note FROM labels), a AS (SELECT doc_id, 'noted' AS note FROM documents WHERE doc_id % 3 = 0),
  l AS (SELECT max(position) AS last FROM m WHERE collection_id = 'c1'), n AS (SELECT doc_id, note FROM a WHERE doc_id NOT IN (SELECT doc_id FROM m WHERE collection_id = 'c1'))
  SELECT collection_id, printf('d%08d', doc_id) AS item_id, CAST(position AS DOUBLE) AS position, CASE WHEN collection_id = 'c1' AND doc_id IN (SELECT doc_id FROM a) THEN 'noted' ELSE note END AS note FROM m
  UNION ALL SELECT 'c1', printf('d%08d', doc_id), coalesce(last, 0.0) + row_number() OVER (ORDER BY doc_id), note FROM n, l""")
def collection_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    added = table(spark, sf_dir, "documents").filter(n % 3 == 0).select(F.lit("c1").alias("collection_id"), F.format_string("d%08d", n).alias("item_id"), F.lit("noted").alias("note"), (n * HOUR).alias("added_ms"))
    return library.add_to_collection(_members(spark, sf_dir), added).drop("added_ms")


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), n.cast("string")).alias("id"), F.concat(F.lit("src"), (n % 20).cast("string")).alias("kind"), F.concat(F.lit("https://feeds.example/?a=1&b="), n.cast("string")).alias("target"), F.col("s_name").alias("label"), (n % 4 > 0).alias("enabled"),
        ((n % 5) * 600).alias("interval_sec"), (F.col("s_acctbal") / 10_000).alias("trust"), F.when(n % 6 > 0, n * 60_000).alias("last_run_ms"), F.when(n % 2 == 0, n).alias("items_total"), F.lit("old").alias("last_error"),
    )


_SUPPLIERS = """WITH s AS (SELECT s_suppkey AS n, 's' || s_suppkey AS id, 'src' || (s_suppkey % 20) AS kind, s_name AS label, s_suppkey % 4 > 0 AS enabled, s_suppkey % 5 * 600 AS interval_sec, s_acctbal / 10000 AS trust,
  CASE WHEN s_suppkey % 6 > 0 THEN s_suppkey * 60000 END AS last_run_ms, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END AS items_total FROM supplier)"""


@query(f"{_SUPPLIERS} SELECT id FROM s WHERE enabled AND interval_sec > 0 AND coalesce(last_run_ms, 0) + interval_sec * 1000 <= 3000000")
def due_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.due(_sources(spark, sf_dir), 3_000_000).select("id")


@query(f"""{_SUPPLIERS}, r AS (SELECT 's' || (user_id % 300) AS id, {EVENT_MS} AS ran, event_id AS added, CASE WHEN event_type = 'error' THEN 'failed ' || event_id END AS error FROM events),
  d AS (SELECT id, max(ran) AS ran, sum(added) AS added, arg_max_null(error, (ran, added)) AS error FROM r GROUP BY id)
  SELECT s.id, coalesce(ran, last_run_ms) AS last_run_ms, CAST(coalesce(items_total, 0) + coalesce(added, 0) AS BIGINT) AS items_total, CASE WHEN d.id IS NOT NULL THEN d.error ELSE 'old' END AS last_error FROM s LEFT JOIN d USING (id)""")
def recorded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    runs = e.select(F.concat(F.lit("s"), (F.col("user_id") % 300).cast("string")).alias("id"), F.col("at_ms").alias("ran_ms"), F.col("event_id").alias("added"), F.when(F.col("event_type") == "error", F.concat(F.lit("failed "), F.col("event_id").cast("string"))).alias("error"))
    return library.record_run(_sources(spark, sf_dir), runs).select("id", "last_run_ms", "items_total", "last_error")


@query(f"{_SUPPLIERS}, k AS (SELECT kind, avg(trust) AS trust FROM s GROUP BY kind) SELECT doc_id, round(coalesce(trust, 1.0), 6) AS source_trust FROM documents LEFT JOIN k ON kind = source")
def trusted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").select("doc_id", "source")
    return library.source_trust(items, _sources(spark, sf_dir), F.lit(1.0)).select("doc_id", F.round("source_trust", 6).alias("source_trust"))


@query(f"""{ITEMS}, c AS (SELECT doc_id, list_distinct(['new', 'q' || quality]) AS tags FROM labels) SELECT id, array_to_string(list_sort(coalesce(c.tags, items.tags)), ',') AS tags FROM items LEFT JOIN c USING (doc_id)""")
def tag_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.concat(F.lit("q"), F.col("quality").cast("string"))
    changes = table(spark, sf_dir, "labels").select(F.format_string("d%08d", "doc_id").alias("id"), F.array(F.lit(" new "), F.lit(""), q, q, F.lit("new")).alias("tags"))
    return library.with_tags(items_of(spark, sf_dir), changes).select("id", F.array_join(F.sort_array("tags"), ",").alias("tags"))


@query(f"""{ITEMS}, x AS (SELECT *, state = 'trash' AND published_ms <= {900 * HOUR} - 2592000000 AS gone FROM items)
  SELECT id, CASE WHEN twin AND NOT (SELECT gone FROM x WHERE id = 'd00000000') THEN 'd00000000' END AS duplicate_of FROM x WHERE NOT gone""")
def trash_emptied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingestion.empty_trash(full_items(spark, sf_dir), 900 * HOUR).select("id", "duplicate_of")


@query("SELECT printf('d%08d', i) AS id, CAST(row_number() OVER () - 1 AS INTEGER) AS turn FROM (SELECT unnest([41, 7, 19]) AS i)")
def rows_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = filters.in_order(items_of(spark, sf_dir), ["d00000041", "unknown", "d00000007", "d00000019"])
    return wanted.select("id").withColumn("turn", F.monotonically_increasing_id()).groupBy().agg(F.collect_list("id").alias("ids")).select(F.posexplode("ids").alias("turn", "id"))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN source NOT IN ('x', 'web', 'rss') THEN 'invalid source' END, CASE WHEN doc_id % 11 = 10 THEN 'invalid kind' END, CASE WHEN length(text) > 2000 THEN 'invalid title' END], lambda x: x IS NOT NULL), ',') AS invalid,
  CASE WHEN trim(text) = '' THEN 'no text' WHEN length(trim(text || chr(10) || substr(text, 1, 20))) < 12 THEN 'too short' WHEN contains(lower(text || chr(10) || substr(text, 1, 20)), 'license') THEN 'muted keyword: license' WHEN doc_id % 50 = 7 THEN 'muted author' END AS reason FROM documents""")
def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    none = F.lit(None).cast("string")
    row = {"url": F.lit("https://example.org/x"), "source": F.col("source"), "kind": F.when(F.col("doc_id") % 11 == 10, "tape").otherwise("post"), "state": none, "title": F.col("text"), "summary": F.substring("text", 1, 20), "content": none, "tags": F.array(F.lit("t")), "media": F.array(), "handle": F.concat(F.lit("@A"), (F.col("doc_id") % 50).cast("string"))}
    return d.select("doc_id", F.array_join(violations(row), ",").alias("invalid"), filters.rejection(row, ("License ", "z"), ("@a7",)).alias("reason"))


@query("""WITH o AS (SELECT doc_id, source, lang FROM documents WHERE doc_id % 7 <> 3), n AS (SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'moved' ELSE source END AS source, CASE WHEN quality = 0 THEN NULL ELSE lang END AS lang FROM documents d LEFT JOIN labels USING (doc_id) WHERE d.doc_id % 5 <> 2)
  SELECT coalesce(o.doc_id, n.doc_id) AS id, CASE WHEN o.doc_id IS NULL THEN 'created' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'updated' END AS change FROM o FULL JOIN n ON o.doc_id = n.doc_id WHERE o.doc_id IS NULL OR n.doc_id IS NULL OR o.source IS DISTINCT FROM n.source OR o.lang IS DISTINCT FROM n.lang""")
def item_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "lang")
    graded = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    new = d.filter("id % 5 <> 2").join(graded, "id", "left").select("id", F.when(F.col("toxic") == 1, "moved").otherwise(F.col("source")).alias("source"), F.when(F.col("quality") == 0, None).otherwise(F.col("lang")).alias("lang"))
    return library.changes(d.filter("id % 7 <> 3"), new, ["source", "lang"])


@query(f"""WITH l AS (SELECT event_id AS seq, {EVENT_MS} AS ts_ms, event_type AS type, user_id FROM events), n AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS k, conv_id, turn FROM conversations)
  SELECT seq, ts_ms, type, 'u' || user_id AS item_id FROM l UNION ALL SELECT (SELECT max(seq) FROM l) + k, conv_id * 1000 + turn, 'asked', 'c' || conv_id FROM n""")
def ledger_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    ledger = _events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.col("at_ms").alias("ts_ms"), F.col("event_type").alias("type"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("item_id"), none.alias("call_id"), none.alias("value"))
    actions = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ts_ms"), F.lit("asked").alias("type"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("item_id"), none.alias("call_id"), none.alias("value"))
    return library.appended(ledger, actions).select("seq", "ts_ms", "type", "item_id")


# Export.


@query("""SELECT '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<opml version="2.0">' || chr(10) || '  <head><title>docloom sources</title></head>' || chr(10) || '  <body>' || chr(10) ||
  string_agg('    <outline type="rss" text="' || s_name || ' &lt;&amp;&quot;" title="' || s_name || ' &lt;&amp;&quot;" xmlUrl="https://feeds.example/?a=1&amp;b=' || s_suppkey || '"/>', chr(10) ORDER BY 'https://feeds.example/?a=1&b=' || s_suppkey) || chr(10) || '  </body>' || chr(10) || '</opml>' || chr(10) AS opml FROM supplier""")
def export_opml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.opml(_sources(spark, sf_dir).withColumns({"kind": F.lit("rss"), "label": F.concat("label", F.lit(' <&"'))}))


# Display and text.


def _half(x: str) -> str:
    return f"CAST(floor({x} + 0.5) AS BIGINT)"


@query(f"""SELECT o_orderkey, CASE WHEN s < 45 THEN 'now' WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN {_half('s / 60.0')} || 'm' WHEN s < 86400 THEN {_half('s / 3600.0')} || 'h' WHEN s < 604800 THEN {_half('s / 86400.0')} || 'd' WHEN s < 2592000 THEN {_half('s / 604800.0')} || 'w'
  WHEN s < 31536000 THEN {_half('s / 2592000.0')} || 'mo' ELSE {_half('s / 31536000.0')} || 'y' END AS ago, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN {_half('s / 60.0')} || 'm' WHEN {_half('(s % 3600) / 60.0')} = 0 THEN (s // 3600) || 'h' ELSE (s // 3600) || 'h ' || {_half('(s % 3600) / 60.0')} || 'm' END AS lasting,
  CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', floor(b / 1024.0 * 10 + 0.5) / 10) WHEN b < 1073741824 THEN printf('%.1f MB', floor(b / 1048576.0 * 10 + 0.5) / 10) ELSE printf('%.1f GB', floor(b / 1073741824.0 * 10 + 0.5) / 10) END AS size,
  strftime(make_timestamp((1700000000000 + o_orderkey * 61000) * 1000), '%Y-%m-%d %H:%M') AS at, (o_orderkey % 3) || CASE WHEN o_orderkey % 3 = 1 THEN ' item' ELSE ' items' END AS items FROM (SELECT o_orderkey, o_orderkey * 997 AS s, o_orderkey * o_orderkey AS b FROM orders)""")
def display_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    now = F.lit(10**15).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", display.time_ago(now - n * 997_000, now).alias("ago"), display.format_duration(n * 997).alias("lasting"), display.format_bytes(n * n).alias("size"), display.format_datetime(F.lit(1_700_000_000_000) + n * 61_000).alias("at"), display.plural(n % 3, "item").alias("items"))


def _fnv(codes: str, offset: int, prime: int, mask: int) -> str:
    return f"list_reduce(list_prepend({offset}::HUGEINT, {codes}), lambda h, x: (xor(h, x) * {prime}::HUGEINT) & {mask}::HUGEINT)"


def _codes(s: str) -> str:
    return f"list_transform(string_split({s}, ''), lambda c: unicode(c)::HUGEINT)"


_FNV64 = (similarity.FNV64_OFFSET, similarity.FNV64_PRIME, (1 << 64) - 1)


def _hex(h: str) -> str:
    return f"printf('%08x%08x', CAST({h} >> 32 AS BIGINT), CAST({h} & 4294967295::HUGEINT AS BIGINT))"


@query(f"""SELECT c_custkey, trim(regexp_replace(lower(c_name || ' ' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '-') AS slug, upper(substr(c_name, 1, 1) || substr(c_mktsegment, 1, 1)) AS letters, CAST({_fnv(_codes('c_name'), 2166136261, 16777619, 0xFFFFFFFF)} % 360 AS INTEGER) AS hue,
  {_hex('f')} AS fnv, CASE WHEN c_custkey % 2 = 0 THEN 'Hacker News' ELSE 'unknown' END AS label FROM (SELECT *, {_fnv(_codes('c_name'), *_FNV64)} AS f FROM customer)""")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.concat_ws(" ", "c_name", "c_mktsegment")
    source = F.when(F.col("c_custkey") % 2 == 0, "hackernews").otherwise("unknown")
    return table(spark, sf_dir, "customer").select("c_custkey", text.slugify(both).alias("slug"), display.initials(both).alias("letters"), display.string_hue(F.col("c_name")).alias("hue"), similarity.fnv1a64(F.col("c_name")).alias("fnv"), display.labelled(source, display.SOURCE_LABELS).alias("label"))


@query("SELECT doc_id, sha256(regexp_replace(text, '(license|the)', '<mark>\\1</mark>', 'gi')) AS marked FROM documents")
def marked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", F.sha2(text.highlighted(F.col("text"), ["the", "license", ""]), 256).alias("marked"))


@query("""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '^\\s*([-*•]|[0-9]+[.)])\\s*', ''))), lambda x: length(x) BETWEEN 8 AND 240)[1:5], chr(10)) AS lines FROM documents""")
def takeaway_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", F.array_join(text.takeaways(F.col("text")), "\n").alias("lines"))


@query("""WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#:]+)', 1)), '^www\\.', '') || CASE WHEN regexp_extract(url, '://[^/?#]+(/[^?#]*)', 1) = '/' THEN '' ELSE regexp_extract(url, '://[^/?#]+(/[^?#]*)', 1) END AS s FROM pages)
  SELECT page_id, CASE WHEN length(s) > 48 THEN substr(s, 1, 47) || '…' ELSE s END AS shown, true AS same FROM h""")
def display_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    tracked = F.concat(u, F.when(F.contains(u, F.lit("?")), "&").otherwise("?"), F.lit("utm_source=feed"))
    return table(spark, sf_dir, "pages").select("page_id", urls.display_url(u).alias("shown"), urls.same_content(u, tracked).alias("same"))


@query("""WITH p AS (SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
  SELECT vec_id, round(list_cosine_similarity(x, y), 6) AS cosine, round(list_sum(list_transform(x, lambda v: v * 3.0 / (3.0 * sqrt(list_dot_product(x, x))))), 5) AS normal FROM p""")
def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    unit = similarity.normalise(F.transform("embedding", lambda x: x * 3))
    return pairs.select("vec_id", F.round(similarity.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"), F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("normal"))


# SQL of queries registered elsewhere.

_SIMHASH = f"""WITH d AS (SELECT doc_id, {TOKENS} AS t FROM documents), o AS (SELECT doc_id, unnest(t) AS f, 1 AS w FROM d UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || chr(1) || t[i + 1])), 2 FROM d),
  g AS (SELECT doc_id, f, sum(w) AS w FROM o GROUP BY ALL), u AS (SELECT f, CAST({_fnv(_codes('f'), *_FNV64)} AS UBIGINT) AS h FROM (SELECT DISTINCT f FROM g)),
  b AS (SELECT doc_id, i, sum(CASE WHEN (h >> i) & 1::UBIGINT = 1 THEN w ELSE -w END) > 0 AS one FROM g JOIN u USING (f), (SELECT unnest(range(64))::UBIGINT AS i) GROUP BY doc_id, i),
  v AS (SELECT doc_id, sum(CASE WHEN one THEN 1::HUGEINT << CAST(i AS INTEGER) ELSE 0::HUGEINT END) AS v FROM b GROUP BY doc_id), s AS (SELECT d.doc_id, coalesce(v, 0::HUGEINT) AS v FROM d LEFT JOIN v USING (doc_id))"""
SQL["simhash_docs"] = f"""{_SIMHASH}, x AS (SELECT doc_id, {_hex('v')} AS simhash FROM s) SELECT doc_id, simhash, array_to_string(list_transform(range(4), lambda i: i || ':' || substr(simhash, CAST(4 * i + 1 AS BIGINT), 4)), ',') AS bands FROM x"""
SQL["near_duplicates"] = f"""{_SIMHASH}, c AS (SELECT v, min(doc_id) AS a FROM s WHERE v <> 0 GROUP BY v) SELECT a, doc_id AS b, 0 AS distance FROM c JOIN s USING (v) WHERE doc_id <> a
  UNION ALL SELECT l.a, r.a, CAST(bit_count(xor(l.v, r.v)) AS INTEGER) FROM c l JOIN c r ON l.a < r.a WHERE bit_count(xor(l.v, r.v)) <= 3"""
SQL["known_near_duplicates"] = f"""{_SIMHASH} SELECT a.doc_id AS id, arg_min(b.doc_id, (bit_count(xor(a.v, b.v)), b.doc_id)) AS match, CAST(min(bit_count(xor(a.v, b.v))) AS INTEGER) AS distance
  FROM s a JOIN s b ON a.doc_id <> b.doc_id AND bit_count(xor(a.v, b.v)) <= 3 WHERE a.v <> 0 AND b.v <> 0 GROUP BY a.doc_id"""
SQL["dedup_canonical"] = f"""{_SIMHASH.replace("WITH d", "WITH RECURSIVE d")}, numbered AS MATERIALIZED (SELECT doc_id AS id, v, row_number() OVER (ORDER BY doc_id) AS i FROM s),
  r AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS id, NULL::BIGINT AS duplicate_of, []::STRUCT(id BIGINT, v HUGEINT)[] AS known UNION ALL SELECT i, id, twin, CASE WHEN twin IS NULL AND v <> 0 THEN list_append(known, {{'id': id, 'v': v}}) ELSE known END
    FROM (SELECT o.i, o.id, o.v, known, list_min(list_transform(list_filter(known, lambda c: o.v <> 0 AND bit_count(xor(c.v, o.v)) <= 3), lambda c: {{'d': bit_count(xor(c.v, o.v)), 'id': c.id}})).id AS twin FROM r JOIN numbered o ON o.i = r.i + 1))
  SELECT id, duplicate_of FROM r WHERE i > 0"""
SQL["stream_sliding"] = """WITH w AS (SELECT time_bucket(INTERVAL '3 hours', ts, TIMESTAMP '1970-01-01') - INTERVAL '3 hours' * k AS s, event_type FROM events, range(2) t(k)), g AS (SELECT s, event_type, count(*) AS n FROM w GROUP BY ALL), m AS (SELECT max(ts) - INTERVAL '1 hour' AS late FROM events)
  SELECT epoch(s) AS start_sec, event_type, n FROM g, m WHERE s + INTERVAL '6 hours' <= date_trunc('milliseconds', late)"""
SQL["stream_session"] = """WITH e AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '30 minutes' AS new FROM events), i AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e),
  g AS (SELECT user_id, k, min(ts) AS s, max(ts) AS e, count(*) AS n FROM i GROUP BY user_id, k), m AS (SELECT max(ts) - INTERVAL '1 hour' AS late FROM events) SELECT epoch(s) AS start_sec, user_id, n FROM g, m WHERE g.e + INTERVAL '30 minutes' <= date_trunc('milliseconds', late)"""
SQL["export_markdown"] = f"""{ITEMS} SELECT id, concat_ws(chr(10) || chr(10), '## [' || substr(text, 1, 60) || '](https://example.org/' || doc_id || ')', source || ' · ' || handle || ' · ' || strftime(make_timestamp(published_ms * 1000), '%Y-%m-%d') || ' · score ' || CAST(score AS INTEGER),
  nullif(trim(substr(text, 1, 300)), ''), 'Tags: ' || array_to_string(tags, ', ')) AS section FROM items"""
