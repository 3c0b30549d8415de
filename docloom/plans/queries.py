"""The registered queries of the engine's own operators, over the driver tables, with the DuckDB SQL of those that SQL can express.

The tables have no items, so one is laid over the documents: identifiers, states, tags and times are simple functions of doc_id.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import display, scoring, similarity, text, urls
from ..operators import analytics, export, filters, library, matching, ranking, terms
from ..operators.storage import spread
from ..schema import KINDS, STATES, SearchQuery
from ..streaming import sessions, sliding, tumbling, unique_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
HOUR = 3_600_000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of texts, for queries that compute on them."""
    return spread(table(spark, sf_dir, name))


def items_of(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    d = docs if docs is not None else table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    pick = lambda names, c: F.element_at(F.array(*(F.lit(x) for x in names)), (c % len(names) + 1).cast("int"))
    return d.select(
        F.format_string("d%08d", n).alias("id"),
        F.concat(F.lit("https://example.org/"), n.cast("string")).alias("url"),
        F.col("source"),
        pick(KINDS, n).alias("kind"),
        F.substring("text", 1, 60).alias("title"),
        F.col("text").alias("content"),
        F.substring("text", 1, 300).alias("summary"),
        "lang",
        F.struct(F.lit(None).cast("string").alias("name"), F.concat(F.lit("a"), (n % 50).cast("string")).alias("handle")).alias("author"),
        F.array(F.concat(F.lit("t"), (n % 3).cast("string")), F.concat(F.lit("t"), (n % 5 + 3).cast("string"))).alias("tags"),
        F.array(F.col("lang"), F.concat(F.lit("p"), (n % 4).cast("string"))).alias("topics"),
        F.array().cast("array<string>").alias("media"),
        (n * HOUR).alias("published_ms"),
        (n * HOUR).alias("captured_ms"),
        (n * 37 % 101).cast("double").alias("score"),
        F.struct((n % 29 / 29).alias("velocity")).alias("breakdown"),
        pick(STATES, n).alias("state"),
        (n % 13 == 0).alias("starred"),
        F.when(n % 2 == 0, n * HOUR).alias("read_ms"),
        F.when(n % 17 == 16, "d00000000").alias("duplicate_of"),
    )


ITEMS = f"""WITH items AS (SELECT doc_id, printf('d%08d', doc_id) AS id, source, lang, text,
  ['{"','".join(KINDS)}'][CAST(doc_id % 10 AS INT) + 1] AS kind, 'a' || (doc_id % 50) AS handle,
  ['t' || (doc_id % 3), 't' || (doc_id % 5 + 3)] AS tags, [lang, 'p' || (doc_id % 4)] AS topics, doc_id * 3600000 AS published_ms,
  CAST(doc_id * 37 % 101 AS DOUBLE) AS score, doc_id % 29 / 29.0 AS velocity, ['{"','".join(STATES)}'][CAST(doc_id % 5 AS INT) + 1] AS state,
  doc_id % 13 = 0 AS starred, CASE WHEN doc_id % 2 = 0 THEN doc_id * 3600000 END AS read_ms, doc_id % 17 = 16 AS twin FROM documents)"""
STOP = "('" + "','".join(sorted(text.STOPWORDS_EN)) + "')"
TOKENS = f"list_filter(regexp_extract_all(lower(text), '{text.LATIN_TOKEN}'), lambda t: length(t) >= 2 AND t NOT IN {STOP})"
ALL_TOKENS = f"list_filter(regexp_extract_all(lower(text), '{text.LATIN_TOKEN}'), lambda t: length(t) >= 2)"


@query(f"{ITEMS} SELECT id, score, source FROM items WHERE NOT twin AND state IN ('inbox', 'saved') AND score >= 20 ORDER BY score DESC, published_ms DESC, id LIMIT 21 OFFSET 10")
def browse_signal_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = SearchQuery(states=("inbox", "saved"), min_score=20, limit=20, cursor=filters.encode_cursor(10))
    return filters.browse(items_of(spark, sf_dir), q).select("id", "score", "source")


@query(f"{ITEMS} SELECT id, velocity FROM items WHERE NOT twin AND state <> 'trash' AND lang = 'en' AND read_ms IS NULL ORDER BY velocity DESC, score DESC, id LIMIT 51")
def browse_by_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.browse(items_of(spark, sf_dir), SearchQuery(lang="en", unread=True, sort="velocity")).select("id", F.col("breakdown.velocity").alias("velocity"))


@query(f"{ITEMS} SELECT id FROM items WHERE NOT twin AND state <> 'trash' AND list_contains(tags, 't1') AND list_contains(tags, 't5') AND list_contains(topics, 'en') AND published_ms BETWEEN 36000000 AND 3600000000")
def filter_tags_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.matching(items_of(spark, sf_dir), SearchQuery(tags=("t1", "t5"), topics=("en",), from_ms=36_000_000, to_ms=3_600_000_000)).select("id")


@query(f"{ITEMS} SELECT id, score FROM items WHERE NOT twin AND state <> 'trash' AND starred AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def collection_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "labels").filter("quality = 1").select(F.lit("good").alias("collection_id"), F.format_string("d%08d", "doc_id").alias("item_id"))
    return filters.matching(items_of(spark, sf_dir), SearchQuery(collection_id="good", starred=True), members).select("id", "score")


@query("SELECT sha256(url) AS url_hash, CAST(min(page_id) AS VARCHAR) AS id FROM pages GROUP BY url")
def check_known_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    known = pages.groupBy("url").agg(F.min("page_id").cast("string").alias("id")).select(urls.url_hash(F.col("url")).alias("url_hash"), "id")
    asked = pages.select(F.explode(F.array("url", F.concat("url", F.lit("#unknown")))).alias("u")).select(urls.url_hash(F.col("u")).alias("url_hash"))
    return filters.known_urls(known, asked)


@query("""SELECT count(*) AS items, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS saved, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS "read",
  CAST(sum(CASE WHEN event_type = 'view' THEN 60 ELSE 0 END) AS BIGINT) AS reading_sec, count(DISTINCT user_id) AS sources, round(avg(value), 1) AS mean_score FROM events""")
def totals_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return analytics.totals(e, F.col("user_id"), F.col("value"), F.col("event_type") == "purchase", F.col("event_type") == "view", F.lit(60))


EVENT_MS = "(epoch_us(ts) // 1000)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    # Zone-less times are read as UTC by arithmetic on them, whatever the session's zone.
    return e.withColumn("at_ms", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").cast("long")).withColumn("at_ms", F.floor(F.col("at_ms") / 1000).cast("long"))


@query(f"SELECT CAST(floor({EVENT_MS} / 21600000.0) * 21600000 AS BIGINT) AS bucket, count(*) AS n, round(avg(value), 6) AS mean_score FROM events GROUP BY 1")
def volume_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.volume(_events(spark, sf_dir), F.col("at_ms"), 6 * HOUR, F.col("value")).withColumn("mean_score", F.round("mean_score", 6))


@query("SELECT source, count(*) AS n, round(avg(n_chars), 6) AS mean_score FROM documents GROUP BY source")
def by_source_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.by_key(table(spark, sf_dir, "documents"), F.col("source"), F.col("n_chars"), "source").withColumn("mean_score", F.round("mean_score", 6))


@query("""SELECT author, n, round(mean_score, 6) AS mean_score, round(mean_score * least(n, 8), 6) AS weight FROM (SELECT c_mktsegment || ':' || c_nationkey AS author, count(*) AS n, avg(o_totalprice) AS mean_score
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) ORDER BY mean_score * least(n, 8) DESC, author LIMIT 12""")
def top_authors_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    top = analytics.top_authors(rows, F.concat_ws(":", "c_mktsegment", "c_nationkey"), F.col("o_totalprice"))
    return top.withColumns({"mean_score": F.round("mean_score", 6), "weight": F.round("weight", 6)})


@query("SELECT CAST(floor(p_retailprice / 10) * 10 AS INTEGER) AS bin, count(*) AS n FROM part GROUP BY 1")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.histogram(table(spark, sf_dir, "part"), F.col("p_retailprice"), 10)


WINDOW_FROM, WINDOW_TO = 1_705_276_800_000, 1_706_486_400_000  # 2024-01-15 to 2024-01-29


@query(f"""WITH b AS (SELECT event_type || ':' || (user_id % 7) AS topic, {EVENT_MS} AS ms FROM events), g AS (SELECT topic, count(*) FILTER (ms >= {WINDOW_FROM} AND ms < {WINDOW_TO}) AS total,
  count(*) FILTER (ms >= {2 * WINDOW_FROM - WINDOW_TO} AND ms < {WINDOW_FROM}) AS previous FROM b GROUP BY topic), t AS (SELECT * FROM g WHERE total > 0 ORDER BY total DESC, topic LIMIT 20)
  SELECT topic, total, previous, round((total + 2) / (previous + 2), 2) AS momentum, previous = 0 AS is_new, round(round((total + 2) / (previous + 2), 2) * ln(1 + total), 6) AS heat FROM t""")
def topic_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return analytics.topic_trends(e, F.concat_ws(":", "event_type", F.col("user_id") % 7), F.col("at_ms"), WINDOW_FROM, WINDOW_TO).withColumn("heat", F.round("heat", 6))


@query(f"SELECT event_type AS key, CAST(floor({EVENT_MS} / 86400000.0) * 86400000 AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY 1, 2")
def topic_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.series(_events(spark, sf_dir), F.col("event_type"), F.col("at_ms"), 24 * HOUR)


@query("SELECT event_type, event_id, turn FROM (SELECT event_type, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS INTEGER) AS turn FROM events) WHERE turn <= 5")
def topic_samples_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.top_per(table(spark, sf_dir, "events"), "event_type", [F.desc("value"), F.asc("event_id")], 5).select("event_type", "event_id", "turn")


@query("SELECT CAST(dayofweek(ts) AS INTEGER) AS dow, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1, 2")
def activity_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.heatmap(table(spark, sf_dir, "events"), F.col("ts"), F.col("event_type"), ("view", "purchase"))


@query("""SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'signup') AS captured, count(*) FILTER (event_type = 'purchase') AS saved, count(*) FILTER (event_type = 'view') AS "read" FROM events GROUP BY 1""")
def daily_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.daily(table(spark, sf_dir, "events"), F.col("ts"), F.col("event_type"), {"captured": "signup", "saved": "purchase", "read": "view"})


@query(f"""{ITEMS}, f AS (SELECT * FROM items WHERE NOT twin AND state <> 'trash'), v AS (SELECT 'source' AS facet, source AS value, 12 AS most FROM f UNION ALL SELECT 'topic', unnest(topics), 16 FROM f UNION ALL SELECT 'tag', unnest(tags), 16 FROM f UNION ALL SELECT 'author', handle, 12 FROM f),
  g AS (SELECT facet, value, most, count(*) AS n FROM v GROUP BY ALL) SELECT facet, value, n FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS turn FROM g) WHERE turn <= most""")
def facets_four_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = filters.matching(items_of(spark, sf_dir), SearchQuery())
    return analytics.facets(fits, {"source": (F.col("source"), 12), "topic": (F.col("topics"), 16), "tag": (F.col("tags"), 16), "author": (F.col("author.handle"), 12)})


@query(f"""{ITEMS} SELECT {", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in STATES)}, count(*) FILTER (read_ms IS NULL) AS unread, count(*) FILTER (starred) AS starred FROM items""")
def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.state_counts(items_of(spark, sf_dir), F.col("state"), STATES, {"unread": F.col("read_ms").isNull(), "starred": F.col("starred")})


@query(f"""{ITEMS} SELECT id, handle, score FROM (SELECT *, row_number() OVER (PARTITION BY handle ORDER BY score DESC, id) AS turn FROM items WHERE NOT twin) WHERE turn <= 2 ORDER BY score DESC, id LIMIT 40""")
def author_cap_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items_of(spark, sf_dir).filter("duplicate_of is null")
    return ranking.capped(rows, F.col("author.handle"), [F.desc("score"), F.asc("id")], 2, 40).select("id", F.col("author.handle").alias("handle"), "score")


@query(f"""{ITEMS}, b AS (SELECT * FROM items WHERE NOT twin AND state <> 'trash' AND published_ms >= {500 * HOUR} AND published_ms <= {900 * HOUR} ORDER BY score DESC, id LIMIT 96)
  SELECT id, score FROM (SELECT *, row_number() OVER (PARTITION BY handle ORDER BY score DESC, id) AS turn FROM b) WHERE turn <= 2 ORDER BY score DESC, id LIMIT 24""")
def digest_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .digest import select_items

    return select_items(items_of(spark, sf_dir), 900 * HOUR, hours=400).select("id", "score")


@query()
def digest_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .digest import generate

    items = items_of(spark, sf_dir).withColumn("embedding", F.lit(None).cast("array<float>"))
    return generate(items, 900 * HOUR, hours=400)


@query(f"SELECT t AS term, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest({TOKENS}) AS t FROM documents) GROUP BY t")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_counts(texts(spark, sf_dir), "doc_id", F.col("text"))


@query(f"""WITH k AS (SELECT doc_id, {TOKENS} AS toks FROM documents), e AS (SELECT doc_id, len(toks) AS size, unnest(toks) AS term, unnest(range(len(toks))) AS pos FROM k),
  g AS (SELECT doc_id, term, size, count(*) AS n, min(pos) AS first FROM e GROUP BY ALL), w AS (SELECT *, n / size * (1 - first / size * 0.45) * CASE WHEN length(term) >= 6 THEN 1.15 ELSE 1.0 END * ln(1 + n) AS w FROM g),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, first) AS rank FROM w) SELECT doc_id, CAST(rank AS INTEGER) AS rank, term, round(w / max(w) OVER (PARTITION BY doc_id), 6) AS weight FROM r WHERE rank <= 3""")
def keywords_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.keyword_table(texts(spark, sf_dir), "doc_id", F.col("text"), 3).withColumn("weight", F.round("weight", 6))


@query("""WITH s AS (SELECT doc_id, regexp_replace(substr(text, 1, 2000), '\\s', '', 'g') AS t FROM documents) SELECT doc_id, CASE WHEN length(t) = 0 THEN 'und' WHEN length(regexp_replace(t, '[^A-Za-z]', '', 'g')) / greatest(length(t), 1) > 0.4 THEN 'en' ELSE 'und' END AS detected FROM s""")
def detect_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", text.detect_lang(F.col("text")).alias("detected"))


@query("SELECT doc_id, CAST(greatest(CASE WHEN trim(text) <> '' THEN 5 ELSE 0 END, floor(len(regexp_extract_all(text, '\\S+')) / 238 * 60 + 0.5)) AS INTEGER) AS seconds FROM documents")
def reading_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", text.reading_time_sec(F.col("text")).alias("seconds"))


def _re2(pattern: str) -> str:
    """A pattern without lookaround, for DuckDB."""
    return pattern.replace(text.WORD_START, "(?:^|[^A-Za-z0-9_])").replace(text.WORD_END, "(?:$|[^A-Za-z0-9_])").replace("'", "''")


_HITS = [f"CASE WHEN regexp_matches(h, '{_re2(p)}') THEN {w} ELSE 0.0 END" for p, w, _ in text.NOISE_PATTERNS]
NOISE = f"""least(1.0, {" + ".join(_HITS)} + CASE WHEN emoji > 0.035 THEN least(0.2, (emoji - 0.035) * 4) ELSE 0.0 END + CASE WHEN tags >= 6 THEN least(0.2, (tags - 5) * 0.03) ELSE 0.0 END
  + CASE WHEN letters > 30 AND upper / greatest(letters, 1) > 0.55 THEN 0.12 ELSE 0.0 END + CASE WHEN marks >= 5 THEN least(0.1, marks * 0.015) ELSE 0.0 END)"""
NOISE_FROM = """(SELECT *, len(regexp_extract_all(h, '[\U0001f300-\U0001faff☀-➿]')) / greatest(length(h), 1) AS emoji, len(regexp_extract_all(h, '#[^\\s#]+')) AS tags, length(regexp_replace(h, '[^A-Za-z]', '', 'g')) AS letters,
  length(regexp_replace(h, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(h, '[^!！]', '', 'g')) AS marks FROM (SELECT *, substr(text, 1, 4000) AS h FROM documents))"""


@query(f"SELECT doc_id, round({NOISE}, 6) AS noise FROM {NOISE_FROM}")
def noise_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", F.round(text.noise(F.col("text"))["score"], 6).alias("noise"))


_MARKS = [f"CASE WHEN regexp_matches(text, '{_re2(p)}') THEN {w} ELSE 0.0 END" for p, w in text.DEPTH_MARKERS]
DEPTH = f"""CASE WHEN n = 0 THEN 0.0 ELSE least(1.0, least(1.0, ln(1 + n) / ln(901.0)) * 0.4 + {" + ".join(_MARKS)} + CASE WHEN kind IN ('paper', 'repo') THEN 0.12 WHEN kind IN ('article', 'thread') THEN 0.06 ELSE 0.0 END
  + CASE WHEN n > 40 THEN least(1.0, greatest(0.0, u / n - 0.35)) * 0.25 ELSE 0.0 END) END"""
DEPTH_FROM = f"(SELECT *, len({ALL_TOKENS}) AS n, len(list_distinct({TOKENS})) AS u FROM items)"


@query(f"{ITEMS} SELECT id, round({DEPTH}, 6) AS depth FROM {DEPTH_FROM}")
def depth_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items_of(spark, sf_dir, texts(spark, sf_dir)).select("id", F.round(scoring.depth(F.col("content"), F.col("kind"), F.lit(0)), 6).alias("depth"))


@query("""WITH c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^#{1,6}\\s+', '', 'g'), '[*_`>]', '', 'g'), '\\s+', ' ', 'g')) AS t FROM documents),
  h AS (SELECT *, substr(t, 1, 120) AS h FROM c), s AS (SELECT *, length(h) - strpos(reverse(h), ' ') AS sp FROM h)
  SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE rtrim(CASE WHEN strpos(h, ' ') > 0 AND sp > 72 THEN substr(h, 1, sp) ELSE h END) || '…' END AS excerpt FROM s""")
def excerpt_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", text.excerpt(F.col("text"), 120).alias("excerpt"))


@query("""WITH p AS (SELECT doc_id, text, least(nullif(strpos(lower(text), 'license'), 0), nullif(strpos(lower(text), 'idiot'), 0)) - 1 AS pos FROM documents), b AS (SELECT *, greatest(0, pos - 40) AS s, least(length(text), pos + 40) AS e FROM p WHERE pos IS NOT NULL)
  SELECT doc_id, CASE WHEN s > 0 THEN '…' ELSE '' END || trim(regexp_replace(substr(text, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT)), '\\s+', ' ', 'g')) || CASE WHEN e < length(text) THEN '…' ELSE '' END AS snippet FROM b""")
def snippet_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir).filter(F.lower("text").rlike("license|idiot"))
    return d.select("doc_id", text.snippet(F.col("text"), ["license", "idiot"], 40).alias("snippet"))


def _html_sql(column: str) -> str:
    out = column
    for p in ("(?is)<script\\b.*?</script>", "(?is)<style\\b.*?</style>", "(?is)<noscript\\b.*?</noscript>", "(?s)<!--.*?-->"):
        out = f"regexp_replace({out}, '{p}', ' ', 'g')"
    out = f"regexp_replace({out}, '(?i)</?(?:{text.BLOCK_ELEMENTS})\\b[^>]*>', chr(10), 'g')"
    out = f"regexp_replace({out}, '<[^>]+>', '', 'g')"
    for name, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–")):
        out = f"replace({out}, '{name}', '{char}')"
    out = f"regexp_replace(regexp_replace({out}, '[ \\t ]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace(regexp_replace({out}, '(?m)^[^\\S\\n]+|[^\\S\\n]+$', '', 'g'), '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT page_id, sha256({_html_sql('html')}) AS text_sha256 FROM pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "pages").select("page_id", F.sha2(text.html_to_text(F.col("html")), 256).alias("text_sha256"))


_TRACKED = "('" + "','".join(sorted({t.lower() for t in urls.TRACKING} | {"s", "t"})) + "')"


@query(f"""WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#]+)', 1)), '^www\\.', '') AS host, regexp_extract(url, '://[^/?#]+(/[^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages),
  k AS (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN {_TRACKED} AND NOT starts_with(lower(x), 'utm_'))) AS kept FROM p)
  SELECT page_id, host, 'https://' || host || CASE WHEN length(path) > 1 AND ends_with(path, '/') THEN path[:-2] WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url FROM k""")
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "pages").select("page_id", urls.canonical_url("url").alias("c")).select("page_id", "c.host", "c.url")


@query("""WITH h AS (SELECT page_id, string_split(regexp_replace(lower(regexp_extract(url, '://([^/?#:]+)', 1)), '^www\\.', ''), '.') AS p FROM pages) SELECT page_id, CASE WHEN len(p) <= 2 THEN array_to_string(p, '.')
  WHEN array_to_string(p[-2:], '.') IN ('co.uk', 'com.cn', 'com.au', 'co.jp', 'co.kr', 'com.br', 'com.tw', 'ac.uk', 'org.uk') THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain FROM h""")
def root_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.root_domain(urls.host_of(F.col("url"))).alias("domain"))


@query("""SELECT o_orderkey, CASE WHEN abs(n) < 1000 THEN CAST(CAST(floor(n + 0.5) AS BIGINT) AS VARCHAR) WHEN abs(n) < 1e6 THEN CASE WHEN n / 1e3 >= 10 THEN CAST(CAST(floor(n / 1e3 + 0.5) AS BIGINT) AS VARCHAR) ELSE regexp_replace(printf('%.1f', n / 1e3), '\\.0$', '') END || 'K' ELSE '?' END AS shown,
  CASE WHEN s >= 80 THEN 'critical' WHEN s >= 62 THEN 'high' WHEN s >= 40 THEN 'medium' ELSE 'low' END AS band FROM (SELECT o_orderkey, o_totalprice AS n, o_orderkey % 100 AS s FROM orders)""")
def display_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", display.compact_number(F.col("o_totalprice")).alias("shown"), display.score_band(F.col("o_orderkey") % 100).alias("band"))


@query()
def simhash_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = texts(spark, sf_dir).select("doc_id", similarity.simhash(F.col("text")).alias("simhash"))
    return hashed.withColumn("bands", F.array_join(similarity.simhash_bands(F.col("simhash")), ","))


@query()
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = matching.saved(simhash_docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "simhash"))
    return matching.band_pairs(hashed)


@query()
def dedup_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = matching.saved(simhash_docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "simhash"))
    return matching.first_come(hashed.select("id", F.col("id").alias("seq")), fingerprints=hashed)


@query(f"""WITH a AS (SELECT doc_id, list_distinct({TOKENS}) AS t FROM documents), b AS (SELECT item_id, list_distinct({TOKENS}) AS t FROM benchmark),
  p AS (SELECT doc_id AS a, item_id AS b, len(list_intersect(a.t, b.t)) AS s, len(a.t) AS na, len(b.t) AS nb FROM a, b) SELECT a, b, round(s / (na + nb - s), 6) AS jaccard FROM p WHERE s > 0 AND s / (na + nb - s) >= 0.08""")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = texts(spark, sf_dir).select(F.col("doc_id").alias("id"), text.tokenize(F.col("text")).alias("tokens"))
    right = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), text.tokenize(F.col("text")).alias("tokens"))
    return terms.shared_terms(left, right, 0.08).withColumn("jaccard", F.round("jaccard", 6))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir)
    return d.select(F.format_string("d%08d", "doc_id").alias("id"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("body"))


BODY = {"body": 1.0}
_WORDS = ("the", "tion", "ere")


def _bm25(words: tuple[str, ...]) -> str:
    counts = ", ".join(f"len(list_filter(b, lambda x: starts_with(x, '{w}'))) AS t{i}" for i, w in enumerate(words))
    every = " AND ".join(f"t{i} > 0" for i in range(len(words)))
    frequency = ", ".join(f"count(*) FILTER (t{i} > 0) AS f{i}" for i in range(len(words)))
    score = " + ".join(f"greatest(ln((n - f{i} + 0.5) / (f{i} + 0.5)), 1e-6) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * length / mean))" for i in range(len(words)))
    return f"d AS (SELECT printf('d%08d', doc_id) AS id, regexp_extract_all(lower(text), '[a-z]+') AS b FROM documents), k AS (SELECT id, len(b) AS length, {counts} FROM d), s AS (SELECT count(*) AS n, avg(length) AS mean, {frequency} FROM k), bm AS (SELECT id, {score} AS score FROM k, s WHERE {every})"


@query(f"WITH {_bm25(_WORDS)} SELECT id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM bm ORDER BY rank LIMIT 25")
def bm25_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.keyword_search(_documents(spark, sf_dir), " ".join(_WORDS), 25, columns=BODY).withColumn("score", F.round("score", 6))


@query(f"""WITH {_bm25(_WORDS)}, kw AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM bm ORDER BY rank LIMIT 60), lg AS (SELECT printf('d%08d', doc_id) AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents ORDER BY rank LIMIT 60),
  u AS (SELECT id, 1.2 / (60 + rank) AS p, 1 AS k FROM kw UNION ALL SELECT id, 0.85 / (60 + rank), 0 FROM lg) SELECT id, round(sum(p), 9) AS fused, CASE WHEN max(k) = 1 AND min(k) = 0 THEN 'both' WHEN max(k) = 1 THEN 'keyword' ELSE 'semantic' END AS matched_by FROM u GROUP BY id""")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    longest = table(spark, sf_dir, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(60)
    longest = longest.select(F.format_string("d%08d", "doc_id").alias("id"), F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    keyword = ranking.keyword_search(_documents(spark, sf_dir), " ".join(_WORDS), 60, columns=BODY)
    return ranking.reciprocal_rank_fusion({"keyword": keyword, "semantic": longest}).withColumn("fused", F.round("fused", 9))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


_COSINE = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(f"""SELECT query_id, id, round(s, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, {_COSINE} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COSINE} DESC, b.vec_id) AS rank
  FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) WHERE rank <= 5""")
def vector_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return ranking.nearest_vectors(v, v.filter("id % 20 = 0"), 5).withColumn("similarity", F.round("similarity", 6))


@query(f"SELECT a.vec_id AS id, round(max({_COSINE}), 6) AS max_similarity FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id GROUP BY a.vec_id")
def novelty_maxsim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.max_similarity(_vectors(spark, sf_dir)).withColumn("max_similarity", F.round("max_similarity", 6))


@query("""WITH e AS (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings), m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM e GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS norm FROM m GROUP BY label)
  SELECT m.label, CAST(i AS INTEGER) AS i, round(x / norm, 6) AS x FROM m JOIN n ON m.label = n.label""")
def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.centroids(_vectors(spark, sf_dir), "label").select("label", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 6))


@query()
def mmr_diversify(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    near = ranking.nearest_vectors(v, v.filter("id % 20 = 0"), 40).select("query_id", "id", F.col("similarity").alias("fused"))
    return ranking.diversified(near.join(v.select("id", "embedding"), "id"), 0.7, 20)


NOW = 1_735_689_600_000
_ORDER_MS = "epoch_ms(o_orderdate)"


@query(f"""WITH o AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'x' WHEN 'F' THEN 'hackernews' ELSE 'github' END AS source, o_orderkey % 900 AS a, o_custkey % 60 AS b, o_totalprice AS followers, greatest(0.0, ({NOW} - {_ORDER_MS}) / 3600000.0) AS age FROM orders),
  u AS (SELECT *, CASE source WHEN 'x' THEN a + 4.0 * b WHEN 'hackernews' THEN a + 0.0 ELSE a * 0.0 + b * 0.0 END AS units, CASE source WHEN 'x' THEN 1200.0 WHEN 'hackernews' THEN 30.0 ELSE 40.0 END AS top FROM o)
  SELECT o_orderkey, round(CASE WHEN units <= 0 THEN 0.0 ELSE least(1.0, ln(1 + units / pow(age + 2, 0.8)) / ln(1 + top)) END, 6) AS velocity, round(0.55 * least(1.0, ln(1 + followers) / ln(2000001.0)) + 0.45 * (3.6 / 14), 6) AS authority, round(pow(0.5, age / 20000), 6) AS recency FROM u""")
def recency_velocity_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("ms", F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)").cast("long"))
    source = F.when(F.col("o_orderstatus") == "O", "x").when(F.col("o_orderstatus") == "F", "hackernews").otherwise("github")
    null = F.lit(None).cast("bigint")
    given = {"likes": F.when(source == "x", F.col("o_orderkey") % 900), "bookmarks": F.when(source == "x", F.col("o_custkey") % 60), "points": F.when(source == "hackernews", F.col("o_orderkey") % 900)}
    metrics = F.struct(*(given.get(c, null).alias(c) for c in scoring.COUNTERS))
    o = o.withColumns({"source": source, "metrics": metrics})
    now = F.lit(NOW).cast("long")
    return o.select(
        "o_orderkey",
        F.round(scoring.velocity(F.col("source"), F.col("metrics"), F.col("ms"), now), 6).alias("velocity"),
        F.round(scoring.authority(F.col("o_totalprice"), scoring.affinity(F.lit(3), F.lit(10)), F.lit(False)), 6).alias("authority"),
        F.round(scoring.recency(F.col("ms"), now, 20000), 6).alias("recency"),
    )


@query(f"""{ITEMS}, n AS (SELECT doc_id, {NOISE} AS noise FROM {NOISE_FROM}), s AS (SELECT d.id, {DEPTH} AS depth, noise, pow(0.5, greatest(0.0, (1200 - d.doc_id) * 1.0) / 36) AS recency FROM {DEPTH_FROM} d JOIN n ON d.doc_id = n.doc_id)
  SELECT id, CAST(floor(least(1.0, greatest(0.0, (0.0 * 0.22 + 0.0 * 0.13 + 0.5 * 0.26 + 1.0 * 0.14 + depth * 0.15 + recency * 0.1) / 1.0 * (1 - least(0.3, noise * 0.4)))) * 100 + 0.5) AS INTEGER) AS score FROM s""")
def rescore_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = items_of(spark, sf_dir, texts(spark, sf_dir))
    none = F.struct(*(F.lit(None).cast("bigint").alias(c) for c in scoring.COUNTERS))
    settings = scoring.Settings(now_ms=1200 * HOUR)
    found = scoring.with_scores(items, settings, F.lit("web"), F.col("kind"), F.col("content"), none, F.col("published_ms"), F.lit(None).cast("long"), F.lit(0.0), F.lit(False), F.lit(0), F.lit(None).cast("double"), F.lit(0.0), F.lit(0))
    return found.select("id", "score")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS turn FROM events) WHERE turn = 1")
def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.last_wins(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("""WITH o AS (SELECT sha256('https://example.org/' || doc_id) AS h, substr(text, 1, 60) AS title, ['t' || (doc_id % 3), 't' || (doc_id % 5 + 3)] AS tags, doc_id % 900 AS secs FROM documents),
  n AS (SELECT sha256('https://example.org/' || doc_id) AS h, CASE WHEN quality = 1 THEN 'graded ' || doc_id ELSE '' END AS title, ['graded', 't1'] AS tags, 450 AS secs FROM labels UNION ALL SELECT sha256('https://example.org/benchmark/' || item_id), substr(text, 1, 60), CAST(NULL AS VARCHAR[]), 5 FROM benchmark)
  SELECT coalesce(o.h, n.h) AS url_hash, coalesce(nullif(n.title, ''), o.title) AS title, array_to_string(list_sort(list_distinct(list_concat(coalesce(o.tags, []), coalesce(n.tags, [])))), ',') AS tags, CAST(greatest(coalesce(o.secs, n.secs), coalesce(n.secs, o.secs)) AS INTEGER) AS secs, CASE WHEN o.h IS NULL THEN 'new' ELSE 'old' END AS state FROM o FULL JOIN n ON o.h = n.h""")
def upsert_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ingestion import upserted

    old, new = _upsert_inputs(spark, sf_dir)
    return _upsert_columns(upserted(old, new))


def _upsert_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Items of all documents, and new rows: one for each labelled document, and one for each text of the benchmark."""
    from ..schema import ITEM

    def item(rows: DataFrame, **given) -> DataFrame:
        return rows.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ITEM))

    at = lambda path, c: F.concat(F.lit(f"https://example.org/{path}"), F.col(c))
    n = F.col("doc_id")
    tags = F.array(F.concat(F.lit("t"), (n % 3).cast("string")), F.concat(F.lit("t"), (n % 5 + 3).cast("string")))
    old = item(table(spark, sf_dir, "documents"), url_hash=urls.url_hash(at("", "doc_id")), title=F.substring("text", 1, 60), tags=tags, reading_time_sec=n % 900, state=F.lit("old"))
    graded = item(table(spark, sf_dir, "labels"), url_hash=urls.url_hash(at("", "doc_id")), title=F.when(F.col("quality") == 1, F.concat(F.lit("graded "), n)).otherwise(""), tags=F.array(F.lit("graded"), F.lit("t1")), reading_time_sec=F.lit(450), state=F.lit("new"))
    added = item(table(spark, sf_dir, "benchmark"), url_hash=urls.url_hash(at("benchmark/", "item_id")), title=F.substring("text", 1, 60), reading_time_sec=F.lit(5), state=F.lit("new"))
    return old, graded.union(added)


def _upsert_columns(items: DataFrame) -> DataFrame:
    return items.select("url_hash", "title", F.array_join(F.sort_array(F.coalesce("tags", F.array().cast("array<string>"))), ",").alias("tags"), F.col("reading_time_sec").alias("secs"), "state")


_ACTIONS = {"purchase": "item.save", "error": "item.trash", "signup": "item.shortlist", "click": "item.star", "view": "item.read"}


@query(f"""{ITEMS}, l AS (SELECT printf('d%08d', user_id) AS id, event_type, {EVENT_MS} AS ms, event_id FROM events), g AS (SELECT id, arg_max(CASE event_type WHEN 'purchase' THEN 'saved' WHEN 'error' THEN 'trash' ELSE 'shortlist' END, (ms, event_id)) FILTER (event_type IN ('purchase', 'error', 'signup')) AS st,
  bool_or(event_type = 'click') AS star, max(ms) FILTER (event_type = 'view') AS seen FROM l GROUP BY id) SELECT items.id, coalesce(st, state) AS state, CASE WHEN star THEN true ELSE starred END AS starred, coalesce(seen, read_ms) AS read_ms FROM items LEFT JOIN g ON items.id = g.id""")
def apply_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ingestion import apply_actions

    kinds = F.create_map(*(F.lit(x) for kv in _ACTIONS.items() for x in kv))
    ledger = _events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.col("at_ms").alias("ts_ms"), kinds[F.col("event_type")].alias("type"), F.format_string("d%08d", "user_id").alias("item_id"), F.col("event_id").cast("string").alias("call_id"), F.lit(None).cast("string").alias("value"))
    return apply_actions(items_of(spark, sf_dir), ledger).select("id", "state", "starred", "read_ms")


@query(f"""{ITEMS} SELECT count(*) AS items, count(*) FILTER (NOT twin) AS canonical, count(DISTINCT source) AS sources, min(published_ms) AS first_ms, max(published_ms) AS last_ms FROM items""")
def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.maintenance import stats

    return stats(items_of(spark, sf_dir).withColumn("embedding", F.lit(None).cast("array<float>"))).drop("vectors")


@query(f"{ITEMS} SELECT 'strong' AS search_id, count(*) AS n FROM items WHERE NOT twin AND state <> 'trash' AND score >= 50 AND published_ms > {300 * HOUR} UNION ALL SELECT 'french', count(*) FROM items WHERE NOT twin AND state <> 'trash' AND lang = 'fr' AND list_contains(tags, 't1')  AND published_ms > 0")
def saved_view_new_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    searches = [{"id": "strong", "query": '{"q": "ignored", "min_score": 50}', "last_seen_ms": 300 * HOUR}, {"id": "french", "query": '{"lang": "fr", "tags": ["t1"]}', "last_seen_ms": None}]
    return library.new_matches(items_of(spark, sf_dir), searches)


@query(f"""WITH e AS (SELECT event_id, user_id, {EVENT_MS} AS at FROM events WHERE event_type = 'purchase') SELECT a.event_id AS a, b.event_id AS b FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(a.at - b.at) <= 259200000""")
def echo_window_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).filter("event_type = 'purchase'").select(F.col("event_id").alias("id"), "user_id", "at_ms")
    return matching.window_pairs(e, e, "user_id", "at_ms").filter("a < b")


@query("SELECT conv_id, turn, substr(text, 1, 500) AS question FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role = 'user') WHERE back = 1")
def chat_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = matching.last_wins(table(spark, sf_dir, "conversations").filter("role = 'user'"), ["conv_id"], [F.desc("turn")])
    return asked.select("conv_id", "turn", F.substring("text", 1, 500).alias("question"))


@query()
def extractive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", text.extractive_summary(F.col("text")).alias("summary"))


@query(f"""{ITEMS}, c AS (SELECT id, substr(text, 1, 60) AS title, source, handle, score, state, topics, tags, published_ms, doc_id, substr(trim(regexp_replace(substr(text, 1, 300), '\\s+', ' ', 'g')), 1, 500) AS summary FROM items)
  SELECT id, CASE WHEN regexp_matches(title, '[",\\n]') THEN '"' || replace(title, '"', '""') || '"' ELSE title END || ',https://example.org/' || doc_id || ',' || source || ',' || handle || ',' || strftime(make_timestamp(published_ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') || ',' || CAST(score AS VARCHAR) || ',' || state || ',' ||
  array_to_string(topics, '|') || ',' || array_to_string(tags, '|') || ',' || CASE WHEN regexp_matches(summary, '[",\\n]') THEN '"' || replace(summary, '"', '""') || '"' ELSE summary END AS line FROM c""")
def export_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.csv_rows(items_of(spark, sf_dir))


@query()
def export_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.markdown(items_of(spark, sf_dir))


def _streamed(spark: SparkSession, sf_dir: str, flow: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a flow over the events, read as a stream to its end, has written."""
    root = f"{matching.shared_root(spark)}/docloom/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    rows = flow(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]"))
    rows.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{root}/out")


def _seconds(out: DataFrame) -> DataFrame:
    """Windows with start_sec: their start, which was read as of the session's zone, in seconds."""
    zone = F.lit(out.sparkSession.conf.get("spark.sql.session.timeZone"))
    return out.withColumn("start_sec", F.unix_micros(F.from_utc_timestamp("start", zone)) / 1e6)


@query("""WITH w AS (SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS s, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2), m AS (SELECT max(ts) - INTERVAL '1 hour' AS late FROM events)
  SELECT epoch(s) AS start_sec, event_type, n, round(total, 6) AS total FROM w, m WHERE s + INTERVAL '6 hours' <= date_trunc('milliseconds', late)""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _streamed(spark, sf_dir, lambda e: tumbling(e, "event_type", value="value"))
    return _seconds(out).select("start_sec", "event_type", "n", F.round("total", 6).alias("total"))


@query()
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seconds(_streamed(spark, sf_dir, lambda e: sliding(e, "event_type"))).select("start_sec", "event_type", "n")


@query()
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seconds(_streamed(spark, sf_dir, lambda e: sessions(e, "user_id"))).select("start_sec", "user_id", "n")


@query("SELECT event_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, lambda e: unique_events(e, ["event_id"]).select("event_id", "event_type"))


from . import catalogue as _catalogue  # noqa: E402, F401  registers more queries
from . import stored as _stored  # noqa: E402, F401  registers more queries
