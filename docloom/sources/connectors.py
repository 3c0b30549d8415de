"""Connectors: responses of public APIs, stored as files, to ingest rows. JSON responses are parsed and projected natively."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import html_to_text
from ..schema import AUTHOR, INGEST, MEDIA, METRICS
from .feeds import read_feeds

PUSH_ONLY = ("x", "xiaohongshu", "web", "manual")


def ingest_rows(df: DataFrame, **columns: Column) -> DataFrame:
    """The ingest schema of given columns; the others are null."""
    return df.select(*(columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in INGEST))


def _struct(kind: str, **values: Column) -> Column:
    names = [x.split(":")[0] for x in kind.removeprefix("struct<").removesuffix(">").split(",")]
    types = dict(x.split(":") for x in kind.removeprefix("struct<").removesuffix(">").split(","))
    return F.struct(*(values.get(n, F.lit(None)).cast(types[n]).alias(n) for n in names))


def _author(**values: Column) -> Column:
    return F.when(values["name"].isNotNull(), _struct(AUTHOR, **values))


def _image(url: Column, width: Column | None = None, height: Column | None = None) -> Column:
    null = F.lit(None)
    one = F.struct(F.lit("image").alias("type"), url.alias("url"), null.cast("string").alias("thumb_url"), (width if width is not None else null).cast("int").alias("width"), (height if height is not None else null).cast("int").alias("height"), null.cast("double").alias("duration_sec"), null.cast("string").alias("alt"))
    return F.when(url.isNotNull(), F.array(one)).cast(MEDIA)


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("r"))


def hackernews(spark: SparkSession, path: str, target: str = "", min_engagement: int = 25) -> DataFrame:
    hit = "objectID string, url string, story_url string, title string, story_title string, story_text string, author string, points bigint, num_comments bigint, created_at_i bigint, _tags array<string>"
    h = _json(spark, path, f"hits array<struct<{', '.join(x.replace(' ', ':', 1) for x in hit.split(', '))}>>").select(F.explode("r.hits").alias("h")).select("h.*")
    link, title = F.coalesce("url", "story_url"), F.coalesce("title", "story_title")
    talk = F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("objectID"))
    h = h.filter(title.isNotNull() & (F.coalesce("points", F.lit(0)) >= min_engagement))
    return ingest_rows(
        h, url=F.coalesce(link, talk), source=F.lit("hackernews"), source_id=F.col("objectID"), kind=F.when(link.isNotNull(), "article").otherwise("discussion"), title=title, content=F.when(F.col("story_text").isNotNull(), html_to_text(F.col("story_text"))),
        author=_author(name=F.col("author"), handle=F.col("author"), url=F.concat(F.lit("https://news.ycombinator.com/user?id="), F.col("author"))),
        metrics=_struct(METRICS, points=F.coalesce("points", F.lit(0)), comments=F.coalesce("num_comments", F.lit(0))), published_ms=F.col("created_at_i") * 1000, raw=F.to_json(F.struct(talk.alias("discussion_url"), F.col("_tags").alias("tags"))),
    )


def _line(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def arxiv(spark: SparkSession, path: str, target: str = "", min_engagement: int = 0) -> DataFrame:
    e = read_feeds(spark, path)
    first = F.nullif(F.trim(F.get(F.split("author", r",|\band\b"), F.lit(0))), F.lit(""))
    return ingest_rows(e, url=F.col("link"), source=F.lit("arxiv"), kind=F.lit("paper"), title=_line(F.col("title")), summary=F.substring(_line(F.col("description")), 1, 3000), content=_line(F.col("description")), author=_author(name=first), published_ms=F.col("published_ms"), raw=F.to_json(F.struct("categories", F.col("author").alias("all_authors"))))


def github_queries(target: str) -> list[str]:
    """One query for each part of a target: a repository qualifier, or a topic."""
    parts = [p.strip() for p in (target or "").replace(" or ", " OR ").split(" OR ") if p.strip()]
    return parts or ["topic:llm"]


def github(spark: SparkSession, path: str, target: str = "", min_engagement: int = 0, most: int = 30) -> DataFrame:
    """All responses below ``path``; of a repository in several, the last; the ``most`` with most stars. A response that is no JSON counts as empty."""
    repo = "struct<full_name:string,html_url:string,description:string,stargazers_count:bigint,forks_count:bigint,language:string,topics:array<string>,created_at:string,pushed_at:string,owner:struct<login:string,avatar_url:string,html_url:string>>"
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", f"items array<{repo}>").alias("r")).select("file", F.posexplode("r.items").alias("at", "i")).select("file", "at", "i.*")
    last = Window.partitionBy("full_name").orderBy(F.desc("file"), F.desc("at"))
    rows = rows.filter(F.col("full_name").isNotNull() & (F.coalesce("stargazers_count", F.lit(0)) >= min_engagement)).withColumn("turn", F.row_number().over(last)).filter("turn = 1").orderBy(F.desc("stargazers_count"), "full_name").limit(most)
    return ingest_rows(
        rows, url=F.col("html_url"), source=F.lit("github"), source_id=F.col("full_name"), kind=F.lit("repo"), title=F.concat_ws(" — ", "full_name", "description"), summary=F.col("description"), content=F.col("description"),
        author=_author(name=F.col("owner.login"), handle=F.col("owner.login"), url=F.col("owner.html_url"), avatar_url=F.col("owner.avatar_url")), metrics=_struct(METRICS, stars=F.col("stargazers_count"), forks=F.col("forks_count")),
        tags=F.slice(F.coalesce("topics", F.array().cast("array<string>")), 1, 8), published_ms=F.unix_millis(F.try_to_timestamp(F.coalesce("pushed_at", "created_at"))),
    )


def huggingface(spark: SparkSession, path: str, target: str = "", min_engagement: int = 0) -> DataFrame:
    paper = "struct<paper:struct<id:string,title:string,summary:string,authors:array<struct<name:string>>,upvotes:bigint,publishedAt:string>,numComments:bigint,thumbnail:string>"
    p = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"array<{paper}>")).alias("e")).select("e.*")
    return ingest_rows(
        p, url=F.concat(F.lit("https://huggingface.co/papers/"), F.col("paper.id")), source=F.lit("huggingface"), source_id=F.col("paper.id"), kind=F.lit("paper"), title=_line(F.col("paper.title")), summary=F.substring(_line(F.col("paper.summary")), 1, 3000), content=_line(F.col("paper.summary")),
        author=_author(name=F.get("paper.authors", F.lit(0))["name"]), metrics=_struct(METRICS, likes=F.coalesce("paper.upvotes", F.lit(0)), comments=F.coalesce("numComments", F.lit(0))), published_ms=F.unix_millis(F.try_to_timestamp("paper.publishedAt")), media=_image(F.col("thumbnail")), raw=F.to_json(F.struct(F.col("paper.id").alias("arxiv_id"))),
    )


def reddit(spark: SparkSession, path: str, target: str = "", min_engagement: int = 0) -> DataFrame:
    post = "struct<data:struct<id:string,title:string,selftext:string,url:string,permalink:string,author:string,ups:bigint,num_comments:bigint,created_utc:double,link_flair_text:string,is_self:boolean,preview:struct<images:array<struct<source:struct<url:string,width:int,height:int>>>>>>"
    p = _json(spark, path, f"data struct<children:array<{post}>>").select(F.explode("r.data.children").alias("c")).select("c.data.*").filter("id is not null")
    link = F.concat(F.lit("https://www.reddit.com"), F.col("permalink"))
    image = F.get("preview.images", F.lit(0))["source"]
    return ingest_rows(
        p, url=F.when(F.col("is_self") | F.col("url").isNull(), link).otherwise(F.col("url")), source=F.lit("reddit"), source_id=F.col("id"), kind=F.when(F.col("is_self"), "discussion").otherwise("article"), title=F.col("title"), content=F.nullif(F.substring("selftext", 1, 40_000), F.lit("")),
        author=_author(name=F.col("author"), handle=F.col("author"), url=F.concat(F.lit("https://www.reddit.com/user/"), F.col("author"))), metrics=_struct(METRICS, points=F.coalesce("ups", F.lit(0)), comments=F.coalesce("num_comments", F.lit(0))),
        published_ms=(F.col("created_utc") * 1000).cast("long"), tags=F.when(F.col("link_flair_text").isNotNull(), F.array("link_flair_text")), media=_image(F.replace(image["url"], F.lit("&amp;"), F.lit("&")), image["width"], image["height"]), raw=F.to_json(F.struct(link.alias("permalink"))),
    )


def rss(spark: SparkSession, path: str, target: str = "", min_engagement: int = 0, most: int = 60) -> DataFrame:
    return feed_items(read_feeds(spark, path), most)


def feed_items(e: DataFrame, most: int = 60) -> DataFrame:
    """Ingest rows of feed entries, the first ``most`` of each feed."""
    e = e.withColumn("turn", F.row_number().over(Window.partitionBy("path").orderBy(F.monotonically_increasing_id()))).filter(F.col("turn") <= most)
    body = html_to_text(F.coalesce("content", "description"), numeric_references=True)
    return ingest_rows(e, url=F.col("link"), source=F.lit("rss"), kind=F.lit("article"), title=F.col("title"), summary=F.substring(html_to_text(F.coalesce("description", "content")), 1, 1500), content=body, author=_author(name=F.col("author")), published_ms=F.col("published_ms"), tags=F.slice("categories", 1, 6), media=_image(F.col("enclosure")))


CONNECTORS: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (hackernews, arxiv, github, huggingface, reddit, rss)}


def has_connector(kind: str) -> bool:
    return kind in CONNECTORS


def run(spark: SparkSession, kind: str, path: str, target: str = "", min_engagement: int | None = None, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), languages: tuple[str, ...] = ()) -> DataFrame:
    """A source's rows after its filters; a row of unknown language passes."""
    if kind not in CONNECTORS:
        raise ValueError(f"no connector for {kind!r}; pushed only: {', '.join(PUSH_ONLY)}")
    rows = CONNECTORS[kind](spark, path, target, **({} if min_engagement is None else {"min_engagement": min_engagement}))
    text = F.lower(F.concat_ws("\n", "title", "summary", "content"))
    holds = lambda words: F.exists(F.array(*(F.lit(w.lower()) for w in words)), lambda w: F.contains(text, w))
    if include:
        rows = rows.filter(holds(include))
    if exclude:
        rows = rows.filter(~holds(exclude))
    return rows.filter(F.col("lang").isNull() | F.col("lang").isin(*languages)) if languages else rows


DEFAULT_SOURCES = (("hackernews", "AI"), ("arxiv", "cat:cs.AI"), ("github", "topic:llm"), ("huggingface", ""), ("reddit", "LocalLLaMA"), ("x", ""), ("xiaohongshu", ""), ("web", ""), ("manual", ""))


def default_sources(spark: SparkSession, existing: DataFrame) -> DataFrame:
    """The seed rows where there are no sources yet."""
    from ..schema import SOURCE

    if not existing.isEmpty():
        return existing
    rows = [(f"{k}-default", k, t, k, k in CONNECTORS, 3600 if k in CONNECTORS else 0, 1.0, None, [], [], [], None, 0, None) for k, t in DEFAULT_SOURCES]
    return spark.createDataFrame(rows, SOURCE)
