"""The item model: Spark types, allowed values, the search query, and checks."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import struct

SOURCES = ("x", "xiaohongshu", "hackernews", "arxiv", "github", "reddit", "youtube", "producthunt", "huggingface", "rss", "web", "manual")
KINDS = ("post", "thread", "note", "article", "paper", "repo", "release", "video", "discussion", "link")
STATES = ("inbox", "shortlist", "saved", "archived", "trash")
ENTITY_TYPES = ("model", "company", "product", "person", "paper", "benchmark", "technique", "hardware")
SORTS = ("relevance", "signal", "recent", "oldest", "velocity")

METRICS = "struct<likes:bigint,reposts:bigint,replies:bigint,quotes:bigint,views:bigint,bookmarks:bigint,collects:bigint,stars:bigint,forks:bigint,points:bigint,comments:bigint,citations:bigint,downloads:bigint>"
AUTHOR = "struct<name:string,handle:string,url:string,avatar_url:string,followers:bigint,verified:boolean,bio:string>"
MEDIA = "array<struct<type:string,url:string,thumb_url:string,width:int,height:int,duration_sec:double,alt:string>>"
ENTITIES = "array<struct<type:string,name:string,confidence:double>>"
BREAKDOWN = "struct<velocity:double,authority:double,relevance:double,novelty:double,depth:double,recency:double,noise:double,source_trust:double>"

#: What a source hands in.
INGEST = struct(
    f"url string, source string, source_id string, kind string, title string, summary string, content string, lang string, author {AUTHOR}, metrics {METRICS}, media {MEDIA}, topics array<string>, tags array<string>, published_ms bigint, state string, raw string"
)
#: What the engine keeps. Times are epoch milliseconds, so arithmetic on them is exact.
ITEM = struct(
    f"id string, url string, url_hash string, source string, source_id string, kind string, title string, summary string, content string, lang string, author {AUTHOR}, metrics {METRICS}, media {MEDIA}, topics array<string>, tags array<string>, entities {ENTITIES}, published_ms bigint, captured_ms bigint, updated_ms bigint, score double, breakdown {BREAKDOWN}, state string, starred boolean, read_ms bigint, reading_time_sec int, simhash string, duplicate_of string, echo_count int, embedding array<float>, embed_model string, raw string"
)
COLLECTION = struct("id string, name string, description string, color string, position double, smart_query string, created_ms bigint")
COLLECTION_ITEM = struct("collection_id string, item_id string, position double, note string, added_ms bigint")
HIGHLIGHT = struct("id string, item_id string, text string, note string, color string, created_ms bigint")
SAVED_SEARCH = struct("id string, name string, query string, last_seen_ms bigint, alerting boolean, created_ms bigint")
SOURCE = struct("id string, kind string, target string, label string, enabled boolean, interval_sec bigint, trust double, min_engagement bigint, include array<string>, exclude array<string>, languages array<string>, last_run_ms bigint, items_total bigint, last_error string")
DIGEST = struct("id string, title string, period_from_ms bigint, period_to_ms bigint, body string, item_ids array<string>, created_ms bigint")
LEDGER = struct("seq bigint, ts_ms bigint, type string, item_id string, call_id string, value string")


@dataclass(frozen=True)
class SearchQuery:
    """What browsing, search, views and smart collections ask for."""

    q: str = ""
    states: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    authors: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    topics: tuple[str, ...] = ()
    collection_id: str | None = None
    min_score: float | None = None
    from_ms: int | None = None
    to_ms: int | None = None
    starred: bool | None = None
    unread: bool | None = None
    has_media: bool | None = None
    lang: str | None = None
    sort: str | None = None
    limit: int = 50
    cursor: str | None = None
    mode: str = "hybrid"
    diversify: float = 0.0
    include_duplicates: bool = False

    @property
    def resolved_sort(self) -> str:
        return self.sort or ("relevance" if self.q.strip() else "signal")

    def bounded(self) -> SearchQuery:
        """With limits and enumerations in range; what is not allowed goes."""
        allowed = lambda values, known: tuple(v for v in values if v in known)
        return replace(self, states=allowed(self.states, STATES), sources=allowed(self.sources, SOURCES), kinds=allowed(self.kinds, KINDS), sort=self.sort if self.sort in SORTS else None, limit=max(1, min(self.limit, 200)), diversify=max(0.0, min(self.diversify, 1.0)))


def parameters(given: dict[str, str]) -> SearchQuery:
    """A query of URL parameters: lists are separated by commas, flags are 1 or true."""
    lists = ("states", "sources", "kinds", "authors", "tags", "topics")
    out: dict = {k: tuple(x.strip() for x in given[k].split(",") if x.strip()) for k in lists if given.get(k)}
    out |= {k: given[k] for k in ("q", "collection_id", "lang", "sort", "cursor", "mode") if given.get(k)}
    out |= {k: given[k].lower() in ("1", "true") for k in ("starred", "unread", "has_media") if given.get(k)}
    for k, kind in (("min_score", float), ("from_ms", int), ("to_ms", int), ("limit", int), ("diversify", float)):
        try:
            out |= {k: kind(given[k])} if given.get(k) else {}
        except ValueError:
            continue
    return SearchQuery(**out).bounded()


def view(name: str, now_ms: int) -> SearchQuery:
    """The queries of named views."""
    views = {
        "inbox": SearchQuery(states=("inbox",)),
        "today": SearchQuery(from_ms=now_ms - 86_400_000),
        "shortlist": SearchQuery(states=("shortlist",)),
        "saved": SearchQuery(states=("saved",)),
        "archive": SearchQuery(states=("archived",)),
        "trash": SearchQuery(states=("trash",)),
        "starred": SearchQuery(starred=True),
        "unread": SearchQuery(unread=True),
        "all": SearchQuery(),
    }
    return views.get(name, SearchQuery())


def violations(row: dict[str, Column]) -> Column:
    """Why an ingested row is invalid: an array of reasons."""
    checks = {
        "url": row["url"].isNull() | (F.length(row["url"]) < 4) | (F.length(row["url"]) > 4096),
        "source": ~F.coalesce(row["source"].isin(*SOURCES), F.lit(False)),
        "kind": row["kind"].isNotNull() & ~row["kind"].isin(*KINDS),
        "state": row["state"].isNotNull() & ~row["state"].isin(*STATES),
        "title": F.length(row["title"]) > 2000,
        "tags": F.size(row["tags"]) > 64,
    }
    return F.array_compact(F.array(*(F.when(bad, f"invalid {name}") for name, bad in checks.items())))



