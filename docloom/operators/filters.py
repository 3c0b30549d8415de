"""Predicates and paging of search queries."""

from __future__ import annotations

import base64
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_of
from ..schema import SearchQuery

MOST_OFFSET = 100_000


def when_ms() -> Column:
    return F.coalesce(F.col("published_ms"), F.col("captured_ms"))


def holds_all(array: Column, wanted: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, (F.array_contains(array, w) for w in wanted), F.lit(True))


def predicate(query: SearchQuery) -> Column:
    """All conditions on items but the collection, which is a join. Simple comparisons come first and reach the scan."""
    parts: list[Column] = []
    if not query.include_duplicates:
        parts.append(F.col("duplicate_of").isNull())
    parts.append(F.col("state").isin(*query.states) if query.states else F.col("state") != "trash")
    for name, wanted in (("source", query.sources), ("kind", query.kinds), ("author.handle", query.authors)):
        if wanted:
            parts.append(F.col(name).isin(*wanted))
    if query.min_score is not None:
        parts.append(F.col("score") >= query.min_score)
    if query.from_ms is not None:
        parts.append(when_ms() >= query.from_ms)
    if query.to_ms is not None:
        parts.append(when_ms() <= query.to_ms)
    if query.starred is not None:
        parts.append(F.coalesce(F.col("starred"), F.lit(False)) == query.starred)
    if query.unread:
        parts.append(F.col("read_ms").isNull())
    if query.has_media:
        parts.append(F.size(F.coalesce(F.col("media"), F.array())) > 0)
    if query.lang:
        parts.append(F.col("lang") == query.lang)
    for name, wanted in (("tags", query.tags), ("topics", query.topics)):
        if wanted:
            parts.append(holds_all(F.col(name), wanted))
    return reduce(lambda a, b: a & b, parts)


def matching(items: DataFrame, query: SearchQuery, members: DataFrame | None = None) -> DataFrame:
    """Items that pass; ``members``: collection_id, item_id, needed for a collection."""
    out = items.filter(predicate(query))
    if query.collection_id is not None:
        if members is None:
            raise ValueError("a collection needs its members")
        own = members.filter(F.col("collection_id") == query.collection_id).select(F.col("item_id").alias("id"))
        out = out.join(own, "id", "left_semi")
    return out


def ordering(sort: str) -> list[Column]:
    """Sort columns, always ended by the identifier."""
    orders = {
        "signal": [F.desc("score"), when_ms().desc()],
        "relevance": [F.desc("score"), when_ms().desc()],
        "recent": [when_ms().desc()],
        "oldest": [when_ms().asc()],
        "velocity": [F.desc("breakdown.velocity"), F.desc("score")],
    }
    return [*orders[sort], F.asc("id")]


def encode_cursor(offset: int) -> str:
    return base64.urlsafe_b64encode(json.dumps({"o": offset}, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(cursor: str | None) -> int:
    """The offset of a cursor, within bounds; 0 for anything malformed."""
    if not cursor:
        return 0
    try:
        n = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))["o"]
        return max(0, min(int(n), MOST_OFFSET))
    except (ValueError, KeyError, TypeError):
        return 0


def browse(items: DataFrame, query: SearchQuery, members: DataFrame | None = None) -> DataFrame:
    """One page and one row more, which tells whether another follows."""
    query = query.bounded()
    rows = matching(items, query, members).orderBy(*ordering(query.resolved_sort))
    return rows.offset(decode_cursor(query.cursor)).limit(query.limit + 1)


def in_order(items: DataFrame, ids: list[str]) -> DataFrame:
    """The items of ``ids`` in their order; unknown ones are left out."""
    wanted = items.sparkSession.createDataFrame(list(enumerate(ids)), "position int, id string")
    return wanted.join(items, "id").orderBy("position").drop("position")


def known_urls(items: DataFrame, url_hashes: DataFrame) -> DataFrame:
    """Which of ``url_hashes`` (url_hash) are known, with the item's identifier."""
    return url_hashes.distinct().join(items.select("url_hash", "id"), "url_hash")


def rejection(row: dict[str, Column], muted_keywords: tuple[str, ...] = (), muted_authors: tuple[str, ...] = ()) -> Column:
    """The first reason to reject an ingested row, or null."""
    text = F.concat_ws("\n", row["title"], row["summary"], row["content"])
    words = [w.strip().lower() for w in muted_keywords if len(w.strip()) >= 2]
    authors = [a.strip().lstrip("@").lower() for a in muted_authors if a.strip()]
    handle = F.lower(F.ltrim(text_of(row["handle"]), F.lit("@")))
    out = F.when(F.length(text_of(row["url"])) < 4, "missing url").when(F.trim(text) == "", "no text")
    out = out.when((F.length(F.trim(text)) < 12) & (F.size(F.coalesce(row["media"], F.array())) == 0), "too short")
    for w in words:
        out = out.when(F.contains(F.lower(text), F.lit(w)), f"muted keyword: {w}")
    return out.when(handle.isin(*authors), "muted author") if authors else out
