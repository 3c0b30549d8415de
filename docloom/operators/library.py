"""Collections, highlights, saved searches, sources: small tables, changed by whole new frames."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SearchQuery
from .filters import matching


def stored_query(text: str | None) -> SearchQuery:
    """A stored query; the default one for anything malformed."""
    try:
        given = json.loads(text or "{}")
        known = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in SearchQuery.__dataclass_fields__}
        return SearchQuery(**known).bounded()
    except (ValueError, TypeError, AttributeError):
        return SearchQuery()


def patched(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """``table`` with the non-null values of ``changes`` (key and some columns) in place of its own."""
    new = [c for c in changes.columns if c != key]
    renamed = changes.select(key, *(F.col(c).alias(f"__{c}") for c in new))
    return table.join(renamed, key, "left").select(*(F.coalesce(f"__{c}", c).alias(c) if c in new else c for c in table.columns))


def without(table: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_anti")


def positioned(table: DataFrame, added: DataFrame, partition: list[str], order: list) -> DataFrame:
    """``table`` and ``added`` rows (without position) after the last position of their partition; rows whose keys exist keep theirs."""
    last = table.groupBy(*partition).agg(F.max("position").alias("__last")) if partition else table.agg(F.max("position").alias("__last"))
    joined = added.join(last, partition, "left") if partition else added.crossJoin(F.broadcast(last))  # one row
    turn = F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) if partition else F.row_number().over(Window.orderBy(*order))
    placed = joined.withColumn("position", F.coalesce("__last", F.lit(0.0)) + turn).select(*table.columns)
    return table.unionByName(placed)


def add_to_collection(members: DataFrame, added: DataFrame) -> DataFrame:
    """Members with ``added`` (collection_id, item_id, note, added_ms): new ones last, old ones with the note if one is given."""
    keys = ["collection_id", "item_id"]
    notes = added.select(*keys, F.col("note").alias("__note"))
    kept = members.join(notes, keys, "left").withColumn("note", F.coalesce("__note", "note")).select(*members.columns)
    return positioned(kept, added.join(members.select(*keys), keys, "left_anti"), ["collection_id"], ["added_ms", "item_id"])


def collection_items(items: DataFrame, members: DataFrame, collection_id: str) -> DataFrame:
    own = members.filter(F.col("collection_id") == collection_id).select(F.col("item_id").alias("id"), "position", "added_ms")
    return items.join(own, "id").orderBy("position", F.desc("added_ms"), "id")


def smart_collection(items: DataFrame, members: DataFrame, query_text: str) -> DataFrame:
    """What a collection's stored query gives at this time."""
    return matching(items, stored_query(query_text), members)


def collection_counts(members: DataFrame) -> DataFrame:
    return members.groupBy("collection_id").agg(F.count("*").alias("n"))


def new_matches(items: DataFrame, searches: list[dict], members: DataFrame | None = None) -> DataFrame:
    """search_id, n: items captured since each saved search (id, query, last_seen_ms) was seen, by all its conditions but its words. One scan for all searches without a collection."""
    from .filters import predicate

    plain, parts = [], []
    for s in searches:
        query = stored_query(s["query"])
        since = F.col("captured_ms") > (s["last_seen_ms"] or 0)
        if query.collection_id is None:
            plain.append(F.count_if(predicate(query) & since).alias(s["id"]))
        else:
            parts.append(matching(items, query, members).filter(since).agg(F.lit(s["id"]).alias("search_id"), F.count("*").alias("n")))
    if plain:
        row = items.agg(*plain)
        names = F.array(*(F.struct(F.lit(c).alias("search_id"), F.col(f"`{c}`").alias("n")) for c in row.columns))
        parts.append(row.select(F.explode(names).alias("x")).select("x.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def due(sources: DataFrame, now_ms: int) -> DataFrame:
    """Enabled sources whose interval has passed."""
    return sources.filter(F.col("enabled") & (F.col("interval_sec") > 0) & (F.coalesce("last_run_ms", F.lit(0)) + F.col("interval_sec") * 1000 <= now_ms))


def record_run(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Counters after ``runs`` (id, ran_ms, added, error)."""
    done = runs.groupBy("id").agg(F.max("ran_ms").alias("__ran"), F.sum("added").alias("__added"), F.max_by("error", "ran_ms").alias("__error"), F.lit(True).alias("__hit"))
    joined = sources.join(done, "id", "left")
    new = {"last_run_ms": F.coalesce("__ran", "last_run_ms"), "items_total": F.coalesce("items_total", F.lit(0)) + F.coalesce("__added", F.lit(0)), "last_error": F.when(F.col("__hit"), F.col("__error")).otherwise(F.col("last_error"))}
    return joined.select(*(new.get(c, F.col(c)).alias(c) for c in sources.columns))


def source_trust(items: DataFrame, sources: DataFrame, default) -> DataFrame:
    """Items with source_trust: the mean trust of the sources of their kind, else ``default``."""
    known = sources.groupBy(F.col("kind").alias("source")).agg(F.avg("trust").alias("__trust"))  # at most one row a kind
    return items.join(F.broadcast(known), "source", "left").withColumn("source_trust", F.coalesce("__trust", default)).drop("__trust")


def with_tags(items: DataFrame, changes: DataFrame, most: int = 64) -> DataFrame:
    """Items with the tags of ``changes`` (id, tags) instead: trimmed, not empty, distinct."""
    clean = F.slice(F.array_distinct(F.filter(F.transform("tags", lambda t: F.trim(t)), lambda t: t != "")), 1, most)
    return patched(items, changes.select("id", clean.alias("tags")))


def item_detail(items: DataFrame, item_id: str, highlights: DataFrame, collections: DataFrame, members: DataFrame) -> DataFrame:
    """One row: the item, its highlights in order, and the names of its collections."""
    one = items.filter(F.col("id") == item_id)
    own = highlights.filter(F.col("item_id") == item_id).agg(F.sort_array(F.collect_list(F.struct("created_ms", "text", "note"))).alias("highlights"))
    held = members.filter(F.col("item_id") == item_id).join(collections, F.col("collection_id") == collections["id"]).agg(F.sort_array(F.collect_set("name")).alias("collections"))
    return one.crossJoin(own).crossJoin(held)  # one row each


def highlights_of(highlights: DataFrame, item_id: str | None = None, limit: int = 500) -> DataFrame:
    """An item's highlights, oldest first; without an item, all, newest first."""
    if item_id is not None:
        return highlights.filter(F.col("item_id") == item_id).orderBy("created_ms", "id")
    return highlights.orderBy(F.desc("created_ms"), "id").limit(limit)


def new_highlights(highlights: DataFrame, added: DataFrame, most: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """The table with the valid ones of ``added``, and the others with their reason: text is needed, of at most ``most`` characters."""
    size = F.length(F.trim(F.coalesce("text", F.lit(""))))
    checked = added.withColumn("reason", F.when(size == 0, "no text").when(F.length("text") > most, "too long"))
    return highlights.unionByName(checked.filter("reason is null").select(*highlights.columns)), checked.filter("reason is not null")


def appended(ledger: DataFrame, actions: DataFrame) -> DataFrame:
    """The ledger with a batch of ``actions`` (ts_ms, type, item_id, call_id, value) after its last entry, in order of time, item and type."""
    last = ledger.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("__last"))
    turn = F.row_number().over(Window.orderBy("ts_ms", "item_id", "type"))  # a batch, not the ledger
    placed = actions.crossJoin(F.broadcast(last)).withColumn("seq", F.col("__last") + turn)  # one row
    return ledger.unionByName(placed.select(*ledger.columns))


def changes(before: DataFrame, after: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """id, change of two versions of a table: created, removed, or updated in any of ``columns``."""
    mark = F.struct(*columns)
    both = before.select(key, mark.alias("old")).join(after.select(key, mark.alias("new")), key, "full_outer")
    change = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "updated")
    return both.select(key, change.alias("change")).filter("change is not null")


def facet_values(items: DataFrame) -> DataFrame:
    """All values to filter by: facet, value, n."""
    from .analytics import facets

    rows = items.filter("duplicate_of is null and state <> 'trash'")
    return facets(rows, {"tag": (F.col("tags"), 100), "topic": (F.col("topics"), 60), "author": (F.coalesce("author.name", "author.handle"), 80), "source": (F.col("source"), 1 << 30)})
