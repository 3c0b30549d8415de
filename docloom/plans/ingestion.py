"""Ingestion: checks, canonical URLs, enrichment, two tiers of duplicates, scores, upsert; and the action ledger."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import DEFAULT, Lexicon, entities_of, topics_of
from ..functions.scoring import Settings, affinity, with_scores
from ..functions.similarity import cosine, hash_embed, item_text, simhash
from ..functions.text import detect_lang, excerpt, normalise_text, reading_time_sec
from ..functions.urls import canonical_url, url_hash
from ..operators.filters import rejection
from ..operators.matching import echo_candidates, first_come, last_wins, max_similarity, saved
from ..operators.versions import Change, Store
from ..schema import ITEM, violations

#: Least cosine of an echo for hashed embeddings.
ECHO_COSINE = 0.5


@dataclass(frozen=True)
class Outcome:
    """``items``: the table after the batch; ``results``: outcome and n; ``rejected``: rows with their reason; ``changes``: url_hash, item (null: none) and echoes, what the batch does to the table."""

    items: DataFrame
    results: DataFrame
    rejected: DataFrame
    changes: DataFrame


def _columns(df: DataFrame) -> dict[str, Column]:
    return {c: F.col(c) for c in df.columns}


def enrich(batch: DataFrame, settings: Settings, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Item columns of checked ingest rows (with ``seq``, their order): the last row of each canonical URL."""
    rows = batch.withColumn("c", canonical_url(F.col("url"))).withColumns({"url": F.col("c.url"), "url_hash": url_hash(F.col("c.url")), "source_id": F.coalesce("source_id", "c.source_id")})
    rows = last_wins(rows, ["url_hash"], [F.desc("seq")]).drop("c")
    content, title = normalise_text(F.col("content")), F.trim(F.coalesce("title", F.lit("")))
    rows = rows.withColumns({"content": content, "title": F.when(title == "", F.substring(F.get(F.split(content, "\n"), F.lit(0)), 1, 200)).otherwise(title)})
    rows = rows.withColumn("summary", F.coalesce("summary", excerpt(F.col("content"))))
    whole = F.concat_ws("\n", "title", "summary", "content")
    rows = rows.withColumns(
        {
            "id": F.substring("url_hash", 1, 24),
            "kind": F.coalesce("kind", F.lit("post")),
            "lang": F.coalesce("lang", detect_lang(whole)),
            "reading_time_sec": reading_time_sec(F.col("content")),
            "topics": F.when(F.size("topics") > 0, F.col("topics")).otherwise(topics_of(F.col("title"), F.col("summary"), F.col("content"), lexicon)),
            "entities": entities_of(whole, lexicon),
            "captured_ms": F.lit(settings.now_ms).cast("long"),
        }
    )
    text = F.concat_ws("\n", "title", F.substring(F.coalesce(F.nullif("content", F.lit("")), "summary"), 1, 4000))
    return rows.withColumns({"simhash": simhash(text), "embedding": hash_embed(item_text(F.col("title"), F.col("summary"), F.col("content"), F.col("topics"), F.col("author.name")))})


def duplicates(items: DataFrame) -> DataFrame:
    """id, duplicate_of of items (id, seq, url_hash, simhash, embedding, entities, times): near fingerprints first, then echoes within 72 hours. An item never matches its own URL."""
    vectors = items.select("id", "embedding")
    echoes = echo_candidates(items).filter(F.col("a") < F.col("b"))
    echoes = echoes.join(vectors.select(F.col("id").alias("a"), F.col("embedding").alias("va")), "a").join(vectors.select(F.col("id").alias("b"), F.col("embedding").alias("vb")), "b")
    echoes = echoes.withColumn("cosine", cosine(F.col("va"), F.col("vb"))).filter(F.col("cosine") >= ECHO_COSINE)
    # Any fingerprint distance (0 to 3) is nearer than any echo (10 to 11).
    return first_come(items.select("id", "seq"), echoes.select("a", "b", (11 - F.col("cosine")).alias("weight")), items.select("id", "simhash"))


def scored(items: DataFrame, settings: Settings, interests: list[list[float]] | None = None, authors: DataFrame | None = None, keywords: list[str] | None = None, similarity: DataFrame | None = None) -> DataFrame:
    """Items with score, breakdown, reasons. ``similarity``: id, max_similarity, computed over the canonical items if not given."""
    similarity = similarity if similarity is not None else max_similarity(items.filter("duplicate_of is null").select("id", "embedding"))
    out = items.join(similarity, "id", "left")
    handle = F.col("author.handle")
    if authors is not None:
        known = authors.select(F.col("handle").alias("__handle"), F.col("saved").alias("__saved"), F.col("seen").alias("__seen"))
        out = out.join(known, handle == F.col("__handle"), "left")
    else:
        out = out.withColumns({"__saved": F.lit(0), "__seen": F.lit(0)})
    likeness = [cosine(F.col("embedding"), F.array(*(F.lit(float(x)) for x in v))) for v in interests or []]
    best = F.greatest(*likeness) if len(likeness) > 1 else likeness[0] if likeness else F.lit(None).cast("double")
    full = with_scores(
        out, settings, F.col("source"), F.col("kind"), F.concat_ws("\n", "title", "summary", "content"), F.col("metrics"), F.col("published_ms"), F.col("author.followers"), affinity(F.col("__saved"), F.col("__seen")), F.coalesce("author.verified", F.lit(False)),
        F.size(F.coalesce("entities", F.array())), best, F.col("max_similarity"), F.col("echo_count"), keywords=keywords,
    )
    new = ("score", "breakdown", "reasons")
    return full.select(*(c for c in items.columns if c not in new), *new)


def upserted(items: DataFrame, new: DataFrame) -> DataFrame:
    """``items`` after an upsert of ``new`` (both of the item schema) by url_hash.

    New values replace old ones unless they are null (an empty title is none); reading time is the longer, tags are united; state, star, read time, id and capture time stay the old row's.
    """
    names = [f.name for f in ITEM]
    old, add = items.select(F.struct(*names).alias("o"), F.col("url_hash")), new.select(F.struct(*names).alias("n"), F.col("url_hash"))
    both = old.join(add, "url_hash", "full_outer")
    keep = {"id", "state", "starred", "read_ms", "captured_ms", "echo_count"}
    rules: dict[str, Column] = {"title": F.coalesce(F.nullif("n.title", F.lit("")), "o.title"), "reading_time_sec": F.greatest("o.reading_time_sec", "n.reading_time_sec"), "tags": F.when(F.col("o.tags").isNull(), F.col("n.tags")).when(F.col("n.tags").isNull(), F.col("o.tags")).otherwise(F.array_union("o.tags", "n.tags"))}
    return both.select(*(rules.get(c, F.coalesce(f"o.{c}", f"n.{c}") if c in keep else F.coalesce(f"n.{c}", f"o.{c}")).cast(ITEM[c].dataType).alias(c) for c in names))


def run(items: DataFrame, batch: DataFrame, settings: Settings, lexicon: Lexicon = DEFAULT, force: bool = False, interests: list[list[float]] | None = None, authors: DataFrame | None = None) -> Outcome:
    """A batch (ingest schema and ``seq``) into the item table.

    Duplicates are linked, not dropped: score 0, archived, without vector. What is new goes to the inbox from the threshold on (or by force, or by hand), else to the archive.
    """
    checked = batch.withColumn("reason", F.coalesce(F.get(violations(_columns(batch)), F.lit(0)), rejection(_columns(batch) | {"handle": F.col("author.handle")}, settings.muted_keywords, settings.muted_authors)))
    checked = saved(checked)
    rejected, passed = checked.filter("reason is not null"), checked.filter("reason is null").drop("reason")
    new = saved(enrich(passed, settings, lexicon))
    known = items.select("url_hash", F.col("id").alias("known_id"))
    new = saved(new.join(known, "url_hash", "left").withColumns({"id": F.coalesce("known_id", "id"), "created": F.col("known_id").isNull()}).drop("known_id"))
    columns = ["id", "seq", "url_hash", "simhash", "embedding", "entities", "published_ms", "captured_ms"]
    stored = items.filter("duplicate_of is null").join(new.select("url_hash"), "url_hash", "left_anti").withColumn("seq", F.lit(-1).cast("long"))
    pool = stored.select(*columns).union(new.select(*(F.col(c).cast("long") if c == "seq" else F.col(c) for c in columns)))
    found = saved(duplicates(pool))
    marked = new.join(found, "id", "left")
    similarity = max_similarity(pool.join(found.filter("duplicate_of is null").select("id"), "id").select("id", "embedding"))
    full = marked.withColumns({n: F.lit(None).cast(ITEM[n].dataType) for n in ITEM.fieldNames() if n not in marked.columns})
    full = full.withColumns({"echo_count": F.lit(0), "updated_ms": F.lit(settings.now_ms).cast("long"), "embed_model": F.lit("hash")}).select(*ITEM.fieldNames(), "created", "seq")
    full = scored(full, settings, interests, authors, similarity=similarity)
    twin = F.col("duplicate_of").isNotNull()
    inbox = F.lit(force) | (F.col("source") == "manual") | (F.col("score") >= settings.inbox_threshold)
    full = full.withColumns({"state": F.when(twin, "archived").otherwise(F.coalesce("state", F.when(inbox, "inbox").otherwise("archived"))), "score": F.when(twin, 0.0).otherwise(F.col("score").cast("double")), "embedding": F.when(~twin, F.col("embedding"))})
    full = saved(full)
    echoes = full.filter(twin & F.col("created")).groupBy(F.col("duplicate_of").alias("id")).agg(F.count("*").alias("__echoes"))
    hashes = items.select("id", "url_hash").union(new.filter("created").select("id", "url_hash"))
    changes = full.select("url_hash", F.struct(*ITEM.fieldNames()).alias("item"), F.lit(0).cast("long").alias("echoes")).union(
        hashes.join(echoes, "id").select("url_hash", F.lit(None).cast(ITEM).alias("item"), "__echoes")
    )
    table = merge_changes(items, changes)
    outcome = F.when(twin, "duplicates").when(F.col("created"), "created").otherwise("updated")
    results = full.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n")).union(rejected.agg(F.lit("rejected"), F.count("*"))).union(batch.agg(F.lit("received"), F.count("*")))
    return Outcome(table, results, rejected, changes)


def merge_changes(items: DataFrame, changes: DataFrame) -> DataFrame:
    """``items`` after an outcome's ``changes``: new values by upsert, then the echoes that items have got."""
    new = changes.filter("item is not null").select("item.*")
    echoes = changes.groupBy("url_hash").agg(F.sum("echoes").alias("__echoes"))
    return upserted(items, new).join(echoes, "url_hash", "left").withColumn("echo_count", (F.coalesce("echo_count", F.lit(0)) + F.coalesce("__echoes", F.lit(0))).cast("int")).select(*ITEM.fieldNames())


def run_into(store: Store, batch: DataFrame, settings: Settings, name: str = "items", **more) -> Outcome:
    """A batch into a versioned table of items, keyed by url_hash: only the buckets that the batch or its echoes fall into are rewritten, in one transaction."""
    if name not in store.snapshot().tables:
        store.create(name, ITEM, "url_hash")
    outcome = run(store.snapshot().table(name), batch, settings, **more)
    store.transact({name: Change(outcome.changes, merge_changes)})
    return outcome


def rescore(items: DataFrame, settings: Settings, interests: list[list[float]] | None = None, authors: DataFrame | None = None, keywords: list[str] | None = None) -> DataFrame:
    """All items with the scores of canonical ones computed anew, by the same function and inputs as at ingestion."""
    canonical = scored(items.filter("duplicate_of is null"), settings, interests, authors, keywords).drop("reasons").withColumn("score", F.col("score").cast("double"))
    return canonical.select(*items.columns).unionByName(items.filter("duplicate_of is not null"))


def backfill(items: DataFrame, model: str = "hash") -> DataFrame:
    """Items with the vectors that are missing or of another model."""
    stale = F.col("duplicate_of").isNull() & (F.col("embedding").isNull() | ~F.col("embed_model").eqNullSafe(model))
    text = item_text(F.col("title"), F.col("summary"), F.col("content"), F.col("topics"), F.col("author.name"))
    fresh = items.filter(stale).withColumns({"embedding": hash_embed(text), "embed_model": F.lit(model)})
    return fresh.unionByName(items.filter(~stale))


def apply_actions(items: DataFrame, ledger: DataFrame) -> DataFrame:
    """Items after the ledger's actions: the last state, star and read of each item count."""
    last = lambda kind, value: F.max_by(F.when(F.col("type").rlike(kind), value), F.when(F.col("type").rlike(kind), F.struct("ts_ms", "seq")))
    state = F.when(F.col("type") == "item.save", "saved").otherwise(F.substring_index("type", ".", -1))
    done = ledger.groupBy(F.col("item_id").alias("id")).agg(
        last("^item\\.(save|inbox|shortlist|archived|trash)$", state).alias("__state"),
        last("^item\\.(star|unstar)$", F.col("type") == "item.star").alias("__starred"),
        last("^item\\.read$", F.col("ts_ms")).alias("__read"),
    )
    new = {"state": F.coalesce("__state", "state"), "starred": F.coalesce("__starred", "starred"), "read_ms": F.coalesce("__read", "read_ms")}
    return items.join(done, "id", "left").select(*(new.get(c, F.col(c)).alias(c) for c in items.columns))


def author_stats(items: DataFrame, ledger: DataFrame) -> DataFrame:
    """handle, seen, saved, dismissed, followers, name. An author counts once a call, however many items the call held."""
    seen = items.filter("duplicate_of is null and author.handle is not null").groupBy(F.col("author.handle").alias("handle")).agg(F.count("*").alias("seen"), F.max_by("author.followers", "captured_ms").alias("followers"), F.max_by("author.name", "captured_ms").alias("name"))
    acts = ledger.join(items.select(F.col("id").alias("item_id"), F.col("author.handle").alias("handle")), "item_id").filter("handle is not null")
    call = lambda kinds: F.count_distinct(F.when(F.col("type").isin(*kinds), F.col("call_id")))
    counts = acts.groupBy("handle").agg(call(["item.save"]).alias("saved"), call(["item.archived", "item.trash"]).alias("dismissed"))
    return seen.join(counts, "handle", "left").na.fill(0, ["saved", "dismissed"])


def delete(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Items without ``ids`` (id); what was linked to them is canonical again."""
    gone = ids.select("id").distinct()
    left = items.join(gone, "id", "left_anti")
    orphans = gone.select(F.col("id").alias("duplicate_of"), F.lit(True).alias("__gone"))
    return left.join(orphans, "duplicate_of", "left").withColumn("duplicate_of", F.when(F.col("__gone"), None).otherwise(F.col("duplicate_of"))).select(*items.columns)


def empty_trash(items: DataFrame, now_ms: int, days: int = 30) -> DataFrame:
    return delete(items, items.filter((F.col("state") == "trash") & (F.col("updated_ms") <= now_ms - days * 86_400_000)))


def interest_keywords(titles: DataFrame, stated: tuple[str, ...], topics: list[str], limit: int = 64) -> list[str]:
    """Stated interests, telling words of saved titles (weight over 0.35 of the best 24), topics."""
    from ..functions.text import keywords

    text = titles.orderBy(F.desc("ts_ms"), "title").limit(200).agg(F.array_join(F.sort_array(F.collect_list("title")), "\n").alias("t"))
    mined = text.select(F.explode(keywords(F.col("t"), 24)).alias("k")).filter("k.weight > 0.35").select("k.term").collect()  # 24 at most
    out = [s.strip().lower() for s in stated if len(s.strip()) >= 2] + [r["term"] for r in mined] + topics
    return list(dict.fromkeys(out))[:limit]


def numbered(batch: DataFrame, order: list[Column]) -> DataFrame:
    """``batch`` with seq, its order of arrival, where the source gives none. One small batch (at most 500 rows) at a time."""
    return batch.withColumn("seq", F.row_number().over(Window.orderBy(*order)).cast("long"))


def interest_profile(items: DataFrame, stated: tuple[str, ...] = (), clusters: int = 3, most: int = 400) -> tuple[list[list[float]], list[str]]:
    """Interest vectors and keywords: centres of the ``most`` latest saved items' vectors, one vector for each stated interest, and telling words, topics included."""
    from ..functions.similarity import interest_clusters
    from .search import embed_query

    saved_items = items.filter("state = 'saved' and duplicate_of is null")
    rows = saved_items.filter("embedding is not null").orderBy(F.desc("updated_ms"), "id").limit(most).select("embedding").collect()
    vectors = [[float(x) for x in c] for c in interest_clusters([r["embedding"] for r in rows], clusters)] if rows else []
    vectors += [embed_query(items, s) for s in stated if s.strip()]
    topics = saved_items.select(F.explode("topics").alias("t")).groupBy("t").count().orderBy(F.desc("count"), "t").limit(12)
    return vectors, interest_keywords(saved_items.select("title", F.col("updated_ms").alias("ts_ms")), stated, [r["t"] for r in topics.collect()])
