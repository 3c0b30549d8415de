"""Standing searches as rows: each is indexed under its rarest required value, items probe that index, and the other conditions are checked on what meets.

A search requires one of its sources, kinds, authors, its collection or its language, or each of its tags and topics. It is put under the alternative whose values are rarest among the items (of tags and topics one value
will do), so a search for a frequent source and a rare tag meets the items of the tag only. The searches without any such value are a query set against all items: distinct conditions, in blocks that are compared with
batches of items as arrays, up to ``PER_SCAN`` of them in one pass.

Searches are counted by their distinct conditions: what meets one of these is counted by time once, and each search reads off what came after it was last seen.

Malformed queries are default ones, as for a stored query; null conditions are none; words aren't looked at. A search without ``last_seen_ms`` has seen nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import KINDS, SOURCES, STATES
from .filters import when_ms
from .storage import saved

PER_SCAN = 65_536
_BLOCK, _PERIODS = 512, 128
_LISTS = ("states", "sources", "kinds", "authors", "tags", "topics")
_FIELDS = {"min_score": "double", "from_ms": "long", "to_ms": "long", "starred": "boolean", "unread": "boolean", "has_media": "boolean", "lang": "string", "collection_id": "string", "include_duplicates": "boolean"}
QUERY = "struct<" + ", ".join([*(f"{n}: array<string>" for n in _LISTS), *(f"{n}: {t}" for n, t in _FIELDS.items())]) + ">"


def parsed(searches: DataFrame) -> DataFrame:
    """search_id, q (a struct of conditions), since, of searches (id, query, last_seen_ms); values that a search can't ask for go."""
    q = F.coalesce(F.from_json("query", QUERY.replace(": ", ":")), F.from_json(F.lit("{}"), QUERY.replace(": ", ":")))
    rows = searches.select(F.col("id").alias("search_id"), q.alias("q"), F.coalesce("last_seen_ms", F.lit(0)).alias("since"))
    allowed = {"states": STATES, "sources": SOURCES, "kinds": KINDS}
    lists = [F.array_intersect(F.coalesce(f"q.{n}", _none()), F.array(*map(F.lit, allowed[n]))) if n in allowed else F.coalesce(f"q.{n}", _none()) for n in _LISTS]
    flags = [F.coalesce(f"q.{n}", F.lit(False)) if n in ("unread", "has_media", "include_duplicates") else F.nullif(F.col("q.lang"), F.lit("")) if n == "lang" else F.col(f"q.{n}") for n in _FIELDS]
    return rows.select("search_id", F.struct(*(c.alias(n) for c, n in zip([*lists, *flags], [*_LISTS, *_FIELDS], strict=True))).alias("q"), "since")


def _none() -> Column:
    return F.array().cast("array<string>")


def _values(items: DataFrame, members: DataFrame | None, columns: list[str]) -> DataFrame:
    """key and ``columns`` of every item, a row for each value that a search may require of it."""
    one = lambda what, c: F.array(F.concat(F.lit(f"{what}:"), F.col(c)))
    many = lambda what, c: F.transform(F.array_distinct(F.coalesce(c, _none())), lambda v: F.concat(F.lit(f"{what}:"), v))
    keys = F.concat(one("sources", "source"), one("kinds", "kind"), one("authors", "author.handle"), one("lang", "lang"), many("tags", "tags"), many("topics", "topics"))
    rows = items.select(F.explode(keys).alias("key"), *columns).filter("key is not null")
    if members is not None:
        inside = members.select(F.col("item_id").alias("id"), F.concat(F.lit("collection_id:"), "collection_id").alias("key")).distinct()
        rows = rows.union(items.select(*columns).join(inside, "id").select("key", *columns))
    return rows


def _choices(searches: DataFrame) -> DataFrame:
    """search_id, choice, key: the values of each alternative that a search can be indexed under."""
    key = lambda what: lambda v: F.concat(F.lit(f"{what}:"), v)
    any_of = [F.struct(F.lit(w).alias("choice"), F.transform(F.array_distinct(f"q.{w}"), key(w)).alias("keys")) for w in ("sources", "kinds", "authors")]
    single = [F.struct(F.lit(w).alias("choice"), F.when(F.col(f"q.{w}").isNull(), _none()).otherwise(F.array(F.concat(F.lit(f"{w}:"), f"q.{w}"))).alias("keys")) for w in ("lang", "collection_id")]
    alone = lambda what: lambda v: F.struct(key(what)(v).alias("choice"), F.array(key(what)(v)).alias("keys"))
    each = [F.transform(F.array_distinct(f"q.{w}"), alone(w)) for w in ("tags", "topics")]
    rows = searches.select("search_id", F.explode(F.concat(F.array(*any_of, *single), *each)).alias("c"))
    return rows.select("search_id", "c.choice", F.explode("c.keys").alias("key"))


def _fits(q: str = "q") -> Column:
    """Whether an item meets all conditions of a search that stand in its own columns."""
    c = lambda n: F.col(f"{q}.{n}")
    unless = lambda absent, test: absent | F.coalesce(test, F.lit(False))
    empty = lambda n: F.size(c(n)) == 0
    tests = [
        c("include_duplicates") | F.col("duplicate_of").isNull(),
        F.when(empty("states"), F.col("state") != "trash").otherwise(F.array_contains(c("states"), F.col("state"))),
        *(unless(empty(n), F.array_contains(c(n), F.col(column))) for n, column in (("sources", "source"), ("kinds", "kind"), ("authors", "author.handle"))),
        *(unless(empty(n), F.size(F.array_except(c(n), F.coalesce(n, _none()))) == 0) for n in ("tags", "topics")),
        unless(c("min_score").isNull(), F.col("score") >= c("min_score")),
        unless(c("from_ms").isNull(), when_ms() >= c("from_ms")),
        unless(c("to_ms").isNull(), when_ms() <= c("to_ms")),
        unless(c("starred").isNull(), F.coalesce("starred", F.lit(False)) == c("starred")),
        ~c("unread") | F.col("read_ms").isNull(),
        ~c("has_media") | (F.coalesce(F.size("media"), F.lit(0)) > 0),
        unless(c("lang").isNull(), F.col("lang") == c("lang")),
        F.col("captured_ms") > F.col("since"),
    ]
    return reduce(lambda a, b: a & b, (F.coalesce(t, F.lit(False)) for t in tests))


def anchored(items: DataFrame, searches: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """search_id, key: what each of the ``parsed`` searches is indexed under; those without a required value are missing."""
    frequency = _values(items, members, ["id"]).groupBy("key").agg(F.count("*").alias("n"))
    costs = _choices(searches).join(frequency, "key", "left").groupBy("search_id", "choice").agg(F.sum(F.coalesce("n", F.lit(0))).alias("cost"), F.collect_set("key").alias("keys"))
    best = costs.groupBy("search_id").agg(F.min_by("keys", F.struct("cost", "choice")).alias("keys"))
    return best.select("search_id", F.explode("keys").alias("key"))


def _met(items: DataFrame, wanted: DataFrame, members: DataFrame | None) -> DataFrame:
    """search_id, id, captured_ms of all items that match ``wanted`` (search_id, q, since), a stored table."""
    index = saved(anchored(items, wanted, members).join(wanted, "search_id"))
    used = ["id", "duplicate_of", "state", "source", "kind", "author", "tags", "topics", "score", "published_ms", "captured_ms", "starred", "read_ms", "media", "lang"]
    met = _values(items, members, used).join(index, "key").filter(_fits())  # checked where they meet; an item has a key once, so it meets a search once
    if members is not None:
        inside = members.select(F.col("collection_id").alias("in_collection"), F.col("item_id").alias("id")).distinct()
        both = met.filter("q.collection_id is not null").select("search_id", "id", "captured_ms", F.col("q.collection_id").alias("in_collection"))
        met = met.filter("q.collection_id is null").select("search_id", "id", "captured_ms").union(both.join(inside, ["in_collection", "id"], "left_semi").select("search_id", "id", "captured_ms"))
    return met.select("search_id", "id", "captured_ms")


def standing_matches(items: DataFrame, searches: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """search_id, id of all items that match searches (id, query, last_seen_ms) with a required value: alerts, one row a match. ``members``: collection_id, item_id, for searches in collections."""
    return _met(items, saved(parsed(searches)), members).select("search_id", "id")


def _later(times: DataFrame, asked: DataFrame, edges: list[int]) -> DataFrame:
    """c, since, n: of ``times`` (c, at, n; one row a time) the sum after each of ``asked`` (c, since; distinct). Sums go by period between the ``edges`` and inside one, so conditions that all items meet are no one task."""
    period = lambda at: F.size(F.filter(F.lit(edges), lambda e: e <= F.col(at))) if edges else F.lit(0)
    rows = times.select("c", period("at").alias("period"), "at", "n", F.lit(0).alias("ask")).union(asked.select("c", period("since"), "since", F.lit(0).cast("long"), F.lit(1)))
    rows = saved(rows)
    after = Window.partitionBy("c").orderBy(F.desc("period")).rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.groupBy("c", "period").agg(F.sum("n").alias("n")).select("c", "period", F.coalesce(F.sum("n").over(after), F.lit(0)).alias("whole"))
    inside = Window.partitionBy("c", "period").orderBy(F.desc("at"), F.desc("ask")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a search before the items of its time
    part = rows.withColumn("part", F.sum("n").over(inside)).filter("ask = 1").join(whole, ["c", "period"])
    return part.select("c", F.col("at").alias("since"), (F.col("whole") + F.col("part")).alias("n"))


def _scanned(items: DataFrame, conditions: list[str], asked: list[tuple[int, int]]) -> DataFrame:
    """i, since, n: how many items meet the condition of each (i, since) after that time, of conditions (JSON) that require no value."""
    q = [json.loads(c) for c in conditions]
    column = lambda name, absent, kind: np.array([absent if x.get(name) is None else x[name] for x in q], kind)
    has = lambda name: np.array([x.get(name) is not None for x in q])
    state = np.array([[s in x["states"] if x["states"] else s != "trash" for s in STATES] + [not x["states"]] for x in q])  # the last column: states by other names
    least, begin, end = (column(n, 0, np.float64) for n in ("min_score", "from_ms", "to_ms"))
    any_score, any_begin, any_end, any_star = (~has(n) for n in ("min_score", "from_ms", "to_ms", "starred"))
    star, unread, media, twins = (column(n, False, bool) for n in ("starred", "unread", "has_media", "include_duplicates"))
    of, since = (np.array(x, np.int64) for x in zip(*sorted(asked), strict=True))
    blocks = [(i, *np.searchsorted(of, (i, i + _BLOCK))) for i in range(0, len(q), _BLOCK)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(of), np.int64)
        for b in batches:
            captured = b.column(3).to_numpy(zero_copy_only=False)
            order = np.argsort(captured)
            place, score, when, captured, starred, is_read, has_media, twin = (b.column(i).to_numpy(zero_copy_only=False)[order] for i in range(8))
            start = np.searchsorted(captured, since, side="right")
            for i, first, last in blocks:
                c = slice(i, i + _BLOCK)
                fits = state[c].T[place] & (twins[c] | ~twin[:, None])
                fits &= (any_score[c] | (score[:, None] >= least[c])) & (any_begin[c] | (when[:, None] >= begin[c])) & (any_end[c] | (when[:, None] <= end[c]))
                fits &= (any_star[c] | (starred[:, None] == star[c])) & (~unread[c] | ~is_read[:, None]) & (~media[c] | has_media[:, None])
                before = np.concatenate([np.zeros((1, fits.shape[1]), np.int32), np.cumsum(fits, axis=0, dtype=np.int32)])
                mine = of[first:last] - i
                total[first:last] += before[-1, mine] - before[start[first:last], mine]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(of[at].astype(np.int32)), pa.array(since[at]), pa.array(total[at])], ["i", "since", "n"])

    place = F.coalesce(*(F.when(F.col("state") == s, i) for i, s in enumerate(STATES)), F.lit(len(STATES)))
    rows = items.filter("state is not null and captured_ms is not null").select(
        place.alias("place"), F.coalesce(F.col("score").cast("double"), F.lit(float("nan"))).alias("score"), F.coalesce(when_ms().cast("double"), F.lit(float("nan"))), F.col("captured_ms").cast("long"),
        F.coalesce("starred", F.lit(False)), F.col("read_ms").isNotNull(), F.coalesce(F.size("media"), F.lit(0)) > 0, F.col("duplicate_of").isNotNull(),
    )
    return rows.mapInArrow(count, "i int, since long, n long").groupBy("i", "since").agg(F.sum("n").alias("n"))


def standing_counts(items: DataFrame, searches: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """search_id, n: how many items match each search since it was seen, by all its conditions but its words."""
    wanted = saved(parsed(searches).withColumn("c", F.to_json("q")))
    asked = saved(wanted.groupBy("c", "since").agg(F.first("q").alias("q")))
    distinct = saved(asked.groupBy("c").agg(F.first("q").alias("q"), F.min("since").alias("since")).withColumnRenamed("c", "search_id"))
    bound = saved(_choices(distinct).select(F.col("search_id").alias("c")).distinct())
    times = _met(items, distinct, members).groupBy(F.col("search_id").alias("c"), F.col("captured_ms").alias("at")).agg(F.count("*").alias("n"))
    shares = items.select(F.col("captured_ms").cast("double").alias("at")).approxQuantile("at", [i / _PERIODS for i in range(1, _PERIODS)], 0.001)
    counted = saved(_later(times, asked.join(bound, "c", "left_semi").select("c", "since"), sorted({int(x) for x in shares})))
    bare = asked.join(bound, "c", "left_anti").select("c", "since").orderBy("c").toLocalIterator()
    while some := list(islice(bare, PER_SCAN)):
        place = {c: i for i, c in enumerate(dict.fromkeys(r["c"] for r in some))}
        numbers = items.sparkSession.createDataFrame([(i, c) for c, i in place.items()], "i int, c string")
        counted = counted.union(saved(_scanned(items, list(place), [(place[r["c"]], r["since"]) for r in some]).join(numbers, "i").select("c", "since", "n")))
    return wanted.select("search_id", "c", "since").join(counted, ["c", "since"], "left").select("search_id", F.coalesce("n", F.lit(0)).alias("n"))
