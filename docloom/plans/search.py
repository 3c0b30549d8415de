"""Hybrid search: keyword, concept and vector retrieval, fused by rank, diversified on request, with facets and paging."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import DEFAULT, Lexicon, classify, entities_in
from ..functions.similarity import embed_tokens
from ..functions.text import snippet, tokenize
from ..operators.analytics import facets
from ..operators.filters import browse, decode_cursor, encode_cursor, matching, ordering
from ..operators.ranking import FLOOR_SEMANTIC, FLOOR_SIMILAR, concept_search, diversified, documents_of, highlight_terms, keyword_search, nearest_vectors, reciprocal_rank_fusion
from ..operators.storage import saved
from ..schema import SearchQuery


@dataclass(frozen=True)
class Page:
    """``items``: the page in order; ``total``: candidates; ``cursor``: of the next page; ``facets``: facet, value, n (of the filters, not the words)."""

    items: DataFrame
    total: int
    cursor: str | None
    facets: DataFrame | None
    terms: list[str]


def depth(limit: int) -> int:
    return min(400, max(4 * limit, 60))


def embed_query(df: DataFrame, q: str) -> list[float]:
    tokens = df.sparkSession.createDataFrame([(q,)], "q string").select(tokenize(F.col("q")).alias("t")).first()["t"]
    return [float(x) for x in embed_tokens(list(tokens))]


def search(items: DataFrame, query: SearchQuery, lexicon: Lexicon = DEFAULT, members: DataFrame | None = None, with_facets: bool = False) -> Page:
    """Filters come before every retriever; trash and duplicates never surface. Only where all three find nothing is the keyword query relaxed to any term."""
    query = query.bounded()
    spark = items.sparkSession
    fits = matching(items, query, members)
    found_facets = facets(fits, {"source": (F.col("source"), 12), "topic": (F.col("topics"), 16), "tag": (F.col("tags"), 16), "author": (F.col("author.handle"), 12)}) if with_facets else None
    offset = decode_cursor(query.cursor)
    if not query.q.strip():
        total = fits.count()
        more = total > offset + query.limit
        return Page(browse(items, query, members).limit(query.limit), total, encode_cursor(offset + query.limit) if more else None, found_facets, [])
    most = depth(query.limit)
    documents = documents_of(fits)
    vector = spark.createDataFrame([("", embed_query(items, query.q))], "id string, embedding array<float>")
    lists = {"keyword": keyword_search(documents, query.q, most).select("id", "rank")}
    if query.mode != "keyword":
        topics, names = classify(lexicon, "", query.q, 4, for_query=True), [e["name"] for e in entities_in(lexicon, query.q)]
        lists["concept"] = concept_search(fits, topics, names, most).select("id", "rank")
        lists["semantic"] = nearest_vectors(fits.select("id", "embedding"), vector, most, FLOOR_SEMANTIC).select("id", "rank")
    lists = {name: saved(ranked) for name, ranked in lists.items()}  # at most 400 rows each
    if all(ranked.isEmpty() for ranked in lists.values()):
        lists["keyword"] = saved(keyword_search(documents, query.q, most, relax=True).select("id", "rank"))
    fused = reciprocal_rank_fusion(lists).limit(most)
    if query.diversify > 0:
        candidates = fused.join(fits.select("id", "embedding"), "id").withColumn("query_id", F.lit("q"))
        order = diversified(candidates, 1 - query.diversify, 2 * query.limit).select("id", "pick")
        fused = fused.join(order, "id").orderBy("pick")
    else:
        fused = fused.orderBy(F.desc("fused"), "id")
    ranked = fused.collect()  # at most 400 rows
    page = ranked[offset : offset + query.limit]
    rows = spark.createDataFrame([(i, r["id"], r["fused"], r["matched_by"]) for i, r in enumerate(page)], "position int, id string, fused double, matched_by string")
    terms = highlight_terms(query.q)
    shown = rows.join(fits, "id").withColumn("snippet", snippet(F.concat_ws("\n", "summary", "content"), terms))
    sort = query.resolved_sort
    shown = shown.orderBy("position") if sort == "relevance" else shown.orderBy(*ordering(sort))
    more = len(ranked) > offset + query.limit
    return Page(shown, len(ranked), encode_cursor(offset + query.limit) if more else None, found_facets, terms)


def similar(items: DataFrame, item_id: str, limit: int = 8) -> DataFrame:
    """Items like one of them: not itself, no duplicates, no trash."""
    fits = matching(items, SearchQuery())
    query = items.filter(F.col("id") == item_id).select("id", "embedding")
    near = nearest_vectors(fits.select("id", "embedding"), query, limit + 6, FLOOR_SIMILAR).select("id", "similarity", "rank")
    return near.join(fits, "id").orderBy("rank").limit(limit)


def ask(items: DataFrame, turns: list[tuple[str, str]], top: int = 12, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Numbered citations for the last user turn: n, id, title, url, snippet. There is no language model here; the answer is the list."""
    question = next((text for role, text in reversed(turns) if role == "user"), "")[:500]
    page = search(items, SearchQuery(q=question, limit=min(40, top), diversify=0.3), lexicon)
    cited = page.items.select((F.col("position") + 1).alias("n"), "id", "title", "url", F.substring("snippet", 1, 700).alias("snippet"))
    return cited.orderBy("n")


def smart(items: DataFrame, query: SearchQuery, members: DataFrame | None = None) -> DataFrame:
    return search(items, replace(query, cursor=None), members=members).items


def context_block(items: DataFrame, limit: int = 1200) -> str:
    """Numbered context of a bounded, ordered list of items (title, url, summary, content)."""
    text = F.substring(F.coalesce(F.nullif("content", F.lit("")), "summary", F.lit("")), 1, limit)
    rows = items.select("title", "url", text.alias("text")).collect()
    return "\n\n".join(f"[{i}] {r['title'] or r['url']}\n{r['url']}\n{r['text']}" for i, r in enumerate(rows, 1))
