"""Keyword, vector and concept retrieval; fusion and diversification."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import CJK_RUN, LATIN_TOKEN, STOPWORDS_EN, cjk_bigrams
from .pivots import finite, nearest_by_pivots, unit_rows
from .storage import saved

# Weight of a match in each column, constants of BM25 and of rank fusion, floors of cosine.
COLUMN_WEIGHTS = {"title": 10.0, "body": 1.0, "author": 3.0, "tags": 4.0, "cjk": 1.0}
K1, B = 1.2, 0.75
RRF_K = 60
LIST_WEIGHTS = {"keyword": 1.2, "concept": 1.0, "semantic": 0.85}
FLOOR_SEMANTIC, FLOOR_SIMILAR = 0.15, 0.2
# Chinese question words and particles that a query's run begins or ends with.
_QUESTION = ("怎么样", "为什么", "是什么", "怎样", "怎么", "如何", "什么", "哪些", "哪个", "有没有", "能不能", "可以", "我想", "请问", "求", "的", "了", "呢", "吗", "啊", "一下", "介绍")


def fold_tokens(c: Column) -> Column:
    """Index tokens: lower case without accents, cut at everything but letters and digits."""
    plain = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"[{CJK_RUN}]+", " ")
    accents = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_extract_all(F.translate(plain, *accents), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def documents_of(items: DataFrame) -> DataFrame:
    """Index columns of items: id, title, body, author, tags, cjk token arrays."""
    whole = F.concat_ws(" ", "title", "summary", "content")
    return items.select(
        "id",
        fold_tokens(F.col("title")).alias("title"),
        fold_tokens(F.concat_ws(" ", "summary", "content")).alias("body"),
        fold_tokens(F.concat_ws(" ", "author.name", "author.handle")).alias("author"),
        fold_tokens(F.concat_ws(" ", F.array_join("tags", " "), F.array_join("topics", " "))).alias("tags"),
        cjk_bigrams(whole).alias("cjk"),
    )


def _placed(name: str, weight: float) -> Callable[[Column, Column], Column]:
    return lambda term, i: F.struct(term.alias("term"), F.lit(name).alias("col"), i.alias("pos"), F.lit(weight).alias("w"))


def postings(documents: DataFrame, columns: dict[str, float] = COLUMN_WEIGHTS) -> DataFrame:
    """term, id, tf (weighted by column), positions in each column's order, of documents with token arrays."""
    parts = F.flatten(F.array(*(F.transform(F.col(c), _placed(c, w)) for c, w in columns.items())))
    rows = documents.select("id", F.explode(parts).alias("p")).select("id", "p.*")
    return rows.groupBy("term", "id").agg(F.sum("w").alias("tf"), F.sort_array(F.collect_list(F.struct("col", "pos"))).alias("places"))


def document_lengths(documents: DataFrame, columns: dict[str, float] = COLUMN_WEIGHTS) -> DataFrame:
    total = sum((F.size(c) for c in columns), F.lit(0))
    return documents.select("id", total.alias("length"))


class Clause:
    """One conjunct of a keyword query: any of some phrases; a phrase's last token may be a prefix."""

    def __init__(self, phrases: list[tuple[str, ...]], prefix: bool = False) -> None:
        self.phrases, self.prefix = phrases, prefix

    def __repr__(self) -> str:
        return f"Clause({self.phrases}, prefix={self.prefix})"

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Clause) and (self.phrases, self.prefix) == (other.phrases, other.prefix)


def _pairs(run: str) -> tuple[str, ...]:
    return (run,) if len(run) == 1 else tuple(run[i : i + 2] for i in range(len(run) - 1))


#: Question words at the ends of a run, which keeps two characters at least.
_ENDS = [re.compile(p) for word in _QUESTION for p in (f"^{word}(?=..)", f"(?<=..){word}$")]
#: The parts of a query, each in a group of its own.
_PARTS = re.compile(f'"(?P<phrase>[^"]+)"|(?P<run>[{CJK_RUN}]+)|(?P<term>{LATIN_TOKEN})')


def _parts(q: str | None) -> dict[str, list[str]]:
    """A query's quoted phrases, CJK runs and Latin terms, each kind in order of appearance."""
    found: dict[str, list[str]] = {"phrase": [], "run": [], "term": []}
    for m in _PARTS.finditer((q or "").lower()):
        found[m.lastgroup].append(m[m.lastgroup].strip())
    return found


def _trimmed(run: str) -> str:
    """A run without question words at its ends, to the last."""
    once = reduce(lambda text, end: end.sub("", text), _ENDS, run)
    return once if once == run else _trimmed(once)


def _asked_for(run: str) -> Clause:
    """What a CJK run asks for: a term if short; of a longer one any four neighbours, taken at every second place and at its end."""
    core = _trimmed(run)
    if len(core) < 6:
        return Clause([_pairs(core)])
    return Clause([_pairs(core[i : i + 4]) for i in sorted({*range(0, len(core) - 3, 2), len(core) - 4})])


def compile_query(q: str) -> list[Clause]:
    """A human query as a conjunction: quoted phrases, CJK runs, Latin terms (prefixes from three characters on). Terms are cut as documents are, so a hyphen makes a phrase."""
    parts = _parts(q)
    cut = lambda text: tuple(re.findall(r"[^\W_]+", re.sub(f"[{CJK_RUN}]+", " ", text)))
    quoted = [c for p in parts["phrase"] for c in [*map(_pairs, re.findall(f"[{CJK_RUN}]+", p)), cut(p)] if c]
    terms = [Clause([words], prefix=len(t) >= 3) for t in parts["term"] if len(t) >= 2 and (words := cut(t))]
    return [*(Clause([words]) for words in quoted), *map(_asked_for, parts["run"]), *terms]


def highlight_terms(q: str) -> list[str]:
    """What to mark of a query's parts, 24 at most: phrases, terms that aren't stopwords, CJK runs."""
    parts = _parts(q)
    telling = [t for t in parts["term"] if len(t) >= 2 and t not in STOPWORDS_EN]
    return list(dict.fromkeys(filter(None, [*parts["phrase"], *telling, *parts["run"]])))[:24]


def _followed(word: str, by: int, prefix: bool) -> Callable[[Column], Column]:
    """Whether ``word`` stands ``by`` places after a hit, in the same column."""

    def after(x: Column) -> Column:
        return F.exists("hits", lambda y: (F.startswith(y["term"], F.lit(word)) if prefix else y["term"] == word) & (y["col"] == x["col"]) & (y["pos"] == x["pos"] + by))

    return after


def _wanted(clauses: list[Clause]) -> Callable[[Column], Column]:
    """Whether a term can be part of a match."""
    exact = sorted({t for c in clauses for p in c.phrases for t in (p[:-1] if c.prefix else p)})
    prefixes = sorted({p[-1] for c in clauses if c.prefix for p in c.phrases})
    return lambda t: reduce(lambda a, b: a | b, ([t.isin(*exact)] if exact else []) + [F.startswith(t, F.lit(p)) for p in prefixes])


def _frequencies(clauses: list[Clause]) -> list[Column]:
    """Of each clause the weight of all places where one of its phrases stands, from a document's hits (term, col, pos, w)."""

    def phrase(words: tuple[str, ...], prefix: bool) -> Column:
        found = F.filter("hits", lambda x: F.startswith(x["term"], F.lit(words[0])) if prefix and len(words) == 1 else x["term"] == words[0])
        for j, word in enumerate(words[1:], 1):
            found = F.filter(found, _followed(word, j, prefix and j == len(words) - 1))
        return F.aggregate(found, F.lit(0.0), lambda s, x: s + x["w"])

    return [sum((phrase(p, c.prefix) for p in c.phrases), F.lit(0.0)).alias(f"tf{i}") for i, c in enumerate(clauses)]


def _ranked(weighed: DataFrame, clauses: int, n: int, mean: float, frequency: dict, limit: int, relax: bool) -> DataFrame:
    """id, score, rank by BM25, of documents (id, length, tf0, tf1, ...)."""
    score, every = F.lit(0.0), F.lit(0)
    for name in (f"tf{i}" for i in range(clauses)):
        seen = frequency[name] or 0
        idf = float(max(np.log((n - seen + 0.5) / (seen + 0.5)), 1e-6))
        score = score + idf * F.col(name) * (K1 + 1) / (F.col(name) + K1 * (1 - B + B * F.col("length") / mean))
        every = every + (F.col(name) > 0).cast("int")
    passing = weighed.filter(every > 0 if relax else every == clauses)
    top = passing.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def _nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "id string, score double, rank int")


def keyword_search(documents: DataFrame, q: str, limit: int, relax: bool = False, columns: dict[str, float] = COLUMN_WEIGHTS) -> DataFrame:
    """id, score, rank of the best documents by BM25 over weighted columns: all clauses must match, or any if relaxed.

    A document's hits are found in its own row, so nothing is shuffled, and the texts are read once: lengths and frequencies are written, and ranked from there.
    """
    clauses = compile_query(q)
    if not clauses:
        return _nothing(documents.sparkSession)
    wanted = _wanted(clauses)
    hits = F.concat(*(F.filter(F.transform(c, _placed(c, w)), lambda x: wanted(x["term"])) for c, w in columns.items()))
    length = sum((F.size(c) for c in columns), F.lit(0))
    weighed = saved(documents.select("id", length.alias("length"), hits.alias("hits")).select("id", "length", *_frequencies(clauses)))
    stats = weighed.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"tf{i}") for i in range(len(clauses)))).first()
    if not stats["n"]:
        return _nothing(documents.sparkSession)
    return _ranked(weighed, len(clauses), stats["n"], float(stats["mean"]), stats.asDict(), limit, relax)


@dataclass(frozen=True)
class Index:
    """A stored inverted index. ``postings``: term, id, tf, places, in order of terms, so a query reads the row groups of its terms; ``lengths``: id, length; ``n`` and ``mean`` of them."""

    postings: DataFrame
    lengths: DataFrame
    n: int
    mean: float
    columns: dict[str, float]


def build_index(documents: DataFrame, columns: dict[str, float] = COLUMN_WEIGHTS) -> Index:
    """The index of documents (id, token arrays), as tables in the shared folder."""
    spark = documents.sparkSession
    terms = saved(postings(documents, columns).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "term", "id").sortWithinPartitions("term", "id"))
    lengths = saved(document_lengths(documents, columns))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    return Index(terms, lengths, stats["n"], float(stats["mean"] or 0), dict(columns))


def indexed_search(index: Index, q: str, limit: int, relax: bool = False) -> DataFrame:
    """What ``keyword_search`` gives, from a stored index: only the postings of the query's terms are read."""
    clauses = compile_query(q)
    if not clauses or not index.n:
        return _nothing(index.postings.sparkSession)
    weight = F.create_map(*(F.lit(x) for c, w in index.columns.items() for x in (c, float(w))))
    found = index.postings.filter(_wanted(clauses)(F.col("term"))).select("id", "term", F.explode("places").alias("p"))
    hits = found.groupBy("id").agg(F.collect_list(F.struct("term", "p.col", "p.pos", weight[F.col("p.col")].alias("w"))).alias("hits"))  # hits of one document
    weighed = saved(hits.join(index.lengths, "id").select("id", "length", *_frequencies(clauses)))
    frequency = weighed.agg(*(F.count_if(F.col(f"tf{i}") > 0).alias(f"tf{i}") for i in range(len(clauses)))).first()
    return _ranked(weighed, len(clauses), index.n, index.mean, frequency.asDict(), limit, relax)


def _frame(**columns: np.ndarray) -> pd.DataFrame:
    """A frame whose strings are plain objects, which Arrow takes as one array."""
    return pd.DataFrame({k: pd.Series(v if v.dtype.kind in "biuf" else v.astype(object), dtype=None if v.dtype.kind in "biuf" else object) for k, v in columns.items()})


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int, floor: float = -1.0, block_rows: int = 1024, skip_self: bool = True) -> DataFrame:
    """query_id, id, similarity, rank: the ``k`` most alike by cosine, exactly, of ``vectors`` (id, embedding). Ties go to smaller identifiers.

    Up to ``block_rows`` queries go to every task with the function, which passes over the corpus once; more meet it in cells around pivots (``pivots.nearest_by_pivots``).
    """
    asked = queries.select("id", "embedding").filter(finite("embedding"))
    block = asked.limit(block_rows + 1).collect()
    if len(block) > block_rows:
        return nearest_by_pivots(vectors, queries, k, floor, skip_self)
    kind = vectors.schema["id"].dataType.simpleString()
    if not block:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, id {kind}, similarity double, rank int")
    names, q = np.array([r["id"] for r in block], None if kind != "string" else object), unit_rows(pa.array([r["embedding"] for r in block], pa.list_(pa.float64())))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.full((len(q), k), -np.inf)  # of each query the k best so far in this task, in order
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                ids, m = batch.column(0).slice(start, 2048), unit_rows(batch.column(1).slice(start, 2048))
                similar = q @ m.T
                if skip_self:
                    similar[names[:, None] == ids.to_numpy(zero_copy_only=False)[None, :]] = -np.inf
                top = np.sort(np.concatenate([top, similar], axis=1), axis=1)[:, -k:]
                query, place = np.nonzero((similar >= np.maximum(top[:, :1], floor)) & (similar > -np.inf))
                yield pa.RecordBatch.from_arrays([pa.array(names[query], batch.schema.field(0).type), ids.take(pa.array(place)), pa.array(similar[query, place])], ["query_id", "id", "similarity"])

    found = vectors.filter(finite("embedding")).select("id", "embedding").mapInArrow(best, f"query_id {kind}, id {kind}, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def concept_search(items: DataFrame, topics: list[str], entities: list[str], limit: int) -> DataFrame:
    """id, overlap, rank of the items that share most topics and entities with the query; ties go to better scores."""
    names = F.transform(F.coalesce(F.col("entities"), F.array()), lambda e: e["name"])
    shared = lambda have, want: F.size(F.array_intersect(have, F.array(*map(F.lit, want)))) if want else F.lit(0)
    overlap = shared(F.coalesce(F.col("topics"), F.array().cast("array<string>")), topics) + shared(names, entities)
    hits = items.select("id", "score", overlap.alias("overlap")).filter("overlap > 0").orderBy(F.desc("overlap"), F.desc("score"), "id").limit(limit)
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("overlap"), F.desc("score"), "id"))).select("id", "overlap", "rank")


def reciprocal_rank_fusion(lists: dict[str, DataFrame], weights: dict[str, float] = LIST_WEIGHTS, k: int = RRF_K) -> DataFrame:
    """id, fused, matched_by of ranked lists (id, rank): the sum of weight / (k + rank)."""
    rows = None
    for name, ranked in lists.items():
        part = ranked.select("id", (F.lit(float(weights.get(name, 1.0))) / (k + F.col("rank"))).alias("part"), F.lit(name).alias("list"))
        rows = part if rows is None else rows.unionByName(part)
    by = lambda name: F.max((F.col("list") == name).cast("int")) == 1
    fuzzy = F.max((F.col("list") != "keyword").cast("int")) == 1
    matched = F.when(by("keyword") & fuzzy, "both").when(by("keyword"), "keyword").otherwise("semantic")
    return rows.groupBy("id").agg(F.sum("part").alias("fused"), matched.alias("matched_by")).orderBy(F.desc("fused"), "id")


def maximal_marginal_relevance(relevances: np.ndarray, vectors: np.ndarray, balance: float, limit: int) -> list[int]:
    """Greedy picks of a bounded candidate list: relevance (over its maximum) against likeness to what is picked."""
    n = len(relevances)
    if balance >= 1 or n <= 1:
        return list(range(min(n, limit)))
    top = relevances.max()
    gain = relevances / top if top > 0 else relevances
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    likeness, left, picked = np.zeros(n), np.ones(n, bool), []
    while len(picked) < min(limit, n):
        value = np.where(left, balance * gain - (1 - balance) * likeness, -np.inf)
        i = int(value.argmax())
        picked.append(i)
        left[i] = False
        likeness = np.maximum(likeness, unit @ unit[i]) if len(picked) > 1 else unit @ unit[i]
    return picked


def diversified(candidates: DataFrame, balance: float, limit: int) -> DataFrame:
    """``candidates`` (query_id, id, fused, embedding; at most a few hundred a query) in order of greedy picks: query_id, id, pick. Each query is a group of its own."""

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["fused", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        size = max((len(e) for e in rows.embedding if e is not None), default=1)
        vectors = np.stack([np.zeros(size) if e is None else np.asarray(e, float) for e in rows.embedding])
        order = maximal_marginal_relevance(rows.fused.to_numpy(float), vectors, balance, limit)
        return _frame(query_id=rows.query_id[order].to_numpy(), id=rows.id[order].to_numpy(), pick=np.arange(1, len(order) + 1))

    kinds = {c: candidates.schema[c].dataType.simpleString() for c in ("query_id", "id")}
    return candidates.groupBy("query_id").applyInPandas(pick, f"query_id {kinds['query_id']}, id {kinds['id']}, pick int")


def interleave(rows: list, bucket, longest: int = 2) -> list:
    """A bounded list, kept in order but for runs of over ``longest`` of one bucket, which wait for another's turn."""
    out: list = []
    waiting = list(rows)
    while waiting:
        run = [bucket(x) for x in out[-longest:]]
        stuck = len(run) == longest and len(set(run)) == 1
        i = next((i for i, x in enumerate(waiting) if not stuck or bucket(x) != run[0]), 0)
        out.append(waiting.pop(i))
    return out


def capped(rows: DataFrame, key: Column, order: list[Column], most: int, limit: int) -> DataFrame:
    """At most ``most`` rows a key, best first, ``limit`` in all."""
    return rows.withColumn("__turn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("__turn") <= most).drop("__turn").orderBy(*order).limit(limit)
