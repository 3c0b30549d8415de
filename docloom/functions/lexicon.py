"""Topics and entities by lexicon. A lexicon is a parameter; the small default one shows the shape."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import ahocorasick
import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf


@dataclass(frozen=True)
class Topic:
    id: str
    label: str
    label_zh: str
    terms: tuple[str, ...]
    query_synonyms: tuple[str, ...] = ()


@dataclass(frozen=True)
class Entity:
    """``exact``: matched with its case; the name itself is then an alias, so upper-case acronyms are found."""

    name: str
    type: str
    aliases: tuple[str, ...] = ()
    exact: bool = False


@dataclass(frozen=True)
class Lexicon:
    topics: tuple[Topic, ...] = ()
    entities: tuple[Entity, ...] = ()
    _compiled: dict = field(default_factory=dict, compare=False, repr=False)


DEFAULT = Lexicon(
    topics=(
        Topic("training", "Training", "训练", ("pretraining", "fine-tuning", "finetune", "training run", "预训练", "微调"), ("train", "训练")),
        Topic("inference", "Inference", "推理", ("inference", "latency", "throughput", "quantization", "kv cache", "推理", "量化"), ("serving", "speed", "部署")),
        Topic("retrieval", "Retrieval", "检索", ("retrieval", "vector search", "embedding", "rerank", "检索", "向量"), ("search", "rag")),
        Topic("agents", "Agents", "智能体", ("agent", "tool use", "planning", "智能体"), ("automation", "workflow")),
        Topic("data", "Data", "数据", ("dataset", "deduplication", "data pipeline", "parquet", "数据集"), ("corpus", "数据")),
        Topic("evaluation", "Evaluation", "评测", ("benchmark", "evaluation", "leaderboard", "ablation", "评测", "基准"), ("compare", "score")),
        Topic("hardware", "Hardware", "硬件", ("gpu", "accelerator", "memory bandwidth", "显卡", "芯片"), ("chip", "cluster")),
        Topic("safety", "Safety", "安全", ("alignment", "red team", "jailbreak", "对齐", "安全"), ("risk", "policy")),
    ),
    entities=(
        Entity("Apache Spark", "product", ("apache spark", "pyspark", "spark sql")),
        Entity("DuckDB", "product", ("duckdb",)),
        Entity("PyTorch", "product", ("pytorch", "torch.compile")),
        Entity("Parquet", "technique", ("parquet",)),
        Entity("MMLU", "benchmark", ("mmlu",), exact=True),
        Entity("GPU", "hardware", ("gpus",), exact=True),
        Entity("RAG", "technique", ("retrieval-augmented generation", "检索增强生成"), exact=True),
        Entity("RLHF", "technique", ("reinforcement learning from human feedback",), exact=True),
    ),
)
_CJK = re.compile("[一-鿿぀-ヿ가-힯]")


def _automaton(words: Iterable[tuple[str, int]]) -> ahocorasick.Automaton | None:
    """All words in one automaton, each with the list of its numbers; None where there are no words."""
    numbers: dict[str, list[int]] = {}
    for word, number in words:
        if word:
            numbers.setdefault(word, []).append(number)
    if not numbers:
        return None
    out = ahocorasick.Automaton()
    for word, places in numbers.items():
        out.add_word(word, (len(word), places))
    out.make_automaton()
    return out


def _terms(lexicon: Lexicon, for_query: bool) -> tuple[list[tuple[int, str]], ahocorasick.Automaton | None]:
    """(topic, term) of each term, and the automaton over them."""
    key = ("terms", for_query)
    if key not in lexicon._compiled:
        terms = [(i, term) for i, topic in enumerate(lexicon.topics) for term in topic.terms + (topic.query_synonyms if for_query else ())]
        lexicon._compiled[key] = terms, _automaton((term, n) for n, (_, term) in enumerate(terms))
    return lexicon._compiled[key]


def _counts(automaton: ahocorasick.Automaton, text: str) -> dict[int, int]:
    """Occurrences of each number's word that don't overlap, from the left."""
    counts: dict[int, int] = {}
    free: dict[int, int] = {}
    for end, (length, places) in automaton.iter(text):
        if end - length + 1 >= free.get(places[0], 0):
            free[places[0]] = end + 1
            for n in places:
                counts[n] = counts.get(n, 0) + 1
    return counts


def classify(lexicon: Lexicon, title: str, body: str, limit: int = 5, for_query: bool = False) -> list[str]:
    """Topic ids, best first: 3 for a term in the title, 1 + log2 of its hits (4 at most) in the body; far from the best they go. Each text is read once, whatever the number of terms."""
    terms, automaton = _terms(lexicon, for_query)
    if automaton is None:
        return []
    scored: dict[int, float] = {}
    for n in sorted(_counts(automaton, title.lower())):
        scored[terms[n][0]] = scored.get(terms[n][0], 0) + 3
    for n, hits in sorted(_counts(automaton, body.lower()).items()):
        scored[terms[n][0]] = scored.get(terms[n][0], 0) + 1 + math.log2(min(4, hits))
    scores = sorted(((lexicon.topics[i].id, scored[i]) for i in sorted(scored)), key=lambda x: -x[1])
    top = scores[0][1] if scores else 0
    floor = max(1, 0.2 * top) if for_query else max(2.5, 0.4 * top)
    return [i for i, s in scores if s >= floor][:limit]


class _Folds(dict):
    """One character for one: what matches without regard to case has one fold. A superset of the pattern's own rule, which decides."""

    def __missing__(self, code: int) -> int:
        char = chr(code)
        folded = next((f for f in (char.casefold(), char.lower()) if len(f) == 1), char)
        self[code] = code if code in range(0x4E00, 0xA000) else ord({"\u0130": "i", "\u0131": "i"}.get(char, folded))
        return self[code]


_FOLDS = _Folds()


def _patterns(lexicon: Lexicon, literal: bool) -> list[tuple[re.Pattern, Entity, str]]:
    if literal not in lexicon._compiled:
        out = []
        for e in lexicon.entities:
            for alias in dict.fromkeys((*e.aliases, *(() if literal and e.aliases else (e.name,)))):
                escaped = re.escape(alias)
                edge = escaped if _CJK.search(alias) else rf"(?<!\w){escaped}(?!\w)"
                exact = e.exact and (literal or alias == e.name)
                out.append((re.compile(edge, 0 if exact else re.IGNORECASE), e, alias))
        lexicon._compiled[literal] = sorted(out, key=lambda x: -len(x[2]))
    return lexicon._compiled[literal]


def _aliases(lexicon: Lexicon, literal: bool) -> tuple[list[tuple[re.Pattern, Entity, str]], ahocorasick.Automaton | None]:
    key = ("aliases", literal)
    if key not in lexicon._compiled:
        patterns = _patterns(lexicon, literal)
        lexicon._compiled[key] = patterns, _automaton((alias.translate(_FOLDS), n) for n, (_, _, alias) in enumerate(patterns))
    return lexicon._compiled[key]


def entities_in(lexicon: Lexicon, text: str, limit: int | None = 24, literal: bool = False, reach: int | None = 12_000) -> list[dict]:
    """type, name, confidence of the entities in the first ``reach`` characters (None: in all), longest aliases first, ``limit`` at most. ``literal``: a case-sensitive entity has only its listed aliases.

    One pass of the automaton over the folded text finds where aliases may be; each is held against its case and edges there, until it is found once.
    """
    patterns, automaton = _aliases(lexicon, literal)
    if automaton is None or not text:
        return []
    stop = len(text) if reach is None else min(reach, len(text))
    hit: set[int] = set()
    for end, (length, places) in automaton.iter(text[:stop].translate(_FOLDS)):
        for n in places:
            if n not in hit and patterns[n][0].match(text, end - length + 1, stop):
                hit.add(n)
    found: dict[str, dict] = {}
    for n in sorted(hit):
        if limit is not None and len(found) >= limit:
            break
        _, entity, alias = patterns[n]
        if entity.name not in found:
            confidence = 1.0 if len(alias) >= 10 else 0.9 if len(alias) >= 6 else 0.85 if entity.exact else 0.7
            found[entity.name] = {"type": entity.type, "name": entity.name, "confidence": confidence}
    return list(found.values())


def topics_of(title: Column, summary: Column, content: Column, lexicon: Lexicon = DEFAULT, limit: int = 5) -> Column:
    plain = Lexicon(lexicon.topics, lexicon.entities)

    @pandas_udf("array<string>")
    def run(titles: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([classify(plain, t or "", b or "", limit) for t, b in zip(titles, bodies, strict=True)], dtype="object")

    return run(title, F.concat_ws("\n", summary, F.substring(content, 1, 8000)))


def entities_of(text: Column, lexicon: Lexicon = DEFAULT, limit: int | None = 24, reach: int | None = 12_000) -> Column:
    """As ``entities_in``; the lexicon goes to the tasks once, and each worker builds its automaton for all its rows."""
    plain = Lexicon(lexicon.topics, lexicon.entities)
    shared = SparkContext.getOrCreate().broadcast(plain) if len(lexicon.entities) > 100 else None
    small = None if shared else plain

    @pandas_udf("array<struct<type:string,name:string,confidence:double>>")
    def run(texts: pd.Series) -> pd.Series:
        words = small if shared is None else shared.value
        return pd.Series([entities_in(words, t or "", limit, reach=reach) for t in texts], dtype="object")

    return run(text if reach is None else F.substring(text, 1, reach))


def topic_label(c: Column, lexicon: Lexicon = DEFAULT, locale: str = "en") -> Column:
    pairs = [F.lit(x) for t in lexicon.topics for x in (t.id, t.label_zh if locale == "zh" else t.label)]
    return F.coalesce(F.create_map(*pairs)[c], c) if pairs else c
