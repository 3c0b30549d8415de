"""The automaton against one search for each alias, and its time against the number of aliases."""

from __future__ import annotations

import math
import pickle
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.functions.lexicon import Entity, Lexicon, Topic, _patterns, classify, entities_in

WORDS = ["RAG", "rag time", "ragtime", "GPU", "gpus", "C++", "检索", "检索增强", "Straße", "İx", "kiss", "a.b", "aa", "aaa", "im"]
LEXICON = Lexicon(
    topics=(Topic("x", "X", "X", ("aa", "rag", "检索"), ("im",)), Topic("y", "Y", "Y", ("aaa", "rag", "gpu"), ()), Topic("z", "Z", "Z", ("",), ())),
    entities=tuple(Entity(w, "t", tuple(WORDS[(i + k) % len(WORDS)] for k in (3, 7)) if i % 2 else (), exact=i % 3 == 0) for i, w in enumerate(WORDS)),
)
PIECES = st.lists(st.sampled_from([*WORDS, *(w.lower() for w in WORDS), *(w.upper() for w in WORDS), " ", "_", "-", "x", "ſ", "ı", "K", "é"]), max_size=25).map("".join)


def one_by_one(text, limit, literal, reach):
    found = {}
    for pattern, entity, _ in _patterns(LEXICON, literal):
        if len(found) < limit and entity.name not in found and pattern.search(text, 0, reach):
            found[entity.name] = entity
    return list(found)


@settings(max_examples=400, deadline=None)
@given(PIECES, st.booleans(), st.sampled_from([3, 24]), st.sampled_from([7, 12_000]))
def test_entities(text, literal, limit, reach):
    assert [e["name"] for e in entities_in(LEXICON, text, limit, literal, reach)] == one_by_one(text, limit, literal, reach)


@settings(max_examples=300, deadline=None)
@given(PIECES, PIECES, st.booleans())
def test_topics(title, body, for_query):
    scores = []
    for topic in LEXICON.topics[:2]:
        terms = topic.terms + (topic.query_synonyms if for_query else ())
        counts = [min(4, body.lower().count(t)) for t in terms]
        scores.append((topic.id, 3 * sum(t in title.lower() for t in terms) + sum(1 + math.log2(c) for c in counts if c)))
    top = max(s for _, s in scores)
    floor = max(1, 0.2 * top) if for_query else max(2.5, 0.4 * top)
    assert classify(LEXICON, title, body, 5, for_query) == [i for i, s in sorted(scores, key=lambda x: -x[1]) if s and s >= floor]


def test_sizes_and_copies():
    assert entities_in(Lexicon(), "any") == [] and classify(Lexicon(), "any", "any") == [] and entities_in(LEXICON, "") == []
    copy = pickle.loads(pickle.dumps(Lexicon(LEXICON.topics, LEXICON.entities)))
    assert entities_in(copy, "RAG time") == entities_in(LEXICON, "RAG time")
    late = "x " * 10_000 + "GPU"
    assert not entities_in(LEXICON, late) and entities_in(LEXICON, late, reach=None)


def test_time_is_flat():
    text = " ".join(f"word{i * 7919 % 10_000}x" for i in range(5_000))
    took = []
    for size in (100, 5_000):
        lexicon = Lexicon(entities=tuple(Entity(f"term{i}", "t") for i in range(size)))
        entities_in(lexicon, "warm")
        began = time.perf_counter()
        for _ in range(5):
            entities_in(lexicon, text, reach=None)
        took.append(time.perf_counter() - began)
    assert took[1] < 4 * took[0] + 0.05
