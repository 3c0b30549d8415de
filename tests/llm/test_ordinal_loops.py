"""The ordinal classifier against plain loops: features word by word, loss and its derivative document by document."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest


def slow_features(text):
    from docloom.llm._words import hashes
    from docloom.llm.ordinal_classifier import BINS

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out, last, again = set(), None, 0
    for word in words:
        raw = word.encode()
        if len(raw) > 1 and raw[-1:] in b".,;:?":
            raw = raw[:-1]
        raw = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
        h = int(hashes(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0])
        out.add(h % BINS)
        again += h == last
        last = h
    if words:
        raw = text.encode()
        shares = (again / len(words), min(1, 4 * sum(c in b"#*$%&|<>!" for c in raw) / len(raw)), sum(65 <= c <= 90 for c in raw) / len(raw))
        out |= {BINS + 11 * i + math.floor(10 * s) for i, s in enumerate(shares)}
    return out


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def chance(grade, total, theta):
    """P(this grade), from its thresholds above and below."""
    upper = 1.0 if grade == len(theta) else sigmoid(theta[grade] - total)
    lower = 0.0 if grade == 0 else sigmoid(theta[grade - 1] - total)
    return upper, lower


def slow_fit(rows, grades, epochs, rate, shrink, least_documents, least_score, batch, seed):
    n, top = len(rows), max(grades)
    whole_mean = sum(grades) / n
    deviation = math.sqrt(sum((g - whole_mean) ** 2 for g in grades) / n)
    weights = {}
    for feature in set().union(*rows):
        held = [g for r, g in zip(rows, grades, strict=True) if feature in r]
        if len(held) >= least_documents and abs(sum(held) / len(held) - whole_mean) * math.sqrt(len(held)) >= least_score * deviation:
            weights[feature] = 0.0
    seen = dict.fromkeys(weights, 1e-8)
    theta = []
    for k in range(1, top + 1):
        share = min(0.99, max(0.01, sum(g < k for g in grades) / n))
        theta.append(math.log(share / (1 - share)) + 0.01 * (k - 1))
        theta[-1] = max(theta)
    seen_theta, rng = [1e-8] * top, np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(n).tolist()
        for a in range(0, n, batch):
            some = order[a : a + batch]
            pulls, on_theta = dict.fromkeys((f for i in some for f in rows[i] if f in weights), 0.0), [0.0] * top
            for i in some:
                total = sum(weights[f] for f in rows[i] if f in weights)
                upper, lower = chance(grades[i], total, theta)
                for f in rows[i]:
                    if f in weights:
                        pulls[f] += (1 - upper - lower) / len(some)
                p = max(upper - lower, 1e-6)
                if grades[i] < top:
                    on_theta[grades[i]] -= upper * (1 - upper) / p / len(some)
                if grades[i] > 0:
                    on_theta[grades[i] - 1] += lower * (1 - lower) / p / len(some)
            for f, pull in pulls.items():
                g = pull + shrink * weights[f]
                seen[f] += g * g
                weights[f] -= rate * g / math.sqrt(seen[f])
            for k, g in enumerate(on_theta):
                seen_theta[k] += g * g
                theta[k] -= rate * g / math.sqrt(seen_theta[k])
            for k in range(1, top):
                theta[k] = max(theta[k], theta[k - 1])
    return weights, theta


def documents():
    rng = random.Random(4)
    words = {0: "junk%% spam!! buy, BUY buy", 1: "vile nasty awful talk", 2: "calm clear useful words."}
    shared = "the of and to in is it é日本".split()
    texts, grades = [], []
    for i in range(30):
        grade = i % 3
        texts.append(" ".join(rng.choice(words[grade].split() if rng.random() < 0.4 else shared) for _ in range(rng.randint(5, 40))))
        grades.append(grade)
    return texts, grades


def test_features_word_by_word():
    from docloom.llm.ordinal_classifier import features

    texts = documents()[0] + ["", " \n", "a", "A. a; a", ". .. a", "x" * 300 + ", " + "x" * 300]
    numbers, counts, _ = features(pa.array(texts))
    ends = np.cumsum(counts)
    assert [set(numbers[e - n : e].tolist()) for e, n in zip(ends, counts, strict=True)] == [slow_features(t) for t in texts]


@pytest.mark.parametrize("epochs", [1, 4])
def test_fit_and_scores_by_loops(spark, epochs):
    from docloom.llm.ordinal_classifier import features, fit, grade_documents

    texts, grades = documents()
    more = {"epochs": epochs, "rate": 0.2, "shrink": 2e-4, "least_documents": 3, "least_score": 1.0, "batch": 8, "seed": 11}
    numbers, counts, _ = features(pa.array(texts))
    model = fit(numbers, counts, np.array(grades), **more)
    rows = [slow_features(t) for t in texts]
    weights, theta = slow_fit(rows, grades, **more)
    assert model.thresholds == pytest.approx(theta, abs=1e-7)
    at = np.flatnonzero(model.weights)
    assert set(at.tolist()) == {f for f, w in weights.items() if w} and len(at) > 8
    assert [float(model.weights[i]) for i in at] == pytest.approx([weights[i] for i in at.tolist()], abs=1e-6)
    scored = {r["doc_id"]: r for r in grade_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, r in enumerate(rows):
        tails = [1 - sigmoid(t - sum(weights.get(f, 0.0) for f in r)) for t in theta]
        assert (scored[i]["expected_grade"], scored[i]["tail_probability"]) == (pytest.approx(sum(tails), abs=1e-5), pytest.approx(tails[-1], abs=1e-5))
        assert scored[i]["kept"] == (tails[-1] >= 0.6)


def test_the_pull_is_the_derivative_of_the_loss():
    theta, step = [-0.7, 0.4], 1e-6
    loss = lambda grade, total: -math.log(np.subtract(*chance(grade, total, theta)))
    for grade in (0, 1, 2):
        for total in (-2.0, 0.1, 1.3):
            upper, lower = chance(grade, total, theta)
            assert (loss(grade, total + step) - loss(grade, total - step)) / (2 * step) == pytest.approx(1 - upper - lower, abs=1e-6)
