import math
import random
from collections import Counter

import numpy as np
import pytest

from tallyframe.llm import lexical_search
from tallyframe.llm.decontaminate import words_of
from tallyframe.llm.lexical_search import search


def brute(docs, items, k):
    bags = [(d, Counter(words_of((t or "").encode()))) for d, t in docs]
    bags = [(d, tf, sum(tf.values())) for d, tf in bags if tf]
    n, total = len(bags), sum(b[2] for b in bags)
    df = Counter(t for _, tf, _ in bags for t in tf)
    out = []
    for item, text in sorted(set(items), key=str):
        if item is None:
            continue
        scored = []
        for d, tf, length in bags:
            m = 50 + (50 * length * n) // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m))
                for t in set(words_of((text or "").encode())) if t in tf
            )
            if score > 0 and d is not None:
                scored.append((-score, d))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def found(spark, docs, items, k, **options):
    d = spark.createDataFrame([(a, b, "r", 1) for a, b in docs], "doc_id long, text string, rank string, score int").repartition(3)
    i = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, doc_id string")
    return sorted(map(tuple, search(d, i, k, **options).select("item_id", "rank", "doc_id", "score").collect()))


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: f"W{int(rng.paretovariate(0.6)) % 700}"
    docs = [(i, " ".join(word() for _ in range(int(rng.paretovariate(0.8)) % 900))) for i in range(n)]
    items = [(j, ", ".join(word() for _ in range(rng.randrange(1, 40)))) for j in range(12)]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = corpus(1, 400)
    docs += docs[:40]  # repeated rows tie
    for k in (1, 7, 50):
        assert found(spark, docs, items, k) == brute(docs, items, k)


def test_blocks_of_items_and_shuffled_joins(spark, monkeypatch):
    docs, items = corpus(2, 120)
    monkeypatch.setattr(lexical_search, "BROADCAST_IDS", 0)
    assert found(spark, docs, items, 5, max_terms=150) == brute(docs, items, 5)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "--- ..."), (4, "Alpha beta"), (4, "beta"), (5, "alpha alpha ß"), (None, "alpha beta beta"), (6, "ALPHA beta"), (7, "x " * 300_000 + "alpha")]
    items = [(1, "alpha BETA"), (1, "alpha BETA"), (2, None), (3, ""), (4, "nowhere"), (None, "alpha"), (5, "ß x")]
    assert found(spark, docs, items, 3) == brute(docs, items, 3)
    assert found(spark, [], items, 3) == [] and found(spark, docs, [], 3) == [] and found(spark, [(1, None)], items, 3) == []


def test_text_ids_raise(spark):
    with pytest.raises(ValueError, match="integer"):
        search(spark.createDataFrame([("a", "b")], "doc_id string, text string"), spark.createDataFrame([(1, "b")], "item_id long, text string"))


def test_bounds_never_fall_below_scores_and_exclude_most(spark):
    docs, items = corpus(5, 600)
    bags = [Counter(words_of(t.encode())) for _, t in docs]
    bags = [b for b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for b in bags)
    terms = sorted(set().union(*bags))
    plan = {"documents": n, "terms": total, "hashes": lexical_search._hashes(terms)}
    at = {t: i for i, t in enumerate(terms)}
    plan["items"] = [(np.array([at[t] for t in q], np.int64), np.arange(1, len(q) + 1)) for q in (sorted(set(words_of(x.encode())) & set(terms)) for _, x in items)]
    over = close = 0
    for size in (1 << 8, 1 << 14):
        block = lexical_search._Block(size)
        for i, b in enumerate(bags):
            keys = [(t, level) for t, tf in b.items() for level in range(tf.bit_length())]
            if len(keys) * 8 > size or block.add(i, sum(b.values()), np.unique(lexical_search._bits(lexical_search._hashes([k[0] for k in keys]), np.array([k[1] for k in keys]), size))):
                break
        own, bounds = lexical_search._bounds_of(block.packed(), plan)
        for row, (numbers, weights) in zip(bounds, plan["items"], strict=True):
            for d, bound in zip(own, row, strict=True):
                b = bags[d]
                m = 50 + (50 * sum(b.values()) * n) // total
                score = sum(int(w) * lexical_search.value(b[terms[t]], m) for t, w in zip(numbers, weights, strict=True) if terms[t] in b)
                assert bound >= score
                over += bound > 2 * score
                close += bound <= 2 * score
    assert close > 4 * over
