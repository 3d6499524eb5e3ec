import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quarry.llm import lexical_search as ls

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, keep=20):
    terms = [(d, Counter(words(t)), len(words(t))) for d, t in docs]
    n_docs, total = sum(n > 0 for *_, n in terms), sum(n for *_, n in terms)
    df = Counter(t for _, c, _ in terms for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, n in terms:
            score = 0
            for t in words(text):
                if t in c:
                    m = 100 - 25 + 25 * n * n_docs // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:keep])]
    return sorted(out, key=repr)


def search(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, ls.ranked(d, i, **more).collect()), key=repr)


@pytest.mark.parametrize("block", [3, 17, ls.BLOCK_DOCS])
def test_equals_brute_force(spark, block):
    rng = random.Random(block)
    vocab = [f"w{i}" for i in range(60)] + ["École", "日本", "ÀB", "x9"]
    text = lambda n: " ".join(vocab[min(int(rng.expovariate(0.1)), 63)] for _ in range(n))
    docs = [(i, text(rng.choice([1, 5, 30, 200]))) for i in range(150)]
    docs += [(200 + i, "W1 same copy, W5-w7") for i in range(50)]                   # ties beyond the last rank
    docs += [(900, None), (901, ""), (902, "-- !"), (None, "w1 w2 w40"), (5, "w1 repeated id"), (5, "w1 repeated id")]
    items = [(i, text(12)) for i in range(12)] + [(50, None), (51, "?!"), (52, "unseen"), (None, "w1 w1 w50"), (53, "same copy w7")]
    assert search(spark, docs, items, block_docs=block) == brute(docs, items)


def test_repeated_items_and_few_documents(spark):
    docs, items = [(1, "a b"), (2, "a c"), (3, "d")], [(1, "b a"), (1, "b a"), (2, "d d")]
    assert search(spark, docs, items) == brute(docs, items)


def test_empty_tables_and_clashing_columns(spark):
    assert search(spark, [], [(1, "a")]) == [] and search(spark, [(1, "a")], []) == [] and search(spark, [(1, " ")], [(1, "a")]) == []
    d = spark.createDataFrame([(1, "a b", 3, "t"), (2, "b", 4, "t")], "doc_id long, text string, score int, terms string")
    i = spark.createDataFrame([(1, "a", 3)], "item_id long, text string, rank int")
    assert list(map(tuple, ls.ranked(d, i).collect())) == brute([(1, "a b"), (2, "b")], [(1, "a")])


def test_very_long_text_and_term(spark):
    docs = [(1, "z" * 200_000 + " k"), (2, "k " * 60_000), (3, "k j")]
    items = [(1, "k j " + "z" * 200_000)]
    assert search(spark, docs, items) == brute(docs, items)


def test_treap_finds_cells_and_prunes():
    rng = np.random.default_rng(4)
    rows, cols = np.unique(rng.integers(0, [300, 90], size=(2000, 2)), axis=0).T
    values = rng.integers(1, 1000, len(rows))
    grid = np.zeros((300, 90), np.int64)
    grid[rows, cols] = values
    treap = ls.Treap.unpacked(ls.Treap.packed(rows, cols, values, 9))
    for _ in range(20):
        paths, weights = rng.choice(300, 6, replace=False), rng.integers(1, 50, 6)
        total = weights @ grid[paths]
        got, scores = treap.search(paths, weights, 90, 5, 1)
        best = sorted(total[total > 0], reverse=True)[:5]
        assert sorted(scores, reverse=True)[:5] == best
        assert all(total[c] == s for c, s in zip(got, scores))
        floor = int(best[-1]) + 1 if best else 1
        assert all(s >= floor for s in treap.search(paths, weights, 90, 5, floor)[1])
