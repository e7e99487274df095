"""The trie join gives what comparing every form with every word gives, however the tries are split."""

import random

import pytest

from factloom.llm.tries import Trie, trie_join

FOLD, PAIRS = {"a": "b", "c": "d"}, {"ab": "c", "dd": "a"}


def distance(f, w, fold, pairs):
    d = [[99] * (len(w) + 1) for _ in range(len(f) + 1)]
    d[0][0] = 0
    same = lambda x, y: x == y or y in fold.get(x, "")
    for i in range(len(f) + 1):
        for j in range(len(w) + 1):
            v = d[i][j]
            if i and j:
                v = min(v, d[i - 1][j - 1] + (not same(f[i - 1], w[j - 1])))
                if i > 1 and j > 1 and same(f[i - 1], w[j - 2]) and same(f[i - 2], w[j - 1]):
                    v = min(v, d[i - 2][j - 2] + 1)
                if i > 1 and w[j - 1] in pairs.get(f[i - 2 : i], ""):
                    v = min(v, d[i - 2][j - 1])
            v = min(v, d[i - 1][j] + 1 if i else 99, d[i][j - 1] + 1 if j else 99)
            d[i][j] = v
    return d[-1][-1]


def some(rng, n, most):
    return sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, most))) for _ in range(n)})


@pytest.mark.parametrize(("fold", "pairs"), [({}, {}), (FOLD, {}), (FOLD, PAIRS)])
@pytest.mark.parametrize("bound", [0, 1, 2])
def test_automata(fold, pairs, bound):
    rng = random.Random(bound)
    words = some(rng, 300, 7)
    trie = Trie(words, fold, pairs)
    for f in some(rng, 80, 8):
        want = {w for w in words if distance(f, w, fold, pairs) <= bound}
        assert {w for w, _ in trie.near(f, bound)} == want


@pytest.mark.parametrize(("words_per_trie", "asked_per_task"), [(10_000, 10_000), (20, 7), (1, 1000)])
def test_join(spark, words_per_trie, asked_per_task):
    rng = random.Random(7)
    words = [(k, w) for k in ("x", "y") for w in some(rng, 120 if k == "x" else 5, 6)]
    asked = [(k, f, b) for k in ("x", "y", "z") for b, f in enumerate(some(rng, 40, 7))]
    asked = [(k, f, i % 3) for i, (k, f, _) in enumerate(asked)]
    got = trie_join(spark.createDataFrame(words, "key string, word string"), spark.createDataFrame(asked, "key string, form string, bound int"), None, None, words_per_trie, asked_per_task).collect()
    want = {(k, f, w, distance(f, w, {}, {})) for k, f, b in asked for j, w in words if j == k and distance(f, w, {}, {}) <= b}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_join_of_empty_tables(spark):
    words, asked = spark.createDataFrame([], "key string, word string"), spark.createDataFrame([], "key string, form string, bound int")
    assert trie_join(words, asked).count() == 0
    assert trie_join(words, spark.createDataFrame([("a", "b", 2), ("a", "", 1)], "key string, form string, bound int")).count() == 0
