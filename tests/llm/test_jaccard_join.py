"""The join against all pairs, on groups that leaders alone would not join."""

from itertools import combinations

import pytest

from inkfield.llm import jaccard_join
from tests.llm.helpers import ODD, documents, passage, words


def brute(rows, size, percent):
    sets = {}
    for n, (i, t) in enumerate(rows):
        w = words(t)
        grams = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        sets[n] = (i if i is not None else -(2**63), grams)
    up = {n: n for n in sets}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in combinations(sets, 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            up[root(a)] = root(b)
    least = {}
    for n in sets:
        least[root(n)] = min(least.get(root(n), 2**63), sets[n][0])
    none = lambda i: None if i == -(2**63) else i
    return sorted(((none(sets[n][0]), len(sets[n][1]), none(least[root(n)])) for n in sets), key=repr)


def changed(base, *places):
    out = list(base)
    for p in places:
        out[p] = f"x{p}"
    return " ".join(out)


def chains():
    """Each text differs from the next by one word, so the ends are linked only through what lies between."""
    rows, base = [], passage(5, 120)
    for n in range(25):
        rows.append((n, changed(base, *range(0, 4 * n, 4))))
    rows += [(100 + n, " ".join(passage(9, 60)[: 40 + n])) for n in range(20)]
    rows += [(200 + n, " ".join(passage(n, 80) + passage(77, 40))) for n in range(12)]
    return rows + [(300, " ".join(passage(3, 200))), (301, " ".join(passage(3, 200))), (302, " ".join(passage(3, 201)))]


@pytest.mark.parametrize("rows", [ODD, chains()])
@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_components(spark, rows, size, percent):
    got = jaccard_join.components(documents(spark, rows), size=size, percent=percent)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr) == brute(rows, size, percent)


def test_one_of_each_component_stays(spark):
    rows = chains()
    docs = documents(spark, rows)
    left = jaccard_join.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted({c for _, _, c in brute(rows, 5, 80)})


def test_empty(spark):
    assert jaccard_join.components(documents(spark, [])).count() == 0 and jaccard_join.keep_one(documents(spark, [])).count() == 0
