"""The filter audit against a row-by-row run of every order."""

import re
from itertools import permutations

from inkfield.llm import filter_audit as fa
from tests.llm.helpers import ODD, passage


def fails(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        x for x, bad in (
            ("A", len(w) < 200), ("B", 100 * len(set(w)) < 50 * len(w)),
            ("C", 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text)), ("D", bool(re.search("[#$%&*|]", text))),
        ) if bad
    }


def brute(rows, good, toxic):
    """rows of (doc_id, text, lang); each order is applied to each row in turn."""
    out = {}
    own = [
        (i, lang or "", fails(t) | ({"E"} if i is not None and any(j is not None and j < i and (s or "") == (t or "") for j, s, _ in rows) else set()))
        for i, t, lang in rows
    ]
    for part in {p for _, p, _ in own}:
        docs = [(i, f) for i, p, f in own if p == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = docs
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                removed_by[x] += len(gone)
                failing = [d for d in docs if x in d[1]]
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(failing) - len(gone), sum(d[1] == {x} for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed_by[order[step - 1]])
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", 2, True) for r in rows], "doc_id long, text string, lang string, n int, hash string, fails int, good boolean")


def test_against_every_order(spark):
    long = " ".join(passage(5, 250))
    rows = [(i, t, "en" if (i or 0) % 2 else None) for i, t in ODD]
    rows += [(50 + i, long, "fr") for i in range(40)] + [(100, long.upper(), "fr"), (101, long + " #", "fr"), (102, "A B " * 150, "x"), (103, long, "x"), (49, long + " *", "fr")]
    rows += [(200, "twice", "en"), (200, "twice", "en"), (201, "twice", ""), (None, "twice", "en")]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(1, 110)] + [(7, None, None), (None, 1, 1), (8, 1, 0)]
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    got = fa.audit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = brute(rows, good, toxic)
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got} == want
    assert len(got) == len(want)


def test_empty(spark):
    assert fa.audit(frame(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    alone = fa.audit(frame(spark, [(1, None, None)]), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(alone) == 600 and {r.part for r in alone} == {""} and {r.shapley for r in alone if r.filter_order[r.step - 1] == "A"} == {120}


def test_long_texts_are_measured_in_slices():
    text = "\n".join(" ".join(passage(i, 4000)) for i in range(60)) * 8  # 15 MB
    assert len(text) > 10 << 20
    assert b"".join(fa.slices(text.encode())) == text.encode() and len(list(fa.slices(text.encode()))) > 5
    assert fa.failures(text) == 2 and fa.failures("x" * (5 << 20)) == 1 and fa.failures("é " * (1 << 20) + "É|") == 10
    assert list(fa.slices(b"aa bb", 1)) == [b"aa", b" bb"]


def test_equal_hashes_are_not_enough(spark):
    """Different texts under one hash are no copies of each other."""
    from inkfield.llm.common import Bench

    own = spark.createDataFrame([(1, "p", "a", 7), (2, "p", "b", 7), (3, "p", "a", 7), (4, "p", "c", 8)], "doc_id long, part string, text string, hash long")
    got = fa.copies(own, own.withColumn("fails", own.hash), Bench(spark, "t"))
    assert [r.doc_id for r in got.collect()] == [3]
