"""The divergence audit against plain integer arithmetic."""

import random
import re
from collections import Counter, defaultdict

from inkfield.llm import source_divergence as sd
from tests.llm.helpers import ODD, UPPER, passage


def brute(rows, least=3, top=200):
    """rows of (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(UPPER)) for t, _, _ in rows]
    held, count, whole, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for (_, lang, source), own in zip(rows, terms):
        groups[lang].add(source)
        held[lang].update(set(own))
        count[lang, source].update(own)
        whole[lang].update(own)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, d in held[lang].items() if d >= least)
        sides = {s: count[lang, s] for s in sources} | {None: whole[lang]}
        p = {}
        for s, c in sides.items():
            n = sum(c[t] for t in kept)
            p[s] = [1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept]
        for s in sources:
            pairs = [(-sum((x - y) ** 2 // y for x, y in zip(p[s], p[o])), o) for o in sources if o != s]
            own = [(-((x - y) ** 2 // y), t) for t, x, y in zip(kept, p[s], p[None]) if count[lang, s][t] and x > y]
            for part, ranked in (("pair", sorted(pairs, key=lambda r: (r[0], r[1].encode()))), ("term", sorted(own, key=lambda r: (r[0], r[1].encode()))[:top])):
                out += [(lang, s, part, item, -v, i) for i, (v, item) in enumerate(ranked, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "text string, lang string, source string, n int, term string, value double")


def rows_of(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def drawn():
    draw = random.Random(1)
    vocabulary = [f"t{'abcdefghij'[i % 10] * (1 + i // 10)}" for i in range(300)] + ["Ünïx", "éé", "日本", "ZZ"]
    rows = [(" ".join(draw.choice(vocabulary[: draw.choice((20, 304))]) + draw.choice(["", ",", "1", "\x00"]) for _ in range(draw.randint(0, 80))), draw.choice(["en", "fr"]), draw.choice(["a", "b", "c", "é", "\U0001F600", "�"])) for _ in range(150)]
    return rows + [(t, None, None) for _, t in ODD] + [("only here", "xx", "s"), ("", "xx", "t"), (None, "yy", "u"), ("rare rare rare", "en", "new")]


def test_against_plain_arithmetic(spark, monkeypatch):
    monkeypatch.setattr(sd, "CELLS", 7)  # many slices of a language
    rows = drawn()
    assert rows_of(sd.audit(frame(spark, rows))) == brute(rows)


def test_ties_reach_past_the_last_rank(spark):
    """Hundreds of terms of one value: only the first in UTF-8 order get a rank."""
    ties = [f"{'abcdefghij'[i // 100]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i % 10]}" for i in range(500)]
    rows = [(" ".join(ties), "en", "a")] * 3 + [("common " * 50 + " ".join(passage(1, 20)), "en", "b")] * 3 + [("aaa " * 5, "en", "a")]
    got = rows_of(sd.audit(frame(spark, rows)))
    assert got == brute(rows) and sum(r[2] == "term" and r[1] == "a" for r in got) == 200


def test_empty_and_without_terms(spark):
    assert sd.audit(frame(spark, [])).count() == 0
    rows = [(None, "en", "a"), ("", "en", "b"), ("12 !", "en", None)]
    assert rows_of(sd.audit(frame(spark, rows))) == brute(rows) and len(brute(rows)) == 6


def test_counts_leave_in_parts(monkeypatch, spark):
    monkeypatch.setattr(sd, "HELD", 5)
    rows = drawn()
    assert rows_of(sd.audit(frame(spark, rows).repartition(3))) == brute(rows)


def test_very_long_text(spark):
    long = " ".join(passage(3, 200)) * 8000  # 11 MB
    rows = [(long, "en", "a"), ("wa wb", "en", "b"), ("wa", "en", "b"), ("wa", "en", None)]
    assert rows_of(sd.audit(frame(spark, rows), least_docs=1)) == brute(rows, least=1)


def test_big_counts_are_exact(spark):
    df = spark.createDataFrame([(9_000_000_000_000, 12_345_678_901_234, 987_654_321)], "c long, n long, v long")
    assert df.select(sd.probability("c", "n", "v").alias("p")).first().p == 1 + 10**9 * 9_000_000_000_001 // (12_345_678_901_234 + 987_654_321)
