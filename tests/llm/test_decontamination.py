"""Decontamination against a search of every window in every document."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from inkfield.llm import decontamination as dc
from tests.llm.helpers import ODD, UPPER, documents, passage


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(10, len(w))
        for p in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[p : p + k]), set()).add("" if item is None else str(item))
    out = []
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for p in range(len(w) - k + 1):
                if tuple(w[p : p + k]) in windows:
                    hit |= set(range(p, p + k))
                    found |= windows[tuple(w[p : p + k])]
        ids = ",".join(sorted(found))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit), sorted(found)))
    return sorted(out, key=repr)


def run(spark, rows, items):
    bench = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id string, text string, row int, hash string")
    got = dc.decontaminate(documents(spark, rows), bench)
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated, list(r.item_ids)) for r in got.collect()), key=repr)


def test_small_alphabet(spark):
    """Few different words: repeated grams, ties, runs that touch and overlap, items of every length."""
    draw = random.Random(3)
    rows = [(i, " ".join(draw.choice("abC") for _ in range(draw.randint(0, 60)))) for i in range(60)]
    items = [(str(i), " ".join(draw.choice("abc") for _ in range(draw.randint(5, 25)))) for i in range(40)]
    want = brute(rows, items)
    assert run(spark, rows, items) == want and 5 < sum(r[5] for r in want)


def test_planted_and_odd_rows(spark):
    a, b = passage(1, 30), passage(2, 60)
    items = [("q1", " ".join(a)), ("q1", " ".join(b[:12])), (None, " ".join(a[5:16])), ("s", "Two words"), ("s6", "six words make one gram here"), ("none", "... ---"), ("null", None), ("copy", " ".join(a)), ("one", "zebra")]
    pad = passage(9, 40)
    rows = [*ODD, (50, "--".join(pad + a + pad)), (51, " ".join(pad + a[10:20] + pad)), (52, " ".join(pad + a[10:19] + ["x"] + a[20:29])), (53, "TWO, WORDS! two words"), (54, "Zebra"), (54, "zebra zebra"), (55, "six words make one gram here"), (56, " ".join(a[:9])), (57, " ".join(b)), (58, "é" + " ".join(a[:10]))]
    rows += [(100 + i, " ".join(pad[: i % 30] + a)) for i in range(200)]
    assert run(spark, rows, items) == brute(rows, items)
    assert run(spark, rows, []) == brute(rows, []) and run(spark, [], items) == []


def test_every_shared_span_shares_a_fingerprint():
    rng = np.random.default_rng(0)
    for _ in range(50):
        shared = rng.integers(0, 4, 10)
        sides = [np.concatenate([rng.integers(0, 4, rng.integers(0, 30)), shared, rng.integers(0, 4, rng.integers(0, 30))]) for _ in range(2)]
        chosen = []
        for side in sides:
            at, text, hashes = dc.Runs(pa.array([" ".join(map(str, side))])).starting(dc.GRAM)
            taken = dc.winnowed(hashes, text, dc.SPAN - dc.GRAM + 1)
            window = dc.SPAN - dc.GRAM + 1
            for p in range(len(hashes) - window + 1):
                least = max(i for i in range(p, p + window) if hashes[i] == hashes[p : p + window].min())
                assert taken[least]
            chosen.append(set(hashes[taken].tolist()))
        assert chosen[0] & chosen[1]


@pytest.mark.parametrize("size", [40, 300, 1 << 20])
def test_long_texts_in_pieces(spark, monkeypatch, size):
    monkeypatch.setattr(dc, "PIECE", size)
    a = passage(4, 25)
    text = " ".join(passage(7, 300) + a + passage(8, 300) + ["y" * 500] + a[3:14] + passage(6, 9))
    batch = pa.RecordBatch.from_pydict({"row": [0], "doc_id": [1], "text": [text]})
    item = pa.RecordBatch.from_pydict({"row": [0], "doc_id": [0], "text": [" ".join(a)]})
    made = next(dc.prints([item], 10, 6, [])).to_pylist()
    hashes = np.array([r["hash"] for r in made if r["hash"] is not None], np.int64).view(np.uint64)
    table = np.zeros(1024, np.uint64)
    for h in hashes.tolist():
        table[(h & 65535) >> 6] |= np.uint64(1 << (h & 63))
    rows = next(dc.prints([batch], 10, 6, [], type("B", (), {"value": table}))).to_pylist()
    assert rows[0]["n_words"] == len(words(text))
    places = {p for r in rows[1:] if r["hash"] in {h["hash"] for h in made} for p in r["at"]}
    assert places and all(300 <= p < 325 or 626 <= p < 637 for p in places)
    for r in rows[1:]:
        for p in r["at"]:
            assert words(text)[p : p + 6] == r["gram"] and words(text)[p - len(r["before"]) : p] == r["before"][::-1]


def test_twenty_megabytes(spark):
    a = passage(4, 25)
    text = " ".join(f"k{i}" for i in range(2_500_000)) + " " + " ".join(a)
    got = run(spark, [(1, text)], [("q", " ".join(a))])
    assert got[0][1:4] == (2_500_025, 25, 1)
