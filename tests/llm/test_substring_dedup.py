"""Chaining and the passages it finds, on planted ones."""

import random

import numpy as np

from inkfield.llm import substring_dedup as sd
from tests.llm.helpers import ODD, documents, passage, words


def test_chain_is_the_best_one():
    """Against all ascending sequences of a few matches."""
    rng = np.random.default_rng(2)
    for _ in range(40):
        x, y = rng.integers(0, 40, 7), rng.integers(0, 40, 7)
        order = np.lexsort((y, x))
        x, y = x[order], y[order]

        def worth(path):
            total = sd.K
            for a, b in zip(path, path[1:]):
                dx, dy = x[b] - x[a], y[b] - y[a]
                if dx <= 0 or dy <= 0:
                    return -1
                total += sd.K - sd.GAP_COST * (dx + dy)
            return total

        best = max(worth([i for i in range(7) if m >> i & 1]) for m in range(1, 128))
        found = [sd.K] + [worth_of(c, sd) for c in sd.chains(x, y)]
        assert abs(max(found) - best) < 1e-9


def test_chain_beside_a_stray_match():
    """The best earlier match is out of reach, a worse one within it: the same chain as a plain quadratic search finds, over wide coordinates."""
    rng = np.random.default_rng(9)
    for trial in range(300):
        n = int(rng.integers(5, 60))
        x, y = np.sort(rng.choice(500, n, replace=False)), rng.integers(0, 500, n)
        if trial % 2:  # steady stretches with strays between them
            y = np.where(rng.random(n) < 0.8, x + 7, y)
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        score = [float(sd.K)] * n
        for j in range(n):
            for i in range(j):
                dx, dy = x[j] - x[i], y[j] - y[i]
                if 0 < dx <= sd.MAX_GAP and 0 < dy <= sd.MAX_GAP:
                    score[j] = max(score[j], score[i] + sd.K - sd.GAP_COST * (dx + dy))
        found = [float(sd.K)] + [worth_of(c, sd) for c in sd.chains(x, y)]
        assert abs(max(found) - max(score)) < 1e-9


def test_passage_beyond_a_phrase_that_stands_earlier(spark):
    """150 copied words, 8 others, 70 copied ones with a word put in; a phrase of theirs stands before the passage in the owner too."""
    rows, want = [], {}
    for n in range(4):
        one, two = passage(600 + n, 150), passage(610 + n, 70)
        rows.append((2 * n, " ".join(two[20:32] + passage(620 + n, 9) + one + passage(630 + n, 8) + two + passage(640 + n, 20))))
        rows.append((2 * n + 1, " ".join(passage(650 + n, 30) + one + passage(660 + n, 8) + two[:26] + ["other"] + two[26:] + passage(670 + n, 30))))
        want[2 * n + 1] = 30 + 150 + 8 + 71
    got = {}
    for r in sd.passages(documents(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.begin_word, r.end_word))
    assert {k: max(e for _, e in v) for k, v in got.items()} == want and all(min(b for b, _ in v) == 30 for v in got.values())


def test_passage_counts_step_by_step():
    """Against a walk from match to match, each gap aligned on its own."""
    rng = np.random.default_rng(6)
    for _ in range(200):
        a = rng.integers(0, 9, 400).astype(np.uint64)
        xs, ys, x, b = [], [], 20, list(a[:20])
        for _ in range(15):
            xs.append(x), ys.append(len(b))
            gap = int(rng.integers(0, 9))
            b += list(a[x : x + sd.K])
            between = [w if rng.random() < 0.7 else 77 for w in a[x + sd.K : x + sd.K + gap]]
            b += between + [88] * int(rng.choice([0, 0, 0, 2]))
            x += sd.K + gap
        b = np.array(b + [99] * 20, np.uint64)
        want = sd.K
        for x0, y0, x1, y1 in zip(xs, ys, xs[1:], ys[1:]):
            want += sd.edits(a[x0 + sd.K : x1], b[y0 + sd.K : y1]) + sd.K
        *_, same = sd.passage(a, b, xs, ys)
        edges = sd.extend(a[: xs[0]][::-1], b[: ys[0]][::-1])[1] + sd.extend(a[xs[-1] + sd.K :], b[ys[-1] + sd.K :])[1]
        assert same - edges == want


def worth_of(chain, sd):
    total = sd.K
    for (x0, y0), (x1, y1) in zip(chain.tolist(), chain[1:].tolist()):
        assert x1 > x0 and y1 > y0
        total += sd.K - sd.GAP_COST * (x1 - x0 + y1 - y0)
    return total


def test_fenwick_prefix_maxima():
    rng = np.random.default_rng(0)
    tree, values = sd.Fenwick(50), [float("-inf")] * 50
    for n in range(300):
        place, score = int(rng.integers(50)), float(rng.random())
        tree.put(place, score, n)
        values[place] = max(values[place], score)
        to = int(rng.integers(1, 51))
        assert tree.best(to)[0] == max(values[:to])


def planted():
    shared, fuzzy = passage(900, 70), passage(901, 90)
    worn = [w if k % 13 else w + "q" for k, w in enumerate(fuzzy)]
    rows = [(n, " ".join(passage(n, 100 + n) + (shared if n % 2 else []) + passage(50 + n, 80))) for n in range(12)]
    rows.append((40, " ".join(passage(360, 100) + fuzzy + passage(361, 100))))
    rows.append((41, " ".join(passage(362, 20) + worn[:45] + ["extra", "words"] + worn[45:] + passage(363, 9))))
    rows.append((42, " ".join(passage(364, 90) + passage(900, 70)[:30] + passage(365, 90))))  # too short a repeat
    rows += [(43, rows[0][1]), (44, rows[0][1].upper())]
    return rows


def test_planted_passages(spark):
    rows = planted()
    got = sd.passages(documents(spark, rows)).collect()
    by = {r.doc_id: r for r in got}
    assert set(by) == {3, 5, 7, 9, 11, 41, 43, 44} and len(got) == len(by)
    for n in (3, 5, 7, 9, 11):
        assert by[n].keep_id == 1 and (by[n].begin_word, by[n].end_word) == (100 + n, 170 + n) and by[n].n_same == 70
        text = rows[n][1].encode()
        assert text[by[n].begin_byte : by[n].end_byte].decode().split() == passage(900, 70)
    assert by[41].keep_id == 40 and abs(by[41].begin_word - 20) <= 3 and abs(by[41].end_word - 112) <= 3
    assert by[43].keep_id == by[44].keep_id == 0 and by[44].end_word == len(words(rows[0][1]))


def test_removal(spark):
    rows = planted()
    docs = documents(spark, rows).withColumn("n_chars", __import__("pyspark").sql.functions.length("text"))
    left = sd.remove_repeats(docs)
    assert left.columns == docs.columns
    texts = {r.doc_id: r.text for r in left.collect()}
    assert all(r.n_chars == len(r.text) for r in left.collect()) and len(texts) == len(rows)
    for n, text in rows:
        if n in (3, 5, 7, 9, 11):
            assert texts[n].split() == passage(n, 100 + n) + passage(50 + n, 80)
        elif n in (43, 44):
            assert not texts[n].split()
        elif n != 41:
            assert texts[n] == text


def test_odd_rows(spark):
    docs = documents(spark, ODD + [(None, " ".join(passage(1, 3000))), (7, " ".join(passage(2, 60)))])
    got = sd.passages(docs).collect()
    assert [(r.doc_id, r.keep_id, r.begin_word, r.end_word) for r in got] == [(7, None, 0, 3000)]
    left = sd.remove_repeats(docs)
    assert left.columns == docs.columns and left.count() == len(ODD) + 2
    assert sd.passages(documents(spark, [])).count() == 0 and sd.remove_repeats(documents(spark, [])).count() == 0


def test_parts_are_the_longest_stretches():
    """Against all stretches of a few equal words."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        i, j = np.cumsum(rng.integers(1, 3, 40)), np.cumsum(rng.integers(1, 3, 40))
        good = [
            (e - s, s, e) for s in range(40) for e in range(s, 40)
            if min(i[e] - i[s], j[e] - j[s]) + 1 >= 12 and e - s + 1 >= 0.8 * (max(i[e] - i[s], j[e] - j[s]) + 1) - 1e-9
        ]
        got = sd.parts(i, j, 12, 0.8)
        assert bool(got) == bool(good) and all((e - s, s, e) in good for s, e in got)
        assert not got or max(e - s for s, e in got) == max(good)[0]
        assert all(any(s <= y and x <= e for s, e in got) for _, x, y in good)


def test_chain_is_cut_where_it_fails(spark):
    """An insertion of 20 to 45 words in a copy, and a stray phrase beside an exact passage."""
    rows, want = [], {}
    for n, gap in enumerate((26, 33, 40, 44)):
        shared = passage(700 + n, 100)
        rows.append((2 * n, " ".join(passage(720 + n, 30) + shared + passage(730 + n, 30))))
        rows.append((2 * n + 1, " ".join(passage(740 + n, 20) + shared[:50] + passage(750 + n, gap) + shared[50:] + passage(760 + n, 20))))
        want[2 * n + 1] = [(20, 70), (70 + gap, 120 + gap)]
    for n, gap in enumerate((20, 30, 40)):
        shared, phrase = passage(800 + n, 50), passage(810 + n, 17)
        rows.append((50 + 2 * n, " ".join(phrase + passage(820 + n, gap) + shared + passage(830 + n, 30))))
        rows.append((51 + 2 * n, " ".join(phrase[:9] + passage(840 + n, 8) + passage(850 + n, gap) + shared + passage(860 + n, 30))))
        want[51 + 2 * n] = [(17 + gap, 67 + gap)]
    got: dict[int, list] = {}
    for r in sd.passages(documents(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.begin_word, r.end_word))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_owners_of_parts(spark):
    """Passages whose seeds belong to several earlier documents, none of which holds enough of them."""
    one, lines = passage(900, 80), [passage(910 + n, 11) for n in range(9)]
    rows = [(1, " ".join(one[:45] + passage(930, 20))), (2, " ".join(passage(931, 20) + one[35:]))]
    rows += [(10 + n, " ".join(passage(940 + n, 30) + line)) for n, line in enumerate(lines)]
    rows += [(30, " ".join(passage(950, 30) + one + sum(lines, []))), (31, " ".join(passage(951, 10) + one + passage(952, 70) + sum(lines, [])))]
    got = sd.passages(documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.keep_id, r.begin_word, r.end_word, r.n_same) for r in got) == [(31, 30, 10, 90, 80), (31, 30, 160, 259, 99)]


def test_worn_passages(spark):
    """Words replaced at random and evenly: every copy of identity 0.8 or more between equal first and last words is found."""
    rng = np.random.default_rng(5)
    rows, want = [], set()
    for n in range(120):
        size, share = (50, 60, 90)[n % 3], (0.0, 0.1, 0.15, 0.2)[n // 3 % 4]
        whole = passage(2000 + n, size)
        worn = list(whole)
        inner = range(4, size - 1, 5) if n >= 108 else rng.choice(np.arange(1, size - 1), int(share * size), replace=False)
        for k in inner:
            worn[k] += "q"
        rows.append((2 * n, " ".join(passage(3000 + n, 25) + whole + passage(4000 + n, 25))))
        rows.append((2 * n + 1, " ".join(passage(5000 + n, 40) + worn + passage(6000 + n, 40))))
        want.add((2 * n + 1, 2 * n))
    assert {(r.doc_id, r.keep_id) for r in sd.passages(documents(spark, rows)).collect()} == want


def test_stretches_hold_no_stretch_inside_another():
    rng = random.Random(8)
    for _ in range(300):
        given = [(lo := rng.randrange(30), lo + rng.randrange(1, 20)) for _ in range(rng.randrange(12))]
        kept = sd.Stretches()
        for low, high in given:
            kept.put(low, high, (low, high))
        outer = {s for s in given if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in given)}
        assert kept.rows == sorted(outer)
        assert all(kept.hold(lo, hi) == any(o[0] <= lo and hi <= o[1] for o in outer) for lo in range(30) for hi in (lo + 1, lo + 9))


def test_words_of_a_short_period_give_one_passage(spark):
    """Two words over and over match at every period: few passages, none inside another, that hold nine tenths of the copied words or more."""
    rows = [(1, "x y " * 150), (2, "new " + "x y " * 120 + "end"), (3, "x y " * 400)]
    found = sd.passages(spark.createDataFrame(rows, "doc_id LONG, text STRING")).collect()
    assert {(r.doc_id, r.keep_id) for r in found} == {(2, 1), (3, 1)}
    nested = [(p, q) for p in found for q in found if p is not q and p.doc_id == q.doc_id and p.begin_word <= q.begin_word and q.end_word <= p.end_word]
    assert not nested
    assert len(found) <= 6
    for doc, copied in ((2, 240), (3, 800)):
        assert len({w for r in found if r.doc_id == doc for w in range(r.begin_word, r.end_word)}) >= 0.9 * copied


def test_one_row_for_the_chains_of_two_documents():
    """A line that one document repeats makes a chain at each place, but no row for each."""
    import pyarrow as pa

    places = np.concatenate([np.arange(9) + 100 * n for n in range(40)]).astype(np.int32)
    numbers = [np.full(len(places), 1, np.int64), np.zeros(len(places), np.int32), places, np.tile(np.arange(9, dtype=np.int32), 40)]
    packed = {k: [sd.planes(v)] for k, v in zip(("owners", "owner_ths", "pos", "owner_pos"), numbers)}
    none = {"owner_id": pa.nulls(1, pa.int64()), **{k: pa.nulls(1, pa.int32()) for k in ("owner_th", "at", "owner_at", "n")}}
    row = pa.RecordBatch.from_pydict({"doc_id": pa.array([2]), "th": pa.array([0], pa.int32()), **packed, **none})
    rows = [r for b in sd.chain_matches(iter([row]), 50, 0.8) for r in b.to_pylist()]
    assert len(rows) == 1 and (rows[0]["doc_id"], rows[0]["owner_id"], rows[0]["second"]) == (2, 1, False)
    assert rows[0]["xs"] == [list(range(100 * n, 100 * n + 9)) for n in range(40)] and rows[0]["ys"] == [list(range(9))] * 40


def test_only_chains_without_hope_are_left_out():
    """What is not aligned would have given no passage and no part of one."""
    rng, left_out = np.random.default_rng(3), 0
    for trial in range(400):
        a = rng.integers(0, 40, 160).astype(np.uint64)
        b = np.where(rng.random(160) < rng.choice([0.1, 0.25, 0.4, 0.6, 0.8]), a, 99).astype(np.uint64)
        x = int(rng.integers(40, 110))
        b[x : x + 9] = a[x : x + 9]
        xs = list(range(x, x + 6))
        if not sd.hopeless(a, b, xs, xs, 50, 0.8):
            continue
        left_out += 1
        x0, x1, y0, y1, same = sd.passage(a, b, xs, xs)
        assert min(x1 - x0, y1 - y0) < 50 or same < 0.8 * max(x1 - x0, y1 - y0)
        bounds = max(x - 50, 0), min(x + 5 + 54, 160)
        i, j = sd.equal_words(a, b, np.array(xs), np.array(xs), (*bounds, *bounds))
        assert not sd.parts(i, j, 50, 0.8)
    assert left_out > 50


def test_windows_are_matched_as_packed_numbers():
    """Later texts' windows go to the first text that holds them, in one row for each part of the documents however many hold one."""
    rng = np.random.default_rng(12)
    ids, pos = np.repeat(np.arange(300), 4), np.tile(np.arange(0, 8, 2, dtype=np.int32), 300)
    window = rng.choice(np.array([5, 6, 7, 8, 2**63 + 1], np.uint64), len(ids), p=[0.7, 0.2, 0.05, 0.04, 0.01])
    row = sd.pack(np.zeros(len(ids), np.int32), np.arange(300), np.zeros(300, np.int32), ids, [(pos, None), (window, None)])
    given = sd.packed(row, "part int, ids binary, ths binary, held binary, pos binary, windows binary")
    out = list(sd.first_holders(iter([given]), 3))
    assert sum(b.num_rows for b in out) == 3
    got = set()
    for batch in out:
        batch = batch.append_column("n", __import__("pyarrow").array([0] * batch.num_rows, "int32"))
        for texts in sd.texts_of_parts(iter([batch])):
            got |= set(zip(*(v.tolist() for v in sd.matches_of(__import__("pyarrow").Table.from_batches([texts])))))
    first = {}
    for i, p, w in zip(ids.tolist(), pos.tolist(), window.tolist()):
        first.setdefault(w, (i, p))
    want = {(i, 0, first[w][0], 0, p, first[w][1]) for i, p, w in zip(ids.tolist(), pos.tolist(), window.tolist()) if i != first[w][0]}
    assert got == want
