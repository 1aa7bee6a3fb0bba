"""Operators against small sequential models, on random and hand-made cases."""

import base64
import decimal
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W, functions as F

from inkfield.functions import text as tx
from inkfield.operators import balloon as bl, labels as lb, layout as lo, raster as rs, sequences as sq, spatial as sp, stages, textjobs as tj
from inkfield.operators.ordered import ordered_scan
from inkfield.sources import readers

BOX = "page_id LONG, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE"


def brute_coverage(region, found):
    x, y, w, h = region
    if w <= 0 or h <= 0:
        return 0.0
    nc, nr = (max(1, min(round(v), 512)) for v in (w, h))
    hit = 0
    for i in range(nc):
        cx = x + (i + 0.5) * w / nc
        for j in range(nr):
            cy = y + (j + 0.5) * h / nr
            hit += any(bx <= cx <= bx + bw and by <= cy <= by + bh for bx, by, bw, bh in found)
    return hit / (nc * nr)


def test_coverage_on_random_boxes(spark):
    rng = random.Random(3)

    def boxes(n):
        return [tuple(float(rng.choice((rng.uniform(0, 60), rng.randrange(60)))) for _ in range(4)) for _ in range(n)]

    pages = {p: (boxes(4), boxes(5)) for p in range(12)}
    pages[12] = ([(0.0, 0.0, 0.0, 5.0), (5.0, 5.0, 600.5, 700.25)], [(6.0, 6.0, 300.0, 650.0), (200.0, 0.0, 500.0, 400.0)])
    pages[13] = ([(0.0, 0.0, 10.0, 10.0)], [(0.0, 0.0, 6.0, 10.0), (4.0, 0.0, 6.0, 10.0), (4.0, 0.0, 6.0, 10.0)])
    regions = spark.createDataFrame([(p, *b) for p, (r, _) in pages.items() for b in r], BOX)
    found = spark.createDataFrame([(p, *b) for p, (_, d) in pages.items() for b in d], BOX).toDF("page_id", "dx", "dy", "dw", "dh")
    rows = sp.with_measures(regions, found).collect()
    for row in rows:
        want = brute_coverage((row.x, row.y, row.w, row.h), pages[row.page_id][1])
        assert row.coverage == pytest.approx(want, abs=1e-12), row
    assert [r.pieces for r in rows if r.page_id == 13] == [3]


def test_pages_without_labels_are_spurious(spark):
    regions = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0)], BOX)
    found = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (2, 0.0, 0.0, 5.0, 5.0)], BOX).toDF("page_id", "dx", "dy", "dw", "dh")
    assert [r.page_id for r in sp.spurious(found, regions).collect()] == [2]


def test_ordered_scan_equals_a_plain_window(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(3), i, rng.choice([None, rng.randrange(9)])) for i in range(400)]
    df = spark.createDataFrame(rows, "k INT, i INT, v INT")
    ours = ordered_scan(df, ["k"], ["i"], F.floor(F.col("i") / 7), lag={"before": "v"}, total={"sum": "i"}, last_known={"known": "v"}, rank="r")
    w = W.partitionBy("k").orderBy("i")
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    want = df.select(
        "k", "i", "v", F.lag("v").over(w).alias("before"), F.sum("i").over(so_far).alias("sum"),
        F.last("v", True).over(so_far).alias("known"), F.row_number().over(w).alias("r"))
    assert sorted(map(tuple, ours.select(want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def flood(on):
    h, w = on.shape
    label = -np.ones((h, w), int)
    for start in range(h * w):
        if on.flat[start] and label.flat[start] < 0:
            stack = [start]
            label.flat[start] = start
            while stack:
                r, c = divmod(stack.pop(), w)
                for a, b in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                    if 0 <= a < h and 0 <= b < w and on[a, b] and label[a, b] < 0:
                        label[a, b] = start
                        stack.append(a * w + b)
    return label


def test_components_three_ways(spark):
    rng = np.random.default_rng(2)
    grids = [(rng.random((13, 17)) < p).astype(int) for p in (0.3, 0.5, 0.6, 0.7, 0.9)]
    snake = np.zeros((13, 17), int)
    for r in range(0, 13, 2):
        snake[r] = 1
        if r + 1 < 13:
            snake[r + 1, -1 if r % 4 == 0 else 0] = 1
    grids.append(snake)
    dense = spark.createDataFrame([(i, g.ravel().tolist(), 17) for i, g in enumerate(grids)], "m INT, cells ARRAY<INT>, width INT")
    labels = {r.m: r.l for r in dense.select("m", rs.label_dense("cells", "width").alias("l")).collect()}
    sparse = rs.explode_map(dense, ["m"], "cells", F.col("width"), "on").where("on = 1")
    joined = {(r.m, r.row, r.col): r.label_row * 17 + r.label_col for r in rs.connected_components(sparse, ["m"], block=5).collect()}
    for i, grid in enumerate(grids):
        want = flood(grid)
        assert list(labels[i]) == want.ravel().tolist()
        for r, c in zip(*np.nonzero(grid)):
            assert joined[(i, r, c)] == want[r, c]


BOXES = "g INT, k STRING, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE"


def in_order(spark, groups):
    df = spark.createDataFrame([(g, *b) for g, bs in groups.items() for b in bs], BOXES)
    got = {}
    for r in sq.reading_order(df, "g", "k", extent=64.0).collect():
        got.setdefault(r.g, {})[r.position] = r.k
    return {g: [found[i] for i in range(len(groups[g]))] for g, found in got.items()}


def test_reading_order_by_hand(spark):
    two_rows = [("a", 90.0, 11.0, 30.0, 10.0), ("b", 10.0, 9.0, 30.0, 10.0), ("c", 50.0, 10.0, 30.0, 10.0), ("d", 10.0, 40.0, 30.0, 10.0), ("e", 60.0, 41.0, 30.0, 10.0)]
    two_columns = [("a", 10.0, 50.0, 10.0, 30.0), ("b", 11.0, 5.0, 10.0, 30.0), ("c", 60.0, 5.0, 10.0, 30.0), ("d", 59.0, 60.0, 10.0, 30.0)]
    stairs = [(str(n), 40.0 * n, 12.0 * n, 30.0, 10.0) for n in range(5)]  # each apart from the next by more than half a line
    got = in_order(spark, {1: two_rows, 2: two_columns, 3: stairs, 4: [("only", 1.0, 2.0, 3.0, 4.0)]})
    assert got == {1: ["b", "c", "a", "d", "e"], 2: ["c", "d", "b", "a"], 3: list("01234"), 4: ["only"]}


def test_reading_order_properties(spark):
    """Every line once; and where lines are far enough apart to be rows, rows follow and each runs on."""
    rng = random.Random(8)
    groups, grid = {}, {}
    for g in range(30):
        down = g % 2 == 1
        cells = {(r, c): (f"{r:02d}{c:02d}", rng.uniform(-2, 2), rng.uniform(-2, 2)) for r in range(rng.randrange(1, 6)) for c in range(rng.randrange(1, 6))}
        thin, long = 12.0, 40.0
        boxes = [
            (k, 100 - 20 * r + dx, 50 * c + dy, thin, long) if down else (k, 50 * c + dx, 20 * r + dy, long, thin)
            for (r, c), (k, dx, dy) in cells.items()
        ]
        rng.shuffle(boxes)
        groups[g], grid[g] = boxes, sorted(k for k, _, _ in cells.values())
    groups[99] = [(f"{i:02d}", *(rng.uniform(0, 300) for _ in range(2)), *(rng.uniform(8, 60) for _ in range(2))) for i in range(40)]
    got = in_order(spark, groups)
    assert sorted(got.pop(99)) == [b[0] for b in groups[99]]
    assert got == grid


def test_rasterise(spark):
    """Each cell on its own: the highest layer of any box that holds it decides."""
    rng = random.Random(4)
    columns, rows = 28, 24

    def boxes(n):
        return [(rng.uniform(-10, 110), rng.uniform(-10, 90), rng.uniform(0, 60), rng.uniform(0, 50)) for _ in range(n)]

    def held(box, inset=0.0):
        """Cells that share area with a box, in quarter pixels."""
        x0, x1 = (box[0] + inset) / 4, (box[0] + box[2] - inset) / 4
        y0, y1 = (box[1] + inset) / 4, (box[1] + box[3] - inset) / 4
        if min(x1 - x0, y1 - y0) < 1e-3:
            return set()
        return {(r, c) for r in range(rows) for c in range(columns) if c + 1 > x0 and c < x1 and r + 1 > y0 and r < y1}

    records = {p: (boxes(6), boxes(2), boxes(2), p % 3 == 0) for p in range(9)}
    given = []
    for p, (text, ignore, background, all_) in records.items():
        for role, part in (("text", text), ("ignore", ignore), ("background", background), ("page", [(0.0, 0.0, 112.0, 96.0)])):
            given += [(p, role, i, *map(float, b), all_, columns, rows) for i, b in enumerate(part)]
    df = spark.createDataFrame(given, "p INT, role STRING, ord INT, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, ignore_all BOOLEAN, columns INT, rows INT")
    got = {(r.p, r.row, r.col): (r.target, r.mask) for r in rs.rasterise(df, ["p"], "ord").collect()}
    for p, (text, ignore, background, all_) in records.items():
        layers = [((0, 0), {(r, c) for r in range(rows) for c in range(columns)}, (0, int(not all_)))]
        layers += [((1, 0), held(b), (0, 1)) for b in background] + [((2, 0), held(b), (0, 0)) for b in ignore]
        for n, b in enumerate(text):
            core = held(b, 0.42 * b[2] * b[3] / max(b[2] + b[3], 5e-7))
            sides = [len({cell[k] for cell in core}) for k in (0, 1)]
            wide = min(sides) >= 2
            layers.append(((3, n), held(b), (0, int(wide and not all_))))
            if wide and held(b):
                layers.append(((4, 0), core, (1, 1)))
        for r in range(rows):
            for c in range(columns):
                want = max((layer, value) for layer, cells, value in layers if (r, c) in cells)[1]
                assert got.get((p, r, c), (0, 1)) == want, (p, r, c)


def width_of(text):
    return sum(280 if c in "iljI.,;:!'| " else 830 if c in "mwMW" else 550 for c in text)


def fewest_lines(words, limit, size):
    """By dynamic programming over where the last line begins; None when a word is too wide."""
    best = [0]
    for end in range(1, len(words) + 1):
        ways = [best[begin] + 1 for begin in range(end) if best[begin] is not None and width_of(" ".join(words[begin:end])) * size / 1000 <= limit]
        best.append(min(ways, default=None))
    return best[-1]


def fits(words, w, h, size):
    lines = fewest_lines(words, w, size)
    return lines is not None and lines * size * 1.15 <= h


def test_fit_text(spark):
    """What a fit promises: all words, full lines, the largest size that fits, and when none does, room around the same centre."""
    rng = random.Random(6)
    texts = ["", "   ", "one", "incomprehensibilities"] + [
        " ".join("".join(rng.choice("aeilmnrstw.") for _ in range(rng.randrange(1, 11))) for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    rows = [(i, t, 5.0, 6.0, rng.uniform(20, 160), rng.uniform(8, 120)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i INT, t STRING, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE")
    fit = lo.fit_text(lo.words_of(F.col("t")), *(F.col(c) for c in "xywh"))
    for r in df.select("*", fit.alias("f")).collect():
        words, f = r.t.split(), r.f
        assert " ".join(f.lines).split() == words
        if not words:
            assert (f.size, f.overflowed, f.x, f.y, f.w, f.h) == (10.0, False, r.x, r.y, r.w, r.h)
            continue
        firsts = [line.split()[0] for line in f.lines[1:]]
        assert all(width_of(f"{line} {word}") * f.size / 1000 > f.w for line, word in zip(f.lines, firsts))  # full lines
        sizes = [min(28.0, max(10.0, r.h)) - k for k in range(19)]
        able = [s for s in sizes if s >= 10 and fits(words, r.w, r.h, s)]
        assert f.overflowed == (not able) and f.size == max(able, default=10.0)
        if able:
            assert (f.x, f.y, f.w, f.h) == (r.x, r.y, r.w, r.h) and max(map(width_of, f.lines)) * f.size / 1000 <= r.w
        else:
            assert (f.x + f.w / 2, f.y + f.h / 2) == pytest.approx((r.x + r.w / 2, r.y + r.h / 2)) and f.h == pytest.approx(len(f.lines) * 11.5)
            needed = max(map(width_of, words)) / 100
            assert r.w <= f.w <= 2.5 * r.w + 1e-9 and f.w == pytest.approx(sorted((r.w, needed, 2.5 * r.w))[1])


def test_balloon_is_filled_and_given_a_lobe(spark):
    grid = np.full((40, 40), 20)
    grid[8:32, 6:34] = 240          # a pale balloon in a dark page
    grid[18:21, 14:26] = 20         # its text
    base, seed = np.zeros((40, 40), int), np.zeros((40, 40), int)
    base[10:30, 8:32] = 1
    seed[16:23, 12:28] = 1
    noise = np.random.default_rng(1).integers(0, 255, (40, 40))
    rows = [(i, 40, *(g.ravel().tolist() for _ in range(3)), base.ravel().tolist(), seed.ravel().tolist()) for i, g in ((1, grid), (2, noise))]
    ints = "ARRAY<INT>"
    windows = spark.createDataFrame(rows, f"id INT, width INT, r {ints}, g {ints}, b {ints}, base {ints}, seed {ints}")
    fills, lobes, painted = bl.clip_to_balloon(windows, "id")
    filled = fills.collect()
    assert [(r.id, r.red, r.pixels) for r in filled] == [(1, 240, 24 * 28)]
    assert painted.count() == 24 * 28
    assert [(r.x, r.y, r.w, r.h) for r in lobes.collect()] == [(8.0, 10.0, 24.0, 20.0)]


def test_post_process_and_loose(spark):
    df = spark.createDataFrame([("ａ・・b… ・.x!",)], "t STRING")
    row = df.select(tx.post_process(F.col("t")).alias("p"), tx.loose(F.col("t")).alias("l")).first()
    assert row.p == "ａ．．ｂ．．．．．ｘ！"
    assert row.l == "abx!"


def test_blanks_of_any_script(spark):
    df = spark.createDataFrame([("\u3000あ\u00a0\u3000い ",), ("\u3000",), ("",)], "source STRING")
    rows = df.select(tx.post_process(F.col("source")).alias("p"), tx.trimmed(F.col("source")).alias("t")).collect()
    assert [(r.p, r.t) for r in rows] == [("あい", "あ\u00a0\u3000い"), ("", ""), ("", "")]
    assert tj.translatable(df).count() == 1
    replies = spark.createDataFrame([(1, 3, "1.\u3000b\n\u3000\n c\n3：\u3000「d」\n3) e\nmore")], "r LONG, count INT, reply STRING")
    assert sorted((r.number, r.text) for r in tj.parse_replies(replies, "r").collect() if r.text) == [(1, "b c"), (3, "e more")]
    assert tj.parse_replies(replies, "r").where("text IS NULL").first().number == 2


def test_error_rate_of_nothing_wanted(spark):
    rows = spark.createDataFrame([("a", "…", ""), ("b", "x", "y")], "slice STRING, want STRING, got STRING")
    assert {r.slice: r.error_rate for r in tj.loose_character_error(rows, ["slice"]).collect()} == {"a": None, "b": 1.0}


def test_region_text_keeps_every_character(spark):
    regions = spark.createDataFrame([(1, "ja"), (2, "ko")], "r LONG, language STRING")
    lines = spark.createDataFrame([(r, p, t) for r in (1, 2) for p, t in ((0, "a\u0001"), (1, ""), (2, "b"))], "r LONG, position INT, text STRING")
    whole = spark.createDataFrame([], "r LONG, text STRING")
    assert {r.r: r.text for r in tj.region_text(regions, lines, whole, "r").collect()} == {1: "a\u0001b", 2: "a\u0001 b"}


def test_stage_schema_and_languages(spark):
    def factory():
        return lambda batch: pd.DataFrame({"i": batch["i"], "price": [decimal.Decimal("1.50")] * len(batch), "pair": [{"a": 1, "b": "x"}] * len(batch)})

    schema = "i LONG, price DECIMAL(5,2), pair STRUCT<a: INT, b: STRING>"
    rows = spark.createDataFrame([(1, "ja"), (2, "xx"), (3, None)], "i LONG, language STRING")
    got = {r.i: (r.status, r.error) for r in stages.apply_by_language(rows, {"ja": factory}, schema, slices=2).collect()}
    assert got == {1: ("ok", None), 2: ("error", "no model for xx"), 3: ("error", "no model for null")}


def test_leak_guard_names_the_ids(spark):
    train = spark.createDataFrame([(1,), (2,), (3,)], "page_id LONG")
    held = spark.createDataFrame([(3,), (9,)], "page_id LONG")
    with pytest.raises(lb.LeakError, match="3"):
        lb.assert_no_leak(train, held)
    lb.assert_no_leak(lb.drop_leaked(train, held), held)


def test_stage_keeps_rows_of_a_failing_batch(spark):
    def factory():
        def model(batch):
            if (batch["i"] == 3).any():
                raise ValueError("three")
            return pd.DataFrame({"i": batch["i"], "double": batch["i"] * 2})
        return model

    rows = stages.apply_stage(spark.range(8).toDF("i").coalesce(1), factory, "i LONG, double LONG", 4).collect()
    assert {r.i: r.double for r in rows if r.status == "ok"} == {i: 2 * i for i in range(8) if i != 3}
    assert [(r.i, r.error) for r in rows if r.status == "error"] == [(3, "three")]


def test_sources(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return str(tmp_path / name)

    cases = put("cases.json", json.dumps([{"post": 1, "box": [10, 20, 40, 60], "text": "a"}], indent=1))
    assert [tuple(r) for r in readers.read_cases(spark, cases, corners=True).select("x", "y", "w", "h").collect()] == [(10, 20, 30, 40)]
    pages = put("pages.json", json.dumps([{"post": 7, "language": "ko", "regions": [{"box": [1, 2, 3, 4], "kind": "sfx"}]}, {"post": 8, "regions": []}]))
    assert [(r.page_id, r.kind, r.h) for r in readers.page_regions(readers.read_pages(spark, pages)).collect()] == [(7, "sfx", 4.0)]
    assert [r[0] for r in readers.read_id_list(spark, put("ids.json", "[5, 6]")).collect()] == [5, 6]
    assert [tuple(r) for r in readers.read_box_map(spark, put("map.json", '{"3": [[1, 2, 3, 4]], "4": []}')).collect()] == [(3, 0, 1, 2, 3, 4)]
    vocab = readers.read_vocab(spark, put("vocab.txt", "a\nb\n"), ctc=True).collect()
    assert [tuple(r) for r in vocab] == [(0, ""), (1, "a"), (2, "b"), (3, " ")]
    log = put("log.txt", "slice   found recall\nsfx     3/4    0.750    0.5    0.25     1\n\n10 detections, 2 spurious (0.200)\n")
    slices, totals = readers.read_score_log(spark, log)
    assert [(r.slice, r.found, r.total, r.frag) for r in slices.collect()] == [("sfx", 3, 4, 1)]
    assert tuple(totals.first()) == (10, 2, 0.2)
    values = np.array([0.1, -2.5, 0.0, 1e-3, 123456.7], "<f4")
    packed = spark.createDataFrame([(base64.b64encode(values.tobytes()).decode(),)], "prob STRING")
    assert readers.unpack_raster(packed).first().prob == values.tolist()
