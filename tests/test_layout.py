"""Text layout against plain loops over words, and that no step folds a text word by word."""

import random

from pyspark.sql import functions as F

from inkfield.operators import layout as lo


def width(text):
    return sum(next((m for glyphs, m in lo.GLYPH_WIDTHS.items() if c in glyphs), lo.DEFAULT_WIDTH) for c in text)


def greedy(words, room, size):
    lines = []
    for word in words:
        if lines and width(f"{lines[-1]} {word}") * size / 1000 <= room:
            lines[-1] += f" {word}"
        else:
            lines.append(word)
    return lines


def halves(words, weights):
    ends, at = [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    if len(words) < 2:
        return [" ".join(words)] if words else []

    def rank(i):
        off = abs(ends[i] - weights[0] / sum(weights) * ends[-1])
        kind = 0 if words[i][-1] in ".!?" and off <= 0.15 * ends[-1] else 1 if words[i][-1] in ",;" and off <= 0.25 * ends[-1] else 2
        return kind, off, i

    cut = min(range(len(words) - 1), key=rank) + 1
    return [" ".join(words[:cut]), " ".join(words[cut:])]


def test_lines_sizes_and_cuts(spark):
    rng = random.Random(12)
    made = lambda n: " ".join("".join(rng.choice("aeilmwW.,;é") for _ in range(rng.randrange(1, 12))) for _ in range(n))
    texts = [None, "", " \n ", "one", made(9000)] + [made(rng.randrange(1, 90)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING").withColumn("room", F.lit(60.0) + F.col("i") * 7)
    words = lo.words_of(F.col("t"))
    box = [F.lit(5.0), F.lit(6.0), F.col("room"), F.lit(50.5)]
    got = df.select(
        "*", lo.wrap(words, F.col("room"), F.lit(12.0)).alias("lines"), lo.split_by_weight(words, F.array(F.lit(3.0), F.lit(2.0))).alias("parts"),
        lo.fit_label(words, *box, F.lit(400.0), F.lit(500.0)).alias("note"), lo.fit_text(words, *box).alias("fit"))
    assert "aggregate(" not in got._jdf.queryExecution().executedPlan().toString()
    for r in got.collect():
        if r.t is None:
            assert r.lines is None and r.parts is None
            continue
        cut = r.t.split()
        assert [(x.text, x.m) for x in r.lines] == [(x, width(x)) for x in greedy(cut, r.room, 12.0)]
        assert r.parts == halves(cut, (3.0, 2.0))
        room = min(260.0, max(80.0, r.room * 1.2))
        tried = {s: greedy(cut, room, float(s)) for s in range(16, 9, -1)}
        fits = [s for s, lines in tried.items() if len(lines) <= 3 and max(map(width, lines), default=0) * s / 1000 <= room]
        assert r.note.size == (fits or [10])[0] and r.note.lines == tried[(fits or [10])[0]]
        assert r.fit.lines == greedy(cut, r.fit.w, r.fit.size)


def test_balloon_parts_are_fitted_to_their_lobes(spark):
    """The parts of a text in two lobes are those of the split, each laid out as it would be alone."""
    text = "all of these words, some more of them; and an end. then others follow here"
    df = spark.createDataFrame([(text,)], "t STRING").withColumn("lobes", F.expr(
        "array(struct(0D AS x, 0D AS y, 60D AS w, 90D AS h), struct(0D AS x, 90D AS y, 60D AS w, 90D AS h))"))
    laid = lo.lay_in_balloon(df, "t", "lobes")
    assert "aggregate(" not in laid._jdf.queryExecution().executedPlan().toString()
    blocks = laid.first().blocks
    parts = halves(text.split(), (1.0, 1.0))
    assert len(blocks) in (1, 2) and " ".join(w for b in blocks for w in b.lines) == text
    if len(blocks) == 2:
        assert [" ".join(b.lines) for b in blocks] == parts


def test_widths_by_bytes_are_those_of_characters(spark):
    import pyarrow as pa

    texts = ["", "wide mW", "é", "日本l", "'|", "😀 .", "plain"]
    assert lo.widths(pa.array(["cut off", *texts])[1:]).tolist() == [width(t) for t in texts] and lo.widths(pa.array([], pa.string())).tolist() == []
    got = spark.createDataFrame([(t,) for t in texts], "t STRING").select(lo.measure(F.col("t"))).collect()
    assert [r[0] for r in got] == [width(t) for t in texts]
