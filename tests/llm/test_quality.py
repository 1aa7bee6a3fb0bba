"""The quality network on held-out rows, and the rules' measures and bounds against plain counting."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from inkfield.llm import quality_cnn as cnn, quality_rules as qr
from tests.llm.helpers import ODD, documents, passage

SF = "/root/testdata/sf0.01"


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = cnn.Network()
    texts = pa.array(["".join(map(chr, rng.integers(97, 110, n))) for n in (3, 300, 90, 700)], pa.large_string())
    y = np.array([0, 1, 1, 0], np.float32)

    def loss():
        z = net.logits(texts).astype(np.float64)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    g = net.gradients(texts, y)
    for name, at in (("mean", 3), ("largest", 5), ("base", 0), ("bias", 2), ("filters", (7, 4)), ("vectors", (100, 2))):
        own, step = net.p[name][at], 2e-3
        net.p[name][at] = own + step
        up = loss()
        net.p[name][at] = own - step
        down = loss()
        net.p[name][at] = own
        assert abs((up - down) / (2 * step) - g[name][at]) < 2e-3 + 0.05 * abs(g[name][at]), name


def test_a_text_scores_the_same_in_any_company():
    net = cnn.Network()
    texts = ["", "short", "x" * 128, "y" * 5000 + "!!", "é" * 77]
    together = net.score(pa.array(texts, pa.large_string()))
    alone = [float(net.score(pa.array([t], pa.large_string()))[0]) for t in texts]
    assert np.allclose(together, alone, atol=1e-6)
    long = "a" * 20_000
    assert net.score(pa.array([long + "###"]))[0] != net.score(pa.array([long + "aaa"]))[0]  # the end counts


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    got = cnn.classify(docs, cnn.train(docs, labels)).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id] == got.held_out.tolist()
    assert ((got.score >= 0.7).astype(int) == got.predicted).all()
    test = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert (test.predicted == test.quality).mean() > 0.93 and (test[test.quality == 1].predicted == 1).mean() > 0.95


def test_odd_rows_and_labels(spark):
    docs = documents(spark, ODD)
    labels = spark.createDataFrame([(1, 1), (None, 0), (4, None), (4, 1)], "doc_id long, quality int")
    got = cnn.classify(docs, cnn.train(docs, labels)).collect()
    assert len(got) == len(ODD) and {r.score for r in got} == {1.0}
    none = cnn.train(docs, labels.where("false"))
    assert {r.score for r in cnn.classify(docs, none).collect()} == {0.5}
    assert cnn.classify(documents(spark, []), none).count() == 0
    assert cnn.keep_good(docs, none).count() == 0 and cnn.keep_good(docs, cnn.Constant(0.9)).columns == docs.columns
    both = spark.createDataFrame([(i, i % 2) for i in range(1, 14)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in cnn.classify(docs, cnn.train(docs, both)).collect())


def plain_forward(net, text):
    """The network byte by byte: each window, each half, each chunk on its own."""
    data = list(text.encode())
    n = max(1, -(-max(len(data), 1) // cnn.HALF))
    codes = data + [cnn.PAD] * (n * cnn.HALF - len(data))
    best = []
    for h in range(n):
        own = []
        for at in range(h * cnn.HALF, (h + 1) * cnn.HALF):
            if at + cnn.WIDTH <= len(codes):
                own.append(np.concatenate([net.p["vectors"][c] for c in codes[at : at + cnn.WIDTH]]) @ net.p["filters"])
        best.append(np.max(own, axis=0))
    chunks = [np.maximum(best[h], best[h + 1]) for h in range(n - 1)] or best
    chunks = [np.maximum(c + net.p["bias"], 0) for c in chunks]
    z = float(np.mean(chunks, axis=0) @ net.p["mean"] + np.max(chunks, axis=0) @ net.p["largest"] + net.p["base"][0])
    return 1 / (1 + math.exp(-z - net.prior))


def test_against_a_plain_forward_pass(monkeypatch):
    net = cnn.Network(3)
    net.p["bias"] += 0.1
    net.prior = 0.3
    texts = ["", "a", "x" * 127, "y" * 129, "Some words, é and 日本. " * 40, "".join(map(chr, np.random.default_rng(1).integers(32, 600, 900)))]
    for walk in (1, 3, 256):
        monkeypatch.setattr(cnn, "WALK", walk)
        got = net.score(pa.array(texts, pa.large_string()))
        assert np.allclose(got, [plain_forward(net, t) for t in texts], atol=1e-5)


def test_twenty_megabytes_in_little_memory():
    import resource

    net, text = cnn.Network(), pa.array(["".join(passage(5, 4000)) * 800], pa.large_string())
    assert len(text[0].as_py()) > 20 << 20
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert 0 <= net.score(text)[0] <= 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300 << 10  # KB


def test_labels_without_a_document(spark):
    """Both classes have labels, but none of a document that is there, or only of documents too long to learn from."""
    docs = documents(spark, ODD)
    elsewhere = spark.createDataFrame([(1000 + i, int(i % 4 > 0)) for i in range(40)], "doc_id long, quality int")
    known = [1000 + i for i in range(40) if zlib.crc32(str(1000 + i).encode()) % 4 != 2]
    share = sum((i - 1000) % 4 > 0 for i in known) / len(known)
    model = cnn.train(docs, elsewhere)
    got = [r.score for r in cnn.classify(docs, model).collect()]
    assert len(got) == len(ODD) and all(abs(s - share) < 1e-9 for s in got)
    both = spark.createDataFrame([(i, i % 2) for i in range(1, 14)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in cnn.classify(docs, cnn.train(docs, both, longest=-1)).collect())


def counts(text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if x]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_measures(spark):
    rows = [*ODD, (20, "a b c a b c a b"), (21, "x x x x x"), (22, "l1 a\nl1 a\n\n \nl1 a\n#|"), (23, " ".join(passage(4, 70) * 2 + ["€#"]))]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(23, 1), (None, 1), (7, None)], "doc_id long, quality int")
    got = qr.judge(docs, labels)
    want = [(i, *counts(t)) for i, t in rows]
    assert sorted(((r.doc_id, *(r[c] for c in qr.COUNTS)) for r in got.collect()), key=repr) == sorted(want, key=repr)
    for r in got.collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed)  # far too few labels for any cutoff
    assert qr.judge(documents(spark, []), labels).count() == 0


def test_tail_is_exact(spark):
    cases = [(k, n, 0.01) for n in (1, 5, 300, 5000) for k in (0, 1, 3, 40) if k <= n]
    got = spark.createDataFrame(cases, "k long, n long, p double").select("k", "n", qr.tail(F.col("k"), F.col("n"), 0.01).alias("t")).collect()
    for r in got:
        log = [math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.01) + (r.n - i) * math.log(0.99) for i in range(r.k + 1)]
        want = max(log) + math.log(sum(math.exp(x - max(log)) for x in log))
        assert abs(r.t - want) < 1e-8 * max(1, abs(want))


def test_a_cutoff_needs_proof_and_rejects(spark):
    good = [(i, " ".join(passage(i, 60)), "big") for i in range(1200)] + [(5000 + i, " ".join(passage(i, 60)), None) for i in range(50)]
    bad = [(9000 + i, "### ".join(passage(i, 60)), "big" if i % 2 else None) for i in range(20)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, *_ in good] + [(i, 0) for i, *_ in bad], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in qr.judge(docs, labels).collect()}
    assert all(kept[i] for i, *_ in good)
    assert all(kept[i] == (lang is None) for i, _, lang in bad)
