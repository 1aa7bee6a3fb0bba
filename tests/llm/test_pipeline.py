"""The pipeline on planted documents, stage by stage."""

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from tests.llm.helpers import passage, words


def plant():
    clean = [(i, " ".join(passage(i, 90)) + ".") for i in range(60)]
    junk = [(100 + i, "### ".join(passage(100 + i, 90)) + "###") for i in range(30)]
    copies = [(200, clean[0][1]), (201, clean[0][1].upper()), (202, clean[1][1])]
    near = [(210, clean[2][1].replace(passage(2, 90)[40], "changed"))]
    shared = passage(999, 60)
    repeats = [(220 + i, " ".join(passage(300 + i, 80) + shared + passage(400 + i, 70))) for i in range(4)]
    return clean + junk + copies + near + repeats, shared


def test_stages(spark, tmp_path):
    rows, shared = plant()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int("###" not in t), 0) for i, t in rows if i < 200]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept, texts = docs, []
    for name, stage in corpus_pipeline.STAGES:
        kept.write.parquet(f"{tmp_path}/before-{name}")
        kept = stage(spark, spark.read.parquet(f"{tmp_path}/before-{name}"), str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept.columns == docs.columns
            texts.append({r.doc_id: r.text for r in kept.collect()})
    given = dict(rows)
    assert set(texts[0]) == {i for i, t in rows if "###" not in t}
    assert set(texts[0]) - set(texts[1]) == {0, 1, 200} and set(texts[1]) - set(texts[2]) == {210}
    assert all(texts[2][i] == given[i] for i in texts[2])
    assert set(texts[3]) == set(texts[2])
    for i, t in texts[3].items():
        assert words(t) == ([w for w in words(given[i]) if w not in shared] if i in (221, 222, 223) else words(given[i]))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts[3].items()}
    got = {}
    for r in kept.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_run_gives_the_last_stage(spark):
    out = contract.queries()["pipeline"](spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
