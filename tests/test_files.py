"""The parser of printed reports, payload files, and page records."""

from inkfield.plans.catalog import QUERIES
from inkfield.sources import readers, writers


def test_score_log_lines(spark, tmp_path):
    (tmp_path / "log.txt").write_text(
        "slice             found   recall  cov  iou  frag\n"
        "dark bg           3/4     0.750   0.5  0.25 1\n"
        "\tall  10/20 0.5 0.4 0.3 0  \n"
        "no numbers here at all now\n"
        "half 3/x 0.1 0.1 0.1 2\n"
        "\n10 detections, 2 spurious (0.200)\n10 detections, two spurious (0.2)\nsaid: 10 detections, 2 spurious (0.2)\n"
    )
    slices, totals = readers.read_score_log(spark, str(tmp_path / "log.txt"))
    assert sorted(tuple(r) for r in slices.collect()) == [("all", 10, 20, 0.5, 0.4, 0.3, 0), ("dark bg", 3, 4, 0.75, 0.5, 0.25, 1)]
    assert [tuple(r) for r in totals.where("spurious IS NOT NULL").collect()] == [(10, 2, 0.2)]


def test_payloads(spark, tmp_path):
    rows = [("a", b"\x00\xff" * 1000), ("b", b""), ("c", None), ("a", b"again")]
    index = writers.write_payloads(spark.createDataFrame(rows, "name string, content binary").repartition(3), str(tmp_path / "p"))
    got = readers.read_payloads(spark, index).collect()
    assert sorted((r.name, bytes(r.content), r.length) for r in got) == sorted((n, c or b"", len(c or b"")) for n, c in rows)


def test_page_records(spark):
    pages = spark.createDataFrame([(1, "page"), (2, "page")], "page_id long, kind string")
    boxes = spark.createDataFrame([(1, "text", 5.0, 9.0, 1.0, 1.0), (1, "text", 7.0, 2.0, 1.0, 1.0), (1, "ignore", 0.0, 0.0, 2.0, 2.0), (1, "text", 7.0, 2.0, 1.0, 1.0)],
                                  "page_id long, role string, x double, y double, w double, h double")
    got = {r.page_id: r for r in writers.page_records(pages, boxes).collect()}
    assert got[1].text == [[7, 2, 1, 1], [7, 2, 1, 1], [5, 9, 1, 1]] and got[1].ignore == [[0, 0, 2, 2]]
    assert got[1].background == got[2].text == []


def test_pages_of_one_address_are_audited_by_themselves(spark, tmp_path):
    url, m = "https://a/x", "https://m.a/x"
    rows = [(1, url, "a" * 2000), (2, url, "b" * 2000), (3, url, "c"), (4, m, "d" * 2000), (5, m, "e" * 2000), (6, m, "f"), (7, None, "g" * 2000), (8, m, None), (9, url, "a" * 2000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.status for r in QUERIES["manifest_audit"](spark, str(tmp_path)).collect()}
    assert got == {1: "cached", 2: "cached", 3: "missing", 4: "mismatch", 5: "mismatch", 6: "missing", 7: "cached", 8: "mismatch", 9: "cached"}
