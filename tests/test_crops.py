"""Crops and their label targets against plain loops over cells."""

import math

from pyspark.sql import functions as F

from inkfield.operators import labels as lb, raster as rs

RECORDS = [("odd", 253, 320, False), ("bare", 200, 320, True), ("none", 320, 111, False), ("wide", 320, 200, True)]
BOXES = [
    ("odd", "text", 10.0, 20.0, 60.0, 40.0), ("odd", "text", 50.0, 40.0, 90.0, 30.0), ("odd", "ignore", 30.0, 10.0, 80.0, 90.0),
    ("odd", "text", 200.0, 300.0, 9.0, 7.0), ("bare", "background", 20.0, 20.0, 70.0, 200.0), ("bare", "ignore", 25.0, 30.0, 20.0, 20.0),
    ("bare", "text", 60.0, 150.0, 70.0, 50.0), ("wide", "background", 0.0, 0.0, 320.0, 40.0), ("wide", "text", 5.0, 5.0, 3.0, 3.0),
]


def tables(spark):
    records = spark.createDataFrame(RECORDS, "page_id STRING, width INT, height INT, ignore_all BOOLEAN")
    boxes = spark.createDataFrame(BOXES, "page_id STRING, role STRING, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE")
    return records, boxes


def test_validation_crop_rounds_down_on_both_sides(spark):
    """A page that leaves an odd number of columns begins at the floor of the negative half."""
    records, boxes = tables(spark)
    plan = lb.crop_plan(records, boxes, 1, 2, train=False, input_size=320)
    got = {r.page_id: (r.x0, r.y0, r.vx0, r.vy0, r.vx1, r.vy1) for r in plan.collect()}
    assert got == {
        "odd": (-34, 0, 34, 0, 287, 320), "bare": (-60, 0, 60, 0, 260, 320),
        "none": (0, -105, 0, 105, 320, 216), "wide": (0, -60, 0, 60, 320, 260),
    }


def test_training_crops_repeat_and_stay_near(spark):
    records, boxes = tables(spark)
    first, again, later = (
        {r.page_id: tuple(r) for r in lb.crop_plan(records, boxes, epoch, 5, crop=128, input_size=320).collect()} for epoch in (1, 1, 2))
    assert first == again and first != later and set(first) == {r[0] for r in RECORDS}
    sizes = {name: (w, h) for name, w, h, _ in RECORDS}
    for row in lb.crop_plan(records, boxes, 1, 5, crop=128, input_size=320).where("NOT on_text").collect():
        for start, size in ((row.x0, round(sizes[row.page_id][0] * row.sx)), (row.y0, round(sizes[row.page_id][1] * row.sy))):
            assert min(0, size - 128) <= start <= max(0, size - 128)


def reach(x, y, w, h, inset, side):
    edges = [(x + inset) / 4, (y + inset) / 4, (x + w - inset) / 4, (y + h - inset) / 4]
    if edges[2] - edges[0] < 1e-3 or edges[3] - edges[1] < 1e-3:
        return set()
    columns = range(max(0, math.floor(edges[0])), min(side, math.ceil(edges[2])))
    rows = range(max(0, math.floor(edges[1])), min(side, math.ceil(edges[3])))
    return {(r, c) for r in rows for c in columns}


def test_targets_of_crops_equal_painting_cell_by_cell(spark):
    records, boxes = tables(spark)
    for train in (False, True):
        plan = lb.crop_plan(records, boxes, 4, 9, crop=128, train=train, input_size=320)
        layers = lb.crop_layers(records, boxes, plan, F.col("y").cast("long"))
        got = {(r.page_id, r.row, r.col): (r.target, r["mask"]) for r in rs.rasterise(layers, ["page_id"], "ord").collect()}
        want = {}
        whole = {name: ignored for name, _, _, ignored in RECORDS}
        for p in plan.collect():
            side, painted = p.crop // 4, {}
            mine = [(role, x * p.sx - p.x0, y * p.sy - p.y0, w * p.sx, h * p.sy, y) for name, role, x, y, w, h in BOXES if name == p.page_id]
            if whole[p.page_id]:
                painted |= dict.fromkeys(reach(p.vx0, p.vy0, p.vx1 - p.vx0, p.vy1 - p.vy0, 0, side), (0, 0))
            for wanted, value in (("background", (0, 1)), ("ignore", (0, 0))):
                for role, x, y, w, h, _ in mine:
                    if role == wanted:
                        painted |= dict.fromkeys(reach(x, y, w, h, 0, side), value)
            cores = []
            for role, x, y, w, h, _ in sorted((b for b in mine if b[0] == "text"), key=lambda b: int(b[5])):
                outer = reach(x, y, w, h, 0, side)
                core = reach(x, y, w, h, w * h * (1 - 0.4**2) / max(1e-6, 2 * (w + h)), side) if outer else set()
                large = len({r for r, _ in core}) >= 2 and len({c for _, c in core}) >= 2
                painted |= dict.fromkeys(outer, (0, int(large and not whole[p.page_id])))
                if large:
                    cores.append(core)
            for core in cores:
                painted |= dict.fromkeys(core, (1, 1))
            want |= {(p.page_id, *cell): value for cell, value in painted.items()}
        assert got == want


def test_no_records_give_no_crops(spark):
    records, boxes = tables(spark)
    plan = lb.crop_plan(records.limit(0), boxes, 1, 1, crop=128, input_size=320)
    assert rs.rasterise(lb.crop_layers(records, boxes, plan, F.lit(0).cast("long")), ["page_id"], "ord").count() == 0


def test_digests_equal_their_cells(spark):
    """Rasters that go on over several batches, rows and columns past one word or band, and layers dealt after a union of joins."""
    keys = ["page_id"]
    n = 3000
    rows = spark.range(n).selectExpr(
        "id % 7 AS page_id", "element_at(array('text', 'ignore', 'background', 'text', 'page'), CAST(id % 5 AS INT) + 1) AS role", "CAST(id * 37 % 500 - 20 AS DOUBLE) AS x",
        "CAST(id * 53 % 470 - 15 AS DOUBLE) / 2 AS y", "CAST(id * 11 % 90 AS DOUBLE) AS w", "CAST(id * 29 % 130 AS DOUBLE) AS h", "id % 7 = 3 AS ignore_all", "id * 101 % 997 AS ord",
        "120 AS columns", "70 AS rows")
    small = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        page = rows.select("page_id").distinct()
        joined = rows.where("ord % 2 = 0").join(page, "page_id").unionByName(rows.where("ord % 2 = 1").join(page, "page_id"))
        cells = {(r.page_id, r.row, r.col): (r.target, r["mask"]) for r in rs.rasterise(rows, keys, "ord").collect()}
        got = {r.page_id: tuple(r)[1:] for r in rs.raster_digest(joined, keys, "ord", 77).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", small)
    want = {}
    for (page_id, row, col), (target, mask) in cells.items():
        old, at = want.get(page_id, (0,) * 5), row * 77 + col
        want[page_id] = tuple(a + b for a, b in zip(old, (1, target, 1 - mask, at * target, at * (1 - mask))))
    assert got == want and len(got) == 7
    masks = {}
    for r in rs.box_mask(rows, keys).collect():
        old = masks.get(r.page_id, (0, 0))
        masks[r.page_id] = old[0] + 1, old[1] + r.row * 901 + r.col
    assert {r.page_id: tuple(r)[1:] for r in rs.box_mask_digest(rows, keys, 901).collect()} == masks


def test_box_masks_make_no_row_a_cell(spark):
    """Two boxes of nine million cells each, on one page."""
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 3000.0, 3000.0), (1, 1000.0, 0.0, 3000.0, 3000.0)], "p int, x double, y double, w double, h double")
    plan = rs.box_mask_digest(boxes, ["p"], 4000)
    assert [tuple(r) for r in plan.collect()] == [(1, 12_000_000, 12_000_000 * 11_999_999 // 2)]
