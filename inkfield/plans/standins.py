"""Stand-in tables: the annotation data model derived from the given tables.

Every table is a projection of a whole given table; nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkfield.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS page_id",
        "element_at(array('ja', 'zh', 'ko'), CAST(o_custkey % 3 AS INT) + 1) AS language",
        "400 AS width",
        "500 AS height",
        "o_orderstatus = 'F' AS reviewed",
        "CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'negative' ELSE 'page' END AS kind",
    )


def _all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS page_id",
        "l_linenumber AS line_no",
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT), "
        "CAST(round(l_extendedprice * 100) AS BIGINT), CAST(l_shipdate AS DATE)) AS box_id",
        "CAST((l_partkey % 40) * 8 AS DOUBLE) AS x",
        "CAST((l_suppkey % 50) * 8 AS DOUBLE) AS y",
        "16 + 2 * l_quantity AS w",
        "CAST(16 + 3 * (l_partkey % 30) AS DOUBLE) AS h",
        "CASE l_returnflag WHEN 'A' THEN 'bubble' WHEN 'N' THEN 'sfx' ELSE 'caption' END AS kind",
        "5 * l_tax AS dark_share",
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_lines(spark, sf_dir)


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_lines(spark, sf_dir).withColumn("dark", F.col("dark_share") >= 0.25)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS page_id",
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT), "
        "CAST(round(l_extendedprice * 100) AS BIGINT), CAST(l_shipdate AS DATE)) AS det_id",
        "CAST((l_partkey % 40) * 8 + CASE WHEN l_linenumber <= 4 THEN (l_suppkey % 7) - 3 ELSE 40 + l_suppkey % 61 END AS DOUBLE) AS dx",
        "CAST((l_suppkey % 50) * 8 + CASE WHEN l_linenumber <= 4 THEN (l_partkey % 5) - 2 ELSE 55 - l_partkey % 83 END AS DOUBLE) AS dy",
        "(16 + 2 * l_quantity) * (CAST(0.6 AS DOUBLE) + 6 * l_discount) AS dw",
        "(16 + 3 * (l_partkey % 30)) * (CAST(0.6 AS DOUBLE) + 8 * l_tax) AS dh",
        "CAST((7 * l_partkey + 13 * l_suppkey) % 1000 AS DOUBLE) / 1000 AS score",
        "l_linestatus AS model",
    )


def held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").selectExpr("o_orderkey AS page_id")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time as microseconds since 1970, free of any session time zone."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "user_id",
        "event_type",
        "value",
        "CAST(get_json_object(props, '$.k') AS INT) AS k",
        "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) AS at_us",
    )


def event_bucket() -> Column:
    """Six hours of event time: a month of events gives a user at most 124 summary rows."""
    return F.floor(F.col("at_us") / (6 * 3_600_000_000))


def settings_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings changes per user; a field a change does not carry is null."""
    return events(spark, sf_dir).selectExpr(
        "event_id", "user_id", "at_us",
        "CASE WHEN (event_id + 1) % 4 = 0 THEN NULL WHEN k % 10 = 9 THEN CAST('NaN' AS DOUBLE) ELSE value / 100 END AS threshold",
        "CASE WHEN (event_id + 2) % 4 = 0 THEN NULL ELSE element_at(array('local', 'cloud', 'other'), k % 3 + 1) END AS provider",
        "CASE WHEN (event_id + 3) % 4 = 0 THEN NULL WHEN k % 7 = 0 THEN ' ' ELSE concat(' key-', k % 5, ' \\n') END AS api_key",
        "CASE WHEN event_id % 4 = 0 THEN NULL ELSE element_at(array('ja', 'zh', 'ko', 'xx'), k % 4 + 1) END AS source",
        "CASE WHEN (event_id + 1) % 4 = 0 THEN NULL ELSE element_at(array('en', 'id'), k % 2 + 1) END AS target",
    )


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images placed in documents: two columns of stacked tiles with small offsets."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS doc_id",
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT), "
        "CAST(round(l_extendedprice * 100) AS BIGINT), CAST(l_shipdate AS DATE)) AS tile_id",
        "CAST(400 * (l_suppkey % 2) + l_partkey % 4 AS DOUBLE) AS x",
        "CAST(150 * (l_linenumber - 1) AS DOUBLE) AS y",
        "CAST(320 + l_partkey % 3 AS DOUBLE) AS w",
        "CAST(CASE WHEN l_partkey % 11 = 0 THEN 450 WHEN l_partkey % 5 = 0 THEN 145 ELSE 150 END AS DOUBLE) AS h",
        "CASE WHEN l_quantity < 3 THEN 1 ELSE 800 END AS natural_width",
        "CASE WHEN l_quantity < 3 THEN 1 ELSE 600 END AS natural_height",
    )


def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One drawn rectangle per document."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS doc_id",
        "CAST(50 + 40 * (o_custkey % 17) AS DOUBLE) AS dx",
        "CAST(40 * (o_custkey % 9) AS DOUBLE) AS dy",
        "CAST(120 + o_custkey % 200 AS DOUBLE) AS dw",
        "CAST(100 + o_custkey % 150 AS DOUBLE) AS dh",
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One placed image per document with its border, padding and object fit."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS doc_id",
        "CAST(10 + o_custkey % 30 AS DOUBLE) AS left",
        "CAST(20 + o_custkey % 40 AS DOUBLE) AS top",
        "CAST(300 + o_custkey % 100 AS DOUBLE) AS width",
        "CAST(400 + o_custkey % 120 AS DOUBLE) AS height",
        "CAST(o_custkey % 4 AS DOUBLE) AS border",
        "CAST(o_custkey % 3 AS DOUBLE) AS padding",
        "CAST(600 + o_custkey % 500 AS DOUBLE) AS natural_width",
        "CAST(700 + o_custkey % 300 AS DOUBLE) AS natural_height",
        "element_at(array('fill', 'contain', 'cover', 'none', 'scale-down'), CAST(o_orderkey % 5 AS INT) + 1) AS object_fit",
        "element_at(array('50%', 'left', 'bottom', '25%', '12px'), CAST(o_orderkey % 5 AS INT) + 1) AS along_x",
        "element_at(array('50%', 'top', 'right', '80%', 'auto'), CAST(o_custkey % 5 AS INT) + 1) AS along_y",
    )


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every document as a wanted text, with a damaged copy as the reading."""
    cut = spread(table(spark, sf_dir, "documents"), "doc_id").select(
        "doc_id", "lang", F.posexplode(F.split("text", r"[.\n]")).alias("sentence", "part")
    )
    return cut.where("trim(part) <> ''").selectExpr(
        "doc_id", "lang", "sentence", "part AS want",
        "CASE (doc_id + sentence) % 3 WHEN 0 THEN part"
        " WHEN 1 THEN regexp_replace(part, concat('(.{', doc_id % 7 + 4, '}).'), '$1')"
        " ELSE replace(replace(part, 'on', 'no'), 'è', 'e') END AS got",
        "CASE WHEN doc_id % 2 = 0 THEN 'horizontal' ELSE 'vertical' END AS orientation",
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as a line to translate."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("page_id"), "lang", F.posexplode(F.split("text", "\n")).alias("position", "source")
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A numbered reply per document: lines left out, repeated, unnumbered, labelled and quoted."""
    def spoil(line, i):
        n = i + 1
        number = F.when(n % 6 == 0, n - 1).otherwise(n)
        mark = F.element_at(F.array(*(F.lit(m) for m in (". ", ") ", ": ", "： "))), (n % 4) + 1)
        body = F.when(n % 3 == 0, F.concat(F.lit("Translation: "), line)).when(
            n % 4 == 1, F.concat(F.lit('"'), line, F.lit('"'))
        ).otherwise(line)
        return F.when(n % 5 == 0, F.lit(None)).when(n % 7 == 0, line).otherwise(
            F.concat(number.cast("string"), mark, body)
        )

    lines = F.split("text", "\n")
    return spread(table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("doc_id").alias("reply_id"), F.size(lines).alias("count"),
        F.array_join(F.filter(F.transform(lines, spoil), lambda s: s.isNotNull()), "\n").alias("reply"),
    )


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as recognition steps of a user: a class (0 is blank) and its probability."""
    return events(spark, sf_dir).selectExpr(
        "event_id", "user_id", "at_us",
        "array_position(array('view', 'click', 'error', 'purchase', 'signup'), event_type) AS raw_class",
        "value", "value / 500 AS p", "k",
    )


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as dense 8 x 8 probability maps of small pages."""
    return spread(table(spark, sf_dir, "embeddings"), "vec_id").select(
        F.col("vec_id").alias("map_id"), "label", F.lit(8).alias("width"),
        F.transform("embedding", lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + 2 * v.cast("double")))).alias("p"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 colour images; the channels are the row read from positions 0, 1 and 2 on."""
    byte = F.transform("embedding", lambda v: F.floor(255 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + v.cast("double")))).cast("int"))
    turned = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), byte.alias("b0"))
    shown = turned.select("image_id", "b0", F.posexplode("b0").alias("pos", "r"))
    return shown.select(
        "image_id", F.floor(F.col("pos") / 8).cast("int").alias("row"), (F.col("pos") % 8).cast("int").alias("col"), "r",
        F.element_at("b0", ((F.col("pos") + 1) % 64 + 1).cast("int")).alias("g"),
        F.element_at("b0", ((F.col("pos") + 2) % 64 + 1).cast("int")).alias("b"),
    ).withColumn("luma", F.floor((F.col("r") * 299 + F.col("g") * 587 + F.col("b") * 114) / 1000).cast("int"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 32 x 32 balloon windows: pale cells inside a dark frame, text mask in the middle."""
    def pixel(i):
        row, col = F.floor(i / 32), i % 32
        cell = F.element_at("embedding", (F.floor(row / 4) * 8 + F.floor(col / 4) + 1).cast("int"))
        frame = (row < 3) | (row >= 29) | (col < 3) | (col >= 29)
        return F.when(frame | (cell < -0.22), 30).otherwise(F.when(cell > 0.3, 225).otherwise(240))

    def within(lo_r, hi_r, lo_c, hi_c):
        return F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: (
            (F.floor(i / 32) >= lo_r) & (F.floor(i / 32) < hi_r) & (i % 32 >= lo_c) & (i % 32 < hi_c)).cast("int"))

    grey = F.transform(F.sequence(F.lit(0), F.lit(1023)), pixel)
    return spread(table(spark, sf_dir, "embeddings"), "vec_id").select(
        F.col("vec_id").alias("region_id"), F.lit(32).alias("width"), grey.alias("r"), grey.alias("g"), grey.alias("b"),
        within(6, 26, 4, 28).alias("base"), within(12, 20, 12, 20).alias("seed"),
    )
