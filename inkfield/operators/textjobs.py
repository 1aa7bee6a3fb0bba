"""Transcription scores, request planning, reply reconciliation, text assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from inkfield.functions import text as tx
from inkfield.functions.arrays import bind
from inkfield.operators.ordered import ordered_scan

# Fixed values the results depend on.
BATCH_LIMIT = 40
MAX_TOKENS = 512
FIRST_TEXT_TOKEN = 5
NUMBERED = f"^{tx.BLANK}*(\\d{{1,9}}){tx.BLANK}*[.):：]{tx.BLANK}*(.*)$"


def character_error(readings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exact count and character error rate of ``got`` against ``want``, by slice; empty slices do not show."""
    return readings.withColumn("_edits", tx.edits("got", "want")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("_edits") == 0).alias("exact"),
        F.sum("_edits").cast("long").alias("errors"),
        F.sum(F.length("want")).alias("characters"),
    ).withColumn("error_rate", F.try_divide("errors", "characters"))  # null where nothing was wanted


def loose_character_error(readings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same after folding widths and dropping dots, hearts, notes and spaces."""
    return character_error(
        readings.withColumns({"got": tx.loose(F.col("got")), "want": tx.loose(F.col("want"))}), by
    )


def normalisation_report(documents: DataFrame) -> DataFrame:
    """Characters per language before and after post-processing and loose folding."""
    return documents.select(
        "lang", F.length("text").alias("before"),
        F.length(tx.post_process(F.col("text"))).alias("post_processed"),
        F.length(tx.loose(F.col("text"))).alias("loose"),
    ).groupBy("lang").agg(
        F.count(F.lit(1)).alias("documents"),
        *(F.sum(c).alias(c) for c in ("before", "post_processed", "loose")),
    )


def translatable(requests: DataFrame) -> DataFrame:
    return requests.where(tx.trimmed(F.col("source")) != "")


def request_plan(requests: DataFrame, bucket_rows: int = 1024) -> DataFrame:
    """Requests of a page: its translatable lines in order, 40 at most, numbered from 1.

    A request of one line goes unnumbered. The grouped list is bounded by the
    chunk size; numbering a long page runs over buckets of its positions.
    """
    numbered = ordered_scan(
        translatable(requests), ["page_id"], ["position"], F.floor(F.col("position") / bucket_rows), rank="_rank"
    )
    entry = F.struct("_rank", "position", "source")
    packed = (
        numbered.withColumn("chunk", F.floor((F.col("_rank") - 1) / BATCH_LIMIT))
        .groupBy("page_id", "chunk")
        .agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    )
    rows = F.size("entries")
    listed = F.array_join(
        F.transform("entries", lambda e, i: F.concat((i + 1).cast("string"), F.lit(". "), e["source"])), "\n"
    )
    return packed.select(
        "page_id", "chunk", rows.alias("rows"), (rows > 1).alias("numbered"),
        F.when(rows > 1, listed).otherwise(F.element_at("entries", 1)["source"]).alias("prompt"),
        (rows * MAX_TOKENS).alias("tokens"),
        F.transform("entries", lambda e: e["position"]).alias("positions"),
    )


def parse_replies(replies: DataFrame, key: str) -> DataFrame:
    """Numbered replies as one row per asked number; skipped numbers have a null text.

    A line starting with a number in range opens that entry, replacing an
    earlier one; other lines continue the entry above. A reply is one row, so
    its lines are worked on inside the row and nothing is shuffled; each line is
    looked at a fixed number of times.
    """

    def tag(line: Column, i: Column) -> Column:
        number = F.regexp_extract(line, NUMBERED, 1).try_cast("int")
        return F.struct(
            i.alias("i"), F.when(number.between(1, F.col("count")), number).alias("number"),
            F.regexp_extract(line, NUMBERED, 2).alias("rest"), tx.trimmed(line).alias("line"),
        )

    tagged = replies.select(key, "count", F.transform(F.split("reply", "\n"), tag).alias("lines"))
    opened = tagged.withColumn("starts", F.filter("lines", lambda s: s["number"].isNotNull()))

    def entry(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1)["i"], F.size("lines"))
        more = F.filter(F.slice("lines", start["i"] + 2, end - start["i"] - 1), lambda s: s["line"] != "")
        text = F.concat_ws(" ", start["rest"], F.array_join(F.transform(more, lambda s: s["line"]), " "))
        return F.struct(start["number"].alias("number"), start["i"].alias("i"), text.alias("text"))

    entries = opened.where("count > 0").select(key, "count", F.array_sort(F.transform("starts", entry)).alias("entries"))
    answered = entries.select(
        key, "count", F.filter("entries", lambda e, k: ~F.coalesce(F.get("entries", k + 1)["number"] == e["number"], F.lit(False))).alias("answers")
    )
    missing = F.array_except(F.sequence(F.lit(1), F.col("count")), F.transform("answers", lambda e: e["number"]))
    skipped = F.transform(missing, lambda n: F.struct(n.alias("number"), F.lit(-1).alias("i"), F.lit(None).cast("string").alias("text")))
    rows = answered.select(key, F.explode(F.concat("answers", skipped)).alias("e"))
    return rows.select(key, F.col("e.number").alias("number"), F.when(F.col("e.text").isNotNull(), tx.clean_reply(tx.trimmed(F.col("e.text")))).alias("text"))


def reask(parsed: DataFrame, key: str) -> DataFrame:
    """Numbers to ask for again: skipped ones only, an empty answer is an answer."""
    return parsed.where(F.col("text").isNull()).select(key, "number")


def reconcile(requests: DataFrame, translated: DataFrame, lobes: DataFrame, art: DataFrame) -> DataFrame:
    """Parallel results of one page joined by position: missing text '', no lobes, not on art."""
    keys = ["page_id", "position"]
    return (
        requests.join(translated, keys, "left").join(lobes, keys, "left").join(art, keys, "left")
        .fillna({"text": "", "lobes": 0, "on_art": False})
    )


def not_done(regions: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    return regions.join(done, list(key), "left_anti")


def label_union(lines: DataFrame, width: int = 2) -> DataFrame:
    """Reference lines of any languages with ids like ``ko07`` from their language and position."""
    number = F.col("position").cast("string")
    padded = F.lpad(number, F.greatest(F.lit(width), F.length(number)), F.lit("0"))
    return lines.select("language", F.concat("language", padded).alias("id"), "source")


def detokenize(sequences: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """Token ids to text: special ids and ``<unused`` entries dropped, the rest in order."""
    words = vocabulary.where(~F.col("token").startswith("<unused") & (F.col("id") >= FIRST_TEXT_TOKEN))
    spelled = (
        sequences.select(key, F.posexplode("ids").alias("pos", "id"))
        .join(words, "id")
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("tokens"))
    )
    return sequences.select(key).join(spelled, key, "left").select(
        key, F.coalesce(F.array_join(F.transform("tokens", lambda t: t["token"]), ""), F.lit("")).alias("text")
    )


def region_text(regions: DataFrame, lines: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """Non-empty line texts of a region in order, joined by its language's separator.

    A region without any line is read whole.
    """
    joined = (
        lines.where("text <> ''")
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("parts"))
    )
    seen = lines.select(key).distinct().withColumn("has_lines", F.lit(True))
    parts = F.transform("parts", lambda p: p["text"])
    text = F.when(F.col("language") == "ko", F.array_join(parts, " ")).otherwise(F.array_join(parts, ""))
    return (
        regions.join(joined, key, "left").join(seen, key, "left")
        .join(whole.select(key, F.col("text").alias("whole_text")), key, "left")
        .select(
            key,
            F.when(F.col("has_lines"), F.coalesce(text, F.lit("")))
            .otherwise(F.coalesce("whole_text", F.lit(""))).alias("text"),
        )
    )


REPLY_SCHEMA = (
    "candidates ARRAY<STRUCT<content: STRUCT<parts: ARRAY<STRUCT<text: STRING>>>, finishReason: STRING>>, "
    "promptFeedback STRUCT<blockReason: STRING>"
)


def read_replies(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Model reply bodies: text of the first candidate, or why there is none."""
    parsed = bodies.withColumn("_r", F.from_json(body, REPLY_SCHEMA))
    first = F.try_element_at(F.col("_r.candidates"), F.lit(1))
    text = F.coalesce(
        F.array_join(F.transform(first["content"]["parts"], lambda p: F.coalesce(p["text"], F.lit(""))), ""), F.lit("")
    )
    block, finish = F.col("_r.promptFeedback.blockReason"), first["finishReason"]
    blocked = F.coalesce(block, F.lit("")) != ""
    cut = (text == "") & (F.coalesce(finish, F.lit("STOP")) != "STOP") & (finish != "")
    return parsed.select(
        *(c for c in bodies.columns if c != body),
        F.when(blocked | cut, F.lit(None)).otherwise(text).alias("text"),
        F.when(blocked, F.concat(F.lit("blocked "), block)).when(cut, F.concat(F.lit("no text "), finish)).alias("error"),
    )
