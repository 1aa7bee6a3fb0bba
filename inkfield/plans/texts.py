"""Transcription scores, requests and replies by name, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkfield.functions import text as tx
from inkfield.operators import textjobs as tj
from inkfield.plans import standins as st
from inkfield.plans.registry import SQL, query, rounded
from inkfield.plans.views_sql import views

# The text is accented; the oracle engine's edit distance counts bytes, so its
# side maps every accented letter to a control character first, one to one.
_ACCENTED = "ÉßÈÑèéÍöüÖÓóçíÇêÊÄñäÜàÀâÂôÔùÙûÛ"
_PLAIN = " || ".join(f"chr({c})" for c in list(range(1, 9)) + list(range(14, 14 + len(_ACCENTED) - 8)))
_BYTE = "translate({}, '" + _ACCENTED + "', " + _PLAIN + ")"

SENTENCES = r"""cut_v AS (
  SELECT doc_id, lang, unnest(string_split_regex(text, '[.\n]')) AS part, generate_subscripts(string_split_regex(text, '[.\n]'), 1) - 1 AS sentence
  FROM documents),
sentences_v AS (
  SELECT doc_id, lang, sentence, part AS want, CASE (doc_id + sentence) % 3 WHEN 0 THEN part
      WHEN 1 THEN regexp_replace(part, '(.{' || (doc_id % 7 + 4) || '}).', '\1', 'g')
      ELSE replace(replace(part, 'on', 'no'), 'è', 'e') END AS got,
    CASE WHEN doc_id % 2 = 0 THEN 'horizontal' ELSE 'vertical' END AS orientation
  FROM cut_v WHERE trim(part) <> '')"""


@query
def cer_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tj.character_error(st.sentences(spark, sf_dir), ["lang", "orientation"]))


SQL["cer_by_slice"] = views(SENTENCES) + f"""
SELECT lang, orientation, count(*) AS n, count(*) FILTER (got = want) AS exact,
  CAST(sum(levenshtein({_BYTE.format('got')}, {_BYTE.format('want')})) AS BIGINT) AS errors,
  CAST(sum(length(want)) AS BIGINT) AS characters,
  round(1e-9 + sum(levenshtein({_BYTE.format('got')}, {_BYTE.format('want')})) / sum(length(want)), 6) AS error_rate
FROM sentences_v GROUP BY lang, orientation"""


@query
def loose_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tj.loose_character_error(st.sentences(spark, sf_dir), ["lang"]))


# The stand-in text has no characters NFKC changes, so the fold is the dropping alone.
_LOOSE = r"regexp_replace({}, '[.．…・♪❤♥♡\s]', '', 'g')"
SQL["loose_cer"] = views(SENTENCES) + f""", loose_v AS (
  SELECT lang, {_LOOSE.format('got')} AS got, {_LOOSE.format('want')} AS want FROM sentences_v)
SELECT lang, count(*) AS n, count(*) FILTER (got = want) AS exact,
  CAST(sum(levenshtein({_BYTE.format('got')}, {_BYTE.format('want')})) AS BIGINT) AS errors,
  CAST(sum(length(want)) AS BIGINT) AS characters,
  round(1e-9 + sum(levenshtein({_BYTE.format('got')}, {_BYTE.format('want')})) / sum(length(want)), 6) AS error_rate
FROM loose_v GROUP BY lang"""


# Halves of a text as a Japanese one is set: full-width blanks, no-break blanks, middle dots and ellipses.
_WIDE = {" ": "\u3000", ",": "\u00a0", "a": "ａ", "e": "・", "i": "…"}


@query
def wide_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rules on every document, its letters and blanks made those of East Asian print."""
    wide = F.concat(F.lit("\u3000"), F.translate("text", "".join(_WIDE), "".join(_WIDE.values())), F.lit("\u00a0\u3000"))
    rows = st.table(spark, sf_dir, "documents").select("doc_id", wide.alias("source"))
    blank = rows.select((-1 - F.col("doc_id")).alias("doc_id"), F.lit("\u3000\u00a0 ").alias("source"))
    return tj.translatable(rows.unionByName(blank)).select(
        "doc_id", F.md5(tx.post_process(F.col("source"))).alias("dense"), F.md5(tx.trimmed(F.col("source"))).alias("trimmed"),
        F.size(F.filter(F.split("source", f"{tx.BLANK}+"), lambda w: w != "")).cast("long").alias("words"),
    )


_ANY_BLANK = "[\\t-\\r \u00a0\u3000]"
SQL["wide_text"] = f"""
WITH w AS (SELECT doc_id, '\u3000' || translate(text, ' ,aei', '\u3000\u00a0ａ・…') || '\u00a0\u3000' AS source FROM documents),
d AS (SELECT *, replace(regexp_replace(source, '{_ANY_BLANK}+', '', 'g'), '…', '...') AS dense FROM w),
r AS (SELECT *, list_aggregate(list_transform(range(1, length(dense) + 1), lambda i: CASE WHEN dense[i] = '・'
  AND (i > 1 AND dense[i - 1] IN ('・', '.') OR i < length(dense) AND dense[i + 1] IN ('・', '.')) THEN '.' ELSE dense[i] END), 'string_agg', '') AS dotted FROM d)
SELECT doc_id, md5(array_to_string(list_transform(range(1, length(dotted) + 1), lambda i:
    CASE WHEN ord(dotted[i]) BETWEEN 33 AND 126 THEN chr(ord(dotted[i]) + 65248) ELSE dotted[i] END), '')) AS dense,
  md5(regexp_replace(source, '^{_ANY_BLANK}+|{_ANY_BLANK}+$', '', 'g')) AS trimmed,
  len(list_filter(string_split_regex(source, '{_ANY_BLANK}+'), lambda x: x <> '')) AS words
FROM r"""


@query
def normalisation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tj.normalisation_report(st.table(spark, sf_dir, "documents"))


SQL["normalisation_report"] = f"""
SELECT lang, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS before,
  CAST(sum(length(replace(regexp_replace(text, '\\s+', '', 'g'), '…', '...'))) AS BIGINT) AS post_processed,
  CAST(sum(length({_LOOSE.format('text')})) AS BIGINT) AS loose FROM documents GROUP BY lang"""


@query
def post_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.post_process(F.col("text"))).alias("digest"))


_VISIBLE = tx.ASCII_VISIBLE.replace("'", "''")
SQL["post_process"] = f"""
SELECT doc_id, md5(translate(replace(regexp_replace(text, '\\s+', '', 'g'), '…', '...'), '{_VISIBLE}', '{tx.FULL_WIDTH}')) AS digest
FROM documents"""

REQUESTS = r"""requests_v AS (
  SELECT doc_id AS page_id, lang, unnest(string_split(text, chr(10))) AS source,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS position FROM documents)"""
PLAN = REQUESTS + r""",
numbered_v AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY position) AS r FROM requests_v
  WHERE regexp_replace(source, '^\s+|\s+$', '', 'g') <> ''),
plan_v AS (
  SELECT page_id, (r - 1) // 40 AS chunk, count(*) AS n,
    CASE WHEN count(*) > 1 THEN string_agg(((r - 1) % 40 + 1) || '. ' || source, chr(10) ORDER BY r) ELSE any_value(source) END AS prompt
  FROM numbered_v GROUP BY page_id, (r - 1) // 40)"""


@query
def request_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = tj.request_plan(st.requests(spark, sf_dir))
    return plan.select("page_id", "chunk", F.col("rows").cast("long"), "numbered", "prompt", F.col("tokens").cast("long"))


SQL["request_plan"] = views(PLAN) + """
SELECT page_id, chunk, n AS "rows", n > 1 AS numbered, prompt, 512 * n AS tokens FROM plan_v"""


@query
def request_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instructions sent with each request, by language pair."""
    pages = st.table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS page_id", "element_at(array('ja', 'zh', 'ko'), CAST(doc_id % 3 AS INT) + 1) AS source",
        "element_at(array('en', 'id'), CAST(doc_id % 2 AS INT) + 1) AS target",
    )
    plan = tj.request_plan(st.requests(spark, sf_dir)).join(pages, "page_id")
    system = tx.system_prompt(F.col("source"), F.col("target"), F.col("numbered"))
    return plan.groupBy(system.alias("system")).agg(F.count(F.lit(1)).alias("requests"))


_SINGLE = tx.SINGLE_PROMPT.replace("%1$s", "' || a || '").replace("%2$s", "' || b || '").replace("%3$s", "' || c || '")
SQL["request_prompts"] = views(PLAN) + f""", named_v AS (
  SELECT ['Japanese', 'Chinese', 'Korean'][page_id % 3 + 1] AS a, ['romaji', 'pinyin', 'romanization'][page_id % 3 + 1] AS b,
    ['English', 'Indonesian'][page_id % 2 + 1] AS c, n > 1 AS batch FROM plan_v)
SELECT '{_SINGLE}' || CASE WHEN batch THEN '{tx.BATCH_PROMPT}' ELSE '' END AS system, count(*) AS requests
FROM named_v GROUP BY ALL"""

REPLIES = r"""source_v AS (
  SELECT doc_id AS reply_id, len(string_split(text, chr(10))) AS n, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
spoiled_v AS (
  SELECT reply_id, n, i, CASE WHEN i % 7 = 0 THEN line ELSE (CASE WHEN i % 6 = 0 THEN i - 1 ELSE i END)
      || ['. ', ') ', ': ', '： '][i % 4 + 1] || CASE WHEN i % 3 = 0 THEN 'Translation: ' || line
      WHEN i % 4 = 1 THEN '"' || line || '"' ELSE line END END AS line
  FROM source_v WHERE i % 5 <> 0),
tagged_v AS (
  SELECT *, CASE WHEN TRY_CAST(regexp_extract(line, '^\s*(\d{1,9})\s*[.):：]\s*(.*)$', 1) AS INT) BETWEEN 1 AND n
    THEN TRY_CAST(regexp_extract(line, '^\s*(\d{1,9})\s*[.):：]\s*(.*)$', 1) AS INT) END AS num FROM spoiled_v),
carried_v AS (
  SELECT *, last_value(CASE WHEN num IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY reply_id ORDER BY i
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS start FROM tagged_v),
final_v AS (SELECT reply_id, num, max(i) AS start FROM tagged_v WHERE num IS NOT NULL GROUP BY ALL),
entry_v AS (
  SELECT f.reply_id, f.num, regexp_replace(string_agg(CASE WHEN c.i = f.start
      THEN regexp_extract(line, '^\s*(\d{1,9})\s*[.):：]\s*(.*)$', 2) ELSE regexp_replace(line, '^\s+|\s+$', '', 'g') END, ' ' ORDER BY c.i),
      '^\s+|\s+$', '', 'g') AS raw
  FROM final_v f JOIN carried_v c ON c.reply_id = f.reply_id AND c.start = f.start
  WHERE c.i = f.start OR regexp_replace(line, '^\s+|\s+$', '', 'g') <> '' GROUP BY ALL),
bare_v AS (
  SELECT reply_id, num, regexp_replace(regexp_replace(raw,
    '^\s*(?:english|translation|translated(?:\s+text)?|answer|output)\s*[:：-]\s*', '', 'i'), '^\s+|\s+$', '', 'g') AS bare FROM entry_v),
parsed_v AS (
  SELECT a.reply_id, a.number, CASE WHEN length(bare) > 2 AND ((bare[1] = '"' AND bare[-1] = '"') OR (bare[1] = '''' AND bare[-1] = ''''))
    THEN regexp_replace(substr(bare, 2, length(bare) - 2), '^\s+|\s+$', '', 'g') ELSE bare END AS text
  FROM (SELECT doc_id AS reply_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS number FROM documents) a
  LEFT JOIN bare_v b ON b.reply_id = a.reply_id AND b.num = a.number)"""


@query
def reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tj.parse_replies(st.replies(spark, sf_dir), "reply_id").withColumn("number", F.col("number").cast("long"))


SQL["reply_parse"] = views(REPLIES) + "SELECT reply_id, number, text FROM parsed_v"


@query
def reask(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = tj.parse_replies(st.replies(spark, sf_dir), "reply_id")
    return tj.reask(parsed, "reply_id").withColumn("number", F.col("number").cast("long"))


SQL["reask"] = views(REPLIES) + "SELECT reply_id, number FROM parsed_v WHERE text IS NULL"


@query
def zip_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with their parsed texts, lobe counts and flags joined by position."""
    parsed = tj.parse_replies(st.replies(spark, sf_dir), "reply_id").select(
        F.col("reply_id").alias("page_id"), (F.col("number") - 1).alias("position"), "text"
    )
    lines = st.requests(spark, sf_dir)
    lobes = lines.where("length(source) > 200").select("page_id", "position", F.lit(2).alias("lobes"))
    art = lines.where("length(source) < 20").select("page_id", "position", F.lit(True).alias("on_art"))
    rows = tj.reconcile(lines, parsed, lobes, art)
    return rows.select("page_id", F.col("position").cast("long"), F.md5("text").alias("digest"), F.col("lobes").cast("long"), "on_art")


SQL["zip_results"] = views(REQUESTS, REPLIES) + """
SELECT r.page_id, r.position, md5(coalesce(p.text, '')) AS digest, CAST(CASE WHEN length(source) > 200 THEN 2 ELSE 0 END AS BIGINT) AS lobes,
  length(source) < 20 AS on_art
FROM requests_v r LEFT JOIN parsed_v p ON p.reply_id = r.page_id AND p.number = r.position + 1"""


@query
def not_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = st.requests(spark, sf_dir)
    parsed = tj.parse_replies(st.replies(spark, sf_dir), "reply_id").where("text IS NOT NULL")
    done = parsed.select(F.col("reply_id").alias("page_id"), (F.col("number") - 1).alias("position"))
    return tj.not_done(lines, done, ["page_id", "position"]).groupBy("lang").agg(F.count(F.lit(1)).alias("lines"))


SQL["not_done"] = views(REQUESTS, REPLIES) + """
SELECT lang, count(*) AS lines FROM requests_v r WHERE NOT EXISTS (
  SELECT 1 FROM parsed_v p WHERE p.reply_id = r.page_id AND p.number = r.position + 1 AND p.text IS NOT NULL) GROUP BY lang"""


@query
def label_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tj.label_union(st.table(spark, sf_dir, "documents").selectExpr("lang AS language", "doc_id AS position", "md5(text) AS source"))


SQL["label_union"] = """
SELECT lang AS language, lang || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(2, length(CAST(doc_id AS VARCHAR))) AS INT), '0') AS id,
  md5(text) AS source FROM documents"""


@query
def detok(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequences = st.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda v: F.floor(F.abs(v.cast("double")) * 60).cast("int")).alias("ids")
    )
    vocabulary = st.table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey AS id", "CASE WHEN n_nationkey % 9 = 0 THEN concat('<unused', n_nationkey, '>') ELSE n_name END AS token"
    )
    return tj.detokenize(sequences, vocabulary, "vec_id")


SQL["detok"] = """WITH t AS (
  SELECT vec_id, generate_subscripts(embedding, 1) AS pos, CAST(floor(abs(CAST(unnest(embedding) AS DOUBLE)) * 60) AS INT) AS id FROM embeddings)
SELECT e.vec_id, coalesce(x.text, '') AS text FROM embeddings e LEFT JOIN (
  SELECT vec_id, string_agg(n_name, '' ORDER BY pos) AS text FROM t JOIN nation ON n_nationkey = id
  WHERE id >= 5 AND n_nationkey % 9 <> 0 GROUP BY vec_id) x USING (vec_id)"""


@query
def region_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = st.table(spark, sf_dir, "documents")
    regions = documents.selectExpr("doc_id", "CASE WHEN lang IN ('de', 'en') THEN 'ko' ELSE 'ja' END AS language")
    lines = documents.where("source <> 'src0'").select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "text"))
    whole = documents.selectExpr("doc_id", "lang AS text")
    return tj.region_text(regions, lines, whole, "doc_id").select("doc_id", F.md5("text").alias("digest"))


SQL["region_text"] = """WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE source <> 'src0'),
j AS (SELECT l.doc_id, CASE WHEN lang IN ('de', 'en') THEN string_agg(t, ' ' ORDER BY i) FILTER (t <> '')
  ELSE string_agg(t, '' ORDER BY i) FILTER (t <> '') END AS text
  FROM l JOIN documents USING (doc_id) GROUP BY l.doc_id, lang)
SELECT d.doc_id, md5(CASE WHEN d.source <> 'src0' THEN coalesce(j.text, '') ELSE d.lang END) AS digest
FROM documents d LEFT JOIN j USING (doc_id)"""


@query
def reply_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply bodies built from conversations, read back as text or an error."""
    parts = F.transform(F.split("text", "\n"), lambda t: F.struct(t.alias("text")))
    finish = F.when(F.col("turn") % 4 == 1, "MAX_TOKENS").otherwise("STOP")
    shown = F.when(F.col("turn") % 4 == 1, F.array().cast("array<struct<text:string>>")).otherwise(parts)
    candidate = F.struct(F.struct(shown.alias("parts")).alias("content"), finish.alias("finishReason"))
    block = F.when(F.col("conv_id") % 10 == 0, F.struct(F.lit("SAFETY").alias("blockReason")))
    bodies = st.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.to_json(F.struct(F.array(candidate).alias("candidates"), block.alias("promptFeedback"))).alias("body")
    )
    return tj.read_replies(bodies)


SQL["reply_json"] = """
SELECT conv_id, turn, CASE WHEN conv_id % 10 = 0 OR turn % 4 = 1 THEN NULL ELSE replace(text, chr(10), '') END AS text,
  CASE WHEN conv_id % 10 = 0 THEN 'blocked SAFETY' WHEN turn % 4 = 1 THEN 'no text MAX_TOKENS'
    WHEN replace(text, chr(10), '') = '' THEN NULL END AS error FROM conversations"""
