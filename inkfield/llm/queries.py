"""The queries of this subpackage by name and, where SQL can say it, the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkfield.llm import (
    chat_format, decontamination, exact_dedup, filter_audit, jaccard_join, packing, quality_cnn, quality_rules, sentencepiece_codec, source_divergence,
    substring_dedup, token_files, warc,
)
from inkfield.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where the given vocabulary files are; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.decide(table(spark, folder, "documents"))


SQL["op1_exact_dedup"] = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM t WINDOW w AS (PARTITION BY h)
"""


@query
def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = scratch_path(spark, "token-ids")
    index = token_files.write_tokens(table(spark, folder, "documents"), files, tokenizer_file("word_bpe_49k.json"), end_id=1)
    return token_files.read_tokens(spark, index, files)


@query
def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_file("byte_bpe_50k.json"))


@query
def op6_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.components(table(spark, folder, "documents"), size=4, percent=85)


@query
def op7_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_codec.encode_decode(table(spark, folder, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query
def op9_quality_cnn(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality_cnn.classify(docs, quality_cnn.train(docs, table(spark, folder, "labels")))


@query
def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.passages(table(spark, folder, "documents"))


@query
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


_MARKS = {
    "symbol_share": "n_symbols, word_chars", "line_share": "n_dup_lines, n_words", "repeat_share": "n_repeat_words, n_words", "mark_share": "n_marks, word_chars",
}
SQL["op5_quality_rules"] = f"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
), w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d)
, v AS (SELECT doc_id, i, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i))
, r AS (SELECT doc_id, i FROM v WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) >= 2)
, q AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS i FROM r, (VALUES (0), (1), (2)) s(k)) GROUP BY doc_id)
, c AS (
  SELECT d.doc_id, lang, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_marks,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(q.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN q USING (doc_id)
), s AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    {", ".join(f"CASE WHEN {v.split(', ')[1]} > 0 THEN ceil({v.split(', ')[0]} * 100 / {v.split(', ')[1]}) ELSE 0 END AS {k}" for k, v in _MARKS.items())}
  FROM c
), g AS (
  SELECT s.* FROM s JOIN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1) USING (doc_id) WHERE NOT base_failed
), m AS ({" UNION ALL ".join(f"SELECT lang, '{k}' AS measure, {k} AS share FROM g" for k in _MARKS)})
, t AS (
  SELECT lang, measure, cutoff, count(*) AS n, count(*) FILTER (share > cutoff) AS errors
  FROM m, (SELECT unnest([{", ".join(map(str, quality_rules.GRID))}]) AS cutoff) GROUP BY ALL
), a AS (
  SELECT * FROM t WHERE errors <= n * {quality_rules.RISK / 4} AND
    list_sum(list_transform(range(0, errors + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
      + i * ln({quality_rules.RISK / 4}) + (n - i) * ln(1 - {quality_rules.RISK / 4}))))
    <= {quality_rules.DOUBT} / ((SELECT count(DISTINCT coalesce(lang, '?')) FROM g) * 4 * {len(quality_rules.GRID)})
), b AS (SELECT lang, measure, arg_min(cutoff, (errors, cutoff)) AS cutoff FROM a GROUP BY ALL)
, p AS (SELECT lang, {", ".join(f"max(cutoff) FILTER (measure = '{k}') AS {k}_cut" for k in _MARKS)} FROM b GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({" OR ".join(f"coalesce({k} > {k}_cut, false)" for k in _MARKS)}) AS kept
FROM s LEFT JOIN p ON s.lang IS NOT DISTINCT FROM p.lang
"""


@query
def op8_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    trial = "\\### Assistant: </turn> ok"
    own = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    kinds = {f.name: f.dataType for f in own.schema.fields}
    both = own.unionByName(
        spark.createDataFrame([(0, "user", trial), (1, "assistant", trial)], "turn long, role string, text string")
        .select(F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"), F.col("turn").cast(kinds["turn"]).alias("turn"), "role", "text")
    )
    path = tokenizer_file("byte_bpe_50k.json")
    written = scratch_path(spark, "chats")
    chat_format.format_chats(both, path).write.parquet(written)
    return chat_format.digests(spark.read.parquet(written), path)


SQL["op8_chat_format"] = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), e AS (
  SELECT *, regexp_replace(text, '(\\\\*)(###|</turn>)', '\\\\\\1\\2', 'g') AS shown FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(shown) + length(role) + 15)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query
def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = scratch_path(spark, "archives")
    index = warc.write_warc(table(spark, folder, "pages"), archives, segment=1 << 13)
    return warc.read_warc(spark, index, archives)


SQL["op10_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS d FROM pages)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN octet_length(b) >= 1000 AND page_id < max(page_id) OVER w THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN octet_length(b) >= 1000 AND page_id < max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
FROM p WINDOW w AS (PARTITION BY d)
"""


@query
def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


SQL["op11_filter_audit"] = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents)
, s AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text)
, l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id)
, w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM d)
, f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
    + 4 * (100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 3 * length(w.text))::INT
    + 8 * regexp_matches(w.text, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > s.first, false)::INT AS m
  FROM w LEFT JOIN s ON w.text = s.text LEFT JOIN l ON w.doc_id = l.doc_id
)
, c AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS t FROM f GROUP BY part, m)
, x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b)
, o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
)
, q AS (
  SELECT filter_order, k AS step, y.b AS own, coalesce(sum(z.b) FILTER (instr(filter_order, z.x) < k), 0)::INT AS before
  FROM o, unnest(range(1, 6)) r(k), x y, x z WHERE y.x = substr(filter_order, k, 1) GROUP BY ALL
)
, a AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN m & (before | own) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN m & before = 0 AND m & own <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN m & before <> 0 AND m & own <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN m = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN m & before = 0 AND m & own <> 0 THEN g ELSE 0 END) AS good_lost,
    sum(CASE WHEN m & before = 0 AND m & own <> 0 THEN t ELSE 0 END) AS toxic_lost
  FROM c, q GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM a
"""


@query
def op12_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("item_ids")


SQL["op12_decontamination"] = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
)
, i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
)
, m AS (SELECT item, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM i WHERE len(w) > 0)
, v AS (SELECT DISTINCT item, k, array_to_string(w[p:p + k - 1], ' ') AS win FROM m)
, n AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM v))
, o AS (SELECT r, n.k, p, item FROM n JOIN v ON n.k = v.k AND array_to_string(w[p:p + n.k - 1], ' ') = win)
, h AS (SELECT r, count(DISTINCT p + j) AS n_hit FROM (SELECT r, p, unnest(range(0, k)) AS j FROM o) GROUP BY r)
, t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM o) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""


@query
def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence.audit(table(spark, folder, "documents"))


SQL["op13_source_divergence"] = """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents)
, t AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d
)
, k AS (SELECT lang, term, count(*) AS whole FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3)
, c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term)
, g AS (SELECT lang, source, coalesce(any_value(s.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) s USING (lang, source) GROUP BY lang, source)
, v AS (SELECT lang, count(*) AS v, sum(whole) AS n FROM k GROUP BY lang)
, p AS (
  SELECT lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n::HUGEINT + v.v) AS p,
    1 + (1000000000::HUGEINT * (whole + 1)) // (v.n::HUGEINT + v.v) AS q
  FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)
)
, a AS (
  SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
)
, b AS (
  SELECT x.lang, x.source, y.source AS item, coalesce(a.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source
)
, u AS (
  SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value FROM b
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM u QUALIFY part = 'pair' OR rank <= 200
"""
