"""Queries of scalar text functions, identities and quality ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, identity, text as T
from ..operators import layout
from .base import BLOCKS, ENTRIES, WS, blocks, sql_clean, sql_collapse, sql_key, sql_strip, table, translations


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    cleaned = T.clean_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(cleaned).cast("bigint").alias("clean_chars"), F.md5(cleaned).alias("clean_md5"))


def content_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Texts that several blocks have, white space and case aside."""
    keyed = blocks(spark, d, "text").select(F.sha2(T.normalize_key(F.col("text")), 256).alias("content"), "block_key")
    return keyed.groupBy("content").agg(F.count("*").alias("n_blocks"), F.min("block_key").alias("first_block")).where("n_blocks > 1")


def normalized_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "glossary").groupBy(T.normalize_key(F.col("source")).alias("term")).agg(F.count("*").alias("n_rows"), F.count_distinct("kb_id").alias("n_kbs"))


def wrap_proof(spark: SparkSession, d: str) -> DataFrame:
    """First and last 18 characters of every translation without white space: what a rendering has to contain."""
    dense = T.no_space(F.col("zh"))
    rows = translations(spark, d, "zh").where(F.length(dense) > 0)
    return rows.select("entry_id", F.left(dense, F.lit(18)).alias("head"), F.right(dense, F.lit(18)).alias("tail"))


def cjk_share(spark: SparkSession, d: str) -> DataFrame:
    return translations(spark, d, "zh").where("zh IS NOT NULL").select("entry_id", T.cjk_ratio(F.col("zh")).alias("cjk_ratio"))


def symbol_share(spark: SparkSession, d: str) -> DataFrame:
    return blocks(spark, d, "text").select("block_key", T.symbol_ratio(F.col("text")).alias("symbol_ratio"))


def reflowed(spark: SparkSession, d: str) -> DataFrame:
    out = T.reflow(F.col("zh"))
    return translations(spark, d, "zh").where("zh IS NOT NULL").select("entry_id", out.alias("zh"), (out != F.col("zh")).alias("changed"))


def english_phrases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "glossary").select("gid", T.english_phrase(F.col("source")).alias("phrase"))


def chinese_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "glossary").where("target IS NOT NULL").select("gid", T.chinese_term(F.col("target")).alias("term"))


def escaped_html(spark: SparkSession, d: str) -> DataFrame:
    return blocks(spark, d, "text", "color").select("block_key", F.md5(T.html_escape(F.col("text"))).alias("html_md5"), T.rgb(F.col("color"))["r"].alias("r"), T.rgb(F.col("color"))["b"].alias("b"))


def compatibility_characters(spark: SparkSession, d: str) -> DataFrame:
    """Compatibility ideographs, and blanks between Chinese characters, per paper."""
    rows = translations(spark, d, "paper_id", "zh").where("zh IS NOT NULL")
    compat, gaps = F.regexp_count("zh", F.lit(r"[\x{f900}-\x{faff}]")), F.regexp_count("zh", F.lit(rf"[{T.CJK}][ \x{{a0}}][{T.CJK}]"))
    return rows.groupBy("paper_id").agg(F.sum(compat).cast("bigint").alias("compat"), F.sum(gaps).cast("bigint").alias("gaps"))


def kind_check(spark: SparkSession, d: str) -> DataFrame:
    """Kinds by rule, per page region and style, against the kinds delivered."""
    b = blocks(spark, d, "text", "bold", "font", "math_only", "kind").where("x0 IS NOT NULL")
    regions = b.where("kind = 'table'").select("paper_id", "page", *[F.col(c).alias("r" + c) for c in ("x0", "y0", "x1", "y1")])
    inside = layout.in_regions(b, regions, 0.25, strict=False).withColumn("_in", F.lit(True))
    ruled = b.join(inside, "block_key", "left").withColumn("rule", layout.kind(F.coalesce("_in", F.lit(False))))
    return ruled.groupBy("rule", F.coalesce("kind", F.lit("none")).alias("delivered")).agg(F.count("*").alias("n_blocks"))


def columns_by_box(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d, "col").where("x0 IS NOT NULL")
    return b.groupBy("col", geometry.Box.of().column(layout.PAGE_WIDTH).alias("by_box")).agg(F.count("*").alias("n_blocks"))


def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Source hashes, new and as delivered."""
    new = identity.source_hash(F.col("page"), F.col("text"))
    return blocks(spark, d, "text", "source_hash").select("block_key", new.alias("source_hash"), F.coalesce(new == F.col("source_hash"), F.lit(False)).alias("same"))


def layout_uids(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d, "text", "col").where("x0 IS NOT NULL")
    return b.select("block_key", identity.layout_uid(F.col("page"), F.col("col"), [F.col(c) for c in ("x0", "y0", "x1", "y1")], F.col("text")).alias("layout_uid"))


_HTML = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_CLEAN = sql_clean("text")
_PUNCT = "[㐀-鿿，。；：！？、（）《》【】]"


def reflowed_sql(s: str) -> str:
    """SQL of a text as one paragraph."""
    held = sql_strip(f"regexp_replace({s}, '[ \\t\\r\\n\\f\\x0b]+', ' ', 'g')")
    return f"""regexp_replace(regexp_replace({held}, '({_PUNCT}) +', '\\1', 'g'), ' +({_PUNCT})', '\\1', 'g')"""


_REFLOW = reflowed_sql("zh")


def _dense(s: str) -> str:
    return f"regexp_replace({s}, '{WS}+', '', 'g')"


_KIND = rf"""CASE WHEN regexp_matches(text, '(?i)^{WS}*(?:Table|Tab\.){WS}*\d+\b') THEN 'table_caption' WHEN regexp_matches(text, '(?i)^{WS}*(?:Fig\.?|Figure){WS}*\d+\b') THEN 'figure_caption'
 WHEN inside THEN 'table' WHEN regexp_matches(text, '(?i)^{WS}*(?:\d{{1,4}}|[ivxlcdm]{{1,8}}){WS}*$') THEN 'meta'
 WHEN length(text) < 160 AND regexp_matches(text, '(?i)(doi{WS}*:|https?://|www\.|copyright|©|all rights reserved|received{WS}|accepted{WS}|journal homepage|available online|corresponding author|preprint|under review)') THEN 'meta'
 WHEN regexp_matches(text, '(?i)^{WS}*(?:references|bibliography|reference list){WS}*[:.]?{WS}*$') THEN 'reference_heading' WHEN coalesce(math_only, false) THEN 'math_only'
 WHEN coalesce(bold, false) OR (contains(lower(coalesce(font, '')), 'italic') AND length(text) <= 130 AND NOT regexp_matches(text, '[.!?;:。！？；：]$')) THEN 'heading'
 WHEN length(text) < 100 AND (y0 < 0.055::DOUBLE * 1000 OR y1 > 0.955::DOUBLE * 1000) THEN 'meta' ELSE 'body' END"""

QUERIES = {
    "clean_text": clean_text, "content_duplicates": content_duplicates, "normalized_keys": normalized_keys, "wrap_proof": wrap_proof, "cjk_ratio": cjk_share, "symbol_ratio": symbol_share,
    "reflow_text": reflowed, "english_phrases": english_phrases, "chinese_terms": chinese_terms, "html_escape": escaped_html, "compatibility_characters": compatibility_characters,
    "kind_histogram": kind_check, "column_class": columns_by_box, "source_hashes": content_hashes, "layout_uids": layout_uids,
}
NOISE_WORDS = [
    "本工作得到", "本工作", "本文", "本研究", "该项目", "该", "其中", "即为", "即", "例如", "比如", "包括", "采用", "利用", "基于", "得到", "需要", "可以", "能够", "以及", "和", "与", "及", "在", "由", "是", "称为", "命名为",
]
STOP_WORDS = "|".join(
    w.replace(".", r"\.")
    for w in (
        "we", "the", "a", "an", "this", "that", "these", "those", "our", "their", "its", "it", "in", "by", "for", "to", "as", "of", "and", "or", "is", "are", "was", "were", "however", "moreover", "furthermore",
        "additionally", "finally", "thus", "therefore", "besides", "specifically", "notably", "here", "there", "using", "based", "with", "called", "named", "termed", "namely", "such", "including", "include",
        "includes", "proposed", "propose", "develop", "developed", "introduce", "introduced", "present", "presented", "use", "used", "adopt", "adopted", "see", "e.g", "i.e",
    )
)
ORACLES = {
    "clean_text": f"SELECT doc_id, length(c) AS clean_chars, md5(c) AS clean_md5 FROM (SELECT doc_id, {_CLEAN} AS c FROM documents)",
    "content_duplicates": f"WITH {BLOCKS} SELECT sha256({sql_key('text')}) AS content, count(*) AS n_blocks, min(block_key) AS first_block FROM b GROUP BY 1 HAVING count(*) > 1",
    "normalized_keys": f"SELECT {sql_key('source')} AS term, count(*) AS n_rows, count(DISTINCT kb_id) AS n_kbs FROM glossary GROUP BY 1",
    "wrap_proof": f"WITH {ENTRIES} SELECT entry_id, left(x, 18) AS head, right(x, 18) AS tail FROM (SELECT entry_id, {_dense('zh')} AS x FROM t) WHERE length(x) > 0",
    "cjk_ratio": f"WITH {ENTRIES} SELECT entry_id, CASE WHEN length(zh) > 0 THEN len(regexp_extract_all(zh, '[{T.CJK}]'))::DOUBLE / length(zh) ELSE 0.0::DOUBLE END AS cjk_ratio FROM t WHERE zh IS NOT NULL",
    "symbol_ratio": rf"""WITH {BLOCKS}, x AS (SELECT block_key, {_dense("coalesce(text, '')")} AS s FROM b)
        SELECT block_key, CASE WHEN length(s) > 0 THEN len(regexp_extract_all(s, '[^\p{{L}}\p{{N}}.,;:''"()%\-–—+/]'))::DOUBLE / length(s) ELSE 0.0::DOUBLE END AS symbol_ratio FROM x""",
    "reflow_text": f"WITH {ENTRIES}, r AS (SELECT entry_id, zh AS old, {_REFLOW} AS zh FROM t WHERE zh IS NOT NULL) SELECT entry_id, zh, zh <> old AS changed FROM r",
    "english_phrases": rf"""WITH w AS (SELECT gid, list_filter(regexp_split_to_array(regexp_replace(source, '^[ ,;.:]+|[ ,;.:]+$', '', 'g'), '{WS}+'), lambda x: x <> '') AS ws FROM glossary),
        c AS (SELECT gid, ws, list_transform(ws, lambda x: NOT regexp_full_match(regexp_replace(lower(x), '^[.,;:]+|[.,;:]+$', '', 'g'), '{STOP_WORDS}')) AS ok FROM w),
        k AS (SELECT gid, CASE WHEN list_contains(ok, true) THEN ws[list_position(ok, true):len(ws) - list_position(list_reverse(ok), true) + 1] END AS kept FROM c)
        SELECT gid, CASE WHEN len(kept) <= 6 AND len(list_filter(kept, lambda x: length(x) > 2)) > 0 AND length(array_to_string(kept, ' ')) BETWEEN 3 AND 52 THEN array_to_string(kept, ' ') ELSE '' END AS phrase FROM k""",
    "chinese_terms": rf"""WITH RECURSIVE n AS (SELECT unnest([{", ".join(f"'{w}'" for w in NOISE_WORDS)}]) AS w),
        s AS (SELECT gid, {sql_strip("regexp_split_to_array(" + sql_strip("target") + r", '[。，；：！？、（）()\[\]【】]')[-1]")} AS t, 0 AS k FROM glossary WHERE target IS NOT NULL
              UNION ALL SELECT gid, substr(t, (SELECT max(length(w)) FROM n WHERE starts_with(t, w) AND length(t) > length(w) + 1) + 1), k + 1 FROM s WHERE EXISTS (SELECT 1 FROM n WHERE starts_with(t, w) AND length(t) > length(w) + 1))
        SELECT gid, CASE WHEN length(arg_max(t, k)) BETWEEN 2 AND 24 THEN arg_max(t, k) ELSE '' END AS term FROM s GROUP BY gid""",
    "html_escape": f"WITH {BLOCKS} SELECT block_key, md5({_HTML}) AS html_md5, ((color >> 16) & 255) / 255.0::DOUBLE AS r, (color & 255) / 255.0::DOUBLE AS b FROM b",
    "compatibility_characters": f"WITH {ENTRIES} SELECT paper_id, sum(len(regexp_extract_all(zh, '[\\x{{f900}}-\\x{{faff}}]')))::BIGINT AS compat, sum(len(regexp_extract_all(zh, '[{T.CJK}][ \\x{{a0}}][{T.CJK}]')))::BIGINT AS gaps FROM t WHERE zh IS NOT NULL GROUP BY 1",
    "kind_histogram": f"""WITH {BLOCKS}, r AS (SELECT paper_id, page, x0 AS a0, y0 AS a1, x1 AS a2, y1 AS a3 FROM b WHERE kind = 'table' AND x0 IS NOT NULL),
        i AS (SELECT b.*, EXISTS (SELECT 1 FROM r WHERE r.paper_id = b.paper_id AND r.page = b.page AND greatest(0, least(x1, a2) - greatest(x0, a0)) * greatest(0, least(y1, a3) - greatest(y0, a1)) / greatest(1e-6::DOUBLE, (x1 - x0) * (y1 - y0)) >= 0.25::DOUBLE) AS inside FROM b WHERE x0 IS NOT NULL)
        SELECT {_KIND} AS rule, coalesce(kind, 'none') AS delivered, count(*) AS n_blocks FROM i GROUP BY 1, 2""",
    "column_class": f"""WITH {BLOCKS} SELECT col, CASE WHEN x1 - x0 >= 600 * 0.68::DOUBLE OR (x0 < 300 AND 300 < x1 AND x1 - x0 >= 600 * 0.42::DOUBLE) THEN 'full' WHEN (x0 + x1) / 2 < 300 THEN 'left' ELSE 'right' END AS by_box, count(*) AS n_blocks FROM b WHERE x0 IS NOT NULL GROUP BY 1, 2""",
    "source_hashes": f"WITH {BLOCKS}, h AS (SELECT block_key, source_hash AS old, substr(sha256(page::VARCHAR || chr(0) || {sql_collapse('text')}), 1, 24) AS source_hash FROM b) SELECT block_key, source_hash, coalesce(source_hash = old, false) AS same FROM h",
    "layout_uids": f"""WITH {BLOCKS} SELECT block_key, substr(sha256(page::VARCHAR || chr(0) || coalesce(nullif(col, ''), '?') || chr(0) || printf('%.1f,%.1f,%.1f,%.1f', round_even(x0 * 2, 0) / 2, round_even(y0 * 2, 0) / 2, round_even(x1 * 2, 0) / 2, round_even(y1 * 2, 0) / 2) || chr(0) || {sql_collapse('text')}), 1, 24) AS layout_uid FROM b WHERE x0 IS NOT NULL""",
}
