"""Queries of registering, harvesting, markup and the old paragraph merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup
from ..operators import register
from ..sources import files
from .base import BLOCKS, LATEST, WS, blocks, latest, sql_key, table
from .kb_queries import _USABLE, _pairs


def paper_guesses(spark: SparkSession, d: str) -> DataFrame:
    return register.guesses(blocks(spark, d, "size", "chars", "text", "flow_index"))


def title_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Page-1 blocks that hold the first 40 characters of their own paper's first heading: every heading finds itself."""
    b = blocks(spark, d, "text", "kind")
    titles = b.where("kind = 'heading' AND page = 1").groupBy("paper_id").agg(F.min_by("text", "block_key").alias("title"))
    return register.find_title(b, titles)


def literature_upsert(spark: SparkSession, d: str) -> DataFrame:
    """First records of papers replaced by their later ones."""
    rows = table(spark, d, "literature").select("rec_id", "paper_id", "title_en").dropDuplicates(["rec_id"])
    ends = rows.groupBy("paper_id").agg(F.min_by(F.struct("rec_id", "title_en"), "rec_id").alias("a"), F.max_by(F.struct("rec_id", "title_en"), "rec_id").alias("z"))
    old, new = ends.select("paper_id", "a.*"), ends.where("a.rec_id <> z.rec_id").select("paper_id", "z.*")
    return register.upsert_records(old, new, "paper_id")


def paper_records(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d, "size", "chars", "text", "flow_index")
    out = register.paper_records(b, latest(spark, d, "zh").select("block_key", "zh"))
    return out.withColumns({c: F.array_join(c, "/") for c in ("keywords_en", "keywords_zh")})


def literature_index(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the index of the last record of every paper."""
    rows = table(spark, d, "literature").groupBy("paper_id").agg(F.max_by(F.struct("id", "title_zh", "title_en", "keywords_zh", "pages", "n_blocks", "n_table_cells", "translated_at", "rec_id"), "rec_id").alias("r")).select("r.*")
    return files.markdown_index(rows)


def paper_slugs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "literature").select("rec_id", "doi", "title_en").dropDuplicates(["rec_id"])
    return rows.select("rec_id", register.paper_slug(F.col("doi"), F.coalesce("title_en", F.lit(""))).alias("slug"))


def kb_harvest(spark: SparkSession, d: str) -> DataFrame:
    """Every knowledge base after harvesting all translated blocks."""
    rows = table(spark, d, "glossary").where(_USABLE).where("target <> ''")
    kb = rows.select("kb_id", "source", "target", "confidence", F.col("source_kind").alias("kind"), F.coalesce(F.get("papers", F.lit(0)), F.lit("")).alias("paper"), F.col("gid").alias("seq"))
    return register.harvested(kb, _pairs(spark, d), F.lit("now"))


def legacy_merge(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d, "size", "text", "heading", "bold", "math_only", "kind").where("x0 IS NOT NULL AND kind IS DISTINCT FROM 'table'")
    done = latest(spark, d, "zh").select("block_key", (F.coalesce("zh", F.lit("")) != "").alias("done"))
    out = register.merge_old_layout(b.join(done, "block_key", "left").withColumn("done", F.coalesce("done", F.lit(False))))
    return out.select("paper_id", "page", "head", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


def math_markup(spark: SparkSession, d: str) -> DataFrame:
    return blocks(spark, d, "text", "has_math").where("has_math").select("block_key", F.md5(markup.math_markup(F.col("text"))).alias("markup_md5"))


_O = "coalesce(flow_index, 1000000000)"
QUERIES = {"paper_records": paper_records, "literature_index": literature_index, "paper_guesses": paper_guesses, "title_blocks": title_blocks, "literature_upsert": literature_upsert, "paper_slugs": paper_slugs, "kb_harvest": kb_harvest, "legacy_merge": legacy_merge, "math_markup": math_markup}
_GUESSED = f"""f AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY size DESC NULLS LAST, chars DESC, block_key) AS t, row_number() OVER (PARTITION BY paper_id ORDER BY chars DESC, block_key) AS a FROM b WHERE page = 1),
 k AS (SELECT paper_id, block_key, row_number() OVER (PARTITION BY paper_id ORDER BY page, {_O}, block_key) AS n FROM b WHERE regexp_matches(text, '(?i)^{WS}*(?:keywords|index terms|key words){WS}*[:：]?{WS}*(.+)$')),
 gu AS (SELECT f.paper_id, max(CASE WHEN t = 1 THEN f.block_key END) AS title_block, max(CASE WHEN a = 1 AND chars > 200 THEN f.block_key END) AS abstract_block, max(k.block_key) AS keyword_block FROM f LEFT JOIN k ON k.paper_id = f.paper_id AND k.n = 1 GROUP BY 1)"""
ORACLES = {
    "paper_records": f"""WITH {BLOCKS}, {LATEST}, {_GUESSED}, x AS (SELECT b.block_key, b.text, coalesce(n.zh, '') AS zh FROM b LEFT JOIN n USING (block_key)), c AS (SELECT paper_id, max(page) AS pages, count(*) FILTER (n.zh <> '') AS n_blocks FROM b LEFT JOIN n USING (block_key, paper_id) GROUP BY 1)
 SELECT paper_id, coalesce(t.text, '') AS title_en, coalesce(t.zh, '') AS title_zh, left(coalesce(a.text, ''), 1500) AS abstract_en, left(coalesce(a.zh, ''), 1200) AS abstract_zh,
  CASE WHEN regexp_matches(w.text, '(?i)^{WS}*(?:keywords|index terms|key words){WS}*[:：]?{WS}*(.+)$') THEN array_to_string(list_transform(regexp_split_to_array(regexp_extract(w.text, '(?i)^{WS}*(?:keywords|index terms|key words){WS}*[:：]?{WS}*(.+)$', 1), '[;；,，、]|{WS}{{2,}}'), lambda x: trim(x, ' .;,')), '/') ELSE '' END AS keywords_en,
  CASE WHEN regexp_matches(w.zh, '^{WS}*(?:关键词|关键字){WS}*[:：]?{WS}*(.+)$') THEN array_to_string(list_transform(regexp_split_to_array(regexp_extract(w.zh, '^{WS}*(?:关键词|关键字){WS}*[:：]?{WS}*(.+)$', 1), '[;；,，、]|{WS}{{2,}}'), lambda x: trim(x, ' ;，、。')), '/') ELSE '' END AS keywords_zh, pages, n_blocks
 FROM gu LEFT JOIN x t ON t.block_key = title_block LEFT JOIN x a ON a.block_key = abstract_block LEFT JOIN x w ON w.block_key = keyword_block JOIN c USING (paper_id)""",
    "literature_index": r"""WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY rec_id DESC) AS n FROM literature) WHERE n = 1)
 SELECT '| ' || coalesce(strftime(translated_at, '%Y-%m-%d'), '') || ' | ' || left(replace(coalesce(nullif(title_zh, ''), nullif(title_en, ''), id, ''), '|', '\|'), 60) || ' | ' || replace(coalesce(array_to_string(keywords_zh[1:5], '、'), ''), '|', '\|')
  || ' | ' || coalesce(pages::VARCHAR, '') || ' | ' || coalesce(n_blocks::VARCHAR, '') || ' | ' || coalesce(n_table_cells::VARCHAR, '') || ' |' AS line FROM r""",
    "paper_guesses": f"""WITH {BLOCKS}, f AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY size DESC NULLS LAST, chars DESC, block_key) AS t, row_number() OVER (PARTITION BY paper_id ORDER BY chars DESC, block_key) AS a FROM b WHERE page = 1),
 k AS (SELECT paper_id, block_key, row_number() OVER (PARTITION BY paper_id ORDER BY page, {_O}, block_key) AS n FROM b WHERE regexp_matches(text, '(?i)^{WS}*(?:keywords|index terms|key words){WS}*[:：]?{WS}*(.+)$'))
 SELECT f.paper_id, max(CASE WHEN t = 1 THEN f.block_key END) AS title_block, max(CASE WHEN a = 1 AND chars > 200 THEN f.block_key END) AS abstract_block, max(k.block_key) AS keyword_block FROM f LEFT JOIN k ON k.paper_id = f.paper_id AND k.n = 1 GROUP BY 1""",
    "title_blocks": f"WITH {BLOCKS}, h AS (SELECT paper_id, left({sql_key('arg_min(text, block_key)')}, 40) AS t FROM b WHERE kind = 'heading' AND page = 1 GROUP BY 1) SELECT paper_id, min(block_key) AS block_key FROM b JOIN h USING (paper_id) WHERE page = 1 AND t <> '' AND contains({sql_key('text')}, t) GROUP BY 1",
    "literature_upsert": "WITH r AS (SELECT DISTINCT rec_id, paper_id, title_en FROM literature) SELECT paper_id, rec_id, title_en FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY rec_id DESC) AS n FROM r) WHERE n = 1",
    "paper_slugs": r"""WITH r AS (SELECT DISTINCT rec_id, doi, coalesce(title_en, '') AS title FROM literature), x AS (SELECT rec_id, title, regexp_extract(lower(coalesce(doi, '')), '(10\.\d{4,9}/\S+)', 1) AS d FROM r)
 SELECT rec_id, CASE WHEN d <> '' THEN trim(regexp_replace(d, '[^0-9a-z]+', '-', 'g'), '-') ELSE trim(left(regexp_replace(title, '[^0-9A-Za-z\x{4e00}-\x{9fff}]+', '-', 'g'), 60), '-') END AS slug FROM x""",
    "legacy_merge": rf"""WITH RECURSIVE {BLOCKS}, {LATEST}, v AS (SELECT b.*, coalesce(n.zh, '') <> '' AS done FROM b LEFT JOIN (SELECT block_key, zh FROM n) n USING (block_key) WHERE x0 IS NOT NULL AND kind IS DISTINCT FROM 'table'),
 x AS (SELECT paper_id, page, x0, row_number() OVER (PARTITION BY paper_id, page ORDER BY x0) AS n FROM (SELECT DISTINCT paper_id, page, x0 FROM v)),
 a AS (SELECT paper_id, page, x0, n, x0 AS anchor FROM x WHERE n = 1 UNION ALL SELECT x.paper_id, x.page, x.x0, x.n, CASE WHEN x.x0 - a.anchor <= 40 THEN a.anchor ELSE x.x0 END FROM a JOIN x ON x.paper_id = a.paper_id AND x.page = a.page AND x.n = a.n + 1),
 l AS (SELECT v.*, anchor, lag(v.x0) OVER w AS px, lag(y1) OVER w AS py, lag(x1) OVER w AS px1, lag(size) OVER w AS ps, lag(text) OVER w AS pt, lag(coalesce(heading, false) OR coalesce(bold, false) OR coalesce(math_only, false)) OVER w AS pst FROM v JOIN a USING (paper_id, page, x0) WINDOW w AS (PARTITION BY paper_id, page, anchor ORDER BY y0, block_key)),
 g AS (SELECT *, NOT coalesce(NOT (coalesce(heading, false) OR coalesce(bold, false) OR coalesce(math_only, false) OR pst) AND abs(size - ps) <= 0.6::DOUBLE AND least(x1 - x0, px1 - px) > 0 AND greatest(0, least(x1, px1) - greatest(x0, px)) > 0.5::DOUBLE * least(x1 - x0, px1 - px) AND y0 - py <= 0.6::DOUBLE * least(size, ps)
  AND NOT regexp_matches(regexp_replace(coalesce(text, ''), '^{WS}+', ''), '{register.STRUCTURE}') AND NOT (regexp_matches(regexp_replace(coalesce(pt, ''), '{WS}+$', ''), '[.!?;:]$') AND x0 - px > greatest(4.0::DOUBLE, 0.75::DOUBLE * least(size, ps))), false) AS fresh FROM l),
 r AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY paper_id, page, anchor ORDER BY y0, block_key ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER (PARTITION BY paper_id, page, anchor ORDER BY y0, block_key) AS o FROM g),
 z AS (SELECT *, row_number() OVER (PARTITION BY paper_id, page, anchor, run ORDER BY o) AS k FROM r)
 SELECT paper_id, page, min(CASE WHEN k = 1 THEN block_key END) AS head, string_agg(block_key::VARCHAR, ',' ORDER BY o) AS members FROM z GROUP BY paper_id, page, anchor, run HAVING count(*) > 1 AND NOT bool_or(done AND k > 1)""",
}
