"""Queries of table, figure and style operators, and of the translation stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tables, translate
from ..operators.layout import PAGE_HEIGHT, PAGE_WIDTH
from . import jobs, layout_queries
from .base import BLOCKS, blocks, table
from .text_queries import reflowed_sql as reflowed


def _rules(spark: SparkSession, d: str) -> DataFrame:
    """Upper and lower edges of table blocks as ruling lines."""
    b = blocks(spark, d, "kind").where("kind = 'table' AND x0 IS NOT NULL")
    return b.select("paper_id", "page", F.explode(F.array("y0", "y1")).alias("y"), "x0", "x1").distinct()


def _captions(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d, "kind").where("kind = 'table_caption' AND x0 IS NOT NULL")
    return b.select("paper_id", "page", F.col("block_key").alias("caption"), *[F.col(c).alias("c" + c) for c in ("x0", "y0", "x1", "y1")])


def caption_owner(spark: SparkSession, d: str) -> DataFrame:
    return tables.captions_of_rules(_rules(spark, d), _captions(spark, d), PAGE_WIDTH / 2)


def rule_clusters(spark: SparkSession, d: str) -> DataFrame:
    rules, captions = _rules(spark, d), _captions(spark, d)
    return tables.table_groups(rules, tables.captions_of_rules(rules, captions, PAGE_WIDTH / 2), captions)


def object_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions around captions, tables and formulas of a page, and which of them divide it."""
    b = blocks(spark, d, "kind").where("kind IN ('table', 'math_only', 'figure_caption') AND x0 IS NOT NULL")
    regions = tables.figure_regions(b)
    wide = tables.wide_barriers(regions, PAGE_WIDTH, PAGE_HEIGHT).withColumn("divides", F.lit(True))
    return regions.join(wide, ["paper_id", "page", "x0", "y0", "x1", "y1"], "left").withColumn("divides", F.coalesce("divides", F.lit(False)))


def _words(spark: SparkSession, d: str) -> DataFrame:
    """Words with boxes: an order is a table, a line item a word."""
    x, y = F.col("l_partkey") % 50 * 10.0, F.col("l_linenumber") / 2.0 * 4.0 + (F.col("l_suppkey") % 5) * 0.5
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("word"), x.alias("x0"), y.alias("y0"), (x + 8.0).alias("x1"), (y + 1.0).alias("y1"))


def word_rows(spark: SparkSession, d: str) -> DataFrame:
    return tables.word_rows(_words(spark, d), ["l_orderkey"])


def row_cells(spark: SparkSession, d: str) -> DataFrame:
    return tables.row_cells(_words(spark, d), ["l_orderkey"], 40.0).select("l_orderkey", "word", "cell")


def line_runs(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of a page's column taken as the lines of one text."""
    lines = blocks(spark, d, "text", "size", "col").where("x0 IS NOT NULL AND text IS NOT NULL").withColumn("line", F.col("block_key"))
    return tables.line_runs(lines, ["paper_id", "page", "col"]).select("block_key", "run")


def table_bands(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of a page's column taken as the lines of one text, cut at the edges of the page's tables."""
    b = blocks(spark, d, "kind", "col").where("x0 IS NOT NULL")
    box = b.groupBy("paper_id", "page", "col").agg(F.min("x0").alias("bx0"), F.min("y0").alias("by0"), F.max("x1").alias("bx1"), F.max("y1").alias("by1"))
    lines = b.join(box, ["paper_id", "page", "col"]).withColumn("line", F.col("block_key"))
    regions = b.where("kind = 'table'").select("paper_id", "page", *[F.col(c).alias("r" + c) for c in ("x0", "y0", "x1", "y1")])
    return tables.table_bands(lines, regions, ["paper_id", "page", "col"]).select("block_key", "band")


def dominant_style(spark: SparkSession, d: str) -> DataFrame:
    return tables.dominant_style(blocks(spark, d, "size", "font", "bold", "chars"), ["paper_id"])


def translate_stub(spark: SparkSession, d: str) -> DataFrame:
    """The translation stage over all captions, a batch per page, with the stand-in translator."""
    b = blocks(spark, d, "text", "kind").where("kind IN ('table_caption', 'figure_caption')")
    batches = b.select(F.concat_ws(".", "paper_id", "page").alias("batch"), F.col("block_key").cast("string").alias("id"), "text", F.col("block_key").alias("pos"))
    return translate.translate(batches, translate.reverse_words).select(F.col("id").cast("bigint").alias("block_key"), "zh")


def translate_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The translation stage over all translatable blocks in flow batches, with the stand-in translator."""
    batches = jobs.pending(blocks(spark, d, "text", "kind", "flow_index", "flow_break"), None)
    return translate.translate(batches, translate.reverse_words).select(F.col("id").cast("bigint").alias("block_key"), "zh")


def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    """What the translation stage used over all translatable blocks."""
    batches = jobs.pending(blocks(spark, d, "text", "kind", "flow_index", "flow_break"), None)
    return translate.usage(translate.answered(batches, translate.reverse_words))


_LINES = f"{BLOCKS}, r AS (SELECT DISTINCT paper_id, page, unnest([y0, y1]) AS y, x0, x1 FROM b WHERE kind = 'table' AND x0 IS NOT NULL), c AS (SELECT paper_id, page, block_key AS caption, x0 AS cx0, y0 AS cy0, x1 AS cx1, y1 AS cy1 FROM b WHERE kind = 'table_caption' AND x0 IS NOT NULL)"
_REVERSED = reflowed("array_to_string(list_reverse(string_split(text, ' ')), ' ')")
_WORDS = "w AS (SELECT l_orderkey, l_linenumber AS word, (l_partkey % 50) * 10.0::DOUBLE AS x0, (l_partkey % 50) * 10.0::DOUBLE + 8 AS x1, l_linenumber / 2.0::DOUBLE * 4 + (l_suppkey % 5) * 0.5::DOUBLE + 0.5::DOUBLE AS c FROM lineitem)"
QUERIES = {
    "caption_owner": caption_owner, "rule_clusters": rule_clusters, "object_regions": object_regions, "word_rows": word_rows, "row_cells": row_cells, "line_runs": line_runs, "table_bands": table_bands,
    "dominant_style": dominant_style, "translate_stub": translate_stub, "translate_blocks": translate_blocks, "usage_totals": usage_totals,
}
ORACLES = {
    "caption_owner": f"""WITH {_LINES}, p AS (SELECT r.*, caption, cy0, (cx0 + cx1) / 2 AS cx, (r.x0 + r.x1) / 2 AS rx FROM r JOIN c USING (paper_id, page) WHERE cy1 <= y + 2 AND (greatest(0, least(r.x1, cx1) - greatest(r.x0, cx0)) / greatest(1e-6::DOUBLE, least(r.x1 - r.x0, cx1 - cx0)) >= 0.2::DOUBLE OR ((cx0 + cx1) / 2 < 300) = ((r.x0 + r.x1) / 2 < 300))),
 q AS (SELECT *, max(cy0) OVER (PARTITION BY paper_id, page, y, x0, x1) AS low FROM p), s AS (SELECT *, row_number() OVER (PARTITION BY paper_id, page, y, x0, x1 ORDER BY ((cx < 300) = (rx < 300)) DESC, abs(rx - cx), caption) AS n FROM q WHERE cy0 >= low - 8)
 SELECT paper_id, page, y, x0, x1, caption FROM s WHERE n = 1""",
    "word_rows": f"""WITH RECURSIVE {_WORDS}, o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY c, x0, word) AS n FROM w),
 f AS (SELECT l_orderkey, word, n, 0 AS row, c AS mean, 1 AS k FROM o WHERE n = 1 UNION ALL SELECT o.l_orderkey, o.word, o.n, CASE WHEN abs(o.c - f.mean) <= 3.2::DOUBLE THEN f.row ELSE f.row + 1 END, CASE WHEN abs(o.c - f.mean) <= 3.2::DOUBLE THEN (f.mean * f.k + o.c) / (f.k + 1) ELSE o.c END, CASE WHEN abs(o.c - f.mean) <= 3.2::DOUBLE THEN f.k + 1 ELSE 1 END
  FROM f JOIN o ON o.l_orderkey = f.l_orderkey AND o.n = f.n + 1) SELECT l_orderkey, word, row FROM f""",
    "row_cells": f"WITH {_WORDS}, g AS (SELECT *, coalesce(x0 - lag(x1) OVER v > 40, false)::INT AS o FROM w WINDOW v AS (PARTITION BY l_orderkey ORDER BY x0, word)) SELECT l_orderkey, word, sum(o) OVER (PARTITION BY l_orderkey ORDER BY x0, word ROWS UNBOUNDED PRECEDING)::INT AS cell FROM g",
    "line_runs": rf"""WITH {BLOCKS}, l AS (SELECT *, lag(size) OVER v AS ps, lag(y1) OVER v AS py, lag(x0) OVER v AS px, lag(text) OVER v AS pt FROM b WHERE x0 IS NOT NULL AND text IS NOT NULL WINDOW v AS (PARTITION BY paper_id, page, col ORDER BY y0, x0, block_key)),
 o AS (SELECT *, coalesce(abs(ps - size) > 1 OR y0 - py > 1.1::DOUBLE * greatest(5.0::DOUBLE, least(ps, size)) OR (pt IS NOT NULL AND regexp_matches(ltrim(text), '^(?:\d{{1,2}}[.)、]|[a-zA-Z][.)、]|[-•·▪–]\s)')) OR (x0 - px >= greatest(7.0::DOUBLE, 0.7::DOUBLE * least(ps, size)) AND regexp_matches(rtrim(pt), '[.!?;:。！？；：]$')), false)::INT AS op FROM l)
 SELECT block_key, sum(op) OVER (PARTITION BY paper_id, page, col ORDER BY y0, x0, block_key ROWS UNBOUNDED PRECEDING)::INT AS run FROM o""",
    "table_bands": f"""WITH {BLOCKS}, v AS (SELECT * FROM b WHERE x0 IS NOT NULL), g AS (SELECT paper_id, page, col, min(x0) AS bx0, min(y0) AS by0, max(x1) AS bx1, max(y1) AS by1 FROM v GROUP BY 1, 2, 3),
 e AS (SELECT DISTINCT g.paper_id, g.page, g.col, unnest([t.y0, t.y1]) AS e FROM g JOIN v t ON t.kind = 'table' AND t.paper_id = g.paper_id AND t.page = g.page AND greatest(0, least(bx1, t.x1) - greatest(bx0, t.x0)) / greatest(1e-6::DOUBLE, least(bx1 - bx0, t.x1 - t.x0)) >= 0.25::DOUBLE)
 SELECT block_key, (SELECT count(*) FROM e WHERE e.paper_id = v.paper_id AND e.page = v.page AND e.col = v.col AND e.e > g.by0 AND e.e < g.by1 AND (v.y0 + v.y1) / 2 >= e.e)::INT AS band FROM v JOIN g ON g.paper_id = v.paper_id AND g.page = v.page AND g.col = v.col""",
    "dominant_style": f"""WITH {BLOCKS}, s AS (SELECT paper_id, size, row_number() OVER (PARTITION BY paper_id ORDER BY sum(chars) DESC, size) AS n FROM b GROUP BY 1, 2), f AS (SELECT paper_id, font, row_number() OVER (PARTITION BY paper_id ORDER BY sum(chars) DESC, font) AS n FROM b WHERE font IS NOT NULL GROUP BY 1, 2),
 h AS (SELECT paper_id, sum(CASE WHEN coalesce(bold, false) THEN chars ELSE 0 END)::DOUBLE / sum(chars) AS bold_share FROM b GROUP BY 1) SELECT s.paper_id, s.size, f.font, h.bold_share FROM s LEFT JOIN (SELECT * FROM f WHERE n = 1) f USING (paper_id) JOIN h USING (paper_id) WHERE s.n = 1""",
    "translate_blocks": f"WITH {BLOCKS} SELECT block_key, {_REVERSED} AS zh FROM b WHERE coalesce(kind, '') NOT IN ('table', 'meta', 'math_only')",
    "translate_stub": f"WITH {BLOCKS} SELECT block_key, {_REVERSED} AS zh FROM b WHERE kind IN ('table_caption', 'figure_caption')",
    "usage_totals": f"""WITH {BLOCKS}, i AS (SELECT * FROM b WHERE coalesce(kind, '') NOT IN ('table', 'meta', 'math_only'))
        SELECT 'sent' AS name, sum(length(text))::DOUBLE AS total FROM i UNION ALL SELECT 'received', sum(greatest(1, length(text)))::DOUBLE FROM i UNION ALL SELECT 'calls', count(*)::DOUBLE FROM (SELECT DISTINCT paper_id, run, batch FROM ({layout_queries.ORACLES["flow_batches"]}))""",
}
