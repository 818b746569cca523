"""Queries of layout, order and planning operators over blocks and translations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, identity
from ..functions.text import page_set, strip
from ..operators import flow, layout, planning, tables
from .base import BLOCKS, LATEST, WS, blocks, latest, sql_clean, sql_collapse, sql_strip

RATIO = 0.5
BUDGET = 4000


def reading_order(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d, "col", "kind").where("x0 IS NOT NULL")
    return layout.reading_order(b).select("block_key", "position", "breaks")


def page_continuation(spark: SparkSession, d: str) -> DataFrame:
    return layout.page_continuations(blocks(spark, d, "kind", "text", "flow_index", "flow_break"))


def _barriers(spark: SparkSession, d: str) -> DataFrame:
    """What divides a page without being read: the region of its tables, and that of its formulas as a drawing."""
    b = blocks(spark, d, "kind").where("kind IN ('table', 'math_only') AND x0 IS NOT NULL").withColumn("kind", F.when(F.col("kind") == "table", "table").otherwise("vector"))
    objects = b.groupBy("paper_id", "page", "kind").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).withColumn("n", (F.col("kind") != "table").cast("int"))
    return tables.layout_barriers(objects, layout.PAGE_WIDTH, layout.PAGE_HEIGHT)


def page_barriers(spark: SparkSession, d: str) -> DataFrame:
    return _barriers(spark, d)


def barred_order(spark: SparkSession, d: str) -> DataFrame:
    """The reading order of what isn't a barrier itself, in the zones between barriers."""
    b = blocks(spark, d, "col", "kind").where("x0 IS NOT NULL AND coalesce(kind, '') NOT IN ('table', 'math_only')")
    return layout.reading_order(b, _barriers(spark, d)).select("block_key", "position", "breaks")


def barred_continuation(spark: SparkSession, d: str) -> DataFrame:
    """Page continuations of what isn't a barrier itself, with no barrier between."""
    b = blocks(spark, d, "kind", "text", "flow_index", "flow_break").where("coalesce(kind, '') NOT IN ('table', 'math_only')")
    return layout.page_continuations(b, _barriers(spark, d))


def merged_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    out = layout.merge_paragraphs(blocks(spark, d, "kind", "col", "size", "text").where("x0 IS NOT NULL"))
    return out.select("paper_id", "page", "col", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"), F.md5("text").alias("text_md5"), "x0", "y0", "x1", "y1")


def nested_roots(spark: SparkSession, d: str) -> DataFrame:
    return layout.nested_roots(blocks(spark, d).where("x0 IS NOT NULL"), RATIO)


def nested_boxes(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d).where("x0 IS NOT NULL")
    return layout.cluster_boxes(b, layout.nested_roots(b, RATIO)).select("paper_id", "page", "root", "members", "x0", "y0", "x1", "y1")


def _regions(b: DataFrame) -> DataFrame:
    """The box around all table blocks of a page."""
    return b.where("kind = 'table'").groupBy("paper_id", "page").agg(F.min("x0").alias("rx0"), F.min("y0").alias("ry0"), F.max("x1").alias("rx1"), F.max("y1").alias("ry1"))


def in_table(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d, "kind").where("x0 IS NOT NULL")
    return layout.in_regions(b.where("kind IS DISTINCT FROM 'table'"), _regions(b), 0.5, strict=True)


def heading_like(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d, "text", "kind")
    return b.groupBy("kind", planning.heading_like(strip(F.col("text"))).alias("heading_like")).agg(F.count("*").alias("n_blocks"))


def front_matter(spark: SparkSession, d: str) -> DataFrame:
    return planning.front_matter(blocks(spark, d, "text"))


def _reasons(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d, "text", "kind", "math_only", "has_math", "flow_index")
    boxed = b.where("x0 IS NOT NULL")
    inside = layout.in_regions(boxed.where("kind IS DISTINCT FROM 'table'"), _regions(boxed), 0.5, strict=True)
    return planning.skip_reasons(b, layout.PAGE_HEIGHT, inside, planning.front_matter(b))


#: Pages that flagged_reasons skips.
SKIP_PAGES = "2,5-6"


def flagged_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The reasons with all that a caller may know: the second block of each page is forced, nested blocks are fragments, pages whose text is wider than
    high are landscape, and SKIP_PAGES are skipped."""
    b = blocks(spark, d, "block_id", "text", "kind", "math_only", "has_math", "flow_index")
    boxed = b.where("x0 IS NOT NULL")
    inside = layout.in_regions(boxed.where("kind IS DISTINCT FROM 'table'"), _regions(boxed), 0.5, strict=True)
    nested = layout.nested_roots(boxed, RATIO).select("block_key", F.lit(True).alias("nested"))
    extent = boxed.groupBy("paper_id", "page").agg((F.max("x1") - F.min("x0")).alias("_w"), (F.max("y1") - F.min("y0")).alias("_h")).select("paper_id", "page", geometry.landscape(F.col("_w"), F.col("_h")).alias("landscape"))
    flags = b.join(nested, "block_key", "left").join(extent, ["paper_id", "page"], "left").withColumn("forced", F.col("block_id").rlike("b1$")).withColumn("skip_page", F.array_contains(page_set(F.lit(SKIP_PAGES), F.lit(0)), F.col("page")))
    return planning.skip_reasons(flags, layout.PAGE_HEIGHT, inside, planning.front_matter(b)).groupBy(F.coalesce("reason", F.lit("translate")).alias("reason")).agg(F.count("*").alias("n_blocks"))


def inline_sources(spark: SparkSession, d: str) -> DataFrame:
    """What is sent for translation of every block with nested blocks: its text with them, in markers, at their height; and its identities."""
    b = blocks(spark, d, "text", "kind", "col", "math_only", "has_math").where("x0 IS NOT NULL")
    roots = layout.nested_roots(b, RATIO).select("block_key", "root")
    outer = b.select(F.col("block_key").alias("root"), F.col("text").alias("_t"), F.col("y0").alias("_y0"), F.col("y1").alias("_y1"))
    rows = b.join(roots, "block_key").join(outer, "root")
    inside = (F.col("y0") >= F.col("_y0")) & (F.col("y0") <= F.col("_y1"))
    at = F.when(inside, F.floor(F.length("_t") * (F.col("y0") - F.col("_y0")) / F.greatest(F.lit(1.0), F.col("_y1") - F.col("_y0"))).cast("int"))
    item = F.struct(F.col("block_key").cast("string").alias("id"), "page", F.array("x0", "y0", "x1", "y1").alias("bbox"), "text", "kind", "math_only", "has_math", at.alias("anchor_offset"))
    held = rows.groupBy("root").agg(F.collect_list(item).alias("_f")).select(F.col("root").alias("block_key"), identity.fragment_specs(F.col("_f")).alias("_s"))
    source = identity.translation_source(F.col("text"), F.col("_s"))
    named = b.join(held, "block_key").withColumn("source", source)
    hash_, uid = identity.block_identity(F.col("page"), F.col("col"), [F.col(c) for c in ("x0", "y0", "x1", "y1")], F.col("text"), F.col("_s"))
    return named.select("block_key", F.size("_s").alias("n_markers"), F.md5("source").alias("source_md5"), hash_.alias("source_hash"), uid.alias("layout_uid"))


def skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _reasons(spark, d).groupBy(F.coalesce("reason", F.lit("translate")).alias("reason")).agg(F.count("*").alias("n_blocks"))


def resume_status(spark: SparkSession, d: str) -> DataFrame:
    return planning.resume_status(latest(spark, d, "source_hash", "layout_uid"), blocks(spark, d, "source_hash", "layout_uid"))


def identity_mismatch(spark: SparkSession, d: str) -> DataFrame:
    return planning.identity_mismatches(latest(spark, d, "source_hash", "layout_uid", "absorbed_into"), blocks(spark, d, "source_hash", "layout_uid"))


def greedy_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of 1,500 characters per page."""
    b = blocks(spark, d, "text").withColumn("_cost", F.length("text") + 40)
    return flow.greedy_batches(b, ["paper_id", "page"], ["block_key"], F.col("_cost"), 1500)


def _pending(spark: SparkSession, d: str) -> DataFrame:
    """Blocks without a finished translation, with their position among all blocks."""
    done = latest(spark, d, "zh").where("zh <> ''").select("block_key")
    return planning.positions(blocks(spark, d, "text", "kind", "flow_index", "flow_break")).join(done, "block_key", "left_anti")


def missing_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of consecutive blocks without translation."""
    of = planning.runs(_pending(spark, d), F.lit(False))
    return of.groupBy("paper_id", F.col("run").alias("first_position")).agg(F.count("*").alias("n_blocks"))


def flow_batches(spark: SparkSession, d: str) -> DataFrame:
    items = planning.positions(blocks(spark, d, "text", "kind", "flow_index", "flow_break")).where("coalesce(kind, '') NOT IN ('table', 'meta', 'math_only')")
    breaks = F.coalesce("flow_break", F.lit(False)) | F.coalesce(F.col("kind").isin(*layout.STRUCTURAL), F.lit(False))
    return planning.flow_batches(items, breaks, BUDGET).select("paper_id", "block_key", "run", "batch")


def batch_context(spark: SparkSession, d: str) -> DataFrame:
    return planning.contexts(blocks(spark, d, "flow_index", "flow_break", "kind").where("kind = 'body'").drop("kind"))


def indent_plan(spark: SparkSession, d: str) -> DataFrame:
    """Indents of the translated blocks; continuation flags come from the page continuations."""
    b = blocks(spark, d, "heading", "bold", "flow_index", "kind", "text", "flow_break")
    zh = latest(spark, d, "zh").where(strip(F.col("zh")) != "").select("block_key", "zh")
    runs_on = layout.page_continuations(b).select(F.col("first_key").alias("block_key"), F.lit(True).alias("continues"))
    return planning.indents(b.join(zh, "block_key").join(runs_on, "block_key", "left"))


_F = "coalesce(flow_index, 1000000000)"
_TERMINAL = "[.!?;:。！？；：]$"
_SHARED = "greatest(0, least(p.x1, c.x1) - greatest(p.x0, c.x0)) * greatest(0, least(p.y1, c.y1) - greatest(p.y0, c.y0))"
_AREA = "(greatest(0, {0}.x1 - {0}.x0) * greatest(0, {0}.y1 - {0}.y0))"
_ROOTS = f"""WITH RECURSIVE {BLOCKS}, v AS (SELECT * FROM b WHERE x0 IS NOT NULL),
 links AS (SELECT c.paper_id, c.page, c.block_key, arg_max(p.block_key, {{'a': {_AREA.format('p')}, 'k': -p.block_key}}) AS parent FROM v c JOIN v p USING (paper_id, page)
   WHERE {_SHARED} > {RATIO} * least({_AREA.format('p')}, {_AREA.format('c')}) AND {_AREA.format('c')} < {_AREA.format('p')} GROUP BY 1, 2, 3),
 up AS (SELECT paper_id, page, block_key, parent AS root, 1 AS level FROM links UNION ALL SELECT u.paper_id, u.page, u.block_key, l.parent, u.level + 1 FROM up u JOIN links l ON l.block_key = u.root),
 roots AS (SELECT paper_id, page, block_key, arg_max(root, level) AS root, max(level) AS level FROM up GROUP BY 1, 2, 3)"""
_JOINED_HYPHEN, _JOINED_BLANK = sql_clean("left(q.ta, length(q.ta) - 1) || q.tb"), sql_clean(sql_strip("q.ta || ' ' || q.tb"))
_MERGE = rf"""WITH RECURSIVE {BLOCKS}, o AS (SELECT *, row_number() OVER (PARTITION BY paper_id, page, col ORDER BY y0, x0, block_key) AS n FROM b WHERE x0 IS NOT NULL AND col IN ('left', 'right')),
 f AS (SELECT paper_id, page, col, n, kind, size, x0, y0, x1, y1, regexp_replace(coalesce(text, ''), '{WS}+$', '') AS tail, block_key::VARCHAR AS members, 0 AS g, text AS txt FROM o WHERE n = 1
  UNION ALL
  SELECT q.paper_id, q.page, q.col, q.n, CASE WHEN q.fits THEN q.akind ELSE q.kind END, CASE WHEN q.fits THEN q.asize ELSE q.size END, CASE WHEN q.fits THEN least(q.ax0, q.x0) ELSE q.x0 END, CASE WHEN q.fits THEN least(q.ay0, q.y0) ELSE q.y0 END,
   CASE WHEN q.fits THEN greatest(q.ax1, q.x1) ELSE q.x1 END, CASE WHEN q.fits THEN greatest(q.ay1, q.y1) ELSE q.y1 END, regexp_replace(coalesce(q.text, ''), '{WS}+$', ''), CASE WHEN q.fits THEN q.amembers || ',' || q.block_key ELSE q.block_key::VARCHAR END, CASE WHEN q.fits THEN q.g ELSE q.g + 1 END,
   CASE WHEN NOT q.fits THEN q.text WHEN ends_with(q.ta, '-') AND regexp_matches(q.tb, '^\p{{Ll}}') THEN {_JOINED_HYPHEN} ELSE {_JOINED_BLANK} END
  FROM (SELECT z.*, coalesce(z.akind = 'body' AND z.kind = 'body' AND abs(z.asize - z.size) <= 1.0::DOUBLE AND z.ov >= 0.28::DOUBLE AND z.gap >= -0.35::DOUBLE * z.s AND z.gap <= 1.25::DOUBLE * z.s AND NOT z.listed AND NOT (z.ind >= 8 AND z.ended)
    AND (z.gap <= 0.48::DOUBLE * z.s OR (z.tail <> '' AND NOT z.ended) OR z.low OR (z.gap <= 0.72::DOUBLE * z.s AND abs(z.ind) <= 4)), false) AS fits
   FROM (SELECT o.*, a.kind AS akind, a.size AS asize, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, a.members AS amembers, a.g AS g, a.tail AS tail, regexp_replace(a.txt, '{WS}+$', '') AS ta, regexp_replace(o.text, '^{WS}+', '') AS tb, o.y0 - a.y1 AS gap, greatest(5.0::DOUBLE, least(a.size, o.size)) AS s, o.x0 - a.x0 AS ind,
     greatest(0, least(a.x1, o.x1) - greatest(a.x0, o.x0)) / greatest(1e-6::DOUBLE, least(a.x1 - a.x0, o.x1 - o.x0)) AS ov, regexp_matches(a.tail, '{_TERMINAL}') AS ended,
     regexp_matches(regexp_replace(o.text, '^{WS}+', ''), '^{WS}*(?:\d{{1,2}}[.)、]|[a-zA-Z][.)、]|[-•·▪–]{WS})') AS listed, regexp_matches(regexp_replace(o.text, '^{WS}+', ''), '^[a-z]') AS low
     FROM f a JOIN o ON o.paper_id = a.paper_id AND o.page = a.page AND o.col = a.col AND o.n = a.n + 1) z) q)
 SELECT paper_id, page, col, members, md5(txt) AS text_md5, x0, y0, x1, y1 FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, page, col, g ORDER BY n DESC) AS r FROM f) WHERE r = 1"""
_INSIDE = "EXISTS (SELECT 1 FROM (SELECT paper_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM b WHERE kind = 'table' AND x0 IS NOT NULL GROUP BY 1, 2) r WHERE r.paper_id = b.paper_id AND r.page = b.page AND greatest(0, least(b.x1, r.x1) - greatest(b.x0, r.x0)) * greatest(0, least(b.y1, r.y1) - greatest(b.y0, r.y0)) / greatest(1e-6::DOUBLE, (b.x1 - b.x0) * (b.y1 - b.y0)) > 0.5::DOUBLE)"
_P = {k: getattr(planning, k).replace("'", "''") for k in ("PAGE_NUMBER", "META", "EMAIL", "AFFILIATION", "REFERENCE_HEADING", "CORRESPONDING", "JOURNAL", "CAPTION", "LABEL", "LABEL_WORD", "ANCHOR", "SENTENCE_END", "HEADING_NUMBER", "HEADING_CHARS")}


def _re(column: str, name: str) -> str:
    return f"regexp_matches({column}, '{_P[name]}')"


_HEADLIKE = f"({_re('tt', 'HEADING_NUMBER')} OR ({_re('tt', 'HEADING_CHARS')} AND (ws >= 2 OR (ws = 1 AND length(tt) >= 12))))"
_TT = sql_strip("coalesce(text, '')")


def _words(column: str) -> str:
    return f"len(list_filter(regexp_split_to_array({column}, '{WS}+'), lambda x: length(x) >= 3))"


_FRONT = f"""fm AS (SELECT *, {_TT} AS tt FROM b WHERE page = 1 AND y0 IS NOT NULL), mk AS (SELECT paper_id, arg_min(y0, block_key) FILTER ({_re('tt', 'ANCHOR')}) AS ay, min(block_key) AS title FROM fm GROUP BY 1),
 front AS (SELECT block_key FROM fm JOIN mk USING (paper_id) WHERE ay IS NOT NULL AND y0 < ay AND block_key <> title AND NOT {_re('tt', 'CAPTION')} AND NOT {_re('tt', 'LABEL_WORD')})"""
_SYM = rf"""CASE WHEN length(regexp_replace(tt, '{WS}+', '', 'g')) > 0 THEN len(regexp_extract_all(regexp_replace(tt, '{WS}+', '', 'g'), '[^\p{{L}}\p{{N}}.,;:''"()%\-–—+/]'))::DOUBLE / length(regexp_replace(tt, '{WS}+', '', 'g')) ELSE 0 END"""
_SKIP = f"""WITH {BLOCKS}, {_FRONT}, ins AS (SELECT block_key FROM b WHERE x0 IS NOT NULL AND kind IS DISTINCT FROM 'table' AND {_INSIDE}),
 w AS (SELECT *, {_words('tt')} AS ws FROM (SELECT *, {_TT} AS tt FROM b)),
 e AS (SELECT *, {_HEADLIKE} AS hl, CASE WHEN tt = '' THEN 'empty' WHEN block_key IN (SELECT block_key FROM front) THEN 'front matter' WHEN kind = 'table' THEN 'table' WHEN kind = 'meta' THEN 'meta' WHEN coalesce(math_only, false) OR kind = 'math_only' THEN 'math' END AS early FROM w),
 l AS (SELECT *, early IS NULL AND {_re('tt', 'REFERENCE_HEADING')} AS rh FROM e),
 m AS (SELECT *, coalesce(max(rh::INT) OVER (PARTITION BY paper_id ORDER BY page, {_F}, block_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS latch FROM l),
 z AS (SELECT CASE WHEN early IS NOT NULL THEN early WHEN latch THEN 'references' WHEN rh THEN 'reference heading' WHEN block_key IN (SELECT block_key FROM ins) THEN 'in table'
  WHEN length(tt) < 90 AND (y0 < 0.062::DOUBLE * 1000 OR y0 > 0.94::DOUBLE * 1000) THEN 'header or footer' WHEN {_re('tt', 'PAGE_NUMBER')} THEN 'page number' WHEN {_re('tt', 'EMAIL')} THEN 'e-mail'
  WHEN length(tt) < 130 AND {_re('tt', 'META')} THEN 'publisher' WHEN length(tt) < 80 AND {_re('tt', 'JOURNAL')} THEN 'journal' WHEN length(tt) < 120 AND {_re('tt', 'CORRESPONDING')} THEN 'correspondence'
  WHEN length(tt) < 300 AND {_re('tt', 'AFFILIATION')} AND NOT {_re('tt', 'SENTENCE_END')} THEN 'affiliation' WHEN coalesce(has_math, false) AND length(tt) < 100 AND NOT hl THEN 'formula fragment'
  WHEN length(tt) < 50 AND NOT ({_re('tt', 'CAPTION')} OR {_re('tt', 'LABEL')} OR {_re('tt', 'LABEL_WORD')} OR hl) AND NOT {_re('tt', 'SENTENCE_END')} THEN 'fragment' WHEN length(tt) >= 3 AND {_SYM} > 0.45::DOUBLE THEN 'symbols' ELSE 'translate' END AS reason FROM m)
 SELECT reason, count(*) AS n_blocks FROM z GROUP BY 1"""
_FLAGGED = (
    _SKIP.replace(f"WITH {BLOCKS}", _ROOTS).replace("w AS (SELECT *, ", "ext AS (SELECT paper_id, page, max(x1) - min(x0) > max(y1) - min(y0) AS wide FROM v GROUP BY 1, 2),\n w AS (SELECT *, ", 1)
    .replace("CASE WHEN tt = '' THEN 'empty' WHEN block_key IN (SELECT block_key FROM front)", """CASE WHEN regexp_matches(block_id, 'b1$') THEN 'forced' WHEN tt = '' THEN 'empty'
   WHEN EXISTS (SELECT 1 FROM ext WHERE ext.paper_id = w.paper_id AND ext.page = w.page AND wide) THEN 'landscape page' WHEN block_key IN (SELECT block_key FROM front)""")
    .replace("WHEN kind = 'table' THEN 'table' WHEN kind = 'meta'", "WHEN block_key IN (SELECT block_key FROM roots) THEN 'nested' WHEN kind = 'table' THEN 'table' WHEN kind = 'meta'")
    .replace("CASE WHEN early IS NOT NULL THEN early", "CASE WHEN early = 'forced' THEN 'translate' WHEN early IS NOT NULL THEN early").replace("THEN 'reference heading' WHEN", "THEN 'reference heading' WHEN page IN (2, 5, 6) THEN 'skipped page' WHEN")
)
_HALF = "printf('%.1f', round_even({} * 2, 0) / 2)"
_INLINE = rf"""{_ROOTS}, f AS (SELECT r.root, c.block_key AS k, c.page, c.x0, c.y0, c.text AS raw, {sql_strip('c.text')} AS t, c.kind, o.page AS opage, {sql_strip("coalesce(o.text, '')")} AS src,
  CASE WHEN c.y0 BETWEEN o.y0 AND o.y1 THEN floor(length(o.text) * (c.y0 - o.y0) / greatest(1.0::DOUBLE, o.y1 - o.y0))::INT END AS a, {_HALF.format('c.x0')} || ',' || {_HALF.format('c.y0')} || ',' || {_HALF.format('c.x1')} || ',' || {_HALF.format('c.y1')} AS box
  FROM roots r JOIN v c ON c.block_key = r.block_key JOIN v o ON o.block_key = r.root WHERE coalesce(c.text, '') <> ''),
 g AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY a NULLS LAST, y0, x0, k::VARCHAR) - 1 AS n FROM f),
 h AS (SELECT *, n || '_' || substr(sha256(page || chr(0) || box || chr(0) || raw || chr(0) || coalesce(kind, '')), 1, 8) AS tag, CASE WHEN a IS NOT NULL THEN greatest(0, least(length(src), a)) END AS po FROM g),
 i AS (SELECT *, '[[Q_INLINE_' || tag || ']]' || t || '[[/Q_INLINE_' || tag || ']]' AS m, coalesce(lag(po) OVER (PARTITION BY root ORDER BY n), 0) AS before FROM h),
 j AS (SELECT *, CASE WHEN a IS NOT NULL THEN substr(src, before + 1, po - before) || CASE WHEN po > 0 AND NOT regexp_matches(substr(src, po, 1), '{WS}') AND NOT contains('([{{（【', substr(src, po, 1)) THEN ' ' ELSE '' END || m
   || CASE WHEN po < length(src) AND NOT regexp_matches(substr(src, po + 1, 1), '{WS}') AND NOT contains(',.;:!?)]}}，。；：！？）】', substr(src, po + 1, 1)) THEN ' ' ELSE '' END END AS piece FROM i),
 s AS (SELECT root, count(*)::INT AS n_markers, coalesce(string_agg(piece, '' ORDER BY n) FILTER (a IS NOT NULL), '') || substr(any_value(src), coalesce(max(po), 0) + 1) || coalesce(chr(10) || string_agg(m, chr(10) ORDER BY n) FILTER (a IS NULL), '') AS source FROM j GROUP BY 1)
 SELECT root AS block_key, n_markers, md5(source) AS source_md5, substr(sha256(page::VARCHAR || chr(0) || {sql_collapse('source')}), 1, 24) AS source_hash,
  substr(sha256(page::VARCHAR || chr(0) || coalesce(nullif(col, ''), '?') || chr(0) || {_HALF.format('x0')} || ',' || {_HALF.format('y0')} || ',' || {_HALF.format('x1')} || ',' || {_HALF.format('y1')} || chr(0) || {sql_collapse('source')}), 1, 24) AS layout_uid FROM s JOIN v ON v.block_key = s.root"""
_CONT = rf"""p AS (SELECT paper_id, page, arg_max({{'k': block_key, 'kind': kind, 'text': text, 'fb': flow_break}}, {{'f': {_F}, 'k': block_key}}) AS l, arg_min({{'k': block_key, 'kind': kind, 'text': text, 'fb': flow_break}}, {{'f': {_F}, 'k': block_key}}) AS f FROM b WHERE coalesce(kind, '') <> 'meta' GROUP BY 1, 2),
 cont AS (SELECT a.paper_id, a.page, a.l.k AS last_key, c.f.k AS first_key FROM p a JOIN p c ON c.paper_id = a.paper_id AND c.page = a.page + 1 WHERE a.l.kind = 'body' AND c.f.kind = 'body' AND NOT coalesce(c.f.fb, false)
  AND ((regexp_replace(coalesce(a.l.text, ''), '{WS}+$', '') <> '' AND NOT regexp_matches(regexp_replace(coalesce(a.l.text, ''), '{WS}+$', ''), '{_TERMINAL}')) OR regexp_matches(regexp_replace(coalesce(c.f.text, ''), '^{WS}+', ''), '^[a-z]')))"""
_POS = f"pos AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY page, {_F}, block_key) - 1 AS position FROM b)"
_BR = "(coalesce(flow_break, false) OR coalesce(kind IN ('heading', 'table', 'table_caption', 'figure_caption'), false))"
_IND = {k: getattr(planning, k) for k in ("INDENT_LIST", "INDENT_CAPTION", "INDENT_END")}
QUERIES = {
    "page_barriers": page_barriers, "barred_order": barred_order, "barred_continuation": barred_continuation,
    "reading_order": reading_order, "page_continuation": page_continuation, "merged_paragraphs": merged_paragraphs, "nested_roots": nested_roots, "nested_boxes": nested_boxes, "in_table_blocks": in_table,
    "heading_like": heading_like, "front_matter": front_matter, "skip_reasons": skip_reasons, "flagged_reasons": flagged_reasons, "inline_sources": inline_sources, "resume_status": resume_status, "identity_mismatch": identity_mismatch, "greedy_batches": greedy_batches,
    "missing_runs": missing_runs, "flow_batches": flow_batches, "batch_context": batch_context, "indent_plan": indent_plan,
}
_BARS = """ob AS (SELECT paper_id, page, CASE WHEN kind = 'table' THEN 'table' ELSE 'vector' END AS kind, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM b WHERE kind IN ('table', 'math_only') AND x0 IS NOT NULL GROUP BY 1, 2, 3),
 ba AS (SELECT paper_id, page, kind, round(x0, 2) AS x0, round(y0, 2) AS y0, round(x1, 2) AS x1, round(y1, 2) AS y1 FROM ob WHERE x1 - x0 >= 0.55::DOUBLE * 600 AND y1 - y0 >= 10 AND (x1 - x0) * (y1 - y0) / 600000.0::DOUBLE <= 0.72::DOUBLE)"""
ORACLES = {
    "page_barriers": f"WITH {BLOCKS}, {_BARS} SELECT * FROM ba",
    "reading_order": f"""WITH {BLOCKS}, v AS (SELECT * FROM b WHERE x0 IS NOT NULL), bar AS (SELECT paper_id, page, block_key AS bk, y0 AS t, y1 AS u, row_number() OVER (PARTITION BY paper_id, page ORDER BY y0, y1, block_key) - 1 AS zone FROM v WHERE col = 'full'),
 z AS (SELECT paper_id, page, zone, coalesce(max(u) OVER (PARTITION BY paper_id, page ORDER BY zone ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e9) AS top, t AS bottom FROM bar UNION ALL SELECT paper_id, page, count(*), max(u), 1e9 FROM bar GROUP BY 1, 2),
 q AS (SELECT v.*, coalesce(bar.zone, z.zone, CASE WHEN NOT EXISTS (SELECT 1 FROM bar e WHERE e.paper_id = v.paper_id AND e.page = v.page) THEN 0 END, 1000000) AS zz, CASE WHEN col = 'left' THEN 0 ELSE 1 END AS side
  FROM v LEFT JOIN bar ON bar.bk = v.block_key LEFT JOIN z ON z.paper_id = v.paper_id AND z.page = v.page AND v.col <> 'full' AND (v.y0 + v.y1) / 2 >= z.top AND (v.y0 + v.y1) / 2 < z.bottom),
 r AS (SELECT *, row_number() OVER (PARTITION BY paper_id, page ORDER BY zz, (col = 'full')::INT, CASE WHEN zz = 1000000 THEN y0 ELSE side END, CASE WHEN zz = 1000000 THEN side ELSE y0 END, x0, block_key) - 1 AS position FROM q),
 s AS (SELECT *, row_number() OVER (PARTITION BY paper_id, page, zz, col = 'full' ORDER BY position) AS n FROM r)
 SELECT block_key, position::INT AS position, col = 'full' OR (n = 1 AND zz > 0 AND zz < 1000000 AND position > 0) OR coalesce(kind IN ('heading', 'table', 'table_caption', 'figure_caption'), false) AS breaks FROM s""",
    "page_continuation": f"WITH {BLOCKS}, {_CONT} SELECT paper_id, page, last_key, first_key FROM cont",
    "merged_paragraphs": _MERGE,
    "nested_roots": f"{_ROOTS} SELECT * FROM roots",
    "nested_boxes": f"{_ROOTS}, m AS (SELECT root, block_key FROM roots UNION SELECT root, root FROM roots) SELECT v.paper_id, v.page, root, count(*) AS members, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM m JOIN v USING (block_key) GROUP BY 1, 2, 3",
    "in_table_blocks": f"WITH {BLOCKS} SELECT block_key FROM b WHERE x0 IS NOT NULL AND kind IS DISTINCT FROM 'table' AND {_INSIDE}",
    "heading_like": f"WITH {BLOCKS}, w AS (SELECT kind, tt, {_words('tt')} AS ws FROM (SELECT kind, {sql_strip('text')} AS tt FROM b)) SELECT kind, {_HEADLIKE} AS heading_like, count(*) AS n_blocks FROM w GROUP BY 1, 2",
    "front_matter": f"WITH {BLOCKS}, {_FRONT} SELECT block_key FROM front",
    "skip_reasons": _SKIP,
    "flagged_reasons": _FLAGGED,
    "inline_sources": _INLINE,
    "resume_status": f"""WITH {BLOCKS}, {LATEST} SELECT n.block_key, CASE WHEN b.block_key IS NULL THEN 'orphan' WHEN b.source_hash IS NULL OR b.layout_uid IS NULL THEN 'unverifiable' WHEN n.source_hash IS NULL THEN 'legacy' WHEN n.source_hash <> b.source_hash THEN 'stale'
 WHEN n.layout_uid IS NULL THEN 'legacy' WHEN n.layout_uid <> b.layout_uid THEN 'layout_stale' ELSE 'valid' END AS status FROM n LEFT JOIN b USING (block_key)""",
    "identity_mismatch": f"""WITH {BLOCKS}, {LATEST}, j AS (SELECT n.source_hash h, n.layout_uid u, b.source_hash ch, b.layout_uid cu FROM n JOIN b USING (block_key) WHERE absorbed_into IS NULL),
 x AS (SELECT 'source_hash' AS field, h AS o, ch AS c FROM j UNION ALL SELECT 'layout_uid', u, cu FROM j) SELECT field, count(*) FILTER (o <> c) AS mismatched, count(*) FILTER (o IS NULL OR c IS NULL) AS unverified FROM x GROUP BY 1""",
    "greedy_batches": f"""WITH RECURSIVE {BLOCKS}, o AS (SELECT paper_id, page, block_key, length(text) + 40 AS cost, row_number() OVER (PARTITION BY paper_id, page ORDER BY block_key) AS n FROM b),
 f AS (SELECT paper_id, page, block_key, n, cost AS used, 0::BIGINT AS batch FROM o WHERE n = 1 UNION ALL SELECT o.paper_id, o.page, o.block_key, o.n, CASE WHEN f.used + o.cost > 1500 THEN o.cost ELSE f.used + o.cost END, CASE WHEN f.used + o.cost > 1500 THEN f.batch + 1 ELSE f.batch END FROM f JOIN o ON o.paper_id = f.paper_id AND o.page = f.page AND o.n = f.n + 1)
 SELECT paper_id, page, block_key, batch FROM f""",
    "missing_runs": f"""WITH {BLOCKS}, {LATEST}, {_POS}, m AS (SELECT paper_id, position, position - row_number() OVER (PARTITION BY paper_id ORDER BY position) AS g FROM pos WHERE block_key NOT IN (SELECT block_key FROM n WHERE zh <> ''))
 SELECT paper_id, min(position) AS first_position, count(*) AS n_blocks FROM m GROUP BY paper_id, g""",
    "flow_batches": f"""WITH RECURSIVE {BLOCKS}, {_POS}, i AS (SELECT *, {_BR} AS br FROM pos WHERE coalesce(kind, '') NOT IN ('table', 'meta', 'math_only')),
 j AS (SELECT *, coalesce(position <> lag(position) OVER w + 1 OR br OR lag(br) OVER w, true) AS opens FROM i WINDOW w AS (PARTITION BY paper_id ORDER BY position)),
 k AS (SELECT paper_id, block_key, position, length(text) + 40 AS cost, max(CASE WHEN opens THEN position END) OVER (PARTITION BY paper_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS run FROM j),
 o AS (SELECT *, row_number() OVER (PARTITION BY paper_id, run ORDER BY position) AS n FROM k),
 f AS (SELECT paper_id, run, block_key, n, cost AS used, 0::BIGINT AS batch FROM o WHERE n = 1 UNION ALL SELECT o.paper_id, o.run, o.block_key, o.n, CASE WHEN f.used + o.cost > {BUDGET} THEN o.cost ELSE f.used + o.cost END, CASE WHEN f.used + o.cost > {BUDGET} THEN f.batch + 1 ELSE f.batch END FROM f JOIN o ON o.paper_id = f.paper_id AND o.run = f.run AND o.n = f.n + 1)
 SELECT paper_id, block_key, run, batch FROM f""",
    "batch_context": f"""WITH {BLOCKS}, x AS (SELECT block_key, flow_break, lag(block_key) OVER w AS p, lead(block_key) OVER w AS q, lead(flow_break) OVER w AS qb FROM b WHERE kind = 'body' WINDOW w AS (PARTITION BY paper_id ORDER BY page, {_F}, block_key))
 SELECT block_key, CASE WHEN NOT coalesce(flow_break, false) THEN p END AS before, CASE WHEN NOT coalesce(qb, false) THEN q END AS after FROM x""",
    "indent_plan": f"""WITH {BLOCKS}, {LATEST}, {_CONT}, j AS (SELECT b.*, n.zh, coalesce(b.heading, false) OR coalesce(b.bold, false) AS head, b.block_key IN (SELECT first_key FROM cont) AS runs_on FROM b JOIN n USING (block_key) WHERE {sql_strip('n.zh')} <> ''),
 k AS (SELECT *, lag(CASE WHEN head THEN false ELSE NOT regexp_matches(regexp_replace(zh, '{WS}+$', ''), '{_IND['INDENT_END']}') END) OVER (PARTITION BY paper_id ORDER BY page, {_F}, block_key) AS op FROM j)
 SELECT block_key, NOT head AND length(zh) >= 30 AND NOT regexp_matches(zh, '{_IND['INDENT_LIST']}') AND NOT regexp_matches(zh, '{_IND['INDENT_CAPTION']}') AND NOT coalesce(op, false) AND NOT runs_on AS indented FROM k""",
}

_ORDER = ORACLES["reading_order"]
ORACLES["barred_order"] = (
    _ORDER.replace(" WHERE x0 IS NOT NULL)", " WHERE x0 IS NOT NULL AND coalesce(kind, '') NOT IN ('table', 'math_only')), " + _BARS, 1)
    .replace("bar AS (SELECT paper_id, page, block_key AS bk, y0 AS t, y1 AS u, row_number() OVER (PARTITION BY paper_id, page ORDER BY y0, y1, block_key) - 1 AS zone FROM v WHERE col = 'full')",
             "bar AS (SELECT *, row_number() OVER (PARTITION BY paper_id, page ORDER BY t, u, bk NULLS LAST) - 1 AS zone FROM (SELECT paper_id, page, block_key AS bk, y0 AS t, y1 AS u FROM v WHERE col = 'full' UNION ALL SELECT paper_id, page, NULL, y0, y1 FROM ba))")
)
ORACLES["barred_continuation"] = (
    f"WITH {BLOCKS}, {_BARS}, lim AS (SELECT paper_id, page, max(y0) AS lowest, min(y1) AS highest FROM ba GROUP BY 1, 2), " + _CONT.replace("WHERE coalesce(kind, '') <> 'meta'", "WHERE coalesce(kind, '') NOT IN ('meta', 'table', 'math_only')")
    + """ SELECT cont.paper_id, cont.page, last_key, first_key FROM cont JOIN b l ON l.block_key = last_key JOIN b f ON f.block_key = first_key LEFT JOIN lim a ON a.paper_id = cont.paper_id AND a.page = cont.page
 LEFT JOIN lim c ON c.paper_id = cont.paper_id AND c.page = cont.page + 1 WHERE coalesce(a.lowest < coalesce(l.y1, 0) - 1, true) AND coalesce(c.highest > coalesce(f.y0, 0) + 1, true)"""
)
