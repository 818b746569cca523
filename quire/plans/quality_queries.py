"""Queries of quality checks, merges, the cell dictionary and prompt assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import page_numbers, page_set, selection_covers
from ..operators import layout, quality
from . import jobs, layout_queries
from .base import BLOCKS, ENTRIES, LATEST, WS, blocks, latest, sql_strip, table, translations
from .layout_queries import _F, _ROOTS

_KINDS = "kind IN ('body', 'heading', 'table_caption', 'figure_caption')"
#: Cells that need no translation (fixed value).
CELL_SKIP = r"^[\s\d.,%±+\-–—/()\[\]:;×xX*•·✓✗✔✘°<>≤≥≈=]+$"


def _expected(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that should be translated, with their last translation."""
    b = blocks(spark, d, "text", "kind").where(_KINDS).select("block_key", "text", "paper_id", "page")
    return b.join(latest(spark, d, "zh").select("block_key", "zh"), "block_key", "left")


def untranslated(spark: SparkSession, d: str) -> DataFrame:
    return quality.untranslated(_expected(spark, d))


def page_cjk(spark: SparkSession, d: str) -> DataFrame:
    """Pages by the share of Chinese characters of their translations; below a fifth is suspicious."""
    pages = _expected(spark, d).groupBy("paper_id", "page").agg(F.sum(F.length(F.coalesce("zh", F.lit("")))).alias("n"), F.sum(F.regexp_count(F.coalesce("zh", F.lit("")), F.lit(r"[\x{4e00}-\x{9fff}]"))).alias("k"))
    return pages.select("paper_id", "page", (F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(0.0) < 0.2).alias("suspicious"))


def glossary_landing(spark: SparkSession, d: str) -> DataFrame:
    terms = table(spark, d, "glossary").where("confidence >= 0.6D AND NOT isnan(confidence) AND target <> ''").select(F.col("gid").alias("_id"), "source", "target")
    return quality.landing(terms, _expected(spark, d).where("zh <> ''"))


def _cells(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Table blocks with what is rendered in their place (the translation, else the text), and the texts that have a translation anywhere."""
    now = latest(spark, d, "zh").select("block_key", "zh").where("zh <> ''")
    cells = blocks(spark, d, "text", "kind").where("kind = 'table'").join(now, "block_key", "left").select("paper_id", "text", F.coalesce("zh", "text").alias("rendered"))
    return cells, blocks(spark, d, "text").join(now, "block_key").select("text")


def qc_report(spark: SparkSession, d: str) -> DataFrame:
    terms = table(spark, d, "glossary").where("confidence >= 0.6D AND NOT isnan(confidence) AND target <> ''").select(F.col("gid").alias("_id"), "source", "target")
    return quality.report(_expected(spark, d), terms, *_cells(spark, d))


def qc_pages(spark: SparkSession, d: str) -> DataFrame:
    """Checks of both halves of every page: the texts of its blocks, a line each, and in the right half their translations where there are any."""
    now = latest(spark, d, "zh").select("block_key", "zh").where("zh <> ''")
    rows = blocks(spark, d, "text").join(now, "block_key", "left").withColumn("_right", F.coalesce("zh", "text"))
    lines = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_key", F.col(c).alias("t")))), lambda x: x["t"]), "\n")
    pages = rows.groupBy("paper_id", "page").agg(lines("text").alias("left"), lines("_right").alias("right"), (F.count("zh") > 0).alias("expected"), F.lit(False).alias("ignored"))
    return quality.page_checks(pages, "paper_id")


def _paper_checks(spark: SparkSession, d: str) -> DataFrame:
    columns = ["paper_id", "check_name", "level"]
    cells, dictionary = _cells(spark, d)
    parts = [qc_pages(spark, d), quality.text_checks(_expected(spark, d), ["paper_id"]), quality.cell_checks(cells, dictionary, ["paper_id"]), _shapes(spark, d)]
    out = parts[0].select(*columns)
    for part in parts[1:]:
        out = out.unionByName(part.select(*columns))
    return out


def qc_papers(spark: SparkSession, d: str) -> DataFrame:
    """Every paper's checks, counted by level, and its exit code."""
    return quality.exits(_paper_checks(spark, d), "paper_id")


def qc_summary(spark: SparkSession, d: str) -> DataFrame:
    return quality.summary(qc_report(spark, d))


def translation_merge(spark: SparkSession, d: str) -> DataFrame:
    return quality.merge_runs(translations(spark, d, "block_key", "zh", "run_no"))


def translation_counts(spark: SparkSession, d: str) -> DataFrame:
    """Entries by state and run."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    state = F.when(yes("skip"), "skip").when(yes("blank"), "blank").when(F.coalesce("zh", F.lit("")) != "", "zh").otherwise("other")
    return translations(spark, d, "zh", "skip", "blank", "run_no").groupBy("run_no", state.alias("state")).agg(F.count("*").alias("n_entries"))


def render_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Every entry against the last entry of its block as the rendered text."""
    now = latest(spark, d, "zh").select("block_key", F.col("zh").alias("rendered"))
    return quality.complete(translations(spark, d, "block_key", "zh"), now).groupBy("complete").agg(F.count("*").alias("n_entries"))


def cell_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Distinct texts of table blocks worth translating, by first appearance."""
    cells = blocks(spark, d, "text", "kind").where("kind = 'table'").where(~F.col("text").rlike(CELL_SKIP) & (F.length("text") >= 2))
    return cells.groupBy("text").agg(F.min("block_key").alias("first_block"), F.count("*").alias("n_cells"))


def cell_join(spark: SparkSession, d: str) -> DataFrame:
    """Blocks, table cells among them, with the translation their text has anywhere: equal texts share one."""
    known = blocks(spark, d, "text").join(latest(spark, d, "zh").where("zh <> ''"), "block_key").groupBy("text").agg(F.min_by("zh", "block_key").alias("zh"))
    return blocks(spark, d, "text").join(known, "text").select("block_key", "zh")


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """The items of a page's captions as a prompt's JSON, in order."""
    b = blocks(spark, d, "text", "kind").where("kind IN ('table_caption', 'figure_caption')")
    items = b.groupBy("paper_id", "page").agg(F.array_sort(F.collect_list(F.struct("block_key", "text"))).alias("i"))
    return items.select("paper_id", "page", F.size("i").alias("n_items"), F.md5(F.array_join(F.transform("i", lambda x: F.concat_ws("=", x["block_key"].cast("string"), x["text"])), "|")).alias("prompt_md5"))


def batch_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The items of every flow batch of translatable blocks as a prompt's JSON, in order."""
    rows = jobs.pending(blocks(spark, d, "text", "kind", "flow_index", "flow_break"), None)
    items = rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "text"))).alias("i"))
    return items.select("batch", F.size("i").alias("n_items"), F.md5(F.array_join(F.transform("i", lambda x: F.concat_ws("=", x["id"], x["text"])), "|")).alias("prompt_md5"))


#: Selectors that page_selections reads in every paper, the last two beyond what a selector may be.
SELECTORS = ("1,3-4", "all", "", " 2 , 7-9,2", "5-3", "3-", "x")


def page_selections(spark: SparkSession, d: str) -> DataFrame:
    """Pages chosen by each selector in every paper, from 0 and clipped, and from 1; and whether preparing pages 1 to 4 covers it."""
    papers = blocks(spark, d).groupBy("paper_id").agg(F.max("page").alias("n_pages"))
    rows = papers.select("paper_id", "n_pages", F.explode(F.array(*map(F.lit, SELECTORS))).alias("selector"))
    joined = lambda c: F.array_join(c.cast("array<string>"), ",")
    return rows.select(
        "paper_id", "selector", joined(page_numbers(F.col("selector"), F.col("n_pages"))).alias("chosen"), joined(page_set(F.col("selector"), F.col("n_pages"))).alias("pages"),
        selection_covers(F.lit("1-4"), F.col("selector")).alias("covered"),
    )


def _shapes(spark: SparkSession, d: str) -> DataFrame:
    """Every paper as delivered against its translated blocks, printed side by side."""
    def shape(rows: DataFrame, width: float) -> DataFrame:
        return rows.groupBy("paper_id").agg(F.count_distinct("page").alias("n_pages"), F.lit(width).alias("width"), F.count_if(F.col("kind") == "heading").alias("n_toc"), F.count_if(F.col("kind") == "figure_caption").alias("n_images"))

    b = blocks(spark, d, "kind")
    done = latest(spark, d, "zh").where("zh <> ''").select("block_key")
    return quality.document_checks(shape(b, 600.0), shape(b.join(done, "block_key", "left_semi"), 1200.0), "paper_id")


def document_checks(spark: SparkSession, d: str) -> DataFrame:
    return _shapes(spark, d).groupBy("check_name", "level").agg(F.count("*").alias("n_papers"))


def actionable_clusters(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d, "math_only").where("x0 IS NOT NULL")
    clusters = layout.cluster_boxes(b, layout.nested_roots(b, 0.5))
    outer = b.join(latest(spark, d, "zh").select("block_key", "zh"), "block_key", "left").select(F.col("block_key").alias("root"), "math_only", "zh")
    return layout.actionable(clusters, outer).select("root", "members")


_P = f"p AS (SELECT b.block_key, text, paper_id, page, n.zh FROM b LEFT JOIN (SELECT block_key, zh FROM n) n USING (block_key) WHERE {_KINDS})"
_ZH = sql_strip("coalesce(zh, '')")
_DENSE = f"regexp_replace(coalesce(zh, ''), '{WS}+', '', 'g')"
_UN = f"u AS (SELECT block_key, paper_id FROM (SELECT block_key, paper_id, {_DENSE} AS z FROM p) WHERE z = '' OR (len(regexp_extract_all(z, '[A-Za-z]')) >= 15 AND len(regexp_extract_all(z, '[A-Za-z]')) > 0.6::DOUBLE * length(z) AND NOT regexp_matches(z, '[\\x{{4e00}}-\\x{{9fff}}]')))"
_GAP = "[" + WS[1:-1].replace("\\", "\\\\") + "-]+"
_PAT = rf"'(^|[^a-z0-9])' || regexp_replace(regexp_replace(lower({sql_strip('source')}), '([\\.^$|?*+()\[\]{{}}])', '\\\1', 'g'), '{WS}+', '{_GAP}', 'g') || '([^a-z0-9]|$)'"
_LAND = rf"""g AS (SELECT gid, {_PAT} AS pat, regexp_replace(target, '{WS}+', '', 'g') AS tt FROM glossary WHERE confidence >= 0.6::DOUBLE AND NOT isnan(confidence) AND target <> ''),
 q AS (SELECT lower(text) AS x, regexp_replace(zh, '{WS}+', '', 'g') AS z FROM p WHERE zh <> ''), la AS (SELECT gid, EXISTS (SELECT 1 FROM q WHERE regexp_matches(x, pat)) AS app, tt <> '' AND EXISTS (SELECT 1 FROM q WHERE contains(z, tt)) AS lan FROM g),
 lc AS (SELECT count(*) FILTER (app) AS applicable, count(*) FILTER (app AND lan) AS landed FROM la)"""
_BASE = f"{BLOCKS}, {LATEST}, {_P}"
_BATCHES = layout_queries.ORACLES["flow_batches"]
_CELLS = r"""kt AS (SELECT DISTINCT b.text FROM b JOIN n USING (block_key) WHERE n.zh <> ''),
 ce AS (SELECT b.paper_id, kt.text IS NOT NULL AS known, coalesce(regexp_matches(coalesce(nullif(n.zh, ''), b.text), '[\x{4e00}-\x{9fff}]'), false) AS cn FROM b LEFT JOIN n USING (block_key) LEFT JOIN kt ON kt.text = b.text WHERE b.kind = 'table')"""
_PAGES = rf"""w AS (SELECT b.paper_id, b.page, b.block_key, b.text AS l, coalesce(nullif(n.zh, ''), b.text) AS r, coalesce(n.zh, '') <> '' AS tr FROM b LEFT JOIN n USING (block_key)),
 pg AS (SELECT paper_id, page, string_agg(l, chr(10) ORDER BY block_key) AS l, string_agg(r, chr(10) ORDER BY block_key) AS r, bool_or(tr) AS ex FROM w GROUP BY 1, 2),
 ln AS (SELECT *, list_filter(list_transform(regexp_split_to_array(coalesce(l, ''), '[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]+'), lambda x: {sql_strip('x')}), lambda x: length(x) > 15) AS ls,
  list_filter(list_transform(regexp_split_to_array(coalesce(r, ''), '[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]+'), lambda x: {sql_strip('x')}), lambda x: length(x) > 15) AS rs FROM pg),
 px AS (SELECT paper_id, count(*) AS n, count(*) FILTER (length(l) > 0 AND len(regexp_extract_all(l, '[\x{{4e00}}-\x{{9fff}}]')) > 0.02::DOUBLE * length(l)) AS le, count(*) FILTER (ex AND {sql_strip("coalesce(r, '')")} <> '' AND len(regexp_extract_all(r, '[\x{{4e00}}-\x{{9fff}}]')) < 0.2::DOUBLE * length(r)) AS ri,
  count(*) FILTER (ex AND {sql_strip("coalesce(r, '')")} = '') AS em, sum(len(list_filter(rs, lambda x: regexp_matches(x, '^[ -~]{{15,}}$') AND list_contains(list_transform(ls, lambda y: regexp_replace(y, '{WS}+', '', 'g')), regexp_replace(x, '{WS}+', '', 'g'))))) AS co FROM ln GROUP BY 1),
 pq AS (SELECT paper_id, 'left half unchanged' AS check_name, CASE WHEN le = 0 THEN 'PASS' ELSE 'WARN' END AS level, le::DOUBLE AS value, le || ' pages' AS detail FROM px
 UNION ALL SELECT paper_id, 'right half translated', CASE WHEN ri + em = 0 THEN 'PASS' WHEN ri + em > 0.3::DOUBLE * n THEN 'FAIL' ELSE 'WARN' END, (ri + em)::DOUBLE, ri || ' pages, ' || em || ' blank' FROM px
 UNION ALL SELECT paper_id, 'copied lines', CASE WHEN co = 0 THEN 'PASS' WHEN co < 10 THEN 'WARN' ELSE 'FAIL' END, co::DOUBLE, co::BIGINT || ' lines' FROM px)"""
_REPORT = rf"""WITH {_BASE}, {_UN}, {_LAND}, {_CELLS}, c AS (SELECT (SELECT count(*) FROM u) AS un, (SELECT CASE WHEN applicable > 0 THEN landed::DOUBLE / applicable ELSE 0 END FROM lc) AS rate, (SELECT landed || '/' || applicable FROM lc) AS lt,
  (SELECT coalesce(sum(len(regexp_extract_all(zh, '[\x{{f900}}-\x{{faff}}]'))), 0) FROM p) AS co, (SELECT coalesce(sum(len(regexp_extract_all(zh, '[\x{{4e00}}-\x{{9fff}}][ \x{{a0}}][\x{{4e00}}-\x{{9fff}}]'))), 0) FROM p) AS ga, (SELECT count(*) FILTER (known AND cn) FROM ce) AS k, (SELECT count(*) FILTER (known) FROM ce) AS n),
 r AS (SELECT 'untranslated blocks' AS check_name, CASE WHEN un = 0 THEN 'PASS' WHEN un < 10 THEN 'WARN' ELSE 'FAIL' END AS level, un::DOUBLE AS value, un || ' blocks' AS detail FROM c
 UNION ALL SELECT 'terms landed', CASE WHEN rate >= 0.8::DOUBLE THEN 'PASS' WHEN rate >= 0.6::DOUBLE THEN 'WARN' ELSE 'FAIL' END, rate, lt FROM c
 UNION ALL SELECT 'compatibility characters', CASE WHEN co = 0 THEN 'PASS' WHEN co < 21 THEN 'WARN' ELSE 'FAIL' END, co::DOUBLE, co || ' found' FROM c
 UNION ALL SELECT 'blanks between characters', CASE WHEN ga < 50 THEN 'PASS' WHEN ga < 400 THEN 'WARN' ELSE 'FAIL' END, ga::DOUBLE, ga || ' found' FROM c
 UNION ALL SELECT 'table cells', CASE WHEN n = 0 THEN 'INFO' WHEN k::DOUBLE / n >= 0.95::DOUBLE THEN 'PASS' WHEN k::DOUBLE / n >= 0.8::DOUBLE THEN 'WARN' ELSE 'FAIL' END, CASE WHEN n = 0 THEN 0 ELSE k::DOUBLE / n END, k || '/' || n FROM c)"""
QUERIES = {
    "untranslated": untranslated, "page_cjk": page_cjk, "glossary_landing": glossary_landing, "qc_report": qc_report, "qc_pages": qc_pages, "qc_papers": qc_papers, "qc_summary": qc_summary, "translation_merge": translation_merge, "translation_counts": translation_counts,
    "render_completeness": render_completeness, "cell_dictionary": cell_dictionary, "cell_join": cell_join, "prompts": prompts, "batch_prompts": batch_prompts, "page_selections": page_selections,
    "document_checks": document_checks, "actionable_clusters": actionable_clusters,
}
_SHAPES = """o AS (SELECT paper_id, count(DISTINCT page) AS p, count(*) FILTER (kind = 'heading') AS t, count(*) FILTER (kind = 'figure_caption') AS i FROM b GROUP BY 1),
 r AS (SELECT paper_id, count(DISTINCT page) AS p, count(*) FILTER (kind = 'heading') AS t, count(*) FILTER (kind = 'figure_caption') AS i FROM b WHERE block_key IN (SELECT block_key FROM n WHERE zh <> '') GROUP BY 1),
 dc AS (SELECT o.paper_id, coalesce(o.p = r.p, false) AS p, r.p IS NOT NULL AS w, coalesce(o.t = r.t, false) AS t, coalesce(r.i >= o.i, false) AS i FROM o LEFT JOIN r USING (paper_id)),
 sh AS (SELECT paper_id, 'pages' AS check_name, CASE WHEN p THEN 'PASS' ELSE 'FAIL' END AS level FROM dc UNION ALL SELECT paper_id, 'width', CASE WHEN w THEN 'PASS' ELSE 'FAIL' END FROM dc UNION ALL SELECT paper_id, 'contents', CASE WHEN t THEN 'PASS' ELSE 'WARN' END FROM dc UNION ALL SELECT paper_id, 'images', CASE WHEN i THEN 'PASS' ELSE 'WARN' END FROM dc)"""
_PAPERS = rf"""WITH {_BASE}, {_UN}, {_CELLS}, {_PAGES}, {_SHAPES}, tc AS (SELECT p.paper_id, (SELECT count(*) FROM u WHERE u.paper_id = p.paper_id) AS un, coalesce(sum(len(regexp_extract_all(zh, '[\x{{f900}}-\x{{faff}}]'))), 0) AS co,
  coalesce(sum(len(regexp_extract_all(zh, '[\x{{4e00}}-\x{{9fff}}][ \x{{a0}}][\x{{4e00}}-\x{{9fff}}]'))), 0) AS ga FROM p GROUP BY 1),
 cx AS (SELECT paper_id, count(*) FILTER (known AND cn) AS k, count(*) FILTER (known) AS n FROM ce GROUP BY 1),
 al AS (SELECT paper_id, level FROM pq UNION ALL SELECT paper_id, level FROM sh UNION ALL SELECT paper_id, CASE WHEN un = 0 THEN 'PASS' WHEN un < 10 THEN 'WARN' ELSE 'FAIL' END FROM tc
 UNION ALL SELECT paper_id, CASE WHEN co = 0 THEN 'PASS' WHEN co < 21 THEN 'WARN' ELSE 'FAIL' END FROM tc UNION ALL SELECT paper_id, CASE WHEN ga < 50 THEN 'PASS' WHEN ga < 400 THEN 'WARN' ELSE 'FAIL' END FROM tc
 UNION ALL SELECT paper_id, CASE WHEN n = 0 THEN 'INFO' WHEN k::DOUBLE / n >= 0.95::DOUBLE THEN 'PASS' WHEN k::DOUBLE / n >= 0.8::DOUBLE THEN 'WARN' ELSE 'FAIL' END FROM cx)
 SELECT paper_id, count(*) FILTER (level = 'PASS') AS n_pass, count(*) FILTER (level = 'WARN') AS n_warn, count(*) FILTER (level = 'FAIL') AS n_fail, max((level = 'FAIL')::INT) AS exit_code FROM al GROUP BY 1"""
ORACLES = {
    "document_checks": f"WITH {BLOCKS}, {LATEST}, {_SHAPES} SELECT check_name, level, count(*) AS n_papers FROM sh GROUP BY 1, 2",
    "qc_pages": f"WITH {BLOCKS}, {LATEST}, {_PAGES} SELECT * FROM pq",
    "qc_papers": _PAPERS,
    "actionable_clusters": f"{_ROOTS}, {LATEST}, m AS (SELECT root, block_key FROM roots UNION SELECT root, root FROM roots), k AS (SELECT root, count(*) AS members FROM m GROUP BY 1) SELECT root, members FROM k JOIN v ON v.block_key = k.root LEFT JOIN (SELECT block_key, zh FROM n) n ON n.block_key = k.root WHERE NOT coalesce(v.math_only, false) OR coalesce(n.zh, '') <> ''",
    "untranslated": f"WITH {_BASE}, {_UN} SELECT block_key FROM u",
    "page_cjk": rf"WITH {_BASE} SELECT paper_id, page, CASE WHEN sum(length(coalesce(zh, ''))) > 0 THEN sum(len(regexp_extract_all(coalesce(zh, ''), '[\x{{4e00}}-\x{{9fff}}]')))::DOUBLE / sum(length(coalesce(zh, ''))) ELSE 0 END < 0.2::DOUBLE AS suspicious FROM p GROUP BY 1, 2",
    "glossary_landing": f"WITH {_BASE}, {_LAND} SELECT applicable, landed FROM lc",
    "qc_report": f"{_REPORT} SELECT * FROM r",
    "qc_summary": f"{_REPORT} SELECT level, count(*) AS n_checks, level = 'FAIL' AS failed FROM r GROUP BY 1",
    "translation_merge": f"WITH {ENTRIES}, w AS (SELECT block_key, zh, lag(zh) OVER v AS before, row_number() OVER v AS n FROM t WINDOW v AS (PARTITION BY block_key ORDER BY run_no NULLS FIRST, entry_id)) SELECT block_key, (arg_max({{'z': zh}}, n)).z AS zh, count(*) AS n_runs, count(*) FILTER (n > 1 AND zh IS DISTINCT FROM before) AS overwritten FROM w GROUP BY 1",
    "translation_counts": f"WITH {ENTRIES} SELECT run_no, CASE WHEN coalesce(skip, false) THEN 'skip' WHEN coalesce(blank, false) THEN 'blank' WHEN coalesce(zh, '') <> '' THEN 'zh' ELSE 'other' END AS state, count(*) AS n_entries FROM t GROUP BY 1, 2",
    "render_completeness": f"""WITH {ENTRIES}, {LATEST}, x AS (SELECT regexp_replace(t.zh, '{WS}+', '', 'g') AS z, regexp_replace(coalesce(n.zh, ''), '{WS}+', '', 'g') AS r FROM t LEFT JOIN n USING (block_key)),
 y AS (SELECT *, regexp_replace(z, '[_^]', '', 'g') AS q FROM x WHERE length(z) > 0) SELECT (contains(r, left(z, 18)) AND contains(r, right(z, 18))) OR (contains(r, left(q, 18)) AND contains(r, right(q, 18))) AS complete, count(*) AS n_entries FROM y GROUP BY 1""",
    "cell_dictionary": f"WITH {BLOCKS} SELECT text, min(block_key) AS first_block, count(*) AS n_cells FROM b WHERE kind = 'table' AND NOT regexp_matches(text, '{CELL_SKIP}') AND length(text) >= 2 GROUP BY 1",
    "cell_join": f"WITH {BLOCKS}, {LATEST}, k AS (SELECT text, arg_min(n.zh, b.block_key) AS zh FROM b JOIN n USING (block_key) WHERE n.zh <> '' GROUP BY 1) SELECT block_key, k.zh FROM b JOIN k USING (text)",
    "prompts": f"WITH {BLOCKS} SELECT paper_id, page, count(*)::INT AS n_items, md5(string_agg(block_key || '=' || text, '|' ORDER BY block_key)) AS prompt_md5 FROM b WHERE kind IN ('table_caption', 'figure_caption') GROUP BY 1, 2",
    "batch_prompts": f"WITH {BLOCKS}, q AS ({_BATCHES}) SELECT concat_ws('.', q.paper_id, q.run, q.batch) AS batch, count(*)::INT AS n_items, md5(string_agg(q.block_key || '=' || text, '|' ORDER BY page, {_F}, q.block_key)) AS prompt_md5 FROM q JOIN b USING (block_key) GROUP BY q.paper_id, q.run, q.batch",
    "page_selections": f"""WITH {BLOCKS}, m AS (SELECT paper_id, max(page) AS n FROM b GROUP BY 1),
 s(selector, listed) AS (VALUES ('1,3-4', [1, 3, 4]), ('all', NULL), ('', NULL), (' 2 , 7-9,2', [2, 7, 8, 9]), ('5-3', []), ('3-', NULL), ('x', NULL)),
 p AS (SELECT paper_id, selector, n, CASE WHEN selector IN ('', 'all') THEN range(1, n + 1) ELSE listed END AS l FROM m, s)
 SELECT paper_id, selector, array_to_string(list_transform(list_filter(l, lambda x: x <= n), lambda x: x - 1), ',') AS chosen, array_to_string(l, ',') AS pages, selector IN ('1,3-4', '5-3') AS covered FROM p""",
}
