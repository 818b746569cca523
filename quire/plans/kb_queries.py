"""Queries of terminology operators over the glossary, blocks and translations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_key
from ..operators import terminology as K
from ..sources import files
from .base import BLOCKS, LATEST, WS, blocks, latest, sql_key, sql_strip, table
from .text_queries import NOISE_WORDS, STOP_WORDS

_USABLE = "confidence IS NOT NULL AND NOT isnan(confidence) AND confidence BETWEEN 0 AND 1"


def kb_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The glossary's rows as evidence, in order of arrival."""
    rows = table(spark, d, "glossary").where(_USABLE)
    evidence = rows.select("kb_id", "source", "target", "confidence", F.col("source_kind").alias("kind"), F.coalesce(F.get("papers", F.lit(0)), F.lit("")).alias("paper"), F.col("gid").alias("seq"))
    return K.upsert(evidence)


def kb_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "glossary").groupBy(F.coalesce("source_kind", F.lit("?")).alias("source_kind")).agg(
        F.count("*").alias("n_terms"), F.count_if(F.coalesce("hits", F.lit(0)) >= 2).alias("n_confirmed"), F.count_if(F.coalesce(F.size("target_alt"), F.lit(0)) > 0).alias("n_with_alternatives")
    )


def literature_stats(spark: SparkSession, d: str) -> DataFrame:
    """The last record of every paper, summed per domain."""
    rows = table(spark, d, "literature").groupBy("paper_id").agg(F.max_by(F.struct("domain", "n_blocks", "n_table_cells"), "rec_id").alias("r"))
    return rows.groupBy(F.coalesce("r.domain", F.lit("?")).alias("domain")).agg(F.count("*").alias("n_papers"), F.sum("r.n_blocks").cast("bigint").alias("n_blocks"), F.sum("r.n_table_cells").cast("bigint").alias("n_cells"))


def kb_lookup(spark: SparkSession, d: str) -> DataFrame:
    return K.lookup(table(spark, d, "glossary").where(_USABLE), "planner").select("gid", "source", "target", "confidence")


def kb_export(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the export for prompts: domain and "source = target" of the terms sure enough."""
    rows = table(spark, d, "glossary").where(_USABLE).where("confidence >= 0.6D AND target <> ''")
    return rows.select("gid", F.coalesce(F.nullif("domain", F.lit("")), F.lit("general")).alias("domain"), F.concat(F.lit("- "), F.col("source"), F.lit(" = "), F.col("target")).alias("line"))


def kb_exports(spark: SparkSession, d: str) -> DataFrame:
    """Every line of all three exports of the usable terms, with its place."""
    terms = table(spark, d, "glossary").where(_USABLE).withColumn("n", F.col("gid"))
    forms = [files.exported(terms, form).withColumn("form", F.lit(form)) for form in ("csv", "markdown", "prompt")]
    return forms[0].unionByName(forms[1]).unionByName(forms[2])


def glossary_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return K.deduplicate(table(spark, d, "glossary"), ["gid"])


def glossary_merge(spark: SparkSession, d: str) -> DataFrame:
    """All knowledge bases in order of their number; later ones overwrite."""
    out = K.deduplicate(table(spark, d, "glossary"), ["kb_id", "gid"])
    return out.select("term", "target", F.col("first.kb_id").alias("first_kb"), F.col("first.gid").alias("first_gid"))


def glossary_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return K.conflicts(table(spark, d, "glossary"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return blocks(spark, d, "text").select("block_key", "text").join(latest(spark, d, "zh").where("zh <> ''").select("block_key", "zh"), "block_key")


def acronym_pairs(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "glossary").select(normalize_key(F.col("source")).alias("term")).distinct()
    return K.acronym_pairs(_pairs(spark, d), known)


def keyword_pairs(spark: SparkSession, d: str) -> DataFrame:
    return K.keyword_pairs(_pairs(spark, d))


def term_confirm(spark: SparkSession, d: str) -> DataFrame:
    terms = table(spark, d, "glossary").select(F.col("gid").alias("_id"), "source", "target")
    return K.confirmations(terms, _pairs(spark, d)).select(F.col("_id").alias("gid"), "first_block")


def glossary_audit(spark: SparkSession, d: str) -> DataFrame:
    terms = table(spark, d, "glossary").select(F.col("gid").alias("_id"), "source", "target")
    zh = latest(spark, d, "zh").where("zh <> ''").select("block_key", "zh")
    return K.audit(terms, blocks(spark, d, "text").select("block_key", "text"), zh).select(F.col("_id").alias("gid"), "n_blocks", "first_block")


def glossary_audit_top(spark: SparkSession, d: str) -> DataFrame:
    """The forty terms with the most affected blocks."""
    return glossary_audit(spark, d).orderBy(F.col("n_blocks").desc(), "gid").limit(40)


_OK = rf"length(s) >= 2 AND length(t) >= 2 AND regexp_matches(s, '[A-Za-z]') AND regexp_matches(t, '[\x{{4e00}}-\x{{9fff}}]') AND NOT (lower(s) || '/' || t IN ('et al/等人', 'fig/图', 'table/表', 'eq/式'))"
_PAIRS = f"{BLOCKS}, {LATEST}, p AS (SELECT block_key, b.text, n.zh FROM b JOIN n USING (block_key) WHERE n.zh <> '')"
_GAP = "[" + WS[1:-1].replace("\\", "\\\\") + "-]+"
_MISS = rf"""m AS (SELECT gid, source, regexp_replace(target, '{WS}+', '', 'g') AS tt FROM glossary WHERE regexp_replace(coalesce(target, ''), '{WS}+', '', 'g') <> ''),
 z AS (SELECT block_key, text, regexp_replace(zh, '{WS}+', '', 'g') AS zz FROM p), un AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM z WHERE contains(zz, tt))),
 h AS (SELECT gid, block_key FROM un JOIN z ON regexp_matches(lower(text), '(^|[^a-z0-9])' || regexp_replace(regexp_replace(lower({sql_strip('source')}), '([\\.^$|?*+()\[\]{{}}])', '\\\1', 'g'), '{WS}+', '{_GAP}', 'g') || '([^a-z0-9]|$)')),
 a AS (SELECT gid, count(*) AS n_blocks, min(block_key) AS first_block FROM h GROUP BY 1)"""
_EN = r"([A-Za-z][A-Za-z0-9\-]*(?:[ \-][A-Za-z0-9\-]+){0,5})\s*\(([A-Z][A-Z0-9\-]{1,9})\)"
_ZH = r"([\x{4e00}-\x{9fff}][\x{4e00}-\x{9fff}A-Za-z0-9\-]{1,21})（([A-Z][A-Z0-9\-]{1,9})）"
_CSV = """CASE WHEN regexp_matches({0}, '[",\n\r]') THEN '"' || replace({0}, '"', '""') || '"' ELSE coalesce({0}, '') END"""
QUERIES = {
    "kb_upsert": kb_upsert, "kb_stats": kb_stats, "literature_stats": literature_stats, "kb_lookup": kb_lookup, "kb_export": kb_export, "kb_exports": kb_exports, "glossary_dedupe": glossary_dedupe, "glossary_merge": glossary_merge,
    "glossary_conflicts": glossary_conflicts, "acronym_pairs": acronym_pairs, "keyword_pairs": keyword_pairs, "term_confirm": term_confirm, "glossary_audit": glossary_audit, "glossary_audit_top": glossary_audit_top,
}
ORACLES = {
    "kb_upsert": rf"""WITH RECURSIVE e AS (SELECT kb_id, gid, {sql_strip('source')} AS s, {sql_strip('target')} AS t, confidence AS c, source_kind AS k, coalesce(papers[1], '') AS p FROM glossary WHERE confidence IS NOT NULL AND NOT isnan(confidence) AND confidence BETWEEN 0 AND 1),
 o AS (SELECT *, {sql_key('s')} AS key, row_number() OVER (PARTITION BY kb_id, {sql_key('s')} ORDER BY gid) AS n FROM e WHERE {_OK}),
 f AS (SELECT kb_id, key, n, s AS source, t AS target, round(c, 2) AS confidence, k AS source_kind, (p <> '')::INT AS hits, p AS papers, []::VARCHAR[] AS alts FROM o WHERE n = 1
 UNION ALL SELECT kb_id, key, n, source, CASE WHEN swap THEN t ELSE target END, CASE WHEN swap OR (same AND c > confidence) THEN round(c, 2) ELSE confidence END, CASE WHEN swap OR (same AND c > confidence) THEN k ELSE source_kind END,
   hits + newp::INT, CASE WHEN newp THEN CASE WHEN papers = '' THEN p ELSE papers || ';' || p END ELSE papers END,
   CASE WHEN same THEN alts WHEN swap AND NOT list_contains(known, target) THEN list_prepend(target, known)[1:4] ELSE known[1:4] END
  FROM (SELECT *, NOT same AND c > confidence + 0.1::DOUBLE AS swap, CASE WHEN same OR list_contains(alts, t) THEN alts ELSE list_append(alts, t) END AS known FROM
   (SELECT f.kb_id, f.key, o.n, f.source, f.target, f.confidence, f.source_kind, f.hits, f.papers, f.alts, o.t, o.c, o.k, o.p, o.p <> '' AND NOT contains(f.papers, o.p) AS newp, {sql_key('o.t')} = {sql_key('f.target')} AS same
    FROM f JOIN o ON o.kb_id = f.kb_id AND o.key = f.key AND o.n = f.n + 1)))
 SELECT kb_id, source, target, confidence, source_kind, hits, papers, array_to_string(alts, '|') AS target_alt FROM (SELECT *, row_number() OVER (PARTITION BY kb_id, key ORDER BY n DESC) AS r FROM f) WHERE r = 1""",
    "kb_stats": "SELECT coalesce(source_kind, '?') AS source_kind, count(*) AS n_terms, count(*) FILTER (coalesce(hits, 0) >= 2) AS n_confirmed, count(*) FILTER (coalesce(len(target_alt), 0) > 0) AS n_with_alternatives FROM glossary GROUP BY 1",
    "literature_stats": "WITH r AS (SELECT paper_id, arg_max({'d': domain, 'b': n_blocks, 'c': n_table_cells}, rec_id) AS r FROM literature GROUP BY 1) SELECT coalesce(r.d, '?') AS domain, count(*) AS n_papers, sum(r.b)::BIGINT AS n_blocks, sum(r.c)::BIGINT AS n_cells FROM r GROUP BY 1",
    "kb_lookup": f"SELECT gid, source, target, confidence FROM glossary WHERE {_USABLE} AND (contains(lower(source), 'planner') OR contains(lower(coalesce(target, '')), 'planner')) ORDER BY confidence DESC, gid LIMIT 20",
    "kb_export": f"SELECT gid, coalesce(nullif(domain, ''), 'general') AS domain, '- ' || source || ' = ' || target AS line FROM glossary WHERE {_USABLE} AND confidence >= 0.6::DOUBLE AND target <> ''",
    "kb_exports": f"""WITH g AS (SELECT *, coalesce(nullif(domain, ''), 'general') AS dm FROM glossary WHERE {_USABLE} AND confidence >= 0.6::DOUBLE), h AS (SELECT dm, min(gid) AS section FROM g GROUP BY 1)
 SELECT 0::BIGINT AS section, gid AS n, {_CSV.format('source')} || ',' || {_CSV.format('target')} || ',' AS line, 'csv' AS form FROM g
 UNION ALL SELECT 0, gid, '| ' || coalesce(source, '') || ' | ' || coalesce(target, '') || ' | ' || confidence || ' | ' || coalesce(hits::VARCHAR, '') || ' | ' || coalesce(source_kind, '') || ' | ' || coalesce(array_to_string(target_alt, '|'), '') || ' |', 'markdown' FROM g
 UNION ALL SELECT section, gid, '- ' || coalesce(source, '') || ' = ' || coalesce(target, ''), 'prompt' FROM g JOIN h USING (dm) UNION ALL SELECT section, -1, '## ' || dm, 'prompt' FROM h""",
    "glossary_dedupe": f"SELECT {sql_key('source')} AS term, (arg_max({{'t': target}}, gid)).t AS target, min(gid) AS first FROM glossary GROUP BY 1",
    "glossary_merge": f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY {sql_key('source')} ORDER BY kb_id DESC, gid DESC) AS l, row_number() OVER (PARTITION BY {sql_key('source')} ORDER BY kb_id, gid) AS f FROM glossary) SELECT {sql_key('source')} AS term, max(CASE WHEN l = 1 THEN target END) AS target, max(CASE WHEN f = 1 THEN kb_id END) AS first_kb, max(CASE WHEN f = 1 THEN gid END) AS first_gid FROM r GROUP BY 1",
    "glossary_conflicts": f"SELECT kb_id, {sql_key('source')} AS term, count(DISTINCT target) AS n_targets, min(target) AS least, max(target) AS greatest FROM glossary WHERE target IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT target) > 1",
    "acronym_pairs": rf"""WITH RECURSIVE {_PAIRS},
 ea AS (SELECT block_key, unnest(regexp_extract_all(text, '{_EN}', 1)) AS nm, unnest(regexp_extract_all(text, '{_EN}', 2)) AS ac, unnest(range(len(regexp_extract_all(text, '{_EN}', 1)))) AS pos FROM p),
 ew AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(nm, '^[ ,;.:]+|[ ,;.:]+$', '', 'g'), '{WS}+'), lambda x: x <> '') AS ws FROM ea),
 ec AS (SELECT *, list_transform(ws, lambda x: NOT regexp_full_match(regexp_replace(lower(x), '^[.,;:]+|[.,;:]+$', '', 'g'), '{STOP_WORDS}')) AS ok FROM ew),
 ek AS (SELECT *, CASE WHEN list_contains(ok, true) THEN ws[list_position(ok, true):len(ws) - list_position(list_reverse(ok), true) + 1] END AS kept FROM ec),
 en AS (SELECT block_key, upper(ac) AS acronym, arg_min(array_to_string(kept, ' '), pos) AS source FROM ek WHERE len(kept) <= 6 AND len(list_filter(kept, lambda x: length(x) > 2)) > 0 AND length(array_to_string(kept, ' ')) BETWEEN 3 AND 52 GROUP BY 1, 2),
 za AS (SELECT block_key, unnest(regexp_extract_all(zh, '{_ZH}', 1)) AS nm, unnest(regexp_extract_all(zh, '{_ZH}', 2)) AS ac, unnest(range(len(regexp_extract_all(zh, '{_ZH}', 1)))) AS pos FROM p),
 no AS (SELECT unnest([{", ".join(f"'{w}'" for w in NOISE_WORDS)}]) AS w),
 zs AS (SELECT block_key, ac, pos, nm AS t, 0 AS k FROM za UNION ALL SELECT block_key, ac, pos, substr(t, (SELECT max(length(w)) FROM no WHERE starts_with(t, w) AND length(t) > length(w) + 1) + 1), k + 1 FROM zs WHERE EXISTS (SELECT 1 FROM no WHERE starts_with(t, w) AND length(t) > length(w) + 1)),
 zl AS (SELECT block_key, ac, pos, arg_max(t, k) AS t FROM zs GROUP BY 1, 2, 3), zn AS (SELECT block_key, upper(ac) AS acronym, arg_min(t, pos) AS target FROM zl WHERE length(t) BETWEEN 2 AND 24 GROUP BY 1, 2),
 j AS (SELECT *, len(string_split(source, ' ')) AS w, lower(string_split(source, ' ')[1]) AS f1 FROM en JOIN zn USING (block_key, acronym))
 SELECT block_key, acronym, source, target FROM j WHERE length(target) BETWEEN greatest(3, w * 2) AND least(24, greatest(greatest(3, w * 2), w * 4)) AND NOT (length(f1) > 4 AND regexp_matches(f1, '(ed|ing)$')) AND {sql_key('source')} <> {sql_key('target')}
  AND lower(acronym) NOT IN (SELECT {sql_key('source')} FROM glossary WHERE source IS NOT NULL)""",
    "keyword_pairs": rf"""WITH {_PAIRS}, k AS (SELECT block_key, regexp_extract(text, '(?i)^{WS}*(?:keywords|index terms|key words){WS}*[:：]?{WS}*(.+)$', 1) AS e, regexp_extract(zh, '^{WS}*(?:关键词|关键字){WS}*[:：]?{WS}*(.+)$', 1) AS z FROM p),
 l AS (SELECT block_key, list_filter(list_transform(regexp_split_to_array(e, '[;；,，、]|{WS}{{2,}}'), lambda x: trim(x, ' .;,')), lambda x: {sql_strip('x')} <> '') AS es, list_filter(list_transform(regexp_split_to_array(z, '[;；,，、]|{WS}{{2,}}'), lambda x: trim(x, ' ;，、。')), lambda x: {sql_strip('x')} <> '') AS zs FROM k WHERE e <> '' AND z <> ''),
 r AS (SELECT block_key, unnest(range(len(es))) AS n, unnest(es) AS source, unnest(zs) AS target FROM l WHERE len(es) = len(zs)) SELECT block_key, n::INT AS n, source, target FROM r WHERE regexp_matches(source, '[A-Za-z]') AND regexp_matches(target, '[\x{{4e00}}-\x{{9fff}}]') AND length(source) > 2""",
    "term_confirm": f"WITH {_PAIRS}, q AS (SELECT block_key, zh, {sql_key('text')} AS x FROM p), g AS (SELECT gid, target, {sql_key('source')} AS s FROM glossary WHERE target <> '' AND source <> '') SELECT gid, min(block_key) AS first_block FROM g JOIN q ON contains(zh, target) AND contains(x, s) GROUP BY 1",
    "glossary_audit": f"WITH {_PAIRS}, {_MISS} SELECT gid, n_blocks, first_block FROM a",
    "glossary_audit_top": f"WITH {_PAIRS}, {_MISS} SELECT gid, n_blocks, first_block FROM a ORDER BY n_blocks DESC, gid LIMIT 40",
}
