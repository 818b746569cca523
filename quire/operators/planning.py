"""Planning a translation run: front matter, skip reasons, resume status, batches, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS, strip, symbol_ratio
from . import flow

# Patterns of the skip rules.
PAGE_NUMBER = rf"(?i)^{WS}*(?:\d{{1,4}}|[ivxlcdm]{{1,6}}){WS}*$"
META = (
    rf"(?i)(doi{WS}*:|https?://|www\.|©|\(c\){WS}*20|copyright|all rights reserved|received{WS}|accepted{WS}|available online|contents lists available|"
    rf"journal homepage|elsevier|springer|wiley|taylor{WS}*&{WS}*francis|preprint|under review|licen[cs]e)"
)
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9_-]+\.[a-zA-Z0-9_.]+"
AFFILIATION = r"(?i)(university|institute|college|laboratory|academy|department|school of|faculty)"
REFERENCE_HEADING = rf"(?i)^{WS}*(references|bibliography|reference list|参考文献){WS}*[:.]?{WS}*$"
CORRESPONDING = r"(?i)(corresponding author|corresp\.)"
JOURNAL = rf"(?i)(journal of|transactions on|proceedings of|research part|part{WS}+[a-f]\b|elsevier|springer|sciencedirect|wiley|ieee\b)"
CAPTION = rf"(?i)^{WS}*(fig\.?|figure|table|tab\.?|algorithm|eq\.?|equation|图|表|式|算法){WS}*\d"
LABEL = rf"^[A-Z](?:{WS}+[A-Z]){{2,}}\.?$"
LABEL_WORD = rf"(?i)^{WS}*(?:a{WS}?b{WS}?s{WS}?t{WS}?r{WS}?a{WS}?c{WS}?t|a{WS}?r{WS}?t{WS}?i{WS}?c{WS}?l{WS}?e|keywords?|index terms){WS}*[:：]?{WS}*$"
ANCHOR = rf"(?i)^{WS}*(?:a{WS}?b{WS}?s{WS}?t{WS}?r{WS}?a{WS}?c{WS}?t|a{WS}?r{WS}?t{WS}?i{WS}?c{WS}?l{WS}?e|keywords?|index terms|1\.?{WS}+introduction)"
SENTENCE_END = r"[.!?。！？]$"
HEADING_NUMBER = rf"(?i)^{WS}*(?:\d{{1,2}}(?:\.\d{{1,2}}){{0,3}}\.?{WS}+[A-Za-z]|appendix\b|[IVX]{{1,4}}\.{WS}+[A-Za-z])"
HEADING_CHARS = rf"^[A-Za-z](?:[A-Za-z\-–&,'/:]|{WS})*$"


def heading_like(t: Column) -> Column:
    """Numbered headings, or letters only with two words of three letters or one such word in at least twelve characters."""
    words = F.size(F.filter(F.split(t, f"{WS}+"), lambda w: F.length(w) >= 3))
    return t.rlike(HEADING_NUMBER) | (t.rlike(HEADING_CHARS) & ((words >= 2) | ((words == 1) & (F.length(t) >= 12))))


def front_matter(blocks: DataFrame) -> DataFrame:
    """(block_key) of first-page blocks above the first anchor (abstract, keywords, introduction), the title, captions and labels aside.

    Blocks are taken in stored order (block_key). Two aggregates per paper and a join; no window over a paper.
    """
    first = blocks.where("page = 1 AND y0 IS NOT NULL").withColumn("_t", strip(F.coalesce("text", F.lit(""))))
    is_anchor = F.col("_t").rlike(ANCHOR)
    marks = first.groupBy("paper_id").agg(F.min_by(F.when(is_anchor, F.col("y0")), F.when(is_anchor, F.col("block_key"))).alias("_y"), F.min("block_key").alias("_title"))
    hit = (F.col("y0") < F.col("_y")) & (F.col("block_key") != F.col("_title")) & ~F.col("_t").rlike(CAPTION) & ~F.col("_t").rlike(LABEL_WORD)
    return first.join(marks.where("_y IS NOT NULL"), "paper_id").where(hit).select("block_key")


def skip_reasons(blocks: DataFrame, height: float, in_table: DataFrame, front: DataFrame, references: bool = True) -> DataFrame:
    """(block_key, reason): why a block isn't translated, the first rule that applies, null if it is.

    Everything after the first reference heading of a paper is skipped (unless ``references`` is false). That heading is found by an aggregate per paper
    (the least position that no earlier rule takes), and joined back. ``blocks`` may have flags for what the caller knows: forced (never skipped),
    landscape (its page is one), nested (a fragment of another block), skip_page; null is no.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in blocks.columns else F.lit(False)
    t = F.col("_t")
    rows = blocks.withColumn("_t", strip(F.coalesce("text", F.lit(""))))
    rows = rows.join(front.withColumn("_front", F.lit(True)), "block_key", "left").join(in_table.withColumn("_in", F.lit(True)), "block_key", "left")
    early = (
        F.when(yes("forced"), "forced").when(t == "", "empty").when(yes("landscape"), "landscape page").when(F.col("_front"), "front matter").when(yes("nested"), "nested").when(F.col("kind") == "table", "table").when(F.col("kind") == "meta", "meta")
        .when(F.coalesce("math_only", F.lit(False)) | (F.col("kind") == "math_only"), "math")
    )
    rows = rows.withColumn("_early", early)
    at = F.struct(F.col("page").alias("page"), F.col("flow_index").isNull().alias("n"), F.col("flow_index").alias("i"), F.col("block_key").alias("k"))
    rows = rows.withColumn("_at", at)
    heads = rows.where(F.col("_early").isNull() & t.rlike(REFERENCE_HEADING)).groupBy("paper_id").agg(F.min("_at").alias("_head"))
    rows = rows.join(heads, "paper_id", "left")
    short = t.rlike(CAPTION) | t.rlike(LABEL) | t.rlike(LABEL_WORD) | heading_like(t)
    n = F.length(t)
    edge = (n < 90) & ((F.col("y0") < 0.062 * height) | (F.col("y0") > 0.94 * height))
    reason = (
        F.when(F.col("_early") == "forced", None).when(F.col("_early").isNotNull(), F.col("_early")).when(F.lit(references) & (F.col("_at") > F.col("_head")), "references")
        .when(F.lit(references) & (F.col("_at") == F.col("_head")), "reference heading").when(yes("skip_page"), "skipped page").when(F.col("_in"), "in table").when(F.coalesce(edge, F.lit(False)), "header or footer").when(t.rlike(PAGE_NUMBER), "page number").when(t.rlike(EMAIL), "e-mail")
        .when((n < 130) & t.rlike(META), "publisher").when((n < 80) & t.rlike(JOURNAL), "journal").when((n < 120) & t.rlike(CORRESPONDING), "correspondence")
        .when((n < 300) & t.rlike(AFFILIATION) & ~t.rlike(SENTENCE_END), "affiliation").when(F.coalesce("has_math", F.lit(False)) & (n < 100) & ~heading_like(t), "formula fragment")
        .when((n < 50) & ~short & ~t.rlike(SENTENCE_END), "fragment").when((n >= 3) & (symbol_ratio(t) > 0.45), "symbols")
    )
    return rows.select("paper_id", "block_key", reason.alias("reason"))


def resume_status(existing: DataFrame, current: DataFrame) -> DataFrame:
    """(block_key, status) of existing entries: orphan, unverifiable, stale, layout_stale, legacy or valid.

    Both have block_key, source_hash and layout_uid. Tested in this order: block unknown; current identity incomplete; hashes differ (legacy
    if the entry has none); places differ (legacy if the entry has none).
    """
    e = existing.select("block_key", F.col("source_hash").alias("_h"), F.col("layout_uid").alias("_u"))
    c = current.select("block_key", F.col("source_hash").alias("_ch"), F.col("layout_uid").alias("_cu"), F.lit(True).alias("_known"))
    status = (
        F.when(F.col("_known").isNull(), "orphan").when(F.col("_ch").isNull() | F.col("_cu").isNull(), "unverifiable")
        .when(F.col("_h").isNull(), "legacy").when(F.col("_h") != F.col("_ch"), "stale")
        .when(F.col("_u").isNull(), "legacy").when(F.col("_u") != F.col("_cu"), "layout_stale").otherwise("valid")
    )
    return e.join(c, "block_key", "left").select("block_key", status.alias("status"))


def identity_mismatches(entries: DataFrame, current: DataFrame) -> DataFrame:
    """(field, mismatched, unverified): per identity field, entries that differ from their block, and entries or blocks without it."""
    e = entries.where("absorbed_into IS NULL").select("block_key", F.col("source_hash").alias("_h"), F.col("layout_uid").alias("_u"))
    both = e.join(current.select("block_key", F.col("source_hash").alias("_ch"), F.col("layout_uid").alias("_cu")), "block_key")
    field = F.explode(F.array(F.struct(F.lit("source_hash").alias("field"), F.col("_h").alias("old"), F.col("_ch").alias("new")), F.struct(F.lit("layout_uid").alias("field"), F.col("_u").alias("old"), F.col("_cu").alias("new"))))
    rows = both.select(field.alias("f")).select("f.*")
    return rows.groupBy("field").agg(F.count_if(F.col("old") != F.col("new")).alias("mismatched"), F.count_if(F.col("old").isNull() | F.col("new").isNull()).alias("unverified"))


def positions(blocks: DataFrame) -> DataFrame:
    """Adds ``position``, counted from 0 per paper in document order: place on the page plus the size of the pages before."""
    sizes = blocks.groupBy(flow.DOC, flow.PAGE).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(flow.DOC).orderBy(flow.PAGE).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(flow.DOC, flow.PAGE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    page = Window.partitionBy(flow.DOC, flow.PAGE).orderBy(*flow.flow_order())
    return blocks.withColumn("_in", F.row_number().over(page) - 1).join(starts, [flow.DOC, flow.PAGE]).withColumn("position", F.col("_start") + F.col("_in")).drop("_in", "_start")


def runs(items: DataFrame, breaks: Column) -> DataFrame:
    """Adds ``run``, the position of the first item of each item's run: runs end where positions aren't consecutive and at breaks.

    A break is an item for which ``breaks`` holds: it starts a run, and so does the item after it.
    """
    held = flow.previous(items.withColumn("_break", F.coalesce(breaks, F.lit(False))), ["position", "_break"])
    opens = F.col("prev_position").isNull() | (F.col("position") != F.col("prev_position") + 1) | F.col("_break") | F.col("prev__break")
    return flow.carried(held, F.when(opens, F.col("position")), "run").drop("_break", "prev_position", "prev__break")


def flow_batches(items: DataFrame, breaks: Column, budget: int, overhead: int = 40) -> DataFrame:
    """(paper_id, run, position, block_key, batch): consecutive items in batches of at most ``budget`` characters, none across a break.

    ``items`` have paper_id, page, flow_index, block_key, position, and text or n_chars. Every item costs its length and ``overhead``. Texts aren't carried along.
    """
    length = F.col("n_chars") if "n_chars" in items.columns else F.length("text")
    of = runs(items.withColumn("_cost", length + overhead).drop("text"), breaks)
    return flow.greedy_batches(of, [flow.DOC, "run"], ["position", "block_key"], F.col("_cost"), budget)


def first_items(items: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` items (paper_id, position) in order of paper and position."""
    return items.orderBy(flow.DOC, "position").limit(limit)


def contexts(items: DataFrame) -> DataFrame:
    """(block_key, before, after): the neighbours in document order that a block's translation may look at, none across a flow break."""
    held = flow.following(flow.previous(items, ["block_key", "flow_break"]), ["block_key", "flow_break"])
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return held.select("block_key", F.when(~yes("flow_break"), F.col("prev_block_key")).alias("before"), F.when(~yes("next_flow_break"), F.col("next_block_key")).alias("after"))


#: Fixed values of the indent rule.
INDENT_LIST = rf"^{WS}*(?:[0-9]{{1,2}}[.、）)]|[a-zA-Z][.、)]|[（(][0-9a-zA-Z]{{1,2}}[）)]|[-•·▪–]{WS})"
INDENT_CAPTION = rf"^{WS}*(?:图|表|式|算法|[Ff]ig|[Tt]able|[Aa]lgorithm|[Ee]q)"
INDENT_END = r"(?:。|！|？|…|。”|\.”|\.)$"


def indents(blocks: DataFrame) -> DataFrame:
    """(block_key, indented): whether a translated paragraph begins with an indent.

    Headings and bold blocks don't; nor do short texts, list items, captions, continuations, and paragraphs after a text that ended inside a
    sentence, unless a heading stood between. The text before is carried within pages and, in one row per page, across them.
    """
    head = F.coalesce("heading", F.lit(False)) | F.coalesce("bold", F.lit(False))
    tail = F.regexp_replace("zh", f"{WS}+$", "")
    open_end = F.when(head, F.lit(False)).otherwise(~tail.rlike(INDENT_END))
    held = flow.carried(blocks, open_end, "_open", inclusive=False)
    zh = F.col("zh")
    yes = ~head & (F.length(zh) >= 30) & ~zh.rlike(INDENT_LIST) & ~zh.rlike(INDENT_CAPTION) & ~F.coalesce("_open", F.lit(False)) & ~F.coalesce("continues", F.lit(False))
    return held.select("block_key", yes.alias("indented"))
