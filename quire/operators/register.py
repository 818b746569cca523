"""Registering papers: title, abstract and keywords guessed from blocks, records upserted, terms harvested; and the old paragraph merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS, normalize_key
from . import terminology


def guesses(blocks: DataFrame) -> DataFrame:
    """(paper_id, title_block, abstract_block, keyword_block): on page 1 the largest block (most characters on ties), the longest one if above 200
    characters, and the paper's first keyword line."""
    first = blocks.where("page = 1").groupBy("paper_id").agg(
        F.max_by("block_key", F.struct("size", "chars", -F.col("block_key"))).alias("title_block"),
        F.max_by(F.struct("block_key", "chars"), F.struct("chars", -F.col("block_key"))).alias("_a"),
    )
    words = blocks.where(F.col("text").rlike(terminology.EN_KEYWORDS)).groupBy("paper_id").agg(F.min_by("block_key", F.struct("page", F.col("flow_index").isNull(), "flow_index", "block_key")).alias("keyword_block"))
    return first.join(words, "paper_id", "left").select("paper_id", "title_block", F.when(F.col("_a.chars") > 200, F.col("_a.block_key")).alias("abstract_block"), "keyword_block")


def paper_records(blocks: DataFrame, translations: DataFrame) -> DataFrame:
    """(paper_id, title_en, title_zh, abstract_en, abstract_zh, keywords_en, keywords_zh, pages, n_blocks): what a paper's blocks and their translations
    (block_key, zh) say about it, by ``guesses``. Abstracts are cut at 1,500 and 1,200 characters, as fields of a record are; n_blocks are translated."""
    texts = blocks.select("block_key", F.col("text").alias("_t")).join(translations.where("zh <> ''").select("block_key", F.col("zh").alias("_z")), "block_key", "left")
    out = guesses(blocks)
    for name in ("title", "abstract", "keyword"):
        held = texts.select(F.col("block_key").alias(f"{name}_block"), F.coalesce("_t", F.lit("")).alias(f"_{name}_en"), F.coalesce("_z", F.lit("")).alias(f"_{name}_zh"))
        out = out.join(held, f"{name}_block", "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    words = lambda c, pattern, signs: F.when(text(c).rlike(pattern), F.transform(F.split(F.regexp_extract(text(c), pattern, 1), terminology.KEYWORD_SPLIT), lambda x: F.regexp_replace(x, f"^[{signs}]+|[{signs}]+$", ""))).otherwise(F.array().cast("array<string>"))
    counts = blocks.join(translations.where("zh <> ''").select("block_key", F.lit(1).alias("_done")), "block_key", "left").groupBy("paper_id").agg(F.max("page").alias("pages"), F.count("_done").alias("n_blocks"))
    return out.select(
        "paper_id", text("_title_en").alias("title_en"), text("_title_zh").alias("title_zh"), F.left(text("_abstract_en"), F.lit(1500)).alias("abstract_en"), F.left(text("_abstract_zh"), F.lit(1200)).alias("abstract_zh"),
        words("_keyword_en", terminology.EN_KEYWORDS, " .;,").alias("keywords_en"), words("_keyword_zh", terminology.ZH_KEYWORDS, " ;，、。").alias("keywords_zh"),
    ).join(counts, "paper_id")


def find_title(blocks: DataFrame, titles: DataFrame) -> DataFrame:
    """(paper_id, block_key): the first block of page 1 that contains the first 40 characters of the paper's known title, spelling of blanks and case aside."""
    head = F.left(normalize_key(F.col("title")), F.lit(40))
    rows = blocks.where("page = 1").join(titles.select("paper_id", head.alias("_t")).where("_t <> ''"), "paper_id")
    return rows.where(F.contains(normalize_key(F.col("text")), F.col("_t"))).groupBy("paper_id").agg(F.min("block_key").alias("block_key"))


def upsert_records(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with records of equal key replaced by those of ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def paper_slug(subject: Column, name: Column) -> Column:
    """Id of a paper: its DOI in the subject, else its file name, with hyphens for other characters; at most 60 characters of a name."""
    doi = F.regexp_extract(F.lower(F.coalesce(subject, F.lit(""))), r"(10\.\d{4,9}/\S+)", 1)
    trim = lambda c: F.regexp_replace(c, "^-+|-+$", "")
    return F.when(doi != "", trim(F.regexp_replace(doi, "[^0-9a-z]+", "-"))).otherwise(trim(F.left(F.regexp_replace(name, r"[^0-9A-Za-z\x{4e00}-\x{9fff}]+", "-"), F.lit(60))))


def harvest(kb: DataFrame, pairs: DataFrame, paper: Column) -> DataFrame:
    """The knowledge bases after a paper's blocks: terms found again gain a hit, the paper and 0.03 confidence (at most 0.95), mined pairs are folded in after.

    ``kb`` is evidence (kb_id, source, target, confidence, kind, paper, seq), ``pairs`` has block_key, text and zh, and kb_id if a pair is for one base
    only; else every base of ``kb`` is harvested from all pairs. The rows are evidence for ``terminology.upsert``, in the stages
    0 (known), 1 (confirmations) and 2 (mined).
    """
    own = "kb_id" in pairs.columns
    mined = _mined(pairs)
    if own:
        mined = mined.join(pairs.select("block_key", "kb_id"), "block_key")
    else:
        mined = _distinct(mined, "_t").crossJoin(F.broadcast(kb.select("kb_id").distinct()))
    return _again(kb, pairs, paper).unionByName(_evidence(mined.join(_known(kb), ["kb_id", "_t"], "left_anti"), paper))


def harvested(kb: DataFrame, pairs: DataFrame, paper: Column) -> DataFrame:
    """``terminology.upsert`` of the ``harvest`` of every base from all pairs, without a row of evidence for each mined pair and base.

    A mined term that a base doesn't have, and of which no acronym is a term of that base, becomes the same in all such bases: it is folded once and
    handed to them. Only the others are folded with what their base has.
    """
    mined = _distinct(_mined(pairs), "_t")
    if kb.sparkSession.conf.get("spark.checkpoint.dir", None):  # else the texts are mined again for each use
        mined = mined.checkpoint()
    known = _known(kb)
    merged = _distinct(mined)
    held = known.select("kb_id", F.col("_t").alias("_s")).join(merged.select("_s").distinct(), "_s", "left_semi")
    barred = mined.join(known, "_t").select("kb_id", "_s").distinct()
    # acronyms are looked at for each base only where one is known there
    open_ = held.join(barred, ["kb_id", "_s"], "left_anti").join(merged, "_s")
    closed = _distinct(barred.join(mined, "_s").join(known, ["kb_id", "_t"], "left_anti"), "kb_id")
    own = terminology.upsert(_again(kb, pairs, paper).unionByName(_evidence(open_, paper)).unionByName(_evidence(closed, paper)))
    shared = terminology.upsert(_evidence(merged.withColumn("kb_id", F.lit(0)), paper)).drop("kb_id").withColumn("_s", normalize_key(F.col("source")))
    base = F.collect_set(F.struct("kb_id"))  # a struct, as a base without number counts too
    apart = held.unionByName(barred).groupBy("_s").agg(base.alias("_apart"))
    every = kb.select("kb_id").distinct().agg(base.alias("_every"))
    rest = shared.join(apart, "_s", "left").crossJoin(F.broadcast(every))
    rest = rest.withColumn("_b", F.explode(F.when(F.col("_apart").isNull(), F.col("_every")).otherwise(F.array_except("_every", "_apart"))))
    return own.unionByName(rest.select("_b.kb_id", *own.columns[1:]))


def _again(kb: DataFrame, pairs: DataFrame, paper: Column) -> DataFrame:
    """The evidence of the stages 0 and 1."""
    own = ["kb_id"] if "kb_id" in pairs.columns else []
    terms = kb.select(F.struct("kb_id", "seq").alias("_id"), *own, "source", "target")
    hits = terminology.confirmations(terms, pairs, own).select("_id.kb_id", "_id.seq", F.lit(True).alias("_hit")).distinct()
    raised = kb.join(hits, ["kb_id", "seq"], "left").withColumn("confidence", F.when(F.col("_hit"), F.least(F.lit(0.95), F.round(F.col("confidence") + 0.03, 2))).otherwise(F.col("confidence")))
    # a term's first row found again is its one confirmation, after all that is known
    nth = F.row_number().over(Window.partitionBy("kb_id", normalize_key(F.col("source"))).orderBy(F.col("_hit").desc_nulls_last(), "seq"))
    row = F.struct(F.col("paper").cast("string").alias("paper"), F.col("seq").cast("bigint").alias("seq"), F.lit(0).alias("stage"))
    once = F.struct(paper.cast("string").alias("paper"), F.lit(0).cast("bigint").alias("seq"), F.lit(1).alias("stage"))
    again = raised.withColumn("_first", F.coalesce(F.col("_hit") & (nth == 1), F.lit(False)))
    again = again.select("kb_id", "source", "target", "confidence", "kind", F.explode(F.when(F.col("_first"), F.array(row, once)).otherwise(F.array(row))).alias("_r"))
    return again.select("kb_id", "source", "target", "confidence", "kind", "_r.*")


def _mined(pairs: DataFrame) -> DataFrame:
    """(block_key, _t, source, target, confidence, kind) of the pairs; _t: the acronym in lower case, null for keywords."""
    texts = pairs.dropDuplicates(["block_key"]) if "kb_id" in pairs.columns else pairs
    acronyms = terminology.acronym_pairs(texts, None).select("block_key", F.lower("acronym").alias("_t"), "source", "target", F.lit(0.78).alias("confidence"), F.lit("acronym").alias("kind"))
    keywords = terminology.keyword_pairs(texts).select("block_key", F.lit(None).cast("string").alias("_t"), "source", "target", F.lit(0.95).alias("confidence"), F.lit("keyword").alias("kind"))
    return acronyms.unionByName(keywords)


def _distinct(mined: DataFrame, *by: str) -> DataFrame:
    """The first of equal mined pairs: the same pair mined again changes nothing."""
    rows = mined.groupBy(normalize_key(F.col("source")).alias("_s"), *by, "target", "confidence", "kind")
    return rows.agg(F.min(F.struct("block_key", "source")).alias("_f")).select("_s", *by, "target", "confidence", "kind", "_f.source", "_f.block_key")


def _known(kb: DataFrame) -> DataFrame:
    return kb.select("kb_id", normalize_key(F.col("source")).alias("_t")).distinct()


def _evidence(mined: DataFrame, paper: Column) -> DataFrame:
    """The evidence of stage 2."""
    return mined.select("kb_id", "source", "target", "confidence", "kind", paper.cast("string").alias("paper"), F.col("block_key").alias("seq"), F.lit(2).alias("stage"))


def seed_evidence(glossary: DataFrame, kb_id: int) -> DataFrame:
    """A glossary (source, target, n) as the first evidence of a knowledge base, at confidence 0.75."""
    return glossary.select(F.lit(kb_id).alias("kb_id"), "source", "target", F.lit(0.75).alias("confidence"), F.lit("seed").alias("kind"), F.lit("").alias("paper"), F.col("n").cast("bigint").alias("seq"))


#: Fixed value: starts of structural blocks.
STRUCTURE = rf"(?i)^{WS}*(?:\[\d{{1,4}}\]|\(\d{{1,4}}\)|\d{{1,3}}[.)]{WS}+|[-•·▪–]{WS}+|(?:fig(?:ure)?|table|algorithm|eq(?:uation)?)\.?{WS}*\d+\b)"


def merge_old_layout(blocks: DataFrame, ratio: float = 0.6) -> DataFrame:
    """(paper_id, page, head, members): paragraphs of documents without reading order, merged down their columns.

    Columns are anchored at the leftmost block; blocks within 40 points belong to it. A block continues the one before unless size, column, gap, structure
    or an indent after an ended sentence speak against it. Runs of two or more are reported; a run of which a member but the first is already
    translated (``done``) isn't.
    """
    page = ["paper_id", "page"]
    xs = blocks.groupBy(*page).agg(F.array_sort(F.collect_set("x0")).alias("_x"))
    empty = F.array().cast("array<double>")
    anchors = F.aggregate("_x", empty, lambda a, x: F.when((F.size(a) > 0) & (x - F.element_at(F.concat(F.array(F.lit(0.0)), a), -1) <= 40), a).otherwise(F.concat(a, F.array(x))))
    rows = blocks.join(xs.select(*page, anchors.alias("_anchors")), page).withColumn("_a", F.array_max(F.filter("_anchors", lambda a: a <= F.col("x0"))))
    w = Window.partitionBy(*page, "_a").orderBy("y0", "block_key")
    p = {c: F.lag(c).over(w) for c in ("x0", "y1", "x1", "size", "text", "heading", "bold", "math_only")}
    yes = lambda c: F.coalesce(c, F.lit(False))
    width = F.least(F.col("x1") - F.col("x0"), p["x1"] - p["x0"])
    over = F.greatest(F.lit(0.0), F.least("x1", p["x1"]) - F.greatest("x0", p["x0"]))
    size = F.least("size", p["size"])
    style = yes(F.col("heading")) | yes(F.col("bold")) | yes(F.col("math_only")) | yes(p["heading"]) | yes(p["bold"]) | yes(p["math_only"])
    ended = F.regexp_replace(F.coalesce(p["text"], F.lit("")), f"{WS}+$", "").rlike(r"[.!?;:]$")
    goes_on = (
        ~style & (F.abs(F.col("size") - p["size"]) <= 0.6) & (width > 0) & (over > 0.5 * width) & (F.col("y0") - p["y1"] <= ratio * size) & ~F.regexp_replace(F.coalesce("text", F.lit("")), f"^{WS}+", "").rlike(STRUCTURE)
        & ~(ended & (F.col("x0") - p["x0"] > F.greatest(F.lit(4.0), 0.75 * size)))
    )
    rows = rows.withColumn("_new", (~yes(goes_on)).cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(*page, "_a", "_run").agg(F.array_sort(F.collect_list(F.struct("y0", "block_key", "done"))).alias("_m")).where(F.size("_m") > 1)
    runs = runs.where(~F.exists(F.slice("_m", 2, F.size("_m")), lambda m: F.coalesce(m["done"], F.lit(False))))
    return runs.select(*page, F.get("_m", F.lit(0))["block_key"].alias("head"), F.col("_m.block_key").alias("members"))
