"""Spans and physical lines: text and summary of a line, blocks split by column, captions captured up to a break, fragments anchored."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.geometry import Box
from ..functions.text import WS, clean_text, collapse
from .tables import line_runs

#: Fonts of formulas, by a part of their name (fixed values).
MATH_FONTS = ("stix", "lmroman", "cmmi", "cmsy", "cmr", "math", "symbol", "mtmi", "euclid")
#: Words in a font's name that don't make another family (fixed values).
FONT_STYLES = r"(?i)(bold|italic|oblique|regular|medium)"


def line_text(spans: Column) -> Column:
    """Text of a line: its spans joined, cleaned."""
    return clean_text(F.array_join(F.transform(spans, lambda s: F.coalesce(s["text"], F.lit(""))), ""))


def block_text(lines: Column) -> Column:
    """Text of a block: its lines' spans joined, blank lines dropped, lines joined and cleaned."""
    texts = F.transform(lines, lambda ln: F.array_join(F.transform(ln["spans"], lambda s: F.coalesce(s["text"], F.lit(""))), ""))
    return clean_text(F.array_join(F.filter(texts, lambda t: collapse(t) != ""), "\n"))


def line_records(lines: Column) -> Column:
    """Visible lines as (text, bbox, spans of text and bbox), boxes to two decimals; a line without box gets the box around its spans."""
    two = lambda box: F.transform(box, lambda v: F.bround(v, 2))
    edge = lambda spans, i, f: f(F.transform(spans, lambda s: s["bbox"][i]))
    around = lambda spans: F.array(edge(spans, 0, F.array_min), edge(spans, 1, F.array_min), edge(spans, 2, F.array_max), edge(spans, 3, F.array_max))
    records = F.transform(lines, lambda ln: F.struct(
        line_text(ln["spans"]).alias("text"), two(F.coalesce(ln["bbox"], around(ln["spans"]))).alias("bbox"),
        F.transform(ln["spans"], lambda s: F.struct(s["text"].alias("text"), two(s["bbox"]).alias("bbox"))).alias("spans")))
    return F.filter(records, lambda r: r["text"] != "")


def dominant_size(spans: Column) -> Column:
    """The size (one decimal) that most characters have, the first on ties; 9 without spans."""
    size = lambda s: F.bround(F.coalesce(s["size"], F.lit(0.0)), 1)
    weight = lambda s: F.greatest(F.lit(1), F.length(F.coalesce(s["text"], F.lit(""))))
    sizes = F.array_distinct(F.transform(spans, size))
    weighed = F.transform(sizes, lambda v, i: F.struct(F.aggregate(spans, F.lit(0), lambda a, s: a + F.when(size(s) == v, weight(s)).otherwise(0)).alias("w"), (-i).alias("i"), v.alias("v")))
    return F.coalesce(F.array_max(weighed)["v"], F.lit(9.0))


def sizes_inside(spans: DataFrame, rectangles: DataFrame) -> DataFrame:
    """(rectangle, size): the size most characters have whose spans' centres lie in a rectangle; the smaller one on ties.

    ``spans`` has paper_id, page, box, size and chars; ``rectangles`` paper_id, page, rectangle, rx0, ry0, rx1, ry1. Joined within pages.
    """
    r = rectangles.select(F.col("paper_id").alias("_d"), F.col("page").alias("_p"), "rectangle", "rx0", "ry0", "rx1", "ry1")
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = (F.col("paper_id") == F.col("_d")) & (F.col("page") == F.col("_p")) & cx.between(F.col("rx0"), F.col("rx1")) & cy.between(F.col("ry0"), F.col("ry1"))
    sums = spans.join(r, inside).groupBy("rectangle", "size").agg(F.sum("chars").alias("_c"))
    return sums.groupBy("rectangle").agg(F.max_by("size", F.struct("_c", -F.col("size"))).alias("size"))


def summarize_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text, size, family, bold_ratio, widest_gap) per line of an array ``spans``; spans without visible text don't count.

    The size is the mean weighted by characters, the family the one with most characters (styles aside, the first on ties).
    """
    visible = F.filter("spans", lambda s: collapse(s["text"]) != "")
    rows = lines.select(*keys, visible.alias("_s")).where(F.size("_s") > 0)
    weight = lambda s: F.greatest(F.lit(1), F.length(collapse(s["text"])))
    total = F.aggregate("_s", F.lit(0), lambda a, s: a + weight(s))
    size = F.aggregate("_s", F.lit(0.0), lambda a, s: a + F.coalesce(s["size"], F.lit(0.0)) * weight(s)) / total
    bold = F.aggregate("_s", F.lit(0), lambda a, s: a + F.when((s["flags"].bitwiseAND(F.lit(16)) != 0) | F.lower(s["font"]).contains("bold"), weight(s)).otherwise(0)) / total
    family = lambda s: F.regexp_replace(F.coalesce(s["font"], F.lit("")), FONT_STYLES, "")
    names = F.array_distinct(F.transform("_s", family))
    weighed = F.transform(names, lambda n, i: F.struct(F.aggregate("_s", F.lit(0), lambda a, s: a + F.when(family(s) == n, weight(s)).otherwise(0)).alias("w"), (-i).alias("i"), n.alias("n")))
    gaps = F.transform(F.sequence(F.lit(1), F.size("_s") - 1), lambda i: F.get("_s", i)["bbox"][0] - F.get("_s", i - 1)["bbox"][2])
    widest = F.when(F.size("_s") > 1, F.array_max(gaps)).otherwise(0.0)
    return rows.select(*keys, line_text(F.col("_s")).alias("text"), size.alias("size"), F.array_max(weighed)["n"].alias("family"), bold.alias("bold_ratio"), widest.alias("widest_gap"))


def split_by_column(lines: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Adds ``part``, from 0 per raw block: blocks as wide as the page whose lines lie in both columns, or in one and across, are split by column and
    each column into runs; other blocks stay whole. Lines have their box, size, text, line, and their block's box as bx0..by1."""
    own, block = Box.of().column(width), Box.of("b").column(width)
    rows = lines.withColumns({"_col": own, "_wide": block == "full"})
    has = Window.partitionBy(*keys)
    count = lambda c: F.count_if(F.col("_col") == c).over(has)
    rows = rows.withColumns({"_l": count("left"), "_r": count("right"), "_f": count("full"), "_n": F.count("*").over(has)})
    split = F.col("_wide") & (F.col("_n") >= 2) & (((F.col("_l") > 0) & (F.col("_r") > 0)) | ((F.col("_f") > 0) & (F.col("_l") + F.col("_r") > 0)))
    rows = line_runs(rows.withColumn("_split", split), [*keys, "_col"])
    run = Window.partitionBy(*keys, "_col", "run")
    rows = rows.withColumns({"_top": F.min("y0").over(run), "_left": F.min("x0").over(run)})
    order = Window.partitionBy(*keys).orderBy("_top", "_left", "_col", "run")
    return rows.withColumn("part", F.when(F.col("_split"), F.dense_rank().over(order) - 1).otherwise(0)).drop("_col", "_wide", "_l", "_r", "_f", "_n", "_split", "run", "_top", "_left")


def caption_text(lines: DataFrame, keys: list[str], width: float) -> DataFrame:
    """(keys, number, text, x0, y0, x1, y1): the caption that starts with the first "Table N" line of a block and ends before the first stop.

    Lines are summaries with box, line and ``rule_y`` (the first ruling line below the caption's first line, null if none). Stops: a line at the rule, a wide
    gap, another size or family, another boldness, a gap as between table columns.
    """
    w = Window.partitionBy(*keys).orderBy("line")
    number = F.regexp_extract("text", rf"(?i)^Table{WS}+(\d+)\b", 1)
    rows = lines.withColumn("_n", F.when(number != "", F.col("line")))
    rows = rows.withColumn("_start", F.min("_n").over(Window.partitionBy(*keys))).where(F.col("line") >= F.col("_start"))
    first = lambda c: F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    py0, py1 = F.lag("y0").over(w), F.lag("y1").over(w)
    stop = (
        (F.col("y0") >= first("rule_y") - 1) | (F.col("y0") - py1 > F.greatest(F.lit(6.0), (py1 - py0) * 0.9)) | (F.abs(F.col("size") - first("size")) > 0.9) | (F.col("family") != first("family"))
        | (F.abs(F.col("bold_ratio") - first("bold_ratio")) > 0.65) | (F.col("widest_gap") > F.greatest(F.lit(24.0), F.lit(width * 0.05)))
    )
    rows = rows.withColumn("_stop", F.when(F.col("line") > F.col("_start"), F.coalesce(stop, F.lit(False))).otherwise(F.lit(False)).cast("int"))
    kept = rows.withColumn("_past", F.max("_stop").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_past = 0")
    out = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("_l"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    text = collapse(F.array_join("_l.text", " "))
    return out.select(*keys, F.regexp_extract(text, rf"(?i)^Table{WS}+(\d+)\b", 1).cast("int").alias("number"), text.alias("text"), "x0", "y0", "x1", "y1")


_BOUNDARY = set(",.;:!?()[]{}，。；：！？（）【】")


def text_boundary(text: str, offset: int) -> int:
    """The place nearest to ``offset``, the left one on ties, before or after a blank or a sign, or at an end of the text."""
    at = min(max(offset, 0), len(text))
    for d in range(len(text) + 1):
        for place in (at - d, at + d):
            if 0 <= place <= len(text) and (place in (0, len(text)) or any(c.isspace() or c in _BOUNDARY for c in text[place - 1 : place + 1])):
                return place
    return at


def anchor(text: str, box: list[float], size: float | None, lines: list[dict], fragment: list[float]) -> int:
    """Where in a block's text a fragment inside its box belongs.

    On the line it shares most height with: as many characters as the spans left of its centre have. Above, below or between lines: at the
    start, at the end, or after the line above. Without lines, by its place on a grid of lines of 1.25 times the size.
    """
    if not text:
        return 0
    cx, cy = (fragment[0] + fragment[2]) / 2, (fragment[1] + fragment[3]) / 2
    known = sorted((ln for ln in lines or [] if ln.get("bbox") is not None and len(ln["bbox"]) == 4), key=lambda ln: (ln["bbox"][1], ln["bbox"][0]))
    if not known:
        height = max(1.0, (size or 9.0) * 1.25)
        n = max(1, round(max(height, box[3] - box[1]) / height))
        row = min(max(int((cy - box[1]) / height), 0), n - 1)
        across = min(max((cx - box[0]) / max(1.0, box[2] - box[0]), 0.0), 1.0)
        return text_boundary(text, round((row + across) / n * len(text)))
    texts = [" ".join((ln.get("text") or "").split()) for ln in known]
    starts, cursor, before = [], 0, 0
    nominal = max(1, sum(len(t) + 1 for t in texts) - 1)
    for t in texts:
        found = text.find(t, cursor) if t else -1
        starts.append(found if found >= 0 else round(before / nominal * len(text)))
        cursor = found + len(t) if found >= 0 else cursor
        before += len(t) + 1
    shared = [min(fragment[3], ln["bbox"][3]) - max(fragment[1], ln["bbox"][1]) for ln in known]
    if max(shared) <= 0:
        if fragment[3] <= known[0]["bbox"][1]:
            return 0
        if fragment[1] >= known[-1]["bbox"][3]:
            return len(text)
        above = [i for i, ln in enumerate(known) if ln["bbox"][3] <= cy]
        return text_boundary(text, starts[above[-1]] + len(texts[above[-1]])) if above else 0
    best = max(range(len(known)), key=lambda i: (shared[i], i))
    local = 0
    for s in sorted((s for s in known[best].get("spans") if s.get("bbox") is not None and len(s["bbox"]) == 4) if known[best].get("spans") is not None else [], key=lambda s: s["bbox"][0]):
        x0, x1, n = s["bbox"][0], s["bbox"][2], len(s.get("text") or "")
        if cx <= x0:
            break
        if cx < x1:
            local += round(n * (cx - x0) / (x1 - x0))
            break
        local += n
    return text_boundary(text, starts[best] + min(local, len(texts[best])))


@F.pandas_udf(IntegerType())
def anchored(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    """``anchor`` over (text, box, size, lines, fragment box)."""
    for text, box, size, lines, fragment in parts:
        out = []
        for t, b, s, ls, f in zip(text, box, size, lines, fragment):
            out.append(None if b is None or f is None else anchor(t or "", [*b], s, [*ls] if ls is not None else [], [*f]))
        yield pd.Series(out, dtype="Int32")


def math_style(spans: Column) -> Column:
    """Whether any span is set in a font of formulas."""
    return F.exists(spans, lambda s: F.lower(F.coalesce(s["font"], F.lit(""))).rlike("|".join(MATH_FONTS)))


def ruling_lines(drawings: DataFrame) -> DataFrame:
    """(paper_id, page, y, x0, x1) of drawings (x0, y0, x1, y1, is_line): nearly level lines above 15 points, and flat boxes; rounded, each once."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    flat = F.when(F.col("is_line"), (F.abs(dy) < 0.9) & (F.abs(dx) > 15)).otherwise((dy < 1.4) & (dx > 15))
    one = lambda c: F.bround(c, 1)
    rows = drawings.where(flat).select("paper_id", "page", one((F.col("y0") + F.col("y1")) / 2).alias("y"), one(F.least("x0", "x1")).alias("x0"), one(F.greatest("x0", "x1")).alias("x1"))
    return rows.distinct()
