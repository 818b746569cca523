"""Layout operators: kinds, reading order, page continuation, paragraph merging, nested boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box
from ..functions.text import LIST_START, TERMINAL, WS, clean_text, strip

PAGE_WIDTH, PAGE_HEIGHT = 600.0, 1000.0

# Patterns of captions, page numbers, publisher's lines and reference headings.
CAPTION_TABLE = rf"(?i)^{WS}*(?:Table|Tab\.){WS}*\d+\b"
CAPTION_FIGURE = rf"(?i)^{WS}*(?:Fig\.?|Figure){WS}*\d+\b"
REFERENCE_HEADING = rf"(?i)^{WS}*(?:references|bibliography|reference list){WS}*[:.]?{WS}*$"
PAGE_NUMBER = rf"(?i)^{WS}*(?:\d{{1,4}}|[ivxlcdm]{{1,8}}){WS}*$"
META = (
    rf"(?i)(doi{WS}*:|https?://|www\.|copyright|©|all rights reserved|received{WS}|accepted{WS}|"
    r"journal homepage|available online|corresponding author|preprint|under review)"
)
STRUCTURAL = ("heading", "table", "table_caption", "figure_caption")


def in_regions(blocks: DataFrame, regions: DataFrame, ratio: float, strict: bool) -> DataFrame:
    """Keys (block_key) of blocks of which a region of their page covers at least (``strict``: more than) ``ratio``.

    Equi-join on document and page with the area condition as residual; regions have (paper_id, page, rx0, ry0, rx1, ry1).
    """
    share = Box.of().overlap_ratio(Box.of("r"))
    hit = share > ratio if strict else share >= ratio
    b, r = blocks.alias("b"), regions.select(F.col("paper_id").alias("_d"), F.col("page").alias("_p"), "rx0", "ry0", "rx1", "ry1")
    return b.join(r, (F.col("b.paper_id") == F.col("_d")) & (F.col("b.page") == F.col("_p")) & hit, "left_semi").select("block_key")


def kind(in_table: Column, height: float = PAGE_HEIGHT) -> Column:
    """Kind of a block, the first rule that applies; needs text, bold, font, math_only and the box."""
    text = F.coalesce(F.col("text"), F.lit(""))
    short_meta = (F.length(text) < 160) & text.rlike(META)
    italic = F.lower(F.coalesce(F.col("font"), F.lit(""))).contains("italic") & (F.length(text) <= 130) & ~text.rlike(TERMINAL)
    edge = (F.length(text) < 100) & ((F.col("y0") < 0.055 * height) | (F.col("y1") > 0.955 * height))
    return (
        F.when(text.rlike(CAPTION_TABLE), "table_caption").when(text.rlike(CAPTION_FIGURE), "figure_caption").when(in_table, "table")
        .when(text.rlike(PAGE_NUMBER), "meta").when(short_meta, "meta").when(text.rlike(REFERENCE_HEADING), "reference_heading")
        .when(F.coalesce(F.col("math_only"), F.lit(False)), "math_only").when(F.coalesce(F.col("bold"), F.lit(False)) | italic, "heading")
        .when(F.coalesce(edge, F.lit(False)), "meta").otherwise("body")
    )


def reading_order(blocks: DataFrame, barriers: DataFrame | None = None) -> DataFrame:
    """Adds ``position`` (from 0 per page) and ``breaks``: wide blocks and barriers divide the page into zones, read left then right.

    Blocks have paper_id, page, block_key, col, kind and a box; ``barriers`` (paper_id, page, y0, y1) are wide objects without text.
    Zones lie between the lowest bottom so far and the next barrier's top. Blocks centred inside a barrier come last.
    """
    page = ["paper_id", "page"]
    full = blocks.where("col = 'full'").select(*page, F.col("y0").alias("by0"), F.col("y1").alias("by1"), F.col("block_key").alias("bar"))
    bars = full if barriers is None else full.unionByName(barriers.select(*page, F.col("y0").alias("by0"), F.col("y1").alias("by1"), F.lit(None).cast("bigint").alias("bar")))
    order = Window.partitionBy(*page).orderBy("by0", "by1", F.col("bar").asc_nulls_last())
    ranked = bars.withColumn("zone", F.row_number().over(order) - 1)
    above = F.max("by1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    zones = ranked.select(*page, "zone", F.coalesce(above, F.lit(-1e9)).alias("top"), F.col("by0").alias("bottom"))
    tail = ranked.groupBy(*page).agg(F.count("*").cast("int").alias("zone"), F.max("by1").alias("top")).withColumn("bottom", F.lit(1e9))
    zones = zones.unionByName(tail.select(*page, "zone", "top", "bottom"))
    center = (F.col("y0") + F.col("y1")) / 2
    z = zones.select(F.col("paper_id").alias("_d"), F.col("page").alias("_p"), "zone", "top", "bottom")
    b = blocks.withColumn("_c", center)
    placed = b.join(z, (F.col("paper_id") == F.col("_d")) & (F.col("page") == F.col("_p")) & (F.col("col") != "full") & (F.col("_c") >= F.col("top")) & (F.col("_c") < F.col("bottom")), "left")
    marks = ranked.where("bar IS NOT NULL").select(F.col("bar").alias("_k"), F.col("zone").alias("_z"))
    placed = placed.join(marks, F.col("block_key") == F.col("_k"), "left")
    barred = zones.select(F.col("paper_id").alias("_d2"), F.col("page").alias("_p2")).distinct()
    placed = placed.join(barred, (F.col("paper_id") == F.col("_d2")) & (F.col("page") == F.col("_p2")), "left")
    side = F.when(F.col("col") == "left", 0).otherwise(1)
    at = F.coalesce("_z", "zone", F.when(F.col("_d2").isNull(), 0), F.lit(10**6))
    last = at == 10**6
    keys = [at, (F.col("col") == "full").cast("int"), F.when(last, F.col("y0")).otherwise(side), F.when(last, side).otherwise(F.col("y0")), F.col("x0"), F.col("block_key")]
    w = Window.partitionBy(*page).orderBy(*keys)
    out = placed.withColumn("position", (F.row_number().over(w) - 1).cast("int")).withColumn("_at", at)
    first = F.row_number().over(Window.partitionBy(*page, "_at", F.col("col") == "full").orderBy("position")) == 1
    opens = first & (F.col("_at") > 0) & (F.col("_at") < 10**6) & (F.col("position") > 0)
    return out.withColumn("breaks", (F.col("col") == "full") | opens | F.coalesce(F.col("kind").isin(*STRUCTURAL), F.lit(False))).drop("_d", "_p", "zone", "top", "bottom", "_c", "_k", "_z", "_d2", "_p2", "_at")


def page_continuations(blocks: DataFrame, barriers: DataFrame | None = None) -> DataFrame:
    """(paper_id, page, last_key, first_key): paragraphs that run over from a page to the next page number.

    Last and first block of neighbouring pages, publisher's lines aside: both body, no break before the second, and the first without
    terminal mark or the second in lower case. ``barriers`` (paper_id, page, y0, y1): none may begin below the first (1 point of grace) nor end above the
    second; ``blocks`` have y0 and y1 then. Aggregates per page and a join of page and page + 1; no window over a document.
    """
    order = F.struct(F.col("flow_index").isNull(), "flow_index", "block_key")
    row = F.struct("block_key", "kind", "text", "flow_break", *[] if barriers is None else ["y0", "y1"])
    real = blocks.where("coalesce(kind, '') <> 'meta'")
    pages = real.groupBy("paper_id", "page").agg(F.max_by(row, order).alias("l"), F.min_by(row, order).alias("f"))
    free_below = free_above = F.lit(True)
    if barriers is not None:
        pages = pages.join(barriers.groupBy("paper_id", "page").agg(F.max("y0").alias("lowest"), F.min("y1").alias("highest")), ["paper_id", "page"], "left")
        free_below = F.coalesce(F.col("lowest") < F.coalesce("l.y1", F.lit(0.0)) - 1, F.lit(True))
        free_above = F.coalesce(F.col("highest") > F.coalesce("f.y0", F.lit(0.0)) + 1, F.lit(True))
    left, right = pages.select("paper_id", "page", "l", free_below.alias("_below")), pages.select("paper_id", (F.col("page") - 1).alias("page"), "f", free_above.alias("_above"))
    lt, ft = F.regexp_replace(F.coalesce("l.text", F.lit("")), f"{WS}+$", ""), F.regexp_replace(F.coalesce("f.text", F.lit("")), f"^{WS}+", "")
    runs = ((lt != "") & ~lt.rlike(TERMINAL)) | ft.rlike("^[a-z]")
    both = (F.col("l.kind") == "body") & (F.col("f.kind") == "body") & ~F.coalesce("f.flow_break", F.lit(False))
    return left.join(right, ["paper_id", "page"]).where(both & runs & F.col("_below") & F.col("_above")).select("paper_id", "page", F.col("l.block_key").alias("last_key"), F.col("f.block_key").alias("first_key"))


def merge_paragraphs(blocks: DataFrame) -> DataFrame:
    """(paper_id, page, col, members, text, x0, y0, x1, y1): paragraphs of left and right columns merged in order (y0, x0).

    The next block is compared with the merged box and the size of the paragraph's first block, so this is a fold over the blocks
    of a page's column, not a comparison of neighbours.
    """
    item = F.struct("y0", "x0", "block_key", "x1", "y1", "size", "kind", "text")
    columns = blocks.where("col IN ('left', 'right')").groupBy("paper_id", "page", "col").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    one = lambda x: F.struct(F.array(x["block_key"]).alias("members"), x["text"].alias("text"), x["x0"].alias("x0"), x["y0"].alias("y0"), x["x1"].alias("x1"), x["y1"].alias("y1"), x["size"].alias("size"), x["kind"].alias("kind"))
    kind_of = "array<struct<members:array<bigint>,text:string,x0:double,y0:double,x1:double,y1:double,size:double,kind:string>>"

    def fits(a: Column, b: Column) -> Column:
        inter = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
        over = inter / F.greatest(F.lit(1e-6), F.least(a["x1"] - a["x0"], b["x1"] - b["x0"]))
        gap, size, indent = b["y0"] - a["y1"], F.greatest(F.lit(5.0), F.least(a["size"], b["size"])), b["x0"] - a["x0"]
        ta, tb = F.regexp_replace(a["text"], f"{WS}+$", ""), F.regexp_replace(b["text"], f"^{WS}+", "")
        ended, listed = ta.rlike(TERMINAL), tb.rlike("^" + LIST_START)
        near = (gap <= 0.48 * size) | ((ta != "") & ~ended) | tb.rlike("^[a-z]") | ((gap <= 0.72 * size) & (F.abs(indent) <= 4.0))
        return F.coalesce(
            (a["kind"] == "body") & (b["kind"] == "body") & (F.abs(a["size"] - b["size"]) <= 1.0) & (over >= 0.28) & (gap >= -0.35 * size) & (gap <= 1.25 * size)
            & ~listed & ~((indent >= 8.0) & ended) & near, F.lit(False))

    def joined(a: Column, b: Column) -> Column:
        ta, tb = F.regexp_replace(a["text"], f"{WS}+$", ""), F.regexp_replace(b["text"], f"^{WS}+", "")
        text = F.when(ta.endswith("-") & tb.rlike(r"^\p{Ll}"), F.concat(F.regexp_replace(ta, "-$", ""), tb)).otherwise(strip(F.concat(ta, F.lit(" "), tb)))
        return F.struct(
            F.concat(a["members"], F.array(b["block_key"])).alias("members"), clean_text(text).alias("text"), F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"),
            F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"), a["size"].alias("size"), a["kind"].alias("kind"))

    def step(acc: Column, x: Column) -> Column:
        tail = F.get(acc, F.size(acc) - 1)
        merged = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined(tail, x)))
        return F.when((F.size(acc) > 0) & fits(tail, x), merged).otherwise(F.concat(acc, F.array(one(x))))

    folded = columns.withColumn("_m", F.aggregate("_items", F.array().cast(kind_of), step))
    return folded.select("paper_id", "page", "col", F.explode("_m").alias("m")).select("paper_id", "page", "col", "m.members", "m.text", "m.x0", "m.y0", "m.x1", "m.y1")


def nested_parents(blocks: DataFrame, ratio: float = 0.9) -> DataFrame:
    """(paper_id, page, block_key, parent): blocks mostly inside a larger block of their page; the parent is the largest, then the first.

    A block lies inside another if they share more than ``ratio`` of the smaller area and the other's area is larger. Joined within a page only.
    """
    cols = ["x0", "y0", "x1", "y1"]
    a = blocks.select("paper_id", "page", F.col("block_key").alias("parent"), *[F.col(c).alias("p" + c) for c in cols])
    b = blocks.select("paper_id", "page", "block_key", *cols)
    outer, inner = Box.of("p"), Box.of()
    hit = (outer.shared(inner) > ratio * F.least(outer.area, inner.area)) & (inner.area < outer.area)
    pairs = b.join(a, ["paper_id", "page"]).where(hit).withColumn("_area", outer.area)
    return pairs.groupBy("paper_id", "page", "block_key").agg(F.max_by("parent", F.struct("_area", -F.col("parent"))).alias("parent"))


def nested_roots(blocks: DataFrame, ratio: float = 0.9) -> DataFrame:
    """(paper_id, page, block_key, root, level): the outermost block around each nested one, and how many blocks lie around it.

    A parent has a strictly larger area, so chains end. They stay within a page, so each page's links are followed in a map of their own.
    """
    links = nested_parents(blocks, ratio)
    pages = links.groupBy("paper_id", "page").agg(F.map_from_entries(F.collect_list(F.struct("block_key", "parent"))).alias("_up"))

    def climb(at: Column, _: Column) -> Column:
        above = F.try_element_at("_up", at["root"])
        return F.when(above.isNull(), at).otherwise(F.struct(above.alias("root"), (at["level"] + 1).alias("level")))

    start = lambda k: F.struct(F.try_element_at("_up", k).alias("root"), F.lit(1).alias("level"))
    ends = F.transform(F.map_keys("_up"), lambda k: F.struct(k.alias("k"), F.aggregate(F.sequence(F.lit(1), F.size(F.col("_up"))), start(k), climb).alias("e")))
    return pages.select("paper_id", "page", F.explode(ends).alias("_e")).select("paper_id", "page", F.col("_e.k").alias("block_key"), F.col("_e.e.root").alias("root"), F.col("_e.e.level").alias("level"))


def cluster_boxes(blocks: DataFrame, roots: DataFrame) -> DataFrame:
    """(paper_id, page, root, members, x0, y0, x1, y1): each outermost block with what lies inside, and the box around all."""
    inner = roots.select("root", "block_key")
    rows = inner.unionByName(roots.select("root", F.col("root").alias("block_key")).distinct())
    boxes = rows.join(blocks.select("paper_id", "page", "block_key", "x0", "y0", "x1", "y1"), "block_key")
    return boxes.groupBy("paper_id", "page", "root").agg(F.count("*").alias("members"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def actionable(clusters: DataFrame, outer: DataFrame) -> DataFrame:
    """Clusters whose outermost block is no formula, or is translated already. ``outer`` has root, math_only and zh."""
    rows = clusters.join(outer, "root", "left")
    return rows.where(~F.coalesce("math_only", F.lit(False)) | (F.coalesce("zh", F.lit("")) != "")).drop("math_only", "zh")
