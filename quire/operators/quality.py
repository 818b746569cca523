"""Quality checks over translated papers: each gives rows of (check_name, level, value, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CJK, cjk_ratio, no_space, strip
from . import terminology

LEVELS = ("FAIL", "WARN", "PASS", "INFO")


def grade(value: Column, passes: Column, warns: Column) -> Column:
    """PASS, else WARN, else FAIL."""
    return F.when(passes, "PASS").when(warns, "WARN").otherwise("FAIL")


def is_untranslated(zh: Column) -> Column:
    """Nothing, or 15 or more Latin letters, above 60 % of the text without white space, and no Chinese character."""
    zh = no_space(F.coalesce(zh, F.lit("")))
    letters = F.regexp_count(zh, F.lit("[A-Za-z]"))
    return (zh == "") | ((letters >= 15) & (letters > 0.6 * F.length(zh)) & ~zh.rlike(f"[{CJK}]"))


def untranslated(pairs: DataFrame) -> DataFrame:
    """(block_key) of blocks without a translation."""
    return pairs.where(is_untranslated(F.col("zh"))).select("block_key")


def landing(terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """(applicable, landed): terms whose source occurs in a translated block, and those of them whose target occurs in a translation."""
    used = terminology.mentions(terms, pairs.select("block_key", "text")).select("_id")
    landed = terminology.landed(terms, pairs.select("block_key", "zh")).withColumn("_l", F.lit(1))
    return used.join(landed, "_id", "left").agg(F.count("*").alias("applicable"), F.count("_l").alias("landed"))


def merge_runs(entries: DataFrame) -> DataFrame:
    """(block_key, zh, n_runs, overwritten): the last run's translation per block, and how often a run changed the one before."""
    w = Window.partitionBy("block_key").orderBy("run_no", "entry_id")
    rows = entries.withColumn("_before", F.lag("zh").over(w)).withColumn("_n", F.row_number().over(w))
    changed = F.count_if((F.col("_n") > 1) & ~F.col("zh").eqNullSafe(F.col("_before")))
    return rows.groupBy("block_key").agg(F.max_by("zh", "_n").alias("zh"), F.count("*").alias("n_runs"), changed.alias("overwritten"))


def complete(pairs: DataFrame, rendered: DataFrame) -> DataFrame:
    """(block_key, complete): whether the first and last 18 characters of a translation occur in the rendered text of its region, as they are or
    without _ and ^; white space aside. ``rendered`` has block_key and rendered."""
    zh = no_space(F.col("zh"))
    rows = pairs.where(F.length(zh) > 0).select("block_key", zh.alias("_zh")).join(rendered.select("block_key", no_space(F.coalesce("rendered", F.lit(""))).alias("_r")), "block_key", "left")

    def inside(z: Column) -> Column:
        return F.contains(F.col("_r"), F.left(z, F.lit(18))) & F.contains(F.col("_r"), F.right(z, F.lit(18)))

    return rows.select("block_key", F.coalesce(inside(F.col("_zh")) | inside(F.regexp_replace("_zh", "[_^]", "")), F.lit(False)).alias("complete"))


def _row(name: str, value: Column, level: Column, detail: Column) -> Column:
    return F.struct(F.lit(name).alias("check_name"), level.alias("level"), value.cast("double").alias("value"), detail.alias("detail"))


def text_checks(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, check_name, level, value, detail) over ``pairs`` (keys, zh; blocks that should be translated), a row per check and value of the keys:
    untranslated blocks, compatibility characters, blanks (no-break ones too) between Chinese characters."""
    zh = F.coalesce("zh", F.lit(""))
    found = lambda pattern: F.coalesce(F.sum(F.regexp_count(zh, F.lit(pattern))), F.lit(0))
    sums = pairs.groupBy(*keys).agg(F.count_if(is_untranslated(F.col("zh"))).alias("missing"), found(r"[\x{f900}-\x{faff}]").alias("compat"), found(rf"[{CJK}][ \x{{a0}}][{CJK}]").alias("gaps"))
    c = F.col
    rows = [
        _row("untranslated blocks", c("missing"), grade(c("missing"), c("missing") == 0, c("missing") < 10), F.concat(c("missing").cast("string"), F.lit(" blocks"))),
        _row("compatibility characters", c("compat"), grade(c("compat"), c("compat") < 1, c("compat") < 21), F.concat(c("compat").cast("string"), F.lit(" found"))),
        _row("blanks between characters", c("gaps"), grade(c("gaps"), c("gaps") < 50, c("gaps") < 400), F.concat(c("gaps").cast("string"), F.lit(" found"))),
    ]
    return sums.select(*keys, F.explode(F.array(*rows)).alias("_r")).select(*keys, "_r.*")


def cell_checks(cells: DataFrame, dictionary: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, check_name, level, value, detail): the share of table cells with Chinese characters where they are rendered, of those whose text the
    ``dictionary`` (text) has; INFO if it has none of them. ``cells`` has keys, text and rendered."""
    known = cells.join(dictionary.select("text").distinct().withColumn("_known", F.lit(True)), "text", "left")
    done = F.col("_known") & F.coalesce(F.col("rendered").rlike(f"[{CJK}]"), F.lit(False))
    sums = known.groupBy(*keys).agg(F.count("_known").alias("n"), F.count_if(done).alias("k"))
    share = F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(0.0)
    level = F.when(F.col("n") == 0, "INFO").otherwise(grade(share, share >= 0.95, share >= 0.8))
    return sums.select(*keys, _row("table cells", share, level, F.concat_ws("/", "k", "n")).alias("_r")).select(*keys, "_r.*")


#: What separates lines.
_LINES = r"[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]+"


def page_checks(pages: DataFrame, key: str, left_most: float = 0.02, right_least: float = 0.20) -> DataFrame:
    """(key, check_name, level, value, detail) of documents printed side by side, three rows each.

    ``pages`` has key, page, left and right (the text of both halves), expected (whether a translation is expected there) and ignored. Ignored pages
    are left out of all checks but count as pages. Chinese on the left only warns; pages without it on the right, where it is expected, fail a document
    if they are more than three tenths of it, else warn; lines of more than 15 ASCII characters that stand on both sides warn, from ten on they fail.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    long_ = lambda c: F.filter(F.transform(F.split(text(c), _LINES), strip), lambda x: F.length(x) > 15)
    left = F.transform(long_("left"), no_space)
    copied = F.size(F.filter(long_("right"), lambda x: x.rlike(r"^[\x20-\x7e]{15,}$") & F.array_contains(left, no_space(x))))
    seen, wanted = ~F.coalesce("ignored", F.lit(False)), F.coalesce("expected", F.lit(True))
    blank = strip(text("right")) == ""
    sums = pages.groupBy(key).agg(
        F.count("*").alias("n"), F.count_if(seen & (cjk_ratio(text("left")) > left_most)).alias("l"), F.count_if(seen & wanted & ~blank & (cjk_ratio(text("right")) < right_least)).alias("r"),
        F.count_if(seen & wanted & blank).alias("e"), F.coalesce(F.sum(F.when(seen, copied)), F.lit(0)).alias("c"),
    )
    bad = F.col("r") + F.col("e")
    rows = [
        _row("left half unchanged", F.col("l"), F.when(F.col("l") == 0, "PASS").otherwise("WARN"), F.concat(F.col("l").cast("string"), F.lit(" pages"))),
        _row("right half translated", bad, F.when(bad == 0, "PASS").when(bad > 0.3 * F.col("n"), "FAIL").otherwise("WARN"), F.concat(F.col("r").cast("string"), F.lit(" pages, "), F.col("e").cast("string"), F.lit(" blank"))),
        _row("copied lines", F.col("c"), grade(F.col("c"), F.col("c") == 0, F.col("c") < 10), F.concat(F.col("c").cast("string"), F.lit(" lines"))),
    ]
    return sums.select(key, F.explode(F.array(*rows)).alias("_r")).select(key, "_r.*")


def report(pairs: DataFrame, terms: DataFrame, cells: DataFrame | None = None, dictionary: DataFrame | None = None) -> DataFrame:
    """One row per check over ``pairs`` (block_key, text, zh; blocks that should be translated), ``terms`` (_id, source, target) and, if given, ``cells``
    (text, rendered) with their ``dictionary``."""
    rate = F.when(F.col("applicable") > 0, F.col("landed") / F.col("applicable")).otherwise(0.0)
    land = landing(terms, pairs.where("zh <> ''")).select(_row("terms landed", rate, grade(rate, rate >= 0.8, rate >= 0.6), F.concat_ws("/", "landed", "applicable")).alias("_r")).select("_r.*")
    out = text_checks(pairs, []).unionByName(land)
    return out if cells is None else out.unionByName(cell_checks(cells, dictionary, []))


def document_checks(original: DataFrame, rendered: DataFrame, key: str) -> DataFrame:
    """(key, check_name, level): pages equal and first page's width doubled (1.85 to 2.15 times), or FAIL; contents equal and images not fewer, or WARN.

    Both have key, n_pages, width, n_toc and n_images; a document without rendering fails the first two and warns of the others.
    """
    r = rendered.select(key, *[F.col(c).alias("_" + c) for c in ("n_pages", "width", "n_toc", "n_images")])
    both = original.join(r, key, "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    ratio = F.col("_width") / F.col("width")
    checks = {
        "pages": F.when(yes(F.col("n_pages") == F.col("_n_pages")), "PASS").otherwise("FAIL"), "width": F.when(yes(ratio.between(1.85, 2.15)), "PASS").otherwise("FAIL"),
        "contents": F.when(yes(F.col("n_toc") == F.col("_n_toc")), "PASS").otherwise("WARN"), "images": F.when(yes(F.col("_n_images") >= F.col("n_images")), "PASS").otherwise("WARN"),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), level.alias("level")) for n, level in checks.items()]))
    return both.select(key, rows.alias("_c")).select(key, "_c.*")


def summary(checks: DataFrame) -> DataFrame:
    """(level, n_checks, failed): checks by level, and whether any failed."""
    counts = checks.groupBy("level").agg(F.count("*").alias("n_checks"))
    return counts.withColumn("failed", F.col("level") == "FAIL")


def exits(checks: DataFrame, key: str) -> DataFrame:
    """(key, n_pass, n_warn, n_fail, exit_code): the checks of each document, and 1 if any failed."""
    count = lambda level: F.count_if(F.col("level") == level)
    return checks.groupBy(key).agg(count("PASS").alias("n_pass"), count("WARN").alias("n_warn"), count("FAIL").alias("n_fail"), F.max((F.col("level") == "FAIL").cast("int")).alias("exit_code"))
