"""Markup and page arithmetic of the rendering decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Capital letters that are symbols when they stand alone (fixed value).
SYMBOL_LETTERS = "SAPRDEFQLMNK"
GREEK = r"\x{391}-\x{3a9}\x{3b1}-\x{3c9}"


def math_markup(text: Column) -> Column:
    """Sub- and superscripts, Greek letters and lone symbol letters as markup, in this order; letters in brackets are labels and stay."""
    out = F.regexp_replace(text, rf"([A-Za-z{GREEK}])_([A-Za-z0-9]{{1,15}}(?:,[A-Za-z0-9]{{1,3}})?)", '<span class="m">$1</span><sub>$2</sub>')
    out = F.regexp_replace(out, rf"([A-Za-z0-9{GREEK}])\^\(?([A-Za-z0-9+\-−]{{1,6}})\)?", '<span class="m">$1</span><sup>$2</sup>')
    out = F.regexp_replace(out, f"([{GREEK}])", '<span class="m">$1</span>')
    return F.regexp_replace(out, rf"(?<![A-Za-z0-9_（(<])([{SYMBOL_LETTERS}])(?![a-z0-9A-Z>(])", '<span class="m">$1</span>')


def css(font: Column, size: Column, align: Column, line_height: Column) -> Column:
    """Style of a text box; ``align`` is 0 left, 1 centre, 2 right, 3 justified."""
    names = F.array(*[F.lit(a) for a in ("left", "center", "right", "justify")])
    return F.format_string("@font-face{font-family:base;src:url(%s)}body{font-family:base;font-size:%spt;line-height:%s;text-align:%s;margin:0}.m{font-style:italic}", font, size.cast("string"), line_height.cast("string"), F.get(names, align))


def rectangle(spec: Column) -> Column:
    """x0,y0,x1,y1 as an array of four numbers, null if they aren't four."""
    parts = F.transform(F.split(spec, ","), lambda p: F.trim(p).try_cast("double"))
    return F.when((F.size(parts) == 4) & ~F.exists(parts, lambda v: v.isNull()), parts)


def half(width: Column, height: Column, which: Column) -> Column:
    """The left or right half of a page, or the whole."""
    zero = F.lit(0.0)
    return F.when(which == "left", F.array(zero, zero, width / 2, height)).when(which == "right", F.array(width / 2, zero, width, height)).otherwise(F.array(zero, zero, width, height))


def panels(n: Column, columns: Column, width: Column, height: Column) -> Column:
    """Boxes of ``n`` panels in a grid of so many columns, row by row."""
    place = lambda i: F.array((i % columns) * width, F.floor(i / columns) * height, (i % columns + 1) * width, (F.floor(i / columns) + 1) * height)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), place)).otherwise(F.array().cast("array<array<double>>"))
