"""Problem 3: one spelling for texts that look the same.

A transducer is compiled once from mapping rules and applied in one left-to-right pass over grapheme clusters, longest
match first. Its rules: full-width and mathematical letters and digits and typographic ligatures become plain letters one
by one; base plus combining accents becomes the composed letter; every space becomes the plain space; hyphens that look
like the plain one become it; radicals and compatibility ideographs become unified ideographs; characters without width
and control characters (but for line breaks) disappear; Greek and Cyrillic letters that look like Latin ones become Latin
within a Latin word. A rule set in which one input has two outputs, or an output is itself changed by a rule, is refused.

Only values holding a character that starts some rule leave the JVM: a ``rlike`` on a class compiled from the same rules
is the gate, so that ordinary texts (the mass of the data) never reach Python.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import col, pick, table

#: Letters of other scripts that look like a Latin letter (fixed values, by script, in code point order).
GREEK_LOOKALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ο": "o", "ϲ": "c", "ϳ": "j", "Ϲ": "C",
}
CYRILLIC_LOOKALIKES = {
    "Ѕ": "S", "І": "I", "Ј": "J", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i",
    "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "Ԛ": "Q", "Ԝ": "W", "ѵ": "v", "Ѵ": "V", "ӏ": "l", "Ӏ": "I",
}
OTHER_LOOKALIKES = {"ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "օ": "o", "Օ": "O", "Տ": "S", "հ": "h", "ս": "u"}
HYPHENS = "‐‑﹣－"
LINE_BREAKS = "\n\r\u0085\u2028\u2029"
#: Marks that only choose a glyph for the character before them.
SELECTORS = [chr(c) for c in (*range(0xFE00, 0xFE10), *range(0x180B, 0x180E), 0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)]


class MappingConflict(ValueError):
    """Two rules disagree, or the output of one rule is the input of another."""


def _plain_rules() -> dict[str, str]:
    """Context-free rules of single characters, found in the planes of the character database that have any."""
    rules: dict[str, str] = {}
    for cp in (*range(0x10000), *range(0x1BCA0, 0x1BCA4), *range(0x1D100, 0x1D800), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)):
        c = chr(cp)
        kind = unicodedata.category(c)
        if c in LINE_BREAKS or kind in ("Cn", "Co", "Cs"):
            continue
        if kind == "Zs":
            if c != " ":
                rules[c] = " "
        elif c == "\t":
            rules[c] = " "
        elif kind in ("Cf", "Cc"):
            rules[c] = ""
        elif unicodedata.normalize("NFC", c) != c and len(unicodedata.normalize("NFC", c)) == 1 and not 0x0370 <= cp <= 0x03FF and not 0x1F00 <= cp <= 0x1FFF:
            rules[c] = unicodedata.normalize("NFC", c)  # compatibility ideographs, the signs for ohm, kelvin and angstrom
        elif 0x2E80 <= cp <= 0x2FD5:
            to = unicodedata.normalize("NFKC", c)
            if to != c and len(to) == 1:
                rules[c] = to
        elif 0xFF10 <= cp <= 0xFF5A or 0x1D400 <= cp <= 0x1D6A3 or 0x1D7CE <= cp <= 0x1D7FF or 0xFB00 <= cp <= 0xFB06 or 0x2160 <= cp <= 0x217F or cp in (0x0132, 0x0133, 0x01C4, 0x01C5, 0x01C6, 0x01C7, 0x01C8, 0x01C9, 0x01CA, 0x01CB, 0x01CC, 0x01F1, 0x01F2, 0x01F3):
            to = unicodedata.normalize("NFKC", c)
            if to != c and all(unicodedata.category(x)[0] in "LN" for x in to) and kind[0] in "LN":
                rules[c] = to
        elif c == "µ":
            rules[c] = "μ"
    rules |= dict.fromkeys(HYPHENS, "-") | dict.fromkeys(SELECTORS, "")
    return rules


def check_rules(rules: list[tuple[str, str]]) -> dict[str, str]:
    """The rules as a table; refuses two outputs of one input, and outputs that another rule would change again."""
    out: dict[str, str] = {}
    for source, target in rules:
        if not source or out.setdefault(source, target) != target:
            raise MappingConflict(f"{source!r} has two outputs or is empty")
    for source, target in out.items():
        if any(c in out for c in target):
            raise MappingConflict(f"the output of {source!r} is mapped again")
    return out


def _char_class(chars: list[str], escape: str) -> str:
    """Sorted code points as ranges of a regular expression's class; ``escape`` formats a code point."""
    points, parts = sorted(map(ord, chars)), []
    i = 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        parts.append(escape % points[i] + (f"-{escape % points[j]}" if j > i else ""))
        i = j + 1
    return "".join(parts)


class Transducer:
    """Compiled rules: ``apply`` is one pass, ``gate`` the Java pattern of values that may change."""

    def __init__(self) -> None:
        self.plain = check_rules([*_plain_rules().items()])
        pairs = [*GREEK_LOOKALIKES.items(), *CYRILLIC_LOOKALIKES.items(), *OTHER_LOOKALIKES.items()]
        self.looks = check_rules(pairs)
        check_rules([*self.plain.items(), *pairs])
        plain, looks = _char_class([*self.plain], r"\U%08x"), _char_class([*self.looks], r"\U%08x")
        skip = _char_class([c for c, to in self.plain.items() if not to], r"\U%08x")
        wide = _char_class([c for c, to in self.plain.items() if to.isalpha() and to.isascii()], r"\U%08x")
        #: A word, perhaps with inner hyphens, of Latin letters and letters that look Latin; then a cluster with combining marks; then single characters.
        letter = rf"(?:[\p{{Latin}}{looks}{wide}]\p{{M}}*[{skip}]*)"
        word = rf"{letter}+(?:[-{HYPHENS}]{letter}+)*"
        self.pattern = regex.compile(rf"(?P<word>{word})|(?P<cluster>[^\s\p{{M}}][{skip}]*\p{{M}}[\p{{M}}{skip}]*)|(?P<one>[{plain}]+)")
        self.has_look = regex.compile(f"[{looks}]")
        self.latin = regex.compile(rf"[\p{{Latin}}{wide}]")
        self.near_word = regex.compile(r"[\p{Greek}\p{Cyrillic}\p{Armenian}]")
        #: What can't be told from ordinary text by this class can't change.
        marks = [chr(cp) for cp in range(0x10000) if unicodedata.category(chr(cp))[0] == "M"]
        bmp = _char_class([*{*(c for c in (*self.plain, *self.looks) if c <= "\uffff"), *marks}], r"\U%08x")
        self.suspect = re.compile(f"[{bmp}]")
        self.beyond = re.compile("[\U00010000-\U0010ffff]")  # apart, as a class within one plane is a bitmap
        java = _char_class([*self.plain, *self.looks], r"\x{%x}")
        self.gate = rf"[\p{{M}}{java}]"
        #: Most texts hold only ASCII, unified ideographs and a few other characters. Nested in this order, the class tells
        #: them after one or two comparisons, many times faster than the gate.
        others = [chr(c) for a, b in ((0xC0, 0x17F), (0x3B1, 0x3C9), (0xFF01, 0xFF0C), (0x3001, 0x3002)) for c in range(a, b + 1)]
        others += "\nΔΣ“”‘’…—–≤≥←→∝：；？（）《》"
        others = [c for c in dict.fromkeys(others) if c not in self.plain and c not in self.looks]
        self.quick = rf"[^ -~[\x{{4e00}}-\x{{9fff}}[{_char_class(others, r'\x{%x}')}]]]"

    def _one(self, s: str) -> str:
        plain = self.plain
        return "".join([plain.get(c, c) for c in s])

    def _match(self, m: regex.Match) -> str:
        s = m[0]
        if m.lastgroup == "one":
            return self._one(s)
        if m.lastgroup == "word" and self.has_look.search(s):
            text, at, to = m.string, m.start(), m.end()
            inside_other = (at and self.near_word.match(text[at - 1])) or (to < len(text) and self.near_word.match(text[to]))
            if not inside_other and self.latin.search(s):
                looks = self.looks
                s = "".join([looks.get(c, c) for c in s])
        return unicodedata.normalize("NFC", self._one(s))

    def apply(self, s: str) -> str:
        """The canonical spelling of ``s``."""
        return self.pattern.sub(self._match, s) if self.suspect.search(s) or self.beyond.search(s) else s


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    """The compiled transducer of this process."""
    return Transducer()


def may_change(text: Column) -> Column:
    """True for values that hold a character which starts a rule (null for null)."""
    t = transducer()
    return text.rlike(t.quick) & text.rlike(t.gate)


@F.pandas_udf(StringType())
def _canonical(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    apply = transducer().apply
    for s in parts:
        yield s.map(lambda x: None if x is None else apply(x))


def canonical(text: Column) -> Column:
    """The canonical spelling of a text column; null stays null, an empty text empty. Applying it twice changes nothing."""
    return _canonical(text)


def canonical_values(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the column ``text`` in canonical spelling.

    Null and empty texts, repeated rows and all other columns stay as they are. Values that no rule can change bypass Python.
    """
    hit = may_change(col(text))
    gated = F.when(hit, col(text))  # Python gets nulls, not texts, for the mass of the rows
    done = df.withColumn("_q3_new", canonical(gated))
    return done.withColumn(text, F.coalesce(F.col("_q3_new"), col(text))).drop("_q3_new")


def changed_values(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row ``(_key, _new)`` per row of ``df`` whose text isn't in canonical spelling; null and empty texts give none."""
    rows = pick(df, _key=key, _text=text).where(may_change(F.col("_text")))
    return rows.withColumn("_new", canonical(F.col("_text"))).where("_new <> _text").select("_key", "_new")


TABLES = (("blocks", "block_key", "text"), ("translations", "entry_id", "zh"), ("glossary", "gid", "target"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tab, row_no) of values not in ordinary spelling. Re-delivered rows give one row."""
    parts = [
        changed_values(table(spark, sf_dir, tab), key, text).select(F.lit(tab).alias("tab"), F.col("_key").cast("bigint").alias("row_no"))
        for tab, key, text in TABLES
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


QUERIES = {"p3_found": p3_found}
ORACLES: dict[str, str] = {}
