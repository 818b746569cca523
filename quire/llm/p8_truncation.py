"""Problem 8: texts cut off by field limits or in transfer.

Per source, histograms of the lengths in characters and in bytes are tested for spikes: a length that occurs far more often
than the lengths around it is a field's limit. A value at such a length that ends without terminal punctuation was cut, by odds
of how many times more often than usual the length occurs.

A cut in transfer leaves no spike, and a sign put after a cut ("...", "[...]") moves it; and a keyword line may happen to have a
spike's length. So the ending of every value without terminal punctuation is weighed as well, by naive Bayes over character
bigrams: whether its last line reads like running prose, which doesn't end so, or like the lines that do (headings, captions,
keywords, references, table rows, formulas, closing remarks). A number with a full stop counts as broken off if paragraphs
hardly ever end so. Both classes are learned from the paragraphs and endings of all documents, counted by the tasks; no wordings are
listed. The odds of both, added up, decide.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import Count, cut_lineage, gathered, pick, summed, table, tally, tally_here
from .p1_pair_defects import LANGUAGES, NgramClasses

_DIGITS = regex.compile(r"\d+")
#: Signs that follow a break: blanks, ellipses, bracketed ellipses, the replacement character, characters without width.
SIGNS = regex.compile(r"(?:[\s\u3000…⋯�\u200b-\u200d\u2060\ufeff\xad]|\.{3,}|\[(?:\.{2,}|…+)\]|\((?:\.{2,}|…+)\)|（(?:…+|\.{2,})）|【(?:…+)】)+$")
END = regex.compile(r"[.!?。！？｡؟]['\"”’»）)\]』」〉》]*$")
#: Words with a full stop that doesn't end a sentence.
ABBREVIATION = regex.compile(r"\b(?i:figs?|al|approx|eqs?|tab|nos?|vs|e\.g|i\.e|cf|resp|dr|prof|sec|ca|bzw|vgl|z\.\s?b)\.$")
#: Widest line of a hard-wrapped text; a longer line wasn't wrapped.
WRAP = 100


#: The blanks of \s in ``regex``, which ``re`` has more of.
_BLANKS = "".join(regex.findall(r"\s", "".join(map(chr, range(0x3001)))))
#: All characters that SIGNS, and that the last part of END may hold.
_SIGN_CHARACTERS, _CLOSERS = _BLANKS + "…⋯\ufffd\u200b\u200c\u200d\u2060\ufeff\xad.[]()（）【】", "'\"”’»）)]』」〉》"
#: Ends of sentences; after the first three and their blanks only what ``_opens`` follows.
_SENTENCE_END = re.compile(rf"[.!?。！？](?:(?<=[.!?])(['\"”’)\]]?)[{_BLANKS}]+|(?<=[。！？])([”’』」》）]?))")


@lru_cache(1 << 16)
def _opens(character: str) -> bool:
    """Whether a sentence may begin with ``character``."""
    return regex.match(r"\p{Lu}|\d", character) is not None


def sentence_starts(paragraph: str) -> list[str]:
    """Roughly the sentences of a paragraph, with wrapped lines joined; of each the first ``Starts.SIZE`` tokens."""
    text = paragraph.replace("\n", " ")
    spans, at = [], 0
    for m in _SENTENCE_END.finditer(text):
        end = m.end()
        if m[2] is None:
            if end < len(text) and _opens(text[end]):
                spans.append((at, m.end(1)))
                at = end
        else:
            spans.append((at, m.start(2)))
            at = m.start(2)
            if m[2]:
                spans.append((at, end))
                at = end
    spans.append((at, len(text)))
    return [m[0] for lo, hi in spans if (m := _FIRST.match(text, lo, hi)) and not text[lo:hi].isspace()]


def _ends(text: str) -> bool:
    """Whether ``text``, which doesn't end with a blank, matches END; looking at its last characters, as a search reads it all."""
    return bool(bare := text.rstrip(_CLOSERS)) and bare[-1] in ".!?。！？｡؟"


def _abbreviated(text: str) -> bool:
    """Whether ``text`` matches ABBREVIATION, which has fewer than 20 characters."""
    return text.endswith(".") and ABBREVIATION.search(text[-20:]) is not None


def last_unit(paragraph: str, numbers: bool = False) -> str | None:
    """What a text without terminal punctuation ends with: its last line, and the lines that this one continues if they are wrapped.
    None if the text ends with terminal punctuation, '' if there is no text. ``numbers``: a full stop after a digit is none."""
    core = paragraph.rstrip(_SIGN_CHARACTERS)
    core += SIGNS.sub("", paragraph[len(core) :])
    if _ends(core) and not _abbreviated(core) and not (numbers and NUMBER.search(core[-2:])):
        return None
    lines = core.split("\n")
    back = len(lines) - 1
    while back:
        before = lines[back - 1].strip()
        if before.startswith("|") or len(lines[back]) > WRAP or not WRAP // 2 <= len(before) <= WRAP or (_ends(before) and not _abbreviated(before)):
            break
        back -= 1
    return " ".join(x.strip() for x in lines[back:]).strip()


#: The first tokens of a line: words and signs, Chinese characters and kana one by one, each with the blank before it.
_START = regex.compile(r"\s?(?:[\p{Han}\p{Hiragana}\p{Katakana}]|[^\s\p{Han}\p{Hiragana}\p{Katakana}]+)")
_FIRST = regex.compile(rf"\s*?{_START.pattern}(?:\s*?{_START.pattern}){{0,3}}")
_LETTERS, _CHARACTERS = regex.compile(r"[^\W\d_\p{Han}\p{Hiragana}\p{Katakana}]+"), regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
#: A number with a full stop, which may be a decimal point.
NUMBER = regex.compile(r"\d\.$")


@lru_cache(1 << 16)
def _shape(token: str) -> tuple[str, str]:
    """A token in lower case with numbers as 0, and its shape."""
    token = _DIGITS.sub("0", token.lower())
    return token, _CHARACTERS.sub("c", _LETTERS.sub("a", token))


class Starts:
    """How lines of a class start: each of the first ``SIZE`` tokens given those before it, unseen ones by their shape."""

    SIZE = 4

    def __init__(self, seen: Counter, shapes: Counter):
        """What ``count`` counted."""
        self.seen, self.shapes = seen, shapes

    @classmethod
    def count(cls, lines: list[str], seen: Counter, shapes: Counter, times: int = 1) -> None:
        """Add the starts of ``lines``, each ``times`` times; a token is named by those before it, a new line and itself. Lines that start alike are read once."""
        for line, n in Counter(m[0] for line in lines if (m := _FIRST.match(line))).items():
            for before, token, shape_before, shape in cls.steps(line):
                for counter, key, given in ((seen, f"{before}\n{token}", before), (shapes, f"{shape_before}\n{shape}", shape_before)):
                    counter[key] += n * times
                    counter[given] += n * times

    @classmethod
    def steps(cls, line: str) -> Iterator[tuple[str, str, str, str]]:
        before = shape_before = ""
        for m in islice(_START.finditer(line), cls.SIZE):
            token, shape = _shape(m[0])
            yield before, token, shape_before, shape
            before, shape_before = f"{before}|{token}", f"{shape_before}|{shape}"[-12:]

    def log_likelihood(self, steps: list[tuple[str, str, str, str]]) -> float:
        """Of a line with these ``steps``."""
        total = 0.0
        for before, token, shape_before, shape in steps:
            by_shape = (self.shapes[f"{shape_before}\n{shape}"] + 0.1) / (self.shapes[shape_before] + 10)
            total += math.log((self.seen[f"{before}\n{token}"] + by_shape) / (self.seen[before] + 1))
        return total


def _count_class(name: str, lines: list[str], starts: list[str], held: Counter, times: int = 1) -> None:
    """Bigrams of ``lines``, and how ``starts`` start."""
    for pair, n in NgramClasses.count(lines).items():
        held[name, pair] += n * times
    seen: Counter = Counter()
    shapes: Counter = Counter()
    Starts.count(starts, seen, shapes, times)
    for kind, counter in ((f"{name} seen", seen), (f"{name} shapes", shapes)):
        for item, n in counter.items():
            held[kind, item] += n


def _count_paragraphs(part: pd.DataFrame, held: Counter) -> None:
    """Of texts (_text, _limit: the length is a spike): the classes 'prose' and 'line', how many paragraphs end with a mark ('ends') or a
    number and a full stop ('numbers'), the lines that texts end with ('open'), and what starts are looked up for these ('wanted')."""
    prose, lines, judged = [], [], []
    for text, limit in zip(part["_text"], part["_limit"]):
        paragraphs = text.split("\n\n")
        for n, p in enumerate(paragraphs):
            inside = n < len(paragraphs) - 1
            unit = last_unit(p)
            if unit is None:
                prose.append(p)
                held["ends", ""] += inside
                held["numbers", ""] += inside and bool(NUMBER.search(p.rstrip()[-2:]))
            elif unit and inside:
                lines.append(unit)  # it ends so inside a text, where nothing was cut
            elif unit and not limit:
                held["open", unit] += 1
        if unit := last_unit(paragraphs[-1], numbers=True):
            judged.append(unit)
    held["lines", ""] += len(lines)
    _count_class("prose", prose, [s for p in prose for s in sentence_starts(p)], held)
    _count_class("line", lines, lines, held)
    for unit in judged:
        for before, token, _, _ in Starts.steps(unit):
            held["wanted", before] += 1
            held["wanted", f"{before}\n{token}"] += 1


def _count_ends(model: Prose | Broadcast | None) -> Count:
    """The class 'line' of the ends (item, n) of texts that ``model`` is sure of, or of all."""

    def count(part: pd.DataFrame, held: Counter) -> None:
        prose = model.value if isinstance(model, Broadcast) else model
        if prose is not None and len(part):
            part = part[prose.odds(part["item"].tolist()) <= -prose.SURE]
        for times, units in part.groupby("n")["item"]:
            held["lines", ""] += len(units) * int(times)
            _count_class("line", units.tolist(), units.tolist(), held, int(times))

    return count


class Prose:
    """Tells running prose from lines that end without terminal punctuation, by how a line starts and by its bigrams.

    Bigrams of one line depend on each other, so their mean odds count ``WEIGHT`` times, however long the line, and at most ``MOST``, so that
    a clear start outweighs them. Ends of texts are learned as lines only if prose is less likely by ``SURE``.
    """

    WEIGHT, MOST, SURE = 25, 6, 8

    def __init__(self, texts: list[str], at_limit: list[bool] | None = None):
        """``at_limit``: texts whose length is a spike; how they end isn't learned from, as they are most likely cut."""
        counted = tally_here(pd.DataFrame({"_text": pd.Series(texts, dtype=object), "_limit": pd.Series(at_limit or [False] * len(texts), dtype=bool)}), _count_paragraphs)
        ends = pd.DataFrame([*counted.get("open", {}).items()], columns=["item", "n"])
        self._learn(counted, lambda count: tally_here(ends, count), lambda model: model)

    @classmethod
    def learned(cls, texts: DataFrame) -> Prose:
        """The classes from all rows (_text, _limit) of ``texts``. They judge these rows' ends as if learned by ``Prose(texts)``: of the starts
        of sentences, the driver gets those that an end of a row begins with."""
        counts = cut_lineage(summed(texts, _count_paragraphs))
        starts = F.col("kind").isin("prose seen", "line seen")
        wanted = counts.where("kind = 'wanted'").select(F.col("item").alias("_wanted"))
        few = counts.where(~starts & ~F.col("kind").isin("open", "wanted"))
        counted = gathered(few.unionByName(counts.where(starts).join(wanted, F.col("item") == F.col("_wanted"), "left_semi")))
        ends = counts.where("kind = 'open'").select("item", "n")
        sent: list[Broadcast] = []

        def send(model: Prose) -> Broadcast:
            sent.append(texts.sparkSession.sparkContext.broadcast(model))
            return sent[-1]

        prose = cls.__new__(cls)
        prose._learn(counted, lambda count: tally(ends, count), send)
        for held in sent:
            held.destroy()
        return prose

    def _learn(self, counted: dict[str, Counter], run: Callable[[Count], dict[str, Counter]], send: Callable) -> None:
        known: Counter = Counter()
        examples = [*LANGUAGES.values()]
        _count_class("prose", examples, [s for p in examples for s in sentence_starts(p)], known)
        for kind, items in counted.items():
            for item, n in items.items():
                known[kind, item] += n

        def of(kind: str) -> Counter:
            return Counter({item: n for (k, item), n in known.items() if k == kind})

        # a number and a full stop at the end: a cut, if paragraphs hardly ever end so and a cut text, itself one in twenty, does once in a hundred
        self.number_odds = math.log(0.05 * 0.01 / 0.95) - math.log((known["numbers", ""] + 0.5) / (known["ends", ""] + 1))
        # the ends of texts hold cut prose: they are told by what they look like and learned from again
        prose, lines, seen, shapes = of("prose"), of("line"), of("line seen"), of("line shapes")
        self.starts = Starts(of("prose seen"), of("prose shapes"))
        held = run(_count_ends(None))
        for n in range(4):
            self.classes = NgramClasses({"prose": prose, "line": lines + held.get("line", Counter())})
            self.line_starts = Starts(seen + held.get("line seen", Counter()), shapes + held.get("line shapes", Counter()))
            self.known = known["lines", ""] + held.get("lines", Counter())[""]
            if n < 3:
                held = run(_count_ends(send(self)))

    def odds(self, units: list[str]) -> np.ndarray:
        """Log odds of prose; the fewer lines are known, the less they count, and without any a text that just ends is taken to be cut."""
        trust = self.known / (self.known + 20)
        mean = self.classes.odds(units, "prose", "line") / np.maximum(1, np.array([len(u) for u in units]))
        starts = np.array([self.starts.log_likelihood(s) - self.line_starts.log_likelihood(s) for s in ([*Starts.steps(u)] for u in units)])
        return 0.5 + trust * (np.clip(self.WEIGHT * mean, -self.MOST, self.MOST) + starts)


def _broken(held: Broadcast):
    @F.pandas_udf(DoubleType())
    def broken(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        prose: Prose = held.value
        for paragraphs in parts:
            units = [None if p is None else last_unit(p, numbers=True) for p in paragraphs]
            at = [i for i, u in enumerate(units) if u]
            out = np.full(len(units), -np.inf)
            out[at] = prose.odds([units[i] for i in at])
            number = [i for i in at if NUMBER.search(units[i])]
            out[number] = np.minimum(out[number], prose.number_odds)
            yield pd.Series(out)

    return broken


def broken_odds(text: Column, held: Broadcast) -> Column:
    """Log odds that a text breaks off in prose, judged by its ending alone; minus infinity for texts that end with terminal punctuation,
    have no words or are null. Most texts plainly end with a sentence: they don't leave the JVM, and only their last signs are read there."""
    blanks = F.lit(" \n\r\t\u3000")
    tail = F.rtrim(F.right(text, F.lit(32)), blanks)
    plain = tail.rlike(r"[\p{L}\p{N}%）)][。！？!?]$|[a-z]{4,}[)%]?\.$|%\.$") & ~tail.rlike(r"\b(?i:figs?|approx)\.$")
    # trimming costs far more than looking at the last character
    trimmed = F.when(F.right(text, F.lit(1)).rlike(r"[ \n\r\t\x{3000}]"), F.rtrim(text, blanks)).otherwise(text)
    never = F.lit(float("-inf"))
    return F.when(text.isNull() | plain, never).otherwise(_broken(held)(F.when(~plain, F.substring_index(trimmed, "\n\n", -1))))


def spikes(lengths: DataFrame, near: int = 50, least: int = 8, factor: float = 8.0) -> DataFrame:
    """(source, unit, length, times) of lengths that occur at least ``least`` times and ``factor`` times as often as those within ``near``
    around; ``times`` is how many times as often.

    ``lengths`` has (source, unit, length), a row per value; it is counted before anything is ordered, so a source with a third of
    all rows costs one row per distinct length.
    """
    counts = lengths.groupBy("source", "unit", "length").agg(F.count("*").alias("n"))
    around = Window.partitionBy("source", "unit").orderBy("length").rangeBetween(-near, near)
    usual = F.greatest((F.sum("n").over(around) - F.col("n")) / F.lit(2.0 * near), F.lit(0.25))
    return counts.withColumn("times", F.col("n") / usual).where((F.col("n") >= least) & (F.col("times") >= factor)).select("source", "unit", "length", "times")


def with_limits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (_source, _chars, _bytes and others) with _times: how much more frequent than usual its length in characters or bytes is."""
    one = found.where("unit = 'chars'").select(F.col("source").alias("_s1"), F.col("length").alias("_l1"), F.col("times").alias("_t1"))
    two = found.where("unit = 'bytes'").select(F.col("source").alias("_s2"), F.col("length").alias("_l2"), F.col("times").alias("_t2"))
    name = F.coalesce(F.col("_source"), F.lit(""))
    out = rows.join(one, (name == F.col("_s1")) & (F.col("_chars") == F.col("_l1")), "left").join(two, (name == F.col("_s2")) & (F.col("_bytes") == F.col("_l2")), "left")
    return out.withColumn("_times", F.coalesce(F.greatest("_t1", "_t2"), F.lit(1.0))).drop("_s1", "_l1", "_t1", "_s2", "_l2", "_t2")  # greatest leaves nulls out


def _measured(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    rows = pick(df, _key=key, _text=text, _source=source)
    return rows.withColumns({"_chars": F.length("_text").cast("bigint"), "_bytes": F.octet_length("_text").cast("bigint")})


def lengths_of(rows: DataFrame) -> DataFrame:
    """(source, unit, length) of measured rows, two for each."""
    each = F.array(F.struct(F.lit("chars").alias("unit"), F.col("_chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("_bytes").alias("length")))
    return rows.where("_text IS NOT NULL").select(F.coalesce(F.col("_source"), F.lit("")).alias("source"), F.explode(each).alias("_l")).select("source", "_l.*")


def learn(rows: DataFrame, found: DataFrame) -> Prose:
    """The classes from all texts."""
    return Prose.learned(with_limits(rows.where("_text IS NOT NULL"), found).select("_text", (F.col("_times") > 1).alias("_limit")))


def decided() -> Column:
    """Whether a row is cut: the odds of its ending and those of its length together."""
    return F.col("_odds") + F.ln("_times") > 0


def truncated(df: DataFrame, key: str, text: str, source: str, prose: Prose | None = None) -> DataFrame:
    """(_key, _source, _odds, _times, limit, cut) per row of ``df``.

    ``limit``: the length in characters or bytes is a spike of its source, ``_times`` as frequent as usual; ``_odds``: of prose broken off,
    by the ending; ``cut``: the text was cut off. Null and blank texts, and texts with terminal punctuation, are not cut. A null source
    is a source of its own. Copies are judged alike. An empty table gives no rows.
    """
    rows = _measured(df, key, text, source)
    found = cut_lineage(spikes(lengths_of(rows)))
    held = df.sparkSession.sparkContext.broadcast(prose or learn(rows, found))  # grows with the distinct bigrams and starts of the texts' ends
    judged = rows.withColumn("_odds", broken_odds(F.col("_text"), held)).drop("_text")
    return with_limits(judged, found).withColumn("limit", F.col("_times") > 1).withColumn("cut", decided()).drop("_chars", "_bytes")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id) of every document whose text was cut off."""
    return truncated(table(spark, sf_dir, "documents"), "doc_id", "text", "source").where("cut").select(F.col("_key").alias("doc_id")).distinct()


def p8_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, documents, cut, at_limit, share): how often each source cuts its texts, and how many of the cuts are at a length spike."""
    rows = truncated(table(spark, sf_dir, "documents"), "doc_id", "text", "source").dropDuplicates(["_key"])
    out = rows.groupBy(F.col("_source").alias("source")).agg(
        F.count("*").alias("documents"), F.count_if(F.col("cut")).alias("cut"), F.count_if(F.col("cut") & F.col("limit")).alias("at_limit")
    )
    return out.withColumn("share", F.col("cut") / F.col("documents"))


def p8_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, unit, length): the field limits of each source, told by length spikes. Re-delivered rows count."""
    return spikes(lengths_of(_measured(table(spark, sf_dir, "documents"), "doc_id", "text", "source"))).select("source", "unit", "length")


QUERIES = {"p8_found": p8_found, "p8_sources": p8_sources, "p8_limits": p8_limits}
ORACLES = {
    "p8_limits": """WITH l AS (SELECT coalesce(source, '') AS source, unnest(['chars', 'bytes']) AS unit, unnest([length(text), strlen(text)]) AS length FROM documents WHERE text IS NOT NULL),
        c AS (SELECT source, unit, length, count(*) AS n FROM l GROUP BY ALL),
        a AS (SELECT *, (sum(n) OVER (PARTITION BY source, unit ORDER BY length RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING) - n) / 100.0::DOUBLE AS usual FROM c)
        SELECT source, unit, length FROM a WHERE n >= 8 AND n / greatest(usual, 0.25::DOUBLE) >= 8""",
}
