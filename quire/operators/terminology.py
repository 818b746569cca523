"""Terminology operators: upsert, deduplication, conflicts, mining, confirmation, audit."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:
    import ahocorasick
except ImportError:  # terms are looked up by joins then
    ahocorasick = None

from ..functions.text import WS, chinese_term, english_phrase, no_space, normalize_key, strip, term_pattern

#: Pairs that are no terms (fixed values).
STOP_PAIRS = {("et al", "等人"), ("fig", "图"), ("table", "表"), ("eq", "式")}
#: Patterns of glosses and keyword lines.
EN_ACRONYM = r"([A-Za-z][A-Za-z0-9\-]*(?:[ \-][A-Za-z0-9\-]+){0,5})\s*\(([A-Z][A-Z0-9\-]{1,9})\)"
ZH_ACRONYM = r"([\x{4e00}-\x{9fff}][\x{4e00}-\x{9fff}A-Za-z0-9\-]{1,21})（([A-Z][A-Z0-9\-]{1,9})）"
EN_KEYWORDS = rf"(?i)^{WS}*(?:keywords|index terms|key words){WS}*[:：]?{WS}*(.+)$"
ZH_KEYWORDS = rf"^{WS}*(?:关键词|关键字){WS}*[:：]?{WS}*(.+)$"
KEYWORD_SPLIT = rf"[;；,，、]|{WS}{{2,}}"
MAX_ALTERNATIVES = 4


def _norm(s: str) -> str:
    return re.sub(r"\s+", " ", s.strip().lower())


class Entry:
    """One term of a knowledge base while evidence is folded into it."""

    def __init__(self, source: str, target: str, confidence: float, kind: str, paper: str):
        self.source, self.target, self.confidence, self.kind = source, target, round(confidence, 2), kind
        self.papers, self.hits = [paper] if paper else [], int(bool(paper))
        self.alternatives: list[str] = []

    def add(self, target: str, confidence: float, kind: str, paper: str, strict: bool) -> None:
        """More evidence: a new paper is a hit; the same target may raise the confidence; another one becomes an alternative, or takes over
        if it is surer by more than 0.1. ``strict``: a paper counts as known if its name is part of the joined list, as "1" is of "10"."""
        if paper and (paper not in ";".join(self.papers) if strict else paper not in self.papers):
            self.papers.append(paper)
            self.hits += 1
        if _norm(target) == _norm(self.target):
            if confidence > self.confidence:
                self.confidence, self.kind = round(confidence, 2), kind
            return
        known = [*self.alternatives] if target in self.alternatives else [*self.alternatives, target]
        if confidence > self.confidence + 0.1:
            if self.target not in known:
                known.insert(0, self.target)
            self.target, self.confidence, self.kind = target, round(confidence, 2), kind
        self.alternatives = known[:MAX_ALTERNATIVES]

    def confirm(self, paper: str, strict: bool) -> None:
        """The term was found again in a paper: a hit, and the paper if it isn't known yet."""
        self.hits += 1
        if paper and (paper not in ";".join(self.papers) if strict else paper not in self.papers):
            self.papers.append(paper)


def _fold(strict: bool):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, entry = None, None
        done: list[tuple] = []

        def close() -> None:
            if entry is not None:
                done.append((key[0], entry.source, entry.target, entry.confidence, entry.kind, entry.hits, ";".join(entry.papers), "|".join(entry.alternatives)))

        columns = ["kb_id", "source", "target", "confidence", "source_kind", "hits", "papers", "target_alt"]
        for part in parts:
            for kb, k, source, target, confidence, kind, paper, again in zip(part["kb_id"], part["_key"], part["source"], part["target"], part["confidence"], part["kind"], part["paper"], part["again"]):
                if (kb, k) != key:
                    close()
                    key, entry = (kb, k), Entry(source, target, confidence, kind, paper)
                elif again:
                    entry.confirm(paper, strict)
                else:
                    entry.add(target, confidence, kind, paper, strict)
            if len(done) >= 10_000:
                yield pd.DataFrame(done, columns=columns)
                done = []
        close()
        yield pd.DataFrame(done, columns=columns)

    return run


def acceptable(source: Column, target: Column) -> Column:
    """Pairs that may become terms: two characters on both sides, a Latin letter in the source, a Chinese character in the target, no stop pair."""
    stop = F.lit(False)
    for a, b in sorted(STOP_PAIRS):
        stop = stop | ((F.lower(source) == a) & (target == b))
    return F.coalesce((F.length(source) >= 2) & (F.length(target) >= 2) & source.rlike("[A-Za-z]") & target.rlike(r"[\x{4e00}-\x{9fff}]") & ~stop, F.lit(False))


def upsert(evidence: DataFrame, strict_compat: bool = True) -> DataFrame:
    """(kb_id, source, target, confidence, source_kind, hits, papers, target_alt): the terms after all evidence, in order of ``seq``.

    ``evidence`` has kb_id, source, target, confidence, kind, paper ('' for none), seq, and perhaps stage, which goes before seq; rows of stage 1 confirm
    the term so far. The rules aren't commutative, so evidence of a term is folded in order: partitions are sorted by term and streamed, one entry is held at a time, and no group is collected.
    """
    rows = evidence.withColumns({"source": strip(F.col("source")), "target": strip(F.col("target"))}).where(acceptable(F.col("source"), F.col("target")))
    stage = F.coalesce("stage", F.lit(0)) if "stage" in evidence.columns else F.lit(0)
    keyed = rows.select("kb_id", normalize_key(F.col("source")).alias("_key"), "seq", "source", "target", F.col("confidence").cast("double"), "kind", F.coalesce("paper", F.lit("")).alias("paper"), stage.alias("stage"), (stage == 1).alias("again"))
    streamed = keyed.repartition("kb_id", "_key").sortWithinPartitions("kb_id", "_key", "stage", "seq")
    return streamed.mapInPandas(_fold(strict_compat), "kb_id int, source string, target string, confidence double, source_kind string, hits int, papers string, target_alt string")


def deduplicate(glossary: DataFrame, order: list[str]) -> DataFrame:
    """(term, target, first): per normalised source the last target in ``order``, at the first position."""
    at = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return glossary.groupBy(normalize_key(F.col("source")).alias("term")).agg(F.max_by("target", at).alias("target"), F.min(at).alias("first"))


def conflicts(glossary: DataFrame) -> DataFrame:
    """(kb_id, term, n_targets, least, greatest) of terms with several raw targets; counted, not collected."""
    out = glossary.where("target IS NOT NULL").groupBy("kb_id", normalize_key(F.col("source")).alias("term"))
    return out.agg(F.count_distinct("target").alias("n_targets"), F.min("target").alias("least"), F.max("target").alias("greatest")).where("n_targets > 1")


#: What stands before an acronym in brackets, taken whole where it begins: the patterns above are then matched in that alone, as they would try every
#: word of a text as a beginning.
_EN_RUN = r"(?<![A-Za-z0-9 \-])[A-Za-z0-9 \-]++\s*+\([A-Z][A-Z0-9\-]{1,9}\)"
_ZH_RUN = r"(?<![\x{4e00}-\x{9fff}A-Za-z0-9\-])[\x{4e00}-\x{9fff}A-Za-z0-9\-]++（[A-Z][A-Z0-9\-]{1,9}）"


def _glosses(df: DataFrame, text: str, pattern: str, run: str, clean, name: str) -> DataFrame:
    """First clean name of every acronym per block."""
    held = F.transform(F.regexp_extract_all(text, F.lit(run), F.lit(0)), lambda r: F.struct(F.regexp_extract(r, pattern, 1).alias("name"), F.regexp_extract(r, pattern, 2).alias("acronym")))
    rows = df.select("block_key", F.posexplode(F.filter(held, lambda p: p["acronym"] != "")).alias("_pos", "_p"))
    rows = rows.select("block_key", "_pos", clean(F.col("_p.name")).alias("_name"), F.upper("_p.acronym").alias("acronym")).where("_name <> ''")
    return rows.groupBy("block_key", "acronym").agg(F.min_by("_name", "_pos").alias(name))


def acronym_pairs(pairs: DataFrame, known: DataFrame | None) -> DataFrame:
    """(block_key, acronym, source, target) mined from "full name (ABC)" in the text and its counterpart in the translation of the same block.

    ``pairs`` has block_key, text and zh. Gates: the acronym is no known source (``known``: term; None: not checked); the name doesn't begin with a participle;
    the target's length suits the number of words.
    """
    en = _glosses(pairs, "text", EN_ACRONYM, _EN_RUN, english_phrase, "source")
    zh = _glosses(pairs, "zh", ZH_ACRONYM, _ZH_RUN, chinese_term, "target")
    words = F.split("source", " ")
    first, n = F.lower(F.get(words, F.lit(0))), F.size(words)
    low = F.greatest(F.lit(3), n * 2)
    high = F.least(F.lit(24), F.greatest(low, n * 4))
    fits = F.length("target").between(low, high) & ~((F.length(first) > 4) & first.rlike("(ed|ing)$")) & (normalize_key(F.col("source")) != normalize_key(F.col("target")))
    found = en.join(zh, ["block_key", "acronym"]).where(fits)
    return found if known is None else found.join(known.select(F.col("term").alias("_t")), F.lower("acronym") == F.col("_t"), "left_anti")


def keyword_pairs(pairs: DataFrame) -> DataFrame:
    """(block_key, n, source, target) by position from two keyword lines of equal length."""
    trimmed = lambda c, chars: F.filter(F.transform(F.split(c, KEYWORD_SPLIT), lambda x: F.regexp_replace(x, f"^[{chars}]+|[{chars}]+$", "")), lambda x: strip(x) != "")
    kept = pairs.select("block_key", F.regexp_extract("text", EN_KEYWORDS, 1).alias("_e"), F.regexp_extract("zh", ZH_KEYWORDS, 1).alias("_z")).where("_e <> '' AND _z <> ''")
    lists = kept.select("block_key", trimmed("_e", " .;,").alias("e"), trimmed("_z", " ;，、。").alias("z")).where(F.size("e") == F.size("z"))
    rows = lists.select("block_key", F.posexplode(F.arrays_zip("e", "z")).alias("n", "_p")).select("block_key", "n", F.col("_p.e").alias("source"), F.col("_p.z").alias("target"))
    return rows.where(F.col("source").rlike("[A-Za-z]") & F.col("target").rlike(r"[\x{4e00}-\x{9fff}]") & (F.length("source") > 2))


#: Characters of distinct terms that one automaton may hold (a few hundred bytes of memory each); more are looked up by joins.
AUTOMATON_CHARS = 4_000_000


def _dictionary(terms: DataFrame, columns: list[str]) -> Broadcast | None:
    """The distinct ``terms``, broadcast, if the characters of ``columns`` fit an automaton (and its library is installed), else None."""
    if ahocorasick is None:
        return None
    distinct = terms.distinct()
    size = distinct.agg(F.sum(sum((F.length(c) for c in columns), F.lit(0)))).first()[0] or 0
    return terms.sparkSession.sparkContext.broadcast([tuple(r) for r in distinct.collect()]) if size <= AUTOMATON_CHARS else None


def _automaton(words: list[str]):
    """An automaton whose matches give the positions of ``words``, which are distinct and not empty."""
    made = ahocorasick.Automaton()
    for n, word in enumerate(words):
        made.add_word(word, n)
    if words:
        made.make_automaton()
    return made


def _found(automaton, text: str) -> set[int]:
    return {n for _, n in automaton.iter(text)} if len(automaton) else set()


def _openings(df: DataFrame, key: str, text: str, n: int = 4) -> DataFrame:
    """(key, _k): every distinct run of one to ``n`` characters of a text: what a term in it can begin with."""
    chars = df.select(key, F.split(text, "").alias("_c"))  # a column of its own: looked up by position, the text would be scanned for each run
    runs = F.transform(F.sequence(F.lit(0), F.size("_c") - 1), lambda i: F.concat(*[F.coalesce(F.get("_c", i + j), F.lit("")) for j in range(n)]))
    every = chars.where(F.size("_c") > 0).select(key, F.array_distinct(runs).alias("_r"))
    return every.select(key, F.explode(F.array_distinct(F.concat("_r", *[F.transform("_r", _left(k)) for k in range(1, n)]))).alias("_k")).where("_k <> ''")


def _left(k: int):
    return lambda x: F.left(x, F.lit(k))


def landed(terms: DataFrame, translations: DataFrame) -> DataFrame:
    """(_id) of terms whose target (white space aside) occurs in a translation.

    ``terms`` has _id and target, ``translations`` block_key and zh. Each translation is scanned once by an automaton of the distinct targets; nothing
    of the texts is shuffled. More targets than an automaton may hold are joined on their first four characters (a shorter one on all) with what
    the translations' terms can begin with; only keys and ids meet there, and the texts are fetched for the candidates to verify.
    """
    t = terms.select("_id", no_space(F.col("target")).alias("_target")).where("_target <> ''")
    z = translations.select("block_key", no_space(F.col("zh")).alias("_zh")).where(F.length("_zh") > 0)
    held = _dictionary(t.select("_target"), ["_target"])
    if held is not None:

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            words = [w for w, in held.value]
            automaton, seen = _automaton(words), set()
            for part in parts:
                new = {n for text in part["_zh"] for n in _found(automaton, text)} - seen
                seen |= new
                yield pd.DataFrame({"_target": pd.Series([words[n] for n in new], dtype=object)})

        hits = z.select("_zh").mapInPandas(run, "_target string").distinct()
    else:
        distinct = t.select("_target").distinct().withColumn("_k", F.left("_target", F.lit(4)))
        candidates = _openings(z, "block_key", "_zh").join(distinct, "_k").select("block_key", "_target")
        hits = candidates.join(z, "block_key").where(F.contains("_zh", "_target")).select("_target").distinct()
    return t.join(hits, "_target", "left_semi").select("_id")


def mentioned(terms: DataFrame, blocks: DataFrame) -> DataFrame:
    """(_id, block_key) of terms that occur in a text at word boundaries, blanks matching hyphens too; found by joins.

    ``terms`` has _id and source, ``blocks`` block_key and text. Terms with Latin words or numbers are joined on their first two (or only) with the
    texts' words and pairs of words, other terms on their first characters; the texts are fetched for the candidates and verified with the term's pattern.
    """
    word = r"[^a-z0-9]+"
    split = lambda c: F.filter(F.split(F.lower(c), word), lambda w: w != "")
    every = terms.where(strip(F.col("source")) != "").select("_id", F.lower(strip(F.col("source"))).alias("_s"), split(F.col("source")).alias("_w"), term_pattern(F.col("source")).alias("_p"))
    t = every.where(F.size("_w") > 0).select("_id", "_p", F.array_join(F.slice("_w", 1, 2), " ").alias("_k"))
    b = blocks.where("text IS NOT NULL").select("block_key", F.lower("text").alias("_text"))
    w = b.select("block_key", split(F.col("_text")).alias("_w")).where(F.size("_w") > 0)
    two = F.zip_with("_w", F.slice("_w", 2, F.greatest(F.size("_w"), F.lit(1))), lambda x, y: F.concat_ws(" ", x, y))
    candidates = w.select("block_key", F.explode(F.array_distinct(F.concat("_w", two))).alias("_k")).join(t, "_k").select("block_key", "_id", "_p")
    wordless = every.where(F.size("_w") == 0).select("_id", "_p", F.left(F.regexp_replace("_s", rf"[{WS[1:-1]}-].*$", ""), F.lit(4)).alias("_k"))
    opened = _openings(b, "block_key", "_text").join(wordless.where("_k <> ''"), "_k").select("block_key", "_id", "_p")
    odd = wordless.where("_k = ''").select("_id", "_p")  # terms that begin with a hyphen: any text may have them
    anywhere = b.select("block_key").join(odd, F.lit(True)) if not odd.isEmpty() else None
    candidates = candidates.unionByName(opened)
    candidates = candidates if anywhere is None else candidates.unionByName(anywhere.select("block_key", "_id", "_p"))
    return candidates.join(b, "block_key").where(F.regexp("_text", F.col("_p"))).select("_id", "block_key").distinct()


_GAPS = re.compile(r"[\s-]+")


def _mention_counts(held: Broadcast):
    """mapInPandas function over (block_key, _text in lower case): (source, n_blocks, first_block) of each batch."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of: dict[str, list[tuple[str, re.Pattern | None]]] = {}
        for source, low in held.value:
            # where gaps are alike, a term without hyphen is found exactly; one with a hyphen may differ from what it seems to match
            pattern = re.compile(r"[\s-]+".join(map(re.escape, low.split()))) if "-" in low else None
            of.setdefault(_GAPS.sub(" ", low), []).append((source, pattern))
        words = [*of]
        automaton = _automaton(words)
        for part in parts:
            counts: dict[str, list[int]] = {}
            for key, text in zip(part["block_key"], part["_text"]):
                alike = _GAPS.sub(" ", text)
                end = len(alike) - 1
                hits: dict[int, bool] = {}
                for at, n in automaton.iter(alike) if words else ():
                    start = at - len(words[n])
                    if (start < 0 or not _is_word(alike[start])) and (at == end or not _is_word(alike[at + 1])):
                        hits[n] = True
                for n in hits:
                    for source, pattern in of[words[n]]:
                        if pattern is None or any((m.start() == 0 or not _is_word(text[m.start() - 1])) and (m.end() == len(text) or not _is_word(text[m.end()])) for m in _overlapping(pattern, text)):
                            held_ = counts.setdefault(source, [0, key])
                            held_[0] += 1
                            held_[1] = min(held_[1], key)
            yield pd.DataFrame({"source": pd.Series([*counts], dtype=object), "_n": pd.Series([c[0] for c in counts.values()], dtype="int64"), "_first": pd.Series([c[1] for c in counts.values()], dtype="int64")})

    return run


def _is_word(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def _overlapping(pattern: re.Pattern, text: str) -> Iterator[re.Match]:
    m = pattern.search(text)
    while m:
        yield m
        m = pattern.search(text, m.start() + 1)


def mentions(terms: DataFrame, blocks: DataFrame) -> DataFrame:
    """(_id, n_blocks, first_block) of the terms that occur at word boundaries; terms of equal source are looked up once.

    ``terms`` has _id and source, ``blocks`` block_key (unique) and text. Each text is scanned once by an automaton of the terms, which sends on counts,
    not texts or matches; more terms than an automaton may hold are looked up by joins (``mentioned``).
    """
    sources = terms.where(strip(F.col("source")) != "").select("source", F.lower(strip(F.col("source"))).alias("_low"))
    held = _dictionary(sources, ["_low"])
    if held is not None:
        rows = blocks.where("text IS NOT NULL").select("block_key", F.lower("text").alias("_text"))
        each = rows.mapInPandas(_mention_counts(held), "source string, _n bigint, _first bigint")
        counts = each.groupBy("source").agg(F.sum("_n").alias("n_blocks"), F.min("_first").alias("first_block"))
    else:
        found = mentioned(terms.select(F.col("source").alias("_id"), "source").distinct(), blocks)
        counts = found.groupBy(F.col("_id").alias("source")).agg(F.count("*").alias("n_blocks"), F.min("block_key").alias("first_block"))
    return terms.select("_id", "source").join(counts, "source").select("_id", "n_blocks", "first_block")


def audit(terms: DataFrame, blocks: DataFrame, translations: DataFrame) -> DataFrame:
    """(_id, n_blocks, first_block) of terms whose target occurs in no translation though their source occurs in translated blocks."""
    missing = terms.where(no_space(F.coalesce("target", F.lit(""))) != "").join(landed(terms, translations), "_id", "left_anti")
    done = blocks.join(translations.where("zh <> ''").select("block_key"), "block_key", "left_semi")
    return mentions(missing, done)


#: Characters of distinct terms that a Python worker looks up at once (about ten bytes of memory each); of more, the texts are scanned for one part after the other.
LOOKUP_CHARS = 24_000_000


def confirmations(terms: DataFrame, pairs: DataFrame, own: list[str] | None = None) -> DataFrame:
    """(_id, first_block) of terms whose source and target both occur in one block and its translation (as plain substrings).

    ``own``: columns of both in which a term and a pair have to agree. The distinct terms are broadcast; each translation is scanned once for the
    targets (once for each part of more than ``LOOKUP_CHARS``), and neither texts nor candidates are shuffled, however many terms there are.
    """
    own = own or []
    t = terms.where("target <> '' AND source <> ''").select("_id", *own, "target", normalize_key(F.col("source")).alias("_s"))
    z = pairs.where("zh <> ''").select("block_key", *own, "zh", normalize_key(F.col("text")).alias("_text")).where("_text IS NOT NULL")
    for c in own:
        z = z.where(F.col(c).isNotNull())
    distinct = t.select(*own, "target", "_s").distinct()
    size = distinct.agg(F.sum(F.length("target") + F.length("_s"))).first()[0] or 0
    n = max(1, -(-size // LOOKUP_CHARS))
    schema = "".join(f"{c} {t.schema[c].dataType.simpleString()}, " for c in own) + "target string, _s string, _first bigint"
    hits = None
    for i in range(n):
        part = distinct if n == 1 else distinct.where(F.pmod(F.xxhash64("target"), F.lit(n)) == i)
        each = z.mapInPandas(_confirmed(_looked_up(part, own), own), schema)
        hits = each if hits is None else hits.unionByName(each)
    return t.join(hits.groupBy(*own, "target", "_s").agg(F.min("_first").alias("first_block")), [*own, "target", "_s"]).select("_id", "first_block")


#: More sources than these of one target aren't tried one by one; they are looked up by what they begin with.
MANY_SOURCES = 16
_OPENING = 6


def _looked_up(distinct: DataFrame, own: list[str]) -> Broadcast:
    """Broadcast (targets, sources, of): the lengths of the targets that begin with each two (or only one) characters, those of the sources of targets
    with many by their first six (or less), and, by values of ``own``, the sources of each target, as a set if they are many."""
    held = distinct.toArrow()
    of: dict[tuple, dict] = {}
    targets: dict[str, set[int]] = {}
    sources: dict[str, set[int]] = {}
    same: dict[str, str] = {}
    for *mine, target, source in zip(*[held[c].to_pylist() for c in (*own, "target", "_s")]):
        of.setdefault(tuple(mine), {}).setdefault(target, []).append(same.setdefault(source, source))
        targets.setdefault(target[:2], set()).add(len(target))
    for table in of.values():
        for target, names in table.items():
            table[target] = frozenset(names) if len(names) > MANY_SOURCES else tuple(names)
            for source in names if len(names) > MANY_SOURCES else ():
                sources.setdefault(source[:_OPENING], set()).add(len(source))
    return distinct.sparkSession.sparkContext.broadcast((*({k: tuple(v) for k, v in x.items()} for x in (targets, sources)), of))


def _within(text: str, openings: dict[str, tuple[int, ...]], widths: list[int]) -> set[str]:
    """Parts of a text that begin with an opening and have one of its lengths; ``widths``: the lengths of openings."""
    get = openings.get
    return {text[i : i + n] for w in widths for i in range(len(text) - w + 1) for n in get(text[i : i + w], ())}


def _confirmed(held: Broadcast, own: list[str]):
    """mapInPandas function over (block_key, *own, zh, _text): (*own, target, _s, _first) of the terms confirmed in each partition."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        targets, sources, of = held.value
        widths = [sorted({len(k) for k in x}) for x in (targets, sources)]
        first: dict[tuple, dict[str, dict[str, int]]] = {}
        for part in parts:
            for key, zh, text, *mine in zip(part["block_key"], part["zh"], part["_text"], *[part[c] for c in own]):
                table = of.get(tuple(mine))
                words = _within(zh, targets, widths[0]) if table else ()
                there = None
                for word in words:
                    names = table.get(word, ())
                    if isinstance(names, frozenset):
                        there = _within(text, sources, widths[1]) if there is None else there
                        names = names & there
                    else:
                        names = [x for x in names if x in text]
                    if names:
                        known = first.setdefault(tuple(mine), {}).setdefault(word, {})
                        for source in names:
                            known[source] = min(known.get(source, key), key)
        rows = [(*mine, word, source, key) for mine, x in first.items() for word, y in x.items() for source, key in y.items()]
        for at in range(0, len(rows), 50_000):
            yield pd.DataFrame(rows[at : at + 50_000], columns=[*own, "target", "_s", "_first"])

    return run


def lookup(glossary: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """The ``limit`` surest terms whose source or target contains the query, case aside; first come first on ties."""
    q = query.lower()
    hit = F.contains(F.lower("source"), F.lit(q)) | F.contains(F.lower(F.coalesce("target", F.lit(""))), F.lit(q))
    return glossary.where(hit).orderBy(F.col("confidence").desc_nulls_last(), "gid").limit(limit)
