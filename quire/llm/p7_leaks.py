"""Problem 7: passages of held-out test items inside corpus documents.

Q-gram lemma filtering. Two strings that agree over L characters but for k edits share many q-grams whose diagonals (position
in the document minus position in the item) lie within k of each other. Items are a table of all their q-grams; documents give
the q-grams at every s-th position. Hits are counted per item in overlapping diagonal bands; regions whose count meets the bound
t = (L - q + 1) // s - k * ceil(q / s) are verified by banded alignment: from a hit, both texts are followed to the left and to
the right with at most k edits in total, and the longest such run must reach L.

Neither side passes through the driver. The items' q-grams are hashed into a bitmap of a fixed size (``FILTER_BITS``), which is
all that a scan of the documents needs: only q-grams with their bit set, and of them only those that ``t`` of lie within a
region, leave the scan, with the text around them. They are joined with the items' q-grams by hash, and the candidates with the
items' texts. More items fill the bitmap, which lets more through, but needs no further scan and no more memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, pick, table

#: Size of the bitmap that a scan of the documents is filtered by.
FILTER_BITS = 1 << 25

_OTHER = re.compile(r"[\W_]+")


def letters_and_digits(text: str) -> str:
    """Only letters and digits, in lower case."""
    return _OTHER.sub("", text.lower())


def plan(length: int, edits: int) -> tuple[int, int, int]:
    """(q, stride, bound) for runs of ``length`` with ``edits``: the longest q, and with it the longest stride, for which at least two
    sampled q-grams survive; one where two can't."""
    for least in (2, 1):
        for q in range(max(2, length // (3 * (edits + 1))), 0, -1):
            for stride in range(max(1, (length - q + 1) // least), 0, -1):
                bound = (length - q + 1) // stride - edits * -(-q // stride)
                if bound >= least:
                    return q, stride, bound
    return 1, 1, 1  # as many edits as characters: every common character is a candidate


_FACTORS = np.random.default_rng(7).integers(0, 1 << 63, 4096, np.uint64) * np.uint64(2) + np.uint64(1)
#: Letters and digits of the basic plane.
_KEPT = np.ones(0x10000, bool)
_KEPT[[m.start() + n for m in _OTHER.finditer("".join(map(chr, range(0x10000)))) for n in range(len(m[0]))]] = False


def plain_codes(text: str) -> np.ndarray:
    """The code points of ``letters_and_digits(text)``."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) and codes.max() > 0xFFFF:
        return np.frombuffer(letters_and_digits(text).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes[_KEPT[codes]]


def gram_hashes(codes: np.ndarray, q: int, stride: int) -> np.ndarray:
    """64-bit hashes of the q-grams at every ``stride``-th position, as signed numbers."""
    if len(codes) < q:
        return np.empty(0, np.int64)
    out = np.lib.stride_tricks.sliding_window_view(codes.astype(np.uint64), q)[::stride] @ np.resize(_FACTORS, q)
    out ^= out >> np.uint64(31)
    out *= _FACTORS[0]
    return (out ^ (out >> np.uint64(29))).view(np.int64)


def reach(a: str, i: int, b: str, j: int, edits: int, step: int) -> list[int]:
    """How many characters of ``b`` can be followed from (i, j) in direction ``step`` with 0, 1 ... ``edits`` edits.

    Diagonals are kept within the band of ``edits``; one furthest point per diagonal and number of edits.
    """

    def slide(x: int, y: int) -> int:
        n = 0
        while 0 <= x < len(a) and 0 <= y < len(b) and a[x] == b[y]:
            x, y, n = x + step, y + step, n + 1
        return n

    def run(x: int, y: int) -> int:  # whole slices first: most runs are long
        n, chunk = 0, 32
        while True:
            if step > 0:
                if x + chunk <= len(a) and y + chunk <= len(b) and a[x : x + chunk] == b[y : y + chunk]:
                    x, y, n = x + chunk, y + chunk, n + chunk
                    continue
            elif x - chunk >= -1 and y - chunk >= -1 and a[x - chunk + 1 : x + 1] == b[y - chunk + 1 : y + 1]:
                x, y, n = x - chunk, y - chunk, n + chunk
                continue
            return n + slide(x, y)

    far = {0: run(i, j)}  # diagonal -> characters of b followed
    out = [far[0]]
    for _ in range(edits):
        new: dict[int, int] = {}
        for d, n in far.items():
            for d2, n2 in ((d, n + 1), (d + 1, n), (d - 1, n + 1)):  # substituted; only in a; only in b
                x, y = i + step * (n2 + d2), j + step * n2
                if abs(d2) <= edits and -1 <= x <= len(a) and -1 <= y <= len(b):
                    new[d2] = max(new.get(d2, -1), n2 + run(x, y))
        far = new or far
        out.append(max(out[-1], *far.values()))
    return out


def _item_grams(runs: dict[str, int], edits: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for item, text, lang in zip(part["_item"], part["_text"], part["_lang"]):
                length, plain = runs.get(lang), plain_codes(text)
                if length is None or len(plain) < length:
                    continue
                hashes = gram_hashes(plain, plan(length, edits)[0], 1)
                yield pd.DataFrame({"_length": np.int32(length), "_gram": hashes, "_item": item, "_at": np.arange(len(hashes), dtype=np.int32)})

    return run


def _near(at: np.ndarray, bound: int, reach_: int) -> np.ndarray:
    """Which of the ascending positions are among ``bound`` within ``reach_``."""
    keep = np.zeros(len(at), bool)
    if len(at) >= bound:
        first = np.flatnonzero(at[bound - 1 :] - at[: len(at) - bound + 1] <= reach_)
        for k in range(bound):
            keep[first + k] = True
    return keep


def _document_hits(filters: Broadcast, edits: int):
    """mapInPandas function: the q-grams of documents that may be some item's, with the text around them."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plans = [(length, *plan(length, edits), bits) for length, bits in filters.value]
        for part in parts:
            docs, lengths, grams, positions, starts, windows = [], [], [], [], [], []
            for doc, text in zip(part["_doc"], part["_text"]):
                if not text:
                    continue
                plain = plain_codes(text)
                for length, q, stride, bound, bits in plans:
                    if len(plain) < length - edits:
                        continue
                    hashes = gram_hashes(plain, q, stride)
                    slot = hashes & np.int64(FILTER_BITS - 1)
                    found = np.flatnonzero((bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1))
                    found = found[_near(found * stride, bound, length + edits - q)]
                    for n in found.tolist():
                        at = n * stride
                        start = max(0, at - length - edits)
                        docs.append(doc)
                        lengths.append(length)
                        grams.append(hashes[n])
                        positions.append(at)
                        starts.append(start)
                        windows.append(plain[start : at + length + edits + q].tobytes().decode("utf-32-le", "surrogatepass"))  # a run through this q-gram that is just long enough lies within
            yield pd.DataFrame({
                "doc_id": pd.Series(docs, dtype="int64"), "_length": pd.Series(lengths, dtype="int32"), "_gram": pd.Series(grams, dtype="int64"),
                "_p": pd.Series(positions, dtype="int64"), "_start": pd.Series(starts, dtype="int64"), "_window": pd.Series(windows, dtype=object),
            })

    return run


def matches(window: str, p: int, item: str, at: int, length: int, edits: int) -> bool:
    """Whether a run of ``length`` with at most ``edits`` edits leads through position ``p`` of ``window`` and ``at`` of ``item``."""
    right = reach(window, p, item, at, edits, 1)
    left = reach(window, p - 1, item, at - 1, edits, -1)
    return max(left[e] + right[edits - e] for e in range(edits + 1)) >= length


def _verify(edits: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            good = [
                any(matches(w, p - s, item, at, length, edits) for w, p, s, at in zip(h["_window"], h["_p"], h["_start"], h["_at"]))
                for h, item, length in (({k: [x[k] for x in hits] for k in ("_window", "_p", "_start", "_at")}, item, length) for hits, item, length in zip(part["_hits"], part["_plain"], part["_length"]))
            ]
            yield part.loc[good, ["doc_id", "item_id"]]

    return run


def leaks(
    documents: DataFrame, items: DataFrame, runs: dict[str, int], edits: int = 0, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", lang: str = "lang",
) -> DataFrame:
    """(doc_id, item_id) of every document that shares a run of at least ``runs[lang of the item]`` letters and digits with an item.

    ``edits`` edits are allowed within a run. Null texts, texts shorter than a run, and items of other languages match nothing; rows with
    a null id are left out; repeated documents give one row; long texts are scanned whole. Empty tables give no rows.
    """
    rows = pick(documents, _doc=doc_id, _text=text).where("_doc IS NOT NULL").withColumn("_doc", F.col("_doc").cast("bigint"))
    held = pick(items, _item=item_id, _text=item_text, _lang=lang).where("_item IS NOT NULL AND _text IS NOT NULL").withColumn("_item", F.col("_item").cast("bigint")).distinct()
    grams = cut_lineage(held.mapInPandas(_item_grams(runs, edits), "_length int, _gram bigint, _item bigint, _at int"))
    bit = F.col("_gram").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = grams.groupBy("_length", F.shiftright(bit, 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_gram & 63 as int))")).alias("_bits"))
    filters = {length: np.zeros(FILTER_BITS // 64, np.uint64) for length in sorted(set(runs.values()))}
    for part in words.toPandas().groupby("_length"):  # at most FILTER_BITS / 64 rows for each length
        filters[int(part[0])][part[1]["_word"].to_numpy()] = part[1]["_bits"].to_numpy().view(np.uint64)
    sent = documents.sparkSession.sparkContext.broadcast([*filters.items()])
    hits = rows.mapInPandas(_document_hits(sent, edits), "doc_id bigint, _length int, _gram bigint, _p bigint, _start bigint, _window string")
    width = edits + 1
    band = F.floor((F.col("_p") - F.col("_at")) / width).cast("bigint")
    # bands overlap by half: with edits, a diagonal belongs to two of them
    banded = hits.join(grams, ["_length", "_gram"]).withColumn("_band", F.explode(F.array(band, band + 1)) if edits else band)
    plans = F.create_map(*[F.lit(x) for length in sorted(set(runs.values())) for x in (length, plan(length, edits)[2])])
    hit = F.struct("_p", "_at", "_start", "_window")
    counted = banded.groupBy("doc_id", F.col("_item").alias("item_id"), "_length", "_band").agg(F.count_distinct("_p").alias("_n"), F.collect_set(hit).alias("_hits")).where(F.col("_n") >= plans[F.col("_length")])
    candidates = counted.select("doc_id", "item_id", "_length", "_hits")
    plain = held.select(F.col("_item").alias("item_id"), F.col("_text").alias("_plain"))
    texts = plain.mapInPandas(_plain_items, "item_id bigint, _plain string")
    return candidates.join(texts, "item_id").mapInPandas(_verify(edits), "doc_id bigint, item_id bigint").distinct()


def _plain_items(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        yield part.assign(_plain=[letters_and_digits(t) for t in part["_plain"]])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) of every leaked passage: 80 letters and digits of an English item, 24 of a Chinese one."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), {"en": 80, "zh": 24})


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, documents): in how many documents each leaked item was found."""
    return p7_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"))


def p7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) of passages that agree over 80 (24) letters and digits but for at most one edit."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), {"en": 80, "zh": 24}, edits=1)


#: A shared run of 80 (24) holds a whole block of 40 (12) of the document's, cut at multiples of 40 (12): such blocks are joined with the items'
#: substrings, then every run of the item is looked for in the text.
_SHARED = r"""
WITH runs(lang, len, half) AS (VALUES ('en', 80, 40), ('zh', 24, 12)),
i AS (SELECT DISTINCT item_id, lang, len, half, lower(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) AS s FROM eval_items JOIN runs USING (lang)),
d AS (SELECT DISTINCT doc_id, lower(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) AS t FROM documents WHERE text IS NOT NULL),
g AS (SELECT DISTINCT item_id, half, substr(s, CAST(unnest(range(1, length(s) - half + 2)) AS INT), half) AS gram FROM i WHERE length(s) >= len),
b AS (SELECT DISTINCT doc_id, half, substr(t, CAST(unnest(range(1, length(t) - half + 2, half)) AS INT), half) AS gram FROM d, (SELECT DISTINCT half FROM runs)),
c AS (SELECT DISTINCT doc_id, item_id FROM b JOIN g USING (half, gram)),
r AS (SELECT item_id, substr(s, CAST(unnest(range(1, length(s) - len + 2)) AS INT), len) AS run FROM i WHERE length(s) >= len),
f AS (SELECT DISTINCT doc_id, item_id FROM c JOIN d USING (doc_id) JOIN r USING (item_id) WHERE contains(t, run))
"""
QUERIES = {"p7_found": p7_found, "p7_items": p7_items, "p7_near": p7_near}
ORACLES = {
    "p7_found": _SHARED + "SELECT doc_id, item_id FROM f",
    "p7_items": _SHARED + "SELECT item_id, count(*) AS documents FROM f GROUP BY item_id",
}
