"""Problem 2: which sentence of a text is rendered by which sentence of its rough translation.

Cross-lingual vectors are learned by a singular value decomposition of paired documents: a document is a prompt with its
translation, its terms are English words and Chinese character pairs, so terms that render each other get neighbouring
vectors. The model is fitted on all pairs: the tasks count the terms, of which each language's ``VOCABULARY`` most frequent ones get
vectors, and multiply with the sparse matrix of documents and terms, of which each holds a part; the driver only orthogonalises a few
directions of the terms' space (randomized decomposition). The driver and each task need a few times
``2 * VOCABULARY * DIMENSIONS`` numbers (31 MB) for the vectors, whatever the corpus. Numbers and names, which both sides share, get
fixed random directions of their own. A sentence is the weighted sum of its terms.

Within a pair of texts, sentences are matched by cosine less the mean of the nearest neighbours' cosines on both sides (margin);
mutual best neighbours are linked in whatever order they stand. What is left over is joined to a linked sentence if the merged
window is clearly more similar to the other side than the window without it; else it stays without counterpart. Similarities are
computed in bands of rows, so a pair of very long texts needs no square matrix.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from operator import add

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, pick, summed, table
from .p1_pair_defects import PairModel, plain, translation_model

DIMENSIONS = 128
ANCHORS = 64
#: Terms of each language that get vectors.
VOCABULARY = 30_000
#: Documents in a part of the matrix, and rows of a product that are summed at once.
PART_ROWS, SLICE_ROWS = 1000, 1024
#: Cells of a similarity matrix held at once.
BAND_CELLS = 2_000_000
#: Vectors gathered at once: what a processor's cache holds, as memory costs far more than sums.
STEP = 2000

_EN_END = re.compile(r"[.?!](?=\s|$)")
_ZH_END = re.compile(r"[。？！]")
_ABBREVIATED = re.compile(r"(?:^|[^a-z])(?:fig|al|approx)$")
_TOKEN = re.compile(r"\d[\d,]*(?:\.\d+)?|[^\W\d_]+(?:-(?:[^\W_]+))*")
#: The same in ASCII texts.
_ASCII_TOKEN = re.compile(r"[0-9][0-9,]*(?:\.[0-9]+)?|[A-Za-z]+(?:-[A-Za-z0-9]+)*")
_CHINESE = re.compile("[㐀-鿿]{2,}")
_ANCHOR = re.compile(r"\d[\d,]*(?:\.\d+)?|[A-Za-zÀ-ɏ]+(?:-[A-Za-z0-9À-ɏ]+)*")


def _split(text: str, ends: list[int]) -> list[str]:
    out = [text[a:b] for a, b in zip([0, *ends], ends)]
    rest = text[ends[-1] :] if ends else text
    return [*out, rest] if rest.strip() else out


def _abbreviated(before: str) -> bool:
    return before.endswith(("fig", "al", "approx", "\n")) and _ABBREVIATED.search(before) is not None


def english_sentences(text: str) -> list[str]:
    """Sentences up to . ? or ! before a blank or the end, but for Fig. al. approx.; text after the last end is a sentence too."""
    return _split(text, [m.end() for m in _EN_END.finditer(text) if m[0] != "." or not _abbreviated(text[max(0, m.start() - 7) : m.start()].lower())])


def chinese_sentences(text: str) -> list[str]:
    """Sentences up to 。？ or ！; text after the last end is a sentence too, blanks alone are none."""
    return _split(text, [m.end() for m in _ZH_END.finditer(text)])


def _tokens(sentence: str) -> list[str]:
    return (_ASCII_TOKEN if sentence.isascii() else _TOKEN).findall(sentence)


def english_terms(sentence: str, first: bool = True) -> tuple[list[str], list[str]]:
    """(words, anchors) of an English sentence. Capitalised words but the first are names."""
    words, anchors = [], []
    for n, token in enumerate(_tokens(sentence)):
        if token[0].isdigit():
            anchors.append(token.replace(",", ""))
        elif token.islower():
            words.append(token)
        elif n == 0 and (len(token) == 1 or token[1:].islower()):
            words.append(token.lower())
        else:
            anchors.append(token.lower())
    return words, anchors


def chinese_anchors(sentence: str) -> list[str]:
    return [t.replace(",", "") if t[0].isdigit() else t.lower() for t in _ANCHOR.findall(sentence)]


def chinese_pairs(sentence: str) -> list[str]:
    """Pairs of neighbouring Chinese characters."""
    return [pair for run in _CHINESE.findall(sentence) for pair in map(add, run, run[1:])]


class _Sparse:
    """A matrix of (row, column, value) cells, multiplied in parts of bounded size."""

    def __init__(self, rows: int, columns: int, cells: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.shape = rows, columns
        self.row, self.column, self.value = (np.concatenate([c[i] for c in cells]) if cells else np.empty(0, np.int64) for i in range(3))
        self.by_column = np.argsort(self.column, kind="stable")

    @staticmethod
    def _sum(to: np.ndarray, source: np.ndarray, value: np.ndarray, m: np.ndarray, n: int, step: int = STEP) -> np.ndarray:
        out = np.zeros((n, m.shape[1]), np.float32)
        for lo in range(0, len(to), step):
            part = to[lo : lo + step]
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            out[part[starts]] += np.add.reduceat(m[source[lo : lo + step]] * value[lo : lo + step, None], starts, axis=0)
        return out

    def times(self, m: np.ndarray) -> np.ndarray:
        return self._sum(self.row, self.column, self.value, m, self.shape[0])

    def transposed_times(self, m: np.ndarray) -> np.ndarray:
        o = self.by_column
        return self._sum(self.column[o], self.row[o], self.value[o], m, self.shape[1])


def _terms(english: str, chinese: str) -> tuple[list[str], list[str]]:
    return [w for s in english_sentences(english) for w in english_terms(s)[0]], chinese_pairs(chinese)


def _matrix(docs: list[tuple[list[str], list[str]]], vocabulary: list[dict[str, int]], weights: list[np.ndarray]) -> _Sparse:
    """Weights of the terms (both languages side by side) in the documents."""
    size = [len(v) for v in vocabulary]
    cells: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for row, d in enumerate(docs):
        for side in (0, 1):
            ids = [i for t in d[side] if (i := vocabulary[side].get(t)) is not None]
            if ids:
                at, times = np.unique(ids, return_counts=True)
                v = (np.sqrt(times) * weights[side][at]).astype(np.float32)
                cells.append((np.full(len(at), row), at + side * size[0], v / max(1e-9, float(np.linalg.norm(v)))))  # both languages weigh the same in a document
    return _Sparse(len(docs), sum(size), cells)


#: Multiplies a matrix of a row per term with the matrix of documents and terms and with that one's transpose.
Product = Callable[[np.ndarray], np.ndarray]


class TermVectors:
    """Vectors of English words and Chinese character pairs in one space."""

    def __init__(self, pairs: list[tuple[str, str]], dimensions: int = DIMENSIONS, keep: float = 0.5, seed: int = 7):
        docs = [_terms(e, z) for e, z in pairs]
        n = len(docs)
        counts: list[dict[str, int]] = []
        for side in (0, 1):
            df = Counter(t for d in docs for t in set(d[side]))
            usable = [t for t, c in df.items() if 2 <= c <= max(2, 0.35 * n)]
            counts.append({t: df[t] for t in sorted(usable, key=lambda t: (-df[t], t))[:VOCABULARY]})

        def product(vocabulary: list[dict[str, int]], weights: list[np.ndarray]) -> Product:
            x = _matrix(docs, vocabulary, weights)
            return lambda m: x.transposed_times(x.times(m.astype(np.float32)))

        self._fit(n, counts, product, dimensions, keep, seed)

    @classmethod
    def learned(cls, pairs: DataFrame, dimensions: int = DIMENSIONS, keep: float = 0.5, seed: int = 7) -> TermVectors:
        """The vectors of all rows (_en, _zh) of ``pairs``, but for rounding the same as of the list of them."""
        held = cut_lineage(summed(pairs, _count_terms))
        n = held.where("kind = 'rows'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        counts = []
        for side in ("en", "zh"):
            usable = held.where((F.col("kind") == side) & (F.col("n") >= 2) & (F.col("n") <= max(2, 0.35 * n)))
            counts.append({r["item"]: r["n"] for r in usable.orderBy(F.desc("n"), "item").limit(VOCABULARY).collect()})
        vectors = cls.__new__(cls)
        vectors._fit(n, counts, lambda vocabulary, weights: _product(pairs, vocabulary, weights), dimensions, keep, seed)
        return vectors

    def _fit(self, n: int, counts: list[dict[str, int]], product: Callable[[list[dict[str, int]], list[np.ndarray]], Product], dimensions: int, keep: float, seed: int) -> None:
        """``counts``: in how many of the ``n`` documents the terms of each language are."""
        vocabulary = [{t: i for i, t in enumerate(sorted(c))} for c in counts]
        weights = [np.array([np.log(max(1, n) / c[t]) for t in v], np.float32) for c, v in zip(counts, vocabulary)]
        self.words, self.pairs = vocabulary
        size = [len(v) for v in vocabulary]
        k = min(dimensions, n, sum(size))
        rng = np.random.default_rng(seed)
        vectors = np.zeros((sum(size), dimensions), np.float32)
        if k:
            times = product(vocabulary, weights)
            z = rng.standard_normal((sum(size), min(k + 16, n, sum(size))), dtype=np.float32)  # randomized range finder
            for _ in range(3):
                z = np.linalg.qr(times(z).astype(np.float64))[0]
            w = times(z).astype(np.float64)
            # with the matrix X and an orthogonal basis of X z, the singular vectors are those of X's transpose times this basis
            square, turn = np.linalg.eigh((z.T @ w + w.T @ z) / 2)
            real = square > 1e-9 * max(square.max(), 1e-30)
            u, s, _ = np.linalg.svd(w @ (turn[:, real] / np.sqrt(square[real])), full_matrices=False)
            k = min(k, len(s))
            vectors[:, :k] = u[:, :k] * np.sqrt(s[:k])
        norm = np.linalg.norm(vectors, axis=1, keepdims=True)
        vectors = np.where(norm > 1e-6, vectors / np.maximum(norm, 1e-6), 0)
        if size[0] and size[1]:  # pairs that render no word (they span two words, or are common to all sentences) only add noise
            best = np.concatenate([(vectors[lo : min(lo + 1024, sum(size))] @ vectors[: size[0]].T).max(axis=1) for lo in range(size[0], sum(size), 1024)])
            kept_pairs = np.flatnonzero(best >= keep)
            names = [*self.pairs]
            self.pairs = {names[i]: n for n, i in enumerate(kept_pairs)}
            vectors = np.concatenate([vectors[: size[0]], vectors[size[0] :][kept_pairs]])
            weights[1] = weights[1][kept_pairs]
        self.en = np.ascontiguousarray(vectors[: size[0]] * weights[0][:, None], np.float32)
        # a word of n characters gives about n - 1 pairs: Chinese pairs weigh less than English words
        self.zh = np.ascontiguousarray(vectors[size[0] :] * weights[1][:, None], np.float32)
        self.weight = float(np.median(weights[0])) * 1.5 if size[0] else 1.0
        self.dimensions = dimensions

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Lookup by character: (compact number of a character, id of a pair of numbers or -1)."""
        chars = sorted({c for p in self.pairs for c in p})
        number = np.zeros(0x10000, np.int32)
        for i, c in enumerate(chars):
            number[ord(c)] = i + 1
        ids = np.full((len(chars) + 1, len(chars) + 1), -1, np.int32)
        for p, i in self.pairs.items():
            ids[number[ord(p[0])], number[ord(p[1])]] = i
        return number, ids


def _plain_terms(part: pd.DataFrame) -> list[tuple[list[str], list[str]]]:
    return [_terms(plain(e), plain(z)) for e, z in zip(part["_en"], part["_zh"])]


def _count_terms(part: pd.DataFrame, held: Counter) -> None:
    """In how many documents each term is, and how many documents there are ('rows')."""
    held["rows", ""] += len(part)
    for en, zh in _plain_terms(part):
        held.update(("en", t) for t in set(en))
        held.update(("zh", t) for t in set(zh))


def _product(pairs: DataFrame, vocabulary: list[dict[str, int]], weights: list[np.ndarray]) -> Product:
    """The product by the tasks. The matrix is written once, in parts of ``PART_ROWS`` documents; there are only about two partitions
    a core, so that few partial sums, each the size of the product, are shuffled."""
    spark = pairs.sparkSession
    known = spark.sparkContext.broadcast((vocabulary, weights))
    terms = sum(len(v) for v in vocabulary)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), PART_ROWS):
                x = _matrix(_plain_terms(batch.iloc[lo : lo + PART_ROWS]), *known.value)
                cells = [x.row.astype(np.int32).tobytes(), x.column.astype(np.int32).tobytes(), x.value.astype(np.float32).tobytes()]
                yield pd.DataFrame([[x.shape[0], *cells]], columns=["rows", "row", "column", "value"])

    parts = pairs.mapInPandas(build, "rows int, row binary, column binary, value binary").withColumn("id", F.xxhash64("row", "column", "value"))
    parts = cut_lineage(parts.repartition(2 * spark.sparkContext.defaultParallelism, "id").sortWithinPartitions("id"))  # summed in one order
    known.destroy()

    def times(m: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(m.astype(np.float32))
        width = m.shape[1]

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, least = np.zeros((terms, width), np.float32), None
            for batch in batches:
                for n, row, column, value, id_ in zip(batch["rows"], batch["row"], batch["column"], batch["value"], batch["id"]):
                    x = _Sparse(n, terms, [(np.frombuffer(row, np.int32), np.frombuffer(column, np.int32), np.frombuffer(value, np.float32))])
                    total += x.transposed_times(x.times(sent.value))
                    least = id_ if least is None else min(least, id_)
            if least is not None:
                for lo in range(0, terms, SLICE_ROWS):
                    yield pd.DataFrame([[lo, least, total[lo : lo + SLICE_ROWS].tobytes()]], columns=["lo", "id", "total"])

        def added(part: pd.DataFrame) -> pd.DataFrame:
            each = part.sort_values("id")["total"]
            return pd.DataFrame([[part["lo"].iloc[0], sum(np.frombuffer(t, np.float32).astype(np.float64) for t in each).tobytes()]], columns=["lo", "total"])

        out = np.zeros((terms, width))
        for r in parts.mapInPandas(partial, "lo bigint, id bigint, total binary").groupBy("lo").applyInPandas(added, "lo bigint, total binary").collect():
            got = np.frombuffer(r["total"], np.float64).reshape(-1, width)
            out[r["lo"] : r["lo"] + len(got)] = got
        sent.destroy()
        return out

    return times


def _sums(vectors: Callable[[np.ndarray], np.ndarray], width: int, ids: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sum of ``vectors(ids)`` per owner; owners ascend."""
    out = np.zeros((n, width), np.float32)
    for lo in range(0, len(ids), STEP):
        part = owner[lo : lo + STEP]
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        out[part[starts]] += np.add.reduceat(vectors(ids[lo : lo + STEP]), starts, axis=0)
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-9)


def _nearest(c: np.ndarray, near: int, axis: int) -> np.ndarray:
    """The ``near`` highest values along ``axis``."""
    size = c.shape[axis]
    if size <= near:
        return np.sort(c, axis=axis)
    return np.partition(c, size - near, axis=axis)[(slice(None),) * axis + (slice(size - near, None),)]


def match(en: np.ndarray, zh: np.ndarray, least: float = 0.3, gain: float = 0.04, near: int = 3, units: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links between the rows of ``en`` and ``zh`` (sums of term vectors); ``units``: these rows with length 1, if they are at hand."""
    n, m = len(en), len(zh)
    if not n or not m:
        return []
    e_unit, z_unit = units or (_unit(en), _unit(zh))
    step = max(1, BAND_CELLS // m)
    bands = [(lo, min(n, lo + step)) for lo in range(0, n, step)]
    whole = e_unit @ z_unit.T if len(bands) == 1 else None
    row, column = np.zeros(n, np.float32), np.zeros(m, np.float32)
    if n > 1 and m > 1:  # means of the nearest neighbours' cosines
        top = np.empty((0, m), np.float32)
        for lo, hi in bands:
            c = whole if whole is not None else e_unit[lo:hi] @ z_unit.T
            row[lo:hi] = _nearest(c, near, 1).sum(axis=1) / min(near, m)
            top = _nearest(np.concatenate([top, c]) if len(top) else c, near, 0)
        column = top.sum(axis=0) / len(top)
    to_z, to_e, best = np.zeros(n, np.int64), np.zeros(m, np.int64), np.full(m, -np.inf, np.float32)
    near_e, near_z, near_cos = [], [], []
    for lo, hi in bands:
        c = whole if whole is not None else e_unit[lo:hi] @ z_unit.T
        margin = c - (row[lo:hi, None] + column[None, :]) / 2
        to_z[lo:hi] = margin.argmax(axis=1)
        at = margin.argmax(axis=0)
        if whole is not None:
            to_e = at
        else:
            high = margin[at, np.arange(m)]
            better = high > best
            to_e[better], best[better] = at[better] + lo, high[better]
        i, j = np.nonzero(c > 0.2)
        near_e.append(i + lo)
        near_z.append(j)
        near_cos.append(c[i, j])
    near_e, near_z, near_cos = (x[0] if len(x) == 1 else np.concatenate(x) for x in (near_e, near_z, near_cos))

    def cosine(i: int, j: int) -> float:
        return float(whole[i, j]) if whole is not None else float(e_unit[i] @ z_unit[j])

    to_z, to_e = to_z.tolist(), to_e.tolist()
    of_e: dict[int, list[int]] = {}
    of_z: dict[int, list[int]] = {}

    def link(i: int, j: int) -> None:
        of_e.setdefault(i, []).append(j)
        of_z.setdefault(j, []).append(i)

    for i, j in enumerate(to_z):
        if to_e[j] == i and cosine(i, j) >= least:
            link(i, j)
    if n == m == len(of_e):
        # all sentences have a partner: only a pair that is similar besides could still be linked
        keep = near_cos > 0.35
        if np.count_nonzero(keep) == n:
            return [(i, j) for i, js in of_e.items() for j in js]
        near_e, near_z, near_cos = near_e[keep], near_z[keep], near_cos[keep]

    def like(a: np.ndarray, b: np.ndarray) -> float:
        return float(a @ b / max(1e-9, float(np.sqrt((a @ a) * (b @ b)))))

    for o in np.argsort(-near_cos, kind="stable").tolist():
        i, j, cos = int(near_e[o]), int(near_z[o]), float(near_cos[o])
        js, es = of_e.get(i, []), of_z.get(j, [])
        if j in js:
            continue
        if not js and not es:
            if cos >= least:
                link(i, j)
            continue
        if es:  # the Chinese sentence renders others already: it has to be explained better with this one
            held = en[es].sum(axis=0)
            if like(held + en[i], zh[j]) < like(held, zh[j]) + (gain if js or cos < least else gain / 4):
                continue
        if js:  # the English sentence is rendered already: it has to be covered better with this one
            held = zh[js].sum(axis=0)
            if like(en[i], held + zh[j]) < like(en[i], held) + (gain if es or cos < least else gain / 4):
                continue
        link(i, j)
    # a divided sentence's other half: next to a half that is linked, as rich in terms as a sentence, and similar
    left = [j for j in range(m) if j not in of_z]
    rich = np.linalg.norm(zh, axis=1) if left else np.empty(0)
    usual = np.median(rich) if left else 0.0
    for j in (j for j in left if rich[j] >= 0.6 * usual):
        beside = [i for k in (j - 1, j + 1) for i in of_z.get(k, [])]
        if beside and cosine(i := max(beside, key=lambda i: cosine(i, j)), j) >= 0.2 and to_e[j] == i:
            link(i, j)
    return [(i, j) for i, js in of_e.items() for j in js]


class _Numbers(dict):
    """The numbers of English tokens: of the word's vector, -1 for a word without vector, -2, -3 and so on for anchors."""

    def __init__(self, words: dict[str, int]):
        self.words = words
        self.anchors: dict[str, int] = {}
        #: ``ANCHORS`` random signs of each anchor, as bits.
        self.signs = bytearray()

    def __missing__(self, token: str) -> int:
        if not token[0].isdigit() and token.islower():
            number = self.words.get(token, -1)
        else:
            anchor = token.replace(",", "") if token[0].isdigit() else token.lower()
            number = self.anchors.get(anchor, 0)
            if not number:
                number = self.anchors[anchor] = -2 - len(self.anchors)
                self.signs += np.packbits(np.frombuffer(np.random.default_rng(zlib.crc32(anchor.encode())).bytes(ANCHORS), np.uint8) & 1).tobytes()
        self[token] = number
        return number


class Aligner:
    """Aligns batches of (English text, Chinese text)."""

    def __init__(self, vectors: TermVectors):
        self.v = vectors
        self.number, self.ids = vectors.tables()
        self.known = _Numbers(vectors.words)

    def align(self, pairs: list[tuple[str, str]], least_english: list[int]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(position, links) of each pair; pairs with fewer English sentences than wanted give no links."""
        en_ids: list[int] = []
        en_size: list[int] = []
        zh_ids: list[int] = []
        zh_owner: list[int] = []
        zh_text: list[str] = []
        spans: list[tuple[int, int, int, int, int]] = []
        e0 = z0 = 0
        if len(self.known) > 500_000:
            self.known = _Numbers(self.v.words)
        number_of, anchors = self.known.__getitem__, self.known.anchors
        for at, (e, z) in enumerate(pairs):
            es = english_sentences(plain(e))
            if len(es) < least_english[at]:
                continue
            zs = chinese_sentences(plain(z))
            begun = len(en_ids)
            for s in es:
                tokens = _tokens(s)
                if tokens and tokens[0][0].isupper() and (len(tokens[0]) == 1 or tokens[0][1:].islower()):
                    tokens[0] = tokens[0].lower()  # the first word's capital tells nothing
                en_ids += map(number_of, tokens)
                en_size.append(len(tokens))
            here = {i for i in en_ids[begun:] if i < -1}
            if here:
                for k, s in enumerate(zs, z0):
                    for t in chinese_anchors(s):
                        if (i := anchors.get(t)) in here:  # a sign that the English text hasn't got tells nothing
                            zh_ids.append(i)
                            zh_owner.append(k)
            zh_text += zs
            spans.append((at, e0, e0 + len(es), z0, z0 + len(zs)))
            e0, z0 = e0 + len(es), z0 + len(zs)
        width = self.v.dimensions
        en = np.empty((e0, width + ANCHORS), np.float32)
        zh = np.empty((z0, width + ANCHORS), np.float32)
        ids, owner = np.array(en_ids, np.int64), np.repeat(np.arange(e0), en_size)
        words, names = np.flatnonzero(ids >= 0), np.flatnonzero(ids < -1)
        en_terms, zh_terms = _sums(self.v.en.__getitem__, width, ids[words], owner[words], e0), np.zeros((z0, width), np.float32)
        if z0:
            codes = np.frombuffer("".join(zh_text).encode("utf-16-le", "replace"), np.uint16)
            lengths = np.array([len(s.encode("utf-16-le", "replace")) // 2 for s in zh_text])
            number = self.number[codes]
            found = self.ids[number[:-1], number[1:]] if len(number) > 1 else np.empty(0, np.int32)
            of = np.repeat(np.arange(z0), lengths)
            keep = np.flatnonzero((found >= 0) & (of[:-1] == of[1:])) if len(found) else np.empty(0, np.int64)
            zh_terms = _sums(self.v.zh.__getitem__, width, found[keep], of[keep], z0)
        # both sides on one scale, then the anchors
        for vectors, terms in ((en, en_terms), (zh, zh_terms)):
            vectors[:, :width] = _unit(terms) * np.sqrt(np.maximum(1, np.linalg.norm(terms, axis=1, keepdims=True)))
        signs, scale = np.frombuffer(bytes(self.known.signs), np.uint8).reshape(-1, ANCHORS // 8), np.float32(self.v.weight / np.sqrt(ANCHORS))

        def anchor(ids: np.ndarray) -> np.ndarray:
            return (np.unpackbits(signs[-2 - ids], axis=1).astype(np.float32) * 2 - 1) * scale

        en[:, width:] = _sums(anchor, ANCHORS, ids[names], owner[names], e0)
        zh[:, width:] = _sums(anchor, ANCHORS, np.array(zh_ids, np.int64), np.array(zh_owner, np.int64), z0)
        en_unit, zh_unit = _unit(en), _unit(zh)
        for at, e1, e2, z1, z2 in spans:
            yield at, match(en[e1:e2], zh[z1:z2], units=(en_unit[e1:e2], zh_unit[z1:z2]))


def learn(pairs: DataFrame, english: str, chinese: str) -> TermVectors:
    """Vectors from all pairs of which both texts are there."""
    return TermVectors.learned(pick(pairs, _en=english, _zh=chinese).where("_en IS NOT NULL AND _zh IS NOT NULL"))


_ROWS = "unit string, rec_no bigint, en_no bigint, zh_no bigint"


def _link(held: Broadcast):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors, model = held.value
        aligner = Aligner(vectors)
        for part in parts:
            part = part[[bool(e) and bool(z) for e, z in zip(part["_en"], part["_zh"])]]
            if model is not None and len(part):
                judged = part[part["_least"] >= 2]
                broken = [i for i, d in zip(judged.index, model.defects(judged["_en"].tolist(), judged["_zh"].tolist())) if d is not None]
                part = part.drop(index=broken)
            unit, key = part["_unit"].to_numpy(), part["_key"].to_numpy()
            units, keys, ens, zhs = [], [], [], []
            for at, links in aligner.align([*zip(part["_en"], part["_zh"])], part["_least"].tolist()):
                units += [unit[at]] * len(links)
                keys += [key[at]] * len(links)
                ens += [i for i, _ in links]
                zhs += [j for _, j in links]
            yield pd.DataFrame({"unit": pd.Series(units, dtype=object), "rec_no": pd.Series(keys, dtype="int64"), "en_no": pd.Series(ens, dtype="int64"), "zh_no": pd.Series(zhs, dtype="int64")})

    return run


def sentence_pairs(pairs: DataFrame, vectors: TermVectors, model: PairModel | None = None) -> DataFrame:
    """(unit, rec_no, en_no, zh_no) of the sentences that render each other.

    ``pairs`` has (_unit, _key, _en, _zh, _least): pairs with fewer than ``_least`` English sentences are left out, and where that is
    two or more, pairs that ``model`` finds defective. Null or blank texts give no rows; a text without end marks is one sentence;
    repeated rows give their links once.
    """
    rows = pairs.select("_unit", F.col("_key").cast("bigint").alias("_key"), "_en", "_zh", "_least").where("_key IS NOT NULL")
    held = pairs.sparkSession.sparkContext.broadcast((vectors, model))  # vectors: see VOCABULARY; the pair model grows with the distinct ends of responses
    return rows.mapInPandas(_link(held), _ROWS).distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence pairs of the abstracts and of the translated body blocks."""
    literature = table(spark, sf_dir, "literature").select("rec_id", "abstract_en", "abstract_zh").where("abstract_en <> '' AND abstract_zh <> ''")
    abstracts = literature.select(F.lit("abstract").alias("_unit"), F.col("rec_id").alias("_key"), F.col("abstract_en").alias("_en"), F.col("abstract_zh").alias("_zh"), F.lit(1).alias("_least"))
    entries = table(spark, sf_dir, "translations").where("NOT coalesce(skip, false) AND NOT coalesce(blank, false) AND zh IS NOT NULL").select("entry_id", "block_key", "zh")
    body = table(spark, sf_dir, "blocks").where("kind = 'body' AND text IS NOT NULL").select("block_key", "text")
    joined = entries.join(body, "block_key")
    blocks = joined.select(F.lit("block").alias("_unit"), F.col("entry_id").alias("_key"), F.col("text").alias("_en"), F.col("zh").alias("_zh"), F.lit(2).alias("_least"))
    vectors = learn(literature, "abstract_en", "abstract_zh")
    return sentence_pairs(abstracts.unionByName(blocks), vectors, translation_model(spark, sf_dir))


QUERIES = {"p2_found": p2_found}
ORACLES: dict[str, str] = {}
