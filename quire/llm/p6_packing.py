"""Problem 6: filling containers of fixed capacity with texts, by a distributed grouping genetic algorithm.

Texts are measured in tokens of a public tokenizer. A text longer than a capacity fills containers of its own and its rest is
an item; all other texts stay whole. Items are dealt by hash to shards of bounded size; of every shard, several islands evolve
packings in parallel tasks. A crossover injects whole well-filled bins of one parent into the other, removes the bins that hold
an item twice, and puts the displaced items back by best fit, largest first; a mutation empties the worst bins. After each epoch
every island's elite migrates to its neighbour (a window over the shard's few islands). A shard stops when its number of bins
meets the lower bound. Bins that remain poorly filled are opened at the end, and their items packed once more across shards.
"""

from __future__ import annotations

import base64
import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, pick, table

#: Path of a rank file (token in base64, blank, rank), a parameter of all functions that count tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The pattern that splits texts before the merges of such a file (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(ranks: bytes):
    import tiktoken

    pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("quire", pat_str=PATTERN, mergeable_ranks=pairs, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(_key, _tokens) of every text with tokens. Null and empty texts have none and give no row; repeated rows give one.

    The tokenizer's file is read on the driver and broadcast (about a megabyte, whatever the data), so no other machine needs it.
    """
    with open(tokenizer, "rb") as file:
        held = df.sparkSession.sparkContext.broadcast(file.read())

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(held.value).encode_ordinary
        for part in parts:
            yield pd.DataFrame({"_key": part["_key"], "_tokens": pd.Series([len(encode(t)) for t in part["_text"]], index=part.index, dtype="int64")})

    rows = pick(df, _key=key, _text=text).where("_key IS NOT NULL AND _text <> ''").withColumn("_key", F.col("_key").cast("bigint"))
    return rows.mapInPandas(run, "_key bigint, _tokens bigint").where("_tokens > 0").groupBy("_key").agg(F.max("_tokens").alias("_tokens"))


Packing = list[list[int]]


class Evolution:
    """Packings of items with given sizes, all at most ``capacity``."""

    def __init__(self, sizes: list[int], capacity: int, seed: int):
        self.sizes, self.capacity, self.random = sizes, capacity, random.Random(seed)
        total = sum(sizes)
        large = [s for s in sizes if 2 * s > capacity]
        # no two items above half a bin share one; what fits in beside them is at most their free room
        room = sum(capacity - s for s in large)
        self.bound = max(-(-total // capacity), len(large) + max(0, -(-(total - sum(large) - room) // capacity)))

    def best_fit(self, bins: Packing, items: list[int]) -> Packing:
        """Adds ``items`` to ``bins``, largest first, each to the fullest bin that has room for it."""
        sizes, capacity = self.sizes, self.capacity
        free = sorted((capacity - sum([sizes[i] for i in b]), n) for n, b in enumerate(bins))
        for i in sorted(items, key=lambda i: -sizes[i]):
            at = bisect_left(free, (sizes[i], -1))
            if at < len(free):
                left, n = free.pop(at)
                bins[n].append(i)
            else:
                left, n = capacity, len(bins)
                bins.append([i])
            insort(free, (left - sizes[i], n))
        return bins

    def fills(self, bins: Packing) -> list[float]:
        sizes, capacity = self.sizes, self.capacity
        return [sum([sizes[i] for i in b]) / capacity for b in bins]

    def fitness(self, bins: Packing) -> float:
        """Mean squared fill: prefers few bins, and among as many, full ones beside an empty one."""
        return sum(x * x for x in self.fills(bins)) / max(1, len(bins))

    def start(self, n: int) -> list[Packing]:
        """Best fit decreasing, and best fit with sizes blurred."""
        out = [self.best_fit([], [*range(len(self.sizes))])]
        while len(out) < n:
            bins: Packing = []
            order = sorted(range(len(self.sizes)), key=lambda i: -self.sizes[i] * self.random.uniform(0.8, 1.2))
            for k in range(0, len(order), max(1, len(order) // 8)):
                bins = self.best_fit(bins, order[k : k + max(1, len(order) // 8)])
            out.append(bins)
        return out

    def cross(self, a: Packing, b: Packing) -> Packing:
        """Well-filled bins of ``a`` in ``b``."""
        fills = self.fills(a)
        good = sorted(range(len(a)), key=lambda n: -fills[n])[: max(1, len(a) // 2)]
        chosen = self.random.sample(good, max(1, len(good) // 4))
        injected = {i for n in chosen for i in a[n]}
        kept = [[*x] for x in b if injected.isdisjoint(x)]
        displaced = [i for x in b if not injected.isdisjoint(x) for i in x if i not in injected]
        return self.best_fit(kept + [[*a[n]] for n in chosen], displaced)

    def mutate(self, a: Packing) -> Packing:
        """Empties some of the worst bins and a few others at random, and packs their items again."""
        fills = self.fills(a)
        order = sorted(range(len(a)), key=lambda n: fills[n])
        gone = {*order[: max(2, len(a) // 50)], *self.random.sample(range(len(a)), min(len(a), max(2, len(a) // 50)))}
        items = [i for n in gone for i in a[n]]
        self.random.shuffle(items)
        kept = [[*x] for n, x in enumerate(a) if n not in gone]
        half = len(items) // 2
        return self.best_fit(self.best_fit(kept, items[:half]), items[half:])

    def run(self, elites: list[Packing], population: int, generations: int) -> list[tuple[float, Packing]]:
        """The population after so many generations, best first; ends early at the lower bound."""
        if not elites:
            first = self.start(1)
            if len(first[0]) <= self.bound:
                return [(self.fitness(first[0]), first[0])]
        people = [(self.fitness(p), p) for p in elites]
        if len(people) < population:
            people += [(self.fitness(p), p) for p in self.start(population - len(people))]
        people.sort(key=lambda x: -x[0])
        for _ in range(generations):
            if len(people[0][1]) <= self.bound:
                break
            (_, a), (_, b) = sorted(self.random.sample(people, 3), key=lambda x: -x[0])[:2] if len(people) > 2 else (people[0], people[-1])
            for child in (self.mutate(self.cross(a, b)), self.cross(b, a)):
                people.append((self.fitness(child), child))
            people.sort(key=lambda x: -x[0])
            del people[population:]
        return people


def _evolve(population: int, generations: int):
    """mapInPandas function: one row is one island of one shard; ``elites`` hold the bin of each item."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            best, count, done = [], [], []
            for pack, shard, island, capacity, sizes, elites in zip(part["_pack"], part["_shard"], part["_island"], part["_capacity"], part["_sizes"], part["_elites"]):
                evolution = Evolution([int(s) for s in sizes], int(capacity), zlib.crc32(f"{pack} {shard} {island} {len(elites)}".encode()))
                start: list[Packing] = []
                for elite in elites:
                    bins: dict[int, list[int]] = {}
                    for i, n in enumerate(elite):
                        bins.setdefault(int(n), []).append(i)
                    start.append([*bins.values()])
                if start and len(start[0]) <= evolution.bound:
                    people = [(evolution.fitness(start[0]), start[0])]
                else:
                    people = evolution.run(start, population, generations)
                rows = []
                for _, p in people[:2]:
                    row = [0] * len(sizes)
                    for n, items in enumerate(p):
                        for i in items:
                            row[i] = n
                    rows.append(row)
                best.append(rows)
                count.append(len(people[0][1]))
                done.append(people[0][0])
            yield part.drop(columns=["_elites"]).assign(_elites=best, _bins=count, _fitness=done)

    return run


_ISLAND = "_pack bigint, _capacity bigint, _shard bigint, _island int, _keys array<bigint>, _pieces array<bigint>, _sizes array<bigint>"


def evolve_shards(items: DataFrame, count: int, shard_items: int, islands: int, epochs: int, population: int, generations: int, level: int) -> DataFrame:
    """(_pack, _capacity, _bin, _key, _piece, _tokens): packings of ``items`` (_pack, _capacity, _key, _piece, _tokens), about ``count`` rows."""
    shards = max(1, -(-count // shard_items))
    dealt = items.withColumn("_shard", F.pmod(F.xxhash64("_key", "_piece", F.lit(level)), F.lit(shards)).cast("bigint"))
    grouped = dealt.groupBy("_pack", "_capacity", "_shard").agg(F.sort_array(F.collect_list(F.struct("_tokens", "_key", "_piece")), asc=False).alias("_i"))
    state = grouped.select(
        "_pack", "_capacity", "_shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("_island"),
        F.col("_i._key").alias("_keys"), F.col("_i._piece").alias("_pieces"), F.col("_i._tokens").alias("_sizes"), F.array().cast("array<array<int>>").alias("_elites"),
    )
    tasks = max(1, min(-(-shards * islands * 3 // 6), 20_000))
    ring = Window.partitionBy("_pack", "_shard").orderBy("_island")
    for epoch in range(epochs):
        if epoch:  # the elite of the next island comes over
            best = F.element_at("_elites", 1)
            guest = F.coalesce(F.lead(best).over(ring), F.first(best).over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
            state = state.withColumn("_guest", guest).withColumn("_elites", F.concat("_elites", F.array("_guest"))).drop("_guest", "_bins", "_fitness")
        state = state.repartition(tasks, "_pack", "_shard", "_island").mapInPandas(_evolve(population, generations), _ISLAND + ", _elites array<array<int>>, _bins int, _fitness double")
    best = state.groupBy("_pack", "_capacity", "_shard").agg(F.max_by(F.struct("_keys", "_pieces", "_sizes", F.element_at("_elites", 1).alias("_bin")), F.struct(-F.col("_bins"), "_fitness", -F.col("_island"))).alias("_b"))
    rows = best.select("_pack", "_capacity", "_shard", F.explode(F.arrays_zip("_b._keys", "_b._pieces", "_b._sizes", "_b._bin")).alias("_r"))
    return rows.select(
        "_pack", "_capacity", F.concat_ws(".", F.lit(level), F.col("_shard"), F.col("_r._bin")).alias("_bin"),
        F.col("_r._keys").alias("_key"), F.col("_r._pieces").alias("_piece"), F.col("_r._sizes").alias("_tokens"),
    )


def pack(
    counts: DataFrame, packs: DataFrame, pack_id: str = "pack_id", capacity: str = "capacity_tokens", shard_items: int = 2000, islands: int = 2, epochs: int = 2,
    population: int = 6, generations: int = 8, full: float = 0.97,
) -> DataFrame:
    """(_pack, _capacity, _bin, _key, _piece, _tokens) of all pieces of all texts, for every capacity of ``packs``.

    ``counts`` is (_key, _tokens). A text above the capacity gives pieces of exactly the capacity, each a container of its own, and a last
    piece that is packed like other items; any other text is one piece. Rows of ``packs`` with a null or non-positive capacity are left out.
    ``packs`` has a row per container size and is a parameter: for each of its rows all texts are packed. Empty tables give no rows.
    """
    sizes = sorted({(r[0], r[1]) for r in pick(packs, _p=pack_id, _c=capacity).where("_p IS NOT NULL AND _c > 0").distinct().collect()})
    counts = cut_lineage(counts)
    spark = counts.sparkSession
    total = counts.count()
    wanted = F.array(*[F.struct(F.lit(p).cast("bigint").alias("_pack"), F.lit(c).cast("bigint").alias("_capacity")) for p, c in sizes]) if sizes else None
    if not total or wanted is None:
        return spark.createDataFrame([], "_pack bigint, _capacity bigint, _bin string, _key bigint, _piece bigint, _tokens bigint")
    every = counts.select("_key", "_tokens", F.explode(wanted).alias("_w")).select("_w.*", "_key", "_tokens")
    whole = F.floor(F.col("_tokens") / F.col("_capacity")).cast("bigint")
    rest = (F.col("_tokens") % F.col("_capacity")).cast("bigint")
    filled = every.where(F.col("_tokens") >= F.col("_capacity")).select("_pack", "_capacity", "_key", F.explode(F.sequence(F.lit(0).cast("bigint"), whole - 1)).alias("_piece"), F.col("_capacity").alias("_tokens"))
    filled = filled.select("_pack", "_capacity", F.concat_ws(".", F.lit("full"), F.col("_key"), F.col("_piece")).alias("_bin"), "_key", "_piece", "_tokens")
    items = every.where(rest > 0).select("_pack", "_capacity", "_key", whole.alias("_piece"), rest.alias("_tokens"))
    first = cut_lineage(evolve_shards(items, total, shard_items, islands, epochs, population, generations, 0))
    used = first.groupBy("_pack", "_bin").agg(F.sum("_tokens").alias("_used"))
    marked = first.join(used, ["_pack", "_bin"])
    poor = F.col("_used") < full * F.col("_capacity")
    open_items = marked.where(poor).drop("_used", "_bin")
    left = open_items.groupBy("_pack").count().agg(F.max("count")).collect()[0][0] or 0
    again = evolve_shards(open_items, left, shard_items, islands, epochs, population, generations, 1)
    return filled.unionByName(marked.where(~poor).drop("_used")).unionByName(again)


def _packed(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    return pack(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer), table(spark, sf_dir, "pack_sizes"))


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pack_id, container, doc_id, piece, first_token, tokens): which part of which text lies in which container."""
    return _packed(spark, sf_dir).select(
        F.col("_pack").alias("pack_id"), F.col("_bin").alias("container"), F.col("_key").alias("doc_id"), F.col("_piece").alias("piece"),
        (F.col("_piece") * F.col("_capacity")).alias("first_token"), F.col("_tokens").alias("tokens"),
    )


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pack_id, capacity, containers, tokens, fill): how well the containers of each size are filled."""
    rows = _packed(spark, sf_dir).groupBy("_pack", "_capacity", "_bin").agg(F.sum("_tokens").alias("_used"))
    out = rows.groupBy(F.col("_pack").alias("pack_id"), F.col("_capacity").alias("capacity")).agg(F.count("*").alias("containers"), F.sum("_used").alias("tokens"))
    return out.withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity")))


def p6_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pack_id, texts, split, incomplete, overfull): texts packed, texts split though they fit, texts of which a token is missing or packed
    twice, and containers above their capacity."""
    packed = cut_lineage(_packed(spark, sf_dir))
    counts = token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    pieces = packed.groupBy("_pack", "_capacity", "_key").agg(F.count("*").alias("_n"), F.sum("_tokens").alias("_sum"), F.count_distinct("_piece").alias("_d"), F.max("_piece").alias("_last"))
    texts = pieces.join(counts, "_key", "full").groupBy("_pack").agg(
        F.count("_key").alias("texts"), F.count_if((F.col("_n") > 1) & (F.col("_tokens") <= F.col("_capacity"))).alias("split"),
        F.count_if(F.coalesce((F.col("_sum") != F.col("_tokens")) | (F.col("_n") != F.col("_d")) | (F.col("_last") != F.col("_n") - 1), F.lit(True))).alias("incomplete"),
    )
    bins = packed.groupBy("_pack", "_capacity", "_bin").agg(F.sum("_tokens").alias("_used")).groupBy("_pack").agg(F.count_if(F.col("_used") > F.col("_capacity")).alias("overfull"))
    return texts.join(bins, "_pack", "left").select(F.col("_pack").alias("pack_id"), "texts", "split", "incomplete", "overfull")


QUERIES = {"p6_packing": p6_packing, "p6_fill": p6_fill, "p6_invariants": p6_invariants}
ORACLES = {
    "p6_invariants": """SELECT pack_id, (SELECT count(DISTINCT doc_id) FROM documents WHERE text <> '') AS texts, 0::BIGINT AS split, 0::BIGINT AS incomplete, 0::BIGINT AS overfull
        FROM (SELECT DISTINCT pack_id FROM pack_sizes WHERE capacity_tokens > 0)""",
}
