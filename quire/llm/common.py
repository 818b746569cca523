"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the directory ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its literal name, even one with dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Keep only the named columns under internal names, so that extra columns can't clash: ``pick(df, _id="doc_id")``."""
    return df.select(*[col(source).alias(alias) for alias, source in names.items()])


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the folder the cluster names in spark.checkpoint.dir and read it from there.

    Where the setting is missing, a temporary folder is used on a single machine (tests); on a cluster that is an error, as no
    other machine could read it.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            folder = os.path.join(tempfile.gettempdir(), "quire-checkpoints")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


#: Adds counts of (kind, item) for the rows of a part.
Count = Callable[[pd.DataFrame, Counter], None]


def summed(df: DataFrame, count: Count, most: int = 500_000) -> DataFrame:
    """(kind, item, n): what ``count`` counts in all rows of ``df``.

    A task sums its parts and gives its counts on when there are more than ``most``; the sums are made by item in a shuffle. No row
    is left out, and sums of whole numbers are the same at any partitioning.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for part in parts:
            count(part, held)
            if len(held) > most:
                yield _frame(held)
                held.clear()
        yield _frame(held)

    return df.mapInPandas(run, "kind string, item string, n bigint").groupBy("kind", "item").agg(F.sum("n").alias("n"))


def gathered(counts: DataFrame) -> dict[str, Counter]:
    """The rows (kind, item, n) as counts of each kind."""
    out: dict[str, Counter] = {}
    for batch in counts.toArrow().to_batches():
        for kind, item, n in zip(*(c.to_pylist() for c in batch.columns)):
            out.setdefault(kind, Counter())[item] = n
    return out


def tally(df: DataFrame, count: Count) -> dict[str, Counter]:
    """The items of each kind that ``count`` counts in all rows of ``df``, with their numbers; the driver gets each item once."""
    return gathered(summed(df, count))


def _frame(held: Counter) -> pd.DataFrame:
    return pd.DataFrame({"kind": pd.Series([k for k, _ in held], dtype=object), "item": pd.Series([i for _, i in held], dtype=object), "n": pd.Series([*held.values()], dtype="int64")})


def tally_here(rows: pd.DataFrame, count: Count) -> dict[str, Counter]:
    """``tally`` of rows that are at hand."""
    held: Counter = Counter()
    count(rows, held)
    out: dict[str, Counter] = {}
    for (kind, item), n in held.items():
        out.setdefault(kind, Counter())[item] = n
    return out
