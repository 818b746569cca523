"""Operators along the document flow (document, page, position), without putting a whole document into one window.

Order matters across pages, but a single document may hold a third of all blocks. So neighbours and carried values are found
within pages first; one summary row per page then carries them across pages, and only pages are ordered per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DOC, PAGE = "paper_id", "page"

def flow_order() -> list[Column]:
    """Order within a page, missing positions last."""
    return [F.col("flow_index").isNull(), F.col("flow_index"), F.col("block_key")]


def _summaries(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Per page: the value of its last row, and the last row's of the pages before (null on the first)."""
    last = df.groupBy(DOC, PAGE).agg(F.max_by(value, F.struct(*flow_order())).alias("_last"))
    pages = Window.partitionBy(DOC).orderBy(PAGE)
    return last.select(DOC, PAGE, F.lag("_last").over(pages).alias(name))


def previous(df: DataFrame, columns: list[str], prefix: str = "prev_") -> DataFrame:
    """Adds the columns of the row before in document order, as ``prefix`` + name."""
    row = F.struct(*[F.col(c).alias(c) for c in columns], F.lit(True).alias("_is"))
    page = Window.partitionBy(DOC, PAGE).orderBy(*flow_order())
    out = df.withColumn("_row", row).withColumn("_in", F.lag("_row").over(page))
    out = out.join(_summaries(df.withColumn("_row", row), F.col("_row"), "_before"), [DOC, PAGE])
    held = F.coalesce("_in", "_before")
    return out.withColumns({prefix + c: held[c] for c in columns}).drop("_row", "_in", "_before")


def following(df: DataFrame, columns: list[str], prefix: str = "next_") -> DataFrame:
    """Adds the columns of the row after in document order, as ``prefix`` + name."""
    row = F.struct(*[F.col(c).alias(c) for c in columns], F.lit(True).alias("_is"))
    page = Window.partitionBy(DOC, PAGE).orderBy(*flow_order())
    held = df.withColumn("_row", row)
    first = held.groupBy(DOC, PAGE).agg(F.min_by("_row", F.struct(*flow_order())).alias("_first"))
    after = first.select(DOC, PAGE, F.lead("_first").over(Window.partitionBy(DOC).orderBy(PAGE)).alias("_after"))
    out = held.withColumn("_in", F.lead("_row").over(page)).join(after, [DOC, PAGE])
    row = F.coalesce("_in", "_after")
    return out.withColumns({prefix + c: row[c] for c in columns}).drop("_row", "_in", "_after")


def carried(df: DataFrame, value: Column, name: str, inclusive: bool = True) -> DataFrame:
    """Adds the last non-null ``value`` up to the row (or, not ``inclusive``, before it) in document order."""
    end = 0 if inclusive else -1
    page = Window.partitionBy(DOC, PAGE).orderBy(*flow_order()).rowsBetween(Window.unboundedPreceding, end)
    held = df.withColumn("_v", value)
    last = held.where("_v IS NOT NULL").groupBy(DOC, PAGE).agg(F.max_by("_v", F.struct(*flow_order())).alias("_last"))
    pages = df.select(DOC, PAGE).distinct().join(last, [DOC, PAGE], "left")
    before = Window.partitionBy(DOC).orderBy(PAGE).rowsBetween(Window.unboundedPreceding, -1)
    carry = pages.select(DOC, PAGE, F.last("_last", ignorenulls=True).over(before).alias("_before"))
    out = held.withColumn("_in", F.last("_v", ignorenulls=True).over(page)).join(carry, [DOC, PAGE])
    return out.withColumn(name, F.coalesce("_in", "_before")).drop("_v", "_in", "_before")


def greedy_batches(runs: DataFrame, keys: list[str], order: list[str], cost: Column, budget: int) -> DataFrame:
    """Adds ``batch`` (from 0 per run): a row opens a batch if the open one is not empty and would exceed ``budget``.

    Greedy packing depends on all rows before, so runs are sorted within partitions and streamed: one open batch is held at a time, and a run is
    never collected, however long. Null orders sort last.
    """
    kinds = dict(runs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, *order]) + ", batch bigint"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, used, batch = None, 0, -1
        for part in parts:
            out = []
            for key, spent in zip(zip(*[part[k] for k in keys]), part["_cost"].tolist()):
                if key != current:
                    current, used, batch = key, 0, -1
                if batch < 0 or used + spent > budget:
                    used, batch = 0, batch + 1
                used += spent
                out.append(batch)
            yield part[[*keys, *order]].assign(batch=pd.Series(out, index=part.index, dtype="int64"))

    rows = runs.select(*keys, *order, cost.cast("bigint").alias("_cost"))
    return rows.repartition(*keys).sortWithinPartitions(*keys, *[F.col(c).asc_nulls_last() for c in order]).mapInPandas(run, schema)
