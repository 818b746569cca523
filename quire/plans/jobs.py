"""The jobs of a run: prepare blocks, translate what is missing, check. Every stage writes a table and commits it with a manifest.

A stage's table is written under a new name and becomes current when its manifest is written, which is the last step; a job that was
interrupted leaves no manifest, and the next run repeats the stage. Lost executors only repeat tasks.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity
from ..operators import flow, layout, planning, quality, translate


def commit(df: DataFrame, store: str, stage: str) -> DataFrame:
    """Write a stage's rows and, after them, its manifest; returns the rows as written."""
    spark = df.sparkSession
    version = f"{time.time_ns():020d}"
    df.write.parquet(f"{store}/{stage}/data/{version}")
    rows = spark.read.parquet(f"{store}/{stage}/data/{version}")
    rows.agg(F.lit(version).alias("version"), F.count("*").alias("n_rows")).coalesce(1).write.mode("append").json(f"{store}/{stage}/manifest")
    return rows


def current(spark: SparkSession, store: str, stage: str) -> DataFrame | None:
    """The rows of a stage's last committed version, None if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{stage}/manifest")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    version = spark.read.schema("version STRING, n_rows BIGINT").json(f"{store}/{stage}/manifest").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{store}/{stage}/data/{version}") if version else None


def prepare(blocks: DataFrame) -> DataFrame:
    """Blocks with reading order, continuation marks and identities. Blocks have paper_id, page, block_key, box, col, kind, text."""
    ordered = layout.reading_order(blocks).withColumn("flow_index", F.col("position")).withColumn("flow_break", F.col("breaks")).drop("position", "breaks")
    runs = layout.page_continuations(ordered)
    flagged = ordered.join(runs.select(F.col("last_key").alias("block_key"), F.lit(True).alias("continues_to_next")), "block_key", "left").join(runs.select(F.col("first_key").alias("block_key"), F.lit(True).alias("continues_from_prev")), "block_key", "left")
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    return flagged.withColumns({"source_hash": identity.source_hash(F.col("page"), F.col("text")), "layout_uid": identity.layout_uid(F.col("page"), F.col("col"), box, F.col("text"))})


def pending(blocks: DataFrame, done: DataFrame | None, budget: int = 4000, skipped: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(batch, id, text, pos) of the blocks without a valid translation, in flow batches; ``done`` has block_key, zh, source_hash, layout_uid.

    ``skipped`` (block_key) are left out, and no batch goes across one; without it, blocks of the kinds table, meta and math_only are. ``limit`` keeps the
    first items only (a trial run). If ``blocks`` has fragments, their markers are spliced into the text and handed on as specs.
    """
    if "fragments" in blocks.columns:
        specs = identity.fragment_specs(F.col("fragments"))
        blocks = blocks.withColumn("specs", specs).withColumn("text", identity.translation_source(F.col("text"), F.col("specs"))).drop("fragments")
    kept = ["paper_id", "page", "block_key", "kind", "flow_index", "flow_break", *[c for c in ("source_hash", "layout_uid") if c in blocks.columns]]
    items = planning.positions(blocks.select(*kept, F.length("text").alias("n_chars")))  # texts are fetched at the end
    if done is not None:
        valid = planning.resume_status(done.where("zh <> ''"), blocks).where("status = 'valid'").select("block_key")
        items = items.join(valid, "block_key", "left_anti")
    items = items.where("coalesce(kind, '') NOT IN ('table', 'meta', 'math_only')") if skipped is None else items.join(skipped.select("block_key"), "block_key", "left_anti")
    if limit is not None:
        items = planning.first_items(items, limit)
    breaks = F.coalesce("flow_break", F.lit(False)) | F.coalesce(F.col("kind").isin(*layout.STRUCTURAL), F.lit(False))
    batches = planning.flow_batches(items, breaks, budget)
    texts = blocks.select("block_key", "text", *[c for c in ("specs",) if c in blocks.columns])
    return batches.join(texts, "block_key").select(F.concat_ws(".", flow.DOC, "run", "batch").alias("batch"), F.col("block_key").cast("string").alias("id"), "text", F.col("position").alias("pos"), *texts.columns[2:])


def run(spark: SparkSession, blocks: DataFrame, terms: DataFrame, store: str, translator: translate.Translator) -> DataFrame:
    """Prepare, translate what is missing, check: the rows of the quality report. Repeated runs translate only what changed."""
    ready = commit(prepare(blocks), store, "blocks")
    done = current(spark, store, "translations")
    made = translate.translate(pending(ready, done), translator).select(F.col("id").cast("bigint").alias("block_key"), "zh")
    fresh = made.join(ready.select("block_key", "source_hash", "layout_uid"), "block_key").select("block_key", "zh", "source_hash", "layout_uid")
    kept = fresh if done is None else done.join(fresh.select("block_key"), "block_key", "left_anti").unionByName(fresh)
    entries = commit(kept, store, "translations")
    wanted = ready.where("coalesce(kind, '') NOT IN ('table', 'meta', 'math_only')").select("block_key", "text")
    return commit(quality.report(wanted.join(entries.select("block_key", "zh"), "block_key", "left"), terms), store, "report")
