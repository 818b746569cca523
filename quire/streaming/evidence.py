"""Terminology evidence as a stream: files arrive, terms are folded, every micro-batch is exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import terminology

EVIDENCE = "kb_id INT, source STRING, target STRING, confidence DOUBLE, kind STRING, paper STRING, seq BIGINT"


def late_rows(stream: DataFrame, event: str, delay: str, window: str) -> DataFrame:
    """Rows per window of event time; rows later than ``delay`` are dropped once their window has closed."""
    return stream.withWatermark(event, delay).groupBy(F.window(event, window)).agg(F.count("*").alias("n_rows"))


def stream_upsert(spark: SparkSession, incoming: str, store: str, checkpoint: str) -> StreamingQuery:
    """Keep the evidence of all Parquet files that arrive in ``incoming``, partitioned by batch, in ``store``.

    A repeated batch overwrites its own partition, so a restart after a loss neither drops nor doubles evidence. ``terms`` folds the store.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")

    stream = spark.readStream.schema(EVIDENCE).parquet(incoming)
    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def terms(spark: SparkSession, store: str) -> DataFrame:
    """The terms after all evidence kept so far."""
    return terminology.upsert(spark.read.schema(EVIDENCE + ", batch INT").parquet(store).drop("batch"))
