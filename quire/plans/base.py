"""The tables as the queries read them: every record once, boxes as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Blocks once each, with x0, y0, x1, y1 (null where there is no box); only the named columns besides keys and box."""
    rows = table(spark, sf_dir, "blocks").select("block_key", "paper_id", "page", "bbox", *[c for c in columns if c not in ("block_key", "paper_id", "page")])
    return rows.dropDuplicates(["block_key"]).withColumns({c: F.get("bbox", F.lit(i)) for i, c in enumerate(("x0", "y0", "x1", "y1"))}).drop("bbox")


def translations(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Translation entries once each."""
    return table(spark, sf_dir, "translations").select("entry_id", *[c for c in columns if c != "entry_id"]).dropDuplicates(["entry_id"])


def latest(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The last translation entry of each block: highest run, then highest entry. An aggregate, so a block's runs are combined before the shuffle."""
    held = [c for c in columns if c != "block_key"]
    row = F.struct("entry_id", *held)
    rows = table(spark, sf_dir, "translations").groupBy("block_key").agg(F.max_by(row, F.struct("run_no", "entry_id")).alias("_r"))
    return rows.select("block_key", "_r.*")


#: The same in DuckDB.
BLOCKS = "b AS (SELECT DISTINCT * EXCLUDE (bbox), bbox[1] AS x0, bbox[2] AS y0, bbox[3] AS x1, bbox[4] AS y1 FROM blocks)"
ENTRIES = "t AS (SELECT DISTINCT * FROM translations)"
LATEST = "n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block_key ORDER BY run_no DESC NULLS LAST, entry_id DESC) AS rn FROM (SELECT DISTINCT * FROM translations)) WHERE rn = 1)"
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(s: str) -> str:
    return f"regexp_replace({s}, '^{WS}+|{WS}+$', '', 'g')"


def sql_collapse(s: str) -> str:
    return f"regexp_replace({sql_strip(s)}, '{WS}+', ' ', 'g')"


def sql_key(s: str) -> str:
    return sql_collapse(f"lower({s})")


def sql_clean(s: str) -> str:
    """SQL of ``text.clean_text``."""
    return sql_strip(f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({s}, ''), chr(160), ' ', 'g'), '-{WS}*\\n{WS}*([a-z])', '\\1', 'g'), '{WS}*\\n{WS}*', ' ', 'g'), '[ \\t]{{2,}}', ' ', 'g')")
