"""Sources and sinks: layout documents, tables, translations and glossaries as JSON, CSV and JSON lines; manifests; Markdown."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import strip

SPAN = "STRUCT<text: STRING, bbox: ARRAY<DOUBLE>, size: DOUBLE, font: STRING, flags: INT, color: INT>"
FRAGMENT = "STRUCT<id: STRING, text: STRING, bbox: ARRAY<DOUBLE>, kind: STRING, math_only: BOOLEAN, has_math: BOOLEAN, anchor_offset: INT, page: INT>"
BLOCK = (
    "STRUCT<id: STRING, bbox: ARRAY<DOUBLE>, size: DOUBLE, font: STRING, bold: BOOLEAN, heading: BOOLEAN, color: INT, math_only: BOOLEAN, has_math: BOOLEAN, chars: INT, text: STRING, kind: STRING, `column`: STRING, "
    f"source_hash: STRING, layout_uid: STRING, flow_index: INT, flow_break: BOOLEAN, continues_to_next: BOOLEAN, continues_from_prev: BOOLEAN, nested_in: STRING, merged_from: ARRAY<STRING>, inline_fragments: ARRAY<{FRAGMENT}>>"
)
DOCUMENT = f"schema_version INT, source STRING, page_count INT, pages ARRAY<STRUCT<page: INT, width: DOUBLE, height: DOUBLE, layout_barriers: ARRAY<STRUCT<kind: STRING, bbox: ARRAY<DOUBLE>>>, blocks: ARRAY<{BLOCK}>>>"
TABLES = "pages ARRAY<STRUCT<page: INT, tables: ARRAY<STRUCT<index: INT, region: ARRAY<DOUBLE>, nrows: INT, cells: ARRAY<STRUCT<id: STRING, row: INT, col: INT, bbox: ARRAY<DOUBLE>, text: STRING>>>>>>"
RAW = f"pages ARRAY<STRUCT<page: INT, width: DOUBLE, height: DOUBLE, blocks: ARRAY<STRUCT<type: INT, bbox: ARRAY<DOUBLE>, lines: ARRAY<STRUCT<bbox: ARRAY<DOUBLE>, spans: ARRAY<{SPAN}>>>>>>>"
ENTRY = "STRUCT<zh: STRING, skip: BOOLEAN, blank: BOOLEAN, source_hash: STRING, layout_uid: STRING, absorbed_into: STRING>"


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of layout documents, a JSON file each: file, page, width, height, position in the file, and the block's fields."""
    docs = spark.read.schema(DOCUMENT).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))
    pages = docs.select("file", "schema_version", F.explode("pages").alias("p"))
    blocks = pages.select("file", "schema_version", "p.page", "p.width", "p.height", F.posexplode("p.blocks").alias("stored_at", "b"))
    return blocks.select("file", "schema_version", "page", "width", "height", "stored_at", "b.*").withColumnRenamed("id", "block_id")


def read_raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines of raw text blocks (type 0): file, page, block, line, box, text (spans joined), and the spans."""
    docs = spark.read.schema(RAW).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))
    blocks = docs.select("file", F.explode("pages").alias("p")).select("file", "p.page", F.posexplode("p.blocks").alias("block", "b")).where("b.type = 0")
    lines = blocks.select("file", "page", "block", F.posexplode("b.lines").alias("line", "l"))
    return lines.select("file", "page", "block", "line", "l.bbox", F.array_join("l.spans.text", "").alias("text"), F.col("l.spans").alias("spans"))


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of table files: file, page, table, region, and the cell's fields; tables whose region hasn't four numbers are left out."""
    docs = spark.read.schema(TABLES).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))
    tables = docs.select("file", F.explode("pages").alias("p")).select("file", "p.page", F.explode("p.tables").alias("t")).where(F.size("t.region") == 4)
    return tables.select("file", "page", F.col("t.index").alias("table"), F.col("t.region").alias("region"), F.explode("t.cells").alias("c")).select("file", "page", "table", "region", "c.*")


def read_translations(spark: SparkSession, glob: str) -> DataFrame:
    """Entries of translation files (an object from block id to entry each); of equal ids the last file in order of name wins.

    Names are compared as text, so "run10" precedes "run2". ``overwrites`` counts how often a file changed the text of the one before.
    """
    raw = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.explode(F.from_json("value", f"MAP<STRING, {ENTRY}>")).alias("block_id", "e"))
    w = Window.partitionBy("block_id").orderBy("file")
    rows = raw.select("file", "block_id", "e.*").withColumn("_before", F.lag("zh").over(w)).withColumn("_n", F.row_number().over(w))
    changed = F.count_if((F.col("_n") > 1) & ~F.col("zh").eqNullSafe(F.col("_before")))
    return rows.groupBy("block_id").agg(F.max_by(F.struct("zh", "skip", "blank", "source_hash", "layout_uid", "absorbed_into"), "_n").alias("e"), changed.alias("overwrites")).select("block_id", "e.*", "overwrites")


def read_literature(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines; malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


@F.pandas_udf(StringType())
def _decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def text(data: bytes) -> str:
        for encoding in ("utf-8-sig", "utf-8", "gbk"):
            try:
                return data.decode(encoding)
            except UnicodeDecodeError:
                pass
        return data.decode("latin-1")

    for s in parts:
        yield s.map(lambda b: None if b is None else text(bytes(b)))


#: Names of the columns of a glossary file (fixed values).
SOURCE_NAMES, TARGET_NAMES = ("source", "en"), ("target", "zh")


def read_glossary(spark: SparkSession, glob: str) -> DataFrame:
    """(file, n, source, target) of glossary files in any of four encodings, with or without header.

    Blank sources are dropped; blank targets too, but only in files with a header.
    """
    text = spark.read.format("binaryFile").load(glob).select(F.col("path").alias("file"), _decode("content").alias("text"))
    lines = text.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line")).where("line <> ''")
    cells = F.from_csv("line", F.lit("a STRING, b STRING, c STRING"))
    head = lines.where("n = 0").select("file", cells.alias("h")).select("file", F.lower(strip(F.col("h.a"))).alias("_a"), F.lower(strip(F.col("h.b"))).alias("_b"))
    known = head.where(F.col("_a").isin(*SOURCE_NAMES) & F.col("_b").isin(*TARGET_NAMES)).select("file", F.lit(True).alias("_headed"))
    rows = lines.select("file", "n", cells.alias("r")).join(known, "file", "left").where(~(F.coalesce("_headed", F.lit(False)) & (F.col("n") == 0)))
    out = rows.select("file", "n", strip(F.col("r.a")).alias("source"), strip(F.coalesce("r.b", F.lit(""))).alias("target"), F.coalesce("_headed", F.lit(False)).alias("_headed"))
    return out.where("source <> '' AND (target <> '' OR NOT _headed)").drop("_headed")


def first_terms(rows: DataFrame) -> DataFrame:
    """(source, target) of glossary rows (file, n, source, target) with both sides, the first of each source, case aside."""
    row = F.struct("file", "n", "source", "target")
    firsts = rows.where("source <> '' AND target <> ''").groupBy(F.lower("source").alias("_s")).agg(F.min_by(row, F.struct("file", "n")).alias("_r"))
    return firsts.select("_r.source", "_r.target")


#: Columns of a knowledge base file (fixed values).
KB_FIELDS = ("source", "target", "domain", "confidence", "hits", "papers", "target_alt", "source_kind", "updated")


def read_kb(spark: SparkSession, path: str) -> DataFrame:
    """Rows of knowledge base files, all fields as trimmed text ('' if missing); rows without source are dropped. A byte order mark is no part of a name."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.toDF(*[c.lstrip("\ufeff").strip() for c in rows.columns])
    field = lambda c: strip(F.coalesce(F.col(c), F.lit(""))) if c in rows.columns else F.lit("")
    return rows.select(*[field(c).alias(c) for c in KB_FIELDS]).where("source <> ''")


def write_glossary(terms: DataFrame, path: str) -> None:
    """A glossary as one CSV file, surest terms first; arrays are joined with ; and |."""
    flat = terms.select(*[F.array_join(c, ";" if c == "papers" else "|").alias(c) if k.startswith("array") else F.col(c) for c, k in terms.dtypes])
    flat.orderBy(F.col("confidence").desc_nulls_last(), F.lower("source")).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def exported(terms: DataFrame, form: str, least: float = 0.6) -> DataFrame:
    """(section, n, line): an export of the terms that are sure enough, ordered by section and n. ``terms`` has n and the fields of a knowledge base.

    ``form``: 'csv' (source, target and an empty language), 'markdown' (a table row each), or 'prompt' (source = target, by domain; the section is the first
    row of the domain, whose heading is line -1).
    """
    rows = terms.where(F.col("confidence") >= least)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    if form == "csv":
        return rows.select(F.lit(0).cast("bigint").alias("section"), "n", F.to_csv(F.struct("source", "target", F.lit("").alias("tgt_lng")), {"escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}).alias("line"))
    if form == "markdown":
        alternatives = F.array_join(F.coalesce("target_alt", F.array().cast("array<string>")), "|") if dict(terms.dtypes)["target_alt"].startswith("array") else text("target_alt")
        cells = F.concat_ws(" | ", text("source"), text("target"), text("confidence"), text("hits"), text("source_kind"), alternatives)
        return rows.select(F.lit(0).cast("bigint").alias("section"), "n", F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))
    domain = F.coalesce(F.nullif("domain", F.lit("")), F.lit("general"))
    heads = rows.groupBy(domain.alias("_d")).agg(F.min("n").cast("bigint").alias("section"))
    lines = rows.withColumn("_d", domain).join(heads, "_d").select("section", "n", F.concat(F.lit("- "), text("source"), F.lit(" = "), text("target")).alias("line"))
    return lines.unionByName(heads.select("section", F.lit(-1).alias("n"), F.concat(F.lit("## "), F.col("_d")).alias("line")))


def write_pages(blocks: DataFrame, path: str, document: str = "file") -> None:
    """Blocks as JSON lines, a page each (document, page, blocks in stored order), so that no document has to fit one row; ``read_pages`` reads them."""
    fields = [c for c in blocks.columns if c not in (document, "page", "stored_at")]
    pages = blocks.groupBy(document, "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("stored_at", *fields))), lambda b: b.dropFields("stored_at")).alias("blocks"))
    pages.write.mode("overwrite").json(path)


def read_pages(spark: SparkSession, path: str, schema: str, document: str = "file") -> DataFrame:
    """Blocks of ``write_pages``: document, page, stored_at and the fields of ``schema`` (a block's)."""
    pages = spark.read.schema(f"{document} STRING, page INT, blocks ARRAY<STRUCT<{schema}>>").json(path)
    return pages.select(document, "page", F.posexplode("blocks").alias("stored_at", "b")).select(document, "page", "stored_at", "b.*")


def kind_counts(blocks: DataFrame, document: str = "file") -> DataFrame:
    """(document, page, kind, n_blocks): the kinds of blocks of every page."""
    return blocks.groupBy(document, "page", F.coalesce("kind", F.lit("none")).alias("kind")).agg(F.count("*").alias("n_blocks"))


def markdown_index(records: DataFrame) -> DataFrame:
    """(line) of a literature index, latest first: date, title (60 characters), up to five keywords, pages, translated blocks and cells; bars escaped."""
    esc = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    title = F.coalesce(F.nullif("title_zh", F.lit("")), F.nullif("title_en", F.lit("")), F.col("id"))
    keywords = F.array_join(F.slice(F.coalesce("keywords_zh", F.array().cast("array<string>")), 1, 5), "、")
    cells = [F.coalesce(F.date_format("translated_at", "yyyy-MM-dd"), F.lit("")), F.left(esc(title), F.lit(60)), esc(keywords), number("pages"), number("n_blocks"), number("n_table_cells")]
    rows = records.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"), "translated_at", "rec_id")
    return rows.orderBy(F.col("translated_at").desc_nulls_last(), "rec_id").select("line")


def file_records(spark: SparkSession, glob: str) -> DataFrame:
    """(name, size, sha256) of files."""
    files = spark.read.format("binaryFile").load(glob)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def manifest_valid(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(name, valid): whether each file still has the hash in the manifest; a file without record is valid."""
    old = manifest.select("name", F.col("sha256").alias("_old"))
    return files.join(old, "name", "left").select("name", F.coalesce(F.col("_old") == F.col("sha256"), F.lit(True)).alias("valid"))


def first_set(*values: str | None, placeholders: tuple[str, ...] = ("", "changeme", "your-key-here")) -> str | None:
    """A setting by precedence: the first value that is neither missing nor a placeholder."""
    return next((v for v in values if v is not None and v.strip().lower() not in placeholders), None)
