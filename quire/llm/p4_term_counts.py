"""Problem 4: how often every distinct term occurs, in how many records, and which are too rare or too common.

Heavy-light aggregation. A sketch pass (Spark's frequent-items aggregate, JVM side, over the rows as they come, so without a
shuffle of records) names a bounded set of heavy terms. It is broadcast; every task counts the heavy terms exactly in local arrays
indexed by their number and hands over one row per heavy term it met, so a term that half of all records hold costs one row per
task. Only the other terms are shuffled, already summed per batch, and with them the number of records of each field. Both count
tables are exact whatever the sketch names, and their union is the result. Records are deduplicated once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, cut_lineage, pick, table

#: Signs removed at both ends of a term, besides blanks (fixed values).
EDGE = " \t.;,，、。"


def normalize(term: Column) -> Column:
    """Blanks and edge signs removed at both ends, inner blanks reduced to one, lower case."""
    cut = F.regexp_replace(term, rf"^[{EDGE}]+|[{EDGE}]+$", "")
    return F.lower(F.regexp_replace(cut, "[ \t]+", " "))


def heavy_terms(terms: DataFrame, k: int, tracked: int) -> list[tuple[str, str]]:
    """At most ``k`` (field, term) pairs per field that a frequent-items sketch estimates as the most frequent.

    The list only steers the work; counts are exact without it. Its size is bounded by ``k`` times the number of fields.
    """
    rows = terms.groupBy("field").agg(F.expr(f"approx_top_k(term, {int(k)}, {max(int(k), int(tracked))})").alias("top")).collect()
    return sorted((r["field"], t["item"]) for r in rows for t in r["top"] if t["item"] is not None)


def _split_counts(heavy: list[tuple[str, str]]):
    """mapInPandas function: exact local counters for the heavy terms, per-batch sums for the others."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = {pair: i for i, pair in enumerate(heavy)}
        occurrences, records = np.zeros(len(heavy), np.int64), np.zeros(len(heavy), np.int64)
        having: Counter = Counter()  # records with any term, per field
        for part in parts:
            if part.empty:
                continue
            number = np.fromiter((at.get(x, -1) for x in zip(part["field"], part["term"])), np.int64, len(part))
            is_heavy = number >= 0
            np.add.at(occurrences, number[is_heavy], part["n"].to_numpy()[is_heavy])
            np.add.at(records, number[is_heavy], 1)
            having.update(part["field"][part["first"]])
            light = part[~is_heavy]
            if len(light):
                groups = light.groupby(["field", "term"], sort=False)["n"]
                sums = groups.sum()
                yield pd.DataFrame(
                    {"field": sums.index.get_level_values(0).astype(object), "term": sums.index.get_level_values(1).astype(object), "occurrences": sums.to_numpy(), "records": groups.size().to_numpy(), "heavy": False}
                )
        if having:
            yield pd.DataFrame({"field": [*having], "term": None, "occurrences": 0, "records": [*having.values()], "heavy": False})
        met = np.flatnonzero(records)
        if len(met):
            yield pd.DataFrame(
                {"field": [heavy[i][0] for i in met], "term": [heavy[i][1] for i in met], "occurrences": occurrences[met], "records": records[met], "heavy": True}
            )

    return run


def term_counts(records: DataFrame, key: str, lists: dict[str, str], k: int = 256, tracked: int = 8192) -> DataFrame:
    """(field, term, occurrences, records, field_records) of every distinct term.

    ``lists`` maps a field's name to the column of ``records`` that holds its terms (an array of strings or a string).
    Rows equal in ``key`` are one record (the first of them counts); rows whose key is null are a record each. Null lists,
    null elements and terms that are empty after normalisation don't count. ``field_records`` is the number of records
    having any term in the field. An empty table gives no rows.
    """
    kinds = dict(records.dtypes)
    rows = records.select(col(key).cast("string").alias("_rec"), *[(col(c) if kinds[c].startswith("array") else F.array(col(c))).alias(f"_f{i}") for i, c in enumerate(lists.values())])
    one = rows.where("_rec IS NOT NULL").dropDuplicates(["_rec"]).unionByName(rows.where("_rec IS NULL"))
    heavy = heavy_terms(_terms(rows, list(lists)), k, tracked)
    split = _terms(one, list(lists)).mapInPandas(_split_counts(heavy), "field string, term string, occurrences bigint, records bigint, heavy boolean")
    # read twice below; a filter of the key would be pushed through the aggregate and everything done twice
    counts = cut_lineage(split.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")))
    having = counts.where("term IS NULL").select("field", F.col("records").alias("field_records"))
    return counts.where("term IS NOT NULL").join(F.broadcast(having), "field")  # one row per field


def _terms(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, term, n, first) of every distinct term of every row: how often it holds it, and whether it is the first of its field."""
    def counted(field: str, held: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            return F.struct(F.lit(field).alias("field"), t.alias("term"), F.size(F.filter(held, lambda y: y == t)).cast("bigint").alias("n"), (i == 0).alias("first"))

        return F.transform(F.array_distinct(held), one)

    # a column of its own, so that terms are cleaned once and not for every comparison
    clean = rows.select(*[F.filter(F.transform(F.col(f"_f{i}"), normalize), lambda t: t.isNotNull() & (t != "")).alias(f"_f{i}") for i in range(len(fields))])
    each = [counted(f, F.col(f"_f{i}")) for i, f in enumerate(fields)]
    nothing = F.array().cast("array<struct<field:string,term:string,n:bigint,first:boolean>>")
    return clean.select(F.explode(F.concat(*[F.coalesce(x, nothing) for x in each])).alias("_t")).select("_t.*")


def mark_terms(counts: DataFrame, common: float = 0.05, rare: int = 1) -> DataFrame:
    """Adds ``mark``: 'common' above the share ``common`` of the field's records, else 'rare' up to ``rare`` records, else null."""
    return counts.withColumn("mark", F.when(F.col("records") > common * F.col("field_records"), "common").when(F.col("records") <= rare, "rare"))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    literature = term_counts(pick(table(spark, sf_dir, "literature"), rec_id="rec_id", keywords_en="keywords_en", keywords_zh="keywords_zh"), "rec_id", {"keywords_en": "keywords_en", "keywords_zh": "keywords_zh"})
    return literature.unionByName(term_counts(pick(table(spark, sf_dir, "glossary"), gid="gid", source="source"), "gid", {"source": "source"}))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, term, mark) of the terms that are too rare or too common."""
    return mark_terms(_counts(spark, sf_dir)).where("mark is not null").select("field", "term", "mark")


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, term, occurrences, records) of every distinct term."""
    return _counts(spark, sf_dir).select("field", "term", "occurrences", "records")


_TERMS = r"""
WITH l AS (SELECT rec_id, any_value(keywords_en) ke, any_value(keywords_zh) kz FROM (SELECT DISTINCT rec_id, keywords_en, keywords_zh FROM literature) GROUP BY rec_id),
raw AS (SELECT 'keywords_en' AS field, rec_id AS rec, unnest(ke) AS x FROM l UNION ALL SELECT 'keywords_zh', rec_id, unnest(kz) FROM l
        UNION ALL SELECT 'source', gid, source FROM (SELECT DISTINCT gid, source FROM glossary)),
t AS (SELECT field, rec, lower(regexp_replace(trim(x, chr(9) || ' .;,，、。'), '[ \t]+', ' ', 'g')) AS term FROM raw WHERE x IS NOT NULL),
u AS (SELECT * FROM t WHERE term <> ''),
n AS (SELECT field, count(DISTINCT rec) AS all_recs FROM u GROUP BY field),
c AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT rec) AS records FROM u GROUP BY field, term)
"""
QUERIES = {"p4_found": p4_found, "p4_counts": p4_counts}
ORACLES = {
    "p4_found": _TERMS + "SELECT field, term, CASE WHEN records > 0.05::DOUBLE * all_recs THEN 'common' ELSE 'rare' END AS mark FROM c JOIN n USING (field) WHERE records > 0.05::DOUBLE * all_recs OR records = 1",
    "p4_counts": _TERMS + "SELECT field, term, occurrences, records FROM c",
}
