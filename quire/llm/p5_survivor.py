"""Problem 5: one surviving record per group of duplicates, chosen field by field.

Rows are ranked by window ordering with a deterministic tie-break, once per surviving field, and only the first row of each
group is kept. A group may hold a third of all rows: as each ranking is followed by "rank = 1", Spark limits every group to
its best row within each map task before the shuffle (WindowGroupLimit), so a hot group sends one row per task. The group's
size and smallest id come from a partial aggregate. The winners, one row per group and field, are folded into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, table

#: A Chinese character, unified, compatibility or radical form.
HAN = r"\p{IsHan}"


def term_key(source: Column) -> Column:
    """Lower case, outer blanks removed, inner blanks reduced to one."""
    return F.lower(F.regexp_replace(F.regexp_replace(source, r"^[\s\x{a0}\x{3000}]+|[\s\x{a0}\x{3000}]+$", ""), r"[\s\x{a0}\x{3000}]+", " "))


def best_rows(df: DataFrame, keys: list[str], id_col: str, rules: dict[str, tuple[Column, list[Column]]], carry: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per group of two or more rows: the keys, ``lead`` (smallest id), ``members`` and, per rule, the winning row's id.

    ``rules`` maps a name to (usable, orderings): the winner is the usable row first in the orderings (descending, null last),
    the smallest id on ties, and 0 if no row is usable. Rows with a null key or null id belong to no group. Rows with the same
    id are one row when a group is told from a single row; ``members`` counts rows. Empty tables give no rows. ``carry`` names, per
    rule, the columns whose values are taken from its winner (null if there is none); they travel with it, so nothing is joined.
    """
    carry = carry or {}
    kinds = {name: f"struct<{','.join(f'_{n}:{df.schema[c].dataType.simpleString()}' for n, c in enumerate(columns))}>" for name, columns in carry.items()}

    def carried(rule: str | None) -> list[Column]:
        """A column per carrying rule, filled for ``rule``."""
        return [(F.struct(*[col(c).alias(f"_{n}") for n, c in enumerate(columns)]) if name == rule else F.lit(None)).cast(kinds[name]).alias(f"_c_{name}") for name, columns in carry.items()]

    rows = df
    for k in [*keys, id_col]:
        rows = rows.where(col(k).isNotNull())
    names = [f"_k{i}" for i in range(len(keys))]
    held = [col(k).alias(n) for k, n in zip(keys, names)]
    parts = [
        rows.select(*held, col(id_col).alias("_id")).groupBy(*names).agg(F.min("_id").alias("_lead"), F.max("_id").alias("_last"), F.count("*").alias("_members"))
        .select(*names, F.lit(-1).alias("_rule"), F.lit(None).cast("bigint").alias("_id"), "_lead", "_last", "_members", *carried(None))
    ]
    for i, (rule, (usable, orders)) in enumerate(rules.items()):
        orderings = [o.alias(f"_o{j}") for j, o in enumerate(orders)]
        w = Window.partitionBy(*names).orderBy(*[F.col(f"_o{j}").desc_nulls_last() for j in range(len(orders))], F.col("_id").asc())
        first = rows.where(usable).select(*held, col(id_col).alias("_id"), *orderings, *carried(rule)).withColumn("_rank", F.row_number().over(w)).where("_rank = 1")
        nothing = F.lit(None).cast("bigint")
        parts.append(first.select(*names, F.lit(i).alias("_rule"), F.col("_id").cast("bigint"), nothing.alias("_lead"), nothing.alias("_last"), nothing.alias("_members"), *[f"_c_{name}" for name in carry]))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    wins = [F.coalesce(F.max(F.when(F.col("_rule") == i, F.col("_id"))), F.lit(0).cast("bigint")).alias(name) for i, name in enumerate(rules)]
    values = [F.max(f"_c_{name}").alias(f"_c_{name}") for name in carry]  # one of them isn't null at most
    out = every.groupBy(*names).agg(F.max("_lead").alias("lead"), F.max("_last").alias("_last"), F.max("_members").alias("members"), *wins, *values).where("lead < _last")
    taken = [F.col(f"_c_{name}")[f"_{n}"].alias(c) for name, columns in carry.items() for n, c in enumerate(columns)]
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "lead", "members", *rules, *taken)


def glossary_rules(target: Column, confidence: Column, hits: Column, updated: Column) -> dict[str, tuple[Column, list[Column]]]:
    """The rules of a terminology base: target and confidence together, hits, updated."""
    sure = F.when(confidence.isNotNull() & ~F.isnan(confidence) & confidence.between(0.0, 1.0), confidence)
    dated = F.when(updated.between(F.lit("2000-01-01").cast("date"), F.lit("2026-12-31").cast("date")), updated)
    count = F.when(hits >= 0, hits)
    return {"target_gid": (target.rlike(HAN), [sure, dated]), "hits_gid": (count.isNotNull(), [count]), "updated_gid": (dated.isNotNull(), [dated])}


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lead_gid, target_gid, hits_gid, updated_gid) of every term with several rows in one knowledge base."""
    glossary = table(spark, sf_dir, "glossary").select("gid", "kb_id", "target", "confidence", "hits", "updated", term_key(F.col("source")).alias("term"))
    rules = glossary_rules(F.col("target"), F.col("confidence"), F.col("hits"), F.col("updated"))
    best = best_rows(glossary, ["kb_id", "term"], "gid", rules)
    return best.select(F.col("lead").alias("lead_gid"), "target_gid", "hits_gid", "updated_gid")


def p5_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving rows with their values: kb_id, term, members, target, confidence, hits, updated."""
    glossary = table(spark, sf_dir, "glossary").select("gid", "kb_id", "target", "confidence", "hits", "updated", term_key(F.col("source")).alias("term"))
    rules = glossary_rules(F.col("target"), F.col("confidence"), F.col("hits"), F.col("updated"))
    best = best_rows(glossary, ["kb_id", "term"], "gid", rules, {"target_gid": ["target", "confidence"], "hits_gid": ["hits"], "updated_gid": ["updated"]})
    return best.select("kb_id", "term", "members", F.col("lead").alias("lead_gid"), "target", "confidence", "hits", "updated")


_RANKED = r"""
WITH g AS (SELECT DISTINCT gid, kb_id, lower(regexp_replace(regexp_replace(source, '^[\s\x{a0}\x{3000}]+|[\s\x{a0}\x{3000}]+$', '', 'g'), '[\s\x{a0}\x{3000}]+', ' ', 'g')) AS term,
             target, confidence, hits, updated FROM glossary),
r AS (SELECT *, CASE WHEN NOT isnan(confidence) AND confidence BETWEEN 0 AND 1 THEN confidence END AS c,
             CASE WHEN updated BETWEEN DATE '2000-01-01' AND DATE '2026-12-31' THEN updated END AS d,
             CASE WHEN hits >= 0 THEN hits END AS h, coalesce(regexp_matches(target, '\p{Han}'), false) AS ok FROM g WHERE kb_id IS NOT NULL AND term IS NOT NULL),
w AS (SELECT *, count(*) OVER p AS members, min(gid) OVER p AS lead,
        row_number() OVER (PARTITION BY kb_id, term ORDER BY ok DESC, c DESC NULLS LAST, d DESC NULLS LAST, gid) AS rt,
        row_number() OVER (PARTITION BY kb_id, term ORDER BY h DESC NULLS LAST, gid) AS rh,
        row_number() OVER (PARTITION BY kb_id, term ORDER BY d DESC NULLS LAST, gid) AS ru
      FROM r WINDOW p AS (PARTITION BY kb_id, term))
"""
QUERIES = {"p5_found": p5_found, "p5_survivors": p5_survivors}
ORACLES = {
    "p5_found": _RANKED + """SELECT lead AS lead_gid, coalesce(max(CASE WHEN rt = 1 AND ok THEN gid END), 0) AS target_gid, coalesce(max(CASE WHEN rh = 1 AND h IS NOT NULL THEN gid END), 0) AS hits_gid,
        coalesce(max(CASE WHEN ru = 1 AND d IS NOT NULL THEN gid END), 0) AS updated_gid FROM w WHERE members >= 2 GROUP BY kb_id, term, lead""",
    "p5_survivors": _RANKED + """SELECT kb_id, term, members, lead AS lead_gid, max(CASE WHEN rt = 1 AND ok THEN target END) AS target, max(CASE WHEN rt = 1 AND ok THEN confidence END) AS confidence,
        max(CASE WHEN rh = 1 AND h IS NOT NULL THEN hits END) AS hits, max(CASE WHEN ru = 1 AND d IS NOT NULL THEN updated END) AS updated FROM w WHERE members >= 2 GROUP BY kb_id, term, members, lead""",
}
