"""Jobs that are done whole: no base, kind or block is left out."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.operators import register, terminology
from quire.plans import catalogue, jobs, layout_queries, quality_queries, register_queries

DATA = "/root/testdata/sf0.001"
real = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")

EVIDENCE = "kb_id int, source string, target string, confidence double, kind string, paper string, seq bigint"
PAIRS = "block_key bigint, text string, zh string"


def test_harvest_reaches_every_base(spark):
    kb = spark.createDataFrame([(1, "speed estimator", "车速估计器", 0.9, "seed", "a", 1), (2, "speed estimator", "车速估计器", 0.5, "seed", "", 2), (2, "DVN", "价值网", 0.5, "seed", "b", 3)], EVIDENCE)
    pairs = spark.createDataFrame([(5, "The speed estimator.", "车速估计器。"), (6, "Keywords: dose planner; net", "关键词：剂量规划器；网络"), (7, "A deep value network (DVN).", "深度价值网络（DVN）。")], PAIRS)
    got = {(r["kb_id"], r["source"]): (r["target"], r["confidence"], r["hits"], r["papers"]) for r in terminology.upsert(register.harvest(kb, pairs, F.lit("p"))).collect()}
    for base in (1, 2):
        assert got.pop((base, "dose planner")) == ("剂量规划器", 0.95, 1, "p") and got.pop((base, "net")) == ("网络", 0.95, 1, "p")
    assert got == {
        (1, "speed estimator"): ("车速估计器", 0.93, 2, "a;p"), (2, "speed estimator"): ("车速估计器", 0.53, 1, "p"), (2, "DVN"): ("价值网", 0.53, 2, "b;p"), (1, "deep value network"): ("深度价值网络", 0.78, 1, "p"),
    }


def test_harvest_keeps_pairs_of_one_base_there(spark):
    kb = spark.createDataFrame([(1, "speed estimator", "车速估计器", 0.9, "seed", "a", 1), (2, "speed estimator", "车速估计器", 0.5, "seed", "b", 2)], EVIDENCE)
    pairs = spark.createDataFrame([(2, 5, "The speed estimator.", "车速估计器。"), (2, 6, "Keywords: net", "关键词：网络")], "kb_id int, " + PAIRS)
    got = {(r["kb_id"], r["source"]): (r["confidence"], r["hits"], r["papers"]) for r in terminology.upsert(register.harvest(kb, pairs, F.lit("p"))).collect()}
    assert got == {(1, "speed estimator"): (0.9, 1, "a"), (2, "speed estimator"): (0.53, 2, "b;p"), (2, "net"): (0.95, 1, "p")}


def write(spark, d, blocks, translations):
    """Tables of (block_key, page, y0, kind, text) with one column each page, and of (block_key, zh)."""
    rows = [(k, 1, page, [50.0, y, 250.0, y + 20.0], "left", kind, text, 10.0, False, False, False, k, False) for k, page, y, kind, text in blocks]
    spark.createDataFrame(rows, "block_key long, paper_id long, page int, bbox array<double>, col string, kind string, text string, size double, heading boolean, bold boolean, math_only boolean, flow_index int, flow_break boolean").write.parquet(f"{d}/blocks.parquet")
    spark.createDataFrame([(k, k, 1, zh) for k, zh in translations], "entry_id long, block_key long, run_no int, zh string").write.parquet(f"{d}/translations.parquet")


def equal_to_sql(spark, name):
    con = duckdb.connect()
    for t in ("blocks", "translations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, DATA)
    want = con.sql(catalogue.ORACLES[name]).project(", ".join(df.columns)).fetchall()
    return sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_legacy_merge_sees_translations_of_odd_keys(spark, tmp_path):
    lines = [(10, 1, 100.0), (11, 1, 124.0), (20, 2, 100.0), (22, 2, 124.0), (30, 3, 100.0), (31, 3, 124.0), (40, 4, 100.0), (41, 4, 124.0)]
    write(spark, tmp_path, [(k, page, y, "body", "some words") for k, page, y in lines], [(11, "译文"), (22, "译文"), (30, "译文"), (41, "")])
    assert sorted((r["head"], r["members"]) for r in register_queries.legacy_merge(spark, str(tmp_path)).collect()) == [(30, "30,31"), (40, "40,41")]


@real
def test_legacy_merge_equals_sql(spark):
    assert equal_to_sql(spark, "legacy_merge")


def test_blocks_without_kind_are_batched(spark, tmp_path):
    write(spark, tmp_path, [(1, 1, 100.0, "body", "One."), (2, 1, 124.0, None, "Two."), (3, 1, 148.0, "table", "3 4"), (4, 1, 172.0, "meta", "m"), (5, 1, 196.0, "math_only", "x")], [])
    assert sorted((r["block_key"], r["run"], r["batch"]) for r in layout_queries.flow_batches(spark, str(tmp_path)).collect()) == [(1, 0, 0), (2, 0, 0)]


def test_blocks_without_kind_are_translated_and_reported(spark, tmp_path):
    rows = [(1, 1, k, 50.0, 100.0 + 30 * k, 250.0, 120.0 + 30 * k, "left", kind, f"text {k}.") for k, kind in ((1, "body"), (2, None), (3, "table"))]
    blocks = spark.createDataFrame(rows, "paper_id long, page int, block_key long, x0 double, y0 double, x1 double, y1 double, col string, kind string, text string")
    assert sorted(r["id"] for r in jobs.pending(jobs.prepare(blocks), None).collect()) == ["1", "2"]
    terms = spark.createDataFrame([(1, "text", "译文")], "_id long, source string, target string")
    report = {r["check_name"]: r["detail"] for r in jobs.run(spark, blocks, terms, str(tmp_path), lambda items, context: json.dumps({i: "译文一句。" for i, _ in items})).collect()}
    assert report["untranslated blocks"] == "0 blocks"


@real
def test_flow_batches_equal_sql_with_null_kinds(spark):
    assert equal_to_sql(spark, "flow_batches")


def test_cells_get_the_translation_of_their_text(spark, tmp_path):
    write(spark, tmp_path, [(1, 1, 100.0, "body", "speed"), (2, 1, 124.0, "table", "speed"), (3, 1, 148.0, "heading", "speed"), (4, 1, 172.0, None, "speed"), (5, 1, 196.0, "table", "4.5")], [(1, "车速")])
    assert sorted((r["block_key"], r["zh"]) for r in quality_queries.cell_join(spark, str(tmp_path)).collect()) == [(k, "车速") for k in (1, 2, 3, 4)]


@real
def test_cell_join_equals_sql_of_all_kinds(spark):
    assert equal_to_sql(spark, "cell_join")


def test_the_stage_translates_every_translatable_kind(spark, tmp_path):
    kinds = ["body", "heading", "table_caption", "figure_caption", None, "table", "meta", "math_only"]
    write(spark, tmp_path, [(k, 1, 100.0 + 24 * k, kind, f"word {k}") for k, kind in enumerate(kinds)], [])
    queries = catalogue.QUERIES
    assert sorted((r["block_key"], r["zh"]) for r in queries["translate_blocks"](spark, str(tmp_path)).collect()) == [(k, f"{k} word") for k in range(5)]
    assert sum(r["n_items"] for r in queries["batch_prompts"](spark, str(tmp_path)).collect()) == 5
