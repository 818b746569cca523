"""Term lookups and harvests that have to stay small on disk when terms and bases are many."""

import pytest
from pyspark.sql import functions as F

from quire.operators import register, terminology

TERMS = [(1, "deep net", "深度网络"), (2, "Net", "网络"), (3, "net", "网"), (4, "a", "网络"), (5, "deep  NET", "深度网络"), (6, "planner", "规划器"), (7, "works well", "网络"), (8, "zz", "网络"), (9, "gone", "缺"), (10, "ne", "络很")]
ROWS = [(4, "A Deep\n net works", "深度网络很好"), (2, "deep net", "深度网络"), (3, "planner", "规划"), (1, "planner", "规划器"), (5, "works well", "络"), (6, None, "网络"), (7, "net", None), (8, "", "网络")]
WANT = sorted((i, min(k for k, text, zh in ROWS if text and zh and target in zh and " ".join(source.lower().split()) in " ".join(text.lower().split()))) for i, source, target in TERMS if i in (1, 2, 3, 4, 5, 6, 10))


@pytest.mark.parametrize("automaton", [10**6, -1])
@pytest.mark.parametrize("chars", [24_000_000, 20])
@pytest.mark.parametrize("many", [0, 16])
def test_confirmations_send_no_candidates(spark, monkeypatch, automaton, chars, many):
    monkeypatch.setattr(terminology, "AUTOMATON_CHARS", automaton)
    monkeypatch.setattr(terminology, "LOOKUP_CHARS", chars, raising=False)
    monkeypatch.setattr(terminology, "MANY_SOURCES", many, raising=False)
    terms = spark.createDataFrame(TERMS, "_id long, source string, target string")
    pairs = spark.createDataFrame(ROWS, "block_key long, text string, zh string").repartition(3)
    found = terminology.confirmations(terms, pairs)
    assert sorted(map(tuple, found.collect())) == WANT
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()  # no row for each position of a text


def test_confirmations_agree_in_their_columns(spark):
    terms = spark.createDataFrame([(1, 1, "net", "网络"), (2, 2, "net", "网络"), (3, None, "net", "网络"), (4, 2, "planner", "规划器")], "_id long, kb_id int, source string, target string")
    pairs = spark.createDataFrame([(5, 1, "net", "网络"), (4, 2, "net planner", "网络"), (3, None, "net", "网络"), (2, 3, "net", "网络")], "block_key long, kb_id int, text string, zh string")
    assert sorted(map(tuple, terminology.confirmations(terms, pairs, ["kb_id"]).collect())) == [(1, 5), (2, 4)]


def test_a_harvest_of_many_bases_folds_mined_pairs_once(spark, monkeypatch):
    """The same terms as the evidence of every pair for every base, and no such evidence."""
    kb = [(b, "speed estimator", "车速估计器", 0.9, "seed", "a", b * 10) for b in range(1, 41)] + [
        (1, "deep value network", "旧价值网络", 0.5, "seed", "b", 1), (2, "DVN", "价值网", 0.5, "seed", "b", 2), (3, "Dose  Planner", "剂量规划器", 0.5, "seed", "", 3), (4, "net", "x", 0.9, "seed", "c", 4),
    ]
    pairs = [(5, "The speed estimator.", "车速估计器。"), (6, "Keywords: dose planner; net", "关键词：剂量规划器；网络"), (7, "A deep value network (DVN).", "深度价值网络（DVN）。"), (8, "A Deep value network (DVN-2).", "深度价值网络（DVN-2）。"), (9, "A deep value network (DVN).", "深层价值网络（DVN）。")]
    kb = spark.createDataFrame(kb, "kb_id int, source string, target string, confidence double, kind string, paper string, seq bigint")
    pairs = spark.createDataFrame(pairs, "block_key bigint, text string, zh string")
    want = sorted(map(repr, map(tuple, terminology.upsert(register.harvest(kb, pairs, F.lit("p"))).collect())))
    sent, real = [], terminology.upsert
    monkeypatch.setattr(terminology, "upsert", lambda evidence, *a: sent.append(evidence.count()) or real(evidence, *a))
    assert sorted(map(repr, map(tuple, register.harvested(kb, pairs, F.lit("p")).collect()))) == want
    assert sum(sent) < 110  # of 40 bases: 44 rows known, 40 found again, a few mined
