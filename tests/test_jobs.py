"""Spans, registering, settings and whole runs."""

import json

import pytest
from pyspark.sql import functions as F

from quire.functions import markup
from quire.operators import register, spans
from quire.plans import jobs
from quire.sources import files, settings


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_markup(spark):
    assert value(spark, markup.math_markup(F.lit("v_p and x^2"))) == '<span class="m">v</span><sub>p</sub> and <span class="m">x</span><sup>2</sup>'
    assert value(spark, markup.math_markup(F.lit("图（A）的 S 与 DQN"))) == '图（A）的 <span class="m">S</span> 与 DQN'
    assert value(spark, markup.rectangle(F.lit("1, 2,3,4.5"))) == [1.0, 2.0, 3.0, 4.5] and value(spark, markup.rectangle(F.lit("1,2,x,4"))) is None
    assert value(spark, markup.half(F.lit(600.0), F.lit(800.0), F.lit("right"))) == [300.0, 0.0, 600.0, 800.0]
    assert value(spark, F.size(markup.panels(F.lit(5), F.lit(2), F.lit(10.0), F.lit(10.0)))) == 5


@pytest.mark.parametrize("fragment,want", [([30, 12, 40, 18], 11), ([1, 0, 5, 2], 0), ([1, 90, 5, 99], 24), ([80, 22, 90, 28], 24)])
def test_anchor(fragment, want):
    lines = [
        {"text": "We define x", "bbox": [0, 10, 60, 20], "spans": [{"text": "We define ", "bbox": [0, 10, 30, 20]}]},
        {"text": "for all cars", "bbox": [0, 21, 60, 30], "spans": [{"text": "for all cars", "bbox": [0, 21, 60, 30]}]},
    ]
    assert spans.anchor("We define x for all cars", [0, 10, 60, 30], 9.0, lines, [float(v) for v in fragment]) in (want, want - 1)


def test_anchor_without_lines():
    assert spans.anchor("", [0, 0, 1, 1], 9.0, [], [0, 0, 1, 1]) == 0
    assert spans.anchor("a b c d", [0, 0, 100, 11], 9.0, [], [95, 0, 99, 11]) == 7


def test_split_by_column(spark):
    rows = [(1, 0, 50.0, 10.0, 250.0, 20.0), (1, 1, 310.0, 10.0, 550.0, 20.0), (1, 2, 50.0, 21.0, 250.0, 31.0), (2, 0, 50.0, 10.0, 550.0, 20.0)]
    df = spark.createDataFrame([(*r, 50.0, 10.0, 550.0, 31.0, 10.0, "text") for r in rows], "block long, line int, x0 double, y0 double, x1 double, y1 double, bx0 double, by0 double, bx1 double, by1 double, size double, text string")
    got = {(r["block"], r["line"]): r["part"] for r in spans.split_by_column(df, ["block"], 600.0).collect()}
    assert got == {(1, 0): 0, (1, 2): 0, (1, 1): 1, (2, 0): 0}


def test_caption_stops_at_the_rule(spark):
    rows = [(0, "Table 3. Results of", 100.0, 110.0), (1, "the planner", 111.0, 119.0), (2, "Speed 3 4", 121.0, 130.0)]
    df = spark.createDataFrame([(1, n, t, 50.0, a, 250.0, b, 10.0, "F", 0.0, 0.0, 120.0) for n, t, a, b in rows], "block long, line int, text string, x0 double, y0 double, x1 double, y1 double, size double, family string, bold_ratio double, widest_gap double, rule_y double")
    got = spans.caption_text(df, ["block"], 600.0).first()
    assert (got["number"], got["text"], got["y1"]) == (3, "Table 3. Results of the planner", 119.0)


def test_line_summary(spark):
    df = spark.createDataFrame([(1, [("ab", [0.0, 0.0, 10.0, 5.0], 10.0, "Foo-Bold", 0), ("cdef", [40.0, 0.0, 50.0, 5.0], 12.0, "Bar", 0), (" ", [0.0] * 4, 99.0, "X", 0)])], "line int, spans array<struct<text:string,bbox:array<double>,size:double,font:string,flags:int>>")
    got = spans.summarize_lines(df, ["line"]).first()
    assert (got["text"], round(got["size"], 3), got["family"], round(got["bold_ratio"], 3), got["widest_gap"]) == ("abcdef", 11.333, "Bar", 0.333, 30.0)


def test_ruling_lines(spark):
    df = spark.createDataFrame([(1, 1, 10.0, 100.0, 200.0, 100.5, True), (1, 1, 10.0, 100.0, 20.0, 100.0, True), (1, 1, 10.0, 50.0, 90.0, 51.0, False), (1, 1, 10.0, 50.0, 90.0, 80.0, False)], "paper_id long, page int, x0 double, y0 double, x1 double, y1 double, is_line boolean")
    assert sorted(r["y"] for r in spans.ruling_lines(df).collect()) == [50.5, 100.2]


def test_old_merge(spark):
    rows = [(1, 1, 1, 50.0, 100.0, 250.0, 120.0, "One part", False), (1, 1, 2, 52.0, 124.0, 250.0, 140.0, "next part", False), (1, 1, 3, 50.0, 144.0, 250.0, 160.0, "[12] listed", False), (1, 1, 4, 310.0, 100.0, 500.0, 120.0, "Other column", False)]
    df = spark.createDataFrame([(*r, 10.0, False, False, False) for r in rows], "paper_id long, page int, block_key long, x0 double, y0 double, x1 double, y1 double, text string, done boolean, size double, heading boolean, bold boolean, math_only boolean")
    assert [(r["head"], r["members"]) for r in register.merge_old_layout(df).collect()] == [(1, [1, 2])]
    assert register.merge_old_layout(df.withColumn("done", F.col("block_key") == 2)).count() == 0


def test_settings(tmp_path):
    (tmp_path / "k.toml").write_text('[a]\nkey = "changeme"\n[b]\nkey = "k1"\nmodel = "m"\n[c]\nenabled = true\nkey = "k2"\n')
    assert settings.import_keys(str(tmp_path / "k.toml"))["key"] == "k2" and settings.import_keys("missing") == {}
    got = settings.resolve({"base": "cli"}, {"QUIRE_KEY": "env"}, {"key": "file", "model": "file"}, {"key": "imported"})
    assert (got.base, got.key, got.model, got.source) == ("cli", "env", "file", "environment")
    assert settings.masked(["run", "--key", "s", "--api-key=s", "x"]) == ["run", "--key", "***", "--api-key=***", "x"]
    assert settings.load(str(tmp_path / "none.json")) == {}


def test_run_translates_only_what_is_missing(spark, tmp_path):
    schema = "paper_id long, page int, block_key long, x0 double, y0 double, x1 double, y1 double, col string, kind string, text string"
    rows = [(1, p, p * 10 + i, 50.0, 100.0 + 30 * i, 250.0, 120.0 + 30 * i, "left", "body", f"text {p} {i}.") for p in (1, 2) for i in range(3)]
    blocks = spark.createDataFrame(rows, schema)
    terms = spark.createDataFrame([(1, "text", "译文")], "_id long, source string, target string")

    def model(items, context):
        return json.dumps({i: "译文一句。" for i, _ in items})

    report = {r["check_name"]: r["level"] for r in jobs.run(spark, blocks, terms, str(tmp_path), model).collect()}
    assert report["untranslated blocks"] == "PASS" and report["terms landed"] == "PASS"
    ready, done = jobs.current(spark, str(tmp_path), "blocks"), jobs.current(spark, str(tmp_path), "translations")
    assert jobs.pending(ready, done).count() == 0
    changed = jobs.prepare(blocks.withColumn("text", F.when(F.col("block_key") == 11, "new").otherwise(F.col("text"))))
    assert [r["id"] for r in jobs.pending(changed, done).collect()] == ["11"]


def test_harvest(spark):
    kb = spark.createDataFrame([(1, "speed estimator", "车速估计器", 0.9, "seed", "", 1)], "kb_id int, source string, target string, confidence double, kind string, paper string, seq bigint")
    pairs = spark.createDataFrame([(1, 5, "The speed estimator.", "车速估计器。"), (1, 6, "Keywords: dose planner; net", "关键词：剂量规划器；网络")], "kb_id int, block_key bigint, text string, zh string")
    got = {(r["source"], r["target"], r["confidence"]) for r in register.harvest(kb, pairs, F.lit("p")).collect()}
    assert got == {("speed estimator", "车速估计器", 0.93), ("dose planner", "剂量规划器", 0.95), ("net", "网络", 0.95)}


SPANS = "array<struct<text:string,bbox:array<double>,size:double,font:string,flags:int>>"


def test_block_text_and_records(spark):
    line = lambda *parts: ([0.0, 0.0, 1.0, 1.0], [(t, [0.123, 0.0, 1.0, 1.0], s, "F", 0) for t, s in parts])
    df = spark.createDataFrame([([line(("data-", 9.0)), line((" ", 9.0)), line(("driven ", 9.0), ("car", 12.0))],)], f"lines array<struct<bbox:array<double>,spans:{SPANS}>>")
    got = df.select(spans.block_text(F.col("lines")).alias("t"), spans.line_records(F.col("lines")).alias("r"), spans.dominant_size(F.col("lines")[2]["spans"]).alias("s")).first()
    assert got["t"] == "datadriven car" and [r["text"] for r in got["r"]] == ["data-", "driven car"] and got["r"][0]["spans"][0]["bbox"][0] == 0.12 and got["s"] == 9.0


def test_sizes_inside(spark):
    s = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0, 9.0, 5), (1, 1, 0.0, 0.0, 10.0, 10.0, 8.0, 5), (1, 1, 90.0, 0.0, 99.0, 10.0, 20.0, 50)], "paper_id long, page int, x0 double, y0 double, x1 double, y1 double, size double, chars int")
    r = spark.createDataFrame([(1, 1, 7, 0.0, 0.0, 20.0, 20.0)], "paper_id long, page int, rectangle long, rx0 double, ry0 double, rx1 double, ry1 double")
    assert [(x["rectangle"], x["size"]) for x in spans.sizes_inside(s, r).collect()] == [(7, 8.0)]


def test_prompt_and_usage():
    from quire.operators import translate

    messages = translate.prompt([("a", "x")], [("net", "网络")], before="B")
    assert "net = 网络" in messages[0]["content"] and "B" in messages[0]["content"] and json.loads(messages[1]["content"]) == [{"id": "a", "text": "x"}]
    assert translate.add_usage({"in": 10}, {"in": 5, "out": 2}) == {"in": 15, "out": 2}


def test_doctor():
    assert all(level == "PASS" for name, level, _ in settings.doctor() if name == "pyspark")


def test_pending_with_fragments_skips_and_limit(spark):
    fragment = "struct<id:string,page:int,bbox:array<double>,text:string,kind:string,math_only:boolean,has_math:boolean,anchor_offset:int>"
    rows = [(1, 1, n, "body", f"text {n}", n, False, [("f", 1, [0.0, 0.0, 1.0, 1.0], "x_1", "body", True, False, 4)] if n == 1 else None) for n in range(6)]
    blocks = spark.createDataFrame(rows, f"paper_id long, page int, block_key long, kind string, text string, flow_index int, flow_break boolean, fragments array<{fragment}>")
    got = {r["id"]: r for r in jobs.pending(blocks, None, skipped=blocks.where("block_key = 3"), limit=4).collect()}
    assert sorted(got) == ["0", "1", "2", "4"] and got["2"]["batch"] != got["4"]["batch"] and got["0"]["batch"] == got["1"]["batch"] == got["2"]["batch"]
    spec = got["1"]["specs"][0]
    assert got["1"]["text"] == f"text {spec['open']}x_1{spec['close']} 1" and spec["math"] and got["0"]["specs"] is None


def test_skip_flags(spark):
    from quire.operators import planning

    text = "A whole sentence of ordinary prose that is long enough to be translated."
    rows = [(1, 1, 0, text, "body", 0), (1, 1, 1, "", "body", 1), (1, 2, 2, text, "body", 0), (1, 3, 3, text, "body", 0), (1, 4, 4, text, "body", 0), (1, 4, 5, "References", "body", 1), (1, 4, 6, text, "body", 2)]
    blocks = spark.createDataFrame(rows, "paper_id long, page int, block_key long, text string, kind string, flow_index int").withColumns(
        {"y0": F.lit(500.0), "math_only": F.lit(None).cast("boolean"), "has_math": F.lit(False), "forced": F.col("block_key").isin(1, 6), "landscape": F.col("page") == 2, "nested": F.col("block_key") == 3, "skip_page": F.col("block_key") == 4}
    )
    none = blocks.select("block_key").limit(0)
    got = {r["block_key"]: r["reason"] for r in planning.skip_reasons(blocks, 1000.0, none, none).collect()}
    assert got == {0: None, 1: None, 2: "landscape page", 3: "nested", 4: "skipped page", 5: "reference heading", 6: None}
    assert {r["block_key"]: r["reason"] for r in planning.skip_reasons(blocks.drop("forced"), 1000.0, none, none, references=False).collect()}[6] is None


def test_exports(spark):
    rows = [(1, "net, deep", '深"网', "vision", 0.9, 2, ["网络"], "seed"), (2, "car", "车", None, 0.7, None, None, None), (3, "low", "低", "vision", 0.1, 1, None, "seed"), (4, " eye", "眼", "vision", 0.8, 1, [], "x")]
    terms = spark.createDataFrame(rows, "n long, source string, target string, domain string, confidence double, hits int, target_alt array<string>, source_kind string")
    lines = lambda form: [r["line"] for r in files.exported(terms, form).orderBy("section", "n").collect()]
    assert lines("csv") == ['"net, deep","深""网",', "car,车,", " eye,眼,"]
    assert lines("markdown")[0] == '| net, deep | 深"网 | 0.9 | 2 | seed | 网络 |' and len(lines("markdown")) == 3
    assert lines("prompt") == ["## vision", '- net, deep = 深"网', "-  eye = 眼", "## general", "- car = 车"]


def test_kb_and_terms_from_files(spark, tmp_path):
    (tmp_path / "kb.csv").write_text('﻿source,target,confidence,extra\n net ,"深,网",0.9,x\n ,无,1,\ncar,,0.5,\n', encoding="utf-8")
    got = files.read_kb(spark, str(tmp_path / "kb.csv")).collect()
    assert [(r["source"], r["target"], r["confidence"], r["papers"]) for r in got] == [("net", "深,网", "0.9", ""), ("car", "", "0.5", "")]
    (tmp_path / "g1.csv").write_text("en,zh\nNet,网\nnet,网络\ncar,\n")
    (tmp_path / "g2.csv").write_text("en,zh\ncar,车\nNET,别\n")
    assert {tuple(r) for r in files.first_terms(files.read_glossary(spark, str(tmp_path / "g*.csv"))).collect()} == {("Net", "网"), ("car", "车")}


def test_pages_round_trip(spark, tmp_path):
    rows = [("d", 1, 1, "b", "body", [1.0, 2.0]), ("d", 1, 0, "a", None, None), ("d", 2, 0, "c", "body", []), ("e", 1, 0, "d", "heading", [0.5])]
    blocks = spark.createDataFrame(rows, "file string, page int, stored_at int, text string, kind string, bbox array<double>")
    files.write_pages(blocks, str(tmp_path / "out"))
    back = files.read_pages(spark, str(tmp_path / "out"), "text: STRING, kind: STRING, bbox: ARRAY<DOUBLE>")
    assert {repr(r) for r in back.collect()} == {repr(r) for r in blocks.collect()}
    assert {tuple(r) for r in files.kind_counts(back).where("file = 'd' AND page = 1").collect()} == {("d", 1, "body", 1), ("d", 1, "none", 1)}
