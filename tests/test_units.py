"""Operators against hand-made cases."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from quire.functions import identity, text
from quire.functions.geometry import Box, landscape
from quire.operators import flow, layout, planning, quality, tables, terminology, translate
from quire.sources import files


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw,want", [("a-\n b  c\n d", "ab c d"), ("x y", "x y"), ("", ""), (None, "")])
def test_clean_text(spark, raw, want):
    assert one(spark, text.clean_text(F.lit(raw).cast("string")), q=1) == want


@pytest.mark.parametrize("raw,want", [("LLM\n与 RL", "LLM与RL"), ("line one\nline two", "line one line two"), ("模型 ， 好", "模型，好")])
def test_reflow(spark, raw, want):
    assert one(spark, text.reflow(F.lit(raw)), q=1) == want


@pytest.mark.parametrize("raw,want", [("we use the deep network", "deep network"), ("of the", ""), ("a b c d e f g hh ii", ""), ("the adaptive planner.", "adaptive planner")])
def test_english_phrase(spark, raw, want):
    assert one(spark, text.english_phrase(F.lit(raw)), q=1) == want


@pytest.mark.parametrize("raw,want", [("本文采用深度网络", "深度网络"), ("其中，自适应规划器", "自适应规划器"), ("在", ""), ("与及在是模型", "模型"), ("该" * 30 + "模型", "模型"), ("在模", "在模"), ("命名为即", "命名为即"), ("  和 ", "")])
def test_chinese_term(spark, raw, want):
    assert one(spark, text.chinese_term(F.lit(raw)), q=1) == want


@pytest.mark.parametrize("spec,want", [("1,3-4", [0, 2, 3]), ("all", [0, 1, 2, 3, 4]), ("", [0, 1, 2, 3, 4]), ("9", []), ("5-3", []), ("0,2", [1]), ("4-99", [3, 4]), ("3-", None), ("x", None), ("1-2-3", None), (None, [0, 1, 2, 3, 4])])
def test_page_numbers(spark, spec, want):
    assert one(spark, text.page_numbers(F.lit(spec).cast("string"), F.lit(5)), q=1) == want


@pytest.mark.parametrize("spec,want", [("9,1-2,2", [1, 2, 9]), ("all", [1, 2, 3]), ("2-1", []), ("-4", None)])
def test_page_set_is_not_clipped(spark, spec, want):
    assert one(spark, text.page_set(F.lit(spec), F.lit(3)), q=1) == want


@pytest.mark.parametrize("a,b,want", [("all", "2-4", True), ("2-5", "3,5", True), ("2-4", "all", False), ("2-4", "1-3", False), ("1-9", "12", False), ("1-3", "x", False), ("x", "1", False), ("x", "all", False), ("", "x", True), ("1-12", "12", True)])
def test_selection_covers(spark, a, b, want):
    assert one(spark, text.selection_covers(F.lit(a), F.lit(b)), q=1) is want


def test_geometry(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 5.0, 5.0, 15.0, 15.0)], "x0 double,y0 double,x1 double,y1 double,rx0 double,ry0 double,rx1 double,ry1 double")
    row = df.select(Box.of().overlap_ratio(Box.of("r")).alias("o"), Box.of().x_overlap(Box.of("r")).alias("x"), Box.of().column(600.0).alias("c"), landscape(F.lit(2.0), F.lit(1.0)).alias("l")).first()
    assert (row.o, row.x, row.c, row.l) == (0.25, 0.5, "left", True)


def specs(text_="abc def"):
    return [{"id": "a", "text": "x_1", "math": True, "open": "[[Q_INLINE_00_a]]", "close": "[[/Q_INLINE_00_a]]", "anchor_offset": 3}, {"id": "b", "text": "y", "math": False, "open": "[[Q_INLINE_01_b]]", "close": "[[/Q_INLINE_01_b]]", "anchor_offset": None}]


SPECS = "s array<struct<id:string,text:string,math:boolean,open:string,close:string,anchor_offset:int>>"


def source(spark, text_, *fragments):
    """The translation source of a text with fragments (text, anchor), markers written < and >."""
    rows = [(str(n), t, False, "<", ">", at) for n, (t, at) in enumerate(fragments)]
    return spark.createDataFrame([(rows,)], SPECS).select(identity.translation_source(F.lit(text_), F.col("s")).alias("t")).first()["t"]


@pytest.mark.parametrize("text_,fragments,want", [
    ("abc def", [("x", 3), ("y", None), ("z", None)], "abc <x> def\n<y>\n<z>"), ("  abc def ", [("x", 4)], "abc <x> def"), ("f(a)", [("x", 2)], "f(<x> a)"), ("abc, d", [("x", 3)], "abc <x>, d"), ("甲（乙。", [("x", 2)], "甲（<x> 乙。"),
    ("甲乙。", [("x", 2)], "甲乙 <x>。"), ("ab", [("x", -5), ("y", 99)], "<x> ab <y>"), ("ab cd", [("x", 1), ("y", 1)], "a <x>  <y> b cd"), ("", [("x", 0)], "<x>"), ("ab", [], "ab"),
])
def test_translation_source(spark, text_, fragments, want):
    assert source(spark, text_, *fragments) == want


def test_markers_round_trip(spark):
    s = specs()
    marked = spark.createDataFrame([(s,)], SPECS).select(identity.translation_source(F.lit("abc def"), F.col("s")).alias("t")).first()["t"]
    assert marked == "abc [[Q_INLINE_00_a]]x_1[[/Q_INLINE_00_a]] def\n[[Q_INLINE_01_b]]y[[/Q_INLINE_01_b]]"
    assert identity.restore_markers(marked, s) == "abc x_1 def y"
    assert identity.restore_markers("好 [[Q_INLINE_00_a]]z[[/Q_INLINE_00_a]] 的 [[Q_INLINE_01_b]]乙[[/Q_INLINE_01_b]]", s) == "好 x_1 的乙".replace("好 x_1 的", "好x_1的")


@pytest.mark.parametrize("reply", ["none", "[[Q_INLINE_00_a]]z[[/Q_INLINE_00_a]]", "[[Q_INLINE_01_b]]乙[[/Q_INLINE_01_b]][[Q_INLINE_00_a]]z[[/Q_INLINE_00_a]]", "[[Q_INLINE_00_a]][[Q_INLINE_01_b]]z[[/Q_INLINE_00_a]]乙[[/Q_INLINE_01_b]]", "[[Q_INLINE_00_a]]z[[/Q_INLINE_00_a]][[Q_INLINE_01_b]] [[/Q_INLINE_01_b]]"])
def test_bad_markers_are_refused(reply):
    assert identity.restore_markers(reply, specs()) is None


def test_marker_specs_ignore_ids(spark):
    schema = "f array<struct<id:string,text:string,bbox:array<double>,kind:string,math_only:boolean,has_math:boolean,anchor_offset:int,page:int>>"
    frag = lambda i: [(i, "t", [1.0, 2.0, 3.0, 4.0], "body", False, False, None, 1), (i + "2", "u", [1.0, 1.0, 3.0, 4.0], "body", False, False, 5, 1)]
    a, b = (spark.createDataFrame([(frag(i),)], schema).select(identity.fragment_specs(F.col("f")).alias("s")).first()["s"] for i in ("p", "q"))
    assert [x["open"] for x in a] == [x["open"] for x in b] and [x["text"] for x in a] == ["u", "t"]


def test_marker_specs(spark):
    schema = "f array<struct<id:string,text:string,bbox:array<double>,kind:string,math_only:boolean,has_math:boolean,anchor_offset:int,page:int>>"
    rows = [("a", " x ", [1.2, 2.25, 3.0, 4.75], "body", None, True, 7, 3), ("b", "", [1.0, 1.0, 3.0, 4.0], "body", False, False, 1, 3), ("c", None, None, None, None, None, None, None), ("d", "y", None, None, None, None, None, None)]
    rows += [(str(n), "z", [0.0, float(n), 1.0, 1.0], "body", False, False, None, 1) for n in range(120)]
    got = spark.createDataFrame([(rows,)], schema).select(identity.fragment_specs(F.col("f")).alias("s")).first()["s"]
    salt = hashlib.sha256("3\x001.0,2.0,3.0,5.0\0 x \0body".encode()).hexdigest()[:8]
    assert (got[0]["id"], got[0]["text"], got[0]["math"], got[0]["open"]) == ("a", "x", True, f"[[Q_INLINE_0_{salt}]]")
    assert len(got) == 122 and got[121]["open"].startswith("[[Q_INLINE_121_") and len({x["open"] for x in got}) == 122 and got[1]["id"] in ("0", "d")


def test_null_column_has_an_identity(spark):
    uid = lambda c: one(spark, identity.layout_uid(F.lit(2), F.lit(c).cast("string"), [F.lit(x) for x in (1.24, 2.25, 3.75, 4.0)], F.lit(" a  b ")), q=1)
    assert uid(None) == uid("") == hashlib.sha256("2\0?\x001.0,2.0,4.0,4.0\0a b".encode()).hexdigest()[:24] != uid("left")


@pytest.mark.parametrize("raw,want", [("a “ b ” c", "a “ b ” c"), ("a — b … c", "a — b … c"), ("中文 。 好", "中文。好"), ("中 — b", "中— b")])
def test_reflow_keeps_blanks_beside_other_signs(spark, raw, want):
    assert one(spark, text.reflow(F.lit(raw)), q=1) == want


BLOCK = "paper_id bigint, page int, block_key bigint, x0 double, y0 double, x1 double, y1 double, size double, col string, kind string, text string, flow_index int, flow_break boolean"


def block(key, y0, y1, x0=50.0, x1=250.0, col="left", kind="body", text_="some text", page=1, i=0, brk=False, size=10.0):
    return (1, page, key, float(x0), float(y0), float(x1), float(y1), size, col, kind, text_, i, brk)


def merged(spark, *blocks):
    return sorted(r["members"] for r in layout.merge_paragraphs(spark.createDataFrame([*blocks], BLOCK)).collect())


def test_merge_paragraphs(spark):
    assert merged(spark, block(1, 100, 120, text_="A sentence."), block(2, 123, 140, text_="Another one.")) == [[1, 2]]
    assert merged(spark, block(1, 100, 120, text_="A sentence."), block(2, 123, 140, x0=62, text_="Another one.")) == [[1], [2]]
    assert merged(spark, block(1, 100, 120), block(2, 123, 140, col="right", x0=310, x1=500)) == [[1], [2]]
    assert merged(spark, block(1, 100, 120), block(2, 123, 140, kind="table")) == [[1], [2]]
    assert merged(spark, block(1, 100, 120, text_="no end"), block(2, 123, 140, text_="[12] x"), block(3, 123, 140, x0=600, x1=900, text_="far")) == [[1, 2], [3]]


def order(spark, blocks, barriers=None):
    df = layout.reading_order(spark.createDataFrame(blocks, BLOCK), barriers)
    return [(r["block_key"], r["breaks"]) for r in df.orderBy("position").collect()]


def test_reading_order_left_before_right(spark):
    assert [k for k, _ in order(spark, [block(1, 50, 90, x0=310, x1=550, col="right"), block(2, 200, 240)])] == [2, 1]


def test_reading_order_around_a_barrier(spark):
    bar = spark.createDataFrame([(1, 1, 250.0, 400.0)], "paper_id bigint, page int, y0 double, y1 double")
    blocks = [block(1, 100, 200), block(2, 100, 200, x0=310, x1=550, col="right"), block(3, 450, 500), block(4, 450, 500, x0=310, x1=550, col="right"), block(5, 300, 320)]
    assert order(spark, blocks, bar) == [(1, False), (2, False), (3, True), (4, False), (5, False)]


def test_page_continuation(spark):
    def runs(*blocks):
        return [(r["last_key"], r["first_key"]) for r in layout.page_continuations(spark.createDataFrame([*blocks], BLOCK)).collect()]

    assert runs(block(1, 100, 200, text_="goes on"), block(2, 50, 90, page=2)) == [(1, 2)]
    assert runs(block(1, 100, 200, text_="goes on"), block(9, 300, 310, kind="meta", i=1), block(2, 50, 90, page=2)) == [(1, 2)]
    assert runs(block(1, 100, 200, text_="goes on"), block(2, 50, 90, page=2, kind="heading")) == []
    assert runs(block(1, 100, 200, text_="goes on"), block(2, 50, 90, page=3)) == []
    assert runs(block(1, 100, 200, text_="It ends."), block(2, 50, 90, page=2, text_="New.")) == []


def test_nested_roots(spark):
    rows = [block(1, 0, 100, 0, 100), block(2, 10, 60, 10, 60), block(3, 20, 40, 20, 40), block(4, 500, 520)]
    got = {(r["block_key"], r["root"]) for r in layout.nested_roots(spark.createDataFrame(rows, BLOCK)).collect()}
    assert got == {(2, 1), (3, 1)}


def test_neighbours_cross_pages(spark):
    df = spark.createDataFrame([block(k, 0, 1, page=p, i=i) for k, p, i in ((1, 1, 0), (2, 1, 1), (3, 2, 0), (4, 4, 0))], BLOCK)
    prev = {r["block_key"]: r["prev_block_key"] for r in flow.previous(df, ["block_key"]).collect()}
    nxt = {r["block_key"]: r["next_block_key"] for r in flow.following(df, ["block_key"]).collect()}
    assert prev == {1: None, 2: 1, 3: 2, 4: 3} and nxt == {1: 2, 2: 3, 3: 4, 4: None}
    held = flow.carried(df, F.when(F.col("block_key").isin(1, 3), F.col("block_key")), "c")
    assert {r["block_key"]: r["c"] for r in held.collect()} == {1: 1, 2: 1, 3: 3, 4: 3}


def batches(spark, items, breaks=(), budget=1000):
    rows = [(1, 1, k, k, p, t) for k, p, t in items]
    df = spark.createDataFrame(rows, "paper_id bigint, page int, block_key bigint, flow_index bigint, position bigint, text string")
    got = planning.flow_batches(df, F.col("block_key").isin(*breaks) if breaks else F.lit(False), budget)
    out = {}
    for r in got.orderBy("position").collect():
        out.setdefault((r["run"], r["batch"]), []).append(r["block_key"])
    return [*out.values()]


def test_flow_batches(spark):
    assert batches(spark, [(1, 0, "a"), (3, 2, "c"), (4, 3, "d")]) == [[1], [3, 4]]
    assert batches(spark, [(1, 0, "a"), (2, 1, "h"), (3, 2, "b")], breaks=(2,)) == [[1], [2], [3]]
    assert batches(spark, [(1, 0, "a" * 50), (2, 1, "b" * 50), (3, 2, "c" * 50)], budget=180) == [[1, 2], [3]]


def test_resume_status(spark):
    new = spark.createDataFrame([(1, "h", "u"), (2, "h", "u"), (3, "h", None), (4, "h", "u"), (6, "h", "u")], "block_key bigint, source_hash string, layout_uid string")
    old = spark.createDataFrame([(1, "h", "u"), (2, "x", "u"), (3, "h", "u"), (4, None, "u"), (5, "h", "u"), (6, "h", "v")], "block_key bigint, source_hash string, layout_uid string")
    assert {r["block_key"]: r["status"] for r in planning.resume_status(old, new).collect()} == {1: "valid", 2: "stale", 3: "unverifiable", 4: "legacy", 5: "orphan", 6: "layout_stale"}


def test_close_boxes():
    assert tables.close_boxes([(60, 200, 260, 300), (280, 200, 520, 300)]) == [[60.0, 200.0, 520.0, 300.0]]
    assert tables.close_boxes([(0, 0, 2, 2), (0, 0, 10, 10), (100, 100, 110, 110)]) == [[0.0, 0.0, 10.0, 10.0], [100.0, 100.0, 110.0, 110.0]]


def test_table_groups(spark):
    rules = spark.createDataFrame([(1, 1, float(y), 60.0, 280.0) for y in (100, 120, 160, 300, 320, 360, 600, 620)], "paper_id bigint, page int, y double, x0 double, x1 double")
    captions = spark.createDataFrame([(1, 1, 7, 60.0, 80.0, 280.0, 92.0), (1, 1, 8, 60.0, 280.0, 280.0, 292.0)], "paper_id bigint, page int, caption bigint, cx0 double, cy0 double, cx1 double, cy1 double")
    owned = tables.captions_of_rules(rules, captions, 300.0)
    got = tables.table_groups(rules, owned, captions.withColumnRenamed("cy1", "cy1")).collect()
    assert sorted((r["caption"] or 0, r["n_rules"], r["y0"]) for r in got) == [(0, 2, 600.0), (7, 3, 100.0), (8, 3, 300.0)]


def test_upsert_rules(spark):
    ev = [
        (1, "Deep net", "深度网络", 0.7, "harvest", "10", 1), (1, "deep  NET", "深度网络", 0.9, "keyword", "1", 2), (1, "deep net", "深层网络", 0.95, "keyword", "2", 3),
        (1, "deep net", "深层网", 0.99, "x", "2", 4), (1, "deep net", "很深的网", 1.0, "seed", "", 5), (1, "x", "好的", 1.0, "seed", "", 6), (1, "fig", "图", 1.0, "seed", "", 7), (2, "deep net", "深度网络", 0.5, "seed", "", 8),
    ]
    df = spark.createDataFrame(ev, "kb_id int, source string, target string, confidence double, kind string, paper string, seq bigint").repartition(3)
    strict = {r["kb_id"]: r for r in terminology.upsert(df).collect()}
    assert set(strict) == {1, 2}
    a = strict[1]
    assert (a["source"], a["target"], a["confidence"], a["hits"], a["papers"], a["target_alt"]) == ("Deep net", "深度网络", 0.9, 2, "10;2", "深层网络|深层网|很深的网")
    assert {r["kb_id"]: r["papers"] for r in terminology.upsert(df, strict_compat=False).collect()}[1] == "10;1;2"


def test_upsert_takes_over_when_surer(spark):
    ev = [(1, "net", "网络", 0.7, "harvest", "", 1), (1, "net", "网状物", 0.95, "keyword", "", 2)]
    got = terminology.upsert(spark.createDataFrame(ev, "kb_id int, source string, target string, confidence double, kind string, paper string, seq bigint")).first()
    assert (got["target"], got["confidence"], got["target_alt"]) == ("网状物", 0.95, "网络|网状物")


def test_mentions_need_word_boundaries(spark):
    terms = spark.createDataFrame([(1, "speed estimator"), (2, "peed estimator"), (3, "c++"), (4, "rl")], "_id bigint, source string")
    blocks = spark.createDataFrame([(1, "The Speed-Estimator (RL) works in C++."), (2, "url curl")], "block_key bigint, text string")
    assert {(r[0], r[1]) for r in terminology.mentioned(terms, blocks).collect()} == {(1, 1), (3, 1), (4, 1)}


def test_acronym_pairs(spark):
    pairs = spark.createDataFrame([(1, "We use the deep value network (DVN) and the guided planner (GP).", "本文采用深度价值网络（DVN）和引导规划器（GP）。")], "block_key bigint, text string, zh string")
    known = spark.createDataFrame([("gp",)], "term string")
    assert [(r["acronym"], r["source"], r["target"]) for r in terminology.acronym_pairs(pairs, known).collect()] == [("DVN", "deep value network", "深度价值网络")]


def test_parse_reply():
    assert translate.parse_reply('```json\n{"a": "x"}\n```') == {"a": "x"}
    assert translate.parse_reply('Here: {"a": "x", "b": "y"} done') == {"a": "x", "b": "y"}
    assert translate.parse_reply('{"a": "x", "b": "y\\n" oops') == {"a": "x", "b": "y\n"}
    assert translate.parse_reply(None) == {} and translate.parse_reply("no") == {}


def test_run_batch_rescues_missing_runs():
    calls = []

    def model(items, context):
        ids = "".join(i for i, _ in items)
        calls.append(ids)
        return json.dumps({i: "译" for i in ids if ids == "d" or ids == "b" or i not in "bd"})

    got = translate.Batch(model).run([(c, "t") for c in "abcd"])
    assert calls == ["abcd", "b", "d"] and set(got) == set("abcd")


def test_run_batch_bisects_and_stops():
    def model(items, context):
        if len(items) > 1:
            raise RuntimeError("too long")
        return json.dumps({i: "译" for i, _ in items})

    assert set(translate.Batch(model).run([(c, "t") for c in "abcd"])) == set("abcd")

    def refused(items, context):
        raise translate.AuthorizationError

    with pytest.raises(translate.AuthorizationError):
        translate.Batch(refused).run([("a", "t")])


def test_files(spark, tmp_path):
    doc = {"schema_version": 4, "source": "s", "page_count": 1, "pages": [{"page": 1, "width": 600.0, "height": 800.0, "layout_barriers": [], "blocks": [{"id": "p1b0", "bbox": [0, 0, 1, 1], "text": "x"}]}]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    assert files.read_blocks(spark, str(tmp_path / "d.json")).select("page", "block_id", "text").first() == (1, "p1b0", "x")
    (tmp_path / "t1.json").write_text(json.dumps({"a": {"zh": "一"}, "b": {"skip": True}}))
    (tmp_path / "t2.json").write_text(json.dumps({"a": {"zh": "二"}}))
    got = {r["block_id"]: (r["zh"], r["overwrites"]) for r in files.read_translations(spark, str(tmp_path / "t*.json")).collect()}
    assert got == {"a": ("二", 1), "b": (None, 0)}
    (tmp_path / "g1.csv").write_bytes("﻿source,target\nnet,网络\nempty,\n".encode())
    (tmp_path / "g2.csv").write_bytes("net,网络\nbare,\n".encode("gbk"))
    rows = {(r["source"], r["target"]) for r in files.read_glossary(spark, str(tmp_path / "g*.csv")).collect()}
    assert rows == {("net", "网络"), ("bare", "")}
    before = spark.createDataFrame(files.file_records(spark, str(tmp_path / "g*.csv")).collect())
    (tmp_path / "g1.csv").write_text("changed")
    assert {r["name"]: r["valid"] for r in files.manifest_valid(before, files.file_records(spark, str(tmp_path / "g*.csv"))).collect()} == {"g1.csv": False, "g2.csv": True}
    assert files.first_set(None, "", "CHANGEME", "x", "y") == "x"


def test_stream_of_evidence(spark, tmp_path):
    from quire.streaming import evidence

    rows = [(1, "net", "网络", 0.7, "harvest", "1", 1)]
    spark.createDataFrame(rows, evidence.EVIDENCE).write.parquet(str(tmp_path / "in" / "a"))
    import shutil

    (tmp_path / "flat").mkdir()
    for n, f in enumerate((tmp_path / "in" / "a").glob("*.parquet")):
        shutil.copy(f, tmp_path / "flat" / f"a{n}.parquet")
    for _ in range(2):  # a second run sees no new files
        evidence.stream_upsert(spark, str(tmp_path / "flat"), str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination(60)
    assert [(r["source"], r["hits"]) for r in evidence.terms(spark, str(tmp_path / "store")).collect()] == [("net", 1)]


def test_quality_completeness(spark):
    pairs = spark.createDataFrame([(1, "第一句。 最后一句。"), (2, "缺了。"), (3, "x_1 的值")], "block_key bigint, zh string")
    shown = spark.createDataFrame([(1, "第一句。最后 一句。"), (2, "别的"), (3, "x1的值")], "block_key bigint, rendered string")
    assert {r[0]: r[1] for r in quality.complete(pairs, shown).collect()} == {1: True, 2: False, 3: True}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], BLOCK)
    assert layout.merge_paragraphs(empty).count() == 0 and layout.reading_order(empty).count() == 0 and layout.page_continuations(empty).count() == 0
    assert terminology.upsert(spark.createDataFrame([], "kb_id int, source string, target string, confidence double, kind string, paper string, seq bigint")).count() == 0


def test_term_lookups_agree(spark, monkeypatch):
    """The automaton and the joins find the same terms."""
    terms = [(1, "deep net", "深度网络"), (2, "deep-net", "网络"), (3, "net", " 深 度 "), (4, "USA", "用法"), (5, "α-β", "贝塔"), (6, "Ωmega", "欧"), (7, "-x", "叉"), (8, " ", "空"), (9, None, None), (10, "a.b", "深度网络"), (11, "net", "深度网络"), (12, "规划", "规划"), (13, "deep net deep", "缺")]
    rows = [(1, "A Deep -\n net works", "深度 网络很好"), (2, "usage of deep-net, net", "网 络用法"), (3, "alpha α-β Ωmega a.b axb", "贝塔"), (4, "x-x  deep net deep net", None), (5, None, "欧"), (6, "规划 is planning", "规划"), (7, "", "")]
    t = spark.createDataFrame(terms, "_id long, source string, target string")
    b = spark.createDataFrame(rows, "block_key long, text string, zh string").repartition(3)
    found = []
    for limit in (10**6, -1):
        monkeypatch.setattr(terminology, "AUTOMATON_CHARS", limit)
        found.append([
            sorted(map(tuple, terminology.mentions(t, b).collect())), sorted(r[0] for r in terminology.landed(t, b).collect()), sorted(map(tuple, terminology.confirmations(t, b).collect())), sorted(map(tuple, terminology.audit(t, b, b).collect())),
        ])
        assert terminology.mentions(t, b.limit(0)).count() == terminology.mentions(t.limit(0), b).count() == terminology.landed(t.limit(0), b).count() == terminology.confirmations(t.limit(0), b).count() == 0
    assert found[0] == found[1]
    assert {r[0]: r[1] for r in found[0][0]} == {1: 3, 2: 1, 3: 3, 5: 1, 6: 1, 10: 1, 11: 3, 12: 1, 13: 1} and 4 in found[0][1] and 13 not in found[0][1]


@pytest.mark.parametrize("reply,want", [
    ('[{"a": "x"}]', {"a": "x"}), ('I use {braces}. {"a": "x", "b": {"c": 1}} and {more}', {"a": "x", "b": {"c": 1}}), ('{"a": "x\ny"}', {"a": "x\ny"}), ('{"a": "x" "b": "y"', {"a": "x", "b": "y"}),
    ('"a" : "he said \\"no\\"", "b":"\\u4e2d"', {"a": 'he said "no"', "b": "中"}), ('"lone" and "a": "x", "n": 3, "z": "q"', {"a": "x", "z": "q"}), ('"' + "k" * 81 + '": "x"', {}), ('{"a": "x", "a": "y"}', {"a": "y"}), ("```\n{}\n```", {}), ('{"a": "cut o', {}),
])
def test_parse_reply_leniently(reply, want):
    assert translate.parse_reply(reply) == want


def test_rule_groups_equal_brute_force(spark):
    rng = random.Random(4)
    pages = [sorted({(float(rng.randrange(0, 400)), float(x), x + float(rng.randrange(1, 200))) for _ in range(rng.randrange(30)) for x in [rng.randrange(0, 300)]}) for _ in range(60)]

    def brute(rules):
        out = []
        for y, a, b in rules:
            for g in out:
                if y - max(r[0] for r in g) <= 30 and max(0, min(b, max(r[2] for r in g)) - max(a, min(r[1] for r in g))) / min(b - a, max(r[2] for r in g) - min(r[1] for r in g)) >= 0.5:
                    g.append((y, a, b))
                    break
            else:
                out.append([(y, a, b)])
        return out

    df = spark.createDataFrame([(n, p) for n, p in enumerate(pages)], "n int, r array<struct<y:double,x0:double,x1:double>>")
    for n, groups in df.select("n", tables.rule_groups(F.col("r")).alias("g")).collect():
        assert [[tuple(r) for r in g["rules"]] for g in groups] == brute(pages[n])
        assert all((g["y0"], g["y1"], g["x0"], g["x1"]) == (g["rules"][0]["y"], g["rules"][-1]["y"], min(r["x0"] for r in g["rules"]), max(r["x1"] for r in g["rules"])) for g in groups)


def test_batches_check_markers_and_give_context(spark):
    marker = {"id": "f", "text": "x_1", "math": True, "open": "[[Q_INLINE_0_a]]", "close": "[[/Q_INLINE_0_a]]", "anchor_offset": 1}
    seen = []

    def model(items, context):
        seen.append(([i for i, _ in items], context))
        return json.dumps({i: "译 文" if i != "b" or len(items) > 1 else "译[[Q_INLINE_0_a]]y[[/Q_INLINE_0_a]] 文" for i, _ in items}), {"in": 2, "out": 1.5}

    batch = translate.Batch(model, {"b": [marker]})
    assert batch.run([(c, "text " + c) for c in "abc"]) == {"a": "译文", "b": "译x_1文", "c": "译文"}
    assert seen == [(["a", "b", "c"], []), (["b"], [(translate.BEFORE, "text a"), (translate.AFTER, "text c")])] and batch.used == {"in": 4, "out": 3.0}
    rows = [("1", c, "text " + c, n, [tuple(marker.values())] if c == "b" else None) for n, c in enumerate("abc")] + [("2", "d", None, 0, None)]
    df = spark.createDataFrame(rows, "batch string, id string, text string, pos int, specs array<struct<id:string,text:string,math:boolean,open:string,close:string,anchor_offset:int>>")
    answers = translate.answered(df, model)
    assert {r["batch"]: r["zh"] for r in answers.collect()} == {"1": {"a": "译文", "b": "译x_1文", "c": "译文"}, "2": {"d": "译文"}}
    assert {r["name"]: r["total"] for r in translate.usage(answers).collect()} == {"in": 6.0, "out": 4.5}
    assert translate.translate(df.limit(0), model).count() == 0


def test_halves_have_context():
    seen = []

    def model(items, context):
        seen.append(([i for i, _ in items], [w for w, _ in context]))
        return "{}"

    batch = translate.Batch(model, retries=0, depth=1)
    assert batch.run([(c, c) for c in "abc"]) == {}
    assert sorted(seen) == [(["a"], [translate.AFTER]), (["a", "b", "c"], []), (["b", "c"], [translate.BEFORE])]


@pytest.mark.parametrize("done,want", [("", [(0, 4)]), ("a", [(1, 4)]), ("bd", [(0, 1), (2, 3)]), ("abcd", []), ("bc", [(0, 1), (3, 4)])])
def test_missing_runs(done, want):
    assert translate.missing_runs([(c, c) for c in "abcd"], dict.fromkeys(done, "x")) == want


def test_layout_barriers(spark):
    rows = [(1, 1, 0, "table", 40.0, 100.0, 500.0, 200.0), (1, 1, 1, "table", 40.9, 100.5, 500.0, 199.5), (1, 1, 2, "table", 41.8, 100.0, 500.0, 200.0), (1, 1, 3, "image", 40.0, 100.0, 500.0, 200.0), (1, 1, 4, "image", 40.0, 300.0, 300.0, 400.0), (1, 1, 5, "image", 40.0, 300.0, 500.0, 305.0), (1, 2, 6, "vector", 0.0, 0.0, 600.0, 999.0)]
    df = spark.createDataFrame(rows, "paper_id long, page int, n int, kind string, x0 double, y0 double, x1 double, y1 double")
    assert [(r["kind"], r["x0"]) for r in tables.layout_barriers(df, 600.0, 1000.0).orderBy("x0", "kind").collect()] == [("image", 40.0), ("table", 40.0), ("table", 41.8)]


@pytest.mark.parametrize("page,y0,y1,runs", [(1, 730.0, 790.0, False), (1, 100.0, 200.0, True), (2, 10.0, 30.0, False), (2, 100.0, 200.0, True), (1, 719.5, 760.0, False), (2, 5.0, 41.0, False)])
def test_barriers_between_pages_end_a_paragraph(spark, page, y0, y1, runs):
    rows = [block(1, 700.0, 720.0, text_="unfinished sentence", page=1, i=0), block(2, 40.0, 60.0, text_="continues here.", page=2, i=0)]
    bars = spark.createDataFrame([(1, page, y0, y1)], "paper_id long, page int, y0 double, y1 double")
    assert layout.page_continuations(spark.createDataFrame(rows, BLOCK), bars).count() == int(runs)


def test_a_wide_barrier_splits_reading_zones(spark):
    rows = [block(1, 80.0, 100.0), block(2, 80.0, 100.0, x0=350.0, x1=550.0, col="right"), block(3, 500.0, 520.0), block(4, 500.0, 520.0, x0=350.0, x1=550.0, col="right")]
    bars = spark.createDataFrame([(1, 1, 250.0, 400.0)], "paper_id long, page int, y0 double, y1 double")
    got = layout.reading_order(spark.createDataFrame(rows, BLOCK), bars).orderBy("position").collect()
    assert [r["block_key"] for r in got] == [1, 2, 3, 4] and [r["breaks"] for r in got] == [False, False, True, False]
