"""Answers of models, cross-references and settings."""

import copy

import pandas as pd
import pytest
from pyspark.sql import functions as F

from clausework.operators import answers, crossref, emit, settings

LEVEL = {"fmt": "decimal", "pre": "(", "suf": ")", "sep": "tab", "first": 1, "left": 2, "size": 10.5, "bold": False, "font": "", "align": "left", "before": 0, "after": 0}
GOOD = {"version": 1, "base": "t1", "layout": "inline", "font": "明朝", "size": 10.5, "line": 18, "table_size": 9, "levels": {k: dict(LEVEL) for k in settings.LEVELS}}


def test_chunks_hold_their_targets(spark):
    lines = spark.createDataFrame([(1, k, "x" * 10, k == 7) for k in range(12)], "doc_id int, pos int, line string, target boolean")
    got = answers.chunks(lines, chars=45)
    assert sorted(r.pos for r in got.collect()) == [6, 7, 8]
    (row,) = answers.prompts(got, lines, context=1).collect()
    assert [x.split(":")[0] for x in row.body.split("\n")] == ["5", "6", "*7", "8", "9"]


@pytest.mark.parametrize("text, good", [('{"labels": {"1": "item", "2": "text"}}', True), ('```json\n{"labels": {"1": "item", "2": "text"}}\n```', True), ('See {x} {"labels": {"1": "item", "2": "text"}} done', True), ('{"labels": {"1": "item"}}', False), ('{"labels": {"1": "item", "2": "verse"}}', False), ('{"labels": {"1": "item", "2": "text", "3": "text"}}', False), ('{"labels": {"a": "item"}}', False), ("", False), (None, False), ("[1]", False)])
def test_labels_are_taken_whole_or_not(text, good):
    assert answers.labels(text, {1, 2}) == ({1: "item", 2: "text"} if good else None)


def test_answers_are_adopted_only_if_they_keep_the_text():
    para = lambda *b: [{"body": x, "items": []} for x in b]
    article = {"type": "article", "paragraphs": para("次の者を除く。甲。乙。")}
    split = {"paragraphs": [{"body": "次の者を除く。", "items": [{"body": "甲。"}, {"body": "乙。"}]}]}
    assert answers.adopt(article, split)["_ai_restructured"]
    assert answers.adopt(article, {"paragraphs": para("次の者を除く。甲。乙。")}) is None
    assert answers.adopt(article, {"paragraphs": para("別の文。", "丙。")}) is None
    assert answers.adopt(article, {"paragraphs": [{}]}) is None
    assert answers.adopt(article | {"tables": [{}]}, split) is None


def test_a_classifier_may_be_any_function(spark):
    lines = spark.createDataFrame([("a",), ("b",)], "line string")
    out = answers.classified(lines, lambda s: pd.Series(["item" if x == "a" else "song" for x in s]))
    assert {(r.line, r.kind) for r in out.collect()} == {("a", "item"), ("b", None)}


def test_paragraphs_are_found_in_order(spark):
    assert crossref.match(["甲乙丙丁", "甲", "甲乙丙丁", "無い文", ""], ["甲乙丙丁", "甲", "２甲乙丙丁", "甲乙丙丁"]) == [0, 1, 3, None, None]
    src = spark.createDataFrame([(1, 0, "第一 文"), (2, 0, "x")], "doc_id int, pos int, text string")
    out = spark.createDataFrame([(1, 5, "第一文"), (1, 6, "第一文")], "doc_id int, pos int, text string")
    assert {(r.doc_id, r.found) for r in crossref.find(src, out).collect()} == {(1, 5), (2, None)}


def test_bookmarks_move_to_the_numbered_neighbour(spark):
    rows = spark.createDataFrame([(1, 0, 1, "第1条"), (1, 1, 2, "1"), (1, 2, 2, "2"), (1, 3, None, None), (2, 0, 1, ""), (2, 1, 2, "第2条")], "doc_id int, pos int, level int, label string")
    assert {(r.doc_id, r.pos): r["at"] for r in crossref.numbered_neighbour(rows).collect()} == {(1, 0): 0, (1, 1): 0, (1, 2): 2, (1, 3): 3, (2, 0): 1, (2, 1): 1}


def test_settings_are_checked():
    assert settings.normalized(GOOD)["levels"]["item"]["size"] == 10.5
    old = copy.deepcopy(GOOD)
    del old["levels"]["sub_single"]
    assert settings.normalized(old)["levels"]["sub_single"]["fmt"] == "none"
    for path, value in ((("size",), True), (("size",), 99), (("font",), " "), (("base",), "t9"), (("version",), 2), (("levels", "item", "pre"), "%1"), (("levels", "item", "bold"), 1), (("levels", "item"), None), (("line",), float("nan"))):
        bad = copy.deepcopy(GOOD)
        at = bad
        for k in path[:-1]:
            at = at[k]
        at[path[-1]] = value
        with pytest.raises(ValueError):
            settings.normalized(bad)


@pytest.mark.parametrize("args, want", [(("decimal", "(%1)", 0), {"fmt": "decimal", "pre": "(", "suf": ")", "sep": "tab"}), (("decimal", "%1　", 0), {"fmt": "decimal", "pre": "", "suf": "", "sep": "zen"}), (("decimal", "%1-%2", 1), None), (("bullet", "%1", 0), None), ((None, "", None), {"fmt": "none"})])
def test_numbering(args, want):
    assert settings.numbering(*args)[0] == want


def test_most_common_and_template(spark):
    rows = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, None)], "doc_id int, pos int, v string")
    assert settings.most_common(rows, ["doc_id"], "v").first().v == "b"
    styles = [(1, s, "本文") for s in emit.STYLES["t4"]] + [(2, s, "　本文") for s in emit.STYLES["t2"]] + [(3, "Normal", "x")]
    found = settings.detect_template(spark.createDataFrame(styles, "doc_id int, style string, text string"))
    assert {r.doc_id: r.template for r in found.collect()} == {1: "t4", 2: "t3"}


def test_wrapped_titles(spark):
    from clausework.operators import emit

    want = {"目的": "（目的）", "（目的）": "（目的）", "((目的))": "（目的）", "目的（注）": "（目的（注））", "（ （目的） ）": "（目的）", "（注）目的": "（（注）目的）", "（）": "", "　": "", "": "", "（": "（（）"}
    df = spark.createDataFrame([(t,) for t in want], "title string")
    assert {r.title: r.w for r in df.select("title", emit.wrapped(df.title).alias("w")).collect()} == want
