"""Operators on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from clausework.functions import text as T
from clausework.operators import compare, editing, emit, reader, refs, structure, validate, variants, verify
from clausework.sources import docx


def article(n, title, *bodies):
    return {"type": "article", "number": n, "branch": 0, "number_str": f"第{n}条", "title": title, "title_note": "", "paragraphs": [{"type": "paragraph", "number": k, "body": b, "items": []} for k, b in enumerate(bodies, 1)]}


BASE = [article(n, f"題{n}", f"本文その{n}を定める。") for n in range(1, 8)]


def test_columns_agree_with_the_reader(spark):
    lines = ["第十二条の２【適用】 1 本文", "第５条～第７条　削除", "（１）甲", "⑶乙", "ア　丙", "(iv) 丁", "２　戊", "　　　　３", "（目的）　※注", "第６条＃２（己）", "第８条従業員は", "定年は満", "1.5倍", ""]
    got = spark.createDataFrame(list(enumerate(lines)), "i int, line string").select("i", T.marker(F.col("line")).alias("m"), T.article(F.col("line")).alias("a"), T.paragraph(F.col("line")).alias("p")).orderBy("i").collect()
    for row, line in zip(got, lines, strict=True):
        seen = reader.look(line)
        assert row.m.kind == seen.kind and (seen.kind is None or row.m.number == seen.nth)
        assert (row.a is None) == (seen.article is None) and (row.p is None) == (seen.paragraph is None)
        if seen.article:
            node = reader.article_node(seen.article, seen.article[7].strip())
            assert (row.a.number, row.a.branch, row.a.title, row.a.body, row.a.range_to) == (node["number"], node["branch"], node["title"], node["body"], node["range_to"])


def kinds(old, new):
    return [(r["kind"], r["old_heading"], r["new_heading"]) for r in compare.view(old, new)["rows"]]


def test_identical_versions_have_no_rows():
    assert kinds(BASE, BASE) == []


def test_an_insertion_renumbers_the_rest():
    new = [BASE[0], article(2, "雑則", "まったく別の条文とする。"), *BASE[1:]]
    rows = compare.view(BASE, new)["rows"]
    assert [r["kind"] for r in rows] == ["added", "renumbered", "renumbered", "summary"]
    assert rows[-1]["note"].startswith("条番号の繰り下げのみ") and rows[-1]["old_heading"] == "第４条～第７条"


def test_changed_characters_are_marked():
    new = [*BASE[:2], article(3, "題3", "本文その3を改める。"), *BASE[3:]]
    (row,) = compare.view(BASE, new)["rows"]
    assert row["kind"] == "changed"
    assert "".join(s for line in row["new"] for s, changed in line if changed) == "改"


def test_a_moved_reference_is_no_change():
    old = [article(1, "甲", "第2条による。"), article(2, "乙", "丙とする。")]
    new = [article(1, "新", "丁を新たに設ける規定とする。"), article(2, "甲", "第3条による。"), article(3, "乙", "丙とする。")]
    assert [k for k, *_ in kinds(old, new)] == ["added", "renumbered", "renumbered"]


def test_pairing_sums_up_highest():
    import itertools
    import random

    def best(s, n, m):
        """The highest sum by trying all ways."""
        most = 0.0
        for k in range(min(n, m) + 1):
            for a in itertools.combinations(range(n), k):
                for b in itertools.combinations(range(m), k):
                    if all(s[i, j] >= compare.PAIRED for i, j in zip(a, b, strict=True)):
                        most = max(most, sum(s[i, j] for i, j in zip(a, b, strict=True)))
        return most

    rnd = random.Random(3)
    for _ in range(60):
        n, m = rnd.randrange(5), rnd.randrange(5)
        s = {(i, j): rnd.choice((0.0, 0.5, 0.6, 0.9, 1.0)) for i in range(n) for j in range(m)}
        pairs = compare.pair_similar(list(range(n)), list(range(m)), lambda i, j, s=s: s[i, j])
        assert [i for i, _ in pairs if i is not None] == list(range(n)) and [j for _, j in pairs if j is not None] == list(range(m))
        assert abs(sum(s[p] for p in pairs if None not in p) - best(s, n, m)) < 1e-9


def test_runs_of_renumbering():
    chapter = lambda n, *articles: {"type": "chapter", "number": n, "number_str": f"第{compare.wide(n)}章", "title": f"章{n}", "articles": list(articles)}
    old = [chapter(1, *(article(k, f"題{k}", f"本文その{k}。") for k in (1, 2, 3))), chapter(2, *(article(k, f"題{k}", f"本文その{k}。") for k in (4, 5, 6)))]
    new = [chapter(1, article(1, "新", "別の定めを置くものとする。"), *old[0]["articles"]), *old[1:]]
    rows = compare.view(old, new)["rows"]
    assert [(r["kind"], r["old_heading"], r["new_heading"]) for r in rows] == [
        ("added", "", "第１条（新）"), ("renumbered", "第１条（題1）", "第２条（題1）"), ("renumbered", "第２条（題2）", "第３条（題2）"), ("summary", "第３条～第６条", "第４条～第７条"),
    ]
    assert rows[-1]["note"] == "条番号の繰り下げのみ（内容の変更なし、以降同様）"
    blocks = compare.view(old, new)["blocks"]
    assert [b["row_id"] for b in blocks if b["row_note"]] == ["summary:第３条～第６条"]


def test_marks_of_every_level():
    tree = [{"type": "article", "number": 1, "number_str": "第１条", "title": "甲", "title_note": "注", "lead": ["前書"], "paragraphs": [{"number": 1, "body": "一", "items": [{"number": 1, "body": "二", "sub_items": [{"number": 1, "body": "三", "sub_items2": [{"number": 1, "body": "四"}]}, {"number": 2, "body": "五"}]}, {"number": 2, "body": "六", "sub_items": [{"body": "七"}]}]}], "tables": [{"rows": [["八", "九"]]}]}]
    (unit,) = compare.units(tree, True)
    assert unit["parts"] == [("", "", "前書"), ("第１条", "第1条", "（甲）　注"), ("１　", "1　", "一"), ("（１）", "（1）", "二"), ("　ア　", "　ア　", "三"), ("　　（ア）", "　　（ア）", "四"), ("　イ　", "　イ　", "五"), ("（２）", "（2）", "六"), ("　＊　", "　", "七"), ("", "", "［表］　八／九")]
    (unit,) = compare.units(tree, False)
    assert [x for x, *_ in unit["parts"]] == ["", "第１条", "１　", "（１）", "　ア　", "　　（ア）", "　イ　", "（２）", "　＊　", ""]


def test_equal_headings_keep_their_rows_apart():
    old = [article(1, "甲", "一を定める。"), article(1, "甲", "二を定める。")]
    new = [article(1, "甲", "一を変える。"), article(2, "甲", "二を変える。")]
    ids = [r["id"] for r in compare.view(old, new)["rows"]]
    assert len(set(ids)) == len(ids)


@pytest.mark.parametrize("parts, text", [(("a＋b", "c"), "（a＋b）÷c"), (("（a＋b）", "c"), "（a＋b）÷c"), (("（a）＋（b）", ""), "（a）＋（b）"), (("", ""), "")])
def test_formula(parts, text):
    assert compare.formula({"num": parts[0], "den": parts[1]}) == text


def test_references_are_told_apart_and_rewritten(spark):
    text = "労働基準法第32条及び第33条、この規則第2条の２第三項、第九条"
    assert [(r[4], r[5], r[6]) for r in refs.scan(text)] == [(32, 0, True), (33, 0, True), (2, 2, False), (9, 0, False)]
    rows = spark.createDataFrame([(1, "第二条と第３条")], "doc_id int, body string")
    before = spark.createDataFrame([(1, 2, 0, 7), (1, 3, 0, 8)], "doc_id int, article long, branch long, rid long")
    after = spark.createDataFrame([(1, 7, 12)], "doc_id int, rid long, number long")
    (row,) = refs.rewrite(rows, before, after).collect()
    assert row.rewritten == "第十二条と第３条［参照先なし］" and row.missing == ["第３条"]


def test_text_is_compared_without_its_signs():
    assert verify.normal("①　（１）　第３条　ＡＢＣ １") == verify.normal("ABC1")
    assert verify.normal("") == verify.normal(None) == ""


def test_variants(spark):
    docs = spark.createDataFrame([(1, "甲及び乙、甲および丙。正社員と職員。"), (2, None)], "doc_id int, text string")
    assert {(r.form, r.n) for r in variants.group_counts(docs).collect()} == {("及び", 1), ("および", 1)}
    assert [s[2] for s in variants.find_spans("前項の規程による年次有給休暇", variants.dictionary())] == ["規程", "年次有給休暇"]
    assert variants.verb("申し出た", "申し出", 0) and not variants.verb("申し出が", "申し出", 0)


def test_rules_of_trees():
    broken = [{"type": "article", "number": True, "paragraphs": [{"body": 1}]}, {"type": ""}, 3, {"type": "supplement", "title": "x" * 201, "body": ""}]
    assert [r for _, r in validate.broken(broken)] == ["number", "body", "type", "node", "supplement"]
    assert validate.broken(BASE) == []
    assert [r for _, r in validate.broken([{"type": "drawing", "index": -1}, {"type": "unknown", "x": 1}])] == ["figure_index"]


@pytest.mark.parametrize(
    "node, want",
    [
        ({"type": "article", "paragraphs": 3}, [("[0]/paragraphs", "list")]),
        ({"type": "article", "paragraphs": [{"items": [{"sub_items": [{"sub_items2": None, "level": "x"}]}]}]}, [("[0]/paragraphs[0]/items[0]/sub_items[0]", "mark_or_level")]),
        ({"type": "article", "tables": 1, "drawings": [{"type": "formula", "num": "x" * 201}, {"type": "formula", "num": "a\x01"}, {"type": "formula", "den": 3}]}, [("[0]", "tables_kind"), ("[0]/drawings[0]", "formula_length"), ("[0]/drawings[1]", "formula_control"), ("[0]/drawings[2]", "formula_kind")]),
        ({"type": "article", "drawings": [{"type": "image", "mime": "image/gif", "data": ""}, {"type": "image", "mime": "image/png", "data": "!"}, {"type": "image", "mime": "image/png", "data": "AAAA"}, {"type": "drawing", "text": 3}]}, [("[0]/drawings[0]", "image_kind"), ("[0]/drawings[1]", "image_broken"), ("[0]/drawings[2]", "image_mismatch"), ("[0]/drawings[3]", "drawing_text")]),
        ({"type": "article", "tables": [{"rows": [["x"] * 11]}, {"rows": [["x" * 1001]]}, {"rows": [3]}] + [{"rows": [["x"] * 10] * 50}] * 5}, [("[0]/tables[0]", "table_shape"), ("[0]/tables[1]", "table_cell"), ("[0]/tables[2]", "table_rows"), ("[0]/tables[7]", "table_total")]),
        ({"type": "chapter", "title": 1}, [("[0]", "chapter")]),
        ({"type": "chapter", "number": 1.5, "articles": [3]}, [("[0]", "number"), ("[0]/articles[0]", "article")]),
        ({"type": "front_matter", "indices": ["x"]}, [("[0]", "matter")]),
        ({"type": "plain", "body": 1}, [("[0]", "body")]),
    ],
)
def test_each_rule(node, want):
    assert validate.broken([node]) == want
    assert validate.broken(node) == [("", "tree")]


def test_split_and_merge_are_inverse():
    tree = [article(1, "甲", "一。", "二。", "三。"), article(2, "乙", "四。")]
    split = editing.split_article(tree, 0, 1)
    assert [len(a["paragraphs"]) for a in split] == [1, 2, 1] and [a["number"] for a in split] == [1, 2, 3]
    assert [len(a["paragraphs"]) for a in editing.merge_articles(split, 0)] == [3, 1]
    headed = editing.split_article([article(1, "甲", "一。", "第2条＃２（丙）　二。")], 0, 1)
    assert headed[1]["title"] == "丙" and headed[1]["paragraphs"][0]["body"] == "二。"


def test_model_answers_are_held_to_the_text():
    assert editing.restructured(["甲は乙を行う。丙は丁を行う。"], ["甲は乙を行う。", "丙は丁を行う。"])
    assert not editing.restructured(["甲は乙を行う。"], ["甲は戊を行う。"])
    assert not editing.restructured(["甲は乙を行う。丙は丁を行う。"], ["甲は乙"])


def test_segments(spark):
    rows = spark.createDataFrame([(1, "甲及び乙")], "doc_id int, text string")
    spans = spark.createDataFrame([(1, 1, 3)], "doc_id int, start int, end int")
    assert [(r.piece, r.marked) for r in emit.segments(rows, spans, ["doc_id"]).orderBy("ord").collect()] == [("甲", False), ("及び", True), ("乙", False)]


def test_office_documents_round_trip(spark, tmp_path):
    data = docx.write([("Normal", "第1条（目的）\n本文とする。"), ("Normal", "２　次項。")], [[[("甲", False)], [("乙", True)]]])
    (tmp_path / "a.docx").write_bytes(data)
    blocks = docx.scan(spark, str(tmp_path))
    table = blocks.filter("kind = 'table'").first()
    assert json.loads(table.rows) == [["甲", "乙"]] and table.table_index == 0
    lines = docx.lines(blocks).withColumnRenamed("path", "doc_id")
    assert [r.text for r in structure.outlines(lines).orderBy("row_no").collect()] == ["第1条（目的）", "  1:本文とする。", "  2:次項。"]


def test_arriving_documents(spark, tmp_path):
    from clausework.streaming.folder import arriving_lines

    spark.createDataFrame([(1, "第1条（甲）\n（１）乙"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    q = arriving_lines(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        assert {(r.doc_id, r.kind) for r in spark.table("arrived").collect()} == {(1, "article"), (1, "item"), (2, "blank")}
    finally:
        q.stop()
