"""Attachments and rewritten references on small cases by hand; groups of spellings with all options."""

from pyspark.sql import functions as F

from clausework.operators import attach, refs, variants


def test_tables_hang_on_the_deepest_open_node(spark):
    kinds = ["table", "chapter", "drawing", "article", "table", "table", "paragraph", "item", "sub", "table", "item", "drawing", "article", "drawing"]
    df = spark.createDataFrame([(1, k, kind, 3) for k, kind in enumerate(kinds)] + [(2, 0, "table", None)], "doc_id long, pos long, kind string, begin long")
    got = [(r["doc_id"], r["pos"], r["index"], r["holder"], r["at"], r["made"]) for r in attach.attached(df).orderBy("doc_id", "pos").collect()]
    assert got == [(1, 0, 0, "front", None, False), (1, 2, 0, "chapter", 1, False), (1, 4, 1, "paragraph", 3, True), (1, 5, 2, "paragraph", 3, True), (1, 9, 3, "sub", 8, False), (1, 11, 1, "item", 10, False), (1, 13, 2, "paragraph", 12, True), (2, 0, 0, "front", None, False)]
    later = {r["pos"]: (r["index"], r["holder"]) for r in attach.attached(df.filter("doc_id = 1"), begin="begin").collect()}
    assert later[0] == (0, "front") and later[2] == (0, "front") and later[4] == (1, "paragraph")
    hung = {(r["pos"], r["kind"]): (r["tables"], r["drawings"]) for r in attach.hung(df.filter("doc_id = 1 and kind not in ('table', 'drawing')").select("doc_id", "pos", "kind"), attach.attached(df), df.select("doc_id", "pos", F.concat(F.lit("c"), "pos").alias("content"))).collect()}
    assert hung[3, "paragraph"] == (["c4", "c5"], []) and hung[3, "article"] == ([], []) and hung[8, "sub"] == (["c9"], [])


def test_tables_go_back_to_paragraphs(spark):
    tables = spark.createDataFrame([(1, 0), (1, 2), (1, 9), (2, 1)], "article long, paragraph long")
    assert {(r["article"], r["paragraph"]): r["to"] for r in attach.restored(tables, spark.createDataFrame([(1,)] * 3, "article long"), ["article"]).collect()} == {(1, 0): 0, (1, 2): 2, (1, 9): 2, (2, 1): None}


def test_references_are_rewritten_by_joins(spark):
    rows = spark.createDataFrame([(1, 1, "第１条、第二条及び第5条の2は、労働基準法第１条及び第２条と同じ。𠮷第1条"), (1, 2, "第１条、第二条及び第5条の2は、労働基準法第１条及び第２条と同じ。𠮷第1条"), (1, 3, None), (1, 4, ""), (1, 5, "前条"), (2, 6, "第１条"), (1, 7, "第１条［参照先なし］と第9条")], "doc_id long, n long, body string")
    before = spark.createDataFrame([(1, 1, 0, "a"), (1, 2, 0, "b"), (1, 5, 2, "c")], "doc_id long, article long, branch long, rid string")
    after = spark.createDataFrame([(1, "a", 12), (1, "b", 30), (1, "c", 7)], "doc_id long, rid string, number long")
    got = {r["n"]: (r["rewritten"], r["missing"]) for r in refs.rewrite(rows, before, after).collect()}
    want = "第１２条、第三十条及び第7条は、労働基準法第１条及び第２条と同じ。𠮷第12条"
    assert got == {1: (want, []), 2: (want, []), 3: (None, []), 4: ("", []), 5: ("前条", []), 6: ("第１条［参照先なし］", ["第１条"]), 7: ("第１条［参照先なし］と第9条［参照先なし］", ["第9条"])}


def test_analysis_options(spark):
    docs = spark.createDataFrame([(1, "「見積」「見積り」見積る及び"), (1, "見積り、および「役職者」「管理職」"), (2, "この規程による。サーバ、サーバー"), (3, None), (4, "及び")], "doc_id long, text string")
    rows = lambda **o: {(r["doc_id"], r["category"], tuple(r["forms"]), r["form"], r["n"], r["correct"]) for r in variants.analyze(docs, **o).collect()}
    assert rows() == {(1, "かな漢字", ("および", "及び"), "および", 1, None), (1, "かな漢字", ("および", "及び"), "及び", 1, None), (1, "送り仮名", ("見積り", "見積"), "見積り", 2, None), (1, "送り仮名", ("見積り", "見積"), "見積", 1, None), (2, "カタカナ", ("サーバ", "サーバー"), "サーバ", 1, None), (2, "カタカナ", ("サーバ", "サーバー"), "サーバー", 1, None)}
    assert {r[1] for r in rows(use_auto=False)} == {"かな漢字"} and {r[1] for r in rows(use_dict=False)} == {"送り仮名", "カタカナ"}
    assert rows(use_dict=False, use_auto=False) == set() and rows(use_auto=False, exclude_forms=("及び",)) == set()
    assert {r[3:5] for r in rows(use_dict=False, use_auto=False, extra_groups=(("独自", ("役職者", "管理職")), ("又", ("管理職", "役職者"))))} == {("役職者", 1), ("管理職", 1)}
    assert ("見積", 2) in {r[3:5] for r in rows(noun_only=False)}
    kind = docs.withColumn("kind", F.lit("規則"))
    assert {r[1:] for r in {(r["doc_id"], r["category"], r["form"], r["correct"]) for r in variants.analyze(kind, use_dict=False, use_auto=False, kind="kind").collect()}} == {("用語の誤用", "規程", "規則")}


def test_numbers_are_dense_over_all_rows(spark):
    from clausework.operators import notes

    df = spark.range(0, 5000, 1, 7).selectExpr("(id * 7919) % 5000 AS v", "id % 3 AS w").repartition(9)
    got = notes.numbered(df, ["w", "v"]).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(5000)) and [(r["w"], r["v"]) for r in got] == sorted((r["w"], r["v"]) for r in got)
    assert notes.numbered(df.filter("false"), ["v"]).count() == 0


def test_comments_of_empty_and_outside_spans(spark):
    from clausework.operators import notes

    runs = spark.createDataFrame([(1, 0, 0, "abc"), (1, 0, 1, "def"), (1, 1, 0, "")], "doc_id long, pos long, run int, text string")
    spans = spark.createDataFrame([(1, 0, 2, 5, "g", "x"), (1, 0, 5, 9, "h", "y"), (1, 0, 7, 9, "i", "z"), (1, 1, 0, 1, "j", "z"), (1, 0, 3, 3, "k", "")], "doc_id long, pos long, start int, end int, group string, surface string")
    assert sorted(tuple(r) for r in notes.ranges(spans, runs).collect()) == [(0, 1, 0, "g", "x", 1, 2), (1, 1, 0, "h", "y", 3, 3)]
