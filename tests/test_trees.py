"""Trees as files, and documents made from them."""

import json

from pyspark.sql import functions as F

from clausework.operators import compare, emit, reader, structure
from clausework.sources import docx, trees

LINES = ["第1章　総則", "第1条（目的）　この規則は秩序を保つ。", "２　次の書類を出す。", "（１）願書"]


def test_trees_are_read_and_checked(spark, tmp_path):
    tree = reader.read(LINES)
    (tmp_path / "a.json").write_text(json.dumps(tree, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "b.json").write_text('[{"type": "article", "number": true}]', encoding="utf-8")
    rows = trees.read(spark, str(tmp_path)).withColumnRenamed("path", "doc_id")
    good, broken = trees.split(rows)
    assert [json.loads(r.tree) for r in good.collect()] == [tree] and [r.rule for r in broken.collect()] == ["number"]
    article = trees.nested(good).select(F.col("tree")[0]["articles"][0].alias("a")).first().a
    assert article.title == "目的" and article.paragraphs[1]["items"][0].body == "願書"


def test_documents_from_trees(spark):
    df = spark.createDataFrame([(1, json.dumps(reader.read(LINES)))], "doc_id int, tree string")
    content = trees.documents(emit.plan(structure.nodes(df), "t1")).first().content
    assert [(r[3], r[2]) for r in docx.read_blocks(bytes(content))] == [("02-第●章", "総則"), ("03-第●条", "（目的）"), ("04-項", "この規則は秩序を保つ。"), ("04-項", "次の書類を出す。"), ("05-(1)号", "願書")]


def test_comparison_documents(spark):
    old, new = reader.read(LINES), reader.read([*LINES[:1], LINES[1].replace("保つ", "守る"), *LINES[2:]])
    versions = spark.createDataFrame([(1, json.dumps(old), json.dumps(new))], "doc_id int, old string, new string")
    content = trees.comparisons(compare.rows(versions)).first().content
    table = next(json.loads(r[7]) for r in docx.read_blocks(bytes(content)) if r[1] == "table")
    assert table[0] == ["現行", "改正案", "備考"] and "保つ" in table[1][0] and "守る" in table[1][1]
    assert [r[2] for r in docx.read_blocks(docx.comparison([]))] == ["変更点はありません。"]


def test_functions_in_sql(spark):
    from clausework.functions.register import register

    assert {"cw_number", "cw_normal", "cw_same_script", "cw_outline"} < set(register(spark))
    row = spark.sql("SELECT cw_number('百二十') AS a, cw_normal('（１）　甲') AS b, cw_same_script(12, '三') AS c, cw_outline('第1条（甲）　乙。') AS d").first()
    assert tuple(row) == (120, "甲", "十二", ["第1条（甲）", "  1:乙。"])


def test_sql_functions_are_the_column_forms(spark):
    from clausework.functions import register

    register.register(spark)
    df = spark.createDataFrame([("第十二条（目的）",), ("（１）甲",), ("　第３章　総則",), ("",), (None,), ("２　会社は、it's \\ 'x'",), ("次の各号のとおり。",), ("ⅳ",), ("③",), ("附　則",)], "arg0 string").withColumn("arg1", F.col("arg0")).withColumn("n", F.length("arg0").cast("long"))
    df.createOrReplaceTempView("register_rows")
    for name, (make, types) in register.SCALARS.items():
        args = ["n" if t == "bigint" else f"arg{i}" for i, t in enumerate(types)]
        called = spark.sql(f"SELECT cw_{name}({', '.join(args)}) FROM register_rows")
        assert [r[0] for r in called.collect()] == [r[0] for r in df.select(make(*map(F.col, args))).collect()], name
        assert "Python" not in called._jdf.queryExecution().executedPlan().toString() and "Arrow" not in called._jdf.queryExecution().executedPlan().toString()


def test_table_functions(spark):
    from clausework.functions.register import register

    register(spark)
    spark.createDataFrame([(1, 2, "一。"), (1, 1, "第１条（甲）"), (2, 1, "前文"), (2, 2, None)], "doc_id long, pos int, line string").createOrReplaceTempView("register_lines")
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM cw_outline_rows(TABLE(register_lines) PARTITION BY doc_id ORDER BY pos)").collect())
    assert got == [(1, 0, "第１条（甲）"), (1, 1, "  1:一。"), (2, 0, "前付け:前文")]
