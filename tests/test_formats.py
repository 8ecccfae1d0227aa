"""Formats in effect, displayed numbers and references cut into runs, on small cases by hand."""

import random

import duckdb
from pyspark.sql import functions as F

from clausework.operators import formats, numbering, overlay
from clausework.plans import registry


def test_chains_of_any_depth_and_circles(spark):
    rows = [(1, f"s{k}", f"s{k - 1}" if k else None, "top" if k == 0 else None, f"b{k}" if k % 50 == 3 else None) for k in range(200)]
    rows += [(2, "a", "b", None, None), (2, "b", "c", "here", None), (2, "c", "a", None, None), (2, "self", "self", None, None), (2, "lost", "nowhere", None, None), (3, "s1", None, None, "own")]
    df = spark.createDataFrame(rows, "doc_id long, style string, based_on string, x string, y string")
    got = {(r["doc_id"], r["style"]): (r["x"], r["y"]) for r in formats.inherited(df, ["x", "y"]).collect()}
    assert len(got) == len(rows)
    for k in range(200):
        assert got[1, f"s{k}"] == ("top", f"b{(k - 3) // 50 * 50 + 3}" if k >= 3 else None)
    assert [got[2, s][0] for s in ("a", "b", "c", "self", "lost")] == ["here", "here", "here", None, None] and got[3, "s1"] == (None, "own")
    assert formats.inherited(df.filter("false"), ["x"]).count() == 0


def test_layers_of_a_paragraph(spark):
    attrs = lambda rows, keys, names=formats.PARAGRAPH | formats.NUMBER: formats.families(spark.createDataFrame(rows, f"{keys}, tag string, attr string, value string"), [k.split()[0] for k in keys.split(", ")], names)
    own = attrs([(1, 1, "S", "jc", "val", "center"), (1, 2, "S", "numId", "val", "7"), (1, 3, "S", None, None, None), (1, 4, None, None, None, None), (1, 5, "S", "spacing", "beforeLines", "100"), (1, 6, "S", "spacing", "before", "x")], "doc_id long, pos long, style string")
    styles = attrs([(1, "S", "numId", "val", "7"), (1, "S", "ind", "left", "420"), (1, "D", "ind", "left", "210"), (1, "D", "numId", "val", "7")], "doc_id long, style string")
    levels = attrs([(1, "7", 0, "ind", "left", "840"), (1, "7", 0, "ind", "hanging", "210")], "doc_id long, num string, level int", formats.PARAGRAPH)
    defaults = attrs([(1, "spacing", "before", "40")], "doc_id long", formats.PARAGRAPH).withColumns({"default_style": F.lit("D"), "pitch": F.lit(None).cast("int")})
    got = {r["pos"]: r for r in formats.paragraph_formats(own, styles, levels, defaults).collect()}
    assert got[1]["align"] == "center" and got[2]["align"] == "both"
    assert (got[2]["first"], got[2]["left"]) == (3.0, 4.0)  # a number of its own: the level's indents
    assert (got[3]["first"], got[3]["left"]) == (1.0, 2.0)  # the style's number: the style's left indent, the level's hanging one
    assert (got[4]["first"], got[4]["left"]) == (1.0, 1.0)  # no style: the default one's indent, but not its number
    assert (got[3]["before"], got[5]["before"], got[6]["before"]) == (2.0, 18.0, None)


def test_runs_weigh_by_characters(spark):
    p = spark.createDataFrame([(1, 1, "S"), (1, 2, "S"), (1, 3, None)], "doc_id long, pos long, style string")
    run = "doc_id long, pos long, run int, n int, run_style string, size struct<val:string>, bold struct<val:string>, east struct<eastAsia:string,eastAsiaTheme:string>, latin struct<ascii:string>"
    runs = spark.createDataFrame([(1, 1, 0, 3, None, ("20",), None, ("M", None), None), (1, 1, 1, 3, "C", None, ("0",), (None, "theme"), None), (1, 1, 2, 4, None, ("24",), ("1",), None, None), (1, 2, 0, 0, None, ("99",), None, None, None)], run)
    rest = run.split(", n int, run_style string, ")[1]
    styles = spark.createDataFrame([(1, "S", ("21",), ("1",), None, ("Latin",)), (1, "C", ("20",), None, None, None)], f"doc_id long, style string, {rest}")
    defaults = spark.createDataFrame([(1, None, ("18",), None, None, None)], f"doc_id long, default_style string, {rest}")
    got = {r["pos"]: (r["font"], r["size"], r["bold"]) for r in formats.run_formats(p, runs, styles, defaults).collect()}
    assert got == {1: ("Latin", 10.0, True), 2: ("Latin", 10.5, True), 3: (None, 9.0, False)}


def test_numbers_by_a_counter_for_each_list(spark):
    rnd = random.Random(4)
    rows = [(d, p, rnd.choice((1, 2, 3, 9)), rnd.choice((0, 1, 1, 2, 2, 2, 3))) for d in range(5) for p in range(120)]
    rule = {0: (1, None, None), 1: (1, None, 3), 2: (4, None, None), 3: (1, 1, None)}  # start, restart, override of numbering 2
    defs = [(d, num, "b" if num == 3 else "a", k, "decimal", "".join(f"%{j + 1}." for j in range(k + 1)), rule[k][0], rule[k][1], rule[k][2] if num == 2 else None) for d in range(5) for num in (1, 2, 3) for k in range(4)]
    levels = spark.createDataFrame(defs, "doc_id long, num long, list string, level int, fmt string, text string, start int, restart int, override int")
    got = {(r["doc_id"], r["pos"]): r["label"] for r in numbering.labels(spark.createDataFrame(rows, "doc_id long, pos long, num long, level int"), levels).collect()}
    assert len(got) == len(rows)
    for d in range(5):
        counts, seen = {}, set()
        for _, pos, num, level in (r for r in rows if r[0] == d):
            if num == 9:
                assert got[d, pos] is None
                continue
            c = counts.setdefault("b" if num == 3 else "a", {k: [rule[k][0], 0] for k in range(4)})
            if num == 2 and rule[level][2] and level not in seen:
                c[level] = [rule[level][2], 0]
            if num == 2:
                seen.add(level)
            for k in range(4):
                if level < (k if rule[k][1] is None else rule[k][1]):
                    c[k] = [rule[k][0], 0]
            c[level][1] += 1
            assert got[d, pos] == "".join(f"{c[j][0] + max(c[j][1] - 1, 0)}." for j in range(level + 1))


def test_formats_of_numbers(spark):
    n = [0, 1, 4, 9, 10, 19, 20, 21, 26, 27, 46, 47, 48, 99, 100, 1994]
    want = {"upperRoman": {1994: "MCMXCIV", 4: "IV"}, "lowerLetter": {26: "z", 27: "27"}, "japaneseCounting": {0: "〇", 10: "十", 21: "二十一", 100: "100"}, "irohaFullWidth": {47: "ス", 48: "４８"}, "iroha": {25: None, 47: "ｽ"}, "decimalEnclosedCircle": {20: "⑳", 21: "２１"}, "bullet": {9: ""}, "aiueo": {46: "ﾝ", 47: "４７"}, "odd": {99: "99"}}
    df = spark.createDataFrame([(k,) for k in n], "n long").select("n", *(numbering.styled(F.lit(f), F.col("n")).alias(f) for f in want))
    got = {r["n"]: r for r in df.collect()}
    assert all(got[k][f] == v for f, some in want.items() for k, v in some.items() if v is not None)


def test_pieces_by_characters(spark):
    rnd = random.Random(6)
    runs, spans = [], []
    for p in range(40):
        runs += [(p, k, "".join(rnd.choice("条文あx") for _ in range(rnd.choice((0, 1, 5, 90)))), f"f{k}") for k in range(rnd.randrange(1, 5))]
        spans += [(p, a, a + rnd.choice((0, 1, 7, 70, 400)), f"t{k}") for k in range(rnd.randrange(0, 5)) for a in (rnd.randrange(-3, 100),)]
    out = overlay.pieces(spark.createDataFrame(runs, "p long, run int, text string, fmt string"), spark.createDataFrame(spans, "p long, start int, end int, target string"), ["p"], ["fmt"])
    got = {}
    for r in out.collect():
        for k in range(r["end"] - r["start"]):
            assert (r["p"], r["start"] + k) not in got
            got[r["p"], r["start"] + k] = (r["run"], r["fmt"], r["text"][k], sorted(r["targets"]))
    want = {}
    for p in range(40):
        chars = [(run, fmt, c) for q, run, text, fmt in runs if q == p for c in text]
        for k, (run, fmt, c) in enumerate(chars):
            want[p, k] = (run, fmt, c, sorted(t for q, a, b, t in spans if q == p and a <= k < b and a < b))
    assert got == want


def test_where_a_result_is_shown(spark):
    df = spark.createDataFrame([("第１条と第１条", "第１条", 0), ("第１条と第１条", "第１条", 1), ("第１条と第１条", "第１条", 5), ("第１条", "第２条", 0), ("第１条", "", 0)], "t string, r string, k int")
    assert [r[0] for r in df.select(overlay.shown_at(F.col("t"), F.col("r"), F.col("k"))).collect()] == [0, 4, 4, None, None]


def test_pieces_shuffle_a_row_once(spark):
    runs = spark.createDataFrame([(p, k, "第１条" * 30, "f") for p in range(9) for k in range(4)], "p long, run int, text string, fmt string")
    spans = spark.createDataFrame([(p, 7 * k, 7 * k + 90, f"t{k}") for p in range(9) for k in range(30)], "p long, start int, end int, target string")
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert shuffles(overlay.pieces(runs, spans, ["p"], ["fmt"])) == 1
    both = runs.unionByName(spans, allowMissingColumns=True).repartition("p")
    assert shuffles(overlay.pieces_of(both, ["p"], ["fmt"])) == 1
    assert overlay.pieces_of(both, ["p"], ["fmt"]).exceptAll(overlay.pieces(runs, spans, ["p"], ["fmt"])).count() == 0


def test_reference_pieces_shuffle_line_items_once(spark, tmp_path):
    rows = [(o, n, 5 * o + n, 3 * o + n, 1.0, "A", "F") for o in range(40) for n in (1, 2, 2, 3)] + [(None, 1, 1, 1, 1.0, "A", "F"), (3, 4, None, 2, 1.0, "A", "F"), (4, 4, 2, 1, 1.0, None, "F")]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = registry.QUERIES["reference_pieces"](spark, str(tmp_path))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    columns = ["doc_id", "run", "fmt", "start", "text", "targets"]
    want = db.execute(registry.ORACLES["reference_pieces"]).df()[columns]
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(want.itertuples(index=False, name=None)) and len(want) > 100


def test_pieces_at_the_ends_of_buckets_and_odd_spans(spark):
    runs = [(1, 0, "あ" * 64, "a"), (1, 1, "い" * 64, "b"), (1, 2, None, "c"), (2, 0, "う" * 200, "a"), (3, 0, "", "a")]
    spans = [(1, 63, 64, "x"), (1, 64, 128, "y"), (1, 127, 5_000_000_000, None), (1, None, 9, "n"), (1, 3, None, "n"), (1, 128, 130, "n"), (1, -9, 0, "n"), (2, 63, 191, "z"), (3, 0, 4, "n"), (4, 0, 4, "n"), (None, 0, 4, "n")]
    out = overlay.pieces(spark.createDataFrame(runs, "p long, run int, text string, fmt string"), spark.createDataFrame(spans, "p long, start long, end long, target string"), ["p"], ["fmt"])
    got = sorted((r["p"], r["run"], r["fmt"], r["start"], r["end"], len(r["text"]), r["targets"]) for r in out.collect())
    assert got == [
        (1, 0, "a", 0, 63, 63, []), (1, 0, "a", 63, 64, 1, ["x"]), (1, 1, "b", 64, 127, 63, ["y"]), (1, 1, "b", 127, 128, 1, ["y", None]),
        (2, 0, "a", 0, 63, 63, []), (2, 0, "a", 63, 191, 128, ["z"]), (2, 0, "a", 191, 200, 9, []),
    ]
