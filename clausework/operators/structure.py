"""Document structure over many documents: lines, matter, units, nodes, trees, and tree arithmetic by windows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as X
from ..functions import text as T
from . import reader


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, line: a row for each line of a text."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "line"))


def matter(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows (key, pos, line) with part: front, body, back or dropped (blank lines and page numbers in the body).

    The body begins at the first heading, or at the title in brackets right before it, and ends at the first stop word or appendix
    head behind it; a stop word that a broken-off line leads to, with a particle behind it, is a reference.
    """
    s = F.trim(F.col("line"))
    heading = T.strip_left(F.col("line")).rlike(X.CHAPTER) | T.strip_left(F.col("line")).rlike(X.ARTICLE)
    by_pos = Window.partitionBy(key).orderBy("pos")
    df = rows.withColumn("filled", F.when(s != "", F.col("line")))
    df = df.withColumn("before", F.last("filled", True).over(by_pos.rowsBetween(Window.unboundedPreceding, -1)))
    begin = F.min(F.when(heading, F.col("pos"))).over(Window.partitionBy(key))
    df = df.withColumn("begin", begin)
    title = T.strip_left(F.col("line")).rlike(X.TITLE) & ~F.regexp_extract(T.strip_left(F.col("line")), X.TITLE, 1).rlike(X.NOTE)
    last_front = F.max(F.when((F.col("pos") < F.col("begin")) & F.col("filled").isNotNull(), F.struct("pos", title.alias("title")))).over(Window.partitionBy(key))
    df = df.withColumn("first", F.when(last_front["title"], last_front["pos"]).otherwise(F.col("begin")))
    n = T.stop_word(F.col("line"))
    reference = F.coalesce(T.mid_sentence(F.col("before")), F.lit(False)) & F.substring(s, n + 1, F.length(s)).rlike(X.STOP_WORD_AS_REFERENCE)
    stops = ((n > 0) & ~reference) | s.rlike(X.APPENDIX)
    df = df.withColumn("back", F.min(F.when(stops & (F.col("pos") > F.col("begin")), F.col("pos"))).over(Window.partitionBy(key)))
    dropped = (s == "") | ((F.col("pos") >= F.col("first")) & s.rlike(X.PAGE_NUMBER) & (F.col("back").isNull() | (F.col("pos") < F.col("back"))))
    part = F.when(dropped, "dropped").when(F.col("first").isNull() | (F.col("pos") < F.col("first")), "front").when(F.col("pos") >= F.col("back"), "back").otherwise("body")
    return df.withColumn("part", part).select(*rows.columns, "part")


def contents_lines(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows (key, pos, line) with toc: whether the line is one of a typed table of contents."""

    @F.pandas_udf("array<boolean>")
    def found(batch: pd.Series) -> pd.Series:
        def one(some: list[str]) -> list[bool]:
            toc = reader.typed_toc(some)
            return [k in toc for k in range(len(some))]

        return batch.map(lambda x: one(list(x)))

    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    listed = listed.withColumn("t", found(F.transform("l", lambda x: x["line"])))
    return listed.select(key, F.explode(F.arrays_zip("l", "t")).alias("z")).select(key, "z.l.pos", "z.l.line", F.col("z.t").alias("toc"))


def _per_document(rows: DataFrame, key: str) -> DataFrame:
    """Each document's lines in order, and their kinds where rows have any."""
    kind = F.col("kind") if "kind" in rows.columns else F.lit(None).cast("string")
    listed = rows.select(key, F.struct("pos", "line", kind.alias("kind")).alias("r")).groupBy(key).agg(F.array_sort(F.collect_list("r")).alias("r"))
    return listed.select(key, F.transform("r", lambda x: x["line"]).alias("lines"), F.transform("r", lambda x: x["kind"]).alias("kinds"))


def read(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, tree (JSON): each document's lines (key, pos, line, and kind where style or numbering gives it) read into a tree, one array of lines a row."""

    @F.pandas_udf("string")
    def trees(lines: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(reader.read(list(x), list(k)), ensure_ascii=False) for x, k in zip(lines, kinds, strict=True)])

    return _per_document(rows, key).select(key, trees("lines", "kinds").alias("tree"))


def outlines(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, row_no, text: each document's tree as indented lines; rows as read() takes them."""

    @F.pandas_udf("array<string>")
    def outline(lines: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([reader.outline(reader.read(list(x), list(k))) for x, k in zip(lines, kinds, strict=True)])

    return _per_document(rows, key).select(key, F.posexplode(outline("lines", "kinds")).alias("row_no", "text"))


def merged_units(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, unit_no, text, n_lines, kind, depth: lines that belong together, as they are joined before they are classified."""

    @F.pandas_udf("array<struct<text:string,n_lines:int,kind:string,depth:int>>")
    def units(batch: pd.Series) -> pd.Series:
        def one(some: list[str]) -> list[tuple]:
            merged = reader.join([("text", x) for x in some])
            deep = reader.depths(merged)
            return [(u.text, len(u.lines), u.first.kind, deep.get(k, (None, None))[0]) for k, (_, u) in enumerate(merged)]

        return batch.map(lambda x: one(list(x)))

    return _per_document(rows, key).select(key, F.posexplode(units("lines")).alias("unit_no", "u")).select(key, "unit_no", "u.*")


_LEVELS = [("paragraphs", "paragraph"), ("items", "item"), ("sub_items", "item_sub"), ("sub_items2", "item_sub2")]
NODE = "seq int, type string, number long, branch long, number_str string, title string, title_note string, body string, mark string, chapter_no int, article_no int, para_no int, item_no int, sub_no int, sub2_no int"


def flatten(tree: list[dict]) -> Iterator[dict]:
    """A tree's nodes in document order with their places."""
    place = {"chapter_no": 0, "article_no": 0}

    def below(node: dict, level: int, at: dict) -> Iterator[dict]:
        if level < len(_LEVELS):
            key, column = _LEVELS[level][0], ("para_no", "item_no", "sub_no", "sub2_no")[level]
            for k, kid in enumerate(node.get(key) or [], 1):
                here = at | {column: k}
                yield kid | here
                yield from below(kid, level + 1, here)

    def article(node: dict) -> Iterator[dict]:
        place["article_no"] += 1
        yield node | place
        yield from below(node, 0, dict(place))

    for node in tree:
        if node["type"] == "chapter":
            place["chapter_no"] += 1
            yield node | {"chapter_no": place["chapter_no"], "article_no": None}
            yield from ({"type": "preamble", "body": x, "chapter_no": place["chapter_no"]} for x in node.get("preamble", []))
            for a in node["articles"]:
                yield from article(a)
        elif node["type"] == "article":
            yield from article(node)
        else:
            yield {"type": node["type"], "body": node.get("body") or " / ".join(node.get("texts", []))}


def nodes(trees: DataFrame, key: str = "doc_id") -> DataFrame:
    """The nodes of trees (key, tree as JSON), a row each."""
    names = [c.split()[0] for c in NODE.split(", ")]

    @F.pandas_udf(f"array<struct<{','.join(c.replace(' ', ':') for c in NODE.split(', '))}>>")
    def rows(batch: pd.Series) -> pd.Series:
        def one(tree: str) -> list[tuple]:
            return [tuple(k if n == "seq" else x.get(n) for n in names) for k, x in enumerate(flatten(json.loads(tree)))]

        return batch.map(one)

    return trees.select(key, F.explode(rows("tree")).alias("n")).select(key, "n.*")


def assign(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Nodes (key, pos, type) with chapter_no, article_no, para_no, item_no by windows: articles run on through chapters, paragraphs and items begin anew."""
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda kind, *within: F.count_if(F.col("type") == kind).over(Window.partitionBy(key, *within).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    df = rows.withColumn("chapter_no", F.count_if(F.col("type") == "chapter").over(order)).withColumn("article_no", F.count_if(F.col("type") == "article").over(order))
    df = df.withColumn("para_no", count("paragraph", "article_no")).withColumn("item_no", count("item", "article_no", "para_no"))
    return df


def attach_titles(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Nodes (key, pos, type, body): a title goes to the article right behind it (column title); one without is text."""
    order = Window.partitionBy(key).orderBy("pos")
    df = rows.withColumn("after", F.lead("type").over(order)).withColumn("before", F.lag(F.struct("type", "body")).over(order))
    taken = (F.col("type") == "article_title") & (F.col("after") == "article")
    df = df.withColumn("title", F.when((F.col("type") == "article") & (F.col("before.type") == "article_title"), F.col("before.body")))
    return df.filter(~F.coalesce(taken, F.lit(False))).withColumn("type", F.when(F.col("type") == "article_title", "text").otherwise(F.col("type"))).select(*rows.columns, "title")


def marker_depths(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Markers (key, pos, kind, resets) with depth: a stack of kinds, folded with aggregate(); a line that resets closes all."""
    empty = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        at = F.array_position(a["stack"], x["kind"]).cast("int")
        stack = F.when(x["resets"], F.array().cast("array<string>")).when(x["kind"].isNull(), a["stack"]).when(at > 0, F.slice(a["stack"], F.lit(1), at)).otherwise(F.array_append(a["stack"], x["kind"]))
        depth = F.when(x["resets"] | x["kind"].isNull(), F.lit(None).cast("int")).when(at > 0, at - 1).otherwise(F.size(a["stack"]))
        return F.struct(stack.alias("stack"), F.array_append(a["out"], depth).alias("out"))

    folded = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "resets"))).alias("m"))
    folded = folded.withColumn("depth", F.aggregate("m", empty, step, lambda a: a["out"]))
    return folded.select(key, F.explode(F.arrays_zip("m", "depth")).alias("z")).select(key, "z.m.pos", "z.m.kind", "z.depth")


def expand_deleted(articles: DataFrame) -> DataFrame:
    """Articles (number, range_to, body, title, ...): a deleted range of up to 100 more becomes an article each, the title on the first."""
    some = (F.col("range_to") > F.col("number")) & (F.col("range_to") <= F.col("number") + 100) & F.trim("body").rlike(X.DELETED)
    each = F.explode(F.when(some, F.sequence("number", "range_to")).otherwise(F.array("number")))
    out = articles.withColumn("n", each)
    return out.withColumn("title", F.when(F.col("n") == F.col("number"), F.col("title")).otherwise("")).withColumn("number", F.col("n")).drop("n", "range_to")


def dilate(rows: DataFrame, key: str = "doc_id", reach: int = 3) -> DataFrame:
    """rows (key, pos, drawing, figure_like) with figure: drawings, and up to `reach` neighbours on either side while they are figure-like."""
    order = Window.partitionBy(key).orderBy("pos")
    near = F.col("drawing")
    for look in (F.lag, F.lead):
        chain = F.col("figure_like")
        for k in range(1, reach + 1):
            near = near | (chain & F.coalesce(look("drawing", k).over(order), F.lit(False)))
            chain = chain & F.coalesce(look("figure_like", k).over(order), F.lit(False))
    return rows.withColumn("figure", near)


def circled_paragraphs(items: DataFrame, key: list[str]) -> DataFrame:
    """Articles (key) whose items (number, marker, body, paragraph_body, n_paragraphs, figures) are circled sentences 1 to n in place of paragraphs."""
    g = items.groupBy(*key).agg(F.count("*").alias("n"), F.bool_and((F.col("marker") == "maru") & F.col("body").rlike(X.ENDS_SENTENCE)).alias("good"), F.array_sort(F.collect_list("number")).alias("numbers"), F.max("n_paragraphs").alias("p"), F.max(F.trim("paragraph_body")).alias("lead"), F.max("figures").alias("f"))
    return g.select(*key, (F.col("good") & (F.col("n") >= 2) & (F.col("p") == 1) & (F.col("lead") == "") & (F.col("f") == 0) & (F.col("numbers") == F.sequence(F.lit(1).cast("long"), F.col("n")))).alias("as_paragraphs"))


def suspicious(paragraphs: DataFrame, length: int = 100, loose: bool = True) -> DataFrame:
    """Units (body, n_below, n_tables, ...) that may hold items run into the text, with a reason."""
    body = F.coalesce("body", F.lit(""))
    told, empty = T.forecast(body), (F.col("n_below") == 0) & (F.col("n_tables") == 0)
    traces = (F.length(body) >= length) & (F.size(T.split_traces(body)) > 0)
    reason = F.when(told & empty, "予告文があるが下位項目なし").when(told & F.lit(loose), "予告文あり（下位の分割漏れ確認）").when(~told & traces, "長文＋分割痕跡")
    return paragraphs.withColumn("reason", reason).filter("reason is not null")


def renumber(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Articles (key, ord) with the number that their place gives."""
    return rows.withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy("ord")).cast("long"))
