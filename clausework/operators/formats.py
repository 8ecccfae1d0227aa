"""The format in which a paragraph or a run is shown: what it says itself, its numbering level, its chain of styles, the document's defaults.

Attributes are rows; those that decide together are one family, and a layer that has any of a family's attributes settles all of
them. Style chains of all documents are resolved at once by pointer doubling: after k joins each style has what its nearest
2**k ancestors say, so a chain of any depth takes a logarithm of joins, and a circle of styles ends like one that has nothing to say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

# Tags and attributes of office documents.
PARAGRAPH = {
    "align": ("jc", ("val",)),
    "before": ("spacing", ("before", "beforeLines")),
    "after": ("spacing", ("after", "afterLines")),
    "line": ("spacing", ("line", "lineRule")),
    "left": ("ind", ("left", "start", "leftChars", "startChars")),
    "first": ("ind", ("firstLine", "hanging", "firstLineChars", "hangingChars")),
}
NUMBER = {"num": ("numId", ("val",)), "ilvl": ("ilvl", ("val",))}
RUN = {"size": ("sz", ("val",)), "bold": ("b", ("val",)), "east": ("rFonts", ("eastAsia", "eastAsiaTheme")), "latin": ("rFonts", ("ascii",))}
OFF = ("0", "false", "off")
PITCH, ALIGN = 360, "both"
# End of the fixed values.
FAMILIES = PARAGRAPH | NUMBER | RUN


def families(attributes: DataFrame, keys: list[str], names: dict[str, tuple[str, tuple[str, ...]]] = FAMILIES) -> DataFrame:
    """One row for each of keys in attributes (keys, tag, attr, value): a struct of texts for each family, null where none of its attributes is given. A bare switch has the value 1."""
    one = lambda tag, attr: F.max(F.when((F.col("tag") == tag) & (F.col("attr") == attr), F.col("value")))
    wide = attributes.groupBy(*keys).agg(*(one(tag, a).alias(f"{name}_{a}") for name, (tag, attrs) in names.items() for a in attrs))
    given = lambda name, attrs: F.when(F.coalesce(*(F.col(f"{name}_{a}") for a in attrs)).isNotNull(), F.struct(*(F.col(f"{name}_{a}").alias(a) for a in attrs)))
    return wide.select(*keys, *(given(name, attrs).alias(name) for name, (_, attrs) in names.items()))


def inherited(nodes: DataFrame, values: list[str], key: str = "doc_id", node: str = "style", parent: str = "based_on") -> DataFrame:
    """nodes (key, node, parent, values), whose ids are unique within key, with each null value filled from the nearest ancestor that has one."""
    state = written(nodes.select(key, node, F.col(parent).alias("up"), *values), "inherited")
    most = state.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    for _ in range(max(0, most - 1).bit_length()):
        above = state.select(F.col(key).alias("of"), F.col(node).alias("is"), F.col("up").alias("next"), *(F.col(v).alias(f"above_{v}") for v in values))
        joined = state.join(above, (F.col(key) == F.col("of")) & (F.col("up") == F.col("is")), "left")
        filled = {v: F.coalesce(v, f"above_{v}") for v in values}
        open_ = F.lit(False)
        for c in filled.values():
            open_ |= c.isNull()
        state = written(joined.select(key, node, F.when(open_, F.col("next")).alias("up"), *(c.alias(v) for v, c in filled.items())), "inherited")
        if state.filter("up IS NOT NULL").isEmpty():
            break
    return state.drop("up")


def _number(c: Column) -> Column:
    """The whole number that a text is; null for anything else."""
    return F.when(c.rlike("^[+-]?[0-9]{1,9}$"), c.cast("int"))


def _points(family: Column, which: str, pitch: Column) -> Column:
    lines, twips = _number(family[f"{which}Lines"]), _number(family[which])
    return F.when(lines != 0, lines / 100 * pitch / 20).otherwise(twips / 20)


def _chars(family: Column, in_chars: tuple[str, ...], in_twips: tuple[str, ...], unit: Column) -> Column:
    """Characters: hundredths where they are given and aren't 0, else twips over a character's width."""
    hundredths = (F.when(_number(family[a]) != 0, _number(family[a]) / 100) for a in in_chars)
    return F.coalesce(*hundredths, *(_number(family[a]) / unit for a in in_twips))


def paragraph_formats(paragraphs: DataFrame, styles: DataFrame, levels: DataFrame, defaults: DataFrame, unit: Column | None = None, key: str = "doc_id") -> DataFrame:
    """key, pos, align, before, after, line (points), first, left (characters) of each paragraph.

    paragraphs: key, pos, style and the families of PARAGRAPH and NUMBER it gives itself. styles: key, style and families, as
    inherited() resolves them. levels: key, num, level and PARAGRAPH. defaults: key, default_style, pitch (twips) and PARAGRAPH.
    A number that the paragraph gives itself sets its level's indents before the style's, one from the style after it. unit: twips of a character, 210 unless given.
    """
    unit = F.lit(210) if unit is None else unit
    as_ = lambda df, prefix, keys: df.select(*keys, *(F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c not in keys))
    rows = as_(paragraphs, "own", [key, "pos", "style"]).join(as_(defaults, "all", [key]), key, "left")
    rows = rows.withColumn("with_style", F.coalesce("style", "all_default_style")).join(as_(styles.withColumnRenamed("style", "with_style"), "style", [key, "with_style"]), [key, "with_style"], "left")
    direct, styled = F.col("own_num.val"), F.col("style").isNotNull()
    level = F.coalesce(F.when(styled, _number(F.col("style_ilvl.val"))), F.lit(0))
    rows = rows.withColumns({"direct": direct.isNotNull(), "num": F.nullif(F.coalesce(direct, F.when(styled, F.col("style_num.val"))), F.lit("0")), "level": F.when(direct.isNotNull(), F.coalesce(_number(F.col("own_ilvl.val")), level)).otherwise(level)})
    rows = rows.join(as_(levels, "level", [key, "num", "level"]), [key, "num", "level"], "left")
    layer = lambda f: F.coalesce(f"own_{f}", F.when(F.col("direct"), F.col(f"level_{f}")), f"style_{f}", f"level_{f}", f"all_{f}")
    f = rows.select(key, "pos", F.coalesce("all_pitch", F.lit(PITCH)).alias("pitch"), unit.alias("unit"), *(layer(x).alias(x) for x in PARAGRAPH))
    start = F.coalesce(_chars(F.col("left"), ("leftChars", "startChars"), ("left", "start"), F.col("unit")), F.lit(0.0))
    hang = _chars(F.col("first"), ("hangingChars",), ("hanging",), F.col("unit"))
    more = F.coalesce(_chars(F.col("first"), ("firstLineChars",), ("firstLine",), F.col("unit")), F.lit(0.0))
    line = F.when(F.col("line.lineRule").isin("exact", "atLeast"), _number(F.col("line.line")) / 20)
    return f.select(key, "pos", F.coalesce("align.val", F.lit(ALIGN)).alias("align"), _points(F.col("before"), "before", F.col("pitch")).alias("before"), _points(F.col("after"), "after", F.col("pitch")).alias("after"), line.alias("line"), F.when(F.coalesce(hang, F.lit(0.0)) != 0, start - hang).otherwise(start + more).alias("first"), start.alias("left"))


def run_formats(paragraphs: DataFrame, runs: DataFrame, styles: DataFrame, defaults: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pos, font, size (points), bold that most characters of a paragraph have; of equals, what comes first.

    paragraphs: key, pos, style. runs: key, pos, run (order), n (characters), run_style and RUN. styles, defaults: RUN. A paragraph without characters is as its style says. A theme's font has no name.
    """
    as_ = lambda df, prefix, keys: df.select(*keys, *(F.col(c).alias(f"{prefix}_{c}") for c in RUN))
    rows = paragraphs.select(key, "pos", "style").join(defaults.select(key, "default_style", *(F.col(c).alias(f"all_{c}") for c in RUN)), key, "left").withColumn("with_style", F.coalesce("style", "default_style"))
    rows = rows.join(as_(styles.withColumnRenamed("style", "with_style"), "style", [key, "with_style"]), [key, "with_style"], "left")
    rows = rows.join(as_(runs.filter("n > 0"), "own", [key, "pos", "run", "n", "run_style"]), [key, "pos"], "left")
    rows = rows.join(as_(styles.withColumnRenamed("style", "run_style"), "char", [key, "run_style"]), [key, "run_style"], "left")
    layer = lambda f: F.coalesce(f"own_{f}", f"char_{f}", f"style_{f}", f"all_{f}")
    rows = rows.select(key, "pos", F.coalesce("run", F.lit(0)).alias("run"), F.coalesce("n", F.lit(1)).alias("n"), *(layer(f).alias(f) for f in RUN))
    font = F.when(F.col("east").isNull(), F.col("latin.ascii")).when(F.col("east.eastAsiaTheme").isNull(), F.col("east.eastAsia"))
    size, bold = _number(F.col("size.val")), F.col("bold").isNotNull() & ~F.coalesce(F.col("bold.val").isin(*OFF), F.lit(False))
    said = F.array(F.struct(F.lit("font").alias("what"), F.nullif(font, F.lit("")).alias("value")), F.struct(F.lit("size").alias("what"), F.nullif(size, F.lit(0)).cast("string").alias("value")), F.struct(F.lit("bold").alias("what"), bold.cast("string").alias("value")))
    each = rows.select(key, "pos", "run", "n", F.explode(said).alias("s")).groupBy(key, "pos", "s.what", "s.value").agg(F.sum("n").alias("n"), F.min("run").alias("first"))
    top = lambda what: F.max_by(F.when(F.col("what") == what, F.col("value")), F.when((F.col("what") == what) & F.col("value").isNotNull(), F.struct("n", -F.col("first"))))
    return each.groupBy(key, "pos").agg(top("font").alias("font"), (top("size").cast("int") / 2).alias("size"), top("bold").cast("boolean").alias("bold"))
