"""Settings of a template of one's own: checked, read from numbering, and found in how a document uses styles."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .emit import STYLES

# What settings may be.
VERSION = 1
BASES, LAYOUTS, ALIGNS, SEPARATORS = ("t1", "t2", "t3", "t4"), ("inline", "separate"), ("left", "center"), ("zen", "space", "tab", "none")
FORMATS = ("decimalFullWidth", "decimal", "japaneseCounting", "decimalEnclosedCircle", "aiueoFullWidth", "irohaFullWidth", "none")
LEVELS = ("chapter", "article", "para1", "paraN", "item", "sub", "sub_single", "sub2")
RANGES = {"size": (6, 36), "line": (6, 72), "table_size": (6, 36), "first": (0, 30), "left": (0, 30), "before": (0, 72), "after": (0, 72)}
TEXTS = {"font": 40, "pre": 8, "suf": 8}
CHOICES = {"base": BASES, "layout": LAYOUTS, "fmt": FORMATS, "sep": SEPARATORS, "align": ALIGNS}
# End of the fixed values.

_TOP = ("base", "layout", "font", "size", "line", "table_size")
_LEVEL = ("fmt", "pre", "suf", "sep", "first", "left", "size", "bold", "font", "align", "before", "after")


def _checked(name: str, v: object, path: str, needed: bool = False) -> object:
    if name in RANGES:
        low, high = RANGES[name]
        if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v) or not low <= v <= high:
            raise ValueError(f"{path} must be a number from {low} to {high}")
        return round(float(v), 2)
    if name in TEXTS:
        if not isinstance(v, str) or len(v.strip()) > TEXTS[name] or re.search("[\\x00-\\x1f\\x7f]", v.strip()) or (needed and not v.strip()):
            raise ValueError(f"{path} must be a text of up to {TEXTS[name]} characters")
        return v.strip()
    if name in CHOICES:
        if v not in CHOICES[name]:
            raise ValueError(f"{path} must be one of {', '.join(CHOICES[name])}")
        return v
    if not isinstance(v, bool):
        raise ValueError(f"{path} must be true or false")
    return v


def normalized(settings: object) -> dict:
    """Settings with all values in range; a ValueError names the first that isn't. Older settings without sub_single get it from sub."""
    if not isinstance(settings, dict) or isinstance(settings.get("version"), bool) or settings.get("version") != VERSION:
        raise ValueError(f"version must be {VERSION}")
    if missing := [k for k in (*_TOP, "levels") if k not in settings]:
        raise ValueError(f"{missing[0]} is missing")
    out = {"version": VERSION} | {k: _checked(k, settings[k], k, needed=True) for k in _TOP}
    levels = settings["levels"]
    if isinstance(levels, dict) and isinstance(levels.get("sub"), dict):
        levels = {"sub_single": levels["sub"] | {"fmt": "none", "pre": "", "suf": ""}} | levels
    out["levels"] = {}
    for level in LEVELS:
        given = levels.get(level) if isinstance(levels, dict) else None
        if not isinstance(given, dict) or (missing := [k for k in _LEVEL if k not in given]):
            raise ValueError(f"levels.{level}" + (f".{missing[0]}" if isinstance(given, dict) else "") + " is missing")
        out["levels"][level] = {k: _checked(k, given[k], f"levels.{level}.{k}") for k in _LEVEL}
        if "%" in out["levels"][level]["pre"] + out["levels"][level]["suf"]:
            raise ValueError(f"levels.{level} may not have % around its number")
    return out


def numbering(fmt: str | None, text: str, ilvl: int | None, behind: str = "tab", symbol: bool = False) -> tuple[dict | None, str | None]:
    """A numbering level as {fmt, pre, suf, sep}, or why it can't be one. fmt None: the paragraph has no number. symbol: only a sign is wanted."""
    if fmt is None:
        return ({"fmt": "none", "pre": "", "suf": ""} if symbol else {"fmt": "none"}), None
    wide = text.endswith("　")
    text = text.removesuffix("　")
    out = {"sep": "zen" if wide else behind if behind in ("tab", "space") else "none"}
    places, rest = re.findall("%(\\d)", text), re.sub("%\\d", "", text)
    if symbol:
        return (None, "a number where only a sign may be") if fmt != "none" and places else (out | {"fmt": "none", "pre": rest, "suf": ""}, None)
    if fmt == "none":
        return (None, "a sign without a number") if rest else (out | {"fmt": "none"}, None)
    if fmt not in FORMATS:
        return None, "an unknown format"
    if ilvl is None or places != [str(ilvl + 1)]:
        return None, "the number of a level above"
    pre, suf = text.split(f"%{places[0]}")
    return (None, "too long a text around the number") if max(len(pre), len(suf)) > TEXTS["pre"] else (out | {"fmt": fmt, "pre": pre, "suf": suf}, None)


def most_common(rows: DataFrame, key: list[str], value: str, ord: str = "pos") -> DataFrame:
    """The most frequent value of each key, of equals the one that comes first; nulls don't count."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("n"), F.min(ord).alias("first"))
    best = Window.partitionBy(*key).orderBy(F.desc("n"), "first")
    return counts.withColumn("k", F.row_number().over(best)).filter("k = 1").select(*key, value)


def detect_template(paragraphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, template of documents whose paragraphs (key, style, text) use a template's styles most; without its chapters and headings, none. t3 is t2 with set-in paragraphs."""
    known = [(t, s, k < 2, k in (2, 3)) for t, styles in STYLES.items() if t != "t3" for s in dict.fromkeys(styles) for k in [styles.index(s)]]
    table = paragraphs.sparkSession.createDataFrame(known, "template string, style string, heading boolean, body boolean")
    set_in = F.col("body") & F.col("text").startswith("　")
    used = paragraphs.join(F.broadcast(table), "style").groupBy(key, "template").agg(F.count("*").alias("n"), F.count_if("heading").alias("heads"), F.count_if(set_in).alias("set_in"), F.count_if(F.col("body") & (F.col("text") != "")).alias("bodies"))  # a table of some twenty styles
    best = used.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "template"))).filter("k = 1 and heads > 0")
    return best.select(key, F.when((F.col("template") == "t2") & (F.col("set_in") * 2 > F.col("bodies")), "t3").otherwise(F.col("template")).alias("template"))
