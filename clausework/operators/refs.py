"""References to articles: found, told from those to other laws, checked, and rewritten when articles move."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# How references, names of other rules, and what links references are written.
_NUM, _D = "[0-9０-９]+|[〇一二三四五六七八九十百]+", "[0-9０-９〇一二三四五六七八九十百]+"
REFERENCE = f"第({_NUM})条(?:の({_NUM}))?"
ELSEWHERE = "(?:法律?|令|規則|規程|条例|附則|協定書?|協約|定款|告示|通達|指針|細則|要領|内規|基準|約款|契約書?|同法|同令)$"
LAW_IN_PARENS = "(?:法律?|令|条例|協約|定款|同法|同令)[（(]$"
ITSELF = "(?:この|本|当)(?:就業)?(?:規則|規程)$"
DEAD = "［参照先なし］"
_LINK = "、|，|,|及び|および|又は|または|若しくは|もしくは|並びに|ならびに|から|ないし|乃至|～|〜|・"
CHAIN = f"(?:第{_D}項|第{_D}号|の規定|まで|前段|後段|ただし書|{DEAD}|{_LINK})*(?:{_LINK})(?:第{_D}項|第{_D}号)?"
BELOW = f"第({_D})項(?:第({_D})号)?"
# End of the fixed values.

_RE = {k: re.compile(v) for k, v in {"ref": REFERENCE, "elsewhere": ELSEWHERE, "law": LAW_IN_PARENS, "self": ITSELF, "chain": CHAIN, "below": BELOW}.items()}
_TRIM = [re.compile(p) for p in ("（[^（）]*）$", "\\([^()]*\\)$", "の(?:規定|定め)[（(]$", "[\\s　]+$")]
_KANJI = "〇一二三四五六七八九"
FOUND = "ref_no int, start int, end int, ref string, article long, branch long, external boolean, dead boolean, paragraph long, item long"


def read_number(s: str) -> int:
    if s[0] in "0123456789０１２３４５６７８９":
        return int(s)
    total = digit = 0
    for c in s:
        if c in "百十":
            total, digit = total + (digit or 1) * (100 if c == "百" else 10), 0
        else:
            digit = digit * 10 + _KANJI.index(c)
    return total + digit


def write_number(n: int, like: str) -> str:
    """n in the script of a numeral."""
    if re.fullmatch("[0-9]+", like):
        return str(n)
    if n >= 1000 or re.fullmatch("[０-９]+", like):
        return str(n).translate(str.maketrans("0123456789", "０１２３４５６７８９"))
    out = ""
    for unit, sign in ((100, "百"), (10, "十")):
        d, n = divmod(n, unit)
        out += (_KANJI[d] if d > 1 else "") + sign if d else ""
    return out + (_KANJI[n] if n else "")


def name_before(text: str) -> str:
    """What stands before a reference, less brackets behind the name."""
    b = text.rstrip()
    for _ in range(5):
        old = b
        for p in _TRIM:
            b = p.sub("", b)
        if _RE["law"].search(b):
            b = b[:-1]
        if b == old:
            break
    return b


def scan(text: str) -> list[tuple]:
    """The references of a text in order, as FOUND says; one that only links part from the one before it is external as that is."""
    out, end, external = [], None, False
    for k, m in enumerate(_RE["ref"].finditer(text)):
        if end is None or not _RE["chain"].fullmatch(text[end : m.start()]):
            name = name_before(text[: m.start()])
            external = bool(_RE["elsewhere"].search(name)) and not _RE["self"].search(name)
        end = m.end()
        below = _RE["below"].match(text, end)
        out.append((k, m.start(), end, m[0], read_number(m[1]), read_number(m[2]) if m[2] else 0, external, text.startswith(DEAD, end), read_number(below[1]) if below else None, read_number(below[2]) if below and below[2] else None))
    return out


def find(rows: DataFrame, text: str = "body") -> DataFrame:
    """rows with a row for each reference in the text."""

    @F.pandas_udf(f"array<struct<{','.join(':'.join(c.split()) for c in FOUND.split(', '))}>>")
    def refs(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: scan(t or ""))

    return rows.withColumn("r", F.explode(refs(text))).select(*rows.columns, "r.*")


def find_plain(rows: DataFrame, text: str = "body") -> DataFrame:
    """rows with ref, article and branch of each reference, wherever it leads, without Python."""
    each = F.explode(F.regexp_extract_all(text, F.lit(f"({REFERENCE})"), 1))
    out = rows.withColumn("ref", each)
    branch = F.regexp_extract("ref", REFERENCE, 2)
    return out.withColumn("article", T.number(F.regexp_extract("ref", REFERENCE, 1))).withColumn("branch", F.when(branch == "", 0).otherwise(T.number(branch)).cast("long"))


def keys(articles: DataFrame, key: str = "doc_id", original: bool = True) -> DataFrame:
    """key, article, branch, rid: which article (rid) a number names; of several with one number the first (by ord)."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("ord")).cast("long")
    own = F.lit(original) & (F.col("number") > 0)
    rows = articles.withColumn("place", place).select(key, "ord", "rid", F.when(own, F.col("number")).otherwise(F.col("place")).alias("article"), F.when(own, F.col("branch")).otherwise(0).cast("long").alias("branch"))
    first = Window.partitionBy(key, "article", "branch").orderBy("ord")
    return rows.withColumn("k", F.row_number().over(first)).filter("k = 1").select(key, "article", "branch", "rid")


def check(found: DataFrame, targets: DataFrame, key: str = "doc_id") -> DataFrame:
    """References (find()) that lead nowhere: kind dead, para or item. targets: key, article, branch, n_paragraphs, items (array of the number of items of each paragraph)."""
    inside = found.filter("not external")
    dead = inside.filter("dead").withColumn("kind", F.lit("dead"))
    deep = inside.filter("not dead and paragraph is not null").join(targets, [key, "article", "branch"])
    n_items = F.when(F.col("paragraph") <= F.size("items"), F.get("items", (F.col("paragraph") - 1).cast("int")))
    kind = F.when(F.col("paragraph") > F.col("n_paragraphs"), "para").when(F.col("item") > n_items, "item")
    return dead.unionByName(deep.withColumn("kind", kind).filter("kind is not null").select(*dead.columns))


def rewrite(rows: DataFrame, before: DataFrame, after: DataFrame, key: str = "doc_id", text: str = "body") -> DataFrame:
    """rows with `rewritten`: references get the numbers of their articles in `after` (key, rid, number); what has none is marked DEAD, and counted in `missing`.

    before: keys() of the tree in whose numbers the text is written. Each reference is a row, and two equi-joins give it its article and
    the article's new number; a text gets only its own references back.
    """
    name = F.md5(text)
    found = find(rows.filter(F.col(text).contains("条")).select(key, text, name.alias("of_text")), text).filter("not external and not dead")
    to = found.select(key, "of_text", "start", "end", "ref", "article", "branch").distinct().join(before.select(key, "article", "branch", "rid"), [key, "article", "branch"], "left").join(after.select(key, "rid", F.col("number").alias("new")), [key, "rid"], "left")
    there = F.coalesce(F.col("new") > 0, F.lit(False))
    put = F.when(there, F.concat(F.lit("第"), T.same_script(F.col("new"), F.regexp_extract("ref", REFERENCE, 1)), F.lit("条"))).otherwise(F.concat("ref", F.lit(DEAD)))
    own = to.select(key, "of_text", F.struct("start", "end", put.alias("put"), F.when(~there, F.col("ref")).alias("missing")).alias("r")).groupBy(key, "of_text").agg(F.array_sort(F.collect_list("r")).alias("refs"))
    out = rows.withColumn("of_text", name).join(own, [key, "of_text"], "left")
    kept = lambda done, r: F.concat(done["out"], F.substring(F.col(text), done["at"] + 1, r["start"] - done["at"]), r["put"])
    whole = F.aggregate("refs", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), lambda done, r: F.struct(kept(done, r).alias("out"), r["end"].alias("at")), lambda done: F.concat(done["out"], F.substring(F.col(text), done["at"] + 1, F.length(text))))
    missing = F.coalesce(F.filter(F.transform("refs", lambda r: r["missing"]), lambda x: x.isNotNull()), F.array().cast("array<string>"))
    return out.select(*rows.columns, F.coalesce(whole, F.col(text)).alias("rewritten"), missing.alias("missing"))
