"""Line features, numerals, markers and normalisers as Spark columns: everything that one line says by itself."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as X

WIDE, NARROW = "０１２３４５６７８９", "0123456789"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row, however often it is used; Catalyst would write it out at each place."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def groups(s: Column, pattern: str, n: int) -> Column:
    """The first n groups of a pattern that matches all of s, by one match; a group that takes no part is empty."""
    return F.split(F.regexp_replace(s, pattern, "\x01".join(f"${k}" for k in range(1, n + 1))), "\x01", n)


def strip_left(c: Column) -> Column:
    return F.regexp_replace(c, "^[　 \\t]+", "")


def strip_right(c: Column) -> Column:
    return F.regexp_replace(c, "[　 \\t]+$", "")


def narrow(c: Column) -> Column:
    """Digits of half width."""
    return F.translate(c, WIDE, NARROW)


def wide(c: Column) -> Column:
    return F.translate(c.cast("string"), NARROW, WIDE)


def indent_width(c: Column) -> Column:
    """Width of the leading blanks: 2 for a full-width one, 1 for a space, 4 for a tab."""
    lead = F.regexp_extract(c, "^[　 \\t]*", 0)
    return F.length(lead) + F.length(F.regexp_replace(lead, "[^　]", "")) + 3 * F.length(F.regexp_replace(lead, "[^\\t]", ""))


def last_char(c: Column) -> Column:
    return F.right(strip_right(c), F.lit(1))


def kanji_number(c: Column) -> Column:
    """Kanji numerals, by place with 〇 and no unit, else by units; what can't be read counts nothing."""
    place = c.rlike(f"^[{X.KANJI_DIGITS}]+$") & c.contains("〇")
    by_place = F.translate(c, X.KANJI_DIGITS, NARROW).cast("long")
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("digit"))

    def step(a: Column, ch: Column) -> Column:
        digit = F.instr(F.lit(X.KANJI_DIGITS), ch).cast("long") - 1
        unit = F.when(ch == "十", 10).when(ch == "百", 100).when(ch == "千", 1000).cast("long")
        man = a["part"] + a["digit"]
        return (
            F.when((ch != "") & (digit >= 0), F.struct(a["total"].alias("total"), a["part"].alias("part"), digit.alias("digit")))
            .when(unit.isNotNull(), F.struct(a["total"].alias("total"), (a["part"] + F.greatest(a["digit"], F.lit(1)) * unit).alias("part"), F.lit(0).cast("long").alias("digit")))
            .when(ch == "万", F.struct((a["total"] + F.when(man == 0, 1).otherwise(man) * 10_000).alias("total"), F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("digit")))
            .otherwise(a)
        )

    by_unit = F.aggregate(F.split(c, ""), zero, step, lambda a: a["total"] + a["part"] + a["digit"])
    return F.when(place, by_place).otherwise(by_unit)


def number(c: Column) -> Column:
    """Digits of either width, else kanji numerals, else 1."""
    return let(narrow(c), lambda d: F.when(d.rlike("^[0-9]+$"), d.cast("long")).otherwise(F.coalesce(F.nullif(let(d, kanji_number), F.lit(0)), F.lit(1))))


def kana_number(c: Column) -> Column:
    """Place of a kana in the order of あいうえお, else of いろは, else 0."""
    return F.coalesce(F.nullif(F.instr(F.lit(X.GOJUON_SHORT), c), F.lit(0)), F.instr(F.lit(X.IROHA), c)).cast("long")


def roman_number(c: Column) -> Column:
    pairs = [("iv", 4), ("ix", 9)]
    count = lambda ch: F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))
    cut = sum((F.when(c.contains(p), 2).otherwise(0) for p, _ in pairs), F.lit(0))
    return (count("i") + 5 * count("v") + 10 * count("x") - cut).cast("long")


def circled_number(c: Column) -> Column:
    return F.instr(F.lit("".join(X.CIRCLED)), c).cast("long")


def marker(line: Column) -> Column:
    """struct(kind, number, body) of a line's marker; kind is null without one. The first kind that fits is taken."""
    read = {
        "digits": lambda m: narrow(m).cast("long"), "kanji": kanji_number, "circled": circled_number, "kana": kana_number, "roman": roman_number,
        "boxed": lambda m: (F.ascii(m) - 0x2473).cast("long"), "latin": lambda m: (F.ascii(m) - 96).cast("long"),
    }

    def told(s: Column) -> Column:
        out = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(0).cast("long").alias("number"), s.alias("body"))
        for kind, pattern, how in reversed(X.MARKERS):
            body = F.trim(F.regexp_extract(s, pattern, 2)).alias("body")
            fits = let(F.regexp_extract(s, pattern, 1), partial(lambda kind, how, body, m: F.struct(F.lit(kind).alias("kind"), read[how](m).alias("number"), body), kind, how, body))
            out = F.when(s.rlike(pattern), fits).otherwise(out)
        return out

    return let(strip_left(line), told)


def article_title(rest: Column) -> Column:
    """struct(title, body) of what stands behind an article's number."""

    def told(r: Column) -> Column:
        out = F.struct(F.lit("").alias("title"), F.regexp_replace(r, f"^[：:]{X.WS}*", "").alias("body"))
        for p in (X.TITLE_AFTER_COLON, X.TITLE_IN_BRACKETS, X.TITLE_IN_PARENS):
            out = F.when(r.rlike(p), F.struct(F.trim(F.regexp_extract(r, p, 1)).alias("title"), F.trim(F.regexp_extract(r, p, 2)).alias("body"))).otherwise(out)
        return out

    return let(rest, told)


def without_first_number(body: Column) -> Column:
    """A body without the number of a first paragraph; a quantity stays."""
    rest = F.regexp_replace(body, X.FIRST_PARAGRAPH, "")
    quantity = (F.regexp_extract(body, X.FIRST_PARAGRAPH, 2) == " ") & rest.rlike(X.QUANTITY)
    return F.when(body.rlike(X.FIRST_PARAGRAPH) & ~quantity, rest).otherwise(body)


def article(line: Column) -> Column:
    """struct(number, branch, range_to, number_str, title, body) of an article's heading; null if the line is none."""

    def told(s: Column) -> Column:
        def parts(g: Column) -> Column:
            at = lambda k: F.nullif(F.get(g, k - 1), F.lit(""))
            n, rest = number(at(1)), F.coalesce(at(7), F.lit(""))
            following = let(number(at(6)), lambda x: F.when(x == n + 1, x))
            to = F.when(at(6).isNotNull(), following).otherwise(F.when(F.coalesce(at(4), at(5)).isNotNull(), number(F.coalesce(at(4), at(5)))))
            label = F.regexp_replace(F.left(s, F.length(s) - F.length(rest)), X.WS, "")
            branch = F.when(at(2).isNotNull(), number(at(2))).otherwise(F.lit(0).cast("long"))
            return let(article_title(F.trim(rest)), lambda t: F.struct(n.alias("number"), branch.alias("branch"), to.alias("range_to"), label.alias("number_str"), t["title"].alias("title"), without_first_number(t["body"]).alias("body")))

        return F.when(s.rlike(X.ARTICLE), let(groups(s, X.ARTICLE, 7), parts))

    return let(strip_left(line), told)


def chapter(line: Column) -> Column:
    """struct(number, title) of a chapter's heading; null if the line is none."""
    s = strip_left(line)
    return F.when(s.rlike(X.CHAPTER), F.struct(number(F.regexp_extract(s, X.CHAPTER, 1)).alias("number"), F.trim(F.regexp_extract(s, X.CHAPTER, 2)).alias("title")))


def paragraph(line: Column) -> Column:
    """struct(number, body, dot) of a paragraph from the second on; null if the line is none."""
    body = F.regexp_extract(line, X.PARAGRAPH, 4)
    deep = (F.trim(body) == "") & (F.length(line) - F.length(strip_left(line)) > 2)
    return F.when(line.rlike(X.PARAGRAPH) & ~deep, F.struct(number(F.regexp_extract(line, X.PARAGRAPH, 1)).alias("number"), F.trim(body).alias("body"), (F.regexp_extract(line, X.PARAGRAPH, 2) != "").alias("dot")))


def kind(line: Column) -> Column:
    """What a line is by itself: chapter, section, article, loose_article, note, title, paragraph, item or text."""
    s = strip_left(line)
    return (
        F.when(s == "", "blank").when(s.rlike(X.CHAPTER), "chapter").when(s.rlike(X.SECTION), "section")
        .when(s.rlike(X.TITLE) & F.regexp_extract(s, X.TITLE, 1).rlike(X.NOTE), "note").when(s.rlike(X.TITLE), "title")
        .when(s.rlike(X.ARTICLE), "article").when(s.rlike(X.LOOSE_ARTICLE) | s.rlike(X.LOOSE_NO_SPACE), "loose_article")
        .when(paragraph(line).isNotNull(), "paragraph").when(marker(line)["kind"].isNotNull(), "item").otherwise("text")
    )


def connective(line: Column) -> Column:
    """Whether a line, less commas at its end, ends with a particle or connective."""
    return F.regexp_replace(strip_right(line), "[、，]+$", "").rlike(f"(?:[{X.PARTICLES}]|{'|'.join(X.MID_WORDS)})$")


def mid_sentence(line: Column, nouns: bool = True) -> Column:
    """Whether a line breaks off inside a sentence; nouns: also at a kanji, unless it is an item."""
    s = strip_left(line)
    marked = s.rlike(X.MARK_HEAD) | marker(line)["kind"].isNotNull()
    open_end = last_char(line).rlike(f"[、，×＋{X.PARTICLES}]") | connective(line)
    return open_end | (last_char(line).rlike("[一-龯々]") & ~marked) if nouns else open_end


def forecast(line: Column) -> Column:
    return line.rlike(X.FORECAST)


def split_traces(body: Column) -> Column:
    """Names of the traces of items that were run into a text; its first two characters don't count."""
    inner = F.when(F.length(body) > 2, F.substring(body, 3, 1 << 30)).otherwise(body)
    return F.array_compact(F.array(*(F.when(F.regexp_count(inner, F.lit(p)) >= n, F.lit(name)) for name, p, n in X.SPLIT_TRACES)))


def stop_word(line: Column) -> Column:
    """Length of the stop word that a line begins with; 0 without one."""
    return F.length(F.regexp_extract(F.trim(line), "^(?:" + "|".join(f"{X.WS}*".join(w) for w in X.STOP_WORDS) + ")", 0))


def lead_mark(line: Column, body: Column) -> Column:
    """The sign before a body in its line, up to 12 characters."""
    full, b = F.trim(line), F.trim(body)
    rest = F.length(full) - F.length(b)
    at = F.instr(full, F.substring(b, 1, 12)) - 1
    found = F.when(full.endswith(b) & (rest > 0) & (rest <= 12), F.left(full, rest)).when((at > 0) & (at <= 12), F.left(full, at)).otherwise("")
    return F.when((full == "") | (b == ""), "").otherwise(found)


def compared(c: Column) -> Column:
    """A text without blanks and light punctuation."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), f"(?:{X.WS}|[・･,，.．、。])", "")


def reference_norm(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, X.WS, ""), "｢｣", "「」")


def without_head_label(c: Column) -> Column:
    n = "[0-9〇一二三四五六七八九十百千]+"
    return F.regexp_replace(c, f"^第{n}[章条節](?:の{n})*", "")


def width_counts(c: Column) -> Column:
    """struct(half, full, mixed): runs of digits of either width."""
    half, full = F.regexp_count(c, F.lit("[0-9]+")), F.regexp_count(c, F.lit("[０-９]+"))
    return F.struct(half.alias("half"), full.alias("full"), ((half > 0) & (full > 0)).alias("mixed"))


def kanji_numeral(n: Column) -> Column:
    """Kanji numeral of 1 to 999."""
    digit = lambda d, one: F.when(d > one, F.substring(F.lit(X.KANJI_DIGITS), (d + 1).cast("int"), F.lit(1))).otherwise("")
    h, t, o = F.floor(n / 100), F.floor(n % 100 / 10), n % 10
    return F.concat(F.when(h > 0, F.concat(digit(h, 1), F.lit("百"))).otherwise(""), F.when(t > 0, F.concat(digit(t, 1), F.lit("十"))).otherwise(""), digit(o, 0))


def format_number(fmt: str, n: Column) -> Column:
    """A number in one of the styles in which levels are numbered; beyond a style's range, digits."""
    plain, tables = n.cast("string"), {
        "decimalEnclosedCircle": X.CIRCLED, "aiueoFullWidth": list(X.GOJUON), "iroha": list(X.IROHA), "aiueo": list(X.HALF_KANA),
        "lowerLetter": [chr(97 + i) for i in range(26)], "upperLetter": [chr(65 + i) for i in range(26)],
        "lowerRoman": ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x"], "upperRoman": ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"],
    }
    if fmt == "none":
        return F.lit("")
    if fmt == "decimalFullWidth":
        return wide(n)
    if fmt == "kanji":
        return F.when((n > 0) & (n < 100), kanji_numeral(n)).otherwise(plain)
    if fmt in tables:
        return F.when((n > 0) & (n <= len(tables[fmt])), F.get(F.array(*map(F.lit, tables[fmt])), (n - 1).cast("int"))).otherwise(plain)
    return plain


def same_script(n: Column, like: Column) -> Column:
    """A number in the script of another: half-width, full-width or kanji."""
    return F.when(like.rlike("^[0-9]+$"), n.cast("string")).when(like.rlike("^[０-９]+$") | (n >= 1000), wide(n)).otherwise(kanji_numeral(n))


def input_tokens(c: Column) -> Column:
    """Rough number of tokens that a model takes a text for."""
    ascii_ = F.length(F.regexp_replace(c, "[^\\x00-\\x7F]", ""))
    return (((ascii_ / 3 + (F.length(c) - ascii_) * 1.1 + 5600) * 2.5).cast("long") + 1)


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, '[\\\\/:*?"<>|\\x00-\\x1f]', "_")


def line_features(line: Column) -> Column:
    """All that a line says by itself, as one struct."""
    s = strip_left(line)
    return F.struct(
        s.alias("s"), indent_width(line).alias("indent"), last_char(line).alias("last"), kind(line).alias("kind"), chapter(line).alias("chapter"), article(line).alias("article"),
        paragraph(line).alias("paragraph"), marker(line).alias("marker"), s.rlike(X.DECIMAL).alias("decimal"), s.rlike(X.PAREN_ONLY).alias("in_parens"), mid_sentence(line).alias("mid_sentence"),
        forecast(line).alias("forecast"), s.rlike(X.PAGE_NUMBER).alias("page_number"), s.rlike(X.APPENDIX).alias("appendix"), (stop_word(line) > 0).alias("stop_word"),
    )
