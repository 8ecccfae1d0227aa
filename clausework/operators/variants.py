"""Spellings that compete, and words that are misused."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as X
from ..sources.shared import written

# Character classes and endings that decide whether a word is a noun.
KANJI, HIRA, KATA = "一-鿿々", "ぁ-ゖ", "ァ-ヶー"
MIDDLE, TAIL, OPTIONAL_TAIL = "りしちきいみびぎじえけめげ", "いりけめげえきしちみびぎじ", "いりけめげえき"
VERB, ROW, AFTER_ROW, NEGATIVE = "うわっえおるれらろよくぐすつぬぶむずたて", "いりきぎしちみびじえけげめせね", "またてだでしょ", "いかけっ"
CONTEXT = {"且つ": ("(?:な|かつ)$", "^(?:かつ|つ)"), "かつ": ("(?:な|かつ)$", "^(?:かつ|つ)"), "尚": (None, "^(?:かつ|さら|す|し|る)"), "なお": (None, "^(?:かつ|さら|す|し|る)")} | {f: (None, "^(?:規程|規則|台帳|支払明細)") for f in ("賃金", "給与", "給料")}
MISUSES = [
    ("kitei_verb", "規程(?=する|しな|して|した|され|すべき|せず)", "規程", "規定", "sure", None),
    ("kitei_ref", "(?:前項|前条|同項|同条|本条|本項|次項|次条|前各号|各号|第[0-9０-９一二三四五六七八九十百]+[条項号])(?:の|に)規程", "規程", "規定", "sure", None),
    ("bunsho_kitei", "[一-龯ァ-ヶー]{2,8}規定(?=[にはがをでも、。」）\\s]|$)", "規定", "規程", "likely", "(?:の|法|令|条例|規則|規程|条|項|号)$"),
]
# End of the fixed values.

NOUN, KATAKANA = f"[{KANJI}]+(?:[{MIDDLE}][{KANJI}]+)*[{TAIL}]?", f"[{KATA}]{{3,}}"
_VERB_TAIL = re.compile(f"[{VERB}]|な[{NEGATIVE}]|[{ROW}][{AFTER_ROW}]")
_NOUN, _KATAKANA = re.compile(NOUN), re.compile(KATAKANA)
REACH = 16


def dictionary() -> list[tuple[str, tuple[str, ...]]]:
    """Groups of competing spellings: category and forms."""
    return [("かな漢字", f) for f in X.KANA_KANJI] + [("用語", f) for f in X.TERMS] + [("単位", f) for f in X.UNITS]


def verb(text: str, form: str, at: int) -> bool:
    """Whether the form at a place is used as a verb, by what follows its last kanji."""
    kanji = [k for k, c in enumerate(form) if re.match(f"[{KANJI}]", c)]
    return bool(kanji) and bool(_VERB_TAIL.match(text, at + kanji[-1] + 1, at + kanji[-1] + 9))


def _alternative(form: str, category: str) -> str:
    before, behind = CONTEXT.get(form, (None, None))
    prefix = f"(?<![{KANJI}{KATA}])" if category == "用語" else ""
    if before:
        prefix += "".join(f"(?<!{x})" for x in before.removeprefix("(?:").removesuffix(")$").split("|"))
    return prefix + form + (f"(?!{behind.removeprefix('^')})" if behind else "")


def group_pattern(category: str, forms: tuple[str, ...]) -> str:
    """One pattern for a group: longer forms first, each with its own context, so that a rejected long form leaves room for a shorter one."""
    return "|".join(_alternative(f, category) for f in sorted(forms, key=lambda f: -len(f)))


def group_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", groups: list[tuple[str, tuple[str, ...]]] | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """key, category, group_no, form, n of the groups of which a document has two spellings or more."""
    some = [(c, kept) for c, forms in groups or dictionary() if len(kept := tuple(f for f in forms if f not in exclude)) > 1]
    def hits(category: str, forms: tuple[str, ...]) -> Column:
        """All finds of a group's forms where two of them are in the text at all, which a plain search tells sooner than the pattern."""
        there = sum((F.col(text).contains(f).cast("int") for f in forms), F.lit(0))
        return F.when(there > 1, F.regexp_extract_all(text, F.lit(f"({group_pattern(category, forms)})"))).otherwise(F.array().cast("array<string>"))

    found = F.array(*(F.struct(F.lit(c).alias("category"), F.lit(k).alias("group_no"), hits(c, forms).alias("hits")) for k, (c, forms) in enumerate(some)))
    rows = docs.select(key, F.explode(F.filter(found, lambda g: F.size(g["hits"]) > 1)).alias("g")).select(key, "g.category", "g.group_no", F.explode("g.hits").alias("form"))
    counts = rows.groupBy(key, "category", "group_no", "form").agg(F.count("*").alias("n"))
    several = counts.groupBy(key, "group_no").agg(F.count("*").alias("k")).filter("k > 1").drop("k")
    return counts.join(several, [key, "group_no"], "left_semi").select(key, "category", "group_no", "form", "n")


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, token, n: nouns in kanji and words in katakana; words used as verbs don't count."""

    @F.pandas_udf("array<string>")
    def words(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: [m[0] for m in _NOUN.finditer(t or "") if not verb(t, m[0], m.start())] + _KATAKANA.findall(t or ""))

    return docs.select(key, F.explode(words(text)).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))


def katakana_groups(counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Words (key, token, n) that differ only in long vowel marks at their end: key, stem, forms."""
    stem = F.regexp_replace("token", "ー+$", "")
    rows = counts.filter(F.col("token").rlike(f"^{KATAKANA}$") & (F.length(stem) >= 3)).withColumn("stem", stem)
    return rows.groupBy(key, "stem").agg(F.array_sort(F.collect_set("token")).alias("forms")).filter(F.size("forms") > 1)


def skeleton(token: Column) -> Column:
    """Kanji of a noun without its kana; null if it can't have spelling variants."""
    bare = F.regexp_replace(token, f"[{HIRA}]", "")
    return F.when(token.rlike(f"^[{KANJI}]+(?:[{MIDDLE}][{KANJI}]+)*[{HIRA}]?$") & (F.length(bare) >= 2) & (F.length(bare) <= 6), bare)


def okurigana_groups(counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Nouns (key, token, n) with the same kanji whose last kana are alike or may be left out: key, stem, forms."""

    @F.pandas_udf("array<array<string>>")
    def clusters(batch: pd.Series) -> pd.Series:
        def one(forms: list[str]) -> list[list[str]]:
            tails: dict[str, list[str]] = defaultdict(list)
            for f in sorted(forms):
                tails[f[-1] if re.match(f"[{HIRA}]", f[-1]) else ""].append(f)
            joined = [t for t in tails if t in OPTIONAL_TAIL] if "" in tails else []
            out = [sorted(sum((tails.pop(t) for t in joined), []))] if joined else []
            return [g for g in [*out, *tails.values()] if len(g) > 1]

        return batch.map(lambda x: one(list(x)))

    rows = counts.withColumn("stem", skeleton(F.col("token"))).filter("stem is not null")
    sets = rows.groupBy(key, "stem").agg(F.array_sort(F.collect_set("token")).alias("all")).filter(F.size("all") > 1)
    return sets.select(key, "stem", F.explode(clusters("all")).alias("forms"))


def document_kind(front: Column, head: Column) -> Column:
    """規則 or 規程, by how a document's front and first 400 characters name it; null if they don't."""
    joined = F.regexp_replace(F.concat(F.coalesce(front, F.lit("")), F.left(head, F.lit(400))), X.WS, "")
    return F.when(joined.rlike("この就業規則|就業規則[（(]以下"), "規則").when(joined.rlike("この[一-龯ァ-ヶー]{2,10}規程|[一-龯ァ-ヶー]{2,10}規程[（(]以下"), "規程")


def misuses(docs: DataFrame, key: str = "doc_id", text: str = "text", kind: str | None = None) -> DataFrame:
    """key, rule_id, wrong, correct, confidence, n of the rules that a document breaks. kind: a column with what the document calls itself."""
    rules = [F.struct(F.lit(r).alias("rule_id"), F.lit(w).alias("wrong"), F.lit(c).alias("correct"), F.lit(s).alias("confidence"), F.regexp_count(text, F.lit(p)).alias("n")) for r, p, w, c, s, _ in MISUSES]
    if kind:
        wrong = F.when(F.col(kind) == "規則", "規程").when(F.col(kind) == "規程", "規則")
        n = F.when(wrong.isNull(), 0).otherwise(F.regexp_count(text, F.concat(F.lit("(?:この|本|当)"), wrong)))
        rules.append(F.struct(F.lit("self_ref").alias("rule_id"), wrong.alias("wrong"), F.col(kind).alias("correct"), F.lit("sure").alias("confidence"), F.coalesce(n, F.lit(0)).alias("n")))
    return docs.select(key, F.explode(F.filter(F.array(*rules), lambda r: r["n"] > 0)).alias("r")).select(key, "r.*")


def find_spans(text: str, groups: list[tuple[str, tuple[str, ...]]], rules: bool = True) -> list[tuple[int, int, str, int, bool]]:
    """start, end, surface, group and misuse of what is found in a text, without overlaps: earlier first, then misuse, then longer."""
    found = []
    for k, (_, pattern, wrong, _, _, before) in enumerate(MISUSES if rules else []):
        for m in re.finditer(pattern, text):
            at = text.find(wrong, m.start(), m.end())
            if at >= 0 and not (before and re.search(before, text[max(0, m.start() - REACH) : m.start()])):
                found.append((at, at + len(wrong), wrong, len(groups) + k, True))
    for k, (category, forms) in enumerate(groups):
        for f in forms:
            found += [(m.start(), m.end(), f, k, False) for m in re.finditer(f"(?={_alternative(f, category)})", text) for m in [re.compile(re.escape(f)).match(text, m.start())] if m and not (category == "送り仮名" and verb(text, f, m.start()))]
    found.sort(key=lambda s: (s[0], not s[4], s[0] - s[1]))
    out, end = [], -1
    for s in found:
        if s[0] >= end:
            out.append(s)
            end = s[1]
    return out


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", groups: list[tuple[str, tuple[str, ...]]] | None = None) -> DataFrame:
    """key and start, end, surface, group_no, misuse of each span to be marked."""
    some = groups or dictionary()

    @F.pandas_udf("array<struct<start:int,end:int,surface:string,group_no:int,misuse:boolean>>")
    def scan(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: find_spans(t or "", some))

    return docs.select(key, F.explode(scan(text)).alias("s")).select(key, "s.*")


Groups = tuple[tuple[str, tuple[str, ...]], ...]


@lru_cache(maxsize=4)
def automaton(groups: Groups) -> object:
    """An automaton over all forms of all groups; each form leads to its groups and to the pattern of its context in them."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, (category, forms) in enumerate(groups):
        for f in forms:
            found.add_word(f, (f, [*found.get(f, (f, []))[1], (k, re.compile(_alternative(f, category)))]))
    if groups:
        found.make_automaton()
    return found


def _counted(places: dict[int, list[tuple[int, int, str]]]) -> list[tuple[int, str, int]]:
    """group, form, n of each group's places (start, minus length, form), earlier and longer ones first, none overlapping another."""
    out = []
    for k, some in places.items():
        n, end = Counter(), 0
        for start, less, form in sorted(some):
            if start >= end:
                n[form] += 1
                end = start - less
        out += [(k, form, m) for form, m in n.items()]
    return out


def analyze(docs: DataFrame, key: str = "doc_id", text: str = "text", use_dict: bool = True, use_auto: bool = True, extra_groups: Groups = (), exclude_forms: tuple[str, ...] = (), noun_only: bool = True, check_misuse: bool = True, kind: str | None = None) -> DataFrame:
    """key, category, forms (most frequent first), form, n, correct: groups of spellings of which a document has two or more, and words it misuses.

    docs may have several rows a key. Groups come from the dictionary, from extra_groups and, found in the document itself, from nouns that
    differ in their kana and katakana words that differ in long vowel marks; of groups with the same forms the first is kept. exclude_forms are never
    counted. noun_only: nouns used as verbs don't count. correct is the right word for a misused one, else null. One automaton finds the
    forms of all groups in one pass over a text, which also counts its words; only documents with groups of their own are read again, with these.
    """
    given: Groups = tuple((c, kept) for c, forms in (*(dictionary() if use_dict else ()), *extra_groups) if len(kept := tuple(f for f in forms if f not in exclude_forms)) > 1)

    @F.pandas_udf("array<struct<rank:int,form:string,n:long>>")
    def scan(batch: pd.Series) -> pd.Series:
        search = automaton(given)

        def one(t: str | None) -> list[tuple[int, str, int]]:
            t, places = t or "", defaultdict(list)
            for end, (form, groups) in search.iter(t) if given else ():
                start = end - len(form) + 1
                for k, pattern in groups:
                    if pattern.match(t, start):
                        places[k].append((start, -len(form), form))
            words = Counter([m[0] for m in _NOUN.finditer(t) if not (noun_only and verb(t, m[0], m.start()))] + _KATAKANA.findall(t)) if use_auto else {}
            return [*_counted(places), *((-1, w, n) for w, n in words.items())]

        return batch.map(one)

    counts = written(docs.select(key, F.explode(scan(text)).alias("s")).groupBy(key, "s.rank", "s.form").agg(F.sum("s.n").alias("n")), "forms")
    names = F.get(F.array(*(F.lit(c) for c, _ in given)), F.col("rank")) if given else F.lit(None).cast("string")
    found = counts.filter("rank >= 0").select(key, F.col("rank").cast("long").alias("rank"), names.alias("category"), "form", "n")
    if use_auto:
        words = counts.filter("rank < 0").select(key, F.col("form").alias("token"), "n").filter(~F.col("token").isin(*exclude_forms) if exclude_forms else F.lit(True))
        own = okurigana_groups(words, key).select(key, F.lit("送り仮名").alias("category"), "forms").unionByName(katakana_groups(words, key).select(key, F.lit("カタカナ").alias("category"), "forms"))

        @F.pandas_udf("array<struct<at:int,form:string,n:long>>")
        def again(texts: pd.Series, groups: pd.Series) -> pd.Series:
            def one(t: str | None, some: list[dict]) -> list[tuple[int, str, int]]:
                t, places = t or "", defaultdict(list)
                for k, g in enumerate(some):
                    for f in g["forms"]:
                        places[k] += [(m.start(), -len(f), f) for m in re.finditer(f"(?={_alternative(f, g['category'])})", t) if not (noun_only and g["category"] == "送り仮名" and verb(t, f, m.start()))]
                return _counted(places)

            return pd.Series([one(t, list(g)) for t, g in zip(texts, groups, strict=True)], dtype=object)

        lists = own.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("category", "forms"))).alias("groups"))
        more = docs.join(lists, key).select(key, "groups", F.explode(again(text, "groups")).alias("s"))
        more = more.select(key, (F.col("s.at") + len(given)).cast("long").alias("rank"), F.get("groups", F.col("s.at"))["category"].alias("category"), "s.form", "s.n").groupBy(key, "rank", "category", "form").agg(F.sum("n").alias("n"))
        found = found.unionByName(more)
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "form", "n")))
    groups = found.groupBy(key, "rank", "category").agg(order.alias("counts"), F.array_sort(F.collect_list("form")).alias("same")).filter(F.size("same") > 1)
    first = groups.groupBy(key, "same").agg(F.min_by(F.struct("category", "counts"), F.struct(F.col("category") == "カタカナ", "rank")).alias("g"))
    forms = F.transform("g.counts", lambda x: x["form"])
    out = first.select(key, "g.category", forms.alias("forms"), F.explode("g.counts").alias("c")).select(key, "category", "forms", "c.form", "c.n", F.lit(None).cast("string").alias("correct"))
    if check_misuse:
        wrong = misuses(docs, key, text, kind).groupBy(key, "rule_id", "wrong", "correct").agg(F.sum("n").alias("n"))
        out = out.unionByName(wrong.select(key, F.lit("用語の誤用").alias("category"), F.array("wrong").alias("forms"), F.col("wrong").alias("form"), "n", "correct"))
    return out


def summary(counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """A line for each group of counts (key, category, group_no, form, n): its forms, most frequent first."""
    forms = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "form", "n")))
    line = F.concat(F.col("category"), F.lit("："), F.array_join(F.transform(forms, lambda x: F.concat(x["form"], F.lit("（"), x["n"].cast("string"), F.lit("）"))), "・"))
    return counts.groupBy(key, "category", "group_no").agg(line.alias("line"))
