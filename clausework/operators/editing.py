"""Edits of trees: split, merge and renumber, as pure functions and for each row of a DataFrame."""

from __future__ import annotations

import copy
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import reader


def articles(tree: list[dict]) -> Iterator[tuple[list[dict], int]]:
    """Each article's list and place in it, in document order."""
    for k, node in enumerate(tree):
        if node["type"] == "chapter":
            yield from ((node["articles"], j) for j in range(len(node["articles"])))
        elif node["type"] == "article":
            yield tree, k


def renumber(tree: list[dict]) -> list[dict]:
    """Numbers by place: chapters and articles run on, what is below an article begins anew."""
    out = copy.deepcopy(tree)
    chapters = articles_seen = 0

    def below(node: dict, keys: tuple[str, ...]) -> None:
        for n, kid in enumerate(node.get(keys[0]) or [], 1):
            kid["number"] = n
            if len(keys) > 1:
                below(kid, keys[1:])

    for node in out:
        if node["type"] == "chapter":
            chapters += 1
            node |= {"number": chapters, "number_str": f"第{chapters}章"}
    for some, k in articles(out):
        articles_seen += 1
        some[k] |= {"number": articles_seen, "branch": 0, "number_str": f"第{articles_seen}条"}
        below(some[k], ("paragraphs", "items", "sub_items", "sub_items2"))
    return out


def new_article(title: str = "", body: str = "") -> dict:
    return {"type": "article", "number": 0, "branch": 0, "number_str": "", "title": title, "title_note": "", "paragraphs": [{"type": "paragraph", "number": 1, "body": body, "items": []}]}


def new_chapter(title: str = "") -> dict:
    return {"type": "chapter", "number": 0, "number_str": "", "title": title, "articles": []}


def head(body: str) -> tuple[str, str]:
    """Title and text of a paragraph that reads like an article's heading; without one, no title."""
    line = reader.look(body)
    if line.article:
        return reader.article_title(line.article[7].strip())
    if line.loose and not line.loose_bare:
        return reader.article_title(line.s[line.loose.end() - 1 :])
    return "", line.s[line.loose.end() :] if line.loose else body


def split_article(tree: list[dict], place: int, paragraph: int) -> list[dict]:
    """The article at a place (from 0) ends before a paragraph (from 1 on); the rest is an article behind it."""
    out = copy.deepcopy(tree)
    some, k = list(articles(out))[place]
    paras = some[k]["paragraphs"]
    if not 0 < paragraph < len(paras):
        raise ValueError("an article is split before its second paragraph or a later one")
    title, body = head(paras[paragraph]["body"])
    rest = new_article(title)
    rest["paragraphs"] = [paras[paragraph] | {"body": body}, *paras[paragraph + 1 :]]
    some[k]["paragraphs"] = paras[:paragraph]
    some.insert(k + 1, rest)
    return renumber(out)


def merge_articles(tree: list[dict], place: int) -> list[dict]:
    """The article at a place takes the paragraphs of the one behind it in the same list."""
    out = copy.deepcopy(tree)
    some, k = list(articles(out))[place]
    if k + 1 >= len(some) or some[k + 1]["type"] != "article":
        raise ValueError("there is no article behind it")
    some[k]["paragraphs"] += some.pop(k + 1)["paragraphs"]
    return renumber(out)


def freeze_levels(tree: list[dict]) -> list[dict]:
    """Each sub-item says whether it is one of several, so that later edits don't change how it is numbered."""
    out = copy.deepcopy(tree)
    for some, k in articles(out):
        for p in some[k]["paragraphs"]:
            for item in p["items"]:
                subs = item.get("sub_items") or []
                for s in subs:
                    s.setdefault("level", "multi" if len(subs) > 1 else "single")
    return out


def restructured(old: list[str], new: list[str], least: float = 0.8) -> bool:
    """Whether a model's new paragraphs may replace old ones: each is text of the old, and together they keep most of it."""
    plain = lambda s: "".join(c for c in s if not c.isspace() and c not in "・･,，.．、。")
    before, after = plain("".join(old)), [plain(s) for s in new]
    return bool(before) and all(s in before for s in after) and sum(map(len, after)) >= least * len(before)


def signature(article: dict, deep: bool = False) -> tuple:
    """What an article is made of: numbers of items of each paragraph, and below."""
    subs = lambda s: len(s.get("sub_items2") or []) if deep else 0
    return tuple(tuple(tuple(subs(s) for s in it.get("sub_items") or []) for it in p.get("items") or []) for p in article["paragraphs"])


def edit(trees: DataFrame, how: Callable[..., list[dict]], *places: str) -> DataFrame:
    """trees (tree as JSON, further columns) with tree edited by how(tree, *places), places being columns; a tree that can't be edited so stays."""

    @F.pandas_udf("string")
    def edited(tree: pd.Series, *at: pd.Series) -> pd.Series:
        def one(text: str, *k: int) -> str:
            try:
                return json.dumps(how(json.loads(text), *map(int, k)), ensure_ascii=False)
            except (ValueError, IndexError):
                return text

        return pd.Series([one(*row) for row in zip(tree, *at, strict=True)])

    return trees.withColumn("tree", edited("tree", *places))


def splits(trees: DataFrame, place: str = "place", paragraph: str = "paragraph") -> DataFrame:
    """Each tree with its article at `place` split before its `paragraph`."""
    return edit(trees, split_article, place, paragraph)


def merges(trees: DataFrame, place: str = "place") -> DataFrame:
    """Each tree with its article at `place` merged with the one behind it."""
    return edit(trees, merge_articles, place)
