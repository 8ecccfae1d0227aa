"""The library's functions under names that SQL can use.

What is a column expression becomes a SQL function (CREATE TEMPORARY FUNCTION ... RETURN), which Catalyst puts in place, with no Python worker; what
isn't stays an Arrow function; what reads the ordered lines of a document is a table function over a partitioned table:

    SELECT * FROM cw_outline_rows(TABLE(lines) PARTITION BY doc_id ORDER BY pos)
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, Row, SparkSession
from pyspark.sql import functions as F

from . import text as T

#: Name, expression, types of its arguments.
SCALARS: dict[str, tuple[Callable[..., Column], tuple[str, ...]]] = {
    "number": (T.number, ("string",)), "kanji_number": (T.kanji_number, ("string",)), "kana_number": (T.kana_number, ("string",)), "roman_number": (T.roman_number, ("string",)), "circled_number": (T.circled_number, ("string",)),
    "kanji_numeral": (T.kanji_numeral, ("bigint",)), "same_script": (T.same_script, ("bigint", "string")), "wide": (T.wide, ("string",)), "narrow": (T.narrow, ("string",)),
    "indent_width": (T.indent_width, ("string",)), "last_char": (T.last_char, ("string",)), "strip_left": (T.strip_left, ("string",)), "strip_right": (T.strip_right, ("string",)),
    "marker": (T.marker, ("string",)), "article": (T.article, ("string",)), "article_title": (T.article_title, ("string",)), "chapter": (T.chapter, ("string",)), "paragraph": (T.paragraph, ("string",)), "kind": (T.kind, ("string",)),
    "connective": (T.connective, ("string",)), "mid_sentence": (T.mid_sentence, ("string",)), "forecast": (T.forecast, ("string",)), "split_traces": (T.split_traces, ("string",)), "stop_word": (T.stop_word, ("string",)),
    "without_first_number": (T.without_first_number, ("string",)), "without_head_label": (T.without_head_label, ("string",)), "lead_mark": (T.lead_mark, ("string", "string")), "compared": (T.compared, ("string",)), "reference_norm": (T.reference_norm, ("string",)),
    "width_counts": (T.width_counts, ("string",)), "input_tokens": (T.input_tokens, ("string",)), "safe_name": (T.safe_name, ("string",)),
}
_LITERAL = re.compile(r"'(?:[^'\\]|\\.|'')*'", re.S)
_OPERATOR = re.compile(r"(?<![\w`])(and|or|not|[<>=!+*/%&|^-]+)\(")


def sql_of(column: Column) -> str:
    """A column expression as SQL: operators are written as the functions of that name."""
    said = str(column)[len("Column<'") : -len("'>")]
    out, at = [], 0
    for m in _LITERAL.finditer(said):
        out += [_OPERATOR.sub(r"`\1`(", said[at : m.start()]), m[0]]
        at = m.end()
    return "".join(out) + _OPERATOR.sub(r"`\1`(", said[at:])


class Outline:
    """A document's lines (doc_id, pos, line), in the order in which they come, as the indented lines of its tree."""

    def __init__(self) -> None:
        self.key, self.lines = None, []

    def eval(self, row: Row) -> None:
        self.key = row["doc_id"]
        self.lines.append(row["line"] or "")

    def terminate(self) -> Iterator[tuple]:
        from ..operators import reader

        if self.lines:
            yield from ((self.key, k, t) for k, t in enumerate(reader.outline(reader.read(self.lines))))


class References:
    """The references of each text of a table (doc_id, body)."""

    def eval(self, row: Row) -> Iterator[tuple]:
        from ..operators import refs

        for r in refs.scan(row["body"] or ""):
            yield (row["doc_id"], *r)


def register(spark: SparkSession, prefix: str = "cw_") -> list[str]:
    """Registers all functions for the session; returns their names."""
    from ..operators import reader, refs, verify

    for name, (make, types) in SCALARS.items():
        body = sql_of(make(*(F.col(f"arg{i}") for i in range(len(types)))))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({', '.join(f'arg{i} {t}' for i, t in enumerate(types))}) RETURN {body}")

    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(verify.normal)

    @F.pandas_udf("array<string>")
    def outline(s: pd.Series) -> pd.Series:
        return s.map(lambda t: reader.outline(reader.read((t or "").split("\n"))))

    arrow = {"normal": normal, "outline": outline}
    for name, f in arrow.items():
        spark.udf.register(prefix + name, f)
    tables = {"outline_rows": F.udtf(Outline, returnType="doc_id long, row_no int, text string"), "reference_rows": F.udtf(References, returnType=f"doc_id long, {refs.FOUND}")}
    for name, f in tables.items():
        spark.udtf.register(prefix + name, f)
    return [prefix + name for name in (*SCALARS, *arrow, *tables)]
