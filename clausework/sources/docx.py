"""Office documents: their paragraphs, tables and reference fields as rows, and simple documents from rows. Standard library only."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as X

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BLOCK = "path string, block_idx int, kind string, text string, style_id string, style_name string, auto_kind string, table_index int, rows string, has_drawing boolean, underlined boolean, toc boolean, aligned boolean"
FIELD = "path string, field_no int, instr string, result string, bookmark string"
_DRAWN = {"drawing", "pict", "object", "AlternateContent", "oMath"}


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def text_of(p: ET.Element) -> str:
    """Text of a paragraph with its breaks and tabs."""
    sign = {"br": "\n", "cr": "\n", "tab": "\t"}
    return "".join((e.text or "") if e.tag == f"{W}t" else sign.get(_name(e.tag), "") if e.tag.startswith(W) and _name(e.tag) in sign and e.get(f"{W}val") is None else "" for e in p.iter())


def blocks(body: ET.Element) -> Iterator[ET.Element]:
    """Paragraphs and tables in order, those in content controls too."""
    for e in body:
        if e.tag in (f"{W}p", f"{W}tbl"):
            yield e
        elif e.tag in (f"{W}sdt", f"{W}customXml"):
            yield from blocks(e.find(f"{W}sdtContent") if e.tag == f"{W}sdt" and e.find(f"{W}sdtContent") is not None else e)


# Kinds of paragraphs by what a style's name begins with; the longest that fits counts.
STYLE_KINDS = {
    "02-": "chapter", "03-": "article", "04-1": "paragraph", "04-": "paragraph", "04-2": "paragraph", "05-": "paragraph", "05-1": "item", "06-1": "item_sub",
    "06-10": "item_sub", "07-1": "item_sub", "06-": "item_sub", "07-": "item_sub", "07-0": "item_sub2", "08-": "item_sub2", "00-": "body_plain",
}
# End of the fixed values.


def style_kind(name: str | None) -> str | None:
    """The kind that a style's name gives; none for other names."""
    fits = [k for k in STYLE_KINDS if (name or "").startswith(k)]
    return STYLE_KINDS[max(fits, key=len)] if fits else None


def auto_kind(fmt: str, text: str, style: str) -> str:
    """What a numbering level's paragraphs are: by a numbered style, the level's text, else its format."""
    if (kind := style_kind(style)) is not None:
        return kind
    if "章" in text or "条" in text:
        return "chapter" if "章" in text else "article"
    if "Circle" in fmt or any(a in text and b in text for a, b in ("（）", "()")):
        return "item"
    return "paragraph_1" if fmt == "none" else "paragraph"


class Package:
    """The parts of a document that decide how its paragraphs are read."""

    def __init__(self, data: bytes):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            part = lambda n: ET.fromstring(z.read(n)) if n in z.namelist() else None
            document, styles, numbering = (part(f"word/{n}.xml") for n in ("document", "styles", "numbering"))
        self.body = document.find(f"{W}body")
        val = lambda e, path: (x.get(f"{W}val") if e is not None and (x := e.find(path)) is not None else None)
        self.val = val
        self.styles = {s.get(f"{W}styleId"): s for s in (styles.iter(f"{W}style") if styles is not None else ())}
        levels = {a.get(f"{W}abstractNumId"): {l.get(f"{W}ilvl"): auto_kind(val(l, f"{W}numFmt") or "", val(l, f"{W}lvlText") or "", val(l, f"{W}pStyle") or "") for l in a.iter(f"{W}lvl")} for a in (numbering.iter(f"{W}abstractNum") if numbering is not None else ())}
        self.numbers = {n.get(f"{W}numId"): levels.get(val(n, f"{W}abstractNumId"), {}) for n in (numbering.iter(f"{W}num") if numbering is not None else ())}

    def kind(self, p: ET.Element) -> tuple[str | None, str | None, str | None]:
        """Style id, style name and the kind that style or numbering gives a paragraph; its own numbering first, then its style's."""
        style = self.val(p, f"{W}pPr/{W}pStyle")
        name = self.val(self.styles.get(style), f"{W}name")
        for holder in (p.find(f"{W}pPr"), self.styles[style].find(f"{W}pPr") if style in self.styles else None):
            number = self.val(holder, f"{W}numPr/{W}numId")
            if number and number != "0":
                return style, name, self.numbers.get(number, {}).get(self.val(holder, f"{W}numPr/{W}ilvl") or "0")
        if (kind := style_kind(name)) is not None:
            return style, name, kind
        if name and name.lower().startswith("list "):
            return style, name, "item" if "bullet" in name.lower() else "list_number"
        return style, name, None


def read_blocks(data: bytes) -> Iterator[tuple]:
    package, table = Package(data), 0
    for k, e in enumerate(blocks(package.body)):
        if e.tag == f"{W}tbl":
            rows = [["\n".join(text_of(p) for p in c.iter(f"{W}p")).strip() for c in r.iter(f"{W}tc")] for r in e.iter(f"{W}tr")]
            yield k, "table", "", None, None, None, table, json.dumps(rows, ensure_ascii=False), False, False, False, False
            table += 1
            continue
        instr = " ".join((x.text or "").upper() for x in e.iter(f"{W}instrText"))
        style, name, auto = package.kind(e)
        toc = "PAGEREF" in instr or " TOC " in f" {instr} " or (name or "").lower().startswith(("toc", "table of contents"))
        under = any(u.get(f"{W}val") != "none" for u in e.iter(f"{W}u"))
        yield k, "paragraph", text_of(e), style, name, auto, None, None, any(_name(x.tag) in _DRAWN for x in e.iter()), under, toc, package.val(e, f"{W}pPr/{W}jc") in ("center", "right")


def read_fields(data: bytes) -> Iterator[tuple]:
    """REF and NOTEREF fields in order: instruction, result, bookmark."""
    state, instr, result, n = None, "", "", 0
    for e in Package(data).body.iter():
        if e.tag == f"{W}fldChar":
            kind = e.get(f"{W}fldCharType")
            if kind == "end" and state:
                words = instr.split()
                if len(words) > 1 and words[0].upper() in ("REF", "NOTEREF") and not words[1].startswith(("_Toc", "_GoBack")):
                    yield n, " ".join(words), result, words[1]
                    n += 1
            state = {"begin": "instr", "separate": "result"}.get(kind)
            instr, result = ("", "") if kind == "begin" else (instr, result)
        elif e.tag == f"{W}instrText" and state == "instr":
            instr += e.text or ""
        elif e.tag == f"{W}t" and state == "result":
            result += e.text or ""


def _scan(spark: SparkSession, path: str, schema: str, read) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, data in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(p, *r) for r in read(data)], columns=names).astype(object)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content").mapInPandas(run, schema)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """A row for each paragraph and table of the documents at a path, in order."""
    return _scan(spark, path, BLOCK, read_blocks)


def fields(spark: SparkSession, path: str) -> DataFrame:
    return _scan(spark, path, FIELD, read_fields)


def lines(blocks: DataFrame) -> DataFrame:
    """path, pos, line, kind of what is read as text: paragraphs outside a table of contents, cut at soft breaks; kind is what style or numbering says."""
    rows = blocks.filter("kind = 'paragraph' and not toc").select("path", "block_idx", F.col("auto_kind").alias("kind"), F.posexplode(F.split("text", "\n")).alias("k", "line"))
    return rows.select("path", (F.col("block_idx").cast("long") * 100_000 + F.col("k")).alias("pos"), "line", "kind")


def layout(text, aligned):
    """Whether a paragraph is laid out by blanks or rules rather than read."""
    lead = F.length(F.regexp_extract(text, "^[　 \\t]*", 0))
    s = F.trim(text)
    plain = ~s.rlike(X.CHAPTER) & ~s.rlike(X.ARTICLE) & ~s.rlike(X.MARK_HEAD) & ~s.endswith("。")
    return plain & (s != "") & (aligned | s.contains("___") | ((lead >= 8) & (F.length(s) <= 20)))


def write(paragraphs: list[tuple[str, str]], table: list[list[list[tuple[str, bool]]]] | None = None) -> bytes:
    """A document of (style, text) paragraphs, and a table whose cells are runs of (text, underlined)."""
    run = lambda t, u=False: f'<w:r>{"<w:rPr><w:u w:val=\"single\"/></w:rPr>" if u else ""}<w:t xml:space="preserve">{escape(t)}</w:t></w:r>'
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{escape(s)}"/></w:pPr>{run(t)}</w:p>' for s, t in paragraphs)
    if table:
        body += "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p>{''.join(run(*r) for r in cell)}</w:p></w:tc>" for cell in row) + "</w:tr>" for row in table) + "</w:tbl><w:p/>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def comparison(rows: list[dict]) -> bytes:
    """The old/new table of a comparison's rows: old, new, note."""
    if not rows:
        return write([("Normal", "変更点はありません。")])
    cell = lambda lines: [r for line in lines for r in ([tuple(x) for x in line] + [("\n", False)])][:-1]
    return write([("Normal", "新旧対照表")], [[[("現行", False)], [("改正案", False)], [("備考", False)]], *([cell(r["old"]), cell(r["new"]), [(r["note"], False)]] for r in rows)])
