"""Segments of articles in JATS XML."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions import patterns as P
from foliospark.functions import text as X
from foliospark.functions.python import Located, plain_name

_FORMULAS = ("inline-formula", "disp-formula", "math")
_SET_APART = ("table-wrap", "fig", "list")
_NUMBER = re.compile(r"^(?:\d{1,2}(?:\.\d{1,2}){0,3}\.?|[IVX]{1,4}\.)\s+")
_BACK = re.compile(rf"(?:{'|'.join(P.BACK_SECTIONS)})\b", re.IGNORECASE)
_WORDS = re.compile(P.WORD)


def running_text(el: ET.Element) -> str:
    """All text below ``el``; formulas become placeholders, nested tables, figures and lists are left out."""
    out: list[str] = []
    stack: list[tuple[ET.Element | None, str | None]] = [(el, None)]
    while stack:  # depth first, without recursion: documents may be nested deeply
        node, tail = stack.pop()
        if node is None:
            out.append(tail or "")
            continue
        name = plain_name(node)
        if node is not el:
            stack.append((None, node.tail))
        if name in _FORMULAS:
            out.append(f" {P.PLACEHOLDER} ")
        elif name and not (name in _SET_APART and node is not el):
            out.append(node.text or "")
            stack += [(child, None) for child in reversed(list(node))]
    return re.sub(r"\s+", " ", "".join(out)).strip()


def _opens_back_matter(title: str) -> bool:
    """Whether a title is a named heading that begins with the name of a part of the back matter."""
    bare = _NUMBER.sub("", title.strip())
    whole = _BACK.fullmatch(bare.rstrip(" :")) or _BACK.match(bare) and len(_WORDS.findall(bare)) <= 4 and not bare.endswith((".", ";", ","))
    return bool(whole and _BACK.match(title))


class _Reader:
    """Collects (kind, text, section, loc) in document order."""

    def __init__(self, content: str) -> None:
        self.rows: list[tuple[str, str, str, str]] = []
        self.doc = Located(content)
        self.article()

    def put(self, kind: str, text: str, section: str, loc: str) -> None:
        if text:
            self.rows.append((kind, text, section, loc))

    def article(self) -> None:
        for el, name, _ in self.doc.children(self.doc.root):
            if name == "front":
                self.front(el)
            elif name == "body":
                self.section(el, "", "body")
            elif name == "back":
                for c, n, _ in self.doc.children(el):
                    if n == "ref-list":
                        self.references(c)

    def front(self, el: ET.Element, inside: bool = False) -> None:
        for c, name, p in self.doc.children(el):
            chosen = inside or name == "abstract" and c.get("abstract-type") in (None, "", "abstract")
            if name == "p" and inside:
                self.put("body", running_text(c), "Abstract", p)
            if name != "abstract" or chosen:
                self.front(c, chosen)

    def section(self, el: ET.Element, title: str, kind: str) -> None:
        for c, name, p in self.doc.children(el):
            match name:
                case "title":
                    title = running_text(c)
                    self.put("heading", title, title, p)
                    if _opens_back_matter(title):
                        kind = "back_matter"
                case "p" | "disp-quote":
                    self.put(kind, running_text(c), title, p)
                    self.inner(c, title)
                case "list" | "def-list":
                    for item, _, q in self.doc.children(c):
                        self.put(kind, running_text(item), title, q)
                case "disp-formula":
                    self.put("formula", P.PLACEHOLDER, title, p)
                case "table-wrap" | "table-wrap-group":
                    self.put("table", running_text(c), title, p)
                case "fig":
                    self.put("caption", running_text(c), title, p)
                case "ref-list":
                    self.references(c)
                case "sec":
                    back = kind == "back_matter" or c.get("sec-type") in P.BACK_SECTION_TYPES
                    self.section(c, title, "back_matter" if back else "body")

    def inner(self, el: ET.Element, title: str) -> None:
        for c, name, p in self.doc.children(el):
            if name in ("table-wrap", "fig"):
                self.put("table" if name == "table-wrap" else "caption", running_text(c), title, p)
            elif name == "list":
                for item, n, q in self.doc.children(c):
                    if n == "list-item":
                        self.put("body", running_text(item), title, q)
            else:
                self.inner(c, title)

    def references(self, el: ET.Element) -> None:
        for c, name, p in self.doc.children(el):
            if name == "ref":
                self.put("reference", running_text(c), "References", p)


_ROWS = "doc_id string, kind string, text string, seg_order int, section string, page int, loc string, broken_line int"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in _ROWS.split(", ")]
    for b in batches:
        out = []
        for doc, content in zip(b["doc_id"], b["content"]):
            try:
                reader = _Reader(content or "")
            except ET.ParseError as e:
                out.append((doc, None, None, None, None, None, None, e.position[0]))
                continue
            out += [(doc, k, t, i, s, None, loc, None) for i, (k, t, s, loc) in enumerate(reader.rows)] or [(doc, None, None, None, None, None, None, None)]
        frame = pd.DataFrame(out, columns=names)
        for c in ("seg_order", "page", "broken_line"):
            frame[c] = frame[c].astype("Int32")
        yield frame


def read_jats(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, failures) of ``files`` (doc_id, content).

    ``failures`` (doc_id, broken_line) has the documents that aren't well-formed XML, null and empty
    content included. Traces of sub- and superscripts are counted in the emitted text, in the JVM.
    """
    rows = files.select(F.col("doc_id").cast("string"), F.col("content").cast("string")).mapInPandas(_read, _ROWS)
    seg = rows.where("kind IS NOT NULL").drop("broken_line").withColumn("traces", X.format_traces(F.col("text")))
    return seg, rows.where("broken_line IS NOT NULL").select("doc_id", "broken_line")


def abstract_subscripts(files: DataFrame) -> DataFrame:
    """(doc_id, subscripts): elements ``sub`` within abstracts of ``files`` (doc_id, content), each once; null for broken XML."""

    @F.pandas_udf("int")
    def count(contents: pd.Series) -> pd.Series:
        out = []
        for c in contents:
            try:
                doc = Located(c or "")
            except ET.ParseError:
                out.append(None)
                continue
            out.append(sum(plain_name(el) == "sub" and "/abstract[" in f"/{place}" for el, place in doc.place.items()))
        return pd.Series(out, dtype="Int32")

    return files.select("doc_id", count(F.col("content").cast("string")).alias("subscripts"))
