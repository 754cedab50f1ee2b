"""What a web page holds beside its running text: title, day of publication, language, links and tables."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = "title string, published string, lang string, links array<struct<href:string,text:string>>, tables array<array<array<string>>>"
#: Elements whose content is no markup, and meta names that hold a page's day, best first.
RAW = {"script", "style", "textarea", "noscript", "template"}
DAYS = ("article:published_time", "datepublished", "publishdate", "pubdate", "date", "dc.date")
_NAME = re.compile(r"[A-Za-z][A-Za-z0-9:-]*")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_DAY = re.compile(r"(\d{4}-\d{2}-\d{2})")

Token = tuple[str, str, dict[str, str]]


def tokens(page: str) -> Iterator[Token]:
    """(kind, value, attributes): `text`, `open` and `close` tokens in order. One pass; what isn't a tag is text.

    A quote that is never closed doesn't hide the end of its tag. Comments and declarations are left out.
    """
    at, n = 0, len(page)
    closed_until = {'"': -1, "'": -1}  # no such quote from there on

    def tag_end(i: int) -> int:
        while i < n:
            c = page[i]
            if c == ">":
                return i
            if c in closed_until and closed_until[c] < 0:
                j = page.find(c, i + 1)
                if j < 0:
                    closed_until[c] = i
                else:
                    i = j
            i += 1
        return n

    while at < n:
        start = page.find("<", at)
        start = n if start < 0 else start
        if start > at:
            yield "text", html.unescape(page[at:start]), {}
        if start == n:
            return
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            at = n if end < 0 else end + 1
            continue
        name = _NAME.match(page, start + 2 if page.startswith("</", start) else start + 1)
        if not name:
            yield "text", "<", {}
            at = start + 1
            continue
        end, low = tag_end(name.end()), name[0].lower()
        at = end + 1
        if page[start + 1] == "/":
            yield "close", low, {}
            continue
        attributes: dict[str, str] = {}
        for m in _ATTRIBUTE.finditer(page, name.end(), min(end, n)):
            attributes.setdefault(m[1].lower(), html.unescape(next((v for v in m.groups()[1:] if v is not None), "")))
        yield "open", low, attributes
        if low in RAW or low == "title":
            close = re.compile(f"</{low}", re.I).search(page, at)
            stop = close.start() if close else n
            if low == "title":
                yield "text", html.unescape(page[at:stop]), {}
            at = stop


def _plain(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def read_page(page: str) -> dict:
    """The fields of PAGE. Links are those with an address, with the text in them; tables have a row of cells for each row
    that has any, and an inner table's cells are its own."""
    title, lang, days, seen = None, None, {}, None
    links: list[dict[str, str]] = []
    tables: list[list[list[str]]] = []
    open_link: list[str] | None = None
    stack: list[dict] = []  # open tables: rows, cell
    in_title = False

    def end_cell(t: dict) -> None:
        if t["cell"] is not None:
            t["rows"][-1].append(_plain(t["cell"]))
            t["cell"] = None

    def end_link() -> None:
        nonlocal open_link
        if open_link is not None:
            links[-1]["text"] = _plain(open_link)
            open_link = None

    for kind, value, attributes in tokens(page):
        if kind == "text":
            if in_title and title is None:
                title = _plain([value])
            elif not in_title:
                if open_link is not None:
                    open_link.append(value)
                if stack and stack[-1]["cell"] is not None:
                    stack[-1]["cell"].append(value)
        elif kind == "open":
            in_title = value == "title"
            if value == "html" and lang is None:
                lang = attributes.get("lang") or None
            elif value == "meta":
                name = (attributes.get("property") or attributes.get("name") or attributes.get("itemprop") or "").lower()
                if name in DAYS and (m := _DAY.search(attributes.get("content", ""))):
                    days.setdefault(name, m[1])
            elif value == "time" and seen is None and (m := _DAY.search(attributes.get("datetime", ""))):
                seen = m[1]
            elif value == "a":
                end_link()
                if attributes.get("href"):
                    links.append({"href": attributes["href"], "text": ""})
                    open_link = []
            elif value == "table":
                stack.append({"rows": [], "cell": None})
            elif value == "tr" and stack:
                end_cell(stack[-1])
                stack[-1]["rows"].append([])
            elif value in ("td", "th") and stack:
                end_cell(stack[-1])
                if not stack[-1]["rows"]:
                    stack[-1]["rows"].append([])
                stack[-1]["cell"] = []
        else:
            in_title = False
            if value == "a":
                end_link()
            elif value in ("td", "th", "tr") and stack:
                end_cell(stack[-1])
            elif value == "table" and stack:
                end_cell(stack[-1])
                tables.append([r for r in stack.pop()["rows"] if r])
    end_link()
    while stack:
        end_cell(stack[-1])
        tables.append([r for r in stack.pop()["rows"] if r])
    published = next((days[d] for d in DAYS if d in days), seen)
    return {"title": title, "published": published, "lang": lang, "links": links, "tables": [t for t in tables if t]}


def read_pages(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """``key`` and the fields of PAGE for every row; a null page has no title, links or tables. Pages are read whole, in batches."""
    kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())])), pa.list_(pa.list_(pa.list_(pa.string())))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                found = [read_page(p or "") for p in part.column(1).to_pylist()]
                cells = [pa.array([f[name] for f in found], kind) for name, kind in zip(("title", "published", "lang", "links", "tables"), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cells], names=[key, "title", "published", "lang", "links", "tables"])

    rows = pages.select(F.col(key), F.col(column))
    return rows.mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, {PAGE}")
