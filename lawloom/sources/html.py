"""Text, links, tables and labelled fields of landed HTML pages, with the standard parser, Arrow batch by batch."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import parse_qs, unquote, urljoin, urlparse

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

# Marks of download links and names that say nothing.
_DOWNLOAD = re.compile(r"filedown|download|down\.do|/filesrc/|/comm/getfile|file_?ty=attach", re.I)
_FILE = re.compile(r"\.(?:pdf|hwpx?|docx?|xlsx?|pptx?|zip)(?:\b|$)", re.I)
_NAMELESS = {"", "다운로드", "파일다운로드", "download", "viewer", "뷰어"}
_SILENT = {"script", "style", "template", "noscript"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}


class Page(HTMLParser):
    """One pass over a page: text nodes, anchors, table rows, and dt/dd and th/td pairs."""

    def __init__(self, markup: str):
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.anchors: list[tuple[str, str]] = []
        self.rows: list[list[tuple[str, str, str]]] = []  # cells: tag, text, first link
        self.fields: dict[str, str] = {}
        self._silent = 0
        self._anchor: list[str] | None = None
        self._href = ""
        self._cell: list | None = None
        self._label: str | None = None
        self._term: list[str] | None = None
        self._term_tag = ""
        try:
            self.feed(markup)
            self.close()
        except (AssertionError, ValueError):  # broken markup: keep what was read
            pass
        self._end_cell()

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self._silent += 1
        elif tag == "a":
            self._href, self._anchor = (dict(attrs).get("href") or "").strip(), []
            if self._cell is not None and not self._cell[2]:
                self._cell[2] = self._href
        elif tag == "tr":
            self._end_cell()
            self.rows.append([])
        elif tag in ("td", "th"):
            self._end_cell()
            if not self.rows:
                self.rows.append([])
            self._cell = [tag, [], ""]
        elif tag in ("dt", "dd"):
            self._end_term()
            self._term, self._term_tag = [], tag

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self._silent = max(0, self._silent - 1)
        elif tag == "a" and self._anchor is not None:
            self.anchors.append((self._href, " ".join(" ".join(self._anchor).split())))
            self._anchor = None
        elif tag in ("td", "th", "tr", "table"):
            self._end_cell()
        elif tag in ("dt", "dd", "dl"):
            self._end_term()

    def handle_data(self, data):
        if self._silent or not data.strip():
            return
        self.texts.append(data.strip())
        for open_part in (self._anchor, self._cell[1] if self._cell else None, self._term):
            if open_part is not None:
                open_part.append(data.strip())

    def _pair(self, is_label: bool, value: str) -> None:
        if is_label:
            self._label = value
        elif self._label is not None:
            if not self.fields.get(self._label):
                self.fields[self._label] = value
            self._label = None

    def _end_cell(self):
        if self._cell is not None:
            tag, parts, href = self._cell
            value = " ".join(" ".join(parts).split())
            self.rows[-1].append((tag, value, href))
            self._pair(tag == "th", value)
            self._cell = None

    def _end_term(self):
        if self._term is not None:
            self._pair(self._term_tag == "dt", " ".join(" ".join(self._term).split()))
            self._term = None


def page_text(markup: str | None) -> str | None:
    """Text nodes one a line, without scripts, styles and comments; None for no markup."""
    return "\n".join(Page(markup).texts) if markup else None


def _last_segment(url: str) -> str:
    return urlparse(url).path.rstrip("/").rsplit("/", 1)[-1]


def page_links(markup: str | None, base: str = "") -> list[dict]:
    """Download links of a page, each file once: file_name, file_url, file_ext. Viewer links give the file they wrap;
    nameless ones the name in their URL."""
    out: dict[str, dict] = {}
    for href, label in Page(markup).anchors if markup else []:
        if not href or href.lower().startswith(("javascript:", "#")) or not (_DOWNLOAD.search(href) or _FILE.search(href) or _FILE.search(label)):
            continue
        if "viewer.html" in href.lower():
            wrapped = parse_qs(urlparse(href).query).get("file")
            if not wrapped:
                continue
            href = unquote(wrapped[0])
        url = urljoin(base, href)
        name = _last_segment(url) or "attached_file" if label.lower() in _NAMELESS else label
        ext = next((n.rsplit(".", 1)[-1].lower() for n in (name, _last_segment(url)) if "." in n), None)
        out.setdefault(url, {"file_name": name, "file_url": url, "file_ext": ext})
    return list(out.values())


def board_rows(markup: str | None, base: str = "") -> list[dict]:
    """Rows of a list page as header-to-cell maps. The headers are the last row of th cells; the link is the first of the
    row. Rows without cells, and rows before any header, are left out."""
    header: list[str] = []
    out = []
    for row in Page(markup).rows if markup else []:
        if row and all(tag == "th" for tag, _, _ in row):
            header = [value for _, value, _ in row]
        elif header and row:
            link = next((href for _, _, href in row if href), None)
            out.append({"cells": dict(zip(header, (value for _, value, _ in row))), "link": urljoin(base, link) if link else None})
    return out


_LINK = StructType([StructField(n, StringType()) for n in ("file_name", "file_url", "file_ext")])
_ROW = StructType([StructField("cells", MapType(StringType(), StringType())), StructField("link", StringType())])


@F.pandas_udf(StringType())
def html_text(markup: pd.Series) -> pd.Series:
    return markup.map(page_text, na_action="ignore")


@F.pandas_udf(ArrayType(_LINK))
def html_links(markup: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([page_links(m, b or "") for m, b in zip(markup, base)])


@F.pandas_udf(ArrayType(_ROW))
def html_board(markup: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([board_rows(m, b or "") for m, b in zip(markup, base)])


@F.pandas_udf(MapType(StringType(), StringType()))
def html_fields(markup: pd.Series) -> pd.Series:
    """Values by the label before them (th and td, dt and dd); the first non-empty value of a label stays."""
    return pd.Series([Page(m).fields if m else {} for m in markup])
