"""Text of document files by format, as (ok, extractor, text, error, metadata). Formats that need a library that is not
installed give ok = false and say so; payloads that turn out to be HTML are read as HTML."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawloom.sources.html import page_text

_Outcome = tuple[bool, str, str, str | None, dict[str, str]]
REGISTRY: list[tuple[str, tuple[str, ...], Callable[[bytes], tuple[str, dict]]]] = []


def extractor(name: str, *formats: str):
    """Registers a function bytes -> (text, metadata) for formats; the first registered for a format is used."""

    def register(f):
        REGISTRY.append((name, formats, f))
        return f

    return register


def _utf8(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def _xml_texts(data: bytes, names: set[str] | None = None) -> list[str]:
    root = ElementTree.fromstring(data)
    nodes = root.iter() if names is None else (n for n in root.iter() if n.tag.rsplit("}", 1)[-1] in names)
    return [n.text.strip() for n in nodes if n.text and n.text.strip()]


@extractor("text", "txt", "md", "log", "ini", "cfg", "yaml", "yml")
def _text(data: bytes):
    return _utf8(data), {}


@extractor("json", "json")
def _json(data: bytes):
    return json.dumps(json.loads(_utf8(data)), ensure_ascii=False, indent=2), {}


@extractor("csv", "csv")
def _csv(data: bytes):
    rows = [" | ".join(x.strip() for x in row) for row in csv.reader(io.StringIO(_utf8(data), newline=""))]
    return "\n".join(rows), {"row_count": len(rows)}


@extractor("html", "html", "htm")
def _html(data: bytes):
    return page_text(_utf8(data)) or "", {}


@extractor("xml", "xml")
def _xml(data: bytes):
    parts = _xml_texts(data)
    return "\n".join(parts), {"node_text_count": len(parts)}


@extractor("pdf", "pdf")
def _pdf(data: bytes):
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("no PDF library is installed") from e
    pages = [(p.extract_text() or "").strip() for p in PdfReader(io.BytesIO(data)).pages]
    return "\n\n".join(p for p in pages if p), {"pages": len(pages)}


def _paragraphs(data: bytes) -> list[str]:
    """Paragraphs of an office or hwpx part: the text runs of each p element joined."""
    root = ElementTree.fromstring(data)
    out = []
    for p in root.iter():
        if p.tag.rsplit("}", 1)[-1] == "p":
            line = "".join(t.text or "" for t in p.iter() if t.tag.rsplit("}", 1)[-1] == "t")
            if line.strip():
                out.append(line.strip())
    return out


@extractor("docx", "docx")
def _docx(data: bytes):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parts = _paragraphs(z.read("word/document.xml"))
    return "\n".join(parts), {"paragraphs": len(parts)}


@extractor("pptx", "pptx")
def _pptx(data: bytes):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted(n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n))
        texts = ["\n".join(_paragraphs(z.read(n))) for n in slides]
    return "\n\n".join(t for t in texts if t), {"slides": len(slides)}


@extractor("xlsx", "xlsx")
def _xlsx(data: bytes):
    tag = lambda n: n.tag.rsplit("}", 1)[-1]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in si.iter() if tag(t) == "t"))
        lines = []
        sheets = sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        for name in sheets:
            for row in (r for r in ElementTree.fromstring(z.read(name)).iter() if tag(r) == "row"):
                cells = []
                for c in row:
                    v = next((x.text or "" for x in c.iter() if tag(x) in ("v", "t")), "")
                    if c.get("t") == "s" and v.isdigit() and int(v) < len(shared):
                        v = shared[int(v)]
                    if v.strip():
                        cells.append(v.strip())
                if cells:
                    lines.append(" | ".join(cells))
    return "\n".join(lines), {"sheets": len(sheets)}


@extractor("hwpx", "hwpx")
def _hwpx(data: bytes):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        sections = sorted((n for n in z.namelist() if re.fullmatch(r"Contents/section\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        texts = ["\n".join(_paragraphs(z.read(n))) for n in sections]
    return "\n\n".join(t for t in texts if t), {"sections": len(sections)}


@extractor("hwp", "hwp")
def _hwp(data: bytes):
    raise RuntimeError("no HWP library is installed")


def looks_like_html(data: bytes, content_type: str | None = None) -> bool:
    head = data[:1024].lower()
    return "html" in (content_type or "").lower() or b"<html" in head or b"<!doctype html" in head


def extract(data: bytes | None, ext: str | None, content_type: str | None = None) -> _Outcome:
    """Read ``data`` by its format; a failure of any kind is an outcome with its message, never an exception."""
    if not data:
        return False, "none", "", "no content", {}
    ext = (ext or "").lower().lstrip(".")
    for name, formats, f in REGISTRY:
        if ext in formats:
            try:
                text, meta = f(data)
                return True, name, text, None, {k: str(v) for k, v in meta.items()}
            except Exception as e:  # noqa: BLE001 - any broken file must give a row
                if looks_like_html(data, content_type):
                    return True, "html", page_text(_utf8(data)) or "", None, {"declared": ext}
                return False, name, "", f"{type(e).__name__}: {e}", {}
    if looks_like_html(data, content_type):
        return True, "html", page_text(_utf8(data)) or "", None, {"declared": ext}
    return True, "binary", re.sub(r"[^\S\n]+", " ", _utf8(data)).strip(), None, {}


_SCHEMA = "ok boolean, extractor string, text string, error string, metadata map<string,string>"  # parsed when a session exists


def extract_files(files: DataFrame, content: str = "content", ext: str = "ext", content_type: str | None = None) -> DataFrame:
    """Adds the struct ``extraction`` (ok, extractor, text, error, metadata) to a frame of binary files. Files are large:
    the batches that cross to Python are cut by Spark's limit of bytes as well as rows."""

    @F.pandas_udf(_SCHEMA)
    def read(data: pd.Series, e: pd.Series, ct: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract(d, x, c) for d, x, c in zip(data, e, ct)], columns=["ok", "extractor", "text", "error", "metadata"])

    ct = F.col(content_type) if content_type else F.lit(None).cast("string")
    return files.withColumn("extraction", read(F.col(content), F.col(ext), ct))
