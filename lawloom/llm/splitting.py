"""Cutting oversized texts at natural boundaries, with overlap (problem 3).

Agglomerative merging: a text falls into atomic segments (lines and sentences; words or grapheme runs of those that are
themselves too long); adjacent pairs wait in a heap ordered by the strength of the boundary between them; the
weakest boundaries are merged away first as long as the merged size plus overlap fits. What remains are pieces whose
cuts stand at the strongest boundaries. One narrow pass over the table, no shuffle: texts within the limit never leave
the JVM, the others are cut inside ``mapInPandas``.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strength of a boundary: blank line, line break before a heading or list item, line break, sentence end, clause end,
#: blank, none (inside a word).
BLANK_LINE, ITEM, LINE, SENTENCE, CLAUSE, SPACE, NONE = 6, 5, 4, 3, 2, 1, 0
NAMES = {BLANK_LINE: "paragraph", ITEM: "item", LINE: "line", SENTENCE: "sentence", CLAUSE: "clause", SPACE: "space", NONE: "hard"}

_COARSE = re.compile(r"(?P<break>[ \t]*(?:\r\n|\n|\r)[ \t\r\n]*)|(?P<end>[.!?。！？।…]+[\"'”’)\]」』》]*(?:[ \t]+|(?<=[。！？।])))")
_FINE = re.compile(r"(?P<clause>[,;:·、，；]+[ \t\r\n]*)|(?P<space>[ \t\r\n]+)")
_ITEM = re.compile(r"(?:[□○●◆■▶※ㅇ·\-*•#]|\(?[0-9가-하①-⑳]{1,3}[.)]|제\d+[장절조])\s?")
_MARKS = re.compile(r"[̀-ͯัิ-ฺ็-๎ऀ-ःऺ-ॏᅠ-ᇿ‍︀-️⃐-⃿゙゚\U0001f3fb-\U0001f3ff]")


def _joined(text: str, at: int) -> bool:
    """Whether a cut before ``at`` would part what is one character to a reader."""
    ch = text[at]
    return bool(_MARKS.match(ch)) or unicodedata.combining(ch) > 0 or text[at - 1] == "‍" or (ch == "\n" and text[at - 1] == "\r")


def _atoms(text: str, size: int, first: int) -> tuple[list[int], list[int]]:
    """Ends of the atomic segments and the strength of the boundary at each end. No segment exceeds ``size``, the one at
    the start of the text, which needs no room for overlap, ``first``."""
    ends, strengths = [], []
    for m in _COARSE.finditer(text):
        if m.lastgroup == "break":
            gap = m.group()
            breaks = gap.count("\n") or gap.count("\r")
            s = BLANK_LINE if breaks > 1 else ITEM if _ITEM.match(text, m.end()) else LINE
        else:
            s = SENTENCE
        ends.append(m.end())
        strengths.append(s)
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
        strengths.append(BLANK_LINE)
    out_e, out_s, at = [], [], 0
    for e, s in zip(ends, strengths):
        if e - at > size:
            for m in _FINE.finditer(text, at, e):
                if m.end() < e:
                    _cut_word(text, out_e[-1] if out_e else 0, m.end(), size, first, out_e, out_s)
                    out_e.append(m.end())
                    out_s.append(CLAUSE if m.lastgroup == "clause" else SPACE)
        _cut_word(text, out_e[-1] if out_e else 0, e, size, first, out_e, out_s)
        out_e.append(e)
        out_s.append(s)
        at = e
    return out_e, out_s


def _cut_word(text: str, a: int, b: int, size: int, first: int, ends: list[int], strengths: list[int]) -> None:
    while b - a > (most := first if a == 0 else size):
        cut = a + most
        while cut > a + 1 and _joined(text, cut):
            cut -= 1
        if cut == a + 1:  # marks without end: cut among them rather than exceed the limit
            cut = a + most
        ends.append(cut)
        strengths.append(NONE)
        a = cut


def split_text(text: str, max_chars: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """(start, core_start, end, boundary) of each piece. text[start:end] has at most ``max_chars`` code points, cores
    follow each other without gap, and text[start:core_start] are the ``overlap`` characters before the core. boundary
    names what stands at the end. Empty text has no piece."""
    if not 0 <= overlap < max_chars:
        raise ValueError("0 <= overlap < max_chars is required")
    if not text:
        return []
    if len(text) <= max_chars:
        return [(0, 0, len(text), "end")]
    room = max_chars - overlap
    ends, strengths = _atoms(text, room, max_chars)
    n = len(ends)
    start = [0, *ends[:-1]]
    following, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(strengths[i], ends[i + 1] - start[i], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, size, i, j = heapq.heappop(heap)
        if not alive[i] or not alive[j] or following[i] != j or ends[j] - start[i] != size:
            continue
        if size > (max_chars if start[i] == 0 else room):
            continue  # sizes only grow: this boundary stays
        ends[i], strengths[i], alive[j] = ends[j], strengths[j], False
        following[i] = k = following[j]
        if k < n:
            before[k] = i
            heapq.heappush(heap, (strengths[i], ends[k] - start[i], i, k))
        if (h := before[i]) >= 0:
            heapq.heappush(heap, (strengths[h], ends[i] - start[h], h, i))
    cores = [i for i in range(n) if alive[i]]
    return [(max(0, start[i] - overlap), start[i], ends[i], NAMES[strengths[i]] if ends[i] < len(text) else "end") for i in cores]


_SCHEMA = "source_table string, row_id bigint, piece_no int, n_pieces int, start_pos int, core_start int, end_pos int, boundary string, long_run int, piece_text string"


def split_records(records: DataFrame, source_table: str, id_col: str, text_col: str, max_chars: int, overlap_chars: int) -> DataFrame:
    """The ordered pieces of every text: source_table, row_id, piece_no from 0, n_pieces, positions in code points,
    boundary at the end, long_run (1 if the text has more than ``max_chars`` consecutive characters without white
    space) and piece_text.

    Texts within the limit are one piece. Null and empty texts give no row; texts of white space are text; repeated
    ids are cut each for itself; other columns are ignored; texts of any length are cut whole; empty table, empty
    result.
    """
    if not 0 <= overlap_chars < max_chars:
        raise ValueError("0 <= overlap_chars < max_chars is required")
    rows = records.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") > 0)
    short = rows.where(F.length("text") <= max_chars).select(
        F.lit(source_table).alias("source_table"), "row_id", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start_pos"),
        F.lit(0).alias("core_start"), F.length("text").alias("end_pos"), F.lit("end").alias("boundary"), F.lit(0).alias("long_run"), F.col("text").alias("piece_text"),
    )
    return short.unionByName(split_oversized(rows, source_table, max_chars, overlap_chars))


def split_oversized(rows: DataFrame, source_table: str, max_chars: int, overlap_chars: int) -> DataFrame:
    """The pieces of the rows (row_id, text) beyond the limit."""
    run = re.compile(r"[^ \t\n\r]{%d}" % (max_chars + 1))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        for pdf in batches:
            out = []
            for i, text in zip(pdf.row_id, pdf.text):
                pieces = split_text(text, max_chars, overlap_chars)
                long_run = int(run.search(text) is not None)
                out += [(source_table, i, k, len(pieces), a, c, e, b, long_run, text[a:e]) for k, (a, c, e, b) in enumerate(pieces)]
            yield pd.DataFrame(out, columns=names)

    return rows.where(F.length("text") > max_chars).mapInPandas(cut, _SCHEMA)


#: Table, id and text column of the texts with limits.
TEXTS = (("articles", "id", "content_text"), ("attachment_extractions", "id", "text_content"))


def _limits(spark, root: str) -> dict[str, tuple[int, int]]:
    # a table of parameters with one row per text table; read by the driver as such
    return {r.source_table: (r.max_chars, r.overlap_chars) for r in spark.read.parquet(f"{root}/split_limits.parquet").collect()}


def p3_pieces(spark, root: str) -> DataFrame:
    limits, out = _limits(spark, root), None
    for name, id_col, text_col in TEXTS:
        pieces = split_records(spark.read.parquet(f"{root}/{name}.parquet"), name, id_col, text_col, *limits[name])
        out = pieces if out is None else out.unionByName(pieces)
    return out


def p3_found(spark, root: str) -> DataFrame:
    limits, out = _limits(spark, root), None
    for name, id_col, text_col in TEXTS:
        rows = spark.read.parquet(f"{root}/{name}.parquet").select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text"))
        pieces = split_oversized(rows, name, *limits[name])
        out = pieces if out is None else out.unionByName(pieces)
    return out.where("piece_no = 0").select("source_table", "row_id", "long_run")
