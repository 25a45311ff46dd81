"""Finding and restoring text that was read in the wrong character encoding (problem 4).

A multinomial (naive Bayes) classifier over hashed byte bigrams predicts by which chain of encodings a stretch of text
was garbled. It is trained in the driver on a bounded sample of clean records garbled on purpose; the rows themselves are
judged inside ``mapInPandas`` without a shuffle, and only rows with a character that no clean Korean or ASCII text has
leave the JVM. A predicted chain counts only after it was inverted: the stretch must decode strictly and read better
to the model of clean text than before. Chains that lost bytes (U+FFFD) cannot be inverted and are reported as lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawloom.session import spread

# Chains of (written in, read in) that occur between Korean and Western systems; the last may lose bytes.
CHAINS: dict[str, tuple[tuple[str, str], ...]] = {
    "utf8>cp1252": (("utf-8", "cp1252"),),
    "utf8>cp1252>utf8>cp1252": (("utf-8", "cp1252"), ("utf-8", "cp1252")),
    "cp949>cp1252": (("cp949", "cp1252"),),
    "utf8>mac_roman": (("utf-8", "mac_roman"),),
    "cp949>mac_roman": (("cp949", "mac_roman"),),
    "utf8>cp437": (("utf-8", "cp437"),),
    "utf8>cp1251": (("utf-8", "cp1251"),),
    "cp949>gbk": (("cp949", "gbk"),),
    "utf8>gbk": (("utf-8", "gbk"),),
    "utf8>cp932": (("utf-8", "cp932"),),
    "cp949>cp932": (("cp949", "cp932"),),
    "cp949>big5": (("cp949", "big5"),),
    "utf8>cp949": (("utf-8", "cp949"),),
    "cp949>utf8": (("cp949", "utf-8"),),
}
# Clean expressions with rare characters.
INNOCENT = (
    "½ 지분과 Ⅱ단계, ①·② 항목", "25°C ± 0.5°C, 면적은 84.9㎡", "Änderung Übersetzung für Maßnahmen", "AÇÃO REGULATÓRIA São Paulo",
    "‘Ñandú™’ “Ærø®” façade naïve café", "㈜예시 漢字 倂記 전년比 2.3%↑", "📎 😀 🔎 🧾 첨부", "€ 1,200 £ 30 ¥ 500 ₩ 9 § 12 Abs. 3", "Ελλάδα Москва Київ",
    "la comisión aprobó la revisión del régimen según el artículo según la próxima señal está más allá", "l’entrée en vigueur à l’été a été différée par le comité français dès février où ça",
    "위험\u00a0관리 · 대상 – 기관 — ‘인용’ “인용” … 말줄임 「법령」", "a decisão não será revista até março à União Política",
)

_ODD = re.compile(r"[^\x00-\x7f가-힣ㄱ-ㆎ‐-‧　-〟※□○●◆■▶▲△◇ㆍ‧×→㎡％（），．：；]")
#: The same class for the JVM's filter.
_ODD_JAVA = r"[^\x00-\x7f가-힣ㄱ-ㆎ‐-‧　-〟※□○●◆■▶▲△◇ㆍ‧×→㎡％（），．：；]"
_LOST = "�"
_FOREIGN = re.compile("[^\x00-\x7f가-힣]{2,}")
_DIMS = 1 << 14

_ALL = bytes(range(256))
_TO_CP1252 = {ord(_ALL[i : i + 1].decode("cp1252", "replace")) if _ALL[i : i + 1].decode("cp1252", "replace") != _LOST else i: i for i in range(256)}
_FROM_CP1252 = {v: chr(k) for k, v in _TO_CP1252.items()}
_TO_CP1252 |= {i: i for i in range(0x80, 0xA0)}  # readers that took Latin-1 show these bytes as control characters


def _read(data: bytes, codec: str) -> str:
    """Bytes as the wrong reader showed them; undefined bytes of cp1252 come out as control characters."""
    if codec == "cp1252":
        return "".join(_FROM_CP1252[b] for b in data)
    return data.decode(codec, "replace")


def _unread(text: str, codec: str) -> bytes:
    """The bytes behind a wrongly read text; raises where the codec cannot have shown it."""
    if codec == "cp1252":
        try:
            return bytes(_TO_CP1252[ord(ch)] for ch in text)
        except KeyError as e:
            raise UnicodeError("not of this code page") from e
    return text.encode(codec)


def garble(text: str, chain: str) -> str:
    """``text`` as the chain shows it; raises UnicodeError where it cannot have been written that way."""
    for written, read in CHAINS[chain]:
        text = _read(text.encode(written), read)
    return text


def invert(text: str, chain: str) -> str:
    """Undo ``chain``; raises UnicodeError unless every step decodes strictly."""
    for written, read in reversed(CHAINS[chain]):
        text = _unread(text, read).decode(written)
    return text


def _bigrams(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    return ((a[:-1] * 256 + a[1:]) * np.uint32(2654435761) >> np.uint32(18)) & np.uint32(_DIMS - 1)


def spans(text: str) -> list[tuple[int, int]]:
    """Stretches to judge: consecutive words of a sentence with an odd character, plain ASCII words between them
    included."""
    out: list[tuple[int, int]] = []
    open_at = end = None
    for m in re.finditer(r"[^ \t\r\n]+|\n", text):
        word = m.group()
        if word == "\n":
            odd, plain = False, False
        else:
            odd, plain = bool(_ODD.search(word)), word.isascii()
        if odd:
            open_at, end = (m.start() if open_at is None else open_at), m.end()
        if open_at is not None and (not odd and not plain or word[-1] in ".!?" or word == "\n"):
            out.append((open_at, end))
            open_at = None
    if open_at is not None:
        out.append((open_at, end))
    return out


class ChainModel:
    """Multinomial naive Bayes: one row of log probabilities over hashed byte bigrams for ``clean`` and every chain."""

    def __init__(self, labels: list[str], weights: np.ndarray):
        self.labels, self.weights = labels, weights

    @classmethod
    def train(cls, texts: list[str], smoothing: float = 0.05) -> ChainModel:
        labels = ["clean", *CHAINS]
        counts = np.full((len(labels), _DIMS), smoothing)
        for text in [*texts, *INNOCENT * max(1, len(texts) // 100)]:
            for k, label in enumerate(labels):
                try:
                    shown = text if k == 0 else garble(text, label)
                except UnicodeError:
                    continue
                if k and shown == text:
                    continue
                # whole texts teach the language, the stretches weigh what will be judged
                data = [shown.encode("utf-8", "replace")] + [shown[a:b].encode("utf-8", "replace") for a, b in spans(shown)]
                for d in data:
                    if len(d) > 1:
                        np.add.at(counts[k], _bigrams(d), 1.0)
        return cls(labels, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))

    def scores(self, text: str) -> np.ndarray:
        data = text.encode("utf-8", "replace")
        if len(data) < 2:
            return np.zeros(len(self.labels), np.float32)
        return self.weights[:, _bigrams(data)].sum(axis=1)

    def fluency(self, text: str) -> float:
        """Mean log probability of a bigram under the model of clean text."""
        data = text.encode("utf-8", "replace")
        return float(self.weights[0, _bigrams(data)].mean()) if len(data) > 1 else -20.0


def _invert_runs(stretch: str, chain: str, model: ChainModel) -> tuple[str, bool]:
    """Invert what the last codec can have shown, leave other characters; False if anything odd does not decode."""
    codec = CHAINS[chain][-1][1]
    out, run, changed = [], [], False

    def showable(ch: str) -> bool:
        try:
            _unread(ch, codec)
            return True
        except UnicodeError:
            return False

    def flush() -> bool:
        nonlocal changed
        piece = "".join(run)
        run.clear()
        if piece.isascii():
            out.append(piece)
            return True
        try:
            back = invert(piece, chain)
        except UnicodeError:
            return False
        changed |= back != piece
        out.append(back)
        return True

    for ch in stretch:
        if showable(ch):
            run.append(ch)
        else:
            if not flush():
                return stretch, False
            out.append(ch)
    if not flush():
        return stretch, False
    return "".join(out), changed


def _name(stretch: str, model: ChainModel, margin: float, legacy: bool = True) -> tuple[str | None, str]:
    """The chain that garbled ``stretch`` and the text before it, or (None, stretch). Without ``legacy`` only chains
    from UTF-8 count, whose strict decoding proves much even for two characters."""
    s = model.scores(stretch)
    order = np.argsort(-s, kind="stable")
    if _LOST in stretch:
        label = model.labels[order[0]]
        return (label if label != "clean" else None), stretch
    for k in order[:4]:
        name = model.labels[k]
        if name == "clean" or s[k] - s[0] < margin:
            break
        if not legacy and any(written != "utf-8" for written, _ in CHAINS[name]):
            continue
        back, ok = _invert_runs(stretch, name, model)
        if ok and _LOST not in back and model.fluency(back) > model.fluency(stretch):
            return name, back
    return None, stretch


def judge(text: str, model: ChainModel, margin: float = 0.0) -> tuple[list[str], str, int]:
    """Chains found in ``text``, the text with every invertible stretch restored, and the number of lost stretches."""
    chains: list[str] = []
    out, last, lost = [], 0, 0
    for a, b in spans(text):
        found, restored = _name(text[a:b], model, margin)
        pieces = [(a, b, found, restored)]
        if found is None:  # a few garbled characters may stand inside clean Korean words
            pieces = [(m.start(), m.end(), *_name(m.group(), model, margin, legacy=False)) for m in _FOREIGN.finditer(text, a, b)]
        for x, y, name, back in pieces:
            if name is not None:
                chains.append(name)
                lost += _LOST in text[x:y]
                out.append(text[last:x] + back)
                last = y
    return sorted(set(chains)), "".join(out) + text[last:], lost


def train_model(clean: DataFrame, text_col: str = "text", sample_rows: int = 600, max_chars: int = 4000) -> ChainModel:
    """Fit on a bounded sample of labelled rows: ``sample_rows`` (documented bound, default 600) records of ``clean``,
    the ones with the smallest hash of their text, so the choice is the same however the table is stored; each is
    garbled by every chain. Records beyond ``max_chars`` are left out of the sample."""
    c = F.col(text_col)
    picked = clean.where(c.isNotNull() & (F.length(c) > 20) & (F.length(c) <= max_chars) & ~c.contains(_LOST)).select(c.alias("t"), F.pmod(F.xxhash64(c), F.lit(1 << 40)).alias("h"))
    share = min(1.0, 3 * sample_rows / max(1, clean.count()))
    while True:  # a share of the hashes that holds the sample and little more, so partitions send next to nothing else
        texts = [r.t for r in picked.where(F.col("h") < int(share * (1 << 40))).orderBy("h", "t").limit(sample_rows).collect()]
        if len(texts) == sample_rows or share == 1.0:
            return ChainModel.train(texts)
        share = min(1.0, 4 * share)


def repair_encoding(records: DataFrame, model: ChainModel, fields: tuple[str, ...] = ("title", "content_text"), id_col: str = "id") -> DataFrame:
    """One row per affected field: article_id, field_name, chains, restored_text, status.

    status is ``restored`` (every garbled stretch inverted strictly), ``partly`` or ``lost`` (stretches with lost bytes
    stay as they are). Null, empty and clean texts give no row; repeated rows are each judged; other columns, whatever
    their names, are ignored; whole texts are read however long; an empty table gives an empty result.
    """
    value = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields])).alias("v")
    rows = spread(records.select(id_col, *fields)).select(F.col(id_col).cast("bigint").alias("article_id"), value).select("article_id", "v.field_name", "v.value")
    rows = rows.where(F.col("value").rlike(_ODD_JAVA))
    shared = records.sparkSession.sparkContext.broadcast((model.labels, model.weights))  # fixed size: labels x 16384 floats

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = ChainModel(*shared.value)
        for pdf in batches:
            got = []
            for i, f, v in zip(pdf.article_id, pdf.field_name, pdf.value):
                chains, text, lost = judge(v, m)
                if chains:
                    got.append((i, f, chains, text, "restored" if not lost else "lost" if text == v else "partly"))
            yield pd.DataFrame(got, columns=["article_id", "field_name", "chains", "restored_text", "status"])

    return rows.mapInPandas(run, "article_id bigint, field_name string, chains array<string>, restored_text string, status string")


def p4_found(spark, root: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{root}/{name}.parquet")
    model = train_model(read("documents"))
    return repair_encoding(read("articles"), model).select("article_id", "field_name")
