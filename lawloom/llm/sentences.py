"""Sentence boundaries across languages and scripts (problem 8).

Document-centred disambiguation: whether a token with a period is an abbreviation, and whether a capitalised word after
it is a name, is settled from unambiguous occurrences elsewhere in the same document; where the document is silent, from
rates over the whole corpus. Terminators, quotation marks and the role of white space follow the script around them.

The corpus speaks in rates, never in absolute counts, so that a key does not change sides because the corpus grew: the rate
at which a token with a period stands last in its block, held against the rate of all such tokens by a log-likelihood
ratio; the share of a word's capitalised occurrences that open a block; the share of a start that follows a full stop.

Two narrow passes: the first counts evidence inside ``mapInPandas`` (folded to one row per key and batch before the
shuffle), the second cuts the documents with the keys that the rates settled. They are broadcast while they are counted
to be few; beyond, each document gets just its own keys by a join. No shuffle of texts but in that case.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawloom.session import materialize, spread

# Marks of list items, brackets, quotation marks, terminators.
_MARKER = re.compile(
    r"[ \t　]*(?:[□■○●◦◆◇▶▷▪▫•‣ㅇ※·☞★☆✓\-–—*+][ \t]+|[□■○●◆◇▶▷•ㅇ※☞①-⑳㉠-㉻⒜-⒵]"
    r"|\(?[0-9]{1,3}\)[ \t]*|[0-9]{1,3}\.(?=[ \t])[ \t]*|\(?[가나다라마바사아자차카타파하]\)[ \t]*|[가나다라마바사아자차카타파하]\.(?=[ \t])[ \t]*"
    r"|\(?[A-Za-z]\)[ \t]+|[ivxIVX]{1,4}[.)][ \t]+|[一二三四五六七八九十]{1,3}、|[（(][一二三四五六七八九十]{1,3}[)）])"
)
_PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "〔": "〕", "〈": "〉", "《": "》", "「": "」", "『": "』", "“": "”", "‘": "’", "„": "“", "‚": "‘", "«": "»", "‹": "›", "｢": "｣", "〝": "〟"}
_CLOSERS = set(_PAIRS.values()) | {'"', "”", "’"}
_ENDS = set(".!?。！？｡．।॥…⋯‼⁇⁈⁉")
_HARD = set("。！？｡।॥‼⁇⁈⁉")
_STOP = re.compile(r"[.!?。！？｡．।॥…⋯‼⁇⁈⁉]+")
_PERIOD = re.compile(r"(?<![^\W\d_])([^\W\d_가-힣ㄱ-ㅎ぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ](?:[\w]|\.(?=[^\W\d_])|[̀-ͯऀ-ॏ])*)\.(?=[\s,;:)\]]|$)")
_TOKEN = re.compile(r"[^\W\d_](?:[\w]|\.(?=[^\W\d_])|[̀-ͯऀ-ॏ])*$")
_WORD = re.compile(r"(?<![\w.])[A-Za-zÀ-ɏऀ-ॏ](?:[A-Za-zÀ-ɏऀ-ॏ]|\.(?=[A-Za-zÀ-ɏऀ-ॏ])){0,19}(?!\w)")
_CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f]")
_HANGUL = re.compile(r"[가-힣ㄱ-ㅎ]")
_THAI = "฀-๿"
_THAI_GAP = re.compile(rf"(?<=[{_THAI}”’\"»)\]])[ \t 　]+(?=[{_THAI}“‘\"«(\[])")
_LETTER_LIST = set("가나다라마바사아자차카타파하")
_DATE_BEFORE = re.compile(r"(?:\d{4}|['’]?\d{2})\. ?(?:\d{1,2}\. ?)?\d{0,2}$")
# German month names, words that begin sentences but are no names, endings of Korean sentences.
_MONTHS_DE = ("Januar", "Jänner", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")
_FUNCTION = frozenset(
    "The A An This That These Those It Its In On At For From If When While Where Who What Why How He She They We I You Our Their His Her Under After Before "
    "But And Or As By To With Some Any All Each Both No Not There Here Die Der Das Ein Eine Es Sie Er Wir Im Am Bei Für Mit Nach Vor Zu Zum Zur Auf Aus "
    "Laut Rund Gilt Wann Was Wer Wie Warum Dies Diese Dieser Dieses Und Oder Aber".split()
)
_KO_FINAL = frozenset("다요까죠음함임됨")

_MARKS = re.compile("[" + re.escape("".join(_PAIRS) + "".join(_PAIRS.values())) + "\"]")
_BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+|\r\n[^\S\n]*(?:\r?\n[^\S\n]*)+")
_SMALL_NAME = re.compile(r"[a-z]{1,2}[A-Z]")
_ANY_THAI = re.compile(f"[{_THAI}]")
_OPENING = re.compile(r"([A-ZÄÖÜ][a-zäöüß]+) [a-zäöüß]")
_AFTER_STOP = re.compile(r"[。！？｡]\s*([^\W\d_]{2})")
_AFTER_ELLIPSIS = re.compile(r"[…⋯]+\s*([^\W\d_]{2})")
_INSIDE_WORD = re.compile(r"(?<=[\w,;] )([A-ZÄÖÜ]?[a-zäöüß]+)\b")
_INSIDE_NAME = re.compile(r"(?<=[\w,;] )([A-ZÄÖÜ][a-zäöüß]+)\b")
_ANY_LATIN = re.compile(r"[A-Za-zÀ-ɏऀ-ॏ]")

#: Settled keys up to this number (some tens of bytes each) are sent to every task.
_FEW = 100_000


def _blocks(text: str) -> list[tuple[int, int]]:
    """Stretches between blank lines, cut again before lines that open with a list marker."""
    out = []
    at = 0
    for m in [*_BLANK.finditer(text), None]:
        a, b = at, (m.start() if m else len(text))
        at = m.end() if m else at
        start, line = a, a
        while line < b:
            if line > a and (g := _MARKER.match(text, line, b)) and _real_marker(text, a, line, g.end(), b):
                out.append((start, line))
                start = line
            nxt = text.find("\n", line, b)
            line = b if nxt < 0 else nxt + 1
        if start < b:
            out.append((start, b))
    return out


def _real_marker(text: str, a: int, line: int, end: int, b: int) -> bool:
    """A number with a period that opens a line may belong to a date or reference wrapped before it."""
    mark = text[line:end].strip()
    if not (mark[:-1].isdigit() and mark.endswith(".")):
        return True
    rest = text[end : end + 12]
    before = text[a:line].rstrip()
    if rest[:1].isdigit() or rest.startswith(_MONTHS_DE):
        return False
    if re.search(r"\d{4}\. ?\d{1,2}\.$", before) or (before and before[-1] not in _ENDS and rest[:1].islower()):
        return False
    return not re.search(r"(?:\b(?:am|zum|vom|bis|und|der|dem|den|ab|No|Nr|제)|[,;(])$", before)


def _quotes(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Outermost quotations and brackets of a block as (index of opening mark, index of closing mark). Marks without a
    partner in the block do not count."""
    marks = [m.start() for m in _MARKS.finditer(text, a, b)]
    if len(marks) < 2:
        return []
    spans, stack = [], []
    straight = [i for i in marks if text[i] == '"']
    partner = dict(zip(straight[::2], straight[1::2]))
    closing_straight = set(straight[1::2])
    for i in marks:
        ch = text[i]
        if ch == '"':
            if i in partner:
                stack.append(('"', i))
            elif i in closing_straight:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == '"':
                        spans.append((stack[k][1], i))
                        del stack[k:]
                        break
            continue
        hit = False
        if stack and ch in _CLOSERS and not (ch == "’" and i + 1 < b and text[i - 1].isalnum() and text[i + 1].isalpha() and text[i + 1].isascii()):
            for k in range(len(stack) - 1, -1, -1):
                if _PAIRS.get(stack[k][0]) == ch or (stack[k][0] == "„" and ch == "”"):
                    spans.append((stack[k][1], i))
                    del stack[k:]
                    hit = True
                    break
        if not hit and ch in _PAIRS and not (ch == "‘" and i > a and text[i - 1].isalnum()):
            stack.append((ch, i))
    spans.sort()
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if not out or s > out[-1][1]:
            out.append((s, e))
    return out


class Evidence:
    """What the corpus settles: tokens that are abbreviations and whether they may end a sentence, and starts of sentences."""

    def __init__(self, abbreviations: dict[str, bool], starts: frozenset[str]):
        self.abbreviations, self.starts = abbreviations, starts


def _small(after: str) -> bool:
    """Whether what follows opens with a small letter; names like iTrade count as capitalised."""
    return after[0].islower() and not _SMALL_NAME.match(after)


def _token_before(text: str, a: int, i: int) -> str:
    m = _TOKEN.search(text, max(a, i - 40), i)
    return m.group() if m else ""


def _period_tokens(text: str, blocks: list[tuple[int, int]]) -> tuple[Counter, Counter, Counter]:
    """Tokens with a period: all their occurrences, those inside a sentence beyond doubt (before a small letter, a digit or a
    comma) and those at the end of a block."""
    total: Counter = Counter()
    inside: Counter = Counter()
    end: Counter = Counter()
    for a, b in blocks:
        stop = a + len(text[a:b].rstrip())
        for m in _PERIOD.finditer(text, a, stop):
            token = m.group(1)
            if len(token) > 20 or _HANGUL.search(token) or _CJK.search(token):
                continue
            total[token] += 1
            after = text[m.end() : min(stop, m.end() + 40)].lstrip()
            if not after or (after[0] in _CLOSERS and len(after) == 1):
                end[token] += 1
            elif after[0] in ",;:" or _small(after) or after[0].isdigit() or (after[0] == ")" and after[1:].lstrip()[:1].islower()):
                inside[token] += 1
    return total, inside, end


def _bare_words(text: str) -> Counter:
    """Words in Latin letters or Devanagari, with a period or without."""
    return Counter(_WORD.findall(text)) if _ANY_LATIN.search(text) else Counter()


def _block_starts(text: str, blocks: list[tuple[int, int]]) -> Counter:
    """Words that open a block before a small letter; two-character starts of a block or after a full stop in scripts
    without spaces."""
    out: Counter = Counter()
    for a, b in blocks:
        marker = _MARKER.match(text, a, b)
        at = marker.end() if marker else a
        while at < b and text[at].isspace():
            at += 1
        if m := _OPENING.match(text, at, b):
            out[m.group(1)] += 1
        elif at + 1 < b and _CJK.match(text[at]):
            out[text[at : at + 2]] += 1
    for m in _AFTER_STOP.findall(text):
        out[m] += 1
    return out


class _Document:
    """Evidence of one document over that of the corpus, each part gathered when it is first asked for."""

    def __init__(self, text: str, blocks: list[tuple[int, int]], corpus: Evidence):
        self.text, self.blocks, self.corpus = text, blocks, corpus
        self._own: dict[str, bool | None] | None = None
        self._starts: Counter | None = None
        self._words: Counter | None = None

    def may_end(self, token: str) -> bool | None:
        """Whether a known abbreviation may end a sentence; None if the token is none."""
        if self._own is None:
            self._own = {}
            total, inside, end = _period_tokens(self.text, self.blocks)
            bare = _bare_words(self.text)
            for t, n in total.items():
                if inside[t] and bare[t] - n <= n:
                    self._own[t] = self.corpus.abbreviations.get(t, False) or end[t] > 0
                elif end[t] and t not in self.corpus.abbreviations:
                    self._own[t] = None
        return self._own[token] if token in self._own else self.corpus.abbreviations.get(token)

    def starts(self, word: str) -> bool:
        """Whether the word opens sentences, in the corpus or in this document."""
        if word in self.corpus.starts:
            return True
        if self._starts is None:
            self._starts = _block_starts(self.text, self.blocks)
        return word in self._starts

    def inside(self, word: str) -> bool:
        """Whether the word stands inside a sentence of this document."""
        if self._words is None:
            self._words = Counter(_INSIDE_WORD.findall(self.text))
        return word in self._words


def _ends_sentence(text: str, a: int, b: int, s: int, e: int, k: int, known: _Document) -> bool:
    """Whether the terminators text[s:e], with closing marks up to ``k``, end a sentence of the block (a, b)."""
    run = text[s:e]
    rest = text[k:b]
    after = rest.lstrip()
    if not after:
        return True
    gap = len(rest) - len(after)
    nxt = after[0]
    prev = text[s - 1] if s > a else " "
    if any(ch in _HARD for ch in run):
        return True
    if run[0] in "…⋯" or run.startswith("..."):
        if _small(after) or nxt in ",;:、，)" or (re.match("[ऀ-ॿ]", nxt) and re.match("[ऀ-ॏ ]", prev)):
            return False  # Hindi sentences end in a danda
        if _CJK.match(prev):
            return nxt in _PAIRS or known.starts(after[:2])
        if _CJK.match(nxt):
            return known.starts(after[:2])
        if _HANGUL.match(nxt):
            return prev in _KO_FINAL and prev != "임" if _HANGUL.match(prev) else gap > 0  # many nouns end in 임
        return gap > 0
    if "!" in run or "?" in run:
        if gap == 0:
            return bool(_CJK.match(nxt) or _CJK.match(prev))
        return not _small(after)
    if run == "．":
        return not nxt.isdigit()
    # an ordinary period
    if gap == 0:
        # Korean sentences may follow each other without a blank
        return bool(_HANGUL.match(nxt) and prev in _KO_FINAL and _HANGUL.match(text[s - 2 : s - 1] or " "))
    if _small(after) or nxt in ",;:、，":
        return False
    if re.match(rf"[ऀ-ॿ{_THAI}]", prev):
        return False
    if prev.isdigit():
        m = re.search(r"(\d+)$", text[max(a, s - 12) : s])
        number = m.group(1) if m else ""
        if _DATE_BEFORE.search(text[max(a, s - 14) : s]) and (len(number) == 4 and re.match(r"\d{1,2}\.", after) or len(number) <= 2):
            return False
        if len(number) <= 2 and after.startswith(_MONTHS_DE):
            return False
        before = text[a : s - len(number)].rstrip()
        if len(number) <= 2 and _HANGUL.match(nxt) and before and (before[-1] == "," or _HANGUL.match(before[-1])):
            return False  # items counted within a Korean sentence
        if re.match(r"\d{1,2}\.(?:\s|$)", after) and len(number) in (2, 4):
            return False
        return True
    token = _token_before(text, a, s)
    if _HANGUL.search(token):
        if token in _LETTER_LIST:
            return False
        return True
    if not token:
        return True
    if len(token) == 1 and token.isalpha():
        return bool(after.split()[0].strip(".,") in _FUNCTION) and token.isupper()
    may_end = known.may_end(token)
    if may_end is not None or ("." in token and len(token) <= 8):
        if may_end is False or nxt.isdigit():
            return False
        m = re.match(r"[“\"‘„(\[]?([^\W\d_]+)", after)
        word = m.group(1) if m else ""
        if _HANGUL.match(word) or _CJK.match(word):
            # a Western abbreviation inside Korean goes on; after a Western sentence a Korean one begins
            lead = text[a : s - len(token)].rstrip()
            return bool(lead) and lead[-1].isascii() and lead[-1].isalpha()
        if known.starts(word):  # opens sentences elsewhere, be it a name or not: the abbreviation may end one, so it does
            return True
        if known.inside(word):  # capitalised inside a sentence of this document: a name
            return False
        return word in _FUNCTION or known.inside(word.lower())
    return True


def split_sentences(text: str, corpus: Evidence) -> list[tuple[int, int]]:
    """(start, end) of every sentence in code points."""
    if not text:
        return []
    blocks = _blocks(text)
    known = _Document(text, blocks, corpus)
    thai = _ANY_THAI.search(text) is not None
    out: list[tuple[int, int]] = []

    def add(x: int, y: int) -> None:
        piece = text[x:y]
        lead = len(piece) - len(piece.lstrip())
        piece = piece.strip()
        if piece:
            out.append((x + lead, x + lead + len(piece)))

    for a, b in blocks:
        marker = _MARKER.match(text, a, b)
        at = a
        quotes = _quotes(text, a, b)
        qi = 0
        pos = marker.end() if marker and marker.end() < b else a
        cuts: list[int] = []
        events = [(m.start(), 0, m.end()) for m in _STOP.finditer(text, pos, b)]
        if thai:
            events = sorted(events + [(m.start(), 1, m.end()) for m in _THAI_GAP.finditer(text, pos, b)])
        inner_end: dict[int, int] = {}
        for s, kind, e in events:
            while qi < len(quotes) and quotes[qi][1] < s:
                qi += 1
            if qi < len(quotes) and quotes[qi][0] < s < quotes[qi][1]:
                if kind == 0 and e == quotes[qi][1]:
                    inner_end[qi] = s
                continue
            if kind == 1:
                if text[s - 1] in _CLOSERS and not re.match(rf"[{_THAI}]", text[e : e + 1]):
                    continue
                cuts.append(e)
                continue
            k = e
            while k < b and text[k] in _CLOSERS and not any(q[0] == k for q in quotes[qi : qi + 2]):
                k += 1
            if _ends_sentence(text, a, b, s, e, k, known):
                cuts.append(k)
        # a quotation that ends with a terminator ends its sentence if it was led in, or if it is all of it
        opens = {q[0] for q in quotes} if inner_end else set()
        plain = list(cuts)
        for q, s in inner_end.items():
            open_at, close = quotes[q]
            k = close + 1
            while k < b and text[k] in _CLOSERS and k not in opens:
                k += 1
            rest = text[k:b]
            after = rest.lstrip()
            if not after or after[0] in _ENDS or after[0] in ",;:、，)":
                continue
            at_most = bisect.bisect_right(plain, open_at)
            last = max(plain[at_most - 1] if at_most else pos, max((c for c in cuts[len(plain) :][-2:] if c <= open_at), default=pos))
            lead = text[last:open_at].strip()
            spaced = len(rest) > len(after)
            bracket = text[open_at] in "([（［【〔〈《{"
            if _CJK.match(after[0]) or _CJK.match(text[s - 1]):
                ends = (not bracket and lead.endswith(("：", ":", "说", "道", "称", "，"))) or (bracket and lead == "" and spaced)
                if not spaced and bracket:
                    ends = False
            elif bracket:
                ends = lead == "" and spaced and not after[0].islower()
            elif re.match(rf"[{_THAI}]", after[0]):
                ends = False
            elif _HANGUL.match(after[0]):
                ends = spaced and text[s] == "." and lead == ""
            else:
                ends = spaced and not after[0].islower() and (lead != "" or text[s] == ".")
            if ends:
                cuts.append(k)
        for c in sorted(set(cuts)):
            if c > at:
                add(at, c)
                at = c
        add(at, b)
    return out


def observe(text: str) -> tuple[Counter, Counter]:
    """What a document adds to the corpus: of tokens with a period (token, kind) counts, kind one of all, inside, end, bare
    (without a period); of starts the kinds start, ellipsis (after one) and inside (capitalised inside a sentence)."""
    blocks = _blocks(text)
    tokens: Counter = Counter()
    total, inside, end = _period_tokens(text, blocks)
    for kind, counts in (("all", total), ("inside", inside), ("end", end)):
        for t, n in counts.items():
            tokens[t, kind] = n
    for t, n in _bare_words(text).items():
        if rest := n - total[t]:
            tokens[t, "bare"] = rest
    starts: Counter = Counter()
    for k, n in _block_starts(text, blocks).items():
        if not _HANGUL.match(k):
            starts[k, "start"] = n
    for k in _AFTER_ELLIPSIS.findall(text):
        if _CJK.match(k):
            starts[k, "ellipsis"] += 1
    for k in _INSIDE_NAME.findall(text):
        starts[k, "inside"] += 1
    return tokens, starts


def corpus_evidence(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """kind, key, may_end: what the rates over all documents settle. ``abbreviation`` keys are tokens with a period,
    ``start`` keys capitalised words, or two-character starts that also follow an ellipsis somewhere."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tokens: Counter = Counter()
            starts: Counter = Counter()
            for text in pdf.t:
                t, s = observe(text)
                tokens.update(t)
                starts.update(s)
            rows = [("abbreviation", k, tokens[k, "inside"], tokens[k, "end"], tokens[k, "all"], tokens[k, "bare"]) for k in {k for k, _ in tokens}]
            rows += [("start", k, starts[k, "start"], starts[k, "ellipsis"], starts[k, "inside"], 0) for k in {k for k, _ in starts}]
            yield pd.DataFrame(rows, columns=["kind", "key", "x", "y", "z", "bare"])

    sums = (
        spread(documents.select(text_col)).select(F.col(text_col).cast("string").alias("t")).where(F.length("t") > 0)
        .mapInPandas(count, "kind string, key string, x bigint, y bigint, z bigint, bare bigint")
        .groupBy("kind", "key").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum("z").alias("z"), F.sum("bare").alias("bare"))
    )
    sums = materialize(sums.where((F.col("kind") == "start") & (F.col("x") > 0) | (F.col("kind") == "abbreviation") & (F.col("z") > 0)), "evidence")
    abbreviation = F.col("kind") == "abbreviation"
    x, y, z, bare = (F.col(c).cast("double") for c in ("x", "y", "z", "bare"))
    rate = sums.where(abbreviation).agg((F.sum("y") / F.sum("z")).alias("r")).first().r or 0.0
    rate = min(max(rate, 0.01), 0.5)  # how often a token with a period stands last in its block
    # inside sentences often enough; or last far less often than tokens with a period are, beyond chance: twice the log of
    # the ratio of the likelihoods of its own rate and of the common one; words that stand mostly without a period are none
    own = y / z
    ratio = 2 * (F.when(y > 0, y * F.log(own / rate)).otherwise(0.0) + F.when(z > y, (z - y) * F.log((1 - own) / (1 - rate))).otherwise(0.0))
    inside = (x >= 0.1 * z) & (x > 0) & (bare <= z)
    never_last = (own <= rate / 10) & (ratio >= _SURE) & (bare <= 0.02 * z)
    settled = abbreviation & (inside | never_last)
    latin = F.col("key").rlike("^[A-ZÄÖÜ]")
    starts = (F.col("kind") == "start") & F.when(latin, x >= _OPENS * (x + z)).otherwise((y > 0) & (x >= y))
    return sums.where(settled | starts).select("kind", "key", F.when(abbreviation, own >= rate / 10).alias("may_end"))


#: Log-likelihood ratio from which a token that is hardly ever last counts as an abbreviation; share of the capitalised
#: occurrences of a word that must open blocks for it to count as a start.
_SURE = 3.0
_OPENS = 0.3


def _needs(text: str) -> set[str]:
    """All keys a document may ask the corpus for: its tokens before periods, the words and the pairs of characters after
    terminators."""
    out: set[str] = set()
    for m in _STOP.finditer(text):
        out.add(_token_before(text, 0, m.start()))
        after = text[m.end() : m.end() + 60].lstrip("".join(_CLOSERS) + " \t\r\n　")
        out.add(after[:2])
        if w := re.match(r"[“\"‘„(\[]?([^\W\d_]+)", after):
            out.add(w.group(1))
    return out - {""}


def sentences(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", few: int = _FEW) -> DataFrame:
    """One row per sentence: doc_id, sentence_no from 0, start_pos, end_pos (code points, end exclusive, outer white
    space left out), sentence.

    Null, empty and blank texts have no sentence; repeated ids are each cut; other columns are ignored; texts of any
    length are cut whole; empty table, empty result. Keys the corpus settles are broadcast up to ``few``; beyond, each
    document is joined with those it may ask for, with the same result.
    """
    known = materialize(corpus_evidence(documents, text_col), "keys")
    rows = spread(documents.select(id_col, text_col)).select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).cast("string").alias("t")).where(F.length("t") > 0)
    schema = "doc_id bigint, sentence_no int, start_pos int, end_pos int, sentence string"
    columns = ["doc_id", "sentence_no", "start_pos", "end_pos", "sentence"]
    if known.count() <= few:
        keys = known.collect()
        shared = documents.sparkSession.sparkContext.broadcast(
            ({r.key: r.may_end for r in keys if r.kind == "abbreviation"}, frozenset(r.key for r in keys if r.kind == "start"))
        )

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            evidence = Evidence(*shared.value)
            for pdf in batches:
                yield pd.DataFrame([(i, n, s, e, t[s:e]) for i, t in zip(pdf.i, pdf.t) for n, (s, e) in enumerate(split_sentences(t, evidence))], columns=columns)

        return rows.mapInPandas(cut, schema)

    def asks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(u, k) for u, t in zip(pdf.u, pdf.t) for k in _needs(t)], columns=["u", "key"])

    def cut_own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, t, found in zip(pdf.i, pdf.t, pdf.found):
                mine = list(found) if found is not None else []
                evidence = Evidence({k["key"]: k["may_end"] for k in mine if k["kind"] == "abbreviation"}, frozenset(k["key"] for k in mine if k["kind"] == "start"))
                out += [(i, n, s, e, t[s:e]) for n, (s, e) in enumerate(split_sentences(t, evidence))]
            yield pd.DataFrame(out, columns=columns)

    # texts are named by two hashes, so copies ask once; a key that most documents ask for is spread over 32 parts
    named = rows.withColumn("u", F.concat_ws("-", F.xxhash64("t"), F.hash("t"), F.length("t")))
    asked = named.select("u", "t").mapInPandas(asks, "u string, key string").withColumn("part", F.pmod(F.hash("u"), F.lit(32)))
    spread_keys = known.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(31))))
    found = asked.join(spread_keys, ["key", "part"]).groupBy("u").agg(F.collect_set(F.struct("kind", "key", "may_end")).alias("found"))
    return named.join(found, "u", "left").select("i", "t", "found").mapInPandas(cut_own, schema)


def p8_sentences(spark, root: str) -> DataFrame:
    return sentences(spark.read.parquet(f"{root}/documents.parquet"))


def p8_found(spark, root: str) -> DataFrame:
    return p8_sentences(spark, root).select("doc_id", "start_pos", "end_pos")
