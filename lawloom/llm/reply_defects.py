"""Defective prompt and response pairs (problem 2).

Noisy labelling functions look at different evidence: the provider's envelope, the structure of the reply, its length against
what replies usually have, its n-grams against the prompt's, its scripts and its function words. Each function grades a pair
on a few levels, so that thresholds of one quantity are one function and not several that agree by construction. For every
defect a label model fitted by expectation-maximisation over the counts of graded pairs learns how far each level can be
trusted; functions that still agree within a class are weighed down by what they share. A pair keeps every defect whose
posterior reaches that defect's cutoff. Cutoffs are validated on all good pairs, each spoilt on purpose:
cut at any place, exchanged for a slice of the prompt or held against a prompt that asks for another language, and on all declined replies known
from their envelopes, which are hidden for the test.

Three narrow passes over all rows: the first sums endings, numbers of headings and lengths, the second writes one small number for each defect
of a row to the shared folder, the third counts the numbers of spoilt pairs; only counts per defect and number, bounded by the levels, reach the driver.
"""

from __future__ import annotations

import html
import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawloom.session import materialize, spread

DEFECTS = ("empty", "refusal", "copy", "truncated", "other_language")

# Words of refusals (sought in small letters), placeholders, languages.
_REFUSAL = re.compile(
    r"도와드리기 (?:어렵|힘들)|(?:제공|답변|작성|수행|지원|응답|말씀|처리|도움)[가-힣]{0,3} ?(?:해 ?)?(?:드릴|할|드리기)? ?수 ?(?:는 |가 )?없|응답하지 않|처리하지 않|(?:사양|거절|거부)(?:하|합)|삼가|범위를 벗어나|양해"
    r"|(?:can(?:no|')t|can not|won't be able|will not be able|unable|not able|not permitted|not allowed|decline|refuse)|(?:outside|beyond) what i|prevent me from|not something i|against my|i(?:'m| am) sorry|unfortunately|may not be analysed|not comfortable"
    r"|申し訳|お応えでき|お答えでき|対応でき|できません|お手伝いでき|控えさせ|お断り|抱歉|对不起|无法|不能(?:提供|回答|协助)|拒绝|不便|leider|kann ich nicht|nicht möglich|lehne",
)
_APOLOGY = re.compile(r"^\W*(?:죄송|안타깝|유감|요청을 검토했으나|AI 모델|이 요청|As an AI|I'm sorry|I am sorry|Unfortunately|I must|Sorry|Request declined|My guidelines|申し訳|恐れ入り|抱歉|很抱歉|对不起|Leider|Es tut mir)", re.I)
_PLACEHOLDER = re.compile(
    r"\W*(?:n/?a|null|none|nil|nan|undefined|empty|blank|todo|tbd|tba|no (?:content|answer|response|output|data)|not available|coming soon|to be (?:added|written|determined|completed)|placeholder|lorem ipsum"
    r"|내용 ?없음|답변 ?없음|응답 ?없음|결과 ?없음|해당 ?없음|없음|미정|(?:추후 )?작성 ?(?:예정|중)|준비 ?중|생략|답변|응답|결과|answer|response|output|result|reply|report|内容なし|回答なし|なし|該当なし|未定|回答|无内容|无|暂无(?:内容)?|答案|回复|keine angabe|antwort)?\W*",
    re.I,
)
_LANGUAGE_NAMES = {
    "ko": r"korean|한국어|한글|국문|韓国語|韩语|koreanisch", "en": r"english|영어|영문|英語|英语|englisch", "ja": r"japanese|일본어|일어|日本語|日语|japanisch",
    "zh": r"chinese|중국어|中国語|中文|汉语|chinesisch", "de": r"german|독일어|ドイツ語|德语|deutsch", "fr": r"french|프랑스어|フランス語|法语", "es": r"spanish|스페인어|スペイン語|西班牙语",
}
_ASKED = re.compile("|".join(f"(?P<{code}>{names})" for code, names in _LANGUAGE_NAMES.items()))
_SOURCES = re.compile(r"^\s*\[(?:sources?|자료|출처|資料|来源|source_index=\d+)\]", re.I | re.M)
_CITATION = re.compile(r"\[source_index=\d+\]")
_CLOSED = re.compile(r"[.!?。！？｡।…⋯]+[\"'”’」』)）\]》>*_`~]*$")
_HEADING = re.compile(r"^\s*(?:#{1,6}(?:\s|$)|\*\*[^*]{1,60}\*\*:?\s*$)")


def unwrap(raw: str) -> tuple[str, str, bool]:
    """(answer, finish reason, whether the envelope itself is broken) of a raw reply: a provider's JSON envelope or
    plain text. What an envelope holds as a refusal is the answer if it holds no other."""
    text = raw.strip()
    if text[:1] == "{":
        try:
            j = json.loads(text)
        except ValueError:
            parts = re.findall(r'"(?:content|text)"\s*:\s*"((?:[^"\\]|\\.)*)', text)
            if not parts or not re.search(r'"(?:choices|candidates|message|parts|content)"', text):
                return raw, "", False
            body = re.sub(r"\\(?:u[0-9a-fA-F]{0,3})?$", "", "".join(parts))
            try:
                return json.loads(f'"{body}"', strict=False), "", True
            except ValueError:
                return body, "", True
        return _from_json(j)
    if text in ("null", "[]", '""'):
        return "", "", False
    return raw, "", False


def _from_json(j) -> tuple[str, str, bool]:
    if not isinstance(j, dict):
        return (j, "", False) if isinstance(j, str) else ("", "", False)
    first = (j.get("choices") or j.get("candidates") or [None])[0] if isinstance(j.get("choices") or j.get("candidates") or [], list) else None
    if isinstance(first, dict):
        finish = str(first.get("finish_reason") or first.get("finishReason") or "").lower()
        inner = first.get("message") or first.get("content") or first
        text = inner if isinstance(inner, str) else _text_of(inner)
        declined = inner.get("refusal") if isinstance(inner, dict) else None
        return (declined, "refusal", False) if isinstance(declined, str) and declined.strip() and not text.strip() else (text, finish, False)
    return _text_of(j), "", False


def _text_of(x) -> str:
    if isinstance(x, str):
        return x
    if isinstance(x, list):
        return "".join(_text_of(v) for v in x)
    if isinstance(x, dict):
        return "".join(_text_of(x[k]) for k in ("content", "parts", "text", "output_text", "output", "answer", "response", "result") if k in x)
    return ""


def own_content(answer: str) -> str:
    """The answer without markup, headings, table heads, rules, labels and placeholders."""
    text = html.unescape(re.sub(r"<[^<>]{1,200}>", " ", answer))
    text = re.sub(r"[​‌‍⁠﻿ ]", " ", text)
    kept, lines = [], text.split("\n")
    for i, line in enumerate(lines):
        bare = line.strip()
        table_head = bare.startswith("|") and i + 1 < len(lines) and re.fullmatch(r"\s*\|?[\s:|\-]+\|?\s*", lines[i + 1]) is not None and "-" in lines[i + 1]
        if not bare or bare.startswith("```") or _HEADING.match(bare) or table_head or re.fullmatch(r"[|\s:\-=*_#>.…]+", bare):
            continue
        if _PLACEHOLDER.fullmatch(re.sub(r"^[\s>*\-#|]+", "", bare)):
            continue
        kept.append(bare)
    return "\n".join(kept)


_SCRIPTS = np.array([0x41, 0x5B, 0x61, 0x7B, 0xC0, 0x250, 0x400, 0x530, 0x900, 0x980, 0xE00, 0xE80, 0x3040, 0x3100, 0x4E00, 0xA000, 0xAC00, 0xD7A4], np.uint32)
_SCRIPT_OF = np.array([0, 1, 0, 1, 0, 1, 0, 2, 0, 3, 0, 4, 0, 5, 0, 6, 0, 7, 0])  # 1 Latin, 2 Cyrillic, 3 Devanagari, 4 Thai, 5 kana, 6 Han, 7 Hangul
# Function words of languages in Latin letters.
_FUNCTION_WORDS = {"en": "the of and to is", "de": "der die und für nicht", "fr": "le les des est", "es": "el los las para una"}
_WORD_OF = {w: code for code, words in _FUNCTION_WORDS.items() for w in words.split()}
_LATIN_WORD = re.compile(r"[a-zà-ɏ]+")
_PARTICLES = {"ko": re.compile(r"[가-힣](?:은|는|이|가|을|를|의|에|로|다)(?![가-힣])"), "ja": re.compile("[のはをにがでとた]"), "zh": re.compile("[的了和在是将须由]")}


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _latin_language(text: str) -> Counter:
    return Counter(_WORD_OF[w] for w in _LATIN_WORD.findall(text.lower()) if w in _WORD_OF)


def _language(text: str) -> tuple[str, float]:
    """The main language by script, and its share; letters weigh as much as they hold."""
    n = np.bincount(_SCRIPT_OF[np.searchsorted(_SCRIPTS, _codes(text), "right")], minlength=8)
    latin, cyrillic, hindi, thai, kana, han, hangul = (float(x) for x in n[1:])
    weight = {"ko": 2.5 * hangul, "ru": cyrillic, "hi": hindi, "th": thai, "ja": 2.2 * (kana + han) if kana * 8 > han else 0.0, "zh": 0.0 if kana * 8 > han else 3.0 * han}
    if latin:
        words = _latin_language(text)
        weight[max(_FUNCTION_WORDS, key=lambda k: (words[k], k == "en"))] = latin
    total = sum(weight.values())
    best = max(weight, key=weight.get)
    return (best, weight[best] / total) if total else ("", 0.0)


def _spoken_by_words(text: str) -> str:
    """The language whose function words and particles the text uses most, whatever its script holds most of."""
    n = {code: len(pattern.findall(text)) for code, pattern in _PARTICLES.items()}
    if n["ja"] < 3 * len(re.findall("[ぁ-ん]", text[:200])) // 10:
        n["ja"] = 0
    n |= _latin_language(text)
    best = max(n, key=n.get)
    return best if n[best] >= 2 else ""


def asked_language(prompt: str) -> str:
    """The language the instruction (not the sources after it) asks for; where it names none, its own."""
    m = _SOURCES.search(prompt)
    head = prompt[: m.start()] if m and m.start() > 0 else prompt
    named = {m.lastgroup for m in _ASKED.finditer(head.lower())}
    return named.pop() if len(named) == 1 else "" if named else _language(head)[0]


def _grams(text: str, n: int = 12) -> np.ndarray:
    """Hashes of the runs of ``n`` characters, without white space and marks, in lower case."""
    for mark in ">#*|`":
        text = text.replace(mark, "")
    c = _codes("".join(text.split()).lower()).astype(np.uint64)
    size = max(1, min(n, len(c)))
    h = np.zeros(max(0, len(c) - size + 1), np.uint64)
    for j in range(size if len(c) else 0):
        h = h * np.uint64(0x100000001B3) + c[j : len(c) - size + 1 + j]
    return h


def _share(known: np.ndarray, mine: np.ndarray) -> float:
    """The share of ``mine`` that is among ``known``, which is in order."""
    if not len(known) or not len(mine):
        return 0.0
    return float((known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine).mean())


def _last_line(answer: str) -> str:
    text = re.sub(r"\s*```\s*$", "", answer.rstrip())
    line = text.rstrip().rsplit("\n", 1)[-1].strip()
    return _CITATION.sub("", line).strip()


def line_endings(answer: str) -> Counter:
    """Last words of list lines that stand complete without a full stop, because other lines follow them."""
    out: Counter = Counter()
    for line in answer.split("\n")[:-1]:
        bare = line.strip()
        if bare[:1] in "-*•ㅇ○·" and re.match(r"[-*•ㅇ○·]\s", bare):
            bare = _CITATION.sub("", bare).strip()
            if not _CLOSED.search(bare):
                out[bare.split()[-1]] += 1
    return out


class Habits:
    """What replies of the table usually have: endings of list lines, numbered headings, letters. All of them are shares of
    the table and do not change with its size."""

    def __init__(self, endings: frozenset[str] = frozenset(), headings: int = 4, letters: int = 300):
        self.endings, self.headings, self.letters = endings, headings, letters


_NUMBERED = re.compile(r"^#{1,6} *\d", re.M)

#: The functions of each defect with the chance of each level before any data: first without the defect, then with it.
_FUNCTIONS: dict[str, dict[str, tuple[tuple[float, ...], tuple[float, ...]]]] = {
    "empty": {
        "letters of its own: none, under 8, under an eighth of the usual, more": ((0.004, 0.006, 0.06, 0.93), (0.9, 0.08, 0.01, 0.01)),
        "carrier: nothing at all, plain text, envelope": ((0.005, 0.3, 0.695), (0.4, 0.3, 0.3)),
        "sentences: none complete, some": ((0.03, 0.97), (0.95, 0.05)),
    },
    "refusal": {
        "words of declining: none, some, some after an apology": ((0.95, 0.045, 0.005), (0.003, 0.397, 0.6)),
        "envelope: silent, declined or filtered": ((0.995, 0.005), (0.75, 0.25)),
        "letters against the usual: under a quarter, under a half, more": ((0.03, 0.1, 0.87), (0.9, 0.08, 0.02)),
        "headings and citations: both, one, neither": ((0.8, 0.15, 0.05), (0.01, 0.04, 0.95)),
        "share of its 12-grams in the prompt: under .4, more": ((0.96, 0.04), (0.999, 0.001)),
    },
    "copy": {
        "share of its 12-grams in the prompt: under .15, .4, .75, more": ((0.85, 0.13, 0.015, 0.005), (0.01, 0.04, 0.15, 0.8)),
        "opening: its own, the prompt's": ((0.995, 0.005), (0.4, 0.6)),
        "numbered headings: some, none": ((0.93, 0.07), (0.1, 0.9)),
        "heads of sources as lines: none, some": ((0.99, 0.01), (0.3, 0.7)),
    },
    "truncated": {
        "end: closed, whole row, known ending of a list line, open, inside a head or row or citation": ((0.7, 0.2, 0.096, 0.003, 0.001), (0.04, 0.02, 0.02, 0.62, 0.3)),
        "envelope: whole, broken": ((0.9999, 0.0001), (0.75, 0.25)),
        "finish reason: none, natural, length": ((0.3, 0.697, 0.003), (0.3, 0.3, 0.4)),
        "numbered headings against the usual: all, fewer, none": ((0.93, 0.02, 0.05), (0.15, 0.8, 0.05)),
        "end mark: none, given": ((0.93, 0.07), (0.995, 0.005)),
    },
    "other_language": {
        "script: the asked, mixed, another": ((0.95, 0.045, 0.005), (0.02, 0.13, 0.85)),
        "function words: unknown, the asked language's, another's": ((0.08, 0.9, 0.02), (0.15, 0.05, 0.8)),
        "headings: none or unknown, asked language, another": ((0.1, 0.89, 0.01), (0.3, 0.1, 0.6)),
    },
}
_RADIX = {d: tuple(len(without) for without, _ in f.values()) for d, f in _FUNCTIONS.items()}


def _grade(value: float, *bounds: float) -> int:
    return sum(value >= b for b in bounds)


class _Prompt:
    """What the functions look at in a prompt, made once for all replies it is held against."""

    def __init__(self, prompt: str):
        self.grams = np.sort(_grams(prompt))
        self.head = re.sub(r"[\s>]+", "", prompt)[:40]
        self.asked = asked_language(prompt)


def _language_levels(asked: str, answer: str, plain: str, letters: int) -> tuple[int, ...] | None:
    """The levels of ``other_language`` where ``asked`` is asked for."""
    spoken, part = _language(plain)
    if not (asked and spoken and letters >= 4):
        return None
    named = "\n".join(x for x in answer.split("\n") if _NUMBERED.match(x))
    headed = _language(named)[0] if named else ""
    words = _spoken_by_words(plain)
    return (0 if spoken == asked and part >= 0.7 else 2 if spoken != asked and part >= 0.7 else 1, 0 if not words else 1 if words == asked else 2, 0 if not headed else 1 if headed == asked else 2)


def levels(prompt: str | _Prompt, raw: str | None, habits: Habits) -> dict[str, tuple[int, ...] | None]:
    """The levels all functions give a pair, by defect; None where a defect cannot apply: without content nothing declines,
    copies, breaks off or speaks."""
    answer, finish, broken = unwrap(raw or "")
    body = own_content(answer)
    letters = sum(map(str.isalnum, body))
    plain = _CITATION.sub("", body)
    cited = len(plain) != len(body)
    headings = len(_NUMBERED.findall(answer))
    closed_lines = any(_CLOSED.search(_CITATION.sub("", x).strip()) for x in body.split("\n")) if body else False
    text = (raw or "").strip()
    out: dict[str, tuple[int, ...] | None] = dict.fromkeys(DEFECTS)
    nothing = not answer.strip()
    out["empty"] = (_grade(letters, 1, 8, max(9, habits.letters / 8)), 0 if nothing else 2 if text[:1] == "{" else 1, int(closed_lines))
    if letters == 0:
        return out
    known = prompt if isinstance(prompt, _Prompt) else _Prompt(prompt)
    share = _share(known.grams, _grams(plain))
    # refusal
    said = _REFUSAL.search(body.lower()) is not None
    declined = finish in ("safety", "content_filter", "refusal", "blocked")
    out["refusal"] = (
        0 if not said else 2 if _APOLOGY.search(body[:400]) else 1, int(declined), _grade(letters, habits.letters / 4, habits.letters / 2),
        2 - (headings > 0) - cited, _grade(share, 0.4),
    )
    # copy
    opening = bool(known.head) and known.head in re.sub(r"[\s>]+", "", answer[:600])[:400]
    out["copy"] = (_grade(share, 0.15, 0.4, 0.75), int(opening), int(headings == 0), int(re.search(r"^\W*\[(?:source_index=\d+\] .*\||sources?\]|자료\])", answer, re.I | re.M) is not None))
    # truncated
    last = _last_line(answer)
    tail = last.split()[-1] if last.split() else ""
    row = last.startswith("|")
    prior = [x for x in answer.rstrip().split("\n")[:-1] if x.strip().startswith("|")] if row else []
    whole_row = row and last.endswith("|") and (not prior or last.count("|") == prior[0].count("|"))
    closed = bool(_CLOSED.search(last)) and not re.fullmatch(r"(?:#+\s*)?(?:\S+ )?\d+\.", last) and not re.search(r"\s\d{1,3}\.$", last)
    item = bool(re.match(r"[-*•ㅇ○·]\s", last)) and tail in habits.endings
    inside = _HEADING.match(last) or (row and not whole_row) or re.search(r"\[[a-z_]*(?:=\d*)?$", last)
    end = 4 if inside else 0 if closed else 1 if whole_row else 2 if item else 3
    out["truncated"] = (
        end, int(broken), 2 if finish in ("length", "max_tokens", "max_output_tokens") else int(finish in ("stop", "end_turn")),
        2 if headings == 0 else int(headings < habits.headings), int(re.search(r"(?:^|\n)\W*(?:끝|이상|以上|end|fin|ende)\W*$", answer[-40:].rstrip(), re.I) is not None),
    )
    # other language
    out["other_language"] = _language_levels(known.asked, answer, plain, letters)
    return out


def _code(d: str, grades: tuple[int, ...] | None) -> int:
    """The levels of a defect as one number; -1 where it cannot apply."""
    if grades is None:
        return -1
    n = 0
    for g, radix in zip(grades, _RADIX[d]):
        n = n * radix + g
    return n


def _table_of(d: str) -> np.ndarray:
    """The levels behind each number of a defect."""
    return np.array(list(np.ndindex(*_RADIX[d])))


class LabelModel:
    """For each defect a two-class mixture over the levels of its functions, fitted by EM to the counts of pairs. Functions that
    depend on each other within the classes (mutual information) count less by what they share."""

    def __init__(self) -> None:
        self.posterior: dict[str, np.ndarray] = {}

    def fit(self, counts: dict[str, np.ndarray], iterations: int = 200, trust: float = 0.04) -> LabelModel:
        """``counts``: for each defect the number of pairs with each number. ``trust``: the share of the pairs for which
        the chances before any data stand."""
        for d, n in counts.items():
            x, base = _table_of(d), [np.array(f) for f in _FUNCTIONS[d].values()]
            weight = max(20.0, trust * n.sum())
            theta, prior = [b.copy() for b in base], 0.03
            share = np.ones(len(base))
            post = np.zeros(len(x))
            for step in range(iterations):
                new = self._judge(x, theta, prior, share)
                if step and np.abs(new - post).max() < 1e-7:
                    break
                post = new
                r = np.stack([n * (1 - post), n * post])
                prior = (r[1].sum() + 0.03 * weight) / (n.sum() + weight)
                for j, b in enumerate(base):
                    stat = b * weight + np.stack([np.bincount(x[:, j], r[c], b.shape[1]) for c in range(2)])
                    theta[j] = stat / stat.sum(axis=1, keepdims=True)
                if step % 10 == 9 and step < 60:
                    share = self._shares(x, r + 1e-9)
            self.posterior[d] = post
        return self

    @staticmethod
    def _judge(x: np.ndarray, theta: list[np.ndarray], prior: float, share: np.ndarray) -> np.ndarray:
        ll = np.log([[1 - prior], [prior]]) + sum(w * np.log(t[:, x[:, j]]) for j, (t, w) in enumerate(zip(theta, share)))
        return 1 / (1 + np.exp(np.clip(ll[0] - ll[1], -60, 60)))

    @staticmethod
    def _shares(x: np.ndarray, r: np.ndarray) -> np.ndarray:
        """One over the number of functions each function stands for: itself and the part of each other that its level
        tells, averaged over both classes."""
        k = x.shape[1]
        out = np.ones(k)
        for i in range(k):
            for j in range(k):
                if i == j:
                    continue
                told = 0.0
                for c in range(2):
                    joint = np.zeros((x[:, i].max() + 1, x[:, j].max() + 1))
                    np.add.at(joint, (x[:, i], x[:, j]), r[c])
                    joint /= joint.sum()
                    a, b = joint.sum(1), joint.sum(0)
                    some = joint > 0
                    mutual = (joint[some] * np.log(joint[some] / np.outer(a, b)[some])).sum()
                    entropy = min(-(a[a > 0] * np.log(a[a > 0])).sum(), -(b[b > 0] * np.log(b[b > 0])).sum())
                    told += 0.5 * (mutual / entropy if entropy > 1e-3 else 0.0)
                out[i] += told
        return 1 / out


def _spoil(prompt: str, answer: str, draw: np.random.Generator) -> list[tuple[str, str]]:
    """(defect, reply) of a good pair spoilt in ways that know nothing of the functions: the reply cut at any place
    between a fifth and nine tenths, a slice of the prompt instead of it, only its lines without a sentence."""
    cut = int(len(answer) * draw.uniform(0.2, 0.9))
    size = int(len(prompt) * draw.uniform(0.15, 1.0))
    at = int(draw.integers(0, max(1, len(prompt) - size + 1)))
    bare = "\n".join(x for x in answer.split("\n") if len(x) < 24 and not re.search(r"[.!?。？！|]", re.sub(r"^#+ *\d+\.", "", x)))
    return [("empty", bare), ("copy", prompt[at : at + size]), ("truncated", answer[:cut])]


def _bare_levels(got: dict[str, tuple[int, ...] | None], answer: str) -> dict[str, tuple[int, ...] | None] | None:
    """The levels of an answer without its envelope, made from those with it; None if the answer looks like an envelope itself."""
    text = answer.strip()
    if text[:1] == "{" or text in ("null", "[]", '""'):
        return None
    empty, refusal, truncated = got["empty"], got["refusal"], got["truncated"]
    out = got | {"empty": (empty[0], int(bool(text)), empty[2])}
    if refusal is not None:
        out |= {"refusal": (refusal[0], 0, *refusal[2:]), "truncated": (truncated[0], 0, 0, *truncated[3:])}
    return out


def spoilt_cases(key: int, prompt: str, answer: str, languages: dict[str, int], habits: Habits, known: _Prompt | None = None, whole: dict | None = None) -> Iterator[tuple[str, dict[str, tuple[int, ...] | None]]]:
    """(case, levels) of a good pair as it is (case "") and spoilt in every way. ``key`` decides the draws, so they do not depend on where a
    row lies; ``languages`` counts what the good prompts ask for: the pair is also held against a prompt that asks for another, as often as they do."""
    known = known or _Prompt(prompt)
    whole = whole or levels(known, answer, habits)
    yield "", whole
    draw = np.random.Generator(np.random.PCG64([2, key & (2**64 - 1)]))
    for case, reply in _spoil(prompt, answer, draw):
        yield case, levels(known, reply, habits)
    others = [(code, n) for code, n in sorted(languages.items()) if code and code != known.asked]
    if known.asked and others:
        ends = np.cumsum([n for _, n in others])
        other = others[int(np.searchsorted(ends, draw.integers(0, ends[-1]), "right"))][0]
        plain = _CITATION.sub("", own_content(answer))
        yield "other_language", whole | {"other_language": _language_levels(other, answer, plain, sum(map(str.isalnum, plain)))}


Cases = dict[tuple[str, str, int], int]


def best_cutoffs(model: LabelModel, cases: Cases) -> tuple[dict[str, float], dict[str, tuple[float, float]]]:
    """For each defect the cutoff of its posterior with the best F1 on good pairs, on these pairs spoilt in this
    way or one of lower precedence and on declined ones, the middle of the best range; and precision and recall there. 0.5 for a defect without
    cases. ``cases`` counts (case, defect, number of its levels)."""
    cutoffs, quality = dict.fromkeys(DEFECTS, 0.5), {}
    for d in DEFECTS:
        later = DEFECTS[DEFECTS.index(d) :]  # a pair spoilt in an earlier way may show this defect too
        known = [(c == d, k, n) for (c, of, k), n in sorted(cases.items()) if of == d and (c == "" or c in later)]
        truth, n = np.array([t for t, _, _ in known], bool), np.array([n for _, _, n in known], np.int64)
        if not truth.any():
            continue
        post = np.array([model.posterior[d][k] if k >= 0 else 0.0 for _, k, _ in known])
        edges = np.unique(np.concatenate([[0.02, 0.98], post[(post > 0.02) & (post < 0.98)]]))
        best: list[tuple[float, float]] = []
        for c in (edges[:-1] + edges[1:]) / 2:
            hit = post >= c
            best.append((2 * n[hit & truth].sum() / max(1, n[hit].sum() + n[truth].sum()), float(c)))
        top = max(f for f, _ in best)
        good_cuts = [c for f, c in best if f >= top - 1e-12]
        cutoffs[d] = good_cuts[len(good_cuts) // 2]
        hit = post >= cutoffs[d]
        quality[d] = (float(n[hit & truth].sum() / max(1, n[hit].sum())), float(n[hit & truth].sum() / n[truth].sum()))
    return cutoffs, quality


def _count_cases(cases: Counter, graded: Iterator[tuple[str, dict[str, tuple[int, ...] | None]]]) -> None:
    for case, got in graded:
        cases.update((case, d, _code(d, got[d])) for d in DEFECTS)


def validated_cutoffs(model: LabelModel, good: list[tuple[str, str]], declined: list[tuple[str, str]], habits: Habits) -> tuple[dict[str, float], dict[str, tuple[float, float]]]:
    """``best_cutoffs`` on the ``good`` pairs, spoilt on purpose, and the ``declined`` ones."""
    cases: Counter = Counter()
    languages = Counter(asked_language(p) for p, _ in good)
    for i, (prompt, answer) in enumerate(good):
        _count_cases(cases, spoilt_cases(i, prompt, answer, languages, habits))
    _count_cases(cases, (("refusal", levels(p, a, habits)) for p, a in declined))
    return best_cutoffs(model, cases)


def _completed(outputs: DataFrame, id_col: str, prompt_col: str, reply_col: str, status_col: str) -> DataFrame:
    status = F.lower(F.trim(F.regexp_replace(F.col(status_col).cast("string"), r"(?U)\s+", " ")))
    return spread(outputs.select(id_col, status_col, prompt_col, reply_col)).where(status == "completed").select(
        F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(prompt_col).cast("string"), F.lit("")).alias("p"), F.col(reply_col).cast("string").alias("r")
    )


def learn_habits(rows: DataFrame) -> Habits:
    """Habits of all replies in column r: endings that at least one list line in 2,000 has, the most frequent number of
    numbered headings, the median of letters (to a tenth)."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: Counter = Counter()
            for r in pdf.r.dropna():
                answer = unwrap(r)[0]
                seen.update(("ending", w, n) for w, n in line_endings(answer).items())
                seen["headings", str(len(_NUMBERED.findall(answer))), 1] += 1
                seen["letters", str(round(10 * math.log(1 + len(answer), 2))), 1] += 1
            totals: Counter = Counter()
            for (kind, word, n), times in seen.items():
                totals[kind, word] += n * times
            yield pd.DataFrame([(k, w, n) for (k, w), n in totals.items()], columns=["kind", "word", "n"])

    summed = materialize(rows.select("r").mapInPandas(gather, "kind string, word string, n bigint").groupBy("kind", "word").agg(F.sum("n").alias("n")), "habits")
    lines = summed.where("kind = 'ending'").agg(F.sum("n")).first()[0] or 0
    endings = frozenset(x.word for x in summed.where((F.col("kind") == "ending") & (F.col("n") >= max(3, lines / 2000))).collect())  # 2,000 at most
    most = summed.where("kind = 'headings' and word <> '0'").orderBy(F.desc("n"), F.desc(F.col("word").cast("int"))).first()
    sizes = sorted((int(x.word), x.n) for x in summed.where("kind = 'letters'").collect())  # tenths of powers of two: a few hundred
    half, run, median = sum(n for _, n in sizes) / 2, 0, 82
    for k, n in sizes:
        run += n
        if run >= half:
            median = k
            break
    return Habits(endings, int(most.word) if most else 4, int(2 ** (median / 10) * 0.7))


def reply_defects(
    outputs: DataFrame, id_col: str = "id", prompt_col: str = "llm_prompt", reply_col: str = "llm_response_raw", status_col: str = "llm_status",
) -> DataFrame:
    """One row per output whose status is completed (letter case and outer blanks ignored): output_id, labels (the
    defects whose posterior reaches its cutoff, in order of precedence), posteriors (name to value).

    A null reply counts as empty, a null prompt as empty text (no copy, no language asked for); other statuses and null
    statuses give no row; repeated ids give a row each; extra columns are ignored; an empty table gives no rows.
    Habits, levels, the label model and its cutoffs cover all rows: every pair without a sign of a defect is spoilt in every way.
    """
    rows = _completed(outputs, id_col, prompt_col, reply_col, status_col)
    habits = learn_habits(rows)
    shared = outputs.sparkSession.sparkContext.broadcast(habits)

    def grade(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for pdf in batches:
            prompts = [_Prompt(p) for p in pdf.p]
            got = [levels(p, None if r is None or r != r else r, known) for p, r in zip(prompts, pdf.r)]
            columns = {d: np.array([_code(d, g[d]) for g in got], np.int16) for d in DEFECTS}
            columns["told"] = np.array([unwrap(r)[1] == "refusal" if isinstance(r, str) and '"refusal"' in r else False for r in pdf.r], bool)
            columns["asked"] = [p.asked for p in prompts]
            yield pd.DataFrame({"id": pdf.id, **columns})

    schema = "id bigint, " + ", ".join(f"{d} smallint" for d in DEFECTS) + ", told boolean, asked string"
    graded = materialize(rows.mapInPandas(grade, schema), "levels")
    stacked = graded.select(F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.col(d).alias("k")) for d in DEFECTS])).alias("x")).select("x.d", "x.k")
    counts = {d: np.zeros(int(np.prod(_RADIX[d]))) for d in DEFECTS}
    for c in stacked.where("k >= 0").groupBy("d", "k").count().collect():  # at most the sum of the products of the levels
        counts[c.d][c.k] = c["count"]
    model = LabelModel().fit(counts)

    def posterior(d: str):
        return F.when(F.col(d) >= 0, F.element_at(F.lit(model.posterior[d].tolist()), F.col(d).cast("int") + 1)).otherwise(F.lit(0.0))

    judged = graded.select("id", "asked", *[posterior(d).alias(d) for d in DEFECTS])
    quiet = judged.where(F.greatest(*DEFECTS) < 0.05)
    languages = {x.asked: x["count"] for x in quiet.groupBy("asked").count().collect()}  # codes of languages
    fitted = outputs.sparkSession.sparkContext.broadcast(model.posterior)

    def spoil(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        habits, post = shared.value, fitted.value
        for pdf in batches:
            cases: Counter = Counter()
            for key, p, r in zip(pdf.id, pdf.p, pdf.r):
                known = _Prompt(p)
                got = levels(known, r, habits)
                answer, told, _ = unwrap(r)
                whole = _bare_levels(got, answer) or levels(known, answer, habits)
                if told == "refusal" and '"refusal"' in r:
                    _count_cases(cases, [("refusal", whole)])
                if all(got[d] is None or post[d][_code(d, got[d])] < 0.05 for d in DEFECTS):
                    _count_cases(cases, spoilt_cases(int(key), p, answer, languages, habits, known, whole))
            yield pd.DataFrame([(*c, n) for c, n in cases.items()], columns=["c", "d", "k", "n"])

    counted = rows.where("r is not null").mapInPandas(spoil, "c string, d string, k int, n bigint").groupBy("c", "d", "k").agg(F.sum("n").alias("n"))
    cutoffs, _ = best_cutoffs(model, {(x.c, x.d, x.k): x.n for x in counted.collect()})
    labels = F.filter(F.array(*[F.when(F.col(d) >= cutoffs[d], F.lit(d)) for d in DEFECTS]), lambda x: x.isNotNull())
    posteriors = F.create_map(*[x for d in DEFECTS for x in (F.lit(d), F.col(d))])
    return judged.select(F.col("id").alias("output_id"), labels.alias("labels"), posteriors.alias("posteriors"))


def p2_found(spark, root: str) -> DataFrame:
    out = reply_defects(spark.read.parquet(f"{root}/report_outputs.parquet"))
    return out.where(F.size("labels") > 0).select("output_id", F.col("labels")[0].alias("defect_type"))
