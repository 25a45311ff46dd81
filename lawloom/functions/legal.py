"""Structured parts of legal texts and of result lists about them: built-in expressions over whole texts.

A result list is cut at the starts of its entries, and each entry's fields are the values of its labelled lines; the
kinds of lists differ only in their start and labels, which ``LISTS`` states.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How entries of each kind of list begin, what of the first line is the name, and the labels of its fields.
LISTS: dict[str, tuple[str, str, dict[str, str]]] = {
    "admin_rule": (r"^\d+\.", r"^\d+\.\s*([^\n]+)", {"rule_no": "행정규칙(?:일련)?번호", "id": "행정규칙ID", "date": "(?:발령일|공포일)", "kind": "구분", "dept": "소관부처"}),
    "ordinance": (r"^\s*\[\d+\]", r"^\s*\[\d+\]\s*([^\n]+)", {"org": "(?:기관|지자체)", "date": "(?:발령일|공포일)", "eff_date": "시행일"}),
    "english_law": (r"^\s*\[[^\]]+\]", r"^\s*\[[^\]]+\]\s*([^\n]+)", {"kor_name": "한글명", "date": "시행일자", "kind": "법령구분", "link": "링크"}),
    "law": (r"^\d+\.", r"^\d+\.\s*([^\n]+)", {"law_id": "법령ID", "mst": "MST", "prom_date": "공포일", "kind": "구분"}),
    "decision": (
        r"^\d+\.\s", r"^\d+\.\s*([^\n]+)",
        {"case_num": "[^:：\\n]*번호", "court": "[^:：\\n]*(?:법원|기관|관청)[^:：\\n]*", "date": "[^:：\\n]*(?:선고일|결정일|발령일|날짜|일자)[^:：\\n]*", "kind": "[^:：\\n]*(?:구분|종류|유형)[^:：\\n]*", "summary": "[^:：\\n]*(?:주문|결론|요지|핵심)[^:：\\n]*"},
    ),
}
# Names of laws in corner brackets, and before an article.
_MENTION_QUOTED = r"[「『｢]([^」』｣]{2,80}(?:법|령|규칙|규정|고시|조례))[^」』｣]*[」』｣]"
_MENTION_PLAIN = r"([가-힣A-Za-z0-9ㆍ·\s]{2,80}(?:법|령|규칙|규정|고시|조례))\s*제\d+조"
_ARTICLE = r"(?:제\s*)?(\d+)\s*조(?:\s*의\s*(\d+))?"


def _text(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def entries(text: Column, kind: str) -> Column:
    """Array of the entries of a result list as maps: ``name``, ``tag`` (what stands in its brackets) and the labelled
    fields; missing ones are empty. Text without entries gives an empty array."""
    start, name, labels = LISTS[kind]
    blocks = F.filter(F.split(_text(text), f"(?m)(?={start})"), lambda b: b.rlike(start))
    one = lambda b: F.create_map(
        F.lit("name"), F.regexp_replace(_trim(F.regexp_extract(b, name, 1)), "<[^>]+>", ""), F.lit("tag"), F.regexp_extract(b, r"^\s*\[([^\]]+)\]", 1),
        *[x for k, label in labels.items() for x in (F.lit(k), _trim(F.regexp_extract(b, rf"(?m)^\s*(?:[-·]\s*)?{label}\s*[:：]\s*([^\n]*)$", 1)))],
    )
    return F.filter(F.transform(blocks, one), lambda m: m["name"] != "")


def legal_terms(text: Column) -> Column:
    """Names on the lines that a pin opens, in order."""
    names = F.regexp_extract_all(_text(text), F.lit(r"(?m)^📌\s*(.+?)\s*$"), F.lit(1))
    return F.filter(F.transform(names, lambda n: F.trim(F.regexp_replace(n, r"(?U)\s+", " "))), lambda n: n != "")


def found_articles(text: Column) -> Column:
    """Entries a scroll opens: law_name, article (its next line), date (the line a calendar opens), summary (up to six more)."""
    blocks = F.filter(F.split(_text(text), r"(?m)(?=^📜\s)"), lambda b: b.startswith("📜"))
    lines = lambda b: F.filter(F.transform(F.split(b, "\n"), _trim), lambda x: x != "")
    one = lambda b: F.struct(
        _trim(F.regexp_replace(F.try_element_at(lines(b), F.lit(1)), "^📜", "")).alias("law_name"), F.try_element_at(lines(b), F.lit(2)).alias("article"),
        _trim(F.regexp_extract(b, r"(?m)^\s*📅([^\n]*)$", 1)).alias("date"), F.array_join(F.slice(lines(b), 3, 6), "\n").alias("summary"),
    )
    return F.filter(F.transform(blocks, one), lambda s: s["article"].isNotNull())


def article_reference(text: Column) -> Column:
    """제N조 or 제N조의M of the first article a text names; null if it names none."""
    g = lambda k: F.regexp_extract(text, _ARTICLE, k)
    return F.when(g(1) != "", F.concat(F.lit("제"), g(1), F.lit("조"), F.when(g(2) != "", F.concat(F.lit("의"), g(2))).otherwise("")))


def without_article(text: Column) -> Column:
    """What stands before the first article a text names; if nothing does, the text without its articles."""
    before = F.trim(F.regexp_replace(F.regexp_extract(text, rf"(?s)^(.*?){_ARTICLE}", 1), r"(?U)\s+", " "))
    return F.when(before != "", before).otherwise(F.trim(F.regexp_replace(F.regexp_replace(text, _ARTICLE, " "), r"(?U)\s+", " ")))


def law_mentions(text: Column, limit: int = 12) -> Column:
    """Names of laws: those in corner brackets, then those before an article; distinct, in order of appearance."""
    quoted = F.regexp_extract_all(_text(text), F.lit(_MENTION_QUOTED), F.lit(1))
    plain = F.regexp_extract_all(_text(text), F.lit(_MENTION_PLAIN), F.lit(1))
    names = F.transform(F.concat(quoted, plain), lambda n: F.trim(F.regexp_replace(n, r"(?U)\s+", " ")))
    return F.slice(F.array_distinct(F.filter(names, lambda n: F.length(n) >= 2)), 1, limit)


def without_lines(text: Column, *marks: str) -> Column:
    """The text without the lines that begin with one of these marks."""
    kept = F.filter(F.split(_text(text), "\n"), lambda x: ~F.ltrim(x).rlike("^(?:" + "|".join(marks) + ")"))
    return _trim(F.array_join(kept, "\n"))


def supplementary_provisions(text: Column, limit: int = 800) -> Column:
    """The text from its first line that opens with 부칙, cut to ``limit``; null without one."""
    tail = F.regexp_extract(_text(text), r"(?sm)^[ \t]*(부칙.*)", 1)
    tail = _trim(F.regexp_replace(tail, r"(?m)^[ \t]+|[ \t]+$", ""))
    return F.when(tail != "", F.when(F.length(tail) > limit, F.concat(F.substring(tail, 1, limit), F.lit("...\n(이하 생략)"))).otherwise(tail))


def contents(text: Column, limit: int = 800) -> Column:
    """Articles of a table of contents (the lines after one with 목차, up to 부칙): array of struct article, title."""
    part = F.regexp_extract(_text(text), r"(?s)목차[^\n]*\n(.*)", 1)
    part = F.regexp_replace(part, r"(?sm)^[ \t]*부칙.*", "")
    lines = F.filter(F.transform(F.split(part, "\n"), _trim), lambda x: x.rlike(r"^제\d+조(?:의\d+)?"))
    jo = lambda x: F.regexp_extract(x, r"^(제\d+조(?:의\d+)?)", 1)
    title = lambda x: _trim(F.regexp_replace(x, r"^제\d+조(?:의\d+)?", ""))
    return F.slice(F.transform(lines, lambda x: F.struct(jo(x).alias("article"), F.coalesce(F.nullif(title(x), F.lit("")), jo(x)).alias("title"))), 1, limit)


def article_blocks(text: Column) -> Column:
    """Parts of one article: array of struct kind (paragraph, item, subitem, lead), marker, text; lines without a marker go
    on with the part before them."""
    body = F.array_join(F.filter(F.transform(F.split(_text(text), "\n"), _trim), lambda x: (x != "") & ~x.rlike(r"^(?:💡|법령명:|공포일:|시행일:|제\d+조(?:의\d+)?(?:\s*\(|\s|$))")), "\n")
    start = r"^(?:[①-⑳㉑-㉟]|\d+\.|[가-힣]\.\s)"
    parts = F.filter(F.split(body, f"(?m)(?={start})"), lambda p: F.trim(p) != "")
    marker = lambda p: F.regexp_extract(p, r"^([①-⑳㉑-㉟]|\d+\.|[가-힣]\.(?=\s))", 1)
    kind = lambda p: F.when(marker(p) == "", "lead").when(marker(p).rlike(r"^\d"), "item").when(marker(p).rlike("^[가-힣]"), "subitem").otherwise("paragraph")
    rest = lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"^(?:[①-⑳㉑-㉟]|\d+\.|[가-힣]\.(?=\s))", ""), r"(?U)\s+", " "))
    return F.transform(parts, lambda p: F.struct(kind(p).alias("kind"), marker(p).alias("marker"), rest(p).alias("text")))


def tool_text(result_json: Column) -> Column:
    """Text items of a tool's result (``content``: array of type and text) joined by line breaks; its structured content
    as JSON where it has one."""
    parsed = F.from_json(result_json, "content array<struct<type:string,text:string>>, structuredContent string")
    joined = F.array_join(F.transform(F.filter(parsed["content"], lambda i: i["type"] == "text"), lambda i: F.coalesce(i["text"], F.lit(""))), "\n")
    return F.coalesce(parsed["structuredContent"], _trim(joined))
