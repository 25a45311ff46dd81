"""Scalar functions on texts, file names, URLs and dates, all built-in expressions. Null in, null out unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lawloom.functions.dims import COMPANY_ENDINGS, COMPANY_MARKS, NEWS_STOPWORDS, PARTICLES, RULE_STOPWORDS, TITLE_STOPWORDS

_WS = r"(?U)\s+"
_KNOWN_EXT = r"\.(pdf|hwpx|hwp|docx|doc|xlsx|xls|pptx|ppt|zip|txt)$"


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none outside."""
    return F.trim(F.regexp_replace(c, _WS, " "))


def clean_lines(c: Column) -> Column:
    """Byte-order marks and tabs as blanks, LF line ends, at most one blank line in a row."""
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "﻿", " "), r"\r\n?", "\n"), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def squeeze_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n(?:\s*\n){2,}", "\n\n")


def without_spaces(c: Column) -> Column:
    """White space removed; null as empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), _WS, "")


def published_day(c: Column) -> Column:
    """The first ten characters with dashes, as text."""
    return F.translate(F.substring(c, 1, 10), "./", "--")


def iso_date(c: Column) -> Column:
    """The date that the first ten characters write as YYYY-MM-DD, null for anything else."""
    head = F.substring(c, 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head.try_cast("date"))


def padded_day(c: Column) -> Column:
    """Y.M.D in Korean or separated writing as YYYY-MM-DD, white space ignored; null if it is none."""
    c = F.regexp_replace(c, _WS, "")
    c = F.regexp_replace(F.translate(F.translate(c, "년월/-", "...."), "일", ""), r"^\.+|\.+$", "")
    m = lambda k: F.regexp_extract(c, r"^(\d{4})\.(\d{1,2})\.(\d{1,2})$", k)
    return F.when(m(1) != "", F.concat_ws("-", m(1), F.lpad(m(2), 2, "0"), F.lpad(m(3), 2, "0")))


def feed_datetime(c: Column) -> Column:
    """A feed's time stamp as ISO text: ``YYYY-MM-DD`` or with a time; other text with its separators as dashes."""
    c = F.regexp_replace(collapse(c), r"\.+$", "")
    g = lambda p, k: F.regexp_extract(c, p, k)
    american = r"^(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}:\d{2}:\d{2})$"
    dense = r"^(\d{4})(\d{2})(\d{2})(?:(\d{2})(\d{2})(\d{2})?)?$"
    loose = r"^(\d{4})[-./](\d{1,2})[-./](\d{1,2})(.*)$"
    join = lambda y, m, d: F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    clock = F.when(g(dense, 4) != "", F.concat(F.lit(" "), F.concat_ws(":", g(dense, 4), g(dense, 5), F.coalesce(F.nullif(g(dense, 6), F.lit("")), F.lit("00"))))).otherwise("")
    return F.nullif(
        F.when(g(american, 1) != "", F.concat(join(g(american, 3), g(american, 1), g(american, 2)), F.lit(" "), g(american, 4)))
        .when(g(dense, 1) != "", F.concat(join(g(dense, 1), g(dense, 2), g(dense, 3)), clock))
        .when(g(loose, 1) != "", F.concat(join(g(loose, 1), g(loose, 2), g(loose, 3)), g(loose, 4)))
        .otherwise(F.translate(c, "./", "--")),
        F.lit(""),
    )


def notice_date(c: Column) -> Column:
    """A day in any of the notices' writings, else what feed_datetime makes of it."""
    return F.coalesce(padded_day(c), feed_datetime(c))


def date_range(c: Column) -> Column:
    """``start_day`` and ``end_day`` of 'A ~ B'; a single date has no end."""
    parts = F.split(collapse(c), r"\s*~\s*")
    return F.struct(notice_date(F.try_element_at(parts, F.lit(1))).alias("start_day"), notice_date(F.try_element_at(parts, F.lit(2))).alias("end_day"))


# How a text names its day of effect.
_DAY_AFTER = r"시행(?:예정)?일\s*[:：]?\s*(20\d{2}[./-]\d{1,2}[./-]\d{1,2})"
_DAY_BEFORE = r"(20\d{2}[./-]\d{1,2}[./-]\d{1,2})\s*시행"


def effective_day(text: Column) -> Column:
    """The day a text names as its day of effect: after the words for it, else before the verb."""
    t = collapse(text)
    after = F.regexp_extract(t, _DAY_AFTER, 1)
    before = F.regexp_extract(t, _DAY_BEFORE, 1)
    return padded_day(F.coalesce(F.nullif(after, F.lit("")), F.nullif(before, F.lit(""))))


def amendment_type(text: Column) -> Column:
    """The first of these words, in this order, that the text contains."""
    out = F
    for word in ("전부개정", "일부개정", "개정", "제정", "폐지"):
        out = out.when(text.contains(word), word)
    return out


def extension(name: Column) -> Column:
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1)))


def name_in_url(url: Column) -> Column:
    """The last segment of the path; ``unknown`` without a URL, ``unknown_file`` without a segment."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    name = F.regexp_extract(path, r"([^/]*)/?$", 1)
    return F.when(F.coalesce(url, F.lit("")) == "", "unknown").when(name == "", "unknown_file").otherwise(name)


def attachment_title(name: Column, url: Column) -> Column:
    """A file's name for comparison: from the URL if it has none, one blank between words, small, without extension."""
    given = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), _WS, " "))
    raw = F.when(given != "", given).when(F.coalesce(url, F.lit("")) != "", name_in_url(url)).otherwise("")
    return F.regexp_replace(F.lower(collapse(raw)), _KNOWN_EXT, "")


def rule_name(file_name: Column) -> Column:
    """A rule file's name without extension, protection prefix and version suffixes."""
    stem = F.regexp_replace(F.regexp_replace(file_name, r"^.*/", ""), r"(?<=.)\.[^.]+$", "")
    stem = F.regexp_replace(F.regexp_replace(stem, r"(?i)^DRM_", ""), r"(?U)\s*원문[-_]?원본\s*$", "")
    return F.lower(collapse(F.regexp_replace(stem, r"(?U)\s*\(수정본\)\s*$", "")))


def url_parameter(url: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))


# How keys and tokens stand in messages.
_SECRETS = (
    (r"(?i)([?&]key=)[^&\s]+", "$1***"),
    (r"(?i)(X-goog-api-key[:=]\s*)[^\s,]+", "$1***"),
    (r"(?i)(Authorization[:=]\s*Bearer\s+)[^\s,]+", "$1***"),
    (r"AIza[0-9A-Za-z\-_]{20,}", "***"),
)


def mask_secrets(c: Column) -> Column:
    """Keys and tokens in messages replaced by asterisks."""
    for pattern, by in _SECRETS:
        c = F.regexp_replace(c, pattern, by)
    return c


def shorten(c: Column, limit: int) -> Column:
    """Collapsed text of at most ``limit`` characters, an ellipsis where it was cut."""
    t = collapse(F.coalesce(c, F.lit("")))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("…")))


def content_hash(c: Column) -> Column:
    """SHA-256, null for empty text."""
    return F.sha2(F.nullif(c, F.lit("")), 256)


def stable_id(c: Column) -> Column:
    """MD5 in the form of a UUID."""
    return F.regexp_replace(F.md5(c), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def token_estimate(c: Column) -> Column:
    """A third of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(c, F.lit(""))) / 3)).cast("int")


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))


def retrieval_tokens(c: Column) -> Column:
    """Small tokens for retrieval: Hangul, ASCII letters, digits and inner joiners; numbers and single signs left out."""
    stripped = F.transform(_all(c, r"[가-힣A-Za-z0-9][가-힣A-Za-z0-9_\-/.]+"), lambda t: F.lower(F.regexp_replace(t, r"^[._\-/]+|[._\-/]+$", "")))
    return F.filter(stripped, lambda t: (F.length(t) >= 2) & ~t.rlike(r"^\d+$"))


def rule_tokens(c: Column) -> Column:
    stripped = F.transform(_all(c, r"[가-힣A-Za-z0-9][가-힣A-Za-z0-9·ㆍ\-/]+"), lambda t: F.lower(F.regexp_replace(t, r"^[\-/]+|[\-/]+$", "")))
    return F.filter(stripped, lambda t: (F.length(t) >= 2) & ~t.isin(*RULE_STOPWORDS) & ~t.rlike(r"^\d+$"))


def keyword_tokens(c: Column) -> Column:
    """Words for keyword counts, case kept; Korean words lose one particle at the end (the longest listed)."""
    ending = "(?:" + "|".join(sorted(PARTICLES, key=lambda p: (-len(p), p))) + ")$"
    return F.filter(F.transform(_all(c, r"[가-힣]{2,}|[a-zA-Z]{3,}"), lambda t: F.regexp_replace(t, ending, "")), lambda t: F.length(t) >= 2)


def pair_tokens(c: Column) -> Column:
    return _all(c, r"[가-힣a-zA-Z0-9]{2,}")


def news_tokens(c: Column) -> Column:
    return F.filter(F.transform(pair_tokens(c), F.lower), lambda t: ~t.isin(*NEWS_STOPWORDS))


def title_tokens(c: Column) -> Column:
    """Distinct small tokens of a title; the stop words are compared before the case is dropped."""
    return F.array_distinct(F.transform(F.filter(pair_tokens(c), lambda t: ~t.isin(*TITLE_STOPWORDS)), F.lower))


def period_label(published_at: Column, granularity: str) -> Column:
    """day, month (YYYY-MM) or the Monday of the week (the month where the text is no date); 미상 for null or empty."""
    day = F.substring(published_at, 1, 10)
    if granularity == "week":
        label = F.coalesce(F.date_format(F.date_trunc("week", iso_date(published_at)), "yyyy-MM-dd"), F.substring(day, 1, 7))
    else:
        label = day if granularity == "day" else F.substring(day, 1, 7)
    return F.when(F.coalesce(published_at, F.lit("")) == "", "미상").otherwise(label)


def date_nearness(a: Column, b: Column, days: int = 90) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(F.datediff(a, b)) / days)


def looks_like_company(token: Column) -> Column:
    ends = "(?:" + "|".join(COMPANY_ENDINGS) + ")$"
    return (F.length(token) >= 3) & (token.rlike(ends) | token.rlike("[a-z]") | token.rlike("|".join(COMPANY_MARKS)))


def file_kind(name: Column, url: Column, content_type: Column) -> Column:
    """The extension of the name, else of the URL's last segment, else of the content type, else ``bin``."""
    ct = F.lower(F.coalesce(content_type, F.lit("")))
    kinds = (("pdf", "pdf"), ("hwpx", "hwpx"), ("hwp", "hwp"), ("wordprocessingml", "docx"), ("spreadsheetml", "xlsx"), ("presentationml", "pptx"), ("html", "html"), ("json", "json"), ("xml", "xml"), ("csv", "csv"), ("text/plain", "txt"), ("zip", "zip"))
    by_type = F
    for mark, kind in kinds:
        by_type = by_type.when(ct.contains(mark), kind)
    short = lambda e: F.when(e.rlike("^[a-z0-9]{1,5}$"), e)
    return F.coalesce(short(extension(F.trim(name))), short(extension(name_in_url(url))), by_type, F.lit("bin"))


def is_news(channel: Column, system: Column, organization: Column | None = None) -> Column:
    """Whether the channel or the system has ``news`` in its name, or the organisation ``arirang``; case ignored."""
    has = lambda c, part: F.coalesce(F.lower(c).contains(part), F.lit(False))
    found = has(channel, "news") | has(system, "news")
    return found if organization is None else found | has(organization, "arirang")


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)
