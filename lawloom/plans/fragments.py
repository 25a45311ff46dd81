"""Pieces of SQL that several twins share."""

from __future__ import annotations

from lawloom.functions import dims


def day(c: str) -> str:
    return f"CASE WHEN regexp_matches(substr({c},1,10), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN TRY_CAST(substr({c},1,10) AS DATE) END"


def words(items) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + ")"


NOT_NEWS = f"NOT (source_channel IN {words(dims.NEWS_CHANNELS)} OR source_system IN {words(dims.NEWS_CHANNELS)})"


def type_key(c: str = "source_channel") -> str:
    return "CASE " + " ".join(f"WHEN {c} IN {words(ch)} THEN '{k}'" for k, _, ch in dims.PRESS_TYPES) + f" ELSE '{dims.PRESS_TYPES[0][0]}' END"


def type_label(c: str = "source_channel") -> str:
    return "CASE " + " ".join(f"WHEN {c} IN {words(ch)} THEN '{label}'" for _, label, ch in dims.PRESS_TYPES) + f" ELSE '{dims.PRESS_TYPES[0][1]}' END"


def type_order(c: str = "source_channel") -> str:
    return "CASE " + " ".join(f"WHEN {c} IN {words(ch)} THEN {i}" for i, (_, _, ch) in enumerate(dims.PRESS_TYPES, 1)) + " ELSE 1 END"


def ws(c: str) -> str:
    return f"trim(regexp_replace({c}, '[\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"


def format_rank(ext: str) -> str:
    e = f"regexp_replace(lower(trim({ext})), '^\\.+', '')"
    return "CASE " + e + " " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(dims.ATTACHMENT_FORMATS, 1)) + " ELSE 99 END"


def name_in_url(c: str) -> str:
    path = f"regexp_extract({c}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
    name = f"regexp_extract({path}, '([^/]*)/?$', 1)"
    return f"CASE WHEN coalesce({c}, '') = '' THEN 'unknown' WHEN {name} = '' THEN 'unknown_file' ELSE {name} END"


def attachment_title(name: str, url: str) -> str:
    given = ws(f"coalesce({name}, '')")
    raw = f"CASE WHEN {given} <> '' THEN {given} WHEN coalesce({url}, '') <> '' THEN {name_in_url(url)} ELSE '' END"
    return f"regexp_replace(lower({ws(raw)}), '\\.(pdf|hwpx|hwp|docx|doc|xlsx|xls|pptx|ppt|zip|txt)$', '')"


def tokens(c: str, pattern: str) -> str:
    return f"regexp_extract_all(coalesce({c}, ''), '{pattern}')"
