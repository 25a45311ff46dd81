"""Normalising mixed timestamp texts (problem 1).

Every text is parsed under each format it could have been written in. Where more than one parse is valid, an
expectation-maximisation over the source's mixture of formats decides: each value adds likelihood to all its valid
parses, the posterior picks one, and a posterior under ``cutoff`` leaves the value marked ``ambiguous`` without a result.

Plan: one narrow scan; the texts are parsed by built-in expressions inside generated code; only counts per
(source, formats, months) are shuffled, so a source that holds a third of all rows still arrives as a few hundred
cells; the answers for the ambiguous cells come back by an equi-join on the cell, which is far smaller than the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawloom.functions.civil import clock_micros, day_number, iso_day, iso_instant, wall_to_utc_micros
from lawloom.session import spread

# Characters that other input systems write for the plain ones.
_WIDE = "０１２３４５６７８９．－／：，（）"
_PLAIN = "0123456789.-/:,()"
_DASHES = "‐‑‒–—−"
_BLANKS = " 　   "
_QUOTES = "’‘`´"

# Month names and zone abbreviations (minutes east of UTC).
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "KST": 540, "JST": 540, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "BST": 60, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120,
    "EEST": 180, "HKT": 480, "SGT": 480, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720,
    "NZDT": 780,
}

_YMD = r"^(\d{4}) ?[-./年년] ?(\d{1,2}) ?[-./月월] ?(\d{1,2})(?!\d)(.*)$"
_SHORT = r"^'?(\d{2})\. ?(\d{1,2})\. ?(\d{1,2})(?!\d)(.*)$"
_SLASHED = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?!\d)(.*)$"
_DAY_NAME = r"^(?:[A-Za-z]{3,9},? )?(\d{1,2})[ -]([A-Za-z]{3,9})\.?,?[ -](\d{4})(?!\d)(.*)$"
_NAME_DAY = r"^(?:[A-Za-z]{3,9}, )?([A-Za-z]{3,9})\.? (\d{1,2}),? (\d{4})(?!\d)(.*)$"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})((?:T?(?:\d{2}){2,3})?Z?)$"
_CLOCK = (
    r"^[.일日]? ?(?:\([^)0-9]{1,9}\)|[월화수목금토일]요일)?,? ?T? ?(?:(오전|오후|AM|PM) ?)?"
    r"(?:(\d{1,2})(?:[:시] ?(\d{1,2})(?:[:분] ?(\d{1,2})(?:[.,](\d{1,9}))?)?)?[시분초]?)? ?(AM|PM|A\.M\.|P\.M\.)? ?"
    r"((?:UTC|GMT)?[-+]\d{1,2}(?::?\d{2})?|[A-Z]{1,4})?(?:\[([A-Z][A-Za-z_/+0-9-]+)\])?$"
)
_COMPACT_CLOCK = r"^T?(\d{2})(\d{2})(\d{2})?(Z)?$"


def _clean(c: Column) -> Column:
    c = F.translate(c, _WIDE + _DASHES + _BLANKS + _QUOTES, _PLAIN + "-" * len(_DASHES) + " " * len(_BLANKS) + "'" * len(_QUOTES))
    c = F.regexp_replace(c, "[​‌‍﻿]", "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _part(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def _number(c: Column, pattern: str, group: int) -> Column:
    return _part(c, pattern, group).try_cast("int")


def _month(name: Column) -> Column:
    return F.nullif(F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(F.substring(name, 1, 3))), F.lit(0)).cast("int")


def _parses(df: DataFrame, raw: str) -> DataFrame:
    """Adds the valid readings of ``raw``: f1/day1 and, where there is a second, f2/day2 (ISO days), and its clock."""
    df = df.withColumn("_c", _clean(F.col(raw)))
    c = F.col("_c")
    digits = c.rlike(r"^\d+$")
    kind = (
        F.when(c.rlike(r"^\d{13}$"), "epoch_ms").when(c.rlike(r"^\d{10}$"), "epoch_s")
        .when(c.rlike(_COMPACT), "compact").when(digits, F.lit(None))
        .when(c.rlike(_YMD), "ymd").when(c.rlike(_SLASHED), "slashed").when(c.rlike(_SHORT), "short")
        .when(c.rlike(_DAY_NAME), "day_name").when(c.rlike(_NAME_DAY), "name_day")
    )
    df = df.withColumn("_k", kind)
    k = F.col("_k")
    #          kind        pattern    rest
    patterns = {"ymd": _YMD, "slashed": _SLASHED, "short": _SHORT, "day_name": _DAY_NAME, "name_day": _NAME_DAY, "compact": _COMPACT}

    def pick(of) -> Column:
        out = None
        for name, pattern in patterns.items():
            value = of(name, pattern)
            out = F.when(k == name, value) if out is None else out.when(k == name, value)
        return out

    df = df.withColumn("_a", pick(lambda n, p: _part(c, p, 1))).withColumn("_b", pick(lambda n, p: _part(c, p, 2)))
    df = df.withColumn("_d", pick(lambda n, p: _part(c, p, 3))).withColumn("_rest", pick(lambda n, p: F.upper(F.regexp_extract(c, p, 4))))
    a, b, d, rest = (F.col(x) for x in ("_a", "_b", "_d", "_rest"))
    ai, bi, di = (x.try_cast("int") for x in (a, b, d))
    first = (
        F.when(k.isin("ymd", "compact"), iso_day(ai, bi, di)).when(k == "slashed", iso_day(di, ai, bi)).when(k == "short", iso_day(ai + 2000, bi, di))
        .when(k == "day_name", iso_day(di, _month(b), ai)).when(k == "name_day", iso_day(di, _month(a), bi))
        .when(k == "epoch_ms", F.date_from_unix_date((c.try_cast("bigint") / 86_400_000).cast("int")).cast("string"))
        .when(k == "epoch_s", F.date_from_unix_date((c.try_cast("bigint") / 86_400).cast("int")).cast("string"))
    )
    hourly = r"^((?:19|20)\d{2})(\d{2})(\d{2})(\d{2})$"  # ten digits may also be a day and an hour
    hour_ok = F.when(_number(c, hourly, 4) <= 23, iso_day(_number(c, hourly, 1), _number(c, hourly, 2), _number(c, hourly, 3)))
    second = F.when(k == "slashed", iso_day(di, bi, ai)).when(k == "epoch_s", hour_ok)
    name1 = F.when(k == "slashed", "mdy").otherwise(k)
    name2 = F.when(k == "slashed", "dmy").when(k == "epoch_s", "compact_hour")
    df = df.withColumn("_p1", first).withColumn("_p2", second).withColumn("_n1", name1).withColumn("_n2", name2)
    # one reading under both orders (4/4/2024) is not ambiguous; an invalid first reading gives way to the second
    same = F.col("_p1").eqNullSafe(F.col("_p2")) & (k != "epoch_s")
    df = df.withColumn("f1", F.when(F.col("_p1").isNotNull(), F.col("_n1")).when(F.col("_p2").isNotNull(), F.col("_n2")))
    df = df.withColumn("day1", F.coalesce("_p1", "_p2"))
    both = F.col("_p1").isNotNull() & F.col("_p2").isNotNull() & ~same
    df = df.withColumn("f2", F.when(both, F.col("_n2"))).withColumn("day2", F.when(both, F.col("_p2")))
    # the clock
    on_compact = k == "compact"
    readable = F.when(on_compact, (rest == "") | rest.rlike(_COMPACT_CLOCK)).when(k.isin("epoch_s", "epoch_ms"), True).otherwise(rest.rlike(_CLOCK))
    half = F.coalesce(_part(rest, _CLOCK, 1), F.regexp_replace(_part(rest, _CLOCK, 6), r"\.", ""))
    h = F.when(on_compact, _number(rest, _COMPACT_CLOCK, 1)).otherwise(_number(rest, _CLOCK, 2))
    mi = F.when(on_compact, _number(rest, _COMPACT_CLOCK, 2)).otherwise(_number(rest, _CLOCK, 3))
    s = F.when(on_compact, _number(rest, _COMPACT_CLOCK, 3)).otherwise(_number(rest, _CLOCK, 4))
    us = F.rpad(F.substring(_part(rest, _CLOCK, 5), 1, 6), 6, "0").try_cast("int")
    noon = half.isin("오후", "PM")
    h24 = F.when(half.isNull(), h).when(h.between(1, 12), F.when(noon, F.when(h == 12, 12).otherwise(h + 12)).otherwise(F.when(h == 12, 0).otherwise(h)))
    h24 = F.when(h24.isNull() & (h == 0) & half.isNotNull() & ~noon, 0).otherwise(h24)
    zone = F.when(on_compact, _part(rest, _COMPACT_CLOCK, 4)).otherwise(_part(rest, _CLOCK, 7))
    df = df.withColumn("_ok", readable).withColumn("_h", h24).withColumn("_hraw", h).withColumn("_zone", zone)
    df = df.withColumn("_clock", F.when(F.col("_h").isNotNull(), clock_micros(F.col("_h"), F.coalesce(mi, F.lit(0)), F.coalesce(s, F.lit(0)), F.coalesce(us, F.lit(0)))))
    offset = r"^(?:UTC|GMT)?([-+])(\d{1,2}):?(\d{2})?$"
    sign = F.when(F.regexp_extract("_zone", offset, 1) == "-", -1).otherwise(1)
    z = F.col("_zone")
    minutes = F.when(z.rlike(offset), sign * (_number(z, offset, 2) * 60 + F.coalesce(_number(z, offset, 3), F.lit(0))))
    named = F.create_map(*[x for kk, v in _ABBREVIATIONS.items() for x in (F.lit(kk), F.lit(v))])
    minutes = F.coalesce(minutes, F.when(z.isNotNull(), F.try_element_at(named, z)))
    # the region in brackets serves where no offset stands before it (its case is lost in _rest)
    df = df.withColumn("_offset", minutes).withColumn("_region", _part(c, r"\[([A-Za-z_/+0-9-]+)\]$", 1))
    bad = ~F.coalesce(F.col("_ok"), F.lit(False)) | (F.col("_hraw").isNotNull() & F.col("_clock").isNull()) | (z.isNotNull() & F.col("_offset").isNull())
    for name in ("f1", "day1", "f2", "day2"):
        df = df.withColumn(name, F.when(~bad, F.col(name)))
    return df


def _fence(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same rows and columns behind a generator, through which filters are not pushed: pushed, they would copy the
    parsing expressions into themselves many times over."""
    return df.select(F.explode(F.array(F.struct(*columns))).alias("_r")).select("_r.*")


def _month_index(day: Column) -> Column:
    return F.substring(day, 1, 4).cast("int") * 12 + F.substring(day, 6, 2).cast("int")


_CELL = ["_src", "f1", "mon1", "f2", "mon2"]


def fit_cells(cells: pd.DataFrame, declared: str | None, iterations: int = 50, strength: float = 100.0) -> pd.DataFrame:
    """EM for one source. Each cell (formats, months, number of values n) adds likelihood to its one or two readings;
    unknown are the format weights and the density over months. ``declared`` (mdy, dmy) enters as a Dirichlet prior worth
    ``strength`` values for each ambiguous one, for ten of them at most however large the source: it settles a source whose
    values say nothing, and gives way to values that say otherwise. The start is the mixture of the values with one reading and the prior. Returns ``cells`` with ``post1``,
    the posterior of reading 1."""
    cells = cells.copy()
    two = cells.f2.notna().to_numpy()
    n = cells.n.to_numpy(float)
    formats = sorted(set(cells.f1) | set(cells.f2.dropna()))
    months = sorted(set(cells.mon1) | set(cells.mon2.dropna()))
    fi, mi = {f: i for i, f in enumerate(formats)}, {m: i for i, m in enumerate(months)}
    a, am = cells.f1.map(fi).to_numpy(), cells.mon1.map(mi).to_numpy()
    b = np.array([fi.get(x, 0) for x in cells.f2])
    bm = np.array([mi.get(x, 0) for x in cells.mon2])
    prior = np.ones(len(formats))
    if declared in fi:
        prior[fi[declared]] += strength * min(n[two].sum() + 1, 10)
    sure = prior + np.bincount(a[~two], n[~two], len(formats))
    post = np.where(two, sure[a] / (sure[a] + sure[b]), 1.0)
    for _ in range(iterations):
        w = prior + np.bincount(a, n * post, len(formats)) + np.bincount(b, n * (1 - post), len(formats))
        dens = np.bincount(am, n * post, len(months)) + np.bincount(bm, n * (1 - post), len(months))
        w, dens = w / w.sum(), 0.9 * dens / max(dens.sum(), 1e-9) + 0.1 / len(months)
        one, other = w[a] * dens[am], w[b] * dens[bm]
        new = np.where(two, one / (one + other), 1.0)
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    cells["post1"] = post
    return cells


def normalize_timestamps(
    articles: DataFrame, sources: DataFrame, fields: tuple[str, ...] = ("published_at", "first_seen_at", "effective_date"), id_col: str = "id",
    source_col: str = "source_system", cutoff: float = 0.9, iterations: int = 50, strength: float = 100.0,
) -> DataFrame:
    """One row per non-null value of ``fields``: article_id, field_name, raw_value, format, norm_value, posterior, status.

    ``sources`` has source_system, zone_name and date_order, one row per source. norm_value is ``YYYY-MM-DD`` for a
    value without time of day, else the UTC instant ``YYYY-MM-DDTHH:MM:SS.ffffffZ``. status: ``day``, ``instant``,
    ``ambiguous`` (no reading reaches ``cutoff``), ``no_zone`` (wall time of a source without known zone) or ``none``
    (denotes no date); norm_value is null for the last three. Null values give no row, blank texts status ``none``;
    values of a null or unknown source are read without declared order; repeated ids and extra columns do no harm;
    an empty table gives an empty result.
    """
    spark = articles.sparkSession
    stacked = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("raw_value")) for f in fields]))
    rows = spread(articles.select(id_col, source_col, *fields)).select(F.col(id_col).cast("bigint").alias("article_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_src"), stacked.alias("_v"))
    rows = rows.select("article_id", "_src", "_v.field_name", "_v.raw_value").where("raw_value is not null")
    parsed = _parses(rows, "raw_value").withColumn("mon1", _month_index(F.col("day1"))).withColumn("mon2", _month_index(F.col("day2")))
    parsed = _fence(parsed, ["article_id", "field_name", "raw_value", "_c", "_clock", "_offset", "_region", "day1", "day2", *_CELL])
    lookup = (
        sources.where(F.col("source_system").isNotNull()).groupBy(F.col("source_system").alias("_src"))
        .agg(F.max("zone_name").alias("_zone_name"), F.max("date_order").alias("_order"))
    )

    cells = parsed.where("f1 is not null").groupBy(*_CELL).agg(F.count("*").alias("n")).join(lookup.select("_src", "_order"), "_src", "left")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        out = fit_cells(pdf, pdf["_order"].iloc[0], iterations, strength)
        return out[out.f2.notna()][[*_CELL, "post1"]]

    schema = "_src string, f1 string, mon1 int, f2 string, mon2 int, post1 double"
    answers = cells.groupBy("_src").applyInPandas(fit, schema).select(*[F.col(x).alias(f"_e{x}") for x in _CELL], "post1")
    # Cells are bounded by sources x format pairs x months; only if they are few are they sent to every task.
    few = answers.limit(_SMALL + 1).collect()
    if len(few) <= _SMALL:
        answers = F.broadcast(spark.createDataFrame(few, answers.schema))
    on = [parsed[x] == answers[f"_e{x}"] for x in _CELL]
    out = parsed.join(answers, on, "left").join(lookup, "_src", "left")
    first = F.coalesce(F.col("post1"), F.lit(1.0)) >= 0.5
    posterior = F.when(F.col("f1").isNotNull(), F.when(first, F.coalesce("post1", F.lit(1.0))).otherwise(1 - F.col("post1")))
    fmt = F.when(first, F.col("f1")).otherwise(F.col("f2"))
    out = out.withColumn("format", fmt).withColumn("posterior", posterior).withColumn("_day", F.when(first, F.col("day1")).otherwise(F.col("day2")))
    c = F.col("_c").try_cast("bigint")
    hourly = F.substring("_c", 9, 2).try_cast("bigint") * 3_600_000_000
    clock = F.when(F.col("format") == "compact_hour", hourly).otherwise(F.col("_clock"))
    wall = day_number(F.col("_day")).cast("bigint") * 86_400_000_000 + clock
    zone = F.coalesce(F.col("_region"), F.col("_zone_name"))
    micros = (
        F.when(F.col("format") == "epoch_ms", c * 1000).when(F.col("format") == "epoch_s", c * 1_000_000)
        .when(F.col("_offset").isNotNull(), wall - F.col("_offset").cast("bigint") * 60_000_000)
        .when(zone.isNotNull(), wall_to_utc_micros(wall, zone))
    )
    timed = F.col("format").isin("epoch_ms", "epoch_s", "compact_hour") | F.col("_clock").isNotNull()
    status = (
        F.when(F.col("format").isNull(), "none").when(F.col("posterior") < cutoff, "ambiguous").when(~timed, "day")
        .when(zone.isNull() & F.col("_offset").isNull() & ~F.col("format").isin("epoch_ms", "epoch_s"), "no_zone").otherwise("instant")
    )
    out = out.withColumn("status", status)
    out = _fence(out.withColumn("_micros", micros), ["article_id", "field_name", "raw_value", "format", "_day", "_micros", "posterior", "status"])
    norm = F.when(F.col("status") == "day", F.col("_day")).when(F.col("status") == "instant", iso_instant(F.col("_micros")))
    return out.select("article_id", "field_name", "raw_value", "format", norm.alias("norm_value"), "posterior", "status")


#: Ambiguous cells up to this number (some tens of bytes each) are broadcast; beyond it they are joined by a shuffle.
_SMALL = 20_000


def p1_found(spark, root: str) -> DataFrame:
    from lawloom.session import table

    out = normalize_timestamps(table(spark, root, "articles"), table(spark, root, "source_systems"))
    return out.where(F.col("norm_value").isNotNull() & (F.col("norm_value") != F.col("raw_value"))).select("article_id", "field_name", "norm_value")
