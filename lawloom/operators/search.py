"""Article search, lists and statistics."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lawloom.functions import dims, text


def article_filter(
    articles: DataFrame, press_type: str = "", organization: str = "", from_date: str = "", to_date: str = "", since: bool = False, news: bool = False,
) -> DataFrame:
    """Articles of a press type, organisation and period. A lone ``from_date`` means that very day unless ``since``;
    texts that are no dates fall out of any period. An unknown press type does not filter. News is left out unless
    ``news``; rows whose channel or system is null count as news only by the other one, and if both fail to tell
    (null), they fall out as in SQL's three-valued logic."""
    if not news:
        articles = articles.where(~(F.col("source_channel").isin(*dims.NEWS_CHANNELS) | F.col("source_system").isin(*dims.NEWS_CHANNELS)))
    if channels := dims.channels_of(press_type):
        articles = articles.where(F.col("source_channel").isin(*channels))
    if organization:
        articles = articles.where(F.col("organization") == organization)
    day = text.iso_date(F.col("published_at"))
    if from_date and to_date:
        articles = articles.where(day.between(F.lit(from_date).cast("date"), F.lit(to_date).cast("date")))
    elif from_date:
        low = F.lit(from_date).cast("date")
        articles = articles.where(day >= low if since else day == low)
    elif to_date:
        articles = articles.where(day <= F.lit(to_date).cast("date"))
    return articles


def postings(articles: DataFrame, id_col: str = "id", fields: tuple[str, ...] = ("title", "content_text")) -> DataFrame:
    """doc_id, field, position, term of every word of letters and digits, in small letters: the full-text index."""
    words = lambda f: F.regexp_extract_all(F.lower(F.coalesce(F.col(f), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    out = None
    for f in fields:
        one = articles.select(F.col(id_col).alias("doc_id"), F.lit(f).alias("field"), F.posexplode(words(f)).alias("position", "term"))
        out = one if out is None else out.unionByName(one)
    return out


def refresh_postings(stored: DataFrame, changed: DataFrame, removed: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """The index after articles were added, changed or (``removed``, by id) deleted: their old postings go, the new ones
    come; the rest of the index is not touched."""
    gone = changed.select(F.col(id_col).alias("doc_id"))
    if removed is not None:
        gone = gone.unionByName(removed.select(F.col(id_col).alias("doc_id")))
    return stored.join(gone.distinct(), "doc_id", "left_anti").select(*stored.columns).unionByName(postings(changed, id_col).select(*stored.columns))


def text_match(articles: DataFrame, query: str) -> DataFrame:
    """Articles that match a typed query: as a phrase, as one joined word, by all its words (a single word: by prefix),
    or whose title holds the joined query when blanks are ignored. Runs as one scan: an index pays only where many
    queries share it."""
    words = [w for w in "".join(ch if ch.isalnum() or ch == "_" else " " for ch in query).split()]
    if not words:
        return articles
    joined = "".join(words)
    edge = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
    phrase = edge[0] + r"[^\p{L}\p{N}]+".join(w.lower() for w in words) + (edge[1] if len(words) > 1 else "")
    exact = lambda w: edge[0] + w.lower() + edge[1]

    def anywhere(pattern: str) -> Column:
        return F.coalesce(F.lower("title").rlike(pattern), F.lit(False)) | F.coalesce(F.lower("content_text").rlike(pattern), F.lit(False))

    hit = anywhere(phrase)
    if len(words) > 1:
        every = F.lit(True)
        for w in words:
            every = every & anywhere(exact(w))
        hit = hit | anywhere(exact(joined)) | every
    squashed = F.lower(F.regexp_replace("title", " ", "")).contains(joined.lower())
    return articles.where(hit | F.coalesce(squashed, F.lit(False)))


@dataclass(frozen=True)
class Phrase:
    """Words one after the other in a field; the last by its beginning if ``prefix``."""

    words: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class All:
    """Every one of these in a document, in whatever field."""

    parts: tuple[Phrase | All | AnyOf, ...]


@dataclass(frozen=True)
class AnyOf:
    parts: tuple[Phrase | All | AnyOf, ...]


def typed_query(query: str) -> AnyOf | None:
    """What a typed query asks of the index: the words as a phrase (a single word by its beginning), as one joined word, or
    all of them; None without a word."""
    words = tuple(w.lower() for w in "".join(ch if ch.isalnum() or ch == "_" else " " for ch in query).split())
    if not words:
        return None
    if len(words) == 1:
        return AnyOf((Phrase(words, prefix=True),))
    return AnyOf((Phrase(words), Phrase(("".join(words),)), All(tuple(Phrase((w,)) for w in words))))


def index_match(index: DataFrame, query: Phrase | All | AnyOf) -> DataFrame:
    """doc_id of the documents that match, from ``postings`` alone. Only the postings of the query's terms are read and
    shuffled; a phrase is counted by its start, so the index is not joined with itself."""
    if isinstance(query, AnyOf):
        return functools.reduce(DataFrame.unionByName, [index_match(index, p) for p in query.parts]).distinct()
    if isinstance(query, All):
        marked = [index_match(index, p).withColumn("part", F.lit(i)) for i, p in enumerate(query.parts)]
        every = functools.reduce(DataFrame.unionByName, marked).groupBy("doc_id").agg(F.count_distinct("part").alias("n"))
        return every.where(F.col("n") == len(query.parts)).select("doc_id")
    last = len(query.words) - 1
    is_word = [F.col("term").startswith(w) if query.prefix and i == last else F.col("term") == w for i, w in enumerate(query.words)]
    hits = index.where(functools.reduce(lambda a, b: a | b, is_word))
    if last == 0:
        return hits.select("doc_id").distinct()
    places = F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(is_word)]))  # a word may stand twice in the phrase
    starts = hits.select("doc_id", "field", "position", F.explode(places).alias("place")).groupBy("doc_id", "field", (F.col("position") - F.col("place")).alias("start"))
    return starts.agg(F.count_distinct("place").alias("n")).where(F.col("n") == last + 1).select("doc_id").distinct()


def indexed_match(articles: DataFrame, index: DataFrame, query: str) -> DataFrame:
    """The articles of ``text_match`` by the index: a semi-join on what the postings give, and the titles that hold the
    joined query when blanks are ignored."""
    asked = typed_query(query)
    if asked is None:
        return articles
    joined = "".join(w for w in "".join(ch if ch.isalnum() or ch == "_" else " " for ch in query).split()).lower()
    squashed = articles.where(F.lower(F.regexp_replace("title", " ", "")).contains(joined)).select(F.col("id").alias("doc_id"))
    return articles.join(index_match(index, asked).unionByName(squashed).distinct(), articles["id"] == F.col("doc_id"), "left_semi")


def with_attachment_count(articles: DataFrame, attachments: DataFrame) -> DataFrame:
    """Adds attachment_count, 0 for none. The counts are aggregated before the join, so a hot article costs nothing."""
    counts = attachments.where("article_id is not null").groupBy(F.col("article_id").alias("id")).agg(F.count("*").alias("attachment_count"))
    return articles.join(counts, "id", "left").withColumn("attachment_count", F.coalesce("attachment_count", F.lit(0).cast("bigint")))


def page(articles: DataFrame, number: int = 1, size: int = 20, descending: bool = True) -> DataFrame:
    """One page of the list, newest first; nulls last when descending, first when ascending; ids break ties."""
    number, size = max(1, number), min(100, max(1, size))
    order = [F.col("published_at").desc(), F.col("id").desc()] if descending else [F.col("published_at").asc(), F.col("id").asc()]
    return articles.orderBy(*order).offset((number - 1) * size).limit(size)


def count_by_organization(articles: DataFrame, top: int | None = None) -> DataFrame:
    out = articles.groupBy(F.coalesce(F.col("organization"), F.lit("(미상)")).alias("organization")).agg(F.count("*").alias("cnt"))
    return out.orderBy(F.desc("cnt"), "organization").limit(top) if top else out


def count_by_type(articles: DataFrame) -> DataFrame:
    key = dims.press_type(F.col("source_channel"))
    out = articles.groupBy(key.alias("type_key")).agg(F.count("*").alias("cnt"))
    return out.select("type_key", dims.press_label(F.col("type_key")).alias("type_label"), dims.press_order(F.col("type_key")).alias("sort_order"), "cnt")


def digest(articles: DataFrame) -> DataFrame:
    """organization, total and its press types as an array (label, count), most frequent first."""
    label = dims.press_label(dims.press_type(F.col("source_channel")))
    per = articles.groupBy(F.coalesce(F.col("organization"), F.lit("(미상)")).alias("organization"), label.alias("label")).agg(F.count("*").alias("n"))
    packed = per.groupBy("organization").agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("minus"), "label"))).alias("p"))
    return packed.select("organization", "total", F.transform("p", lambda s: F.concat_ws(":", s["label"], (-s["minus"]).cast("string"))).alias("types"))


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first by ``order``. Rank and filter run as a group limit before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def outputs_about(outputs: DataFrame, output_sources: DataFrame, articles: DataFrame, press_type: str) -> DataFrame:
    """Report outputs that cite an article of a press type."""
    channels = dims.channels_of(press_type)
    cited = output_sources.join(articles.where(F.col("source_channel").isin(*channels)).select(F.col("id").alias("article_id")), "article_id", "left_semi")
    return outputs.join(cited.select(F.col("report_output_id").alias("id")), "id", "left_semi")


def suggestions(articles: DataFrame, typed: str, limit: int = 8) -> DataFrame:
    """Distinct titles in which every typed word begins a word, newest first."""
    words = [w for w in "".join(ch if ch.isalnum() else " " for ch in typed.lower()).split()]
    hits = articles.where(F.col("title").isNotNull())
    for w in words:
        hits = hits.where(F.lower("title").rlike(rf"(?<![\p{{L}}\p{{N}}]){w}"))
    return hits.groupBy("title").agg(F.max("published_at").alias("published_at")).orderBy(F.desc("published_at"), "title").limit(limit)


# Fields of the landed item that an article's detail shows.
_DETAIL = (
    "notice_start notice_end final_extension_date validity_period enforcement_status processing_status public_yn registrant reply_date query_summary "
    "reply_text reason_text case_number"
).split()


def detail_fields(articles: DataFrame) -> DataFrame:
    """Articles with the fields of their landed item (``raw_json``); what is missing, or no JSON, gives nulls."""
    return articles.select("*", *[F.get_json_object("raw_json", f"$.{n}").alias(n) for n in _DETAIL])
