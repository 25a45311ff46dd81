"""Similar and related articles: candidates from shared terms, rule scores, fused ranks."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lawloom.functions import dims, text
from lawloom.operators.keywords import weighted_terms
from lawloom.operators.retrieval import Bm25Index
from lawloom.session import materialize


def attachment_tokens(articles: DataFrame, attachments: DataFrame, extractions: DataFrame, most: int = 3, ok: str = "completed") -> DataFrame:
    """id, lead20, lead30, attached: of the first ``most`` attachments with an extracted text of each article the first 20
    and the first 30 tokens of each text, one text after the other, and the distinct tokens of all. Articles without such a
    text have no row. A text is cut into tokens once, however many articles link it."""
    texts = extractions.where((F.lower(F.trim("status")) == ok) & F.col("text_content").rlike(r"(?U)\S")).select("document_id", F.col("id").alias("extraction_id"), "text_content")
    links = attachments.join(articles.select(F.col("id").alias("article_id")).distinct(), "article_id", "left_semi").select("article_id", F.col("id").alias("attachment_id"), "document_id")
    place = F.row_number().over(Window.partitionBy("article_id").orderBy("attachment_id", "extraction_id"))
    chosen = links.join(texts.select("document_id", "extraction_id"), "document_id").withColumn("place", place).where(F.col("place") <= most)
    cut = texts.select("extraction_id", text.news_tokens(F.col("text_content")).alias("t")).select("extraction_id", F.slice("t", 1, 20).alias("t20"), F.slice("t", 1, 30).alias("t30"), F.array_distinct("t").alias("t"))
    per = chosen.join(cut, "extraction_id").groupBy(F.col("article_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("place", "t20", "t30", "t"))).alias("x"))
    return per.select("id", F.flatten("x.t20").alias("lead20"), F.flatten("x.t30").alias("lead30"), F.array_distinct(F.flatten("x.t")).alias("attached"))


def candidate_news(articles: DataFrame, queries: DataFrame, limit: int = 50, pool: int = 200, attached: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, rank: for each query article the news among its best ``pool`` matches by its twelve weightiest
    terms, ranked among themselves, ``limit`` at most. ``attached`` are the attachment tokens of the query articles."""
    tokens = F.filter(text.pair_tokens(F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content_text", F.lit(""))))), lambda t: F.length(t) >= 2)
    index = Bm25Index(articles, "id", tokens, k1=1.2)
    asked = weighted_terms(queries, attached=attached).groupBy(F.col("doc_id").alias("query_id")).agg(F.collect_list("term").alias("tokens"))
    best = index.search(asked, pool, skip_self=True)
    news = articles.where(text.is_news(F.col("source_channel"), F.col("source_system"), F.col("organization"))).select(F.col("id").alias("doc_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return best.join(news, "doc_id", "left_semi").select("query_id", "doc_id", rank.alias("rank")).where(F.col("rank") <= limit)


def entities(title: Column, organization: Column, lead30: Column) -> Column:
    """Distinct tokens of three letters or more of the title, the organisation and the beginnings of the attachments."""
    return F.array_distinct(F.filter(F.concat(text.news_tokens(title), text.news_tokens(organization), lead30), lambda t: F.length(t) >= 3))


def _strong(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*dims.WEAK_TERMS))


def passes_gate(a: str, b: str) -> Column:
    """Whether the news ``b`` may belong to ``a``: if the title of ``a`` has an approval term and there are company names in
    it or in the beginnings of the attachments, one of these must stand in the title or the body of ``b``."""
    col = lambda side, name: F.col(f"{side}.{name}")
    asks = F.coalesce(col(a, "title").rlike("|".join(dims.APPROVAL_TERMS)), F.lit(False))
    gate = F.filter(_strong(F.concat(text.news_tokens(col(a, "title")), col(a, "lead20"))), text.looks_like_company)
    found = F.arrays_overlap(gate, F.concat(text.news_tokens(col(b, "title")), text.news_tokens(col(b, "content_text"))))
    return ~asks | (F.size(gate) == 0) | found


def rule_score(a: str, b: str) -> tuple[Column, Column]:
    """(score, reasons) of the pair of article structs ``a`` and ``b``: shared title, entity and body tokens, tokens of the
    attachments of ``a`` in ``b``, the same organisation, near days; at most 1."""
    col = lambda side, name: F.col(f"{side}.{name}")
    both = lambda f, name: F.array_intersect(f(col(a, name)), f(col(b, name)))
    titles = F.size(_strong(both(text.news_tokens, "title")))
    bodies = F.size(F.filter(_strong(both(text.news_tokens, "content_text")), lambda t: F.length(t) >= 3))
    in_news = F.concat(text.news_tokens(col(b, "title")), text.news_tokens(col(b, "content_text")))
    attached = F.size(_strong(F.array_intersect(col(a, "attached"), in_news)))
    named = lambda side: entities(col(side, "title"), col(side, "organization"), col(side, "lead30"))
    names = F.size(F.filter(F.array_intersect(named(a), named(b)), text.looks_like_company))
    org = [F.lower(F.trim(F.coalesce(col(s, "organization"), F.lit("")))) for s in (a, b)]
    same = (org[0] != "") & (org[0] == org[1])
    near = F.coalesce(text.date_nearness(text.iso_date(col(a, "published_at")), text.iso_date(col(b, "published_at"))), F.lit(0.0))
    part = lambda n, each, most: F.least(F.lit(most), n * each)
    score = part(titles, 0.10, 0.36) + part(attached, 0.10, 0.40) + part(names, 0.14, 0.42) + part(bodies, 0.02, 0.16) + F.when(same, 0.08).otherwise(0.0) + 0.08 * near
    reasons = F.array_compact(
        F.array(
            F.when(titles > 0, F.lit("제목 키워드 일치")), F.when(attached > 0, F.lit("첨부 핵심어 일치")), F.when(names > 0, F.lit("고유명사 일치")),
            F.when(bodies > 0, F.lit("본문 키워드 유사")), F.when(same, F.lit("기관명 일치")), F.when(near > 0, F.lit("시점 인접")),
        )
    )
    return F.least(score, F.lit(1.0)), reasons


def related_news(
    articles: DataFrame, queries: DataFrame, limit: int = 5, least_rule: float = 0.16, least_final: float = 0.22,
    attachments: DataFrame | None = None, extractions: DataFrame | None = None,
) -> DataFrame:
    """query_id, doc_id, final_score, rule_score, sparse_rank, reasons of the best related news of each query article.
    Without ``attachments`` and ``extractions`` no article has any."""
    attached = None
    columns = [F.array().cast("array<string>").alias(c) for c in ("lead20", "lead30", "attached")]
    sides = articles.select("*", *columns)
    if attachments is not None and extractions is not None:
        news = articles.where(text.is_news(F.col("source_channel"), F.col("source_system"), F.col("organization")))
        attached = materialize(attachment_tokens(queries.select("id").union(news.select("id")), attachments, extractions), "attached")
        sides = articles.join(attached, "id", "left").withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("lead20", "lead30", "attached")})
    cand = candidate_news(articles, queries, attached=attached)
    cols = ["id", "title", "content_text", "organization", "published_at", "lead30"]
    # the wide side, with all tokens of the attachments, comes last: its pairs are not shuffled
    pairs = cand.join(sides.select(F.col("id").alias("doc_id"), F.struct(*cols).alias("b")), "doc_id")
    asked = sides.join(queries.select("id"), "id", "left_semi")
    pairs = pairs.join(asked.select(F.col("id").alias("query_id"), F.struct(*cols, "lead20", "attached").alias("a")), "query_id").where(passes_gate("a", "b"))
    score, reasons = rule_score("a", "b")
    out = pairs.withColumn("rule_score", score).withColumn("reasons", reasons)
    out = out.withColumn("final_score", 0.75 * F.col("rule_score") + 0.25 * F.greatest(F.lit(0.0), 1 - (F.col("rank") - 1) / 50.0))
    minor = F.array(F.lit("시점 인접"), F.lit("본문 키워드 유사"))
    main = F.array_except("reasons", minor)
    out = out.withColumn("reasons", F.when(F.size(main) > 0, main).otherwise(F.col("reasons")))
    out = out.where((F.col("rule_score") >= least_rule) & (F.col("final_score") >= least_final) & (F.size(F.array_remove("reasons", "시점 인접")) > 0))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("final_score", 4)), F.col("b.published_at").desc_nulls_last(), "doc_id"))
    out = out.withColumn("place", place).where(F.col("place") <= limit)
    return out.select("query_id", "doc_id", F.round("final_score", 4).alias("final_score"), F.round("rule_score", 4).alias("rule_score"), F.col("rank").alias("sparse_rank"), F.slice("reasons", 1, 3).alias("reasons"))


def similar_titles(articles: DataFrame, queries: DataFrame, limit: int = 8) -> DataFrame:
    """query_id, doc_id, score, rank: articles of the same organisation or channel with the best BM25 match to the
    query article's title tokens. Nulls are equal to nothing."""
    words = F.filter(text.pair_tokens(F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content_text", F.lit(""))))), lambda t: F.length(t) >= 2)
    index = Bm25Index(articles, "id", words, k1=1.2, alike=("organization", "source_channel"))
    asked = queries.select(F.col("id").alias("query_id"), text.title_tokens(F.col("title")).alias("tokens"), "organization", "source_channel").where(F.size("tokens") > 0)
    return index.search(asked, limit, skip_self=True).select("query_id", "doc_id", "score", "rank")


@F.pandas_udf(DoubleType())
def surface_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two strings; 0 if one is null or empty."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b)])


def title_similarity(a: Column, b: Column, floor: float | None = 0.16) -> Column:
    """0.65 Jaccard of the title tokens and 0.35 surface ratio; below ``floor`` 0."""
    score = 0.65 * text.jaccard(text.title_tokens(a), text.title_tokens(b)) + 0.35 * surface_ratio(a, b)
    score = F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0).otherwise(score)
    return score if floor is None else F.when(score >= floor, score).otherwise(0.0)


def rule_scores(guidance_terms: list[str], rules: DataFrame, hits: DataFrame) -> DataFrame:
    """rule_id, match_score, match_terms: for the best hit of each rule 650 times its fused score, plus 3 for each shared
    term and 6 for each term inside the rule's name. ``rules`` has rule_id, rule_name, terms; ``hits`` rule_id, score, rank."""
    terms = F.array(*[F.lit(t) for t in sorted(guidance_terms)])
    r = rules.withColumn("shared", F.array_intersect(terms, "terms")).withColumn("inside", F.filter(terms, lambda t: F.lower("rule_name").contains(t)))
    best = hits.withColumn("_r", F.row_number().over(Window.partitionBy("rule_id").orderBy(F.desc("score"), "rank"))).where("_r = 1")
    out = r.join(best.select("rule_id", "score"), "rule_id")
    score = F.col("score") * 650 + 3 * F.size("shared") + 6 * F.size("inside")
    return out.select("rule_id", "rule_name", F.round(score, 4).alias("match_score"), F.slice(F.array_sort(F.array_union("shared", "inside")), 1, 30).alias("match_terms")).orderBy(F.desc("match_score"), "rule_name")


def rule_impact(guidance_terms: list[str], rules: DataFrame, hits: DataFrame, most: int | None = None, rule_terms: int = 50) -> DataFrame:
    """rule_id, match_score, best first (``most`` of them): ``rule_scores`` of rules (rule_id, rule_name, tokens) by their most
    frequent ``rule_terms`` tokens and hits (rule_id, rank), whose fused score is one over 60 plus the rank. A rule with
    several hits keeps its best."""
    counted = rules.join(hits.select("rule_id").distinct(), "rule_id", "left_semi").select("rule_id", "rule_name", F.explode("tokens").alias("term")).groupBy("rule_id", "rule_name", "term").count()
    place = F.row_number().over(Window.partitionBy("rule_id", "rule_name").orderBy(F.desc("count"), "term"))
    terms = counted.withColumn("_p", place).where(F.col("_p") <= rule_terms).groupBy("rule_id", "rule_name").agg(F.collect_set("term").alias("terms"))
    scored = rule_scores(guidance_terms, terms, hits.select("rule_id", (1 / (60 + F.col("rank"))).alias("score"), "rank"))
    out = scored.select("rule_id", "match_score").orderBy(F.desc("match_score"), "rule_id")
    return out.limit(most) if most is not None else out


def sectioned_text(title: Column, attachments: Column, body: Column, most: int = 3, attachment_limit: int = 1800, body_limit: int = 2200) -> Column:
    """A document's text in sections: its title, its first ``most`` attachments (an array of struct file_name, text_content)
    and its body, the texts collapsed and shortened to their limits; sections without text are left out."""
    first = F.slice(F.coalesce(attachments, F.array().cast("array<struct<file_name:string,text_content:string>>")), 1, most)
    given = F.filter(first, lambda a: text.collapse(F.coalesce(a["text_content"], F.lit(""))) != "")
    name = lambda a: F.coalesce(F.nullif(a["file_name"], F.lit("")), F.lit("file"))
    files = F.array_join(F.transform(given, lambda a: F.concat(F.lit("[ATTACHMENT:"), name(a), F.lit("]\n"), text.shorten(a["text_content"], attachment_limit))), "\n\n")
    short = text.shorten(body, body_limit)
    parts = [F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("[TITLE]\n"), title)), F.nullif(files, F.lit("")), F.when(short != "", F.concat(F.lit("[BODY]\n"), short))]
    return F.trim(F.concat_ws("\n\n", *parts))
