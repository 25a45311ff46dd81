"""Ranked retrieval. The query set is every row whose id is divisible by 20, searched against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawloom.functions import dims, text
from lawloom.operators import keywords, related, retrieval
from lawloom.plans import fragments as q
from lawloom.plans.catalog import query
from lawloom.session import spread, table

_TOKENS = (
    "list_filter(list_transform(regexp_extract_all({0}, '[가-힣A-Za-z0-9][가-힣A-Za-z0-9_\\-/.]+'), lambda t: lower(regexp_replace(t, '^[._\\-/]+|[._\\-/]+$', '', 'g'))), "
    "lambda t: length(t) >= 2 AND NOT regexp_full_match(t, '[0-9]+'))"
)
_DOC = "coalesce(title, '') || ' ' || coalesce(content_text, '')"


def bm25_sql(doc_tokens: str, query_rows: str, limit: int, k1: float = 1.5, skip_self: bool = False) -> str:
    """The ranking as CTEs ending in r(query_id, doc_id, score, rank); ``query_rows`` selects query_id and tokens."""
    return f"""
d AS (SELECT id AS doc_id, {doc_tokens} AS toks FROM articles), st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM d),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM d) GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(tokens) AS term FROM ({query_rows})) GROUP BY 1, 2),
s AS (SELECT qt.query_id, p.doc_id, sum(qt.qtf * ln(1 + (st.n - f.df + 0.5) / (f.df + 0.5)) * (p.tf * {k1 + 1} / (p.tf + {k1} * (0.25 + 0.75 * greatest(len(d.toks), 1) / st.avgdl)))) AS score
  FROM qt JOIN f USING (term) JOIN p USING (term) JOIN d ON d.doc_id = p.doc_id CROSS JOIN st {"WHERE qt.query_id <> p.doc_id" if skip_self else ""} GROUP BY 1, 2),
r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s WHERE score > 0 QUALIFY rank <= {limit})
"""


_ASKED = f"SELECT id AS query_id, {_TOKENS.format(chr(34) + 'title' + chr(34))} AS tokens FROM articles WHERE id % 20 = 0 AND title IS NOT NULL"


def _bm25(spark, root, limit: int) -> DataFrame:
    a = table(spark, root, "articles").select("id", "title", "content_text")
    whole = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content_text", F.lit("")))
    asked = a.where("id % 20 = 0 and title is not null").select(F.col("id").alias("query_id"), text.retrieval_tokens(F.col("title")).alias("tokens"))
    return retrieval.Bm25Index(a, "id", text.retrieval_tokens(whole)).search(asked, limit)


@query(f"WITH {bm25_sql(_TOKENS.format(_DOC), _ASKED, 10)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r")
def bm25_search(spark, root) -> DataFrame:
    return _bm25(spark, root, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"SELECT id, {_TOKENS.format(_DOC)} AS tokens FROM articles")
def retrieval_tokens_of_articles(spark, root) -> DataFrame:
    whole = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content_text", F.lit("")))
    return table(spark, root, "articles").select("id", text.retrieval_tokens(whole).alias("tokens"))


_DENSE = """
s AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0),
dr AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s WHERE score > 0 QUALIFY rank <= {limit})
"""


def _dense(spark, root, limit: int) -> DataFrame:
    v = table(spark, root, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return retrieval.dense_search(v.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "embedding"), v, limit)


@query(f"WITH {_DENSE.format(limit=10)} SELECT query_id, doc_id, round(score, 5) AS score, rank FROM dr")
def dense_search(spark, root) -> DataFrame:
    return _dense(spark, root, 10).select("query_id", "doc_id", F.round("score", 5).alias("score"), "rank")


@query(f"""
WITH {_DENSE.format(limit=2000000000)} SELECT query_id, doc_id, round(score, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank
FROM dr JOIN embeddings e ON e.vec_id = dr.doc_id WHERE e.label % 2 = 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dr.rank) <= 10
""")
def dense_among_allowed(spark, root) -> DataFrame:
    v = table(spark, root, "embeddings")
    allowed = v.where("label % 2 = 0").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.dense_search(asked, allowed, 10).select("query_id", "doc_id", F.round("score", 5).alias("score"), "rank")


_FUSED = f"""
WITH {bm25_sql(_TOKENS.format(_DOC), _ASKED, 80)}, {_DENSE.format(limit=80).replace("s AS", "ds AS").replace("FROM s ", "FROM ds ")},
u AS (SELECT query_id, doc_id, 1.0 / (60 + rank) AS part, rank AS b, NULL AS d FROM r UNION ALL SELECT query_id, doc_id, 1.0 / (60 + rank), NULL, rank FROM dr),
g AS (SELECT query_id, doc_id, sum(part) AS score, max(b) AS b, max(d) AS d FROM u GROUP BY 1, 2)
SELECT query_id, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, b NULLS LAST, d NULLS LAST, doc_id) AS rank FROM g QUALIFY rank <= 30
"""


@query(_FUSED.replace("1.0 / (60 + rank)", "CAST(1 AS DOUBLE) / (60 + rank)"))
def fused_search(spark, root) -> DataFrame:
    lists = {"bm25": _bm25(spark, root, 80), "dense": _dense(spark, root, 80)}
    return retrieval.reciprocal_rank_fusion(lists, 30).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


@query()
def unified_search(spark, root) -> DataFrame:
    a = table(spark, root, "articles").select("id", "title", "content_text")
    asked = a.where("id % 20 = 0 and title is not null").select(F.col("id").alias("query_id"), F.col("title").alias("query_text"))
    return retrieval.unified_search(a, asked, "id", "title", "content_text").select("query_id", "doc_id", "score", "rank")


@query()
def hash_embeddings(spark, root) -> DataFrame:
    a = table(spark, root, "articles").select("id", "title", "content_text")
    return retrieval.hash_embeddings(a, "id", text.retrieval_tokens(F.concat_ws(" ", "title", "content_text")))


@query()
def document_chunks(spark, root) -> DataFrame:
    return retrieval.chunks(table(spark, root, "documents"), "doc_id", "title", "text").select("chunk_id", "doc_id", "chunk_no", F.length("text").alias("chars"))


@query("SELECT substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) AS point_id, doc_id FROM (SELECT doc_id, md5(CAST(doc_id AS VARCHAR) || '#0') AS m FROM documents WHERE lang IS DISTINCT FROM 'ko')")
def vectors_to_add(spark, root) -> DataFrame:
    d = table(spark, root, "documents").select("doc_id", "lang", F.concat(F.col("doc_id").cast("string"), F.lit("#0")).alias("chunk_id"))
    stored = d.where("lang = 'ko'").select(text.stable_id(F.col("chunk_id")).alias("point_id"))
    return retrieval.missing_vectors(d, stored).select("point_id", "doc_id")


@query()
def chunk_vectors_to_add(spark, root) -> DataFrame:
    """The chunks of all documents whose vectors are not stored yet, if those of the Korean documents are."""
    d = table(spark, root, "documents")
    pieces = lambda rows: retrieval.chunks(rows, "doc_id", "title", "text")
    stored = pieces(d.where("lang = 'ko'")).select(text.stable_id(F.col("chunk_id")).alias("point_id"))
    return retrieval.missing_vectors(pieces(d), stored).select("point_id", "chunk_id", "doc_id", "chunk_no")


_ALNUM = f"regexp_extract_all(lower({_DOC}), '[가-힣a-zA-Z0-9]{{2,}}')"
_TITLES = f"list_distinct(list_transform(list_filter(regexp_extract_all(coalesce(title, ''), '[가-힣a-zA-Z0-9]{{2,}}'), lambda t: t NOT IN {q.words(dims.TITLE_STOPWORDS)}), lambda t: lower(t)))"


@query(f"""
WITH {bm25_sql(_ALNUM, f"SELECT id AS query_id, {_TITLES} AS tokens FROM articles WHERE id % 20 = 0", 2000000000, 1.2, True)}
SELECT r.query_id, r.doc_id, round(r.score, 6) AS score, row_number() OVER (PARTITION BY r.query_id ORDER BY round(r.score, 9) DESC, r.doc_id) AS rank
FROM r JOIN articles a ON a.id = r.query_id JOIN articles b ON b.id = r.doc_id WHERE a.organization = b.organization OR a.source_channel = b.source_channel
QUALIFY row_number() OVER (PARTITION BY r.query_id ORDER BY round(r.score, 9) DESC, r.doc_id) <= 8
""")
def similar_articles(spark, root) -> DataFrame:
    a = table(spark, root, "articles").select("id", "title", "content_text", "organization", "source_channel")
    return related.similar_titles(a, a.where("id % 20 = 0")).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


_STOPSQL = q.words(dims.NEWS_STOPWORDS)
_NEWS = f"list_filter(list_transform(regexp_extract_all(coalesce({{0}}, ''), '[가-힣a-zA-Z0-9]{{{{2,}}}}'), lambda t: lower(t)), lambda t: t NOT IN {_STOPSQL})"
_TERMS = f"""
qs AS (SELECT * FROM articles WHERE id % 20 = 0),
tt AS (SELECT id, unnest(list_slice({_NEWS.format('title')}, 1, 12)) AS term, 4 AS w FROM qs), tb AS (SELECT id, unnest(list_slice({_NEWS.format('content_text')}, 1, 20)) AS term, 1 AS w FROM qs),
tw AS (SELECT id, term, sum(w) AS w FROM (SELECT * FROM tt UNION ALL SELECT * FROM tb) GROUP BY 1, 2),
tk AS (SELECT id AS query_id, list(term) AS tokens FROM (SELECT * FROM tw QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, term) <= 12) GROUP BY 1)
"""


@query(f"""
WITH {_TERMS}, {bm25_sql(_ALNUM, "SELECT query_id, tokens FROM tk", 200, 1.2, True)}
SELECT r.query_id, r.doc_id, row_number() OVER (PARTITION BY r.query_id ORDER BY r.rank) AS rank FROM r JOIN articles a ON a.id = r.doc_id
WHERE a.source_channel IN {q.words(dims.NEWS_CHANNELS)} OR a.source_system IN {q.words(dims.NEWS_CHANNELS)} QUALIFY row_number() OVER (PARTITION BY r.query_id ORDER BY r.rank) <= 50
""")
def news_candidates(spark, root) -> DataFrame:
    a = table(spark, root, "articles").select("id", "title", "content_text", "organization", "source_channel", "source_system")
    return related.candidate_news(a, a.where("id % 20 = 0"))


@query()
def related_news(spark, root) -> DataFrame:
    a = table(spark, root, "articles").select("id", "title", "content_text", "organization", "published_at", "source_channel", "source_system")
    return related.related_news(a, a.where("id % 20 = 0"), attachments=table(spark, root, "attachments"), extractions=table(spark, root, "attachment_extractions"))


_SETS = f"SELECT id, source_item_id, title, {_TITLES} AS t FROM articles WHERE source_item_id IS NOT NULL"


@query(f"""
WITH s AS ({_SETS}) SELECT a.id AS id_a, b.id AS id_b, CASE WHEN len(list_distinct(list_concat(a.t, b.t))) > 0 THEN round(len(list_intersect(a.t, b.t)) / CAST(len(list_distinct(list_concat(a.t, b.t))) AS DOUBLE), 6) ELSE 0 END AS jaccard
FROM s a JOIN s b ON a.source_item_id = b.source_item_id AND a.id < b.id
""")
def title_jaccard_of_versions(spark, root) -> DataFrame:
    """Titles of the versions of an item that was collected again. The pairs of one item id, not of a group of hot keys."""
    s = table(spark, root, "articles").where("source_item_id is not null").select("id", "source_item_id", text.title_tokens(F.col("title")).alias("t"))
    a, b = s.select(F.col("id").alias("id_a"), "source_item_id", F.col("t").alias("ta")), s.select(F.col("id").alias("id_b"), "source_item_id", F.col("t").alias("tb"))
    return a.join(b, "source_item_id").where("id_a < id_b").select("id_a", "id_b", F.round(text.jaccard(F.col("ta"), F.col("tb")), 6).alias("jaccard"))


@query()
def title_similarity_of_versions(spark, root) -> DataFrame:
    s = table(spark, root, "articles").where("source_item_id is not null").select("id", "source_item_id", "title")
    a, b = s.select(F.col("id").alias("id_a"), "source_item_id", F.col("title").alias("ta")), s.select(F.col("id").alias("id_b"), "source_item_id", F.col("title").alias("tb"))
    return a.join(b, "source_item_id").where("id_a < id_b").select("id_a", "id_b", related.title_similarity(F.col("ta"), F.col("tb")).alias("similarity"))


_GUIDE = f"SELECT term FROM (SELECT unnest({{words}}) AS term FROM articles WHERE source_channel LIKE '%guidance%') GROUP BY 1 ORDER BY count(*) DESC, term LIMIT 140"
_RULE_TOKENS = (
    "list_filter(list_transform(regexp_extract_all({0}, '[가-힣A-Za-z0-9][가-힣A-Za-z0-9·ㆍ\\-/]+'), lambda t: lower(regexp_replace(t, '^[\\-/]+|[\\-/]+$', '', 'g'))), "
    f"lambda t: length(t) >= 2 AND t NOT IN {q.words(dims.RULE_STOPWORDS)} AND NOT regexp_full_match(t, '[0-9]+'))"
)


@query(f"""
WITH gt AS ({_GUIDE.format(words=_RULE_TOKENS.format(_DOC))}), {bm25_sql(_RULE_TOKENS.format(_DOC), "SELECT 0 AS query_id, list(term) AS tokens FROM gt", 160)},
ru AS (SELECT id AS rule_id, title AS rule_name, {_RULE_TOKENS.format(_DOC)} AS toks FROM articles WHERE source_channel LIKE '%rule_change%' AND title IS NOT NULL),
rt AS (SELECT rule_id, term FROM (SELECT rule_id, unnest(toks) AS term FROM ru) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY count(*) DESC, term) <= 50),
sh AS (SELECT rule_id, count(*) AS shared FROM rt JOIN gt USING (term) GROUP BY 1), ti AS (SELECT rule_id, count(*) AS inside FROM ru JOIN gt ON contains(lower(rule_name), gt.term) GROUP BY 1)
SELECT ru.rule_id, round(650 / (60.0 + r.rank) + 3 * coalesce(sh.shared, 0) + 6 * coalesce(ti.inside, 0), 4) AS match_score
FROM r JOIN ru ON ru.rule_id = r.doc_id LEFT JOIN sh USING (rule_id) LEFT JOIN ti USING (rule_id) ORDER BY match_score DESC, ru.rule_id LIMIT 30
""")
def rule_impact(spark, root) -> DataFrame:
    """Rule notices most affected by the guidance, scored by rank, shared terms and terms in their names."""
    a = spread(table(spark, root, "articles").select("id", "title", "content_text", "source_channel"))
    words = text.rule_tokens(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content_text", F.lit(""))))
    guide = [r.term for r in keywords.top_terms(a.where("source_channel like '%guidance%'"), words, 140).collect()]  # 140 rows
    asked = spark.createDataFrame([(0, guide)], "query_id bigint, tokens array<string>")
    hits = retrieval.Bm25Index(a, "id", words).search(asked, 160)
    rules = a.where("source_channel like '%rule_change%' and title is not null")
    return related.rule_impact(guide, rules.select(F.col("id").alias("rule_id"), F.col("title").alias("rule_name"), words.alias("tokens")), hits.select(F.col("doc_id").alias("rule_id"), "rank"), 30)
