"""Keywords, co-occurrence and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawloom.functions import dims, text
from lawloom.operators import keywords as K
from lawloom.plans import fragments as q
from lawloom.plans.catalog import query
from lawloom.session import spread, table

_ENDING = "(?:" + "|".join(sorted(dims.PARTICLES, key=lambda p: (-len(p), p))) + ")$"
_STOP = ["점검", "결과", "관련"]
_SYN = [("유의사항", "주의사항"), ("보도설명", "설명자료")]
_KEYWORDS = f"list_filter(list_transform(regexp_extract_all({{0}}, '[가-힣]{{{{2,}}}}|[a-zA-Z]{{{{3,}}}}'), lambda t: regexp_replace(t, '{_ENDING}', '')), lambda t: length(t) >= 2)"
_TITLE = "coalesce(title, '')"
_BOTH = "coalesce(title, '') || ' ' || coalesce(content_text, '')"
_PAIRS = "regexp_extract_all({0}, '[가-힣a-zA-Z0-9]{{2,}}')"
_DICTIONARIES = f"""
syn(canonical, synonym) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _SYN)}), stop(word) AS (VALUES {", ".join(f"('{w}')" for w in _STOP)}),
"""


def _words_sql(tokens: str) -> str:
    kept = "SELECT id, coalesce(s.canonical, tok) AS word FROM raw LEFT JOIN syn s ON s.synonym = tok WHERE coalesce(s.canonical, tok) NOT IN (SELECT word FROM stop)"
    return f"raw AS (SELECT id, unnest({tokens}) AS tok FROM articles), w AS ({kept})"


def _dictionaries(spark) -> dict[str, DataFrame]:
    return {"stopwords": spark.createDataFrame([(w,) for w in _STOP], "word string"), "synonyms": spark.createDataFrame(_SYN, "canonical string, synonym string")}


def _articles(spark, root, keep=()) -> DataFrame:
    a = spread(table(spark, root, "articles").select("id", "title", "content_text", "published_at"))
    for name, column in keep:
        a = a.withColumn(name, column)
    return a


def _counts(spark, root, tokens, target="title", keep=()) -> DataFrame:
    return K.count_words(_articles(spark, root, keep), tokens(K.target_text(target)), **_dictionaries(spark), by=tuple(n for n, _ in keep))


_TFIDF = """
WITH {dict} {words}, p AS (SELECT word, id, count(*) AS c FROM w GROUP BY 1, 2)
SELECT word, CAST(sum(c) AS BIGINT) AS tf, count(*) AS df, CAST(round_even(CAST(sum(c) * (ln(((SELECT count(*) FROM articles) + 1.0) / (count(*) + 1)) + 1) AS DOUBLE), 0) AS BIGINT) AS score FROM p GROUP BY 1
"""


@query(_TFIDF.format(dict=_DICTIONARIES, words=_words_sql(_KEYWORDS.format(_TITLE))))
def keyword_scores_titles(spark, root) -> DataFrame:
    return K.tfidf(_counts(spark, root, text.keyword_tokens), table(spark, root, "articles").count())


@query(_TFIDF.format(dict=_DICTIONARIES, words=_words_sql(_KEYWORDS.format(_BOTH))) + " ORDER BY score DESC, word LIMIT 50")
def keyword_top_content(spark, root) -> DataFrame:
    n = table(spark, root, "articles").count()
    return K.tfidf(_counts(spark, root, text.keyword_tokens, "both"), n).orderBy(F.desc("score"), "word").limit(50)


_COOC = f"""
WITH {_DICTIONARIES} {_words_sql(_PAIRS.format(_BOTH))}, d AS (SELECT DISTINCT id, word FROM w),
top AS (SELECT word, count(*) AS freq FROM d GROUP BY 1 ORDER BY freq DESC, word LIMIT 40), k AS (SELECT d.* FROM d JOIN top USING (word))
"""


@query(_COOC + "SELECT word, freq FROM top")
def cooccurrence_nodes(spark, root) -> DataFrame:
    return K.document_network(_articles(spark, root), text.pair_tokens(K.target_text("both")), **_dictionaries(spark))[0]


@query(_COOC + "SELECT a.word AS source, b.word AS target, count(*) AS weight FROM k a JOIN k b ON a.id = b.id AND a.word < b.word GROUP BY 1, 2 HAVING count(*) >= 2")
def cooccurrence_edges(spark, root) -> DataFrame:
    return K.document_network(_articles(spark, root), text.pair_tokens(K.target_text("both")), **_dictionaries(spark))[1]


def _trend_sql(label: str) -> str:
    return f"""
WITH {_DICTIONARIES} lab AS (SELECT id, title, {label} AS period FROM articles), raw AS (SELECT id, period, unnest({_KEYWORDS.format(_TITLE)}) AS tok FROM lab),
w AS (SELECT id, period, coalesce(s.canonical, tok) AS word FROM raw LEFT JOIN syn s ON s.synonym = tok WHERE coalesce(s.canonical, tok) NOT IN (SELECT word FROM stop)),
top AS (SELECT word, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, word LIMIT 10), per AS (SELECT DISTINCT period FROM lab), c AS (SELECT period, word, count(*) AS n FROM w GROUP BY 1, 2)
SELECT per.period, top.word, coalesce(c.n, 0) AS cnt FROM per CROSS JOIN top LEFT JOIN c ON c.period = per.period AND c.word = top.word
"""


_DAY10 = "substr(published_at, 1, 10)"
_MONTH = f"CASE WHEN coalesce(published_at, '') = '' THEN '미상' ELSE substr({_DAY10}, 1, 7) END"
_WEEK = f"CASE WHEN coalesce(published_at, '') = '' THEN '미상' ELSE coalesce(strftime(date_trunc('week', {q.day('published_at')}), '%Y-%m-%d'), substr({_DAY10}, 1, 7)) END"


def _trend(spark, root, granularity: str) -> DataFrame:
    label = text.period_label(F.col("published_at"), granularity)
    counts = _counts(spark, root, text.keyword_tokens, keep=(("period", label),))
    return K.trend(counts, "period", periods=table(spark, root, "articles").select(label.alias("period")))


@query(_trend_sql(_MONTH))
def keyword_trend_months(spark, root) -> DataFrame:
    return _trend(spark, root, "month")


@query(_trend_sql(_WEEK))
def keyword_trend_weeks(spark, root) -> DataFrame:
    return _trend(spark, root, "week")


@query(f"SELECT canonical, list(synonym ORDER BY synonym) AS synonyms FROM (VALUES {', '.join(f'({chr(39)}{a}{chr(39)}, {chr(39)}{b}{chr(39)})' for a, b in _SYN)}) t(canonical, synonym) GROUP BY 1")
def synonym_groups(spark, root) -> DataFrame:
    return _dictionaries(spark)["synonyms"].groupBy("canonical").agg(F.array_sort(F.collect_set("synonym")).alias("synonyms"))


_STOPSQL = q.words(dims.NEWS_STOPWORDS)
_NEWS = f"list_filter(list_transform(regexp_extract_all(coalesce({{0}}, ''), '[가-힣a-zA-Z0-9]{{{{2,}}}}'), lambda t: lower(t)), lambda t: t NOT IN {_STOPSQL})"


@query(f"""
WITH t AS (SELECT id, unnest(list_slice({_NEWS.format('title')}, 1, 12)) AS term, 4 AS w FROM articles), b AS (SELECT id, unnest(list_slice({_NEWS.format('content_text')}, 1, 20)) AS term, 1 AS w FROM articles),
s AS (SELECT id AS doc_id, term, CAST(sum(w) AS BIGINT) AS weight FROM (SELECT * FROM t UNION ALL SELECT * FROM b) GROUP BY 1, 2)
SELECT doc_id, term, weight, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rank FROM s QUALIFY rank <= 12
""")
def query_terms(spark, root) -> DataFrame:
    return K.weighted_terms(table(spark, root, "articles"))


_RULE_WORDS = f"list_filter(list_transform(regexp_extract_all({{0}}, '[가-힣A-Za-z0-9][가-힣A-Za-z0-9·ㆍ\\-/]+'), lambda t: lower(regexp_replace(t, '^[\\-/]+|[\\-/]+$', '', 'g'))), lambda t: length(t) >= 2 AND t NOT IN {q.words(dims.RULE_STOPWORDS)} AND NOT regexp_full_match(t, '[0-9]+'))"


@query(f"SELECT term, count(*) AS count FROM (SELECT unnest({_RULE_WORDS.format(_BOTH)}) AS term FROM articles) GROUP BY 1 ORDER BY count DESC, term LIMIT 80")
def top_terms(spark, root) -> DataFrame:
    return K.top_terms(_articles(spark, root), text.rule_tokens(K.target_text("both")))
