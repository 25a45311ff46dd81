"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawloom.functions import dims, legal, text
from lawloom.plans import fragments as q
from lawloom.plans.catalog import query
from lawloom.session import table
from lawloom.sources.html import html_links, html_text

_WSC = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+"


@query(f"""
SELECT id, {q.ws("title")} AS collapsed, regexp_replace(content_text, '\\n(?:\\s*\\n){{2,}}', chr(10) || chr(10), 'g') AS squeezed, regexp_replace(coalesce(department, ''), '{_WSC}', '', 'g') AS department_key,
  CASE WHEN length({q.ws("coalesce(content_text, '')")}) <= 280 THEN {q.ws("coalesce(content_text, '')")} ELSE rtrim(substr({q.ws("coalesce(content_text, '')")}, 1, 279)) || '…' END AS summary,
  CASE WHEN contains(title, '전부개정') THEN '전부개정' WHEN contains(title, '일부개정') THEN '일부개정' WHEN contains(title, '개정') THEN '개정' WHEN contains(title, '제정') THEN '제정' WHEN contains(title, '폐지') THEN '폐지' END AS amendment,
  greatest(1, length(coalesce(content_text, '')) // 3) AS token_estimate, CASE WHEN content_text <> '' THEN sha256(content_text) END AS content_hash
FROM articles
""")
def article_texts(spark, root) -> DataFrame:
    body = F.col("content_text")
    return table(spark, root, "articles").select(
        "id", text.collapse(F.col("title")).alias("collapsed"), text.squeeze_blank_lines(body).alias("squeezed"), text.without_spaces(F.col("department")).alias("department_key"),
        text.shorten(body, 280).alias("summary"), text.amendment_type(F.col("title")).alias("amendment"), text.token_estimate(body).alias("token_estimate"), text.content_hash(body).alias("content_hash"),
    )




def _padded(c: str) -> str:
    t = f"regexp_replace({c}, '{_WSC}', '', 'g')"
    t = f"regexp_replace(regexp_replace(translate(translate({t}, '년월/-', '....'), '일', ''), '^\\.+', ''), '\\.+$', '')"
    g = [f"regexp_extract({t}, '^([0-9]{{4}})\\.([0-9]{{1,2}})\\.([0-9]{{1,2}})$', {k})" for k in (1, 2, 3)]
    return f"CASE WHEN {g[0]} <> '' THEN {g[0]} || '-' || lpad({g[1]}, 2, '0') || '-' || lpad({g[2]}, 2, '0') END"


@query(f"""
SELECT id, translate(substr(published_at, 1, 10), './', '--') AS published_day, {q.day("published_at")} AS published_date, {_padded("effective_date")} AS effective_day,
  CASE WHEN coalesce(published_at, '') = '' THEN '미상' ELSE substr(substr(published_at, 1, 10), 1, 7) END AS month_label,
  greatest(0.0, 1 - abs(date_diff('day', {q.day("published_at")}, DATE '2025-06-01')) / 90.0)::DOUBLE AS nearness
FROM articles
""")
def article_dates(spark, root) -> DataFrame:
    at = F.col("published_at")
    near = F.round(text.date_nearness(text.iso_date(at), F.lit("2025-06-01").cast("date")), 6)
    near = F.when(text.iso_date(at).isNotNull(), near).otherwise(F.lit(0.0))
    return table(spark, root, "articles").select(
        "id", text.published_day(at).alias("published_day"), text.iso_date(at).alias("published_date"), text.padded_day(F.col("effective_date")).alias("effective_day"), text.period_label(at, "month").alias("month_label"), near.alias("nearness")
    )


@query(f"""
SELECT id, CASE WHEN contains(file_name, '.') THEN lower(regexp_extract(file_name, '([^.]*)$', 1)) END AS extension, {q.name_in_url("file_url")} AS url_name, {q.attachment_title("file_name", "file_url")} AS title_key,
  {q.format_rank("file_ext")} AS format_rank, sha256(file_url) AS url_hash
FROM attachments
""")
def attachment_names(spark, root) -> DataFrame:
    name, url = F.col("file_name"), F.col("file_url")
    return table(spark, root, "attachments").select("id", text.extension(name).alias("extension"), text.name_in_url(url).alias("url_name"), text.attachment_title(name, url).alias("title_key"), dims.format_rank(F.col("file_ext")).alias("format_rank"), F.sha2(url, 256).alias("url_hash"))


@query("SELECT id, nullif(regexp_extract(detail_url, '[?&]no=([^&#]*)', 1), '') AS item_no, nullif(regexp_extract(detail_url, '[?&]p=([^&#]*)', 1), '') AS page_no FROM articles")
def article_url_parameters(spark, root) -> DataFrame:
    url = F.col("detail_url")
    return table(spark, root, "articles").select("id", text.url_parameter(url, "no").alias("item_no"), text.url_parameter(url, "p").alias("page_no"))


@query(f"""
SELECT id, CASE source_channel {" ".join(f"WHEN '{c}' THEN '{dims.ORGANIZATIONS[c.split('_')[0]]}'" for c in dims.CANONICAL_CHANNELS)} ELSE organization END AS organization,
  coalesce(source_channel IN {q.words(dims.NEWS_CHANNELS)}, false) OR coalesce(source_system IN {q.words(dims.NEWS_CHANNELS)}, false) AS is_news
FROM articles
""")
def article_organizations(spark, root) -> DataFrame:
    ch = F.col("source_channel")
    return table(spark, root, "articles").select("id", dims.canonical_organization(ch, F.col("organization")).alias("organization"), text.is_news(ch, F.col("source_system"), F.col("organization")).alias("is_news"))


_ART = "regexp_extract(content_text, '(?:제\\s*)?([0-9]+)\\s*조(?:\\s*의\\s*([0-9]+))?', {0})"


@query(f"""
SELECT id, CASE WHEN {_ART.format(1)} <> '' THEN '제' || {_ART.format(1)} || '조' || CASE WHEN {_ART.format(2)} <> '' THEN '의' || {_ART.format(2)} ELSE '' END END AS article_number,
  len(regexp_extract_all(coalesce(content_text, ''), '「([^」]{{2,60}})」', 1)) AS quoted
FROM articles
""")
def law_references(spark, root) -> DataFrame:
    body = F.coalesce(F.col("content_text"), F.lit(""))
    quoted = F.size(F.regexp_extract_all(body, F.lit("「([^」]{2,60})」"), F.lit(1)))
    return table(spark, root, "articles").select("id", legal.article_reference(F.col("content_text")).alias("article_number"), quoted.cast("bigint").alias("quoted"))


_ENDS = "(?:법|령|규칙|규정|고시|조례)"
_NAMES = (
    f"list_filter(list_transform(list_concat(regexp_extract_all(coalesce(content_text, ''), '[「『｢]([^」』｣]{{2,80}}{_ENDS})[^」』｣]*[」』｣]', 1), "
    f"regexp_extract_all(coalesce(content_text, ''), '([가-힣A-Za-z0-9ㆍ·\\s]{{2,80}}{_ENDS})\\s*제\\d+조', 1)), lambda n: {q.ws('n')}), lambda n: length(n) >= 2)"
)


@query(f"""
SELECT id, list_slice(list_transform(list_filter(range(1, len(l) + 1), lambda i: list_position(l, l[i]) = i), lambda i: l[i]), 1, 12) AS laws FROM (SELECT id, {_NAMES} AS l FROM articles)
""")
def law_mentions(spark, root) -> DataFrame:
    return table(spark, root, "articles").select("id", legal.law_mentions(F.col("content_text")).alias("laws"))


@query()
def effective_days_in_texts(spark, root) -> DataFrame:
    return table(spark, root, "articles").select("id", text.effective_day(F.col("content_text")).alias("effective_day"), text.date_range(F.col("effective_date")).alias("period"))


_RULE = q.words(dims.RULE_STOPWORDS)


@query(f"""
SELECT id, list_filter(list_transform(regexp_extract_all(coalesce(title, ''), '[가-힣A-Za-z0-9][가-힣A-Za-z0-9·ㆍ\\-/]+'), lambda t: lower(regexp_replace(t, '^[\\-/]+|[\\-/]+$', '', 'g'))), lambda t: length(t) >= 2 AND t NOT IN {_RULE} AND NOT regexp_full_match(t, '[0-9]+')) AS rule_tokens,
  regexp_extract_all(coalesce(title, ''), '[가-힣a-zA-Z0-9]{{2,}}') AS pair_tokens
FROM articles
""")
def title_tokens(spark, root) -> DataFrame:
    return table(spark, root, "articles").select("id", text.rule_tokens(F.col("title")).alias("rule_tokens"), text.pair_tokens(F.col("title")).alias("pair_tokens"))


@query("""
SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(last_error, '([?&]key=)[^&\\s]+', '\\1***', 'gi'), '(X-goog-api-key[:=]\\s*)[^\\s,]+', '\\1***', 'gi'), '(Authorization[:=]\\s*Bearer\\s+)[^\\s,]+', '\\1***', 'gi'), 'AIza[0-9A-Za-z\\-_]{20,}', '***', 'g') AS message
FROM attachments WHERE last_error IS NOT NULL
""")
def masked_errors(spark, root) -> DataFrame:
    return table(spark, root, "attachments").where("last_error is not null").select("id", text.mask_secrets(F.col("last_error")).alias("message"))


@query()
def article_html_texts(spark, root) -> DataFrame:
    return table(spark, root, "articles").where("content_html is not null").select("id", html_text(F.col("content_html")).alias("html_text"), html_links(F.col("content_html"), F.col("detail_url")).alias("files"))
