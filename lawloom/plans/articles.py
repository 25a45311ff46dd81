"""Article lists, search, statistics and report evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawloom.functions import dims, text
from lawloom.operators import evidence, search
from lawloom.plans import fragments as q
from lawloom.plans.catalog import query
from lawloom.session import materialize, table
from lawloom.sources.boards import SITES, board_records

_PRESS = q.words(dims.channels_of("press_release"))


@query(f"""
SELECT a.id, a.title, a.published_at, a.organization, coalesce(c.n, 0) AS attachment_count
FROM articles a LEFT JOIN (SELECT article_id, count(*) AS n FROM attachments GROUP BY 1) c ON c.article_id = a.id
WHERE {q.NOT_NEWS} AND source_channel IN {_PRESS} AND {q.day("published_at")} BETWEEN DATE '2024-03-01' AND DATE '2025-06-30'
""")
def article_list(spark, root) -> DataFrame:
    a = search.article_filter(table(spark, root, "articles"), "press_release", from_date="2024-03-01", to_date="2025-06-30")
    return search.with_attachment_count(a, table(spark, root, "attachments")).select("id", "title", "published_at", "organization", "attachment_count")


@query(f"""
SELECT id, title, published_at FROM articles WHERE {q.NOT_NEWS} ORDER BY published_at DESC NULLS LAST, id DESC LIMIT 20 OFFSET 20
""")
def article_page(spark, root) -> DataFrame:
    return search.page(search.article_filter(table(spark, root, "articles")).select("id", "title", "published_at"), number=2)


@query(f"SELECT id FROM articles WHERE {q.NOT_NEWS} AND {q.day('published_at')} = DATE '2025-01-15'")
def articles_of_day(spark, root) -> DataFrame:
    return search.article_filter(table(spark, root, "articles"), from_date="2025-01-15").select("id")


_SPACED = "' ' || trim(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
_T, _B = _SPACED.format("title"), _SPACED.format("content_text")


@query(f"""
SELECT id FROM articles WHERE contains({_T}, ' 점검 결과 ') OR contains({_B}, ' 점검 결과 ') OR contains({_T}, ' 점검결과 ') OR contains({_B}, ' 점검결과 ')
  OR ((contains({_T}, ' 점검 ') OR contains({_B}, ' 점검 ')) AND (contains({_T}, ' 결과 ') OR contains({_B}, ' 결과 '))) OR contains(lower(replace(coalesce(title, ''), ' ', '')), '점검결과')
""")
def search_words(spark, root) -> DataFrame:
    return search.text_match(table(spark, root, "articles"), "점검, 결과").select("id")


@query(f"""
SELECT id FROM articles WHERE contains({_T}, ' 점검 결과 ') OR contains({_B}, ' 점검 결과 ') OR contains({_T}, ' 점검결과 ') OR contains({_B}, ' 점검결과 ')
  OR ((contains({_T}, ' 점검 ') OR contains({_B}, ' 점검 ')) AND (contains({_T}, ' 결과 ') OR contains({_B}, ' 결과 '))) OR contains(lower(replace(coalesce(title, ''), ' ', '')), '점검결과')
""")
def search_words_indexed(spark, root) -> DataFrame:
    """The same search by the positional postings, which are written once and could serve many."""
    a = table(spark, root, "articles")
    return search.indexed_match(a, materialize(search.postings(a), "postings"), "점검, 결과").select("id")


@query(f"SELECT id FROM articles WHERE contains({_T}, ' 자금세탁') OR contains({_B}, ' 자금세탁') OR contains(lower(replace(coalesce(title, ''), ' ', '')), '자금세탁')")
def search_prefix(spark, root) -> DataFrame:
    return search.text_match(table(spark, root, "articles"), "자금세탁").select("id")


@query(f"SELECT title, max(published_at) AS published_at FROM articles WHERE title IS NOT NULL AND contains({_T}, ' 광고') AND contains({_T}, ' 기준') GROUP BY title ORDER BY published_at DESC NULLS LAST, title LIMIT 8")
def suggest_titles(spark, root) -> DataFrame:
    return search.suggestions(table(spark, root, "articles"), "광고 기준")


@query("SELECT field, term, count(*) AS n, count(DISTINCT id) AS docs FROM (SELECT id, 'title' AS field, unnest(regexp_extract_all(lower(coalesce(title, '')), '[\\p{L}\\p{N}]+')) AS term FROM articles) GROUP BY 1, 2")
def title_postings(spark, root) -> DataFrame:
    p = search.postings(table(spark, root, "articles"), fields=("title",))
    return p.groupBy("field", "term").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("SELECT DISTINCT organization FROM articles WHERE organization IS NOT NULL AND trim(organization) <> ''")
def organization_filter(spark, root) -> DataFrame:
    return table(spark, root, "articles").where("organization is not null and trim(organization) <> ''").select("organization").distinct()


@query(f"SELECT count(*) AS total, count(DISTINCT organization) AS organizations FROM articles WHERE {q.NOT_NEWS}")
def stats_total(spark, root) -> DataFrame:
    return search.article_filter(table(spark, root, "articles")).agg(F.count("*").alias("total"), F.countDistinct("organization").alias("organizations"))


@query(f"SELECT coalesce(organization, '(미상)') AS organization, count(*) AS cnt FROM articles WHERE {q.NOT_NEWS} GROUP BY 1 ORDER BY cnt DESC, organization LIMIT 8")
def stats_top_organizations(spark, root) -> DataFrame:
    return search.count_by_organization(search.article_filter(table(spark, root, "articles")), top=8)


@query(f"SELECT {q.type_key()} AS type_key, {q.type_label()} AS type_label, {q.type_order()} AS sort_order, count(*) AS cnt FROM articles WHERE {q.NOT_NEWS} GROUP BY 1, 2, 3")
def stats_types(spark, root) -> DataFrame:
    return search.count_by_type(search.article_filter(table(spark, root, "articles")))


@query("SELECT source_system, source_channel, count(*) AS cnt FROM articles GROUP BY 1, 2")
def source_counts(spark, root) -> DataFrame:
    return table(spark, root, "articles").groupBy("source_system", "source_channel").agg(F.count("*").alias("cnt"))


@query("SELECT id, source_channel, title, published_at FROM articles ORDER BY coalesce(published_at, '') DESC, id DESC LIMIT 20")
def latest_articles(spark, root) -> DataFrame:
    return table(spark, root, "articles").orderBy(F.desc(F.coalesce("published_at", F.lit(""))), F.desc("id")).select("id", "source_channel", "title", "published_at").limit(20)


@query(f"""
WITH p AS (SELECT coalesce(organization, '(미상)') AS organization, {q.type_label()} AS label, count(*) AS n FROM articles WHERE {q.NOT_NEWS} GROUP BY 1, 2)
SELECT organization, CAST(sum(n) AS BIGINT) AS total, list(label || ':' || n ORDER BY n DESC, label) AS types FROM p GROUP BY 1
""")
def digest(spark, root) -> DataFrame:
    return search.digest(search.article_filter(table(spark, root, "articles")))


@query(f"""
SELECT id, coalesce(title, '(제목 없음)') AS title, coalesce(detail_url, original_url, '') AS url, {q.type_label()} AS label FROM articles
WHERE {q.NOT_NEWS} AND {q.day("published_at")} >= DATE '2026-01-01'
""")
def notifications_since(spark, root) -> DataFrame:
    a = search.article_filter(table(spark, root, "articles"), from_date="2026-01-01", since=True)
    label = dims.press_label(dims.press_type(F.col("source_channel")))
    return a.select("id", F.coalesce("title", F.lit("(제목 없음)")).alias("title"), F.coalesce("detail_url", "original_url", F.lit("")).alias("url"), label.alias("label"))


@query("""
SELECT id, json_extract_string(raw_json, '$.no') AS item_no, TRY_CAST(json_extract_string(raw_json, '$.views') AS BIGINT) AS views, json_extract_string(raw_json, '$.charset') AS charset FROM articles
""")
def article_raw_fields(spark, root) -> DataFrame:
    get = lambda p: F.get_json_object("raw_json", p)
    return table(spark, root, "articles").select("id", get("$.no").alias("item_no"), get("$.views").try_cast("bigint").alias("views"), get("$.charset").alias("charset"))


@query("SELECT article_id, count(*) AS n, string_agg(coalesce(file_name, ''), '|' ORDER BY id) AS names FROM attachments WHERE article_id IS NOT NULL GROUP BY 1")
def attachments_of_articles(spark, root) -> DataFrame:
    packed = table(spark, root, "attachments").where("article_id is not null").groupBy("article_id").agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("file_name", F.lit("")).alias("name")))).alias("f"))
    return packed.select("article_id", F.size("f").cast("bigint").alias("n"), F.array_join(F.transform("f", lambda s: s["name"]), "|").alias("names"))


@query(f"SELECT document_id, count(*) AS n, min({q.format_rank('file_ext')}) AS best_format FROM attachments WHERE document_id IS NOT NULL GROUP BY 1")
def document_formats(spark, root) -> DataFrame:
    return table(spark, root, "attachments").where("document_id is not null").groupBy("document_id").agg(F.count("*").alias("n"), F.min(dims.format_rank(F.col("file_ext"))).alias("best_format"))


@query("""
SELECT d.id, count(*) AS articles, count(DISTINCT a.source_channel) AS channels, min(a.first_seen_at) AS first_seen
FROM attachment_documents d JOIN attachments t ON t.document_id = d.id JOIN articles a ON a.id = t.article_id GROUP BY 1
""")
def document_usage(spark, root) -> DataFrame:
    t = table(spark, root, "attachments").select("article_id", "document_id")
    a = table(spark, root, "articles").select(F.col("id").alias("article_id"), "source_channel", "first_seen_at")
    d = table(spark, root, "attachment_documents").select("id")
    per = t.join(a, "article_id").groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("articles"), F.countDistinct("source_channel").alias("channels"), F.min("first_seen_at").alias("first_seen"))
    return per.join(d, "id")


@query("SELECT DISTINCT file_url FROM attachments WHERE file_url IS NOT NULL")
def attachment_urls(spark, root) -> DataFrame:
    return table(spark, root, "attachments").where("file_url is not null").select("file_url").distinct()


@query("SELECT sha256, count(*) AS n, count(DISTINCT canonical_url) AS urls, min(id) AS first_id FROM attachment_documents WHERE sha256 IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def same_documents(spark, root) -> DataFrame:
    d = table(spark, root, "attachment_documents").where("sha256 is not null")
    return d.groupBy("sha256").agg(F.count("*").alias("n"), F.countDistinct("canonical_url").alias("urls"), F.min("id").alias("first_id")).where("n > 1")


@query(f"""
SELECT o.id FROM report_outputs o WHERE EXISTS (SELECT 1 FROM report_output_sources s JOIN articles a ON a.id = s.article_id WHERE s.report_output_id = o.id AND a.source_channel IN {_PRESS})
""")
def outputs_on_press_releases(spark, root) -> DataFrame:
    return search.outputs_about(table(spark, root, "report_outputs"), table(spark, root, "report_output_sources"), table(spark, root, "articles"), "press_release").select("id")


@query("SELECT job_id, id, title FROM report_outputs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY coalesce(llm_completed_at, created_at) DESC NULLS LAST, id DESC) = 1")
def latest_outputs(spark, root) -> DataFrame:
    o = table(spark, root, "report_outputs").select("job_id", "id", "title", "llm_completed_at", "created_at")
    return search.latest_by(o, ["job_id"], [F.coalesce("llm_completed_at", "created_at").desc_nulls_last(), F.desc("id")]).select("job_id", "id", "title")


@query("""
WITH s AS (SELECT s.article_id, o.id, o.title, coalesce(o.llm_completed_at, o.created_at) AS done FROM report_output_sources s JOIN report_outputs o ON o.id = s.report_output_id WHERE s.article_id IS NOT NULL),
l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY done DESC NULLS LAST, id DESC) = 1)
SELECT l.article_id, l.id AS output_id, l.title, n.n AS sources FROM l JOIN (SELECT report_output_id, count(*) AS n FROM report_output_sources GROUP BY 1) n ON n.report_output_id = l.id
""")
def article_reports(spark, root) -> DataFrame:
    s = table(spark, root, "report_output_sources").select("report_output_id", "article_id")
    o = table(spark, root, "report_outputs").select(F.col("id").alias("report_output_id"), "title", F.coalesce("llm_completed_at", "created_at").alias("at"))
    last = search.latest_by(s.where("article_id is not null").join(o, "report_output_id"), ["article_id"], [F.col("at").desc_nulls_last(), F.desc("report_output_id")])
    return last.join(s.groupBy("report_output_id").agg(F.count("*").alias("sources")), "report_output_id").select("article_id", F.col("report_output_id").alias("output_id"), "title", "sources")


_EVIDENCE_TITLE = f"CASE WHEN t.id IS NULL THEN '' ELSE coalesce(nullif({q.attachment_title('t.file_name', 'NULL')}, ''), 'att_' || t.id) END"
_EVIDENCE = f"""
WITH r AS (
  SELECT a.id AS article_id, a.published_at, a.content_text, t.id AS attachment_id, t.file_ext, t.document_id, {_EVIDENCE_TITLE} AS title_key, e.id AS extraction_id, e.text_content
  FROM articles a LEFT JOIN attachments t ON t.article_id = a.id LEFT JOIN attachment_documents d ON d.id = t.document_id
  LEFT JOIN attachment_extractions e ON e.document_id = d.id AND lower(trim(e.status)) = 'completed'),
c AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY article_id, title_key ORDER BY {q.format_rank("file_ext")}, attachment_id NULLS LAST, extraction_id NULLS LAST) = 1)
"""


@query(_EVIDENCE + "SELECT article_id, title_key, attachment_id, document_id, extraction_id, length(text_content) AS chars FROM c")
def evidence_choice(spark, root) -> DataFrame:
    return _evidence(spark, root).select("article_id", "title_key", "attachment_id", "document_id", "extraction_id", F.length("extraction_text").cast("bigint").alias("chars"))


@query(_EVIDENCE + f"SELECT row_number() OVER (ORDER BY {q.day('published_at')} DESC NULLS LAST, article_id DESC, attachment_id NULLS FIRST) AS source_index, article_id, attachment_id FROM c")
def evidence_index(spark, root) -> DataFrame:
    return evidence.numbered(_evidence(spark, root).select("article_id", "attachment_id", "published_at")).select("source_index", "article_id", "attachment_id")


@query()
def evidence_texts(spark, root) -> DataFrame:
    """The JSON lines of the evidence with body and attachment text, each cut to 3000 characters (the feature)."""
    rows = _evidence(spark, root).withColumn("text", evidence.merged_text(F.col("content_text"), F.col("extraction_text"), 3000))
    return evidence.payload(rows, ["article_id", "attachment_id", "title", "published_at", "text"])


def _evidence(spark, root) -> DataFrame:
    names = ("articles", "attachments", "attachment_documents", "attachment_extractions")
    return evidence.chosen_evidence(*[table(spark, root, n) for n in names], ok="completed")


_NAMES = ("notice_start", "notice_end", "final_extension_date", "validity_period", "enforcement_status", "processing_status", "public_yn", "registrant", "reply_date", "query_summary", "reply_text", "reason_text", "case_number")


@query("SELECT id, " + ", ".join(f"json_extract_string(CASE WHEN json_valid(raw_json) THEN raw_json END, '$.{n}') AS {n}" for n in _NAMES) + " FROM articles")
def article_detail_fields(spark, root) -> DataFrame:
    return search.detail_fields(table(spark, root, "articles").select("id", "raw_json")).drop("raw_json")


_TITLE_LINE, _DEPARTMENT_LINE = (q.ws(f"coalesce({c}, '')") for c in ("title", "department"))
_KEPT = "source_channel LIKE 'fss_press%' OR source_channel LIKE 'fsc_r%' OR source_channel LIKE 'krx_recent%'"


@query(f"""
SELECT source_channel, CAST(id AS VARCHAR) AS source_item_id, {_TITLE_LINE} AS title, nullif({_DEPARTMENT_LINE}, '') AS department
FROM articles WHERE ({_KEPT}) AND {_TITLE_LINE} <> '' AND source_channel IN {q.words(SITES)}
""")
def boards_read_back(spark, root) -> DataFrame:
    """Articles of three kinds of boards written as list pages in their sites' shapes and read back."""
    a = table(spark, root, "articles").where(_KEPT).select(F.col("source_channel").alias("channel"), F.col("id").cast("string").alias("id"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "department")])
    safe = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    table_page = F.concat(F.lit("<table><thead><tr><th>번호</th><th>제목</th><th>담당부서</th></tr></thead><tbody><tr><td>1</td><td><a href='v.do?nttId="), "id", F.lit("'>"), safe("title"), F.lit("</a></td><td>"), safe("department"), F.lit("</td></tr></tbody></table>"))
    item_page = F.concat(F.lit("<div class='board-list-wrap'><ul><li><a href='/po040301/"), "id", F.lit("'><b class='subject'>"), safe("title"), F.lit("</b></a><p class='info'><span>담당부서 :"), safe("department"), F.lit("</span></p></li></ul></div>"))
    json_page = F.to_json(F.struct(F.array(F.struct(F.col("id").alias("BOOKID"), F.col("title").alias("TITLE"), F.col("department").alias("DEPTNAME"))).alias("result")))
    body = F.when(F.col("channel").startswith("fss"), table_page).when(F.col("channel").startswith("fsc"), item_page).otherwise(json_page)
    pages = a.select("channel", F.lit("list").alias("role"), F.lit(None).cast("string").alias("key"), F.lit("https://s.example/").alias("url"), body.alias("body"))
    return board_records(pages).select("source_channel", "source_item_id", "title", text.collapse(F.col("department")).alias("department"))
