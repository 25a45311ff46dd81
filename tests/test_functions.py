import pytest
from pyspark.sql import functions as F

from lawloom.functions import dims, legal, text


def value(spark, column, **cells):
    schema = ", ".join(f"{k} string" for k in cells)
    return spark.createDataFrame([tuple(cells.values())], schema).select(column.alias("v")).first().v


CASES = [
    (text.feed_datetime, "03/04/2026 09:05:00", "2026-03-04 09:05:00"), (text.feed_datetime, "2026.03.04.", "2026-03-04"), (text.feed_datetime, "", None), (text.feed_datetime, "20260304", "2026-03-04"),
    (text.feed_datetime, "202603041205", "2026-03-04 12:05:00"), (text.feed_datetime, "2026-3-4", "2026-03-04"), (text.notice_date, "2026년 3월 4일", "2026-03-04"), (text.padded_day, "2026/3/4", "2026-03-04"),
    (text.amendment_type, "감독규정 일부개정 예고", "일부개정"), (text.amendment_type, "안내", None), (text.effective_day, "시행일: 2026.4.1", "2026-04-01"), (text.effective_day, "2026-4-1 시행", "2026-04-01"),
    (text.published_day, "2026.03.04 12:34", "2026-03-04"), (text.extension, "A.B.HWPX", "hwpx"), (text.extension, "noext", None), (text.name_in_url, "https://a.example/x/y.pdf?z=1", "y.pdf"),
    (text.name_in_url, "https://a.example/", "unknown_file"), (text.collapse, " a  　b\n", "a b"), (text.without_spaces, None, ""), (text.content_hash, "", None), (text.token_estimate, "", 1), (text.token_estimate, "x" * 10, 3),
    (text.rule_name, "/a/DRM_여신 규정 원문-원본.hwp", "여신 규정"), (text.rule_name, "여신(수정본).pdf", "여신"), (legal.article_reference, "법 제 12 조의 3", "제12조의3"), (legal.article_reference, "없음", None),
    (text.mask_secrets, "?KEY=abc&x Authorization: bearer tok.en X-Goog-Api-Key=q1, z", "?KEY=***&x Authorization: bearer *** X-Goog-Api-Key=***, z"), (text.clean_lines, "a\r\n\n\n\nb\t c ", "a\n\nb c"), (text.retrieval_tokens, "K-ICS/x 2024 a_b. 가", ["k-ics/x", "a_b"]),
    (text.keyword_tokens, "금융위원회에서는 AML을 보고", ["금융위원회", "AML", "보고"]), (text.title_tokens, "보도자료 AAA aaa 관련", ["aaa"]), (text.retrieval_tokens, None, []),
    (lambda c: text.period_label(c, "week"), "2024-01-03", "2024-01-01"), (lambda c: text.period_label(c, "week"), "bad", "bad"), (lambda c: text.period_label(c, "month"), None, "미상"),
    (lambda c: text.shorten(c, 5), "abcdefgh", "abcd…"), (lambda c: text.file_kind(c, F.lit("https://x.example/a"), F.lit("application/pdf")), "noext", "pdf"), (legal.law_mentions, "「여신법」 여신법 제3조", ["여신법"]),
    (lambda c: text.url_parameter(c, "nttId"), "https://a.example/v?nttId=12&x=1", "12"), (lambda c: dims.format_rank(c).cast("int"), ".PDF", 1), (lambda c: dims.format_rank(c).cast("int"), None, 99),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_scalar(spark, i):
    f, given, want = CASES[i]
    assert value(spark, f(F.col("c")), c=given) == want


def test_stable_id_and_titles(spark):
    assert value(spark, text.stable_id(F.col("c")), c="a#0").count("-") == 4
    assert value(spark, text.attachment_title(F.col("n"), F.col("u")), n="  보도 자료.PDF", u=None) == "보도 자료"
    assert value(spark, text.attachment_title(F.col("n"), F.col("u")), n=None, u="https://a.example/f/Notice.HWP") == "notice"


def test_range(spark):
    r = value(spark, text.date_range(F.col("c")), c="2026.3.1 ~ 2026.3.20")
    assert (r.start_day, r.end_day) == ("2026-03-01", "2026-03-20")
    assert value(spark, text.date_range(F.col("c")), c="2026.3.1").end_day is None


def test_types(spark):
    rows = spark.createDataFrame([("fsc_no_action_opinion",), ("other",), (None,)], "c string").select(dims.press_type(F.col("c")).alias("k")).collect()
    assert [r.k for r in rows] == ["no_action_opinion", "press_release", "press_release"]


def test_legal_lists(spark):
    admin = "1. 여신 규정\n - 행정규칙일련번호: 12\n - 행정규칙ID: A1\n - 발령일: 2024.1.1\n - 구분: 고시\n - 소관부처: 금융위\n2. 다른 규정\n - 행정규칙ID: A2\n"
    got = value(spark, legal.entries(F.col("c"), "admin_rule"), c=admin)
    assert [(m["name"], m["id"], m["dept"]) for m in got] == [("여신 규정", "A1", "금융위"), ("다른 규정", "A2", "")]
    assert value(spark, legal.entries(F.col("c"), "ordinance"), c="[77] 서울 조례\n 지자체: 서울\n 시행일: 2024.2.1")[0] == {"name": "서울 조례", "tag": "77", "org": "서울", "date": "", "eff_date": "2024.2.1"}
    assert value(spark, legal.entries(F.col("c"), "law"), c="1. 은행법\n- 법령ID: 5\n- MST: 9")[0]["mst"] == "9"
    assert value(spark, legal.entries(F.col("c"), "decision"), c="1. 판결\n- 사건번호: 2020가1\n- 선고일: 2021")[0]["case_num"] == "2020가1"
    assert value(spark, legal.entries(F.col("c"), "law"), c=None) == [] and value(spark, legal.legal_terms(F.col("c")), c="📌 예금  자 \n x") == ["예금 자"]
    f = value(spark, legal.found_articles(F.col("c")), c="📜 은행법\n제3조\n📅 2024\n내용")
    assert (f[0].law_name, f[0].article, f[0].date) == ("은행법", "제3조", "2024")


def test_legal_texts(spark):
    law = "법령명: 은행법\n제3조 (목적)\n머리말\n① 첫째는\n이어진다.\n1. 항목\n가. 목\n"
    assert [(b.kind, b.marker, b.text) for b in value(spark, legal.article_blocks(F.col("c")), c=law)] == [("lead", "", "머리말"), ("paragraph", "①", "첫째는 이어진다."), ("item", "1.", "항목"), ("subitem", "가.", "목")]
    toc = "목차\n제1조 목적\n제2조의2\n부칙\n제9조 밖"
    assert [(a.article, a.title) for a in value(spark, legal.contents(F.col("c")), c=toc)] == [("제1조", "목적"), ("제2조의2", "제2조의2")]
    assert value(spark, legal.supplementary_provisions(F.col("c")), c="a\n 부칙 <1>\n 시행") == "부칙 <1>\n시행" and value(spark, legal.supplementary_provisions(F.col("c")), c="a") is None
    assert value(spark, legal.without_lines(F.col("c"), "💡"), c="a\n💡 b\nc") == "a\nc" and value(spark, legal.without_article(F.col("c")), c="은행법  제3조") == "은행법"
    assert value(spark, legal.tool_text(F.col("c")), c='{"content":[{"type":"text","text":"a"},{"type":"image"},{"type":"text","text":"b"}]}') == "a\nb"


def test_news_by_parts_of_names(spark):
    rows = [(" Overseas_News_API", None, None), ("yonhap_news", "x", None), (None, "News_Feed", None), ("x", None, " Arirang TV"), ("fss_press_release", "fss_scrape", "금융위"), (None, None, None)]
    a = spark.createDataFrame(rows, "c string, s string, o string")
    assert [r.n for r in a.select(text.is_news(F.col("c"), F.col("s"), F.col("o")).alias("n")).collect()] == [True] * 4 + [False] * 2
