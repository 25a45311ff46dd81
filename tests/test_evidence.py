from pyspark.sql import functions as F

from lawloom.operators import evidence, related, retrieval, search


def test_merged_text(spark):
    rows = [("본문", "첨부"), ("본문", None), (None, "첨부"), (None, None), ("a" * 50, "b" * 50)]
    df = spark.createDataFrame(rows, "b string, a string").select(evidence.merged_text(F.col("b"), F.col("a"), 5).alias("t"))
    assert [r.t for r in df.collect()] == ["본문\n\n[첨부문서]\n첨부", "본문", "[첨부문서]\n첨부", "", "aaaaa\n\n[첨부문서]\nbbbbb"]


def test_evidence_keeps_articles_without_files(spark):
    a = spark.createDataFrame([(1, "t", "2024-01-01", "o", "c", "body"), (2, "t", None, None, None, None)], "id bigint, title string, published_at string, organization string, source_channel string, content_text string")
    t = spark.createDataFrame([(10, 1, "a.hwp", "hwp", "u1", 100), (11, 1, "a.pdf", "pdf", "u2", 101)], "id bigint, article_id bigint, file_name string, file_ext string, file_url string, document_id bigint")
    d = spark.createDataFrame([(100, "p"), (101, "q")], "id bigint, storage_path string")
    e = spark.createDataFrame([(7, 101, "failed", "x"), (8, 100, " Success ", "y")], "id bigint, document_id bigint, status string, text_content string")
    got = {r.article_id: r for r in evidence.choose_by_title(evidence.evidence_rows(a, t, d, e)).collect()}
    assert got[1].attachment_id == 11 and got[1].extraction_text is None and got[2].attachment_id is None


def test_prompt_and_skeleton(spark):
    df = spark.createDataFrame([("T", "Do.", [(1, "A", "x"), (2, None, None)])], "t string, i string, s array<struct<source_index:int,title:string,text:string>>")
    assert df.select(evidence.prompt(F.col("t"), F.col("i"), F.col("s")).alias("p")).first().p == "T\n\nDo.\n\n[Sources]\n\n[source_index=1] A\nx\n\n[source_index=2] \n"
    assert df.select(evidence.report_skeleton(F.col("t"), F.lit("a"), F.lit("b")).alias("p")).first().p.startswith("# T\n\n기간: a ~ b\n\n## 1. 요약")


def test_rule_scores(spark):
    rules = spark.createDataFrame([("1", "여신 규정", ["여신", "한도"]), ("2", "인사 규정", ["휴가"])], "rule_id string, rule_name string, terms array<string>")
    hits = spark.createDataFrame([("1", 0.03, 1), ("1", 0.01, 2), ("2", 0.02, 3)], "rule_id string, score double, rank int")
    got = related.rule_scores(["여신", "한도", "없음"], rules, hits).collect()
    assert [(r.rule_id, r.match_score, r.match_terms) for r in got] == [("1", 31.5, ["여신", "한도"]), ("2", 13.0, [])]


def test_vectors_of_another_dimension(spark):
    import pytest

    chunks = spark.createDataFrame([("1#0",)], "chunk_id string")
    stored = spark.createDataFrame([("x", [1.0, 2.0])], "point_id string, embedding array<double>")
    assert retrieval.missing_vectors(chunks, stored, 2).count() == 1
    with pytest.raises(ValueError):
        retrieval.missing_vectors(chunks, stored, 3)


def test_filters_and_pages(spark):
    rows = [(1, "fss_press_release", "fss_scrape", "o", "2024-01-02"), (2, "overseas_news_api", "x", "o", "2024-01-02"), (3, None, None, "o", "2024-01-02"), (4, "fss_press_release", "fss_scrape", None, "20240102"), (5, "bok_press_release", "bok", "o", None)]
    a = spark.createDataFrame(rows, "id bigint, source_channel string, source_system string, organization string, published_at string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(search.article_filter(a)) == [1, 4, 5] and ids(search.article_filter(a, from_date="2024-01-02")) == [1] and ids(search.article_filter(a, from_date="2024-01-01")) == []
    assert ids(search.article_filter(a, from_date="2024-01-01", since=True)) == [1] and ids(search.article_filter(a, "unknown", "o")) == [1, 5]
    assert [r.id for r in search.page(a, 1, 2).collect()] == [4, 3] and [r.id for r in search.page(a, 3, 2).collect()] == [5]
    assert [r.organization for r in search.count_by_organization(a).collect()] == ["o", "(미상)"] or search.count_by_organization(a).count() == 2


def test_enriched_text(spark):
    df = spark.createDataFrame([("x" * 10, "yyyyyyyy"), ("x" * 10, "y"), ("", None)], "s string, p string")
    assert [r.t for r in df.select(evidence.enriched_text(F.col("s"), F.col("p"), 24).alias("t")).collect()] == ["x" * 10 + "\n\n[첨부문서]\nyyyyy", "x" * 10, ""]
    assert df.select(evidence.enriched_text(F.col("s"), F.col("p"), 99, None).alias("t")).collect()[1].t.endswith("y")


def test_index_maintenance(spark):
    schema = "id bigint, title string, content_text string"
    before = spark.createDataFrame([(1, "가 나", None), (2, "다", "라"), (3, "마", "")], schema)
    index = search.refresh_postings(search.postings(before), spark.createDataFrame([(2, "바", "사 아"), (4, "자", None)], schema), spark.createDataFrame([(3,)], "id bigint"))
    after = spark.createDataFrame([(1, "가 나", None), (2, "바", "사 아"), (4, "자", None)], schema)
    assert sorted(index.collect()) == sorted(search.postings(after).collect())
