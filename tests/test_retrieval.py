import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lawloom.operators import evidence, keywords, merge, related, retrieval, search

DOCS = [(1, ["a", "b", "a"]), (2, ["b", "c"]), (3, []), (4, ["a"]), (5, ["a"])]


def test_bm25_against_formula(spark):
    docs = spark.createDataFrame(DOCS, "id bigint, tokens array<string>")
    asked = spark.createDataFrame([(10, ["a", "c", "a"]), (11, ["zzz"]), (12, [])], "query_id bigint, tokens array<string>")
    got = {(r.query_id, r.doc_id): (r.score, r.rank) for r in retrieval.Bm25Index(docs, "id", F.col("tokens")).search(asked, 10).collect()}
    n, avg = len(DOCS), sum(len(t) for _, t in DOCS) / len(DOCS)
    df = Counter(w for _, t in DOCS for w in set(t))
    want = {}
    for i, toks in DOCS:
        s = 0.0
        for w in ["a", "c", "a"]:
            tf = toks.count(w)
            if tf:
                s += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * max(1, len(toks)) / avg))
        if s > 0:
            want[10, i] = s
    assert set(got) == set(want)
    assert all(abs(got[k][0] - v) < 1e-9 for k, v in want.items())
    assert got[10, 4][1] + 1 == got[10, 5][1]  # a tie goes to the lower id


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n가", max_size=900), st.integers(0, 400))
def test_chunks_cover(text, overlap):
    at = 0
    for a, b in retrieval.chunk_bounds(text, 300, overlap):
        assert a <= at < b <= len(text) and b - a <= 300
        at = b
    assert at == len(text)


def test_chunk_rows(spark):
    docs = spark.createDataFrame([(1, "t", "x " * 500), (2, None, None), (3, "t", "")], "id bigint, title string, body string")
    got = retrieval.chunks(docs, "id", "title", "body", 300, 50).collect()
    assert {r.doc_id for r in got} == {"1"} and got[0].chunk_id == "1#0"


def test_dense_search_is_exact_in_blocks(spark):
    rng = np.random.default_rng(1)
    v = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)]
    vectors = spark.createDataFrame(v, "doc_id bigint, embedding array<float>")
    asked = spark.createDataFrame(v[:7], "query_id bigint, embedding array<float>")
    got = {(r.query_id, r.rank): r.doc_id for r in retrieval.dense_search(asked, vectors, 5, block=3).collect()}
    m = np.array([x for _, x in v], np.float32).astype(float)
    for q in range(7):
        s = m @ m[q]
        want = [i for i in np.argsort(-s) if s[i] > 0][:5]
        assert [got[q, k + 1] for k in range(len(want))] == want
    assert retrieval.dense_search(asked.where("false"), vectors).count() == 0


def test_hash_embeddings_and_fusion(spark):
    docs = spark.createDataFrame(DOCS, "id bigint, tokens array<string>")
    e = retrieval.hash_embeddings(docs, "id", F.col("tokens"), 16)
    norms = {r.doc_id: r.s for r in e.groupBy("doc_id").agg(F.sum(F.col("value") ** 2).alias("s")).collect()}
    assert norms and all(abs(s - 1) < 1e-9 for s in norms.values())
    ranked = lambda rows: spark.createDataFrame(rows, "query_id bigint, doc_id bigint, rank int")
    fused = retrieval.reciprocal_rank_fusion({"bm25": ranked([(1, 7, 1), (1, 8, 2)]), "dense": ranked([(1, 9, 1), (1, 8, 2)])}).orderBy("rank").collect()
    assert [r.doc_id for r in fused] == [8, 7, 9] and abs(fused[0].score - 2 / 62) < 1e-12 and fused[0].component_ranks == {"bm25": 2, "dense": 2}


def test_tfidf_cooccurrence_trend(spark):
    words = spark.createDataFrame([(1, "p", "x"), (1, "p", "x"), (2, "q", "x"), (2, "q", "y")], "doc_id bigint, period string, word string")
    assert {r.word: r.score for r in keywords.tfidf(words, 3).collect()} == {"x": 4, "y": 2}
    nodes, edges = keywords.cooccurrence(words, 5, 1)
    assert [(r.source, r.target, r.weight) for r in edges.collect()] == [("x", "y", 1)] and nodes.count() == 2
    grid = {(r.period, r.word): r.cnt for r in keywords.trend(words, "period", 2).collect()}
    assert grid == {("p", "x"): 2, ("p", "y"): 0, ("q", "x"): 1, ("q", "y"): 1}


def test_dictionaries(spark):
    a = spark.createDataFrame([(1, "AA bb CC")], "id bigint, title string")
    stop, syn = spark.createDataFrame([("CC",)], "word string"), spark.createDataFrame([("ZZ", "AA"), ("CC", "bb")], "canonical string, synonym string")
    assert [r.word for r in keywords.words_of(a, F.split("title", " "), stop, syn).collect()] == ["ZZ"]  # bb becomes a stop word


def test_merges(spark):
    schema = "k string, v int, first_seen_at string, last_seen_at string, seq int"
    old = spark.createDataFrame([("a", 1, "1", "1", 1), ("b", 1, "1", "1", 1)], schema)
    new = spark.createDataFrame([("a", 2, "3", "3", 1), ("a", 3, "4", "4", 2), ("c", 9, "5", "5", 1), (None, 7, "6", "6", 1)], schema)
    got = {r.k: (r.v, r.first_seen_at, r.last_seen_at) for r in merge.upsert(old, new, ["k"], ["seq"]).collect()}
    assert got == {"a": (3, "1", "4"), "b": (1, "1", "1"), "c": (9, "5", "5"), None: (7, "6", "6")}
    pairs = lambda rows: spark.createDataFrame(rows, "a int, b int")
    merged = merge.insert_or_ignore(pairs([(1, 1), (None, 1)]), pairs([(1, 1), (2, 2), (2, 2), (None, 1)]), ["a", "b"]).collect()
    assert sorted(map(str, merged)) == sorted(map(str, [pairs([(1, 1)]).first(), *pairs([(None, 1), (None, 1), (2, 2)]).collect()]))
    assert merge.replace_groups(pairs([(1, 1), (2, 2)]), pairs([(1, 5)]), "a").count() == 2
    assert {r.k: r.v for r in merge.insert_or_replace(old, new.where("k is not null"), "k", ["seq"]).collect()} == {"a": 3, "b": 1, "c": 9}


def test_best_attachment_and_links(spark):
    t = spark.createDataFrame([(1, 7, "a.hwp", "u1", "hwp", None), (2, 7, "a.pdf", "u2", "pdf", None), (3, 7, "b.pdf", "u1", None, 5)], "id bigint, article_id bigint, file_name string, file_url string, file_ext string, document_id bigint")
    assert {r.title_key: r.id for r in merge.best_attachments(t).collect()} == {"a": 2, "b": 3}
    docs = spark.createDataFrame([(50, "u1")], "id bigint, canonical_url string")
    new, linked = merge.link_documents(t, docs)
    got = {r.id: r.document_id for r in linked.collect()}
    assert got[1] == 50 and got[3] == 5 and new.count() == 1 and got[2] == new.first().id


def test_numbering(spark):
    rows = spark.createDataFrame([(i, None, f"2024-01-{1 + i % 28:02d}") for i in range(200)], "article_id bigint, attachment_id bigint, published_at string")
    got = [r.article_id for r in evidence.numbered(rows).orderBy("source_index").collect()]
    want = sorted(range(200), key=lambda i: (-(i % 28), -i))
    assert got == want and [r.source_index for r in evidence.numbered(rows).orderBy("source_index").limit(3).collect()] == [1, 2, 3]


def test_text_match(spark):
    a = spark.createDataFrame([(1, "점검 결과", None), (2, None, "결과를 점검, 결과"), (3, "점 검결과", ""), (4, "결과", "x")], "id bigint, title string, content_text string")
    assert sorted(r.id for r in search.text_match(a, "점검 결과").collect()) == [1, 2, 3]
    assert sorted(r.id for r in search.text_match(a, "결").collect()) == [1, 2, 3, 4] and search.text_match(a, " ?! ").count() == 4


def test_related(spark):
    rows = [
        (1, "가온은행 abc 점검", "내용 문장 하나", "금융위", "2024-03-01", "fss_press_release", "fss_scrape"), (2, "가온은행 abc 소식", "내용 문장 둘", "금융위", "2024-03-02", "overseas_news_api", "overseas_news_api"),
        (3, None, None, None, None, "overseas_news_api", None), (4, "무관", "다른 글", None, "x", "overseas_news_api", None),
    ]
    a = spark.createDataFrame(rows, "id bigint, title string, content_text string, organization string, published_at string, source_channel string, source_system string")
    got = related.related_news(a, a.where("id = 1")).collect()
    assert [r.doc_id for r in got] == [2] and "제목 키워드 일치" in got[0].reasons
    s = a.select(related.title_similarity(F.col("title"), F.lit("가온은행 abc 점검")).alias("s")).collect()
    assert s[0].s == 1.0 and s[2].s == 0.0


def test_related_by_attachments(spark):
    rows = [
        (1, "회의 결과", "짧은 글", None, None, "fss_press_release"), (2, "소식 하나", "orvane 은행 대출 한도 확대", None, None, "overseas_news_api"),
        (3, "다른 소식", "날씨 맑음", None, None, "overseas_news_api"), (4, "노바홀딩스 인가 심사", "심사 내용", None, None, "fss_press_release"),
        (5, "인가 심사 동향", "심사 내용 일반", None, None, "overseas_news_api"), (6, "인가 심사 소식", "노바홀딩스 심사 내용", None, None, "overseas_news_api"),
    ]
    a = spark.createDataFrame([(*r, None) for r in rows], "id bigint, title string, content_text string, organization string, published_at string, source_channel string, source_system string")
    attachments = spark.createDataFrame([(10, 1, 7), (11, 1, 8), (12, 1, None)], "id bigint, article_id bigint, document_id bigint")
    texts = [(1, 7, "completed", " "), (2, 7, " Completed", "대출 한도 Orvane"), (3, 8, "failed", "날씨 맑음"), (4, 8, "completed", None)]
    e = spark.createDataFrame(texts, "id bigint, document_id bigint, status string, text_content string")
    terms = {r.term: r.weight for r in keywords.weighted_terms(a.where("id = 1"), attached=related.attachment_tokens(a, attachments, e)).collect()}
    assert terms == {"회의": 4, "결과": 4, "대출": 3, "한도": 3, "orvane": 3, "짧은": 1}
    got = {(r.query_id, r.doc_id): r for r in related.related_news(a, a.where("id in (1, 4)"), attachments=attachments, extractions=e).collect()}
    assert set(got) == {(1, 2), (4, 6)}  # 5 shares title tokens with 4, but not the company
    assert got[1, 2].rule_score == 0.3 and got[1, 2].reasons == ["첨부 핵심어 일치"]


def test_chunk_vectors_to_add(spark, root):
    import hashlib
    import uuid

    import __spark_entry__ as e

    want = {}
    for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "lang", "text").collect():
        flat = " ".join((r.text or "").split())
        if r.lang != "ko" and flat:
            for i, _ in enumerate(retrieval.chunk_bounds(flat, 1200, 160)):
                want[str(uuid.UUID(hashlib.md5(f"{r.doc_id}#{i}".encode()).hexdigest()))] = (str(r.doc_id), i)
    got = {r.point_id: (r.doc_id, r.chunk_no) for r in e.queries()["chunk_vectors_to_add"](spark, root).collect()}
    assert got == want and any(no for _, no in got.values())


def test_many_queries_meet_documents_by_a_join(spark, monkeypatch):
    docs = [(i, [f"w{(i * k) % 17}" for k in range(1, 8)], "a" if i % 3 else None) for i in range(60)]
    df = spark.createDataFrame(docs, "id bigint, words array<string>, org string")
    asked = df.where("id < 12").selectExpr("id as query_id", "words as tokens", "org")
    for alike in ((), ("org",)):
        index = retrieval.Bm25Index(df, "id", F.col("words"), alike=alike)
        sent = {(r.query_id, r.doc_id, round(r.score, 9), r["rank"]) for r in index.search(asked, 7, skip_self=True).collect()}
        with monkeypatch.context() as m:
            m.setattr(retrieval, "_MOST_PAIRS", 3)
            assert {(r.query_id, r.doc_id, round(r.score, 9), r["rank"]) for r in index.search(asked, 7, skip_self=True).collect()} == sent
        assert sent and not any(q == d for q, d, _, _ in sent)
        if alike:
            assert all(q % 3 and d % 3 for q, d, _, _ in sent)
    assert retrieval.Bm25Index(df.where("false"), "id", F.col("words")).search(asked, 5).count() == 0
    assert retrieval.Bm25Index(df, "id", F.col("words")).search(asked.where("false"), 5).count() == 0


def test_best_rows_of_blocks_with_ties():
    import numpy as np

    rng = np.random.default_rng(4)
    scores = np.round(rng.random((500, 6)), 1)
    scores[rng.random(scores.shape) < 0.3] = -np.inf
    docs = rng.permutation(500)
    best = retrieval._Best(6, 9)
    for at in range(0, 500, 37):
        best.add(scores[at : at + 37], docs[at : at + 37])
    q, s, d = best.settle()
    for k in range(6):
        want = sorted((-x, i) for x, i in zip(scores[:, k], docs) if np.isfinite(x))[:9]
        assert [(-x, i) for x, i in zip(s[q == k], d[q == k])] == want


def test_dense_search_in_blocks_of_queries(spark):
    rows = [(i, [float((i * k) % 7) for k in range(1, 5)]) for i in range(40)] + [(99, None)]
    v = spark.createDataFrame(rows, "doc_id bigint, embedding array<double>")
    asked = v.selectExpr("doc_id as query_id", "embedding").where("query_id < 15")
    whole = {tuple(r) for r in retrieval.dense_search(asked, v, 5).collect()}
    assert {tuple(r) for r in retrieval.dense_search(asked, v, 5, block=4).collect()} == whole and len(whole) > 50
    assert retrieval.dense_search(asked.where("false"), v, 5).count() == 0


def test_counts_of_words_are_the_same_by_either_way(spark, monkeypatch):
    docs = [(i, " ".join(f"w{(i * k) % 7}" for k in range(1, 6)), "p" if i % 2 else None) for i in range(30)] + [(90, "", "p"), (91, None, "p")]
    df = spark.createDataFrame(docs, "id bigint, title string, part string")
    stop, syn = spark.createDataFrame([("w3",)], "word string"), spark.createDataFrame([("w1", "w2"), ("w9", None)], "canonical string, synonym string")
    rows = lambda d: sorted(tuple(r) for r in d.select("word", "tf", "df").collect())
    network = lambda: [sorted(tuple(r) for r in d.collect()) for d in keywords.document_network(df.where("title is not null"), F.split("title", " "), 4, 1, stop, syn)]
    sent, graph = rows(keywords.count_words(df, F.split("title", " "), stop, syn, ("part",))), network()
    words = keywords.words_of(df.where("title is not null"), F.split("title", " "), stop, syn)
    assert graph == [sorted(tuple(r) for r in d.collect()) for d in keywords.cooccurrence(words, 4, 1)]
    monkeypatch.setattr(keywords, "_SMALL_DICTIONARY", 0)
    assert rows(keywords.count_words(df, F.split("title", " "), stop, syn, ("part",))) == sent and not any(w in ("w2", "w3") for w, _, _ in sent)


def test_providers_and_appended_vectors(spark):
    from lawloom.operators import embedding as E

    assert E.RemoteAnswers(lambda t: [{"index": 1, "embedding": [0, 2]}, {"index": 0, "embedding": [3, 4]}]).embed(["a", "b"]) == [[0.6, 0.8], [0.0, 1.0]]
    with pytest.raises(ValueError):
        E.RemoteAnswers(lambda t: []).embed(["a"])
    seen = []
    E.PrefixedModel(lambda: lambda t: seen.extend(t) or [[1.0]] * len(t)).embed(["x"], query=True)
    assert seen == ["query: x"] and E.provider_from({"dimensions": 8})().dimensions == 8
    with pytest.raises(ValueError):
        E.provider_from({"provider": "other"})
    pieces = spark.createDataFrame([("a#0", "one two"), ("a#1", None), ("b#0", "three"), ("b#0", "three")], "chunk_id string, text string")
    empty = spark.createDataFrame([], "point_id string, chunk_id string, embedding array<double>")
    first = E.append_vectors(pieces.where("chunk_id = 'a#0'"), empty, E.provider_from({"dimensions": 8}))
    again = E.append_vectors(pieces, first, E.provider_from({"dimensions": 8}), dimensions=8)
    got = {r.chunk_id: r.embedding for r in again.collect()}
    assert set(got) == {"a#0", "a#1", "b#0"} and again.count() == 3 and got["a#1"] is None and abs(sum(x * x for x in got["b#0"]) - 1) < 1e-9


def test_phrases_in_the_index(spark):
    rows = [(1, "a b c", "x a"), (2, "b a", "a b"), (3, "a x b", None), (4, None, "ab a a b"), (5, "A-B cd", "")]
    articles = spark.createDataFrame(rows, "id bigint, title string, content_text string")
    index = search.postings(articles)
    ids = lambda q: sorted(r.doc_id for r in search.index_match(index, q).collect())
    P, A, O = search.Phrase, search.All, search.AnyOf
    assert ids(P(("a", "b"))) == [1, 2, 4, 5] and ids(P(("a", "a", "b"))) == [4] and ids(P(("b", "c"), True)) == [1, 5] and ids(P(("a",), True)) == [1, 2, 3, 4, 5]
    assert ids(A((P(("x",)), P(("b",))))) == [1, 3] and ids(O((P(("ab",)), A((P(("x",)), P(("c",))))))) == [1, 4]
    for typed in ("a b", "ab", "x", "a", "c d", "  "):
        same = lambda d: sorted(r.id for r in d.select("id").collect())
        assert same(search.indexed_match(articles, index, typed)) == same(search.text_match(articles, typed)), typed


def test_sectioned_text(spark):
    row = spark.createDataFrame([("T", [("f.pdf", " a  b "), (None, "c" * 30), ("g", " "), ("h", "never")], " body ", None)], "t string, a array<struct<file_name:string,text_content:string>>, b string, n string").select(
        related.sectioned_text(F.col("t"), F.col("a"), F.col("b"), 3, 10).alias("x"), related.sectioned_text(F.col("n"), F.lit(None).cast("array<struct<file_name:string,text_content:string>>"), F.col("n")).alias("y")
    ).first()
    assert row.x == "[TITLE]\nT\n\n[ATTACHMENT:f.pdf]\na b\n\n[ATTACHMENT:file]\nccccccccc…\n\n[BODY]\nbody" and row.y == ""


def test_rule_impact(spark):
    rules = spark.createDataFrame([(1, "Bank rule", ["bank", "x", "x"]), (2, "Other", ["y"]), (3, "Bank", ["bank"])], "rule_id bigint, rule_name string, tokens array<string>")
    hits = spark.createDataFrame([(1, 2), (1, 1), (2, 3)], "rule_id bigint, rank int")
    got = [(r.rule_id, r.match_score) for r in related.rule_impact(["bank", "x"], rules, hits).collect()]
    assert got == [(1, round(650 / 61 + 6 + 6, 4)), (2, round(650 / 63, 4))]
    assert related.rule_impact(["bank"], rules, hits, most=1).count() == 1
