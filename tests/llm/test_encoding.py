import random

import pytest

from lawloom.llm import encoding_repair as E

KO = ["금융위원회는 감독규정 제{}조를 개정하였다고 밝혔다.", "보험회사는 {}일까지 개선계획을 제출해야 한다.", "공매도 잔고보고 관련 민원은 전년보다 {}% 늘어난 것으로 집계되었다.", "은행은 {}월부터 고객확인 의무 현황을 매월 보고한다.", "토론회에 참석한 담당자 {}명은 비용을 우려했다."]
OTHER = ["Die Beschwerden über Auslagerungen stiegen auf {} Fälle; Übergangsfristen gelten für größere Häuser.", "监管机构于{}日公布了关于资本充足要求的修订草案。", "当局は{}日、内部統制の基準に関する改正案を公表した。", "The review covered {} files and found “errors” in remote onboarding.", "la comisión aprobó la revisión del régimen según el artículo {}."]


@pytest.fixture(scope="module")
def model():
    return E.ChainModel.train([t.format(i) for i in range(60) for t in KO + OTHER])


def test_round_trips():
    for chain in E.CHAINS:
        text = "감독규정 개정" if chain != "cp949>utf8" else "abc"
        try:
            shown = E.garble(text, chain)
        except UnicodeError:
            continue
        if "�" not in shown:
            assert E.invert(shown, chain) == text


def test_held_out_accuracy(model):
    rng = random.Random(3)
    right = restored = n = lossless = 0
    for i in range(120):
        text = rng.choice(KO).format(1000 + i)
        chain = rng.choice([c for c in E.CHAINS if c.startswith(("utf8", "cp949"))])
        shown = E.garble(text, chain)
        chains, back, lost = E.judge(shown, model)
        n += 1
        right += bool(chains)
        if "�" not in shown:
            lossless += 1
            restored += back == text
    assert right >= 0.98 * n and restored >= 0.9 * lossless


def test_clean_texts_stay(model):
    for text in [t.format(i) for i in range(900, 930) for t in KO + OTHER] + list(E.INNOCENT) + ["", "abc", "😀📎", "½단계"]:
        chains, back, lost = E.judge(text, model)
        assert (chains, back, lost) == ([], text, 0), text


def test_parts_of_a_text(model):
    bad = E.garble("보험회사는 보고해야 한다.", "utf8>cp1252")
    chains, back, lost = E.judge(f"금융위원회는 밝혔다.\n{bad} 담당자는 우려했다.", model)
    assert chains and back == "금융위원회는 밝혔다.\n보험회사는 보고해야 한다. 담당자는 우려했다." and lost == 0
    assert E.judge("“시행”은 â€œ인용â€\x9d이다", model)[1] == "“시행”은 “인용”이다"


def test_rows(spark, model):
    bad = E.garble("보험회사는 개선계획을 제출해야 한다", "cp949>cp1252")
    rows = [(1, bad, None, "x"), (1, bad, None, "x"), (2, None, None, "x"), (3, "", "깨끗한 글", "x"), (4, E.garble("보험회사는 보고", "cp949>utf8"), bad * 500, "x"), (None, bad, "", "x")]
    df = spark.createDataFrame(rows, "id bigint, title string, content_text string, field_name string")
    got = E.repair_encoding(df, model).collect()
    assert sorted((r.article_id or 0, r.field_name, r.status) for r in got) == [(0, "title", "restored"), (1, "title", "restored"), (1, "title", "restored"), (4, "content_text", "restored"), (4, "title", "lost")]
    assert got[0].restored_text == "보험회사는 개선계획을 제출해야 한다"
    assert E.repair_encoding(df.where("false"), model).count() == 0


def test_query(spark, root):
    import __spark_entry__ as e

    assert e.queries()["p4_found"](spark, root).columns == ["article_id", "field_name"]
