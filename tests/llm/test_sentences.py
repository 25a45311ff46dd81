import pytest

from lawloom.llm.sentences import Evidence, sentences, split_sentences

KNOWN = Evidence({"Mr": False, "Dr": False, "No": False, "Co": False, "Ltd": False, "U.S": True, "i.e": False, "z": False, "d": False, "Abs": False, "Mio": False, "ca": False, "डॉ": False}, frozenset({"原有", "当局", "Staff"}))
CASES = [
    ["가나은행은 보고하였다.", "다음 문장이다!", "왜 그런가?"],
    ["라온시장본부는 2070. 4. 28. 개정안을 예고하였다.", "3.5%로 올랐다."],
    ["전자금융팀은 1. 인력, 2. 예산 순으로 늘리기로 했다.", "제4호 가. 및 나.목은 준용한다."],
    ['담당자는 "자료가 맞습니까? 다시 보겠습니다!"라며 중단했다.', "끝내 공개하지 않았다…", "(세부 일정은 별도로 공지한다.)", "다음 글이다."],
    ["Mr. Veldorn of Acme Co., Ltd. spoke at 4.30 on No. 25.", "“Why now? Tell us.” asked the chair.", "It fell below the U.S. average.", "Was it final?"],
    ["He said, “We will act.”", "The bank agreed, i.e. it paid.", "Files such as a_17.5.pdf at www.x.example list it…", "The end."],
    ["Nach § 5 Abs. 4 gelten Fristen, z. B. bis zum 4. März, d. h. für ca. 7.100 Fälle.", "Es kostet 3 Mio. Won.", "„Wann? Jetzt!“, fragte er."],
    ["当局公布了草案。", "主席说：“不能再等。我们马上行动。”", "附件（见第25页。另发。）列出了细节！", "结论……至今没有。", "成本过高……", "原有指引没有说明。"],
    ["指数は３．５から１．１へ下がった。", "委員長は「待てない。すぐに始める。」と述べた。", "可能なのだろうか！？", "見送る｡"],
    ["डॉ. तोलम ने कहा, “देरी नहीं होगी। काम शुरू है।”", "समिति ने मंज़ूरी दी॥", "क्या नियम लागू होगा?"],
]


def parts(text):
    return [text[a:b] for a, b in split_sentences(text, KNOWN)]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_sentences(i):
    glue = "" if i in (7, 8) else " "
    assert parts(glue.join(CASES[i])) == CASES[i]


def test_lines_and_markers():
    text = "제목 줄\n\n□ 첫째 항목은 줄이\n바뀐다. 이어진다.\n1. 둘째 항목\n - 셋째\n\n끝"
    assert parts(text) == ["제목 줄", "□ 첫째 항목은 줄이\n바뀐다.", "이어진다.", "1. 둘째 항목", "- 셋째", "끝"]


def test_sentences_without_a_blank():
    assert parts("그쳤다.공청회에 참석한 이는 가.목 및 나.목을 따른다.끝났다.") == ["그쳤다.", "공청회에 참석한 이는 가.목 및 나.목을 따른다.", "끝났다."]


def test_camel_case():
    assert parts("It fell to 3. iTrade rules now apply.") == ["It fell to 3.", "iTrade rules now apply."]


def test_thai():
    assert parts("ธนาคารรายงานทุกเดือน ใช้แบบฟอร์ม Form No. 22 สำหรับเงิน ร้อยละ 85.0 ยังไม่ผ่าน") == ["ธนาคารรายงานทุกเดือน", "ใช้แบบฟอร์ม Form No. 22 สำหรับเงิน", "ร้อยละ 85.0 ยังไม่ผ่าน"]


def test_document_evidence_comes_first():
    blank = Evidence({}, frozenset())
    text = "See Qrx. 5 and Qrx. 7 for it. The Qrx. Maru index rose.\n\nIt fell."
    assert [text[a:b] for a, b in split_sentences(text, blank)] == ["See Qrx. 5 and Qrx. 7 for it.", "The Qrx. Maru index rose.", "It fell."]


def test_spans_cover_all_but_white_space():
    text = " 하나다. 둘이다.\n\n 셋이다 “열린 따옴표. 그대로. "
    got = split_sentences(text, KNOWN)
    assert "".join(text[a:b] for a, b in got).replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "")
    assert all(text[a:b] == text[a:b].strip() for a, b in got)
    assert split_sentences("", KNOWN) == [] and split_sentences(" \n\n ", KNOWN) == []


def test_rows(spark):
    rows = [(1, "하나다. 둘이다.", "x"), (1, "하나다. 둘이다.", "x"), (2, None, "x"), (3, "", "x"), (4, "아주 긴 글이다. " * 20_000, "x"), (None, "넷이다.", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, sentence string")
    got = sentences(df).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {1: 4, 4: 20_000, None: 1}
    assert sentences(df.where("false")).count() == 0


CORPUS = (
    ["Dr. Kim met the board.", "The chair, Dr. Lee, spoke of Kim and of Mr. Park."] * 30
    + ["They asked Dr. Kim at Co. level, by Mr. Lee and Kim.", "Rules of the U.S. apply.", "Staff of the U.S. agency came, said Lee and Kim."] * 6
    + ["Kim opened it.", "The guest was a Dr.", "Staff moved.", "It rests.", "To stay here he agreed. This they agreed, all agreed on this and to this. Nobody stayed, all stayed away."]
    + ["当局公布了。结论……至今没有。", "至今没有。"]
)


def _cut(df):
    return {(r.doc_id, r.start_pos, r.end_pos) for r in sentences(df).collect()}


def test_evidence_does_not_depend_on_the_size_of_the_corpus(spark):
    """A hundred times the same corpus is cut the same; a rare line end after Dr. and a rare start with Kim change nothing."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*CORPUS, "We met Dr. Kim on Monday."])], "doc_id bigint, text string")
    once = _cut(df)
    assert _cut(df.selectExpr("*", "explode(sequence(1, 100)) as n").select("doc_id", "text")) == once
    last = len(CORPUS)
    assert [x for x in once if x[0] == last] == [(last, 0, 25)]


def test_more_keys_than_can_be_broadcast(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*CORPUS, *CORPUS[:5]])], "doc_id bigint, text string")
    assert {(r.doc_id, r.start_pos, r.end_pos) for r in sentences(df, few=0).collect()} == _cut(df)
    assert sentences(df.where("false"), few=-1).count() == 0


def test_query(spark, root):
    import __spark_entry__ as e

    assert e.queries()["p8_found"](spark, root).columns == ["doc_id", "start_pos", "end_pos"]
