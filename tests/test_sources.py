import io
import json
import zipfile

from pyspark.sql import functions as F

from lawloom.sources import extract, html, landing

LIST = """<table><thead><tr><th>번호</th><th>제목</th><th>담당부서</th><th>등록일</th></tr></thead><tbody>
<tr><td>2</td><td><a href="view.do?nttId=12">둘째 &amp; 글</a></td><td>감독국</td><td>2026.03.04</td></tr>
<tr><td>1</td><td><a href="view.do?nttId=11">첫째 일부개정</a></td><td></td><td>2026-03-03</td></tr></tbody></table>"""
DETAIL = """<html><script>var x="no";</script><!-- no --><dl><dt>담당부서</dt><dd>은행국</dd></dl><div>본문 <b>글</b></div>
<a href="/fileDown.do?id=1">안내.hwp</a><a href="/fileDown.do?id=1">안내.hwp</a><a href="#x">top</a><a href="/viewer.html?file=%2Fa%2Fb.pdf">뷰어</a></html>"""


def test_page():
    assert html.page_text(DETAIL).split("\n")[:3] == ["담당부서", "은행국", "본문"]
    assert [(x["file_name"], x["file_url"], x["file_ext"]) for x in html.page_links(DETAIL, "https://s.example/x/")] == [("안내.hwp", "https://s.example/fileDown.do?id=1", "hwp"), ("b.pdf", "https://s.example/a/b.pdf", "pdf")]
    assert html.board_rows(LIST, "https://s.example/")[0]["cells"]["제목"] == "둘째 & 글"
    assert html.page_text(None) is None and html.page_links("<a href=") == [] and html.board_rows("") == []


def test_html_board(spark):
    b = landing.Board("fss_scrape", "fss_press_release", "https://s.example/", {"title": "제목", "department": "담당부서", "published_at": "등록일"}, {"department": "담당부서"}, r"nttId=(\d+)")
    lists = spark.createDataFrame([("l", LIST), ("l2", LIST)], "url string, html string")
    details = spark.createDataFrame([("https://s.example/view.do?nttId=12", DETAIL)], "url string, html string")
    got = {r.source_item_id: r for r in landing.html_boards(lists, details, b).collect()}
    assert set(got) == {"11", "12"} and got["12"].department == "은행국" and got["12"].published_at == "2026-03-04" and len(got["12"].attachments) == 2
    assert got["11"].amendment_type == "일부개정" and got["11"].organization == "금융감독원" and got["11"].content_text is None


def test_policy_briefings(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        "<response><body><NewsItem><NewsItemId>1</NewsItemId><Title> T </Title><MinisterCode>금융 위원회</MinisterCode><ApproveDate>03/04/2026 09:05:00</ApproveDate><DataContents>&lt;p&gt;글&lt;/p&gt;</DataContents>"
        "<FileName>a.pdf</FileName><FileName>b.HWP</FileName><FileUrl>u1</FileUrl><FileUrl>u2</FileUrl></NewsItem>"
        "<NewsItem><NewsItemId>2</NewsItemId><Title>X</Title><MinisterCode>다른곳</MinisterCode></NewsItem><NewsItem><NewsItemId>3</NewsItemId><MinisterCode>금융위원회</MinisterCode></NewsItem></body></response>"
    )
    got = landing.policy_briefings(spark, str(tmp_path), ["금융위원회"]).collect()
    assert [(r.source_item_id, r.title, r.published_at, r.content_text) for r in got] == [("1", "T", "2026-03-04 09:05:00", "글")]
    assert [(f.file_name, f.file_url, f.file_ext) for f in got[0].attachments] == [("a.pdf", "u1", "pdf"), ("b.HWP", "u2", "hwp")]


def test_news_feed(spark, tmp_path):
    (tmp_path / "n.json").write_text(json.dumps({"data": [{"uid": "a", "headline": "H", "pubDate": "2026-03-04", "body_html": "<p>x</p>"}, {"uid": "b"}, {"title": " only title ", "link": "l"}]}))
    got = {r.source_item_id: r for r in landing.news_feed(spark, str(tmp_path)).collect()}
    assert set(got) == {"a", "l"} and got["a"].content_text == "x" and got["l"].title == "only title" and got["a"].attachments == []


def test_json_board(spark, tmp_path):
    (tmp_path / "k.json").write_text(json.dumps({"list": [{"nttId": 5, "nttSj": "규정 개정", "regDate": "20260304", "nttCn": "<p>시행일: 2026.4.1</p>"}]}))
    r = landing.json_boards(spark, str(tmp_path), landing.Board("ksd_scrape", "ksd_rule_change_notice", columns={"source_item_id": "nttId", "title": "nttSj", "published_at": "regDate", "content_html": "nttCn"}, items="list")).first()
    assert (r.source_item_id, r.published_at, r.effective_date, r.amendment_type, r.organization) == ("5", "2026-03-04", "2026-04-01", "개정", "한국예탁결제원")


def test_parts(spark):
    row = spark.createDataFrame([({"질의요지": "q", "이유": " "}, "- [a] x\nplain")], "m map<string,string>, t string").select(landing.labelled_body(F.col("m")).alias("b"), landing.bullet_lines(F.col("t")).alias("l")).first()
    assert row.b == "[질의요지] q" and row.l == "- [a] x"


def test_windows():
    assert landing.date_windows("2026-03-01", "2026-03-07") == [("2026-03-01", "2026-03-03"), ("2026-03-04", "2026-03-06"), ("2026-03-07", "2026-03-07")]


def _zip(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), body)
    return out.getvalue()


def test_extract():
    docx = _zip(word__document_dot_xml='<w:document xmlns:w="w"><w:p><w:r><w:t>가</w:t></w:r><w:r><w:t>나</w:t></w:r></w:p><w:p/></w:document>')
    xlsx = _zip(xl__sharedStrings_dot_xml="<sst><si><t>이름</t></si></sst>", xl__worksheets__sheet1_dot_xml='<worksheet><row><c t="s"><v>0</v></c><c><v>3</v></c></row></worksheet>')
    hwpx = _zip(Contents__section10_dot_xml="<s><p><t>열</t></p></s>", Contents__section2_dot_xml="<s><p><t>둘</t></p></s>")
    assert extract.extract(docx, "docx")[:3] == (True, "docx", "가나") and extract.extract(xlsx, "XLSX")[2] == "이름 | 3" and extract.extract(hwpx, ".hwpx")[2] == "둘\n\n열"
    assert extract.extract(b'{"a":1}', "json")[2] == '{\n  "a": 1\n}' and extract.extract(b"a , b\nc", "csv")[2] == "a | b\nc" and extract.extract(b"<a> x <b>y</b></a>", "xml")[2] == "x\ny"
    assert extract.extract(b"<html><p>x</p></html>", "pdf")[:3] == (True, "html", "x")
    assert extract.extract(b"junk", "docx")[0] is False and extract.extract(None, "pdf")[3] == "no content" and extract.extract(b"a \t b\n", "zzz")[2] == "a b"
    assert extract.extract(b"x", "hwp")[0] is False


def test_extract_files(spark):
    df = spark.createDataFrame([(bytearray(b"hello"), "txt"), (None, None)], "content binary, ext string")
    got = [r.extraction for r in extract.extract_files(df).collect()]
    assert (got[0].ok, got[0].text) == (True, "hello") and got[1].ok is False


def test_rule_groups(spark, tmp_path):
    for name, body in {"a/여신.pdf": "1", "b/여신.hwp": "2", "b/copy.txt": "1", "b/x.exe": "3"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    got = {r.rule_name: len(r.paths) for r in landing.rule_groups(spark, str(tmp_path)).collect()}
    assert got == {"여신": 2}


def test_config_chunks_summary(spark, tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text('date_window_days: 3 # days\ncollectors:\n  api:\n    enabled: true\n    orgs:\n      - "가"\n      - 나\n  fss:\n    enabled: false\n    max_pages: 2\n')
    assert landing._small_yaml(p.read_text()) == {"date_window_days": 3, "collectors": {"api": {"enabled": True, "orgs": ["가", "나"]}, "fss": {"enabled": False, "max_pages": 2}}}
    assert landing.load_config(str(p))["date_window_days"] == 3
    (tmp_path / "x.jsonl").write_text('{"chunk_id":"1#0","doc_id":"1","text":"t"}\n\n')
    assert landing.read_chunks(spark, str(tmp_path / "x.jsonl")).count() == 1
    a = spark.createDataFrame([(1, "s", "c", "t", "2024")], "id bigint, source_system string, source_channel string, title string, published_at string")
    assert json.loads(landing.run_summary(a))["counts"] == [["s", "c", 1]]
