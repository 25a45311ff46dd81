"""Landed pages of every channel in the shapes the sites answer with."""

import json

from lawloom.sources import boards
from lawloom.sources.boards import SITES, board_records, document, labels

U = "https://s.example"
FSS_LIST = """<table><thead><tr><th>번호</th><th>제 목</th><th>담당부서</th><th>등록일</th><th>조회수</th></tr></thead><tbody>
<tr><td>9</td><td class="title"><a href="/fss/bbs/B1/view.do?nttId=12&menuNo=2">둘째 &amp; 글</a></td><td>감독국</td><td>2026-03-04</td><td>7</td></tr><tr><td>8</td><td>링크 없음</td><td></td><td></td></tr></tbody></table>"""
FSS_VIEW = """<div class="bd-view"><dl><dt>담당부서</dt><dd>은행감독국</dd></dl><div class="dbdata">본문 <b>글</b><p>둘째 줄</p></div>
<div class="file-list"><a href="/fss/cmmn/file/fileDown.do?id=1">안내.HWP</a></div></div><a href="/x/fileDown.do?id=2">밖.pdf</a>"""
FSC_LIST = """<div class="board-list-wrap"><ul><li><div class="subject"><a href="/no010102/8811?x=1"><span class="subject">설명. 금일 등록된 게시글</span></a></div>
<div class="info"><span>담당부서 : 금융정책과</span><span>조회 3</span></div><span>2026-02-01</span></li><li>빈 줄</li></ul></div>"""
FSC_VIEW = '<div class="board-view-wrap"><div class="cont">내용이다.</div></div><a href="/comm/getFile?srvcId=1">다운로드</a><a href="/a/view.pdf">보기.pdf</a><a href="javascript:void(0)">x.pdf</a>'
ADMIN_VIEW = """<div class="board-view"><table><tr><th>기관</th><td>금융위원회 &gt; 은행과</td></tr><tr><th>시행일</th><td>2026-05-01</td></tr><tr><th>시행여부</th><td>시행중</td></tr>
<tr><th>예고기간</th><td>2026-01-02 ~ 2026-01-20</td></tr></table><div class="contents">지도 일부개정. 시행일: 2026.4.1</div></div>"""
FSS_ADMIN_LIST = '<table><tbody><tr><td>3</td><td><a href="view.do?seqno=77">지도 예고</a></td><td>2026.03.02 ~ 2026.03.20</td></tr></tbody></table>'
FSS_ADMIN_RUN = '<table><tbody><tr><td>3</td><td><a href="view.do?guGuidanceMgrSeq=78">지도 시행</a></td><td>보험과</td><td>2026.04.01</td><td>시행</td></tr></tbody></table>'
FSS_ADMIN_VIEW = '<div class="bd-view"><dl><dt>담당부서</dt><dd>은행국</dd></dl><div class="dbdata">머리<br>- [첫째]  제정<br>잡것<br>- [둘째] 나</div></div><a href="/fss.hpdownload?filere=%EA%B0%80+1.pdf"></a>'
CASE = "<table><tr><th>회신일</th><td>2026.01.05</td><th>처리구분</th><td>회신완료</td></tr><tr><th>소관부서</th><td>금융위,은행과</td></tr><tr><th>질의요지</th><td>되는가</td></tr><tr><th>회답</th><td>된다 &lt;b&gt;</td></tr></table>"
KFB_LIST = '<table class="pan_table"><tbody><tr><td>1</td><td></td><td><a href="javascript:readRun(55);">자료</a></td><td>기획부</td><td>2026.02.03</td><td>9</td></tr></tbody></table>'
KFB_VIEW = '<div class="panViewArea"><div class="viewInfo"><div class="txt">은행 글</div></div><a href="/down.do?x=1">표.xlsx</a></div><a href="/down.do?x=2">밖.xlsx</a>'
FSEC_VIEW = '<div id="boardView"><div class="titleBox"><h3>상세 제목</h3><p class="info"><span class="tag">보안팀</span><span class="date">2026-01-09</span></p></div><div class="cont">보안 글</div><div class="downBox"><a fileNo="4" filePage="board" href="javascript:d()">가.zip</a><a fileno="4">가.zip</a></div></div>'
BOK_LIST = '<ul><li><div class="set"><a class="title" href="/portal/view.do?nttId=31&m=1">외환 소식</a></div><span class="date">등록일 2026.03.09</span></li></ul>'
BOK_VIEW = '<div class="bdView"><div class="dbdata">외환 글</div></div><a href="/fileSrc/portal/1">보도자료.pdf</a>'
KRX_VIEW = "<div id=\"conts\">규정 안내 시행일 : 2026-06-01</div><ul><li class=\"filename\" onclick=\"downFile('신구 제정.hwp','s1.hwp','B')\">신구 제정.hwp</li></ul>"
KOFIA_LIST = """<table class="brdComList"><tbody><tr><td>1</td><td><a href="javascript:goRevisionInfoDetail('901')">영업 규정</a></td><td>개정</td><td>2026.01.10</td><td>2026.01.20</td>
<td><a href="/download.do?gubun=105&seq=3"><img alt="신구대비표(새창)"></a><a href="/download.do?gubun=101&seq=3"><img></a></td></tr></tbody></table>"""
KOFIA_VIEW = '<table><tr><th>규정명</th><td>영업 규정 전문</td></tr><tr><th>담당부서</th><td>자율규제부</td></tr><tr><th>제ㆍ개정구분</th><td>일부개정</td></tr><tr><td class="story"><div class="storyIn">글. 2026-07-01 시행</div></td></tr></table><a href="/download.do?gubun=105&seq=3">같은 것</a><a href="/download.do?gubun=104&seq=3">개정문</a>'
RECENT_LIST = '<table class="brdComList"><tbody><tr><td>1</td><td><a href="/service/revision/revisionView.do?historySeq=66">회원 규정</a></td><td>제정</td><td>2026.02.10</td></tr></tbody></table>'
RECENT_VIEW = '<table><tr><th>규정명</th><td>회원 규정 본</td></tr><tr><th>제ㆍ개정일</th><td>2026.02.11</td></tr><tr><th>개정구분</th><td>폐지</td></tr><tr><th>시행일</th><td>2026.03.01</td></tr><tr><td class="story"><div class="storyIn">회원 글</div></td></tr></table>'

J = lambda **x: json.dumps(x, ensure_ascii=False)
KSD_LIST = J(status=200, body={"list": [{"nttId": 5, "bbsSj": "예탁 소식", "frstRegistPnttm": "20260304101112"}]})
KSD_FILES = J(status=200, body={"list": [{"atchFileId": "A", "fileSn": 0, "streFileNm": "s", "orignlFileNm": "표.pdf", "fileExtsn": ".PDF"}]})
PAGES = [
    *[(c, "list", None, FSS_LIST) for c in ("fss_press_release", "fss_press_release", "fss_press_explainer")], ("fss_press_release", "detail", "12", FSS_VIEW),
    *[(c, "list", None, FSC_LIST) for c in ("fsc_press_explainer", "fsc_rule_change_notice", "fsc_regulation_notice")], ("fsc_press_explainer", "detail", "8811", FSC_VIEW),
    ("fsc_admin_guidance_notice", "list", None, J(recordsTotal=1, data=[{"postNo": 4, "title": " 지도 ", "dpNm": "과", "eventStartDate": ""}, {"title": "번호 없음"}])), ("fsc_admin_guidance_notice", "detail", "4", ADMIN_VIEW),
    ("fsc_admin_guidance_enforcement", "list", None, J(data=[{"postNo": "6", "title": "지도 시행", "dpNm": "과", "addFild2": "2026-05-02", "addFild4": ""}])), ("fsc_admin_guidance_enforcement", "detail", "6", ADMIN_VIEW),
    ("fss_admin_guidance_notice", "list", None, FSS_ADMIN_LIST), ("fss_admin_guidance_notice", "detail", "77", FSS_ADMIN_VIEW), ("fss_admin_guidance_enforcement", "list", None, FSS_ADMIN_RUN),
    ("fsc_law_interpretation", "list", None, J(data=[{"lawreqIdx": 41, "title": "해석", "status": "접수"}])), ("fsc_law_interpretation", "detail", "41", CASE), ("fsc_no_action_opinion", "list", None, J(data=[{"opinionIdx": 42, "title": "의견", "status": "접수"}])),
    ("ksd_press_release", "list", None, KSD_LIST), ("ksd_press_release", "detail", "5", J(status="200", body={"bbsCn": "<p>예탁 글</p>"})), ("ksd_press_release", "files", "5", KSD_FILES), ("ksd_rule_change_notice", "list", None, KSD_LIST),
    ("kfb_publicdata_other", "list", None, KFB_LIST), ("kfb_publicdata_other", "detail", "55", KFB_VIEW),
    ("fsec_bbs_222", "list", None, J(resultCode="00", resultData=[{"bbsNo": 8, "title": "목록 제목", "regDate": "2026-01-08", "fileCount": 1, "filePath": "/f/a.hwp", "fileNameOrg": "원.hwp"}, {"bbsNo": 9, "title": "둘", "regDate": "2026-01-07", "contents": "<p>목록 글</p>", "fileCount": 1, "filePath": "/f/b.hwp"}])), ("fsec_bbs_222", "detail", "8", FSEC_VIEW),
    ("bok_press_release", "list", None, BOK_LIST), ("bok_press_release", "detail", "31", BOK_VIEW),
    ("krx_recent_rule_change", "list", None, J(result=[{"BOOKID": "B1", "TITLE": "업무규정", "PROMULDT": "2026.02.02", "STARTDT": "2026.03.03", "REVCD": "일부개정", "DEPTNAME": "시장부"}])),
    ("krx_rule_change_notice", "list", None, J(result=[{"BBSID": "T00123", "TITLE": "예고", "MAINDT": "2026.01.02", "DEPTNAME": "본부"}])), ("krx_rule_change_notice", "detail", "00123", KRX_VIEW),
    ("kofia_rule_change_notice", "list", None, KOFIA_LIST), ("kofia_rule_change_notice", "detail", "901", KOFIA_VIEW), ("kofia_recent_rule_change", "list", None, RECENT_LIST), ("kofia_recent_rule_change", "detail", "66", RECENT_VIEW),
    ("unknown", "list", None, FSS_LIST), ("fss_press_release", "list", None, None), ("fss_press_release", "list", None, "<table><thead><tr"), ("ksd_press_release", "list", None, "{broken"),
]


def test_every_channel(spark):
    df = spark.createDataFrame([(c, r, k, U + "/list", b) for c, r, k, b in PAGES], "channel string, role string, key string, url string, body string").selectExpr("*", "'x' as title")
    got = {(r.source_channel, r.source_item_id): r for r in board_records(df).collect()}
    assert {c for c, _ in got} == set(SITES) and len(SITES) == 20 and len(got) == 21
    field = lambda c, k, *names: tuple(got[c, k][n] for n in names)
    day = ("published_at", "effective_date", "amendment_type")
    assert field("fss_press_release", "12", "title", "department", "organization", "content_text", *day) == ("둘째 & 글", "은행감독국", "금융감독원", "본문\n글\n둘째 줄", "2026-03-04", None, None)
    assert [(f.file_name, f.file_url, f.file_ext, f.source) for f in got["fss_press_release", "12"].attachments] == [("안내.HWP", U + "/fss/cmmn/file/fileDown.do?id=1", "hwp", "fss_scrape")]
    assert field("fss_press_explainer", "12", "department", "content_text") == ("감독국", None)
    assert field("fsc_press_explainer", "8811", "title", "department", "content_text", "published_at") == ("설명", "금융정책과", "내용이다.", "2026-02-01") and len(got["fsc_press_explainer", "8811"].attachments) == 2
    assert field("fsc_admin_guidance_notice", "4", "title", "department", *day) == ("지도", "은행과", "2026-01-02", "2026-04-01", "일부개정")
    assert field("fsc_admin_guidance_enforcement", "6", "department", *day) == ("은행과", "2026-05-02", "2026-05-02", "시행중")
    assert field("fss_admin_guidance_notice", "77", "department", "content_text", *day) == ("은행국", "- 아래 -\n- [첫째] 제정\n- [둘째] 나", "2026-03-02", None, "제정")
    assert [(f.file_name, f.file_ext) for f in got["fss_admin_guidance_notice", "77"].attachments] == [("가 1.pdf", "pdf")]
    assert field("fss_admin_guidance_enforcement", "78", "department", *day) == ("보험과", "2026-04-01", "2026-04-01", "시행")
    assert field("fsc_law_interpretation", "41", "department", "content_text", *day) == ("금융위 > 은행과", "[질의요지] 되는가\n\n[회답] 된다 <b>", "2026-01-05", "2026-01-05", "회신완료") and "&lt;b&gt;" in got["fsc_law_interpretation", "41"].content_html
    assert field("fsc_no_action_opinion", "42", "title", "amendment_type") == ("의견", "접수")
    assert field("ksd_press_release", "5", "title", "published_at", "content_text") == ("예탁 소식", "2026-03-04", "예탁 글") and field("ksd_rule_change_notice", "5", "source_system", "content_text") == ("ksd_rule_scrape", None)
    assert [(f.file_name, f.file_ext) for f in got["ksd_press_release", "5"].attachments] == [("표.pdf", "pdf")] and "orignlFileNm=%ED%91%9C.pdf" in got["ksd_press_release", "5"].attachments[0].file_url
    assert field("kfb_publicdata_other", "55", "title", "department", "published_at", "content_text") == ("자료", "기획부", "2026-02-03", "은행 글") and [f.file_name for f in got["kfb_publicdata_other", "55"].attachments] == ["표.xlsx"]
    assert field("fsec_bbs_222", "8", "title", "department", "published_at", "content_text") == ("상세 제목", "보안팀", "2026-01-09", "보안 글") and [f.file_url for f in got["fsec_bbs_222", "8"].attachments] == [U + "/file/downloadFile?fileNo=4&filePage=board"]
    assert field("fsec_bbs_222", "9", "title", "content_html") == ("둘", "<p>목록 글</p>") and [f.file_name for f in got["fsec_bbs_222", "9"].attachments] == ["b.hwp"]
    assert field("bok_press_release", "31", "title", "published_at", "content_text") == ("외환 소식", "2026-03-09", "외환 글") and len(got["bok_press_release", "31"].attachments) == 1
    assert field("krx_recent_rule_change", "B1", "title", "department", *day) == ("업무규정", "시장부", "2026-02-02", "2026-03-03", "일부개정")
    assert field("krx_rule_change_notice", "00123", *day) == ("2026-01-02", "2026-06-01", "제정") and got["krx_rule_change_notice", "00123"].attachments[0].file_url.startswith(U + "/out/down/downLoad2.do?orgFileName=")
    assert field("kofia_rule_change_notice", "901", "title", "department", *day) == ("영업 규정 전문", "자율규제부", "2026-01-10", "2026-07-01", "일부개정")
    assert [f.file_name for f in got["kofia_rule_change_notice", "901"].attachments] == ["신구대비표", "kofia_full_text_3", "개정문"]
    assert field("kofia_recent_rule_change", "66", "title", *day) == ("회원 규정 본", "2026-02-11", "2026-03-01", "폐지")
    assert board_records(df.where("false")).count() == 0


def test_document():
    page = document("<ul><li>a<li class='x y'>b <b id=z>c</b></ul><p>d<p>e<td>broken")
    assert [n.line() for n in page.all("li")] == ["a", "b c"] and page.one("li.x #z").line() == "c" and page.one(".none", "p").line() == "d"
    assert labels(document("<dl><dt>k</dt><dd></dd><dt>k</dt><dd>v</dd></dl>")) == {"k": "v"} and document(None).line() == ""
    assert boards.list_rows("fss_press_release", "", U) == [] and document("<p a='1'>x &lt; y<br></p>").one("p").markup() == '<p a="1">x &lt; y<br></p>'
