"""The boards of the supervised sites: landed list, detail and attachment pages in the shapes the sites answer with, read into
records.

A landed page is a row of channel, role (``list``, ``detail``, ``files``), key, url, body. The key of a detail or files page is
what its list row calls it by: the item's id. Each page is parsed by itself in an Arrow batch; list rows meet their
detail pages by one join on (channel, key); dates and kinds are built-in expressions over the parsed fields.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import parse_qs, quote, unquote, urlencode, urljoin, urlparse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawloom.functions import dims, text
from lawloom.sources.html import _SILENT, _VOID, page_links, page_text
from lawloom.sources.landing import as_record

# ---------------------------------------------------------------------------------------------------------------- documents


class Node:
    """An element of a page; texts are children of type str."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """All elements below, in the order of the page."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def all(self, selector: str) -> list[Node]:
        """Elements below that match ``tag.class#id[attr*='part']`` steps, each below the one before."""
        found = [self]
        for step in selector.split():
            test = _step(step)
            seen: dict[int, Node] = {}
            for base in found:
                for node in base.walk():
                    if test(node):
                        seen.setdefault(id(node), node)
            found = list(seen.values())
        return found

    def one(self, *selectors: str) -> Node | None:
        """The first element of the first selector that matches."""
        return next((hit[0] for s in selectors if (hit := self.all(s))), None)

    def texts(self) -> Iterator[str]:
        stack: list[Node | str] = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                if x.strip():
                    yield x.strip()
            elif x.tag not in _SILENT:
                stack += reversed(x.children)

    def line(self) -> str:
        return " ".join(" ".join(self.texts()).split())

    def markup(self) -> str:
        out: list[str] = []
        stack: list[Node | str | tuple[str]] = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                out.append(x[0])
            elif isinstance(x, str):
                out.append(html.escape(x, quote=False))
            else:
                out.append("<" + x.tag + "".join(f' {k}="{html.escape(v)}"' for k, v in x.attrs.items()) + ">")
                if x.tag not in _VOID:
                    stack.append((f"</{x.tag}>",))
                    stack += reversed(x.children)
        return "".join(out)


def _step(step: str) -> Callable[[Node], bool]:
    m = re.fullmatch(r"([a-z0-9]*)((?:\.[\w-]+)*)(?:#([\w-]+))?(?:\[(\w+)(?:\*='([^']*)')?\])?", step)
    tag, classes, name, attr, part = m.groups()
    wanted = set(filter(None, classes.split(".")))

    def test(node: Node) -> bool:
        return (
            (not tag or node.tag == tag) and wanted <= set(node.attrs.get("class", "").split()) and (not name or node.attrs.get("id") == name)
            and (not attr or (attr in node.attrs and (part is None or part in node.attrs[attr])))
        )

    return test


#: Elements that end an open element of these kinds before they begin.
_CLOSES = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "p": {"p"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("", {})

    def handle_starttag(self, tag, attrs):
        closes = _CLOSES.get(tag, ())
        while self.here.tag in closes:
            self.here = self.here.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.here)
        self.here.children.append(node)
        if tag not in _VOID:
            self.here = node

    def handle_endtag(self, tag):
        node = self.here
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.here = node.parent

    def handle_data(self, data):
        self.here.children.append(data)


def document(markup: str) -> Node:
    tree = _Tree()
    try:
        tree.feed(markup or "")
        tree.close()
    except (AssertionError, ValueError):  # broken markup: keep what was read
        pass
    return tree.root


def labels(page: Node) -> dict[str, str]:
    """Values by their labels: th and the td after it, dt and the dd after it; the first that is not empty stays."""
    out: dict[str, str] = {}
    label = None
    for node in page.walk():
        if node.tag in ("th", "dt"):
            label = node.line()
        elif node.tag in ("td", "dd") and label is not None:
            if not out.get(label):
                out[label] = node.line()
            label = None
    return out


def _labelled(found: dict[str, str], name: str) -> str | None:
    """The value of the first label that holds ``name``, blanks ignored."""
    key = re.sub(r"\s+", "", name)
    return next((v for k, v in found.items() if key in re.sub(r"\s+", "", k)), None)


def _query(url: str, *names: str) -> str | None:
    q = parse_qs(urlparse(url).query)
    return next((q[n][0] for n in names if q.get(n)), None)


# -------------------------------------------------------------------------------------------------------------- attachments

_Files = list[dict[str, str]]


def _file(name: str, url: str, ext: str | None = None) -> dict[str, str | None]:
    return {"file_name": name, "file_url": url, "file_ext": ext or (name.rsplit(".", 1)[-1].lower() if "." in name else None)}


def general_files(page: Node, url: str) -> _Files:
    return page_links(page.markup(), url)


def listed_files(selector: str) -> Callable[[Node, str], _Files]:
    return lambda page, url: [_file(a.line(), urljoin(url, a.attrs["href"])) for a in page.all(selector) if a.attrs.get("href")]


def guidance_files(page: Node, url: str) -> _Files:
    """Downloads named by their text, else by their parameters filere or file."""
    out = []
    for a in page.all("a[href*='/fss.hpdownload']"):
        link = urljoin(url, a.attrs["href"])
        out.append(_file(a.line() or unquote((_query(link, "filere", "file") or "").replace("+", " ")), link))
    return out


def onclick_files(page: Node, url: str) -> _Files:
    """Downloads behind downFile('name','stored name','kind')."""
    out = []
    for li in page.all("li.filename[onclick]"):
        if m := re.search(r"downFile\('([^']*)','([^']*)','([^']*)'\)", li.attrs["onclick"]):
            name, stored, kind = m.groups()
            out.append(_file((li.line() or name or stored).strip(), urljoin(url, f"/out/down/downLoad2.do?orgFileName={quote(name)}&newFileName={quote(stored)}&fileGb={quote(kind)}")))
    return out


def numbered_files(page: Node, url: str) -> _Files:
    """Downloads by file number, or by link where there is none; each once."""
    out: dict[str, dict] = {}
    for a in page.all(".downBox a"):
        number, href = a.attrs.get("fileno"), a.attrs.get("href", "").strip()
        if number:
            link = urljoin(url, "/file/downloadFile?" + urlencode({"fileNo": number, "filePage": a.attrs.get("filepage") or "board"}))
        elif href and not href.lower().startswith("javascript"):
            link = urljoin(url, href)
        else:
            continue
        out.setdefault(link, _file(a.line() or urlparse(link).path.rsplit("/", 1)[-1] or "attached_file", link))
    return list(out.values())


# What the kinds of downloads without a name are.
_DOWNLOAD_KINDS = {"101": "full_text", "104": "amendment_text", "105": "comparison_table"}


def icon_files(page: Node, url: str) -> _Files:
    """Downloads shown as icons: named by text, title or the image's texts without brackets, else by kind and number."""
    out: dict[str, dict] = {}
    for a in page.all("a[href*='/download.do']"):
        link = urljoin(url, a.attrs["href"].strip())
        image = a.one("img")
        names = [a.line(), a.attrs.get("title", ""), *([image.attrs.get("title", ""), image.attrs.get("alt", "")] if image else [])]
        name = re.sub(r"\(.*?\)", "", next((n.strip() for n in names if n.strip()), "")).strip()
        if not name:
            kind, number = _query(link, "gubun") or "", _query(link, "seq") or ""
            name = "kofia_" + _DOWNLOAD_KINDS.get(kind, f"gubun_{kind}" if kind else "attachment") + (f"_{number}" if number else "")
        out.setdefault(link, _file(name, link))
    return list(out.values())


def stored_files(body: dict, url: str) -> _Files:
    """The answer of the file service of a content system; a download is named by all its parameters."""
    out = []
    for row in (body.get("body") or {}).get("list") or []:
        names = ("atchFileId", "fileSn", "fileStreCours", "streFileNm", "orignlFileNm", "fileExtsn", "fileSize")
        given = {n: row[n] for n in names if row.get(n) is not None}
        ext = (row.get("fileExtsn") or "").strip().lstrip(".").lower()
        out.append(_file(row.get("orignlFileNm") or "", urljoin(url, "/ko/api/download/attach?" + urlencode(given)), ext or None))
    return out


# --------------------------------------------------------------------------------------------------------------------- boards


@dataclass(frozen=True)
class Site:
    """How the pages of a channel are read. ``rows``: the rows of a list page as dicts with key, title and what the list
    tells; ``view`` and ``content``: selectors of the part with the article and of its body, the first that matches, the part
    itself if none does (``whole``: the page if there is no such part); ``files``: its attachments; ``fields``: record field to label on
    the detail page; ``body``: other ways to a body."""

    system: str
    rows: Callable[[str, str], list[dict]]
    view: tuple[str, ...] = ()
    content: tuple[str, ...] = ()
    whole: bool = False
    files: Callable[[Node, str], _Files] | None = None
    fields: dict[str, str] = field(default_factory=dict)
    selected: dict[str, str] = field(default_factory=dict)
    body: Callable[[Node, dict[str, str]], tuple[str | None, str | None]] | None = None
    #: Whether the day of effect and the kind are sought in the text and the title.
    from_text: bool = False
    published: str = "published"
    json_detail: bool = False


def _cells(tr: Node) -> list[Node]:
    return [c for c in tr.children if isinstance(c, Node) and c.tag == "td"]


def _headed(body: str, url: str) -> list[dict]:
    """A table whose headers name title, department and day; the title's link holds the number."""
    page = document(body)
    at = {re.sub(r"\s+", "", th.line()): i for i, th in enumerate(page.all("thead th"))}
    out = []
    for tr in page.all("tbody tr"):
        td = _cells(tr)
        cell = lambda name, other, td=td: td[at.get(name, other)].line() if at.get(name, other) < len(td) else None
        place = at.get("제목", 1)
        a = td[place].one("a[href]") if place < len(td) else None
        if a is not None and a.attrs["href"]:
            link = urljoin(url, a.attrs["href"])
            out.append({"key": _query(link, "nttId") or link, "link": link, "title": a.line(), "department": cell("담당부서", 2), "published": cell("등록일", 3)})
    return out


def _listed(body: str, url: str) -> list[dict]:
    """A list of items with subject, info and date."""
    out = []
    for li in document(body).all(".board-list-wrap li"):
        a = li.one("a")
        if a is None:
            continue
        link = urljoin(url, a.attrs.get("href", ""))
        m = re.search(r"/(?:no|po)\d{6}/(\d+)", link)
        info = [s.line() for s in li.all(".info span")]
        date = li.one(".date")
        out.append({
            "key": (m.group(1) if m else _query(link, "noticeId", "nttId", "bbsNo")) or link, "link": link,
            "title": re.sub(r"\.\s*금일 등록된 게시글$", "", (li.one(".subject") or a).line()).strip(),
            "department": next((t.replace("담당부서 :", "").strip() for t in info if "담당부서" in t), None),
            "published": date.line() if date else next((t for t in li.texts() if re.match(r"^\d{4}-\d{2}-\d{2}$", t)), None),
        })
    return out


def _guided(notice: bool) -> Callable[[str, str], list[dict]]:
    """A table without useful headers: number, title, then the period of a notice, or department, day and state."""

    def rows(body: str, url: str) -> list[dict]:
        out = []
        for tr in document(body).all("tbody tr"):
            td, a = _cells(tr), tr.one("a[href]")
            if not td or a is None:
                continue
            link = urljoin(url, a.attrs["href"])
            cell = lambda i, td=td: td[i].line() if i < len(td) else None
            row = {"key": _query(link, "guGuidanceMgrSeq", "seqno") or cell(0) or _query(link, "nttId") or link, "link": link, "title": a.line()}
            out.append(row | ({"published": cell(2)} if notice else {"department": cell(2), "published": cell(3), "effective": cell(3), "kind": cell(4)}))
        return out

    return rows


def _numbered(body: str, url: str) -> list[dict]:
    """A table of six cells whose links run a script with the number."""
    out = []
    for tr in document(body).all("table.pan_table tbody tr"):
        td = _cells(tr)
        a = td[2].one("a[href]") if len(td) >= 6 else None
        if a is None:
            continue
        m = re.search(r"readRun\((\d+)\)", a.attrs["href"], re.I)
        if key := (m.group(1) if m else _query(urljoin(url, a.attrs["href"]), "idx")):
            out.append({"key": key, "link": urljoin(url, f"/publicdata/data_other_view.php?idx={key}"), "title": a.line(), "department": td[3].line(), "published": td[4].line()})
    return out


def _titled(body: str, url: str) -> list[dict]:
    """Links of class title, each in an item with a date."""
    out = []
    for a in document(body).all("a.title"):
        href = a.attrs.get("href", "")
        if "view.do" not in href or not a.line():
            continue
        li = a.parent
        while li is not None and li.tag != "li":
            li = li.parent
        date = li.one("span.date") if li is not None else None
        day = re.search(r"\d{4}[-./]\d{1,2}[-./]\d{1,2}", date.line()) if date else None
        link = urljoin(url, href)
        out.append({"key": _query(link, "nttId") or link, "link": link, "title": a.line(), "published": re.sub(r"[./]", "-", day.group()) if day else None})
    return out


def _seen(key: Callable[[Node], str | None], cells: dict[str, int], least: int, link: str) -> Callable[[str, str], list[dict]]:
    """A table of class brdComList; its rows carry attachments of their own."""

    def rows(body: str, url: str) -> list[dict]:
        out = []
        for tr in document(body).all("table.brdComList tbody tr"):
            td, k = _cells(tr), key(tr)
            if k and len(td) >= least:
                out.append({"key": k, "link": urljoin(url, link.format(k)), "_files": icon_files(tr, url)} | {n: td[i].line() or None for n, i in cells.items()})
        return out

    return rows


def _items(path: str, key: str, names: dict[str, str], link: str, drop: str = "", keep: tuple[str, ...] = ()) -> Callable[[str, str], list[dict]]:
    """Items of a JSON answer under ``path``; ``names``: list field to key, the first of several that is not empty."""

    def rows(body: str, url: str) -> list[dict]:
        try:
            here = json.loads(body)
        except ValueError:
            return []
        for step in path.split("."):
            here = here.get(step) if isinstance(here, dict) else None
        out = []
        for item in here or []:
            k = str(item.get(key) or "").replace(drop, "").strip() if drop else str(item.get(key) or "").strip()
            if k:
                row = {n: next((str(item[x]) for x in keys.split() if item.get(x) not in (None, "")), None) for n, keys in names.items()}
                out.append({"key": k, "link": urljoin(url, link.format(quote(k)))} | row | {x: item.get(x) for x in keep})
        return out

    return rows


def _bullets(view: Node, _: dict[str, str]) -> tuple[str | None, str | None]:
    """Only the lines '- [..] ..' under a heading if there are any."""
    content = view.one(".dbdata") or view
    raw = "\n".join(content.texts())
    kept = [x for x in (" ".join(y.split()) for y in raw.splitlines()) if re.match(r"^-\s*\[[^\]]+\]\s*", x)]
    if not kept:
        return content.markup(), raw
    return "".join(f"<p>{html.escape(x)}</p>" for x in ("- 아래 -", *kept)), "\n".join(("- 아래 -", *kept))


# The parts of a case.
_CASE_PARTS = ("질의요지", "회답", "이유")


def _case(_: Node, found: dict[str, str]) -> tuple[str | None, str | None]:
    """Question, reply and reason of a case, from the table's labels."""
    parts = [(n, (found.get(n) or "").strip()) for n in _CASE_PARTS if (found.get(n) or "").strip()]
    return "".join(f"<h4>{n}</h4><p>{html.escape(v)}</p>" for n, v in parts), "\n\n".join(f"[{n}] {v}" for n, v in parts)


_FSS = Site("fss_scrape", _headed, (".bd-view",), (".dbdata",), files=listed_files(".file-list a[href*='fileDown.do']"), fields={"department": "담당부서"})
_FSC = Site("fsc_scrape", _listed, (".board-view-wrap", ".board-view", ".bdView"), (".cont", ".dbdata", ".txt"), True, general_files)
_ADMIN = {"fields": {"department_path": "기관", "effective_label": "시행일", "kind_label": "시행여부", "period": "예고기간"}, "view": (".board-view",), "content": (".contents", ".cont"), "whole": True, "files": general_files}
_CASE_FIELDS = {"published": "회신일", "effective": "회신일", "kind": "처리구분", "department": "소관부서"}
_KSD = {"json_detail": True}
_RULES = {"view": ("",), "content": ("td.story div.storyIn",), "files": icon_files}

#: The channels. Names of fields, selectors and paths are those of the sites' answers.
SITES: dict[str, Site] = {
    "fss_press_release": _FSS,
    "fss_press_explainer": _FSS,
    "fsc_press_explainer": _FSC,
    "fsc_rule_change_notice": _FSC,
    "fsc_regulation_notice": _FSC,
    "fsc_admin_guidance_notice": Site(
        "fsc_admin_scrape", _items("data", "postNo", {"title": "title", "department": "dpNm", "department_list": "addFild2", "published": "eventStartDate"}, "/fsc_new/status/adminMap/PrvntcDetail.do?muNo=144&postNo={}&stNo=11&actCd=R"),
        from_text=True, **_ADMIN,
    ),
    "fsc_admin_guidance_enforcement": Site(
        "fsc_admin_scrape", _items("data", "postNo", {"title": "title", "department": "dpNm", "department_list": "addFild2", "published": "addFild2", "effective": "addFild2", "kind": "addFild4"}, "/fsc_new/status/adminMap/OpertnDetail.do?muNo=145&postNo={}&stNo=11&actCd=R"),
        **_ADMIN,
    ),
    "fss_admin_guidance_notice": Site("fss_admin_scrape", _guided(True), (".bd-view",), files=guidance_files, fields={"department": "담당부서"}, body=_bullets, from_text=True),
    "fss_admin_guidance_enforcement": Site("fss_admin_scrape", _guided(False), (".bd-view",), files=guidance_files, fields={"department": "담당부서"}, body=_bullets),
    "fsc_law_interpretation": Site(
        "fsc_reply_scrape", _items("data", "lawreqIdx", {"title": "title", "kind": "status"}, "/fsc_new/replyCase/LawreqDetail.do?muNo=85&stNo=11&lawreqIdx={}&actCd=R"),
        whole=True, files=general_files, fields=_CASE_FIELDS, body=_case,
    ),
    "fsc_no_action_opinion": Site(
        "fsc_reply_scrape", _items("data", "opinionIdx", {"title": "title", "kind": "status"}, "/fsc_new/replyCase/OpinionDetail.do?muNo=86&stNo=11&opinionIdx={}&actCd=R"),
        whole=True, files=general_files, fields=_CASE_FIELDS, body=_case,
    ),
    "ksd_press_release": Site("ksd_scrape", _items("body.list", "nttId", {"title": "bbsSj", "published": "frstRegistPnttm"}, "/ko/about-ksd/ksd-news/press-release/{}"), **_KSD),
    "ksd_rule_change_notice": Site("ksd_rule_scrape", _items("body.list", "nttId", {"title": "bbsSj", "published": "frstRegistPnttm"}, "/ko/information-disclosure/legal-information/notice-of-rules-revision/{}"), **_KSD),
    "kfb_publicdata_other": Site("kfb_scrape", _numbered, (".panViewArea",), (".viewInfo .txt", ".txt"), files=general_files),
    "fsec_bbs_222": Site(
        "fsec_scrape", _items("resultData", "bbsNo", {"title": "title", "department": "regUser", "published": "regDate", "contents": "contents", "path": "filePath", "path_name": "fileNameOrg", "count": "fileCount"}, "/bbs/detail?menuNo=222&bbsNo={}"),
        ("#boardView",), (".cont",), files=numbered_files, selected={"title": ".titleBox h3", "department": ".titleBox .info .tag", "published": ".titleBox .info .date"},
    ),
    "bok_press_release": Site("bok_scrape", _titled, ("div.bdView", "div.board-view", "div.content"), ("div.dbdata", "div.cont", "div.txt"), files=general_files),
    "krx_recent_rule_change": Site(
        "krx_scrape", _items("result", "BOOKID", {"title": "TITLE", "published": "PROMULDT", "department": "DEPTNAME", "effective": "STARTDT", "kind": "REVCD"}, "/out/regulation/regulationViewPop.do?bookid={}"),
    ),
    "krx_rule_change_notice": Site(
        "krx_scrape", _items("result", "BBSID", {"title": "TITLE", "published": "MAINDT", "department": "DEPTNAME"}, "/out/pds/pdsView.do?BBSID={}&Menuid=10000016", drop="T"),
        content=("#conts",), view=("",), files=onclick_files, from_text=True,
    ),
    "kofia_rule_change_notice": Site(
        "kofia_notice_scrape", _seen(lambda tr: next(iter(re.findall(r"goRevisionInfoDetail\('(\d+)'\)", tr.markup().replace("&#x27;", "'"))), None), {"title": 1, "kind": 2, "published": 3}, 5, "/service/revisionNotice/revisionNoticeView.do?revisionSeq={}"),
        fields={"title": "규정명", "department": "담당부서", "kind": "제ㆍ개정구분"}, from_text=True, **_RULES,
    ),
    "kofia_recent_rule_change": Site(
        "kofia_recent_scrape", _seen(lambda tr: next((_query(a.attrs["href"], "historySeq") for a in tr.all("a[href*='revisionView.do?historySeq=']")), None), {"title": 1, "kind": 2, "published": 3}, 4, "/service/revision/revisionView.do?historySeq={}"),
        fields={"title": "규정명", "published": "제ㆍ개정일", "kind": "개정구분", "effective": "시행일"}, **_RULES,
    ),
}

# --------------------------------------------------------------------------------------------------------------------- reading

_FILES = "array<struct<file_name:string,file_url:string,file_ext:string>>"
_LIST_SCHEMA = f"channel string, key string, link string, fields map<string,string>, list_files {_FILES}"
_DETAIL_SCHEMA = f"channel string, key string, found map<string,string>, content_html string, content_text string, files {_FILES}"


def list_rows(channel: str, body: str, url: str) -> list[tuple]:
    out = []
    for row in SITES[channel].rows(body, url):
        files = row.pop("_files", [])
        key, link = row.pop("key"), row.pop("link")
        if row.get("path") and row.get("count") not in (None, "", "0"):  # used where the detail page lists no file
            path = urljoin(url, row["path"])
            files = [_file(row.get("path_name") or urlparse(path).path.rsplit("/", 1)[-1] or "attached_file", path)]
        out.append((channel, key, link, {k: v for k, v in row.items() if v not in (None, "")}, files))
    return out


def detail_row(channel: str, key: str, body: str, url: str) -> tuple:
    site = SITES[channel]
    if site.json_detail:
        try:
            content = (json.loads(body).get("body") or {}).get("bbsCn")
        except (ValueError, AttributeError):
            content = None
        return channel, key, {}, content, page_text(content), []
    page = document(body)
    found = labels(page)
    view = page if site.view == ("",) else page.one(*site.view) if site.view else None
    if view is None:
        if not site.whole:
            return channel, key, {}, None, None, []
        view = page
    if site.body:
        markup, words = site.body(view, found)
    else:
        content = view.one(*site.content) if site.content else None
        if content is None and site.view == ("",):
            markup = words = None
        else:
            markup = content.markup() if content is not None else view.markup() if site.whole and not site.content else None
            words = "\n".join((content if content is not None else view).texts()) or "\n".join(view.texts())
    values = {n: v for n, label in site.fields.items() if (v := _labelled(found, label))}
    for n, selector in site.selected.items():
        node = view.one(selector)
        if node is not None and node.line():
            values[n] = node.line()
    # files may stand outside the article's part, but for boards whose part holds nothing else
    scope = view if site.files in (numbered_files,) or channel == "kfb_publicdata_other" else page
    return channel, key, values, markup, words, site.files(scope, url) if site.files else []


def board_records(pages: DataFrame) -> DataFrame:
    """Records of the landed pages (channel, role, key, url, body) of all channels in ``SITES``; pages of other channels are left
    out, as are list rows without key or title. A list row seen on several pages counts once; a detail page that is missing,
    null or broken leaves what the list tells. Attachments of the list row come first, then those of the detail page and of
    files pages, each URL once."""
    known = pages.where(F.col("channel").isin(*SITES) & F.col("body").isNotNull())

    def lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([r for c, b, u in zip(pdf.channel, pdf.body, pdf.url) for r in list_rows(c, b, u or "")], columns=["channel", "key", "link", "fields", "list_files"])

    def details(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([detail_row(c, k, b, u or "") for c, k, b, u in zip(pdf.channel, pdf.key, pdf.body, pdf.url)], columns=["channel", "key", "found", "content_html", "content_text", "files"])

    def stored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for c, k, b, u in zip(pdf.channel, pdf.key, pdf.body, pdf.url):
                try:
                    rows.append((c, k, stored_files(json.loads(b), u or "")))
                except (ValueError, AttributeError):
                    continue
            yield pd.DataFrame(rows, columns=["channel", "key", "more_files"])

    cols = ["channel", "key", "url", "body"]
    once = lambda df, names: df.groupBy("channel", "key").agg(F.min_by(F.struct(*names), F.col("key")).alias("_v")).select("channel", "key", *[F.col(f"_v.{n}").alias(n) for n in names])
    rows = once(known.where("role = 'list'").select(*cols).mapInPandas(lists, _LIST_SCHEMA), ["link", "fields", "list_files"])
    pages_ = once(known.where("role = 'detail' and key is not null").select(*cols).mapInPandas(details, _DETAIL_SCHEMA), ["found", "content_html", "content_text", "files"])
    extra = once(known.where("role = 'files' and key is not null").select(*cols).mapInPandas(stored, f"channel string, key string, more_files {_FILES}"), ["more_files"])
    both = rows.join(pages_, ["channel", "key"], "left").join(extra, ["channel", "key"], "left")
    told = lambda n: F.coalesce(F.nullif(F.trim(F.try_element_at("found", F.lit(n))), F.lit("")), F.nullif(F.trim(F.try_element_at("fields", F.lit(n))), F.lit("")))
    listed = lambda n: F.nullif(F.trim(F.try_element_at("fields", F.lit(n))), F.lit(""))
    path = F.coalesce(told("department_path"), F.when(F.col("channel").startswith("fsc_admin"), listed("department_list")))
    department = F.when(F.contains(path, F.lit(">")), F.trim(F.element_at(F.split(path, ">"), -1))).otherwise(told("department"))
    department = F.when(F.col("channel").isin("fsc_law_interpretation", "fsc_no_action_opinion"), F.replace(department, F.lit(","), F.lit(" > "))).otherwise(department)
    start = text.date_range(F.coalesce(told("published"), told("period")))["start_day"]
    published = F.when(F.col("channel") == "ksd_press_release", text.feed_datetime(F.substring(told("published"), 1, 8))).when(F.col("channel") == "fsc_admin_guidance_enforcement", F.coalesce(text.padded_day(listed("published")), text.padded_day(told("effective_label"))))
    published = published.otherwise(start)
    sought = F.col("channel").isin(*[c for c, s in SITES.items() if s.from_text])
    effective = F.when(sought, text.effective_day(F.col("content_text"))).otherwise(F.coalesce(text.padded_day(told("effective")), text.padded_day(told("effective_label"))))
    first = F.when(F.size(F.coalesce("files", F.array())) > 0, F.col("files"))
    # of a list row's own files, those the list only tells in case the page shows none give way to the page's
    own = F.when((F.col("channel") != "fsec_bbs_222") | first.isNull(), F.col("list_files"))
    none = F.array().cast(_FILES)
    files = F.concat(F.coalesce(own, none), F.coalesce("files", none), F.coalesce("more_files", none))
    files = F.aggregate(files, none, lambda acc, f: F.when(F.exists(acc, lambda g: g["file_url"] == f["file_url"]), acc).otherwise(F.concat(acc, F.array(f))))
    names = F.array_join(F.transform(files, lambda f: F.coalesce(f["file_name"], F.lit(""))), " ")
    in_texts = F.concat_ws(" ", told("title"), "content_text", F.when(F.col("channel") == "krx_rule_change_notice", names))
    kind = F.when(F.col("channel") == "kofia_rule_change_notice", told("kind")).when(sought, text.amendment_type(in_texts)).when(F.col("channel") == "fsc_admin_guidance_enforcement", F.coalesce(listed("kind"), told("kind_label"))).otherwise(told("kind"))
    system = F.create_map(*[F.lit(x) for c, s in SITES.items() for x in (c, s.system)])[F.col("channel")]
    return as_record(both.withColumn("_files", files), {
        "source_system": system, "source_channel": F.col("channel"), "source_item_id": F.col("key"), "title": text.collapse(told("title")), "published_at": published,
        "organization": dims.canonical_organization(F.col("channel"), F.lit(None).cast("string")), "department": department, "original_url": F.col("link"), "detail_url": F.col("link"),
        "effective_date": effective, "amendment_type": kind, "content_html": F.coalesce("content_html", listed("contents")), "content_text": F.col("content_text"),
        "attachments": F.transform("_files", lambda f: F.struct(f["file_name"].alias("file_name"), f["file_url"].alias("file_url"), f["file_ext"].alias("file_ext"), system.alias("source"))),
        "raw": F.map_concat("fields", F.map_filter(F.coalesce("found", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key("fields", k))),
    })
