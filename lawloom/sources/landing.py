"""Readers of landed feeds into one record shape, and sinks. Fetching over the network is the landing job's business:
the engine starts at files."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lawloom.functions import dims, text
from lawloom.sources.html import html_board, html_fields, html_links, html_text

FILE = "struct<file_name:string,file_url:string,file_ext:string,source:string>"
#: The shape every reader returns.
RECORD = (
    "source_system string, source_channel string, source_item_id string, title string, published_at string, organization string, department string, original_url string, "
    f"detail_url string, effective_date string, amendment_type string, content_html string, content_text string, attachments array<{FILE}>, raw map<string,string>"
)


def as_record(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The record shape from ``columns``; what is missing is a null of its type. Rows without item id or title fall out."""
    shape = rows.sparkSession.createDataFrame([], RECORD).schema
    out = rows.select(*[(columns.get(f.name, F.lit(None)).cast(f.dataType)).alias(f.name) for f in shape])
    return out.where((F.trim(F.coalesce("source_item_id", F.lit(""))) != "") & (F.trim(F.coalesce("title", F.lit(""))) != ""))


def first_given(columns: set[str], names: tuple[str, ...]) -> Column:
    """The first of these fields that is there and not blank."""
    given = [F.nullif(F.trim(F.col(f"`{n}`").cast("string")), F.lit("")) for n in names if n in columns]
    return F.coalesce(*given) if given else F.lit(None).cast("string")


def date_windows(start: str, end: str, days: int = 3) -> list[tuple[str, str]]:
    """Windows of ``days`` days that cover start..end, both included."""
    a, b = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    if b < a:
        raise ValueError("the end lies before the start")
    out = []
    while a <= b:
        last = min(a + dt.timedelta(days - 1), b)
        out.append((a.isoformat(), last.isoformat()))
        a = last + dt.timedelta(1)
    return out


def policy_briefings(spark: SparkSession, path: str, organizations: list[str] | None = None) -> DataFrame:
    """Landed XML answers of the briefing API: one record per NewsItem; FileName and FileUrl are paired by place.
    ``organizations`` keeps only those ministries, blanks in names ignored."""
    s = lambda n: StructField(n, StringType())
    schema = StructType([s(n) for n in ("NewsItemId", "Title", "MinisterCode", "ApproveDate", "OriginalUrl", "DataContents")] + [StructField(n, ArrayType(StringType())) for n in ("FileName", "FileUrl")])
    rows = spark.read.format("xml").option("rowTag", "NewsItem").schema(schema).load(path)
    if organizations:
        keys = [o.replace(" ", "") for o in organizations]
        rows = rows.where(text.without_spaces(F.col("MinisterCode")).isin(*keys))
    pair = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(F.coalesce("FileUrl", F.array())), F.lit(1))),
        lambda i: F.struct(
            F.trim(F.try_element_at("FileName", i)).alias("file_name"), F.trim(F.try_element_at("FileUrl", i)).alias("file_url"),
            text.extension(F.trim(F.try_element_at("FileName", i))).alias("file_ext"), F.lit("data_go_api").alias("source"),
        ),
    )
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return as_record(rows, {
        "source_system": F.lit("data_go_api"), "source_channel": F.lit("korea_policy_briefing_press_release"), "source_item_id": F.coalesce(blank("NewsItemId"), blank("OriginalUrl"), blank("Title")),
        "title": blank("Title"), "published_at": text.feed_datetime(F.col("ApproveDate")), "organization": blank("MinisterCode"), "original_url": blank("OriginalUrl"),
        "content_html": F.col("DataContents"), "content_text": html_text(F.col("DataContents")), "attachments": F.filter(pair, lambda f: F.coalesce(f["file_url"], F.lit("")) != ""),
        "raw": F.create_map(*[x for n in ("NewsItemId", "MinisterCode", "ApproveDate", "OriginalUrl") for x in (F.lit(n), F.col(n))]),
    })


# Names under which news feeds give a field, in order of preference.
_NEWS_FIELDS = {
    "source_item_id": "uid id uuid hash article_id news_id source_item_id detail_url original_url link url",
    "title": "title headline newsTitle",
    "published_at": "published_at publishedAt created_at createdAt pubDate regDate date",
    "content_html": "content_html contentHtml body_html bodyHtml",
    "content_text": "content_text contentText body full_text fullText description summary summary_text summaryText",
    "original_url": "original_url originalUrl link url",
    "detail_url": "detail_url detailUrl link url original_url originalUrl",
    "organization": "organization publisher press source publisher_name",
}


def news_feed(spark: SparkSession, path: str, system: str = "overseas_news_api", channel: str | None = None) -> DataFrame:
    """Landed JSON of a news API: an array of items, one item, or an envelope with items, data or articles."""
    rows = spark.read.option("multiLine", True).json(path)
    for envelope in ("items", "data", "articles"):
        if envelope in rows.columns and rows.schema[envelope].dataType.typeName() == "array":
            rows = rows.select(F.explode(envelope).alias("_i")).select("_i.*")
            break
    names = set(rows.columns)
    get = {k: first_given(names, tuple(v.split())) for k, v in _NEWS_FIELDS.items()}
    title = get["title"]
    told = F.lit(None).cast("string")
    if "highlight" in names and rows.schema["highlight"].dataType.typeName() == "struct":  # marked places where there is no text
        inner = set(rows.schema["highlight"].dataType.names)
        part = lambda *keys: F.coalesce(*[F.nullif(F.col(f"highlight.{k}").cast("string"), F.lit("")) for k in keys if k in inner], F.lit(None).cast("string"))
        told = F.nullif(F.concat_ws(" ", part("title"), part("content", "body")), F.lit(""))
    return as_record(rows, get | {
        "source_system": F.lit(system), "source_channel": F.lit(channel or system), "source_item_id": F.coalesce(get["source_item_id"], title), "published_at": text.feed_datetime(get["published_at"]),
        "content_text": F.coalesce(get["content_text"], told, html_text(get["content_html"])), "organization": F.coalesce(get["organization"], F.lit(system)), "attachments": F.array().cast(f"array<{FILE}>"),
        "raw": F.from_json(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(names)])), "map<string,string>"),
    })


@dataclass
class Board:
    """How the landed pages of any other board map to records (``boards`` knows the supervised sites). ``columns``: record field to header (HTML) or key (JSON) of the list;
    ``detail``: record field to label on the detail page; ``id_pattern``: the item id within the link."""

    system: str
    channel: str
    base: str = ""
    columns: dict[str, str] = field(default_factory=dict)
    detail: dict[str, str] = field(default_factory=dict)
    id_pattern: str = r"(\d+)(?!.*\d)"
    items: str = "data"
    link: str = ""


def _finish(rows: DataFrame, board: Board, get: dict[str, Column]) -> DataFrame:
    org = dims.canonical_organization(F.lit(board.channel), get.get("organization", F.lit(None).cast("string")))
    title = text.collapse(get["title"])
    kind = get.get("amendment_type")
    named = text.amendment_type(title)
    out = get | {
        "source_system": F.lit(board.system), "source_channel": F.lit(board.channel), "organization": org, "title": title, "published_at": text.feed_datetime(get.get("published_at", F.lit(None).cast("string"))),
        "effective_date": F.coalesce(text.notice_date(get.get("effective_date", F.lit(None).cast("string"))), text.effective_day(get.get("content_text", F.lit(None).cast("string")))),
        "amendment_type": named if kind is None else F.coalesce(text.amendment_type(kind), named),
    }
    return as_record(rows, out)


def html_boards(lists: DataFrame, details: DataFrame, board: Board) -> DataFrame:
    """Records of landed HTML list pages (url, html) joined to their landed detail pages (url, html)."""
    rows = lists.select(F.explode(html_board(F.col("html"), F.lit(board.base))).alias("r")).select("r.cells", "r.link").dropDuplicates(["link"])
    page = details.select(F.col("url").alias("link"), F.col("html").alias("page"))
    both = rows.join(page, "link", "left").withColumn("labels", html_fields(F.col("page"))).withColumn("files", html_links(F.col("page"), F.col("link")))
    cell = lambda h: F.nullif(F.trim(F.try_element_at("cells", F.lit(h))), F.lit(""))
    label = lambda h: F.nullif(F.trim(F.try_element_at("labels", F.lit(h))), F.lit(""))
    get = {k: cell(h) for k, h in board.columns.items()}
    for k, h in board.detail.items():
        get[k] = F.coalesce(label(h), get[k]) if k in get else label(h)
    get |= {
        "source_item_id": F.coalesce(F.nullif(F.regexp_extract("link", board.id_pattern, 1), F.lit("")), F.col("link")), "original_url": F.col("link"), "detail_url": F.col("link"),
        "content_html": F.col("page"), "content_text": html_text(F.col("page")), "raw": F.col("cells"),
        "attachments": F.transform("files", lambda f: F.struct(f["file_name"].alias("file_name"), f["file_url"].alias("file_url"), f["file_ext"].alias("file_ext"), F.lit(board.system).alias("source"))),
    }
    return _finish(both, board, get)


def json_boards(spark: SparkSession, path: str, board: Board) -> DataFrame:
    """Records of landed JSON lists; the items lie in the array field the board names, or are the document itself."""
    rows = spark.read.option("multiLine", True).json(path)
    if board.items in rows.columns and rows.schema[board.items].dataType.typeName() == "array":
        rows = rows.select(F.explode(board.items).alias("_i")).select("_i.*")
    names = set(rows.columns)
    get = {k: first_given(names, (key,)) for k, key in board.columns.items()}
    if "content_html" in get:
        get["content_text"] = html_text(get["content_html"])
    get["raw"] = F.from_json(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(names)])), "map<string,string>")
    return _finish(rows, board, get)


def labelled_body(fields: Column, labels: tuple[str, ...] = ("질의요지", "회답", "이유")) -> Column:
    """Parts of a case under their labels in brackets, missing ones left out."""
    part = lambda n: F.when(F.coalesce(F.trim(F.try_element_at(fields, F.lit(n))), F.lit("")) != "", F.concat(F.lit(f"[{n}] "), F.trim(F.try_element_at(fields, F.lit(n)))))
    return F.concat_ws("\n\n", *[part(n) for n in labels])


def bullet_lines(body: Column) -> Column:
    """Only the lines of the form '- [..' if there are any, else the text as it is."""
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"^\s*-\s*\["))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(body)


def rule_groups(spark: SparkSession, path: str) -> DataFrame:
    """Rule files under a folder, at any depth: files of equal content once (the first path), grouped by rule name, each
    group's files in order of format, length of name and name: rule_name, paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("digest"), text.extension(F.col("path")).alias("ext"))
    files = files.where(F.col("ext").isin(*dims.RULE_FORMATS)).groupBy("digest").agg(F.min("path").alias("path"), F.min_by("ext", "path").alias("ext"))
    named = files.withColumn("rule_name", text.rule_name(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")))))
    entry = F.struct(dims.format_rank(F.col("ext"), dims.RULE_FORMATS).alias("r"), F.length("path").alias("l"), "path")
    return named.groupBy("rule_name").agg(F.array_sort(F.collect_list(entry)).alias("f")).select("rule_name", F.transform("f", lambda s: s["path"]).alias("paths"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks saved as JSON lines; blank lines are skipped."""
    return spark.read.schema("chunk_id string, doc_id string, title string, text string, metadata map<string,string>").json(path).where("chunk_id is not null")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Overwrite a table; with ``partition_by`` only the partitions that occur are replaced."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(path)


def uncached(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose key (path, size, time of change) is not in the parse cache yet; adds ``cache_key``."""
    key = F.substring(F.sha2(F.concat_ws("|", "path", F.col("length").cast("string"), F.unix_timestamp("modificationTime").cast("string")), 256), 1, 24)
    return files.withColumn("cache_key", key).join(cache.select("cache_key"), "cache_key", "left_anti")


def run_summary(articles: DataFrame, errors: dict[str, str] | None = None, newest: int = 20) -> str:
    """JSON of a run: counts by channel, errors, the newest articles. Its size does not grow with the table."""
    counts = articles.groupBy("source_system", "source_channel").count().orderBy("source_system", "source_channel").collect()
    latest = articles.orderBy(F.desc(F.coalesce("published_at", F.lit(""))), F.desc("id")).select("id", "title", "published_at").limit(newest).collect()
    return json.dumps({"counts": [list(r) for r in counts], "errors": errors or {}, "latest": [list(r) for r in latest]}, ensure_ascii=False)


def load_config(path: str) -> dict:
    """Collectors switched on, with pages and days, from a YAML file of nested mappings, scalars and lists."""
    try:
        import yaml

        with open(path, encoding="utf-8") as f:
            return yaml.safe_load(f) or {}
    except ImportError:
        return _small_yaml(open(path, encoding="utf-8").read())


def _small_yaml(source: str) -> dict:
    root: dict = {}
    stack: list[tuple[int, dict | list]] = [(-1, root)]
    pending: tuple[dict, str] | None = None
    for line in source.splitlines():
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        indent, item = len(body) - len(body.lstrip()), body.strip()
        while stack and indent <= stack[-1][0] and not (item.startswith("- ") and isinstance(stack[-1][1], list) and indent == stack[-1][0]):
            stack.pop()
        if item.startswith("- "):
            if pending is not None:
                holder, key = pending
                holder[key] = []
                stack.append((indent, holder[key]))
                pending = None
            stack[-1][1].append(_scalar(item[2:]))
            continue
        if pending is not None:
            holder, key = pending
            holder[key] = {}
            stack.append((indent - 1, holder[key]))
            pending = None
        key, _, value = item.partition(":")
        here = stack[-1][1]
        if value.strip():
            here[key.strip()] = _scalar(value.strip())
        else:
            here[key.strip()] = None
            pending = (here, key.strip())
    return root


def _scalar(text_: str):
    t = text_.strip()
    if t[:1] in "\"'" and t[-1:] == t[:1]:
        return t[1:-1]
    low = t.lower()
    return {"true": True, "false": False, "null": None}.get(low, int(t) if t.lstrip("-").isdigit() else t)
