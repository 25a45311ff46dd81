"""Evidence for reports: articles with their attachments' texts, chosen, cut and numbered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lawloom.functions import dims, text


def evidence_rows(articles: DataFrame, attachments: DataFrame, documents: DataFrame, extractions: DataFrame, ok: str = "success") -> DataFrame:
    """Articles with all their attachments, documents and successful extractions; what is missing is null. The status is
    part of the join, not a filter, so articles without any text of an attachment stay."""
    a = articles.select(F.col("id").alias("article_id"), "title", "published_at", "organization", "source_channel", "content_text")
    t = attachments.select(F.col("id").alias("attachment_id"), "article_id", "file_name", "file_ext", "file_url", "document_id")
    d = documents.select(F.col("id").alias("document_id"), "storage_path")
    e = extractions.where(F.lower(F.trim("status")) == ok).select(F.col("id").alias("extraction_id"), "document_id", F.col("text_content").alias("extraction_text"))
    return a.join(t, "article_id", "left").join(d, "document_id", "left").join(e, "document_id", "left")


def evidence_title(file_name: Column, attachment_id: Column) -> Column:
    """The title by which an article's attachments are told apart: the file's name, an attachment without one its own id;
    empty for the body of an article without attachments."""
    named = F.nullif(text.attachment_title(file_name, F.lit(None).cast("string")), F.lit(""))
    return F.when(attachment_id.isNull(), "").otherwise(F.coalesce(named, F.concat(F.lit("att_"), attachment_id.cast("string"))))


def _best_of_title(rows: DataFrame, formats: tuple[str, ...]) -> DataFrame:
    """The last row of each article and title by an aggregation, which keeps partial results before its shuffle."""
    late = lambda c: F.coalesce(F.col(c), F.lit((1 << 63) - 1))
    order = F.struct(dims.format_rank(F.col("file_ext"), formats), late("attachment_id"), late("extraction_id"))
    rest = [c for c in rows.columns if c not in ("article_id", "title_key")]
    best = rows.groupBy("article_id", "title_key").agg(F.min_by(F.struct(*rest), order).alias("_v"))
    return best.select("article_id", *[F.col(f"_v.{c}").alias(c) for c in rest], "title_key")


def choose_by_title(rows: DataFrame, formats: tuple[str, ...] = dims.ATTACHMENT_FORMATS) -> DataFrame:
    """One row for each article and attachment title: the preferred format, then the first attachment and extraction."""
    return _best_of_title(rows.withColumn("title_key", evidence_title(F.col("file_name"), F.col("attachment_id"))), formats).select(*rows.columns, "title_key")


def chosen_evidence(
    articles: DataFrame, attachments: DataFrame, documents: DataFrame, extractions: DataFrame, ok: str = "success", formats: tuple[str, ...] = dims.ATTACHMENT_FORMATS,
) -> DataFrame:
    """The rows ``choose_by_title`` takes of ``evidence_rows``. The choice is made on ids and names alone; bodies and texts
    are joined to the chosen rows, so they do not pass through joins and aggregations on a document that many link."""
    names = attachments.select(F.col("id").alias("attachment_id"), "article_id", "file_name", "file_ext", "file_url", "document_id")
    done = extractions.where(F.lower(F.trim("status")) == ok).select(F.col("id").alias("extraction_id"), "document_id")
    ids = articles.select(F.col("id").alias("article_id")).join(names, "article_id", "left").join(done, "document_id", "left")
    chosen = _best_of_title(ids.withColumn("title_key", evidence_title(F.col("file_name"), F.col("attachment_id"))), formats)
    paths = documents.select(F.col("id").alias("document_id"), "storage_path")
    bodies = articles.select(F.col("id").alias("article_id"), "title", "published_at", "organization", "source_channel", "content_text")
    texts = extractions.select(F.col("id").alias("extraction_id"), F.col("text_content").alias("extraction_text"))
    return chosen.join(bodies, "article_id").join(paths, "document_id", "left").join(texts, "extraction_id", "left")


def merged_text(body: Column, attachment: Column, limit: int, marker: str = "[첨부문서]") -> Column:
    """Body and attachment text, the attachment under its marker, each part cut to ``limit``."""
    b, a = (F.substring(text.clean_lines(F.coalesce(c, F.lit(""))), 1, limit) for c in (body, attachment))
    return F.when(a == "", b).when(b == "", F.concat(F.lit(marker + "\n"), a)).otherwise(F.concat(b, F.lit(f"\n\n{marker}\n"), a))


def enriched_text(stored: Column, parsed: Column, limit: int, share: float | None = 0.7, marker: str = "[첨부문서]") -> Column:
    """A stored text with a newly parsed attachment under its marker, cut to ``limit``: only if the parsed text is longer
    than ``share`` of the stored one, with ``share`` None whenever it is not empty."""
    s, p = (F.coalesce(c, F.lit("")) for c in (stored, parsed))
    wanted = (p != "") if share is None else (F.length(p) > share * F.length(s))
    return F.when(wanted, F.substring(F.concat(s, F.lit(f"\n\n{marker}\n"), p), 1, limit)).otherwise(s)


def numbered(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """source_index from 1, newest first (days that are none last), then the higher article id and the lower attachment id."""
    order = [text.iso_date(F.col("published_at")).desc_nulls_last(), F.desc("article_id"), F.col("attachment_id").asc_nulls_first()]
    # ranks of the whole list without a window over one partition: sorted ranges, counted, then offset
    out = rows.orderBy(*order)
    if limit is not None:
        out = out.limit(limit)
    return with_index(out, "source_index", 1)


def with_index(sorted_rows: DataFrame, name: str, start: int = 0) -> DataFrame:
    """Consecutive numbers in the order of an already sorted frame: the rows are numbered within their range and offset
    by the sizes of the ranges before it, so no task sees more than its own range."""
    from lawloom.session import materialize

    part = materialize(sorted_rows.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "ranges")
    sizes = part.groupBy("_p").agg(F.count("*").alias("n"), F.min("_i").alias("low"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "low", "before")
    return part.join(F.broadcast(before), "_p").withColumn(name, F.col("_i") - F.col("low") + F.col("before") + start).drop("_p", "_i", "low", "before")


def payload(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON document per row, for writing as JSON lines."""
    return rows.select(F.to_json(F.struct(*columns)).alias("value"))


def prompt(title: Column, instructions: Column, sources: Column) -> Column:
    """A prompt: title, instructions, and the sources as numbered blocks (an array of struct source_index, title, text)."""
    block = F.transform(sources, lambda s: F.concat(F.lit("[source_index="), s["source_index"].cast("string"), F.lit("] "), F.coalesce(s["title"], F.lit("")), F.lit("\n"), F.coalesce(s["text"], F.lit(""))))
    return F.concat_ws("\n\n", title, instructions, F.lit("[Sources]"), F.array_join(block, "\n\n"))


def report_skeleton(title: Column, start: Column, end: Column, headings: tuple[str, ...] = ("요약", "주요 변경", "영향", "후속 조치", "출처")) -> Column:
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), F.concat(F.lit("기간: "), start, F.lit(" ~ "), end), *[F.lit(f"## {i}. {h}") for i, h in enumerate(headings, 1)])
