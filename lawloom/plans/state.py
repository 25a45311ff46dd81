"""Incremental merges, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawloom.operators import merge
from lawloom.plans import fragments as q
from lawloom.plans.catalog import query
from lawloom.session import table
from lawloom.streaming import feeds


_SPAN = "SELECT user_id, event_type, arg_max(value, ts) AS last_value, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS seen FROM events GROUP BY 1, 2"


@query(_SPAN)
def event_upsert(spark, root) -> DataFrame:
    e = table(spark, root, "events")
    return merge.observed_span(e, ["user_id", "event_type"], "ts", F.col("value"), ["ts", "event_id"])


@query(_SPAN.replace(", count(*) AS seen", ""))
def event_upsert_in_batches(spark, root) -> DataFrame:
    """The same state reached by two merges, the later half of the log into the state of the earlier one."""
    e = table(spark, root, "events").select("user_id", "event_type", F.col("value").alias("last_value"), F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"), "event_id", "ts")
    edge = F.lit("2024-01-16").cast("timestamp_ntz")
    keys, order = ["user_id", "event_type"], ["ts", "event_id"]
    early = merge.upsert(None, e.where(F.col("ts") < edge), keys, order, "first_seen", "last_seen")
    both = merge.upsert(early, e.where(F.col("ts") >= edge), keys, order, "first_seen", "last_seen")
    return both.select("user_id", "event_type", "last_value", "first_seen", "last_seen")


_KEYS = "source_system, source_channel, source_item_id"


@query(f"""
SELECT {_KEYS}, count(*) AS seen, min(id) AS first_id, max(id) AS last_id, arg_max(coalesce(title, ''), id) AS last_title FROM articles GROUP BY 1, 2, 3
""")
def article_versions(spark, root) -> DataFrame:
    a = table(spark, root, "articles")
    return a.groupBy("source_system", "source_channel", "source_item_id").agg(F.count("*").alias("seen"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.max_by(F.coalesce("title", F.lit("")), "id").alias("last_title"))


@query(f"""
WITH t AS (SELECT *, {q.attachment_title("file_name", "file_url")} AS title_key FROM attachments)
SELECT id, article_id, title_key FROM t QUALIFY row_number() OVER (PARTITION BY article_id, title_key ORDER BY {q.format_rank("coalesce(file_ext, CASE WHEN contains(file_name, '.') THEN lower(regexp_extract(file_name, '([^.]*)$', 1)) END)")}, id) = 1
""")
def best_attachments(spark, root) -> DataFrame:
    return merge.best_attachments(table(spark, root, "attachments").select("id", "article_id", "file_name", "file_url", "file_ext")).select("id", "article_id", "title_key")


@query("""
WITH s AS (SELECT report_output_id AS o, article_id AS a, attachment_id AS t FROM report_output_sources WHERE id % 2 = 0), b AS (SELECT report_output_id AS o, article_id AS a, attachment_id AS t FROM report_output_sources WHERE id % 2 = 1),
n AS (SELECT DISTINCT o, a, t FROM b WHERE o IS NOT NULL AND a IS NOT NULL AND t IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s WHERE s.o = b.o AND s.a = b.a AND s.t = b.t)),
u AS (SELECT * FROM s UNION ALL SELECT * FROM n UNION ALL SELECT * FROM b WHERE o IS NULL OR a IS NULL OR t IS NULL)
SELECT o, count(*) AS n, count(t) AS with_attachment FROM u GROUP BY 1
""")
def sources_insert_or_ignore(spark, root) -> DataFrame:
    s = table(spark, root, "report_output_sources").select("id", F.col("report_output_id").alias("o"), F.col("article_id").alias("a"), F.col("attachment_id").alias("t"))
    merged = merge.insert_or_ignore(s.where("id % 2 = 0").drop("id"), s.where("id % 2 = 1").drop("id"), ["o", "a", "t"])
    return merged.groupBy("o").agg(F.count("*").alias("n"), F.count("t").alias("with_attachment"))


@query("""
WITH d AS (SELECT canonical_url, min(id) AS id FROM attachment_documents WHERE canonical_url IS NOT NULL AND download_status = 'downloaded' GROUP BY 1)
SELECT count(*) AS attachments, count(coalesce(t.document_id, d.id)) AS linked_to_known, count(DISTINCT CASE WHEN d.id IS NULL AND t.file_url <> '' THEN t.file_url END) AS new_documents FROM attachments t LEFT JOIN d ON d.canonical_url = t.file_url
""")
def linked_documents(spark, root) -> DataFrame:
    known = table(spark, root, "attachment_documents").where("download_status = 'downloaded'").select("id", "canonical_url")
    t = table(spark, root, "attachments").select("id", "file_url", "document_id")
    new, linked = merge.link_documents(t, known)
    is_new = linked.join(new.select(F.col("id").alias("document_id"), F.lit(True).alias("_n")), "document_id", "left")
    return is_new.agg(F.count("*").alias("attachments"), F.count(F.when(F.col("_n").isNull(), F.col("document_id"))).alias("linked_to_known")).join(new.agg(F.count("*").alias("new_documents")))


@query(f"""
SELECT source_channel, count(DISTINCT id) AS rows_now FROM articles WHERE source_channel NOT LIKE 'fss%' GROUP BY 1
UNION ALL SELECT source_channel, count(*) FROM (SELECT DISTINCT {_KEYS} FROM articles WHERE source_channel LIKE 'fss%') GROUP BY 1
""")
def replaced_groups(spark, root) -> DataFrame:
    """The channels of one authority are collected anew, each item once in its last version; all others stay as they are."""
    a = table(spark, root, "articles").where("source_channel is not null").select("id", "source_system", "source_channel", "source_item_id")
    keys = ["source_system", "source_channel", "source_item_id"]
    again = a.where(F.col("source_channel").startswith("fss")).groupBy(*keys).agg(F.max("id").alias("id"))
    return merge.replace_groups(a, again.select(*a.columns), "source_channel").groupBy("source_channel").agg(F.count("*").alias("rows_now"))


@query(_SPAN)
def stream_upsert(spark, root) -> DataFrame:
    """The change log read as a stream in micro-batches, merged by foreachBatch; the state after the last batch."""
    return feeds.upserted(spark, f"{root}/events.parquet")


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_daily_counts(spark, root) -> DataFrame:
    """Event-time windows of a day over the stream, closed by a watermark and a last flush."""
    return feeds.daily_counts(spark, f"{root}/events.parquet")
