"""Incremental merges: every function takes the stored table and a batch and returns the new version of the table.

A batch may hold a key many times and in any order; ``order`` columns decide which row is the last. Each merge is one
aggregation by key over stored and new rows: max_by keeps partial results before the shuffle, so a key that a third of
a batch repeats does not gather in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawloom.functions import dims, text


def last_rows(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``; null keys are keys of their own."""
    rest = [c for c in changes.columns if c not in keys]
    packed = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_v"))
    return packed.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest])


def upsert(stored: DataFrame | None, batch: DataFrame, keys: list[str], order: list[str], first_seen: str = "first_seen_at", last_seen: str = "last_seen_at") -> DataFrame:
    """Rows of the batch replace stored ones of the same key, but first_seen stays the earliest and last_seen becomes
    the latest ever seen."""
    both = batch if stored is None else stored.select(*batch.columns).withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    by = order if stored is None else ["_new", *order]
    rest = [c for c in batch.columns if c not in keys and c not in (first_seen, last_seen)]
    agg = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_v"), F.min(first_seen).alias(first_seen), F.max(last_seen).alias(last_seen))
    return agg.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest], first_seen, last_seen)


def insert_or_ignore(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows, and batch rows whose key is not stored. A key with a null equals nothing, so such rows always enter."""
    fresh = batch.join(stored.select(*keys).dropna().distinct(), keys, "left_anti")
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    once = fresh.where(complete).dropDuplicates(keys)
    return stored.unionByName(once).unionByName(fresh.where(~complete))


def insert_or_replace(stored: DataFrame, batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last batch row of each key replaces the stored one."""
    new = last_rows(batch, [key], order)
    return stored.join(new.select(key), key, "left_anti").select(*batch.columns).unionByName(new.select(*batch.columns))


def replace_groups(stored: DataFrame, batch: DataFrame, group: str) -> DataFrame:
    """Delete, then insert: groups named in the batch are replaced whole."""
    return stored.join(batch.select(group).distinct(), group, "left_anti").select(*batch.columns).unionByName(batch)


def best_attachments(attachments: DataFrame) -> DataFrame:
    """Of the files of an article with the same title the one in the preferred format; the first id breaks ties."""
    title = text.attachment_title(F.col("file_name"), F.col("file_url"))
    return last_rows(
        attachments.withColumn("title_key", title).withColumn("_rank", -dims.format_rank(F.coalesce("file_ext", text.extension(F.col("file_name"))))).withColumn("_seq", -F.col("id")),
        ["article_id", "title_key"], ["_rank", "_seq"],
    ).drop("_rank", "_seq")


def link_documents(attachments: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new documents, linked attachments): every URL not stored yet becomes a pending document with a stable id, and
    attachments without a document get that of their URL."""
    urls = attachments.where(F.coalesce("file_url", F.lit("")) != "").select(F.col("file_url").alias("canonical_url")).distinct()
    new = urls.join(documents.select("canonical_url"), "canonical_url", "left_anti").select(
        F.xxhash64("canonical_url").alias("id"), "canonical_url", F.sha2("canonical_url", 256).alias("url_hash"), F.lit("pending").alias("download_status"), F.lit(0).alias("retry_count")
    )
    ids = documents.where("canonical_url is not null").groupBy("canonical_url").agg(F.min("id").alias("known_id")).unionByName(new.select("canonical_url", F.col("id").alias("known_id")))
    linked = attachments.join(ids.withColumnRenamed("canonical_url", "file_url"), "file_url", "left")
    return new, linked.withColumn("document_id", F.coalesce("document_id", "known_id")).drop("known_id")


def observed_span(changes: DataFrame, keys: list[str], at: str, value: Column, order: list[str]) -> DataFrame:
    """The closed form of an upsert over a change log: last value by ``order``, first and last time seen, and count."""
    return changes.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("last_value"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("seen"))
