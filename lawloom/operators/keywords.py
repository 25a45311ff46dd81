"""Keyword extraction, co-occurrence and trends over tokenised articles."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lawloom.functions import text
from lawloom.session import materialize


def target_text(target: str = "title") -> Column:
    """The text analysed: title, content, or both joined by a blank; nulls as empty."""
    title, content = (F.coalesce(F.col(c), F.lit("")) for c in ("title", "content_text"))
    return title if target == "title" else content if target == "content" else F.concat(title, F.lit(" "), content)


def words_of(articles: DataFrame, tokens: Column, stopwords: DataFrame | None = None, synonyms: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, word (and ``keep``): each token under its canonical form, stop words dropped after that step.
    ``stopwords`` has word, ``synonyms`` canonical and synonym. Both are joined by size as Spark sees fit."""
    out = articles.select(F.col("id").alias("doc_id"), *keep, F.explode(tokens).alias("word"))
    if synonyms is not None:
        last = synonyms.where("synonym is not null").groupBy("synonym").agg(F.max("canonical").alias("canonical"))
        out = out.join(last.select(F.col("synonym").alias("word"), "canonical"), "word", "left").withColumn("word", F.coalesce("canonical", "word")).drop("canonical")
    if stopwords is not None:
        out = out.join(stopwords.select("word").distinct(), "word", "left_anti")
    return out.select("doc_id", *keep, "word")


#: Dictionary rows up to which they are sent to the documents; larger ones are joined with the words.
_SMALL_DICTIONARY = 200_000


def count_words(articles: DataFrame, tokens: Column, stopwords: DataFrame | None = None, synonyms: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """word (and the columns ``by``), tf, df: occurrences and documents of each word, under canonical forms and without stop words.

    Documents are counted where they are read: what is shuffled is one row for each word and batch, however long the documents
    and however many of them share a word. Dictionaries too large to be sent are joined with the words instead.
    """
    stop = stopwords.select("word").distinct().limit(_SMALL_DICTIONARY + 1).collect() if stopwords is not None else []
    forms = []
    if synonyms is not None:
        last = synonyms.where("synonym is not null").groupBy("synonym").agg(F.max("canonical").alias("canonical"))
        forms = last.limit(_SMALL_DICTIONARY + 1).collect()
    if len(stop) > _SMALL_DICTIONARY or len(forms) > _SMALL_DICTIONARY:
        return _counted(words_of(articles, tokens, stopwords, synonyms, by), by)
    shared = articles.sparkSession.sparkContext.broadcast(({r.synonym: r.canonical for r in forms if r.canonical is not None}, {r.word for r in stop}))
    rows = articles.select(*by, tokens.alias("_t"))
    columns = [*by, "word", "tf", "df"]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        canonical, dropped = shared.value
        for pdf in batches:
            tf: Counter = Counter()
            df: Counter = Counter()
            for *group, words in pdf.itertuples(index=False, name=None):
                if words is None:
                    continue
                own = Counter(w for w in (canonical.get(x, x) for x in words) if w is not None and w not in dropped)
                for w, n in own.items():
                    key = (*group, w)
                    tf[key] += n
                    df[key] += 1
            yield pd.DataFrame([(*k, n, df[k]) for k, n in tf.items()], columns=columns)

    types = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in by)
    return rows.mapInPandas(count, f"{types}word string, tf bigint, df bigint").groupBy("word", *by).agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def _counted(words: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``words`` if they are counted already (``count_words``), else the counts of words of documents (``words_of``)."""
    if "tf" in words.columns:
        return words
    per_doc = words.groupBy("word", "doc_id", *by).agg(F.count("*").alias("c"))
    return per_doc.groupBy("word", *by).agg(F.sum("c").alias("tf"), F.count("*").alias("df"))


def tfidf(words: DataFrame, n_docs: int) -> DataFrame:
    """word, tf, df, score: the sum over documents of tf x (ln((N+1)/(df+1))+1), rounded half to even. N counts empty documents
    too. ``words``: words of documents or their counts."""
    counts = _counted(words)
    return counts.withColumn("score", F.bround(F.col("tf") * (F.log(F.lit(n_docs + 1.0) / (F.col("df") + 1)) + 1), 0).cast("bigint"))


def top_words(words: DataFrame, n: int) -> DataFrame:
    """The n words found in most documents; ties by the word."""
    return _counted(words).select("word", F.col("df").alias("freq")).orderBy(F.desc("freq"), "word").limit(n)


def cooccurrence(words: DataFrame, n: int = 40, min_weight: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the network of the n most frequent words. Each document contributes its own pairs of at most
    n words, made inside one row; no join of the words with themselves takes place."""
    nodes = top_words(words, n)
    per_doc = words.join(F.broadcast(nodes.select("word")), "word").groupBy("doc_id").agg(F.array_sort(F.collect_set("word")).alias("w"))  # n words at most
    pairs = F.expr("flatten(transform(sequence(1, greatest(size(w), 1)), i -> transform(slice(w, i + 1, size(w)), b -> struct(w[i - 1] as source, b as target))))")
    edges = per_doc.where(F.size("w") > 1).select(F.explode(pairs).alias("p")).groupBy("p.source", "p.target").agg(F.count("*").alias("weight"))
    return nodes, edges.where(F.col("weight") >= min_weight)


def document_network(articles: DataFrame, tokens: Column, n: int = 40, min_weight: int = 2, stopwords: DataFrame | None = None, synonyms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The same from the documents themselves: (nodes, edges). Each document contributes its own pairs of at most
    n words, made inside its row; neither words nor documents are shuffled, only counts of pairs."""
    counts = materialize(count_words(articles, tokens, stopwords, synonyms), "words")
    nodes = top_words(counts, n)
    top = [r.word for r in nodes.collect()]  # n rows
    w = F.array_distinct(tokens)
    if synonyms is not None and top:
        # a top word stands in a document as itself or as one of its synonyms; a form that has a canonical one stands for that
        forms = synonyms.where("synonym is not null").groupBy("synonym").agg(F.max("canonical").alias("canonical")).where(F.col("canonical").isin(top) | F.col("synonym").isin(top)).collect()
        if forms:
            known = F.create_map(*[F.lit(x) for r in forms for x in (r.synonym, r.canonical)])
            w = F.array_distinct(F.transform(w, lambda t: F.coalesce(F.try_element_at(known, t), t)))
    chosen = F.array_sort(F.array_intersect(w, F.array(*[F.lit(t) for t in top]).cast("array<string>")))
    pairs = F.expr("flatten(transform(sequence(1, greatest(size(w), 1)), i -> transform(slice(w, i + 1, size(w)), b -> struct(w[i - 1] as source, b as target))))")
    edges = articles.select(chosen.alias("w")).where(F.size("w") > 1).select(F.explode(pairs).alias("p")).groupBy("p.source", "p.target").agg(F.count("*").alias("weight"))
    return nodes, edges.where(F.col("weight") >= min_weight)


def trend(words: DataFrame, period: str, n: int = 10, periods: DataFrame | None = None) -> DataFrame:
    """period, word, cnt for the n words that occur most, over every period, zeros included. ``words`` have a column
    ``period``, counted or not; ``periods`` lists all of them (those without words too)."""
    counts = materialize(_counted(words, (period,)), "words")
    top = counts.groupBy("word").agg(F.sum("tf").alias("total")).orderBy(F.desc("total"), "word").limit(n)
    listed = [r.word for r in top.select("word").collect()]  # n rows
    every = (periods if periods is not None else counts.select(period)).select(period).distinct()
    grid = every.select(period, F.explode(F.array(*[F.lit(w) for w in listed]).cast("array<string>")).alias("word"))
    own = counts.where(F.col("word").isin(listed)).select(period, "word", F.col("tf").alias("cnt"))
    return grid.join(own, [period, "word"], "left").select(period, "word", F.coalesce("cnt", F.lit(0).cast("bigint")).alias("cnt"))


def top_terms(texts: DataFrame, tokens: Column, n: int = 80) -> DataFrame:
    """term, count of the n terms that occur most; ties by the term."""
    return count_words(texts, tokens).select(F.col("word").alias("term"), F.col("tf").alias("count")).orderBy(F.desc("count"), "term").limit(n)


def weighted_terms(articles: DataFrame, top: int = 12, attached: DataFrame | None = None) -> DataFrame:
    """doc_id, term, weight, rank: the query terms of an article, four for each of its first twelve title tokens, three for
    each of the first thirty of its attachments' first twenty (``attached``: id, lead20) and one for each of the first twenty
    of its body; ties by the term."""
    title = articles.select(F.col("id").alias("doc_id"), F.explode(F.slice(text.news_tokens(F.col("title")), 1, 12)).alias("term"), F.lit(4).alias("w"))
    body = articles.select(F.col("id").alias("doc_id"), F.explode(F.slice(text.news_tokens(F.col("content_text")), 1, 20)).alias("term"), F.lit(1).alias("w"))
    if attached is not None:
        own = attached.join(articles.select("id"), "id", "left_semi")
        body = body.unionByName(own.select(F.col("id").alias("doc_id"), F.explode(F.slice("lead20", 1, 30)).alias("term"), F.lit(3).alias("w")))
    sums = title.unionByName(body).groupBy("doc_id", "term").agg(F.sum("w").alias("weight"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("weight"), "term"))
    return sums.withColumn("rank", rank).where(F.col("rank") <= top)
