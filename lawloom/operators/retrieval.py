"""Retrieval: chunks, BM25, hashed and given embeddings, rank fusion."""

from __future__ import annotations

import functools
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lawloom.functions.text import retrieval_tokens, stable_id
from lawloom.session import materialize, spread


# The least window and the marks a window may end after.
_LEAST_WINDOW = 300
_STOPS = (". ", " ")


def chunk_bounds(text: str, size: int = 1200, overlap: int = 160) -> list[tuple[int, int]]:
    """(start, end) of windows of at most ``size`` (300 at least) that cover the text. A window ends after the full stop of
    its last ". " or after its last blank in its second half, whichever is later, else at its full size; the next begins
    ``overlap`` (half the size at most) before that end."""
    size = max(_LEAST_WINDOW, size)
    back = min(max(overlap, 0), size // 2)
    # places a window may end, found once for the whole text: after a stop anywhere in it, after a blank in its second half
    stops, blanks = (np.array([m.start() for m in re.finditer(re.escape(mark), text)], np.int64) for mark in _STOPS)
    bounds: list[tuple[int, int]] = []
    left = 0
    while left + size < len(text):
        full = left + size

        def latest(places: np.ndarray, low: int, mark: str, full: int = full) -> int:
            k = int(np.searchsorted(places, full - len(mark), "right"))
            return int(places[k - 1]) if k and places[k - 1] >= low else -1

        cut = max(latest(stops, left, _STOPS[0]), latest(blanks, left + size // 2, _STOPS[1]))
        right = cut + 1 if cut > left else full
        bounds.append((left, right))
        left = max(right - back, left + 1)
    if text:
        bounds.append((left, len(text)))
    return bounds


def chunks(documents: DataFrame, id_col: str, title_col: str, text_col: str, size: int = 1200, overlap: int = 160) -> DataFrame:
    """chunk_id (``doc#i``), doc_id, chunk_no, title, text of every non-blank window of the collapsed text."""
    rows = documents.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(title_col), F.lit("")).alias("title"), F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"(?U)\s+", " ")).alias("text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(f"{d}#{i}", d, i, ti, t[a:b].strip()) for d, ti, t in zip(pdf.doc_id, pdf.title, pdf.text) for i, (a, b) in enumerate(chunk_bounds(t, size, overlap))]
            yield pd.DataFrame(out, columns=["chunk_id", "doc_id", "chunk_no", "title", "text"])

    return rows.where("text <> ''").mapInPandas(cut, "chunk_id string, doc_id string, chunk_no int, title string, text string")


#: Distinct query terms, and pairs of query and term, up to which a search sends its queries to the documents (some tens of
#: megabytes); beyond, documents and queries meet by a join on terms.
_MOST_TERMS, _MOST_PAIRS = 300_000, 2_000_000
#: Cells of a block of scores: eight megabytes, and a few temporaries of that size in each task.
_BLOCK = 1_000_000


class _Best:
    """The best ``limit`` documents of each query among the blocks of scores seen, by score to nine digits, then id."""

    def __init__(self, queries: int, limit: int):
        self.limit, self.edge = limit, np.full(queries, -np.inf)
        self.query, self.score, self.doc = [np.zeros(0, np.int64)], [np.zeros(0)], []
        self.waiting = 0

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        """``scores``: documents x queries, minus infinity where a document is no hit."""
        rounded = np.round(scores, 9)
        edge = self.edge
        if len(rounded) > self.limit:
            edge = np.maximum(edge, np.partition(rounded, len(rounded) - self.limit, axis=0)[len(rounded) - self.limit])
        row, column = np.nonzero((rounded >= edge) & (scores > -np.inf))
        self.query.append(column)
        self.score.append(scores[row, column])
        self.doc.append(docs[row])
        self.waiting += len(row)
        if self.waiting > 2 * self.limit * len(self.edge) + 100_000:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, score = np.concatenate(self.query), np.concatenate(self.score)
        doc = np.concatenate(self.doc) if self.doc else np.zeros(0, np.int64)
        order = np.lexsort((doc, -np.round(score, 9), query))
        query, score, doc = query[order], score[order], doc[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.limit
        full = place == self.limit - 1
        self.edge[query[full]] = np.round(score[full], 9)
        query, score, doc = query[keep], score[keep], doc[keep]
        self.query, self.score, self.doc, self.waiting = [query], [score], [doc], 0
        return query, score, doc


class Bm25Index:
    """BM25 over documents of tokens. A search reads the documents once: what they have of the query terms is written as short
    vectors with their lengths, from which the statistics are counted; the vectors are then scored against all queries
    in blocks, and each task hands on just its best ``limit`` of each query."""

    def __init__(self, documents: DataFrame, id_col: str, tokens: Column, k1: float = 1.5, b: float = 0.75, alike: tuple[str, ...] = ()):
        """``alike``: columns of the documents of which a hit must share one with its query."""
        self.k1, self.b, self.alike = k1, b, alike
        same = [F.xxhash64(c).alias(f"_a{i}") if c else F.lit(0) for i, c in enumerate(alike)]
        given = [F.col(c).isNotNull().alias(f"_n{i}") for i, c in enumerate(alike)]
        self.rows = spread(documents).select(F.col(id_col).alias("doc_id"), tokens.alias("tokens"), *same, *given)

    def search(self, queries: DataFrame, limit: int = 50, skip_self: bool = False) -> DataFrame:
        """query_id, doc_id, score, rank for ``queries`` (query_id, tokens, and the columns ``alike`` if there are any), repeated
        tokens weighing as often as they occur; of each query the best ``limit``."""
        spark = queries.sparkSession
        q = materialize(queries.select("query_id", F.explode("tokens").alias("term"), *self.alike).groupBy("query_id", "term", *self.alike).agg(F.count("*").alias("qtf")), "queries")
        if q.limit(_MOST_PAIRS + 1).count() > _MOST_PAIRS or q.select("term").distinct().limit(_MOST_TERMS + 1).count() > _MOST_TERMS:
            return self._joined(q, limit, skip_self)
        terms = {r.term: i for i, r in enumerate(q.select("term").distinct().orderBy("term").collect())}
        known = spark.sparkContext.broadcast(terms)

        def shorten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            place = known.value
            for pdf in batches:
                got = [Counter(t for t in tokens if t in place) for tokens in pdf.tokens]
                out = pdf.drop(columns="tokens")
                out["dl"] = [len(t) for t in pdf.tokens]
                out["term"] = [[place[t] for t in g] for g in got]
                out["tf"] = [list(g.values()) for g in got]
                yield out

        extra = "".join(f", _a{i} bigint" for i in range(len(self.alike))) + "".join(f", _n{i} boolean" for i in range(len(self.alike)))
        id_type = self.rows.schema["doc_id"].dataType.simpleString()
        rows = self.rows.select("doc_id", *[f"_a{i}" for i in range(len(self.alike))], *[f"_n{i}" for i in range(len(self.alike))], "tokens")
        short = materialize(rows.mapInPandas(shorten, f"doc_id {id_type}{extra}, dl int, term array<int>, tf array<int>"), "vectors")
        stats = short.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
        n, avgdl = stats.n, stats.avgdl or 1.0
        counts = np.zeros(len(terms))
        for r in short.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # _MOST_TERMS at most
            counts[r.term] = r["count"]
        idf = np.log(1 + (n - counts + 0.5) / (counts + 0.5))
        pairs = q.select("query_id", "term", "qtf", *[F.xxhash64(c).alias(f"_a{i}") for i, c in enumerate(self.alike)], *[F.col(c).isNotNull().alias(f"_n{i}") for i, c in enumerate(self.alike)]).toPandas()  # _MOST_PAIRS at most
        ids, at = np.unique(pairs.query_id.to_numpy(), return_inverse=True)
        term = pairs.term.map(terms).to_numpy(np.int64)
        order = np.argsort(term, kind="stable")
        first = np.searchsorted(term[order], np.arange(len(terms) + 1))
        weight = (pairs.qtf.to_numpy() * idf[term])[order] if len(term) else np.zeros(0)
        marks = []
        for i in range(len(self.alike)):
            value, there = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
            value[at], there[at] = pairs[f"_a{i}"].to_numpy(np.int64), pairs[f"_n{i}"].to_numpy(bool)
            marks.append((value, there))
        asked = spark.sparkContext.broadcast((ids, at[order], weight, first, marks))
        k1, b = self.k1, self.b

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, query, weight, first, marks = asked.value
            best = _Best(len(ids), limit)
            step = max(1, _BLOCK // max(1, len(ids)))
            for whole in batches:
                for x in range(0, len(whole), step):
                    pdf = whole.iloc[x : x + step]
                    held = pdf.term.str.len().to_numpy(np.int64)
                    if not held.sum():
                        continue
                    term, tf = np.concatenate(pdf.term.to_numpy()).astype(np.int64), np.concatenate(pdf.tf.to_numpy()).astype(float)
                    row = np.repeat(np.arange(len(pdf)), held)
                    dl = np.maximum(pdf.dl.to_numpy(), 1)[row]
                    sat = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
                    width = first[term + 1] - first[term]
                    entry = np.repeat(first[term] - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
                    cell = np.repeat(row, width) * len(ids) + query[entry]
                    scores = np.bincount(cell, np.repeat(sat, width) * weight[entry], len(pdf) * len(ids)).reshape(len(pdf), len(ids))
                    hit = scores > 0
                    if marks:
                        alike = np.zeros_like(hit)
                        for i, (value, there) in enumerate(marks):
                            alike |= (pdf[f"_a{i}"].to_numpy(np.int64)[:, None] == value) & pdf[f"_n{i}"].to_numpy(bool)[:, None] & there
                        hit &= alike
                    docs = pdf.doc_id.to_numpy()
                    if skip_self:
                        hit &= docs[:, None] != ids
                    best.add(np.where(hit, scores, -np.inf), docs)
            q_at, s, d = best.settle()
            yield pd.DataFrame({"query_id": ids[q_at], "doc_id": d, "score": s})

        q_type = queries.schema["query_id"].dataType.simpleString()
        return top_ranked(short.mapInPandas(score, f"query_id {q_type}, doc_id {id_type}, score double"), limit)

    def _joined(self, q: DataFrame, limit: int, skip_self: bool) -> DataFrame:
        """The same by a join on terms, for query sets too large to be sent."""
        stats = self.rows.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl")).first()
        marks = [x for i in range(len(self.alike)) for x in (f"_a{i}", f"_n{i}")]
        words = self.rows.select("doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"), *marks)
        own = materialize(words.join(q.select("term").distinct(), "term", "left_semi").groupBy("doc_id", "dl", "term", *marks).agg(F.count("*").alias("tf")), "postings")
        df = F.col("df").cast("double")
        idf = F.log(1 + (stats.n - df + 0.5) / (df + 0.5))
        weighted = q.join(own.groupBy("term").agg(F.count("*").alias("df")), "term").withColumn("w", F.col("qtf") * idf)
        sat = F.col("tf") * (self.k1 + 1) / (F.col("tf") + self.k1 * (1 - self.b + self.b * F.greatest("dl", F.lit(1)).cast("double") / (stats.avgdl or 1.0)))
        hits = weighted.join(own.withColumn("sat", sat), "term")
        if self.alike:
            same = [(F.xxhash64(c) == F.col(f"_a{i}")) & F.col(f"_n{i}") & F.col(c).isNotNull() for i, c in enumerate(self.alike)]
            hits = hits.where(functools.reduce(lambda a, c: a | c, same))
        if skip_self:
            hits = hits.where("query_id <> doc_id")
        scored = hits.groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("sat")).alias("score")).where("score > 0")
        return top_ranked(scored, limit)


def top_ranked(scored: DataFrame, limit: int) -> DataFrame:
    """The best rows of each query, ranked from 1; scores to nine digits, ties by doc_id."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit)


def token_slot(token: str, dimensions: int) -> tuple[int, float]:
    """Slot and sign of a token: an eight-byte BLAKE2b digest, its remainder and its ninth bit."""
    x = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")
    return x % dimensions, 1.0 if x >> 8 & 1 else -1.0


def hash_vectors(documents: DataFrame, id_col: str, tokens: Column, dimensions: int = 384) -> DataFrame:
    """doc_id, embedding: unit-length vectors of signed token counts, null if the vector is zero. Each row is computed by itself:
    nothing is shuffled."""
    rows = spread(documents).select(F.col(id_col).alias("doc_id"), tokens.alias("tokens"))

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[int, float]] = {}
        for pdf in batches:
            if len(known) > 500_000:
                known.clear()
            vectors = []
            for words in pdf.tokens:
                v = np.zeros(dimensions)
                for w in words if words is not None else ():
                    if (at := known.get(w)) is None:
                        at = known[w] = token_slot(w, dimensions)
                    v[at[0]] += at[1]
                norm = np.sqrt((v * v).sum())
                vectors.append(v / norm if norm else None)
            yield pd.DataFrame({"doc_id": pdf.doc_id, "embedding": vectors})

    return rows.mapInPandas(embed, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, embedding array<double>")


def hash_embeddings(documents: DataFrame, id_col: str, tokens: Column, dimensions: int = 384) -> DataFrame:
    """doc_id, slot, value: the entries of ``hash_vectors`` that are not zero."""
    slots = hash_vectors(documents, id_col, tokens, dimensions).select("doc_id", F.posexplode("embedding").alias("slot", "value"))
    return slots.where("value <> 0")


def dense_search(queries: DataFrame, vectors: DataFrame, limit: int = 50, block: int = 8192, floor: float = 0.0) -> DataFrame:
    """query_id, doc_id, score, rank: exact inner products of ``queries`` (query_id, embedding) with all ``vectors``
    (doc_id, embedding). The stated query set travels to the vectors in blocks of at most ``block`` queries; each task keeps only
    its own best ``limit`` for each query over all its batches, so what is shuffled is bounded by partitions x queries x limit.
    Null vectors are no hits."""
    spark = vectors.sparkSession
    queries = queries.where("embedding is not null")
    total = queries.count()
    parts = [queries] if total <= block else [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(-(-total * 5 // (4 * block)))) == i) for i in range(-(-total * 5 // (4 * block)))]
    types = vectors.schema["doc_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    out = None
    for part in parts:
        rows = part.select("query_id", "embedding").collect()
        asked = spark.sparkContext.broadcast((np.array([r.query_id for r in rows]), np.array([r.embedding for r in rows], np.float64)))

        def best(batches: Iterator[pd.DataFrame], asked=asked) -> Iterator[pd.DataFrame]:
            ids, matrix = asked.value
            if not len(ids):
                return
            top = _Best(len(ids), limit)
            step = max(1, _BLOCK // len(ids))
            for whole in batches:
                for x in range(0, len(whole), step):
                    pdf = whole.iloc[x : x + step]
                    s = np.stack(pdf.embedding.to_numpy()).astype(np.float64) @ matrix.T
                    top.add(np.where(s > floor, s, -np.inf), pdf.doc_id.to_numpy())
            q, s, d = top.settle()
            yield pd.DataFrame({"query_id": ids[q], "doc_id": d, "score": s})

        one = vectors.where("embedding is not null").select("doc_id", "embedding").mapInPandas(best, f"query_id {types[1]}, doc_id {types[0]}, score double")
        out = one if out is None else out.unionByName(one)
    return top_ranked(out, limit)


def reciprocal_rank_fusion(lists: dict[str, DataFrame], limit: int = 50, k: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """query_id, doc_id, score, rank and component_ranks (list name to rank) of ranked lists (query_id, doc_id, rank).
    Equal scores keep the order of the lists' own ranks, the first list first."""
    weights = weights or {}
    union = None
    for name, df in lists.items():
        one = df.select("query_id", "doc_id", F.col("rank").cast("int").alias("r"), F.lit(name).alias("source"), F.lit(float(weights.get(name, 1.0))).alias("weight"))
        union = one if union is None else union.unionByName(one)
    order = [F.max(F.when(F.col("source") == name, F.col("r"))).alias(f"_r{i}") for i, name in enumerate(lists)]
    fused = union.groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") / (k + F.col("r"))).alias("score"), F.map_from_entries(F.collect_list(F.struct("source", "r"))).alias("component_ranks"), *order)
    ties = [F.col(f"_r{i}").asc_nulls_last() for i in range(len(lists))]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), *ties, "doc_id"))
    return fused.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "doc_id", "score", "rank", "component_ranks")


def missing_vectors(wanted: DataFrame, stored: DataFrame, dimensions: int | None = None) -> DataFrame:
    """Chunks whose stable id is not stored yet; raises if stored vectors have another dimension."""
    if dimensions is not None and stored.where(F.size("embedding") != dimensions).limit(1).count():
        raise ValueError("stored vectors have another dimension; build the collection anew")
    return wanted.withColumn("point_id", stable_id(F.col("chunk_id"))).join(stored.select("point_id"), "point_id", "left_anti")


def unified_search(documents: DataFrame, queries: DataFrame, id_col: str, title_col: str, text_col: str, limit: int = 30, candidates: int = 80) -> DataFrame:
    """BM25 and hashed embeddings over the same tokens, fused. ``queries`` has query_id and query_text."""
    tokens = retrieval_tokens(F.concat_ws(" ", F.coalesce(F.col(title_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))))
    asked = queries.select("query_id", retrieval_tokens(F.col("query_text")).alias("tokens"))
    words = Bm25Index(documents, id_col, tokens).search(asked, candidates)
    q_vec = hash_vectors(queries.select(F.col("query_id").alias("_q"), "query_text"), "_q", retrieval_tokens(F.col("query_text"))).withColumnRenamed("doc_id", "query_id")
    vectors = dense_search(q_vec, hash_vectors(documents, id_col, tokens), candidates)
    return reciprocal_rank_fusion({"bm25": words, "dense": vectors}, limit)
