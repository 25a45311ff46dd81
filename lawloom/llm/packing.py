"""Filling containers of fixed capacity with texts (problem 6).

Which lengths share a container is planned on the histogram of lengths, which has at most ``capacity`` entries whatever
the number of texts: exact-complement hashing indexes the lengths and their pair sums, so that a gap is closed exactly by
one, two or three available lengths; a combination is consumed as often as its lengths last; what cannot be
closed exactly takes the best fit. Texts then find their places by their rank within their length: ranks are
counted within input partitions and offset by the counts of earlier ones, so a length that a third of all texts
share is never gathered in one task, and no text is moved at all.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lawloom.llm.tokens import token_counts
from lawloom.session import materialize


class _Stock:
    """Counts by length, the distinct lengths present, and the search for exact complements."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] += n
        self._indexed = -1

    def _sums(self, have: np.ndarray) -> np.ndarray:
        """Whether two lengths that were in stock when the index was made add up to a total. Lengths only run out, so no sum
        is missing; the index is made anew when a quarter of them has run out."""
        if self._indexed < 0 or len(have) * 4 < self._indexed * 3:
            self._indexed, size = len(have), len(self.left)
            present = self.left > 0
            self._pair_sums = np.zeros(size, bool)
            for a in have:
                self._pair_sums[a:] |= present[: size - a]
        return self._pair_sums

    def lengths(self) -> np.ndarray:
        return np.flatnonzero(self.left)

    def largest(self, gap: int) -> int:
        """The largest available length that fits, 0 if none does."""
        at = np.flatnonzero(self.left[1 : gap + 1])
        return int(at[-1]) + 1 if len(at) else 0

    def complement(self, gap: int, used: Counter) -> tuple[int, ...] | None:
        """One, two or three available lengths whose sum is ``gap``, the largest first; ``used`` are taken already."""
        left = self.left.copy() if used else self.left
        for length, n in used.items():
            left[length] -= n
        if left[gap] > 0:
            return (gap,)
        have = np.flatnonzero(left[: gap + 1] > 0)
        if len(have) == 0:
            return None

        def pair(total: int, taken: int = 0) -> tuple[int, int] | None:
            # index of present lengths: b = total - a is looked up for all a at once
            a = have[(have * 2 >= total) & (have < total)]
            b = total - a
            ok = (left[b] - (b == taken) > (a == b)) & (left[a] - (a == taken) > 0)
            hit = np.flatnonzero(ok)
            return (int(a[hit[-1]]), int(b[hit[-1]])) if len(hit) else None

        if two := pair(gap):
            return two
        largest = have[(have * 3 >= gap) & (have < gap - 1)]
        for a in largest[self._sums(self.lengths())[gap - largest]][::-1]:
            if two := pair(gap - int(a), int(a)):
                if two[0] <= a:
                    return (int(a), *two)
        return None


def plan_containers(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how many containers hold just these lengths) for a histogram of lengths from 1 to ``capacity``."""
    stock = _Stock(counts, capacity)
    out: list[tuple[tuple[int, ...], int]] = []
    while (first := stock.largest(capacity)) > 0:
        held = Counter([first])
        gap = capacity - first
        while gap > 0:
            fill = stock.complement(gap, held)
            if fill is not None:
                held.update(fill)
                break
            left = stock.left.copy()
            for length, n in held.items():
                left[length] -= n
            fits = np.flatnonzero(left[1 : gap + 1] > 0) + 1
            if len(fits) == 0:
                break
            best = int(fits[-1])  # no exact complement: the best fit for now
            held[best] += 1
            gap -= best
        times = min(int(stock.left[length]) // n for length, n in held.items())
        for length, n in held.items():
            stock.left[length] -= n * times
        out.append((tuple(sorted(held.elements(), reverse=True)), times))
    return out


def pack_texts(documents: DataFrame, plans: dict[int, int], id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """plan_id, container_id (from 0 in each plan), doc_id, piece_no, token_start, token_end: every text once for each
    plan (id to capacity in tokens), divided only if it alone exceeds the capacity: then into pieces that fill whole
    containers, and a rest that is packed like a text.

    Null and empty texts take no room; they have the piece (0, 0) in container 0. Repeated ids are packed each for itself;
    extra columns are ignored; an empty table gives no rows. Capacities below 1 raise ValueError.
    """
    if min(plans.values(), default=1) < 1:
        raise ValueError("capacities must be at least 1")
    sizes = token_counts(documents, id_col, text_col, path=tokenizer)
    plan_list = sorted(plans.items())

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = {p: np.zeros(c + 1, np.int64) for p, c in plan_list}
        for pdf in batches:
            n = pdf.n_tokens.to_numpy()
            for p, c in plan_list:
                full = np.where(n > c, n // c, 0)
                rest = n - full * c
                keep = (rest > 0) | (n == 0)
                # rank of each length within this partition so far
                length = rest[keep]
                order = np.argsort(length, kind="stable")
                s = length[order]
                start = np.searchsorted(s, s, "left")
                rank = np.empty(len(s), np.int64)
                rank[order] = np.arange(len(s)) - start
                rank += seen[p][length]
                np.add.at(seen[p], length, 1)
                whole = np.repeat(np.arange(len(n)), full)
                number = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
                rank_whole = seen[p][c] + np.arange(len(whole))
                seen[p][c] += len(whole)
                yield pd.DataFrame(
                    {
                        "plan_id": p, "part": pdf.part.iloc[0] if len(pdf) else 0,
                        "doc_id": np.concatenate([pdf.item_id.to_numpy()[keep], pdf.item_id.to_numpy()[whole]]),
                        "piece_no": np.concatenate([full[keep], number]), "token_start": np.concatenate([full[keep] * c, number * c]),
                        "length": np.concatenate([length, np.full(len(whole), c)]), "rank": np.concatenate([rank, rank_whole]),
                    }
                )

    schema = "plan_id int, part int, doc_id bigint, piece_no int, token_start bigint, length int, rank bigint"
    items = materialize(sizes.withColumn("part", F.spark_partition_id()).mapInPandas(ranked, schema), "items")
    counts = items.where("length > 0").groupBy("plan_id", "part", "length").count()
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("plan_id", "length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("plan_id", "part", "length", F.coalesce("before", F.lit(0).cast("bigint")).alias("before"))

    # the histogram: at most capacity rows for each plan
    places: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    histogram: dict[int, dict[int, int]] = {p: {} for p, _ in plan_list}
    for r in counts.groupBy("plan_id", "length").agg(F.sum("count").alias("n")).collect():
        histogram[r.plan_id][r.length] = r.n
    for p, c in plan_list:
        base = 0
        filled: Counter = Counter()
        for lengths, times in plan_containers(histogram[p], c):
            for length, each in Counter(lengths).items():
                places.setdefault((p, length), []).append((filled[length], each, base))
                filled[length] += each * times
            base += times
    table = {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in places.items()}
    shared = documents.sparkSession.sparkContext.broadcast(table)  # bounded by the patterns, those by the capacity

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for pdf in batches:
            container = np.zeros(len(pdf), np.int64)
            rank = (pdf["rank"] + pdf["before"].fillna(0)).to_numpy(np.int64)
            for (p, length), at in pdf.groupby(["plan_id", "length"]).indices.items():
                if length == 0:
                    continue
                start, each, base = known[p, length]
                run = np.searchsorted(start, rank[at], "right") - 1
                container[at] = base[run] + (rank[at] - start[run]) // each[run]
            yield pd.DataFrame(
                {"plan_id": pdf.plan_id, "container_id": container, "doc_id": pdf.doc_id, "piece_no": pdf.piece_no, "token_start": pdf.token_start, "token_end": pdf.token_start + pdf.length}
            )

    joined = items.join(before, ["plan_id", "part", "length"], "left")
    return joined.mapInPandas(place, "plan_id int, container_id bigint, doc_id bigint, piece_no int, token_start bigint, token_end bigint")


def _plans(spark, root: str) -> dict[int, int]:
    # a table of parameters, one row per plan
    return {r.plan_id: r.capacity_tokens for r in spark.read.parquet(f"{root}/pack_limits.parquet").collect()}


def p6_packing(spark, root: str) -> DataFrame:
    return pack_texts(spark.read.parquet(f"{root}/documents.parquet"), _plans(spark, root))


def p6_fill(spark, root: str) -> DataFrame:
    """plan_id, capacity, containers, tokens, least_containers (tokens over capacity, rounded up) and unused_share."""
    plans = _plans(spark, root)
    capacity = F.create_map(*[F.lit(x) for kv in plans.items() for x in kv])
    per = p6_packing(spark, root).groupBy("plan_id").agg((F.max("container_id") + 1).alias("containers"), F.sum(F.col("token_end") - F.col("token_start")).alias("tokens"))
    per = per.withColumn("capacity", capacity[F.col("plan_id")])
    return per.select(
        "plan_id", "capacity", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"),
        (1 - F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("unused_share"),
    )
