"""Mixing sources to target shares of the tokens (problem 7).

Texts of a source fall into blocks by a hash; a source's quota is a number of block draws: whole passes over its blocks
and a last partial one, each pass in its own permutation. A multivariate-hypergeometric splitting tree deals the draws
of all sources to the output shards: each node splits its counts among its two halves exactly, so that every shard is
a fair sample of the whole mixture and no draw is dealt twice. Within a shard the texts are shuffled by a hash.

The tree has two storeys. The driver deals at most ``max_blocks`` blocks of a source (they grow with it) to at most
``max_groups`` groups of shards, so its plan is bounded. Where a group is more than a shard, it is dealt on by the same tree
among its shards, each group by itself in a task, in blocks of ``block_tokens`` again: shards have the wanted number of
tokens whatever the size of the sources. The texts' rows are joined with the plan and sorted once, by shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lawloom.llm.tokens import token_counts
from lawloom.session import materialize


def split_tree(counts: np.ndarray, leaves: int, seed: int) -> np.ndarray:
    """Deal ``counts`` (draws of each source) to ``leaves`` shards: a matrix leaves x sources whose columns sum to
    ``counts`` and whose rows have sizes as equal as can be. Each node's split is multivariate hypergeometric."""
    out = np.zeros((leaves, len(counts)), np.int64)
    todo = [(0, leaves, np.asarray(counts, np.int64))]
    while todo:
        lo, hi, have = todo.pop()
        if hi - lo == 1:
            out[lo] = have
            continue
        mid = (lo + hi) // 2
        total = int(have.sum())
        draws = total * (mid - lo) // (hi - lo)
        rng = np.random.default_rng((seed, lo, hi))
        method = "marginals" if total < 10**9 else "count"
        left = rng.multivariate_hypergeometric(have, draws, method=method) if total else have.copy()
        todo += [(lo, mid, left), (mid, hi, have - left)]
    return out


def feasible_total(tokens: dict[str, int], targets: dict[str, tuple[float, int]]) -> float:
    """The largest mixture in which every source meets its share without passing its cap of repeats. Sources without
    tokens or share do not bind: they are left out."""
    live = {s: (share, cap) for s, (share, cap) in targets.items() if share > 0 and tokens.get(s, 0) > 0 and cap > 0}
    whole = sum(share for share, _ in live.values())
    return min((cap * tokens[s] * whole / share for s, (share, cap) in live.items()), default=0.0)


def _counted(documents: DataFrame, names: list[str], id_col: str, text_col: str, source_col: str, seed: int, max_blocks: int, tokenizer: str | None) -> DataFrame:
    rows = documents.where(F.col(source_col).isin(names))
    sized = token_counts(rows.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.col(source_col).alias("source")), "_id", "_t", ("source",), tokenizer)
    return materialize(sized.where("n_tokens > 0").withColumn("block", F.pmod(F.xxhash64("item_id", F.lit(seed)), F.lit(max_blocks)).cast("int")), "sizes")


def mix_sources(
    documents: DataFrame, targets: dict[str, tuple[float, int]], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard_tokens: int = 250_000,
    max_blocks: int = 20_000, block_tokens: int = 2_000, max_groups: int = 2_000, seed: int = 7, tokenizer: str | None = None,
) -> DataFrame:
    """shard, position (from 0 in its shard), doc_id, source, copy_no (from 0), n_tokens: the largest mixture in which each
    source supplies its target share of the tokens and no text is used more than its source's max_repeats times.

    ``targets``: source to (share, max_repeats); shares need not sum to 1. Texts of other or null sources, null and
    empty texts are not in the mixture. A source with a share but no tokens is left out, the others keep their
    proportions. Repeated ids are texts of their own; extra columns are ignored; an empty table gives no rows. Shares
    are met to within one text of each source.
    """
    sized = _counted(documents, sorted(targets), id_col, text_col, source_col, seed, max_blocks, tokenizer)
    per_block: dict[str, dict[int, int]] = {}
    for r in sized.groupBy("source", "block").agg(F.sum("n_tokens").alias("n")).collect():  # at most sources x max_blocks rows
        per_block.setdefault(r.source, {})[r.block] = r.n
    tokens = {s: sum(b.values()) for s, b in per_block.items()}
    total = feasible_total(tokens, targets)
    whole = sum(targets[s][0] for s in tokens if targets[s][0] > 0 and targets[s][1] > 0)
    spark = documents.sparkSession

    # group the hash classes of a source into blocks of about block_tokens, then plan its draws
    rng = np.random.default_rng(seed)
    plan, cuts, order = [], [], []
    for s in sorted(tokens):
        share, cap = targets[s]
        quota = total * share / whole if share > 0 and cap > 0 and total else 0
        if quota <= 0:
            continue
        classes = np.array(sorted(per_block[s]))
        size = np.array([per_block[s][k] for k in classes], np.int64)
        blocks = int(np.clip(tokens[s] // block_tokens, 1, len(classes)))
        of_class = np.arange(len(classes)) * blocks // len(classes)
        block_size = np.bincount(of_class, size, blocks)
        draw, left, copy = 0, quota, 0
        while left > 0.5 and copy < cap:
            perm = rng.permutation(blocks)
            run = np.cumsum(block_size[perm])
            taken = blocks if run[-1] <= left + 0.5 else int(np.searchsorted(run, left, "right")) + 1
            place = np.empty(blocks, np.int64)
            place[perm] = np.arange(blocks)
            inside = place[of_class] < taken
            plan += [(s, int(k), copy, int(draw + place[b])) for k, b in zip(classes[inside], of_class[inside])]
            if taken < blocks or run[-1] > left + 0.5:
                last = perm[taken - 1]  # of the last block only as many texts as the quota still has room for
                cuts += [(s, int(k), copy, float(left - (run[taken - 2] if taken > 1 else 0))) for k in classes[of_class == last]]
                left = 0
            else:
                left -= run[-1]
            draw += taken
            copy += 1
        order.append((s, draw))
    if not plan:
        return spark.createDataFrame([], "shard int, position bigint, doc_id bigint, source string, copy_no int, n_tokens bigint")
    shards = max(1, round(total / shard_tokens))
    groups = min(shards, max_groups)
    dealt = split_tree(np.array([d for _, d in order]), groups, seed)
    ends = {s: np.cumsum(dealt[:, i]) for i, (s, _) in enumerate(order)}
    rows = [(s, k, copy, int(np.searchsorted(ends[s], draw, "right"))) for s, k, copy, draw in plan]
    dealt_df = spark.createDataFrame(rows, "source string, block int, copy_no int, shard int")
    limit = spark.createDataFrame(cuts, "source string, block int, copy_no int, room double")

    drawn = sized.join(dealt_df, ["source", "block"])
    key = ["source", "block", "copy_no"]
    kept = drawn.join(limit, key, "left_anti").select("shard", "item_id", "source", "copy_no", "n_tokens")
    # the last blocks, one for each source at most: texts in hash order while they fit, each to the nearest
    by = Window.partitionBy("source", "copy_no").orderBy(F.xxhash64("item_id", "copy_no"), "item_id").rowsBetween(Window.unboundedPreceding, 0)
    part = drawn.join(F.broadcast(limit), key).withColumn("run", F.sum("n_tokens").over(by)).where(F.col("run") - F.col("n_tokens") / 2 <= F.col("room"))
    mixed = kept.unionByName(part.select("shard", "item_id", "source", "copy_no", "n_tokens"))
    if shards > groups:
        mixed = _deal_groups(mixed, -(-shards // groups), block_tokens, seed)
    shuffled = Window.partitionBy("shard").orderBy(F.xxhash64("item_id", "copy_no", "shard"), "item_id", "copy_no")
    return mixed.select("shard", (F.row_number().over(shuffled) - 1).cast("bigint").alias("position"), F.col("item_id").alias("doc_id"), "source", "copy_no", "n_tokens")


def _deal_groups(mixed: DataFrame, each: int, block_tokens: int, seed: int) -> DataFrame:
    """The second storey: the texts of each group (column shard) dealt to ``each`` shards, in blocks by hash."""
    mixed = materialize(mixed, "groups")
    held = mixed.groupBy("shard", "source").agg(F.ceil(F.sum("n_tokens") / block_tokens).cast("int").alias("blocks"))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source")
        group = int(pdf.shard.iloc[0])
        leaves = split_tree(pdf.blocks.to_numpy(np.int64), each, seed * 1_000_003 + group)
        rng = np.random.default_rng((seed, group))
        out = []
        for i, (source, blocks) in enumerate(zip(pdf.source, pdf.blocks)):
            of = np.empty(blocks, np.int64)
            of[rng.permutation(blocks)] = np.repeat(np.arange(each), leaves[:, i])
            out.append(pd.DataFrame({"shard": group, "source": source, "part": np.arange(blocks), "leaf": of}))
        return pd.concat(out)

    plan = held.groupBy("shard").applyInPandas(deal, "shard int, source string, part int, leaf int")
    split = mixed.join(held, ["shard", "source"]).withColumn("part", F.pmod(F.xxhash64("item_id", "copy_no", F.lit(seed + 1)), F.col("blocks")).cast("int"))
    return split.join(plan, ["shard", "source", "part"]).select((F.col("shard") * each + F.col("leaf")).alias("shard"), "item_id", "source", "copy_no", "n_tokens")


def _targets(spark, root: str) -> dict[str, tuple[float, int]]:
    # a table of parameters, one row per source of the mixture
    return {r.source: (r.target_share, r.max_repeats) for r in spark.read.parquet(f"{root}/mix_targets.parquet").collect()}


def p7_mixture(spark, root: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{root}/documents.parquet"), _targets(spark, root))


def p7_shares(spark, root: str) -> DataFrame:
    """source, target_share, max_repeats, tokens in the mixture, actual_share and most_copies of a text."""
    got = p7_mixture(spark, root).groupBy("source").agg(F.sum("n_tokens").alias("tokens"), (F.max("copy_no") + 1).alias("most_copies"))
    got = got.withColumn("actual_share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy()))
    want = spark.read.parquet(f"{root}/mix_targets.parquet")
    return want.join(got, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("actual_share", F.lit(0.0)).alias("actual_share"), F.coalesce("most_copies", F.lit(0)).alias("most_copies")
    )
