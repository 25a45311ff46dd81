from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lawloom.llm.mixing import feasible_total, mix_sources, split_tree
from lawloom.llm.packing import pack_texts, plan_containers
from lawloom.llm.tokens import TOKENIZER_DIR, encoding


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), max_size=25))
def test_plan_uses_every_item_once(counts):
    used: Counter = Counter()
    for lengths, times in plan_containers(counts, 60):
        assert sum(lengths) <= 60 and times > 0
        for length in lengths:
            used[length] += times
    assert used == Counter(counts)


def test_exact_fills_are_found():
    plan = plan_containers({60: 10, 40: 10}, 100)
    assert plan == [((60, 40), 10)]
    assert sum(t for _, t in plan_containers({50: 4, 30: 4, 20: 4}, 100)) == 4
    assert plan_containers({}, 10) == []


def test_nearly_no_room_is_left():
    rng = np.random.default_rng(1)
    counts = Counter(int(x) for x in np.clip(rng.lognormal(4.5, 0.8, 5000), 1, 512))
    total = sum(k * v for k, v in counts.items())
    n = sum(t for _, t in plan_containers(dict(counts), 512))
    assert n <= -(-total // 512) + 1


def rows(spark):
    data = [(i, "word " * (3 + i % 40), "s") for i in range(300)] + [(900, "word " * 500, "s"), (901, None, "s"), (902, "", "s"), (7, "again a word", "s")]
    return spark.createDataFrame(data, "doc_id bigint, text string, container_id string").repartition(5)


def test_pack(spark):
    got = pack_texts(rows(spark), {1: 64, 2: 100}).toPandas()
    got["n"] = got.token_end - got.token_start
    for plan, cap in ((1, 64), (2, 100)):
        g = got[got.plan_id == plan]
        assert g.groupby("container_id").n.sum().max() <= cap
        assert (g.groupby("doc_id").n.sum() > 0).sum() == 301 and {901, 902} <= set(g.doc_id)
        big = g[g.doc_id == 900].sort_values("piece_no")
        assert list(big.token_start)[1:] == list(big.token_end)[:-1] and (big.n.iloc[:-1] == cap).all()
        total = encoding(f"{TOKENIZER_DIR}/byte_bpe_multi_50k.tiktoken").encode_ordinary("word " * 500)
        assert big.n.sum() == len(total)
        assert not g.duplicated(["doc_id", "piece_no", "container_id"]).any()
        # only a text beyond the capacity is divided
        assert set(g[g.piece_no > 0].doc_id) == {900}
        assert g.container_id.max() + 1 <= -(-g.n.sum() // cap) + 2
    assert pack_texts(rows(spark).where("false"), {1: 64}).count() == 0
    with pytest.raises(ValueError):
        pack_texts(rows(spark), {1: 0})


def test_split_tree():
    counts = np.array([100, 7, 0, 33])
    for leaves in (1, 2, 5, 8):
        m = split_tree(counts, leaves, 3)
        assert (m.sum(axis=0) == counts).all() and (m >= 0).all() and m.sum(axis=1).max() - m.sum(axis=1).min() <= leaves
    assert (split_tree(counts, 5, 3) == split_tree(counts, 5, 3)).all()


def test_feasible_total():
    assert feasible_total({"a": 100, "b": 10}, {"a": (0.5, 2), "b": (0.5, 3)}) == 60
    assert feasible_total({"a": 100}, {"a": (0.5, 2), "gone": (0.5, 3)}) == 200
    assert feasible_total({}, {"a": (1.0, 1)}) == 0


def test_mix(spark):
    data = [(i, "some words here " * (1 + i % 5), "big" if i % 10 else "small") for i in range(2000)] + [(5000, "x y", None), (5001, "x y", "unlisted"), (5002, None, "big"), (5003, "", "small")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    df = df.selectExpr("*", "'x' as shard")
    targets = {"big": (0.6, 2), "small": (0.4, 3), "absent": (0.2, 2)}
    got = mix_sources(df, targets, shard_tokens=900, block_tokens=40).toPandas()
    share = got.groupby("source").n_tokens.sum() / got.n_tokens.sum()
    assert abs(share["big"] - 0.6) < 0.005 and abs(share["small"] - 0.4) < 0.005
    assert got.groupby("doc_id").size().max() <= 3 and not got.duplicated(["doc_id", "copy_no"]).any()
    assert (got[got.source == "small"].groupby("doc_id").size() == 3).all()  # the binding source is used up
    assert got.shard.nunique() > 3 and (got.groupby("shard").position.max() + 1 == got.groupby("shard").size()).all()
    per = got.groupby(["shard", "source"]).n_tokens.sum().unstack(fill_value=0)
    assert ((per["small"] / per.sum(axis=1) - 0.4).abs() < 0.25).all()
    assert not {5000, 5001, 5002, 5003} & set(got.doc_id)
    assert mix_sources(df.where("false"), targets).count() == 0


def test_two_storeys(spark):
    """More shards than the driver deals: the groups are dealt on, nothing is lost and shards keep size and shares."""
    data = [(i, "some words here " * (1 + i % 5), "big" if i % 10 else "small") for i in range(2000)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    targets = {"big": (0.6, 2), "small": (0.4, 3)}
    one = mix_sources(df, targets, shard_tokens=900, block_tokens=40).toPandas()
    two = mix_sources(df, targets, shard_tokens=900, block_tokens=40, max_groups=2).toPandas()
    assert sorted(zip(one.doc_id, one.copy_no)) == sorted(zip(two.doc_id, two.copy_no)) and abs(two.shard.nunique() - one.shard.nunique()) <= 1
    per = two.groupby("shard").n_tokens.sum()
    assert per.max() < 2 * 900 and (two.groupby("shard").position.max() + 1 == two.groupby("shard").size()).all()
    share = two[two.source == "small"].groupby("shard").n_tokens.sum() / per
    assert ((share - 0.4).abs() < 0.25).all()


def test_queries(spark, root):
    import __spark_entry__ as e

    fill = {r.plan_id: r for r in e.queries()["p6_fill"](spark, root).collect()}
    assert set(fill) == {1, 2, 3} and all(r.containers <= r.least_containers + 1 for r in fill.values())
    shares = e.queries()["p7_shares"](spark, root).collect()
    assert len(shares) == 12 and all(r.most_copies <= r.max_repeats for r in shares)


def test_triple_behind_many_large_lengths():
    from lawloom.llm.packing import plan_containers

    counts = {2000: 1, 400: 1, 350: 1, 250: 1} | {n: 1 for n in range(801, 1000, 2)}
    plan = plan_containers(counts, 3000)
    assert ((2000, 400, 350, 250), 1) in plan
    assert sum(times * lengths.count(n) for lengths, times in plan for n in counts) == len(counts)
