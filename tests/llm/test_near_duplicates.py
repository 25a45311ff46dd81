import random

import numpy as np
from pyspark.sql import functions as F

from lawloom.llm import near_duplicates
from lawloom.llm.near_duplicates import near_duplicate_classes, near_duplicate_groups, normalized_text


def grams(t, w=5):
    return {t[i : i + w] for i in range(len(t) - w + 1)}


def brute(texts, threshold, w=5):
    sets = {t: grams(t, w) for t in set(texts)}
    keys = sorted(sets)
    out = set()
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            u = len(sets[a] | sets[b])
            if u and len(sets[a] & sets[b]) / u >= threshold:
                out.add(frozenset((a, b)))
    return out


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("가나다라마바사아자차카타파하거너더러머버") for _ in range(rng.randint(2, 5))) for _ in range(400)]
    texts = []
    for _ in range(n // 4):
        base = [rng.choice(words) for _ in range(rng.choice([6, 20, 60, 150, 400]))]
        texts.append("".join(base))
        for _ in range(3):
            other = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 8))):
                k = rng.randrange(len(other))
                other[k : k + rng.randint(0, 2)] = [rng.choice(words) for _ in range(rng.randint(0, 2))]
            texts.append("".join(other))
    return texts


def classes(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string").repartition(3)
    members, links = near_duplicate_classes(df, "id", F.col("t"), **kw)
    ids = {}
    for r in members.collect():
        ids.setdefault(r.class_id, set()).add(r.record_id)
    got = {frozenset((texts[min(ids[r.class_a])], texts[min(ids[r.class_b])])) for r in links.collect()}
    return ids, got, members, links


def test_against_brute_force(spark):
    texts = corpus()
    texts += texts[:10]  # exact copies
    ids, got, members, links = classes(spark, texts)
    assert got == brute(texts, 0.7)
    assert sum(len(v) for v in ids.values()) == len(texts) and sum(len(v) > 1 for v in ids.values()) >= 10


def test_higher_threshold_and_small_texts(spark):
    texts = corpus(60, 2) + ["가나다라마", "가나다라마바", "abcdefghij", "abcdefghijk", "abcde", "aaaaaa", "aaaaaaa"]
    assert classes(spark, texts, threshold=0.8)[1] == brute(texts, 0.8)


def test_groups(spark):
    base = "".join(random.Random(5).choice("가나다라마바사아자차카타파하") for _ in range(300))
    chain = [base[:250] + base[250:][:0], base[:260], base[:270], "전혀 다른 글" * 20, base[:260], None, ""]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(chain)], "id bigint, t string, class_id string")
    members, links = near_duplicate_classes(df, "id", F.col("t"), threshold=0.955)
    got = {r.record_id: r for r in near_duplicate_groups(members, links).collect()}
    assert 5 not in got and len({got[i].group_id for i in (0, 1, 2, 4)}) == 1 and got[3].group_id != got[0].group_id
    assert got[1].n_links == 2 and got[1].class_id == got[4].class_id and got[3].n_links == 0 and got[6].n_links == 0


def test_hot_copies_and_empty(spark):
    texts = ["같은 글이 아주 많이 되풀이된다 " * 10] * 500 + ["다른 글 하나가 여기에 있다 " * 10]
    ids, got, members, links = classes(spark, texts)
    assert sorted(map(len, ids.values())) == [1, 500] and links.count() == 0
    members, links = near_duplicate_classes(spark.createDataFrame([], "id bigint, t string"), "id", F.col("t"))
    assert members.count() == 0 and links.count() == 0


def test_long_text(spark):
    rng = random.Random(7)
    long = "".join(rng.choice("가나다라마바사아자차카타파하거너더러") for _ in range(100_000))
    assert len(classes(spark, [long, long[:95_000], long[:50_000]])[1]) == 1


def test_normal_form(spark):
    r = spark.createDataFrame([(" A　b\n", None)], "title string, content_text string").select(normalized_text("title", "content_text").alias("t")).first()
    assert r.t == "ab"


def test_query_against_brute_force(spark, root):
    import __spark_entry__ as e

    rows = spark.read.parquet(f"{root}/articles.parquet").select("id", "title", "content_text").where("length(content_text) >= 200").collect()
    sets = {r.id: grams("".join(f"{r.title or ''} {r.content_text}".split()).lower()) for r in rows}
    ids = sorted(sets)
    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    got = [(r.article_id_a, r.article_id_b) for r in e.queries()["p5_found"](spark, root).collect()]
    assert sorted(got) == sorted(want)


def test_no_pair_is_left_to_chance(spark):
    texts = corpus(160, 3)
    want = brute(texts, 0.35)
    assert len(want) > 200 and classes(spark, texts, threshold=0.35)[1] == want


def test_divided_buckets(spark):
    texts = corpus(120, 4)
    for threshold in (0.7, 0.5):
        assert classes(spark, texts, threshold=threshold, records_per_bucket=25)[1] == brute(texts, threshold)


def test_bucket_pairs_are_complete_and_use_deletions():
    """All pairs similar within a part are found, by equal segments and by segments with one shingle less."""
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        base = rng.choice(3000, int(rng.choice([3, 8, 30, 80])), replace=False)
        for _ in range(3):
            kept = base[rng.random(len(base)) > rng.choice([0.0, 0.05, 0.12])]
            sets.append(np.unique(np.concatenate([kept, rng.choice(3000, int(rng.integers(0, 1 + len(base) // 8)))])).astype("<u2"))
    sets = sorted((x for x in sets if len(x)), key=len)
    size = np.array([len(x) for x in sets])
    spent = {}
    got = {(int(a), int(b)) for p in near_duplicates._bucket_pairs(size, size, size, np.concatenate(sets), 0.7, spent) for a, b in zip(*p)}
    lists = [set(x.tolist()) for x in sets]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(lists[i] & lists[j]) >= 0.7 * len(lists[i] | lists[j])}
    assert want <= got and len(want) > 60 and spent["one"] > 0 and spent["two"] > 0


def test_groups_of_every_article(spark, tmp_path):
    from lawloom.llm.near_duplicates import p5_groups

    rows = [(1, "같은 제목", "짧은 글 하나"), (2, "같은 제목", "짧은 글 하나"), (3, None, None), (4, " ", ""), (5, "제목만 있는 글", None)]
    spark.createDataFrame(rows, "id bigint, title string, content_text string").write.parquet(f"{tmp_path}/articles.parquet")
    got = {r.record_id: r for r in p5_groups(spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5] and got[1].group_id == got[2].group_id and len({r.group_id for r in got.values()}) == 4


def test_what_is_shuffled_does_not_grow_with_divided_buckets(spark):
    """Each shingle is written once, however many tasks share a bucket; groups of segments find the same pairs."""
    store, scheduler = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().dagScheduler()
    texts = corpus(200, 6)
    want = brute(texts, 0.7)
    sent = {}
    for kw in ({}, {"records_per_bucket": 40}, {"at_once": 500}, {"records_per_bucket": 60, "at_once": 300}):
        first = int(str(scheduler.nextStageId()))
        assert classes(spark, texts, **kw)[1] == want
        total = 0
        for stage in range(first, int(str(scheduler.nextStageId()))):
            try:
                total += store.lastStageAttempt(stage).shuffleWriteBytes()
            except Exception:  # a skipped stage
                continue
        sent[str(kw)] = total
    assert max(sent.values()) < 1.5 * sent["{}"], sent
