import pandas as pd
import pytest

from lawloom.operators.timestamps import fit_cells, normalize_timestamps

SOURCES = [("kr", "Asia/Seoul", "ymd"), ("ny", "America/New_York", "mdy"), ("ldn", "Europe/London", "dmy")]
SCHEMA = "id bigint, source_system string, published_at string, first_seen_at string, effective_date string"


def run(spark, values, **kw):
    """values: (source, text) pairs; gives (norm_value, status) in order."""
    rows = [(i, s, v, None, None) for i, (s, v) in enumerate(values)]
    out = normalize_timestamps(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(SOURCES, "source_system string, zone_name string, date_order string"), **kw)
    got = {r.article_id: (r.norm_value, r.status) for r in out.collect()}
    return [got.get(i) for i in range(len(values))]


def test_writings(spark):
    cases = {
        ("kr", "2024-03-05"): "2024-03-05", ("kr", " 2024-3-5 "): "2024-03-05", ("kr", "2024. 3. 5."): "2024-03-05", ("kr", "２０２４．３．５"): "2024-03-05", ("kr", "2024‑03‑05"): "2024-03-05",
        ("kr", "'24.3.5."): "2024-03-05", ("kr", "2024년 3월 5일(화요일)"): "2024-03-05", ("kr", "2024年3月5日"): "2024-03-05", ("kr", "20240305"): "2024-03-05", ("kr", "5 Mar 2024"): "2024-03-05",
        ("kr", "March 5, 2024"): "2024-03-05", ("kr", "2024.03.05(화)"): "2024-03-05", ("kr", "2024-03-05 24:00"): "2024-03-05T15:00:00.000000Z", ("kr", "2024. 3. 5. 오전 12:05"): "2024-03-04T15:05:00.000000Z",
        ("kr", "2024. 3. 5. 오후 12:05"): "2024-03-05T03:05:00.000000Z", ("kr", "Mar 5, 2024 1:09 PM"): "2024-03-05T04:09:00.000000Z", ("kr", "2024. 03. 05 (화) 4시 41분"): "2024-03-04T19:41:00.000000Z",
        ("kr", "202403051530"): "2024-03-05T06:30:00.000000Z", ("kr", "20240305T153001Z"): "2024-03-05T15:30:01.000000Z", ("kr", "1709618400"): "2024-03-05T06:00:00.000000Z", ("kr", "1709618400123"): "2024-03-05T06:00:00.123000Z",
        ("kr", "2024-03-05T15:30:01.123456789+09:00"): "2024-03-05T06:30:01.123456Z", ("kr", "2024-03-05t15:30:01z"): "2024-03-05T15:30:01.000000Z", ("kr", "2024-03-05T15+0900"): "2024-03-05T06:00:00.000000Z",
        ("kr", "2024-03-05 15:30:01 KST"): "2024-03-05T06:30:01.000000Z", ("kr", "2024-03-05 15:30:01 UTC-5"): "2024-03-05T20:30:01.000000Z", ("kr", "2024-03-05 15:30:01 GMT+05:45"): "2024-03-05T09:45:01.000000Z",
        ("kr", "Tue, 05 Mar 2024 15:30:01 +0900"): "2024-03-05T06:30:01.000000Z", ("kr", "2024-03-05T15:30:01+09:00[Asia/Seoul]"): "2024-03-05T06:30:01.000000Z", ("kr", "2024-03-05 15:30:01,250"): "2024-03-05T06:30:01.250000Z",
    }
    got = run(spark, list(cases))
    assert [g and g[0] for g in got] == list(cases.values())


def test_daylight_saving(spark):
    got = run(spark, [("ny", "2025-11-02 01:30"), ("ny", "2025-03-09 02:30"), ("ldn", "2025-10-26 01:30"), ("kr", "1988-10-09 02:30:00"), ("ny", "2025-11-02 01:30:00 EST")])
    assert [g[0] for g in got] == ["2025-11-02T05:30:00.000000Z", "2025-03-09T07:30:00.000000Z", "2025-10-26T00:30:00.000000Z", "1988-10-08T16:30:00.000000Z", "2025-11-02T06:30:00.000000Z"]


def test_slashed_dates_follow_their_source(spark):
    got = run(spark, [("ny", "04/07/2024"), ("ldn", "04/07/2024 10:00:00"), ("ny", "21/08/2025"), ("ldn", "04/04/2024"), ("ny", "31/31/2024")])
    assert [g[0] for g in got] == ["2024-04-07", "2024-07-04T09:00:00.000000Z", "2025-08-21", "2024-04-04", None]


def test_ambiguity_is_marked(spark):
    # an undeclared source without any unambiguous value cannot be decided
    assert run(spark, [("new", "04/07/2024")]) == [(None, "ambiguous")]
    # many unambiguous values of one order decide it
    got = run(spark, [("new", f"{d:02d}/03/2024") for d in range(13, 29)] + [("new", "04/07/2024")])
    assert got[-1] == ("2024-07-04", "day")


def test_no_dates(spark):
    texts = ["", "-", "TBD", "미정", "2025.13.01", "2025-02-30", "0000-00-00", "2024-03-05 25:00", "공포 후 6개월이 경과한 날", "2024-03-05 10:00 XYZ", "x" * 100_000]
    assert run(spark, [("kr", t) for t in texts]) == [(None, "none")] * len(texts)


def test_nulls_unknown_zone_repeats_and_clashes(spark):
    rows = [(1, None, "2024-03-05 10:00", None, None, "x"), (1, "kr", None, None, "2024.3.5", "x"), (1, "kr", None, None, "2024.3.5", "x"), (None, "kr", "2024.3.6", None, None, "x")]
    df = spark.createDataFrame(rows, SCHEMA + ", format string").withColumnRenamed("format", "norm_value")
    out = normalize_timestamps(df, spark.createDataFrame(SOURCES, "source_system string, zone_name string, date_order string")).collect()
    assert sorted((r.article_id or 0, r.field_name, r.norm_value or "", r.status) for r in out) == [
        (0, "published_at", "2024-03-06", "day"), (1, "effective_date", "2024-03-05", "day"), (1, "effective_date", "2024-03-05", "day"), (1, "published_at", "", "no_zone"),
    ]


def test_empty_table(spark):
    out = normalize_timestamps(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "source_system string, zone_name string, date_order string"))
    assert out.count() == 0


def test_shuffled_join_equals_broadcast(spark, monkeypatch):
    values = [("ny", f"{m:02d}/{d:02d}/2024") for m in range(1, 13) for d in range(1, 13)]
    plain = run(spark, values)
    monkeypatch.setattr("lawloom.operators.timestamps._SMALL", 3)
    assert run(spark, values) == plain


def test_em_weights():
    cells = pd.DataFrame({"_src": "s", "f1": ["mdy", "dmy", "mdy"], "mon1": [10, 11, 12], "f2": [None, None, "dmy"], "mon2": [None, None, 15], "n": [90, 10, 5]})
    assert fit_cells(cells, None).post1.iloc[2] > 0.8
    assert fit_cells(cells, "dmy", strength=100).post1.iloc[2] < 0.2


def test_values_outweigh_a_declaration():
    """5,000 values that can only be dmy leave 100 ambiguous ones ambiguous or dmy though mdy is declared, at any size; a
    source whose values say nothing follows its declaration."""
    for times in (1, 100):
        cells = pd.DataFrame({"_src": "s", "f1": ["dmy", "mdy"], "mon1": [10, 10], "f2": [None, "dmy"], "mon2": [None, 10], "n": [5000 * times, 100 * times]})
        assert fit_cells(cells, "mdy").post1.iloc[1] < 0.5
    alone = pd.DataFrame({"_src": "s", "f1": ["mdy"], "mon1": [10], "f2": ["dmy"], "mon2": [10], "n": [100_000]})
    assert fit_cells(alone, "mdy").post1.iloc[0] > 0.9 and fit_cells(alone, "dmy").post1.iloc[0] < 0.1


def test_contradicted_declaration_is_marked(spark):
    values = [("ny", f"{d}/{m}/2024") for d in range(13, 29) for m in range(1, 13)] * 25 + [("ny", "03/04/2024")]
    out = run(spark, values)
    assert out[-1][0] in ("2024-04-03", None)


@pytest.mark.parametrize("name", ["p1_found"])
def test_query_schema(spark, root, name):
    import __spark_entry__ as e

    df = e.queries()[name](spark, root)
    assert df.columns == ["article_id", "field_name", "norm_value"] and df.count() > 100
