import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lawloom.llm.splitting import split_records, split_text


def check(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][2] == len(text)
    for (a, c, e, _), (a2, c2, e2, _) in zip(pieces, pieces[1:]):
        assert c2 == e and a2 == max(0, c2 - overlap) and a2 >= a
    assert all(0 < e - a <= limit for a, _, e, _ in pieces)
    return pieces


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="가나. \n\tab́,。‍\r", min_size=1, max_size=400), st.integers(2, 60), st.integers(0, 59))
def test_invariants(text, limit, overlap):
    check(text, limit, min(overlap, limit - 1))


def test_strong_boundaries_survive():
    text = "첫 문단이다. 둘째 문장이다.\n\n둘째 문단이다. 또 한 문장이다.\n\n셋째 문단이다."
    pieces = check(text, 24, 0)
    assert [b for *_, b in pieces] == ["paragraph", "paragraph", "end"]


def test_no_merge_is_possible_any_more():
    text = ". ".join(f"문장 {i} 번이 여기에 있다" for i in range(50))
    pieces = check(text, 100, 10)
    sizes = [e - c for _, c, e, _ in pieces]
    assert all(x + y > (100 if i == 0 else 90) for i, (x, y) in enumerate(zip(sizes, sizes[1:])))


def test_long_runs_and_marks():
    assert all(e - a <= 50 for a, _, e, _ in check("가" * 1000, 50, 7))
    pieces = check("é" * 200, 21, 0)  # letters with a combining mark each
    assert all(len("é" * 200) == e or ("é" * 200)[e] != "́" for _, _, e, _ in pieces)
    check("x" * 300_000, 1000, 100)


def test_limits():
    for limit, overlap in ((5, 5), (5, -1), (0, 0)):
        with pytest.raises(ValueError):
            split_text("abcdef", limit, overlap)


def test_rows(spark):
    rows = [(1, "a" * 10, "x"), (1, "a" * 10, "x"), (2, None, "x"), (3, "", "x"), (4, "b" * 25, "x"), (5, " " * 12, "x"), (None, "short", "x")]
    df = spark.createDataFrame(rows, "id bigint, body string, piece_no string")
    got = split_records(df, "t", "id", "body", 10, 2).collect()
    assert sorted((r.row_id or 0, r.piece_no, r.n_pieces) for r in got) == [(0, 0, 1), (1, 0, 1), (1, 0, 1), (4, 0, 3), (4, 1, 3), (4, 2, 3), (5, 0, 2), (5, 1, 2)]
    assert {r.row_id: r.long_run for r in got if r.n_pieces > 1} == {4: 1, 5: 0}
    assert split_records(df.where("false"), "t", "id", "body", 10, 2).count() == 0


def test_query(spark, root):
    import __spark_entry__ as e

    found, pieces = e.queries()["p3_found"](spark, root), e.queries()["p3_pieces"](spark, root)
    assert found.columns == ["source_table", "row_id", "long_run"]
    many = pieces.where("n_pieces > 1 and piece_no = 0").select("source_table", "row_id", "long_run")
    assert found.exceptAll(many).count() == 0 and many.exceptAll(found).count() == 0
