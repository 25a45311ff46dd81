import json

import numpy as np

from lawloom.llm import reply_defects as R

PROMPT = "Task: assess how the notices affect an insurer.\nOutput: Markdown, written in Korean, four headed parts.\n\n[Sources]\n[source_index=1] 공지 | 기관\n저축은행은 제36조의 경과조치를 적용받아 종전 기준을 따를 수 있다. 개정안은 교육을 요구한다."
GOOD = "# 보고서\n\n## 1. 요약\n\n- 보험회사는 매월 보고해야 한다. [source_index=1]\n\n## 2. 주요 변경\n\n위험평가표를 새로 만들어야 한다.\n\n## 3. 영향\n\n민원이 늘었다.\n\n## 4. 후속 조치\n\n| 조치 | 담당 |\n|---|---|\n| 점검 | 감독국 |"
ENGLISH = "## 1. Summary\n\nThe review covered 264 files and found 9 errors.\n\n## 2. Changes\n\nStaff need training.\n\n## 3. Impact\n\nCosts rise for the firms.\n\n## 4. Next steps\n\nReport to the board."


def envelope(text, finish="stop"):
    return json.dumps({"choices": [{"message": {"content": text}, "finish_reason": finish}]}, ensure_ascii=False)


def google(text, finish="STOP"):
    return json.dumps({"candidates": [{"content": {"parts": [{"text": text}]}, "finishReason": finish}]})


CASES = [
    ("empty", None), ("empty", ""), ("empty", " \n"), ("empty", "null"), ("empty", "N/A"), ("empty", "&nbsp;"), ("empty", "답변:"), ("empty", envelope("")), ("empty", '{"choices": []}'), ("empty", "```markdown\n```"),
    ("empty", "# 제목\n\n## 1. 요약\n\n## 2. 영향"), ("empty", "# 제목\n\n| 조치 | 담당 |\n|---|---|"), ("empty", '{"dry_run": true}'), ("empty", google("...")),
    ("refusal", "죄송하지만, 해당 요청은 도와드리기 어렵습니다."), ("refusal", envelope("I'm sorry, but I cannot comply with this request.")), ("refusal", google("申し訳ありませんが、この依頼にはお応えできません。", "SAFETY")), ("refusal", "# 제목\n\n이 주제의 보고서는 작성해 드릴 수 없습니다."), ("refusal", json.dumps({"choices": [{"message": {"content": None, "refusal": "이 요청은 처리하지 않습니다."}, "finish_reason": "stop"}]})),
    ("copy", PROMPT), ("copy", "네, 요청하신 내용은 다음과 같습니다.\n\n" + PROMPT), ("copy", envelope(PROMPT.split("[Sources]")[1])),
    ("truncated", GOOD[:90]), ("truncated", envelope(GOOD[:95], "length")), ("truncated", envelope(GOOD)[:150]), ("truncated", GOOD[: GOOD.index("## 3.") + 8]),
    ("other_language", ENGLISH), ("other_language", google(ENGLISH)),
    ("", GOOD), ("", envelope(GOOD)), ("", google(GOOD)), ("", GOOD.replace("# 보고서", "죄송합니다만 일부 수치는 확인되지 않았습니다.")), ("", GOOD + "\n\n끝."),
]


def test_unwrap():
    assert R.unwrap(envelope("a", "length")) == ("a", "length", False) and R.unwrap(google("b")) == ("b", "stop", False) and R.unwrap("plain") == ("plain", "", False)
    text, _, broken = R.unwrap(envelope("가나다라마바사")[:-34])
    assert broken and text.startswith("가나")
    text, _, broken = R.unwrap('{"candidates": [{"content": {"parts": [{"text": "가"}, {"text": "나\\n다')
    assert (text, broken) == ("가나\n다", True)
    assert R.unwrap("[]")[0] == "" and R.unwrap('"x"')[0] == '"x"'


def test_asked_language():
    assert R.asked_language(PROMPT) == "ko" and R.asked_language("Language of the answer: English\n[Sources]\n한국어") == "en" and R.asked_language("") == "" and R.asked_language("한국어 마크다운으로 쓸 것") == "ko"


def test_rows(spark):
    many = [(1000 + i, "completed", PROMPT, f) for i in range(60) for f in [envelope(GOOD.replace("늘었다", f"{i}건 늘었다"))]]
    rows = [(i, " Completed ", PROMPT, raw) for i, (_, raw) in enumerate(CASES)] + many
    rows += [(500, "failed", PROMPT, ""), (501, None, PROMPT, ""), (502, "completed", None, None), (503, "completed", None, GOOD), (0, "completed", PROMPT, None), (504, "completed", PROMPT, GOOD + "\n\n긴 문장이다." * 20_000)]
    df = spark.createDataFrame(rows, "id bigint, llm_status string, llm_prompt string, llm_response_raw string").selectExpr("*", "'x' as labels")
    got = {}
    for r in R.reply_defects(df).collect():
        got.setdefault(r.output_id, []).append(list(r.labels))
    assert 500 not in got and 501 not in got and len(got[0]) == 2 and got[502][0][0] == "empty" and got[503] == [[]] and got[504] == [[]]
    wrong = [(want, raw, got[i][0]) for i, (want, raw) in enumerate(CASES) if (got[i][0] or [""])[0] != want]
    assert wrong == []
    assert R.reply_defects(df.where("false")).count() == 0


def test_declined_in_the_envelope():
    raw = json.dumps({"choices": [{"message": {"content": None, "refusal": "I cannot help."}, "finish_reason": "stop"}]})
    assert R.unwrap(raw) == ("I cannot help.", "refusal", False)
    assert R.unwrap(json.dumps({"choices": [{"message": {"content": "x", "refusal": None}, "finish_reason": "stop"}]})) == ("x", "stop", False)


def _counted(pairs):
    habits = R.Habits(frozenset(), 4, 120)
    graded = [R.levels(p, a, habits) for p, a in pairs]
    return {d: np.bincount([R._code(d, g[d]) for g in graded if g[d] is not None], minlength=int(np.prod(R._RADIX[d]))).astype(float) for d in R.DEFECTS}


def test_label_model_weighs_several_functions():
    """A reply that ends in a full stop breaks off all the same if its envelope is broken and it lacks headings: no single
    function decides."""
    pairs = [(PROMPT, envelope(GOOD))] * 95 + [(PROMPT, envelope(GOOD[:90], "length"))] * 5
    model = R.LabelModel().fit(_counted(pairs))
    whole = R.levels(PROMPT, envelope(GOOD), R.Habits(frozenset(), 4, 120))
    cut = R.levels(PROMPT, envelope(GOOD[: GOOD.index("## 2.")].rstrip(), "length"), R.Habits(frozenset(), 4, 120))
    assert cut["truncated"][0] == whole["truncated"][0] or cut["truncated"][0] == 0
    assert model.posterior["truncated"][R._code("truncated", whole["truncated"])] < 0.05
    assert model.posterior["truncated"][R._code("truncated", cut["truncated"])] > 0.5
    hedged = R.levels(PROMPT, GOOD.replace("# 보고서", "일부 수치는 제공할 수 없습니다."), R.Habits(frozenset(), 4, 120))
    assert hedged["refusal"][0] == 1 and model.posterior["refusal"][R._code("refusal", hedged["refusal"])] < 0.5


def test_the_model_does_not_depend_on_size():
    counts = _counted([(PROMPT, envelope(GOOD))] * 900 + [(PROMPT, envelope(GOOD[:90], "length"))] * 60 + [(PROMPT, PROMPT)] * 40)
    a, b = R.LabelModel().fit(counts), R.LabelModel().fit({d: 1000 * n for d, n in counts.items()})
    assert all(np.allclose(a.posterior[d], b.posterior[d], atol=0.02) for d in R.DEFECTS)


def test_functions_that_agree_count_less():
    x = np.array([[0, 0, 0], [0, 0, 1], [1, 1, 0], [1, 1, 1]])
    share = R.LabelModel._shares(x, np.ones((2, 4)))
    assert share[0] < 0.55 and share[1] < 0.55 and share[2] > 0.95


def test_cutoffs_are_validated_on_spoilt_pairs():
    good = [(PROMPT, GOOD.replace("늘었다", f"{i}건 늘었다")) for i in range(30)] + [(PROMPT.replace("Korean", "English"), ENGLISH)] * 5
    model = R.LabelModel().fit(_counted([(p, envelope(a)) for p, a in good] * 20 + [(PROMPT, PROMPT)] * 20 + [(PROMPT, envelope(GOOD[:100]))] * 20 + [(PROMPT, ENGLISH)] * 20))
    cutoffs, quality = R.validated_cutoffs(model, good, [(PROMPT, "요청을 처리하지 않습니다.")] * 5, R.Habits(frozenset(), 4, 120))
    assert set(quality) == set(R.DEFECTS) and all(0 < c < 1 for c in cutoffs.values())
    assert quality["copy"] == (1.0, 1.0) and quality["other_language"] == (1.0, 1.0) and quality["refusal"] == (1.0, 1.0) and min(quality["truncated"]) > 0.7
    assert R.validated_cutoffs(model, [], [], R.Habits()) == (dict.fromkeys(R.DEFECTS, 0.5), {})


def test_query(spark, root):
    import __spark_entry__ as e

    assert e.queries()["p2_found"](spark, root).columns == ["output_id", "defect_type"]


def test_language_named_late_in_a_prompt_without_sources():
    from lawloom.llm.reply_defects import asked_language

    assert asked_language("다음 글을 요약한다. " * 60 + "Answer in English.") == "en"


def test_cutoffs_come_from_every_pair(spark, monkeypatch):
    """What validates the cutoffs counts all good and all declined pairs, wherever the rows lie."""
    refused = json.dumps({"choices": [{"message": {"content": None, "refusal": "이 요청은 처리하지 않습니다."}, "finish_reason": "stop"}]})
    rows = [(i, "completed", PROMPT, envelope(GOOD.replace("늘었다", f"{i}건 늘었다"))) for i in range(700)]
    rows += [(1000 + i, "completed", PROMPT.replace("Korean", "English"), ENGLISH.replace("264", str(i))) for i in range(70)] + [(2000 + i, "completed", PROMPT, refused) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, llm_status string, llm_prompt string, llm_response_raw string")
    seen, best = [], R.best_cutoffs
    monkeypatch.setattr(R, "best_cutoffs", lambda model, cases: seen.append(cases) or best(model, cases))
    for parts in (2, 5):
        R.reply_defects(df.repartition(parts))
    total = {case: sum(n for (c, d, _), n in seen[0].items() if c == case and d == "empty") for case in ("", *R.DEFECTS)}
    assert total == {"": 770, "empty": 770, "refusal": 200, "copy": 770, "truncated": 770, "other_language": 770} and seen[0] == seen[1]


def test_levels_without_the_envelope():
    habits = R.Habits(frozenset(), 4, 120)
    for _, raw in CASES:
        answer = R.unwrap(raw or "")[0]
        assert R._bare_levels(R.levels(PROMPT, raw, habits), answer) in (None, R.levels(PROMPT, answer, habits))
