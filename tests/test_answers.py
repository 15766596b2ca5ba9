import json
import random

import pytest

from driftline.functions import answers as a

WHOLE = {"overallRisk": "HIGH", "impactScope": ["orders, and \"pay\"", "web }]"], "testThemes": ["login", "a\nb"], "fileRisks": [{"key": "A.java", "risk": "LOW", "oneLineReason": "x"}, {"file": "B.java", "riskLevel": "HIGH", "description": "{y}"}],
         "suggestions": {"first": "do", "then": ["p", "q"], "deep": {"x": 1}}, "rollbackPlan": "undo \\ now"}


def test_whole_answers():
    t = json.dumps(WHOLE, ensure_ascii=False)
    assert a.scalar(t, "overallRisk") == "HIGH" and a.field(t, "impactScope") == 'orders, and "pay"\nweb }]' and a.themes(t) == ["login", "a\nb"]
    assert a.file_risks(t) == [{"key": "A.java", "risk": "LOW", "reason": "x"}, {"key": "B.java", "risk": "HIGH", "reason": "{y}"}]
    assert a.field(t, "suggestions") == "- first：do\n- then：\n  p\n  q\n- deep：- x：1"
    assert a.field(json.dumps(WHOLE, indent=2), "none", "rollbackPlan") == "undo \\\\ now"


@pytest.mark.parametrize("text, name, want", [
    ('{"intent": "cut sho', "intent", '"cut sho'), ('{"intent": ["a", "b', "intent", '["a"'), ('{"intent": {"x": "y"', "intent", '{"x": "y"'), ('{"intent": ', "intent", ""), ('{"intent"', "intent", ""), ("intent: plain, 'text'", "intent", "plain text"),
    ('{"compatImpact": "no", "impact": "yes"}', "impact", "yes"), ('{"n": 12, "m": true}', "n", "12"), ('{"x": [{"a": "1"}, {"a": "2", "b": [1, 2]}]}', "x", "- a：1\n- a：2\n- b："), ('{"x": []}', "x", ""), ('{"x": "a\\"b"}', "x", 'a\\"b'), ("", "x", "")])
def test_cut_and_plain(text, name, want):
    assert a.field(text, name) == want


def test_names_in_order_and_prose():
    assert a.themes("ok\n- 回归 login\n- other\n-验证 x") == ["回归 login", "验证 x"] and a.strings('{"test_themes": ["t"]}', "testThemes", "test_themes") == ["t"]
    assert a.file_risks('{"files": [{"risk": "LOW"}, {"key": "k"') == [] and a.file_risks('{"files": [{"risk": "LOW"}]}') == [{"key": "?", "risk": "LOW", "reason": ""}]


def test_any_cut_ends_and_keeps_what_is_whole():
    """Cut anywhere, nothing fails, and fields that closed before the cut are as in the whole."""
    t = json.dumps(WHOLE, ensure_ascii=False, indent=1)
    whole = {n: (a.value_of(t, n), t.index(f'"{n}"')) for n in WHOLE}
    for cut in range(len(t)):
        for name, (raw, at) in whole.items():
            got = a.field(t[:cut], name)
            if t.index(raw, at) + len(raw) <= cut:
                assert got == a.field(t, name)
        a.file_risks(t[:cut]), a.themes(t[:cut])


def test_noise_ends():
    rng = random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice('"\\{}[]:, \nabx') for _ in range(40))
        for name in ("a", "b", "x"):
            a.field(t, name), a.objects(t, name), a.strings(t, name)


def test_column(spark):
    rows = [(json.dumps(WHOLE),), (None,), ('{"overallRisk": "LOW", "impactScope": "cut',)]
    got = [r.p for r in spark.createDataFrame(rows, "t string").select(a.parsed(__import__("pyspark").sql.functions.col("t")).alias("p")).collect()]
    assert [g.risk for g in got] == ["HIGH", "MEDIUM", "LOW"] and got[2].impact_scope == '"cut' and got[1].themes == [] and len(got[0].files) == 2
