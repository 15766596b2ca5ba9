import random

import pytest

from driftline.operators import markdown as md


def parse(text):
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    lines = lines[:-1] if lines[-1] == "" else lines
    return [md.block(own) for _, own in md.parts(lines, md._looks(lines, None), md.NONE, 0)] if text else []


def kinds(text):
    return [b["type"] for b in parse(text)]


def test_headings():
    got = parse("# H1\n## H2\n### H3\n#### H4\n##### H5\n###### H6")
    assert [(b["type"], b["level"], b["text"]) for b in got] == [("HEADING", k, f"H{k}") for k in range(1, 7)]
    assert [(b["level"], b["text"]) for b in parse("#\n######")] == [(1, ""), (6, "")]
    assert kinds("####### x\n#NoSpace") == ["PARAGRAPH", "PARAGRAPH"]


def test_paragraphs_and_rules():
    assert [b["text"] for b in parse("line one\nline two\nline three")] == ["line one line two line three"]
    assert kinds("|---|---|\n") == ["PARAGRAPH"] and kinds("---\n***\n___\n- - -\n*  *  *") == ["HR"] * 5
    assert kinds("text\n# head\ntext\n---\ntext\n```\n```\nx\n- a\n\n> q\ny\n|a|b|\n|-|-|") == ["PARAGRAPH", "HEADING", "PARAGRAPH", "HR", "PARAGRAPH", "CODE", "PARAGRAPH", "LIST", "QUOTE", "PARAGRAPH", "TABLE"]
    assert parse("") == [] and kinds("\n \n\t") == []


def test_code():
    assert [(b["type"], b["lang"], b["text"]) for b in parse("```java\nint x = 1;\nint y = 2;\n```")] == [("CODE", "java", "int x = 1;\nint y = 2;")]
    assert [(b["type"], b["lang"], b["text"]) for b in parse("```\nfoo\nbar")] == [("CODE", "", "foo\nbar")]
    assert parse("```\n---\n| a | b |\n```")[0]["text"] == "---\n| a | b |" and len(parse("```\n---\n```")) == 1


def test_lists():
    items = lambda t: [(i["indent"], i["ordered"], i["content"]) for i in parse(t)[0]["items"]]
    assert items("- a\n- b\n* c") == [(0, False, "a"), (0, False, "b"), (0, False, "c")] and parse("- a")[0]["ordered"] is False
    assert items("1. first\n- second") == [(0, True, "first"), (0, False, "second")] and parse("1. first\n- second")[0]["ordered"] is True
    assert items("- parent\n  child text") == [(0, False, "parent child text")] and items("- a\n  - b") == [(0, False, "a"), (2, False, "b")]
    assert kinds("- a\nb") == ["LIST", "PARAGRAPH"]


def test_tables():
    t = parse("| 名称 | 值 |\n|---|---|\n| a | 1 |\n| b | 2 |")
    assert [(b["type"], b["header"], b["rows"]) for b in t] == [("TABLE", ["名称", "值"], [["a", "1"], ["b", "2"]])]
    assert [(b["header"], b["rows"]) for b in parse("h1 | h2\n--- | ---\nv1 | v2")] == [(["h1", "h2"], [["v1", "v2"]])]
    assert len(parse("| a | b |\n|:---|---:|\n| 1 | 2 |")[0]["rows"]) == 1 and kinds("| a | b |\n|---|---|\n| 1 | 2 |\nafter") == ["TABLE", "PARAGRAPH"]


def test_quotes():
    assert [(b["type"], b["text"]) for b in parse("> hello\n> world\nnot quote")] == [("QUOTE", "hello\nworld"), ("PARAGRAPH", "not quote")]
    assert parse(">tight")[0]["text"] == "tight"


@pytest.mark.parametrize("text, want", [
    ("a **b** c", [("TEXT", "a "), ("BOLD", "b"), ("TEXT", " c")]), ("*i* and `x*y`", [("ITALIC", "i"), ("TEXT", " and "), ("CODE", "x*y")]),
    ("a`b", [("TEXT", "a"), ("TEXT", "`b")]), ("a **b", [("TEXT", "a "), ("TEXT", "**b")]), ("x *y", [("TEXT", "x "), ("TEXT", "*y")]), ("", []), (None, []), ("``", [("CODE", "")]), ("****", [("BOLD", "")])])
def test_inline(text, want):
    assert md.inline(text) == want


LINES = ["# h", "####### no", "#no", "", "  ", "text", "  indented", "- item", "2. item", "* x", "---", "```", "```py", "> q", ">", "| a | b |", "|---|---|", "a | b", "-|-", "| c |", "\ttab"]


def test_runs_give_what_whole_texts_give(spark, monkeypatch):
    """Long texts, cut into short runs, against the same texts read in one go."""
    rng = random.Random(4)
    texts = [(i, "\n".join(rng.choice(LINES) for _ in range(rng.randint(1, 60))) + rng.choice(["", "\n"])) for i in range(60)] + [(60, None), (61, ""), (62, "one\r\ntwo\rthree")]
    df = spark.createDataFrame(texts, "key long, text string")
    found = {}
    for run in (2, 7, 5000):
        monkeypatch.setattr(md, "RUN", run)
        for r in md.blocks(df).collect():
            found.setdefault(run, []).append(tuple(r))
    assert sorted(found[2], key=repr) == sorted(found[7], key=repr) == sorted(found[5000], key=repr)
    want = [(k, no, b["type"], b["text"]) for k, t in texts for no, b in enumerate(parse(t or ""), 1)]
    assert sorted((r[0], r[1], r[2], r[5]) for r in found[2] if r[5] is not None) == sorted(w for w in want if w[3] is not None) and len(found[2]) == len(want)
