import random
import re

from pyspark.sql import functions as F

from driftline.functions import lexer


def by_hand(line, col):
    """Character by character."""
    n = len(line)
    if n == 0:
        return "blank"
    col = max(0, min(col, n))
    if col >= n:
        return "eol"
    i, state, q = 0, None, ""
    while i <= col:
        ch, nx = line[i], line[i + 1 : i + 2]
        if state == "comment":
            if ch == "*" and nx == "/":
                state, i = None, i + 2
            else:
                i += 1
        elif state == "string":
            if ch == "\\":
                i += 2
            else:
                state = None if ch == q else state
                i += 1
        elif ch + nx == "//":
            return "comment"
        elif ch + nx == "/*":
            state, i = "comment", i + 2
        else:
            if ch in "\"'`":
                state, q = "string", ch
            i += 1
    if state:
        return state
    ch, nx = line[col], line[col + 1 : col + 2]
    if ch.isspace():
        return "ws"
    if re.match("[0-9]", ch) or (ch == "." and re.match("[0-9]", nx)):
        return "number"
    if re.match("[A-Za-z_$]", ch):
        s, e = col, col
        while s and re.match(r"[\w$]", line[s - 1], re.A):
            s -= 1
        while e < n and re.match(r"[\w$]", line[e], re.A):
            e += 1
        return "keyword" if line[s:e] in lexer.KEYWORDS else "ident"
    return "op" if re.match(lexer.OPERATORS, ch) else "other"


def test_against_a_walk(spark):
    rng = random.Random(9)
    pieces = ["\"", "'", "`", "//", "/*", "*/", "\\", "if", "x1", " ", "3.5", ".", "*", "/", "é", "\"a\"", "return", "$", "#", "'b'"]
    lines = ["", "int a = 5; // done", "s = \"a // b\" + 'c'", "/* x */ y", "a /*/ b", "\"open // x", "f(x)/2"] + ["".join(rng.choices(pieces, k=rng.randint(1, 9))) for _ in range(900)]
    rows = [(x, c) for x in lines for c in range(-1, len(x) + 2)]
    got = spark.createDataFrame(rows, "line string, col int").select("line", "col", lexer.token_at(F.col("line"), F.col("col")).alias("t"), ).collect()
    wrong = [(r.line, r.col, r.t, by_hand(r.line, r.col)) for r in got if r.t != by_hand(r.line, r.col)]
    assert not wrong, wrong[:8]
    assert {r.t for r in got} == set(lexer.LABELS)
