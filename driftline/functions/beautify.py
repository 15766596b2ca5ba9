"""Minified scripts and styles on lines of their own, and which form a text of each class is compared in."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as t

# Labels of the forms, by class; and how deep lines are indented at most.
ENGINES = {"CSS": "css-beautify", "HTML": "html-beautify", "JSP": "jsp-normalize", "CONFIG": "text-normalize"}
OTHER_ENGINE = "js-beautify"
DEEPEST = {"JS": 64, "CSS": 16}
LONGEST = 2_000_000
# A comment's end loses its slash and gains a line end: fixed, so that results are those known.
_BLOCK = r"(?P<block>/(?:\*(?=/)|\*.*?\*(?=/))/|/\*.*\Z)"
_PIECES = {
    "JS": re.compile(r"(?P<text>(?P<q>['\"`])(?:\\.|(?!(?P=q)).)*(?:(?P=q)|\Z))|(?P<line>//[^\n]*\n?)|" + _BLOCK + r"|[{};]", re.S),
    "CSS": re.compile(r"(?P<text>(?P<q>['\"])(?:\\.|(?!(?P=q)).)*(?:(?P=q)|\Z))|" + _BLOCK + r"|[{};]", re.S),
}


def spread(source: str, kind: str) -> str:
    """A script or style with line ends after braces and semicolons outside texts and comments, indented by depth."""
    depth = 0

    def piece(m: re.Match) -> str:
        nonlocal depth
        found = m.group()
        if found == "{":
            depth = min(depth + 1, DEEPEST[kind])
            return "{\n" + "  " * depth
        if found == "}":
            depth = max(depth - 1, 0)
            return "\n" + "  " * depth + "}"
        if found == ";":
            return ";\n" + "  " * depth
        if m["block"] and found.endswith("*/") and len(found) > 2:
            return found[:-1] + "\n"
        return found

    return _PIECES[kind].sub(piece, source)


def engine(cls: Column) -> Column:
    """The label of a class' form."""
    out = None
    for name, label in ENGINES.items():
        out = F.when(cls == name, label) if out is None else out.when(cls == name, label)
    return out.otherwise(OTHER_ENGINE)


def minified(text: str) -> bool:
    """What text.looks_minified says of a text, inside a task."""
    lines = text.split("\n")
    return max(map(len, lines)) > 400 and (len(lines) < 6 or len(text) / len(lines) > 200)


def spread_form(text: str, kind: str) -> str | None:
    """A minified script or style of a class spread, inside a task; none of what is compared in another form."""
    if kind in ENGINES and kind != "CSS" or len(text) > LONGEST or not minified(text):
        return None
    return spread(text, "CSS" if kind == "CSS" else "JS")


def form(text: Column, cls: Column, spread_text: Column) -> Column:
    """The form in which a text of a class is compared, where a task that had the text in hand has made its spread_form."""
    return (F.when(F.length(text) > LONGEST, text).when(cls == "HTML", t.html_split(text)).when(cls == "JSP", t.jsp_split(text))
            .when(spread_text.isNotNull(), spread_text).otherwise(t.newlines(text)))


def beautified(text: Column, cls: Column) -> Column:
    """The form in which a text of a class is compared. Only minified scripts and styles leave expressions; too long texts stay as they are."""

    @F.pandas_udf("string")
    def spread_all(texts: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else spread(x, "CSS" if k == "CSS" else "JS") for x, k in zip(texts, kinds)])

    packed = t.looks_minified(text) & ~cls.isin("HTML", "JSP", "CONFIG")
    return form(text, cls, F.when(packed, spread_all(F.when(packed, text), cls)))
