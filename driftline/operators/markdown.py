"""Markdown texts as rows of blocks.

Which block a line belongs to depends on what stands above it, but only through a few states, so lines are functions of states and
runs of lines are compositions of such functions. Texts are cut into runs of RUN lines; each run is reduced to where it leads from
every state and how many blocks it begins, the runs of a long text are put in order by these few numbers alone, and then every run is
read again from the state it really begins in. Texts of one run, nearly all, are read in one pass without any exchange.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 5_000
NONE, CODE, TABLE, ROWS, LIST, QUOTE, TEXT = STATES = range(7)
# What lines look like.
_BLANKS = "".join(map(chr, range(33)))
_REST = "[^\n\r\x85  ]*"
_ITEM = re.compile(rf"(?:[-*]|(\d+)\.)[ \t\n\x0b\f\r]+({_REST})", re.ASCII)
_RULE = re.compile(r"-{3,}|\*{3,}|_{3,}")
BLANK, FENCE, HEADING, HASH, GRID, PIPE, LINE, ITEM, MORE, CITED = (1 << k for k in range(10))


def _separator(line: str) -> bool:
    s = line.strip(_BLANKS).replace("|", "").replace(" ", "")
    return "-" in s and not s.strip("-:")


def look(line: str, following: str | None) -> int:
    """What a line looks like, as bits; a table's head by the line that follows."""
    t = line.strip(_BLANKS)
    if not t:
        return BLANK
    marks = len(t) - len(t.lstrip("#"))
    heading = 0 < marks <= 6 and (len(t) == marks or t[marks] == " ")
    item = _ITEM.fullmatch(t)
    return (FENCE * t.startswith("```") | HEADING * heading | HASH * (marks > 0) | GRID * ("|" in t and following is not None and _separator(following)) | PIPE * ("|" in t)
            | LINE * bool(_RULE.fullmatch(t.replace(" ", ""))) | ITEM * bool(item) | MORE * (not item and line.startswith(" ")) | CITED * t.startswith(">"))


def _step(looks: int, state: int) -> tuple[int, int, str]:
    """(state after a line, blocks it begins, its part in its block)."""
    has = lambda *bits: any(looks & b for b in bits)
    if state == CODE:
        return (NONE, 0, "") if has(FENCE) else (CODE, 0, "code")
    if state == TABLE:
        return ROWS, 0, ""
    if state == ROWS and has(PIPE) and not has(FENCE):
        return ROWS, 0, "row"
    if state == LIST and has(ITEM, MORE):
        return LIST, 0, "item" if has(ITEM) else "more"
    if state == QUOTE and has(CITED):
        return QUOTE, 0, "cited"
    if state == TEXT and not has(BLANK, HASH, LINE, FENCE, ITEM, CITED, GRID):
        return TEXT, 0, "text"
    for bit, after, part in ((BLANK, NONE, ""), (FENCE, CODE, "CODE"), (HEADING, NONE, "HEADING"), (GRID, TABLE, "TABLE"), (LINE, NONE, "HR"), (ITEM, LIST, "LIST"), (CITED, QUOTE, "QUOTE")):
        if has(bit):
            return after, int(bool(part)), part
    return TEXT, 1, "PARAGRAPH"


_STEPS = [[_step(looks, s) for s in STATES] for looks in range(1024)]
_AFTER, _BEGUN = (np.array([[x[k] for x in row] for row in _STEPS]) for k in (0, 1))


def _looks(lines: list[str], following: str | None) -> list[int]:
    return [look(x, y) for x, y in zip(lines, [*lines[1:], following])]


def composed(looks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """From each state: where the lines lead, and how many blocks they begin."""
    at, begun = np.arange(len(STATES)), np.zeros(len(STATES), int)
    for x in looks:
        begun = begun + _BEGUN[x][at]
        at = _AFTER[x][at]
    return at, begun


def parts(lines: list[str], looks: list[int], state: int, block: int) -> list[tuple[int, list[tuple[str, str]]]]:
    """(block, lines with their part) of a run that begins in a state, after so many blocks."""
    out: list[tuple[int, list]] = []
    for line, x in zip(lines, looks):
        state, begun, part = _STEPS[x][state]
        block += begun
        if part:
            if not out or out[-1][0] != block:
                out.append((block, []))
            out[-1][1].append((part, line))
    return out


def _cells(line: str) -> list[str]:
    s = line.strip(_BLANKS)
    s = s[1:] if s.startswith("|") else s
    return [c.strip(_BLANKS) for c in (s[:-1] if s.endswith("|") else s).split("|")]


def _item(line: str) -> tuple[int, bool, str]:
    m = _ITEM.fullmatch(line.strip(_BLANKS))
    return len(line) - len(line.lstrip(" ")), m[1] is not None, m[2].strip(_BLANKS)


_BLOCK = "type string, level int, lang string, text string, ordered boolean, items array<struct<indent:int,ordered:boolean,content:string>>, header array<string>, rows array<array<string>>"
_FIELDS = ["type", "level", "lang", "text", "ordered", "items", "header", "rows"]


def block(own: list[tuple[str, str]]) -> dict:
    """A block of its lines and their parts; the first one's part is the block's type."""
    kind, first = own[0]
    t, more, out = first.strip(_BLANKS), own[1:], dict.fromkeys(_FIELDS)
    out["type"] = kind
    if kind == "HEADING":
        out["level"] = len(t) - len(t.lstrip("#"))
        out["text"] = t[out["level"]:].strip(_BLANKS)
    elif kind == "CODE":
        out["lang"], out["text"] = t[3:].strip(_BLANKS), "\n".join(x for _, x in more)
    elif kind == "TABLE":
        out["header"], out["rows"] = _cells(first), [_cells(x) for _, x in more]
    elif kind == "QUOTE":
        out["text"] = "\n".join(re.sub(r"^>[ \t\n\x0b\f\r]?", "", x.strip(_BLANKS)) for _, x in own)
    elif kind == "PARAGRAPH":
        out["text"] = " ".join(x.strip(_BLANKS) for _, x in own)
    elif kind == "LIST":
        items: list[list] = []
        for part, x in own:
            if part == "more":
                items[-1][2] += f" {x.strip(_BLANKS)}"
            else:
                items.append(list(_item(x)))
        out["ordered"], out["items"] = items[0][1], [dict(zip(("indent", "ordered", "content"), i)) for i in items]
    return out


def _runs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, run, runs, lines, following): a text's lines in runs, with the line after each. A line end closes the last line."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "(\r\n|\r|\n)\\z", ""), "\r\n|\r|\n")
    own = docs.where(F.coalesce(F.length(text), F.lit(0)) > 0).select(F.col(key).alias("key"), lines.alias("all"))
    runs = F.ceil(F.size("all") / RUN).cast("int")
    own = own.select("key", "all", runs.alias("runs"), F.explode(F.sequence(F.lit(0), runs - 1)).alias("run"))
    return own.select("key", "run", "runs", F.slice("all", F.col("run") * RUN + 1, F.lit(RUN)).alias("lines"), F.get("all", (F.col("run") + 1) * RUN).alias("following"))


def blocks(docs: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """(key, block_no from 1, type, level, lang, text, ordered, items, header, rows) of every text. key is one value for each text."""
    kind = docs.schema[key].dataType.simpleString()
    runs = _runs(docs, key, text)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r.key, no, block(own)) for r in batch.itertuples() for no, own in parts(list(r.lines), _looks(list(r.lines), r.following), NONE, 0)]
            yield pd.DataFrame([{"key": k, "block_no": no, **b} for k, no, b in rows], columns=["key", "block_no", *_FIELDS])

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r.key, r.run, *composed(_looks(list(r.lines), r.following))) for r in batch.itertuples()]
            yield pd.DataFrame(rows, columns=["key", "run", "after", "begun"])

    def ordered(own: pd.DataFrame) -> pd.DataFrame:
        state, count, rows = NONE, 0, []
        for r in own.sort_values("run").itertuples():
            rows.append((r.key, r.run, state, count))
            state, count = int(r.after[state]), count + int(r.begun[state])
        return pd.DataFrame(rows, columns=["k", "r", "state", "before"])

    def replayed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r.key, no, r.run, [{"part": p, "line": x} for p, x in own]) for r in batch.itertuples() for no, own in parts(list(r.lines), _looks(list(r.lines), r.following), r.state, r.before)]
            yield pd.DataFrame(rows, columns=["key", "block_no", "run", "own"])

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([{"key": r.key, "block_no": r.block_no, **block([(x["part"], x["line"]) for x in r.own])} for r in batch.itertuples()], columns=["key", "block_no", *_FIELDS])

    schema = f"key {kind}, block_no int, {_BLOCK}"
    short = runs.where("runs = 1").mapInPandas(whole, schema)
    long = runs.where("runs > 1")
    vectors = long.mapInPandas(reduced, f"key {kind}, run int, after array<int>, begun array<int>")
    begins = vectors.groupBy("key").applyInPandas(ordered, f"k {kind}, r int, state int, before int")
    pieces = long.join(begins, (F.col("key") == F.col("k")) & (F.col("run") == F.col("r"))).mapInPandas(replayed, f"key {kind}, block_no int, run int, own array<struct<part:string,line:string>>")
    own = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("run", "own"))), lambda x: x["own"]))
    return short.unionByName(pieces.groupBy("key", "block_no").agg(own.alias("own")).mapInPandas(joined, schema)).withColumnRenamed("key", key)


_INLINE = re.compile(r"`(?P<CODE>[^`]*)`|\*\*(?P<BOLD>.*?)\*\*|(?P<open>\*\*)|\*(?P<ITALIC>[^*]*)\*|(?P<mark>[`*])", re.S)


def inline(text: str | None) -> list[tuple[str, str]]:
    """(TEXT, BOLD, ITALIC or CODE, value) pieces of a text; a mark that nothing closes is text, of a piece of its own with what follows."""
    out: list[tuple[str, str]] = []
    at, held = 0, ""
    for m in _INLINE.finditer(text or ""):
        held += text[at : m.start()]
        if held:
            out.append(("TEXT", held))
        kind = m.lastgroup
        held = m[0] if kind in ("open", "mark") else ""
        if not held:
            out.append((kind, m[kind]))
        at = m.end()
    held += (text or "")[at:]
    return out + ([("TEXT", held)] if held else [])


def inline_tokens(text) -> F.Column:
    """inline() of a column."""

    @F.pandas_udf("array<struct<kind:string,value:string>>")
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"kind": k, "value": v} for k, v in inline(t)])

    return tokens(text)
