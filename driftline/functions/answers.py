"""Fields of answers that are nearly JSON: cut short, wrapped in prose, with other names.

A value is found by its name and read to where its brackets close, strings and escapes taken into account. A string that the cut
goes through is read to its end; a list or object that never closes isn't taken as a whole, but its first item's text is.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\\.|"(?:[^"\\]|\\.)*"?|[][{}]', re.S)
_STRING = re.compile(r'"(?:[^"\\]|\\.)*', re.S)
_CLOSED = re.compile(r'"((?:[^"\\]|\\.)*)"', re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
#: What the fields of an answer are called, by what they hold.
TEXTS = {"impact_scope": ("impactScope",), "context": ("contextInfluence", "上下文影响"), "intent": ("intent", "意图"), "impact": ("impact", "影响"), "suggestions": ("suggestions",), "rollback": ("rollbackPlan",)}
LISTS = {"themes": ("testThemes", "test_themes", "测试主题")}
FILES = ("fileRisks", "files", "file_risks")


def _key(text: str, name: str) -> int:
    """Where a name stands as a key; -1 if it doesn't."""
    m = re.search(rf'(?:(?<=[{{,\s])|\A)"{re.escape(name)}"', text)
    return m.start() if m else -1


def _closing(text: str, at: int) -> int:
    """Where the bracket at a place closes; -1 if it doesn't. Only its own kind counts."""
    opens, depth = text[at], 0
    closes = {"[": "]", "{": "}"}[opens]
    for m in _TOKEN.finditer(text, at):
        depth += (m[0] == opens) - (m[0] == closes)
        if depth == 0:
            return m.start()
    return -1


def _value(text: str, at: int, stops: str) -> tuple[str | None, int]:
    """(the JSON value at a place, where it ends); None if its brackets don't close."""
    if text[at] == '"':
        end = _STRING.match(text, at).end()
        return text[at : end + 1], min(end, len(text))
    if text[at] in "[{":
        end = _closing(text, at)
        return (text[at : end + 1], end + 1) if end > at else (None, at)
    end = next((i for i in range(at, len(text)) if text[i] in stops), len(text))
    return text[at:end], end


def value_of(text: str, name: str) -> str | None:
    at = _key(text, name)
    colon = text.find(":", at + len(name) + 2) if at >= 0 else -1
    if colon < 0:
        return None
    start = colon + 1 + len(text[colon + 1 :]) - len(text[colon + 1 :].lstrip(" \t\r\n"))
    return _value(text, start, ",}]\n\r")[0] if start < len(text) else None


def _strings(inner: str) -> list[str]:
    return [re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), m[1], flags=re.S) for m in _CLOSED.finditer(inner)]


def bodies(inner: str) -> list[str]:
    """The insides of a list's objects."""
    out, depth, start = [], 0, -1
    for m in _TOKEN.finditer(inner):
        if m[0] == "{":
            start = m.start() if depth == 0 else start
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if depth == 0 and start >= 0:
                out.append(inner[start + 1 : m.start()])
                start = -1
    return out


def _object_text(inner: str) -> str:
    lines, at = [], 0
    while (q := inner.find('"', at)) >= 0:
        end = _STRING.match(inner, q).end()
        colon = inner.find(":", end)
        if colon < 0:
            break
        start = colon + 1 + len(inner[colon + 1 :]) - len(inner[colon + 1 :].lstrip())
        raw, after = _value(inner, start, ",}") if start < len(inner) else ("", start)
        if raw is None:
            break
        value, name = re.sub(r"\n\s*", "\n", text_of(raw)).strip(), inner[q + 1 : end]
        lines.append(f"- {name}：\n" + "".join(f"  {x}\n" for x in value.split("\n")) if "\n" in value else f"- {name}：{value}")
        stop = next((i for i in range(after, len(inner)) if inner[i] in ",}"), len(inner))
        at = stop + (inner[stop : stop + 1] == ",")
        if at <= q:
            break
    return re.sub(r"\n{2,}", "\n", "\n".join(lines)).strip()


def text_of(raw: str) -> str:
    """A JSON value as lines of text: lists line by line, objects as `- name：value`."""
    t = raw.strip()
    if t.startswith("["):
        inner = t[1:-1]
        if inner.lstrip().startswith("{"):
            return "\n".join(x for x in map(_object_text, bodies(inner)) if x)
        return "\n".join(_strings(inner))
    if t.startswith("{"):
        return _object_text(t[1:-1])
    return t[1:-1] if len(t) >= 2 and t[0] == t[-1] == '"' else t


def scalar(text: str, name: str, default: str | None = "") -> str | None:
    """A field by lines: the string or number after its key, or what follows `name:`."""
    for line in text.split("\n"):
        at = _key(line, name)
        colon = line.find(":", at) if at >= 0 else -1
        if colon >= 0:
            rest = line[colon + 1 :].lstrip(" \t")
            found = re.match(r'"([^"]*)"', rest) if rest.startswith('"') else re.match(r"[^,}]+", rest)
            value = found and (found[1] if rest.startswith('"') else found[0].strip())
            if value:
                return value
        at = line.find(f"{name}:")
        if at >= 0:
            return re.sub("[\"',]", "", line[at + len(name) + 1 :].strip())
    return default


def field(text: str, *names: str) -> str:
    """The first of several fields that holds something, as text."""
    for name in names:
        raw = value_of(text, name)
        found = scalar(text, name) if raw is None else text_of(raw)
        if found:
            return found
    return ""


def _list_body(text: str, names: tuple[str, ...]) -> str | None:
    for name in names:
        at = _key(text, name)
        at = text.find("[", at) if at >= 0 else -1
        end = _closing(text, at) if at >= 0 else -1
        if end > at:
            return text[at + 1 : end]
    return None


def strings(text: str, *names: str) -> list[str]:
    inner = _list_body(text, names)
    return [] if inner is None else _strings(inner)


def objects(text: str, *names: str) -> list[str]:
    inner = _list_body(text, names)
    return [] if inner is None else bodies(inner)


def _of_object(body: str, *names: str) -> str:
    return next((v for v in (scalar(body, n, None) for n in names) if v), "")


def file_risks(text: str) -> list[dict[str, str]]:
    return [{"key": _of_object(o, "key", "fileName", "file") or "?", "risk": _of_object(o, "risk", "riskLevel") or "MEDIUM", "reason": _of_object(o, "oneLineReason", "reason", "description")} for o in objects(text, *FILES)]


def themes(text: str) -> list[str]:
    """What to test, from the list of it, or from lines of prose that speak of tests."""
    found = strings(text, *LISTS["themes"])
    if not found:
        lines = [x.strip() for x in text.split("\n")]
        found = [x[1:].strip() for x in lines if x.startswith("-") and any(w in x for w in ("测试", "回归", "验证"))]
    return found


def parsed(answer: Column) -> Column:
    """A struct of an answer's fields: risk, the TEXTS, themes and risks of files."""
    kind = "risk string, " + ", ".join(f"{n} string" for n in TEXTS) + ", themes array<string>, files array<struct<key:string,risk:string,reason:string>>"

    @F.pandas_udf(kind)
    def read(answers: pd.Series) -> pd.DataFrame:
        texts = answers.fillna("")
        return pd.DataFrame({"risk": [scalar(t, "overallRisk", "MEDIUM") for t in texts], **{n: [field(t, *names) for t in texts] for n, names in TEXTS.items()}, "themes": [themes(t) for t in texts], "files": [file_risks(t) for t in texts]})

    return read(answer)
