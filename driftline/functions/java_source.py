"""Outlines of Java sources: what a class offers to others, and a form that doesn't change with order, layout and comments.

Sources are cut into tokens; types and their members are found by brackets, bodies are not looked into. Whatever isn't balanced or
has no type is no source: None.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a source that is looked at, at most.
LONGEST = 2_000_000
_TOKEN = re.compile(r"""//[^\n]*|/\*.*?\*/|\"\"\".*?\"\"\"|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|[\w$]+(?:\.\d[\w]*)?|\.\.\.|\s+|.""", re.S)
_KINDS = ("class", "interface", "enum", "record")
# Modifiers of types and members.
_MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed"}
_CLOSES = {"(": ")", "[": "]", "{": "}"}


@dataclass
class Type:
    """A class, interface, enum or record: members as (kind, tokens), and the types inside."""

    name: str
    kind: str
    constants: list[str] = field(default_factory=list)
    members: list[tuple[str, list[str]]] = field(default_factory=list)
    inner: list[Type] = field(default_factory=list)


class Broken(ValueError):
    """Brackets that don't match, or text that can't be a source."""


def tokens(source: str) -> list[str]:
    out = []
    for t in _TOKEN.findall(source):
        if t.isspace() or t.startswith("//") or (t.startswith("/*") and len(t) > 3):
            continue
        if t in ('"', "'") or t.startswith("/*"):
            raise Broken("an open text or comment")
        out.append(t)
    return out


def _close(ts: list[str], at: int) -> int:
    """Where the bracket at `at` closes."""
    stack = []
    for i in range(at, len(ts)):
        if ts[i] in _CLOSES:
            stack.append(_CLOSES[ts[i]])
        elif ts[i] in (")", "]", "}"):
            if not stack or stack.pop() != ts[i]:
                raise Broken("brackets")
            if not stack:
                return i
    raise Broken("brackets")


def _angle(ts: list[str], at: int) -> int:
    """Where type arguments that open at `at` close."""
    depth = 0
    for i in range(at, len(ts)):
        depth += (ts[i] == "<") - (ts[i] == ">")
        if depth == 0:
            return i
    raise Broken("type arguments")


def _after_head(ts: list[str]) -> int:
    """Past annotations, modifiers and type parameters."""
    at = 0
    while at < len(ts):
        if ts[at] == "@" and at + 1 < len(ts) and ts[at + 1] != "interface":
            at += 2
            while at + 1 < len(ts) and ts[at] == ".":
                at += 2
            at = _close(ts, at) + 1 if at < len(ts) and ts[at] == "(" else at
        elif ts[at] in _MODIFIERS:
            at += 1
        elif ts[at] == "<":
            at = _angle(ts, at) + 1
        else:
            break
    return at


def _kind_of(ts: list[str]) -> str | None:
    """The kind of type that a declaration's tokens begin, if any."""
    at = _after_head(ts)
    if ts[at : at + 2] == ["@", "interface"]:
        return "interface"
    if at + 1 < len(ts) and ts[at] in _KINDS and re.match(r"[\w$]+$", ts[at + 1]) and (ts[at] != "record" or "(" in ts[at + 2 :][:1] + ts[at + 3 :][:1]):
        return ts[at]
    return None


def _type(head: list[str], body: list[str], kind: str) -> Type:
    at = _after_head(head)
    own = Type(head[at + (2 if head[at] == "@" else 1)], kind)
    own.members.append(("HEAD", head))
    if kind == "enum":
        end = next((i for i, t in _flat(body) if t == ";"), len(body))
        own.constants = [part[_after_head(part)] for part in _split(body[:end], ",") if part]
        own.members += [("CONSTANT", part) for part in _split(body[:end], ",") if part]
        body = body[end + 1 :]
    _members(body, own)
    return own


def _flat(ts: list[str]) -> Iterator[tuple[int, str]]:
    """(place, token) outside brackets."""
    i = 0
    while i < len(ts):
        yield i, ts[i]
        i = _close(ts, i) + 1 if ts[i] in _CLOSES else i + 1


def _split(ts: list[str], by: str) -> list[list[str]]:
    """Parts between separators outside brackets and type arguments."""
    out, depth, last = [[]], 0, -1
    for i, t in _flat(ts):
        depth += (t == "<") - (t == ">")
        if t == by and depth <= 0:
            out[-1] = ts[last + 1 : i]
            out.append([])
            last = i
    out[-1] = ts[last + 1 :]
    return out


def _members(ts: list[str], own: Type) -> None:
    begin = at = 0
    assigned = False
    while at < len(ts):
        t = ts[at]
        assigned = assigned or t == "="
        if t == ";":
            if at > begin:
                own.members.append(("METHOD" if not assigned and "(" in ts[begin:at] else "VARIABLE", ts[begin : at + 1]))
            begin, assigned = at + 1, False
        elif t in _CLOSES:
            end = _close(ts, at)
            if t == "{" and not assigned:
                kind = _kind_of(ts[begin:at])
                if kind:
                    own.inner.append(_type(ts[begin:at], ts[at + 1 : end], kind))
                else:
                    own.members.append(("METHOD" if "(" in ts[begin:at] else "BLOCK", ts[begin : end + 1]))
                begin = end + 1
            at = end
        at += 1
    if begin < len(ts):
        raise Broken("a member without its end")


def outline(source: str | None) -> tuple[str, list[Type]] | None:
    """(package, types) of a source."""
    if not source or len(source) > LONGEST:
        return None
    try:
        ts = tokens(source)
        holder = Type("", "file")
        _members(ts, holder)
    except (Broken, IndexError):
        return None
    package = next(("".join(m[1:-1]) for _, m in holder.members if m[:1] == ["package"]), "")
    if any(m[0] not in ("package", "import") for _, m in holder.members) or not holder.inner:
        return None
    return package, holder.inner


def _written(ts: list[str]) -> str:
    """Tokens of a type as one writes them."""
    return re.sub(r" ?([<\[\]().]|\.\.\.) ?", r"\1", re.sub(r" (?=[,>])", "", " ".join(ts)))


def _signature(member: list[str], kind: str, owner: Type) -> list[str]:
    at = _after_head(member)
    if not {"public", "protected"} & {t for i, t in _flat(member[:at])}:
        return []
    rest = member[at:]
    if kind == "METHOD":
        open_ = next(i for i, t in enumerate(rest) if t == "(")
        name, returns = rest[open_ - 1], rest[: open_ - 1]
        close = _close(rest, open_)
        types = []
        for p in _split(rest[open_ + 1 : close], ","):
            p = p[_after_head(p) :]
            if p:
                dims = [t for t in p[p.index("[") :]] if p[-1] == "]" and re.match(r"[\w$]+$", p[p.index("[") - 1]) and len(p) - p.index("[") <= 2 and p.index("[") > 1 else []
                types.append(_written(p[: len(p) - len(dims) - 1] + dims))
        return [f"{name if returns else '<init>'}({','.join(types)}):{_written(returns) or 'void'}"]
    if kind == "VARIABLE":
        parts = _split([t for t in rest if t != ";"], ",")
        first = next((i for i, t in _flat(parts[0]) if t == "="), len(parts[0]))
        type_, names = parts[0][: first - 1], [parts[0][first - 1], *(p[0] for p in parts[1:])]
        return [f"{n}:{_written(type_)}" for n in names]
    return []


def apis(source: str | None) -> list[tuple[str, str]] | None:
    """(class, signature) of what is public or protected, in the order of the source; classes by full name."""
    found = outline(source)
    if not found:
        return None
    out: list[tuple[str, str]] = []

    def visit(t: Type, outer: str) -> None:
        name = f"{outer}.{t.name}" if outer else t.name
        out.extend((name, f"{c}:{t.name}") for c in t.constants)
        for kind, member in t.members:
            out.extend((name, s) for s in _signature(member, kind, t))
        for inner in t.inner:
            visit(inner, name)

    for t in found[1]:
        visit(t, found[0])
    return list(dict.fromkeys(out))


def normal_form(source: str | None) -> str | None:
    """Members sorted by kind and text, inner types as wholes among them."""
    found = outline(source)
    if not found:
        return None

    def form(t: Type) -> str:
        parts = [f"{kind}:{' '.join(m)}" for kind, m in t.members] + [f"CLASS:{form(i)}" for i in t.inner]
        return "\n".join(sorted(parts))

    return "\n".join(sorted(map(form, found[1])))


def outlines(sources: DataFrame) -> DataFrame:
    """(cls, api, ordinal) of sources (key, text)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(cls, api, n) for text in batch["text"] for n, (cls, api) in enumerate(apis(text) or [])]
            yield pd.DataFrame(rows, columns=["cls", "api", "ordinal"])

    return sources.select("text").mapInPandas(read, "cls string, api string, ordinal long")


def normal_digest(text: Column) -> Column:
    """SHA-256 of a source's normal form; null where it has none."""

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        return texts.map(normal_form)

    return F.sha2(form(text), 256)
