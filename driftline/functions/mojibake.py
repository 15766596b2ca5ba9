"""Texts whose UTF-8 bytes somebody read as GBK."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_RUN = re.compile(r"[^\x00-\x7f]+")
# Fixed value: words that tell a text that reads well.
COMMON = ("的", "是", "不", "了", "在", "有", "和", "文件", "配置", "系统", "数据", "接口", "修改", "新增", "删除")
LEAST, THRESHOLD = 8, 0.5


def _turned(run: str) -> str | None:
    try:
        return run.encode("gbk").decode("utf-8")
    except UnicodeError:
        return None


def turned_back(text: str) -> tuple[float, str]:
    """(share of runs of other than ASCII that turn back, the text with them turned); a run of which only parts do counts half."""
    clean, total, out, last = 0.0, 0, [], 0
    for m in _RUN.finditer(text):
        run, total = m.group(), total + 1
        whole = _turned(run)
        if whole is not None:
            clean += 1
        else:
            whole, i, hit = [], 0, False
            while i < len(run):
                # A character of UTF-8 has at most four bytes, so a part that turns back splits into parts of four at most.
                end = next((j for j in range(min(len(run), i + 4), i, -1) if _turned(run[i:j]) is not None), None)
                hit = hit or end is not None
                whole.append(run[i] if end is None else _turned(run[i:end]))
                i = i + 1 if end is None else end
            clean += 0.5 * hit
            whole = "".join(whole)
        out += [text[last : m.start()], whole]
        last = m.end()
    return (clean / total if total else 0.0), "".join([*out, text[last:]])


def judge(text: str) -> tuple[int, float, bool]:
    """(characters other than ASCII, score, whether the text is mojibake): most runs turn back and more common words come out."""
    n = sum(map(len, _RUN.findall(text)))
    if n < LEAST:
        return n, 0.0, False
    score, turned = turned_back(text)
    hits = lambda t: sum(map(t.count, COMMON))
    return n, round(score, 3), score >= THRESHOLD and hits(turned) > hits(text)


def judged(text: Column) -> Column:
    """judge() of a column."""

    @F.arrow_udf("non_ascii long, score double, bad boolean")
    def of(texts: pa.Array) -> pa.Array:  # one text at a time is a Python object
        found = [judge(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([x[c] for x in found], kind) for c, kind in enumerate((pa.int64(), pa.float64(), pa.bool_()))], names=["non_ascii", "score", "bad"])

    return of(text)
