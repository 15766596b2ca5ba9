import random

import numpy as np
import pytest

from driftline.functions import mojibake
from driftline.operators import impact, report
from driftline.operators.quantiles import quantiles
from driftline.plans import content


def test_mojibake():
    plain = "这个系统的文件和配置的数据接口是不在有了修改。" * 3
    spoiled = plain.encode("utf-8").decode("gbk", errors="ignore")
    n, score, bad = mojibake.judge(spoiled)
    assert bad and score >= 0.5 and n == len(spoiled)
    assert mojibake.judge(plain)[2] is False and mojibake.judge("plain words")[0] == 0
    assert mojibake.turned_back("ab中cd")[1] in ("ab中cd",)
    # Parts that turn back are looked for among all, as long as they are.
    rng = random.Random(1)
    for _ in range(60):
        run = "".join(rng.choice("系统的鏂囦欢é鍜é閰嶇疆") for _ in range(rng.randint(1, 9)))
        out, i = "", 0
        if mojibake._turned(run) is None:
            while i < len(run):
                end = next((j for j in range(len(run), i, -1) if mojibake._turned(run[i:j]) is not None), None)
                out += run[i] if end is None else mojibake._turned(run[i:end])
                i = i + 1 if end is None else end
            assert mojibake.turned_back(run)[1] == out


@pytest.mark.parametrize("n", [1, 2, 999])
def test_quantiles(spark, n):
    rng = np.random.default_rng(n)
    values = np.concatenate([np.round(rng.lognormal(3, 2, n), 2), np.full(n, 5.0)])
    rows = [("a", float(v)) for v in values] + [(None, 1.0), ("b", None), ("c", 7.5)]
    got = {r.g: r for r in quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"p50": 0.5, "p99": 0.99}).collect()}
    assert got["a"].p50 == pytest.approx(np.quantile(values, 0.5)) and got["a"].p99 == pytest.approx(np.quantile(values, 0.99))
    assert got[None].p50 == 1.0 and got["c"].p99 == 7.5 and "b" not in got


def test_unsafe_keys_are_not_exported(spark):
    rows = spark.createDataFrame([("../A.class", "ADDED", "CLASS")], "key string, status string, file_class string")
    texts = spark.createDataFrame([("../A.class", "x")], "key string, text string")
    with pytest.raises(Exception, match="leaves its folder"):
        report.class_files(rows, texts, texts).collect()


def test_references(spark):
    sources = spark.createDataFrame([("c", "x.Caller", "x", ["y.Svc"], "Svc s;"), ("s", "y.Sibling", "y", [], "new Svc()"), ("f", "z.Full", "z", [], "y.Svc.run()"), ("n", "z.Named", "z", [], "Svc"), ("o", "y.Svc", "y", [], "class Svc")],
                                    "key string, fqn string, pkg string, imports array<string>, text string")
    targets = spark.createDataFrame([("y.Svc", True, False), ("y.Gone", True, False)], "target string, deleted boolean, signature_changed boolean")
    refs = impact.references(sources, targets)
    assert {r.source_key for r in refs.collect()} == {"c", "s", "f"}
    assert {r.target: (r.risk, r.n_refs) for r in impact.impact(targets, refs).collect()} == {"y.Svc": ("CRITICAL", 3), "y.Gone": ("LOW", 0)}


def test_group_quotas(spark):
    sf = "/root/testdata/sf0.01"
    need = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("source", "text").collect():
        need[r.source or "none"] = need.get(r.source or "none", 0) + len(r.text or "")
    left, want = content.OPTIONS.total_budget, {}
    for k, name in enumerate(sorted(need)):
        want[name] = min(need[name], left // (len(need) - k))
        left -= want[name]
    assert {r.source: r.quota for r in content.group_quotas(spark, sf).collect()} == want


def test_texts_are_judged_one_at_a_time(spark, monkeypatch):
    """No pandas copy of a batch of texts is made."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(F, "pandas_udf", None)
    bad = " ".join(w.encode().decode("gbk") for w in ["配置文件", "系统数据", "配置系统", "数据文件"])
    rows = spark.createDataFrame([("plain",), (bad,)], "t string").select("t", mojibake.judged(F.col("t")).alias("j")).collect()
    assert [tuple(r.j) for r in rows] == [mojibake.judge("plain"), mojibake.judge(bad)] and rows[1].j.bad
