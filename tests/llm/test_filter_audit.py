import re
from itertools import permutations

from pyspark.sql import functions as F

from driftline.llm import filter_audit as fa


def fails(text, doc_id, texts):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {f for f, bad in {
        "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)),
        "E": doc_id is not None and any(i is not None and i < doc_id and t == text for i, t in texts)}.items() if bad}


def brute(docs, labels):
    texts = [(i, t or "") for i, t, _ in docs]
    good, toxic = ({i for i, *m in labels if i is not None and m[k] == 1} for k in (0, 1))
    cells = [(s or "", i, fails(t or "", i, texts)) for i, t, s in docs]
    out = {}
    for part in {c[0] for c in cells}:
        own = [c for c in cells if c[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [c for c in left if f in c[2]]
                left = [c for c in left if f not in c[2]]
                shapley[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in c[2] for c in own) - len(gone), sum(c[2] == {f} for c in own), sum(c[1] in good for c in gone), sum(c[1] in toxic for c in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


PROSE = " ".join(f"w{k}" for k in range(60))
DOCS = [
    (5, PROSE, "s"), (7, PROSE, "s"), (7, PROSE, None), (9, PROSE, "t"), (None, PROSE, "t"), (1, None, None), (2, "", ""), (3, "a b", "s"), (4, "A B c " * 30, "s"), (6, PROSE.upper(), "t"), (8, PROSE + " #", "s"),
    (10, "é ü " * 80, "u"), (11, PROSE + " $ " + PROSE, "u"), (12, "x" * 200_000, "u"), (13, "X\x0b" * 5000, "u"), (14, "a\x1fb " * 60, "s"), (5, PROSE, "s"), (None, None, "s")]
LABELS = [(5, 1, 0), (5, None, 1), (7, 0, 1), (None, 1, 1), (8, 1, None), (4, 1, 1), (99, 1, 1)]


def both(spark, docs, labels):
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, source string, cell int, part int")
    m = spark.createDataFrame([(*x, "x") for x in labels], "doc_id long, quality int, toxic int, label string")
    return fa.audit(fa.judged(fa.measure(d), m))


def rows(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_against_brute_force(spark):
    found = both(spark, DOCS, LABELS)
    assert found.count() == 600 * len({s or "" for _, _, s in DOCS})
    assert rows(found) == brute(DOCS, LABELS)


def test_many_parts_are_sent_in_pieces(spark):
    docs = [(i, "a b" if i % 2 else PROSE, f"s{i % 9}") for i in range(60)]
    cells = spark.createDataFrame(docs, "doc_id long, text string, source string")
    cells = fa.judged(fa.measure(cells), spark.createDataFrame([], "doc_id long, quality int, toxic int")).coalesce(1)
    pieces = fa.partial_sums(cells.union(cells), 4)
    assert pieces.count() >= 9 * 600 and pieces.groupBy().agg(F.sum("docs")).first()[0] == 120 * 600
    assert rows(fa.audit(cells)) == brute(docs, [])


def test_first_failures():
    for k, order in enumerate(fa.ORDERS):
        for cell in range(32):
            steps = [s for s, f in enumerate(order, 1) if cell >> "ABCDE".index(f) & 1]
            assert fa.FIRST[cell, k] == min(steps, default=0)


def test_empty(spark):
    d, m = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit(fa.judged(fa.measure(d), m)).count() == 0


def test_copies_of_a_third(spark):
    """A hot text meets one row of minima, and no pairs are made."""
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy").otherwise(F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    cells = fa.judged(fa.measure(docs), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert cells.count() == 30_000 and cells.where("cell >= 16").count() == 9_999
