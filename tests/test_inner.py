import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from driftline.functions import versions
from driftline.sources import inner


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(zipfile.ZipInfo(name), zipped(data) if isinstance(data, dict) else data)
    return out.getvalue()


def by_hand(old, new, depth=12, most=20_000):
    """Nodes in order, one archive after the other, as a plain walk visits them."""
    rows, count = [], 0

    def opened(data):
        return inner.listing(data) if data is not None else {}

    def entry(data, name):
        if data is None:
            return None
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            found = inner.resolved(z.namelist(), name)
            return z.read(found) if found and not found.endswith("/") else None

    def walk(key, o, n, level):
        nonlocal count
        if level >= depth:
            return
        a, b = opened(o), opened(n)
        def status(x):
            if x in a and x in b:
                return 3 if x.endswith("/") or a[x] == b[x] else 0
            return 1 if x in a else 2
        for name in sorted(a.keys() | b.keys(), key=lambda x: (status(x), x)):
            count += 1
            if count > most:
                return
            rows.append((count, f"{key}!/{name}", level, ["MODIFIED", "DELETED", "ADDED", "UNCHANGED"][status(name)]))
            if name.endswith((".zip", ".jar")):
                walk(f"{key}!/{name}", entry(o, name), entry(n, name), level + 1)

    walk("r", old, new, 0)
    return rows


def tree(spark, old, new, **limits):
    frame = lambda x: spark.createDataFrame([("r", x)] if x is not None else [], "root string, bytes binary")
    return sorted((r.at, r.key, r.depth, r.status) for r in inner.tree(frame(old), frame(new), **limits).collect())


OLD = {"b.txt": b"1", "empty/": b"", "fake": b"", "fake/x": b"x", "lib/core-1.0.jar": {"A.class": b"a", "sub.zip": {"t.txt": b"t", "u.txt": b"u"}}, "in.zip": {"x.txt": b"x", "deep.zip": {"y.txt": b"y", "z.zip": {"w": b"w"}}}, "gone.zip": {"g": b"g"}}
NEW = {"b.txt": b"22", "c.txt": b"3", "lib/core-2.0.jar": {"A.class": b"b", "sub.zip": {"t.txt": b"t"}}, "in.zip": {"x.txt": b"x", "deep.zip": {"y.txt": b"changed", "z.zip": {"w": b"w"}}}}


@pytest.mark.parametrize("limits", [{}, {"most": 7}, {"most": 12}, {"depth": 1}, {"depth": 2, "most": 9}])
def test_three_levels(spark, limits):
    got, want = tree(spark, zipped(OLD), zipped(NEW), **limits), by_hand(zipped(OLD), zipped(NEW), **limits)
    assert got == want and (limits or len(got) > 20)


def test_one_side_and_what_overflows(spark):
    rng = random.Random(3)
    many = {f"a{k}.zip": {f"f{i}.txt": bytes([rng.randrange(3)]) for i in range(30)} for k in range(12)}
    other = {f"a{k}.zip": {f"f{i}.txt": bytes([rng.randrange(3)]) for i in range(30)} for k in range(3, 15)}
    for most in (1, 13, 50, 137, 400):
        assert tree(spark, zipped(many), zipped(other), most=most) == by_hand(zipped(many), zipped(other), most=most)
    assert tree(spark, zipped(OLD), None) == by_hand(zipped(OLD), None)


def test_broken_and_ignored(spark):
    frame = lambda x: spark.createDataFrame([("r", zipped(x))], "root string, bytes binary")
    found = inner.tree(frame({"x.zip": b"none", "y.MF": b"1", "z.zip": {"M.mf": b"1", "n.txt": b""}}), frame({}), spark.createDataFrame([(".mf",)], "ext string"))
    assert {(r.key, r.error) for r in found.collect()} == {("r!/x.zip", "BadZipFile"), ("r!/z.zip", None), ("r!/z.zip!/n.txt", None)}


def test_addresses(spark):
    files = spark.createDataFrame([("s", "a.zip", zipped(OLD)), ("s", "app-1.0.zip", zipped({"q": b"q"})), ("t", "app-1.0.zip", zipped({"q": b"q"})), ("t", "app-1.1.zip", zipped({"q": b"r"}))], "snapshot string, name string, bytes binary")
    want = {("s", "a.zip!/b.txt"): b"1", ("s", "a.zip!/in.zip!/deep.zip!/z.zip!/w"): b"w", ("s", "a.zip!/lib/core-9.9.jar!/sub.zip!/u.txt"): b"u", ("s", "app-2.0.zip!/q"): b"q", ("t", "app-2.0.zip!/q"): None,
            ("t", "app-1.1.zip!/q"): b"r", ("s", "a.zip!/none"): None, ("s", "none.zip!/x"): None, ("s", "a.zip!/b.txt!/c"): None, ("s", "a.zip!/lib/"): None}
    got = inner.inner_bytes(files, spark.createDataFrame(list(want), "snapshot string, key string"))
    assert {(r.snapshot, r.key): r.bytes and bytes(r.bytes) for r in got.collect()} == want


def test_units_by_class(spark):
    side = lambda rows: spark.createDataFrame(rows, "key string, bytes binary")
    old = [("a!/x.txt", b"1\n2"), ("a!/x.class", b"\xca\xfe"), ("a!/in.zip", zipped({"p": b"1"})), ("a!/bad.zip", b"no"), ("a!/gone.js", b"var a;"), ("a!/x.doc", b"\xd0\xcf"), ("a!/no.txt", None)]
    new = [("a!/x.txt", b"1\n3"), ("a!/x.class", b"\xca\xff"), ("a!/in.zip", zipped({"p": b"2", "q/r": b""})), ("a!/bad.zip", b"no"), ("a!/no.txt", None)]
    found = inner.units(side(old), side(new))
    got = {r.key: r for r in found.collect()}
    assert {k: (r.engine, r.error) for k, r in got.items()} == {"a!/x.txt": ("text-normalize", None), "a!/x.class": (None, "CLASS has no text"), "a!/in.zip": ("archive-listing", None), "a!/bad.zip": (None, "BadZipFile"),
                                                                "a!/gone.js": ("js-beautify", None), "a!/x.doc": (None, "legacy office format"), "a!/no.txt": (None, "on neither side")}
    assert got["a!/in.zip"].new_lines == ["           1 1ad5be0d - p".replace("1ad5be0d", format(__import__("zlib").crc32(b"2"), "08x")), "           0 -------- d q/", "           0 00000000 - q/r"]
    assert got["a!/gone.js"].new_hash == "0000000" and len(got["a!/gone.js"].old_hash) == 7
    ops = {}
    for r in sorted(inner.unit_lines(found).collect(), key=lambda r: r.pos):
        ops.setdefault(r.key, []).append((r.op, r.text))
    assert ops["a!/x.txt"] == [("ctx", "1"), ("del", "2"), ("add", "3")] and ops["a!/gone.js"] == [("del", "var a;")] and [o for o, _ in ops["a!/in.zip"]] == ["del", "add", "add", "add"]


def test_versions_of_strings(spark):
    names = ["app-1.0.zip", "core-036M059(20260101-0900).jar", "x.zip", "lib-2.0-SNAPSHOT.jar", "BEMP5.0-adapterV202301-02-036M059(20260703-1104).zip", ".hidden1.0", "a.b", "log4j2.jar", "v1.zip", "abc12", "abcd12x3(4)-z.war", "é1.0.zip"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", versions.version(F.col("n")).alias("v"), versions.base_name(F.col("n")).alias("b")).collect()
    assert [(r.v, r.b) for r in rows] == [(versions.file_version(n), versions.file_base(n)) for n in names]


def test_small_archives_are_made_many_at_a_time(spark, monkeypatch):
    """Archives of two documents are made twenty in a group, each with its own."""
    from driftline.plans import trees

    monkeypatch.setattr(trees, "cut", lambda df: df)
    packs = trees._packed(spark, "/root/testdata/sf0.001", lambda side, pack, docs: f"{pack}:{[i for i, _ in docs]}".encode(), 2)
    assert "FlatMapGroupsInPandas [held" in packs._jdf.queryExecution().executedPlan().toString()
    ids = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.doc_id is not None}
    want = {f"p{k}.zip": f"{k}:{sorted(i for i in ids if i // 2 == k and i % 13 != 4)}".encode() for k in {i // 2 for i in ids}}
    assert {r.root: bytes(r.old) for r in packs.collect()} == want


def test_versions_side_by_side(spark):
    """What is read of two versions at once is what is read of each, as deep as the keys lead, and whether names are given or taken from the files."""
    keys = spark.createDataFrame([("s", f"{top}!/{way}" if way else top) for top in ("a.zip", "app-2.0.zip", "old.zip", "new.zip", "none.zip")
                                  for way in ("", "b.txt", "c.txt", "in.zip", "in.zip!/x.txt", "in.zip!/deep.zip!/y.txt", "in.zip!/deep.zip!/z.zip!/w", "lib/core-1.0.jar!/A.class", "lib/core-1.0.jar!/sub.zip!/u.txt", "b.txt!/c", "lib/", "none")], "snapshot string, key string")
    boxes = [("s", "a.zip", zipped(OLD), zipped(NEW)), ("s", "app-1.0.zip", zipped(NEW), b"no archive"), ("s", "old.zip", zipped(OLD), None), ("s", "new.zip", None, zipped(OLD))]
    files = spark.createDataFrame(boxes, "snapshot string, name string, old binary, new binary")
    for names in (None, files.select("snapshot", "name")):
        got = {r.key: (r.old and bytes(r.old), r.new and bytes(r.new)) for r in inner.inner_bytes(files, keys, missing=False, names=names).collect()}
        want = [{r.key: r.bytes and bytes(r.bytes) for r in inner.inner_bytes(files.select("snapshot", "name", F.col(c).alias("bytes")), keys).collect()} for c in ("old", "new")]
        assert got == {k: (want[0][k], want[1][k]) for k in want[0] if want[0][k] is not None or want[1][k] is not None} and len(got) > 20
    assert got["a.zip!/lib/core-1.0.jar!/A.class"] == (b"a", b"b") and got["app-2.0.zip"][1] == b"no archive" and got["new.zip!/b.txt"] == (None, b"1")


def test_units_of_pairs(spark):
    """Versions side by side have the units that they have apart."""
    rows = [("a!/x.txt", b"1\n2", b"1\n3"), ("a!/x.class", b"\xca\xfe", b"\xca\xff"), ("a!/in.zip", zipped({"p": b"1"}), zipped({"p": b"2", "q/r": b""})), ("a!/bad.zip", b"no", b"no"), ("a!/half.zip", zipped({}), b"no"), ("a!/gone.js", b"var a;", None),
            ("a!/min.js", b"var a;" * 500, b"var a;" * 501), ("a!/x.html", b"<a></a>", b"<a></a><b>"), ("a!/x.doc", b"\xd0\xcf", None), ("a!/no.txt", None, None), ("a!/empty.txt", b"", None), ("a!/x.docx", None, zipped({"word/document.xml": b"<p><t>z</t></p>"}))]
    pairs = spark.createDataFrame(rows, "key string, old binary, new binary")
    apart = inner.units(*(pairs.select("key", F.col(c).alias("bytes")) for c in ("old", "new")))
    assert sorted(map(repr, inner.pair_units(pairs).collect())) == sorted(map(repr, apart.collect())) and apart.columns == inner.pair_units(pairs).columns


@pytest.mark.parametrize("name", ["office_diff", "inner_diff", "inner_read"])
def test_archives_are_shuffled_once(spark, monkeypatch, name):
    """However many names are asked, texts are shuffled to be packed and archives to meet their keys, and neither again; archives are not kept."""
    import re

    from driftline.plans import trees

    monkeypatch.setattr(inner, "NAMES", 0)
    kept, cut = [], inner.cut
    for module in (inner, trees):
        monkeypatch.setattr(module, "cut", lambda df: kept.append(df.dtypes) or cut(df))
    df = trees.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    moved = [set(re.findall(r"(\w+)#", x)) for x in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)]
    assert sorted(sorted(x & {"text", "bytes", "old", "new", "old_sha", "lines", "max"}) for x in moved if x & {"text", "bytes", "old", "new", "old_sha", "lines", "max"}) == [["new", "old"], ["text"]]
    assert not [t for t in kept if "binary" in dict(t).values()]
