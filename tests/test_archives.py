import hashlib
import io
import zipfile

import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from driftline.model import Options
from driftline.operators import diff
from driftline.sources import archives


def zipped(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name.replace("__", "/"), data)
    return out.getvalue()


def packed(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def files(spark, **contents):
    return spark.createDataFrame([(f"x/{k}.zip", v) for k, v in contents.items()], "path string, content binary")


def nested(data, keep, extra=()):
    return packed([("lib/bundle.zip", packed([("deep/inner.zip", packed([("data.txt", data), ("keep.txt", keep), *extra]))]))])


def test_three_levels(spark, tmp_path):
    (tmp_path / "v1.zip").write_bytes(nested("one", "same"))
    (tmp_path / "v2.zip").write_bytes(nested("two", "same", [("new.txt", "new")]))
    rows = archives.flatten(archives.scan_archives(spark, f"file://{tmp_path}/*.zip"))
    side = lambda name: rows.where(F.col("snapshot_id") == name).select("key", "size", "sha256")
    got = {r.key: r.status for r in diff.snapshot_diff(side("v1.zip"), side("v2.zip")).collect()}
    base = "lib/bundle.zip/deep/inner.zip/"
    assert got == {f"{base}data.txt": "MODIFIED", f"{base}keep.txt": "UNCHANGED", f"{base}new.txt": "ADDED"}


def test_what_cannot_be_read_is_told(spark):
    good = packed([("a.txt", "a"), ("../up.txt", "x"), ("/abs.txt", "x"), ("c:evil.txt", "x"), ("inner.zip", b"not one")])
    rows = archives.flatten(archives.entries_of(files(spark, good=good, cut=good[:40], none=b""))).collect()
    of = lambda s: {r.key: r.error for r in rows if r.snapshot_id == f"{s}.zip"}
    assert of("good") == {"a.txt": None, "../up.txt": "unsafe name", "/abs.txt": "unsafe name", "c:evil.txt": "unsafe name", "inner.zip": "root: BadZipFile"}
    assert list(of("cut").values()) == ["root: BadZipFile"] and list(of("none").values()) == ["root: BadZipFile"]
    log = {r.snapshot_id: (r.ok, r.failed, r.incomplete) for r in archives.unpack_log(archives.entries_of(files(spark, good=good))).collect()}
    assert log == {"good.zip": (2, 3, False)}


def test_limits(spark):
    deep = b"end"
    for k in range(5):
        deep = packed([(f"l{k}.zip" if k else "end.txt", deep)])
    rows = archives.flatten(archives.entries_of(files(spark, deep=deep)), Options(max_depth=2)).collect()
    assert [r.error for r in rows] == ["too deep"]
    big = archives.entries_of(files(spark, big=packed([("a", "x" * 100), ("b", "y" * 10), ("c", "z" * 60)])), Options(max_entry_bytes=64, max_total_bytes=150)).collect()
    assert {r.key: r.error for r in big} == {"a": "over the limit", "b": None, "c": "over the limit"}


def test_folders_without_their_slash(spark):
    rows = archives.entries_of(files(spark, p=packed([("d", b""), ("d/x", "1"), ("e/", b""), ("empty", b"")]))).collect()
    assert sorted(r.key for r in rows) == ["d/x", "empty"]
    lines = archives.first_lines(archives.listing_lines(archives.entries_of(files(spark, p=packed([("d/x", "1"), ("d/e/y", "22")])))), 3).orderBy("line_no").collect()
    assert [r.line for r in lines] == ["           0 -------- d d/", "           0 -------- d d/e/", f"           2 {zipfile.crc32(b'22'):08x} - d/e/y"]


def test_office(spark):
    docx = packed([("word/document.xml", '<w:document xmlns:w="w"><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>there</w:t></w:r></w:p><w:p/><w:p><w:t>Bye</w:t></w:p></w:document>')])
    xlsx = packed([("xl/sharedStrings.xml", "<sst><si><t>name</t></si><si><r><t>v</t></r><r><t>al</t></r></si></sst>"),
                   ("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>7</v></c><c r="B2" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>')])
    pptx = packed([("ppt/slides/slide2.xml", "<sld><a:p xmlns:a='a'><a:t>second</a:t></a:p></sld>"), ("ppt/slides/slide1.xml", "<x><a:p xmlns:a='a'><a:t>first</a:t></a:p></x>")])
    bomb = packed([("word/document.xml", "<!DOCTYPE x [<!ENTITY a 'b'>]><w>&a;</w>")])
    store = packed([("a.docx", docx), ("b.xlsx", xlsx), ("c.pptx", pptx), ("d.docx", bomb), ("e.doc", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"), ("f.txt", "é".encode("gbk")), ("g.png", b"1")])
    rows = {r.key: (r.text, r.error) for r in archives.texts(archives.entries_of(files(spark, s=store))).collect()}
    assert rows["a.docx"] == ("Hello there\n\nBye", None)
    assert rows["b.xlsx"] == ("Row 1: A1=name | B1=val\nRow 2: A2=7 | B2=in", None)
    assert rows["c.pptx"] == ("first\nsecond", None)
    assert rows["d.docx"][0] is None and rows["e.doc"] == (None, "legacy office format")
    assert rows["f.txt"] == ("é", None) and "g.png" not in rows


def test_folder_scan(spark, tmp_path):
    for side, changed in (("l", "old"), ("r", "new")):
        (tmp_path / side / "sub/deep").mkdir(parents=True)
        (tmp_path / side / "sub/deep/a.txt").write_text(changed)
        (tmp_path / side / "same.txt").write_text("same")
    (tmp_path / "l/gone.txt").write_text("x")
    left, right = (archives.scan_folder(spark, f"file://{tmp_path}/{s}") for s in "lr")
    rows = {r.path: r for r in left.collect()}
    assert set(rows) == {"sub", "sub/deep", "sub/deep/a.txt", "same.txt", "gone.txt"} and rows["sub"].type == "DIR"
    assert rows["same.txt"].sha256 == hashlib.sha256(b"same").hexdigest() and rows["same.txt"].size == 4
    got = {r.path: (r.status, "CONTENT" in r.changes) for r in diff.folder_diff(left.drop("mtime_ms").withColumn("mtime_ms", F.lit(1)), right.drop("mtime_ms").withColumn("mtime_ms", F.lit(1))).collect()}
    assert got["sub/deep/a.txt"] == ("MODIFIED", True) and got["same.txt"] == ("SAME", False) and got["gone.txt"] == ("LEFT_ONLY", False) and got["sub"] == ("SAME", False)


@pytest.mark.parametrize("data", ["text", "é", "日本"])
def test_decode(data):
    assert archives.decode_text(data.encode()) == data
    assert archives.decode_text(b"\xff\xfe\xfa") == "\xff\xfe\xfa"


def test_a_task_hands_on_what_it_made_before_it_makes_more():
    """Of a batch that becomes 64 MB, no more than a frame and a row is there at a time."""
    made = []

    def blown_up(n):
        made.append(n)
        yield n, bytes(1 << 20)

    to = pa.schema([("n", pa.int64()), ("bytes", pa.binary())])
    rows = []
    for frame in archives.frames(iter([pa.RecordBatch.from_arrays([pa.array(range(64), pa.int64())], names=["n"])]), blown_up, to):
        assert frame.nbytes < archives.FRAME + (2 << 20) and len(made) - len(rows) <= archives.FRAME // (1 << 20) + 1
        rows += frame.column("n").to_pylist()
    assert rows == list(range(64))
