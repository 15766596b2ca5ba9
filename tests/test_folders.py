import hashlib
import os

from driftline.model import Options
from driftline.operators import diff
from driftline.sources import folders


def build(root, files):
    for name, data in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)


FILES = {"a.txt": b"a", "web/index.html": b"<html>", "web/js/deep/x.min.js": b"1;", ".git/HEAD": b"ref", "web/.git/y": b"y", "Ünï/ß.java": b"class", "empty.txt": b"", "a..b/c.txt": b"bad", "big.txt": b"x" * 100}


def tree(tmp_path):
    root = tmp_path / "tree"
    build(root, FILES)
    (root / "hollow" / "inner").mkdir(parents=True)
    os.symlink(root, root / "loop")
    os.symlink(root / "a.txt", root / "web" / "link.txt")
    os.symlink("nowhere", root / "dangling")
    os.mkfifo(root / "pipe")
    return root


def test_what_is_listed(spark, tmp_path):
    root = tree(tmp_path)
    for subtrees in (1, 2, 5, 256):
        rows = {r.path: r for r in folders.listed(spark, str(root), pruned=(".git",), subtrees=subtrees).collect()}
        assert set(rows) == {"a.txt", "web", "web/index.html", "web/js", "web/js/deep", "web/js/deep/x.min.js", "Ünï", "Ünï/ß.java", "empty.txt", "a..b", "big.txt", "hollow", "hollow/inner"}
        assert {p for p, r in rows.items() if r.error} == {"a..b"} and rows["a..b"].error == "unsafe name"
        assert all(r.type == ("DIR" if os.path.isdir(root / p) else "FILE") and r.size == (0 if r.type == "DIR" else os.path.getsize(root / p)) for p, r in rows.items())
        assert all(r.mtime_ms == os.stat(root / p).st_mtime_ns // 1_000_000 for p, r in rows.items())


def test_depth(spark, tmp_path):
    root = tree(tmp_path)
    for depth in (1, 2, 3):
        for subtrees in (1, 4, 256):
            found = {r.path for r in folders.listed(spark, f"file://{root}", depth=depth, subtrees=subtrees).collect()}
            every = {r.path for r in folders.listed(spark, str(root)).collect()}
            assert found == {p for p in every if p.count("/") < depth}


def test_digests_errors_and_limits(spark, tmp_path):
    root = tree(tmp_path)
    rows = folders.listed(spark, str(root)).collect()
    gone = spark.createDataFrame(rows, folders.LISTED)
    os.remove(root / "web/index.html")
    got = {r.path: r for r in folders.digests(gone, str(root), Options(hash_limit=50)).collect()}
    assert got["web/index.html"].error == "read: FileNotFoundError" and got["web/index.html"].sha256 is None
    assert got["big.txt"].sha256 is None and got["big.txt"].error is None
    assert got["a.txt"].sha256 == hashlib.sha256(b"a").hexdigest() and got["web"].sha256 is None
    assert {r.path for r in folders.errors(spark.createDataFrame(list(got.values()), folders.LISTED + ", sha256 string")).collect()} == {"web/index.html", "a..b"}


def test_snapshot_has_folders_with_files_only(spark, tmp_path):
    root = tree(tmp_path)
    rows = {r.key: r for r in folders.snapshot(folders.scan(spark, str(root), Options(hash_limit=50)), Options(hash_limit=50)).collect()}
    assert {k for k in rows if k.endswith("/")} == {"web/", "web/js/", "web/js/deep/", ".git/", "web/.git/", "Ünï/"}
    assert all(rows[k].sha256 == "dir" and rows[k].file_class == "FOLDER" and rows[k].size == 0 for k in rows if k.endswith("/"))
    assert rows["big.txt"].file_class == "OTHER" and rows["big.txt"].sha256 is None and rows["Ünï/ß.java"].file_class == "OTHER" and rows["web/js/deep/x.min.js"].file_class == "JS"
    assert not any("..b" in k for k in rows)


def test_two_folders(spark, tmp_path):
    left, right = tmp_path / "l", tmp_path / "r"
    build(left, {"same.txt": b"1", "changed.txt": b"1", "touched.txt": b"1", "old/only.txt": b"1", "kind": b"file"})
    build(right, {"same.txt": b"1", "changed.txt": b"22", "touched.txt": b"1", "new/only.txt": b"1", "kind/x": b"1"})
    for side in (left, right):
        for d, _, names in os.walk(side):
            for n in names:
                os.utime(os.path.join(d, n), (1e9, 2e9 if n == "touched.txt" and side == right else 1e9))
    scan = lambda p: folders.scan(spark, str(p))
    got = {r.path: (r.status, r.changes) for r in diff.folder_diff(scan(left), scan(right)).collect()}
    assert got == {"same.txt": ("SAME", []), "changed.txt": ("MODIFIED", ["SIZE", "CONTENT"]), "touched.txt": ("MODIFIED", ["MTIME"]), "old": ("LEFT_ONLY", []), "old/only.txt": ("LEFT_ONLY", []),
                   "new": ("RIGHT_ONLY", []), "new/only.txt": ("RIGHT_ONLY", []), "kind": ("TYPE_MISMATCH", ["TYPE"]), "kind/x": ("RIGHT_ONLY", [])}


def test_no_folder(spark, tmp_path):
    import pytest

    with pytest.raises(Exception, match="no folder"):
        folders.listed(spark, str(tmp_path / "none")).collect()
    (tmp_path / "bare").mkdir()
    assert folders.scan(spark, str(tmp_path / "bare")).count() == 0


def test_tasks_remove_the_files_they_found(spark, tmp_path):
    """Files go by tasks, so the driver is left with folders only; what was not found stays."""
    from driftline.plans import trees

    root = str(tmp_path / "r")
    trees.write_files(spark.range(50).selectExpr("concat('d', id % 3, '/f', id) AS path", "repeat('ä', 9) AS text", "1600000000 + id AS time"), root)
    found = folders.scan(spark, root)
    (tmp_path / "r/d0/later").write_text("x")
    trees.remove_files(found, root)
    assert found.where("type = 'FILE'").count() == 50 and [str(p.relative_to(root)) for p in (tmp_path / "r").rglob("*") if p.is_file()] == ["d0/later"]
