import random
import time

from driftline.functions import versions
from driftline.operators import align, diff
from driftline.functions.text import version_normalized_path
from pyspark.sql import functions as F


def snap(spark, rows):
    return spark.createDataFrame([(k, len(h), h, h) for k, h in rows], "key string, size long, sha256 string, content_key string")


def aligned(spark, old, new):
    return {r.key: (r.new_key, r.status, r.match_kind) for r in align.align(diff.snapshot_diff(snap(spark, old), snap(spark, new), ("content_key",))).collect()}


def by_hand(deleted, added, skeleton):
    """One after the other, over all candidates."""
    left, out = list(added), {}
    for d in sorted(deleted):
        fit = [a for a in left if versions.equivalent_paths(d, a)]
        strict = [a for a in fit if skeleton[a] == skeleton[d]]
        pick = strict or fit
        if len(pick) == 1:
            out[d] = pick[0]
            left.remove(pick[0])
    return out


def test_pairs_of_one_content_are_those_found_one_by_one(spark):
    rng = random.Random(7)
    for trial in range(4):
        old = {f"root-{rng.choice(['036M059', '036M060', '1.2'])}/{rng.choice(['core', 'core2', 'web'])}/file-{rng.randint(1, 9)}.{rng.randint(0, 3)}.txt" for _ in range(40)}
        new = {f"root-{rng.choice(['036M061', '036M062', '1.3'])}/{rng.choice(['core', 'core3', 'web'])}/file-{rng.randint(1, 9)}.{rng.randint(0, 3)}.txt" for _ in range(40)}
        gone, fresh = old - new, new - old
        frame = lambda keys: spark.createDataFrame([(k, "same") for k in keys], "key string, content_key string")
        skeleton = {r.k: r.s for r in spark.createDataFrame([(k,) for k in gone | fresh], "k string").select("k", version_normalized_path(F.col("k")).alias("s")).collect()}
        got = {r.d: r.a for r in align.content_pairs(frame(gone), frame(fresh)).collect()}
        assert got == by_hand(gone, fresh, skeleton)


def test_equivalence_is_the_same_in_tasks_and_expressions(spark):
    rng = random.Random(3)
    names = ["foo-rc1.txt", "foo-rc2.txt", "logo.dce2e9f.png", "logo-login.dce2e9f.png", "app-1.0.zip", "app-2.0.zip", "core-036M059(20260101-0900)", "core-036M061(20260707-1135)", "a1.zip", "a2.zip", "chunk1é2", "chunk1é3", "x"]
    pairs = [("/".join(rng.choices(names, k=k)), "/".join(rng.choices(names, k=k))) for k in (1, 1, 2) for _ in range(120)] + [(a, b) for a in names for b in names]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", versions.equivalent_path(F.col("a"), F.col("b")).alias("e")).collect()
    assert all(r.e == versions.equivalent_paths(r.a, r.b) for r in got)


def test_many_renames_of_one_content(spark):
    """Empty files by the thousand under a folder whose build number changed."""
    n = 20_000
    old = [(f"core-036M059(20260101-0900)/src/doc{i}.js", "empty") for i in range(n)]
    new = [(f"core-036M061(20260707-1135)/src/doc{i}.js", "empty") for i in range(n)]
    began = time.time()
    got = aligned(spark, old, new)
    assert all(got[k] == (a, "UNCHANGED", "CONTENT") for (k, _), (a, _) in zip(old, new)) and len(got) == n
    assert time.time() - began < 120


def test_renamed_archive_and_what_lies_in_it(spark):
    lib = "WEB-INF/lib/app-{}.zip"
    old = [(lib.format("1.0"), "zipOld"), (lib.format("1.0") + "!/config/application.properties", "same"), (lib.format("1.0") + "!/code/A.class", "oldCode")]
    new = [(lib.format("2.0"), "zipNew"), (lib.format("2.0") + "!/config/application.properties", "same"), (lib.format("2.0") + "!/code/A.class", "newCode")]
    got = aligned(spark, old, new)
    assert {k: s for k, (_, s, _) in got.items()} == {old[0][0]: "MODIFIED", old[1][0]: "UNCHANGED", old[2][0]: "MODIFIED"}


def test_affixes(spark):
    old = [("foo-rc1.txt", "f"), ("logo.dce2e9f.png", "l")]
    new = [("foo-rc2.txt", "f"), ("logo-login.dce2e9f.png", "l")]
    got = aligned(spark, old, new)
    assert got["foo-rc1.txt"][0] == "foo-rc2.txt" and got["logo.dce2e9f.png"][1] == "DELETED" and got["logo-login.dce2e9f.png"][1] == "ADDED"


def test_equivalent_paths_share_a_stem():
    rng = random.Random(5)
    parts = ["view", "view1", "view12", "-v", "_", "a", "b", "2", "3", ".1", "(2)", "rc", "x9", "alpha", "0"]
    seg = lambda: "".join(rng.choices(parts, k=rng.randint(1, 5)))
    names = list({"/".join(seg() for _ in range(rng.randint(1, 2))) for _ in range(700)})
    met = 0
    for a in names:
        for b in names:
            if versions.equivalent_paths(a, b):
                met += a != b
                assert set(versions.path_stems(a)) & set(versions.path_stems(b)), (a, b)
    assert met > 300


def test_equal_files_of_unlike_names(spark):
    """Thousands of empty files on each side whose names only begin alike compete with nobody."""
    n = 20_000
    old = [(f"app/viewalpha{i}x{i % 7}.html", "empty") for i in range(n)]
    new = [(f"app/viewbeta{i}x{i % 7}.html", "empty") for i in range(n)]
    began = time.time()
    got = aligned(spark, old, new)
    assert len(got) == 2 * n and {k for _, _, k in got.values()} == {"NONE"}
    assert time.time() - began < 20


def containers_by_hand(deleted, added, info):
    left, out = sorted(added), {}
    for d in sorted(deleted):
        fit = [a for a in left if info[d].name != info[a].name and versions.same_base(info[d].name, info[a].name, info[d].version, info[a].version, info[d].base, info[a].base)]
        if len(fit) == 1:
            out[d] = fit[0]
            left.remove(fit[0])
    return out


def test_containers_one_by_one(spark):
    """Version-renamed archives, with and without versions on both sides, against all candidates looked at in order."""
    rng = random.Random(11)
    names = [*(f"{b}-{v}.zip" for b in ("core", "store", "service") for v in ("1.0", "1.1", "2.0", "036M059(20260101-0900)")), "service-a1x.zip", "service-b2y.zip", "service-a1x2y.jar", "core-x.jar", "store-9é9z.zip", "storeq7q.zip", "sto1r.zip", "corea9b.jar", "coreb8c.jar"]
    for trial in range(12):
        old = {f"{rng.choice('pq')}/{rng.choice(names)}" for _ in range(rng.randint(2, 9))}
        new = {f"{rng.choice('pqr')}/{rng.choice(names)}" for _ in range(rng.randint(1, 6))}
        gone, fresh = old - new, new - old
        frame = lambda keys: spark.createDataFrame([(k, "JAR" if k.endswith("jar") else "ARCHIVE") for k in sorted(keys)], "key string, file_class string")
        f = F.element_at(F.split("key", "/"), -1)
        info = {r.key: r for r in frame(gone | fresh).select("key", f.alias("name"), versions.version(f).alias("version"), versions.base_name(f).alias("base")).collect()}
        got = {r.d: r.a for r in align.container_pairs(frame(gone), frame(fresh)).collect()}
        assert got == containers_by_hand(gone, fresh, info), (sorted(gone), sorted(fresh))


def test_same_base():
    """Pairs of names with and without versions."""
    of = lambda a, b, va, vb, ba, bb: versions.same_base(a, b, va, vb, ba, bb)
    assert of("app-1.0.zip", "app-2.0.zip", "1.0", "2.0", "app-", "app-")
    assert not of("BEMP-adapterV1.zip", "BEMP-cpesmqV2.zip", "1", "2", "BEMP-adapterV", "BEMP-cpesmqV")
    assert of("service-a1x.zip", "service-b2y.zip", None, None, None, None) and not of("service.zip", "service-b2y.zip", None, None, None, None)
    assert not of("srv1x.zip", "srv2y.zip", None, None, None, None)


def test_archives_of_one_name(spark):
    """Many archives of one base name and version moved to other folders: nothing pairs, and nobody scans the others."""
    n = 5_000
    old, new = [(f"a/m{i}/core-1.0.zip", f"h{i}") for i in range(n)], [(f"b/m{i}/core-1.0.zip", f"g{i}") for i in range(n)]
    began = time.time()
    pairs = align.container_pairs(*(spark.createDataFrame([(k, "ARCHIVE") for k, _ in x], "key string, file_class string") for x in (old, new)))
    assert pairs.count() == 0 and time.time() - began < 30


def test_copies_leave_each_its_own_successor(spark):
    """An edited file whose old text another file still has is paired with its own successor, and so is the other."""
    path = "core-{}/src/doc{}.js"
    old, new = "036M059(20260101-0900)", "036M061(20260707-1135)"
    got = aligned(spark, [(path.format(old, i), "copy") for i in (10, 12, 15)], [(path.format(new, 10), "edited"), (path.format(new, 12), "copy"), (path.format(new, 15), "edited too")])
    assert got == {path.format(old, i): (path.format(new, i), status, kind) for i, status, kind in ((10, "MODIFIED", "PATH"), (12, "UNCHANGED", "CONTENT"), (15, "MODIFIED", "PATH"))}
