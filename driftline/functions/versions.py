"""Versions in file names, as Column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# A dotted version at the end of a name, and a build number with an optional bracket and suffix.
DOTTED = r"[Vv]?(\d+(?:\.\d+)*(?:[-_][A-Za-z0-9]+)?)$"
BUILD_TAIL = r"([A-Za-z]*\d{2,}[A-Za-z]*\d*(?:\([^()]*\))?(?:[-_][A-Za-z0-9]+)?)$"
VERSION_TAIL = r"^[\p{L}\p{Nd}()._-]*\p{Nd}[\p{L}\p{Nd}()._-]*$"
LEAST_PREFIX = 4


def stem(name: Column) -> Column:
    """A file's name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(name, r"(?s)(.)\.[^./\\]*$", "$1")


def version(name: Column) -> Column:
    """The version a file's name ends with: dotted, unless that follows a bracket, else the build number; null without one."""
    s = stem(name)
    dotted, build = F.regexp_extract(s, DOTTED, 1), F.nullif(F.regexp_extract(s, BUILD_TAIL, 1), F.lit(""))
    before = F.substring(F.regexp_extract(s, f"(?s)^(.*?){DOTTED}", 1), -1, 1)
    return F.when(dotted == "", build).when(before == "(", F.coalesce(build, dotted)).otherwise(dotted)


def base_name(name: Column) -> Column:
    """A file's name without its version; null if it doesn't end with one or too little is left."""
    s, v = stem(name), version(name)
    base = F.when(s.endswith(v), F.substring(s, F.lit(1), F.length(s) - F.length(v)))
    return F.when(F.length(base) >= LEAST_PREFIX, base)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    n = F.least(F.length(a), F.length(b))
    differs = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.array_min(differs) - 1, n))


def _tails(a: Column, b: Column) -> Column:
    p = common_prefix(a, b)
    return F.struct(p.alias("p"), F.substring(a, p + 1, F.length(a)).alias("a"), F.substring(b, p + 1, F.length(b)).alias("b"))


def _short_word(tail: Column) -> Column:
    """Fewer than two letters before the first digit."""
    return F.length(F.regexp_replace(F.regexp_extract(tail, r"^[^\p{Nd}]*", 0), r"[^\p{L}]", "")) < 2


def equivalent_segment(a: Column, b: Column) -> Column:
    """Equal, or alike for four characters and then unlike in version tails only."""
    both = F.transform(F.array(_tails(a, b)), lambda t: (t["p"] >= LEAST_PREFIX) & (t["a"] != "") & (t["b"] != "") & _short_word(t["a"]) & _short_word(t["b"]) & t["a"].rlike(VERSION_TAIL) & t["b"].rlike(VERSION_TAIL))
    return (a == b) | F.element_at(both, 1)


def segments(key: Column) -> Column:
    k = F.replace(F.replace(key, F.lit("\\"), F.lit("/")), F.lit("!/"), F.lit("/"))
    return F.filter(F.split(k, "/"), lambda s: s != "")


def equivalent_path(a: Column, b: Column) -> Column:
    """Keys of as many segments, each equivalent."""
    return F.when(F.size(segments(a)) == F.size(segments(b)), F.forall(F.zip_with(segments(a), segments(b), equivalent_segment), lambda x: x)).otherwise(False)


def _equivalent_segments(a: str, b: str) -> bool:
    if a == b:
        return True
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    tails = a[p:], b[p:]
    if p < LEAST_PREFIX or not all(tails):
        return False
    for tail in tails:
        kinds = [unicodedata.category(c) for c in tail]
        first = kinds.index("Nd") if "Nd" in kinds else len(kinds)
        if first == len(kinds) or sum(k[0] == "L" for k in kinds[:first]) >= 2 or not all(k[0] == "L" or k == "Nd" or c in "()._-" for c, k in zip(tail, kinds)):
            return False
    return True


def equivalent_paths(a: str, b: str) -> bool:
    """equivalent_path of two strings, for those who look at few pairs inside a task."""
    x, y = ([s for s in k.replace("\\", "/").replace("!/", "/").split("/") if s] for k in (a, b))
    return len(x) == len(y) and all(map(_equivalent_segments, x, y))


def prefix_key(key: Column) -> Column:
    """What equivalent paths have in common: segments without a digit after the first characters, and the first characters of the others."""
    return F.array_join(F.transform(segments(key), lambda s: F.when(F.substring(s, F.lit(LEAST_PREFIX + 1), F.length(s)).rlike(r"\p{Nd}"), F.substring(s, 1, LEAST_PREFIX)).otherwise(s)), "/")


#: Segments of a path, from its end, whose stems tell candidates apart; others do by their first characters.
STEM_SEGMENTS = 2


def _stems(segment: str) -> set[str]:
    """Beginnings of a segment of which equivalent ones share one: what stands before a run of digits, without marks at its end and up to one letter."""
    out = set()
    for m in re.finditer(r"\d+", segment[LEAST_PREFIX:]):
        stem = segment[: LEAST_PREFIX + m.start()].rstrip("()._-")
        out |= {stem, stem[:-1].rstrip("()._-")}
    return out or {segment}


def path_stems(key: str) -> list[str]:
    """Stems of a path: equivalent paths share one. The last STEM_SEGMENTS segments with a digit have their stems, those above their first characters."""
    found, left = [""], STEM_SEGMENTS
    for s in reversed([s for s in key.replace("\\", "/").replace("!/", "/").split("/") if s]):
        own = {s}
        if re.search(r"\d", s[LEAST_PREFIX:]):
            own = _stems(s) if left else {s[:LEAST_PREFIX]}
            left = max(0, left - 1)
        found = [f"{x}/{rest}" for x in own for rest in found]
    return sorted(found)


def same_base(a: str, b: str, version_a: str | None, version_b: str | None, base_a: str | None, base_b: str | None) -> bool:
    """Whether two file names are those of one package in different versions: by their base names, or where one has no version by their common beginning."""
    if version_a is not None and version_b is not None:
        return version_a != version_b and base_a is not None and base_a == base_b
    a, b = _stem(a), _stem(b)
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return p >= LEAST_PREFIX and all(looks_version_tail(x[p:]) for x in (a, b))


def _stem(name: str) -> str:
    return re.sub(r"(?s)(.)\.[^./\\]*$", r"\1", name)


def file_version(name: str) -> str | None:
    """version() of a string."""
    s = _stem(name)
    dotted, build = (re.search(p.replace(r"\d", "[0-9]"), s) for p in (DOTTED, BUILD_TAIL))
    if not dotted or (build and dotted.start() and s[dotted.start() - 1] == "("):
        return build and build[1]
    return dotted[1]


def file_base(name: str) -> str | None:
    """base_name() of a string."""
    s, v = _stem(name), file_version(name)
    return s[: len(s) - len(v)] if v and s.endswith(v) and len(s) - len(v) >= LEAST_PREFIX else None


def same_package(a: str, b: str) -> bool:
    """Whether two paths' file names are those of one package in different versions."""
    a, b = a.rpartition("/")[2], b.rpartition("/")[2]
    return _stem(a) != _stem(b) and same_base(a, b, file_version(a), file_version(b), file_base(a), file_base(b))


def looks_version_tail(tail: str) -> bool:
    """A digit, and nothing but letters, digits and ()._-."""
    kinds = [unicodedata.category(c) for c in tail]
    return "Nd" in kinds and all(k[0] == "L" or k == "Nd" or c in "()._-" for c, k in zip(tail, kinds))


def sort_key(v: Column) -> Column:
    """An array that orders versions: runs of digits by value, before other runs, which order without case, then with it."""
    tokens = F.regexp_extract_all(F.coalesce(v, F.lit("")), F.lit(r"(\d+|\D+)"), 1)
    return F.transform(tokens, lambda t: F.struct(
        F.when(t.rlike(r"^\d+$"), 1).otherwise(2).alias("kind"), F.when(t.rlike(r"^\d+$"), t.cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)")).alias("number"), F.lower(t).alias("folded"), F.when(t.rlike(r"^\d+$"), "").otherwise(t).alias("text")))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1. Arrays that end first compare as if an empty, non-numeric run followed."""
    pad = F.struct(F.lit(2).alias("kind"), F.lit(0).cast("decimal(38,0)").alias("number"), F.lit("").alias("folded"), F.lit("").alias("text"))

    def value(t: Column) -> Column:
        return F.struct(t["kind"], t["number"], F.when(t["kind"] == 2, t["folded"]).otherwise(""), t["text"])

    each = F.zip_with(sort_key(a), sort_key(b), lambda x, y: F.when(value(F.coalesce(x, pad)) < value(F.coalesce(y, pad)), -1).when(value(F.coalesce(x, pad)) > value(F.coalesce(y, pad)), 1).otherwise(0))
    return F.coalesce(F.get(F.filter(each, lambda x: x != 0), F.lit(0)), F.lit(0))


def up_to_date(current: Column, tag: Column) -> Column:
    """Whether a version is at least that of a tag, without a leading v; null for a tag without digits or no version."""
    plain = lambda v: F.regexp_replace(F.coalesce(v, F.lit("")), "^[vV]", "")
    return F.when((F.trim(current) != "") & plain(tag).rlike(r"\d"), compare(plain(current), plain(tag)) >= 0)


def ordered(a: Column, b: Column) -> Column:
    """A struct (old, new) of two names, the one with the smaller version first."""
    return F.when(compare(version(a), version(b)) > 0, F.struct(b.alias("old"), a.alias("new"))).otherwise(F.struct(a.alias("old"), b.alias("new")))
