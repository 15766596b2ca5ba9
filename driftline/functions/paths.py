"""Keys and what follows from their names, as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import EXTENSIONS, FILE_CLASSES, KNOWN_TEXT


def _ends(extensions: Iterable[str]) -> str:
    return r"\.(" + "|".join(re.escape(e) for e in extensions) + ")$"


def file_class(key: Column) -> Column:
    """The class of a file by its extension; the order of classes decides between them."""
    out = None
    for name, (any_case, exact) in EXTENSIONS.items():
        hit = F.lit(False)
        if any_case:
            hit = hit | F.lower(key).rlike(_ends(any_case))
        if exact:
            hit = hit | key.rlike(_ends(exact))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("OTHER")


def is_frontend_text(cls: Column) -> Column:
    return cls.isin([c for c, (front, _, _) in FILE_CLASSES.items() if front])


def is_text_diffable(cls: Column) -> Column:
    return cls.isin([c for c, (_, text, _) in FILE_CLASSES.items() if text])


def category_label(cls: Column) -> Column:
    out = None
    for name, (_, _, label) in FILE_CLASSES.items():
        if name != "OTHER":
            out = F.when(cls == name, label) if out is None else out.when(cls == name, label)
    return out.otherwise(FILE_CLASSES["OTHER"][2])


def file_name(key: Column) -> Column:
    return F.element_at(F.split(key, "/"), -1)


def parent(key: Column) -> Column:
    return F.regexp_extract(key, r"^(.*)/[^/]*$", 1)


def depth(key: Column) -> Column:
    return F.size(F.split(key, "/")) - 1


def ancestors(key: Column) -> Column:
    """All proper prefixes of a key that end at a slash, without it, shortest first."""
    parts = F.split(key, "/")
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))


def is_known_text(key: Column) -> Column:
    name = F.lower(file_name(key))
    dot = F.length(F.substring_index(name, ".", -1))
    has_extension = name.rlike(r"^.+\.[^.]+$")
    return F.when(has_extension, F.substring_index(name, ".", -1).isin(*KNOWN_TEXT)).otherwise(name.isin(*KNOWN_TEXT) & (dot > 0))


def is_unsafe(key: Column) -> Column:
    """Keys that could leave their root: empty, absolute, with a colon or two dots."""
    k = F.replace(key, F.lit("\\"), F.lit("/"))
    return key.isNull() | (k == "") | k.startswith("/") | k.contains(":") | k.contains("..")


def normalized(key: Column) -> Column:
    return F.replace(key, F.lit("\\"), F.lit("/"))


def is_deploy_manifest(key: Column) -> Column:
    return key.endswith("/META-INF/MANIFEST.xml")


def is_build_metadata(key: Column) -> Column:
    k = normalized(key)
    return k.endswith("/META-INF/MANIFEST.MF") | is_deploy_manifest(k) | (k.endswith("/pom.properties") & k.contains("/META-INF/maven/"))


def is_lib_jar(key: Column) -> Column:
    return key.endswith(".jar") & key.contains("/lib/")


def layer(key: Column, package_type: Column, classes_prefix: Column, internal: Iterable[str], expand_all: bool = False) -> Column:
    """L1 for the package's own classes, else L0 (library jars, L2, are told apart when scanning)."""
    own = F.lit(expand_all)
    for p in internal:
        own = own | key.startswith(p)
    return F.when((package_type == "JAR") & key.endswith(".class"), F.when(own, "L1").otherwise("L0")).when(classes_prefix.isNotNull() & key.startswith(classes_prefix), "L1").otherwise("L0")


def compound(key: Column) -> Column:
    """A key's parts at archive boundaries: a!/b!/c."""
    return F.split(key, "!/")
