"""Normal forms of text, as Column expressions."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..model import VERSION_MARK
from .paths import file_class, is_deploy_manifest, is_known_text, is_text_diffable

# Build numbers with a time in brackets, with a dotted time, and alone.
VERSION_TOKENS = (
    r"\d+M\d*(?:\.\d+)?\(\d[0-9.\-]*\)",
    r"\d+M\d*(?:\.\d+)?\.\d{8}\.\d+",
    r"\d+M\d*(?:\.\d+)?",
)
# Fixed value: the date comment of generated property files, after its #.
DATE_COMMENT = r"^(?i)(mon|tue|wed|thu|fri|sat|sun)[a-z]*\s+[a-z]+\s+\d+.*\d{4}$"
# What prompts must not carry (identity numbers, secrets, mobile numbers), and by what it is replaced.
PROMPT_SECRETS = (
    (r"(?<!\d)\d{17}[\dXx](?!\d)", "***ID***"),
    (r"(?<!\w)(?:AKIA|AK|SK|KEY|SECRET|TOKEN|PASSWORD|PWD)[-.\w=:]*[A-Za-z0-9+/=]{6,}", "***SECRET***"),
    (r"(?<!\d)1[3-9]\d{9}(?!\d)", "***PHONE***"),
)
# Credentials in log lines, and by what they are replaced.
LOG_SECRETS = (
    (r"(?i)(bearer\s+)([A-Za-z0-9._~+/\-]+=*)", "$1<redacted>"),
    (r"(?i)((?:api[_-]?key|apikey|authorization|token|bearer|secret|password)\s*[:=]\s*)(\S+)", "$1<redacted>"),
    (r"sk-[A-Za-z0-9_\-]{8,}", "sk-<redacted>"),
)


def normalize(text: Column) -> Column:
    """Without a byte-order mark, blanks and tabs at line ends, and carriage returns before line feeds. A bare carriage return is no line end."""
    s = F.regexp_replace(text, "^﻿", "")
    return F.regexp_replace(F.replace(s, F.lit("\r\n"), F.lit("\n")), r"(?md)[ \t]+$", "")


def strip_version_tokens(text: Column) -> Column:
    for pattern in VERSION_TOKENS:
        text = F.regexp_replace(text, pattern, VERSION_MARK)
    return text


def strip_content_hash(segment: Column) -> Column:
    """Without the hexadecimal part that bundlers put before the extension."""
    return F.regexp_replace(segment, r"\.[0-9a-f]{6,}(?=\.[A-Za-z0-9]+$)", "")


def version_normalized_path(key: Column) -> Column:
    k = F.replace(F.replace(key, F.lit("!/"), F.lit("/")), F.lit("\\"), F.lit("/"))
    return F.array_join(F.transform(F.split(k, "/"), lambda s: strip_content_hash(strip_version_tokens(s))), "/")


def is_build_noise(line: Column) -> Column:
    t = F.trim(line)
    return line.startswith("Timestamp:") | (t.startswith("#") & F.trim(F.substring(t, 2, 1 << 30)).rlike(DATE_COMMENT))


def collapse_version_assignment(line: Column) -> Column:
    """key=value or key: value with a version in the value: the value is the mark alone."""
    return F.regexp_replace(line, f"^(\\s*[^=\\n]+[=:]).*{VERSION_MARK}.*$", f"$1{VERSION_MARK}")


def noise_normalized(text: Column) -> Column:
    kept = F.filter(F.split(normalize(text), "\n"), lambda x: ~is_build_noise(x))
    lines = F.transform(kept, lambda x: F.concat(collapse_version_assignment(strip_version_tokens(x)), F.lit("\n")))
    return F.array_join(lines, "")


def deploy_normalized(text: Column) -> Column:
    s = F.regexp_replace(noise_normalized(text), r'(?i)md5\s*=\s*"[0-9a-f]+"', 'md5="*"')
    return F.regexp_replace(s, r'(?i)size\s*=\s*"\d+"', 'size="*"')


def content_key(key: Column, text: Column, limit: int) -> Column:
    """What tells contents apart when names change: the digest of a text without build noise, else of the bytes."""
    plain = (is_text_diffable(file_class(key)) | is_known_text(key)) & (F.octet_length(text) <= limit)
    form = F.when(is_deploy_manifest(key), deploy_normalized(text)).when(plain, noise_normalized(text)).otherwise(text)
    return F.sha2(form, 256)


def valid_pattern(pattern: str | None) -> str | None:
    """The pattern if the engine that runs it compiles it, else None: a bad rule is no rule."""
    if not pattern:
        return None
    jvm = SparkSession.active().sparkContext._jvm
    try:
        jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, PySparkException):
        return None
    return pattern


def rule_normalized(line: Column, ignore_whitespace: bool = False, ignore_comments: bool = False, ignore_regex: str | None = None) -> Column:
    """A line as comparison rules see it: without white space, whole-line comments and what a pattern matches, in this order."""
    s = F.coalesce(line, F.lit(""))
    if ignore_whitespace:
        s = F.regexp_replace(s, r"[ \t\n\x0B\f\r]+", "")
    if ignore_comments:
        t = F.trim(s)
        comment = t.startswith("//") | t.startswith("#") | (t.startswith("/*") & t.endswith("*/")) | (t.startswith("<!--") & t.endswith("-->")) | t.startswith("*")
        s = F.when(comment, "").otherwise(s)
    if pattern := valid_pattern(ignore_regex):
        s = F.regexp_replace(s, pattern, "")
    return s


def newlines(text: Column) -> Column:
    """CRLF and CR become line feeds; blanks and tabs before a line feed go, those before a CR stay."""
    return F.regexp_replace(text, r"[ \t]*\n|\r\n?", "\n")


def html_split(text: Column) -> Column:
    return F.replace(newlines(text), F.lit("><"), F.lit(">\n<"))


def jsp_split(text: Column) -> Column:
    s = F.replace(F.replace(html_split(text), F.lit("<%"), F.lit("\n<%")), F.lit("%>"), F.lit("%>\n"))
    lines = F.split(s, "\n")
    # The first of each run of blank lines stays.
    kept = F.filter(F.arrays_zip(lines.alias("a"), F.concat(F.array(F.lit("x")), lines).alias("b")), lambda p: p["a"].isNotNull() & ~((F.trim(p["a"]) == "") & (F.trim(p["b"]) == "")))
    return F.array_join(F.transform(kept, lambda p: F.concat(p["a"], F.lit("\n"))), "")


def looks_minified(text: Column) -> Column:
    lines = F.split(text, "\n")
    longest = F.array_max(F.transform(lines, lambda x: F.length(x)))
    return (text != "") & (longest > 400) & ((F.size(lines) < 6) | (F.length(text) / F.size(lines) > 200))


def redact_prompt(text: Column) -> Column:
    for pattern, by in PROMPT_SECRETS:
        text = F.regexp_replace(text, pattern, by)
    return text


def redact_log(line: Column, home: str = "", work: str = "") -> Column:
    for pattern, by in LOG_SECRETS:
        line = F.regexp_replace(line, pattern, by)
    for folder, by in ((home, "<home>"), (work, "<workdir>")):
        if folder:
            line = F.replace(line, F.lit(folder), F.lit(by))
    return line


def short_hash(data: Column) -> Column:
    """The first seven hexadecimal digits of SHA-1; zeros for null and empty."""
    return F.when(data.isNull() | (F.length(data) == 0), "0000000").otherwise(F.substring(F.sha1(data), 1, 7))


def crc_text(data: Column) -> Column:
    return F.coalesce(F.lpad(F.lower(F.hex(F.crc32(data))), 8, "0"), F.lit("--------"))


def token_estimate(text: Column) -> Column:
    return F.length(text) / 2.0


def manifest_version(text: Column, name: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?m)^{name}:[ \t]*(.*)$", 1)), F.lit(""))


#: Fixed value: where a manifest may have a version.
MANIFEST_VERSIONS = ("Bundle-Version", "Implementation-Version", "Specification-Version", "Build-Version", "Version")


def manifest_versions(text: Column) -> Column:
    """All versions that a manifest's lines give, in the order of its lines."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?m)^(?:{'|'.join(MANIFEST_VERSIONS)}):([^\n]*)$"), 1), lambda v: F.trim(v, F.lit(" \t\r")))


def properties_version(text: Column) -> Column:
    """The version of a file of properties."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?m)^version=([^\n]*)$"), 1)
    return F.trim(F.get(found, F.lit(0)), F.lit(" \t\r"))


def best_version(versions: Column) -> Column:
    """The most detailed of an array: most dotted parts, then longest, then first."""
    ranked = F.transform(F.filter(versions, lambda v: v.isNotNull()), lambda v, i: F.struct(F.size(F.split(v, r"\.")).alias("parts"), F.length(v).alias("length"), (-i).alias("first"), v.alias("v")))
    return F.array_max(ranked)["v"]


def human_size(size: Column) -> Column:
    return (F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
            .when(size < 1 << 20, F.format_string("%.1f KB", size / 1024.0)).when(size < 1 << 30, F.format_string("%.1f MB", size / float(1 << 20)))
            .when(size < 1 << 40, F.format_string("%.1f GB", size / float(1 << 30))).otherwise(F.format_string("%.1f TB", size / float(1 << 40))))


def shown_time(ms: Column) -> Column:
    """A time in milliseconds, in the session's zone; a dash for none."""
    return F.coalesce(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("-"))
