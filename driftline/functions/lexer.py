"""What kind of token stands at a column of a line of source, as Column expressions.

A line's beginning up to the column is reduced: strings and comments that close there become a blank. What is left holds at most one
that is still open, and the first thing that opens decides.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords, operators, and labels of kinds.
KEYWORDS = (
    "abstract", "assert", "boolean", "break", "byte", "case", "catch", "char", "class", "const", "continue", "default", "do", "double", "else", "enum", "extends", "final", "finally", "float", "for", "goto", "if", "implements", "import", "instanceof", "int",
    "interface", "long", "native", "new", "package", "private", "protected", "public", "return", "short", "static", "strictfp", "super", "switch", "synchronized", "this", "throw", "throws", "transient", "try", "void", "volatile", "while", "var", "let",
    "function", "async", "await", "export", "typeof", "delete", "in", "of", "yield", "null", "true", "false", "undefined", "NaN", "Infinity", "def", "print", "from", "as", "with", "using",
)
OPERATORS = r"""[-+*/%=!<>&|^~?:.,;()\[\]{}@$#\\]"""
LABELS = {"keyword": "关键字", "string": "字符串", "comment": "注释", "number": "数字", "ident": "标识符", "op": "运算符", "ws": "空白", "eol": "行尾", "blank": "空行", "other": "其他"}
#: Strings and comments that close; a line comment closes with the line, and its mark stays.
CLOSED = r"""(?s)"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`|/\*.*?\*/|(//).*"""


def token_at(line: Column, column: Column) -> Column:
    """The kind of what stands at a column from 0: a key of LABELS."""
    text = F.coalesce(line, F.lit(""))
    at = F.greatest(F.lit(0), F.least(column, F.length(text)))
    ch, after = F.substring(text, at + 1, F.lit(1)), F.substring(text, at + 2, F.lit(1))
    # A line comment may begin at the column, which takes the next character to be seen.
    before = F.substring(text, F.lit(1), at + 1)
    rest = F.regexp_replace(before, CLOSED, F.lit("$1 "))
    begins = rest.endswith("/") & after.isin("/", "*")
    # The first opener among those left; what stands behind // opens nothing.
    opener = F.regexp_extract(rest, r"""(?s)^.*?(//|/\*|["'`])""", 1)
    inside = F.regexp_extract(rest, r"""(?s)(/\*.*)$""", 1)
    closes = (opener == "/*") & (ch == "*") & (after == "/") & (F.length(inside) > 2)
    letter, digit = ch.rlike(r"^[A-Za-z_$]$"), ch.rlike(r"^[0-9]$") | ((ch == ".") & after.rlike(r"^[0-9]$"))
    word = F.concat(F.regexp_extract(F.substring(text, F.lit(1), at), r"([\w$]*)$", 1), F.regexp_extract(F.substring(text, at + 1, F.length(text)), r"^([\w$]*)", 1))
    plain = (F.when(ch.rlike(r"^\s$"), "ws").when(digit, "number").when(letter, F.when(word.isin(*KEYWORDS), "keyword").otherwise("ident")).when(ch.rlike(f"^{OPERATORS}$"), "op").otherwise("other"))
    return (F.when(text == "", "blank").when(at >= F.length(text), "eol").when(closes, "op").when(opener.isin("//", "/*"), "comment").when(opener != "", "string")
            .when(begins, "comment").otherwise(plain))


def label(kind: Column) -> Column:
    out = None
    for name, text in LABELS.items():
        out = F.when(kind == name, text) if out is None else out.when(kind == name, text)
    return out
