"""Schemas, enumerations and options of the comparison."""

from __future__ import annotations

from dataclasses import dataclass

# File classes, what follows from them, and the labels of reports.
FILE_CLASSES = {
    # class: (front-end text, text that is compared by line, label)
    "CLASS": (False, False, "Java 类"),
    "JAR": (False, False, "依赖 JAR"),
    "CONFIG": (False, True, "配置文件(XML/Properties)"),
    "JSP": (False, True, "JSP 页面/标签"),
    "JS": (True, True, "前端 JS"),
    "HTML": (True, True, "前端 HTML"),
    "CSS": (True, True, "前端 CSS"),
    "STATIC": (False, False, "静态资源(图片/字体)"),
    "ARCHIVE": (False, False, "归档压缩包(zip/war/ear/tar)"),
    "OFFICE": (False, False, "Office 文档(docx/xlsx)"),
    "FOLDER": (False, False, "文件夹"),
    "OTHER": (False, False, "其他"),
}
# Extensions by file class. The first list ignores case, the second doesn't.
EXTENSIONS = {
    "CLASS": ((), ("class",)),
    "JAR": ((), ("jar",)),
    "ARCHIVE": (("zip", "war", "ear", "tar", "tar.gz", "tgz"), ()),
    "JSP": ((), ("jsp", "jspx", "tag", "tagx")),
    "CONFIG": (("mf", "sh"), ("xml", "properties", "yml", "yaml", "json", "conf", "cfg", "tld", "xhtml", "wsdl", "xsl", "xslt", "dtd", "vm", "ftl", "ini", "toml", "txt", "csv")),
    "OFFICE": (("docx", "docm", "dotx", "xlsx", "xlsm", "xltx", "pptx", "pptm", "doc", "xls", "ppt"), ()),
    "JS": ((), ("js",)),
    "HTML": ((), ("html", "htm")),
    "CSS": ((), ("css",)),
    "STATIC": ((), ("png", "jpg", "jpeg", "gif", "bmp", "ico", "webp", "svg", "woff", "woff2", "ttf", "eot", "so", "dll", "exe")),
}
# Extensions and bare names of plain text.
KNOWN_TEXT = (
    "java", "kt", "groovy", "scala", "sql", "md", "markdown", "log", "bat", "cmd", "ps1", "py", "rb", "php", "go", "rs", "c", "cpp", "cc", "h", "hpp",
    "sh", "bash", "zsh", "vue", "ts", "tsx", "jsx", "scss", "less", "sass", "gitignore", "dockerignore", "editorconfig", "env", "lock", "yarn", "makefile", "dockerfile",
)
# Fixed value: what version tokens become.
VERSION_MARK = "\x00V\x00"


@dataclass(frozen=True)
class Options:
    """Every limit and switch of the comparison in one place."""

    internal_prefixes: tuple[str, ...] = ("com/", "cn/")
    expand_all: bool = False
    expand_internal_lib: bool = True
    max_entry_bytes: int = 256 << 20
    max_total_bytes: int = 4 << 30
    max_depth: int = 6
    listing_limit: int = 50_000
    normalize_limit: int = 2 << 20
    text_limit: int = 4 << 20
    hash_limit: int = 64 << 20
    lcs_cells: int = 5_000_000
    beautify_chars: int = 2_000_000
    top_k: int = 12
    file_budget: int = 8_000
    total_budget: int = 60_000
    least_budget: int = 500
