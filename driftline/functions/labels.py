"""Risk, category and other labels by rules of words, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import is_frontend_text

# Words in keys that make a change risky, and the categories in the order in which they are tried.
HIGH_RISK = ("controller", "api", "facade", "endpoint")
BY_CLASS = (("CONFIG", "配置"), ("JS", "前端脚本"), ("HTML", "前端模板"), ("CSS", "前端样式"), ("JSP", "页面"))
BY_WORD = (
    # category, words of keys, words of stated intents
    ("接口", ("controller", "api", "facade"), ("接口", "api")),
    ("数据", ("dao", "mapper", "repository"), ("数据库", "sql", "数据访问")),
    ("服务", ("service", "manager", "biz"), ("服务",)),
    ("配置", ("config", "bean", "context", "properties"), ()),
    ("模型", ("entity", "model", "domain", "dto", "vo", "po"), ()),
)
# Severities in the order in which they are tried.
SEVERITIES = (
    (r"(?i)(致命|严重|critical|breaking|破坏性|fatal)", "sev-breaking"),
    (r"(?i)(高|high|较大|major)", "sev-high"),
    (r"(?i)(中|med|medium|一般|moderate)", "sev-med"),
    (r"(?i)(低|low|较小|轻微|minor)", "sev-low"),
    (r"(?i)(无|none|没有|未|na)", "sev-none"),
)
# What a focus is about.
FOCUSES = (
    ("breaking", ("破坏性", "兼容性", "接口契约")),
    ("impact", ("影响范围", "上下游", "依赖")),
    ("testpoints", ("测试", "回归")),
    ("risk", ("风险", "降级", "回滚")),
)
# The sentences that give a reason.
REASONS = {
    "status": {"ADDED": "新增", "DELETED": "删除", "MODIFIED": "修改"},
    "config": "配置文件，影响配置语义/启动加载，建议核对配置项",
    "frontend": "前端资源，影响页面/交互，建议核对渲染与交互",
    "other": "后端类，按包路径/变更类型初判风险，建议结合上下文复核",
}


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def heuristic_risk(key: Column, cls: Column) -> Column:
    return F.when((cls == "CONFIG") | is_frontend_text(cls), "LOW").when(_any(F.lower(F.coalesce(key, F.lit(""))), HIGH_RISK), "HIGH").otherwise("MEDIUM")


def heuristic_category(key: Column, cls: Column, intent: Column | None = None) -> Column:
    k, it = F.lower(F.coalesce(key, F.lit(""))), F.lower(F.coalesce(intent if intent is not None else F.lit(""), F.lit("")))
    out = F.when(cls == BY_CLASS[0][0], BY_CLASS[0][1])
    for name, label in BY_CLASS[1:]:
        out = out.when(cls == name, label)
    for label, of_key, of_intent in BY_WORD:
        out = out.when(_any(k, of_key) | _any(it, of_intent), label)
    return out.otherwise("业务代码")


def reason(cls: Column, status: Column) -> Column:
    word = F.when(status == "ADDED", REASONS["status"]["ADDED"]).when(status == "DELETED", REASONS["status"]["DELETED"]).otherwise(REASONS["status"]["MODIFIED"])
    return F.concat(word, F.when(cls == "CONFIG", REASONS["config"]).when(is_frontend_text(cls), REASONS["frontend"]).otherwise(REASONS["other"]))


def normalized_risk(text: Column) -> Column:
    u = F.upper(F.trim(text))
    return F.when(u.contains("HIGH") | u.contains("高"), "HIGH").when(u.contains("LOW") | u.contains("低"), "LOW").otherwise("MEDIUM")


def severity(text: Column, context: Column) -> Column:
    """The first severity that the text names, if its context is about risk."""
    out = F.when(~context.contains("风险"), F.lit(None).cast("string"))
    for pattern, name in SEVERITIES:
        out = out.when(text.rlike(pattern), name)
    return out


def focus(text: Column) -> Column:
    out = F.when(text.isNull() | (F.trim(text) == ""), "")
    for name, words in FOCUSES:
        out = out.when(_any(text, words), name)
    return out.otherwise("")


def risk_rank(risk: Column) -> Column:
    return F.when(risk == "CRITICAL", 4).when(risk == "HIGH", 3).when(risk == "MEDIUM", 2).when(risk == "LOW", 1).otherwise(0)


def status_rank(status: Column) -> Column:
    """MODIFIED, ADDED, DELETED, UNCHANGED."""
    return F.when(status == "MODIFIED", 0).when(status == "ADDED", 1).when(status == "DELETED", 2).otherwise(3)


def archive_rank(status: Column) -> Column:
    """MODIFIED, DELETED, ADDED, UNCHANGED."""
    return F.when(status == "MODIFIED", 0).when(status == "DELETED", 1).when(status == "ADDED", 2).otherwise(3)


def output_tokens(configured: Column, window: Column, used: Column) -> Column:
    """Tokens that an answer may take: as configured or what the window leaves (2048 kept back, 16384 at most), 1024 at least, and less than is left."""
    left = F.greatest(F.lit(0), window - used - 2048)
    return F.least(F.greatest(configured, F.least(left, F.lit(16384)), F.lit(1024)), F.greatest(F.lit(0), window - used - 1))
