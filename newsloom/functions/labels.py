"""Rule-based labels: language, content type, event type, confidence, error class."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import contains_any, let, normalize_text, strip, to_nfc

# Keyword lists, checked in this order.
CONTENT_TYPES = (
    ("release", ("release", "launch", "announce", "发布", "推出")),
    ("tutorial", ("tutorial", "guide", "how to", "教程", "指南")),
    ("discussion", ("discussion", "discuss", "讨论", "热议")),
    ("news", ("news", "breaking", "新闻", "快讯")),
)
EVENT_TYPES = (
    ("breaking_news", ("breaking", "urgent", "alert", "快讯", "突发")),
    ("product_launch", ("release", "launch", "announce", "发布", "推出", "上线")),
    ("open_source_release", ("open source", "oss", "github", "开源")),
    ("long_running_topic", ("trending", "popular", "热门", "趋势")),
)
# Hours an event of each type stays one event.
EVENT_WINDOWS = {
    "breaking_news": 48.0,
    "product_launch": 168.0,
    "open_source_release": 336.0,
    "long_running_topic": 720.0,
    "default": 24.0,
}
# Confidence borders.
HIGH, MEDIUM = 0.70, 0.45

# User hints per error class.
HINT_UNKNOWN = "抓取失败，详细信息请查看服务端日志"
HINT_SSRF = "目标地址被安全策略拦截：只允许抓取公开的 http/https 地址"
HINT_PAUSED = "任务已暂停，本次触发已跳过"
HINT_MISSING = "任务不存在或已被删除，请刷新页面"
HINT_LARGE = "响应体超过大小上限，已中止本次抓取（可通过环境变量 CRAWLER_MAX_RESPONSE_MB 调整上限）"
HINT_TIMEOUT = "连接超时：目标站点响应过慢或被网络阻断"
HINT_TLS = "TLS 握手失败（证书校验不通过），无法安全连接目标站点"
HINT_NETWORK = "无法连接到目标站点（连接被拒绝或中断）"
CONFIG_PREFIX = "任务配置不完整"
HTTP_HINTS = {
    "400": "目标站点拒绝了该请求（400），请检查来源 URL 与请求参数",
    "401": "目标站点要求登录（401），该来源需要鉴权",
    "403": "目标站点拒绝访问（403），可能需要调整请求头或降低抓取频率",
    "404": "目标地址不存在（404），请确认来源 URL 是否正确",
    "429": "目标站点限流（429），请降低抓取频率后重试",
}


def _joined(title: Column, summary: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(summary, F.lit("")))


def _first_rule(text: Column, rules, default: str) -> Column:
    def choose(low: Column) -> Column:
        out = None
        for label, needles in rules:
            hit = contains_any(low, needles)
            out = F.when(hit, label) if out is None else out.when(hit, label)
        return out.otherwise(default)

    return let(choose, low=F.lower(text))


def language(text: Column) -> Column:
    """`zh` when Chinese characters exceed 30 % of the trimmed length, else `en`; blank is `unknown`."""
    size = F.length(strip(text))
    share = F.try_divide(F.regexp_count(text, F.lit("[一-鿿]")), size)
    return F.when(F.coalesce(size, F.lit(0)) == 0, "unknown").when(share > 0.3, "zh").otherwise("en")


def content_type(title: Column, summary: Column) -> Column:
    return _first_rule(_joined(title, summary), CONTENT_TYPES, "article")


def event_type(title: Column, summary: Column) -> Column:
    return _first_rule(_joined(title, summary), EVENT_TYPES, "default")


def event_window_hours(kind: Column) -> Column:
    out = None
    for label, hours in EVENT_WINDOWS.items():
        out = F.when(kind == label, hours) if out is None else out.when(kind == label, hours)
    return out.otherwise(EVENT_WINDOWS["default"])


def confidence(score: Column) -> Column:
    return F.when(score.isNull(), None).when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


def title_fingerprint(title: Column) -> Column:
    """First 16 hex digits of SHA-256 of the normalised title; empty stays empty."""
    text = normalize_text(to_nfc(title))
    return F.when(text == "", "").otherwise(F.substring(F.sha2(text, 256), 1, 16))


def source_novelty(source: Column, platforms: Column) -> Column:
    """Unknown source 0.5, thread without platforms 1.0, seen platform 0.3, new platform 1.0."""
    return (
        F.when(F.coalesce(source, F.lit("")) == "", 0.5)
        .when(F.size(platforms) == 0, 1.0)
        .when(F.array_contains(platforms, source), 0.3)
        .otherwise(1.0)
    )


def classify_error(raw: Column) -> Column:
    """Struct (code, hint) of a raw error text; the first matching rule wins."""
    text = strip(F.coalesce(raw, F.lit("")))
    low = F.lower(text)
    status = F.regexp_extract(text, r"HTTP\s+(\d{3})", 1)
    http_hint = None
    for code, hint in HTTP_HINTS.items():
        http_hint = F.when(status == code, hint) if http_hint is None else http_hint.when(status == code, hint)
    http_hint = http_hint.when(
        status.startswith("5"), F.concat(F.lit("目标站点暂时不可用（HTTP "), status, F.lit("），稍后会自动重试"))
    ).otherwise(F.concat(F.lit("目标站点返回 HTTP "), status, F.lit("，请检查来源配置")))

    def result(code, hint) -> Column:
        as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(as_col(code).alias("code"), as_col(hint).alias("hint"))

    return (
        F.when(text == "", result("UNKNOWN", HINT_UNKNOWN))
        .when(text.startswith(CONFIG_PREFIX), result("CONFIG_INCOMPLETE", text))
        .when(low.contains("ssrf"), result("SSRF_BLOCKED", HINT_SSRF))
        .when(low.contains("task is paused"), result("TASK_PAUSED", HINT_PAUSED))
        .when(low.contains("task not found"), result("TASK_NOT_FOUND", HINT_MISSING))
        .when(low.contains("too large"), result("RESPONSE_TOO_LARGE", HINT_LARGE))
        .when(status != "", result(F.concat(F.lit("HTTP_"), status), http_hint))
        .when(low.contains("timeout"), result("TIMEOUT", HINT_TIMEOUT))
        .when(low.contains("certificate") | low.contains("ssl"), result("NETWORK", HINT_TLS))
        .when(low.contains("connection") | low.contains("disconnected") | low.contains("network"),
              result("NETWORK", HINT_NETWORK))
        .otherwise(result("INTERNAL", HINT_UNKNOWN))
    )
