"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters that Unicode calls white space.
SPACE = r"[\x{0009}-\x{000D}\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SPACES = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: What is followed by a secret, if an assignment follows.
SECRET_KEYS = ("api_key", "api-key", "apikey", "authorization", "image_base64", "raw_response", "request_body", "token", "secret")
REDACTED = "[redacted]"
LONGEST_DETAIL = 800
#: Job messages once stored in a wrong encoding, and what they said.
LEGACY = (("椤甸潰鍒嗘瀽瀹屾垚", "页面分析完成"), ("鎵归噺鍒嗘瀽瀹屾垚", "批量分析完成"), ("璇婃柇缂栧彿锛歿}", "诊断编号: "), ("鐠囧﹥鏌囩紓鏍у娇閿涙}", "诊断编号: "))


def ws_trim(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def blank_to_null(c: Column) -> Column:
    return F.nullif(ws_trim(c), F.lit(""))


def detect_file_type(path: Column) -> Column:
    """By extension in all-lower or all-upper case only."""
    ext = F.regexp_extract(path, r"\.([^./\\]*)$", 1)
    known = ext.isin("pdf", "PDF", "doc", "DOC", "docx", "DOCX", "ppt", "PPT", "pptx", "PPTX")
    return F.when(known, F.lower(ext)).otherwise("unknown")


def is_supported(path: Column) -> Column:
    """Any case; from the last point to the end."""
    return F.lower(F.regexp_extract(path, r"(\.[^.]*)$", 1)).isin(".pdf", ".doc", ".docx", ".ppt", ".pptx")


def sanitize_filename(c: Column) -> Column:
    return ws_trim(F.regexp_replace(c, r'[/\\:*?"<>|\x00]', "_"))


def stored_name(file_hash: Column, name: Column) -> Column:
    return F.concat(F.substring(file_hash, 1, 16), F.lit("_"), sanitize_filename(name))


def image_mime(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))
    return F.when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext == "webp", "image/webp").otherwise("image/png")


def is_safe_relative(path: Column) -> Column:
    """Neither absolute nor with a parent step."""
    return ~path.rlike(r"^([/\\]|[A-Za-z]:)") & ~path.rlike(r"(^|[/\\])\.\.([/\\]|$)")


def path_display(c: Column) -> Column:
    plain = F.when(c.startswith("\\\\?\\UNC\\"), F.concat(F.lit("\\\\"), F.substring(c, F.lit(9), F.length(c)))).when(c.startswith("\\\\?\\"), F.substring(c, F.lit(5), F.length(c))).otherwise(c)
    return plain


def forward_slashes(c: Column) -> Column:
    return F.translate(c, "\\", "/")


def searched_parts(title: Column, summary: Column, visible: Column, topics: Column, keywords: Column, bm25: Column, filename: Column) -> list[Column]:
    joined = lambda a: F.when(F.size(a) > 0, F.array_join(a, " "))
    return [*map(blank_to_null, (title, summary, visible)), joined(topics), joined(keywords), blank_to_null(bm25), blank_to_null(filename)]


def combined_text(*parts: Column) -> Column:
    """Everything of a page that is searched (title, summary, visible, topics, keywords, bm25, filename), one part a line; blank parts are left out."""
    return F.concat_ws("\n", *searched_parts(*parts))


def is_searched(*parts: Column) -> Column:
    """Whether the combined text is not blank: told by its first part that is not, without putting it together."""
    return F.coalesce(*map(blank_to_null, searched_parts(*parts))).isNotNull()


def bm25_text(given: Column, title: Column, summary: Column, visible: Column, topics: Column, keywords: Column) -> Column:
    """The text given for retrieval, or else all others; null if nothing is left."""
    listed = F.concat(F.array(title, summary, visible), F.coalesce(topics, F.array()), F.coalesce(keywords, F.array()))
    parts = F.filter(F.transform(listed, lambda x: ws_trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(blank_to_null(given), F.nullif(F.array_join(parts, "\n"), F.lit("")))


def redact_secrets(c: Column) -> Column:
    low = F.lower(c)
    assigned = F.lit(False)
    for key in SECRET_KEYS:
        at = F.locate(key, low)
        assigned = assigned | ((at > 0) & F.substring(c, at + len(key), F.length(c)).rlike(rf"^{SPACE}*[:=]"))
    return F.when(low.contains("authorization:") | low.contains("bearer ") | assigned, REDACTED).otherwise(F.left(c, F.lit(LONGEST_DETAIL)))


def first_line_summary(c: Column, longest: int = 240) -> Column:
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: ws_trim(x)), lambda x: x != "")
    return F.left(F.coalesce(F.get(lines, 0), F.lit("")), F.lit(longest))


def ui_truncate(c: Column, longest: int) -> Column:
    return F.when(F.length(c) > longest, F.concat(F.left(c, F.lit(longest)), F.lit("..."))).otherwise(c)


def failure_summary(message: Column, correlation: Column, details: Column) -> Column:
    """With the first 200 characters of the details, if there are any."""
    return F.concat(message, F.lit(" 诊断编号: "), correlation, F.coalesce(F.concat(F.lit(" "), F.left(details, F.lit(200))), F.lit("")))


def legacy_text(c: Column) -> Column:
    for wrong, right in LEGACY:
        c = F.replace(c, F.lit(wrong), F.lit(right))
    return c


def progress_status(progress: Column) -> Column:
    return F.when(progress >= 100, "succeeded").otherwise("running")


def batch_progress(done: Column, total: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(99), F.floor(done * 98 / total) + 1))


def import_progress(i: Column, n: Column, base: int, span: int) -> Column:
    return F.least(F.lit(90), base + F.floor((i + 1) * span / n))


def bounded_progress(c: Column) -> Column:
    finite = F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)
    return F.least(F.greatest(F.floor(finite + 0.5), F.lit(0)), F.lit(100))


def http_status(code: Column) -> Column:
    return F.when(code.startswith("api_server_"), 503).when(code.startswith("not_found") | code.contains("_not_found"), 404).when(code.startswith("validation_"), 400).otherwise(500)


def sanitize_language(c: Column) -> Column:
    kept = F.regexp_replace(F.left(ws_trim(c), F.lit(40)), r"[^\p{IsAlphabetic}\p{N}\-_ ]", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.trim(kept), " +", " "), F.lit("")), F.lit("unspecified"))


def vendor_content(kind: Column, raw: Column) -> Column:
    return F.when(kind == "anthropic", F.get_json_object(raw, "$.content[0].text")).otherwise(F.get_json_object(raw, "$.choices[0].message.content"))


def endpoint(base: Column, custom: Column) -> Column:
    """The address that a request goes to."""
    base, custom = F.regexp_replace(ws_trim(base), "/+$", ""), ws_trim(custom)
    low = F.lower(base)
    default = F.when(low.endswith("/chat/completions"), base).when(low.endswith("/v1"), F.concat(base, F.lit("/chat/completions"))).otherwise(F.concat(base, F.lit("/v1/chat/completions")))
    return (
        F.when(custom.startswith("http://") | custom.startswith("https://"), custom)
        .when(base == "", "https://api.openai.com/v1/chat/completions")
        .when(custom == "", default)
        .otherwise(F.concat(base, F.lit("/"), F.regexp_replace(custom, "^/+", "")))
    )


def endpoint_error(url: Column) -> Column:
    """Null if requests may go there: https, or http to this machine."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    return (
        F.when(scheme == "", "model_endpoint_invalid")
        .when(scheme == "https", F.when(host == "", "model_endpoint_invalid"))
        .when(scheme == "http", F.when(host == "", "model_endpoint_invalid").when(~host.isin("localhost", "127.0.0.1"), "model_endpoint_insecure"))
        .otherwise("model_endpoint_invalid_scheme")
    )


def provider_name(provider: Column, base: Column, custom: Column, model: Column) -> Column:
    provider = ws_trim(provider)
    address = F.lower(F.coalesce(blank_to_null(custom), ws_trim(base)))
    own = address.contains("xiaomimimo.com") | F.lower(ws_trim(model)).startswith("mimo-")
    return F.when(provider.isin("mimo", "xiaomi", "xiaomimimo") | ((provider == "openai") & own), "mimo").otherwise(provider)


#: The providers that are known; each has an endpoint of its own and wants a key.
PROVIDERS = ("siliconflow", "mimo", "openai", "anthropic")


def model_name(c: Column) -> Column:
    """Trimmed; names of one family are lower-cased, others stay."""
    trimmed = ws_trim(c)
    return F.when(F.lower(trimmed).startswith("mimo-"), F.lower(trimmed)).otherwise(trimmed)


def missing_configuration(provider: Column, base: Column, custom: Column, model: Column, has_key: Column) -> Column:
    """Names of what is still to be set before a model can be asked, in order."""
    name = provider_name(provider, base, custom, model)
    known = name.isin(*PROVIDERS)
    blank = lambda c: F.coalesce(ws_trim(c), F.lit("")) == ""
    checks = (("model_provider", ~known), ("model_name", blank(model)), ("endpoint", ~known & blank(base) & blank(custom)), ("api_key", ~F.coalesce(has_key, F.lit(False))))
    return F.array_compact(F.array(*[F.when(wrong, field) for field, wrong in checks]))


def date_label(c: Column) -> Column:
    """A time as it is shown, short; what is no time is shown as it is."""
    return F.coalesce(F.date_format(F.try_to_timestamp(c), "y/M/d HH:mm:ss"), c)


def bigrams(c: Column) -> Column:
    """All character pairs of the whole text, lower-cased: an empty match before each pair, which it captures."""
    return F.regexp_extract_all(F.lower(c), F.lit("(?s)(?=(..))"), F.lit(1))


def settings_problems(dpi: Column, conversion: Column, analysis: Column, port: Column, host: Column) -> Column:
    """Names of the settings out of range."""
    checks = (("default_image_dpi", dpi.between(72, 300)), ("conversion_concurrency", conversion.between(1, 8)), ("analysis_concurrency", analysis.between(1, 8)), ("api_port", port >= 1024), ("api_host", host.isin("127.0.0.1", "localhost", "::1")))
    return F.array_compact(F.array(*[F.when(~ok, name) for name, ok in checks]))
