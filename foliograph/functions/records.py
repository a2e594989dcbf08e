"""The page-analysis record: finding it in a model's answer, checking it, redacting it.

Finding a balanced object and walking a value of any shape need recursion, so
these run as Arrow-batched pandas functions; everything that Catalyst can say
is in text.py.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliograph.functions.text import SPACE

PAYLOAD_BYTES, FIELD_CHARS, TOTAL_CHARS, ARRAY_ITEMS = 1_000_000, 50_000, 250_000, 512
#: Errors after which the model is asked once more.
RETRIED = ("analysis_json_invalid", "analysis_field_missing", "analysis_schema_version_unsupported", "analysis_field_invalid", "analysis_retrieval_text_missing")
WHITE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

_TEXT, _OPTIONAL = (str,), (str, type(None))
#: What the record may hold: name to kind; a trailing ? marks what may be missing or null.
SHAPE = {
    "schema_version": "text?", "page_id": "text?", "image_hash": "text?", "image_path": "text?",
    "source": {"document_id": "text", "page_number": "whole", "original_filename": "text?"},
    "analysis": {"title": "text?", "summary": "text?", "visible_text": "text?", "topics": "texts", "keywords": "texts"},
    "retrieval": {"bm25_text": "text?"},
    "model": {"provider": "text", "model_name": "text"},
    "provider_response": {"endpoint_kind": "text", "raw_json": "text"},
}


def find_object(raw: str | None) -> str | None:
    """The record in an answer: the whole of it, a fenced block, or the first balanced object."""
    if raw is None:
        return None
    text = raw.strip(WHITE)
    if text[:1] == "{" and text[-1:] == "}":
        return text
    head, fence, rest = text.partition("```")
    if fence:
        line = rest.find("\n") + 1
        body, closing, _ = rest[line:].partition("```")
        body = body.strip(WHITE)
        if closing and body[:1] == "{" and body[-1:] == "}":
            return body
    start = text.find("{")
    depth, quoted, k = 0, False, start
    while 0 <= k < len(text):
        c = text[k]
        if quoted:
            if c == "\\":
                k += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return text[start : k + 1]
        k += 1
    return None


class Refused(Exception):
    def __init__(self, code: str, path: str = "$"):
        super().__init__(code)
        self.code, self.path = code, path


def check_bounds(value, path: str = "$") -> None:
    """Lengths of strings and arrays, in order; keys do not count."""
    total = 0
    todo = [(value, path)]
    while todo:
        v, at = todo.pop()
        if isinstance(v, str):
            total += len(v)
            if len(v) > FIELD_CHARS or total > TOTAL_CHARS:
                raise Refused("analysis_text_too_long", at)
        elif isinstance(v, list):
            if len(v) > ARRAY_ITEMS:
                raise Refused("analysis_array_too_large", at)
            todo.extend((x, f"{at}[{k}]") for k, x in reversed(list(enumerate(v))))
        elif isinstance(v, dict):
            todo.extend((x, f"{at}.{k}") for k, x in reversed(sorted(v.items())))


def _check_shape(value, shape: dict, path: str) -> None:
    if not isinstance(value, dict):
        raise Refused("analysis_field_invalid", path or "$")
    at = lambda name: f"{path}.{name}" if path else name
    for name, v in value.items():
        if name not in shape:
            raise Refused("analysis_field_invalid", at(name))
        kind = shape[name]
        if isinstance(kind, dict):
            if v is not None:
                _check_shape(v, kind, at(name))
        elif kind == "texts":
            if not isinstance(v, list) or not all(isinstance(x, str) for x in v):
                raise Refused("analysis_field_invalid", at(name))
        elif kind == "whole":
            if not isinstance(v, int) or isinstance(v, bool):
                raise Refused("analysis_field_invalid", at(name))
        elif not (isinstance(v, str) or v is None and kind.endswith("?")):
            raise Refused("analysis_field_invalid", at(name))
    if path:
        for name, kind in shape.items():
            if kind in ("text", "whole") and name not in value:
                raise Refused("analysis_field_invalid", at(name))


def validate(raw: str | None, expected: dict) -> dict:
    """The record, complete, or Refused; the first check that fails says why."""
    found = find_object(raw)
    if found is None:
        raise Refused("analysis_json_invalid", "no complete JSON object found")
    if len(found.encode()) > PAYLOAD_BYTES:
        raise Refused("analysis_payload_too_large")
    try:
        value = json.loads(found, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        raise Refused("analysis_json_invalid") from None
    check_bounds(value)
    _check_shape(value, SHAPE, "")
    if value.get("schema_version") is None:
        raise Refused("analysis_field_missing", "schema_version")
    if value["schema_version"] != "page_analysis_v1":
        raise Refused("analysis_schema_version_unsupported", "schema_version")
    for name in ("page_id", "image_hash", "image_path"):
        if value.get(name) is None:
            raise Refused("analysis_field_missing", name)
        if value[name] != expected[name]:
            raise Refused(f"analysis_{name}_mismatch", name)
    if value.get("source") is None:
        raise Refused("analysis_field_missing", "source")
    for name in ("document_id", "page_number"):
        if value["source"][name] != expected[name]:
            raise Refused(f"analysis_{name}_mismatch", f"source.{name}")
    for name in ("analysis", "model", "retrieval"):
        if value.get(name) is None:
            raise Refused("analysis_field_missing", name)
    a = value["analysis"]
    given = (value["retrieval"].get("bm25_text") or "").strip(WHITE)
    if not given:
        parts = [a.get("title"), a.get("summary"), a.get("visible_text"), *a.get("topics", []), *a.get("keywords", [])]
        given = "\n".join(p for p in ((x or "").strip(WHITE) for x in parts) if p)
    if not given:
        raise Refused("analysis_retrieval_text_missing", "retrieval.bm25_text")
    value["retrieval"] = {"bm25_text": given}
    a.setdefault("topics", [])
    a.setdefault("keywords", [])
    return value


def _no_constant(name: str):
    raise ValueError(name)


def redact(value):
    """Secrets and images taken out of a value, long strings cut."""
    if isinstance(value, dict):
        out = {}
        for k, v in value.items():
            low = k.lower()
            hidden = any(w in low for w in ("api_key", "authorization", "token", "secret")) or low in ("image_base64", "data")
            out[k] = "[redacted]" if hidden else redact(v)
        return out
    if isinstance(value, list):
        return [redact(v) for v in value]
    if isinstance(value, str):
        start = value[:32].lower()
        return "[redacted-image-data-url]" if start.startswith("data:image/") and ";base64," in start else value[:FIELD_CHARS]
    return value


def redact_text(raw: str | None) -> str | None:
    if raw is None:
        return None
    try:
        value = json.loads(raw, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return f"provider_response_bytes={len(raw.encode())}"
    return json.dumps(redact(value), ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(T.StringType())
def _find_udf(raw: pd.Series) -> pd.Series:
    return raw.map(find_object, na_action="ignore").astype(object)


@F.pandas_udf(T.StringType())
def redact_json(raw: pd.Series) -> pd.Series:
    return raw.map(redact_text, na_action="ignore").astype(object)


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("error_code", "error_path")]))
def bounds_error(raw: pd.Series) -> pd.DataFrame:
    def one(text):
        try:
            if isinstance(text, str):
                check_bounds(json.loads(text))
            return (None, None)
        except Refused as e:
            return (e.code, e.path)
        except ValueError:
            return ("analysis_json_invalid", "$")

    return pd.DataFrame([one(t) for t in raw], columns=["error_code", "error_path"], dtype=object)


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("error_code", "error_path", "record")]))
def validated(raw: pd.Series, page_id: pd.Series, document_id: pd.Series, page_number: pd.Series, image_hash: pd.Series, image_path: pd.Series) -> pd.DataFrame:
    def one(text, *context):
        try:
            value = validate(text if isinstance(text, str) else None, dict(zip(("page_id", "document_id", "page_number", "image_hash", "image_path"), context, strict=True)))
            return (None, None, json.dumps(value, ensure_ascii=False, separators=(",", ":")))
        except Refused as e:
            return (e.code, e.path, None)

    return pd.DataFrame([one(*x) for x in zip(raw, page_id, document_id, page_number, image_hash, image_path, strict=True)], columns=["error_code", "error_path", "record"], dtype=object)


def extract_json(raw: Column) -> Column:
    """Plain objects never leave the JVM; only answers with something around them are scanned."""
    trimmed = F.regexp_replace(raw, rf"^{SPACE}+|{SPACE}+$", "")
    return F.when(trimmed.startswith("{") & trimmed.endswith("}"), trimmed).otherwise(_find_udf(raw))


def is_retried(code: Column) -> Column:
    return F.coalesce(code.isin(*RETRIED), F.lit(False))


def repair_outcome(first: Column, first_path: Column, second: Column, second_path: Column) -> Column:
    """What becomes of a page after at most two answers."""
    no_object = (second == "analysis_json_invalid") & (second_path == "no complete JSON object found")
    return F.when(first.isNull(), "saved").when(~is_retried(first), "failed").when(second.isNull(), "saved_after_retry").when(no_object, "saved_as_text").otherwise("failed_after_retry")
