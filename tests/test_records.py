"""Records, redaction and text functions against fixed vectors."""

import json

import pytest
from pyspark.sql import functions as F

from foliograph.functions import records as R
from foliograph.functions import text as X

#: Identifiers, codes, paths and limits in this file are fixed values of the record's format; the texts are our own.
CONTEXT = {"page_id": "atlas_7", "document_id": "atlas", "page_number": 7, "image_hash": "c0ffee", "image_path": "pages/atlas/c0ffee.png"}


def record(**changes):
    """An answer for page 7 of an atlas; ``...`` takes a field out."""
    out = dict(CONTEXT) | {"schema_version": "page_analysis_v1", "retrieval": {}, "model": {"provider": "none", "model_name": "hand"}}
    out["source"] = {"document_id": out.pop("document_id"), "page_number": out.pop("page_number"), "original_filename": None}
    out["analysis"] = {"title": "Harbour plan", "summary": "Piers and depths", "visible_text": "Pier 4, 12 m", "topics": ["ports", "tides"], "keywords": ["sounding"]}
    for k, v in changes.items():
        if v is ...:
            del out[k]
        else:
            out[k] = v
    return json.dumps(out)


def code(raw):
    try:
        R.validate(raw, CONTEXT)
    except R.Refused as e:
        return e.code, e.path
    return None


def test_accepted_and_filled():
    assert R.validate(record(), CONTEXT)["retrieval"]["bm25_text"] == "Harbour plan\nPiers and depths\nPier 4, 12 m\nports\ntides\nsounding"
    again = R.validate(record(), CONTEXT)
    assert R.validate(json.dumps(again), CONTEXT) == again
    assert code("Here you are\n```json\n" + record() + "\n```") is None
    assert code("north of it " + record(analysis={"title": 'a quay {4} "east"'}) + " south") is None


@pytest.mark.parametrize(
    "raw, want",
    [
        (record(page_id="c0ffee"), ("analysis_page_id_mismatch", "page_id")),
        (record(image_hash="decaf"), ("analysis_image_hash_mismatch", "image_hash")),
        (record(image_path="pages/decaf.png"), ("analysis_image_path_mismatch", "image_path")),
        (record(schema_version="page_analysis_v2"), ("analysis_schema_version_unsupported", "schema_version")),
        (record(schema_version=...), ("analysis_field_missing", "schema_version")),
        (record(source={"document_id": "atlas", "page_number": "7"}), ("analysis_field_invalid", "source.page_number")),
        (record(source={"document_id": "globe", "page_number": 7}), ("analysis_document_id_mismatch", "source.document_id")),
        (record(source={"document_id": "atlas", "page_number": 8}), ("analysis_page_number_mismatch", "source.page_number")),
        (record(retrieval=...), ("analysis_field_missing", "retrieval")),
        (record(scale=1), ("analysis_field_invalid", "scale")),
        (record(analysis={"topics": ["t"] * 513}), ("analysis_array_too_large", "$.analysis.topics")),
        (record(analysis={"visible_text": "x" * 50_001}), ("analysis_text_too_long", "$.analysis.visible_text")),
        (record(analysis={"title": " "}), ("analysis_retrieval_text_missing", "retrieval.bm25_text")),
        (record(analysis={"keywords": ["x" * 49_000] * 6}), ("analysis_text_too_long", "$.analysis.keywords[5]")),
        ('{"a": "' + "x" * 1_000_000 + '"}', ("analysis_payload_too_large", "$")),
        ('{"depth": "12', ("analysis_json_invalid", "no complete JSON object found")),
        (None, ("analysis_json_invalid", "no complete JSON object found")),
    ],
)
def test_refused(raw, want):
    assert code(raw) == want


def test_redaction(spark):
    # the names before the signs are fixed values; the words after them are our own
    hidden = ["call with api_key=kelp", "apikey: kelp", "API_KEY: kelp", "Authorization: Bearer kelp", "sent bearer kelp", "token=kelp99", "secret: kelp", "image_base64=kelp", "request_body=kelp", "raw_response=kelp", "x-api-key: kelp"]
    shown = ["pier 4 was sounded twice", "a token of thanks for the crew", "z" * 900]
    df = spark.createDataFrame([(x,) for x in hidden + shown], "t string").select(X.redact_secrets(F.col("t")).alias("r"))
    got = [r.r for r in df.collect()]
    assert got == ["[redacted]"] * len(hidden) + shown[:2] + ["z" * 800]
    assert json.loads(R.redact_text('{"usage":{"total_tokens":3},"x":["data:image/png;base64,AA"],"data":1}')) == {"usage": {"total_tokens": "[redacted]"}, "x": ["[redacted-image-data-url]"], "data": "[redacted]"}
    assert R.redact_text("no") == "provider_response_bytes=2"


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(X.ws_trim(F.lit("　\t a b \n"))) == "a b"
    assert one(F.octet_length(F.lit("正文"))) == 6
    assert {"合同", "审查"} <= set(one(X.bigrams(F.lit("合同审查要点"))))
    assert one(X.bigrams(F.lit("x"))) == []
    assert [one(X.bounded_progress(F.lit(x))) for x in (float("nan"), -3.0, 49.5, 200.0)] == [0, 0, 50, 100]
    assert one(X.endpoint_error(F.lit("http://127.0.0.1:1/x"))) is None
    assert one(X.provider_name(F.lit("openai"), F.lit(""), F.lit(""), F.lit("MiMo-7b"))) == "mimo"
