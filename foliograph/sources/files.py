"""Files to documents and pages: binary files, a pluggable renderer and model, and the ledger's tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.functions import text as X

#: Bytes of images after which a batch of rendered pages ends.
RENDERED_BYTES = 4_000_000


class Renderer(Protocol):
    def __call__(self, name: str, content: bytes) -> list[bytes]:
        """The images of a file's pages, in order."""


class Model(Protocol):
    def __call__(self, page: dict) -> str:
        """The answer for a page (page_id, document_id, page_number, image_hash, image_path)."""


def text_pages(name: str, content: bytes) -> list[bytes]:
    """Stand-in for a renderer: slices of text are the images."""
    text = content.decode(errors="replace")
    return [text[k : k + 1000].encode() for k in range(0, len(text), 1000)]


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """document_id (the content's hash, so that an import repeated is the same), name, type, content; one row a content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.where(X.is_supported(name)).select(F.sha2("content", 256).alias("file_hash"), name.alias("original_filename"), X.detect_file_type(name).alias("file_type"), F.col("path").alias("original_path"), "content")
    first = files.groupBy("file_hash").agg(F.min("original_path").alias("original_path"))
    return files.join(first, ["file_hash", "original_path"], "left_semi").withColumn("document_id", F.substring("file_hash", 1, 32))


def render(files: DataFrame, renderer: Renderer = text_pages) -> DataFrame:
    """One row a page; a file without pages gives one row with an error."""
    names = ["document_id", "page_number", "image", "error"]
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.string()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for doc, name, content in zip(*[b.column(c) for c in ("document_id", "original_filename", "content")], strict=True):
                doc = doc.as_py()
                try:
                    images = renderer(name.as_py(), content.as_py())
                    error = None if images else "pdf_empty_document"
                except Exception as e:
                    images, error = [], f"render_failed: {type(e).__name__}"
                rows += [(doc, k + 1, i, None) for k, i in enumerate(images)] or [(doc, None, None, error)]
                held += sum(len(i or b"") for i in images)
                if held > RENDERED_BYTES:
                    yield table(rows)
                    rows, held = [], 0
            if rows:
                yield table(rows)

    pages = files.select("document_id", "original_filename", "content").mapInArrow(run, "document_id string, page_number long, image binary, error string")
    return pages.withColumn("page_id", F.concat_ws("_", "document_id", F.col("page_number").cast("string"))).withColumn("image_hash", F.sha2("image", 256))


#: What the stand-in model answers, and what a record says that was made of an answer without an object.
MOCK_TITLE, MOCK_SUMMARY, MOCK_TEXT, MOCK_TOPICS, MOCK_KEYWORDS = "第 {} 页", "本地 mock provider 生成的确定性页面分析摘要。", "mock analysis text", ["mock", "analysis"], ["mock"]
MADE_TITLE, MADE_TOPIC, NO_ANSWER = "第 {} 页分析", "页面分析", "模型未返回结构化 JSON，原始响应已保留。"


def mock_model(page: dict) -> str:
    """The same answer for the same page, always."""
    import json

    return json.dumps(
        {
            "schema_version": "page_analysis_v1", "page_id": page["page_id"], "image_hash": page["image_hash"], "image_path": page["image_path"],
            "source": {"document_id": page["document_id"], "page_number": page["page_number"], "original_filename": None},
            "analysis": {"title": MOCK_TITLE.format(page["page_number"]), "summary": MOCK_SUMMARY, "visible_text": MOCK_TEXT, "topics": MOCK_TOPICS, "keywords": MOCK_KEYWORDS},
            "retrieval": {"bm25_text": MOCK_TEXT}, "model": {"provider": "mock", "model_name": "mock-v1"},
        },
        ensure_ascii=False,
    )


def analyse(pages: DataFrame, model: Callable[[dict], str] = mock_model) -> DataFrame:
    """Ask the model for every page, validate its answer, ask once more if that may help.

    outcome is succeeded or failed; record holds the validated record as JSON.
    """
    from foliograph.functions.records import RETRIED, Refused, find_object, validate

    names = ["page_id", "document_id", "page_number", "image_hash", "image_path"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for b in batches:
            out = []
            for row in b[names].itertuples(index=False):
                page = dict(zip(names, row, strict=True))
                page["page_number"] = int(page["page_number"])
                raw, code, record = None, None, None
                for _ in range(2):
                    try:
                        raw = model(page)
                        record, code = json.dumps(validate(raw, page), ensure_ascii=False), None
                        break
                    except Refused as e:
                        code = e.code
                        if code not in RETRIED:
                            break
                    except Exception as e:
                        code = f"model_failed: {type(e).__name__}"
                        break
                if record is None and code == "analysis_json_invalid" and raw and find_object(raw) is None:
                    record, code = json.dumps(text_record(page, raw), ensure_ascii=False), None
                out.append((page["page_id"], "failed" if record is None else "succeeded", code, record))
            yield pd.DataFrame(out, columns=["page_id", "outcome", "error_code", "record"], dtype=object)

    return pages.select(*names).mapInPandas(run, "page_id string, outcome string, error_code string, record string")


def text_record(page: dict, raw: str) -> dict:
    """A record made of an answer that holds no object."""
    from foliograph.functions.records import FIELD_CHARS, WHITE

    shown = raw.strip(WHITE)[:FIELD_CHARS] or NO_ANSWER
    line = next((x.strip(WHITE) for x in shown.split("\n") if x.strip(WHITE)), "")
    return {
        "schema_version": "page_analysis_v1", "page_id": page["page_id"], "image_hash": page["image_hash"], "image_path": page["image_path"],
        "source": {"document_id": page["document_id"], "page_number": page["page_number"], "original_filename": None},
        "analysis": {"title": MADE_TITLE.format(page["page_number"]), "summary": line[:240], "visible_text": shown, "topics": [MADE_TOPIC], "keywords": []},
        "retrieval": {"bm25_text": shown}, "model": {"provider": "mock", "model_name": "mock-v1"},
    }
