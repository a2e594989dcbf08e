"""What a model is asked for a page, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliograph.functions.text import sanitize_language
from foliograph.schemas import SCHEMA_VERSION

#: The texts that a model gets, word for word, but for the assistant's name.
CONTRACT = """你是 Foliograph 的页面图片分析器。你必须只返回一个符合 schema_version=page_analysis_v1 的 JSON 对象。

规则：
- 所有可见内容摘要、标题、主题、关键词和检索文本都使用中文。
- 必须严格按照下方“固定 JSON 输出模板”返回；不要增加字段，不要删除字段，不要改字段名，不要改变嵌套结构。
- `schema_version`、`page_id`、`image_hash`、`image_path`、`source`、`model` 中已经给出的值必须逐字保留。
- 只允许根据图片内容填写或替换 `analysis` 和 `retrieval.bm25_text` 的值。
- `analysis.title`、`analysis.summary`、`analysis.visible_text` 必须是字符串；没有内容时使用空字符串。
- `analysis.topics` 和 `analysis.keywords` 必须是字符串数组；没有内容时使用空数组。
- `retrieval.bm25_text` 必须是字符串，优先综合标题、摘要、可见文字、主题和关键词。
- 不要使用 Markdown 代码块，不要在 JSON 前后添加解释、寒暄或额外文本。
- 第一个非空白字符必须是 `{`，最后一个非空白字符必须是 `}`。
- 不要包含 API key、Authorization header、token、credential、secret 或 request body。
- 输出保持紧凑：summary 不超过 120 个中文字符，visible_text 不超过 800 个中文字符，topics 不超过 6 项，keywords 不超过 12 项，retrieval.bm25_text 不超过 1000 个中文字符。
"""
LANGUAGE, VERSION = "\n输出语言：", f'\nschema_version 字段必须是 "{SCHEMA_VERSION}"。'
TEMPLATE, TASK = "\n\n固定 JSON 输出模板：\n", "\n\n请分析随请求附带的页面图片，保持模板中的所有字段、字段顺序、字段类型和身份字段值不变，只填写 analysis 和 retrieval.bm25_text。最终输出只能是一个完整 JSON 对象。"
AGAIN = ("\n\n上一次输出未通过 page_analysis_v1 格式校验，错误摘要：", "\n请重新生成，必须严格返回规定 JSON 对象，不要返回纯文本、Markdown、数组或解释。")


def _quoted(c: Column) -> Column:
    """A string as JSON writes it."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


def template(page_id: Column, document_id: Column, page_number: Column, image_hash: Column, image_path: Column, provider: Column, model: Column) -> Column:
    """The record that is to be filled in, its names in order."""
    lines = [
        F.lit('{\n  "analysis": {\n    "keywords": [],\n    "summary": "",\n    "title": "",\n    "topics": [],\n    "visible_text": ""\n  },\n  "image_hash": '), _quoted(image_hash),
        F.lit(',\n  "image_path": '), _quoted(image_path), F.lit(',\n  "model": {\n    "model_name": '), _quoted(model), F.lit(',\n    "provider": '), _quoted(provider),
        F.lit('\n  },\n  "page_id": '), _quoted(page_id), F.lit(f',\n  "retrieval": {{\n    "bm25_text": ""\n  }},\n  "schema_version": "{SCHEMA_VERSION}",\n  "source": {{\n    "document_id": '), _quoted(document_id),
        F.lit(',\n    "original_filename": null,\n    "page_number": '), page_number.cast("string"), F.lit("\n  }\n}"),
    ]
    return F.concat(*lines)


def contract(language: Column) -> Column:
    return F.concat(F.lit(CONTRACT + LANGUAGE), sanitize_language(language), F.lit(VERSION))


def analysis(language: Column, made: Column) -> Column:
    """The prompt for a page: contract, template and task."""
    return F.concat(contract(language), F.lit(TEMPLATE), made, F.lit(TASK))


def repair(prompt: Column, problem: Column) -> Column:
    """The prompt after an answer that was refused."""
    return F.concat(prompt, F.lit(AGAIN[0]), problem, F.lit(AGAIN[1]))
