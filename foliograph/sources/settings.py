"""Settings in layers: what is built in, what the workspace's ledger holds, what a file beside it says."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from foliograph.operators.mutations import LedgerProblem
from foliograph.sources.commits import hadoop, read_file, replace_file

#: The settings and what they are as long as nobody says otherwise; the key of the ledger's record.
DEFAULTS = {
    "model_provider": "siliconflow", "base_url": "", "custom_endpoint": "", "model_name": "", "default_image_dpi": 144, "conversion_concurrency": 2, "analysis_concurrency": 2,
    "api_enabled": False, "api_bind_address": "127.0.0.1", "api_port": 17321, "libreoffice_path": None,
}
RECORD = "app_settings"


def load(spark: SparkSession, path: str, default: dict, code: str = "settings_parse_failed") -> dict:
    """A file of JSON; the default where there is none, an error where it holds no object."""
    fs, p = hadoop(spark, path)
    if not fs.exists(p):
        return dict(default)
    try:
        found = json.loads(read_file(spark, path))
    except ValueError as e:
        raise LedgerProblem(code, str(e)) from e
    if not isinstance(found, dict):
        raise LedgerProblem(code, "no object")
    return found


def save(spark: SparkSession, path: str, values: dict) -> None:
    replace_file(spark, path, json.dumps(values, ensure_ascii=False))


def merged(record: str | None, file: dict) -> dict:
    """The layers over each other, the last one said first; names that are no settings are left out."""
    try:
        own = json.loads(record) if record else {}
    except ValueError as e:
        raise LedgerProblem("settings_parse_failed", str(e)) from e
    return {k: file.get(k, own.get(k, v)) for k, v in DEFAULTS.items()}
