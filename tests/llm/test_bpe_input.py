"""Which inputs of the byte-level BPE are written down before they are read twice."""

import pytest
from pyspark.sql import functions as F

from foliograph.llm import bpe


@pytest.mark.parametrize("change, written", [(lambda d: d, False), (lambda d: d.where("doc_id > 3").withColumn("text", F.coalesce("text", F.lit(""))), False), (lambda d: d.repartition(3), True), (lambda d: d.coalesce(1), True), (lambda d: d.mapInArrow(lambda b: b, d.schema), True), (lambda d: d.sample(0.5, seed=1), True), (lambda d: d.persist(), True)])
def test_plain_scans_are_not_written_again(spark, monkeypatch, change, written):
    seen = []
    own = bpe.cut
    monkeypatch.setattr(bpe, "cut", lambda df, name: seen.append(name) or own(df, name))
    docs = change(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))
    bpe.encode(docs)
    assert bool(seen) is written
