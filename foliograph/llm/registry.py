"""The operators as queries over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliograph.llm import ann, bpe, exact_dedup, fim, html, line_dedup, mixing, near_dup, pieces, pii, tokenfile, toxicity, trie
from foliograph.llm.common import table


def op1_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), "byte_bpe_multi_50k.tiktoken")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate(table(spark, sf_dir, "pages"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.write_and_read(table(spark, sf_dir, "documents"), vocabulary="byte_bpe_50k.json", end=2)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.learn(documents, table(spark, sf_dir, "labels")))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.join(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"), plain_share=10, spm_share=20, seed="1")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), "piece_bpe_32k.model")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(table(spark, sf_dir, "conversations"), family=20, shared=4)


QUERIES = (op1_pareto_mixing, op2_html_extraction, op3_byte_bpe, op4_exact_dedup, op5_line_dedup, op6_nearest_neighbours, op7_token_files, op8_pii, op9_toxicity, op10_near_duplicates, op11_fill_in_middle, op12_sentencepiece, op13_conversation_trie)


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_pareto_mixing": mixing.ORACLE, "op4_exact_dedup": exact_dedup.ORACLE, "op5_line_dedup": line_dedup.oracle(), "op11_fill_in_middle": fim.ORACLE, "op13_conversation_trie": trie.ORACLE}
