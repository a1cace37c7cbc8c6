"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from retailcast.llm import (
    decontaminate,
    filter_audit,
    line_dedup,
    order_minhash,
    packing,
    pii,
    prefix_join,
    quality,
    simhash,
    sql,
    token_files,
    toxicity,
    url_filter,
    whitening,
)
from retailcast.llm.common import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    return token_files.token_index(table(spark, sf_dir, "documents"), definition)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, groups=simhash.near_duplicates(docs))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_join.similar_groups(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = filter_audit.pattern_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filter_audit.audit(counts)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality,
        op2_simhash,
        op3_decontaminate,
        op4_order_minhash,
        op5_token_files,
        op6_toxicity,
        op7_line_dedup,
        op8_url_filter,
        op9_packing,
        op10_pii,
        op11_whitening,
        op12_prefix_join,
        op13_filter_audit,
    )
}
ORACLES = {
    "op3_decontaminate": sql.DECONTAMINATE,
    "op7_line_dedup": sql.LINE_DEDUP,
    "op13_filter_audit": sql.FILTER_AUDIT,
}
