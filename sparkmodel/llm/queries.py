"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmodel.llm import toxicity, warc
from sparkmodel.llm.decontamination import contamination_sql, find_contamination
from sparkmodel.llm.lattice import embedding_groups
from sparkmodel.llm.line_dedup import remove_repeated_lines
from sparkmodel.llm.mixing import mix_sources, mix_sql
from sparkmodel.llm.secrets import find_secrets
from sparkmodel.llm.simhash import simhash_groups
from sparkmodel.llm.token_counts import token_counts
from sparkmodel.llm.url_filter import judge_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back by index."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix of all sources takes."""
    return mix_sources(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credentials in every document. A document stands for a repository and its source for the owner."""
    return find_secrets(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by a network fitted to labelled rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the benchmark stands verbatim in each document; the longest matches as item:start:words, by item."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    match = F.transform("matches", lambda m: F.concat_ws(":", m["item_id"], m["start"].cast("string"), m["words"].cast("string")))
    return found.withColumn("matches", F.array_join(match, ","))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the byte-level vocabulary."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the chunks of lines that documents with smaller ids hold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_lines(docs, report=True)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents."""
    return simhash_groups(table(spark, sf_dir, "documents"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of near-duplicate embeddings."""
    return embedding_groups(table(spark, sf_dir, "embeddings"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on the URL of every page."""
    return judge_urls(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_mixing": op2_mixing,
        "op3_secrets": op3_secrets,
        "op4_toxicity": op4_toxicity,
        "op5_decontamination": op5_decontamination,
        "op6_token_counts": op6_token_counts,
        "op7_line_dedup": op7_line_dedup,
        "op8_simhash": op8_simhash,
        "op9_embeddings": op9_embeddings,
        "op10_url_filter": op10_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": warc.SQL,
        "op2_mixing": mix_sql(),
        "op5_decontamination": contamination_sql(),
    }
