"""From raw documents to a training mix, in five stages that each read what the one before has written.

Toxic documents go, repeated passages are cut, one document of each group of near-duplicates stays, documents that
hold too much of the benchmark go, and what is left is mixed to the sources' weights.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmodel.llm import toxicity
from sparkmodel.llm.decontamination import drop_contaminated
from sparkmodel.llm.line_dedup import remove_repeated_lines
from sparkmodel.llm.mixing import mix_documents
from sparkmodel.llm.queries import table
from sparkmodel.llm.runtime import drop_table, scratch, written
from sparkmodel.llm.simhash import keep_one_per_group


def drop_toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a network fitted to the labels scores below one half.

    Null and empty texts have the score of a text without words; of a very long one all windows are scored. Rows with a
    null id and repeated rows are scored each by itself. Columns are those of docs; an empty table stays empty.
    """
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the runs of lines that a document with a smaller id holds; n_chars follows the text.

    Null texts and their n_chars stay, empty texts stay empty, very long ones are cut as a whole. A null id is larger
    than any other; rows that repeat the smallest id all keep their text. Columns are those of docs; an empty table
    stays empty.
    """
    cut = remove_repeated_lines(docs)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def keep_one_near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id.

    Null and empty texts are one group. A row with a null id stays only if its group has no other; of rows that repeat
    an id and its text one stays. Very long texts count whole. Columns are those of docs; an empty table stays empty.
    """
    return keep_one_per_group(docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the benchmark does not contaminate.

    Null and empty texts hold nothing of it; very long texts are searched whole. Rows with a null id and repeated rows
    are judged each by itself. Columns are those of docs; an empty table stays empty.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the mix, with the words that it takes of each, repeats counted.

    Null and empty texts have no words and are left out; very long ones count whole. A null source is a source, a null
    id the text 'null'; repeated rows are taken alike. The columns of docs stay, and those of the mix get a '_' where
    a name is taken; an empty table stays empty.
    """
    return mix_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic_documents),
    ("line_dedup", cut_repeated_passages),
    ("simhash_near_dedup", keep_one_near_duplicate),
    ("decontamination", drop_benchmark_copies),
    ("mixing", mix),
]

#: The stages run a network and compare fingerprints, which SQL does not express: tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table is deleted once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scratch() as made:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
            made.remove(docs)
        drop_table(*before)
        before = [docs]
    return docs
