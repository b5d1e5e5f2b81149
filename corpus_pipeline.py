"""From raw documents to packed training sequences: five operators, one after another.

Each stage is written as Parquet and read again, so a lost executor costs at
most a stage, and each works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treemend.llm.common import learnable, prepare
from treemend.llm.langid import fit_languages, language_column
from treemend.llm.mixing import mixed_documents
from treemend.llm.packing import pack_documents
from treemend.llm.queries import tokenizer_path
from treemend.llm.secrets import redact_secrets
from treemend.llm.simhash import drop_near_duplicates
from treemend.session import cut_lineage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that no language model accepts: null, without a letter, or unlike any language.

    Repeated rows are judged alike; a table that teaches no language keeps none of its rows.
    """
    prepare(spark)
    predict = language_column(fit_languages(docs.where(learnable(docs["doc_id"])).select("lang", "text")))
    return docs.where(~predict(docs["text"])["rejected"])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, repeated rows among them; null texts are copies of each other."""
    return drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated rows too, their secrets replaced; null texts stay null."""
    return redact_secrets(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the target weights of their sources take them; null sources are one source."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences; null texts are the end id alone."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("packing", packing),
]
# Models, components and budgets have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES):
            docs = cut_lineage(docs)
    return docs
