"""A corpus pipeline of five stages over `documents`; each stage is written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from podium.llm import lines, minhash, mixing, packing, quality
from podium.llm.common import materialize, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null, empty and short texts are rejected. Repeated rows are judged alike, other
    columns stay as they are. An empty table stays empty."""
    return quality.keep_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; every document stays, n_chars follows its text. A null text stays null; of equal lines that of the
    smallest doc_id stays, null last; rows with equal doc_id and text come out alike. An empty table stays empty."""
    return lines.dedup_lines(docs).selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) as n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, null doc_id or not, repeated rows too; those without a word have no copies
    and stay. An empty table stays empty."""
    return minhash.drop_near_duplicates(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents repeated or cut as taken. Null sources are a source; null and wordless texts go; repeated rows
    take their places one after the other. An empty table stays empty."""
    out = mixing.take_documents(docs)
    return out.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) as n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens. A null text is empty; repeated rows and null doc_ids are packed each
    for itself. An empty table gives no pieces."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mixing", mix),
    ("packing", pack),
]

#: Compression, MinHash candidates and tokens can't be expressed in SQL; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written in the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
