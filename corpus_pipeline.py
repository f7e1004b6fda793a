"""A corpus pipeline: toxic documents go, one of each group of near-duplicates stays, personal data is masked, sources are
mixed to target weights, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its decisions hold for all rows its predecessor kept. All
but the last return the columns of documents. Null texts stay null up to packing, where they are empty; rows with a null
doc_id pass; repeated rows pass as often as they come; see the operators for their defined results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm import mixing, neardup, packing, privacy, toxicity
from larkspan.llm._common import cut, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model (operator 10) predicts to be toxic go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), lambda i: ~toxicity.held_out(i))
    return toxicity.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (operator 9) the document with the smallest doc_id stays."""
    return neardup.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data (operator 5) are replaced by their kind; n_chars follows the text."""
    out = privacy.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken to their target weights (operator 1); n_chars follows the text."""
    out = mixing.mixed_documents(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences (operator 6)."""
    return packing.pack(packing.pieces(docs, with_ids=False))


STAGES = [("toxicity", toxic), ("near-duplicates", near_duplicates), ("personal data", personal_data), ("mixing", mix), ("packing", pack)]

#: The models of toxicity and personal data can't be expressed in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
