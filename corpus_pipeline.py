"""A corpus pipeline: toxicity, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread as
the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regimelake.llm import near_dedup, packing, substring_dedup, toxicity
from regimelake.llm.common import discard, materialize, small_batches, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 for toxicity.

    Null and empty texts stay, as they have no evidence; repeated rows stay or go together; an empty table gives an empty one.
    """
    small_batches(spark)
    return toxicity.score(docs, table(spark, sf_dir, "labels")).filter("predicted = 0").select(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of near-duplicates: five-word shingles, similarity 0.8.

    Rows that repeat a doc_id stay or go together; rows of null doc_id stay.
    """
    small_batches(spark)
    dropped = near_dedup.near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-word windows that a smaller doc_id has too; n_chars follows the text.

    Null and empty texts and rows of null doc_id stay as they are; a text that loses all its words stays as an empty one.
    """
    small_batches(spark)
    out = substring_dedup.remove_repeats(docs)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts that are left in sequences of at most 4096 tokens; null and empty ones are their end alone."""
    small_batches(spark)
    out = packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("packing", pack),
]

#: Fitted models and tokenizer libraries are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the rows are a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            out = materialize(out)
            discard(docs)
        docs = out
    return docs
