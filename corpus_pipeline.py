"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, repeated passages go,
sources are mixed to their target weights, and what is left is packed into training sequences.

Defined results of all stages: a null text is an empty one and stays as null where the stage keeps the document; an empty table gives an empty one; all but the last
return the columns of docs, whatever they are called. Rows that are equal in id and text are one after the near-duplicates' stage; null ids and null
sources are kept as such. Reruns over the same tables give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import common, mixing, packing, simhash, substrings, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models don't call toxic; fitted on the labelled documents among docs. Without labels of both classes all stay."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "text")
    return toxicity.score_documents(rows, model, ("__row",)).where(F.col("predicted") == 0).select("__row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each near-duplicate group: texts whose sets of five-word shingles have a cosine of 0.8 or more, directly or through others.
    All texts without words are one group."""
    return simhash.keep_first(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that a document of a smaller doc_id has; those of which nothing is left go, those without an id stay whole."""
    return substrings.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; those without words are never taken."""
    return mixing.mix_copies(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs)


STAGES = [("toxicity", reject_toxic), ("simhash near-dedup", drop_near_duplicates), ("substring dedup", drop_repeats), ("mixing", mix_sources), ("packing", pack_sequences)]

#: SimHash, the language models and the tokenizer can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.stored(docs, "stage")
    return docs
