"""A corpus pipeline of the training-data operators, each stage on what the one before kept.

1. toxicity: documents that the grammar scores at or above its threshold go;
2. near_dedup: one document of each class of near duplicates stays;
3. secrets: every span found is masked in the text; all documents stay;
4. mixing: documents are repeated or left out so that sources come near their target weights;
5. packing: the last stage gives the pieces of every document and the bins they are in.

All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelode.llm.common import cut, release, table
from tracelode.llm.minhash_dedup import drop_near_duplicates
from tracelode.llm.mixing import mix_documents
from tracelode.llm.packing import pack_documents
from tracelode.llm.secrets import mask_secrets
from tracelode.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked."""
    return mask_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, nth, start, length, bin_id, place, bin_length of every piece."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: The stages learn from labels, sign texts and rank by hashes, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it. What a stage read is deleted once its rows are written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
        release(*before)
        before = [docs]
    return docs
