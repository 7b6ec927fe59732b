"""From raw documents to packed token sequences: each stage works on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result to the shared folder and reads it again for the next stage. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tenantlens.llm import decontaminate, linededup, neardup, packing, toxicity
from tenantlens.llm.common import stage, table

WORDS = 5  # of a shingle in the near-duplicate stage


def carried(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row: no column of a document can clash with those an operator adds."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar rejects go; it is fitted on the labels of the documents given."""
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.score(carried(docs), model).where("predicted = 0").select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar lines the first stays; a document without a line left goes."""
    return linededup.dedup_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that an exact Jaccard of 0.8 or more connects, one row stays: the first by doc_id."""
    return neardup.keep_one(docs, words=WORDS)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies in benchmark windows go."""
    found = decontaminate.scan(carried(docs), table(spark, sf_dir, "benchmark"))
    return found.where("not contaminated").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their place in sequences of 4096 tokens."""
    return packing.pack_documents(docs, packing.default_tokenizer())


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("near-duplicates", dedup_documents),
          ("decontamination", decontaminate_documents), ("packing", pack)]

ORACLE_SQL = None  # a fitted model, MinHash and packing have no SQL; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
