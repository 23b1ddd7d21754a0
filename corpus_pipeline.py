"""Corpus pipeline: toxicity, near-dedup, decontamination, mixing and token output, in that order.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame: the documents that go on (all
columns unchanged), the last one the token index. Stages keep clean documents; null texts and
repeated rows follow the rules in the operators' docstrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from watchloom.llm import decontam, mixing, queries, simhash, tokens, toxicity
from watchloom.llm.common import Workspace


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models score under 0.5.

    Null, empty and wordless texts have the score of no evidence; a score of exactly 0.5 goes; repeated
    rows stay or go together; very long texts are scored whole. Without labels of both kinds every
    document has the labels' share as its score; an empty table stays empty. Further columns, also of
    ``labels``, are kept or ignored whatever their names.
    """
    return toxicity.ordinary_documents(docs, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: that with the smallest id.

    Null and empty texts have fingerprint zero, so one of them stays; documents without an id come
    last; of rows equal in id and text one stays. Very long texts are hashed whole; an empty table
    stays empty; columns are unchanged.
    """
    return simhash.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item by tiles to 0.8 or more (0.8 exactly goes).

    Null, empty and wordless texts stay, as everything does if the benchmark is empty or null; repeated
    rows stay or go together; very long texts are read whole; columns are unchanged.
    """
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (0, 1 or 2 times), columns unchanged.

    Null and empty texts have no words and are taken ``whole`` times of their source; a null source is
    a source of its own; of rows equal in id and text as many are taken as fit. An empty table stays
    empty.
    """
    return mixing.repeat_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, read back as an index: doc_id, start, n_tokens, ids_crc32.

    Documents without an id come first; rows of one id stand together, by a hash of their tokens; null
    and empty texts are the end id alone; an empty table gives no rows.
    """
    return tokens.token_index(docs, queries.default_tokenizer())


STAGES = [("toxicity", drop_toxic), ("simhash near-dedup", drop_near_copies), ("benchmark decontamination", drop_benchmark), ("mixing", mix), ("token output", write_tokens)]

#: Learned scores, fingerprints and tokens are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and reread by the next."""
    ws, docs = Workspace(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = ws.store(docs)
    return docs
