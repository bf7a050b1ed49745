"""Corpus pipeline over ``documents``: toxicity filter, exact dedup, near-duplicate dedup, decontamination, tokens.

Every stage calls one operator of ``curio.llm`` on all that its predecessor kept; what it returns is
written as Parquet and read again. All stages but the last keep the columns of ``documents``; the last
returns doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids (little-endian unsigned 32-bit).

Rows are told apart by their place in the stage's Parquet input, so null and repeated ids are
handled row by row; null texts count as empty and, all being equal, one of them stays. Empty tables
give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curio.llm import decontaminate as dc
from curio.llm import exact_dedup as ed
from curio.llm import sentencepieces as sp
from curio.llm import simhash as sim
from curio.llm import toxicity as tox
from curio.llm.common import free_name, read_table, with_row_key, written
from curio.llm.queries import TOXIC_AT, model_path, sha, toxicity_rest

#: Learned models and random choices; checked against a brute-force version in tests/llm.
ORACLE_SQL = None


def _keep(docs: DataFrame, keyed: DataFrame, key: str, kept: DataFrame) -> DataFrame:
    """The rows of ``keyed`` that ``kept`` marks, with the columns of ``docs``."""
    rows = written(kept.where("kept").select(F.col("row.place").alias(key)), "pipeline-kept")
    # the kept rows grow with the documents, so they are never broadcast
    return keyed.join(rows.hint("merge"), key, "left_semi").select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not hold for toxic."""
    model = tox.train(docs, read_table(spark, sf_dir, "labels"), use=toxicity_rest() != 1)
    score = free_name(docs, "_score")
    return tox.score(docs, model, score_col=score).where(F.col(score) < TOXIC_AT).drop(score)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id."""
    key = free_name(docs, "_place")
    keyed = with_row_key(docs, key)
    ids = keyed.select(F.struct("doc_id", F.col(key).alias("place")).alias("row"), "text")
    return _keep(docs, keyed, key, ed.exact_dedup(ids, id_col="row"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, the one with the smallest id."""
    key = free_name(docs, "_place")
    keyed = with_row_key(docs, key)
    ids = keyed.select(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(key).alias("place")).alias("row"), "text")
    return _keep(docs, keyed, key, sim.simhash_components(ids, id_col="row"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, row by row on both sides."""
    return dc.decontaminate_rows(docs, read_table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of every document left."""
    enc = sp.encode_texts(docs, model_path("piece_bpe_32k.model"))
    return enc.select("doc_id", "n_tokens", sha("ids").alias("ids_sha256"), sha("decoded").alias("decoded_sha256"), "ids")


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("simhash_near_dedup", near_dedup),
          ("decontamination", decontaminate), ("sentencepiece", sentencepiece)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
