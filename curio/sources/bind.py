"""Binding of the driver's parquet tables to the pipeline's input schemas.

The original corpora (ads, news) are not available, so each reference table is derived from
the given tables with pure expressions (see FIXTURES.md section 2). Every derivation keeps all
rows; modulo expressions only decide *values* (a NULL title, a quoting style, a split), never
which rows are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import is_local

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# --- fixed values of the binding -------------------------------------------------------------
TARGET_TOPIC = "ring"          # topic whose presence makes a news article positive
TEST_SPLIT_MOD = 5             # doc_id % 5 = 0 -> held-out (validation) split, else train
NULL_TITLE_MOD = 7             # doc_id % 7 = 0 -> title is NULL (exercises drop_null_title)
NULL_DESC_MOD = 3              # p_partkey % 3 = 0 -> description is NULL
WIRE_TAG_MOD = 2               # doc_id % 2 = 0 -> " Reuter" appended to the raw article
JUNK_TOPIC_MOD = 13            # doc_id % 13 = 0 -> topic literal is unparseable junk
LOG_BLOCK = 100                # labeled docs per simulated run (doc_id div 100)
RESULT_BLOCK = 10              # events per simulated run: 10 rounds, as in the original loop
METRIC_SCALE = 500.0           # events.value / 500 -> a metric in [0, 1)
DEAD_EVENT = "error"           # event type that stands for a dead round (empty arm)
INITIAL_BASELINE = 0.5
# ---------------------------------------------------------------------------------------------


# text-heavy tables and the key their rows are spread on
SPREAD_KEYS = {"documents": "doc_id", "conversations": "conv_id", "pages": "page_id"}


def spread(df: DataFrame, key: str) -> DataFrame:
    """For local runs only: hash-partition a scan on ``key`` when it yields fewer tasks than there are
    cores (a file with one row group is one task), so that the text work of small files uses all cores.
    On a cluster the scan is left as it is, whatever its size: no shuffle is added."""
    try:
        sc = df.sparkSession.sparkContext
        if not is_local(sc.master):
            return df
        n, par = df.rdd.getNumPartitions(), sc.defaultParallelism
    except Exception:  # noqa: BLE001 - no RDD/SparkContext access (e.g. a Spark Connect session)
        return df
    return df.repartition(par, key) if n < par else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, SPREAD_KEYS[name]) if name in SPREAD_KEYS else df


def arm_of_source(c="source"):
    return (F.regexp_extract(F.col(c), "[0-9]+", 0).cast("int") % 10).cast("int")


def news_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> (id, doc_id, title, text, source, n_chars, label_cluster, predicted_label)."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("id"),
        "doc_id",
        T.first_line("text").alias("title"),
        "text", "source", "n_chars",
        arm_of_source().alias("label_cluster"),
        (F.col("n_chars") % 2).cast("int").alias("predicted_label"),
    )


def pool_with_null_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = news_pool(spark, sf_dir)
    return p.withColumn("title", F.when(F.col("doc_id") % NULL_TITLE_MOD == 0, F.lit(None).cast("string"))
                        .otherwise(F.col("title")))


def ads_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -> (id, title, description); description NULL for a third of the rows."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_name").alias("title"),
        F.when(F.col("p_partkey") % NULL_DESC_MOD == 0, F.lit(None).cast("string"))
        .otherwise(F.col("p_type")).alias("description"),
    )


def labeled_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News pool rows that carry a stored label (``labels.toxic``)."""
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("label"))
    return news_pool(spark, sf_dir).join(lab, "doc_id", "inner")


def raw_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw news corpus: quoted ``new_id`` (pairs of docs share one), title, tagged text, topic literal, split."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), "p_name")
    topics = F.when(F.col("doc_id") % JUNK_TOPIC_MOD == 0, F.lit("junk")).otherwise(
        F.concat(F.lit("['"), F.regexp_replace(F.col("p_name"), " ", "', '"), F.lit("']")))
    base = F.floor(F.col("doc_id") / 2).cast("string")
    new_id = (F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("'"), base, F.lit("'")))
              .when(F.col("doc_id") % 4 == 1, F.concat(F.lit(' "'), base, F.lit('" ')))
              .otherwise(F.concat(F.lit('"'), base, F.lit('"'))))
    return (d.join(part, "doc_id", "left")
            .select("doc_id",
                    new_id.alias("new_id"),
                    T.first_line("text").alias("title"),
                    F.when(F.col("doc_id") % WIRE_TAG_MOD == 0, F.concat("text", F.lit(" Reuter")))
                    .otherwise(F.col("text")).alias("text"),
                    topics.alias("topics"),
                    F.when(F.col("doc_id") % TEST_SPLIT_MOD == 0, F.lit("test")).otherwise(F.lit("train"))
                    .alias("split")))


def results_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round results derived from ``events``: runs of 10 rounds, arm, metric; NULL metric = dead round."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("r"), F.floor(F.col("event_id") / RESULT_BLOCK).cast("string")).alias("run_id"),
        ((F.col("event_id") % RESULT_BLOCK) + 1).cast("int").alias("step"),
        (F.col("user_id") % 10).cast("int").alias("arm"),
        F.when(F.col("event_type") == DEAD_EVENT, F.lit(None).cast("double"))
        .otherwise(F.col("value") / METRIC_SCALE).alias("metric"),
    )


def labeled_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labeled rows of simulated rounds: run = doc_id div 100, step = doc_id % 10 + 1."""
    p = labeled_pool(spark, sf_dir)
    return p.select(
        F.concat(F.lit("r"), F.floor(F.col("doc_id") / LOG_BLOCK).cast("string")).alias("run_id"),
        ((F.col("doc_id") % RESULT_BLOCK) + 1).cast("int").alias("step"),
        F.col("label_cluster").alias("arm"), "id", "title", "label")
