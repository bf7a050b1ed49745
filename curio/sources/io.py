"""Sources and sinks: pool / validation scans, the cluster-assignment cache and append-only logs.

All state of a run lives in parquet tables keyed by ``run_id`` (and ``step``), appended once per
round. Nothing is rewritten in place, so a lost executor or a restarted driver reads the same
history, and concurrent runs never clobber each other.
"""

from __future__ import annotations

from typing import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import NEWS_POOL, ADS_POOL, VALIDATION


# a table that was never written (or whose only write did not commit) reads as absent
_ABSENT = {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}


def _absent(e: AnalysisException) -> bool:
    return (e.getCondition() or "") in _ABSENT


def _conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the declared columns in order, cast, and fill absent optional ones with NULL."""
    have = set(df.columns)
    cols = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in have else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with header; quoted fields may hold newlines and doubled quotes."""
    r = (spark.read.option("header", "true").option("multiLine", "true")
         .option("escape", '"').option("quote", '"').option("mode", "PERMISSIVE"))
    if schema is not None:
        # read every column as string, then conform: file column order is not trusted
        df = r.option("inferSchema", "false").csv(path)
        return _conform(df, schema)
    return r.option("inferSchema", "false").csv(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Scan parquet (default) or CSV by extension, conforming to ``schema`` when given."""
    if path.endswith(".csv"):
        return read_csv(spark, path, schema)
    df = spark.read.parquet(path)
    return _conform(df, schema) if schema is not None else df


def scan_pool(spark: SparkSession, path: str, dataset: str = "news") -> DataFrame:
    return read_table(spark, path, NEWS_POOL if dataset == "news" else ADS_POOL)


def scan_validation(spark: SparkSession, path: str, dataset: str = "news") -> DataFrame:
    """Validation set with ``training_text``: the article body for news, the title for ads."""
    v = read_table(spark, path, VALIDATION)
    src = F.col("text") if dataset == "news" else F.col("title")
    return v.withColumn("training_text", src)


def read_splits(spark: SparkSession, train_path: str, test_path: str, schema=None) -> DataFrame:
    """Two-split corpus as one table with a ``split`` column."""
    tr = read_table(spark, train_path, schema).withColumn("split", F.lit("train"))
    te = read_table(spark, test_path, schema).withColumn("split", F.lit("test"))
    return tr.unionByName(te, allowMissingColumns=True)


def write_csv(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("header", "true").option("escape", '"')
     .option("quote", '"').csv(path))


def cluster_cache(spark: SparkSession, root: str, dataset: str, method: str, k: int,
                  compute: Callable[[], DataFrame], version: str = "all", rows: int | None = None) -> DataFrame:
    """Read the (id, label_cluster) assignment for (dataset, method, k, version), computing it once.

    ``version`` names what else the assignment depends on (seed, text column, pool content) and
    ``rows`` is the pool's size. The table is partitioned by ``label_cluster`` so a per-arm read
    prunes to one folder. Writing it also cuts the lineage of the topic model fit.
    """
    path = f"{root}/clusters/dataset={dataset}/method={method}/k={k}/version={version}"
    return write_once(spark, path, compute, ["label_cluster"], rows)


def write_once(spark: SparkSession, path: str, compute: Callable[[], DataFrame],
               partition_by: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """The table at ``path``, written from ``compute`` when it is absent or does not hold ``rows``
    rows (a write cut short). A fresh table of another size is an error: no row is lost unseen."""
    try:
        found = spark.read.parquet(path)
        if rows is None or found.count() == rows:
            return found
    except AnalysisException as e:
        if not _absent(e):
            raise
    df = compute()
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    if rows is not None and (n := made.count()) != rows:
        raise ValueError(f"{path} holds {n} rows instead of {rows}: ids must be unique and not null")
    return made


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read an append-only log; an absent log is an empty table of the declared schema. Folders of a
    partitioned log keep their names as text (a run id "01" is no number)."""
    try:
        found = spark.read.parquet(path).schema
        named = T.StructType([T.StructField(f.name, T.StringType() if f.name == "run_id" else f.dataType) for f in found])
        return _conform(spark.read.schema(named).parquet(path), schema)
    except AnalysisException as e:
        if not _absent(e):
            raise
        return spark.createDataFrame([], schema)
