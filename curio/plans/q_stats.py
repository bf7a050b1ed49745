"""Registered queries: cluster statistics, exports, classification metrics, experiment grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bandit as BD
from ..operators import stats as ST
from ..operators import topics as TP
from ..session import scratch_path
from ..sources import bind as B
from ..sources import io
from . import sqlbits as S
from .registry import query

POOL = S.NEWS_POOL
SIZES = f"SELECT label_cluster, count(*) AS n FROM ({POOL}) GROUP BY label_cluster"


@query("cluster_sizes", SIZES)
def cluster_sizes(spark, d):
    return ST.cluster_sizes(B.news_pool(spark, d))


@query("cluster_count", f"SELECT count(DISTINCT label_cluster) AS n_clusters, count(*) AS n_docs FROM ({POOL})")
def cluster_count(spark, d):
    return ST.cluster_count(B.news_pool(spark, d))


@query("cluster_report", f"""SELECT label_cluster, n, round(n * 100.0 / sum(n) OVER (), 6) AS pct,
  repeat('#', CAST(floor(n * 100.0 / sum(n) OVER () / 2) AS INTEGER)) AS bar FROM ({SIZES})""")
def cluster_report(spark, d):
    return ST.cluster_report(B.news_pool(spark, d))


IMBALANCE = """count(*) AS n_clusters, min(n) AS min_size, max(n) AS max_size,
  round(CASE WHEN min(n) = 0 THEN NULL ELSE max(n) * 1.0 / min(n) END, 6) AS ratio,
  round(stddev_samp(n), 6) AS std_size, round(avg(n), 6) AS mean_size"""


@query("cluster_imbalance", f"SELECT {IMBALANCE} FROM ({SIZES})")
def cluster_imbalance(spark, d):
    return ST.cluster_imbalance(B.news_pool(spark, d))


def _assignments(spark, d):
    """One long (dataset, method, id, label_cluster) table of deterministic assignments."""
    news = B.news_pool(spark, d)
    part = B.table(spark, d, "part")
    by_source = news.select(F.lit("news").alias("dataset"), F.lit("source").alias("method"), "id", "label_cluster")
    by_digits = news.select(F.lit("news").alias("dataset"), F.lit("digits").alias("method"), "id",
                            F.length(F.col("n_chars").cast("string")).cast("int").alias("label_cluster"))
    by_size = part.select(F.lit("ads").alias("dataset"), F.lit("size").alias("method"),
                          F.col("p_partkey").cast("string").alias("id"), (F.col("p_size") % 10).cast("int").alias("label_cluster"))
    by_brand = part.select(F.lit("ads").alias("dataset"), F.lit("brand").alias("method"),
                           F.col("p_partkey").cast("string").alias("id"),
                           (F.regexp_extract("p_brand", "[0-9]+", 0).cast("int") % 10).cast("int").alias("label_cluster"))
    return by_source.unionByName(by_digits).unionByName(by_size).unionByName(by_brand)


ASSIGN_SQL = f"""SELECT 'news' AS dataset, 'source' AS method, id, label_cluster FROM ({POOL})
UNION ALL SELECT 'news', 'digits', id, CAST(length(CAST(n_chars AS VARCHAR)) AS INTEGER) FROM ({POOL})
UNION ALL SELECT 'ads', 'size', CAST(p_partkey AS VARCHAR), CAST(p_size % 10 AS INTEGER) FROM part
UNION ALL SELECT 'ads', 'brand', CAST(p_partkey AS VARCHAR), CAST(CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) % 10 AS INTEGER) FROM part"""
GRID_SIZES = f"SELECT dataset, method, label_cluster, count(*) AS n FROM ({ASSIGN_SQL}) GROUP BY dataset, method, label_cluster"


@query("cluster_sizes_grid", f"SELECT dataset, method, {IMBALANCE} FROM ({GRID_SIZES}) GROUP BY dataset, method")
def cluster_sizes_grid(spark, d):
    return ST.cluster_imbalance(_assignments(spark, d), ["dataset", "method"])


@query("cluster_sizes_json", f"""SELECT CAST(to_json(map_from_entries(list(struct_pack(k := dataset, v := m) ORDER BY dataset)))
  AS VARCHAR) AS json FROM (SELECT dataset, map_from_entries(list(struct_pack(k := method, v := m) ORDER BY method)) AS m
  FROM (SELECT dataset, method, map_from_entries(list(struct_pack(k := CAST(label_cluster AS VARCHAR), v := n)
    ORDER BY CAST(label_cluster AS VARCHAR))) AS m FROM ({GRID_SIZES}) GROUP BY dataset, method) GROUP BY dataset)""")
def cluster_sizes_json(spark, d):
    sizes = _assignments(spark, d).groupBy("dataset", "method", "label_cluster").agg(F.count(F.lit(1)).alias("n"))
    return ST.sizes_json(sizes, "dataset", "method")


@query("classification_metrics", f"""WITH p AS (SELECT d.lang, CAST(l.toxic AS INTEGER) AS y, CAST(d.n_chars % 2 AS INTEGER) AS p
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
conf AS (SELECT lang, y, p, count(*) AS c FROM p GROUP BY lang, y, p),
cls AS (SELECT DISTINCT lang, y AS cls FROM conf UNION SELECT DISTINCT lang, p FROM conf),
per AS (SELECT k.lang, k.cls,
  coalesce((SELECT sum(c) FROM conf WHERE conf.lang = k.lang AND conf.y = k.cls), 0) AS support,
  coalesce((SELECT sum(c) FROM conf WHERE conf.lang = k.lang AND conf.y = k.cls AND conf.p = k.cls), 0) AS tp,
  coalesce((SELECT sum(c) FROM conf WHERE conf.lang = k.lang AND conf.p = k.cls), 0) AS predicted FROM cls k),
m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS pr,
  CASE WHEN support > 0 THEN tp / support ELSE 0 END AS rc FROM per)
SELECT lang, round(sum(tp) / sum(support), 6) AS accuracy, round(sum(pr * support) / sum(support), 6) AS precision,
  round(sum(rc * support) / sum(support), 6) AS recall,
  round(sum(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END * support) / sum(support), 6) AS f1,
  CAST(sum(support) AS BIGINT) AS n
FROM m GROUP BY lang""")
def classification_metrics(spark, d):
    docs = B.table(spark, d, "documents")
    lab = B.table(spark, d, "labels")
    p = docs.join(lab, "doc_id").select("lang", F.col("toxic").alias("label"),
                                        (F.col("n_chars") % 2).cast("int").alias("prediction"))
    m = ST.classification_metrics(p, ["lang"])
    return m.select(*[F.round(c, 6).alias(c) if c in ("accuracy", "precision", "recall", "f1") else F.col(c) for c in m.columns])


@query("dense_arms", """SELECT vec_id, label * 2 AS cluster, CAST(dense_rank() OVER (ORDER BY label * 2) - 1 AS INTEGER) AS arm
FROM embeddings""")
def dense_arms(spark, d):
    e = B.table(spark, d, "embeddings").select("vec_id", (F.col("label") * 2).alias("cluster"))
    return TP.dense_arms(e, "cluster", "arm").select("vec_id", "cluster", "arm")


@query("cluster_cache", f"SELECT id, label_cluster FROM ({POOL})")
def cluster_cache(spark, d):
    """Assignment written once per (dataset, method, k), partitioned by cluster, then read back."""
    root = scratch_path(spark, "cache")
    compute = lambda: B.news_pool(spark, d).select("id", "label_cluster")
    io.cluster_cache(spark, root, "news", "source", 10, compute)
    cached = io.cluster_cache(spark, root, "news", "source", 10, compute)  # second call reads the cache
    return cached.select("id", F.col("label_cluster").cast("int").alias("label_cluster"))


# --- experiment grid: runs of the results log are spread over the 72 configurations ------------
METHODS = ["lda", "kmeans", "fine"]


def _config_cols(idx):
    m = F.element_at(F.array(*[F.lit(x) for x in METHODS]), (idx % 3 + 1).cast("int"))
    return [m.alias("method"), ((F.floor(idx / 3) % 2) == 0).alias("balance"),
            ((F.floor(idx / 6) % 2) == 0).alias("filter_label"),
            F.when(F.floor(idx / 12) % 2 == 0, "ads").otherwise("news").alias("dataset"),
            (F.floor(idx / 24) % 3 + 1).cast("int").alias("repeat")]


def _config_sql(idx):
    return (f"CASE {idx} % 3 WHEN 0 THEN 'lda' WHEN 1 THEN 'kmeans' ELSE 'fine' END AS method, "
            f"(({idx} // 3) % 2 = 0) AS balance, (({idx} // 6) % 2 = 0) AS filter_label, "
            f"CASE WHEN ({idx} // 12) % 2 = 0 THEN 'ads' ELSE 'news' END AS dataset, "
            f"CAST(({idx} // 24) % 3 + 1 AS INTEGER) AS repeat")


RUN_IDX_SQL = "CAST(substr(run_id, 2) AS BIGINT)"


def _runs(spark, d):
    ra = BD.reward_accept(B.results_log(spark, d), B.INITIAL_BASELINE)
    idx = F.substring("run_id", 2, 1 << 20).cast("bigint")
    return ra.select("*", *_config_cols(idx))


@query("experiment_grid", f"""SELECT method, balance, filter_label, dataset, count(DISTINCT run_id) AS n_runs, count(*) AS n_rounds
FROM (SELECT run_id, {_config_sql(RUN_IDX_SQL)} FROM ({S.REWARD_ACCEPT})) GROUP BY method, balance, filter_label, dataset""")
def experiment_grid(spark, d):
    r = _runs(spark, d)
    return r.groupBy("method", "balance", "filter_label", "dataset").agg(
        F.countDistinct("run_id").alias("n_runs"), F.count(F.lit(1)).alias("n_rounds"))


@query("grid_summary", f"""SELECT method, balance, filter_label, dataset, count(*) AS n_runs,
  round(avg(final_metric), 6) AS mean_metric, round(stddev_samp(final_metric), 6) AS std_metric,
  round(avg(n_accepted), 6) AS mean_accepted
FROM (SELECT run_id, method, balance, filter_label, dataset,
        greatest({B.INITIAL_BASELINE}, coalesce(max(CASE WHEN accepted THEN metric END), {B.INITIAL_BASELINE})) AS final_metric,
        sum(CASE WHEN accepted THEN 1 ELSE 0 END) AS n_accepted
      FROM (SELECT *, {_config_sql(RUN_IDX_SQL)} FROM ({S.REWARD_ACCEPT}))
      GROUP BY run_id, method, balance, filter_label, dataset)
GROUP BY method, balance, filter_label, dataset""")
def grid_summary(spark, d):
    r = _runs(spark, d)
    keys = ["method", "balance", "filter_label", "dataset"]
    per_run = r.groupBy("run_id", *keys).agg(
        F.greatest(F.lit(B.INITIAL_BASELINE), F.coalesce(F.max(F.when(F.col("accepted"), F.col("metric"))),
                                                          F.lit(B.INITIAL_BASELINE))).alias("final_metric"),
        F.sum(F.col("accepted").cast("int")).alias("n_accepted"))
    return per_run.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_runs"), F.round(F.avg("final_metric"), 6).alias("mean_metric"),
        F.round(F.stddev_samp("final_metric"), 6).alias("std_metric"),
        F.round(F.avg("n_accepted"), 6).alias("mean_accepted"))
