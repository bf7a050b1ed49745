"""Registered queries: classifier features, training, inference, evaluation, the Thompson draw,
one Thompson round and the full active-learning run (rows-only: trained models and draws)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bandit as BD
from ..operators import classify as C
from ..sources import bind as B
from ..session import scratch_path
from . import sqlbits as S
from .flagship import active_learning as _al
from .flagship import labeled_splits
from .grid import grid_configs, grid_root, run_grid, summarize
from .lockstep import LABELED_LOG, Steps, grid_tables, pool_fingerprints
from .registry import query


def _fit(spark, d, weighted):
    pool, validation = labeled_splits(spark, d)
    path = scratch_path(spark, "train")   # the passes of the fit read this narrow table, not the documents
    pool.select("id", "title", "label").write.parquet(path)
    pool = spark.read.parquet(path)
    return C.train_classifier(pool, "title", weighted), pool, validation


@query("text_features", f"""SELECT id, CAST(len(list_filter(string_split_regex(lower(coalesce(title, '')), '[^a-zA-Z0-9_]+'),
  lambda x: x <> '')) AS INTEGER) AS n_tokens FROM ({S.LABELED_POOL}) WHERE doc_id % {B.TEST_SPLIT_MOD} <> 0""")
def text_features(spark, d):
    pool, _ = labeled_splits(spark, d)
    f = C.text_features(pool, "title")
    return f.select("id", "n_tokens")


@query("train_classifier")
def train_classifier(spark, d):
    model, _, validation = _fit(spark, d, False)
    return C.evaluate(model, validation, "title")


@query("train_weighted")
def train_weighted(spark, d):
    model, _, validation = _fit(spark, d, True)
    return C.evaluate(model, validation, "title")


@query("predict_pool")
def predict_pool(spark, d):
    """Score the whole unlabeled pool with a classifier trained on the labeled split."""
    model, _, _ = _fit(spark, d, True)
    return C.predict(model, B.news_pool(spark, d).select("id", "title"), "title").select(
        "id", "predicted_label", "score")


@query("evaluate_classifier")
def evaluate_classifier(spark, d):
    model, pool, validation = _fit(spark, d, True)
    return C.evaluate(model, validation, "title").withColumn("n_train", F.lit(pool.count()))


@query("choose_arm")
def choose_arm(spark, d):
    """Thompson draw per run of the derived reward log (one arm per run)."""
    ra = BD.reward_accept(B.results_log(spark, d), B.INITIAL_BASELINE)
    post = BD.bandit_posterior(ra.select("run_id", "step", "arm", "reward"), 10)
    return BD.choose_arm(post, F.lit(11), seed=42)


@query("thompson_round")
def thompson_round(spark, d):
    return _al(spark, d, method="lda", k=10, rounds=1, strategy="thompson", run_id="t1")


@query("active_learning")
def active_learning(spark, d):
    return _al(spark, d, method="lda", k=10, rounds=10, strategy="thompson", balance=True, run_id="al")


FACTS_SAMPLE = 60


def _rows(df):
    return df.agg(F.count(F.lit(1)).alias("n"))


@query("loop_facts", f"""SELECT 'news' AS dataset, count(*) AS pool_rows, CAST(3 AS BIGINT) AS n_rounds,
  CAST(0 AS BIGINT) AS repeated_ids, CAST(0 AS BIGINT) AS unlabeled, CAST(0 AS BIGINT) AS relabeled,
  CAST(0 AS BIGINT) AS oversized FROM documents
WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % {B.TEST_SPLIT_MOD} = 0)
UNION ALL SELECT 'ads', count(*), 3, 0, 0, 0, 0 FROM part WHERE p_name IS NOT NULL AND p_partkey % {B.TEST_SPLIT_MOD} <> 0""")
def loop_facts(spark, d):
    """Three rounds over each dataset's whole pool, told from the logs they left: pool size, ids
    drawn twice, drawn rows without a label, stored labels not kept, draws above the sample size."""
    out = None
    for ds in ("news", "ads"):
        root = scratch_path(spark, f"facts-{ds}")
        res = _al(spark, d, method="lda", k=5, rounds=3, sample_size=FACTS_SAMPLE, run_id=ds, store_root=root, dataset=ds)
        tables = [spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/{t}") for t in ("pool", "labels")]
        drawn = spark.read.parquet(f"{root}/ledger")
        labeled = spark.read.parquet(f"{root}/labeled").select("id", "label")
        facts = {"pool_rows": _rows(tables[0]), "n_rounds": _rows(res),
                 "repeated_ids": _rows(drawn.groupBy("id").count().filter("count > 1")),
                 "unlabeled": _rows(drawn.join(labeled.filter("label IN (0, 1)"), "id", "left_anti")),
                 "relabeled": _rows(labeled.join(tables[1].withColumnRenamed("label", "stored"), "id").filter("label <> stored")),
                 "oversized": _rows(drawn.groupBy("step").count().filter(F.col("count") > FACTS_SAMPLE))}
        rows = None
        for name, df in facts.items():
            part = df.select(F.lit(name).alias("fact"), "n")
            rows = part if rows is None else rows.unionByName(part)
        one_row = rows.groupBy(F.lit(ds).alias("dataset")).agg(
            *[F.max(F.when(F.col("fact") == f, F.col("n"))).alias(f) for f in facts])
        out = one_row if out is None else out.unionByName(one_row)
    return out


GRID = dict(filter_label=(False, True), datasets=("news", "ads"))


@query("grid_run")
def grid_run(spark, d):
    """The whole experiment grid: both datasets, every method, balance and classifier filter on and off, three
    repeats, each run with the default rounds and k. Runs of one dataset, method and seed share the assignment."""
    return summarize(run_grid(spark, d, grid_configs(**GRID)))


@query("grid_facts", f"""WITH pools AS (SELECT 'news' AS dataset, count(*) AS pool_rows FROM documents
  WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % {B.TEST_SPLIT_MOD} = 0)
  UNION ALL SELECT 'ads', count(*) FROM part WHERE p_name IS NOT NULL AND p_partkey % {B.TEST_SPLIT_MOD} <> 0)
SELECT dataset, method, balance, filter_label, 3::BIGINT AS n_runs, 30::BIGINT AS n_rounds, 3 * pool_rows AS pool_rows,
  0::BIGINT AS repeated_ids, 0::BIGINT AS unlabeled, 0::BIGINT AS relabeled, 0::BIGINT AS oversized, 0::BIGINT AS off_arm
FROM pools, (VALUES ('lda'), ('kmeans'), ('fine')) m(method), (VALUES (true), (false)) b(balance), (VALUES (true), (false)) f(filter_label)""")
def grid_facts(spark, d):
    """The finished grid told from its logs, per configuration: runs, rounds, clustered pool rows, ids drawn twice by a
    run, drawn rows without a label, stored labels not kept, draws above the sample size, rows outside the round's arm."""
    configs = grid_configs(**GRID)
    pools = pool_fingerprints(spark, d, configs)
    root = grid_root(spark, d, configs, 10, 10, pools)
    res = run_grid(spark, d, configs, root=root, fingerprints=pools)
    steps, names = Steps(spark, f"{root}/rounds"), ["dataset", "method", "balance", "filter_label"]
    runs = res.select("run_id", *names, F.concat_ws("-", "dataset", "method", "repeat").alias("pool")).distinct()
    tables = grid_tables(spark, d, configs, root, 10, pools)
    labeled = steps.read("labeled", 1, 10, LABELED_LOG).join(runs, "run_id")
    stored = tables["labels"].groupBy("dataset", "id").agg(F.max("label").alias("least"), F.min("label").alias("most"))
    home = tables["assignment"].select("pool", "id", "label_cluster")
    facts = {
        "n_runs": runs.groupBy(*names), "n_rounds": res.groupBy(*names),
        "pool_rows": runs.join(home.groupBy("pool").agg(F.count("*").alias("w")), "pool").groupBy(*names),
        "repeated_ids": labeled.groupBy(*names, "run_id", "id").count().where("count > 1").groupBy(*names),
        "unlabeled": labeled.where("label IS NULL OR label NOT IN (0, 1)").groupBy(*names),
        "relabeled": labeled.join(stored, ["dataset", "id"]).where("label NOT IN (least, most)").groupBy(*names),
        "oversized": labeled.groupBy(*names, "run_id", "step").count().where("count > 200").groupBy(*names),
        "off_arm": labeled.join(home, ["pool", "id"]).where("arm <> label_cluster").groupBy(*names)}
    out = runs.select(*names).distinct()
    for fact, g in facts.items():
        n = F.sum("w") if fact == "pool_rows" else F.count(F.lit(1))
        out = out.join(g.agg(n.alias(fact)), names, "left")
    return out.select(*names, *[F.coalesce(f, F.lit(0)).alias(f) for f in facts])
