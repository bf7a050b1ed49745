"""Registered queries: seen-exclusion, samplers, class balance, label joins, the random round."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import sql_draw_key
from ..operators import labels as LB
from ..operators import prepare as P
from ..operators import sample as SM
from ..operators.stats import label_counts
from ..sources import bind as B
from . import sqlbits as S
from .registry import query

# --- fixed parameters of the registered sampling queries -------------------------------------
SEED = 42            # draw seed
SAMPLE_SIZE = 200    # rows per round (the original sweeps' sample size)
N_ARMS = 10          # clusters
ARM = 3              # arm used by the single-arm queries
ARM_N = 50           # rows drawn from the single arm
# ---------------------------------------------------------------------------------------------
PER_CLUSTER = int(SAMPLE_SIZE / N_ARMS)
KEY = sql_draw_key(SEED, "id")


def _stored_labels(spark, d):
    return B.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"),
                                              F.col("toxic").cast("int").alias("label"))


def _seen_r0(spark, d):
    """Ids already drawn by run r0 of the labeled log: the ledger the next round excludes."""
    return B.labeled_log(spark, d).filter(F.col("run_id") == "r0").select("id")


SEEN_R0_SQL = f"SELECT id FROM ({S.LABELED_LOG}) WHERE run_id = 'r0'"
UNSEEN_SQL = f"SELECT * FROM ({S.NEWS_POOL}) WHERE id NOT IN ({SEEN_R0_SQL})"
STORED_SQL = "SELECT CAST(doc_id AS VARCHAR) AS id, CAST(toxic AS INTEGER) AS label FROM labels"


@query("exclude_seen", f"SELECT id, label_cluster FROM ({UNSEEN_SQL})")
def exclude_seen(spark, d):
    pool = B.news_pool(spark, d).select("id", "label_cluster")
    return SM.exclude_seen(pool, _seen_r0(spark, d))


@query("sample_from_arm", f"""SELECT id, label_cluster FROM ({S.NEWS_POOL}) WHERE label_cluster = {ARM}
ORDER BY {KEY}, id LIMIT {ARM_N}""")
def sample_from_arm(spark, d):
    return SM.sample_from_arm(B.news_pool(spark, d).select("id", "label_cluster"), ARM, ARM_N, SEED)


STRATIFIED_SQL = f"""SELECT id, label_cluster FROM (SELECT id, label_cluster,
  row_number() OVER (PARTITION BY label_cluster ORDER BY {KEY}, id) AS rn FROM ({UNSEEN_SQL})) WHERE rn <= {PER_CLUSTER}"""


@query("stratified_sample", STRATIFIED_SQL)
def stratified_sample(spark, d):
    pool = SM.exclude_seen(B.news_pool(spark, d).select("id", "label_cluster"), _seen_r0(spark, d))
    return SM.stratified_sample(pool, PER_CLUSTER, SEED)


def _posneg_sql(src: str, quota: int, group: str) -> str:
    n_pos = int(quota / 2)
    return f"""WITH d AS (SELECT * FROM ({src}) WHERE predicted_label IN (0, 1)),
r AS (SELECT *, row_number() OVER (PARTITION BY {group}, predicted_label ORDER BY {KEY}, id) AS rn FROM d),
t AS (SELECT {group}, least(count(*), {n_pos}) AS taken FROM d WHERE predicted_label = 1 GROUP BY {group})
SELECT r.id, r.{group}, r.predicted_label FROM r LEFT JOIN t USING ({group})
WHERE (r.predicted_label = 1 AND r.rn <= {n_pos}) OR (r.predicted_label = 0 AND r.rn <= {quota} - coalesce(t.taken, 0))"""


@query("stratified_posneg_sample", _posneg_sql(S.NEWS_POOL, PER_CLUSTER, "label_cluster"))
def stratified_posneg_sample(spark, d):
    pool = B.news_pool(spark, d).select("id", "label_cluster", "predicted_label")
    return SM.stratified_posneg_sample(pool, PER_CLUSTER, SEED)


@query("arm_posneg_sample", _posneg_sql(f"""SELECT * FROM ({S.NEWS_POOL}) WHERE label_cluster = {ARM}
  AND EXISTS (SELECT 1 FROM ({S.NEWS_POOL}) q WHERE q.label_cluster = {ARM} AND q.predicted_label = 1)""",
                                         ARM_N, "label_cluster"))
def arm_posneg_sample(spark, d):
    pool = B.news_pool(spark, d).select("id", "label_cluster", "predicted_label")
    return SM.arm_posneg_sample(pool, ARM, ARM_N, SEED)


@query("positive_stratified_sample", f"""SELECT id, label_cluster FROM (SELECT id, label_cluster,
  row_number() OVER (PARTITION BY label_cluster ORDER BY {KEY}, id) AS rn FROM ({S.NEWS_POOL}) WHERE predicted_label = 1)
WHERE rn <= {PER_CLUSTER}""")
def positive_stratified_sample(spark, d):
    pool = B.news_pool(spark, d).select("id", "label_cluster", "predicted_label")
    return SM.positive_stratified_sample(pool, SAMPLE_SIZE, N_ARMS, SEED).drop("predicted_label")


@query("balance_two_to_one", f"""WITH d AS ({S.LABELED_POOL}),
c AS (SELECT label_cluster, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS np, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS nn
      FROM d GROUP BY label_cluster),
r AS (SELECT *, row_number() OVER (PARTITION BY label_cluster, label ORDER BY {KEY}, id) AS rn FROM d)
SELECT r.id, r.label_cluster, r.label FROM r JOIN c USING (label_cluster)
WHERE NOT (c.np > 0 AND c.nn > 2 * c.np) OR r.label = 1 OR r.rn <= 2 * c.np""")
def balance_two_to_one(spark, d):
    lp = B.labeled_pool(spark, d).select("id", "label_cluster", "label")
    return SM.balance_two_to_one(lp, SEED, ["label_cluster"])


@query("shuffle_order", f"""SELECT id, label_cluster, row_number() OVER (PARTITION BY label_cluster ORDER BY {KEY}, id)
  AS shuffle_pos FROM ({S.LABELED_POOL})""")
def shuffle_order(spark, d):
    lp = B.labeled_pool(spark, d).select("id", "label_cluster")
    return SM.shuffle_rank(lp, SEED, ["label_cluster"])


@query("random_round", f"SELECT id, label_cluster, 'random' AS arm FROM ({STRATIFIED_SQL})")
def random_round(spark, d):
    """One round of the random strategy: exclude the run's ledger, per-cluster quota, arm "random"."""
    return stratified_sample(spark, d).withColumn("arm", F.lit("random"))


@query("label_from_table", f"""SELECT s.id, s.label_cluster, l.label FROM ({STRATIFIED_SQL}) s
JOIN ({STORED_SQL}) l ON s.id = l.id""")
def label_from_table(spark, d):
    return LB.label_from_table(stratified_sample(spark, d), _stored_labels(spark, d))


@query("reuse_labels", f"""SELECT s.id, s.label_cluster, l.label FROM ({STRATIFIED_SQL}) s
LEFT JOIN ({STORED_SQL}) l ON s.id = l.id""")
def reuse_labels(spark, d):
    return LB.reuse_labels(stratified_sample(spark, d), _stored_labels(spark, d))


@query("needs_label", f"""SELECT s.id, s.label_cluster FROM ({STRATIFIED_SQL}) s
WHERE s.id NOT IN (SELECT id FROM ({STORED_SQL}))""")
def needs_label(spark, d):
    return LB.needs_label(stratified_sample(spark, d), _stored_labels(spark, d))


_ANSWER_SQL = "CASE WHEN l.label = 1 THEN 'Relevant' ELSE 'Not relevant' END"


@query("label_sample", f"""SELECT s.id, trim({_ANSWER_SQL}) AS answer,
  CAST((contains(lower({_ANSWER_SQL}), 'relevant') AND NOT contains(lower({_ANSWER_SQL}), 'not relevant')) AS INTEGER) AS label
FROM ({STRATIFIED_SQL}) s JOIN ({STORED_SQL}) l ON s.id = l.id""")
def label_sample(spark, d):
    """Sample -> answer from the stored-label labeler -> news label rule."""
    s = stratified_sample(spark, d)
    ans = _stored_labels(spark, d).select(
        "id", F.when(F.col("label") == 1, "Relevant").otherwise("Not relevant").alias("answer"))
    return LB.label_from_answer(s.join(ans, "id", "inner"), "news").select("id", "answer", "label")


MIN_SLICE_SQL = f"""SELECT s.label_cluster, l.label, count(*) AS n FROM ({STRATIFIED_SQL}) s
JOIN ({STORED_SQL}) l ON s.id = l.id GROUP BY s.label_cluster, l.label"""


@query("minimum_slice", MIN_SLICE_SQL)
def minimum_slice(spark, d):
    """Preprocess -> exclude seen -> stratified sample -> stored labels -> label counts."""
    pool = P.preprocess_pool(B.news_pool(spark, d)).select("id", "label_cluster", "clean_title")
    fresh = SM.exclude_seen(pool, _seen_r0(spark, d))
    s = SM.stratified_sample(fresh, PER_CLUSTER, SEED)
    return label_counts(LB.label_from_table(s, _stored_labels(spark, d)), ["label_cluster"])


# fixed stand-in vocabulary of the keyword labeler (words that occur in the generated titles)
KEYWORDS = ["attion", "eriner"]
_KW_SQL = " OR ".join(f"contains(training_text, '{k}')" for k in KEYWORDS)


@query("label_keyword", f"""SELECT id, answer,
  CAST((contains(lower(answer), 'relevant') AND NOT contains(lower(answer), 'not relevant')) AS INTEGER) AS label
FROM (SELECT s.id, CASE WHEN {_KW_SQL} THEN 'relevant' ELSE 'not relevant' END AS answer
      FROM ({STRATIFIED_SQL}) s JOIN (SELECT id, {S.clean_text('title')} AS training_text FROM ({S.NEWS_POOL})) p
      ON s.id = p.id)""")
def label_keyword(spark, d):
    """Sample -> prompts -> a user labeler run through mapInPandas -> news label rule."""
    pool = P.preprocess_pool(B.news_pool(spark, d)).select("id", "title", "clean_title", "label_cluster")
    s = SM.stratified_sample(SM.exclude_seen(pool, _seen_r0(spark, d)), PER_CLUSTER, SEED)
    prompts = LB.build_prompts(s, "hf", "news", "clean_title")
    answered = LB.apply_labeler(prompts, LB.keyword_labeler(KEYWORDS, "relevant", "not relevant"))
    return LB.label_from_answer(answered, "news").select("id", "answer", "label")
