"""Declared schemas of the pipeline's tables. Optional columns are NULL when a source lacks them."""

from pyspark.sql import types as T

S, I, D, L = T.StringType(), T.IntegerType(), T.DoubleType(), T.LongType()


def _st(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


NEWS_POOL = _st(("id", S), ("title", S), ("text", S), ("label", I))
ADS_POOL = _st(("id", S), ("title", S), ("description", S), ("label", I))
VALIDATION = _st(("title", S), ("text", S), ("label", I))
CLUSTERS = _st(("id", S), ("label_cluster", I))

# append-only logs of a run
LEDGER = _st(("run_id", S), ("step", I), ("id", S))
LABELED = _st(("run_id", S), ("step", I), ("arm", I), ("id", S), ("title", S), ("label", I))
RESULTS = _st(("run_id", S), ("step", I), ("arm", I), ("metric", D), ("accuracy", D),
              ("precision", D), ("recall", D), ("f1", D), ("n_train", L))
REWARDS = _st(("run_id", S), ("step", I), ("arm", I), ("reward", D))
