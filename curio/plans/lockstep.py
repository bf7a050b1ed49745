"""Many active-learning runs in lockstep: all of them advance one round together, keyed by ``run_id``.

A round is one chain of plans for all runs: posterior and Thompson draw per (run, arm), the draw of unseen rows of
each run's arm, labels, training sets with carried positives and balance, one grouped fit, one scoring pass. The
number of Spark jobs of a round does not depend on the number of runs. Logs are folders per step below one
root; a step cut short is written again whole, so an interrupted grid goes on where it stopped, and a finished one is
only read.

What grows with the pool (items, stored labels, validation rows) is scanned once a round by all cores. What is bounded by the
grid (a row per run and step, the rows that runs draw in a round, weights of the terms of those rows) comes to the driver,
which gives it to the scans in a broadcast and to the plans between them as a table of one task: they are single
stages without shuffles. Logs are written beside the next plans; a step's results come last.

A run's draws, training rows, weights and metrics depend on its own configuration and logs alone, so a run of the grid
equals the same run alone.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
import threading
from collections import Counter
from concurrent.futures import Future, ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import draw_key
from ..operators import bandit as BD
from ..operators import labels as LB
from ..operators import multi_fit as MF
from ..operators import prepare as P
from ..operators import sample as SM
from ..operators import topics as TP
from ..operators.stats import class_ratio_flags, classification_metrics
from ..sources import io
from .flagship import ANSWERS, ASK_KEYWORDS, loop_tables, pool_fingerprint

#: Tables and topic fits submitted to the cluster at a time.
FITS_AT_ONCE = 6
#: Logs written at a time.
LOGS_AT_ONCE = 4
#: Rows drawn by all runs that one task takes.
DRAWN_A_TASK = 200_000

#: Stands for a missing label while rows are counted.
NO_LABEL = -(1 << 31)

_CHOICE = "run_id string, arm int"
_DRAW = "run_id string, dataset string, arm int, id string, title string, clean_title string"
LABELED_LOG = "run_id string, arm int, id string, title string, label int"
_MODEL = "run_id string, feature long, weight long"
_RESULT = "run_id string, arm int, metric double, accuracy double, precision double, recall double, f1 double, n_train long"


def small_session(spark: SparkSession) -> SparkSession:
    """A session for plans over tables of one task: joins of such tables need neither shuffles nor jobs for broadcasts."""
    out = spark.newSession()
    for name, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))):
        out.conf.set(name, value)
    return out


class Steps:
    """Logs of a grid: one folder per log and step."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str, step: int) -> str:
        return f"{self.root}/{name}/step={step}"

    def write(self, df: DataFrame, name: str, step: int, schema: str) -> DataFrame:
        fields = T.StructType.fromDDL(schema)
        df.select(*[F.col(f.name).cast(f.dataType) for f in fields]).write.mode("overwrite").parquet(self.path(name, step))
        return self.spark.read.schema(fields).parquet(self.path(name, step))

    def read(self, name: str, first: int, last: int, schema: str) -> DataFrame:
        """Steps first..last of a log with the column ``step``."""
        fields = T.StructType.fromDDL(schema)
        if last < first:
            return self.spark.createDataFrame([], T.StructType([*fields, T.StructField("step", T.IntegerType())]))
        paths = [self.path(name, s) for s in range(first, last + 1)]
        return (self.spark.read.schema(T.StructType([*fields, T.StructField("step", T.IntegerType())]))
                .option("basePath", f"{self.root}/{name}").parquet(*paths))

    def done(self, name: str, last: int) -> int:
        """Number of whole steps of a log."""
        for step in range(1, last + 1):
            try:
                self.spark.read.parquet(self.path(name, step))
            except AnalysisException:
                return step - 1
        return last


def pool_fingerprints(spark: SparkSession, sf_dir: str, configs: list[dict]) -> dict[str, tuple[str, int]]:
    """(content hash, rows) of each dataset's pool."""
    datasets = sorted({c["dataset"] for c in configs})
    with ThreadPoolExecutor(len(datasets)) as at_once:
        return dict(zip(datasets, at_once.map(lambda ds: pool_fingerprint(loop_tables(spark, sf_dir, ds)[0]), datasets)))


def pools_of(configs: list[dict], ds: str) -> list[tuple[str, int]]:
    """(method, seed) of a dataset's assignments; an item's homes stand in this order."""
    return sorted({(c["method"], c["repeat"]) for c in configs if c["dataset"] == ds})


def grid_tables(spark: SparkSession, sf_dir: str, configs: list[dict], root: str, k: int,
                fingerprints: dict[str, tuple[str, int]] | None = None) -> dict:
    """Written once: assignment (pool, label_cluster, id), items by dataset (id, title, clean title, terms, its arm in each
    pool), stored labels, validation rows with their terms. Datasets and methods are worked on at the same time; the
    seeds of a method are fitted together."""
    datasets = sorted({c["dataset"] for c in configs}, reverse=True)
    found = fingerprints or pool_fingerprints(spark, sf_dir, configs)
    version, rows = {ds: f[0] for ds, f in found.items()}, {ds: f[1] for ds, f in found.items()}
    inputs = {ds: loop_tables(spark, sf_dir, ds) for ds in datasets}
    union, term_tables = DataFrame.unionByName, threading.Lock()
    passing = spark.newSession()   # what a pass has shuffled is of no use after it
    passing.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")

    def text_table(ds: str) -> DataFrame:
        pre = P.feature_text(P.preprocess_pool(inputs[ds][0]), ds)
        return io.write_once(spark, f"{root}/topic-text/{ds}-{version[ds]}", lambda: pre.select("id", "title", "clean_title", "topic_text"), None, rows[ds])

    def vector_table(ds: str) -> DataFrame:
        return io.write_once(spark, f"{root}/vectors/{ds}-{version[ds]}", lambda: TP.embed_documents(texts[ds].result(), "topic_text"), None, rows[ds])

    def assign(ds: str, method: str) -> DataFrame:
        seeds = [s for m, s in pools_of(configs, ds) if m == method]
        emb, docs = vectors[ds].result() if method != "lda" else None, texts[ds].result()
        if method == "lda":
            docs = passing.read.schema(docs.schema).parquet(*docs.inputFiles())
        # topic models are fitted one dataset after the other: the driver holds tables of all terms for them
        with term_tables if method == "lda" else contextlib.nullcontext():
            return io.cluster_cache(spark, root, ds, method, k,
                                    lambda: TP.cluster(docs, method, k, "topic_text", seed=seeds, embeddings=emb).hint("rebalance", "label_cluster"),
                                    version=f"{version[ds]}-seed{'-'.join(map(str, seeds))}", rows=rows[ds] * len(seeds))

    def label_table() -> DataFrame:
        parts = [inputs[ds][2].select(F.lit(ds).alias("dataset"), "id", "label") for ds in datasets]
        return io.write_once(spark, f"{root}/labels", lambda: functools.reduce(union, parts))

    def validation_table() -> DataFrame:
        parts = [P.preprocess_pool(inputs[ds][1]).select(F.lit(ds).alias("dataset"), "title", "label") for ds in datasets]
        return io.write_once(spark, f"{root}/validation", lambda: functools.reduce(union, parts).withColumn("terms", MF.terms("title")))

    def item_table(ds: str) -> DataFrame:
        pools = pools_of(configs, ds)
        made = functools.reduce(union, [fits[ds, m].result().select("id", F.lit(m).alias("method"), "seed", "label_cluster") for m in sorted({m for m, _ in pools})])
        home = [F.max(F.when((F.col("method") == m) & (F.col("seed") == s), F.col("label_cluster"))).cast("int") for m, s in pools]
        homes = made.groupBy("id").agg(*[h.alias(f"_{i}") for i, h in enumerate(home)])
        homes = homes.select("id", F.array(*[f"_{i}" for i in range(len(pools))]).alias("homes"))
        items = texts[ds].result().select("id", "title", "clean_title", MF.terms("title").alias("terms")).join(homes, "id")
        name = hashlib.md5(repr((pools, k)).encode()).hexdigest()[:12]
        return io.write_once(spark, f"{root}/items/{ds}-{version[ds]}-{name}", lambda: items, None, rows[ds])

    # a task waits for earlier ones only, so they never wait for each other
    with ThreadPoolExecutor(FITS_AT_ONCE) as at_once:
        texts = {ds: at_once.submit(text_table, ds) for ds in datasets}
        vectors = {ds: at_once.submit(vector_table, ds) for ds in datasets if any(m != "lda" for m, _ in pools_of(configs, ds))}
        keys = sorted({(c["dataset"], c["method"]) for c in configs}, key=lambda x: (x[1] == "lda", -rows[x[0]], x))
        labels, validation = at_once.submit(label_table), at_once.submit(validation_table)
        fits = {key: at_once.submit(assign, *key) for key in keys}
        items = {ds: at_once.submit(item_table, ds) for ds in datasets}
        tables = {"labels": labels.result(), "validation": validation.result(), "items": {ds: t.result() for ds, t in items.items()}}
        made = [fits[ds, m].result().select(F.concat_ws("-", F.lit(ds), F.lit(m), "seed").alias("pool"), F.col("label_cluster").cast("int").alias("label_cluster"), "id")
                for ds, m in fits]
    tables["assignment"] = functools.reduce(union, made)
    sizes = tables["assignment"].groupBy("pool").agg((F.max("label_cluster") + 1).alias("n")).collect()  # a row per fit; arms are dense
    tables["arms"] = {r["pool"]: r["n"] for r in sizes}
    return tables


def local(spark: SparkSession, rows: pa.Table, tasks: int = 1) -> DataFrame:
    """A small table of the driver in one task, or the few that its bound needs."""
    return spark.createDataFrame(rows).coalesce(tasks)


def run_table(spark: SparkSession, configs: list[dict], arms: dict[str, int]) -> DataFrame:
    """One row per run: its configuration, draw seed, pool and number of arms."""
    pool = [f"{c['dataset']}-{c['method']}-{c['repeat']}" for c in configs]
    place = {ds: pools_of(configs, ds) for ds in {c["dataset"] for c in configs}}
    return local(spark, pa.table({
        "run_id": [c["run_id"] for c in configs], "dataset": [c["dataset"] for c in configs], "balance": [bool(c["balance"]) for c in configs],
        "filter_label": [bool(c["filter_label"]) for c in configs], "seed": pa.array([41 + c["repeat"] for c in configs], pa.int32()), "pool": pool,
        "place": pa.array([place[c["dataset"]].index((c["method"], c["repeat"])) for c in configs], pa.int32()),
        "n_arms": pa.array([arms[p] for p in pool], pa.int32())}))


def _latest_models(steps: Steps, acc: DataFrame, step: int) -> DataFrame:
    """The weights in force: of each run's last accepted step before ``step``."""
    last = acc.where("accepted").groupBy("run_id").agg(F.max("step").alias("step"))
    return steps.read("models", 1, step - 1, _MODEL).join(last, ["run_id", "step"]).drop("step")


def _ids(labeled: pa.Table) -> dict[str, pa.Array]:
    """The ids that each run has drawn."""
    run, ids = labeled["run_id"].combine_chunks(), labeled["id"].combine_chunks()
    return {r: ids.filter(pc.equal(run, r)) for r in run.unique().to_pylist()}


def _labeled(small: SparkSession, tables: dict, ds: str, ask, rows: pa.Table, few: int) -> pa.Table:
    """The drawn rows of a dataset with their labels. An item drawn by several runs is asked once; of the stored labels
    only those of drawn items are joined."""
    labels, here = tables["labels"], local(small, rows, few)
    ids = labels.sparkSession.createDataFrame(pa.table({"id": rows["id"].combine_chunks().unique()}))
    stored = labels.where(F.col("dataset") == ds).select("id", "label").join(F.broadcast(ids), "id", "left_semi").toArrow()
    answers = LB.label_or_ask(here.select("id", "title", "clean_title").distinct(), local(small, stored, few), ds, ask)
    return here.select("run_id", "arm", "id", "title").join(answers.select("id", "label"), "id").select("run_id", "arm", "id", "title", "label").toArrow()


def _candidates(items: DataFrame, held) -> DataFrame:
    """(run_id, arm, id, _seed, predicted_label): unseen rows of the chosen arm of every run; no prediction for a run without
    a filter. ``held`` has a tuple of run, place of its pool, arm, draw seed, weights or none, ids seen or none for each run."""
    def task(batches):
        for b in batches:
            ids = b.column(0)
            homes = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
            terms, ends = MF.flat_terms(b.column(2))
            rows, which, classes = [], [], []
            for i, (_, place, arm, _, model, seen) in enumerate(held.value):
                at = np.flatnonzero(homes[:, place] == arm) if len(ids) else np.zeros(0, np.int64)
                if seen is not None and len(at):
                    at = at[~pc.is_in(ids.take(pa.array(at)), value_set=seen).to_numpy(zero_copy_only=False)]
                rows.append(at)
                which.append(np.full(len(at), i, np.int32))
                classes.append(np.full(len(at), -1) if model is None else MF.judge(model, terms, ends, at))
            at, which, classes = np.concatenate(rows), np.concatenate(which), np.concatenate(classes).astype(np.int32)
            run = [pa.DictionaryArray.from_arrays(pa.array(which), pa.array([x[j] for x in held.value], pa.string())).dictionary_decode() for j in (0, 3)]
            arm = np.array([x[2] for x in held.value], np.int32)[which]
            yield pa.RecordBatch.from_arrays([run[0], pa.array(arm), ids.take(pa.array(at)), run[1], pa.array(classes, mask=classes < 0)],
                                             names=["run_id", "arm", "id", "_seed", "predicted_label"])

    return items.select("id", "homes", "terms").mapInArrow(task, "run_id string, arm int, id string, _seed string, predicted_label int")


def _draw(tables: dict, turns: dict, sample_size: int) -> DataFrame:
    """The round's draw of all runs: unseen rows of the chosen arm in the order of the run's own draw key. A run with a
    classifier takes int(n / 2) predicted positives, negatives fill up; an arm without a positive is dead."""
    parts = [_candidates(tables["drawable"][ds], held).withColumn("dataset", F.lit(ds)) for ds, held in turns.items()]
    order = Window.partitionBy("run_id", "predicted_label").orderBy(draw_key(F.col("_seed")), "id")
    ranked = (functools.reduce(DataFrame.unionByName, parts).withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= sample_size)
              .withColumn("_pos", F.sum("predicted_label").over(Window.partitionBy("run_id"))))
    half, judged = sample_size // 2, F.col("predicted_label").isNotNull()
    taken = F.when(F.col("predicted_label") == 1, half).otherwise(sample_size - F.least("_pos", F.lit(half)))
    return ranked.where(~judged | (F.col("_pos") > 0) & (F.col("_rn") <= taken)).select("run_id", "dataset", "arm", "id")


def _with_texts(tables: dict, drawn: pa.Table) -> DataFrame:
    """The drawn rows (at most runs x sample size) with their texts, found in one scan."""
    texts = functools.reduce(DataFrame.unionByName, [t.select(F.lit(ds).alias("dataset"), "id", "title", "clean_title") for ds, t in tables["items"].items()])
    return texts.join(F.broadcast(texts.sparkSession.createDataFrame(drawn)), ["dataset", "id"])


def _judged(validation: DataFrame, held) -> DataFrame:
    """(run_id, label, prediction, n): validation rows counted under each run's weights."""
    def task(batches):
        counts = Counter()
        for b in batches:
            label, (terms, ends) = b.column(0).fill_null(NO_LABEL).to_numpy().astype(np.int64), MF.flat_terms(b.column(1))
            for run, model in held.value:
                pair, n = np.unique(2 * label + MF.judge(model, terms, ends, np.arange(len(label))), return_counts=True)
                counts.update({(run, int(p)): int(c) for p, c in zip(pair, n)})
        run, pair, n = [r for r, _ in counts], np.array([p for _, p in counts], np.int64), list(counts.values())
        label = pa.array((pair // 2).astype(np.int32), mask=pair // 2 == NO_LABEL)
        yield pa.RecordBatch.from_arrays([pa.array(run, pa.string()), label, pa.array((pair % 2).astype(np.int32)), pa.array(n, pa.int64())],
                                         names=["run_id", "label", "prediction", "n"])

    return validation.select("label", "terms").mapInArrow(task, "run_id string, label int, prediction int, n long")


def run_lockstep(spark: SparkSession, sf_dir: str, configs: list[dict], root: str, rounds: int = 10, k: int = 10, sample_size: int = 200,
                 baseline: float = 0.5, metric: str = "f1", fingerprints: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """All rounds of all runs; returns (run_id, step, arm, metric, baseline, reward, accepted, n_train)."""
    tables = grid_tables(spark, sf_dir, configs, root, k, fingerprints)
    few = -(-len(configs) * rounds * sample_size // DRAWN_A_TASK)   # tasks for what all runs have drawn
    small = small_session(spark)
    tables["drawable"] = {ds: small.read.schema(t.schema).parquet(*t.inputFiles()) for ds, t in tables["items"].items()}
    runs = run_table(small, configs, tables["arms"])
    of_run = {r["run_id"]: r for r in runs.collect()}
    steps, sc = Steps(small, f"{root}/rounds"), spark.sparkContext
    datasets = sorted({c["dataset"] for c in configs})
    asks = {ds: LB.keyword_labeler(ASK_KEYWORDS[ds], *ANSWERS[ds]) for ds in datasets}
    done = steps.done("results", rounds)
    seen = _ids(steps.read("labeled", 1, done, LABELED_LOG).select("run_id", "id").toArrow()) if 0 < done < rounds else {}
    results = steps.read("results", 1, done, _RESULT).coalesce(1).toArrow()
    balanced = pa.array([c["run_id"] for c in configs if c["balance"]], pa.string())
    in_force = fitted = None
    written: list[Future] = []
    with ThreadPoolExecutor(LOGS_AT_ONCE) as at_once:
        def log(rows: pa.Table, name: str, step: int, schema: str, after: list[Future] = ()) -> Future:
            def write():
                for f in after:
                    f.result()
                steps.write(local(small, rows, few), name, step, schema)
            return at_once.submit(write)

        for step in range(done + 1, rounds + 1):
            acc = local(small, BD.reward_accept(local(small, results), baseline).toArrow())
            if in_force is None:
                in_force = MF.weights(_latest_models(steps, acc, step).toArrow()) if step > 1 else {}
            else:
                kept = acc.where(F.col("accepted") & (F.col("step") == step - 1)).select("run_id").collect()
                in_force |= {r["run_id"]: fitted[r["run_id"]] for r in kept}
            state = BD.bandit_state(acc.select("run_id", "step", "arm", "reward")).coalesce(1)
            post = (runs.select("run_id", "seed", F.explode(F.expr("sequence(0, n_arms - 1)")).alias("arm")).join(state, ["run_id", "arm"], "left")
                    .select("run_id", "seed", "arm", (F.coalesce("wins", F.lit(0.0)) + BD.PRIOR_ALPHA).alias("alpha"),
                            (F.coalesce("losses", F.lit(0.0)) + BD.PRIOR_BETA).alias("beta")))
            chosen = BD.choose_arm(post, F.lit(step), F.col("seed")).select("run_id", F.col("chosen_arm").alias("arm")).toArrow()
            logs = [log(chosen, "choice", step, _CHOICE)]
            turns = {ds: [] for ds in datasets}
            for r in chosen.to_pylist():
                run = of_run[r["run_id"]]
                model = in_force.get(r["run_id"]) if run["filter_label"] else None
                turns[run["dataset"]].append((r["run_id"], run["place"], r["arm"], f"{run['seed']}:{r['run_id']}:{step}", model, seen.get(r["run_id"])))
            held = {ds: sc.broadcast(t) for ds, t in turns.items()}
            drawn = _with_texts(tables, _draw(tables, held, sample_size).toArrow()).toArrow()
            for h in held.values():
                h.destroy()
            logs.append(log(drawn, "draws", step, _DRAW))
            asked = at_once.map(lambda ds: _labeled(small, tables, ds, asks[ds], drawn.filter(pc.equal(drawn["dataset"], ds)), few), datasets)
            labeled = pa.concat_tables(list(asked))
            logs.append(log(labeled, "labeled", step, LABELED_LOG))
            for r, ids in _ids(labeled).items():
                seen[r] = pa.concat_arrays([seen[r], ids]) if r in seen else ids
            for f in written:   # earlier steps are read from their logs
                f.result()
            own, cols = local(small, labeled, few), ["run_id", "id", "title", "label"]
            carried = BD.positive_buffer(steps.read("labeled", 1, step - 1, LABELED_LOG).coalesce(few), acc)
            train = own.select(cols).unionByName(carried.select(cols)).coalesce(few).dropDuplicates(["run_id", "id"]).toArrow()
            even = pc.is_in(train["run_id"], value_set=balanced)
            cut = local(small, train.filter(even), few).join(runs.select("run_id", F.concat_ws(":", "seed", "run_id", F.lit(f"{step}:b")).alias("_seed")), "run_id")
            cut = SM.balance_two_to_one(cut, F.col("_seed"), ["run_id"]).select(cols).toArrow()
            train = pa.concat_tables([cut, train.filter(pc.invert(even))])
            logs.append(log(train, "training", step, "run_id string, id string, title string, label int"))
            train = local(small, train, few)
            flags = class_ratio_flags(train, ["run_id"]).select("run_id", (F.col("n_pos") + F.col("n_neg")).alias("n_train"),
                                                                F.coalesce("still_unbalanced", F.lit(True)).alias("weighted")).toArrow()
            flags = local(small, flags)
            models = MF.fit_runs(train.join(flags.select("run_id", "weighted"), "run_id")).toArrow()
            logs.append(log(models, "models", step, _MODEL))
            fitted = MF.weights(models)
            held = {ds: sc.broadcast([(r, m) for r, m in sorted(fitted.items()) if of_run[r]["dataset"] == ds]) for ds in datasets}
            scored = [_judged(tables["validation"].where(F.col("dataset") == ds), h) for ds, h in held.items()]
            scored = local(small, functools.reduce(DataFrame.unionByName, scored).toArrow())
            for h in held.values():
                h.destroy()
            metrics = classification_metrics(scored, ["run_id"], "label", "prediction", "n")
            result = (local(small, chosen).join(metrics.select("run_id", "accuracy", "precision", "recall", "f1"), "run_id", "left")
                      .join(flags.select("run_id", "n_train"), "run_id", "left").withColumn("metric", F.col(metric))
                      .withColumn("n_train", F.coalesce("n_train", F.lit(0))).withColumn("step", F.lit(step)))
            result = result.select(*[F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(_RESULT)], "step").toArrow()
            results = pa.concat_tables([results, result.cast(results.schema)])
            # a step counts as done by its results: they are written when all else is
            written = [*logs, log(result, "results", step, _RESULT, [*written, *logs])]
        for f in written:
            f.result()
    out = BD.reward_accept(Steps(spark, steps.root).read("results", 1, rounds, _RESULT).coalesce(1), baseline)
    return out.select("run_id", "step", "arm", "metric", "baseline", "reward", "accepted", "n_train")
