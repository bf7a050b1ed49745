"""Registered queries: tokens, bag of words, class-TF-IDF, topic words, argmax topics, centroids,
and the Spark ML topic models (rows-only: fitted models are not bit-reproducible across engines)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import density as DN
from ..operators import topics as TP
from ..session import checkpoint_dir, scratch_path
from ..sources import bind as B
from . import sqlbits as S
from .registry import query

SEED = 7
K = 10
TOPN = 10


def _docs(spark, d):
    """News pool with its cleaned text (the text the topic models read)."""
    return B.news_pool(spark, d).select("id", "label_cluster", T.clean_text("text").alias("topic_text"))


DOCS_SQL = f"SELECT id, label_cluster, {S.clean_text('text')} AS topic_text FROM ({S.NEWS_POOL})"
TOK_LIST = "list_filter(string_split(coalesce(topic_text, ''), ' '), lambda x: x <> '')"


@query("tokenize", f"""SELECT id, CAST(unnest(range(len(t))) AS INTEGER) AS pos, unnest(t) AS token
FROM (SELECT id, {TOK_LIST} AS t FROM ({DOCS_SQL}))""")
def tokenize(spark, d):
    return TP.tokenize(_docs(spark, d), "topic_text")


BOW_SQL = f"SELECT id, token, count(*) AS n FROM (SELECT id, unnest({TOK_LIST}) AS token FROM ({DOCS_SQL})) GROUP BY id, token"


@query("bag_of_words", BOW_SQL)
def bag_of_words(spark, d):
    return TP.bag_of_words(_docs(spark, d), "topic_text")


@query("dictionary", f"SELECT token, count(*) AS doc_freq, CAST(sum(n) AS BIGINT) AS coll_freq FROM ({BOW_SQL}) GROUP BY token")
def dictionary(spark, d):
    return TP.dictionary(_docs(spark, d), "topic_text")


CTFIDF_SQL = f"""WITH tok AS (SELECT label_cluster, unnest({TOK_LIST}) AS token FROM ({DOCS_SQL})),
tf AS (SELECT label_cluster, token, count(*) AS tf FROM tok GROUP BY label_cluster, token),
pc AS (SELECT label_cluster, sum(tf) AS n_c FROM tf GROUP BY label_cluster),
a AS (SELECT CAST(sum(n_c) AS DOUBLE) / count(*) AS A FROM pc),
pt AS (SELECT token, sum(tf) AS f_t FROM tf GROUP BY token),
s AS (SELECT tf.label_cluster, tf.token, (CAST(tf.tf AS DOUBLE) / CAST(pc.n_c AS DOUBLE)) * ln(1 + a.A / CAST(pt.f_t AS DOUBLE)) AS score
      FROM tf JOIN pc ON tf.label_cluster = pc.label_cluster JOIN pt ON tf.token = pt.token CROSS JOIN a)
SELECT label_cluster, "rank", token, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY label_cluster
  ORDER BY score DESC, token) AS INTEGER) AS "rank" FROM s) WHERE "rank" <= {TOPN}"""


@query("ctfidf_terms", f"SELECT label_cluster, \"rank\", token, round(score, 6) AS score FROM ({CTFIDF_SQL})")
def ctfidf_terms(spark, d):
    t = TP.ctfidf_terms(_docs(spark, d), "topic_text", "label_cluster", TOPN)
    return t.select("label_cluster", "rank", "token", F.round("score", 6).alias("score"))


@query("topic_info", f"""SELECT s.label_cluster, s.n, CAST(s.label_cluster AS VARCHAR) || '_' ||
  array_to_string(list(c.token ORDER BY c."rank"), '_') AS name
FROM (SELECT label_cluster, count(*) AS n FROM ({S.NEWS_POOL}) GROUP BY label_cluster) s
JOIN ({CTFIDF_SQL}) c ON s.label_cluster = c.label_cluster WHERE c."rank" <= 4 GROUP BY s.label_cluster, s.n""")
def topic_info(spark, d):
    docs = _docs(spark, d)
    terms = TP.ctfidf_terms(docs, "topic_text", "label_cluster", 4)
    names = terms.groupBy("label_cluster").agg(F.array_sort(F.collect_list(F.struct("rank", "token"))).alias("_t"))
    names = names.select("label_cluster", F.concat_ws("_", F.col("label_cluster").cast("string"),
                                                      F.concat_ws("_", F.col("_t.token"))).alias("name"))
    sizes = docs.groupBy("label_cluster").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(names, "label_cluster")


@query("topic_top_words", f"""SELECT label_cluster, "rank", token, tf FROM (SELECT label_cluster, token, tf,
  CAST(row_number() OVER (PARTITION BY label_cluster ORDER BY tf DESC, token) AS INTEGER) AS "rank"
  FROM (SELECT label_cluster, token, count(*) AS tf FROM (SELECT label_cluster, unnest({TOK_LIST}) AS token FROM ({DOCS_SQL}))
        GROUP BY label_cluster, token)) WHERE "rank" <= 5""")
def topic_top_words(spark, d):
    from pyspark.sql import Window
    docs = _docs(spark, d)
    tf = (docs.select("label_cluster", F.explode(TP.tokens("topic_text")).alias("token"))
          .groupBy("label_cluster", "token").agg(F.count(F.lit(1)).alias("tf")))
    w = Window.partitionBy("label_cluster").orderBy(F.col("tf").desc(), "token")
    return tf.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= 5)


@query("dominant_topic", """SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS topic
FROM embeddings""")
def dominant_topic(spark, d):
    e = B.table(spark, d, "embeddings")
    return TP.dominant_topic(e, "embedding").select("vec_id", "topic")


@query("nearest_centroid", """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT label, unnest(range(len(v))) AS i, unnest(v) AS x FROM e),
c AS (SELECT label, list(m ORDER BY i) AS cv FROM (SELECT label, i, avg(x) AS m FROM u GROUP BY label, i) GROUP BY label),
s AS (SELECT e.vec_id, c.label AS topic, list_cosine_similarity(e.v, c.cv) AS sim FROM e CROSS JOIN c)
SELECT vec_id, topic, round(sim, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id
  ORDER BY sim DESC, topic) AS rn FROM s) WHERE rn = 1""")
def nearest_centroid(spark, d):
    e = B.table(spark, d, "embeddings")
    dim = 64
    cents = TP.centroids(e, "label", "embedding", dim)
    out = TP.nearest_centroid(e, cents, "label", "embedding", "vec_id")
    return out.select("vec_id", "topic", F.round("similarity", 6).alias("similarity"))


# --- Spark ML models (rows-only checks) ---------------------------------------------------------

@query("lda_topics")
def lda_topics(spark, d):
    return TP.lda_topics(_docs(spark, d), "topic_text", K, max_iter=10, seed=SEED)


@query("lda_save_load", f"SELECT id, TRUE AS assigned, TRUE AS same FROM ({DOCS_SQL})")
def lda_save_load(spark, d):
    """Fit, save, load: every row gets a topic in range, the same from the loaded model as from the fitted one."""
    bow = TP.hashed_counts(_docs(spark, d), "topic_text").persist()
    try:
        model = TP.fit_lda(bow, K, max_iter=10, seed=SEED)
        path = scratch_path(spark, "lda-model")
        TP.save_lda(model, path)
        fitted = TP.assign_lda(model, bow, "id", "_bow").withColumnRenamed("label_cluster", "_fitted")
        both = TP.assign_lda(TP.load_lda(path), fitted, "id", "_fitted")
        checkpoint_dir(spark)
        return both.select("id", F.col("label_cluster").between(0, K - 1).alias("assigned"),
                           (F.col("label_cluster") == F.col("_fitted")).alias("same")).checkpoint()
    finally:
        bow.unpersist()


def _bit(i):
    return f"2 * ((CAST('0x' || substr(md5(token), {1 + 8 * (i // 32)}, 8) AS BIGINT) >> {i % 32}) & 1) - 1"


EMBED_SQL = f"""SELECT id, {', '.join(f"coalesce(avg({_bit(i)}), 0.0) AS x{i}" for i in range(TP.EMBED_DIM))}
FROM (SELECT d.id, t.token FROM ({DOCS_SQL}) d LEFT JOIN (SELECT id, unnest({TOK_LIST}) AS token FROM ({DOCS_SQL})) t ON d.id = t.id)
GROUP BY id"""


@query("embed_documents", "SELECT id, " + ", ".join(f"round(x{i}, 6) AS x{i}" for i in range(TP.EMBED_DIM)) + f" FROM ({EMBED_SQL})")
def embed_documents(spark, d):
    emb = TP.embed_documents(_docs(spark, d), "topic_text")
    return emb.select("id", *[F.round(F.col("embedding")[i], 6).alias(f"x{i}") for i in range(TP.EMBED_DIM)])


def _vectors(spark, d):
    return B.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")


@query("project_embeddings")
def project_embeddings(spark, d):
    return TP.project_embeddings(_vectors(spark, d), 2)


@query("kmeans_topics")
def kmeans_topics(spark, d):
    return TP.kmeans_topics(_vectors(spark, d), K, seed=SEED)


@query("fine_topics")
def fine_topics(spark, d):
    return TP.fine_topics(_vectors(spark, d), 2 * K, seed=SEED).select("id", "fine_topic")


@query("reduce_topics")
def reduce_topics(spark, d):
    fine = TP.fine_topics(_vectors(spark, d), 2 * K, seed=SEED)
    return TP.reduce_topics(fine, K, dim=64)


_DIMS = range(TP.EMBED_DIM)


@query("topic_words_by_vector", f"""WITH c AS (
  SELECT d.label_cluster, [{', '.join(f'avg(e.x{i})' for i in _DIMS)}] AS cv
  FROM ({EMBED_SQL}) e JOIN ({DOCS_SQL}) d ON e.id = d.id GROUP BY d.label_cluster),
w AS (SELECT token, CAST([{', '.join(_bit(i) for i in _DIMS)}] AS DOUBLE[]) AS v
  FROM (SELECT DISTINCT unnest({TOK_LIST}) AS token FROM ({DOCS_SQL}))),
s AS (SELECT c.label_cluster, w.token AS word, list_cosine_similarity(w.v, c.cv) AS score FROM w CROSS JOIN c)
SELECT label_cluster, word, round(score, 6) AS score, "rank" FROM (SELECT *, CAST(row_number() OVER (
  PARTITION BY label_cluster ORDER BY score DESC, word) AS INTEGER) AS "rank" FROM s) WHERE "rank" <= {TOPN}""")
def topic_words_by_vector(spark, d):
    docs = _docs(spark, d)
    emb = TP.embed_documents(docs, "topic_text")
    cents = TP.centroids(emb.join(docs.select("id", "label_cluster"), "id"), "label_cluster", "embedding", TP.EMBED_DIM)
    words = TP.topic_words_by_vector(TP.word_vectors(docs, "topic_text"), cents, "label_cluster", TOPN)
    return words.withColumn("score", F.round("score", 6))


@query("cluster_methods")
def cluster_methods(spark, d):
    docs = _docs(spark, d)
    emb = TP.embed_documents(docs, "topic_text")  # settled once for both methods that read it
    out = None
    for m in ("lda", "kmeans", "fine"):
        a = TP.cluster(docs, m, K, text_col="topic_text", seed=SEED, embeddings=emb).withColumn("method", F.lit(m))
        out = a if out is None else out.unionByName(a)
    return out


@query("density_topics")
def density_topics(spark, d):
    """Topics of a neighbour graph's condensed tree, every row at its nearest topic vector."""
    return DN.density_topics(_vectors(spark, d))


@query("density_facts", """SELECT count(*) AS n_rows, count(*) AS full_lists, count(*) AS edges_and_trees
FROM embeddings WHERE embedding IS NOT NULL""")
def density_facts(spark, d):
    """Rows, rows with a full list of neighbours, and edges plus trees of the spanning forest (one for each row)."""
    vecs = DN.unit_vectors(_vectors(spark, d))
    graph = DN.knn_graph(vecs)
    tree, roots = DN.spanning_forest(DN.reachability(graph, 5))
    full = graph.groupBy("src").count().where(F.col("count") == DN.NEIGHBOURS)
    parts = [("n_rows", vecs), ("full_lists", full), ("edges_and_trees", tree.select("u").union(roots.select("root").distinct()))]
    rows = None
    for name, df in parts:
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("fact"), "n")
        rows = one if rows is None else rows.union(one)
    return rows.groupBy().agg(*[F.max(F.when(F.col("fact") == name, F.col("n"))).alias(name) for name, _ in parts])
