"""Registered queries: sources, text functions, corpus preparation, prompts and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import labels as LB
from ..operators import prepare as P
from ..operators import sets as U
from ..schemas import NEWS_POOL as NEWS_SCHEMA
from ..session import scratch_path
from ..sources import bind as B
from ..sources import io
from . import sqlbits as S
from .registry import query


@query("scan_pool", f"""SELECT CAST(p.doc_id AS VARCHAR) AS id, {S.first_line('p.text')} AS title, p.text,
  CAST(l.toxic AS INTEGER) AS label FROM documents p LEFT JOIN labels l ON p.doc_id = l.doc_id""")
def scan_pool(spark, d):
    """Pool written as CSV (texts hold newlines and quotes) and scanned back with the declared schema."""
    lab = B.table(spark, d, "labels").select("doc_id", F.col("toxic").alias("label"))
    src = B.news_pool(spark, d).join(lab, "doc_id", "left").select("id", "title", "text", "label")
    path = scratch_path(spark, "pool_csv")
    io.write_csv(src, path)
    return io.read_csv(spark, path, NEWS_SCHEMA)


@query("scan_validation", f"""SELECT title, text, CAST(list_contains(topics_list, '{B.TARGET_TOPIC}') AS INTEGER) AS label,
  text AS training_text FROM ({S.KEPT_CORPUS}) WHERE split = 'test'""")
def scan_validation(spark, d):
    v = P.prep_validation(B.raw_news(spark, d), B.TARGET_TOPIC).drop("doc_id")
    path = scratch_path(spark, "validation")
    v.write.mode("overwrite").parquet(path)
    return io.scan_validation(spark, path, "news")


@query("corpus_splits", f"SELECT split, count(*) AS n_rows FROM ({S.RAW_NEWS}) GROUP BY split")
def corpus_splits(spark, d):
    return B.raw_news(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


@query("drop_null_title", f"SELECT id, title FROM ({S.POOL_NULL_TITLES}) WHERE title IS NOT NULL")
def drop_null_title(spark, d):
    return P.drop_null_title(B.pool_with_null_titles(spark, d)).select("id", "title")


@query("title_and_desc", f"""SELECT id, CASE WHEN description IS NULL THEN title ELSE title || '. ' || description END
  AS title_and_desc FROM ({S.ADS_POOL})""")
def title_and_desc(spark, d):
    return B.ads_pool(spark, d).select("id", T.title_and_desc("title", "description").alias("title_and_desc"))


@query("clean_text", f"SELECT CAST(doc_id AS VARCHAR) AS id, {S.clean_text('text')} AS clean_text FROM documents")
def clean_text(spark, d):
    return B.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"),
                                                  T.clean_text("text").alias("clean_text"))


@query("preprocess_pool", f"""SELECT id, {S.clean_text('title')} AS clean_title, {S.clean_text('text')} AS clean_text
FROM ({S.POOL_NULL_TITLES}) WHERE title IS NOT NULL""")
def preprocess_pool(spark, d):
    return P.preprocess_pool(B.pool_with_null_titles(spark, d)).select("id", "clean_title", "clean_text")


@query("preprocess_ads", f"""SELECT id, {S.clean_text("CASE WHEN description IS NULL THEN title ELSE title || '. ' || description END")}
  AS clean_title FROM ({S.ADS_POOL})""")
def preprocess_ads(spark, d):
    return P.preprocess_pool(B.ads_pool(spark, d)).select("id", "clean_title")


@query("parse_topics", f"""SELECT doc_id, CAST(len(t) AS INTEGER) AS n_topics, array_to_string(t, '|') AS topics
FROM (SELECT doc_id, {S.parse_list('topics')} AS t FROM ({S.RAW_NEWS}))""")
def parse_topics(spark, d):
    t = T.parse_list_literal("topics")
    return B.raw_news(spark, d).select("doc_id", F.size(t).alias("n_topics"),
                                       F.concat_ws("|", t).alias("topics"))


@query("strip_wire_tag", f"SELECT doc_id, {S.strip_wire_tag('text')} AS text FROM ({S.RAW_NEWS})")
def strip_wire_tag(spark, d):
    return B.raw_news(spark, d).select("doc_id", T.strip_wire_tag("text").alias("text"))


@query("clean_headline", f"SELECT doc_id, {S.clean_headline('title')} AS title FROM ({S.RAW_NEWS})")
def clean_headline(spark, d):
    return B.raw_news(spark, d).select("doc_id", T.clean_headline("title").alias("title"))


@query("clean_id", f"SELECT doc_id, {S.clean_id('new_id')} AS id FROM ({S.RAW_NEWS})")
def clean_id(spark, d):
    return B.raw_news(spark, d).select("doc_id", T.clean_id("new_id").alias("id"))


@query("word_count", f"SELECT CAST(doc_id AS VARCHAR) AS id, {S.word_count('text')} AS n_words FROM documents")
def word_count(spark, d):
    return B.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"),
                                                  T.word_count("text").alias("n_words"))


@query("drop_short", f"SELECT doc_id, split, n_words FROM ({S.KEPT_CORPUS})")
def drop_short(spark, d):
    return P.keep_long(P.clean_corpus(B.raw_news(spark, d))).select("doc_id", "split", "n_words")


@query("drop_short_counts", f"""SELECT split, count(*) AS before,
  CAST(sum(CASE WHEN length(text) > 0 AND length(title) > 0 AND {S.word_count('text')} >= 10 THEN 1 ELSE 0 END) AS BIGINT) AS after,
  CAST(sum(CASE WHEN length(text) > 0 AND length(title) > 0 AND {S.word_count('text')} >= 10 THEN 0 ELSE 1 END) AS BIGINT) AS dropped
FROM ({S.CLEAN_CORPUS}) GROUP BY split""")
def drop_short_counts(spark, d):
    return P.drop_short_counts(P.clean_corpus(B.raw_news(spark, d)), ["split"])


@query("dedup_by_id", f"""SELECT id, min(doc_id) AS doc_id FROM (SELECT {S.clean_id('new_id')} AS id, doc_id
FROM ({S.KEPT_CORPUS}) WHERE split = 'train') GROUP BY id""")
def dedup_by_id(spark, d):
    tr = P.keep_long(P.clean_corpus(B.raw_news(spark, d)).filter(F.col("split") == "train"))
    return P.dedup_by_id(tr.withColumn("id", T.clean_id("new_id")).select("id", "doc_id"), "doc_id")


@query("dedup_counts", f"""SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS before, count(*) AS after,
  CAST(coalesce(sum(n), 0) AS BIGINT) - count(*) AS removed
FROM (SELECT id, count(*) AS n FROM (SELECT {S.clean_id('new_id')} AS id FROM ({S.KEPT_CORPUS}) WHERE split = 'train') GROUP BY id)""")
def dedup_counts(spark, d):
    tr = P.keep_long(P.clean_corpus(B.raw_news(spark, d)).filter(F.col("split") == "train"))
    return P.dedup_counts(tr.select(T.clean_id("new_id").alias("id")))


@query("prep_pool", f"""SELECT id, title, text FROM (SELECT {S.clean_id('new_id')} AS id, title, text,
  row_number() OVER (PARTITION BY {S.clean_id('new_id')} ORDER BY doc_id) AS rn
  FROM ({S.KEPT_CORPUS}) WHERE split = 'train') WHERE rn = 1""")
def prep_pool(spark, d):
    return P.prep_pool(B.raw_news(spark, d))


@query("prep_validation", f"""SELECT doc_id, title, text,
  CAST(list_contains(topics_list, '{B.TARGET_TOPIC}') AS INTEGER) AS label FROM ({S.KEPT_CORPUS}) WHERE split = 'test'""")
def prep_validation(spark, d):
    return P.prep_validation(B.raw_news(spark, d), B.TARGET_TOPIC)


@query("corpus_stats", f"""SELECT split, count(*) AS n_rows, CAST(sum(y) AS BIGINT) AS n_pos,
  round(sum(y) * 100.0 / count(*), 6) AS pct_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg,
  round(avg(n_words), 6) AS mean_words, round(quantile_cont(n_words, 0.5), 6) AS median_words
FROM (SELECT split, n_words, CAST(list_contains(topics_list, '{B.TARGET_TOPIC}') AS INTEGER) AS y FROM ({S.KEPT_CORPUS}))
GROUP BY split""")
def corpus_stats(spark, d):
    from ..operators.stats import corpus_stats as cs
    kept = P.keep_long(P.clean_corpus(B.raw_news(spark, d)))
    kept = kept.withColumn("label", F.array_contains("topics_list", B.TARGET_TOPIC).cast("int"))
    return cs(kept, ["split"])


@query("truncate_text", f"""SELECT CAST(doc_id AS VARCHAR) AS id, {S.truncate('text')} AS text,
  CAST(length({S.truncate('text')}) AS INTEGER) AS n_chars FROM documents""")
def truncate_text(spark, d):
    t = T.truncate_text("text")
    return B.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"),
                                                  t.alias("text"), F.length(t).alias("n_chars"))


def _prompt_sql(labeler: str, dataset: str, body: str) -> str:
    pre, suf = LB.template(labeler, dataset)
    return f"{S.lit(pre)} || {body} || {S.lit(suf)}"


@query("build_prompts", f"""SELECT id, title, {S.clean_text('title')} AS training_text,
  {_prompt_sql('hf', 'news', S.truncate(S.clean_text('text')))} AS text
FROM ({S.POOL_NULL_TITLES}) WHERE title IS NOT NULL""")
def build_prompts(spark, d):
    pre = P.preprocess_pool(B.pool_with_null_titles(spark, d))
    return LB.build_prompts(pre, "hf", "news", "clean_text", T.PROMPT_MAX_CHARS)


def _dispatch_sql() -> str:
    whens = []
    for (lab, ds), _ in LB.PROMPTS.items():
        cond = f"labeler = '{lab}'" + ("" if ds == "*" else f" AND dataset = '{ds}'")
        whens.append(f"WHEN {cond} THEN {_prompt_sql(lab, ds, S.truncate('body'))}")
    return "CASE " + " ".join(whens) + " ELSE NULL END"


_LABELERS_SQL = "CASE doc_id % 4 WHEN 0 THEN 'instruct' WHEN 1 THEN 'chat' WHEN 2 THEN 'hf' ELSE 'none' END"


@query("prompt_dispatch", f"""SELECT id, dataset, labeler, md5(prompt) AS prompt_md5, CAST(length(prompt) AS INTEGER) AS prompt_len
FROM (SELECT id, dataset, labeler, {_dispatch_sql()} AS prompt FROM (
  SELECT CAST(doc_id AS VARCHAR) AS id, 'news' AS dataset, {_LABELERS_SQL} AS labeler, text AS body FROM documents
  UNION ALL
  SELECT CAST(p_partkey AS VARCHAR) AS id, 'ads' AS dataset, {_LABELERS_SQL.replace('doc_id', 'p_partkey')} AS labeler,
    p_name AS body FROM part))""")
def prompt_dispatch(spark, d):
    def labeler(c):
        m = F.col(c) % 4
        return (F.when(m == 0, "instruct").when(m == 1, "chat").when(m == 2, "hf").otherwise("none"))
    news = B.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"),
                                                  F.lit("news").alias("dataset"), labeler("doc_id").alias("labeler"),
                                                  F.col("text").alias("body"))
    ads = B.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"),
                                           F.lit("ads").alias("dataset"), labeler("p_partkey").alias("labeler"),
                                           F.col("p_name").alias("body"))
    prompt = LB.prompt_expr("labeler", "dataset", T.truncate_text("body"))
    return (U.union_by_name(news, ads).withColumn("prompt", prompt)
            .select("id", "dataset", "labeler", F.md5("prompt").alias("prompt_md5"),
                    F.length("prompt").alias("prompt_len")))


@query("answer_first_line", f"""SELECT conv_id, turn, {S.strip_ws(S.first_line(S.strip_ws('text')))} AS answer
FROM conversations""")
def answer_first_line(spark, d):
    return B.table(spark, d, "conversations").select("conv_id", "turn", T.answer_first_line("text").alias("answer"))


_MARKED_SQL = ("CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN 'echo Response:' || chr(10) || text "
               "ELSE 'a Response:' || chr(10) || 'b' || chr(10) || 'Response:' || chr(10) || text END")


def _marked(c):
    m = F.col("turn") % 3
    return (F.when(m == 0, F.col(c)).when(m == 1, F.concat(F.lit("echo Response:\n"), F.col(c)))
            .otherwise(F.concat(F.lit("a Response:\nb\nResponse:\n"), F.col(c))))


@query("answer_after_marker", f"""SELECT conv_id, turn, coalesce(split_part(coalesce(p[3], p[2]), chr(10), 1),
  '{T.DEFAULT_NEGATIVE_ANSWER}') AS answer
FROM (SELECT conv_id, turn, string_split({_MARKED_SQL}, 'Response:' || chr(10)) AS p FROM conversations)""")
def answer_after_marker(spark, d):
    c = B.table(spark, d, "conversations")
    return c.select("conv_id", "turn", T.answer_after_marker(_marked("text")).alias("answer"))


_ANSWERS = [  # fixed answer variants by (toxic, doc_id % 3)
    ((1, 0), "Relevant animal"), ((1, 1), " relevant animal\n"), ((1, 2), "Relevant"),
    ((0, 0), "Not a relevant animal"), ((0, 1), "not relevant"), ((0, 2), "irrelevant"),
]


def _answer_col():
    e = None
    for (y, m), a in _ANSWERS:
        cond = (F.col("toxic") == y) & (F.col("doc_id") % 3 == m)
        e = F.when(cond, F.lit(a)) if e is None else e.when(cond, F.lit(a))
    return e


def _answer_sql():
    return "CASE " + " ".join(f"WHEN toxic = {y} AND doc_id % 3 = {m} THEN {S.lit(a)}" for (y, m), a in _ANSWERS) + " END"


def _rule_sql(pos, neg):
    a = f"lower({S.strip_ws('answer')})"
    return f"CAST((contains({a}, '{pos}') AND NOT contains({a}, '{neg}')) AS INTEGER)"


@query("label_rule_ads", f"""SELECT doc_id, {S.strip_ws('answer')} AS answer, {_rule_sql(T.ADS_POSITIVE, T.ADS_NEGATIVE)} AS label
FROM (SELECT doc_id, {_answer_sql()} AS answer FROM labels)""")
def label_rule_ads(spark, d):
    a = B.table(spark, d, "labels").select("doc_id", _answer_col().alias("answer"))
    return LB.label_from_answer(a, "ads")


@query("label_rule_news", f"""SELECT doc_id, {S.strip_ws('answer')} AS answer, {_rule_sql(T.NEWS_POSITIVE, T.NEWS_NEGATIVE)} AS label
FROM (SELECT doc_id, {_answer_sql()} AS answer FROM labels)""")
def label_rule_news(spark, d):
    a = B.table(spark, d, "labels").select("doc_id", _answer_col().alias("answer"))
    return LB.label_from_answer(a, "news")


@query("union_by_name", f"""SELECT id, title, text, NULL AS description, 'news' AS dataset FROM ({S.NEWS_POOL})
UNION ALL SELECT id, title, NULL AS text, description, 'ads' AS dataset FROM ({S.ADS_POOL})""")
def union_by_name(spark, d):
    news = B.news_pool(spark, d).select("id", "title", "text", F.lit("news").alias("dataset"))
    ads = B.ads_pool(spark, d).select("id", "title", "description", F.lit("ads").alias("dataset"))
    return U.union_by_name(news, ads).select("id", "title", "text", "description", "dataset")


@query("dedup_rows", "SELECT DISTINCT md5(text) AS text_md5, lang FROM documents")
def dedup_rows(spark, d):
    docs = B.table(spark, d, "documents").select("text", "lang")
    return U.dedup_rows(docs).select(F.md5("text").alias("text_md5"), "lang")
