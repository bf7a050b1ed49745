"""Pool preprocessing and corpus preparation (projections, filters, de-duplication).

All steps are narrow column expressions except the id de-duplication (one shuffle on id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

MIN_WORDS = 10  # fixed value: articles shorter than this are dropped


def drop_null_title(df: DataFrame) -> DataFrame:
    return df.na.drop(subset=["title"])


def preprocess_pool(df: DataFrame) -> DataFrame:
    """Drop NULL titles; ``clean_title`` from title (+ description when the column exists);
    ``clean_text`` from text when it exists, NULL otherwise; ``text_for_topics`` never NULL."""
    d = drop_null_title(df)
    if "description" in d.columns:
        d = d.withColumn("title_and_desc", T.title_and_desc("title", "description"))
        d = d.withColumn("clean_title", T.clean_text("title_and_desc"))
    else:
        d = d.withColumn("clean_title", T.clean_text("title"))
    d = d.withColumn("clean_text", T.clean_text("text") if "text" in d.columns else F.lit(None).cast("string"))
    return d


def feature_text(df: DataFrame, dataset: str) -> DataFrame:
    """The text a topic model reads: clean body for news, clean title for ads; NULL -> ''."""
    col = "clean_text" if dataset == "news" else "clean_title"
    return df.withColumn("topic_text", F.coalesce(F.col(col), F.lit("")))


def computed_once(df: DataFrame) -> DataFrame:
    """Evaluate every column of ``df`` once per row before any later filter.

    Catalyst pushes a filter below a projection by substituting the projected expressions,
    so a filter on a cleaned text would re-run the cleaning regexes (then the projection runs
    them again). A filter cannot move below a Generate that produces the columns it reads, so
    emitting the row through a one-element ``inline`` keeps the expensive text work single.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def clean_corpus(df: DataFrame) -> DataFrame:
    """Raw news corpus -> parsed topics, cleaned article and headline, word count."""
    keep = [c for c in df.columns if c not in ("text", "title")]
    cleaned = df.select(*keep, T.parse_list_literal("topics").alias("topics_list"), T.strip_wire_tag("text").alias("text"),
                        T.clean_headline("title").alias("title"))
    return computed_once(cleaned).withColumn("n_words", T.spaced_word_count("text"))


def keep_long(df: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Drop empty text, empty title and texts under ``min_words`` words (after cleaning).
    Reuses ``n_words`` when the cleaner already computed it (one regex pass, not two)."""
    wc = F.col("n_words") if "n_words" in df.columns else T.word_count("text")
    return df.filter((F.length("text") > 0) & (F.length("title") > 0) & (wc >= min_words))


def drop_short_counts(df: DataFrame, keys: list[str], min_words: int = MIN_WORDS) -> DataFrame:
    wc = F.col("n_words") if "n_words" in df.columns else T.word_count("text")
    keep = (F.length("text") > 0) & (F.length("title") > 0) & (wc >= min_words)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("before"),
                                 F.sum(keep.cast("int")).alias("after"),
                                 F.sum((~keep).cast("int")).alias("dropped"))


def dedup_by_id(df: DataFrame, order_col: str, id_col: str = "id") -> DataFrame:
    """Keep the first row per id; "first" is made explicit by ``order_col``.

    An aggregation (``min_by``), not a per-id window: partial aggregation keeps one row per id
    per map task, so an id repeated across a third of the corpus never lands whole in one task.
    """
    others = [c for c in df.columns if c != id_col]
    first = df.groupBy(id_col).agg(F.min_by(F.struct(*others), F.col(order_col)).alias("_r"))
    return first.select(id_col, "_r.*")


def dedup_counts(df: DataFrame, id_col: str = "id") -> DataFrame:
    """One row (before, after, removed): what ``dedup_by_id`` keeps and drops. Only ids are shuffled,
    as partial counts; null ids are one id, as in ``dedup_by_id``. An empty table gives zeros."""
    n = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"))
    total = n.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("before"), F.count(F.lit(1)).alias("after"))
    return total.select("before", "after", (F.col("before") - F.col("after")).alias("removed"))


def prep_pool(corpus: DataFrame) -> DataFrame:
    """Train split -> unlabeled pool (id, title, text), de-duplicated by cleaned id."""
    tr = keep_long(clean_corpus(corpus.filter(F.col("split") == "train")))
    tr = tr.withColumn("id", T.clean_id("new_id"))
    return dedup_by_id(tr, "doc_id").select("id", "title", "text")


def prep_validation(corpus: DataFrame, target: str) -> DataFrame:
    """Test split -> labeled validation (title, text, label = target topic present).
    Not de-duplicated, as in the original."""
    te = keep_long(clean_corpus(corpus.filter(F.col("split") == "test")))
    return te.select("doc_id", "title", "text",
                     F.array_contains("topics_list", target).cast("int").alias("label"))
