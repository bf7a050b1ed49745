"""Labeling: prompt tables, answer extraction, label rules, stored-label reuse, labelers.

A labeler is any function ``pandas.DataFrame -> pandas.DataFrame`` adding an ``answer``
column; it runs through ``mapInPandas`` (Arrow batches, model loaded once per task). Two
labelers ship: the stored label table (a join, no Python) and a keyword rule.
"""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import text as T

# --- fixed values: prompt templates (our wording; the slot is the item text) -----------------
PROMPTS = {
    ("instruct", "*"): ("### Instruction: Decide whether the item below matches the target class. "
                        "Answer with the label only.\n### Input:\n", "\n### Response:\n"),
    ("chat", "*"): ("Label the advertisement below. Answer 'relevant animal' only when the product "
                    "is made from shark, ray or chimaera; otherwise answer 'not a relevant animal'.\n"
                    "Advertisement: ", "\nLabel:"),
    ("hf", "ads"): ("Label the advertisement below. Answer 'relevant animal' when what is on sale comes "
                    "from the body of a creature that once lived; answer 'not a relevant animal' when a creature "
                    "is only shown, copied or named.\n"
                    "Advertisement: ", "\nLabel:"),
    ("hf", "news"): ("Label the news article below. Answer 'relevant' when petroleum as a business is its "
                     "chief subject; answer 'not relevant' when it is mentioned in passing or not at all.\nArticle: ", "\nLabel:"),
}
# ---------------------------------------------------------------------------------------------


def template(labeler: str, dataset: str) -> tuple[str, str] | None:
    return PROMPTS.get((labeler, dataset)) or PROMPTS.get((labeler, "*"))


def prompt_expr(labeler_col, dataset_col, body) -> F.Column:
    """Prompt chosen per row from the (labeler, dataset) pair; NULL for an unknown labeler."""
    lab, ds = F.col(labeler_col), F.col(dataset_col)
    expr = None
    for (l, d), (pre, suf) in PROMPTS.items():
        cond = (lab == l) if d == "*" else ((lab == l) & (ds == d))
        val = F.concat(F.lit(pre), body, F.lit(suf))
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr.otherwise(F.lit(None).cast("string"))


def build_prompts(sample: DataFrame, labeler: str, dataset: str, text_col: str,
                  max_chars: int | None = None) -> DataFrame:
    """Inference table (id, title, training_text, text = prompt of the item text).
    The whole text goes in unless the caller sets ``max_chars``."""
    pre, suf = template(labeler, dataset) or (None, None)
    body = T.truncate_text(text_col, max_chars) if max_chars else F.col(text_col)
    prompt = F.concat(F.lit(pre), body, F.lit(suf)) if pre is not None else F.lit(None).cast("string")
    return sample.select("id", "title", F.col("clean_title").alias("training_text"), prompt.alias("text"))


def label_from_answer(df: DataFrame, dataset: str, answer_col: str = "answer") -> DataFrame:
    a = T.strip_ws(answer_col)
    rule = T.label_rule_news(a) if dataset == "news" else T.label_rule_ads(a)
    return df.withColumn(answer_col, a).withColumn("label", rule)


def one_label_per_id(stored: DataFrame, id_col: str = "id", order_col: str | None = None) -> DataFrame:
    """One stored label per id: the first by ``order_col``, else the smallest label."""
    first = F.min_by("label", order_col) if order_col else F.min("label")
    return stored.groupBy(id_col).agg(first.alias("label"))


def label_from_table(sample: DataFrame, labels: DataFrame, id_col: str = "id") -> DataFrame:
    """Labels supplied with the data: inner join on id (only labeled rows can train)."""
    return sample.join(one_label_per_id(labels, id_col), id_col, "inner")


def reuse_labels(sample: DataFrame, stored: DataFrame, id_col: str = "id") -> DataFrame:
    """Left join stored labels; ``label`` NULL marks a row the labeler still has to answer."""
    return sample.join(one_label_per_id(stored, id_col).select(id_col, F.col("label").alias("stored_label")), id_col, "left") \
        .withColumn("label", F.col("stored_label")).drop("stored_label")


def label_or_ask(sample: DataFrame, stored: DataFrame, dataset: str, labeler: Callable[[pd.DataFrame], pd.DataFrame],
                 text_col: str = "title", template_of: str = "hf", max_chars: int | None = None) -> DataFrame:
    """Every sampled row with a label: the stored one, else the labeler's answer to its prompt.

    One row per sampled row; only rows without a stored label reach the labeler. An id sampled
    twice keeps both rows and gets one label."""
    reused = reuse_labels(sample, stored)
    todo = reused.filter(F.col("label").isNull()).drop("label")
    asked = apply_labeler(build_prompts(todo, template_of, dataset, text_col, max_chars), labeler)
    answers = one_label_per_id(label_from_answer(asked, dataset))
    return reused.filter(F.col("label").isNotNull()).unionByName(todo.join(answers, "id"))


def needs_label(sample: DataFrame, stored: DataFrame, id_col: str = "id") -> DataFrame:
    return sample.join(stored.select(id_col), id_col, "left_anti")


def keyword_labeler(keywords: list[str], positive: str, negative: str,
                    column: str = "training_text") -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A stand-in labeler for offline runs: answers ``positive`` when any keyword occurs in the
    item's text (``column``; the prompt itself also holds the template's words)."""
    kws = [k.lower() for k in keywords]

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        low = pdf[column].fillna("").str.lower()
        hit = pd.Series(False, index=pdf.index)
        for k in kws:
            hit |= low.str.contains(k, regex=False)
        return pdf.assign(answer=hit.map({True: positive, False: negative}))
    return f


def apply_labeler(prompts: DataFrame, labeler: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Run a user labeler on Arrow batches; output = input columns + ``answer``."""
    # a new StructType: ``DataFrame.schema`` is cached and ``StructType.add`` mutates in place
    schema = ST.StructType(list(prompts.schema.fields) + [ST.StructField("answer", ST.StringType(), True)])

    def run(batches):
        for pdf in batches:
            yield labeler(pdf)[schema.fieldNames()]
    return prompts.mapInPandas(run, schema)
