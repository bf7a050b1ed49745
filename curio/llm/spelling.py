"""Spelling variant grouping by asymmetric q-chunks.

Of a pair of words one edit apart, the shorter one (equal lengths: the one first in code-point order) contributes two
disjoint chunks, its halves; the longer one contributes its positional grams of those two lengths. One edit
touches one half at most, so the other half is a gram of the longer word, shifted by no more than one place (by
none when the lengths are equal). The join is on chunk length, place and gram, the grams standing at the
places that a shift within one can give; what meets is verified by edit distance. The key holds the length of
the shorter word, so words of different lengths do not meet by chance.

Words are counted with partial sums before the shuffle, so a frequent word costs a row per task. A hot gram is a
join key that Spark can split; nothing is grouped by gram. Chains of forms at least double the count at each step,
so pointer jumping ends after a few joins; each round is written to the shared folder.

Edge cases: a null text has no words, a null id counts as an empty string in the draw. Words without a near
word stand with null form and 0 near words. Equal counts are told apart by code points. Repeated rows and ids count
as often as they occur. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

#: A run of letters, A-Z already in lower case.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_typos(run: Column, doc_id: Column, one_in: int) -> Column:
    """The run, or the run without one code point where crc32 of ``<doc_id>:<run>`` is a multiple of ``one_in``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def word_counts(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", one_in: int = 97,
                min_length: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n): words of at least ``min_length`` code points that occur at least ``min_count`` times."""
    runs = df.select(F.col(id_col).alias("id"),
                     F.explode(F.regexp_extract_all(F.translate(text_or_empty(text_col), *LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.select(with_typos(F.col("run"), F.col("id"), one_in).alias("word")).where(F.char_length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b): distinct ``word`` values exactly one edit apart, a the shorter or the first one; each pair once."""
    size = F.char_length("word")
    half = F.expr("length(a) div 2")
    chunks = (words.select(F.col("word").alias("a"))
              .select("a", F.char_length("a").alias("len"),
                      F.explode(F.array(F.struct(F.lit(0).alias("at"), F.substr("a", F.lit(1), half).alias("gram")),
                                        F.struct(half.cast("int").alias("at"), F.substr("a", half + 1).alias("gram")))).alias("c"))
              .select("a", "len", "c.at", "c.gram"))
    # grams of a longer or equal word b: for a shorter word of length len its halves are len div 2 and the rest long
    lens = words.select(F.col("word").alias("b"), F.explode(F.array(size, size - 1)).alias("len"))
    slots = F.explode(F.array(*(F.struct(F.lit(s).alias("shift"), F.lit(p).alias("part")) for s in (0, 1) for p in (0, 1))))
    grams = (lens.where("len > 0").select("b", "len", slots.alias("s")).where("s.shift <= length(b) - len")
             .select("b", "len", F.expr("IF(s.part = 0, 0, len div 2)").cast("int").alias("at"),
                     F.expr("substr(b, IF(s.part = 0, 0, len div 2) + s.shift + 1, "
                            "IF(s.part = 0, len div 2, len - len div 2))").alias("gram")))
    met = chunks.join(grams, ["len", "at", "gram"]).where("(len < length(b) OR a < b) AND levenshtein(a, b, 1) = 1")
    return met.select("a", "b").distinct()


def _followed(form: DataFrame) -> DataFrame:
    """(word, root): the last word that the forms (word, form) lead to, by pointer jumping."""
    links = written(form.select("word", F.col("form").alias("root")), "spelling-links")
    while True:
        step = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = links.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        jumped = written(jumped, "spelling-links")
        if jumped.where("moved").isEmpty():
            return jumped.select("word", "root")
        links = jumped.select("word", "root")


def spelling_variants(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", one_in: int = 97,
                      min_length: int = 5, min_count: int = 3, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word with the more frequent word it is a variant of.

    ``form`` is the near word of largest n (ties: the smallest) if that n is at least ``ratio`` times the word's, else
    null; ``root`` is where following forms ends.
    """
    if ratio < 2:
        raise ValueError("forms must at least double the count, or their chains need not end")
    words = written(word_counts(df, text_col, id_col, one_in, min_length, min_count), "spelling-words")
    pairs = written(near_pairs(words), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).union(pairs.select("b", "a"))
    near = (both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
            .groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), "near")).alias("best")))
    out = (words.join(near, "word", "left")
           .withColumn("is_form", F.coalesce(-F.col("best.k") >= ratio * F.col("n"), F.lit(False)))
           .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                   F.when(F.col("is_form"), F.col("best.near")).alias("form"), F.when(F.col("is_form"), -F.col("best.k")).alias("form_n")))
    out = written(out, "spelling-forms")
    roots = _followed(out.where("form IS NOT NULL"))
    return (out.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
