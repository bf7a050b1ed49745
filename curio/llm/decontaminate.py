"""Benchmark decontamination by size-partitioned MinHash containment search (DataFrame functions only).

Words are runs of letters and digits, lower-cased; an item's set holds its distinct five-word
shingles (a text of fewer words has one, the whole). Items are partitioned by the size of that set
(powers of two). Within a partition an item's sketch is its k smallest shingle hashes, with
k = floor((1 - t) * upper size) + 1. A document that holds a share t of an item's m shingles lacks
at most floor((1 - t) * m) of them, so it holds at least k - floor((1 - t) * m) >= 1 of the sketch:
the search loses no pair. The size partition sets the sketch's length only; documents are not cut by size.

Documents are exploded into shingle hashes and joined with the sketches, a table of a few rows per
item whose written size Spark checks before it broadcasts it (else both sides are shuffled).
Pairs with enough sketch hits are verified by exact containment: the document's shingle strings are intersected with
the item's within the row, so no task meets all rows of a frequent shingle.

Edge cases: null and empty texts have no shingles and never match. In ``contained_items`` and
``decontaminate`` rows that share an id count as one text's shingles together, and rows with a null id
are passed over. ``decontaminate_rows`` takes every row of both tables as a text of its own, whatever
its id. Empty tables give no pairs. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, text_or_empty, with_row_key, written

SHINGLE = 5
THRESHOLD = 0.8
#: Runs of other characters part the words.
NOT_WORD = r"[^\p{L}\p{N}]+"


def words(text_col: str) -> Column:
    return F.array_remove(F.split(F.lower(text_or_empty(text_col)), NOT_WORD), "")


def shingle_structs(w: Column) -> Column:
    """The shingles of an array of words, as structs w0..w4 (fewer words: one, the whole)."""
    n = F.size(w)
    many = F.arrays_zip(*[F.slice(w, F.lit(i + 1), F.greatest(n - (SHINGLE - 1), F.lit(0))).alias(f"w{i}")
                          for i in range(SHINGLE)])
    one = F.array(F.struct(*[F.get(w, F.lit(i)).alias(f"w{i}") for i in range(SHINGLE)]))
    return F.when(n >= SHINGLE, many).otherwise(one)


def shingle_rows(df: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """``keep`` and the five words of each shingle as w0..w4."""
    w = df.select(*keep, words(text_col).alias("_w")).where(F.size("_w") > 0)
    return w.select(*keep, F.inline(shingle_structs(F.col("_w"))).alias(*[f"w{i}" for i in range(SHINGLE)]))


def shingle_array(text_col: str) -> Column:
    """The shingle strings of a text that has words."""
    return F.transform(shingle_structs(words(text_col)), lambda s: F.concat_ws(" ", *[s[f"w{i}"] for i in range(SHINGLE)]))


def shingle_hash() -> Column:
    return F.xxhash64(*[f"w{i}" for i in range(SHINGLE)])


def shingle_text() -> Column:
    return F.concat_ws(" ", *[f"w{i}" for i in range(SHINGLE)])


def item_sketches(items: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(item shingles with their number m, sketch rows: h, item, m, need)."""
    sh = (shingle_rows(items, ["_item"], "_text").select("_item", shingle_text().alias("sh"), shingle_hash().alias("h"))
          .distinct())
    m = sh.groupBy("_item").agg(F.count("*").alias("m"))
    sh = written(sh.join(m, "_item"), "op8-items")
    lack = lambda c: F.floor(c * (1.0 - threshold) + 1e-9)
    upper = F.pow(F.lit(2.0), F.ceil(F.log2("m")))  # the size partition's upper bound
    k = F.least(lack(upper) + 1, F.col("m"))
    ranked = sh.withColumn("rank", F.row_number().over(Window.partitionBy("_item").orderBy("h", "sh")))
    sketch = ranked.where(F.col("rank") <= k).select("h", "_item", "m", (k - lack(F.col("m"))).alias("need"))
    return sh, written(sketch, "op8-sketch")


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id",
                    item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, doc, n_item, n_found, containment) for every pair at ``threshold`` or more."""
    d = docs.select(F.col(doc_id).alias("_doc"), F.col(text_col).alias("_text")).where(F.col("_doc").isNotNull())
    i = items.select(F.col(item_id).alias("_item"), F.col(text_col).alias("_text")).where(F.col("_item").isNotNull())
    shingles, sketch = item_sketches(i, threshold)
    hits = (shingle_rows(d, ["_doc"], "_text").select("_doc", shingle_hash().alias("h"))
            .join(sketch, "h").select("_item", "_doc", "need", "h").distinct()
            .groupBy("_item", "_doc", "need").agg(F.count("*").alias("hits")))
    pairs = written(hits.where(F.col("hits") >= F.col("need")).select("_item", "_doc"), "op8-candidates")
    # exact check: each candidate's whole text against the item's shingle strings, within the row
    sets = shingles.groupBy("_item", "m").agg(F.collect_set("sh").alias("_set"))  # one item's text each
    found = (d.join(pairs, "_doc").join(sets, "_item")
             .select("_item", "_doc", "m", F.explode(F.array_intersect(shingle_array("_text"), F.col("_set"))).alias("sh")).distinct()
             .groupBy("_item", "_doc", "m").agg(F.count("*").alias("n_found")))
    share = F.col("n_found") / F.col("m")
    return (found.where(share >= threshold)
            .select(F.col("_item").alias(item_id), F.col("_doc").alias(doc_id), F.col("m").alias("n_item"), "n_found",
                    share.alias("containment")))


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id",
                  item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """The documents that contain no item, told apart by id; all columns stay."""
    bad = contained_items(docs, items, threshold, doc_id, item_id, text_col)
    bad = written(bad.select(doc_id).distinct(), "op8-bad")
    return docs.join(bad, doc_id, "left_anti").select(*docs.columns)


def decontaminate_rows(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD,
                       text_col: str = "text") -> DataFrame:
    """The document rows that contain no item row, whatever their ids; all columns stay."""
    doc_row, item_row = free_name(docs, "_doc_row"), free_name(items.select(text_col), "_item_row")
    keyed, rows = with_row_key(docs, doc_row), with_row_key(items.select(text_col), item_row)
    return decontaminate(keyed, rows, threshold, doc_row, item_row, text_col).select(*docs.columns)
