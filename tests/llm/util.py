"""Small fixtures for the training-data operators: awkward rows and a Parquet table of them."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _t string, best int"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def awkward() -> list[tuple]:
    """(doc_id, text): nulls, empty, blank, one word, repeats, ties, a very long text, odd characters."""
    passage = prose(1, 60)
    rows = [
        (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one"), (6, "One"), (7, "a b"),
        (10, prose(2, 50) + " " + passage + " " + prose(3, 30)), (11, prose(4, 20) + "\n" + passage + "\n" + prose(5, 40)),
        (12, passage), (13, prose(6, 200)), (14, prose(6, 200)), (15, prose(6, 200) + " tail"),
        (16, "same line\nsame line\nsame line\nsame line"), (17, "x\ny\nz\nw\nx\ny\nz"), (18, "x\ny\nz"), (19, "\n\n\n\n"),
        (20, "r " * 100), (21, prose(7, 30000)), (22, "naïve café ▁ 日本   \u0085 é<s></s> <|endoftext|> end"),
        (23, "tail\rcarriage\x0bvertical\x0cfeed"), (None, prose(8, 80)), (None, prose(8, 80)), (25, prose(9, 40)), (25, prose(10, 40)),
        (26, prose(11, 45)), (26, prose(11, 45)), (27, prose(11, 45)),
    ]
    return rows


def frame(spark, rows):
    """The rows as documents with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), 0.5, "extra", 1) for i, t in rows], SCHEMA)


def tables(spark, path, rows, benchmark=(), labels=()):
    """A folder of Parquet tables documents, benchmark and labels."""
    frame(spark, rows).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def key(v):
    """Sortable form of a value that may be null."""
    return (v is not None, v)
