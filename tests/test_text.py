"""Edge fixtures of the text functions (FIXTURES.md section 3), expected values by hand."""

from pyspark.sql import functions as F

from curio.functions import text as T
from tests.conftest import one_col


def run(spark, fn, values):
    df = one_col(spark, values).withColumn("_i", F.monotonically_increasing_id())
    return [r[0] for r in df.orderBy("_i").select(fn(F.col("x"))).collect()]


def test_clean_text(spark):
    got = run(spark, T.clean_text, [
        "Hello World", "a\nb", "a b", "a b", "!!!", "", None, "  lead and trail  ",
        "eBay Store", "Café déjà", "tab\tsep", "x\x1cy"])
    assert got == ["hello world", "a b", "a b", "a b", "", "", None, " lead and trail ",
                   "ebay store", "caf dj", "tab sep", "x y"]


def test_strip_wire_tag(spark):
    got = run(spark, T.strip_wire_tag, ["Oil rose. Reuter ", "Oil rose.\tREUTER\n", "Reuter",
                                         "prices reuters", None, "a  \n b"])
    assert got == ["Oil rose.", "Oil rose.", "Reuter", "prices reuters", "", "a b"]


def test_clean_headline_and_id(spark):
    assert run(spark, T.clean_headline, ["  A   b\n c ", None]) == ["A b c", ""]
    assert run(spark, T.clean_id, ['"12"', "'12'", "\"'12'\"", '  "12"  ', ' "12" ']) == \
        ["12", "12", "12", '"12"', '"12"']


def test_parse_topics(spark):
    df = one_col(spark, ["['crude', 'nat-gas']", "[]", None, "junk", '["a\'b"]'])
    df = df.withColumn("_i", F.monotonically_increasing_id()).orderBy("_i")
    got = [r[0] for r in df.select(T.parse_list_literal("x")).collect()]
    assert got == [["crude", "nat-gas"], [], [], [], ["a'b"]]


def test_word_count(spark):
    assert run(spark, T.word_count, ["a b  c", "", "  x ", "one\ttwo\nthree"]) == [3, 0, 1, 3]


def test_truncate(spark):
    got = run(spark, T.truncate_text, ["a" * 1999, "a" * 2000, "a" * 2001])
    assert [len(x) for x in got] == [1999, 2000, 2003] and got[2].endswith("...")


def test_answer_after_marker(spark):
    got = run(spark, T.answer_after_marker, ["no marker", "x Response:\nfirst\nsecond",
                                             "a Response:\nb\nResponse:\nthird\nz", "Response:\nlast"])
    assert got == ["not a relevant animal", "first", "third", "last"]


def test_answer_first_line(spark):
    assert run(spark, T.answer_first_line, ["  relevant \n more", "\n\nonly"]) == ["relevant", "only"]


def test_label_rules(spark):
    ans = ["Relevant", "not relevant", "irrelevant", "relevant animal", "not a relevant animal"]
    assert run(spark, T.label_rule_news, ans) == [1, 0, 1, 1, 1]
    assert run(spark, T.label_rule_ads, ans) == [0, 0, 0, 1, 0]
    assert run(spark, lambda c: T.label_rule_news(c, strict=True), ans)[2] == 0


def test_title_and_desc(spark):
    df = spark.createDataFrame([("t", None), ("t", "d")], "title string, description string")
    got = [r[0] for r in df.select(T.title_and_desc("title", "description")).collect()]
    assert sorted(got) == ["t", "t. d"]


def test_whitespace_patterns_equal_the_plain_ones(spark):
    import random
    import re

    r = random.Random(5)
    ws = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0        　"
    words = ["Reuter", "reuter", "xReuter", "a", "B7", "é", "-", "​", "\U0001f600", "K"]
    texts = ["".join(r.choice(words) if r.random() < 0.5 else " " if r.random() < 0.5 else r.choice(ws) for _ in range(r.randrange(9)))
             for _ in range(600)]
    texts += ["Reuter", " Reuter", " Reuter \n", "a Reuter Reuter \x85", "aReuter ", ""]
    flat = [re.sub(f"[{ws}]+", " ", t) for t in texts]
    assert run(spark, T.collapse_ws, texts) == flat
    assert run(spark, T.word_count, texts) == [len(re.findall(f"[^{ws}]+", t)) for t in texts]
    assert run(spark, T.clean_text, texts) == [re.sub(f"[{ws}]+", " ", re.sub(f"[^a-z0-9{ws}]", "", t.lower())) for t in texts]
    bare = [re.sub(f"[{ws}]+", " ", re.sub(f"[{ws}]+reuter[{ws}]*$", "", t, flags=re.I)).strip(" ") for t in texts]
    assert run(spark, T.strip_wire_tag, texts) == bare
    assert run(spark, T.spaced_word_count, bare) == [len(t.split()) for t in bare]


def test_drop_short_counts_reads_the_words_counted_by_the_cleaner(spark):
    from curio.operators import prepare as P

    rows = [("a", "x y z", "t", 12), ("a", "x y z", "t", 3), ("b", "", "t", 12)]
    got = P.drop_short_counts(spark.createDataFrame(rows, "split string, text string, title string, n_words int"), ["split"])
    assert sorted(map(tuple, got.collect())) == [("a", 2, 1, 1), ("b", 1, 0, 1)]
