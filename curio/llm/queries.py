"""Registered queries of the training-data operators, with oracle SQL where SQL can state the result.

Each query is thin: it applies one operator with production parameters to its whole table and
derives the digest columns from the operator's real output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations as col
from . import decontaminate as dc
from . import exact_dedup as ed
from . import line_dedup as ld
from . import lm
from . import mixing as mix
from . import records as rec
from . import sentencepieces as sp
from . import sharding as sh
from . import simhash as sim
from . import spelling as spell
from . import substring_dedup as ss
from . import toxicity as tox
from .common import read_table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def model_path(name: str) -> str:
    """Where the installed public tokenizer of that name lies."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


def sha(c: str):
    return F.sha2(F.col(c).cast("binary"), 256)


@query("op1_exact_dedup", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ed.exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SHARDS, SEED = 40, 2024


@query("op2_shard_feistel")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (sh.shard_rows(documents(spark, sf_dir), shards=SHARDS, seed=SEED)
            .select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"))


SHINGLED = """
  SELECT {id}, unnest(CASE WHEN len(w) >= 5
      THEN list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' '))
      ELSE [array_to_string(w, ' ')] END) AS sh
  FROM (SELECT {id}, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w
        FROM {t}) WHERE len(w) > 0"""


@query("op8_decontaminate", f"""
WITH i AS (SELECT DISTINCT * FROM ({SHINGLED.format(id="item_id", t="benchmark")})),
m AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
d AS (SELECT DISTINCT * FROM ({SHINGLED.format(id="doc_id", t="documents")})),
f AS (SELECT i.item_id, d.doc_id, count(*) AS n_found FROM i JOIN d ON i.sh = d.sh GROUP BY i.item_id, d.doc_id)
SELECT f.item_id, f.doc_id, m.n_item, f.n_found, f.n_found / m.n_item AS containment
FROM f JOIN m ON f.item_id = m.item_id WHERE f.n_found / m.n_item >= 0.8""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.contained_items(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


@query("op9_line_windows", """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (SELECT doc_id, unnest(range(len(l) - 2)) AS pos, unnest(list_transform(range(len(l) - 2),
        lambda i: array_to_string(l[i + 1 : i + 3], chr(10)))) AS win FROM l WHERE len(l) >= 3),
later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS k FROM w)
          WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS line FROM later),
lines AS (SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS t FROM l),
kept AS (SELECT lines.doc_id, string_agg(lines.t, chr(10) ORDER BY lines.line) AS t, count(*) AS n
         FROM lines LEFT JOIN gone ON lines.doc_id = gone.doc_id AND lines.line = gone.line
         WHERE gone.line IS NULL GROUP BY lines.doc_id)
SELECT l.doc_id, CAST(len(l.l) AS INTEGER) AS n_lines, CAST(len(l.l) - coalesce(kept.n, 0) AS INTEGER) AS n_removed,
  sha256(coalesce(kept.t, '')) AS kept_sha256
FROM l LEFT JOIN kept ON l.doc_id = kept.doc_id""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (ld.dedup_lines(documents(spark, sf_dir))
            .select("doc_id", "n_lines", "n_removed", sha("text").alias("kept_sha256")))


@query("op3_sentencepiece")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    enc = sp.encode_texts(documents(spark, sf_dir), model_path("piece_bpe_32k.model"))
    return enc.select("doc_id", "n_tokens", sha("ids").alias("ids_sha256"), sha("decoded").alias("decoded_sha256"))


@query("op4_token_records")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = rec.records_folder(spark)
    rec.write_records(documents(spark, sf_dir), model_path("byte_bpe_50k.json"), root)
    return rec.read_records(spark, root).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op10_simhash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sim.simhash_components(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


@query("op6_ppm_score")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(documents(spark, sf_dir))


TOXIC_AT = 0.7


def toxicity_rest():
    """crc32(doc_id as text) mod 3; remainder 1 is held out."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rest = toxicity_rest()
    model = tox.train(docs, read_table(spark, sf_dir, "labels"), use=rest != 1)
    return tox.score(docs, model).select("doc_id", (rest == 1).alias("held_out"), "score",
                                         (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


@query("op5_substring_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", sha("text").alias("kept_sha256"))


#: crc32 as a byte fold over the UTF-8 bytes of ``word`` (code points up to U+00FF), in DuckDB.
CRC_TABLE = "list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)))"
UTF8 = ("flatten(list_transform(string_split({s}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] "
        "ELSE [(192 | (unicode(x) >> 6))::BIGINT, (128 | (unicode(x) & 63))::BIGINT] END))")


@query("op11_spelling_variants", f"""
WITH k AS MATERIALIZED (SELECT {CRC_TABLE} AS t),
runs AS MATERIALIZED (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents) GROUP BY ALL),
h AS MATERIALIZED (SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, {UTF8.format(s="coalesce(doc_id::VARCHAR, '') || ':' || run")}),
    lambda a, b: xor(a >> 8, k.t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS h FROM runs, k),
w AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM (SELECT c, CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
    ELSE run END AS word FROM h) WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
del AS MATERIALIZED (SELECT word, i, left(word, i::INT) || substr(word, i::INT + 2) AS d FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
p AS (SELECT a.word, b.word AS near FROM del a JOIN del b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT del.word, w.word FROM del JOIN w ON del.d = w.word UNION SELECT w.word, del.word FROM del JOIN w ON del.d = w.word),
best AS (SELECT p.word, count(*) AS n_near, arg_min(struct_pack(near := p.near, n := w.n), struct_pack(k := -w.n, near := p.near)) AS b
  FROM p JOIN w ON p.near = w.word GROUP BY p.word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 2 * w.n THEN b.near END AS form,
  CASE WHEN b.n >= 2 * w.n THEN b.n END AS form_n FROM w LEFT JOIN best ON w.word = best.word),
chain AS (WITH RECURSIVE c AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON c.at = f.word WHERE f.form IS NOT NULL)
  SELECT c.word, c.at AS root FROM c JOIN f ON c.at = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, chain.root, f.n, f.n_near, f.form_n FROM f JOIN chain ON f.word = chain.word""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spell.spelling_variants(documents(spark, sf_dir))


@query("op12_mix_sources")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix_sources(documents(spark, sf_dir), seed=SEED)


@query("op13_collocations", """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM p),
g AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM (SELECT lang, m, unnest(list_transform(range(len(w) - m + 1),
    lambda i: array_to_string(w[i + 1 : i + m], ' '))) AS phrase FROM w, range(1, 6) r(m) WHERE len(w) >= m) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE m = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE m >= 2 AND f >= 100),
inner_ AS (SELECT lang, phrase, max(a) AS around FROM (SELECT lang, a, unnest(flatten(list_transform(range(2, m), lambda k:
    list_transform(range(m - k + 1), lambda i: array_to_string(w[i + 1 : i + k], ' '))))) AS phrase FROM c WHERE m >= 3) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inner_ i ON c.lang = i.lang AND c.phrase = i.phrase WHERE around IS NULL OR 100 * around < 100 * a),
cut AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1 :], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)),
s AS (SELECT cut.lang, cut.phrase, cut.a, k, gx.f AS l, gy.f AS r, n, ((1000::HUGEINT * a * n) // (gx.f::HUGEINT * gy.f))::BIGINT AS score
  FROM cut JOIN g gx ON cut.lang = gx.lang AND cut.x = gx.phrase JOIN g gy ON cut.lang = gy.lang AND cut.y = gy.phrase JOIN n ON n.lang = cut.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b QUALIFY rank <= 2000""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return col.collocations(documents(spark, sf_dir))
