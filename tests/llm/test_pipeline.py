"""The corpus pipeline against a brute-force version, and the registered queries' schemas."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from curio.llm import toxicity as tox
from curio.llm.queries import model_path, toxicity_rest
from tests.llm.test_operators import plain_fingerprint, roots_of, shingles
from tests.llm.util import awkward, key, prose, tables


def planted():
    rows = [(i, t) for i, t in awkward()]
    rows += [(1000 + k, prose(500 + k, 60) + (" vile rotten" if k % 3 == 0 else "")) for k in range(240)]
    item = prose(900, 30)
    rows += [(2000, prose(901, 50) + "\n" + item + "\n" + prose(902, 50)), (2001, rows[-1][1]), (2002, rows[-2][1] + " more")]
    labels = [(1000 + k, 1, int(k % 3 == 0)) for k in range(200)]
    return rows, [(1, item), (2, prose(903, 20))], labels


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows, items, labels = planted()
    return tables(spark, tmp_path_factory.mktemp("tables"), rows, items, labels), rows, items, labels


def test_pipeline(spark, made):
    path, rows, items, labels = made
    docs = spark.read.parquet(f"{path}/documents.parquet")
    lab = spark.read.parquet(f"{path}/labels.parquet")
    model = tox.train(docs, lab, use=toxicity_rest() != 1)
    toxic = {(r["doc_id"], r["text"]) for r in tox.score(docs, model, score_col="s").where("s >= 0.7").collect()}
    assert all("vile" in (t or "") for _, t in toxic) and len(toxic) >= 70
    left = [r for r in rows if r not in toxic]
    best = {}
    for i, t in left:
        best[t or ""] = max(best.get(t or "", (False, None)), key(i))
    left = [(i[1], t) for t, i in best.items()]
    fps = [plain_fingerprint(t) for _, t in left]
    groups = defaultdict(list)
    for r, c in zip(left, roots_of(fps)):
        groups[c].append(r)
    left = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    bad = set()
    for i, t in left:
        if i is not None and any(q and len(q & shingles(t)) / len(q) >= 0.8 for q in (shingles(x) for _, x in items)):
            bad.add(i)
    left = [r for r in left if r[0] not in bad]
    assert 2000 in bad
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path("piece_bpe_32k.model"))
    want = Counter()
    for i, t in left:
        ids = sp.encode(t, add_bos=True, add_eos=True)
        raw = np.array(ids, dtype="<u4").tobytes()
        want[i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest(), raw] += 1
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], bytes(r["ids"])) for r in corpus_pipeline.run(spark, path).collect())
    assert got == want


def test_stages_keep_the_columns(spark, made):
    docs = spark.read.parquet(f"{made[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, made[0]).columns == docs.columns


def test_decontamination_stage_goes_by_row(spark, tmp_path):
    """Null and shared ids on both sides: contaminated rows go, clean rows stay, pieces of two texts are no item."""
    null_item, one, two, split = (prose(950 + k, 30) for k in range(4))
    halves = split.split()
    rows = [(None, f"{prose(960, 20)} {null_item} {prose(961, 20)}"), (None, prose(962, 50)),
            (7, f"{one} {prose(963, 20)}"), (7, prose(964, 50)), (7, prose(965, 50)),
            (8, f"{prose(966, 20)} {two}"), (9, " ".join(halves[:17])), (9, " ".join(halves[13:])), (10, None), (11, null_item)]
    # two different texts share an id; two items have none
    path = tables(spark, tmp_path / "t", rows, [(None, null_item), (1, one), (1, two), (None, split), (2, None)])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    left = corpus_pipeline.decontaminate(spark, docs, path)
    assert left.columns == docs.columns
    want = [rows[k] for k in (1, 3, 4, 6, 7, 8)]
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter(want)


def test_empty_tables(spark, tmp_path):
    path = tables(spark, tmp_path / "t", [])
    assert corpus_pipeline.run(spark, path).count() == 0
    for name, f in entry.queries().items():
        if name.startswith("op"):
            assert f(spark, path).count() == 0, name


COLUMNS = {
    "op1": "doc_id keep_id group_size kept text_sha256", "op2": "doc_id size text_crc32 law shard slot grown_shard",
    "op3": "doc_id n_tokens ids_sha256 decoded_sha256", "op4": "doc_id start n_tokens ids_crc32",
    "op5": "doc_id n_words n_removed kept_sha256", "op6": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op7": "doc_id held_out score predicted", "op8": "item_id doc_id n_item n_found containment",
    "op9": "doc_id n_lines n_removed kept_sha256", "op10": "doc_id fingerprint component_id",
}


@pytest.mark.parametrize("op", COLUMNS)
def test_contract(spark, made, op):
    path, rows, _, _ = made
    name, = (q for q in entry.queries() if q.split("_")[0] == op)
    df = entry.queries()[name](spark, path)
    assert df.columns == COLUMNS[op].split()
    if op != "op8":
        got = df.collect()
        assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
        if op == "op7":
            held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1 for i, _ in rows}
            assert all(r["held_out"] == held[r["doc_id"]] and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got)


def test_stages_keep_columns_of_clashing_names(spark, made):
    docs = spark.read.parquet(f"{made[0]}/documents.parquet")
    odd = ("_place", "_PLACE_", "_score", "_scored_text", "_doc_row", "_row_key")
    more = docs.selectExpr("*", *[f"'kept' AS {c}" for c in odd])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, more, made[0])
        assert out.columns == more.columns
        assert out.where("_place = 'kept' AND _score = 'kept' AND _doc_row = 'kept'").count() == stage(spark, docs, made[0]).count() > 0
