"""Plan-shape guards for the scale properties the README claims."""

import __spark_entry__ as E
from curio.operators import prepare as P
from curio.sources import bind as B
from tests.conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cleaning_runs_once_despite_filters(spark):
    p = plan(P.keep_long(P.clean_corpus(B.raw_news(spark, SF_SMALL))))
    above, below = p.split("Generate inline", 1)
    assert "Filter" in above and "[Rr][Ee][Uu][Tt][Ee][Rr]" not in above   # filter reads computed columns
    assert "[Rr][Ee][Uu][Tt][Ee][Rr]" in below       # cleaning happens once, in one projection


def test_quota_samplers_cut_groups_map_side(spark):
    q = E.queries()
    for name in ("stratified_sample", "stratified_posneg_sample", "positive_stratified_sample"):
        p = plan(q[name](spark, SF_SMALL))
        assert "WindowGroupLimit" in p and "Partial" in p, name
    assert "TakeOrderedAndProject" in plan(q["sample_from_arm"](spark, SF_SMALL))


def test_scans_read_only_needed_columns(spark):
    p = plan(E.queries()["cluster_sizes"](spark, SF_SMALL))
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in p or "ReadSchema: struct<source:string>" in p
