"""SQL (DuckDB dialect) mirrors of the table bindings and text functions, for the oracle side."""

from __future__ import annotations

from ..functions import text as T
from ..sources import bind as B

WS = T.WS
NL = "chr(10)"


def lit(s: str) -> str:
    """A SQL string literal; newlines become chr(10) concatenations."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return "(" + f" || {NL} || ".join(quoted) + ")"


def clean_text(x: str) -> str:
    return (f"regexp_replace(regexp_replace(lower({x}), '[^{T.KEEP_CLASS}]', '', 'g'), "
            f"'[{WS}]+', ' ', 'g')")


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '[{WS}]+', ' ', 'g')"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def trim_sp(x: str) -> str:
    return f"trim({x}, ' ')"


def strip_wire_tag(x: str) -> str:
    no_tag = f"regexp_replace({x}, '[{WS}]+{T.WIRE_TAG}[{WS}]*$', '')"
    return f"coalesce({trim_sp(collapse(no_tag))}, '')"


def clean_headline(x: str) -> str:
    return f"coalesce({trim_sp(collapse(x))}, '')"


def clean_id(x: str) -> str:
    s = f"CAST({x} AS VARCHAR)"
    s = f"regexp_replace({s}, '^\"+|\"+$', '', 'g')"
    s = f"regexp_replace({s}, '^''+|''+$', '', 'g')"
    return strip_ws(s)


def word_count(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '[^{WS}]+')) AS INTEGER)"


def first_line(x: str) -> str:
    return f"split_part({x}, {NL}, 1)"


def truncate(x: str, n: int = T.PROMPT_MAX_CHARS) -> str:
    return f"CASE WHEN length({x}) > {n} THEN substring({x}, 1, {n}) || '{T.ELLIPSIS}' ELSE {x} END"


def parse_list(x: str) -> str:
    j = f"replace({x}, '''', '\"')"
    return (f"CASE WHEN {x} IS NOT NULL AND json_valid({j}) AND json_type({j}) = 'ARRAY' "
            f"THEN from_json({j}, '[\"VARCHAR\"]') ELSE CAST([] AS VARCHAR[]) END")


def arm_of_source(x: str = "source") -> str:
    return f"CAST(CAST(regexp_extract({x}, '[0-9]+') AS INTEGER) % 10 AS INTEGER)"


NEWS_POOL = f"""SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, {first_line('text')} AS title, text, source,
  n_chars, {arm_of_source()} AS label_cluster, CAST(n_chars % 2 AS INTEGER) AS predicted_label
FROM documents"""

POOL_NULL_TITLES = f"""SELECT id, doc_id, CASE WHEN doc_id % {B.NULL_TITLE_MOD} = 0 THEN NULL ELSE title END AS title,
  text, source, n_chars, label_cluster, predicted_label FROM ({NEWS_POOL})"""

ADS_POOL = f"""SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title,
  CASE WHEN p_partkey % {B.NULL_DESC_MOD} = 0 THEN NULL ELSE p_type END AS description FROM part"""

LABELED_POOL = f"""SELECT p.*, CAST(l.toxic AS INTEGER) AS label FROM ({NEWS_POOL}) p JOIN labels l ON p.doc_id = l.doc_id"""

RAW_NEWS = f"""SELECT d.doc_id,
  CASE WHEN d.doc_id % 4 = 0 THEN '''' || CAST(d.doc_id // 2 AS VARCHAR) || ''''
       WHEN d.doc_id % 4 = 1 THEN ' "' || CAST(d.doc_id // 2 AS VARCHAR) || '" '
       ELSE '"' || CAST(d.doc_id // 2 AS VARCHAR) || '"' END AS new_id,
  {first_line('d.text')} AS title,
  CASE WHEN d.doc_id % {B.WIRE_TAG_MOD} = 0 THEN d.text || ' Reuter' ELSE d.text END AS text,
  CASE WHEN d.doc_id % {B.JUNK_TOPIC_MOD} = 0 THEN 'junk'
       ELSE '[''' || replace(p.p_name, ' ', ''', ''') || ''']' END AS topics,
  CASE WHEN d.doc_id % {B.TEST_SPLIT_MOD} = 0 THEN 'test' ELSE 'train' END AS split
FROM documents d LEFT JOIN part p ON d.doc_id = p.p_partkey"""

CLEAN_CORPUS = f"""SELECT doc_id, new_id, {clean_headline('title')} AS title, {strip_wire_tag('text')} AS text,
  {parse_list('topics')} AS topics_list, split FROM ({RAW_NEWS})"""

KEPT_CORPUS = f"""SELECT *, {word_count('text')} AS n_words FROM ({CLEAN_CORPUS})
WHERE length(text) > 0 AND length(title) > 0 AND {word_count('text')} >= 10"""

RESULTS_LOG = f"""SELECT 'r' || CAST(event_id // {B.RESULT_BLOCK} AS VARCHAR) AS run_id,
  CAST(event_id % {B.RESULT_BLOCK} + 1 AS INTEGER) AS step, CAST(user_id % 10 AS INTEGER) AS arm,
  CASE WHEN event_type = '{B.DEAD_EVENT}' THEN NULL ELSE value / {B.METRIC_SCALE} END AS metric
FROM events"""

REWARD_ACCEPT = f"""SELECT run_id, step, arm, metric, baseline,
  CASE WHEN metric IS NULL THEN -1.0 ELSE metric - baseline END AS reward,
  (metric IS NOT NULL AND metric - baseline > 0) AS accepted
FROM (SELECT *, greatest({B.INITIAL_BASELINE}, coalesce(max(metric) OVER (PARTITION BY run_id ORDER BY step
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {B.INITIAL_BASELINE})) AS baseline
      FROM ({RESULTS_LOG}))"""

LABELED_LOG = f"""SELECT 'r' || CAST(doc_id // {B.LOG_BLOCK} AS VARCHAR) AS run_id,
  CAST(doc_id % {B.RESULT_BLOCK} + 1 AS INTEGER) AS step, label_cluster AS arm, id, title, label
FROM ({LABELED_POOL})"""
