"""Scalar text functions as Spark Column expressions (JVM-side, whole-stage codegen).

Every function takes and returns a ``Column`` so it composes into one projection; none is a
Python UDF. The patterns below are spelled so that Java regex (Spark) and RE2 (the SQL oracle)
read them the same way.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------------------
# Whitespace exactly as Python's str.isspace() / re "\s" define it for text, written as a
# character-class body: \t \n \v \f \r, the four information separators \x1c-\x1f, space,
# NEL \x85, NBSP \xa0, U+1680, U+2000..U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
WS = r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Characters kept by the cleaner: ASCII letters and digits plus whitespace.
KEEP_CLASS = r"a-zA-Z0-9" + WS
# Nearly all characters of a lower-cased text, listed one by one: Java looks such a class up in one table.
PLAIN = "abcdefghijklmnopqrstuvwxyz0123456789 "
# Trailing wire-service tag of news articles (case-insensitive "reuter" after whitespace).
WIRE_TAG = r"[Rr][Ee][Uu][Tt][Ee][Rr]"
# Maximum characters of a text placed into a labeling prompt, and the ellipsis appended.
PROMPT_MAX_CHARS = 2000
ELLIPSIS = "..."
# Marker that separates echoed prompt and answer in instruction-model output.
RESPONSE_MARKER = "Response:\n"
# Answer used when instruction-model output holds no marker.
DEFAULT_NEGATIVE_ANSWER = "not a relevant animal"
# Phrases of the two labeling rules (positive phrase, negating phrase).
ADS_POSITIVE = "relevant animal"
ADS_NEGATIVE = "not a relevant animal"
NEWS_POSITIVE = "relevant"
NEWS_NEGATIVE = "not relevant"
# ---------------------------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_ws(c) -> Column:
    """Replace every run of whitespace by one space (no trim).

    A lone space is already right and is not matched, and the lookaheads dismiss a printable character by one
    range instead of all parts of the class."""
    return F.regexp_replace(_c(c), f"(?![ -~])[{WS}]+| (?![!-~])[{WS}]+", " ")


def strip_ws(c) -> Column:
    """Strip leading and trailing whitespace (Python ``str.strip()``; Spark ``trim`` only strips spaces)."""
    return F.regexp_replace(_c(c), f"^[{WS}]+|[{WS}]+$", "")


def clean_text(c) -> Column:
    """Lower-case, drop everything but ASCII letters, digits and whitespace, collapse whitespace.

    Newlines and NBSP become spaces through the collapse. No trim; NULL stays NULL.
    """
    low = F.lower(_c(c))
    kept = F.regexp_replace(low, f"([{PLAIN}]+)|[^{KEEP_CLASS}]+", "$1")  # runs of plain characters are passed over whole
    return collapse_ws(kept)


def strip_wire_tag(c) -> Column:
    """Clean a news article: drop the trailing wire tag, collapse whitespace, strip; NULL -> ''."""
    flat = F.rtrim(collapse_ws(c))  # the tag is then the last seven characters, its space included
    tagged = F.substring(flat, -7, 7).rlike(f"^ {WIRE_TAG}$")
    return F.coalesce(F.trim(F.when(tagged, F.left(flat, F.length(flat) - 7)).otherwise(flat)), F.lit(""))


def clean_headline(c) -> Column:
    """Collapse whitespace and strip; NULL -> ''."""
    return F.coalesce(F.trim(collapse_ws(c)), F.lit(""))


def clean_id(c) -> Column:
    """Strip double quotes, then single quotes, then whitespace from both ends."""
    s = _c(c).cast("string")
    s = F.regexp_replace(s, '^"+|"+$', "")
    s = F.regexp_replace(s, "^'+|'+$", "")
    return strip_ws(s)


def word_count(c) -> Column:
    """Number of whitespace-separated words (Python ``len(s.split())``)."""
    return F.regexp_count(_c(c), F.lit(f"[!-~[^{WS}]]+"))


def spaced_word_count(c) -> Column:
    """``word_count`` of a text that ``strip_wire_tag`` or ``clean_headline`` returned: one more than its spaces."""
    s = _c(c)
    return F.when(s == "", F.lit(0)).otherwise(F.length(s) - F.length(F.replace(s, F.lit(" "))) + 1)


def first_line(c) -> Column:
    return F.substring_index(_c(c), "\n", 1)


def title_and_desc(title, description) -> Column:
    """``title`` alone, or ``title. description`` when a description is present."""
    t, d = _c(title), _c(description)
    return F.when(d.isNull(), t).otherwise(F.concat(t, F.lit(". "), d))


def parse_list_literal(c) -> Column:
    """Parse a Python list literal of strings (``['a', 'b']``); NULL or junk -> empty list."""
    parsed = F.from_json(_c(c), "array<string>", {"allowSingleQuotes": "true", "mode": "PERMISSIVE"})
    return F.coalesce(parsed, F.array().cast("array<string>"))


def truncate_text(c, max_chars: int = PROMPT_MAX_CHARS) -> Column:
    s = _c(c)
    return F.when(F.length(s) > max_chars, F.concat(F.substring(s, 1, max_chars), F.lit(ELLIPSIS))).otherwise(s)


def answer_first_line(c) -> Column:
    """Strip the answer, take its first line, strip again."""
    return strip_ws(first_line(strip_ws(c)))


def answer_after_marker(c, default: str = DEFAULT_NEGATIVE_ANSWER) -> Column:
    """Third part after the response marker, else the second, else ``default``; first line of it."""
    parts = F.split(_c(c), RESPONSE_MARKER, -1)
    picked = F.coalesce(F.try_element_at(parts, F.lit(3)), F.try_element_at(parts, F.lit(2)))
    return F.coalesce(first_line(picked), F.lit(default))


def _rule(answer, positive: str, negative: str) -> Column:
    a = F.lower(strip_ws(answer))
    return (a.contains(positive) & ~a.contains(negative)).cast("int")


def label_rule_ads(answer) -> Column:
    return _rule(answer, ADS_POSITIVE, ADS_NEGATIVE)


def label_rule_news(answer, strict: bool = False) -> Column:
    """News rule. Default keeps the original substring test ("irrelevant" counts as positive)."""
    if strict:
        a = F.lower(strip_ws(answer))
        return (a.rlike(r"(^|[^a-z])relevant") & ~a.contains(NEWS_NEGATIVE)).cast("int")
    return _rule(answer, NEWS_POSITIVE, NEWS_NEGATIVE)
