"""Line-first quality rules: failing lines are removed, then documents that lose too much text are rejected."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, byte_texts, words

#: Patterns of a navigation line (the whole line) and of boilerplate (anywhere in a line), for Python's and RE2's syntax alike.
NAVIGATION = r"^\s*(home|menu|log ?in|log ?out|sign ?(in|up|out)|register|next|prev|previous|back|back to top|search|share|print|contact( us)?|about( us)?|skip to (main )?content|read more|older posts|newer posts|site ?map|faq|help)[ .:>|]*$"
BOILERPLATE = r"all rights reserved|cookie policy|accept (all )?cookies|privacy policy|terms of (use|service)|enable javascript|lorem ipsum|subscribe to our|click here|powered by|follow us on"
SYMBOLS = b"#*$%&|<>"

_NAV, _BOIL = re.compile(NAVIGATION.encode(), re.I), re.compile(BOILERPLATE.encode(), re.I)
_SENTENCE = re.compile(rb"[.,;:!?]")
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bad_lines", "text_chars", "lost_chars")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", base_failed boolean, kept boolean"


def without(text: bytes, chars: bytes) -> int:
    return len(text.translate(None, chars))


def n_chars(text: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return len(text.decode("utf-8", "replace"))


def line_fails(line: bytes, n_words: int, repeated: bool, symbol_share: float = 0.3, long_line: int = 20) -> bool:
    """Punctuation, navigation and boilerplate rules for one line that has a word."""
    symbols, shouts = len(line) - without(line, SYMBOLS), line.count(b"!")
    bars = line.count(b"|")
    return (
        repeated
        or (symbols >= 2 and symbols >= symbol_share * n_words)
        or (shouts >= 3 and shouts >= symbol_share * n_words)
        or (n_words >= long_line and not _SENTENCE.search(line))
        or (bars >= 2 and 4 * bars >= n_words)
        or (n_words <= 6 and _NAV.search(line) is not None)
        or _BOIL.search(line) is not None
    )


def repeated_words(tokens: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text has twice or more."""
    windows = list(zip(tokens, tokens[1:], tokens[2:]))
    if len(set(windows)) == len(windows):
        return 0
    count, n, end = Counter(windows), 0, 0
    for i, x in enumerate(windows):
        if count[x] > 1:
            n += i + 3 - max(end, i)
            end = i + 3
    return n


def clean_lines(text: bytes) -> tuple[list[bytes], list[int]]:
    """The lines that stay, and figures: lines with a word, repeated ones, failing ones, characters of lines with a word, those of failing ones."""
    seen, stay, f = set(), [], [0, 0, 0, 0, 0]
    for line in text.split(b"\n"):
        n = len(line.split())
        if not n:
            stay.append(line)
            continue
        again = line in seen
        seen.add(line)
        size, bad = n_chars(line), line_fails(line, n, again)
        for k, v in enumerate((1, again, bad, size, size if bad else 0)):
            f[k] += v
        if not bad:
            stay.append(line)
    return stay, f


def judge(text: bytes, max_lost: float = 0.3) -> tuple:
    """All figures of SCHEMA after doc_id."""
    tokens = words(text)
    n, repeats = len(tokens), repeated_words(tokens)
    chars = n_chars(text) - (len(text) - without(text, SPACES))
    _, (lines, dup, bad, size, lost) = clean_lines(text)
    failed = n < 50 or 100 * repeats > 50 * n
    return n, chars, len(text) - without(text, SYMBOLS), dup, repeats, lines, bad, size, lost, failed, not failed and lost <= max_lost * size


def quality_rules(docs: DataFrame, max_lost: float = 0.3) -> DataFrame:
    """One row of figures and verdicts per document (columns doc_id, text; others are ignored).

    Null and empty texts have no words, fail the base rules and aren't kept. A null doc_id stays null and
    repeated rows are judged alike, each on its own. Texts are judged whole, one at a time. No rows give no rows.
    """

    def run(batches):
        for b in batches:
            rows = [judge(t, max_lost) for t in byte_texts(b.column(1))]
            cols = list(zip(*rows)) if rows else [()] * 11
            kinds = [pa.int64()] * 9 + [pa.bool_()] * 2
            yield pa.record_batch([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", *_COUNTS, "base_failed", "kept"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def keep_clean(docs: DataFrame, max_lost: float = 0.3) -> DataFrame:
    """The documents that pass, with all their columns, rows and texts as they were."""

    def verdict(text: pa.Array) -> pa.Array:
        return pa.array([judge(t, max_lost)[-1] for t in byte_texts(text)], pa.bool_())

    return docs.where(F.arrow_udf(verdict, "boolean")(F.col("text").cast("string")))


def cleaned_texts(docs: DataFrame) -> DataFrame:
    """doc_id and the text without its failing lines; a null text stays null."""

    def clean(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else b"\n".join(clean_lines(t.encode())[0]).decode() for t in text.to_pylist()], pa.string())

    return docs.select("doc_id", F.arrow_udf(clean, "string")(F.col("text").cast("string")).alias("text"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
tri AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS x FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT rid, x FROM tri GROUP BY ALL HAVING count(*) > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM tri JOIN rep USING (rid, x), (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
l AS (SELECT rid, lines[i] AS line, i FROM (SELECT rid, string_split(t, chr(10)) AS lines, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM d)),
m AS (SELECT rid, line, length(line) AS size, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw,
  length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS ns, length(regexp_replace(line, '[^!]', '', 'g')) AS ne,
  length(regexp_replace(line, '[^|]', '', 'g')) AS nb, row_number() OVER (PARTITION BY rid, line ORDER BY i) > 1 AS again FROM l),
v AS (SELECT *, again OR (ns >= 2 AND ns >= 0.3 * nw) OR (ne >= 3 AND ne >= 0.3 * nw) OR (nw >= 20 AND NOT regexp_matches(line, '[.,;:!?]'))
  OR (nb >= 2 AND 4 * nb >= nw) OR (nw <= 6 AND regexp_matches(line, '(?i){NAVIGATION}')) OR regexp_matches(line, '(?i){BOILERPLATE}') AS bad FROM m WHERE nw > 0),
s AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (again) AS n_dup_lines, count(*) FILTER (bad) AS n_bad_lines, sum(size) AS text_chars, coalesce(sum(size) FILTER (bad), 0) AS lost_chars FROM v GROUP BY rid),
a AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
  coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_bad_lines, 0)::BIGINT AS n_bad_lines, coalesce(text_chars, 0)::BIGINT AS text_chars, coalesce(lost_chars, 0)::BIGINT AS lost_chars
  FROM d JOIN w USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN s USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND lost_chars <= 0.3 * text_chars AS kept FROM b
"""
