"""The index for quotes: nothing missed, whole texts, time in proportion to the text."""

import random
import time

import numpy as np
from pyspark.sql import functions as F
from tidemark.functions import text, winnow


def test_every_quote_of_twelve_bytes_shares_its_fingerprints():
    r = random.Random(1)
    for _ in range(60):
        t = bytes(r.choice(b"ab c") for _ in range(r.randrange(12, 200)))
        a = r.randrange(len(t) - 11)
        q = t[a : a + r.randrange(12, 40)]
        own, held = set(winnow.fingerprints([q], 12)[1].tolist()), set(winnow.fingerprints([b"", t, b"xy"], 12)[1].tolist())
        assert own and own <= held


def test_short_and_empty_texts_have_none():
    row, g = winnow.fingerprints([b"", b"elevenbytes", b"twelve bytes", b"x"], 12)
    assert row.tolist() == [2] and len(g) == 1 and len(winnow.fingerprints([], 12)[0]) == 0


def test_long_texts_are_indexed_in_parts(monkeypatch):
    r = random.Random(2)
    t = bytes(r.randrange(97, 123) for _ in range(5000))
    whole = set(winnow.fingerprints([t], 12)[1].tolist())
    monkeypatch.setattr(winnow, "AT_ONCE", 64)
    found = set()
    for rows, group in winnow.parts([b"short text of its own", t], 12):
        number, g = winnow.fingerprints(group, 12)
        found |= {x for i, x in zip(number, g.tolist()) if rows[i] == 1}
    assert found == whole


def test_quotes_against_plain_search(spark):
    r = random.Random(3)
    words = ["alpha", "beta", "gam", "Ünïted", "of", "the", "12 table of contents", "ß"]
    texts = [(i, None if i == 5 else " ".join(r.choice(words) for _ in range(r.randrange(120)))) for i in range(150)]
    quotes = [(j, None if j == 3 else " ".join(r.choice(words) for _ in range(r.randrange(1, 6)))) for j in range(60)]
    quotes += [(60 + k, t[k : k + 14].upper()) for k, (_, t) in enumerate(x for x in texts if x[1] and len(x[1]) > 60)]
    d, q = spark.createDataFrame(texts, "k int, text string"), spark.createDataFrame(quotes, "q int, text string")
    form = lambda df: {x[0]: x[1] for x in df.select(df.columns[0], text.grounding_form(F.col("text"))).collect()}
    dt, qt = form(d), form(q)
    want = sorted((k, j) for k, t in dt.items() for j, x in qt.items() if t is not None and x is not None and len(x) >= 12 and x in t)
    assert sorted(tuple(x) for x in text.grounded_quotes(d, "k", q, "q").collect()) == want and len(want) > 100
    assert text.grounded_quotes(d.limit(0), "k", q, "q").count() == 0 == text.grounded_quotes(d, "k", q.limit(0), "q").count()


def test_time_grows_with_the_text_alone():
    r = np.random.default_rng(4)

    def took(n):
        data = r.integers(97, 123, n, np.uint8).tobytes()
        began = time.process_time()
        for _, group in winnow.parts([data], 12):
            winnow.fingerprints(group, 12)
        return time.process_time() - began

    took(1 << 20)
    assert took(1 << 24) < 3.5 * took(1 << 23) + 0.2


def test_excerpt_ends_at_whole_characters(spark):
    texts = ["x" * n + c * 60 for n in range(150, 160) for c in ("é", "€", "😀", "y", " é")] + ["", "€" * 66, "€" * 67, None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("t", text.excerpt(F.col("t")).alias("e")).collect()
    for t, e in rows:
        if t is None or len(t.encode()) <= 200:
            assert e == t
            continue
        head = t.encode()[:200].decode(errors="ignore")
        assert e == (head.rpartition(" ")[0] or head) + "…"
