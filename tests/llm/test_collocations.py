"""Collocations against plain code with small shards, steps and filters; the SQL comparison is in test_sql."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from tidemark.llm import collocations
from tidemark.llm.collocations import mine

SCHEMA = "doc_id long, text string, lang string, score long, phrase string"
LOWER = {i: i + 32 for i in range(65, 91)}


def plain(rows, least=10, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    own = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in own.items():
        if len(p) == 2 and any(100 * b >= 50 * a and p in (q[:2], q[1:]) for (other, q), b in own.items() if other == lang and len(q) == 3):
            continue
        s, _, left, right = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-s, -a, " ".join(p).encode(), left, right))
    return sorted((lang, k, p.decode(), -a, left, right, n[lang], -s) for lang, all_ in out.items() for k, (s, a, p, left, right) in enumerate(sorted(all_)[:top], 1))


def got(spark, rows, **more):
    df = mine(spark.createDataFrame(rows, SCHEMA), **more)
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


def drawn(seed, n, vocabulary=("a", "B", "c", "dé", "Éd", "x-y", " ", "1.", "the", "of", "the", "of"), langs=("en", "de", None)):
    r = random.Random(seed)
    text = lambda: "".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!?"]) for _ in range(r.randrange(60)))
    return [(i, text(), r.choice(langs), 0, "") for i in range(n)]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(collocations, "SHARD", 200)
    monkeypatch.setattr(collocations, "AT_ONCE", 50)
    monkeypatch.setattr(collocations, "RANGE", 500)


def test_many_shards(spark, small):
    rows = drawn(1, 200)
    assert got(spark, rows) == plain(rows) != []


def test_odd_rows(spark, small):
    rows = [(1, None, "en", 1, ""), (2, "", None, 1, ""), (None, " \t\n.,", "en", 1, ""), (3, "und so " * 9, None, 1, ""), (4, "und so", "und", 1, ""), (5, "aa " * 5000 + "aa aa. aa", "en", 1, "")]
    rows += [(6, "same row here", "fr", 1, "")] * 10 + [(7, "same row", "fr", 1, "")] * 11 + [(8, "z" * 70_000 + " q", "xx", 1, "")]
    assert got(spark, rows) == plain(rows) != []
    assert got(spark, []) == [] == got(spark, [(1, "one two", "en", 1, "")])


def test_ties_and_the_first_of_each_language(spark, small):
    rows = [(i, f"p{i % 40} q{i % 40}. r{i % 40} s", "en", 0, "") for i in range(400)]
    assert got(spark, rows, top=25) == plain(rows, top=25)


def test_full_filters_change_nothing(spark, small, monkeypatch):
    """Filters that let everything through cost rows, not results."""
    rows = drawn(2, 120)
    monkeypatch.setattr(collocations, "bloom", lambda keys: np.full(8, 255, np.uint8))
    assert got(spark, rows) == plain(rows) != []


def test_long_texts_are_cut_at_pieces():
    text = b"one two three. four five, six" * 50 + b" seven" * 40
    parts = list(collocations.parts_of(text, limit=100))
    assert b"".join(parts) == text and len(parts) > 5 and all(p[-1:] in (b".", b",") for p in parts[:-1])
    assert list(collocations.parts_of(b"x" * 1000, limit=10)) == [b"x" * 1000]


def test_colliding_hashes_take_another_seed(spark, small, monkeypatch):
    """Under the first seed all words have one hash."""
    real = collocations.F.xxhash64
    one = collocations.F.lit(1).cast("long")
    monkeypatch.setattr(collocations.F, "xxhash64", lambda *cols: collocations.F.when(cols[0] == 0, one).otherwise(real(*cols)) if len(cols) == 2 else real(*cols))
    rows = drawn(3, 100)
    words, seed = collocations.dictionary(collocations.shards(spark.createDataFrame(rows, SCHEMA)))
    assert seed == 1
    assert got(spark, rows) == plain(rows) != []


def test_filters_do_not_pass_the_driver(spark, small, monkeypatch):
    """The driver gets a row at most at a time and broadcasts nothing, whether filters have one part or many."""

    def few(df, collect=type(spark.range(0)).collect):
        assert len(rows := collect(df)) <= 1
        return rows

    def refused(*_, **__):
        raise AssertionError("passes the driver")

    rows = drawn(4, 150)
    for part in (1 << 20, 1 << 10):
        with monkeypatch.context() as m:
            m.setattr(collocations, "PART", part)
            m.setattr(type(spark.range(0)), "collect", few)
            m.setattr(type(spark.range(0)), "toPandas", refused)
            m.setattr(type(spark.sparkContext), "broadcast", refused)
            found = mine(spark.createDataFrame(rows, SCHEMA))
        assert sorted(tuple(r) for r in found.collect()) == plain(rows) != []


def test_filter_of_many_parts(spark, monkeypatch):
    monkeypatch.setattr(collocations, "PART", 1 << 12)
    keys = spark.range(20_000).selectExpr("xxhash64(id) AS key")
    made = collocations.Bloom(collocations.bloom(keys))
    known = np.array([r["key"] for r in keys.collect()]).view(np.uint64)
    assert len(made.bits) * 8 == 1 << 19 and made.has(known).all() and made.has(collocations.mix(known)).mean() < 0.02
    assert not collocations.Bloom(collocations.bloom(keys.where("key is null"))).bits.any()
