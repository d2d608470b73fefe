"""Every stage of the pipeline on its own input by plain code, and run() as a whole."""

import zlib

import corpus_pipeline as p
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tidemark.llm import mixing, quality_model, quality_rules
from tidemark.llm.queries import tokenizer_path
from tokenizers import Tokenizer

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """Rows of each stage, in the order of the files, as run() writes and reads them."""
    folder, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, stage in p.STAGES:
        stage(spark, docs, DATA).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append(docs)
    place = [F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")]
    return [sorted((r.asDict() for r in d.select("*", *place).collect()), key=lambda r: (r["f"], r["i"])) for d in out]


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_classifier_and_rules(spark, written):
    w = quality_model.train(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    assert ids(written[1]) == sorted(r["doc_id"] for r in written[0] if quality_model.score_texts([(r["text"] or "").encode()], w.astype(np.float32))[0] >= 0.7)
    assert ids(written[2]) == sorted(r["doc_id"] for r in written[1] if quality_rules.judge((r["text"] or "").encode())[-1])
    assert 0 < len(written[2]) < len(written[1]) < len(written[0])


def test_near_duplicates_by_all_pairs(written):
    def shingles(text):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else {tuple(w)} if w else set()

    sets = {r["doc_id"]: shingles(r["text"]) for r in written[2]}
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                group[b] = a
    assert ids(written[3]) == sorted({root(i) for i in sets})


def test_mix_by_the_plain_schedule(spark, written):
    rows, block = written[3], 16
    signed = {i: spark.range(1).select(F.xxhash64(F.lit(i).cast("long"))).first()[0] for i in ids(rows)[:3]}
    assert all(signed[i] == xxhash.xxh64_intdigest(int(i).to_bytes(8, "little"), 42) - (1 << 64) * (xxhash.xxh64_intdigest(int(i).to_bytes(8, "little"), 42) >> 63) for i in signed)
    pools = {}
    for r in rows:
        pools.setdefault(r["source"], []).append(r["doc_id"])
    h = lambda i: xxhash.xxh64_intdigest(int(i).to_bytes(8, "little"), 42)
    order = {s: sorted(x, key=lambda i: (h(i) >> 52, h(i) - (1 << 64) * (h(i) >> 63), i)) for s, x in pools.items()}
    names = sorted(pools)
    part = mixing.parts({s: float(len(pools[s])) ** 0.5 for s in names})
    want = []
    for k, j, *_ in mixing.schedule([part[s] for s in names], [-(-len(pools[s]) // block) for s in names]):
        want += order[names[k]][j * block : (j + 1) * block]
    assert [r["doc_id"] for r in written[4]] == want and set(map(str, written[4][0])) == set(map(str, written[0][0]))


def test_packing_in_the_order_of_the_mix(written):
    t, flat, at = Tokenizer.from_file(tokenizer_path()), {}, 0
    for r in written[4]:
        own = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        flat[r["doc_id"]] = (at, own)
        at += len(own)
    total = 0
    for r in written[5]:
        start, own = flat[r["doc_id"]]
        assert start + r["start"] == 4096 * r["sequence_id"] + r["offset"] and r["doc_tokens"] == len(own)
        assert zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        total += r["length"]
    assert total == at


def test_run_is_its_stages(spark, written):
    strip = lambda r: tuple(v for k, v in sorted(r.items()) if k not in "fi")
    assert sorted(strip(r.asDict()) for r in p.run(spark, DATA).collect()) == sorted(strip(r) for r in written[5])


def test_empty_tables_and_clashing_columns(spark, odd, none, tmp_path):
    extra = odd.withColumns({c: F.lit("clash") for c in ("_n", "_place", "score", "kept", "label", "id", "place", "shingles")})
    for k, docs in enumerate((none, extra)):
        docs.write.parquet(str(tmp_path / str(k)))
        docs, empty = spark.read.parquet(str(tmp_path / str(k))), k == 0
        for name, stage in p.STAGES:
            out = stage(spark, docs, DATA)
            assert out.count() <= (0 if empty else 10**6), name
            if name != "packing":
                assert out.columns == docs.columns
