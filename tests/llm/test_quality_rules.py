from pyspark.sql import functions as F
from tidemark.llm import quality_rules as q

GOOD = "\n".join(f"line{i} has{i} words{i}, and{i} it{i} ends{i} as{i} a{i} sentence{i}." for i in range(8))


def test_texts_without_their_failing_lines(spark, none):
    text = GOOD + "\nHome\n| a | b | c |\nAll rights reserved\n\nThe end, truly."
    rows = [(1, text), (2, None), (3, ""), (None, "Menu\nkept line, here."), (4, GOOD + "\n" + GOOD)]
    got = {r["doc_id"]: r["text"] for r in q.cleaned_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: GOOD + "\n\nThe end, truly.", 2: None, 3: "", None: "kept line, here.", 4: GOOD}
    assert q.cleaned_texts(none).count() == 0


def test_keep_clean_gives_the_verdicts_of_the_query_and_all_columns(spark, docs, odd, none):
    for rows in (docs, odd.withColumn("kept", F.lit("clash"))):
        want = sorted(str(r["doc_id"]) for r in q.quality_rules(rows).where("kept").collect())
        out = q.keep_clean(rows)
        assert sorted(str(r["doc_id"]) for r in out.collect()) == want and out.columns == rows.columns
    assert q.keep_clean(none).count() == 0


def test_a_document_that_loses_too_much_goes():
    junk = "\n".join("| x | y | z |" for _ in range(40)).encode()
    assert q.judge(GOOD.encode())[-1] and not q.judge(GOOD.encode() + b"\n" + junk)[-1] and not q.judge(b"few words only.")[-1]
