import pytest
from against_sql import DATA

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Null, empty, blank, repeated rows, a tie of texts, a long text, symbols, other scripts.
TEXTS = [None, "", " \n\t ", "one", "Same words here and there.", "Same words here and there.", "word " * 30_000, "a\x0bb\x0cc\rd", "naïve CAFÉ ÀÉ x y", "x" * 200_000, "#*$%&|<> !!! | a | b"]


@pytest.fixture
def odd(spark):
    rows = [(i, t, "en", None if i % 3 else "s", 1) for i, t in enumerate(TEXTS)] + [(3, "one", "en", "s", 1), (None, "no id", None, None, None)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")
