"""Queries that SQL can express, on the provided tables and on odd rows."""

import pytest
from against_sql import differences
from tidemark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert differences(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name]) is None


@pytest.mark.parametrize("name", ["op1_quality_rules", "op3_license_scan", "op11_collocations"])
def test_odd_rows(spark, tmp_path, odd, none, name):
    more = odd.unionByName(spark.createDataFrame([(90, "x Released under the MIT\nLicense. y", "", "", 1), (91, "Home\n" + "Good line with words, and more of them.\n" * 3, "", "", 1)], odd.schema))
    more.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    none.write.parquet(str(tmp_path / "b" / "documents.parquet"))
    for part in "ab":
        sql = queries.ORACLE_SQL[name].replace("FROM documents", f"FROM read_parquet('{tmp_path}/{part}/documents.parquet/*.parquet')")
        assert differences(spark, name, queries.QUERIES[name], sql, str(tmp_path / part)) is None


def test_odd_pages(spark, tmp_path):
    html = "<p>" + "x" * 200
    rows = [(5, "http://a/", html), (2, "http://b/", html), (9, None, html), (1, "u", None), (3, "v", ""), (4, "w", "<p>small"), (6, "w", "<p>small"), (7, "é\r\nInjected: 1", "é" * 60)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    sql = queries.ORACLE_SQL["op2_warc_zip"].replace("FROM pages", f"FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert differences(spark, "op2", queries.QUERIES["op2_warc_zip"], sql, str(tmp_path)) is None
