"""The console refuses by plan, and ends what takes too long."""

import time

import pytest
from tidemark.operators import console


@pytest.fixture
def views(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 3 as g", "cast(id as string) as t").write.parquet(str(tmp_path / "p"))
    spark.read.parquet(str(tmp_path / "p")).createOrReplaceTempView("numbers")
    spark.range(5).createOrReplaceTempView("hidden")
    return tmp_path


def test_queries_are_answered(spark, views):
    ask = lambda q: console.read(spark, q, ["numbers"]).rows
    assert ask("select g, count(*) as n, max(id) from numbers group by g having count(*) > 33 order by g") == [["0", "34", "99"]]
    assert ask("with a as (select * from numbers where id in (select id from numbers where g = 1)), b as (select max(id) m from a) select m from b") == [["97"]]
    assert ask("select n.id, (select max(id) from numbers) from numbers n join numbers m on n.id = m.id + 98 where exists (select 1 from numbers where t like '9%') order by 1 desc limit 1") == [["99", "99"]]
    assert ask("select x.id, row_number() over (partition by g order by id) as k from (select * from numbers where id < 2) x order by 1") == [["0", "1"], ["1", "1"]]
    assert ask("select e from numbers lateral view explode(split(t, '')) as e where id = 42 union all select 'z' order by 1 limit 9")[-1] == ["z"]


@pytest.mark.parametrize("query", [
    "select java_method('java.lang.System', 'getProperty', 'user.home')", "select reflect('java.lang.System', 'exit', 1)", "select try_reflect('java.lang.System', 'lineSeparator')", "select * from parquet.`{p}`", "select * from json.`/etc/passwd`",
    "select * from hidden", "select id from numbers where id in (select id from hidden)", "select (select max(id) from parquet.`{p}`) from numbers", "with numbers2 as (select * from hidden) select * from numbers2", "select transform(id) using 'cat' as x from numbers",
    "select * from range(10)", "select input_file_name() from numbers", "select * from numbers where exists (select reflect('java.lang.System', 'lineSeparator'))", "with a as (select current_user() as x) select * from a", "select * from default.numbers",
    "select * from numbers lateral view inline(array(struct(1))) as e", "select max(id) over (order by java_method('java.lang.System', 'lineSeparator')) from numbers", "select 1 order by reflect('java.lang.System', 'lineSeparator')",
])
def test_what_is_not_a_plain_query_is_refused(spark, views, query):
    with pytest.raises(ValueError):
        console.read(spark, query.replace("{p}", str(views / "p")), ["numbers"])


def test_a_view_over_another_is_read_whole(spark, views):
    spark.sql("create or replace temp view over as select * from hidden where id > 2")
    assert console.read(spark, "select id from over order by id", ["over"]).rows == [["3"], ["4"]]


def test_slow_queries_end(spark, views):
    spark.range(3_000_000).createOrReplaceTempView("many")
    began = time.time()
    with pytest.raises(TimeoutError):
        console.read(spark, "select count(*) from many a join many b on a.id % 7 = b.id % 7 where sqrt(a.id + b.id) < 0", ["many"], seconds=2)
    assert time.time() - began < 20
    assert console.read(spark, "select count(*) from numbers", ["numbers"]).rows == [["100"]]  # the session goes on
