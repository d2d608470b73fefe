"""The log of page views as a stream: what counts, what is kept of it, and that each view is logged once."""

import json

from pyspark.sql import functions as F
from tidemark.streaming import visits

SCHEMA = "method string, path string, referrer string, forwarded string, remote string, agent string, at timestamp"
NEAR = {"method": "GET", "path": "/radar", "referrer": "https://a.b/x?secret", "forwarded": "5.6.7.8, 1.1.1.1", "remote": None, "agent": "Mozilla/5.0", "at": "2024-01-02T03:04:05.9"}


def land(folder, name, *rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(NEAR | r) + "\n" for r in rows))


def run(spark, tmp, salt="s"):
    requests = spark.readStream.schema(SCHEMA).json(str(tmp / "in"))
    q = visits.log_views(requests, f"file://{tmp}/log", str(tmp / "cp"), ["5.6.0.0/16"], salt)
    q.awaitTermination()
    return visits.views(spark, f"file://{tmp}/log")


def test_views_are_logged_once(spark, tmp_path):
    assert visits.views(spark, f"file://{tmp_path}/log").count() == 0
    land(tmp_path / "in", "1", {}, {"method": "POST"}, {"path": "/wp-admin"}, {"path": None}, {"at": None}, {"forwarded": None, "remote": "[::1]:80", "path": "/companies/7", "referrer": None})
    land(tmp_path / "in", "2", {"forwarded": "", "remote": "", "agent": None, "path": "/"})
    got = {r["path"]: r for r in run(spark, tmp_path).collect()}
    assert set(got) == {"/radar", "/companies/7", "/"}
    assert (got["/radar"]["referrer_host"], got["/radar"]["client_kind"], str(got["/radar"]["viewed_at"])) == ("a.b", "automated", "2024-01-02 03:04:05")  # a browser in a data centre is no visitor
    assert (got["/companies/7"]["referrer_host"], got["/companies/7"]["client_kind"], len(got["/companies/7"]["visitor_day_hash"])) == ("", "human", 16)
    assert (got["/"]["client_kind"], got["/"]["visitor_day_hash"]) == ("automated", "")
    assert run(spark, tmp_path).count() == 3  # a restart finds nothing new
    land(tmp_path / "in", "3", {}, {})
    assert run(spark, tmp_path).count() == 5  # the same visitor again is a view again
    assert {c for c, _ in run(spark, tmp_path).dtypes} == {"path", "referrer_host", "client_kind", "visitor_day_hash", "viewed_at"}


def test_a_visitor_is_one_a_day(spark):
    at = lambda day: F.lit(f"2024-01-{day:02d} 10:00:00").cast("timestamp")
    request = lambda day, ip: spark.range(1).select(F.lit("GET").alias("method"), F.lit("/").alias("path"), F.lit("").alias("referrer"), F.lit(ip).alias("forwarded"), F.lit("").alias("remote"), F.lit("x").alias("agent"), at(day).alias("at"))
    who = lambda day, ip, salt="s": visits.viewed(request(day, ip), [], salt).first()["visitor_day_hash"]
    assert who(1, "1.2.3.4") == who(1, " 1.2.3.4,9.9.9.9") != who(2, "1.2.3.4") and who(1, "1.2.3.4") not in (who(1, "1.2.3.5"), who(1, "1.2.3.4", "other"))
