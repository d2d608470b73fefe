"""Raw formats, on inputs made here."""

import datetime
import json
import time

from pyspark.sql import functions as F
from tidemark.plans import raw
from tidemark.sources import listings, ownership, pages, risks

INDEX = """Description:           Master Index
Comments:              any | thing | with | five | bars.txt

CIK|Company Name|Form Type|Date Filed|File Name
--------------------------------------------------------------------------------
1000|ALPHA, INC.|8-K|20240102|edgar/data/1000/0000001000-24-000001.txt
1001|Beta Co|8-K/A|20240102|edgar/data/1001/0000001001-24-000002.txt
broken line
1002|Gamma|8-K|20240102|edgar/data/1002/none.htm
1003|Delta|13F-HR|20240102|edgar/data/1003/0000001003-24-000004.txt
"""


def files(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_daily_index(spark):
    got = listings.daily_index(files(spark, INDEX, None, "", "no dashes|a|b|c|0000001003-24-000004.txt"))
    assert [r[:4] for r in rows(got)] == [("0000001000", "ALPHA, INC.", "8-K", "20240102"), ("0000001001", "Beta Co", "8-K/A", "20240102"), ("0000001003", "Delta", "13F-HR", "20240102")]
    assert rows(listings.of_form(got, "8-K").select("accession_number")) == [("0000001000-24-000001",)]
    assert rows(spark.range(1).select(listings.daily_index_url(F.lit(datetime.date(2024, 8, 5)))))[0][0].endswith("2024/QTR3/master.20240805.idx")


def entry(title="8-K - A-B, Corp &amp; Co (0000000042) (Filer)", ident="urn:tag:x,2008:accession-number=0000000042-24-000001", updated="2024-01-02T10:00:00-05:00", term="8-K"):
    parts = [f"<title>{title}</title>" if title else "", f"<id>{ident}</id>" if ident else "", f"<updated>{updated}</updated>" if updated else "", f'<category scheme="s" label="l" term="{term}"/>' if term else ""]
    return "<entry>" + "\n".join(parts) + "<summary type=\"html\">x</summary></entry>"


def test_feed(spark):
    feed = '<?xml version="1.0" encoding="ISO-8859-1" ?><feed xmlns="http://www.w3.org/2005/Atom"><title>all</title>' + "".join(
        [entry(), entry(term="8-K/A"), entry(term=None), entry(ident=None), entry(title="no number here"), entry(updated=None), entry(ident="urn:other")]
    ) + "</feed>"
    got = rows(listings.feed(files(spark, feed, None, "not xml")))
    assert got == [("0000000042", "A-B, Corp & Co", f, "0000000042-24-000001", "2024-01-02T10:00:00-05:00") for f in ("8-K", "8-K/A", "8-K")]


def test_columnar_json_and_tickers(spark):
    recent = {"accessionNumber": ["0-24-1", "0-24-2", "0-24-3"], "filingDate": ["2024-01-01", "2024-02-01", "2024-03-01"], "reportDate": ["", "2024-01-31"], "form": ["8-K", "10-K", "8-K"], "primaryDocument": ["a.htm", "b.htm", "c.htm"], "items": ["2.02, 9.01,", ""]}
    text = json.dumps({"cik": "77", "name": "Seven", "filings": {"recent": recent, "files": []}})
    got = listings.submissions(files(spark, text, "{}", "oops", None))
    assert [(r["cik"], r["form"], r["report_date"], r["items"], r["primary_document_url"].split("data/")[1]) for r in got.collect()] == [
        ("0000000077", "8-K", None, ["2.02", "9.01"], "77/0241/a.htm"), ("0000000077", "10-K", datetime.date(2024, 1, 31), [], "77/0242/b.htm"), ("0000000077", "8-K", None, [], "77/0243/c.htm")]
    assert [r["accession_number"] for r in listings.recent_of_form(got, "8-K", 1).collect()] == ["0-24-1"]
    older = listings.older_submissions(spark.createDataFrame([("77", "Seven", json.dumps(recent | {"accessionNumber": ["0-24-1", "0-20-9", "0-20-8"]}))], "cik string, company_name string, text string"))
    assert [r["accession_number"] for r in listings.periodic(got, older, "8-K", 2).orderBy(F.desc("filing_date")).collect()] == ["0-24-3", "0-20-8"]
    names = {"0": {"cik_str": 5, "ticker": "brk-b", "title": "B"}, "1": {"cik_str": 6, "ticker": "XY", "title": "X"}, "2": {"cik_str": 7, "ticker": "", "title": "N"}, "3": {"ticker": "Q", "title": "Q"}, "10": {"cik_str": 8, "ticker": "XY", "title": "Later"}}
    entries = listings.tickers(files(spark, json.dumps(names)))
    assert sorted(rows(entries.select("cik", "ticker"))) == [("0000000005", "brk-b"), ("0000000006", "XY"), ("0000000008", "XY")]
    index = listings.ticker_index(entries)
    asked = spark.createDataFrame([("brk.b", 0), ("X.Y", 1), ("none", 2), ("xy", 3)], "ticker string, pos int")
    assert {r["ticker"]: r["cik"] for r in listings.resolved(asked, index).collect()} == {"brk.b": "0000000005", "X.Y": "0000000008", "none": None, "xy": "0000000008"}
    ciks = spark.createDataFrame([("8", 0), ("123", 1)], "cik string, pos int")
    assert rows(listings.targets(asked, index, ciks).orderBy("at").select("cik", "name")) == [("0000000005", "B"), ("0000000008", "Later"), ("0000000123", "0000000123")]


def ownership_text(issuer="<issuerCik>123</issuerCik>", extra=""):
    line = "<nonDerivativeTransaction><securityTitle><value>Common</value></securityTitle><transactionDate><value>2024-01-05</value></transactionDate><transactionCoding><transactionFormType>4</transactionFormType><transactionCode>P</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>{0}</value><footnoteId id='F1'/></transactionShares><transactionPricePerShare>{1}</transactionPricePerShare><transactionAcquiredDisposedCode><value>A</value></transactionAcquiredDisposedCode></transactionAmounts><postTransactionAmounts><sharesOwnedFollowingTransaction><value>5000</value></sharesOwnedFollowingTransaction></postTransactionAmounts><ownershipNature><directOrIndirectOwnership><value>D</value></directOrIndirectOwnership></ownershipNature></nonDerivativeTransaction>"
    option = "<derivativeTable><derivativeTransaction><securityTitle><value>Option</value></securityTitle><conversionOrExercisePrice><value>15.50</value></conversionOrExercisePrice><exerciseDate><value>2027-06-26</value></exerciseDate><expirationDate><footnoteId id='F2'/></expirationDate><underlyingSecurity><underlyingSecurityTitle><value>Common</value></underlyingSecurityTitle><underlyingSecurityShares><value>5000</value></underlyingSecurityShares></underlyingSecurity></derivativeTransaction></derivativeTable>"
    return (
        "<SEC-DOCUMENT>head\n<XML><ownershipDocument><periodOfReport>2024-01-05</periodOfReport><aff10b5One>True</aff10b5One>"
        f"<issuer>{issuer}<issuerName>I &amp; Co</issuerName></issuer><reportingOwner><reportingOwnerId><rptOwnerCik>0000000456</rptOwnerCik><rptOwnerName>O</rptOwnerName></reportingOwnerId>"
        "<reportingOwnerRelationship><isDirector>1</isDirector><isOfficer>true</isOfficer><isOther>0</isOther><officerTitle> CEO </officerTitle></reportingOwnerRelationship></reportingOwner>"
        f"<nonDerivativeTable>{line.format('1000', '<value>10.00</value>')}{line.format('abc', '<value> </value>')}</nonDerivativeTable>{option}{extra}</ownershipDocument></XML>"
    )


def test_ownership(spark):
    texts = [("a", ownership_text()), ("b", "no xml"), ("c", None), ("d", ownership_text(issuer="<issuerCik>x</issuerCik>")), ("e", "<ownershipDocument><issuer></ownershipDocument>"), ("f", ownership_text(extra="<notSubjectToSection16>1</notSubjectToSection16>").replace("nonDerivativeT", "otherT"))]
    got = ownership.parsed(spark.createDataFrame(texts, "accession_number string, text string"))
    env = {r["accession_number"]: r for r in ownership.envelopes(got).collect()}
    assert {k: (r["parsed"], r["non_derivative_count"], r["derivative_count"]) for k, r in env.items()} == {"a": (True, 2, 1), "b": (False, 0, 0), "c": (False, 0, 0), "d": (False, 0, 0), "e": (False, 0, 0), "f": (True, 0, 1)}
    a = env["a"]
    assert (a["issuer_cik"], a["issuer_name"], a["issuer_ticker"], a["owner_cik"], a["officer_title"]) == ("0000000123", "I & Co", None, "0000000456", "CEO")
    assert (a["is_director"], a["is_officer"], a["is_ten_percent_owner"], a["is_other"], a["is_10b5_1"], a["not_subject_to_section16"]) == (True, True, False, False, True, False) and env["f"]["not_subject_to_section16"]
    assert env["b"]["is_director"] is None and env["d"]["issuer_name"] is None
    lines = ownership.transactions(got).where("accession_number = 'a'").orderBy("txn_seq").collect()
    assert [(r["transaction_code"], r["shares"], r["price_per_share"], r["transaction_value"], r["acquired_disposed"], r["shares_owned_following"], r["direct_or_indirect"]) for r in lines] == [("P", 1000.0, 10.0, 10000.0, "A", 5000.0, "D"), ("P", None, None, None, "A", 5000.0, "D")]
    option = ownership.derivative_transactions(got).where("accession_number = 'f'").first()
    assert (option["conversion_exercise_price"], option["exercise_date"], option["expiration_date"], option["underlying_shares"], option["shares"]) == (15.5, "2027-06-26", None, 5000.0, None)


PAGE = """<div class="infoHead">Filing Date</div><div class="info">2024-02-02</div><div class="infoHead">Period of Report</div>
<div class="info">2023-12-31</div><table class="tableFile" summary="Document Format Files"><tr><th>Seq</th><th>x</th></tr>
<tr><td>1</td><td>REPORT</td><td><a href="/ix?doc=/Archives/edgar/data/1/000/main.htm">main.htm</a> iXBRL</td><td>8-K</td><td>1</td></tr>
<tr><td>2</td><td>ex</td><td><a href="/Archives/edgar/data/1/000/b.htm">b</a></td><td>EX-99.2</td><td>1</td></tr>
<tr><td>3</td><td>ex</td><td><a href="/Archives/edgar/data/1/000/a.htm">a</a></td><td>ex-99.1</td><td>1</td></tr>
<tr><td>4</td><td>logo</td><td><a href="/x/l.jpg">l</a></td><td>&nbsp;</td><td>1</td></tr><tr><td>5</td><td></td><td>none</td><td>EX-99.3</td><td>1</td></tr></table>"""


def test_index_page(spark):
    df = spark.createDataFrame([(PAGE, "8-K"), (PAGE, "10-K"), ("<p>", "8-K"), (None, "8-K"), (PAGE.replace("2023-12-31", "2023-13-31"), "8-K/A")], "page string, form string")
    page = F.col("page")
    got = df.select(pages.primary_document(page, F.col("form")), pages.report_date(page), F.transform(pages.exhibits(page, F.lit("0000000009"), F.lit("0-24-1")), lambda e: F.concat_ws(" ", e["exhibit_type"], e["document"]))).collect()
    assert [tuple(r) for r in got] == [("main.htm", datetime.date(2023, 12, 31), ["EX-99.1 a.htm", "EX-99.2 b.htm"]), (None, datetime.date(2023, 12, 31), ["EX-99.1 a.htm", "EX-99.2 b.htm"]), (None, None, []), (None, None, None), (None, None, ["EX-99.1 a.htm", "EX-99.2 b.htm"])]
    url = df.select(F.get(pages.exhibits(page, F.lit("0000000009"), F.lit("0-24-1")), F.lit(0))["url"]).first()[0]
    assert url.endswith("data/9/0241/a.htm")


def test_kinds_and_charsets(spark):
    cases = [(b"  %PDF-1.4", None, "pdf"), (b"<html>", "application/pdf; x", "pdf"), (b"PK\x03\x04", "text/html", "binary"), (b"<p>", "image/png", "binary"), (b"<p>", "application/octet-stream", "binary"), (b"<p>", "Text/HTML; charset=x", "markup"), (b"", None, "markup"), (None, None, "markup"), (b"BM..", None, "binary")]
    df = spark.createDataFrame(cases, "content binary, kind string, want string")
    assert all(r[0] == r[1] for r in df.select(pages.document_kind(F.col("content"), F.col("kind")), "want").collect())
    big = spark.range(1).select(F.encode(F.repeat(F.lit("x"), pages.MAX_PARSE_BYTES + 1), "UTF-8").alias("c"))
    assert big.select(pages.document_kind(F.col("c"), F.lit("text/html"))).first()[0] == "oversized"
    df = spark.createDataFrame([("é".encode("latin-1"), "text/html; charset=ISO-8859-1"), ("é".encode(), None), ("é".encode(), "a; charset=none-such"), (b"\xff", "x"), (None, None)], "c binary, k string")
    assert [r[0] for r in df.select(pages.decoded(F.col("c"), F.col("k"))).collect()] == ["é", "é", "é", "�", None]


def test_text_and_items(spark):
    html = "<?xml version='1.0'?><html><head><style>p{}</style></head><body><script>no</script><!-- no --><p><b>F</b>irst of A<i>pri</i>l&nbsp; x</p><div>Item 2.02. Results &amp; more</div><p>Body\n one</p><p></p><p></p><p>two</p><div>ITEM 9.01 — Exhibits</div><p>list</p><noscript>no</noscript></body></html>"
    assert pages.text_of(html).splitlines()[0] == "First of April x" and "no" not in pages.text_of(html).split() and "\n\n\n" not in pages.text_of(html)
    df = spark.createDataFrame([(html,), (None,), ("<p>no headings</p>",)], "html string").select(pages.plain_text(F.col("html")).alias("text")).select(pages.item_sections(F.col("text")).alias("s"))
    got = [[tuple(x) for x in r["s"]] for r in df.collect()]
    assert [(n, t) for n, t, _ in got[0]] == [("2.02", "Results & more"), ("9.01", "Exhibits")] and got[0][1][2] == "list" and "two" in got[0][0][2] and got[1] == got[2] == []


WORDS = "We may lose customers and suppliers if conditions in our markets worsen for a long time. "


def report(heading="<b>Item 1A. Risk Factors</b>", toc="", end="<p><b>Item 1B. Unresolved Staff Comments</b></p>", risks_=4, body=8):
    parts = "".join(f"<p><b>Risk number {i} is stated in a whole sentence here.</b></p><p>{WORDS * body}An <b>inline</b> word.</p>" for i in range(risks_))
    return f"<html><style>b{{}}</style>{toc}<p>{heading}</p><p>{WORDS * 2}</p>{parts}{end}<p>{WORDS * 30}</p></html>"


def blocks(spark, **reports):
    """(index, heading, text, hash) of each report's blocks, by its name."""
    rows = risks.risk_blocks(spark.createDataFrame(list(reports.items()), "accession_number string, html string")).orderBy("accession_number", "block_index").collect()
    return {name: [tuple(r)[1:] for r in rows if r["accession_number"] == name] for name in reports}


def test_sections_by_every_tier(spark):
    toc = '<a href="#rf">Risk Factors</a><a href="#ub">Unresolved Staff Comments</a>'
    found = blocks(
        spark, bold=report(toc="<p>Item 1A. Risk Factors 12</p><p>Item 1B. Unresolved 20</p>"), plain=report(heading="Item 1A — Risk Factors", end="<p>Item 1B. Unresolved</p>"),
        styled=report(heading='<span style="font-weight: 700">Risk Factors</span>', end="<h2>Properties</h2>"), linked=report(heading='<a name="rf"></a>Ris k Fac tors', toc=toc, end='<p id="ub">next part</p>'),
        open=report(heading="<p id='rf'></p>Ris k", toc='<a href="#rf">Risk Factors</a>', end=""), back=report(heading='<a name="rf"></a>Ris k', toc='<p id="ub">before</p>' + toc, end=""),
        broken=report(heading="Item 1A<br>- Risk <i>Factors</i>", end="Item 2. Other"),
    )
    got = found["bold"]
    assert [i for i, *_ in got] == list(range(5)) and got[0][1].startswith("Item 1A") is False if got[0][1] else got[0][1] is None
    assert [h for _, h, _, _ in got[1:]] == [f"Risk number {i} is stated in a whole sentence here." for i in range(4)]
    assert all("inline word" in t and "Unresolved" not in t for _, _, t, _ in got[1:])
    assert [h for _, h, _, _ in found["plain"]][1:] == [h for _, h, _, _ in got][1:] == [h for _, h, _, _ in found["broken"]][1:]
    assert len(found["styled"]) == 5
    assert [h for _, h, _, _ in found["linked"]][1:] == [h for _, h, _, _ in got][1:] and "next part" not in found["linked"][-1][2]
    assert found["open"] == [] and len(found["back"]) == 5  # links that lead back leave the end open


def test_sections_without_headers_and_of_wrong_size(spark):
    flat = "<p>Item 1A. Risk Factors</p>" + "".join(f"<p>{i} {WORDS * 6}</p>{'<b>x</b>'}" for i in range(9)) + "<p>Item 2. Properties</p>"
    found = blocks(spark, flat=flat, short="<b>Risk Factors</b><p>short</p><b>Properties</b>", empty="", none="<p>none</p>", long=report(body=3000), plain=report())
    got = found["flat"]
    assert len(got) >= 2 and all(h is None and len(t) >= risks.MERGED_BLOCK for _, h, t, _ in got[:-1])
    assert found["short"] == found["empty"] == found["none"] == found["long"] == []
    assert len({h for *_, h in found["plain"]}) == 5


def test_reports_over_the_limit_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(risks, "MOST_BYTES", 3000)
    assert blocks(spark, large=report())["large"] == []


def test_blocks_as_rows(spark):
    got = risks.risk_blocks(spark.createDataFrame([("a", report()), ("b", None), ("c", "<p>")], "accession_number string, html string"))
    assert [(r["accession_number"], r["block_index"]) for r in got.orderBy("block_index").collect()] == [("a", i) for i in range(5)]
    assert risks.risk_blocks(spark.createDataFrame([], "accession_number string, html string")).count() == 0


def test_markup_is_read_once_and_nothing_is_shuffled(spark):
    plan = risks.risk_blocks(spark.createDataFrame([("a", report())], "accession_number string, html string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan and "Window" not in plan


def test_reports_of_many_pieces(spark):
    """Beginnings, ends and runs by the tens of thousands, over many blocks of sums: only the longest stretch counts, in seconds."""
    many = "".join(f"<p>Item 1A. Risk Factors</p><p>x</p><b>y{i}</b><p>Item 2. Other</p>" for i in range(20_000))
    began = time.time()
    found = blocks(spark, many=many + report() + many, plain=report())
    assert time.time() - began < 120
    assert [h for *_, h in found["many"]] == [h for *_, h in found["plain"]] and len(found["plain"]) == 5


def test_ownership_blocks_are_cut_by_places(spark):
    """As the pattern cuts them, without walking every character by it."""
    a, b = "<ownershipDocument>", "</ownershipDocument>"
    texts = [None, "", "x", a, b, b + a, f"h{a}é 1{b}t", f"{a}1{a}2{b}3{b}", f"{b}{a}1{b}{a}2{b}", f"{a}{b}", f"\n{a}\n{b}\n", f"{a}1", "<ownershipDocument >1" + b]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = rows.select(ownership.ownership_xml(F.col("text")).alias("cut"), F.nullif(F.regexp_extract("text", f"(?s){a}.*?{b}", 0), F.lit("")).alias("pattern")).collect()
    assert [r["cut"] for r in got] == [r["pattern"] for r in got] and sum(r["cut"] is not None for r in got) == 5
    assert "regexp_extract" not in rows.select(ownership.ownership_xml(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()


def test_ownership_markup_is_made_after_the_shuffle(spark, tmp_path):
    lines = spark.createDataFrame([(1, 1, 2.0, 3.0), (1, 2, 5.0, 7.0), (1, 3, None, 1.0), (2, 1, 4.0, None)], "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    out = raw.raw_ownership(spark, str(tmp_path))
    assert sorted(tuple(r) for r in out.collect()) == [("1", "0000000001", 3, 7.0, 6.0), ("2", "0000000002", 1, 4.0, None)]
    made = [x for x in out._jdf.queryExecution().sparkPlan().toString().split("\n") if "partial_collect_list" in x]
    assert made and "<nonDerivativeTransaction>" not in "".join(made)
