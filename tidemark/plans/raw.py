"""Parsers of raw formats over files made from the provided tables, each against the tables themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.registry import query, table
from tidemark.sources import listings, ownership, pages, risks

_ACC = "concat(lpad(cast(c_custkey as string), 10, '0'), '-24-', lpad(cast(c_nationkey as string), 6, '0'))"
_SQL_ACC = "lpad(c_custkey::VARCHAR, 10, '0') || '-24-' || lpad(c_nationkey::VARCHAR, 6, '0')"
_FORM = "if(c_custkey % 3 = 0, '8-K', '8-K/A')"
_SQL_FORM = "CASE WHEN c_custkey % 3 = 0 THEN '8-K' ELSE '8-K/A' END"


def _joined(rows: DataFrame, line: str, sep: str, head: str, tail: str = "") -> DataFrame:
    """A file for each block of at most 200 customers of a nation: their lines between a head and a tail."""
    parts = rows.groupBy("c_nationkey", F.expr("c_custkey div 200")).agg(F.array_join(F.array_sort(F.collect_list(F.expr(line))), sep).alias("t"))
    return parts.select(F.concat(F.lit(head), "t", F.lit(tail)).alias("text"))


@query(f"SELECT lpad(c_custkey::VARCHAR, 10, '0') AS cik, c_name AS company_name, {_SQL_FORM} AS form, '20240102' AS filed_at, {_SQL_ACC} AS accession_number, 'edgar/' || {_SQL_ACC} || '.txt' AS submission_path FROM customer")
def raw_daily_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = f"concat_ws('|', cast(c_custkey as string), c_name, {_FORM}, '20240102', concat('edgar/', {_ACC}, '.txt'))"
    return listings.daily_index(_joined(table(spark, sf_dir, "customer"), line, "\n", "Preamble: a|b|c|d|e.txt\n\n-----\nbroken|row\n"))


@query(f"SELECT lpad(c_custkey::VARCHAR, 10, '0') AS cik, c_name AS company_name, '8-K' AS form, {_SQL_ACC} AS accession_number, '2024-01-02T10:00:00-05:00' AS updated_at FROM customer WHERE c_custkey % 3 = 0 AND c_nationkey <> 7")
def raw_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of one form; those of one nation lack their id."""
    ident = f"if(c_nationkey = 7, '', concat('<id>urn:tag:x,2008:accession-number=', {_ACC}, '</id>'))"
    line = f"concat('<entry><title>', {_FORM}, ' - ', c_name, ' (', lpad(cast(c_custkey as string), 10, '0'), ') (Filer)</title>', {ident}, '<updated>2024-01-02T10:00:00-05:00</updated><category term=\"', {_FORM}, '\"/></entry>')"
    files = _joined(table(spark, sf_dir, "customer"), line, "\n", '<feed xmlns="http://www.w3.org/2005/Atom">', "</feed>")
    return listings.of_form(listings.feed(files), "8-K")


@query(
    """SELECT lpad(o_custkey::VARCHAR, 10, '0') AS cik, o_orderkey::VARCHAR AS accession_number, o_orderdate::DATE AS filing_date, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE END AS report_date
    FROM orders WHERE o_orderpriority = '1-URGENT'"""
)
def raw_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel lists of each customer's orders."""
    o = table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    entry = F.struct(F.col("o_orderkey").cast("string").alias("a"), day.alias("d"), F.when(F.col("o_orderkey") % 2 == 0, day).otherwise("").alias("r"), F.col("o_orderpriority").alias("f"))
    lists = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    part = lambda k: F.transform("e", lambda x: x[k])
    recent = F.struct(part("a").alias("accessionNumber"), part("d").alias("filingDate"), part("r").alias("reportDate"), part("f").alias("form"), part("a").alias("primaryDocument"))
    files = lists.select(F.to_json(F.struct(F.col("o_custkey").cast("string").alias("cik"), F.lit("n").alias("name"), F.struct(recent.alias("recent")).alias("filings"))).alias("text"))
    return listings.of_form(listings.submissions(files), "1-URGENT").select("cik", "accession_number", "filing_date", "report_date")


@query("SELECT upper(n_name) AS ticker, lpad(n_nationkey::VARCHAR, 10, '0') AS cik, n_name AS company_name FROM nation WHERE n_nationkey <> 3")
def raw_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each region; one entry is incomplete."""
    n = table(spark, sf_dir, "nation")
    entry = F.struct(F.col("n_nationkey").cast("string"), F.struct(F.col("n_nationkey").alias("cik_str"), F.when(F.col("n_nationkey") != 3, F.col("n_name")).otherwise("").alias("ticker"), F.col("n_name").alias("title")))
    files = n.groupBy("n_regionkey").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("text"))  # regions hold a few nations each
    return listings.ticker_index(listings.tickers(files))


@query(
    """SELECT l_orderkey::VARCHAR AS accession_number, lpad(l_orderkey::VARCHAR, 10, '0') AS owner_cik, count(*) AS n, sum(l_quantity) AS shares,
    sum(CASE WHEN l_linenumber <> 2 THEN l_quantity * l_extendedprice END) AS total FROM lineitem GROUP BY l_orderkey"""
)
def raw_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ownership document for each order; the second line's price isn't a number."""
    written = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("n/a"))
    numbers = F.struct(written("l_quantity").alias("shares"), F.when(F.col("l_linenumber") == 2, "n/a").otherwise(written("l_extendedprice")).alias("price"))
    line = lambda x: F.concat(F.lit("<nonDerivativeTransaction><transactionAmounts><transactionShares><value>"), x["shares"], F.lit("</value></transactionShares><transactionPricePerShare><value>"), x["price"], F.lit("</value></transactionPricePerShare></transactionAmounts></nonDerivativeTransaction>"))
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(numbers).alias("lines"))  # numbers are shuffled, markup is made where it is parsed
    head = F.concat(F.lit("head <ownershipDocument><issuer><issuerCik>1</issuerCik></issuer><reportingOwner><reportingOwnerId><rptOwnerCik>"), F.col("l_orderkey").cast("string"), F.lit("</rptOwnerCik></reportingOwnerId></reportingOwner><nonDerivativeTable>"))
    text = F.concat(head, F.array_join(F.transform("lines", line), ""), F.lit("</nonDerivativeTable></ownershipDocument>"))
    parsed = ownership.parsed(orders.select(F.col("l_orderkey").cast("string").alias("accession_number"), text.alias("text")))
    return ownership.transactions(parsed).groupBy("accession_number", "owner_cik").agg(F.count("*").alias("n"), F.sum("shares").alias("shares"), F.sum("transaction_value").alias("total"))


@query("SELECT c_custkey, c_custkey::VARCHAR || '.htm' AS primary_document, DATE '2023-12-31' AS report_date, (c_custkey % 3)::INT AS exhibits FROM customer")
def raw_filing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index page for each customer, with up to two exhibits."""
    row = lambda kind, name: F.concat(F.lit('<tr><td>1</td><td>x</td><td><a href="/ix?doc=/Archives/'), name, F.lit(f'">d</a></td><td>{kind}</td></tr>'))
    own = F.concat(F.col("c_custkey").cast("string"), F.lit(".htm"))
    table_of = F.concat(row("8-K", own), F.when(F.col("c_custkey") % 3 > 0, row("EX-99.1", F.lit("a.htm"))).otherwise(""), F.when(F.col("c_custkey") % 3 > 1, row("EX-99.2", F.lit("b.htm"))).otherwise(""))
    page = F.concat(F.lit('<div class="infoHead">Period of Report</div><div class="info">2023-12-31</div><table summary="Document Format Files">'), table_of, F.lit("</table>"))
    c = table(spark, sf_dir, "customer").select("c_custkey", page.alias("page"))
    return c.select("c_custkey", pages.primary_document(F.col("page"), F.lit("8-K")).alias("primary_document"), pages.report_date(F.col("page")).alias("report_date"), F.size(pages.exhibits(F.col("page"), F.lit("1"), F.lit("1-1"))).alias("exhibits"))


@query(
    r"""SELECT page_id, number, text FROM (SELECT page_id, unnest(['2.02', '9.01']) AS number, unnest(['first part of ' || page_id, 'second part']) AS text FROM pages)"""
)
def raw_item_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup with scripts and inline tags around two items of each page."""
    html = F.format_string("<html><script>no</script><p>Item <b>2</b>.02. Results</p><div>first p<i>art</i> of %d</div><!-- x --><h1>ITEM 9.01 - Exhibits</h1><td>second  part</td></html>", "page_id")
    text = table(spark, sf_dir, "pages").select("page_id", pages.plain_text(html).alias("t"))
    return text.select("page_id", F.explode(pages.item_sections(F.col("t"))).alias("s")).select("page_id", "s.number", "s.text")


@query()
def raw_page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text of every page that is markup; compared with plain code in the tests."""
    p = table(spark, sf_dir, "pages").where(pages.document_kind(F.encode("html", "UTF-8"), F.lit("text/html")) == "markup")
    return p.select("page_id", pages.plain_text(F.col("html")).alias("text"))


@query("""SELECT c_custkey::VARCHAR AS accession_number, i::INT AS block_index, 'Risk number ' || i || ' of ' || c_name || ' is stated here.' AS heading,
    'Risk number ' || i || ' of ' || c_name || ' is stated here. ' || trim(repeat('Trade of ' || c_name || ' may fall. ', 25)) AS block_text FROM customer, (VALUES (0), (1), (2)) t(i) WHERE c_custkey % 4 <> 3""")
def raw_risk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each customer, found by its bold heading, its item or its table of contents; those of a quarter lack the section's end."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")  # reports are made from dealt keys and names, so that every core parses
    kind = F.col("c_custkey") % 4
    toc = F.when(kind == 2, '<a href="#rf">Risk Factors</a><a href="#end">Properties</a>').otherwise("")
    head = F.when(kind == 0, "<p><b>Item 1A. Risk Factors</b></p>").when(kind == 2, '<p id="rf">Where we may fail</p>').otherwise("<p>Item 1A. Risk Factors</p>")
    end = F.when(kind == 0, "<p><b>Item 1B. Unresolved Staff Comments</b></p>").when(kind == 1, "<p>Item 2. Properties</p>").when(kind == 2, '<p id="end">More</p>').otherwise("<p>More</p>")
    risk = lambda i: F.concat(F.lit(f"<p><b>Risk number {i} of "), "c_name", F.lit(" is stated here.</b></p><p>"), F.repeat(F.concat(F.lit("Trade of "), "c_name", F.lit(" may fall. ")), F.lit(25)), F.lit("</p>"))
    html = F.concat(F.lit("<html>"), toc, head, F.lit("<p>intro</p>"), risk(0), risk(1), risk(2), end, F.lit("<p>and more text</p></html>"))
    return risks.risk_blocks(c.select(F.col("c_custkey").cast("string").alias("accession_number"), html.alias("html"))).drop("block_hash")
