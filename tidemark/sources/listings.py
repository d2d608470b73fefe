"""Raw listings as rows: the daily index, the feed of new filings, columnar JSON of a company's filings, the map of tickers.

Each function takes a table of whole files (column ``text``; other columns are carried along where it says so) and works with built-in functions alone, so it
runs over a folder of any number of files (``spark.read.text(folder, wholetext=True)``). A null or empty text has no rows, no files give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import padded, split_items

# Patterns of the listings.
ACCESSION_IN_PATH = r"(\d{10}-\d{2}-\d{6})\.txt$"
ACCESSION_IN_ID = r"accession-number=(\d{10}-\d{2}-\d{6})\s*$"
FEED_TITLE = r"^(\S+) - (.+) \((\d{10})\) \(\w+\)\s*$"
DOCUMENT_URL = "https://www.sec.gov/Archives/edgar/data/%s/%s/%s"
INDEX_URL = "https://www.sec.gov/Archives/edgar/daily-index/%s/QTR%s/master.%s.idx"


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the pattern's first match; null where there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def daily_index(files: DataFrame) -> DataFrame:
    """cik, company_name, form, filed_at, accession_number and submission_path of every row below an index file's line of dashes.

    Rows without five fields, or whose path doesn't end with an accession number, are left out; a number that isn't one gives a null cik.
    """
    lines = F.split("text", r"\r\n|\n|\r")
    start = F.array_position(F.transform(lines, lambda x: x.startswith("---")), True)
    body = F.when(start > 0, F.slice(lines, start.cast("int") + 1, F.size(lines))).otherwise(F.array().cast("array<string>"))
    rows = files.select(F.explode(body).alias("line")).select(F.transform(F.split("line", r"\|"), lambda x: F.trim(x)).alias("p")).where(F.size("p") == 5)
    p = lambda i: F.col("p")[i]
    out = rows.select(padded(p(0)).alias("cik"), p(1).alias("company_name"), p(2).alias("form"), p(3).alias("filed_at"), found(p(4), ACCESSION_IN_PATH).alias("accession_number"), p(4).alias("submission_path"))
    return out.where("accession_number is not null")


def of_form(entries: DataFrame, form: str) -> DataFrame:
    """Entries of exactly this form: an amendment (8-K/A) is another one."""
    return entries.where(F.col("form") == form)


def feed(files: DataFrame) -> DataFrame:
    """cik, company_name, form, accession_number and updated_at (as written) of every entry of Atom files.

    An entry's category names its form before its title does. Entries without a title, id or time of the expected shape are left out; the others stay.
    """
    entries = files.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?s)<entry[\s>].*?</entry>"), F.lit(0))).alias("xml"))
    schema = "title string, id string, updated string, category struct<_term: string>"
    e = entries.select(F.from_xml("xml", F.lit(schema), {"mode": "PERMISSIVE", "ignoreNamespace": "true"}).alias("e")).select("e.*")
    title = F.trim("title")
    form = F.coalesce(F.nullif(F.col("category._term"), F.lit("")), found(title, FEED_TITLE, 1))
    out = e.select(found(title, FEED_TITLE, 3).alias("cik"), F.trim(found(title, FEED_TITLE, 2)).alias("company_name"), form.alias("form"), found(F.trim("id"), ACCESSION_IN_ID).alias("accession_number"), F.nullif(F.trim("updated"), F.lit("")).alias("updated_at"))
    return out.where("cik is not null and accession_number is not null and updated_at is not null")


_RECENT = "accessionNumber array<string>, filingDate array<string>, reportDate array<string>, form array<string>, primaryDocument array<string>, items array<string>"
_SUBMISSIONS = f"cik string, name string, tickers array<string>, filings struct<recent: struct<{', '.join(c.replace(' ', ': ', 1) for c in _RECENT.split(', '))}>>"


def document_url(cik: Column, accession: Column, document: Column) -> Column:
    return F.format_string(DOCUMENT_URL, cik.try_cast("long").cast("string"), F.replace(accession, F.lit("-"), F.lit("")), document)


def _columns(block: Column, source: str) -> Column:
    """Parallel lists as a list of rows; missing dates and items are null and empty."""
    return F.arrays_zip(*[F.coalesce(block[c], F.array().cast("array<string>")).alias(c) for c in ("accessionNumber", "filingDate", "reportDate", "form", "primaryDocument", "items")])


def _filings(rows: DataFrame) -> DataFrame:
    date = lambda c: F.nullif(F.col(f"f.{c}"), F.lit("")).try_cast("date")
    return rows.select(
        "cik", "company_name", "pos", F.col("f.form").alias("form"), F.col("f.accessionNumber").alias("accession_number"), date("filingDate").alias("filing_date"), date("reportDate").alias("report_date"),
        F.col("f.primaryDocument").alias("primary_document"), document_url(F.col("cik"), F.col("f.accessionNumber"), F.col("f.primaryDocument")).alias("primary_document_url"), split_items(F.col("f.items")).alias("items"),
    )


def submissions(files: DataFrame) -> DataFrame:
    """A row for each filing of companies' JSON files, whose lists run in parallel: cik, company_name, pos, form, accession_number, filing_date, report_date,
    primary_document, its URL and items. A file that isn't such JSON has no rows."""
    s = files.select(F.from_json("text", _SUBMISSIONS).alias("s")).where("s.filings.recent is not null")
    rows = s.select(padded(F.col("s.cik")).alias("cik"), F.col("s.name").alias("company_name"), F.posexplode(_columns(F.col("s.filings.recent"), "")).alias("pos", "f"))
    return _filings(rows)


def older_submissions(files: DataFrame) -> DataFrame:
    """The same of the further files that hold the lists alone; needs cik and company_name with each file."""
    s = files.select("cik", "company_name", F.from_json("text", _RECENT).alias("s"))
    return _filings(s.select(padded(F.col("cik")).alias("cik"), "company_name", F.posexplode(_columns(F.col("s"), "")).alias("pos", "f")))


def recent_of_form(filings: DataFrame, form: str, limit: int) -> DataFrame:
    """Each company's first ``limit`` filings of the form in the order of its file."""
    from tidemark.operators.current import first_n

    return first_n(of_form(filings, form), ["cik"], limit, F.col("pos"))


def periodic(recent: DataFrame, older: DataFrame, form: str, limit: int) -> DataFrame:
    """Each company's newest ``limit`` filings of the form over its recent and older files, each accession once."""
    from tidemark.operators.current import first_n

    once = of_form(recent, form).unionByName(of_form(older, form)).dropDuplicates(["cik", "accession_number"])
    return first_n(once, ["cik"], limit, F.desc("filing_date"), F.desc("accession_number"))


def tickers(files: DataFrame) -> DataFrame:
    """cik, ticker and company_name of every complete entry of ticker maps (objects of objects)."""
    entry = files.select(F.explode(F.from_json("text", "map<string, struct<cik_str: string, ticker: string, title: string>>")).alias("k", "e"))
    rows = entry.select(F.lpad("e.cik_str", 10, "0").alias("cik"), F.col("e.ticker").alias("ticker"), F.col("e.title").alias("company_name"), F.col("k").try_cast("long").alias("pos"))
    return rows.where("cik is not null and ticker <> '' and company_name <> ''")


def ticker_index(entries: DataFrame) -> DataFrame:
    """One row for each upper-cased ticker: the last entry of the map wins."""
    return entries.groupBy(F.upper("ticker").alias("ticker")).agg(F.max_by(F.struct("cik", "company_name"), "pos").alias("e")).select("ticker", "e.*")


def resolved(asked: DataFrame, index: DataFrame) -> DataFrame:
    """ticker, cik and company_name of asked tickers (column ticker): as given, with - for a dot, or without the dot, in any case; a null cik where none is known."""
    forms = asked.select("ticker", F.posexplode(F.array(*[f(F.upper("ticker")) for f in (lambda t: t, lambda t: F.replace(t, F.lit("."), F.lit("-")), lambda t: F.replace(t, F.lit("."), F.lit("")))])).alias("try", "form"))
    hits = forms.join(index.withColumnRenamed("ticker", "form"), "form").groupBy("ticker").agg(F.min_by(F.struct("cik", "company_name"), "try").alias("e"))
    return asked.join(hits, "ticker", "left").select("ticker", "e.cik", "e.company_name")


def targets(asked: DataFrame, index: DataFrame, ciks: DataFrame) -> DataFrame:
    """cik and name of every company asked for by ticker (ticker, pos) or by number (cik, pos), once, in the order asked, tickers first."""
    by_ticker = resolved(asked, index).join(asked, "ticker").where("cik is not null").select("cik", F.col("company_name").alias("name"), F.struct(F.lit(0).alias("kind"), "pos").alias("at"))
    by_cik = ciks.select(padded(F.col("cik").cast("string")).alias("cik"), "pos").select("cik", F.col("cik").alias("name"), F.struct(F.lit(1).alias("kind"), "pos").alias("at"))
    return by_ticker.unionByName(by_cik).groupBy("cik").agg(F.min_by("name", "at").alias("name"), F.min("at").alias("at")).select("cik", "name", "at")


def daily_index_url(day: Column) -> Column:
    """Where a day's index lies."""
    return F.format_string(INDEX_URL, F.date_format(day, "yyyy"), F.quarter(day), F.date_format(day, "yyyyMMdd"))
