"""Ownership filings: the XML block of a submission, its envelope, its lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import padded

#: Fields of the document, each read as written, with any elements inside.
_LINE = "securityTitle string, transactionDate string, transactionCoding struct<transactionCode: string>, transactionAmounts struct<transactionShares: string, transactionPricePerShare: string, transactionAcquiredDisposedCode: string>, postTransactionAmounts struct<sharesOwnedFollowingTransaction: string>, ownershipNature struct<directOrIndirectOwnership: string>"
_DERIVATIVE = _LINE + ", conversionOrExercisePrice string, exerciseDate string, expirationDate string, underlyingSecurity struct<underlyingSecurityTitle: string, underlyingSecurityShares: string>"


def _struct(fields: str) -> str:
    """A flat list of fields as the inside of a struct type."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(fields + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(fields[start:i].strip().replace(" ", ": ", 1))
            start = i + 1
    return "struct<" + ", ".join(out) + ">"


SCHEMA = (
    "periodOfReport string, aff10b5One string, notSubjectToSection16 string, issuer struct<issuerCik: string, issuerName: string, issuerTradingSymbol: string>, "
    "reportingOwner array<struct<reportingOwnerId: struct<rptOwnerCik: string, rptOwnerName: string>, reportingOwnerRelationship: struct<isDirector: string, isOfficer: string, isTenPercentOwner: string, isOther: string, officerTitle: string>>>, "
    f"nonDerivativeTable struct<nonDerivativeTransaction: array<{_struct(_LINE)}>>, derivativeTable struct<derivativeTransaction: array<{_struct(_DERIVATIVE)}>>"
)


def ownership_xml(text: Column) -> Column:
    """The block from the opening to the closing tag; null where a submission has none."""
    opening, closing = "<ownershipDocument>", "</ownershipDocument>"
    tail = F.substring(text, F.locate(opening, text), F.lit(2**31 - 1))  # by places, as a pattern walks every character
    cut = lambda t: F.when(F.contains(text, F.lit(opening)) & F.contains(t, F.lit(closing)), F.concat(F.substring_index(t, closing, 1), F.lit(closing)))
    return F.transform(F.array(tail), cut)[0]  # so that the tail is made once


def value(raw: Column) -> Column:
    """A field's text, that of its ``value`` element if it has one; null if blank."""
    inner = F.regexp_extract(raw, r"(?s)<value>(.*?)</value>", 1)
    plain = F.regexp_replace(raw, r"(?s)<.*", "")
    return F.nullif(F.trim(F.when(F.contains(raw, F.lit("<value>")), inner).otherwise(plain), F.lit(" \t\r\n")), F.lit(""))


def flag(raw: Column) -> Column:
    """True for 1 and true, in any case; else false."""
    return F.coalesce(F.lower(value(raw)).isin("1", "true"), F.lit(False))


def number(raw: Column) -> Column:
    """A number; null for what isn't one."""
    return value(raw).try_cast("double")


def parsed(submissions: DataFrame) -> DataFrame:
    """Adds ``parsed`` to submissions (accession_number, text): whether the text holds an ownership document with an issuer's and an owner's number; and its fields.

    The envelope is there for every submission, with null fields where it isn't parsed. Of several owners the first counts.
    """
    doc = F.from_xml(ownership_xml(F.col("text")), F.lit(SCHEMA), {"mode": "PERMISSIVE", "rowTag": "ownershipDocument"})
    d = submissions.select("*", F.explode(F.array(doc)).alias("d"))  # a generator's output isn't copied into what uses it, so a document is parsed once
    owner = F.get("d.reportingOwner", F.lit(0))
    role = owner["reportingOwnerRelationship"]
    d = d.withColumns({"issuer_cik": padded(value(F.col("d.issuer.issuerCik"))), "owner_cik": padded(value(owner["reportingOwnerId"]["rptOwnerCik"]))})
    ok = F.col("issuer_cik").isNotNull() & F.col("owner_cik").isNotNull()
    of = lambda c: F.when(ok, c)
    text = lambda c: F.coalesce(value(c), F.lit(""))
    return d.select(
        *submissions.columns, ok.alias("parsed"), of(value(F.col("d.periodOfReport"))).alias("period_of_report"), of(F.col("issuer_cik")).alias("issuer_cik"), of(text(F.col("d.issuer.issuerName"))).alias("issuer_name"),
        of(value(F.col("d.issuer.issuerTradingSymbol"))).alias("issuer_ticker"), of(F.col("owner_cik")).alias("owner_cik"), of(text(owner["reportingOwnerId"]["rptOwnerName"])).alias("owner_name"),
        of(flag(role["isDirector"])).alias("is_director"), of(flag(role["isOfficer"])).alias("is_officer"), of(flag(role["isTenPercentOwner"])).alias("is_ten_percent_owner"), of(flag(role["isOther"])).alias("is_other"),
        of(value(role["officerTitle"])).alias("officer_title"), of(flag(F.col("d.aff10b5One"))).alias("is_10b5_1"), of(flag(F.col("d.notSubjectToSection16"))).alias("not_subject_to_section16"),
        F.when(ok, F.coalesce(F.col("d.nonDerivativeTable.nonDerivativeTransaction"), F.array())).alias("lines"), F.when(ok, F.coalesce(F.col("d.derivativeTable.derivativeTransaction"), F.array())).alias("derivative_lines"),
    )


WHO = ["accession_number", "period_of_report", "issuer_cik", "issuer_name", "issuer_ticker", "owner_cik", "owner_name", "is_director", "is_officer", "is_ten_percent_owner", "is_other", "officer_title", "is_10b5_1", "not_subject_to_section16"]


def envelopes(filings: DataFrame) -> DataFrame:
    """One row for each submission of ``parsed``, parsed or not, with the numbers of its lines."""
    size = lambda c: F.when(F.col("parsed"), F.size(c)).otherwise(0)
    return filings.select(*WHO, "parsed", size("lines").alias("non_derivative_count"), size("derivative_lines").alias("derivative_count"))


def _line(t: Column) -> dict[str, Column]:
    amounts = t["transactionAmounts"]
    shares, price = number(amounts["transactionShares"]), number(amounts["transactionPricePerShare"])
    return {
        "security_title": value(t["securityTitle"]), "transaction_date": value(t["transactionDate"]), "transaction_code": value(t["transactionCoding"]["transactionCode"]), "acquired_disposed": value(amounts["transactionAcquiredDisposedCode"]),
        "shares": shares, "price_per_share": price, "transaction_value": shares * price, "shares_owned_following": number(t["postTransactionAmounts"]["sharesOwnedFollowingTransaction"]), "direct_or_indirect": value(t["ownershipNature"]["directOrIndirectOwnership"]),
    }


def transactions(filings: DataFrame) -> DataFrame:
    """A row for each line (txn_seq from 0) that isn't a derivative's; the value is shares times price, null if either is."""
    rows = filings.select(*WHO, F.posexplode("lines").alias("txn_seq", "t"))
    return rows.select(*WHO, "txn_seq", *[c.alias(k) for k, c in _line(F.col("t")).items()])


def derivative_transactions(filings: DataFrame) -> DataFrame:
    """A row for each derivative's line, with its terms and the underlying security."""
    t = F.col("t")
    more = {
        "conversion_exercise_price": number(t["conversionOrExercisePrice"]), "exercise_date": value(t["exerciseDate"]), "expiration_date": value(t["expirationDate"]),
        "underlying_security_title": value(t["underlyingSecurity"]["underlyingSecurityTitle"]), "underlying_shares": number(t["underlyingSecurity"]["underlyingSecurityShares"]),
    }
    rows = filings.select(*WHO, F.posexplode("derivative_lines").alias("txn_seq", "t"))
    return rows.select(*WHO, "txn_seq", *[c.alias(k) for k, c in (_line(t) | more).items()])
