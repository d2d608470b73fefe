"""The governed menu of event types: leaves, domains, versions and their snapshots."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The version of the menu, the leaves of each domain in the menu's order within it, and items that carry no event of their own.
VERSION = "v1.3"
DOMAINS = {
    "governance": ("exec_departure", "exec_appointment", "exec_compensation", "auditor_change", "shareholder_vote_results", "governance_other"),
    "financial": ("earnings_release", "restatement", "material_impairment", "covenant_breach", "dilutive_issuance", "debt_issuance", "dividend_distribution", "financial_other"),
    "operational": ("ma_activity", "workforce_reduction", "operational_other"),
    "legal": ("material_litigation", "cybersecurity_incident", "legal_other"),
    "terminal": ("going_concern", "delisting_risk", "bankruptcy_filing", "terminal_other"),
    "catchall": ("other_material",),
    "periodic": ("periodic_annual", "periodic_quarterly", "periodic_interim", "periodic_report"),
}
NON_SUBSTANTIVE_ITEMS = ("9.01",)


def menu(spark: SparkSession, descriptions: dict[str, str] | None = None) -> DataFrame:
    """leaf, domain and description of every event type."""
    d = descriptions or {}
    return spark.createDataFrame([(leaf, domain, d.get(leaf)) for domain, leaves in DOMAINS.items() for leaf in leaves], "leaf string, domain string, description string")


def domain_of(leaf: Column) -> Column:
    """The one domain of a leaf; null for none."""
    out = F.lit(None).cast("string")
    for domain, leaves in DOMAINS.items():
        out = F.when(leaf.isin(*leaves), domain).otherwise(out)
    return out


def offered(leaves: DataFrame, form: str) -> DataFrame:
    """The leaves offered for a form: those of periodic reports for a 6-K alone."""
    return leaves if form == "6-K" else leaves.where("domain <> 'periodic'")


def event_sections(classified: DataFrame, leaf: str = "event_type") -> DataFrame:
    """Classified sections that can become events: not those of the periodic domain, which are put off."""
    return classified.where(F.coalesce(domain_of(F.col(leaf)) != "periodic", F.lit(True)))


def substantive(items: DataFrame, number: str) -> DataFrame:
    """Items that may carry an event."""
    return items.where(~F.col(number).isin(*NON_SUBSTANTIVE_ITEMS))


def content_hash(leaves: DataFrame) -> str:
    """A hash of the menu's content, whatever the order of its rows and its version. The menu is a few dozen rows."""
    rows = [tuple(r) for r in leaves.select("leaf", "description", "domain").collect()]
    key = lambda r: tuple(x or "" for x in r)
    content = {"domains": sorted({r[2] for r in rows}), "leaves": sorted(rows, key=key)}
    return hashlib.sha256(json.dumps(content, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def snapshot(versions: DataFrame, leaves: DataFrame, version: str, asof: str) -> tuple[DataFrame, DataFrame]:
    """Rows to append to the versions (taxonomy_version, major, minor, content_hash, cut_at) and to their leaves; none if the version is there already.

    A version that is there with other content is an error: a label stands for one menu.
    """
    spark, digest = leaves.sparkSession, content_hash(leaves)
    known = [r["content_hash"] for r in versions.where(F.col("taxonomy_version") == version).select("content_hash").collect()]
    if known and known[0] != digest:
        raise ValueError(f"taxonomy {version} was cut with other content")
    major, minor = (int(x) for x in version.lstrip("v").split("."))
    row = spark.createDataFrame([] if known else [(version, major, minor, digest, asof)], "taxonomy_version string, major int, minor int, content_hash string, cut_at string")
    return row.withColumn("cut_at", F.col("cut_at").cast("timestamp")), leaves.where(F.lit(not known)).withColumn("taxonomy_version", F.lit(version))


def leaves_of(cut: DataFrame, version: str) -> DataFrame:
    """The menu as it was at a version."""
    return cut.where(F.col("taxonomy_version") == version).select("leaf", "description", "domain")
