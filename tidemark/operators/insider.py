"""Insider transactions: pulse, trades, clusters of buyers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import any_date
from tidemark.operators.current import first_n


def pulse(trades: DataFrame, asof: Column, days: int) -> DataFrame:
    """Per issuer: value, number and people of open-market buys (P) and sales (S) since ``days`` before asof. No upper bound; a null value counts as 0."""
    rows = trades.where(any_date("transaction_date") >= F.date_sub(asof, days))

    def of(code, name):
        here = F.col("transaction_code") == code
        return [F.coalesce(F.sum(F.when(here, F.coalesce("transaction_value", F.lit(0.0)))), F.lit(0.0)).alias(f"{name}_value"), F.count_if(here).alias(f"{name}_count"), F.count_distinct(F.when(here, F.col("owner_cik"))).alias(f"{name}_people")]

    return rows.groupBy("issuer_cik").agg(*of("P", "buy"), *of("S", "sell")).withColumn("has_activity", F.col("buy_count") + F.col("sell_count") > 0)


def recent_trades(trades: DataFrame, n: int) -> DataFrame:
    """Newest n trades of each issuer with the owner's role."""
    return first_n(trades.withColumn("role", role()), ["issuer_cik"], n, any_date("transaction_date").desc_nulls_last(), F.col("accession_number").desc(), F.col("txn_seq"))


def role() -> Column:
    """Officer's title, else director, ten-percent owner, other; empty if none."""
    return F.coalesce(F.when(F.col("is_officer") & (F.coalesce("officer_title", F.lit("")) != ""), F.col("officer_title")), F.when(F.col("is_officer"), "Officer"), F.when(F.col("is_director"), "Director"), F.when(F.col("is_ten_percent_owner"), "10% owner"), F.when(F.col("is_other"), "Other"), F.lit(""))


def clusters(trades: DataFrame, asof: Column, days: int, min_value: float, people: int = 2) -> DataFrame:
    """Issuers with at least ``people`` different buyers and min_value bought in the window, largest value first."""
    date = any_date("transaction_date")
    rows = trades.where((F.col("transaction_code") == "P") & (date >= F.date_sub(asof, days)))
    ticker = F.when(~F.upper("issuer_ticker").isin("N/A", "NONE"), F.col("issuer_ticker"))
    out = rows.groupBy("issuer_cik").agg(F.max("issuer_name").alias("issuer_name"), F.coalesce(F.max(ticker), F.lit("")).alias("issuer_ticker"), F.count_distinct("owner_cik").alias("buyers"), F.count("*").alias("trades"), F.sum(F.coalesce("transaction_value", F.lit(0.0))).alias("value"), F.min(date).alias("first_trade"), F.max(date).alias("last_trade"))
    return out.where((F.col("buyers") >= people) & (F.col("value") >= min_value)).orderBy(F.desc("value"), "issuer_cik")
