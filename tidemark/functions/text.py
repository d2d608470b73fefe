"""Text functions, all in the JVM unless they say otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import winnow

# Phrases that flag a risk in text that is cut off.
RED_FLAGS = ("going concern", "material weakness", "restatement", "restate its", "event of default", "covenant breach", "breach of covenant", "acceleration of", "bankruptcy", "chapter 11", "delisting", "delist", "subpoena", "investigation", "sec inquiry", "fraud", "class action", "impairment charge")


def squeeze(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def block_hash(text: Column) -> Column:
    """Equal if and only if two blocks have the same words in the same order, whatever the white space."""
    return F.sha2(squeeze(text), 256)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def grounding_form(text: Column) -> Column:
    """Text without page-break marks, with single spaces, in lower case."""
    return F.lower(squeeze(F.regexp_replace(text, r"(?i)\d+\s*table of contents", " ")))


def quote_is_grounded(quote: Column, source: Column, least: int = 12) -> Column:
    """Whether a quote of at least ``least`` characters occurs in its source; false for nulls."""
    q = grounding_form(quote)
    return F.coalesce((F.length(q) >= least) & F.contains(grounding_form(source), q), F.lit(False))


def grounded_quotes(texts: DataFrame, key: str, quotes: DataFrame, quote_key: str, least: int = 12) -> DataFrame:
    """(key, quote_key) of every quote of at least ``least`` characters that a text holds. Both tables have a column ``text``; nulls hold nothing and are held by nothing.

    Texts and quotes meet by winnowed fingerprints (see winnow): a quote by that of its own which the fewest texts have. Texts give only fingerprints that some quote
    has, by a filter of bounded size, and come back once, for the pairs that are left. The index runs in Arrow batches, the rest in the JVM.
    """
    q = quotes.select(F.col(quote_key), grounding_form(F.col("text")).alias("_q")).where(F.length("_q") >= least)
    wanted = winnow.indexed(q, quote_key, "_q", least).distinct()
    t = texts.select(F.col(key), grounding_form(F.col("text")).alias("_t"))
    held = winnow.indexed(t, key, "_t", least, winnow.filter_of(wanted)).distinct()
    often = held.groupBy("g").agg(F.count("*").alias("_n"))
    rarest = wanted.join(often, "g").groupBy(quote_key).agg(F.min_by("g", F.struct("_n", "g")).alias("g"), F.count("*").alias("_found"))
    complete = wanted.groupBy(quote_key).agg(F.count("*").alias("_all"))  # a quote of which no text has some fingerprint is in none
    rarest = rarest.join(complete, quote_key).where("_found = _all").select(quote_key, "g")
    pairs = held.join(rarest, "g").select(key, quote_key)
    found = pairs.join(q, quote_key).join(texts.select(key, "text"), key)
    return found.where(F.contains(grounding_form(F.col("text")), F.col("_q"))).select(key, quote_key)


def terms_in(text: Column, terms: tuple[str, ...] = RED_FLAGS) -> Column:
    """The terms that a text contains, in their order."""
    low = F.lower(text)
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, t))


def split_items(text: Column) -> Column:
    """Parts of a comma-separated field, trimmed, without empty ones; none for null."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def padded(number: Column, width: int = 10) -> Column:
    """Digits with leading zeros; null if not a number."""
    return F.lpad(number.cast("string").try_cast("long").cast("string"), width, "0")


def excerpt(text: Column, most: int = 200) -> Column:
    """At most ``most`` bytes of UTF-8, cut back to a space (else to a whole character), with an ellipsis if cut."""
    head = F.substring(F.encode(text, "UTF-8"), 1, most + 1)
    goes_on = lambda k: F.conv(F.hex(F.substring(head, most + 1 - k, 1)), 16, 10).cast("int").between(0x80, 0xBF)  # noqa: E731  whether a cut of k bytes less would split a character
    whole = F.lit(most - 3)
    for k in (2, 1, 0):
        whole = F.when(~goes_on(k), most - k).otherwise(whole)
    short = F.decode(F.substring(head, F.lit(1), whole), "UTF-8")
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.coalesce(F.nullif(F.regexp_extract(short, r"(?s)^(.*)\s", 1), F.lit("")), short), F.lit("…")))


def first_sentence(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)^(.*?[.!?])(\s|$)", 1)


def coerced(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    """A value of a governed vocabulary, else the default."""
    v = F.lower(F.trim(value))
    return F.when(v.isin(*allowed), v).otherwise(default)


def clamped(value: Column, default: float = 0.5) -> Column:
    """A share between 0 and 1; the default for what isn't a number."""
    v = value.cast("string").try_cast("double")
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.when(~F.isnan(v), v), F.lit(default))))


def compact_usd(value: Column) -> Column:
    """$1.2M, $3.4K, $56."""
    a = F.abs(value)
    return F.when(a >= 1e9, F.concat(F.lit("$"), F.format_number(value / 1e9, 1), F.lit("B"))).when(a >= 1e6, F.concat(F.lit("$"), F.format_number(value / 1e6, 1), F.lit("M"))).when(a >= 1e3, F.concat(F.lit("$"), F.format_number(value / 1e3, 1), F.lit("K"))).otherwise(F.concat(F.lit("$"), F.format_number(value, 0)))
