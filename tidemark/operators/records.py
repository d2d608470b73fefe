"""Records that judges and reducers return as JSON, read with every field brought into its range; and the texts that they are given.

A field that can't be read doesn't lose its record: it takes the value stated here. Text that isn't JSON gives a record of these values.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import clamped, coerced, quote_is_grounded, slug

# Governed words. The first list's last word and the others' defaults stand for words that aren't in them.
DIRECTIONS, HEADLINES, INTENSITIES = ("worse", "eased", "neutral"), ("worsening", "easing", "mixed", "stable"), ("major", "moderate", "minor", "none")
JUDGED_FROM = 0.6


def field(raw: Column, name: str) -> Column:
    """A field's text, null if it is absent or null."""
    return F.get_json_object(raw, f"$.{name}")


def flag(raw: Column, name: str) -> Column:
    return F.coalesce(F.lower(field(raw, name)) == "true", F.lit(False))


def whole(raw: Column, name: str, default) -> Column:
    """A whole number, cut off towards zero; the default for truth values and what isn't a number."""
    text = F.trim(field(raw, name))
    n = F.when(~F.lower(text).isin("true", "false"), text.try_cast("double"))
    return F.coalesce(F.when(~F.isnan(n) & (F.abs(n) < 2**31), n.cast("int")), F.lit(default).cast("int"))


def share(raw: Column, name: str) -> Column:
    """Confidence between 0 and 1; 0.5 for what isn't a number."""
    return clamped(F.when(~F.lower(field(raw, name)).isin("true", "false"), field(raw, name)))


def listed(raw: Column, name: str, element: str) -> Column:
    """A list of records as JSON texts; empty for what isn't a list."""
    parts = lambda text: F.coalesce(F.when(text.startswith("["), F.from_json(text, "array<string>")), F.array().cast("array<string>"))
    return F.transform(F.array(field(raw, name)), parts)[0]  # the field is taken out once


def verdict(raw: Column, categories: tuple[str, ...]) -> Column:
    """is_material, confidence, category (other), direction (neutral), explanation and needs_review of a judgement of one change."""
    sure = share(raw, "confidence")
    return F.struct(flag(raw, "is_material").alias("is_material"), sure.alias("confidence"), coerced(F.coalesce(field(raw, "category"), F.lit("")), categories, "other").alias("category"), coerced(F.coalesce(field(raw, "direction"), F.lit("")), DIRECTIONS, "neutral").alias("direction"), F.coalesce(field(raw, "explanation"), F.lit("")).alias("explanation"), (sure < JUDGED_FROM).alias("needs_review"))


def effects(raw: Column, name: str = "top_effects") -> Column:
    """Effects as a list of texts: a list as it is; one text split at <item> marks, else at line breaks and semicolons, without marks and bullets."""
    text = field(raw, name)
    items = F.regexp_extract_all(text, F.lit("(?is)<item>(.*?)</item>"), F.lit(1))
    parts = F.when(F.size(items) > 0, items).otherwise(F.split(text, "[\n;]+"))
    plain = F.transform(parts, lambda x: F.trim(F.regexp_replace(F.trim(F.regexp_replace(x, "<[^>]+>", "")), "^[-*•]+", "")))
    own = F.transform(F.from_json(text, "array<string>"), lambda x: F.trim(x))
    return F.filter(F.coalesce(F.when(text.startswith("["), own), plain, F.array().cast("array<string>")), lambda x: x != "")


def synthesis(raw: Column) -> Column:
    """headline_direction (mixed), headline_intensity (moderate), thesis and top_effects of a filing's changes."""
    return F.struct(coerced(F.coalesce(field(raw, "headline_direction"), F.lit("")), HEADLINES, "mixed").alias("headline_direction"), coerced(F.coalesce(field(raw, "headline_intensity"), F.lit("")), INTENSITIES, "moderate").alias("headline_intensity"), F.coalesce(field(raw, "thesis"), F.lit("")).alias("thesis"), effects(raw).alias("top_effects"))


def standing(raw: Column) -> Column:
    """thesis and top_effects of a filing whose risks stand as they were; its direction and intensity aren't judged but set."""
    return F.struct(F.lit("stable").alias("headline_direction"), F.lit("none").alias("headline_intensity"), F.coalesce(field(raw, "thesis"), F.lit("")).alias("thesis"), effects(raw).alias("top_effects"))


def catalog(raw: Column) -> Column:
    """Themes (theme_slug, archetype, prevalence of 0 or more) as a list; empty for what isn't a list."""
    one = lambda x: F.struct(slug(F.coalesce(field(x, "theme_slug"), F.lit(""))).alias("theme_slug"), F.coalesce(field(x, "archetype"), F.lit("")).alias("archetype"), F.greatest(F.lit(0), whole(x, "prevalence", 0)).alias("prevalence"))
    return F.transform(listed(raw, "themes", ""), one)


def specificity(raw: Column) -> Column:
    """Verdicts (change_index, 0 if it can't be read; is_specific; matched_theme, null if empty; confidence; explanation) as a list.

    Each field is taken out of a verdict's text once, each number read once: Spark evaluates what a lambda repeats as often as it stands there.
    """
    text = lambda x, n: F.coalesce(field(x, n), F.lit(""))
    cut = lambda x: F.struct(field(x, "change_index").try_cast("double").alias("n"), flag(x, "is_specific").alias("is_specific"), slug(text(x, "matched_theme")).alias("theme"), field(x, "confidence").try_cast("double").alias("sure"), text(x, "explanation").alias("explanation"))
    index = lambda n: F.coalesce(F.when(~F.isnan(n) & (F.abs(n) < 2**31), n.cast("int")), F.lit(0))  # noqa: E731  truth values aren't numbers
    sure = lambda n: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.when(~F.isnan(n), n), F.lit(0.5))))
    one = lambda x: F.struct(index(x["n"]).alias("change_index"), x["is_specific"].alias("is_specific"), F.nullif(x["theme"], F.lit("")).alias("matched_theme"), sure(x["sure"]).alias("confidence"), x["explanation"].alias("explanation"))
    return F.transform(F.transform(listed(raw, "verdicts", ""), cut), one)


def realization(raw: Column) -> Column:
    """is_realized, event_index (null if it can't be read), quote, evidence and confidence."""
    text = lambda n: F.coalesce(field(raw, n), F.lit("")).alias(n)
    return F.struct(flag(raw, "is_realized").alias("is_realized"), whole(raw, "event_index", None).alias("event_index"), text("quote"), text("evidence"), share(raw, "confidence").alias("confidence"))


def classification(raw: Column, leaves: tuple[str, ...]) -> Column:
    """event_type (null if it isn't one of those offered: no record), is_material, confidence and reasoning of one section."""
    leaf = field(raw, "event_type")
    return F.struct(F.when(leaf.isin(*leaves), leaf).alias("event_type"), flag(raw, "is_material").alias("is_material"), share(raw, "confidence").alias("confidence"), F.coalesce(field(raw, "reasoning"), F.lit("")).alias("reasoning"))


def reduced_events(raw: Column) -> Column:
    """Events (event_type, is_material, confidence, summary, anchor_item_number, contributing_item_numbers) as a list."""
    one = lambda x: F.struct(field(x, "event_type").alias("event_type"), flag(x, "is_material").alias("is_material"), share(x, "confidence").alias("confidence"), F.coalesce(field(x, "summary"), F.lit("")).alias("summary"), field(x, "anchor_item_number").alias("anchor_item_number"), F.coalesce(F.from_json(field(x, "contributing_item_numbers"), "array<string>"), F.array().cast("array<string>")).alias("contributing_item_numbers"))
    return F.transform(listed(raw, "events", ""), one)


def is_grounded(v: Column, events: Column) -> Column:
    """Whether a realization holds against its events (an array of summary, source_text): not realized, or its event exists and has the quote in its text (in its summary without a text)."""
    event = F.get(events, v["event_index"] - 1)
    source = F.coalesce(F.nullif(F.trim(event["source_text"]), F.lit("")), event["summary"])
    cited = F.coalesce((v["event_index"] >= 1) & (v["event_index"] <= F.size(events)), F.lit(False))
    return ~v["is_realized"] | (cited & quote_is_grounded(v["quote"], source))


def content_hash(themes: list[tuple[str, str]]) -> str:
    """A catalog's content: its slugs and archetypes, whatever their order and prevalence. The first of equal slugs counts, empty ones don't."""
    first: dict[str, str] = {}
    for name, archetype in themes:
        if name:
            first.setdefault(name, archetype)
    return hashlib.sha256(json.dumps([[k, first[k]] for k in sorted(first)], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def catalog_version(extractor: str, themes: list[tuple[str, str]]) -> str:
    """Who cut a catalog and what is in it."""
    return f"{extractor}-{content_hash(themes)[:8]}"


# Texts for judges. Their wording is a parameter of whoever calls a judge; what data they hold, and in which order, is set here.


def change_text(change_type: Column, current: Column, prior: Column) -> Column:
    """What a judge reads of a change: both texts of a changed block, the one there is of an added or dropped block; any other type is an error."""
    c, p = F.coalesce(current, F.lit("")), F.coalesce(prior, F.lit(""))
    both = F.concat(F.lit("PRIOR YEAR:\n"), p, F.lit("\n\nTHIS YEAR:\n"), c)
    return F.when(change_type == "changed", both).when(change_type == "added", F.concat(F.lit("NEWLY ADDED:\n"), c)).when(change_type == "dropped", F.concat(F.lit("REMOVED (prior year):\n"), p)).otherwise(F.raise_error(F.concat(F.lit("unknown change_type "), F.coalesce(change_type, F.lit("null")))))


def lines(rows: DataFrame, keys: list[str], line: Column, *order: str) -> DataFrame:
    """Each key's lines in order as one text."""
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))), lambda s: s["_line"]), "\n").alias("text"))


def finding(category: Column, direction: Column, explanation: Column) -> Column:
    return F.format_string("- [%s | %s] %s", category, direction, explanation)


def theme_line(name: Column, archetype: Column) -> Column:
    return F.format_string("- %s: %s", name, archetype)


def numbered(position: Column, category: Column, explanation: Column) -> Column:
    """A change as the specificity judge reads it, numbered from 1."""
    return F.format_string("%d. [%s] %s", position, category, explanation)


def event_block(position: Column, day: Column, event_type: Column, item: Column, summary: Column, source: Column, head: str = "Text:") -> Column:
    """A later event as the realization judge reads it: numbered from 1, with its item and, after head, its text if it has them."""
    own = F.trim(F.coalesce(source, F.lit("")))
    of_item = F.when(F.coalesce(item, F.lit("")) != "", F.concat(F.lit(" (item "), item, F.lit(")"))).otherwise("")
    text = F.when(own != "", F.concat(F.lit(f"\n  {head} "), own)).otherwise("")
    return F.concat(position.cast("string"), F.lit(". ["), day.cast("string"), F.lit("] "), event_type, of_item, F.lit(": "), summary, text)


def source_text(sections: Column, item: Column, body: Column, most: int = 4000) -> Column:
    """The text that an event may be quoted from: its item's sections, else all sections, else the body; parts without text don't count, the whole is cut."""
    parts = F.filter(F.coalesce(sections, F.array().cast("array<struct<number:string,title:string,text:string>>")), lambda s: F.trim(s["text"]) != "")
    own = F.filter(parts, lambda s: F.coalesce(item, F.lit("")).eqNullSafe(s["number"]) & (F.coalesce(item, F.lit("")) != ""))
    texts = lambda a: F.transform(a, lambda s: F.trim(s["text"]))
    chosen = F.when(F.size(own) > 0, texts(own)).when(F.size(parts) > 0, texts(parts)).otherwise(F.array(F.trim(F.coalesce(body, F.lit("")))))
    return F.substring(F.array_join(chosen, "\n\n"), 1, most)


def section_message(form: Column, company: Column, cik: Column, ticker: Column, day: Column, unit: Column, title: Column, text: Column, exhibits: Column, heads: tuple[str, str, str] = ("Part: ", "Whole report:", "Whole filing:")) -> Column:
    """What the classifier reads of one section: the filing, the section's name (an exhibit's for a 6-K, an item's else; none for a whole filing), its text cut to the form's cap, and the exhibits as context.

    heads are the words before a section's name, before a 6-K's body and before another filing's.
    """
    six = form == "6-K"
    filing = F.format_string("%s, CIK %s, %s\n%s of %s\n", company, cik, F.coalesce(ticker, F.lit("no ticker")), form, day.cast("string"))
    named = F.concat(F.when(six, "Exhibit ").otherwise("Item "), unit, F.coalesce(F.concat(F.lit(": "), title), F.lit("")))
    section = F.when(unit.isNotNull(), F.concat(F.lit(heads[0]), named)).when(six, heads[1]).otherwise(heads[2])
    body = F.substring(F.coalesce(text, F.lit("")), F.lit(1), F.when(six, 20_000).otherwise(12_000))
    more = F.coalesce(exhibits, F.lit(""))
    return F.concat_ws("\n\n", F.concat(filing, section), body, F.when(more != "", more))


def reduce_line(form: Column, unit: Column, title: Column, event_type: Column, material: Column, confidence: Column, reasoning: Column) -> Column:
    """A classified section as the reducer reads it."""
    name = F.concat(F.when(form == "6-K", "Exhibit ").otherwise("Item "), unit, F.coalesce(F.concat(F.lit(" ("), title, F.lit(")")), F.lit("")))
    return F.concat(F.lit("\n"), name, F.lit(" — "), event_type, F.when(material, ", material").otherwise(", non-material"), F.format_string(", confidence %.2f\n  ", confidence), reasoning)
