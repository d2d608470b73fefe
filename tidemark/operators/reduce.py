"""Guards of the map/reduce classification: grounding, subsumption, budgets, rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grounded(anchor: Column, items: Column, known: Column) -> tuple[Column, Column]:
    """Anchor and items that exist in the filing: invented items go, a lost anchor moves to the first item left and the anchor stands first.

    No items left: null and an empty list, to be dropped by the caller.
    """
    real = F.array_distinct(F.filter(items, lambda i: F.array_contains(known, i)))
    new = F.when(F.array_contains(known, anchor), anchor).otherwise(F.get(real, F.lit(0)))
    return new, F.when(new.isNull(), F.array().cast("array<string>")).otherwise(F.concat(F.array(new), F.filter(real, lambda i: i != new)))


def subsumed(events: DataFrame, group: str, key: str, items: str) -> DataFrame:
    """(group, key) of events whose item set is part of another's in the group, or equal to that of a smaller key.

    A set is looked for where its rarest item is: whoever holds the set holds that item, so candidates are its holders alone, not all pairs of the group. Sets without items are part of
    any other. Null groups, keys and sets are part of none.
    """
    rows = events.select(F.col(group).alias("_g"), F.col(key).alias("_k"), F.array_distinct(items).alias("_i"))
    each = rows.select("_g", "_k", "_i", F.explode("_i").alias("_x"))
    often = each.groupBy("_g", "_x").agg(F.count("*").alias("_n"))
    rare = each.join(often, ["_g", "_x"]).groupBy("_g", "_k").agg(F.min_by("_x", F.struct("_n", "_x")).alias("_x"), F.first("_i").alias("_a"))
    held = each.select("_g", "_x", F.col("_k").alias("_other"), F.col("_i").alias("_b"))
    met = rare.join(held, ["_g", "_x"]).where("_k <> _other and size(_a) <= size(_b) and size(array_except(_a, _b)) = 0 and (size(_a) < size(_b) or _other < _k)")
    sizes = rows.where("_g is not null").groupBy("_g").agg(F.max(F.size("_i")).alias("_most"), F.min(F.when(F.size("_i") == 0, F.col("_k"))).alias("_least"))
    none = rows.where(F.size("_i") == 0).join(sizes, "_g").where("_most > 0 or _least < _k")
    return met.select("_g", "_k").unionByName(none.select("_g", "_k")).distinct().select(F.col("_g").alias(group), F.col("_k").alias(key))


def maximal(events: DataFrame, group: str, key: str, items: str) -> DataFrame:
    """Events whose item set isn't part of another's in the group; of equal sets that with the smallest key stays."""
    return events.join(subsumed(events, group, key, items), [group, key], "left_anti")


def over_emitted(events: DataFrame, group: str, key: str, items: str) -> DataFrame:
    """Events that ``maximal`` would drop: none is the healthy state."""
    return events.join(subsumed(events, group, key, items), [group, key], "left_semi")


def within_budget(rows: DataFrame, group: list[str], order: str, size: Column, budget: int) -> DataFrame:
    """Adds used and dropped: of each row's size what still fits into its group's budget, in order; later rows are dropped whole."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_size", size).withColumn("_before", F.coalesce(F.sum("_size").over(w), F.lit(0)))
    used = F.greatest(F.lit(0), F.least("_size", F.lit(budget) - F.col("_before"))).cast("long")
    return rows.withColumn("used", used).withColumn("dropped", (F.col("_size") - F.col("used")).cast("long")).drop("_size", "_before")


def within_budget_in_ranges(rows: DataFrame, group: str, order: str, size: Column, budget: int, width: int) -> DataFrame:
    """Adds before (what the group's earlier rows hold), used and dropped, as ``within_budget`` does, for groups of any size: sums within ranges of ``width`` of the
    (whole-numbered) order, then sums of the ranges' totals, so that no task holds a group."""
    own = rows.withColumns({"_size": size, "_range": F.floor(F.col(order) / width)})
    totals = own.groupBy(F.col(group).alias("_g"), F.col("_range").alias("_r")).agg(F.sum("_size").alias("_t"))
    back = Window.unboundedPreceding, -1
    base = totals.withColumn("_base", F.coalesce(F.sum("_t").over(Window.partitionBy("_g").orderBy("_r").rowsBetween(*back)), F.lit(0))).drop("_t")
    local = F.coalesce(F.sum("_size").over(Window.partitionBy(group, "_range").orderBy(order).rowsBetween(*back)), F.lit(0))
    out = own.withColumn("_local", local).join(base, F.col(group).eqNullSafe(F.col("_g")) & F.col("_range").eqNullSafe(F.col("_r")))
    out = out.withColumn("before", (F.col("_base") + F.col("_local")).cast("long"))
    out = out.withColumn("used", F.greatest(F.lit(0), F.least("_size", F.lit(budget) - F.col("before"))).cast("long"))
    return out.withColumn("dropped", (F.col("_size") - F.col("used")).cast("long")).select(*rows.columns, "before", "used", "dropped")


def joined_text(rows: DataFrame, key: str, order: str, text: str, most: int) -> DataFrame:
    """Per key the rows' texts in order, joined by a blank line: rows are taken until ``most`` characters are reached (separators don't count), then the whole is cut."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    taken = rows.withColumn("_b", F.coalesce(F.sum(F.length(text)).over(w), F.lit(0))).where(F.col("_b") < most)
    parts = F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda s: s[text])
    return taken.groupBy(key).agg(F.substring(F.array_join(parts, "\n\n"), 1, most).alias("text"), F.count("*").alias("parts"))


def first_valid(rows: DataFrame, group: list[str], index: str, order: str, size: str) -> DataFrame:
    """The first verdict for each index from 1 to the group's size; others go."""
    ok = rows.where(F.col(index).between(1, F.col(size)))
    return ok.groupBy(*group, index).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in (*group, index)]), order).alias("_r")).select(*group, index, "_r.*")


def canonical(rows: DataFrame, slug: Column, order: str) -> DataFrame:
    """The first row of each non-empty slug, sorted by it."""
    return rows.withColumn("slug", slug).where("slug <> ''").groupBy("slug").agg(F.min_by(F.struct(*rows.columns), order).alias("_r")).select("slug", "_r.*").orderBy("slug")


def rolled_up(rows: DataFrame, leaf: str, domains: DataFrame, default: str = "other") -> DataFrame:
    """Adds each leaf's domain from the governed menu (leaf, domain; a fixed list), the default for unknown ones."""
    return rows.join(F.broadcast(domains.select(F.col("leaf").alias(leaf), "domain")), leaf, "left").withColumn("domain", F.coalesce("domain", F.lit(default)))


def sections_of(filings: DataFrame, caps: dict[str, int], least: int = 200, skip: tuple[str, ...] = ("9.01",)) -> DataFrame:
    """Sections to label: a 6-K's exhibits (of at least ``least`` characters), else the substantive items; texts cut to the form's cap, no sections: the whole filing."""
    exhibits = F.transform(F.filter(F.coalesce("exhibits", F.array()), lambda e: F.length(e["text"]) >= least), lambda e: F.struct(e["exhibit_type"].alias("unit"), e["text"].alias("text")))
    items = F.transform(F.filter(F.coalesce("sections", F.array()), lambda s: ~s["number"].isin(*skip)), lambda s: F.struct(s["number"].alias("unit"), s["text"].alias("text")))
    cap = F.lit(caps.get("8-K", 12_000))
    for form, n in caps.items():
        cap = F.when(F.col("form") == form, n).otherwise(cap)
    rows = filings.select("accession_number", "form", "body_text", F.posexplode_outer(F.when(F.col("form").startswith("6-K"), exhibits).otherwise(items)).alias("pos", "s"))
    twice = F.row_number().over(Window.partitionBy("accession_number", "s.unit").orderBy("pos"))
    unit = F.when(F.col("s").isNull(), "__whole_filing__").when(twice > 1, F.concat("s.unit", F.lit("#"), twice.cast("string"))).otherwise(F.col("s.unit"))
    return rows.select("accession_number", "form", F.coalesce("pos", F.lit(0)).alias("pos"), unit.alias("unit"), F.substring(F.coalesce("s.text", "body_text"), F.lit(1), cap).alias("text"))


def compared(left: DataFrame, right: DataFrame, key: str, label: str, score: str) -> DataFrame:
    """Two arms side by side: where each unit is present, whether its label changed, and by how much its score."""
    a, b = left.select(key, F.col(label).alias("label_a"), F.col(score).alias("score_a"), F.lit(True).alias("_a")), right.select(key, F.col(label).alias("label_b"), F.col(score).alias("score_b"), F.lit(True).alias("_b"))
    out = a.join(b, key, "full_outer")
    present = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "a").otherwise("b")
    return out.select(key, present.alias("present_in"), "label_a", "label_b", (F.col("_a") & F.col("_b") & (F.col("label_a") != F.col("label_b"))).alias("changed"), (F.col("score_b") - F.col("score_a")).alias("delta")).withColumn("changed", F.coalesce("changed", F.lit(False)))


def precision_recall(rows: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    tp, fp, fn = F.count_if(truth & predicted), F.count_if(~truth & predicted), F.count_if(truth & ~predicted)
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return rows.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def compared_summary(compared_rows: DataFrame, filing: str, label: str = "other_material") -> DataFrame:
    """Figures of ``compared`` rows (with material_a and material_b): filings, units in both arms, changes, mean difference, and by how much a label became rarer."""
    both = F.col("present_in") == "both"
    n, changed = F.count_if(both), F.count_if(both & F.col("changed"))
    share = lambda x, d: F.coalesce(F.round(F.try_divide(x, n), d), F.lit(0.0))
    a, b = F.count_if(both & (F.col("label_a") == label)), F.count_if(both & (F.col("label_b") == label))
    return compared_rows.agg(
        F.count_distinct(filing).alias("filings"), n.alias("comparable_units"), changed.alias("label_changed"), share(100 * changed, 2).alias("label_changed_pct"),
        F.count_if(both & (F.col("material_a") != F.col("material_b"))).alias("material_changed"), share(F.sum(F.when(both, F.round("delta", 4))), 4).alias("mean_delta"),
        a.alias("other_a"), b.alias("other_b"), (a - b).alias("other_reduction"),
    )


def truncation(filings: DataFrame, cap: int = 20_000) -> DataFrame:
    """Per filing (accession_number, exhibits): exhibits, their characters, those within the cap of each, what is dropped, whether any is, and the red flags of what is dropped."""
    from tidemark.functions.text import terms_in

    size = lambda f: F.aggregate(F.transform("exhibits", f), F.lit(0), lambda a, x: a + x)
    total, used = size(lambda e: F.length(e["text"])), size(lambda e: F.least(F.length(e["text"]), F.lit(cap)))
    tail = F.array_join(F.filter(F.transform("exhibits", lambda e: F.substring(e["text"], F.lit(cap + 1), F.length(e["text"]))), lambda t: t != ""), "\n")
    rows = filings.where(F.size("exhibits") > 0).select("accession_number", F.size("exhibits").alias("exhibit_count"), total.alias("total_chars"), used.alias("used_chars"), tail.alias("_tail"))
    return rows.select("*", (F.col("total_chars") - F.col("used_chars")).alias("dropped_chars"), (F.col("total_chars") > F.col("used_chars")).alias("truncated"), terms_in(F.col("_tail")).alias("red_flags")).drop("_tail")
