"""Blocks of a report's risk factors: where the section lies, where its blocks begin, which are kept.

Markup becomes a list of pieces: texts with their weight, named places and links, in the order of the document. All else is done on lists, a report a row, so that nothing is shuffled and
markup is read once: neighbours of one weight are cut out as slices, marks of beginnings and ends are put in one order of which only the turns count, headers are where blocks begin. The
section is found by a bold heading, else by the words of its item, else by the links of the table of contents; it is split at bold headers, or by size where there are none. Time is
linear in a report but for the sort of its marks; a report is held whole, so those over MOST_BYTES are left out.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import squeeze

# Lengths in characters, weights that render bold, and patterns of headings (of lower-cased text).
MIN_HEADER, MIN_BLOCK, MERGED_BLOCK, MIN_SECTION, MAX_SECTION = 25, 120, 1800, 1500, 400_000
BOLD_TAGS = ("b", "strong", "h1", "h2", "h3", "h4")
BOLD_WEIGHTS = ("bold", "bolder", "600", "700", "800", "900")
SEPARATOR = "[\\s.:—–-]"
START_HEADING = rf"(?:item\s*1a\b{SEPARATOR}*)?risk\s+factors\b"
START_ITEM = rf"item\s*1a\b{SEPARATOR}*risk\s+factors\b"
END_ITEM = rf"item[\s ]*(?:1b|1c|2){SEPARATOR}"
END_HEADING = r"(?:item\s*(?:1b|1c|2)\b|unresolved\s+staff|properties\b|legal\s+proceedings|mine\s+safety)"
MOST_BYTES = 25 * 1024 * 1024
_WEIGHT = re.compile(r"font-weight\s*:\s*(\w+)")
_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


class _Pieces(HTMLParser):
    """Rows (kind, bold, text, name) of a document in its order: texts, places that have a name, and links within the document with their words."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.rows, self.skip, self.link = [], [], 0, None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        self.rows += [["place", False, "", name] for name in (a.get("id"), a.get("name")) if name]
        if tag in ("script", "style"):
            self.skip += 1
        if tag == "a" and (a.get("href") or "").startswith("#") and len(a["href"]) > 1:
            self.link = ["link", False, "", a["href"][1:]]
            self.rows.append(self.link)
        if tag not in _VOID:
            weight = _WEIGHT.search(a.get("style") or "")
            self.open.append((tag, tag in BOLD_TAGS or (weight is not None and weight.group(1).lower() in BOLD_WEIGHTS)))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        text = " ".join(data.split())
        if self.skip or not text:
            return
        self.rows.append(["text", any(bold for _, bold in self.open), text, None])
        if self.link and any(tag == "a" for tag, _ in self.open):
            self.link[2] = f"{self.link[2]} {text}".strip()


def pieces(reports: DataFrame) -> DataFrame:
    """accession_number and pieces of reports (accession_number, html): kind (text, place or link), bold, text, name and at, the characters of the texts before it with one more for each."""
    size = 1 << 22
    kinds = (pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int32())
    names = ["kind", "bold", "text", "name", "at"]

    def batch(found):
        flat = [x for _, rows in found for x in rows]
        ends = accumulate((len(rows) for _, rows in found), initial=0)
        each = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(zip(*flat) if flat else [()] * 5, kinds)], names=names)
        return pa.record_batch([pa.array([a for a, _ in found], pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)], names=[ID, "pieces"])

    def parse(batches):
        found, held = [], 0
        for b in batches:
            for accession, html in zip(b.column(0), b.column(1)):
                html = html.as_py()
                document = _Pieces()
                document.feed(html)
                document.close()
                at = accumulate((len(r[2]) + 1 if r[0] == "text" else 0 for r in document.rows), initial=0)
                found.append((accession.as_py(), [(*r, n) for r, n in zip(document.rows, at)]))
                held += len(html)
                if held >= size:
                    yield batch(found)
                    found, held = [], 0
        if found:
            yield batch(found)

    own = reports.select(F.col(ID).cast("string"), F.col("html").cast("string")).where(F.col(ID).isNotNull() & (F.octet_length("html") <= MOST_BYTES))
    return own.mapInArrow(parse, f"{ID} string, pieces array<struct<kind: string, bold: boolean, text: string, name: string, at: int>>")


ID = "accession_number"
_BLOCK = 256


def added(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows with columns that are evaluated once: a generator's output isn't copied into what uses it, a list's expression isn't evaluated for each of another's elements."""
    one = F.struct(*[c.alias(k) for k, c in columns.items()])
    return rows.select("*", F.explode(F.array(one)).alias("_new")).select("*", "_new.*").drop("_new")


def numbers_where(items: str, holds) -> Column:
    """Numbers (from 0) of a list's elements for which holds(element, number) is true."""
    return F.filter(F.transform(items, lambda x, i: F.when(holds(x, i), i)), lambda i: i.isNotNull())


def sliced(items: str, starts: str) -> Column:
    """A list cut before each of the numbers ``starts``."""
    return F.transform(starts, lambda s, k: F.slice(items, s + 1, F.coalesce(F.get(starts, k + 1), F.size(items)) - s))


def joined(parts: Column, sep: str = " ") -> Column:
    return F.array_join(F.transform(parts, lambda x: x["text"]), sep)


def with_runs(rows: DataFrame, texts: str, name: str) -> DataFrame:
    """Adds neighbouring texts of one weight as one: a list of bold, text, at (that of its first)."""
    rows = added(rows, _starts=numbers_where(texts, lambda x, i: (i == 0) | (x["bold"] != F.get(texts, i - 1)["bold"])))
    run = F.transform(sliced(texts, "_starts"), lambda p: F.struct(F.get(p, F.lit(0))["bold"].alias("bold"), joined(p).alias("text"), F.get(p, F.lit(0))["at"].alias("at")))
    return added(rows, **{name: run}).drop("_starts")


def with_places(rows: DataFrame, name: str, pattern: str) -> DataFrame:
    """Adds the places (from 0) at which a pattern occurs in ``low``: sums of what lies before, in blocks, so that time stays linear."""
    gaps = F.transform(F.split("low", pattern, -1), lambda g: F.length(g))
    hits = F.transform(F.regexp_extract_all("low", F.lit(pattern), F.lit(0)), lambda h: F.length(h))
    zero, add = F.lit(0), lambda a, x: a + x
    rows = added(rows, _gaps=gaps, _hits=hits)
    rows = added(rows, _steps=F.transform("_hits", lambda h, i: h + F.get("_gaps", i)))
    blocks = F.when(F.size("_steps") > 0, F.sequence(zero, F.floor((F.size("_steps") - 1) / _BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = added(rows, _sums=F.transform(blocks, lambda b: F.aggregate(F.slice("_steps", b * _BLOCK + 1, _BLOCK), zero, add)))
    rows = added(rows, _before=F.aggregate("_sums", F.array(zero), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))))
    block = lambda i: F.floor(i / _BLOCK).cast("int")
    at = F.transform("_steps", lambda _, i: F.get("_before", block(i)) + F.aggregate(F.slice("_steps", block(i) * _BLOCK + 1, i % _BLOCK), zero, add) + F.get("_gaps", i))
    return added(rows, **{name: at}).drop("_gaps", "_hits", "_steps", "_sums", "_before")


def with_longest(rows: DataFrame, name: str, starts: str, ends: str) -> DataFrame:
    """Adds lo and hi of the longest stretch of MIN_SECTION or more from a beginning to the next end behind it, the first of equals; null without one.

    In the order of all marks the first of several beginnings in a row gives the longest stretch, so that only the turns from one kind to the other are looked at.
    """
    mark = lambda c, kind: F.transform(c, lambda at: F.struct(at.alias("at"), F.lit(kind).alias("is_start")))
    rows = added(rows, _marks=F.array_sort(F.concat(mark(starts, 1), mark(ends, 0))))
    rows = added(rows, _turns=F.filter("_marks", lambda m, i: (i == 0) | (m["is_start"] != F.get("_marks", i - 1)["is_start"])))
    spans = F.transform("_turns", lambda m, i: F.struct(m["is_start"].alias("is_start"), (F.get("_turns", i + 1)["at"] - m["at"]).alias("size"), (-m["at"]).alias("back"), F.get("_turns", i + 1)["at"].alias("hi")))
    long = F.filter(spans, lambda s: (s["is_start"] == 1) & (s["size"] >= MIN_SECTION))
    rows = added(rows, _best=F.array_max(long))
    return rows.withColumn(name, F.when(F.col("_best").isNotNull(), F.struct((-F.col("_best.back")).alias("lo"), F.col("_best.hi").alias("hi")))).drop("_marks", "_turns", "_best")


def with_linked(rows: DataFrame) -> DataFrame:
    """Adds from_pos and to_pos (null: the end) of sections between the places to which the table of contents links: its first link to the risk factors and its next to what follows; null without."""
    of = lambda kind: F.filter(F.transform("pieces", lambda p, i: F.struct(i.alias("pos"), p["kind"].alias("kind"), F.lower(p["text"]).alias("low"), p["name"].alias("name"))), lambda p: p["kind"] == kind)
    rows = added(rows, _links=of("link"), _places=of("place"))
    rows = added(rows, _b=F.get(F.filter("_links", lambda x: x["low"].rlike(f"^{START_HEADING}")), F.lit(0)))
    rows = added(rows, _e=F.get(F.filter("_links", lambda x: (x["pos"] > F.col("_b.pos")) & x["low"].rlike(f"^{END_HEADING}")), F.lit(0)))
    place = lambda c: F.get(F.filter("_places", lambda x: x["name"] == F.col(c)["name"]), F.lit(0))["pos"]
    rows = added(rows, _from=place("_b"), _to=place("_e"))
    texts = lambda c: F.size(F.filter(F.slice("pieces", 1, F.col(c)), lambda p: p["kind"] == "text"))  # noqa: E731  so that places without a text between them are one place
    both = F.col("_from").isNotNull() & F.col("_to").isNotNull()
    rows = added(rows, from_pos=F.when(both, F.col("_from")), to_pos=F.when(both & (texts("_to") > texts("_from")), F.col("_to")))
    return rows.drop("_links", "_places", "_b", "_e", "_from", "_to")


def sections(rows: DataFrame) -> DataFrame:
    """accession_number and runs (bold, text) of the risk factors, cut to the section, from ``pieces``; none where it isn't found."""
    rows = added(rows, _texts=F.filter("pieces", lambda p: p["kind"] == "text"))
    rows = with_runs(rows, "_texts", "_runs").drop("_texts")
    rows = added(rows, low=F.lower(joined(F.col("_runs"), "\n")))
    heading = lambda pattern: F.transform(F.filter("_runs", lambda r: r["bold"] & F.lower(r["text"]).rlike(f"^{pattern}")), lambda r: r["at"])
    rows = with_places(with_places(rows, "_item_ends", END_ITEM), "_items", START_ITEM).drop("low")
    rows = added(rows, _headings=heading(START_HEADING), _ends=F.concat("_item_ends", heading(END_HEADING)))
    rows = with_longest(with_longest(rows, "_s1", "_headings", "_ends"), "_s2", "_items", "_ends")
    rows = with_linked(added(rows, _s=F.coalesce("_s1", "_s2"))).select(ID, "pieces", "_runs", "_s", "from_pos", "to_pos")
    past = lambda c, r: F.greatest(F.lit(0), F.col("_s")[c] - r["at"])
    cut = F.transform("_runs", lambda r: F.struct(r["bold"].alias("bold"), F.trim(F.substring(r["text"], past("lo", r) + 1, past("hi", r) - past("lo", r))).alias("text")))
    between = F.filter("pieces", lambda p, i: (p["kind"] == "text") & (i >= F.col("from_pos")) & (F.col("to_pos").isNull() | (i < F.col("to_pos"))))
    none = F.array().cast("array<struct<bold: boolean, text: string>>")
    rows = added(rows, _words=F.when(F.col("_s").isNotNull(), F.filter(cut, lambda r: r["text"] != "")).otherwise(none), _between=F.when(F.col("_s").isNull() & F.col("from_pos").isNotNull(), between).otherwise(F.slice("pieces", 1, 0)))
    rows = with_runs(rows.select(ID, "_words", "_between"), "_between", "_linked")
    return rows.select(ID, F.concat("_words", F.transform("_linked", lambda r: F.struct(r["bold"].alias("bold"), r["text"].alias("text")))).alias("runs"))


def by_size(lengths: Column) -> Column:
    """Numbers of the runs of these lengths with which blocks begin, when a block is closed at MERGED_BLOCK characters (with a space between runs)."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("size"), F.array(F.lit(0)).alias("out"))

    def add(state, n):
        size = F.when(state["size"] > 0, state["size"] + 1 + n).otherwise(n)
        full = size >= MERGED_BLOCK
        return F.struct((state["i"] + 1).alias("i"), F.when(full, 0).otherwise(size).alias("size"), F.when(full, F.concat(state["out"], F.array(state["i"] + 1))).otherwise(state["out"]).alias("out"))

    return F.aggregate(lengths, start, add, lambda state: F.filter(state["out"], lambda k: k < state["i"]))


def risk_blocks(reports: DataFrame) -> DataFrame:
    """accession_number, block_index, heading, block_text and block_hash of the risk factors of reports (accession_number, html).

    Blocks begin at bold runs of MIN_HEADER characters or more; with less than two of these, runs are put together by size. A report without the section, with too little or too much to be it,
    or of over MOST_BYTES has no rows; nor has one without html. Each accession number must come once.
    """
    is_header = lambda r: r["bold"] & (F.length(r["text"]) >= MIN_HEADER)
    rows = added(sections(pieces(reports)), _headers=numbers_where("runs", lambda r, i: is_header(r)))
    split = F.size("_headers") >= 2
    starts = F.when(split, F.when(F.get("_headers", F.lit(0)) > 0, F.concat(F.array(F.lit(0)), "_headers")).otherwise(F.col("_headers"))).otherwise(by_size(F.transform("runs", lambda r: F.length(r["text"]))))
    rows = added(rows, _starts=starts, _split=split)
    block = lambda p: F.struct(squeeze(F.when(F.col("_split") & is_header(F.get(p, F.lit(0))), F.get(p, F.lit(0))["text"])).alias("heading"), squeeze(joined(p)).alias("block_text"))
    rows = added(rows, _blocks=F.filter(F.transform(sliced("runs", "_starts"), block), lambda b: F.length(b["block_text"]) >= MIN_BLOCK)).select(ID, "_blocks")
    total = F.aggregate("_blocks", F.lit(0), lambda n, b: n + F.length(b["block_text"]))
    each = rows.where(total.between(MIN_SECTION, MAX_SECTION)).select(ID, F.posexplode("_blocks").alias("block_index", "b"))
    return each.select(ID, "block_index", "b.heading", "b.block_text", F.sha2("b.block_text", 256).alias("block_hash"))
