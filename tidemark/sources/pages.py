"""Filing pages: the index page of a filing, kinds and encodings of documents, plain text and item sections."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.sources.listings import document_url

# Elements whose text runs on in the line; the largest document that is parsed; first bytes of formats that aren't markup, in hexadecimal.
INLINE = ("a", "abbr", "b", "cite", "code", "del", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var")
MAX_PARSE_BYTES = 25 * 1024 * 1024
BINARY_HEADS = ("255044462D", "504B0304", "FFD8FF", "89504E47", "47494638", "424D")
VIEWER = "/ix?doc="
ITEM_HEADING = r"(?i)^\s*item\s+(\d+\.\d+)\.?\s*[–—\-:.]?\s*(.*?)$"


def document_kind(content: Column, content_type: Column) -> Column:
    """pdf, binary, oversized or markup: by the first bytes after white space, then by the type that the server gave. Null content is markup of no bytes."""
    kind = F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    head = F.regexp_replace(F.hex(F.substring(F.coalesce(content, F.lit(b"")), 1, 512)), "^(?:20|09|0A|0B|0C|0D)+", "")
    pdf = head.startswith(BINARY_HEADS[0]) | (kind == "application/pdf")
    binary = kind.startswith("image/") | kind.startswith("application/zip") | kind.isin("application/octet-stream", "application/vnd.ms-excel")
    for h in BINARY_HEADS[1:]:
        binary = binary | head.startswith(h)
    return F.when(pdf, "pdf").when(binary, "binary").when(F.length(content) > MAX_PARSE_BYTES, "oversized").otherwise("markup")


def decoded(content: Column, content_type: Column) -> Column:
    """Text by the charset of the type, UTF-8 without or for an unknown one; bytes that can't be decoded are replaced. Decoded in Arrow batches."""

    def run(raw: pa.Array, kinds: pa.Array) -> pa.Array:
        out = []
        for x, k in zip(raw.to_pylist(), kinds.to_pylist()):
            _, has, rest = (k or "").lower().partition("charset=")
            name = rest.partition(";")[0].strip() if has else ""
            try:
                out.append(None if x is None else x.decode(name or "utf-8", "replace"))
            except LookupError:
                out.append(x.decode("utf-8", "replace"))
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(content, content_type.cast("string"))


def _document_rows(page: Column) -> Column:
    """Cells (as markup) of every row of the table of documents that has four or more."""
    table = F.regexp_extract(page, r"""(?is)<table[^>]*summary\s*=\s*["']Document Format Files["'][^>]*>(.*?)</table>""", 1)
    rows = F.regexp_extract_all(table, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    return F.filter(F.transform(rows, lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1))), lambda c: F.size(c) >= 4)


def _cell_text(cell: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(cell, r"(?s)<[^>]*>", ""), r"&nbsp;|\s+", " "))


def _href(cell: Column) -> Column:
    """The link's target without the viewer's prefix; null without one."""
    href = F.regexp_extract(cell, r"""(?is)<a\b[^>]*href\s*=\s*["']([^"']*)["']""", 1)
    return F.nullif(F.when(href.startswith(VIEWER), F.substring(href, len(VIEWER) + 1, 1 << 30)).otherwise(href), F.lit(""))


def primary_document(page: Column, form: Column) -> Column:
    """The file of the first row whose type is exactly the form; null where there is none."""
    hits = F.filter(_document_rows(page), lambda c: (_cell_text(c[3]) == form) & _href(c[2]).isNotNull())
    return F.substring_index(_href(F.get(hits, F.lit(0))[2]), "/", -1)


def exhibits(page: Column, cik: Column, accession: Column) -> Column:
    """exhibit_type, document and url of the rows of type EX-99 or EX-99.n that have a link, by n, then as listed."""
    pattern = r"(?i)^EX-99(?:\.(\d+))?$"
    hits = F.filter(_document_rows(page), lambda c: F.regexp_like(_cell_text(c[3]), F.lit(pattern)) & _href(c[2]).isNotNull())

    def row(c, i):
        kind, name = F.upper(_cell_text(c[3])), F.substring_index(_href(c[2]), "/", -1)
        n = F.coalesce(F.regexp_extract(kind, pattern, 1).try_cast("long"), F.lit(0))
        return F.struct(n.alias("n"), i.alias("i"), kind.alias("exhibit_type"), name.alias("document"), document_url(cik, accession, name).alias("url"))

    return F.transform(F.array_sort(F.transform(hits, row)), lambda r: F.struct(r["exhibit_type"].alias("exhibit_type"), r["document"].alias("document"), r["url"].alias("url")))


def report_date(page: Column) -> Column:
    """The date in the info block right after the first one headed "Period of Report"; null where there is none, or it isn't a date."""
    info = F.regexp_extract(page, r"""(?is)<div[^>]*class\s*=\s*["']infoHead["'][^>]*>\s*Period of Report\s*</div>.*?<div[^>]*class\s*=\s*["']info["'][^>]*>(.*?)</div>""", 1)
    return F.regexp_extract(_cell_text(info), r"^\d{4}-\d{2}-\d{2}", 0).try_cast("date")


class _Text(HTMLParser):
    """Text of markup: other elements than INLINE end a line, what scripts and styles hold is left out."""

    hidden = ("script", "style", "noscript")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in self.hidden:
            self.skip += 1
        elif tag not in INLINE:
            self.out.append("\n")

    def handle_startendtag(self, tag, attrs):
        if tag not in INLINE:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in self.hidden:
            self.skip = max(0, self.skip - 1)
        elif tag not in INLINE:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def text_of(html: str) -> str:
    """Plain text: one line for each block, single spaces, one blank line at most between lines that markup or the text itself sets apart."""
    parser = _Text()
    parser.feed(html)
    parser.close()
    # a boundary of elements is one line break however many elements begin and end there
    raw = re.sub(r"\n(?:[ \t ]*\n)+", "\n\n", "".join(parser.out))
    lines = [re.sub(r"[ \t \r\f\v]+", " ", x).strip() for x in raw.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def plain_text(html: Column) -> Column:
    """``text_of`` of every document, in Arrow batches; null for null. Meant for markup only: see document_kind."""

    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else text_of(x) for x in column.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(html.cast("string"))


def item_sections(text: Column) -> Column:
    """number, title and text of each item of a filing's plain text (a column, not an Arrow function itself): the lines from its heading to the next one's; none without headings."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    marked = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.regexp_extract(x, ITEM_HEADING, 1).alias("number"), F.nullif(F.trim(F.regexp_extract(x, ITEM_HEADING, 2)), F.lit("")).alias("title")))
    heads = F.filter(marked, lambda h: h["number"] != "")

    def section(h, k):
        end = F.coalesce(F.get(heads, k + 1)["i"], F.size(lines))
        body = F.array_join(F.slice(lines, h["i"] + 2, end - h["i"] - 1), "\n")
        return F.struct(h["number"].alias("number"), h["title"].alias("title"), F.trim(body, F.lit(" \t\r\n")).alias("text"))

    return F.transform(heads, section)
