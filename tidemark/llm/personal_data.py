"""Personal data in texts, in DataFrame functions alone: generators propose spans, boosted trees score them, calibrated thresholds choose.

The base finds e-mail addresses, IP addresses, card and phone numbers by patterns and checks (see BASE). Their matches are greedy, so that two numbers side by side spoil each
other. The method adds to them: emails and addresses of the base are blanked, wider patterns (GENERATORS) propose spans of each kind in what is left, and gradient-boosted
trees score each by its form and its surroundings. No table says which spans are personal data, so the trees learn from all texts what the base's checks say of a proposed span
taken alone, without seeing the check itself (the checksum of a card, say). A kind's threshold is the least at which PRECISION of the held-out spans are right.

Spans are places in code points. Everything is a projection of a row, without a shuffle: positions come from the lengths of what a pattern splits and finds, summed in blocks, so the
time is linear in the text and nearly so in the number of spans. Trees are written as CASE expressions. They and the thresholds are learned from every proposed span of every text: spans
that are alike in all features and in what is said of them become one row with their number as its weight, which is all that is shuffled and kept for training.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, written so that a long run of characters is read once: possessive, and begun only where a run begins or the last match ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Stands for a blanked character; it breaks words and numbers like a space.
BLANK = "\u0001"
_NOT = r"\s@<>(),;:\"\x01"
#: What may be personal data. Lengths are bounded, so that few spans can overlap one (see NEAR).
GENERATORS = {
    "email": rf"(?<![^{_NOT}])[^{_NOT}]{{1,64}}+@[^{_NOT}]{{1,190}}+|(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9.-]{{1,190}}+",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:\.[0-9]{1,3}+){2,5}+(?![0-9])",
    "card": r"(?<![0-9])(?:(?:[0-9]{4}[\x20.-]){3}[0-9]{2,7}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}|[0-9]{9,24})(?![0-9])",
    "phone": r"\+[0-9]{1,3}+(?:[\x20.-]?\(?[0-9]{2,4}\)?){3,4}(?![0-9])|(?<![0-9.+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: Words before a number or an address that say what it is.
HINTS = {"email": "mail|contact|kontakt|correo|courriel", "ip": "ip|host|server|address|adresse", "card": "card|visa|iban|karte|carte|tarjeta|account|konto", "phone": "tel|phone|call|fax|mobil|whatsapp|handy|portable"}
#: Share of right ones among the held-out spans over a threshold; held-out spans needed for one; spans that each side of a split has at least; most values of a feature that are told apart
#: (features are small whole numbers: none has as many).
PRECISION, LEAST_HELD, LEAST_SIDE, MAX_VALUES = 0.9, 20, 3, 1024
FEATURES = ("kind", "length", "digits", "letters", "spaces", "dots", "hyphens", "groups", "longest", "plus", "brackets", "ats", "before", "after", "first", "different", "last_part", "hint", "hint_other")
_BLOCK = 256
#: Spans by start, so far on either side of one, hold all that overlap it: proposed spans are at most 260 characters, others of a kind don't overlap, and none is under 5.
NEAR = 260


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def holds(kind: str, s: Column) -> Column:
    """What the base asks of a match besides its pattern."""
    n = F.length(_digits(s))
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: p.rlike(r"^0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])?$"))
    if kind == "card":
        return n.between(14, 19) & F.call_function("luhn_check", _digits(s))
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def is_base(kind: str, s: Column) -> Column:
    """Whether a span taken alone is what the base would find."""
    return s.rlike(rf"^(?:{BASE[kind]})$") & holds(kind, s)


def with_matches(rows: DataFrame, text: str, patterns: dict[str, str], prefix: str) -> DataFrame:
    """Adds for each pattern ``prefix + name``: start, end, s, before, after of its leftmost matches, which don't overlap, and ``prefix + name + _gaps``, the texts between them."""
    p = {k: prefix + k for k in patterns}
    rows = rows.withColumns({c + "_gaps": F.split(F.col(text), patterns[k], -1) for k, c in p.items()} | {c + "_s": F.regexp_extract_all(F.col(text), F.lit(patterns[k]), F.lit(0)) for k, c in p.items()})
    add = lambda a, x: a + x
    zero = F.lit(0)
    rows = rows.withColumns({c + "_n": F.transform(c + "_s", lambda s, i: F.length(s) + F.length(F.get(c + "_gaps", i))) for c in p.values()})
    sums = lambda c: F.transform(F.when(F.size(c) > 0, F.sequence(zero, F.floor((F.size(c) - 1) / _BLOCK).cast("int"))).otherwise(F.array().cast("array<int>")), lambda b: F.aggregate(F.slice(c, b * _BLOCK + 1, _BLOCK), zero, add))
    rows = rows.withColumns({c + "_o": F.aggregate(sums(c + "_n"), F.array(zero), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))) for c in p.values()})

    def place(c):
        def at(s, i):
            block = F.floor(i / _BLOCK).cast("int")
            gap = F.get(c + "_gaps", i)
            start = F.get(c + "_o", block) + F.aggregate(F.slice(c + "_n", block * _BLOCK + 1, i % _BLOCK), zero, add) + F.length(gap)
            return F.struct(start.alias("start"), (start + F.length(s)).alias("end"), s.alias("s"), F.right(gap, F.lit(24)).alias("before"), F.left(F.get(c + "_gaps", i + 1), F.lit(8)).alias("after"))

        return F.transform(c + "_s", at)

    return rows.withColumns({c: place(c) for c in p.values()}).drop(*[c + x for c in p.values() for x in ("_s", "_n", "_o")])


def blanked(matches: str, kind: str) -> Column:
    """The text with the matches that hold blanked, from a column of matches and that of the texts between them."""
    gaps = F.col(matches + "_gaps")
    each = F.transform(matches, lambda m, i: F.concat(F.get(gaps, i), F.when(holds(kind, m["s"]), F.repeat(F.lit(BLANK), F.length(m["s"]))).otherwise(m["s"])))
    return F.concat(F.array_join(each, ""), F.element_at(gaps, -1))


def _sort_of(char: Column) -> Column:
    return F.when(char.rlike(r"^[\s\x01]?$"), 0.0).when(char.rlike(r"\p{L}"), 1.0).when(char.rlike("[0-9]"), 2.0).otherwise(3.0)


def features(kind: str, m: Column) -> Column:
    """Form and surroundings of a proposed span (a match), as a struct of doubles. What the base checks of digits isn't among them."""
    s = m["s"]
    n = lambda keep: F.length(F.regexp_replace(s, f"[^{keep}]", ""))
    groups = F.filter(F.split(s, "[^0-9]+"), lambda g: g != "")
    hint = {k: m["before"].rlike(rf"(?i)\b(?:{w})") for k, w in HINTS.items()}
    other = F.lit(False)
    for k, h in hint.items():
        other = other | h if k != kind else other
    values = {
        "kind": F.lit(KINDS.index(kind)), "length": F.length(s), "digits": n("0-9"), "letters": n("A-Za-z"), "spaces": n(r"\x20"), "dots": n("."), "hyphens": n("-"), "groups": F.size(groups),
        "longest": F.coalesce(F.array_max(F.transform(groups, lambda g: F.length(g))), F.lit(0)), "plus": s.startswith("+"), "brackets": n("()"), "ats": n("@"), "before": _sort_of(F.right(m["before"], F.lit(1))), "after": _sort_of(F.left(m["after"], F.lit(1))),
        "first": F.coalesce(F.left(_digits(s), F.lit(1)).try_cast("int"), F.lit(-1)), "different": F.size(F.array_distinct(F.split(_digits(s), ""))), "last_part": F.length(F.regexp_extract(s, r"\.([A-Za-z]+)$", 1)), "hint": hint[kind], "hint_other": other,
    }
    return F.struct(*[values[f].cast("double").alias(f) for f in FEATURES])


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id and t, the text if it has a digit or an at sign (nothing can be found without); else empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(text.rlike(r"[0-9@]|(?i)[\[(]at[\])]"), text).otherwise("").alias("t"))


def proposals(docs: DataFrame) -> DataFrame:
    """Every span that the generators propose in the whole texts, and each without its first or last part (so that a kind of which all proposals are right has wrong ones too),
    with features, label (the base's opinion of the span alone) and a hash that says which are held out."""
    rows = with_matches(texts_of(docs), "t", GENERATORS, "c_")
    part = "[0-9A-Za-z]{1,4}"
    cuts = lambda s: F.array(s, F.regexp_extract(s, rf"^(.*?)[^0-9A-Za-z]*{part}$", 1), F.regexp_extract(s, rf"^[^0-9A-Za-z]*{part}[^0-9A-Za-z]*(.*)$", 1))

    def labelled(kind):
        each = F.flatten(F.transform(f"c_{kind}", lambda m: F.transform(cuts(m["s"]), lambda s: F.struct(s.alias("s"), m["before"].alias("before"), m["after"].alias("after")))))
        one = lambda m: F.struct(features(kind, m).alias("f"), is_base(kind, m["s"]).cast("double").alias("label"), F.xxhash64(m["s"], m["before"], m["after"], F.lit(kind)).alias("h"))
        return F.transform(F.filter(each, lambda m: m["s"] != ""), one)

    return rows.select(F.explode(F.concat(*[labelled(k) for k in KINDS])).alias("x")).select("x.f.*", "x.label", "x.h")


def as_column(node, value) -> Column:
    """A tree's prediction as CASE expressions; value gives a feature by number."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    return F.when(value(node.split().featureIndex()) <= float(node.split().threshold()), as_column(node.leftChild(), value)).otherwise(as_column(node.rightChild(), value))


def alike(spans: DataFrame) -> DataFrame:
    """Proposed spans by features, label and whether they are held out (a fifth, by hash): n, how many they are."""
    return spans.withColumn("held", F.pmod("h", F.lit(5)) == 0).groupBy(*FEATURES, "label", "held").agg(F.count("*").cast("double").alias("n"))


def train(docs: DataFrame):
    """(score of a struct of features, threshold of each kind) from all proposed spans, a fifth of them held out for the thresholds; None without both labels."""
    rows = alike(proposals(docs)).sortWithinPartitions(*FEATURES, "label").cache()
    own = rows.where("not held")
    if own.select("label").distinct().count() < 2:
        rows.unpersist()
        return None
    least = min(0.49, (LEAST_SIDE - 0.5) / own.agg(F.sum("n")).first()[0])  # as a share of the spans, since a row stands for many
    gbt = GBTClassifier(maxIter=10, maxDepth=4, stepSize=0.3, seed=1, maxBins=MAX_VALUES, minInstancesPerNode=1, minWeightFractionPerNode=least, weightCol="n")
    model = gbt.fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(own).select("features", "label", "n"))
    roots = [(float(w), t._java_obj.rootNode()) for w, t in zip(model.treeWeights, model.trees)]

    def score(f: Column) -> Column:
        margin = F.lit(0.0)
        for weight, root in roots:
            margin = margin + F.lit(weight) * as_column(root, lambda i: f[FEATURES[i]])
        return 1 / (1 + F.exp(-2 * margin))

    held = rows.where("held").select("kind", "label", "n", score(F.struct(*FEATURES)).alias("score"))
    steps = held.select("kind", "label", "n", "score", F.explode(F.transform(F.sequence(F.lit(1), F.lit(19)), lambda i: i / 20)).alias("step")).where("score >= step")
    right = steps.groupBy("kind", "step").agg((F.sum(F.col("label") * F.col("n")) / F.sum("n")).alias("right"), F.sum("n").alias("n")).where((F.col("right") >= PRECISION) & (F.col("n") >= LEAST_HELD))
    found = {KINDS[int(r["kind"])]: r["least"] for r in right.groupBy("kind").agg(F.min("step").alias("least")).collect()}  # a row a kind
    rows.unpersist()
    return score, {k: found.get(k, 0.95) for k in KINDS}


def base_spans(rows: DataFrame) -> DataFrame:
    """Adds the matches of the base's patterns and, for each kind, the spans that hold."""
    rows = with_matches(rows, "t", BASE, "b_")
    return rows.withColumns({f"v_{k}": F.filter(f"b_{k}", lambda m: holds(k, m["s"])) for k in KINDS})


def _named(kind: str, m: Column, score: Column) -> Column:
    return F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end"), score.alias("score"))


def chosen(spans: Column) -> Column:
    """Of spans sorted by start those that no better one overlaps; the base's have a score of 2 and all stay."""

    def stays(x, i):
        first = F.greatest(i - NEAR, F.lit(0))
        near = F.slice(spans, first + 1, 2 * NEAR + 1)
        better = lambda y, j: (y["start"] < x["end"]) & (x["start"] < y["end"]) & ((y["score"] > x["score"]) | ((y["score"] == x["score"]) & (first + j < i)))
        return (x["score"] == 2.0) | ~F.exists(F.transform(near, better), lambda b: b)

    return F.filter(spans, stays)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def spans_of(docs: DataFrame, model=None) -> DataFrame:
    """doc_id, base (array of start, kind, end, score, sorted), spans (the same with those that the method adds) of each document; model is that of train(), by default on docs."""
    model = train(docs) if model is None else model
    rows = base_spans(texts_of(docs))
    rows = rows.withColumn("base", F.array_sort(F.concat(*[F.transform(f"v_{k}", lambda m: _named(k, m, F.lit(2.0))) for k in KINDS])))
    if model is None:
        return rows.select("doc_id", "base", F.col("base").alias("spans"))
    score, least = model
    rows = rows.withColumn("left1", blanked("b_email", "email")).select("doc_id", "base", "left1")
    rows = with_matches(rows, "left1", {"ip": BASE["ip"]}, "d_").withColumn("left2", blanked("d_ip", "ip")).select("doc_id", "base", "left2")
    rows = with_matches(rows, "left2", GENERATORS, "c_")
    scored = [F.transform(f"c_{k}", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), features(k, m).alias("f"))) for k in KINDS]
    rows = rows.select("doc_id", "base", *[x.alias(f"f_{k}") for k, x in zip(KINDS, scored)])
    rows = rows.select("doc_id", "base", *[F.filter(F.transform(f"f_{k}", lambda m: _named(k, m, score(m["f"]))), lambda x: x["score"] >= least[k]).alias(f"p_{k}") for k in KINDS])
    rows = rows.select("doc_id", "base", F.array_sort(F.concat("base", *[f"p_{k}" for k in KINDS])).alias("all"))
    return rows.select("doc_id", "base", chosen(F.col("all")).alias("spans"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans (``kind:start:end`` by start, then kind, comma-joined) of every document.

    Null and empty texts have no spans. Repeated rows are alike, null ids stay null, no rows give no rows; other columns are ignored. Where the texts don't give both right and wrong
    spans to learn from, nothing is added to the base.
    """
    rows = spans_of(docs)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *[count(k) for k in KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
