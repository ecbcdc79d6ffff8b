"""Personal data: pattern spans, and terms that give protected values away.

Native. The patterns mark their matches in the text with a control character; splitting at it yields
pieces whose lengths give code-point places. Patterns use possessive quantifiers and look-behinds, so a run of a
million characters costs one pass and no stack.

Beyond the patterns, the corpus itself tells which terms disclose a protected entity. An entity is a value, and what a value
gives away of its holder: the name and the host of an address, the area of a number, the network of an IP, the issuer of a card. For an
entity e and a term t of its line, ``PMI(t; e) = log2(P(t, e) / (P(t) P(e)))`` is estimated from document counts, and compared with the
information ``IC(e) = -log2 P(e)`` of the entity: at 1 the term gives e away completely. With
fewer than ``CONTEXTS`` different lines as evidence the estimate is smoothed by a prior: PMI counts ``n / (n + PRIOR)``, n the documents
that hold both, so one co-occurrence proves nothing and two can.
Terms with ``PMI >= ALPHA * IC`` are spans of kind ``term`` in every document that holds them;
``sanitised`` generalises pattern spans to their kind and removes terms. All counts cover all documents; they are
aggregated before each shuffle, so a value or word of a third of all documents is a row per task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.llm.line_dedup import fresh, lines_of, row_key
from rankmill.session import cut_lineage

MARK, OTHER = "\x01", "\x02"
ALPHA = 0.8
CONTEXTS = 3
PRIOR = 1 / 3  # documents' worth of doubt
EPSILON = 1e-9
KINDS = ("email", "ip", "card", "phone")
# fixed values: the patterns of the contract, made linear. \G lets a match begin where the last one ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"[\p{L}\p{N}]++"
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}


def _luhn(digits: Column) -> Column:
    """Luhn's check over digits from the right, every second one doubled."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substr(digits, n - i, F.lit(1))) - 48
        return total + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        small = r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9]?)$"
        return F.forall(F.split(value, "[.]"), lambda p: F.regexp_like(p, F.lit(small)))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    return F.lit(True)


def _pieces(text: Column, pattern: str) -> Column:
    """The text cut at its matches: every second piece is a match."""
    plain = F.translate(text, MARK, OTHER)
    return F.split(F.regexp_replace(plain, f"({pattern})", f"{MARK}$1{MARK}"), MARK, -1)


def _placed(pieces: Column, kind: str, wanted: Callable[[Column], Column]) -> Column:
    """Spans (kind, start, end, value) of the wanted matches, left to right."""

    def span(at: Column, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), at.alias("start"), (at + F.length(value)).alias("end"), value.alias("value"))

    def step(a: Column, x: Column) -> Column:
        out = F.when(a["on"] & wanted(x), F.array_append(a["out"], span(a["at"], x))).otherwise(a["out"])
        return F.struct((a["at"] + F.length(x)).alias("at"), (~a["on"]).alias("on"), out.alias("out"))

    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("on"), none.alias("out"))
    return F.aggregate(pieces, start, step, lambda a: a["out"])


def base_spans(text: Column) -> Column:
    """Pattern spans by kind as listed, then start; places in code points, ends exclusive. Null text: none."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    hints = {"email": text.contains("@"), "phone": text.contains("+")}
    found = []
    for kind, pattern in PATTERNS.items():
        hint = hints.get(kind, F.regexp_like(text, F.lit("[0-9]")))
        spans = _placed(_pieces(text, pattern), kind, lambda x, kind=kind: _valid(kind, x))
        found.append(F.when(hint, spans).otherwise(none))
    return F.concat(*found)


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1)))


def _without_values(line: Column) -> Column:
    long_runs = CARD.replace(")++", "){12,}+")  # shorter runs of digits are words or parts of words
    for pattern in (PATTERNS | {"card": long_runs}).values():
        line = F.regexp_replace(line, pattern, " ")
    return line


def entities(span: Column) -> Column:
    """What a pattern span protects: its value, and the parts that point at its holder."""
    kind, value = span["kind"], F.lower(span["value"])

    def part(of: str, label: str, pattern: str) -> Column:
        found = F.regexp_extract(value, pattern, 0)
        return F.when((kind == of) & (found != ""), F.concat(F.lit(f"{label}:"), found))

    return F.array_compact(
        F.array(
            F.concat(kind, F.lit(":"), value), part("email", "host", r"(?<=@).+$"), part("email", "name", r"^[a-z]{3,}"),
            part("phone", "area", r"^\+[0-9]+[^0-9]+[0-9]+"), part("ip", "net", r"^[0-9]+\.[0-9]+"), part("card", "issuer", r"^(?:[0-9][\x20-]?){6}"),
        )
    )


def disclosing_terms(docs: DataFrame, alpha: float = ALPHA, contexts: int = CONTEXTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_doc, _of, terms``: for each document that holds terms which give a protected value away, these terms."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # keys first: beside a generator they would be computed again for every line or word
    lines = docs.select(*row_key(id_col, text_col), lines_of(text).alias("lines")).select("_doc", "_of", F.explode("lines").alias("line"))
    lines = lines.where(F.regexp_like("line", F.lit("@|[0-9]")))
    mentions = lines.select(
        "_doc", "_of", F.xxhash64("line").alias("context"), _words(_without_values(F.col("line"))).alias("words"),
        F.explode(F.array_distinct(F.flatten(F.transform(base_spans(F.col("line")), entities)))).alias("value"),
    )
    mentions = cut_lineage(mentions, "mentions")
    held = mentions.select("value", "_doc").distinct().groupBy("value").agg(F.count("*").alias("n_e"))
    pairs = mentions.select("_doc", "context", "value", F.explode("words").alias("term"))
    seen = pairs.select("value", "term", "context").distinct().groupBy("value", "term").agg(F.count("*").alias("lines"))
    together = pairs.select("value", "term", "_doc").distinct().groupBy("value", "term").agg(F.count("*").alias("n_te"))
    # PMI is at most the value's information, so fewer documents cannot reach it
    enough = (F.col("lines") >= contexts) | (F.col("n_te") >= PRIOR * alpha / (1 - alpha) - EPSILON)
    evidence = cut_lineage(seen.join(together, ["value", "term"]).where(enough), "evidence")
    # how many documents hold each candidate, over all documents
    count = docs.select(F.explode(_words(text)).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    count = count.join(evidence.select("term").distinct(), "term", "left_semi")
    total = F.lit(docs.count())
    scored = evidence.join(count, "term").join(held, "value")
    sure = F.when(F.col("lines") >= contexts, 1.0).otherwise(F.col("n_te") / (F.col("n_te") + PRIOR))
    pmi = F.log2(F.col("n_te") * total / (F.col("n_t") * F.col("n_e")))
    content = F.log2(total / F.col("n_e"))
    risky = cut_lineage(scored.where((content > 0) & (sure * pmi >= alpha * content - EPSILON)).select("term").distinct(), "risky")
    words = docs.select(*row_key(id_col, text_col), _words(text).alias("words"))
    holding = words.select("_doc", "_of", F.explode("words").alias("term")).join(risky, "term", "left_semi")
    return holding.groupBy("_doc", "_of").agg(F.array_sort(F.collect_set("term")).alias("_terms"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``_base`` and ``_spans``: arrays of (kind, start, end, value), which replace columns of these names.

    A null or empty text has none; a null id is a document of its own; repeated rows have equal spans; an empty table gives
    no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc, of = row_key(id_col, text_col)
    names = {c: fresh(c, docs.columns) for c in ("_doc", "_of", "_terms")}
    known = names["_terms"]
    found = disclosing_terms(docs, id_col=id_col, text_col=text_col).select(*[F.col(c).alias(n) for c, n in names.items()])
    keyed = docs.withColumn(names["_doc"], doc).withColumn(names["_of"], of)
    out = keyed.join(found, [names["_doc"], names["_of"]], "left").withColumn("_base", base_spans(text))
    placed = _placed(_pieces(text, TERM), "term", lambda x: F.array_contains(known, F.lower(x)))
    terms = F.when(F.col(known).isNotNull(), placed)
    return out.withColumn("_spans", F.when(terms.isNull(), F.col("_base")).otherwise(F.concat("_base", terms))).drop(*names.values())


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def sanitised(spans: Column, text: Column) -> Column:
    """The text with pattern spans generalised to ``[kind]`` and terms removed; of overlapping spans the first counts."""
    text = F.coalesce(text, F.lit(""))
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(b["end"] - a["end"]))

    def step(a: Column, s: Column) -> Column:
        label = F.when(s["kind"] == "term", "").otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
        more = F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), label)
        fresh = s["start"] >= a["at"]
        return F.struct(F.when(fresh, s["end"]).otherwise(a["at"]).alias("at"), F.when(fresh, more).otherwise(a["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(ordered, start, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))))
