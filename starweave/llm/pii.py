"""Personal data spans, in DataFrame functions only.

Regular expressions propose spans, checksums and ranges confirm them (Luhn for cards, mod-97 for IBANs, parts of an IP
address), and words in the CONTEXT_CHARS characters before a span move its score. A span stays at MIN_SCORE or more; the
four base kinds start above it.

A match's place is found by splitting the text at the same pattern: the lengths of the pieces and of the matches up to it
add up to its end. Running sums go in blocks of sqrt(n), as Spark copies an array for each value appended; so do the cuts
of `redact`, as a substring is found by walking the text. A text with n matches costs its length times sqrt(n) at most.
Loops over groups are possessive, so the regex engine does not recurse on very long texts.

Edge cases: null texts are empty and have no spans; `redact` leaves them null. Spans of different kinds may overlap;
`redact` merges those, named after the first (ties of start: the kind listed first). Places are code points, ends
exclusive. Texts of any length and any number of matches are searched whole. Repeated rows are judged each, an empty table
gives an empty one; extra columns pass through `redact` untouched, whatever their names, and are not read by `find`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SCORE, CONTEXT_CHARS = 0.6, 40

#: kind: (cheap guard, pattern, score, context words, score they add). The order is the kinds' order in digests.
KINDS: dict[str, tuple[str, str, float, str, float]] = {
    "email": ("@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, r"mail|contact|write|kontakt|correo|courriel", 0.1),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.7, r"\bip\b|address|host|server|login", 0.2),
    "card": (r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", r"[0-9](?:[ -]?[0-9])++", 0.8, r"card|visa|pay|karte|carte|tarjeta", 0.2),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", 0.7, r"tel|phone|call|mobil|fax", 0.2),
    "iban": (r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", 0.7, r"iban|konto|account|bank", 0.2),
    "ssn": (r"[0-9]-[0-9]{2}-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, r"ssn|social security|tax id", 0.5),
    "secret": (r"[0-9A-Fa-f]{32}", r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,128}(?![A-Za-z0-9])", 0.3, r"token|secret|password|passwd|api.?key", 0.5),
}
BASE = ("email", "ip", "card", "phone")
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once: inside a lambda, any other expression is computed for each element."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """The running totals of an array of non-negative integers, in blocks of sqrt(n)."""

    def within(block: Column) -> Column:
        return F.aggregate(block, F.array().cast("array<int>"), lambda out, x: F.array_append(out, add(F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0)), x)))

    def all_blocks(inner: Column) -> Column:
        before = F.aggregate(inner, F.array(F.lit(0)), lambda out, b: F.array_append(out, add(F.element_at(out, -1), F.element_at(b, -1))))
        return F.flatten(F.zip_with(inner, F.slice(before, 1, F.size(inner)), lambda b, h: F.transform(b, lambda x: add(h, x))))

    def blocks(v: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(v))).cast("int")
        cut = F.transform(F.sequence(F.lit(1), F.size(v), step), lambda i: F.slice(v, i, step))
        return F.when(F.size(v) > 0, _let(F.transform(cut, within), all_blocks)).otherwise(F.array().cast("array<int>"))

    return _let(values, blocks)


def luhn(digits: Column) -> Column:
    """True if the string of digits passes the Luhn check."""

    def check(back: Column) -> Column:
        def add(total: Column, i: Column) -> Column:
            x = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
            return total + F.when(x > 9, x - 9).otherwise(x)

        return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), add) % 10 == 0

    return _let(F.reverse(digits), check)


def mod97(iban: Column) -> Column:
    """True if the letters and digits of an account number leave 1 modulo 97 (country and check digits moved to the end)."""

    def check(turned: Column) -> Column:
        def step(rest: Column, i: Column) -> Column:
            c = F.ascii(F.substring(turned, i, F.lit(1)))
            return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97).cast("int")

        return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1

    return _let(F.regexp_replace(iban, " ", ""), lambda flat: _let(F.concat(F.substring(flat, F.lit(5), F.length(flat)), F.substring(flat, 1, 4)), check))


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return _let(_digits(match), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    if kind == "iban":
        return mod97(match)
    return F.lit(True)


_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


#: The shortest match has five characters, so this many matches before a span fill its context.
_MATCHES_BEFORE = -(-CONTEXT_CHARS // 5)


def _spans_of(kind: str, rank: int, text: Column) -> Column:
    guard, pattern, score, context, more = KINDS[kind]

    def parts(s: Column) -> Column:
        """Each match with the end of what lies before it, and of that with the match."""
        return F.zip_with(s["m"], F.slice(s["g"], 1, F.size(s["m"])), lambda m, g: F.struct(
            m.alias("m"), F.right(g, F.lit(CONTEXT_CHARS)).alias("before"), F.right(F.concat(g, m), F.lit(CONTEXT_CHARS)).alias("upto"), (F.length(g) + F.length(m)).alias("n"),
        ))

    def placed(s: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            earlier = F.slice(s["p"], F.greatest(i - (_MATCHES_BEFORE - 1), F.lit(1)), F.least(i, F.lit(_MATCHES_BEFORE)))
            near = F.right(F.concat(F.array_join(F.transform(earlier, lambda q: q["upto"]), ""), p["before"]), F.lit(CONTEXT_CHARS))
            end = F.element_at(s["end"], i + 1)
            return F.struct(
                (end - F.length(p["m"])).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"),
                F.when(_confirmed(kind, p["m"]), F.when(F.lower(near).rlike(context), score + more).otherwise(F.lit(score))).otherwise(F.lit(0.0)).alias("score"),
            )

        return F.filter(F.transform(s["p"], one), lambda x: x["score"] >= MIN_SCORE)

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    found = _let(both, lambda s: _let(parts(s), lambda p: _let(F.struct(p.alias("p"), _running(F.transform(p, lambda x: x["n"]), lambda x, y: x + y).alias("end")), placed)))
    return F.when(text.rlike(guard), found).otherwise(F.array().cast(_SPAN))


def spans(text: Column) -> Column:
    """array<struct<start, rank, end, kind, score>> by start, then kind."""
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(F.flatten(F.array(*(_spans_of(k, i, text) for i, k in enumerate(KINDS)))))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, doc_col="doc_id", text_col="text") -> DataFrame:
    """Per document: doc_id and its spans."""
    return docs.select(F.col(doc_col).alias("doc_id"), spans(F.col(text_col)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))

    def count(rank: int, kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{kind}")

    counts = [count(i, k) for i, k in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _merged(found: Column) -> Column:
    """Spans by start with overlapping ones as one: array<struct<start, end, kind>>."""

    def groups(s: Column) -> Column:
        # a span opens a group where it starts at or after the largest end before it; the group ends at the largest end then
        n = F.size(s["s"])
        opens = F.filter(F.sequence(F.lit(1), n), lambda i: F.when(i > 1, F.element_at(s["s"], i)["start"] >= F.element_at(s["end"], i - 1)).otherwise(True))
        return _let(opens, lambda o: F.transform(o, lambda i, j: F.struct(
            F.element_at(s["s"], i)["start"].alias("start"), F.element_at(s["end"], F.coalesce(F.get(o, j + 1) - 1, n)).alias("end"), F.element_at(s["s"], i)["kind"].alias("kind"),
        )))

    return _let(found, lambda x: _let(F.struct(x.alias("s"), _running(F.transform(x, lambda y: y["end"]), lambda a, b: F.greatest(a, b)).alias("end")), groups))


def _replaced(text: Column, m: Column) -> Column:
    """text with each of the spans m (by start, apart, at least one) replaced by its kind in brackets."""
    step = F.ceil(F.sqrt(F.size(m))).cast("int")
    blocks = F.transform(F.sequence(F.lit(1), F.size(m), step), lambda i: F.struct(F.when(i > 1, F.element_at(m, i - 1)["end"]).otherwise(0).alias("at"), F.slice(m, i, step).alias("s")))
    cut = F.transform(blocks, lambda b: F.struct(b["at"].alias("at"), b["s"].alias("s"), F.substring(text, b["at"] + 1, F.element_at(b["s"], -1)["end"] - b["at"]).alias("t")))

    def block(b: Column) -> Column:
        def one(x: Column, j: Column) -> Column:
            at = F.when(j > 0, F.get(b["s"], j - 1)["end"]).otherwise(b["at"])
            return F.concat(F.substring(b["t"], at - b["at"] + 1, x["start"] - at), F.lit("["), F.upper(x["kind"]), F.lit("]"))

        return F.array_join(F.transform(b["s"], one), "")

    return F.concat(F.array_join(F.transform(cut, block), ""), F.substring(text, F.element_at(m, -1)["end"] + 1, F.length(text)))


def redact(docs: DataFrame, text_col="text") -> DataFrame:
    """docs with each span (overlapping ones merged, named after the first) replaced by its kind in brackets."""
    text = F.col(text_col)
    clean = _let(spans(text), lambda s: F.when(F.size(s) > 0, _let(_merged(s), lambda m: _replaced(text, m))).otherwise(text))
    return docs.withColumn(text_col, clean)
