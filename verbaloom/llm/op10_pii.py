"""PII in DataFrame functions only: patterns propose, checksums confirm, context scores.

A kind is a pattern whose matches (leftmost, without overlap) pass a validator. Places come from
the gaps that split() leaves between the matches. Patterns that could be retried inside a long run
of their own characters start at a run's first character or where the last match ended (\\G), and
don't give back what they took, so that time stays linear and no match of the plain pattern is lost
or changed. Starts are running sums in two levels, and what stands around a span is cut from blocks
of the text, so a text of n characters and k spans takes time n + k * BLOCK. IBANs have their country's length and pass mod-97. Context words within `reach` characters raise a span's score; kinds
that have no checksum (ssn) need them.

Null text counts as empty: no spans, hash of the empty string. Rows are independent: repeated rows
repeat, empty tables give empty results, extra columns are ignored. Spans are in order of kind,
then start; offsets are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import let


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def valid_ip(m: Column) -> Column:
    short = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(m, "\\."), lambda p: F.when(F.length(short(p)) <= 3, F.concat(F.lit("0"), short(p)).cast("int") <= 255).otherwise(False))


def luhn(d: Column) -> Column:
    """Every second digit from the right doubles, less 9 if above 9; the sum ends in 0."""

    def value(c: Column, i: Column) -> Column:
        n = c.cast("int")
        return F.when(i % 2 == 0, n).when(n > 4, 2 * n - 9).otherwise(2 * n)

    return F.aggregate(F.transform(F.split(F.reverse(d), "", -1), lambda c, i: F.when(c == "", 0).otherwise(value(c, i))), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid_card(m: Column) -> Column:
    return F.length(digits(m)).between(13, 19) & luhn(digits(m))


def valid_phone(m: Column) -> Column:
    return F.length(digits(m)).between(9, 15)


def mod97(m: Column) -> Column:
    """The first four characters move to the end, letters count 10 to 35; remainder 1."""
    plain = F.regexp_replace(m, " ", "")
    moved = F.concat(F.substring(plain, 5, 60), F.substring(plain, 1, 4))

    def step(a: Column, c: Column) -> Column:
        v = F.when(c == "", F.lit(None)).when(F.ascii(c) < 58, F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.when(v.isNull(), a).when(v < 10, (a * 10 + v) % 97).otherwise((a * 100 + v) % 97)

    return F.length(plain).between(15, 34) & (F.aggregate(F.split(moved, "", -1), F.lit(0), step) == 1)


#: IBAN lengths of the registry by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def iban_pattern() -> str:
    """A country's IBANs have its length, so that no word behind one is taken in; else any length."""

    def groups(length: int) -> str:
        whole, rest = divmod(length - 4, 4)
        return f"(?:\\x20?[A-Z0-9]{{4}}){{{whole}}}" + (f"\\x20?[A-Z0-9]{{{rest}}}" if rest else "")

    known = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}{groups(n)}" for n, c in IBAN_LENGTHS.items())
    return rf"(?:{known})(?![A-Za-z0-9])|[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}(?:\x20?[A-Z0-9]{{1,3}})?"


class Kind(NamedTuple):
    name: str
    gate: str  # a plain pattern without which there is no match
    pattern: str
    valid: Callable[[Column], Column] | None
    context: str  # of lower-cased text around a span
    alone: float  # score without and with context; below 0.5 no span
    near: float
    bounded: bool = False  # no letter or digit may touch it


#: The base kinds' languages (as patterns that don't backtrack) and context words.
KINDS = (
    Kind("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None, "mail|contact|kontakt|correo|courriel|write", 0.9, 1.0),
    Kind("ip", "[0-9]\\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", valid_ip, "ip|host|server|address|login|addr", 0.7, 0.9),
    Kind("card", "[0-9][ -]?[0-9]", r"[0-9](?:[\x20-]?[0-9])++", valid_card, "card|karte|carte|tarjeta|visa|pay|credit", 0.7, 0.95),
    Kind("phone", "\\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", valid_phone, "tel|phone|call|fon|fax|llama|appel", 0.7, 0.9),
    Kind("iban", "[A-Z][A-Z][0-9][0-9]", iban_pattern(), mod97, "iban|account|konto|compte|cuenta|bank", 0.9, 1.0, True),
    Kind("ssn", "-[0-9][0-9]-", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", None, "ssn|social security", 0.2, 0.9, True),
)
BASE, REACH, BLOCK = ("email", "ip", "card", "phone"), 40, 1000
SPAN = "struct<kind:string,start:int,end:int,score:double>"


def running(values: Column, op: Callable[[Column, Column], Column], neutral: int = 0) -> Column:
    """Inclusive running op (associative) of an int array: within blocks of about sqrt(n), then over
    blocks, since an array grows by copying."""
    last = lambda a: F.get(a, F.size(a) - 1)
    none = F.array().cast("array<int>")

    def scan(block: Column) -> Column:
        return F.aggregate(block, none, lambda acc, x: F.concat(acc, F.array(op(F.coalesce(last(acc), F.lit(neutral)), x))))

    def scanned(v: Column) -> Column:
        n, b = F.size(v), F.ceil(F.sqrt(F.size(v))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / b).cast("int")), lambda i: scan(F.slice(v, i * b + 1, b)))

    def summed(s: Column) -> Column:
        bases = F.aggregate(s, F.array(F.lit(neutral)), lambda acc, block: F.concat(acc, F.array(op(last(acc), last(block)))))
        return let(bases, lambda z: F.flatten(F.transform(s, lambda block, i: F.transform(block, lambda x: op(F.get(z, i), x)))))

    return let(values, lambda v: F.when(F.size(v) == 0, none).otherwise(let(scanned(v), summed)))


def blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(parts: Column, start: Column, length: Column) -> Column:
    """A substring (start from 0) of the text whose blocks are parts."""
    first = F.floor(start / BLOCK).cast("int")
    whole = F.array_join(F.slice(parts, first + 1, F.floor((start + length) / BLOCK).cast("int") - first + 1), "")
    # slice() copies its array, get() doesn't
    two = F.concat(F.coalesce(F.get(parts, first), F.lit("")), F.coalesce(F.get(parts, first + 1), F.lit("")))
    return F.substring(F.when(length <= BLOCK, two).otherwise(whole), F.pmod(start, F.lit(BLOCK)) + 1, length)


def kind_spans(text: Column, kind: Kind) -> Column:
    """Array of spans of one kind; most texts stop at the gate."""
    hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)

    def placed(h: Column) -> Column:
        sizes = F.transform(F.arrays_zip(gaps.alias("g"), h.alias("h")), lambda z: F.length(z["g"]) + F.length(F.coalesce(z["h"], F.lit(""))))
        return let(running(sizes, lambda a, b: a + b), lambda ends: F.transform(h, lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("m"))))

    def judged(parts: Column) -> Column:
        def one(s: Column) -> Column:
            """start, end, text around, place in it."""
            at = F.greatest(s["start"] - REACH, F.lit(0))
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), cut(parts, at, s["end"] - s["start"] + 2 * REACH).alias("around"), (s["start"] - at).alias("own"))

        def untouched(s: Column) -> Column:
            before = F.when(s["own"] > 0, F.substring(s["around"], s["own"], F.lit(1))).otherwise("")
            after = F.substring(s["around"], s["own"] + s["end"] - s["start"] + 1, F.lit(1))
            return ~before.rlike("[A-Za-z0-9]") & ~after.rlike("[A-Za-z0-9]")

        def scored(s: Column) -> Column:
            score = F.when(F.lower(s["around"]).rlike(kind.context), kind.near).otherwise(kind.alone)
            return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"))

        valid = (lambda s: F.lit(True)) if kind.valid is None else (lambda s: kind.valid(s["m"]))
        around = F.transform(F.filter(let(hits, placed), valid), one)
        return F.filter(F.transform(F.filter(around, untouched) if kind.bounded else around, scored), lambda s: s["score"] >= 0.5)

    found = let(blocks(text), judged)
    return F.when(text.contains(kind.gate) if kind.gate == "@" else text.rlike(kind.gate), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def with_spans(docs: DataFrame, text: str = "text", column: str = "pii") -> DataFrame:
    """docs with an array of (kind, start, end, score) under `column`."""
    return docs.withColumn(column, let(common.text_of(text), lambda t: F.concat(*[kind_spans(t, k) for k in KINDS])))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """Spans become [KIND]; overlapping spans are one, named by the first to start, then the longest."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))

    def cleaned(o: Column) -> Column:
        reach = running(F.transform(o, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
        return let(reach, lambda r: let(blocks(text), lambda parts: F.array_join(F.transform(heads(o, r), lambda z: piece(z, parts)), "")))

    def heads(o: Column, r: Column) -> Column:
        """Spans that start behind all before them, with where those end; then the end of the text."""
        each = F.transform(o, lambda x, i: F.struct(F.coalesce(F.get(r, i - 1), F.lit(0)).alias("after"), x["start"].alias("start"), x["kind"].alias("kind")))
        end = F.struct(F.get(r, F.size(r) - 1).alias("after"), F.length(text).alias("start"), F.lit(None).cast("string").alias("kind"))
        return F.concat(F.filter(each, lambda z: z["start"] >= z["after"]), F.array(end))

    def piece(z: Column, parts: Column) -> Column:
        return F.concat(cut(parts, z["after"], z["start"] - z["after"]), F.when(z["kind"].isNull(), "").otherwise(F.concat(F.lit("["), F.upper(z["kind"]), F.lit("]"))))

    return F.when(F.size(spans) == 0, text).otherwise(let(ordered, cleaned))


def op10_pii(spark, sf_dir) -> DataFrame:
    docs = with_spans(common.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    top = F.coalesce(F.array_max(F.transform("pii", lambda s: s["score"])), F.lit(0.0))
    return docs.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), top.alias("score"))
