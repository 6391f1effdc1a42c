"""Scalar text functions as Catalyst columns. Only NFC needs Python, and only for the texts that a
quick check can't clear."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values. White space of words (with the separators U+001C-1F) and of units (without).
WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
WS_UNI = r"[\s\x0b\x85\p{Z}]"
UNIT = r"[\p{L}\p{M}\p{N}]+|[^\s\x0b\x85\p{Z}\p{L}\p{M}\p{N}]"
WORD_CHAR = r"\p{L}\p{N}_ऀ-ॿఀ-౿"
CITATION = r"\[[^\]\n]{1,15}\]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
MARK = "▁"
WORD_CAP = 3000


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc_texts(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with `column` in NFC. Characters below U+0300 are in NFC already, so texts made of them
    stay in the JVM; a UDF in a CASE would get every row, so the branches are a union."""
    odd = F.coalesce(F.col(column).rlike(r"[^\x00-\u02ff]"), F.lit(False))
    return docs.filter(~odd).unionByName(docs.filter(odd).withColumn(column, nfc(column)))


def collapse(t: Column) -> Column:
    """White space runs to one space, ends stripped (the rest of normalization after NFC)."""
    return F.trim(F.regexp_replace(t, WS + "+", " "))


def strip(t: Column) -> Column:
    return F.regexp_replace(t, f"^{WS}+|{WS}+$", "")


def pieces(t: Column) -> Column:
    """White space pieces of a collapsed text."""
    return F.filter(F.split(t, " "), lambda x: x != "")


def strip_edges(w: Column) -> Column:
    return F.regexp_replace(w, f"^[^{WORD_CHAR}]+|[^{WORD_CHAR}]+$", "")


def words(t: Column) -> Column:
    """Words of a collapsed text: pieces without edge punctuation, empties dropped."""
    return F.filter(F.transform(pieces(t), strip_edges), lambda x: x != "")


def faithful_units(t: Column) -> Column:
    return F.regexp_count(t, F.lit(UNIT)).cast("long")


def units(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(UNIT), F.lit(0))


def visible(t: Column) -> Column:
    return F.regexp_replace(t, WS_UNI, "")


def first_sentence(t: Column, lo: int = 40, hi: int = 200) -> Column:
    sized = F.filter(F.split(t, r"(?<=[।.!?])\s+"), lambda s: F.char_length(s).between(lo, hi))
    return F.coalesce(F.get(sized, F.lit(0)), F.substring(t, 1, hi))


def sample_line(t: Column, lo: int = 60, hi: int = 160) -> Column:
    lines = F.transform(F.split(t, LINE_END), strip)
    good = F.filter(lines, lambda s: F.char_length(s).between(lo, hi) & s.rlike(r"\p{L}") & ~s.rlike(r"^[#\-|!]"))
    return F.coalesce(F.get(good, F.lit(0)), F.substring(strip(t), 1, hi))


def strip_citations(t: Column) -> Column:
    return F.regexp_replace(t, CITATION, "")


def normalize_markdown(t: Column) -> Column:
    """NBSP to space, newline runs of 4 or more to 3, blanks before a newline off, in this order."""
    t = F.regexp_replace(F.regexp_replace(F.replace(t, F.lit("\u00a0"), F.lit(" ")), r"\n{4,}", "\n\n\n"), r"[ \t]+\n", "\n")
    return F.concat(strip(t), F.lit("\n"))


def url_quote(t: Column) -> Column:
    """Percent-encoding that keeps / and ~ and encodes a space as %20."""
    q = F.url_encode(t)
    for a, b in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        q = F.replace(q, F.lit(a), F.lit(b))
    return q


def absolute_link(href: Column, host: str, base: str) -> Column:
    return (
        F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("./"), F.concat(F.lit(base), F.substring(href, 3, F.lit(2**31 - 1))))
        .when(href.startswith("/"), F.concat(F.lit(host), href)).otherwise(href)
    )


def penalty(ratio: Column, threshold: float = 1.2) -> Column:
    return F.exp(F.greatest(F.lit(0.0), ratio / threshold - 1))


def display_token(t: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), (" ", "·"), (MARK, "·")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def metaspace(t: Column) -> Column:
    """Pieces that start at each space mark; other white space stays inside."""
    return F.regexp_extract_all(F.replace(t, F.lit(" "), F.lit(MARK)), F.lit(f"{MARK}[^{MARK}]*|[^{MARK}]+"), F.lit(0))


def lines_kept(t: Column) -> Column:
    """Lines with their newline: what the joint trainer learns from."""
    return F.regexp_extract_all(t, F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0))


def decode_metaspace(tokens: Column, unknown: str = "[UNK]") -> Column:
    return F.replace(F.array_join(F.filter(tokens, lambda x: x != unknown), ""), F.lit(MARK), F.lit(" "))


def script(ch: Column, names: tuple[str, ...] = ("Latin", "Devanagari", "Telugu")) -> Column:
    """The first of these scripts that a character belongs to."""
    out = F.lit(None).cast("string")
    for name in reversed(names):
        out = F.when(ch.rlike(rf"\p{{Is{name}}}"), name).otherwise(out)
    return out
