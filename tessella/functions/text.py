"""Tokens, pattern matching and the display form of values."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The parameters of BM25.
K1, B = 1.5, 0.75

_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case; null has none."""
    spaced = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]+", " "), *_ASCII)
    return F.array_remove(F.split(spaced, " "), "")


def query_terms(query: str) -> dict[str, int]:
    """Terms of a query and how often each occurs in it."""
    found: dict[str, int] = {}
    for term in re.findall("[A-Za-z0-9]+", query):
        term = term.lower()
        found[term] = found.get(term, 0) + 1
    return found


def _as_token(terms: list[str]) -> str:
    """A pattern for any of some terms as a whole token; a search needs no list of tokens then."""
    return f"(?i)(?<![A-Za-z0-9])(?:{'|'.join(terms)})(?![A-Za-z0-9])"


def matches(text: Column, query: str) -> Column:
    """Does any term of the query occur?  A null text has none."""
    terms = sorted(query_terms(query))
    return F.coalesce(text.rlike(_as_token(terms)), F.lit(False)) if terms else F.lit(False)


def length(text: Column) -> Column:
    """The number of tokens."""
    return F.coalesce(F.regexp_count(text, F.lit("[A-Za-z0-9]+")), F.lit(0))


def occurrences(text: Column, term: str) -> Column:
    """How often a term is a token."""
    return F.coalesce(F.regexp_count(text, F.lit(_as_token([term]))), F.lit(0))


def bm25_term(tf: Column, length: Column, mean_length: Column, docs: Column, docs_with: Column) -> Column:
    """What one term adds to the score of a document; nothing where it doesn't occur."""
    idf = F.log(1 + (docs - docs_with + 0.5) / (docs_with + 0.5))
    mean = F.when(mean_length > 0, mean_length).otherwise(1.0)
    return idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length / mean))


def like_pattern(pattern: str) -> str:
    """An anchored regular expression: ``%`` any characters, ``_`` one; a backslash escapes ``%``, ``_`` and itself."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and pattern[i + 1 : i + 2] in ("%", "_", "\\"):
            i += 1
            out += re.escape(pattern[i])
        elif c == "%":
            out += ".*"
        elif c == "_":
            out += "."
        else:
            out += re.sub(r"([^\w\s]|\s)", r"\\\1", c) if ord(c) < 128 else c
        i += 1
    return rf"(?is)\A{out}\z"


def like_column(pattern: Column) -> Column:
    """:func:`like_pattern` for a pattern that only the rows know."""
    # escaped characters wait under private-use code points while the others are translated
    kept = F.replace(F.replace(F.replace(pattern, F.lit("\\\\"), F.lit("\ue000")), F.lit("\\%"), F.lit("\ue001")), F.lit("\\_"), F.lit("\ue002"))
    plain = F.regexp_replace(kept, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    wild = F.replace(F.replace(plain, F.lit("%"), F.lit(".*")), F.lit("_"), F.lit("."))
    back = F.replace(F.replace(F.replace(wild, F.lit("\ue000"), F.lit("\\\\")), F.lit("\ue001"), F.lit("%")), F.lit("\ue002"), F.lit("_"))
    return F.concat(F.lit(r"(?is)\A"), back, F.lit(r"\z"))


def display(value: Column, kind: str) -> Column:
    """The text of a value; whole reals have no fraction, vectors are bracketed."""
    if kind == "real":
        whole = (value == F.floor(value)) & (F.abs(value) < 9e15)
        return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))
    if kind == "vector":
        parts = F.transform(value, lambda x: F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string")))
        return F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]"))
    return value.cast("string")
