"""Tokenisers as column expressions.  Null text gives a null array; empty text an empty one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: token patterns -----------------------------------------------------------
WORD = r"[\p{L}\p{N}_]+"
ASCII = r"[a-z]+"
SPANISH = r"[a-záéíóúñ]+"
LETTERS = r"[\p{L}\p{Nl}\p{No}]+"
_B1, _B2 = r"(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_])", r"(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])"
EMAIL = r"[a-zA-Z0-9._-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
URL = r"[a-zA-Z]+://[-a-zA-Z0-9@:%._\+~#=]+(?:\.[a-zA-Z0-9()]+)+(?:[-a-zA-Z0-9()@:%_\+.~#?&//=]*)"
DATE = _B1 + r"\p{Nd}{1,4}[-/]\p{Nd}{1,2}[-/]\p{Nd}{1,4}" + _B2
PHONE = {1: r"(?:\+\p{Nd}{1,3}[-])?\(?\p{Nd}{2,4}\)?[-]\p{Nd}{3,4}(?:[-]\p{Nd}{3,4})?", 2: r"(?:\+\p{Nd}{1,3}[ -])?\(?\p{Nd}{2,4}\)?[ -]\p{Nd}{3,4}(?:[ -]\p{Nd}{3,4})?"}
NUMBER = _B1 + r"\p{Nd}+(?:[\.,]\p{Nd}+)?" + _B2
ABBREVIATION = {1: _B1 + r"(?:[A-Z]+[a-z]*\.)+[A-Z]*", 2: _B1 + r"(?:[A-Z][a-z]*\.)+"}
ACRONYM = _B1 + r"[A-Z]{2,}" + _B2
PROPER_NAME = _B1 + r"[A-Z][a-z]+(?: [A-Z][a-z]+)*" + _B2
# --------------------------------------------------------------------------------------------


def matches(text: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(pattern), F.lit(0))


def tokens(text: Column | str, pattern: str = LETTERS) -> Column:
    """Lower-cased runs of ``pattern``."""
    return matches(F.lower(text), pattern)


def _classes(version: int) -> tuple[tuple[str, str], ...]:
    return ("email", EMAIL), ("url", URL), ("date", DATE), ("phone", PHONE[version]), ("number", NUMBER), ("abbreviation", ABBREVIATION[version]), ("acronym", ACRONYM), ("name", PROPER_NAME)


def structured_columns(df: DataFrame, text: str, version: int = 2) -> DataFrame:
    """``df`` with a column of tokens for each class, as :func:`structured`, in steps: what is left of a text is made once for each class."""
    got = df.withColumn("__rest", F.col(text))
    for name, pattern in _classes(version):
        got = got.withColumn(name, matches("__rest", pattern)).withColumn("__rest", F.regexp_replace("__rest", pattern, ""))
    return got.withColumn("letters", tokens("__rest", LETTERS)).drop("__rest")


def structured(text: Column | str, version: int = 2) -> dict[str, Column]:
    """Token arrays by class; each class's matches are deleted before the next is searched.

    Version 1 takes phones with dashes only and abbreviations with an open end; version 2 also takes
    blanks in phones.  ``letters`` is what is left, lower-cased.
    """
    rest, out = F.col(text) if isinstance(text, str) else text, {}
    for name, pattern in _classes(version):
        out[name] = matches(rest, pattern)
        rest = F.regexp_replace(rest, pattern, "")
    out["letters"] = tokens(rest, LETTERS)
    return out


def structured_tokens(text: Column | str, version: int = 2) -> Column:
    """All classes in one array, in the order of the classes."""
    return F.concat(*structured(text, version).values())


def letters_only(text: Column | str) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}]", "")


def kept_length(least: int, most: int, term: str = "term") -> Column:
    return F.length(term).between(least, most)
