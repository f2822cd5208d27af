"""Text functions on columns: normalising, splitting, hashing, n-grams."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

BRACKETS = "()[]{}<>"
FNV_OFFSET, FNV_PRIME, U32 = 2166136261, 16777619, 4294967296


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def squeeze(text: Column) -> Column:
    """Lower case, brackets dropped, white space to single spaces, trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), BRACKETS, ""), r"(?U)\s+", " "))


@F.pandas_udf(StringType())
def _compose(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


@F.pandas_udf(StringType())
def _plain(text: pd.Series) -> pd.Series:
    strip = lambda s: unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn"))
    return text.map(strip, na_action="ignore")


#: Characters that NFKC leaves alone, alone and next to each other: ASCII, Latin-1 letters and common punctuation.
COMPOSED = r"\x00-\x7F\u00A1\u00AB\u00BB\u00BF-\u00FF\u2013\u2014\u2018-\u201A\u201C-\u201E\u20AC"


def normalize(text: Column, compose: bool = True, strip_diacritics: bool = False) -> Column:
    """Text as the tokenizer wants it: NFKC, lower case, squeezed. Only texts with characters that NFKC could change leave the
    JVM for it; strip_diacritics drops marks there too."""
    out = F.coalesce(_compose(F.when(text.rlike(f"[^{COMPOSED}]"), text)), text) if compose else text
    return squeeze(_plain(F.lower(out)) if strip_diacritics else out)


def normalize_word(word: Column) -> Column:
    return F.translate(word, BRACKETS, "")


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.length(F.regexp_replace(text, r"(?U)\s+", "")) == 0)


def split_words(text: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def code_points(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda x: x != "")


def alnum_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), lambda x: x != "")


def trim_punctuation(word: Column) -> Column:
    return F.regexp_replace(word, r"['.,;:!?)(]+$", "")


def low_bytes(text: Column) -> Column:
    """The low byte of every UTF-16 unit, as ints."""
    units = F.encode(text, "UTF-16BE")
    hexed = F.hex(units)
    n = (F.length(hexed) / 4).cast("int")
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: F.conv(F.substring(hexed, (i - 1) * 4 + 3, F.lit(2)), 16, 10).cast("int")))


def fnv(text: Column, start: Column | None = None) -> Column:
    """32-bit FNV-1a over the low bytes; start continues an earlier hash."""
    begin = F.lit(FNV_OFFSET).cast("long") if start is None else start
    return F.aggregate(low_bytes(text), begin, lambda h, b: F.pmod(h.bitwiseXOR(b.cast("long")) * FNV_PRIME, F.lit(U32)))


def fnv_bytes(data: Column) -> Column:
    """32-bit FNV-1a of a binary column, byte by byte."""
    hexed = F.hex(data)
    n = (F.length(hexed) / 2).cast("int")
    octets = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: F.conv(F.substring(hexed, i * 2 - 1, F.lit(2)), 16, 10).cast("int")))
    return F.aggregate(octets, F.lit(FNV_OFFSET).cast("long"), lambda h, b: F.pmod(h.bitwiseXOR(b.cast("long")) * FNV_PRIME, F.lit(U32)))


def bucket(text: Column, features: int) -> Column:
    return F.pmod(fnv(text), F.lit(features)).cast("int")


def grams(items: Column, low: int, high: int, glue: str = " ") -> Column:
    """All runs of low..high neighbours of an array, joined by glue."""
    one = lambda a, n: F.when(F.size(a) >= n, F.transform(F.sequence(F.lit(1), F.size(a) - (n - 1)), lambda i: F.array_join(F.slice(a, i, F.lit(n)), glue))).otherwise(F.array().cast("array<string>"))
    return let(items, lambda a: F.concat(*(one(a, n) for n in range(low, high + 1))))


def padded(tokens: Column, order: int, bos: str = "<s>", eos: str = "</s>") -> Column:
    return F.concat(F.array_repeat(F.lit(bos), order - 1), tokens, F.array(F.lit(eos)))


def split_list(text: Column, mark: str = r"\|") -> Column:
    return F.filter(F.transform(F.split(text, mark), lambda x: F.trim(x)), lambda x: x != "")


def csv_safe(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit('"'), F.lit('""')), F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))
