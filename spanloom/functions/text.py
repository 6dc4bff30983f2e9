"""Column functions on text: normal forms, hashes, n-grams, scripts and shapes.

Null in gives null out. ``norm_sql`` is the normal form that both SQL engines share; ``normalize_exact`` applies NFKC and
full case folding in an Arrow UDF.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Scripts told apart in profiles, with their property names (fixed values).
SCRIPTS = ("Latin", "Cyrillic", "Arabic", "Devanagari", "Thai", "Han", "Hiragana", "Katakana", "Hangul", "Greek", "Hebrew")


def norm_sql(text: Column) -> Column:
    """Small letters, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\p{Z}]+", " "))


@F.pandas_udf(StringType())
def normalize_exact(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


def text_id(text: Column) -> Column:
    """First 24 hex digits of the SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 24)


def row_hash(*columns: str) -> Column:
    """SHA-256 of a canonical rendering of the columns, in the order of their names; nulls are told apart from empty strings."""
    parts = [F.coalesce(F.concat(F.lit(c + "="), F.col(c).cast("string")), F.lit(c)) for c in sorted(columns)]
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def hash_bucket(key: Column, buckets: int = 100) -> Column:
    """The first 8 hex digits of the SHA-256 as a number, modulo the buckets."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def hash_fold(key: Column, modulus: int) -> Column:
    """The first 16 hex digits of the SHA-256 as an unsigned number, modulo the modulus."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)") % modulus).cast("int")


def hash_unit(key: Column) -> Column:
    """A number in (0, 1) from the first 12 hex digits of the SHA-256."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def char_ngrams(text: Column, n: int) -> Column:
    """All substrings of n characters, in order; none for shorter texts."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda k: F.substring(text, k, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def letter_ratio(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{L}", "")) / F.greatest(F.lit(1), F.length(text))


def script_profile(text: Column) -> Column:
    """Names of the scripts in the text, joined by +."""
    return F.concat_ws("+", *[F.when(text.rlike(rf"\p{{{'Is' + s}}}"), F.lit(s)) for s in SCRIPTS])


def shape_ascii(text: Column) -> Column:
    """Runs of letters and digits as L and D with the length class of the run left out; other characters stay."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[A-Z]+", "U"), "[a-z]+", "l"), "[0-9]+", "D")


def language_tag(tag: Column) -> Column:
    """Language subtag of a BCP 47 tag in small letters, null if it isn't two or three letters."""
    head = F.lower(F.split_part(F.regexp_replace(F.trim(tag), "_", "-"), F.lit("-"), F.lit(1)))
    return F.when(head.rlike("^[a-z]{2,3}$"), head)


def strip_text(text: Column) -> Column:
    """Text without Unicode white space at its ends."""
    return F.regexp_replace(F.regexp_replace(text, r"^[\s\p{Z}]+", ""), r"[\s\p{Z}]+$", "")
