"""Quality gates: the first failing reason, hits of identifier patterns, strata and roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hash_bucket, letter_ratio, strip_text

#: Patterns by which a text counts as holding an identifier, without look-around (fixed values).
IDENTIFIERS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "url": r"(?:https?://|www\.)[^ \t\r\n]+",
    "handle": r"(?:^|[^\p{L}\p{N}_])@[A-Za-z0-9_]{3,}",
    "phone": r"(?:\+|\(?[0-9])[0-9 \t\r\n().-]{7,}[0-9]",
    "long_digits": r"[0-9]{5,}",
    "date": r"(?:^|[^\p{L}\p{N}_])[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}(?:$|[^\p{L}\p{N}_])",
}
#: Upper ends of the hash buckets of each role (fixed values).
ROLES = (("dev", 20), ("rotation_1", 45), ("rotation_2", 70), ("final", 100))


#: Languages whose words aren't parted by blanks (fixed values).
UNPARTED = ("zh", "ja", "th")


def quality_reason(text: Column, language: Column, least: int = 40, most: int = 2_000) -> Column:
    """Name of the first gate that a text without the blanks at its ends fails, null if it passes all; null texts fail as too short.

    The longest word counts in languages with blanks between words alone. all_caps: over 40 characters, no small letter,
    and capitals in over 0.6 of all characters.
    """
    t = strip_text(text)
    n = F.greatest(F.lit(1), F.length(t))
    upper = F.length(F.regexp_replace(t, r"\P{Lu}", ""))
    longest = F.array_max(F.transform(F.split(t, r"[\s\p{Z}]+"), lambda w: F.length(w)))
    return (
        F.when(t.isNull() | (F.length(t) < least), "too_short")
        .when(F.length(t) > most, "too_long")
        .when(letter_ratio(t) < 0.5, "low_letter_ratio")
        .when(t.contains("\n"), "internal_line_break")
        .when(~F.coalesce(language.isin(*UNPARTED), F.lit(False)) & (longest > 60), "overlong_token")
        .when((F.length(t) > 40) & ~t.rlike(r"\p{Ll}") & (upper / n > 0.6), "all_caps")
    )


def identifier_hits(text: Column) -> Column:
    """Names of the identifier patterns that the text holds, in the order of the table; none for null."""
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in IDENTIFIERS.items()]), lambda x: x.isNotNull())


def cue_count(text: Column, cues: list[str]) -> Column:
    """Occurrences of any of the cue words."""
    pattern = "|".join(rf"\b{c}\b" for c in cues)
    return F.regexp_count(F.coalesce(F.lower(text), F.lit("")), F.lit(pattern))


def stratum(text: Column, cues: dict[str, list[str]], least: int = 2, least_fields: int = 2) -> Column:
    """identifier, reference or ordinary, the first that applies. A reference has cues enough, from several fields (field -> its cues)."""
    n = [cue_count(text, words) for words in cues.values()]
    total, fields = F.lit(0), F.lit(0)
    for c in n:
        total, fields = total + c, fields + (c > 0).cast("int")
    return F.when(F.size(identifier_hits(text)) > 0, "identifier").when((total >= least) & (fields >= least_fields), "reference").otherwise("ordinary")


def role(key: Column) -> Column:
    b, out = hash_bucket(key), F.lit(None).cast("string")
    for name, end in reversed(ROLES):
        out = F.when(b < end, name).otherwise(out)
    return out


def with_quality(df: DataFrame, text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    return df.withColumn("reason", quality_reason(F.col(text_col), F.col(lang_col) if lang_col else F.lit(None).cast("string")))
