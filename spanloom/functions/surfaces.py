"""Column functions on surfaces: scripts, letter case, durations, and the paragraph around a span. Null in gives null out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Script of the languages that have one of their own (fixed values); all others count as Latin.
SCRIPT_OF = {"ru": "Cyrillic", "uk": "Cyrillic", "bg": "Cyrillic", "ar": "Arabic", "fa": "Arabic", "ur": "Arabic", "hi": "Devanagari", "mr": "Devanagari", "th": "Thai", "ko": "Hangul", "el": "Greek", "he": "Hebrew"}


def script_bucket(value: Column) -> Column:
    """The first of the scripts that a value has; latin if it has no other letters; else mixed-or-other."""
    has = lambda s: value.rlike(rf"\p{{Is{s}}}")
    out = F.when(value.rlike(r"[\p{IsHiragana}\p{IsKatakana}]"), "japanese").when(has("Hangul"), "korean").when(has("Han"), "han")
    for s in ("Arabic", "Cyrillic", "Devanagari"):
        out = out.when(has(s), s.lower())
    latin = value.rlike(r"\p{L}") & ~F.regexp_replace(value, r"\p{IsLatin}", "").rlike(r"\p{L}")
    return F.when(value.isNotNull(), out.when(latin, "latin").otherwise("mixed-or-other"))


def in_script(text: Column, language: Column) -> Column:
    """Whether half of the letters or more belong to the script of the language; false without letters."""
    letters = F.length(F.regexp_replace(text, r"\P{L}", ""))
    inside = lambda s: F.length(F.regexp_replace(F.regexp_replace(text, r"\P{L}", ""), rf"\P{{Is{s}}}", ""))
    n = inside("Latin")
    for s in sorted(set(SCRIPT_OF.values())):
        n = F.when(language.isin(*[k for k, v in SCRIPT_OF.items() if v == s]), inside(s)).otherwise(n)
    return (letters > 0) & (2 * n >= letters)


def mixed_case(value: Column) -> Column:
    return value.rlike(r"\p{Lu}") & value.rlike(r"\p{Ll}")


def natural_case(value: Column) -> Column:
    """Values with both cases as they are, others with a capital in front of each word."""
    return F.when(mixed_case(value), value).otherwise(F.initcap(F.lower(value)))


def duration_seconds(value: Column) -> Column:
    """Seconds of a plain number or of parts such as 1h30m; null for anything else."""
    v = F.lower(F.trim(value))
    parts = F.regexp_extract_all(v, F.lit(r"([0-9]+(?:\.[0-9]+)?[smhd])"), F.lit(1))
    unit = lambda p: F.when(p.endswith("s"), 1.0).when(p.endswith("m"), 60.0).when(p.endswith("h"), 3600.0).otherwise(86400.0)
    total = F.aggregate(parts, F.lit(0.0), lambda a, p: a + F.regexp_replace(p, "[smhd]$", "").try_cast("double") * unit(p))
    plain = v.rlike(r"^[0-9]+(\.[0-9]+)?$")
    return F.when(plain, v.try_cast("double")).when((F.size(parts) > 0) & (F.array_join(parts, "") == v), total)


def paragraph_bounds(spans: DataFrame, most: int) -> DataFrame:
    """Spans (s, e, text) with p_s and p_e: the text between the blank lines around, or a window of ``most`` characters around the span where that is longer."""
    head = F.reverse(F.substring("text", F.lit(1), F.col("s")))
    back = F.instr(head, "\n\n")
    left = F.when(back > 0, F.col("s") - back + 1).otherwise(0)
    ahead = F.locate("\n\n", F.substring(F.col("text"), F.col("e") + 1, F.length("text")))
    right = F.when(ahead > 0, F.col("e") + ahead - 1).otherwise(F.length("text"))
    x = spans.withColumns({"_l": left, "_r": right})
    half = most // 2
    start = F.greatest(F.col("_l"), F.col("s") - half)
    end = F.least(start + most, F.least(F.col("_r"), F.greatest(F.col("e") + half, start + most)))
    fits = F.col("_r") - F.col("_l") <= most
    return x.withColumns({"p_s": F.when(fits, F.col("_l")).otherwise(start), "p_e": F.when(fits, F.col("_r")).otherwise(end)}).drop("_l", "_r")
