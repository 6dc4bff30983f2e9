"""Checksums of identifiers as column expressions over strings of digits; separators are removed first.

Every check gives false, never null, for a value of the wrong form; null gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bare(value: Column) -> Column:
    return F.regexp_replace(value, r"[\s./-]", "")


def _digit(value: Column, at) -> Column:
    return F.substring(value, at, F.lit(1)).cast("int")


def weighted(value: Column, weights: list[int]) -> Column:
    """Sum of the first digits times their weights."""
    total = F.lit(0)
    for k, w in enumerate(weights, 1):
        total = total + F.coalesce(_digit(value, F.lit(k)), F.lit(0)) * w
    return total


def _formed(value: Column, form: str, check: Column) -> Column:
    return F.when(value.isNull(), None).otherwise(F.when(value.rlike(form), check).otherwise(False))


def luhn(value: Column, least: int = 12) -> Column:
    v = bare(value)
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(v))), F.lit(0), lambda a, k: a + _luhn_digit(_digit(v, F.length(v) - k + 1), k))
    return _formed(v, rf"^[0-9]{{{least},}}$", total % 10 == 0)


def _luhn_digit(d: Column, k: Column) -> Column:
    d = F.coalesce(d, F.lit(0))
    twice = d * 2
    return F.when(k % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))


def iban(value: Column) -> Column:
    v = F.upper(F.regexp_replace(value, r"\s", ""))
    turned = F.concat(F.substring(v, F.lit(5), F.length(v)), F.substring(v, 1, 4))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    rest = F.aggregate(chars, F.lit(0), lambda a, c: F.when(c.rlike("[A-Z]"), (a * 100 + F.ascii(c) - 55) % 97).otherwise((a * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97))
    return _formed(v, "^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$", rest == 1)


def pesel(value: Column) -> Column:
    v = bare(value)
    day = (F.substring(v, 3, 2).cast("int") % 20).between(1, 12) & F.substring(v, 5, 2).cast("int").between(1, 31)
    return _formed(v, "^[0-9]{11}$", day & ((10 - weighted(v, [1, 3, 7, 9, 1, 3, 7, 9, 1, 3]) % 10) % 10 == _digit(v, F.lit(11))))


def payment_card(value: Column) -> Column:
    return luhn(value) & bare(value).rlike("^[2-6][0-9]{12,18}$")


def imei(value: Column) -> Column:
    return luhn(value) & (F.length(bare(value)) == 15)


def card_shape(value: Column) -> Column:
    """Lengths and first digits of the three large card networks."""
    v = bare(value)
    four, two = F.substring(v, 1, 4).try_cast("int"), F.substring(v, 1, 2)
    sixteen = (F.length(v) == 16) & (two.between("51", "55") | four.between(2221, 2720))
    return _formed(v, "^[0-9]+$", (v.startswith("4") & F.length(v).isin(13, 16, 19)) | sixteen | ((F.length(v) == 15) & two.isin("34", "37")))


def phone_surface(value: Column) -> Column:
    """7 to 15 digits without the extension, at most one pair of parentheses, no date and no IPv4 address, 40 characters at most."""
    base = F.trim(F.regexp_replace(value, r"(?i)\s*(?:ext\.?|x)\s*[0-9]+\s*$", ""))
    opened, closed = F.regexp_count(base, F.lit(r"\(")), F.regexp_count(base, F.lit(r"\)"))
    digits = F.length(F.regexp_replace(base, "[^0-9]", ""))
    other = base.rlike(r"^[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}$") | base.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    return (F.length(value) <= 40) & digits.between(7, 15) & (opened == closed) & (opened <= 1) & ~other


def birth_number(value: Column) -> Column:
    """Czech and Slovak birth numbers of ten digits: months plus 20, 50 or 70 for some, the last digit the rest of the others by 11."""
    v = bare(value)
    m = F.substring(v, 3, 2).try_cast("int")
    month = F.when(m > 70, m - 70).when(m > 50, m - 50).when(m > 20, m - 20).otherwise(m)
    rest = F.substring(v, 1, 9).try_cast("bigint") % 11
    good = month.between(1, 12) & F.substring(v, 5, 2).try_cast("int").between(1, 31) & (F.when(rest == 10, 0).otherwise(rest) == _digit(v, F.lit(10)))
    return _formed(v, "^[0-9]{10}$", F.coalesce(good, F.lit(False)))


def turkish_id(value: Column) -> Column:
    v = bare(value)
    odd, even = weighted(v, [1, 0, 1, 0, 1, 0, 1, 0, 1]), weighted(v, [0, 1, 0, 1, 0, 1, 0, 1, 0])
    tenth = F.pmod(odd * 7 - even, F.lit(10)) == _digit(v, F.lit(10))
    return _formed(v, "^[1-9][0-9]{10}$", tenth & (weighted(v, [1] * 10) % 10 == _digit(v, F.lit(11))))


def snils(value: Column) -> Column:
    v = bare(value)
    rest = weighted(v, [9, 8, 7, 6, 5, 4, 3, 2, 1]) % 101
    return _formed(v, "^[0-9]{11}$", F.when(rest == 100, 0).otherwise(rest) == F.substring(v, 10, 2).cast("int"))


def israeli_id(value: Column) -> Column:
    v = F.lpad(bare(value), 9, "0")
    total = F.lit(0)
    for k in range(1, 10):
        d = _digit(v, F.lit(k)) * (1 if k % 2 else 2)
        total = total + F.when(d > 9, d - 9).otherwise(d)
    return _formed(bare(value), "^[0-9]{5,9}$", total % 10 == 0)


def korean_rrn(value: Column) -> Column:
    v = bare(value)
    day = F.substring(v, 3, 2).cast("int").between(1, 12) & F.substring(v, 5, 2).cast("int").between(1, 31)
    return _formed(v, "^[0-9]{13}$", day & ((11 - weighted(v, [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5]) % 11) % 10 == _digit(v, F.lit(13))))


def chinese_id(value: Column) -> Column:
    v = F.upper(bare(value))
    mark = F.substring(F.lit("10X98765432"), weighted(v, [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2]) % 11 + 1, F.lit(1))
    day = F.substring(v, 11, 2).cast("int").between(1, 12) & F.substring(v, 13, 2).cast("int").between(1, 31)
    return _formed(v, "^[1-9][0-9]{16}[0-9X]$", day & (mark == F.substring(v, 18, 1)))


def aadhaar(value: Column) -> Column:
    """Verhoeff's check over the dihedral group of ten elements, whose tables follow from their rule."""
    v = bare(value)
    c = F.lit(0)
    times = F.array(*[F.lit(_times(a, b)) for a in range(10) for b in range(10)])
    turns = F.array(*[F.lit(_turn(k, d)) for k in range(8) for d in range(10)])
    for k in range(12):
        d = F.coalesce(_digit(v, F.lit(12 - k)), F.lit(0))
        c = F.element_at(times, c * 10 + F.element_at(turns, F.lit(k % 8 * 10) + d + 1) + 1)
    return _formed(v, "^[2-9][0-9]{11}$", c == 0)


def _times(a: int, b: int) -> int:
    """Product in the dihedral group: 0 to 4 are turns, 5 to 9 reflections."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b - 5) % 5
    return 5 + (a - 5 - b) % 5 if b < 5 else (a - b) % 5


def _turn(k: int, d: int) -> int:
    """The k-th power of Verhoeff's permutation (fixed values)."""
    for _ in range(k):
        d = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)[d]
    return d


def ipv4(value: Column) -> Column:
    parts = F.split(F.trim(value), r"\.")
    good = F.forall(parts, lambda p: p.rlike("^(0|[1-9][0-9]{0,2})$") & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255))
    return F.when(value.isNull(), None).otherwise((F.size(parts) == 4) & good)


def ipv6(value: Column) -> Column:
    """Eight groups of up to four hex digits, or fewer with one gap of colons for the zeros; an IPv4 tail counts as two."""
    v = F.regexp_replace(F.trim(value), r":([0-9]{1,3}\.){3}[0-9]{1,3}$", ":0:0")
    tail = F.regexp_extract(F.trim(value), r":((?:[0-9]{1,3}\.){3}[0-9]{1,3})$", 1)
    halves = F.split(v, "::")
    groups = F.filter(F.flatten(F.transform(halves, lambda h: F.split(h, ":"))), lambda g: g != "")
    formed = F.forall(groups, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$")) & v.rlike("^(?:[0-9A-Fa-f]|::).*(?:[0-9A-Fa-f]|::)$") & ~v.rlike(":::")
    count = F.when(F.size(halves) == 1, F.size(groups) == 8).otherwise((F.size(halves) == 2) & (F.size(groups) <= 7))
    return F.when(value.isNull(), None).otherwise(formed & count & ((tail == "") | F.coalesce(ipv4(tail), F.lit(False))))


def coordinates(value: Column) -> Column:
    """Two decimals in the range of latitude and longitude, not both 0."""
    n = F.regexp_extract_all(value, F.lit(r"(-?[0-9]+\.[0-9]+)"), F.lit(1))
    a, b = F.get(n, F.lit(0)).try_cast("double"), F.get(n, F.lit(1)).try_cast("double")
    return F.when(value.isNull(), None).otherwise(F.coalesce((F.size(n) == 2) & a.between(-90, 90) & b.between(-180, 180) & ~((a == 0) & (b == 0)), F.lit(False)))
