"""Format-preserving pseudonyms: keyed Feistel permutations of numbers issued to persons, of telephone numbers and of dates.

A value is a row of symbols, each with the number of values it can take: ten for a digit, twenty-six for a letter, and as
many as there are days for a date of birth within a number. The symbols are read as one number in mixed radix, whose two
halves go through a Feistel network with a keyed hash. Formats with a check (a check digit, a valid date) are walked: the
permutation is repeated until the result has the same format and passes the same check, so valid values stay valid, others
stay without a format, and the whole is a permutation of all strings of one shape. Separators, letter case and the script
of digits stay as they are; so equal values get equal pseudonyms in any document, and only the key's owner can undo them.

Telephone numbers keep country code, trunk zero and the number of digits; an extension is permuted by itself.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import regex


def luhn(d: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def _sum(d: str, weights) -> int:
    return sum(int(c) * w for c, w in zip(d, weights))


def _pesel(d: str) -> bool:
    return _sum(d, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3, 1)) % 10 == 0


def _snils(d: str) -> bool:
    return _sum(d, range(9, 0, -1)) % 101 % 100 == int(d[9:])


def _turkish(d: str) -> bool:
    odd, even = sum(map(int, d[0:9:2])), sum(map(int, d[1:8:2]))
    return d[0] != "0" and (odd * 7 - even) % 10 == int(d[9]) and sum(map(int, d[:10])) % 10 == int(d[10])


def _cpf(d: str) -> bool:
    return all(_sum(d, range(n + 1, 1, -1)) * 10 % 11 % 10 == int(d[n]) for n in (9, 10))


def _german_tax(d: str) -> bool:
    p = 10
    for c in d[:10]:
        s = (int(c) + p) % 10 or 10
        p = s * 2 % 11
    return d[0] != "0" and (11 - p) % 10 == int(d[10])


def _thai(d: str) -> bool:
    return (11 - _sum(d, range(13, 1, -1)) % 11) % 10 == int(d[12])


def _korean(d: str) -> bool:
    return (11 - _sum(d, (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)) % 11) % 10 == int(d[12])


def _chinese(d: str) -> bool:
    return sum((10 if c == "X" else int(c)) * pow(2, 17 - k, 11) for k, c in enumerate(d)) % 11 == 1


def _french(d: str) -> bool:
    return 97 - int(d[:13]) % 97 == int(d[13:])


def _japanese(d: str) -> bool:
    r = _sum(d, (6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2)) % 11
    return (0 if r <= 1 else 11 - r) == int(d[11])


def _dutch(d: str) -> bool:
    return (_sum(d, range(9, 1, -1)) - int(d[8])) % 11 == 0


def _portuguese(d: str) -> bool:
    r = _sum(d, range(9, 1, -1)) % 11
    return (0 if r < 2 else 11 - r) == int(d[8])


def _spanish(d: str) -> bool:
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(d[:8].translate({88: 48, 89: 49, 90: 50})) % 23] == d[8]


#: Values of characters at odd places of an Italian tax code, digits 0 to 9 and letters A to Z (fixed values).
_ITALIAN_ODD = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23)


def _italian(d: str) -> bool:
    place = lambda c: int(c) if c.isdigit() else ord(c) - 65
    total = sum(_ITALIAN_ODD[place(c)] if k % 2 == 0 else place(c) for k, c in enumerate(d[:15]))
    return d[8] in "ABCDEHLMPRST" and chr(65 + total % 26) == d[15]


def _verhoeff(d: str) -> bool:
    from ..functions.checks import _times, _turn

    c = 0
    for k, x in enumerate(reversed(d)):
        c = _times(c, _turn(k % 8, int(x)))
    return c == 0


@dataclass(frozen=True)
class Format:
    """Strings of one shape that pass a check; ``day`` is the place of a date of birth, of six digits or eight."""

    name: str
    shape: str
    check: Callable[[str], bool] = lambda d: True
    day: tuple[int, int] | None = None


#: Formats in the order in which a value is tried against them.
FORMATS = (
    Format("korean resident", r"\d{13}", _korean, (0, 6)),
    Format("thai", r"\d{13}", _thai),
    Format("chinese resident", r"\d{17}[\dX]", _chinese, (6, 14)),
    Format("french", r"\d{15}", _french),
    Format("card or device", r"\d{14,19}", luhn),
    Format("japanese", r"\d{12}", _japanese),
    Format("indian", r"\d{12}", _verhoeff),
    Format("polish", r"\d{11}", _pesel),
    Format("russian", r"\d{11}", _snils),
    Format("turkish", r"\d{11}", _turkish),
    Format("brazilian", r"\d{11}", _cpf),
    Format("german tax", r"\d{11}", _german_tax),
    Format("saudi", r"[12]\d{9}", luhn),
    Format("dutch", r"\d{9}", _dutch),
    Format("portuguese", r"\d{9}", _portuguese),
    Format("israeli", r"\d{9}", luhn),
    Format("spanish", r"[\dXYZ]\d{7}[A-Z]", _spanish),
    Format("italian", r"[A-Z]{6}\d\d[A-Z]\d\d[A-Z]\d{3}[A-Z]", _italian),
    Format("british", r"[A-Z]{2}\d{6}[A-D]"),
)
#: First days and numbers of days of dates in six digits (years of one century) and in eight.
_DAYS = {6: (datetime.date(2000, 1, 1).toordinal(), 36_525), 8: (datetime.date(1900, 1, 1).toordinal(), 73_049)}
#: Country codes of two digits; besides, 1 and 7 stand alone, and all others have three (fixed values).
_TWO = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_FAR = regex.compile(r"^\s*(?:\+|00)[ .\-/]{0,2}(\d(?:[ .\-/]?\d){0,2})")
_EXTENSION = regex.compile(r"(?:ext(?:ension|\.)?|x|доб\.?|poste|durchwahl|int\.?|anexo|ramal)\s{0,2}(\d+)\s*$", regex.I)


def _day_number(digits: str) -> int | None:
    first, count = _DAYS[len(digits)]
    try:
        day = datetime.date(int(digits[:-4]) + (2000 if len(digits) == 6 else 0), int(digits[-4:-2]), int(digits[-2:]))
    except ValueError:
        return None
    n = day.toordinal() - first
    return n if 0 <= n < count else None


class Pseudonyms:
    """Keyed permutations; the key is never written anywhere."""

    ROUNDS = 10

    def __init__(self, key: bytes, formats: tuple[Format, ...] = FORMATS):
        if not key:
            raise ValueError("pseudonyms need a key")
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.formats = [(f, regex.compile(f.shape)) for f in formats]

    def _f(self, tweak: str, half: int, r: int, modulus: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{tweak}|{r}|{half}".encode(), key=self.key, digest_size=24).digest(), "big") % modulus

    def symbols(self, values: list[int], radices: list[int], tweak: str, undo: bool = False) -> list[int]:
        """The permuted values of the symbols."""
        cut = len(values) // 2
        sizes = [math.prod(radices[:cut]), math.prod(radices[cut:])]
        halves = [0, 0]
        for k, (v, r) in enumerate(zip(values, radices)):
            halves[k >= cut] = halves[k >= cut] * r + v
        tweak = f"{tweak}|{'.'.join(map(str, radices))}"
        for r in reversed(range(self.ROUNDS)) if undo else range(self.ROUNDS):
            mine, other = r % 2, 1 - r % 2
            step = self._f(tweak, halves[other], r, sizes[mine])
            halves[mine] = (halves[mine] - step if undo else halves[mine] + step) % sizes[mine]
        out: list[int] = []
        for k in reversed(range(len(values))):
            halves[k >= cut], v = divmod(halves[k >= cut], radices[k])
            out.append(v)
        return out[::-1]

    def format_of(self, bare: str) -> Format | None:
        for f, shape in self.formats:
            if shape.fullmatch(bare) and (f.day is None or _day_number(bare[slice(*f.day)]) is not None) and f.check(bare):
                return f
        return None

    def _once(self, bare: str, f: Format | None, undo: bool) -> str:
        a, b = f.day if f is not None and f.day else (0, 0)
        rest = bare[:a] + bare[b:]
        values = [int(c) if c.isdigit() else ord(c) - 65 for c in rest]
        radices = [10 if c.isdigit() else 26 for c in rest]
        if b:
            values.insert(a, _day_number(bare[a:b]))
            radices.insert(a, _DAYS[b - a][1])
        new = self.symbols(values, radices, f.name if f is not None else "", undo)
        day = new.pop(a) if b else 0
        out = "".join(str(v) if c.isdigit() else chr(65 + v) for v, c in zip(new, rest))
        if b:
            d = datetime.date.fromordinal(_DAYS[b - a][0] + day)
            out = out[:a] + f"{d.year:04}{d.month:02}{d.day:02}"[-(b - a) :] + out[a:]
        return out

    def bare(self, bare: str, undo: bool = False) -> str:
        """Digits and capital letters permuted, among the strings of the same format, or of none."""
        f = self.format_of(bare)
        out = self._once(bare, f, undo)
        while self.format_of(out) is not f:
            out = self._once(out, f, undo)
        return out

    def number(self, text: str, undo: bool = False) -> str:
        """An identity number: all its letters and digits are permuted."""
        return self._within(text, [k for k, c in enumerate(unicodedata.normalize("NFKC", x) for x in text) if len(c) == 1 and c.isalnum() and (c.isdecimal() or c.isascii())], lambda s: self.bare(s, undo))

    def phone(self, text: str, undo: bool = False) -> str:
        """A telephone number: all digits but those of the country code, the trunk zero and the number's length."""
        t = "".join(str(unicodedata.decimal(c)) if c.isdecimal() else "+" if c == "＋" else c for c in text)
        ext = _EXTENSION.search(t)
        end = ext.start() if ext else len(t)
        places = [k for k in range(end) if t[k].isdigit() and t[k - 1 : k + 2] != "(0)"]
        far = _FAR.match(t[:end])
        if far:
            code = "".join(c for c in far[1] if c.isdigit())
            size = 1 if code[:1] in ("1", "7") else 2 if code[:2] in _TWO else 3
            places = places[size + 2 * (t.lstrip()[:1] != "+") :]
        trunk = not far and bool(places) and t[places[0]] == "0"
        digits = lambda s: self._digits(s, undo)
        out = self._within(text, places[trunk:], digits)
        return self._within(out, range(ext.start(1), ext.end(1)), digits) if ext else out

    def _digits(self, s: str, undo: bool) -> str:
        """Digits permuted; a zero in front neither comes nor goes, as it would be read as a trunk or country prefix."""
        zero = s[:1] == "0"
        while True:
            s = "".join(map(str, self.symbols([int(c) for c in s], [10] * len(s), "phone", undo)))
            if (s[:1] == "0") == zero:
                return s

    @staticmethod
    def _within(text: str, places, change: Callable[[str], str]) -> str:
        """Text with the characters at the places changed, in their own script and case."""
        places = list(places)
        if not places:
            return text
        old = [unicodedata.normalize("NFKC", text[k]) for k in places]
        old = [str(unicodedata.decimal(c)) if c.isdecimal() else c for c in old]
        new = change("".join(old).upper())
        out = list(text)
        for k, a, b in zip(places, old, new):
            out[k] = chr(ord(text[k]) - ord(a) + ord(b.lower() if a.islower() else b))
        return "".join(out)

    def link(self, kind: str, text: str) -> str:
        """A keyed digest of 128 bits for values without a format; spellings of the same value have the same."""
        t = unicodedata.normalize("NFKC", text).casefold()
        if kind == "email":
            t = regex.sub(r"\s*[\[(]?\s*(?<![\w])at(?![\w])\s*[\])]?\s*|\s*@\s*", "@", t)
            t = regex.sub(r"\s*[\[(]?\s*(?<![\w])dot(?![\w])\s*[\])]?\s*", ".", t)
        words = regex.findall(r"[\p{L}\p{M}\p{N}@._+-]+", t)
        if kind == "person_name":
            words = sorted(w.strip("._-") for w in words)
        return hashlib.blake2b(f"{kind}|{' '.join(words)}".encode(), key=self.key, digest_size=16).hexdigest()

    def placeholder(self, text: str, kind: str) -> str:
        if kind == "phone":
            return f"[{kind}:{self.phone(text)}]"
        return f"[{kind}:{self.number(text) if kind == 'id_number' else self.link(kind, text)}]"
