"""P9: text decoded with a wrong encoding, by round-trip repair.

A text is encoded again as it was wrongly decoded and decoded as it was meant; this is tried for pairs of encodings, and
again on the result for nested layers. A repair is accepted where a garbling cost drops: the negative log share of texts
that hold each pair of neighbouring characters, so that pairs no language writes are dear; the shares are counted over the
whole corpus, and so are the garbled texts among them. Decoding is strict; where bytes were lost on the way, so that it fails, a tolerant decoding is tried and the
repair is marked "with losses". UTF-8 sequences are repaired
word by word, so half-garbled texts and texts with lost bytes are repaired where they can be; the other encodings
sentence by sentence.

Defined results: null and empty texts are not garbled; character references, percent codes and mentions of unusual
letters stay as they are.
"""

from __future__ import annotations

import math
import operator
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_table

#: Share of texts that is added to that of each pair, and the share below which a pair costs what an unseen one does.
UNSEEN, LEAST_SHARE = 4e-5, 1e-6
#: Share of texts with a pair at which a word is worth a closer look.
ODD_SHARE = 1 / 1200
LAYERS = 3
#: Cost that a repair must save: in all, and for each character it changes.
SAVED, SAVED_EACH = 6.0, 0.5
#: As before for repairs of single Latin letters, where rare foreign words must not pass for garbled ones.
SAVED_EACH_LATIN = 3.0
#: What a character that becomes a mark counts against a repair of Latin letters.
MARK = 5.0
#: Part of the dearest cost that a text in scripts of other than Latin letters must reach for each character to be looked at.
STRANGE = 0.5
#: What a character that comes out as lost counts against a repair.
LOST = 6.0
#: Bytes and characters of which a first part may rule a repair out.
PREFIX = 80

#: Encodings in which UTF-8 is read by mistake, one byte a character (fixed values: Python's codec names).
UTF8_READ_AS = ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp850", "cp1250", "iso8859-2", "koi8-r", "cp866", "cp1253", "cp1254", "cp1256", "cp1257", "iso8859-15", "cp874", "mac_cyrillic", "iso8859-5")
#: As before, in two bytes a character.
UTF8_READ_AS_WIDE = ("gb18030", "cp932", "big5", "cp949", "euc_jp")
#: (written in, read as) of one byte a character.
ONE_BYTE = (
    [(b, a) for b in ("cp1252",) for a in ("mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8-r", "cp866", "cp1253", "cp1256", "iso8859-5", "cp874", "iso8859-7")]
    + [("mac_roman", a) for a in ("cp1252", "cp1250", "cp1251")]
    + [(b, "cp1252") for b in ("cp437", "cp850", "cp1251", "koi8-r", "cp866", "cp1250", "iso8859-2", "cp1256", "iso8859-6", "cp874", "cp1253", "iso8859-5", "mac_cyrillic", "cp852")]
    + [(b, a) for b in ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic") for a in ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic", "mac_roman", "cp437", "cp850") if a != b]
    + [(b, a) for b in ("cp1250", "iso8859-2", "cp852") for a in ("cp1250", "iso8859-2", "cp852", "cp437", "cp850", "mac_roman", "cp1251") if a != b]
    + [("cp1256", "cp1251"), ("cp1256", "mac_roman"), ("iso8859-6", "mac_roman"), ("cp874", "mac_roman"), ("cp874", "cp1251")]
)
#: (written in, read as) where the writing takes two bytes a character.
WIDE = [(b, a) for b in ("gb18030", "cp932", "big5", "cp949", "euc_jp") for a in ("latin-1", "cp1252", "mac_roman", "cp437", "cp1251", "gb18030", "cp932", "big5", "cp949", "euc_jp") if a != b]

LATIN = frozenset(("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "iso8859-2", "cp852"))
#: Characters that one-byte encodings have besides ASCII; scripts outside can't come from reading one of them.
_NARROW = regex.compile(r"[\x80-\u060c\u061b-\u0652\u0e00-\u0e5b\u2010-\u25ff\uf8ff\ufb01\ufb02]")
WIDE_READ = frozenset(("gb18030", "cp932", "big5", "cp949", "euc_jp"))
#: Parts of a text; those that count have a character besides ASCII before the mark that ends them.
_LINE = re.compile(r"[^\r\n]+")
_WORD = re.compile(r"[^ \t\r\n]+")
_PIECE = re.compile(r"[^\r\n.!?…。！？।]+[.!?…。！？।]?")
_ENDS = frozenset("…。！？।")
_ASCII = {c: chr(c) for c in range(128)}  # tables without gaps are faster
_NO_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())
_ASCII_BYTES = bytes(range(128))
_BASE = 0xF0000  # stand-ins for bytes while sequences are looked for
_SEQUENCE = re.compile(
    "[{2}-{3}][{0}-{1}]|[{4}-{5}][{0}-{1}]{{2}}|[{6}-{7}][{0}-{1}]{{3}}".format(*(chr(_BASE + x) for x in (0x80, 0xBF, 0xC2, 0xDF, 0xE0, 0xEF, 0xF0, 0xF4)))
)


@cache
def _table(codec: str) -> dict[int, str]:
    """Byte to character; bytes without one stand for the control character of the same number."""
    out = {}
    for b in range(128, 256):
        try:
            out[b] = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


#: Marks, blanks and invisible characters that layouts put anywhere; all count as a blank.
_QUIET = re.compile(r"[\u2000-\u206f\u00a0\u3000\ufeff«»¿¡。、，：；！？・「」『』（）📎\ufffd\t\r\n]+")


class CostModel:
    """Cost of neighbouring characters, from the share of texts that hold them."""

    def __init__(self, shares: dict[str, float], odd_share: float = ODD_SHARE):
        self.dearest = -math.log(UNSEEN)
        self.cost = {k: -math.log(v + UNSEEN) for k, v in shares.items()}
        self.blocks = {ord(c) >> 7 for k in self.cost for c in k}
        self.odd = -math.log(odd_share + UNSEEN) - 1e-9

    @classmethod
    def of_texts(cls, texts: Iterable[str]) -> CostModel:
        """Model of a list of texts; pairs that one text alone has count as unseen."""
        texts = list(texts)
        seen = Counter(p for t in texts for p in cls.pairs(t))
        return cls({k: v / len(texts) for k, v in seen.items() if v > 1}, max(ODD_SHARE, 2 / len(texts)))

    @classmethod
    def pairs(cls, text: str) -> set[str]:
        t = cls.plain(text)
        return {a + b for a, b in zip(t, t[1:])}

    @staticmethod
    def plain(text: str) -> str:
        return _QUIET.sub(" ", f" {text.lower()} ")

    def of(self, text: str, most: float = math.inf) -> float:
        """The cost of a text; of one that costs more than ``most`` a part that does so too."""
        t, get, top = self.plain(text), self.cost.get, self.dearest
        cost, n = 0.0, len(t)
        if not t.isascii():
            cost = 12.0 * sum([t.count(c) for c in set(t) if c > "\x7f" and ord(c) >> 7 not in self.blocks])
        step = n if n < PREFIX or most == math.inf else n // 4
        for k in range(0, n - 1, step):
            if cost > most:
                break
            cost += sum(map(get, map(operator.add, t[k : k + step], t[k + 1 : k + step + 1]), repeat(top)))
        return cost

    def suspicious(self, text: str) -> bool:
        if text.isascii():
            return False
        t, get, top, odd = self.plain(text), self.cost.get, self.dearest, self.odd
        return any([get(a + b, top) >= odd for a, b in zip(t, t[1:]) if a > "\x7f" or b > "\x7f"])


def _parts(pattern: re.Pattern, text: str) -> list[str]:
    """The parts of a text with other than ASCII characters, the mark at the end of a piece aside."""
    if pattern is _WORD:
        return [w for w in text.replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if not w.isascii()]
    found = [p for p in pattern.findall(text) if not p.isascii()]
    return [p for p in found if p[-1] not in _ENDS or not p[:-1].isascii()] if pattern is _PIECE else found


def _plain_letters(text: str) -> int:
    return len(text.encode("ascii", "ignore").translate(None, _NO_LETTERS))


def _letters_changed(old: str, new: str, latin: bool) -> bool:
    """Whether a repair turns what stands in words into letters: for Latin writing next to plain letters, else in most letters of the piece."""
    if latin:
        good = bad = 0
        last = len(old) - 1
        for k, (a, b) in enumerate(zip(old, new)):
            if a != b:
                beside = (k > 0 and (old[k - 1].isalpha() or old[k - 1] > "\x7f")) or (k < last and (old[k + 1].isalpha() or old[k + 1] > "\x7f"))
                if beside and (b.isalpha() or b in "’‘“”–—…"):
                    good += 1
                elif beside or not b.isalpha():
                    bad += 1
        return good > 4 * bad
    letters = sum(map(str.isalpha, new))
    if letters < 3:
        return False
    if len(old) == len(new):
        kept = sum([b.isalpha() for a, b in zip(old, new) if a == b])
    else:
        kept = _plain_letters(new)
    return kept <= 0.4 * letters


class _Swapped:
    """Which swaps of other than Latin letters ``_letters_changed`` can accept, told for all swaps together by the characters of a piece."""

    def __init__(self, swaps: list[tuple[str, str]]):
        tables = [{wrong: right for right, wrong in zip(_table(b).values(), _table(a).values())} for b, a in swaps]
        self.column = {c: k for k, c in enumerate(sorted(set().union(*tables)))}
        # letters that a swap makes of a character, and those that are it still
        self.letters = np.array([[t.get(c, c).isalpha() for c in self.column] for t in tables], np.int64)
        self.kept = self.letters * np.array([[t.get(c, c) == c for c in self.column] for t in tables])

    @classmethod
    @cache
    def of_others(cls) -> _Swapped:
        return cls([x for x in ONE_BYTE if x[0] not in LATIN])

    def changing(self, text: str) -> list[int]:
        at, n, others = [], [], 0
        for c, k in Counter(text).items():
            if c in self.column:
                at.append(self.column[c])
                n.append(k)
            elif c.isalpha():
                others += k
        letters, kept = self.letters[:, at] @ np.array(n, np.int64) + others, self.kept[:, at] @ np.array(n, np.int64) + others
        return np.flatnonzero((letters >= 3) & (kept <= 0.4 * letters)).tolist()


class Repairer:
    def __init__(self, model: CostModel):
        self.model = model
        self.odd_words: dict[str, bool] = {}
        self.fixes: dict[tuple[str, int], list[tuple[int, str, float]]] = {}
        self.about: dict[str, tuple[float, int, bool, bool, bool]] = {}
        self.words = [(f"utf-8 as {a}", self._sequences(a)) for a in UTF8_READ_AS]
        self.sequence = self._sequence(*UTF8_READ_AS)
        encoders = {a: self._encoder(a) for a in [*UTF8_READ_AS_WIDE, *(a for _, a in WIDE)]}
        self.pieces: list[tuple[str, Callable[[str], str | None]]] = [(f"utf-8 as {a}", self._round_trip("utf-8", encoders[a], loose=True)) for a in UTF8_READ_AS_WIDE]
        swaps = [(f"{b} as {a}", self._swap(b, a)) for b, a in ONE_BYTE]
        self.latin_pieces = [x for x in swaps if x[0].split()[0] in LATIN]
        self.other_pieces = [x for x in swaps if x[0].split()[0] not in LATIN]
        self.swapped = _Swapped.of_others()
        self.lines = [(f"{b} as {a}", self._round_trip(b, encoders[a])) for b, a in WIDE]
        self.read_wide = frozenset(f"{b} as {a}" for b, a in WIDE if a in WIDE_READ)

    @staticmethod
    def _to_byte(codec: str) -> dict[int, str]:
        """Character to the stand-in of its byte."""
        to_byte = {ord(c): chr(_BASE + b) for b, c in _table(codec).items()}
        if codec.startswith("cp125"):  # bytes 80 to 9f are also delivered as control characters
            to_byte = {b: chr(_BASE + b) for b in range(0x80, 0xA0)} | to_byte
        return to_byte

    @classmethod
    @cache
    def _sequence(cls, *codecs: str) -> re.Pattern:
        """What a text has in which any of the readings finds a sequence."""
        of: dict[int, set[str]] = {}
        for codec in codecs:
            for k, b in cls._to_byte(codec).items():
                of.setdefault(ord(b) - _BASE, set()).update((chr(k), b))
        c, *leads = ("[" + "".join(map(re.escape, sorted(set().union(*map(of.__getitem__, range(a, z + 1)))))) + "]" for a, z in ((0x80, 0xBF), (0xC2, 0xDF), (0xE0, 0xEF), (0xF0, 0xF4)))
        return re.compile("|".join(x + c * (k + 1) for k, x in enumerate(leads)))

    @classmethod
    def _sequences(cls, codec: str) -> Callable[[str], str]:
        table, to_byte, sequence = _table(codec), cls._to_byte(codec), cls._sequence(codec)
        to_byte, back = _ASCII | to_byte, _ASCII | {_BASE + b: c for b, c in table.items()}

        def one(m) -> str:
            raw = bytes(ord(c) - _BASE for c in m.group())
            try:
                return raw.decode("utf-8")
            except UnicodeDecodeError:
                return m.group()

        def run(text: str) -> str:
            return _SEQUENCE.sub(one, text.translate(to_byte)).translate(back) if sequence.search(text) else text

        return run

    @staticmethod
    def _swap(written: str, read: str) -> Callable[[str], str | None]:
        right, wrong = _table(written), _table(read)
        table = _ASCII | {ord(wrong[b]): right[b] for b in range(128, 256)}
        latin, told = written in LATIN, frozenset(wrong[b] for b in range(128, 256) if wrong[b] != right[b])

        def run(text: str) -> str | None:
            if told.isdisjoint(text):
                return None
            new = text.translate(table)
            return new if new != text and _letters_changed(text, new, latin) else None

        return run

    @staticmethod
    def _encoder(read: str) -> Callable[[str, bool], list[tuple[str, bytes | None]]]:
        """Stretches of a text that an encoding can have read, with their bytes; None for those that stay. The last text is kept, as it is tried as several writings."""
        wide = read in WIDE_READ
        table = {} if wide else {ord(c): b for b, c in _table(read).items()}
        if read.startswith("cp125"):
            table = {b: b for b in range(0x80, 0xA0)} | table
        runs = None if wide else re.compile("([\\x20-\\x7e" + "".join(re.escape(chr(c)) for c in sorted(table)) + "]+)")
        table = _ASCII | table
        last: list = [None, None]

        def raw(text: str, loose: bool) -> bytes | None:
            try:
                return (text.replace("\ufffd", "?") if loose else text).encode(read) if wide else several(text.translate(table).encode("latin-1"))
            except UnicodeEncodeError:
                return None

        def several(b: bytes) -> bytes | None:
            # of fewer than two bytes besides ASCII no writing makes most of three letters
            return b if len(b.translate(None, _ASCII_BYTES)) > 1 else None

        def run(text: str, loose: bool) -> list[tuple[str, bytes | None]]:
            if last[0] != (text, loose):
                parts = [text] if wide else runs.split(text)  # every other one is a run
                last[:] = (text, loose), [(p, raw(p, loose) if wide or k & 1 and not p.isascii() else None) for k, p in enumerate(parts)]
            return last[1]

        return run

    @staticmethod
    def _round_trip(written: str, encoder: Callable[[str, bool], list[tuple[str, bytes | None]]], loose: bool = False) -> Callable[[str], str | None]:
        def one(text: str, raw: bytes) -> str | None:
            if not loose and len(raw) > PREFIX and raw[: len(raw) // 4].decode(written, "replace").count("\ufffd") > 1 + 0.05 * len(raw):
                return None  # more is lost already than the whole may lose
            new = raw.decode(written, "replace")
            lost = new.count("\ufffd")
            if lost > 0.05 * len(new) and not (loose and lost <= (0.5 if "\ufffd" in text else 0.2) * sum([c > "\x7f" for c in new])):
                return None
            return new if loose or _letters_changed(text, new, False) else None

        def run(text: str) -> str | None:
            parts = encoder(text, loose)
            if all([raw is None for _, raw in parts]):
                return None
            new = [one(p, raw) if raw is not None else None for p, raw in parts]
            return "".join([n or p for n, (p, _) in zip(new, parts)]) if any(new) else None

        return run

    def _odd(self, word: str) -> bool:
        odd = self.odd_words.get(word)
        if odd is None:
            if len(self.odd_words) > 300_000:
                self.odd_words.clear()
            odd = self.odd_words[word] = self.model.suspicious(word)
        return odd

    def _about(self, part: str) -> tuple[float, int, bool, bool, bool]:
        """Cost of a part, its characters besides ASCII, and whether it is strange, has what one-byte encodings have, and is mostly plain letters."""
        known = self.about.get(part)
        if known is None:
            if len(self.about) > 1000:
                self.about.clear()
            cost, n = self.model.of(part), len(part) - len(part.encode("ascii", "ignore"))
            narrow = _NARROW.search(_QUIET.sub("", part)) is not None
            known = self.about[part] = cost, n, cost > STRANGE * self.model.dearest * len(part), narrow, _plain_letters(part) > 0.4 * (n + 1)
        return known

    def _fixes(self, part: str, runs: list) -> list[tuple[int, str, float]]:
        """(number of the mistake, repaired part, cost saved) of the repairs that pay."""
        known = self.fixes.get((part, id(runs)))
        if known is None:
            if len(self.fixes) > 50_000:
                self.fixes.clear()
            if runs is self.words and not self.sequence.search(part):
                self.fixes[part, id(runs)] = known = []
                return known
            known = []
            cost, n, strange, narrow, plain = self._about(part)
            changing = self.swapped.changing(part) if runs is self.other_pieces and strange and narrow and not plain else range(len(runs))
            saved: dict[str, float] = {}  # by repaired part, as readings often agree
            for k in changing:
                name, run = runs[k]
                if (runs is self.latin_pieces or runs is self.other_pieces) and not (narrow and plain == (runs is self.latin_pieces)):
                    break
                if not strange and (runs is self.other_pieces or runs is self.lines and name in self.read_wide or runs is self.pieces and not plain):
                    continue
                if runs is self.lines and (plain or not narrow) and name not in self.read_wide:
                    continue
                new = run(part)
                if new is not None and new != part and not (plain and new.count("\ufffd") > part.count("\ufffd")):
                    if runs is self.latin_pieces:  # a letter that becomes a mark must have been dear
                        gain_less = MARK * sum([a != b and not b.isalpha() for a, b in zip(part, new)])
                        least = SAVED_EACH_LATIN * sum([a != b for a, b in zip(part, new)])
                    else:
                        gain_less, least = 0.0, SAVED_EACH * n
                    gain_less += LOST * max(0, new.count("\ufffd") - part.count("\ufffd"))
                    gain = saved.get(new)
                    if gain is None:
                        gain = saved[new] = cost - self.model.of(new, cost - gain_less - least) - gain_less
                    if gain > least:
                        known.append((k, new, gain))
            self.fixes[part, id(runs)] = known
        return known

    def repair(self, text: str | None) -> tuple[str | None, list[str]]:
        """The repaired text and the mistakes undone, outermost first; none if it isn't garbled."""
        undone: list[str] = []
        if not text or text.isascii():
            return text, undone
        for _ in range(LAYERS):
            odd = {w for w in _parts(_WORD, text) if self._odd(w)}
            if not odd:
                break
            best, name = ({}, 0.0), ""
            parts: dict[re.Pattern, set[str]] = {_WORD: odd}
            for pattern, runs in ((_WORD, self.words), (_PIECE, self.pieces), (_PIECE, self.latin_pieces), (_PIECE, self.other_pieces), (_LINE, self.lines)):
                total: dict[int, list] = {}
                if pattern not in parts:
                    parts[pattern] = {p for p in _parts(pattern, text) if not odd.isdisjoint(_parts(_WORD, p))}
                for part in parts[pattern]:
                    for k, new, gain in self._fixes(part, runs):
                        total.setdefault(k, [{}, 0.0])
                        total[k][0][part] = new
                        total[k][1] += gain
                for k, (changes, gain) in total.items():
                    if gain > best[1] + 1e-9:
                        best, name = (changes, gain, pattern), runs[k][0]
                if runs is self.words and best[1] >= SAVED and not any([self._odd(w) for w in _parts(_WORD, self._apply(text, *best))]):
                    break  # nothing odd is left
            if best[1] < SAVED:
                break
            text = self._apply(text, *best)
            undone.append(name + " with losses" * any("\ufffd" in x for x in best[0].values()))
        return text, undone

    @staticmethod
    def _apply(text: str, changes: dict[str, str], gain: float, pattern: re.Pattern) -> str:
        return pattern.sub(lambda m: changes.get(m.group(), m.group()), text)


_LAST: list = [None, None]


def _repairer(model: CostModel) -> Repairer:
    """The repairer of a worker: what one task has learned of words serves the next."""
    if _LAST[0] is not model:
        _LAST[:] = model, Repairer(model)
    return _LAST[1]


#: Pairs that a partition counts before it hands them on, and characters that it looks at together.
COUNTED, TOGETHER = 500_000, 1_000_000


class PairCounter:
    """Texts with each pair of neighbouring characters, a pair being one number; equal to counting ``CostModel.pairs`` of each text."""

    BITS = 21

    def __init__(self):
        self.n: Counter = Counter()
        self.texts, self.waiting, self.size = 0, [], 0

    def add(self, text: str) -> None:
        self.texts += 1
        self.waiting.append(CostModel.plain(text))
        self.size += len(self.waiting[-1])
        if self.size > TOGETHER:
            self.flush()

    def flush(self) -> None:
        texts, self.waiting, self.size = self.waiting, [], 0
        if not texts:
            return
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        inside = of[1:] == of[:-1]
        # pair, then text: each text is one entry of a pair's run
        keys = (((codes[:-1] << self.BITS) | codes[1:]) << self.BITS) | of[1:]
        keys = np.sort(keys[inside])
        pairs = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] >> self.BITS
        pairs, n = np.unique(pairs, return_counts=True)
        self.n.update(dict(zip(pairs.tolist(), n.tolist())))

    def rows(self, known: dict[str, float] | None = None) -> pa.RecordBatch:
        """The counts as rows (pair, n), of known pairs only if they are given, the pair "" being the number of texts; begins anew."""
        self.flush()
        low = (1 << self.BITS) - 1
        n = {chr(k >> self.BITS) + chr(k & low): v for k, v in self.n.items()}
        rows = {"": self.texts} | (n if known is None else {k: v for k, v in n.items() if k in known})
        self.n, self.texts = Counter(), 0
        return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), pa.array(list(rows.values()), pa.int64())], ["pair", "n"])


def _count_pairs(texts: DataFrame, text_col: str, model: CostModel | None = None) -> DataFrame:
    """(pair, n): texts with each pair; with a model only the texts that it repairs, and the pairs that it knows. The pair "" counts the texts."""
    sent = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, counter = sent.value, PairCounter()
        repairer = _repairer(model) if model is not None else None
        known = model.cost if model is not None else None
        for b in batches:
            for t in b.column(0).to_pylist():
                if t and (repairer is None or repairer.repair(t)[1]):
                    counter.add(t)
                if len(counter.n) > COUNTED:
                    yield counter.rows(known)
        yield counter.rows(known)

    return texts.select(text_col).mapInArrow(run, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def fit(texts: DataFrame, text_col: str = "text") -> CostModel:
    """Cost model of all texts. A first model tells the garbled ones, all of them; the shares of the second are those of texts that hold a pair and aren't garbled."""
    all_ = stage_table(_count_pairs(texts, text_col), "pairs")
    total = (all_.where("pair = ''").select("n").first() or [0])[0]
    if not total:
        return CostModel({})
    odd = max(ODD_SHARE, 2 / total)
    often = all_.where((F.col("pair") != "") & (F.col("n") >= F.greatest(F.lit(2.0), F.lit(LEAST_SHARE * total))))  # a table of the alphabets, not of the corpus
    n = {r[0]: r[1] for r in often.select("pair", "n").collect()}
    garbled = {r[0]: r[1] for r in _count_pairs(texts, text_col, CostModel({k: v / total for k, v in n.items()}, odd)).collect()}  # pairs of that table
    clean = {k: (v - garbled.get(k, 0)) / total for k, v in n.items()}
    return CostModel({k: v for k, v in clean.items() if v >= max(LEAST_SHARE, 1.5 / total)}, odd)


def repair_texts(docs: DataFrame, model: CostModel, id_col: str = "doc_id", text_col: str = "text", only_garbled: bool = True) -> DataFrame:
    """(id, repaired, mistakes): texts with the original restored where it can be, mistakes as 'written as read', outermost first."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _repairer(sent.value)
        for b in batches:
            keep, texts, names = [], [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                new, undone = r.repair(t)
                if undone or not only_garbled:
                    keep.append(k)
                    texts.append(new)
                    names.append(undone)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(texts, pa.string()), pa.array(names, pa.list_(pa.string()))], [id_col, "repaired", "mistakes"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, repaired string, mistakes array<string>")
