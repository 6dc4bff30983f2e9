"""P1: language of documents and of the stretches of mixed ones, by bit-sliced Bloom filters over n-grams.

One table of bit masks holds the Bloom filters of all languages side by side: the masks at an n-gram's places, combined by
AND, give all languages that contain it. The n-grams of a clause are counted by language, corrected for the filters' false
positives, and the best path over the clauses of a document decides, where a change of language must pay for itself and is
dearer inside a sentence. Words with digits, addresses of mail and web and single marks have no n-grams.

Defined results: null texts and texts without any known n-gram have language null and confidence 0; texts with fewer than
``min_letters`` letters are no cases.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_table
from . import encoding

#: Codes of the languages told apart; a mask has one bit for each (fixed values).
LANGUAGES = tuple("en de fr es it pt nl pl ru ar hi th ja zh ko".split())
#: Places of the filters, of one size for every corpus (8 MB), and their hashes.
ROWS_LOG2, HASHES = 22, 3
#: n-grams that a partition counts before it hands them on, and tokens and n-grams whose answers a worker remembers.
COUNTED, KEPT = 500_000, 200_000
#: Tokens whose hits a worker adds up together, and n-grams that it sorts together.
TOGETHER, SORTED = 20_000, 500_000
#: Places that one task packs for the driver (as a power of 2).
SEGMENT = 18
#: An n-gram belongs to a language that shows it in at least this part of the share of texts in which the likeliest language does.
KEPT_SHARE = 0.25
#: Hits that a change of language must win: between sentences, and between clauses within one.
CHANGE, CHANGE_INSIDE = 14.0, 30.0
#: What a word with a capital counts, as it may be a name.
NAME_WEIGHT = 0.25
#: Shares of words with a first capital, and of swapped case, above which capitals don't set names apart, and the words it takes to tell.
CAPITALS, SWAPPED, TELLING = 0.6, 0.3, 8

#: Names and longer codes of labels (fixed values).
NAMES = {
    "eng": "en", "english": "en", "deu": "de", "ger": "de", "german": "de", "fra": "fr", "fre": "fr", "french": "fr", "spa": "es", "spanish": "es", "castilian": "es",
    "ita": "it", "italian": "it", "por": "pt", "portuguese": "pt", "nld": "nl", "dut": "nl", "dutch": "nl", "flemish": "nl", "pol": "pl", "polish": "pl", "rus": "ru", "russian": "ru",
    "ara": "ar", "arabic": "ar", "hin": "hi", "hindi": "hi", "tha": "th", "thai": "th", "jpn": "ja", "japanese": "ja", "zho": "zh", "chi": "zh", "cmn": "zh", "chinese": "zh", "kor": "ko", "korean": "ko",
}
_TOKEN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー々]+|\p{Thai}+|[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*")
_ADDRESS = regex.compile(
    r"(?<![A-Za-z0-9０-９ａ-ｚ._+＋．－-])[A-Za-z0-9０-９ａ-ｚ._+＋．－-]{1,60}+[^\S\r\n]?(?:[@＠]|[\[(]at[\])]|(?<=[^\S\r\n])at(?=[^\S\r\n][\w-]+[^\S\r\n](?:dot|\(dot)))[^\S\r\n]?[\w－-]+(?:[^\S\r\n]?(?:[.．]|[\[(]dot[\])]|(?<=[^\S\r\n])dot(?=[^\S\r\n]))[^\S\r\n]?[\w－-]+)*"
    r"|https?://\S+",
    regex.I,
)
_MAY_ADDRESS = regex.compile(r"[@＠]|[\[(]at[\])]|://|\bat [\w-]+ dot\b", regex.I)
_CLAUSE = regex.compile(r"(?<![.!?;…。！？；।|؟．])[.!?;…。！？；।|؟．]++[”“\"’»)\]」』）]*+(?=\s|[\p{Han}\p{Hiragana}\p{Katakana}])|[\r\n]++|\s/\s|(?<=\p{Thai})[^\S\r\n]+(?=\p{Latin}{2,}[^\S\r\n]+\p{Latin}{2,})|(?<=[\p{Latin}.!?][^\S\r\n])(?=\p{Thai}{8,})")
_DENSE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
#: What every address of ``_ADDRESS`` has, and how far behind its beginning at most.
_IN_ADDRESS, BEFORE = regex.compile(r"[@＠]|[\[(]at[\])]|://|(?<=[^\S\r\n])at(?=[^\S\r\n][\w-]+[^\S\r\n](?:dot|\(dot))", regex.I), 64
#: The parts of ``_CLAUSE`` for texts without Thai.
_THAI, _MARK = re.compile("[\u0e00-\u0e7f]"), re.compile("[.!?;…。！？；।|؟．\r\n/]")
_MARKS, _CLOSING, _BLANKS = frozenset(".!?;…。！？；।|؟．"), frozenset("”“\"’»)]」』）"), frozenset("\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
_MAY_AT = re.compile(r"[aA][tT](?:[\])]| [^ ]+ [dD][oO][tT])")  # in what ``_MAY_ADDRESS`` finds, where it isn't one of the next
_ADDRESS_MARKS = ("@", "＠", "://")
_LETTERS = regex.compile(r"\p{L}+").findall


class _Matches(dict):
    """Whether a character matches a pattern, by character."""

    def __init__(self, pattern: regex.Pattern):
        self.match = pattern.match

    def __missing__(self, c: str) -> bool:
        found = self[c] = self.match(c) is not None
        return found


_BEHIND, _UNSPACED = _Matches(regex.compile(r"[\s\p{Han}\p{Hiragana}\p{Katakana}]")), _Matches(_DENSE)


def _class(pattern: str) -> str:
    """The characters of the first plane that a pattern matches, as ranges of a class."""
    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    return "".join(f"{re.escape(x[0])}-{re.escape(x[-1])}" for x in regex.findall(f"(?:{pattern})+", plane))


#: Tokens of texts that have nothing but words of letters and marks of the first plane, which are most, and what the others have.
_WORD = re.compile("[{0}]+(?:['’][{0}]+)*".format(_class(r"[\p{L}\p{M}]")))
_OTHER = re.compile("[" + _class(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}ー々]") + "\U00010000-\U0010ffff]")


@lru_cache(10_000)
def label_code(label: str | None) -> str | None:
    """Two-letter code that a label names, whatever its case, length, region or script; null if it names none of the known."""
    head = regex.split(r"[^A-Za-z]+", (label or "").strip())[0].lower()
    return head if head in LANGUAGES else NAMES.get(head)


def ngrams(token: str) -> list[str]:
    """n-grams of one token: of two and one characters in scripts without blanks, else of three and five with the ends marked, and the token."""
    if _UNSPACED[token[:1]]:
        size = (1, 2) if not "฀" <= token[0] <= "๿" else (3, 5)
        return [token[k : k + n] for n in size for k in range(len(token) - n + 1)]
    t = f"^{token}$"
    return [t, *[t[k : k + 3] for k in range(len(t) - 2)], *[t[k : k + 5] for k in range(len(t) - 4)]]


def _clean(t: str) -> str:
    """Text with blanks over what has no language."""
    if not any([x in t for x in _ADDRESS_MARKS]) and not (_MAY_AT.search(t) and _MAY_ADDRESS.search(t)):
        return t
    out, at = [], 0
    while m := _IN_ADDRESS.search(t, at):  # between addresses only what may begin one is read
        m = _ADDRESS.search(t, max(at, m.start() - BEFORE))
        if m is None:
            break
        out += t[at : m.start()], " " * len(m.group())
        at = m.end()
    return "".join(out) + t[at:] if out else t


def _clause_ends(t: str) -> list[tuple[int, int]]:
    """Where the matches of ``_CLAUSE`` begin and end."""
    if _THAI.search(t):
        return [m.span() for m in _CLAUSE.finditer(t)]
    out, at, n = [], 0, len(t)
    for m in _MARK.finditer(t):
        first = m.start()
        if first < at:
            continue
        mark, at = t[first], first + 1
        if mark in _MARKS:
            while at < n and t[at] in _MARKS:
                at += 1
            while at < n and t[at] in _CLOSING:
                at += 1
            if at < n and _BEHIND[t[at]]:
                out.append((first, at))
        elif mark != "/":
            while at < n and t[at] in "\r\n":
                at += 1
            out.append((first, at))
        elif first > (out[-1][1] if out else 0) and at < n and t[first - 1] in _BLANKS and t[at] in _BLANKS:
            at += 1
            out.append((first - 1, at))
    return out


def _finder(text: str) -> Callable[..., list[str]]:
    """What finds the tokens of ``_TOKEN`` in a text soonest."""
    return (_TOKEN if _OTHER.search(text) else _WORD).findall


def _tokens(text: str) -> list[str]:
    clean = _clean(text.lower())
    return _finder(clean)(clean)


class GramCounter:
    """Texts with each n-gram by language; the n-gram "" counts the texts. n-grams are numbered, those of many texts sorted together."""

    def __init__(self):
        self.kept: dict[str, np.ndarray] = {}
        self.begin()

    def begin(self) -> None:
        self.ids: dict[str, int] = {}
        self.kept.clear()
        self.texts: Counter = Counter()
        self.waiting: list[np.ndarray] = []
        self.of: list[tuple[int, int]] = []  # language and n-grams of each waiting text
        self.size = 0
        self.keys, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, code: str, text: str | None) -> None:
        kept = self.kept
        if len(kept) > KEPT:
            kept.clear()
        self.texts[code] += 1
        tokens, once, ids = set(_tokens(text or "")), {}, self.ids
        for t in tokens.difference(kept):
            # runs without blanks hardly recur
            (once if _UNSPACED[t[0]] else kept)[t] = np.array([ids.setdefault(g, len(ids)) for g in ngrams(t)], np.int64)
        tokens.difference_update(once)
        found = [*map(kept.__getitem__, tokens), *once.values()]
        n = sum(map(len, found))
        self.waiting += found
        self.of.append((LANGUAGES.index(code), n))
        self.size += n
        if self.size > SORTED:
            self.flush()

    def flush(self) -> None:
        waiting, of, self.waiting, self.of, self.size = self.waiting, self.of, [], [], 0
        if not waiting:
            return
        codes, sizes = np.array(of).T
        # text, then n-gram: each n-gram counts once for a text
        keys = np.sort(np.repeat(np.arange(len(of)) << 32, sizes) | np.concatenate(waiting))
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
        keys = np.sort(codes[keys >> 32] << 32 | keys & 0xFFFFFFFF)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, n = np.concatenate([self.keys, keys[first]]), np.concatenate([self.n, np.diff(first, append=len(keys))])
        self.keys, at = np.unique(keys, return_inverse=True)
        self.n = np.bincount(at, n).astype(np.int64)

    def full(self) -> bool:
        return max(len(self.keys), len(self.ids)) > COUNTED

    def rows(self, sign: int = 1) -> pa.RecordBatch:
        """The counts as rows (gram, code, n), n times ``sign``; begins anew."""
        self.flush()
        grams = pa.array([*self.ids, ""], pa.string()).take(np.append(self.keys & 0xFFFFFFFF, [len(self.ids)] * len(self.texts)).astype(np.int64))
        codes = pa.array(LANGUAGES, pa.string()).take(np.append(self.keys >> 32, [LANGUAGES.index(c) for c in self.texts]).astype(np.int64))
        n = sign * np.append(self.n, list(self.texts.values())).astype(np.int64)
        self.begin()
        return pa.RecordBatch.from_arrays([grams, codes, pa.array(n)], ["gram", "code", "n"])


def _places(grams: list[str]) -> np.ndarray:
    """A row of places for each n-gram: the lowest bits of its digest, then the next ones."""
    h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, grams)), ">u8").astype(np.uint64).reshape(-1, 2)
    high, low = h.T
    parts = [low, low >> np.uint64(ROWS_LOG2), low >> np.uint64(2 * ROWS_LOG2) | high << np.uint64(64 - 2 * ROWS_LOG2)]
    return (np.stack(parts, 1) & np.uint64((1 << ROWS_LOG2) - 1)).astype(np.int64)


class LanguageFilters:
    """The bit-sliced filters: ``rows[p]`` has the bits of all languages whose filter has place p set."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.known = rows, {}
        bits = (rows[:, None] >> np.arange(len(LANGUAGES), dtype=np.uint16)) & 1
        self.false = bits.mean(0) ** HASHES

    def masks(self, grams: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > KEPT:
            known.clear()
        fresh = list(set(grams).difference(known))
        if fresh:
            known.update(zip(fresh, np.bitwise_and.reduce(self.rows[_places(fresh)], axis=1).tolist()))
        return np.array([*map(known.__getitem__, grams)], np.uint16)

    def __getstate__(self):
        return self.rows, self.false

    def __setstate__(self, state) -> None:
        (self.rows, self.false), self.known = state, {}


class LanguageReader:
    """Language paths of texts; keeps the counts of tokens seen."""

    def __init__(self, filters: LanguageFilters, repairer: encoding.Repairer | None = None):
        self.filters, self.repairer = filters, repairer
        self.kept: dict[str, int] = {}
        self.table = np.zeros((4096, len(LANGUAGES) + 5))

    def add(self, tokens: set[str]) -> None:
        """Rows of the table for new tokens: hits by language, the number of n-grams, and the counts of words, first capitals, capitals throughout, swapped case."""
        first, new = len(self.kept), sorted(tokens)
        while first + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        grams = [ngrams(t.lower()) for t in new]
        n = np.array([len(g) for g in grams])
        masks = self.filters.masks([g for x in grams for g in x])
        bits = (masks[:, None] >> np.arange(len(LANGUAGES), dtype=np.uint16)) & 1
        upto = np.concatenate([np.zeros((1, len(LANGUAGES)), np.int64), np.cumsum(bits, axis=0, dtype=np.int64)])
        counts = upto[np.cumsum(n)] - upto[np.cumsum(n) - n]  # short tokens may have no n-gram
        f = self.filters.false
        # a capital may begin a name, which has no language
        weight = np.array([NAME_WEIGHT if t[0].isupper() else 1.0 for t in new])[:, None]
        rows = self.table[first : first + len(new)]
        rows[:, :-5] = weight * np.maximum(0.0, (counts - f * n[:, None]) / (1 - f))
        rows[:, -5] = weight[:, 0] * n
        rows[:, -4:] = [(1, t[0].isupper(), len(t) > 1 and t.isupper(), t[1:2].isupper() and not t[0].isupper()) for t in new]
        self.kept.update(zip(new, range(first, first + len(new))))

    def rows(self, tokens: list[str]) -> list[int]:
        fresh = set(tokens).difference(self.kept)
        if fresh:
            self.add(fresh)
        return [*map(self.kept.__getitem__, tokens)]

    @staticmethod
    def lowered(counts: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Whether each clause counts in small letters, as its capitals don't set names apart: a long clause by its own words; a short one by the whole text, or with the clauses before or behind it if it and they are in capitals throughout. firsts: the first clause of each text."""
        words, first, through, swapped = counts.T
        w, f, _, x = np.add.reduceat(counts, firsts, axis=0).T
        ends = np.append(firsts[1:], len(words))
        whole = np.repeat((f > CAPITALS * w) | (x > SWAPPED * w), ends - firsts)
        low = np.where(words >= TELLING, (first > CAPITALS * words) | (swapped > SWAPPED * words), whole)
        upper = through + swapped
        for k in np.flatnonzero((words < TELLING) & ~low & (upper > CAPITALS * words)):
            text = np.searchsorted(firsts, k, "right") - 1
            for step in (1, -1):
                n = u = 0.0
                j = k
                while n < TELLING and firsts[text] <= j < ends[text]:
                    n, u, j = n + words[j], u + upper[j], j + step
                if n >= TELLING and u > CAPITALS * n:
                    low[k] = True
        return low

    @staticmethod
    def split(text: str) -> tuple[list[str], list[int], list[float], list[int]]:
        """Words, the first word of each clause, what a change of language costs at its beginning, and where it begins."""
        clean = _clean(text)
        find = _finder(clean)
        words, firsts, costs, begins, at, cost = [], [], [], [], 0, CHANGE
        for start, end in [*_clause_ends(clean), (None, len(clean))]:
            tokens = find(clean, at, end)
            if tokens:
                firsts.append(len(words))
                costs.append(cost)
                begins.append(at)
                words += tokens
                cost = CHANGE_INSIDE
            if start is not None:
                at = end
                mark = clean[start:end][:1]
                if mark not in (";", "；", "|") and not (mark in ("\r", "\n") and cost == CHANGE_INSIDE and clean[start - 1 : start] not in ".!?…。！？।؟-📎 "):
                    cost = CHANGE
        return words, firsts, costs, begins

    def hits(self, parts: list[tuple[list[str], list[int]]]) -> np.ndarray:
        """Hits of the clauses of texts that have words, one text after the other: of each its words and the first word of each clause."""
        words = [w for x, _ in parts for w in x]
        sizes = np.array([len(x) for x, _ in parts])
        n = np.array([len(f) for _, f in parts])
        firsts = np.array([k for _, f in parts for k in f]) + np.repeat(np.cumsum(sizes) - sizes, n)
        ids = self.rows(words)
        h = np.add.reduceat(self.table[ids], firsts, axis=0)
        if low := np.flatnonzero(self.lowered(h[:, -4:], np.cumsum(n) - n)).tolist():
            ends = [*firsts[1:].tolist(), len(words)]
            own = [[t.lower() for t in words[firsts[c] : ends[c]]] for c in low]
            ids = self.rows([t for x in own for t in x])
            h[low] = np.add.reduceat(self.table[ids], np.cumsum([0, *map(len, own[:-1])]), axis=0)
        h = h[:, :-4]
        # clauses of names and codes are known by no language; they count for less
        h[:, :-1] *= np.clip((h[:, :-1].max(1) / np.maximum(1, h[:, -1]) - 0.5) / 0.4, 0, 1)[:, None]
        return h

    def clauses(self, text: str) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Hits of each clause, what a change of language costs at its beginning, and where it begins."""
        words, firsts, costs, begins = self.split(text)
        if not words:
            return np.zeros((0, len(LANGUAGES) + 1)), np.zeros(0), []
        return self.hits([(words, firsts)]), np.array(costs), begins

    def paths(self, texts: Iterable[str]) -> Iterator[tuple[list[tuple[str, float]], list[int]]]:
        """(language, confidence) of each stretch of each text, and where each begins, the first at 0."""
        waiting, size = [], 0
        for t in texts:
            waiting.append(self.split(t))
            size += len(waiting[-1][0])
            if size > TOGETHER:
                yield from self._paths(waiting)
                waiting, size = [], 0
        yield from self._paths(waiting)

    def _paths(self, parts: list[tuple[list[str], list[int], list[float], list[int]]]) -> Iterator[tuple[list[tuple[str, float]], list[int]]]:
        if len(self.kept) > KEPT:
            self.kept.clear()
        some = [x for x in parts if x[0]]
        if not some:
            yield from [([], []) for _ in parts]
            return
        gains = self.hits([x[:2] for x in some])[:, :-1]
        n = np.array([len(x[1]) for x in some])
        firsts = np.cumsum(n) - n
        sums = np.add.reduceat(gains, firsts, axis=0)
        whole = sums.argmax(1)
        lost = np.add.reduceat(gains.max(1) - gains[np.arange(len(gains)), np.repeat(whole, n)], firsts)
        k = 0
        for _, clauses, costs, begins in parts:
            if not clauses:
                yield [], []
                continue
            part, top, f = sums[k], int(whole[k]), firsts[k]
            if not part[top]:
                yield [], []
            elif lost[k] < CHANGE:
                yield [self._stretch(part, top)], [0]
            else:
                yield self._best(gains[f : f + len(clauses)], costs, begins)
            k += 1

    @staticmethod
    def _stretch(part: np.ndarray, state: int) -> tuple[str, float]:
        top = part[state]
        part[state] = 0
        return LANGUAGES[state], float(max(0.0, top - part.max()) / max(1.0, top))

    def _best(self, gain: np.ndarray, costs: list[float], begins: list[int]) -> tuple[list[tuple[str, float]], list[int]]:
        """The best path over the clauses of one text."""
        best, back = gain[0].copy(), []
        for k in range(1, len(gain)):
            top = int(best.argmax())
            change = best[top] - costs[k]
            stay = best >= change
            back.append(np.where(stay, np.arange(len(best)), top))
            best = np.where(stay, best, change) + gain[k]
        state = [int(best.argmax())]
        for b in reversed(back):
            state.append(int(b[state[-1]]))
        state.reverse()
        out, starts, first = [], [], 0
        for k in range(1, len(state) + 1):
            if k == len(state) or state[k] != state[first]:
                out.append(self._stretch(gain[first:k].sum(0), state[first]))
                starts.append(begins[first] if first else 0)
                first = k
        return out, starts

    def path(self, text: str) -> tuple[list[tuple[str, float]], list[int]]:
        """(language, confidence) of each stretch, and where each begins, the first at 0."""
        return next(self.paths([text]))

    def read(self, text: str | None) -> list[tuple[str, float]]:
        """(language, confidence) of each stretch of the text as it was before any wrong decoding."""
        return [x[:2] for x in self.stretches(text)]

    def stretches(self, text: str | None) -> list[tuple[str, float, int | None, int | None]]:
        """(language, confidence, start, end) of each stretch; a garbled text has no offsets, as those of the repaired text would not fit it."""
        return next(self.all_stretches([text]))

    def all_stretches(self, texts: list[str | None]) -> Iterator[list[tuple[str, float, int | None, int | None]]]:
        """The stretches of each text."""
        # whatever its path: a clean rest says nothing about a short garbled stretch
        as_meant = [self.repairer.repair(t)[0] if t and self.repairer is not None else t or "" for t in texts]
        for text, meant, (out, starts) in zip(texts, as_meant, self.paths(as_meant)):
            if meant != (text or ""):
                yield [(*x, None, None) for x in out]
            else:
                yield [(*x, s, e) for x, s, e in zip(out, starts, [*starts[1:], len(meant)])]


GRAMS = "gram string, code string, n bigint"


def count_grams(examples: DataFrame) -> DataFrame:
    """(gram, code, n) of (code, text): texts of each language with each n-gram; the n-gram "" counts the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = GramCounter()
        for b in batches:
            for code, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c.add(code, text)
                if c.full():
                    yield c.rows()
        yield c.rows()

    return examples.select("code", "text").mapInArrow(count, GRAMS).groupBy("gram", "code").agg(F.sum("n").alias("n"))


def filters_of(counts: DataFrame) -> LanguageFilters:
    """Filters of (gram, code, n): their bits are set on the workers; the driver gets the filters' rows.

    An n-gram must be in two texts of a language at least.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _places(b.column(0).to_pylist()).ravel()
            yield pa.RecordBatch.from_arrays([pa.array((at >> SEGMENT).astype(np.int32)), pa.array((at & ((1 << SEGMENT) - 1)).astype(np.int32)), pa.array(np.repeat(b.column(1).to_numpy(), HASHES))], ["segment", "place", "mask"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(1):
                rows = np.zeros(1 << SEGMENT, np.uint16)
                rows[x.values.field(0).to_numpy()] = x.values.field(1).to_numpy()
                out.append(rows.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["segment", "bits"])

    docs = {r[0]: r[1] for r in counts.where("gram = ''").select("code", "n").collect()}  # one row for each language
    share = F.lit(0.0)
    bit = F.lit(0)
    for k, code in enumerate(LANGUAGES):
        if docs.get(code):
            share = F.when(F.col("code") == code, F.col("n") / F.lit(float(docs[code]))).otherwise(share)
            bit = F.when(F.col("code") == code, F.lit(1 << k)).otherwise(bit)
    x = counts.where("gram <> '' and n > 1").select("gram", F.struct(share.alias("share"), bit.alias("bit")).alias("x")).groupBy("gram").agg(F.max("x.share").alias("top"), F.collect_list("x").alias("by"))  # as many as languages
    mask = F.aggregate("by", F.lit(0), lambda a, y: a.bitwiseOR(F.when(y["share"] >= KEPT_SHARE * F.col("top"), y["bit"]).otherwise(0)))
    places = x.select("gram", mask.alias("mask")).mapInArrow(place, "segment int, place int, mask int").groupBy("segment", "place").agg(F.bit_or("mask").alias("mask"))
    segments = places.groupBy("segment").agg(F.collect_list(F.struct("place", "mask")).alias("places"))  # at most 2**SEGMENT places
    rows = np.zeros(1 << ROWS_LOG2, np.uint16)
    for k, part in segments.mapInArrow(pack, "segment int, bits binary").collect():  # the filters' bytes, whatever the number of n-grams
        rows[k << SEGMENT : (k + 1) << SEGMENT] = np.frombuffer(part, np.uint16)
    return LanguageFilters(rows)


def fit_filters(examples: DataFrame) -> LanguageFilters:
    """Filters of (code, text)."""
    return filters_of(stage_table(count_grams(examples), "ngrams"))


def fit(docs: DataFrame, text_col: str = "raw_text", lang_col: str = "lang") -> LanguageFilters:
    """Filters of all labelled documents. A first round takes all labels as they are; of the documents whose one language it finds is the one of the label are the counts of the second: those of the others are taken off."""
    code = F.lower(F.split_part(F.regexp_replace(F.trim(lang_col), "[^A-Za-z]+", "-"), F.lit("-"), F.lit(1)))
    table = F.create_map(*[F.lit(x) for c in LANGUAGES for x in (c, c)], *[F.lit(x) for pair in NAMES.items() for x in pair])
    rows = docs.where(f"trim(`{lang_col}`) <> '' and `{text_col}` <> ''").select(table[code].alias("code"), F.col(text_col).alias("text")).where("code is not null")
    counts = stage_table(count_grams(rows), "ngrams")  # an n-gram and language once
    first = docs.sparkSession.sparkContext.broadcast(filters_of(counts))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, c = _reader(first.value, None), GramCounter()
        for b in batches:
            codes, texts = (x.to_pylist() for x in b.columns)
            for code, text, (path, _) in zip(codes, texts, reader.paths(texts)):
                if [x for x, _ in path] != [code]:
                    c.add(code, text)
                    if c.full():
                        yield c.rows(-1)
        yield c.rows(-1)

    agreed = counts.unionByName(rows.mapInArrow(others, GRAMS)).groupBy("gram", "code").agg(F.sum("n").alias("n"))
    return filters_of(stage_table(agreed.where("n > 0"), "agreed"))


_READERS: dict[int, LanguageReader] = {}


def _reader(filters: LanguageFilters, costs: encoding.CostModel | None) -> LanguageReader:
    """The reader of a worker: what one task has learned of words serves the next."""
    key = xxhash.xxh3_64_intdigest(filters.rows.tobytes(), len(costs.cost) if costs is not None else 0)
    if key not in _READERS:
        _READERS.clear()
        _READERS[key] = LanguageReader(filters, encoding.Repairer(costs) if costs is not None else None)
    return _READERS[key]


def label_documents(docs: DataFrame, filters: LanguageFilters, costs: encoding.CostModel | None = None, id_col: str = "doc_id", text_col: str = "raw_text", lang_col: str = "lang") -> DataFrame:
    """(id, seg_no, lang, confidence, start_char, end_char, label, n_letters, n_segments) of every document; documents without known words have one row with lang null, and garbled ones no offsets."""
    sent = docs.sparkSession.sparkContext.broadcast((filters, costs))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(*sent.value)
        for b in batches:
            at, rows = [], []
            texts = b.column(1).to_pylist()
            for k, (t, label, path) in enumerate(zip(texts, b.column(2).to_pylist(), reader.all_stretches(texts))):
                path = path or [(None, 0.0, None, None)]
                n = sum(map(len, _LETTERS(t))) if t else 0
                code = label_code(label)
                at += [k] * len(path)
                rows += [(j, *x, code, n, len(path)) for j, x in enumerate(path)]
            cols = list(zip(*rows)) or [[]] * 8
            arrays = [pa.array(list(x), y) for x, y in zip(cols, (pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *arrays], [id_col, *names])

    names = ["seg_no", "lang", "confidence", "start_char", "end_char", "label", "n_letters", "n_segments"]
    return docs.select(id_col, text_col, lang_col).mapInArrow(run, f"`{id_col}` {kind}, seg_no int, lang string, confidence double, start_char int, end_char int, label string, n_letters int, n_segments int")


def mislabelled(labelled: DataFrame, min_letters: int = 20) -> DataFrame:
    """Rows of documents whose label is missing or names another language, or that mix languages."""
    return labelled.where(F.col("lang").isNotNull() & (F.col("n_letters") >= min_letters) & ((F.col("n_segments") > 1) | F.col("label").isNull() | (F.col("label") != F.col("lang"))))
