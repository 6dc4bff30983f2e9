"""P3: sentence units with offsets, across scripts, by document-centred disambiguation.

A full stop is ambiguous: whether the word before it is an abbreviation is decided first by unambiguous occurrences in the
same document (the word with a stop before a small letter, or without one), then by such occurrences over the whole corpus,
and by fixed lists only where both are silent or at odds; whether a capitalised word after an abbreviation starts a sentence
is decided in the same order, by small letters elsewhere against capitals inside sentences, which tell proper names. Other scripts have terminators of their own. Thai, which has none, is cut at
blanks between what the corpus shows at the ends and at the beginnings of paragraphs.

Defined results: null and blank texts give no units; offsets are code points, half-open; units carry no white space and
no byte-order mark at their ends; blank lines always end a unit, other line breaks only after a terminator or before a
list marker.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_table
from .wordfilter import WordFilter, filter_segments

# Abbreviations that always stand before something.
BEFORE = frozenset(
    "mr mrs ms dr prof col gen lt capt sgt rev hon st messrs mx fig figs vol ch sec pp cf vs viz approx ca esp incl excl e.g i.e tel ext dept est "
    "hr fr frl nr abs vgl bzw geb inkl exkl insb zzgl bspw ggf sog z.b d.h u.a v.h z evtl dipl ing kap lfd str hrsg tgl mind max min "
    "mme mlle mgr art env réf av chap éd fig not p.ex c.-à-d n° tél bd cie "
    "sr sra srta sres dña avda núm aprox pág págs apdo ej p.ej ctra izq dcha gral lic "
    "sig sigg sig.ra dott dott.ssa ing avv pag es compr spec ecc.to c.so p.es "
    "sr dr dra exmo exma n.º cap ex p.ex "
    "dhr mevr mw blz bijv m.n nl resp t.a.v d.w.z bv drs ir mr "
    "ul al pl os np zob por zwł ust godz tzn tj tzw ok pkt poz prof inż hab mec św m.in "
    "г ул д пр пер просп кв обл р-н стр ст см п гл рис табл т.е т.к т.н напр прибл особ проф акад доц гр им тел ч руб "
    "д م أ ص ت ج تح د هـ "
    "डॉ श्री प्रो कि.ग्रा ".split()
)
# Abbreviations that also end sentences.
EITHER = frozenset(
    "etc p.m a.m inc ltd co corp plc jr sr u.s u.k u.n hosp ave rd blvd no al ff bros dec jan feb mar apr jun jul aug sep sept oct nov "
    "usw u.a.m o.ä u.ä h v.h kg km cm mm ecc enz pct itd itp т.п т.д др г.г proc проц ed eds art sec rev p.s d.c e.v gmbh ag s.a n.v b.v спб млн тыс".split()
)
# Words that begin sentences, where neither document nor corpus has them in small letters.
OPENERS = frozenset("the we it this they he she in at on as for der die das es wir sie er le la les il nous el los lo una un een de het o os as um a on w i то это мы они в на".split())
GERMAN_MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember jan feb mär apr jun jul aug sep sept okt nov dez".split())
THAI_INNER = ("แล้ว", "และ", "หาก", "เมื่อ", "พร้อม", "ได้", "ก่อนเที่ยง", "ลงวัน", "ตามบัตร", "จาก", "ที่")

_NL = r"(?>\r\n|\n|\r)"
_INNER = rf"(?:[^\r\n{{}}]|{_NL}(?![^\S\r\n]*{_NL}))"
_SET_IN = regex.compile(
    "|".join(
        a + _INNER.replace("{}", not_) + "*?" + b
        for a, b, not_ in (
            ("“", "”", "“”"),
            ("„", "[“”]", "„“”"),
            ("«", "»", "«»"),
            ("「", "」", "「」"),
            ("『", "』", "『』"),
            (r"\(", r"\)", "()"),
            ("（", "）", "（）"),
            ("(?<![\\w])\"", "\"(?![\\w])", "\""),
            ("(?<![\\w])[‘‚](?=\\p{Lu})", "[.!?…]’", "‘"),
        )
    )
)
_SMALL = regex.compile(r"(?<![\p{L}\p{M}])\p{Ll}[\p{L}\p{M}]*")
_CAPITAL = regex.compile(r"(?<![\p{L}\p{M}])\p{Lu}[\p{L}\p{M}]*")
_INNER_CAPITAL = regex.compile(r"(?<=[\p{L}\p{M}\p{N}][,;]?[ \u00a0]|(?<!\p{L})\p{Lu}\.[ \u00a0])\p{Lu}[\p{Ll}\p{M}]+")
_EMOJI = r"(?:(?:[^\S\r\n]*\p{Extended_Pictographic}[️‍\U0001f3fb-\U0001f3ff]*)(?<![\d#*]))"
_MARKER = r"(?:[-–—•*·▪◦‣●○]|\d{1,2}[.)]|[a-z]\))[^\S\r\n]+"
_CANDIDATE = regex.compile(
    rf"(?P<para>{_NL}[^\S\r\n]*{_NL}\s*)"
    rf"|(?P<list>{_NL}[^\S\r\n]*(?=[-–—•*·▪◦‣●○][^\S\r\n]))"
    rf"|(?P<num>{_NL}[^\S\r\n]*(?=\d{{1,2}}[.)][^\S\r\n]+\p{{L}}))"
    rf"|(?P<term>[.!?…。！？｡．؟۔।॥|]+)(?P<close>(?:[^\S\r\n]?»|[”“\"’\)\]」』）])*)(?P<emoji>{_EMOJI}*)(?P<gap>\s*)"
)
_WORD_BEFORE = regex.compile(r"[\p{L}\p{M}\p{N}°º]+(?:\.[\p{L}\p{M}\p{N}]+)*$")
_NEXT_WORD = regex.compile(r"[\p{L}\p{M}\p{N}’']+")
_OPENING = "“„«\"‘‚([（「『¿¡—–-•*"
_EDGE = regex.compile(r"^[\s﻿​⁠]+|[\s﻿​⁠]+$")
_THAI_GAP = regex.compile(r"(?<=\S)(?P<emoji>(?:[^\S\r\n]*\p{Extended_Pictographic})*)[^\S\r\n]*(?:[^\S\r\n]|(?:\r\n|\n|\r))[^\S\r\n]*(?=\p{Thai})")
_THAI = regex.compile(r"\p{Thai}")


class Evidence(WordFilter):
    """What the corpus shows: before and either, abbreviations as they are written, by what follows them; ordinary, words
    that are none; of words in small letters small, words that are not proper names, and proper, which are; first and last, what Thai
    paragraphs begin and end with; seen, whether there is any of the last two."""


NO_EVIDENCE = Evidence()


def _cased(c: str) -> bool:
    return c.lower() != c.upper()


def _cjk(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "豈" <= c <= "﫿" or "０" <= c <= "９"


#: Uses in the corpus that decide, the share of them before small letters that makes an abbreviation, and the smaller one of those that may end sentences as well.
TOLD, BEFORE_SHARE, EITHER_SHARE = 3, 0.7, 0.3
#: Uses without a stop, as a multiple of those with one, that make an ordinary word.
BARE_TIMES = 3


def _telling(small: int, capital: int) -> bool:
    """Whether capitals set words apart in a text with so many words with and without one: not where all words have them, or hardly any."""
    return 0.03 <= capital / max(1, small + capital) <= 0.7


class _Document:
    def __init__(self, text: str, evidence: Evidence):
        self.text, self.evidence = text, evidence
        self._words: tuple[set[str], set[str], bool] | None = None
        self._uses: dict[str, tuple[bool, bool]] = {}

    def words(self) -> tuple[set[str], set[str], bool]:
        """Words in small letters, words with a capital after a small word, and whether capitals tell anything here."""
        if self._words is None:
            small = _SMALL.findall(self.text)
            self._words = set(small), {w.lower() for w in _INNER_CAPITAL.findall(self.text)}, _telling(len(small), len(_CAPITAL.findall(self.text)))
        return self._words

    def uses(self, word: str) -> tuple[bool, bool]:
        """Whether the document has the word with a stop where no sentence ends, and without a stop."""
        if word not in self._uses:
            w = regex.escape(word)
            stopped = regex.search(rf"(?<![\w.]){w}\.[^\S\r\n]?(?:[,;:]|[^\S\r\n]?\p{{Ll}}\p{{L}})", self.text) is not None
            self._uses[word] = stopped, regex.search(rf"(?<![\w.’'@-]){w}(?![\w.’'@-])", self.text) is not None
        return self._uses[word]

    def abbreviation(self, word: str, number_next: bool = False) -> str:
        """'before', 'either' or '' for a word in front of a stop and something that isn't a small letter.

        The document decides first: with stops inside sentences alone the word is an abbreviation, without any stop it is
        none, unless a number follows. Where it is silent or at odds the corpus decides, and then the lists, which also
        tell whether an abbreviation of the document can end a sentence.
        """
        w = word.lower()
        inner = w.count(".") and len(w) <= 6 and all(len(p) <= 2 for p in w.split("."))
        listed = "either" if w in EITHER else "before" if w in BEFORE or inner or w.endswith("str") else ""
        forms = (word,) if self.words()[2] else (word, w, w.capitalize())
        kind = next((k for k in ("before", "either") for f in forms if self.evidence.has(k, f)), listed)
        if len(word) == 1 or inner:
            return listed
        stopped, bare = self.uses(word)
        if stopped and not bare:
            return listed or kind or ("either" if len(word) <= 5 else "")
        if bare and not stopped and not number_next:
            return ""
        if self.evidence.has("ordinary", word) and not number_next and not stopped:
            return ""
        return listed if listed and kind == listed else kind

    def opens(self, word: str) -> bool:
        """Whether a capitalised word is no proper name: the document decides first, then the corpus, then the list."""
        w = word.lower()
        small, names, telling = self.words()
        if w in small:
            return True
        if w in OPENERS:
            return True
        if not telling or w in names or self.evidence.has("proper", w):
            return False
        return self.evidence.has("small", w)

    def ends(self, m: regex.Match, quoted: bool, start: int) -> bool:
        """Whether the terminator of m ends a sentence that began at start. quoted: a closed quotation or parenthesis ends here."""
        text, term, gap, at = self.text, m["term"], m["gap"], m.end()
        if at >= len(text):
            return True
        before = text[m.start() - 1] if m.start() else " "
        nxt = text[at]
        if regex.search(rf"{_NL}[^\S\r\n]*{_NL}", gap):
            return True
        new_line = any(c in gap for c in "\r\n")
        if quoted and not (new_line and regex.match(_MARKER, text[at:at + 8])):
            body = nxt if nxt not in _OPENING else (text[at + 1 : at + 2] or " ")
            inner_stop = text[m.start()] in ".!?…。！？؟"
            return bool(gap) and inner_stop and _cased(body) and body.isupper() and text[start] in _OPENING and self.opens((_NEXT_WORD.search(text, at) or [""])[0])
        last = term[-1]
        if last in "。！？｡।॥۔؟":
            return True
        if last == "．":
            return bool(gap) or (_cjk(before) and not nxt.isdigit() and not nxt.isascii())
        if last == "|":
            return bool(gap) and "ऀ" <= before <= "ॿ"
        if "…" in term or term == "...":
            if _cjk(before) or _cjk(nxt):
                return not nxt.islower()
            return bool(gap) and not nxt.islower()
        if not gap:
            if last in "!?" and (_cjk(before) or _cjk(nxt)):
                return True
            return bool(m["emoji"])
        k = at
        while k < len(text) - 1 and text[k] in _OPENING + " ":
            k += 1
        nxt = text[k]
        if nxt.islower():
            return bool(m["emoji"])
        if last in "!?":
            return True
        if _THAI.match(before):
            return False
        if term == "..":
            return True
        found = _WORD_BEFORE.search(text, max(0, m.start() - 30), m.start())
        word = found.group() if found else ""
        if not word:
            return True
        follow = _NEXT_WORD.search(text, k)
        follow_word = follow.group() if follow else ""
        if word.isdigit():
            attached = found.start() and text[found.start() - 1] in ".,/-–:"
            if len(word) <= 4 and not attached and nxt.isdigit():
                return False
            return not (len(word) <= 2 and not attached and follow_word.lower() in GERMAN_MONTHS)
        if len(word) == 1 and word.isupper() and _cased(word):
            # an initial; with the name before it, it may end a sentence
            return len(follow_word) > 1 and word != "U" and self.opens(follow_word)
        kind = self.abbreviation(word, nxt.isdigit())
        if kind == "before":
            return False
        if kind == "either" or (len(word) == 1 and _cased(word)):
            if nxt.isdigit() or not follow_word or any(c.isdigit() for c in follow_word) or (len(follow_word) > 1 and follow_word.isupper()):
                return False
            if text[follow.end() : follow.end() + 1] == "." and (len(follow_word) == 1 or self.abbreviation(follow_word) == "before"):
                return False
            return self.opens(follow_word)
        return True


def _thai_cuts(text: str, s: int, e: int, evidence: Evidence, regions: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, start = [], s
    for m in _THAI_GAP.finditer(text, s, e):
        a = m.start()
        if any(x < a < y for x, y in regions):
            continue
        left, right = text[start:a], regex.match(r"\S*", text[m.end() : m.end() + 12]).group()
        if m["emoji"] or (_thai_opens(right, evidence) and _thai_closes(left, evidence)):
            out.append((start, a + len(m["emoji"])))
            start = m.end()
    out.append((start, e))
    return out


def _thai_key(chunk: str) -> str:
    return regex.sub(r"\d+", "9", chunk)


def _thai_opens(right: str, evidence: Evidence) -> bool:
    if right.startswith(THAI_INNER):
        return False
    return evidence.has("first", right[:6]) or not evidence.has("seen", "first")


def _thai_closes(left: str, evidence: Evidence) -> bool:
    chunk = regex.split(r"\s", left)[-1]
    if not regex.search(r"\w", left):
        return False
    if regex.search(r"[\d)”\"]$", chunk) or not _THAI.search(chunk):
        return True
    return evidence.has("last", _thai_key(chunk)[-6:]) or not evidence.has("seen", "last")


def split_sentences(text: str | None, evidence: Evidence = NO_EVIDENCE) -> list[tuple[int, int]]:
    """[start, end) of the sentence units of text."""
    if not text:
        return []
    doc = _Document(text, evidence)
    regions = [m.span() for m in _SET_IN.finditer(text)]
    thai = bool(_THAI.search(text))
    out: list[tuple[int, int]] = []
    start, r = 0, 0

    def add(a: int, b: int) -> None:
        while a < b and (text[a].isspace() or text[a] in "﻿​⁠"):
            a += 1
        while b > a and (text[b - 1].isspace() or text[b - 1] in "﻿​⁠"):
            b -= 1
        if a < b:
            out.append((a, b))

    def unit(a: int, b: int) -> None:
        if thai and _THAI.search(text, a, b):
            for x, y in _thai_cuts(text, a, b, evidence, regions):
                add(x, y)
        else:
            add(a, b)

    for m in _CANDIDATE.finditer(text):
        a = m.start()
        while r < len(regions) and regions[r][1] <= a:
            r += 1
        inside = r < len(regions) and regions[r][0] < a
        if m["term"] is None:
            if m["num"] and (not a or text[a - 1] not in ".!?…。！？:।"):
                continue
            if m["para"] or not inside:
                unit(start, a)
                start = m.end()
            continue
        closed = m.end("close")
        quoted = inside and regions[r][1] <= closed
        if inside and not quoted:
            continue
        first = start
        while first < a and (text[first].isspace() or text[first] in "﻿​"):
            first += 1
        if regex.fullmatch(r"(?:\d{1,2}|[a-z])", text[first:a]) and m["term"] == ".":
            continue  # a list marker
        if doc.ends(m, quoted, first):
            unit(start, m.end("emoji"))
            start = m.end("emoji")
    unit(start, len(text))
    return out


# ---- evidence of the corpus ----

_STOP = regex.compile(r"(?<![\p{L}\p{M}\p{N}@_+-])([\p{L}\p{M}]{1,10}(?:\.[\p{L}\p{M}]{1,3})?)\.(?:\s+|(?=[,;:)]))(.)")
_PARA = regex.compile(rf"{_NL}[^\S\r\n]*{_NL}\s*")


_SHORT = regex.compile(r"(?<![\p{L}\p{M}\p{N}@_+.’'-])([\p{L}\p{M}]{2,10})(?![\p{L}\p{M}\p{N}@_+.’'-])")
#: Keys that a partition counts before it hands them on.
COUNTED = 300_000


def _count(n: Counter, t: str) -> None:
    """Adds the counts of a text by (kind, key, seen): how often key was there, and how often in the telling place; words count once in a text, and only where capitals set them apart."""
    small = _SMALL.findall(t)
    if small and _telling(len(small), len(_CAPITAL.findall(t))):
        stops = _STOP.findall(t)
        for w, c in stops:
            n["abbr", w, c.islower() or c in ",;:)" or c.isdigit() and _cased(w[0])] += 1
        for w in set(small):
            n["word", w, True] += 1
        for w in {w.lower() for w in _INNER_CAPITAL.findall(t)}:
            n["word", w, False] += 1
        for w in set(_SHORT.findall(t)) - {w for w, _ in stops}:
            n["bare", w, True] += 1
    if _THAI.search(t):
        for p in _PARA.split(t):
            chunks = [c for c in regex.split(r"\s+", _EDGE.sub("", p)) if c]
            for k, c in enumerate(chunks):
                if _THAI.match(c):
                    n["first", c[:6], k == 0] += 1
                if _THAI.search(c):
                    n["last", _thai_key(c)[-6:], k == len(chunks) - 1] += 1


def corpus_evidence(docs: DataFrame, text_col: str = "raw_text") -> Evidence:
    """Evidence over all documents: counted inside the partitions, summed by key, and put into a filter of fixed size. The same counts decide at every size of the corpus."""

    def rows(n: Counter) -> pa.RecordBatch:
        cols = list(zip(*[(k, key, v if told else 0, v) for (k, key, told), v in n.items()])) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["kind", "key", "told", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    _count(n, t)
                if len(n) > COUNTED:
                    yield rows(n)
                    n.clear()
        yield rows(n)

    counts = docs.select(text_col).mapInArrow(run, "kind string, key string, told bigint, n bigint").groupBy("kind", "key").agg(F.sum("told").alias("told"), F.sum("n").alias("n"))
    counts = stage_table(counts, "sentence_counts")
    of = lambda kind: counts.where(F.col("kind") == kind)
    share = F.col("told") / F.col("n")
    abbr = of("abbr").join(of("bare").select("key", F.col("n").alias("bare")), "key", "left").withColumn("bare", F.coalesce("bare", F.lit(0)))
    many = F.col("bare") >= BARE_TIMES * F.col("n")
    stop = F.when((F.col("told") >= TOLD) & (share >= BEFORE_SHARE), "before").when((F.col("told") >= TOLD) & (share >= EITHER_SHARE), "either").when((F.col("bare") >= TOLD) & many & (share < EITHER_SHARE), "ordinary")
    word = F.when((F.col("told") >= 2) & (2 * F.col("told") > F.col("n")), "small").when((F.col("n") >= 2) & (10 * F.col("told") <= F.col("n")), "proper")
    edge = counts.where("kind in ('first', 'last') and told > 0 and n >= 2").where(share >= 0.02)
    parts = [abbr.select(stop.alias("kind"), F.col("key").alias("word")), of("word").select(word.alias("kind"), F.col("key").alias("word")), edge.select("kind", F.col("key").alias("word")), edge.select(F.lit("seen"), "kind").distinct()]
    return Evidence(filter_segments(reduce(DataFrame.union, parts).where("kind is not null")))


def sentences(docs: DataFrame, evidence: Evidence | None = None, id_col: str = "doc_id", text_col: str = "raw_text") -> DataFrame:
    """(id, sentence_no, start_char, end_char) of the units of all texts. Evidence is gathered over docs unless given."""
    sent = docs.sparkSession.sparkContext.broadcast(corpus_evidence(docs, text_col) if evidence is None else evidence)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, no, starts, ends = [], [], [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                spans = split_sentences(t, sent.value)
                at += [k] * len(spans)
                no += range(len(spans))
                starts += [s for s, _ in spans]
                ends += [e for _, e in spans]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int32()) for x in (no, starts, ends))], [id_col, "sentence_no", "start_char", "end_char"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, sentence_no int, start_char int, end_char int")
