"""P4: personal information in free text, and its replacement by typed placeholders.

Addresses of mail, telephone numbers, numbers issued to persons and street addresses follow formats, with words beside them
as evidence. Names of persons are found by a lexicon that the corpus itself gives: the words after forms of address, titles
and contact labels, counted over all documents; sequences of such words are names anywhere. Numbers in a placeholder are
pseudonyms by a keyed Feistel permutation within their format (module ``pseudonyms``), so that equal values stay linked
across documents without showing the value; other values are linked by a keyed digest.

Defined results: null texts have no spans and stay null; spans are half-open counts of code points and never overlap
(where two kinds compete, the order is email, id_number, street_address, phone, person_name).
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
from .pseudonyms import Pseudonyms
from .wordfilter import WordFilter, filter_segments

#: Telling places that a word of a name needs, at every size of the corpus.
LEAST = 2

TYPES = ("email", "id_number", "street_address", "phone", "person_name")

# One character for one: full-width forms, other digits, blanks and dashes become plain, so offsets stay.
_PLAIN = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x0660 + d: 48 + d for d in range(10)} | {0x06F0 + d: 48 + d for d in range(10)} | {0x0966 + d: 48 + d for d in range(10)}
_PLAIN |= dict.fromkeys([0xA0, *range(0x2000, 0x200B), 0x202F, 0x3000, 9], 32) | dict.fromkeys([0x2010, 0x2011, 0x2012, 0x2013, 0x2212], 45) | {0x2019: 39}


def plain(text: str) -> str:
    return text if text.isascii() and "\t" not in text else text.translate(_PLAIN)


S = r"\s{0,3}"
_EMAIL = regex.compile(
    rf"(?<![A-Za-z0-9._+-])[A-Za-z0-9][A-Za-z0-9._+-]*(?:"
    rf"(?:@|\s@\s)[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,12}}(?![A-Za-z0-9])"
    rf"|{S}[\[(]{S}at{S}[\])]{S}[A-Za-z0-9-]+(?:(?:\.|{S}[\[(]{S}dot{S}[\])]{S})[A-Za-z0-9-]+)*(?:\.|{S}[\[(]{S}dot{S}[\])]{S})[A-Za-z]{{2,12}}(?![A-Za-z0-9])"
    rf"|\s{{1,3}}at\s{{1,3}}[A-Za-z0-9-]+(?:\s{{1,3}}dot\s{{1,3}}[A-Za-z0-9-]+)*\s{{1,3}}dot\s{{1,3}}[A-Za-z]{{2,12}}(?![A-Za-z0-9]))",
    regex.I,
)
_EMAIL_SIGN = regex.compile(r"@|[\[(]\s?at\s?[\])]|\sat\s+\S+\s+dot\s", regex.I)

# Words before numbers that are issued to persons.
_ID_CUE = (
    r"social security (?:number|no)|national insurance (?:number|no)|passport (?:number|no)|identity card (?:number|no)|tax(?:payer)? (?:id|identification)(?: number)?|national id|ssn"
    r"|steuer-?\s?(?:identifikationsnummer|id(?:nr)?)|ausweisnummer|reisepass(?:nummer)?|sozialversicherungsnummer|personalausweis(?:nummer)?"
    r"|num[ée]ro de s[ée]curit[ée] sociale|num[ée]ro d[’']identit[ée]|passeport n°?|carte d[’']identit[ée]"
    r"|n[úu]mero de (?:identidad|contribuinte|identifica[cç][aã]o|pasaporte|passaporte)|pasaporte n[.;]?º?|passaporte n[.;]?º?|\bdni\b|\bnie\b|\bnif\b|\bcpf\b"
    r"|codice fiscale|carta d[’']identità|passaporto n?|burgerservicenummer|\bbsn\b|paspoort(?:nummer)?|\bpesel\b|paszport(?:u)?|numer dowodu"
    r"|снилс|паспорт\w*|\bинн\b|رقم الهوية(?: الوطنية)?|جواز السفر|आधार(?: संख्या)?|पासपोर्ट|เลขประจำตัวประชาชน|หนังสือเดินทาง|個人番号|旅券番号|身份证号码?|护照号码?|주민등록번호|여권번호"
)
_DIGITS = r"\d(?:[ .\-/]{0,3}\d)*"
_ID = regex.compile(
    rf"(?:{_ID_CUE})[^\d]{{0,26}}?(?<![\w-])(?P<v>[a-z]{{6}}\d\d[a-z]\d\d[a-z]\d{{3}}[a-z]|[a-z]{{2}}(?:{S}\d\d){{3}}{S}[a-z]|(?:[a-z]{{1,3}}-?)?{_DIGITS}(?:-?[a-z])?)(?!\w)(?<=[\w])",
    regex.I,
)
_ID_JOINED = regex.compile(rf"(?:個人番号|旅券番号|身份证号码?|护照号码?|주민등록번호|여권번호|เลขประจำตัวประชาชน)\D{{0,6}}?(?P<v>{_DIGITS}[Xx]?)")

# Words beside telephone numbers.
_PHONE_CUE = regex.compile(
    r"tel|tél|phone|fax|call|mobil|\bm:|☎|☏|📞|reach|answer|anruf|erreichb|ruf|appel|joign|llamad|atiende|chiamat|rispond|chamad|atend|bereik|numer|odbier|звон|номер|тел|هاتف|الاتصال|الرقم|फ़ोन|फोन|उपलब्ध|หมายเลข|สาย|โทร|電話|正午|电话|来电|拨打|接到|전화|연락",
    regex.I,
)
_EXT = r"(?:,?\s{0,2}(?:ext\.?|extension|x|доб\.?|poste|durchwahl|int\.?|anexo|ramal)\s{0,2}\d{1,5})?"
_PHONE = regex.compile(
    r"(?<![A-Za-z0-9/.+-])(?:"
    r"(?P<far>(?:\+\d{1,3}|00[1-9]\d{0,2})(?:[ .\-/]{0,3}\(0\))?(?:[ .\-/]{0,3}\(?\d{1,8}\)?){1,6})"
    r"|(?P<paren>\(0?\d{2,4}\)[ .\-/]{0,3}\d{3,6}(?:[ .\-/]{1,3}\d{2,4}){0,3})"
    r"|(?P<us>(?:1[-. ])?\d{3}[-.]\d{3}[-.]\d{4})"
    r"|(?P<zero>0(?!000)\d{0,4}(?:[ .\-/]{1,3}\d{2,8}){1,5})"
    r"|(?P<bare>\d{9,11}))" + _EXT + r"(?![\d/-]|\.\d|[A-Za-z]\w)",
    regex.I,
)
_CASE_NUMBER = regex.compile(r"\d{3}/\d{6}-\d\d|\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|0000.*|\d{4}-\d\d-\d\d")

W = r"[\p{L}\p{M}][\p{L}\p{M}'’-]*"
C = r"\s{0,2}[,،、]\s{0,3}"
_STREETS = [
    (regex.compile(rf"(?:(?:flat|apt\.?|unit|suite)\s+\d+[a-z]?{C})?(?<![\w-])\d+[a-z]?\s{{1,3}}(?:{W}\s{{1,3}}){{1,2}}?(?:lane|avenue|road|street|drive|square|close|way|court|boulevard|crescent|terrace|(?:st|ave|rd|blvd|dr)\s?[.;])(?!\w)(?:{C}(?P<town>{W})(?:\s{{1,3}}\d{{5}}(?!\d))?)?", regex.I), regex.compile(r"\d\w?\s+\w+\s+\w*\s*(?:lane|aven|road|st|dri|squ|clo|way|cou|bou|cre|ter|ave|rd|blvd|dr)", regex.I)),
    (regex.compile(rf"(?<![\p{{L}}\p{{M}}])(?:am\s{{1,3}}{W}weg|{W}(?:stra(?:ß|ss)e|str\s?[.;]|weg|platz|allee|gasse|straat|laan|plein|gracht|kade))\s{{1,3}}\d+\s?(?:-[ivx]+|[a-z](?!\w))?(?:{C}\d{{4,5}}(?:\s?[a-z]{{2}}(?=\s))?\s{{1,3}}{W})?", regex.I), regex.compile(r"(?:stra(?:ß|ss|at)|str\s?[.;]|weg|platz|allee|gasse|laan|plein|gracht|kade)", regex.I)),
    (regex.compile(rf"(?<![\w-])\d+(?:\s?(?:bis|ter))?{C}(?:rue|av\s?[.;]|avenue|place|boulevard|bd\s?[.;]?|impasse|chemin|quai|allée)(?:\s+d(?:e la|e|u|es))?\s{{1,3}}{W}(?:{C}\d{{5}}\s{{1,3}}{W})?", regex.I), regex.compile(r"\b(?:rue|av\s?[.;]|avenue|place|boulevard|bd|impasse|chemin|quai|allée)\s", regex.I)),
    (regex.compile(rf"(?<![\p{{L}}\p{{M}}])(?:avda\s?[.;]|av\s?[.;]|avenida|plaza|calle|c/|paseo|piazza|via|viale|v\s?[.;]\s?le|corso|rua|r\s?[.;]|travessa|praça|largo)\s{{1,3}}{W}(?:\s{{1,3}}{W})?{C}\d+(?:\s?[a-z](?!\w))?(?:{C}\d{{5}}(?:-\d{{3}})?\s{{1,3}}{W})?", regex.I), regex.compile(r"\b(?:avda|av|avenida|plaza|calle|paseo|piazza|via|viale|v\s?[.;]\s?le|corso|rua|travessa|praça|largo)\b", regex.I)),
    (regex.compile(rf"(?<![\p{{L}}\p{{M}}])(?:ul|al|pl|os)\s?[.;]\s{{0,3}}{W}(?:\s{{1,3}}{W})?\s{{1,3}}\d+[a-z]?(?:\s?/\s?\d+|\s{{1,3}}m\s?[.;]\s{{0,2}}\d+)?(?:{C}\d\d-\d{{3}}\s{{1,3}}{W})?", regex.I), regex.compile(r"\b(?:ul|al|pl|os)\s?[.;]", regex.I)),
    (regex.compile(rf"(?<![\p{{L}}\p{{M}}])(?:ул|пер|пр|просп|наб|пл)\s?[.;]\s{{0,3}}{W}{C}д\s?[.;]\s{{0,3}}\d+(?:\s?[а-я](?!\w))?(?:{C}кв\s?[.;]\s{{0,3}}\d+)?(?:{C}(?:\d{{6}}\s{{1,3}})?г\s?[.;]\s{{0,3}}{W})?", regex.I), regex.compile(r"д\s?[.;]\s*\d", regex.I)),
    (regex.compile(rf"شارع\s{{1,3}}{W}\s{{1,3}}\d+(?:{C}{W})?"), regex.compile("شارع")),
    (regex.compile(rf"(?<![\w-])\d+{C}{W}\s{{1,3}}(?:मार्ग|सड़क|गली)(?:{C}{W}\s{{1,3}}\d{{6}})?"), regex.compile("मार्ग|सड़क|गली")),
    (regex.compile(r"(?<!\d)\d+\s{1,3}(?:ถนน|ซอย)\p{Thai}+(?:\s{1,3}\p{Thai}+\s{1,3}\d{5})?"), regex.compile("ถนน|ซอย")),
    (regex.compile(r"\p{Han}{2,3}\s?市\s?[\p{Han}\s]{1,6}?町\s?\d+\s?-\s?\d+"), regex.compile("町")),
    (regex.compile(r"\p{Han}\s?\p{Han}\s?市\s?\p{Han}\s?\p{Han}\s?\p{Han}?\s?路\s?\d+\s?号"), regex.compile("路")),
    (regex.compile(r"\p{Hangul}+시\s{1,3}\p{Hangul}+(?:로|길)\s{1,3}\d+(?:-\d+)?"), regex.compile("[로길]")),
]

# What stands before names. Forms of address, titles, labels of forms, and words around names in other scripts.
_GREETING = r"(?:dear|hello|guten tag|sehr geehrte[rs]?(?: frau| herr)?|hallo|beste|geachte|bonjour|cher|chère|estimad[oa](?:/[oa])?|querid[oa]|gentile|egregi[oa]|car[oa](?:/[oa])?|prezad[oa](?:/[oa])?|szanown[ay](?:/[ay])?(?: pan[iu]?)?|здравствуйте,|уважаем\w+|السيد|عزيزي|تحية طيبة،?|مرحب\w+،?|आदरणीय|प्रिय|नमस्ते,?|เรียน(?:คุณ| คุณ)?)"
_TITLE = r"(?:prof\.? dr|dr|prof|mr|mrs|ms|miss|hr|fr|herr|frau|mme|mlle|sra?|sig(?:\.?ra)?|dott(?:\.ssa)?|mevr|dhr|гр|проф|д-р|col|capt|gen|lt|sgt|д|د|डॉ|นพ|พญ)"
_LABEL = r"(?:contact(?: person)?|name|applicant|client|kontakt|ansprechpartner(?:in)?|person(?:ne)?|nom|contacto|nombre|persona|contatto|nominativo|nome|contato|contactpersoon|naam|osoba|kontaktowa|контакт|лицо|имя|для связи|للتواصل|الاسم|संपर्क|नाम|ติดต่อ|ชื่อ|signed by|unterschrieben von|signé par|firmado por|firmato da|assinado por|ondertekend door|podpisano|подписано|подписал[аи]?)"
_PART = r"(?:van der|van de|van|von der|von|zu|de la|del|della|de los|de|da|dos|du|di)"
_NW = r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)?"
_WHOLE = rf"(?:{_NW}|\p{{L}}\.)(?:[ -]{_PART})?(?:,? {_NW}\.?|-{_NW}){{1,3}}"
_STRONG = regex.compile(rf"(?:^|(?<=[\n|;{{\"]))[ \"]*(?:{_GREETING}|\"?{_LABEL}\"?\s?:)[ \"]*(?P<n>(?:{_NW}|\p{{Lu}}\.)(?:,? {_NW}\.?|-{_NW}){{1,4}})\"?\s?(?=[,:!;|\n\"]|$)", regex.I | regex.M)
_TITLED = regex.compile(rf"(?<![\p{{L}}\p{{M}}]){_TITLE}\. (?P<n>\p{{L}}[\p{{L}}\p{{M}}]+ \p{{L}}[\p{{L}}\p{{M}}-]+)", regex.I)
_SURNAME_FIRST = regex.compile(rf"(?<![\p{{L}}\p{{M}}]){_TITLE}\. (?P<n>\p{{L}}[\p{{L}}\p{{M}}]{{2,}} \p{{Lu}}\.)", regex.I)
_SIGNED = regex.compile(rf"(?:signed by|unterschrieben von|signé par|firmado por|firmato da|assinado por|ondertekend door|podpisano:|contacto:|contact ?:|contatto:|kontakt:|ansprechpartner:|контакт:) (?P<n>{_NW} {_NW})(?! \p{{Lu}}|-)", regex.I)
_JA = regex.compile(r"(?<![\p{Han}\p{Hiragana}])(?P<f>\p{Han}{2,4}) (?P<g>[\p{Han}]{2,3})(?=さん|博士|様|氏)|(?:連絡先：|連絡先:)(?P<f2>\p{Han}{2,4}) (?P<g2>\p{Han}{2,3})(?=、)|(?<![\p{Han}])(?P<w>\p{Han}{4,7})(?=さん|博士|様)")
_ZH = regex.compile(r"(?:联系人：|联系人:|收件人是|尊敬的|您好，|您好)(?P<w>\p{Han}{3,4})(?=[，。：:！,\s])|(?:^|(?<=[。！，\n•-]\s?))(?P<w2>\p{Han}{3,4}?)(?=先生|女士|医生|教授|博士|老师|同志|还?住在)")
_KO = regex.compile(r"(?<!\p{Hangul})(?P<w>\p{Hangul}{3,5})(?= 님| 박사|[,!:]\n)")
_TH = regex.compile(r"(?:คุณ|นพ\.|พญ\.)\s?(?P<g>\p{Thai}{2,10})\s(?P<f>\p{Thai}{3,12})(?=\s)")
_COMMON = frozenset("the of and for to in on at by with from de la le les el los las der die das und von zu den dem van het een en da do dos das di del della il lo un una i w z na o a e y et est ist is was no not".split())


class Lexicon(WordFilter):
    """Words of names by class: g and s, given names and surnames in scripts with blanks; ja-f, ja-g, zh-f, zh-g, ko-f, ko-g,
    th-f, th-g, family and given names in the others; town, words beside postcodes."""

    def kind(self, word: str) -> str:
        """g, s or nothing for a word in small letters."""
        return "g" if self.has("g", word) else "s" if self.has("s", word) else ""


_TOWN = regex.compile(rf"(?:(?:lane|avenue|road|street|(?:st|ave|rd)\s?[.;]){C}(?P<a>\p{{L}}{{4,}})\s{{1,3}}\d{{5}}(?!\d)|,\s{{1,3}}(?:\d{{5}}|\d{{4}}\s?[a-z]{{2}}|\d\d-\d{{3}})\s{{1,3}}(?P<b>\p{{L}}{{4,}}))", regex.I)


def name_counts(texts: list[str | None]) -> Counter:
    n: Counter = Counter()
    for raw in texts:
        if not raw:
            continue
        t = plain(raw)
        for m in [*_STRONG.finditer(t), *_TITLED.finditer(t), *_SIGNED.finditer(t), *_SURNAME_FIRST.finditer(t)]:
            name = m["n"].rstrip(".").strip()
            words = [w for w in regex.findall(rf"{_NW}", name.lower()) if len(w) > 1 and w not in _COMMON]
            if len(words) < 2 and not ("." in name and words):
                continue
            comma = "," in name
            upper = regex.match(r"\p{Lu}{3,}", name) and not name.isupper()
            first, rest = (words[-1:], words[:-1]) if comma or upper else (words[:-1], words[-1:])
            if len(words) == 1:
                first, rest = [], words
            for w in first:
                n["g", w] += 1
            for w in rest:
                n["s", w] += 1
        for m in _TOWN.finditer(t):
            n["town", (m["a"] or m["b"]).lower()] += 1
        for m in _JA.finditer(t):
            if m["f"] or m["f2"]:
                n["ja-f", m["f"] or m["f2"]] += 1
                n["ja-g", m["g"] or m["g2"]] += 1
            elif m["w"]:
                n["ja-w", m["w"]] += 1
        for m in _ZH.finditer(t):
            n["zh-w", m["w"] or m["w2"]] += 1
        for m in _KO.finditer(t):
            n["ko-w", m["w"]] += 1
        for m in _TH.finditer(t):
            n["th-g", m["g"]] += 1
            n["th-f", m["f"]] += 1
    return n


def name_words(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """(kind, word) of the lexicon from counts (kind, word, n) of the telling places, by joins and sums.

    A word needs ``least`` telling places, at every size of the corpus. Names written without a blank (Chinese, Korean) are
    cut after their first character: a family name stands before several given names, a given name after several families;
    Japanese ones where a known given name ends them.
    """
    of = lambda kind: counts.where(F.col("kind") == kind)
    sides = counts.where("kind in ('g', 's')").groupBy("word").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in "gs"])
    # two letters are too common to be a surname by themselves
    plain = sides.where((F.col("g") + F.col("s") >= least) & ((F.length("word") > 2) | (F.col("g") > F.col("s")))).select(F.when(F.col("g") > F.col("s"), "g").otherwise("s").alias("kind"), "word")
    parts = [plain, counts.where("kind in ('th-f', 'th-g', 'ja-f', 'ja-g', 'town')").where(F.col("n") >= least).select("kind", "word")]
    whole = of("ja-w").where(F.col("n") >= least).select("word", F.explode(F.array(F.lit(2), F.lit(3))).alias("k")).where(F.length("word") - F.col("k") >= 2)
    cut = whole.select(F.expr("left(word, length(word) - k)").alias("f"), F.expr("right(word, k)").alias("word")).where(F.length("f") <= 3)
    parts.append(cut.join(of("ja-g").where(F.col("n") >= least).select("word"), "word").select(F.lit("ja-f").alias("kind"), F.col("f").alias("word")))
    for lang in ("zh", "ko"):
        w = of(f"{lang}-w").select(F.substring("word", 1, 1).alias("head"), F.expr("substring(word, 2)").alias("tail"), "n")
        shared = w.groupBy("tail").agg(F.sum("n").alias("n"), F.count_distinct("head").alias("heads")).where((F.col("n") >= least) & (F.col("heads") >= 2)).select("tail")
        pairs = w.join(shared, "tail").select("head", "tail")
        family = pairs.groupBy("head").agg(F.count_distinct("tail").alias("tails")).where("tails >= 2").select("head")
        parts.append(family.select(F.lit(f"{lang}-f").alias("kind"), F.col("head").alias("word")))
        parts.append(pairs.join(family, "head").select(F.lit(f"{lang}-g").alias("kind"), F.col("tail").alias("word")))
    return reduce(DataFrame.union, parts).distinct()


def lexicon_of(words: DataFrame) -> Lexicon:
    """The filter of (kind, word)."""
    return Lexicon(filter_segments(words))


def learn_names(docs: DataFrame, text_col: str = "raw_text") -> Lexicon:
    """The lexicon of all documents; counted inside the partitions, summed by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            n += name_counts(b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in n], pa.string()), pa.array([w for _, w in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["kind", "word", "n"])

    summed = docs.select(text_col).mapInArrow(run, "kind string, word string, n bigint").groupBy("kind", "word").agg(F.sum("n").alias("n"))
    return lexicon_of(name_words(stage_table(summed, "name_counts")))


_TOKEN = regex.compile(r"[\p{L}\p{M}]+")


_HAN_RUN = regex.compile(r"\p{Han}+(?:\s\p{Han}+)*")
_HANGUL_RUN = regex.compile(r"\p{Hangul}+")
_THAI_GAP = regex.compile(r"(?<=\p{Thai})\s{1,3}(?=\p{Thai})")
_DENSE_SCRIPT = regex.compile(r"[\p{Han}\p{Hangul}\p{Thai}]")


class Scanner:
    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def _given(self, t: str, i: int, size: int, end: int, lang: str, givens: tuple[int, ...]) -> int:
        """End of the name whose family name has the given size and begins at i; 0 if there is none."""
        if i + size >= end or not self.lexicon.has(f"{lang}-f", t[i : i + size]):
            return 0
        j = i + size + t[i + size].isspace()
        return next((j + g for g in givens if j + g <= end and self.lexicon.has(f"{lang}-g", t[j : j + g])), 0)

    def _dense(self, t: str) -> Iterator[tuple[int, int]]:
        """Names in scripts without blanks between words: a family name and a given name that the lexicon knows, the longest parts first."""
        has = self.lexicon.has
        for lang, families, givens in (("ja", (4, 3, 2), (3, 2)), ("zh", (1,), (3, 2))):
            for m in _HAN_RUN.finditer(t):
                i, end = m.span()
                while i < end:
                    stop = next((x for x in (self._given(t, i, f, end, lang, givens) for f in families) if x), 0)
                    if stop:
                        yield i, stop
                    i = stop or i + 1
        for m in _HANGUL_RUN.finditer(t):
            s, e = m.span()
            for n in (4, 3, 2):
                if e - s > n and has("ko-f", t[s]) and has("ko-g", t[s + 1 : s + 1 + n]):
                    yield s, s + 1 + n
                    break
        for m in _THAI_GAP.finditer(t):
            a = next((n for n in range(min(10, m.start()), 1, -1) if has("th-g", t[m.start() - n : m.start()])), 0)
            b = a and next((n for n in range(12, 2, -1) if has("th-f", t[m.end() : m.end() + n])), 0)
            if b:
                yield m.start() - a, m.end() + b

    def scan(self, raw: str | None) -> list[tuple[int, int, str]]:
        """(start, end, type) of the spans of a text, in order."""
        if not raw:
            return []
        t = plain(raw)
        taken: list[tuple[int, int, str]] = []
        held = bytearray(len(t))

        def add(s: int, e: int, kind: str) -> None:
            if s < e and not any(held[s:e]):
                taken.append((s, e, kind))
                held[s:e] = b"\x01" * (e - s)

        if _EMAIL_SIGN.search(t):
            for m in _EMAIL.finditer(t):
                add(m.start(), m.end(), "email")
        digits = any(c.isdigit() for c in t)
        if digits:
            for p in (_ID, _ID_JOINED):
                for m in p.finditer(t):
                    if sum(c.isdigit() for c in m["v"]) >= 5:
                        add(*m.span("v"), "id_number")
            for pattern, sign in _STREETS:
                if sign.search(t):
                    for m in pattern.finditer(t):
                        s, e = m.span()
                        if "town" in m.groupdict() and m["town"] and not self._town(t, m):
                            e = m.start("town")
                            while e > s and t[e - 1] in ", \n\r،、":
                                e -= 1
                        add(s, e, "street_address")
            for m in _PHONE.finditer(t):
                if self._phone(t, m):
                    add(*m.span(), "phone")
        for s, e in list(self._names(t, held)):
            add(s, e, "person_name")
        return sorted(taken)

    def _town(self, t: str, m: regex.Match) -> bool:
        """Whether the word after a street is its town: before a postcode, known as one, or with a capital and known neither as a word of names nor as a small word."""
        town = m["town"].lower()
        if self.lexicon.has("town", town) or regex.search(r"\d{5}$", m.group()):
            return True
        return (m["town"][0].isupper() or m["town"][1:].isupper()) and not self.lexicon.kind(town) and town not in ("so", "and", "last", "but", "for", "the")

    @staticmethod
    def _phone(t: str, m: regex.Match) -> bool:
        v = m.group()
        n = sum(c.isdigit() for c in v)
        if _CASE_NUMBER.fullmatch(v):
            return False
        if m["far"]:
            return 9 <= n <= 16
        if m["paren"]:
            return 8 <= n <= 12
        if m["us"]:
            return 10 <= n <= 15
        beside = _PHONE_CUE.search(t, max(0, m.start() - 32), m.start()) or _PHONE_CUE.search(t, m.end(), m.end() + 24)
        if m["zero"]:
            return 8 <= n <= 12
        line = t[t.rfind("\n", 0, m.start()) + 1 : m.start()]
        alone = regex.fullmatch(r"[ \-•*]*(?:[TMFP][.:]? ?|☎ ?)?", line, regex.I) is not None and (m.end() >= len(t) or t[m.end()] in "\r\n ")
        return bool(beside or alone) and not v.startswith("0000")

    def _names(self, t: str, held: bytearray) -> Iterator[tuple[int, int]]:
        if _DENSE_SCRIPT.search(t):
            yield from self._dense(t)
        kind_of = self.lexicon.kind
        toks = [(m.start(), m.end()) for m in _TOKEN.finditer(t)]
        kinds = [kind_of(t[s:e].lower()) for s, e in toks]
        for k, (s, e) in enumerate(toks):  # parts of addresses of mail are no names
            if kinds[k] and any(held[s:e]):
                kinds[k] = ""
        k, n = 0, len(toks)
        while k < n:
            if not kinds[k]:
                k += 1
                continue
            a, b = self._extend(t, toks, kinds, k)
            if a is not None:
                yield self._edges(t, toks, kinds, a, b)
            k = b + 1

    def _extend(self, t: str, toks: list[tuple[int, int]], kinds: list[str], k: int) -> tuple[int | None, int]:
        """First and last token of the name around token k, as far as it goes; null first if it is none."""
        n, b, given, surname, comma = len(toks), k, kinds[k] == "g", kinds[k] == "s", False
        initials_after = 0
        while b + 1 < n:
            gap = t[toks[b][1] : toks[b + 1][0]]
            nxt, kind = t[toks[b + 1][0] : toks[b + 1][1]], kinds[b + 1]
            if len(gap) > 4:
                break
            if kind and (gap == "-" or not gap.strip(" \r\n") and "\n\n" not in gap):
                if gap.strip(" ") and ("\n" in gap) and surname and given:
                    break
                if gap != "-" and kind == "g" and given and surname:
                    break
                if gap != "-" and kind == "s" and surname and not given:
                    break
            elif not kind and gap in (" ", "\n") and given and not surname and b + 2 < n and kinds[b + 2] == "s" and t[toks[b + 1][1] : toks[b + 2][0]] == "-":
                b += 2
                surname = True
                continue
            elif kind == "g" and surname and not given and not comma and regex.fullmatch(r"\s?,\s{1,2}", gap):
                comma = True
            elif len(nxt) == 1 and surname and not given and regex.fullmatch(r"\s?,?\s{1,2}|\.\s?", gap) and t[toks[b + 1][1] : toks[b + 1][1] + 1] == "." and _cyrillic(nxt):
                initials_after += 1
                b += 1
                continue
            elif gap in (" ", "\n") and given and not surname and regex.match(rf"{_PART}\s", t[toks[b + 1][0] : toks[b + 1][0] + 10], regex.I):
                step = 1
                while step <= 3 and b + 1 + step < n and not kinds[b + 1 + step] and toks[b + 1 + step][0] - toks[b + step][1] <= 1:
                    step += 1
                if b + 1 + step < n and kinds[b + 1 + step] == "s":
                    b += 1 + step
                    surname = True
                    continue
                break
            elif gap in (" ", "\n") and given and not surname and nxt.lower() in ("o", "mc", "mac", "d") and b + 2 < n and kinds[b + 2] and t[toks[b + 1][1] : toks[b + 2][0]] in ("'", "’"):
                b += 2
                surname = True
                continue
            elif gap in (" ", "\n") and given and not surname and nxt[:2].lower() == "mc" and self.lexicon.kind(nxt[2:].lower()):
                surname = True
                b += 1
                continue
            else:
                break
            b += 1
            given, surname = given or kind == "g", surname or kind == "s"
        a, initials = k, 0
        # initials, particles and O' before
        while a > 0:
            gap = t[toks[a - 1][1] : toks[a][0]]
            prev = t[toks[a - 1][0] : toks[a - 1][1]]
            if len(prev) == 1 and gap in (". ", ".", ".\n", ". \n") and (prev.isupper() or not t[toks[k][0]].isupper()) and initials < 2:
                initials += 1
                a -= 1
            elif gap in ("'", "’") and prev.lower() in ("o", "d"):
                a -= 1
            elif not initials and kinds[k] == "s" and a == k and a > 1 and gap in (" ", "\n") and (t[toks[a - 2][0] : toks[a - 2][1]] + " " + prev).lower() in ("van der", "de la", "von der", "van de", "de los"):
                a -= 2
            elif gap == "-" and a == k and not kinds[a - 1] and prev[0].isupper() == t[toks[k][0]].isupper():
                a -= 1
            else:
                break
        whole = (given and surname) or (surname and (initials or initials_after)) or (given and initials and b > k)
        return (a if whole else None), b

    def _edges(self, t: str, toks: list[tuple[int, int]], kinds: list[str], a: int, b: int) -> tuple[int, int]:
        s, e = toks[a][0], toks[b][1]
        if len(t[toks[b][0] : e]) == 1 and t[e : e + 1] == ".":
            e += 1
        # "M." in French and "P." in Polish before a whole name are forms of address
        first = t[toks[a][0] : toks[a][1]].upper()
        if first in _SMALL_WORDS and len(t[s:e].split()) > 2 and (first == "P" or toks[a + 1][1] - toks[a + 1][0] > 1) and _SMALL_WORDS[first].search(t, max(0, s - 80), e + 80):
            s = toks[a + 1][0]
        return s, e


#: Small words of the languages in which a single letter before a whole name is a form of address (fixed values).
_SMALL_WORDS = {
    "M": regex.compile(r"(?<!\p{L})(?:est|été|les|des|pour|dans|chez|sur|aux|qui|n[’']a)(?!\p{L})", regex.I),
    "P": regex.compile(r"(?<!\p{L})(?:się|jest|nie|przy|dla|oraz|że|nr|w|z|dnia|który|która)(?!\p{L})", regex.I),
}


def _cyrillic(c: str) -> bool:
    return "Ѐ" <= c <= "ӿ"


# ---- spans of tables ----

_SPAN = "array<struct<start_char:int,end_char:int,pii_type:string>>"
_SPAN_ARROW = pa.list_(pa.struct([("start_char", pa.int32()), ("end_char", pa.int32()), ("pii_type", pa.string())]))


def find_spans(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "raw_text") -> DataFrame:
    """(id, spans) of every row; no spans for null texts."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sent.value)
        for b in batches:
            spans = [[{"start_char": s, "end_char": e, "pii_type": k} for s, e, k in scanner.scan(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, _SPAN_ARROW)], [id_col, "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, spans {_SPAN}")


def window_spans(windows: DataFrame, docs: DataFrame, doc_spans: DataFrame, lexicon: Lexicon, located: DataFrame) -> DataFrame:
    """(window_id, start_char, end_char, pii_type): what lies wholly in a window, with offsets in its text.

    Located windows take the spans of their document; windows that aren't found in it are scanned by themselves.
    """
    w = windows.where("text is not null").select("window_id", "doc_id", F.length("text").alias("size"), "text").join(located, "window_id", "left")
    held = doc_spans.select("doc_id", F.explode("spans").alias("s"))
    a = w.where("base is not null").join(held, "doc_id").select("window_id", (F.col("s.start_char") - F.col("base")).alias("start_char"), (F.col("s.end_char") - F.col("base")).alias("end_char"), "s.pii_type", "size").where("start_char >= 0 and end_char <= size")
    alone = find_spans(w.where("base is null"), lexicon, "window_id", "text").select("window_id", F.explode("spans").alias("s")).select("window_id", "s.*")
    return a.drop("size").unionByName(alone)


# ---- redaction ----


def _replace(text: str | None, spans: list[tuple[int, int, str]], pseudonyms: Pseudonyms) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for s, e, kind in spans:
        out += [text[at:s], pseudonyms.placeholder(text[s:e], kind)]
        at = e
    return "".join(out) + text[at:]


def redact(rows: DataFrame, key: bytes, id_col: str, text_col: str, spans_col: str = "spans") -> DataFrame:
    """(id, redacted, n_spans): texts with a typed placeholder for each of their spans; the rest of the text as it was.

    Null texts stay null with 0 spans. The key comes from its owner and has no default; equal values have equal
    placeholders under one key.
    """
    sent = rows.sparkSession.sparkContext.broadcast(key)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pseudonyms = Pseudonyms(sent.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            spans = [sorted((x["start_char"], x["end_char"], x["pii_type"]) for x in r or []) for r in b.column(2).to_pylist()]
            new = [_replace(t, x, pseudonyms) for t, x in zip(texts, spans)]
            counts = [len(x) if t is not None else 0 for t, x in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, pa.string()), pa.array(counts, pa.int32())], [id_col, "redacted", "n_spans"])

    return rows.select(id_col, text_col, spans_col).mapInArrow(run, f"`{id_col}` {kind}, redacted string, n_spans int")
