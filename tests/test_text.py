import hashlib
import unicodedata

from pyspark.sql import functions as F

from spanloom.functions import checks
from spanloom.functions.text import char_ngrams, hash_bucket, hash_fold, norm_sql, normalize_exact, row_hash
from spanloom.operators import quality, segments


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_normal_forms_and_hashes(spark):
    texts = ["  A  B\n", "", None, "ﬁn ẞ", "x" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows(df.select(norm_sql(F.col("t")), normalize_exact("t"), hash_bucket(F.col("t")), hash_fold(F.col("t"), 97)))
    assert got[0][0] == "a b" and got[1][0] == "" and got[2] == (None, None, None, None)
    for t, g in zip(texts, got):
        if t is not None:
            assert g[1] == " ".join(unicodedata.normalize("NFKC", t).casefold().split())
            h = hashlib.sha256(t.encode()).hexdigest()
            assert g[2] == int(h[:8], 16) % 100 and g[3] == int(h[:16], 16) % 97


def test_row_hash_tells_null_from_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", "")], "x string, y string")
    a, b = (r[0] for r in rows(df.select(row_hash("x", "y"))))
    assert a != b


def test_ngrams(spark):
    df = spark.createDataFrame([("abcd",), ("ab",), ("",), (None,)], "t string")
    assert [r[0] for r in rows(df.select(char_ngrams(F.col("t"), 3)))] == [["abc", "bcd"], [], [], []]


VALID = [
    ("luhn", "4111 1111 1111 1111"), ("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432"), ("pesel", "44051401359"), ("turkish_id", "10000000146"),
    ("snils", "112-233-445 95"), ("israeli_id", "000000018"), ("chinese_id", "11010519491231002X"), ("aadhaar", "2341 2341 2346"),
]


def test_checksums_accept_published_values_and_reject_changed_digits(spark):
    for name, value in VALID:
        cases = [value]
        for k, c in enumerate(value):
            if c.isdigit():
                cases.append(value[:k] + str((int(c) + 1) % 10) + value[k + 1 :])
        df = spark.createDataFrame([(c,) for c in [*cases, None, ""]], "v string")
        got = [r[0] for r in rows(df.select(getattr(checks, name)(F.col("v"))))]
        assert got[0] is True, name
        assert not any(got[1 : len(cases)]), (name, [c for c, g in zip(cases[1:], got[1:]) if g])
        assert got[-2] is None and got[-1] is False


def test_addresses_and_coordinates(spark):
    df = spark.createDataFrame([("1.2.3.255",), ("1.2.3.256",), ("01.2.3.4",), (None,)], "v string")
    assert [r[0] for r in rows(df.select(checks.ipv4(F.col("v"))))] == [True, False, False, None]
    df = spark.createDataFrame([("48.85, 2.35",), ("0.0, 0.0",), ("95.1 2.2",), ("x",)], "v string")
    assert [r[0] for r in rows(df.select(checks.coordinates(F.col("v"))))] == [True, False, False, False]


def test_quality_reasons_in_order(spark):
    texts = [None, "", "short", "x" * 3000, "1" * 50, "a" * 20 + "\n" + "b" * 30, "w" * 61, "ALL CAPITAL LETTERS HERE AND NOTHING ELSE AT ALL", "A plain sentence that is long enough to pass every gate."]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[1] for r in rows(quality.with_quality(df))] == ["too_short", "too_short", "too_short", "too_long", "low_letter_ratio", "internal_line_break", "overlong_token", "all_caps", None]


def test_paragraphs_keep_offsets(spark):
    text = "  one 😀\n\n two\t\n \nthree"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    got = rows(segments.paragraphs(df, "id", "text"))
    assert {text[s:e] for _, _, s, e, _ in got} == {"one 😀", "two", "three"} == {t for *_, t in got}


def test_segments_rebuild_the_text():
    text = "One. Two is here.\nThree and more words without an end " * 7
    for most in (5, 20, 60):
        cuts = segments.cut_segments(text, [(3, 30), (100, 108)], most)
        assert "".join(text[a:b] for a, b in cuts) == text
        assert not any(a < e < b for a, b in [(3, 30), (100, 108)] for _, e in cuts[:-1])
    assert segments.cut_segments("", [], 5) == []


def test_token_spans(spark):
    tokens = [("d", 0, "Ada", "B-P"), ("d", 1, "Mensah", "I-P"), ("d", 2, "met", "O"), ("d", 3, "Bo", "I-P"), ("d", 4, "Ng", "B-P")]
    df = spark.createDataFrame(tokens, "doc string, no int, token string, tag string")
    got = sorted((r["s"], r["e"]) for r in segments.token_spans(df).collect())
    assert got == [(0, 10), (15, 17), (18, 20)]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id int, text string")
    assert rows(segments.paragraphs(df, "id", "text")) == [] and rows(quality.with_quality(df)) == []
