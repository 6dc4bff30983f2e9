"""Queries on texts: normal forms, quality, hashes, paragraphs, n-grams, identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks
from ..functions.text import char_ngrams, hash_bucket, hash_fold, language_tag, letter_ratio, norm_sql, normalize_exact, row_hash, script_profile, shape_ascii, text_id
from ..operators import dedup, quality, segments
from ..registry import query

NORM = r"trim(regexp_replace(lower({c}), '[\s\p{{Z}}]+', ' ', 'g'))"
CUES = {"matter": ["file", "dossier", "expediente", "vorgang", "matter"], "sign": ["reference", "order", "number", "nummer"]}


@query(f"""SELECT sha256({NORM.format(c="text")}) AS key, min(doc_id) AS keep, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def norm_exact_dup_groups(t):
    return dedup.exact_groups(t("documents"), "text", "doc_id").where("n > 1")


@query(f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY sha256({NORM.format(c="text")}) ORDER BY doc_id) AS r FROM documents)
SELECT lang, source, count(*) AS kept FROM d WHERE r = 1 OR text IS NULL GROUP BY lang, source""")
def exact_dedup_keep_first(t):
    return dedup.keep_first(t("documents"), "text", "doc_id").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("kept"))


@query(f"""WITH e AS (SELECT DISTINCT sha256({NORM.format(c="text")}) AS k FROM eval_items),
d AS (SELECT *, sha256({NORM.format(c="text")}) AS k FROM documents),
c AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS r FROM d WHERE text IS NULL OR k NOT IN (SELECT k FROM e))
SELECT lang, source, count(*) AS kept FROM c WHERE r = 1 OR text IS NULL GROUP BY lang, source""")
def decontaminate_exact(t):
    clean = dedup.without_texts(t("documents"), t("eval_items"), "text", "text")
    return dedup.keep_first(clean, "text", "doc_id").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("kept"))


@query(r"""WITH s AS (SELECT lang, regexp_replace(regexp_replace(text, '^[\s\p{Z}]+', ''), '[\s\p{Z}]+$', '') AS text FROM documents) SELECT coalesce(CASE WHEN text IS NULL OR length(text) < 40 THEN 'too_short' WHEN length(text) > 2000 THEN 'too_long'
 WHEN length(regexp_replace(text, '\P{L}', '', 'g')) / greatest(1, length(text)) < 0.5 THEN 'low_letter_ratio'
 WHEN contains(text, chr(10)) THEN 'internal_line_break'
 WHEN coalesce(lang NOT IN ('zh', 'ja', 'th'), true) AND list_max([length(x) for x in regexp_split_to_array(text, '[\s\p{Z}]+')]) > 60 THEN 'overlong_token'
 WHEN length(text) > 40 AND NOT regexp_matches(text, '\p{Ll}') AND length(regexp_replace(text, '\P{Lu}', '', 'g')) / length(text) > 0.6 THEN 'all_caps' END, 'passed') AS reason, count(*) AS n FROM s GROUP BY 1""")
def quality_reasons(t):
    return quality.with_quality(t("documents"), lang_col="lang").groupBy(F.coalesce("reason", F.lit("passed")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_CUES = ["|".join(rf"\b{c}\b" for c in words) for words in CUES.values()]
_HITS = {n: p.replace("'", "''") for n, p in quality.IDENTIFIERS.items()}


@query(" UNION ALL ".join(f"SELECT '{n}' AS identifier, count(*) AS n FROM documents WHERE regexp_matches(text, '{p}') HAVING count(*) > 0" for n, p in _HITS.items()))
def identifier_hits(t):
    return t("documents").select(F.explode(quality.identifier_hits(F.col("text"))).alias("identifier")).groupBy("identifier").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, CASE WHEN " + " OR ".join(f"regexp_matches(text, '{p}')" for p in _HITS.values()) + " THEN 'identifier' WHEN " + " + ".join(f"len(regexp_extract_all(coalesce(lower(text), ''), '{p}'))" for p in _CUES) + " >= 2 AND " + " AND ".join(f"regexp_matches(lower(text), '{p}')" for p in _CUES) + " THEN 'reference' ELSE 'ordinary' END AS stratum FROM documents")
def document_strata(t):
    return t("documents").select("doc_id", quality.stratum(F.col("text"), CUES).alias("stratum"))


_BUCKET = "(('0x' || substr(sha256({k}), 1, 8))::BIGINT % 100)"


@query(f"""SELECT CASE WHEN b < 20 THEN 'dev' WHEN b < 45 THEN 'rotation_1' WHEN b < 70 THEN 'rotation_2' ELSE 'final' END AS role, count(*) AS n, sum(b)::BIGINT AS buckets
FROM (SELECT {_BUCKET.format(k="text")} AS b FROM documents WHERE text IS NOT NULL) GROUP BY 1""")
def hash_role_split(t):
    d = t("documents").where("text is not null")
    return d.groupBy(quality.role(F.col("text")).alias("role")).agg(F.count(F.lit(1)).alias("n"), F.sum(hash_bucket(F.col("text"))).alias("buckets"))


@query("SELECT (('0x' || substr(sha256(id), 1, 16))::UHUGEINT % 7)::INT AS fold, count(*) AS n FROM canonical_records GROUP BY 1")
def audit_fold_split(t):
    return t("canonical_records").groupBy(hash_fold(F.col("id"), 7).alias("fold")).agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT lang, round(avg(length(regexp_replace(text, '\P{L}', '', 'g')) / greatest(1, length(text))), 9) AS letter_ratio FROM documents WHERE text IS NOT NULL GROUP BY lang")
def letter_ratio_by_lang(t):
    return t("documents").where("text is not null").groupBy("lang").agg(F.round(F.avg(letter_ratio(F.col("text"))), 9).alias("letter_ratio"))


@query("SELECT concat_ws('+', " + ", ".join(rf"CASE WHEN regexp_matches(text, '\p{{{s}}}') THEN '{s}' END" for s in ("Latin", "Cyrillic", "Arabic", "Devanagari", "Thai", "Han", "Hiragana", "Katakana", "Hangul", "Greek", "Hebrew")) + ") AS scripts, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def script_profiles(t):
    return t("documents").where("text is not null").groupBy(script_profile(F.col("text")).alias("scripts")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT regexp_replace(regexp_replace(regexp_replace(substring(s.text, x.start_char + 1, x.end_char - x.start_char), '[A-Z]+', 'U', 'g'), '[a-z]+', 'l', 'g'), '[0-9]+', 'D', 'g') AS shape, count(*) AS n
FROM (SELECT text, unnest(spans) AS x FROM canonical_records WHERE text IS NOT NULL) s WHERE x.start_char IS NOT NULL AND x.end_char > x.start_char GROUP BY 1""")
def value_shapes(t):
    s = t("canonical_records").where("text is not null").select("text", F.explode("spans").alias("x")).where("x.end_char > x.start_char")
    value = F.substring(F.col("text"), F.col("x.start_char") + 1, F.col("x.end_char") - F.col("x.start_char"))
    return s.groupBy(shape_ascii(value).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN regexp_matches(h, '^[a-z]{2,3}$') THEN h END AS tag, count(*) AS n FROM (SELECT lower(split_part(replace(trim(lang), '_', '-'), '-', 1)) AS h FROM documents) GROUP BY 1""")
def language_tags(t):
    return t("documents").groupBy(language_tag(F.col("lang")).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT coalesce(nullif(lower(trim(lang)), ''), nullif(regexp_extract(id, '/([a-z]{2}):', 1), ''), corpus) AS language, count(*) AS n FROM canonical_records GROUP BY 1""")
def inferred_language(t):
    ladder = F.coalesce(F.nullif(F.lower(F.trim("lang")), F.lit("")), F.nullif(F.regexp_extract("id", "/([a-z]{2}):", 1), F.lit("")), F.col("corpus"))
    return t("canonical_records").groupBy(ladder.alias("language")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, substr(sha256(text), 1, 24) AS text_id FROM documents")
def text_ids(t):
    return t("documents").select("doc_id", text_id(F.col("text")).alias("text_id"))


@query("SELECT doc_id, sha256(concat_ws(chr(31), coalesce('doc_id=' || doc_id, 'doc_id'), coalesce('lang=' || lang, 'lang'), coalesce('source=' || source, 'source'))) AS h FROM documents")
def row_hashes(t):
    return t("documents").select("doc_id", row_hash("doc_id", "lang", "source").alias("h"))


_LEFT, _TRIM = r"regexp_replace(line, '^[\s\p{Z}]+', '')", r"regexp_replace(regexp_replace(line, '^[\s\p{Z}]+', ''), '[\s\p{Z}]+$', '')"


@query(f"""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS no FROM p),
o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM l)
SELECT doc_id AS doc, no::INT AS no, (off + length(line) - length({_LEFT}))::INT AS s, (off + length(line) - length({_LEFT}) + length({_TRIM}))::INT AS e, {_TRIM} AS text FROM o WHERE length({_TRIM}) > 0""")
def paragraph_explode(t):
    return segments.paragraphs(t("documents"), "doc_id", "text")


@query(f"""WITH r AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, {_TRIM} AS line FROM r)
SELECT line, count(DISTINCT doc_id) AS docs, count(*) AS n FROM l WHERE length(line) > 0 GROUP BY line HAVING count(DISTINCT doc_id) > 1""")
def repeated_lines(t):
    p = segments.paragraphs(t("documents"), "doc_id", "text")
    return p.groupBy(F.col("text").alias("line")).agg(F.count_distinct("doc").alias("docs"), F.count(F.lit(1)).alias("n")).where("docs > 1")


@query("""WITH w AS (SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 512) / 384.0))::INT + 1)) AS k FROM documents WHERE length(text) > 0)
SELECT doc_id AS doc, k::INT AS no, (k * 384)::INT AS s, least(k * 384 + 512, length(text))::INT AS e, substring(text, k * 384 + 1, 512) AS text FROM w""")
def fixed_windows(t):
    return segments.slices(t("documents"), "doc_id", "text", 512, 384)


@query("""WITH g AS (SELECT DISTINCT item_id, substring(text, i, 4) AS gram FROM (SELECT item_id, text, unnest(range(1, length(text) - 2)) AS i FROM eval_items))
SELECT gram, count(*) AS df FROM g GROUP BY gram HAVING count(*) >= 20""")
def char_ngram_df(t):
    g = t("eval_items").select("item_id", F.explode(F.array_distinct(char_ngrams(F.col("text"), 4))).alias("gram"))
    return g.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df >= 20")


@query(f"SELECT doc_id, sha256({NORM.format(c='text')}) AS h, length({NORM.format(c='text')}) AS n FROM documents")
def normalized_digest(t):
    n = norm_sql(F.col("text"))
    return t("documents").select("doc_id", F.sha2(n, 256).alias("h"), F.length(n).alias("n"))


@query()
def normalized_exact(t):
    """NFKC, full case folding and collapsed white space; no SQL engine here has these."""
    return t("documents").select("doc_id", normalize_exact("text").alias("normalized"))


@query("SELECT doc_id, regexp_replace(raw_text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[email]', 'g') AS redacted FROM documents")
def redact_email(t):
    return t("documents").select("doc_id", F.regexp_replace("raw_text", quality.IDENTIFIERS["email"], "[email]").alias("redacted"))


@query("""WITH v AS (SELECT unnest(regexp_extract_all(text, '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+')) AS v FROM documents)
SELECT v AS value, len([p for p in string_split(v, '.') if NOT regexp_matches(p, '^(0|[1-9][0-9]{0,2})$') OR try_cast(p AS INT) > 255]) = 0 AS valid, count(*) AS n FROM v GROUP BY 1, 2""")
def ipv4_octets(t):
    v = t("documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)"), F.lit(1))).alias("value"))
    return v.groupBy("value", checks.ipv4(F.col("value")).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


_D = "substr(v, {k}, 1)::INT"


def _sum(weights: list[int]) -> str:
    return "(" + " + ".join(f"{_D.format(k=k)} * {w}" for k, w in enumerate(weights, 1) if w) + ")"


_KEYED = "(SELECT o_orderkey, lpad(((o_orderkey * 7919 + o_custkey * 104729) % 89999999999 + 10000000000)::VARCHAR, 11, '0') AS v FROM orders)"


def _keyed(t):
    n = (F.col("o_orderkey") * 7919 + F.col("o_custkey") * 104729) % F.lit(89999999999) + F.lit(10000000000)
    return t("orders").select("o_orderkey", F.lpad(n.cast("string"), 11, "0").alias("v"))


@query(f"""SELECT count(*) AS n,
 count(*) FILTER (WHERE ({" + ".join((f"substr(v, {k}, 1)::INT" if k % 2 else f"(CASE WHEN substr(v, {k}, 1)::INT * 2 > 9 THEN substr(v, {k}, 1)::INT * 2 - 9 ELSE substr(v, {k}, 1)::INT * 2 END)") for k in range(11, 0, -1))}) % 10 = 0) AS luhn,
 count(*) FILTER (WHERE (10 - {_sum([1, 3, 7, 9, 1, 3, 7, 9, 1, 3])} % 10) % 10 = {_D.format(k=11)} AND substr(v, 3, 2)::INT % 20 BETWEEN 1 AND 12 AND substr(v, 5, 2)::INT BETWEEN 1 AND 31) AS pesel,
 count(*) FILTER (WHERE (CASE WHEN {_sum([9, 8, 7, 6, 5, 4, 3, 2, 1])} % 101 = 100 THEN 0 ELSE {_sum([9, 8, 7, 6, 5, 4, 3, 2, 1])} % 101 END) = substr(v, 10, 2)::INT) AS snils,
 count(*) FILTER (WHERE ((({_sum([1, 0, 1, 0, 1, 0, 1, 0, 1])} * 7 - {_sum([0, 1, 0, 1, 0, 1, 0, 1])}) % 10) + 10) % 10 = {_D.format(k=10)} AND {_sum([1] * 10)} % 10 = {_D.format(k=11)}) AS turkish_id
FROM {_KEYED}""")
def checksum_counts(t):
    v = F.col("v")
    return _keyed(t).agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(c, 1)).alias(n) for n, c in (("luhn", checks.luhn(v, 11)), ("pesel", checks.pesel(v)), ("snils", checks.snils(v)), ("turkish_id", checks.turkish_id(v)))])


@query()
def checksum_flags(t):
    """All checks over numbers written into the texts; their published examples are in the tests."""
    v = t("documents").select("doc_id", F.explode(F.regexp_extract_all("raw_text", F.lit(r"([A-Z]{0,2}[0-9][0-9 .-]{7,24}[0-9X])"), F.lit(1))).alias("value"))
    c = F.col("value")
    return v.select("doc_id", "value", *[f(c).alias(f.__name__) for f in (checks.luhn, checks.iban, checks.pesel, checks.turkish_id, checks.snils, checks.israeli_id, checks.korean_rrn, checks.chinese_id, checks.aadhaar)])


@query("""SELECT doc_id, len(regexp_extract_all(text, '\\[[A-Z_]+\\]')) AS placeholders, array_to_string(list_sort(regexp_extract_all(text, '[A-Z]{2}[0-9]{9}')), '|') AS codes FROM documents WHERE text IS NOT NULL""")
def code_multiset(t):
    d = t("documents").where("text is not null")
    return d.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"(\[[A-Z_]+\])"), F.lit(1))).alias("placeholders"), F.array_join(F.array_sort(F.regexp_extract_all("text", F.lit("([A-Z]{2}[0-9]{9})"), F.lit(1))), "|").alias("codes"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def json_fields(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").alias("k")).where("k is not null")
