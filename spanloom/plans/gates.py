"""Queries of gates and small functions: surfaces, shapes, admission, label maps, schedules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import checks, surfaces
from ..functions.text import hash_fold
from ..operators import gates, sampling, scoring, stats, tagset
from ..registry import query
from .audit import _VALUES, values
from .spans import _CLOSURE, _FOREST, _GOLD, _PRED, _TEXT, CUT, FOREST, gold, predicted, texts

_DIGITS = r"regexp_replace(value, '[\s./-]', '', 'g')"


@query(f"""WITH {_VALUES} SELECT label, CASE WHEN regexp_matches(value, '[\\p{{Hiragana}}\\p{{Katakana}}]') THEN 'japanese' WHEN regexp_matches(value, '\\p{{Hangul}}') THEN 'korean' WHEN regexp_matches(value, '\\p{{Han}}') THEN 'han'
 WHEN regexp_matches(value, '\\p{{Arabic}}') THEN 'arabic' WHEN regexp_matches(value, '\\p{{Cyrillic}}') THEN 'cyrillic' WHEN regexp_matches(value, '\\p{{Devanagari}}') THEN 'devanagari'
 WHEN regexp_matches(value, '\\p{{L}}') AND NOT regexp_matches(regexp_replace(value, '\\p{{Latin}}', '', 'g'), '\\p{{L}}') THEN 'latin' ELSE 'mixed-or-other' END AS script, count(*) AS n FROM v GROUP BY ALL""")
def script_buckets(t):
    """Coarse scripts of the values of each label."""
    return values(t).groupBy("label", surfaces.script_bucket(F.col("value")).alias("script")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH d AS (SELECT doc_id, lower(substr(lang, 1, 2)) AS lang, regexp_replace(text, '\P{L}', '', 'g') AS letters FROM documents WHERE text IS NOT NULL AND lang IN ('ru', 'ar', 'hi', 'th', 'ko', 'en', 'de')),
c AS (SELECT *, length(letters) AS n, length(regexp_replace(letters, CASE lang WHEN 'ru' THEN '\P{Cyrillic}' WHEN 'ar' THEN '\P{Arabic}' WHEN 'hi' THEN '\P{Devanagari}' WHEN 'th' THEN '\P{Thai}' WHEN 'ko' THEN '\P{Hangul}' ELSE '\P{Latin}' END, '', 'g')) AS inside FROM d)
SELECT doc_id, lang, n > 0 AND 2 * inside >= n AS in_script FROM c""")
def texts_in_script(t):
    """Whether half of a text's letters or more belong to the script of its label."""
    d = t("documents").where("text is not null").where(F.col("lang").isin("ru", "ar", "hi", "th", "ko", "en", "de"))
    return d.select("doc_id", "lang", surfaces.in_script(F.col("text"), F.col("lang")).alias("in_script"))


@query(f"""WITH {_VALUES}, d AS (SELECT label, {_DIGITS} AS d, value FROM v) SELECT label, count(*) AS n,
 count(*) FILTER (WHERE regexp_matches(d, '^[0-9]+$') AND ((starts_with(d, '4') AND length(d) IN (13, 16, 19)) OR (length(d) = 16 AND (substr(d, 1, 2) BETWEEN '51' AND '55' OR try_cast(substr(d, 1, 4) AS INT) BETWEEN 2221 AND 2720)) OR (length(d) = 15 AND substr(d, 1, 2) IN ('34', '37')))) AS card_shapes,
 count(*) FILTER (WHERE length(value) <= 40 AND length(regexp_replace(b, '[^0-9]', '', 'g')) BETWEEN 7 AND 15 AND length(regexp_replace(b, '[^(]', '', 'g')) = length(regexp_replace(b, '[^)]', '', 'g')) AND length(regexp_replace(b, '[^(]', '', 'g')) <= 1 AND NOT regexp_matches(b, '^[0-9]{{1,4}}[./-][0-9]{{1,2}}[./-][0-9]{{1,4}}$') AND NOT regexp_matches(b, '^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$')) AS phone_surfaces
FROM (SELECT *, trim(regexp_replace(value, '(?i)\\s*(?:ext\\.?|x)\\s*[0-9]+\\s*$', '')) AS b FROM d) GROUP BY label""")
def card_and_phone_shapes(t):
    v = F.col("value")
    return values(t).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(checks.card_shape(v), 1)).alias("card_shapes"), F.count(F.when(checks.phone_surface(v), 1)).alias("phone_surfaces"))


_TEN = "(SELECT o_orderkey, lpad(((o_orderkey * 7919 + o_custkey * 104729) % 8999999999 + 1000000000)::VARCHAR, 10, '0') AS v FROM orders)"


@query(f"""SELECT count(*) AS n, count(*) FILTER (WHERE month BETWEEN 1 AND 12 AND substr(v, 5, 2)::INT BETWEEN 1 AND 31 AND (CASE WHEN substr(v, 1, 9)::BIGINT % 11 = 10 THEN 0 ELSE substr(v, 1, 9)::BIGINT % 11 END) = substr(v, 10, 1)::INT) AS valid
FROM (SELECT v, CASE WHEN m > 70 THEN m - 70 WHEN m > 50 THEN m - 50 WHEN m > 20 THEN m - 20 ELSE m END AS month FROM (SELECT v, substr(v, 3, 2)::INT AS m FROM {_TEN}))""")
def birth_numbers(t):
    n = (F.col("o_orderkey") * 7919 + F.col("o_custkey") * 104729) % F.lit(8999999999) + F.lit(1000000000)
    v = t("orders").select(F.lpad(n.cast("string"), 10, "0").alias("v"))
    return v.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(checks.birth_number(F.col("v")), 1)).alias("valid"))


@query("""SELECT event_id, d AS duration, CASE WHEN regexp_matches(d, '^[0-9]+(\\.[0-9]+)?$') THEN d::DOUBLE WHEN regexp_matches(d, '^([0-9]+[smhd])+$') THEN
 coalesce(list_sum([x[:-2]::DOUBLE * CASE x[-1] WHEN 's' THEN 1 WHEN 'm' THEN 60 WHEN 'h' THEN 3600 ELSE 86400 END FOR x IN regexp_extract_all(d, '[0-9]+[smhd]')]), 0) END AS seconds
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN (user_id % 90)::VARCHAR || 'm' WHEN 1 THEN (user_id % 9)::VARCHAR || 'h' || (event_id % 60)::VARCHAR || 'm5s' WHEN 2 THEN (event_id % 1000)::VARCHAR || '.5' ELSE 'soon' END AS d FROM events)""")
def durations(t):
    """Compact durations in seconds; null for what isn't one."""
    e, u = F.col("event_id"), F.col("user_id")
    d = F.when(e % 4 == 0, F.concat((u % 90).cast("string"), F.lit("m"))).when(e % 4 == 1, F.concat((u % 9).cast("string"), F.lit("h"), (e % 60).cast("string"), F.lit("m5s"))).when(e % 4 == 2, F.concat((e % 1000).cast("string"), F.lit(".5"))).otherwise("soon")
    return t("events").select("event_id", d.alias("duration")).withColumn("seconds", surfaces.duration_seconds(F.col("duration")))


@query(f"""WITH {_VALUES} SELECT label, count(*) AS n, count(*) FILTER (WHERE regexp_matches(value, '\\p{{Lu}}') AND regexp_matches(value, '\\p{{Ll}}')) AS mixed, count(*) FILTER (WHERE value = upper(value) AND value <> lower(value)) AS upper_case, count(*) FILTER (WHERE value = lower(value) AND value <> upper(value)) AS lower_case FROM v GROUP BY label""")
def case_variants(t):
    v = F.col("value")
    c = lambda x: F.count(F.when(x, 1))
    return values(t).groupBy("label").agg(F.count(F.lit(1)).alias("n"), c(surfaces.mixed_case(v)).alias("mixed"), c((v == F.upper(v)) & (v != F.lower(v))).alias("upper_case"), c((v == F.lower(v)) & (v != F.upper(v))).alias("lower_case"))


@query(f"""WITH {_VALUES}, k AS (SELECT DISTINCT lower(value) AS key FROM v), h AS (SELECT key, (('0x' || substr(sha256(key), 1, 16))::UHUGEINT % 10000)::INT AS b FROM k)
SELECT CASE WHEN b < 8000 THEN 'train' WHEN b < 9000 THEN 'development' ELSE 'test' END AS split, count(*) AS n, sum(b)::BIGINT AS buckets FROM h GROUP BY 1""")
def split_names(t):
    """Names by the hash of their normal form: 80, 10 and 10 in a hundred."""
    k = values(t).select(F.lower("value").alias("key")).distinct().withColumn("b", hash_fold(F.col("key"), 10_000))
    split = F.when(F.col("b") < 8_000, "train").when(F.col("b") < 9_000, "development").otherwise("test")
    return k.groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("buckets"))


@query(f"""WITH {_GOLD}, {_TEXT}, p AS (SELECT g.doc, g.s, g.e, g.label, length(text) AS n, coalesce(nullif(length(substring(text, 1, s)) - coalesce(nullif(instr(reverse(substring(text, 1, s)), chr(10) || chr(10)), 0), length(substring(text, 1, s)) + 1) + 1, 0), 0) AS l, instr(substring(text, e + 1, length(text)), chr(10) || chr(10)) AS r FROM g JOIN t USING (doc) WHERE text IS NOT NULL AND e <= length(text)),
b AS (SELECT *, CASE WHEN r = 0 THEN n ELSE e + r - 1 END AS right_end FROM p)
SELECT doc, s, e, label, CASE WHEN right_end - l <= 400 THEN l ELSE greatest(l, s - 200) END AS p_s,
 CASE WHEN right_end - l <= 400 THEN right_end ELSE least(greatest(l, s - 200) + 400, least(right_end, greatest(e + 200, greatest(l, s - 200) + 400))) END AS p_e FROM b""")
def paragraph_bounds(t):
    """The paragraph between blank lines around each span, or a window of 400 characters of it where it is longer."""
    j = gold(t).join(texts(t).where("text is not null"), "doc").where(F.col("e") <= F.length("text"))
    return surfaces.paragraph_bounds(j, 400).select("doc", "s", "e", "label", "p_s", "p_e")


# ---- scores ----


@query(f"""WITH {_GOLD}, {_PRED}, {_TEXT}, n AS (SELECT sum(length(text))::BIGINT AS chars FROM t WHERE text IS NOT NULL), a AS (SELECT DISTINCT doc, unnest(range(s, e)) AS k FROM g SEMI JOIN (SELECT doc FROM t WHERE text IS NOT NULL) USING (doc)), b AS (SELECT DISTINCT model, doc, unnest(range(s, e)) AS k FROM p SEMI JOIN (SELECT doc FROM t WHERE text IS NOT NULL) USING (doc)),
m AS (SELECT DISTINCT model FROM p), x AS (SELECT m.model, (SELECT count(*) FROM a) AS pos, (SELECT count(*) FROM b WHERE b.model = m.model) AS said, (SELECT count(*) FROM a JOIN b USING (doc, k) WHERE b.model = m.model) AS tp FROM m)
SELECT model, round((tp + chars - pos - said + tp) / chars, 9) AS accuracy, round((tp / pos + (chars - pos - said + tp) / (chars - pos)) / 2, 9) AS balanced FROM x, n""")
def character_accuracy(t):
    """Accuracy and balanced accuracy of each model over characters."""
    n = texts(t).where("text is not null").select("doc", F.length("text").alias("n"))
    p = predicted(t)
    out = None
    for m in [r[0] for r in p.select("model").distinct().orderBy("model").collect()]:  # a handful of models
        c = scoring.character_counts(gold(t), p.where(F.col("model") == m), n).agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn", "tn")])
        one = c.select(F.lit(m).alias("model"), *[F.round(x, 9).alias(a) for a, x in zip(("accuracy", "balanced"), scoring.accuracies())])
        out = one if out is None else out.union(one)
    return out


@query(f"""WITH {_GOLD}, {_TEXT}, tok AS (SELECT g.doc, g.s, g.e, g.label, x.label AS vote, least(g.e, x.e) - greatest(g.s, x.s) AS w FROM g JOIN (SELECT DISTINCT id AS doc, y.start_char AS s, y.end_char AS e, y.label AS label FROM (SELECT id, unnest(preds) AS y FROM predictions)) x ON g.doc = x.doc AND g.s < x.e AND x.s < g.e WHERE x.label IS NOT NULL),
s AS (SELECT doc, s, e, label, vote, sum(w)::BIGINT AS w FROM tok GROUP BY ALL) SELECT doc, s, e, label, vote, w FROM (SELECT *, row_number() OVER (PARTITION BY doc, s, e, label ORDER BY w DESC, vote) AS k FROM s) WHERE k = 1""")
def preponderance_vote(t):
    """The label that covers most characters of each span among the models' spans; ties go to the first by name."""
    x = predicted(t).where("label is not null").select("doc", "s", "e", "label").distinct()
    return gates.preponderant_label(gold(t), x)


@query(f"""WITH {_CLOSURE}, near AS (SELECT node, arg_min(ancestor, steps) AS target FROM c WHERE ancestor IN ({", ".join(f"'{x}'" for x in CUT)}) GROUP BY node) SELECT target, node AS label, count(*) OVER (PARTITION BY target)::BIGINT AS options FROM near WHERE NOT EXISTS (SELECT 1 FROM {_FOREST} WHERE parent = near.node)""")
def back_projection(t):
    """Leaves that each label of the cut stands for, and how many they are."""
    spark = t("nation").sparkSession
    nodes, cut = spark.createDataFrame(FOREST, "node string, parent string"), spark.createDataFrame([(x,) for x in CUT], "node string")
    return tagset.back_project(nodes, cut)


@query(f"""WITH {_GOLD}, {_PRED}, o AS (SELECT DISTINCT g.label AS source, p.label AS target FROM g JOIN p USING (doc, s, e) WHERE g.label IS NOT NULL AND p.label IS NOT NULL) SELECT target, array_to_string(list_sort(list(source)), '|') AS sources, count(*) AS n FROM o GROUP BY target""")
def acceptable_sources(t):
    """The label map turned round: for each target the sources that it was seen for on equal spans."""
    o = gold(t).where("label is not null").select("doc", "s", "e", F.col("label").alias("source")).join(predicted(t).where("label is not null").select("doc", "s", "e", F.col("label").alias("target")), ["doc", "s", "e"])
    return tagset.invert(o.select("source", "target"))


@query(f"""WITH RECURSIVE {_CLOSURE.removeprefix('RECURSIVE ')}, {_GOLD}, near AS (SELECT node AS label, arg_min(ancestor, steps) AS target FROM c WHERE ancestor IN ({", ".join(f"'{x}'" for x in CUT)}) GROUP BY node),
k AS (SELECT split_part(doc, '/', 1) AS corpus, coalesce(target, 'other') AS target, count(*) AS n FROM g LEFT JOIN near USING (label) WHERE g.label IS NOT NULL GROUP BY ALL), a AS (SELECT target, n / sum(n) OVER () AS p FROM k WHERE corpus = 'civic-letters'), b AS (SELECT target, n / sum(n) OVER () AS q FROM k WHERE corpus = 'ward-notes'), j AS (SELECT coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM a FULL JOIN b USING (target)),
v AS (SELECT sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2 AS js FROM j) SELECT round(js, 9) AS js, js <= 0.05 AS balanced FROM v""")
def coarsened_balance(t):
    """Balance of two corpora over labels brought to the cut, and whether it passes the gate."""
    spark = t("nation").sparkSession
    nodes, cut = spark.createDataFrame(FOREST, "node string, parent string"), spark.createDataFrame([(x,) for x in CUT], "node string")
    n = tagset.project(gold(t).where("label is not null"), nodes, cut).groupBy(F.split_part("doc", F.lit("/"), F.lit(1)).alias("corpus"), F.coalesce("target", F.lit("other")).alias("target")).agg(F.count(F.lit(1)).alias("n"))
    js = stats.js_divergence(n.where("corpus = 'civic-letters'"), n.where("corpus = 'ward-notes'"), "target", "n")
    return js.select(F.round("js", 9).alias("js"), (F.col("js") <= 0.05).alias("balanced"))


# ---- admission ----


@query("""WITH r AS (SELECT id, CASE WHEN starts_with(coalesce(metadata['source'], ''), 'gold-') THEN 'source' WHEN starts_with(corpus, 'ward-') THEN 'corpus' END AS reason FROM canonical_records) SELECT reason, count(*) AS n, min(id) AS first FROM r WHERE reason IS NOT NULL GROUP BY reason""")
def quarantined_rows(t):
    """Rows whose fields begin with a blocked prefix, by the first such field."""
    return gates.quarantine(t("canonical_records"), {"source": F.coalesce(F.col("metadata")["source"], F.lit("")), "corpus": F.col("corpus")}, {"source": ["gold-"], "corpus": ["ward-"]}, "id")


@query("""WITH s AS (SELECT id, corpus, length(text) AS n, text IS NULL AS no_text, lang, row_number() OVER (PARTITION BY id ORDER BY ingested_at, corpus) AS k, spans FROM canonical_records), x AS (SELECT id, unnest(spans) AS x, n FROM s WHERE NOT no_text)
SELECT 'text_missing' AS expectation, count(*) AS failed FROM s WHERE no_text UNION ALL SELECT 'lang_missing', count(*) FROM s WHERE lang IS NULL UNION ALL SELECT 'spans_unknown', count(*) FROM s WHERE spans IS NULL UNION ALL SELECT 'id_repeated', count(*) FROM s WHERE k > 1
UNION ALL SELECT 'label_missing', count(*) FROM x WHERE x.label IS NULL UNION ALL SELECT 'span_empty', count(*) FROM x WHERE x.end_char <= x.start_char UNION ALL SELECT 'span_outside', count(*) FROM x WHERE x.start_char < 0 OR x.end_char > n""")
def record_expectations(t):
    """Expectations on canonical records, with the number of rows or spans that fail each."""
    return gates.expectations(t("canonical_records"))


@query(f"""WITH {_GOLD}, {_TEXT}, l AS (SELECT doc, text, regexp_extract_all(text, '(?:[$€£][0-9][0-9.,]*|[0-9][0-9.,]* ?EUR)') AS hits FROM t WHERE text IS NOT NULL), x AS (SELECT doc, text, unnest(list_distinct(hits)) AS hit FROM l),
h AS (SELECT doc, hit, instr(text, hit) - 1 AS s, instr(text, hit) - 1 + length(hit) AS e FROM x) SELECT doc, count(*) AS amounts FROM h WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc = h.doc AND g.s <= h.s AND h.e <= g.e) GROUP BY doc""")
def semantic_guard(t):
    """Documents with amounts of money that no span contains, and their number; each amount at its first place."""
    found = texts(t).where("text is not null").select("doc", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"((?:[$€£][0-9][0-9.,]*|[0-9][0-9.,]* ?EUR))"), F.lit(1)))).alias("hit"))
    placed = found.select("doc", "hit", (F.expr("instr(text, hit)") - 1).alias("s")).withColumn("e", F.col("s") + F.length("hit"))
    return gates.not_contained(placed, gold(t)).groupBy("doc").agg(F.count(F.lit(1)).alias("amounts"))


@query("SELECT column_name FROM (DESCRIBE canonical_records) WHERE column_name IN ('text', 'spans') ORDER BY 1")
def text_like_columns(t):
    """Columns of a table whose name, or that of a part of which, tells of text; a receipt must have none."""
    found = gates.text_like(t("canonical_records").schema)
    return t("nation").sparkSession.createDataFrame([(c.split(".")[0],) for c in found], "column_name string").distinct()


@query("SELECT o_orderkey, o_totalprice, n FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def strict_one_to_one(t):
    """A join in which both sides must have the same distinct keys; it fails at the first that is missing or repeated."""
    n = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    o = t("orders").select("o_orderkey", "o_totalprice").join(n.select("o_orderkey"), "o_orderkey", "left_semi")
    return gates.one_to_one(o, n, "o_orderkey")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM sentence_review) AND doc_id NOT IN (SELECT doc_id FROM text_windows WHERE doc_id IS NOT NULL)")
def included_and_excluded(t):
    """Rows of a list of ids without those of another; an id of the first list that no row has is an error."""
    return gates.select_ids(t("documents").select("doc_id", "source"), "doc_id", include=t("sentence_review"), exclude=t("text_windows"))


@query("""WITH e AS (SELECT DISTINCT lower(trim(text)) AS k FROM eval_items), d AS (SELECT source, lower(trim(text)) AS k, doc_id % 5 = 0 AS validation FROM documents WHERE text IS NOT NULL AND source IS NOT NULL) SELECT source, count(*) FILTER (WHERE NOT validation) AS train, count(*) FILTER (WHERE validation AND k NOT IN (SELECT k FROM d WHERE NOT validation)) AS validation FROM d GROUP BY source""")
def partition_without_train_texts(t):
    """Training and validation rows, where validation rows whose text is in training are dropped."""
    d = t("documents").where("text is not null and source is not null").select("source", F.sha2(F.lower(F.trim("text")), 256).alias("k"), (F.col("doc_id") % 5 == 0).alias("validation"))
    train = d.where(~F.col("validation"))
    kept = d.where("validation").join(train.select("k").distinct(), "k", "left_anti")
    n = lambda x, c: x.groupBy("source").agg(F.count(F.lit(1)).alias(c))
    return d.select("source").distinct().join(n(train, "train"), "source", "left").join(n(kept, "validation"), "source", "left").na.fill(0, ["train", "validation"])


@query("""WITH c AS (SELECT DISTINCT id, lang FROM canonical_records), f(prefix, fixed) AS (VALUES ('civic-letters/en', 'en'), ('ward-notes/de', 'de')) SELECT coalesce(fixed, lang) AS language, count(*) AS n FROM c LEFT JOIN f ON split_part(id, ':', 1) = prefix GROUP BY 1""")
def scoring_language(t):
    """Languages of records with the corrections of their id's prefix first."""
    fixed = {"civic-letters/en": "en", "ward-notes/de": "de"}
    table = F.create_map(*[F.lit(x) for kv in fixed.items() for x in kv])
    return t("canonical_records").select("id", "lang").distinct().groupBy(F.coalesce(table[F.split_part("id", F.lit(":"), F.lit(1))], F.col("lang")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


# ---- weights and order ----


@query("""WITH s AS (SELECT source, count(*)::DOUBLE AS score FROM documents WHERE source IS NOT NULL GROUP BY source), a AS (SELECT *, 2000 * score / sum(score) OVER () AS w0 FROM s), b AS (SELECT *, w0 >= 150 AS c1 FROM a), b2 AS (SELECT *, (2000 - 150 * count(*) FILTER (WHERE c1) OVER ()) * score / nullif(sum(CASE WHEN c1 THEN 0 ELSE score END) OVER (), 0) AS w1 FROM b), c AS (SELECT *, c1 OR w1 >= 150 AS c2 FROM b2),
d AS (SELECT *, (2000 - 150 * count(*) FILTER (WHERE c2) OVER ()) * score / nullif(sum(CASE WHEN c2 THEN 0 ELSE score END) OVER (), 0) AS w2 FROM c), e AS (SELECT *, c2 OR w2 >= 150 AS c3 FROM d), f AS (SELECT *, (2000 - 150 * count(*) FILTER (WHERE c3) OVER ()) * score / nullif(sum(CASE WHEN c3 THEN 0 ELSE score END) OVER (), 0) AS w3 FROM e), g AS (SELECT *, c3 OR w3 >= 150 AS c4 FROM f),
h AS (SELECT *, (2000 - 150 * count(*) FILTER (WHERE c4) OVER ()) * score / nullif(sum(CASE WHEN c4 THEN 0 ELSE score END) OVER (), 0) AS w4 FROM g) SELECT source, round(CASE WHEN c4 THEN 150 ELSE w4 END, 6) AS weight FROM h""")
def capped_extra(t):
    """A budget shared in proportion to scores, no share over the cap, what the cap frees going to the others."""
    s = t("documents").where("source is not null").groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return sampling.capped_extra_weights(s, "source", "score", 2000.0, 150.0).select("source", F.round("weight", 6).alias("weight"))


@query("""WITH d AS (SELECT doc_id, n_chars, doc_id // 64 AS block FROM documents WHERE n_chars IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY n_chars, doc_id) - 1 AS k FROM d) SELECT doc_id, block, (k // 8)::INT AS batch FROM r""")
def length_buckets(t):
    """Batches of eight rows of like length within blocks of 64 ids."""
    d = t("documents").where("n_chars is not null").select("doc_id", "n_chars", F.floor(F.col("doc_id") / 64).alias("block"))
    k = F.row_number().over(Window.partitionBy("block").orderBy("n_chars", "doc_id")) - 1
    return d.withColumn("batch", F.floor(k / 8).cast("int")).select("doc_id", "block", "batch")


@query("""WITH d AS (SELECT doc_id // 32 AS batch, n_chars, source, text FROM documents WHERE n_chars IS NOT NULL), b AS (SELECT batch, count(*) AS rows, sum(n_chars)::BIGINT AS used, max(n_chars) * count(*) AS held, count(*) - count(DISTINCT text) AS repeats FROM d GROUP BY batch)
SELECT count(*) AS batches, round(1 - sum(used) / sum(held), 9) AS padding, sum(repeats)::BIGINT AS repeats, round(stddev_samp(used) / avg(used), 9) AS variation FROM b""")
def schedule_metrics(t):
    """Padding, repeated texts and variation in size of batches of 32 ids."""
    d = t("documents").where("n_chars is not null").select(F.floor(F.col("doc_id") / 32).alias("batch"), "n_chars", F.sha2("text", 256).alias("k"))
    return sampling.schedule_metrics(d, "batch", "n_chars", "k").withColumns({c: F.round(c, 9) for c in ("padding", "variation")})


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents WHERE text IS NOT NULL), s AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no) - length(line) - 1 AS off FROM l)
SELECT doc_id, (off // 500)::BIGINT AS part, count(*) AS lines, min(off)::BIGINT AS s FROM s GROUP BY doc_id, off // 500""")
def paragraph_parts(t):
    """Lines of a document in parts by the stretch of 500 characters in which they begin."""
    x = t("documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    w = Window.partitionBy("doc_id").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    placed = x.withColumn("at", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)))
    return placed.groupBy("doc_id", F.floor(F.col("at") / 500).alias("part")).agg(F.count(F.lit(1)).alias("lines"), F.min("at").alias("s"))


@query("""WITH a AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS k FROM eval_items), b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM (SELECT DISTINCT doc_id FROM sentence_review)) SELECT item_id, doc_id, k FROM a JOIN b USING (k)""")
def positional_zip(t):
    """Rows of two tables side by side by their places in the order of their keys."""
    return gates.zip_by_place(t("eval_items").select("item_id"), "item_id", t("sentence_review").select("doc_id").distinct(), "doc_id")


@query("""WITH s AS (SELECT id, model, threshold, max(tp) AS tp FROM score_counts WHERE coverage = 80 GROUP BY ALL), a AS (SELECT id, threshold, tp, row_number() OVER (ORDER BY id, threshold) AS k FROM s WHERE model = 'span-a'), b AS (SELECT id, threshold, tp, row_number() OVER (ORDER BY id, threshold) AS k FROM s WHERE model = 'span-b')
SELECT count(*) FILTER (WHERE same) AS equal_rows, coalesce(min(k) FILTER (WHERE NOT same) - 1, count(*)) AS prefix FROM (SELECT coalesce(a.k, b.k) AS k, coalesce(a.id = b.id AND a.threshold = b.threshold AND a.tp = b.tp, false) AS same FROM a FULL JOIN b USING (k))""")
def resume_prefix(t):
    """How many rows of two outputs are equal, and how long the equal beginning is from which a run may go on."""
    s = t("score_counts").where("coverage = 80").groupBy("id", "model", "threshold").agg(F.max("tp").alias("tp"))
    side = lambda m: s.where(F.col("model") == m).drop("model")
    return gates.equal_prefix(side("span-a"), side("span-b"), ["id", "threshold"], ["tp"])


@query()
def document_bootstrap(t):
    """F1 with its standard error over resampled documents."""
    c = t("score_counts").where("coverage = 80 and threshold = 0.5").groupBy("model", "id").agg(*[F.sum(F.coalesce(x, F.lit(0))).alias(x) for x in ("tp", "predicted", "gold")])
    return stats.bootstrap_error(c, "model", "id")


@query("""WITH l(need, lo, hi) AS (VALUES ('short', 1, 400), ('middle', 200, 900), ('long', 800, 100000)), d AS (SELECT doc_id, n_chars FROM documents WHERE n_chars > 0), f AS (SELECT min(doc_id) AS id FROM d WHERE n_chars BETWEEN 1 AND 400), g AS (SELECT min(doc_id) AS id FROM d WHERE n_chars BETWEEN 200 AND 900 AND doc_id NOT IN (SELECT id FROM f)), h AS (SELECT min(doc_id) AS id FROM d WHERE n_chars >= 800 AND n_chars <= 100000 AND doc_id NOT IN (SELECT id FROM f UNION ALL SELECT id FROM g))
SELECT 'long' AS need, id AS doc_id FROM h UNION ALL SELECT 'middle', id FROM g UNION ALL SELECT 'short', id FROM f""")
def distinct_targets(t):
    """One row of its own for each need, in the order in which they are stated, the smallest id that none before has taken."""
    needs = [("short", 1, 400), ("middle", 200, 900), ("long", 800, 100_000)]
    d = t("documents").where("n_chars > 0")
    return gates.distinct_targets(d, "doc_id", [(n, F.col("n_chars").between(a, b)) for n, a, b in needs])
