"""Queries that count and compare values, carriers, labels and coverage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import norm_sql
from ..operators import stats
from ..registry import query
from .spans import _GOLD, _PRED, _TEXT, gold, predicted, texts

_VALUES = f"{_GOLD}, {_TEXT}, v AS (SELECT g.doc, g.label, split_part(g.doc, '/', 1) AS corpus, substring(t.text, s + 1, e - s) AS value FROM g JOIN t USING (doc) WHERE t.text IS NOT NULL AND g.label IS NOT NULL)"
_N = r"trim(regexp_replace(lower(value), '[\s\p{Z}]+', ' ', 'g'))"


def values(t):
    j = gold(t).where("label is not null").join(texts(t).where("text is not null"), "doc")
    return j.select("doc", "label", F.split_part("doc", F.lit("/"), F.lit(1)).alias("corpus"), F.substring(F.col("text"), F.col("s") + 1, F.col("e") - F.col("s")).alias("value"))


@query(f"WITH {_GOLD} SELECT split_part(doc, '/', 1) AS corpus, label, count(*) AS spans, count(DISTINCT doc) AS docs FROM g GROUP BY ALL")
def span_counts(t):
    return gold(t).groupBy(F.split_part("doc", F.lit("/"), F.lit(1)).alias("corpus"), "label").agg(F.count(F.lit(1)).alias("spans"), F.count_distinct("doc").alias("docs"))


@query(f"WITH {_VALUES} SELECT label, count(*) AS n, count(DISTINCT value) AS surfaces, count(DISTINCT {_N}) AS normalized, count(*) - count(DISTINCT {_N}) AS repeats FROM v GROUP BY label")
def value_stats(t):
    n = norm_sql(F.col("value"))
    return values(t).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("surfaces"), F.count_distinct(n).alias("normalized"), (F.count(F.lit(1)) - F.count_distinct(n)).alias("repeats"))


@query(f"WITH {_VALUES}, c AS (SELECT label, {_N} AS value, count(*) AS n FROM v GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, value) AS place FROM c) SELECT * FROM r WHERE place <= 5")
def value_topk(t):
    c = values(t).groupBy("label", norm_sql(F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "value")).cast("bigint")).where("place <= 5")


@query(f"""WITH {_VALUES}, c AS (SELECT corpus, {_N} AS value, count(*) AS n FROM v GROUP BY 1, 2), a AS (SELECT value, n FROM c WHERE corpus = 'civic-letters'), b AS (SELECT value, n FROM c WHERE corpus = 'ward-notes'),
j AS (SELECT coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL JOIN b USING (value)) SELECT count(*) FILTER (WHERE x > 0 AND y > 0) AS shared, count(*) AS either, sum(least(x, y))::BIGINT AS shared_mass, sum(greatest(x, y))::BIGINT AS either_mass, round(sum(least(x, y)) / sum(greatest(x, y)), 9) AS multiset_jaccard FROM j""")
def carrier_multiset_jaccard(t):
    c = values(t).groupBy("corpus", norm_sql(F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    a, b = c.where("corpus = 'civic-letters'").select("value", F.col("n").alias("x")), c.where("corpus = 'ward-notes'").select("value", F.col("n").alias("y"))
    j = a.join(b, "value", "full").na.fill(0, ["x", "y"])
    return j.agg(F.count(F.when((F.col("x") > 0) & (F.col("y") > 0), 1)).alias("shared"), F.count(F.lit(1)).alias("either"), F.sum(F.least("x", "y")).alias("shared_mass"), F.sum(F.greatest("x", "y")).alias("either_mass"), F.round(F.sum(F.least("x", "y")) / F.sum(F.greatest("x", "y")), 9).alias("multiset_jaccard"))


@query(f"""WITH {_GOLD}, a AS (SELECT label, count(*) / sum(count(*)) OVER () AS p FROM g WHERE label IS NOT NULL AND split_part(doc, '/', 1) = 'civic-letters' GROUP BY label), b AS (SELECT label, count(*) / sum(count(*)) OVER () AS q FROM g WHERE label IS NOT NULL AND split_part(doc, '/', 1) = 'ward-notes' GROUP BY label),
j AS (SELECT coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM a FULL JOIN b USING (label)) SELECT round(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 9) AS js FROM j""")
def balance_js(t):
    n = gold(t).where("label is not null").groupBy(F.split_part("doc", F.lit("/"), F.lit(1)).alias("corpus"), "label").agg(F.count(F.lit(1)).alias("n"))
    return stats.js_divergence(n.where("corpus = 'civic-letters'"), n.where("corpus = 'ward-notes'"), "label", "n").select(F.round("js", 9).alias("js"))


_NEED = {"person_name": (500, 300), "city": (200, 150), "date": (100, 100), "iban": (10, 10)}


@query(f"WITH {_GOLD}, n AS (SELECT label, count(*) AS spans, count(DISTINCT doc) AS docs FROM g GROUP BY label), r(label, need_spans, need_docs) AS (VALUES " + ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in _NEED.items()) + ") SELECT r.label, coalesce(spans, 0) AS spans, coalesce(docs, 0) AS docs, greatest(0, need_spans - coalesce(spans, 0)) AS span_deficit, greatest(0, need_docs - coalesce(docs, 0)) AS doc_deficit FROM r LEFT JOIN n USING (label)")
def coverage_result(t):
    g = gold(t).groupBy("label").agg(F.count(F.lit(1)).alias("spans"), F.count_distinct("doc").alias("docs"))
    need = g.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in _NEED.items()], "label string, need_spans bigint, need_docs bigint")
    j = need.join(g, "label", "left").na.fill(0, ["spans", "docs"])
    return j.select("label", "spans", "docs", F.greatest(F.lit(0), F.col("need_spans") - F.col("spans")).alias("span_deficit"), F.greatest(F.lit(0), F.col("need_docs") - F.col("docs")).alias("doc_deficit"))


@query(f"""WITH {_VALUES}, s AS (SELECT CASE WHEN (('0x' || substr(sha256(doc), 1, 16))::UHUGEINT % 10)::INT = 0 THEN 'audit' ELSE 'train' END AS split, * FROM v)
SELECT split, label, value, count(*) AS n, count(DISTINCT corpus) AS sources, count(DISTINCT doc) AS records, substr(sha256(concat_ws(chr(31), '1', split, label, value)), 1, 20) AS entry_id FROM s GROUP BY split, label, value""")
def surface_pool(t):
    from ..functions.text import hash_fold

    s = values(t).withColumn("split", F.when(hash_fold(F.col("doc"), 10) == 0, "audit").otherwise("train"))
    p = s.groupBy("split", "label", "value").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("corpus").alias("sources"), F.count_distinct("doc").alias("records"))
    return p.withColumn("entry_id", F.substring(F.sha2(F.concat_ws("\u001f", F.lit("1"), "split", "label", "value"), 256), 1, 20))


@query(f"WITH {_VALUES}, k AS (SELECT {_N} AS value, label, doc FROM v) SELECT value, min(label) AS label, count(*) AS n FROM k GROUP BY value HAVING count(DISTINCT label) = 1")
def unambiguous_values(t):
    k = values(t).select(norm_sql(F.col("value")).alias("value"), "label")
    return k.groupBy("value").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("d")).where("d = 1").drop("d")


@query(f"WITH {_VALUES} SELECT {_N} AS value, count(*) FILTER (WHERE label = 'person_name') AS person_name, count(*) FILTER (WHERE label = 'city') AS city, count(*) FILTER (WHERE label = 'organization_name') AS organization_name FROM v WHERE label IN ('person_name', 'city', 'organization_name') GROUP BY 1")
def name_inventory(t):
    roles = ["person_name", "city", "organization_name"]
    k = values(t).where(F.col("label").isin(roles)).select(norm_sql(F.col("value")).alias("value"), "label")
    return k.groupBy("value").pivot("label", roles).count().na.fill(0, roles)


@query(f"WITH {_GOLD}, {_PRED}, a AS (SELECT DISTINCT label FROM g WHERE label IS NOT NULL), b AS (SELECT DISTINCT label FROM p WHERE label IS NOT NULL) SELECT label, 'both' AS side FROM (SELECT label FROM a INTERSECT SELECT label FROM b) UNION ALL SELECT label, 'gold' FROM (SELECT label FROM a EXCEPT SELECT label FROM b) UNION ALL SELECT label, 'predicted' FROM (SELECT label FROM b EXCEPT SELECT label FROM a)")
def label_universes(t):
    a, b = gold(t).where("label is not null").select("label").distinct(), predicted(t).where("label is not null").select("label").distinct()
    side = lambda d, s: d.select("label", F.lit(s).alias("side"))
    return side(a.intersect(b), "both").union(side(a.subtract(b), "gold")).union(side(b.subtract(a), "predicted"))


@query("SELECT id, text FROM canonical_records WHERE text IS NOT NULL EXCEPT ALL SELECT DISTINCT id, text FROM canonical_records WHERE text IS NOT NULL")
def redelivered_rows(t):
    c = t("canonical_records").where("text is not null").select("id", "text")
    return c.exceptAll(c.distinct())


@query("WITH h AS (SELECT CASE WHEN value <= 0 THEN 0 ELSE ceil(log2(value * 1000))::INT END AS bucket FROM events WHERE value IS NOT NULL) SELECT bucket, count(*) AS n FROM h GROUP BY bucket")
def power_histogram(t):
    v = F.col("value")
    return t("events").where("value is not null").groupBy(F.when(v <= 0, 0).otherwise(F.ceil(F.log2(v * 1000)).cast("int")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, round(avg(value), 6) AS mean, max(CASE WHEN k = floor(n * 0.5)::BIGINT THEN value END) AS p50, max(CASE WHEN k = least(n - 1, floor(n * 0.9)::BIGINT) THEN value END) AS p90, max(value) AS top FROM r GROUP BY event_type""")
def latency_stats(t):
    """Quantiles by the element of a rank, from the counts of distinct values, so that no group's rows are gathered."""
    c = t("events").where("value is not null").groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("event_type")
    r = c.withColumn("upto", F.sum("c").over(w.orderBy("value"))).withColumn("n", F.sum("c").over(w))
    at = lambda q: F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * q)), F.col("value")))
    return r.groupBy("event_type").agg(F.round(F.sum(F.col("value") * F.col("c")) / F.sum("c"), 6).alias("mean"), at(0.5).alias("p50"), at(0.9).alias("p90"), F.max("value").alias("top"))


@query("WITH s AS (SELECT lang, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM documents WHERE text IS NOT NULL GROUP BY lang), r(lang, floor) AS (VALUES ('en', 0.2), ('de', 0.05), ('ko', 0.05), ('sv', 0.01)) SELECT r.lang, coalesce(n, 0) AS n, coalesce(share, 0) >= floor AS supported FROM r LEFT JOIN s USING (lang)")
def language_support(t):
    d = t("documents").where("text is not null")
    n, total = d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), d.count()
    need = n.sparkSession.createDataFrame([("en", 0.2), ("de", 0.05), ("ko", 0.05), ("sv", 0.01)], "lang string, floor double")
    return need.join(n, "lang", "left").na.fill(0, ["n"]).select("lang", "n", (F.col("n") / F.lit(float(max(1, total))) >= F.col("floor")).alias("supported"))


@query("SELECT metadata['license'] AS license, count(*) AS n, count(*) FILTER (WHERE metadata['license'] NOT IN ('open-a', 'open-b')) AS refused FROM canonical_records WHERE metadata['license'] IS NOT NULL GROUP BY 1")
def license_gate(t):
    li = F.col("metadata")["license"]
    return t("canonical_records").where(li.isNotNull()).groupBy(li.alias("license")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~li.isin("open-a", "open-b"), 1)).alias("refused"))


@query("""SELECT corpus, coalesce(metadata['split'], 'none') AS split, lang, count(*) AS records, sum(coalesce(len(spans), 0))::BIGINT AS spans FROM canonical_records GROUP BY ALL""")
def shard_manifest(t):
    return t("canonical_records").groupBy("corpus", F.coalesce(F.col("metadata")["split"], F.lit("none")).alias("split"), "lang").agg(F.count(F.lit(1)).alias("records"), F.sum(F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans"))).alias("spans"))
