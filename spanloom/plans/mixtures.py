"""Queries that split, draw and weigh rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import hash_unit
from ..operators import sampling
from ..registry import query

_U = "((('0x' || substr(sha256({k}), 1, 12))::BIGINT + 0.5) / 281474976710656.0)"


def _weighted(t):
    return t("documents").where("n_chars > 0").select("doc_id", "lang", "source", "text", F.col("n_chars").cast("double").alias("w"))


@query("""WITH d AS (SELECT doc_id, lang, text, n_chars::DOUBLE AS w FROM documents WHERE n_chars > 0), g AS (SELECT lang, text, sum(w) AS s, count(*) AS n FROM d GROUP BY ALL), a AS (SELECT sum(s) AS before, sum(s / n) AS after FROM g)
SELECT d.doc_id, round(s / (n * n) * before / after, 6) AS shared FROM d JOIN g ON d.lang IS NOT DISTINCT FROM g.lang AND d.text = g.text, a""")
def share_mass(t):
    return sampling.share_duplicate_mass(_weighted(t), ["lang", "text"], "w").select("doc_id", F.round("shared", 6).alias("shared"))


@query()
def language_caps(t):
    """Water-filling over the masses of the languages; a loop on a small table."""
    d = sampling.capped_weights(_weighted(t), "lang", "w", {"en": 0.2, "de": 0.08})
    return d.groupBy("lang").agg(F.round(F.sum("w"), 6).alias("mass"), F.round(F.sum("capped"), 6).alias("capped"))


@query("""WITH r AS (SELECT doc_id, lang, n_chars::DOUBLE AS w, sum(n_chars::DOUBLE) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS run FROM documents WHERE n_chars > 0)
SELECT doc_id, (floor(round(run / 1000.0 - 0.5, 9)) - floor(round((run - w) / 1000.0 - 0.5, 9)))::BIGINT AS draws FROM r""")
def systematic_draw(t):
    return sampling.systematic_draw(_weighted(t), ["lang"], "doc_id", "w", 1000.0).select("doc_id", "draws")


@query("""WITH r AS (SELECT doc_id, source, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS run, sum(n_chars) OVER (PARTITION BY source) AS total FROM documents WHERE n_chars > 0 AND source IS NOT NULL),
c AS (SELECT source, arg_min(run, round(abs(run - 0.3 * total), 9) * 1e9 + run / 1e6) AS stop FROM r GROUP BY source) SELECT source, count(*) FILTER (WHERE run <= stop) AS taken, count(*) AS n FROM r JOIN c USING (source) GROUP BY source""")
def cumulative_split(t):
    d = _weighted(t).where("source is not null")
    return sampling.ordered_prefix(d, ["source"], "doc_id", "w", 0.3).groupBy("source").agg(F.count(F.when(F.col("taken"), 1)).alias("taken"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH g AS (SELECT lang, source, sum(n_chars) AS n, sha256(concat_ws(':', '0', source)) AS h FROM documents WHERE n_chars > 0 AND source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h) AS k, count(*) OVER (PARTITION BY lang) AS c, sum(n) OVER (PARTITION BY lang ORDER BY h ROWS UNBOUNDED PRECEDING) AS run, sum(n) OVER (PARTITION BY lang) AS total FROM g),
b AS (SELECT lang, k AS stop FROM (SELECT lang, k, row_number() OVER (PARTITION BY lang ORDER BY round(abs(run - 0.8 * total), 9), k) AS q FROM r WHERE k < c OR c = 1) WHERE q = 1) SELECT lang, source, k <= stop AS in_first FROM r JOIN b USING (lang)""")
def stratified_group_split(t):
    return sampling.group_split(_weighted(t).where("source is not null and lang is not null"), "lang", "source", "w", 0.8)


@query(f"SELECT source, {_U.format(k='source')} < 0.5 AS in_train, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY ALL")
def group_hash_split(t):
    return t("documents").where("source is not null").groupBy("source", (hash_unit(F.col("source")) < 0.5).alias("in_train")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY ln({_U.format(k='doc_id::VARCHAR')}) / n_chars DESC) AS r FROM documents WHERE n_chars > 0) WHERE r <= 3")
def weighted_choice(t):
    return sampling.weighted_choice(_weighted(t), ["source"], F.col("doc_id").cast("string"), "w", 3).select("source", "doc_id")


@query("""WITH g AS (SELECT coalesce(source, 'none') AS source, sum(n_chars)::DOUBLE AS w FROM documents WHERE n_chars > 0 GROUP BY 1), x AS (SELECT *, 1000.0 * w / sum(w) OVER () AS x FROM g), b AS (SELECT *, floor(round(x, 9)) AS base FROM x),
r AS (SELECT *, 1000 - sum(base) OVER () AS rest, row_number() OVER (ORDER BY round(x - base, 9) DESC, source) AS k FROM b) SELECT source, w, (base + CASE WHEN k <= rest THEN 1 ELSE 0 END)::BIGINT AS "rows" FROM r""")
def largest_remainder(t):
    g = _weighted(t).groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.sum("w").alias("w"))
    return sampling.largest_remainder(g, "w", 1000, "source").withColumn("rows", F.col("rows").cast("bigint"))


@query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY sha256(doc_id::VARCHAR), doc_id) AS r FROM documents WHERE text IS NOT NULL) WHERE r <= 2")
def cap_per_cell(t):
    w = Window.partitionBy("lang", "source").orderBy(F.sha2(F.col("doc_id").cast("string"), 256), "doc_id")
    return t("documents").where("text is not null").withColumn("r", F.row_number().over(w)).where("r <= 2").select("doc_id", "lang", "source")


@query("SELECT doc_id, round(CASE WHEN source = 'court-bulletin' THEN 0.3 ELSE 0.7 END * n_chars / sum(n_chars) OVER (PARTITION BY coalesce(source = 'court-bulletin', false)), 12) AS weight FROM documents WHERE n_chars > 0")
def pool_weights(t):
    """Each pool's mass shared by the factors of its rows; pool sums come from a grouped join, so a hot pool is not gathered."""
    d = _weighted(t).withColumn("pool", F.coalesce(F.col("source") == "court-bulletin", F.lit(False)))
    total = F.broadcast(d.groupBy("pool").agg(F.sum("w").alias("total")))  # one row per pool
    return d.join(total, "pool").select("doc_id", F.round(F.when(F.col("pool"), 0.3).otherwise(0.7) * F.col("w") / F.col("total"), 12).alias("weight"))


@query("""WITH f(lang, a) AS (VALUES ('en', 0.5), ('de', 2.0)), g(source, b) AS (VALUES ('court-bulletin', 0.25)), d AS (SELECT doc_id, coalesce(a, 1.0) * coalesce(b, 1.0) AS w FROM documents LEFT JOIN f USING (lang) LEFT JOIN g USING (source)) SELECT doc_id, round(w / sum(w) OVER (), 12) AS weight FROM d""")
def dimension_weights(t):
    d = t("documents")
    spark = d.sparkSession
    f, g = spark.createDataFrame([("en", 0.5), ("de", 2.0)], "lang string, a double"), spark.createDataFrame([("court-bulletin", 0.25)], "source string, b double")
    j = d.join(F.broadcast(f), "lang", "left").join(F.broadcast(g), "source", "left").select("doc_id", (F.coalesce("a", F.lit(1.0)) * F.coalesce("b", F.lit(1.0))).alias("w"))
    total = j.agg(F.sum("w")).first()[0]
    return j.select("doc_id", F.round(F.col("w") / F.lit(total), 12).alias("weight"))


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 5")
def head_per_language(t):
    return t("documents").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).where("r <= 5").select("doc_id", "lang")


@query("""WITH d AS (SELECT user_id, event_id, ts, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT user_id, count(p) AS gaps, min(event_id - p) AS least, max(event_id - p) AS most FROM d GROUP BY user_id""")
def exposure_gaps(t):
    p = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t("events").withColumn("p", p).groupBy("user_id").agg(F.count("p").alias("gaps"), F.min(F.col("event_id") - F.col("p")).alias("least"), F.max(F.col("event_id") - F.col("p")).alias("most"))


@query("SELECT doc_id, sha256('7:' || doc_id) AS place FROM documents ORDER BY place LIMIT 100")
def hash_shuffle_head(t):
    """A deterministic shuffle, of which the first 100 are wanted."""
    return t("documents").select("doc_id", F.sha2(F.concat(F.lit("7:"), F.col("doc_id").cast("string")), 256).alias("place")).orderBy("place").limit(100)


@query(f"SELECT doc_id, (floor(round(0.3 * 5 + {_U.format(k='doc_id::VARCHAR')}, 9)) - floor(round(0.3 * 4 + {_U.format(k='doc_id::VARCHAR')}, 9)))::BIGINT AS draws FROM documents")
def carried_draw(t):
    d = t("documents").select("doc_id", F.lit(0.3).alias("x"))
    return sampling.carried_draw(d, "x", 4, F.col("doc_id").cast("string")).select("doc_id", "draws")


@query()
def label_floors(t):
    """Factors that lift languages to a floor of the mass; a loop on a small table."""
    mass = {r[0]: float(r[1]) for r in _weighted(t).groupBy(F.coalesce("lang", F.lit("")).alias("g")).agg(F.sum("w")).collect()}
    factors, missing = sampling.floor_weights(mass, {"ko": 0.05, "th": 0.05, "sv": 0.01})
    spark = t("mix_targets").sparkSession
    return spark.createDataFrame([(g, f, g in missing) for g, f in sorted(factors.items())] or [("", 1.0, False)], "lang string, factor double, unattainable boolean")


@query("""WITH r AS (SELECT user_id, value, event_id, 1.5 AS w, coalesce(sum(1.5) OVER (PARTITION BY user_id ORDER BY value DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM events), p AS (SELECT *, greatest(0, least(w, 5 - b)) AS part FROM r)
SELECT user_id, round(sum(part * event_id) / sum(part), 6) AS mean FROM p GROUP BY user_id""")
def neighbour_mean(t):
    e = t("events").select("user_id", "value", F.col("event_id").cast("double").alias("event_id"), F.lit(1.5).alias("w"))
    return sampling.neighbour_mean(e, "user_id", "value", "w", "event_id", 5).withColumn("mean", F.round("mean", 6))


@query("""WITH e AS (SELECT lang, x.label AS label, substring(text, x.start_char + 1, x.end_char - x.start_char) AS surface, corpus FROM (SELECT lang, text, corpus, unnest(spans) AS x FROM canonical_records WHERE text IS NOT NULL)),
c AS (SELECT * FROM (VALUES ('en'), ('de'), ('sv')) a(lang), (VALUES ('person_name'), ('city'), ('organization_name')) b(label)), n AS (SELECT lang, label, count(*) AS examples, count(DISTINCT surface) AS surfaces, count(DISTINCT corpus) AS "groups" FROM e GROUP BY lang, label)
SELECT lang, label, coalesce(examples, 0) AS examples, coalesce(surfaces, 0) AS surfaces, coalesce("groups", 0) AS "groups", greatest(0, 40 - coalesce(surfaces, 0)) AS missing FROM c LEFT JOIN n USING (lang, label) WHERE coalesce(surfaces, 0) < 40 OR coalesce("groups", 0) < 3""")
def support_deficits(t):
    x = t("canonical_records").where("text is not null").select("lang", "text", "corpus", F.explode("spans").alias("x"))
    e = x.select("lang", F.col("x.label").alias("label"), F.substring(F.col("text"), F.col("x.start_char") + 1, F.col("x.end_char") - F.col("x.start_char")).alias("surface"), "corpus")
    cells = e.sparkSession.createDataFrame([(a, b) for a in ("en", "de", "sv") for b in ("person_name", "city", "organization_name")], "lang string, label string")
    return sampling.support_deficits(e, cells, ["lang", "label"], "surface", "corpus", 40, 3)
