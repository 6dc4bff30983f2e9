"""Queries that score spans, sweep thresholds and choose operating points."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import scoring, stats
from ..operators.scoring import prf, ratio
from ..registry import query
from .spans import _GOLD, _PRED, _TEXT, _islands, gold, predicted, texts

_F = "coalesce(2.0 * tp / nullif(predicted + gold, 0), 0)"
_SUM = "sum(tp)::BIGINT AS tp, sum(predicted)::BIGINT AS predicted, sum(coalesce(gold, 0))::BIGINT AS gold"
_CURVE = f"curve AS (SELECT model, threshold, {_F} AS f FROM (SELECT model, threshold, {_SUM} FROM score_counts WHERE coverage = 80 GROUP BY ALL))"


def _counts(t):
    return t("score_counts").withColumn("gold", F.coalesce("gold", F.lit(0)).cast("bigint"))


def _summed(df, *by):
    return df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "predicted", "gold")])


def _curve(t):
    s = _summed(_counts(t).where("coverage = 80"), "model", "threshold")
    return s.select("model", "threshold", ratio(2.0 * F.col("tp"), F.col("predicted") + F.col("gold")).alias("f"))


def _one(gold_sql: str, cover: float) -> str:
    return f"""WITH {_GOLD}, {_PRED}, q AS (SELECT doc, s, e FROM p WHERE model = 'span-a'), {_islands('g', 'doc').replace('i AS', 'gi AS', 1)}, gr AS (SELECT doc, min(s) AS s, max(e) AS e FROM gi GROUP BY doc, island),
{_islands('q', 'doc').replace('i AS', 'pi AS', 1)}, pr AS (SELECT doc, min(s) AS s, max(e) AS e FROM pi GROUP BY doc, island),
m AS (SELECT gr.doc, count(*) AS tp FROM gr JOIN pr ON gr.doc = pr.doc AND least(gr.e, pr.e) - greatest(gr.s, pr.s) >= {cover} * (gr.e - gr.s) AND least(gr.e, pr.e) - greatest(gr.s, pr.s) >= {cover} * (pr.e - pr.s) AND gr.s < pr.e AND pr.s < gr.e GROUP BY gr.doc)
SELECT coalesce(a.doc, b.doc) AS doc, coalesce(tp, 0) AS tp, coalesce(predicted, 0) AS predicted, coalesce(gold, 0) AS gold FROM (SELECT doc, count(*) AS gold FROM gr GROUP BY doc) a FULL JOIN (SELECT doc, count(*) AS predicted FROM pr GROUP BY doc) b ON a.doc = b.doc LEFT JOIN m ON m.doc = coalesce(a.doc, b.doc)"""


@query(_one(_GOLD, 0.8))
def region_counts_80(t):
    return scoring.region_counts(gold(t), predicted(t).where("model = 'span-a'"), 0.8)


@query(_one(_GOLD, 1.0))
def region_counts_exact(t):
    return scoring.region_counts(gold(t), predicted(t).where("model = 'span-a'"), 1.0)


@query(f"""WITH {_GOLD}, {_PRED}, x AS (SELECT DISTINCT doc, s, e, label, 1 AS g FROM g WHERE label IS NOT NULL), y AS (SELECT DISTINCT doc, s, e, label, 1 AS p FROM p WHERE label IS NOT NULL AND model = 'span-a')
SELECT label, count(*) FILTER (WHERE g = 1 AND p = 1) AS tp, count(p) AS predicted, count(g) AS gold FROM x FULL JOIN y USING (doc, s, e, label) GROUP BY label""")
def typed_set_scores(t):
    return scoring.typed_counts(gold(t).where("label is not null"), predicted(t).where("model = 'span-a' and label is not null"))


@query(f"""WITH {_GOLD}, {_PRED}, {_TEXT}, a AS (SELECT DISTINCT doc, unnest(range(s, e)) AS k FROM g), b AS (SELECT DISTINCT doc, unnest(range(s, e)) AS k FROM p WHERE model = 'span-a'),
n AS (SELECT doc, length(text) AS n FROM t WHERE text IS NOT NULL), c AS (SELECT coalesce(a.doc, b.doc) AS doc, count(a.k) AS ga, count(b.k) AS pb, count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS tp FROM a FULL JOIN b ON a.doc = b.doc AND a.k = b.k GROUP BY 1)
SELECT n.doc, coalesce(tp, 0) AS tp, coalesce(pb - tp, 0) AS fp, coalesce(ga - tp, 0) AS fn, n.n - coalesce(ga + pb - tp, 0) AS tn FROM n LEFT JOIN c ON n.doc = c.doc""")
def character_confusion(t):
    n = texts(t).where("text is not null").select("doc", F.length("text").alias("n"))
    return scoring.character_counts(gold(t), predicted(t).where("model = 'span-a'"), n)


@query(f"""WITH {_GOLD}, {_PRED}, x AS (SELECT DISTINCT doc, s, e, label FROM g) SELECT label, count(*) AS gold, count(*) FILTER (WHERE h) AS hit, round(count(*) FILTER (WHERE h) / count(*), 9) AS recall
FROM (SELECT *, EXISTS (SELECT 1 FROM p WHERE p.doc = x.doc AND p.s < x.e AND x.s < p.e) AS h FROM x) WHERE label IS NOT NULL GROUP BY label""")
def recall_by_label(t):
    return scoring.recall_by_label(gold(t).where("label is not null"), predicted(t)).withColumn("recall", F.round("recall", 9))


@query()
def nested_matching(t):
    """Maximum one-to-one matching of raw spans, which may nest: an augmenting path has no SQL form."""
    from ..operators.intervals import overlaps

    pairs = overlaps(gold(t), predicted(t).where("model = 'span-a'"), 0.5)
    key = lambda s, e, l: F.concat_ws(":", s, e, F.coalesce(l, F.lit("")))  # noqa: E731, E741
    return scoring.maximum_matching(pairs.select("doc", key("s", "e", F.col("label")).alias("g"), key("r_s", "r_e", F.col("r_label")).alias("p")).distinct())


@query(f"""SELECT model, threshold, lang, grouping(lang)::INT AS all_panels, {_SUM}, round(coalesce(sum(tp) / nullif(sum(predicted), 0), 0), 9) AS "precision", round(coalesce(sum(tp) / nullif(sum(coalesce(gold, 0)), 0), 0), 9) AS recall, round(coalesce(2.0 * sum(tp) / nullif(sum(predicted) + sum(coalesce(gold, 0)), 0), 0), 9) AS f
FROM score_counts WHERE coverage = 80 GROUP BY GROUPING SETS ((model, threshold, lang), (model, threshold))""")
def pooled_by_language(t):
    p = scoring.pooled(_counts(t).where("coverage = 80"), ["model", "threshold"])
    return p.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f")}).withColumn("all_panels", F.col("all_panels").cast("int"))


@query(f"""WITH l AS (SELECT model, lang, {_SUM} FROM score_counts WHERE coverage = 100 GROUP BY ALL) SELECT model, round(sum(gold * {_F}) / sum(gold), 9) AS macro_f FROM l WHERE lang IS NOT NULL GROUP BY model""")
def weighted_macro(t):
    s = _summed(_counts(t).where("coverage = 100 and lang is not null"), "model", "lang")
    f = ratio(2.0 * F.col("tp"), F.col("predicted") + F.col("gold"))
    return s.groupBy("model").agg(F.round(F.sum(F.col("gold") * f) / F.sum("gold"), 9).alias("macro_f"))


@query(f"""SELECT id, model, coverage, {_SUM}, round(coalesce(5.0 * sum(tp) / nullif(4 * sum(coalesce(gold, 0)) + sum(predicted), 0), 0), 9) AS f2 FROM score_counts GROUP BY id, model, coverage""")
def document_counts(t):
    s = _summed(_counts(t), "id", "model", "coverage")
    return s.select("*", F.round(prf(F.col("tp"), F.col("predicted"), F.col("gold"), 2.0)[2], 9).alias("f2"))


@query(f"WITH {_CURVE} SELECT model, threshold, round(f, 9) AS f FROM curve")
def threshold_curve(t):
    return _curve(t).withColumn("f", F.round("f", 9))


@query(f"WITH {_CURVE}, r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(f, 12) DESC, round(abs(threshold - 0.5), 9), threshold) AS k FROM curve) SELECT model, threshold, round(f, 9) AS f FROM r WHERE k = 1")
def select_threshold(t):
    return stats.best_threshold(_curve(t), ["model"]).withColumn("f", F.round("f", 9))


@query(f"""WITH {_CURVE}, r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(f, 12) DESC, round(abs(threshold - 0.5), 9), threshold) AS k FROM curve), b AS (SELECT model, threshold AS best, f AS top FROM r WHERE k = 1),
j AS (SELECT curve.*, best, curve.f >= top - 0.01 AS inside FROM curve JOIN b USING (model)), w AS (SELECT *, sum(CASE WHEN inside THEN 0 ELSE 1 END) OVER (PARTITION BY model ORDER BY threshold) AS run FROM j),
h AS (SELECT model, run FROM w WHERE threshold = best), i AS (SELECT w.*, row_number() OVER (PARTITION BY w.model ORDER BY threshold) AS k, count(*) OVER (PARTITION BY w.model) AS n FROM w JOIN h USING (model, run) WHERE inside)
SELECT model, any_value(best) AS best, min(threshold) AS low, max(threshold) AS high, max(CASE WHEN k = (n + 1) // 2 THEN threshold END) AS middle, any_value(n) AS n FROM i GROUP BY model""")
def trust_region(t):
    return stats.trust_region(_curve(t), ["model"], 0.01)


@query(f"""WITH dev AS (SELECT model, threshold, {_F} AS f FROM (SELECT model, threshold, {_SUM} FROM score_counts WHERE coverage = 80 AND lang = 'en' GROUP BY ALL)), r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(f, 12) DESC, round(abs(threshold - 0.5), 9), threshold) AS k FROM dev),
e AS (SELECT model, threshold, lang, {_SUM} FROM score_counts WHERE coverage = 80 AND lang <> 'en' GROUP BY ALL) SELECT e.model, e.lang, e.threshold, round({_F}, 9) AS f FROM e JOIN r USING (model, threshold) WHERE k = 1""")
def operating_points(t):
    """Thresholds chosen on one language, scored on the others."""
    c = _counts(t).where("coverage = 80")
    f = ratio(2.0 * F.col("tp"), F.col("predicted") + F.col("gold"))
    dev = _summed(c.where("lang = 'en'"), "model", "threshold").select("model", "threshold", f.alias("f"))
    best = F.broadcast(stats.best_threshold(dev, ["model"]).select("model", "threshold"))  # one row per model
    return _summed(c.where("lang <> 'en'"), "model", "threshold", "lang").join(best, ["model", "threshold"]).select("model", "lang", "threshold", F.round(f, 9).alias("f"))


@query(f"WITH {_CURVE}, d AS (SELECT threshold, avg(f) AS f, stddev_samp(f) AS se FROM curve GROUP BY threshold), b AS (SELECT f - se AS least FROM d ORDER BY f DESC, threshold LIMIT 1) SELECT threshold, round(f, 9) AS f FROM d, b WHERE f >= least ORDER BY threshold LIMIT 1")
def one_standard_error(t):
    d = _curve(t).groupBy("threshold").agg(F.avg("f").alias("f"), F.stddev_samp("f").alias("se"))
    return stats.one_standard_error(d, "f", "se", "threshold").select("threshold", F.round("f", 9).alias("f"))


@query(f"""WITH {_PRED}, k AS (SELECT model, threshold, count(*) FILTER (WHERE score >= threshold - 1e-9) AS kept FROM p, (VALUES (0.4), (0.5), (0.6), (0.7), (0.8), (0.9)) v(threshold) GROUP BY ALL) SELECT * FROM k""")
def threshold_emulation(t):
    """Points at higher thresholds from one run at a low one; conditional counts instead of a join with the grid."""
    grid = (0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
    c = predicted(t).groupBy("model").agg(*[F.count(F.when(F.col("score") >= x - 1e-9, 1)).alias(f"k{i}") for i, x in enumerate(grid)])
    return c.select("model", F.explode(F.array(*[F.struct(F.lit(x).alias("threshold"), F.col(f"k{i}").alias("kept")) for i, x in enumerate(grid)])).alias("x")).select("model", "x.*")


@query()
def paired_bootstrap(t):
    """Resampled difference of two models on the same groups."""
    c = _counts(t).where("coverage = 80 and threshold = 0.5")
    side = lambda m, p: [F.sum(F.when(F.col("model") == m, F.col(c)).otherwise(0)).alias(f"{p}_{c}") for c in ("tp", "predicted", "gold")]
    return stats.paired_bootstrap(c.groupBy("group_id").agg(*side("span-a", "a"), *side("span-b", "b")), "group_id", 10_000)


@query(f"""WITH l AS (SELECT model, threshold, lang, {_SUM} FROM score_counts WHERE coverage = 80 AND lang IS NOT NULL GROUP BY ALL) SELECT model, threshold, round(avg({_F}), 9) AS f, row_number() OVER (ORDER BY round(avg({_F}), 9) DESC, model, threshold) AS place FROM l GROUP BY model, threshold""")
def checkpoint_ranking(t):
    f = ratio(2.0 * F.col("tp"), F.col("predicted") + F.col("gold"))
    s = _summed(_counts(t).where("coverage = 80 and lang is not null"), "model", "threshold", "lang").groupBy("model", "threshold").agg(F.round(F.avg(f), 9).alias("f"))
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.desc("f"), "model", "threshold")).cast("bigint"))


@query("SELECT model, threshold, count(*) AS n, sum(tp)::BIGINT AS tp FROM score_counts GROUP BY model, threshold")
def columnar_receipt(t):
    """Rows packed into one array of counts per model and threshold, and expanded again: the expansion has every row of the input."""
    packed = t("score_counts").groupBy("model", "threshold", F.pmod(F.xxhash64("id"), F.lit(16)).alias("part")).agg(F.collect_list(F.struct("id", "tp", "predicted", "gold")).alias("rows"))
    return packed.select("model", "threshold", F.explode("rows").alias("r")).groupBy("model", "threshold").agg(F.count(F.lit(1)).alias("n"), F.sum("r.tp").alias("tp"))


@query("""WITH a AS (SELECT model, threshold, sum(tp)::DOUBLE AS v FROM score_counts WHERE coverage = 80 GROUP BY ALL), b AS (SELECT model, threshold, v + CASE WHEN threshold = 0.5 THEN 1 ELSE 0 END AS v FROM a WHERE threshold <> 0.9)
SELECT a.model, a.threshold, CASE WHEN b.v IS NULL THEN 'missing' ELSE 'differs' END AS difference FROM a LEFT JOIN b USING (model, threshold) WHERE b.v IS NULL OR abs(a.v - b.v) > 1e-12""")
def receipt_difference(t):
    """Published values that are missing from a recomputation or differ by more than the tolerance; extra values of the recomputation don't count."""
    s = _counts(t).where("coverage = 80")
    a = s.groupBy("model", "threshold").agg(F.sum("tp").cast("double").alias("v"))
    b = s.where("threshold <> 0.9").groupBy("model", "threshold").agg((F.sum("tp") + F.when(F.col("threshold") == 0.5, 1).otherwise(0)).cast("double").alias("w"))
    j = a.join(b, ["model", "threshold"], "left").where(F.col("w").isNull() | (F.abs(F.col("v") - F.col("w")) > 1e-12))
    return j.select("model", "threshold", F.when(F.col("w").isNull(), "missing").otherwise("differs").alias("difference"))
