"""Queries on spans: islands, cuts, coverage, agreement, redaction, label maps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import segments, tagset
from ..registry import query

#: A small forest of the labels in the tables: node, parent (fixed values).
FOREST = [("person_name", "person"), ("government_id", "person"), ("person", "private"), ("phone_number", "contact"), ("email_address", "contact"), ("contact", "private"), ("street_address", "place"), ("city", "place"), ("place", None), ("private", None), ("date", "time"), ("time", None), ("organization_name", "party"), ("party", None)]
CUT = ["person", "contact", "place", "time", "party"]
_FOREST = "(VALUES " + ", ".join(f"('{n}', " + ("NULL" if p is None else f"'{p}'") + ")" for n, p in FOREST) + ") AS f(node, parent)"
_CLOSURE = f"RECURSIVE c AS (SELECT node, node AS ancestor, 0 AS steps FROM {_FOREST} UNION ALL SELECT c.node, f.parent, steps + 1 FROM c JOIN {_FOREST} ON c.ancestor = f.node WHERE f.parent IS NOT NULL)"

#: One row per record and per prediction row: redelivered and repeated rows are taken once.
_GOLD = "g AS (SELECT DISTINCT id AS doc, x.start_char AS s, x.end_char AS e, x.label AS label FROM (SELECT id, unnest(spans) AS x FROM canonical_records) WHERE x.start_char >= 0 AND x.end_char > x.start_char)"
_PRED = "p AS (SELECT DISTINCT id AS doc, model, x.start_char AS s, x.end_char AS e, x.label AS label, x.score AS score FROM (SELECT id, model, unnest(preds) AS x FROM predictions) WHERE x.start_char >= 0 AND x.end_char > x.start_char)"
_TEXT = "t AS (SELECT id AS doc, max(text) AS text FROM canonical_records GROUP BY id)"


def gold(t):
    return iv.explode_spans(t("canonical_records"), "id", "spans").distinct()


def predicted(t):
    x = t("predictions").select(F.col("id").alias("doc"), "model", F.explode("preds").alias("x"))
    return iv.valid(x.select("doc", "model", F.col("x.start_char").alias("s"), F.col("x.end_char").alias("e"), F.col("x.label").alias("label"), F.col("x.score").alias("score"))).distinct()


def texts(t):
    return t("canonical_records").groupBy(F.col("id").alias("doc")).agg(F.max("text").alias("text"))


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE x.start_char IS NULL OR x.end_char IS NULL OR x.start_char < 0 OR x.end_char <= x.start_char) AS malformed, count(*) FILTER (WHERE x.end_char > length(text)) AS beyond, count(*) FILTER (WHERE x.label IS NULL) AS unlabelled
FROM (SELECT text, unnest(spans) AS x FROM canonical_records)""")
def span_validation(t):
    x = t("canonical_records").select("text", F.explode("spans").alias("x"))
    bad = F.col("x.start_char").isNull() | F.col("x.end_char").isNull() | (F.col("x.start_char") < 0) | (F.col("x.end_char") <= F.col("x.start_char"))
    return x.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(bad, 1)).alias("malformed"), F.count(F.when(F.col("x.end_char") > F.length("text"), 1)).alias("beyond"), F.count(F.when(F.col("x.label").isNull(), 1)).alias("unlabelled"))


@query("SELECT CASE WHEN spans IS NULL THEN 'unknown' WHEN len(spans) = 0 THEN 'negative' ELSE 'spans' END AS state, count(*) AS n FROM canonical_records GROUP BY 1")
def label_states(t):
    state = F.when(F.col("spans").isNull(), "unknown").when(F.size("spans") == 0, "negative").otherwise("spans")
    return t("canonical_records").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def _islands(source: str, by: str, gap: int = 0) -> str:
    return f"""i AS (SELECT *, sum(new) OVER (PARTITION BY {by} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY {by} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS new FROM {source}))"""


@query(f"WITH {_GOLD}, {_islands('g', 'doc')} SELECT doc, min(s) AS s, max(e) AS e, count(*) AS n FROM i GROUP BY doc, island")
def merge_regions(t):
    return iv.merge_regions(gold(t))


@query(f"WITH {_PRED}, {_islands('p', 'doc, model', 1)} SELECT doc, model, min(s) AS s, max(e) AS e, count(*) AS n FROM i GROUP BY doc, model, island")
def merge_touching_by_model(t):
    return iv.merge_regions(predicted(t), ["model"], 1)


@query(f"""WITH {_GOLD}, {_islands('g', 'doc')} SELECT doc, count(DISTINCT island) AS regions, sum(e - s)::BIGINT AS characters FROM (SELECT doc, island, min(s) AS s, max(e) AS e FROM i GROUP BY doc, island) GROUP BY doc""")
def maximal_intervals(t):
    return iv.merge_regions(gold(t)).groupBy("doc").agg(F.count(F.lit(1)).alias("regions"), F.sum(F.col("e") - F.col("s")).alias("characters"))


@query(f"""WITH {_GOLD}, {_TEXT}, j AS (SELECT g.*, t.text, max(e) OVER (PARTITION BY doc, label ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM g JOIN t USING (doc)),
k AS (SELECT *, CASE WHEN b IS NOT NULL AND (s <= b OR (s > b AND regexp_matches(substring(text, b + 1, s - b), '^[ \\t\\n\\r\\f\\v]+$'))) THEN 0 ELSE 1 END AS new FROM j),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc, label ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM k)
SELECT doc, label, min(s) AS s, max(e) AS e, count(*) AS n FROM i GROUP BY doc, label, island""")
def merge_adjacent_same_label(t):
    return iv.merge_adjacent(gold(t), texts(t))


@query(f"""WITH {_GOLD}, {_PRED}, c AS (SELECT doc, unnest(range(s, e)) AS k FROM g GROUP BY doc, s, e), h AS (SELECT DISTINCT doc, unnest(range(s, e)) AS k FROM p WHERE model = 'span-a'),
r AS (SELECT DISTINCT doc, k FROM c WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc = c.doc AND h.k = c.k)), q AS (SELECT doc, k, k - row_number() OVER (PARTITION BY doc ORDER BY k) AS run FROM r)
SELECT doc, min(k)::INT AS s, (max(k) + 1)::INT AS e FROM q GROUP BY doc, run""")
def subtract_intervals(t):
    return iv.subtract(gold(t), predicted(t).where("model = 'span-a'"))


@query(f"WITH {_GOLD}, {_PRED} SELECT g.doc, g.s, g.e, g.label, p.s AS r_s, p.e AS r_e, p.model AS r_model, least(g.e, p.e) - greatest(g.s, p.s) AS shared FROM g JOIN p ON g.doc = p.doc AND g.s < p.e AND p.s < g.e WHERE (least(g.e, p.e) - greatest(g.s, p.s)) >= 0.8 * (g.e - g.s) AND (least(g.e, p.e) - greatest(g.s, p.s)) >= 0.8 * (p.e - p.s)")
def coverage_join(t):
    return iv.overlaps(gold(t), predicted(t).drop("label", "score"), 0.8).select("doc", "s", "e", "label", "r_s", "r_e", "r_model", "shared")


@query(f"WITH {_GOLD}, {_PRED} SELECT p.model AS r_model, count(*) AS pairs, sum(least(g.e, p.e) - greatest(g.s, p.s))::BIGINT AS shared FROM g JOIN p ON g.doc = p.doc AND g.s < p.e AND p.s < g.e GROUP BY p.model")
def any_intersection(t):
    return iv.overlaps(gold(t), predicted(t)).groupBy("r_model").agg(F.count(F.lit(1)).alias("pairs"), F.sum("shared").alias("shared"))


@query(f"WITH {_GOLD}, {_PRED} SELECT g.label, count(*) AS n FROM g JOIN p ON g.doc = p.doc AND p.s <= g.s AND g.e <= p.e GROUP BY g.label")
def containment_join(t):
    return iv.contained(gold(t), predicted(t)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_GOLD}, {_PRED} SELECT p.doc, p.model, p.s, p.e, p.label, p.score FROM p WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc = p.doc AND g.s < p.e AND p.s < g.e)")
def range_anti_join(t):
    return iv.not_overlapping(predicted(t), gold(t))


@query(f"WITH {_GOLD}, {_TEXT} SELECT a.doc, a.s, a.e, b.s AS r_s, b.e AS r_e FROM g a JOIN g b ON a.doc = b.doc AND b.s >= a.e JOIN t ON t.doc = a.doc WHERE regexp_matches(substring(t.text, a.e + 1, b.s - a.e), '^[ \\t\\n\\r\\f\\v]*$') AND length(t.text) >= b.s")
def adjacency_join(t):
    g = gold(t)
    r = g.select("doc", F.col("s").alias("r_s"), F.col("e").alias("r_e"))
    j = g.select("doc", "s", "e", "label").join(r, "doc").where("r_s >= e").join(texts(t), "doc")
    return j.where(F.substring(F.col("text"), F.col("e") + 1, F.col("r_s") - F.col("e")).rlike(r"^\s*$") & (F.length("text") >= F.col("r_s"))).select("doc", "s", "e", "r_s", "r_e")


@query(f"WITH {_GOLD}, {_PRED}, j AS (SELECT g.doc, g.s, g.e, p.model, p.s AS r_s, p.e AS r_e, greatest(0, least(g.e, p.e) - greatest(g.s, p.s)) AS x FROM g JOIN p ON g.doc = p.doc AND g.label = p.label) SELECT model, count(*) AS close FROM j WHERE x / (greatest(e, r_e) - least(s, r_s)) >= 0.8 OR (abs(s - r_s) <= 1 AND abs(e - r_e) <= 1) GROUP BY model")
def iou_or_edges(t):
    g, p = gold(t), predicted(t).select("doc", "model", "label", F.col("s").alias("r_s"), F.col("e").alias("r_e"))
    both = F.greatest(F.lit(0), F.least("e", "r_e") - F.greatest("s", "r_s"))
    j = g.join(p, ["doc", "label"])
    return j.where((both / (F.greatest("e", "r_e") - F.least("s", "r_s")) >= 0.8) | ((F.abs(F.col("s") - F.col("r_s")) <= 1) & (F.abs(F.col("e") - F.col("r_e")) <= 1))).groupBy("model").agg(F.count(F.lit(1)).alias("close"))


@query(f"WITH {_PRED}, q AS (SELECT DISTINCT doc, model, s, e FROM p) SELECT a.doc, a.s, a.e, a.model, count(DISTINCT b.model) AS voters FROM q a JOIN q b ON a.doc = b.doc AND a.s < b.e AND b.s < a.e GROUP BY ALL HAVING count(DISTINCT b.model) >= 2")
def agreement_of_models(t):
    return iv.agreement(predicted(t).select("doc", "model", "s", "e").distinct(), "model", 2)


@query(f"WITH {_PRED} SELECT doc, s, e, label, count(DISTINCT model) AS models FROM p GROUP BY doc, s, e, label")
def union_of_predictions(t):
    return predicted(t).groupBy("doc", "s", "e", "label").agg(F.count_distinct("model").alias("models"))


@query(f"""WITH {_GOLD}, {_PRED}, l AS (SELECT DISTINCT doc, s, e FROM g), r AS (SELECT DISTINCT doc, s, e FROM p WHERE model = 'span-b'),
x AS (SELECT l.doc, l.s, l.e, l.s AS r_s, l.e AS r_e, 'exact' AS tier FROM l JOIN r USING (doc, s, e)), l2 AS (SELECT * FROM l ANTI JOIN r USING (doc, s, e)), r2 AS (SELECT * FROM r ANTI JOIN l USING (doc, s, e)),
o AS (SELECT l2.doc, l2.s, l2.e, r2.s AS r_s, r2.e AS r_e FROM l2 JOIN r2 ON l2.doc = r2.doc AND least(l2.e, r2.e) - greatest(l2.s, r2.s) >= 0.8 * (l2.e - l2.s) AND least(l2.e, r2.e) - greatest(l2.s, r2.s) >= 0.8 * (r2.e - r2.s)),
c AS (SELECT *, count(*) OVER (PARTITION BY doc, s, e) AS nl, count(*) OVER (PARTITION BY doc, r_s, r_e) AS nr FROM o)
SELECT * FROM x UNION ALL SELECT doc, s, e, r_s, r_e, 'unique' FROM c WHERE nl = 1 AND nr = 1""")
def unique_counterparts(t):
    return iv.unique_counterparts(gold(t), predicted(t).where("model = 'span-b'"))


@query(f"""WITH {_GOLD}, {_PRED}, m AS (SELECT g.label, p.label AS r_label, p.model, CASE WHEN g.s = p.s AND g.e = p.e AND g.label = p.label THEN 'exact' WHEN g.label = p.label THEN 'boundary' WHEN g.s = p.s AND g.e = p.e THEN 'label' ELSE 'both' END AS tier FROM g JOIN p ON g.doc = p.doc AND g.s < p.e AND p.s < g.e WHERE g.label IS NOT NULL AND p.label IS NOT NULL)
SELECT model, label, tier, count(*) AS n FROM m GROUP BY model, label, tier""")
def agreement_tiers(t):
    o = iv.overlaps(gold(t), predicted(t)).where("label is not null and r_label is not null")
    same = (F.col("s") == F.col("r_s")) & (F.col("e") == F.col("r_e"))
    tier = F.when(same & (F.col("label") == F.col("r_label")), "exact").when(F.col("label") == F.col("r_label"), "boundary").when(same, "label").otherwise("both")
    return o.groupBy(F.col("r_model").alias("model"), "label", tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_PRED}, w AS (SELECT *, row_number() OVER (PARTITION BY doc, s, e ORDER BY score DESC, label, model) AS r FROM p WHERE label IS NOT NULL) SELECT doc, s, e, label, round(score, 9) AS score FROM w WHERE r = 1")
def best_confidence_merge(t):
    w = Window.partitionBy("doc", "s", "e").orderBy(F.desc("score"), "label", "model")
    return predicted(t).where("label is not null").withColumn("r", F.row_number().over(w)).where("r = 1").select("doc", "s", "e", "label", F.round("score", 9).alias("score"))


@query(f"WITH {_PRED}, v AS (SELECT doc, s, e, label, count(*) AS votes, max(score) AS top FROM p WHERE label IS NOT NULL GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY doc, s, e ORDER BY votes DESC, top DESC, label) AS r FROM v) SELECT doc, s, e, label, votes FROM w WHERE r = 1")
def duplicate_vote(t):
    v = predicted(t).where("label is not null").groupBy("doc", "s", "e", "label").agg(F.count(F.lit(1)).alias("votes"), F.max("score").alias("top"))
    w = Window.partitionBy("doc", "s", "e").orderBy(F.desc("votes"), F.desc("top"), "label")
    return v.withColumn("r", F.row_number().over(w)).where("r = 1").select("doc", "s", "e", "label", "votes")


@query()
def resolve_overlaps(t):
    """Greedy, longest first; the result of one span depends on those kept before, which plain SQL doesn't express."""
    return t("canonical_records").where("spans is not null").select("id", F.explode(iv.greedy_longest("spans")).alias("x")).select("id", "x.*")


@query()
def redact_spans(t):
    c = t("canonical_records").where("text is not null")
    return c.select("id", iv.replace_spans(F.col("text"), iv.greedy_longest("spans")).alias("redacted")).distinct()


@query()
def mask_carrier(t):
    """Texts with every span replaced by its label in angle brackets, in the shared normal form: the carrier around the values."""
    from ..functions.text import norm_sql

    c = t("canonical_records").where("text is not null")
    masked = norm_sql(iv.replace_spans(F.col("text"), iv.greedy_longest("spans"), "<", ">"))
    return c.select("id", masked.alias("carrier")).distinct().groupBy("carrier").agg(F.count_distinct("id").alias("n"))


@query(rf"""WITH {_GOLD}, {_TEXT}, v AS (SELECT g.*, substring(t.text, s + 1, e - s) AS v FROM g JOIN t USING (doc) WHERE text IS NOT NULL AND e <= length(text)),
l AS (SELECT *, length(v) - length(regexp_replace(v, '^[ \t\n\r\f\v]+', '')) AS a, length(v) - length(regexp_replace(v, '[ \t\n\r\f\v]+$', '')) AS z FROM v)
SELECT doc, label, (s + a)::INT AS s, (e - z)::INT AS e FROM l WHERE a + z < e - s""")
def trim_edges(t):
    j = gold(t).join(texts(t), "doc").where(F.col("text").isNotNull() & (F.col("e") <= F.length("text")))
    return j.select("doc", "label", iv.trim_edges(F.col("text"), F.col("s"), F.col("e")).alias("x")).where("x is not null").select("doc", "label", "x.s", "x.e")


@query(f"""WITH {_GOLD}, {_TEXT}, w AS (SELECT doc, text, unnest(range(0, greatest(0, ceil((length(text) - 120) / 80.0))::INT + 1)) AS k FROM t WHERE length(text) > 0),
x AS (SELECT doc, k::INT AS no, (k * 80)::INT AS ws, least(k * 80 + 120, length(text))::INT AS we FROM w)
SELECT g.doc, x.no, g.s - x.ws AS s, g.e - x.ws AS e, g.label FROM g JOIN x ON g.doc = x.doc AND x.ws <= g.s AND g.e <= x.we""")
def split_gold(t):
    w = segments.slices(texts(t), "doc", "text", 120, 80).select("doc", "no", F.col("s").alias("ws"), F.col("e").alias("we"))
    return gold(t).join(w, "doc").where("ws <= s and e <= we").select("doc", "no", (F.col("s") - F.col("ws")).alias("s"), (F.col("e") - F.col("ws")).alias("e"), "label")


@query()
def bounded_segments(t):
    one = t("canonical_records").where("text is not null").groupBy("id").agg(F.max_by(F.struct("text", "spans"), "ingested_at").alias("x")).select("id", "x.*")
    return segments.bounded_segments(one, "id", "text", "spans", 160)


@query("""WITH p AS (SELECT id, text, string_split(text, ' ') AS w FROM (SELECT id, max(text) AS text FROM canonical_records GROUP BY id) WHERE text IS NOT NULL), k AS (SELECT id, unnest(w) AS token, unnest(range(len(w))) AS no FROM p),
o AS (SELECT *, coalesce(sum(length(token) + 1) OVER (PARTITION BY id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS s FROM k),
b AS (SELECT *, regexp_matches(token, '[0-9]') AS hit FROM o), c AS (SELECT *, hit AND NOT coalesce(lag(hit) OVER (PARTITION BY id ORDER BY no), false) AS new FROM b),
i AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY no ROWS UNBOUNDED PRECEDING) AS n FROM c WHERE true)
SELECT id AS doc, min(s)::INT AS s, max(s + length(token))::INT AS e, 'NUM' AS label FROM i WHERE hit GROUP BY id, n""")
def token_label_spans(t):
    tokens = texts(t).where("text is not null").select("doc", F.posexplode(F.split("text", " ")).alias("no", "token"))
    hit = F.col("token").rlike("[0-9]")
    before = F.coalesce(F.lag(hit).over(Window.partitionBy("doc").orderBy("no")), F.lit(False))
    tagged = tokens.withColumn("tag", F.when(hit & ~before, "B-NUM").when(hit, "I-NUM").otherwise("O"))
    return segments.token_spans(tagged)


@query("SELECT id, text, lang, row_number() OVER (PARTITION BY id ORDER BY ingested_at, captured_at, text NULLS FIRST, lang NULLS FIRST) AS nth, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY ingested_at, captured_at, text NULLS FIRST, lang NULLS FIRST) = 1 THEN id ELSE id || '~' || row_number() OVER (PARTITION BY id ORDER BY ingested_at, captured_at, text NULLS FIRST, lang NULLS FIRST) END AS unique_id FROM canonical_records")
def id_disambiguation(t):
    nth = F.row_number().over(Window.partitionBy("id").orderBy("ingested_at", "captured_at", F.asc_nulls_first("text"), F.asc_nulls_first("lang")))
    return t("canonical_records").select("id", "text", "lang", nth.alias("nth")).withColumn("unique_id", F.when(F.col("nth") == 1, F.col("id")).otherwise(F.concat("id", F.lit("~"), F.col("nth").cast("string"))))


@query("""WITH w AS (SELECT doc_id, window_id, text, start_char FROM text_windows WHERE start_char IS NOT NULL)
SELECT window_id, lag(text) OVER (PARTITION BY doc_id ORDER BY start_char, window_id) AS before, lead(text) OVER (PARTITION BY doc_id ORDER BY start_char, window_id) AS after FROM w""")
def neighbor_context(t):
    w = t("text_windows").where("start_char is not null").select(F.col("doc_id").alias("doc"), F.struct("start_char", "window_id").alias("no"), "text", "window_id")
    return segments.context(w).select("window_id", "before", "after")


@query(f"WITH {_CLOSURE}, n AS (SELECT node, arg_min(ancestor, steps) AS target FROM c WHERE ancestor IN ({', '.join(repr(x) for x in CUT)}) GROUP BY node), {_GOLD} SELECT g.label, n.target, count(*) AS n FROM g LEFT JOIN n ON g.label = n.node GROUP BY g.label, n.target")
def tagset_projection(t):
    g = gold(t)
    spark = g.sparkSession
    nodes, cut = spark.createDataFrame(FOREST, "node string, parent string"), spark.createDataFrame([(x,) for x in CUT], "node string")
    return tagset.project(g, nodes, cut).groupBy("label", "target").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_CLOSURE} SELECT a.node AS x, b.node AS y, arg_min(a.ancestor, a.steps + b.steps) AS lca FROM c a JOIN c b ON a.ancestor = b.ancestor WHERE a.node < b.node GROUP BY a.node, b.node")
def tagset_common_ancestor(t):
    spark = t("mix_targets").sparkSession
    names = sorted(n for n, _ in FOREST)
    nodes = spark.createDataFrame(FOREST, "node string, parent string")
    pairs = spark.createDataFrame([(a, b) for k, a in enumerate(names) for b in names[k + 1 :]], "x string, y string")
    return tagset.common_ancestor(pairs, nodes).where("lca is not null")


@query("""WITH o AS (SELECT x.source_label AS source, x.label AS target FROM (SELECT unnest(spans) AS x FROM canonical_records) WHERE x.source_label IS NOT NULL AND x.label IS NOT NULL), n AS (SELECT source, target, count(*) AS n FROM o GROUP BY ALL)
SELECT source, target, n, round(n / sum(n) OVER (PARTITION BY source), 9) AS share, CASE WHEN source = 'PERSON' AND target = 'person_name' THEN 'defined' WHEN n >= 5 AND n / sum(n) OVER (PARTITION BY source) >= 0.1 THEN 'observed' ELSE 'off_map' END AS kind FROM n""")
def reconcile_label_map(t):
    o = t("canonical_records").select(F.explode("spans").alias("x")).select(F.col("x.source_label").alias("source"), F.col("x.label").alias("target")).where("source is not null and target is not null")
    defined = o.sparkSession.createDataFrame([("PERSON", "person_name")], "source string, target string")
    return tagset.reconcile(o, defined, 5, 0.1).withColumn("share", F.round("share", 9))


@query()
def rare_label_collapse(t):
    g = gold(t).where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return tagset.collapse_rare(g, g.sparkSession.createDataFrame(FOREST, "node string, parent string"), 300)


@query()
def rule_scan(t):
    """Matches of the default rules with offsets in code points."""
    from ..operators import rules

    return rules.scan(t("documents"), rules.DEFAULT_RULES, "doc_id", "raw_text")


@query()
def rule_scores(t):
    from ..operators import rules

    return rules.scores(rules.scan(t("documents"), rules.DEFAULT_RULES, "doc_id", "raw_text"))


def _record_rules(t):
    from ..operators import rules

    return rules.scan(texts(t), rules.DEFAULT_RULES, "doc", "text")


@query()
def rule_arbitration(t):
    from ..operators import rules

    return rules.arbitrate(gold(t), _record_rules(t), "skip")


@query()
def rule_detail(t):
    from ..operators import rules

    return rules.attach_detail(gold(t).where("label is not null"), _record_rules(t))


@query()
def rule_completion(t):
    from ..operators import rules

    source = texts(t).select("doc", F.split_part("doc", F.lit("/"), F.lit(1)).alias("source"))
    return rules.complete(gold(t), _record_rules(t), source)[1]


@query("SELECT pmod_bucket AS part, count(*) AS n FROM (SELECT length(text) % 8 AS pmod_bucket FROM documents WHERE length(text) >= 4) GROUP BY 1")
def texts_with_postings(t):
    """Texts that have postings, by their length modulo 8."""
    from ..sources.files import postings

    d = t("documents")
    ids = postings(d, "doc_id", "text", (4,)).select(F.col("id").alias("doc_id")).distinct()
    return d.join(ids, "doc_id", "left_semi").groupBy((F.length("text") % 8).alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query()
def flat_views(t):
    """Overlapping spans in layers; a span's layer depends on those placed before it."""
    return t("canonical_records").where("spans is not null").select("id", F.explode(iv.layers("spans")).alias("x")).select("id", "x.*")


@query()
def best_schedules(t):
    return iv.schedule(t("predictions"), "id", "preds")


@query("WITH s AS (SELECT unnest(['archive', 'file', 'Unser Archiv', '文書', 'Archiv']) AS surface) SELECT surface, count(*) AS docs FROM s JOIN documents ON contains(text, surface) GROUP BY surface")
def surface_occurrences(t):
    d = t("documents")
    s = d.sparkSession.createDataFrame([(x,) for x in ("archive", "file", "Unser Archiv", "文書", "Archiv")], "surface string")
    return iv.occurrences(d, s, "doc_id", "text").select("doc", "surface").distinct().groupBy("surface").agg(F.count(F.lit(1)).alias("docs"))
