"""The screen: lexical and semantic neighbours, decisions over both views, and components of near-duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup
from ..operators import similarity as sim
from ..registry import query
from ..session import stage_table

_DOT = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"
_TOP = f"top AS (SELECT * FROM (SELECT a.vec_id AS a, b.vec_id AS b, {_DOT} AS cosine, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_DOT}, 9) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE rank <= 3)"
_GRAMS = "g AS (SELECT item_id, lang, n, substring(text, i, n) AS gram, count(*) AS c FROM (SELECT item_id, lang, text, n, unnest(range(1, greatest(1, length(text) - n + 2))) AS i FROM eval_items, (VALUES (3), (4), (5), (6)) v(n)) GROUP BY ALL)"


def _vectors(t):
    return t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _asked(v):
    """The stated queries of a search: every row whose id is divisible by 100."""
    return v.where("id % 100 = 0")


def _items(t):
    return t("eval_items").select(F.col("item_id").alias("id"), "text", "lang")


def _documents(t):
    """Distinct texts, each with its smallest id: the search runs on representatives. Texts are compared by their digests."""
    d = t("documents").where("text is not null and text <> ''").select("doc_id", "text", F.sha2("text", 256).alias("k"))
    return d.groupBy("k").agg(F.min(F.struct("doc_id", "text")).alias("x")).select(F.col("x.doc_id").alias("id"), "x.text")


@query(f"WITH {_TOP} SELECT a, b, round(cosine, 6) AS cosine, rank FROM top")
def cosine_topk(t):
    v = _vectors(t)
    return sim.cosine_topk(_asked(v), v).select("a", "b", F.round("cosine", 6).alias("cosine"), "rank")


@query()
def ann_topk(t):
    v = _vectors(t)
    return sim.ann_topk(_asked(v), v)


@query()
def ann_recall(t):
    """Recall of the hashed index against the exact neighbours of the stated queries."""
    v = _vectors(t)
    return sim.recall(sim.ann_topk(_asked(v), v), sim.cosine_topk(_asked(v), v))


@query(f"""WITH {_GRAMS}, p AS (SELECT a.item_id AS a, b.item_id AS b, a.text AS ta, b.text AS tb FROM eval_items a JOIN eval_items b ON a.lang = b.lang AND a.item_id < b.item_id),
o AS (SELECT p.a, p.b, n, greatest(0, length(ta) - n + 1) AS na, greatest(0, length(tb) - n + 1) AS nb FROM p, (VALUES (3), (4), (5), (6)) v(n)),
s AS (SELECT x.item_id AS a, y.item_id AS b, x.n, sum(least(x.c, y.c)) AS shared FROM g x JOIN g y ON x.gram = y.gram AND x.n = y.n AND x.lang = y.lang AND x.item_id < y.item_id GROUP BY ALL)
SELECT o.a, o.b, round(avg(2 * coalesce(shared, 0) / (na + nb)), 9) AS chrf, round(avg(coalesce(shared, 0) / na), 9) AS a_in_b, round(avg(coalesce(shared, 0) / nb), 9) AS b_in_a FROM o LEFT JOIN s USING (a, b, n) WHERE na > 0 AND nb > 0 GROUP BY o.a, o.b""")
def chrf_pairs(t):
    i = _items(t)
    pairs = i.select(F.col("id").alias("a"), "lang").join(i.select(F.col("id").alias("b"), "lang"), "lang").where("a < b").select("a", "b")
    return sim.chrf(pairs, i, i).select("a", "b", *[F.round(c, 9).alias(c) for c in ("chrf", "a_in_b", "b_in_a")])


@query()
def lexical_topk(t):
    """Items as queries against all distinct document texts; the candidates follow the retrieval's own rarity ranks."""
    return sim.lexical_topk(_items(t), _documents(t)).withColumn("chrf", F.round("chrf", 9))


@query()
def lexical_within(t):
    i = _items(t)
    return sim.lexical_topk(i, i, within=True).select("a", "b", F.round("chrf", 9).alias("chrf"), "rank")


def _two_views(t):
    """Stated document queries in both views; the vectors are those with the documents' ids."""
    d, v = stage_table(_documents(t), "representatives"), _vectors(t)
    # a stated row asks by its representative
    asked = t("documents").where("doc_id % 100 = 0 and text <> ''").select(F.sha2("text", 256).alias("k")).distinct()
    queries = d.withColumn("k", F.sha2("text", 256)).join(asked, "k", "left_semi").select("id", "text")
    lexical = sim.lexical_topk(queries, d, k=16, within=True)
    return sim.two_views(lexical, sim.cosine_topk(_asked(v), v, k=100))


@query()
def two_view_overlap(t):
    return _two_views(t).select("a", "b", F.round("chrf", 9).alias("chrf"), F.round("cosine", 6).alias("cosine"), "near")


@query(f"WITH {_TOP} SELECT threshold, count(*) FILTER (WHERE cosine >= threshold) AS n FROM top, (VALUES (0.0), (0.2), (0.4), (0.6), (0.8)) v(threshold) GROUP BY threshold")
def threshold_sweep(t):
    v = _vectors(t)
    return sim.threshold_sweep(sim.cosine_topk(_asked(v), v), "cosine", [0.0, 0.2, 0.4, 0.6, 0.8])


@query(f"WITH {_TOP}, u AS (SELECT a, b, cosine FROM top) SELECT a, b, round(cosine, 6) AS cosine, CASE WHEN rank <= 2 AND rank >= 2 THEN 'first+second' WHEN rank <= 2 THEN 'first' ELSE 'second' END AS retrieved_by, rank FROM top")
def fuse_neighbours(t):
    v = _vectors(t)
    top = sim.cosine_topk(_asked(v), v)
    return sim.fuse(top.where("rank <= 2"), top.where("rank >= 2"), "cosine").select("a", "b", F.round("cosine", 6).alias("cosine"), "retrieved_by", "rank")


@query("""WITH RECURSIVE l AS (SELECT DISTINCT a.item_id AS a, b.item_id AS b FROM eval_items a JOIN eval_items b ON a.eval_set = b.eval_set AND a.lang = b.lang AND b.item_id - a.item_id BETWEEN 1 AND 40),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT a AS node, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON r.node = e.a)
SELECT node, min(c) AS component FROM r GROUP BY node""")
def link_components(t):
    """Components of links between items of one set and language whose ids are near."""
    i = t("eval_items")
    links = i.select(F.col("item_id").alias("a"), "eval_set", "lang").join(i.select(F.col("item_id").alias("b"), "eval_set", "lang"), ["eval_set", "lang"]).where("b - a between 1 and 40").select("a", "b")
    return dedup.components(links)


@query()
def near_dup_components(t):
    """Documents by the likeness of their shingles of five words: one row each with its class and number of links of its representative."""
    links, members = sim.shingle_links(t("documents"), "doc_id", "text")
    links = stage_table(links, "links")
    classes = dedup.components(links)
    degree = links.select("a").union(links.select("b")).groupBy("a").agg(F.count(F.lit(1)).alias("links"))
    out = members.join(classes.withColumnRenamed("node", "rep"), "rep", "left").join(degree.withColumnRenamed("a", "rep"), "rep", "left")
    return out.select(F.col("id").alias("doc_id"), F.coalesce("component", "rep").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))


@query("""SELECT label, count(*) AS n, round(max(p), 6) AS top FROM (
 SELECT vec_id, label, k, exp(-d) / sum(exp(-d)) OVER (PARTITION BY vec_id) AS p FROM (
  SELECT e.vec_id, e.label, c.label AS k, sum((x.v - c.m) * (x.v - c.m)) AS d FROM (SELECT vec_id, label, embedding FROM embeddings) e,
   LATERAL (SELECT unnest(e.embedding) AS v, unnest(range(len(e.embedding))) AS i) x JOIN (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i) c ON x.i = c.i GROUP BY e.vec_id, e.label, c.label)) GROUP BY label""")
def soft_clusters(t):
    """Posterior of each row over the centroids of the labels: softmax of the negative squared distance. Centroids are one row per label and place."""
    x = t("embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    c = x.groupBy(F.col("label").alias("k"), "i").agg(F.avg("v").alias("m")).groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    d = F.aggregate(F.zip_with("embedding", "m", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda a, z: a + z)
    far = t("embeddings").join(F.broadcast(c)).select("vec_id", "label", "k", F.exp(-d).alias("w"))
    from pyspark.sql import Window

    p = far.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("vec_id")))
    return p.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("p"), 6).alias("top"))
