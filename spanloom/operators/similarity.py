"""Neighbours by shared n-grams and by vectors, and decisions over both views.

Gram frequencies are multisets per text; candidates share one of the rare grams of the query. Cuts by gram frequency or by
rank are the retrieval's own definition; equal texts are always candidates, whatever their grams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import char_ngrams
from ..session import stage_table

ORDERS = (3, 4, 5, 6)
_WORDS = regex.compile(r"[\p{L}\p{M}\p{Nd}]+").findall


def gram_counts(df: DataFrame, id_col: str, text_col: str, orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """(id, n, gram, c): multiset of the character n-grams of each text."""

    def marked(n: int):
        return F.transform(char_ngrams(F.col(text_col), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))

    grams = F.concat(*[marked(n) for n in orders])
    return df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(grams).alias("g")).groupBy("id", "g.n", "g.gram").agg(F.count(F.lit(1)).alias("c"))


def chrf(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, chrf, a_in_b, b_in_a) for pairs (a, b) of ids; left and right have (id, text).

    Mean over the orders 3 to 6 of the F1 of the gram multisets, orders missing on either side left out; where all are,
    1 for equal texts and 0 for others.
    """
    # only texts that are in a pair are cut into grams
    left = left.select("id", "text").join(pairs.select(F.col("a").alias("id")), "id", "left_semi")
    right = right.select("id", "text").join(pairs.select(F.col("b").alias("id")), "id", "left_semi")
    la, rb = gram_counts(left, "id", "text"), gram_counts(right, "id", "text")
    ga = la.select(F.col("id").alias("a"), "n", "gram", F.col("c").alias("ca"))
    gb = rb.select(F.col("id").alias("b"), "n", "gram", F.col("c").alias("cb"))
    shared = pairs.join(ga, "a").join(gb, ["b", "n", "gram"]).groupBy("a", "b", "n").agg(F.sum(F.least("ca", "cb")).alias("both"))
    size = lambda t, name, col: t.select(F.col("id").alias(name), F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.greatest(F.length("text") - n + 1, F.lit(0)).alias(col)) for n in ORDERS])).alias("x")).select(name, "x.*")
    every = pairs.join(size(left, "a", "na"), "a").join(size(right, "b", "nb"), ["b", "n"]).join(shared, ["a", "b", "n"], "left")
    both = F.coalesce("both", F.lit(0))
    usable = (F.col("na") > 0) & (F.col("nb") > 0)
    scored = every.groupBy("a", "b").agg(
        F.avg(F.when(usable, 2 * both / (F.col("na") + F.col("nb")))).alias("f"),
        F.avg(F.when(usable, both / F.col("na"))).alias("a_in_b"),
        F.avg(F.when(usable, both / F.col("nb"))).alias("b_in_a"),
    )
    same = pairs.join(left.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(right.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", (F.col("ta") == F.col("tb")).cast("double").alias("same"))
    out = scored.join(same, ["a", "b"])
    return out.select("a", "b", F.coalesce("f", "same").alias("chrf"), F.coalesce("a_in_b", "same").alias("a_in_b"), F.coalesce("b_in_a", "same").alias("b_in_a"))


def rare_gram_candidates(queries: DataFrame, corpus: DataFrame, n: int = 6, rare: int = 12, most: int = 16, within: bool = False) -> DataFrame:
    """(a, b): for each query its ``most`` best rows of the corpus by the summed rarity of shared grams, the query's ``rare`` rarest grams counting.

    Both sides have (id, text); within one table, grams that only the query itself has don't count. Document frequencies are those of the corpus; equal texts are added whatever their rank.
    """
    gram = lambda t: t.where("text is not null").select("id", F.explode(F.array_distinct(F.transform(char_ngrams(F.col("text"), n), lambda x: F.xxhash64(x)))).alias("g"))
    q = gram(queries)
    # grams that no query has are dropped before anything is counted or shuffled twice
    c = gram(corpus).join(q.select("g").distinct(), "g", "left_semi")
    df = c.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    w = Window.partitionBy("id").orderBy("df", "g")
    chosen = q.join(df.where(F.col("df") > int(within)), "g").withColumn("r", F.row_number().over(w)).where(F.col("r") <= rare)
    hits = chosen.select(F.col("id").alias("a"), "g", "df").join(c.select(F.col("id").alias("b"), "g"), "g").groupBy("a", "b").agg(F.sum(1.0 / F.col("df")).alias("s"))
    best = hits.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.round("s", 9).desc(), "b"))).where(F.col("r") <= most).select("a", "b")
    key = lambda t, name: t.where("text is not null").select(F.col("id").alias(name), F.sha2("text", 256).alias("k"))
    return best.union(key(queries, "a").join(key(corpus, "b"), "k").select("a", "b")).distinct()


def rank_neighbours(scored: DataFrame, k: int, *order: str) -> DataFrame:
    """The k best rows of each a by the given columns, descending, and then by b."""
    w = Window.partitionBy("a").orderBy(*[F.round(F.col(c), 9).desc() for c in order], "b")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def lexical_topk(queries: DataFrame, corpus: DataFrame, k: int = 3, within: bool = False) -> DataFrame:
    """Neighbours by chrF among the candidates. within: both sides are one table and a row is not its own neighbour."""
    pairs = rare_gram_candidates(queries, corpus, within=within)
    if within:
        pairs = pairs.where("a <> b")
    return rank_neighbours(chrf(pairs, queries, corpus), k, "chrf", "a_in_b")


def _shingle_sets(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, key, set): sorted distinct hashes of the word shingles of each text with a word, and a digest of the set."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, keys, flat, ends = [], [], [], [0]
            for k, t in enumerate(b.column(1).to_pylist()):
                w = _WORDS(t.lower()) if t else []
                if w:
                    s = np.unique(np.array([xxhash.xxh3_64_intdigest(" ".join(w[i : i + words])) for i in range(max(1, len(w) - words + 1))], np.uint64)).view(np.int64)
                    keep.append(k)
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    flat.append(s)
                    ends.append(ends[-1] + len(s))
            sets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(keys, pa.binary()), sets], ["id", "key", "set"])

    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, key binary, set array<bigint>")


def shingle_links(df: DataFrame, id_col: str, text_col: str, words: int = 5, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, jaccard) of all texts whose sets of word shingles are ``least`` alike or more, and members (id, rep).

    Texts with the same set are one class with the smallest id as its representative, and only representatives are linked.
    Two sets that are alike share one of their rarest shingles, the first (1 - least) * size + 1 in the order of frequency;
    sizes must fit as well. No pair is lost and no partner is capped. Texts shorter than a shingle have their words as one.
    """
    keyed = stage_table(_shingle_sets(df, id_col, text_col, words), "shingles")
    reps = keyed.groupBy("key").agg(F.min("id").alias("rep"))
    members = keyed.select("id", "key").join(reps, "key").select("id", "rep")
    rep_sets = keyed.join(reps.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "set", F.size("set").alias("n"))
    one = rep_sets.select("id", "n", F.explode("set").alias("g"))
    freq = one.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    r = F.row_number().over(Window.partitionBy("id").orderBy("df", "g"))
    ranked = one.join(freq.where("df > 1"), "g", "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("r", r).where("df > 1")
    head = lambda part: F.col("n") - F.ceil(F.round(part * F.col("n"), 9)) + 1
    # the smaller set of a pair shares one of its first (1 - 2 least / (1 + least)) parts with the first (1 - least) of the larger
    # sizes that can go together lie in the same class or the one below, so a frequent shingle meets within classes only
    size = F.floor(F.log("n") / F.lit(-math.log(least)) + 1e-9)
    small = ranked.where(F.col("r") <= head(2 * least / (1 + least))).select(F.col("id").alias("x"), F.col("n").alias("nx"), F.col("r").alias("rx"), "g", size.alias("c"))
    large = ranked.where(F.col("r") <= head(least)).select(F.col("id").alias("y"), F.col("n").alias("ny"), F.col("r").alias("ry"), "g", F.explode(F.array(size - 1, size)).alias("c"))
    order = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    need = F.ceil(F.round(F.lit(least / (1 + least)) * (F.col("nx") + F.col("ny")), 9))
    # and what follows the first shared place must be enough to reach the overlap that is needed
    room = 1 + F.least(F.col("nx") - F.col("rx"), F.col("ny") - F.col("ry"))
    met = small.join(large, ["g", "c"]).where(order & (F.col("nx") >= least * F.col("ny")) & (room >= need))
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    s = rep_sets.select("id", "set", "n")
    j = pairs.join(s.select(F.col("id").alias("a"), F.col("set").alias("sa"), F.col("n").alias("na")), "a").join(s.select(F.col("id").alias("b"), F.col("set").alias("sb"), F.col("n").alias("nb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    links = j.select("a", "b", (both / (F.col("na") + F.col("nb") - both)).alias("jaccard")).where(F.col("jaccard") >= least)
    return links, members


def cosine_topk(queries: DataFrame, corpus: DataFrame, k: int = 3, blocks: int = 8, within: bool = True) -> DataFrame:
    """(a, b, cosine, rank) by exact cosine: every query against every row, in blocks.

    queries (id, v) are a stated set that meets the corpus block by block: each block of queries is one matrix, bounded by
    its number of rows, and each batch of the corpus gives its k best for it; the best of all batches are ranked at the end.
    """
    out = None
    rows = queries.where("v is not null").select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
    for block in range(blocks):
        part = rows.where(F.col("block") == block).select("id", "v").collect()
        if not part:
            continue
        ids, m = np.array([r[0] for r in part], np.int64), _unit(np.array([r[1] for r in part], np.float64))
        sent = queries.sparkSession.sparkContext.broadcast((ids, m))  # one block of the stated queries

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            q_ids, q = sent.value
            for b in batches:
                c_ids = b.column(0).to_numpy()
                c = _unit(np.array(b.column(1).to_pylist(), np.float64))
                s = q @ c.T
                if within:
                    s[q_ids[:, None] == c_ids[None, :]] = -np.inf
                near = np.argsort(-s, axis=1, kind="stable")[:, :k]
                v = np.take_along_axis(s, near, 1)
                keep = np.isfinite(v).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, near.shape[1])[keep]), pa.array(c_ids[near].ravel()[keep]), pa.array(v.ravel()[keep])], ["a", "b", "cosine"])

        got = corpus.where("v is not null").select(F.col("id").cast("bigint"), "v").mapInArrow(run, "a bigint, b bigint, cosine double")
        out = got if out is None else out.unionByName(got)
    if out is None:
        return queries.sparkSession.createDataFrame([], "a bigint, b bigint, cosine double, rank int")
    return rank_neighbours(out, k, "cosine")


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


#: Rows that the centroids of an index are fitted on (the bound of the sample), and centroids.
FIT_VECTORS, CENTROIDS = 4_096, 64


def fit_centroids(corpus: DataFrame, count: int = CENTROIDS, bound: int = FIT_VECTORS, seed: int = 0, steps: int = 12) -> np.ndarray:
    """Unit centroids by spherical k-means over about ``bound`` rows, chosen by the hash of their id."""
    rows = corpus.where("v is not null")
    n = rows.count()
    if n > bound:
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * bound / n))
    m = _unit(np.array([r[0] for r in rows.orderBy("id").select("v").collect()], np.float64))
    if not len(m):
        return np.zeros((1, 1))
    c = m[np.random.default_rng(seed).choice(len(m), min(count, len(m)), replace=False)]
    for _ in range(steps):
        near = (m @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, m)
        c = _unit(np.where(np.bincount(near, minlength=len(c))[:, None] > 0, sums, c))
    return c


def ann_topk(queries: DataFrame, corpus: DataFrame, k: int = 3, probes: int = 40, centroids: np.ndarray | None = None) -> DataFrame:
    """(a, b, cosine, rank) by an index of lists: every row of the corpus lies in the list of its nearest centroid, and a query is met by the lists of its ``probes`` nearest ones.

    The queries are what is repeated, once per probe, so the corpus moves once however many lists are probed.
    """
    sent = queries.sparkSession.sparkContext.broadcast(fit_centroids(corpus) if centroids is None else centroids)  # CENTROIDS vectors

    def place(most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = _unit(np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, -1))
                near = np.argsort(-(v @ sent.value.T), axis=1, kind="stable")[:, :most] if b.num_rows else np.empty((0, 1), np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, max(1, near.shape[1])), pa.int32()), pa.array(near.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["id", "v", "lists"])

        return run

    schema = "id bigint, v array<float>, lists array<bigint>"
    placed = lambda t, most, i, v: t.where("v is not null").select(F.col("id").cast("bigint"), "v").mapInArrow(place(most), schema).select(F.col("id").alias(i), F.col("v").alias(v), F.explode("lists").alias("list"))
    pairs = placed(queries, probes, "a", "va").join(placed(corpus, 1, "b", "vb"), "list").where("a <> b")
    return rank_neighbours(pairs.select("a", "b", cosine(F.col("va"), F.col("vb")).alias("cosine")), k, "cosine")


def cosine(a, b):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, recall): mean share of the exact neighbours that were found."""
    hit = exact.select("a", "b").join(found.select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left").groupBy("a").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("r"))
    return hit.agg(F.count(F.lit(1)).alias("queries"), F.avg("r").alias("recall"))


def two_views(lexical: DataFrame, semantic: DataFrame, least_chrf: float = 0.30, least_cosine: float = 0.875) -> DataFrame:
    """Neighbours that both views rank, with near = both cuts passed by the same neighbour."""
    j = lexical.select("a", "b", "chrf").join(semantic.select("a", "b", "cosine"), ["a", "b"])
    return j.withColumn("near", (F.col("chrf") >= least_chrf) & (F.col("cosine") >= least_cosine))


def fuse(first: DataFrame, second: DataFrame, score: str, k: int = 3) -> DataFrame:
    """Union of two retrievers' neighbours with the best score of each and the names of those that found it."""
    u = first.select("a", "b", score, F.lit("first").alias("by")).union(second.select("a", "b", score, F.lit("second").alias("by")))
    return rank_neighbours(u.groupBy("a", "b").agg(F.max(score).alias(score), F.array_join(F.array_sort(F.collect_set("by")), "+").alias("retrieved_by")), k, score)


def threshold_sweep(pairs: DataFrame, score: str, thresholds: list[float]) -> DataFrame:
    """(threshold, n): pairs at or over each threshold; one pass, without a join."""
    counts = pairs.agg(*[F.count(F.when(F.col(score) >= t, 1)).alias(f"t{k}") for k, t in enumerate(thresholds)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{k}").alias("n")) for k, t in enumerate(thresholds)])).alias("x")).select("x.*")
