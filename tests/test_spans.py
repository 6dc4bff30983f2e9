import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from spanloom.operators import intervals as iv
from spanloom.operators import labels, rules, scoring, tagset


def spans(spark, rows):
    return spark.createDataFrame(rows, "doc int, s int, e int, label string")


def random_spans(rng, docs=6, n=40):
    out = []
    for _ in range(n):
        s = rng.randrange(60)
        out.append((rng.randrange(docs), s, s + rng.randint(1, 12), rng.choice("AB")))
    return out


def chars(rows):
    return {(d, k) for d, s, e, *_ in rows for k in range(s, e)}


def test_merge_and_subtract_equal_sets_of_characters(spark):
    rng = random.Random(3)
    for _ in range(2):
        a, b = random_spans(rng), random_spans(rng)
        merged = [tuple(r)[:3] for r in iv.merge_regions(spans(spark, a)).collect()]
        assert chars(merged) == chars(a)
        assert sum(e - s for _, s, e in merged) == len(chars(a))
        left = [tuple(r) for r in iv.subtract(spans(spark, a), spans(spark, b)).collect()]
        assert chars(left) == chars(a) - chars(b) and sum(e - s for _, s, e in left) == len(chars(left))


def test_overlaps_and_anti(spark):
    rng = random.Random(5)
    a, b = random_spans(rng), random_spans(rng)
    want = {(x[:3], y[:3]) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2] and min(x[2], y[2]) - max(x[1], y[1]) >= 0.8 * max(x[2] - x[1], y[2] - y[1])}
    got = {((r["doc"], r["s"], r["e"]), (r["doc"], r["r_s"], r["r_e"])) for r in iv.overlaps(spans(spark, a), spans(spark, b), 0.8).collect()}
    assert got == want
    free = {tuple(r)[:3] for r in iv.not_overlapping(spans(spark, a), spans(spark, b)).collect()}
    assert free == {x[:3] for x in a if not any(x[0] == y[0] and x[1] < y[2] and y[1] < x[2] for y in b)}


def test_merge_adjacent_needs_white_space(spark):
    text = spark.createDataFrame([(1, "Dr. Ada  Mensah,Bo")], "doc int, text string")
    got = iv.merge_adjacent(spans(spark, [(1, 0, 3, "N"), (1, 4, 7, "N"), (1, 9, 15, "N"), (1, 16, 18, "N")]), text).collect()
    assert sorted((r["s"], r["e"]) for r in got) == [(0, 15), (16, 18)]


def test_greedy_and_replace(spark):
    row = [(1, "😀 a@b.com and Ada Mensah", [(2, 9, "email", None), (14, 24, "name", None), (14, 17, "given", None), (None, 3, "x", None), (5, 5, "none", None)]), (2, None, None), (3, "plain", [])]
    df = spark.createDataFrame(row, "id int, text string, spans array<struct<start_char:int,end_char:int,label:string,source_label:string>>")
    got = {r[0]: r[1] for r in df.select("id", iv.replace_spans(F.col("text"), iv.greedy_longest("spans"))).collect()}
    assert got == {1: "😀 [email] and [name]", 2: None, 3: "plain"}


def test_trim(spark):
    df = spark.createDataFrame([("a  b ", 1, 5), ("   ", 0, 3)], "t string, s int, e int")
    assert [r[0] and tuple(r[0]) for r in df.select(iv.trim_edges(F.col("t"), F.col("s"), F.col("e"))).collect()] == [(3, 4), None]


def test_region_counts_are_a_maximum_matching(spark):
    rng = random.Random(7)
    a, b = random_spans(rng, 5, 25), random_spans(rng, 5, 25)
    got = {r["doc"]: r["tp"] for r in scoring.region_counts(spans(spark, a), spans(spark, b), 0.8).collect()}

    def merged(rows, doc):
        out = []
        for s, e in sorted((s, e) for d, s, e, _ in rows if d == doc):
            if out and s <= out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
        return out

    for doc in range(5):
        g, p = merged(a, doc), merged(b, doc)
        fit = {i: [j for j, y in enumerate(p) if (m := min(x[1], y[1]) - max(x[0], y[0])) >= 0.8 * (x[1] - x[0]) and m >= 0.8 * (y[1] - y[0])] for i, x in enumerate(g)}
        assert got.get(doc, 0) == scoring.matching_size(fit)


def test_matching_against_all_assignments():
    rng = random.Random(11)
    for _ in range(30):
        partners = {g: rng.sample(range(5), rng.randint(0, 3)) for g in range(4)}
        best = max(sum(p in partners[g] for g, p in zip(range(4), perm)) for perm in itertools.permutations(range(5), 4))
        assert scoring.matching_size(partners) == best


def test_metrics_with_no_denominator_are_zero(spark):
    df = spark.createDataFrame([(0, 0, 0)], "tp int, p int, g int")
    assert tuple(df.select(*scoring.prf(F.col("tp"), F.col("p"), F.col("g"))).first()) == (0.0, 0.0, 0.0)


def test_best_path_against_all_sequences():
    tags = ["O", "B-X", "I-X", "E-X", "S-X"]
    rng = np.random.default_rng(0)
    for n in (1, 2, 4):
        s = rng.normal(size=(n, len(tags)))
        best = max((seq for seq in itertools.product(range(5), repeat=n) if labels.violations([tags[k] for k in seq]) == 0), key=lambda seq: sum(s[i, k] for i, k in enumerate(seq)))
        assert labels.best_path(s, tags) == [tags[k] for k in best]
    assert labels.best_path(np.zeros((0, 5)), tags) == []
    assert labels.spans(["B-X", "E-X", "O", "I-Y", "S-X"]) == [(0, 2, "X"), (3, 4, "Y"), (4, 5, "X")]


def test_tagset(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "a"), ("z", None)], "node string, parent string")
    labels_ = spark.createDataFrame([("c",), ("d",), ("z",), (None,)], "label string")
    cut = spark.createDataFrame([("b",), ("a",)], "node string")
    assert {r["label"]: r["target"] for r in tagset.project(labels_, nodes, cut).collect()} == {"c": "b", "d": "a", "z": None, None: None}
    pairs = spark.createDataFrame([("c", "d"), ("c", "z"), ("c", "b")], "x string, y string")
    assert {(r["x"], r["y"]): r["lca"] for r in tagset.common_ancestor(pairs, nodes).collect()} == {("c", "d"): "a", ("c", "z"): None, ("c", "b"): "b"}
    counts = spark.createDataFrame([("c", 2), ("d", 50), ("z", 1)], "label string, n bigint")
    assert {r["label"]: r["target"] for r in tagset.collapse_rare(counts, nodes, 10).collect()} == {"c": "a", "d": "d", "z": "z"}


def test_rules(spark):
    m = rules.Matcher(rules.DEFAULT_RULES)
    text = "😀 mail a.b@c.org, call 0555 123 4567, card 4111 1111 1111 1111, not 4111 1111 1111 1112, IP 10.0.0.300"
    german = rules.Matcher([rules.Rule("p", "phone", r"\d{6,}", cues=("de:anruf", "tel"))])
    assert german.find("Anruf 1234567", "de") and not german.find("Anruf 1234567", "fr") and german.find("Tel 1234567", "fr")
    assert m.find(None) == [] and m.find("") == []
    df = spark.createDataFrame([(1, text), (2, None)], "id int, text string")
    found = rules.scan(df, rules.DEFAULT_RULES, "id", "text")
    assert [(text[r["s"]:r["e"]], r["label"]) for r in found.orderBy("s").collect()] == [("a.b@c.org", "email_address"), ("0555 123 4567", "phone_number"), ("4111 1111 1111 1111", "payment_card_data")]
    have = spans(spark, [(1, 7, 16, "email_address")])
    merged = rules.arbitrate(have, found, "skip").collect()
    assert len(merged) == 3 and sum(r["origin"] == "existing" for r in merged) == 1
    assert rules.scores(found).first()["score"] == 2.0 + 1.5 + 3.0
