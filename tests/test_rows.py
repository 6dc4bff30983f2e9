import random

import numpy as np
import pytest

from spanloom.operators import dedup, sampling, stats
from spanloom.operators import similarity as sim
from spanloom.sources import files


def test_exact_dedup_with_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "A  b", 0), (2, "a B", 1), (3, None, 2), (4, None, 3), (5, "", 4)], "doc_id int, text string, key int")
    kept = sorted(r["doc_id"] for r in dedup.keep_first(df, "text", "doc_id").collect())
    assert kept == [1, 3, 4, 5]
    bad = spark.createDataFrame([("a b",), (None,)], "text string")
    assert sorted(r["doc_id"] for r in dedup.without_texts(df, bad, "text", "text").collect()) == [3, 4, 5]


def test_components_against_union_find(spark):
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)]
    parent = {n: n for e in links for n in e}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    linked = {n for a, b in links if a != b for n in (a, b)}
    got = {r["node"]: r["component"] for r in dedup.components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {n: min(m for m in parent if top(m) == top(n)) for n in linked}


def test_shingle_links_lose_no_pair(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(30)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(40)]
        texts.append(" ".join(base))
        for _ in range(2):
            other = list(base)
            for k in range(rng.randint(0, 2)):
                other[rng.choice([0, 1, 39])] = rng.choice(words)
            texts.append(" ".join(other))
    texts += ["", None, "one two", "one two", "ONE, two!"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    links, members = sim.shingle_links(df, "id", "text")

    def shingles(t):
        w = t.lower().replace(",", "").replace("!", "").split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    rep = {r["id"]: r["rep"] for r in members.collect()}
    sets = {k: shingles(t) for k, t in enumerate(texts) if t}
    assert set(rep) == set(sets) and all(sets[k] == sets[r] for k, r in rep.items())
    reps = sorted(set(rep.values()))
    want = {(a, b) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert {(r["a"], r["b"]) for r in links.collect()} == want


def test_chrf_of_short_and_equal_texts(spark):
    df = spark.createDataFrame([(1, "abcdefgh"), (2, "abcdefgh"), (3, "ab"), (4, "ab"), (5, "xyzxyzxyz")], "id int, text string")
    pairs = spark.createDataFrame([(1, 2), (3, 4), (1, 3), (1, 5)], "a int, b int")
    got = {(r["a"], r["b"]): r["chrf"] for r in sim.chrf(pairs, df, df).collect()}
    assert got[1, 2] == 1.0 and got[3, 4] == 1.0 and got[1, 3] == 0.0 and got[1, 5] == 0.0


def test_cosine_and_hashed_search(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(200, 64)).astype("float32")
    m[100:] = m[:100] + 0.05 * rng.normal(size=(100, 64))
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(m)] + [(999, None)], "id bigint, v array<float>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    exact = sim.cosine_topk(df.where("id % 10 = 0"), df, 1)
    assert {r["a"]: r["b"] for r in exact.collect()} == {k: int(s[k].argmax()) for k in range(0, 200, 10)}
    found = sim.ann_topk(df.where("id % 10 = 0"), df, 1)
    assert sim.recall(found, exact).first()["recall"] >= 0.9


def test_duplicate_mass(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 1.0), (None, "y", 2.0), (None, "y", 2.0), ("b", "z", 3.0)], "lang string, text string, w double")
    got = sampling.share_duplicate_mass(df, ["lang", "text"], "w").collect()
    assert len(got) == 5 and sum(r["shared"] for r in got) == pytest.approx(9.0)
    by = {}
    for r in got:
        by.setdefault(r["text"], []).append(r["shared"])
    assert by["x"][0] * 2 == pytest.approx(by["y"][0] * 2 / 2) and by["z"][0] == pytest.approx(3 * by["x"][0] * 2)
    alone = df.where("lang = 'b'")
    assert sampling.share_duplicate_mass(alone, ["lang", "text"], "w").first()["shared"] == 3.0


def test_caps_move_mass_and_report_what_cannot_be_met():
    factors, short = sampling.cap_shares({"en": 70.0, "de": 20.0, "fr": 10.0}, {"en": 0.5})
    assert factors["en"] * 70 == pytest.approx(50) and sum(factors[g] * m for g, m in {"en": 70, "de": 20, "fr": 10}.items()) == pytest.approx(100) and not short
    _, short = sampling.cap_shares({"en": 70.0, "de": 30.0}, {"en": 0.5, "de": 0.3})
    assert short


def test_systematic_draw_counts(spark):
    df = spark.createDataFrame([(1, "a", 30.0), (2, "a", 120.0), (3, "a", 50.0), (4, "b", 99.0)], "id int, g string, w double")
    got = {r["id"]: r["draws"] for r in sampling.systematic_draw(df, ["g"], "id", "w", 50.0).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 2}


def test_running_sums_over_stretches(spark):
    rows = [(k, "hot" if k % 3 else None, float(k % 7)) for k in range(0, 3000, 2)]
    df = spark.createDataFrame(rows, "id bigint, g string, w double")
    got = {r["id"]: r["running"] for r in sampling.running_sum(df, ["g"], "id", "w", stretch=64).collect()}
    run = {}
    for k, g, w in rows:
        run[g] = run.get(g, 0.0) + w
        assert got[k] == pytest.approx(run[g])
    taken = sampling.ordered_prefix(df.where("g = 'hot'"), ["g"], "id", "w", 0.5).where("taken").count()
    assert 450 < taken < 550


def test_group_split_keeps_groups_whole(spark):
    df = spark.createDataFrame([("s", f"g{k}", 1.0) for k in range(10)] + [("t", "only", 1.0)], "st string, gr string, n double")
    got = sampling.group_split(df, "st", "gr", "n", 0.8).collect()
    assert sum(r["in_first"] for r in got if r["st"] == "s") == 8 and all(r["in_first"] for r in got if r["st"] == "t")


def test_bootstrap_brackets_the_difference(spark):
    rng = random.Random(0)
    rows = []
    for k in range(200):
        gold = rng.randint(1, 5)
        rows.append((f"g{k}", gold if rng.random() < 0.9 else 0, gold, gold, gold if rng.random() < 0.6 else 0, gold, gold))
    df = spark.createDataFrame(rows, "g string, a_tp int, a_predicted int, a_gold int, b_tp int, b_predicted int, b_gold int")
    r = stats.paired_bootstrap(df, "g", 400).first()
    assert r["low"] < r["observed"] < r["high"] and r["p"] < 0.01 and r["win_rate"] > 0.99
    again = stats.paired_bootstrap(df.repartition(5), "g", 400).first()
    assert r["low"] == pytest.approx(again["low"]) and r["high"] == pytest.approx(again["high"])


def test_trust_region(spark):
    df = spark.createDataFrame([("m", x / 10, f) for x, f in enumerate([0.2, 0.79, 0.8, 0.795, 0.5, 0.8])], "model string, threshold double, f double")
    r = stats.trust_region(df, ["model"], 0.02).first()
    assert (r["best"], r["low"], r["high"], r["n"]) == (0.5, 0.5, 0.5, 1)
    r = stats.trust_region(df.where("threshold < 0.45"), ["model"], 0.02).first()
    assert (r["low"], r["middle"], r["high"]) == (0.1, 0.2, 0.3)


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", "en"), ("b", "y", "de"), ("c", None, "de")], "id string, text string, lang string")
    out = str(tmp_path / "shards")
    files.write_shards(df.withColumn("split", df.lang), out, ["split"])
    with pytest.raises(Exception):
        files.write_shards(df.withColumn("split", df.lang), out, ["split"])
    back = files.scan_named(spark, {"one": out + "/*/*.json.gz"}).select("id", "text", "lang")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    saved = files.manifest(df, ["lang"], "id", "text")
    assert files.check_manifest(back, saved, ["lang"], "id", "text").count() == 0
    assert files.check_manifest(back.where("id <> 'a'"), saved, ["lang"], "id", "text").count() == 1
    with pytest.raises(Exception):
        files.check_required(back, "text").collect()
    (tmp_path / "bad.json").write_text('{"id": 1, "text"\n')
    with pytest.raises(Exception):
        files.scan_jsonl(spark, str(tmp_path / "bad.json")).collect()
