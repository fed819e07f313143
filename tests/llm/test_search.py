"""Lexical search, centroid clustering and language identification: brute force, odd rows, held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldra.llm import clustering, language, lexical
from veldra.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_plain(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def ranked_plain(docs, items, k):
    """(item, rank, doc, score) by the formula as it is written."""
    docs = [(i, Counter(terms_plain(t))) for i, t in docs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, total = len(docs), sum(s for *_, s in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, size in docs:
            m = 100 - 50 + (50 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms_plain(text)) if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return out


ODD_DOCS = [
    (1, None),
    (2, ""),
    (3, "!!! -- \x00\x1f"),
    (4, "the cat sat"),
    (4, "the cat sat"),
    (None, "the cat sat"),
    (9, "The CAT, sat"),
    (5, "ÄÖ äö É—quote ÄÖ İstanbul 日本語 cat"),
    (6, "cat " * 60_000 + "dog"),
    (7, "x" * 300_000),
    (-3, "dog\nbird\tfish dog"),
]
ODD_ITEMS = [(1, "The cat"), (1, "the cat"), (2, None), (3, ""), (4, "ÄÖ quote dog dog"), (None, "bird 日本語"), (5, "unknown words"), (6, "äö")]


def test_lexical_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, 1, "q") for i, t in ODD_DOCS], "doc_id long, text string, score int, q string")
    items = spark.createDataFrame([(i, t, 2.0) for i, t in ODD_ITEMS], "item_id long, text string, rank double")
    for parts in (1, 5):
        for k in (2, 50):
            rows = [tuple(r) for r in lexical.search(docs.repartition(parts), items, k).collect()]
            assert sorted(rows, key=str) == sorted(ranked_plain(ODD_DOCS, ODD_ITEMS, k), key=str)
    assert lexical.search(docs.limit(0), items).count() == 0 and lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs.where("doc_id < 4 AND doc_id > 0"), items).count() == 0


def test_lexical_many_shards_packs_and_ties(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    docs = [(rng.randrange(400), " ".join(rng.choices(words, k=rng.choice([3, 3, 8])))) for _ in range(600)]
    items = [(i, " ".join(rng.sample(words, 4))) for i in range(30)]
    for name, value in (("SHARD_DOCS", 37), ("PACK", 4), ("PACKS", 2), ("MERGE_PARTS", 3)):
        monkeypatch.setattr(lexical, name, value)
    found = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), 50)
    assert sorted(tuple(r) for r in found.collect()) == sorted(ranked_plain(docs, items, 50))


def test_best_is_tie_safe():
    rng = np.random.default_rng(1)
    for _ in range(200):
        scores = rng.integers(0, 4, rng.integers(1, 30))
        want = sorted((i for i in range(len(scores)) if scores[i] > 0), key=lambda i: (-scores[i], i))[:5]
        assert sorted(lexical.best(scores, 5)) == sorted(want)


def clusters_plain(rows, k, rounds, dim):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, tuple(math.floor(64 * x) for x in v)))
    own = [(hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None]
    centroids = [v for _, v in sorted(own)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            members = [v for (_, v), a in zip(kept, at, strict=True) if a == n]
            if members:
                centroids[n] = tuple(sum(x) // len(members) for x in zip(*members, strict=True))
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, n in found:
        inertia[n] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, n, d, inertia[n], sum(inertia.values()), digest[n]) for i, d, n in found]


@pytest.mark.parametrize("seed", range(3))
def test_clusters_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(i, [round(rng.uniform(-0.1, 0.1), 2) for _ in range(4)]) for i in range(120)]  # many ties on a coarse grid
    rows += [(i, v) for i, v in rows[:20]] + [(200 + i, rows[0][1]) for i in range(60)]
    rows += [(300, None), (301, []), (302, [1.0] * 3), (303, [1.0] * 5), (304, [None, 0.0, 0.0, 0.0]), (305, [float("nan")] + [0.0] * 3), (306, [float("inf")] + [0.0] * 3)]
    rows += [(None, [0.5, 0.0, 0.0, 0.25]), (307, [1e6, -1e6, 0.0, 0.0]), (308, [0.0] * 4), (309, [-0.0] * 4)]
    table = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, v string")
    found, _ = clustering.cluster(table.repartition(5), 7, 3, 4)
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(clusters_plain(rows, 7, 3, 4), key=str)


def test_clusters_of_few_and_no_vectors(spark):
    rows = [(5, [0.1, 0.2]), (6, [0.3, 0.1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(r.distance for r in clustering.cluster(table, 16, 3, 2)[0].collect()) == [0, 0]
    assert clustering.cluster(table.limit(0), 16, 3, 2)[0].count() == 0
    assert clustering.cluster(table.withColumn("embedding", F.lit(None).cast("array<float>")), 16, 3, 2)[0].count() == 0
    assert clustering.cluster(table.withColumn("embedding", F.expr("transform(embedding, x -> cast(1e30 AS float))")), 16, 3, 2)[0].count() == 0


def test_annulus_holds_all_nearest():
    rng = np.random.default_rng(3)
    for k in (1, 2, 9, 50):
        x, c = rng.integers(-9, 9, (500, 3)), rng.integers(-9, 9, (k, 3))
        number, distance = clustering.Annuli(c).nearest(x)
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (number == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()


def test_language_of_held_out_rows(spark):
    from veldra.llm.common import table

    sf = "/root/testdata/sf0.01"
    made = QUERIES["op13_language"](spark, sf).where("held_out").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert len(made) > 100 and sum(r.lang == r.lang_pred for r in made) > 0.97 * len(made)
    assert all(0 <= r.score <= 1 for r in made)


def test_language_odd_rows(spark):
    rng = random.Random(2)
    word = {"aa": "rha ngo tik plo".split(), "bb": "ést çor ñul äb".split()}
    rows = [(i, " ".join(rng.choices(word[x], k=rng.choice([3, 60, 400]))), x) for i in range(80) for x in word]
    rows += [(None, "rha ngo tik", "bb"), (900, "12 34 !!", "bb"), (901, None, "aa"), (902, "rha", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language.train(docs, F.lit(True))
    assert net.langs == ["aa", "bb"]
    odd = [(1, None), (2, ""), (3, "12 !"), (4, "rha ngo"), (4, "rha ngo"), (None, "ést çor ést"), (5, "ñul " * 100_000), (6, "tik"), (7, "x" * 128), (8, "\x00é")]
    asked = spark.createDataFrame([(i, t, "zz", 0.5) for i, t in odd], "doc_id long, text string, lang string, score double")
    got = [(r.t.lang, r.t.score) for r in asked.select("doc_id", language.identify(net, F.col("text")).alias("t")).collect()]
    assert [x for x, _ in got][:7] == ["und", "und", "und", "aa", "aa", "bb", "bb"] and all(s == 0 for _, s in got[:3])
    assert all(0 < s <= 1 for _, s in got[3:])
    none = language.train(docs.where("lang = 'zz'"), F.lit(True))
    assert none is None and asked.select(language.identify(none, F.col("text")).alias("t")).first().t == ("und", 0.0)
    assert asked.limit(0).select(language.identify(net, F.col("text"))).count() == 0


def test_language_scores_equal_a_plain_net():
    net = language.fit(["abc abd " * 30, "xyz xyw " * 30] * 20, ["a", "b"] * 20)
    x, own = language.windows("abd xyz " * 40)
    assert own.sum() == 320 and b"".join(w[:n].tobytes() for w, n in zip(x, own, strict=True)) == b"abd xyz " * 40
    h = np.concatenate([np.maximum(r.max(axis=1), 0) for r in language.responses(net, x)], axis=1)
    want = language.log_softmax(h @ net.out.T + net.out_bias)
    assert np.allclose(language.Paired(net).log_probabilities(x), want, atol=1e-4)


def test_language_gradients():
    """Against differences of the loss."""
    rng = np.random.default_rng(4)
    net = language.fit(["abc " * 20, "xyz " * 20] * 3, ["a", "b"] * 3)
    net = net._replace(filters=[f.astype(np.float64) for f in net.filters], biases=[b.astype(np.float64) for b in net.biases], out=net.out.astype(np.float64), out_bias=net.out_bias.astype(np.float64))
    x, y = rng.integers(97, 123, (6, language.WINDOW)).astype(np.uint8), np.array([0, 1] * 3)

    def loss():
        h = np.concatenate([np.maximum(r.max(axis=1), 0) for r in language.responses(net, x)], axis=1)
        return -language.log_softmax(h @ net.out.T + net.out_bias)[np.arange(6), y].mean()

    for w, g in zip([*net.filters, *net.biases, net.out, net.out_bias], language.gradients(net, x, y), strict=True):
        for at in rng.choice(np.flatnonzero(np.abs(g) > 1e-6), 3) if (np.abs(g) > 1e-6).any() else []:
            w.flat[at] += 1e-6
            up = loss()
            w.flat[at] -= 2e-6
            down = loss()
            w.flat[at] += 1e-6
            assert abs((up - down) / 2e-6 - g.flat[at]) < 1e-4


def test_each_query_row_has_its_own_neighbours(spark):
    from veldra.llm import ann

    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(2)]) for i in range(1, 50)] + [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0])] + [(100, [-1.0, 0.0])] * 3
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.search(vectors.repartition(3), vectors.where("vec_id % 50 = 0"), k=5, block=7, query_block=2).collect()

    def near(q, v):
        scores = sorted((-(v[0] * x[0] + v[1] * x[1]) / (math.hypot(*v) * math.hypot(*x)), i) for i, x in rows if i != q)
        return [(q, r + 1, i, round(-s, 9)) for r, (s, i) in enumerate(scores[:5])]

    want = sorted(w for q, v in rows if q % 50 == 0 for w in near(q, v))
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in found) == want


def test_a_long_benchmark_item_leaves_the_passages_of_short_ones_alone(spark):
    """A text that spreads an item's words over a thousand others scores the same, whatever other items there are."""
    from veldra.llm import decontaminate

    rng = random.Random(3)
    word = lambda: "".join(rng.choices("bcdfghjklm", k=7))
    item = [word() for _ in range(20)]
    spread = " ".join(w for x in item for w in (x, *(word() for _ in range(50))))
    docs = spark.createDataFrame([(1, spread), (2, " ".join([word() for _ in range(500)] + item + [word() for _ in range(500)]))], "doc_id long, text string")
    far = " ".join(word() for _ in range(2000))
    found = {}
    for name, items in (("alone", [(1, " ".join(item))]), ("with", [(1, " ".join(item)), (2, far)])):
        leaks = decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string"), overlap=0.0).collect()
        found[name] = {(r.doc_id, r.item_id) for r in leaks}
    assert found["alone"] == found["with"] == {(2, 1)}
