"""Operators that SQL can't express, against plain brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import itertools
import math
import random
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veldra.llm import ann, decontaminate, near_dup, quality, sentencepiece_sampling, toxicity
from veldra.llm.queries import QUERIES

LARGER = "/root/testdata/sf0.1"
ODD_TEXTS = [None, "", " ", "\n", "a", "▁a ▁▁ b", "Grüße\n\n  aus 東京 🎉!", "x" * 5000, "one two one two " * 300, "tab\tand\r\nline"]


def bag(text: str) -> Counter:
    words = re.findall("[0-9a-z_\u0080-\U0010ffff]+", text.lower())
    n = min(5, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else Counter()


def brute_classes(rows: list[tuple[int, str | None]]) -> dict[int, int]:
    """Class names by all pairs."""
    texts = [(i, t or "", bag(t or "")) for i, t in rows]
    name = {i: i for i, _, _ in texts}

    def root(i: int) -> int:
        while name[i] != i:
            i = name[i]
        return i

    for (i, s, a), (j, t, b) in itertools.combinations(texts, 2):
        n, m = a.total(), b.total()
        alike = s == t
        if not alike and n and m and min(n, m) >= 0.8 * max(n, m):
            shared = (a & b).total()
            alike = shared >= 0.8 * (n + m - shared) - 1e-9
        if alike:
            x, y = sorted((root(i), root(j)))
            name[y] = x
    return {i: root(i) for i in name}


def brute_leaks(docs: list[tuple[int, str]], items: list[tuple[int, str]]) -> set[tuple[int, int]]:
    """All (doc, item) by the whole BM25 sum for each passage and item."""
    word = re.compile(r"\w+")
    kept = [(i, t, word.findall(t.lower())) for i, t in items if word.search(t)]
    df = Counter(w for *_, ws in kept for w in set(ws))
    mean = sum(len(ws) for *_, ws in kept) / max(1, len(kept))
    stride = max(5, max((len(ws) for *_, ws in kept), default=1))
    made = []
    for i, t, ws in kept:
        tf = Counter(ws)
        score = {w: math.log(1 + (len(kept) - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w, n in tf.items()}
        sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", t) if word.search(s)]
        halves = ([w for s in sentences[:-1] for w in word.findall(s.lower())], word.findall(sentences[-1].lower())) if len(sentences) > 1 else (ws[: len(ws) // 2], ws[len(ws) // 2 :])
        made.append((i, score, sum(score.values()), halves))
    found = set()
    for d, text in docs:
        words = word.findall(text.lower())
        for at in range(0, len(words), stride):
            passage = words[at : at + 2 * stride]
            own = set(passage)
            for i, score, full, halves in made:
                if sum(s for w, s in score.items() if w in own) < 0.6 * full - 1e-12:
                    continue
                shares = []
                for h in halves:
                    n = min(5, len(h))
                    grams = {tuple(h[k : k + n]) for k in range(len(h) - n + 1)} if n else set()
                    there = {tuple(passage[k : k + n]) for k in range(len(passage) - n + 1)}
                    shares.append(len(grams & there) / len(grams) if grams else 1.0)
                if min(shares) >= 0.8:
                    found.add((d, i))
    return found


# --- near duplicates ---------------------------------------------------------------------------------------------------


def near_copies() -> list[tuple[int, str | None]]:
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    texts: list[str | None] = []
    for n in (4, 6, 30, 60, 120, 300):
        for _ in range(3):
            words = rng.choices(vocabulary, k=n)
            texts.append(" ".join(words))
            for changes in (0, 1, 2, 6):
                other = list(words)
                for _ in range(changes):
                    other[rng.randrange(n)] = rng.choice(vocabulary)
                texts.append(" ".join(other))
    texts += ["the same text for all of these many rows"] * 40 + ODD_TEXTS
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_near_duplicate_classes_equal_brute_force(spark):
    rows = near_copies()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, bucket string, size int")
    found = {r.doc_id: r.class_id for r in near_dup.classes(docs).collect()}
    assert found == brute_classes(rows)
    kept = near_dup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(found.values())


def test_registers_agree_as_often_as_the_weighted_similarity(spark):
    shingler = near_dup.Shingler()
    words = [f"w{i}" for i in range(120)]
    a, b = " ".join(words * 2), " ".join(words[:90] * 2 + words[90:])
    expected = (bag(a) & bag(b)).total() / (bag(a) | bag(b)).total()
    agree = []
    for k in range(40):  # other words, the same overlap
        pair = [t.replace("w", f"v{k}x") for t in (a, b)]
        sig = np.vstack([near_dup.signatures(near_dup.one_text(shingler, t), 1) for t in pair])
        agree.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(agree) - expected) < 0.03


def test_ids_with_several_texts_join_their_classes(spark):
    base = [" ".join(f"{c}{k}" for k in range(40)) for c in "abcd"]
    rows = [(1, base[0]), (2, base[1]), (3, base[0] + " more"), (4, base[1] + " more"), (9, base[0]), (9, base[1] + " again"), (5, base[2]), (5, base[2]), (6, base[3]), (None, base[3]), (None, None)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, Word int, mark int")
    found = sorted((r.doc_id, r.class_id) for r in near_dup.classes(docs).where("doc_id IS NOT NULL").collect())
    assert found == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (5, 5), (6, 6), (9, 1), (9, 1)]
    assert near_dup.classes(docs).where("doc_id IS NULL AND class_id IS NULL").count() == 2
    kept = near_dup.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "5", "5", "6", "None", "None"]


def test_recall_of_near_duplicates_against_all_pairs(spark):
    """All pairs of the documents of sf0.01, by an inverted index of runs; the classes must hold at least 95 % of them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    bags = {r.doc_id: bag(r.text or "") for r in docs.collect()}
    where: dict[tuple, list[int]] = {}
    for i, b in bags.items():
        for run in b:
            where.setdefault(run, []).append(i)
    size = {i: b.total() for i, b in bags.items()}
    pairs = set()
    for i, b in bags.items():
        met = Counter(j for run in b for j in where[run] if j < i and min(size[i], size[j]) >= 0.8 * max(size[i], size[j]))
        for j in met:
            shared = (b & bags[j]).total()
            if shared >= 0.8 * (size[i] + size[j] - shared) - 1e-9:
                pairs.add((i, j))
    name = {r.doc_id: r.class_id for r in near_dup.classes(docs).collect()}
    found = sum(name[i] == name[j] for i, j in pairs)
    print(f"pairs {len(pairs)}, found {found}")
    assert len(pairs) > 50 and found >= 0.95 * len(pairs)
    linked = {i for pair in pairs for i in pair}
    assert all(c == i for i, c in name.items() if i not in linked and bags[i])  # nothing else is joined


def test_near_duplicates_of_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.classes(empty).count() == 0 and near_dup.one_of_each(empty).count() == 0


# --- SentencePiece -----------------------------------------------------------------------------------------------------


def test_round_trip_and_reproducible(spark):
    rows = [(i, t, "kept") for i, t in enumerate(ODD_TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    made = sentencepiece_sampling.encode(docs, keep_text=True, check="same")
    back = sentencepiece_sampling.decode(made).orderBy("doc_id").collect()
    assert [r.decoded for r in back] == ODD_TEXTS
    assert all(r.same for r in back) and back[0].ids is None and back[1].ids == []
    again = {r.doc_id: r.ids for r in sentencepiece_sampling.encode(docs.repartition(5)).collect()}
    assert again == {r.doc_id: r.ids for r in back}
    assert {r.doc_id: r.ids for r in sentencepiece_sampling.encode(docs, seed=2).collect()} != again
    assert sentencepiece_sampling.encode(docs.limit(0)).count() == 0


def test_columns_of_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 5, [7], 9), (2, "c", 6, None, 8)], "doc_id long, text string, key int, IDS array<int>, _key int")
    made = sentencepiece_sampling.encode(docs)
    assert made.columns == ["doc_id", "text", "key", "_key", "ids"]
    assert [(r.key, r["_key"]) for r in made.orderBy("doc_id").collect()] == [(5, 9), (6, 8)]
    clash = spark.createDataFrame([(1, "a toxic b", 1, 2, 3, 4, 5)], "doc_id long, text string, score int, label int, Order int, item_id int, toxic int")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, toxic int, quality int")
    assert clash.select(toxicity.score(toxicity.train(clash, labels, F.lit(True)))["score"]).count() == 1
    assert clash.select(quality.score(clash, quality.train(clash, labels, F.lit(True)))).count() == 1
    assert decontaminate.leaks(clash, spark.createDataFrame([(4, "a toxic b", 1)], "item_id int, text string, doc_id int")).count() == 1


def test_long_runs_and_many_spaces_are_in_the_lattice():
    pieces, byte_ids, size = sentencepiece_sampling.pieces_of(sentencepiece_sampling.MODEL)
    lattice, speller = sentencepiece_sampling.Lattice(pieces, byte_ids, size, 0.6), sentencepiece_sampling.Speller(pieces, byte_ids, size)
    texts = ["ab" * 60_000, " " * 5000 + "x", "a  b" + " " * 16, "x" * 199 + "the" * 3]
    keys = np.arange(4, dtype=np.uint64)
    assert [speller.text(i.tolist()) for i in lattice.sample(texts, keys)] == texts
    spaces = {i for i, t in pieces if t.strip(" ") == "" and len(t) > 1}
    assert len(spaces) == 14 and spaces & set(lattice.sample([" " * 400], keys[:1])[0].tolist())
    crossing = [set(lattice.sample(["x" * 198 + "the" + "x" * 10], np.array([k], np.uint64))[0].tolist()) for k in range(40)]
    assert any(dict((t, i) for i, t in pieces)["the"] in c for c in crossing)


def test_sampling_takes_few_times_a_plain_pass_over_the_words(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    model, keys, word = sentencepiece_sampling.pieces_of(sentencepiece_sampling.MODEL), np.arange(len(texts), dtype=np.uint64), re.compile(r" +[^ \n]*|\n|[^ \n]+")
    times = []
    for _ in range(5):
        lattice, start = sentencepiece_sampling.Lattice(*model, 0.6), time.process_time()
        for at in range(0, len(texts), 256):
            lattice.sample(texts[at : at + 256], keys[at : at + 256])
        sampled = time.process_time()
        for t in texts:
            Counter(word.findall(t))
        times.append((sampled - start) / (time.process_time() - sampled))
    assert min(times) < 6.5


def test_units_have_the_same_tables_in_whichever_batch_they_come():
    model, one = sentencepiece_sampling.pieces_of(sentencepiece_sampling.MODEL), np.arange(1, dtype=np.uint64)
    alone, among = sentencepiece_sampling.Lattice(*model, 0.6), sentencepiece_sampling.Lattice(*model, 0.6)
    alone.sample(["there there there"], one)
    among.sample([" ".join(f"{w} {w}" for w in ["x" * 90, *(f"w{n}é" for n in range(3000)), "there there", "東京 🎉" * 9, "a\n\n \n"])], one)

    def arcs(lattice, unit):
        states, found = [lattice.at[unit]], []
        for s in states:
            arc = int(lattice.first[s])
            while True:
                found.append((float(lattice.cum[arc]), int(lattice.piece[arc])))
                if lattice.back[arc] >= 0:
                    states.append(int(lattice.back[arc]))
                if lattice.cum[arc] == 2.0:
                    break
                arc += 1
        return found

    assert arcs(alone, b" there") == arcs(among, b" there")


def test_segmentation_needs_little_memory_for_many_new_units():
    lattice, rng = sentencepiece_sampling.Lattice(*sentencepiece_sampling.pieces_of(sentencepiece_sampling.MODEL), 0.6), random.Random(7)
    texts = [" ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(3, 12))) for _ in range(300)) for _ in range(256)]
    for parts in ([sentencepiece_sampling.spaced(t) for t in texts], [sentencepiece_sampling.spaced(" ".join(texts))]):  # many texts, and a long one
        lattice.forget()
        tracemalloc.start()
        lattice.draw(parts, np.arange(len(parts), dtype=np.uint64))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 90e6


def test_blocks_and_chunks_do_not_change_segmentations(monkeypatch):
    model = sentencepiece_sampling.pieces_of(sentencepiece_sampling.MODEL)
    parts = [sentencepiece_sampling.spaced(t) for t in [*ODD_TEXTS, None, " ".join(f"w{n % 700} w{n % 900}é 東京" for n in range(2000)), ""]]
    keys = np.arange(len(parts), dtype=np.uint64)
    ids, ends = sentencepiece_sampling.Lattice(*model, 0.6).draw(parts, keys)
    for sizes in ({"BLOCK": 1000, "CHUNK": 50}, {"BLOCK": 1, "CHUNK": 1}, {"BLOCK": 5000, "CHUNK": 300, "KEEP": 0}):
        for name, size in sizes.items():
            monkeypatch.setattr(sentencepiece_sampling, name, size)
        again = sentencepiece_sampling.Lattice(*model, 0.6).draw(parts, keys)
        assert again[0].tolist() == ids.tolist() and again[1].tolist() == ends.tolist()


def test_slices_of_a_batch_hold_a_block_of_text_or_one_row():
    texts = ["a" * 400_000] * 5 + ["b" * 3_000_000, None, ""] + ["c"] * 600
    cut = list(sentencepiece_sampling.slices(pa.RecordBatch.from_pydict({"text": texts}), "text", 256))
    assert [t for b in cut for t in b.column("text").to_pylist()] == texts
    assert all(b.num_rows == 1 or b.num_rows <= 256 and sum(len(t or "") for t in b.column("text").to_pylist()) <= sentencepiece_sampling.BLOCK for b in cut)


def test_check_finds_each_text_that_its_ids_do_not_give():
    speller = sentencepiece_sampling.Speller(*sentencepiece_sampling.pieces_of(sentencepiece_sampling.MODEL))
    lattice = sentencepiece_sampling.Lattice(*sentencepiece_sampling.pieces_of(sentencepiece_sampling.MODEL), 0.6)
    parts = [sentencepiece_sampling.spaced(t) for t in ODD_TEXTS]
    ids, ends = lattice.draw(parts, np.arange(len(parts), dtype=np.uint64))
    assert all(speller.same(ids, ends, parts))
    for i, part in enumerate(parts):
        wrong = [*parts[:i], part[:-1] if part else b" ", *parts[i + 1 :]]
        assert speller.same(ids, ends, wrong) == [n != i for n in range(len(parts))]
    nothing = lattice.draw([b"", b""], np.arange(2, dtype=np.uint64))
    assert nothing[0].tolist() == [] and nothing[1].tolist() == [0, 0] and speller.same(*nothing, [b"", b""]) == [True, True]


def test_segmentations_are_drawn_in_proportion_to_their_weight():
    pieces, byte_ids, size = sentencepiece_sampling.pieces_of(sentencepiece_sampling.MODEL)
    lattice = sentencepiece_sampling.Lattice(pieces, byte_ids, size, 0.6)
    by_text = {t: i for i, t in pieces}

    def ways(rest: str) -> list[tuple[tuple[int, ...], float]]:
        if not rest:
            return [((), 1.0)]
        first = [(n, by_text[rest[:n]], lattice.log_p[by_text[rest[:n]]]) for n in range(1, len(rest) + 1) if rest[:n] in by_text]
        if rest[0] not in by_text:  # spelt as its one byte
            first.append((1, byte_ids[ord(rest[0])], lattice.spelt))
        return [((i, *tail), math.exp(0.6 * p) * w) for n, i, p in first for tail, w in ways(rest[n:])]

    expected = ways(" there")
    total = sum(w for _, w in expected)
    n = 20_000
    keys = np.random.default_rng(0).integers(0, 1 << 63, n).astype(np.uint64)
    seen = Counter(tuple(ids.tolist()) for ids in lattice.sample(["there"] * n, keys))
    assert set(seen) <= {ids for ids, _ in expected}
    assert sum(abs(seen[ids] / n - w / total) for ids, w in expected) < 0.05


# --- toxicity and quality ----------------------------------------------------------------------------------------------


def test_marginals_equal_the_sum_over_all_labellings():
    rng = np.random.default_rng(1)
    odds, trans = rng.uniform(0.1, 5, (6, 1)), rng.uniform(0.2, 3, (2, 2))
    total, toxic, pairs = 0.0, np.zeros(6), np.zeros((2, 2, 5))
    for ys in itertools.product((0, 1), repeat=6):
        w = np.prod([odds[t, 0] ** y for t, y in enumerate(ys)]) * np.prod([trans[a, b] for a, b in itertools.pairwise(ys)])
        total += w
        toxic += w * np.array(ys)
        for t, (a, b) in enumerate(itertools.pairwise(ys)):
            pairs[a, b, t] += w
    assert np.allclose(toxicity.marginals(odds, trans)[:, 0], toxic / total)
    assert np.allclose(toxicity.pair_marginals(odds, trans)[..., 0], pairs / total)


def test_a_whole_text_is_one_chain():
    rng = np.random.default_rng(2)
    sizes = [0, 1, 2, 63, 64, 65, 128, 129, 0, 700, 7]
    odds, trans = [np.exp(rng.normal(size=n) * 5) for n in sizes], np.exp(rng.normal(size=(2, 2)) * 2)

    def plain(x: np.ndarray) -> np.ndarray:
        ahead, back = np.empty((len(x), 2)), np.ones((len(x), 2))
        for t in range(len(x)):
            ahead[t] = np.array([1, x[t]]) * (ahead[t - 1] @ trans if t else 1)
            ahead[t] /= ahead[t].sum()
        for t in range(len(x) - 2, -1, -1):
            back[t] = trans @ (np.array([1, x[t + 1]]) * back[t + 1])
            back[t] /= back[t].sum()
        return ahead[:, 1] * back[:, 1] / (ahead * back).sum(axis=1)

    assert np.allclose(toxicity.chain_marginals(np.concatenate(odds), trans, np.array(sizes)), np.concatenate([plain(x) for x in odds if len(x)]))
    field = toxicity.Field(np.zeros(toxicity.SIZE), np.array([[1.0, -1.0], [0.0, 2.0]]))
    p = toxicity.token_marginals(["foo bar"], field, toxicity.Odds(field.weights))[0]
    step, total, toxic = np.exp(field.trans), 0.0, np.zeros(2)
    for a, b in itertools.product((0, 1), repeat=2):
        total += step[a, b]
        toxic += step[a, b] * np.array([a, b])
    assert np.allclose(p, toxic / total)


def test_ftrl_equals_a_plain_loop():
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(50, 6, replace=False)), rng.uniform(0.1, 2, 6), int(rng.integers(2))) for _ in range(200)]
    alpha, beta, l1, l2 = 0.3, 1.0, 0.002, 0.001
    z, n, bias = Counter(), Counter(), quality.SIZE + 2

    def weight(i: int) -> float:
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for index, value, label in rows * 2:
        x = {**dict(zip(index.tolist(), value.tolist(), strict=True)), bias: 1.0}
        w = {i: weight(i) for i in x}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
        for i, v in x.items():
            g = (p - label) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
            n[i] += g * g
    made = quality.train_ftrl(rows, 2)
    assert np.allclose(made[[*range(50), bias]], [weight(i) for i in [*range(50), bias]])
    codes = quality.Codes()
    places = quality.features("One two two, three!", codes)
    weights = rng.normal(size=quality.SIZE + 3)
    assert np.isclose(sum(weights[p] for p in places) * quality.SCALE / len(places), (lambda i, v: weights[i] @ v)(*quality.vector("One two two, three!", codes)))


def test_one_row_an_id_is_learned_from(spark):
    rows = [(i, f"{'good' if i % 2 else 'bad'} text {i} of words") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    once = spark.createDataFrame(rows, "doc_id long, text string")
    often = spark.createDataFrame(rows + [(3, "good text 3 of words"), (3, "zzz other")] * 50, "doc_id long, text string")
    assert np.array_equal(quality.train(once, labels, F.lit(True)), quality.train(often, labels, F.lit(True)))
    assert np.array_equal(toxicity.train(once, labels, F.lit(True)).weights, toxicity.train(often, labels, F.lit(True)).weights)


def area(score: np.ndarray, label: np.ndarray) -> float:
    """Area under the ROC curve, ties counted half."""
    good, bad = score[label == 1], score[label == 0]
    return float(((good[:, None] > bad[None]) + 0.5 * (good[:, None] == bad[None])).mean())


@pytest.mark.parametrize(("name", "label"), [("op5_toxicity", "toxic"), ("op8_quality", "quality")])
def test_held_out_accuracy(spark, name, label):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").where(F.col(label).isNotNull()).select("doc_id", label)
    rows = QUERIES[name](spark, LARGER).where("held_out").join(labels, "doc_id").select("score", "predicted", label).toPandas()
    assert len(rows) > 300 and rows["score"].between(0, 1).all()
    assert area(rows["score"].to_numpy(), rows[label].to_numpy()) > 0.93


def test_classifiers_without_labels_and_with_odd_texts(spark):
    docs = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    field = toxicity.train(docs, none, F.lit(True))
    assert [r[0] < 1e-6 for r in docs.select(toxicity.score(field)["score"]).collect()] == [True] * len(ODD_TEXTS)
    weights = quality.train(docs, none, F.lit(True))
    assert {r[0] for r in docs.select(quality.score(docs, weights)).collect()} == {0.5}


# --- decontamination ---------------------------------------------------------------------------------------------------


def test_leaks_equal_brute_force(spark, sf_dir):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    odd = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(ODD_TEXTS)], "doc_id long, text string")
    whole = items.orderBy("item_id").first().text
    odd = odd.unionAll(spark.createDataFrame([(-90, f"before {whole} after"), (-91, whole[: len(whole) // 3])], odd.schema))
    both = docs.select("doc_id", "text").unionAll(odd)
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(both, items).collect()}
    assert (-90, items.orderBy("item_id").first().item_id) in found
    assert found == brute_leaks([(r.doc_id, r.text or "") for r in both.collect()], [(r.item_id, r.text or "") for r in items.collect()])


def test_leaks_do_not_depend_on_the_number_of_shards(spark, sf_dir, monkeypatch):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    odd = [(-1, None), (-2, ""), (-3, "?!"), (-4, "Straße ÄX naïve 東京. One long item " + "so long " * 90)]
    items = items.select(F.col("item_id").cast("long"), "text").unionAll(spark.createDataFrame(odd, "item_id long, text string"))
    cut = [(-10 - r.item_id, " ".join(w if k % 9 else "other" for k, w in enumerate(r.text.split()))) for r in items.where("item_id >= 0").collect()]
    docs = docs.unionAll(spark.createDataFrame([*cut, (-5, odd[3][1])], "doc_id long, text string"))
    found = {}
    for shard in (20_000, max(1, items.count() // 3), 10):
        monkeypatch.setattr(decontaminate, "SHARD", shard)
        found[shard] = {(r.doc_id, r.item_id): tuple(r)[2:] for r in decontaminate.leaks(docs, items, overlap=0.3).collect()}
    one, many, more = found.values()
    assert more.keys() == one.keys() and all(np.allclose(one[k], more[k], rtol=1e-9) for k in one)
    assert (-5, -4) in one and len(one) > 10 and one.keys() == many.keys()
    assert all(np.allclose(one[k], many[k], rtol=1e-9) for k in one)


def test_leaks_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, None)], "item_id long, text string")
    assert decontaminate.leaks(docs, items).count() == 0
    assert decontaminate.leaks(spark.createDataFrame([(1, "some words")], "doc_id long, text string"), items.limit(0)).count() == 0


# --- nearest neighbours ------------------------------------------------------------------------------------------------


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    mat = rng.standard_normal((600, 24))
    mat[100:160] = mat[7]  # equal vectors: ties go to the smaller id
    rows = [(i, v.tolist(), "x") for i, v in enumerate(mat)]
    rows += [(900, None, "x"), (901, [0.0] * 24, "x"), (902, [float("nan")] * 24, "x"), (903, [None, *[1.0] * 23], "x"), (904, [], "x"), (950, [1.0, 2.0], "x")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block string")
    found = ann.search(vectors, vectors.where("vec_id % 50 = 0"), k=5, block=128).collect()
    unit = mat / np.linalg.norm(mat, axis=1)[:, None]
    hit = 0
    for q in range(0, 600, 50):
        score = unit @ unit[q]
        score[q] = -2
        hit += len(set(np.lexsort((np.arange(600), -np.round(score, 12)))[:5].tolist()) & {r.vec_id for r in found if r.query_id == q})
    assert hit >= 0.99 * 60 and len(found) == 60
    assert all(abs(r.score - unit[r.query_id] @ unit[r.vec_id]) < 1e-12 for r in found)
    assert ann.search(vectors.limit(0), vectors.limit(0)).count() == 0


def test_vectors_of_extreme_lengths(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1.0]), (2, [1.0, 2.0]), (50, [1e-200, 0.0]), (51, [5e-324, 0.0]), (52, [-1e308, 1e308])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {(r.query_id, r.vec_id): r.score for r in ann.search(vectors, vectors.where("vec_id % 50 = 0"), k=5).collect()}
    assert len(found) == 10
    expected = {1: 1.0, 2: 1 / math.sqrt(5), 51: 1.0, 52: -math.sqrt(0.5)}
    assert all(math.isclose(found[q, v], x, rel_tol=1e-12) for q in (0, 50) for v, x in expected.items())


def test_bit_counts_give_the_estimate_within_its_bound():
    rng = np.random.default_rng(5)
    mat = rng.standard_normal((500, 40))
    codes, corr = ann.encode(mat, 256, 11)
    found = ann.search_block(np.arange(500), mat, codes, corr, np.array([-1]), mat[:1] + 0.3 * rng.standard_normal((1, 40)), 500, 4.5, 11)
    assert sorted(i for _, i, _ in found) == list(range(500)) and found[0][1] == 0


# --- pipeline ----------------------------------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, sf_dir, tmp_path):
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        kept.append({r.doc_id: r for r in docs.collect()})
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    score = {r.doc_id: r.score for r in QUERIES["op5_toxicity"](spark, sf_dir).collect()}
    assert set(kept[0]) == {i for i in before if score[i] < corpus_pipeline.TOXIC}
    assert set(kept[1]) == set(brute_classes([(i, before[i]) for i in kept[0]]).values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert set(kept[2]) == set(kept[1]) - {d for d, _ in brute_leaks([(i, before[i] or "") for i in kept[1]], items)}
    assert set(kept[3]) == set(kept[2])
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for i, r in kept[3].items():
        assert not mail.search(r.text or "")
        assert "@" in (before[i] or "") or "[" in (r.text or "") or r.text == before[i]
    speller = sentencepiece_sampling.Speller(*sentencepiece_sampling.pieces_of(sentencepiece_sampling.MODEL))
    assert {i: speller.text(r.ids) for i, r in kept[4].items()} == {i: r.text or "" for i, r in kept[3].items()}
    assert corpus_pipeline.run(spark, sf_dir).count() == len(kept[4])
