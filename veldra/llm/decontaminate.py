"""Benchmark decontamination: a BM25 index of the test items, queried by every passage with block-max WAND.

The test items are the indexed documents, in classes of lengths; for each class the training documents are cut into passages, each long enough and overlapping
enough that any item of the class lies whole in one of them. A passage's words are the query; an item's BM25 score is divided by the
score that the item's own words would get, so one threshold serves all items, and all items at or above it are retrieved:
lists are walked in item order, upper bounds of lists choose the pivot, and the bounds of the pivot's blocks allow skips.
A passage is
walked only if some item could reach the threshold by the exact sum over its short lists and a bound for its long ones. Retrieved pairs are then verified: the shares
of the question's and of the answer's word runs of five that occur in the passage must both reach ``overlap``. The answer
is the item's last sentence, the question what precedes it (an item of one sentence is cut in the middle).

The index goes to the tasks in shards of about ``SHARD`` items and ``SHARD_CHARS`` characters, so what is sent at once is bounded however large the
benchmark is; each further shard is a further pass over the documents, stored before the next index is built. Scores and
passages don't depend on the shards: the number of items, their mean length and the document frequencies of a shard's words
are those of all items, and a class is the lengths between two powers of two.

Defined cases: null texts are empty; items without words match nothing; items of equal text are all reported; repeated
documents are reported each, repeated item ids, too; empty tables give no rows; other columns are ignored; null item ids are left out.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldra.llm.common import stored

WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
RUN, BLOCK, SHARD, SHARD_CHARS, SHORT = 5, 32, 20_000, 8_000_000, 20
K1, B = 1.2, 0.75


def runs(words: list[str]) -> set[tuple[str, ...]]:
    n = min(RUN, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


class Totals(NamedTuple):
    """Of all items that have words: their number, mean length, and document frequencies of words."""

    n: int
    mean: float
    df: dict[str, int]


def totals(words: list[list[str]]) -> Totals:
    sizes = [len(w) for w in words]
    return Totals(len(sizes), sum(sizes) / max(1, len(sizes)), Counter(t for w in words for t in set(w)))


class Index:
    """Postings by term, in item order, cut into blocks with their largest scores.

    whole: totals of more items than these; terms: numbers of more terms than these items'.
    """

    def __init__(self, items: list[tuple[int, str]], whole: Totals | None = None, terms: dict[str, int] | None = None):
        words = [WORD.findall(t.lower()) for _, t in items]
        keep = [i for i, w in enumerate(words) if w]
        self.ids, self.words = [items[i][0] for i in keep], [words[i] for i in keep]
        self.halves = []
        for i in keep:
            cut = [s for s in SENTENCE.split(items[i][1]) if WORD.search(s)]
            if len(cut) > 1:
                q, a = [w for s in cut[:-1] for w in WORD.findall(s.lower())], WORD.findall(cut[-1].lower())
            else:
                w = words[i]
                q, a = w[: len(w) // 2], w[len(w) // 2 :]
            self.halves.append((runs(q), runs(a)))
        n, mean, df = whole or totals(self.words)
        self.longest = (1 << max(map(len, self.words), default=1).bit_length()) - 1  # of all items of such a length
        self.terms = terms or {t: i for i, t in enumerate(sorted({t for w in self.words for t in w}))}
        lists: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for d, w in enumerate(self.words):
            own = {}
            for t, tf in Counter(w).items():
                idf = np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                own[self.terms[t]] = float(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean)))
            full = sum(own.values())
            for t, s in own.items():
                lists[t].append((d, s / full))
        self.docs = [[d for d, _ in lists[t]] for t in range(len(self.terms))]
        self.scores = [[s for _, s in lists[t]] for t in range(len(self.terms))]
        self.bound = np.array([max(s, default=0.0) for s in self.scores] or [0.0])
        self.block_max = [[max(s[i : i + BLOCK]) for i in range(0, len(s), BLOCK)] for s in self.scores]
        # short lists in one array each, and what an item's long lists can add at most
        short = [0 < len(d) <= SHORT for d in self.docs]
        self.short = np.array([*short, False], bool)  # the last one for words that no item has, term -1
        self.start = np.concatenate([[0], np.cumsum([len(d) if s else 0 for d, s in zip(self.docs, short, strict=True)])]).astype(np.int64)
        self.short_docs = np.array([x for d, s in zip(self.docs, short, strict=True) if s for x in d], np.int64)
        self.short_scores = np.array([x for d, s in zip(self.scores, short, strict=True) if s for x in d])
        self.rest = np.zeros(max(1, len(self.words)))
        for d, x, s in zip(self.docs, self.scores, short, strict=True):
            if not s:
                self.rest[d] += x

    def promising(self, passage: np.ndarray, term: np.ndarray, least: float) -> np.ndarray:
        """The passages of which some item could reach ``least``: its exact sum over short lists, and its bound over long ones."""
        sizes = self.start[term + 1] - self.start[term]
        at = np.repeat(self.start[term] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        n = len(self.rest)
        key = np.repeat(passage, sizes) * n + self.short_docs[at]
        if not len(key):
            return key
        if int(passage[-1] + 1) * n <= 1 << 20:
            total = np.bincount(key, self.short_scores[at])
            kept = np.flatnonzero(total)
            total = total[kept]
        else:
            kept, which = np.unique(key, return_inverse=True)
            total = np.bincount(which, self.short_scores[at])
        return np.unique(kept[total >= least - self.rest[kept % n] - 1e-9] // n)

    def wand(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """(item, score) of all items whose score over these distinct terms is at least ``least``."""
        at = {t: 0 for t in terms}
        live = sorted((t for t in terms if self.docs[t]), key=lambda t: self.docs[t][0])
        found = []
        while live:
            total, pivot = 0.0, -1
            for k, t in enumerate(live):
                total += self.bound[t]
                if total >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            doc = self.docs[live[pivot]][at[live[pivot]]]
            while pivot + 1 < len(live) and self.docs[live[pivot + 1]][at[live[pivot + 1]]] == doc:
                pivot += 1
            ahead, skip_to, blocks = live[: pivot + 1], None, 0.0
            for t in ahead:  # the blocks in which doc would stand
                i = bisect_left(self.docs[t], doc, at[t]) // BLOCK
                if i < len(self.block_max[t]):
                    blocks += self.block_max[t][i]
                    last = self.docs[t][min(len(self.docs[t]), (i + 1) * BLOCK) - 1]
                    skip_to = last if skip_to is None else min(skip_to, last)
            if blocks >= least:
                score = 0.0
                for t in ahead:
                    i = at[t] = bisect_left(self.docs[t], doc, at[t])
                    if i < len(self.docs[t]) and self.docs[t][i] == doc:
                        score += self.scores[t][i]
                if score >= least:
                    found.append((doc, score))
                target = doc + 1
            else:  # no item up to the end of the first of these blocks can reach the threshold, nor before the next list's item
                target = max(doc, skip_to if skip_to is not None else doc) + 1
                if pivot + 1 < len(live):
                    target = max(doc + 1, min(target, self.docs[live[pivot + 1]][at[live[pivot + 1]]]))
            for t in ahead:
                at[t] = bisect_left(self.docs[t], target, at[t])
            live = sorted((t for t in live if at[t] < len(self.docs[t])), key=lambda t: self.docs[t][at[t]])
        return found

    def hits(self, text: str, least: float, overlap: float, codes: dict[str, int]) -> dict[int, tuple[float, float, float]]:
        """item -> (best score, question share, answer share) of the verified items of a text."""
        words = WORD.findall(text)
        return self.hits_of(words, np.fromiter(map(codes.__getitem__, words), np.int64, len(words)), least, overlap) if words else {}

    def hits_of(self, words: list[str], term: np.ndarray, least: float, overlap: float) -> dict[int, tuple[float, float, float]]:
        """``hits`` of a text's words and their terms."""
        stride = max(RUN, self.longest)
        some = np.flatnonzero(self.short[term])
        near = np.empty(0, np.int64)
        if len(some):  # a word stands in the passage that begins in its stretch, and in the one before
            home = some // stride
            later = home > 0
            pairs = np.unique(np.concatenate([home, home[later] - 1]) * len(self.bound) + np.concatenate([term[some], term[some[later]]]))
            near = self.promising(pairs // len(self.bound), pairs % len(self.bound), least)
        if self.rest.max() >= least:  # there is an item of common words only: no passage can be left out beforehand
            near = np.arange(-(-len(words) // stride))
        out: dict[int, tuple[float, float, float]] = {}
        for p in near:
            own = np.unique(term[p * stride : (p + 2) * stride])
            found = self.wand(own[own >= 0].tolist(), least)
            if not found:
                continue
            here = [w.lower() for w in words[p * stride : (p + 2) * stride]]
            grams: dict[int, set[tuple[str, ...]]] = {}
            for item, score in found:
                shares = []
                for part in self.halves[item]:
                    n = len(next(iter(part))) if part else 0
                    if n not in grams:
                        grams[n] = {tuple(here[i : i + n]) for i in range(len(here) - n + 1)}
                    shares.append(len(part & grams[n]) / len(part) if part else 1.0)
                if min(shares) >= overlap and (item not in out or score > out[item][0]):
                    out[item] = (score, *shares)
        return out


class Classes:
    """An index for each class of lengths (powers of two), over the same terms, so that a passage is about as long as the items it is held against."""

    def __init__(self, items: list[tuple[int, str]], whole: Totals | None = None):
        words = {i: WORD.findall(t.lower()) for i, (_, t) in enumerate(items)}
        whole = whole or totals([w for w in words.values() if w])
        self.terms = {t: i for i, t in enumerate(sorted({t for w in words.values() for t in w}))}
        classes: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for i, w in words.items():
            if w:
                classes[len(w).bit_length()].append(items[i])
        self.parts = {c: Index(part, whole, self.terms) for c, part in sorted(classes.items())}
        self.all = Index(items, whole, self.terms)
        self.class_of = np.array([len(w).bit_length() for w in self.all.words], np.int64)

    def likely(self, term: np.ndarray, least: float) -> list[int]:
        """The classes with an item that all words of a text together could bring to ``least``; no passage can do what its text can't."""
        own, all_ = np.unique(term), self.all
        own = own[all_.short[own]]
        sizes = all_.start[own + 1] - all_.start[own]
        at = np.repeat(all_.start[own] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        total = all_.rest + np.bincount(all_.short_docs[at], all_.short_scores[at], len(all_.rest))
        near = np.flatnonzero(total >= least - 1e-9)
        return np.unique(self.class_of[near]).tolist() if len(near) else []

    def hits(self, text: str, least: float, overlap: float, codes: dict[str, int]) -> list[tuple[int, float, float, float]]:
        """(item id, best score, question share, answer share) of the verified items of a text."""
        words = WORD.findall(text)
        if not words:
            return []
        term = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
        likely = [self.parts[c] for c in self.likely(term, least)]
        return [(part.ids[item], *found) for part in likely for item, found in part.hits_of(words, term, least, overlap).items()]


class Codes(dict):
    """word as written -> its term, or -1; forgets everything when it grows large."""

    def __init__(self, terms: dict[str, int]):
        super().__init__()
        self.terms = terms

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = code = self.terms.get(word.lower(), -1)
        return code


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.6, overlap: float = 0.8) -> DataFrame:
    """(doc_id, item_id, bm25_share, question_overlap, answer_overlap) of each verified pair."""
    items = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    shards = max(1, -(-total // SHARD), -(-chars // SHARD_CHARS))
    schema = "doc_id long, item_id long, bm25_share double, question_overlap double, answer_overlap double"

    # hash-cut, so of about SHARD rows and SHARD_CHARS characters
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(shards)))
    if shards > 1:

        @F.pandas_udf("array<string>")
        def words_of(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: WORD.findall(t.lower()))

        counted = items.select("shard", words_of("text").alias("words")).where("size(words) > 0")
        n, mean = counted.agg(F.count("*"), F.avg(F.size("words"))).first()
        each = counted.select("shard", F.explode(F.array_distinct("words")).alias("word")).groupBy("word", "shard").agg(F.count("*").alias("n"))
        df = each.select("shard", "word", F.sum("n").over(Window.partitionBy("word")).alias("df")).persist()  # a word has a row a shard

    def one(k: int) -> DataFrame:
        part, whole = items, None
        if shards > 1:
            part = items.where(F.col("shard") == k)
            whole = Totals(n, mean or 0.0, {r.word: r.df for r in df.where(F.col("shard") == k).collect()})  # words of about SHARD items
        index = docs.sparkSession.sparkContext.broadcast(Classes(sorted((r.item_id, r.text) for r in part.collect()), whole))

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = index.value
            codes = Codes(own.terms)
            for batch in it:
                rows = []
                for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                    rows += [(doc.as_py(), *found) for found in own.hits(text.as_py(), least, overlap, codes)]
                columns = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in range(5)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int64(), *[pa.float64()] * 3], strict=True)], ["doc_id", "item_id", "bm25_share", "question_overlap", "answer_overlap"])

        made = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(run, schema)
        if shards > 1:  # one index at a time is on the driver and in the executors
            made = stored(made, "leaks-of-shard")
            index.destroy()
        return made

    found = reduce(DataFrame.unionAll, [one(k) for k in range(shards)])
    if shards > 1:
        df.unpersist()
    return found
