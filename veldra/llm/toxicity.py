"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are words; a token is plain (O) or toxic (T). Training takes about ``max_rows`` labelled documents at most (a
documented bound), as many toxic as plain ones. Token labels come from the document labels: in toxic documents a token is
labelled T if its word or one of its prefixes is found after many *different* words in toxic documents and hardly ever in
plain ones (different words before it, so that copies of one text count once). The field's features are hashed words,
prefixes, suffixes and shapes; it is fitted by AdaGrad on the likelihood of stretches of 32 tokens, by forward-backward.

For scoring, forward-backward runs over the whole chain of a text: the transfer matrices of stretches of ``WINDOW`` tokens
are multiplied first, messages go from stretch to stretch through these, and then all stretches are filled in at once, so
the marginals are those of the uncut chain. A document's score is a logistic function of the log of its number of surely
toxic tokens; tokens with a marginal of at least 0.5 are returned as spans.

Defined cases: null text is empty; an empty text has no toxic tokens and gets the score of such texts; rows with a null
label or id aren't learned from; of several rows of an id the
least text is learned from; with no labelled rows of both kinds every score is 0; of several labels for an id the
largest counts; repeated rows are scored each; an empty table gives no rows; columns named like results are replaced.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
BITS, WINDOW = 17, 64
SIZE = 1 << BITS


def parts(word: str) -> list[str]:
    """What a word may be toxic by: itself and its prefixes of 4 to 6 letters."""
    return [f"={word}", *(f"^{word[:n]}" for n in (4, 5, 6) if len(word) > n)]


def feature_ids(word: str) -> list[int]:
    low = word.lower()
    names = [*parts(low), f"^{low[:3]}", f"${low[-3:]}", f"#{min(len(low), 12)}", "bias"]
    return [zlib.crc32(x.encode("utf-8", "replace")) % SIZE for x in names]


def messages(odds: np.ndarray, trans: np.ndarray, real: np.ndarray | None = None, ahead_in: np.ndarray | None = None, back_in: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages, kept as ratios T : O, so a step is a handful of products and no logarithm.

    odds: (steps, stretches) of exp(score of T); trans: exp of the transition scores [from, to]; real: where tokens stand
    (the others, at a stretch's end, aren't there). ahead_in: what comes from the token before a stretch, or NaN at the
    first token of a text; back_in: what comes back into its last token, 1 where nothing follows.
    """
    (oo, ot), (to, tt) = trans
    steps = len(odds)
    ahead, back = np.empty_like(odds), np.ones_like(odds)
    ahead[0] = odds[0]
    if ahead_in is not None:
        ahead[0] = np.where(np.isnan(ahead_in), odds[0], odds[0] * (ahead_in * tt + ot) / (ahead_in * to + oo))
    if back_in is not None:
        back[-1] = back_in
    for t in range(1, steps):
        r = ahead[t - 1]
        ahead[t] = odds[t] * (r * tt + ot) / (r * to + oo)
    for t in range(steps - 2, -1, -1):
        r = odds[t + 1] * back[t + 1]
        back[t] = (r * tt + to) / (r * ot + oo)
        if real is not None:
            gone = ~real[t + 1]
            back[t, gone] = back[t + 1, gone]
    return ahead, back


def transfers(odds: np.ndarray, trans: np.ndarray, real: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """(2, 2, stretches): products of the steps' matrices [from, to], scaled; begins: stretches with a text's first token."""
    (oo, ot), (to, tt) = trans
    a, b, c, d = (np.where(begins, x, y) for x, y in ((1.0, oo), (0.0, ot), (0.0, to), (1.0, tt)))
    b, d = b * odds[0], d * odds[0]
    for t in range(1, len(odds)):
        x, here = odds[t], real[t]
        if not here.all():
            na, nb, nc, nd = a * oo + b * to, (a * ot + b * tt) * x, c * oo + d * to, (c * ot + d * tt) * x
            a, b, c, d = np.where(here, na, a), np.where(here, nb, b), np.where(here, nc, c), np.where(here, nd, d)
        else:
            a, b, c, d = a * oo + b * to, (a * ot + b * tt) * x, c * oo + d * to, (c * ot + d * tt) * x
        if t % 8 == 0:  # exp(20 * 8) at most between two scalings
            top = np.maximum(np.maximum(a, b), np.maximum(c, d))
            a, b, c, d = a / top, b / top, c / top, d / top
    return np.array([[a, b], [c, d]])


def chain_marginals(odds: np.ndarray, trans: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """P(T) of the tokens of several texts of ``sizes`` tokens each, one text after another in ``odds``."""
    sizes = np.asarray(sizes, np.int64)
    n = -(-sizes // WINDOW)  # stretches of each text
    total = int(n.sum())
    if not total:
        return np.empty(0)
    last = np.cumsum(n)
    first = last - n
    begin = np.cumsum(sizes) - sizes
    at = np.repeat(first * WINDOW - begin, sizes) + np.arange(len(odds))
    flat, real = np.ones(total * WINDOW), np.zeros(total * WINDOW, bool)
    flat[at], real[at] = odds, True
    flat, real = np.ascontiguousarray(flat.reshape(total, WINDOW).T), np.ascontiguousarray(real.reshape(total, WINDOW).T)
    ahead_in, back_in = np.full(total, np.nan), np.ones(total)
    long = np.flatnonzero(n > 1)
    if len(long):
        begins = np.zeros(total, bool)
        begins[first[n > 0]] = True
        of_long = np.repeat(n > 1, n)
        moved = np.empty((2, 2, total))
        moved[:, :, of_long] = transfers(flat[:, of_long], trans, real[:, of_long], begins[of_long])
        long = long[np.argsort(-n[long], kind="stable")]
        f = np.ones((2, len(long)))
        b = np.ones((2, len(long)))
        for k in range(int(n[long[0]]) - 1):  # from stretch to stretch, all texts that have so many at once
            live = long[: int(np.searchsorted(-n[long], -(k + 1), side="left"))]
            w = first[live] + k
            f = np.einsum("ix,ijx->jx", f[:, : len(live)], moved[:, :, w])
            f /= f.max(axis=0)
            ahead_in[w + 1] = f[1] / np.maximum(f[0], 1e-300)
            w = last[live] - 1 - k
            b = np.einsum("ijx,jx->ix", moved[:, :, w], b[:, : len(live)])
            b /= b.max(axis=0)
            back_in[w - 1] = b[1] / np.maximum(b[0], 1e-300)
    ahead, back = messages(flat, trans, real, ahead_in, back_in)
    both = ahead * back
    return np.ascontiguousarray((both / (1 + both)).T).reshape(-1)[at]


def marginals(odds: np.ndarray, trans: np.ndarray, real: np.ndarray | None = None) -> np.ndarray:
    """P(T) of each token."""
    ahead, back = messages(odds, trans, real)
    both = ahead * back
    return both / (1 + both)


def pair_marginals(odds: np.ndarray, trans: np.ndarray, real: np.ndarray | None = None) -> np.ndarray:
    """P(from, to) of each two neighbouring tokens: (2, 2, steps - 1, stretches)."""
    ahead, back = messages(odds, trans, real)
    after = odds[1:] * back[1:]
    one = np.ones_like(after)
    joint = np.stack([np.stack([trans[0, 0] * one, trans[0, 1] * after]), ahead[:-1] * np.stack([trans[1, 0] * one, trans[1, 1] * after])])
    return joint / joint.sum(axis=(0, 1))


def token_labels(texts: list[str], toxic: np.ndarray, least: float = 0.005, rate: float = 0.02) -> tuple[list[list[str]], list[np.ndarray]]:
    """Lower-case words of each text and their labels."""
    words = [WORD.findall(t.lower()) for t in texts]
    before: dict[str, set[int]] = defaultdict(set)
    plain: Counter[str] = Counter()
    seen: Counter[str] = Counter()
    bad_docs, good_docs = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    enough = max(4, least * bad_docs)
    for ws, bad in zip(words, toxic, strict=True):
        own = set()
        for i, w in enumerate(ws):
            own.update(parts(w))
            if bad:
                ahead = zlib.crc32(ws[i - 1].encode("utf-8", "replace")) if i else 0
                for p in parts(w):
                    if len(before[p]) < enough:  # no more are needed
                        before[p].add(ahead)
        (seen if bad else plain).update(own)
    telling = {p for p, s in before.items() if len(s) >= enough and plain[p] / good_docs <= rate * seen[p] / bad_docs}
    return words, [np.fromiter((bad and any(p in telling for p in parts(w)) for w in ws), bool, len(ws)) for ws, bad in zip(words, toxic, strict=True)]


def fit_field(words: list[list[str]], labels: list[np.ndarray], steps: int = 32, passes: int = 6, seed: int = 5, plain_per_odd: int = 2, plain_least: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights of T against O, and transition scores, from stretches of ``steps`` words.

    All stretches with toxic tokens are learned from; of those without, ``plain_per_odd`` times as many and ``plain_least`` more, chosen at random.
    """
    stretches = [(ws[i : i + steps], ys[i : i + steps]) for ws, ys in zip(words, labels, strict=True) for i in range(0, len(ws), steps)]
    rng = np.random.default_rng(seed)
    odd, even = [w for w in stretches if w[1].any()], [w for w in stretches if not w[1].any()]
    picked = odd + [even[i] for i in rng.permutation(len(even))[: plain_per_odd * len(odd) + plain_least]]
    # each stretch as numbers of words; a word's features, filled up with one that always weighs 0
    number: dict[str, int] = {}
    token, gold, real = np.zeros((len(picked), steps), np.int64), np.zeros((len(picked), steps)), np.zeros((len(picked), steps), bool)
    for j, (ws, ys) in enumerate(picked):
        token[j, : len(ws)] = [number.setdefault(w, len(number)) for w in ws]
        gold[j, : len(ys)], real[j, : len(ws)] = ys, True
    features = np.full((max(1, len(number)), 8), SIZE)
    for w, i in number.items():
        ids = feature_ids(w)
        features[i, : len(ids)] = ids
    weights, trans = np.zeros(SIZE + 1), np.array([[1.0, -1.0], [0.0, 0.0]])
    grown, grown_t = np.full(SIZE + 1, 1e-6), np.full((2, 2), 1e-6)
    for _ in range(passes if odd else 0):
        order = rng.permutation(len(picked))
        for at in range(0, len(order), 256):
            some = order[at : at + 256]
            here, g = real[some].T, gold[some].T
            own, which = np.unique(token[some].T, return_inverse=True)
            score = weights[features[own]].sum(axis=1)[which.reshape(here.shape)]
            odds, step = np.where(here, np.exp(np.clip(score, -20, 20)), 1.0), np.exp(trans)
            p, joint = marginals(odds, step, here), pair_marginals(odds, step, here)
            error = np.bincount(which.reshape(-1), np.where(here, p - g, 0.0).reshape(-1), len(own))
            slope = np.bincount(features[own].reshape(-1), np.repeat(error, features.shape[1]), SIZE + 1) + 1e-3 * weights
            slope[SIZE] = 0.0
            grown += slope * slope
            weights -= 0.5 * slope / np.sqrt(grown)
            pair = here[1:] & here[:-1]
            for a in (0, 1):
                for b in (0, 1):
                    want = (g[:-1] == a) & (g[1:] == b)
                    d = float(((joint[a, b] - want) * pair).sum()) + 1e-2 * trans[a, b]
                    grown_t[a, b] += d * d
                    trans[a, b] -= 0.1 * d / np.sqrt(grown_t[a, b])
    return weights[:SIZE], trans


class Field:
    """Fitted weights: features, transitions, and the two numbers of the document score."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray, slope: float = 0.0, bias: float = -30.0):
        self.weights, self.trans, self.slope, self.bias = weights, trans, slope, bias


class Odds(dict):
    """word -> exp(its score for T); forgets everything when it grows large."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights.tolist()

    def __missing__(self, word: str) -> float:
        if len(self) > 300_000:
            self.clear()
        self[word] = x = math.exp(max(-20.0, min(20.0, sum(map(self.weights.__getitem__, feature_ids(word))))))
        return x


def token_marginals(texts: list[str], field: Field, odds: Odds) -> list[np.ndarray]:
    """P(T) of each word of each text, all texts in one run of forward-backward."""
    words = [WORD.findall(t) for t in texts]
    sizes = [len(w) for w in words]
    flat = np.fromiter((odds[w] for ws in words for w in ws), np.float64, sum(sizes))
    return np.split(chain_marginals(flat, np.exp(field.trans), np.array(sizes, np.int64)), np.cumsum(sizes)[:-1]) if texts else []


def evidence(p: np.ndarray) -> float:
    """Log of the number of surely toxic tokens; the power keeps many faint doubts of a long text from adding up."""
    return float(np.log(1e-2 + (p**8).sum()))


def fit(texts: list[str], toxic: np.ndarray, share: float) -> Field:
    """share: of toxic documents among all labelled ones, to undo the balanced sample."""
    if not toxic.any() or toxic.all():
        return Field(np.zeros(SIZE), np.zeros((2, 2)))
    words, labels = token_labels(texts, toxic)
    field = Field(*fit_field(words, labels))
    odds = Odds(field.weights)
    x = np.array([evidence(p) for i in range(0, len(texts), 256) for p in token_marginals(texts[i : i + 256], field, odds)])
    y = toxic.astype(float)
    weight = np.where(toxic, share / y.mean(), (1 - share) / (1 - y.mean()))
    a, b = 1.0, 0.0
    for _ in range(60):  # Newton steps for two numbers, lightly held
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r, h = weight * (p - y), weight * p * (1 - p)
        g = np.array([(r * x).sum() + 0.1 * a, r.sum() + 0.01 * b])
        hess = np.array([[(h * x * x).sum() + 0.1, (h * x).sum()], [(h * x).sum(), h.sum() + 0.01]])
        move = np.linalg.solve(hess, g)
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -1, 1)
    field.slope, field.bias = float(a), float(b)
    return field


def train(docs: DataFrame, labels: DataFrame, keep: Column, max_rows: int = 5000) -> Field:
    """Fits on about max_rows labelled documents, in one task; the field (1 MB) comes back to the driver."""
    known = labels.where(keep & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    bad, good = counts.get(1, 0), counts.get(0, 0)
    order = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 40))
    limit = lambda n: int((1 << 40) * min(1.0, 0.48 * max_rows / max(1, n)))
    chosen = known.withColumn("order", order).where(F.col("order") < F.when(F.col("toxic") == 1, F.lit(limit(bad))).otherwise(F.lit(limit(good))))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # bounded by max_rows
    rows = rows.groupBy("doc_id", "order", "toxic").agg(F.min("text").alias("text"))  # one row an id, however often it occurs
    share = bad / max(1, bad + good)

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "doc_id", "text"])
        field = fit(pdf["text"].tolist(), pdf["toxic"].to_numpy() == 1, share)
        return pd.DataFrame([{"weights": field.weights.astype(np.float32).tobytes(), "trans": field.trans.tobytes(), "slope": field.slope, "bias": field.bias}])

    made = rows.withColumn("task", F.lit(0)).groupBy("task").applyInPandas(task, "weights binary, trans binary, slope double, bias double").collect()
    if not made:
        return Field(np.zeros(SIZE), np.zeros((2, 2)))
    r = made[0]
    return Field(np.frombuffer(r.weights, np.float32).astype(np.float64), np.frombuffer(r.trans).reshape(2, 2).copy(), r.slope, r.bias)


def score(field: Field, text_col: str = "text", spans: bool = True) -> Column:
    """struct<score double, spans array<struct<start, end>>> of a text; offsets are code points, end exclusive."""

    @F.pandas_udf("score double, spans array<struct<start:int,end:int>>")
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        odds = Odds(field.weights)
        for texts in batches:
            scores, found = np.empty(len(texts)), [[] for _ in range(len(texts))]
            for at in range(0, len(texts), 256):
                some = texts.iloc[at : at + 256].tolist()
                for i, p in enumerate(token_marginals(some, field, odds)):
                    z = field.slope * evidence(p) + field.bias
                    scores[at + i] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                    if spans and len(p) and p.max() >= 0.5:
                        found[at + i] = [{"start": m.start(), "end": m.end()} for m, q in zip(WORD.finditer(some[i]), p, strict=True) if q >= 0.5]
            yield pd.DataFrame({"score": scores, "spans": found})

    return tag(F.coalesce(F.col(text_col), F.lit("")))
