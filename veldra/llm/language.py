"""Language identification by a small convolutional network over bytes.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes, each beginning ``STEP`` after the one before, so that no run of as many bytes as
the widest filter is lost at a border; the last window is padded with zero bytes. For each width of ``WIDTHS`` there are
``FILTERS`` filters, each with one weight for every byte at every offset. Their largest positive response in the window is
its feature, and softmax over the features gives the languages' probabilities. A text's log-probabilities are the means over its
windows, weighted by their bytes; whole texts are read. For scoring, weights of two neighbouring offsets are
added up beforehand for all pairs of bytes, which halves the look-ups.

Training takes at most about ``max_rows`` labelled texts (a documented bound; all if there are fewer), the same share for
each language, chosen by hash of id and text, and of each text up to ``PER_TEXT`` windows dealt over its whole length,
some of them cut short, so that short texts are learned, too. Adam in numpy, in one task of bounded size; a window's gradient
flows to the bytes of the largest response only.

Defined cases: a null text and one without any letter is ``und`` with score 0, as is every text if no labelled text is
given; rows with a null language or id, or without letters, aren't learned from; repeated rows are learned from and predicted each;
of equally likely languages the first by name counts; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, WIDTHS, FILTERS, PER_TEXT, UNKNOWN = 128, (2, 3, 4), 12, 8, "und"
STEP = WINDOW - max(WIDTHS) + 1
BATCH, ROUNDS, RATE, SEED = 128, 4, 0.01, 13
CACHED = 64  # windows at once in scoring: what they need stays in a core's cache


class Net(NamedTuple):
    """Languages by name; filters (width, 256, FILTERS) and their biases by width; softmax weights and biases."""

    langs: list[str]
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n, WINDOW) bytes, and how many of a window's bytes are the text's and not yet in the window before."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(1, -(-(len(data) - (WINDOW - STEP)) // STEP))
    padded = np.zeros((n - 1) * STEP + WINDOW, np.uint8)
    padded[: len(data)] = data
    own = np.minimum(STEP, len(data) - np.arange(n) * STEP)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP], np.maximum(own, 1)


def responses(net: Net, x: np.ndarray) -> Iterator[np.ndarray]:
    """For each width the responses (n, places, FILTERS) before pooling."""
    for table, bias in zip(net.filters, net.biases, strict=True):
        places = WINDOW - len(table) + 1
        yield sum((table[o][x[:, o : o + places]] for o in range(len(table))), bias)


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def fit(texts: list[str], labels: list[str]) -> Net:
    """A net from labelled texts, in the order given."""
    rng = np.random.default_rng(SEED)
    langs = sorted(set(labels))
    rows, target = [], []
    for text, label in zip(texts, labels, strict=True):
        cut, _ = windows(text)
        chosen = cut[np.sort(rng.permutation(len(cut))[:PER_TEXT])].copy()
        for x in chosen[rng.random(len(chosen)) < 0.25]:
            x[int(rng.integers(12, WINDOW)) :] = 0
        rows.append(chosen)
        target += [langs.index(label)] * len(chosen)
    x, y = np.concatenate(rows), np.array(target)
    net = Net(
        langs,
        [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.2, (len(langs), FILTERS * len(WIDTHS))).astype(np.float32),
        np.zeros(len(langs), np.float32),
    )
    weights = [*net.filters, *net.biases, net.out, net.out_bias]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(ROUNDS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows_here, step = order[at : at + BATCH], step + 1
            for w, g, m, v in zip(weights, gradients(net, x[rows_here], y[rows_here]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def gradients(net: Net, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy, in the order filters, biases, out, out_bias."""
    pooled, where = [], []
    for r in responses(net, x):
        at = r.argmax(axis=1)
        where.append(at)
        pooled.append(np.take_along_axis(r, at[:, None, :], axis=1)[:, 0, :])
    h = np.concatenate(pooled, axis=1)
    wrong = np.exp(log_softmax(np.maximum(h, 0) @ net.out.T + net.out_bias))
    wrong[np.arange(len(y)), y] -= 1
    wrong /= len(y)
    back = np.where(h > 0, wrong @ net.out, 0)
    filters, biases = [], []
    for k, (table, at) in enumerate(zip(net.filters, where, strict=True)):
        own = back[:, k * FILTERS : (k + 1) * FILTERS]
        grad = np.empty_like(table)
        for o in range(len(table)):
            seen = np.take_along_axis(x, at + o, axis=1).astype(np.int64) * FILTERS + np.arange(FILTERS)
            grad[o] = np.bincount(seen.ravel(), own.ravel(), 256 * FILTERS).reshape(256, FILTERS)
        filters.append(grad)
        biases.append(own.sum(axis=0))
    return [*filters, *biases, wrong.T @ np.maximum(h, 0), wrong.sum(axis=0)]


class Paired:
    """A net for scoring, its filters as tables over pairs of bytes."""

    def __init__(self, net: Net):
        self.net, self.tables = net, []
        for table, bias in zip(net.filters, net.biases, strict=True):
            parts = []
            for o in range(0, len(table), 2):
                pair = table[o][:, None] + (table[o + 1][None] if o + 1 < len(table) else np.zeros((1, 256, FILTERS), np.float32))
                parts.append((o, np.ascontiguousarray(pair.reshape(-1, FILTERS))))
            parts[0][1][:] += bias
            self.tables.append((len(table), parts))

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """(n, languages) of windows (n, WINDOW)."""
        out = []
        for i in range(0, len(x), CACHED):
            own = np.zeros((min(CACHED, len(x) - i), WINDOW + 1), np.int64)
            own[:, :WINDOW] = x[i : i + CACHED]
            pairs = own[:, :-1] * 256 + own[:, 1:]
            h = []
            for width, parts in self.tables:
                places = WINDOW - width + 1
                r = parts[0][1].take(pairs[:, :places], axis=0)
                for o, table in parts[1:]:
                    r += table.take(pairs[:, o : o + places], axis=0)
                h.append(np.maximum(r.max(axis=1), 0))
            out.append(log_softmax(np.concatenate(h, axis=1) @ self.net.out.T + self.net.out_bias))
        return np.concatenate(out)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text, and its probability."""
        cut = [windows(t) for t in texts]
        begin = np.cumsum([0] + [len(x) for x, _ in cut])[:-1]
        weight = np.concatenate([w for _, w in cut]).astype(np.float64)
        mean = np.add.reduceat(self.log_probabilities(np.concatenate([x for x, _ in cut])) * weight[:, None], begin, axis=0) / np.add.reduceat(weight, begin)[:, None]
        p = np.exp(log_softmax(mean))
        top = p.argmax(axis=1)
        return [self.net.langs[j] for j in top], p[np.arange(len(p)), top]


def lettered(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, keep: Column, text_col: str = "text", lang_col: str = "lang", max_rows: int = 1600) -> Net | None:
    """A net from at most about max_rows rows that ``keep`` allows; None if there are none."""
    text, lang = F.col(text_col), F.col(lang_col)
    known = docs.where(F.coalesce(keep, F.lit(False)) & lang.isNotNull() & lettered(text))
    counts = {r[0]: r[1] for r in known.groupBy(lang.alias("lang")).count().collect()}  # a row a language
    if not counts:
        return None
    quota = max_rows / len(counts)
    share = F.lit(0)
    for name, n in counts.items():
        share = F.when(lang == name, int((1 << 40) * min(1.0, quota / n))).otherwise(share)
    order = F.pmod(F.xxhash64(F.lit("lang"), "doc_id", text), F.lit(1 << 40))
    chosen = known.where(order < share).select(order.alias("order"), text.alias("text"), lang.alias("lang"))

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "text", "lang"])
        net = fit(pdf["text"].tolist(), pdf["lang"].tolist())
        arrays = [*net.filters, *net.biases, net.out, net.out_bias]
        return pd.DataFrame({"place": range(len(arrays)), "data": [np.ascontiguousarray(a, np.float32).tobytes() for a in arrays], "langs": [net.langs] * len(arrays)})

    made = chosen.groupBy(F.lit(0).alias("one")).applyInPandas(fitted, "place int, data binary, langs array<string>").orderBy("place").collect()
    if not made:
        return None
    langs, a = list(made[0].langs), [np.frombuffer(r.data, np.float32) for r in made]
    n = len(WIDTHS)
    return Net(langs, [a[i].reshape(w, 256, FILTERS) for i, w in enumerate(WIDTHS)], a[n : 2 * n], a[2 * n].reshape(len(langs), -1), a[2 * n + 1])


def identify(net: Net | None, text: Column) -> Column:
    """struct(lang, score) of each text."""
    if net is None:
        return F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))

    @F.pandas_udf("lang string, score double")
    def likeliest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        paired = Paired(net)
        for texts in batches:
            lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            own = texts.to_numpy()
            some = [i for i, t in enumerate(own) if t is not None]
            for at in range(0, len(some), 256):
                here = some[at : at + 256]
                lang[here], score[here] = paired.predict([own[i] for i in here])
            yield pd.DataFrame({"lang": lang, "score": score})

    return likeliest(F.when(lettered(text), text))
