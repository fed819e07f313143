"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Tokens are words and runs of punctuation. Features are hashed into ``1 << BITS`` places: word unigrams and bigrams, the
same n-grams over token shapes (capitals, digits, punctuation as written), and marks where a token repeats the one or the second before.
A text's feature values are counts over its number of tokens; a score is the sparse dot product with the weights.

Training takes at most about ``max_rows`` labelled rows (a documented bound; all of them if there are fewer), chosen by hash
of the id, in ``SHARDS`` shards; each shard is one task that reads its rows in hash order, and the shards' weights are
averaged. At most ``1 << BITS`` weights reach the driver and are sent out again (2 MB).

Defined cases: null text is empty; an empty text scores by the bias alone; rows with a null label, or a null id, aren't
learned from; of several rows of an id the least text is learned from; with no labelled rows every score is 0.5; of several labels for an id the largest counts; repeated rows are
scored each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, SHARDS, SCALE = 18, 8, 10.0
SIZE = 1 << BITS
TOKEN = re.compile(r"\w+|[^\w\s]+")


class Codes(dict):
    """token -> word hash and shape hash in one integer; forgets everything when it grows large."""

    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        c = token[0]
        if not (c.isalnum() or c == "_"):
            shape = token[:8]
        elif token.isdigit():
            shape = "9"
        elif token.isupper() and len(token) > 1:
            shape = "AA"
        else:
            shape = ("A" if c.isupper() else "a") + ("9" if any(x.isdigit() for x in token) else "")
        word, form = zlib.crc32(token.lower().encode("utf-8", "replace")) % SIZE, zlib.crc32(b"\0" + shape.encode("utf-8", "replace")) % SIZE
        self[token] = code = word << 32 | form
        return code


def features(text: str, codes: Codes) -> np.ndarray:
    """Indices of all features of a text, with repeats; SIZE and SIZE + 1 mark tokens equal to the one and the second before."""
    tokens = TOKEN.findall(text)
    packed = np.fromiter(map(codes.__getitem__, tokens), np.int64, len(tokens))
    word, form = packed >> 32, packed & 0xFFFFFFFF
    if len(word) < 2:
        return np.concatenate([word, form])
    pairs = lambda x, salt: (x[:-1] * 7919 + x[1:] * 104729 + salt) % SIZE
    near, far = int((word[1:] == word[:-1]).sum()), int((word[2:] == word[:-2]).sum())
    return np.concatenate([word, form, pairs(word, 1), pairs(form, 2), np.full(near, SIZE), np.full(far, SIZE + 1)])


def vector(text: str, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    places = features(text, codes)
    index, count = np.unique(places, return_counts=True)
    return index, count * (SCALE / max(1, len(places)))


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], passes: int = 2, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.002, l2: float = 0.001) -> np.ndarray:
    """Weights (the last three places are the repeat marks' and the bias's)."""
    z, n = np.zeros(SIZE + 3), np.zeros(SIZE + 3)

    def weights(i: np.ndarray) -> np.ndarray:
        far = np.abs(z[i]) > l1
        return np.where(far, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2), 0.0)

    for _ in range(passes):
        for index, value, label in rows:
            i, x = np.append(index, SIZE + 2), np.append(value, 1.0)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - label) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange(SIZE + 3))


def labelled(labels: DataFrame, label_col: str, keep: Column, max_rows: int) -> DataFrame:
    """(doc_id, label, order): about max_rows rows at most, chosen by hash of the id."""
    known = labels.where(keep & F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    total = known.count()
    order = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 40))
    return known.withColumn("order", order).where(F.col("order") < int((1 << 40) * min(1.0, 0.97 * max_rows / max(1, total)) if total > max_rows else 1 << 40))


def train(docs: DataFrame, labels: DataFrame, keep: Column, label_col: str = "quality", max_rows: int = 16_000, passes: int = 2) -> np.ndarray:
    """Averaged weights; keep: which label rows may be learned from."""
    chosen = labelled(labels, label_col, keep, max_rows)  # max_rows rows of 20 bytes: a proven bound for the broadcast
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "order", "label").agg(F.min("text").alias("text"))  # one row an id, however often it occurs

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        codes = Codes()
        pdf = pdf.sort_values(["order", "doc_id", "text"])
        w = train_ftrl([(*vector(t, codes), y) for t, y in zip(pdf["text"], pdf["label"], strict=True)], passes)
        at = np.flatnonzero(w)
        return pd.DataFrame({"place": at, "weight": w[at] * len(pdf), "n": len(pdf)})

    made = rows.withColumn("shard", F.pmod("order", F.lit(SHARDS))).groupBy("shard").applyInPandas(shard, "place long, weight double, n long")
    mean = made.groupBy("place").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n")).toPandas()
    weights = np.zeros(SIZE + 3)
    if len(mean):
        weights[mean["place"].to_numpy()] = mean["weight"].to_numpy() / mean["n"].max()
    return weights.astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> Column:
    """Column with the probability of label 1."""

    @F.pandas_udf("double")
    def dot(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codes, w = Codes(), weights.astype(np.float64)
        for texts in batches:
            out = np.empty(len(texts))
            for i, t in enumerate(texts):
                places = features(t or "", codes)
                out[i] = w[-1] + (w[places].sum() * SCALE / len(places) if len(places) else 0.0)
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    return dot(F.coalesce(F.col(text_col), F.lit("")))
