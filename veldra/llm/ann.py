"""Nearest neighbours by cosine over randomly rotated one-bit codes.

Each vector is scaled by a power of two, normalised, rotated into ``bits`` dimensions by one random orthonormal matrix
(fixed seed) and kept as its signs, packed in words, with a correction scalar: the inner product of the rotated vector and
its sign vector. A rotated query is rounded to ``PLANES`` bits a component, and its inner product with a sign vector is a
weighted sum of bit counts of packed words. From this the inner product with the query is estimated without bias; it lies
within ``sureness`` deviations, and what the rounding can add, of the estimate. In a block, the
vectors with the best estimates are measured exactly; then each further one whose upper bound reaches the k-th exact
measure is, too. Estimates only choose what is measured: the scores returned are cosines of the original vectors in double
precision, ties go to the smaller id.

The index holds every vector, cut by hash into blocks of about ``block`` rows; the queries, packed in blocks of
``query_block``, go to every block of the index in groups of at most ``GROUP`` packs. A task holds one index block and
one group, whatever the number of rows or queries. The hash takes in
the row's number, so rows of one id, or of one vector, spread over all blocks and packs.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, neither as query
nor as candidate; vectors of different lengths aren't compared; a query never finds rows of its own id; repeated ids
count as rows each, and each query row has its own k answers; with fewer than k candidates all are returned; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GROUP, PLANES = 16, 6


def rotation(dim: int, bits: int, seed: int) -> np.ndarray:
    """dim x bits, its rows orthonormal."""
    q, _ = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((bits, dim)))
    return np.ascontiguousarray(q.T)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times powers of two, their largest component within [0.5, 1): no square over- or underflows, cosines stay."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def encode(vectors: np.ndarray, bits: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs and correction scalars of float64 rows."""
    vectors = scaled(vectors)
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    turned = unit @ rotation(vectors.shape[1], bits, seed)
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(bits)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.transform(vector_col, lambda x: x.cast("double"))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull() & sound).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("dim"))


def nearest(ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, corr: np.ndarray, qids: np.ndarray, queries: np.ndarray, k: int, sureness: float, seed: int) -> list[tuple[int, int, int, float]]:
    """(query's place, its id, id found, score) of the k nearest rows of a block."""
    bits = codes.shape[1] * 8
    words = np.ascontiguousarray(np.ascontiguousarray(codes).view(np.uint64).T)  # word by word, each over all rows
    ones = np.bitwise_count(words).sum(axis=0, dtype=np.int64)
    vectors, queries = scaled(vectors), scaled(queries)
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    qnorms = np.sqrt((queries * queries).sum(axis=1))
    turned = (queries / qnorms[:, None]) @ rotation(queries.shape[1], bits, seed)
    margin = sureness * np.sqrt(np.maximum(0.0, 1 - corr**2)) / corr / np.sqrt(bits - 1) + 1e-5
    low, step = turned.min(axis=1), np.maximum(np.ptp(turned, axis=1), 1e-12) / (2**PLANES - 1)
    levels = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    rounded = low[:, None] + levels * step[:, None]
    off = np.sqrt(((turned - rounded) ** 2).sum(axis=1))  # times the length of a sign vector: what rounding can add
    planes = [np.packbits(levels >> p & 1, axis=1).view(np.uint64) for p in range(PLANES)]
    found = []
    for i, qid in enumerate(qids):
        # <signs, q> = 2 <ones, q> - sum(q), and <ones, q> comes from bit counts, one plane of q's levels after another
        counted = sum((np.bitwise_count(words & planes[p][i][:, None]).sum(axis=0, dtype=np.uint16).astype(np.int64) << p for p in range(PLANES)), np.zeros(len(ids), np.int64))
        estimate = (2 * (low[i] * ones + step[i] * counted) - rounded[i].sum()) / (np.sqrt(bits) * corr)
        upper = estimate + margin + off[i] / corr
        upper[ids == qid] = -np.inf
        first = np.argpartition(-upper, min(4 * k, len(ids) - 1))[: 4 * k]
        first = first[upper[first] > -np.inf]

        def exact(rows: np.ndarray, q: np.ndarray = queries[i], n: float = qnorms[i]) -> np.ndarray:
            return (vectors[rows] * q).sum(axis=1) / (norms[rows] * n)

        scores = exact(first)
        if len(scores) >= k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            upper[first] = -np.inf
            more = np.flatnonzero(upper >= least)
            first, scores = np.concatenate([first, more]), np.concatenate([scores, exact(more)])
        best = np.lexsort((ids[first], -scores))[:k]
        found += [(i, int(qid), int(ids[first[j]]), float(scores[j])) for j in best]
    return found


def search_block(*given: np.ndarray | int | float) -> list[tuple[int, int, float]]:
    """``nearest`` without the queries' places."""
    return [row[1:] for row in nearest(*given)]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = 256, block: int = 4096, query_block: int = 256, sureness: float = 4.5, seed: int = 11) -> DataFrame:
    """(query_id long, rank int, vec_id long, score double): the k nearest of each query among the other rows."""
    rows, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    n, m = vectors.count(), asked.count()
    blocks, packs = max(1, -(-n // block)), max(1, -(-m // query_block))
    groups = -(-packs // GROUP)

    def index(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for dim, part in pdf.groupby("dim"):
                mat = np.array(part["v"].tolist(), dtype=np.float64)
                codes, corr = encode(mat, -(-max(bits, int(dim)) // 64) * 64, seed)
                yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy(), "dim": int(dim), "raw": [x.tobytes() for x in mat], "code": [x.tobytes() for x in codes], "corr": corr})

    coded = rows.mapInPandas(index, "vec_id long, dim int, raw binary, code binary, corr double")
    spread = lambda n: F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n)).cast("int")
    blocked = coded.withColumn("block", spread(blocks)).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        mat, ids = np.array(pdf["v"].tolist(), dtype=np.float64), pdf["vec_id"].to_numpy(np.int64)
        order = np.lexsort((*mat.T, ids))  # one order, however the rows arrive: a query is known by its pack and its place there
        number = int(pdf["pack"].iloc[0])
        return pd.DataFrame({"dim": [int(pdf["dim"].iloc[0])], "pack": [number], "grp": [number % groups], "qids": [ids[order].tobytes()], "qraw": [mat[order].tobytes()]})

    packed = asked.withColumn("pack", spread(packs)).groupBy("dim", "pack").applyInPandas(pack, "dim int, pack int, grp int, qids binary, qraw binary")
    sent = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, int, int, float]] = []
        if len(left) and len(right):
            dim = int(left["dim"].iloc[0])
            ids, corr = left["vec_id"].to_numpy(np.int64), left["corr"].to_numpy()
            raw = np.frombuffer(b"".join(left["raw"]), np.float64).reshape(-1, dim)
            codes = np.frombuffer(b"".join(left["code"]), np.uint8).reshape(len(ids), -1)
            for number, qids, qraw in zip(right["pack"], right["qids"], right["qraw"], strict=True):
                met = nearest(ids, raw, codes, corr, np.frombuffer(qids, np.int64), np.frombuffer(qraw, np.float64).reshape(-1, dim), k, sureness, seed)
                out += [(dim, number, *row) for row in met]
        return pd.DataFrame(out, columns=["dim", "pack", "place", "query_id", "vec_id", "score"])

    near = blocked.groupBy("block", "grp", "dim").cogroup(sent.groupBy("block", "grp", "dim")).applyInPandas(meet, "dim int, pack int, place int, query_id long, vec_id long, score double")
    order = Window.partitionBy("dim", "pack", "place").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
