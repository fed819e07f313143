r"""Ranked lexical search over document shards of integer impacts.

1. Totals: one scan counts the documents that hold a term and all their terms.
2. Index: each task turns its own rows into shards of at most ``SHARD_DOCS`` documents and about ``SHARD_TERMS`` terms; texts are
   never shuffled. A shard is one row: its vocabulary, the length of each posting list, and the lists one after another
   (compressed sparse rows) as document ordinals and precomputed integer impacts. Ordinals follow the ids, so the first of
   equals is the one with the smallest id.
3. Weights: document frequencies are summed over the shards' vocabularies for the queries' terms only.
4. Search: queries travel in packs of about ``PACK`` queries and ``PACK_TERMS`` terms, one row a pack, ``PACKS`` at once (a bound
   for what is broadcast); further packs are further passes, each stored before the next begins. A task holds one shard and one
   pack: term at a time, weight times impact is added to a dense accumulator; an argpartition finds the k-th score,
   all above it are kept, and of those equal to it the first.
5. Merge: the k best of each shard meet in two ranks, within hashed parts of a query's candidates and then of the query.

A term is a maximal run of ASCII letters and digits and of anything beyond ASCII; only A-Z are lower-cased, so UTF-8 bytes are worked on.

Defined cases: null and empty texts have no terms; a document without terms counts nowhere; repeated rows are documents
each, repeated queries are ranked each; among equal scores a null document id comes last; queries without a known term
and empty tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldra.llm.common import stored

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHARD_DOCS, SHARD_TERMS, PACK, PACK_TERMS, PACKS, MERGE_PARTS = 4096, 2_000_000, 1000, 200_000, 4, 32

#: byte -> byte: separators become spaces, A-Z a-z
BYTES = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
INDEX = "terms string, sizes array<int>, ids binary, nameless int, ordinals binary, impacts binary"


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def totals(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """The number of documents with a term, and of all their terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(t.as_py().translate(BYTES).split()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(bool, sizes))], pa.int64()), pa.array([sum(sizes)], pa.int64())], ["n", "length"])

    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("binary").alias("text"))
    return tuple(texts.mapInArrow(count, "n long, length long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first())


class Vocabulary(dict):
    """term -> number, in order of arrival."""

    def __missing__(self, term: bytes) -> int:
        self[term] = number = len(self)
        return number


def shard_row(ids: list[int | None], terms: list[np.ndarray], vocabulary: Vocabulary, n: int, length: int) -> dict:
    """One shard as a row: documents by id (null last), lists by term, impacts from the term counts and the documents' lengths."""
    place = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    sizes = np.array([len(terms[i]) for i in place], np.int64)
    m = 100 - 50 + (50 * sizes * n) // length
    key = np.concatenate([terms[i] for i in place]) * len(ids) + np.repeat(np.arange(len(ids)), sizes)
    key, tf = np.unique(key, return_counts=True)
    term, at = np.divmod(key, len(ids))
    impacts = (1_000_000_000 * tf) // (1000 * tf + 20 * m[at])
    known = [i for i in place if ids[i] is not None]
    return {
        "terms": b" ".join(vocabulary).decode("utf-8", "replace"),
        "sizes": np.bincount(term, minlength=len(vocabulary)).astype(np.int32),
        "ids": np.array([ids[i] for i in known], np.int64).tobytes(),
        "nameless": len(ids) - len(known),
        "ordinals": at.astype(np.uint16).tobytes(),
        "impacts": impacts.astype(np.int32).tobytes(),
    }


def index(docs: DataFrame, n: int, length: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards of the rows of each partition (INDEX)."""
    fields = [("terms", pa.string()), ("sizes", pa.list_(pa.int32())), ("ids", pa.binary()), ("nameless", pa.int32()), ("ordinals", pa.binary()), ("impacts", pa.binary())]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        terms: list[np.ndarray] = []
        vocabulary, held = Vocabulary(), 0

        def row() -> pa.RecordBatch:
            made = shard_row(ids, terms, vocabulary, n, length)
            return pa.RecordBatch.from_arrays([pa.array([made[name]], kind) for name, kind in fields], [name for name, _ in fields])

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                found = text.as_py().translate(BYTES).split()
                if not found:
                    continue
                ids.append(doc.as_py())
                terms.append(np.fromiter(map(vocabulary.__getitem__, found), np.int64, len(found)))
                held += len(found)
                if len(ids) >= SHARD_DOCS or held >= SHARD_TERMS:
                    yield row()
                    ids, terms, vocabulary, held = [], [], Vocabulary(), 0
        if ids:
            yield row()

    given = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return given.mapInArrow(build, INDEX)


def weighted(queries: DataFrame, shards: DataFrame, n: int) -> DataFrame:
    """(q, term, w) of each query's distinct terms that the documents hold."""
    asked = queries.select("q", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term"))
    lists = shards.select(F.explode(F.arrays_zip(F.split("terms", " ").alias("term"), F.col("sizes").alias("size"))).alias("x")).select("x.*")
    df = lists.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("size").cast("long").alias("df"))
    w = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1))).cast("long")
    return asked.join(df, "term").select("q", "term", w.alias("w")).where("w > 0")


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest positive scores; of equal ones at the border the first."""
    hits = np.flatnonzero(scores > 0)
    if len(hits) > k:
        own = scores[hits]
        least = own[np.argpartition(own, len(own) - k)[len(own) - k]]
        above = hits[own > least]
        hits = np.concatenate([above, hits[own == least][: k - len(above)]])
    return hits


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id long, rank int, doc_id long, score long): the k best documents of each item."""
    spark = docs.sparkSession
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    n, length = totals(docs, text_col)
    if not length:
        return empty
    shards = stored(index(docs, n, length, id_col, text_col), "shards")
    named = items.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    queries = stored(named.withColumn("q", F.monotonically_increasing_id()), "items")
    terms = stored(weighted(queries, shards, n), "weights")
    count = terms.agg(F.countDistinct("q"), F.count("*")).first()
    packs = max(1, -(-count[0] // PACK), -(-count[1] // PACK_TERMS))
    each = terms.groupBy("q").agg(F.collect_list("term").alias("terms"), F.collect_list("w").alias("weights"))
    packed = each.groupBy(F.pmod(F.xxhash64("q"), F.lit(packs)).alias("pack")).agg(F.collect_list(F.struct("q", "terms", "weights")).alias("asked"))
    names = ["q", "doc_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                place = {t: j for j, t in enumerate(row["terms"].as_py().split(" "))}
                starts = np.concatenate([[0], np.cumsum(row["sizes"].values.to_numpy(), dtype=np.int64)])
                ids = np.frombuffer(row["ids"].as_py(), np.int64)
                ordinals, impacts = np.frombuffer(row["ordinals"].as_py(), np.uint16), np.frombuffer(row["impacts"].as_py(), np.int32).astype(np.int64)
                scores = np.zeros(len(ids) + row["nameless"].as_py(), np.int64)
                qs, docs_found, found = [], [], []
                for query in row["asked"].as_py():
                    scores[:] = 0
                    for t, w in zip(query["terms"], query["weights"], strict=True):
                        j = place.get(t)
                        if j is not None:
                            own = slice(starts[j], starts[j + 1])
                            scores[ordinals[own]] += w * impacts[own]
                    hits = best(scores, k)
                    qs += [query["q"]] * len(hits)
                    docs_found += [int(ids[h]) if h < len(ids) else None for h in hits]
                    found += scores[hits].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(qs, pa.int64()), pa.array(docs_found, pa.int64()), pa.array(found, pa.int64())], names)

    def one_pass(first: int) -> DataFrame:
        here = list(range(first, min(packs, first + PACKS)))
        sent = F.broadcast(packed.where(F.col("pack").isin(here)))
        met = shards.withColumn("pack", F.explode(F.array(*[F.lit(p).cast("long") for p in here]))).join(sent, "pack").drop("pack")
        return met.mapInArrow(run, "q long, doc_id long, score long")

    passes = range(0, packs, PACKS)
    near = one_pass(0) if len(passes) == 1 else reduce(DataFrame.unionAll, [stored(one_pass(p), "found") for p in passes])
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = near.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_PARTS)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("q", "part").orderBy(*order))).where(F.col("rank") <= k)
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.join(queries.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")
