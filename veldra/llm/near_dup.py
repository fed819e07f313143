"""Near-duplicate classes by BagMinHash signatures, banding and exact verification of multiset overlap.

A text is the multiset of its runs of five words (lower case; letters, digits and characters beyond ASCII make words); a
shorter text is one run. Texts of equal content are represented by one document. For the representatives:

1. Signatures. Each run has a Poisson process over time and weight; weights (counts) are discretised at the integers and
   the weight axis is laid out as [0, 1), [1, 2), [2, 4), [4, 8), ... Each stretch is a hierarchy of halves: the first
   point of a stretch falls in one half, and the other half starts anew from there, so points at weights that a text
   doesn't have are never visited and all texts that share a stretch share its points. Each of ``M`` registers keeps the
   earliest of its points; two registers agree with a probability of exactly the weighted Jaccard similarity.
2. ``BANDS`` bands of ``ROWS`` registers. Texts of similarity 0.8 miss each other in all 25 bands with a probability of 5e-5.
   Besides, two bits of each register are kept as four words (``SKETCH``). The bits of two texts of similarity 0.8 agree
   less than ``might_be_alike`` asks for with a probability below 1e-6, and so pairs are left out before any text moves.
3. In each bucket every text is compared with the bucket's hub, the text that shares most buckets. The comparison is
   exact. Links are joined to components.
4. In buckets of three or more texts that still hold several components, all texts of different components are compared:
   by their bits, in blocks of ``BLOCK`` by ``BLOCK``, and what remains of a block exactly. So each two similar texts that
   share a bucket end in one class, though a group of thousands of copies is linked by one star and not by all pairs.
5. Components come from alternating star contractions; a class is named by its smallest doc_id.

Texts travel only for pairs that the bits leave; the rows that may be needed are found by a broadcast bitmap of fixed size.

Defined cases: null text is empty; texts without words are alike only if they are equal; rows with a null id get a null
class and are compared with none; rows of one id and different texts join that id's classes; repeated rows are returned
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldra.llm.common import marked, stored, without

WORDS, M, BANDS, ROWS, BLOCK = 5, 128, 25, 5, 1000
A_TASK = 500  # texts compared with one copy of a hub's text
SKETCH = [f"s{i}" for i in range(2 * M // 64)]  # the low bits of all registers, then their next bits
BATCH_BYTES = 1 << 21
U = np.uint64
IN_WORD = np.array([48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b == 95 or b > 127 for b in range(256)])
BASE, BASE_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U)
    out[0] = 1
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * U(pow(base, done, 1 << 64))
        done += more
    return out


class Shingler:
    """Word runs of many texts at once, from their bytes."""

    def __init__(self) -> None:
        self.up, self.down = powers(BASE, 1 << 16), powers(BASE_INVERSE, 1 << 16)

    def keys(self, buffer: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Sorted keys (text number << 48 | 48 bits of the run), with repeats; texts are buffer[offsets[i]:offsets[i + 1]]."""
        n = len(buffer)
        if n == 0:
            return np.empty(0, U)
        if n >= len(self.up):
            self.up, self.down = powers(BASE, 2 * n), powers(BASE_INVERSE, 2 * n)
        inside = IN_WORD[buffer]
        fresh = np.zeros(n + 1, bool)
        fresh[offsets] = True
        before = np.r_[False, inside[:-1]]
        begin = np.flatnonzero(inside & (~before | fresh[:n]))
        after = np.r_[inside[1:], False]
        end = np.flatnonzero(inside & (~after | fresh[1:])) + 1
        if not len(begin):
            return np.empty(0, U)
        total = np.concatenate([np.zeros(1, U), np.cumsum((buffer.astype(U) + U(1)) * self.up[:n], dtype=U)])
        word = mixed((total[end] - total[begin]) * self.down[begin])
        text = np.searchsorted(offsets, begin, side="right") - 1
        first = np.searchsorted(text, text)  # where the word's text begins
        last = np.searchsorted(text, text, side="right")
        at = np.arange(len(word))
        runs = np.zeros(len(word), U)
        for k in range(WORDS):
            i = at + k
            there = i < last
            runs[there] += mixed(word[i[there]] + U((k + 1) * BASE % (1 << 64)))
        good = (at + WORDS <= last) | (at == first)  # full runs, and the only run of a short text
        return np.sort(text[good].astype(U) << U(48) | mixed(runs[good]) >> U(16))


def batches(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text + 1, bytes, offsets) of stretches of about BATCH_BYTES."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.empty(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, min(int(np.searchsorted(offsets, offsets[a] + BATCH_BYTES, side="right")) - 1, a + 8192, len(texts)))
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def uniform(state: np.ndarray) -> np.ndarray:
    return ((state >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(keys: np.ndarray, texts: int) -> np.ndarray:
    """texts x M registers (arrival times; infinite for a text without runs)."""
    out = np.full((texts, M), np.inf)
    if not len(keys):
        return out
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    count = np.diff(np.r_[heads, len(keys)])
    text = (keys[heads] >> U(48)).astype(np.int64)
    run = mixed(keys[heads] << U(16))
    weight = np.bincount(text, count, texts)
    todo = np.unique(text)
    limit = np.zeros(texts)
    limit[todo] = M * (np.log(M) + 3) / weight[todo]
    while len(todo):
        chosen = np.isin(text, todo) if len(todo) < texts else slice(None)
        out[todo] = np.inf
        fill(out, text[chosen], run[chosen], count[chosen], limit)
        todo = todo[np.isinf(out[todo]).any(axis=1)]  # a few, whose registers aren't all full by then
        limit[todo] *= 2
    return out


def fill(out: np.ndarray, text: np.ndarray, run: np.ndarray, count: np.ndarray, limit: np.ndarray) -> None:
    """All points up to each text's limit go to their registers."""
    units: list[tuple[np.ndarray, ...]] = [start(text, run, np.zeros(len(run), np.int64), 1, limit)]
    low = 1
    while low < int(count.max(initial=0)):  # stretches [low, 2 low)
        has = count > low
        t, h, c = text[has], run[has], count[has]
        t, h, lo, x, c = *start(t, h, np.full(len(h), low), low, limit, c),
        width = low
        while width > 1 and len(t):
            half = width // 2
            coin = mixed(h + lo.astype(U) * U(0xA0761D6478BD642F) + U(width * 0xE7037ED1A0B428DB % (1 << 64)))
            right = (coin & U(1)).astype(bool)
            other = x - np.log(uniform(coin)) / half
            t, h, c = np.tile(t, 2), np.tile(h, 2), np.tile(c, 2)
            lo, x = np.r_[lo + np.where(right, half, 0), lo + np.where(right, 0, half)], np.r_[x, other]
            keep = (x <= limit[t]) & (lo < c)
            t, h, c, lo, x = t[keep], h[keep], c[keep], lo[keep], x[keep]
            width = half
        units.append((t, h, lo, x))
        low *= 2
    t, h, lo, x = (np.concatenate([u[i] for u in units]) for i in range(4))
    state = mixed(h + lo.astype(U) * U(BASE) + U(7))
    flat = out.reshape(-1)
    n = 0
    while len(t):
        np.minimum.at(flat, t * M + (mixed(state + U(1)) & U(M - 1)).astype(np.int64), x)
        n += 1
        state = mixed(state + U((2 * n + 1) * BASE % (1 << 64)))
        x = x - np.log(uniform(state))
        keep = x <= limit[t]
        t, state, x = t[keep], state[keep], x[keep]


def start(text: np.ndarray, run: np.ndarray, low: np.ndarray, rate: int, limit: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """First points of stretches, without those after the limit: (text, run, low, time, *more)."""
    x = uniform(mixed(run + low.astype(U) * U(0x8EBC6AF09C88C6E3) + U(3)))
    keep = x >= np.exp(-limit[text] * rate)
    return text[keep], run[keep], low[keep], -np.log(x[keep]) / rate, *(m[keep] for m in more)


def bands(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, with the band's number in it."""
    parts = np.ascontiguousarray(signature[:, : BANDS * ROWS]).view(U).reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=U) * U(BASE), parts.shape[:2]).copy()
    for k in range(ROWS):
        key = mixed(key ^ mixed(parts[:, :, k] + U(k)))
    return key.view(np.int64)


def sketches(signature: np.ndarray) -> np.ndarray:
    """Two bits of each register, as ``SKETCH`` words."""
    mixed_up = mixed(signature.view(U) + U(11))
    bits = [np.packbits((mixed_up >> U(k) & U(1)).astype(bool), axis=1) for k in (0, 1)]
    return np.ascontiguousarray(np.concatenate(bits, axis=1)).view(np.int64)


def least_agreement(least: float) -> int:
    """The fewest equal registers, by their two bits, of texts whose similarity is ``least``: five deviations below the mean."""
    p = least + (1 - least) / 4
    return max(0, int(np.floor(M * p - 5 * np.sqrt(M * p * (1 - p)))))


def might_be_alike(a: str, b: str, least: float) -> Column:
    """Whether two texts of prefixes a and b, (n = number of runs, SKETCH), can reach ``least`` by size and bits."""
    half = len(SKETCH) // 2
    differ = lambda i: F.bit_count(F.col(a + SKETCH[i]).bitwiseXOR(F.col(b + SKETCH[i])).bitwiseOR(F.col(a + SKETCH[i + half]).bitwiseXOR(F.col(b + SKETCH[i + half]))))
    agree = F.lit(M)
    for i in range(half):
        agree = agree - differ(i)
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    return (F.least(n, m) >= least * F.greatest(n, m) - 1e-9) & (agree >= least_agreement(least))


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, content, n, SKETCH, keys array<long>) of rows (doc_id, content, text) with words; equal rows of a batch are one."""
    words = ", ".join(f"{s} long" for s in SKETCH)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in it:
            once = pa.array(np.sort(pd.DataFrame({"i": batch.column("doc_id").to_pandas(), "c": batch.column("content").to_pandas()}).drop_duplicates().index.to_numpy()))
            batch = batch.take(once)
            for a, b, data, offsets in batches(batch.column("text")):
                keys = shingler.keys(data, offsets)
                sig = signatures(keys, b - a)
                n = np.bincount((keys >> U(48)).astype(np.int64), minlength=b - a)
                some = np.flatnonzero(n)
                sig = np.ascontiguousarray(sig[some])
                made, bits = bands(sig), sketches(sig)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * BANDS, pa.int32()), pa.array(made.reshape(-1)))
                kept = [batch.column(c).slice(a, b - a).take(pa.array(some)) for c in ("doc_id", "content")]
                columns = [*kept, pa.array(n[some]), *(pa.array(bits[:, i]) for i in range(len(SKETCH))), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "content", "n", *SKETCH, "keys"])

    return docs.select("doc_id", "content", F.lower("text").alias("text")).mapInArrow(run, f"doc_id long, content binary, n long, {words}, keys array<long>")


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the weighted Jaccard similarity of two sorted multisets is at least ``least``."""
    n = len(a) + len(b)
    if not n or min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return False
    both = np.sort(np.concatenate([a * U(2), b * U(2) + U(1)]))
    values, heads = np.unique(both >> U(1), return_index=True)
    ones = np.add.reduceat((both & U(1)).astype(np.int64), heads)
    shared = int(np.minimum(ones, np.diff(np.r_[heads, n]) - ones).sum())
    return shared >= least * (n - shared) - 1e-9


def one_text(shingler: Shingler, text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return shingler.keys(data, np.array([0, len(data)]))


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those (a, b) of pairs (a, b, size) whose texts are alike; texts: (doc_id, text), lower case.

    size: of the bucket they met in. A hub's text goes to one place for each A_TASK texts of its bucket.
    """
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("size") / A_TASK)).alias("salt"))
    hubs = salted.select("b", "salt").distinct().join(right, "b")
    both = salted.join(left, "a").join(hubs, ["b", "salt"]).sortWithinPartitions("b", "salt")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last, hub = Shingler(), None, np.empty(0, U)
        for batch in it:
            ok = []
            for x, y in zip(batch.column("text_a"), batch.column("text_b"), strict=True):
                y = y.as_py()
                if y != last:  # rows of one hub follow one another
                    last, hub = y, one_text(shingler, y)
                ok.append(alike(one_text(shingler, x.as_py()), hub, least))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def are_stars(edges: DataFrame) -> bool:
    """Whether each a has one b, and no b is an a."""
    twice = edges.groupBy("a").count().where("count > 1").select("a")
    chained = edges.select(F.col("b").alias("a")).distinct().join(edges, "a", "left_semi")
    return twice.unionAll(chained).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all ids in links (a, b) but those that are their own component, the smallest id of each.

    Alternating large and small stars. The least neighbour of a node is an aggregate, and is stored before the edges are
    joined with it: both sides of the join are plain tables then, so that a node with a third of all edges can be split.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not are_stars(edges):
        ways = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(ways.groupBy("a").agg(F.min("b").alias("m")), "least")
        large = stored(ways.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")), "large")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        pulled = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(pulled.unionAll(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))


def cells(members: DataFrame) -> DataFrame:
    """members (bucket, size, ...) with (i, j, second): a bucket is cut by hash of the id into as many parts as its size
    needs, and each two parts, i and j, meet in a task of their own."""
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), parts.cast("long")).cast("int")
    meet = members.withColumn("part", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return meet.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).withColumn("second", F.col("part") > F.col("other")).drop("part", "other", "size")


def odd_ones(component: np.ndarray) -> np.ndarray:
    """Places outside the most frequent component: each pair of different components has one of them at least."""
    values, n = np.unique(component, return_counts=True)
    return np.flatnonzero(component != values[n.argmax()])


def doubtful(meet: DataFrame, least: float) -> DataFrame:
    """The rows of cells that have a partner of another component there which they might be like."""
    limit, half = least_agreement(least), len(SKETCH) // 2

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        component, second, n = pdf["component"].to_numpy(), pdf["second"].to_numpy(), pdf["n"].to_numpy()
        bits = pdf[SKETCH].to_numpy(np.int64)
        found = np.zeros(len(pdf), bool)
        for i in odd_ones(component):
            unlike = bits ^ bits[i]
            agree = M - np.bitwise_count(unlike[:, :half] | unlike[:, half:]).sum(axis=1, dtype=np.int64)
            good = (agree >= limit) & (component != component[i]) & (np.minimum(n, n[i]) >= least * np.maximum(n, n[i]) - 1e-9)
            if key[1] != key[2]:
                good &= second != second[i]
            if good.any():
                found |= good
                found[i] = True
        return pdf.loc[found, ["bucket", "i", "j", "second", "id", "component"]]

    return meet.groupBy("bucket", "i", "j").applyInPandas(run, "bucket long, i int, j int, second boolean, id long, component long")


def bridges(meet: DataFrame, least: float) -> DataFrame:
    """(a, b): components that two alike texts of one cell join; meet: (bucket, i, j, second, id, component, text)."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shingler = Shingler()
        data = pa.array(pdf["text"], pa.string())
        keys = [shingler.keys(d, o) + (U(a) << U(48)) for a, _, d, o in batches(data)]
        flat = np.concatenate(keys) if keys else np.empty(0, U)
        heads = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.empty(0, np.int64)
        count = np.diff(np.r_[heads, len(flat)])
        text = (flat[heads] >> U(48)).astype(np.int64)
        values, run_no = np.unique(flat[heads] & U((1 << 48) - 1), return_inverse=True)
        size = np.bincount(text, count, len(pdf))
        component, second = pdf["component"].to_numpy(), pdf["second"].to_numpy()
        bounds = np.searchsorted(text, np.arange(len(pdf) + 1))
        found, held = set(), np.zeros(len(values), count.dtype)
        for i in odd_ones(component):
            mine = slice(bounds[i], bounds[i + 1])
            held[run_no[mine]] = count[mine]
            shared = np.bincount(text, np.minimum(held[run_no], count), len(pdf))
            held[run_no[mine]] = 0
            good = (shared >= least * (size + size[i] - shared) - 1e-9) & (component != component[i]) & (shared > 0)
            if key[1] != key[2]:
                good &= second != second[i]
            found |= {(int(component[i]), int(c)) for c in np.unique(component[good])}
        return pd.DataFrame(sorted(found), columns=["a", "b"])

    return meet.groupBy("bucket", "i", "j").applyInPandas(run, "a long, b long").distinct()


def classes(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id) of each row of docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("content"))
    known = rows.where("doc_id IS NOT NULL")
    texts = known.select("doc_id", F.lower("text").alias("text"))
    first = stored(known.groupBy("content").agg(F.min("doc_id").alias("first")), "firsts")
    marks = stored(signed(known), "signatures").join(first.withColumnRenamed("first", "doc_id"), ["content", "doc_id"], "left_semi").drop("content")
    marks = stored(marks, "marks")

    # buckets of two texts or more, and each one's hub
    buckets = marks.select(F.col("doc_id").alias("id"), F.explode("keys").alias("bucket"))
    sizes = stored(buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    live = buckets.join(sizes, "bucket")
    live = live.withColumn("central", F.sum("size").over(Window.partitionBy("id")))  # a text has BANDS rows
    live = stored(live.join(marks.select(F.col("doc_id").alias("id"), "n", *SKETCH), "id"), "buckets")
    best = F.max_by(F.struct("id", "n", *SKETCH), F.struct("central", -F.col("id")))
    hubs = stored(live.groupBy("bucket").agg(best.alias("hub")), "hubs")
    met = live.join(hubs.select("bucket", *[F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("id", "n", *SKETCH)]), "bucket")
    met = met.where((F.col("id") != F.col("hub_id")) & might_be_alike("", "hub_", least))
    pairs = stored(met.groupBy(F.col("id").alias("a"), F.col("hub_id").alias("b")).agg(F.max("size").alias("size")), "pairs")
    near = stored(marked(texts, "doc_id", pairs.select("a").unionAll(pairs.select("b")), "near").where("near").drop("near"), "near")
    star = verified(pairs, near, least)

    # an id with several texts joins their classes
    several = known.groupBy("doc_id").agg(F.min(F.xxhash64("content")).alias("lo"), F.max(F.xxhash64("content")).alias("hi")).where("lo < hi")
    few = marked(known.select("doc_id", "content"), "doc_id", several.select("doc_id"), "few").where("few").join(several, "doc_id", "left_semi")
    same_id = few.distinct().join(first, "content").select("first", F.min("first").over(Window.partitionBy("doc_id")).alias("b"))
    found = components(star.unionAll(same_id.select(F.col("first").alias("a"), "b")))

    # what the stars leave open
    member = live.join(found, "id", "left").withColumn("component", F.coalesce("component", "id")).drop("central")
    member = stored(member.where("size > 2"), "members")
    open_ = stored(member.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket"), "open")
    rest = stored(doubtful(cells(member.join(open_, "bucket")), least), "doubtful")
    needed = marked(texts, "doc_id", rest.select("id"), "needed").where("needed").select(F.col("doc_id").alias("id"), "text")
    joined = components(bridges(rest.join(needed, "id"), least)).select(F.col("id").alias("component"), F.col("component").alias("whole"))

    final = found.join(joined, "component", "left").select("id", F.coalesce("whole", "component").alias("class_id"))
    final = final.unionAll(joined.select("component", "whole").join(found.select("id"), F.col("component") == F.col("id"), "left_anti"))
    named = first.join(final.withColumnRenamed("id", "first"), "first", "left").select("content", F.coalesce("class_id", "first").alias("class_id"))
    return rows.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("content")).alias("content")).join(named, "content", "left").select("doc_id", "class_id")


def one_of_each(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose id isn't their class's name; rows with a null id stay."""
    away = stored(classes(docs, least, id_col, text_col).where("doc_id <> class_id").select(F.col("doc_id").alias(id_col)).distinct(), "away")
    return without(docs, away)


def similarity(a: Column, b: Column) -> Column:
    """Exact weighted Jaccard similarity of two columns of texts (for reports and tests)."""

    @F.pandas_udf("double")
    def measure(xs: pd.Series, ys: pd.Series) -> pd.Series:
        shingler, out = Shingler(), []
        for x, y in zip(xs, ys, strict=True):
            p, q = (pd.Series(one_text(shingler, t.lower())).value_counts() for t in (x or "", y or ""))
            shared = float(np.minimum(*p.align(q, fill_value=0)).sum()) if len(p) and len(q) else 0.0
            out.append(shared / (p.sum() + q.sum() - shared) if len(p) or len(q) else float(x == y))
        return pd.Series(out)

    return measure(a, b)
