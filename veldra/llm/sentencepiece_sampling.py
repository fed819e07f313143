"""SentencePiece encoding by forward-filtering backward-sampling over the piece lattice, and lossless decoding.

A text, with one space put before it, is cut before each run of spaces and around each newline, which no piece of the
model crosses (a model with such pieces is refused). The lattice of such a unit has an arc for each piece of the model that
matches, and for a character without a piece an arc that spells its UTF-8 bytes. Arc weights are
``exp(alpha * log p)``, where p follows Zipf's law in the piece's rank in the model. Forward filtering sums weights up
to each position, scaled by logarithms, so a unit may have any length; backward sampling then draws arcs from the end, so whole segmentations are drawn with probability in
proportion to their weight. The numbers drawn are a hash of (row key, seed, unit, step): a row's segmentation depends
neither on the partitioning nor on other rows.

A batch's texts are cut on their bytes and their distinct units numbered by Arrow, in blocks of ``BLOCK`` bytes. Tables of
arcs are made once per distinct unit, for new units of ``CHUNK`` bytes at a time, and many units are sampled together; caches
are bounded, and tables of units that aren't kept are cut back at once. So a worker needs memory for its caches, one block and
its longest unit, however many or long its texts are. The piece ``▁`` stands for a space only: a ``▁`` in a text is spelt as bytes, so
decoding returns each text exactly.

Defined cases: a null text has null ids; an empty text has none, and decodes to an empty text; rows with equal keys and
texts get equal segmentations; an empty table gives no rows; other columns, whatever their names, pass unchanged
(result columns replace columns of the same name, in any case).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldra.llm.common import unused

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPELT = 1 << 24  # arcs that spell a character as bytes are numbered from here
KEEP = 2_000_000  # arcs kept between batches
BLOCK = 1 << 20  # bytes of text whose units are numbered together
CHUNK = 1 << 16  # bytes of units whose arcs are made together, and units sampled together


def pieces_of(model_file: str) -> tuple[list[tuple[int, str]], list[int], int]:
    """(id, text) of ordinary pieces by rank, the ids of the 256 byte pieces, and the number of pieces."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = p.get_piece_size()
    ordinary = [i for i in range(size) if not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i) or p.is_byte(i)) and (p.get_score(i) > -1e8 or not p.id_to_piece(i).strip("▁"))]
    ordinary.sort(key=lambda i: -p.get_score(i))
    texts = [(i, p.id_to_piece(i)) for i in ordinary]
    if any("▁" in t.lstrip("▁") or "\n" in t for _, t in texts):
        raise ValueError(f"{model_file} has pieces that go on after a word's end")
    return [(i, t.replace("▁", " ")) for i, t in texts], [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)], size


class Speller:
    """Ids back to text."""

    def __init__(self, pieces: list[tuple[int, str]], byte_ids: list[int], size: int):
        self.bytes = [b""] * size
        for i, text in pieces:
            self.bytes[i] = text.encode("utf-8")
        for b, i in enumerate(byte_ids):
            self.bytes[i] = bytes([b])
        self.table, self.lengths = pa.array(self.bytes, pa.large_binary()), np.array([len(b) for b in self.bytes])

    def same(self, ids: np.ndarray, ends: np.ndarray, parts: list[bytes]) -> list[bool]:
        """Whether the ids of each part, which lie one after another, are spelt as the part."""
        made = self.table.take(pa.array(ids))
        spelt = b"" if made.buffers()[2] is None else memoryview(made.buffers()[2]).cast("B")
        at = np.r_[0, np.cumsum(self.lengths[ids])][np.r_[0, ends]].tolist()
        return [spelt[a:b] == part for a, b, part in zip(at[:-1], at[1:], parts, strict=True)]

    def text(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


class Lattice:
    """Pieces as a trie over reversed text, with weights; makes and keeps the arcs of units, and samples."""

    def __init__(self, pieces: list[tuple[int, str]], byte_ids: list[int], size: int, alpha: float):
        self.byte_ids = np.array(byte_ids, np.int32)
        children: dict[tuple[int, int], int] = {}
        ends = [-1]
        total = np.log(np.arange(len(pieces)) + 2.7)
        log_p = -total - np.log(np.exp(-total).sum())
        self.log_p = np.full(size, 2 * log_p.min())
        self.deepest = max((len(text) for _, text in pieces), default=1)
        for rank, (i, text) in enumerate(pieces):
            self.log_p[i] = log_p[rank]
            node = 0
            for c in reversed(text):
                key = (node, ord(c))
                if key not in children:
                    children[key] = len(ends)
                    ends.append(-1)
                node = children[key]
            ends[node] = i
        self.bits = max(len(children) * 4, 2).bit_length()
        self.keys, self.next = np.full(1 << self.bits, -1), np.zeros(1 << self.bits, np.int64)  # open addressing, a quarter full
        keys, to = np.array([n << 21 | c for n, c in children], np.int64), np.array(list(children.values()), np.int64)
        slot = self.slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            self.keys[slot[free]], self.next[slot[free]] = keys[free], to[free]
            left = self.keys[slot] != keys
            keys, to, slot = keys[left], to[left], slot[left] + 1 & (1 << self.bits) - 1
        self.ends = np.array(ends, np.int64)
        self.alpha, self.spelt = alpha, float(log_p.min())
        self.forget()

    def forget(self) -> None:
        self.at: dict[bytes, int] = {}  # unit -> number of its last state
        self.states = self.n = 0  # used lengths of the tables: one row a state, one row an arc
        self.first = np.empty(1024, np.int64)  # state -> its first arc
        self.cum, self.piece, self.back = np.empty(1024), np.empty(1024, np.int32), np.empty(1024, np.int64)

    def put(self, table: str, at: int, values: np.ndarray) -> None:
        """Writes values from ``at`` on; tables grow by halves."""
        old = getattr(self, table)
        if at + len(values) > len(old):
            grown = np.empty((at + len(values)) * 3 // 2, old.dtype)
            grown[:at] = old[:at]
            setattr(self, table, old := grown)
        old[at : at + len(values)] = values

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Where the search for a trie's edge begins."""
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def follow(self, node: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which nodes have an edge of the character, and the nodes it leads to."""
        key = node << 21 | char
        slot = self.slots(key)
        met = self.keys[slot]
        hit = met == key
        open_ = np.flatnonzero(~hit & (met >= 0))
        while len(open_):
            slot[open_] = slot[open_] + 1 & (1 << self.bits) - 1
            met = self.keys[slot[open_]]
            hit[open_] = met == key[open_]
            open_ = open_[(met != key[open_]) & (met >= 0)]
        hit = np.flatnonzero(hit)
        return hit, self.next[slot[hit]]

    def add(self, units: list[bytes]) -> np.ndarray:
        """Forward filtering of new units; appends their states and arcs to the tables and returns their last states.

        States lie by their place in the unit, and within a place by unit, longest units first.
        """
        whole = b"".join(units)
        chars = np.frombuffer(whole.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        in_bytes = np.fromiter(map(len, units), np.int64, len(units))
        sizes = np.add.reduceat((np.frombuffer(whole, np.uint8) & 0xC0 != 0x80).astype(np.int64), np.cumsum(in_bytes) - in_bytes)
        order = np.argsort(-sizes, kind="stable")
        rank = np.empty(len(units), np.int64)
        rank[order] = np.arange(len(units))
        many = len(units) - np.cumsum(np.bincount(sizes))[:-1]  # place -> units that have it
        start = np.cumsum(many) - many
        inside = np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        char = np.empty(len(chars), np.int64)
        char[start[inside] + np.repeat(rank, sizes)] = chars
        place = np.repeat(np.arange(len(many)), many)
        before = np.where(place > 0, np.arange(len(char)) - many[place - 1], -1)  # the state before; -1 at a unit's start

        found = []  # of each length: last state, state before the first, piece
        at, node, left = np.arange(len(char)), np.zeros(len(char), np.int64), np.arange(len(char))
        bare = np.ones(len(char), bool)
        for d in range(1, self.deepest + 1):
            hit, node = self.follow(node, char[left])
            at, left = at[hit], before[left[hit]]
            piece = self.ends[node]
            good = np.flatnonzero(piece >= 0)
            found.append((at[good], left[good], piece[good]))
            if d == 1:
                bare[at[good]] = False
            more = np.flatnonzero(left >= 0)
            at, node, left = at[more], node[more], left[more]
            if not len(at):
                break
        bare = np.flatnonzero(bare)
        found.append((bare, before[bare], SPELT + char[bare]))

        arcs = np.zeros(len(char), np.int64)
        for at, _, _ in found:
            arcs[at] += 1
        free = np.cumsum(arcs) - arcs
        first = free.copy()
        n = int(arcs.sum())
        back, piece = np.empty(n, np.int64), np.empty(n, np.int64)
        for at, to, p in reversed([found[0], found[-1], *found[1:-1]]):  # long arcs first
            back[free[at]], piece[free[at]] = to, p
            free[at] += 1
        log_w = self.log_p[np.minimum(piece, len(self.log_p) - 1)]
        odd = np.flatnonzero(piece >= SPELT)
        log_w[odd] = self.spelt * utf8_length(piece[odd] - SPELT)
        log_w *= self.alpha
        ahead = np.zeros(len(char) + 1)  # logarithm of the weight of all ways up to a state; the last is that of starts
        cum = np.empty(n)
        cuts = np.r_[start, len(char)].tolist()
        arc_cuts = np.r_[first, n][cuts].tolist()
        for p, (a, b) in enumerate(zip(arc_cuts[:-1], arc_cuts[1:], strict=True)):
            states = slice(cuts[p], cuts[p + 1])
            heads = first[states] - a
            log_v = log_w[a:b] + ahead[back[a:b]]
            top = np.maximum.reduceat(log_v, heads)
            w = np.exp(log_v - np.repeat(top, arcs[states]))
            total = np.add.reduceat(w, heads)
            ahead[states] = top + np.log(total)
            cum[a:b] = w / np.repeat(total, arcs[states])
        more, k = np.flatnonzero(arcs > 1), 1
        while len(more):  # sums within each state, the same in whichever batch it comes
            cum[first[more] + k] += cum[first[more] + k - 1]
            k += 1
            more = more[arcs[more] > k]
        cum[first + arcs - 1] = 2.0  # the last arc takes what rounding leaves
        self.put("back", self.n, np.where(back < 0, -1, back + self.states))
        self.put("cum", self.n, cum)
        self.put("piece", self.n, piece)
        self.put("first", self.states, first + self.n)
        last = self.states + start[sizes - 1] + rank
        self.n, self.states = self.n + n, self.states + len(char)
        return last

    def sample(self, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
        """Ids of each text."""
        ids, ends = self.draw([spaced(t) for t in texts], keys)
        return np.split(ids, ends[:-1])

    def draw(self, parts: list[bytes], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in UTF-8, one after another, and where each text's end."""
        whole = b"".join(parts)
        data = np.frombuffer(whole, np.uint8)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        newline, space = data == 10, data == 32
        cut = newline.copy()
        cut[1:] |= newline[:-1] | (space[1:] & ~space[:-1])
        cut[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        starts = np.r_[np.flatnonzero(cut), len(data)]
        first = np.searchsorted(starts[:-1], np.cumsum(np.r_[0, sizes]))  # unit of each text
        made = [(np.empty(0, np.int32), np.empty(0, np.int64))]
        at = 0
        while at < len(starts) - 1:
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + BLOCK, "right")) - 1)
            units = pa.Array.from_buffers(pa.large_binary(), to - at, [None, pa.py_buffer(starts[at : to + 1]), pa.py_buffer(whole)])
            text = np.searchsorted(first, np.arange(at, to), "right") - 1
            seed = mixed(keys[text].astype(np.uint64) + (np.arange(at, to) - first[text]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            made.append(self.block(units.dictionary_encode(), seed))
            at = to
        ids, counts = map(np.concatenate, zip(*made, strict=True))
        return ids, np.r_[0, np.cumsum(counts)][first[1:]]

    def block(self, units: pa.DictionaryArray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, one after another, and how many each has."""
        unit, names = units.indices.to_numpy(), units.dictionary.to_pylist()
        last = np.fromiter(map(self.at.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(last < 0)
        again = new[np.bincount(unit, minlength=len(names))[new] > 1] if self.n < KEEP else new[:0]
        for some in chunks(again, names):
            kept_names = [names[i] for i in some.tolist()]
            last[some] = self.add(kept_names)
            self.at.update(zip(kept_names, last[some].tolist(), strict=True))
        drawn: list[tuple[int, np.ndarray, np.ndarray]] = []  # steps from a unit's end, units, pieces
        known = np.flatnonzero(last[unit] >= 0)
        for at in range(0, len(known), CHUNK):
            self.walk(known[at : at + CHUNK], last[unit[known[at : at + CHUNK]]], seed, drawn)
        once = np.setdiff1d(new, again, assume_unique=True)  # what a block has once, or what comes when the tables are full, isn't kept
        if len(once):
            kept, order = (self.n, self.states), np.argsort(unit, kind="stable")
            places = np.r_[0, np.cumsum(np.bincount(unit, minlength=len(names)))]
            for some in chunks(once, names):
                states = self.add([names[i] for i in some.tolist()])
                times = places[some + 1] - places[some]
                who = order[np.repeat(places[some] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))]
                self.walk(who, np.repeat(states, times), seed, drawn)
                self.n, self.states = kept
        counts = np.zeros(len(unit), np.int64)
        for _, who, _ in drawn:
            counts[who] += 1
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]), np.int32)
        for n, who, piece in drawn:
            out[ends[who] - 1 - n] = piece
        ids, ends = self.spell(out, np.r_[0, ends])
        return ids, np.diff(ends)

    def walk(self, who: np.ndarray, state: np.ndarray, seed: np.ndarray, drawn: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        """Backward sampling of some units from their last states; appends what is drawn."""
        seed, n = seed[who], 0
        while len(who):
            u = (mixed(seed + np.uint64((n + 1) * 0xD1B54A32D192ED03 % (1 << 64))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            arc = self.first[state]
            open_ = np.flatnonzero(self.cum[arc] <= u)
            while len(open_):
                arc[open_] += 1
                open_ = open_[self.cum[arc[open_]] <= u[open_]]
            drawn.append((n, who, self.piece[arc]))  # copies: the tables may be cut back
            state = self.back[arc]
            more = np.flatnonzero(state >= 0)
            who, state, seed, n = who[more], state[more], seed[more], n + 1

    def spell(self, pieces: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replaces arcs that spell a character by the ids of its bytes; moves the ends, too."""
        odd = pieces >= SPELT
        if odd.any():
            codes = pieces[odd] - SPELT
            spelt = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
            times = np.ones(len(pieces), np.int64)
            times[odd] = utf8_length(codes)
            ends = np.r_[0, np.cumsum(times)][ends]
            pieces = np.repeat(pieces, times)
            pieces[np.repeat(odd, times)] = self.byte_ids[np.frombuffer(spelt, np.uint8)]
        return pieces, ends


def spaced(text: str | None) -> bytes:
    """A text in UTF-8 with one space before it; nothing for an empty one."""
    return (" " + text).encode("utf-8", "surrogatepass") if text else b""


def chunks(some: np.ndarray, names: list[bytes]) -> list[np.ndarray]:
    """Numbers of units, longest first, in parts of CHUNK bytes or one unit."""
    if not len(some):
        return []
    sizes = np.fromiter((len(names[i]) for i in some.tolist()), np.int64, len(some))
    order = np.argsort(-sizes, kind="stable")
    part = (np.cumsum(sizes[order]) - 1) // CHUNK
    return np.split(some[order], np.flatnonzero(np.diff(part)) + 1)


def slices(batch: pa.RecordBatch, text_col: str, rows: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, of at most so many rows and of BLOCK bytes of text or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
    total = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, min(at + rows, int(np.searchsorted(total, total[at] + BLOCK, "right")) - 1))
        yield batch.slice(at, to - at)
        at = to


def utf8_length(codes: np.ndarray) -> np.ndarray:
    """Bytes of characters."""
    return 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _replaced(schema: T.StructType, *added: T.StructField) -> T.StructType:
    names = {f.name.lower() for f in added}
    return T.StructType([f for f in schema.fields if f.name.lower() not in names] + list(added))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str = MODEL, alpha: float = 0.6, seed: int = 1, out: str = "ids", keep_text: bool = True, check: str | None = None, rows: int = 256) -> DataFrame:
    """docs with ``out``: array<int>, the sampled segmentation of each text.

    check: name of one more column, whether decoding the ids gives the text again. keep_text: whether the text stays.
    """
    model = pieces_of(model_file)  # read on the driver: executors need no file
    key = unused(docs, "key")
    keyed = docs.withColumn(key, F.xxhash64(F.lit(seed), F.col(id_col)))
    added = [T.StructField(out, T.ArrayType(T.IntegerType()))] + ([T.StructField(check, T.BooleanType())] if check else [])
    schema = _replaced(docs.schema if keep_text else docs.drop(text_col).schema, *added)
    names = [f.name for f in schema.fields[: -len(added)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, speller = Lattice(*model, alpha), Speller(*model)
        for whole in batches:
            for batch in slices(whole, text_col, rows):
                texts = batch.column(text_col).to_pylist()
                keys = batch.column(key).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                parts = [spaced(t) for t in texts]
                ids, ends = lattice.draw(parts, keys)
                offsets = pa.array(np.r_[0, ends].astype(np.int32), mask=np.array([t is None for t in texts] + [False]))
                made = [pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))]
                if check:
                    made.append(pa.array(speller.same(ids, ends, parts)))
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *made], [*names, *(f.name for f in added)])

    return keyed.mapInArrow(run, schema)


def decode(encoded: DataFrame, ids_col: str = "ids", model_file: str = MODEL, out: str = "decoded") -> DataFrame:
    """encoded with ``out``: the text that the ids stand for."""
    model = pieces_of(model_file)
    schema = _replaced(encoded.schema, T.StructField(out, T.StringType()))
    names = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(*model)
        for batch in batches:
            ids = batch.column(ids_col)
            flat, offsets = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            made = [speller.text(flat[a:b].tolist()) if ok else None for a, b, ok in zip(offsets[:-1], offsets[1:], ids.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(made, pa.string())], [*names, out])

    return encoded.mapInArrow(run, schema)
