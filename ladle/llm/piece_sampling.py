"""SentencePiece encoding by forward-filtering backward-sampling, and lossless decoding.

A text's segmentations form a lattice: an arc for each piece of the vocabulary that matches there.
Forward filtering sums the weight of all ways to reach each node; sampling walks back from the end
and picks each arc with its share of that sum, so a segmentation is drawn with its probability under
the piece weights. The random numbers are hashes of the row's key, the seed and the place in the
text, so a row gets the same segmentation wherever and whenever it is encoded.

No piece holds a space after its beginning, so the lattice falls into parts (spaces and the word
after them); each distinct part of a batch is filtered once and sampling runs over all occurrences
at once. The vocabulary is that of a published model; as a BPE model has merge ranks and no
probabilities, the weight of a piece is 1 / (rank + 2) ** theta.

Spaces are pieces' U+2581; a U+2581 of the text, and any character without a piece, is written as
its UTF-8 bytes' pieces. There is no normalisation and no dummy prefix, so decoding gives back the
text byte by byte.

Defined cases: a null text is empty and has no pieces; rows with one key and equal text get equal
pieces; a null key is the key "None"; an empty table gives no rows; long texts are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladle.llm.common import chunks_of, list_array, string_bytes, text_sizes, tidy

UNIT = re.compile(r" *[^ ]+| +")
SPACE, LITERAL = 0x2581, 0x110000  # LITERAL stands for a U+2581 of the text
BATCH_CHARS = 1 << 19
UNIT_MASS = 1 << 40
COMMON_LENGTH = 64
ONE = np.uint64(1)
MULT = np.uint64(0x9E3779B97F4A7C15)
_vocabularies: dict[int, "Vocabulary"] = {}


def model_bytes(path: str | None = None) -> bytes:
    """The model file; by default the installed public BPE model with byte fallback."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Vocabulary:
    """Pieces by length as sorted hashes, a bit map of all hashes, weights and the bytes of each id."""

    BITS = 20

    def __init__(self, model: bytes, theta: float = 1.0):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = m.vocab_size()
        self.byte_id = np.full(256, -1, np.int64)
        texts: dict[str, int] = {}
        plain = [b""] * n
        for i in range(n):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                plain[i] = bytes([int(piece[1:-1], 16)])
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                texts[piece] = i
                plain[i] = piece.replace("▁", " ").encode()
        ids = sorted(texts.values())
        rank = np.full(n, len(ids), np.float64)
        rank[ids] = np.arange(len(ids))
        self.logp = -theta * np.log(rank + 2)
        self.longest = max(map(len, texts))
        self.bit = np.zeros(1 << self.BITS, bool)
        self.common: tuple[dict[str, int], Lattice] | None = None
        self.by_length: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for size in range(1, self.longest + 1):
            some = [(p, i) for p, i in texts.items() if len(p) == size]
            if not some:
                self.by_length.append(self.by_length[0])
                continue
            cp = np.array([[ord(c) for c in p] for p, _ in some], np.uint64)
            h = np.zeros(len(some), np.uint64)
            for k in range(size):
                h = self.roll(h, cp[:, k])
            order = np.argsort(h)
            assert len(np.unique(h)) == len(h)
            self.by_length.append((h[order], np.array([i for _, i in some])[order]))
            self.bit[self.slot(h, size)] = True
        self.size = np.array([len(b) for b in plain], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(plain), np.uint8)
        self.piece_text = [m.id_to_piece(i) for i in range(n)]

    @staticmethod
    def roll(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (h ^ (c + np.uint64(0x51ED27))) * np.uint64(0x100000001B3) ^ (h >> np.uint64(29))

    def slot(self, h: np.ndarray, size: int) -> np.ndarray:
        return (((h + np.uint64(size)) * MULT) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def arcs(self, cp: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Every match of a piece in the parts that stand in cp: first place, length, id; id -1 for a
        character that has no piece."""
        n = len(cp)
        left = np.repeat(begin + sizes, sizes) - np.arange(n)  # characters from here to the part's end
        wide = cp.astype(np.uint64)
        at = np.arange(n)
        h = np.zeros(n, np.uint64)
        places, lengths, ids = [], [], []
        for size in range(1, self.longest + 1):
            keep = left[at] >= size
            at, h = at[keep], h[keep]
            if not len(at):
                break
            h = self.roll(h, wide[at + size - 1])
            maybe = np.flatnonzero(self.bit[self.slot(h, size)])
            keys, values = self.by_length[size]
            if len(keys) and len(maybe):
                k = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
                hit = keys[k] == h[maybe]
                found, which = at[maybe[hit]], values[k[hit]]
                real = self.same(cp, found, which, size)
                found, which = found[real], which[real]
                places.append(found)
                lengths.append(np.full(len(found), size))
                ids.append(which)
            if size == 1:
                bare = np.ones(n, bool)
                if places:
                    bare[places[0]] = False
                bare = np.flatnonzero(bare)
                places.append(bare)
                lengths.append(np.ones(len(bare), np.int64))
                ids.append(np.full(len(bare), -1))
        return np.concatenate(places), np.concatenate(lengths), np.concatenate(ids)

    def same(self, cp: np.ndarray, places: np.ndarray, ids: np.ndarray, size: int) -> np.ndarray:
        """Whether the characters are the piece's, as a hash alone could mislead."""
        if not hasattr(self, "_cp"):
            self._cp = np.zeros((len(self.piece_text), self.longest), np.uint32)
            for i, p in enumerate(self.piece_text):
                self._cp[i, : min(len(p), self.longest)] = [ord(c) for c in p[: self.longest]]
        ok = np.ones(len(places), bool)
        for k in range(size):
            ok &= cp[places + k] == self._cp[ids, k]
        return ok


def vocabulary(model: bytes, theta: float = 1.0) -> Vocabulary:
    key = xxhash.xxh64_intdigest(model, int(theta * 1e6))
    if key not in _vocabularies:
        _vocabularies[key] = Vocabulary(model, theta)
    return _vocabularies[key]


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Lattice:
    """Forward-filtered lattices of distinct parts; nodes of part p are base[p] .. base[p] + its length."""

    def __init__(self, v: Vocabulary, parts: list[str]):
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        cp = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        literal = cp == SPACE
        cp[cp == 32] = SPACE
        cp[literal] = LITERAL
        begin = np.cumsum(sizes) - sizes
        places, lengths, ids = v.arcs(cp, begin, sizes)
        part = np.repeat(np.arange(len(parts)), sizes)[places]
        self.base = begin + np.arange(len(parts))
        self.sizes = sizes
        source = places + part  # one more node than characters in each part
        target = source + lengths
        depth = target - self.base[part]
        # bytes of characters without a piece
        bare = ids < 0
        chars = np.where(literal, np.uint32(SPACE), cp)[places[bare]]
        self.fallback = [c.encode("utf-8", "surrogatepass") for c in map(chr, chars.tolist())]
        weight = np.empty(len(ids))
        weight[~bare] = v.logp[ids[~bare]]
        n_bytes = np.fromiter(map(len, self.fallback), np.int64, len(self.fallback))
        weight[bare] = n_bytes * v.logp[v.byte_id[0]]
        count = np.ones(len(ids), np.int64)
        count[bare] = n_bytes
        nodes = int(sizes.sum()) + len(parts)
        order = np.argsort((depth * nodes + target) * 64 + lengths)  # no two arcs have the same key
        source, target, depth, weight, lengths = source[order], target[order], depth[order], weight[order], lengths[order]
        reach = np.full(nodes, -np.inf)
        reach[self.base] = 0.0
        share = np.empty(len(order))
        edges = np.searchsorted(depth, np.arange(1, int(sizes.max(initial=0)) + 2))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if a == b:
                continue
            value = reach[source[a:b]] + weight[a:b]
            first = np.flatnonzero(np.concatenate(([True], target[a + 1 : b] != target[a : b - 1])))
            top = np.maximum.reduceat(value, first)
            repeat = np.diff(np.append(first, b - a))
            e = np.exp(value - np.repeat(top, repeat))
            total = np.add.reduceat(e, first)
            reach[target[a:b][first]] = top + np.log(total)
            share[a:b] = e / np.repeat(total, repeat)
        # arcs by target; the upper end of each arc's part of its node's 2**40, in whole numbers, so
        # that a draw does not depend on what else stands in the tables
        by = np.argsort(target * 64 + lengths)
        self.source, target, share = source[by], target[by], share[by]
        width = (share * UNIT_MASS).astype(np.int64)
        total = np.cumsum(width)
        starts = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1]))) if len(target) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(target))
        self.upper = total - np.repeat(total[starts] - width[starts], ends - starts)
        self.upper[ends - 1] = UNIT_MASS
        self.first = np.zeros(nodes + 1, np.int64)  # where a node's arcs begin
        self.first[1:] = np.cumsum(np.bincount(target, minlength=nodes))
        # tokens of each arc
        tokens = np.empty(len(ids), np.int64)
        tokens[~bare] = ids[~bare]
        self.count = count[order][by]
        flat: list[np.ndarray] = []
        start = np.zeros(len(ids), np.int64)
        start[~bare] = np.arange(int((~bare).sum()))
        flat.append(tokens[~bare])
        joined = np.frombuffer(b"".join(self.fallback), np.uint8)
        start[bare] = len(flat[0]) + np.cumsum(n_bytes) - n_bytes
        flat.append(v.byte_id[joined])
        self.flat = np.concatenate(flat)
        self.start = start[order][by]

    def sample(self, parts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each occurrence of a part, with its random key: how many tokens, and all tokens in order."""
        node = self.base[parts] + self.sizes[parts]
        home = self.base[parts]
        live = np.arange(len(parts))
        steps = np.zeros(len(parts), np.int64)
        drawn: list[tuple[np.ndarray, np.ndarray]] = []
        while len(live):
            at = node[live]
            r = _mix(keys[live] + (at - home[live]).astype(np.uint64) * MULT)
            aim = (r >> np.uint64(24)).astype(np.int64)
            arc, final = self.first[at], self.first[at + 1] - 1
            more = np.flatnonzero((self.upper[arc] <= aim) & (arc < final))
            while len(more):
                arc[more] += 1
                more = more[(self.upper[arc[more]] <= aim[more]) & (arc[more] < final[more])]
            drawn.append((live, arc))
            steps[live] += 1
            node[live] = self.source[arc]
            live = live[node[live] > home[live]]
        if not len(parts):
            return steps, np.zeros(0, np.int64)
        end = np.cumsum(steps)
        path = np.empty(int(end[-1]), np.int64)
        for k, (who, arc) in enumerate(drawn):
            path[end[who] - 1 - k] = arc
        count = self.count[path]
        per_part = np.add.reduceat(count, end - steps)
        place = np.repeat(self.start[path] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return per_part, self.flat[place]


def common_parts(v: Vocabulary, units: list[str]) -> tuple[dict[str, int], Lattice]:
    """A worker's first parts, filtered once and kept: they are mostly the frequent ones."""
    if v.common is None:
        known = {u: i for i, u in enumerate(dict.fromkeys([" ", *(u for u in units if len(u) <= COMMON_LENGTH)]))}
        v.common = known, Lattice(v, list(known))
    return v.common


def sample_parts(v: Vocabulary, units: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens each part has, and all tokens in order."""
    known, kept = common_parts(v, units)
    others = Numbers()
    get, number = known.get, others.__getitem__
    numbers = np.fromiter(map(get, units, repeat(-1)), np.int64, len(units))
    new = np.flatnonzero(numbers < 0)
    old = np.flatnonzero(numbers >= 0)
    fresh = np.fromiter((number(units[i]) for i in new.tolist()), np.int64, len(new))
    sizes = np.empty(len(units), np.int64)
    drawn = []
    for lattice, where, parts in ((kept, old, numbers[old]), (Lattice(v, list(others)) if others else kept, new, fresh)):
        count, tokens = lattice.sample(parts, keys[where])
        sizes[where] = count
        drawn.append((where, count, tokens))
    begin = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.int64)
    for where, count, tokens in drawn:
        out[np.repeat(begin[where] - (np.cumsum(count) - count), count) + np.arange(len(tokens))] = tokens
    return sizes, out


def encode_many(v: Vocabulary, texts: list[str], keys: list[str], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of tokens of each text, and all tokens."""
    counts, units = [], []
    for t in texts:
        found = UNIT.findall(t)
        counts.append(len(found))
        units += found
    counts = np.array(counts, np.int64)
    if not units:
        return np.zeros(len(texts), np.int64), np.zeros(0, np.int64)
    row = np.fromiter((xxhash.xxh64_intdigest(k, seed) for k in keys), np.uint64, len(keys))
    within = np.arange(len(units)) - np.repeat(np.cumsum(counts) - counts, counts)
    random = _mix(np.repeat(row, counts) + (within.astype(np.uint64) + ONE) * np.uint64(0xD1B54A32D192ED03))
    per_part, tokens = sample_parts(v, units, random)
    sizes = np.zeros(len(texts), np.int64)
    some = np.flatnonzero(counts)
    sizes[some] = np.add.reduceat(per_part, (np.cumsum(counts) - counts)[some])
    return sizes, tokens


def decode_many(v: Vocabulary, sizes: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each text, and all bytes."""
    n = v.size[tokens]
    place = np.repeat(v.begin[tokens] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    ends = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(sizes)))]
    return np.diff(ends), v.bytes[place]


def encode(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", seed: int = 0, theta: float = 1.0, model: bytes | None = None) -> DataFrame:
    """df with __pieces (array<int>: the sampled piece ids) and __lossless (whether decoding them gave
    the text's bytes back)."""
    proto = df.sparkSession.sparkContext.broadcast(model or model_bytes())
    names = list(df.columns)
    inner, at = df.select(F.col(key_col).cast("string").alias("key"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]), names.index(text_col) + 1
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in inner.schema[1:]] + ["pieces array<int>", "lossless boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(proto.value, theta)
        for whole in batches:
            for a, b in chunks_of(text_sizes(whole.column(at)), BATCH_CHARS):
                batch = whole.slice(a, b - a)
                texts = pc.fill_null(batch.column(at), "")
                data, offsets = string_bytes(texts)
                sizes, tokens = encode_many(v, texts.to_pylist(), [str(k) for k in batch.column(0).to_pylist()], seed)
                back, decoded = decode_many(v, sizes, tokens)
                same = back == np.diff(offsets)
                if not (same.all() and np.array_equal(decoded, data)):
                    ends = np.cumsum(back)
                    same = np.array([bool(s) and decoded[e - n : e].tobytes() == data[p:q].tobytes() for s, e, n, p, q in zip(same, ends, back, offsets, offsets[1:])], bool)
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], list_array(tokens.astype(np.int32), sizes, pa.int32()), pa.array(same)], [*batch.schema.names[1:], "pieces", "lossless"])

    out = inner.mapInArrow(tidy(run), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("pieces").alias("__pieces"), F.col("lossless").alias("__lossless"))


def decode(df: DataFrame, pieces_col: str = "pieces", model: bytes | None = None) -> DataFrame:
    """df with __text, the text that the piece ids stand for; null where the ids are null."""
    proto = df.sparkSession.sparkContext.broadcast(model or model_bytes())
    names = list(df.columns)
    inner = df.select(F.col(pieces_col).cast("array<int>").alias("pieces"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in inner.schema[1:]] + ["text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(proto.value)
        for batch in batches:
            column = batch.column(0)
            sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            back, data = decode_many(v, sizes, column.flatten().to_numpy().astype(np.int64))
            raw, ends = data.tobytes(), np.cumsum(back).tolist()
            texts = [raw[e - n : e].decode("utf-8", "replace") if ok else None for e, n, ok in zip(ends, back.tolist(), column.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(1, batch.num_columns)), pa.array(texts, pa.string())], [*batch.schema.names[1:], "text"])

    out = inner.mapInArrow(tidy(run), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("text").alias("__text"))
