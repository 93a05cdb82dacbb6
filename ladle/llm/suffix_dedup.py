"""Exact removal of byte strings that repeat anywhere in the input, by suffix sorting.

A string of `length` bytes that occurs twice holds, in both places, the same smallest hash of a
`GRAM`-byte gram at the same offset (its anchor). So only suffixes around anchors whose gram occurs
more than once need sorting:

1. each text's anchors, with the hash of the gram and the digest of the context (every byte that a
   window over this anchor can hold: 128 bits of SHA-256, in two columns);
2. grams are counted; anchors whose gram stands once drop out, and where a whole context stands
   twice every window over it is repeated. Texts of any length and number repeat so, and carrying
   their bytes to each other would cost the repeats several times over, so equal digests stand for
   equal contexts here; the grams' short hashes are never relied on;
3. one occurrence of each remaining context is read again, and the contexts of a gram are sorted as
   suffixes that run right from the anchor and, mirrored, left from it. Suffixes are compared by
   prefix polynomial hashes: a binary search finds how far two agree, so a comparison in the
   mergesort takes a logarithmic number of steps. Neighbours' common lengths are verified byte by
   byte; where a hash misled, the group is sorted by its bytes. A window with o bytes left of the
   anchor is repeated if another context lies in the same run of right suffixes that share
   length - o bytes and in the same run of left suffixes that share o bytes;
4. spans go back to their documents.

Sorting is vectorised over all groups of an Arrow batch. A group holds distinct contexts only, so
copies count once. The contexts of a gram that has more than `MANY` are dealt further: two contexts
that share a window share the `length - reach` bytes before the anchor with the gram, or the `reach`
bytes from it on (`reach`: see `halves`), so those that agree in either meet.

A row is told from others by 124 bits of the SHA-256 of its text and its id. Rows that agree in both
lose the same bytes, so they need no telling apart.

Defined cases: a null text is empty and loses nothing; repeated rows are documents of their own, so
both lose what they share; a null id is an id like any other, and different texts may have one id; texts shorter than `length` lose
nothing; long texts are cut into overlapping pieces of bounded size for hashing only; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladle.llm.common import string_bytes, tidy, written

LENGTH, GRAM = 200, 40
PIECE = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
POSITION_BITS = 20
#: Contexts of one gram above which they are dealt by what else they share, and bytes that are sorted at a time.
MANY, SORT_BYTES = 64, 1 << 22
_tables: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse (mod 2**64) for i < n."""
    if len(_tables.get("power", ())) < n:
        size = max(n, 1 << 19)
        power = np.full(size, BASE, np.uint64)
        inverse = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        power[0] = inverse[0] = 1
        _tables["power"], _tables["inverse"] = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
    return _tables["power"][:n], _tables["inverse"][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """n+1 sums of (byte + 1) * BASE**i."""
    power, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=out[1:])
    return out


def smallest_grams(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of `length` bytes, where its smallest gram begins (the first of equals); all gram hashes."""
    sums = prefix_hashes(data)
    _, inverse = powers(len(data) + 1)
    hashes = (sums[gram:] - sums[:-gram]) * inverse[: len(data) - gram + 1]
    low = np.uint64((1 << POSITION_BITS) - 1)
    key = ((hashes * np.uint64(0xD6E8FEB86659FD93)) & ~low) | np.arange(len(hashes), dtype=np.uint64)
    span, step = length - gram + 1, 1
    while 2 * step <= span:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    if step < span:
        key = np.minimum(key[: len(key) - (span - step)], key[span - step :])
    return (key & low).astype(np.int64), hashes


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM, size: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the documents in data: row, position in data, hash of the gram."""
    rows, places, hashes = [], [], []
    at, n, total = 0, len(offsets) - 1, int(offsets[-1])
    row = 0
    while at + length <= total:
        stop = min(total, at + size + length - 1)
        piece = data[at:stop]
        best, grams = smallest_grams(piece, length, gram)
        starts = np.arange(at, at + len(best))
        owner = np.searchsorted(offsets, starts, "right") - 1
        valid = starts + length <= offsets[owner + 1]
        best, owner = best[valid], owner[valid]
        if len(best):
            new = np.ones(len(best), bool)
            new[1:] = best[1:] != best[:-1]
            rows.append(owner[new])
            places.append(best[new] + at)
            hashes.append(grams[best[new]])
        at += size
    if not rows:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    rows, places, hashes = np.concatenate(rows), np.concatenate(places), np.concatenate(hashes)
    places, first = np.unique(places, return_index=True)
    return rows[first], places, hashes[first]


def contexts_of(data: bytes, offsets: np.ndarray, rows: np.ndarray, places: np.ndarray, length: int, gram: int) -> Iterator[tuple[int, int, bytes]]:
    """Bytes left of each anchor, bytes from it on, and both together."""
    reach = length - gram
    starts, stops = offsets[rows], offsets[rows + 1]
    a, b = np.maximum(starts, places - reach), np.minimum(stops, places + length)
    for i, j, p in zip(a.tolist(), b.tolist(), places.tolist()):
        yield p - i, j - p, data[i:j]


class Suffixes:
    """Strings that begin at `begins` in data and have `sizes` bytes, compared by prefix hashes."""

    def __init__(self, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray):
        self.data, self.begins, self.sizes = data, begins, sizes
        self.sums = prefix_hashes(data)
        self.inverse = powers(len(data) + 1)[1]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many bytes the strings i and j have in common at their beginning."""
        x, y = self.begins[i], self.begins[j]
        sx, sy, ix, iy = self.sums[x], self.sums[y], self.inverse[x], self.inverse[y]
        lo, hi = np.zeros(len(i), np.int64), np.minimum(self.sizes[i], self.sizes[j])
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi + 1) >> 1
            same = (self.sums[x + mid] - sx) * ix == (self.sums[y + mid] - sy) * iy
            lo = np.where(open_ & same, mid, lo)
            hi = np.where(open_ & ~same, mid - 1, hi)

    def before(self, i: np.ndarray, j: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether string i comes before j; ties decides between equal ones."""
        n = self.common(i, j)
        si, sj = self.sizes[i], self.sizes[j]
        over_i, over_j = n == si, n == sj
        last = len(self.data) - 1
        ci = self.data[np.minimum(self.begins[i] + n, last)]
        cj = self.data[np.minimum(self.begins[j] + n, last)]
        return np.where(over_i & over_j, ties, np.where(over_i, True, np.where(over_j, False, ci < cj)))

    def sort(self, group_start: np.ndarray, group_stop: np.ndarray) -> np.ndarray:
        """Mergesort within each group, all groups at once: at each place, the string that stands there."""
        order = np.arange(len(group_start))
        sizes = group_stop - group_start
        width = 1
        while len(order) and width < sizes.max():
            here = np.flatnonzero(sizes > width)
            start, stop = group_start[here], group_stop[here]
            run = (here - start) // width
            right = (run & 1) == 1
            sibling = start + (run ^ 1) * width
            lo = np.minimum(sibling, stop)
            first, hi = lo.copy(), np.minimum(sibling + width, stop)
            mine = order[here]
            todo = np.flatnonzero(lo < hi)
            while len(todo):
                mid = (lo[todo] + hi[todo]) >> 1
                b = self.before(order[mid], mine[todo], right[todo])
                lo[todo] = np.where(b, mid + 1, lo[todo])
                hi[todo] = np.where(b, hi[todo], mid)
                todo = todo[lo[todo] < hi[todo]]
            own = here - start - run * width
            place = start + (run >> 1) * 2 * width + own + (lo - first)
            merged = order.copy()
            merged[place] = mine
            order = merged
            width *= 2
        return order

    def neighbours(self, order: np.ndarray, group_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes shared with the string before in the order (-1 at a group's first), and where a hash misled."""
        shared = np.full(len(order), -1, np.int64)
        inner = np.flatnonzero(np.arange(len(order)) > group_start)
        if not len(inner):
            return shared, np.zeros(0, np.int64)
        i, j = order[inner - 1], order[inner]
        n = self.common(i, j)
        shared[inner] = n
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        wrong = self.data[np.repeat(self.begins[i], n) + within] != self.data[np.repeat(self.begins[j], n) + within]
        bad = np.zeros(len(inner), bool)
        bad[np.repeat(np.arange(len(inner)), n)[wrong]] = True
        return shared, inner[bad]


def _sorted_by_bytes(strings: list[bytes]) -> tuple[list[int], list[int]]:
    order = sorted(range(len(strings)), key=strings.__getitem__)
    shared = [-1]
    for i, j in zip(order, order[1:]):
        a, b = strings[i], strings[j]
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        shared.append(n)
    return order, shared


def _ordered(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = Suffixes(data, begins, sizes)
    order = s.sort(start, stop)
    shared, misled = s.neighbours(order, start)
    for a, b in {(int(start[k]), int(stop[k])) for k in misled}:
        own, lengths = _sorted_by_bytes([data[begins[i] : begins[i] + sizes[i]].tobytes() for i in range(a, b)])
        order[a:b], shared[a:b] = np.array(own) + a, lengths
    return order, shared


def repeated_offsets(groups: np.ndarray, left: np.ndarray, contexts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For contexts that stand group by group (each distinct within its group): the smallest and the
    largest number of bytes left of the anchor at which a window occurs in another context of the
    group; -1 if none."""
    n = len(contexts)
    low, high = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    if not n:
        return low, high
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.fromiter(map(len, contexts), np.int64, n)
    begins = np.cumsum(sizes) - sizes
    edge = np.flatnonzero(np.diff(groups)) + 1
    edges = np.concatenate(([0], edge, [n]))
    start, stop = np.repeat(edges[:-1], np.diff(edges)), np.repeat(edges[1:], np.diff(edges))
    anchor = begins + left
    right_order, right_shared = _ordered(data, anchor, sizes - left, start, stop)
    left_order, left_shared = _ordered(data[::-1].copy(), len(data) - anchor, left, start, stop)

    def best(order: np.ndarray, shared: np.ndarray) -> np.ndarray:
        after = np.append(shared[1:], -1)
        out = np.empty(n, np.int64)
        out[order] = np.maximum(shared, after)
        return out

    first, last = np.maximum(length - best(right_order, right_shared), 0), np.minimum(best(left_order, left_shared), length - gram)
    rank_right, rank_left = np.empty(n, np.int64), np.empty(n, np.int64)
    rank_right[right_order] = np.arange(n)
    rank_left[left_order] = np.arange(n)
    for o in range(length - gram + 1):
        live = np.flatnonzero((first <= o) & (o <= last))
        if len(live) < 2:
            continue
        right_class = np.cumsum(right_shared < length - o)[rank_right[live]]
        left_class = np.cumsum(left_shared < o)[rank_left[live]]
        key = right_class * (n + 1) + left_class
        by = np.argsort(key, kind="stable")
        key = key[by]
        twin = np.zeros(len(key), bool)
        twin[1:] = key[1:] == key[:-1]
        twin[:-1] |= twin[1:]
        hit = live[by[twin]]
        low[hit] = np.where(low[hit] < 0, o, low[hit])
        high[hit] = o
    return low, high


def merged(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that spans cover, within 0..size."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        a, b = max(a, 0), min(b, size)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif a < b:
            out.append([a, b])
    return [(a, b) for a, b in out]


def context_digest(left: int, context: bytes) -> bytes:
    """16 bytes for a context with `left` bytes before its anchor."""
    return hashlib.sha256(left.to_bytes(4, "little") + context).digest()[:16]


def _anchor_rows(length: int, gram: int, digest: Callable[[int, bytes], bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_bytes(batch.column(2))
            rows, places, hashes = anchors_of(data, offsets, length, gram, PIECE)
            digests = b"".join(digest(left, c) for left, _, c in contexts_of(data.tobytes(), offsets, rows, places, length, gram))
            contexts = np.frombuffer(digests, np.int64).reshape(-1, 2)
            whose = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(whose), batch.column(1).take(whose), pa.array((places - offsets[rows]).astype(np.int32)), pa.array(hashes.view(np.int64)), pa.array(contexts[:, 0].copy()), pa.array(contexts[:, 1].copy())],
                ["k1", "k2", "pos", "g", "c", "v"],
            )

    return run


def halves(left: int, context: bytes, length: int, gram: int) -> list[bytes]:
    """What a context shares with each other one that shares a window with it: the bytes left of the
    anchor that a window reaching far left holds, or those from the anchor on that any other window holds."""
    far = (length - gram) // 2
    out = []
    if left >= far:
        out.append(b"l" + context[left - far : left + gram])
    if len(context) - left > length - far:
        out.append(b"r" + context[left : left + length - far + 1])
    return out


def _context_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            data, offsets = string_bytes(batch.column("text"))
            items = batch.column("items")
            counts = items.value_lengths().to_numpy(zero_copy_only=False)
            pos, g, c, v, many = (x.to_numpy(zero_copy_only=False) for x in items.flatten().flatten())
            rows = np.repeat(np.arange(len(counts)), counts)
            out: list[tuple[int, int, int, int, int, bytes]] = []
            size = 0
            for (left, _, context), a, b, d, split in zip(contexts_of(data.tobytes(), offsets, rows, pos + offsets[rows], length, gram), g.tolist(), c.tolist(), v.tolist(), many.tolist()):
                keys = [digest(h, a & 0xFFFF) - (1 << 63) for h in halves(left, context, length, gram)] if split else [a]
                out += [(k, a, b, d, left, context) for k in keys]
                size += len(context) * len(keys)
                if size >= SORT_BYTES:
                    yield _rows_of(out)
                    out, size = [], 0
            yield _rows_of(out)

    return run


def _rows_of(out: list[tuple[int, int, int, int, int, bytes]]) -> pa.RecordBatch:
    *numbers, left, context = zip(*out) if out else ((),) * 6
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in numbers), pa.array(left, pa.int32()), pa.array(context, pa.binary())], ["key", "g", "c", "v", "left", "context"])


def _resolve(length: int, gram: int):
    """Rows come by key and gram; whole groups are sorted together, about `SORT_BYTES` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(rows: list[tuple[int, int, int, int, int, bytes]]) -> pa.RecordBatch:
            groups, at, last = [], -1, None
            for row in rows:
                if row[:2] != last:
                    at, last = at + 1, row[:2]
                groups.append(at)
            _, g, c, v, left, contexts = zip(*rows)
            low, high = repeated_offsets(np.array(groups), np.array(left, np.int64), list(contexts), length, gram)
            found = high >= 0
            return pa.RecordBatch.from_arrays([*(pa.array(np.array(x, np.int64)[found]) for x in (g, c, v)), *(pa.array(x[found].astype(np.int32)) for x in (low, high))], ["g", "c", "v", "low", "high"])

        rows: list[tuple[int, int, int, int, int, bytes]] = []
        size = 0
        for batch in batches:
            for row in zip(*(x.to_pylist() for x in batch.columns)):
                if rows and row[:4] == rows[-1][:4]:
                    continue
                if size >= SORT_BYTES and row[:2] != rows[-1][:2]:
                    yield solved(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[5])
        if rows:
            yield solved(rows)

    return run


def _cut(names: list[str], as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_bytes(batch.column("text"))
            raw, bounds = data.tobytes(), offsets.tolist()
            items = batch.column("items")
            counts = np.nan_to_num(items.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            lo, hi = (x.to_numpy() for x in items.flatten().flatten())
            ends = np.cumsum(counts).tolist()
            spans, kept = [], []
            for i, (n, end) in enumerate(zip(counts.tolist(), ends)):
                text = raw[bounds[i] : bounds[i + 1]]
                runs = merged(list(zip(lo[end - n : end].tolist(), hi[end - n : end].tolist())), len(text)) if n else []
                spans.append([{"start": a, "end": b} for a, b in runs])
                at, parts = 0, []
                for a, b in runs:
                    parts.append(text[at:a])
                    at = b
                rest = b"".join([*parts, text[at:]]) if runs else text
                kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(np.diff(offsets)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string() if as_text else pa.binary())],
                [*names, "n_bytes", "spans", "kept"],
            )

    return run


def remove_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, as_text: bool = False, digest: Callable[[int, bytes], bytes] = context_digest
) -> DataFrame:
    """The columns of df without its text, and n_bytes, spans (array<struct<start, end>> of removed
    bytes, maximal and in order) and kept (binary: the other bytes in order; as_text: a string of them,
    without what a cut has left of a character)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = {c: f"c{i}" for i, c in enumerate(df.columns) if c != text_col}
    row, context = ["k1", "k2"], ["g", "c", "v"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.sha2(text, 256).alias("sha"), text.alias("text"), *[F.col(f"`{c}`").alias(a) for c, a in names.items()])
    docs = docs.select(F.xxhash64(names[id_col], "sha").alias("k1"), F.conv(F.substring("sha", 1, 15), 16, 10).cast("bigint").alias("k2"), "text", *names.values())
    anchors = docs.select(*row, "text").mapInArrow(tidy(_anchor_rows(length, gram, digest)), "k1 bigint, k2 bigint, pos int, g bigint, c bigint, v bigint")
    # counts are made before the shuffle, so a gram that stands everywhere is a row for each task; they
    # are written down before they are joined back, as Spark splits a skewed join of plain shuffles only
    differ = (F.min("c") != F.max("c")) | (F.min("v") != F.max("v"))
    often = written(anchors.groupBy("g").agg(F.count(F.lit(1)).alias("all"), differ.alias("several")).filter("all > 1").select("g", "several"))
    found = written(anchors.join(often, "g"))
    same = written(found.filter("several").groupBy(*context).agg((F.count(F.lit(1)) > 1).alias("whole")))
    mixed = written(same.groupBy("g").agg(F.min("whole").alias("all_whole"), (F.count(F.lit(1)) > MANY).alias("many")).filter("not all_whole").select("g", F.lit(True).alias("mixed"), "many"))
    no = F.lit(False)
    known = written(same.join(mixed, "g", "left").select(*context, "whole", F.coalesce("mixed", no).alias("mixed"), F.coalesce("many", no).alias("many")))
    shared = found.filter("several").join(known, context).select(*row, "pos", *context, "whole", "mixed", "many")
    shared = written(shared.unionByName(found.filter("not several").select(*row, "pos", *context, F.lit(True).alias("whole"), no.alias("mixed"), no.alias("many"))))

    one = shared.filter("mixed").groupBy(*context).agg(F.min(F.struct(*row, "pos")).alias("x"), F.first("many").alias("many"))
    asked = one.groupBy("x.k1", "x.k2").agg(F.collect_list(F.struct(F.col("x.pos").alias("pos"), *context, "many")).alias("items"))
    # rows of one key have one text: each context is read from every one of them, and met once when sorted
    read = docs.join(asked, row).select("text", "items")
    contexts = read.mapInArrow(tidy(_context_rows(length, gram)), "key bigint, g bigint, c bigint, v bigint, left int, context binary")
    found_in = contexts.repartition(n, "key").sortWithinPartitions("key", *context).mapInArrow(tidy(_resolve(length, gram)), "g bigint, c bigint, v bigint, low int, high int")
    # a context may be found by either of the keys
    solved = found_in.groupBy(*context).agg(F.min("low").alias("low"), F.max("high").alias("high"))

    part = shared.filter("mixed and not whole").join(solved, context).select(*row, (F.col("pos") - F.col("high")).alias("lo"), (F.col("pos") + length - F.col("low")).alias("hi"))
    whole = shared.filter("whole").select(*row, (F.col("pos") - (length - gram)).alias("lo"), (F.col("pos") + length).alias("hi"))
    # a set: rows of one key bring the same spans
    per_doc = whole.unionAll(part).groupBy(*row).agg(F.collect_set(F.struct("lo", "hi")).alias("items"))
    final = docs.join(per_doc, row, "left").select("text", *names.values(), "items")
    schema = ", ".join([*(f"{a} {docs.schema[a].dataType.simpleString()}" for a in names.values()), f"n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept {'string' if as_text else 'binary'}"])
    out = final.mapInArrow(tidy(_cut(list(names.values()), as_text)), schema)
    return out.select(*[F.col(a).alias(c) for c, a in names.items()], "n_bytes", "spans", "kept")
