"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes is taken at every byte. A chunk ends where the hash has all bits
of a mask unset: a strict mask up to the normal size, a loose one after it (normalised chunking),
between a least and a largest size. Boundaries depend on nearby bytes only, so an insertion moves a
few chunks and leaves the rest. A document's fingerprint is the set of its chunk digests, each with
the bytes of text that have it; containment of A in B is the weight of A's chunks that B has over A's
weight.

The hash needs 32 bytes and a chunk has at least as many, so hashing many documents in one numpy
pass gives each what it would get alone.

Defined cases: a null text is empty; an empty text has the empty fingerprint; equal fingerprints
have likeness 1; an empty text has likeness 0 to others; rows with one id follow each other in the
order of their texts; a null id comes first; ids may have any type with an order; an empty table gives
no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladle.llm.common import chunks_of, keyed_text, tidy

LEAST, NORMAL, MOST = 32, 80, 320
STRICT_BITS, LOOSE_BITS = 7, 5
WINDOW_STEPS = 5  # 2**5 bytes
BLOCK = 1 << 18
Fingerprint = dict[int, int]


def gear_table(seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, np.uint32)


GEAR = gear_table()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of gear[byte k before] << k for k < 32 (mod 2**32), by doubling."""
    h = GEAR[data]
    for step in range(WINDOW_STEPS):
        gap = 1 << step
        if len(h) <= gap:
            break
        longer = h.copy()
        longer[gap:] += h[:-gap] << np.uint32(gap)
        h = longer
    return h


def boundaries(data: np.ndarray, offsets: list[int]) -> list[list[int]]:
    """For each document in data (offsets: n+1), where its chunks end."""
    hashes = gear_hashes(data)
    top = hashes >> np.uint32(32 - LOOSE_BITS)
    loose = np.flatnonzero(top == 0)
    strict = (hashes[loose] >> np.uint32(32 - STRICT_BITS)) == 0
    places = (loose + 1).tolist()
    is_strict = strict.tolist()
    out, i, n = [], 0, len(places)
    for start, stop in zip(offsets[:-1], offsets[1:]):
        ends = []
        at = start
        while at < stop:
            lo, mid, hi = at + LEAST, at + NORMAL, min(at + MOST, stop)
            while i < n and places[i] < lo:
                i += 1
            cut = hi
            j = i
            while j < n and places[j] < hi:
                if places[j] > mid or is_strict[j]:
                    cut = places[j]
                    break
                j += 1
            i = j
            ends.append(cut)
            at = cut
        out.append(ends)
    return out


def fingerprint_many(texts: list[bytes]) -> list[Fingerprint]:
    """Digest (64 bits) -> bytes of text, for each text."""
    out: list[Fingerprint] = []
    for a, b in chunks_of(np.array([len(t) for t in texts], np.int64), BLOCK):
        joined = b"".join(texts[a:b])
        offsets = [0, *np.cumsum([len(t) for t in texts[a:b]]).tolist()]
        for start, ends in zip(offsets, boundaries(np.frombuffer(joined, np.uint8), offsets)):
            weights: Fingerprint = {}
            at = start
            for end in ends:
                digest = xxhash.xxh3_64_intdigest(joined[at:end])
                weights[digest] = weights.get(digest, 0) + end - at
                at = end
            out.append(weights)
    return out


def containment(a: Fingerprint, b: Fingerprint) -> float:
    """The weight of a's chunks that b has too, over a's weight."""
    if a == b:
        return 1.0
    total = sum(a.values())
    return sum(n for d, n in a.items() if d in b) / total if total else 0.0


def render(f: Fingerprint) -> str:
    """A fingerprint as text: per chunk 16 hex digits of its digest and its weight in hex, sorted."""
    return " ".join([f"{d:016x}{n:x}" for d, n in sorted(f.items())])


def parse(text: str) -> Fingerprint:
    return {int(x[:16], 16): int(x[16:], 16) for x in text.split()}


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, fingerprint for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([render(f) for f in fingerprint_many(texts)])], ["doc_id", "n_bytes", "fingerprint"])

    docs = keyed_text(df, id_col, text_col)
    return docs.mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, fingerprint string")


def first_ids(docs: DataFrame, ranges: int) -> list:
    """The smallest id of each of some ranges of ids, ascending (null first). Only ids are looked at."""
    smallest = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("x")
    dealt = docs.select("doc_id").repartitionByRange(ranges, F.asc_nulls_first("doc_id")).groupBy(F.spark_partition_id().alias("range")).agg(smallest)
    found = [r["x"]["doc_id"] for r in dealt.collect()]  # a row for each range
    return sorted(found, key=lambda x: (x is not None, x))


def with_successors(docs: DataFrame, ranges: int) -> DataFrame:
    """doc_id, text, bucket, ghost: the rows dealt into ranges of doc_id, with the first id's rows of
    the next range (after the last range, of the first) once more as ghosts that end each range."""
    firsts = first_ids(docs, ranges)
    shared = docs.sparkSession.sparkContext.broadcast(firsts)  # an id for each range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = shared.value
        nulls = int(starts[:1] == [None])  # an empty table has no ranges
        known = starts[nulls:]
        last = len(starts) - 1
        for batch in batches:
            bucket = [0 if x is None else max(0, bisect_right(known, x) - 1 + nulls) for x in batch.column(0).to_pylist()]
            bucket = np.array(bucket, np.int32)
            ids = batch.column(0).to_pylist()
            ghosts = np.array([i for i, (x, b) in enumerate(zip(ids, bucket.tolist())) if x == starts[b]], np.int64)
            rows = pa.array(np.concatenate((np.arange(len(ids)), ghosts)))
            to = np.concatenate((bucket, np.where(bucket[ghosts] > 0, bucket[ghosts] - 1, last))).astype(np.int32)
            ghost = np.repeat(np.array([0, 1], np.int32), [len(ids), len(ghosts)])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(to), pa.array(ghost)], ["doc_id", "text", "bucket", "ghost"])

    return docs.mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, bucket int, ghost int")


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Each document, its edited text (its last floor(n/2) code points replaced by the first as many
    of the next document) and the next document, by fingerprint. The texts are shuffled once."""
    docs = keyed_text(df, id_col, text_col)
    n = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = with_successors(docs, n).repartitionById(n, "bucket").sortWithinPartitions("bucket", "ghost", F.asc_nulls_first("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, whose successor is still to come
        for batch in batches:
            ids, texts, bucket, ghost = (batch.column(i).to_pylist() for i in range(4))
            if held is not None:
                ids, texts, bucket, ghost = [held[0], *ids], [held[1], *texts], [held[2], *bucket], [held[3], *ghost]
            last = len(ids) - 1
            held = (ids[last], texts[last], bucket[last], ghost[last])
            pairs = [i for i in range(last) if not ghost[i] and bucket[i] == bucket[i + 1]]
            for a, b in chunks_of(np.array([len(texts[i]) for i in pairs], np.int64), 1 << 21):
                part = pairs[a:b]
                own, edited, following = [], [], []
                for i in part:
                    t, nxt = texts[i], texts[i + 1]
                    half = len(t) // 2
                    own.append(t.encode())
                    edited.append((t[: len(t) - half] + nxt[:half]).encode())
                    following.append(nxt)
                prints = fingerprint_many(own)
                edited_prints = fingerprint_many(edited)
                # the next document is mostly the next row of this part
                rest = {k: None for k, i in enumerate(part) if k + 1 == len(part) or part[k + 1] != i + 1}
                rest = dict(zip(rest, fingerprint_many([following[k].encode() for k in rest])))
                nexts = [rest[k] if k in rest else prints[k + 1] for k in range(len(part))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i] for i in part], batch.schema.field(0).type),
                        pa.array([len(texts[i]) for i in part], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in edited]),
                        pa.array([render(f) for f in prints]),
                        pa.array([render(f) for f in edited_prints]),
                        pa.array([containment(f, g) for f, g in zip(prints, edited_prints)], pa.float64()),
                        pa.array([containment(f, g) for f, g in zip(prints, nexts)], pa.float64()),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.mapInArrow(tidy(run), f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
