"""Language-model scores by masked pseudo-likelihood.

A network reads the two tokens on either side of a masked one (embeddings, one tanh layer) and
predicts it: its class by softmax, then by a second softmax of that class its leaf. The
`OWN` most frequent words are leaves of their own; other words share a leaf by their ending and are told
apart there by how often the corpus has them. The probabilities of all words of the corpus add up
to 1 at every place. A text's score is the sum over all its tokens of the log-probability given
both sides.

1. All words of all texts are counted (partial counts in the tasks, summed by a shuffle) and kept as
   a table. The `WORDS` most frequent are sent to the tasks; what the corpus has of each other word
   is joined to the tokens that need it, so every word counts as itself, however rare.
2. Texts are encoded once and dealt by hash into shards of about `SHARD_TOKENS` tokens. A shard trains
   a copy of the network in numpy on every position of its texts, in the order of their hashes; the
   copies are averaged in whole numbers. So parameters depend on the rows alone, not on how they are
   split into tasks.
3. Every token of every text is scored.

What goes to the driver is the vocabulary and one averaged network, both of stated size; what the
tasks send (counts, encoded texts and copies) grows with the input.

Defined cases: a null or empty text has no tokens, log-probability 0 and a null mean; repeated rows
get equal scores; a word that the fitted corpus lacks counts as seen once; an empty table gives no
rows; long texts are scored whole, in parts that see their neighbours; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladle.llm.common import chunks_of, keyed_text, list_array, tidy, written

#: Words known to all tasks, classes and leaves of each; half of the classes are for words of their own.
WORDS, CLASSES, LEAVES = 1 << 16, 28, 28
OWN = ENDINGS = CLASSES * LEAVES // 2
#: Words with an embedding of their own as neighbours; the rest go by their leaf.
NEIGHBOURS, EMBED, HIDDEN, SIDES = 4096, 8, 16, (-2, -1, 1, 2)
BATCH, RATE, LARGEST = 4096, 0.02, 4.0
#: Added to what has no probability: e to it is nothing beside 1, yet gradients hold no numbers so small that float32 slows down.
NEVER = -60
SHARD_TOKENS, TRAIN_TOKENS, PART_CHARS, SCORE_ROWS = 2_000_000, 1 << 16, 1 << 20, 4096
COUNT_KEYS, SCALE = 300_000, float(1 << 32)
#: A word, or a run of other signs that are not white space.
TOKEN = re.compile(r"\w+|[^\w\s]+")


def tokens_of(text: str) -> list[str]:
    """What `TOKEN` finds in the text in lower case; most words need no search for it."""
    out = []
    for w in text.lower().split():
        if w.isalnum():
            out.append(w)
        elif w[-1] != "_" and w[:-1].isalnum():  # one sign at the end
            out += (w[:-1], w[-1])
        else:
            out += TOKEN.findall(w)
    return out


def signed_hash(text: str) -> int:
    """Spark's xxhash64 of a string."""
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def ending(word: str) -> int:
    return signed_hash(word[-2:]) % ENDINGS


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all texts; tasks add up what fits a bounded table before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for texts in _parts(batch, 0):
                for t in texts:
                    counts.update(tokens_of(t))
                if len(counts) >= COUNT_KEYS:
                    yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
                    counts = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(tidy(run), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Tokens:
    """Token ids: frequent words, then the endings of all others. frequent: (word, count) in order;
    endings: how many tokens of the corpus are words with each ending, frequent ones included."""

    def __init__(self, frequent: list[tuple[str, int]], endings: list[int]):
        self.ids = {w: i for i, (w, _) in enumerate(frequent)}
        self.words = len(frequent)
        self.size = self.words + ENDINGS
        tails = [ending(w) for w, _ in frequent]
        leaf = np.array([i if i < OWN else OWN + e for i, e in enumerate(tails)] + [OWN + e for e in range(ENDINGS)], np.int64)
        half = CLASSES // 2
        self.group = np.where(leaf < OWN, leaf % half, half + (leaf - OWN) % half)
        self.leaf = np.where(leaf < OWN, leaf, leaf - OWN) // half
        shared = np.array(endings, np.float64)
        for (_, n), e in zip(frequent[:OWN], tails):
            shared[e] -= n
        #: log of a word's share of its leaf; for endings, of one token's share, to which log n of the word is added
        known = [0.0 if i < OWN else math.log(n / max(shared[e], n)) for i, ((_, n), e) in enumerate(zip(frequent, tails))]
        self.within = np.array(known + [-math.log(max(n, 1.0)) for n in shared.tolist()])
        self.near = np.where(np.arange(self.size) < min(self.words, NEIGHBOURS), np.arange(self.size), NEIGHBOURS + np.maximum(leaf - OWN, 0)).astype(np.int32)
        self.edge = NEIGHBOURS + ENDINGS
        #: classes and leaves that have words
        self.used = np.zeros((CLASSES, LEAVES), bool)
        held = np.concatenate((np.arange(self.words), self.words + np.flatnonzero(shared > 0)))
        self.used[self.group[held], self.leaf[held]] = True

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts' tokens, how many each has, hashes of the words beyond the frequent ones, and how many each has."""
        get = self.ids.get
        out, sizes, rare, rare_sizes = [], [], [], []
        for t in texts:
            words = tokens_of(t)
            ids = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
            others = np.flatnonzero(ids < 0).tolist()
            for i in others:
                ids[i] = self.words + _ending(words[i][-2:])
                rare.append(signed_hash(words[i]))
            out.append(ids)
            sizes.append(len(ids))
            rare_sizes.append(len(others))
        return np.concatenate(out) if out else np.zeros(0, np.int32), np.array(sizes, np.int64), np.array(rare, np.int64), np.array(rare_sizes, np.int64)

    def contexts(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each token the neighbours on either side, the edge mark beyond its text."""
        reach = max(SIDES)
        n = len(ids)
        # texts with room for the edge marks between them
        at = np.arange(n) + np.repeat(np.arange(1, len(sizes) + 1) * reach, sizes)
        wide = np.full(n + (len(sizes) + 1) * reach, self.edge, np.int32)
        wide[at] = self.near[ids]
        return np.stack([wide[at + d] for d in SIDES], axis=1)


_endings: dict[str, int] = {}


def _ending(tail: str) -> int:
    """ending() of a word with this tail, remembered; the table is bounded."""
    e = _endings.get(tail)
    if e is None:
        if len(_endings) > 50_000:
            _endings.clear()
        e = _endings[tail] = ending(tail)
    return e


class Network:
    """Window network with a softmax over classes and one of each class over its leaves; `params` are
    float32 arrays in the order of `shapes`, output weights with a last row for the bias. What `used`
    (classes, leaves) rules out has no probability."""

    def __init__(self, near: int, used: np.ndarray | None = None, seed: int = 3, flat: np.ndarray | None = None):
        used = np.ones((CLASSES, LEAVES), bool) if used is None else used
        self.off = [np.where(used.any(axis=1), 0, NEVER).astype(np.float32), np.where(used, 0, NEVER).astype(np.float32)]
        wide = len(SIDES) * EMBED
        self.shapes = [(near, EMBED), (wide, HIDDEN), (HIDDEN,), (HIDDEN + 1, CLASSES), (CLASSES, HIDDEN + 1, LEAVES)]
        if flat is None:
            rng = np.random.default_rng(seed)
            self.params = [(rng.standard_normal(s) * k).astype(np.float32) for s, k in zip(self.shapes, [0.3, wide**-0.5, 0.0, 0.1, 0.1])]
        else:
            ends = np.cumsum([int(np.prod(s)) for s in self.shapes])
            self.params = [flat[e - int(np.prod(s)) : e].reshape(s).astype(np.float32) for e, s in zip(ends, self.shapes)]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.params])

    def _forward(self, context: np.ndarray, group: np.ndarray):
        table, w1, b1, wc, wl = self.params
        wc, wl = wc.copy(), wl.copy()
        wc[HIDDEN] += self.off[0]
        wl[:, HIDDEN] += self.off[1]
        n = len(context)
        x = table[context].reshape(n, -1)
        h = np.ones((n, HIDDEN + 1), table.dtype)
        np.tanh(x @ w1 + b1, out=h[:, :HIDDEN])
        order = np.argsort(group.astype(np.int16), kind="stable")  # of short numbers by radix
        sorted_h = h[order]
        ends = [0, *np.cumsum(np.bincount(group, minlength=CLASSES)).tolist()]
        zl = np.empty((n, LEAVES), table.dtype)
        for k in range(CLASSES):
            a, b = ends[k], ends[k + 1]
            if a < b:
                np.matmul(sorted_h[a:b], wl[k], out=zl[a:b])
        return x, h, h @ wc, order, sorted_h, ends, zl

    def log_p(self, context: np.ndarray, group: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        _, _, zc, order, _, _, zl = self._forward(context, group)
        rows = np.arange(len(zc))
        out, inner = zc[rows, group], zl[rows, leaf[order]]
        for z, own in ((zc, out), (zl, inner)):
            np.exp(z, out=z)  # weights are bounded, so this is
            own -= np.log(z @ np.ones(z.shape[1], z.dtype))
        out[order] += inner
        return out

    def gradient(self, context: np.ndarray, group: np.ndarray, leaf: np.ndarray) -> list[np.ndarray]:
        """Of the mean of -log_p."""
        table, w1, _, wc, wl = self.params
        x, h, zc, order, sorted_h, ends, zl = self._forward(context, group)
        n = len(zc)
        rows = np.arange(n)
        for z, own in ((zc, group), (zl, leaf[order])):
            np.exp(z, out=z)
            z *= (1 / (z @ np.ones(z.shape[1], z.dtype)))[:, None]
            z[rows, own] -= 1
            z /= n
        dh, inner, dwl = zc @ wc[:HIDDEN].T, np.empty((n, HIDDEN), table.dtype), np.zeros_like(wl)
        for k in range(CLASSES):
            a, b = ends[k], ends[k + 1]
            if a < b:
                np.matmul(zl[a:b], wl[k, :HIDDEN].T, out=inner[a:b])
                np.matmul(sorted_h[a:b].T, zl[a:b], out=dwl[k])
        dh[order] += inner
        tanh = h[:, :HIDDEN]
        dh *= 1 - tanh * tanh
        dx = dh @ w1.T
        near, each = context.ravel(), dx.reshape(-1, EMBED)
        dtable = np.empty_like(table)
        for k in range(EMBED):
            dtable[:, k] = np.bincount(near, each[:, k], len(table))
        return [dtable, x.T @ dh, dh.sum(axis=0), h.T @ zc, dwl]


class Adam:
    def __init__(self, net: Network):
        self.net, self.t = net, 0
        self.m = [np.zeros_like(p) for p in net.params]
        self.v = [np.zeros_like(p) for p in net.params]

    def step(self, context: np.ndarray, group: np.ndarray, leaf: np.ndarray) -> None:
        self.t += 1
        for p, g, m, v in zip(self.net.params, self.net.gradient(context, group, leaf), self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= np.float32(RATE) * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)
        for p in self.net.params[3:]:
            np.clip(p, -LARGEST, LARGEST, out=p)

    def train(self, tokens: Tokens, texts: list[np.ndarray]) -> None:
        """A step for every `BATCH` positions of the encoded texts, taking each position once."""
        ids = np.concatenate(texts)
        context = tokens.contexts(ids, np.array([len(t) for t in texts], np.int64))
        group, leaf = tokens.group[ids], tokens.leaf[ids]
        for a in range(0, len(ids), BATCH):
            self.step(context[a : a + BATCH], group[a : a + BATCH], leaf[a : a + BATCH])


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[list[str]]:
    """The texts of a batch, some at a time."""
    for at in range(0, batch.num_rows, 256):
        texts = batch.column(column).slice(at, 256).to_pylist()
        for a, b in chunks_of(np.array([len(t) for t in texts], np.int64), PART_CHARS):
            yield texts[a:b]


@dataclass
class Model:
    """Sent to tasks: tokens and network. counts is a table of (h, n): hashes of words and how often the corpus has them."""

    tokens: Tokens
    network: Network
    counts: DataFrame


def vocabulary(counts: DataFrame) -> tuple[Tokens, int]:
    """The tokens of counted words (word, n), and how many tokens they are."""
    frequent = [(r["word"], r["n"]) for r in counts.orderBy(F.desc("n"), "word").limit(WORDS).collect()]
    endings = [0] * ENDINGS
    for r in counts.groupBy(F.pmod(F.xxhash64(F.right("word", F.lit(2))), F.lit(ENDINGS)).alias("e")).agg(F.sum("n").alias("n")).collect():
        endings[r["e"]] = r["n"]
    return Tokens(frequent, endings), sum(endings)


def encoded(docs: DataFrame, tokens: Tokens) -> DataFrame:
    """rid (a number for the row), doc_id, tk (hash of id and text), ids (binary, int32) and rare (hashes of the
    words beyond the frequent ones), as a written table."""
    shared = docs.sparkSession.sparkContext.broadcast(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in _parts(batch, 2):
                ids, sizes, rare, rare_sizes = shared.value.encode(texts)
                ends = np.cumsum(sizes).tolist()
                coded = pa.array([ids[e - n : e].tobytes() for e, n in zip(ends, sizes.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), coded, list_array(rare, rare_sizes, pa.int64())], ["doc_id", "tk", "ids", "rare"])
                at += len(texts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("tk"), "text").mapInArrow(tidy(run), f"doc_id {kind}, tk bigint, ids binary, rare array<bigint>")
    return written(rows.withColumn("rid", F.monotonically_increasing_id()))


def trained(coded: DataFrame, tokens: Tokens, total: int) -> Network:
    """The mean of the copies that the shards of the encoded texts train."""
    spark = coded.sparkSession
    shards = max(1, -(-total // SHARD_TOKENS))
    shared = spark.sparkContext.broadcast(tokens)
    size = len(Network(tokens.edge + 1).flat())
    block = -(-size // 16)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        shard, adam, texts, held = None, None, [], 0

        def done() -> pa.RecordBatch:
            if texts:
                adam.train(known, texts)
                texts.clear()
            whole = np.zeros(16 * block + 16, np.int64).reshape(16, -1)
            whole[:, :-1].flat[:size] = np.rint(adam.net.flat().astype(np.float64) * SCALE).astype(np.int64)
            whole[:, -1] = 1
            return pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), pa.array([x.tobytes() for x in whole], pa.binary())], ["block", "sums"])

        for batch in batches:
            for s, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if s != shard:
                    if adam:
                        yield done()
                    shard, adam, held = s, Adam(Network(known.edge + 1, known.used)), 0
                if ids:
                    texts.append(np.frombuffer(ids, np.int32))
                    held += len(texts[-1])
                if held >= TRAIN_TOKENS:
                    adam.train(known, texts)
                    texts.clear()
                    held = 0
        if adam:
            yield done()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "sums"])

    dealt = coded.filter(F.octet_length("ids") > 0).select(F.pmod(F.col("tk"), F.lit(shards)).cast("int").alias("shard"), "ids", "tk").repartitionById(shards, "shard").sortWithinPartitions("shard", "tk")
    copies = dealt.select("shard", "ids").mapInArrow(tidy(train), "block int, sums binary")
    flat, seen = np.zeros((16, block)), 0
    for r in copies.repartition(16, "block").mapInArrow(tidy(add), "block int, sums binary").collect():  # one network
        sums = np.frombuffer(r["sums"], np.int64)
        flat[r["block"]], seen = sums[:-1] / SCALE / sums[-1], int(sums[-1])
    return Network(tokens.edge + 1, tokens.used, flat=flat.ravel()[:size] if seen else None)


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """Count, encode, train; the model and the encoded texts."""
    counts = written(word_counts(docs))
    tokens, total = vocabulary(counts)
    coded = encoded(docs, tokens)
    return Model(tokens, trained(coded, tokens, total), counts.groupBy(F.xxhash64("word").alias("h")).agg(F.sum("n").alias("n"))), coded


def score_encoded(coded: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, log_p (sum over tokens), mean_log_p for each encoded row."""
    shared = coded.sparkSession.sparkContext.broadcast((model.tokens, model.network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, network = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [np.frombuffer(x, np.int32) for x in part.column(2).to_pylist()]
                sizes = np.array([len(t) for t in texts], np.int64)
                ids = np.concatenate(texts)
                each, context, group, leaf = tokens.within[ids], tokens.contexts(ids, sizes), tokens.group[ids], tokens.leaf[ids]
                for a in range(0, len(ids), SCORE_ROWS):
                    each[a : a + SCORE_ROWS] += network.log_p(context[a : a + SCORE_ROWS], group[a : a + SCORE_ROWS], leaf[a : a + SCORE_ROWS])
                sums = np.zeros(len(texts))
                some = np.flatnonzero(sizes)
                if len(some):
                    sums[some] = np.add.reduceat(each, (np.cumsum(sizes) - sizes)[some])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes), pa.array(sums)], ["rid", "doc_id", "n_tokens", "known_log_p"])

    kind = coded.schema["doc_id"].dataType.simpleString()
    known = coded.select("rid", "doc_id", "ids").mapInArrow(tidy(run), f"rid bigint, doc_id {kind}, n_tokens bigint, known_log_p double")
    rare = coded.select("rid", F.explode("rare").alias("h")).join(model.counts, "h", "left").groupBy("rid").agg(F.sum(F.log(F.coalesce("n", F.lit(1)).cast("double"))).alias("rare_log_p"))
    scored = known.join(rare, "rid", "left").withColumn("log_p", F.col("known_log_p") + F.coalesce("rare_log_p", F.lit(0.0)))
    return scored.select("doc_id", "n_tokens", "log_p", F.when(F.col("n_tokens") > 0, F.col("log_p") / F.col("n_tokens")).alias("mean_log_p"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, log_p, mean_log_p for each row of doc_id, text."""
    return score_encoded(encoded(docs, model.tokens), model)


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on df and score it."""
    model, coded = fit(keyed_text(df, id_col, text_col))
    return score_encoded(coded, model)
