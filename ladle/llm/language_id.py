"""Language identification by a linear-chain conditional random field over words.

Every word (a run of letters, lower-cased) gets a label. Its score for a label is the sum of learned
weights of its character n-grams with word boundaries, its prefixes and suffixes, and the word
itself (the lexicon); neighbouring labels have learned transition weights. Forward-backward gives
each word's label probabilities; a text's prediction is the label with the largest share of them.

The field is trained on a bounded sample of labelled texts (`docs_per_language`, by hash of the id),
cut and joined into sequences that switch language, so transitions are learned too. Features are
hashed into tables of fixed size, so the model that goes to the tasks is bounded.

Scores are summed over code points and words in numpy, and the recursions run over all texts of a
batch at once, longest first.

Defined cases: a text that is null or has no letter gets `und` and score 0; with no labelled text
every prediction is `und`; repeated rows get equal predictions; an empty table gives no rows; long
texts are labelled whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladle.llm.common import chunks_of, text_sizes, tidy

DOCS_PER_LANGUAGE = 250
SEQUENCES, SEQUENCE_WORDS, EPOCHS = 1600, 60, 40
NGRAM_BITS, WORD_BITS = 14, 17
UNKNOWN = "und"
#: Texts whose recursions run together, and texts whose features are made together.
BATCH_CHARS, PART_CHARS = 1 << 20, 1 << 18
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts with a space after each, and where each text begins."""
    # the one letter whose lower case is longer than itself
    lowered = [t.replace("İ", "i").lower() for t in texts]
    sizes = np.array([len(t) + 1 for t in lowered], np.int64)
    data = np.frombuffer((" ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    return data, np.concatenate(([0], np.cumsum(sizes)))


def _mixed(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def word_bounds(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    letter = letter_table()[cp]
    change = np.diff(letter.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    return letter, np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def features(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Where words start and stop; hashed n-grams at every code point (those of a word stand at its
    letters and at the place after it); hashed features of every word."""
    letter, starts, stops = word_bounds(cp)
    c0 = np.where(letter, cp, 0).astype(np.uint64)
    c1 = np.concatenate((np.zeros(1, np.uint64), c0[:-1]))
    c2 = np.concatenate((np.zeros(2, np.uint64), c0[:-2]))[: len(c0)]
    two = (c0 << np.uint64(21)) | c1
    three = (two << np.uint64(21)) | c2
    grams = [_mixed(c0 + np.uint64(1), NGRAM_BITS), _mixed(two ^ np.uint64(1 << 50), NGRAM_BITS), _mixed(three ^ np.uint64(1 << 63), NGRAM_BITS)]
    # a sum over a word's letters that depends on their order, from prefix sums
    n = len(cp)
    place = np.arange(n, dtype=np.uint64)
    begun = np.zeros(n, np.uint64)
    begun[starts] = starts.astype(np.uint64) - np.concatenate((np.zeros(1, np.uint64), starts[:-1].astype(np.uint64)))[: len(starts)]
    index = place - np.cumsum(begun)
    spread = (c0 + np.uint64(7)) * (index * np.uint64(2) + np.uint64(0xD1B54A32D192ED03))
    spread ^= spread >> np.uint64(29)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(spread * np.uint64(0xBF58476D1CE4E5B9))))
    whole = sums[stops] - sums[starts]
    size = stops - starts
    head = sums[np.minimum(starts + 4, stops)] - sums[starts]
    back = np.zeros(len(starts), np.uint64)
    for k in range(1, 5):
        at = np.maximum(stops - k, 0)
        back = back * np.uint64(0x100000001B3) + np.where(k <= size, c0[at], 0) if len(starts) else back
    words = [_mixed(whole, WORD_BITS), _mixed(head ^ np.uint64(3 << 40), NGRAM_BITS), _mixed(back ^ np.uint64(5 << 40), NGRAM_BITS)]
    return starts, stops, grams, words


@dataclass
class Field:
    labels: list[str]
    grams: list[np.ndarray]  # [2**NGRAM_BITS, labels] for 1, 2 and 3 code points
    words: list[np.ndarray]  # whole word, prefix, suffix
    start: np.ndarray
    step: np.ndarray

    def scores(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, stops, grams, words = features(cp)
        if not len(starts):
            return starts, stops, np.zeros((0, len(self.labels)), np.float32)
        at = self.grams[0][grams[0]]
        for table, g in zip(self.grams[1:], grams[1:]):
            at += table[g]
        # n-grams of a word: its letters and the boundary after it
        ends = np.stack((starts, stops + 1), axis=1).ravel()
        padded = np.concatenate((at, np.zeros((2, at.shape[1]), at.dtype)))
        out = np.add.reduceat(padded, ends, axis=0)[::2]
        for table, w in zip(self.words, words):
            out += table[w]
        return starts, stops, out


def forward_backward(scores: np.ndarray, counts: np.ndarray, start: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Label probabilities of every word; the words of each sequence stand together."""
    n, k = scores.shape
    counts = counts[counts > 0]
    if not n:
        return np.zeros((0, k))
    local = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64) + 1e-30
    begin = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    begin, size = begin[order], counts[order]
    move = np.exp(step - step.max())
    first = np.exp(start - start.max())
    # how many sequences are at least t+1 long
    alive = len(size) - np.searchsorted(size[::-1], np.arange(size[0]), "right")
    forward = np.empty((n, k))
    a = local[begin] * first
    a /= a.sum(axis=1, keepdims=True)
    forward[begin] = a
    for t in range(1, int(size[0])):
        at = begin[: alive[t]] + t
        a = (a[: alive[t]] @ move) * local[at]
        a /= a.sum(axis=1, keepdims=True)
        forward[at] = a
    b = np.ones((0, k))
    for t in range(int(size[0]) - 1, 0, -1):
        if len(b) < alive[t]:
            b = np.concatenate((b, np.ones((alive[t] - len(b), k))))
        at = begin[: alive[t]] + t
        carried = (b * local[at]) @ move.T
        carried /= carried.sum(axis=1, keepdims=True)
        forward[at] *= b
        b = carried
    forward[begin[: len(b)]] *= b
    forward /= forward.sum(axis=1, keepdims=True)
    return forward


def word_scores(field: Field, texts: list[str], sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where each text begins and how many words it has; each word's start, stop and scores."""
    parts, at = [], 0
    for a, b in chunks_of(sizes, PART_CHARS):
        cp, begin = code_points(texts[a:b])
        starts, stops, local = field.scores(cp)
        parts.append((begin[:-1] + at, np.diff(np.searchsorted(starts, begin)), starts + at, stops + at, local))
        at += len(cp)
    return tuple(np.concatenate(x) for x in zip(*parts))


def train(texts: list[str], langs: list[str], seed: int = 7) -> Field | None:
    """Maximum likelihood with L2 by Adam over sequences made of pieces of texts."""
    labels = sorted(set(langs))
    parts = list(chunks_of(np.array([len(t) for t in texts], np.int64), PART_CHARS))
    counts = []
    for lo, hi in parts:
        cp, begin = code_points(texts[lo:hi])
        counts.append(np.diff(np.searchsorted(word_bounds(cp)[1], begin)))
    count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    if not count.sum():
        return None
    label_of = np.repeat(np.array([labels.index(x) for x in langs]), count)
    rng = np.random.default_rng(seed)
    first = np.cumsum(count) - count
    usable = np.flatnonzero(count >= 3)
    if not len(usable):
        usable = np.flatnonzero(count)
    by_label = [usable[np.array([langs[i] == x for i in usable])] for x in labels]
    by_label = [x for x in by_label if len(x)]
    k, length = len(labels), SEQUENCE_WORDS
    picks = np.empty((SEQUENCES, length), np.int64)
    for s in range(SEQUENCES):
        cuts = [0, *sorted(rng.integers(1, length, rng.integers(0, 3)).tolist()), length]
        for a, b in zip(cuts, cuts[1:]):
            doc = rng.choice(by_label[rng.integers(len(by_label))])
            at = rng.integers(count[doc])
            picks[s, a:b] = first[doc] + (at + np.arange(b - a)) % count[doc]
    used, inverse = np.unique(picks, return_inverse=True)
    inverse = inverse.reshape(picks.shape)
    gold = label_of[picks]
    # every feature of every used word: its slot in one long table, and its word
    tables = [1 << NGRAM_BITS] * 3 + [1 << WORD_BITS, 1 << NGRAM_BITS, 1 << NGRAM_BITS]
    offset = np.cumsum([0, *tables])
    slot_parts, row_parts = [], []
    for lo, hi in parts:
        begun = int(first[lo])
        here = np.arange(*np.searchsorted(used, [begun, begun + int(count[lo:hi].sum())]))
        if not len(here):
            continue
        starts, stops, grams, words = features(code_points(texts[lo:hi])[0])
        own = used[here] - begun
        spans = (stops - starts + 1)[own]
        flat = np.repeat(starts[own] - (np.cumsum(spans) - spans), spans) + np.arange(int(spans.sum()))
        slot_parts += [g[flat] + o for g, o in zip(grams, offset)] + [w[own] + o for w, o in zip(words, offset[3:])]
        row_parts += [np.repeat(here, spans)] * 3 + [here] * 3
    slots, rows = np.concatenate(slot_parts), np.concatenate(row_parts)
    slot_ids, slots = np.unique(slots, return_inverse=True)
    weight = np.zeros((len(slot_ids), k))
    start, step = np.zeros(k), np.zeros((k, k))
    target = np.zeros((len(used), k))
    np.add.at(target, (inverse.ravel(), gold.ravel()), 1.0)
    params = [weight, start, step]
    first_moment, second_moment = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    gold_step = np.zeros((k, k))
    np.add.at(gold_step, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1.0)
    gold_start = np.bincount(gold[:, 0], minlength=k).astype(float)
    for epoch in range(1, EPOCHS + 1):
        local = np.stack([np.bincount(rows, weight[slots, j], len(used)) for j in range(k)], axis=1)
        seq = local[inverse]
        e = np.exp(seq - seq.max(axis=2, keepdims=True))
        move = np.exp(step - step.max())
        f = np.empty_like(e)
        a = e[:, 0] * np.exp(start - start.max())
        f[:, 0] = a / a.sum(axis=1, keepdims=True)
        for t in range(1, length):
            a = (f[:, t - 1] @ move) * e[:, t]
            f[:, t] = a / a.sum(axis=1, keepdims=True)
        b = np.ones((len(e), k))
        gamma = np.empty_like(e)
        xi = np.zeros((k, k))
        for t in range(length - 1, -1, -1):
            g = f[:, t] * b
            gamma[:, t] = g / g.sum(axis=1, keepdims=True)
            if t:
                eb = e[:, t] * b
                norm = np.einsum("si,ij,sj->s", f[:, t - 1], move, eb)
                xi += np.einsum("si,ij,sj,s->ij", f[:, t - 1], move, eb, 1 / norm)
                b = eb @ move.T
                b /= b.sum(axis=1, keepdims=True)
        expected = np.stack([np.bincount(inverse.ravel(), gamma[:, :, j].ravel(), len(used)) for j in range(k)], axis=1)
        diff = (target - expected) / SEQUENCES
        grads = [np.stack([np.bincount(slots, diff[rows, j], len(slot_ids)) for j in range(k)], axis=1) - 1e-4 * weight, (gold_start - gamma[:, 0].sum(axis=0)) / SEQUENCES, (gold_step - xi) / SEQUENCES]
        for p, g, m, v in zip(params, grads, first_moment, second_moment):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += 0.1 * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
    full = np.zeros((int(offset[-1]), k), np.float32)
    full[slot_ids] = weight
    parts = [full[a:b] for a, b in zip(offset, offset[1:])]
    return Field(labels, parts[:3], parts[3:], start, step)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE) -> Field | None:
    """Train on at most `docs_per_language` texts of each language, chosen by hash of the id; of an id that
    comes several times one row counts."""
    known = df.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).filter(F.col("id").isNotNull() & F.col("lang").isNotNull())
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    ids = [r["id"] for r in known.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= docs_per_language).select("id").collect()]
    if not ids:
        return None
    chosen = df.filter(F.col(id_col).isin(ids) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    # one row of each id, however often it comes
    one = chosen.groupBy("id").agg(F.min_by(F.struct("text", "lang"), F.xxhash64("text", "lang")).alias("x")).select("id", "x.text", "x.lang").collect()
    rows = sorted(((r["id"], r["text"], r["lang"]) for r in one), key=lambda r: (str(r[0]), r[1], r[2]))
    return train([r[1] for r in rows], [r[2] for r in rows])


def labelled(df: DataFrame, field: Field | None, text_col: str = "text", spans: bool = True) -> DataFrame:
    """df with __lang (the predicted language), __score (its share of the text's words) and, if asked
    for, __words: array<struct<start, end, lang, p>> with code point offsets."""
    model = df.sparkSession.sparkContext.broadcast(field)
    names = list(df.columns)
    inner, at = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]), names.index(text_col)
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in inner.schema] + ["lang string, score double"] + ["words array<struct<start:int,end:int,lang:string,p:float>>"] * spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = model.value
        for whole in batches:
            sizes = text_sizes(whole.column(at))
            for lo, hi in chunks_of(sizes, BATCH_CHARS):
                batch = whole.slice(lo, hi - lo)
                texts = [t or "" for t in batch.column(at).to_pylist()]
                n = len(texts)
                if field is None:
                    langs, scores, counts = [UNKNOWN] * n, np.zeros(n), np.zeros(n, np.int64)
                    starts = stops = best = np.zeros(0, np.int64)
                    p = np.zeros((0, 1))
                    begin = np.zeros(n, np.int64)
                else:
                    begin, counts, starts, stops, local = word_scores(field, texts, sizes[lo:hi])
                    p = forward_backward(local, counts, field.start, field.step)
                    share = np.zeros((n, len(field.labels)))
                    some = np.flatnonzero(counts)
                    if len(some):
                        share[some] = np.add.reduceat(p, (np.cumsum(counts) - counts)[some], axis=0) / counts[some, None]
                    top = share.argmax(axis=1)
                    langs = [field.labels[t] if c else UNKNOWN for t, c in zip(top.tolist(), counts.tolist())]
                    scores = np.minimum(share[np.arange(n), top], 1.0)
                    best = p.argmax(axis=1)
                columns = batch.columns + [pa.array(langs, pa.string()), pa.array(scores)]
                if spans:
                    shift = np.repeat(begin, counts)
                    parts = [pa.array((starts - shift).astype(np.int32)), pa.array((stops - shift).astype(np.int32)), pa.array([field.labels[i] for i in best.tolist()] if field else [], pa.string()), pa.array(p.max(axis=1).astype(np.float32) if len(p) else np.zeros(0, np.float32))]
                    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, ["start", "end", "lang", "p"])))
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "lang", "score", *["words"] * spans])

    out = inner.mapInArrow(tidy(run), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("lang").alias("__lang"), F.col("score").alias("__score"), *[F.col("words").alias("__words")] * spans)
