"""Benchmark decontamination: a BM25 index of test items, searched by block-max WAND.

Items are split into question and answer (at the last line break; without one, all is question).
Passages of training texts (windows of two blocks of words, one block apart, a block being longer
than any item) query an inverted index of the items. Impacts are BM25 weights divided by what the
item needs, so an item is above the threshold at a score of 1. What an item needs is the weight of
all its words without those that may be missing while `overlap` of its five-word shingles remain,
so no passage that passes the check is lost by the search. Retrieved items are then checked: the
share of the question's shingles, and of the answer's, that stand in the passage.

The pivot test at the start of a search (can any item reach the threshold by the largest impacts of
the words at hand?) is made for all passages of a batch in numpy, with the words that few items hold
counted exactly and the frequent ones by their upper bound; passages with an item left go on to the
WAND search.

The index is broadcast in shards of at most `shard_items` items, so its size is bounded; with several
shards the texts are searched once for each, one after another, so one index is held at a time. What
BM25 takes from all items (how many there are and hold a word, their mean and largest length) is
counted by Spark over all of them, so scores and passages don't depend on the shards.

Defined cases: a null text or item is empty and matches nothing; items of fewer than five words are
one shingle; equal items are both reported; a repeated row is reported for itself; an empty table of
documents gives no rows, of items no matches; long texts are searched whole; ids may have any type; a
column of the documents with the name of the result is replaced by it, others may have any name.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladle.llm.common import tidy, written

SHINGLE, OVERLAP, SHARD_ITEMS = 5, 0.8, 20_000
K1, B = 1.2, 0.75
BLOCK_ITEMS = 16
WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles(words: list[str], size: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


def parts_of(text: str) -> tuple[list[str], list[str]]:
    """The words of an item's question and of its answer."""
    head, _, tail = text.strip().rpartition("\n")
    question, answer = words_of(head or tail), words_of(tail if head else "")
    return (question, answer) if question else (answer, [])


@dataclass
class Statistics:
    """Of all items: how many have words, the sum and the largest of their lengths, and by word how many hold it."""

    n: int
    total: int
    longest: int
    df: dict[str, int]


def statistics_of(texts: list[str]) -> Statistics:
    bags = [b for b in ([*q, *a] for q, a in map(parts_of, texts)) if b]
    return Statistics(len(bags), sum(map(len, bags)), max(map(len, bags), default=0), Counter(t for b in bags for t in set(b)))


class Index:
    """Postings by term: item numbers ascending and impacts, with the largest impact of each block.
    `of` are the statistics of all items, if these are some of them."""

    def __init__(self, items: list[tuple[object, str]], overlap: float = OVERLAP, shingle: int = SHINGLE, of: Statistics | None = None):
        self.overlap, self.shingle = overlap, shingle
        self.ids, self.question, self.answer = [], [], []
        bags: list[Counter] = []
        sizes = []
        of = of or statistics_of([text for _, text in items])
        for item_id, text in items:
            question, answer = parts_of(text)
            if not question:
                continue
            self.ids.append(item_id)
            self.question.append(shingles(question, shingle))
            self.answer.append(shingles(answer, shingle))
            bags.append(Counter(question + answer))
            sizes.append(len(question) + len(answer))
        n, df = of.n, of.df
        self.block = max(32, of.longest * 5 // 4)
        mean = of.total / n if n else 1
        self.terms = {t: i for i, t in enumerate(sorted({t for bag in bags for t in bag}))}
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for item, bag in enumerate(bags):
            weight = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * sizes[item] / mean)) for t, f in bag.items()}
            missing = 0
            for part in (self.question[item], self.answer[item]):
                m = math.floor((1 - overlap) * len(part) + 1e-9)
                missing += m + min(m, shingle - 1)
            needed = sum(sorted(weight.values(), reverse=True)[missing:]) if missing < len(weight) else 0.0
            needed = max(needed, 1e-9) * (1 - 1e-9)
            for t, w in weight.items():
                postings[self.terms[t]].append((item, w / needed))
        m = len(self.terms)
        self.items = [np.array([i for i, _ in postings[t]], np.int64) for t in range(m)]
        self.impacts = [np.array([w for _, w in postings[t]]) for t in range(m)]
        self.largest = [[float(p[a : a + BLOCK_ITEMS].max()) for a in range(0, len(p), BLOCK_ITEMS)] for p in self.impacts]
        # words that few items hold, as flat postings; the rest by what they can add to an item at most
        n = len(self.ids)
        few = max(4, n // 50)
        self.rare = np.array([len(p) <= few for p in self.items], bool)
        self.start = np.zeros(m + 1, np.int64)
        np.cumsum([len(p) if r else 0 for p, r in zip(self.items, self.rare)], out=self.start[1:])
        held = [t for t in range(m) if self.rare[t]]
        self.flat_items = np.concatenate([self.items[t] for t in held]) if held else np.zeros(0, np.int64)
        self.flat_impacts = np.concatenate([self.impacts[t] for t in held]) if held else np.zeros(0)
        self.rest = np.zeros(n)
        for t in range(m):
            if not self.rare[t]:
                np.add.at(self.rest, self.items[t], self.impacts[t])
        #: items that the frequent words alone can bring over the threshold are looked for in every passage that holds one of their words
        self.open_items = np.flatnonzero(self.rest >= 1)

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """Block-max WAND: every item whose impacts over the terms add up to 1 or more."""
        lists = [[self.items[t].tolist(), self.impacts[t].tolist(), self.largest[t], 0, max(self.largest[t])] for t in terms]
        out = []
        while True:
            lists = [x for x in lists if x[3] < len(x[0])]
            lists.sort(key=lambda x: x[0][x[3]])
            bound, pivot = 0.0, -1
            for k, x in enumerate(lists):
                bound += x[4]
                if bound >= 1:
                    pivot = k
                    break
            if pivot < 0:
                return out
            item = lists[pivot][0][lists[pivot][3]]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][3]] == item:
                pivot += 1
            # the bound from the blocks in which the item would stand
            near, edge = 0.0, len(self.ids)
            for x in lists[: pivot + 1]:
                at = x[3]
                while (at // BLOCK_ITEMS + 1) * BLOCK_ITEMS < len(x[0]) and x[0][(at // BLOCK_ITEMS + 1) * BLOCK_ITEMS - 1] < item:
                    at = (at // BLOCK_ITEMS + 1) * BLOCK_ITEMS
                stop = min((at // BLOCK_ITEMS + 1) * BLOCK_ITEMS, len(x[0]))
                if x[0][stop - 1] >= item:
                    near += x[2][at // BLOCK_ITEMS]
                    edge = min(edge, x[0][stop - 1] + 1)
            if near < 1:  # nothing up to the first block's end can reach it
                skip_to = max(item + 1, min(edge, lists[pivot + 1][0][lists[pivot + 1][3]] if pivot + 1 < len(lists) else edge))
                for x in lists[: pivot + 1]:
                    while x[3] < len(x[0]) and x[0][x[3]] < skip_to:
                        x[3] += 1
                continue
            score = 0.0
            for x in lists[: pivot + 1]:
                while x[3] < len(x[0]) and x[0][x[3]] < item:
                    x[3] += 1
                if x[3] < len(x[0]) and x[0][x[3]] == item:
                    score += x[1][x[3]]
                    x[3] += 1
            if score >= 1:
                out.append((item, score))

    def candidates(self, ids: np.ndarray, window_of: np.ndarray) -> np.ndarray:
        """Windows that may hold an item. ids: the term of each word (-1: none); window_of: the first
        window of each word (it stands in that one and the next)."""
        if len(self.open_items):
            some = np.zeros(len(self.rare), bool)
            for t, p in enumerate(self.items):
                some[t] = bool(np.isin(p, self.open_items).any())
            hit = np.flatnonzero(ids >= 0)
            extra = window_of[hit[some[ids[hit]]]]
        else:
            extra = np.zeros(0, np.int64)
        at = np.flatnonzero(ids >= 0)
        at = at[self.rare[ids[at]]]
        terms, windows = ids[at], window_of[at]
        m = len(self.rare)
        pair = np.unique(np.concatenate((windows, windows + 1)) * m + np.concatenate((terms, terms)))
        windows, terms = pair // m, pair % m
        first, count = self.start[terms], self.start[terms + 1] - self.start[terms]
        flat = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        n = max(1, len(self.ids))
        key, inverse = np.unique(np.repeat(windows, count) * n + self.flat_items[flat], return_inverse=True)
        mass = np.bincount(inverse, self.flat_impacts[flat], len(key))
        return np.unique(np.concatenate(((key // n)[mass + self.rest[key % n] >= 1], extra, extra + 1)))

    def leaks(self, texts: list[str]) -> list[list[dict]]:
        """For each text its items with the best overlap of question and answer, and where they were found."""
        get = self.terms.get
        words = [words_of(t) for t in texts]
        counts = np.array([len(w) for w in words], np.int64)
        total = int(counts.sum())
        ids = np.empty(total, np.int64)
        at = 0
        for w in words:
            ids[at : at + len(w)] = np.fromiter(map(get, w, repeat(-1)), np.int64, len(w))
            at += len(w)
        begin = np.cumsum(counts) - counts
        windows = counts // self.block + 2  # window w holds blocks w-1 and w
        base = np.cumsum(windows) - windows
        within = np.arange(total) - np.repeat(begin, counts)
        window_of = np.repeat(base, counts) + within // self.block
        out: list[list[dict]] = [[] for _ in texts]
        best: dict[tuple[int, int], dict] = {}
        for window in self.candidates(ids, window_of).tolist():
            row = int(np.searchsorted(base, window, "right")) - 1
            block = window - int(base[row])
            lo, hi = max(0, (block - 1) * self.block), min(len(words[row]), (block + 1) * self.block)
            if lo >= hi:
                continue
            first = int(begin[row])
            terms = sorted({t for t in ids[first + lo : first + hi].tolist() if t >= 0})
            found = self.search(terms)
            if not found:
                continue
            here = shingles(words[row][lo:hi], self.shingle)
            part = words[row][lo:hi]
            for item, score in found:
                question = self._share(self.question[item], here, part)
                answer = self._share(self.answer[item], here, part) if self.answer[item] else 1.0
                if min(question, answer) >= self.overlap:
                    leak = {"item_id": self.ids[item], "score": round(score, 9), "question": question, "answer": answer, "word": lo}
                    key = (row, item)
                    if key not in best or (min(question, answer), leak["score"]) > (min(best[key]["question"], best[key]["answer"]), best[key]["score"]):
                        best[key] = leak
        for (row, _), leak in sorted(best.items()):
            out[row].append(leak)
        return out

    def _share(self, wanted: set[tuple[str, ...]], here: set[tuple[str, ...]], words: list[str]) -> float:
        size = len(next(iter(wanted)))
        have = here if size == self.shingle else {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
        return len(wanted & have) / len(wanted)


def _item_words(items: DataFrame) -> DataFrame:
    """item (a row number), word, size: the distinct words of each item that has any, and how many it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                question, answer = parts_of(text)
                out += [(row, w, len(question) + len(answer)) for w in {*question, *answer}]
            row, word, size = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(word, pa.string()), pa.array(size, pa.int64())], ["item", "word", "size"])

    return items.select("row", "text").mapInArrow(tidy(run), "item bigint, word string, size bigint")


def _indexes(items: DataFrame, overlap: float, shard_items: int) -> Iterator[Index]:
    """An index for each shard of the items (item_id, text), one after another."""
    # a shard's items come to the driver together: shard_items or so at most
    shards = max(1, math.ceil(items.count() / shard_items))
    order = ["item_id", "text"]
    if shards == 1:
        rows = items.orderBy(*order).collect()
        yield Index([(r["item_id"], r["text"]) for r in rows], overlap)
        return
    items = written(items.withColumn("row", F.monotonically_increasing_id()).withColumn("shard", F.pmod(F.xxhash64("item_id", "text", "row"), F.lit(shards))))
    words = written(_item_words(items))
    sizes = words.groupBy("item").agg(F.first("size").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.max("size").alias("longest")).first()
    counts = written(words.groupBy("word").agg(F.count(F.lit(1)).alias("df")))
    for shard in range(shards):
        own = items.filter(F.col("shard") == shard)
        df = counts.join(words.join(own.select(F.col("row").alias("item")), "item", "left_semi").select("word").distinct(), "word")
        of = Statistics(sizes["n"], sizes["total"] or 0, sizes["longest"] or 0, {r["word"]: r["df"] for r in df.collect()})
        yield Index([(r["item_id"], r["text"]) for r in own.orderBy(*order).collect()], overlap, of=of)


def _searched(df: DataFrame, items: DataFrame, text_col: str, item_id: str, item_text: str, overlap: float, shard_items: int) -> DataFrame:
    """leaks, and the columns of df as c0, c1 and so on."""
    spark = df.sparkSession
    items = items.select(F.col(f"`{item_id}`").alias("item_id"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("text"))
    leak = f"array<struct<item_id:{items.schema['item_id'].dataType.simpleString()},score:double,question:double,answer:double,word:bigint>>"
    out, at = df.select(F.array().cast(leak).alias("leaks"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]), df.columns.index(text_col) + 1
    kind, shared = out.schema, None
    for index in _indexes(items, overlap, shard_items):
        if shared is not None:  # the passes before this one are done, and their index goes
            out = written(out)
            shared.unpersist()
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], index=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [t or "" for t in batch.column(at).to_pylist()]
                found, start, size = [], 0, 0
                for i, t in enumerate(texts):
                    size += len(t)
                    if size >= 1 << 21 or i + 1 == len(texts):
                        found += index.value.leaks(texts[start : i + 1])
                        start, size = i + 1, 0
                before = batch.column(0)
                if any(found) or before.null_count or len(before.values):
                    before = pa.array([[*a, *b] for a, b in zip(before.to_pylist(), found)], before.type)
                yield pa.RecordBatch.from_arrays([before, *batch.columns[1:]], batch.schema.names)

        out = out.mapInArrow(tidy(run), kind)
    return out


def with_leaks(df: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", overlap: float = OVERLAP, shard_items: int = SHARD_ITEMS, into: str = "__leaks") -> DataFrame:
    """df and a column `into`: array<struct<item_id, score, question, answer, word>>, empty where
    the text holds no test item. Nothing is shuffled."""
    out = _searched(df, items, text_col, item_id, item_text, overlap, shard_items)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns) if c != into], F.col("leaks").alias(into))


def find_leaks(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """A row for each document and test item that it holds: doc_id, item_id, score, question, answer, word
    (where the passage that holds it begins)."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_leaks(docs, items, **more).select("doc_id", F.explode("__leaks").alias("x")).select("doc_id", "x.item_id", "x.score", "x.question", "x.answer", "x.word")


def drop_leaks(df: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", overlap: float = OVERLAP, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """The rows of df that hold no test item."""
    out = _searched(df, items, text_col, item_id, item_text, overlap, shard_items).filter(F.size("leaks") == 0)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)])
