"""Hard negatives by exact search in a multiway tree of split points with distance ranges.

Search is by inner product of integer vectors. With M2 the largest squared norm, each row gets one more
coordinate sqrt(M2 - |x|^2) and an anchor a zero there, so d(a, x)^2 = |a|^2 + M2 - 2 a.x is a distance and a
window of inner products is an annulus around the anchor.

The tree: `SAMPLE` rows (the smallest hashes of ids) give the split points, `FAN` for the root and `FAN`
for each of its parts, chosen one after another as the sampled row farthest from those before. A row belongs to
the nearest split point at both levels (a hyperplane between any two). Over all rows, each split point
keeps the least and the largest distance to the rows of every sibling's subtree; these ranges
are of stated size (FAN * FAN of the root and FAN^3 of the parts) whatever the number of rows. For an anchor at
distance d of a split point whose distances to a subtree lie in [lo, hi], rows of that subtree are at
distances between max(lo - d, d - hi) and d + hi; a subtree whose interval, cut over all split points,
misses the annulus is left out. What is left is compared in its leaves, exactly.

Rows are dealt into blocks of whole leaves (large leaves into several blocks), anchors into chunks, and each
block meets each chunk in one task: rows come leaf by leaf, the best found so far narrow the annulus, and a task
holds one chunk and a few thousand rows at a time. Block and chunk sizes only set how the work is split. First the
best rows of the anchor's own label are found, then for each of them the best of other labels in its window.

Defined cases: rows with a null label, null vector, null or non-finite component take no part, nor does
a row whose squared norm in whole numbers reaches 2^62 (its products don't fit a long); shorter
vectors count as filled up with zeros; a null id takes part as a negative or positive after all other ids of its
score, and never as an anchor; rows of one id are rows of their own (only the anchor's own row is left out); an
anchor without positives gives no rows, nor does an empty table; ties go by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladle.llm.common import list_array, tidy, written

FAN = 16
SAMPLE = 4096
BLOCK_ROWS = 131072
CHUNK_ANCHORS = 4096
BATCH_ROWS = 1024
SCALE = 256
SLACK = 1e-6  # of the largest squared norm: bounds come from rounded distances
NO_ID = np.iinfo(np.int64).max


def whole_numbers(df: DataFrame, id_col: str, vec_col: str, label: Column) -> DataFrame:
    """id, row, label, v (int array), n2 (its squared norm): the rows that take part, written down."""
    v = F.transform(vec_col, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    size = F.aggregate(vec_col, F.lit(0.0), lambda s, x: s + F.pow(F.floor(x.cast("double") * SCALE).cast("double"), F.lit(2.0)))
    part = df.filter(label.isNotNull() & F.col(vec_col).isNotNull()).filter(fine).filter(size < 2.0**62)
    return written(part.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), label.cast("long").alias("label"), v.alias("v"), size.alias("n2")))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as rows of `dim` numbers; missing ones are 0."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), flat.dtype)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def farthest(points: np.ndarray, k: int) -> np.ndarray:
    """Up to k distinct rows, each the farthest from those before."""
    chosen = [0]
    gap = ((points - points[0]) ** 2).sum(1)
    while len(chosen) < k and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


@dataclass
class Tree:
    """Split points with their extra coordinate; leaf = part of the root * FAN + part below."""

    dim: int
    m2: float
    root: np.ndarray
    parts: list[np.ndarray]
    ranges: np.ndarray | None = None  # leaf, split point (root ones, then those of its part), (lo, hi)

    def lifted(self, v: np.ndarray, n2: np.ndarray) -> np.ndarray:
        return np.column_stack([v, np.sqrt(np.maximum(self.m2 - n2, 0.0))])

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of each lifted row, and its distances to the FAN root points and the FAN points of its part."""
        top = distances(x, self.root)
        part = top.argmin(1)
        out, below = np.zeros(len(x), np.int64), np.full((len(x), FAN), np.nan)
        for p in np.unique(part):
            at = np.flatnonzero(part == p)
            d = distances(x[at], self.parts[p])
            below[at, : d.shape[1]] = d
            out[at] = p * FAN + d.argmin(1)
        wide = np.full((len(x), FAN), np.nan)
        wide[:, : top.shape[1]] = top
        return out, np.hstack([wide, below])

    def place(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return self.leaves(self.lifted(matrix(b["v"], self.dim).astype(float), b["n2"].to_numpy()))

    def reach(self, a: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest squared distance that rows of a leaf can have from each anchor."""
        points = np.vstack([self.root, self.parts[leaf // FAN]])
        r = self.ranges[leaf]
        r = np.vstack([r[: len(self.root)], r[FAN : FAN + len(self.parts[leaf // FAN])]])
        d = distances(a, points)
        near = np.maximum(r[:, 0] - d, d - r[:, 1]).max(1)
        far = (d + r[:, 1]).min(1)
        return np.maximum(near, 0.0) ** 2, far**2


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    d2 = (x * x).sum(1)[:, None] + (points * points).sum(1) - 2 * (x @ points.T)
    return np.sqrt(np.maximum(d2, 0.0))


def grow(rows: DataFrame, dim: int, m2: float) -> Tree:
    """Split points from `SAMPLE` rows by hash of the row's id (stated bound; every row is indexed after)."""
    sample = rows.select("v", "n2", "row", F.xxhash64("id").alias("h")).orderBy("h", "row").limit(SAMPLE).select("v", "n2").collect()
    tree = Tree(dim, m2, np.zeros((0, dim + 1)), [])
    v = np.zeros((len(sample), dim))
    for i, r in enumerate(sample):
        v[i, : len(r.v)] = r.v
    x = tree.lifted(v, np.array([r.n2 for r in sample]))
    tree.root = farthest(x, FAN)
    part = distances(x, tree.root).argmin(1)
    tree.parts = [farthest(x[part == p], FAN) for p in range(len(tree.root))]
    return tree


def with_leaves(rows: DataFrame, tree: Tree) -> DataFrame:
    """rows with the leaf that each belongs to."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf, _ = shared.value.place(b)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], [*b.schema.names, "leaf"])

    return rows.mapInArrow(tidy(run), "id long, row long, label long, v array<int>, n2 double, leaf long")


def leaf_ranges(placed: DataFrame, tree: Tree) -> DataFrame:
    """leaf, point, n, lo, hi: rows of a leaf and their distances to each split point on its way."""
    shared = placed.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, lo, hi = np.zeros(FAN * FAN, np.int64), np.full((FAN * FAN, 2 * FAN), np.inf), np.full((FAN * FAN, 2 * FAN), -np.inf)
        for b in batches:
            leaf, d = shared.value.place(b)
            np.add.at(n, leaf, 1)
            np.fmin.at(lo, leaf, d)
            np.fmax.at(hi, leaf, d)
        i, j = np.nonzero(lo <= hi)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(n[i]), pa.array(lo[i, j]), pa.array(hi[i, j])], ["leaf", "point", "n", "lo", "hi"])

    parts = placed.mapInArrow(tidy(run), "leaf long, point long, n long, lo double, hi double")
    return parts.groupBy("leaf", "point").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def index(rows: DataFrame, dim: int, m2: float) -> tuple[DataFrame, Tree, dict[int, int]]:
    """The rows with their leaf, the tree with its ranges over all of them, and the rows of each leaf."""
    tree = grow(rows, dim, m2)
    placed = written(with_leaves(rows, tree))
    ranges, sizes = np.zeros((FAN * FAN, 2 * FAN, 2)), {}
    for r in leaf_ranges(placed, tree).collect():  # at most 2 * FAN^3 rows
        sizes[r.leaf], ranges[r.leaf, r.point] = r.n, (r.lo, r.hi)
    tree.ranges = ranges
    return placed, tree, sizes


def dealt(sizes: dict[int, int]) -> tuple[list[tuple[int, int, int]], int]:
    """(leaf, first block, blocks of it) and the number of blocks: whole leaves together, large ones split."""
    most = min(BLOCK_ROWS, max(512, -(-sum(sizes.values()) // 64)))
    out, block, room = [], -1, 0
    for leaf, n in sorted(sizes.items()):
        if n > room:
            block, room = block + 1, most
        parts = max(1, -(-n // most))
        out.append((leaf, block, parts))
        if parts > 1:
            block, room = block + parts - 1, 0
        else:
            room -= n
    return out, block + 1


class Best:
    """The `keep` best (score, id, row) of each of a number of slots, best first."""

    def __init__(self, slots: int, keep: int):
        self.score = np.full((slots, keep), np.iinfo(np.int64).min)
        self.id, self.row = np.full((slots, keep), NO_ID), np.full((slots, keep), -1)

    def add(self, slots: np.ndarray, score: np.ndarray, ok: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """score, ok: slot by row. Only scores that can enter are sorted."""
        ok = ok & (score >= self.score[slots, -1][:, None])
        i, j = np.nonzero(ok)
        if not len(i):
            return
        hit = np.unique(i)
        keep = self.score.shape[1]
        s = np.concatenate([np.repeat(slots[hit], keep), slots[i]])
        sc = np.concatenate([self.score[slots[hit]].ravel(), score[i, j]])
        d = np.concatenate([self.id[slots[hit]].ravel(), ids[j]])
        r = np.concatenate([self.row[slots[hit]].ravel(), rows[j]])
        order = np.lexsort((r, d, -sc, r < 0, s))
        s, sc, d, r = s[order], sc[order], d[order], r[order]
        place = np.arange(len(s)) - np.searchsorted(s, s)
        good = place < keep
        s, place = s[good], place[good]
        self.score[s, place], self.id[s, place], self.row[s, place] = sc[good], d[good], r[good]


def products(a: np.ndarray, v: np.ndarray, m2: float) -> np.ndarray:
    """Exact inner products: in double precision where no partial sum can reach 2^53."""
    if m2 < 2.0**53:
        return (a.astype(float) @ v.astype(float).T).astype(np.int64)
    return a.astype(np.int64) @ v.astype(np.int64).T


def search(placed: DataFrame, anchors: DataFrame, tree: Tree, sizes: dict[int, int], keep: int, same: bool) -> DataFrame:
    """slot, score, id, row: the best `keep` rows of each slot within each block.

    anchors: row, id, label, v, n2, slots: array<struct<slot, lo, hi>> (windows of the score). same: rows of the anchor's
    label without its own row, else rows of other labels.
    """
    deal, blocks = dealt(sizes)
    spark = placed.sparkSession
    chunks = max(1, -(-anchors.count() // CHUNK_ANCHORS))
    leaf_block = F.create_map(*[x for leaf, block, parts in deal for x in (F.lit(leaf), F.struct(F.lit(block).alias("first"), F.lit(parts).alias("parts")))])
    own = F.element_at(leaf_block, F.col("leaf"))
    slots = "array<struct<slot:long,lo:long,hi:long>>"
    each_chunk = F.sequence(F.lit(0), F.lit(chunks - 1))
    many = placed.withColumn("at", own).select(
        (F.col("at.first") + F.pmod(F.xxhash64("row"), F.col("at.parts"))).cast("int").alias("block"), F.explode(each_chunk).alias("chunk"), "leaf", "row", "id", "label", "v", "n2", F.lit(None).cast(slots).alias("slots")
    )
    few = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int").alias("chunk"), F.lit(-1).cast("long").alias("leaf"), "row", "id", "label", "v", "n2", F.col("slots").cast(slots).alias("slots"))
    # a partition for each block and chunk: the keys are numbers from 0, dealt by range
    cell = F.col("block") * chunks + F.col("chunk")
    cells = many.unionByName(few).withColumn("cell", cell).repartition(min(blocks * chunks, 20000), "cell").sortWithinPartitions("cell", "leaf", "row")
    shared = spark.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, state = shared.value, None
        for b in batches:
            for part in runs_of(b):
                now = part["cell"][0].as_py()
                if state is None or state.cell != now:
                    if state is not None:
                        yield from state.results()
                    state = Cell(now, t, keep, same)
                state.take(part)
        if state is not None:
            yield from state.results()

    return cells.select("cell", "leaf", "row", "id", "label", "v", "n2", "slots").mapInArrow(tidy(run), "slot long, score long, id long, row long")


def runs_of(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of one cell and leaf, of `BATCH_ROWS` rows at most."""
    cell, leaf = b["cell"].to_numpy(), b["leaf"].to_numpy()
    cuts = [0, *(np.flatnonzero((np.diff(cell) != 0) | (np.diff(leaf) != 0)) + 1).tolist(), b.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        for at in range(lo, hi, BATCH_ROWS):
            yield b.slice(at, min(BATCH_ROWS, hi - at))


class Cell:
    """One chunk of anchors against one block of rows, leaf by leaf."""

    def __init__(self, cell: int, tree: Tree, keep: int, same: bool):
        self.cell, self.tree, self.keep, self.same = cell, tree, keep, same
        self.parts: list[pa.RecordBatch] = []
        self.best: Best | None = None
        self.leaf = -1

    def start(self) -> None:
        c = pa.Table.from_batches(self.parts).combine_chunks()
        s = c["slots"].combine_chunks()
        self.v, self.rows, self.labels = matrix(c["v"].combine_chunks(), self.tree.dim), c["row"].to_numpy(), c["label"].to_numpy()
        n2 = c["n2"].to_numpy()
        self.lifted, self.reach0 = np.column_stack([self.v.astype(float), np.zeros(len(self.v))]), n2 + self.tree.m2
        self.of = np.repeat(np.arange(c.num_rows), s.value_lengths().to_numpy())
        flat = s.flatten()
        self.slot, self.lo, self.hi = (flat.field(k).to_numpy() for k in ("slot", "lo", "hi"))
        self.best = Best(len(self.slot), self.keep)

    def take(self, b: pa.RecordBatch) -> None:
        leaf = b["leaf"][0].as_py()
        if leaf < 0:
            self.parts.append(b)
            return
        if not self.parts:
            return
        if self.best is None:
            self.start()
        if leaf != self.leaf:
            self.leaf = leaf
            near, far = self.tree.reach(self.lifted, leaf)
            self.most, self.least = (self.reach0 - near) / 2, (self.reach0 - far) / 2
        most, least = self.most[self.of], self.least[self.of]
        slack = SLACK * self.tree.m2 + 1e-3
        open_ = np.flatnonzero((most + slack >= np.maximum(self.lo, self.best.score[:, -1])) & (least - slack <= self.hi))
        if not len(open_):
            return
        who, back = np.unique(self.of[open_], return_inverse=True)
        score = products(self.v[who], matrix(b["v"], self.tree.dim), self.tree.m2)
        label, rows = b["label"].to_numpy(), b["row"].to_numpy()
        alike = self.labels[who][:, None] == label
        ok = (alike & (self.rows[who][:, None] != rows)) if self.same else ~alike
        ids = b["id"].fill_null(NO_ID).to_numpy()
        for at in range(0, len(open_), 1024):
            o, k = open_[at : at + 1024], back[at : at + 1024]
            sc = score[k]
            self.best.add(o, sc, ok[k] & (sc >= self.lo[o][:, None]) & (sc <= self.hi[o][:, None]), ids, rows)

    def results(self) -> Iterator[pa.RecordBatch]:
        if self.best is None:
            return
        i, j = np.nonzero(self.best.row >= 0)
        ids = self.best.id[i, j]
        yield pa.RecordBatch.from_arrays([pa.array(self.slot[i]), pa.array(self.best.score[i, j]), pa.array(ids, mask=ids == NO_ID), pa.array(self.best.row[i, j])], ["slot", "score", "id", "row"])


def first_of(found: DataFrame, keep: int) -> DataFrame:
    """slot, rank, score, id, row: the best `keep` of each slot over all blocks."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def mine(df: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vec_col: str = "embedding", positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor: over `id`. window: the percentages of the positive's score between which a negative's lies.
    """
    spark = df.sparkSession
    rows = whole_numbers(df, id_col, vec_col, label)
    size = rows.agg(F.max("n2").alias("m2"), F.max(F.size("v")).alias("dim")).first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if size.m2 is None:
        return spark.createDataFrame([], out)
    placed, tree, sizes = index(rows, size.dim, float(size.m2))
    anchors = placed.filter(F.col("id").isNotNull() & is_anchor).select("row", "id", "label", "v", "n2")
    low, high = -(2**63), 2**63 - 1
    whole = F.array(F.struct(F.col("row").alias("slot"), F.lit(low).cast("long").alias("lo"), F.lit(high).cast("long").alias("hi")))
    found = written(first_of(search(placed, anchors.withColumn("slots", whole), tree, sizes, positives, True), positives))
    # floors of quotients: 100 s >= 30 p where s >= ceil(30 p / 100), 100 s <= 90 p where s <= floor(90 p / 100)
    p = F.col("score")
    lo, hi = F.ceil(p.cast("decimal(38,0)") * window[0] / 100).cast("long"), F.floor(p.cast("decimal(38,0)") * window[1] / 100).cast("long")
    slots = found.select(F.col("slot").alias("row"), F.struct((F.col("slot") * positives + F.col("rank") - 1).alias("slot"), lo.alias("lo"), hi.alias("hi")).alias("w")).filter("w.lo <= w.hi").groupBy("row").agg(F.array_sort(F.collect_list("w")).alias("slots"))
    asked = written(anchors.join(slots, "row"))
    hard = first_of(search(placed, asked, tree, sizes, negatives, False), negatives)
    pairs = found.join(anchors.select(F.col("row").alias("slot"), F.col("id").alias("anchor_id")), "slot").select((F.col("slot") * positives + F.col("rank") - 1).alias("slot"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(pairs, "slot").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
