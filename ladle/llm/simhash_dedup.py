"""SimHash near-duplicates, linked through BK-trees.

A fingerprint has 64 bits, each set where over half of the XXH64 hashes (seed 42) of the text's word
shingles have it. Two fingerprints with at most `radius` differing bits agree in at least two of
radius + 2 blocks of bits, so each fingerprint goes to one shard for every pair of blocks. A shard's
fingerprints form a BK-tree: a child hangs under the edge numbered by its Hamming distance to the
parent, and a search follows only the edges within the radius. A shard returns a spanning forest of
its links, components of which are joined over all shards by Spark jobs.

`keep_one` groups texts by the similarity of their five-word shingles instead. The trees link what has
fingerprints within the radius. Fingerprints of similar texts may differ in more bits than any exact
search covers; those, and only those, are linked by an exact set-similarity join (`shingle_join`). All
links are verified.

The trees of all shards grow with the input, so they are not broadcast: each is built in the task
that the shuffle brings its shard's distinct fingerprints to. Equal fingerprints are one node.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; a text of
fewer words than a shingle is one shingle; rows with one id are rows of their own with that id; a
null id is smaller than any other, so a component that holds one has component_id null; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladle.llm.common import keyed_text, tidy
from ladle.llm.components import components
from ladle.llm.shingle_join import READ_ROWS, SIMILARITY, candidate_links, family_cells, set_print, shingle_hashes, verified_links
from ladle.session import ensure_checkpoint_dir

RADIUS, SHINGLE, SEED = 4, 4, 42


def simhash(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as an unsigned number."""
    words = text.encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.zeros_like(ends)
        starts[1:] = ends[:-1]
        count = len(words) - shingle + 1
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[:count].tolist(), (ends[shingle - 1 :] - 1).tolist())]
    total = len(hashes)
    ones = np.zeros(64, np.int64)
    for at in range(0, total, 65536):  # bounds the unpacked bits of a very long text
        part = np.array(hashes[at : at + 65536], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), th (hash of the whole text) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([simhash(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64)), batch.column(2)], ["doc_id", "fp", "th"])

    docs = keyed_text(df, id_col, text_col).withColumn("th", F.xxhash64("text"))
    return docs.mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint, th bigint")


class LinkedTree:
    """A BK-tree over integers that joins what lies within the radius into components.

    `whole[i]` is a component that holds the whole subtree of i, or -1 where there are several: a
    subtree that the searched value is joined with already needs no second visit, which keeps dense
    clusters from being compared pair by pair.
    """

    def __init__(self, radius: int):
        self.radius = radius
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.parent: list[int] = []
        self.whole: list[int] = []

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def add(self, value: int) -> list[int]:
        """Insert a value; returns values that it joins, one for each component at most."""
        me = len(self.values)
        self.values.append(value)
        self.children.append({})
        self.parent.append(me)
        self.whole.append(me)
        joined = []
        if me == 0:
            return joined
        values, children, radius, find = self.values, self.children, self.radius, self.find
        stack = [0]
        seen = []
        while stack:
            node = stack.pop()
            if self.whole[node] >= 0 and find(self.whole[node]) == find(me):
                continue
            seen.append(node)
            d = (values[node] ^ value).bit_count()
            if d <= radius and find(node) != find(me):
                self.parent[find(me)] = find(node)
                joined.append(values[node])
            for edge, child in children[node].items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)
        for node in reversed(seen):
            if joined and self.whole[node] < 0:
                root = find(node)
                if all(self.whole[c] >= 0 and find(self.whole[c]) == root for c in children[node].values()):
                    self.whole[node] = root
        node = 0
        while True:
            if self.whole[node] >= 0 and find(self.whole[node]) != find(me):
                self.whole[node] = -1
            d = (values[node] ^ value).bit_count()
            child = children[node].get(d)
            if child is None:
                children[node][d] = me
                return joined
            node = child


def shard_links(df: DataFrame, radius: int = RADIUS) -> DataFrame:
    """u, v: links between distinct fingerprints `fp` that join all that lie within the radius."""
    blocks = radius + 2
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [F.shiftrightunsigned("fp", edges[i]).bitwiseAND((1 << (edges[i + 1] - edges[i])) - 1) for i in range(blocks)]
    width = 64 // blocks + 1
    keys = [F.lit(k << (2 * width)).cast("long") + F.shiftleft(parts[i], width) + parts[j] for k, (i, j) in enumerate(combinations(range(blocks), 2))]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = df.select("fp", F.explode(F.array(*keys)).alias("shard")).repartition(n, "shard").sortWithinPartitions("shard", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_shard, tree, first = None, None, 0
        for batch in batches:
            shard = batch.column(1).to_numpy()
            fps = batch.column(0).to_numpy().view(np.uint64)
            at = np.flatnonzero(np.diff(shard)) + 1
            starts, stops = [0, *at.tolist()], [*at.tolist(), len(shard)]
            u, v = [], []
            for a, b in zip(starts, stops):
                key = int(shard[a])
                group = fps[a:b].tolist()
                if key != open_shard:
                    open_shard, tree, first = key, None, group[0]
                    group = group[1:]
                if tree is None and group:
                    tree = LinkedTree(radius)
                    tree.add(first)
                for x in group:
                    for y in tree.add(x):
                        u.append(x)
                        v.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(u, np.uint64).view(np.int64)), pa.array(np.array(v, np.uint64).view(np.int64))], ["u", "v"])

    return shards.mapInArrow(tidy(run), "u bigint, v bigint")


def _least(id_col: str = "doc_id"):
    """The smallest id, null before all others."""
    return F.min(F.struct(F.col(id_col).isNotNull().alias("known"), F.col(id_col).alias("id")))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id (the smallest id reachable over links) for each row."""
    ensure_checkpoint_dir(df.sparkSession)
    prints = fingerprint_documents(df, id_col, text_col, shingle).checkpoint()
    nodes = prints.groupBy("fp").agg(_least().alias("least"))
    roots = components(shard_links(nodes.select("fp"), radius))
    labelled = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = labelled.groupBy("root").agg(F.min("least").alias("smallest"))
    component = labelled.join(least, "root").select("fp", F.col("smallest.id").alias("component_id"))
    return prints.join(component, "fp").select("doc_id", "fp", "component_id")


def fingerprint_shingles(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, th, fp, size for each row of docs (key, th, text): the fingerprint over the distinct
    five-word shingles, and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sizes = [], []
            for a in range(0, batch.num_rows, READ_ROWS):
                for text in batch.column(2).slice(a, READ_ROWS).to_pylist():
                    hashes = shingle_hashes(text)
                    prints.append(set_print(hashes))
                    sizes.append(len(hashes))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(prints, np.int64)), pa.array(np.array(sizes, np.int64))], ["doc_id", "th", "fp", "size"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), "th", "text").mapInArrow(tidy(run), f"doc_id {kind}, th bigint, fp bigint, size bigint")


def _id_text(id_col: str):
    """An id as text that is never null, so that rows of null ids meet in plain joins."""
    return F.to_json(F.struct(F.col(id_col).alias("id")))


def _grouped(docs: DataFrame, key: str, radius: int, similarity: float) -> DataFrame:
    """th, least, head for each distinct text of docs (key, id_text, th, text and others): its smallest id, and a
    text that stands for its group.

    Links of the BK-trees, which hold every pair of fingerprints within the radius, and those of
    `candidate_links`, which hold all others that may have the similarity, make families; within these, pairs of
    texts whose shingle sets have the similarity make groups. Equal texts count once. A family is verified in
    cells of bounded size.
    """
    prints = fingerprint_shingles(docs, key).checkpoint()
    texts = prints.groupBy("th").agg(F.first("fp").alias("fp"), F.first("size").alias("size"), _least().alias("least")).checkpoint()
    near = shard_links(texts.select("fp").distinct(), radius)
    linked = components(near.unionByName(candidate_links(docs, radius, similarity))).select(F.col("node").alias("fp"), "root")
    # texts of one fingerprint are a family, if it has no links
    several = texts.groupBy("fp").count().filter("count > 1").select("fp").join(linked, "fp", "left_anti")
    families = linked.unionByName(several.select("fp", F.col("fp").alias("root")))
    members = texts.join(families, "fp").select("th", "size", "root", _id_text("least.id").alias("id_text"))
    cells = family_cells(members).select("id_text", "th", "cells")
    # all columns go along, so that the shuffle of docs is the one that the caller's join can use again
    read = docs.join(cells, ["id_text", "th"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, READ_ROWS):
                part = batch.slice(a, READ_ROWS)
                hashes = [shingle_hashes(x).tobytes() for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("th"), pa.array(hashes, pa.binary()), part.column("cells")], ["th", "hashes", "cells"])

    hashed = read.select("th", "text", "cells", *[c for c in docs.columns if c not in ("th", "text")]).mapInArrow(tidy(sets), "th bigint, hashes binary, cells array<struct<cell:bigint,side:int>>")
    linked = verified_links(hashed.select("th", "hashes", F.explode("cells").alias("c")).select("c.cell", "c.side", "th", "hashes"), similarity)
    groups = components(linked)
    return texts.join(groups, texts["th"] == groups["node"], "left").select("th", "least", F.coalesce("root", "th").alias("head"))


def _smallest(groups: DataFrame) -> DataFrame:
    """head, group_id, group_th: the smallest id of each group, and the text that has it (of several
    with that id the one of the smallest hash)."""
    return groups.groupBy("head").agg(F.min(F.struct("least", "th")).alias("x")).select("head", F.col("x.least.id").alias("group_id"), F.col("x.th").alias("group_th"))


def verified_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, th (hash of the text), group_id (smallest id of the group) for each row."""
    ensure_checkpoint_dir(df.sparkSession)
    docs = keyed_text(df, id_col, text_col).withColumn("th", F.xxhash64("text")).withColumn("id_text", _id_text("doc_id"))
    groups = _grouped(docs, "doc_id", radius, similarity)
    named = groups.join(_smallest(groups), "head").select("th", "group_id")
    return docs.select("doc_id", "th").join(named, "th")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of df that stand for their group: the row of its smallest id, once. Of rows with equal
    id and text the one whose other columns come first as JSON stays. The texts are shuffled once."""
    ensure_checkpoint_dir(df.sparkSession)
    names = {c: f"c{i}" for i, c in enumerate(df.columns) if c != text_col}
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    docs = df.select(F.xxhash64(text).alias("th"), text.alias("text"), F.col(f"`{text_col}`").isNull().alias("no_text"), *[F.col(f"`{c}`").alias(a) for c, a in names.items()])
    key = names[id_col]
    docs = docs.withColumn("id_text", _id_text(key))
    kept = _smallest(_grouped(docs, key, radius, similarity)).select(_id_text("group_id").alias("id_text"), F.col("group_th").alias("th"))
    rows = docs.join(kept, ["id_text", "th"], "left_semi")
    others = [c for c in rows.columns if c not in ("id_text", "th", "text")]
    rows = rows.groupBy("id_text", "th").agg(F.first("text").alias("text"), F.min_by(F.struct(*others), F.to_json(F.struct(*others))).alias("x")).select("text", *[F.col(f"x.{c}").alias(c) for c in others])
    return rows.select(*[F.when(~F.col("no_text"), F.col("text")).alias(c) if c == text_col else F.col(names[c]).alias(c) for c in df.columns])
