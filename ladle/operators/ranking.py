"""Filtered ranks of test triples among all entities, without a row for each candidate.

Blocks of test triples meet blocks of entities; a task counts, for each of its triples, how many of its entities score above
the true tail, and only these counts leave it. True tails that score above are taken off after: all known triples of the
asked (head, relation) are scored once, and a running count by score says how many stand above a test triple. All scores come
from the same sums in the same order, so equal vectors tie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladle.operators.scoring import MODELS, embedding_range
from ladle.session import stored

BLOCK = 16384  # rows of a block of triples or of entities
SLICE = 512


def scores(model: str, h: np.ndarray, r: np.ndarray, t: np.ndarray, gamma: float) -> np.ndarray:
    """Scores of vectors along the last axis; the other axes are broadcast. One component after the other, so that a block
    and a single row add up alike."""
    dim = h.shape[-1]
    half = dim // 2
    x = np.zeros(np.broadcast_shapes(h.shape[:-1], t.shape[:-1]))
    if model == "TransE":
        for j in range(dim):
            x += np.abs(h[..., j] + r[..., j] - t[..., j])
        return gamma - x
    if model == "DistMult":
        for j in range(dim):
            x += h[..., j] * r[..., j] * t[..., j]
        return x
    if model == "ComplEx":
        for j in range(half):
            a, b, c, d = h[..., j], h[..., j + half], r[..., j], r[..., j + half]
            x += (a * c - b * d) * t[..., j] + (a * d + b * c) * t[..., j + half]
        return x
    if model == "RotatE":
        scale = math.pi / embedding_range(gamma, half)
        for j in range(half):
            a, b, cos, sin = h[..., j], h[..., j + half], np.cos(r[..., j] * scale), np.sin(r[..., j] * scale)
            re, im = a * cos - b * sin - t[..., j], a * sin + b * cos - t[..., j + half]
            x += np.sqrt(re * re + im * im)
        return gamma - x
    if model == "pRotatE":
        scale = math.pi / embedding_range(gamma, dim)
        for j in range(dim):
            x += np.abs(np.sin(h[..., j] * scale + r[..., j] * scale - t[..., j] * scale))
        return gamma - x * (0.5 * embedding_range(gamma, dim))
    raise ValueError(f"model {model} is not supported")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def scored(triples: DataFrame, entities: DataFrame, relations: DataFrame, model: str, gamma: float, digits: int | None) -> DataFrame:
    """h, r, t, hv, rv, own: triples with the vectors of head and relation and their score. Triples without vectors drop out."""
    v = lambda df, id_, vec: df.select(F.col("id").alias(id_), F.col("vec").cast("array<double>").alias(vec))
    whole = triples.select("h", "r", "t").distinct().join(v(entities, "h", "hv"), "h").join(v(relations, "r", "rv"), "r").join(v(entities, "t", "tv"), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own = _rounded(scores(model, _matrix(b["hv"]), _matrix(b["rv"]), _matrix(b["tv"]), gamma), digits)
                yield pa.RecordBatch.from_arrays([b["h"], b["r"], b["t"], b["hv"], b["rv"], pa.array(own)], ["h", "r", "t", "hv", "rv", "own"])

    return whole.select("h", "r", "t", "hv", "rv", "tv").mapInArrow(run, "h long, r long, t long, hv array<double>, rv array<double>, own double")


def _rounded(x: np.ndarray, digits: int | None) -> np.ndarray:
    return x if digits is None else np.round(x, digits)


def counted_above(asked: DataFrame, entities: DataFrame, model: str, gamma: float, digits: int | None, block: int = BLOCK) -> DataFrame:
    """h, r, t, above: how many entities score above each asked triple. asked: see `scored`; entities: id, vec."""
    rows = lambda n: min(block, max(SLICE, -(-n // 16)))
    n_asked, n_entities = max(1, asked.count()), max(1, entities.count())
    qs, es = -(-n_asked // rows(n_asked)), -(-n_entities // rows(n_entities))
    left = asked.withColumn("q", F.pmod(F.xxhash64("h", "r", "t"), F.lit(qs))).withColumn("e", F.explode(F.sequence(F.lit(0), F.lit(es - 1)).cast("array<bigint>")))
    right = entities.select(F.col("vec").cast("array<double>").alias("vec"), F.pmod(F.xxhash64("id"), F.lit(es)).alias("e"), F.explode(F.sequence(F.lit(0), F.lit(qs - 1)).cast("array<bigint>")).alias("q"))

    def count(a: pa.Table, b: pa.Table) -> pa.Table:
        above = np.zeros(a.num_rows, np.int64)
        if a.num_rows and b.num_rows:
            h, r, own, e = _matrix(a["hv"]), _matrix(a["rv"]), a["own"].to_numpy(), _matrix(b["vec"])
            for i in range(0, len(h), SLICE):
                for j in range(0, len(e), SLICE):
                    s = _rounded(scores(model, h[i : i + SLICE, None], r[i : i + SLICE, None], e[None, j : j + SLICE], gamma), digits)
                    above[i : i + SLICE] += (s > own[i : i + SLICE, None]).sum(1)
        return pa.table({"h": a["h"], "r": a["r"], "t": a["t"], "above": pa.array(above)})

    cells = left.groupBy("q", "e").cogroup(right.groupBy("q", "e")).applyInArrow(count, "h long, r long, t long, above long")
    return cells.groupBy("h", "r", "t").agg(F.sum("above").alias("above"))


def filtered_ranks(test: DataFrame, known: DataFrame, entities: DataFrame, candidates: DataFrame, relations: DataFrame, model: str, gamma: float, digits: int | None = None, block: int = BLOCK) -> DataFrame:
    """h, r, t, rank: 1 + how many candidates other than known true tails score above the test triple's tail.

    test, known: h, r, t; entities, relations: id, vec; candidates: id (each once) of the entities that count.
    """
    if model not in MODELS:
        raise ValueError(f"model {model} is not supported")
    asked = stored(scored(test, entities, relations, model, gamma, digits))
    held = entities.join(candidates.select("id").distinct(), "id", "left_semi")
    above = counted_above(asked, held, model, gamma, digits, block)
    true = known.join(test.select("h", "r").distinct(), ["h", "r"], "left_semi").join(candidates.select(F.col("id").alias("t")).distinct(), "t", "left_semi")
    marks = scored(true, entities, relations, model, gamma, digits).select("h", "r", F.lit(None).cast("bigint").alias("t"), "own", F.lit(1).alias("mark"))
    both = marks.unionByName(asked.select("h", "r", "t", "own", F.lit(0).alias("mark")))
    higher = Window.partitionBy("h", "r").orderBy(F.desc("own"), "mark").rowsBetween(Window.unboundedPreceding, 0)
    taken = both.withColumn("n", F.sum("mark").over(higher)).filter("mark = 0").select("h", "r", "t", "n")
    return above.join(taken, ["h", "r", "t"]).select("h", "r", "t", (1 + F.col("above") - F.col("n")).alias("rank"))
