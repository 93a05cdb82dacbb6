"""Ranking of replacements by the value that an operation tree has with one leaf exchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladle.operators.forest import EXCHANGES, TAILS, asked_scores
from ladle.operators.scoring import TREE_GAMMA, TREE_MODELS, deepest


def rank_replacements(nodes: DataFrame, candidates: DataFrame, emb: DataFrame, relations: DataFrame, dim: int, model: str = "TransE", depth: int | None = None, learned: DataFrame | None = None) -> DataFrame:
    """tree, target, cand, score: cosine of the tree's value with the candidate and its value as it
    was (or the learned vector of the tree: tree, own: its id in emb).

    All leaves of a tree that are the target are exchanged; equal children are not merged again after that.
    """
    if model not in TREE_MODELS:
        raise ValueError(f"trees can be evaluated with {', '.join(TREE_MODELS)} only, not {model}")
    no = F.lit(None)
    pairs = candidates.groupBy("tree").agg(F.collect_list(F.struct("target", "cand")).alias("x")).select("tree", F.lit(EXCHANGES).alias("kind"), F.col("x.cand").alias("names"), F.col("x.target").alias("a"), F.col("x.cand").alias("b"))
    tails = (pairs.withColumn("own", no.cast("bigint")) if learned is None else learned).select("tree", F.lit(TAILS).alias("kind"), no.cast("array<bigint>").alias("names"), F.array(F.col("own").cast("bigint")).alias("a"), no.cast("array<bigint>").alias("b"))
    asks = pairs.select("tree", "kind", *[F.col(c).cast("array<bigint>").alias(c) for c in ("names", "a", "b")]).unionByName(tails)
    found = asked_scores(nodes, asks, emb, relations, dim, model, deepest(nodes, depth), TREE_GAMMA, None)
    each = found.select("tree", F.explode(F.arrays_zip("old", "names", "changed")).alias("x"))
    return each.select("tree", F.col("x.old").alias("target"), F.col("x.names").alias("cand"), F.col("x.changed").alias("score")).filter("score is not null")


def target_of(members: DataFrame, group: object = None, item: object = None, seed: int = 0) -> tuple[object, object]:
    """The group and item to find substitutes for. members: grp, item. A group that is not there, or does not hold
    the item, is an error; what is not given is chosen by hash."""
    own = members if group is None else members.filter(F.col("grp") == F.lit(group))
    if item is not None:
        own = own.filter(F.col("item") == F.lit(item))
    found = own.orderBy(F.xxhash64(F.lit(seed), "grp", "item"), "grp", "item").first()
    if found is None:
        raise ValueError(f"no group {'' if group is None else repr(group) + ' '}holds {'anything' if item is None else repr(item)}")
    return found["grp"], found["item"]
