"""Trees in blocks: exchanges against trees evaluated anew, and plans that shuffle no vectors."""

import pytest
from pyspark.sql import functions as F

from ladle import registry
from ladle.operators import forest
from ladle.operators import scoring as M
from ladle.operators.substitute import rank_replacements

SCHEMA = "tree string, node string, parent string, depth int, rel long, leaf long"
# two trees: one with a leaf in two places, an unknown leaf and an action without known inputs; one that is a leaf
NODES = [("a", "r", None, 0, 0, None), ("a", "x", "r", 1, 1, None), ("a", "l1", "r", 1, None, 2), ("a", "l2", "x", 2, None, 2), ("a", "l3", "x", 2, None, 3), ("a", "l4", "x", 2, None, 99), ("a", "y", "r", 1, 1, None), ("a", "l5", "y", 2, None, 98), ("b", "r", None, 0, None, 1)]
VECTORS = [(i, [((7 * i + 3 * j) % 11 - 5) / 4 for j in range(4)]) for i in range(5)]


def frames(spark, dim):
    return spark.createDataFrame(NODES, SCHEMA), spark.createDataFrame(VECTORS, "id long, vec array<double>"), spark.createDataFrame([(0, [0.5, -1.0, 0.25, 2.0][:dim]), (1, [1.0, 0.5, -0.5, 1.5][:dim])], "id long, vec array<double>")


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("model", ["TransE", "DistMult", "RotatE"])
def test_exchanges(spark, model, whole, monkeypatch):
    monkeypatch.setattr(forest, "WHOLE", 1 << 16 if whole else 0)
    nodes, emb, rel = frames(spark, 2 if model == "RotatE" else 4)
    value = lambda n: {r.tree: r.value for r in M.evaluate_trees(n, emb, rel, 4, model).collect()}
    base, vec = value(nodes), dict(VECTORS)
    assert base["b"] == pytest.approx(vec[1])
    new = value(nodes.withColumn("leaf", F.when(F.col("leaf") == 2, 4).otherwise(F.col("leaf"))))
    cand = spark.createDataFrame([("a", 2, 4), ("a", 2, 2), ("a", 2, 77)], "tree string, target long, cand long")
    got = {r.cand: r.score for r in rank_replacements(nodes, cand, emb, rel, 4, model).collect()}
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    assert got == {2: pytest.approx(1.0), 4: pytest.approx(dot(base["a"], new["a"]) / (dot(base["a"], base["a"]) * dot(new["a"], new["a"])) ** 0.5)}


def test_scores_of_graphs(spark):
    nodes, emb, rel = frames(spark, 4)
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = M.graph_scores(nodes, table([("a", 1, 2, 4)], "tree string, variant long, leaf long, replacement long"), table([("a", 0), ("a", 3), ("b", 77)], "tree string, t long"), table([("a", 1, 4), ("b", 2, 0)], "tree string, variant long, t long"), emb, rel, 4, 6.0)
    value = {r.tree: r.value for r in M.evaluate_trees(nodes, emb, rel, 4).collect()}
    near = lambda t, i: 6.0 - sum(abs(x - y) for x, y in zip(value[t], dict(VECTORS)[i]))
    got = sorted((r.tree, r.kind, r.variant, round(r.score, 9)) for r in found.collect())
    assert [x for x in got if x[1] != "head"] == sorted([("a", "positive", 0, round(near("a", i), 9)) for i in (0, 3)] + [("a", "tail", 1, round(near("a", 4), 9)), ("b", "tail", 2, round(near("b", 0), 9))])
    assert len([x for x in got if x[1] == "head"]) == 2


@pytest.mark.parametrize("name", ["gop_transe", "gop_distmult", "gop_rotate", "subst_calc", "subst_learned", "graph_scores", "path_scores"])
def test_no_vector_is_shuffled_with_a_row(spark, name):
    """Sums of 64 components as states of an aggregate were what filled the disks."""
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "partial_avg" not in plan and "partial_sum" not in plan


def test_corrupted_leaves_are_drawn_in_place(spark):
    plan = registry.QUERIES["corrupted_leaves"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in plan
