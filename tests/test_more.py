"""Whole results at the edges: trees that hold nearly all entities, equal lines, blocks, fallbacks, formats."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ladle.functions.nlp import parse
from ladle.operators import closure as C
from ladle.operators import cooccurrence as O
from ladle.operators import facts as N
from ladle.operators import flow as G
from ladle.operators import gold as E
from ladle.operators import linking as L
from ladle.operators import nearest as V
from ladle.operators import sampling as S
from ladle.operators import scoring as M
from ladle.operators.substitute import target_of
from ladle.sources import files


def test_every_leaf_has_a_variant(spark):
    rows = [(1, i) for i in range(30) if i not in (4, 17)] + [(2, i) for i in range(30)] + [(3, 29), (3, 0)] + [(4, i) for i in range(1, 30)]
    got = S.corrupted_leaves(spark.createDataFrame(rows, "tree long, leaf long"), 30).collect()
    by = lambda t: {r.leaf: r.replacement for r in got if r.tree == t}
    assert set(by(1)) == {i for i in range(30)} - {4, 17} and set(by(1).values()) <= {4, 17}
    assert by(2) == {} and set(by(3)) == {0, 29} and not set(by(3).values()) & {0, 29}
    assert by(4) == {i: 0 for i in range(1, 30)}


def test_equal_lines_are_trees_of_their_own(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"out": [{"mix": ["x"]}]}\n' * 3)
    nodes = files.read_trees(spark, f"{tmp_path}/t.jsonl")
    assert nodes.select("tree").distinct().count() == 3 and nodes.count() == 9


def test_unseen_ingredients_without_likeness(spark):
    edges = spark.createDataFrame([(1, ("name", "salt", 0), ("pred", "mix", 0))], "recipe_id long, src struct<kind:string,name:string,step:int>, dst struct<kind:string,name:string,step:int>")
    ing = spark.createDataFrame([(1, "salt"), (1, "rice")], "recipe_id long, name string")
    none = spark.createDataFrame([], "a string, b string, sim double")
    assert {r.src.name for r in G.attach_unseen(edges, ing, none).collect()} == {"salt", "rice"}


def test_passive_subjects_and_ingredients(spark):
    t = {x["text"]: x for x in parse("the onions are chopped")}
    assert t["chopped"]["pos"] == "VERB" and t["onions"]["dep"] == "nsubjpass" and t["onions"]["head"] == 3
    r = spark.createDataFrame([(1, ["2 large onions", "the salt", "salt", None]), (2, None)], "recipe_id long, ingredients array<string>")
    assert {tuple(x) for x in N.ingredient_names(r).collect()} == {(1, "large onion"), (1, "salt")}


def test_verbs_are_joined(spark):
    steps = spark.createDataFrame([(1, 0, "peel, chop and fry"), (1, 1, "chopped onions"), (None, 2, "fry it")], "recipe_id long, step_num int, step string")
    verbs = spark.createDataFrame([("chop",), ("fry",)], "word string")
    known = {r.step_num: set(r.known) for r in N.with_verbs(steps, verbs).collect()}
    assert known == {0: {"chop", "fry"}, 1: {"chopped"}, 2: set()}


@pytest.mark.parametrize("blocks", [(4096, 4096), (5, 3)])
def test_masked_top_k_in_blocks(spark, monkeypatch, blocks):
    rng = random.Random(3)
    m = spark.createDataFrame([(g, f"i{x}") for g in range(90) for x in rng.sample(range(12), rng.randint(1, 6))] + [(99, "alone")], "grp long, item string")
    rows = O.symmetric(O.pair_counts(m))
    targets = m.groupBy("grp").agg(F.min("item").alias("target"))
    whole = O.masked_cosines(m, rows, targets).withColumn("key", F.struct("grp", "target"))
    want = sorted(map(tuple, O.top_k(whole, 3, by="key", name="item").select("grp", "target", "item", "cos", "rank").collect()))
    monkeypatch.setattr(O, "SET_BLOCK", blocks[0])
    monkeypatch.setattr(O, "ITEM_BLOCK", blocks[1])
    found = sorted(map(tuple, O.masked_top_k(m, rows, targets, 3).select("grp", "target", "item", "cos", "rank").collect()))
    assert found == want and len(want) > 150


@pytest.mark.parametrize("block", [3, 1000])
def test_nearest_is_brute_force(spark, block):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(90, 4)), 1)
    x[7] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = sorted((r.x, r["rank"], r.y, r.cos) for r in V.nearest(df.filter("id % 20 = 0"), df, 5, block).collect())
    size = np.linalg.norm(x, axis=1)
    unit = np.divide(x, size[:, None], where=size[:, None] > 0, out=np.zeros_like(x))
    want = []
    for q in range(0, 90, 20):
        cos = np.round(unit[q] @ unit.T, 6) + 0.0
        want += [(q, k, int(y), cos[y]) for k, y in enumerate(np.lexsort((np.arange(90), -cos))[:5], 1)]
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert V.nearest(df.limit(0), df, 5).count() == 0


def test_links_above_the_threshold_are_all_found(spark):
    rng = random.Random(8)
    pool = [f"w{k}" for k in range(30)]
    text = lambda n: " ".join(rng.choices(pool, weights=range(1, 31), k=n))
    labels = spark.createDataFrame([(f"u{i}", text(rng.randint(1, 6))) for i in range(60)], "uri string, label string")
    queries = spark.createDataFrame([(f"q{i}", text(rng.randint(1, 6))) for i in range(60)], "q string, text string")
    w, idf = L.tfidf(labels, "uri", "label")
    wq = L.normalised(L.term_counts(queries, "q", "text"), idf, "q")
    every = wq.join(w.withColumnRenamed("w", "v"), "term").groupBy("q", "uri").agg(F.round(F.sum(F.col("w") * F.col("v")), 9).alias("score"))
    scores = [tuple(r) for r in every.collect()]
    for least in (0.2, 0.6, 0.95):
        best = {}
        for q, _, s in scores:
            best[q] = max(best.get(q, 0), s)
        want = {(q, u) for q, u, s in scores if s == best[q] and s >= least}
        assert {(r.q, r.uri) for r in L.best_links(queries, labels, least).collect()} == want
    index = labels.withColumn("label_prio", F.lit(0)).withColumn("hier_prio", F.lit(0))
    linked, counts = L.link_batches({"a": (queries.select(F.col("text").alias("name")), L.LabelMatcher(index, 0.6)), "b": (queries.select(F.lit("nothing").alias("name")), L.LabelMatcher(index))})
    c = {r.kind: r for r in counts.collect()}
    assert c["b"].n_names == c["b"].n_missed == 1 and linked.filter("kind = 'a'").count() == c["a"].n_names - c["a"].n_missed


def test_second_root(spark):
    e = spark.createDataFrame([("a", "r1"), ("b", "a"), ("c", "r2"), ("b", "r2")], "src string, dst string")
    assert {tuple(r) for r in C.depth_below(e, "r1", "r2").collect()} == {("r1", 0), ("a", 1), ("b", 2), ("c", 1), ("r2", 0)}


def test_leaves_get_words(spark):
    e = spark.createDataFrame([(1, "t1", "t9"), (1, "t9", "t12"), (1, "t2", "t12")], "k long, src string, dst string")
    w = spark.createDataFrame([(1, "t1", "Red Onions"), (1, "t9", "Chop"), (1, "t2", "salt")], "k long, node string, word string")
    edges, names = E.relabelled_leaves(e, "k", w)
    assert {tuple(r) for r in edges.collect()} == {(1, "red onion", "t9"), (1, "t9", "t12"), (1, "salt", "t12")}
    assert {r.name for r in names.collect()} == {"red onion", "salt"}


def test_targets_are_checked(spark):
    m = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "grp long, item string")
    assert target_of(m, 1, "b") == (1, "b") and target_of(m, 2) == (2, "c") and target_of(m, item="a") == (1, "a")
    assert target_of(m, seed=3) == target_of(m, seed=3)
    for wrong in ({"group": 9}, {"group": 1, "item": "c"}, {"item": "z"}):
        with pytest.raises(ValueError):
            target_of(m, **wrong)


def test_trees_refuse_other_models(spark):
    none = spark.createDataFrame([], "tree long")
    with pytest.raises(ValueError):
        M.graph_scores(none, none, none, none, none, none, 4, 1.0, "ComplEx")


def test_more_formats(spark, tmp_path):
    p = str(tmp_path)
    (tmp_path / "rel.json").write_text('{"subclass_edges": [["a", "b"], ["b", "c"]], "subclass_edge_labels": ["sub", "sub"]}')
    r = files.read_relations(spark, f"{p}/rel.json")
    files.write_relations(r, f"{p}/rel")
    assert sorted(map(tuple, files.read_relations(spark, f"{p}/rel").collect())) == sorted(map(tuple, r.collect())) == [("a", "b", "sub"), ("b", "c", "sub")]
    ents = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "id long, name string")
    rels = spark.createDataFrame([(0, "mix"), (1, "heat")], "id long, name string")
    (tmp_path / "paths.txt").write_text("['x', 'y']\t['heat', 'mix', 'heat']\tz\n['x']\t['gone']\tz\n")
    got = files.read_path_triples(spark, f"{p}/paths.txt", ents, rels).collect()
    assert [(g.heads, g.rels, g.t, g.length) for g in got] == [([0, 1], [1, 0, 1], 2, 3)]
    (tmp_path / "names.json").write_text('["salt", "rice"]')
    assert [x.name for x in files.read_names(spark, f"{p}/names.json").collect()] == ["salt", "rice"]
    files.write_corpus(ents, f"{p}/corpus")
    assert files.read_corpus(spark, f"{p}/corpus").count() == 3
    files.write_features(ents, r, f"{p}/features")
    recipes = spark.createDataFrame([(1, "n", ["t"], ["s"], ["i"])], "recipe_id long, name string, tags array<string>, steps array<string>, ingredients array<string>")
    files.write_gold(spark.createDataFrame([(1, "a", "b")], "recipe_id long, src string, dst string"), recipes, f"{p}/gold")
    assert files.read_recipes(spark, f"{p}/gold/recipes").count() == 1 and spark.read.parquet(f"{p}/gold/graphs").count() == 1
