"""Hand-computed cases for the operators' rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ladle.operators import closure as C
from ladle.operators import cooccurrence as O
from ladle.operators import flow as G
from ladle.operators import gold as E
from ladle.operators import linking as L
from ladle.operators import sampling as S
from ladle.operators import scoring as M
from ladle.operators import taxonomy as K
from ladle.operators import textops as X
from ladle.operators import triples as T
from ladle.operators.substitute import rank_replacements


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def tax(spark):
    return spark.createDataFrame([("a", "m"), ("b", "m"), ("m", "root"), ("c", "root")], "src string, dst string")


def test_wpath(spark, tax):
    reach = C.closure(tax)
    ic = dict(rows(K.information_content(reach), "node", "ic"))
    assert ic["m"] == pytest.approx(0.221849, abs=1e-6)
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "a"), ("a", "x")], "a string, b string")
    sim = {(r.a, r.b): r.sim for r in K.wpath(pairs, C.ancestors(tax), "root").collect()}
    assert sim["a", "b"] == pytest.approx(0.368333, abs=1e-5)
    assert sim["a", "c"] == pytest.approx(0.25)
    assert sim["a", "a"] == 1 and sim["a", "x"] == 0


def test_closure_of_a_cycle_ends(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    assert ("a", "c", 2) in rows(C.closure(e), "src", "dst", "dist")
    assert rows(C.cyclic_rest(e), "src", "dst") == [("a", "b"), ("b", "a")]


def test_ancestor_labels_hold_the_closure(spark, tax):
    cycle = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "d"), ("x", "x"), ("y", "d"), ("y", "a"), ("y", "a")]
    for edges in (tax, spark.createDataFrame(cycle, "src string, dst string"), tax.limit(0)):
        flat = C.ancestors(edges).select(F.col("node").alias("src"), F.inline("ups").alias("dst", "dist"))
        assert rows(flat, "src", "dst", "dist") == rows(C.closure(edges), "src", "dst", "dist")


def test_lowest_common_ancestor_ties(spark):
    # m and n are equally deep; m has more below it, so n tells more. p and q tie in all but the name.
    edges = [("a", "m"), ("a", "n"), ("b", "m"), ("b", "n"), ("c", "m"), ("d", "p"), ("d", "q"), ("e", "p"), ("e", "q"), ("m", "root"), ("n", "root"), ("p", "root"), ("q", "root"), ("z", "alone")]
    labels = C.ancestors(spark.createDataFrame(edges, "src string, dst string"))
    pairs = spark.createDataFrame([("a", "b"), ("d", "e"), ("a", "d"), ("a", "m"), ("z", "a"), ("a", None)], "a string, b string")
    found = rows(K.lowest_common(pairs, labels, "root"), "a", "b", "anc", "dist")
    assert found == [("a", "b", "n", 2), ("a", "d", "root", 4), ("a", "m", "m", 1), ("d", "e", "p", 2)]


def test_closure_is_idempotent(spark, tax):
    once = C.closure(tax)
    twice = C.closure(once.filter("dist > 0").select("src", "dst"))
    assert rows(once, "src", "dst") == rows(twice, "src", "dst")


def test_cooccurrence(spark):
    m = O.members(spark.createDataFrame([("1", x) for x in "abc"] + [("2", x) for x in "ab"] + [("3", x) for x in "bc"], "g string, i string"), "g", "i")
    pairs = O.pair_counts(m)
    assert rows(pairs, "a", "b", "n") == [("a", "b", 2), ("a", "c", 1), ("b", "c", 2)]
    cos = {(r.x, r.y): r.cos for r in O.cosines(O.symmetric(pairs)).collect()}
    assert cos["a", "c"] == pytest.approx(0.8) and cos["a", "b"] == pytest.approx(0.316228, abs=1e-6)
    masked = {r.item: r.cos for r in O.masked_cosines(m, O.symmetric(pairs), spark.createDataFrame([("2", "a")], "grp string, target string")).collect()}
    assert masked["c"] == pytest.approx(0.894427, abs=1e-6) and masked.get("b", 0) == 0


def _tree(spark, leaves):
    """mix: leaves and {heat: [3]}."""
    n = [(1, "mix", None, 0, 0, None), (1, "heat", "mix", 1, 1, None), (1, "z", "heat", 2, None, 3)] + [(1, f"l{x}", "mix", 1, None, x) for x in leaves]
    return spark.createDataFrame(n, "tree long, node string, parent string, depth int, rel long, leaf long")


def test_tree_value(spark):
    emb = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id long, vec array<double>")
    rel = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 0.0])], "id long, vec array<double>")
    v = M.evaluate_trees(_tree(spark, [1, 2]), emb, rel, 2).first()["value"]
    assert v == pytest.approx([1, 5 / 3])
    cand = spark.createDataFrame([(1, 1, 1), (1, 1, 2)], "tree long, target long, cand long")
    found = {r.cand: r.score for r in rank_replacements(_tree(spark, [1, 2]), cand, emb, rel, 2).collect()}
    assert found[1] == pytest.approx(1) and found[2] < 1
    with pytest.raises(ValueError):
        M.apply_relation("ComplEx", F.lit(None), F.lit(None), 2)


FACTS = "recipe_id long, step_num int, entity string, action string, word_idx int, dep string, kind string"


def _edges(df):
    return sorted((r.s, r.d) for r in df.select(F.col("src.name").alias("s"), F.col("dst.name").alias("d")).collect())


def test_action_chain_and_final(spark):
    f = spark.createDataFrame([(1, 0, "onion", "chop", 1, "dobj", "main"), (1, 0, "onion", "fry", 5, "dobj", "main")], FACTS)
    assert _edges(G.action_chains(f)) == [("chop", "fry"), ("onion", "chop")]
    assert G.final_actions(f).first()["final"] == "fry"


def test_continuation(spark):
    f = spark.createDataFrame([(1, 0, "flour", "mix", 1, "dobj", "main"), (1, 1, "oven", "bake", 2, "pobj", "prep")], FACTS)
    assert _edges(G.continuations(f)) == [("mix", "bake")]


def test_special_names(spark):
    f = spark.createDataFrame([(1, 0, "salt", "put", 1, "dobj", "main"), (1, 1, "remaining ingredient", "mix", 1, "dobj", "main")], FACTS)
    ing = spark.createDataFrame([(1, "salt"), (1, "oat")], "recipe_id long, name string")
    assert _edges(G.special_edges(G.action_chains(f), ing)) == [("oat", "mix"), ("salt", "put")]


def test_leaf_pruning(spark):
    ok = dict(leaves=spark.createDataFrame([(1, "garnish"), (1, "salt"), (1, "everything")], "recipe_id long, name string"), taxonomy=spark.createDataFrame([("salt",)], "name string"), reaches=spark.createDataFrame([("salt",)], "name string"))
    records = spark.createDataFrame([("salt", True, False)], "name string, closest_ing boolean, r_eqp boolean")
    accepted = G.accepted_leaves(records=records, ingredients=spark.createDataFrame([(1, "salt")], "recipe_id long, name string"), **ok)
    assert rows(accepted, "name") == [("everything",), ("salt",)]
    node = lambda k, n: F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name"), F.lit(0).alias("step"))
    base = spark.range(1).select(F.lit(1).cast("long").alias("recipe_id"))
    e = base.select("recipe_id", node("name", "garnish").alias("src"), node("pred", "plate").alias("dst")).unionAll(base.select("recipe_id", node("name", "salt"), node("pred", "plate"))).unionAll(base.select("recipe_id", node("pred", "plate"), node("output", "o")))
    kept = G.prune_leaves(e, accepted)
    assert _edges(kept) == [("plate", "o"), ("salt", "plate")]
    assert rows(G.sound_recipes(kept), "recipe_id") == [(1,)]


def test_terminals(spark):
    e = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "x", "y"), (1, "y", "x"), (1, "d", "e"), (1, "d", "f")], "k long, src string, dst string")
    t = {r.node: r.terminal for r in G.terminals(e, "k").collect()}
    assert t == {"a": "c", "b": "c", "c": "c", "x": None, "y": None, "d": "d", "e": "e", "f": "f"}


def test_suffix_links(spark):
    d = lambda *x: spark.createDataFrame([(v,) for v in x], "name string")
    r = L.suffix_links(d("tablespoon olive oil", "cookie sheet", "1 to 2 potato"), d("oil", "olive oil", "cookie", "potato"))
    got = {x.name: (x.found, x.rest) for x in r.collect()}
    assert got["tablespoon olive oil"] == (["olive oil"], "tablespoon")
    assert got["cookie sheet"] == ([], "cookie sheet")
    assert got["1 to 2 potato"] == (["potato"], "1 to 2")
    assert rows(L.sub_noun_links(r, d("cookie", "to 2", "tablespoon")), "name") == [("cookie sheet",), ("tablespoon olive oil",)]


def test_ties(spark):
    ties = lambda *u: spark.createDataFrame([("q", x, 1.0) for x in u], "q string, uri string, score double")
    labels = spark.createDataFrame([("A", 0, 5), ("B", 1, 2), ("C", 0, 7)], "uri string, label_prio int, hier_prio int")
    assert L.one_of_ties(ties("A", "B"), labels).first()["uri"] == "A"
    assert L.one_of_ties(ties("A", "B", "C"), labels).first()["uri"] == "B"


def test_counts_and_weights(spark):
    t = spark.createDataFrame([(1, 0, 2), (1, 0, 3)], "h long, r long, t long")
    w = {(r.h, r.t): r.w for r in S.subsampling_weights(t).collect()}
    assert w[1, 2] == pytest.approx(1 / 3)


def test_negatives_are_false_and_enough(spark):
    t = spark.createDataFrame([(1, 0, x) for x in range(8)] + [(2, 0, 1)], "h long, r long, t long")
    n = S.negative_tails(t, 10, 4).collect()
    assert all(x.neg in (8, 9) for x in n if x.h == 1) and sum(x.h == 2 for x in n) == 4


def test_metrics(spark):
    m = M.ranking_metrics(spark.createDataFrame([(1,), (2,), (20,)], "rank long")).first()
    assert m.mrr == pytest.approx(0.516667, abs=1e-6) and m.mr == pytest.approx(7.666667, abs=1e-6)
    assert (m.hits_1, m.hits_3, m.hits_10, m.hits_100) == pytest.approx((1 / 3, 2 / 3, 2 / 3, 1))


def test_edge_scores(spark):
    t = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (2, "a", "x"), (2, "c", "x")], "k long, src string, dst string")
    p = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (1, "d", "x"), (1, "e", "x"), (2, "a", "x")], "k long, src string, dst string")
    r = M.edge_scores(t, p, "k")[1].first()
    assert (r.precision, r.recall, r.f1) == pytest.approx((0.75, 0.75, 0.75))


def test_islands(spark):
    t = spark.createDataFrame([("r", 1, "olive", "F-B"), ("r", 2, "oil", "F-I"), ("r", 3, "Heat", "Ac"), ("r", 4, "x", "F-I")], "k string, n int, w string, tag string")
    assert rows(E.merged_tokens(t, "k", ["n"], "w", "tag", "F-B", "F-I"), "n", "merged") == [(1, "olive oil")]


def test_reduction(spark):
    e = spark.createDataFrame([("r", "salt", "pan"), ("r", "pan", "fry"), ("r", "fast", "fry"), ("r", "fry", "serve")], "k string, src string, dst string")
    n = spark.createDataFrame([("r", "salt", "F"), ("r", "pan", "T"), ("r", "fry", "Ac"), ("r", "fast", "Af"), ("r", "serve", "Ac")], "k string, node string, tag string")
    links = spark.createDataFrame([], "k string, src string, dst string, link string")
    assert rows(E.reduce_graph(e, n, links, "k"), "src", "dst") == [("fry", "serve"), ("salt", "fry")]


def test_split_is_complete_and_disjoint(spark):
    t = spark.range(3000).select(F.col("id").cast("string").alias("h"), F.lit("r").alias("r"), F.lit("t").alias("t"))
    parts = {r["part"]: r["count"] for r in T.split(t, F.col("h")).groupBy("part").count().collect()}
    assert sum(parts.values()) == 3000 and 0.6 < parts["train"] / 3000 < 0.8


def test_dictionary_is_dense(spark):
    d = T.dictionary(spark.createDataFrame([(x,) for x in ["b", "a", "c", "a", None]], "name string"))
    assert rows(d, "id", "name") == [(0, "a"), (1, "b"), (2, "c")]


def test_tree_paths(spark):
    e = spark.createDataFrame([(1, "o", "mix"), (1, "mix", "x"), (1, "mix", "heat"), (1, "heat", "x")], "k long, parent string, child string")
    assert len(T.operation_tree(e, "k", "o").collect()) == 4
    kept = T.prune_childless(e, spark.createDataFrame([(1, "x")], "k long, node string"), "k")
    assert kept.count() == 4
    assert T.prune_childless(e, spark.createDataFrame([(1, "none")], "k long, node string"), "k").count() == 0


def test_partitions_do_not_matter(spark, tax):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(rows(C.closure(tax), "src", "dst", "dist"))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_steps(spark):
    d = spark.createDataFrame([(1, "mix , stir\n\nbake")], "id long, text string")
    assert rows(X.steps(d, "id", F.col("text")), "step_num", "step") == [(0, "mix, stir."), (1, "bake.")]


def test_model_rules():
    M.check_model("TransE", False, False)
    for args in (("RotatE", True, True), ("ComplEx", False, False), ("Other", False, False)):
        with pytest.raises(ValueError):
            M.check_model(*args)
    assert np.isclose(M.embedding_range(24, 200), 0.13)
