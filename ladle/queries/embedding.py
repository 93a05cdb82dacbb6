"""Triples, samples, scores and metrics.

Customers are triples (customer's vector, market segment, nation's vector); orders are operation
trees whose leaves are the vectors of their parts, grouped by return flag.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladle.operators import ranking as R
from ladle.operators import sampling as S
from ladle.operators import scoring as M
from ladle.operators import triples as T
from ladle.operators.substitute import rank_replacements
from ladle.operators.train import Settings, train
from ladle.queries import table

DIM, GAMMA = 64, 12.0
#: In SQL: how many vectors, and so entities, there are.
ENTITIES = "(SELECT count(*) FROM embeddings)"
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def named_triples(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("h"), F.col("c_mktsegment").alias("r"), F.concat(F.lit("N"), "c_nationkey").alias("t"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("h"), F.lit("in").alias("r"), F.concat(F.lit("R"), "n_regionkey").alias("t"))
    return T.triples(c, n, T.typed(table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("node")), "node", "type", "Customer"))


NAMED = "nt AS (SELECT DISTINCT 'C' || c_custkey AS h, c_mktsegment AS r, 'N' || c_nationkey AS t FROM customer UNION SELECT 'N' || n_nationkey, 'in', 'R' || n_regionkey FROM nation UNION SELECT 'C' || c_custkey, 'type', 'Customer' FROM customer)"


def entities(spark, sf_dir) -> int:
    """How many vectors there are; customers, parts and suppliers stand for them by their numbers."""
    return max(1, emb(spark, sf_dir).count())


def id_triples(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    n = entities(spark, sf_dir)
    segment = F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("c_mktsegment")) - 1
    return c.select((F.col("c_custkey") % n).alias("h"), segment.cast("bigint").alias("r"), F.col("c_nationkey").cast("bigint").alias("t"))


IDS = f"it AS (SELECT c_custkey % {ENTITIES} AS h, CAST(list_position({list(SEGMENTS)}, c_mktsegment) - 1 AS BIGINT) AS r, CAST(c_nationkey AS BIGINT) AS t FROM customer)"


def emb(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def relations(spark, sf_dir, dim: int = DIM) -> DataFrame:
    """The vectors 100 to 104, for the five relations."""
    return emb(spark, sf_dir).filter("id between 100 and 104").select((F.col("id") - 100).alias("id"), F.slice("vec", 1, dim).alias("vec"))


def triples_union(spark, sf_dir):
    return named_triples(spark, sf_dir)


def known_subclass_triples(spark, sf_dir):
    known = named_triples(spark, sf_dir).select(F.col("h").alias("node")).distinct()
    edges = table(spark, sf_dir, "supplier").select(F.concat(F.lit("C"), "s_suppkey").alias("src"), F.concat(F.lit("N"), "s_nationkey").alias("dst"))
    return T.triples(T.among_known(edges, known, "sub"))


def dict_encode(spark, sf_dir):
    t = named_triples(spark, sf_dir)
    return T.dictionary(t.select(F.col("h").alias("name")).unionAll(t.select("t")))


def encoded_triples(spark, sf_dir):
    t = named_triples(spark, sf_dir)
    entities = T.dictionary(t.select(F.col("h").alias("name")).unionAll(t.select("t")))
    return T.encode(t, entities, T.dictionary(t.select(F.col("r").alias("name"))))


def _parts(spark, sf_dir):
    t = named_triples(spark, sf_dir)
    return T.split(t, F.concat_ws("|", "h", "r", "t"))


def split_hash(spark, sf_dir):
    return _parts(spark, sf_dir)


def leak_anti(spark, sf_dir):
    """Test triples whose (h, r, t), by customer number modulo 1000, training doesn't have."""
    short = lambda d: d.select(F.regexp_replace("h", "[0-9]{3}$", "").alias("h"), "r", "t", "part")
    p = short(_parts(spark, sf_dir))
    return T.without_leaks(p.filter("part = 'test'"), p.filter("part = 'train'")).select("h", "r", "t")


def node_roles(spark, sf_dir):
    t = named_triples(spark, sf_dir)
    edges = t.filter("r <> 'type'").select(F.col("h").alias("src"), F.col("t").alias("dst"))
    outputs = table(spark, sf_dir, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("node"))
    types = table(spark, sf_dir, "nation").filter("n_nationkey < 5").select(F.concat(F.lit("N"), "n_nationkey").alias("node"))
    external = table(spark, sf_dir, "supplier").select(F.concat(F.lit("C"), "s_suppkey").alias("node")).unionByName(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("node")))
    return T.node_roles(edges, outputs, types, external)


def two_way_edges(spark, sf_dir):
    t = named_triples(spark, sf_dir)
    return T.reversed_edges(t.select(F.col("h").alias("src"), F.col("t").alias("dst")))


def freq_start4(spark, sf_dir):
    head, tail = S.partial_key_counts(id_triples(spark, sf_dir))
    return head.select(F.lit("head").alias("side"), F.col("h").alias("e"), "r", F.col("c_hr").alias("c")).unionByName(tail.select(F.lit("tail").alias("side"), F.col("t").alias("e"), "r", F.col("c_tr").alias("c")))


def subsample_weight(spark, sf_dir):
    return S.subsampling_weights(id_triples(spark, sf_dir)).select("h", "r", "t", F.round("w", 9).alias("w"))


def true_tail(spark, sf_dir):
    return S.true_tails(id_triples(spark, sf_dir))


def true_head(spark, sf_dir):
    return S.true_heads(id_triples(spark, sf_dir))


def neg_sample(spark, sf_dir):
    return S.negative_tails(id_triples(spark, sf_dir), 25, 4).select("h", "r", "t", "neg", F.col("k").cast("bigint").alias("k"))


def _nations(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"))


def eval_candidates(spark, sf_dir):
    t = id_triples(spark, sf_dir)
    return S.evaluation_tails(t, t, _nations(spark, sf_dir))


def _score(spark, sf_dir, model, dim_r=DIM):
    t = M.embed(id_triples(spark, sf_dir), emb(spark, sf_dir), relations(spark, sf_dir, dim_r))
    return t.select("h", "r", "t", F.round(model(F.col("hv"), F.col("rv"), F.col("tv")), 6).alias("score"))


def score_transe(spark, sf_dir):
    return _score(spark, sf_dir, lambda h, r, t: M.transe(h, r, t, DIM, GAMMA))


def score_distmult(spark, sf_dir):
    return _score(spark, sf_dir, lambda h, r, t: M.distmult(h, r, t, DIM))


def score_complex(spark, sf_dir):
    return _score(spark, sf_dir, lambda h, r, t: M.complex_(h, r, t, DIM))


def score_rotate(spark, sf_dir):
    return _score(spark, sf_dir, lambda h, r, t: M.rotate(h, r, t, DIM, GAMMA))


def score_protate(spark, sf_dir):
    return _score(spark, sf_dir, lambda h, r, t: M.protate(h, r, t, DIM, GAMMA))


def filtered_ranks(spark, sf_dir):
    t = id_triples(spark, sf_dir)
    r = R.filtered_ranks(t, t, emb(spark, sf_dir), _nations(spark, sf_dir), relations(spark, sf_dir), "TransE", GAMMA, 6)
    return r.select("h", "r", F.col("t").alias("true"), "rank")


def mrr_hits(spark, sf_dir):
    m = M.ranking_metrics(filtered_ranks(spark, sf_dir))
    return m.select(*[F.round(c, 9).alias(c) for c in m.columns])


def predict_tails(spark, sf_dir):
    """All nations in the order of their scores, for each (h, r)."""
    q = id_triples(spark, sf_dir).select("h", "r").distinct().join(F.broadcast(_nations(spark, sf_dir).select(F.col("id").alias("t"))))  # a dictionary
    e = M.embed(q, emb(spark, sf_dir), relations(spark, sf_dir))
    s = e.select("h", "r", "t", F.round(M.distmult(F.col("hv"), F.col("rv"), F.col("tv"), DIM), 9).alias("score"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("h", "r").orderBy(F.desc("score"), "t")).cast("bigint"))


def adv_loss(spark, sf_dir):
    t = S.subsampling_weights(id_triples(spark, sf_dir)).distinct()
    e = M.embed(t, emb(spark, sf_dir), relations(spark, sf_dir))
    score = lambda d: F.round(M.transe(F.col("hv"), F.col("rv"), F.col("tv"), DIM, GAMMA), 6)
    positive = e.select("h", "r", "t", "w", score(e).alias("score"))
    neg = S.negative_tails(id_triples(spark, sf_dir), 25, 4).select("h", "r", F.col("neg").alias("t"), F.col("t").alias("own"))
    n = M.embed(neg, emb(spark, sf_dir), relations(spark, sf_dir))
    negative = n.select("h", "r", F.col("own").alias("t"), score(n).alias("score"))
    out = M.loss(positive, negative, ["h", "r", "t"], 1.0)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def tree_nodes(spark, sf_dir) -> DataFrame:
    """Orders as trees: the order, its return flags below it, its parts' vectors below them."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tree"), F.col("l_returnflag").alias("flag"), (F.col("l_partkey") % entities(spark, sf_dir)).alias("leaf"))
    li = li.filter("tree is not null and flag is not null and leaf is not null").repartition("tree").distinct()  # one shuffle for all that follows
    own = li.groupBy("tree").agg(F.collect_list(F.struct("flag", "leaf")).alias("x"))
    text, number = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    node = lambda name, parent, depth, rel, leaf: F.struct(name.alias("node"), parent.alias("parent"), F.lit(depth).alias("depth"), rel.alias("rel"), leaf.alias("leaf"))
    leaves = F.transform("x", lambda v: node(F.concat(v["flag"], F.lit("/"), v["leaf"]), v["flag"], 2, number, v["leaf"]))
    flags = F.transform(F.array_distinct("x.flag"), lambda f: node(f, F.lit("root"), 1, (F.array_position(F.array(*map(F.lit, "ANR")), f) - 1).cast("bigint"), number))
    return own.select("tree", F.inline(F.concat(leaves, flags, F.array(node(F.lit("root"), text, 0, F.lit(4).cast("bigint"), number)))))


def _gop(spark, sf_dir, model, dim_r=DIM):
    v = M.evaluate_trees(tree_nodes(spark, sf_dir), emb(spark, sf_dir), relations(spark, sf_dir, dim_r), DIM, model, depth=2)
    return v.select("tree", F.round(F.get("value", F.lit(0)), 6).alias("first"), F.round(F.get("value", F.lit(DIM - 1)), 6).alias("last"))


def gop_transe(spark, sf_dir):
    return _gop(spark, sf_dir, "TransE")


def gop_distmult(spark, sf_dir):
    return _gop(spark, sf_dir, "DistMult")


def gop_rotate(spark, sf_dir):
    v = M.evaluate_trees(tree_nodes(spark, sf_dir), emb(spark, sf_dir), relations(spark, sf_dir), DIM, "RotatE", depth=2)
    return v.select("tree", F.round(F.get("value", F.lit(0)), 5).alias("first"))


def leaf_counts(spark, sf_dir):
    return S.leaf_counts(tree_nodes(spark, sf_dir))


def tree_frequency(spark, sf_dir):
    """How many orders have one form, by how often it occurs."""
    n = tree_nodes(spark, sf_dir).filter("leaf is not null").select("tree", F.array("parent").alias("path"), "leaf")
    return S.tree_counts(S.canonical(n)).groupBy("c").agg(F.count(F.lit(1)).alias("forms"))


def head_paths(spark, sf_dir):
    n = tree_nodes(spark, sf_dir).filter("leaf is not null").select("tree", F.array(F.lit("root"), F.col("parent"), F.col("node")).alias("path"), "leaf")
    return S.head_paths(n)


def corrupted_leaves(spark, sf_dir):
    found = S.corrupted_leaves(tree_nodes(spark, sf_dir).select("tree", "leaf"), entities(spark, sf_dir))
    return found.select("tree", F.col("variant").cast("bigint").alias("variant"), "leaf", "replacement")


def hyper_triples(spark, sf_dir):
    n = tree_nodes(spark, sf_dir).filter("parent is not null")
    return T.hyper_triples(n.select("tree", F.col("node").alias("src"), F.col("parent").alias("dst")), "tree")


def _replacements(spark, sf_dir):
    """For each order its first part's vector as the target, and its suppliers' vectors as candidates."""
    n = entities(spark, sf_dir)
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tree"), (F.col("l_partkey") % n).alias("leaf"), (F.col("l_suppkey") % n).alias("cand"))
    own = li.repartition("tree").groupBy("tree").agg(F.min("leaf").alias("target"), F.collect_set("cand").alias("cands"))
    return own.select("tree", "target", F.explode("cands").alias("cand"))


def subst_calc(spark, sf_dir):
    """Orders evaluated with the target replaced, compared with what they were."""
    found = rank_replacements(tree_nodes(spark, sf_dir), _replacements(spark, sf_dir), emb(spark, sf_dir), relations(spark, sf_dir), DIM, depth=2)
    return found.select("tree", "target", "cand", F.round("score", 6).alias("score"))


def subst_learned(spark, sf_dir):
    """The same, compared with a vector of the order's own."""
    trees = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tree"), (F.col("o_orderkey") % entities(spark, sf_dir)).alias("own"))
    found = rank_replacements(tree_nodes(spark, sf_dir), _replacements(spark, sf_dir), emb(spark, sf_dir), relations(spark, sf_dir), DIM, depth=2, learned=trees)
    return found.select("tree", "target", "cand", F.round("score", 6).alias("score"))


def tree_paths(spark, sf_dir):
    """Orders unrolled from the root, with the way to every node."""
    n = tree_nodes(spark, sf_dir).filter("parent is not null").select("tree", "parent", F.col("node").alias("child"))
    found = T.operation_tree(n, "tree", "root")
    return found.select("tree", F.array_join("path", ">").alias("path"), F.col("depth").cast("bigint").alias("depth"))


def flat_triples(spark, sf_dir):
    n = tree_nodes(spark, sf_dir).filter("depth = 2").select("tree", F.concat(F.lit("pred_"), "parent", F.lit("_"), "tree").alias("parent"), F.col("node").alias("child"))
    return T.flat_triples(n, "tree").select("tree", "h", "r", "t")


def trained_entities(spark, sf_dir):
    """Entities after steps on the customers' triples and on the orders' trees, which lead to their customers."""
    n = entities(spark, sf_dir)
    tails = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tree"), (F.col("o_custkey") % n).alias("t"))
    s = Settings(dim=16, steps=3, negatives=1)
    return train(id_triples(spark, sf_dir), n, len(SEGMENTS), s, (tree_nodes(spark, sf_dir), tails)).entities.select("id", "vec")


def _tails(spark, sf_dir) -> DataFrame:
    """An order's own vector is its tail."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tree"), (F.col("o_orderkey") % entities(spark, sf_dir)).alias("t"))


def _graph_rows(spark, sf_dir) -> DataFrame:
    nodes, n = tree_nodes(spark, sf_dir), entities(spark, sf_dir)
    heads = S.corrupted_leaves(nodes.select("tree", "leaf"), n)
    others = _tails(spark, sf_dir).select("tree", F.explode(F.sequence(F.lit(1), F.lit(2)).cast("array<bigint>")).alias("variant")).withColumn("t", T.bucket(F.concat_ws("|", "tree", "variant"), n))
    return M.graph_score_rows(nodes, heads, _tails(spark, sf_dir), others, emb(spark, sf_dir), relations(spark, sf_dir), DIM, 24.0, depth=2)


def graph_scores(spark, sf_dir):
    """Orders against their own vectors, with corrupted leaves, and against two other vectors each."""
    return M.graph_scores_of(_graph_rows(spark, sf_dir)).select("tree", "kind", "variant", F.round("score", 5).alias("score"))


def graph_loss(spark, sf_dir):
    """Loss of the orders' scores, weighted by how often their form occurs, and the L3 term of all vectors."""
    rounded = lambda c: F.transform(c, lambda x: F.round(x, 5)).alias(c)
    rows = _graph_rows(spark, sf_dir).select("tree", F.round("own", 5).alias("own"), rounded("changed"), rounded("others"))
    forms = S.canonical(tree_nodes(spark, sf_dir).filter("leaf is not null").select("tree", F.array("parent").alias("path"), "leaf"))
    reg = M.regularisation(emb(spark, sf_dir), relations(spark, sf_dir), DIM, 1e-3)
    out = M.graph_loss_by_form(rows, forms.select("tree", F.unhex("form").alias("form"))).join(F.broadcast(reg))  # a row each
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


def graph_candidates(spark, sf_dir):
    """Forms of orders with the nations of their customers as tails."""
    n = tree_nodes(spark, sf_dir).filter("leaf is not null").select("tree", F.array("parent").alias("path"), F.col("leaf") % 3)
    n = n.toDF("tree", "path", "leaf")
    nation = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("tree"), F.col("c_nationkey").cast("bigint").alias("t"))
    named = n.groupBy("tree").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.get("path", F.lit(0)), F.lit("/"), "leaf"))), " ").alias("form"))
    return S.graph_candidates(named.join(nation, "tree"), _nations(spark, sf_dir))


def path_scores(spark, sf_dir):
    """From each part of an order over its return flag and the root to the order's vector."""
    n = tree_nodes(spark, sf_dir)
    flag = F.array_position(F.array(*map(F.lit, "ANR")), F.col("parent")) - 1
    paths = n.filter("leaf is not null").join(_tails(spark, sf_dir), "tree").select(F.struct("tree", "node").alias("key"), F.col("leaf").alias("h"), F.array(flag.cast("bigint"), F.lit(4).cast("bigint")).alias("rels"), "t")
    found = M.path_scores(paths, emb(spark, sf_dir), relations(spark, sf_dir), DIM, 24.0)
    return found.select("key.tree", "key.node", F.round("score", 5).alias("score"))


def instance_types(spark, sf_dir):
    """The edges of orders from parts to actions, and from actions to their classes."""
    e = flat_triples(spark, sf_dir).select(F.col("h").alias("src"), F.col("t").alias("dst"), F.col("r").alias("label"))
    return T.with_instance_types(e)


EMB = f"e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), rl AS (SELECT id - 100 AS id, v FROM e WHERE id BETWEEN 100 AND 104)"
TV = "tv AS (SELECT it.h, it.r, it.t, a.v AS hv, rl.v AS rv, b.v AS tv FROM it JOIN e a ON it.h = a.id JOIN rl ON it.r = rl.id JOIN e b ON it.t = b.id)"
_TRANSE = f"{GAMMA} - list_sum([abs(hv[i] + rv[i] - tv[i]) for i in range(1, {DIM + 1})])"
_DISTMULT = f"list_sum([hv[i] * rv[i] * tv[i] for i in range(1, {DIM + 1})])"
_HALF = DIM // 2
_PHASE = math.pi / M.embedding_range(GAMMA, _HALF)
_P = math.pi / M.embedding_range(GAMMA, DIM)
CAND = "known AS (SELECT DISTINCT h, r, t FROM it), cand AS (SELECT k.h, k.r, k.t, CAST(n_nationkey AS BIGINT) AS cand FROM known k, nation WHERE n_nationkey = k.t OR NOT EXISTS (SELECT 1 FROM known o WHERE o.h = k.h AND o.r = k.r AND o.t = n_nationkey))"
CSCORE = f"cs AS (SELECT h, r, t AS \"true\", cand, round({GAMMA} - list_sum([abs(hv[i] + rv[i] - tv[i]) for i in range(1, {DIM + 1})]), 6) AS score FROM (SELECT c.h, c.r, c.t, c.cand, a.v AS hv, rl.v AS rv, b.v AS tv FROM cand c JOIN e a ON c.h = a.id JOIN rl ON c.r = rl.id JOIN e b ON c.cand = b.id)), rk AS (SELECT h, r, \"true\", CAST(sum(CAST(score > own AS INT)) + 1 AS BIGINT) AS rank FROM (SELECT *, max(CASE WHEN cand = \"true\" THEN score END) OVER (PARTITION BY h, r, \"true\") AS own FROM cs) GROUP BY 1, 2, 3)"


def bucket_sql(key: str, n: int) -> str:
    return f"(CAST('0x' || substr(md5({key}), 1, 15) AS BIGINT) % {n})"


NEG = f"""base AS (SELECT DISTINCT h, r, t FROM it), dr AS (SELECT h, r, t, i AS attempt, {bucket_sql("concat_ws('|', h, r, t, i)", 25)} AS neg FROM base, range(1, 13) x(i)),
    cl AS (SELECT h, r, t, neg, min(attempt) AS attempt FROM dr WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.h = dr.h AND b.r = dr.r AND b.t = dr.neg) GROUP BY 1, 2, 3, 4),
    fi AS (SELECT h, r, t, neg, row_number() OVER (PARTITION BY h, r, t ORDER BY attempt) AS k FROM cl QUALIFY k <= 4), sh AS (SELECT h, r, t FROM base EXCEPT SELECT h, r, t FROM fi WHERE k = 4),
    ev AS (SELECT h, r, t, ({bucket_sql("concat_ws('|', h, r, t)", 25)} + s) % 25 AS neg, s FROM sh, range(0, 25) y(s)),
    re AS (SELECT h, r, t, neg, row_number() OVER (PARTITION BY h, r, t ORDER BY s) AS k FROM ev WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.h = ev.h AND b.r = ev.r AND b.t = ev.neg) QUALIFY k <= 4),
    ng AS (SELECT h, r, t, neg, k FROM fi WHERE (h, r, t) NOT IN (SELECT (h, r, t) FROM sh) UNION ALL SELECT h, r, t, neg, k FROM re)"""
WEIGHTS = "wt AS (SELECT it.h, it.r, it.t, sqrt(1 / (a.c + b.c)) AS w FROM it JOIN (SELECT h, r, count(*) + 3 AS c FROM it GROUP BY 1, 2) a ON it.h = a.h AND it.r = a.r JOIN (SELECT t, r, count(*) + 3 AS c FROM it GROUP BY 1, 2) b ON it.t = b.t AND it.r = b.r)"
TREE = f"lv AS (SELECT DISTINCT l_orderkey AS tree, l_returnflag AS flag, l_partkey % {ENTITIES} AS leaf FROM lineitem)"


def gop_sql(act: str, top: str) -> str:
    return f"""WITH {EMB}, {TREE}, d(i) AS (VALUES (1), ({DIM})), x AS (SELECT tree, flag, i, avg(e.v[i]) AS m FROM lv JOIN e ON lv.leaf = e.id, d GROUP BY 1, 2, 3),
        y AS (SELECT tree, i, avg({act}) AS m FROM x JOIN rl ON rl.id = list_position(['A', 'N', 'R'], flag) - 1 GROUP BY 1, 2), z AS (SELECT tree, i, {top} AS v FROM y, (SELECT v FROM rl WHERE id = 4) r)
        SELECT tree, round(max(CASE WHEN i = 1 THEN v END), 6) + 0.0 AS first, round(max(CASE WHEN i = {DIM} THEN v END), 6) + 0.0 AS last FROM z GROUP BY tree"""


def subst_sql(against: str) -> str:
    """A tree's value is linear in its leaves: an exchange adds the leaf's weight times the difference."""
    return f"""WITH {EMB}, {TREE}, fl AS (SELECT tree, flag, count(*) AS n FROM lv GROUP BY 1, 2), nf AS (SELECT tree, count(*) AS nf FROM fl GROUP BY 1),
        x AS (SELECT tree, flag, i, avg(e.v[i]) AS m FROM lv JOIN e ON lv.leaf = e.id, range(1, {DIM + 1}) d(i) GROUP BY 1, 2, 3), y AS (SELECT tree, i, avg(m + rl.v[i]) AS m FROM x JOIN rl ON rl.id = list_position(['A', 'N', 'R'], flag) - 1 GROUP BY 1, 2),
        o AS (SELECT tree, list(m + r.v[i] ORDER BY i) AS v FROM y, (SELECT v FROM rl WHERE id = 4) r GROUP BY tree),
        tg AS (SELECT l_orderkey AS tree, min(l_partkey % {ENTITIES}) AS target FROM lineitem GROUP BY 1), wt AS (SELECT tg.tree, target, sum(1.0 / (nf * n)) AS w FROM tg JOIN lv ON lv.tree = tg.tree AND lv.leaf = target JOIN fl ON fl.tree = lv.tree AND fl.flag = lv.flag JOIN nf ON nf.tree = tg.tree GROUP BY 1, 2),
        c AS (SELECT DISTINCT l_orderkey AS tree, l_suppkey % {ENTITIES} AS cand FROM lineitem),
        k AS (SELECT c.tree, target, cand, {against} AS a, [o.v[i] + w * (p.v[i] - q.v[i]) for i in range(1, {DIM + 1})] AS b FROM c JOIN wt ON c.tree = wt.tree JOIN o ON o.tree = c.tree JOIN e p ON p.id = cand JOIN e q ON q.id = target JOIN e g ON g.id = c.tree % {ENTITIES})
        SELECT tree, target, cand, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) AS score FROM k"""


def _log_sigmoid(x: str) -> str:
    return f"(-ln(1 + exp(-abs({x}))) + least({x}, 0))"


FUNCTIONS = (
    graph_scores, graph_loss, graph_candidates, path_scores, instance_types, triples_union, known_subclass_triples, dict_encode, encoded_triples, split_hash, leak_anti, node_roles, two_way_edges, freq_start4, subsample_weight, true_tail, true_head, neg_sample, eval_candidates,
    score_transe, score_distmult, score_complex, score_rotate, score_protate, filtered_ranks, mrr_hits, predict_tails, adv_loss, gop_transe, gop_distmult, gop_rotate, leaf_counts, tree_frequency, head_paths, corrupted_leaves, hyper_triples, subst_calc, subst_learned, tree_paths, flat_triples, trained_entities,
)
QUERIES = {f.__name__: f for f in FUNCTIONS}
_PART = f"pt AS (SELECT *, CASE WHEN b < 15 THEN 'test' WHEN b < 30 THEN 'valid' ELSE 'train' END AS part FROM (SELECT *, {bucket_sql('concat_ws(chr(124), h, r, t)', 100)} AS b FROM nt))"
CORRUPT = f"""cl AS (SELECT DISTINCT tree, leaf FROM lv), cd AS (SELECT tree, leaf, i AS attempt, {bucket_sql("concat_ws('|', tree, leaf, i)", ENTITIES)} AS replacement FROM cl, range(1, 9) x(i)),
    cb AS (SELECT tree, leaf, arg_min(replacement, attempt) AS replacement FROM cd WHERE NOT EXISTS (SELECT 1 FROM cl WHERE cl.tree = cd.tree AND cl.leaf = cd.replacement) GROUP BY 1, 2),
    ck AS (SELECT cl.tree, cl.leaf, {bucket_sql("concat_ws('|', cl.tree, cl.leaf)", ENTITIES)} AS start FROM cl WHERE NOT EXISTS (SELECT 1 FROM cb WHERE cb.tree = cl.tree AND cb.leaf = cl.leaf)),
    cr AS (SELECT tree, leaf, (start + i) % {ENTITIES} AS replacement, i FROM (SELECT *, unnest(range(0, {ENTITIES})) AS i FROM ck)),
    cf AS (SELECT tree, leaf, arg_min(replacement, i) AS replacement FROM cr WHERE NOT EXISTS (SELECT 1 FROM cl WHERE cl.tree = cr.tree AND cl.leaf = cr.replacement) GROUP BY 1, 2),
    cv AS (SELECT tree, CAST(row_number() OVER (PARTITION BY tree ORDER BY leaf) AS BIGINT) AS variant, leaf, replacement FROM (SELECT * FROM cb UNION ALL SELECT * FROM cf))"""
# a tree's value is linear in its leaves
VALUE = f"""fl AS (SELECT tree, flag, count(*) AS n FROM lv GROUP BY 1, 2), nf AS (SELECT tree, count(*) AS nf FROM fl GROUP BY 1), vx AS (SELECT tree, flag, i, avg(e.v[i]) AS m FROM lv JOIN e ON lv.leaf = e.id, range(1, {DIM + 1}) d(i) GROUP BY 1, 2, 3),
    vy AS (SELECT tree, i, avg(m + rl.v[i]) AS m FROM vx JOIN rl ON rl.id = list_position(['A', 'N', 'R'], flag) - 1 GROUP BY 1, 2), vo AS (SELECT tree, list(m + r.v[i] ORDER BY i) AS v FROM vy, (SELECT v FROM rl WHERE id = 4) r GROUP BY tree)"""
_NEAR = f"24.0 - list_sum([abs(a[i] - b[i]) for i in range(1, {DIM + 1})])"
GRAPH = f"""{CORRUPT}, {VALUE}, ot AS (SELECT o_orderkey AS tree, o_orderkey % {ENTITIES} AS t FROM orders), ng AS (SELECT tree, variant, {bucket_sql("concat_ws('|', tree, variant)", ENTITIES)} AS t FROM ot, range(1, 3) x(variant)),
    wl AS (SELECT cv.tree, variant, leaf, replacement, sum(1.0 / (nf * n)) AS w FROM cv JOIN lv USING (tree, leaf) JOIN fl ON fl.tree = cv.tree AND fl.flag = lv.flag JOIN nf ON nf.tree = cv.tree GROUP BY 1, 2, 3, 4),
    hd AS (SELECT wl.tree, variant, [vo.v[i] + w * (p.v[i] - q.v[i]) for i in range(1, {DIM + 1})] AS v FROM wl JOIN vo ON vo.tree = wl.tree JOIN e p ON p.id = replacement JOIN e q ON q.id = leaf),
    ab AS (SELECT vo.tree, 'positive' AS kind, CAST(0 AS BIGINT) AS variant, vo.v AS a, e.v AS b FROM vo JOIN ot ON ot.tree = vo.tree JOIN e ON e.id = ot.t UNION ALL SELECT hd.tree, 'head', variant, hd.v, e.v FROM hd JOIN ot ON ot.tree = hd.tree JOIN e ON e.id = ot.t
        UNION ALL SELECT vo.tree, 'tail', variant, vo.v, e.v FROM vo JOIN ng ON ng.tree = vo.tree JOIN e ON e.id = ng.t), gs AS (SELECT tree, kind, variant, round({_NEAR}, 5) AS score FROM ab)"""
FORMS = "fm AS (SELECT tree, list_sort(list(DISTINCT flag || '/' || leaf)) AS form FROM lv GROUP BY tree)"
ORACLE = {
    "graph_scores": f"WITH {EMB}, {TREE}, {GRAPH} SELECT tree, kind, variant, score FROM gs",
    "graph_loss": f"""WITH {EMB}, {TREE}, {GRAPH}, {FORMS}, w AS (SELECT tree, sqrt(1 / (c + 3)) AS w FROM fm JOIN (SELECT form, count(*) AS c FROM fm GROUP BY form) USING (form)), ps AS (SELECT tree, score, w FROM gs JOIN w USING (tree) WHERE kind = 'positive'),
        aa AS (SELECT tree, kind, sum(exp(score - m) * {_log_sigmoid('(-score)')}) / sum(exp(score - m)) AS a FROM (SELECT *, max(score) OVER (PARTITION BY tree, kind) AS m FROM gs WHERE kind <> 'positive') GROUP BY 1, 2),
        hl AS (SELECT -sum(w * {_log_sigmoid('score')}) / sum(w) AS p, -sum(w * a) / sum(w) AS n FROM ps JOIN aa USING (tree) WHERE kind = 'head'), tl AS (SELECT -sum(w * a) / sum(w) AS n FROM ps JOIN aa USING (tree) WHERE kind = 'tail'),
        rg AS (SELECT 0.001 * sum(list_sum([pow(abs(x), 3) for x in v])) AS reg FROM (SELECT v FROM e UNION ALL SELECT v FROM rl))
        SELECT round(p, 4) AS pos_loss, round(hl.n + tl.n, 4) AS neg_loss, round((p + hl.n + tl.n) / 2, 4) AS loss, round(reg, 4) AS reg FROM hl, tl, rg""",
    "graph_candidates": f"""WITH {TREE}, fm AS (SELECT tree, array_to_string(list_sort(list(DISTINCT flag || '/' || (leaf % 3))), ' ') AS form FROM lv GROUP BY tree), k AS (SELECT DISTINCT form, CAST(c_nationkey AS BIGINT) AS t FROM fm JOIN orders ON o_orderkey = tree JOIN customer ON o_custkey = c_custkey)
        SELECT k.form, k.t, CAST(n_nationkey AS BIGINT) AS cand FROM k, nation WHERE n_nationkey = k.t OR NOT EXISTS (SELECT 1 FROM k o WHERE o.form = k.form AND o.t = n_nationkey)""",
    "path_scores": f"WITH {EMB}, {TREE}, p AS (SELECT tree, flag || '/' || leaf AS node, h.v AS h, rl.v AS r, t.v AS t FROM lv JOIN e h ON h.id = leaf JOIN rl ON rl.id = list_position(['A', 'N', 'R'], flag) - 1 JOIN e t ON t.id = tree % {ENTITIES}) SELECT tree, node, round(24.0 - list_sum([abs(h[i] + p.r[i] + q.v[i] - t[i]) for i in range(1, {DIM + 1})]), 5) AS score FROM p, (SELECT v FROM rl WHERE id = 4) q",
    "instance_types": f"WITH {TREE}, x AS (SELECT flag || '/' || leaf AS src, 'pred_' || flag || '_' || tree AS dst, 'pred ' || flag AS label FROM lv) SELECT src, dst, label FROM x UNION ALL SELECT dst, label, 'class_pred_type' FROM x",
    "triples_union": f"WITH {NAMED} SELECT h, r, t FROM nt",
    "known_subclass_triples": f"WITH {NAMED} SELECT DISTINCT 'C' || s_suppkey AS h, 'sub' AS r, 'N' || s_nationkey AS t FROM supplier WHERE 'C' || s_suppkey IN (SELECT h FROM nt) AND 'N' || s_nationkey IN (SELECT h FROM nt)",
    "dict_encode": f"WITH {NAMED} SELECT CAST(row_number() OVER (ORDER BY name) - 1 AS BIGINT) AS id, name FROM (SELECT h AS name FROM nt UNION SELECT t FROM nt)",
    "encoded_triples": f"WITH {NAMED}, en AS (SELECT row_number() OVER (ORDER BY name) - 1 AS id, name FROM (SELECT h AS name FROM nt UNION SELECT t FROM nt)), rn AS (SELECT row_number() OVER (ORDER BY name) - 1 AS id, name FROM (SELECT DISTINCT r AS name FROM nt)) SELECT a.id AS h, rn.id AS r, b.id AS t FROM nt JOIN en a ON nt.h = a.name JOIN rn ON nt.r = rn.name JOIN en b ON nt.t = b.name",
    "split_hash": f"WITH {NAMED}, {_PART} SELECT h, r, t, part FROM pt",
    "leak_anti": f"WITH {NAMED}, {_PART}, s AS (SELECT regexp_replace(h, '[0-9]{{3}}$', '') AS h, r, t, part FROM pt) SELECT h, r, t FROM s WHERE part = 'test' AND (h, r, t) NOT IN (SELECT (h, r, t) FROM s WHERE part = 'train')",
    "node_roles": f"""WITH {NAMED}, g AS (SELECT h AS src, t AS dst FROM nt WHERE r <> 'type'), n AS (SELECT src AS node FROM g UNION SELECT dst FROM g),
        k AS (SELECT node, node IN (SELECT dst FROM g) AS i, node IN (SELECT 'R' || r_regionkey FROM region) AS o, node IN (SELECT 'N' || n_nationkey FROM nation WHERE n_nationkey < 5) AS y FROM n)
        SELECT node, CAST(NOT i AND NOT o AND NOT y AS INT) AS leaf, CAST(i AND NOT o AND NOT y AS INT) AS intermediate, CAST(y AS INT) AS intermediate_type, CAST(o AS INT) AS output, 0 AS external FROM k
        UNION ALL SELECT x, 0, 0, 0, 0, 1 FROM (SELECT 'C' || s_suppkey AS x FROM supplier UNION SELECT s_name FROM supplier) WHERE x NOT IN (SELECT node FROM n)""",
    "two_way_edges": f"WITH {NAMED} SELECT h AS src, t AS dst FROM nt UNION ALL SELECT t, h FROM nt",
    "freq_start4": f"WITH {IDS} SELECT 'head' AS side, h AS e, r, CAST(count(*) + 3 AS BIGINT) AS c FROM it GROUP BY h, r UNION ALL SELECT 'tail', t, r, CAST(count(*) + 3 AS BIGINT) FROM it GROUP BY t, r",
    "subsample_weight": f"WITH {IDS}, {WEIGHTS} SELECT h, r, t, round(w, 9) AS w FROM wt",
    "true_tail": f"WITH {IDS} SELECT h, r, list_sort(list(DISTINCT t)) AS tails FROM it GROUP BY h, r",
    "true_head": f"WITH {IDS} SELECT r, t, list_sort(list(DISTINCT h)) AS heads FROM it GROUP BY r, t",
    "neg_sample": f"WITH {IDS}, {NEG} SELECT h, r, t, neg, CAST(k AS BIGINT) AS k FROM ng",
    "eval_candidates": f"WITH {IDS}, {CAND} SELECT h, r, t, cand FROM cand",
    "score_transe": f"WITH {IDS}, {EMB}, {TV} SELECT h, r, t, round({_TRANSE}, 6) AS score FROM tv",
    "score_distmult": f"WITH {IDS}, {EMB}, {TV} SELECT h, r, t, round({_DISTMULT}, 6) AS score FROM tv",
    "score_complex": f"WITH {IDS}, {EMB}, {TV} SELECT h, r, t, round(list_sum([(hv[i] * rv[i] - hv[i + {_HALF}] * rv[i + {_HALF}]) * tv[i] + (hv[i] * rv[i + {_HALF}] + hv[i + {_HALF}] * rv[i]) * tv[i + {_HALF}] for i in range(1, {_HALF + 1})]), 6) AS score FROM tv",
    "score_rotate": f"WITH {IDS}, {EMB}, {TV} SELECT h, r, t, round({GAMMA} - list_sum([sqrt(pow(hv[i] * cos(rv[i] * {_PHASE!r}) - hv[i + {_HALF}] * sin(rv[i] * {_PHASE!r}) - tv[i], 2) + pow(hv[i] * sin(rv[i] * {_PHASE!r}) + hv[i + {_HALF}] * cos(rv[i] * {_PHASE!r}) - tv[i + {_HALF}], 2)) for i in range(1, {_HALF + 1})]), 6) AS score FROM tv",
    "score_protate": f"WITH {IDS}, {EMB}, {TV} SELECT h, r, t, round({GAMMA} - list_sum([abs(sin(hv[i] * {_P!r} + rv[i] * {_P!r} - tv[i] * {_P!r})) for i in range(1, {DIM + 1})]) * {0.5 * M.embedding_range(GAMMA, DIM)!r}, 6) AS score FROM tv",
    "filtered_ranks": f'WITH {IDS}, {EMB}, {CAND}, {CSCORE} SELECT h, r, "true", rank FROM rk',
    "mrr_hits": f"WITH {IDS}, {EMB}, {CAND}, {CSCORE} SELECT round(avg(1 / rank), 9) AS mrr, round(avg(rank), 9) AS mr, {', '.join(f'round(avg(CAST(rank <= {k} AS DOUBLE)), 9) AS hits_{k}' for k in (1, 3, 10, 100))} FROM rk",
    "predict_tails": f"WITH {IDS}, {EMB}, q AS (SELECT DISTINCT h, r, CAST(n_nationkey AS BIGINT) AS t FROM it, nation), x AS (SELECT q.h, q.r, q.t, a.v AS hv, rl.v AS rv, b.v AS tv FROM q JOIN e a ON q.h = a.id JOIN rl ON q.r = rl.id JOIN e b ON q.t = b.id), s AS (SELECT h, r, t, round({_DISTMULT}, 9) AS score FROM x) SELECT *, CAST(row_number() OVER (PARTITION BY h, r ORDER BY score DESC, t) AS BIGINT) AS place FROM s",
    "adv_loss": f"""WITH {IDS}, {EMB}, {WEIGHTS}, {NEG}, w1 AS (SELECT DISTINCT h, r, t, w FROM wt), ps AS (SELECT w1.h, w1.r, w1.t, w, round({GAMMA} - list_sum([abs(a.v[i] + rl.v[i] - b.v[i]) for i in range(1, {DIM + 1})]), 6) AS s FROM w1 JOIN e a ON w1.h = a.id JOIN rl ON w1.r = rl.id JOIN e b ON w1.t = b.id),
        ns AS (SELECT ng.h, ng.r, ng.t, round({GAMMA} - list_sum([abs(a.v[i] + rl.v[i] - b.v[i]) for i in range(1, {DIM + 1})]), 6) AS s FROM ng JOIN e a ON ng.h = a.id JOIN rl ON ng.r = rl.id JOIN e b ON ng.neg = b.id),
        aa AS (SELECT h, r, t, sum(exp(s - m) * {_log_sigmoid('(-s)')}) / sum(exp(s - m)) AS a FROM (SELECT *, max(s) OVER (PARTITION BY h, r, t) AS m FROM ns) GROUP BY 1, 2, 3),
        l AS (SELECT -sum(w * {_log_sigmoid('s')}) / sum(w) AS p, -sum(w * a) / sum(w) AS n FROM ps JOIN aa USING (h, r, t)) SELECT round(p, 6) AS pos_loss, round(n, 6) AS neg_loss, round((p + n) / 2, 6) AS loss FROM l""",
    "gop_transe": gop_sql("m + rl.v[i]", "m + r.v[i]"),
    "gop_distmult": gop_sql("m * rl.v[i]", "m * r.v[i]"),
    "gop_rotate": f"""WITH {EMB}, {TREE}, x AS (SELECT tree, flag, avg(e.v[1]) AS a, avg(e.v[{_HALF + 1}]) AS b FROM lv JOIN e ON lv.leaf = e.id GROUP BY 1, 2),
        y AS (SELECT tree, avg(a * cos(p) - b * sin(p)) AS a, avg(a * sin(p) + b * cos(p)) AS b FROM (SELECT x.*, rl.v[1] * {math.pi / M.embedding_range(24.0, _HALF)!r} AS p FROM x JOIN rl ON rl.id = list_position(['A', 'N', 'R'], flag) - 1) GROUP BY tree)
        SELECT tree, round(a * cos(p) - b * sin(p), 5) + 0.0 AS first FROM y, (SELECT v[1] * {math.pi / M.embedding_range(24.0, _HALF)!r} AS p FROM rl WHERE id = 4)""",
    "leaf_counts": f"WITH {TREE} SELECT tree, CAST(count(*) AS BIGINT) AS leaves, CAST(count(DISTINCT leaf) AS BIGINT) AS distinct_leaves FROM lv GROUP BY tree",
    "tree_frequency": f"WITH {TREE}, f AS (SELECT tree, list_sort(list(DISTINCT flag || '/' || leaf)) AS form FROM lv GROUP BY tree), c AS (SELECT form, count(*) + 3 AS c FROM f GROUP BY form) SELECT CAST(c AS BIGINT) AS c, CAST(count(*) AS BIGINT) AS forms FROM c GROUP BY c",
    "head_paths": f"WITH {TREE} SELECT tree, leaf, [flag, 'root'] AS path FROM lv",
    "corrupted_leaves": f"""WITH {TREE}, l AS (SELECT DISTINCT tree, leaf FROM lv), d AS (SELECT tree, leaf, i AS attempt, {bucket_sql("concat_ws('|', tree, leaf, i)", ENTITIES)} AS replacement FROM l, range(1, 9) x(i)),
        b AS (SELECT tree, leaf, arg_min(replacement, attempt) AS replacement FROM d WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.tree = d.tree AND l.leaf = d.replacement) GROUP BY 1, 2)
        , s AS (SELECT l.tree, l.leaf, {bucket_sql("concat_ws('|', l.tree, l.leaf)", ENTITIES)} AS start FROM l WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.tree = l.tree AND b.leaf = l.leaf)),
        r AS (SELECT tree, leaf, (start + i) % {ENTITIES} AS replacement, i FROM (SELECT *, unnest(range(0, {ENTITIES})) AS i FROM s)),
        c AS (SELECT tree, leaf, arg_min(replacement, i) AS replacement FROM r WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.tree = r.tree AND l.leaf = r.replacement) GROUP BY 1, 2)
        SELECT tree, CAST(row_number() OVER (PARTITION BY tree ORDER BY leaf) AS BIGINT) AS variant, leaf, replacement FROM (SELECT * FROM b UNION ALL SELECT * FROM c)""",
    "subst_calc": subst_sql("o.v"),
    "subst_learned": subst_sql("g.v"),
    "tree_paths": f"""WITH RECURSIVE {TREE}, ed AS (SELECT tree, flag AS parent, flag || '/' || leaf AS child FROM lv UNION SELECT tree, 'root', flag FROM lv),
        w AS (SELECT tree, child AS node, 'root>' || child AS path, CAST(1 AS BIGINT) AS depth FROM ed WHERE parent = 'root' UNION ALL SELECT w.tree, ed.child, w.path || '>' || ed.child, w.depth + 1 FROM w JOIN ed ON ed.tree = w.tree AND ed.parent = w.node) SELECT tree, path, depth FROM w""",
    "flat_triples": f"WITH {TREE} SELECT tree, flag || '/' || leaf AS h, 'pred ' || flag AS r, 'pred_' || flag || '_' || tree AS t FROM lv",
    "hyper_triples": f"WITH {TREE} SELECT tree, flag AS action, list_sort(list(DISTINCT flag || '/' || leaf)) AS inputs FROM lv GROUP BY tree, flag UNION ALL SELECT tree, 'root', list_sort(list(DISTINCT flag)) FROM lv GROUP BY tree",
}
