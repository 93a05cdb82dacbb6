"""Training triples, encodings, splits and operation trees from flow graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladle.session import ensure_checkpoint_dir


def triples(*parts: DataFrame) -> DataFrame:
    """h, r, t: the distinct union of parts that have these columns."""
    return reduce(lambda a, b: a.unionByName(b), [p.select("h", "r", "t") for p in parts]).distinct()


def typed(nodes: DataFrame, node: str, relation: str, kind: str) -> DataFrame:
    return nodes.select(F.col(node).alias("h"), F.lit(relation).alias("r"), F.lit(kind).alias("t"))


def among_known(edges: DataFrame, known: DataFrame, relation: str) -> DataFrame:
    """h, r, t for edges src -> dst both ends of which are known (known: node)."""
    e = edges.join(known, edges["src"] == known["node"], "left_semi").join(known, edges["dst"] == known["node"], "left_semi")
    return e.select(F.col("src").alias("h"), F.lit(relation).alias("r"), F.col("dst").alias("t"))


def dictionary(values: DataFrame, name: str = "name", ranges: int = 64) -> DataFrame:
    """id, name: dense ids from 0 in the order of names.

    Positions are counted within ranges of names and shifted by the sizes of the ranges before, so no
    single task sorts all names.
    """
    distinct = values.select(F.col(name).alias("name")).filter("name is not null").distinct()
    ensure_checkpoint_dir(values.sparkSession)
    dealt = distinct.repartitionByRange(ranges, "name").withColumn("part", F.spark_partition_id()).checkpoint()
    sizes = dealt.groupBy("part").count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    shift = sizes.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("name")) - 1
    return dealt.withColumn("k", within).join(F.broadcast(shift), "part").select((F.col("k") + F.col("shift")).cast("bigint").alias("id"), "name")


def encode(t: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Ids in place of names; triples with an unknown name drop out."""
    h = entities.select(F.col("id").alias("hid"), F.col("name").alias("h"))
    r = relations.select(F.col("id").alias("rid"), F.col("name").alias("r"))
    o = entities.select(F.col("id").alias("tid"), F.col("name").alias("t"))
    return t.join(h, "h").join(r, "r").join(o, "t").select(F.col("hid").alias("h"), F.col("rid").alias("r"), F.col("tid").alias("t"))


def bucket(key: Column, buckets: int = 100) -> Column:
    """A number below `buckets` from the first hex digits of md5, the same in any engine."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("bigint") % buckets


def split(df: DataFrame, key: Column, valid: int = 15, test: int = 15) -> DataFrame:
    """df and `part`: train, valid or test, about 70/15/15, by hash of the key."""
    b = bucket(key)
    return df.withColumn("part", F.when(b < test, "test").when(b < test + valid, "valid").otherwise("train"))


def without_leaks(held: DataFrame, train: DataFrame) -> DataFrame:
    """Held-out triples that training doesn't have."""
    return held.join(train.select("h", "r", "t").distinct(), ["h", "r", "t"], "left_anti")


def prune_childless(edges: DataFrame, kept: DataFrame, key: str, most_rounds: int = 1000) -> DataFrame:
    """Edges parent -> child left when childless nodes that are not `kept` (key, node) go, again and again."""
    ensure_checkpoint_dir(edges.sparkSession)
    rest = edges.select(key, "parent", "child").distinct().checkpoint()
    count = rest.count()
    good = kept.select(key, F.col("node").alias("child"))
    for _ in range(most_rounds):
        parents = rest.select(key, F.col("parent").alias("child"))
        rest = rest.join(parents.unionByName(good).distinct(), [key, "child"], "left_semi").select(key, "parent", "child").checkpoint()
        now = rest.count()
        if now == count:
            return rest
        count = now
    raise RuntimeError("the pruning did not end")


def operation_tree(edges: DataFrame, key: str, root: str, most_depth: int = 100) -> DataFrame:
    """key, path, node, depth: every node of the tree unrolled from the root; a node with several
    parents comes once for each way to it. edges: key, parent, child."""
    ensure_checkpoint_dir(edges.sparkSession)
    level = edges.filter(F.col("parent") == root).select(key, F.col("child").alias("node")).distinct().withColumn("path", F.array(F.lit(root), F.col("node"))).withColumn("depth", F.lit(1))
    found = level
    step = edges.select(key, F.col("parent").alias("node"), "child").distinct()
    for depth in range(2, most_depth):
        level = level.join(step, [key, "node"]).select(key, F.col("child").alias("node"), F.concat("path", F.array("child")).alias("path"), F.lit(depth).alias("depth")).checkpoint()
        if level.isEmpty():
            return found.select(key, "path", "node", "depth")
        found = found.unionByName(level)
    raise RuntimeError("the tree is too deep or has a cycle")


def flat_triples(edges: DataFrame, key: str) -> DataFrame:
    """key, h, r, t: an edge parent -> child as (child, the parent's action, parent)."""
    return edges.select(key, F.col("child").alias("h"), F.array_join(F.slice(F.split("parent", "_"), 1, 2), " ").alias("r"), F.col("parent").alias("t"))


def hyper_triples(edges: DataFrame, key: str) -> DataFrame:
    """key, action, inputs: what flows into each node."""
    return edges.groupBy(key, F.col("dst").alias("action")).agg(F.array_sort(F.collect_set("src")).alias("inputs"))


def reversed_edges(edges: DataFrame) -> DataFrame:
    """The edges and the same edges the other way round."""
    return edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def node_roles(edges: DataFrame, outputs: DataFrame, types: DataFrame, external: DataFrame) -> DataFrame:
    """node and five 0/1 columns: leaf, intermediate, intermediate_type, output, external.

    edges: src, dst; outputs, types, external: node. External nodes are those not in the graph.
    """
    inner = edges.groupBy(F.col("dst").alias("node")).agg(F.lit(1).alias("has_in"))
    nodes = edges.select(F.col("src").alias("node")).unionAll(edges.select("dst")).distinct()
    mark = lambda df, name: df.select("node").distinct().withColumn(name, F.lit(1))
    own = nodes.join(inner, "node", "left").join(mark(outputs, "is_out"), "node", "left").join(mark(types, "is_type"), "node", "left")
    known = own.select("node", *[(F.coalesce(c, F.lit(0)) == 1).alias(c) for c in ("has_in", "is_out", "is_type")])
    roles = known.select(
        "node",
        (~F.col("has_in") & ~F.col("is_out") & ~F.col("is_type")).cast("int").alias("leaf"),
        (F.col("has_in") & ~F.col("is_out") & ~F.col("is_type")).cast("int").alias("intermediate"),
        F.col("is_type").cast("int").alias("intermediate_type"),
        F.col("is_out").cast("int").alias("output"),
        F.lit(0).alias("external"),
    )
    outside = external.select("node").distinct().join(nodes, "node", "left_anti")
    return roles.unionByName(outside.select("node", *[F.lit(0).alias(c) for c in ("leaf", "intermediate", "intermediate_type", "output")], F.lit(1).alias("external")))


def with_instance_types(edges: DataFrame) -> DataFrame:
    """src, dst, label: the edges (src, dst, label) and, for each action that something leads to, an edge from it to
    its class, 'pred verb', once for each of its in-edges."""
    kind = F.array_join(F.slice(F.split("dst", "_"), 1, 2), " ")
    typed_ = edges.filter(F.col("dst").startswith("pred_")).select(F.col("dst").alias("src"), kind.alias("dst"), F.lit("class_pred_type").alias("label"))
    return edges.select("src", "dst", "label").unionByName(typed_)
