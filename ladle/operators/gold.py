"""Reduction of hand-annotated flow graphs to ingredients and actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladle.functions.nlp import base_name
from ladle.operators.closure import closure
from ladle.session import ensure_checkpoint_dir


def merged_tokens(tokens: DataFrame, key: str, order: list[str], word: str, tag: str, begin: str, inside: str) -> DataFrame:
    """key, tokens' order columns and `merged`: each begin-tagged word with the inside-tagged words that
    follow it directly, at the begin token."""
    w = Window.partitionBy(key).orderBy(*order)
    t = tokens.withColumn("__starts", (F.col(tag) == begin).cast("int")).withColumn("__other", (~F.col(tag).isin(begin, inside)).cast("int"))
    t = t.withColumn("__island", F.sum("__starts").over(w)).withColumn("__gaps", F.sum("__other").over(w))
    first = Window.partitionBy(key, "__island")
    t = t.filter(F.col(tag).isin(begin, inside) & (F.col("__island") > 0)).withColumn("__own", F.min(F.when(F.col(tag) == begin, F.col("__gaps"))).over(first)).filter("__gaps = __own")
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(word).alias("__word"))))
    g = t.groupBy(key, "__island").agg(parts.alias("x"))
    return g.select(key, *[F.col("x")[0][o].alias(o) for o in order], F.array_join(F.transform("x", lambda e: e["__word"]), " ").alias("merged"))


def sentences(tokens: DataFrame, key: str, order: list[str], word: str, by: list[str]) -> DataFrame:
    """key, by, sentence: the words of each step and sentence in order."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(word).alias("w"))))
    return tokens.groupBy(key, *by).agg(F.array_join(F.transform(parts, lambda e: e["w"]), " ").alias("sentence"))


def degrees(edges: DataFrame, key: str) -> DataFrame:
    """key, node, n_in, n_out."""
    out = edges.groupBy(key, F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_out"))
    into = edges.groupBy(key, F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_in"))
    return out.join(into, [key, "node"], "full").select(key, "node", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))


def dropped(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Edges without those that touch the nodes (key, node)."""
    e = edges.join(nodes.select(key, F.col("node").alias("src")), [key, "src"], "left_anti")
    return e.join(nodes.select(key, F.col("node").alias("dst")), [key, "dst"], "left_anti").select(key, "src", "dst")


def bypassed(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """The nodes are taken out and what fed each feeds what it fed."""
    n = nodes.select(key, "node").distinct()
    into = edges.select(key, "src", F.col("dst").alias("node")).join(n, [key, "node"], "left_semi")
    out = edges.select(key, F.col("src").alias("node"), "dst").join(n, [key, "node"], "left_semi")
    through = into.join(out, [key, "node"]).filter("src <> dst").select(key, "src", "dst")
    return dropped(edges, n, key).unionByName(through).distinct()


def reduce_graph(edges: DataFrame, nodes: DataFrame, links: DataFrame, key: str, most_rounds: int = 200) -> DataFrame:
    """Reduction to a fixpoint. edges: key, src, dst; nodes: key, node, tag; links: key, src, dst, link.

    In turn: sources that are no food (F...) go; Sf and St nodes go; tool nodes (T...) are bypassed if
    one edge leads in and one out, else go; targets of f-eq are bypassed; sources of v... links go;
    targets of f-part-of whose source is still there are bypassed; Q nodes go.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.select(key, "src", "dst").distinct().checkpoint()
    tagged = lambda *starts: nodes.filter(" or ".join(f"tag like '{s}%'" for s in starts)).select(key, "node")
    before = None
    for _ in range(most_rounds):
        # every step reads its graph several times, so each is written down
        loose = degrees(e, key).filter("n_in = 0").join(nodes.filter("tag not like 'F%'"), [key, "node"], "left_semi")
        e = dropped(dropped(e, loose, key), nodes.filter("tag in ('Sf', 'St')"), key).checkpoint()
        d = degrees(e, key).join(tagged("T"), [key, "node"], "left_semi").checkpoint()
        e = dropped(bypassed(e, d.filter("n_in = 1 and n_out = 1"), key), d.filter("not (n_in = 1 and n_out = 1)"), key).checkpoint()
        e = bypassed(e, links.filter("link = 'f-eq'").select(key, F.col("dst").alias("node")), key)
        e = dropped(e, links.filter("link like 'v%'").select(key, F.col("src").alias("node")), key).checkpoint()
        still = e.select(key, "src").distinct()
        e = bypassed(e, links.filter("link = 'f-part-of'").join(still, [key, "src"], "left_semi").select(key, F.col("dst").alias("node")), key)
        e = dropped(e, nodes.filter("tag = 'Q'"), key).checkpoint()
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64(key, "src", "dst").cast("decimal(38,0)"))).first())
        if now == before:
            return e
        before = now
    raise RuntimeError("the reduction did not settle")


def main_ancestors(edges: DataFrame, key: str) -> DataFrame:
    """Edges between ancestors of the sink that has most (smallest name on ties), the sink included."""
    pair = lambda c: F.struct(F.col(key).alias("k"), F.col(c).alias("n"))
    reach = closure(edges.select(pair("src").alias("src"), pair("dst").alias("dst"))).checkpoint()
    sources = edges.select(key, F.col("src").alias("dst"))
    sinks = edges.select(key, "dst").distinct().join(sources, [key, "dst"], "left_anti").select(pair("dst").alias("dst"))
    size = reach.join(sinks, "dst", "left_semi").groupBy("dst").agg(F.count(F.lit(1)).alias("size"))
    best = size.groupBy(F.col("dst.k").alias("k")).agg(F.min_by("dst", F.struct(-F.col("size"), F.col("dst.n"))).alias("dst"))
    kept = reach.join(best.select("dst"), "dst", "left_semi").select(F.col("src.k").alias(key), F.col("src.n").alias("node"))
    e = edges.join(kept.withColumnRenamed("node", "src"), [key, "src"], "left_semi")
    return e.join(kept.withColumnRenamed("node", "dst"), [key, "dst"], "left_semi").select(key, "src", "dst")


def action_name(word: Column, node: Column) -> Column:
    return F.concat(F.lit("pred "), word, F.lit("_"), node.cast("string"))


def canonical_edges(edges: DataFrame, key: str) -> DataFrame:
    """key, src, dst with actions as 'pred verb'; edges into the output go, and so do keys in which an
    edge ends in something other than an action."""
    plain = lambda c: F.when(F.col(c).startswith("pred"), F.array_join(F.slice(F.split(F.regexp_replace(c, "_", " "), " "), 1, 2), " ")).otherwise(F.element_at(F.split(c, "_"), 1))
    e = edges.filter(~F.col("dst").startswith("RECIPE_OUTPUT") & ~F.col("dst").startswith("RECIPE OUTPUT"))
    e = e.select(key, plain("src").alias("src"), plain("dst").alias("dst")).distinct()
    odd = e.filter(~F.col("dst").startswith("pred ")).select(key).distinct()
    return e.join(odd, key, "left_anti")


def relabelled_leaves(edges: DataFrame, key: str, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges in which nodes that nothing leads to have their words in lower case, the last one as a lemma, in place of
    their ids; and the distinct ingredients (key, name). words: key, node, word."""
    sources = edges.select(key, F.col("src").alias("node")).distinct().join(edges.select(key, F.col("dst").alias("node")).distinct(), [key, "node"], "left_anti")
    named = sources.join(words, [key, "node"]).select(key, "node", base_name(F.lower("word")).alias("name"))
    e = edges.join(named.withColumnRenamed("node", "src"), [key, "src"], "left")
    return e.select(key, F.coalesce("name", "src").alias("src"), "dst").distinct(), named.select(key, "name").distinct()
