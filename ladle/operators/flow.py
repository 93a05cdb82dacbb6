"""Flow graphs of procedures from step facts.

facts: recipe_id, step_num, entity, action, word_idx, dep, kind ('main', 'prep' or 'modifier').
Edges have struct nodes (kind: 'name' or 'pred', name, step), so names may hold anything; `render`
writes them as text.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladle.operators.closure import cyclic_rest, prune_sources
from ladle.session import ensure_checkpoint_dir

# Names that stand for all ingredients.
SPECIAL = ("all ingredient", "remaining ingredient", "ingredient", "everything")
STEP = ["recipe_id", "step_num"]


def name_node(name: Column, step: Column) -> Column:
    return F.struct(F.lit("name").alias("kind"), name.cast("string").alias("name"), step.cast("int").alias("step"))


def pred_node(name: Column, step: Column) -> Column:
    return F.struct(F.lit("pred").alias("kind"), name.cast("string").alias("name"), step.cast("int").alias("step"))


def render(node: Column, recipe: Column) -> Column:
    prefix = F.when(node["kind"] == "pred", "pred_").otherwise("")
    return F.when(node["kind"] == "output", F.concat(F.lit("RECIPE_OUTPUT_"), recipe)).otherwise(F.concat(prefix, F.concat_ws("_", node["name"], recipe, node["step"])))


def registered(facts: DataFrame) -> DataFrame:
    """Main facts without `acomp`; at one word of an entity the last action (by name) stands."""
    main = facts.filter("kind = 'main' and dep <> 'acomp'")
    return main.groupBy(*STEP, "entity", "word_idx").agg(F.max("action").alias("action"))


def final_actions(facts: DataFrame) -> DataFrame:
    """recipe_id, step_num, final: the action of the largest word index (smallest name on ties) of the
    main and prep facts; where a step has none, of its modifiers."""
    usable = facts.filter("kind = 'modifier' or kind = 'prep' and entity <> action or kind = 'main' and dep <> 'acomp'")
    rank = F.struct(F.when(F.col("kind") == "modifier", 1).otherwise(0), -F.col("word_idx"), F.col("action"))
    return usable.groupBy(*STEP).agg(F.min_by("action", rank).alias("final"))


def followed_finals(edges: DataFrame, finals: DataFrame) -> DataFrame:
    """The finals, each moved on along single out-edges within its step to where they end (a final on a
    cycle stays)."""
    key = F.struct(*STEP)
    inner = edges.filter("src.step = step_num and dst.step = step_num and src.kind = 'pred'").select(key.alias("key"), "src", "dst")
    ends = terminals(inner, "key").select("key", F.col("node.name").alias("final"), F.col("terminal.name").alias("end"))
    f = finals.withColumn("key", key).join(ends, ["key", "final"], "left")
    return f.select(*STEP, F.coalesce("end", "final").alias("final"))


def action_chains(facts: DataFrame) -> DataFrame:
    """Edges entity -> first action -> next action ..., by word index."""
    order = Window.partitionBy(*STEP, "entity").orderBy("word_idx", "action")
    chained = registered(facts).withColumn("before", F.lag("action").over(order)).filter("before is null or before <> action")
    src = F.when(F.col("before").isNull(), name_node(F.col("entity"), F.col("step_num"))).otherwise(pred_node(F.col("before"), F.col("step_num")))
    return chained.select(*STEP, src.alias("src"), pred_node(F.col("action"), F.col("step_num")).alias("dst")).distinct()


def preposition_edges(facts: DataFrame, chains: DataFrame) -> DataFrame:
    """Edges entity -> action of prepositions, unless the chains have the same two the other way round."""
    p = facts.filter("kind = 'prep' and entity <> action").select(*STEP, name_node(F.col("entity"), F.col("step_num")).alias("src"), pred_node(F.col("action"), F.col("step_num")).alias("dst")).distinct()
    against = chains.select(*STEP, F.col("dst.name").alias("a"), F.col("src.name").alias("b")).distinct()
    return p.join(against, (p["recipe_id"] == against["recipe_id"]) & (p["step_num"] == against["step_num"]) & (p["src.name"] == against["a"]) & (p["dst.name"] == against["b"]), "left_anti")


def continuations(facts: DataFrame) -> DataFrame:
    """A step without a direct object takes up the last step's final action: edge to its first action
    that only prepositions have (its orphans, chained by word index), else to its own final action."""
    own = facts.groupBy(*STEP).agg(F.max((F.col("dep") == "dobj").cast("int")).alias("has_object"))
    main = registered(facts).select(*STEP, "action").distinct()
    orphans = facts.filter("kind = 'prep' and entity <> action").join(main, [*STEP, "action"], "left_anti").groupBy(*STEP, "action").agg(F.min("word_idx").alias("at"))
    order = Window.partitionBy(*STEP).orderBy("at", "action")
    orphans = orphans.withColumn("last", F.lag("action").over(order))
    w = Window.partitionBy("recipe_id").orderBy("step_num")
    steps = own.join(final_actions(facts), STEP, "left").withColumn("before", F.lag(F.struct("step_num", "final")).over(w)).filter((F.col("has_object") == 0) & F.col("before.final").isNotNull())
    both = steps.join(orphans, STEP, "left").withColumn("to", F.coalesce("action", "final")).filter("to is not null")
    src = F.when(F.col("last").isNotNull(), pred_node(F.col("last"), F.col("step_num"))).otherwise(pred_node(F.col("before.final"), F.col("before.step_num")))
    return both.select(*STEP, src.alias("src"), pred_node(F.col("to"), F.col("step_num")).alias("dst"))


def dangling(edges: DataFrame, finals: DataFrame) -> DataFrame:
    """Edges to the final action from actions of the step that lead nowhere."""
    preds = edges.filter("dst.kind = 'pred'").select(*STEP, F.col("dst").alias("src")).distinct()
    loose = preds.join(edges.select(*STEP, "src").distinct(), [*STEP, "src"], "left_anti").join(finals, STEP).filter("src.name <> final")
    return loose.select(*STEP, "src", pred_node(F.col("final"), F.col("step_num")).alias("dst"))


def step_edges(facts: DataFrame) -> DataFrame:
    """All edges within the steps and from one step to the next by continuation."""
    chains = action_chains(facts)
    edges = chains.unionByName(preposition_edges(facts, chains)).unionByName(continuations(facts)).distinct()
    return edges.unionByName(dangling(edges, final_actions(facts))).distinct()


def terminals(edges: DataFrame, key: str, most_rounds: int = 60) -> DataFrame:
    """key, node, terminal: where following the only out-edge of each node ends, at a node with no
    out-edge or several; null on a cycle. Pointers are doubled each round."""
    ensure_checkpoint_dir(edges.sparkSession)
    out = edges.select(key, "src", "dst").distinct()
    unique = out.groupBy(key, "src").agg(F.count(F.lit(1)).alias("n"), F.first("dst").alias("dst")).filter("n = 1").select(key, F.col("src").alias("node"), F.col("dst").alias("to"))
    nodes = out.select(key, F.col("src").alias("node")).unionByName(out.select(key, F.col("dst").alias("node"))).distinct()
    at = nodes.join(unique, [key, "node"], "left").withColumn("ends", F.col("to").isNull()).withColumn("to", F.coalesce("to", "node")).checkpoint()
    reached = None
    for _ in range(most_rounds):
        nxt = at.select(key, F.col("node").alias("to"), F.col("to").alias("further"), F.col("ends").alias("there"))
        at = at.join(nxt, [key, "to"]).select(key, "node", F.when(F.col("ends"), F.col("to")).otherwise(F.col("further")).alias("to"), (F.col("ends") | F.col("there")).alias("ends")).checkpoint()
        now = at.filter("ends").count()
        if now == reached:
            return at.select(key, "node", F.when(F.col("ends"), F.col("to")).alias("terminal"))
        reached = now
    raise RuntimeError("the pointers did not settle")


def leaves_of(edges: DataFrame) -> DataFrame:
    """recipe_id, step_num, leaf: names that nothing leads to."""
    names = edges.filter("src.kind = 'name'").select(*STEP, "src").distinct()
    return names.join(edges.select(*STEP, F.col("dst").alias("src")).distinct(), [*STEP, "src"], "left_anti").select(*STEP, F.col("src.name").alias("leaf"))


def contents_of(edges: DataFrame) -> DataFrame:
    """recipe_id, step_num, item: the names of a step."""
    return edges.filter("src.kind = 'name'").select(*STEP, F.col("src.name").alias("item")).distinct()


def related(reach: DataFrame, classes: DataFrame, similarity: DataFrame) -> DataFrame:
    """a, b, tier, sim: pairs of names that may be one thing. Tier 1: either reaches the other, both
    ingredients; 2: likewise equipment; 3: ingredients of one class.

    reach: src, dst; classes: name, kind ('ingredient', 'equipment'), class; similarity: a, b, sim.
    """
    c = classes.select("name", "kind", "class")
    x, y = c.select(F.col("name").alias("a"), F.col("kind").alias("ka"), F.col("class").alias("ca")), c.select(F.col("name").alias("b"), F.col("kind").alias("kb"), F.col("class").alias("cb"))
    up = reach.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(reach.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    direct = up.join(x, "a").join(y, "b").filter("ka = kb").select("a", "b", F.when(F.col("ka") == "ingredient", 1).otherwise(2).alias("tier"))
    same = x.filter("ka = 'ingredient' and ca is not null").join(y.filter("kb = 'ingredient'"), F.col("ca") == F.col("cb")).select("a", "b", F.lit(3).alias("tier"))
    best = direct.unionByName(same).groupBy("a", "b").agg(F.min("tier").alias("tier"))
    return best.join(similarity, ["a", "b"], "left").select("a", "b", "tier", F.coalesce("sim", F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0)).alias("sim"))


def link_steps(steps: DataFrame, pairs: DataFrame) -> DataFrame:
    """recipe_id, source_step, target_step (null: the output), leaf (null: no leaf is replaced).

    steps: recipe_id, step_num, final, items array, leaves array, has_out boolean; pairs: as `related`,
    joined per recipe: recipe_id, a (leaf), b (item), tier, sim. A step's contents go on to the step it
    leads to, so steps are taken in order, one recipe at a time.
    """

    def one(key: tuple, own: pd.DataFrame, related_: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("step_num")
        look = {(r.a, r.b): (r.tier, r.sim) for r in related_.itertuples()}
        numbers = own["step_num"].tolist()
        items = {n: set(x) for n, x in zip(numbers, own["items"])}
        leaves = {n: list(x) for n, x in zip(numbers, own["leaves"])}
        has_out = dict(zip(numbers, own["has_out"]))
        out = []
        for i, n in enumerate(numbers):
            if has_out[n]:
                continue
            for m in numbers[i + 1 :]:
                found = defaultdict(list)
                for leaf in leaves[m]:
                    for item in items[n]:
                        tier, sim = look.get((leaf, item), (1, 1.0) if leaf == item else (0, 0.0))
                        if tier:
                            found[tier].append((sim, leaf))
                if found:
                    tier = min(found)
                    best = max(sim for sim, _ in found[tier])
                    hit = sorted({leaf for sim, leaf in found[tier] if sim == best})
                    out += [(n, m, leaf) for leaf in hit]
                    leaves[m] = [x for x in leaves[m] if x not in hit]
                    items[m] |= items[n]
                    break
            else:
                if i + 1 < len(numbers):
                    out.append((n, numbers[i + 1], None))
        if numbers:
            out.append((numbers[-1], None, None))
        return pd.DataFrame([(key[0], a, b, c) for a, b, c in out], columns=["recipe_id", "source_step", "target_step", "leaf"]).astype({"target_step": "Int64"})

    steps, pairs = steps.select(*[F.col(c).alias(c) for c in steps.columns]), pairs.select(*[F.col(c).alias(c) for c in pairs.columns])
    kind = steps.schema["recipe_id"].dataType.simpleString()
    return steps.groupBy("recipe_id").cogroup(pairs.groupBy("recipe_id")).applyInPandas(one, f"recipe_id {kind}, source_step long, target_step long, leaf string")


def rerouted(edges: DataFrame, links: DataFrame, finals: DataFrame) -> DataFrame:
    """recipe_id, src, dst: edges after the links: a linked leaf's out-edges start from the source
    step's final action, the leaf is fed by it no more than once, and the last step feeds the output."""
    f = finals.select("recipe_id", F.col("step_num").alias("source_step"), F.col("final").alias("source_final"))
    t = finals.select("recipe_id", F.col("step_num").alias("target_step"), F.col("final").alias("target_final"))
    known = links.join(f, ["recipe_id", "source_step"]).join(t, ["recipe_id", "target_step"], "left")
    source = pred_node(F.col("source_final"), F.col("source_step"))
    direct = known.filter("leaf is null")
    output = F.struct(F.lit("output").alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("step"))
    target = F.when(F.col("target_step").isNull(), output).otherwise(pred_node(F.col("target_final"), F.col("target_step")))
    more = direct.select("recipe_id", source.alias("src"), target.alias("dst")).filter("src <> dst")
    moved = known.filter("leaf is not null").select("recipe_id", name_node(F.col("leaf"), F.col("target_step")).alias("src"), source.alias("new"))
    e = edges.select("recipe_id", "src", "dst").distinct().join(moved, ["recipe_id", "src"], "left")
    kept = e.select("recipe_id", F.coalesce("new", "src").alias("src"), "dst")
    return kept.unionByName(more).distinct()


def special_edges(edges: DataFrame, ingredients: DataFrame) -> DataFrame:
    """Edges in which a name such as 'all ingredient' is replaced by the recipe's ingredients that no
    step has named (the first such step of a recipe gets them all; later ones none).

    edges: recipe_id, step_num, src, dst; ingredients: recipe_id, name.
    """
    special = edges.filter(F.col("src.name").isin(*SPECIAL) & (F.col("src.kind") == "name"))
    named = edges.filter("src.kind = 'name'").select("recipe_id", F.col("src.name").alias("name")).distinct()
    unseen = ingredients.select("recipe_id", "name").distinct().join(named, ["recipe_id", "name"], "left_anti")
    first = special.groupBy("recipe_id").agg(F.min("step_num").alias("first"))
    put = special.join(first, "recipe_id").filter("step_num = first").join(unseen, "recipe_id").select("recipe_id", "step_num", name_node(F.col("name"), F.col("step_num")).alias("src"), "dst")
    return edges.join(special.select("recipe_id", "step_num", "src", "dst"), ["recipe_id", "step_num", "src", "dst"], "left_anti").unionByName(put).distinct()


def without_sinks(edges: DataFrame, output_kind: str = "output") -> DataFrame:
    """Edges without those into nodes, other than the output, that lead nowhere (one pass)."""
    sources = edges.select("recipe_id", F.col("src").alias("dst")).distinct()
    keep = edges.join(sources, ["recipe_id", "dst"], "left_semi")
    return keep.select("recipe_id", "src", "dst").unionByName(edges.filter(F.col("dst.kind") == output_kind).select("recipe_id", "src", "dst"))


def attach_unseen(edges: DataFrame, ingredients: DataFrame, similarity: DataFrame) -> DataFrame:
    """Edges and, for each recipe ingredient that no node names, edges to where the leaves most similar to
    it lead (all ties). similarity: a (ingredient), b (leaf name), sim; a
    leaf without a row is at 0, so where none is similar all are equally near."""
    named = edges.filter("src.kind = 'name'").select("recipe_id", F.col("src.name").alias("name")).distinct()
    unseen = ingredients.select("recipe_id", "name").distinct().join(named, ["recipe_id", "name"], "left_anti")
    near = unseen.join(similarity.filter("sim > 0").withColumnRenamed("a", "name"), "name").join(named.withColumnRenamed("name", "b"), ["recipe_id", "b"])
    far = unseen.join(near.select("recipe_id", "name").distinct(), ["recipe_id", "name"], "left_anti").join(named.withColumnRenamed("name", "b"), "recipe_id").withColumn("sim", F.lit(0.0))
    pairs = near.select("recipe_id", "name", "b", "sim").unionByName(far.select("recipe_id", "name", "b", "sim"))
    best = pairs.withColumn("k", F.rank().over(Window.partitionBy("recipe_id", "name").orderBy(F.desc("sim")))).filter("k = 1")
    to = edges.filter("src.kind = 'name'").select("recipe_id", F.col("src.name").alias("b"), "src", "dst")
    more = best.join(to, ["recipe_id", "b"]).select("recipe_id", name_node(F.col("name"), F.col("src.step")).alias("src"), "dst")
    return edges.select("recipe_id", "src", "dst").unionByName(more).distinct()


def raw_leaves(edges: DataFrame) -> DataFrame:
    """Edges in which every occurrence of a leaf is the bare name, whatever its step."""
    fed = edges.select("recipe_id", F.col("dst").alias("src")).distinct().withColumn("fed", F.lit(True))
    e = edges.select("recipe_id", "src", "dst").join(fed, ["recipe_id", "src"], "left")
    bare = F.struct(F.lit("name").alias("kind"), F.col("src.name").alias("name"), F.lit(None).cast("int").alias("step"))
    return e.select("recipe_id", F.when((F.col("src.kind") == "name") & F.col("fed").isNull(), bare).otherwise(F.col("src")).alias("src"), "dst").distinct()


def node_category(in_recipe: Column, is_ingredient: Column, is_equipment: Column) -> Column:
    """3: an ingredient of the recipe; 2: another ingredient; 1: equipment; else null."""
    return F.when(is_ingredient & in_recipe, 3).when(is_ingredient, 2).when(is_equipment, 1)


def accepted_leaves(leaves: DataFrame, taxonomy: DataFrame, reaches: DataFrame, records: DataFrame, ingredients: DataFrame) -> DataFrame:
    """recipe_id, name of the source leaves that stay: special names; and those in the taxonomy that
    are ingredients of the recipe or reach the ingredient hub, have a connection record, and are not a
    foreign ingredient by it (closest link an ingredient, no equipment, not in the recipe).

    leaves: recipe_id, name; taxonomy: name; reaches: name; records: name, closest_ing, r_eqp;
    ingredients: recipe_id, name.
    """
    own = leaves.join(ingredients.select("recipe_id", "name").distinct().withColumn("own", F.lit(True)), ["recipe_id", "name"], "left")
    known = own.join(taxonomy.select("name").distinct().withColumn("in_taxonomy", F.lit(True)), "name", "left").join(reaches.select("name").distinct().withColumn("reaches", F.lit(True)), "name", "left").join(records.select("name", "closest_ing", "r_eqp").withColumn("has_record", F.lit(True)), "name", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    good = yes("in_taxonomy") & (yes("own") | yes("reaches")) & yes("has_record") & ~(yes("closest_ing") & ~yes("r_eqp") & ~yes("own"))
    return known.filter(F.col("name").isin(*SPECIAL) | good).select("recipe_id", "name")


def prune_leaves(edges: DataFrame, accepted: DataFrame) -> DataFrame:
    """Edges (recipe_id, src, dst) left when sources that are not accepted go, round by round."""
    named = edges.filter("src.kind = 'name'").select("recipe_id", F.col("src").alias("node"), F.col("src.name").alias("name")).distinct()
    ok = named.join(accepted, ["recipe_id", "name"], "left_semi").select("recipe_id", "node")
    return prune_sources(edges, ok, "recipe_id")


def sound_recipes(edges: DataFrame) -> DataFrame:
    """recipe_id of graphs without a cycle in which every node reaches the output."""
    cyclic = cyclic_rest(edges, "recipe_id").select("recipe_id").distinct()
    # without cycles every node leads to a sink, so all reach the output if it is the only one
    sources = edges.select("recipe_id", F.col("src").alias("dst")).distinct()
    sinks = edges.select("recipe_id", "dst").distinct().join(sources, ["recipe_id", "dst"], "left_anti")
    lost = sinks.filter("dst.kind <> 'output'").select("recipe_id").distinct()
    ended = edges.select("recipe_id").distinct().join(sinks.filter("dst.kind = 'output'").select("recipe_id"), "recipe_id", "left_semi")
    return ended.join(cyclic, "recipe_id", "left_anti").join(lost, "recipe_id", "left_anti")


def tree_output(edges: DataFrame) -> DataFrame:
    """recipe_id, edges array<array<string>>, edge_labels, output_node: for writing as JSON."""
    r = F.col("recipe_id").cast("string")
    plain = F.when(F.col("src.kind") == "name", F.col("src.name")).otherwise(render(F.col("src"), r))
    label = F.when(F.col("dst.kind") == "pred", F.concat(F.lit("pred "), F.col("dst.name"))).otherwise(F.lit("RECIPE OUTPUT"))
    rows = edges.select("recipe_id", F.struct(F.array(plain, render(F.col("dst"), r)).alias("edge"), label.alias("label")).alias("x"))
    g = rows.groupBy("recipe_id").agg(F.array_sort(F.collect_set("x")).alias("x"))
    return g.select("recipe_id", F.transform("x", lambda e: e["edge"]).alias("edges"), F.transform("x", lambda e: e["label"]).alias("edge_labels"), F.concat(F.lit("RECIPE_OUTPUT_"), r).alias("output_node"))


def leaf_classes(leaves: DataFrame, records: DataFrame, ingredients: DataFrame) -> DataFrame:
    """recipe_id, step_num, leaf, is_ingredient, is_equipment: a leaf is an ingredient if it reaches the ingredient or
    the food hub or is in its recipe, and equipment if it reaches that hub; a leaf without a record is left out.

    leaves: recipe_id, step_num, leaf; records: name, r_ing, r_food, r_eqp; ingredients: recipe_id, name.
    """
    own = ingredients.select("recipe_id", F.col("name").alias("leaf")).distinct().withColumn("own", F.lit(True))
    known = leaves.join(records.select(F.col("name").alias("leaf"), "r_ing", "r_food", "r_eqp"), "leaf").join(own, ["recipe_id", "leaf"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return known.select(*STEP, "leaf", (yes("r_ing") | yes("r_food") | yes("own")).alias("is_ingredient"), yes("r_eqp").alias("is_equipment"))
