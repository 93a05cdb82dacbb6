"""Flow graphs: a user's day of events is a step, the event type the action, k the entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladle.operators import closure as C
from ladle.operators import facts as N
from ladle.operators import flow as G
from ladle.operators import gold as E
from ladle.operators import scoring as M
from ladle.operators import triples as T
from ladle.plans.procedures import recipe_facts
from ladle.queries import table


def facts(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    order = Window.partitionBy("user_id", day).orderBy("ts", "event_id")
    kind = F.when(F.col("event_type") == "error", "prep").when(F.col("event_type") == "signup", "modifier").otherwise("main")
    dep = F.when(F.col("value") >= 30, "dobj").when(F.col("value") < 1, "acomp").otherwise("nsubjpass")
    return e.select(
        F.col("user_id").alias("recipe_id"),
        F.datediff(day, F.lit("2024-01-01")).alias("step_num"),
        F.concat(F.lit("k"), F.get_json_object("props", "$.k").cast("int") % 7).alias("entity"),
        F.col("event_type").alias("action"),
        F.row_number().over(order).alias("word_idx"),
        dep.alias("dep"),
        kind.alias("kind"),
    )


FACTS = """f AS (SELECT user_id AS recipe_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS step_num, 'k' || (CAST(json_extract_string(props, '$.k') AS INT) % 7) AS entity, event_type AS action,
    row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS word_idx, CASE WHEN value >= 30 THEN 'dobj' WHEN value < 1 THEN 'acomp' ELSE 'nsubjpass' END AS dep,
    CASE event_type WHEN 'error' THEN 'prep' WHEN 'signup' THEN 'modifier' ELSE 'main' END AS kind FROM events)"""
FINALS = "fin AS (SELECT recipe_id, step_num, action AS final FROM f WHERE kind <> 'main' OR dep <> 'acomp' QUALIFY row_number() OVER (PARTITION BY recipe_id, step_num ORDER BY CASE kind WHEN 'modifier' THEN 1 ELSE 0 END, word_idx DESC, action) = 1)"
REG = "reg AS (SELECT recipe_id, step_num, entity, word_idx, max(action) AS action FROM f WHERE kind = 'main' AND dep <> 'acomp' GROUP BY 1, 2, 3, 4)"
CHAINS = "ch AS (SELECT DISTINCT recipe_id, step_num, CASE WHEN b IS NULL THEN entity || '_' || recipe_id || '_' || step_num ELSE 'pred_' || b || '_' || recipe_id || '_' || step_num END AS src, 'pred_' || action || '_' || recipe_id || '_' || step_num AS dst, coalesce(b, entity) AS s, action AS d FROM (SELECT *, lag(action) OVER (PARTITION BY recipe_id, step_num, entity ORDER BY word_idx, action) AS b FROM reg) WHERE b IS NULL OR b <> action)"
PREP = "pe AS (SELECT DISTINCT recipe_id, step_num, entity || '_' || recipe_id || '_' || step_num AS src, 'pred_' || action || '_' || recipe_id || '_' || step_num AS dst FROM f WHERE kind = 'prep' AND entity <> action AND NOT EXISTS (SELECT 1 FROM ch WHERE ch.recipe_id = f.recipe_id AND ch.step_num = f.step_num AND ch.d = f.entity AND ch.s = f.action))"
CONT = """ob AS (SELECT recipe_id, step_num, max(CAST(dep = 'dobj' AS INT)) AS has_object FROM f GROUP BY 1, 2), orp AS (SELECT *, lag(action) OVER (PARTITION BY recipe_id, step_num ORDER BY at_, action) AS last_ FROM (SELECT recipe_id, step_num, action, min(word_idx) AS at_ FROM f WHERE kind = 'prep' AND (recipe_id, step_num, action) NOT IN (SELECT (recipe_id, step_num, action) FROM reg) GROUP BY 1, 2, 3)),
    st AS (SELECT ob.recipe_id, ob.step_num, has_object, final, lag(final) OVER w AS bf, lag(ob.step_num) OVER w AS bs FROM ob LEFT JOIN fin ON ob.recipe_id = fin.recipe_id AND ob.step_num = fin.step_num WINDOW w AS (PARTITION BY ob.recipe_id ORDER BY ob.step_num)),
    co AS (SELECT st.recipe_id, st.step_num, CASE WHEN last_ IS NULL THEN 'pred_' || bf || '_' || st.recipe_id || '_' || bs ELSE 'pred_' || last_ || '_' || st.recipe_id || '_' || st.step_num END AS src, 'pred_' || coalesce(orp.action, final) || '_' || st.recipe_id || '_' || st.step_num AS dst
        FROM st LEFT JOIN orp ON st.recipe_id = orp.recipe_id AND st.step_num = orp.step_num WHERE has_object = 0 AND bf IS NOT NULL AND coalesce(orp.action, final) IS NOT NULL)"""
EDGES = """e0 AS (SELECT recipe_id, step_num, src, dst FROM ch UNION SELECT * FROM pe UNION SELECT * FROM co),
    da AS (SELECT DISTINCT a.recipe_id, a.step_num, a.dst AS src, 'pred_' || final || '_' || a.recipe_id || '_' || a.step_num AS dst FROM e0 a JOIN fin ON a.recipe_id = fin.recipe_id AND a.step_num = fin.step_num WHERE NOT EXISTS (SELECT 1 FROM e0 b WHERE b.recipe_id = a.recipe_id AND b.step_num = a.step_num AND b.src = a.dst) AND a.dst <> 'pred_' || final || '_' || a.recipe_id || '_' || a.step_num),
    ed AS (SELECT * FROM e0 UNION SELECT * FROM da)"""
_ALL = f"WITH {FACTS}, {FINALS}, {REG}, {CHAINS}, {PREP}, {CONT}, {EDGES}"


def _text(edges: DataFrame) -> DataFrame:
    r = F.col("recipe_id").cast("string")
    return edges.select("recipe_id", "step_num", G.render(F.col("src"), r).alias("src"), G.render(F.col("dst"), r).alias("dst"))


def final_action(spark, sf_dir):
    return G.final_actions(facts(spark, sf_dir))


def action_chain(spark, sf_dir):
    return _text(G.action_chains(facts(spark, sf_dir)))


def preposition_edges(spark, sf_dir):
    f = facts(spark, sf_dir)
    return _text(G.preposition_edges(f, G.action_chains(f)))


def implicit_continuation(spark, sf_dir):
    return _text(G.continuations(facts(spark, sf_dir)))


def step_edges(spark, sf_dir):
    return _text(G.step_edges(facts(spark, sf_dir)))


def step_leaves(spark, sf_dir):
    return G.leaves_of(G.step_edges(facts(spark, sf_dir)))


def _names(spark, sf_dir):
    """Entities k0..k6: k0 to k3 are ingredients of two classes, the others equipment; k1 lies under k0."""
    f = facts(spark, sf_dir).select(F.col("entity").alias("name")).distinct()
    n = F.substring("name", 2, 1).cast("int")
    return f.select("name", F.when(n < 4, "ingredient").otherwise("equipment").alias("kind"), F.when(n < 4, (n % 2).cast("string")).alias("class"))


def _linked(spark, sf_dir):
    f = facts(spark, sf_dir)
    edges = G.step_edges(f).checkpoint()
    names = _names(spark, sf_dir)
    reach = names.filter("name = 'k1'").select(F.col("name").alias("src"), F.lit("k0").alias("dst"))
    sims = names.select(F.col("name").alias("a")).filter("a in ('k0', 'k1')").select("a", F.lit("k0").alias("b"), F.lit(0.7).alias("sim"))
    pairs = G.related(reach, names, sims)
    finals = G.final_actions(f)
    out = edges.filter("src.kind = 'pred' and src.step <> step_num").select("recipe_id", F.col("src.step").alias("step_num"), F.lit(True).alias("has_out")).distinct()
    items = G.contents_of(edges).groupBy("recipe_id", "step_num").agg(F.collect_set("item").alias("items"))
    leaves = G.leaves_of(edges).groupBy("recipe_id", "step_num").agg(F.collect_set("leaf").alias("leaves"))
    none = F.array().cast("array<string>")
    steps = finals.join(items, ["recipe_id", "step_num"], "left").join(leaves, ["recipe_id", "step_num"], "left").join(out, ["recipe_id", "step_num"], "left")
    steps = steps.select("recipe_id", "step_num", "final", F.coalesce("items", none).alias("items"), F.coalesce("leaves", none).alias("leaves"), F.coalesce("has_out", F.lit(False)).alias("has_out"))
    own = G.leaves_of(edges).select("recipe_id", F.col("leaf").alias("a")).distinct().join(pairs, "a")
    return edges, G.link_steps(steps, own), finals


def step_links(spark, sf_dir):
    return _linked(spark, sf_dir)[1]


def flow_graphs(spark, sf_dir):
    """Connected, sinks dropped, foreign leaves pruned, only sound graphs kept; as text for JSON."""
    edges, links, finals = _linked(spark, sf_dir)
    g = G.without_sinks(G.rerouted(edges, links, finals)).checkpoint()
    names = g.filter("src.kind = 'name'").select("recipe_id", F.col("src.name").alias("name")).distinct()
    g = G.prune_leaves(g, names.filter("name <> 'k6'"))
    return G.tree_output(g.join(G.sound_recipes(g), "recipe_id", "left_semi"))


def terminal_nodes(spark, sf_dir):
    edges = G.step_edges(facts(spark, sf_dir))
    r = F.col("recipe_id").cast("string")
    t = G.terminals(edges.filter("src <> dst"), "recipe_id")
    return t.select("recipe_id", G.render(F.col("node"), r).alias("node"), F.when(F.col("terminal").isNotNull(), G.render(F.col("terminal"), r)).alias("terminal"))


def _day_graph(spark, sf_dir):
    """Edges event type -> next event type of a user's day."""
    f = facts(spark, sf_dir)
    w = Window.partitionBy("recipe_id", "step_num").orderBy("word_idx")
    return f.withColumn("dst", F.lead("action").over(w)).filter("dst is not null and dst <> action").select("recipe_id", "step_num", F.col("action").alias("src"), "dst").distinct()


DAY = "dg AS (SELECT DISTINCT recipe_id, step_num, action AS src, dst FROM (SELECT *, lead(action) OVER (PARTITION BY recipe_id, step_num ORDER BY word_idx) AS dst FROM f) WHERE dst IS NOT NULL AND dst <> action)"


def _keyed(spark, sf_dir):
    return _day_graph(spark, sf_dir).select(F.concat_ws("/", "recipe_id", "step_num").alias("k"), "src", "dst")


def acyclic_graphs(spark, sf_dir):
    g = _keyed(spark, sf_dir).checkpoint()
    return g.select("k").distinct().join(C.cyclic_rest(g, "k").select("k").distinct(), "k", "left_anti")


def pruned_sources(spark, sf_dir):
    g = _keyed(spark, sf_dir)
    ok = g.select("k", F.col("src").alias("node")).filter("node in ('click', 'view')").distinct()
    return C.prune_sources(g, ok, "k")


def pruned_childless(spark, sf_dir):
    g = _keyed(spark, sf_dir).select("k", F.col("src").alias("parent"), F.col("dst").alias("child"))
    ok = g.select("k", F.col("child").alias("node")).filter("node = 'click'").distinct()
    return T.prune_childless(g, ok, "k")


def text_facts(spark, sf_dir):
    """Step facts of the documents' lines, read by the trained parser."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("recipe_id"), F.filter(F.split("text", "\n"), lambda x: x != "").alias("steps"))
    return recipe_facts(docs)


def no_sinks(spark, sf_dir):
    """The days' graphs without edges into nodes that lead nowhere; a purchase counts as output."""
    kind = lambda c: F.struct(F.when(F.col(c) == "purchase", "output").otherwise("pred").alias("kind"), F.col(c).alias("name"))
    kept = G.without_sinks(_keyed(spark, sf_dir).select(F.col("k").alias("recipe_id"), kind("src").alias("src"), kind("dst").alias("dst")))
    return kept.select(F.col("recipe_id").alias("k"), F.col("src.name").alias("src"), F.col("dst.name").alias("dst")).distinct()


def raw_leaf_edges(spark, sf_dir):
    r = F.col("recipe_id").cast("string")
    e = G.raw_leaves(G.action_chains(facts(spark, sf_dir)))
    return e.select("recipe_id", F.when(F.col("src.step").isNull(), F.col("src.name")).otherwise(G.render(F.col("src"), r)).alias("src"), G.render(F.col("dst"), r).alias("dst"))


def attached_unseen(spark, sf_dir):
    """k0 to k6 are each user's ingredients; an unseen one goes where the nearest numbers lead."""
    chains = G.action_chains(facts(spark, sf_dir))
    names = facts(spark, sf_dir).select(F.col("entity").alias("name")).distinct()
    users = facts(spark, sf_dir).select("recipe_id").distinct()
    ing = users.join(F.broadcast(names))  # seven names
    n = lambda c: F.substring(c, 2, 1).cast("int")
    sims = names.select(F.col("name").alias("a")).join(F.broadcast(names.select(F.col("name").alias("b")))).filter("a <> b").select("a", "b", F.round(1.0 / (1 + F.abs(n("a") - n("b"))), 6).alias("sim"))
    e = G.attach_unseen(chains, ing, sims)
    r = F.col("recipe_id").cast("string")
    return e.select("recipe_id", G.render(F.col("src"), r).alias("src"), G.render(F.col("dst"), r).alias("dst"))


def node_categories(spark, sf_dir):
    f = facts(spark, sf_dir)
    n = F.substring("entity", 2, 1).cast("int")
    own = f.filter("dep = 'dobj'").select("recipe_id", "entity").distinct().withColumn("own", F.lit(True))
    e = f.select("recipe_id", "entity").distinct().join(own, ["recipe_id", "entity"], "left")
    return e.select("recipe_id", "entity", G.node_category(F.coalesce("own", F.lit(False)), n < 4, n >= 5).alias("category"))


def downstream_actions(spark, sf_dir):
    """What follows a view, directly or not, in each day's graph."""
    g = _keyed(spark, sf_dir)
    node = lambda c: F.struct("k", F.col(c).alias("n"))
    reach = C.closure(g.select(node("src").alias("src"), node("dst").alias("dst")))
    return reach.filter("src.n = 'view' and dst.n <> 'view'").select("src.k", F.col("dst.n").alias("action"), F.col("dist").cast("bigint").alias("dist"))


def island_merge(spark, sf_dir):
    """A click begins a name and directly following views continue it."""
    f = facts(spark, sf_dir).withColumn("key", F.concat_ws("/", "recipe_id", "step_num"))
    return E.merged_tokens(f, "key", ["word_idx"], "entity", "action", "click", "view").select("key", F.col("word_idx").cast("bigint").alias("word_idx"), "merged")


def sentence_assembly(spark, sf_dir):
    return E.sentences(facts(spark, sf_dir), "recipe_id", ["word_idx"], "action", ["step_num"])


def bypass_nodes(spark, sf_dir):
    g = _keyed(spark, sf_dir)
    return E.bypassed(g, g.select("k", F.lit("view").alias("node")).distinct(), "k")


def node_degrees(spark, sf_dir):
    return E.degrees(_keyed(spark, sf_dir), "k")


def ancestor_keep(spark, sf_dir):
    g = _keyed(spark, sf_dir).checkpoint()
    sound = g.join(C.cyclic_rest(g, "k").select("k").distinct(), "k", "left_anti")
    return E.main_ancestors(sound, "k")


def reduced_gold(spark, sf_dir):
    """Views as tools, purchases as foods, errors as states."""
    g = _keyed(spark, sf_dir)
    nodes = g.select("k", F.col("src").alias("node")).unionByName(g.select("k", F.col("dst").alias("node"))).distinct()
    nodes = nodes.withColumn("tag", F.when(F.col("node") == "view", "T").when(F.col("node") == "error", "Sf").when(F.col("node").isin("click", "purchase"), "F").otherwise("Ac"))
    links = g.withColumn("link", F.when((F.col("src") == "purchase") & (F.col("dst") == "click"), "f-eq").otherwise("t"))
    return E.reduce_graph(g, nodes, links, "k")


def _gold_pair(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    e = li.select("l_orderkey", F.concat(F.lit("p"), F.col("l_partkey") % 50).alias("src"), F.concat(F.lit("pred "), "l_returnflag").alias("dst"), "l_linenumber", "l_quantity")
    return e.filter("l_quantity > 10").select("l_orderkey", "src", "dst"), e.filter("l_linenumber <= 4").select("l_orderkey", "src", "dst")


def edge_precision_recall(spark, sf_dir):
    true, predicted = _gold_pair(spark, sf_dir)
    each, _ = M.edge_scores(E.canonical_edges(true, "l_orderkey"), E.canonical_edges(predicted, "l_orderkey"), "l_orderkey")
    return each.select("l_orderkey", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def edge_prf(spark, sf_dir):
    true, predicted = _gold_pair(spark, sf_dir)
    _, mean = M.edge_scores(E.canonical_edges(true, "l_orderkey"), E.canonical_edges(predicted, "l_orderkey"), "l_orderkey")
    return mean.select(*[F.round(c, 6).alias(c) for c in mean.columns])


def leaf_classes(spark, sf_dir):
    """k0 and k1 reach the ingredients, k2 food, k3 to k5 equipment; k6 has no record; what a user buys is their own."""
    leaves = G.leaves_of(G.step_edges(facts(spark, sf_dir)))
    names = facts(spark, sf_dir).select(F.col("entity").alias("name")).distinct()
    n = F.substring("name", 2, 1).cast("int")
    records = names.filter(n < 6).select("name", (n < 2).alias("r_ing"), (n == 2).alias("r_food"), n.between(3, 5).alias("r_eqp"))
    own = facts(spark, sf_dir).filter("action = 'purchase'").select("recipe_id", F.col("entity").alias("name"))
    return G.leaf_classes(leaves, records, own)


def special_edges(spark, sf_dir):
    """k6 stands for everything; each user has the names k0 to k5."""
    f = facts(spark, sf_dir)
    chains = G.action_chains(f.withColumn("entity", F.when(F.col("entity") == "k6", "everything").otherwise(F.col("entity"))))
    names = f.filter("entity <> 'k6'").select(F.col("entity").alias("name")).distinct()
    e = G.special_edges(chains, f.select("recipe_id").distinct().join(F.broadcast(names)))  # six names
    return _text(e)


FUNCTIONS = (leaf_classes, special_edges, final_action, action_chain, preposition_edges, implicit_continuation, step_edges, step_leaves, step_links, flow_graphs, terminal_nodes, acyclic_graphs, pruned_sources, pruned_childless, island_merge, sentence_assembly, bypass_nodes, node_degrees, ancestor_keep, reduced_gold, edge_precision_recall, edge_prf, text_facts, no_sinks, raw_leaf_edges, attached_unseen, node_categories, downstream_actions)
QUERIES = {f.__name__: f for f in FUNCTIONS}
_DAY = f"{FACTS}, {DAY}, g AS (SELECT recipe_id || '/' || step_num AS k, src, dst FROM dg)"
_REACH = "w AS (SELECT k, src, src AS dst FROM g UNION SELECT k, dst, dst FROM g UNION SELECT w.k, w.src, g.dst FROM w JOIN g ON w.k = g.k AND w.dst = g.src)"
_CYCLIC = "cy AS (SELECT DISTINCT w.k FROM w JOIN g ON w.k = g.k AND w.dst = g.src AND w.src = g.dst)"
_PRF = "te AS (SELECT DISTINCT l_orderkey, 'p' || (l_partkey % 50) AS src, 'pred ' || l_returnflag AS dst FROM lineitem WHERE l_quantity > 10), pe AS (SELECT DISTINCT l_orderkey, 'p' || (l_partkey % 50) AS src, 'pred ' || l_returnflag AS dst FROM lineitem WHERE l_linenumber <= 4), hit AS (SELECT l_orderkey, count(*) AS h FROM te JOIN pe USING (l_orderkey, src, dst) GROUP BY 1), pr AS (SELECT t.l_orderkey, coalesce(h, 0) / np AS precision, coalesce(h, 0) / nt AS recall FROM (SELECT l_orderkey, count(*) AS nt FROM te GROUP BY 1) t JOIN (SELECT l_orderkey, count(*) AS np FROM pe GROUP BY 1) p USING (l_orderkey) LEFT JOIN hit USING (l_orderkey))"
ORACLE = {
    "leaf_classes": f"{_ALL}, lv AS (SELECT DISTINCT recipe_id, step_num, split_part(src, '_', 1) AS leaf FROM ed WHERE src NOT LIKE 'pred%'), ow AS (SELECT DISTINCT recipe_id, entity FROM f WHERE action = 'purchase') SELECT recipe_id, step_num, leaf, leaf IN ('k0', 'k1', 'k2') OR (recipe_id, leaf) IN (SELECT (recipe_id, entity) FROM ow) AS is_ingredient, leaf IN ('k3', 'k4', 'k5') AS is_equipment FROM lv WHERE leaf <> 'k6'",
    "special_edges": f"""WITH {FACTS.replace("f AS (SELECT", "f0 AS (SELECT", 1)}, f AS (SELECT * REPLACE (CASE WHEN entity = 'k6' THEN 'everything' ELSE entity END AS entity) FROM f0), {REG}, {CHAINS},
        nm AS (SELECT DISTINCT recipe_id, name FROM (SELECT DISTINCT recipe_id FROM f0), (SELECT DISTINCT entity AS name FROM f0 WHERE entity <> 'k6')), un AS (SELECT * FROM nm WHERE (recipe_id, name) NOT IN (SELECT (recipe_id, s) FROM ch WHERE src NOT LIKE 'pred%')),
        sp AS (SELECT * FROM ch WHERE src LIKE 'everything%'), fs AS (SELECT recipe_id, min(step_num) AS step_num FROM sp GROUP BY 1)
        SELECT recipe_id, step_num, src, dst FROM ch WHERE src NOT LIKE 'everything%' UNION SELECT sp.recipe_id, sp.step_num, name || '_' || sp.recipe_id || '_' || sp.step_num, dst FROM sp JOIN fs USING (recipe_id, step_num) JOIN un ON un.recipe_id = sp.recipe_id""",
    "terminal_nodes": f"""WITH RECURSIVE {_ALL[5:]}, g AS (SELECT DISTINCT recipe_id, src, dst FROM ed WHERE src <> dst), nd AS (SELECT recipe_id, src AS node FROM g UNION SELECT recipe_id, dst FROM g),
        uq AS (SELECT recipe_id, src, min(dst) AS dst FROM g GROUP BY 1, 2 HAVING count(*) = 1), w AS (SELECT recipe_id, node, node AS at_ FROM nd UNION SELECT w.recipe_id, w.node, uq.dst FROM w JOIN uq ON uq.recipe_id = w.recipe_id AND uq.src = w.at_)
        SELECT w.recipe_id, node, max(CASE WHEN uq.src IS NULL THEN at_ END) AS terminal FROM w LEFT JOIN uq ON uq.recipe_id = w.recipe_id AND uq.src = w.at_ GROUP BY 1, 2""",
    "final_action": f"WITH {FACTS}, {FINALS} SELECT recipe_id, step_num, final FROM fin",
    "action_chain": f"WITH {FACTS}, {REG}, {CHAINS} SELECT DISTINCT recipe_id, step_num, src, dst FROM ch",
    "preposition_edges": f"WITH {FACTS}, {REG}, {CHAINS}, {PREP} SELECT * FROM pe",
    "implicit_continuation": f"WITH {FACTS}, {FINALS}, {REG}, {CONT} SELECT * FROM co",
    "step_edges": f"{_ALL} SELECT recipe_id, step_num, src, dst FROM ed",
    "step_leaves": f"{_ALL} SELECT DISTINCT recipe_id, step_num, split_part(src, '_', 1) AS leaf FROM ed WHERE src NOT LIKE 'pred%'",
    "acyclic_graphs": f"WITH RECURSIVE {_DAY}, {_REACH}, {_CYCLIC} SELECT DISTINCT k FROM g WHERE k NOT IN (SELECT k FROM cy)",
    # a node stays if an accepted source, or a cycle, leads to it
    "pruned_sources": f"WITH RECURSIVE {_DAY}, {_REACH}, good AS (SELECT DISTINCT k, src AS node FROM g WHERE src IN ('click', 'view') UNION SELECT w.k, w.src FROM w JOIN g ON w.k = g.k AND w.dst = g.src AND w.src = g.dst), live AS (SELECT DISTINCT w.k, w.dst AS node FROM w JOIN good ON w.k = good.k AND w.src = good.node) SELECT k, src, dst FROM g WHERE (k, src) IN (SELECT (k, node) FROM live)",
    "pruned_childless": f"WITH RECURSIVE {_DAY}, {_REACH}, good AS (SELECT DISTINCT k, dst AS node FROM g WHERE dst = 'click' UNION SELECT w.k, w.src FROM w JOIN g ON w.k = g.k AND w.dst = g.src AND w.src = g.dst), live AS (SELECT DISTINCT w.k, w.src AS node FROM w JOIN good ON w.k = good.k AND w.dst = good.node) SELECT k, src AS parent, dst AS child FROM g WHERE (k, dst) IN (SELECT (k, node) FROM live)",
    "island_merge": f"""WITH {FACTS}, t AS (SELECT recipe_id || '/' || step_num AS key, word_idx, entity, action, sum(CAST(action = 'click' AS INT)) OVER w AS island, sum(CAST(action NOT IN ('click', 'view') AS INT)) OVER w AS gaps FROM f WINDOW w AS (PARTITION BY recipe_id, step_num ORDER BY word_idx)),
        u AS (SELECT *, min(CASE WHEN action = 'click' THEN gaps END) OVER (PARTITION BY key, island) AS own FROM t WHERE action IN ('click', 'view') AND island > 0) SELECT key, CAST(min(word_idx) AS BIGINT) AS word_idx, string_agg(entity, ' ' ORDER BY word_idx) AS merged FROM u WHERE gaps = own GROUP BY key, island""",
    "sentence_assembly": f"WITH {FACTS} SELECT recipe_id, step_num, string_agg(action, ' ' ORDER BY word_idx) AS sentence FROM f GROUP BY 1, 2",
    "no_sinks": f"WITH {_DAY} SELECT k, src, dst FROM g WHERE dst = 'purchase' OR EXISTS (SELECT 1 FROM g o WHERE o.k = g.k AND o.src = g.dst)",
    "raw_leaf_edges": f"WITH {FACTS}, {REG}, {CHAINS} SELECT DISTINCT recipe_id, CASE WHEN src LIKE 'pred%' THEN src ELSE s END AS src, dst FROM ch",
    "attached_unseen": f"""WITH {FACTS}, {REG}, {CHAINS}, u AS (SELECT DISTINCT recipe_id FROM f), nm AS (SELECT DISTINCT entity AS name FROM f), lf AS (SELECT DISTINCT recipe_id, s AS b FROM ch WHERE src NOT LIKE 'pred%'),
        un AS (SELECT recipe_id, name FROM u, nm WHERE (recipe_id, name) NOT IN (SELECT (recipe_id, b) FROM lf)), bs AS (SELECT un.recipe_id, name, b FROM un JOIN lf ON un.recipe_id = lf.recipe_id QUALIFY rank() OVER (PARTITION BY un.recipe_id, name ORDER BY abs(CAST(name[2] AS INT) - CAST(b[2] AS INT))) = 1)
        SELECT recipe_id, src, dst FROM ch UNION SELECT bs.recipe_id, name || '_' || bs.recipe_id || '_' || step_num, dst FROM bs JOIN ch ON ch.recipe_id = bs.recipe_id AND ch.s = bs.b AND src NOT LIKE 'pred%'""",
    "node_categories": f"WITH {FACTS}, o AS (SELECT DISTINCT recipe_id, entity FROM f WHERE dep = 'dobj') SELECT recipe_id, entity, CASE WHEN n < 4 AND (recipe_id, entity) IN (SELECT (recipe_id, entity) FROM o) THEN 3 WHEN n < 4 THEN 2 WHEN n >= 5 THEN 1 END AS category FROM (SELECT DISTINCT recipe_id, entity, CAST(entity[2] AS INT) AS n FROM f)",
    "downstream_actions": f"WITH RECURSIVE {_DAY}, dw AS (SELECT k, src, dst, 1 AS d FROM g WHERE src = 'view' UNION SELECT dw.k, dw.src, g.dst, dw.d + 1 FROM dw JOIN g ON g.k = dw.k AND g.src = dw.dst WHERE dw.d < 6) SELECT k, dst AS action, CAST(min(d) AS BIGINT) AS dist FROM dw WHERE dst <> 'view' GROUP BY 1, 2",
    "bypass_nodes": f"WITH {_DAY} SELECT k, src, dst FROM g WHERE src <> 'view' AND dst <> 'view' UNION SELECT a.k, a.src, b.dst FROM g a JOIN g b ON a.k = b.k WHERE a.dst = 'view' AND b.src = 'view' AND a.src <> b.dst",
    "node_degrees": f"WITH {_DAY}, n AS (SELECT k, src AS node FROM g UNION SELECT k, dst FROM g) SELECT k, node, (SELECT count(*) FROM g WHERE g.k = n.k AND g.dst = n.node) AS n_in, (SELECT count(*) FROM g WHERE g.k = n.k AND g.src = n.node) AS n_out FROM n",
    "ancestor_keep": f"""WITH RECURSIVE {_DAY}, {_REACH}, {_CYCLIC}, s AS (SELECT w.k, w.dst AS sink, count(*) AS n FROM w WHERE w.k NOT IN (SELECT k FROM cy) AND NOT EXISTS (SELECT 1 FROM g WHERE g.k = w.k AND g.src = w.dst) GROUP BY 1, 2),
        b AS (SELECT k, sink FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, sink) = 1), keep AS (SELECT w.k, w.src AS node FROM w JOIN b ON w.k = b.k AND w.dst = b.sink) SELECT k, src, dst FROM g WHERE (k, src) IN (SELECT (k, node) FROM keep) AND (k, dst) IN (SELECT (k, node) FROM keep)""",
    "edge_precision_recall": f"WITH {_PRF} SELECT l_orderkey, round(precision, 6) AS precision, round(recall, 6) AS recall FROM pr",
    "edge_prf": f"WITH {_PRF}, m AS (SELECT avg(precision) AS p, avg(recall) AS r FROM pr) SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM m",
}
