"""Readers and writers of the formats that the pipelines exchange."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECIPES = "id bigint, name string, minutes string, contributor_id string, submitted string, tags string, nutrition string, n_steps string, steps string, description string, ingredients string, n_ingredients string"


def list_literal(c: Column) -> Column:
    """A Python list literal of strings as an array; what JSON with single quotes can't read is parsed
    as a literal."""

    @F.pandas_udf("array<string>")
    def literal(s: pd.Series) -> pd.Series:
        return s.map(_parsed_literal)

    quick = F.from_json(c, "array<string>", {"allowSingleQuotes": "true"})
    return F.when(c.isNull(), None).when(quick.isNotNull() & ~c.contains("\\x") & ~c.contains("\\u"), quick).otherwise(literal(c))


def _parsed_literal(x: str | None) -> list[str] | None:
    try:
        return [str(v) for v in ast.literal_eval(x)]
    except (ValueError, SyntaxError, TypeError):
        return None


def read_recipes(spark: SparkSession, path: str, n: int | None = None, seed: int = 0) -> DataFrame:
    """recipe_id, name, tags, steps, ingredients of a CSV with a header; n: an exact sample by seed."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    arrays = [list_literal(F.col(c)).alias(c) for c in ("tags", "steps", "ingredients")]
    out = df.select(F.col("id").cast("bigint").alias("recipe_id"), "name", *arrays)
    return out if n is None else out.orderBy(F.xxhash64(F.lit(seed), "recipe_id"), "recipe_id").limit(n)


def write_recipes(df: DataFrame, path: str) -> None:
    """The same CSV schema, the id included, lists as literals."""
    text = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.concat(F.lit("'"), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))), ", "), F.lit("]"))
    df.select(F.col("recipe_id").alias("id"), "name", *[text(c).alias(c) for c in ("tags", "steps", "ingredients")]).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


NQUAD = r'^(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*(<[^>]*>|_:\S+)?\s*\.\s*$'


def read_nquads(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o, o_is_literal, o_lang, g. Blank lines and comments are skipped."""
    lines = spark.read.text(path).filter(F.col("value").rlike(NQUAD))
    part = lambda i: F.regexp_extract("value", NQUAD, i)
    bare = lambda c: F.regexp_replace(c, "^<|>$", "")
    o = part(3)
    literal = o.startswith('"')
    inner = F.regexp_extract(o, r'^"((?:[^"\\]|\\.)*)"', 1)
    plain = F.replace(F.replace(F.replace(F.replace(inner, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")), F.lit("\\\\"), F.lit("\\"))
    lang = F.nullif(F.regexp_extract(o, r'"@([A-Za-z0-9-]+)$', 1), F.lit(""))
    return lines.select(bare(part(1)).alias("s"), bare(part(2)).alias("p"), F.when(literal, plain).otherwise(bare(o)).alias("o"), literal.alias("o_is_literal"), lang.alias("o_lang"), F.nullif(bare(part(4)), F.lit("")).alias("g"))


def rejected_nquads(spark: SparkSession, path: str) -> DataFrame:
    """file, line, reason of the lines that `read_nquads` leaves out, but for blank ones and comments: what the first part
    is that can't be read."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    subject, predicate, thing = r"(<[^>]*>|_:\S+)", r"<[^>]*>", r'(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)'
    bad = lines.filter(~F.trim("line").startswith("#") & (F.trim("line") != "") & ~F.col("line").rlike(NQUAD))
    reason = (
        F.when(~F.col("line").rlike(f"^{subject}\\s"), "subject")
        .when(~F.col("line").rlike(f"^{subject}\\s+{predicate}\\s"), "predicate")
        .when(~F.col("line").rlike(f"^{subject}\\s+{predicate}\\s+{thing}"), "object")
        .when(~F.col("line").rlike(r"\.\s*$"), "no full stop")
        .otherwise("graph")
    )
    return bad.select("file", "line", reason.alias("reason"))


def write_nquads(df: DataFrame, path: str, graph: str) -> None:
    """s, p, o as quads of one graph; o is an IRI unless o_is_literal says otherwise."""
    literal = F.col("o_is_literal") if "o_is_literal" in df.columns else F.lit(False)
    escaped = F.replace(F.replace(F.replace(F.col("o"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    o = F.when(literal, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(F.concat(F.lit("<"), F.col("o"), F.lit(">")))
    df.select(F.concat(F.lit("<"), F.col("s"), F.lit("> <"), F.col("p"), F.lit("> "), o, F.lit(f" <{graph}> .")).alias("value")).write.mode("overwrite").text(path)


OWL = """`_about` string, `rdfs:label` array<struct<_VALUE: string, `_lang`: string, `_xml:lang`: string>>, `oboInOwl:hasExactSynonym` array<struct<_VALUE: string, `_lang`: string, `_xml:lang`: string>>,
    `oboInOwl:hasSynonym` array<struct<_VALUE: string, `_lang`: string, `_xml:lang`: string>>, `rdfs:subClassOf` array<struct<`_rdf:resource`: string>>, `_rdf:about` string"""


def read_owl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(uri, label, lang, label_prio) with label 0, exact synonym 1, synonym 2; and edges (src, dst)
    of subClassOf. Classes without a name are skipped."""
    x = spark.read.format("xml").option("rowTag", "owl:Class").schema(OWL).load(path)
    x = x.withColumn("uri", F.col("`_rdf:about`")).filter("uri is not null")
    parts = []
    for i, c in enumerate(("rdfs:label", "oboInOwl:hasExactSynonym", "oboInOwl:hasSynonym")):
        parts.append(x.select("uri", F.explode(f"`{c}`").alias("l")).select("uri", F.col("l._VALUE").alias("label"), F.coalesce(F.col("l.`_xml:lang`"), F.col("l._lang")).alias("lang"), F.lit(i).alias("label_prio")))
    labels = parts[0].unionByName(parts[1]).unionByName(parts[2]).filter("label is not null")
    edges = x.select(F.col("uri").alias("src"), F.explode("`rdfs:subClassOf`").alias("s")).select("src", F.col("s.`_rdf:resource`").alias("dst")).filter("dst is not null").distinct()
    return labels, edges


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id bigint, name string").option("sep", "\t").option("quote", "").csv(path)


def write_dictionary(df: DataFrame, path: str) -> None:
    df.select("id", "name").write.mode("overwrite").option("sep", "\t").option("quote", "").option("escapeQuotes", False).csv(path)


def read_triples(spark: SparkSession, path: str, entities: DataFrame | None = None, relations: DataFrame | None = None) -> DataFrame:
    """h, r, t; as ids where dictionaries are given."""
    from ladle.operators.triples import encode

    t = spark.read.schema("h string, r string, t string").option("sep", "\t").option("quote", "").csv(path)
    return t if entities is None else encode(t, entities, relations)


def write_triples(df: DataFrame, path: str) -> None:
    df.select("h", "r", "t").write.mode("overwrite").option("sep", "\t").option("quote", "").option("escapeQuotes", False).csv(path)


def _flatten(tree: dict) -> Iterator[tuple[int, int | None, int, str | None, str | None]]:
    """node, parent, depth, rel, leaf; equal children of a node once."""
    counter = 0
    stack = [(None, 0, x) for x in ([tree] if isinstance(tree, dict) else [])]
    while stack:
        parent, depth, x = stack.pop(0)
        if isinstance(x, dict):
            for rel, children in x.items():
                me, counter = counter, counter + 1
                yield me, parent, depth, rel, None
                seen = set()
                for c in children:
                    form = json.dumps(c, sort_keys=True)
                    if form not in seen:
                        seen.add(form)
                        stack.append((me, depth + 1, c))
        else:
            me, counter = counter, counter + 1
            yield me, parent, depth, None, str(x)


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """tree (a number for the line, so equal lines are trees of their own), node, parent, depth, rel, leaf
    from lines of nested JSON."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(key, *row) for key, line in zip(b["tree"], b["value"]) for row in _flatten(json.loads(line))]
            yield pd.DataFrame(rows, columns=["tree", "node", "parent", "depth", "rel", "leaf"]).astype({"parent": "Int64"})

    lines = spark.read.text(path).filter(F.trim("value") != "").select(F.monotonically_increasing_id().alias("tree"), "value")
    return lines.mapInPandas(run, "tree long, node long, parent long, depth int, rel string, leaf string")


def write_trees(nodes: DataFrame, path: str) -> None:
    """Lines of nested JSON from tree, node, parent, depth, rel, leaf, one tree at a time."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        below: dict = {}
        for r in pdf.sort_values("node").itertuples():
            below.setdefault(None if pd.isna(r.parent) else int(r.parent), []).append(r)

        def build(r) -> object:
            return {r.rel: [build(c) for c in below.get(int(r.node), [])]} if r.leaf is None or pd.isna(r.leaf) else r.leaf

        return pd.DataFrame({"value": [json.dumps(build(r)) for r in below.get(None, [])]})

    nodes.groupBy("tree").applyInPandas(one, "value string").write.mode("overwrite").text(path)


FLOW = "edges array<array<string>>, edge_labels array<string>, output_node string"


def write_flow_graphs(df: DataFrame, path: str) -> None:
    """Lines {"recipe_id": ..., "edges": ..., "edge_labels": ..., "output_node": ...}."""
    df.select("recipe_id", "edges", "edge_labels", "output_node").write.mode("overwrite").json(path)


def read_flow_graphs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"recipe_id bigint, {FLOW}").json(path)


def read_flow_graph_object(spark: SparkSession, path: str) -> DataFrame:
    """The same from one JSON object {recipe_id: graph}."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string, struct<{', '.join(x.replace(' ', ': ', 1) for x in FLOW.split(', '))}>>")).alias("recipe_id", "g"))
    return whole.select(F.col("recipe_id").cast("bigint").alias("recipe_id"), "g.*")


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """kind, src, dst, ord from a JSON object of objects name -> list (or string)."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, string>")).alias("kind", "body"))
    pairs = whole.select("kind", F.explode(F.from_json("body", "map<string, string>")).alias("src", "value"))
    many = F.coalesce(F.from_json("value", "array<string>"), F.array("value"))
    return pairs.select("kind", "src", F.posexplode(many).alias("ord", "dst")).select("kind", "src", "dst", "ord")


def write_links(df: DataFrame, path: str) -> None:
    """kind, src, dst, ord as Parquet, a folder for each kind."""
    df.select("kind", "src", "dst", "ord").write.mode("overwrite").partitionBy("kind").parquet(path)


#: The fields of annotated tokens and of annotated edges, and their types.
GOLD_TOKEN = {"step": "int", "sentence": "int", "word_no": "int", "word": "string", "pos": "string", "tag": "string", "other": "string"}
GOLD_EDGE = {"from_step": "int", "from_sentence": "int", "from_word": "int", "link": "string", "to_step": "int", "to_sentence": "int", "to_word": "int"}


def _cut(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """file, value, x (its fields) of lines that are no comments."""
    raw = spark.read.option("encoding", encoding).option("sep", "\x00").option("quote", "").csv(path, schema="value string").select("value", F.col("_metadata.file_path").alias("file"))
    return raw.filter(~F.col("value").startswith("#")).withColumn("x", F.split("value", " "))


def _fields(spark: SparkSession, path: str, kinds: dict[str, str], encoding: str) -> DataFrame:
    cut = _cut(spark, path, encoding).filter(F.size("x") == len(kinds))
    return cut.select("file", *[F.try_element_at("x", F.lit(i)).try_cast(k).alias(c) for i, (c, k) in enumerate(kinds.items(), 1)])


def _rejected(spark: SparkSession, path: str, kinds: dict[str, str], encoding: str) -> DataFrame:
    numbers = [F.when(~F.try_element_at("x", F.lit(i)).rlike(r"^\s*[+-]?[0-9]+\s*$"), F.lit(c)) for i, (c, k) in enumerate(kinds.items(), 1) if k == "int"]
    odd = F.array_join(F.array_compact(F.array(*numbers)), ", ")
    reason = F.when(F.size("x") != len(kinds), F.concat(F.size("x").cast("string"), F.lit(f" fields, not {len(kinds)}"))).when(odd != "", F.concat(F.lit("no number: "), odd))
    return _cut(spark, path, encoding).select("file", F.col("value").alias("line"), reason.alias("reason")).filter("reason is not null")


def read_gold_tokens(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """file, step, sentence, word_no, word, pos, tag, other of lines with seven fields; what is no number is null."""
    return _fields(spark, path, GOLD_TOKEN, encoding)


def read_gold_edges(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """file, from (step, sentence, word), link, to (step, sentence, word) of lines with seven fields; what is no number is null."""
    return _fields(spark, path, GOLD_EDGE, encoding)


def rejected_gold_tokens(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """file, line, reason of token lines with other than seven fields (left out) or with a field that should be a number
    (read as null). Comments and blank lines are no such lines."""
    return _rejected(spark, path, GOLD_TOKEN, encoding)


def rejected_gold_edges(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """file, line, reason of edge lines, as `rejected_gold_tokens`."""
    return _rejected(spark, path, GOLD_EDGE, encoding)


def save_model(emb: DataFrame, relations: DataFrame, config: dict, path: str) -> None:
    """id, vec of entities and relations as Parquet, the settings as JSON."""
    emb.write.mode("overwrite").parquet(f"{path}/entities")
    relations.write.mode("overwrite").parquet(f"{path}/relations")
    emb.sparkSession.createDataFrame([(json.dumps(config),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    config = json.loads(spark.read.text(f"{path}/config").first()["value"])
    return spark.read.parquet(f"{path}/entities"), spark.read.parquet(f"{path}/relations"), config


def cached(spark: SparkSession, path: str, compute) -> DataFrame:
    """The table at path, computed and written first if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_relations(edges: DataFrame, path: str) -> None:
    """Lines {"src": ..., "dst": ..., "label": ...} of an entity graph."""
    edges.select("src", "dst", "label").write.mode("overwrite").json(path)


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, label from such lines, or from one object {"subclass_edges": [[src, dst]], "subclass_edge_labels": [...]}."""
    schema = "src string, dst string, label string, subclass_edges array<array<string>>, subclass_edge_labels array<string>"
    x = spark.read.schema(schema).json(path)
    pairs = x.filter("subclass_edges is not null").select(F.explode(F.arrays_zip("subclass_edges", "subclass_edge_labels")).alias("e"))
    inner = pairs.select(F.col("e.subclass_edges")[0].alias("src"), F.col("e.subclass_edges")[1].alias("dst"), F.col("e.subclass_edge_labels").alias("label"))
    return x.filter("src is not null").select("src", "dst", "label").unionByName(inner)


def read_path_triples(spark: SparkSession, path: str, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """key, heads, rels, t, length from lines "[heads]\\t[relations]\\ttail" of names as list literals; ids by the dictionaries.
    A line with an unknown name drops out. Paths of one length are a group of `length`."""
    raw = spark.read.schema("h string, r string, t string").option("sep", "\t").option("quote", "").csv(path)
    x = raw.select(F.xxhash64("h", "r", "t").alias("key"), list_literal(F.col("h")).alias("hs"), list_literal(F.col("r")).alias("rs"), "t").distinct()

    def ids(column: str, dictionary: DataFrame, name: str) -> DataFrame:
        each = x.select("key", F.posexplode(column).alias("at", "name")).join(dictionary, "name")
        return each.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda e: e["id"]).alias(name))

    out = x.join(ids("hs", entities, "heads"), "key").join(ids("rs", relations, "rels"), "key").join(entities.select(F.col("id").alias("tail"), F.col("name").alias("t")), "t")
    return out.filter("size(heads) = size(hs) and size(rels) = size(rs)").select("key", "heads", "rels", F.col("tail").alias("t"), F.size("rels").alias("length"))


def write_gold(graphs: DataFrame, recipes: DataFrame, path: str) -> None:
    """Reduced gold graphs (recipe_id, src, dst) as Parquet, and the recipes they are of in the recipe CSV's schema."""
    graphs.write.mode("overwrite").parquet(f"{path}/graphs")
    write_recipes(recipes, f"{path}/recipes")


def write_features(roles: DataFrame, edges: DataFrame, path: str) -> None:
    """A matrix of node features (node and 0/1 columns) and the edges between the nodes as Parquet."""
    roles.write.mode("overwrite").parquet(f"{path}/features")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """name of each item of a JSON list of strings."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("name"))


def write_corpus(corpus: DataFrame, path: str) -> None:
    """A parsed corpus (see `facts.corpus`) as Parquet."""
    corpus.write.mode("overwrite").parquet(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
