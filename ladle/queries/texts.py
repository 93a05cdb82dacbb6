"""Steps, vocabularies and links: document lines are steps, part names are nouns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ladle.operators import facts as N
from ladle.operators import linking as L
from ladle.operators import textops as T
from ladle.queries import table


def step_explode(spark, sf_dir):
    s = T.steps(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    return s.select("doc_id", F.col("step_num").cast("bigint").alias("step_num"), "step")


def step_vocabulary(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return T.vocabulary(c, F.split("text", " "))


def token_df(spark, sf_dir):
    return T.document_frequency(T.term_counts(table(spark, sf_dir, "documents"), "doc_id", "text"))


def shared_token_pairs(spark, sf_dir):
    return T.sharing_pairs(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")))


def _labels(spark, sf_dir):
    """Part names as labels; the brand's number stands for the priority, the size for the depth."""
    p = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("label")).agg(F.min(F.length("p_brand")).alias("label_prio"), F.min("p_size").alias("hier_prio"))
    return p.withColumn("uri", F.concat(F.lit("part:"), F.col("label"))).select("uri", "label", "label_prio", "hier_prio")


def _requests(spark, sf_dir):
    """Texts to link: part names with their type, once each."""
    return table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_type", "p_name").alias("q")).distinct().select("q", F.col("q").alias("text"))


def tfidf_link(spark, sf_dir):
    return L.best_links(_requests(spark, sf_dir), _labels(spark, sf_dir), 0.6)


def tfidf_link_one(spark, sf_dir):
    heads = table(spark, sf_dir, "part").select(F.element_at(F.split("p_name", " "), -1).alias("q")).distinct().select("q", F.col("q").alias("text"))
    return L.link_names(heads, _labels(spark, sf_dir), 0.1)


def tfidf_link_known(spark, sf_dir):
    return L.best_links(_requests(spark, sf_dir), _labels(spark, sf_dir), 0.6, all_known=True)


def benchmark_link(spark, sf_dir):
    """The documents closest to each benchmark item."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("q"), "text")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uri"), F.col("text").alias("label"))
    return L.best_links(q, d, 0.2).select("q", "uri", F.round("score", 6).alias("score"))


def _nouns(spark, sf_dir):
    """Nouns of several kinds: a type and a name; names joined by a slash; a name twice; numbers around and before a name."""
    p = table(spark, sf_dir, "part")
    head, size = F.element_at(F.split("p_name", " "), -1), F.col("p_size").cast("string")
    kinds = [
        F.concat_ws(" ", F.lower("p_type"), "p_name"),
        F.concat(F.col("p_name"), F.lit("/ "), head),
        F.concat_ws(" ", "p_name", head, "p_name"),
        F.concat_ws(" ", size, head, "p_name"),
        F.concat_ws(" ", size, head, size),
        F.concat(size, F.lit(" "), F.col("p_name"), F.lit("s")),
    ]
    return p.select(F.explode(F.array(*kinds)).alias("name")).distinct()


def _ingredients(spark, sf_dir):
    """Part names, their last words, and numbers with a last word."""
    p = table(spark, sf_dir, "part")
    head = F.element_at(F.split("p_name", " "), -1)
    return p.select(F.explode(F.array("p_name", head, F.concat_ws(" ", F.col("p_size").cast("string"), head))).alias("name")).distinct()


def suffix_links(spark, sf_dir):
    return L.suffix_links(_nouns(spark, sf_dir), _ingredients(spark, sf_dir)).withColumn("found", F.array_sort("found"))


def sub_noun_links(spark, sf_dir):
    heads = table(spark, sf_dir, "part").select(F.element_at(F.split("p_name", " "), -1).alias("name")).distinct()
    stripped = L.suffix_links(_nouns(spark, sf_dir), heads)
    firsts = table(spark, sf_dir, "part").select(F.element_at(F.split("p_name", " "), 1).alias("name")).distinct()
    return L.sub_noun_links(stripped, firsts.unionAll(_nouns(spark, sf_dir))).withColumn("found", F.array_sort("found"))


def sub_ingredient_links(spark, sf_dir):
    return L.sub_ingredient_links(_ingredients(spark, sf_dir)).withColumn("found", F.array_sort("found"))


def label_endings(spark, sf_dir):
    n = table(spark, sf_dir, "part").select(F.col("p_name").alias("label")).distinct()
    return L.without_ending(n, "label", " ring")




def words_sql(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def tfidf_sql(k: str, t: str, labels: str, queries: str) -> str:
    return f"""tf AS (SELECT {k} AS uri, term, count(*) AS tf FROM (SELECT {k}, unnest({words_sql(t)}) AS term FROM {labels}) GROUP BY 1, 2),
    idf AS (SELECT term, ln((1 + (SELECT count(*) FROM {labels})) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
    rl AS (SELECT uri, term, tf * idf AS w FROM tf JOIN idf USING (term)), wl AS (SELECT uri, term, w / sqrt(sum(w * w) OVER (PARTITION BY uri)) AS w FROM rl),
    qt AS (SELECT q, term, count(*) AS tf FROM (SELECT q, unnest({words_sql("text")}) AS term FROM {queries}) GROUP BY 1, 2),
    rq AS (SELECT q, term, tf * idf AS w FROM qt JOIN idf USING (term)), wq AS (SELECT q, term, w / sqrt(sum(w * w) OVER (PARTITION BY q)) AS w FROM rq),
    sc AS (SELECT q, uri, round(sum(wq.w * wl.w), 9) AS score FROM wq JOIN wl USING (term) GROUP BY 1, 2),
    best AS (SELECT q, uri, score FROM sc QUALIFY score = max(score) OVER (PARTITION BY q))"""


LABELS = "labels_ AS (SELECT 'part:' || p_name AS uri, p_name AS label, min(length(p_brand)) AS label_prio, min(p_size) AS hier_prio FROM part GROUP BY p_name)"
REQUESTS = "requests AS (SELECT DISTINCT p_type || ' ' || p_name AS q, p_type || ' ' || p_name AS text FROM part)"
_HEAD = "split_part(p_name, ' ', 2)"
NOUNS = f"""nouns AS (SELECT DISTINCT unnest([lower(p_type) || ' ' || p_name, p_name || '/ ' || {_HEAD}, p_name || ' ' || {_HEAD} || ' ' || p_name, p_size || ' ' || {_HEAD} || ' ' || p_name, p_size || ' ' || {_HEAD} || ' ' || p_size, p_size || ' ' || p_name || 's']) AS name FROM part),
    ings AS (SELECT DISTINCT unnest([p_name, {_HEAD}, p_size || ' ' || {_HEAD}]) AS name FROM part), heads AS (SELECT DISTINCT {_HEAD} AS name FROM part), firsts AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS name FROM part)"""


def strip_sql(k: str, names: str, others: str, shorter: bool, digits: bool, once: bool) -> str:
    """Tables {k}s (name, found, rest): candidates share a word with a name (name, rest); longest first, as often as the
    rest has words (or once) each is taken off the end where it begins a word; a slash left at the end goes."""
    size = "length(other) < length(rest) AND other <> rest" if shorter else "length(other) <= length(rest)"
    number = "AND (at_ = 0 OR NOT regexp_matches(cand, '^[0-9]'))" if digits else ""
    return f"""{k}o AS (SELECT DISTINCT n.name, n.rest, o.name AS other FROM (SELECT name, rest, unnest({words_sql('rest')}) AS term FROM {names}) n JOIN (SELECT name, unnest({words_sql('name')}) AS term FROM {others}) o USING (term)),
    {k}c AS (SELECT n.name, n.rest, coalesce(list(other ORDER BY length(other) DESC, other) FILTER (other IS NOT NULL AND {size} AND contains(n.rest, other)), []) AS cands FROM (SELECT n.name, n.rest, o.other FROM {names} n LEFT JOIN {k}o o ON n.name = o.name) n GROUP BY 1, 2),
    {k}r AS (SELECT name, rest, cands, CAST([] AS VARCHAR[]) AS found, 0 AS i, len(cands) * {"1" if once else "len(string_split(rest, ' '))"} AS turns FROM {k}c
        UNION ALL SELECT name, CASE WHEN good THEN rtrim(CASE WHEN cut LIKE '%/' THEN left(cut, length(cut) - 1) ELSE cut END, ' ') ELSE rest END, cands, CASE WHEN good THEN list_append(found, cand) ELSE found END, i + 1, turns
            FROM (SELECT *, rtrim(left(rest, greatest(at_, 0)), ' ') AS cut, at_ >= 0 AND (at_ = 0 OR substr(rest, at_, 1) = ' ') {number} AS good FROM (SELECT *, CASE WHEN ends_with(rest, cand) THEN length(rest) - length(cand) ELSE -1 END AS at_ FROM (SELECT *, cands[i % len(cands) + 1] AS cand FROM {k}r WHERE i < turns)))),
    {k}s AS (SELECT name, list_distinct(found) AS found, found AS every, rest FROM {k}r WHERE i = turns)"""



def batch_links(spark, sf_dir):
    """Names linked and missed of four runs over part names, with the thresholds of the batch linker."""
    names, types = (table(spark, sf_dir, "part").select(F.col(c).alias("name")) for c in ("p_name", "p_type"))
    wide = _requests(spark, sf_dir).select(F.col("text").alias("name"))
    own = {("ingredient", "food"): wide, ("object", "food"): wide, ("object", "equipment"): names, ("verb", "preparation"): types}
    runs = {"-".join(k): (own[k], L.LabelMatcher(_labels(spark, sf_dir), least)) for k, least in L.BATCH_THRESHOLDS.items()}
    return L.link_batches(runs)[1]


def ingredient_names(spark, sf_dir):
    """The cleaned names of what each order holds, as the ingredients of a recipe."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return N.ingredient_names(li.groupBy(F.col("l_orderkey").alias("recipe_id")).agg(F.collect_set(F.concat_ws(" ", F.lit("the"), F.col("p_size").cast("string"), F.concat("p_name", F.lit("s")))).alias("ingredients")))


QUERIES = {f.__name__: f for f in (batch_links, ingredient_names, step_explode, step_vocabulary, token_df, shared_token_pairs, tfidf_link, tfidf_link_one, tfidf_link_known, benchmark_link, suffix_links, sub_noun_links, sub_ingredient_links, label_endings)}
def _batch_sql(kind: str, names: str, least: float) -> str:
    return f"""SELECT '{kind}' AS kind, (SELECT count(*) FROM {names}) AS n_names, (SELECT count(*) FROM {names} WHERE q NOT IN (SELECT q FROM (WITH {tfidf_sql('uri', 'label', 'labels_', names)} SELECT q FROM best WHERE score >= {least}))) AS n_missed"""


ORACLE = {
    "batch_links": f"WITH {LABELS}, {REQUESTS}, names_ AS (SELECT DISTINCT p_name AS q, p_name AS text FROM part), types_ AS (SELECT DISTINCT p_type AS q, p_type AS text FROM part) "
    + " UNION ALL ".join([_batch_sql("ingredient-food", "requests", 0.6), _batch_sql("object-food", "requests", 0.9), _batch_sql("object-equipment", "names_", 0.85), _batch_sql("verb-preparation", "types_", 0.85)]),
    # the base form of these names is the name without its s
    "ingredient_names": "SELECT DISTINCT l_orderkey AS recipe_id, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey",
    "step_explode": """WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(trim(x, ' ')) > 0) AS s FROM documents)
        SELECT doc_id, CAST(i - 1 AS BIGINT) AS step_num, replace(s[i] || '.', ' ,', ',') AS step FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM l)""",
    "step_vocabulary": "SELECT DISTINCT name FROM (SELECT unnest(string_split(text, ' ')) AS name FROM conversations) WHERE name <> ''",
    "token_df": f"SELECT term, CAST(sum(tf) AS BIGINT) AS tf, CAST(count(*) AS BIGINT) AS df FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({words_sql('text')}) AS term FROM documents) GROUP BY 1, 2) GROUP BY term",
    "shared_token_pairs": f"WITH t AS (SELECT DISTINCT p_name AS name, unnest({words_sql('p_name')}) AS term FROM part) SELECT DISTINCT x.name AS a, y.name AS b FROM t x JOIN t y USING (term) WHERE x.name <> y.name",
    "tfidf_link": f"WITH {LABELS}, {REQUESTS}, {tfidf_sql('uri', 'label', 'labels_', 'requests')} SELECT q, uri, score FROM best WHERE score >= 0.6",
    "tfidf_link_one": f"""WITH {LABELS}, heads AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS q, split_part(p_name, ' ', 2) AS text FROM part), {tfidf_sql('uri', 'label', 'labels_', 'heads')},
        t AS (SELECT best.*, label_prio, hier_prio, min(label_prio) OVER (PARTITION BY q) AS least FROM best JOIN labels_ USING (uri) WHERE score >= 0.1),
        a AS (SELECT *, sum(CAST(label_prio = least AS INT)) OVER (PARTITION BY q) = 1 AS alone FROM t)
        SELECT q, uri, score FROM a QUALIFY row_number() OVER (PARTITION BY q ORDER BY CASE WHEN alone AND label_prio = least THEN 0 ELSE 1 END, hier_prio, uri) = 1""",
    "tfidf_link_known": f"WITH {LABELS}, {REQUESTS}, {tfidf_sql('uri', 'label', 'labels_', 'requests')} SELECT q, uri, score FROM best WHERE score >= 0.6 AND q NOT IN (SELECT q FROM qt WHERE term NOT IN (SELECT term FROM idf))",
    "benchmark_link": "WITH items AS (SELECT CAST(item_id AS VARCHAR) AS q, text FROM benchmark), " + tfidf_sql("doc_id", "text", "documents", "items") + " SELECT q, uri, round(score, 6) AS score FROM best WHERE score >= 0.2",
    "sub_ingredient_links": f"WITH RECURSIVE {NOUNS}, b AS (SELECT name, name AS rest FROM ings), {strip_sql('g', 'b', 'ings', True, True, True)} SELECT name, list_sort(found) AS found FROM gs",
    "suffix_links": f"WITH RECURSIVE {NOUNS}, b AS (SELECT name, name AS rest FROM nouns), {strip_sql('n', 'b', 'ings', False, False, False)} SELECT name, list_sort(found) AS found, rest FROM ns",
    "label_endings": "WITH n AS (SELECT DISTINCT p_name AS label FROM part) SELECT label FROM n UNION ALL SELECT left(label, length(label) - 5) FROM n WHERE label LIKE '% ring'",
}
ORACLE["sub_noun_links"] = f"""WITH RECURSIVE {NOUNS}, b AS (SELECT name, name AS rest FROM nouns), {strip_sql('h', 'b', 'heads', False, False, False)},
    op AS (SELECT name, rest FROM hs WHERE NOT (length(rest) <= 1 OR (regexp_matches(rest, '^[0-9]') AND regexp_matches(rest, '[0-9]$')))), su AS (SELECT name FROM firsts UNION SELECT name FROM nouns),
    {strip_sql('m', 'op', 'su', True, True, False)} SELECT name, list_sort(found) AS found, rest AS leftover FROM ms"""
