"""Co-occurrence and substitution: orders are recipes, part names are ingredients."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladle.operators import cooccurrence as C
from ladle.operators import nearest as V
from ladle.queries import table


def basket(spark, sf_dir) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    return C.members(items, "l_orderkey", "p_name")


BASKET = "m AS (SELECT DISTINCT l_orderkey AS grp, p_name AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"
PAIRS = "p AS (SELECT x.item AS a, y.item AS b, CAST(count(*) AS BIGINT) AS n FROM m x JOIN m y ON x.grp = y.grp AND x.item < y.item GROUP BY 1, 2), s AS (SELECT a, b, n FROM p UNION ALL SELECT b, a, n FROM p)"
COSINES = "z AS (SELECT a, sqrt(sum(CAST(n AS DOUBLE) * n)) AS norm FROM s GROUP BY a), u AS (SELECT s.a, s.b, s.n / z.norm AS u FROM s JOIN z ON s.a = z.a), c AS (SELECT x.a AS x, y.a AS y, round(sum(x.u * y.u), 6) AS cos FROM u x JOIN u y ON x.b = y.b GROUP BY 1, 2)"


def occurrence_counts(spark, sf_dir):
    return C.occurrences(basket(spark, sf_dir))


def cooc_counts(spark, sf_dir):
    return C.pair_counts(basket(spark, sf_dir))


def _cosines(spark, sf_dir):
    # the counts have a row for each pair of names: small whatever the number of orders
    return C.cosines(C.symmetric(C.pair_counts(basket(spark, sf_dir))))


def cooc_topk(spark, sf_dir):
    return C.top_k(_cosines(spark, sf_dir), 10).select("x", "y", "cos", F.col("rank").cast("bigint").alias("rank"))


def cond_cooc(spark, sf_dir):
    m = basket(spark, sf_dir)
    rows = C.symmetric(C.pair_counts(m))
    targets = m.groupBy("grp").agg(F.min("item").alias("target"))
    return C.masked_top_k(m, rows, targets, 3).select("grp", "target", "item", "cos", F.col("rank").cast("bigint").alias("rank"))


def emb_topk(spark, sf_dir):
    """Every twentieth vector against all vectors."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return V.nearest(e.filter("id % 20 = 0"), e, 20).select("x", "y", "cos", F.col("rank").cast("bigint").alias("rank"))


def rank_vote(spark, sf_dir):
    """Two rankings of names: by co-occurrence cosine, and by counts of shared orders."""
    cos = C.top_k(_cosines(spark, sf_dir), 30)
    counts = C.symmetric(C.pair_counts(basket(spark, sf_dir))).select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("n").alias("cos"))
    return C.rank_vote([cos, C.top_k(counts, 30)])


QUERIES = {f.__name__: f for f in (occurrence_counts, cooc_counts, cooc_topk, cond_cooc, emb_topk, rank_vote)}
ORACLE = {
    "occurrence_counts": f"WITH {BASKET} SELECT item, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY item",
    "cooc_counts": f"WITH {BASKET}, {PAIRS} SELECT a, b, n FROM p",
    "cooc_topk": f"WITH {BASKET}, {PAIRS}, {COSINES} SELECT x, y, cos, CAST(row_number() OVER (PARTITION BY x ORDER BY cos DESC, y) AS BIGINT) AS rank FROM c QUALIFY rank <= 10",
    "cond_cooc": f"""WITH {BASKET}, {PAIRS}, o AS (SELECT item, count(*) AS total FROM m GROUP BY item), sc AS (SELECT s.a, s.b, s.n / o.total AS p FROM s JOIN o ON s.a = o.item),
        t AS (SELECT grp, min(item) AS target FROM m GROUP BY grp), k AS (SELECT t.grp, t.target, m.item AS b, sc.a AS item, sc.p FROM t JOIN m ON t.grp = m.grp JOIN sc ON sc.b = m.item),
        q AS (SELECT grp, b, p AS q FROM k WHERE item = target), nq AS (SELECT grp, sqrt(sum(q * q)) AS nq FROM q GROUP BY grp),
        d AS (SELECT k.grp, k.target, k.item, round(sum(k.p * coalesce(q.q, 0)) / (sqrt(sum(k.p * k.p)) * any_value(nq.nq)), 6) AS cos FROM k JOIN nq ON k.grp = nq.grp LEFT JOIN q ON k.grp = q.grp AND k.b = q.b GROUP BY 1, 2, 3)
        SELECT grp, target, item, cos, CAST(row_number() OVER (PARTITION BY grp ORDER BY cos DESC, item) AS BIGINT) AS rank FROM d QUALIFY rank <= 3""",
    "emb_topk": """WITH s AS (SELECT q.vec_id AS x, e.vec_id AS y, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])))), 6) AS cos
        FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0) SELECT x, y, cos, CAST(row_number() OVER (PARTITION BY x ORDER BY cos DESC, y) AS BIGINT) AS rank FROM s QUALIFY rank <= 20""",
    "rank_vote": f"""WITH {BASKET}, {PAIRS}, {COSINES}, r1 AS (SELECT x, y, row_number() OVER (PARTITION BY x ORDER BY cos DESC, y) AS rank FROM c QUALIFY rank <= 30),
        r2 AS (SELECT a AS x, b AS y, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS rank FROM s QUALIFY rank <= 30)
        SELECT r1.x, r1.y, CAST(r1.rank + r2.rank AS BIGINT) AS votes FROM r1 JOIN r2 ON r1.x = r2.x AND r1.y = r2.y""",
}
