"""Linking names to labels: TF-IDF cosine with thresholds and ties, and suffix matching."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladle.functions.nlp import lemma
from ladle.operators.textops import term_counts, words
from ladle.session import stored


def tfidf(labels: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Fit on labels: (key, term, w) with L2-normalised rows, and (term, idf), idf = ln((1+n)/(1+df)) + 1."""
    tf = term_counts(labels, key, text)
    idf = fitted_idf(tf, labels.count())
    return normalised(tf, idf, key), idf


def fitted_idf(tf: DataFrame, n: int) -> DataFrame:
    """term, idf from the counts (key, term) of n texts."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", (F.ln((1 + F.lit(float(n))) / (1 + F.col("df"))) + 1).alias("idf"))


def normalised(tf: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """key, term, w of counts under a fitted idf; unknown terms drop out."""
    raw = tf.join(idf, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("raw"))
    size = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("size"))
    return raw.join(size, key).select(key, "term", (F.col("raw") / F.col("size")).alias("w"))


#: Terms of a query that its first candidate is looked for with, and what sums may be off by.
PROBES, SLACK = 3, 1e-8


def _partial(terms: DataFrame, weights: DataFrame) -> DataFrame:
    """q, uri, part, seen: for each query and label that share one of the terms, the sum of the products of their weights
    over them, and of the label's squares. terms: q, term, w; weights: uri, term, v."""
    return terms.join(weights, "term").groupBy("q", "uri").agg(F.sum(F.col("w") * F.col("v")).alias("part"), F.sum(F.col("v") * F.col("v")).alias("seen"))


def _completed(found: DataFrame, terms: DataFrame, weights: DataFrame) -> DataFrame:
    """q, uri, score: part plus the products over further terms of the query. found: q, uri, part; terms: q, term, w."""
    more = found.join(terms, "q").join(weights, ["uri", "term"]).groupBy("q", "uri").agg(F.sum(F.col("w") * F.col("v")).alias("more"))
    return found.select("q", "uri", "part").join(more, ["q", "uri"], "left").select("q", "uri", (F.col("part") + F.coalesce("more", F.lit(0.0))).alias("score"))


def best_links(queries: DataFrame, labels: DataFrame, least: float, all_known: bool = False) -> DataFrame:
    """q, uri, score: every label with the best cosine of its query, if that reaches `least`.

    queries: q, text; labels: uri (unique), label. all_known: a query with a word that no label has gets no link.

    Each query's heaviest terms find a first label, whose cosine the best one reaches. A label that does so shares one of the
    query's rarer terms: its commonest ones, as long as their weights together are shorter than that cosine, can't
    bring it there alone. The products over the rarer terms give a part of every such label's cosine; the rest is at most what
    both have left in length. Only labels that can still be the best ones meet the query's other terms.
    """
    counts = stored(term_counts(labels, "uri", "label"))
    idf = stored(fitted_idf(counts, labels.count()))
    tf = stored(term_counts(queries, "q", "text"))
    # lengths take all terms of a label, products only those that a query has
    raw = counts.join(idf, "term").select("uri", "term", (F.col("tf") * F.col("idf")).alias("raw"))
    size = raw.groupBy("uri").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("size"))
    asked = tf.select("term").distinct()
    weights = stored(raw.join(asked, "term", "left_semi").join(size, "uri").select("uri", "term", (F.col("raw") / F.col("size")).alias("v")))
    if all_known:
        unknown = tf.join(idf, "term", "left_anti").select("q").distinct()
        tf = tf.join(unknown, "q", "left_anti")
    by_weight = Window.partitionBy("q").orderBy(F.desc("w"), "term")
    common = Window.partitionBy("q").orderBy("idf", "term").rowsBetween(Window.unboundedPreceding, 0)
    terms = normalised(tf, idf, "q").join(idf, "term").select("q", "term", "w", F.row_number().over(by_weight).alias("place"), F.sqrt(F.sum(F.col("w") * F.col("w")).over(common)).alias("reach"))
    terms = stored(terms)
    heavy = F.col("place") <= PROBES
    first = _partial(terms.filter(heavy).select("q", "term", "w"), weights).groupBy("q").agg(F.max(F.struct("part", "uri")).alias("x")).select("q", "x.part", "x.uri")
    floor = _completed(first, terms.filter(~heavy).select("q", "term", "w"), weights).groupBy("q").agg(F.max("score").alias("floor"))
    known = terms.join(floor, "q").withColumn("floor", F.greatest(F.col("floor"), F.lit(least)) - SLACK).withColumn("rare", F.col("reach") >= F.col("floor"))
    known = stored(known.select("q", "term", "w", "rare", "floor", F.sqrt(F.coalesce(F.sum(F.when(~F.col("rare"), F.col("w") * F.col("w"))).over(Window.partitionBy("q")), F.lit(0.0))).alias("left")))
    of_query = known.groupBy("q").agg(F.first("floor").alias("floor"), F.first("left").alias("left"))
    parts = _partial(known.filter("rare").select("q", "term", "w"), weights).join(of_query, "q")
    most = F.col("part") + F.col("left") * F.sqrt(F.greatest(1 - F.col("seen"), F.lit(0.0))) + SLACK
    open_ = parts.filter(most >= F.col("floor")).withColumn("top", F.max("part").over(Window.partitionBy("q"))).filter(most >= F.col("top"))
    score = _completed(stored(open_.select("q", "uri", "part")), known.filter(~F.col("rare")).select("q", "term", "w"), weights).withColumn("score", F.round("score", 9))
    best = F.max("score").over(Window.partitionBy("q"))
    return score.withColumn("best", best).filter((F.col("score") == F.col("best")) & (F.col("score") >= least)).drop("best")


def one_of_ties(ties: DataFrame, labels: DataFrame) -> DataFrame:
    """q, uri, score: a tie whose label priority is the only smallest one wins; else the tie of the
    smallest hierarchy depth over all ties (then of the smallest uri).

    labels: uri, label_prio, hier_prio.
    """
    w = Window.partitionBy("q")
    t = ties.join(labels.select("uri", "label_prio", "hier_prio"), "uri").withColumn("least", F.min("label_prio").over(w))
    t = t.withColumn("alone", F.sum((F.col("label_prio") == F.col("least")).cast("int")).over(w) == 1)
    order = F.when(F.col("alone") & (F.col("label_prio") == F.col("least")), 0).otherwise(1)
    return t.groupBy("q").agg(F.min_by(F.struct("uri", "score"), F.struct(order, "hier_prio", "uri")).alias("x")).select("q", "x.uri", "x.score")


def link_names(queries: DataFrame, labels: DataFrame, least: float, all_known: bool = False) -> DataFrame:
    """q, uri, score: one link for each query that has any. labels: uri, label, label_prio, hier_prio."""
    return one_of_ties(best_links(queries, labels, least, all_known), labels)


class Matcher(Protocol):
    """What links names (q, text) to an index: q, uri, score, at most one row for each q."""

    def match(self, queries: DataFrame) -> DataFrame: ...


@dataclass
class LabelMatcher:
    """TF-IDF links to labels (uri, label, label_prio, hier_prio) at a least cosine."""

    labels: DataFrame
    least: float = 0.75
    all_known: bool = False

    def match(self, queries: DataFrame) -> DataFrame:
        return link_names(queries, self.labels, self.least, self.all_known)


#: The runs of the batch linker (names, index) and their thresholds.
BATCH_THRESHOLDS = {("ingredient", "food"): 0.6, ("object", "food"): 0.9, ("object", "equipment"): 0.85, ("verb", "preparation"): 0.85}


def link_batches(runs: dict[str, tuple[DataFrame, Matcher]]) -> tuple[DataFrame, DataFrame]:
    """(kind, q, uri, score) of all runs, and (kind, n_names, n_missed). runs: kind -> names (name), matcher."""
    linked, counts = [], []
    for kind, (names, matcher) in runs.items():
        asked = names.select(F.col("name").alias("q"), F.col("name").alias("text")).filter("q is not null").distinct()
        found = matcher.match(asked)
        linked.append(found.select(F.lit(kind).alias("kind"), "q", "uri", "score"))
        hit = asked.join(found.select("q", F.lit(1).alias("hit")), "q", "left")
        counts.append(hit.agg(F.count(F.lit(1)).alias("n_names"), F.sum(F.col("hit").isNull().cast("bigint")).alias("n_missed")).select(F.lit(kind).alias("kind"), "n_names", F.coalesce("n_missed", F.lit(0)).alias("n_missed")))
    union = lambda parts: reduce(lambda a, b: a.unionByName(b), parts)
    return union(linked), union(counts)


def english(labels: DataFrame) -> DataFrame:
    """Labels in English or without a language, the smallest priority of each (uri, label)."""
    known = labels.filter(F.col("lang").isNull() | F.col("lang").startswith("en"))
    return known.groupBy("uri", "label").agg(F.min("label_prio").alias("label_prio"))


def normal_labels(labels: DataFrame, verbs: bool = False) -> DataFrame:
    """uri, label, label_prio with labels in lower case, without full stops, the last word as a lemma
    (and, for verbs, once more as a verb's)."""

    @F.pandas_udf("string")
    def last(s: pd.Series, verb: pd.Series) -> pd.Series:
        return pd.Series([" ".join([*w[:-1], lemma(w[-1], bool(v))]) if (w := (t or "").split(" ")) and w[-1] else t for t, v in zip(s, verb)])

    plain = labels.withColumn("label", F.replace(F.lower("label"), F.lit("."), F.lit("")))
    kinds = F.array(F.lit(False), F.lit(True)) if verbs else F.array(F.lit(False))
    each = plain.withColumn("verb", F.explode(kinds)).withColumn("label", last("label", "verb"))
    return each.groupBy("uri", "label").agg(F.min("label_prio").alias("label_prio"))


def without_ending(labels: DataFrame, label: str, ending: str = " food product") -> DataFrame:
    """The labels, and once more those with the ending, without it."""
    cut = labels.filter(F.col(label).endswith(ending)).withColumn(label, F.expr(f"left({label}, length({label}) - {len(ending)})"))
    return labels.unionByName(cut)


def _position(text: Column, part: Column) -> Column:
    """Where a part of a text begins, from 0, if it ends the text, else -1."""
    return F.when(F.endswith(text, part), F.length(text) - F.length(part)).otherwise(-1)


def _strip_all(start: Column, candidates: Column, fits: callable, once: bool) -> Column:
    """Fold over candidates (longest first): as long as one ends the remainder at a word boundary it
    is taken off. Returns struct(rest, found)."""

    def take(state: Column, c: Column) -> Column:
        at = _position(state["rest"], c)
        good = (at >= 0) & ((at == 0) | (F.substr(state["rest"], at, F.lit(1)) == " ")) & fits(state["rest"], c, at)
        rest = F.rtrim(F.substr(state["rest"], F.lit(1), F.greatest(at, F.lit(0))))
        rest = F.when(F.endswith(rest, F.lit("/")), F.rtrim(F.substr(rest, F.lit(1), F.greatest(F.length(rest) - 1, F.lit(0))))).otherwise(rest)
        return F.when(good, F.struct(rest.alias("rest"), F.concat(state["found"], F.array(c)).alias("found"))).otherwise(state)

    none = F.array().cast("array<string>")
    # a match can come again only while the remainder gets shorter: as many turns as it has words
    turns = F.array(F.lit(1)) if once else F.sequence(F.lit(1), F.greatest(F.size(F.split(start, " ")), F.lit(1)))
    one_turn = lambda state: F.aggregate(candidates, state, take)
    return F.aggregate(turns, F.struct(start.alias("rest"), none.alias("found")), lambda s, _: one_turn(s))


def _with_candidates(names: DataFrame, name: str, others: DataFrame, rest: str, shorter: bool) -> DataFrame:
    """names with `candidates`: the others that share a word with `rest`, longest first."""
    own = names.select(name, rest).distinct().select(name, F.length(rest).alias("size"), F.col(rest).alias("text"), F.explode(F.array_distinct(words(F.col(rest)))).alias("term"))
    theirs = others.select(F.col("name").alias("other")).distinct().select("other", F.explode(F.array_distinct(words(F.col("other")))).alias("term"))
    fits = (F.length("other") < F.col("size")) if shorter else (F.length("other") <= F.col("size"))
    found = own.join(theirs, "term").filter(fits & F.endswith(F.col("text"), F.col("other")) | fits & F.col("text").contains(F.col("other")))
    grouped = found.groupBy(name).agg(F.collect_set(F.struct((-F.length("other")).alias("k"), F.col("other").alias("other"))).alias("c"))
    none = F.array().cast("array<string>")
    return names.join(grouped, name, "left").withColumn("candidates", F.coalesce(F.transform(F.array_sort("c"), lambda x: x["other"]), none)).drop("c")


def suffix_links(nouns: DataFrame, ingredients: DataFrame) -> DataFrame:
    """name, found, rest for each noun: ingredients stripped from its end, longest first, and what is left.

    nouns, ingredients: name. Candidates are at most as long as the noun and share a word with it.
    """
    n = nouns.select("name").distinct().withColumn("whole", F.col("name"))
    c = _with_candidates(n, "name", ingredients, "whole", shorter=False)
    s = _strip_all(F.col("whole"), F.col("candidates"), lambda rest, part, at: F.lit(True), once=False)
    return c.select("name", s.alias("s")).select("name", F.array_distinct("s.found").alias("found"), "s.rest")


def stops(rest: Column) -> Column:
    """At most one character left, or digits at both ends: such a remainder has no sub-nouns."""
    return (F.length(rest) <= 1) | (rest.rlike("^[0-9]") & rest.rlike("[0-9]$"))


def sub_noun_links(stripped: DataFrame, nouns: DataFrame) -> DataFrame:
    """name, found, leftover: shorter nouns stripped from the end of what `suffix_links` left.

    A candidate that starts with a digit must be the whole remainder.
    """
    open_ = stripped.filter(~stops(F.col("rest"))).select("name", "rest")
    c = _with_candidates(open_, "name", nouns, "rest", shorter=True).withColumn("candidates", F.filter("candidates", lambda x: x != F.col("rest")))
    s = _strip_all(F.col("rest"), F.col("candidates"), lambda rest, part, at: (at == 0) | ~part.rlike("^[0-9]"), once=False)
    return c.select("name", s.alias("s")).select("name", F.array_distinct("s.found").alias("found"), F.col("s.rest").alias("leftover"))


def sub_ingredient_links(ingredients: DataFrame) -> DataFrame:
    """name, found: strictly shorter ingredients stripped from an ingredient's end, each once."""
    n = ingredients.select("name").distinct().withColumn("whole", F.col("name"))
    c = _with_candidates(n, "name", ingredients, "whole", shorter=True).withColumn("candidates", F.filter("candidates", lambda x: x != F.col("whole")))
    s = _strip_all(F.col("whole"), F.col("candidates"), lambda rest, part, at: (at == 0) | ~part.rlike("^[0-9]"), once=True)
    return c.select("name", F.array_distinct(s["found"]).alias("found"))
