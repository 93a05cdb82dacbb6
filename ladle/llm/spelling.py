"""Spelling variants: words one edit apart, found by PartEnum signatures over letter multisets.

A word's letters with their occurrence numbers are the ones of a binary vector. One inserted or deleted
letter changes one place of it, a replaced letter two, so words one edit apart have vectors at Hamming distance
two at most. The places are dealt into `PARTS` parts (letters in the order of how many words have them, so that parts
hold about as much); two such vectors agree on all but two parts. A word's signatures are its vector
without two parts, for every two of them: any two words one edit apart share one. As one edit leaves the first or the second
half of a word as it is, a signature also holds one half and the length of the longer word. An equi-join on the
signature gives candidates, and the edit distance over code points verifies them inside the join; only pairs that
are near leave it.

Words are counted first (combined before the shuffle), so everything after works on distinct words. The way
from a word to its form at least doubles the count, so the root is found by a few rounds of pointer doubling.

Defined cases: a null text has no words; a null id is an empty string in the hash; rows of one id are counted
each; an empty table gives no rows; texts are scanned whole; words without a near one have no form and are their own
root; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladle.llm.common import written

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT = 5, 3
PARTS = 4
RATIO = 2
SLIP = 97


def runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, run: every maximal run of letters, A-Z in lower case."""
    each = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(RUN), F.lit(0))).alias("run"))
    return each.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("run"))


def slipped(key: Column, run: Column, every: int = SLIP) -> Column:
    """The run, less one code point where the hash of its key says so."""
    h = F.crc32(F.concat(key, F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def word_counts(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the words that are long and frequent enough."""
    counted = words.filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= least_count)


def letter_order(vocabulary: DataFrame) -> dict[str, int]:
    """Letters of the words, commonest first. Words of runs have at most 26 + 64 letters."""
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    return {r.c: i for i, r in enumerate(sorted(letters.collect(), key=lambda r: (-r.n, r.c)))}


def parts_of(word: Column, order: dict[str, int], parts: int) -> Column:
    """array<string>: for each part, the letters of a word that are dealt to it. The letter of order r is dealt to
    part r for its first occurrence, to the next part for its second, and so on round."""
    rank = F.create_map(*[x for c, i in order.items() for x in (F.lit(c), F.lit(i))])
    letters = F.array_sort(F.filter(F.split(word, ""), lambda c: c != ""))

    def dealt(sorted_letters: Column) -> Column:
        places = F.transform(sorted_letters, lambda c, i: F.struct(c.alias("c"), ((F.element_at(rank, c) + i - F.array_position(sorted_letters, c) + 1) % parts).alias("p")))
        return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.array_join(F.transform(F.filter(places, lambda x: x["p"] == p), lambda x: x["c"]), ""))

    return F.get(F.transform(F.array(letters), dealt), 0)


def signatures(split: DataFrame, longer: Column, parts: int = PARTS) -> DataFrame:
    """word, n, length, sig: for every two parts that are left out and each half of the longer word, a hash of what
    two near words share. split: word, n, p (its parts); longer: lengths of the longer word, an array.

    Of a longer word of m letters the first m // 2 or the last m - m // 2 are those of the shorter one too:
    an edit at place i leaves what is before it, and from the ends of both what comes after.
    """
    each = split.select("word", "n", "p", F.char_length("word").alias("length"), F.explode(longer).alias("m"))
    first = F.floor(F.col("m") / 2).cast("int")
    halves = [F.substring("word", F.lit(1), first), F.substring("word", F.col("length") - (F.col("m") - first) + 1, F.col("length"))]
    sigs = [F.xxhash64("m", F.lit(side), F.lit(no), half, *[F.get("p", k) for k in range(parts) if k not in out]) for no, out in enumerate(combinations(range(parts), 2)) for side, half in enumerate(halves)]
    return each.select("word", "n", "length", F.explode(F.array(*sigs)).alias("sig"))


def near_pairs(vocabulary: DataFrame, parts: int = PARTS) -> DataFrame:
    """a, a_n, b, b_n: every two words that are one edit apart, once (b longer, or as long and greater)."""
    split = written(vocabulary.select("word", "n", parts_of(F.col("word"), letter_order(vocabulary), parts).alias("p")))
    length = F.char_length("word")
    a = signatures(split, F.array(length, length + 1), parts).select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("length").alias("a_length"), "sig")
    b = signatures(split, F.array(length), parts).select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("length").alias("b_length"), "sig")
    once = (F.col("a_length") < F.col("b_length")) | (F.col("a") < F.col("b"))
    close = a.join(b, "sig").filter(once & (F.levenshtein("a", "b", 1) == 1))
    return close.select("a", "a_n", "b", "b_n").distinct()


def forms(vocabulary: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n."""
    ways = [pairs.select(F.col(x).alias("word"), F.col(f"{y}_n").alias("other_n"), F.col(y).alias("other")) for x, y in (("a", "b"), ("b", "a"))]
    best = reduce(DataFrame.unionAll, ways).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("k"), "other")).alias("best"))
    every = vocabulary.join(best, "word", "left")
    good = -F.col("best.k") >= ratio * F.col("n")
    return every.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("best.other")).alias("form"), F.when(good, -F.col("best.k")).alias("form_n"))


def with_roots(found: DataFrame) -> DataFrame:
    """found with root: the last word when forms are followed. Counts at least double on the way, so it ends."""
    to = written(found.filter("form is not null").select("word", F.col("form").alias("root")))
    for _ in range(7):  # 2^6 steps are more than counts of 64 bits can double
        ahead = to.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        further = written(to.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")))
        to = further.select("word", "root")
        if further.filter("moved").isEmpty():
            break
    return found.join(to, "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int | None = None, parts: int = PARTS, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word. slip: one in how many runs loses a letter (none: no run)."""
    each = runs(docs, id_col, text_col)
    word = F.col("run") if slip is None else slipped(F.col("id"), F.col("run"), slip)
    vocabulary = written(word_counts(each.select(word.alias("word"))))
    found = written(forms(vocabulary, near_pairs(vocabulary, parts), ratio))
    return with_roots(found).select("word", "form", "root", "n", "n_near", "form_n")
