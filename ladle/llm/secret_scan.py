"""Secret scans that tell copied examples from credentials of one owner by corpus-wide ownership counts.

Candidates are spans of a text that a kind's pattern matches, leftmost and without overlap:

* base kinds: `assign` (a password-like name, a sign, a value of 12 or more characters), `access`
  (AKIA and capitals, 18 or more), `hex` (16 or more hex digits). They are always returned.
* kinds that the method adds: `issued` (formats that services give their tokens, and heads of private
  keys) and `random` (24 or more characters of mixed case with digits). One is returned only where the
  whole corpus says that it is live: see below.

The hash of every candidate's value is counted over all texts: in how many distinct repositories and
under how many distinct owners it stands. A value that more than `owners` owners hold is a widely copied
example. A value of at most `owners` owners that looks drawn at random (8 or more distinct characters,
letters and digits, no placeholder words) is live. All others are plain.

The counts go over (hash, owner, repository), then (hash, owner), then (hash), each combined before its
shuffle, so a value that a third of all texts hold is a row of each task. Only hashes leave the texts.
Everything is DataFrame expressions.

Defined cases: a null text is empty; a null owner or repository counts as one of its own; rows of one id
(null too) are kept apart by a row number that is written down with them; an empty table gives no rows;
texts are scanned whole; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladle.llm.common import written


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _any_case("api") + "_?" + _any_case("key")
ASSIGN = rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kind, pattern, whether it is a base kind; in the order of spans that start together.
KINDS = (
    ("assign", ASSIGN, True),
    ("access", "AKIA[A-Z0-9]{14,}", True),  # a shorter run holds no match, so this is AKIA[A-Z0-9]+ of 18 or more
    ("hex", "[0-9a-f]{16,}", True),
    # fixed values: how some services begin their tokens, and the head of a private key
    ("issued", "gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|[rs]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", False),
    ("random", "[A-Za-z0-9+/_=-]{24,}", False),
)
ASSIGN_VALUE = 12
DISTINCT = 8
PLACEHOLDER = "example|sample|dummy|change|your|test|xxxx|1234567|abcdefg"
OWNERS = 2
CHUNK = 256


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def running_sums(steps: Column) -> Column:
    """Sums of an array of longs from its start to each place, in chunks, so that long arrays take no quadratic time."""

    def sums(a: Column) -> Column:
        return F.transform(a, lambda _, i: F.aggregate(F.slice(a, 1, i + 1), F.lit(0).cast("long"), lambda x, y: x + y))

    def before(ends: Column) -> Column:
        return F.transform(ends, lambda _, c: F.aggregate(F.slice(ends, 1, c), F.lit(0).cast("long"), lambda x, y: x + y))

    def joined(parts: Column) -> Column:
        ends = F.transform(parts, lambda p: F.element_at(p, -1))
        return let(let(ends, before), lambda off: F.flatten(F.transform(parts, lambda p, c: F.transform(p, lambda x: x + F.get(off, c)))))

    chunks = F.transform(F.sequence(F.lit(0), F.size(steps) - 1, F.lit(CHUNK)), lambda at: F.slice(steps, at + 1, F.lit(CHUNK)))
    return F.when(F.size(steps) == 0, F.array().cast("array<bigint>")).otherwise(let(F.transform(chunks, sums), joined))


def spans_of(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found>> of all matches of a pattern, in code points."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,found:string>>")

    def placed(x: Column) -> Column:
        steps = F.transform(x["found"], lambda m, i: (F.char_length(F.get(x["between"], i)) + F.char_length(m)).cast("long"))
        ends = let(steps, running_sums)
        return let(ends, lambda e: F.transform(x["found"], lambda m, i: F.struct((F.get(e, i) - F.char_length(m)).alias("start"), F.get(e, i).alias("end"), m.alias("found"))))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))
    return F.when(text.rlike(pattern), let(both, placed)).otherwise(none)


def random_looking(value: Column) -> Column:
    classes = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return classes & (F.size(F.array_distinct(F.split(value, ""))) >= DISTINCT) & ~F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").rlike(PLACEHOLDER)


def mixed(value: Column) -> Column:
    return value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]")


def _of_kind(no: int, text: Column) -> Column:
    kind, pattern, _ = KINDS[no]
    found = spans_of(text, pattern)

    def value(x: Column) -> Column:
        return F.regexp_extract(x["found"], ASSIGN, 2) if kind == "assign" else x["found"]

    def candidate(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), F.lit(no).alias("kind_no"), x["end"].alias("end"), F.sha2(value(x).cast("binary"), 256).alias("hash"), random_looking(value(x)).alias("looks"))

    if kind == "assign":
        found = F.filter(found, lambda x: F.char_length(value(x)) >= ASSIGN_VALUE)
    if kind == "random":
        found = F.filter(found, lambda x: mixed(x["found"]))
    return F.transform(found, candidate)


def candidates(text: Column) -> Column:
    """array<struct<start, kind_no, end, hash, looks>> of all kinds, by start and kind."""
    return F.array_sort(F.concat(*[_of_kind(no, text) for no in range(len(KINDS))]))


def rendered(spans: Column) -> Column:
    names = F.array(*[F.lit(kind) for kind, *_ in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind_no"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_owners, n_repos (distinct repositories, those of one name under two owners counted twice).

    found: hash, owner, repo.
    """
    each = found.select("hash", "owner", "repo").distinct()
    by_owner = each.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repos"))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", owners: int = OWNERS) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, most_owners.

    spans holds the base spans and the added ones that are live; n_live and n_example count all of its spans and,
    for examples, added ones that were left out; most_owners is the most that hold one of the row's candidates.
    """
    base_kinds = [no for no, (*_, base) in enumerate(KINDS) if base]
    texts = df.select(F.col(id_col).alias("doc_id"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), candidates(F.coalesce(F.col(text_col), F.lit(""))).alias("found"))
    kept = written(texts.withColumn("row", F.monotonically_increasing_id()))
    each = kept.filter(F.size("found") > 0).select("row", "owner", "repo", F.explode("found").alias("c")).select("row", "owner", "repo", "c.*")
    # written, so that Spark can split the join on a hash that very many texts hold
    counted = written(ownership(each))
    judged = each.select("row", "start", "kind_no", "end", "hash", "looks").join(counted, "hash")
    example = F.col("n_owners") > owners
    live = ~example & F.col("looks")
    wanted = F.col("kind_no").isin(base_kinds) | live
    by_row = judged.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(wanted, F.struct("start", "kind_no", "end")))).alias("spans"),
        F.sum(live.cast("long")).alias("n_live"),
        F.sum(example.cast("long")).alias("n_example"),
        F.max("n_owners").alias("most_owners"),
    )
    base = F.filter("found", lambda c: c["kind_no"].isin(base_kinds))

    def count(no: int) -> Column:
        return F.size(F.filter("found", lambda c: c["kind_no"] == no)).cast("long").alias(f"n_{KINDS[no][0]}")

    own = kept.select("row", "doc_id", *map(count, base_kinds), F.sha2(rendered(base).cast("binary"), 256).alias("base_sha256"))
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    return own.join(by_row, "row", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(rendered(F.col("spans")), F.lit("")).alias("spans"), zero("n_live"), zero("n_example"), zero("most_owners"))
