"""Token counts from an exact histogram of encoded lengths.

Every text is encoded with a published byte-level BPE; documents are counted by length; sums over
the lengths from each one on (suffix sums) then give, for any context limit, how many documents are
longer, how many tokens there are, how many a cut at the limit leaves, and the quantiles. The
histogram has one row for each length that occurs, so its size is bounded by the longest text, not
by the number of texts. It is written down, so the texts are encoded once.

Defined cases: a null or empty text has 0 tokens; repeated rows count each time; an empty table
gives no rows; long texts are encoded whole; control strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladle.llm.common import keyed_text, tidy, written

RANGE = 128
_encodings: dict[int, object] = {}


def rank_bytes(path: str | None = None) -> tuple[bytes, str]:
    """The ranks of a published vocabulary, and the pattern that splits texts before merging."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def encoding(ranks: bytes, pattern: str):
    key = xxhash.xxh64_intdigest(ranks)
    if key not in _encodings:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encodings[key] = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encodings[key]


def encoded_lengths(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens for each row."""
    model = df.sparkSession.sparkContext.broadcast(rank_bytes(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(*model.value).encode_ordinary
        for batch in batches:
            counts = np.fromiter((len(encode(t)) for t in batch.column(1).to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts)], ["doc_id", "n_tokens"])

    docs = keyed_text(df, id_col, text_col)
    return docs.mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint")


def histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, n_docs, as a written table."""
    return written(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")))


def suffix_sums(counted: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit: n_docs, docs_longer, docs_at_most,
    tokens_at_most, tokens_longer, tokens_total, tokens_kept (each text cut at the limit).

    Sums go over ranges of lengths first, then within each range.
    """
    hist = counted.withColumn("range", F.floor(F.col("n_tokens") / RANGE))
    of = hist.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_tokens") * F.col("n_docs")).alias("t"))
    later = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each 128 lengths
    every = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = of.select("range", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_after"), F.sum("d").over(every).alias("d_all"), F.sum("t").over(every).alias("t_all"))
    inner = Window.partitionBy("range").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    rows = hist.withColumn("d", F.coalesce(F.sum("n_docs").over(inner), F.lit(0))).withColumn("t", F.coalesce(F.sum(F.col("n_tokens") * F.col("n_docs")).over(inner), F.lit(0)))
    s = rows.join(ranges, "range").withColumn("docs_longer", F.col("d") + F.col("d_after")).withColumn("tokens_longer", F.col("t") + F.col("t_after"))
    return s.select(
        "n_tokens",
        "n_docs",
        "docs_longer",
        (F.col("d_all") - F.col("docs_longer")).alias("docs_at_most"),
        (F.col("t_all") - F.col("tokens_longer")).alias("tokens_at_most"),
        "tokens_longer",
        F.col("t_all").alias("tokens_total"),
        (F.col("t_all") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")).alias("tokens_kept"),
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the smallest length that at least this share of the documents don't exceed."""
    asked = sums.sparkSession.createDataFrame([(float(q),) for q in shares], "share double")
    ranked = sums.select("n_tokens", (F.col("docs_at_most") / (F.col("docs_at_most") + F.col("docs_longer"))).alias("reached"))
    return ranked.join(F.broadcast(asked), F.col("reached") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, docs_longer, tokens_kept for any limits, whether a text has that length or not."""
    asked = sums.sparkSession.createDataFrame([(int(x),) for x in limits], "context_limit bigint")
    at_most = sums.join(F.broadcast(asked), F.col("n_tokens") <= F.col("context_limit")).groupBy("context_limit").agg(F.max("docs_at_most").alias("d"), F.max("tokens_at_most").alias("t"))
    total = sums.agg(F.max(F.col("docs_at_most") + F.col("docs_longer")).alias("docs"))
    joined = asked.join(at_most, "context_limit", "left").join(F.broadcast(total))  # one row
    longer = F.col("docs") - F.coalesce("d", F.lit(0))
    return joined.select("context_limit", longer.alias("docs_longer"), (F.coalesce("t", F.lit(0)) + F.col("context_limit") * longer).alias("tokens_kept"))


def every_limit(sums: DataFrame) -> DataFrame:
    """Rows that together cover every limit from 0 on: context_limit, last_limit (null: no end) and what holds
    from the one to the other: docs_longer, docs_at_most, tokens_at_most, tokens_longer, tokens_total. A limit x
    between them keeps tokens_at_most + x * docs_longer; tokens_kept is that for context_limit. n_docs have
    exactly context_limit tokens; percentiles are the whole percents of the documents of which it is the
    quantile (the smallest length that they don't exceed).

    There is a row for each length that occurs, and one for the limits below them, so a single very long text
    adds one row."""
    ranged = sums.withColumn("range", F.floor(F.col("n_tokens") / RANGE))
    firsts = ranged.groupBy("range").agg(F.min("n_tokens").alias("first"))
    later = Window.orderBy("range").rowsBetween(1, 1)  # a row for each 128 lengths
    after = firsts.select("range", F.min("first").over(later).alias("after"))
    inner = Window.partitionBy("range").orderBy("n_tokens").rowsBetween(1, 1)
    ends = ranged.withColumn("following", F.min("n_tokens").over(inner)).join(after, "range")
    own = F.struct(F.col("n_tokens").alias("from"), (F.coalesce("following", "after") - 1).alias("to"))
    below = F.struct(F.lit(0).cast("bigint").alias("from"), (F.col("n_tokens") - 1).alias("to"))
    shortest = (F.col("docs_at_most") == F.col("n_docs")) & (F.col("n_tokens") > 0)
    rows = ends.withColumn("gap", F.explode(F.when(shortest, F.array(below, own)).otherwise(F.array(own))))
    here = F.col("gap.from") == F.col("n_tokens")
    total = F.col("docs_at_most") + F.col("docs_longer")
    docs_longer = F.when(here, F.col("docs_longer")).otherwise(total)
    at_most = F.when(here, F.col("tokens_at_most")).otherwise(F.lit(0))
    first, last = F.floor((F.col("docs_at_most") - F.col("n_docs")) * 100 / total) + 1, F.floor(F.col("docs_at_most") * 100 / total)
    percents = F.when(here & (first <= last), F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return rows.select(
        F.col("gap.from").alias("context_limit"),
        F.col("gap.to").alias("last_limit"),
        F.when(here, F.col("n_docs")).otherwise(F.lit(0)).alias("n_docs"),
        docs_longer.alias("docs_longer"),
        (total - docs_longer).alias("docs_at_most"),
        at_most.alias("tokens_at_most"),
        (F.col("tokens_total") - at_most).alias("tokens_longer"),
        "tokens_total",
        (at_most + F.col("gap.from") * docs_longer).alias("tokens_kept"),
        percents.alias("percentiles"),
    )
