"""The vectors nearest to stated ones by cosine, exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladle.operators.cooccurrence import top_k
from ladle.session import ensure_checkpoint_dir

#: Queries that are sent to the tasks at a time.
BLOCK = 20_000


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(n, -1)
    size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """x, y, cos, rank: for each query the k vectors of the highest cosine (6 digits), the smaller id first
    on ties. Both: id (number), vec (arrays of one length); the query itself is a vector like any other.

    Blocks of queries are sent to the tasks, each of which keeps its k best for every query; no pair is
    skipped, and only those go through the shuffle. A vector of zeros has cosine 0 to all.
    """
    spark = queries.sparkSession
    ensure_checkpoint_dir(spark)
    n = max(1, -(-queries.count() // block))
    out = None
    for part in range(n):
        own = queries.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == part).orderBy("id").toArrow()
        if not own.num_rows:
            continue
        shared = spark.sparkContext.broadcast((own.column("id").to_numpy(), _matrix(own.column("vec").combine_chunks())))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, asked = shared.value
            for batch in batches:
                for a in range(0, batch.num_rows, 2048):
                    rows = batch.slice(a, 2048)
                    theirs = rows.column(0).to_numpy()
                    if not len(theirs):
                        continue
                    matrix = _matrix(rows.column(1))
                    for q in range(0, len(ids), 2048):
                        cos = np.round(asked[q : q + 2048] @ matrix.T, 6)
                        order = np.lexsort((np.broadcast_to(theirs, cos.shape), -cos), axis=1)[:, :k]
                        best = np.take_along_axis(cos, order, axis=1)
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[q : q + 2048], order.shape[1])), pa.array(theirs[order.ravel()]), pa.array(best.ravel())], ["x", "y", "cos"])

        # zeros have one sign
        found = vectors.select("id", "vec").mapInArrow(run, "x bigint, y bigint, cos double").withColumn("cos", F.col("cos") + F.lit(0.0))
        best = top_k(found, k)
        out = best if out is None else out.unionByName(best.checkpoint())
    return top_k(vectors.select(F.col("id").alias("x"), F.col("id").alias("y"), F.lit(0.0).alias("cos")).limit(0), k) if out is None else out
