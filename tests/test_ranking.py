"""Ranks in blocks against ranks by hand, and cosine links against all pairs."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ladle.operators import linking as L
from ladle.operators import ranking as R
from ladle.operators import scoring as M

NATIVE = {
    "TransE": lambda h, r, t: M.transe(h, r, t, 4, 6.0),
    "DistMult": lambda h, r, t: M.distmult(h, r, t, 4),
    "ComplEx": lambda h, r, t: M.complex_(h, r, t, 4),
    "RotatE": lambda h, r, t: M.rotate(h, r, t, 4, 6.0),
    "pRotatE": lambda h, r, t: M.protate(h, r, t, 4, 6.0),
}


def world(spark, model, n=40):
    rng = np.random.default_rng(2)
    ent, rel = rng.normal(size=(n, 4)), rng.normal(size=(3, 2 if model == "RotatE" else 4))
    ent[5] = ent[6] = ent[7]  # ties
    known = sorted({(int(a), int(b) % 3, int(c)) for a, b, c in rng.integers(0, n, (150, 3))} | {(0, 0, k) for k in range(0, n, 2)})
    frame = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    return ent, rel, known, frame(ent), frame(rel)


@pytest.mark.parametrize("model", list(NATIVE))
def test_ranks(spark, model, monkeypatch):
    monkeypatch.setattr(R, "SLICE", 7)
    ent, rel, known, e, r = world(spark, model)
    test, candidates = known[::3], [i for i in range(40) if i % 5]
    df = spark.createDataFrame(known, "h long, r long, t long")
    asked = spark.createDataFrame(test, "h long, r long, t long")
    found = R.filtered_ranks(asked, df, e, spark.createDataFrame([(i,) for i in candidates], "id long"), r, model, 6.0, block=9).collect()
    truth = set(known)
    score = lambda h, k, t: float(R.scores(model, ent[h], rel[k], ent[t], 6.0))
    want = {(h, k, t): 1 + sum(score(h, k, c) > score(h, k, t) for c in candidates if (h, k, c) not in truth) for h, k, t in test}
    assert {(x.h, x.r, x.t): x["rank"] for x in found} == want
    # the scores are those of the expressions
    own = M.embed(asked, e, r).select("h", "r", "t", NATIVE[model](F.col("hv"), F.col("rv"), F.col("tv")).alias("s")).collect()
    assert all(abs(x.s - score(x.h, x.r, x.t)) < 1e-12 for x in own)


def test_no_test_triples(spark):
    _, _, known, e, r = world(spark, "TransE")
    none = spark.createDataFrame([], "h long, r long, t long")
    assert R.filtered_ranks(none, spark.createDataFrame(known, "h long, r long, t long"), e, e.select("id"), r, "TransE", 6.0).collect() == []


def brute_links(queries, labels, least):
    df = Counter(w for _, x in labels for w in set(x.split()))
    idf = {w: math.log((1 + len(labels)) / (1 + n)) + 1 for w, n in df.items()}

    def vector(text):
        v = {w: n * idf[w] for w, n in Counter(text.split()).items() if w in idf}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()} if size else {}

    held = {u: vector(x) for u, x in labels}
    out = {}
    for q, text in queries:
        v = vector(text)
        s = {u: round(sum(x * w.get(k, 0.0) for k, x in v.items()), 9) for u, w in held.items()}
        best = max(s.values(), default=0.0)
        out |= {(q, u): x for u, x in s.items() if x == best and x >= least}
    return out


@pytest.mark.parametrize("least", [0.2, 0.6, 0.95])
def test_cosine_links(spark, least):
    rng = random.Random(11)
    word = lambda: f"w{min(int(rng.expovariate(0.15)), 40)}"  # noqa: E731  few common words, many rare ones
    text = lambda n: " ".join(word() for _ in range(rng.randint(1, n)))
    labels = [(k, text(7)) for k in range(120)]
    labels += [(200 + k, labels[k][1]) for k in range(30)]  # ties
    queries = [(k, text(9)) for k in range(60)] + [(100 + k, labels[k][1] + " zz") for k in range(20)] + [(300, "zz yy")]
    found = L.best_links(spark.createDataFrame(queries, "q long, text string"), spark.createDataFrame(labels, "uri long, label string"), least).collect()
    want = brute_links(queries, labels, least)
    assert {(r.q, r.uri) for r in found} == set(want) and all(abs(r.score - want[r.q, r.uri]) < 2e-9 for r in found) and len(want) > 20
