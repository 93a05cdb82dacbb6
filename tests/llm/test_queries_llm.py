"""The queries of the text operators on the smallest tables, each against a plain computation of its columns."""

import hashlib

import pytest
from test_operators import brute_simhash, roots_of

from ladle.llm import decontaminate, fingerprints, lm_score, piece_sampling, queries, token_counts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def rows(spark, name):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, SF).collect()}


def test_op2(spark, docs):
    got = rows(spark, "op2_document_fingerprints")
    ids = sorted(docs)
    assert sorted(got) == ids
    for i, nxt in zip(ids, [*ids[1:], ids[0]]):
        t, r = docs[i], got[i]
        half = len(t) // 2
        edited = t[: len(t) - half] + docs[nxt][:half]
        own, other, following = fingerprints.fingerprint_many([t.encode(), edited.encode(), docs[nxt].encode()])
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fingerprints.render(own) and r.edited_fingerprint == fingerprints.render(other)
        assert r.near_edited == fingerprints.containment(own, other) and r.near_next == fingerprints.containment(own, following)


def test_op3(spark, docs):
    got = rows(spark, "op3_language_id")
    assert sorted(got) == sorted(docs)
    for i, r in got.items():
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (not any(c.isalpha() for c in docs[i]))


def test_op4(spark, docs):
    got = rows(spark, "op4_sentencepiece")
    assert sorted(got) == sorted(docs)
    df = spark.createDataFrame([(i, r.pieces) for i, r in got.items()], "doc_id long, pieces array<int>")
    back = {r.doc_id: r["__text"] for r in piece_sampling.decode(df).collect()}
    for i, r in got.items():
        assert r.n_bytes == len(docs[i].encode()) and r.n_pieces == len(r.pieces) and r.lossless and back[i] == docs[i]


def test_op5(spark, docs):
    got = rows(spark, "op5_lm_scoring")
    assert sorted(got) == sorted(docs)
    for i, r in got.items():
        n = len(lm_score.tokens_of(docs[i]))
        assert r.n_tokens == n and (r.mean_log_p is None if n == 0 else abs(r.mean_log_p * n - r.log_p) < 1e-6 * n) and r.log_p <= 0


def test_op6(spark, docs):
    got = rows(spark, "op6_simhash_near_dedup")
    ids = sorted(docs)
    prints = [brute_simhash(docs[i]) for i in ids]
    roots = roots_of(len(ids), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    for k, i in enumerate(ids):
        assert got[i].fingerprint == f"{prints[k]:016x}" and got[i].component_id == ids[roots[k]]


def test_op7(spark, docs):
    got = rows(spark, "op7_suffix_array_dedup")
    data = {i: t.encode() for i, t in docs.items()}
    seen: dict[int, int] = {}
    for d in data.values():
        for p in range(len(d) - 199):
            h = hash(d[p : p + 200])
            seen[h] = seen.get(h, 0) + 1
    for i, d in data.items():
        gone = bytearray(len(d))
        for p in range(len(d) - 199):
            if seen[hash(d[p : p + 200])] > 1:
                gone[p : p + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(d, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest())


def test_op8(spark, docs):
    encode = token_counts.encoding(*token_counts.rank_bytes()).encode_ordinary
    lengths = sorted(len(encode(t)) for t in docs.values())
    got = sorted(queries.QUERIES["op8_token_counts"](spark, SF).collect(), key=lambda r: r.context_limit)
    assert [r.context_limit for r in got] == sorted({0, *lengths})
    assert [r.last_limit for r in got] == [*(r.context_limit - 1 for r in got[1:]), None]
    for r in got[:: max(1, len(got) // 300)]:
        n = r.context_limit
        assert r.tokens_kept == sum(min(x, n) for x in lengths) and r.docs_longer == sum(x > n for x in lengths) and r.n_docs == lengths.count(n)
    for r in got:
        for p in r.percentiles:
            assert lengths[-(-p * len(lengths) // 100) - 1] == r.context_limit
    assert sorted(p for r in got for p in r.percentiles) == list(range(1, 101))


def test_op9(spark, docs):
    items = {r.item_id: r.text or "" for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    wanted = {k: [decontaminate.shingles(p) for p in decontaminate.parts_of(t) if p] for k, t in items.items()}
    want = set()
    for i, t in docs.items():
        words = decontaminate.words_of(t)
        here = decontaminate.shingles(words)
        for k, parts in wanted.items():
            share = []
            for p in parts:
                n = len(next(iter(p)))
                have = here if n == decontaminate.SHINGLE else {tuple(words[j : j + n]) for j in range(len(words) - n + 1)}
                share.append(len(p & have) / len(p))
            if share and min(share) >= decontaminate.OVERLAP:
                want.add((i, k))
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op9_benchmark_decontamination"](spark, SF).collect()}
    assert got == want and want
