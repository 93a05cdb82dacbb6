"""The stages on the smallest tables, and the queries that have SQL."""

import random
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from ladle.llm import decontaminate, language_id, queries, suffix_dedup

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before) and len(after) > 0.7 * len(before), name
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
        if name == "language_id":
            assert all(any(c.isalpha() for c in r.text) for r in after.values())
        if name == "simhash_near_dedup":
            assert len({r.text for r in after.values()}) == len(after)
        if name == "suffix_array_dedup":
            cut = suffix_dedup.remove_repeats(docs).filter("size(spans) > 0")
            assert all(r.n_chars == len(r.text) for r in after.values()) and set(after) == set(before)
            assert cut.count() <= 2  # cutting can bring bytes together
        if name == "benchmark_decontamination":
            assert decontaminate.find_leaks(docs, items).count() == 0 and len(after) < len(before)
        if name == "sentencepiece_encoding":
            assert all(r.lossless for r in after.values()) and set(after) == set(before)


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op3_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert language_id.UNKNOWN == "und"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[c] for c in sorted(names)) for r in df.collect()))) == sorted(map(str, (tuple(r[names.index(c)] for c in sorted(names)) for r in cur.fetchall())))


ODD = [None, "", " ", "\n", "a", "é\x00ß", "word " * 30_000, "the same text stands here twice and is long enough to count as one " * 5]
CLASH = ["kept", "spans", "n_bytes", "pieces", "lossless", "__lang", "__score", "__leaks", "leaks", "th", "tk", "c0", "own2", "items", "fp", "root", "id_text", "key", "least"]


def odd_docs(spark):
    rows = [(i if i != 3 else None, t, "en" if i % 2 else None, "src", len(t or ""), *["x"] * len(CLASH)) for i, t in enumerate([*ODD, *ODD])]
    rows += [rows[-1], rows[-1], (2, "another text of that id", None, None, None, *[None] * len(CLASH))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH))


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_odd_rows(spark, k):
    """Nulls anywhere, empty and very long texts, repeated rows, columns with the operators' own names, no rows."""
    name, stage = corpus_pipeline.STAGES[k]
    docs = odd_docs(spark)
    last = k + 1 == len(corpus_pipeline.STAGES)
    columns = docs.columns if not last else [c for c in docs.columns if c not in ("pieces", "lossless")] + ["pieces", "lossless"]
    got = stage(spark, docs, SF)
    assert got.columns == columns
    rows = got.collect()
    given = docs.collect()
    if name == "language_id":
        assert all(any(c.isalpha() for c in r.text) for r in rows) and any(r.text == ODD[-1] for r in rows)
    if name == "simhash_near_dedup":
        texts = [r.text or "" for r in rows]
        assert len(texts) == len(set(texts)) == 6 and {t for t in texts if t.split()} == {r.text for r in given if (r.text or "").split()}
        assert {r.kept for r in rows} <= {"x", None}
    if name == "suffix_array_dedup":
        assert len(rows) == len(given) and all(r.text is not None and r.n_chars == len(r.text) and r.kept in ("x", None) for r in rows)
        assert {r.text for r in rows if r.doc_id in (6, 7)} == {""}
    if name == "benchmark_decontamination":
        assert len(rows) == len(given)
    if last:
        assert len(rows) == len(given) and all(r.lossless and (len(r.pieces) > 0) == bool(r.text) for r in rows)
    assert stage(spark, docs.limit(0), SF).collect() == []


def brute_kept(texts, size):
    data = [t.encode() for t in texts]
    seen = Counter(d[p : p + size] for d in data for p in range(len(d) - size + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for p in range(len(d) - size + 1):
            if seen[d[p : p + size]] > 1:
                gone[p : p + size] = b"\1" * size
        out.append(bytes(x for x, g in zip(d, gone) if not g))
    return out


BORDERS = {"PIECE": 700, "SORT_BYTES": 900, "MANY": 2}


def test_repeats_across_borders(spark, monkeypatch):
    """Texts longer than the pieces that are hashed at a time, groups larger than what is sorted at a time, split grams."""
    for name, value in BORDERS.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(5)
    line = "a line that stands in very many of the texts, with other words around it each time and long enough."
    other = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts = [other(rng.randint(0, 3000)) + line + other(rng.randint(0, 300)) for _ in range(30)]
    texts += [other(100) + texts[i][-350:] + other(50) for i in range(10)] + [texts[0][:2500], line + line]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(df, length=120, gram=24).collect()}
    assert [got[i] for i in range(len(texts))] == brute_kept(texts, 120)
