"""Each operator against brute force on small tables, and its defined cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ladle.llm import chat_format, decontaminate, fingerprints, language_id, license_scan, lm_score, piece_sampling, shingle_join, simhash_dedup, suffix_dedup, token_counts

# columns whose names clash with those that the operators use inside
EXTRA = "lang string, c0 string, tk int, items int, key string, leaks int"
ODD = [None, "", " ", "\n\n", "a", "a" * 3000, "the the the", "É ß İ K ſ 日本語 🎉", "▁x▁", "<s></s> <0x0A>", "x\x00y"]


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, None, "c", 1, 2, "k", 3) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}")


def prose(n, seed=0, words=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, words))) for _ in range(n)]


# 1 license scans


def brute_licenses(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(license_scan.WORD, text)
    hits = [(i, label) for phrase, label in license_scan.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    labels, best = {label for _, label in hits}, 0.0
    templates, windows = license_scan.template_sets()
    for i in range(len(words)):
        for _, label, template, need, win, telling in templates:
            anchor, before, after = windows[win]
            if words[i : i + len(anchor)] != anchor:
                continue
            block = words[max(0, i - before) : i + len(anchor) + after]
            shared = len(set(block) & set(template))
            if shared >= need and all(any(block[k : k + len(p)] == p for k in range(len(block))) for p in (t.split(" ") for t in telling)):
                labels.add(label)
                best = max(best, shared / len(template))
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits})), ",".join(sorted(labels)), 1.0 if hits else best


def test_licenses(spark):
    rng = random.Random(3)
    texts = [*ODD, "CC-by\nx ALL Rights\nreserved", "general public license general PUBLIC license", "Released under the MIT License.", "under the MIT released X license", "permission is hereby granted"]
    sets, _ = license_scan.template_sets()
    pool = [w for _, _, words, *_ in sets for w in words]
    for _ in range(120):
        _, _, words, _, _, telling = rng.choice(sets)
        some = lambda: rng.sample(words, k=max(1, int(len(words) * rng.uniform(0.3, 0.6))))
        texts.append(rng.choice(["\n", "\n\n\n\nx\n"]).join(" ".join([*some(), *rng.choice([telling, telling[:1], []]), *some(), *rng.sample(pool, 2)]) for _ in range(2)))
    got = {r[0]: tuple(r[1:]) for r in license_scan.scan_licenses(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = brute_licenses(t)
        assert got[i][:6] == want[:6] and got[i][6] == pytest.approx(want[6]), t
    again = license_scan.scan_licenses(frame(spark, ["MIT licensed under the license", None, "x"], [1, 1, None])).collect()
    assert len(again) == 3
    assert license_scan.scan_licenses(frame(spark, []).limit(0)).count() == 0


NOTICES = {
    "Licensed under the Apache License, Version 2.0.": "apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
    "This program is licensed under the GNU General Public License, version 2.": "gpl,gpl-2.0",
    "Licensed under the GNU Lesser General Public License, version 3": "gpl,lgpl",
    "Licensed under the BSD License": "bsd",
    "Licensed under the Microsoft Public License": "ms-pl",
    "This text is licensed under a licence of its own, version 2.0": "",
    "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated\ndocumentation files": "mit",
    "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.": "gpl,gpl-3.0",
    "Licensed under CC BY-NC 4.0": "cc-by,cc-by-nc-4.0",
    "L\u0130CENSED UNDER THE M\u0130T LICENSE": "",
    "This program is licensed under the GNU General Public License, version 2.\nSee section 3 for details.": "gpl,gpl-2.0",
    "This work is licensed under the GNU General Public License, version 3.\nSee section 2.": "gpl,gpl-3.0",
    "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.\nSee version 3 of this file.": "gpl,gpl-2.0",
    "Licensed under the BSD License\nMIT course notes": "bsd",
    "Licensed under the Apache License, Version 1.1\nChapter 2": "",
    "Licensed under the Apache\nLicense,\nVersion 2.0": "apache-2.0",
    "Licensed under the\nBSD 3-Clause\n\nLicense": "bsd",
    "Licensed under CC BY-NC-SA 4.0": "cc-by",
    "// Licensed under the Mozilla Public\n// License, version 2.0": "mpl-2.0",
}


def test_licences_are_told_apart(spark):
    got = {r.doc_id: r.labels for r in license_scan.scan_licenses(frame(spark, [f"some words\n\n{t}\n\nmore words" for t in NOTICES])).collect()}
    assert [got[i] for i in range(len(NOTICES))] == list(NOTICES.values())


def brute_similar(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, found = re.findall(license_scan.WORD, text), {}
    templates, windows = license_scan.template_sets()
    for _, label, template, need, win, _ in templates:
        anchor, before, after = windows[win]
        for i in range(len(words)):
            shared = len(set(words[i : i + before + len(anchor) + after]) & set(template))
            if shared >= need:
                found[label] = max(found.get(label, 0), shared / len(template))
    return found


ALTERED = {
    "Permission is hereby granted, free of charge, to any individual obtaining a copy of this software and associated documentation files": "mit",
    "Redistribution and usage in source and binary forms, with or without modification, are permitted": "bsd",
    "This is free, unencumbered software, released into the public domain": "unlicense",
    "Licensed under CC BY-NC-SA 4.0": "cc-by-nc-4.0",
}


def test_no_similar_licence_is_lost(spark):
    """All that meet the threshold, where a telling phrase is altered too; op1's labels are among them."""
    rng = random.Random(5)
    texts = [*ODD, *ALTERED, *NOTICES, *["a " * n + t + " b" * 300 for t in ALTERED for n in (40, 245, 500)], "license " * 200]
    sets, _ = license_scan.template_sets()
    pool = [w for _, _, words, *_ in sets for w in words]
    for _ in range(120):
        words = rng.choice(license_scan.TEMPLATES)[1].split()
        for _ in range(rng.randint(0, max(1, len(words) // 4))):
            words[rng.randrange(len(words))] = rng.choice([*pool, "x"])
        for _ in range(rng.randint(0, 30)):
            words.insert(rng.randint(0, len(words)), rng.choice(["x", "y", *pool[:5]]))
        texts.append(" ".join([*rng.choices(pool, k=rng.randint(0, 90)), *words, *rng.choices(["z", "the", "license"], k=rng.randint(0, 90))]))
    got = {}
    for r in license_scan.similar_licenses(frame(spark, texts)).collect():
        assert r.label not in got.setdefault(r.doc_id, {})
        got[r.doc_id][r.label] = r.containment
    for i, t in enumerate(texts):
        assert got.get(i, {}) == pytest.approx(brute_similar(t)), t
    base = {label for _, label in license_scan.PHRASES}
    for r in license_scan.scan_licenses(frame(spark, texts)).collect():
        assert set(filter(None, r.labels.split(","))) - base <= set(got.get(r.doc_id, {})), r
        if texts[r.doc_id] in ALTERED:
            assert ALTERED[texts[r.doc_id]] in got[r.doc_id] and ALTERED[texts[r.doc_id]] not in r.labels.split(",")
    again = ["Licensed under the BSD License", "Licensed under the BSD License", "Released under the MIT License", "Licensed under the BSD License", None]
    rows = license_scan.similar_licenses(frame(spark, again, [1, 1, 1, None, None])).filter("containment = 1").collect()
    assert sorted((str(r.doc_id), r.label) for r in rows) == [("1", "bsd"), ("1", "mit"), ("None", "bsd")]
    assert license_scan.similar_licenses(frame(spark, []).limit(0)).count() == 0


# 2 fingerprints


def test_fingerprints_move_with_the_text():
    text = " ".join(prose(30, 1)).encode()
    a, b = fingerprints.fingerprint_many([text, b"some words in front " + text])
    assert fingerprints.containment(a, b) > 0.9
    assert sum(a.values()) == len(text)
    alone = [fingerprints.fingerprint_many([x.encode()])[0] for x in prose(20, 2)]
    assert alone == fingerprints.fingerprint_many([x.encode() for x in prose(20, 2)])
    assert fingerprints.parse(fingerprints.render(a)) == a


@pytest.mark.parametrize("buckets", [1, 5])
def test_compared_with_next(spark, buckets):
    texts = [*ODD, *prose(40, 3), "same", "same"]
    docs = sorted(((i * 7) % 101, t or "") for i, t in enumerate(texts))
    got = {r.doc_id: r for r in fingerprints.compare_with_next(frame(spark, [t for _, t in docs], [i for i, _ in docs]), buckets=buckets).collect()}
    assert len(got) == len(docs)
    for k, (i, t) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        own, other, nxt = fingerprints.fingerprint_many([t.encode(), edited.encode(), following.encode()])
        assert got[i].fingerprint == fingerprints.render(own) and got[i].near_edited == fingerprints.containment(own, other) and got[i].near_next == fingerprints.containment(own, nxt)


def test_compared_with_next_odd_ids(spark):
    df = frame(spark, ["a", "b", "c", None, "e"], [None, 1, 1, 2, None])
    assert sorted((r.doc_id is None, r.n_chars) for r in fingerprints.compare_with_next(df).collect()) == [(False, 0), (False, 1), (False, 1), (True, 1), (True, 1)]
    assert fingerprints.compare_with_next(frame(spark, []).limit(0)).count() == 0
    assert fingerprints.compare_with_next(frame(spark, ["alone here"])).first().near_next == 1
    named = df.select(F.concat(F.lit("n"), "doc_id").alias("doc_id"), "text")
    assert sorted((str(r.doc_id), r.n_chars) for r in fingerprints.compare_with_next(named, buckets=3).collect()) == [("None", 1), ("None", 1), ("n1", 1), ("n1", 1), ("n2", 0)]


# 3 language


LANGS = {"aa": "ba be bi bo bu ban ben".split(), "kk": "ko ka kik kok kuk kan".split()}


def spoken(lang, n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(LANGS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language(spark):
    train = [(i, spoken(x, 40, i), x) for i, x in enumerate(["aa", "kk"] * 20)] + [(99, None, "aa"), (100, "xx", None), (None, "zz", "aa")]
    field = language_id.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    mixed = spoken("aa", 6, 1) + " " + spoken("kk", 6, 2)
    texts = [spoken("aa", 30, 77), spoken("kk", 30, 78), mixed, *ODD]
    got = {r.doc_id: r for r in language_id.labelled(frame(spark, texts), field).collect()}
    assert got[0].__getitem__("__lang") == "aa" and got[1]["__lang"] == "kk" and got[0]["__score"] > 0.9
    words = got[2]["__words"]
    assert [w.lang for w in words] == ["aa"] * 6 + ["kk"] * 6 and mixed[words[0].start : words[0].end] == mixed.split()[0]
    assert all(0 <= r["__score"] <= 1 for r in got.values())
    for i, t in enumerate(texts):
        if not t or not any(c.isalpha() for c in t):
            assert got[i]["__lang"] == "und" and got[i]["__score"] == 0
    assert got[2]["c0"] == "c" and len(got) == len(texts)
    assert language_id.fit(spark.createDataFrame([], "doc_id long, text string, lang string")) is None
    assert language_id.labelled(frame(spark, ["a"]), None).first()["__lang"] == "und"
    assert language_id.labelled(frame(spark, []).limit(0), field).count() == 0


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    counts = np.array([4, 0, 1, 3])
    scores, start, step = rng.normal(size=(8, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    p = language_id.forward_backward(scores, counts, start, step)
    at = 0
    for n in counts:
        want, total = np.zeros((n, 3)), 0.0
        for path in np.ndindex(*[3] * n):
            w = np.exp(sum(scores[at + t, k] for t, k in enumerate(path)) + (start[path[0]] if n else 0) + sum(step[a, b] for a, b in zip(path, path[1:])))
            total += w
            for t, k in enumerate(path):
                want[t, k] += w
        assert np.allclose(p[at : at + n], want / total)
        at += n


# 4 pieces


def test_pieces(spark):
    texts = [*ODD, *prose(30, 4)]
    got = piece_sampling.encode(frame(spark, texts)).collect()
    assert all(r["__lossless"] for r in got)
    back = piece_sampling.decode(piece_sampling.encode(frame(spark, texts)).withColumnRenamed("__pieces", "pieces")).collect()
    assert {r.doc_id: r["__text"] for r in back} == {i: t or "" for i, t in enumerate(texts)}
    again = piece_sampling.encode(frame(spark, texts).repartition(3)).collect()
    assert {r.doc_id: r["__pieces"] for r in got} == {r.doc_id: r["__pieces"] for r in again}
    other = piece_sampling.encode(frame(spark, texts), seed=5).collect()
    assert {r.doc_id: r["__pieces"] for r in got} != {r.doc_id: r["__pieces"] for r in other}
    assert piece_sampling.encode(frame(spark, []).limit(0)).count() == 0


def test_pieces_are_drawn_by_their_weights():
    v = piece_sampling.vocabulary(piece_sampling.model_bytes(), 0.5)
    ids = {p: i for i, p in enumerate(v.piece_text)}

    def ways(x):
        if not x:
            yield ()
        for i in range(1, len(x) + 1):
            if x[:i] in ids:
                yield from ((ids[x[:i]], *rest) for rest in ways(x[i:]))

    weight = {w: np.exp(sum(v.logp[i] for i in w)) for w in ways("there")}
    total = sum(weight.values())
    sizes, tokens = piece_sampling.encode_many(v, ["there"] * 20000, [str(i) for i in range(20000)], 1)
    seen, at = Counter(), 0
    for n in sizes.tolist():
        seen[tuple(tokens[at : at + n].tolist())] += 1
        at += n
    assert set(seen) <= set(weight)
    assert all(abs(seen[w] / 20000 - x / total) < 0.015 for w, x in weight.items())


# 5 language model


def test_lm_scores(spark):
    texts = [*ODD, *prose(150, 5)]
    got = {r.doc_id: r for r in lm_score.score_documents(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n = len(lm_score.tokens_of(t or ""))
        assert got[i].n_tokens == n and got[i].log_p <= 0 and (got[i].mean_log_p is None) == (n == 0)
    assert lm_score.score_documents(frame(spark, []).limit(0)).count() == 0


def brute_log_p(model, counts, text):
    """Every token by loops: the network's softmax over classes and over the class's leaves, and the word's share of its leaf."""
    tokens, net = model.tokens, model.network
    table, w1, b1, wc, wl = (p.astype(np.float64) for p in net.params)
    words = lm_score.tokens_of(text)
    frequent = list(tokens.ids)
    own = frequent[: lm_score.OWN]
    shares = Counter()
    for w, n in counts.items():
        if w not in own:
            shares[lm_score.ending(w)] += n
    at = lambda i: tokens.edge if not 0 <= i < len(words) else tokens.near[tokens.ids.get(words[i], tokens.words + lm_score.ending(words[i]))]
    total = 0.0
    for i, w in enumerate(words):
        h = np.append(np.tanh(np.concatenate([table[at(i + d)] for d in lm_score.SIDES]) @ w1 + b1), 1)
        t = tokens.ids.get(w, tokens.words + lm_score.ending(w))
        zc, zl = h @ wc, h @ wl[tokens.group[t]]
        zc[~tokens.used.any(axis=1)] = zl[~tokens.used[tokens.group[t]]] = -np.inf
        total += zc[tokens.group[t]] - np.log(np.exp(zc).sum()) + zl[tokens.leaf[t]] - np.log(np.exp(zl).sum())
        if w not in own:
            total += np.log(counts[w] / shares[lm_score.ending(w)])
    return total


@pytest.mark.parametrize("words", [1 << 16, 40])
def test_lm_scores_are_those_of_loops(spark, monkeypatch, words):
    """With a small vocabulary most words come from the joined counts; results don't depend on the split into tasks."""
    monkeypatch.setattr(lm_score, "WORDS", words)
    monkeypatch.setattr(lm_score, "OWN", 20)
    monkeypatch.setattr(lm_score, "SHARD_TOKENS", 1000)
    texts = [*ODD, *prose(120, 25), *prose(3, 26, 5000)]
    docs = frame(spark, texts).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    model, coded = lm_score.fit(docs.repartition(5))
    got = {r.doc_id: r for r in lm_score.score_encoded(coded, model).collect()}
    counts = Counter(w for t in texts for w in lm_score.tokens_of(t or ""))
    for i, t in enumerate(texts):
        assert got[i].log_p == pytest.approx(brute_log_p(model, counts, t or ""), rel=1e-4, abs=1e-3)
    other, _ = lm_score.fit(docs.repartition(2))
    assert np.array_equal(model.network.flat(), other.network.flat())


def test_lm_probabilities_add_up(spark):
    texts = prose(80, 27)
    model, _ = lm_score.fit(frame(spark, texts).select("doc_id", "text"))
    counts = Counter(w for t in texts for w in lm_score.tokens_of(t))
    middle = " ".join(texts[:3]).split()
    z = lambda w: np.exp(brute_place(model, counts, [*middle[:2], w, *middle[2:4]], 2))
    assert sum(map(z, counts)) == pytest.approx(1, abs=1e-4)


def brute_place(model, counts, words, place):
    """log_p of one token among its neighbours."""
    tokens, net = model.tokens, model.network
    ids, sizes, _, _ = tokens.encode([" ".join(words)])
    p = net.log_p(tokens.contexts(ids, sizes), tokens.group[ids], tokens.leaf[ids])[place] + tokens.within[ids[place]]
    return p if words[place] in tokens.ids else p + np.log(counts[words[place]])


def test_lm_gradient():
    net = lm_score.Network(20)
    net.params = [p.astype(np.float64) for p in net.params]
    rng = np.random.default_rng(1)
    context, group, leaf = rng.integers(0, 20, (9, 4)), rng.integers(0, 5, 9), rng.integers(0, lm_score.LEAVES, 9)
    grads = net.gradient(context, group, leaf)
    loss = lambda: -net.log_p(context, group, leaf).mean()
    for p, g in zip(net.params, grads):
        for at in list(np.ndindex(*p.shape))[:: max(1, p.size // 9)]:
            keep = p[at]
            p[at] = keep + 1e-5
            up = loss()
            p[at] = keep - 1e-5
            down = loss()
            p[at] = keep
            assert (up - down) / 2e-5 == pytest.approx(g[at], abs=1e-4)


def test_lm_tokens_are_those_of_the_expression():
    signs = [chr(c) for c in range(0x3000) if c not in range(0xD800, 0xE000)]
    text = " ".join([*ODD[1:], "".join(signs), *(f"{c} x{c} {c}x x{c}Y a{c}{c}, {c}{c}" for c in signs)])
    assert lm_score.tokens_of(text) == lm_score.TOKEN.findall(text.lower())


def test_lm_gradients_hold_no_tiny_numbers():
    """Classes and leaves without words get next to no gradient, but none below what float32 is quick with."""
    used = np.zeros((lm_score.CLASSES, lm_score.LEAVES), bool)
    used[:9, :5] = True
    net = lm_score.Network(20, used)
    rng = np.random.default_rng(1)
    at = rng.integers(0, 20, (4096, 4)), rng.integers(0, 9, 4096), rng.integers(0, 5, 4096)
    for g in net.gradient(*at):
        assert not ((g != 0) & (np.abs(g) < np.finfo(np.float32).tiny)).any()
    assert np.abs(net.gradient(*at)[4][:, :, 5:]).max() < 1e-12


def test_lm_trains_on_every_position(spark):
    text = " ".join(prose(1, 5, 200))
    model, _ = lm_score.fit(frame(spark, [text]).select("doc_id", "text"))
    tokens = model.tokens
    ids, sizes, _, _ = tokens.encode([text])
    want = lm_score.Network(tokens.edge + 1, tokens.used)
    lm_score.Adam(want).step(tokens.contexts(ids, sizes), tokens.group[ids], tokens.leaf[ids])
    assert np.allclose(model.network.flat(), want.flat(), atol=1e-5)


def test_lm_learns_from_both_sides(spark):
    rng = random.Random(1)
    ordered = [" ".join(x for _ in range(30) for x in ("red", "fox", rng.choice(["ran", "sat"]))) for _ in range(400)]
    shuffled = [" ".join(rng.sample(t.split(), 90)) for t in ordered[:50]]
    model, _ = lm_score.fit(frame(spark, ordered).select("doc_id", "text"))
    mean = lambda texts: np.mean([r.mean_log_p for r in lm_score.score(frame(spark, texts).select("doc_id", "text"), model).collect()])
    assert mean(ordered[:50]) > mean(shuffled) + 0.3


def test_lm_tells_twice_from_once(spark):
    """A text that the corpus has twice scores above one that it has once."""
    rng = random.Random(31)
    texts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(40)) for _ in range(60)]
    got = {r.doc_id: r.mean_log_p for r in lm_score.score_documents(frame(spark, texts + texts[:20])).collect()}
    assert min(got[i] for i in range(20)) > max(got[i] for i in range(20, 60))


# 6 SimHash


def brute_simhash(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_of(n, linked):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [find(i) for i in range(n)]


def test_simhash(spark):
    rng = random.Random(6)
    texts = [*ODD, *prose(60, 6)]
    for t in prose(25, 7, 300):
        w = t.split()
        texts.append(t)
        for _ in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    got = {r.doc_id: r for r in simhash_dedup.near_duplicates(frame(spark, texts)).collect()}
    prints = [brute_simhash(t) for t in texts]
    want = roots_of(len(texts), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert [got[i].fp % 2**64 for i in range(len(texts))] == prints
    assert [got[i].component_id for i in range(len(texts))] == want and len(set(want)) < len(texts)
    odd = simhash_dedup.near_duplicates(frame(spark, ["x", "x", "y"], [None, 4, 4])).collect()
    assert sorted(str(r.component_id) for r in odd) == ["4", "None", "None"]
    assert simhash_dedup.near_duplicates(frame(spark, []).limit(0)).count() == 0


def test_linked_tree():
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(4)]
    values = list(dict.fromkeys(b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) for b in base for _ in range(60)))
    tree = simhash_dedup.LinkedTree(4)
    for v in values:
        tree.add(v)
    want = roots_of(len(values), lambda a, b: (values[a] ^ values[b]).bit_count() <= 4)
    same = lambda f: [[f(i) == f(j) for j in range(len(values))] for i in range(len(values))]
    assert same(tree.find) == same(lambda i: want[i])


def shingle_set(t):
    w = t.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_kept_documents(spark):
    rng = random.Random(9)
    texts = [*ODD, *prose(40, 10)]
    for t in prose(20, 11, 200):
        v = t.split()
        v[rng.randrange(len(v))] = "changed"
        texts += [t, t, " ".join(v)]
    sets = [shingle_set(t or "") for t in texts]
    want = roots_of(len(texts), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    df = frame(spark, texts)
    got = {r.doc_id: r.group_id for r in simhash_dedup.verified_groups(df).collect()}
    assert [got[i] for i in range(len(texts))] == want
    kept = simhash_dedup.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    assert simhash_dedup.keep_one(frame(spark, ["x y", "x y"], [1, 1])).count() == 1
    assert simhash_dedup.keep_one(frame(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("limits", [{}, {"HOT_ROWS": 5}, {"LIST": 2, "PART_TEXTS": 3}, {"MATCH_ROWS": 40, "MATCH_PAIRS": 30, "LIST": 4, "PART_SHINGLES": 300}])
def test_kept_copies_down_to_the_similarity(spark, monkeypatch, limits):
    """Appended and cut copies at 0.8 and just below, with a common line; low limits tie shingles and split families."""
    for name, value in limits.items():
        monkeypatch.setattr(shingle_join, name, value)
    rng = np.random.default_rng(11)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 50_000, n)]
    texts = ["", None, "one two", "one two"]
    for k in range(40):
        base = words(104) if k % 2 else "this line stands in many texts of the corpus".split() + words(95)
        texts += [" ".join(base), " ".join(base + words(25 if k % 4 else 26)), " ".join(base[: 84 if k % 3 else 83])]
    got = {r.doc_id: r.group_id for r in simhash_dedup.verified_groups(frame(spark, texts)).collect()}
    sets = [shingle_set(t or "") for t in texts]
    want = roots_of(len(texts), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9)
    assert 40 < len(set(want)) < len(texts) - 40
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("n_words", [20, 40, 60, 100, 200, 400])
def test_no_pair_at_the_similarity_is_lost(spark, n_words):
    """Copies with words changed in one place, at several, at the end, or cut, at similarities from 0.8 to 0.85 and below."""
    rng = np.random.default_rng(n_words)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 50_000, n)]
    texts = []
    for k in range(60):
        base, other = words(n_words), []
        while not other or len(shingle_set(" ".join(base)) & shingle_set(" ".join(other))) < 0.7 * (n_words - 4):
            other, part = list(base), max(1, int(n_words * rng.uniform(0.02, 0.2)))
            if k % 4 == 0:
                other[-part:] = words(part)
            elif k % 4 == 1:
                other[:part] = words(part)
            elif k % 4 == 2:
                del other[-part:]
            else:
                for at in rng.integers(0, n_words, max(1, n_words // 50)):
                    other[at] = "changed"
        texts += [" ".join(base), " ".join(other)]
    got = {r.doc_id: r.group_id for r in simhash_dedup.verified_groups(frame(spark, texts)).collect()}
    sets = [shingle_set(t) for t in texts]
    want = roots_of(len(texts), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9)
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) < len(texts)


def test_trees_and_join_link_each_their_part(spark, monkeypatch):
    """Fingerprints within the radius are linked by the trees alone, those further apart by the join alone."""
    rng = np.random.default_rng(17)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 50_000, n)]
    texts = []
    for k in range(40):
        base = words(300)
        texts += [" ".join(base), " ".join(base + words(2) if k % 2 else base[:250])]
    docs = frame(spark, texts).select("doc_id", F.xxhash64("text").alias("th"), "text")
    fps = {r.doc_id: r.fp for r in simhash_dedup.fingerprint_shingles(docs, "doc_id").collect()}
    bits = [((fps[i] ^ fps[i + 1]) % 2**64).bit_count() for i in range(0, 80, 2)]
    assert any(0 < b <= 4 for b in bits) and any(b > 4 for b in bits)
    far = {(r.u, r.v) for r in shingle_join.candidate_links(docs, 4).collect()}
    assert far == {tuple(sorted((fps[2 * k], fps[2 * k + 1]))) for k, b in enumerate(bits) if b > 4}
    split = lambda: [r[0] != r[1] for r in np.array([g for _, g in sorted((r.doc_id, r.group_id) for r in simhash_dedup.verified_groups(frame(spark, texts)).collect())]).reshape(-1, 2)]
    assert not any(split())
    monkeypatch.setattr(simhash_dedup, "shard_links", lambda df, radius: df.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0))
    assert split() == [0 < b <= 4 for b in bits]


def test_a_large_family_is_split(spark, monkeypatch):
    """Near copies of one text, many to a shingle, verified in cells of a few texts each."""
    monkeypatch.setattr(shingle_join, "LIST", 8)
    monkeypatch.setattr(shingle_join, "PART_TEXTS", 10)
    rng = random.Random(21)
    base = prose(1, 22, 1)[0].split() + [f"v{k}" for k in range(90)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.random()}"
        texts.append(" ".join(w[: rng.randint(60, 91)]))
    got = {r.doc_id: r.group_id for r in simhash_dedup.verified_groups(frame(spark, texts)).collect()}
    sets = [shingle_set(t) for t in texts]
    want = roots_of(len(texts), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9)
    assert [got[i] for i in range(len(texts))] == want and 2 < len(set(want)) < 150


def test_kept_rows_of_one_id(spark):
    """Equal id and text: the row whose other columns come first; one id with several texts; null ids."""
    df = spark.createDataFrame([(1, "a b", "z", 1), (1, "a b", "y", 2), (1, "c d", "x", 3), (None, "e f", "w", 4), (None, "e f", "v", 5), (2, None, "u", 6), (3, "", "t", 7)], "doc_id long, text string, th string, size int")
    kept = simhash_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.text, r.th, r.size) for r in kept.collect()) == [("1", "a b", "y", 2), ("1", "c d", "x", 3), ("2", None, "u", 6), ("None", "e f", "v", 5)]


# 7 repeats


def brute_kept(texts, size):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p : p + size] for d in data for p in range(len(d) - size + 1))
    out = []
    for d in data:
        covered = bytearray(len(d))
        for p in range(len(d) - size + 1):
            if seen[d[p : p + size]] > 1:
                covered[p : p + size] = b"\1" * size
        out.append(bytes(x for x, c in zip(d, covered) if not c))
    return out


@pytest.mark.parametrize("size,gram", [(200, 40), (24, 6)])
def test_repeats(spark, size, gram):
    rng = random.Random(size)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 700))) for _ in range(30)]
    texts = [*ODD, *base, "ab" * 500, base[3], base[3]]
    for _ in range(40):
        a, b = rng.choice(base), rng.choice(base)
        i, j, k = rng.randint(0, len(a)), rng.randint(0, len(b)), rng.randint(0, 400)
        texts.append(b[:j] + a[i : i + k] + b[j:])
    df = frame(spark, texts)
    cut = suffix_dedup.remove_repeats(df, length=size, gram=gram)
    got = {r.doc_id: r for r in cut.collect()}
    want = brute_kept(texts, size)
    assert [bytes(got[i].kept) for i in range(len(texts))] == want
    for i, t in enumerate(texts):
        spans = got[i].spans
        assert got[i].n_bytes == len((t or "").encode()) and sum(s.end - s.start for s in spans) == got[i].n_bytes - len(want[i])
        assert all(a.end < b.start for a, b in zip(spans, spans[1:]))
    assert set(df.columns) - {"text"} < set(cut.columns)


def test_repeats_odd_rows(spark):
    long = "".join(random.Random(1).choice("abcdefg ") for _ in range(500))
    got = suffix_dedup.remove_repeats(frame(spark, [long, long, long + "x", None], [1, 1, None, None]), as_text=True).collect()
    assert sorted(r.kept for r in got) == ["", "", "", "x"]
    assert suffix_dedup.remove_repeats(frame(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("good", [slice(0, 8), slice(8, 16)])
def test_repeats_with_half_a_digest(spark, good):
    """Contexts whose digests agree in one column are told apart by the other."""

    def digest(left, context):
        whole = suffix_dedup.context_digest(left, context)
        return bytes(x if i in range(16)[good] else 0 for i, x in enumerate(whole))

    rng = random.Random(7)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 300))) for _ in range(12)]
    for _ in range(12):
        a, b = rng.choice(texts), rng.choice(texts)
        texts.append(b[: rng.randint(0, len(b))] + a[rng.randint(0, 60) :][: rng.randint(0, 120)])
    cut = suffix_dedup.remove_repeats(frame(spark, texts), length=24, gram=6, digest=digest).collect()
    got = {r.doc_id: bytes(r.kept) for r in cut}
    assert [got[i] for i in range(len(texts))] == brute_kept(texts, 24)


@pytest.fixture(scope="module")
def equal_hashes(spark):
    """Two texts of 320 bytes with the same 32-bit hash."""
    n = spark.range(400_000).select(F.concat(*[F.sha2(F.concat_ws("-", F.col("id"), F.lit(i)), 256) for i in range(5)]).alias("text"))
    pair = n.groupBy(F.hash("text").alias("h")).agg(F.sort_array(F.collect_list("text")).alias("texts")).filter("size(texts) > 1").orderBy("h").first()
    return pair.texts[0], pair.texts[1]


@pytest.mark.parametrize("ids", [[None, None, 5], [3, 3, 5], [3, 3, 3]])
def test_repeats_of_rows_with_one_id(spark, equal_hashes, ids):
    a, b = equal_hashes
    c = "begins otherwise " + a
    rows = suffix_dedup.remove_repeats(frame(spark, [a, b, c], ids)).collect()
    remaining = sorted(bytes(r.kept) for r in rows)
    assert remaining == sorted([b"", b.encode(), b"begins otherwise "])
    twice = suffix_dedup.remove_repeats(frame(spark, [a, a, b, c], [ids[0], ids[0], ids[1], ids[2]])).collect()
    assert sorted(bytes(r.kept) for r in twice) == sorted([b"", b"", b.encode(), b"begins otherwise "])


def test_suffixes_are_sorted():
    rng = random.Random(2)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(200)]
    data = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.array([len(s) for s in strings])
    groups = np.sort(np.array([rng.randrange(20) for _ in strings]))
    start, stop = np.searchsorted(groups, groups), np.searchsorted(groups, groups, "right")
    order = suffix_dedup.Suffixes(data, np.cumsum(sizes) - sizes, sizes).sort(start, stop)
    for g in set(groups.tolist()):
        at = np.flatnonzero(groups == g)
        assert [strings[i] for i in order[at]] == sorted(strings[i] for i in at)


def test_misled_hashes_are_found(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "prefix_hashes", lambda data: np.zeros(len(data) + 1, np.uint64))  # every comparison by hash says equal
    contexts = [b"aaaaabbbbbccccc", b"aaaaabbbbbddddd", b"zzzzzbbbbbccccc"]
    low, high = suffix_dedup.repeated_offsets(np.zeros(3, np.int64), np.array([5, 5, 5]), contexts, 10, 5)
    assert low.tolist() == [0, 5, 0] and high.tolist() == [5, 5, 0]


# 8 token counts


def limits_hold(rows, lengths):
    """Every limit is in one row, and what the row says of it is what a count says."""
    rows = sorted(rows, key=lambda r: r.context_limit)
    ordered, longest = sorted(lengths), max(lengths)
    assert [r.context_limit for r in rows] == sorted({0, *lengths})
    assert [r.last_limit for r in rows] == [*(r.context_limit - 1 for r in rows[1:]), None]
    for r in rows:
        n = r.context_limit
        assert r.n_docs == lengths.count(n) and r.tokens_kept == sum(min(x, n) for x in lengths) and r.tokens_total == sum(lengths)
        assert r.percentiles == [p for p in range(1, 101) if ordered[-(-p * len(lengths) // 100) - 1] == n]
        end = 2 * longest if r.last_limit is None else r.last_limit
        for x in {n, (n + end) // 2, end}:
            assert r.docs_longer == sum(y > x for y in lengths) and r.docs_at_most == sum(y <= x for y in lengths)
            assert r.tokens_at_most == sum(y for y in lengths if y <= x) and r.tokens_longer == sum(y for y in lengths if y > x)
            assert r.tokens_at_most + x * r.docs_longer == sum(min(y, x) for y in lengths)


def test_limits_below_and_between_the_lengths(spark):
    """Neither a row for every limit nor an array of them: one text of ten million tokens adds one row."""
    counted = spark.createDataFrame([(3, 2), (7, 1), (500, 96), (10_000_000, 1)], "n_tokens bigint, n_docs bigint")
    rows = token_counts.every_limit(token_counts.suffix_sums(counted)).collect()
    assert len(rows) == 5
    limits_hold(rows, [3, 3, 7, *[500] * 96, 10_000_000])


def test_token_counts(spark):
    texts = [*ODD, *prose(50, 12), " ".join(prose(20, 12))]
    encode = token_counts.encoding(*token_counts.rank_bytes()).encode_ordinary
    lengths = [len(encode(t or "")) for t in texts]
    sums = token_counts.suffix_sums(token_counts.histogram(token_counts.encoded_lengths(frame(spark, texts))))
    for r in sums.collect():
        n = r.n_tokens
        assert r.n_docs == lengths.count(n) and r.docs_longer == sum(x > n for x in lengths) and r.tokens_longer == sum(x for x in lengths if x > n)
        assert r.tokens_kept == sum(min(x, n) for x in lengths) and r.tokens_total == sum(lengths) and r.docs_at_most == sum(x <= n for x in lengths)
    limits_hold(token_counts.every_limit(sums).collect(), lengths)
    q = {r.share: r.n_tokens for r in token_counts.quantiles(sums, [0.5, 1.0]).collect()}
    assert q[1.0] == max(lengths) and q[0.5] == sorted(lengths)[(len(lengths) - 1) // 2]
    for r in token_counts.at_limits(sums, [0, 7, 10**6]).collect():
        assert r.tokens_kept == sum(min(x, r.context_limit) for x in lengths)
    assert token_counts.suffix_sums(token_counts.histogram(token_counts.encoded_lengths(frame(spark, []).limit(0)))).count() == 0


# 9 decontamination


def test_leaks(spark):
    items = prose(60, 13, 50) + ["one two", "", None, "first question here goes on\nyes it does indeed"]
    rng = random.Random(14)
    texts = [*ODD, *prose(60, 15, 300)]
    for _ in range(60):
        w = (rng.choice(items) or "x").split(" ")
        if len(w) > 20:
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(prose(1, rng.random(), 80)[0].split() + w + prose(1, rng.random(), 80)[0].split()))
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame(spark, texts), table).collect()}
    want = set()
    for i, t in enumerate(texts):
        here = decontaminate.words_of(t or "")
        for k, item in enumerate(items):
            head, _, tail = (item or "").strip().rpartition("\n")
            parts = [decontaminate.words_of(x) for x in ((head, tail) if head else (tail,))]
            share = []
            for p in parts:
                wanted = decontaminate.shingles(p)
                if wanted:
                    n = len(next(iter(wanted)))
                    share.append(len(wanted & {tuple(here[j : j + n]) for j in range(len(here) - n + 1)}) / len(wanted))
            if share and min(share) >= 0.8:
                want.add((i, k))
    assert want - got == set(), "the passages' windows hold every item that stands in one place"
    assert got <= want
    assert len(want) > 40
    one = sorted(map(tuple, decontaminate.find_leaks(frame(spark, texts), table).collect()))
    several = sorted(map(tuple, decontaminate.find_leaks(frame(spark, texts), table, shard_items=20).collect()))
    assert [x[:2] + x[5:] for x in one] == [x[:2] + x[5:] for x in several]
    assert [x[2:5] for x in one] == [pytest.approx(x[2:5]) for x in several], "scores don't depend on the shards"
    named = table.select(F.concat(F.lit("item "), "item_id").alias("item_id"), "text")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame(spark, texts), named).collect()} == {(i, f"item {k}") for i, k in got}
    kept = decontaminate.drop_leaks(frame(spark, texts), table)
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {i for i, _ in got} and "c0" in kept.columns
    assert decontaminate.find_leaks(frame(spark, texts), table.limit(0)).count() == 0
    assert decontaminate.find_leaks(frame(spark, []).limit(0), table).count() == 0


def test_wand_finds_what_a_full_scan_finds():
    rng = random.Random(16)
    index = decontaminate.Index(list(enumerate(prose(300, 17, 40))))
    for _ in range(200):
        terms = sorted(rng.sample(range(len(index.terms)), rng.randint(1, 60)) + rng.choice([[], [index.terms[w] for q in [rng.choice(index.question)] for s in q for w in s]]))
        terms = sorted(set(terms))
        full: dict[int, float] = {}
        for t in terms:
            for item, x in zip(index.items[t].tolist(), index.impacts[t].tolist()):
                full[item] = full.get(item, 0.0) + x
        want = {i for i, x in full.items() if x >= 1 + 1e-9}
        got = {i for i, _ in index.search(terms)}
        assert want <= got and all(full[i] >= 1 - 1e-9 for i in got)


# 10 chats


def test_chats(spark):
    rows = [
        (1, 0, "user", "hi <|im_end|>\n<|im_start|>assistant no"),
        (1, 1, "assistant", "a\\b <\\| <|im_sep|>"),
        (1, 2, "assistant", None),
        (1, 2, "assistant", "two"),
        (2, None, None, "x"),
        (2, 1, "ro\nle<|", "\\\\<|<|nl|>"),
        (None, 1, "assistant", "n"),
        (3, 1, "assistant", "same"),
        (3, 1, "assistant", "same"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    chats = chat_format.format_chats(df)
    got = {r.conv_id: r for r in chats.select("conv_id", "formatted", "n_messages", "loss", chat_format.read_back(F.col("formatted")).alias("turns"), chat_format.loss_texts(F.col("formatted"), F.col("loss")).alias("texts")).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", rows[0][3]), ("assistant", rows[1][3]), ("assistant", ""), ("assistant", "two")]
    assert got[1].texts == [rows[1][3], "", "two"] and got[1].n_messages == 2
    assert [tuple(t) for t in got[2].turns] == [("", "x"), ("ro\nle<|", "\\\\<|<|nl|>")]
    assert got[3].texts == ["same", "same"] and got[None].texts == ["n"]
    assert got[1].formatted.count("<|im_end|>") == 2
    assert chat_format.format_chats(df.limit(0)).count() == 0
