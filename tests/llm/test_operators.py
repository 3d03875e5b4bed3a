"""Edge cases and brute-force comparisons of the training-data operators, on small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import pickle
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.llm import bpe, common, components, fingerprint, lang_id, license, line_dedup, lm, mixing, near_dup, quality, queries, url_filter

from ..conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor " * 20_000
EDGE = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n\x0b", "en", "a", 4), (4, "the same line of the text here\nx", "en", "b", 30), (4, "the same line of the text here\nx", "en", "b", 30),
    (5, "THE same line of the text here \ny", "de", "b", 30), (6, "the same line of the text here", None, None, 30), (None, "the same line of the text here", "en", "c", 30), (None, None, None, None, None),
    (7, "a b é😀 \u001c x<|endoftext|>  y", "fr", "c", 10), (8, LONG, "en", "a", len(LONG)), (6, "another text under one id", "en", "a", 3),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


DIGESTS = {
    "op1": lang_id.digest, "op2": mixing.digest, "op4": quality.digest, "op5": line_dedup.digest, "op6": bpe.digest,
    "op7": fingerprint.digest, "op8": license.digest, "op9": lm.digest, "op10": near_dup.digest,
}


@pytest.mark.parametrize("op", DIGESTS)
def test_edge_and_empty_tables(spark, edge, op):
    clash = edge.select("*", *[F.lit(1).alias(c) for c in ("words", "th", "size", "key", "pos", "h1", "a.b", "ids", "n_lines")])
    got = DIGESTS[op](clash)
    assert got.count() == len(EDGE)
    assert [r for r in rows(got, "doc_id")] == sorted(((x[0],) for x in EDGE), key=str)
    assert DIGESTS[op](edge.limit(0)).count() == 0


# SQL


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_against_sql(spark, same, name):
    same(queries.QUERIES[name](spark, SF), queries.ORACLES[name])


def test_edge_rows_against_sql(spark, same, edge):
    unique = edge.where("doc_id is not null").dropDuplicates(["doc_id"])
    table = {"documents": unique.toPandas()}
    for module in (mixing, quality, line_dedup):
        same(module.digest(unique), module.ORACLE, table)


# 1 language


def test_language_is_learned(docs):
    got = lang_id.digest(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out, strict=True))


def test_values_are_those_of_exact_kernel_ridge_regression():
    """With every training text a landmark, the Nystroem map is exact: values equal the dual solution in plain numpy."""
    random.seed(11)
    texts = ["".join(random.choices("abcde fgh" if i % 2 else "aeiou xyz", k=random.randint(20, 200))) for i in range(24)]
    langs = ["l1" if i % 2 else "l2" for i in range(20)] + ["l3"] * 4
    gaps = lambda t: " " + re.sub(r"[\W\d_]+", " ", t.lower()).strip() + " "
    sets = lambda t: {gaps(t)[i : i + n] for n in (2, 3, 4) for i in range(len(gaps(t)) - n + 1)}
    kernel = lambda a, b: np.array([[len(x & y) / math.sqrt(len(x) * len(y)) for y in map(sets, b)] for x in map(sets, a)])
    assert all(len(lang_id.ngrams(t)) == len(sets(t)) for t in texts)
    model = lang_id.Model([lang_id.ngrams(t) for t in texts], langs)
    k, w = kernel(texts, texts), np.array([1 / langs.count(x) for x in langs])
    y = np.where(np.array(langs)[:, None] == np.array(model.langs)[None, :], 1.0, -1.0)
    dual = np.linalg.solve(k + lang_id.RIDGE / np.linalg.matrix_rank(k, 1e-5) * np.diag(1 / w), y)
    new = ["abc def gh a", "xyz ae io u", "12 Äb c!", "a" * 5000 + " b " * 900]
    assert np.allclose(model.values(new), kernel(new, texts) @ dual, atol=2e-3)
    names, scores = model.predict(new)
    assert [model.langs[i] for i in (kernel(new, texts) @ dual).argmax(axis=1)] == names and all(0 <= x <= 1 for x in scores)


def test_long_texts_are_told_apart(spark, docs):
    """Texts of 100,000 characters, of all a language's documents, are still of that language."""
    d = docs.where("lang is not null and text is not null")
    model = lang_id.train(d)
    long = {r["lang"]: r["t"] for r in d.groupBy("lang").agg(F.array_join(F.collect_list("text"), "\n").alias("t")).collect()}
    for lang, t in long.items():
        t = (t * (100_000 // len(t) + 1))[:100_000]
        assert model.predict([t])[0] == [lang]


def test_no_letter_is_undetermined(spark):
    d = spark.createDataFrame([(1, None, "en"), (2, "12 .", "en"), (3, "hello there", "en"), (5, "bonjour", "fr")], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in lang_id.predict(d, lang_id.train(d)).collect()} == {1: "und", 2: "und", 3: "en", 5: "fr"}
    assert {r["lang_pred"] for r in lang_id.predict(d, lang_id.train(d.where("false"))).collect()} == {"und"}


# 2 mixing


def test_targets():
    assert mixing.targets([("a", 100), ("b", 10), ("c", 5), ("d", 1), (None, 1)]) == {"a": 69.375, "b": 27.75, "c": 13.875, "d": 3.0, None: 3.0}
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0.0}
    random.seed(1)
    for _ in range(200):
        sizes = [(f"s{i}", random.choice([0, 1, 5, 100, 10_000])) for i in range(random.randint(1, 9))]
        t = mixing.targets(sizes)
        assert math.isclose(sum(t.values()), sum(n for _, n in sizes), abs_tol=1e-6)
        assert all(t[s] <= 3 * n + 1e-9 for s, n in sizes)


def test_mix_comes_near_and_reruns_agree(spark):
    random.seed(2)
    d = spark.createDataFrame([(i, "w " * random.randint(1, 60), random.choice("aaaab"), "x") for i in range(4000)], "doc_id long, text string, source string, more string")
    got = mixing.mix(d).join(d.select("doc_id", "source"), "doc_id").toPandas()
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 60
    assert (got.taken <= 3 * got["size"]).all()
    assert rows(mixing.digest(d)) == rows(mixing.digest(d.repartition(7)))
    assert mixing.mixed(d).columns == d.columns
    assert mixing.mixed(d).count() == got.copies.sum()


# 3 addresses


PAGES = [
    (1, "http://a.com/x", '<link rel="canonical" href="http://b.com/y">'), (2, "https://B.com/y#z", None), (3, "http://c.net/", '<meta http-equiv="refresh" content="0; url=http://b.com/y">'),
    (4, "http://d.org/fr/q", "<LINK href=/z rel=canonical>"), (5, "http://d.org/z", '<link rel=canonical href="//c.net/">'), (6, None, "x"), (7, "nope", ""), (8, "http://q.com", None), (1, "http://a.com/x", None),
    (9, "http://www.example.NET/en/1?q", None), (10, "http://example.net/de/", None), (11, "http://myexample.com/de/1", None), (12, "http://x.example.com/de/1", None), (13, "http://h.net", None),
]


def test_blocks_spread_to_aliases(spark, same):
    p = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(p).collect()}
    assert got == {
        1: (None, "block"), 2: (None, "block"), 3: ("net/", "block"), 4: ("org/fr/", "allow"), 5: (None, "block"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"),
        9: ("example.net/en/", "allow"), 10: ("net/", "block"), 11: (None, "allow"), 12: ("example.com/de/", "block"), 13: (None, "allow"),
    }
    assert url_filter.judge_urls(p).count() == len(PAGES) and url_filter.judge_urls(p.limit(0)).count() == 0
    same(url_filter.digest(p), url_filter.ORACLE, {"pages": p.toPandas()})


def test_given_redirects(spark):
    p = spark.createDataFrame([(1, "http://a.com/1", None)], "page_id long, url string, html string")
    e = spark.createDataFrame([("http://a.com/1", "http://b.com/2"), ("http://b.com/2", "https://c.net/3"), (None, "x")], "src string, dst string")
    assert [r["verdict"] for r in url_filter.judge_urls(p, edges=e).collect()] == ["block"]


def test_components(spark):
    random.seed(3)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)] + [(500, i) for i in range(400, 460)]
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = components.connected_components(spark.createDataFrame([*edges, (None, 1)], "src long, dst long"))
    assert {r["node"]: r["component"] for r in got.collect()} == {x: find(x) for x in list(parent)}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


# 4 quality


def test_symbols_are_rejected_and_prose_is_kept(docs):
    got = quality.judge(docs).join(docs.select("doc_id", "text"), "doc_id").toPandas()
    judged = got[~got.base_failed]
    assert not judged[judged.n_symbols > 0.2 * judged.word_chars].kept.any()
    assert judged[judged.n_symbols < 0.01 * judged.word_chars].kept.mean() > 0.99
    assert quality.keep_good(docs).count() == got.kept.sum()


def test_many_repeated_windows(spark):
    text = " ".join(f"w{i}" for i in range(200)) + " " + " ".join(f"w{i}" for i in range(200))
    got = quality.judge(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")).first()
    assert got["n_repeat_words"] == 400 and got["base_failed"]


# 5 lines


def test_lines_keep_their_order(spark):
    shared = "a line that is shared by many documents"
    d = spark.createDataFrame([(i, f"top {i}\n{shared}\n\n {shared.upper()} \nend {i}", "z") for i in range(5)], "doc_id long, text string, extra string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_shared_lines(d).collect()}
    assert got[0] == "top 0\n\nend 0" and got[4] == f"top 4\n{shared}\n\n {shared.upper()} \nend 4"


# 6 BPE


def test_encoding_is_the_librarys(spark, docs, edge):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_tokenizer())
    odd = ["  two  spaces\n\n\t tabs ", "don't we'LL I'm", "x²³ ½ ٣ 漢字 ‍👩‍👩‍👧 ñ", "a<|endoftext|><|endoftext|> b  <|endoftext|>\n", "\x1c\x85  end", "\u0000�", "a" * 3000]
    d = docs.select("doc_id", "text").limit(60).unionByName(edge.select("doc_id", "text")).unionByName(spark.createDataFrame(list(enumerate(odd, 10**6)), "doc_id long, text string"))
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in d.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), h(",".join(map(str, ids))), h(t.decode(ids, skip_special_tokens=False))))
    assert rows(bpe.digest(d)) == sorted(want, key=str)


def test_words_are_encoded_one_by_one(spark, tmp_path):
    """Random texts of all kinds of white space: the words of Spark and of a task are the same, and their ids the library's."""
    import json

    path = bpe.default_tokenizer()
    t, split, marks = bpe._tokenizer(path), bpe._split(path), bpe.special_tokens(path)
    alphabet = [*" \n\t\r\x0b\x0c\x1c\x1f\x85\xa0\u1680\u2000\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff", *"ab'st1.2é漢😀", "<|endoftext|>", " ", "  ", "'ll"]
    random.seed(3)
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 14))) for _ in range(3000)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", bpe.words_of(F.col("text"), marks).alias("w")).collect()
    for r in got:
        words = split(texts[r["i"]])
        assert r["w"] == words and "".join(words) == texts[r["i"]]
        assert ",".join(bpe._ids(words, path)) == ",".join(map(str, t.encode(texts[r["i"]], add_special_tokens=False).ids))
    other = json.loads(open(path, encoding="utf-8").read())
    other["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(other))
    with pytest.raises(ValueError, match="supported"):
        bpe.special_tokens(str(tmp_path / "t.json"))


# 7 fingerprints


def test_fingerprints_against_a_loop(spark, docs, edge):
    d = docs.select("doc_id", "text").limit(80).unionByName(edge.where("doc_id <> 8 or doc_id is null").select("doc_id", "text"))
    for x in (d, d.limit(1)):
        order = sorted((tuple(r) for r in x.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        want = []
        for k, (i, t) in enumerate(order):
            t, n = t or "", order[(k + 1) % len(order)][1] or ""
            half = len(t) // 2
            e = t[: len(t) - half] + n[:half]
            a, b, c = map(fingerprint.fingerprint, (t, e, n))
            want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprint._name(a), fingerprint._name(b), fingerprint.likeness(a, b), fingerprint.likeness(a, c)))
        assert rows(fingerprint.digest(x)) == sorted(want, key=str)
    assert rows(fingerprint.fingerprints(d), "doc_id", "fingerprint") == rows(fingerprint.digest(d), "doc_id", "fingerprint")


def lempel_ziv(text):
    """The phrase set, parsed independently: the longest known prefix and one more character, again and again."""
    phrases, i = set(), 0
    while i < len(text):
        n = 1
        while i + n <= len(text) and text[i : i + n] in phrases:
            n += 1
        if i + n > len(text):
            break
        phrases.add(text[i : i + n])
        i += n
    return phrases


def test_phrases_are_those_of_an_independent_parse(docs):
    texts = [r["text"] or "" for r in docs.limit(25).collect()] + ["", "a", "aaaaaaaa", "abababababab", "é😀é😀é"]
    for t in texts:
        seen = set()
        fingerprint.phrase_ends(t, seen, "", 0)
        want = lempel_ziv(t)
        assert seen == want
        hashes = fingerprint.phrase_hashes(t, fingerprint.phrase_ends(t, set(), "", 0)[0])
        assert len(set(hashes.tolist())) == len(want)
        small = sorted({h >> 32 for h in hashes.tolist()})[: fingerprint.SIZE]
        assert fingerprint.fingerprint(t).tolist() == small
    # likeness: the share of both sketches among the smallest of their union, against the definition
    a, b = (set(fingerprint.fingerprint(t).tolist()) for t in texts[:2])
    union = set(sorted(a | b)[: fingerprint.SIZE])
    assert math.isclose(fingerprint.likeness(*map(fingerprint.fingerprint, texts[:2])), len(union & a & b) / len(union))


def test_likeness_follows_the_phrase_sets(docs):
    texts = [r["text"] for r in docs.limit(30).collect()]
    off = []
    for a, b in zip(texts, texts[1:], strict=False):
        x, y = set(), set()
        fingerprint.phrase_ends(a, x, "", 0)
        fingerprint.phrase_ends(b, y, "", 0)
        off.append(abs(len(x & y) / max(1, len(x | y)) - fingerprint.likeness(fingerprint.fingerprint(a), fingerprint.fingerprint(b))))
    assert sum(off) / len(off) < 0.05
    assert fingerprint.likeness(fingerprint.fingerprint(texts[0]), fingerprint.fingerprint(texts[0])) == 1.0


# 8 licences


def test_licences(spark, docs):
    own = spark.createDataFrame([(10**6, "word " * 90 + "Licensed under CC BY-NC 4.0. " + "more " * 70), (10**6 + 1, "about the license of a file in general"), (10**6 + 2, "RELEASED UNDER THE MIT LICENSE")], "doc_id long, text string")
    d = docs.select("doc_id", "text").unionByName(own)
    known = (("Apache License, Version 2.0", "apache-2.0"), ("CC BY-NC 4.0", "cc-by-nc"), ("GNU General Public License, version 3", "gpl-3"), ("MIT License", "mit"), ("MIT LICENSE", "mit"))
    want = {r["doc_id"]: ",".join(sorted({f for p, f in known if p in (r["text"] or "")})) for r in d.collect()}
    assert {r["doc_id"]: r["families"] for r in license.digest(d).collect()} == want


def test_wrapped_licences(spark, docs):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the rest), to deal"
    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following\n# conditions are met:"
    own = {
        "mit": "Copyright by the authors\n\n" + mit, "bsd": bsd, "bsd,mit": f"{bsd}\n  \n{mit}\n\nend", "gpl-3": "some words before\nThis work is licensed under the GNU General\nPublic License, version 3",
        "apache-2.0,mit": "Released under the MIT License\nLicensed under the Apache License, Version 2.0", "": "Redistribution and use in source and binary forms,\n\nwith or without modification, are permitted provided",
    }
    texts = list(own.values())
    new = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"] - 10**6: r for r in license.digest(docs.select("doc_id", "text").unionByName(new)).where("doc_id >= 1000000").collect()}
    assert [got[i]["families"] for i in range(len(texts))] == list(own)
    assert [got[i]["n_license_lines"] for i in range(len(texts))] == [2, 3, 5, 2, 2, 0]


def test_near_families_are_told_apart(spark, docs):
    """Headers that differ in a word or two, wrapped and in other words than in training: precision and recall by family."""
    import textwrap

    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    notices = {
        "gpl-2": gpl.format("General Public", 2), "gpl-3": gpl.format("General Public", 3), "agpl-3": gpl.format("Affero General Public", 3),
        "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
        "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appears in all copies.",
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "unlicense": "This is free and unencumbered software released into the public domain.", "cc-by": "Licensed under CC BY 4.0", "cc-by-nc": "Licensed under CC BY-NC 4.0", "cc-by-sa": "Licensed under CC BY-SA 4.0",
    }
    random.seed(4)
    rows_, want = [], {}
    for k in range(4):
        for family, text in notices.items():
            around = random.choices("quite some other words stand around the notice in any such file".split(), k=20)
            body = textwrap.fill(" ".join(around[: 5 * k]) + " " + text + " " + " ".join(around[5 * k :]), random.choice([50, 72, 79]), break_on_hyphens=False)
            rows_.append((10**6 + len(rows_), ("\n".join(f"# {x}" for x in body.split("\n")) if k % 2 else body).upper() if k == 3 else body))
            want[rows_[-1][0]] = family
    got = {r["doc_id"]: r["families"] for r in license.digest(docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows_, "doc_id long, text string"))).where("doc_id >= 1000000").collect()}
    right = sum(got[i] == f for i, f in want.items())
    assert right >= 0.95 * len(want), {i: (got[i], f) for i, f in want.items() if got[i] != f}


# 9 language model


def test_scores_against_a_loop(spark, docs, edge):
    d = docs.select("doc_id", "text").limit(120).unionByName(edge.where("doc_id <> 6 or doc_id is null").select("doc_id", "text"))
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    tokens = lambda t: [*WS.findall(lower(t)), None]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    data, c = [tuple(r) for r in d.collect()], collections.Counter()
    for i, t in data:
        if not held(i):
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i is None, i or 0, held(i), len(tokens(t)), sum(x in c for x in tokens(t)), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t)), 4)) for i, t in data)
    out = lm.digest(d).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in out) == want
    apart = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in apart) > sum(r["base_score"] for r in apart)


def test_probabilities_sum_to_one(docs):
    m, counts, _, _ = lm.train(docs.select(F.col("text").cast("binary").alias("text")))
    rest = sum(r["n"] + 1 for r in counts.collect() if bytes(r["word"]) not in m.words) + 1
    pairs = m.pairs[:: max(1, len(m.pairs) // 5)]
    for before in [[], [2], [-1], [3, 4], [-1, 5], *([int(k // m.width), int(k % m.width)] for k in pairs if k >= m.width)]:
        own = m.read(np.array(before, np.int64))
        total = rest * 10 ** (m.read(np.array([*before, -1])) - own + m.log_one)
        total += sum(10 ** (m.read(np.array([*before, w])) - own) for w in range(1, m.width))
        assert math.isclose(total, 1, rel_tol=1e-6)


@pytest.mark.parametrize("shares", [(5e-7, 1e-6), (0.02, 0.004), (0.9, 0.9)])
def test_all_repeated_ngrams_count_whatever_is_frequent(spark, monkeypatch, shares):
    random.seed(9)
    vocabulary = [f"w{i}" for i in range(12)] + ["x" * 80]
    data = [(i, " ".join(random.choices(vocabulary, weights=range(13, 0, -1), k=random.randint(0, 25)))) for i in range(40)] + [(40, "unseen " * 3 + "w1 w2"), (None, None)]
    tokens = lambda t: ["<", *(t or "").split(), ">"]
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for _, t in data[:30]:
        w = tokens(t)
        one.update(w)
        two.update(zip(w, w[1:], strict=False))
        three.update(zip(w, w[1:], w[2:], strict=False))
    two, three = ({k: n for k, n in c.items() if n >= 2} for c in (two, three))
    total, v = sum(n for w, n in one.items() if w != "<"), len(one) - 1
    p1 = lambda c: ((one[c] if c != "<" else 0) + 1) / (total + v + 1)
    p2 = {(b, c): (n - 0.75) / one[b] for (b, c), n in two.items()}
    p3 = {(a, b, c): (n - 0.75) / two[a, b] for (a, b, c), n in three.items()}

    def back(kept, lower):
        return (1 - sum(kept)) / max(1 - sum(lower), 1e-12) if kept else 1.0

    def p(a, b, c):
        if (a, b, c) in p3:
            return p3[a, b, c]
        near = p2.get((b, c)) or p1(c) * back([q for k, q in p2.items() if k[0] == b], [p1(k[1]) for k in p2 if k[0] == b])
        return near * back([q for k, q in p3.items() if k[:2] == (a, b)], [p2[k[1:]] for k in p3 if k[:2] == (a, b)])

    want = {i: sum(math.log10(p(*x)) for x in zip([None, *w], w, w[1:], strict=False)) for i, t in data for w in [tokens(t)]}
    for name, x in zip(("WORD_SHARE", "NGRAM_SHARE"), shares, strict=True):
        monkeypatch.setattr(lm, name, x)
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score(df, df.where("doc_id < 30")).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)


# 10 near-duplicates


def plain_groups(data, least=0.8):
    """All pairs, in plain Python: shingles as tuples, weights from word counts over all rows."""
    split = lambda t: t.lower().split() if t else []
    n, df = len(data), collections.Counter()
    for _, t in data:
        df.update(set(split(t)))
    idf = {w: math.log1p(n / x) for w, x in df.items()}
    sets, parent = [], list(range(n))
    for _, t in data:
        w = split(t)
        grams = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))]
        sets.append({g: c * sum(idf[x] for x in g) / len(g) for g, c in collections.Counter(grams).items() if g})

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            p, q = sets[i], sets[j]
            same = sum(min(p[g], q[g]) for g in p.keys() & q.keys())
            if p and q and same / (sum(p.values()) + sum(q.values()) - same) >= least:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {d: data[find(i)][0] for i, (d, _) in enumerate(data)}


@pytest.mark.parametrize("frequent", [near_dup.FREQUENT, 1.0])
def test_groups_against_all_pairs(spark, monkeypatch, frequent):
    """Whatever share of the words is broadcast, the groups are the same."""
    monkeypatch.setattr(near_dup, "FREQUENT", frequent)
    random.seed(5)
    vocabulary = [f"v{i}" for i in range(400)] + ["long" * 30 + str(i) for i in range(9)]
    data = []
    for _ in range(25):
        base = random.choices(vocabulary, k=random.randint(40, 200))
        for _ in range(random.randint(1, 8)):
            w = list(base)
            for _ in range(random.randint(0, 3)):
                w[random.randrange(len(w))] = random.choice(vocabulary)
            data.append((len(data), " ".join(w)))
    data += [(len(data) + i, data[i][1].upper().replace(" ", "  ")) for i in range(6)]
    d = spark.createDataFrame(data, "doc_id long, text string")
    want = plain_groups(data)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.digest(d).collect()}
    assert got == want
    if frequent == near_dup.FREQUENT:
        kept = near_dup.keep_first(d.withColumns({"more": F.lit(1), "__th": F.lit("mine"), "KEPT_ID_0": F.lit(2)}))
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values())) and kept.columns == ["doc_id", "text", "more", "__th", "KEPT_ID_0"]
        assert {r["__th"] for r in kept.collect()} == {"mine"}


def test_many_variants_of_one_text(spark, monkeypatch):
    """A bucket larger than a block: groups against all pairs."""
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    monkeypatch.setattr(near_dup, "LEADER_BLOCK", 11)
    random.seed(8)
    vocabulary = [f"v{i}" for i in range(300)]
    base = random.choices(vocabulary, k=90)
    data = []
    for i in range(140):
        w = list(base)
        for _ in range(i % 12):
            w[random.randrange(len(w))] = random.choice(vocabulary)
        data.append((i, " ".join(w)))
    got = {r["doc_id"]: r["class_id"] for r in near_dup.digest(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == plain_groups(data)


def test_groups_without_an_id_or_with_one_id_stay(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    data = [(None, a), (None, b), (None, b.upper()), (None, c), (7, c), (5, d), (5, "few words"), (9, d + " more"), (None, None)]
    kept = near_dup.keep_first(spark.createDataFrame(data, "doc_id long, text string"))
    got = sorted(((r["doc_id"], r["text"].lower() if r["text"] else None) for r in kept.collect()), key=str)
    assert got == sorted([(None, a), (None, b), (7, c), (5, d), (5, "few words"), (None, None)], key=str)


def content_sets(n: dict[bytes, int], n_docs: int):
    import zstandard

    often = near_dup.word_hashes(n, len(n)), np.array(list(n.values()))
    v = near_dup.Vocabulary(near_dup.Words(n_docs, often, np.zeros(1 << (near_dup.FILTER_BITS - 6), np.uint64)))
    none = np.zeros(0, np.int64)
    return lambda words: v.of_content(zstandard.compress(b" ".join(words)), (none, none))


def test_similarity_and_sampling():
    rng = np.random.default_rng(6)
    words = [f"w{i}".encode() for i in range(600)]
    sets = content_sets({w: 1 for w in words}, 600)
    a = [words[i] for i in rng.integers(0, 600, 400)]
    agree, exact = [], []
    for cut in (0, 8, 20, 60):
        b = list(a)
        for i in rng.integers(0, 400, cut):
            b[i] = words[int(rng.integers(0, 600))]
        x, y = sets(a), sets(b)
        count = lambda s: collections.Counter(tuple(s[i : i + 5]) for i in range(len(s) - 4))
        p, q = count(a), count(b)
        assert math.isclose(near_dup.similarity(x, y), sum((p & q).values()) / sum((p | q).values()))
        exact.append(near_dup.similarity(x, y))
        agree.append((near_dup.bands(*x) == near_dup.bands(*y)).mean())
    assert agree[0] == 1 and agree == sorted(agree, reverse=True) and exact[-1] < 0.6


def test_samples_agree_as_often_as_texts_are_similar():
    """Over many pairs, the share of equal bands follows the similarity to the third power."""
    rng = np.random.default_rng(9)
    sets = content_sets({b"w%d" % i: 1 + i for i in range(500)}, 500)
    for cut, pairs in ((4, 150), (12, 150)):
        agree, exact = [], []
        for _ in range(pairs):
            a = rng.integers(0, 500, 150)
            b = a.copy()
            b[rng.integers(0, 150, cut)] = rng.integers(0, 500, cut)
            x, y = (sets([b"w%d" % i for i in s]) for s in (a, b))
            exact.append(near_dup.similarity(x, y) ** near_dup.ROWS)
            agree.append((near_dup.bands(*x) == near_dup.bands(*y)).mean())
        assert abs(np.mean(agree) - np.mean(exact)) < 0.04


# columns of any name


CLASHES = ("__d", "__h", "__n", "__i", "__th", "__gone", "__lines", "__cuts", "text_hash_0", "gone_id_0", "bad_id_0", "mix_copy_0", "kept_id_0", "words", "key", "a.b")


@pytest.mark.parametrize("stage", [quality.keep_good, line_dedup.drop_shared_lines, near_dup.keep_first, mixing.mixed])
def test_stages_keep_columns_of_any_name(spark, edge, stage):
    """Each stage on edge rows: the rows and columns that it gives without the clashing ones, and their values untouched."""
    long = spark.createDataFrame([(20 + i, " ".join(f"{w}{j}" for j in range(60)), "en", "a", 9) for i, w in enumerate(("alpha", "beta"))], DOCS)
    d = edge.unionByName(long)
    plain = stage(d)
    own = stage(d.select("*", *[F.lit(c).alias(c) for c in CLASHES]))
    assert plain.columns == d.columns and own.columns == [*d.columns, *CLASHES]
    got = own.collect()
    assert all(tuple(r)[len(d.columns) :] == CLASHES for r in got)
    assert sorted((tuple(r)[: len(d.columns)] for r in got), key=str) == rows(plain)
    assert got and (stage is mixing.mixed or {r["doc_id"] for r in got} >= {20, 21})  # a mix takes what its hashes say
    assert stage(d.limit(0)).count() == 0


# shared


def test_words(spark, edge):
    got = edge.select("text", common.words(F.col("text")).alias("w")).collect()
    assert all(r["w"] == WS.findall(r["text"] or "") for r in got)


# 3 addresses


def test_aliases_of_hubs_and_chains(spark):
    """A redirect table with a hub of thousands, long chains and cycles, against a search in plain Python."""
    random.seed(12)
    edges = [(f"http://hub.org/{i}", "https://hub.org/0?x#f") for i in range(3000)]
    edges += [(f"http://chain{k}.org/{i}", f"http://chain{k}.org/{i + 1}") for k in range(6) for i in range(120)]
    edges += [("http://chain0.org/120", "http://bad.net/x"), ("http://chain1.org/60", "http://chain2.org/7"), ("http://chain2.org/120", "http://A.NET/"), ("http://c.org/a", "http://c.org/b"), ("http://c.org/b", "http://c.org/a"), ("no address", "http://c.org/a")]
    pages = [(i, random.choice(edges)[0], None) for i in range(400)] + [(1000, "http://chain1.org/fr/x", "<link rel=canonical href='/60'>"), (1001, None, None), (1002, "no address", "x"), (1003, "http://org.org/fr/" + "y" * 50_000, "<p>" * 50_000)]
    d = spark.createDataFrame([(*p, "mine") for p in pages], "page_id long, url string, html string, component string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(d, edges=spark.createDataFrame(edges, "src string, dst string")).collect()}

    def node(u):
        rest = u.partition("://")[2].partition("#")[0]
        m = re.match(r"([^/?]*)(.*)", rest, re.S)
        return m[1].lower() + m[2]

    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in [*edges, ("http://chain1.org/fr/x", "http://chain1.org/60")]:
        if "://" in a and "://" in b:
            x, y = find(node(a)), find(node(b))
            parent[max(x, y)] = min(x, y)
    is_net = lambda n: re.match(r"[^/?]*", n)[0].split(".")[-1] == "net"
    bad = {find(n) for n in list(parent) if is_net(n)}
    for i, u, _ in pages:
        allowed = bool(u and re.match(r"http://[^/]*org/fr/", u))
        want = "allow" if not u or "://" not in u or allowed else "block" if node(u) in parent and find(node(u)) in bad or is_net(node(u)) else "allow"
        assert got[i] == want, (i, u)
    assert {"block", "allow"} <= set(got.values())


# the pipeline


def test_pipeline_stage_by_stage(spark, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    from tokenizers import Tokenizer

    stages = dict(pipeline.STAGES)
    good = stages["quality rules"](spark, docs, SF)
    verdict = {r["doc_id"]: r["kept"] for r in quality.digest(docs).collect()}
    assert sorted(r["doc_id"] for r in good.collect()) == sorted(k for k, v in verdict.items() if v)
    good = common.durable(good)
    lines = common.durable(stages["line dedup"](spark, good, SF))
    assert lines.columns == docs.columns and lines.count() == good.count()
    once = common.durable(stages["near-duplicates"](spark, lines, SF))
    assert sorted(r["doc_id"] for r in once.collect()) == sorted({r["class_id"] for r in near_dup.digest(lines).collect()})
    mix = common.durable(stages["source mixing"](spark, once, SF))
    size = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.digest(once).collect() if r["size"]}
    assert collections.Counter(r["doc_id"] for r in mix.collect()) == {k: v for k, v in size.items() if v}
    t = Tokenizer.from_file(bpe.default_tokenizer())
    want = sorted((r["doc_id"], ",".join(map(str, t.encode(r["text"], add_special_tokens=False).ids))) for r in mix.collect())
    assert sorted((r["doc_id"], r["token_ids"]) for r in stages["byte-level BPE"](spark, mix, SF).collect()) == want
    assert pipeline.run(spark, SF).count() == mix.count()


def test_pipeline_on_edge_rows(spark, edge, monkeypatch, tmp_path):
    """All stages in turn on nulls, empties, repeats, ties and long texts, with further columns, against plain Python; and on no rows."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from tokenizers import Tokenizer

    prose = lambda w, n: " ".join(f"{w}{j}" for j in range(n))
    shared = "a line that very many documents hold"
    data = [(20, prose("a", 60) + "\n" + shared, "en", "x", 1), (21, prose("b", 60) + "\n" + shared, "en", None, 1), (22, prose("b", 60).upper(), "en", "x", 1), (23, prose("b", 60) + " " + shared, "en", "x", 1)]
    data += [(24, prose("c", 70) + "\n" + shared, None, "y", 1), (24, prose("c", 70) + "\n" + shared, None, "y", 1), (None, prose("d", 80), "en", "y", 1), (None, prose("e", 80), "en", "y", 1), (25, prose("f", 30_000), "en", "y", 1)]
    monkeypatch.setattr(quality, "MAX_CLASS_DISTANCE", 1.0)
    monkeypatch.setattr(quality, "MAX_WORD_DISTANCE", 1.0)
    d = edge.unionByName(spark.createDataFrame(data, DOCS)).select("*", F.lit("mine").alias("__th"))
    stages = dict(pipeline.STAGES)
    good = common.stored(stages["quality rules"](spark, d, ""))
    text = {i: t for i, t, *_ in data}
    assert sorted((r["doc_id"] or 0 for r in good.collect())) == sorted(x[0] or 0 for x in data)
    lines = common.stored(stages["line dedup"](spark, good, ""))
    # 20 and 21 lose the shared line, of which 24 is the keeper; within 23 it is no line
    got = collections.Counter(r["text"] for r in lines.collect())
    assert got == collections.Counter([t.removesuffix("\n" + shared) if i in (20, 21) else t for i, t, *_ in data])
    once = common.stored(stages["near-duplicates"](spark, lines, ""))
    # 22 is 21 in capitals, 23 has a few words more; 24 is there twice; two rows without an id stay
    assert sorted((r["doc_id"] or 0, r["__th"]) for r in once.collect()) == [(i, "mine") for i in (0, 0, 20, 21, 24, 25)]
    assert once.where("doc_id = 21").first()["n_chars"] == len(text[21].removesuffix("\n" + shared))
    mix = common.stored(stages["source mixing"](spark, once, ""))
    size = {(r["doc_id"], r["source"]): len(r["text"].split()) for r in once.collect() if r["doc_id"]}
    assert {r["doc_id"] for r in mix.collect()} <= {r["doc_id"] for r in once.collect()} and sum(size.values()) > 0
    t = Tokenizer.from_file(bpe.default_tokenizer())
    want = sorted((str(r["doc_id"]), ",".join(map(str, t.encode(r["text"], add_special_tokens=False).ids))) for r in mix.collect())
    assert sorted((str(r["doc_id"]), r["token_ids"]) for r in stages["byte-level BPE"](spark, mix, "").collect()) == want
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


# ---- language model: what tasks hand on


def test_words_are_those_of_bytes_split():
    texts = ["", None, " a  B\tc\n\x0b\x0cd\r", "É x  y\x1cz\x85w", "one", " \n ", "ZZ zz " * 3]
    words, n = lm.split_words(pa.array([t and t.encode() for t in texts], pa.binary()))
    want = [t.encode().lower().split() if t else [] for t in texts]
    assert n.tolist() == [len(w) for w in want] and words.to_pylist() == [x for w in want for x in w]


def test_ngrams_are_handed_on_in_few_rows(spark, docs):
    d = docs.select(F.col("text").cast("binary").alias("text")).repartition(2)
    known = spark.sparkContext.broadcast(({}, np.full(1 << (lm.FILTER_BITS - 6), ~np.uint64(0)), None))
    packed = lm.packed_ngrams(d, known, 2, 7)
    sizes = [(r["g"], len(r["n"]) // 8) for r in packed.collect()]
    assert len(sizes) <= 2 * 7 and {g for g, _ in sizes} == set(range(7)) and sum(n for _, n in sizes) > 1000
    tokens = [[None, *(r["text"] or b"").lower().split(), True] for r in d.collect()]
    want = collections.Counter(p for t in tokens for p in zip(t, t[1:], strict=False))
    got = lm.ngram_counts(d, known, 2, 7).collect()
    assert sorted(r["n"] for r in got) == sorted(n for n in want.values() if n >= lm.LEAST)
    assert len({(r["b"], r["c"]) for r in got}) == len(got)


def test_index_finds_what_a_search_finds():
    rng = np.random.default_rng(3)
    for keys in (np.zeros(0, np.int64), np.array([5]), np.unique(rng.integers(0, 1 << 40, 5000)), np.arange(0, 90000, 3)):
        asked = np.concatenate([keys, rng.integers(0, 1 << 40, 2000), np.arange(300)])
        place = {k: i for i, k in enumerate(keys.tolist())}
        assert lm.Index(keys).find(asked).tolist() == [place.get(k, -1) for k in asked.tolist()]


def test_what_texts_ask_for_is_handed_on_in_few_rows(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "NGRAM_SHARE", 0.01)  # nearly all n-grams are looked up by a join
    run, sizes = lm._met, []

    def met(rows):
        asks = rows.where(F.col("kind") == lm.ASKS).select(F.octet_length("c").alias("n")).collect()
        sizes.append((len(asks), sum(r["n"] for r in asks) // 8))
        return run(rows)

    monkeypatch.setattr(lm, "_met", met)
    d = docs.select("doc_id", "text").repartition(2)
    assert lm.digest(d).count() == d.count()
    assert len(sizes) == lm.ROUNDS and all(n <= 4 < 1000 < asked for n, asked in sizes)


def test_bits_are_those_of_the_keys(spark):
    keys = np.random.default_rng(4).integers(-(1 << 63), 1 << 63, 3000)
    want = np.zeros(1 << (lm.FILTER_BITS - 6), np.uint64)
    for at in lm._place(keys).tolist():
        want[at >> 6] |= np.uint64(1 << (at & 63))
    longs = spark.createDataFrame([(int(k),) for k in keys], "k long").repartition(3)
    packed = spark.createDataFrame([(keys[:2000].tobytes(),), (keys[1500:].tobytes(),)], "k binary")
    assert (lm._bits(longs) == want).all() and (lm._bits(packed) == want).all()


def test_hash_tables_are_not_sent_along(docs):
    m = lm.train(docs.select(F.col("text").cast("binary").alias("text")))[0]
    size = len(pickle.dumps(m))
    m.read(np.array([2, 3, 4]))
    assert len(pickle.dumps(m)) == size and pickle.loads(pickle.dumps(m)).read(np.array([2, 3, 4])) == m.read(np.array([2, 3, 4]))


def test_shuffle_files_go_between_steps(spark):
    def files():
        blocks = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {x for x in blocks.mkString(" ").split() if "shuffle_" in x}

    before = files()
    common.Scratch(spark).put(spark.range(1000).repartition(3, "id"))
    new = files() - before
    assert new
    lm._freed(spark)
    for _ in range(50):
        if not new & files():
            return
        time.sleep(0.2)
    raise AssertionError("the last step's files are still there")


# ---- near-duplicates and mixing: what Python workers do


def test_mix_starts_no_python_worker(spark, docs, monkeypatch):
    """Plans of a row per source go to the executors without Python workers, whose memory would come on top."""
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", None)
    assert mixing.mix(docs.select("doc_id", "text", "source")).where("copies > 0").count() > 0
    assert mixing.mix(docs.select("doc_id", "text", F.lit(None).cast("string").alias("source"))).where("copies > 0").count() > 0


def test_many_contents_at_once_weigh_what_each_weighs(monkeypatch):
    import zstandard

    rng = np.random.default_rng(12)
    texts = [[b"%dw" % i for i in rng.integers(0, 90, k)] for k in (1, 4, 5, 6, 3, 200, 70_000, 2, 9)]
    h = near_dup.word_hashes([b"%dw" % i for i in range(90)], 90)
    known = near_dup.Words(50, (h[:30], np.arange(1, 31)), np.zeros(1 << (near_dup.FILTER_BITS - 6), np.uint64))
    rare = np.sort(h[30:60]), np.arange(2, 32)
    contents = [(zstandard.compress(b" ".join(w)), rare) for w in texts]
    for size in (near_dup.SLICE_BYTES, 300):
        monkeypatch.setattr(near_dup, "SLICE_BYTES", size)
        v = near_dup.Vocabulary(known)
        for got, x in zip(near_dup.weighted_sets(known, contents), contents, strict=True):
            assert all(np.array_equal(a, b) for a, b in zip(got, v.of_content(*x), strict=True))


def test_bytes_are_those_of_the_array():
    a = pa.array([b"a", b"", b"\xc3\xa9 x", b"word", b"z" * 100], pa.binary())
    for x in (a, a[1:4], a[5:], pa.array([], pa.binary()), pa.array([b"", b""], pa.binary())):
        assert common.bytes_of(x) == x.to_pylist()


def test_sums_of_texts_are_handed_on_in_few_rows_however_many_groups(spark, monkeypatch):
    random.seed(11)
    vocabulary = [f"w{i}" for i in range(60)]
    data = [(i, " ".join(random.choices(vocabulary, k=25))) for i in range(300)]
    d = spark.createDataFrame(data, "doc_id long, text string")
    for name, x in (("WORD_SHARE", 0.02), ("NGRAM_SHARE", 0.01)):  # nearly all n-grams are looked up
        monkeypatch.setattr(lm, name, x)
    want = {r["doc_id"]: r for r in lm.digest(d).collect()}
    run, counts = lm._met, []

    def met(rows):
        out = run(rows)
        counts.append((rows.select("g").distinct().count(), out.count()))
        return out

    monkeypatch.setattr(lm, "_met", met)
    monkeypatch.setattr(lm, "REST_TOKENS", 300)
    monkeypatch.setattr(lm, "SUM_GROUPS", 2, raising=False)
    got = {r["doc_id"]: r for r in lm.digest(d).collect()}
    most = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(counts) == lm.ROUNDS and all(groups > 10 and n <= most for groups, n in counts)
    assert got.keys() == want.keys()
    for i, r in want.items():
        assert (got[i]["n_tokens"], got[i]["n_known"]) == (r["n_tokens"], r["n_known"])
        assert math.isclose(got[i]["score"], r["score"], rel_tol=1e-9) and math.isclose(got[i]["base_score"], r["base_score"], rel_tol=1e-9)
