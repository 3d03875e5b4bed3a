"""Spelling variants, importance resampling and substring dedup against plain Python and their SQL."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafmill.llm import bpe, importance, lang_id, spelling, substring
from leafmill.llm import queries as Q
from leafmill.llm.fm_index import FMIndex

from ..conftest import SF

DOCS = "doc_id long, text string, `e.x` string, word string, n_words long"


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_importance_resampling", "op13_substring_dedup"])
def test_queries_equal_their_sql(spark, same, name):
    same(Q.QUERIES[name](spark, SF), Q.ORACLES[name])


# ---- substring dedup


def test_index_finds_the_least_value_of_each_window():
    rng = np.random.default_rng(1)
    for _ in range(100):
        length, kinds = int(rng.integers(1, 9)), int(rng.integers(1, 5))
        texts = [rng.integers(0, kinds, rng.integers(0, 30)) * 7 - 3 for _ in range(rng.integers(1, 8))]
        values = rng.integers(0, 100, len(texts))
        asked = [rng.integers(0, kinds + 1, rng.integers(0, 40)) * 7 - 3 for _ in range(5)] + texts
        index = FMIndex(np.concatenate(texts), np.array([len(x) for x in texts]), values, length)
        least: dict[tuple, int] = {}
        for text, v in zip(texts, values, strict=True):
            for i in range(len(text) - length + 1):
                w = tuple(text[i : i + length])
                least[w] = min(least.get(w, 999), v)
        want = [least.get(tuple(q[i : i + length]), 999) if i + length <= len(q) else 999 for q in asked for i in range(len(q))]
        assert index.search(np.concatenate(asked), np.array([len(q) for q in asked]), 999).tolist() == want


def plain_repeats(rows: list[tuple], length: int) -> Counter:
    """(doc_id, words, removed, kept text) of each row, by a table of all windows."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    rank = lambda i: math.inf if i is None else i
    least: dict[tuple, float] = {}
    for i, text in rows:
        w = split(text)
        for p in range(len(w) - length + 1):
            key = tuple(w[p : p + length])
            least[key] = min(least.get(key, math.inf), rank(i))
    out = Counter()
    for i, text in rows:
        w = split(text)
        gone = {p + o for p in range(len(w) - length + 1) if least[tuple(w[p : p + length])] < rank(i) for o in range(length)}
        out[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    return out


def passages(rng: random.Random, n: int) -> list[tuple]:
    word = lambda: rng.choice(["a", "b", "cc", "Ä", "d d", "日本"]) if rng.random() < 0.3 else f"w{rng.randrange(300)}"
    shared = [[word() for _ in range(rng.randrange(5, 60))] for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.5 else [word() for _ in range(rng.randrange(0, 30))] for _ in range(rng.randrange(0, 5))]
        rows.append((i * 3, rng.choice([" ", "\n", "\t ", "\x0b"]).join(w for p in parts for w in p)))
    return rows


@pytest.mark.parametrize("big", [substring.BIG_ANCHOR, 30])
def test_repeats_equal_plain_python(spark, monkeypatch, big):
    # with a small limit hot anchors are dealt out by windows
    monkeypatch.setattr(substring, "BIG_ANCHOR", big)
    monkeypatch.setattr(substring, "SHARD_WORDS", 500)
    rng = random.Random(7)
    rows = passages(rng, 60)
    rows += [(None, rows[5][1]), (None, rows[5][1]), (rows[7][0], rows[7][1]), (rows[7][0], rows[5][1] + " x"), (1, None), (2, ""), (4, " \n\t"), (5, "same " * 400), (6, "same " * 90)]
    rows.append((1000, " ".join(w for _, t in rows if t for w in t.split())))  # a long text
    out = substring.drop_repeats(spark.createDataFrame([(i, t, "x", "y", 3) for i, t in rows], DOCS), 12)
    assert out.columns == ["doc_id", "text", "e.x", "word", "n_words_0", "n_words", "n_removed"]
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in out.collect())
    assert got == plain_repeats(rows, 12)


def test_repeats_of_an_empty_table(spark):
    assert substring.digest(spark.createDataFrame([], DOCS)).count() == 0


# ---- spelling variants


def plain_words(rows: list[tuple]) -> dict[str, int]:
    total: Counter[str] = Counter()
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    for i, text in rows:
        for w, n in Counter(x.translate(low) for x in re.findall("[A-Za-zÀ-ÿ]+", text or "")).items():
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += n
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def plain_near(words: dict[str, int]) -> dict[str, list[str]]:
    """All pairs, letter by letter."""

    def near(a: str, b: str) -> bool:
        if len(a) > len(b):
            a, b = b, a
        if a == b or len(b) - len(a) > 1:
            return False
        return any((a[:i] + a[i + 1 :] if len(a) == len(b) else a) == b[:i] + b[i + 1 :] for i in range(len(b)))

    return {w: [v for v in words if near(w, v)] for w in words}


def plain_variants(rows: list[tuple]) -> Counter:
    words = plain_words(rows)
    near = plain_near(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = Counter()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None] += 1
    return out


def spelt(rng: random.Random) -> list[tuple]:
    base = ["planet", "Éclair", "straße", "banana", "aaaaaa", "abababab", "motion", "notion", "lotion", "nation", "x" * 9] + ["".join(rng.choices("abcé", k=rng.randrange(4, 9))) for _ in range(12)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randrange(0, 60)):
            w = rng.choice(base)
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                p = rng.randrange(len(w) + 1)
                w = rng.choice([w[:p] + w[p + 1 :], w[:p] + rng.choice("abé") + w[p:], w[:p] + rng.choice("abcÀ") + w[p + 1 :]])
            words.append(w)
        rows.append((i - 3, rng.choice([" ", ",", "×1 ", "日", "_"]).join(words)))
    return rows + [(None, "planet planets " * 5), (None, None), (0, ""), (0, "7 - !"), (7, "motion " * 3000), (7, "motion " * 3000)]


@pytest.mark.parametrize("block", [spelling.BLOCK, 7])
def test_variants_equal_all_pairs(spark, monkeypatch, block):
    # with small blocks every shard is cut
    monkeypatch.setattr(spelling, "BLOCK", block)
    rows = spelt(random.Random(3))
    out = spelling.variants(spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], DOCS))
    got = Counter(tuple(r) for r in out.select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == plain_variants(rows) and len(got) > 100


def test_variants_of_an_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], DOCS)).count() == 0


# ---- importance resampling


def plain_resampled(rows: list[tuple], targets: list[str | None], order: int, buckets: int, least: int) -> list[tuple]:
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    features = lambda w: [" ".join(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)]
    s, t = (Counter(bucket(f) for text in texts for f in features(split(text))) for texts in ([x for _, x in rows], targets))
    many_s, many_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (many_s + buckets) / ((s[b] + 1) * (many_t + buckets))))
    out = []
    for i, text in rows:
        f = features(split(text))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(x)) for x in f)
        out.append([i, len(split(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], math.inf if x[0] is None else x[0]))
    rank = {id(x): k for k, x in enumerate(able[: 30 * len(able) // 100], 1)}
    return sorted(((x[0], x[2], x[3], x[4], rank.get(id(x))) for x in out), key=str)


@pytest.mark.parametrize(("order", "share"), [(1, importance.SHARE), (1, 0.05), (2, 0.02), (3, 1.0)])
def test_resampling_equals_plain_python(spark, monkeypatch, order, share):
    # with large shares most words and tuples take the joins
    monkeypatch.setattr(importance, "SHARE", share)
    rng = random.Random(5)
    words = ["The", "the", "straße", "日本", "ÄB", "x1", "7", "a" * 90] + [f"w{k}" for k in range(60)]
    text = lambda: rng.choice([" ", ", ", "\n", "_"]).join(rng.choices(words, k=rng.randrange(0, 60)))
    rows = [(i, text()) for i in range(50)] + [(None, text()), (60, None), (61, ""), (62, "?! "), (63, "w1 w2 " * 3000), (3, "w3 w4 " * 30)]
    targets = [text() for _ in range(7)] + [None, ""]
    d = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], DOCS)
    out = importance.resampled(d, spark.createDataFrame([(t,) for t in targets], "text string"), order=order, buckets=50, percent=30, least_words=10)
    got = sorted((tuple(r) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)
    assert got == plain_resampled(rows, targets, order, 50, 10)


def test_resampling_of_ties_and_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "w " * 30)] * 40, "doc_id long, text string")  # repeated rows are drawn one by one
    assert importance.resampled(empty, empty).count() == 0
    assert importance.resampled(empty, some).count() == 0
    out = importance.resampled(some, empty).toPandas()
    assert sorted(out["rank"].dropna()) == [1, 2, 3, 4] and out["score"].nunique() == 1
    assert pd.isna(importance.resampled(some.limit(3), some).toPandas()["rank"]).all()


# ---- language identification: what the training sample keeps


@pytest.mark.parametrize("same_id", [None, 7])
def test_no_language_is_lost_by_its_ids(spark, same_id):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text")
    rows = docs.withColumn("doc_id", F.lit(same_id).cast("long")).unionByName(spark.createDataFrame([(9, "xx", "zulu qqq zzz")] * 400, "doc_id long, lang string, text string"))
    model = lang_id.train(rows, max_train=60)
    assert model.langs == sorted({r["lang"] for r in docs.where("lang is not null").select("lang").distinct().collect()} | {"xx"})


# ---- substring dedup: memory of Python workers


@pytest.mark.parametrize("most", [substring.BIG_ANCHOR, 0])
def test_substring_workers_hand_memory_back(spark, monkeypatch, most):
    """A worker that has done its part lives on, idle, beside those of the next stage."""
    kind = type(spark.range(1))
    run, given = kind.mapInArrow, []
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *more: given.append(f) or run(self, f, *more))
    monkeypatch.setattr(substring, "BIG_ANCHOR", most)
    d = spark.createDataFrame([(i, " ".join(f"w{k % 70}" for k in range(i, 90))) for i in range(4)], "doc_id long, text string")
    assert substring.digest(d).where("n_removed > 0").count() == 3
    assert len(given) == (5 if most == 0 else 4) and all(hasattr(f, "__wrapped__") for f in given)


# ---- byte-pair encoding: words that no task knows beforehand


@pytest.mark.parametrize("share", [1.0, 0.01])
def test_rarer_words_are_encoded_by_tasks(spark, monkeypatch, share):
    # with these no word, or few, are in the shared table, and a task forgets its own again and again
    monkeypatch.setattr(bpe, "FREQUENT", share)
    monkeypatch.setattr(bpe, "TASK_WORDS", 50)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    docs = docs.unionByName(spark.createDataFrame([(-1, " ".join(f"Wörter{k * 7919}" for k in range(3000))), (-2, None), (-3, "")], "doc_id long, text string"))
    tokenizer = Tokenizer.from_file(bpe.default_tokenizer())
    want = set()
    for r in docs.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.add((r["doc_id"], len(ids), digest(",".join(map(str, ids))), digest(tokenizer.decode(ids, skip_special_tokens=False))))
    got = bpe.digest(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert {tuple(r) for r in got.collect()} == want


def test_words_are_counted_in_tasks_before_they_are_shuffled(spark, monkeypatch):
    texts = ["aa bb  aa\n", "aa <|endoftext|>aa", None, "", " \t é é"] * 50
    d = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    for most in (200_000, 2):
        monkeypatch.setattr(bpe, "TASK_WORDS", most)
        counts = bpe.distinct_words(d, bpe.default_tokenizer())
        want = collections.Counter(w for t in texts for w in bpe._split(bpe.default_tokenizer())(t or ""))
        assert {r["word"]: r["n"] for r in counts.collect()} == want
        plan = counts._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "MapInArrow" in plan  # no row for each word
