"""Language identification with a string kernel.

The kernel of two texts counts the character n-grams of 2, 3 and 4 letters that both hold
(presence, not frequency), normalised by the sizes of their n-gram sets.  n-grams are told apart
by 64-bit hashes, so sets of long texts don't fill up; what a text shares with the landmarks is
found among the n-grams that those hold.  A Nystroem map
over a few landmark texts turns it into features, on which one-versus-rest kernel ridge
regression is solved on the driver.  Training reads a bounded sample of labelled rows
(``MAX_TRAIN``, ``MAX_LANDMARKS``), drawn by hash evenly over the languages.

Scoring is a batch of matrix products: presence rows (of the landmarks' n-grams) times landmark
columns, and the kernel values times the regression weights.  The whole text of every row is read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MAX_TRAIN, MAX_LANDMARKS = 1200, 96
#: Languages that can be told apart; more are an error.
MAX_LANGUAGES = 300
NGRAMS, RIDGE = (2, 3, 4), 1e-2
#: Texts that are scored in one product; how steeply scores follow the regression's values, which are about -1 to 1.
BATCH, STEEP = 128, 4
FOLDS, HELD_OUT = 4, 2
_GAPS = re.compile(r"[\W\d_]+")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def ngrams(text: str) -> np.ndarray:
    """Sorted hashes of the distinct n-grams: lower-cased letters, with one space for all between them."""
    a = np.frombuffer((" " + _GAPS.sub(" ", text.lower()).strip() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    found = []
    for n in NGRAMS:
        if len(a) < n:
            break
        h = np.full(len(a) - n + 1, n, np.uint64)
        for i in range(n):
            h = (h ^ a[i : len(a) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        found.append(h)
    return np.unique(np.concatenate(found)).view(np.int64)


def landmark_places(langs: list[str]) -> list[int]:
    """The first rows of each language, as many of each."""
    share, seen, out = max(1, MAX_LANDMARKS // max(1, len(set(langs)))), Counter(), []
    for i in sorted(range(len(langs)), key=lambda i: (langs[i], i)):
        seen[langs[i]] += 1
        if seen[langs[i]] <= share:
            out.append(i)
    return out


class Model:
    """The landmarks' n-grams and columns, weights by language and the languages in order."""

    def __init__(self, sets: list[np.ndarray], langs: list[str]) -> None:
        """sets: n-grams of the training texts."""
        marks = landmark_places(langs)
        self.set_landmarks([sets[i] for i in marks])
        self.fit(self.kernel(sets), langs, marks)

    @classmethod
    def of_landmarks(cls, sets: list[np.ndarray]) -> Model:
        """A model that has kernel values, but isn't fitted."""
        out = cls.__new__(cls)
        out.set_landmarks(sets)
        return out

    def set_landmarks(self, sets: list[np.ndarray]) -> None:
        self.grams = np.unique(np.concatenate(sets))
        self.landmarks = self.rows(sets).T / np.sqrt([max(1, len(x)) for x in sets]).astype(np.float32)

    def fit(self, k_xm: np.ndarray, langs: list[str], marks: list[int]) -> None:
        """Weights from the training texts' kernel values with the landmarks, which are those at ``marks``."""
        self.langs = sorted(set(langs))
        value, vector = np.linalg.eigh(k_xm[marks].astype(np.float64))
        keep = value > 1e-6 * max(value.max(initial=0.0), 1e-12)
        root = vector[:, keep] / np.sqrt(value[keep])
        f = k_xm @ root
        # each language weighs the same, however many rows it has
        many = {k: langs.count(k) for k in self.langs}
        w = np.array([1 / many[k] for k in langs])
        y = np.where(np.array(langs)[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
        left = f.T @ (f * w[:, None]) + RIDGE * np.eye(f.shape[1]) / max(1, f.shape[1])
        self.weights = (root @ np.linalg.solve(left, f.T @ (y * w[:, None]))).astype(np.float32)

    def rows(self, sets: list[np.ndarray]) -> np.ndarray:
        """Presence of the landmarks' n-grams."""
        p = np.zeros((len(sets), len(self.grams)), dtype=np.float32)
        for i, h in enumerate(sets):
            at = np.minimum(np.searchsorted(self.grams, h), len(self.grams) - 1)
            p[i, at[self.grams[at] == h]] = 1
        return p

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """Values with the landmarks, in batches."""
        parts = [self.rows(sets[i : i + BATCH]) @ self.landmarks for i in range(0, len(sets), BATCH)]
        return np.concatenate(parts) / np.sqrt([max(1, len(h)) for h in sets]).astype(np.float32)[:, None]

    def values(self, texts: list[str]) -> np.ndarray:
        """Regression values by text and language."""
        return self.kernel([ngrams(t) for t in texts]) @ self.weights

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Languages and scores: the softmax of the regression values."""
        value = self.values(texts)
        e = np.exp(STEEP * (value - value.max(axis=1, keepdims=True)))
        best = value.argmax(axis=1)
        return [self.langs[i] for i in best], (e[np.arange(len(best)), best] / e.sum(axis=1)).astype(float).tolist()


def train(labelled: DataFrame, max_train: int = MAX_TRAIN) -> Model | None:
    """From (doc_id, text, lang); null languages and texts without a letter are left out.  None without any row."""
    d = labelled.select("doc_id", "text", "lang").where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}"))
    # rows are told apart by id and text, so neither null nor shared ids keep or lose a language as a whole; equal ones count once
    d = d.select("lang", "text", F.xxhash64(F.lit(17), "doc_id", "text").alias("draw"))
    counts = d.groupBy("lang").agg(F.approx_count_distinct("draw", 0.02).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return None
    each = max(4, max_train // len(counts))
    # a hash below the language's own threshold; a few more than needed, so that each has enough
    share = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(min(1.0, (1.25 * each + 8) / max(1, r["n"])))) for r in counts])
    part = F.pmod(F.col("draw"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = d.where(part <= share).groupBy("lang", "draw").agg(F.first("text").alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, BATCH):
                rows = b.slice(i, BATCH)
                found = [ngrams(t).tobytes() for t in rows.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column("lang"), rows.column("draw"), pa.array(found, pa.binary())], ["lang", "draw", "grams"])

    box = Scratch(labelled.sparkSession)
    drawn = box.put(sample.mapInArrow(sets, "lang string, draw long, grams binary").withColumn("same", F.xxhash64("lang", "grams")))
    # the driver gets a few numbers of each row, the n-grams of the landmarks, and the others' values with them
    by_hash = sorted((r["lang"], r["draw"] % (1 << 30), r["draw"], r["same"]) for r in drawn.select("lang", "draw", "same").collect())
    chosen: dict[str, dict[int, int]] = {}
    for lang, _, draw, same in by_hash:
        own = chosen.setdefault(lang, {})
        if len(own) < each:
            own.setdefault(same, draw)
    langs = [k for k in sorted(chosen) for _ in chosen[k]]
    draws = [x for k in sorted(chosen) for x in chosen[k].values()]
    marks = landmark_places(langs)
    of = lambda draws: drawn.where(F.col("draw").isin(draws)).select("lang", "draw", "grams")
    own = {(r["lang"], r["draw"]): np.frombuffer(bytes(r["grams"]), np.int64) for r in of([draws[i] for i in marks]).toLocalIterator()}
    model = Model.of_landmarks([own[langs[i], draws[i]] for i in marks])
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, BATCH):
                rows = b.slice(i, BATCH)
                k = shared.value.kernel([np.frombuffer(x, np.int64) for x in rows.column("grams").to_pylist()])
                yield pa.RecordBatch.from_arrays([rows.column("lang"), rows.column("draw"), pa.array(list(k), pa.list_(pa.float32()))], ["lang", "draw", "k"])

    k_of = {(r["lang"], r["draw"]): r["k"] for r in of(draws).mapInArrow(values, "lang string, draw long, k array<float>").collect()}
    model.fit(np.array([k_of[x] for x in zip(langs, draws, strict=True)], np.float32), langs, marks)
    shared.destroy()
    box.drop()
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per input row: doc_id, lang_pred and score (0 to 1).

    A null text, or one without a letter, is ``und`` with score 0; so is everything without a model.
    Very long texts are read whole.  Of languages with equal values the first by name is taken.
    Repeated rows each give a row; an empty table gives none.  Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column("text").to_pylist()
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            known = [i for i, t in enumerate(texts) if m is not None and has_letter(t)]
            for i in range(0, len(known), BATCH):
                part = known[i : i + BATCH]
                for j, lang, s in zip(part, *m.predict([texts[j] for j in part]), strict=True):
                    langs[j], scores[j] = lang, s
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def digest(docs: DataFrame) -> DataFrame:
    """Learns from the rows of the other folds; a null doc_id counts as an empty string."""
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
