"""BPE encoding through a table of distinct words, and decoding through a table of pieces.

1. Words: each text is split at special tokens and white space (``words_of`` does the same by built-in functions,
   which takes several times as long): a word is a run of anything but white space with the space before it, or white space that goes to
   no word.  The tokenizer's own pattern never matches across the ends of such words.
2. The distinct words of all texts are counted; each that makes up at least ``FREQUENT`` of
   all words is encoded once.  There are at most 1 / FREQUENT of them, each of at most
   ``MAX_FREQUENT_BYTES``, so their table can go to every task.
3. Each task keeps a table of the rarer words that it meets and encodes those once
   (``TASK_WORDS`` at most at a time).
4. Ids come back to each text position by position.

Joining the rarer words by a shuffle instead, and the texts with what it finds, needs more disk
than the texts have: see the README for figures.

Decoding looks each id up in the table of pieces, which is as large as the vocabulary.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import giving_back, stored

FREQUENT = 1e-6
MAX_FREQUENT_BYTES = 64
#: Rarer words that a task remembers; then it starts afresh.
TASK_WORDS = 200_000
ROWS = 500
#: The code points with the Unicode property White_Space.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _tokenizer(path: str):  # noqa: ANN202
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=2)
def special_tokens(path: str) -> tuple[str, ...]:
    """Special tokens of a byte-level tokenizer whose words can be encoded one by one; any other file is an error."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    pre, decoder = d.get("pre_tokenizer") or {}, d.get("decoder") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    flags = any(x.get(k) for x in d["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized"))
    if not plain or d.get("normalizer") or decoder.get("type") != "ByteLevel" or d["model"].get("type") != "BPE" or flags:
        raise ValueError(f"{path}: only byte-level BPE without normaliser, prefix space or flags of added tokens is supported")
    return tuple(sorted((x["content"] for x in d["added_tokens"]), key=len, reverse=True))


def _byte_names() -> dict[int, str]:
    """The printable stand-ins for bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


def words_of(text: Column, marks: tuple[str, ...]) -> Column:
    """The words of a text, by built-in functions; special tokens are words of their own."""
    text = F.coalesce(text, F.lit(""))
    out = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    if marks:
        mark = "|".join("".join(c if c.isalnum() else f"\\{c}" for c in m) for m in marks)
        other = f"(?:(?!{mark})[^{SPACES}])"
        marked = f"{mark}| ?{other}+|[{SPACES}]+(?!{other})|[{SPACES}]+"
        out = F.when(text.rlike(mark), F.regexp_extract_all(text, F.lit(marked), F.lit(0))).otherwise(out)
    return out


def _split(path: str) -> Callable[[str], list[str]]:
    """The same from a text in a task."""
    find, marks = re.compile(WORD).findall, special_tokens(path)
    cut = re.compile("(" + "|".join(map(re.escape, marks)) + ")").split if marks else None

    def words(text: str) -> list[str]:
        if cut is None or not any(m in text for m in marks):
            return find(text)
        return [w for i, part in enumerate(cut(text)) for w in ([part] if i % 2 else find(part))]

    return words


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of batches: Python objects are made of ROWS texts at a time."""
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            yield b.slice(i, ROWS)


def distinct_words(docs: DataFrame, path: str) -> DataFrame:
    """(word, n) of all texts; counts are summed within tasks before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = _split(path), Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
        for b in _slices(batches):
            for text in b.column("text").to_pylist():
                seen.update(words(text or ""))
                if len(seen) > TASK_WORDS:
                    yield flush()
                    seen.clear()
        yield flush()

    return docs.select("text").mapInArrow(giving_back(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _ids(words: list[str], path: str) -> list[str]:
    """The ids of each word: decimal, joined by commas."""
    return [",".join(map(str, e.ids)) for e in _tokenizer(path).encode_batch_fast(words, add_special_tokens=False)]


def encode_words(table: DataFrame, path: str) -> DataFrame:
    """(word, ids): each distinct word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(_ids(b.column("word").to_pylist(), path), pa.string())], ["word", "ids"])

    return table.select("word").mapInArrow(giving_back(run), "word string, ids string")


def _encoder(docs: DataFrame, path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches of (doc_id, text) to batches of (doc_id, n_tokens, ids), with the frequent words of ``docs`` known."""
    counts = stored(distinct_words(docs, path))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = counts.where((F.col("n") >= FREQUENT * total) & (F.octet_length("word") <= MAX_FREQUENT_BYTES))
    frequent = docs.sparkSession.sparkContext.broadcast({r["word"]: r["ids"] for r in encode_words(often, path).toLocalIterator()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shared, own = _split(path), frequent.value, {}
        for b in _slices(batches):
            n, texts = [], []
            for text in b.column("text").to_pylist():
                ws = words(text or "")
                found = list(map(shared.get, ws))
                if None in found:
                    rest = [i for i, x in enumerate(found) if x is None]
                    asked = {ws[i] for i in rest}
                    new = [w for w in asked if w not in own]
                    if len(own) + len(new) > TASK_WORDS:
                        own.clear()
                        new = list(asked)
                    own.update(zip(new, _ids(new, path), strict=True))
                    for i in rest:
                        found[i] = own[ws[i]]
                ids = ",".join(found)
                n.append(ids.count(",") + 1 if ids else 0)
                texts.append(ids)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids"])

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids): one row per input row; ids are decimal, joined by commas.

    The ids are those of the tokenizers library with add_special_tokens=False.  Null and empty
    texts have none (an empty string).  Very long texts and words are encoded whole.  Repeated rows
    each give a row; an empty table gives none.  Columns other than doc_id and text are ignored.
    A tokenizer whose words can't be encoded one by one is an error.
    """
    run = _encoder(docs, path or default_tokenizer())
    return docs.select("doc_id", "text").mapInArrow(giving_back(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids string")


@lru_cache(maxsize=2)
def _pieces(path: str) -> pa.Array:
    """Bytes by id: the printable stand-ins of a byte-level vocabulary, undone; null for an id that isn't used."""
    shown, special = {c: b for b, c in _byte_names().items()}, set(special_tokens(path))
    vocab = _tokenizer(path).get_vocab(with_added_tokens=True)
    out: list[bytes | None] = [None] * (max(vocab.values(), default=-1) + 1)
    for p, i in vocab.items():
        out[i] = p.encode() if p in special else bytes(shown[c] for c in p)
    return pa.array(out, pa.binary())


def _decoder(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds ``text`` to batches with ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for b in _slices(batches):
            ids = pc.split_pattern(pc.if_else(pc.equal(b.column("ids"), ""), None, b.column("ids")), ",")
            found = pieces.take(ids.flatten().cast(pa.int64()))  # the pieces of all rows, one after another
            if found.null_count:
                raise KeyError("an id that the tokenizer doesn't have")
            n = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
            whole = np.frombuffer(found.buffers()[2] or b"", np.uint8).tobytes()
            ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(pc.binary_length(found).to_numpy(), dtype=np.int64)])[np.cumsum(n)].tolist()
            texts = [whole[i:j].decode("utf-8", "replace") for i, j in zip([0, *ends], ends, strict=False)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "text"])

    return run


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds ``text`` to rows with ``ids`` (decimal, joined by commas; null: none); bytes that aren't UTF-8 become U+FFFD.  An unknown id is an error."""
    encoded = encoded.drop("text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(giving_back(_decoder(path or default_tokenizer())), f"{kinds}, text string")


def encode_and_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, text): both in one pass of a Python worker; text is decoded from the ids."""
    path = path or default_tokenizer()
    encoder, decoder = _encoder(docs, path), _decoder(path)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids string, text string"
    return docs.select("doc_id", "text").mapInArrow(giving_back(lambda batches: decoder(encoder(batches))), schema)


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    coded = encode_and_decode(docs, path)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
