"""Byte-level BPE encoding of a corpus with a public rank file.

The JVM splits texts into words; a batch of words is dictionary-encoded, and
only distinct words are encoded: a word keeps the boundaries of its parts and
the ranks of adjacent pairs in two contiguous arrays, the smallest rank is
searched by scanning, a boundary is deleted, and the two neighbouring ranks are
refreshed. Long words would make the scan quadratic; they use a heap over the
same arrays, with the same result.
"""

from __future__ import annotations

import atexit
import base64
import heapq
import shutil
import sys
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Split of the vocabulary's own pattern, for the JVM, whose \s is ASCII only.
_WS = r"\p{IsWhite_Space}"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: Words of more bytes use a heap.
LONG_WORD = 96
#: Distinct words remembered by a worker process; beyond that it forgets all.
MEMORY = 400_000
NONE = 1 << 60


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def ship(spark: SparkSession, path: str | None) -> str:
    """Sends the rank file to the executors; the name they know it by. Files of
    one name are told apart by their content, so each is sent once."""
    path = path or default_path()
    digest = xxhash.xxh3_64_hexdigest(Path(path).read_bytes())
    sc = spark.sparkContext
    sent = sc.__dict__.setdefault("_covergrid_ranks", {})
    if digest not in sent:
        folder = tempfile.mkdtemp(prefix="covergrid-ranks-")
        atexit.register(shutil.rmtree, folder, True)
        sc.addFile(shutil.copy(path, f"{folder}/ranks-{digest}"))
        sent[digest] = f"ranks-{digest}"
    return sent[digest]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_word(ranks: dict[bytes, int], word: bytes) -> list[int]:
    """Token ids of a word."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > LONG_WORD:
        return _merge_long(ranks, word)
    get = ranks.get
    start = list(range(len(word) + 1))  # part i is word[start[i]:start[i + 1]]
    pair = [get(word[i : i + 2], NONE) for i in range(len(word) - 1)]  # rank of parts i and i + 1 joined
    while pair:
        low = min(pair)
        if low == NONE:
            break
        i = pair.index(low)
        del start[i + 1], pair[i]
        if i < len(pair):
            pair[i] = get(word[start[i] : start[i + 2]], NONE)
        if i:
            pair[i - 1] = get(word[start[i - 1] : start[i + 1]], NONE)
    return [ranks[word[a:b]] for a, b in zip(start, start[1:])]


def _merge_long(ranks: dict[bytes, int], word: bytes) -> list[int]:
    n = len(word)
    end = list(range(1, n + 1))  # where the part that starts at i ends; 0 if none starts there
    before = list(range(-1, n - 1))  # where the part before it starts
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != to:
            continue  # one of the two parts has changed
        end[i], end[mid] = to, 0
        if to < n:
            before[to] = i
            if (r := get(word[i : end[to]])) is not None:
                heapq.heappush(heap, (r, i, end[to]))
        if (p := before[i]) >= 0 and (r := get(word[p:to])) is not None:
            heapq.heappush(heap, (r, p, to))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Vocabulary:
    """Ranks, and the ids of words met so far, one per worker process."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.seen: dict[str, list[int]] = {}

    @staticmethod
    def of(name: str) -> "Vocabulary":
        """That of a file sent by ``ship``."""
        kept = sys.modules[__name__].__dict__.setdefault("_VOCABULARIES", {})
        if name not in kept:
            kept[name] = Vocabulary(SparkFiles.get(name))
        return kept[name]

    def table(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, first position, number) of each word."""
        seen, ranks = self.seen, self.ranks
        if len(seen) > MEMORY:
            seen.clear()
        flat: list[int] = []
        count = np.empty(len(words), "int64")
        for k, w in enumerate(words):
            ids = seen.get(w)
            if ids is None:
                ids = seen[w] = merge_word(ranks, w.encode())
            flat += ids
            count[k] = len(ids)
        first = np.zeros(len(words), "int64")
        np.cumsum(count[:-1], out=first[1:])
        return np.array(flat, "int32"), first, count


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Positions first[k], first[k] + 1, ... of count[k] each, one after another."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(first - (ends - count), count) + np.arange(total)


def encode_batch(vocabulary: Vocabulary, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray, np.ndarray]:
    """(token ids, token offset per text, coded words, tokens per word)."""
    offsets = words.offsets.to_numpy()
    coded = words.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode() if len(words) else pa.array([], pa.string()).dictionary_encode()
    flat, first, count = vocabulary.table(coded.dictionary.to_pylist())
    at = coded.indices.to_numpy()
    per_word = count[at]
    ids = flat[ragged(first[at], per_word)]
    upto = np.zeros(len(at) + 1, "int64")
    np.cumsum(per_word, out=upto[1:])
    return ids, upto[offsets - offsets[0]], coded, per_word


def word_column(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORDS), F.lit(0))


def _encoder(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.of(name)
        for b in batches:
            ids, offsets, _, _ = encode_batch(vocabulary, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype("int32")), pa.array(ids))], ["id", "ids"])

    return run


def encode(df: DataFrame, id: str, text: str, path: str | None = None) -> DataFrame:
    """``id, ids``: the token ids of each text, special tokens never made (their
    strings are ordinary text). Null and empty texts give an empty list; rows
    repeated exactly come out as often. Texts are processed whole. Only the two
    columns are read. Nothing is shuffled."""
    rows = df.select(F.col(f"`{id}`").alias("id"), word_column(F.col(f"`{text}`")).alias("words"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_encoder(ship(df.sparkSession, path)), f"id {kind}, ids array<int>").withColumnRenamed("id", id)
