"""Splitting oversized texts at natural boundaries.

Every token position of a batch of texts is joined to its farthest legal
successor (the next cut, with room for the overlap), and the successor table is
squared again and again, so the cuts of all texts of the batch are found in
parallel in log2(pieces) rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covergrid.llm.bpe import Vocabulary, encode_batch, ragged, ship, word_column

LIMIT, OVERLAP = 1024, 64
#: Kinds of cuts, weakest first: between tokens, words, lines, paragraphs, hunks, files.
CUTS = ("token", "word", "line", "paragraph", "hunk", "file")


def levels(coded: pa.DictionaryArray) -> np.ndarray:
    """Kind (index in CUTS) of a cut before each word of a batch."""
    words = coded.dictionary.to_pylist()
    at = coded.indices.to_numpy()
    n = len(at)
    if not n:
        return np.zeros(0, "int8")
    flag = lambda test: np.array([test(w) for w in words], bool)[at]
    ends = flag(lambda w: w.endswith("\n"))
    opens = flag(lambda w: w.lstrip("\r").startswith("\n") and not w.endswith("\n"))  # newline and indentation in one word
    breaks = np.array([w.count("\n") for w in words])[at]
    before = lambda x, k=1: np.concatenate([np.zeros(min(k, n), x.dtype), x[:-k]]) if n > k else np.zeros(n, x.dtype)
    after = lambda x: np.concatenate([x[1:], np.zeros(1, x.dtype)])
    start = before(ends)
    level = np.ones(n, "int8")
    level[start | opens] = 2
    blank = (start & ((before(breaks) > 1) | before(ends, 2))) | (opens & ((breaks > 1) | start))
    level[blank] = 3
    level[start & flag(lambda w: w.startswith("@@"))] = 4
    header = (flag(lambda w: w == "diff") & after(flag(lambda w: w == " --"))) | (flag(lambda w: w == "Index") & after(flag(lambda w: w == ":")))
    level[start & header] = 5
    return level


def successors(offsets: np.ndarray, place: np.ndarray, level: np.ndarray, limit: int, overlap: int) -> np.ndarray:
    """Next cut after a cut at each token position. Text t holds positions
    offsets[t] + t .. offsets[t + 1] + t, the last of which is its end.

    A cut lies at most ``limit`` tokens on from the start of a text, and
    ``limit - overlap`` from a later cut, as the piece repeats ``overlap``
    tokens; and at least ``overlap`` tokens on. Of the cuts in the upper half of
    that reach the strongest kind wins, of that kind the farthest; else the
    farthest between lines or stronger, else between words, else between tokens.
    """
    texts = len(offsets) - 1
    first, last = offsets[:-1] + np.arange(texts), offsets[1:] + np.arange(texts)
    total = int(last[-1]) + 1 if texts else 0
    p = np.arange(total)
    own = np.repeat(np.arange(texts), last - first + 1)
    reach = np.where(p == first[own], limit, limit - overlap)
    far = p + reach
    done = far >= last[own]
    out = far.copy()
    chosen = done.copy()
    out[done] = last[own][done]
    todo = np.flatnonzero(~chosen)
    for k, least in [(5, reach // 2), (4, reach // 2), (3, reach // 2), (2, reach // 2), (2, None), (1, None)]:
        cuts = place[level >= k]
        if not len(cuts) or not len(todo):
            continue
        c = cuts[np.maximum(np.searchsorted(cuts, far[todo], "right") - 1, 0)]
        low = p[todo] + (np.maximum(least[todo], overlap) if least is not None else overlap)
        ok = (c <= far[todo]) & (c >= low)
        out[todo[ok]] = c[ok]
        todo = todo[~ok]
    return out


def all_cuts(succ: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All positions reached from the starts, by squaring the table."""
    reached, table = starts, succ
    is_end = np.zeros(len(succ), bool)
    is_end[ends] = True
    while True:
        nxt = table[reached]
        reached = np.unique(np.concatenate([reached, nxt]))
        if is_end[nxt].all():
            return reached
        table = table[table]


def _splitter(name: str, limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.of(name)
        for b in batches:
            ids, offsets, coded, per_word = encode_batch(vocabulary, b.column(1))
            size = np.diff(offsets)
            over = np.flatnonzero(size > limit)
            if not len(over):
                continue
            # word starts and their levels, in positions (one extra position a text)
            word_at = np.zeros(len(per_word), "int64")
            np.cumsum(per_word[:-1], out=word_at[1:])
            level = levels(coded)
            text_of = np.searchsorted(offsets, word_at, "right") - 1
            big = np.zeros(len(size), bool)
            big[over] = True
            take = big[text_of] & (word_at > offsets[text_of])
            small_off = np.concatenate([[0], np.cumsum(size[over])])
            rank = np.zeros(len(size), "int64")
            rank[over] = np.arange(len(over))
            r = rank[text_of[take]]
            place = word_at[take] - offsets[text_of[take]] + small_off[r] + r
            kind = level[take]
            succ = successors(small_off, place, kind, limit, overlap)
            starts = small_off[:-1] + np.arange(len(over))
            ends = small_off[1:] + np.arange(len(over))
            cuts = all_cuts(succ, starts, ends)
            owner = np.searchsorted(starts, cuts, "right") - 1
            is_last = cuts == ends[owner]
            begin, to = cuts[~is_last], cuts[1:][~is_last[:-1]]
            owner = owner[~is_last]
            opening = begin == starts[owner]
            from_ = np.where(opening, begin, begin - overlap)
            number = np.arange(len(begin)) - np.searchsorted(owner, owner, "left")
            at_cut = np.searchsorted(place, begin)
            hit = (at_cut < len(place)) & (place[np.minimum(at_cut, len(place) - 1)] == begin) if len(place) else np.zeros(len(begin), bool)
            cut = np.where(opening, -1, np.where(hit, kind[np.minimum(at_cut, max(len(place) - 1, 0))] if len(place) else 0, 0))
            names = np.array([*CUTS, "start"], object)[cut]
            lo, hi = from_ - starts[owner], to - starts[owner]
            flat = ids[ragged(offsets[over[owner]] + lo, hi - lo)]
            ends_ = np.concatenate([[0], np.cumsum(hi - lo)]).astype("int32")
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(over[owner])), pa.array(number.astype("int32")), pa.array(lo.astype("int32")), pa.array(hi.astype("int32")), pa.array(names, pa.string()), pa.ListArray.from_arrays(pa.array(ends_), pa.array(flat))],
                ["id", "piece", "token_from", "token_to", "cut", "ids"],
            )

    return run


def split(df: DataFrame, id: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, path: str | None = None) -> DataFrame:
    """``id, piece, token_from, token_to, cut, ids``: the pieces of each text of
    more than ``limit`` tokens; shorter, empty and null texts have none.

    Piece 0 starts with the text; each later one repeats the last ``overlap``
    tokens before its cut and holds at most ``limit`` tokens with them. ``cut``
    is the kind of boundary before the piece's new tokens. Pieces without the
    repeated tokens, one after another, are the text's tokens. A text comes out
    as often as it stands in ``df``. Texts of at most ``limit`` bytes are passed
    over: no token is shorter than a byte. Nothing is shuffled.
    """
    if not 0 <= overlap * 2 <= limit:
        raise ValueError("overlap may be half of limit at most")
    t = F.col(f"`{text}`")
    rows = df.where(F.octet_length(t) > limit).select(F.col(f"`{id}`").alias("id"), word_column(t).alias("words"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_splitter(ship(df.sparkSession, path), limit, overlap), f"id {kind}, piece int, token_from int, token_to int, cut string, ids array<int>").withColumnRenamed("id", id)
