"""Evaluation passages inside training text.

Words become template tokens: numbers, names, units and quantities turn into
typed placeholders (slots), each by its own form, whatever stands in the items.
Windows of template tokens of corpus and items are hash-joined by their templates
alone; of the corpus windows that meet a template the slots must then be filled
consistently, one value for one value. Two windows are filled consistently
exactly if equal slots stand at the same places in both, so each slot's distance
to the same value before it in the window is hashed as its filling, and fillings
of a template are joined, too: no pairs of windows are made to be compared.

* Word for word (``EXACT``): windows of words; the filling is the values of the
  slots. Letter case doesn't count, so a name is a word, in any case, that some
  item writes with a capital inside a sentence.
* Templates: windows of spans, in which a number of several words (``1.5``,
  ``2,000``, ``thirty four``) is one slot and so is a number with its unit
  (``5kg``, ``30 seconds``). A name is a word with a capital. At the start of a
  sentence that may be any word, so windows are read in several ways: without
  names, with all such words as names, and with those inside sentences only.
  A template needs ``LITERALS`` words that are no slots, as a row of mere numbers
  says nothing; word for word such rows are found like others.

A corpus window can only meet an item window if each of its words stands in
some item. So windows that hold another word are dropped before anything is
shuffled; nothing is lost by that. Equal windows of a text are one row with
their number.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covergrid.operators.salting import skew_join

WIDTH = 12
#: Number words and units, in lower case.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
UNITS = frozenset("ns us ms s sec secs second seconds min mins minute minutes h hour hours day days b kb mb gb tb kib mib gib byte bytes percent m km cm mm kg g hz khz mhz ghz".split())
#: Item words up to which their set is sent to the workers; beyond it every
#: corpus window takes part in the join, with the same result.
VOCABULARY = 500_000
#: Item windows up to which they are broadcast; beyond it the join is shuffled.
BROADCAST_WINDOWS = 100_000
#: Words of a template window that must be no slots.
LITERALS = 5
#: Ways to read a text: word for word, and as templates without names, with all
#: words with a capital as names, with those inside sentences as names.
EXACT, NO_NAMES, ALL_NAMES, INNER_NAMES = WAYS = (0, 1, 2, 3)
#: Kinds of tokens.
WORD, NUMBER, UNIT, QUANTITY, NAME = range(5)

_QUANTITY = re.compile(r"\d+(?:[.,]\d+)*(?:" + "|".join(sorted(UNITS, key=len, reverse=True)) + ")")
_FIGURES = re.compile(r"\d+(?:[.,]\d+)*")


def tokens_of(text) -> F.Column:
    """Longest runs of letters and digits, as written, each after the marks that
    end a sentence before it; digits joined by points or commas are one."""
    run = r"(?:\p{N}+(?:[.,]\p{N}+)+[\p{L}\p{N}]*|[\p{L}\p{N}]+)"
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?:[.!?:;\n\"(\[][\s\p{P}\p{S}]*)?" + run), F.lit(0))


def _bare(marked: str) -> tuple[str, bool]:
    """A token without the marks before it, and whether there are any."""
    k = next(i for i, c in enumerate(marked) if unicodedata.category(c)[0] in "LN")
    return marked[k:], k > 0


def kind_of(token: str) -> int:
    """Kind of a token in lower case, names apart."""
    if token in NUMBER_WORDS or token.isnumeric() or _FIGURES.fullmatch(token):
        return NUMBER
    if token in UNITS:
        return UNIT
    return QUANTITY if _QUANTITY.fullmatch(token) else WORD


def _words(token: str) -> list[str]:
    """The words of a token in lower case."""
    return re.split("[.,]", token) if "." in token or "," in token else [token]


def _hash(texts: list[str], seed: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(t.encode(), seed=seed) for t in texts], "uint64")


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _blend(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A hash of pairs of 64-bit numbers."""
    with np.errstate(over="ignore"):
        h = (x ^ (y * _ODD + (x << np.uint64(6)) + (x >> np.uint64(2)))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def _ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


class _Sequence:
    """Tokens of a batch of texts, one after another: ``owner`` (text),
    ``literal`` (hash of the token, 0 for slots), ``value`` (hash of the token,
    slots too), ``kind``, and whether the token is ``known`` (slots are)."""

    def __init__(self, owner, literal, value, kind, known):
        self.owner, self.literal, self.value, self.kind, self.known = owner, literal, value, kind, known

    def windows(self, literals: int) -> np.ndarray:
        """Starts of windows of one text, of known tokens, and with so many
        words that are no slots."""
        n = len(self.owner)
        if n < WIDTH:
            return np.zeros(0, "int64")
        upto = lambda x: np.concatenate([[0], np.cumsum(x)])
        bad, plain = upto(~self.known), upto(self.kind == WORD)
        p = np.arange(n - WIDTH + 1)
        ok = (bad[WIDTH:] == bad[:-WIDTH]) & (self.owner[WIDTH - 1 :] == self.owner[: n - WIDTH + 1]) & (plain[WIDTH:] - plain[:-WIDTH] >= literals)
        return p[ok]

    def before(self) -> np.ndarray:
        """Distance to the same slot value before in the text; 0 if there is none."""
        out = np.zeros(len(self.owner), "int64")
        slot = np.flatnonzero(self.kind != WORD)
        if len(slot):
            order = slot[np.lexsort((slot, self.value[slot], self.owner[slot]))]
            same = (self.owner[order[1:]] == self.owner[order[:-1]]) & (self.value[order[1:]] == self.value[order[:-1]])
            out[order[1:][same]] = (order[1:] - order[:-1])[same]
        return out

    def keys(self, p: np.ndarray, exact: bool) -> np.ndarray:
        """Three hashes of each window: of its template, of its filling, which is
        its slot values (``exact``) or the places of equal slots, and of both."""
        at = p[:, None] + np.arange(WIDTH)
        shape = _blend(self.literal[at], self.kind[at].astype("uint64"))
        if exact:
            fill = np.where(self.kind[at] != WORD, self.value[at], np.uint64(0))
        else:
            gap = self.before()[at]
            fill = np.where(gap <= np.arange(WIDTH), gap, 0).astype("uint64")
        cells = (shape, fill, _blend(shape, fill))
        out = np.zeros((3, len(p)), "uint64")
        for k in range(WIDTH):
            for i, cell in enumerate(cells):
                out[i] = _blend(out[i] + np.uint64(i + 1), cell[:, k])
        return out.view("int64")


def _exact(at: np.ndarray, owner: np.ndarray, tokens: list[str], known: frozenset[str] | None, names: frozenset[str]) -> _Sequence:
    """The words of the tokens, each for itself."""
    words = [_words(t) for t in tokens]
    count = np.array([len(w) for w in words] or [0], "int64")
    first = np.cumsum(count) - count
    flat = [w for ws in words for w in ws]
    value, kind = _hash(flat, 0), np.array([NAME if w in names else kind_of(w) for w in flat], "int8")
    inside = np.array([known is None or w in known for w in flat], bool)
    place = _ragged(first[at], count[at])
    kind = kind[place]
    return _Sequence(np.repeat(owner, count[at]), np.where(kind == WORD, value[place], np.uint64(0)), value[place], kind, inside[place])


def _spans(at: np.ndarray, owner: np.ndarray, tokens: list[str], name: np.ndarray, known: frozenset[str] | None) -> _Sequence:
    """Tokens with the words of one number, and numbers and their units, joined.
    ``name``: which tokens are names if they are plain words."""
    kinds = np.array([kind_of(t) for t in tokens], "int8")
    verbal = np.array([t in NUMBER_WORDS for t in tokens], bool)[at]
    kind = np.where(name & (kinds[at] == WORD), NAME, kinds[at])
    value = _hash(tokens, 0)[at]
    inside = np.array([known is None or t in known for t in tokens], bool)[at] | (kind != WORD)
    n = len(at)
    joins = np.zeros(n, bool)
    if n > 1:
        near = owner[1:] == owner[:-1]
        joins[1:] = near & ((verbal[1:] & verbal[:-1]) | ((kind[1:] == UNIT) & (kind[:-1] == NUMBER)))
    starts = np.flatnonzero(~joins)
    if not n:
        return _Sequence(owner, value, value, kind, inside)
    last = np.append(starts[1:], n) - 1
    with np.errstate(over="ignore"):
        whole = np.add.reduceat(value * (np.arange(n) - np.repeat(starts, last - starts + 1) + 1).astype("uint64"), starts)
    span = np.where((last > starts) & (kind[last] == UNIT), QUANTITY, kind[starts])
    return _Sequence(owner[starts], np.where(span == WORD, value[starts], np.uint64(0)), whole, span, inside[starts])


def _windows(known: frozenset[str] | None, names: frozenset[str], ways: tuple[int, ...]):
    """``id, way, key, fill, check, n``: the windows of each text in each way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            off = lists.offsets.to_numpy().astype("int64")
            coded = lists.values.slice(off[0], off[-1] - off[0]).dictionary_encode()
            off = off - off[0]
            marked = [_bare(w) for w in coded.dictionary.to_pylist()]
            tokens = [w.lower() for w, _ in marked]
            at = coded.indices.to_numpy().astype("int64")
            owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
            capital = np.array([w[0].isupper() for w, _ in marked], bool)[at]
            opens = np.array([o for _, o in marked], bool)[at]
            opens[off[:-1][off[:-1] < off[1:]]] = True
            for way in ways:
                if way == EXACT:
                    s = _exact(at, owner, tokens, known, names)
                else:
                    name = capital & (way != NO_NAMES) & ((way == ALL_NAMES) | ~opens)
                    s = _spans(at, owner, tokens, name, known)
                p = s.windows(0 if way == EXACT else LITERALS)
                if not len(p):
                    continue
                rows, n = np.unique(np.stack([s.owner[p], *s.keys(p, way == EXACT)]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[0])), pa.array(np.full(len(n), way, "int32")), *[pa.array(x) for x in rows[1:]], pa.array(n)], ["id", "way", "key", "fill", "check", "n"])

    return run


class LeakFinder:
    """Corpus documents that hold passages of evaluation items.

    Texts that are null, empty or shorter than ``WIDTH`` words leak nothing and
    nothing leaks from such items. Equal items are reported each; a document
    that comes several times under one id comes out once. Letter case and all
    that stands between words don't count. Texts are processed whole. Only the
    named columns are read.
    """

    def __init__(self, items: DataFrame, item_id: str, item_text: str):
        tokens = items.select(F.col(f"`{item_id}`").alias("id"), tokens_of(F.col(f"`{item_text}`")).alias("tokens"))
        self.id, self.known = item_id, None
        total = tokens.agg(F.sum(F.size("tokens"))).first()[0] or 0
        each = tokens.select(F.posexplode("tokens").alias("at", "token")).select("token", ((F.col("at") > 0) & F.col("token").rlike(r"^\p{Lu}")).alias("name")).distinct()
        found = (each if total <= VOCABULARY else each.where("name")).collect()
        self.names = frozenset(w for r in found if r.name and kind_of(w := r.token.lower()) == WORD)
        if total <= VOCABULARY:  # bounded: no more distinct tokens than that
            known = {_bare(r.token)[0].lower() for r in found}
            self.known = frozenset(known | {w for t in known for w in _words(t)})
        self.windows = self._made(tokens, WAYS).select(F.col("id").alias("item"), "way", "key", "fill", "check").distinct()
        self.small = total <= BROADCAST_WINDOWS  # about as many windows, in each way

    def _made(self, tokens: DataFrame, ways: tuple[int, ...]) -> DataFrame:
        kind = tokens.schema["id"].dataType.simpleString()
        return tokens.mapInArrow(_windows(self.known, self.names, ways), f"id {kind}, way int, key bigint, fill bigint, check bigint, n bigint")

    def _join(self, many: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
        return many.join(F.broadcast(few), on) if self.small else skew_join(many, few, on, F.col("doc"))

    def candidates(self, docs: DataFrame, doc_id: str, doc_text: str, ways: tuple[int, ...] = WAYS) -> DataFrame:
        """``way, key, doc, fill, check, n``: windows of each document with the
        template of an item, however its slots are filled."""
        tokens = docs.select(F.col(f"`{doc_id}`").alias("id"), tokens_of(F.col(f"`{doc_text}`")).alias("tokens")).where(F.size("tokens") > 0)
        templates = self.windows.where(F.col("way").isin(*ways)).select("way", "key").distinct()
        return self._join(self._made(tokens, ways).withColumnRenamed("id", "doc"), templates, ["way", "key"])

    def matches(self, docs: DataFrame, doc_id: str, doc_text: str, ways: tuple[int, ...] = WAYS) -> DataFrame:
        """``doc, item, way, n``: windows of each document that an item has, too:
        those with its template, of which the slots are filled consistently."""
        filled = self.windows.where(F.col("way").isin(*ways))
        return self._join(self.candidates(docs, doc_id, doc_text, ways), filled, ["way", "key", "fill", "check"]).select("doc", "item", "way", "n")

    def leaks(self, docs: DataFrame, doc_id: str, doc_text: str) -> DataFrame:
        """Each document and item that share at least WIDTH words in a row."""
        return self.matches(docs, doc_id, doc_text, (EXACT,)).select("doc", "item").distinct().toDF(doc_id, self.id)

    def report(self, docs: DataFrame, doc_id: str, doc_text: str) -> DataFrame:
        """Each document and item with a common template: ``n_windows`` of the
        document that fit it (in the way of reading that finds most), and
        ``n_exact`` that hold the item's own words."""
        each = self.matches(docs, doc_id, doc_text).groupBy("doc", "item", "way").agg(F.sum("n").alias("n"))
        most = lambda exact: F.coalesce(F.max(F.when((F.col("way") == EXACT) == exact, F.col("n"))), F.lit(0))
        return each.groupBy("doc", "item").agg(most(False).alias("n_windows"), most(True).alias("n_exact")).withColumnRenamed("doc", doc_id).withColumnRenamed("item", self.id)
