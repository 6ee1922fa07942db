"""Problem 8: passages of evaluation items inside a corpus, by pigeonhole edit matching.

Every window of ``window`` consecutive words of an item is a test passage with an error budget of
``budget`` word edits. Split into ``budget + 1`` pieces, at least one piece of a passage within the
budget occurs exactly. The pieces of all windows (all word runs of piece length in the items) are
looked up in each document; around every exact hit the passages that contain the piece are verified
with Myers' bit-parallel distance, one bit a word, run over all candidates of a batch at once.

The items are the stated query set: they go to the workers in blocks of ``BLOCK_CHARS`` characters,
one pass over the corpus per block, so what is broadcast is bounded whatever their number. The index of
a block is built once and loaded once a worker; with several blocks each one's matches are written and
its index dropped before the next. Documents never move: the corpus is read once per block and only
matches come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept
from .words import letter_words

WINDOW = 12
BUDGET = 1
BLOCK_CHARS = 8_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _grams(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of n word ids; shorter input gives nothing."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for j in range(n):
        h = (h ^ ids[j : j + m].astype(np.uint64)) * _ODD
        h ^= h >> np.uint64(29)
    return h


def match_masks(pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted keys of (row, symbol) of all patterns, the bits where the row holds the symbol, the factor of a row."""
    rows, m = pattern.shape
    base = int(pattern.max(initial=0)) + 2
    key = (np.arange(rows)[:, None] * base + pattern + 1).ravel()
    order = np.argsort(key, kind="stable")
    key, bit = key[order], np.tile(np.left_shift(np.int64(1), np.arange(m, dtype=np.int64)), rows)[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[at], np.bitwise_or.reduceat(bit, at) if len(at) else bit, base


def myers(pattern: np.ndarray, text: np.ndarray, which: np.ndarray | None = None) -> np.ndarray:
    """Least edit distance of each row of ``text``'s pattern to any substring of that row.

    ``which`` is the pattern's number of each row of ``text`` (the same row, unless told otherwise), so the
    match mask of every symbol is made once a pattern. Bit-parallel over the pattern (at most 62 symbols),
    vectorised over rows. Negative symbols match nothing.
    """
    rows, m = len(text), pattern.shape[1]
    full, top = np.int64((1 << m) - 1), np.int64(1 << (m - 1))
    pv, mv = np.full(rows, full), np.zeros(rows, np.int64)
    score = np.full(rows, m, np.int64)
    best = score.copy()
    keys, masks, base = match_masks(pattern)
    which = np.arange(rows) if which is None else which
    wanted = np.where((text >= 0) & (text < base - 1), which[:, None] * base + text + 1, -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    every = np.where(keys[at] == wanted, masks[at], 0) if len(keys) else np.zeros(text.shape, np.int64)
    for j in range(text.shape[1]):
        eq = every[:, j]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        score += ((ph & top) != 0).astype(np.int64) - ((mh & top) != 0)
        ph, mh = ph << 1, mh << 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
        best = np.minimum(best, score)
    return best


class Passages:
    """The items of a block as word ids with the sorted hashes of all their pieces."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW, budget: int = BUDGET):
        self.window, self.budget, self.piece = window, budget, window // (budget + 1)
        if self.piece < 2 or window > 60:
            raise ValueError("window must have 2 words a piece and at most 60 words")
        self.vocab: dict[str, int] = {}
        ids, item, place, length = [], [], [], []
        for key, text in items:
            w = [self.vocab.setdefault(x, len(self.vocab)) for x in letter_words(text or "")]
            if len(w) < window:
                continue
            place.extend(range(len(w)))
            ids.extend(w)
            item.extend([key] * len(w))
            length.extend([len(w)] * len(w))
        self.ids, self.item = np.array(ids, np.int64), np.array(item, np.int64)
        self.place, self.length = np.array(place, np.int64), np.array(length, np.int64)
        h = _grams(self.ids, self.piece)
        inside = np.flatnonzero(self.place[: len(h)] + self.piece <= self.length[: len(h)])
        order = inside[np.argsort(h[inside], kind="stable")]
        self.hash, self.at = h[order], order
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hash & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row of text, item, least edits of any passage, longest run of words in common on a hit."""
        none = np.zeros(0, np.int64)
        if not len(self.hash):
            return none, none, none, none
        get, pad = self.vocab.get, self.window + self.budget
        ids: list[int] = [-1] * pad
        starts = []
        for t in texts:
            starts.append(len(ids))
            if t:
                ids += [get(x, -1) for x in letter_words(t)]
            ids += [-1] * pad  # no run crosses two texts
        w = np.array(ids, np.int64)
        n = self.piece
        known = np.append(0, np.cumsum(w >= 0))
        pos = np.flatnonzero(known[n:] - known[:-n] == n)
        h = _grams(w, n)[pos]
        ok = self.maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)]
        pos, h = pos[ok], h[ok]
        lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        many = hi - lo
        pos = np.repeat(pos, many)
        here = self.at[np.repeat(lo, many) + np.arange(len(pos)) - np.repeat(np.cumsum(many) - many, many)]
        same = np.ones(len(pos), bool)
        for j in range(n):  # the hash only proposes
            same &= w[pos + j] == self.ids[here + j]
        pos, here = pos[same], here[same]
        if not len(pos):
            return none, none, none, none
        row = np.searchsorted(np.array(starts), pos, "right") - 1
        # each piece stands at one of budget + 1 places of a passage
        edits = np.full(len(pos), self.window, np.int64)
        for k in range(self.budget + 1):
            first = here - k * n
            fit = (self.place[here] >= k * n) & (self.place[here] - k * n + self.window <= self.length[here])
            at = np.flatnonzero(fit)
            for part in np.array_split(at, max(1, len(at) // 50_000)):
                start, which = np.unique(first[part], return_inverse=True)
                p = self.ids[start[:, None] + np.arange(self.window)]
                begin = pos[part] - k * n - self.budget
                span = np.clip(begin[:, None] + np.arange(self.window + 2 * self.budget), 0, len(w) - 1)
                edits[part] = np.minimum(edits[part], myers(p, w[span], which))
        item = self.item[here]
        # exact check: hits that follow each other on one diagonal are one run of equal words
        order = np.lexsort((pos, here - pos, row))
        p, d, r = pos[order], (here - pos)[order], row[order]
        new = np.append(True, (p[1:] != p[:-1] + 1) | (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (item[order][1:] != item[order][:-1]))
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(p)))
        run = np.empty(len(p), np.int64)
        run[order] = np.repeat(size + n - 1, size)
        good = edits <= self.budget
        row, item, edits, run = row[good], item[good], edits[good], run[good]
        if not len(row):
            return none, none, none, none
        pair, back = np.unique(np.stack([row, item], 1), axis=0, return_inverse=True)
        back = back.reshape(-1)
        least, longest = np.full(len(pair), self.window, np.int64), np.zeros(len(pair), np.int64)
        np.minimum.at(least, back, edits)
        np.maximum.at(longest, back, run)
        return pair[:, 0], pair[:, 1], least, longest


def find_leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, budget: int = BUDGET, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Documents that contain a passage of an item: doc key, item key, ``edits``, ``run``.

    ``edits`` is the least number of word edits of any passage of ``window`` words, at most ``budget``;
    ``run`` the longest run of equal words that such passages lie in.

    Defined cases: NULL, empty and wordless texts match nothing; items of fewer than ``window`` words
    have no passage; texts are taken whole; repeated documents and items each give their rows, equal
    keys one; empty tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    small = items.select(F.col(f"`{item_key}`").cast("bigint").alias("i"), F.col(f"`{item_text}`").alias("t")).where("t IS NOT NULL AND i IS NOT NULL")
    chars = small.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    src = docs.select(F.col(f"`{doc_key}`").alias("d"), F.col(f"`{text}`").alias("x"))
    schema = f"d {src.schema['d'].dataType.simpleString()}, i bigint, edits bigint, run bigint"
    out = None
    for b in range(blocks):
        block = small.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b) if blocks > 1 else small
        shared = spark.sparkContext.broadcast(Passages([(r.i, r.t) for r in block.orderBy("i").toLocalIterator()], window, budget))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, len(whole), 1000):
                    batch = whole.slice(at, 1000)
                    row, item, edits, longest = shared.value.find(batch.column(1).to_pylist())
                    if len(row):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *[pa.array(x, pa.int64()) for x in (item, edits, longest)]], names=["d", "i", "edits", "run"])

        found = src.mapInArrow(run, schema)
        if blocks > 1:
            found = kept(found)
            shared.unpersist()
        out = found if out is None else out.unionByName(found)
    best = out.groupBy("d", "i").agg(F.min("edits").alias("edits"), F.max("run").alias("run"))
    return best.select(F.col("d").alias(doc_key), F.col("i").alias(item_key), "edits", "run")
