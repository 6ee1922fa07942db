"""Problem 1: token counts of texts under an existing byte-level BPE vocabulary, and budgets of them.

Texts are split into pieces by the tokenizer's pattern inside the JVM. Per Arrow batch the distinct
pieces are stored once, as one flat array of symbols with piece bounds. Each round joins all adjacent
symbol pairs with the table of merge ranks (a binary search in its sorted keys), takes the lowest
rank of every piece and applies it; pieces without a mergeable pair have converged and leave. The
counts go back to the documents by piece code, so no text and no piece is ever shuffled.

The merge table is bounded by the vocabulary (about 300,000 pairs, 3 MB, for 50,000 tokens), so it is
sent to the workers whole.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Folder of the public vocabulary files, and the file that is used unless another is named.
VOCABULARIES = "/opt/tokenizers"
VOCABULARY = f"{VOCABULARIES}/byte_bpe_multi_50k.tiktoken"

#: Splitting pattern of the byte-level vocabularies (a fixed value that belongs to them).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

NONE = np.int64(1 << 40)
MEMO = 300_000  # pieces whose counts a worker remembers; beyond it they are simply counted again


class Merges:
    """Merge ranks as sorted arrays: symbol pair -> rank of the joined symbol."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray, first: np.ndarray):
        self.keys, self.ranks, self.first = keys, ranks, first

    @classmethod
    def load(cls, path: str) -> Merges:
        """From a file of ``base64-token rank`` lines; every way to split a token is a merge."""
        ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                token, _, rank = line.partition(b" ")
                if token:
                    ranks[base64.b64decode(token)] = int(rank)
        keys, to = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    to.append(rank)
        k, r = np.array(keys, np.int64), np.array(to, np.int64)
        order = np.argsort(k)
        return cls(k[order], r[order], np.array([ranks[bytes([i])] for i in range(256)], np.int64))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all pieces in order, and the number of symbols of each piece."""
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        sym = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), n)
        place = np.arange(len(sym))  # where each symbol began, to put converged pieces back in order
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(sym):
            rank = np.full(len(sym), NONE)
            rank[:-1] = np.where(owner[:-1] == owner[1:], self.rank(sym[:-1], sym[1:]), NONE)
            at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            low = np.minimum.reduceat(rank, at)
            size = np.diff(np.append(at, len(sym)))
            low_each = np.repeat(low, size)
            if (low == NONE).any():
                over = low_each == NONE
                done.append((sym[over], owner[over], place[over]))
                sym, owner, place, rank, low_each = (x[~over] for x in (sym, owner, place, rank, low_each))
                if not len(sym):
                    break
            hit = rank == low_each
            # of overlapping hits (aaa) every other one, from the left
            idx = np.arange(len(sym))
            start = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), idx, 0))
            hit &= (idx - start) % 2 == 0
            # hits of one piece may be applied at once unless one of them opens a lower rank
            left, right = np.append(-1, owner[:-1]) == owner, np.append(owner[2:], [-1, -1])[: len(sym)] == owner
            before = np.append(-1, sym[:-1])
            merged_before = np.append([False, False], hit[:-2])[: len(sym)]
            before = np.where(merged_before, np.append([0, 0], low_each[:-2])[: len(sym)], before)
            after = np.append(sym[2:], [-1, -1])[: len(sym)]
            h = np.flatnonzero(hit)
            opened = (left[h] & (self.rank(before[h], low_each[h]) < low_each[h])) | (right[h] & (self.rank(low_each[h], after[h]) < low_each[h]))
            if opened.any():
                risky = np.isin(owner[h], owner[h][opened])
                leading = np.append(True, owner[h][1:] != owner[h][:-1])
                hit[h[risky & ~leading]] = False
            sym = np.where(hit, low_each, sym)
            keep = ~np.append(False, hit[:-1])
            sym, owner, place = sym[keep], owner[keep], place[keep]
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(pieces), np.int64)
        sym, owner, place = (np.concatenate([d[i] for d in done]) for i in range(3))
        return sym[np.argsort(place)], np.bincount(owner, minlength=len(pieces))


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges.load(path)


_memos: dict[str, dict[str, int]] = {}


def count_pieces(table: Merges, pieces: list[str], memo: dict[str, int]) -> np.ndarray:
    """Tokens of each distinct piece."""
    new = [p for p in pieces if p not in memo]
    if new:
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = pieces
        memo.update(zip(new, table.encode([p.encode() for p in new])[1].tolist()))
    return np.fromiter((memo[p] for p in pieces), np.int64, len(pieces))


def token_counter(spark: SparkSession, path: str = VOCABULARY) -> Callable[[Column], Column]:
    """A function from a text column to its BIGINT token count.

    Defined cases: NULL and empty texts have 0 tokens; strings that spell special tokens are ordinary
    text; texts of any length are counted whole; equal texts give equal counts.
    """
    shared = spark.sparkContext.broadcast(merges(path))

    def count(lists: pa.Array) -> pa.Array:
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        words = lists.flatten().dictionary_encode()
        each = count_pieces(shared.value, words.dictionary.to_pylist(), _memos.setdefault(path, {}))
        run = np.append(0, np.cumsum(each[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)))
        end = np.cumsum(n)
        return pa.array(run[end] - run[end - n], pa.int64())

    udf = F.arrow_udf(count, "bigint")
    return lambda text: udf(F.regexp_extract_all(text, F.lit(f"(?U){PATTERN}"), F.lit(0)))
