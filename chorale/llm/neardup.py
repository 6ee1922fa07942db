"""Problem 4: near-duplicate texts, by tiled exact comparison of bit vectors.

A text is the set of its runs of ``shingle`` words. Texts with equal sets are one class from the
start and only a representative goes on. Each set is folded into a bit vector by parity: bit
``hash mod BITS`` is flipped for every element. The exclusive-or of two vectors is then the folded
symmetric difference of the sets, so its bit count never exceeds the size of that difference: a pair
whose count lies beyond the radius that the threshold allows can't be similar, and no similar pair is
lost. Pairs within the radius are verified on their texts.

Comparing all with all would be quadratic, so vectors meet in blocks that lose nothing: if two sets
reach the threshold t, the first ``n - ceil(t * n) + 1`` elements of both, in one order common to
all, share an element. The order is by frequency, rare first; elements of one set only are in no block. A
block holds the sets with one element in common and the element's rank in each. Of the first element
that two sets share, ``n - rank`` bounds what they have in common, and with that the other's size
(``reach``): sets that can't reach each other needn't meet in this block, because similar ones do in
that of their first element. Inside a block, vectors are compared tile against tile with numpy's
exclusive-or and bit count, and a tile pair is skipped when population counts, sizes or reaches differ
beyond the radius. Elements that are more frequent than ``hot`` are salted: their sets are spread over k
tiles and each pair of tiles is a block of its own.

Frequencies are counted in a table of cells (``CELLS`` for every element, so few share one; whatever they
share, any common order is exact) that grows with the data and is spread over tasks: packs of sets send
the cells they hold, each once with a count, to the task of the cell's range, and get the totals back in
the same order. Nothing that grows with the data is broadcast or sent to the driver.

What travels per set is two or three bytes per element for the counts, its text to the counts of its pack,
and one vector per bucket of blocks that it takes part in, packed in binary columns. The pairs found come
out, never the pairs compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bucket_keys, cut, kept

BITS = 512
TILE = 512
#: Cells of the table of frequencies for every element of a set, and (as a power of 2) in one task's range.
CELLS, RANGE_BITS = 8, 22
#: Sets and characters of text in a pack of sets, on average.
PACK_SETS, PACK_CHARS = 2000, 8_000_000
#: Sets per block beyond which an element's block is split into pairs of tiles, and copies beyond which a class is.
HOT = 20_000
#: Elements per bucket of blocks that one task takes at once, on average.
BUCKET = 250_000
#: Tasks that the buckets are dealt out to at most.
MAX_TASKS = 20_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_NO_WORD = r"[^\p{L}\p{N} ]+"  # but for spaces, which are there to split at


def word_lists(texts: pa.Array) -> pa.Array:
    """Runs of letters or digits of each text, case as it is; the columnar library splits whole batches."""
    spaced = pc.utf8_trim(pc.replace_substring_regex(texts, _NO_WORD, " "), " ")
    return pc.ascii_split_whitespace(spaced)


@lru_cache(maxsize=1 << 16)
def word_hash(word: str) -> int:
    """Equal for words that differ in case only."""
    return xxhash.xxh64_intdigest(word.casefold().replace("\u0307", ""))


def shingles(texts: pa.Array | list[str | None], k: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and element of every set, sorted by both. Texts below ``least_words`` have none.

    An element is a 53-bit hash of k words, so at most 2,048 texts can be sorted by one key.
    """
    texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
    rows = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(texts) > 2048:
        parts = [shingles(texts.slice(a, 2048), k, least_words) for a in range(0, len(texts), 2048)]
        return np.concatenate([r + 2048 * i for i, (r, _) in enumerate(parts)]), np.concatenate([g for _, g in parts])
    lists = word_lists(texts)
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    m = len(flat) - k + 1
    if m <= 0:
        return rows
    h = np.fromiter(map(word_hash, flat.dictionary.to_pylist()), np.uint64, len(flat.dictionary))[flat.indices.to_numpy()]
    g = np.zeros(m, np.uint64)
    for j in range(k):
        g = (g ^ h[j : j + m]) * _ODD
        g ^= g >> np.uint64(31)
    row = np.repeat(np.arange(len(texts)), n)
    inside = (row[:m] == row[k - 1 :]) & (n >= max(least_words, k))[row[:m]]
    key = np.sort(row[:m][inside].astype(np.uint64) << np.uint64(53) | g[inside] >> np.uint64(11))
    if not len(key):
        return rows
    key = key[np.append(True, key[1:] != key[:-1])]
    return (key >> np.uint64(53)).astype(np.int64), key & np.uint64((1 << 53) - 1)


def fold(row: np.ndarray, g: np.ndarray, rows: int) -> np.ndarray:
    """Parity bit vectors, ``BITS // 64`` uint64 a row."""
    bits = np.bincount(row * BITS + ((g >> np.uint64(7)) % np.uint64(BITS)).astype(np.int64), minlength=rows * BITS) & 1
    return np.packbits(bits.astype(np.uint8).reshape(rows, BITS), axis=1).view(np.uint64)


def _slices(batches: Iterator[pa.RecordBatch], n: int = 2000) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, len(b), n):
            yield b.slice(at, n)


def distinct_sets(df: DataFrame, key: str, text: str, k: int, least_words: int) -> DataFrame:
    """Rows (id, sig, n, text) of all texts with a set; the text only where it is new to its task."""
    src = df.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in _slices(batches):
            row, g = shingles(b.column(1), k, least_words)
            if not len(row):
                continue
            at = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            end = np.append(at[1:], len(row))
            sigs = [xxhash.xxh3_128_digest(g[a:z].tobytes()) for a, z in zip(at, end)]
            known = []
            for s in sigs:
                known.append(s in seen)
                if len(seen) < 1_000_000:  # beyond it texts are sent again, which changes nothing
                    seen.add(s)
            pick = pa.array(row[at])
            text_or_null = b.column(1).take(pa.array(row[at], mask=np.array(known)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pick), pa.array(sigs, pa.binary()), pa.array(end - at, pa.int64()), text_or_null], names=["id", "sig", "n", "text"])

    return src.mapInArrow(run, "id bigint, sig binary, n bigint, text string")


def _cells(texts: pa.Array, k: int, least_words: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number and element of every set, the distinct cells in order, each element's cell among them, and their counts."""
    row, g = shingles(texts, k, least_words)
    cell, back, count = np.unique(g & np.uint64((1 << bits) - 1), return_inverse=True, return_counts=True)
    return row, g, cell, back.reshape(-1), count


def frequencies(packed: DataFrame, k: int, least_words: int, bits: int, range_bits: int = RANGE_BITS) -> DataFrame:
    """For each pack and range of cells the totals of the pack's cells, in the order of the cells: pack, part, totals.

    ``packed`` has the columns pack, id, text. Totals are the upper halves of 32-bit floats, which keep
    their order.
    """
    low = min(bits, range_bits)

    def send(t: pa.Table) -> pa.Table:
        _, _, cell, _, count = _cells(t.column("text").combine_chunks(), k, least_words, bits)
        part = (cell >> np.uint64(low)).astype(np.int64)
        rest = (cell & np.uint64((1 << low) - 1)).astype(np.int64)
        at = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else part
        steps, counts = [], []
        for a, z in zip(at, np.append(at[1:], len(part))):
            step = np.diff(rest[a:z], prepend=0)  # cells ascend, so steps are short
            steps.append(step.astype(np.uint16 if step.max() < 1 << 16 else np.uint32).tobytes())
            counts.append(count[a:z].astype(np.uint32 if count[a:z].max() > 255 else np.uint8).tobytes())
        pack = t.column("pack")[0].as_py()
        return pa.table({"pack": pa.array([pack] * len(at), pa.int64()), "part": pa.array(part[at]), "n": pa.array(np.diff(np.append(at, len(part)))), "steps": pa.array(steps, pa.binary()), "counts": pa.array(counts, pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(1 << low, np.int64)
        cells = []
        for n, steps, counts in zip(*(t.column(c).to_pylist() for c in ("n", "steps", "counts"))):
            cell = np.cumsum(np.frombuffer(steps, f"<u{len(steps) // n}").astype(np.int64))
            total[cell] += np.frombuffer(counts, f"<u{len(counts) // n}")
            cells.append(cell)
        half = (total.astype(np.float32).view(np.uint32) >> np.uint32(16)).astype(np.uint16)
        return pa.table({"pack": t.column("pack"), "part": t.column("part"), "totals": pa.array([half[c].tobytes() for c in cells], pa.binary())})

    sent = packed.groupBy("pack").applyInArrow(send, "pack bigint, part bigint, n bigint, steps binary, counts binary")
    return sent.groupBy("part").applyInArrow(add, "pack bigint, part bigint, totals binary")


def _within(sa: np.ndarray, sb: np.ndarray, num: int, den: int) -> np.ndarray:
    """The largest symmetric difference of two sets with similarity >= num/den (sizes broadcast)."""
    return ((den - num) * (sa + sb)) // (den + num)


def reach(n: np.ndarray, rank: np.ndarray, num: int, den: int) -> np.ndarray:
    """The largest size of a set that may be similar to one of size n, if the first element they share has this rank (from 0) in the latter.

    At most ``n - rank`` elements are common, and similarity >= num/den needs ``num * (n + size) <= (num + den) * common``.
    """
    return (n - rank) * (den + num) // num - n


def compare_lists(doc: np.ndarray, far: np.ndarray, start: np.ndarray, vec: np.ndarray, size: np.ndarray, num: int, den: int) -> np.ndarray:
    """Pairs (n, 2) of documents within the radius in any list; lists are ascending, documents sorted by size.

    ``far`` is how far each entry of a list reaches. Pairs that can't reach each other are not looked at.
    """
    found = []
    ones = np.bitwise_count(vec).sum(1).astype(np.int64)
    length = np.diff(np.append(start, len(doc)))
    # short lists: all their pairs side by side
    short = np.repeat(length <= 64, length)
    pos = np.flatnonzero(short & (far >= size[doc]))  # those that may be the smaller one
    span = int(size.max(initial=0)) + 1
    base = np.repeat(np.arange(len(length)) * span, length)
    many = np.searchsorted(base + size[doc], base[pos] + np.minimum(far[pos], span - 1), "right") - pos - 1
    pos, many = pos[many > 0], many[many > 0]
    cuts = np.searchsorted(np.cumsum(many), np.arange(0, many.sum() + 1, 200_000)) if len(pos) else []
    for a, z in zip(cuts, np.append(cuts[1:], len(pos))):
        m = many[a:z]
        p = np.repeat(pos[a:z], m)
        q = p + 1 + np.arange(len(p)) - np.repeat(np.cumsum(m) - m, m)
        i, j = doc[p], doc[q]
        radius = _within(size[i], size[j], num, den)
        ok = (far[q] >= size[i]) & (np.abs(ones[i] - ones[j]) <= radius)  # population counts don't differ beyond the radius
        i, j, radius = i[ok], j[ok], radius[ok]
        half = vec.shape[1] // 2
        d = np.bitwise_count(vec[i, :half] ^ vec[j, :half]).sum(1)
        ok = d <= radius
        i, j, radius, d = i[ok], j[ok], radius[ok], d[ok]
        ok = d + np.bitwise_count(vec[i, half:] ^ vec[j, half:]).sum(1) <= radius
        found.append(np.unique(i[ok].astype(np.int64) << 32 | j[ok]))
    # long lists: tile against tile
    for s, n in zip(start[length > 64], length[length > 64]):
        d, f = doc[s : s + n], far[s : s + n]
        found.append(compare_tiles(d, f, d, f, vec, ones, size, num, den))
    pair = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return np.stack([pair >> 32, pair & 0xFFFFFFFF], 1)


def compare_tiles(da: np.ndarray, fa: np.ndarray, db: np.ndarray, fb: np.ndarray, vec: np.ndarray, ones: np.ndarray, size: np.ndarray, num: int, den: int) -> np.ndarray:
    """Packed pairs within the radius of a document of the first list and one of the second that isn't smaller.

    Lists are ascending, documents sorted by size; ``fa`` and ``fb`` are how far their entries reach.
    """
    found = [np.zeros(0, np.int64)]
    small = fa >= size[da]  # the others reach smaller ones only
    da, fa, sb = da[small], fa[small], size[db]
    for a in range(0, len(da), TILE):
        x = da[a : a + TILE]
        vx, sx, px = vec[x].T.copy(), size[x].astype(np.int64), ones[x]
        lo, hi = np.searchsorted(sb, sx[0]), np.searchsorted(sb, fa[a : a + TILE].max(), "right")
        near = db[lo:hi][fb[lo:hi] >= sx[0]]
        for b in range(0, len(near), TILE):
            y = near[b : b + TILE]
            sy, py = size[y].astype(np.int64), ones[y]
            radius = _within(sx.max(), sy.max(), num, den)
            if py.min() - px.max() > radius or px.min() - py.max() > radius:  # population counts differ beyond the radius
                continue
            vy = vec[y].T.copy()
            d = np.zeros((len(x), len(y)), np.uint16)
            for w in range(vec.shape[1]):
                d += np.bitwise_count(vx[w][:, None] ^ vy[w][None, :])
            i, j = np.nonzero(d <= _within(sx[:, None], sy[None, :], num, den))
            i, j = x[i].astype(np.int64), y[j].astype(np.int64)
            i, j = i[i != j], j[i != j]
            found.append(np.minimum(i, j) << 32 | np.maximum(i, j))
    return np.unique(np.concatenate(found))


class Totals(NamedTuple):
    """Sums over all sets: how many, their elements, the elements of their prefixes, characters of text."""

    sets: int
    elements: int
    prefixes: int
    chars: int


def candidate_pairs(reps: DataFrame, totals: Totals, k: int, least_words: int, num: int, den: int, hot: int = HOT, range_bits: int = RANGE_BITS, bucket: int = BUCKET) -> DataFrame:
    """Distinct pairs (a < b) of representatives (id, text) whose bit vectors lie within the radius.

    ``totals`` are sums over all of them, by which packs, the table of frequencies and the buckets of
    blocks are sized.
    """
    bits = min(53, max(10, (totals.elements * CELLS).bit_length()))
    buckets = max(12, -(-totals.prefixes // bucket))
    tasks = min(buckets, MAX_TASKS)
    places = np.array(bucket_keys(reps.sparkSession, tasks), np.int64)  # every task has as many buckets
    packs = max(1, -(-totals.sets // PACK_SETS), -(-totals.chars // PACK_CHARS))
    packed = reps.select(F.pmod(F.xxhash64("id"), F.lit(packs)).alias("pack"), "id", "text")

    def spread(t: pa.Table, counted: pa.Table) -> pa.Table:
        row, g, _, back, _ = _cells(t.column("text").combine_chunks(), k, least_words, bits)
        order = np.argsort(counted.column("part").to_numpy())
        half = b"".join(x for x in counted.column("totals").take(pa.array(order)).to_pylist())
        f = (np.frombuffer(half, np.uint16).astype(np.uint32) << np.uint32(16)).view(np.float32).astype(np.int64)[back]
        vec = fold(row, g, len(t))
        size = np.bincount(row, minlength=len(t))
        order = np.lexsort((g, f, row))
        row, g, f = row[order], g[order], f[order]
        n = size[row]
        rank = np.arange(len(row)) - (np.cumsum(size) - size)[row]
        keep = (rank < n - (num * n + den - 1) // den + 1) & (f > 1)
        row, g, f, rank = row[keep], g[keep], f[keep], rank[keep]
        ids = t.column("id").to_numpy()
        is_hot = f > hot
        key = (g % np.uint64(buckets)).astype(np.int64)
        tile = np.zeros(len(row), np.int64)
        if is_hot.any():
            parts = -(-f[is_hot] // hot)
            r, e = np.repeat(row[is_hot], parts), np.repeat(g[is_hot], parts)
            own = (ids[r].astype(np.uint64) * _ODD >> np.uint64(40)).astype(np.int64) % np.repeat(parts, parts)
            other = np.arange(len(r)) - np.repeat(np.cumsum(parts) - parts, parts)
            lo, hi = np.minimum(own, other), np.maximum(own, other)
            block = ((e ^ (lo * 65537 + hi + 1).astype(np.uint64)) * _ODD >> np.uint64(2)).astype(np.int64) | np.int64(1 << 61)
            # a block of two tiles: 1 and 2 tell them apart; of one tile: 3
            side = np.where(lo == hi, 3, np.where(own == lo, 1, 2))
            row, g, rank = np.append(row[~is_hot], r), np.append(g[~is_hot], e), np.append(rank[~is_hot], np.repeat(rank[is_hot], parts))
            key, tile = np.append(key[~is_hot], block), np.append(tile[~is_hot], side)
        order = np.argsort(key, kind="stable")
        row, g, rank, key, tile = row[order], (g >> np.uint64(21)).astype(np.uint32)[order], rank[order], key[order], tile[order]
        cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        keys, cols = [], [[], [], [], [], [], [], []]
        for a, z in zip(cuts, np.append(cuts[1:], len(key))):
            docs, local = np.unique(row[a:z], return_inverse=True)
            keys.append(int(key[a]))
            for c, x in zip(cols, (ids[docs], size[docs].astype(np.int32), vec[docs], g[a:z], local.astype(np.uint16), tile[a:z].astype(np.uint8), rank[a:z].astype(np.uint16 if rank[a:z].max() < 1 << 16 else np.uint32))):
                c.append(np.ascontiguousarray(x).tobytes())
        place = places[np.array(keys, np.int64) % tasks]
        return pa.table([pa.array(place), pa.array(keys, pa.int64()), *[pa.array(c, pa.binary()) for c in cols]], names=["place", "key", "ids", "sizes", "vecs", "elements", "locals", "tiles", "ranks"])

    def compare(t: pa.Table) -> pa.Table:
        col = {c: t.column(c).to_pylist() for c in ("ids", "sizes", "vecs", "elements", "locals", "tiles", "ranks")}
        base = np.cumsum([0, *[len(x) // 8 for x in col["ids"]]])
        ids, size = np.frombuffer(b"".join(col["ids"]), np.int64), np.frombuffer(b"".join(col["sizes"]), np.int32)
        vec = np.frombuffer(b"".join(col["vecs"]), np.uint64).reshape(len(ids), -1)
        g, tile = np.frombuffer(b"".join(col["elements"]), np.uint32), np.frombuffer(b"".join(col["tiles"]), np.uint8)
        rank = np.concatenate([np.frombuffer(x, f"<u{len(x) // len(n)}").astype(np.int64) for x, n in zip(col["ranks"], col["tiles"])])
        doc = np.concatenate([np.frombuffer(x, np.uint16).astype(np.int64) + o for x, o in zip(col["locals"], base)])
        order = np.argsort(size, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        ids, size, vec, doc = ids[order], size[order].astype(np.int64), vec[order], place[doc]
        order = np.lexsort((doc, g))
        g, doc, tile, far = g[order], doc[order], tile[order], reach(size[doc], rank, num, den)[order]
        if tile.any() and (tile != 3).any():
            ones = np.bitwise_count(vec).sum(1).astype(np.int64)
            one, two = (doc[tile == 1], far[tile == 1]), (doc[tile == 2], far[tile == 2])
            pair = np.unique(np.concatenate([compare_tiles(*x, *y, vec, ones, size, num, den) for x, y in ((one, two), (two, one))]))
            pair = np.stack([pair >> 32, pair & 0xFFFFFFFF], 1)
        else:
            pair = compare_lists(doc, far, np.flatnonzero(np.append(True, g[1:] != g[:-1])), vec, size, num, den)
        a, b = ids[pair[:, 0]], ids[pair[:, 1]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    counted = frequencies(packed, k, least_words, bits, range_bits)
    blocks = packed.groupBy("pack").cogroup(counted.groupBy("pack")).applyInArrow(spread, "place bigint, key bigint, ids binary, sizes binary, vecs binary, elements binary, locals binary, tiles binary, ranks binary")
    return blocks.repartition(tasks, "place").groupBy("place", "key").applyInArrow(compare, "a bigint, b bigint").where("a <> b").distinct()


def verified(pairs: DataFrame, reps: DataFrame, k: int, least_words: int, num: int, den: int) -> DataFrame:
    """The pairs that reach the threshold, compared on their texts: a, b, ``common``, ``all``."""
    one = pairs.join(reps.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = one.join(reps.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _slices(batches, 1000):
            left, at = x.column(2).dictionary_encode(), x.column(3).dictionary_encode()
            texts = pa.concat_arrays([left.dictionary, at.dictionary])
            i, j = left.indices.to_numpy(), at.indices.to_numpy() + len(left.dictionary)
            row, g = shingles(texts, k, least_words)
            cut_at = np.searchsorted(row, np.arange(len(texts) + 1))
            common = np.array([len(np.intersect1d(g[cut_at[p] : cut_at[p + 1]], g[cut_at[q] : cut_at[q + 1]], assume_unique=True)) for p, q in zip(i, j)], np.int64)
            n = np.diff(cut_at)
            union = n[i] + n[j] - common
            ok = common * den >= union * num
            keep = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([x.column(0).take(keep), x.column(1).take(keep), pa.array(common[ok]), pa.array(union[ok])], names=["a", "b", "common", "all"])

    return both.mapInArrow(run, "a bigint, b bigint, common bigint, all bigint")


class Similar:
    """Similar texts of a table: ``members`` (id, rep) and ``pairs`` (a, b, common, all) of representatives.

    ``num / den`` is the least similarity (Jaccard), ``k`` the words of a shingle; texts of fewer than
    ``least_words`` words, NULL texts and NULL ids take no part. Repeated rows of an id count once if
    their texts have equal sets (an id with several sets is a member of several classes). Very long
    texts are compared whole; an empty table gives empty results.
    """

    def __init__(self, df: DataFrame, key: str = "result_id", text: str = "full_text", k: int = 3, num: int = 3, den: int = 5, least_words: int = 20, hot: int = HOT, range_bits: int = RANGE_BITS, bucket: int = BUCKET):
        self.hot = hot
        sets = distinct_sets(df, key, text, k, least_words)
        self.reps = kept(sets.groupBy("sig").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.min("text").alias("text")))
        ids = sets.select("id", "sig")
        self.members = ids.join(self.reps.select("sig", F.col("id").alias("rep")), "sig").select("id", "rep").distinct()
        prefix = F.col("n") - F.expr(f"({num} * n + {den - 1}) div {den}") + 1
        totals = Totals(*(x or 0 for x in self.reps.agg(F.count("*"), F.sum("n"), F.sum(prefix), F.sum(F.length("text"))).first()))
        # one id may stand for several sets, so sets are numbered by their signature
        texts = self.reps.select(F.xxhash64("sig").alias("id"), "text")
        found = verified(candidate_pairs(texts, totals, k, least_words, num, den, hot, range_bits, bucket), texts, k, least_words, num, den)
        name = self.reps.select(F.xxhash64("sig").alias("h"), "id")
        self.pairs = (
            found.join(name.select(F.col("h").alias("a"), F.col("id").alias("ia")), "a")
            .join(name.select(F.col("h").alias("b"), F.col("id").alias("ib")), "b")
            .select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "common", "all")
        )

    def all_pairs(self, names: tuple[str, str] = ("result_id_a", "result_id_b")) -> DataFrame:
        """Every pair of ids (a < b) that are similar, copies included.

        A class of more than ``hot`` copies is dealt over tiles, and each pair of its tiles is a key of its own.
        """
        m = self.members
        between = self.pairs.select("a", "b").join(m.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a").join(m.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b")
        copies = m.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1")
        tiles = F.ceil(F.col("n") / self.hot).cast("int")
        dealt = m.join(copies, "rep").withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        dealt = dealt.select("rep", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "id", "own")
        left, right = dealt.toDF("rep", "lo", "hi", "x", "p"), dealt.toDF("rep", "lo", "hi", "y", "q")
        # of two members that meet in a block of two tiles, each is from its own one
        inside = left.join(right, ["rep", "lo", "hi"]).where("x < y AND least(p, q) = lo AND greatest(p, q) = hi")
        out = between.select("x", "y").union(inside.select("x", "y")).where("x <> y")
        return out.select(F.least("x", "y").alias(names[0]), F.greatest("x", "y").alias(names[1])).distinct()

    def classes(self, key: str = "result_id") -> DataFrame:
        """One row per id: the least id it is linked with over any number of links, its own links."""
        edges = cut(self.pairs.select("a", "b"))
        label = components(edges)
        ends = edges.select(F.col("a").alias("rep")).union(edges.select(F.col("b").alias("rep")))
        links = ends.groupBy("rep").agg(F.count("*").alias("links"))
        copies = self.members.groupBy("rep").agg((F.count("*") - 1).alias("copies"))
        per_rep = copies.join(links, "rep", "left").join(label.select(F.col("v").alias("rep"), "c"), "rep", "left")
        out = self.members.join(per_rep, "rep")
        return out.groupBy(F.col("id").alias(key)).agg(F.min(F.coalesce("c", "rep")).alias("class_id"), F.sum(F.coalesce("links", F.lit(0)) + F.col("copies")).alias("n_links"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components (v, c = least vertex), by alternating large and small stars.

    Each round is cut into the shared folder; the number of rounds grows with the logarithm of the
    vertices. Stars of any size are aggregated with map-side minima, never collected.
    """
    e = edges.select("a", "b").distinct()
    last = None
    while True:
        both = e.union(e.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        e = cut(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    return e.select(F.col("a").alias("v"), F.col("b").alias("c")).union(e.select(F.col("b").alias("v"), F.col("b").alias("c"))).groupBy("v").agg(F.min("c").alias("c"))
