"""Problem 2: the language of texts and of their segments, by string kernels.

The kernel is the blended-spectrum presence kernel: the number of distinct character n-grams
(n = 1 to 4, hashed into ``2 ** GRAM_BITS`` features) two snippets share, over the geometric mean of
their own numbers. Landmark snippets of every language span a Nyström feature space; one ridge
regression per language against the rest is solved in it. As the kernel against fixed landmarks is
linear in a snippet's grams, the trained machine is one table of gram weights, and a batch of
snippets is scored as the product of its sparse presence matrix with that table.

The machine knows the languages that the labels name. It is fitted on a bounded sample: of
``TEXTS_PER_LANGUAGE`` labelled texts a label, drawn by a hash of the id, at most
``SNIPPETS_PER_LANGUAGE`` runs of about ten words, drawn by a hash from the whole texts. A label whose
texts the other labels explain as well (a language that a backend only imagined) is no language here;
single labels that the fit contradicts are dropped and it is fitted again. The halves kept out of these
fits also give the scale of probabilities, the lead that a segment's language needs and the score below
which a text is in none of the languages. Everything else runs over all rows, with nothing shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import canonical_language

GRAM_BITS = 17
TEXTS_PER_LANGUAGE = 400
SNIPPETS_PER_LANGUAGE = 1200
#: Least number of labelled texts of a language that is fitted; more labels than ``MAX_LABELS`` are an error.
MIN_TEXTS, MAX_LABELS = 3, 200
#: Snippets a label, and landmarks, by which labels are told from languages.
PROBE, PROBE_LANDMARKS = 160, 24
GENUINE = 0.3  # share of its snippets by which a label is a language; half of the labels of one may be wrong
LANDMARKS = 48
CHUNK = 10
RIDGE = 0.3
#: Words of a text below which no language is assigned, and of a segment.
TEXT_WORDS, SEGMENT_WORDS = 20, 4
#: Share of segments in another language than their text's that the lead is chosen for, as in songs that change language.
FOREIGN = 0.1
#: Share of texts in a known language that may be taken for none.
FALSE_NONE = 1e-3
_WORD = re.compile(r"[^\W_]+")
_STRETCHED = re.compile(r"(.)\1+")
_UNIT = re.compile(r"(.{1,3}?)\1*|.{4}")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.replace("İ", "i").casefold()) if text else []


def sung(ws: Sequence[str]) -> bool:
    """Whether words are sung syllables only: up to three short ones, stretched or repeated, that recur."""
    own = set(ws)
    return len(own) <= min(3, max(2, len(ws) // 3)) and all(_UNIT.fullmatch(_STRETCHED.sub(r"\1", w)) for w in own)


_PRIME = np.uint64(0x100000001B3)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def grams(snippets: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of every distinct n-gram of each snippet (at most 8,192), sorted."""
    c = np.frombuffer("\n".join([f" {s} " for s in snippets]).encode("utf-32-le"), np.uint32)
    line = np.cumsum(c == 10)
    h = np.zeros(len(c), np.uint64)
    keys = []
    for n in range(1, 5):
        m = len(c) - n + 1
        if m <= 0:
            break
        h = h[:m] * _PRIME + c[n - 1 :].astype(np.uint64) + np.uint64(n)
        ok = (line[:m] == line[n - 1 :]) & (c[n - 1 :] != 10) & (c[:m] != 10)
        f = ((h * _ODD) >> np.uint64(64 - GRAM_BITS)).astype(np.uint32)
        keys.append((line[:m].astype(np.uint32) << np.uint32(GRAM_BITS) | f)[ok])
    key = np.sort(np.concatenate(keys))
    key = key[np.append(True, key[1:] != key[:-1])]
    return (key >> np.uint32(GRAM_BITS)).astype(np.int64), (key & np.uint32((1 << GRAM_BITS) - 1)).astype(np.int64)


def _product(row: np.ndarray, feature: np.ndarray, table: np.ndarray, rows: int) -> np.ndarray:
    """The sparse presence matrix, its rows scaled by the root of their counts, times ``table``."""
    out = np.zeros((rows, table.shape[1]), np.float32)
    at = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    out[row[at]] = np.add.reduceat(table[feature], at, axis=0) / np.sqrt(np.diff(np.append(at, len(row))))[:, None]
    return out


def softmax(s: np.ndarray) -> np.ndarray:
    p = np.exp(s - s.max(1, initial=-np.inf)[:, None])
    return p / p.sum(1, keepdims=True)


class Machine:
    """Gram weights per language, a bias, the scale that makes scores log-odds, and what was calibrated.

    ``gap`` is how far a segment's score for another language must lie above that for the text's, ``floor``
    the mean score below which a text is in no known language (targets are 1 and -1).
    """

    def __init__(self, weights: np.ndarray, bias: np.ndarray, scale: float, codes: Sequence[str], gap: float, floor: float):
        self.codes, self.bias, self.scale, self.gap, self.floor = tuple(codes), bias, scale, gap, floor
        used = np.flatnonzero(np.abs(weights).sum(1) > 0)
        self.at = np.zeros(1 << GRAM_BITS, np.int32)  # gram -> row of the table; row 0 is no gram's
        self.at[used] = np.arange(1, len(used) + 1)
        self.table = np.concatenate([np.zeros((1, weights.shape[1]), np.float32), weights[used].astype(np.float32)])

    def scores(self, snippets: Sequence[str]) -> np.ndarray:
        """Log-odds (up to a constant per row) of every language for every snippet."""
        parts = [np.zeros((0, len(self.codes)), np.float32)]
        for i in range(0, len(snippets), 2048):
            part = snippets[i : i + 2048]
            row, f = grams(part)
            parts.append((_product(row, self.at[f], self.table, len(part)) + self.bias) * self.scale)
        return np.concatenate(parts)

    def probabilities(self, snippets: Sequence[str]) -> np.ndarray:
        return softmax(self.scores(snippets))

    def save(self, path: str) -> None:
        """One file, so that a fitted machine may serve other tables and days."""
        np.savez_compressed(path, at=self.at, table=self.table, bias=self.bias, codes=np.array(self.codes), numbers=np.array([self.scale, self.gap, self.floor]))

    @classmethod
    def load(cls, path: str) -> Machine:
        out = cls.__new__(cls)
        with np.load(path) as z:
            out.at, out.table, out.bias, out.codes = z["at"], z["table"], z["bias"], tuple(z["codes"].tolist())
            out.scale, out.gap, out.floor = z["numbers"].tolist()
        return out


class Space:
    """The Nyström space of landmark snippets."""

    def __init__(self, landmarks: list[str]):
        row, f = grams(landmarks)
        m = len(landmarks)
        self.used, back = np.unique(f, return_inverse=True)
        self.scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=m), 1))
        self.span = np.zeros((len(self.used), m), np.float32)  # presence of grams in landmarks, scaled
        self.span[back, row] = self.scale[row]
        # the landmarks that hold each gram
        self.holders = row[np.argsort(f, kind="stable")]
        self.many = np.bincount(f, minlength=1 << GRAM_BITS)
        self.first = np.cumsum(self.many) - self.many
        k = self.kernel(landmarks)
        value, vector = np.linalg.eigh((k + k.T) / 2 + 1e-6 * np.eye(m))
        self.root = vector / np.sqrt(np.maximum(value, 1e-6))

    def kernel(self, snippets: list[str]) -> np.ndarray:
        """Grams in common with each landmark, over the geometric mean of both numbers."""
        m, parts = len(self.scale), []
        for a in range(0, len(snippets), 64):
            part = snippets[a : a + 64]
            row, f = grams(part)
            n = self.many[f]
            at = np.repeat(self.first[f] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            common = np.bincount(np.repeat(row * m, n) + self.holders[at], minlength=len(part) * m).reshape(len(part), m)
            parts.append(common * self.scale / np.sqrt(np.maximum(np.bincount(row, minlength=len(part)), 1))[:, None])
        return np.concatenate(parts)

    def features(self, snippets: list[str]) -> np.ndarray:
        """Features of all snippets, and a constant."""
        out = np.ones((len(snippets), self.root.shape[1] + 1))
        for a in range(0, len(snippets), 4096):
            out[a : a + 4096, :-1] = self.kernel(snippets[a : a + 4096]) @ self.root
        return out

    def weights(self, w: np.ndarray) -> np.ndarray:
        """Gram weights of weights on the features."""
        out = np.zeros((1 << GRAM_BITS, w.shape[1]), np.float32)
        out[self.used] = self.span @ (self.root @ w).astype(np.float32)
        return out


def _ridge(phi: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float) -> np.ndarray:
    """One machine against the rest for every class; ``share`` is the weight of each class as a whole."""
    classes = len(share)
    weight = (share / np.maximum(np.bincount(y, minlength=classes), 1))[y] * len(y) / share.sum()
    target = np.where(y[:, None] == np.arange(classes)[None, :], 1.0, -1.0)
    lhs = (phi * weight[:, None]).T @ phi + ridge * np.diag([*[1.0] * (phi.shape[1] - 1), 1e-6])
    return np.linalg.solve(lhs, (phi * weight[:, None]).T @ target)


def _held(phi: np.ndarray, y: np.ndarray, half: np.ndarray, keep: np.ndarray, share: np.ndarray, ridge: float, also: np.ndarray | None = None) -> list[np.ndarray]:
    """Scores of every snippet (and of rows ``also``, in the same halves) by the machine fitted on the other half."""
    out = [np.zeros((len(y), len(share))) for _ in range(1 + (also is not None))]
    for side in (0, 1):
        some = keep & (half != side)
        if some.any():
            w = _ridge(phi[some], y[some], share, ridge)
            for o, x in zip(out, (phi, also)):
                o[half == side] = x[half == side] @ w
    return out


def halves(owner: np.ndarray, y: np.ndarray) -> np.ndarray:
    """0 or 1 for every snippet: the texts of each class by turns."""
    pair, back = np.unique(np.stack([y, owner], 1), axis=0, return_inverse=True)
    first = np.searchsorted(pair[:, 0], pair[:, 0])
    return ((np.arange(len(pair)) - first) & 1)[back.reshape(-1)]


def genuine(snippets: list[str], y: np.ndarray, owner: np.ndarray, share: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Classes that are languages: ``GENUINE`` of their snippets are known as theirs by a machine that hasn't seen their texts.

    Classes with more texts weigh more (by the root), so one that holds texts of larger ones only has
    nothing that speaks for it.
    """
    some = np.concatenate([rng.permutation(np.flatnonzero(y == c))[:PROBE] for c in range(len(share))])
    part, z, half = [snippets[i] for i in some], y[some], halves(owner[some], y[some])
    marks = np.concatenate([np.flatnonzero(z == c)[:PROBE_LANDMARKS] for c in range(len(share))])
    phi = Space([part[i] for i in marks]).features(part)
    held = _held(phi, z, half, np.ones(len(z), bool), np.sqrt(share), RIDGE)[0]
    right = np.bincount(z[held.argmax(1) == z], minlength=len(share))
    return np.flatnonzero(right >= np.maximum(GENUINE * np.bincount(z, minlength=len(share)), 1))


def fit(snippets: list[str], labels: list[str], owners: Sequence[int] | None = None, texts: dict[str, int] | None = None, landmarks: int = LANDMARKS, ridge: float = RIDGE, seed: int = 7, rounds: int = 4) -> Machine:
    """The machine of labelled snippets; ``owners`` numbers their texts, ``texts`` counts the labelled texts.

    Labels may be wrong: in each round machines fitted on the snippets of either half of the texts judge
    the other half, and snippets that they give to another language are left out of the next round.
    Snippets without words are left out. At least two languages must be labelled.
    """
    owners = range(len(snippets)) if owners is None else owners
    rows = [(s, x, o) for s, x, o in zip(snippets, labels, owners) if s]
    codes = sorted({x for _, x, _ in rows})
    if len(codes) < 2:
        raise ValueError("labelled snippets of at least two languages are needed")
    snippets, owner = [s for s, _, _ in rows], np.array([o for _, _, o in rows], np.int64)
    y = np.array([codes.index(x) for _, x, _ in rows])
    rng = np.random.default_rng(seed)
    share = np.array([float((texts or {}).get(c, 0) or len(set(owner[y == i].tolist()))) for i, c in enumerate(codes)])
    real = genuine(snippets, y, owner, share, rng)
    if len(real) >= 2 and len(real) < len(codes):
        of = np.isin(y, real)
        snippets, owner, y = [s for s, ok in zip(snippets, of) if ok], owner[of], np.searchsorted(real, y[of])
        codes, share = [codes[c] for c in real], share[real]
    n = len(codes)
    even = np.ones(n)
    chosen = np.concatenate([rng.permutation(np.flatnonzero(y == c))[:landmarks] for c in range(n)])
    space = Space([snippets[i] for i in chosen])
    phi = space.features(snippets)
    half = halves(owner, y)
    keep = np.ones(len(y), bool)
    held = np.zeros((len(y), n))
    for r in range(rounds):
        # at first larger languages weigh more, as wrong labels mostly hide texts of theirs in small ones
        held = _held(phi, y, half, keep, np.sqrt(share) if r == 0 else even, ridge * (10 if r == 0 else 1))[0]
        now = held.argmax(1) == y
        now |= np.isin(y, np.flatnonzero(np.bincount(y[now], minlength=n) < 4))  # too few to judge
        if (now == keep).all():
            break
        keep = now
    losses = []  # the scale that makes probabilities honest, on the halves kept out
    for scale in range(2, 21):  # no surer than that: unseen texts are less alike than the halves
        z = held[keep] * scale
        z = z - z.max(1, keepdims=True)
        losses.append((-(z[np.arange(len(z)), y[keep]] - np.log(np.exp(z).sum(1))).mean(), scale))
    w = _ridge(phi[keep], y[keep], even, ridge)
    gap, floor = _calibrate(space, snippets, phi, y, owner, half, keep, ridge, share)
    return Machine(space.weights(w[:-1]), w[-1].astype(np.float32), float(min(losses)[1]), codes, gap, floor)


def _calibrate(space: Space, snippets: list[str], phi: np.ndarray, y: np.ndarray, owner: np.ndarray, half: np.ndarray, keep: np.ndarray, ridge: float, share: np.ndarray) -> tuple[float, float]:
    """Lead of segments and floor of texts, from scores by machines that haven't seen the text.

    Segments are played by the first half of each snippet: in a text of its own language, and in one of
    the most frequent other language. The lead is the one with the fewest errors if ``FOREIGN`` of all
    segments are in another language than their text. (Some of the former are foreign in truth, and lead
    by as much as the latter; that doesn't move the place with the fewest errors.)
    """
    every = np.arange(len(y))
    short = space.features([" ".join(x[: max(1, len(x) // 2)]) for x in (s.split(" ") for s in snippets)])
    held, brief = _held(phi, y, half, keep, np.ones(len(share)), ridge, short)
    own = brief[every, y]
    other = brief.copy()
    other[every, y] = -np.inf
    rank = np.argsort(-share, kind="stable")
    host = np.where(y == rank[0], rank[1], rank[0])
    at_home, abroad = np.sort((other.max(1) - own)[keep]), np.sort(np.where(own > other.max(1), own - brief[every, host], -1.0)[keep])
    tried = np.arange(0, 2, 0.01)
    false = (len(at_home) - np.searchsorted(at_home, tried, "left")) / max(1, len(at_home))
    missed = np.searchsorted(abroad, tried, "left") / max(1, len(abroad))
    gap = float(tried[((1 - FOREIGN) * false + FOREIGN * missed).argmin()])
    _, text, size = np.unique(owner[keep], return_inverse=True, return_counts=True)
    mean = np.bincount(text, held[every, y][keep]) / size
    floor = float(np.quantile(mean, FALSE_NONE, method="lower")) if len(mean) else -1.0
    return gap, floor


def chunks(ws: list[str], size: int = CHUNK) -> list[list[str]]:
    """Words in runs of about ``size``; the last run takes a short rest."""
    n = max(1, round(len(ws) / size))
    cuts = [len(ws) * i // n for i in range(n + 1)]
    return [ws[a:z] for a, z in zip(cuts, cuts[1:]) if z > a]


def sample(df: DataFrame, key: str, text: str, label: str, texts: int = TEXTS_PER_LANGUAGE, snippets: int = SNIPPETS_PER_LANGUAGE) -> tuple[DataFrame, dict[str, int]]:
    """Labelled snippets (l, h: hash of the text's id, s), and the number of labelled texts of each label.

    Ids and labels are read first, without the texts; then the texts of the drawn ids only go on.
    """
    named = df.select(F.xxhash64(F.col(f"`{key}`")).alias("h"), canonical_language(F.col(f"`{label}`")).alias("l")).where("l IS NOT NULL").distinct()
    top = named.groupBy("l").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_TEXTS).orderBy(F.desc("n"), "l").limit(MAX_LABELS + 1).collect()
    if len(top) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels of {MIN_TEXTS} texts")
    count = {r["l"]: r["n"] for r in top}
    drawn = named.where(F.col("l").isin(*count)).withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("r") <= texts)
    whole = df.select(F.xxhash64(F.col(f"`{key}`")).alias("h"), F.col(f"`{text}`").alias("t")).where("t IS NOT NULL")
    # at most MAX_LABELS * texts rows of a hash and a label
    whole = whole.join(F.broadcast(drawn.select("h", "l")), "h").select("l", "h", "t")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, parts = [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                for c in chunks(words(t)):
                    if not sung(c):
                        row.append(i)
                        parts.append(" ".join(c))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(parts, pa.string())], names=["l", "h", "s"])

    parts = whole.mapInArrow(split, "l string, h bigint, s string").distinct()
    turn = Window.partitionBy("l").orderBy(F.xxhash64("h", "s"), "h", "s")
    return parts.withColumn("r", F.row_number().over(turn)).where(F.col("r") <= snippets).drop("r"), count


def train(df: DataFrame, key: str = "result_id", text: str = "full_text", label: str = "detected_language", texts: int = TEXTS_PER_LANGUAGE, snippets: int = SNIPPETS_PER_LANGUAGE) -> Machine:
    """A machine from at most ``texts`` labelled texts and ``snippets`` snippets of each label."""
    rows, count = sample(df, key, text, label, texts, snippets)
    got = sorted(tuple(r) for r in rows.collect())  # at most MAX_LABELS * snippets short strings
    return fit([s for _, _, s in got], [x for x, _, _ in got], [h for _, h, _ in got], count)


def languages(df: DataFrame, machine: Machine, key: str, text: str, segments: Column | None = None, text_words: int = TEXT_WORDS, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Languages of texts and of segments in another language: key, seg_no, lang, confidence.

    ``seg_no`` -1 is the text: the language of most of its words, judged in runs of about ten words
    that vote with their probabilities; the confidence is the language's share of the votes. It is NULL,
    with a confidence of 0, if the runs that vote for it score below the machine's floor: the text is in
    none of the languages, or in no language at all. Other rows are the segments (ARRAY<STRING>, numbered
    from 0) whose own language leads the text's by the machine's gap; their confidence is its probability.

    Defined cases: texts of fewer than ``text_words`` words (NULL and empty ones too) give no row, nor do
    their segments; sung syllables don't vote unless there is nothing else; NULL segments and such of
    fewer than ``segment_words`` words or of sung syllables only give no row; repeated rows give
    repeated rows; an empty table gives an empty result; other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(machine)
    src = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"), (segments if segments is not None else F.array().cast("array<string>")).alias("s")).where(F.length("t") >= text_words * 2 - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for b in (whole.slice(a, 400) for a in range(0, len(whole), 400)):
                seen: dict[str, int] = {}  # every distinct snippet is scored once
                which, owner, number, vote = [], [], [], []
                for i, (t, segs) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                    ws = words(t)
                    if len(ws) < text_words:
                        continue
                    own = [words(x) for x in segs or []]
                    # where the segments are the text, they are its runs of words as well
                    same = own and max(map(len, own)) <= 2 * CHUNK and [w for c in own for w in c] == ws
                    runs = [c for c in own if c] if same else chunks(ws)
                    voting = [c for c in runs if not sung(c)]
                    for c in voting or runs:
                        which.append(seen.setdefault(" ".join(c), len(seen)))
                        owner.append(i)
                        number.append(-1)
                        vote.append(len(c))
                    for j, c in enumerate(own):
                        if len(c) >= segment_words and not sung(c):
                            which.append(seen.setdefault(" ".join(c), len(seen)))
                            owner.append(i)
                            number.append(j)
                            vote.append(0)
                if not which:
                    continue
                score = m.scores(list(seen))[which]
                p = softmax(score)
                o, no, w = np.array(owner), np.array(number), np.array(vote, float)
                best = p.argmax(1)
                text_part = no < 0
                votes = np.zeros((len(b), len(m.codes)))
                np.add.at(votes, o[text_part], p[text_part] * w[text_part][:, None])
                total = np.bincount(o[text_part], w[text_part], len(b))
                main = votes.argmax(1)
                has = np.flatnonzero(total > 0)
                # how well the runs that vote for the language fit it
                for_main = p[text_part, main[o[text_part]]] * w[text_part]
                fits = np.bincount(o[text_part], for_main * score[text_part, main[o[text_part]]], len(b)) / np.maximum(np.bincount(o[text_part], for_main, len(b)), 1e-9)
                none = fits < m.floor * m.scale
                # a short segment speaks for another language only against the song's own
                every = np.arange(len(p))
                other = ~text_part & (best != main[o]) & (score[every, best] - score[every, main[o]] >= m.gap * m.scale) & ~none[o]
                rows = np.append(has, o[other])
                lang = np.append(main[has], best[other])
                known = np.append(~none[has], np.ones(other.sum(), bool))
                conf = np.where(known, np.append(votes[has, main[has]] / total[has], p[np.flatnonzero(other), best[other]]), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows)), pa.array(np.append(np.full(len(has), -1), no[other]), pa.int64()), pa.array([m.codes[x] if k else None for x, k in zip(lang, known)], pa.string()), pa.array(conf, pa.float64())],
                    names=["k", "seg_no", "lang", "confidence"],
                )

    return src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, seg_no bigint, lang string, confidence double").withColumnRenamed("k", key)
