"""Problem 9: subject areas of documents, by class-association rules.

Documents are cut into passages (lines and sentences). The passages of labelled documents are
transactions: their telling words, a mark of verse form, and the subject of the document. Parallel
frequent-pattern growth gives each group of words its conditional passages and grows bodies in it, of any
length, from the rarest word on; a body that holds for a subject in most of its documents is a rule
"words -> subject". Growth goes on as long as a word makes the rule surer by ``GAIN`` and the counts allow
it to become so again, which ends it without a bound on length. (Without that condition a passage of n
words that comes often enough has 2^n sets.) A rule is redundant, and pruned, if a part of its words gives
the same subject with about the same confidence. A passage is scored by the evidence (log-odds against
the subject's share) of the rules that match it. Labelled documents that the rules were not mined from
give the chance that a passage's leading subject is right, and the chance from which it counts: the one
that gives these documents their labels best. Document shares are the words of its passages per subject.

The rules are fitted on at most ``TRAIN_DOCS`` labelled documents (drawn by a hash of the id) and
``TRAIN_PASSAGES`` passages of them, so their words and rules are sent to the workers whole. Their texts
are read once and kept as passages; scoring reads every document once more and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import canonical_language
from ..session import kept
from .words import folded

TRAIN_DOCS = 5_000
TRAIN_PASSAGES = 200_000
#: Least share of the training passages behind a rule, and least number of passages and of documents.
MIN_SUPPORT, MIN_PASSAGES, MIN_DOCS = 1e-4, 3, 2
MIN_CONFIDENCE = 0.7  # remarks go with whatever a language's documents are about, up to about half of the time
TELLING = 0.3  # least share of a word's documents of one subject; words below it are in no body
SHORT = 3  # runs of lines of fewer words are one passage
UNSEEN_DOCS = 2.0  # documents without the subject that are added to those behind each word of a rule
MIN_ODDS = 3.0  # how much a rule must raise the odds of its subject
GAIN = 0.05  # how much surer each word must make a rule, and a rule must be than its parts
MIN_HELD, GROUP = 200, 25  # least number of held-out passages with evidence to calibrate on; passages a point
LEAD_STEP = 0.05  # leads are counted in steps
CHANCES = tuple(x / 100 for x in range(50, 100, 5))  # from which the least chance is chosen
SHARE = 0.25
MAX_SUBJECTS = 1000  # the workers hold words x subjects and passages x subjects; above it, mining fails
AT_ONCE = 1 << 20  # parts of bodies that are matched at once
VERSE = "#verse"
_STOP = r"([.!?;])\s+|([。！？；])"
_OPEN = r"[^\s.!?;:。！？；][\"')\]»”]*$"


class Passages:
    """The passages of a batch of texts as flat arrays: sentences, lines, and runs of short lines.

    ``text``, ``words``: number of the text and count of the words of each passage that has words.
    ``at``, ``code``: passage and item of each distinct item, sorted; ``items`` names the codes. Items are
    folded words that aren't mere digits, and ``VERSE``, which marks passages of four words or more that
    end in no stop and have such a neighbour.
    """

    def __init__(self, texts: pa.Array | list[str | None]):
        texts = texts.to_pylist() if isinstance(texts, pa.Array) else texts
        whole = pa.array([folded(t) if t else "" for t in texts], pa.string())
        lines = pc.split_pattern_regex(pc.replace_substring_regex(whole, _STOP, "\\1\\2\n"), r"\r\n|[\n\r\v\f]|\x85|\x{2028}|\x{2029}")
        text = np.repeat(np.arange(len(texts)), pc.list_value_length(lines).to_numpy())
        flat = lines.flatten()
        words = pc.split_pattern(pc.utf8_trim(pc.replace_substring_regex(flat, r"[^\p{L}\p{N}]+", " "), " "), " ")
        n = pc.list_value_length(words).to_numpy().astype(np.int64)
        n[pc.equal(pc.list_element(words, 0), "").to_numpy(zero_copy_only=False)] = 0  # a line of marks only
        open_end = pc.match_substring_regex(pc.utf8_trim_whitespace(flat), _OPEN).to_numpy(zero_copy_only=False) & (n > 0)
        same = text[1:] == text[:-1]
        beside = np.zeros(len(text), bool)
        beside[1:] |= open_end[:-1] & same
        beside[:-1] |= open_end[1:] & same
        short = open_end & (n < SHORT) | (n == 0)
        head = np.append(True, ~(same & short[1:] & short[:-1])) if len(text) else np.zeros(0, bool)
        part = np.cumsum(head) - 1  # the passage of each line
        verse = np.unique(part[open_end & beside & (n >= 4)])
        encoded = words.flatten().dictionary_encode()
        self.items: list[str] = [*encoded.dictionary.to_pylist(), VERSE]
        useful = np.array([bool(w) and not w.isdigit() for w in self.items[:-1]], bool)
        owner = np.repeat(part, pc.list_value_length(words).to_numpy())
        code = encoded.indices.to_numpy().astype(np.int64)
        keep = useful[code] if len(code) else np.zeros(0, bool)
        pair = np.unique(np.append(owner[keep], verse) << 32 | np.append(code[keep], np.full(len(verse), len(self.items) - 1)))
        n, text = np.bincount(part, n, part[-1] + 1 if len(part) else 0).astype(np.int64), text[head]
        number = np.cumsum(n > 0) - 1  # passages without words are left out
        self.text, self.words = text[n > 0], n[n > 0]
        self.at, self.code = number[pair >> 32], pair & 0xFFFFFFFF

    @classmethod
    def of_lists(cls, text: np.ndarray, words: np.ndarray, lists: pa.Array) -> Passages:
        """From what ``lists`` gave, with the text's number and the words of each passage."""
        out = cls.__new__(cls)
        encoded = lists.flatten().dictionary_encode()
        out.items, out.text, out.words = encoded.dictionary.to_pylist(), text, words
        at = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        pair = np.sort(at << 32 | encoded.indices.to_numpy().astype(np.int64))
        out.at, out.code = pair >> 32, pair & 0xFFFFFFFF
        return out

    def lists(self) -> pa.Array:
        """The items of each passage as an array of strings."""
        ends = np.searchsorted(self.at, np.arange(len(self.words) + 1))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(self.items, pa.string()).take(pa.array(self.code)))


class Rules:
    """Rules as sorted arrays, and the calibration.

    Bodies are paths of a tree: ``first`` has the evidence of single items, a key ``node * items + item``
    in ``keys`` leads from a body (a node; single items are the first ones) to the body with one more item.
    """

    def __init__(self, subjects: list[str], rules: dict[tuple[str, ...], dict[int, float]]):
        self.subjects = subjects
        #: chance that the leading subject is right by its lead; without a calibration leads are log-odds
        self.curve = (np.arange(0, 20, 0.1), 1 / (1 + np.exp(-np.arange(0, 20, 0.1))))
        self.least = 0.8
        items = sorted({x for k in rules for x in k})
        self.index = {x: i for i, x in enumerate(items)}
        nodes: dict[tuple[int, ...], int] = {(i,): i for i in range(len(items))}
        bodies = sorted((tuple(sorted(self.index[x] for x in k)), by) for k, by in rules.items())
        steps: dict[int, int] = {}
        for body, _ in bodies:
            for n in range(2, len(body) + 1):
                if body[:n] not in nodes:
                    nodes[body[:n]] = len(nodes)
                    steps[nodes[body[: n - 1]] * len(items) + body[n - 1]] = nodes[body[:n]]
        self.weight = np.zeros((max(1, len(nodes)), len(subjects)), np.float32)
        for body, by in bodies:
            for c, e in by.items():
                self.weight[nodes[body], c] = e
        self.keys = np.array(sorted(steps), np.int64)
        self.to = np.array([steps[k] for k in self.keys.tolist()], np.int64)
        self.longer = np.zeros(len(items), bool)
        for body in nodes:
            if len(body) > 1:
                self.longer[list(body)] = True

    def evidence(self, p: Passages) -> np.ndarray:
        """Summed evidence of the matching rules per passage and subject."""
        out = np.zeros((len(p.words), len(self.subjects)), np.float32)
        item = np.array([self.index.get(w, -1) for w in p.items], np.int64)[p.code] if len(p.code) else np.zeros(0, np.int64)
        some = item >= 0
        r, x = p.at[some], item[some]
        if not len(r):
            return out
        at = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        out[r[at]] = np.add.reduceat(self.weight[x], at, axis=0)
        if not len(self.keys):
            return out
        more = self.longer[x]
        r, x = r[more], x[more]
        order = np.lexsort((x, r))
        r, x = r[order], x[order]
        end = np.searchsorted(r, r, "right")
        todo = [(np.arange(len(r)), x)]  # place of a body's last item, and its node
        while todo:
            place, node = todo.pop()
            left = end[place] - place - 1
            take = int(np.searchsorted(np.cumsum(left), AT_ONCE, "right"))
            if take < len(place):
                take = max(1, take)
                if take < len(place):
                    todo.append((place[take:], node[take:]))
                place, node, left = place[:take], node[:take], left[:take]
            nxt = np.repeat(place + 1, left) + np.arange(left.sum()) - np.repeat(np.cumsum(left) - left, left)
            key = np.repeat(node, left) * len(self.index) + x[nxt]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[k] == key)
            if len(hit):
                node = self.to[k[hit]]
                np.add.at(out, r[nxt[hit]], self.weight[node])
                todo.append((nxt[hit], node))
        return out

    @staticmethod
    def lead(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best subject, its evidence and how far it leads the next (or no evidence)."""
        every = np.arange(len(e))
        best = e.argmax(1)
        top = e[every, best]
        rest = e.copy()
        rest[every, best] = -np.inf
        return best, top, top - np.maximum(rest.max(1, initial=-np.inf), 0)

    def assign(self, p: Passages, least: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Subject of each passage (-1: none) and the calibrated chance that it is right."""
        if not len(p.words):
            return np.zeros(0, np.int64), np.zeros(0)
        best, top, lead = self.lead(self.evidence(p))
        chance = np.interp(lead, *self.curve)
        return np.where((top > 0) & (chance >= (self.least if least is None else least)), best, -1), chance

    def calibrate(self, lead: np.ndarray, n: np.ndarray, right: np.ndarray) -> None:
        """From counts of held-out passages and of right ones at ascending leads: the curve from lead to chance, which never falls."""
        if n.sum() < MIN_HELD:
            return
        point = np.minimum((np.cumsum(n) - n) // GROUP, (n.sum() - 1) // GROUP)  # about GROUP passages a point
        blocks: list[list[float]] = []  # number, sum of leads, right ones; neighbours that fall are pooled
        for g in np.unique(point):
            own = point == g
            blocks.append([float(n[own].sum()), float((lead * n)[own].sum()), float(right[own].sum())])
            while len(blocks) > 1 and blocks[-2][2] * blocks[-1][0] >= blocks[-1][2] * blocks[-2][0]:
                last = blocks.pop()
                blocks[-1] = [i + j for i, j in zip(blocks[-1], last)]
        total, sums, good = np.array(blocks).T
        self.curve = (sums / total, good / total)


def mine(docs: DataFrame, labels: DataFrame, areas: DataFrame, train_docs: int = TRAIN_DOCS, train_passages: int = TRAIN_PASSAGES) -> Rules:
    """Rules from the labelled documents.

    Labels that are NULL or no subject of ``areas`` don't count. Rules are mined from documents whose
    annotators name one subject only; a fifth of all labelled documents is kept out for calibration.
    More than ``MAX_SUBJECTS`` subjects are an error: none is left out.
    """
    subjects = [r[0] for r in areas.select("subject").where("subject IS NOT NULL").distinct().orderBy("subject").limit(MAX_SUBJECTS + 1).collect()]
    if len(subjects) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    named = labels.select(F.col("doc_id").alias("d"), F.col("subject").alias("s")).where(F.col("s").isin(*subjects)).distinct()
    per_doc = named.groupBy("d").agg(F.sort_array(F.collect_set("s")).alias("ss")).withColumn("h", F.pmod(F.xxhash64("d"), F.lit(1 << 20)))
    # A bounded sample, so it may be broadcast and no text is shuffled for it. Each language and subject
    # gives its documents by a hash of their ids, one after another, so that rare languages are in it.
    label = canonical_language(F.col("lang")) if "lang" in docs.columns else F.lit(None).cast("string")
    lang = docs.select(F.col("doc_id").alias("d"), F.coalesce(label, F.lit("?")).alias("l"))
    turn = Window.partitionBy("l", F.col("ss")[0]).orderBy("h", "d")
    sample = per_doc.join(lang, "d").withColumn("r", F.row_number().over(turn)).where(F.col("r") <= train_docs).orderBy("r", "h", "d").limit(train_docs)
    texts = docs.select(F.col("doc_id").alias("d"), "text").join(F.broadcast(sample.select("d", F.pmod("h", F.lit(5)).alias("h"), "ss")), "d").select("d", "h", "ss", "text")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = Passages(b.column(3))
            pick = pa.array(p.text)
            yield pa.RecordBatch.from_arrays([*[b.column(i).take(pick) for i in range(3)], pa.array(p.words), p.lists()], names=["d", "h", "ss", "words", "items"])

    tasks = docs.sparkSession.sparkContext.defaultParallelism
    parts = kept(texts.repartition(tasks, "d").mapInArrow(split, "d bigint, h bigint, ss array<string>, words bigint, items array<string>"))
    train = parts.where("size(ss) = 1 AND h <> 0").select("d", F.col("ss")[0].alias("s"), "items").distinct()
    share = {r["s"]: r["n"] for r in train.groupBy("s").agg(F.count("*").alias("n")).collect()}
    n = sum(share.values())
    if not n:
        return Rules(subjects, {})
    if n > train_passages:
        train = train.where(F.pmod(F.xxhash64("d", "items"), F.lit(1 << 30)) < int((1 << 30) * train_passages / n))
    share = {s: x / n for s, x in share.items()}
    # Passages of a document resemble each other, and a long document with a wrong label has many. So the
    # bodies are found over passages, and confidence is taken over documents.
    confidence: dict[tuple[tuple[str, ...], str], float] = {}
    for r in grow(train, max(MIN_PASSAGES, int(np.ceil(MIN_SUPPORT * min(n, train_passages))))).collect():
        confidence[tuple(sorted(r["body"])), r["s"]] = r["docs"] / (r["all"] + UNSEEN_DOCS * len(r["body"]))
    rules: dict[tuple[str, ...], dict[int, float]] = {}
    for (body, s), c in irredundant(confidence).items():
        p = min(0.5, share[s])
        odds = c / (1 - c) / (p / (1 - p))
        if odds >= MIN_ODDS:
            rules.setdefault(body, {})[subjects.index(s)] = float(np.log(odds))
    out = Rules(subjects, rules)
    _tune(out, parts.where("h = 0"), tasks)
    return out


def irredundant(confidence: dict[tuple[tuple[str, ...], str], float]) -> dict[tuple[tuple[str, ...], str], float]:
    """Rules that are surer by ``GAIN`` than every rule of a part of their (sorted) words."""
    known: dict[tuple[tuple[str, ...], str], float] = {}

    def best_part(body: tuple[str, ...], s: str) -> float:
        if (body, s) not in known:
            parts = [body[:i] + body[i + 1 :] for i in range(len(body))] if len(body) > 1 else []
            known[body, s] = max((max(confidence.get((x, s), 0.0), best_part(x, s)) for x in parts), default=-GAIN)
        return known[body, s]

    return {k: c for k, c in confidence.items() if c >= best_part(*k) + GAIN}


def _tune(rules: Rules, held: DataFrame, tasks: int) -> None:
    """Calibrates the rules on held-out passages (d, ss, words, items) and chooses the least chance that counts.

    The workers return counts only: at most a row a step of lead, and a row a chance that is tried.
    """
    shared = held.sparkSession.sparkContext.broadcast(rules)
    number = {x: i for i, x in enumerate(rules.subjects)}

    def read(t: pa.Table | pa.RecordBatch) -> tuple[Passages, list[set[int]]]:
        text = pc.dictionary_encode(t.column("d")).combine_chunks() if isinstance(t, pa.Table) else t.column("d").dictionary_encode()
        text = text.indices.to_numpy().astype(np.int64)
        _, first = np.unique(text, return_index=True)
        labels = [{number[x] for x in ss} for ss in t.column("ss").take(pa.array(first)).to_pylist()]
        lists = t.column("items").combine_chunks() if isinstance(t, pa.Table) else t.column("items")
        return Passages.of_lists(text, t.column("words").to_numpy(), lists), labels

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for b in batches:
            p, labels = read(b)
            if len(p.words):
                best, top, lead = r.lead(r.evidence(p))
                some = np.flatnonzero(top > 0)
                right = np.array([int(best[i]) in labels[p.text[i]] for i in some], np.int64)
                step, back = np.unique((lead[some] / LEAD_STEP).round().astype(np.int64), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(np.bincount(back, minlength=len(step))), pa.array(np.bincount(back, right, len(step)).astype(np.int64))], names=["step", "n", "ok"])

    steps = held.select("d", "ss", "words", "items").mapInArrow(leads, "step bigint, n bigint, ok bigint").groupBy("step").agg(F.sum("n").alias("n"), F.sum("ok").alias("ok")).orderBy("step").collect()
    if sum(r["n"] for r in steps) < MIN_HELD:
        return
    rules.calibrate(*(np.array([r[c] for r in steps], float) * x for c, x in (("step", LEAD_STEP), ("n", 1), ("ok", 1))))
    tuned = held.sparkSession.sparkContext.broadcast(rules)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        r = tuned.value
        p, labels = read(pa.Table.from_batches(got))
        total = np.bincount(p.text, p.words, len(labels))
        best, top, lead = r.lead(r.evidence(p))
        chance = np.interp(lead, *r.curve)
        rows = []
        for least in CHANCES:
            some = np.flatnonzero((top > 0) & (chance >= least))
            of = np.bincount(p.text[some] * len(r.subjects) + best[some], p.words[some], len(labels) * len(r.subjects)).reshape(len(labels), -1)
            told = of >= SHARE * total[:, None]
            told &= of > 0
            hits = sum(int(told[i, list(x)].sum()) for i, x in enumerate(labels))
            rows.append((int(least * 100), hits, int(told.sum()), sum(map(len, labels))))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["least", "hits", "told", "named"])

    sums = held.select("d", "ss", "words", "items").repartition(tasks, "d").mapInArrow(judged, "least bigint, hits bigint, told bigint, named bigint").groupBy("least").agg(F.sum("hits").alias("hits"), F.sum("told").alias("told"), F.sum("named").alias("named")).collect()
    rules.least = max(sums, key=lambda r: (2 * r["hits"] / max(1, r["told"] + r["named"]), -r["least"]))["least"] / 100


def grow(train: DataFrame, least: int) -> DataFrame:
    """Bodies (words, of any length) that are a rule for a subject s: body, s, passages and docs with s, all docs.

    ``train`` has a passage a row (d, s, items), one subject a document. A rule has ``least`` passages,
    ``MIN_DOCS`` documents and ``MIN_CONFIDENCE`` of its body's documents. Every group of words is one task
    of growth over its conditional passages: of each passage with words of the group, the part from the
    rarest of them on.
    """
    per = train.select("d", "s", F.explode("items").alias("x")).groupBy("d", "s", "x").agg(F.count("*").alias("n"))
    per = per.groupBy("x", "s").agg(F.sum("n").alias("passages"), F.count("*").alias("docs"))
    telling = per.groupBy("x").agg(F.sum("passages").alias("n"), F.sum("docs").alias("all"), F.max("docs").alias("most"), F.max("passages").alias("top"))
    telling = telling.where((F.col("most") >= MIN_DOCS) & (F.col("most") >= TELLING * F.col("all")) & (F.col("top") >= least)).select("x", "n")
    words = [r["x"] for r in sorted(telling.collect(), key=lambda r: (r["n"], r["x"]))]  # rare ones first
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast(words)
    groups = 4 * spark.sparkContext.defaultParallelism

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.string())
        for b in batches:
            lists = b.column(2)
            code = pc.index_in(lists.flatten(), known)
            hit = code.is_valid().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(b)), pc.list_value_length(lists).to_numpy())[hit]
            item = code.drop_null().to_numpy().astype(np.int64)
            order = np.lexsort((item, row))
            row, item = row[order], item[order]
            group = item % groups
            # the first place of each group in each passage
            pick = np.lexsort((np.arange(len(row)), group, row))
            new = np.append(True, (row[pick][1:] != row[pick][:-1]) | (group[pick][1:] != group[pick][:-1])) if len(row) else np.zeros(0, bool)
            head = pick[new]
            n = np.searchsorted(row, row[head], "right") - head
            flat = np.repeat(head, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            tails = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(item[flat].astype(np.int32)))
            at = pa.array(row[head])
            yield pa.RecordBatch.from_arrays([pa.array(group[head]), b.column(0).take(at), b.column(1).take(at), tails], names=["g", "d", "s", "items"])

    def growth(t: pa.Table) -> pa.Table:
        subject = t.column("s").combine_chunks().dictionary_encode()
        names = subject.dictionary.to_pylist()
        s = subject.indices.to_numpy().astype(np.int64)
        doc = t.column("d").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        lists = t.column("items").combine_chunks()
        flat = lists.flatten().to_numpy().astype(np.int64)
        n = pc.list_value_length(lists).to_numpy()
        end = np.cumsum(n)
        owner = np.repeat(np.arange(len(n)), n)
        of_doc = np.zeros(doc.max(initial=-1) + 1, np.int64)
        of_doc[doc] = s
        mine = flat % groups == t.column("g")[0].as_py()
        words, found = shared.value, []
        # bodies to extend: the body, the place after its last word in each of its passages, confidence by subject
        todo = [((), np.flatnonzero(mine), None)]
        while todo:
            body, place, sure = todo.pop()
            if sure is not None:  # the rest of the passages behind the body
                left = end[owner[place]] - place - 1
                place = np.repeat(place + 1, left) + np.arange(left.sum()) - np.repeat(np.cumsum(left) - left, left)
            place = place[np.argsort(flat[place], kind="stable")]
            word, back = np.unique(flat[place], return_inverse=True)
            if not len(word):
                continue
            k = len(names)
            passages = np.bincount(back * k + s[owner[place]], minlength=len(word) * k).reshape(-1, k)
            pair = np.unique(back * len(of_doc) + doc[owner[place]])
            docs = np.bincount(pair // len(of_doc) * k + of_doc[pair % len(of_doc)], minlength=len(word) * k).reshape(-1, k)
            every = docs.sum(1, keepdims=True)
            size = len(body) + 1
            conf = docs / (every + UNSEEN_DOCS * size)
            can = (passages >= least) & (docs >= MIN_DOCS) & (conf >= (0 if sure is None else sure + GAIN))
            rule = can & (docs >= MIN_CONFIDENCE * every)
            for w, c in zip(*np.nonzero(rule)):
                found.append(([words[x] for x in (*body, int(word[w]))], names[c], int(passages[w, c]), int(docs[w, c]), int(every[w, 0])))
            # with every other document gone and one word more a rule can't be surer than this
            on = (can & (docs / (docs + UNSEEN_DOCS * (size + 1)) >= conf + GAIN)).any(1)
            first = np.searchsorted(back, np.arange(len(word) + 1))
            for w in np.flatnonzero(on):
                todo.append(((*body, int(word[w])), place[first[w] : first[w + 1]], conf[w]))
        cols = list(zip(*found)) if found else [[], [], [], [], []]
        return pa.table({"body": pa.array(cols[0], pa.list_(pa.string())), "s": pa.array(cols[1], pa.string()), **{c: pa.array(x, pa.int64()) for c, x in zip(("passages", "docs", "all"), cols[2:])}})

    tails = train.select("d", "s", "items").mapInArrow(spread, "g bigint, d bigint, s string, items array<int>")
    return tails.groupBy("g").applyInArrow(growth, "body array<string>, s string, passages bigint, docs bigint, all bigint")


def shares(docs: DataFrame, rules: Rules, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Share of each document's words per subject: key, subject, words, doc_words, share, confidence.

    Defined cases: NULL, empty and wordless texts, and documents without any passage about a subject,
    give no row; digits count as words; texts are taken whole; repeated documents give repeated rows;
    an empty table gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(rules)
    src = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for whole in batches:
            for b in (whole.slice(a, 500) for a in range(0, len(whole), 500)):
                p = Passages(b.column(1))
                s, sure = r.assign(p)
                o, w = p.text, p.words
                total = np.bincount(o, w, len(b))
                some = s >= 0
                cell = o[some] * len(r.subjects) + s[some]
                size = len(b) * len(r.subjects)
                of, conf = np.bincount(cell, w[some], size), np.bincount(cell, (w * sure)[some], size)
                at = np.flatnonzero(of)
                d = at // len(r.subjects)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(d)), pa.array([r.subjects[x] for x in at % len(r.subjects)], pa.string()), pa.array(of[at].astype(np.int64)), pa.array(total[d].astype(np.int64)), pa.array(of[at] / total[d]), pa.array(conf[at] / of[at])],
                    names=["k", "subject", "words", "doc_words", "share", "confidence"],
                )

    return src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, subject string, words bigint, doc_words bigint, share double, confidence double").withColumnRenamed("k", key)
