"""Toxicity: a convolutional text classifier on hashed word embeddings.

A word's embedding is the sum of the hashed embeddings of the word and of its first 4, 5
and 6 bytes, so an unseen word with a known stem still means something.  Filters of
widths 1 to 3 run over the words of a whole text; a filter's output is max-pooled over
the text, and a linear layer on the pooled values gives the logit.

The net learns from every labelled row outside the held-out fold, whole texts included, but
for a share (``VALIDATION``, by a hash of the id) that the thresholds are found on.  Rows are dealt by id
to tasks of about ``SHARD_ROWS``; each task goes on from the common net (numpy, Adagrad,
max-pooling passes the gradient to one place per filter and text), and after each of
``ROUNDS`` rounds every parameter moves by the mean step of the tasks that moved it.  The steps
are summed by block in many tasks, so the driver gets one net a round.  The deal depends on
the rows alone, so reruns agree.  Up to ``SHARD_ROWS`` rows are one task and one round.

Thresholds are calibrated by language on the share that training does not see: its logits
are counted in cells of ``1 / CELLS``, and for each language the logit with the best F1 at
the corpus's own class ratio becomes score 0.5.  The language is detected from the text itself (function words); the columns
``lang``, ``source``, the id and the labels never enter a score.

Defined results: a null or empty text has the score of a text without known words.  With
labels of one class only, or none, every score is the share of toxic labels (0.0 without
labels).  Of contradicting labels of one id, toxic wins.  Equal texts have equal scores;
repeated rows are scored alike.  Labels without an id, or not 0 or 1, are left out.  An
empty table gives no rows.  Other columns pass through; columns that have the names of
results are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..operators.bitmaps import possible_members
from .common import cut, release
from .textcore import KEEP, NON_ALNUM, Texts, give_back, mix, slices

SHARD_ROWS = 6000          # labelled rows that one task learns from, about
ROUNDS = 3                 # rounds of several tasks, each with EPOCHS // ROUNDS passes over all rows
HELD_BYTES = 96 << 20      # word rows that a task holds at once
STRETCH = 1 << 16          # words of a text whose windows are compared at once
FOLDS = 5                  # rows of fold 0 are held out: never learned from
BITS = 18                  # 2 ** BITS embedding rows
DIM, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
STEMS = (4, 5, 6)          # bytes
EPOCHS, BATCH, RATE = 6, 32, 0.05
LEAST_STEPS = 600          # few rows get more epochs
LEAST_TEXTS, LEAST_SHARE = 3, 0.003   # texts that a row must occur in to be learned
VALIDATION = 0.25          # share of the labelled rows kept for the thresholds
BLOCKS = 64                # parts of a vector that the tasks' results are summed in
CELLS, LARGEST = 256, 30   # cells of a logit of 1, and the largest logit that has its own
LEAST_FOR_LANGUAGE = 20    # toxic rows in validation from which on a language has its own threshold

# fixed values: frequent function words
FUNCTION_WORDS = {
    "en": "the of and to in is that for was with as on are this by be it at from or an not",
    "fr": "le la les des et est une du dans que pour qui au sur par ne se pas avec il",
    "de": "der die und das ist ein zu den von mit sich des auf für nicht dem im als auch eine",
    "es": "el los de y en que las se por con una del para su al es lo como más",
}
LANGUAGES = tuple(FUNCTION_WORDS)


_SALTS = {n: np.uint64(n * 0x9E3779B97F4A7C15 % 2 ** 64) for n in STEMS}


def _ids(t: Texts, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Embedding rows of each word: the word's own and one per stem length."""
    lead, size = t.lead(start, end), end - start
    out = np.empty((len(start), 1 + len(STEMS)), dtype=np.int32)
    out[:, 0] = t.hashes(start, end) >> np.uint64(64 - BITS)
    for j, n in enumerate(STEMS):
        # a word no longer than the stem is its own stem
        out[:, j + 1] = mix((lead & KEEP[n]) + _SALTS[n]) >> np.uint64(64 - BITS)
    return out


def word_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(embedding rows, text) of the words of a slice of texts."""
    t = Texts(column, lower=True)
    start, end, owner = t.pieces(NON_ALNUM)
    return _ids(t, start, end), owner


def _language_table() -> np.ndarray:
    """Language by embedding row of a function word (-1: none; words of two languages: none)."""
    table = np.full(2 ** BITS, -1, dtype=np.int8)
    for k, lang in enumerate(LANGUAGES):
        rows = word_ids(pa.array(FUNCTION_WORDS[lang].split()))[0][:, 0]
        table[rows] = np.where(table[rows] == -1, k, -2)
    table[table == -2] = -1
    return table


def languages(ids: np.ndarray, owner: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
    """Index into LANGUAGES of each text, len(LANGUAGES) where no function word occurs."""
    of = table[ids[:, 0]] if len(ids) else np.zeros(0, dtype=np.int8)
    seen = of >= 0
    votes = np.bincount(owner[seen] * len(LANGUAGES) + of[seen], minlength=n * len(LANGUAGES)).reshape(n, -1)
    return np.where(votes.max(axis=1, initial=0) > 0, votes.argmax(axis=1), len(LANGUAGES))


@dataclass
class Net:
    """Parameters of the classifier."""

    embedding: np.ndarray
    taps: list            # per width: (width * DIM, FILTERS)
    bias: list            # per width: (FILTERS,)
    out: np.ndarray
    out_bias: float
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES) + 1))
    constant: float | None = None

    @classmethod
    def fresh(cls, seed: int = 0) -> Net:
        rng = np.random.default_rng(seed)
        taps = [rng.normal(0, 0.5, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        return cls(np.zeros((2 ** BITS, DIM), dtype=np.float32), taps,
                   [np.full(FILTERS, 0.05, dtype=np.float32) for _ in WIDTHS],
                   rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), 0.0)

    def windows(self, x: np.ndarray, w: int, k: int) -> np.ndarray:
        """Filter outputs of width w over the rows of x (windows that start at each row)."""
        n = len(x) - w + 1
        h = x[:n] @ self.taps[k][:DIM]
        for j in range(1, w):
            h += x[j:j + n] @ self.taps[k][j * DIM:(j + 1) * DIM]
        return h

    def logits(self, ids: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Logit of each text: pooled over all its words."""
        per = np.bincount(owner, minlength=n)
        full = np.flatnonzero(per)
        first = np.concatenate([[0], np.cumsum(per)])[:-1]
        x = self.embedding[ids[:, 0]]
        for j in range(1, ids.shape[1]):
            x += self.embedding[ids[:, j]]
        pooled = np.zeros((n, len(self.out)), dtype=np.float32)
        for k, w in enumerate(WIDTHS):
            if len(x) < w:
                pooled[:, k * FILTERS:(k + 1) * FILTERS] = np.maximum(self.bias[k], 0)
                continue
            h = np.full((len(x), FILTERS), -np.inf, dtype=np.float32)
            inside = owner[:len(x) - w + 1] == owner[w - 1:]
            h[:len(inside)][inside] = self.windows(x, w, k)[inside]
            top = np.full((n, FILTERS), -np.inf, dtype=np.float32)
            if len(full):
                top[full] = np.maximum.reduceat(h, first[full], axis=0)
            top[np.isneginf(top)] = 0.0              # texts shorter than the filter
            pooled[:, k * FILTERS:(k + 1) * FILTERS] = np.maximum(top + self.bias[k], 0)
        return pooled @ self.out + self.out_bias

    def score(self, logit: np.ndarray, language: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(logit), self.constant)
        z = np.clip(logit.astype(np.float64) - self.thresholds[language], -30, 30)
        return 1 / (1 + np.exp(-z))


class Learner:
    """A net, the sums of squares that Adagrad has seen, and which embedding rows it learns."""

    def __init__(self, learned: np.ndarray, seed: int = 0):
        self.net, self.learned, self.rows = Net.fresh(seed), learned, np.flatnonzero(learned)
        self.seen_e = np.full(len(learned), 0.1, dtype=np.float32)
        self.dense = [*self.net.taps, *self.net.bias, self.net.out]
        self.seen = [np.full_like(p, 0.1) for p in self.dense]

    def vector(self) -> np.ndarray:
        """All that learning changes, as one vector."""
        return np.concatenate([self.net.embedding[self.rows].ravel(), self.seen_e[self.rows],
                               *[p.ravel() for p in (*self.dense, *self.seen)], [self.net.out_bias]]).astype(np.float32)

    def load(self, v: np.ndarray) -> Learner:
        n = len(self.rows)
        self.net.embedding[self.rows] = v[:n * DIM].reshape(n, DIM)
        self.seen_e[self.rows] = v[n * DIM:n * (DIM + 1)]
        at = n * (DIM + 1)
        for p in (*self.dense, *self.seen):
            p[...] = v[at:at + p.size].reshape(p.shape)
            at += p.size
        self.net.out_bias = float(v[at])
        return self

    def peaks(self, text: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Largest output of each filter over a whole text, and where."""
        net, (top, place) = self.net, (np.full(len(self.net.out), -np.inf, dtype=np.float32), np.zeros(len(self.net.out), dtype=np.int64))
        for at in range(0, len(text) - max(WIDTHS) + 1, STRETCH):
            x = net.embedding[text[at:at + STRETCH + max(WIDTHS) - 1]].sum(axis=1)
            for k, w in enumerate(WIDTHS):
                h = net.windows(x, w, k)
                # ties (words not seen yet) are broken at random
                p = (h + rng.random(h.shape, dtype=np.float32) * 1e-4).argmax(axis=0)
                h = h[p, np.arange(FILTERS)]
                cols = np.arange(k * FILTERS, (k + 1) * FILTERS)
                more = h > top[cols]
                top[cols[more]], place[cols[more]] = h[more], p[more] + at
        return top, place

    def learn(self, texts: list[np.ndarray], labels: np.ndarray, class_weight: np.ndarray, epochs: int,
              rng: np.random.Generator) -> None:
        """Pass over texts given as word rows.  Embedding rows that too few texts have stay
        zero: what they would learn is noise."""
        net, weight, n = self.net, class_weight[labels], len(self.dense)
        usable = [i for i, t in enumerate(texts) if len(t) >= max(WIDTHS)]
        for _ in range(epochs):
            order = rng.permutation(usable)
            for at in range(0, len(order), BATCH):
                batch = order[at:at + BATCH]
                found = [self.peaks(texts[i], rng) for i in batch]
                places = np.stack([p for _, p in found])
                pooled = np.maximum(np.stack([t for t, _ in found]) + np.concatenate(net.bias), 0)
                z = np.clip(pooled @ net.out + net.out_bias, -30, 30)
                g = ((1 / (1 + np.exp(-z)) - labels[batch]) * weight[batch] / len(batch)).astype(np.float32)
                up = g[:, None] * net.out * (pooled > 0)
                _step(net.out, pooled.T @ g + 1e-4 * net.out, self.seen[n - 1])
                net.out_bias -= RATE * 0.1 * float(g.sum())
                e_rows, e_grads = [], []
                for k, w in enumerate(WIDTHS):
                    cols = slice(k * FILTERS, (k + 1) * FILTERS)
                    d, p = up[:, cols], places[:, cols]
                    grad = np.zeros_like(net.taps[k])
                    for j in range(w):
                        rows = np.stack([texts[i][p[r] + j] for r, i in enumerate(batch)])     # text, filter, row
                        x = net.embedding[rows].sum(axis=2)
                        part = slice(j * DIM, (j + 1) * DIM)
                        grad[part] = np.einsum("rf,rfd->df", d, x)
                        down = d[:, :, None] * net.taps[k][part].T[None]
                        e_rows.append(rows.reshape(-1))
                        e_grads.append(np.repeat(down.reshape(-1, DIM), rows.shape[2], axis=0))
                    _step(net.taps[k], grad, self.seen[k])
                    _step(net.bias[k], d.sum(axis=0), self.seen[len(WIDTHS) + k])
                rows, inverse = np.unique(np.concatenate(e_rows), return_inverse=True)
                grad = np.zeros((len(rows), DIM), dtype=np.float32)
                np.add.at(grad, inverse, np.concatenate(e_grads))
                grad[~self.learned[rows]] = 0
                self.seen_e[rows] += (grad ** 2).mean(axis=1)
                net.embedding[rows] -= RATE * grad / np.sqrt(self.seen_e[rows])[:, None]


def _step(param: np.ndarray, grad: np.ndarray, seen: np.ndarray) -> None:
    seen += grad ** 2
    param -= RATE * grad / np.sqrt(seen)


def best_threshold(logit: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    """Logit with the best weighted F1, halfway to the next one below."""
    order = np.argsort(-logit, kind="stable")
    z, hit = logit[order], np.cumsum((label * weight)[order])
    f1 = 2 * hit / (np.cumsum(weight[order]) + (label * weight).sum())
    f1[:-1][z[:-1] == z[1:]] = -1                    # equal logits stay together
    i = int(f1.argmax())
    return float((z[i] + z[i + 1]) / 2) if i + 1 < len(z) else float(z[i]) - 1e-6


def _texts(batches, held: tuple[bool, ...]):
    """(word rows of each text, labels) of the rows (y, held, text) on the given sides, in lots
    of at most ``HELD_BYTES`` or one longer text."""
    ids, labels, size = [], [], 0
    for b in batches:
        b = b.filter(pa.array([h in held for h in b.column(1).to_pylist()], pa.bool_()))
        for at, part in slices(b.column(2), 64):
            rows, owner = word_ids(part)
            ends = np.cumsum(np.bincount(owner, minlength=len(part)))
            for i, (lo, hi) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends)):
                if ids and size + rows[lo:hi].nbytes > HELD_BYTES:
                    yield ids, np.array(labels, dtype=np.int64)
                    ids, labels, size = [], [], 0
                ids.append(rows[lo:hi].copy())
                labels.append(b.column(0)[at + i].as_py())
                size += ids[-1].nbytes
    if ids:
        yield ids, np.array(labels, dtype=np.int64)


def _summed(rows: DataFrame, work: Callable, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the vectors (float32) that ``work`` makes of each partition, and how many of them are not
    0 at each place.  Blocks of the vectors are summed in many tasks, in the partitions' order."""
    width = -(-size // BLOCKS)
    kinds = {"block": pa.int32(), "shard": pa.int32(), "total": pa.binary(), "moved": pa.binary()}

    def run(batches):
        v, shard = work(batches), TaskContext.get().partitionId()
        give_back()
        if v is not None:
            parts = [v[at:at + width] for at in range(0, size, width)]
            yield pa.RecordBatch.from_pydict({"block": range(len(parts)), "shard": [shard] * len(parts), "total": [x.tobytes() for x in parts],
                                              "moved": [None] * len(parts)}, pa.schema(kinds))

    def add(batches):
        # a task may hold several blocks; each is a running sum of fixed size
        sums = {}
        for b in batches:
            for block, x in zip(b.column(0).to_pylist(), b.column(2)):
                x = np.frombuffer(x.as_buffer(), dtype=np.float32)
                total, moved = sums.setdefault(block, (np.zeros(len(x)), np.zeros(len(x))))
                total += x
                moved += x != 0
        if sums:
            yield pa.RecordBatch.from_pydict({"block": list(sums), "shard": [0] * len(sums), "total": [t.tobytes() for t, _ in sums.values()],
                                              "moved": [m.tobytes() for _, m in sums.values()]}, pa.schema(kinds))

    schema = "block int, shard int, total binary, moved binary"
    done = (rows.mapInArrow(run, schema).repartition("block").sortWithinPartitions("block", "shard")
            .mapInArrow(add, schema).collect())
    out = np.zeros((2, size))
    for r in done:
        for o, c in zip(out, ("total", "moved")):
            x = np.frombuffer(bytes(r[c]))
            o[r["block"] * width:r["block"] * width + len(x)] = x
    return out[0], out[1]


def _occurrences(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts that have each embedding row, the labelled rows and the usable ones by class; each for
    the rows to train on, then those held back."""
    size = 2 ** BITS + 4

    def work(batches):
        out, any_ = np.zeros((2, size), dtype=np.float32), False
        for b in batches:
            for side in (0, 1):
                for ids, labels in _texts([b], (bool(side),)):
                    any_ = True
                    for t, y in zip(ids, labels):
                        out[side, np.unique(t)] += 1
                        out[side, 2 ** BITS + y] += 1
                        out[side, 2 ** BITS + 2 + y] += len(t) >= max(WIDTHS)
        return out.reshape(-1) if any_ else None

    total = _summed(rows, work, 2 * size)[0].reshape(2, size)
    return total[:, :2 ** BITS], total[:, 2 ** BITS:2 ** BITS + 2], total[:, 2 ** BITS + 2:]


def train(rows: DataFrame, held: tuple[bool, ...], occurs: np.ndarray, classes: np.ndarray, usable: int, shards: int, seed: int = 0) -> Net:
    """Fit a net on the rows (y, held, text) of the given sides, classes weighted equally."""
    context = rows.sparkSession.sparkContext
    learner = Learner(occurs >= max(LEAST_TEXTS, LEAST_SHARE * classes.sum()), seed)
    class_weight = 0.5 * classes.sum() / np.maximum(1, classes)
    rounds, epochs = (ROUNDS, EPOCHS // ROUNDS) if shards > 1 else (1, max(EPOCHS, -(-LEAST_STEPS * BATCH // max(1, usable))))
    vector = learner.vector()
    for round_ in range(rounds):
        start = context.broadcast((vector, learner.learned))

        def work(batches, round_=round_, start=start):
            v, learned = start.value
            own, rng, any_ = Learner(learned, seed).load(v), np.random.default_rng((seed + 1, round_)), False
            for ids, labels in _texts(batches, held):
                own.learn(ids, labels, class_weight, epochs, rng)
                any_ = True
            return own.vector() - v if any_ else None

        step, moved = _summed(rows, work, len(vector))
        vector = (vector + step / np.maximum(1, moved)).astype(np.float32)
        start.unpersist()
    return learner.load(vector).net


def calibrate(net: Net, rows: DataFrame, held: tuple[bool, ...], class_rows: tuple[int, int]) -> None:
    """Set the thresholds from the rows of the given sides.  ``class_rows``: labelled rows of
    class 0 and 1 altogether, which give the classes their weights."""
    shared = rows.sparkSession.sparkContext.broadcast((net, _language_table()))

    def work(batches):
        net, table = shared.value
        for ids, labels in _texts(batches, held):
            for at in range(0, len(ids), 64):            # a few texts at a time: bounds what is held at once
                part = ids[at:at + 64]
                words, owner = np.concatenate(part), np.repeat(np.arange(len(part)), [len(x) for x in part])
                cell = np.rint(np.clip(net.logits(words, owner, len(part)), -LARGEST, LARGEST) * CELLS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(languages(words, owner, len(part), table).astype(np.int32)), pa.array(cell),
                                                  pa.array(labels[at:at + 64].astype(np.int32))], names=["lang", "cell", "y"])
        give_back()

    cells = rows.mapInArrow(work, "lang int, cell int, y int").groupBy("lang", "cell", "y").count().collect()
    shared.unpersist()
    lang, cell, label, count = np.array(sorted(map(tuple, cells)), dtype=np.int64).reshape(-1, 4).T
    n = np.bincount(label, weights=count, minlength=2)
    logit, weight = cell / CELLS, count * np.where(label == 1, class_rows[1] / n[1], class_rows[0] / n[0])
    net.thresholds[:] = best_threshold(logit, label, weight)
    for k in range(len(LANGUAGES)):
        of = lang == k
        if count[of & (label == 1)].sum() >= LEAST_FOR_LANGUAGE and (label[of] == 0).any():
            net.thresholds[k] = best_threshold(logit[of], label[of], weight[of])


def fold(row_id: str):
    """Fold of a row by its id; fold 0 is held out."""
    return F.pmod(F.crc32(F.encode(F.col(row_id).cast("string"), "UTF-8")), F.lit(FOLDS))


def fit_on(docs: DataFrame, labels: DataFrame, row_id: str = "doc_id", text: str = "text", label: str = "toxic",
           seed: int = 0) -> Net:
    """Fit on all labelled rows outside the held-out fold."""
    known = (labels.filter(F.col(row_id).isNotNull() & F.col(label).isin(0, 1) & (fold(row_id) != 0))
             .groupBy(F.col(row_id).alias("id")).agg(F.max(label).cast("int").alias("y")))
    counts = dict(known.groupBy("y").count().collect())
    class_rows = (counts.get(0, 0), counts.get(1, 0))
    shards = max(1, round(sum(class_rows) / SHARD_ROWS))
    constant = Net.fresh(seed)
    constant.constant = class_rows[1] / max(1, sum(class_rows))
    if not all(class_rows):
        return constant
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = docs.select(F.col(row_id).alias("id"), body.alias("text"))
    if texts.schema["id"].dataType == known.schema["id"].dataType:       # equal hashes need equal types
        texts = possible_members(texts, "id", known.select("id"), sum(class_rows))
    held = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)) < int(1000 * VALIDATION)
    rows = cut(texts.join(known.hint("merge"), "id").select("id", "y", held.alias("held"), "text").repartition(shards, "id")
               .sortWithinPartitions("id", "text").select("y", "held", "text"))
    release(docs.sparkSession)               # the shuffled texts are in the checkpoint
    occurs, classes, usable = _occurrences(rows)
    if not classes.sum(axis=0).all():
        return constant
    train_on, check_on = (False,), (True,)
    if not classes.all():                    # too few rows: calibrate on the trained ones
        train_on = check_on = (False, True)
    side = list(map(int, train_on))
    net = train(rows, train_on, occurs[side].sum(axis=0), classes[side].sum(axis=0), int(usable[side].sum()), shards, seed)
    calibrate(net, rows, check_on, class_rows)
    return net


def score_toxicity(df: DataFrame, net: Net, text: str = "text") -> DataFrame:
    """``df`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) of each whole text."""
    shared = df.sparkSession.sparkContext.broadcast((net, _language_table()))

    @F.arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        net, table = shared.value
        out = [np.zeros(0)]
        for _, part in slices(texts, 64):
            ids, owner = word_ids(part)
            out.append(net.score(net.logits(ids, owner, len(part)), languages(ids, owner, len(part), table)))
        return pa.array(np.concatenate(out))

    return (df.drop("score", "predicted").withColumn("score", score(F.col(text).cast("string")))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
