"""Quality: a convolutional classifier on the bytes of whole texts, in numpy.

A byte has a learned embedding.  Filters of ``WINDOW`` bytes, every ``STEP`` bytes, run over
the text; each is max-pooled over chunks of ``2 * HALF`` bytes that overlap by half and
together cover the whole text.  A text's features are, for each filter, the greatest and the
mean value of its chunks; a linear layer on them gives one logit and that one probability.
Nothing but the text's bytes enters a score.

The net is trained by Adam on a bounded sample of labelled rows (at most ``MAX_PER_CLASS`` of
a class, each of at most ``MAX_TRAIN_BYTES``) in one task, with hand-written gradients: max
pooling passes a gradient to one window, so a step touches few bytes.  The sample's last part
is kept from training and sets the logit that becomes ``THRESHOLD``: the cut between the
classes with the best balanced accuracy.  Scoring reads whole texts in all tasks, in pieces
of bounded bytes, so a long text takes no more memory than many short ones.

Defined results: a null or empty text has the score of an empty text.  With labels of one
class only, or none, every score is the share of label 1 (0.0 without labels).  Of
contradicting labels of one id the lower wins.  Labels without an id, or not 0 or 1, are left
out.  Equal texts have equal scores.  An empty table gives no rows.  Other columns pass
through; columns that have the names of results are replaced.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .textcore import Texts

MAX_PER_CLASS = 2000        # labelled rows of a class that the fit may use
MAX_TRAIN_BYTES = 20_000    # longer labelled texts are left to scoring (bounds the sample's bytes)
FOLDS, HELD_OUT = 4, 2      # rows of this fold are never learned from
THRESHOLD = 0.7
DIM, FILTERS = 8, 32
STEP = 4
WINDOW = 2 * STEP           # bytes
HALF = 256                  # bytes of half a chunk
PAD = 255                   # a byte that UTF-8 does not use
EPOCHS, BATCH, RATE, DECAY = 6, 16, 0.004, 1e-4
LEAST_STEPS = 400           # a small sample gets more epochs
VALIDATION = 0.2            # share of the sample kept for the threshold
PIECE = 256                 # half chunks that go through the filters at once: 64 KiB of text
SLICE_BYTES = 4 << 20       # text laid out at once, unless one text is longer
WINDOWS = HALF // STEP      # windows that begin in half a chunk


def lay_out(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts ``data[off[i]:off[i + 1]]`` padded to whole half chunks: (bytes, first half chunk
    of each text and the end, length of each text).  A pad of at least STEP bytes follows."""
    size = np.diff(off)
    halves = (size + STEP + HALF - 1) // HALF
    first = np.concatenate([[0], np.cumsum(halves)])
    flat = np.full(first[-1] * HALF + STEP, PAD, dtype=np.uint8)
    at = np.repeat(first[:-1] * HALF - off[:-1], size) + np.arange(off[0], off[-1])
    flat[at] = data[off[0]:off[-1]]
    return flat, first, size


@dataclass
class Net:
    """Parameters of the classifier."""

    embedding: np.ndarray     # 256, DIM
    taps: np.ndarray          # WINDOW * DIM, FILTERS
    bias: np.ndarray          # FILTERS
    out: np.ndarray           # 2 * FILTERS: greatest, mean
    out_bias: float = 0.0
    shift: float = 0.0        # logit that becomes THRESHOLD
    constant: float | None = None

    @classmethod
    def fresh(cls, seed: int = 0) -> Net:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
                   rng.normal(0, (WINDOW * DIM) ** -0.5, (WINDOW * DIM, FILTERS)).astype(np.float32),
                   np.zeros(FILTERS, dtype=np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32))

    def exact(self) -> Net:
        """The net with embedding and taps rounded so that a filter's sum is exact in 32 bits in
        any order (products are multiples of 2^-14, sums stay below 2^10): a text has the same
        score in any company and on any machine."""
        self.embedding = (np.clip(np.round(self.embedding * 64), -256, 256) / 64).astype(np.float32)
        self.taps = (np.clip(np.round(self.taps * 256), -1024, 1024) / 256).astype(np.float32)
        return self

    def halves(self, flat: np.ndarray, first: np.ndarray, size: np.ndarray, places: bool = False):
        """The greatest value of each filter in each half chunk (and the window it is at)."""
        n = int(first[-1])
        top = np.empty((n, FILTERS), dtype=self.taps.dtype)
        at = np.empty((n, FILTERS), dtype=np.int64) if places else None
        # windows that begin in the text, of each half chunk; the first of a text always counts
        inside = -(-np.repeat(size, np.diff(first)) // STEP) - (np.arange(n) - np.repeat(first[:-1], np.diff(first))) * WINDOWS
        inside = np.clip(inside, 0, WINDOWS)
        inside[first[:-1]] = np.maximum(inside[first[:-1]], 1)
        k = STEP * DIM
        for lo in range(0, n, PIECE):
            hi = min(n, lo + PIECE)
            x = self.embedding[flat[lo * HALF:hi * HALF + STEP]].reshape(-1, k)
            h = x[:-1] @ self.taps[:k]
            h += x[1:] @ self.taps[k:]
            h = h.reshape(hi - lo, WINDOWS, FILTERS)
            for i in np.flatnonzero(inside[lo:hi] < WINDOWS):
                h[i, inside[lo + i]:] = -np.inf
            if places:
                at[lo:hi] = h.argmax(axis=1)
                top[lo:hi] = np.take_along_axis(h, at[lo:hi][:, None], axis=1)[:, 0]
            else:
                top[lo:hi] = h.max(axis=1)
        return (top, at) if places else top

    def pooled(self, top: np.ndarray, first: np.ndarray):
        """(features, half chunk of each chunk's value, chunk of the greatest, chunks) of each
        text, from its half chunks; a text of one half chunk is one chunk."""
        n = len(first) - 1
        per = np.maximum(np.diff(first) - 1, 1)
        begin = np.concatenate([[0], np.cumsum(per)])
        lead = np.repeat(first[:-1], per) + np.arange(begin[-1]) - np.repeat(begin[:-1], per)
        after = np.minimum(lead + 1, np.repeat(first[1:], per) - 1)
        from_after = top[after] > top[lead]
        half = np.where(from_after, after[:, None], lead[:, None])
        chunk = np.maximum(np.where(from_after, top[after], top[lead]) + self.bias, 0)
        chunk = chunk.astype(np.float64)
        great = np.maximum.reduceat(chunk, begin[:-1], axis=0) if n else np.zeros((0, FILTERS))
        mean = np.add.reduceat(chunk, begin[:-1], axis=0) / per[:, None] if n else great
        return np.concatenate([great, mean], axis=1), half, chunk, begin

    def logits(self, flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.pooled(self.halves(flat, first, size), first)[0] * self.out).sum(axis=1) + self.out_bias

    def score(self, logit: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(logit), self.constant)
        z = np.clip(logit.astype(np.float64) - self.shift, -30, 30)
        return np.round(1 / (1 + np.exp(-(z + math.log(THRESHOLD / (1 - THRESHOLD))))), 9)

    def gradients(self, flat, first, size, label, weight):
        """(loss, gradients of embedding, taps, bias, out and out_bias) of the weighted log loss."""
        top, at = self.halves(flat, first, size, places=True)
        feats, half, chunk, begin = self.pooled(top, first)
        z = np.clip(feats @ self.out + self.out_bias, -30, 30)
        p = 1 / (1 + np.exp(-z))
        loss = float(-(weight * (label * np.log(p) + (1 - label) * np.log(1 - p))).sum())
        g = ((p - label) * weight).astype(np.float32)
        per = np.diff(begin)
        down = np.repeat(g / per, per)[:, None] * self.out[FILTERS:]       # chunk, filter
        for i in range(len(per)):
            best = begin[i] + chunk[begin[i]:begin[i + 1]].argmax(axis=0)
            down[best, np.arange(FILTERS)] += g[i] * self.out[:FILTERS]
        down = np.where(chunk > 0, down, 0).astype(np.float32)
        c, f = np.nonzero(down)
        d, h = down[c, f], half[c, f]
        start = h * HALF + at[h, f] * STEP
        seen = flat[start[:, None] + np.arange(WINDOW)].astype(np.int64)   # windows that carry a gradient
        x = self.embedding[seen].reshape(len(d), -1)
        taps = np.zeros_like(self.taps)
        for k in range(FILTERS):
            taps[:, k] = d[f == k] @ x[f == k]
        back = (d[:, None] * self.taps.T[f]).reshape(-1, DIM)
        flat_seen = seen.reshape(-1)
        emb = np.stack([np.bincount(flat_seen, weights=back[:, j], minlength=256) for j in range(DIM)], axis=1).astype(np.float32)
        return loss, emb, taps, down.sum(axis=0), feats.T @ g, g.sum()


def train(texts: list[bytes], labels: np.ndarray, seed: int = 0, epochs: int = EPOCHS) -> Net:
    """Fit a net on texts, classes weighted equally."""
    net, rng = Net.fresh(seed), np.random.default_rng(seed + 1)
    params = {k: getattr(net, k) for k in ("embedding", "taps", "bias", "out")}
    out_bias = np.zeros(1, dtype=np.float32)
    m = {k: np.zeros_like(v) for k, v in (params | {"out_bias": out_bias}).items()}
    v = {k: np.zeros_like(x) for k, x in m.items()}
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    rounds, step = max(epochs, -(-LEAST_STEPS * BATCH // len(texts))), 0
    last = rounds * -(-len(texts) // BATCH)
    for _ in range(rounds):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            batch = order[lo:lo + BATCH]
            off = np.concatenate([[0], np.cumsum([len(texts[i]) for i in batch])])
            laid = lay_out(np.frombuffer(b"".join(texts[i] for i in batch), dtype=np.uint8), off)
            _, *grads = net.gradients(*laid, labels[batch], weight[batch] / len(batch))
            step += 1
            rate = RATE * (1 - step / (last + 1))
            for (k, p), grad in zip((params | {"out_bias": out_bias}).items(), grads):
                grad = grad + DECAY * p
                m[k] += 0.1 * (grad - m[k])
                v[k] += 0.001 * (grad ** 2 - v[k])
                p -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
            net.out_bias = float(out_bias[0])
    return net


def best_cut(logit: np.ndarray, label: np.ndarray) -> float:
    """The logit between two neighbours that parts the classes with the best balanced accuracy
    (the middle one of equally good cuts)."""
    order = np.argsort(logit, kind="stable")
    z, y = logit[order].astype(np.float64), label[order]
    good = np.cumsum(y == 0) / max(1, (y == 0).sum()) + (y.sum() - np.cumsum(y)) / max(1, y.sum())
    good[:-1][z[:-1] == z[1:]] = -1                  # equal logits stay together
    at = np.flatnonzero(good == good.max())
    i = int(at[len(at) // 2])
    return float((z[i] + z[i + 1]) / 2) if i + 1 < len(z) else float(z[i]) + 1e-6


def logits_of(net: Net, texts: list[bytes]) -> np.ndarray:
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return net.logits(*lay_out(np.frombuffer(b"".join(texts), dtype=np.uint8), off))


def fit(texts: list[bytes], labels: np.ndarray, class_rows: tuple[int, int], seed: int = 0) -> Net:
    """Train on most of a sample and set the threshold on the rest.  ``class_rows``: labelled
    rows of class 0 and 1 altogether."""
    if len(set(labels.tolist())) < 2:
        net = Net.fresh(seed)
        net.constant = class_rows[1] / max(1, sum(class_rows))
        return net
    held = np.random.default_rng(seed).random(len(labels)) < VALIDATION
    if len(set(labels[~held].tolist())) < 2 or len(set(labels[held].tolist())) < 2:
        held[:] = False                               # too few rows: the threshold is set on the trained ones
    net = train([t for t, h in zip(texts, held) if not h], labels[~held], seed).exact()
    use = held if held.any() else ~held
    net.shift = best_cut(logits_of(net, [t for t, u in zip(texts, use) if u]), labels[use])
    return net


def fold(row_id: str) -> Column:
    """Fold of a row by its id; fold ``HELD_OUT`` is never learned from."""
    return F.pmod(F.crc32(F.encode(F.col(row_id).cast("string"), "UTF-8")), F.lit(FOLDS))


def fit_on(docs: DataFrame, labels: DataFrame, row_id: str = "doc_id", text: str = "text", label: str = "quality",
           seed: int = 0) -> Net:
    """Fit on at most ``MAX_PER_CLASS`` labelled rows of a class outside the held-out fold."""
    known = (labels.filter(F.col(row_id).isNotNull() & F.col(label).isin(0, 1) & (fold(row_id) != HELD_OUT))
             .groupBy(F.col(row_id).alias("id")).agg(F.min(label).cast("int").alias("y")))
    counts = dict(known.groupBy("y").count().collect())
    order = F.xxhash64(F.col("id"), F.lit(seed))
    sample = [known.filter(F.col("y") == y).orderBy(order, "id").limit(MAX_PER_CLASS) for y in (0, 1)]
    # at most 2 * MAX_PER_CLASS rows, so broadcast whatever the corpus
    sample = F.broadcast(sample[0].unionByName(sample[1]))
    body = F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8")
    rows = (docs.select(F.col(row_id).alias("id"), body.alias("body")).filter(F.octet_length("body") <= MAX_TRAIN_BYTES)
            .join(sample, "id").orderBy("id", "body").limit(4 * MAX_PER_CLASS).select("y", "body"))
    class_rows = (counts.get(0, 0), counts.get(1, 0))

    def run(batches):
        y, texts = [], []
        for b in batches:
            y += b.column(0).to_pylist()
            texts += b.column(1).to_pylist()
        net = fit(texts, np.array(y, dtype=np.int64), class_rows, seed)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])

    # the bounded sample is learned in one task; the parameters (about 20 kB) come back
    fitted = rows.repartition(1).mapInArrow(run, "net binary").collect()
    return pickle.loads(bytes(fitted[0]["net"])) if fitted else fit([], np.zeros(0, dtype=np.int64), class_rows, seed)


def score_texts(net: Net, texts: Texts) -> np.ndarray:
    """Score of each text, laid out in groups of at most ``SLICE_BYTES`` (or one longer text)."""
    out, lo, n = [np.zeros(0)], 0, len(texts)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(texts.off, texts.off[lo] + SLICE_BYTES, side="right")) - 1)
        hi = min(hi, n)
        out.append(net.score(net.logits(*lay_out(texts.data, texts.off[lo:hi + 1]))))
        lo = hi
    return np.concatenate(out)


def score_quality(df: DataFrame, net: Net, text: str = "text") -> DataFrame:
    """``df`` with ``score`` (0 to 1) and ``predicted`` (1 from ``THRESHOLD`` on) of each whole text."""
    shared = df.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(score_texts(shared.value, Texts(texts)))

    return (df.drop("score", "predicted").withColumn("score", score(F.col(text).cast("string")))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))
