import zlib

import numpy as np
import pyarrow as pa
import pytest

from seatwise.llm import bytequality, queries
from seatwise.llm.textcore import Texts

from .conftest import LONG, SF


def plain_logit(net, text):
    """One text, window by window and chunk by chunk."""
    data = list(text) + [bytequality.PAD] * (2 * bytequality.HALF)
    halves = []
    for lo in range(0, (len(text) + bytequality.STEP + bytequality.HALF - 1) // bytequality.HALF * bytequality.HALF, bytequality.HALF):
        top = np.full(bytequality.FILTERS, -np.inf)
        for at in range(lo, lo + bytequality.HALF, bytequality.STEP):
            if at < max(1, len(text)):
                x = np.concatenate([net.embedding[b] for b in data[at:at + bytequality.WINDOW]])
                top = np.maximum(top, x.astype(float) @ net.taps)
        halves.append(top)
    chunks = [np.maximum(a, b) for a, b in zip(halves, halves[1:])] or halves
    chunks = [np.maximum(c + net.bias, 0) for c in chunks]
    return np.concatenate([np.max(chunks, axis=0), np.mean(chunks, axis=0)]) @ net.out + net.out_bias


TEXTS = [b"", b"a", b"abcd", b"x" * 251, b"y" * 252, b"z" * 253, b"q" * 256, bytes(range(128)) * 9, "é漢\U0001f600 mixed ".encode() * 70]


def some_net():
    net = bytequality.Net.fresh(5)
    net.bias[:] = np.linspace(-0.2, 0.2, bytequality.FILTERS)
    net.out_bias = 0.3
    return net.exact()


def test_forward_pass_is_the_plain_one(monkeypatch):
    net = some_net()
    want = [plain_logit(net, t) for t in TEXTS]
    assert np.allclose(bytequality.logits_of(net, TEXTS), want, atol=1e-4)
    monkeypatch.setattr(bytequality, "PIECE", 2)           # half chunks of a text fall into several pieces
    assert np.allclose(bytequality.logits_of(net, TEXTS), want, atol=1e-4)
    column = Texts(pa.array([t.decode() for t in TEXTS] + [None]))
    whole = bytequality.score_texts(net, column)
    monkeypatch.setattr(bytequality, "SLICE_BYTES", 300)   # and texts into several slices
    assert np.array_equal(bytequality.score_texts(net, column), whole) and len(whole) == len(TEXTS) + 1
    assert whole[-1] == pytest.approx(whole[0])


def test_gradients_are_those_of_the_loss():
    net = some_net()
    for k in ("embedding", "taps", "bias", "out"):
        setattr(net, k, getattr(net, k).astype(np.float64))
    texts, y, w = TEXTS[1:], np.array([0, 1, 0, 1, 1, 0, 1, 0]), np.linspace(0.5, 1.5, 8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    laid = bytequality.lay_out(np.frombuffer(b"".join(texts), dtype=np.uint8), off)
    _, *grads = net.gradients(*laid, y, w)
    rng = np.random.default_rng(0)
    for name, grad in zip(("embedding", "taps", "bias", "out"), grads):
        p = getattr(net, name)
        for _ in range(12):
            i = tuple(rng.integers(0, n) for n in p.shape)
            kept, eps = p[i], 1e-6
            p[i] = kept + eps
            up = net.gradients(*laid, y, w)[0]
            p[i] = kept - eps
            down = net.gradients(*laid, y, w)[0]
            p[i] = kept
            assert (up - down) / (2 * eps) == pytest.approx(grad[i], abs=1e-3, rel=1e-3), (name, i)


def test_held_out_rows_are_told_apart(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = queries.op11_quality_classifier(spark, sf).collect()
    held = [r for r in out if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    good, bad = ([r.predicted for r in held if labels[r.doc_id] == y] for y in (1, 0))
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.1
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_held_out_labels_are_never_read(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", (bytequality.fold("doc_id") == 2).cast("int") * (1 - labels.quality)
                               + (bytequality.fold("doc_id") != 2).cast("int") * labels.quality)
    a, b = bytequality.fit_on(documents, labels), bytequality.fit_on(documents, turned)
    assert all(np.array_equal(getattr(a, k), getattr(b, k)) for k in ("embedding", "taps", "bias", "out"))


def test_odd_rows(spark, odd, clashing, none):
    net = some_net()
    out = bytequality.score_quality(clashing, net).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    empty = {r.score for r in out if not r.text}
    assert len(empty) == 1
    assert len({r.score for r in out if r.text == LONG}) == 1
    assert bytequality.score_quality(none, net).count() == 0
    few = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    for labels, share in ((few.filter("doc_id = 2"), 1.0), (few.limit(0), 0.0)):
        got = {r.score for r in bytequality.score_quality(odd, bytequality.fit_on(odd, labels)).collect()}
        assert got == {share}


def test_slices_are_bounded_by_bytes(monkeypatch):
    """256 texts of 100 kB: what is handled at once stays small, and nothing is left out."""
    import tracemalloc

    from seatwise.llm import quality, textcore
    from seatwise.llm.frequencies import text_shingles

    text = " ".join(f"w{i % 5000}" for i in range(18_000))
    column = pa.array([text] * 256 + [None, "", "x" * (3 << 20)])
    parts = list(textcore.slices(column))
    assert [p for _, part in parts for p in part.to_pylist()] == column.to_pylist()
    assert [at for at, _ in parts] == np.cumsum([0, *[len(p) for _, p in parts[:-1]]]).tolist()
    assert all(len(p) == 1 or sum(len(x or "") for x in p.to_pylist()) <= textcore.SLICE_BYTES for _, p in parts)
    assert max(len(p) for _, p in textcore.slices(pa.array(["a"] * 1000))) == textcore.SLICE
    beside = [len(p) for _, p in textcore.slices(pa.array(["a"] * 40), beside=pa.array([text] * 40))]
    assert sum(beside) == 40 and max(beside) <= textcore.SLICE_BYTES // len(text)
    tracemalloc.start()
    for _, part in textcore.slices(column.slice(0, 256)):
        text_shingles(part)
        quality._statistics(part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
