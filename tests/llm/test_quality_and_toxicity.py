import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seatwise.llm import quality, queries, toxicity

from .conftest import LONG, PROSE, SF


def test_quality_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    cols = ["doc_id", *quality.STATS, "base_failed", "kept"]
    want = sorted(con.sql(queries.ORACLE_SQL["op6_quality"]).select(", ".join(cols)).fetchall())
    assert sorted(map(tuple, queries.op6_quality(spark, SF).select(cols).collect())) == want


def test_boilerplate_lines(spark):
    menu = "home about contact imprint and some more words of a menu line"
    body = lambda i: " ".join(f"d{i}w{j}" for j in range(60))
    rows = [(i, f"{menu}\n{body(i)}", "h") for i in range(30)]                  # boilerplate and a body: kept
    rows += [(100 + i, f"{menu}\n" * 6 + f"own {i}", "h") for i in range(5)]      # little else: depleted
    rows += [(200 + i, f"{menu}\n{body(200 + i)}", "other") for i in range(3)]    # too few at that host
    rows += [(300 + i, "\n".join(body(999) for _ in range(1)), "h") for i in range(40)]   # copies are one document
    out = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(out[i].n_removed_words == 12 and out[i].kept for i in range(30))
    assert all(out[100 + i].n_removed_words == 72 and not out[100 + i].kept for i in range(5))
    assert all(out[200 + i].n_removed_words == 0 for i in range(3))
    assert all(out[300 + i].kept for i in range(40))


def test_share_rules_alone_on_a_hot_host(spark):
    """The same line in ten documents: boilerplate up to 5,000 texts of the host, text above;
    on a small host, nine are too few."""
    def host(name, size, held):
        return [(name, f"text {name} {i}" + "\nthe license line" * (i < held)) for i in range(size)]
    rows = host("full", 5000, 10) + host("hot", 5001, 10) + host("hotter", 5500, 11) + host("small", 20, 9)
    out = quality.quality_rules(spark.createDataFrame(rows, "source string, text string"))
    gone = {r.source: (r.n, r.rows) for r in out.filter("n_removed_words > 0").groupBy("source")
            .agg(F.sum("n_removed_words").alias("n"), F.count("*").alias("rows")).collect()}
    assert gone == {"full": (30, 10), "hotter": (33, 11)}


def test_quality_odd_rows(odd, clashing, none):
    out = quality.quality_rules(clashing).collect()
    assert len(out) == odd.count()
    for r in out:
        if not (r.text or "").strip():
            assert r.n_words == 0 and r.base_failed and not r.kept
        if r.text == LONG:
            assert r.n_words == 40_000 and r.n_repeat_words == 0 and r.kept
        if r.text == PROSE:
            assert r.n_words == 300
    assert quality.quality_rules(none).count() == 0


def test_repeated_windows():
    stats = lambda t: quality._statistics(pa.array([t]))[0].as_py()
    assert stats("a a a a")["n_repeat_words"] == 4
    assert stats("a b c x a b c")["n_repeat_words"] == 6
    assert stats("a b")["n_repeat_words"] == 0
    assert stats("q\n\nq \nq\n q")["n_dup_lines"] == 1
    assert stats("é漢 #*")["word_chars"] == 4


@pytest.fixture(scope="module")
def toxic_rows(spark):
    rng = np.random.default_rng(0)
    bad = ["zorgel", "blimpfen", "vaskuu"]
    rows, labels = [], []
    for i in range(600):
        words = [f"w{rng.integers(400)}" for _ in range(60)] + ["the", "of"] * 3
        y = int(i % 4 == 0)
        if y:
            words[10:10] = [bad[i % 3] + f"x{rng.integers(50)}" for _ in range(3)]     # a known stem, a new ending
        rows.append((i, " ".join(words)))
        labels.append((i, y, y))
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_toxicity_held_out(toxic_rows):
    docs, labels = toxic_rows
    net = toxicity.fit_on(docs, labels)
    held = toxicity.score_toxicity(docs, net).join(labels, "doc_id").filter(toxicity.fold("doc_id") == 0).collect()
    assert len(held) > 80
    assert np.mean([(r.score >= 0.5) == (r.toxic == 1) for r in held]) > 0.97
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in held)


def test_held_out_rows_and_other_columns_do_not_matter(toxic_rows, spark):
    docs, labels = toxic_rows
    flipped = labels.selectExpr("doc_id", "quality",
                                "if(pmod(crc32(encode(cast(doc_id as string), 'UTF-8')), 5) = 0, 1 - toxic, toxic) as toxic")
    a, b = toxicity.fit_on(docs, labels), toxicity.fit_on(docs, flipped)
    assert np.array_equal(a.embedding, b.embedding) and np.array_equal(a.out, b.out)
    out = {r.doc_id for r in toxicity.score_toxicity(docs, a).selectExpr("doc_id").collect()}
    assert {i for i in out if zlib.crc32(str(i).encode()) % 5 == 0}


def test_all_labelled_rows_are_learned(toxic_rows, monkeypatch):
    """With more rows than one task learns from, every row of the other folds is still read, and
    the net of several tasks is as good and the same again."""
    docs, labels = toxic_rows
    seen, occurrences = [], toxicity._occurrences
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 120)
    monkeypatch.setattr(toxicity, "_occurrences", lambda rows: seen.append(occurrences(rows)) or seen[-1])
    a, b = toxicity.fit_on(docs, labels), toxicity.fit_on(docs, labels)
    known = labels.filter(toxicity.fold("doc_id") != 0)
    assert seen[0][1].sum(axis=0).tolist() == [known.filter(f"toxic = {y}").count() for y in (0, 1)]
    assert np.array_equal(a.embedding, b.embedding) and np.array_equal(a.thresholds, b.thresholds)
    held = toxicity.score_toxicity(docs, a).join(labels, "doc_id").filter(toxicity.fold("doc_id") == 0).collect()
    assert np.mean([(r.score >= 0.5) == (r.toxic == 1) for r in held]) > 0.95


def test_long_texts_are_learned(spark, monkeypatch):
    """Texts of 5,200 words, compared in stretches: the toxic ones can be told by a word near the end."""
    monkeypatch.setattr(toxicity, "STRETCH", 1000)
    rows = [(i, " ".join(f"w{(i * 7 + j) % 300}" for j in range(5200)) + " zorgel" * (i % 2) + " the of" * 3) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    net = toxicity.fit_on(docs, labels)
    assert net.constant is None
    assert all(r.predicted == r.doc_id % 2 for r in toxicity.score_toxicity(docs, net).collect())


def test_toxicity_odd_rows(odd, clashing, none, toxic_rows):
    net = toxicity.fit_on(*toxic_rows)
    out = toxicity.score_toxicity(clashing, net).collect()
    assert len(out) == odd.count() and all(r.score is not None for r in out)
    assert len({r.score for r in out if not (r.text or "").strip()}) == 1
    assert toxicity.score_toxicity(none, net).count() == 0
    labels = toxic_rows[1]
    for some, share in ((labels.limit(0), 0.0), (labels.filter("toxic = 1"), 1.0)):
        constant = toxicity.fit_on(odd, some)
        assert {r.score for r in toxicity.score_toxicity(odd, constant).collect()} == {share}


def test_query_covers_all_documents(spark, texts):
    rows = queries.op7_toxicity(spark, SF).collect()
    assert Counter(r.doc_id for r in rows) == Counter(list(texts))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_logits_equal_a_plain_forward_pass():
    net = toxicity.Net.fresh(3)
    net.embedding[:] = np.random.default_rng(0).normal(size=net.embedding.shape)
    ids, owner = toxicity.word_ids(pa.array(["one two three four", "", "alone", "two words"]))
    got = net.logits(ids, owner, 4)
    for i in range(4):
        x = net.embedding[ids[owner == i]].sum(axis=1)
        pooled = []
        for k, w in enumerate(toxicity.WIDTHS):
            h = [np.concatenate(x[j:j + w]) @ net.taps[k] for j in range(len(x) - w + 1)]
            pooled.append(np.maximum((np.max(h, axis=0) if h else 0) + net.bias[k], 0))
        assert got[i] == pytest.approx(np.concatenate(pooled) @ net.out + net.out_bias, abs=1e-4)
