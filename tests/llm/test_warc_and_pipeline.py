import hashlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seatwise.llm import decontamination, neardup, queries, warc
from seatwise.session import scratch_path

from .conftest import SF

PAGE = "page_id long, url string, html string"
BIG = "<p>" + "ü" * 600 + "</p>"


def expected(pages):
    best = {}
    for i, _, h in pages:
        h = (h or "").encode()
        best[h] = max(best.get(h, -1), -1 if i is None else i)
    out = []
    for i, _, h in pages:
        h = (h or "").encode()
        top = best[h]
        again = len(h) >= 1000 and i != top
        out.append((i, len(h), hashlib.sha1(h).hexdigest(), "revisit" if again else "response", top if again else None))
    return Counter(out)


PAGES = [(1, "http://a/x y\nz", BIG), (2, "http://b", BIG), (9, None, BIG), (3, "", None), (4, "http://c", ""),
         (5, "http://d", "a\r\n\r\nWARC/1.1\r\n\r\nb\nfiledesc: x"), (6, "http://e", "small"), (7, "http://f", "small"),
         (None, "http://g", BIG), (8, "http://h", "漢" * 400_000), (10, "http://i", "x" * 999), (11, "http://j", "x" * 999),
         (12, "http://k", "x" * 1000), (13, "http://k", "x" * 1000)]


def test_round_trip_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    cols = "page_id, payload_bytes, payload_digest, record_type, refers_to"
    want = sorted(con.sql(queries.ORACLE_SQL["op9_warc"]).select(cols).fetchall(), key=str)
    assert sorted(map(tuple, queries.op9_warc(spark, SF).select(*cols.split(", ")).collect()), key=str) == want


def test_round_trip_odd_pages(spark):
    pages = spark.createDataFrame(PAGES, PAGE).selectExpr("*", "'own' as record_id", "'own' as payload").repartition(3)
    rows = warc.archive_round_trip(pages).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == expected(PAGES)
    assert warc.archive_round_trip(spark.createDataFrame([], PAGE)).count() == 0


def test_equal_ids_are_separate_records(spark):
    rows = warc.archive_round_trip(spark.createDataFrame([(1, "u", BIG)] * 3, PAGE)).collect()
    assert Counter(r.record_type for r in rows) == {"response": 1, "revisit": 2}
    assert {r.refers_to for r in rows} == {None, 1}


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(spark, version):
    path = scratch_path(spark, "arc-test")
    warc.write_arc(spark.createDataFrame(PAGES, PAGE), path, version=version, records_per_file=3)
    got = {r.page_id: r.payload.decode() for r in warc.read_arc(spark, path, version).collect()}
    assert got == {i: h or "" for i, _, h in PAGES}


def files(spark, path):
    return [f for f in (warc._plain(r.content) for r in warc._files(spark, path).collect()) if f]


def test_archives_open_with_version_block_and_warcinfo(spark, monkeypatch):
    """The query's own archives, seen before they are removed."""
    seen = []
    monkeypatch.setattr(warc, "remove", lambda spark, *paths: seen.extend(paths))
    pages = spark.createDataFrame(PAGES, PAGE).repartition(3)
    assert warc.archive_round_trip(pages).count() == len(PAGES)
    arcs, warcs = (files(spark, path) for path in seen)
    assert {f[:f.index(b"\n", f.index(b"\n") + 1)].rsplit(b"\n", 1)[1] for f in arcs} == {b"1 0 seatwise", b"2 0 seatwise"}
    heads = [h for f in arcs for _, h, _ in warc.arc_records(f, "f")]
    assert len(heads) == len(PAGES) and {len(h) for h in heads} == {5, 10}
    sums = [(h["Checksum"], hashlib.md5(c.partition(b"\r\n\r\n")[2]).hexdigest())
            for f in arcs for _, h, c in warc.arc_records(f, "f") if len(h) == 10]
    assert all(a == b for a, b in sums)
    kinds = [[h["WARC-Type"] for h, _ in warc.warc_records(f, "f")] for f in warcs]
    assert all(k[0] == "warcinfo" and k.count("warcinfo") == 1 for k in kinds)
    infos = [next(warc.warc_records(f, "f")) for f in warcs]
    assert all(warc.SOFTWARE in block.decode() for _, block in infos)
    ids = [h["WARC-Record-ID"] for f in warcs for h, _ in warc.warc_records(f, "f")]
    assert len(set(ids)) == len(ids) == len(PAGES) + len(warcs)


def test_every_part_has_its_version_block(spark):
    path = scratch_path(spark, "arc-test")
    warc.write_arc(spark.range(0, 100, 1, 4).selectExpr("id as page_id", "'u' as url", "'own' as row", "'h' as html"),
                   path, None, records_per_file=7)
    assert sorted(sum(1 for _ in warc.arc_records(f, "f")) for f in files(spark, path)) == [4] * 4 + [7] * 12
    assert sorted(r.page_id for r in warc.read_arc(spark, path).collect()) == list(range(100))


@pytest.mark.parametrize("version", [1, 2])
def test_version_block_names_the_fields(version):
    extra = "200 sum - 0 f.arc " if version == 2 else ""
    body = b"HTTP/1.1 200 OK\r\n\r\nhello\nworld"
    data = warc.arc_version_block(version).encode() + b"\n"
    data += f"http://x/ 1.2.3.4 19990102030405 text/html {extra}{len(body)}\n".encode() + body + b"\n"
    (_, head, content), = warc.arc_records(data, "f")
    assert content == body and head["URL"] == "http://x/" and head["Archive-date"] == "19990102030405"
    assert ("Result-code" in head) == (version == 2)


@pytest.mark.parametrize("data", [b"no header\n", b"http://x 1.1.1.1 20000101000000 text/html 99\nshort", b"a b c d e\nx"])
def test_damaged_arc_is_an_error(data):
    with pytest.raises(ValueError, match="byte 0"):
        list(warc.arc_records(data, "f", 1))


def test_damaged_warc_is_an_error():
    with pytest.raises(ValueError):
        list(warc.warc_records(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n", "f"))


def test_pipeline_run(spark, monkeypatch):
    """run() as it is, and each stage on what the one before kept, against brute force."""
    tables = []

    def seen(stage):
        def call(spark, docs, sf_dir):
            tables.append(docs)
            return stage(spark, docs, sf_dir)
        return call
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, seen(f)) for n, f in corpus_pipeline.STAGES])
    final = corpus_pipeline.run(spark, SF).collect()
    before = [t.collect() for t in tables]
    assert all(t.columns == tables[0].columns for t in tables)
    ids = [Counter(r.doc_id for r in rows) for rows in before]
    assert all(b.keys() <= a.keys() for a, b in zip(ids, ids[1:]))
    # near-duplicates: one document of each class of what the toxicity stage kept
    classes = Counter(r.class_id for r in neardup.near_duplicates(tables[1]).collect())
    assert set(ids[2]) == set(classes) and len(before[2]) < len(before[1])
    # benchmark: exactly the documents without an item
    benchmark = [decontamination.shingle_set(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = lambda t: any(len(q & decontamination.shingle_set(t)) >= 0.8 * len(q) for q in benchmark)
    assert set(ids[3]) == {r.doc_id for r in before[2] if not held(r.text or "")}
    # mixing repeats documents three times at most; sharding places every row
    assert max(ids[4].values()) <= 3
    assert Counter(r.doc_id for r in final) == ids[4]
    slots = {}
    for r in final:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_toxicity_stage_keeps_columns_of_any_name(spark, documents):
    some = documents.limit(30).withColumns({"a.b": F.lit(1), "score": F.lit("own"), "c 0": F.lit(2)})
    out = corpus_pipeline.drop_toxic(spark, some, SF)
    assert out.columns == some.columns
    assert 0 < out.count() <= 30 and {r.score for r in out.collect()} == {"own"}


def test_stages_on_an_empty_table(spark, none):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_stages_handle_odd_rows(spark, odd, clashing):
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, clashing, SF)
        assert out.columns == clashing.columns and out.count() > 0
    assert corpus_pipeline.STAGES[4][1](spark, clashing, SF).count() == odd.count()
