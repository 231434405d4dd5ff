"""Near-duplicates, lines and contamination against brute force over every pair."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from seatwise.llm import decontamination, linededup, links, neardup, queries, textcore

from .conftest import LONG, PROSE, SF

TOKEN = re.compile(r"[^\x00-/:-@\[-`{-\x7f]+")


def shingles(text):
    w = TOKEN.findall((text or "").lower())
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def classes(rows):
    """Classes of (id, text) rows by weighted Jaccard over every pair."""
    bags = [shingles(t) for _, t in rows]
    df = Counter(s for b in bags for s in b)
    n = sum(1 for b in bags if b)
    w = [{s: (1 + math.log(c)) * min(1, max(0.5, math.log(n / df[s]) / math.log(100))) for s, c in b.items()} for b in bags]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            shared = sum(min(v, w[j][s]) for s, v in w[i].items() if s in w[j])
            whole = sum(w[i].values()) + sum(w[j].values()) - shared
            if rows[i][1] == rows[j][1] or whole and shared / whole >= neardup.THRESHOLD:
                parent[find(i)] = find(j)
    out = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        out[find(i)].append(d)
    return Counter(tuple(sorted(c, key=str)) for c in out.values())


def found_classes(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.class_id].append(r.row_id)
    return Counter(tuple(sorted(c, key=str)) for c in out.values())


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10 ** 6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def planted(spark):
    """Groups of edited copies, a large group among them, and unrelated documents."""
    rng = random.Random(1)
    rows = []
    for g, size in enumerate([150, 12, 5, 2, 2]):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(200)]
        rows += [(len(rows) + k, edited(rng, base, k % 3)) for k in range(size)]
    passage = " ".join(f"shared{i}" for i in range(40))
    rows += [(len(rows) + k, passage + " " + " ".join(f"u{k}x{i}" for i in range(60))) for k in range(60)]
    return rows


def test_near_duplicates_on_documents(spark, documents, texts):
    got = neardup.near_duplicates(documents).collect()
    assert found_classes(got) == classes(list(texts.items()))
    assert sum(r.first for r in got) == len({r.class_id for r in got})
    assert all(r.first == (r.row_id == r.class_id) for r in got)


def test_near_duplicates_on_planted_groups(spark, planted):
    docs = spark.createDataFrame(planted, "doc_id long, text string")
    assert found_classes(neardup.near_duplicates(docs.repartition(5)).collect()) == classes(planted)


def test_near_duplicates_odd_rows(odd, clashing, none):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    of = lambda i: next(r.class_id for r in got if r.row_id == i)
    assert of(1) == of(2) == of(3) == 1
    assert of(7) == of(8) == 7
    assert of(5) == 5 and of(6) == 6          # without a word: equal texts only
    assert of(4) == 4                         # null text, with the null row's
    kept = neardup.deduplicate(clashing).collect()
    assert sorted(r.doc_id or -1 for r in kept) == [-1, 1, 4, 5, 6, 7, 9, 10, 11]
    assert neardup.deduplicate(clashing).columns == clashing.columns
    assert neardup.deduplicate(none).count() == 0


def test_draws_agree_as_often_as_the_sets_are_similar():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2 ** 56, 300, dtype=np.uint64)
    b = a.copy()
    b[220:] = rng.integers(0, 2 ** 56, 80, dtype=np.uint64)
    wa = rng.choice([0.5, 1, 1.7], 300).astype(np.float32)
    wb = rng.choice([0.5, 1, 1.7], 300).astype(np.float32)
    shared = np.minimum(wa, wb)[:220].sum()
    d = neardup.draws(np.concatenate([a, b]), np.array([0, 300]), np.concatenate([wa, wb]), 6000)
    assert (d[:, 0] == d[:, 1]).mean() == pytest.approx(shared / (wa.sum() + wb.sum() - shared), abs=0.02)


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(45)] + [(200 + i, 201 + i) for i in range(40)]
    edges = [(min(e), max(e)) for e in edges if e[0] != e[1]]
    got = {r.id: r.component for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: x for e in edges for x in e}
    while True:
        new = dict(want)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == want:
            break
        want = new
    assert got == want


def test_group_finds_links_that_leaders_miss(spark, monkeypatch):
    # one bucket of 60 members in small blocks; links are neighbours of equal tens digit
    monkeypatch.setattr(links, "BLOCK", 8)
    from pyspark.sql.functions import arrow_udf, col
    import pyarrow as pa
    members = spark.createDataFrame([(1, i) for i in range(60)] + [(2, 5), (2, 17)], "bucket long, id long")

    def verify(pairs):
        return pairs.filter("floor(a / 10) = floor(b / 10) and (b - a) % 3 = 0 or a = 5 and b = 17")

    @arrow_udf(neardup._PAIRS)
    def alike(bucket: pa.Array, lo: pa.Array, hi: pa.Array, m: pa.Array) -> pa.Array:
        out = []
        for a, b, rows in zip(lo.to_pylist(), hi.to_pylist(), m.to_pylist()):
            out.append([{"a": min(x["id"], y["id"]), "b": max(x["id"], y["id"])} for x in rows for y in rows
                        if x["k"] == a and y["k"] == b and x["id"] != y["id"] and x["component"] != y["component"]])
        return pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
    got = defaultdict(set)
    for r in links.group(links.in_buckets(members), verify, lambda ids: ids.withColumn("sketch", col("id")), alike).collect():
        got[r.component].add(r.id)
    want = [{i for i in range(t, t + 10) if (i - t) % 3 == k} for t in range(0, 60, 10) for k in range(3)]
    joined = next(s for s in want if 5 in s) | next(s for s in want if 17 in s)
    want = [s for s in want if 5 not in s and 17 not in s and len(s) > 1] + [joined]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))


# ---- lines -----------------------------------------------------------------------

def removed_lines(rows):
    seen, out = [], {}
    for d, text in sorted(rows):
        for k, line in enumerate(text.split("\n")):
            s = frozenset(shingles(line))
            if s:
                near = any(len(s & o) >= linededup.THRESHOLD * len(s | o) for o in seen)
                out[d, k] = "copy" if s in seen else "near" if near else None
                if s not in seen:
                    seen.append(s)
    return out


def test_lines_match_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    cols = "doc_id, n_lines, n_copies, n_near"
    want = sorted(con.sql(queries.ORACLE_SQL["op3_linededup"]).select(cols).fetchall())
    assert sorted(map(tuple, queries.op3_linededup(spark, SF).select(*cols.split(", ")).collect())) == want


def test_lines_with_a_hot_group(spark):
    rng = random.Random(5)
    hot = [f"h{i}" for i in range(60)]
    rows = [(i, "\n".join([edited(rng, hot, rng.randrange(4)), " ".join(f"l{i}w{rng.randrange(9)}" for _ in range(20)),
                           "one short line", "#" * (i % 3)])) for i in range(120)]
    # tokens shared by lines that are no matches: the same rare start, other ends
    rows += [(500 + i, "rare start of a line " + " ".join(f"e{i}x{j}" for j in range(12))) for i in range(40)]
    got = linededup.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {(r.doc["id"], r.line_no): r.reason for r in got} == removed_lines(rows)


def test_prefix_length_is_never_short():
    for n in range(1, 200):
        p = int(linededup.prefix_length(np.array([n]))[0])
        assert 1 <= p <= n and n - p + 1 >= linededup.THRESHOLD * n - 1e-6


def test_lines_odd_rows(odd, clashing, none):
    out = linededup.dedup_lines(clashing)
    assert out.columns == clashing.columns
    rows = out.collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r.text for r in rows if r.doc_id is not None}
    assert by_id[1] == PROSE and by_id[2] == "" and by_id[3] == ""        # a copy, and a near copy
    assert by_id[4] is None and by_id[6] == " \n\t " and by_id[9] == LONG
    assert by_id[7] == "two words" and by_id[8] == ""
    assert linededup.line_report(none).count() == 0
    assert linededup.line_report(odd).count() == len(set((r.doc_id, r.text) for r in odd.collect()))


def test_many_lines_in_one_text(spark):
    lines = [f"line number {i} of one very long text {i % 1000}" for i in range(9000)] + ["line number 5 of one very long text 5"]
    got = linededup.duplicate_lines(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")).collect()
    assert len(got) == 9001 and sum(r.reason == "copy" for r in got) == 1


def test_posting_lists_move_tokens_once(spark):
    rng = random.Random(11)
    # lists of one set (copies among them), of several, and one that most rows are in, over batch ends
    rows = [(i, 9, sorted({rng.randrange(900) for _ in range(4)} | ({-1} if i % 3 else set()))) for i in range(300)]
    rows = [(i, n, t) for i, n, t in rows for _ in range(1 + i % 3)]
    lines = spark.createDataFrame(rows, "id long, n int, prefix array<long>")
    held = defaultdict(dict)
    for i, n, tokens in rows:
        for k, t in enumerate(tokens):
            held[t][i] = (n, k)
    want = sorted((t, i, len(m), *x) for t, m in held.items() if len(m) > 1 for i, x in m.items())
    got = linededup.postings_of(lines)
    assert sorted(map(tuple, got.select("bucket", "id", "n", "size", "pos").collect())) == want
    for size in (1, 2, 7, 5000):
        flat = sorted((t, i, n, k) for i, n, tokens in rows for k, t in enumerate(tokens))
        rng.shuffle(flat)
        flat.sort(key=lambda r: r[0])
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*flat[j:j + size])], names=["bucket", "id", "size", "pos"])
                   for j in range(0, len(flat), size)]
        out = [r for b in linededup.in_several(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))]
        assert {(t, i) for t, i, *_ in out} == {(t, i) for t, i, *_ in want}


def test_only_wanted_lines_leave_the_texts(spark):
    texts = ["a\n\nb", None, "", "one\n", "é\n\x1cx\r\ny"]
    flags = spark.sparkContext.broadcast(np.full(1 << 23, 255, dtype=np.uint8))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").repartition(2)
    got = {r.i: [tuple(x) for x in r.l] for r in docs.select("i", linededup._lines_in(flags)("t", "i").alias("l")).collect()}
    assert got == {i: list(enumerate(t.split("\n"))) if t is not None else [] for i, t in enumerate(texts)}
    one = np.zeros(1 << 23, dtype=np.uint8)
    one[(8 ^ 2) >> 3] |= 1 << ((8 ^ 2) & 7)
    flags = spark.sparkContext.broadcast(one)
    docs = spark.createDataFrame([(8, "a\nb\nc\nd"), (9, "a\nb")], "i long, t string")
    got = {r.i: [tuple(x) for x in r.l] for r in docs.select("i", linededup._lines_in(flags)("t", "i").alias("l")).collect()}
    assert got == {8: [(2, "c")], 9: []}


def test_words_of_lines():
    for line in ("", "#-# ", "a", "Two words", "a b c d e", "A-b_c d\te f\u00a0g \u4e2d\u3000x \u0130 \x85 \x1c h \x7f i", "r " * 30):
        w = TOKEN.findall(line.lower())
        assert linededup.line_set(line) == ({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())


# ---- benchmark ---------------------------------------------------------------------

def test_contamination_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cols = "doc_id, item_id, item_shingles, shared"
    want = sorted(con.sql(queries.ORACLE_SQL["op2_decontamination"]).select(cols).fetchall())
    assert want and sorted(map(tuple, queries.op2_decontamination(spark, SF).select(*cols.split(", ")).collect())) == want


def test_contamination_of_every_size(spark):
    rng = random.Random(7)
    items, docs = [], []
    for i, n in enumerate([1, 3, 4, 5, 6, 12, 29, 40, 90, 400]):
        words = [f"i{i}w{j}" for j in range(n)]
        items.append((i, " ".join(words)))
        filler = [f"f{i}x{j}" for j in range(3000)]
        docs.append((10 * i, " ".join(filler[:1500] + words + filler[1500:])))                 # whole
        docs.append((10 * i + 1, " ".join(filler[:50] + words[: len(words) // 2])))            # half: not contaminated
        some = [w if rng.random() > 0.01 else "changed" for w in words]
        docs.append((10 * i + 2, " ".join(filler[50:60] + some)))                              # maybe
        docs.append((10 * i + 3, " ".join(words).upper() + "!"))                               # other case and marks
    want = set()
    for d, text in docs:
        for i, item in items:
            s, q = set(shingles(text)), set(shingles(item))
            if len(s & q) >= decontamination.THRESHOLD * len(q):
                want.add((d, i))
    found = decontamination.find_contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                                              spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc["id"], r.item_id) for r in found} == want
    assert len(want) >= 17


def test_least_hits_miss_rarely():
    assert [decontamination.least_hits(n) for n in (1, 5, 24)] == [1, 4, 20]
    hits = decontamination.least_hits(1000)
    miss = sum(math.comb(24, k) * 0.8 ** k * 0.2 ** (24 - k) for k in range(hits))
    assert miss <= decontamination.MISS < miss + math.comb(24, hits) * 0.8 ** hits * 0.2 ** (24 - hits)


def test_two_size_classes(spark):
    """Up to the sketch's length the sketch is the item; above, one number of hits for all sizes."""
    sizes = [1, 5, 24, 25, 60, 3000]
    items = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n + 4 * (n > 1)))) for n in sizes], "item_id long, text string")
    sketches = decontamination.item_sketches(items)
    assert sketches.columns == ["item", "n", "least", "hash"]
    rows = sketches.groupBy("n", "least").count().collect()
    above = decontamination.least_hits(10 ** 6)
    assert sorted(map(tuple, rows)) == [(1, 1, 1), (5, 4, 5), (24, 20, 24), *[(n, above, 24) for n in (25, 60, 3000)]]


def test_contamination_odd_rows(spark, odd, clashing, none):
    items = spark.createDataFrame([(1, PROSE), (1, PROSE), (None, "two words"), (2, None), (3, ""), (4, LONG)], "item_id long, text string")
    found = decontamination.find_contaminated(odd, items).collect()
    assert sorted(((r.doc["id"], r.item_id) for r in found), key=str) == sorted(
        [(1, 1), (2, 1), (3, 1), (7, None), (8, None), (9, 4)], key=str)
    clean = decontamination.decontaminate(clashing, items)
    assert clean.columns == clashing.columns
    assert sorted(r.doc_id or -1 for r in clean.collect()) == [-1, -1, 4, 5, 6, 10, 11]
    assert decontamination.decontaminate(odd, items.limit(0)).count() == odd.count()
    assert decontamination.decontaminate(none, items).count() == 0


def test_size_partitions(spark):
    """Each item has its partition's sketch and least hits, and items of every partition are
    found at the threshold in documents of any size that can hold them, not below it."""
    words = lambda tag, n: [f"{tag}x{i}" for i in range(n)]
    sizes = [1, 6, 24, 25, 64, 65, 256, 257, 900]
    texts = {n: words(f"i{n}", n + 4) for n in sizes}
    items = spark.createDataFrame([(n, " ".join(w)) for n, w in texts.items()], "item_id long, text string")
    seen = {}
    for r in decontamination.partitioned_sketches(items).collect():
        assert r.n == r.item.id
        seen.setdefault(r.n, []).append(r)
    for n, rows in seen.items():
        part = max(p for p, (least, _) in enumerate(decontamination.PARTITIONS) if least <= n)
        least, kept = decontamination.PARTITIONS[part]
        assert {r.part for r in rows} == {part} and len({r.hash for r in rows}) == len(rows) == min(n, kept)
        assert {r.least for r in rows} == {decontamination.least_hits(n, sketch=kept)}
    docs, want = [], set()
    for n, w in texts.items():
        need = math.ceil(0.8 * n)                         # shingles a document must hold
        for j, size in enumerate((need, need - 1, n)):
            if size < 1:
                continue
            part = w[:size + 4]
            for k, long in enumerate((0, 3000)):          # alone, and inside a long text
                doc = n * 10 + j * 2 + k
                docs.append((doc, " ".join(words(f"d{doc}", long) + part + words(f"e{doc}", long))))
                if size >= 0.8 * n:
                    want.add((doc, n, size))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r.doc.id, r.item_id, r.shared) for r in decontamination.find_contaminated(docs, items).collect()}
    assert found == want


def test_popular_item(spark):
    text = " ".join(f"p{i}" for i in range(40))
    docs = spark.range(3000).selectExpr("id as doc_id", f"concat('w', id, ' {text} v', id) as text")
    items = spark.createDataFrame([(1, text), (2, text + " q")], "item_id long, text string")
    found = decontamination.find_contaminated(docs, items)
    assert found.count() == 6000 and found.select("doc").distinct().count() == 3000


def test_similarity_of_pairs_of_lines():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(12)] + ["İ", "É", "αΣ", " x", "中", "Ab", "-", "\x1c", "\x85", "#"]
    lines = ["", " ", "-", "a", "A", "a b c d", "a  b-c d E"] + [" ".join(rng.choice(words) for _ in range(rng.randrange(25))) for _ in range(80)]
    a = [rng.choice(lines) for _ in range(600)]
    b = [rng.choice([rng.choice(lines), x + " tail", x.upper(), x]) for x in a]
    sets = [(linededup.line_set(x), linededup.line_set(y)) for x, y in zip(a, b)]
    want = [len(x & y) / max(1, len(x | y)) for x, y in sets]
    assert linededup.jaccards(pa.array(a), pa.array(b)).tolist() == want
    assert linededup.jaccards(pa.array([], pa.string()), pa.array([], pa.string())).tolist() == []


def test_line_report_of_repeated_rows(spark):
    rows = [(1, "one two\nthree four\none two"), (2, "one two\nfive six"), (2, "five six"), (None, "one two"), (3, None), (4, "")]
    once = spark.createDataFrame(rows, "doc_id long, text string")
    many = spark.createDataFrame([r for i, r in enumerate(rows) for _ in range(1 + i % 3)], once.schema).repartition(3)
    want = sorted(map(str, linededup.line_report(once).collect()))
    assert len(want) == 6 and sorted(map(str, linededup.line_report(many).collect())) == want


def test_tokens_of_lines_cross_to_python_in_lists_only(spark):
    lines = spark.createDataFrame([(1, 9, [5, 6]), (2, 9, [6])], "id long, n int, prefix array<long>")
    asked = []
    linededup.cut, cut = lambda df: asked.append(df._jdf.queryExecution().executedPlan().toString()) or df, linededup.cut
    try:
        linededup.postings_of(lines)
    finally:
        linededup.cut = cut
    assert "Window" in asked[0] and "MapInArrow" not in asked[0]       # a row of each token is what took the time


def test_words_and_hashes_of_texts():
    rng = random.Random(3)
    for _ in range(200):
        texts = ["".join(rng.choice("ab \n-é\x1c") for _ in range(rng.choice([0, 3, 12, 300]))) for _ in range(rng.randrange(6))]
        t = textcore.Texts(pa.array(texts, pa.string()))
        start, end, owner = t.pieces(textcore.NON_ALNUM)
        got = [(int(o), t.data[s:e].tobytes().decode()) for s, e, o in zip(start, end, owner)]
        assert got == [(i, w) for i, x in enumerate(texts) for w in re.findall(r"[abé]+", x)]
        h = t.hashes(start, end).tolist()
        assert len({(w, x) for (_, w), x in zip(got, h)}) == len(set(h)) == len({w for _, w in got})
