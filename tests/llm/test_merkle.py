import hashlib
import zlib

import duckdb
from pyspark.sql import functions as F

from seatwise.llm import merkle, queries

from .conftest import SF


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    """All levels of a list of hashes."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        at = levels[-1]
        levels.append([sha(*at[i:i + 8]) for i in range(0, len(at), 8)])
    return levels


def way(levels, pos):
    out = []
    for level in levels[:-1]:
        lo = pos // 8 * 8
        out.append(("".join(level[lo:pos]), "".join(level[pos + 1:lo + 8])))
        pos //= 8
    return out


def brute(rows):
    """(doc_id, leaf, subroot, root, proof) of rows (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is None, r[0] or 0, leaf(r), r))
    langs = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(by[g], key=lambda x: x[:3])]) for g in langs}
    top = tree([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for pos, x in enumerate(sorted(by[g], key=lambda x: x[:3])):
            w = way(trees[g], pos) + way(top, k)
            out.append((x[3][0], x[2], trees[g][-1][0], top[-1][0], sha(*[a + b for a, b in w])))
    return sorted(out, key=repr)


def result(docs):
    m = merkle.manifest(docs)
    rows = m.leaves.select("id", merkle.as_text(F.col("leaf")), "subroot", F.lit(m.root), merkle.proof_digest(F.col("way"))).collect()
    return sorted(map(tuple, rows), key=repr)


def fields(docs):
    return [tuple(r) for r in docs.select(*merkle.FIELDS).collect()]


def test_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    out = queries.op12_merkle(spark, SF)
    want = con.sql(queries.ORACLE_SQL["op12_merkle"]).select(", ".join(out.columns)).fetchall()
    got = sorted(map(tuple, out.collect()))
    assert got == sorted(want)
    held = {r[0]: r[-1] for r in got}
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for i, t in text.items():
        changed = zlib.crc32(str(i).encode()) % 3 == 0 and any("A" <= c <= "Z" for c in t or "")
        assert held[i] != changed
    assert not all(held.values()) and any(held.values())


def test_odd_rows(odd, clashing):
    want = brute(fields(odd))
    assert result(odd) == want == result(clashing)


def test_run_sizes(spark):
    """Groups of 1, 7, 8, 9, 64, 65 and 513 rows, and more than eight groups: full and short
    last runs, even of one node, at several levels."""
    sizes = [1, 7, 8, 9, 64, 65, 513, 1, 2, 3]
    rows = [(g * 1000 + i, "s", f"l{g}", i, f"Text {g} {i}") for g, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert result(docs) == brute(rows)


def test_one_row_and_none(spark, none):
    one = spark.createDataFrame([(1, "s", "en", 3, "abc")], "doc_id long, source string, lang string, n_chars long, text string")
    assert result(one) == brute(fields(one))
    m = merkle.manifest(none)
    assert m.root is None and m.leaves.count() == 0 and m.groups.count() == 0
    assert merkle.verify(m.leaves, m.root).count() == 0


def test_a_change_anywhere_is_seen(spark, documents):
    m = merkle.manifest(documents)
    other = merkle.manifest(documents.withColumn("source", F.when(F.col("doc_id") == 17, F.lit("else")).otherwise(F.col("source"))))
    assert other.root != m.root
    lang = documents.filter("doc_id = 17").first().lang
    moved = m.groups.alias("a").join(other.groups.alias("b"), "grp").filter("a.subroot <> b.subroot").collect()
    assert [r.grp for r in moved] == [lang]
    assert merkle.verify(m.leaves, m.root).filter("not verified").count() == 0
    assert merkle.verify(m.leaves, other.root).filter("verified").count() == 0


def test_places_do_not_depend_on_partitions(documents):
    assert merkle.manifest(documents.repartition(7)).root == merkle.manifest(documents.repartition(2)).root
