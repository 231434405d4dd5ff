import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from seatwise.llm import queries, spelling

from .conftest import SF

COLS = ["word", "form", "root", "n", "n_near", "form_n"]


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)):] == b[i + (len(b) >= len(a)):]


def counts(rows):
    """Words of rows (id, text) and their counts."""
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def brute(n):
    near = {w: [o for o in n if one_edit(w, o)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select(*COLS).collect()))


def test_matches_sql_and_brute_force(spark, texts):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    rows = got(queries.op13_spelling(spark, SF))
    assert rows == sorted(con.sql(queries.ORACLE_SQL["op13_spelling"]).select(", ".join(COLS)).fetchall())
    assert rows == brute(counts(texts.items()))
    assert sum(r[4] > 0 for r in rows) > 50


def test_odd_rows(odd, clashing, none):
    want = brute(counts([(r.doc_id, r.text) for r in odd.collect()]))
    assert got(spelling.spelling_variants(odd)) == want == got(spelling.spelling_variants(clashing))
    assert spelling.spelling_variants(none).count() == 0


def test_chains_ties_and_long_words(spark):
    long = "ab" * 20_000
    said = {"colour": 5, "coloura": 30, "colourab": 200, "colourabc": 1000, "colourz": 30, "banana": 400, "bananas": 80, "bananan": 16,
            "anananan": 6, "éééééé": 50, "éééééè": 9, long: 50, long + "a": 5, "aaaaaa": 30, "aaaaaaa": 150, "aaaaab": 6}
    text = " ".join(w for w, n in said.items() for _ in range(n))
    docs = spark.createDataFrame([(7, text), (None, None), (8, "")], "doc_id long, text string")
    rows = got(spelling.spelling_variants(docs))
    assert rows == brute(counts([(7, text)]))
    by = {r[0]: r for r in rows}
    assert by["colour"][1:3] == ("coloura", "colourabc")      # a tie (coloura, colourz), then a chain
    assert by[long + "a"][1] == long


def test_hot_posting_lists_are_dealt(spark, monkeypatch):
    """All words share their rarest bigrams: blocks of four words find the same pairs."""
    monkeypatch.setattr(spelling, "BLOCK", 4)
    rng = random.Random(3)
    n = {"".join(rng.choice("ab") for _ in range(rng.choice([6, 7, 8]))): rng.randint(5, 500) for _ in range(150)}
    near = spelling.near_pairs(spark.createDataFrame(list(n.items()), "word string, n long"))
    want = sorted((a, n[a], b, n[b]) for a, b in itertools.permutations(n, 2) if one_edit(a, b))
    assert sorted(map(tuple, near.collect())) == want and len(want) > 300


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9)), min_size=3, max_size=12, unique_by=lambda g: g[0]))
def test_pivots_are_the_cheapest_disjoint_pair(grams):
    prefix = sorted((place, place % 5, weight) for place, weight in grams)
    pairs = [(a, b) for a, b in itertools.combinations(prefix, 2) if b[0] - a[0] >= 2]
    chosen = spelling.choose_pivots(prefix)
    assert len(chosen) == 2 and chosen[1][0] - chosen[0][0] >= 2
    assert sum(g[2] for g in chosen) == min(a[2] + b[2] for a, b in pairs)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=7, max_size=14), st.integers(0, 13), st.sampled_from("abcd-+"), st.randoms(use_true_random=False))
def test_a_near_word_shares_a_pivot_within_the_limits(word, at, edit, rng):
    """The claim that the search rests on, for any order of the bigrams."""
    at %= len(word)
    other = word[:at] + (word[at + 1:] if edit == "-" else "c" + word[at:] if edit == "+" else edit + word[at + 1:])
    grams = sorted({w[i:i + 2] for w in (word, other) for i in range(len(w) - 1)})
    rng.shuffle(grams)
    order = {g: (k, rng.randint(1, 9)) for k, g in enumerate(grams)}
    (la, pa, va), (lb, pb, vb) = spelling.signature(word, order), spelling.signature(other, order)
    if word == other:
        return

    def found(s, pivots, r, prefix):
        return any((g, p + on) in prefix for more, on in spelling.SHIFTS if len(r) - len(s) == more for g, p in pivots)
    assert (lb <= la and found(other, vb, word, pa)) or (la <= lb and found(word, va, other, pb))
