import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from seatwise.llm import mixing, queries, sharding

from .conftest import SF


def best_fit_by_hand(sizes, capacity):
    room, where = [], []
    for s in sizes:
        fits = [(r, i) for i, r in enumerate(room) if r >= s]
        if not fits:
            room.append(max(capacity, s))
            fits = [(room[-1], len(room) - 1)]
        i = min(fits)[1]
        room[i] -= s
        where.append(i)
    return where, len(room)


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_decreasing(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.choice([1, 2, 5, 40, 60, rng.randrange(1, 90)]) for _ in range(400)), reverse=True)
    assert sharding.best_fit_decreasing(sizes, 100) == best_fit_by_hand(sizes, 100)


def test_pack_uses_the_least_capacity():
    sizes = sorted([7, 7, 6, 5, 5, 4, 4, 3, 2, 2], reverse=True)
    where = sharding.pack(sizes, 3)
    load = Counter()
    for s, w in zip(sizes, where):
        load[w] += s
    least = next(c for c in range(15, 46) if best_fit_by_hand(sizes, c)[1] <= 3)      # 15: a third of the sum
    assert set(load) <= {0, 1, 2} and max(load.values()) <= least == 16


def check_shards(rows, text_of):
    slots, shard_of = defaultdict(list), defaultdict(set)
    for r in rows:
        t = text_of(r) or ""
        assert r.size == len(t.encode()) + 8 and r.text_crc32 == zlib.crc32(t.encode())
        slots[r.shard].append(r.slot)
        shard_of[t].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shard_of.values())


def test_shards_of_documents(spark, texts):
    rows = queries.op5_sharding(spark, SF).collect()
    assert Counter(r.doc_id for r in rows) == Counter(list(texts))
    check_shards(rows, lambda r: texts[r.doc_id])
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    mean = sum(load.values()) / 24
    assert len(load) == 24 and max(load.values()) < 1.1 * mean and {r.law for r in rows} == {"bytes"}


def test_shards_of_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE", 20)
    rows = [(i % 900, f"text {i % 300}") for i in range(2000)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 7).collect()
    assert len(out) == 2000
    check_shards(out, lambda r: r.text)


@pytest.mark.parametrize("part,fine", [(50, 256), (50, 4), (7, 2), (10 ** 6, 8)])
def test_groups_are_packed_in_levels(spark, monkeypatch, part, fine):
    """Boxes of every part are the best fit of its groups by hand, at each level, and the shards
    that of the last boxes, whatever the number of levels."""
    monkeypatch.setattr(sharding, "PART", part)
    monkeypatch.setattr(sharding, "FINE", fine)
    levels, boxes = [], sharding._boxes
    monkeypatch.setattr(sharding, "_boxes", lambda items, n, capacity: levels.append((capacity, boxes(items, n, capacity))) or levels[-1][1])
    rng = random.Random(part * fine)
    sizes = {f"{i:04d}": rng.choice([9, 9, 12, 40, rng.randrange(8, 400), 3000]) for i in range(900)}
    groups = spark.createDataFrame(list(sizes.items()), "item string, size long")
    placed = {r.item: r.shard for r in sharding._place(groups, 900, sum(sizes.values()), 5).collect()}
    assert placed.keys() == sizes.keys() and set(placed.values()) <= set(range(5))
    inside, load = dict(sizes), Counter()
    for capacity, level in levels:
        by_part, size = defaultdict(list), Counter()
        for r in level.collect():
            assert inside[r.item] == r.size
            by_part[r.box.split(".")[0]].append(r)
            size[r.box] += r.size
        assert sum(map(len, by_part.values())) == len(inside)
        for rows in by_part.values():
            rows.sort(key=lambda r: (-r.size, r.item))
            where, _ = best_fit_by_hand([r.size for r in rows], capacity)
            assert [int(r.box.split(".")[1]) for r in rows] == where
        inside = dict(size)
    assert len(inside) <= 4 * fine * 5 and (len(levels) > 1) == ((part, fine) == (7, 2))
    for g, s in sizes.items():
        load[placed[g]] += s
    last = sorted(inside.values(), reverse=True)
    want = Counter()
    for s, w in zip(last, sharding.pack(last, 5)):
        want[w] += s
    assert sorted(load.values()) == sorted(want.values())


def test_shards_odd_rows(odd, clashing, none):
    out = sharding.shard(clashing, 3)
    rows = out.collect()
    assert len(rows) == odd.count() and dict(out.dtypes)["key"] == "string" and dict(out.dtypes)["slot"] == "bigint"
    check_shards(rows, lambda r: r.text)
    assert sharding.shard(none, 3).count() == 0


# ---- mixing ----------------------------------------------------------------------

def targets_by_hand(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(out.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * sizes[s]
            free.discard(s)


def check_mix(rows, sizes, source_of, tolerance=0.02):
    total = Counter()
    for r in rows:
        total[source_of(r)] += r.size
    want = targets_by_hand(total)
    taken = Counter()
    for r in rows:
        s = source_of(r)
        assert r.source_size == total[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    largest = Counter()
    for r in rows:
        largest[source_of(r)] = max(largest[source_of(r)], r.size)
    for s in total:
        assert abs(taken[s] - want[s]) <= max(tolerance * want[s], largest[s])


def test_mix_of_documents(spark, documents, texts):
    source = {r.doc_id: r.source for r in documents.collect()}
    rows = queries.op10_mixing(spark, SF).collect()
    assert Counter(r.doc_id for r in rows) == Counter(list(texts))
    check_mix(rows, texts, lambda r: source[r.doc_id])
    again = mixing.mix_plan(documents.repartition(7)).collect()
    assert {(r.doc_id, r.taken) for r in rows} == {(r.row_id, r.taken) for r in again}


def test_mix_of_skewed_sources_in_levels(spark):
    rng = np.random.default_rng(2)
    n = rng.integers(0, 60, 6000)
    rows = [(i, "w " * int(n[i]), "hot" if i % 3 else f"s{i % 40}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix_plan(docs, block=64).collect()
    source = {i: s for i, _, s in rows}
    check_mix(plan, None, lambda r: source[r.row_id], tolerance=0.002)
    # document totals are balanced as well: the expected number of copies, within the landing
    hot = [r for r in plan if source[r.row_id] == "hot"]
    ratio = hot[0].target / hot[0].source_size
    assert abs(sum(r.copies for r in hot) - ratio * len(hot)) < 4


def test_flight_keeps_the_balance():
    rng = np.random.default_rng(0)
    pi, size = rng.random(500), rng.integers(1, 1000, 500).astype(float)
    out = mixing.flight(pi, size, rng.random(500))
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(pi.sum()) and (out * size).sum() == pytest.approx((pi * size).sum())
    landed = mixing.landing(out, size, rng.random(500))
    assert set(landed) <= {0.0, 1.0} and abs((landed * size).sum() - (pi * size).sum()) <= size.max()


def test_flight_hits_the_probabilities():
    rng = np.random.default_rng(1)
    pi, size = np.array([0.2, 0.5, 0.7, 0.35, 0.25]), np.array([3.0, 8, 1, 4, 4])
    runs = np.mean([mixing.landing(mixing.flight(pi, size, rng.random(5)), size, rng.random(5)) for _ in range(8000)], axis=0)
    assert runs == pytest.approx(pi, abs=0.03)


def test_mix_odd_rows(odd, clashing, none):
    rows = mixing.mix_sources(odd).collect()
    assert len(rows) == odd.count()
    check_mix(rows, None, lambda r: r.source)
    assert all(r.size == 0 and r.taken == 0 for r in rows if not (r.text or "").strip())
    taken = mixing.take_mix(clashing)
    assert taken.columns == clashing.columns
    assert taken.count() == sum(r.copies for r in rows)
    assert mixing.mix_sources(none).count() == 0 and mixing.take_mix(none).count() == 0


def test_mix_without_any_word(spark):
    docs = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix_plan(docs).collect()] == [(0.0, 0)] * 2
