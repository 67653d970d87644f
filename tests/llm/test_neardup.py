import random

import numpy as np

from pixelmill.llm import neardup
from pixelmill.llm.components import components
from pixelmill.llm.shared import Scratch
from tests.llm.conftest import odd_rows, shingles


def brute(rows):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def check(df, rows):
    want = brute(rows)
    got = df.collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id], r
            assert r.kept == (r.doc_id == r.component_id)


def test_odd_rows(odd):
    rows = [(r[0], r[1]) for r in odd_rows()]
    df = neardup.near_duplicates(odd)
    check(df, rows)
    sizes = {r.doc_id: r.n_shingles for r in df.collect() if r.doc_id is not None}
    assert all(sizes[i] == len(shingles(t)) for i, t in rows if i is not None)


def test_empty_table(none):
    assert neardup.near_duplicates(none).count() == 0


def test_chains_and_groups(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    rows, k = [], 100
    for size in (2, 7, 40, 90):
        base = [word() for _ in range(r.choice((6, 40, 150)))]
        for _ in range(size):
            own = base[:]
            for _ in range(r.randint(0, max(1, len(own) // 25))):
                own[r.randrange(len(own))] = word()
            if r.random() < 0.3:
                base = own
            rows.append((k, " ".join(own)))
            k += 1
    r.shuffle(rows)
    check(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_open_buckets_are_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    test_chains_and_groups(spark)


def test_ids_that_repeat_with_other_texts(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    one, two, three = ([word() for _ in range(40)] for _ in range(3))
    near = lambda w: " ".join([*w[:-1], word()])
    rows = [(5, near(one)), (5, near(two)), (3, near(one)), (9, near(two)), (7, " ".join(three)), (8, near(three)), (8, " ".join(one)), (20, "a b c"), (20, "d e f"), (21, "D E F"), (None, near(one))]
    check(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_components_of_a_path_and_a_hot_vertex(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, k) for k in range(1001, 1300)] + [(5, 5), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 1000 for k in range(1000, 1300)}}


def test_registers_estimate_jaccard():
    r = np.random.default_rng(1)
    for shared, own in ((900, 100), (60, 20), (9, 1), (3000, 3000)):
        common = r.integers(0, 2**63, shared, dtype=np.uint64)
        sets = [np.unique(np.concatenate((common, r.integers(0, 2**63, own, dtype=np.uint64)))) for _ in range(2)]
        at = np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
        regs = neardup.registers(np.concatenate(sets), at)
        n = np.array([len(sets[0])])
        want = shared / (shared + 2 * own)
        assert abs(neardup.estimate(regs[:1], regs[1:], n, n)[0] - want) < 0.12
