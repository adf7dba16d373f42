"""Sorted runs in numpy against Python's sort."""

import random

import numpy as np
import pytest

from sparkloom.llm import runs


def items(strings, uids, words=5):
    size = np.array([len(x) for x in strings], np.int64)
    start = np.cumsum(size) - size
    key = runs.gather(runs.pad(np.frombuffer(b"".join(strings), np.uint8), words), start, size, words)
    n = len(strings)
    return runs.Items(key, size, [np.array(uids, np.int64), np.arange(n, dtype=np.int32), np.ones(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int32)])


def strings(x):
    rows = x.bytes()
    return [rows[i, : x.size[i]].tobytes() for i in range(len(x))]


def prefix(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("seed", range(40))
def test_settle_code_merge(seed, monkeypatch):
    """Strings with NULs and 0xFF, empty ones, long shared prefixes, and every form of block and tree."""
    rng = random.Random(seed)
    monkeypatch.setattr(runs, "BLOCK", rng.choice([1, 7, 1 << 14]))
    monkeypatch.setattr(runs, "PER_TREE", rng.choice([1, 3, 48]))
    alphabet = rng.choice([b"ab", b"a\0", b"abc\xff\0"])
    coded, places, everything = [], [], []
    for _ in range(rng.choice([1, 2, 3, 5, 9])):
        own = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, rng.choice([3, 20, 40])))) for _ in range(rng.randint(0, rng.choice([5, 60, 300])))]
        lot = items(own, [rng.randrange(4) for _ in own])
        distinct, rest = runs.settle(lot)
        assert strings(distinct) == sorted(set(own))
        assert sorted(strings(distinct) + strings(rest)) == sorted(own)
        lcp, sizes, tails = runs.front_code(distinct)
        assert strings(runs.decode(lcp, sizes, tails, distinct.numbers, 5)) == strings(distinct)
        coded.append((distinct, lcp))
        everything += strings(distinct)
        places += list(zip(strings(distinct), *(c.tolist() for c in distinct.numbers[:2])))
    merged, placed, common = runs.merge(coded)
    got = strings(merged.take(placed))
    assert got == sorted(everything)
    assert all(k <= prefix(a, b) for k, a, b in zip(common[1:], got, got[1:]))
    assert all(k == prefix(a, b) for k, a, b in zip(common[1:], got, got[1:]) if a == b)
    least = {}
    for x, *place in places:
        least[x] = min(least.get(x, place), place)
    found, repeat = runs.repeats(merged, placed, common)
    found = merged.take(found)
    got = list(zip(strings(found), *(c.tolist() for c in found.numbers[:2]), repeat.tolist()))
    assert set(got) == {(x, *p, p != least[x]) for x, *p in places}
    assert sum(not r for *_, r in got) == len(least)


def test_one_tree_knows_every_shared_prefix(monkeypatch):
    monkeypatch.setattr(runs, "MAX_TREES", 1)
    rng = random.Random(3)
    coded = []
    for _ in range(6):
        distinct = runs.settle(items([bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(90)], range(90)))[0]
        coded.append((distinct, runs.front_code(distinct)[0]))
    merged, placed, common = runs.merge(coded)
    got = strings(merged.take(placed))
    assert common.tolist() == [0, *map(prefix, got, got[1:])]


def test_unite():
    rng = random.Random(5)
    rows = [(rng.randrange(5), rng.randrange(200), rng.randint(1, 9)) for _ in range(150)]
    uid, s, r = runs.unite(*(np.array(c, np.int64) for c in zip(*rows)))
    want = {(u, i) for u, a, n in rows for i in range(a, a + n)}
    got = [(u, i) for u, a, n in zip(uid.tolist(), s.tolist(), r.tolist()) for i in range(a, a + n)]
    assert sorted(got) == sorted(want)  # once each
    assert all((u, a + n) not in want for u, a, n in zip(uid.tolist(), s.tolist(), r.tolist()))
    assert len(runs.unite(*[np.zeros(0, np.int64)] * 3)[0]) == 0
