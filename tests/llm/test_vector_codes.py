import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import vector_codes
from sparkloom.llm.vector_codes import Spec

SCHEMA = "vec_id long, embedding array<double>, label string, error long, code string, ints string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)


def expected(rows, spec):
    """Plain Lloyd over all entries: Counter of (vec_id, code, error, label_error), digest."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not any(i is not None for i, _, _ in kept):
        return Counter(), None
    starts = {}
    for i, v, _ in kept:
        if i is not None:
            starts[i] = min(starts.get(i, v), v)
    size = len(starts[min(starts)])
    kept = [r for r in kept if len(r[1]) == size]
    first = [starts[i] for i in sorted(starts) if len(starts[i]) == size][: spec.entries]
    where = vector_codes.cuts(size, spec.parts)
    books = [[v[w] for v in first] for w in where]

    def nearest(p, v):
        return min((sum((x - y) ** 2 for x, y in zip(v[where[p]], c)), k) for k, c in enumerate(books[p]))

    for _ in range(spec.rounds):
        codes = [[nearest(p, v)[1] for p in range(spec.parts)] for _, v, _ in kept]
        for p, w in enumerate(where):
            for k in range(len(first)):
                own = [v[w] for (_, v, _), c in zip(kept, codes) if c[p] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    found = [[nearest(p, v) for p in range(spec.parts)] for _, v, _ in kept]
    errors, labels = [sum(d for d, _ in f) for f in found], Counter()
    for (_, _, label), e in zip(kept, errors):
        labels[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return Counter((i, "".join(f"{k:02x}" for _, k in f), e, labels[label]) for (i, _, label), f, e in zip(kept, found, errors)), digest


def check(spark, rows, spec=Spec()):
    want, digest = expected(rows, spec)
    got = vector_codes.vector_codes(frame(spark, rows), spec).collect()
    assert Counter((r.vec_id, r.code, r.error, r.label_error) for r in got) == want
    assert {r.codebooks_sha256 for r in got} == ({digest} if want else set())
    return want


def vectors(rng, n, size, step):
    """Clustered, on a coarse grid so that ties are many, and repeated."""
    centres = [[rng.gauss(0, 0.3) for _ in range(size)] for _ in range(9)]
    out = [[round((c + rng.gauss(0, 0.1)) / step) * step for c in rng.choice(centres)] for _ in range(n)]
    return out + out[: n // 10]


@pytest.mark.parametrize(("size", "step", "spec"), [(64, 0.001, Spec()), (16, 0.25, Spec()), (7, 0.5, Spec(parts=3, entries=5, groups=2, rounds=3)), (8, 0.125, Spec(groups=1))])
def test_brute_force(spark, size, step, spec):
    rng = random.Random(size)
    rows = [(i, v, rng.choice(["a", "b", None])) for i, v in enumerate(vectors(rng, 150, size, step))]
    rng.shuffle(rows)
    check(spark, rows, spec)


def test_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, v, "l" * (i % 3) or None) for i, v in enumerate(vectors(rng, 30, 16, 0.01))]
    rows += [(40, None, "a"), (41, [], "a"), (42, [1.0] * 15 + [None], "a"), (43, [float("nan")] * 16, "a"), (44, [1.0] * 15 + [float("inf")], None), (-5, None, "a")]
    rows += [(None, rows[3][1], "a"), (0, rows[9][1], "b"), (0, rows[9][1], "b"), (45, [1.0] * 8, "a"), (46, [-1e-9] * 16, "a"), (47, [3e3] * 16, "a")]
    assert len(check(spark, rows)) > 30


def test_few_rows(spark):
    check(spark, [(3, [0.5] * 8, None)])
    check(spark, [(3, [0.5] * 8, None), (2, [0.25] * 8, "a"), (9, [0.25] * 8, "a")])
    for rows in ([], [(None, [0.5] * 8, "a")], [(1, None, "a")]):
        check(spark, rows)


def test_too_large(spark):
    with pytest.raises(ValueError, match="too large"):
        vector_codes.vector_codes(frame(spark, [(1, [1e12] * 8, "a")]))


def test_bounds_spare_distances():
    """Bounds hold for every group after every round, and few groups are scanned once entries settle."""
    rng = np.random.default_rng(0)
    x = (rng.normal(0, 400, (12, 8))[rng.integers(0, 12, 3000)] + rng.normal(0, 40, (3000, 8))).astype(np.int64)
    entries = x[:16].copy()
    of = vector_codes.grouped(entries, 4)
    code, bounds, taken = np.full(len(x), vector_codes.UNSET, np.uint8), np.zeros((len(x), 4)), []
    for _ in range(8):
        code, least, bounds, n = vector_codes.assign(x, entries, of, code, bounds)
        d = ((x[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        assert (code == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()
        others = np.sqrt(d.astype(float))
        others[np.arange(len(x)), code] = np.inf
        for g in range(4):
            if (of == g).any():
                assert (bounds[:, g] <= others[:, of == g].min(axis=1)).all()
        taken.append(n)
        moved = np.array([x[code == k].sum(axis=0) // (code == k).sum() if (code == k).any() else entries[k] for k in range(16)])
        far = np.sqrt(((moved - entries) ** 2).sum(axis=1)) * (1 + vector_codes.MARGIN)
        bounds = bounds - np.array([far[of == g].max(initial=0) for g in range(4)])
        entries = moved
    assert taken[0] == 17 * len(x) and taken[-1] < 0.4 * taken[0]


def test_exact_squares():
    rng = np.random.default_rng(1)
    for most in (100, 1 << 25):
        a, b = (rng.integers(-most, most, (n, 8)) for n in (20, 5))
        want = [[sum((int(p) - int(q)) ** 2 for p, q in zip(r, s)) for s in b] for r in a]
        assert vector_codes.exact_squares(a, b).tolist() == want
