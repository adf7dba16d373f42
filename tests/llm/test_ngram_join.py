import random
from collections import Counter

import brute
import numpy as np
import pytest
from conftest import frame, words

from sparkloom.llm import ngram_join


def shingled(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def near(a, b):
    c = len(a & b)
    return bool(c) and 100 * c >= 85 * (len(a) + len(b) - c)


def expected(rows):
    """Counter of (doc_id, n_shingles, component_id)."""
    sets = [shingled(t) for _, t, *_ in rows]
    root = brute.classes(len(rows), lambda a, b: near(sets[a], sets[b]))
    least = {}
    for r, k in zip(rows, root):
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    return Counter((r[0], len(s), least.get(k) if s else r[0]) for r, s, k in zip(rows, sets, root))


def got(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect())


def test_odd_rows(odd, odd_rows):
    assert got(odd) == expected(odd_rows)


def test_empty(none):
    df = ngram_join.jaccard_components(none)
    assert df.columns == ["doc_id", "n_shingles", "component_id"] and df.count() == 0


def edited(rng, base):
    """Copies on either side of the threshold, so that groups are no cliques."""
    out = list(base)
    for _ in range(rng.randint(0, max(1, len(base) // 20))):
        k = rng.randrange(len(out))
        out[k : k + rng.randint(0, 1)] = words(rng, rng.randint(0, 1))
    return out


@pytest.mark.parametrize("hot", [2, 64])
def test_groups_with_a_common_passage(spark, monkeypatch, hot):
    """Near copies of many documents, and others that share half their words with them; with lists in tiles or not."""
    monkeypatch.setattr(ngram_join, "HOT", hot)
    rng, rows = random.Random(hot), []
    passage = words(rng, 50)
    for _ in range(4):
        base = words(rng, rng.randint(40, 120))
        rows += [edited(rng, base) for _ in range(25)]
    rows += [passage + words(rng, rng.randint(0, 90)) for _ in range(30)]
    rows += [edited(rng, passage) for _ in range(20)] + [words(rng, 3) for _ in range(4)] * 2
    rows = [(i, " ".join(r), "en", "s", 0) for i, r in enumerate(rows)]
    want = expected(rows)
    assert 5 < len({c for _, _, c in want}) < len(rows) - 60
    assert got(frame(spark, rows)) == want


def test_lengthened_prefixes_keep_every_link():
    """Any two choices of l leave at least the smaller one in common."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = rng.choice(80, n, replace=False)
        b = np.unique(np.concatenate([a[: ngram_join.need(n)], rng.choice(80, int(rng.integers(0, 12)))]))
        c = len(np.intersect1d(a, b))
        if not ngram_join.linked(np.array(c), np.array(len(a)), np.array(len(b))):
            continue
        for la in range(1, ngram_join.need(len(a)) + 1):
            for lb in range(1, ngram_join.need(len(b)) + 1):
                x = np.sort(a)[: len(a) - ngram_join.need(len(a)) + la]
                y = np.sort(b)[: len(b) - ngram_join.need(len(b)) + lb]
                assert len(np.intersect1d(x, y)) >= min(la, lb)


def test_choice_by_cost():
    assert ngram_join.chosen(100, np.full(80, 2)) == (0, 0)  # 20 members of one set only fill the prefix
    l, take = ngram_join.chosen(100, np.full(100, 50))
    assert l > 1 and take == 16 + l - 1  # verifying is dear: more has to match
    assert ngram_join.chosen(100, np.r_[[2] * 16, [10**9] * 84]) == (1, 16)  # lengthening would read long lists
    assert ngram_join.chosen(1, np.array([5])) == (1, 1)


def test_common_members(monkeypatch):
    monkeypatch.setattr(ngram_join, "SLICE", 7)
    rng = np.random.default_rng(0)
    a, b = ([np.unique(rng.integers(0, 40, rng.integers(1, 30), dtype=np.uint64)) for _ in range(n)] for n in (5, 8))
    assert ngram_join.common_members(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]
