import random
import re
import zlib
from collections import Counter

import brute
import pytest
from conftest import frame

from sparkloom.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows, every):
    n = Counter()
    for doc, text, *_ in rows:
        for run in RUN.findall((text or "").translate(brute.LOW)):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if every and h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 6:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 5}
    form, out = {}, {}
    for w in n:
        close = [v for v in n if one_edit(w, v)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = (len(close), best if best and n[best] >= 5 * n[w] else None)
    for w in n:
        root = w
        while form[root][1]:
            root = form[root][1]
        out[w] = (form[w][1], root, n[w], form[w][0], n.get(form[w][1]))
    return out


def got(docs, every=None):
    rows = spelling.spelling_variants(docs, every=every).collect()
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(found) == len(rows)
    return found


def documents(seed):
    """Words with misspelt ones, chains of them, capitals, letters beyond ASCII, and a very long word."""
    rng, rows = random.Random(seed), []
    alphabet = "abÀé"
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 9))) for _ in range(25)] + ["kettle", "kettles", "Kettlest", "x" * 3000]
    weights = [6 ** rng.randint(0, 3) for _ in base]
    for i in range(60):
        out = []
        for w in rng.choices(base, weights, k=60):
            k = rng.randrange(len(w))
            out.append(rng.choice([w, w.upper() if w.isascii() else w, w[:k] + w[k + 1 :], w[:k] + rng.choice(alphabet) + w[k:], w[:k] + rng.choice(alphabet) + w[k + 1 :]]) if rng.random() < 0.4 else w)
        rows.append((i if i % 7 else None, ", ".join(out), "en", "s", 0))
    rows.append((96, "papers " * 6 + "papersx " * 40 + "papersxy " * 300, "", "", 0))
    return rows + [(99, None, None, None, None), (98, "", None, None, None), (97, "x" * 3000 + "y", "", "", 0)] * 5


@pytest.mark.parametrize("limits", [None, (40, 2000, 300, 500)])
def test_brute_force(spark, monkeypatch, limits):
    """Also with many shards, waves, lots and steps."""
    if limits:
        for name, value in zip(("SHARD_LETTERS", "WAVE", "LOT_LETTERS", "WALKERS"), limits):
            monkeypatch.setattr(spelling, name, value)
    rows = documents(1)
    want = expected(rows, 19)
    assert len(want) > 40 and any(v[0] and v[1] != v[0] for v in want.values())
    assert got(frame(spark, rows), 19) == want


def test_odd_rows(odd, odd_rows):
    assert got(odd) == expected(odd_rows, None)


def test_empty(none):
    df = spelling.spelling_variants(none)
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"] and df.count() == 0


def test_tries():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(400)} | {"z" * 40})
    labels, first, ends_at = spelling.build(words)
    assert sorted(ends_at[ends_at >= 0].tolist()) == list(range(len(words)))
    for i, w in enumerate(words):
        node = 0
        for c in w.encode():
            node = next(k for k in range(first[node], first[node + 1]) if labels[k] == c)
        assert ends_at[node] == i
    n = range(len(words))
    letters, ends = spelling.joined(words)
    trie = spelling.Trie(labels.tobytes(), first.tobytes(), ends_at.tobytes(), letters.tobytes(), ends.tobytes(), b"\0" * 8 * len(words))
    asked = [*words, "q", "ab" * 30, "z" * 41, "z" * 39]
    row, found = trie.near(asked)
    pairs = list(zip(row.tolist(), found.tolist()))
    assert len(set(pairs)) == len(pairs)
    assert set(pairs) == {(i, k) for i, a in enumerate(asked) for k in n if one_edit(a, words[k])}
