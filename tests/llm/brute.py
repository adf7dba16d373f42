"""Plain-Python versions of the operators."""

import hashlib
import re

import xxhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def repeats(units, window):
    """units: [(order, sequence)]; removed positions of each, for windows that start earlier elsewhere."""
    first = {}
    for order, u in units:
        for i in range(len(u) - window + 1):
            k = u[i : i + window] if isinstance(u, bytes) else tuple(u[i : i + window])
            first[k] = min(first.get(k, (order, i)), (order, i))
    out = []
    for order, u in units:
        gone = set()
        for i in range(len(u) - window + 1):
            k = u[i : i + window] if isinstance(u, bytes) else tuple(u[i : i + window])
            if first[k] < (order, i):
                gone.update(range(i, i + window))
        out.append(gone)
    return out


def fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(x >> j & 1 for x in h) > len(h)) << j for j in range(64)) if h else 0


def classes(n, linked):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(n)]


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def stats(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def sha(data):
    return hashlib.sha256(data).hexdigest()
