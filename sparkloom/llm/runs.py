"""Sorted runs of byte strings in numpy: front coding, and loser trees that run in lockstep.

A string is a row of 8-byte words, big-endian in value, padded with zeros, and a length;
so comparing is a look at one word at a time, for many pairs at once.

Runs are merged by loser trees over (shared prefix length, string): a run stores what each
string shares with its predecessor, so of two players the one that shares more with the
last winner is the smaller; only at equal lengths are words compared, from there on, and
the loser remembers how far they agreed (Ng and Kakehi 2008; Bingmann, Eberle, Sanders
2017).  No word of a known prefix is looked at again.  The key space is cut into many
ranges, each with a tree of its own over all runs, and one step of numpy plays a match in
every tree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Numbers that go with a string: document, first window, number of windows, gram hash, place of the gram.
NUMBERS = [("uid", np.int64), ("s", np.int32), ("r", np.int32), ("h", np.int64), ("a", np.int32)]
#: Rows that are coded or decoded at a time; strings per tree; trees at most.
BLOCK, PER_TREE, MAX_TREES = 1 << 12, 48, 4096

_BYTE_ENDS = np.array([1 << 8 * k for k in range(1, 8)], np.uint64)
_rng = np.random.Generator(np.random.PCG64(7))
_MULTIPLIERS = _rng.integers(1, 1 << 63, 1 << 12, np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Items:
    """Strings: key (n x words, uint64) and size (bytes); numbers: a column for each of ``NUMBERS``."""

    key: np.ndarray
    size: np.ndarray
    numbers: list[np.ndarray]

    @staticmethod
    def empty(words: int) -> Items:
        return Items(np.zeros((0, words), np.uint64), np.zeros(0, np.int64), [np.zeros(0, t) for _, t in NUMBERS])

    @staticmethod
    def join(parts: list[Items]) -> Items:
        return Items(np.concatenate([p.key for p in parts]), np.concatenate([p.size for p in parts]), [np.concatenate(c) for c in zip(*(p.numbers for p in parts))])

    def take(self, at: np.ndarray | slice) -> Items:
        return Items(self.key[at], self.size[at], [c[at] for c in self.numbers])

    def __len__(self) -> int:
        return len(self.size)

    def bytes(self) -> np.ndarray:
        """n x 8 words, as stored: padded with zeros."""
        return self.key.astype(">u8").view(np.uint8).reshape(len(self), 8 * self.key.shape[1])


def words_for(size: int) -> int:
    return max(1, -(-size // 8))


def pad(data: np.ndarray, words: int) -> np.ndarray:
    return np.concatenate([data, np.zeros(8 * words, np.uint8)])


def gather(padded: np.ndarray, start: np.ndarray, size: np.ndarray, words: int) -> np.ndarray:
    """Keys of the strings data[start : start + size] of ``pad``-ded data."""
    width = 8 * words
    rows = np.lib.stride_tricks.as_strided(padded, (len(padded) - width + 1, width), (1, 1))[start]
    if len(size) and (size.min() != width):
        rows[np.arange(width) >= size[:, None]] = 0
    return rows.view(">u8").astype(np.uint64)


def shared(key: np.ndarray, size: np.ndarray, p: np.ndarray, q: np.ndarray, known: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """What strings p and q share, known to be at least ``known``; and whether p is the smaller or equal one."""
    end = np.minimum(size[p], size[q])
    out, less = end.copy(), size[p] <= size[q]
    word = np.broadcast_to(np.asarray(known) >> 3, end.shape).copy()
    todo = np.flatnonzero(word * 8 < end)
    while len(todo):
        w = word[todo]
        x, y = key[p[todo], w], key[q[todo], w]
        differ = x != y
        at = todo[differ]
        if len(at):
            x, y = x[differ], y[differ]
            k = w[differ] * 8 + 7 - np.searchsorted(_BYTE_ENDS, x ^ y, side="right")
            inside = k < end[at]
            out[at] = np.where(inside, k, end[at])
            less[at] = np.where(inside, x < y, less[at])
        todo = todo[~differ]
        word[todo] += 1
        todo = todo[word[todo] * 8 < end[todo]]
    return out, less


def order(key: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions in the order of the strings: by words, each only among those that are tied so far."""
    n = len(size)
    at = np.argsort(key[:, 0], kind="stable")
    same = np.zeros(n + 1, bool)  # same[i]: i and its predecessor are tied
    same[1:n] = key[at[1:], 0] == key[at[:-1], 0]
    for w in [*range(1, key.shape[1]), -1]:
        tied = np.flatnonzero(same[:n] | same[1:])
        if not len(tied):
            break
        value = key[:, w] if w >= 0 else size
        group = np.cumsum(~same[tied])
        at[tied] = at[tied][np.lexsort((value[at[tied]], group))]
        later = tied[same[tied]]
        same[later] = value[at[later]] == value[at[later - 1]]
    return at


def settle(items: Items) -> tuple[Items, Items]:
    """Of a lot: its distinct strings in order, each with its earliest place, and the other places."""
    n = len(items)
    if not n:
        return items, items
    uid, s = items.numbers[:2]
    mixed = items.size.astype(np.uint64) * _MULTIPLIERS[-1]
    for w in range(items.key.shape[1]):
        mixed += items.key[:, w] * _MULTIPLIERS[w]
    at = np.lexsort((s, uid, mixed))
    a, b = at[1:], at[:-1]
    same = np.zeros(n, bool)
    near = np.flatnonzero((mixed[a] == mixed[b]) & (items.size[a] == items.size[b]))
    same[near + 1] = (items.key[a[near]] == items.key[b[near]]).all(axis=1)
    first = at[np.maximum.accumulate(np.where(same, 0, np.arange(n)))]
    later = same & ((uid[at] != uid[first]) | (s[at] != s[first]))  # a document that is listed twice counts once
    distinct = at[~same]
    distinct = distinct[order(items.key[distinct], items.size[distinct])]
    return items.take(distinct), items.take(at[later])


def front_code(items: Items) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Of sorted strings: what each shares with its predecessor, the sizes of the rests, the rests."""
    n = len(items)
    lcp = np.zeros(n, np.int64)
    if n > 1:
        lcp[1:] = shared(items.key, items.size, np.arange(n - 1), np.arange(1, n), 0)[0]
    rests, cols = [], np.arange(8 * items.key.shape[1])
    for k in range(0, n, BLOCK):
        part = items.take(slice(k, k + BLOCK))
        rests.append(part.bytes()[(cols >= lcp[k : k + BLOCK, None]) & (cols < part.size[:, None])].tobytes())
    return lcp.astype(np.int32), (items.size - lcp).astype(np.int32), b"".join(rests)


def decode(lcp: np.ndarray, rest: np.ndarray, rests: bytes, numbers: list[np.ndarray], words: int) -> Items:
    """The strings of a front-coded run."""
    n, cols = len(lcp), np.arange(8 * words)
    size = lcp.astype(np.int64) + rest
    offsets = np.concatenate([[0], np.cumsum(rest, dtype=np.int64)])
    flat = np.frombuffer(rests, np.uint8)
    key = np.zeros((n, words), np.uint64)
    last = np.zeros(8 * words, np.uint8)
    for k in range(0, n, BLOCK):
        m = min(BLOCK, n - k)
        own, full = lcp[k : k + m, None], size[k : k + m, None]
        rows = np.zeros((m + 1, 8 * words), np.uint8)
        rows[0] = last
        rows[1:][(cols >= own) & (cols < full)] = flat[offsets[k] : offsets[k + m]]
        # a byte before the shared length is that of the last row which stored it
        source = np.zeros((m + 1, 8 * words), np.int32)
        source[1:] = np.where(cols >= own, np.arange(1, m + 1, dtype=np.int32)[:, None], 0)
        np.maximum.accumulate(source, axis=0, out=source)
        rows = np.take_along_axis(rows, source, axis=0)
        last = rows[-1].copy()
        body = rows[1:]
        body[cols >= full] = 0
        key[k : k + m] = body.view(">u8")
    return Items(key, size, numbers)


def merge(runs: list[tuple[Items, np.ndarray]]) -> tuple[Items, np.ndarray, np.ndarray]:
    """All items of sorted runs (items, shared with the predecessor), their order, and what each in that order shares with its predecessor.

    ``runs`` is emptied.  The first string of a tree counts as sharing nothing; equal
    strings are in one tree.
    """
    lengths = [len(r[0]) for r in runs if len(r[0])]
    if not lengths:
        return Items.empty(1), np.zeros(0, np.int64), np.zeros(0, np.int64)
    lcp = np.concatenate([r[1] for r in runs]).astype(np.int64)
    items = Items.join([r[0] for r in runs])
    runs.clear()
    key, size, n = items.key, items.size, len(items)
    if len(lengths) < 2:
        return items, np.arange(n), lcp
    trees = int(min(MAX_TREES, max(1, n // PER_TREE)))
    kind = f"S{8 * key.shape[1]}"
    probe = items.take(np.arange(0, n, max(1, n // (4 * trees)))) if trees > 1 else items.take(slice(0, 0))
    bounds = np.sort(np.ascontiguousarray(probe.bytes()).view(kind).ravel())
    bounds = np.unique(bounds[np.linspace(0, len(bounds) - 1, trees + 1).astype(int)[1:-1]]) if trees > 1 else bounds
    trees, width = len(bounds) + 1, 1 << (len(lengths) - 1).bit_length()
    now, end = np.zeros((trees, width), np.int64), np.zeros((trees, width), np.int64)
    begin = 0
    for i, m in enumerate(lengths):
        run = key[begin : begin + m].astype(">u8").view(kind).ravel()
        cuts = begin + np.searchsorted(run, bounds, side="right")
        now[:, i] = [begin, *cuts]
        end[:, i] = [*cuts, begin + m]
        begin += m
    first = np.cumsum(np.concatenate([[0], (end - now).sum(axis=1)[:-1]]))
    share = np.where(now < end, 0, -1)

    def play(t: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(winner, loser) of players a and b in trees t; the loser's share is set."""
        x, y = share[t, a], share[t, b]
        wins = x > y
        even = np.flatnonzero((x == y) & (x >= 0))
        if len(even):
            te, ae, be = t[even], a[even], b[even]
            k, less = shared(key, size, now[te, ae], now[te, be], x[even])
            share[te, np.where(less, be, ae)] = k
            wins[even] = less
        return np.where(wins, a, b), np.where(wins, b, a)

    losers = np.zeros((trees, width), np.int64)
    level = np.broadcast_to(np.arange(width), (trees, width))
    while level.shape[1] > 1:
        m = level.shape[1] // 2
        t = np.repeat(np.arange(trees), m)
        won, lost = play(t, level[:, 0::2].ravel(), level[:, 1::2].ravel())
        losers[:, m : 2 * m] = lost.reshape(trees, m)
        level = won.reshape(trees, m)
    winner, t = level[:, 0].copy(), np.arange(trees)
    placed, common = np.zeros(n, np.int64), np.zeros(n, np.int64)
    out = first.copy()
    while True:
        alive = share[t, winner] >= 0
        if not alive.all():
            t, winner = t[alive], winner[alive]
            if not len(t):
                break
        at = now[t, winner]
        placed[out[t]], common[out[t]] = at, share[t, winner]
        out[t] += 1
        at = at + 1
        now[t, winner] = at
        share[t, winner] = np.where(at < end[t, winner], lcp[np.minimum(at, n - 1)], -1)
        node = (winner + width) >> 1
        while node[0]:
            winner, losers[t, node] = play(t, winner, losers[t, node])
            node = node >> 1
    return items, placed, common


def repeats(items: Items, placed: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a merged order: its items, a document that is listed twice once, and whether an equal string starts earlier."""
    n = len(items)
    if not n:
        return placed, np.zeros(0, bool)
    new, size = np.ones(n, bool), items.size[placed]
    new[1:] = (common[1:] != size[1:]) | (size[1:] != size[:-1])
    group = np.cumsum(new) - 1
    uid, s = (c[placed] for c in items.numbers[:2])
    at = np.lexsort((s, uid, group))
    head = np.ones(n, bool)
    head[1:] = group[at[1:]] != group[at[:-1]]
    first = at[np.maximum.accumulate(np.where(head, np.arange(n), 0))]
    repeat = (uid[at] != uid[first]) | (s[at] != s[first])
    keep = head | repeat
    return placed[at[keep]], repeat[keep]


def unite(uid: np.ndarray, s: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of windows (r windows from s on) of each document, those that touch made one."""
    if not len(uid):
        return uid, s, r
    at = np.lexsort((s, uid))
    uid, s, r = uid[at], s[at].astype(np.int64), r[at].astype(np.int64)
    rank = np.cumsum(np.concatenate([[0], uid[1:] != uid[:-1]]))
    base = rank * (int((s + r).max()) + 1)
    reach = np.maximum.accumulate(base + s + r)
    new = np.concatenate([[True], (base[1:] + s[1:] > reach[:-1]) | (rank[1:] != rank[:-1])])
    head = np.flatnonzero(new)
    last = np.concatenate([head[1:], [len(s)]]) - 1
    return uid[head], s[head], reach[last] - base[last] - s[head]
