"""Spelling variants: words one edit apart, found by Levenshtein automata on broadcast tries.

The vocabulary is counted in the JVM, sorted, and packed in tasks into trie shards of a
bounded number of letters: arrays of labels, first children and word numbers, where the
children of a node lie side by side.  Shards go out by broadcast in waves of at most
``WAVE`` bytes, each dropped before the next, so neither the driver nor a task ever holds
more than one wave, however large the vocabulary is.

A task walks lots of words through every shard of a wave, depth first and in lockstep: a
walker is (word, node, state), and one numpy step moves all walkers on top of the stack to
the children of their nodes.  The state is that of the word's automaton for distance one:
the three cells of the edit-distance table around the diagonal, capped at two, 27 states in
all, with a table of transitions by which of the three letters equal the label.  Walkers
whose cells are all two end.  Each word is counted with its neighbours in the task; one
row a word and wave is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, stored

LETTERS = r"A-Za-z\x{C0}-\x{FF}"
SHARD_LETTERS = 1 << 20  # letters of a trie shard, unless it holds a single word
WAVE = 64 << 20  # bytes broadcast at a time
LOT_LETTERS = 1 << 18  # letters walked in lockstep, unless a lot holds a single word
WALKERS = 1 << 16  # moved in one step
ALPHABET = 56  # about as many children as a node can have
TRIE = "shard long, bytes long, labels binary, first binary, ends_at binary, letters binary, ends binary, n binary"


def _transitions() -> np.ndarray:
    """next[state, equal]: state is 9 * left + 3 * middle + right, equal has bit i for the letter i - 1 after the depth."""
    out = np.zeros((27, 8), np.uint8)
    for s in range(27):
        left, middle, right = s // 9, s // 3 % 3, s % 3
        for e in range(8):
            differs = [1 - (e >> i & 1) for i in range(3)]
            a = min(left + differs[0], middle + 1, 2)
            b = min(middle + differs[1], right + 1, a + 1, 2)
            c = min(right + differs[2], b + 1, 2)
            out[s, e] = 9 * a + 3 * b + c
    return out


NEXT = _transitions()
START, DEAD = 9 * 2 + 3 * 0 + 1, 26
#: one_off[state, k]: whether the cell k - 1 right of the diagonal is one.
ONE_OFF = np.array([[s // 9 == 1, s // 3 % 3 == 1, s % 3 == 1] for s in range(27)])


def joined(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All letters as bytes (Latin-1), and the words' ends."""
    raw = [w.encode("latin-1") for w in words]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)], dtype=np.int32)


def build(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """labels, first, ends_at of the trie of sorted, distinct words.

    Nodes are numbered by depth, then in order, so the children of node v are first[v] up
    to first[v + 1]; ends_at[v] is the number of the word that ends there, or -1.
    """
    letters, ends = joined(words)
    size, fresh = len(words), np.zeros(len(words), np.int64)
    for i in range(1, size):
        a, b = words[i - 1], words[i]
        k, most = 0, min(len(a), len(b))
        while k < most and a[k] == b[k]:
            k += 1
        fresh[i] = k
    lengths = np.diff(ends).astype(np.int64)
    many = lengths - fresh
    word = np.repeat(np.arange(size), many)
    depth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(fresh, many) + 1
    order = np.argsort(depth, kind="stable")
    word, depth = np.r_[0, word[order]], np.r_[0, depth[order]]
    key = depth * (size + 1) + word
    above = np.searchsorted(key, key[1:] - (size + 1), "right") - 1
    first = np.searchsorted(above, np.arange(len(key) + 1)).astype(np.int32) + 1
    labels = np.zeros(len(key), np.uint8)
    labels[1:] = letters[ends[word[1:]] + depth[1:] - 1]
    ends_at = np.full(len(key), -1, np.int32)
    ends_at[np.searchsorted(key, lengths * (size + 1) + np.arange(size), "right") - 1] = np.arange(size)
    return labels, first, ends_at


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, words, counts, held = TaskContext.get().partitionId() << 32, [], [], 0

    def pack() -> pa.RecordBatch:
        parts = [*build(words), *joined(words), np.array(counts, np.int64)]
        raw = [x.tobytes() for x in parts]
        return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([sum(map(len, raw))]), *(pa.array([x], pa.binary()) for x in raw)], [c.split()[0] for c in TRIE.split(", ")])

    for batch in batches:
        for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
            if words and held + len(w) > SHARD_LETTERS:
                yield pack()
                shard, words, counts, held = shard + 1, [], [], 0
            words.append(w)
            counts.append(n)
            held += len(w)
    if words:
        yield pack()


class Trie:
    def __init__(self, labels: bytes, first: bytes, ends_at: bytes, letters: bytes, ends: bytes, n: bytes):
        self.labels, self.first, self.ends_at = np.frombuffer(labels, np.uint8), np.frombuffer(first, np.int32), np.frombuffer(ends_at, np.int32)
        self.letters, self.ends, self.n = letters, np.frombuffer(ends, np.int32), np.frombuffer(n, np.int64)

    def word(self, i: int) -> str:
        return self.letters[self.ends[i] : self.ends[i + 1]].decode("latin-1")

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(row, number): the trie's words that differ from words[row] by exactly one edit, each once."""
        letters, ends = joined(words)
        lengths = np.diff(ends)
        # a column of zeros before each word and two after it, which equal no label
        w = np.zeros((len(words), int(lengths.max()) + 3), np.uint8)
        at = np.arange(len(letters)) - np.repeat(ends[:-1], lengths)
        w[np.repeat(np.arange(len(words)), lengths), at + 1] = letters
        stack = [(0, np.arange(len(words)), np.zeros(len(words), np.int32), np.full(len(words), START, np.uint8))]
        rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        while stack:
            depth, row, node, state = stack.pop()
            if len(row) > WALKERS // ALPHABET:
                half = len(row) // 2
                stack += [(depth, row[half:], node[half:], state[half:]), (depth, row[:half], node[:half], state[:half])]
                continue
            begin = self.first[node]
            many = self.first[node + 1] - begin
            row, state = np.repeat(row, many), np.repeat(state, many)
            child = np.arange(many.sum(), dtype=np.int32) + np.repeat(begin - (np.cumsum(many) - many), many).astype(np.int32)
            label = self.labels[child]
            # beyond its end a word has no letters, and cells there don't lead back
            c = [np.minimum(depth + i, w.shape[1] - 1) for i in range(3)]
            equal = (w[row, c[0]] == label) | (w[row, c[1]] == label).astype(np.uint8) << 1 | (w[row, c[2]] == label).astype(np.uint8) << 2
            state = NEXT[state, equal]
            offset = lengths[row] - depth  # of the word's end from the diagonal, plus one
            end = self.ends_at[child]
            hit = (end >= 0) & (offset >= 0) & (offset <= 2) & ONE_OFF[state, np.clip(offset, 0, 2)]
            rows.append(row[hit])
            found.append(end[hit])
            alive = (state != DEAD) & (offset >= 0)
            if alive.any():
                stack.append((depth + 1, row[alive], child[alive], state[alive]))
        return np.concatenate(rows), np.concatenate(found)


def lots(words: list[str]) -> Iterator[list[int]]:
    """Numbers of words of similar length, with at most LOT_LETTERS letters once they are padded."""
    lot: list[int] = []
    for i in sorted(range(len(words)), key=lambda i: len(words[i])):
        if lot and (len(lot) + 1) * len(words[i]) > LOT_LETTERS:
            yield lot
            lot = []
        lot.append(i)
    if lot:
        yield lot


def _neighbours(batches: Iterator[pa.RecordBatch], tries: list[tuple]) -> Iterator[pa.RecordBatch]:
    """word, n_near, form_n, form (most frequent, then smallest) of words with neighbours in these tries, in word order."""
    opened = [Trie(*t) for t in tries]
    for batch in batches:
        words = batch.column("word").to_pylist()
        count, most, form = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [""] * len(words)
        for lot in lots(words):
            for t in opened:
                row, number = t.near([words[i] for i in lot])
                order = np.lexsort((number, -t.n[number], row))
                row, number = row[order], number[order]
                at, first, n = np.unique(row, return_index=True, return_counts=True)
                for r, k, c in zip(at.tolist(), number[first].tolist(), n.tolist()):
                    i = lot[r]
                    count[i] += c
                    if t.n[k] > most[i]:
                        most[i], form[i] = t.n[k], t.word(k)
        has = pa.array(count > 0)
        yield pa.RecordBatch.from_arrays([batch.column("word").filter(has), *(pa.array(x).filter(has) for x in (count, most)), pa.array(form, pa.string()).filter(has)], ["word", "n_near", "form_n", "form"])


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """word, n_near, form_n, form of the words (word, n; distinct) that differ by one edit from another."""
    spark = vocabulary.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = vocabulary.repartitionByRange(parts, "word").sortWithinPartitions("word")
    tries = stored(ordered.mapInArrow(_packed, TRIE), "spelling-tries")
    waves: list[list[int]] = []
    free = 0
    for x in tries.select("shard", "bytes").orderBy("shard").toLocalIterator():
        if x.bytes > free:
            waves.append([])
            free = WAVE
        waves[-1].append(x.shard)
        free -= x.bytes
    columns = [c.split()[0] for c in TRIE.split(", ")][2:]
    out = None
    walkers = vocabulary.repartition(parts, "word")
    for k, wave in enumerate(waves):
        shards = tries.filter(F.col("shard").isin(wave)).orderBy("shard").select(*columns).collect()
        sent = spark.sparkContext.broadcast([tuple(map(bytes, s)) for s in shards])
        found = stored(walkers.mapInArrow(lambda it, sent=sent: _neighbours(it, sent.value), "word string, n_near long, form_n long, form string"), f"spelling-wave{k}")
        sent.destroy()
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("f"), "form"))  # bytes of UTF-8 sort as code points do
    return out.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.f")).alias("form_n"), F.col("b.form").alias("form"))


def runs(docs: DataFrame, least: int) -> DataFrame:
    """id (doc_id as text, '' if NULL), run: every run of letters of whole texts with at least ``least`` of them, A-Z as a-z."""
    found = F.regexp_extract_all(F.coalesce(lower_ascii(F.col("text")), F.lit("")), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    return docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))


def misspelt(identity: Column, run: Column, every: int) -> Column:
    """The run; for one in ``every`` pairs of id and run, as their crc32 tells, without one of its letters."""
    h = F.crc32(F.concat(identity, F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, least_letters: int = 6, least_n: int = 5, every: int | None = None) -> DataFrame:
    """word, n of the words with enough letters and occurrences; ``every`` misspells some (see ``misspelt``)."""
    r = runs(docs, least_letters)
    word = misspelt(F.col("id"), F.col("run"), every) if every else F.col("run")
    counted = r.select(word.alias("word")).filter(F.length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= least_n)


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms (word, form) from each word; forms make no circle.

    Jumps double, and a form is several times as frequent as its word, so few rounds do.
    """
    jump = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = jump.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stored(jump.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        jump = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return jump


def spelling_variants(docs: DataFrame, least_letters: int = 6, least_n: int = 5, factor: int = 5, every: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs`` (doc_id, text).

    Words are maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z as a-z, with at
    least ``least_letters`` letters and ``least_n`` occurrences in whole texts.  n_near counts
    the words that differ by one inserted, deleted or replaced letter; form is the one of
    them with the largest n (ties: the smallest in code-point order) if that is at least
    ``factor`` times the word's, else NULL; root follows forms to the last, and is the word
    itself without one.  ``every`` makes test errors: see ``misspelt``; a NULL doc_id counts
    as the empty string there.  NULL and empty texts have no words; repeated rows count each
    time; extra columns are ignored; an empty table gives an empty result.
    """
    words = stored(vocabulary(docs, least_letters, least_n, every), "spelling-words")
    found = stored(neighbours(words), "spelling-near")
    formed = F.col("form_n") >= factor * F.col("n")
    full = words.join(found, "word", "left").select(
        "word", F.when(formed, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("form_n")).alias("form_n"))
    full = stored(full, "spelling-forms")
    ends = roots(full.filter("form IS NOT NULL"))
    return full.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
