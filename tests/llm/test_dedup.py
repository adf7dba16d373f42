"""Substring (words, bytes) and SimHash dedup against brute force, on odd rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import brute
from sparkloom.llm import decontaminate, simhash, substring_dedup, suffix_dedup, windows
from sparkloom.llm.components import connected


@pytest.mark.parametrize("batches", [1, 3])
def test_repeated_words(odd, odd_rows, order_keys, batches):
    units = [(k, (r[1] or "").encode().split()) for k, r in zip(order_keys, odd_rows)]
    want = Counter((r[0], len(u), len(g), b" ".join(x for i, x in enumerate(u) if i not in g).decode()) for r, (_, u), g in zip(odd_rows, units, brute.repeats(units, 20)))
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(odd, batches=batches).collect())
    assert got == want


def test_repeated_bytes(odd, odd_rows, order_keys, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "RANGE", 1 << 14)  # many ranges
    units = [(k, (r[1] or "").encode()) for k, r in zip(order_keys, odd_rows)]
    want = Counter()
    for r, (_, u), g in zip(odd_rows, units, brute.repeats(units, 100)):
        want[r[0], len(u), len(g), sum(i in g and i - 1 not in g for i in range(len(u))), bytes(b for i, b in enumerate(u) if i not in g)] += 1
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(odd).collect())
    assert got == want


def test_nothing(none):
    assert substring_dedup.remove_repeats(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_first(none).count() == 0


def test_index_over_batches(spark):
    """Later batches see earlier ones through the index alone; runs are compacted."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(50)]
    shared = [rng.choice(vocabulary) for _ in range(45)]
    docs = []
    for i in range(24):
        own = [rng.choice(vocabulary) for _ in range(30)]
        a, b = sorted(rng.sample(range(46), 2))
        docs.append((i, " ".join(own + shared[a:b] + own[:7])))
    index, seen, gone = substring_dedup.FingerprintIndex(spark), None, {}
    for k in range(0, 24, 6):
        batch = spark.createDataFrame(docs[k : k + 6], "uid long, text string")
        seen = batch if seen is None else seen.unionByName(batch)
        for r in index.add(batch, seen).collect():
            gone.setdefault(r.uid, set()).update(range(r.s, r.s + r.r + 19))
    want = brute.repeats([(i, t.split()) for i, t in docs], 20)
    assert [gone.get(i, set()) for i in range(24)] == want
    assert any(want) and len(index.runs) < 4


def test_index_is_opened_again(spark, tmp_path):
    """Another job goes on where one has stopped; a window of another length is refused, and so is a second writer of one version."""
    rng = random.Random(11)
    docs = [(i, " ".join(rng.choice("abc") for _ in range(60))) for i in range(12)]
    root, gone, seen = str(tmp_path / "index"), {}, []
    for k in range(0, 12, 3):
        index = substring_dedup.FingerprintIndex(spark, gram=5, root=root)
        seen += docs[k : k + 3]
        found = index.add(spark.createDataFrame(docs[k : k + 3], "uid long, text string"), spark.createDataFrame(seen, "uid long, text string"))
        for r in found.collect():
            gone.setdefault(r.uid, set()).update(range(r.s, r.s + r.r + 19))
        assert index.version > 0 and sum(r["rows"] for r in index.runs) == index.history().count()
        index.close()
    assert [gone.get(i, set()) for i in range(12)] == brute.repeats([(i, t.split()) for i, t in docs], 20)
    with pytest.raises(ValueError):
        substring_dedup.FingerprintIndex(spark, window=21, gram=5, root=root)
    late = substring_dedup.FingerprintIndex(spark, gram=5, root=root)
    late.version -= 1
    with pytest.raises(RuntimeError):
        late._commit([])


def test_runs_are_merged_without_a_shuffle(spark, tmp_path):
    index = substring_dedup.FingerprintIndex(spark, root=str(tmp_path / "index"))
    batch = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(90))) for i in range(5)], "uid long, text string")
    index.add(batch, batch).count()
    run = index._run(index.runs[0])
    rows = spark.read.parquet(index.runs[0]["path"]).repartition(index._buckets(), "h", "c")
    plan = rows.join(run.select("h", "c", "uid").hint("merge"), ["h", "c"], "left")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1  # the batch's own
    index.close()


def test_only_grams_of_the_batch_are_compared(spark, monkeypatch):
    """Edges of older repeats aren't compared again for a batch that has none of their grams."""
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = [rng.choice(vocabulary) for _ in range(60)]
    first = [(i, " ".join([rng.choice(vocabulary) for _ in range(30)] + shared[i : 50 + i] + [rng.choice(vocabulary) for _ in range(30)])) for i in range(6)]
    other = [(i, " ".join(f"x{i}y{k}" for k in range(90))) for i in range(6, 9)]
    compared, verify = [], substring_dedup.FingerprintIndex._verify
    monkeypatch.setattr(substring_dedup.FingerprintIndex, "_verify", lambda self, sides, corpus: compared.append(sides.count()) or verify(self, sides, corpus))
    index = substring_dedup.FingerprintIndex(spark)
    batches = [spark.createDataFrame(x, "uid long, text string") for x in (first, other)]
    assert index.add(batches[0], batches[0]).count() > 0
    assert index.add(batches[1], batches[0].unionByName(batches[1])).count() == 0
    assert compared[0] > 0 and compared[1] == 0
    index.close()


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_collide_in_polynomial_hashes(spark, n):
    """A Thue-Morse word and its complement agree in every polynomial hash mod 2^64 with an odd base."""
    shared, word = [f"w{i}" for i in range(19)], thue_morse(n)
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [" ".join([*shared, word]), " ".join([*shared, other]), " ".join([*shared, word, "end"]), word + "x" * 60, other + "y" * 60]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 20, 3: 0, 4: 0}
    want = brute.repeats([(i, t.encode()) for i, t in enumerate(texts)], 100)
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == {i: len(g) for i, g in enumerate(want)}


@pytest.mark.parametrize("numbered_by", ["id", "rank"])
def test_ids_near_the_limits_of_a_long(spark, numbered_by):
    rng = random.Random(9)
    passage = " ".join(rng.choice(["ka", "lo", "mi", "nu"]) + str(rng.randrange(99)) for _ in range(60))
    ids = [2**63 - 1, 2**62 + 5, 0, -(2**62) - 7, -(2**63)]
    rows = [(i, f"{k} {passage} {k}") for k, i in enumerate(ids)]
    if numbered_by == "rank":
        rows += [(None, passage), (None, "x " + passage), (None, None), (2**62 + 5, "again " + passage), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = [(i is not None, i or 0, hashlib.md5((t or "").encode()).hexdigest()) for i, t in rows]
    for module, window, cut in ((substring_dedup, 20, lambda t: t.encode().split()), (suffix_dedup, 100, lambda t: t.encode())):
        gone = brute.repeats([(k, cut(t or "")) for k, (_, t) in zip(keys, rows)], window)
        want = Counter((i, len(g)) for (i, _), g in zip(rows, gone))
        assert Counter((r.doc_id, r.n_removed) for r in module.remove_repeats(docs).collect()) == want
    bench = spark.createDataFrame([(1, " ".join(passage.split()[:12]))], "item_id long, text string")
    got = Counter((r.doc_id, r.n_hit) for r in decontaminate.decontaminate(docs, bench).collect())
    assert got == Counter((i, 12 if t else 0) for i, t in rows)


def test_chunks_hold_each_window_once(monkeypatch):
    monkeypatch.setattr(windows, "PIECE", 64)
    text = bytes(random.Random(1).choice(b"abc ") for _ in range(900))
    k = windows.Chunks.join(list(windows.byte_chunks(iter([(5, text), (6, b"short"), (7, text[:101])]), 100, 32)))
    starts = sorted((u, i) for u, s, r in zip(k.uid.tolist(), k.s.tolist(), k.r.tolist()) for i in range(s, s + r))
    assert starts == [(5, i) for i in range(801)] + [(7, 0), (7, 1)]


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 99, 1000, dtype=np.uint64)
    for w in (1, 7, 1000):
        assert windows.sliding_min(x, w).tolist() == [min(x[i : i + w]) for i in range(1000 - w + 1)]
    assert len(windows.sliding_min(x, 1001)) == 0


def test_simhash(odd, odd_rows):
    fps = [brute.fingerprint(r[1]) for r in odd_rows]
    root = brute.classes(len(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    least = {}
    for r, k in zip(odd_rows, root):
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    want = Counter((r[0], f, least.get(k)) for r, f, k in zip(odd_rows, fps, root))
    got = Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(odd, tile_rows=4).collect())
    assert got == want
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len(set(root))


def test_forests_join_to_all_links():
    rng = np.random.default_rng(1)
    fp = [int(x) for x in rng.integers(0, 1 << 63, 30)]
    for x in fp[:30]:
        for _ in range(20):
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(b)
            fp.append(x)
    fp = np.unique(np.array(fp, np.uint64)).view(np.int64)
    at, u = {int(x): i for i, x in enumerate(fp)}, [int(x) % (1 << 64) for x in fp]
    want = brute.classes(len(fp), lambda a, b: (u[a] ^ u[b]).bit_count() <= 3)
    half, links = len(fp) // 2, set()
    for a, b in ((fp[:half], None), (fp[half:], None), (fp[:half], fp[half:])):
        links |= {(at[int(x)], at[int(y)]) for x, y in zip(*simhash.forest(a, b, 3))}
    assert len(links) < 3 * len(fp)
    assert brute.classes(len(fp), lambda a, b: (a, b) in links or (b, a) in links) == want


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    pairs = set(links)
    want = brute.classes(200, lambda a, b: (a, b) in pairs or (b, a) in pairs)
    assert got == {i: want[i] for i in {x for l in links if l[0] != l[1] for x in l}}
    assert connected(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
