"""The operators that use DataFrame functions only."""

import json
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

import brute
from conftest import frame, words
from sparkloom.llm import chat, decontaminate, licenses, mixing, quality, sharding, url_reputation
from sparkloom.llm.entry import TARGETS, URL_RULES


def plan_has_python(df):
    return any(x in df._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Pandas", "Arrow"))


# -- sharding ------------------------------------------------------------------------


def test_store(spark, odd, tmp_path):
    policy = sharding.Policy(target_bytes=60_000, least_bytes=4_000, fanout=3)
    store = sharding.ShardStore(spark, str(tmp_path / "s"), policy)
    assert store.version() == 0 and store.shards() == []
    for k in range(7):
        store.append(odd.repartition(1 + k % 2))
    before = store.shards()
    version = store.compact()
    after = store.shards()
    assert len(after) < len(before) and store.version() == version > 7
    assert all(len([s for s in after if s.tier == t and not policy.done(s.bytes)]) < 3 for t in {s.tier for s in after}) or store.plan()
    assert Counter(map(tuple, store.read().collect())) == Counter({k: 7 * v for k, v in Counter(map(tuple, odd.collect())).items()})
    placed = store.placement()
    assert placed.count() == 7 * odd.count()
    assert {r.shard_no for r in placed.select("shard_no").distinct().collect()} <= set(range(len(after)))
    assert not plan_has_python(placed)


def test_commits_are_exclusive(spark, odd, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"))
    store.append(odd)
    with pytest.raises(sharding.Conflict):
        store.commit(0, [])
    assert len(store.shards(1)) > 0
    manifest = (tmp_path / "s/manifest/v00000001.json").read_text().splitlines()
    assert [json.loads(x)["no"] for x in manifest] == list(range(len(manifest)))


def test_another_writer_is_faster(spark, odd, tmp_path, monkeypatch):
    """An append that loses its race is committed on top of the winner's version; a merge of shards that are gone is not."""
    root = str(tmp_path / "s")
    a, b = sharding.ShardStore(spark, root), sharding.ShardStore(spark, root)
    plain, calls = sharding.ShardStore.commit, []

    def slow(self, base, shards):
        if self is a and not calls:
            calls.append(1)
            b.append(odd.limit(3).coalesce(1))
        return plain(self, base, shards)

    monkeypatch.setattr(sharding.ShardStore, "commit", slow)
    a.append(odd)
    assert calls and a.version() == 2 and a.read().count() == odd.count() + 3 and a.read(1).count() == 3
    with pytest.raises(sharding.Conflict):
        a._change({"gone"}, [])


def test_placement_and_history_by_files(spark, odd, tmp_path):
    """A model of the store: rows by file as pyarrow reads them, tiers by size, every version whole until the vacuum."""
    import math

    import pyarrow.parquet as pq

    policy = sharding.Policy(target_bytes=40_000, least_bytes=3_000, fanout=3, arrival_rows=9)
    docs = odd.repartition(6, "text")
    store = sharding.shard_table(docs, str(tmp_path / "s"), policy, arrivals=3)
    shards = store.shards()
    want = Counter((doc, i, s.tier, s.bytes) for i, s in enumerate(shards) for doc in pq.read_table(s.path)["doc_id"].to_pylist())
    assert Counter((r.doc_id, r.shard_no, r.tier, r.shard_bytes) for r in store.placement().collect()) == want
    assert Counter(k[0] for k, n in want.items() for _ in range(n)) == Counter(r.doc_id for r in odd.collect())
    assert all(s.bytes == (tmp_path / s.path).stat().st_size for s in shards)
    for s in shards:
        assert s.tier == (0 if s.bytes < 3_000 else 1 + math.floor(math.log(s.bytes / 3_000, 3)))
    tiers = Counter(s.tier for s in shards if 2 * s.bytes <= 40_000)
    full = [t for t in sorted(tiers) if tiers[t] >= 3]
    merge = [s for s in shards if full and s.tier == full[0] and 2 * s.bytes <= 40_000]
    assert store.plan() == merge and (not merge or math.ceil(sum(s.bytes for s in merge) / 40_000) >= len(merge))
    counts = [store.read(v).count() for v in range(1, store.version() + 1)]
    assert counts == sorted(counts) and len(set(counts)) == 3 and counts[-1] == odd.count()  # a merge changes no row
    assert store.read().columns == odd.columns
    files = sum(1 for _ in (tmp_path / "s/data").rglob("part-*"))
    assert files > len(shards) and store.vacuum() == 0
    brief = sharding.shard_table(docs, str(tmp_path / "t"), sharding.Policy(40_000, 3_000, 3, 9, 0.0), arrivals=3)
    assert brief.read().count() == odd.count() and sum(1 for _ in (tmp_path / "t/data").rglob("part-*")) == len(brief.shards())
    swept = sharding.ShardStore(spark, store.root, sharding.Policy(retain_seconds=0.0))
    assert swept.vacuum() == files - len(shards) and swept.read().count() == odd.count()


def test_empty_store(spark, none, tmp_path):
    store = sharding.shard_table(none, str(tmp_path / "s"))
    assert store.version() == 1 and store.placement().count() == 0


# -- urls ----------------------------------------------------------------------------


def test_urls(spark):
    urls = [None, "no scheme", "http://A.Example.NET/en/x?q=1#f", "https://example.net", "x://sub.example.com/de/1", "x://example.com/de", "http://net/", "http://notnet/a", "http://ORG/fr/?x", "a://b://c/d", "http://É.org/fr/1", "http://h#/en/", ""]
    pages = spark.createDataFrame([(i, u, "host", 1) for i, u in enumerate(urls)] + [(1, None, "host", 1)], "page_id long, url string, host string, bad int")
    marks = spark.createDataFrame([(1, 0), (1, None), (None, 1)], "page_key long, bad int")
    rows = {(r.page_id, r.host): r for r in url_reputation.judge_urls(pages, marks, URL_RULES).collect()}
    got = {k[0]: (r.host, r.path, r.rule, r.verdict) for k, r in rows.items() if k != (1, "")}
    assert got[0] == ("", "", None, "allow")
    assert got[2] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[3][:3] == ("example.net", "", None)
    assert got[4] == ("sub.example.com", "/de/1", "example.com/de/", "block")
    assert got[5][2] is None and got[6][2] == "net/" and got[7][2] is None and got[8][:3] == ("org", "/fr/", "org/fr/")
    assert got[9][:2] == ("b:", "//c/d") and got[10][0] == "É.org" and got[11][:2] == ("h", "")
    assert url_reputation.judge_urls(pages.limit(0), marks, URL_RULES).count() == 0
    assert url_reputation.judge_urls(pages, marks.limit(0), URL_RULES).count() == len(urls) + 1


def test_domains_and_suffixes(spark):
    want = {"x.a.co.uk": ("a.co.uk", "co.uk"), "a.co.uk": ("a.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.b.com": ("b.com", "com"),
            "b.com": ("b.com", "com"), "disco.uk": ("disco.uk", "uk"), "host": ("host", "host"), "": ("", ""), "a.b.": ("b.", ""), "..": (".", "")}
    df = spark.createDataFrame([(h,) for h in want], "host string")
    got = df.select("host", url_reputation.domain_of(F.col("host")).alias("d"), url_reputation.suffix_of(F.col("host")).alias("s")).collect()
    assert {r.host: (r.d, r.s) for r in got} == want


def test_bad_hosts_are_blocked_and_small_ones_shrunk(spark):
    rows = [("bad.a.com", 1)] * 40 + [("good.a.com", 0)] * 40 + [("new.a.com", 1)] + [(f"h{i}.b.org", int(i % 5 == 0)) for i in range(50)] + [("none.a.com", None)]
    df = spark.createDataFrame(rows, "host string, bad int")
    r = {x.host: x for x in url_reputation.host_reputation(df).collect()}
    assert r["bad.a.com"].lower_bound > 0.5 > r["good.a.com"].posterior_mean
    assert r["new.a.com"].lower_bound < 0.5 < r["new.a.com"].posterior_mean + 0.3
    assert r["none.a.com"].n == 0 and 0.2 < r["none.a.com"].posterior_mean < 0.8


# -- quality -------------------------------------------------------------------------


def test_statistics(odd, odd_rows):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judge_quality(odd).collect())
    assert got == Counter((r[0], *brute.stats(r[1])) for r in odd_rows)


def test_repeat_words_slow_way(spark):
    """Hash parts that collide are told apart: every 43-bit part is made equal."""
    w = "a b c d a b c e a b c d".split()
    df = spark.createDataFrame([(w,)], "w array<string>")
    assert df.select(quality.repeat_words(F.col("w"))).first()[0] == brute.stats(" ".join(w))[4]


def test_outliers(spark, none):
    import random

    rng = random.Random(2)
    rows = []
    for i in range(300):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(60, 400))]
        rows.append((i, " ".join(w), "en", "src0", 1))
    rows += [(1000 + i, " ".join("<|#" + x for x in rows[i][1].split()), "en", "src0", 1) for i in range(20)]
    docs = frame(spark, rows)
    verdict = {r.doc_id: r for r in quality.judge_quality(docs).collect()}
    assert all(verdict[i].kept for i in range(300))
    assert not any(verdict[1000 + i].kept for i in range(20))
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in verdict.items() if r.kept}
    assert quality.judge_quality(none).count() == 0 and quality.keep_good(none).count() == 0
    assert not plan_has_python(quality.judge_quality(docs))


def test_junk_between_pipes_goes_and_one_repeated_line_stays(spark):
    import random

    rng = random.Random(3)

    def text(mark, repeat):
        lines = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) + mark(k) for k in range(45)) for _ in range(rng.randint(7, 9))]
        short = " ".join(lines[0].split()[:9])
        return "\n".join([short, *lines[1:], short] if repeat else lines)

    texts = [text(lambda k: "", False) for _ in range(300)]
    texts += [text(lambda k: " |" if k % 2 else "", False) for _ in range(20)]  # 8 symbols to 100 word characters
    texts += [text(lambda k: "", True) for _ in range(20)]
    docs = frame(spark, [(i, t, "en", "src0", 1) for i, t in enumerate(texts)])
    kept = {r.doc_id for r in quality.judge_quality(docs).collect() if r.kept}
    assert kept == set(range(300)) | set(range(320, 340))
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == kept


def numpy_mcd(x, share, raised, ridge, rng, starts=60):
    """The textbook's search: concentration from random small subsets and from all, the least determinant wins."""
    import numpy as np

    n, h, best = len(x), int(np.ceil(share * len(x))), None
    for k in range(starts):
        own = rng.choice(n, 8, replace=False) if k else np.arange(n)
        for _ in range(100):
            centre, scatter = x[own].mean(0), raised * np.cov(x[own].T, bias=True) + np.diag(ridge**2)
            d2 = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(scatter), x - centre)
            near = np.argsort(d2, kind="stable")[:h]
            if set(near) == set(own):
                break
            own = near
        det = np.linalg.slogdet(scatter)[1]
        if best is None or det < best[0]:
            best = det, centre, d2
    return best


@pytest.mark.parametrize("bad", [0.0, 0.2])
def test_the_determinant_is_least(spark, bad):
    """Against an independent search in numpy, with many random starts, on statistics with planted outliers."""
    import numpy as np

    rng = np.random.default_rng(int(bad * 10) + 1)
    n = 600
    words = np.exp(rng.normal(5.5, 0.5, n)).astype(int) + 50
    chars = (words * np.exp(rng.normal(1.5, 0.08, n))).astype(int)
    symbols = rng.poisson(chars * 0.01)
    dups, repeats, lines = rng.poisson(1, n), (words * rng.beta(2, 30, n)).astype(int), words // 10 + 1
    out = np.arange(n) < bad * n
    symbols[out] = chars[out] // 4
    chars[out] = chars[out] * 2
    rows = [(i, "en", "s", *map(int, r)) for i, r in enumerate(zip(words, chars, symbols, dups, repeats, lines))]
    stats = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    lim = quality.Limits()
    model = quality.fit(stats, lim)
    got = {r.doc_id: r.d2 for r in model.distances(stats).select("doc_id", "d2").collect()}
    x = np.array([list(r) for r in stats.orderBy("doc_id").select(*(F.expr(e).alias(k) for k, e in quality._VECTOR.items())).collect()], float)
    ridge = np.array([r * quality.SCALE for _, _, r in quality.FEATURES])
    det, centre, d2 = numpy_mcd(x, lim.subset, quality.consistency(lim.subset), ridge, rng)
    f = model.factors.first().asDict()
    assert 2 * sum(np.log(f[f"l{i}_{i}"]) for i in range(5)) <= det + 0.05  # classes of distance end a little off the exact share
    assert np.allclose([f[f"m{i}"] for i in range(5)], centre, atol=0.05 * quality.SCALE)
    mine, theirs = {i for i, v in got.items() if v > lim.cutoff}, set(np.flatnonzero(d2 > lim.cutoff).tolist())
    assert len(mine ^ theirs) <= 4 and mine >= set(np.flatnonzero(out).tolist())


def test_consistency():
    """Known quantiles of chi-square: with 5 degrees 0.95 at 11.0705, 0.999 at 20.515; with 7, 0.95 at 14.0671."""
    assert quality._chi_square(11.0705, 5) == pytest.approx(0.95, abs=1e-5)
    assert quality._chi_square(14.0671, 7) == pytest.approx(0.95, abs=1e-5)
    assert 1 - quality._chi_square(quality.Limits().cutoff, 5) == pytest.approx(0.001, rel=1e-3)
    assert quality.consistency(0.75) == pytest.approx(1.4121, abs=1e-3) and quality.consistency(1.0) == pytest.approx(1)


def test_base_rules(spark):
    texts = [" ".join(f"w{i}" for i in range(49)), " ".join(f"w{i}" for i in range(50)), "x y z " * 20, None]
    got = [r.base_failed for r in quality.judge_quality(frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])).orderBy("doc_id").collect()]
    assert got == [True, False, True, True]


# -- decontamination -----------------------------------------------------------------


def test_decontamination(spark, odd, odd_rows, none):
    passage = odd_rows[6][1]
    items = [(0, passage), (1, "Kaba"), (1, "one TWO"), (None, passage[:200]), (2, None), (3, "..."), (4, "never seen words here"), (5, " ".join(passage.split()[5:15]))]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, uid long")
    win = {}
    for i, t in items:
        w = brute.terms(t)
        for k in range(max(1, len(w) - 9)) if w else []:
            win.setdefault(tuple(w[k : k + 10]), set()).add("null" if i is None else str(i))
    want = Counter()
    for r in odd_rows:
        w, hit, ids = brute.terms(r[1]), set(), set()
        for n in {len(k) for k in win}:
            for i in range(len(w) - n + 1):
                if (found := win.get(tuple(w[i : i + n]))):
                    hit |= set(range(i, i + n))
                    ids |= found
        want[r[0], len(w), len(hit), tuple(sorted(ids)), bool(hit)] += 1
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), r.contaminated) for r in decontaminate.decontaminate(odd, bench).collect())
    assert got == want
    clean = decontaminate.keep_clean(odd, bench)
    assert clean.columns == odd.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(k[0] for k, n in want.items() for _ in range(n) if not k[4])
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert decontaminate.decontaminate(odd, bench.limit(0)).filter("contaminated").count() == 0


def test_proximity(spark, odd, odd_rows, none):
    """Against every span of every document, with items whose words are mixed, spread, repeated, unknown, few or none."""
    passage = odd_rows[6][1].split()
    mixed = [*passage[3:8][::-1], "kaba", *passage[9:16]]
    texts = [(0, " ".join(passage)), (1, "one"), (1, "two one"), (None, " ".join(passage[:7])), (2, None), (3, "..."), (4, "never seen"), (5, " ".join(mixed)), (6, "ab " * 12), (7, "one one")]
    bench = spark.createDataFrame([(*x, 1) for x in texts], "item_id long, text string, uid long")
    for width, slop in ((10, 3), (4, 0), (1, 2)):
        want = Counter()
        for r in odd_rows:
            w, near = brute.terms(r[1]), set()
            for item, text in texts:
                b = brute.terms(text)
                n = min(width, len(b))
                for q in range(len(b) - n + 1 if b else 0):
                    own = set(b[q : q + n])
                    near |= {(item, q, s) for s in range(len(w)) if w[s] in own and own <= set(w[s : s + n + slop])}
            want[r[0], len(w), frozenset(near)] += 1
        found = decontaminate.PositionalIndex(odd, bench).matches(width, slop).collect()
        assert Counter((r.doc_id, r.n_words, frozenset(map(tuple, r.near))) for r in found) == want
        for r in found:
            assert len(r.near) == len(set(r.near)) and {m.item_id for m in r.matches} <= {m.item_id for m in r.near}
    assert decontaminate.decontaminate(none, bench, slop=3).count() == 0
    assert decontaminate.decontaminate(odd, bench.limit(0), slop=3).filter("n_near > 0 OR contaminated").count() == 0


# -- licences ------------------------------------------------------------------------


def test_licenses(spark, odd, none):
    texts = ["Intro\nReleased under the MIT License.\nEnd", "licensed UNDER the apache-license, version 2.0!", "the licence is nice", None, "",
             "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nmore"]
    texts += ["See below. This project is licensed under the MIT License. Contributions are welcome.", "Some words here. This Source Code Form is subject to the\nterms of the Mozilla Public License, v. 2.0. More words\nfollow in this paragraph", "Apache License\nVersion 2.0, January 2004", "x " * 20000 + ". All rights reserved. " + "y " * 20000]
    got = {(r.doc_id, r.unit, r.unit_no, r.unit_size, r.license) for r in licenses.scan_licenses(frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])).collect()}
    assert {g for g in got if g[1] != "sentences"} == {(0, "line", 1, 1, "MIT"), (1, "line", 0, 1, "Apache-2.0"), (5, "paragraph", 0, 1, "MIT"), (8, "paragraph", 0, 1, "Apache-2.0"), (8, "line", 1, 1, "Apache-2.0"), (0, "paragraph", 0, 1, "MIT"), (5, "text", 0, 1, "MIT")}
    assert {(g[0], g[2], g[4]) for g in got if g[1] == "sentences"} >= {(6, 1, "MIT"), (7, 1, "MPL-2.0"), (8, 0, "Apache-2.0"), (9, 1, "proprietary")}
    assert {g[0] for g in got} == {0, 1, 5, 6, 7, 8, 9}
    assert licenses.scan_licenses(odd).count() == 0 and licenses.scan_licenses(none).count() == 0
    with pytest.raises(ValueError):
        licenses.scan_licenses(odd, [("x", "word")])


def test_whole_licence_text_without_its_own_words_alone(spark):
    whole = "\n\n".join(" ".join(f"w{(i * 40 + j) ** 2 % 389}" for j in range(40)) + "." for i in range(12))
    templates = [("long", whole), ("short", "w1 w2 w3 w4")]
    near, far = whole.replace("w100 ", "other "), whole[: len(whole) // 2]
    docs = frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate([whole, near, far, "a\n\nb"])])
    got = [(r.doc_id, r.unit, r.license) for r in licenses.scan_licenses(docs, templates).orderBy("doc_id").collect()]
    assert got == [(0, "text", "long"), (1, "text", "long")]


def units_of(text, run=3):
    """The units of a text by plain Python."""
    yield from (("line", i, 1, x) for i, x in enumerate(text.split("\n")))
    blocks = re.split(r"\n[ \t\r]*\n", text)
    yield from (("paragraph", i, 1, x) for i, x in enumerate(blocks) if "\n" in x.strip(" "))
    if len(blocks) > 1:
        yield "text", 0, 1, text
    p = re.split(r"[.!?;:][ \t\r\n]+|\n[ \t\r]*\n", text)
    yield from (("sentences", i, r, " ".join(p[i : i + r])) for r in range(1, run + 1) for i in range(len(p) - r + 1))


def test_dice_and_pruning_lose_nothing(spark):
    import random

    rng, rows, want = random.Random(4), [], {}
    grams = [licenses.template_bigrams(t) for _, t in licenses.TEMPLATES]
    for i in range(200):
        parts = []
        for _ in range(rng.randint(1, 3)):
            w = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w)) : rng.randrange(len(w)) + 1] = rng.choice([["extra"], []]) or w[:1]
            parts += [" ".join(w[:90]), rng.choice(["\n", " ", "\n\n", ". ", "; it is so. "])]
        text = "".join(parts)
        rows.append((i, text, "en", "s", 1))
        for unit, no, size, s in units_of(text):
            mine = set(licenses.template_bigrams(s))
            best = max((2 * len(mine & set(g)) / (len(mine) + len(g)), -n) for n, g in enumerate(grams))
            if best[0] >= 0.8:
                want[i, unit, no, size] = (-best[1], round(best[0], 6))
    got = {(r.doc_id, r.unit, r.unit_no, r.unit_size): (r.template_no, r.dice) for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert got == want and {k[1] for k in want} == {"line", "paragraph", "sentences", "text"}


# -- mixing --------------------------------------------------------------------------


def test_raking_meets_the_margins(spark):
    rows = [(i, "w " * (1 + i % 7), ["en", "de", None][i % 3], ["a", "b", "c", "new"][i * i % 4], 1) for i in range(400)]
    targets = {"source": {"a": 3, "b": 1, "c": 1}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"general": 1.0}}
    out = mixing.mix(frame(spark, rows), targets, iterations=60).collect()
    total = sum(r.n_tokens for r in out)
    by = Counter()
    for r in out:
        by["s", r.source if r.source in targets["source"] else "*"] += r.n_tokens * r.multiplier
        by["l", r.lang or "*"] += r.n_tokens * r.multiplier
    other = sum(r.n_tokens for r in out if r.lang is None)
    assert by["l", "en"] == pytest.approx((total - other) / 2, rel=1e-3) == pytest.approx(by["l", "de"], rel=1e-3)
    present = {r.source for r in out} & set(targets["source"])
    rest = total - sum(r.n_tokens for r in out if r.source not in targets["source"])
    share = sum(targets["source"][s] for s in present)
    for s in present:
        assert by["s", s] == pytest.approx(rest * targets["source"][s] / share, rel=1e-3)
    for r in out:
        assert r.probability == pytest.approx(min(1, r.multiplier), abs=1e-5)
        assert r.probability == 0 or r.weight * r.probability == pytest.approx(r.multiplier, abs=1e-4)
        assert r.kept or r.probability < 1


def test_sampling(odd, none):
    out = mixing.mix(odd, TARGETS)
    assert out.count() == odd.count() and not plan_has_python(out)
    assert out.filter("n_tokens = 0 AND kept").count() == 0
    kept = mixing.sample(odd, TARGETS)
    assert kept.columns == odd.columns
    drawn = Counter((r.doc_id, r.text) for r in kept.collect())
    for r in mixing.mix(odd, TARGETS, keep=["text"]).collect():
        n = drawn[r.doc_id, r.text]
        assert n % 1 == 0 and (r.multiplier >= 1) <= (n > 0) and (n == 0) >= (r.multiplier == 0)
    assert mixing.mix(none, TARGETS).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(odd, {"source": {f"s{i}": 1 for i in range(20_000)}, "lang": {}, "topic": {}})


def test_the_sample_itself_meets_the_targets(spark):
    """Rare cells are repeated: token shares of the rows as they are, without weights."""
    rows = [(i, "w " * (20 + i % 9), "en" if i % 20 else "de", "a" if i % 7 else "b", 1) for i in range(4000)]
    targets = {"source": {"a": 1, "b": 1}, "lang": {"en": 0.6, "de": 0.4}, "topic": {}}
    got = mixing.sample(frame(spark, rows), targets).groupBy("source", "lang").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()
    total = sum(r.n for r in got)
    assert sum(r.n for r in got if r.lang == "de") / total == pytest.approx(0.4, abs=0.02)
    assert sum(r.n for r in got if r.source == "b") / total == pytest.approx(0.5, abs=0.02)
    assert total == pytest.approx(sum(20 + i % 9 for i in range(4000)), rel=0.05)


def test_rows_without_ids_are_drawn_one_by_one(spark):
    rows = [(None, f"text number {i}", "en", "a", 1) for i in range(400)]
    targets = {"source": {"a": 1}, "lang": {}, "topic": {}}
    kept = mixing.mix(frame(spark, rows), targets, rate=0.5).filter("kept").count()
    assert 150 < kept < 250


def test_topics_from_a_column(spark):
    docs = spark.createDataFrame([(i, "a b c", "en", "s", "maths" if i % 4 else None) for i in range(80)], "doc_id long, text string, lang string, source string, label string")
    out = mixing.mix(docs, {"source": {}, "lang": {}, "topic": {"maths": 1.0}}, topic_column="label")
    assert {r.topic for r in out.collect()} == {"maths", None}
    assert mixing.sample(docs, {"source": {}, "lang": {}, "topic": {"maths": 1.0}}, topic_column="label").columns == docs.columns


# -- chats ---------------------------------------------------------------------------


def test_chats(spark):
    def conv(i, *turns):
        return [(i, k, "user" if k % 2 == 0 else "assistant", t, "x") for k, t in enumerate(turns)]

    rows = conv(1, "a", "b") + conv(2, "a", "b", "c") + conv(3, "a", "b", "c") + conv(4, "a", "x") + conv(5, "a") + conv(6, "ab") + conv(7, None) + conv(8, "")
    rows += [(None, 0, None, "<|im_end|>", "x"), (9, None, "user", "late", "x"), (9, None, "user", "late", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    got = {r.conv_id: (r.n_turns, r.n_copies) for r in chat.format_chats(df).collect()}
    assert got == {2: (3, 2), 4: (2, 1), 6: (1, 1), 7: (1, 1), 8: (1, 1), None: (1, 1), 9: (2, 1)}
    assert not plan_has_python(chat.format_chats(df))
    text = {r.conv_id: r.text for r in chat.format_chats(df).collect()}
    assert text[4] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n"
    assert text[None] == "<|im_start|>unknown\n< |im_end|><|im_end|>\n"
    assert chat.format_chats(df.limit(0)).count() == 0


def test_turns_without_a_conversation_stand_alone(spark):
    rows = [(None, i, "user", f"t{i}") for i in range(30)] + [(None, 0, "user", "t5"), (3, 0, "user", "t7"), (None, 0, "a\nb", None)]
    got = {r.text: (r.conv_id, r.n_turns, r.n_copies) for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == 31 and {v[1] for v in got.values()} == {1}
    assert got["<|im_start|>user\nt5<|im_end|>\n"] == (None, 1, 2) and got["<|im_start|>user\nt7<|im_end|>\n"] == (3, 1, 2)
    assert "<|im_start|>a b\n<|im_end|>\n" in got


def test_long_conversations(spark):
    """Linear in the turns; prefixes across the blocks of the chain."""
    n = 100_000
    turns = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    short = turns.filter(f"turn < {3 * chat.STEP + 1}").withColumn("conv_id", F.lit(2).cast("long"))
    other = turns.filter(f"turn < {2 * chat.STEP}").withColumn("conv_id", F.lit(3).cast("long")).withColumn("text", F.concat("text", F.when(F.col("turn") == 2 * chat.STEP - 1, "x").otherwise("")))
    got = {r.conv_id: r.n_turns for r in chat.collapse_snapshots(turns.unionByName(short).unionByName(other)).select("conv_id", "n_turns").collect()}
    assert got == {1: n, 3: 2 * chat.STEP}


def test_shards_keep_all_columns(spark, tmp_path):
    """Arrivals with more, fewer, renamed in case, wider and narrower columns, through merges and vacuum."""
    store = sharding.ShardStore(spark, f"{tmp_path}/s", sharding.Policy(retain_seconds=0.0))
    arrivals = [
        spark.sql("SELECT 1L AS doc_id, 'a' AS text, CAST(1 AS INT) AS n, CAST(1.5 AS FLOAT) AS x"),
        spark.sql("SELECT 2L AS doc_id, 'b' AS text, 'en' AS lang, CAST(1 AS BIGINT) << 40 AS N"),
        spark.sql("SELECT 'c' AS TEXT, CAST(0.1 AS DOUBLE) AS x"),
        spark.sql("SELECT CAST(4 AS INT) AS doc_id, array(struct(1 AS k)) AS more"),
    ]
    for a in arrivals:
        store.append(a)
    want = {(1, "a", 1, 1.5, None, None), (2, "b", 1 << 40, None, "en", None), (None, "c", None, 0.1, None, None), (4, None, None, None, None, (1,))}

    def rows():
        return {(*r[:5], r.more and tuple(m.k for m in r.more)) for r in store.read().collect()}

    assert store.read().columns == ["doc_id", "text", "n", "x", "lang", "more"] and rows() == want
    assert store.read(1).columns == ["doc_id", "text", "n", "x"]
    files = len(store.shards())
    store.compact()
    assert len(store.shards()) < files and rows() == want and store.schema().simpleString() == store.read().schema.simpleString()
    assert store.vacuum() == 0 and sum(1 for _ in (tmp_path / "s/data").rglob("part-*.parquet")) == len(store.shards())
    assert {(r.doc_id, r.shard_no) for r in store.placement().collect()} == {(i, 0) for i in (1, 2, 4, None)}
    version = store.version()
    with pytest.raises(ValueError, match="lang is string"):
        store.append(spark.sql("SELECT 5L AS doc_id, 7 AS lang"))
    assert store.version() == version


def test_items_of_20000_words(spark):
    """A document that holds a very long item with two words changed, and others with parts of it."""
    rng = random.Random(8)
    item = [f"w{rng.randrange(3000)}" for _ in range(20_000)]
    doc = list(item)
    doc[5_000] = doc[15_000] = "zzz"
    docs = [(1, " ".join(["x", *doc])), (2, " ".join(item[777:800])), (3, " ".join(item[40:49])), (4, " ".join(words(rng, 300))), (5, " ".join(item[-10:] + item[:12]))]
    rows = [(i, t, "en", "s", 0) for i, t in docs]
    items = spark.createDataFrame([("long", " ".join(item)), ("short", "zzz")], "item_id string, text string")
    began = time.time()
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontaminate.decontaminate(frame(spark, rows), items).collect()}
    assert time.time() - began < 90
    assert got == {1: (20_001, 20_000, ["long", "short"]), 2: (23, 23, ["long"]), 3: (9, 0, []), 4: (300, 0, []), 5: (22, 22, ["long"])}


@pytest.mark.parametrize("name", ["op2_url_reputation", "op5_decontamination", "op6_license_scan"])
def test_no_python_in_native_queries(spark, name):
    from sparkloom.llm.entry import QUERIES

    assert not plan_has_python(QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_broadcasts_are_bounded_by_bytes(spark):
    from sparkloom.llm.common import light

    few = spark.createDataFrame([("x" * 5000,)] * 10, "t string")
    for most, hinted in ((60_000, True), (40_000, False)):
        assert ("broadcast" in light(few, most)._jdf.queryExecution().analyzed().toString().lower()) is hinted
    assert "broadcast" in light(few.limit(0))._jdf.queryExecution().analyzed().toString().lower()
