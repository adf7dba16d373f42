"""Stages and queries on a small written copy of the tables."""

import corpus_pipeline
import pytest
from conftest import frame

from sparkloom.llm import entry


@pytest.fixture(scope="module")
def sf_dir(spark, odd, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    odd.write.parquet(f"{d}/documents.parquet")
    passage = odd.filter("doc_id = 6").first().text
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, odd, sf_dir):
    docs, counts = odd, [odd.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == odd.columns
        counts.append(docs.count())
    assert counts[:-1] == sorted(counts[:-1], reverse=True) and counts[-2] < counts[0]  # mixing may repeat rows
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert sorted(r.doc_id for r in placed.collect()) == sorted(r.doc_id for r in docs.collect())


def test_run_matches_the_stages_by_hand(spark, sf_dir, tmp_path):
    """The pipeline's rows from DuckDB's quality verdicts, brute-force fingerprints and windows, and DuckDB's raked weights."""
    import hashlib
    import json
    import math
    from collections import Counter

    import brute
    import duckdb
    import pyarrow.parquet as pq
    from sparkloom.llm.sql import mixing_sql

    spark.conf.set("spark.sparkloom.shards.dir", str(tmp_path / "shards"))
    try:
        got = Counter(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect())
    finally:
        spark.conf.unset("spark.sparkloom.shards.dir")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet/*.parquet')")
    head, _, tail = entry.oracle_sql()["op3_quality_rules"].rpartition("SELECT doc_id, n_words")
    good = con.execute(f"SELECT doc_id, text, lang, source FROM ({head}SELECT doc_id, text, lang, source, n_words{tail}) WHERE kept").fetchall()
    fps = [brute.fingerprint(r[1]) for r in good]
    root = brute.classes(len(good), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    groups = {}
    for r, k in zip(good, root):
        groups.setdefault(k, []).append(r)
    unique = [min(g, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest())) for g in groups.values()]
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = brute.terms(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    clean = [r for r in unique if not any(tuple(w[i : i + 10]) in windows for w in [brute.terms(r[1])] for i in range(len(w) - 9))]
    assert len(good) > len(unique) > len(clean) > 5
    con.execute("DROP VIEW documents")
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", clean)
    want = Counter()
    for doc, m in con.execute(f"SELECT doc_id, multiplier FROM ({mixing_sql(entry.TARGETS)})").fetchall():
        u = int(hashlib.md5(f"{doc}|mix".encode()).hexdigest()[:8], 16) / 2**32
        want[doc] += math.floor(m) + (u < m - math.floor(m))
    assert got == +want
    # the shards lie where the caller said, whole
    newest = max((tmp_path / "shards/manifest").glob("v*.json"))
    files = [json.loads(x)["path"] for x in newest.read_text().splitlines()]
    assert Counter(x for f in files for x in pq.read_table(f)["doc_id"].to_pylist()) == got


def test_empty_table(spark, none, sf_dir):
    docs = none
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_registry():
    names = list(entry.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert set(entry.oracle_sql()) <= set(names)


def test_frame_helper(spark, odd_rows):
    assert frame(spark, odd_rows).count() == len(odd_rows)
