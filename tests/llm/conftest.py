import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, uid long, n_words string, topic string, fp long, h long, g string"
VOCABULARY = [a + b for a in ("ka", "lo", "mi", "nu", "re", "sa", "Ti", "vé") for b in ("ba", "de", "fi", "go", "hu", "ja")]


def words(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """NULLs, empty and blank texts, one long text, copies, near copies, repeated ids and rows, shared passages."""
    rng = random.Random(7)
    passage = " ".join(words(rng, 60))
    long = " ".join(words(rng, 9000)) + "\n" + passage
    texts = [None, "", " \n\t ", "one", "one two", long, passage, passage, passage + " end"]
    for i in range(40):
        own = words(rng, rng.randint(1, 160))
        if i % 3 == 0:
            own[len(own) // 2 : len(own) // 2] = passage.split()
        texts.append("\n".join(" ".join(own[k : k + 9]) for k in range(0, len(own), 9)))
    texts += [texts[12], texts[12] + " x", texts[15] * 3, "ab " * 400, "a" * 700, "é" * 300]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(None, passage), (None, None), (3, "one"), (3, texts[20]), (9, texts[9]), (9, texts[9])]
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src1", "odd", None]), None if t is None else len(t)) for i, t in rows]


def frame(spark, rows):
    """documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, True, -1, "x", "y", 5, 6, "z") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return frame(spark, odd_rows).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def order_keys(odd_rows):
    """uid of each row as ``numbered`` defines it: NULL ids first, equal ids by md5 of the text."""
    import hashlib

    def key(r):
        return (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest())

    ranks = {k: i for i, k in enumerate(sorted({key(r) for r in odd_rows}))}
    return [ranks[key(r)] for r in odd_rows]
