"""Quality rules: base limits, then robust multivariate outliers.

Each document's statistics become a vector of logarithms, in fixed point so that sums
are exact in any order.  Per language and source the minimum-covariance-determinant
estimate of location and scatter is found by concentration steps: take the ``subset``
share of documents that is nearest by Mahalanobis distance, estimate again, repeat while
the determinant falls.  Three starts (medians and absolute deviations; all documents; the
half nearest to the medians) are followed side by side, and each group takes the one whose
scatter has the least determinant.  The scatter of the nearest share is raised to that of
a whole normal sample (``consistency``), and a ridge is added: the least deviation that is
told apart where a statistic hardly varies.  Squared distances are therefore at most
chi-square, and documents above its quantile ``cutoff`` are rejected.

The texts are read once, in one pass without a shuffle; the steps run over one row of
integers per document, and each step is one pass: sums are kept per group, start and class
of distance, a bounded histogram from which the share and its sums follow.  All aggregates
combine before the shuffle, so a source that holds a third of all documents is no hot key.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, stored, words

SCALE = 1024
#: name, fixed-point expression (SQL over the statistics of documents with words), ridge in units of SCALE
FEATURES: list[tuple[str, str, float]] = [
    ("x0", "ln(n_words)", 0.2),
    ("x1", "ln(word_chars / n_words)", 0.05),
    ("x2", "ln(1 + 100e0 * n_symbols / word_chars)", 0.5),
    # one repeated line tells nothing, and a share of few lines little
    ("x3", "ln(1 + 100e0 * greatest(n_dup_lines - 1, 0) / (n_lines + 20))", 0.5),
    ("x4", "ln(1 + 100e0 * n_repeat_words / n_words)", 0.5),
]
NAMES = [n for n, _, _ in FEATURES]
#: What half the logarithm of a determinant has to fall by for another step.
FALL = 1e-3


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    max_repeat_percent: int = 50
    min_group: int = 50  # smaller groups join their language's rest, then the rest of all
    subset: float = 0.75
    steps: int = 50  # at most; some ten suffice
    cutoff: float = 20.515  # of the squared distance; chi-square with 5 degrees passes it with p = 0.001


def _chi_square(x: float, degrees: int) -> float:
    """Distribution function for odd degrees of freedom."""
    term, out = math.sqrt(2 * x / math.pi) * math.exp(-x / 2), math.erf(math.sqrt(x / 2))
    for k in range(1, degrees - 1, 2):
        out, term = out - term, term * x / (k + 2)
    return out


def consistency(subset: float) -> float:
    """Scatter of a normal sample over that of its ``subset`` share nearest to the centre."""
    p, low, high = len(FEATURES), 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi_square(middle, p) < subset else (low, middle)
    return subset / _chi_square(high, p + 2)


def _same(a: Column, b: Column) -> Column:
    return F.shiftrightunsigned(a.bitwiseXOR(b), 21) == 0


def _covered(starts: Column) -> Column:
    """Words in the union of 3-word windows that begin at the sorted ``starts``."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(
        starts, zero,
        lambda a, p: F.struct((a["n"] + 3 - F.greatest(F.lit(0).cast("long"), a["end"] - p)).alias("n"), (p + 3).alias("end")),
        lambda a: a["n"],
    )


def repeat_words(w: Column) -> Column:
    """Words in 3-word windows that are found twice or more in the array ``w``.

    Window hashes are sorted together with their positions as packed longs (43 bits of
    hash); where two different hashes share those bits, or a text has over 2^21 windows,
    whole 64-bit hashes are sorted instead.
    """
    low = (1 << 21) - 1

    def by_hash(h: Column) -> Column:
        def from_sorted(k: Column) -> Column:
            def pos(x: Column) -> Column:
                return x.bitwiseAND(F.lit(low))

            def flag(x: Column, i: Column) -> Column:
                before, after = F.get(k, i - 1), F.get(k, i + 1)
                return (
                    F.when((i > 0) & _same(x, before), F.when(F.get(h, pos(x).cast("int")) == F.get(h, pos(before).cast("int")), pos(x)).otherwise(F.lit(-1).cast("long")))
                    .when((i + 1 < F.size(k)) & _same(x, after), pos(x))
                )

            starts = F.sort_array(F.filter(F.transform(k, flag), lambda p: p.isNotNull()))
            return let(starts, lambda s: F.when(F.get(s, F.lit(0)) < 0, slow(h)).otherwise(_covered(s)))

        packed = F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
        return F.when(F.size(h) > low, slow(h)).otherwise(let(F.sort_array(packed), from_sorted))

    def slow(h: Column) -> Column:
        def from_sorted(k: Column) -> Column:
            def flag(x: Column, i: Column) -> Column:
                return F.when(((i > 0) & (F.get(k, i - 1)["h"] == x["h"])) | ((i + 1 < F.size(k)) & (F.get(k, i + 1)["h"] == x["h"])), x["p"])

            return _covered(F.sort_array(F.filter(F.transform(k, flag), lambda p: p.isNotNull())))

        return let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("p")))), from_sorted)

    hashes = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return let(hashes, by_hash)


def text_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (long) of whole texts.

    n_lines counts lines with a word.  NULL texts have no words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))

    def of(w: Column, ls: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"), repeat_words(w).alias("n_repeat_words"), F.size(ls).cast("long").alias("n_lines"),
        )

    # a generator, since filters on its columns stay above it; a projection's would be
    # pushed down and evaluate the statistics once for each mention
    return docs.select(*keep, F.inline(F.array(let(words(text), lambda w: let(lines, lambda ls: of(w, ls))))))


def _bin(d2: Column) -> Column:
    """Squared distance in 64ths of a binary logarithm: ordered, and of few values."""
    return F.floor(F.lit(64.0) * F.log2(F.least(d2, F.lit(1e12)) + 1)).cast("int")


def _distance(whitened: list[Column]) -> Column:
    out = whitened[0] * whitened[0]
    for z in whitened[1:]:
        out = out + z * z
    return out


def _params(sums: DataFrame, raised: float) -> DataFrame:
    """g, start, n, means m<i> and the Cholesky factor l<i>_<j> of the scatter, times ``raised``, with ridge, and ld, its log-determinant, from exact sums."""
    p = len(FEATURES)
    df = sums.select("g", "start", *(((F.col(f"s{i}").cast("double") / F.col("n")).alias(f"m{i}")) for i in range(p)), "n", *(f"s{i}_{j}" for i in range(p) for j in range(i + 1)))
    df = df.select(
        "g", "start", "n", *(f"m{i}" for i in range(p)),
        *((F.lit(raised) * (F.col(f"s{i}_{j}").cast("double") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) + (F.lit((FEATURES[i][2] * SCALE) ** 2) if i == j else F.lit(0.0))).alias(f"c{i}_{j}") for i in range(p) for j in range(i + 1)),
    )
    for j in range(p):  # Cholesky, column by column
        total = F.col(f"c{j}_{j}")
        for k in range(j):
            total = total - F.col(f"l{j}_{k}") * F.col(f"l{j}_{k}")
        df = df.withColumn(f"l{j}_{j}", F.sqrt(F.greatest(total, F.lit(1e-6))))
        new = {}
        for i in range(j + 1, p):
            total = F.col(f"c{i}_{j}")
            for k in range(j):
                total = total - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            new[f"l{i}_{j}"] = total / F.col(f"l{j}_{j}")
        df = df.withColumns(new) if new else df
    return df.select("g", "start", "n", *_PARAMS, _log_det().alias("ld"))


_PARAMS = [*(f"m{i}" for i in range(len(FEATURES))), *(f"l{i}_{j}" for i in range(len(FEATURES)) for j in range(i + 1))]


def _log_det() -> Column:
    out = F.ln("l0_0")
    for i in range(1, len(FEATURES)):
        out = out + F.ln(f"l{i}_{i}")
    return out


def _sums(rows: DataFrame, by: list[str]) -> DataFrame:
    """Numbers of rows, sums and products of the vectors; exact."""
    p = len(FEATURES)
    products = [(F.col(NAMES[i]) * F.col(NAMES[j]), f"s{i}_{j}") for i in range(p) for j in range(i + 1)]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.sum(n).alias(f"s{i}") for i, n in enumerate(NAMES)), *(F.sum(c).alias(n) for c, n in products))


def _nearest(near: DataFrame, share: float) -> DataFrame:
    """The sums of the nearest ``share`` of each group and start, by a histogram of d2's classes."""
    hist = _sums(near.select("g", "start", *NAMES, _bin(F.col("d2")).alias("bin")), ["g", "start", "bin"])
    whole = Window.partitionBy("g", "start")
    before = F.coalesce(F.sum("n").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = hist.withColumns({"before": before, "all": F.sum("n").over(whole)}).filter(F.col("before") < F.lit(share) * F.col("all"))
    columns = [c for c in hist.columns if c not in ("g", "start", "bin")]
    return inside.groupBy("g", "start").agg(*(F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in columns))


def _whiten(df: DataFrame) -> DataFrame:
    """Forward substitution: adds d2, the squared Mahalanobis distance."""
    p = len(FEATURES)
    for i in range(p):
        total = F.col(NAMES[i]) - F.col(f"m{i}")
        for j in range(i):
            total = total - F.col(f"l{i}_{j}") * F.col(f"z{j}")
        df = df.withColumn(f"z{i}", total / F.col(f"l{i}_{i}"))
    return df.withColumn("d2", _distance([F.col(f"z{i}") for i in range(p)]))


@dataclass(frozen=True)
class Model:
    """names: g0 (language and source) and g, the group that stands for it; factors: g, location, scatter."""

    names: DataFrame
    factors: DataFrame

    def distances(self, stats: DataFrame) -> DataFrame:
        """Adds d2, the squared robust distance, to documents with words; NULL where no group is known."""
        df = stats.withColumns({n: F.expr(e) for n, e in _VECTOR.items()}).withColumn("g0", _exact_group())
        return _whiten(df.join(self.names, "g0", "left").join(self.factors, "g", "left"))


_VECTOR = {n: f"CAST(round({SCALE} * {e}) AS BIGINT)" for n, e, _ in FEATURES}


def _exact_group() -> Column:
    return F.concat_ws("|", F.lit("g"), F.coalesce("lang", F.lit("-")), F.coalesce("source", F.lit("-")))


def _failed(lim: Limits) -> Column:
    return (F.col("n_words") < lim.min_words) | (100 * F.col("n_repeat_words") > lim.max_repeat_percent * F.col("n_words"))


def group_names(stats: DataFrame, lim: Limits) -> DataFrame:
    """g0, g: language and source; where too few, the language's rest, then the rest of all."""
    lang = F.concat_ws("|", F.lit("l"), F.coalesce("lang", F.lit("-")))
    counts = stats.groupBy(_exact_group().alias("g0"), lang.alias("g1")).agg(F.count(F.lit(1)).alias("n"))
    langs = counts.filter(F.col("n") < lim.min_group).groupBy("g1").agg(F.sum("n").alias("n1"))
    return counts.join(langs, "g1", "left").select(
        "g0", F.when(F.col("n") >= lim.min_group, F.col("g0")).when(F.col("n1") >= lim.min_group, F.col("g1")).otherwise("rest").alias("g")
    )


def fit(stats: DataFrame, lim: Limits = Limits()) -> Model:
    """Estimate from the statistics of documents with words that pass the base rules."""
    p = len(FEATURES)
    names = stored(group_names(stats, lim), "mcd-names")
    vectors = stats.withColumn("g0", _exact_group()).join(names, "g0").select("g", *(F.expr(e).alias(n) for n, e in _VECTOR.items()))
    vectors = stored(vectors, "mcd-vectors")
    raised = consistency(lim.subset)
    centre = vectors.groupBy("g").agg(*(F.percentile(n, F.lit(0.5)).alias(f"m{i}") for i, n in enumerate(NAMES)))
    around = vectors.join(centre, "g")
    spread = around.groupBy("g").agg(*(F.percentile(F.abs(F.col(n) - F.col(f"m{i}")), F.lit(0.5)).alias(f"a{i}") for i, n in enumerate(NAMES)))
    factor = [(F.greatest(F.lit(1.4826) * F.col(f"a{i}"), F.lit(FEATURES[i][2] * SCALE)) if i == j else F.lit(0.0)).alias(f"l{i}_{j}") for i in range(p) for j in range(i + 1)]
    middle = stored(centre.join(spread, "g").select("g", F.lit(0).alias("start"), *(f"m{i}" for i in range(p)), *factor), "mcd-middle")
    half = _params(_nearest(_whiten(vectors.join(middle, "g")).withColumn("start", F.lit(2)), 0.5), raised)
    every = _params(_sums(vectors, ["g"]).withColumn("start", F.lit(1)), 1.0)
    starts = ["g", "start", *_PARAMS]
    params = middle.select(starts).unionByName(every.select(starts)).unionByName(half.select(starts))
    params = stored(params.withColumns({"ld": _log_det(), "falls": F.lit(True)}), "mcd-start")
    for step in range(lim.steps):
        # a start is done for a group once its determinant no longer falls; what it had then stays
        going = params.filter("falls")
        if going.isEmpty():
            break
        new = _params(_nearest(_whiten(vectors.join(going.select(starts), "g")), lim.subset), raised)
        new = new.select("g", "start", F.struct(*_PARAMS, "ld").alias("new"))
        falls = F.col("new").isNotNull() & (F.lit(step == 0) | (F.col("new.ld") < F.col("ld") - FALL))
        joined = params.join(new, ["g", "start"], "left").withColumn("falls", falls)
        params = stored(joined.select("g", "start", *(F.when(F.col("falls"), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in [*_PARAMS, "ld"]), "falls"), f"mcd-params{step}")
    best = params.groupBy("g").agg(F.min_by(F.struct(*_PARAMS), F.struct("ld", "start")).alias("b")).select("g", "b.*")
    return Model(names, stored(best, "mcd-best"))


def judge_quality(docs: DataFrame, lim: Limits = Limits()) -> DataFrame:
    """doc_id, statistics, base_failed, kept and distance of every row of ``docs``.

    base_failed: fewer than ``min_words`` words, or more than ``max_repeat_percent`` of
    them in repeated 3-word windows.  Only documents that pass the base rules are
    estimated and judged by distance (NULL for the others).  NULL texts count as
    empty, NULL languages and sources are groups of their own; repeated rows and equal
    ids are judged one by one; extra columns are ignored; an empty table gives an empty
    result.  A group of fewer than ``min_group`` documents joins its language's other
    small groups, and those, if still few, the rest of all languages.
    """
    stats = stored(text_stats(docs, ["doc_id", "lang", "source"]).withColumn("base_failed", _failed(lim)), "quality-stats")
    # the guard is for min_words = 0: the vectors divide by the number of words
    good = stats.filter("NOT base_failed AND n_words > 0")
    judged = fit(good, lim).distances(good)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    judged = judged.select(*columns, F.coalesce(F.col("d2") <= lim.cutoff, F.lit(True)).alias("kept"), F.round("d2", 4).alias("distance"))
    rest = stats.filter("base_failed OR n_words = 0").select(*columns, F.expr("NOT base_failed").alias("kept"), F.lit(None).cast("double").alias("distance"))
    return judged.unionByName(rest)


def keep_good(docs: DataFrame, lim: Limits = Limits()) -> DataFrame:
    """The rows of ``docs``, with all columns, that ``judge_quality`` keeps.

    Rows that pass the base rules are written once, with their statistics, and read again
    with the verdicts once the estimates are known; that costs less than to count all
    words twice or to shuffle texts.
    """
    packed = docs.select(F.struct("*").alias("_row"), "text", "lang", "source")
    passed = stored(text_stats(packed, ["_row", "lang", "source"]).filter(~_failed(lim)), "quality-rows")
    with_words = passed.filter("n_words > 0")
    kept = fit(with_words.drop("_row"), lim).distances(with_words).filter(F.coalesce(F.col("d2") <= lim.cutoff, F.lit(True))).select("_row.*")
    return kept if lim.min_words > 0 else kept.unionByName(passed.filter("n_words = 0").select("_row.*"))
