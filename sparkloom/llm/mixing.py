"""Mixing sources to target weights by iterative proportional fitting (raking).

Tokens are counted per cell of source, language and topic.  Raking scales the cells'
weights until each margin meets its target share; a document's multiplier is its
cell's raked tokens over its actual tokens.  A document is kept with probability
min(1, multiplier) (times ``rate``), by a hash of its id, and carries the weight
multiplier / probability, so that weighted token sums meet the targets in expectation
also where a cell can't be multiplied.

The cells are classes that the targets name, plus '*' for all other values of a
dimension, so their number is bounded by the targets, not by the data: they are
raked as one array in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, md5_uniform, words

DIMENSIONS = ("source", "lang", "topic")
MAX_CELLS = 20_000

Targets = dict[str, dict[str, float]]


def topic_of(text: Column) -> Column:
    """A topic by plain marks in the whole text, the first that fits."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(t.rlike("(?i)licen[sc]e|copyright"), "legal")
        .when(t.contains("@") | t.contains("://"), "contact")
        .when(t.contains(" | "), "tabular")
        .otherwise("general")
    )


def class_of(col: Column, targets: dict[str, float]) -> Column:
    """The value itself if it has a target; '*' for others and NULL."""
    return F.when(col.isin(*targets), col).otherwise(F.lit("*")) if targets else F.lit("*")


def rake(cells: Column, targets: Targets, iterations: int) -> Column:
    """Raked weights of an array of cells (source, lang, topic, n), in order.

    Shares are taken over the classes that have tokens: '*' keeps its natural share,
    the others divide the rest in proportion to their targets.  A class without tokens
    gives its share to the others.
    """

    def sum_where(w: Column, cat: Column, dim: str) -> Column:
        hit = F.zip_with(cells_var[0], w, lambda c, x: F.when(c[dim] == cat, x).otherwise(0.0))
        return F.aggregate(hit, F.lit(0.0), lambda a, x: a + x)

    cells_var: list[Column] = []

    def goal(cats: Column, natural: Column, dim: str) -> Column:
        """Target tokens of each class in ``cats``, given their natural tokens."""
        wish = F.create_map(*(F.lit(v) for kv in {**targets[dim], "*": 0.0}.items() for v in kv))
        total = F.aggregate(natural, F.lit(0.0), lambda a, x: a + x)
        other = F.aggregate(F.zip_with(cats, natural, lambda c, x: F.when(c == "*", x).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
        wished = F.aggregate(cats, F.lit(0.0), lambda a, c: a + wish[c])
        return F.zip_with(cats, natural, lambda c, x: F.when(c == "*", x).when(wished > 0, (total - other) * wish[c] / wished).otherwise(x))

    def with_goals(base: Column) -> Column:
        def step(w: Column, dim: str, cats: Column, goals: Column) -> Column:
            def scaled(sums: Column) -> Column:
                def one(c: Column, x: Column) -> Column:
                    at = F.array_position(cats, c[dim]).cast("int")
                    return F.when(F.element_at(sums, at) > 0, x * F.element_at(goals, at) / F.element_at(sums, at)).otherwise(0.0)

                return F.zip_with(cells_var[0], w, one)

            return let(F.transform(cats, lambda c: sum_where(w, c, dim)), scaled)

        def pair(dim: str) -> Column:
            cats = F.array_sort(F.array_distinct(F.transform(cells_var[0], lambda c: c[dim])))
            return let(cats, lambda cs: let(F.transform(cs, lambda c: sum_where(base, c, dim)), lambda nat: F.struct(cs.alias("cats"), goal(cs, nat, dim).alias("goals"))))

        def run(g: Column) -> Column:
            def round_(w: Column, _: Column) -> Column:
                return let(step(w, "source", g["source"]["cats"], g["source"]["goals"]), lambda w1: let(step(w1, "lang", g["lang"]["cats"], g["lang"]["goals"]), lambda w2: step(w2, "topic", g["topic"]["cats"], g["topic"]["goals"])))

            return F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), base, round_)

        return let(F.struct(*(pair(d).alias(d) for d in DIMENSIONS)), run)

    def with_cells(cs: Column) -> Column:
        cells_var.append(cs)
        return let(F.transform(cs, lambda c: c["n"].cast("double")), with_goals)

    return let(cells, with_cells)


def cell_multipliers(tokens: DataFrame, targets: Targets, iterations: int) -> DataFrame:
    """source, lang, topic (classes), multiplier: raked over actual tokens of each cell with tokens."""
    bound = 1
    for d in DIMENSIONS:
        bound *= len(targets[d]) + 1
    if bound > MAX_CELLS:
        raise ValueError(f"the targets span {bound} cells; the limit is {MAX_CELLS}")
    cells = tokens.groupBy(*DIMENSIONS).agg(F.sum("n").alias("n")).filter("n > 0")
    one = cells.agg(F.sort_array(F.collect_list(F.struct(*DIMENSIONS, "n"))).alias("cells")).filter(F.size("cells") > 0)
    raked = one.select("cells", rake(F.col("cells"), targets, iterations).alias("w"))
    return raked.select(F.inline(F.arrays_zip("cells", "w"))).select("cells.*", "w").select(*DIMENSIONS, (F.col("w") / F.col("n")).alias("multiplier"))


def mix(docs: DataFrame, targets: Targets, iterations: int = 30, rate: float = 1.0, seed: str = "mix", keep: list[str] | None = None, topic_column: str | None = None, copies: bool = False) -> DataFrame:
    """Every document with n_tokens, topic, multiplier, probability, weight and kept.

    Columns: doc_id, source, lang, those of ``keep``, then the above.  Tokens are
    words.  Documents without tokens (NULL, empty) get probability 0.  NULL sources,
    languages and topics belong to '*'.  ``topic_column`` names a column with topics, say a
    classifier's; without it ``topic_of`` finds them.  A document's draw depends on doc_id
    (on the text where that is NULL) and seed alone: repeated rows are kept or left together.  Extra columns only pass if named in
    ``keep``; an empty table gives an empty result.

    Two passes: token counts (a row per cell and task is shuffled), then a join with
    the cells, which the targets bound, so they are broadcast.
    """
    text = F.col("text")
    topic = topic_of(text) if topic_column is None else F.col(topic_column).cast("string")
    keep = [c for c in keep or [] if c not in ("doc_id", "source", "lang")]
    identity = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))
    classes = [class_of(F.col("source"), targets["source"]).alias("_s"), class_of(F.col("lang"), targets["lang"]).alias("_l")]
    counted = docs.select("doc_id", "source", "lang", *keep, *classes, topic.alias("_topic"), F.size(words(text)).cast("long").alias("_n"), md5_uniform(identity, F.lit(seed)).alias("_u"))
    topic_class = class_of(F.col("_topic"), targets["topic"])
    cells = cell_multipliers(counted.select(F.col("_s").alias("source"), F.col("_l").alias("lang"), topic_class.alias("topic"), F.col("_n").alias("n")), targets, iterations)
    cells = cells.select(F.col("source").alias("_s"), F.col("lang").alias("_l"), F.col("topic").alias("_t"), F.col("multiplier").alias("_m"))
    m = F.when(F.col("_n") > 0, F.coalesce("_m", F.lit(0.0))).otherwise(0.0)
    p = F.least(F.lit(1.0), F.col("_mult") * F.lit(rate))
    return (
        counted.withColumn("_t", topic_class).join(F.broadcast(cells), ["_s", "_l", "_t"], "left")
        .withColumn("_mult", m).withColumn("_p", p)
        .select("doc_id", "source", "lang", *keep, F.col("_topic").alias("topic"), F.col("_n").alias("n_tokens"),
                F.round("_mult", 6).alias("multiplier"), F.round("_p", 6).alias("probability"),
                F.round(F.when(F.col("_p") > 0, F.col("_mult") / F.col("_p")).otherwise(0.0), 6).alias("weight"),
                (F.col("_u") < F.col("_p")).alias("kept"), *([(F.floor(F.col("_mult") * rate) + (F.col("_u") < F.col("_mult") * rate - F.floor(F.col("_mult") * rate)).cast("long")).alias("_copies")] if copies else []))
    )


def sample(docs: DataFrame, targets: Targets, **how) -> DataFrame:
    """The rows of ``docs``, with all columns, as often as their multipliers (times ``rate``) say.

    A multiplier of 0.3 keeps a document with that probability; one of 2.3 gives it twice,
    and a third time with probability 0.3.  So the sample's own token shares meet the
    targets, as those of ``mix`` do with its weights.
    """
    packed = docs.select("doc_id", "source", "lang", "text", F.struct("*").alias("_row"), *([how["topic_column"]] if how.get("topic_column") else []))
    counted = mix(packed, targets, keep=["_row"], copies=True, **how).filter("_copies > 0")
    return counted.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_row.*")
