"""PageRank with dangling mass and frozen ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.program import RunConfig, Step, VertexProgram
from ..operators.superstep import Run

#: Fixed values of the algorithm.
DAMPING = 0.85
EPSILON = 1e-9

#: Steps of the two integers that ``exact_sum`` adds up: 2^-52, and 2^-30 of that.
COARSE, FINE = float(1 << 52), float(1 << 30)


def exact_sum(x: Column) -> Column:
    """Sum of numbers from 0 up that total less than 2^11, the same in any order.

    Each number becomes two integers, cut off below 2^-82; integers add up exactly, so
    neither partitions nor retries change a bit.  NULL for no numbers.
    """
    coarse = F.floor(x * COARSE)
    return F.sum(coarse).cast("double") / COARSE + F.sum(F.floor((x * COARSE - coarse) * FINE)).cast("double") / (COARSE * FINE)


class PageRank(VertexProgram):
    """Two ranks per vertex: ``rank`` only follows changes above EPSILON; ``emit_rank`` always, and is what is sent.

    A vertex without arcs gives its rank to all vertices alike: that is one number per
    step, taken with the step's counts, not n messages.  Every vertex is active in every
    step (in message terms, each sends an empty one to all, which is only counted).
    """

    name, kind = "PageRank", "rankings"
    state = ("rank",)
    payload = ("rank",)
    always_active = True

    def init(self, cfg: RunConfig, step: Step) -> dict[str, Column]:
        return {"rank": F.lit(1.0 / step.n), "emit_rank": F.lit(1.0 / step.n)}

    def message(self, step: Step) -> dict[str, Column]:
        return {"rank": F.col("emit_rank") / F.col("degree")}

    def gather(self, outbox: DataFrame, states: DataFrame) -> DataFrame:
        return outbox.groupBy("dst").agg(exact_sum(F.col("rank")).alias("received"))

    def update(self, step: Step) -> dict[str, Column]:
        loose = (step.totals["dangling_rank"] or 0.0) / step.n
        new = F.lit((1 - DAMPING) / step.n) + F.lit(DAMPING) * (F.coalesce("received", F.lit(0.0)) + F.lit(loose))
        return {"rank": F.when(F.abs(new - F.col("rank")) <= EPSILON, F.col("rank")).otherwise(new), "emit_rank": new}

    def emits(self) -> Column:
        return F.lit(True)

    def totals(self) -> dict[str, Column]:
        loose = F.col("degree") == 0
        return {"dangling_rank": exact_sum(F.when(loose, F.col("emit_rank"))), "dangling": F.count(F.when(loose, 1))}

    def messages_sent(self, step: Step, along_arcs: int) -> int:
        return step.n * step.n + along_arcs + step.n * step.totals["dangling"]

    def max_steps(self, n: int) -> int:
        return max(50, n * n)

    def observed(self) -> tuple[str, str]:
        return "rank", "rank"

    def extra_messages(self, states: DataFrame, step: Step) -> DataFrame:
        """Shares of vertices without arcs, and the empty messages: n per vertex, for traces of small graphs."""
        everyone = states.sparkSession.range(step.n).select(F.col("id").alias("dst"))
        shares = F.when(F.col("degree") == 0, F.array(F.struct((F.col("emit_rank") / step.n).alias("rank"), F.lit(0).alias("seq")))).otherwise(F.array().cast("array<struct<rank:double,seq:int>>"))
        both = states.select(F.col("id").alias("src"), F.inline(F.concat(shares, F.array(F.struct(F.lit(0.0).alias("rank"), F.lit(1).alias("seq"))))))
        return both.join(everyone).select("src", "dst", "rank", "seq")


def rankings(run: Run) -> DataFrame:
    """id, rank of every vertex."""
    return run.states.select("id", "rank")
