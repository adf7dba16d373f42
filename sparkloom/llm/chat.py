"""Chat formatting: collapse cumulative snapshots, then render.

Chat logs often hold the same dialogue many times, each time one turn longer.  A
rolling SHA-256 over (role, text) gives every conversation the identities of all its
prefixes; a conversation whose full identity is a proper prefix of another one is
dropped by an anti-join, and the maximal ones are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored

START, END = "<|im_start|>", "<|im_end|>"


def _turn_key(role: Column, text: Column) -> Column:
    """Unambiguous: lengths go before the values, and NULL differs from ''."""

    def part(c: Column) -> Column:
        return F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    return F.concat(part(role), F.lit("|"), part(text))


def _safe(c: Column) -> Column:
    """A text can't forge a marker: '<|' gets a space."""
    return F.replace(c, F.lit("<|"), F.lit("< |"))


#: Turns whose hashes are chained in one step; the chain's cost grows with turns times this, not with their square.
STEP = 256


def _chain(turns: Column) -> Column:
    """Rolling SHA-256 of an array of turns: the identity of every prefix, in order."""

    def one(acc: Column, x: Column) -> Column:
        link = F.sha2(F.concat(F.coalesce(F.get(acc["own"], F.size(acc["own"]) - 1), acc["last"]), _turn_key(x["role"], x["text"])), 256)
        return F.struct(acc["last"].alias("last"), F.concat(acc["own"], F.array(link)).alias("own"))

    none = F.array().cast("array<string>")

    def block(acc: Column, i: Column) -> Column:
        begin = F.struct(acc["last"].alias("last"), none.alias("own"))
        own = F.aggregate(F.slice(turns, i * STEP + 1, F.lit(STEP)), begin, one, lambda x: x["own"])
        return let(own, lambda o: F.struct(F.element_at(o, -1).alias("last"), F.concat(acc["blocks"], F.array(o)).alias("blocks")))

    start = F.struct(F.lit("").alias("last"), F.array().cast("array<array<string>>").alias("blocks"))
    blocks = F.sequence(F.lit(0), F.floor((F.size(turns) - 1) / STEP).cast("int"))
    return F.aggregate(blocks, start, block, lambda x: F.flatten(x["blocks"]))


def collapse_snapshots(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, turns (array of role and text) of maximal conversations.

    Turns are ordered by (turn, role, text), NULLs first, so ties and repeated rows have
    a fixed place and count as turns.  Conversations with equal turns collapse to the
    smallest conv_id; n_copies counts them.  A turn with a NULL conv_id belongs to no other
    and is a conversation by itself.  Extra columns are ignored; an empty table gives an
    empty result.

    A conversation is one row from the first step on.  Prefix identities are made
    distinct before the shuffle, so an opening that a third of all logs share is one
    row per task, and copies meet as hashes; turns are joined by a key of their own.
    """
    turns = conversations.select("conv_id", "turn", "role", "text")
    one = F.struct("turn", "role", "text")
    convs = turns.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t"))
    convs = convs.unionByName(turns.filter("conv_id IS NULL").select("conv_id", F.array(one).alias("t")))
    convs = convs.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    # stored, so the key stays as it is
    convs = stored(convs.select("conv_id", F.monotonically_increasing_id().alias("key"), "turns", let(F.col("turns"), _chain).alias("chain")), "conversations")
    whole = F.element_at("chain", -1)
    first = F.struct(F.col("conv_id").isNull().alias("n"), "conv_id", "key")
    unique = convs.select("conv_id", "key", whole.alias("whole")).groupBy("whole").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n_copies"))
    prefixes = convs.select(F.explode(F.slice("chain", F.lit(1), F.size("chain") - 1)).alias("whole")).distinct()
    maximal = unique.join(prefixes, "whole", "left_anti").select(F.col("first.key").alias("key"), "n_copies")
    return convs.join(maximal, "key").select("conv_id", F.size("turns").cast("long").alias("n_turns"), "n_copies", "turns")


def render(turns: Column) -> Column:
    """One string: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn; NULL role: unknown; line ends in a role become spaces."""
    return F.array_join(
        F.transform(turns, lambda x: F.concat(F.lit(START), _safe(F.translate(F.coalesce(x["role"], F.lit("unknown")), "\r\n", "  ")), F.lit("\n"), _safe(F.coalesce(x["text"], F.lit(""))), F.lit(END), F.lit("\n"))),
        "",
    )


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, text of every maximal conversation."""
    return collapse_snapshots(conversations).select("conv_id", "n_turns", "n_copies", render(F.col("turns")).alias("text"))
