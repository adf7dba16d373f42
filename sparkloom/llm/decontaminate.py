"""Benchmark decontamination over a distributed positional inverted index.

The index stores a posting (term, uid, pos) for every occurrence, in the training
texts, of a term that some test item uses; terms that no item uses can't take part in
a match.  Postings are written where the texts are read, without a shuffle.

A phrase query works from the rarest terms: for each window of an item the two terms
with the fewest postings are its anchors.  Their posting lists, shifted by the anchor's
place in the item, are intersected: an alignment (document, item, shift) survives where
both anchors of some window are there.  Consecutive windows share anchors, so an alignment
stands for all of them.  Only anchors' postings are shuffled.  Documents with survivors
give out the words about the anchors that have met, and those are compared with the item's,
so the work follows what matches and not the item's length.

A proximity query asks for all words of a window within a few words more than the window
has, in any order.  Postings of anchors are grouped by half-overlapping cells of positions;
where a window's two anchors are close enough, the words about the rarer one are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import RAW_TERM, TERM, let, light, lower_ascii, numbered, stored, words


def terms(text: Column) -> Column:
    return words(lower_ascii(text), TERM)


def _intervals(part: Column, item: Column, shift: Column, width: Column) -> Column:
    """(s, e) in document positions of each window of ``item`` that occurs at ``shift``; ``part``: the document's words from ``shift``, or 0, on.

    Found between the places that differ, so the work follows the item's words.
    """
    skipped = F.greatest(-shift, F.lit(0))
    differs = F.filter(F.sequence(F.lit(0), F.size(item) - 1), lambda j: (j < skipped) | ~F.coalesce(F.get(part, j - skipped) == F.get(item, j), F.lit(False)))

    def runs(ends: Column) -> Column:
        between = F.transform(F.sequence(F.lit(1), F.size(ends) - 1), lambda i: F.struct((F.get(ends, i - 1) + 1).alias("a"), F.get(ends, i).alias("b")))
        return F.filter(between, lambda x: x["b"] - x["a"] >= width)

    found = let(F.concat(F.array(F.lit(-1)), differs, F.array(F.size(item))), runs)
    return F.flatten(F.transform(found, lambda x: F.transform(F.sequence(x["a"], x["b"] - width), lambda k: F.struct((shift + k).alias("s"), (shift + k + width).alias("e")))))


def _near(qs: Column, width: Column) -> Column:
    """Codes (see ``_code``) of the pairs of places in ``qs`` less than ``width`` apart; the work follows the length of qs."""
    around = F.sequence(1 - width, width - 1)

    def codes(swapped: bool) -> Column:
        return F.flatten(F.transform(qs, lambda q: F.transform(around, lambda d: _code(q + d, q) if swapped else _code(q, q + d))))

    return F.array_intersect(codes(False), codes(True))


def _segments(places: Column, width: Column, n: Column) -> Column:
    """(lo, hi), apart from each other, in an item of ``n`` words: every window of ``width`` that holds one of ``places``."""

    def merged(q: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(q) - 1), lambda i: (i == 0) | (F.get(q, i) - F.get(q, i - 1) >= 2 * width))

        def cut(at: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.size(at) - 1), lambda k: F.struct(
                F.greatest(F.get(q, F.get(at, k)) - width + 1, F.lit(0)).alias("lo"),
                F.least(F.get(q, F.coalesce(F.get(at, k + 1), F.size(q)) - 1) + width, n).alias("hi")))

        return let(begins, cut)

    return let(F.array_sort(places), merged)


def _code(q1: Column, q2: Column) -> Column:
    return q1.cast("long") * F.lit(1 << 32) + q2


def covered(intervals: Column) -> Column:
    """Positions in the union of intervals (s, e)."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        F.sort_array(intervals), zero,
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["end"]))).alias("n"), F.greatest(a["end"], x["e"]).alias("end")),
        lambda a: a["n"],
    )


class PositionalIndex:
    """Postings of ``docs`` (doc_id, text) for the vocabulary of ``items`` (item_id, text).

    NULL texts have no words.  Equal or NULL doc_ids: see ``numbered``.  Equal or NULL
    item_ids: each row is an item; results name ids once.  Extra columns are ignored.
    """

    def __init__(self, docs: DataFrame, items: DataFrame):
        self.docs = numbered(docs)
        item = items.select("item_id", terms(F.col("text")).alias("iw")).distinct().filter(F.size("iw") > 0)
        self.items = stored(item.withColumn("ik", F.monotonically_increasing_id()), "items")
        vocabulary = stored(self.items.select(F.explode("iw").alias("term")).distinct(), "vocabulary")
        # one pass over the texts: postings, and with each document's first word its own row
        read = self.docs.select("doc_id", "uid", F.md5("text").alias("digest"), words(F.col("text"), RAW_TERM).alias("raws"))
        read = read.select("doc_id", "uid", "digest", F.size("raws").cast("long").alias("n_words"), "raws")
        tokens = read.select("doc_id", "uid", "digest", "n_words", F.posexplode_outer("raws").alias("pos", "raw"))
        begins = F.coalesce(F.col("pos"), F.lit(0)) == 0
        own = [F.when(begins, F.col(c)).alias(c) for c in ("doc_id", "digest", "n_words")]
        tokens = tokens.select(lower_ascii(F.col("raw")).alias("term"), "uid", "pos", begins.alias("begins"), *own)
        tokens = tokens.join(light(vocabulary.withColumn("known", F.lit(True))), "term", "left").filter("known OR begins")
        written = stored(tokens, "postings")
        self.postings = written.filter("known").select("term", "uid", "pos")
        #: doc_id, uid, digest (md5 of the text), n_words of every row
        self.rows = written.filter("begins").select("doc_id", "uid", "digest", "n_words")

    def _framed(self, width: int) -> tuple[DataFrame, DataFrame]:
        """The items with their windows' width; and ik, q (place in the item), q1, q2 (places of the rarest terms) of each possible window.

        An item of fewer words is one window.  Windows with a term that never occurs are
        left out.
        """
        freq = self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("f"))
        sized = self.items.withColumn("width", F.least(F.lit(width), F.size("iw")))
        placed = sized.select("ik", "width", F.posexplode("iw").alias("q", "term")).join(freq, "term", "left")
        ahead = Window.partitionBy("ik").orderBy("q").rowsBetween(0, width - 1)
        framed = placed.select("ik", "q", "width", F.count(F.lit(1)).over(ahead).alias("n"), F.count("f").over(ahead).alias("known"), F.sort_array(F.collect_list(F.struct("f", "q")).over(ahead)).alias("r"))
        framed = framed.filter("n = width AND known = width")
        q1 = F.get("r", F.lit(0))["q"]
        return sized, stored(framed.select("ik", "q", q1.alias("q1"), F.coalesce(F.get("r", F.lit(1))["q"], q1).alias("q2")), "frames")

    def _hits(self, wins: DataFrame) -> DataFrame:
        """ik, uid, q, shift of every posting of every anchor."""
        anchor = wins.select("ik", "iw", F.explode(F.array_distinct(F.flatten(F.transform("w", lambda x: F.array(x["q1"], x["q2"]))))).alias("q"))
        anchor = stored(anchor.select("ik", "q", F.get("iw", F.col("q")).alias("term")), "anchors")
        return self.postings.join(light(anchor), "term").select("ik", "uid", "q", (F.col("pos") - F.col("q")).alias("shift"))

    def _aligned(self, wins: DataFrame) -> DataFrame:
        """uid, ik, lo, hi, shift: what of an item is to be compared with the words from position ``shift`` + lo on."""
        hits = self._hits(wins).groupBy("uid", "ik", "shift").agg(F.collect_set("q").alias("qs"))
        sizes = light(wins.select("ik", "width", F.size("iw").alias("n")))
        pairs = light(wins.select("ik", F.explode("w").alias("w")).select("ik", _code(F.col("w.q1"), F.col("w.q2")).alias("code"), F.col("w.q1").alias("q1")))
        # most alignments are single words that meet by chance
        several = hits.join(sizes, "ik").filter(F.size("qs") >= F.least(F.lit(2), F.col("width")))
        met = several.select("uid", "ik", "shift", "width", "n", F.explode(_near(F.col("qs"), F.col("width"))).alias("code")).join(pairs, ["ik", "code"])
        held = met.groupBy("uid", "ik", "shift", "width", "n").agg(F.collect_set("q1").alias("places"))
        # of an item only what lies about the places that have met is compared
        return held.select("uid", "ik", "shift", F.inline(_segments(F.col("places"), F.col("width"), F.col("n"))))

    def _close(self, loose: DataFrame, most: int) -> DataFrame:
        """uid, wid, at: postings of the rarest term of a window of ``loose`` with one of its second rarest close by.

        Spans have ``most`` words at most, so both lie in one of two cells of twice that length.
        """
        ids = stored(loose.select(F.explode(F.array("t1", "t2")).alias("term")).distinct().withColumn("tid", F.monotonically_increasing_id()), "anchors")
        pairs = loose.select("wid", "span", "t1", "t2")
        for t in ("1", "2"):
            pairs = pairs.join(ids.select(F.col("term").alias(f"t{t}"), F.col("tid").alias(f"a{t}")), f"t{t}")
        pairs = light(stored(pairs.select("wid", "span", "a1", "a2"), "pairs"))
        cell = F.floor(F.col("pos") / F.lit(most))
        spread = self.postings.join(light(ids), "term").select("uid", F.explode(F.array(cell - 1, cell)).alias("cell"), F.struct("pos", "tid").alias("p"))
        cells = spread.groupBy("uid", "cell").agg(F.collect_set("p").alias("ps"))

        def about(x: Column) -> Column:
            close = F.filter(F.col("ps"), lambda y: F.abs(x["pos"] - y["pos"]) < most)
            return F.transform(close, lambda y: F.struct(x["tid"].alias("a1"), y["tid"].alias("a2"), x["pos"].alias("at"), F.abs(x["pos"] - y["pos"]).alias("gap")))

        meets = cells.select("uid", F.inline(F.flatten(F.transform("ps", about))))
        return meets.join(pairs, ["a1", "a2"]).filter("gap < span").select("uid", "wid", "at").distinct()

    def matches(self, width: int = 10, slop: int | None = None) -> DataFrame:
        """doc_id, digest (md5 of the text), n_words, n_hit, matches, near of every document.

        matches (array of item_id, s, e) has each occurrence of a window of ``width`` words of
        an item (of the whole item if it is shorter) as word positions [s, e), in no order;
        n_hit counts the words in any.

        near (array of item_id, q, s) has each proximity match, likewise: the window from word
        q of the item on has all its words, in any order and repeats once, among the document's
        words from s on, in ``slop`` words more than the window has, and word s is one of
        them.  Phrases are proximity matches, too.  Without ``slop`` it is empty.
        """
        sized, framed = self._framed(width)
        anchors = framed.groupBy("ik").agg(F.collect_set(F.struct("q1", "q2")).alias("w"))
        wins = stored(sized.join(anchors, "ik").select("ik", "item_id", "iw", "width", "w"), "windows")
        wanted = self._aligned(wins).select("uid", F.lit(False).alias("loose"), "ik", "lo", "hi", (F.col("shift") + F.col("lo")).alias("shift"))
        if slop is not None:
            most = width + slop
            loose = sized.join(framed, "ik").select(
                "item_id", "q", (F.col("width") + slop).alias("span"), F.array_distinct(F.slice("iw", F.col("q") + 1, F.col("width"))).alias("own"),
                F.get("iw", F.col("q1")).alias("t1"), F.get("iw", F.col("q2")).alias("t2"), F.monotonically_increasing_id().alias("wid"))
            loose = stored(loose, "loose-windows")
            close = self._close(loose, most)
            wanted = wanted.unionByName(close.select("uid", F.lit(True).alias("loose"), F.col("wid").alias("ik"), F.lit(0).alias("lo"), F.lit(2 * most - 1).alias("hi"), (F.col("at") - most + 1).alias("shift")))
        per_doc = stored(wanted.groupBy("uid").agg(F.collect_list(F.struct("loose", "ik", "lo", "hi", "shift")).alias("aligned")), "alignments")

        def cut(dw: Column) -> Column:
            return F.transform(F.col("aligned"), lambda a: F.struct(
                a["loose"].alias("loose"), a["ik"].alias("ik"), a["lo"].alias("lo"), a["hi"].alias("hi"), a["shift"].alias("shift"),
                F.slice(dw, F.greatest(a["shift"], F.lit(0)) + 1, F.greatest(a["hi"] - a["lo"] + F.least(a["shift"], F.lit(0)), F.lit(0))).alias("part")))

        # survivors grow with the corpus, so they are never broadcast: one plan at every size
        parts = self.docs.join(per_doc.hint("merge"), "uid").select("uid", F.inline(let(terms(F.col("text")), cut)))
        if slop is not None:
            parts = stored(parts, "parts")  # read twice
        exact = parts.filter("NOT loose").join(light(wins.select("ik", "item_id", "iw", "width")), "ik").withColumn("own", F.slice("iw", F.col("lo") + 1, F.col("hi") - F.col("lo")))
        exact = exact.select("uid", "item_id", F.inline(_intervals(F.col("part"), F.col("own"), F.col("shift"), F.col("width"))))
        found = exact.select("uid", F.struct("item_id", "s", "e").alias("m"), F.lit(None).cast(f"struct<item_id:{exact.schema['item_id'].dataType.simpleString()},q:int,s:int>").alias("l"))
        if slop is not None:
            near = parts.filter("loose").withColumnRenamed("ik", "wid").join(light(loose.select("wid", "item_id", "q", "span", "own")), "wid")
            begin, at = F.greatest(F.col("shift"), F.lit(0)), F.col("shift") + most - 1
            whole = lambda i: F.array_contains("own", F.get("part", i)) & (F.size(F.array_except("own", F.slice("part", i + 1, F.col("span")))) == 0)
            starts = F.filter(F.sequence(F.greatest(at - F.col("span") + 1, F.lit(0)) - begin, at - begin), whole)
            near = near.select("uid", "item_id", "q", (F.explode(starts)).alias("i"), begin.alias("begin"))
            found = found.unionByName(near.select("uid", F.lit(None).cast(found.schema["m"].dataType).alias("m"), F.struct("item_id", "q", (F.col("begin") + F.col("i")).alias("s")).alias("l")))
        found = stored(found.groupBy("uid").agg(F.collect_set("m").alias("matches"), F.collect_set("l").alias("near")), "matches")
        found = self.rows.join(found.hint("merge"), "uid", "left")
        lists = {c: F.coalesce(c, F.array().cast(found.schema[c].dataType)) for c in ("matches", "near")}
        places = F.transform(lists["matches"], lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e")))
        return found.select("doc_id", "digest", "n_words", covered(places).alias("n_hit"), lists["matches"].alias("matches"), lists["near"].alias("near"))


def _ids(matches: str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(matches, lambda m: F.coalesce(m["item_id"].cast("string"), F.lit("null")))))


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, slop: int | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted distinct strings), contaminated, near_ids, n_near of every document.

    near_ids and n_near are the items and the number of the proximity matches (see
    ``PositionalIndex.matches``); they don't make a document contaminated.  An empty
    ``items`` contaminates nothing; an empty ``docs`` gives an empty result.
    """
    found = PositionalIndex(docs, items).matches(width, slop)
    return found.select("doc_id", "n_words", "n_hit", _ids("matches").alias("item_ids"), (F.col("n_hit") > 0).alias("contaminated"), _ids("near").alias("near_ids"), F.size("near").cast("long").alias("n_near"))


def keep_clean(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """The rows of ``docs``, with all columns, that hold no phrase of any item."""
    found = PositionalIndex(docs, items).matches(width).filter("n_hit > 0")
    dirty = stored(found.select(F.col("doc_id").alias("_i"), F.col("digest").alias("_d")).distinct(), "dirty")
    packed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.md5(F.coalesce("text", F.lit(""))).alias("_digest"))
    return packed.join(dirty, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_digest") == F.col("_d")), "left_anti").select("_row.*")
