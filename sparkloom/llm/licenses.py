"""Licence scan: Dice coefficient over word bigrams against licence templates.

Units of comparison are the lines of a text, its paragraphs of two lines or more, runs
of neighbouring sentences, over line ends too, and a text of several paragraphs as a
whole.  A unit's distinct bigrams are compared with a template's; a template is looked at
only if its size allows the threshold: with a and b bigrams, Dice is at most
2 min(a, b) / (a + b), so b must lie in [a t / (2 - t), a (2 - t) / t].
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, lower_ascii

#: Ends of sentences and of paragraphs.
SENTENCE_END = r"[.!?;:][\x20\t\r\n]+|\n[\x20\t\r]*\n"
PARAGRAPH_END = r"\n[\x20\t\r]*\n"

#: Short notices and standard headers of public licences.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("proprietary", "All rights reserved."),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("Apache-2.0", "Apache License, Version 2.0, January 2004"),
    ("GPL-2.0", "GNU General Public License, Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License, Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU Lesser General Public License, Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License, Version 3, 19 November 2007"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("MPL-2.0", "Mozilla Public License, Version 2.0"),
]


def normal_words(col: Column) -> Column:
    """A-Z lower-cased, all but a-z and 0-9 taken as space."""
    return F.split(F.trim(F.regexp_replace(lower_ascii(col), "[^a-z0-9]+", " ")), " ")


def bigrams(w: Column) -> Column:
    """Distinct pairs of neighbouring words; none for fewer than two words."""
    pairs = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1)))
    return F.array_distinct(pairs)


def template_bigrams(text: str) -> list[str]:
    w = "".join(c if c.isascii() and c.isalnum() else " " for c in text).lower().split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))


def telling_words(gram: list[str], threshold: float, sets: int = 3) -> list[list[str]]:
    """Disjoint word sets; a text that reaches the threshold with the template holds a word of each.

    A match shares at least t / (2 - t) of the template's bigrams, so words that are part
    of more than the rest can't all be missing.  Words are taken longest first; numbers, rare in
    prose, count as four letters.
    """
    pairs, need = [set(x.split(" ")) for x in gram], len(gram) * threshold / (2 - threshold) - 1e-9
    left, found = sorted(set().union(*pairs), key=lambda w: (-max(len(w), 4 * w.isdigit()), w)), []
    while len(found) < sets:
        taken = next((left[:k] for k in range(1, len(left) + 1) if sum(not p.intersection(left[:k]) for p in pairs) < need), None)
        if taken is None:
            break
        found.append(taken)
        left = left[len(taken) :]
    return found


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = 0.8, run: int = 3) -> DataFrame:
    """doc_id, unit, unit_no, unit_size, license, template_no, dice: the best template of each matching unit.

    unit is 'line', 'paragraph' (of two lines or more), 'sentences' (a run of unit_size
    neighbouring sentences, 1 to ``run``, the first of them unit_no) or 'text' (a whole
    text of several paragraphs).  Units overlap, and each that matches is reported.

    Whole texts are read.  NULL or empty texts have no units; ties go to the template
    that comes first; repeated rows are reported for each row.  Extra columns are
    ignored; an empty table gives an empty result.  The work is one pass without a
    shuffle, and the templates (a list in the plan) are its only other input.  Texts and
    units that lack the telling words of every template can't match and go first.
    Templates of fewer than two words match nothing; without any other there is an error.
    """
    grams = [(i, k, template_bigrams(t)) for i, (k, t) in enumerate(TEMPLATES if templates is None else templates)]
    grams = [g for g in grams if g[2]]
    if not grams:
        raise ValueError("no template of two words or more")
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    sizes = sorted({len(g[2]) for g in grams})
    telling = [telling_words(g[2], threshold) for g in grams]
    first = sorted({w for sets in telling for w in sets[0]})
    first = [w for w in first if not any(v in w for v in first if v != w)]  # a word is held by all that contain it
    text = F.coalesce(F.col("text"), F.lit(""))

    def any_of(col: Column, taken: list[str]) -> Column:
        return reduce(or_, (col.contains(w) for w in taken), F.lit(False))

    def may_match(col: Column) -> Column:
        return reduce(or_, (reduce(and_, (any_of(col, taken) for taken in sets)) for sets in telling), F.lit(False))

    def unit(kind: str, i: Column, size: int, s: Column) -> Column:
        return F.struct(F.lit(kind).alias("unit"), i.cast("long").alias("unit_no"), F.lit(size).cast("long").alias("unit_size"), s.alias("s"))

    def runs(p: Column) -> Column:
        def of(r: int) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (i <= F.size(p) - r) & F.exists(F.slice(p, i + 1, r), lambda x: x["told"]))
            return F.transform(starts, lambda i: unit("sentences", i, r, F.array_join(F.slice(p, i + 1, r)["x"], " ")))

        return F.concat(*map(of, range(1, run + 1)))

    def units_of(t: Column) -> Column:
        lines = F.filter(F.transform(F.split(t, "\n"), lambda x, i: unit("line", i, 1, x)), lambda u: any_of(u["s"], first))
        blocks = F.transform(F.split(t, PARAGRAPH_END), lambda x, i: unit("paragraph", i, 1, x))
        blocks = F.filter(blocks, lambda u: F.contains(F.trim(u["s"]), F.lit("\n")) & any_of(u["s"], first))
        whole = F.filter(F.array(unit("text", F.lit(0), 1, t)), lambda u: u["s"].rlike(PARAGRAPH_END))
        pieces = F.transform(F.split(t, SENTENCE_END), lambda x: F.struct(x.alias("x"), any_of(x, first).alias("told")))
        return F.concat(lines, blocks, whole, let(pieces, runs))

    # lower-cased once; a text that can't match has no units
    units = let(lower_ascii(text), lambda t: F.when(any_of(t, first) & may_match(t), units_of(t)))
    units = docs.select("doc_id", F.inline(units)).filter(let(F.col("s"), may_match))
    # a text of n characters has at most n / 2 bigrams, so short lines go before they are split
    units = units.filter(F.length("s") >= 2 * low * sizes[0]).withColumn("w", normal_words(F.col("s")))
    # distinct bigrams only get fewer, so a lower bound on words is exact; the upper bound holds after array_distinct
    units = units.filter(F.size("w") - 1 >= F.lit(low * sizes[0])).select("doc_id", "unit", "unit_no", "unit_size", let(F.col("w"), bigrams).alias("b"))
    n = F.size("b")
    units = units.filter(n.between(low * sizes[0] - 1e-9, high * sizes[-1] + 1e-9))
    scores = []
    for i, k, g in grams:
        common = F.size(F.array_intersect("b", F.array(*map(F.lit, g))))
        dice = F.when(n.between(low * len(g) - 1e-9, high * len(g) + 1e-9), F.lit(2.0) * common / (n + len(g))).otherwise(0.0)
        scores.append(F.struct(dice.alias("dice"), F.lit(-i).alias("o"), F.lit(k).alias("license")))
    best = F.array_max(F.array(*scores))
    return (
        units.select("doc_id", "unit", "unit_no", "unit_size", best.alias("m")).filter(F.col("m.dice") >= threshold)
        .select("doc_id", "unit", "unit_no", "unit_size", "m.license", (-F.col("m.o")).cast("long").alias("template_no"), F.round("m.dice", 6).alias("dice"))
    )

