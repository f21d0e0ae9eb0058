"""Licence scans by Dice coefficient over word bigrams, in DataFrame functions only.

A text and the templates are normalised (lower case, letters and digits only), cut into distinct bigrams and compared as sets:
2 * shared / (bigrams of both). A text is cut into pieces at line ends and after sentences. Compared are the whole text and
every window of consecutive pieces, so notices that are wrapped or span sentences are found. Of the windows of one template that
overlap, the best is reported (of equals the shortest, then the first); a window is reported with its best template.

No window is lost by what is skipped: a coefficient of t needs t / (2 - t) * a shared bigrams of a template of a, and at most
a * (2 - t) / t distinct bigrams in the window; a first or last piece that adds no shared bigram only lowers the coefficient.

Defined cases: null and blank texts match nothing; ties go to the template first by name; units without a bigram match nothing;
equal rows give equal results; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, let
from .license_texts import TEXTS

LEAST = 0.75
#: Short notices of our own wording; the query compares with these and with the licence texts and headers of TEXTS.
TEMPLATES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "copyright-line": "Copyright (c) All rights reserved.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.", "mit": "Released under the MIT License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.", "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "spdx-mit": "SPDX-License-Identifier: MIT", "spdx-apache": "SPDX-License-Identifier: Apache-2.0",
}


def normalised(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def _grams(text: str) -> list[str]:
    import regex

    w = regex.sub(r"[^\p{L}\p{N}]+", " ", text.lower()).split(" ")
    w = [x for x in w if x]
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def matches(text: Column, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> Column:
    """array<struct<license, dice, line, last>> of one text: line 0 is the whole text with its best template, others are windows from piece `line` to `last`."""
    grams = {k: g for k, v in sorted(templates.items()) if (g := _grams(v))}
    known = sorted({x for g in grams.values() for x in g})
    need = {k: math.ceil(len(g) * least / (2 - least) - 1e-9) for k, g in grams.items()}
    most = {k: math.floor(len(g) * (2 - least) / least + 1e-9) for k, g in grams.items()}
    all_ = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(len(g)).alias("m"), F.lit(need[k]).alias("need"), F.lit(most[k]).alias("most"), F.split(F.lit("|".join(g)), r"\|").alias("g")) for k, g in grams.items()])
    nothing = F.array().cast("array<struct<license:string,dice:double,line:int,last:int>>")

    def dice(s: Column, n: Column, m: Column) -> Column:
        return -(2 * s) / (n + m)

    def windows(t: Column, g: Column, piece: Column, before: Column, hits: Column) -> Column:
        """The windows of one template, of which those that overlap a better one are left out."""
        own = F.filter(hits, lambda i: F.array_contains(t["g"], F.get(g, i)))

        def from_start(p: Column, own: Column) -> Column:
            start = (F.array_position(piece, p) - 1).cast("int")
            # Places of the first distinct bigrams from the start on: a window with more than `most` can't match.
            fresh = let(start, lambda a: F.slice(F.filter(F.sequence(a, F.size(g) - 1), lambda i: F.get(before, i) < a), F.lit(1), t["most"] + 1))

            def ends(fresh: Column) -> Column:
                shared = F.array_intersect(fresh, own)

                def at(q: Column, shared: Column) -> Column:
                    n = F.size(F.filter(fresh, lambda i: F.get(piece, i + 1) <= q))
                    s = F.size(F.filter(shared, lambda i: F.get(piece, i + 1) <= q))
                    return F.struct(dice(s, n, t["m"]).alias("d"), (q - p).alias("span"), p.alias("p"), q.alias("q"), t["k"].alias("k"))

                return let(shared, lambda x: F.when(F.size(x) >= t["need"], F.filter(F.transform(F.array_distinct(F.transform(x, lambda i: F.get(piece, i + 1))), lambda q: at(q, x)), lambda w: w["d"] <= -least)))

            return F.coalesce(let(fresh, ends), empty)

        def best(found: Column) -> Column:
            return F.aggregate(F.array_sort(found), empty, lambda chosen, w: F.when(F.exists(chosen, lambda c: (c["p"] <= w["q"]) & (w["p"] <= c["q"])), chosen).otherwise(F.concat(chosen, F.array(w))))

        empty = F.array().cast("array<struct<d:double,span:int,p:int,q:int,k:string>>")
        found = let(own, lambda o: F.flatten(F.transform(F.array_distinct(F.transform(o, lambda i: F.get(piece, i))), lambda p: from_start(p, o))))
        return let(found, best)

    def found(words: Column, g: Column, hits: Column) -> Column:
        piece = F.flatten(F.transform(words, lambda w, i: F.array_repeat(i, F.size(w))))
        # For each bigram the place of the one before that equals it, or -1.
        ranked = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        before = let(ranked, lambda r: F.transform(F.array_sort(F.transform(r, lambda x, j: F.struct(x["i"].alias("i"), F.when(F.get(r, j - 1)["g"] == x["g"], F.get(r, j - 1)["i"]).otherwise(F.lit(-1)).alias("b")))), lambda x: x["b"]))

        def of(have: Column) -> Column:
            near = F.filter(all_, lambda t: F.size(F.array_intersect(have, t["g"])) >= t["need"])
            n = F.size(F.array_distinct(g))

            def both(near: Column) -> Column:
                whole = let(n, lambda n: F.array_min(F.transform(near, lambda t: F.struct(dice(F.size(F.array_intersect(have, t["g"])), n, t["m"]).alias("d"), t["k"].alias("k")))))
                first = let(whole, lambda w: F.when(w["d"] <= -least, F.array(F.struct(w["k"].alias("license"), (-w["d"]).alias("dice"), F.lit(0).alias("line"), F.lit(0).alias("last")))).otherwise(nothing))
                seen = let(piece, lambda p: let(before, lambda b: F.flatten(F.transform(near, lambda t: windows(t, g, p, b, hits)))))
                alone = let(seen, lambda s: F.filter(s, lambda w: ~F.exists(s, lambda o: (o["p"] == w["p"]) & (o["q"] == w["q"]) & ((o["d"] < w["d"]) | ((o["d"] == w["d"]) & (o["k"] < w["k"]))))))
                placed = F.array_sort(F.transform(alone, lambda w: F.struct((w["p"] + 1).alias("line"), (w["q"] + 1).alias("last"), w["k"].alias("license"), (-w["d"]).alias("dice"))))
                return F.concat(first, F.transform(placed, lambda w: F.struct(w["license"], w["dice"], w["line"], w["last"])))

            return let(near, lambda x: F.when(F.size(x) > 0, both(x)).otherwise(nothing))

        return let(F.array_distinct(F.transform(hits, lambda i: F.get(g, i))), lambda have: F.when(F.size(have) >= min(need.values()), of(have)).otherwise(nothing))

    def cut_into(words: Column, flat: Column) -> Column:
        g = F.transform(F.sequence(F.lit(0), F.size(flat) - 2), lambda i: F.concat_ws(" ", F.get(flat, i), F.get(flat, i + 1)))
        return F.when(F.size(flat) >= 2, let(g, lambda g: let(F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: F.get(g, i).isin(known)), lambda hits: F.when(F.size(hits) >= min(need.values()), found(words, g, hits)).otherwise(nothing)))).otherwise(nothing)

    pieces = F.transform(F.split(text, r"\n|(?<=[.!?])[ \t]+(?=\p{Lu})"), normalised)
    return let(pieces, lambda words: let(F.flatten(words), lambda flat: cut_into(words, flat)))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_matches, license and dice of the best match (null without one), and all matches."""
    t = F.coalesce(F.col(text), F.lit(""))
    m = docs.select(F.col(id).alias("doc_id"), matches(t, templates, least).alias("matches"))
    top = F.array_min(F.transform("matches", lambda x: F.struct((-x["dice"]).alias("d"), x["license"].alias("k"))))
    return m.select("doc_id", F.size("matches").cast("long").alias("n_matches"), top["k"].alias("license"), (-top["d"]).alias("dice"), "matches")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: licence texts, headers and notices in all documents."""
    return scan(documents(spark, sf_dir), TEMPLATES | TEXTS)
