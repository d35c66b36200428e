"""Operator 3: licence scans, in built-in functions only.

Each line of a text and the text as a whole are normalised and held against licence notices by the Dice coefficient
over their sets of word bigrams. A notice can only reach the threshold t if its number of bigrams lies between
t / (2 - t) and (2 - t) / t times the line's, so size bounds prune notices before any intersection.

A licence that no line shows is looked for in word windows over the whole text, line breaks and longer lines included.
A window of at most (2 - t) / t times a notice's bigrams is best when it starts and ends with a bigram of the notice,
and at least t / (2 - t) of the notice's bigrams lie in it, so only dense runs of such bigrams are scored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Short notices by which texts state their licence, and the openings by which full texts are known.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ],
    "MIT": ["Released under the MIT License.", "This project is licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Creative Commons Attribution-NonCommercial 4.0 International Public License"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Creative Commons Attribution 4.0 International Public License"],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "all-rights-reserved": ["All rights reserved.", "All rights reserved. No part of this publication may be reproduced without permission."],
}


def normalise(text: Column) -> Column:
    """Lower case; every run of other characters than letters and digits becomes one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def bigrams(text: Column) -> Column:
    """Set of word bigrams of a normalised text."""
    return let(
        F.split(text, " "),
        lambda w: F.when(F.size(w) < 2, F.array().cast("array<string>")).otherwise(
            F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))
        ),
    )


def passages(text: Column, known: list[tuple[str, list[str]]], named: Column, threshold: float) -> Column:
    """Best window (dice, licence) of every notice that a normalised text holds, notices of licences in `named` left out."""
    every = sorted({b for _, bs in known for b in bs})

    def best(pairs: Column, near: Column, name: str, bs: list[str]) -> Column:
        least = math.ceil(len(bs) * threshold / (2 - threshold) - 1e-9)
        most = math.floor(len(bs) * (2 - threshold) / threshold + 1e-9)

        def windows(own: Column) -> Column:
            numbered = F.transform(own, lambda x, i: F.struct(x["at"].alias("at"), i.alias("i")))
            # the window from here holds enough bigrams of the notice, repeated ones counted
            starts = F.filter(numbered, lambda x: F.get(own, x["i"] + (least - 1))["at"] - x["at"] < most)

            def score(x: Column) -> Column:
                ends = F.filter(F.slice(own, x["i"] + least, most - least + 1), lambda e: e["at"] - x["at"] < most)
                return F.array_max(F.transform(ends, lambda e: let(
                    F.array_distinct(F.slice(pairs, x["at"] + 1, e["at"] - x["at"] + 1)),
                    lambda d: 2 * F.size(F.array_intersect(d, F.array(*[F.lit(b) for b in bs]))) / (F.size(d) + len(bs)),
                )))

            return F.when(F.size(own) >= least, F.array_max(F.transform(starts, score)))

        dice = let(F.filter(near, lambda x: x["b"].isin(*bs)), windows)
        return F.when((F.size(near) >= least) & ~F.array_contains(named, name), F.struct(dice.alias("dice"), F.lit(name).alias("licence")))

    def scored(pairs: Column) -> Column:
        near = F.filter(F.transform(pairs, lambda b, i: F.when(b.isin(*every), F.struct(i.alias("at"), b.alias("b")))), lambda x: x.isNotNull())
        return let(near, lambda near: F.filter(F.array(*[best(pairs, near, n, bs) for n, bs in known]), lambda x: x["dice"] >= threshold))

    none = F.array().cast("array<struct<dice:double,licence:string>>")
    return let(F.split(text, " "), lambda w: F.when(F.size(w) < 2, none).otherwise(
        let(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)), scored)
    ))


def templates(notices: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    """(licence, bigrams) of every notice, normalised as texts are (ASCII notices)."""
    found = []
    for name, texts in notices.items():
        for text in texts:
            w = "".join(c if c.isalnum() else " " for c in text.lower()).split()
            found.append((name, sorted({f"{a} {b}" for a, b in zip(w, w[1:])})))
    return found


def scan(docs: DataFrame, keep: list[str], text: str = "text", notices: dict[str, list[str]] = NOTICES, threshold: float = 0.8) -> DataFrame:
    """One row per row of `docs`: `keep`, n_matches (lines that match, or 1 for a whole text), licences (sorted set), best (largest Dice).

    A licence that windows alone show counts as one match.
    Null and empty texts have no match (0, empty array, null best). Ties between notices keep every licence named.
    Whole texts are scanned; repeated rows are scanned each; an empty table gives an empty result.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold lies in (0, 1]")
    known = templates(notices)
    any_bigram = sorted({b for _, bs in known for b in bs})
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    least, most = min(len(b) for _, b in known) * low, max(len(b) for _, b in known) * high
    t = normalise(F.coalesce(F.col(text), F.lit("")))
    units = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    # a unit of w words has at most w - 1 bigrams, so short units need no bigrams; long ones might repeat theirs
    units = F.filter(F.transform(F.concat(units, F.when(F.size(units) > 1, F.array(F.col(text))).otherwise(F.array().cast("array<string>"))), normalise), lambda u: F.char_length(u) >= 3)

    def matches(u: Column) -> Column:
        def scored(b: Column) -> Column:
            def dice(name: str, bs: list[str]) -> Column:
                score = 2 * F.size(F.array_intersect(b, F.array(*[F.lit(x) for x in bs]))) / (F.size(b) + len(bs))
                fits = F.size(b).between(len(bs) * low - 1e-9, len(bs) * high + 1e-9)
                return F.when(fits, F.struct(score.alias("dice"), F.lit(name).alias("licence")))

            return F.filter(F.array(*[dice(n, bs) for n, bs in known]), lambda x: x["dice"] >= threshold)

        sized = lambda b: F.size(b).between(least - 1e-9, most + 1e-9) & F.exists(b, lambda x: x.isin(*any_bigram))
        none = F.array().cast("array<struct<dice:double,licence:string>>")
        return let(bigrams(u), lambda b: F.when(sized(b), scored(b)).otherwise(none))

    lines = F.filter(F.transform(units, matches), lambda x: F.size(x) > 0)
    found = docs.select(*keep, let(lines, lambda f: F.struct(
        f.alias("lines"), passages(t, known, F.transform(F.flatten(f), lambda x: x["licence"]), threshold).alias("windows")
    )).alias("_found"))
    windows = F.col("_found")["windows"]
    both = F.concat(F.flatten(F.col("_found")["lines"]), windows)
    return found.select(
        *keep,
        (F.size(F.col("_found")["lines"]) + F.size(F.array_distinct(F.transform(windows, lambda x: x["licence"])))).cast("long").alias("n_matches"),
        F.sort_array(F.array_distinct(F.transform(both, lambda x: x["licence"]))).alias("licences"),
        F.array_max(F.transform(both, lambda x: x["dice"])).alias("best"),
    )
