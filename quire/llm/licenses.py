"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Words are runs of a-z and 0-9 of the lower-cased text, shingles are five words. A template of n words is looked for in windows of its class, the least of
the lengths 5, 6, 7, ... that grow by a tenth that is not below n, each STEP-th of that length apart. A window is hashed if it holds, widened by one step to
both sides, as many shingles of the class's templates as the shortest of them needs: no other can pass. Which shingles are a class's is told by a table,
three places a shingle, a literal of the plan; a place met by chance costs a hashed window and no more. Two windows at a similarity of 0.6, what a template with a fifth
of its shingles changed and the worst offset keeps, share one of BANDS bands of ROWS minima with probability above 0.999. Bands join the index of
templates, and the verified share is of the template's shingles that stand in the widened window.

All on DataFrame functions. Texts are cut into pieces that overlap by the longest window, so windows never carry a whole text, and a text costs in
proportion to its length. Null and empty texts, and those of fewer than five words, match nothing. Repeated rows of an id count as one document.
Ties in containment go to the earliest window.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, BANDS, ROWS, STEP, CONTAINED = 5, 16, 2, 8, 0.8
#: Least words of a piece of a text, and what bounds the index that is broadcast: templates, and their shingles altogether.
PIECE, MOST, MOST_SHINGLES = 2048, 10_000, 200_000

#: Notices and the opening terms of public licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda x: x != "")


def shingle(array: Column, at: Column) -> Column:
    return F.xxhash64(*(F.get(array, at + i) for i in range(WORDS)))


def shingles(array: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(array) - WORDS), lambda i: shingle(array, i))


def bands(window: Column) -> Column:
    """Hashes of the bands, each of ROWS minima over the window's shingles."""

    def least_of(seed: int) -> Column:
        return F.array_min(F.transform(window, lambda h: F.xxhash64(h, F.lit(seed))))

    least = [least_of(seed) for seed in range(BANDS * ROWS)]
    return F.array(*(F.xxhash64(F.lit(b), *least[b * ROWS : (b + 1) * ROWS]) for b in range(BANDS)))


def length_class(n: int) -> int:
    """The length of the windows for templates of n words: at most a tenth more."""
    length = WORDS
    while length < n:
        length = max(length + 1, length * 11 // 10)
    return length


def membership(values: set[int]) -> Callable[[Column], Column]:
    """A test on 64-bit hashes that all values pass, and others with a probability of 1e-4 at most."""
    size = 1 << max(10, (64 * len(values) - 1).bit_length())
    cells = bytearray(size)
    for value in values:
        for shift in (0, 21, 42):
            cells[((value & 0xFFFFFFFFFFFFFFFF) >> shift) & (size - 1)] = 1
    table = F.lit(bytes(cells))

    def test(h: Column) -> Column:
        places = [(F.shiftrightunsigned(h, shift) if shift else h).bitwiseAND(size - 1).cast("int") for shift in (0, 21, 42)]
        a, b, c = (F.substring(table, at + 1, 1) == F.lit(b"\x01") for at in places)
        return a & b & c

    return test


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, license, containment double, first_word int, n_windows long): each document and template of which CONTAINED of the shingles or more stand in one window;
    first_word: of the best window. templates: name to text, notices or whole licences, of WORDS words at least, at most MOST of MOST_SHINGLES shingles altogether; else an error."""
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    if not templates:
        return spark.createDataFrame([], f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, license string, containment double, first_word int, n_windows bigint")
    lengths = {k: len(re.findall("[a-z0-9]+", v.lower())) for k, v in templates.items()}
    if short := [k for k, n in lengths.items() if n < WORDS]:
        raise ValueError(f"templates of fewer than {WORDS} words: {', '.join(short)}")
    if len(templates) > MOST or sum(lengths.values()) > MOST_SHINGLES:
        raise ValueError("too many templates")
    known = spark.createDataFrame([(k, length_class(lengths[k]), v) for k, v in templates.items()], "license string, n int, body string")
    known = known.withColumn("w", words(F.col("body"))).select("license", "n", F.array_distinct(shingles(F.col("w"))).alias("own"), bands(shingles(F.col("w"))).alias("bands"))
    of: dict[int, set[int]] = {}
    least: dict[int, int] = {}
    rows = known.collect()  # as many shingles as the templates have words
    for r in rows:
        of.setdefault(r["n"], set()).update(r["own"])
        least[r["n"]] = min(least.get(r["n"], MOST_SHINGLES), math.ceil(CONTAINED * len(r["own"])))
    classes = sorted(of)
    some = membership(set().union(*of.values()))
    tests = {n: membership(values) for n, values in of.items()} if len(of) > 1 else {}
    longest, pace = classes[-1], max(1, classes[-1] // STEP)
    piece = max(PIECE, 2 * longest)

    def hits(array: Column, test: Callable[[Column], Column]) -> Column:
        return F.filter(F.transform(array, lambda h, i: F.when(test(h), i)), lambda i: i.isNotNull())

    # No filter on what comes from an array of words: Spark would push it below and repeat the splitting for each shingle.
    hashed = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w")).select("id", F.when(F.size("w") >= WORDS, shingles(F.col("w"))).otherwise(F.array().cast("array<bigint>")).alias("hs"))
    where = lambda p: F.sequence(F.floor(F.greatest(p - longest - pace, F.lit(0)) / piece).cast("int"), F.floor((p + pace) / piece).cast("int"))
    near = hashed.select("id", "hs", F.array_distinct(F.flatten(F.transform(hits(F.col("hs"), some), where))).alias("near"))
    first = lambda b: F.greatest(b * piece - pace, F.lit(0))
    cut = F.transform("near", lambda b: F.struct((b * piece).alias("low"), first(b).alias("at"), F.slice("hs", first(b) + 1, F.lit(piece + longest + 2 * pace)).alias("part")))
    pieces = near.select("id", F.explode_outer(cut).alias("x")).where("x is not null").select("id", "x.*")
    pieces = pieces.select("id", "low", "at", "part", F.transform(hits(F.col("part"), some), lambda i: i + F.col("at")).alias("hits"))

    def own_hits(n: int) -> Column:
        return F.filter("hits", lambda p: tests[n](F.get("part", p - F.col("at")))) if tests else F.col("hits")

    pieces = pieces.select("id", "low", "at", "part", F.array(*(own_hits(n) for n in classes)).alias("by"))

    def starts(k: int, n: int) -> Column:
        """Windows of a class that start in the piece and have hits enough: the first of so many in a row is not before them, the last not behind them."""
        step, span, by, more = max(1, n // STEP), n - WORDS, F.col("by")[k], least[n] - 1

        def of_hit(j: Column) -> Column:
            low = F.ceil(F.greatest(F.get(by, j + more) - span - step, F.lit(0)) / step).cast("int") * step
            high = F.floor((F.get(by, j) + step) / step).cast("int") * step
            return F.when(low <= high, F.sequence(low, high, F.lit(step))).otherwise(F.array().cast("array<int>"))

        all_ = F.when(F.size(by) > more, F.transform(F.sequence(F.lit(0), F.size(by) - 1 - more), of_hit)).otherwise(F.array().cast("array<array<int>>"))
        own = F.filter(F.array_distinct(F.flatten(all_)), lambda s: (s >= F.col("low")) & (s < F.col("low") + piece))
        return F.transform(own, lambda s: F.struct(F.lit(n).alias("n"), F.lit(step).alias("step"), s.alias("s")))

    windows = pieces.select("id", "at", "part", F.explode_outer(F.flatten(F.array(*(starts(k, n) for k, n in enumerate(classes))))).alias("x")).where("x is not null").select("id", "at", "part", "x.*")
    window = F.slice("part", F.col("s") - F.col("at") + 1, F.col("n") - WORDS + 1)
    from_ = F.greatest(F.col("s") - F.col("step"), F.lit(0))
    wide = F.slice("part", from_ - F.col("at") + 1, F.col("s") - from_ + F.col("n") - WORDS + 1 + F.col("step"))
    banded = windows.select("id", "s", "n", F.array_distinct(wide).alias("wide"), F.posexplode(bands(window)).alias("band", "h"))
    index = spark.createDataFrame([(r["license"], r["n"], band, h) for r in rows for band, h in enumerate(r["bands"])], "license string, n int, band int, h bigint")
    shares = spark.createDataFrame([(r["license"], r["own"]) for r in rows], "license string, own array<bigint>")
    met = banded.join(F.broadcast(index), ["n", "band", "h"]).select("id", "s", "wide", "license").join(F.broadcast(shares), "license")
    share = F.size(F.array_intersect("own", "wide")) / F.size("own")
    kept = met.withColumn("containment", share).where(F.col("containment") >= CONTAINED).select("id", "s", "license", "containment")
    best = kept.groupBy("id", "license").agg(F.max(F.struct(F.col("containment"), (-F.col("s")).alias("s"))).alias("b"), F.countDistinct("s").alias("n_windows"))
    return best.select(F.col("id").alias(id_col), "license", F.col("b.containment").alias("containment"), (-F.col("b.s")).alias("first_word"), "n_windows")
