"""License scans with MinHash bands over text windows; DataFrame functions only.

A notice is found where at least SIMILARITY of its shingles of five words (lower-case letters and digits) lie in one window of
a text. Templates are dealt to classes by their number of shingles m: class c has m up to 2**c. A class has windows of 1.75 *
2**c shingles at every 2**(c-1) places, so a window holds a whole notice even with a quarter more words, and its Jaccard
similarity with the notice is at least 0.8 * m / (1.75 * 2**c + 0.2 * m) > 0.21. With BANDS = 32 bands of one minimum each,
such a pair shares a band with probability over 1 - (1 - 0.21) ** 32 > 0.999. Bands retrieve templates; the exact
containment of their shingles, as words, decides.

A window without a template's shingle can share no minimum with it, so only windows around such shingles are hashed. A text of
any length is scanned as a whole; templates are a fixed list (TEMPLATES or one given), so their bands are broadcast.

Nulls: a null text is an empty one; a null doc_id is kept, and rows with one doc_id give the notices of all of them, each from its
own windows. Notices of fewer than five words have no shingle and aren't looked for. Empty table or no notice: no row. Other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import text_of

SHINGLE, SIMILARITY, BANDS = 5, 0.8, 32

# Notices as their licences word them.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once for each row, however often body names it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _places(w: Column) -> Column:
    """Where shingles begin."""
    return F.when(F.size(w) >= SHINGLE, F.sequence(F.lit(0), F.size(w) - SHINGLE)).otherwise(F.array().cast("array<int>"))


def _hashes(w: Column) -> Column:
    """A hash for each shingle, from hashes of its words."""

    def of(x: Column) -> Column:
        return F.transform(_places(x), lambda i: F.xxhash64(*(F.get(x, i + k) for k in range(SHINGLE))))

    return _let(F.transform(w, lambda word: F.xxhash64(word)), of)


def _shingles(w: Column) -> Column:
    """The distinct shingles themselves."""
    return _let(w, lambda x: F.array_distinct(F.transform(_places(x), lambda i: F.concat_ws(" ", F.slice(x, i + 1, SHINGLE)))))


def _minima(hashes: Column) -> Column:
    """The least hash of each band."""

    def least(band: int) -> Column:
        return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(band))))

    return F.array(*map(least, range(BANDS)))


def _windows(c: int) -> Column:
    """The windows of a class that hold one of the places `at`."""
    step, size = max(1, 1 << c >> 1), max(1, (7 << c) // 4)

    def around(p: Column) -> Column:
        return F.transform(F.sequence(F.greatest(F.ceil((p - size + 1) / step), F.lit(0)).cast("int"), F.floor(p / step).cast("int")), lambda k: k * step)

    begun = F.array_distinct(F.flatten(F.transform("at", around)))
    return F.transform(begun, lambda s: F.struct(F.lit(c).alias("class"), s.alias("start"), F.lit(size).alias("size")))


def templates(df: DataFrame, notices: dict[str, str]) -> DataFrame:
    """(license, class, shingles, hashes) of each notice of five words or more."""
    own = df.sparkSession.createDataFrame(sorted(notices.items()), "license string, notice string").withColumn("w", words(F.col("notice")))
    known = own.withColumns({"shingles": _shingles(F.col("w")), "hashes": F.array_distinct(_hashes(F.col("w")))}).filter(F.size("shingles") > 0)
    return known.select("license", F.ceil(F.log2(F.size("shingles"))).cast("int").alias("class"), "shingles", "hashes")


def scan(df: DataFrame, notices: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, containment, first_word): the notices in each text, the best window's share of shingles, and the
    first word of the earliest window that holds one."""
    known = templates(df, TEMPLATES if notices is None else notices)
    wanted = sorted({h for r in known.select("hashes").collect() for h in r[0]})  # a fixed list's hashes
    classes = sorted({r[0] for r in known.select("class").distinct().collect()})
    if not wanted:
        return df.select(df[doc_id].cast("long").alias("doc_id"), F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).alias("first_word")).limit(0)
    def looked_at(w: Column) -> Column:
        def with_places(h: Column) -> Column:
            at = F.filter(F.transform(h, lambda x, i: F.when(x.isin(wanted), i)), lambda i: i.isNotNull())
            return F.struct(w.alias("w"), h.alias("h"), at.alias("at"))

        return _let(_hashes(w), with_places)

    # explode, so that no filter is pushed below, where it would hash all texts a second time
    held = F.filter(F.array(_let(words(text_of(df, text)), looked_at)), lambda x: F.size(x["at"]) > 0)
    hits = df.select(df[doc_id].cast("long").alias("doc_id"), F.explode(held).alias("x")).select("doc_id", "x.*")
    # the windows of each class that hold one of these places: they begin at multiples of a step and are 3.5 steps long
    windows = hits.select("doc_id", "w", "h", F.explode(F.concat(*map(_windows, classes))).alias("x")).select(
        "doc_id", "x.class", "x.start", F.expr("slice(h, x.start + 1, x.size)").alias("h"), F.expr(f"slice(w, x.start + 1, x.size + {SHINGLE - 1})").alias("w")
    )
    banded = windows.select("doc_id", "class", "start", "w", F.posexplode(_minima(F.col("h"))).alias("band", "least"))
    bands = known.select("license", "class", "shingles", F.posexplode(_minima(F.col("hashes"))).alias("band", "least"))
    found = banded.join(F.broadcast(bands), ["class", "band", "least"])
    # of rows with one doc_id, each has windows of its own, which their words tell apart
    once = found.groupBy("doc_id", "class", "start", "license", F.xxhash64("w").alias("of")).agg(F.first("w").alias("w"), F.first("shingles").alias("shingles"))
    share = F.size(F.array_intersect(_shingles(F.col("w")), "shingles")) / F.size("shingles")
    sure = once.select("doc_id", "license", "start", share.alias("containment")).filter(F.col("containment") >= SIMILARITY)
    return sure.groupBy("doc_id", "license").agg(F.round(F.max("containment"), 6).alias("containment"), F.min("start").alias("first_word"))


# --- the same by brute force, for tests -----------------------------------------------------------------------------


def brute(text: str, notices: dict[str, str] | None = None) -> dict[str, float]:
    """The best containment of each notice over all windows of its class's size, wherever they begin."""
    cut = lambda t: re.findall("[a-z0-9]+", t.lower())
    shingles = lambda w: [" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)]
    own, out = shingles(cut(text or "")), {}
    for name, notice in (TEMPLATES if notices is None else notices).items():
        wanted = set(shingles(cut(notice)))
        if wanted:
            size = max(1, (7 << (len(wanted) - 1).bit_length()) // 4)
            best = max((len(wanted & set(own[i : i + size])) / len(wanted) for i in range(max(1, len(own)))), default=0)
            if best >= SIMILARITY:
                out[name] = round(best, 6)
    return out
