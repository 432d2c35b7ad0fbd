"""License scans with DataFrame functions only: MinHash bands over overlapping text windows, then exact containment.

Words are runs of a-z and 0-9 of the lower-cased text; shingles are SHINGLE words (of a shorter template: all of it).
Templates fall into classes by length. For each class, windows of one and a quarter times the longest template of the
class start at every quarter of the shortest, so that any place of a template lies whole in a window. A window's
MinHash has BANDS bands of one row. A window that holds 80 % of a template's shingles has at least 0.44 of the
union with it (checked in the tests), so it shares a band with a chance of at least 1 - 0.56 ** BANDS, over 0.9999. What shares
a band is verified exactly: the share of the template's distinct shingles that the window has.

Before all that, documents without any word of ANCHORS are left out. That loses nothing: in every template, more than
a fifth of the shingles hold such a word (checked in the tests), so no text without one reaches 80 %.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
BANDS = 16
LEAST = 0.8
# Notices of well-known licenses, as published with them.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0",
    "mit-line": "Released under the MIT License",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0-line": "Licensed under CC BY 4.0",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
#: Words of which one or more stand in over a fifth of every template's shingles.
ANCHORS = ("license", "licensed", "copyright", "permission", "warranty", "redistribution", "redistributions", "software", "mozilla")


def words(text: str) -> list[str]:
    """Runs of a-z and 0-9 of the lower-cased text, repeats kept; none of an empty text."""
    return re.findall("[a-z0-9]+", text.lower())


def shingles(tokens: list[str]) -> list[str]:
    """Distinct runs of SHINGLE words, in order; of fewer words, all of them as one; of none, none."""
    size = min(SHINGLE, len(tokens))
    return list(dict.fromkeys(" ".join(tokens[i : i + size]) for i in range(len(tokens) - size + 1))) if tokens else []


def classes(templates: dict[str, str]) -> list[tuple[int, int, dict[str, list[str]]]]:
    """(window words, stride, templates as words) of each class of lengths, a quarter apart at most."""
    out: list[tuple[int, int, dict[str, list[str]]]] = []
    left = sorted((len(words(t)), name) for name, t in templates.items())
    while left:
        shortest = left[0][0]
        own = [x for x in left if 4 * x[0] <= 5 * shortest and min(x[0], SHINGLE) == min(shortest, SHINGLE)]
        left = [x for x in left if x not in own]
        stride = max(1, shortest // 4)
        out.append((own[-1][0] + stride - 1, stride, {name: words(templates[name]) for _, name in own}))
    return out


def _hashes(tokens: str, size: int) -> str:
    """SQL for the hashes of the runs of `size` words of the array `tokens`; of a shorter array, that of all of it."""
    return f"transform(sequence(1, greatest(size({tokens}) - {size - 1}, 1)), i -> xxhash64(slice({tokens}, i, {size})))"


def _least(hashes: str) -> str:
    """SQL for the least value of each of the BANDS hash functions over an array of hashes."""
    return f"transform(sequence(1, {BANDS}), b -> array_min(transform({hashes}, h -> xxhash64(h, b))))"


def _literal(values: list[int]) -> str:
    return "array(" + ", ".join(f"{x}L" if x > -(1 << 63) else "(-9223372036854775807L - 1L)" for x in values) + ")"


def _found_in_class(width: int, stride: int, size: int, templates: list, least: float) -> str:
    """SQL for the templates (number, hashes, bands) of a class that windows hold: their number t and windows' shares c.

    It stands where `hashes` are bound to a document's shingles and `every` to each band's hashes of these.
    """
    inner = width - size + 1
    windows = f"transform(sequence(1, size(hashes), {stride}), at -> struct(slice(hashes, at, {inner}) as hashes, transform(every, b -> array_min(slice(b, at, {inner}))) as bands))"
    hits = []
    for number, exact, bands in templates:
        near = f"filter(windows, w -> arrays_overlap(w.bands, {_literal(bands)}))"
        share = f"transform({near}, w -> size(array_intersect({_literal(exact)}, w.hashes)) / cast({len(exact)} as double))"
        hits.append(f"struct({number} as t, filter({share}, c -> c >= {least}D) as c)")
    return f"get(transform(array({windows}), windows -> filter(array({', '.join(hits)}), f -> size(f.c) > 0)), 0)"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """A row per document and license found in it: id_col, license, containment (the best window's), n_windows.

    Whole texts are scanned. Null and empty texts hold no license. Rows with equal ids count as one document, a null id
    too; the windows of repeated rows add up. Other columns aren't read. An empty table gives no rows. Templates are few:
    they are literals of the plan. One without a word is found nowhere, and without templates there are no rows; licenses
    with the same text are both found.
    """
    spark = docs.sparkSession
    given = templates is not None
    templates = {name: t for name, t in (TEMPLATES if templates is None else templates).items() if words(t)}
    names = sorted(templates)
    schema = docs.select(F.col(id_col)).schema.add("license", "string").add("containment", "double").add("n_windows", "long")
    if not templates:
        return spark.createDataFrame([], schema)
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    if not given:
        anchor = F.lit(False)
        for word in ANCHORS:
            anchor = anchor | F.contains("text", F.lit(word))
        rows = rows.filter(anchor)
    rows = rows.select("id", F.expr("filter(split(text, '[^a-z0-9]+'), w -> w != '')").alias("words"))
    own = spark.createDataFrame([(names.index(name), min(SHINGLE, len(words(t))), words(t)) for name, t in templates.items()], "t int, k int, words array<string>")
    lookup = own.select("t", F.expr(f"array_distinct(case k {' '.join(f'when {k} then {_hashes("words", k)}' for k in range(1, SHINGLE + 1))} end)").alias("hashes"))
    lookup = {r["t"]: (r["t"], r["hashes"], r["bands"]) for r in lookup.withColumn("bands", F.expr(_least("hashes"))).collect()}  # a row per template
    # of each shingle size, the shingles and each band's hashes are bound once per document for all its classes
    found = []
    by_size: dict[int, list[str]] = {}
    for width, stride, members in classes(templates):
        size = min(SHINGLE, min(map(len, members.values())))
        by_size.setdefault(size, []).append(_found_in_class(width, stride, size, [lookup[names.index(name)] for name in members], least))
    for size, parts in by_size.items():
        every = f"transform(sequence(1, {BANDS}), b -> transform(hashes, h -> xxhash64(h, b)))"
        found.append(f"get(transform(array({_hashes('words', size)}), hashes -> get(transform(array({every}), every -> concat({', '.join(parts)})), 0)), 0)")
    hits = rows.filter("size(words) > 0").select("id", F.inline(F.expr(f"concat({', '.join(found)})")))
    hits = hits.select("id", "t", F.array_max("c").alias("containment"), F.size("c").cast("bigint").alias("n_windows"))
    best = hits.groupBy("id", "t").agg(F.max("containment").alias("containment"), F.sum("n_windows").alias("n_windows"))
    named = F.get(F.array(*map(F.lit, names)), F.col("t"))
    return best.select(F.col("id").alias(id_col), named.alias("license"), "containment", "n_windows")
