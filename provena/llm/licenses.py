"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle
containment verifies them; DataFrame functions only.

Templates and texts are cut into lower-cased words of a-z and 0-9, and words into shingles of five (a
template of fewer words is one shingle).  For each template length m, windows of m + stride - 1 words
start every stride = max(1, m // 4) words, so each run of m words lies inside one.  A window with a
template's run has a likeness of 0.8 or more to it, and with four fifths of the run 0.5 or more; with
BANDS bands of ROWS minima they meet with a chance of 1 - (1 - 0.5**2)**32 > 0.9998.

Before that, two tests that lose nothing leave out what cannot match.  A match lacks at most a known number
of a template's shingles, so a text must hold one of the anchors: long words that stand in more of the
template's shingles than that.  And a window must hold as many known shingles as the least match of its
length needs.

Defined cases: null and empty texts have no matches; a long text is scanned whole; equal rows (id and
text) give one set of matches; a null doc_id is a group like any; extra columns are ignored; templates
without words are left out; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame, functions as F

from provena.session import stored

SHINGLE = 5
CONTAINMENT = 0.8
BANDS, ROWS = 32, 2
#: Bound of the templates, in shingles; their tables are literals of the plan or are broadcast.
MAX_SHINGLES = 50_000

#: Texts by which licenses announce themselves, and short licenses (BSL-1.0 and Unlicense without disclaimers).
TEMPLATES = [
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", "disclaimer", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "licensed", "Licensed under the MIT License."),
    ("MIT", "grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "header", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("BSD", "conditions", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "work", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "notice", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "notice", "This is free and unencumbered software released into the public domain."),
    ("AGPL-3.0", "header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "header", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("GPL", "warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("EPL-2.0", "notice", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("MIT", "body", '''Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'''),
    ("BSD-2-Clause", "body", '''Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'''),
    ("BSD-3-Clause", "endorsement", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "body", '''Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'''),
    ("Zlib", "body", '''This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
        2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        3. This notice may not be removed or altered from any source distribution.'''),
    ("BSL-1.0", "body", '''Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
        The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.'''),
    ("Unlicense", "body", '''This is free and unencumbered software released into the public domain.
        Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
        In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.'''),
    ("proprietary", "notice", "All rights reserved."),
]


def _words(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def shingles(ws: Column, k: int) -> Column:
    """Hashes of k consecutive words, by position."""
    return F.when(F.size(ws) >= k, F.transform(F.sequence(F.lit(1), F.size(ws) - k + 1), lambda i: F.xxhash64(F.array_join(F.slice(ws, i, k), " ")))).otherwise(F.expr("cast(array() AS array<bigint>)"))


def _bands(items: Column) -> Column:
    """BANDS hashes of ROWS minima of a non-empty set of hashes."""
    low = lambda p: F.array_min(F.transform(items, lambda x: F.xxhash64(x, p)))
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, *[low(b * ROWS + r) for r in range(ROWS)]))


def _classes(templates: list[tuple[str, str, str]]) -> dict[tuple[int, int], list[tuple[str, str, str]]]:
    """Templates by shingle size and length in words."""
    out = defaultdict(list)
    for t in templates:
        m = len(_words(t[2]))
        if m:
            out[min(SHINGLE, m), m].append(t)
    if sum(m - k + 1 for (k, m), ts in out.items() for _ in ts) > MAX_SHINGLES:
        raise ValueError("too many templates for one scan; scan in blocks of templates")
    return dict(out)


def _need(n: int, least: float) -> int:
    """How many of a template's n different shingles a match holds at least."""
    return next(h for h in range(n + 1) if h / n >= least)


def _anchors(texts: list[list[str]], least: float) -> list[str]:
    """Words of which every text that holds the share `least` of a template's shingles has one.

    A match lacks at most n - need of n different shingles; the anchors stand in more than those.
    """
    out: set[str] = set()
    for ws in texts:
        k = min(SHINGLE, len(ws))
        left = {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)}
        n = len(left)
        may_lack = n - _need(n, least)
        left = {g for g in left if not out & set(g)}
        for w in sorted(set(ws), key=lambda w: (-len(w), w)):
            if n - len(left) > may_lack:
                break
            if any(w in g for g in left):
                out.add(w)
                left = {g for g in left if w not in g}
    return sorted(out)


def scan(docs: DataFrame, templates: list[tuple[str, str, str]] | None = None, least: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, template, containment, start (word of the best window) and windows (how many match)."""
    if not 0 < least <= 1:
        raise ValueError("the least containment is above 0 and at most 1")
    spark = docs.sparkSession
    classes = _classes(TEMPLATES if templates is None else templates)
    anchors = _anchors([_words(t[2]) for ts in classes.values() for t in ts], least)
    schema = "doc_id " + docs.schema["doc_id"].dataType.simpleString() + ", license string, template string, containment double, start int, windows long"
    if not anchors:
        return spark.createDataFrame([], schema)
    rows = [(k, m, a, n, t) for (k, m), ts in classes.items() for a, n, t in ts]
    tab = spark.createDataFrame(rows, "k int, m int, license string, template string, t string")
    by_k = {k: F.array_distinct(shingles(words(F.col("t")), k)) for k, _ in classes}
    pick = F.coalesce(*[F.when(F.col("k") == k, c) for k, c in by_k.items()])
    got = tab.select("k", "m", "license", "template", pick.alias("items")).collect()  # at most MAX_SHINGLES hashes
    tab = spark.createDataFrame(got, "k int, m int, license string, template string, items array<bigint>")
    known = {k: sorted({x for r in got if r.k == k for x in r["items"]}) for k in by_k}
    need = {(r.k, r.m): min(_need(len(x["items"]), least) for x in got if (x.k, x.m) == (r.k, r.m)) for r in got}
    keys = tab.select("k", "m", "license", "template", F.explode(_bands(F.col("items"))).alias("band")).distinct()

    # each array goes through a generator of one row, so that the optimizer can't copy its
    # expression into the functions that run for every item
    once = lambda c: F.explode(F.array(c))
    split = F.split(F.lower("text"), "[^a-z0-9]+")
    d = docs.select("doc_id", "text").select("doc_id", F.xxhash64("text").alias("row"), once(split).alias("ws"))
    d = d.where(F.arrays_overlap("ws", F.lit(anchors))).select("doc_id", "row", once(F.filter("ws", lambda w: w != "")).alias("ws"))
    d = d.select("doc_id", "row", once(F.struct(*[shingles(F.col("ws"), k).alias(f"s{k}") for k in by_k])).alias("s"))
    hits = lambda k: F.filter(F.transform(F.col(f"s.s{k}"), lambda x, i: F.when(x.isin(known[k]), i)), lambda i: i.isNotNull())
    d = d.select("doc_id", "row", "s", once(F.struct(*[hits(k).alias(f"s{k}") for k in by_k])).alias("hits"))
    d = stored(d.where(" OR ".join(f"size(hits.s{k}) > 0" for k in by_k)))
    parts = []
    for k in by_k:
        sizes = [F.struct(F.lit(m).alias("m"), F.lit(max(1, m // 4)).alias("stride"), F.lit(m + max(1, m // 4) - k).alias("width"), F.lit(need[k, m]).alias("need")) for m in sorted(m for kk, m in classes if kk == k)]
        h = d.select("doc_id", "row", F.lit(k).alias("k"), F.col(f"s.s{k}").alias("s"), F.col(f"hits.s{k}").alias("hits"), F.explode(F.array(*sizes)).alias("c"))
        first = lambda i: F.ceil(F.greatest(i - (F.col("c.width") - 1), F.lit(0)) / F.col("c.stride")).cast("int")
        last = lambda i: F.floor(i / F.col("c.stride")).cast("int")
        starts = F.array_distinct(F.flatten(F.transform("hits", lambda i: F.sequence(first(i), last(i)))))
        w = h.select("doc_id", "row", "k", "c", "s", F.explode(starts).alias("n"))
        w = w.select("doc_id", "row", "k", F.col("c.m").alias("m"), F.col("c.need").alias("need"), (F.col("n") * F.col("c.stride")).alias("start"), F.array_distinct(F.slice("s", F.col("n") * F.col("c.stride") + 1, F.col("c.width"))).alias("set"))
        parts.append(w.where(F.size(F.filter("set", lambda x: x.isin(known[k]))) >= F.col("need")).drop("need"))
    windows = parts[0]
    for p in parts[1:]:
        windows = windows.unionByName(p)
    met = windows.withColumn("band", F.explode(_bands(F.col("set")))).join(F.broadcast(keys), ["k", "m", "band"])
    met = met.groupBy("doc_id", "row", "k", "m", "start", "license", "template").agg(F.first("set").alias("set"))
    both = met.join(F.broadcast(tab), ["k", "m", "license", "template"])
    share = F.size(F.array_intersect("items", "set")) / F.size("items")
    good = both.select("doc_id", "row", "license", "template", "start", share.alias("containment")).where(F.col("containment") >= least)
    best = good.groupBy("doc_id", "row", "license", "template").agg(
        F.max("containment").alias("containment"), F.min_by("start", F.struct(-F.col("containment"), "start")).alias("start"), F.count("*").alias("windows"))
    return best.select("doc_id", "license", "template", "containment", "start", "windows")


def brute_force(rows: list[tuple], templates: list[tuple[str, str, str]] | None = None, least: float = CONTAINMENT) -> dict:
    """(doc_id, license, template) to the best containment over all windows of (doc_id, text) rows."""
    out: dict[tuple, float] = {}
    for i, text in rows:
        ws = _words(text or "")
        for a, n, t in TEMPLATES if templates is None else templates:
            tw = _words(t)
            m, k = len(tw), min(SHINGLE, len(tw))
            stride = max(1, m // 4)
            want = {tuple(tw[j : j + k]) for j in range(m - k + 1)}
            for s in range(0, len(ws), stride):
                have = ws[s : s + m + stride - 1]
                share = len(want & {tuple(have[j : j + k]) for j in range(len(have) - k + 1)}) / len(want)
                if share >= least:
                    out[i, a, n] = max(share, out.get((i, a, n), 0))
    return out
