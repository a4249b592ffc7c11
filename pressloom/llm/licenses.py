"""License scans: MinHash bands over overlapping windows find templates, exact containment confirms them.

Built-in functions only. Texts are lower-cased words (letters and digits) and their
five-word shingles. Templates are sorted into classes by length; a class of templates
up to ``size`` shingles is searched with windows of ``size + step - 1`` shingles every
``step``, so that some window holds any such run whole. Each window has ``bands``
MinHash values, the minima of its shingles' hashes under different bit flips; one equal
value in a band makes the template a candidate. ``bands`` follows from the lowest
Jaccard similarity that a window with the wanted containment can have, so that such a
window is missed with a chance of at most ``MISS``. Windows go to templates by a
broadcast of the templates' bands, whose size the templates bound.

Before, texts are left out that cannot hold any template: every template has words
without which too few of its shingles remain, and a text with none of these words is
not looked at. Of the others, only windows are drawn that hold a shingle of some
template: without one no MinHash value can be equal.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from typing import NamedTuple

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINMENT = 0.8
#: The highest chance that the bands miss a window that holds a template.
MISS = 1e-4
#: Templates that a scan takes at most; their bands are broadcast.
MOST_TEMPLATES = 10_000
#: Shingles of all templates that a scan takes at most.
MOST_SHINGLES = 50_000

# Whole texts of short licences, and the notices by which the others and their short forms are stated.
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT_HEAD = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_MIT_REST = 'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_REST = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_GNU = "This {0} is free software{3} you can redistribute it and/or modify it under the terms of the GNU {1} General Public License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version. This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} General Public License for more details."
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "mit-licensed": "This project is licensed under the terms of the MIT license.",
    "mit-license-notice": "Licensed under the MIT License.",
    "bsd-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-sa-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nd-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "mit": _MIT_HEAD,
    "mit-text": f"{_MIT_HEAD} {_MIT_REST}",
    "isc-text": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_REST}",
    "0bsd-text": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_REST}",
    "bsd": _BSD_HEAD,
    "bsd-2-clause-text": f"{_BSD_HEAD} 1. {_BSD_SOURCE} 2. {_BSD_BINARY} {_BSD_END}",
    "bsd-3-clause-text": f"{_BSD_HEAD} 1. {_BSD_SOURCE} 2. {_BSD_BINARY} 3. {_BSD_NAMES} {_BSD_END}",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "bsl-1.0-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "gpl-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2.0-or-later": _GNU.format("program", "", "2", ";").replace("  ", " "),
    "lgpl-2.1-or-later": _GNU.format("library", "Lesser", "2.1", ";"),
    "lgpl-3.0-or-later": _GNU.format("library", "Lesser", "3", ":"),
    "agpl-3.0-or-later": _GNU.format("program", "Affero", "3", ":"),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
}


class Class(NamedTuple):
    """Window settings of the templates of up to ``size`` shingles."""

    size: int
    step: int
    window: int
    bands: int


def shingles(text: str) -> list[str]:
    """The distinct shingles of a template, in order."""
    found = regex.findall(r"[\p{L}\p{N}]+", text.lower())
    return list(dict.fromkeys(" ".join(found[i : i + SHINGLE]) for i in range(len(found) - SHINGLE + 1)))


def bands_for(jaccard: float, miss: float = MISS) -> int:
    """The least number of one-row bands by which a pair of this similarity is missed with a chance of at most ``miss``."""
    return 1 if jaccard >= 1 else max(1, math.ceil(math.log(miss) / math.log(1 - jaccard)))


def classes(lengths: list[int], containment: float = CONTAINMENT) -> dict[int, Class]:
    """{number of shingles: its class}; class sizes are powers of two."""
    out, found = {}, {}
    for n in sorted(set(lengths)):
        size = 1 << (n - 1).bit_length()
        out.setdefault(size, []).append(n)
    for size, own in out.items():
        step = max(1, size // 2)
        window = size + step - 1
        shared = [math.ceil(containment * n - 1e-9) for n in own]
        bands = max(bands_for(k / (window + n - k)) for k, n in zip(shared, own, strict=True))
        for n in own:
            found[n] = Class(size, step, window, bands)
    return found


def anchors(templates: Mapping[str, str], containment: float = CONTAINMENT) -> list[str]:
    """Words such that a text with none of them contains less than ``containment`` of every template."""
    chosen: set[str] = set()
    for text in templates.values():
        left = [s.split(" ") for s in shingles(text)]
        total = len(left)
        while True:
            left = [s for s in left if not chosen.intersection(s)]
            if len(left) < containment * total - 1e-9:
                break
            # many shingles hold it, and few other texts: short words are a last resort
            weight = {w: (sum(w in s for s in left) * max(0.01, min(len(w), 8) - 4), w) for s in left for w in s}
            chosen.add(max(weight, key=weight.get))
    return sorted(chosen)


def _flips(n: int) -> Column:
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return F.array(*(F.lit(signed((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) for k in range(n)))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def _keys(words: Column) -> Column:
    """The hashes of all shingles, in order."""
    places = F.when(F.size(words) >= SHINGLE, F.sequence(F.lit(0), F.size(words) - SHINGLE)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*(F.get(words, (i + k).cast("int")) for k in range(SHINGLE))))


def _minima(keys: Column, bands: Column, most: int) -> Column:
    flips = F.slice(_flips(most), F.lit(1), bands)
    return F.transform(flips, lambda c: F.array_min(F.transform(keys, lambda x: x.bitwiseXOR(c))))


def _strings(words: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.array_join(F.slice(words, i + 1, SHINGLE), " ")))


def template_bands(spark: SparkSession, templates: Mapping[str, str], sets: dict[int, Class], most: int) -> tuple[DataFrame, DataFrame]:
    """((size, band, value, license) of the MinHash values, (license, shingles) of the templates)."""
    rows = [(name, text, sets[len(found)].size, sets[len(found)].bands) for name, text in templates.items() if (found := shingles(text))]
    table = spark.createDataFrame(rows, "license string, text string, size int, bands int").withColumn("words", _words(F.col("text")))
    values = table.select("license", "size", F.posexplode(_minima(F.array_distinct(_keys(F.col("words"))), F.col("bands"), most)).alias("band", "value"))
    return values.select("size", "band", "value", "license"), table.select("license", _strings(F.col("words")).alias("shingles"))


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, containment, first_word, n_windows): every template that a document holds.

    A document holds a template if one of its windows contains ``containment`` or more
    of the template's distinct shingles; the highest containment, the first such
    window's word and the number of such windows are stated. A template that is part of
    another is found in it, too. Rows that repeat both id and text give one row a
    template. Null, empty and short texts hold none, nor does an empty table. Other
    columns are not read, so their names cannot clash. Templates of fewer than five words are an error.
    """
    wanted = {name: shingles(t) for name, t in templates.items()}
    lengths = [len(x) for x in wanted.values()]
    if not templates or min(lengths) == 0 or len(templates) > MOST_TEMPLATES or sum(lengths) > MOST_SHINGLES:
        raise ValueError(f"give 1 to {MOST_TEMPLATES} templates of {SHINGLE} words or more, {MOST_SHINGLES} shingles in all")
    sets = classes(lengths, containment)
    most = max(c.bands for c in sets.values())
    text = F.coalesce(F.col(text_col), F.lit(""))
    some = docs.where(F.lower(text).rlike("|".join(anchors(templates, containment))))
    some = some.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), _words(text).alias("words"))
    some = some.where(F.size("words") >= SHINGLE).withColumn("keys", _keys(F.col("words")))
    bands, texts = template_bands(docs.sparkSession, templates, sets, most)
    # equal minima are a shingle in common: only windows that hold one of a template are drawn
    all_keys = texts.select(F.explode("shingles").alias("s")).select(F.xxhash64(*(F.split("s", " ")[k] for k in range(SHINGLE))).alias("k")).distinct().collect()
    known = [r.k for r in all_keys]  # at most MOST_SHINGLES numbers
    met_at = F.filter(F.transform("keys", lambda x, i: F.when(x.isin(known), i)), lambda i: i.isNotNull())
    some = some.withColumn("at", F.explode_outer(F.array(met_at))).where(F.size("at") > 0)

    def cut(c: Class) -> Column:
        # the starts, multiples of step, of the windows that a met shingle is in
        of = lambda x: F.sequence(F.greatest(F.lit(0), F.ceil((x - c.window + 1) / c.step).cast("int")) * c.step, F.floor(x / c.step).cast("int") * c.step, F.lit(c.step))
        return F.transform(
            F.array_distinct(F.flatten(F.transform("at", of))),
            lambda i: F.struct(
                F.lit(c.size).alias("size"),
                F.lit(c.bands).alias("bands"),
                i.alias("start"),
                F.slice("keys", i + 1, c.window).alias("keys"),
                F.slice("words", i + 1, c.window + SHINGLE - 1).alias("words"),
            ),
        )

    windows = some.select("id", "text_hash", F.explode(F.concat(*(cut(c) for c in sorted(set(sets.values()))))).alias("w")).select("id", "text_hash", "w.*")
    probes = windows.select("id", "text_hash", "size", "start", "words", F.posexplode(_minima(F.col("keys"), F.col("bands"), most)).alias("band", "value"))
    met = probes.join(F.broadcast(bands), ["size", "band", "value"]).drop("band", "value")  # at most MOST_TEMPLATES times the bands, of numbers
    share = F.size(F.array_intersect("shingles", _strings(F.col("words")))) / F.size("shingles")
    held = met.join(F.broadcast(texts), "license").select("id", "text_hash", "license", "start", share.alias("share")).where(F.col("share") >= containment - 1e-9)  # at most MOST_SHINGLES strings
    found = held.groupBy("id", "text_hash", "license").agg(
        F.max("share").alias("containment"), F.min("start").cast("long").alias("first_word"), F.count_distinct("start").alias("n_windows")
    )
    return found.select("id", "license", "containment", "first_word", "n_windows")
