"""Licence scans: sparse TF-IDF cosine to templates, then inheritance.

Every statement of a text (a line, a sentence or a paragraph) is compared with the notice
templates; those of licence files also with the licences' titles, and licence
files as a whole with the licences' texts. A title or a whole text outranks a
notice. A file without a licence of its own takes that of the nearest
directory above it that has a licence file.

Weights are term counts times ln((N + 1) / (n + 1)), with n of N texts
holding the term; the texts are all files and all templates, so that a few
files alone have sound weights too. All terms of the files are counted. A
statement can reach the threshold only if its terms have enough of a
template's weight between them, whatever else it holds; others are not
weighed, which loses none.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import SALTS
from .staging import stage

TOKEN = r"\p{L}+|[0-9]+(?:\.[0-9]+)*"
_PYTHON_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+(?:\.[0-9]+)*")
PARAGRAPH = r"\n[^\p{L}\p{N}\n]*\n"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)([.-][^/]*)?$"

_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Fixed values: (licence, kind, text). Kind "notice" is for the statements and
#: paragraphs of any file, "title" for those of licence files, "text" for whole
#: licence files.
TEMPLATES: list[tuple[str, str, str]] = [
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("MIT", "notice", "SPDX-License-Identifier: MIT"),
    ("BSD-3-Clause", "notice", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "notice", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "notice", "SPDX-License-Identifier: BSD-2-Clause"),
    ("GPL-2.0", "notice", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "notice", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "notice", "SPDX-License-Identifier: GPL-3.0"),
    ("LGPL-3.0", "notice", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "notice", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "notice", "To the extent possible under law, the author has dedicated this work to the public domain under CC0 1.0."),
    ("Unlicense", "notice", "This is free and unencumbered software released into the public domain."),
    ("MIT", "notice", "Licensed under the MIT License. See LICENSE file in the project root for license information."),
    ("MIT", "notice", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0", "notice", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "notice", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-3.0", "notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "notice", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-1.1", "notice", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/"),
    ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MIT", "title", "The MIT License (MIT)"),
    ("ISC", "title", "ISC License"),
    ("BSD-2-Clause", "title", "BSD 2-Clause License"),
    ("BSD-3-Clause", "title", "BSD 3-Clause License"),
    ("Apache-2.0", "title", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-1.0", "title", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"),
    ("GPL-2.0", "title", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "title", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.0", "title", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "title", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "title", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "title", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("GFDL-1.1", "title", "GNU Free Documentation License Version 1.1, March 2000"),
    ("GFDL-1.2", "title", "GNU Free Documentation License Version 1.2, November 2002"),
    ("GFDL-1.3", "title", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("MPL-1.1", "title", "MOZILLA PUBLIC LICENSE Version 1.1"),
    ("MPL-2.0", "title", "Mozilla Public License Version 2.0"),
    ("Artistic-1.0", "title", "The Artistic License"),
    ("CC0-1.0", "title", "CC0 1.0 Universal"),
    ("CC-BY-4.0", "title", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-SA-4.0", "title", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC-BY-NC-4.0", "title", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("MIT", "text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. " + _BSD_END),
    ("BSD-3-Clause", "text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END),
    ("Unlicense", "text", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
]


def template_tokens(text: str) -> list[str]:
    return _PYTHON_TOKEN.findall(text.lower())


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def statements(text: Column) -> Column:
    """Lines and sentences of a text."""
    return F.split(F.regexp_replace(text, r"([.!?])[ \t\r\n]+", "$1\n"), "\n")


def paragraphs(text: Column) -> Column:
    """What stands between blank lines, or lines of marks only, and has lines
    of its own: headers over several lines come together, whatever marks
    begin their lines."""
    return F.filter(F.split(text, PARAGRAPH), lambda x: x.contains("\n"))


def _anchors(vectors: list[dict[str, float]], threshold: float) -> list[str]:
    """Terms of which every statement that reaches the threshold has one: by
    Cauchy-Schwarz, a template's lightest terms alone cannot reach it while
    their norm is below the threshold's share of the template's."""
    out: set[str] = set()
    for vector in vectors:
        room = threshold**2 * sum(w * w for w in vector.values()) * (1 - 1e-9)
        for term, w in sorted(vector.items(), key=lambda x: (x[1], x[0])):
            room -= w * w
            if room < 0:
                out.add(term)
    return sorted(out)


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _shares(tokens: Column, vocabulary: Column, vectors: list[dict[str, float]], norms: list[float]) -> Column:
    """For each template, the share of its squared weight that tokens have."""
    shares = {t: [v.get(t, 0.0) ** 2 / n**2 if n else 0.0 for v, n in zip(vectors, norms, strict=True)] for t in sorted(set().union(*vectors))}
    held = F.from_json(F.lit(json.dumps(shares)), "map<string,array<double>>")
    none = F.array_repeat(F.lit(0.0), len(vectors))
    # A term that all texts have weighs nothing and has no shares.
    step = lambda sums, t: F.coalesce(F.zip_with(sums, F.try_element_at(held, t), lambda a, b: a + b), sums)
    return F.aggregate(F.array_intersect(tokens, vocabulary), none, step)


def scan(
    files: DataFrame,
    *,
    id_col: str = "doc_id",
    path_col: str = "path",
    text_col: str = "text",
    templates: list[tuple[str, str, str]] = TEMPLATES,
    threshold: float = 0.6,
) -> DataFrame:
    """One row a file: id, path, own_license, own_score, inherited_from, license.

    Of templates that match alike the first listed wins. A directory with
    several licence files takes the best match, then the first licence by
    name. A null text has no statements; a null path is the root's nameless
    file. Rows that repeat an id are scanned one by one; should also their
    texts agree, they get the same row each. An empty table gives no rows;
    other columns are ignored. ``inherited_from`` is null for a file with a
    licence of its own or none above it; the root is the empty string.

    ``templates`` may have any texts, such as whole licences from a folder of
    them; their number and length is what is broadcast.
    """
    spark = files.sparkSession
    rows = files.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(path_col), F.lit("")).alias("path"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("h", F.xxhash64("path", "text")).withColumn("no_id", F.col("id").isNull())
    counts = [Counter(template_tokens(t)) for _, _, t in templates]
    mine = Counter(term for c in counts for term in c)
    if not mine:
        raise ValueError("templates without terms")
    extra = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{t}', {n}L)" for t, n in sorted(mine.items())) + " AS t(term, extra)")
    held = stage(rows.select(F.explode(F.array_distinct(_tokens(F.col("text")))).alias("term")).groupBy("term").count(), "terms")
    n_texts = rows.count() + len(templates)
    idf = {r["term"]: math.log((n_texts + 1) / ((r["count"] or 0) + r["extra"] + 1)) for r in extra.join(held, "term", "left").collect()}  # the templates' terms
    vectors = [{t: n * idf[t] for t, n in c.items() if idf[t]} for c in counts]
    norms = [math.sqrt(sum(w * w for w in v.values())) for v in vectors]
    anchors, vocabulary = _strings(_anchors(vectors, threshold)), _strings(sorted(mine))
    cells = [
        f"({i}, '{kind}', '{term}', {w / norm!r}D)"
        for i, ((_, kind, _), v, norm) in enumerate(zip(templates, vectors, norms, strict=True))
        if norm
        for term, w in v.items()
    ] or ["(-1, '', '', 0D)"]
    weights = F.broadcast(spark.sql(f"SELECT * FROM VALUES {', '.join(cells)} AS t(template, kind, term, weight)"))

    licence_file = F.col("path").rlike(LICENCE_FILE)
    hopeful = rows.where(F.arrays_overlap(_tokens(F.col("text")), anchors))
    said = F.concat(statements(F.col("text")), paragraphs(F.col("text")))
    split = hopeful.select("no_id", "id", "h", licence_file.alias("licence_file"), F.posexplode(said).alias("part", "said"))
    whole = hopeful.where(licence_file).select("no_id", "id", "h", F.lit(True).alias("licence_file"), F.lit(-1).alias("part"), F.col("text").alias("said"))
    key = ["no_id", "id", "h", "licence_file", "part"]
    parts = split.unionByName(whole).select(*key, _tokens(F.col("said")).alias("tokens")).where(F.arrays_overlap("tokens", anchors))
    fits = ((F.col("kind") == "text") == (F.col("part") == -1)) & ((F.col("kind") != "title") | F.col("licence_file"))
    kinds = _strings([kind for _, kind, _ in templates])
    open_to = lambda kind: ((kind == "text") == (F.col("part") == -1)) & ((kind != "title") | F.col("licence_file"))
    shares = F.filter(_shares(F.col("tokens"), vocabulary, vectors, norms), lambda x, i: open_to(F.get(kinds, i)) & (x >= threshold**2 - 1e-9))
    near = parts.where(F.size(shares) > 0)
    # Rows that repeat an id, path and text double every count of theirs, which leaves the cosine as it is.
    terms = near.select(*key, F.explode("tokens").alias("term")).groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf"))
    terms = terms.join(held, "term").join(F.broadcast(extra), "term", "left")
    texts = F.col("count") + F.coalesce("extra", F.lit(0)) + 1
    terms = terms.withColumn("w", F.col("tf") * F.log(F.lit(float(n_texts + 1)) / texts))
    known = F.collect_list(F.when(F.col("extra").isNotNull(), F.struct("term", "w")))
    vectored = terms.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), known.alias("known")).where("norm > 0")
    dots = vectored.select(*key, "norm", F.explode("known").alias("k")).select(*key, "norm", "k.term", "k.w")
    dots = dots.join(weights, "term").where(fits).groupBy(*key, "template", "kind").agg(
        F.round(F.sum(F.col("w") * F.col("weight")) / F.first("norm"), 9).alias("score")
    )
    best = F.max(F.struct((F.col("kind") != "notice").alias("level"), "score", (-F.col("template")).alias("place")))
    names = _strings([name for name, _, _ in templates])
    own = dots.where(F.col("score") >= threshold).groupBy("no_id", "id", "h").agg(best.alias("best"))
    own = own.select("no_id", "id", "h", F.get(names, -F.col("best.place")).alias("own_license"), F.round("best.score", 6).alias("own_score"))

    named = rows.select("no_id", "id", "h", "path", F.regexp_replace("path", "/?[^/]*$", "").alias("dir"))
    same = [named["no_id"] == own["no_id"], named["id"].eqNullSafe(own["id"]), named["h"] == own["h"]]
    named = named.join(own, same, "left").select(named["id"], named["path"], named["dir"], "own_license", "own_score")
    licensed = named.where(F.col("path").rlike(LICENCE_FILE) & F.col("own_license").isNotNull())
    least = F.min(F.struct((-F.col("own_score")).alias("s"), "own_license"))
    licensed = licensed.groupBy(F.col("dir").alias("above")).agg(least.alias("found"))
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(steps, 1, i), "/").alias("above")))
    ways = named.select("dir").distinct().select("dir", F.explode(F.array_distinct(above)).alias("at")).select("dir", "at.*")
    nearest = F.max(F.struct("depth", "above", "found")).alias("top")
    given = ways.join(licensed, "above").groupBy("dir").agg(nearest)
    given = given.select("dir", F.col("top.above").alias("above"), F.col("top.found.own_license").alias("given"))
    lacks = F.col("own_license").isNull()
    # A directory's files meet what is above them in parts.
    given = given.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = named.withColumn("salt", F.pmod(F.xxhash64("path", "id"), F.lit(SALTS)).cast("int"))
    return named.join(given, ["dir", "salt"], "left").select(
        F.col("id").alias(id_col), F.col("path").alias(path_col), "own_license", "own_score",
        F.when(lacks, F.col("above")).alias("inherited_from"), F.coalesce("own_license", "given").alias("license"),
    )
