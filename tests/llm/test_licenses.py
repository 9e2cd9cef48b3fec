from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from inkwell.llm import licenses

COMMON = Path("/usr/share/common-licenses")
FILES = "doc_id long, path string, text string"
MIT = next(t for n, k, t in licenses.TEMPLATES if n == "MIT" and k == "text")
TREE = [
    (1, "a/LICENSE", MIT), (2, "a/b/x.py", "print(1)"), (3, "a/b/y.py", "# SPDX-License-Identifier: Apache-2.0\nx = 1"), (4, "c/z.py", "nothing here"),
    (5, "a/b/c/COPYING.txt", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nEveryone is permitted to copy"), (6, "a/b/c/d/e.py", None),
    (7, "top.py", "Licensed under CC BY-SA 4.0. Enjoy."), (8, None, None), (None, "a/q.py", ""), (9, "ab/LICENSED.txt", MIT), (10, "ab/w.py", "a licence file is not named LICENSED.txt"),
    (6, "a/b/c/d/e.py", None),
]


def brute(files, templates=licenses.TEMPLATES, threshold=0.6):
    """The scan by plain loops, with the frequencies of all terms."""
    tokens = lambda t: re.findall(r"[^\W\d_]+|[0-9]+(?:\.[0-9]+)*", (t or "").lower())
    texts = [t for _, _, t in files] + [t for _, _, t in templates]
    held = Counter(x for t in texts for x in set(tokens(t)))

    def vector(text):
        return {x: n * math.log((len(texts) + 1) / (held[x] + 1)) for x, n in Counter(tokens(text)).items()}

    def cosine(a, b):
        norm = math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))
        return sum(w * b.get(x, 0) for x, w in a.items()) / norm if norm else 0

    known = [(i, name, kind, vector(t)) for i, (name, kind, t) in enumerate(templates)]
    own = []
    for _, path, text in files:
        text, best = text or "", (0, 0, 0, None)
        said = re.sub(r"([.!?])[ \t\r\n]+", r"\1\n", text).split("\n") + [p for p in re.split(r"\n(?:[^\w\n]|_)*\n", text) if "\n" in p]
        parts = [(("notice",), x) for x in said]
        if re.search(licenses.LICENCE_FILE, path or ""):
            parts = [(("notice", "title"), x) for x in said] + [(("text",), text)]
        for kinds, x in parts:
            v = vector(x)
            for i, name, kind, t in known:
                if kind in kinds and (score := round(cosine(v, t), 9)) >= threshold:
                    best = max(best, (kind != "notice", score, -i, name))
        own.append(best[3])
    given = {}
    for (_, path, _), name in sorted(zip(files, own), key=lambda x: str(x)):
        if name and re.search(licenses.LICENCE_FILE, path or ""):
            given.setdefault(path.rpartition("/")[0], name)
    out = []
    for (i, path, _), name in zip(files, own):
        way = (path or "").rpartition("/")[0].split("/")
        ups = ["/".join(way[:n]) for n in range(len(way), -1, -1)]
        above = next((u for u in ups if u in given), None)
        out.append((i, path or "", name, None if name else above, name or given.get(above)))
    return sorted(out, key=str)


def found(df, **options):
    return sorted((tuple(r) for r in licenses.scan(df, **options).select("doc_id", "path", "own_license", "inherited_from", "license").collect()), key=str)


def test_tree(spark):
    df = spark.createDataFrame(TREE, FILES)
    got = found(df)
    assert got == brute(TREE)
    by_id = {r[0]: r[4] for r in got}
    assert by_id[2] == "MIT" and by_id[3] == "Apache-2.0" and by_id[4] is None and by_id[6] == "GPL-3.0" and by_id[7] == "CC-BY-SA-4.0" and by_id[10] is None


def test_documents(documents):
    df = documents.select("doc_id", F.concat("source", F.lit("/"), F.when(F.col("doc_id") % 20 == 0, F.concat(F.lit("LICENSE-"), "doc_id")).otherwise(F.col("doc_id").cast("string"))).alias("path"), "text")
    got, want = found(df), brute([tuple(r) for r in df.collect()])
    own = {r[0]: r[2] for r in want}
    assert {r[0]: r[2] for r in got} == own and any(own.values())


REAL = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0",
    "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}


@pytest.mark.skipif(not COMMON.is_dir(), reason="no licence texts on this machine")
@pytest.mark.parametrize("together", [True, False])
def test_real_licence_files(spark, together):
    data = [(i, f"{name}/COPYING", (COMMON / name).read_text("utf-8", "replace")) for i, name in enumerate(REAL) if (COMMON / name).is_file()]
    data += [(100 + i, f"{path}/code.py", "x = 1") for i, (_, path, _) in enumerate((i, p.split("/")[0], t) for i, p, t in data)]
    for some in [data] if together else [[r for r in data if r[1].startswith(name + "/")] for name in ("GPL-3", "LGPL-2.1", "BSD")]:
        found = {r["path"]: r["license"] for r in licenses.scan(spark.createDataFrame(some, FILES)).collect()}
        assert found == {p: REAL[p.split("/")[0]] for _, p, _ in some}


HEADERS = [
    ("GPL-3.0", "#!/usr/bin/env python\n# Copyright (C) 2020 A. Body\n#\n# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n#\n# This program is distributed in the hope that it will be useful\n\nimport os\n"),
    ("GPL-2.0", "/*\n * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation; either version 2 of the License, or\n * (at your option) any later version.\n */\nint main;\n"),
    ("MIT", "// Copyright (c) Somebody. All rights reserved.\n// Licensed under the MIT license, see the LICENSE file in the project root for details.\n\nlet x;\n"),
    ("Apache-2.0", "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n"),
    (None, "This text speaks of a license to print money, and of the public.\nIt has several lines,\nall of them harmless.\n"),
]


def test_headers_over_several_lines(spark):
    data = [(i, f"{i}.c", t) for i, (_, t) in enumerate(HEADERS)]
    got = found(spark.createDataFrame(data, FILES))
    assert got == brute(data)
    assert [r[2] for r in got] == [name for name, _ in HEADERS]


def test_very_long_text_and_hard_rows(spark, hard, clashing):
    """Texts of 60,000 words, nulls, repeated rows and clashing columns."""
    df = clashing.withColumn("path", F.concat_ws("/", "source", F.when(F.col("doc_id") % 2 == 0, "LICENSE").otherwise("a.txt")))
    got = licenses.scan(df).collect()
    assert len(got) == hard.count() and all(r["license"] is None for r in got)
    long = spark.createDataFrame([(1, "LICENSE", "word " * 60_000 + "\n\nMIT License\n\n" + MIT), (2, "x/y.py", None)], FILES)
    assert {r["license"] for r in licenses.scan(long).collect()} == {"MIT"}


def test_anchors_lose_nothing(spark):
    df = spark.createDataFrame(TREE, FILES)
    for threshold in (0.3, 0.9):
        assert [r[2] for r in found(df, threshold=threshold)] == [r[2] for r in brute(TREE, threshold=threshold)]


def test_empty_and_clashing(spark):
    assert licenses.scan(spark.createDataFrame([], FILES)).count() == 0
    df = spark.createDataFrame(TREE, FILES).withColumns({n: F.lit("x") for n in ("h", "dir", "kind", "no_id", "term", "part")})
    assert found(df) == brute(TREE)
