"""What travels while token sets are compared, and that all pairs are found."""

from __future__ import annotations

import random
import re

from compare import rows

from inkwell.operators import preferences


def test_no_set_travels_beside_its_tokens(spark):
    sets = spark.createDataFrame([(1, ["x", "y"])], "k int, tokens array<string>")
    held = spark.createDataFrame([(1, ["x", "y"])], "ref int, tokens array<string>")
    for cut in (0.4, 0.8):
        found = preferences.overlapping(sets, held, "tokens", key="k", threshold=cut)
        arrays = {f"{name}#{i}" for name, i in re.findall(r"(\w+)#(\d+)", found._jdf.queryExecution().analyzed().toString()) if name in ("a", "b", "tokens", "by")}
        beside = re.findall(r"Generate explode\(.*\), \[([^\]]*)\], (?:true|false), \[", found._jdf.queryExecution().executedPlan().toString())
        assert beside and arrays and not [x for x in beside if set(x.split(", ")) & arrays]


def test_sets_of_one_key_are_compared_apart(spark):
    rng = random.Random(6)
    draw = lambda n, keys: [(i % keys, rng.sample("abcdefghijkl", rng.randint(0, 7))) for i in range(n)]
    a, b = draw(80, 31), draw(40, 17)
    left, right = spark.createDataFrame(a, "k int, tokens array<string>"), spark.createDataFrame(b, "ref int, tokens array<string>")
    for cut in (0.2, 0.4, 0.5, 0.6, 1.0):
        for least in (1, 4):
            want = sorted({k for k, x in a for _, y in b if min(len(x), len(y)) >= least and len({*x} & {*y}) / min(len(x), len(y)) >= cut})
            assert [k for (k,) in rows(preferences.overlapping(left, right, "tokens", key="k", threshold=cut, least=least), "k")] == want
