import random

import pytest

from chartloom.operators import prefix


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_values_of_hot_and_null_keys(spark, inclusive):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), n, rng.choice([None, 1, 2, 5])) for n in range(600)]
    rng.shuffle(rows)
    df = prefix.sliced(spark.createDataFrame(rows, "k STRING, n INT, v INT"), ["k"], ["n"])
    assert df.where("k = 'hot'").select(prefix.SLICE).distinct().count() > 1
    got = {(r.k, r.n): (r.s, r.lo, r.hi) for r in prefix.running(df, ["k"], ["n"], {"s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v")}, inclusive).collect()}
    for k, n, v in rows:
        before = [x for kk, m, x in rows if kk == k and (m < n or inclusive and m == n) and x is not None]
        assert got[k, n] == ((sum(before), min(before), max(before)) if before else (None, None, None))


def test_places(spark):
    df = spark.createDataFrame([("a", i % 7, i) for i in range(50)] + [("b", 0, 0)], "k STRING, x INT, y INT")
    got = {(r.k, r.x, r.y): r._n for r in prefix.numbered(df, ["k"], ["x", "y"]).collect()}
    order = sorted((i % 7, i) for i in range(50))
    assert got == {("a", *o): n for n, o in enumerate(order, 1)} | {("b", 0, 0): 1}
    assert prefix.numbered(df.limit(0), ["k"], ["x", "y"]).columns == ["k", "x", "y", "_n"]
