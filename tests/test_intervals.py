import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chartloom.operators import intervals

SCHEMA = "k STRING, a INT, b INT"


def by_pages(rows):
    """Page by page: what the sweep must find."""
    pages = {}
    for k, a, b in rows:
        if a is not None and b is not None and a <= b:
            pages.setdefault(k, set()).update(range(a, b + 1))
    out = set()
    for k, covered in pages.items():
        for kind, wanted in (("period", True), ("gap", False)):
            start = None
            for p in range(min(covered), max(covered) + 2):
                inside = (p in covered) == wanted and p <= max(covered)
                if inside and start is None:
                    start = p
                elif not inside and start is not None:
                    out.add((k, kind, start, p - 1))
                    start = None
    return out


def swept(spark, rows, slices=4):
    spark.conf.set("spark.sql.shuffle.partitions", str(slices))
    try:
        return {tuple(r) for r in intervals.sweep(spark.createDataFrame(rows, SCHEMA), "k", "a", "b").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_overlaps_nests_touches_and_gaps(spark):
    rows = [("x", 1, 9), ("x", 3, 4), ("x", 10, 12), ("x", 20, 20), ("x", 20, 20), ("y", 5, 1), ("y", None, 3), ("y", 2, None), (None, 7, 8), (None, 7, 8)]
    assert swept(spark, rows) == {("x", "period", 1, 12), ("x", "gap", 13, 19), ("x", "period", 20, 20), (None, "period", 7, 8)}


def test_empty_table(spark):
    assert swept(spark, []) == set()


def test_greatest_page_does_not_overflow(spark):
    assert swept(spark, [("x", 2**31 - 2, 2**31 - 1)]) == {("x", "period", 2**31 - 2, 2**31 - 1)}


def test_other_columns_may_clash(spark):
    df = spark.createDataFrame([("x", 1, 2, 3, "u")], "k STRING, a INT, b INT, _at INT, kind STRING")
    assert [tuple(r) for r in intervals.sweep(df, "k", "a", "b").collect()] == [("x", "period", 1, 2)]


@pytest.mark.parametrize("seed", range(3))
def test_hot_key_over_many_slices(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("xxxxyz"), s, s + rng.randrange(0, 6)) for s in (rng.randrange(1, 900) for _ in range(150))]
    assert swept(spark, rows, slices=40) == by_pages(rows)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("xy"), st.integers(-5, 30), st.integers(-5, 30)), max_size=12))
def test_against_pages(spark, rows):
    assert swept(spark, rows, slices=7) == by_pages(rows)
