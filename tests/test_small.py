import pytest

from chartloom.operators import small


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_one_row_of_each_key(spark, monkeypatch, most):
    monkeypatch.setattr(small, "if_small", lambda df, rows: df if most == 0 else small.F.broadcast(df))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "n"), (None, "n"), (3, "c")], "k INT, t STRING")
    got = sorted(map(str, small.without_repeats(df, "k").collect()))
    assert got == sorted(["Row(k=1, t='a')", "Row(k=2, t='b')", "Row(k=3, t='c')", "Row(k=None, t='n')"])
    assert small.without_repeats(df.limit(0), "k").count() == 0
