"""Every query with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from chartloom import queries, reference_queries


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list):
        return tuple(map(plain, v))
    return float(v) if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = duck.execute(queries.SQL[name])
    at = [[c[0] for c in want.description].index(c) for c in columns]
    assert len(want.description) == len(columns)
    rows = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == rows


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_others_run(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert reference_queries and entry.entry(spark).columns[0] == "event_id"
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_imports_llm():
    root = Path(queries.__file__).parent
    outside = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert not [p for p in outside if "chartloom.llm" in p.read_text()]


def test_order_of_input_does_not_matter(spark, sf):
    rows = reference_queries.chronology_rows(spark, sf)
    once = reference_queries.chronology.processed(rows, ["case_id"]).select("seq", "source").collect()
    again = reference_queries.chronology.processed(rows.repartition(7).orderBy("occurrence"), ["case_id"]).select("seq", "source").collect()
    assert sorted(map(tuple, once)) == sorted(map(tuple, again))


def test_pages_hold_the_texts_of_all_their_events(spark):
    rows = [(*r, None, None, None) for r in (("c", 1, "b knee"), ("c", 1, "a back"), ("c", 1, "a back"), ("c", 2, "d"), ("c", 3, None), ("c", None, "e"))]
    rows.append(("c", 4, "f", "2024-01-05", "Dr. A|B", "Clinic"))
    got = {r.page: r.text for r in reference_queries.event_pages(spark.createDataFrame(rows, "case_id STRING, source_page INT, source_text STRING, date STRING, provider STRING, location STRING")).collect()}
    assert got.pop(4) == "Seen on 01/05/2024 | provider: Dr. A B | facility: Clinic | f"
    assert set(got) == {1, 2} and got[1].index("a back") < got[1].index("b knee") and got[1].count("a back") == 1
