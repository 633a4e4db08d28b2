from pathlib import Path

import duckdb
import pytest

from chartloom.llm import queries

COLUMNS = {"p1_found": ["field", "record_id", "kind", "start_char"], "p2_found": ["event_id_a", "event_id_b"], "p3_found": ["entity_id", "spelling"], "p6_found": ["chunk_id"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs_without_repeats(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = [str(r) for r in df.collect()]
    assert rows and len(rows) == len(set(rows))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = sorted(con.execute(queries.SQL[name]).fetchall())
    assert sorted(tuple(r) for r in queries.QUERIES[name](spark, sf).collect()) == want
