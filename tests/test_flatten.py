import json

from chartloom.operators import flatten

LISTS = ("m.filings", "m.filings.decisions")


def emitted(spark, rows, schema="id BIGINT, j STRING"):
    return flatten.once(flatten.emit(spark.createDataFrame(rows, schema), "id", "j", LISTS, ("raw",)))


def test_children_know_their_parents(spark):
    record = {"m": {"name": "n", "office": {"city": "c"}, "filings": [{"t": "a", "decisions": [{"level": "1"}, None, {"level": "2"}]}, None, {"t": "b", "decisions": {"level": "3"}}]}}
    rows = emitted(spark, [(7, json.dumps(record))]).collect()
    decisions = sorted((r.parent_position, r.position, json.loads(r.payload)["level"]) for r in rows if r.tag == "m.filings.decisions")
    assert decisions == [(0, 0, "1"), (0, 2, "2"), (2, 0, "3")]
    keys = {r.pk for r in rows}
    assert all(r.parent_pk in keys for r in rows if r.tag != flatten.ROOT)
    assert json.loads(next(r.payload for r in rows if r.tag == flatten.ROOT)) == {"m.name": "n", "m.office.city": "c"}


def test_what_is_no_object_has_no_rows(spark):
    rows = [(1, None), (2, ""), (3, "[]"), (4, "null"), (5, '{"a": [{"b": 1'), (6, '{"a": NaN}'), (7, "{" * 50_000), (None, '{"a": 1}'), (8, "[" * 200_000 + "{")]
    assert emitted(spark, rows).count() == 0


def test_odd_shapes_and_repeats(spark):
    text = json.dumps({"m": {"filings": {"decisions": []}}, "raw": json.dumps({"x": [{"y": 1}, 2]}), "bad": "\ud800", "\ud801": [{"z": 1}]})
    rows = emitted(spark, [(1, text), (1, text)]).collect()
    assert sorted(r.tag for r in rows) == sorted([flatten.ROOT, "m.filings", "raw.x", "raw.x", "?"])
    assert [json.loads(r.payload) for r in rows if r.tag == "raw.x" and r.position == 1] == [{"value": 2}]


def test_raw_text_that_does_not_parse_stays_a_value(spark):
    row = emitted(spark, [(1, json.dumps({"raw": "{broken"}))]).first()
    assert json.loads(row.payload) == {"raw": None}


def test_schema_of_a_table_and_partitions(spark, tmp_path):
    df = emitted(spark, [(1, json.dumps({"m": {"filings": [{"t": "a", "n": 2}]}}))])
    flatten.write_tables(df, str(tmp_path / "t"))
    back = flatten.table_of(spark.read.parquet(str(tmp_path / "t")), "m.filings", "t STRING, n INT").first()
    assert (back.record_id, back.t, back.n, back.position) == (1, "a", 2, 0)


def test_empty_table_and_clashing_names(spark):
    assert emitted(spark, []).count() == 0
    df = spark.createDataFrame([(1, '{"a": 1}', "t", "p")], "id INT, j STRING, tag STRING, _id STRING")
    assert flatten.emit(df, "id", "j").select("record_id", "tag").first() == (1, flatten.ROOT)


def test_records_too_deep_are_reported(spark):
    deep = '{"a": ' * 200_000 + "1" + "}" * 200_000
    rows = [(1, '{"x": [{"y": 1}]}'), (2, deep), (3, "{cut"), (4, '{"m": ' + json.dumps(deep) + "}")]
    got = {(r.record_id, r.tag) for r in flatten.emit(spark.createDataFrame(rows, "id BIGINT, j STRING"), "id", "j", (), ("m",)).collect()}
    assert got == {(1, "record"), (1, "x"), (2, flatten.UNREAD), (4, flatten.UNREAD)}


def test_records_delivered_again(spark):
    rows = [(1, '{"x": [{"y": 1}]}'), (1, '{"x": [{"y": 1}]}'), (2, '{"x": [{"y": 2}]}'), (3, None), (3, '{"x": [{"y": 3}]}'), (None, '{"x": 1}'), (None, '{"x": 1}')]
    df = spark.createDataFrame(rows, "id BIGINT, j STRING")
    got = sorted((r.record_id, r.tag) for r in flatten.emit_once(df, "id", "j").collect())
    assert got == [(i, t) for i in (1, 2, 3) for t in ("record", "x")]
    assert flatten.emit_once(df.limit(0), "id", "j").count() == 0
