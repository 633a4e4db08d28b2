import json

import pytest
from pyspark.sql import functions as F

from chartloom.operators import chunks, repair


def read(spark, *responses):
    df = spark.createDataFrame(list(enumerate(responses)), "id INT, r STRING")
    out = {}
    for row in repair.entries(df, "id", "r").orderBy("id", "seq").collect():
        out.setdefault(row.id, []).append(json.loads(row.entry))
    return [out.get(i, []) for i in range(len(responses))]


def test_responses(spark):
    one = '{"date": "01/15/2024", "x": {"y": 1}}'
    got = read(spark, f"[{one}]", f"```json\n[{one}]\n```", f'[{one}, {{"date": "01/16/20', f'{{"entries": [{one}, null, 3]}}', "", "No data found.", None, one, "[]", f"text ```\n{one}", '{"entries": {"date": "d"}}')
    assert [len(x) for x in got] == [1, 1, 1, 1, 0, 0, 0, 1, 0, 1, 1]
    assert got[2][0]["date"] == "01/15/2024"


@pytest.mark.parametrize(("text", "dates"), [('[{"date": "a", "b": [1, {"c": {"d": [2', ["a"]), ('{"date": "a", "b": "cut he', ["a"]), ('{"entries": [{"date": "a", "n": [{"x": [1]}]}, {"da', ["a", None]), ("{", []), ('"', []), ("]]]]", [])])
def test_salvage(text, dates):
    found = repair.salvaged(text)
    assert [x.get("date") for x in found][: len(dates)] == dates[: len(found)]
    assert bool(found) == bool(dates)


@pytest.mark.parametrize(("text", "value"), [
    ('{"a": 1, "b": [1, {"c": "x, y", "d', {"a": 1, "b": [1, {"c": "x, y"}]}), ('{"a": {"b": 1}, "c": ', {"a": {"b": 1}}), ('{"a": 1,, "b": 2}', {"a": 1}), ('[{"a": tru', [{}]), ("", None), ("{", {}), ("nothing", None),
    ("[" + ", ".join(f'{{"n": {i}}}' for i in range(3_000)) + ", {\"n\": bad}, {}]", [{"n": i} for i in range(3_000)] + [{}]),
])
def test_mended(text, value):
    assert repair.mended(text) == value


@pytest.mark.parametrize(("answer", "value"), [
    ('{"a": 1}', {"a": 1}), ('Here:\n```json\n{"a": 1}\n```\nDone {x}', {"a": 1}), ('```\n{"a": 1}', {"a": 1}), ('So {"a": 1} it is', {"a": 1}), ('{"a": [{"b": 1}, {"b": 2', {"a": [{"b": 1}, {"b": 2}]}), ("[1]", {}), (None, {}), ("", {}), ("none", {}),
])
def test_determination(answer, value):
    assert repair.determination(answer) == value


def test_determination_rows(spark):
    rows = [(1, '{"a": 1}'), (2, 'is {"a": 2} so'), (3, None), (4, "x"), (4, "x")]
    got = repair.determinations(spark.createDataFrame(rows, "id INT, j STRING"), "id", "j").collect()
    assert sorted((r.id, json.loads(r.j).get("a")) for r in got if r.id < 4) == [(1, 1), (2, 2), (3, None)] and len(got) == 5


def test_determinations(spark):
    nested = json.dumps({"case_metadata": {"claimant_name": "n", "alleged_onset_date": "d"}, "raw_fields": {"medical_impairments": [{}, {}]}})
    rows = [(1, nested), (2, json.dumps({"claimant_name": "m", "medical_impairments": {"a": 1}})), (3, "{cut"), (4, None), (5, "[]")]
    got = {r.id: r for r in repair.normalized(spark.createDataFrame(rows, "id INT, j STRING"), "id", "j").collect()}
    assert {i: (r.claimant_name, r.nested, r.impairments, round(r.confidence, 1)) for i, r in got.items()} == {1: ("n", True, 2, 0.4), 2: ("m", False, 1, 0.2)}
    both = spark.createDataFrame([(1, json.dumps({"date_of_birth": "", "case_metadata": {"date_of_birth": "x", "claim_type": "", "protective_filing_date": 0}, "claim_type": "y"}))], "id INT, j STRING")
    assert repair.normalized(both, "id", "j").first().confidence == 0.4
    lifts = spark.createDataFrame([("50 pounds",), ('{"max": 20}',), ("10",), ("x",), (None,)], "l STRING")
    assert [r[0] for r in lifts.select(repair.exertional_capacity(F.col("l"))).collect()] == ["Medium", "Light", "Sedentary", "Unknown", "Unknown"]


def test_chunk_spans():
    a = "a" * 250
    assert chunks.spans(a, 100, 10, 50) == [(0, 100), (90, 190), (180, 250), (240, 250)]
    assert chunks.spans(a, 100, 10, 50, tail=False) == [(0, 100), (90, 190), (180, 250)]
    assert chunks.spans("a" * 200, 100, 10, 50) == [(0, 100), (90, 190), (180, 200)]
    assert chunks.spans("a" * 200, 100, 20, 30) == [(0, 100), (80, 180), (160, 200), (190, 200)]
    assert chunks.spans("", 100, 10, 50) == [] and chunks.spans("abc", 100, 10, 50) == [(0, 3)]


def test_chunk_rows(spark):
    df = spark.createDataFrame([(1, "x " * 120), (2, None), (3, ""), (4, "é🙂")], "id INT, t STRING")
    got = chunks.chunked(df, "id", "t", 100, 10, 20).orderBy("id", "chunk_index").collect()
    assert {r.id for r in got} == {1, 4} and [r.is_continuation for r in got if r.id == 1][:2] == [False, True]
    assert all(len(r.text) == r.end_char - r.start_char for r in got)
