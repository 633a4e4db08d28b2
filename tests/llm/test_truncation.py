import random

import numpy as np
import pyarrow as pa
import pytest

from chartloom.llm import truncation
from chartloom.session import table

DOC = "doc_id BIGINT, source STRING, text STRING"


@pytest.fixture(scope="module")
def whole(spark, sf):
    """Texts of the test tables that end with a sentence."""
    rows = table(spark, "/root/testdata/sf0.01", "documents").select("source", "text").where(r"text rlike '[a-z][.]$' and length(text) > 200").collect()
    return [r.text for r in rows][:450]


@pytest.fixture(scope="module")
def judged(spark, whole):
    """Every fifth text cut at a random place, some of those with a mark behind; labels known."""
    rng = random.Random(11)
    rows, cut = [], set()
    for i, text in enumerate(whole):
        if i % 5 == 0:
            at = rng.randrange(len(text) // 2, len(text) - 2)
            if text[at - 1].isalpha() and text[at].isalpha():
                cut.add(i)
                text = text[:at] + rng.choice(["", "", " …", "...", "�"])
        rows.append((i, f"s{i % 3}", text))
    found = truncation.truncated(spark.createDataFrame(rows, DOC), "doc_id", "source", "text").collect()
    return cut, {r.doc_id for r in found if r.truncated}, found


def test_cuts_within_words_are_found(judged):
    cut, found, _ = judged
    assert len(cut & found) / len(cut) >= 0.9
    assert len(found - cut) / max(len(found), 1) <= 0.05


def test_rates(judged, spark):
    cut, found, rows = judged
    got = {r.source: r for r in truncation.rates(spark.createDataFrame(rows), "source").collect()}
    assert sum(r.truncated for r in got.values()) == len(found) and sum(r.texts for r in got.values()) == len(rows)
    assert all(abs(r.rate - r.truncated / r.texts) < 1e-12 for r in got.values())


def test_copies_are_no_evidence(spark, whole):
    often, twice = (t[: next(i for i in range(len(t) // 2, len(t)) if t[i - 3 : i + 3].isalpha())] for t in (whole[0], whole[1]))
    rows = [(i, "s", t) for i, t in enumerate(whole[2:])] + [(1000 + i, "s", often) for i in range(len(whole) // 2)] + [(2000, "s", twice), (2001, "t", twice)]
    found = {r.doc_id: r for r in truncation.truncated(spark.createDataFrame(rows, DOC), "doc_id", "source", "text").collect()}
    alone = {r.doc_id: r for r in truncation.truncated(spark.createDataFrame([r for r in rows if r[0] <= 1000 or r[0] == 2000], DOC), "doc_id", "source", "text").collect()}
    assert len(found) == len(rows) and all(found[k].truncated == r.truncated for k, r in alone.items())
    assert alone[1000].truncated and alone[2000].truncated and all(r.truncated for k, r in found.items() if k >= 1000)


def test_stubs_that_occur_inside_texts(spark, whole):
    """In a large corpus the half of a word occurs too, here in six texts; against the whole word it stays rare."""
    rows = [(i, "s", f"{t} Note {i} says the therapist continued therapy with the therapist today.") for i, t in enumerate(whole * 20)]
    rows = [(i, s, t.replace("the therapist continued", "the therapis continued", 1) if i % 1500 == 7 else t) for i, s, t in rows]
    rows += [(90_000 + i, "s", f"{t} Note {i} says the therapis") for i, t in enumerate(whole[:4])]
    found = {r.doc_id: r for r in truncation.truncated(spark.createDataFrame(rows, DOC).repartition(4), "doc_id", "source", "text").where("doc_id >= 90000").collect()}
    assert len(found) == 4 and all(r.truncated and r.mid_word for r in found.values())


def test_words_are_handed_on_in_parts(spark, sf, monkeypatch):
    texts = [r.text for r in table(spark, sf, "documents").where("text <> ''").select("text").limit(60).collect()]
    batch = pa.RecordBatch.from_arrays([pa.array(texts * 10)], names=["text"])

    def counts():
        got = {}
        for b in truncation._counted(iter([batch]), np.full(1 << 10, (1 << 64) - 1, np.uint64)):
            for r in b.to_pylist():
                old = got.get((r["kind"], r["key"]), (0, 0, 0))
                got[r["kind"], r["key"]] = tuple(x + r[c] for x, c in zip(old, ("n", "ends", "stops")))
        return got

    at_once = counts()
    monkeypatch.setattr(truncation, "HELD_WORDS", 10)
    assert counts() == at_once and len(at_once) > 1_000


def test_marks():
    assert truncation.base("abc de …") == ("abc de", True) and truncation.base("abc�") == ("abc", True) and truncation.base("x [truncated]\n") == ("x", True)
    assert truncation.base("abc. \n") == ("abc.", False) and truncation.base("abc") == ("abc", False) and truncation.base(" … ")[0] == ""


def test_tokens():
    assert truncation.tokens("TSH 7.5 mg. Was") == ["tsh", "9", ".", "9", "mg", ".\x1e", "was"]
    assert truncation.tokens("ﬁle é") == ["file", "é"]


def test_limit_of_a_source(spark, whole):
    rows = [(i, "short", (t + " " + t)[:200]) for i, t in enumerate(whole[:60])] + [(1000 + i, "free", t) for i, t in enumerate(whole)]
    found = {r.doc_id: r for r in truncation.truncated(spark.createDataFrame(rows, DOC), "doc_id", "source", "text").collect()}
    assert all(found[i].at_limit for i in range(60)) and not any(r.at_limit for i, r in found.items() if i >= 1000)
    assert sum(found[i].truncated for i in range(60)) >= 50


def test_null_empty_odd_and_repeated(spark):
    rows = [(1, "a", None), (2, None, ""), (3, "a", " \n"), (4, None, "…"), (5, "a", "One."), (5, "a", "One."), (None, "a", "x"), (6, "a", "y" * 200_000), (7, "a", "🙂"), (8, "a", "�")]
    found = {r.doc_id: r.truncated for r in truncation.truncated(spark.createDataFrame(rows, DOC), "doc_id", "source", "text").collect()}
    assert found == dict.fromkeys(range(1, 9), False)
    assert truncation.truncated(spark.createDataFrame([], DOC), "doc_id", "source", "text").count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", "One.", 5, "x")], "doc_id BIGINT, source STRING, text STRING, n_chars INT, _key STRING")
    assert truncation.truncated(df, "doc_id", "source", "text").first().truncated is False
