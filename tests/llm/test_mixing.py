from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chartloom.llm import bpe, mixing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=6))
def test_schedule_keeps_every_share_within_a_block(counts):
    blocks = {f"s{i}": n for i, n in enumerate(counts)}
    total, done = sum(counts), dict.fromkeys(blocks, 0)
    slots = mixing.schedule(blocks)
    assert len(slots) == total
    for t, (name, k) in enumerate(slots, 1):
        assert k == done[name]
        done[name] += 1
        assert all(abs(done[s] - Fraction(t * n, total)) < 1 for s, n in blocks.items())


def test_quotas_of_small_sources():
    make = lambda n, share, repeats, size: mixing.Source(n, share, repeats, size)
    got = {s.name: s.quota for s in mixing.quotas([make("a", 0.5, 2, 100), make("b", 0.5, 2, 900)])}
    assert got == {"a": 200.0, "b": 800.0}
    got = {s.name: s.quota for s in mixing.quotas([make("a", 0.2, 1, 100), make("b", 0.8, 1, 50), make("c", 0.0, 9, 50), make("d", 0.3, 3, 0)], 1000)}
    assert got == {"a": 100.0, "b": 50.0, "c": 0.0, "d": 0.0}
    assert mixing.quotas([]) == []


DOC = "doc_id BIGINT, text STRING, source STRING"


@pytest.fixture(scope="module")
def mixed(spark):
    docs = spark.createDataFrame([(i, "word " * (1 + i % 17), "big" if i % 10 else "small") for i in range(600)] + [(9000, None, "big"), (9001, "", "big"), (None, "x", "big"), (1, "word word", "big"), (9002, "y", None), (9003, "y", "other")], DOC)
    aims = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3), ("absent", 0.2, 2), (None, 0.3, 1), ("big", 0.1, 9)], "source STRING, target_share DOUBLE, max_repeats INT")
    m, report = mixing.mix(docs, aims, "doc_id", "text", "source", blocks=50)
    return m.toPandas(), {r.source: r for r in report.collect()}


def test_shares_and_repeats(mixed):
    rows, report = mixed
    assert set(rows.source) == {"big", "small"}
    assert rows.groupby(["source", "doc_id"]).size().groupby("source").max().to_dict() == {"big": 1, "small": 3}
    assert not rows.duplicated(["doc_id", "repeat_no"]).any()
    small, big = report["small"], report["big"]
    assert small.too_small and small.mixed_tokens == 3 * small.available_tokens and report["absent"].too_small
    assert abs(big.mixed_tokens + small.mixed_tokens - (big.available_tokens + small.available_tokens)) < 40
    assert abs(big.actual_share - big.mixed_tokens / (big.mixed_tokens + small.mixed_tokens)) < 1e-12
    assert report["absent"].mixed_tokens == 0 and big.max_repeats == 1


def test_interleaving(mixed):
    rows, report = mixed
    ordered = rows.sort_values(["slot", "offset"])
    total, part, worst = ordered.tokens.sum(), {s: 0 for s in report}, 0.0
    quota = {s: report[s].mixed_tokens / total for s in report}
    done = 0
    for r in ordered.itertuples():
        part[r.source] += r.tokens
        done += r.tokens
        worst = max(worst, *(abs(part[s] - quota[s] * done) for s in quota))
    assert worst < 2.5 * total / 50 + 40


def test_target_reached_within_half_a_document(spark):
    docs = spark.createDataFrame([(i, "word " * 10, f"s{i % 2}") for i in range(400)], DOC)
    aims = spark.createDataFrame([("s0", 0.75, 4), ("s1", 0.25, 4)], "source STRING, target_share DOUBLE, max_repeats INT")
    _, report = mixing.mix(docs, aims, "doc_id", "text", "source", total=3000.0)
    got = {r.source: r.mixed_tokens for r in report.collect()}
    size = len(bpe.Vocabulary(f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}").encode("word " * 10))
    assert abs(got["s0"] - 2250) <= size / 2 and abs(got["s1"] - 750) <= size / 2


def test_same_seed_same_mix_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, "a b c", "s") for i in range(30)], DOC)
    aims = spark.createDataFrame([("s", 1.0, 1)], "source STRING, target_share DOUBLE, max_repeats INT")
    one = [tuple(r) for r in mixing.mix(docs, aims, "doc_id", "text", "source", total=40.0)[0].orderBy("slot", "offset").collect()]
    two = [tuple(r) for r in mixing.mix(docs.repartition(5), aims, "doc_id", "text", "source", total=40.0)[0].orderBy("slot", "offset").collect()]
    assert one == two
    m, report = mixing.mix(docs.limit(0), aims, "doc_id", "text", "source")
    assert m.count() == 0 and report.first().mixed_tokens == 0
    assert mixing.mix(docs, aims.limit(0), "doc_id", "text", "source")[0].count() == 0
