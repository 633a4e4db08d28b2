import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chartloom.llm import splitting

ROW = "chunk_id BIGINT, profile STRING, text STRING, start_char INT"
LIMITS = "profile STRING, max_chars INT, overlap_chars INT, min_chunk_chars INT"


def split(spark, rows, limits):
    df = splitting.split(spark.createDataFrame(rows, ROW), spark.createDataFrame(limits, LIMITS), "chunk_id", "profile", "text", "start_char")
    out = {}
    for r in df.orderBy("chunk_id", "piece_no").collect():
        out.setdefault(r.chunk_id, []).append(r)
    return out


def sound(pieces, text, most, overlap, start):
    done = 0
    for i, p in enumerate(pieces):
        assert p.text == text[p.piece_start : p.piece_end] and 0 < len(p.text) <= most and p.n_pieces == len(pieces)
        assert p.piece_start == (done - overlap if i else 0)
        assert p.start_char == (None if start is None else start + p.piece_start)
        done = p.piece_end
    assert done == len(text) and (len(pieces) > 1) == (len(text) > most)


TEXTS = ["word " * 400, "x" * 1500, "One sentence here. " * 90, "line\n" * 300, "para\n\n" * 250, "é🙂́" * 500, "\r\n" * 700, " " * 1200, "a" * 99 + "\n\n" + "b" * 901]


@pytest.mark.parametrize(("most", "overlap", "least"), [(100, 10, 20), (100, 0, 1), (101, 80, 500), (2, 1, 1), (1000, 100, 900)])
def test_pieces_are_sound(spark, most, overlap, least):
    rows = [(i, "p", t, None if i % 3 == 0 else i * 7) for i, t in enumerate(TEXTS)]
    got = split(spark, rows, [("p", most, overlap, least)])
    for i, _, t, start in rows:
        sound(got[i], t, most, min(overlap, most // 2), start)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="ab. \n\r🙂é,", min_size=1, max_size=90), min_size=1, max_size=6), st.integers(2, 40), st.integers(0, 30))
def test_any_text(spark, texts, most, overlap):
    got = split(spark, [(i, "p", t, i) for i, t in enumerate(texts)], [("p", most, overlap, 1)])
    for i, t in enumerate(texts):
        sound(got[i], t, most, min(overlap, most // 2), i)


def test_strongest_boundary_is_taken(spark):
    first = lambda t: split(spark, [(1, "p", t, 0)], [("p", 40, 0, 5)])[1][0].text
    assert first("aaaa bbbb.\n\ncccc dddd. eeee ffff gggg hhhh iiii jjjj") == "aaaa bbbb.\n\n"
    assert first("aaaa bbbb\ncccc dddd. eeee ffff gggg hhhh iiii jjjj") == "aaaa bbbb\n"
    assert first("aaaa bbbb cccc. dddd, eeee ffff gggg hhhh iiii jjjj") == "aaaa bbbb cccc. "
    assert first("aaaa bbbb cccc, dddd eeee ffff gggg hhhh iiii jjjj") == "aaaa bbbb cccc, "
    assert first("aaaa bbbb cccc dddd eeee ffff gggg hhhh iiii jjjj") == "aaaa bbbb cccc dddd eeee ffff gggg hhhh "
    assert first("x" * 39 + "é" + "y" * 40) == "x" * 39


def test_null_empty_unknown_and_repeated(spark):
    rows = [(1, "p", None, 0), (2, "p", "", 0), (3, "?", "x" * 99, 0), (4, None, "x", 0), (5, "p", "abcdef", 3), (5, "p", "abcdef", 3), (6, "q", "x", 0)]
    got = split(spark, rows, [("p", 4, None, None), ("q", None, 1, 1), ("p", 4, None, None), (None, 5, 1, 1), ("r", 1, 0, 0)])
    assert {k: [r.text for r in v] for k, v in got.items()} == {5: ["abcd", "ef"]}
    assert split(spark, [], [("p", 4, 0, 1)]) == {}


def test_very_long_text(spark):
    text = "Some words make a sentence. " * 20_000
    got = split(spark, [(1, "p", text, 0)], [("p", 1000, 100, 200)])[1]
    sound(got, text, 1000, 100, 0)
