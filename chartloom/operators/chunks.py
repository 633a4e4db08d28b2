"""Overlapping chunks of long texts for extraction."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How far back from the limit a boundary is looked for.
LOOK_BACK = 2_000
_BOUNDARIES = ((re.compile(r"\n\n+"), "end"), (re.compile(r"\n[A-Z][A-Z\s]{2,}:"), "header"), (re.compile(r"[.!?]\s+"), "end"), (re.compile(r"\n"), "end"), (re.compile(r"\s"), "end"))


def spans(text: str, most: int, overlap: int, least: int, tail: bool = True) -> list[tuple[int, int]]:
    """(start, end) of the chunks: each ends at the last blank line, heading, sentence, line or word before the
    limit, the next starts ``overlap`` before that end but ``least`` after the last start. Without ``tail``
    a last chunk that only repeats the overlap is left out."""
    if len(text) <= most:
        return [(0, len(text))] if text else []
    found, start = [], 0
    while start < len(text):
        end = min(start + most, len(text))
        if end < len(text):
            begin = max(start, end - LOOK_BACK)
            window = text[begin:end]
            for pattern, kind in _BOUNDARIES:
                last = None
                for last in pattern.finditer(window):
                    pass
                if last is not None:
                    end = begin + (last.start() + 1 if kind == "header" else last.end())
                    break
        found.append((start, end))
        start = max(end - overlap, start + least)
    if not tail:
        while len(found) > 1 and found[-1][1] <= found[-2][1]:
            found.pop()
    return found


def chunked(df: DataFrame, key: str, text: str, most: int = 40_000, overlap: int = 500, least: int = 1_000, tail: bool = True) -> DataFrame:
    """(key, chunk_index, total_chunks, start_char, end_char, is_continuation, text) of every text; null and empty ones give none."""
    kind = df.schema[key].dataType.simpleString()
    names = [key, "chunk_index", "total_chunks", "start_char", "end_char", "is_continuation", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                cuts = spans(t or "", most, overlap, least, tail)
                for n, (a, b) in enumerate(cuts):
                    at.append(i)
                    rows.append((n, len(cuts), a, b, n > 0, t[a:b]))
            types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
            columns = zip(*rows) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, ty) for c, ty in zip(columns, types))], names=names)

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, f"`{key}` {kind}, chunk_index INT, total_chunks INT, start_char INT, end_char INT, is_continuation BOOLEAN, text STRING")
