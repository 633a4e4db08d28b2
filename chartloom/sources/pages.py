"""Pages of files as rows, by a pluggable decoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

PAGES = "path STRING, page INT, text STRING, image BINARY, content_type STRING"
Decoder = Callable[[bytes], Iterator[tuple[int, str | None, bytes | None]]]


def form_feed_decoder(content: bytes) -> Iterator[tuple[int, str | None, bytes | None]]:
    """Plain text whose pages end with form feeds."""
    for n, page in enumerate(content.decode("utf-8", "replace").split("\f"), 1):
        yield n, page, None


def missing_decoder(content: bytes) -> Iterator[tuple[int, str | None, bytes | None]]:
    raise RuntimeError("no decoder for this kind of file is installed; pass one that yields (page, text, image)")


def read_pages(spark: SparkSession, path: str, decoder: Decoder = missing_decoder, first: int | None = None, last: int | None = None) -> DataFrame:
    """A row for each page of the files under a path or glob, first to last inclusive and counted from 1."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            rows = [(p, n, text, image, "image" if image is not None else "text") for p, content in zip(frame["path"], frame["content"]) for n, text, image in decoder(content) if (first is None or n >= first) and (last is None or n <= last)]
            yield pd.DataFrame(rows, columns=["path", "page", "text", "image", "content_type"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, PAGES)
