"""Extraction by a provider: any callable that turns a chunk of text, or page images, into a response."""

from __future__ import annotations

import json
import re
import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESPONSES = "exhibit_id STRING, chunk_index INT, response STRING, attempts INT, error STRING"

# Kinds of errors, and words in an error, that make a repeated call worthwhile.
PASSING_KINDS = (
    "ThrottlingException", "ServiceUnavailableException", "InternalServerException", "ModelTimeoutException",
    "ProvisionedThroughputExceededException", "ReadTimeoutError", "ConnectTimeoutError",
)
PASSING_WORDS = ("throttl", "rate limit", "too many requests", "capacity", "timeout")


class Provider(Protocol):
    """One instance lives in each Python worker; it is pickled to get there."""

    def generate(self, prompt: str) -> str: ...


class VisionProvider(Protocol):
    """A provider that reads images of pages."""

    def generate_with_vision(self, prompt: str, images: list[bytes]) -> str: ...


@dataclass
class RuleProvider:
    """Deterministic stand-in that reads dates, what names a provider and a facility behind them, and the text up
    to the next date; for tests and offline runs."""

    pattern: str = r"\b(\d{1,2}/\d{1,2}/\d{4})\b(?: \| provider: (?P<provider>[^|\n]*?))?(?: \| facility: (?P<facility>[^|\n]*?))?(?: \| |(?=\W|$))"

    def generate(self, prompt: str) -> str:
        hits = list(re.finditer(self.pattern, prompt))
        ends = [h.start() for h in hits[1:]] + [len(prompt)]
        found = []
        for hit, end in zip(hits, ends):
            named = {k: v.strip() for k, v in hit.groupdict().items() if v and v.strip()}
            found.append({"date": hit[1], "visit_type": "office_visit", **named, "occurrence_treatment": {"findings": " ".join(prompt[hit.end() : end].split())}})
        return json.dumps({"entries": found})


@dataclass
class Pace:
    """At most ``most`` calls in ``seconds``: a sliding window of one worker. A cluster-wide rate is this one
    divided by the partitions that run at once."""

    most: int = 50
    seconds: float = 60.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    calls: deque = field(default_factory=deque)

    def take(self) -> None:
        while True:
            now = self.clock()
            while self.calls and self.calls[0] <= now - self.seconds:
                self.calls.popleft()
            if len(self.calls) < self.most:
                self.calls.append(now)
                return
            self.sleep(self.calls[0] + self.seconds - now)


def worth_repeating(error: Exception, kinds: tuple[str, ...] = PASSING_KINDS) -> bool:
    """By the error's class, by words of its message, or by the code that a client's error carries."""
    said = str(error).lower()
    answer = getattr(error, "response", None)
    code = (answer.get("Error") or {}).get("Code", "") if isinstance(answer, dict) else ""
    return type(error).__name__ in kinds or any(word in said for word in PASSING_WORDS) or code in kinds


def repeated(call: Callable[[], str], repeats: int = 5, base: float = 1.0, factor: float = 2.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, int, str | None]:
    """(response, attempts, error). Errors that pass are repeated after growing delays; others end the call."""
    for attempt in range(repeats + 1):
        try:
            return call(), attempt + 1, None
        except Exception as error:  # noqa: BLE001  a provider may raise anything; the row carries it on
            if attempt == repeats or not worth_repeating(error):
                return None, attempt + 1, f"{type(error).__name__}: {error}"
            sleep(min(base * factor**attempt, most))
    raise AssertionError


def called(provider: Provider, prompt: str, *settings, **named) -> tuple[str | None, int, str | None]:  # noqa: ANN002, ANN003
    """``repeated`` for a prompt."""
    return repeated(lambda: provider.generate(prompt), *settings, **named)


def extract(chunks: DataFrame, provider: Provider, key: str = "exhibit_id", per_worker: int | None = 50, repeats: int = 5) -> DataFrame:
    """Responses of a provider for chunks (key, chunk_index, text): one row for each, with ``error`` set where
    the call failed, so that one chunk's failure costs no other. The result should be written before it is
    branched: reading it twice would call twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pace = Pace(per_worker) if per_worker else None
        for batch in batches:
            out: list[list] = [[], [], []]
            for text in batch.column(2).to_pylist():
                if pace:
                    pace.take()
                for column, x in zip(out, called(provider, text or "", repeats)):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string())], names=["exhibit_id", "chunk_index", "response", "attempts", "error"])

    return chunks.select(F.col(key).cast("string"), F.col("chunk_index").cast("int"), "text").mapInArrow(run, RESPONSES)


VISION_PROMPT = "Extract the medical entries of these {page_count} page images of exhibit {exhibit_id}, pages {page_nums}. Answer with a JSON array."


def filled(template: str, **members: object) -> str:
    """A prompt with its named places filled; braces of other text, as in JSON examples, stay."""
    for name, value in members.items():
        template = template.replace(f"{{{name}}}", str(value))
    return template


def extract_images(batches_: DataFrame, provider: VisionProvider, prompt: str = VISION_PROMPT, per_worker: int | None = 50, repeats: int = 5) -> DataFrame:
    """Responses for batches of page images (exhibit_id, batch, pages ARRAY<INT>, images ARRAY<BINARY>): as ``extract``,
    a row for each batch, so that one that fails costs no other. Batches without images are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pace = Pace(per_worker) if per_worker else None
        for batch in batches:
            out: list[list] = [[], [], []]
            for exhibit, pages, images in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                if pace:
                    pace.take()
                said = filled(prompt, page_count=len(images), exhibit_id=exhibit, page_nums=pages)
                for column, x in zip(out, repeated(lambda: provider.generate_with_vision(said, images), repeats)):  # noqa: B023
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string())], names=["exhibit_id", "chunk_index", "response", "attempts", "error"])

    rows = batches_.where("size(images) > 0").select("exhibit_id", F.col("batch").cast("int"), "pages", "images")
    return rows.mapInArrow(run, RESPONSES)
