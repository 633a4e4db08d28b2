"""Token ids of whole texts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies lie, on every machine.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

#: Fixed value: the pattern that the public vocabulary's description gives for splitting a text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same for this library: its \s also holds U+001C to U+001F, which are no white space to the public tokenizer.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORDS = regex.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^{_SPACE}\p{{L}}\p{{N}}]").replace(r"\S", rf"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")).findall
#: And for ASCII texts, which the faster library can split.
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+").findall

#: Words kept with their ids in a worker, and the longest that is kept. They bound memory, not results.
CACHED_WORDS = 200_000
CACHED_CHARS = 64

#: Words of more bytes are merged over a heap of ranks instead of by scans, whose time is quadratic.
SHORT = 128

NEVER = 1 << 31


class _Known(dict):
    """Ids of the words met so far."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.merge = vocabulary.merge

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = tuple(self.merge(word.encode("utf-8", "replace")))
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Vocabulary:
    """Ranks of byte strings; a token's id is its rank."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
        self.ids_of = _Known(self).__getitem__

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for null and empty. Strings of special tokens are ordinary text."""
        if not text:
            return []
        words = _ASCII_WORDS(text) if text.isascii() else _WORDS(text)
        return list(itertools.chain.from_iterable(map(self.ids_of, words)))

    def count(self, text: str | None) -> int:
        return len(self.encode(text))

    def merge(self, word: bytes) -> list[int]:
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        return self._scan(word) if len(word) <= SHORT else self._heap(word)

    def _scan(self, word: bytes) -> list[int]:
        """Contiguous rank array: part i spans starts[i] to starts[i + 1], and pairs[i] is the rank of
        parts i and i + 1 together. The least rank is found by a scan, its inner boundary deleted, and
        the two ranks beside it looked up anew, until no pair is in the vocabulary."""
        rank = self.ranks.get
        starts = list(range(len(word) + 1))
        pairs = [rank(word[i : i + 2], NEVER) for i in range(len(word) - 1)]
        while pairs:
            least = min(pairs)
            if least == NEVER:
                break
            i = pairs.index(least)
            del starts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = rank(word[starts[i] : starts[i + 2]], NEVER)
            if i:
                pairs[i - 1] = rank(word[starts[i - 1] : starts[i + 1]], NEVER)
        return [self.ranks[word[a:b]] for a, b in itertools.pairwise(starts)]

    def _heap(self, word: bytes) -> list[int]:
        """The same merges for long runs (base64, rules of dashes) in n log n time."""
        rank, n = self.ranks.get, len(word)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, middle, stop = heapq.heappop(heap)
            if not alive[i] or end[i] != middle or middle >= n or not alive[middle] or end[middle] != stop:
                continue
            alive[middle] = False
            end[i], after[i] = stop, after[middle]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank(word[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, stop, end[after[i]]))
            if before[i] >= 0 and (r := rank(word[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], i, stop))
        return [self.ranks[word[i : end[i]]] for i in range(n) if alive[i]]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Loaded once a worker."""
    return Vocabulary(path)


def encode(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, file: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row: one row for each row, in one pass without a shuffle.

    Null and empty texts give an empty list; a null key stays null; repeated rows stay repeated.
    Texts of any length are encoded whole. An empty table gives no rows.
    """
    path = str(Path(folder, file))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = [words.encode(x) for x in part.column(1).to_pylist()]
                offsets = pa.array(itertools.accumulate(map(len, lists), initial=0), pa.int32())
                values = pa.array(list(itertools.chain.from_iterable(lists)), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, values)], names=[key, "ids"])

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, f"`{key}` {kind}, ids ARRAY<INT>")


def count_tokens(df: DataFrame, text: str, into: str, folder: str = TOKENIZERS, file: str = VOCABULARY) -> DataFrame:
    """The columns without the text, and the text's number of tokens; 0 for null and empty."""
    path = str(Path(folder, file))
    kept = [c for c in df.columns if c != text]
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            counts = pa.array([words.count(x) for x in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], counts], names=[*kept, into])

    return df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`")).mapInArrow(run, f"{fields}, `{into}` BIGINT")
