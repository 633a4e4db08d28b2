"""Deeply nested JSON records into flat tables with parent links, in one pass."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.operators.small import if_small

EMITTED = "record_id {id}, tag STRING, pk STRING, parent_tag STRING, parent_pk STRING, position INT, parent_position INT, payload STRING"


#: Tag of the records themselves, and of those that couldn't be read as they nest too deep.
ROOT, UNREAD = "record", "unread"


def _clean(name: str) -> str:
    """JSON may name members by half of a surrogate pair, which no UTF-8 column can hold."""
    return name.encode("utf-8", "replace").decode()


def _refuse(name: str) -> float:
    raise ValueError(f"{name} is no JSON")


def parsed(text: str | None) -> dict | None:
    """The object that a text holds; None where it isn't one valid JSON object. One that nests too deep for the parser raises."""
    if not text:
        return None
    try:
        value = json.loads(text, parse_constant=_refuse)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def visit(record: str, root: dict, lists: frozenset[str], texts: frozenset[str]) -> Iterator[tuple]:
    """Depth-first walk that emits (tag, pk, parent tag, parent pk, position, parent position, payload).

    An object in an array is a row of the table named by its path, positions left out; objects that
    are plain members of another stay in their owner's payload under dotted names. A row's key is the
    record and its path with positions, its parent key that of the row it lies in. Members named in
    ``lists`` hold one row at position 0 where an object stands in place of the array; members named
    in ``texts`` may hold the object as JSON text. Null elements keep their position and are no row.
    """
    stack: list[tuple[dict, str, str, str | None, str | None, int, int | None]] = [(root, "", record, None, None, 0, None)]
    while stack:
        owner, tag, key, parent_tag, parent, position, above = stack.pop()
        payload: dict[str, object] = {}
        below: list[tuple[dict, str, str, str | None, str | None, int, int | None]] = []
        members = [(name, value, name) for name, value in reversed(owner.items())]
        while members:
            name, value, local = members.pop()
            path = f"{tag}.{local}" if tag else local
            if path in texts and isinstance(value, str):
                value = parsed(value)
            if path in lists and isinstance(value, dict):
                value = [value]
            if isinstance(value, dict):
                members += [(k, v, f"{local}.{k}") for k, v in reversed(value.items())]
            elif isinstance(value, list) and any(isinstance(x, dict) for x in value):
                for i, x in enumerate(value):
                    if isinstance(x, dict):
                        below.append((x, path, f"{key}/{local}/{i}", _clean(tag or ROOT), _clean(key), i, position))
                    elif x is not None:
                        below.append(({"value": x}, path, f"{key}/{local}/{i}", _clean(tag or ROOT), _clean(key), i, position))
            else:
                payload[local] = value
        yield _clean(tag or ROOT), _clean(key), parent_tag, parent, position, above, json.dumps(payload)
        stack += reversed(below)


def emit(df: DataFrame, record_id: str, column: str, lists: tuple[str, ...] = (), texts: tuple[str, ...] = ()) -> DataFrame:
    """One tagged row for each object of each record: record_id, tag, keys, positions and payload.

    The record itself has the tag ``record`` and its id as key. Texts that are null, empty, truncated or
    any JSON but an object give no rows; so do rows without a record id. A record that nests deeper than
    the parser's stack, a thousand levels at least, gives one row tagged ``unread``. Arrays without
    objects, empty ones too, stay in their owner's payload. A record delivered again gives
    the same rows, which count once: see ``once``. Other columns of any name are ignored.
    """
    kind = df.schema[record_id].dataType
    schema = T._parse_datatype_string(EMITTED.format(id=kind.simpleString()))
    arrow = pa.schema([("tag", pa.string()), ("pk", pa.string()), ("parent_tag", pa.string()), ("parent_pk", pa.string()), ("position", pa.int32()), ("parent_position", pa.int32()), ("payload", pa.string())])
    list_paths, text_paths = frozenset(lists), frozenset(texts)

    def rows_of(record: str, text: str) -> list[tuple]:
        try:
            root = parsed(text)
            return list(visit(record, root, list_paths, text_paths)) if root is not None else []
        except RecursionError:
            return [(UNREAD, record, None, None, 0, None, None)] if text.lstrip().startswith("{") else []

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, (record, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                found = rows_of(str(record), text)
                at += [i] * len(found)
                rows += found
                if len(rows) >= 20_000:
                    yield packed(batch.column(0), at, rows)
                    at, rows = [], []
            yield packed(batch.column(0), at, rows)

    def packed(ids: pa.Array, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[] for _ in arrow]
        arrays = [ids.take(pa.array(at, pa.int64()))] + [pa.array(c, f.type) for c, f in zip(columns, arrow)]
        return pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    source = df.select(F.col(f"`{record_id}`").alias("_id"), F.col(f"`{column}`").alias("_text")).where("_id IS NOT NULL AND _text LIKE '%{%'")
    return source.mapInArrow(walk, schema)


def emit_once(df: DataFrame, record_id: str, column: str, lists: tuple[str, ...] = (), texts: tuple[str, ...] = ()) -> DataFrame:
    """``emit`` for a table in which records may be delivered again. Only the rows of ids that repeat are shuffled."""
    rows = df.select(F.col(f"`{record_id}`").alias("_id"), F.col(f"`{column}`").alias("_text"))
    again = if_small(rows.groupBy(F.col("_id").alias("_again")).count().where("count > 1").select("_again"), 1_000_000)
    single = rows.join(again, F.col("_id") == F.col("_again"), "left_anti")
    several = rows.join(again, F.col("_id") == F.col("_again"), "left_semi").distinct()
    return emit(single, "_id", "_text", lists, texts).unionByName(once(emit(several, "_id", "_text", lists, texts)))


def once(emitted: DataFrame) -> DataFrame:
    """Drops what records delivered again emitted again."""
    return emitted.dropDuplicates(["tag", "pk"])


def table_of(emitted: DataFrame, tag: str, payload: str) -> DataFrame:
    """The flat table of a tag: keys, positions and the payload's columns by the DDL ``payload``. Of tables written by
    ``write_tables`` only that tag's folder is read."""
    rows = emitted.where(F.col("tag") == tag)
    return rows.select("record_id", "pk", "parent_pk", "position", "parent_position", F.from_json("payload", payload).alias("_p")).select(
        "record_id", "pk", "parent_pk", "position", "parent_position", "_p.*"
    )


def write_tables(emitted: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Writes all tables in one job, a folder a tag; table_of reads one back without the others."""
    emitted.write.mode(mode).partitionBy("tag").parquet(path)
