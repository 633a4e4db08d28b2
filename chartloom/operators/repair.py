"""JSON that models return: fenced, wrapped, truncated."""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OBJECT = re.compile(r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", re.DOTALL)
# Members that wrap the entries.
WRAPPERS = ("entries", "chronological_medical_entries")


def unfenced(response: Column) -> Column:
    """The part between code fences, else all, without white space around."""
    inner = F.regexp_extract(response, r"(?s)```(?:json)?(.*?)(?:```|\z)", 1)
    return F.regexp_replace(F.when(response.contains("```"), inner).otherwise(response), r"^\s+|\s+$", "")


def _entries(value: object) -> list[dict]:
    while isinstance(value, dict):
        wrapped = next((w for w in WRAPPERS if w in value), None)
        if wrapped is None:
            return [value]
        value = value[wrapped]
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def _loads(text: str) -> object:
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def closed(text: str) -> str:
    """A text cut off inside JSON with its quotes and brackets closed, innermost first."""
    stack, quoted, escaped = [], False, False
    for c in text:
        if quoted:
            quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "[{":
            stack.append("]" if c == "[" else "}")
        elif c in "]}" and stack:
            stack.pop()
    text = text + '"' * quoted if quoted else re.sub(r"[,:\s]+\Z", "", text)
    return text + "".join(reversed(stack))


def mended(text: str) -> object:
    """What the longest beginning of a text gives that is valid JSON once its quotes and brackets are closed; None without.

    The parser tells where it stopped. All that ended before that place is whole, so the text is read once up to
    there and closed behind the last member or element.
    """
    value = _loads(closed(text))
    if value is not None:
        return value
    try:
        json.loads(text)
    except json.JSONDecodeError as error:
        stop = error.pos
    except (ValueError, RecursionError):
        return None
    stack: list[str] = []
    ends: deque[tuple[int, str]] = deque(maxlen=2)
    quoted = escaped = False
    for i, c in enumerate(text[:stop]):
        if quoted:
            quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "[{":
            stack.append("]" if c == "[" else "}")
            ends.append((i + 1, "".join(reversed(stack))))
        elif c in "]}" and stack:
            stack.pop()
            ends.append((i + 1, "".join(reversed(stack))))
        elif c == ",":
            ends.append((i, "".join(reversed(stack))))
    return next((v for at, closers in reversed(ends) if (v := _loads(text[:at] + closers)) is not None), None)


def salvaged(text: str) -> list[dict]:
    """Entries left in JSON that doesn't parse: complete objects with a date; else what closing the brackets gives."""
    whole = [x for x in map(_loads, _OBJECT.findall(text)) if isinstance(x, dict) and x.get("date")]
    if whole:
        return whole
    value = mended(text)
    found = _entries(value)
    return found if isinstance(value, list) else [x for x in found if x.get("date")]


def entries(responses: DataFrame, key: str, response: str) -> DataFrame:
    """(key, seq, entry): the entries of each response as JSON texts, in their order.

    Responses that parse stay on the JVM; Python sees only those that don't. Empty ones, and ones
    without JSON, give no rows.
    """
    clean = responses.select(F.col(f"`{key}`").alias("_key"), unfenced(F.col(f"`{response}`")).alias("_text")).where("_text <> ''")
    parsed = clean.withColumn("_ok", F.try_parse_json("_text"))
    good = parsed.where("_ok IS NOT NULL AND left(_text, 1) IN ('[', '{')")
    wrapped = F.coalesce(*(F.get_json_object("_text", f"$.{w}") for w in WRAPPERS), F.col("_text"))
    listed = F.when(F.ltrim(wrapped).startswith("["), F.from_json(wrapped, "array<string>")).otherwise(F.array(wrapped))
    fast = good.select(F.col("_key"), F.posexplode(F.filter(listed, lambda x: F.ltrim(x).startswith("{"))).alias("seq", "entry"))
    kind = responses.schema[key].dataType.simpleString()

    def slow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, seqs, texts = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for n, e in enumerate(salvaged(text)):
                    at.append(i)
                    seqs.append(n)
                    texts.append(json.dumps(e))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(seqs, pa.int32()), pa.array(texts, pa.string())], names=["_key", "seq", "entry"])

    mended = parsed.where("_ok IS NULL").select("_key", "_text").mapInArrow(slow, f"_key {kind}, seq INT, entry STRING")
    return fast.unionByName(mended).withColumnRenamed("_key", key)


# ---------------------------------------------------------------- determination results

_FENCE = re.compile(r"```(?:json)?(.*?)(?:```|\Z)", re.DOTALL)


def determination(response: str | None) -> dict:
    """The object of a model's answer: bare, fenced, with words around it, or cut off; empty where there is none."""
    text = response or ""
    if "```" in text:
        start = text.find("```json") if "```json" in text else text.find("```")
        text = _FENCE.match(text, start)[1]
    text = text.strip()
    first, last = text.find("{"), text.rfind("}")
    tries = (lambda: _loads(text), lambda: _loads(text[first : last + 1]) if first < last else None, lambda: mended(text[first:]))
    if first < 0:
        return {}
    return next((v for t in tries if isinstance(v := t(), dict)), {})


def determinations(answers: DataFrame, key: str, column: str) -> DataFrame:
    """(key, column): each answer as one valid JSON object, ``{}`` where nothing is left of it. Those that are valid stay on the JVM."""
    text, kind = F.col(f"`{column}`"), answers.schema[key].dataType.simpleString()
    rows = answers.select(F.col(f"`{key}`").alias("_key"), text.alias("_text"))
    good = F.coalesce(F.try_parse_json("_text").isNotNull() & F.ltrim("_text").startswith("{"), F.lit(False))

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([json.dumps(determination(t)) for t in batch.column(1).to_pylist()], pa.string())], names=["_key", "_text"])

    both = rows.where(good).unionByName(rows.where(~good).mapInArrow(mend, f"_key {kind}, _text STRING"))
    return both.select(F.col("_key").alias(key), F.col("_text").alias(column))


# Members whose presence makes a result sure.
KEY_FIELDS = ("claimant_name", "date_of_birth", "claim_type", "alleged_onset_date", "protective_filing_date")


def normalized(results: DataFrame, key: str, column: str) -> DataFrame:
    """Flat columns of determination results, nested under case_metadata or not, and the share of key fields found.

    Rows that hold no JSON object are left out; ``determinations`` mends those that were cut off."""
    text = F.col(f"`{column}`")
    under = lambda name: F.get_json_object(text, f"$.case_metadata.{name}")
    above = lambda name: F.get_json_object(text, f"$.{name}")
    both = lambda name: F.coalesce(under(name), above(name))
    filled = lambda c: F.coalesce(~F.coalesce(c, F.lit("")).isin("", "null", "[]", "{}", "false", "0"), F.lit(False))
    found = sum(((filled(above(f)) | filled(under(f))).cast("int") for f in KEY_FIELDS), F.lit(0))
    impairments = F.coalesce(F.get_json_object(text, "$.raw_fields.medical_impairments"), F.get_json_object(text, "$.medical_impairments"))
    count = F.when(impairments.startswith("["), F.json_array_length(impairments)).when(impairments.startswith("{"), F.size(F.json_object_keys(impairments))).otherwise(0)
    return results.where(F.try_parse_json(text).isNotNull() & F.ltrim(text).startswith("{")).select(
        F.col(f"`{key}`"), *(both(f).alias(f) for f in ("claimant_name", "alleged_onset_date", "age_category")), F.get_json_object(text, "$.case_metadata").isNotNull().alias("nested"), count.cast("int").alias("impairments"), (found / len(KEY_FIELDS)).alias("confidence")
    )


def exertional_capacity(lift: Column) -> Column:
    """Medium, Light or Sedentary by the weight named, in a text or an object."""
    return F.when(lift.contains("50"), "Medium").when(lift.contains("20"), "Light").when(lift.contains("10"), "Sedentary").otherwise("Unknown")
