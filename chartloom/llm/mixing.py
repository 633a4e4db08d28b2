"""Mixes of sources by target shares of the total size."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartloom.llm import bpe
from chartloom.operators.prefix import SLICE, running, sliced
from chartloom.session import cut

#: Blocks that a mix is scheduled in. The schedule has this many entries and one a source more at most.
BLOCKS = 10_000
#: Most sources with a target.
MAX_SOURCES = 10_000


@dataclass(frozen=True)
class Source:
    name: str
    share: float
    repeats: int
    size: int
    quota: float = 0.0


def quotas(sources: list[Source], total: float | None = None) -> list[Source]:
    """Each source's part of ``total`` (by default the size of all sources, read once).

    A source whose size times its repeats falls short of its share gives all it may; the others share
    what is left of the total in proportion to their targets, until the total or all capacity is used.
    """
    wanted = float(sum(s.size for s in sources)) if total is None else float(total)
    given: dict[str, float] = {}
    open_ = [s for s in sources if s.share > 0]
    while open_:
        left, weight = wanted - sum(given.values()), sum(s.share for s in open_)
        full = [s for s in open_ if s.size * s.repeats <= left * s.share / weight]
        if not full:
            given |= {s.name: left * s.share / weight for s in open_}
            break
        given |= {s.name: float(s.size * s.repeats) for s in full}
        open_ = [s for s in open_ if s.name not in given]
    return [Source(s.name, s.share, s.repeats, s.size, given.get(s.name, 0.0)) for s in sources]


def schedule(blocks: dict[str, int]) -> list[tuple[str, int]]:
    """(source, block) of each slot, by earliest deadline first.

    Block k of a source with n of the N blocks is released in slot floor(k N / n) and due by slot
    ceil((k + 1) N / n). The weights n / N sum to 1, so the schedule meets every deadline and at each
    slot every source is less than one block off its share so far.
    """
    n_all = sum(blocks.values())
    later = [(0, name, 0) for name, n in blocks.items() if n]
    heapq.heapify(later)
    ready: list[tuple[int, str, int]] = []
    slots: list[tuple[str, int]] = []
    for slot in range(n_all):
        while later and later[0][0] <= slot:
            _, name, k = heapq.heappop(later)
            heapq.heappush(ready, (-(-(k + 1) * n_all // blocks[name]), name, k))
        _, name, k = heapq.heappop(ready)
        slots.append((name, k))
        if k + 1 < blocks[name]:
            heapq.heappush(later, ((k + 1) * n_all // blocks[name], name, k + 1))
    return slots


def sized(documents: DataFrame, targets: DataFrame, key: str, text: str, source: str, folder: str = bpe.TOKENIZERS, file: str = bpe.VOCABULARY) -> DataFrame:
    """(key, source, tokens) of the documents of sources with a target, each key once, written to the shared folder."""
    wanted = targets.select(F.col("source").alias("_source")).where("_source IS NOT NULL").distinct()
    rows = documents.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{source}`").alias("_of"), F.col(f"`{text}`").alias("_text"))
    rows = rows.where("_key IS NOT NULL AND _text <> ''").join(F.broadcast(wanted.limit(MAX_SOURCES)), F.col("_of") == F.col("_source"), "left_semi")
    return cut(bpe.count_tokens(rows, "_text", "_tokens", folder, file).dropDuplicates(["_key"]))


def mix(documents: DataFrame, targets: DataFrame, key: str, text: str, source: str, total: float | None = None, blocks: int = BLOCKS, seed: int = 0, folder: str = bpe.TOKENIZERS, file: str = bpe.VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    The mix has a row for each use of a document: slot, offset (place within the slot's block), source,
    key, repeat_no and tokens; ordered by slot and offset it is the training order. The report has a
    row for each target: target_share, max_repeats, available_tokens, mixed_tokens, actual_share,
    documents used, most uses of one document, and whether the source was too small for its share.

    Within a source the documents lie in a keyed random order; reading on from the end starts the next
    repeat, at most max_repeats of them. A document is used where the middle of it lies within the
    source's quota, so a source's size differs from the quota by less than half its longest document. Blocks are
    interleaved by ``schedule``.

    Sizes are tokens of the vocabulary; null and empty texts, null keys and sources without a target
    take no part. Keys that repeat count once. Null or negative shares count as 0, null repeats as 1;
    a source named twice counts by its first row in order of share. Empty tables give an empty mix.
    """
    spark = documents.sparkSession
    aims = {}
    for r in targets.select("source", "target_share", "max_repeats").where("source IS NOT NULL").orderBy(F.desc("target_share")).limit(MAX_SOURCES + 1).collect():
        aims.setdefault(r["source"], (max(r["target_share"] or 0.0, 0.0), max(1 if r["max_repeats"] is None else r["max_repeats"], 0)))
    if len(aims) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources have a target")
    rows = sized(documents, targets, key, text, source, folder, file)
    sizes = {r["_of"]: r["n"] for r in rows.groupBy("_of").agg(F.sum("_tokens").alias("n")).collect()}
    plan = quotas([Source(name, share, repeats, sizes.get(name, 0)) for name, (share, repeats) in sorted(aims.items())], total)
    whole = sum(s.quota for s in plan)
    block = max(whole / blocks, 1.0)
    counts = {s.name: -int(-s.quota // block) for s in plan}

    ends = spark.createDataFrame([(s.name, s.size, s.quota) for s in plan], "_name STRING, _size BIGINT, _quota DOUBLE")
    slots = spark.createDataFrame([(name, k, slot) for slot, (name, k) in enumerate(schedule(counts))], "_name STRING, _block BIGINT, slot BIGINT")
    mixed_up = rows.where("_tokens > 0").withColumn("_hash", F.xxhash64(F.lit(seed), "_key"))
    order = ["_hash", "_key"]
    placed = running(sliced(mixed_up, ["_of"], order), ["_of"], order, {"_end": ("sum", "_tokens")}).drop(SLICE)
    # Use p starts at p * size + end - tokens; its middle must lie within the quota.
    uses = F.ceil((F.col("_quota") - F.col("_end") + F.col("_tokens") / 2) / F.col("_size"))
    used = (
        placed.join(F.broadcast(ends), F.col("_of") == F.col("_name"))
        .where(uses > 0)
        .select("_of", "_key", "_tokens", (F.col("_end") - F.col("_tokens")).alias("_begin"), "_size", F.explode(F.sequence(F.lit(0).cast("long"), uses.cast("long") - 1)).alias("repeat_no"))
        .withColumn("_begin", F.col("_begin") + F.col("repeat_no") * F.col("_size"))
        .withColumn("_in", F.floor(F.col("_begin") / F.lit(block)))
    )
    mixed = used.join(F.broadcast(slots), (F.col("_of") == F.col("_name")) & (F.col("_in") == F.col("_block"))).select(
        "slot", (F.col("_begin") - F.floor(F.col("_in") * F.lit(block))).alias("offset"), F.col("_of").alias("source"), F.col("_key").alias(key), F.col("repeat_no").cast("int").alias("repeat_no"), F.col("_tokens").alias("tokens")
    )

    goals = spark.createDataFrame([(s.name, s.share, s.repeats, s.size, s.quota, s.quota < s.share * whole * (1 - 1e-9)) for s in plan], "source STRING, target_share DOUBLE, max_repeats INT, available_tokens BIGINT, _quota DOUBLE, too_small BOOLEAN")
    reached = (
        mixed.groupBy(F.col("source").alias("_name"), key)
        .agg(F.sum("tokens").alias("_t"), F.count("*").alias("_n"))
        .groupBy("_name")
        .agg(F.sum("_t").alias("_mixed"), F.count("*").alias("_docs"), F.max("_n").alias("_most"))
    )
    reached = reached.withColumn("_all", F.sum("_mixed").over(Window.partitionBy(F.lit(0))))  # a row a source
    report = (
        goals.join(reached, F.col("source") == F.col("_name"), "left")
        .select(
            "source", "target_share", "max_repeats", "available_tokens",
            F.coalesce("_mixed", F.lit(0)).alias("mixed_tokens"),
            F.coalesce(F.col("_mixed") / F.col("_all"), F.lit(0.0)).alias("actual_share"),
            F.coalesce("_docs", F.lit(0)).alias("documents"),
            F.coalesce("_most", F.lit(0)).alias("most_repeats"),
            "too_small",
        )
    )
    return mixed, report
