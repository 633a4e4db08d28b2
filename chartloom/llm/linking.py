"""Spellings of names linked to the entities of a directory, by merging and matching again."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.llm import names
from chartloom.operators.small import if_small
from chartloom.session import cut

#: Most edits between a name and the directory's form of it, however many merges lie between.
MOST_EDITS = 3
#: Costs up to which a value is merged: the next is tried when nothing merges below the one before.
LEVELS = (0.8, 1.6, 2.6)
#: How much dearer the next entity has to be.
APART = 0.15

ENTITY = "entity_id BIGINT, kind STRING, canonical STRING"
READING = "word STRING, given STRING, middle STRING"
CANDIDATE = f"spelling STRING, {ENTITY}, left_out INT, cost DOUBLE, {READING}"


def readings(value: str) -> Iterator[tuple[str, str, str]]:
    """(word, given, middle) for each word that may be the surname, and (place, all words, '') as an organisation."""
    words = [t for t in names.tokens(value) if t not in names.TITLES and t not in names.DEGREES]
    for i, word in enumerate(words):
        if len(word) >= 5:
            rest = words[:i] + words[i + 1 :]
            full = [t for t in rest if len(t) > 2]
            initials = "".join(t for t in rest if len(t) <= 2)
            if len(full) <= 1:
                yield word, full[0] if full else "", initials[:1] if full else initials[1:2]
    named = names.organisation_words(value)
    if len(named) > 1:
        place = named[1] if named[0] == "saint" and len(named) > 2 else named[0]
        yield place, " ".join(named), ""


def merged(value: str, kind: str, canonical: str) -> tuple[str, str, str]:
    """What a linked spelling adds to the entity's profile: the reading nearest to its name."""
    if kind == "person":
        target, org = names.person(canonical).surname, False
    else:
        o = names.organisation(canonical)
        target, org = o.words[o.place], True
    ways = [r for r in readings(value) if (" " in r[1]) == org]
    return min(ways, key=lambda r: (names.distance(r[0], target, 6), r), default=("", "", ""))


def again(word: str, given: str, middle: str, variant: tuple[str, str, str], by_given: bool, kind: str, canonical: str) -> float | None:
    """Cost of a reading that meets a spelling merged into an entity; None where it doesn't fit the entity.

    The reading is held against the merged spelling: what differs from it costs, not what that differs from the
    entity's own name by. The own name only bounds how far merges may lead away from it.
    """
    if kind == "person":
        p = names.person(canonical)
        if not given and not middle:
            return None
        beside = p.read(tuple(x for x in (given, middle) if x))
        if len(given) > 1 and given == variant[1] and (not middle or not p.middle or middle == p.middle):
            beside = min(0.2, beside if beside is not None else 0.2)
        if beside is None:
            return None
        d = names.close(word, p.surname, MOST_EDITS)
        if by_given and middle == p.middle:
            n = len(word)
            d = min([d, *(0.5 + names.close(word, p.surname[:k], 2) for k in range(max(4, n - 2), min(n + 3, len(p.surname))))])
            return 0.5 * d + beside if d <= MOST_EDITS and word[0] == p.surname[0] else None
        step = names.distance(word, variant[0], 1)
        return 0.25 + 0.5 * min(d, step) + beside if d <= MOST_EDITS and step <= 1 and word != p.surname else None
    o = names.organisation(canonical)
    typed, spelled = tuple(given.split()), tuple(variant[1].split())
    if len(typed) != len(o.words) or (place := names.same_place(word, o.words[o.place])) is None:
        return None
    if len(spelled) == len(typed) and sum(names.distance(a, b, 2) for i, (a, b) in enumerate(zip(typed, spelled)) if i != o.place) <= 1:
        return place + 0.5
    return None


def _words_left(word: str) -> Column:
    """The word and each form of it with one letter left out."""
    left = f"concat('w:', left({word}, i - 1), substring({word}, i + 1))"
    return F.expr(f"array_distinct(concat(array(concat('w:', {word})), CASE WHEN length({word}) <= {names.LONGEST} THEN transform(sequence(1, length({word})), i -> {left}) ELSE array() END))")


def _keys(df: DataFrame) -> DataFrame:
    """A row for each block that a reading enters."""
    given = F.when((F.col("given") != "") & (F.col("middle") != ""), F.array(F.concat(F.lit("g:"), "given", F.lit("|"), "middle"))).otherwise(F.array().cast("array<string>"))
    return df.where("length(word) >= 4").withColumn("key", F.explode(F.concat(_words_left("word"), given)))


def _each(run, schema: pa.Schema, columns: int = 1):  # noqa: ANN001, ANN202
    """A function on batches from one that yields rows for the first columns of a row."""

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            rows = [r for x in zip(*(batch.column(i).to_pylist() for i in range(columns))) for r in run(*x)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return batches


_S, _I, _L, _F = pa.string(), pa.int32(), pa.int64(), pa.float64()
_CANDIDATE = pa.schema([("spelling", _S), ("entity_id", _L), ("kind", _S), ("canonical", _S), ("left_out", _I), ("cost", _F), ("word", _S), ("given", _S), ("middle", _S)])


def _read(spelling: str, entity: int, kind: str, canonical: str) -> Iterator[tuple]:
    hit = names.read(spelling, kind, canonical)
    if hit:
        yield spelling, entity, kind, canonical, *hit, *merged(spelling, kind, canonical)


def _read_again(spelling: str, word: str, given: str, middle: str, entity: int, kind: str, canonical: str, v_word: str, v_given: str, v_middle: str, by_given: bool) -> Iterator[tuple]:
    cost = again(word, given, middle, (v_word, v_given, v_middle), by_given, kind, canonical)
    if cost is not None:
        yield spelling, entity, kind, canonical, 0, cost, word, given, middle


def _keyed_value(spelling: str) -> Iterator[tuple]:
    if not names.names_nobody(spelling):
        yield from ((spelling, k) for k in names.value_keys(spelling))


def _keyed_entity(entity: int, kind: str, canonical: str) -> Iterator[tuple]:
    yield from ((entity, kind, canonical, k) for k in set(names.entity_keys(kind, canonical)))


def decided(candidates: DataFrame, most: float) -> DataFrame:
    """The cheapest entity of each spelling, unless it is dearer than ``most`` or another comes too near it."""
    cheapest = candidates.groupBy("spelling", "entity_id").agg(F.min(F.struct("cost", "kind", "canonical", "word", "given", "middle")).alias("m"))
    # The two cheapest entities are enough to tell; they are found without gathering all of a spelling's.
    first = cheapest.groupBy("spelling").agg(F.min(F.struct("m.cost", "entity_id", "m")).alias("b"))
    other = cheapest.join(first.select(F.col("spelling").alias("_s"), F.col("b.entity_id").alias("_e"), F.col("b.cost").alias("_c")), (F.col("spelling") == F.col("_s")) & (F.col("entity_id") != F.col("_e")) & (F.col("m.cost") - F.col("_c") < APART)).select("spelling").distinct()
    best = first.where(F.col("b.cost") <= most).join(other, "spelling", "left_anti")
    return best.select("spelling", F.col("b.entity_id").alias("entity_id"), "b.m.kind", "b.m.canonical", "b.m.word", "b.m.given", "b.m.middle")


def link(values: DataFrame, spelling: str, directory: DataFrame, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """(entity_id, spelling, canonical, kind, merge_round, level) of each distinct value that refers to an entity of the directory.

    Values and entities are blocked by what slips of the hand leave of their surnames, places, beginnings
    and acronyms, and met values are read as the entity: slips of the hand and of scanning, short forms, nicknames,
    initials, swapped parts, names cut off. Each reading has a cost.

    Merge and rematch: the cheapest readings, up to the first level, are merged. A merged spelling joins
    the entity's profile: its form of the surname, of the given name, its initials, its words of an
    organisation. Profiles enter blocking again with what they gained, and open values that meet them there
    are held against the merged spelling, at most MOST_EDITS from the entity's own name. Rounds go on
    until none merges anything; then the next level is tried, until none merges at the last.

    Values that name nobody, or fit two entities alike, are not linked; neither are nulls. A value counts once
    however often it occurs. Entities without id or name are left out. Directory and values are joined,
    so both may be of any size; words of more than 40 letters are compared as they stand.
    """
    entities = directory.select(F.col("entity_id").cast("long").alias("entity_id"), F.coalesce("kind", F.lit("")).alias("kind"), F.col("canonical_name").alias("canonical")).where("entity_id IS NOT NULL AND canonical IS NOT NULL").distinct()
    distinct = values.select(F.col(f"`{spelling}`").alias("spelling")).where("spelling IS NOT NULL").distinct()
    # Few bytes of names take much work, so they are spread over tasks by number, not by size.
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = distinct.repartition(tasks).mapInArrow(_each(_keyed_value, pa.schema([("spelling", _S), ("key", _S)])), "spelling STRING, key STRING")
    blocks = cut(entities.mapInArrow(_each(_keyed_entity, pa.schema([("entity_id", _L), ("kind", _S), ("canonical", _S), ("key", _S)]), 3), f"{ENTITY}, key STRING"))
    met = keyed.join(if_small(blocks, 200_000), "key").select("spelling", "entity_id", "kind", "canonical").distinct()
    scored = cut(met.repartition(tasks).mapInArrow(_each(_read, _CANDIDATE, 4), CANDIDATE))
    # Where a word stands as it is, entities it meets with letters left out don't count.
    least = scored.groupBy(F.col("spelling").alias("_s")).agg(F.min("left_out").alias("_n"))
    candidates = scored.join(least, (F.col("spelling") == F.col("_s")) & (F.col("left_out") == F.col("_n"))).drop("_s", "_n")

    # Values that no reading settles enter blocking again in each round.
    new = cut(decided(candidates, levels[0]))
    open_ = cut(distinct.join(new.select("spelling"), "spelling", "left_anti").mapInArrow(_each(lambda s: () if names.names_nobody(s) else ((s, *r) for r in readings(s)), pa.schema([("spelling", _S), ("word", _S), ("given", _S), ("middle", _S)])), f"spelling STRING, {READING}"))
    links, number, level = None, 0, 0
    while True:
        if new.isEmpty():
            if level + 1 == len(levels):
                break
            level += 1
        else:
            number += 1
            found = new.select("entity_id", "spelling", "canonical", "kind", F.lit(number).alias("merge_round"), F.lit(levels[level]).alias("level"))
            links = found if links is None else links.unionByName(found)
            profiles = _keys(new.select("entity_id", "kind", "canonical", "word", "given", "middle").distinct()).select("entity_id", "kind", "canonical", "key", F.col("word").alias("v_word"), F.col("given").alias("v_given"), F.col("middle").alias("v_middle"))
            still = _keys(open_.join(links.select("spelling"), "spelling", "left_anti"))
            pairs = still.join(profiles, "key").select("spelling", "word", "given", "middle", "entity_id", "kind", "canonical", "v_word", "v_given", "v_middle", F.col("key").startswith("g:").alias("by_given")).distinct()
            gained = pairs.mapInArrow(_each(_read_again, _CANDIDATE, 11), CANDIDATE)
            candidates = cut(candidates.join(new.select("spelling"), "spelling", "left_anti").unionByName(gained))
        new = cut(decided(candidates, levels[level]))
    if links is None:
        return values.sparkSession.createDataFrame([], "entity_id BIGINT, spelling STRING, canonical STRING, kind STRING, merge_round INT, level DOUBLE")
    return links
