"""Records of one occurrence: near-equal descriptions, near dates, one provider."""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.llm import names
from chartloom.llm.linking import again, link, readings
from chartloom.operators.small import if_small
from chartloom.session import cut

#: Least share of words in common, in tenths.
TENTHS = 6
#: Bits of a fingerprint, and reference fingerprints whose distances make up a record's pivot table.
BITS = 512
PIVOTS = 32
#: Days that one block spans, and classes that a tile of a block holds.
SPAN = 8
TILE_ROWS = 8_192
#: Groups of entities that a crowded day is cut into.
PARTIES = 16
#: Rows compared at a time with others.
STRIPE = 512
#: In place of an entity: names nobody, names somebody that no directory holds.
NOBODY, UNLISTED = -1, -2

_WORD = re.compile(r"[^\W_]+").findall


def full_day(date: str) -> Column:
    """The day that a date as typed gives in full, month before day; null for partial and unreadable dates."""
    text = F.trim(F.regexp_replace(F.col(f"`{date}`"), r"\s+", " "))
    found = lambda pattern, form: F.try_to_date(F.nullif(pattern, F.lit("")), form)
    iso = F.regexp_extract(text, r"^(\d{4}-\d{1,2}-\d{1,2})(?:[T ]\d.*)?$", 1)
    us = F.regexp_replace(F.regexp_extract(text, r"^(\d{1,2}[/.-]\d{1,2}[/.-]\d{4})$", 1), "[.-]", "/")
    short = F.regexp_replace(F.regexp_extract(text, r"^(\d{1,2}[/.-]\d{1,2}[/.-]\d{2})$", 1), "[.-]", "/")
    pattern = r"^([A-Za-z]{3})[a-z]*\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})$"
    worded = F.concat_ws(" ", F.initcap(F.regexp_extract(text, pattern, 1)), F.nullif(F.regexp_extract(text, pattern, 2), F.lit("")), F.nullif(F.regexp_extract(text, pattern, 3), F.lit("")))
    back = r"^(\d{1,2}) ([A-Za-z]{3})[a-z]*\.?,? (\d{4})$"
    turned = F.concat_ws(" ", F.initcap(F.regexp_extract(text, back, 2)), F.nullif(F.regexp_extract(text, back, 1), F.lit("")), F.nullif(F.regexp_extract(text, back, 3), F.lit("")))
    return F.coalesce(found(us, "M/d/yyyy"), found(iso, "yyyy-M-d"), found(short, "M/d/yy"), found(worded, "MMM d yyyy"), found(turned, "MMM d yyyy"))


def words(text: str | None) -> frozenset[str]:
    """Distinct maximal runs of letters and digits, in lower case."""
    return frozenset(_WORD(text.lower())) if text else frozenset()


@functools.lru_cache(maxsize=500_000)
def _bit(word: str) -> int:
    return 1 << (zlib.crc32(word.encode("utf-8", "replace")) % BITS)


def fingerprints(sets: list[frozenset[str]]) -> np.ndarray:
    """A row of BITS bits a set: a word sets one bit, so sets differ in no more bits than in words."""
    raw = bytearray()
    for s in sets:
        bits = 0
        for w in s:
            bits |= _bit(w)
        raw += bits.to_bytes(BITS // 8, "little")
    return np.frombuffer(bytes(raw), np.uint64).reshape(len(sets), BITS // 64)


def pivot_table(prints: np.ndarray) -> np.ndarray:
    """Bits of each fingerprint in each of PIVOTS regions, a row a region.

    Reference fingerprint r has all bits of region r, w of them. A print of n bits, c of them there, is n + w - 2c
    away from it, so n and c stand for the distance. The same table gives the distances to all 2^PIVOTS unions
    of regions, which are reference fingerprints too: n plus the sum of w - 2c over their regions.
    """
    return np.bitwise_count(prints.view(np.uint8).reshape(len(prints), PIVOTS, BITS // 8 // PIVOTS)).sum(axis=2).astype(np.uint8).T.copy()


def survivors(table: np.ndarray, a: slice, other: np.ndarray, b: slice, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of columns of two pivot tables, in two slices, whose greatest difference of a coordinate is at most ``most``.

    Of all unions of regions, distances to the one of those where a has more bits than b differ most (or to the
    one where it has fewer): by the sum of |c - c'| over all regions. By the triangle inequality that is never
    above the Hamming distance, so no pair within ``most`` is lost. Sums wrap at 256, which only lets
    more pairs through.
    """
    x, y = table[:, a].view(np.int8), other[:, b].view(np.int8)
    total = np.zeros((x.shape[1], y.shape[1]), np.uint8)
    step = np.empty(total.shape, np.int8)
    for r in range(PIVOTS):
        np.subtract(x[r][:, None], y[r][None, :], out=step)
        np.abs(step, out=step)
        np.add(total, step.view(np.uint8), out=total)
    return np.nonzero(total <= most)


def alike(a: frozenset[str], b: frozenset[str]) -> bool:
    both = len(a & b)
    return both > 0 and both * 10 >= (len(a) + len(b) - both) * TENTHS


# ---------------------------------------------------------------- providers


def _given_fit(a: tuple[str, str], b: tuple[str, str]) -> bool:
    """Whether two (given name or initial, middle initial) may be one person's."""
    (x, m), (y, n) = a, b
    if m and n and m != n:
        return False
    if not x or not y:
        return True
    if len(x) == 1 or len(y) == 1:
        if x[0] == y[0]:
            return True
        long, short = (x, y) if len(x) > 1 else (y, x)
        return any(k[0] == short for k in names._NICK.get(long, ())) or any(short == full[0] and long in nicks for full, nicks in names._NICK.items())
    if names.same_given(x, y) is not None or names.same_given(y, x) is not None:
        return True
    return any(names.same_given(x, f) is not None and names.same_given(y, f) is not None for f in names._NICK)


def _persons(value: str) -> Iterator[tuple[str, tuple[str, str]]]:
    ws = [t for t in names.tokens(value) if t not in names.TITLES and t not in names.DEGREES]
    for i, w in enumerate(ws):
        if len(w) >= 4:
            rest = ws[:i] + ws[i + 1 :]
            full = [t for t in rest if len(t) > 2]
            initials = "".join(t for t in rest if len(t) <= 2)
            if len(full) <= 1 and len(initials) <= 3:
                yield w, ((full[0], initials[:1]) if full else (initials[:1], initials[1:2]))


@functools.lru_cache(maxsize=200_000)
def _unlisted(a: str, b: str) -> bool:
    """Whether two spellings that the directory doesn't settle name one party."""
    if names.tokens(a) == names.tokens(b):
        return True
    x, y = names.organisation_words(a), names.organisation_words(b)
    if len(x) == len(y) > 2:
        at = 1 if x[0] == "saint" or y[0] == "saint" else 0
        if names.same_place(x[at], y[at]) is not None and all(names.abbreviates(p, q) is not None or names.abbreviates(q, p) is not None for p, q in zip(x, y)):
            return True
    for s, given in _persons(a):
        for t, other in _persons(b):
            near = names.close(s, t, 2) <= (2 if min(len(s), len(t)) >= 7 else 1)
            begun = min(len(s), len(t)) >= 5 and (s.startswith(t) or t.startswith(s)) and len(given[0]) > 1 and len(other[0]) > 1
            if (near or begun) and _given_fit(given, other) and (given[0] or other[0] or near):
                return True
    return False


Party = tuple[str | None, int | None, str | None, str | None]


def same_party(a: Party, b: Party) -> bool:
    """Whether two providers (as typed, entity, its kind, its name) name the same person or organisation, or one names nobody."""
    if names.names_nobody(a[0]) or names.names_nobody(b[0]) or a[0] == b[0]:
        return True
    if a[1] is not None and b[1] is not None:
        return a[1] == b[1]
    if a[1] is not None or b[1] is not None:
        (_, _, kind, canonical), other = (a, b[0]) if a[1] is not None else (b, a[0])
        if kind == "person" and any(again(*r, ("", "", ""), True, kind, canonical) is not None for r in readings(other) if r[1] and r[2]):
            return True
    return _unlisted(min(a[0], b[0]), max(a[0], b[0]))


# ---------------------------------------------------------------- pairs


def _stripes(a: dict[str, np.ndarray], at: tuple[int, int], b: dict[str, np.ndarray], to: tuple[int, int], own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of two ranges that may share TENTHS of their words, by positions; of one range with itself each pair once.

    Sets that share s of their words differ in at most (1 - s) / (1 + s) of their sizes together, and their fingerprints
    in no more bits. Pairs whose pivot tables differ by more are discarded, then those whose fingerprints do,
    and those of two different entities.
    """
    for i0 in range(*at, STRIPE):
        x = slice(i0, min(i0 + STRIPE, at[1]))
        for j0 in range(i0 if own else to[0], to[1], 4 * STRIPE):
            y = slice(j0, min(j0 + 4 * STRIPE, to[1]))
            most = np.minimum((a["size"][x][:, None] + b["size"][y][None, :]) * (10 - TENTHS) // (10 + TENTHS), 255).astype(np.uint8)
            i, j = survivors(a["table"], x, b["table"], y, most)
            i, j = i + x.start, j + y.start
            p, q = a["party"][i], b["party"][j]
            kept = ((p < 0) | (q < 0) | (p == q)) & ((i < j) if own else True)
            i, j = i[kept], j[kept]
            bound = (a["size"][i] + b["size"][j]) * (10 - TENTHS) // (10 + TENTHS)
            near = np.bitwise_count(a["prints"][i] ^ b["prints"][j]).sum(axis=1) <= bound
            yield i[near], j[near]


def block_pairs(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pairs of a block that survive. Its own rows, where they are whole, meet each other; guests, who are
    of earlier days or the same, meet own rows only."""
    rows = rows.sort_by("day")

    def side(part: pa.Table) -> dict[str, np.ndarray]:
        prints = np.frombuffer(b"".join(part["print"].to_pylist()), np.uint64).reshape(len(part), BITS // 64)
        return {"id": part["id"].to_numpy(), "day": part["day"].to_numpy(), "party": part["party"].to_numpy(), "size": part["size"].to_numpy().astype(np.int32), "prints": prints, "table": pivot_table(prints)}

    guest = rows["guest"].to_numpy(zero_copy_only=False)
    own, guests = side(rows.filter(pa.array(~guest))), side(rows.filter(pa.array(guest)))
    whole = bool(rows["whole"][0].as_py()) if len(rows) else False
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a, among in ((own, True), (guests, False)):
        if among and not whole:
            continue
        for day in np.unique(a["day"]):
            at = tuple(np.searchsorted(a["day"], [day, day + 1]))
            to = tuple(np.searchsorted(own["day"], [day, day + 2]))
            for i, j in _stripes(a, at, own, to, among):
                left.append(a["id"][i])
                right.append(own["id"][j])
    return np.concatenate(left), np.concatenate(right)


def representatives(events: DataFrame, directory: DataFrame, key: str, date: str, provider: str, description: str) -> tuple[DataFrame, DataFrame]:
    """One row for each class of records of equal day, provider and description (id = the least key), with the
    entity that its provider is linked to, and (class, key) of all."""
    rows = events.select(F.col(f"`{key}`").cast("long").alias("key"), full_day(date).alias("d"), F.col(f"`{provider}`").alias("provider"), F.col(f"`{description}`").alias("description"))
    rows = rows.where(F.col("key").isNotNull() & F.col("d").isNotNull() & F.col("description").rlike(r"[\p{L}\p{N}]")).withColumn("day", F.unix_date("d")).drop("d")
    rows = rows.withColumn("class", F.sha2(F.concat_ws("\u0000", F.col("day").cast("string"), F.coalesce("provider", F.lit("\u0001")), "description"), 256).substr(1, 32))
    reps = cut(rows.groupBy("class").agg(F.min("key").alias("id"), F.first("day").alias("day"), F.first("provider").alias("provider"), F.first("description").alias("description")))
    linked = link(reps.select("provider"), "provider", directory).select(F.col("spelling").alias("provider"), F.col("entity_id").alias("entity"), "kind", "canonical")
    return reps.join(if_small(linked, 100_000), "provider", "left"), rows.select("class", "key")


def fingerprinted(reps: DataFrame) -> DataFrame:
    """(id, day, party, bucket, size, print): what a record takes to its blocks. Records that name nobody, or somebody that no
    directory holds, may meet all others; those of an entity meet its bucket and them."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [words(x) for x in batch.column(4).to_pylist()]
            entities = batch.column(3).to_pylist()
            party = [NOBODY if names.names_nobody(p) else UNLISTED if e is None else e for p, e in zip(batch.column(2).to_pylist(), entities)]
            rows = fingerprints(sets)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(party, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["id", "day", "party", "size", "print"])

    # Entities get numbers from 0 on, so that the two special parties can't be taken for one.
    entity = F.when(F.col("entity").isNotNull(), F.xxhash64("entity").bitwiseAND(F.lit((1 << 62) - 1)))
    printed = reps.select("id", "day", "provider", entity.alias("entity"), "description").mapInArrow(made, "id BIGINT, day INT, party BIGINT, size INT, print BINARY")
    return cut(printed.withColumn("bucket", F.when(F.col("party") < 0, F.col("party")).otherwise(F.pmod("party", F.lit(PARTIES))).cast("int")))


def tiled(printed: DataFrame, most: int = TILE_ROWS) -> tuple[DataFrame, DataFrame]:
    """(records with their tile, places): the tiles that records are cut into, and the blocks in which tiles meet.

    A span of days is one tile where it has at most ``most`` records, else each of its days is; a day of more
    is cut by bucket, and a bucket into as many parts as it takes. Two tiles meet where their days are at most one
    apart and their buckets may name one party. A tile's own block also takes the rows of the
    tile of the days before, where that is a single one; parts of crowded days meet pair by pair, so no block has
    more than about 2 * ``most`` rows.
    """
    cells = printed.groupBy("day", "bucket").agg(F.count("*").alias("n")).withColumn("span", F.floor(F.col("day") / SPAN).cast("int"))
    total = lambda by: cells.groupBy(by).agg(F.sum("n").alias(f"n_{by}"))
    cells = cells.join(total("span"), "span").join(total("day"), "day")
    by_span, by_day = F.col("n_span") <= most, F.col("n_day") <= most
    parts = F.when(by_span | by_day, 1).otherwise(F.ceil(F.col("n") / most)).cast("int")
    cells = cut(
        cells.select(
            "day", "bucket", "span", parts.alias("parts"), (by_span | by_day).alias("single"),
            F.when(by_span, F.concat(F.lit("s"), "span")).when(by_day, F.concat(F.lit("d"), "day")).otherwise(F.concat_ws("/", F.concat(F.lit("d"), "day"), "bucket")).alias("tile"),
            F.when(by_span, F.col("span") * SPAN).otherwise(F.col("day")).alias("lo"), F.when(by_span, F.col("span") * SPAN + SPAN - 1).otherwise(F.col("day")).alias("hi"),
        )
    )
    part = lambda n: F.when(F.col("parts") == 1, F.col("tile")).otherwise(F.concat_ws("#", "tile", n))
    tiles = cells.select(F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("n"), "*").select(part(F.col("n").cast("string")).alias("tile"), "span", "lo", "hi", "single", F.when(~F.col("single"), F.col("bucket")).alias("bucket")).distinct()
    a, b = tiles.withColumn("at", F.explode(F.array(F.col("span"), F.col("span") + 1))).alias("a"), tiles.alias("b")
    ordered = F.struct("a.lo", "a.tile") < F.struct("b.lo", "b.tile")
    fits = F.coalesce((F.col("a.bucket") == F.col("b.bucket")) | (F.col("a.bucket") < 0) | (F.col("b.bucket") < 0), F.lit(True))
    met = a.join(b, (F.col("a.at") == F.col("b.span")) & ordered & (F.col("b.lo") <= F.col("a.hi") + 1) & fits)
    own = F.col("a.single")
    block = F.when(own, F.col("b.tile")).otherwise(F.concat_ws(" ", "a.tile", "b.tile"))
    place = lambda tile, guest, of: F.struct(F.col(f"{tile}.tile").alias("tile"), block.alias("block"), F.lit(guest).alias("guest"), own.alias("whole"), (F.col(f"{of}.lo") - 1).alias("first"), (F.col(f"{of}.hi") + 1).alias("last"))
    cross = met.select(F.explode(F.array_compact(F.array(place("a", True, "b"), F.when(~own, place("b", False, "a"))))).alias("p")).select("p.*")
    places = tiles.select("tile", F.col("tile").alias("block"), F.lit(False).alias("guest"), F.lit(True).alias("whole"), F.col("lo").alias("first"), F.col("hi").alias("last")).unionByName(cross)
    where = cells.select("day", "bucket", "parts", "tile")
    placed = printed.join(if_small(where, 200_000), ["day", "bucket"]).withColumn("tile", part(F.pmod(F.xxhash64("id"), "parts").cast("string"))).drop("parts", "bucket")
    return placed, places


def class_pairs(reps: DataFrame, most: int = TILE_ROWS) -> DataFrame:
    """(a, b): ids of all pairs of classes that describe one occurrence."""
    placed, places = tiled(fingerprinted(reps), most)
    rows = placed.join(if_small(cut(places), 200_000), "tile").where(F.col("day").between(F.col("first"), F.col("last"))).select("block", "guest", "whole", "id", "day", "party", "size", "print")

    def pairs(table: pa.Table) -> pa.Table:
        a, b = block_pairs(table)
        return pa.table({"a": a, "b": b})

    near = cut(rows.groupBy("block").applyInArrow(pairs, "a BIGINT, b BIGINT"))
    of = lambda side: reps.select(F.col("id").alias(side), F.struct("provider", "entity", "kind", "canonical", "description").alias(f"of_{side}"))
    both = near.join(of("a"), "a").join(of("b"), "b").select("a", "b", "of_a", "of_b")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        party = lambda x: (x["provider"], x["entity"], x["kind"], x["canonical"])
        for batch in batches:
            kept = [i for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())) if alike(words(x["description"]), words(y["description"])) and same_party(party(x), party(y))]
            part = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"])

    return both.mapInArrow(verified, "a BIGINT, b BIGINT")


def near_duplicates(events: DataFrame, directory: DataFrame, key: str, date: str, provider: str, description: str, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b), a < b: keys of all pairs of records whose days are at most one apart, whose providers name
    one party or nobody, and whose descriptions share 0.6 of their words.

    Records equal in day, provider and description form a class, and classes are compared. A class's words become
    a fingerprint, its distances to the reference fingerprints a pivot table. Classes are cut into tiles of at most
    ``tile_rows`` by days and, where days are crowded, by party and number; tiles that may hold pairs meet in blocks.
    There pairs are discarded by the greatest difference of a coordinate, then by their fingerprints, and
    the survivors verified by their words and providers. At the end classes become records again.

    Records without key, full date or words have no pairs; a null or empty provider names nobody.
    Repeated rows count once. Empty tables give no rows; other columns are ignored.
    """
    reps, members = representatives(events, directory, key, date, provider, description)
    members = cut(members.distinct())
    names_of = reps.select("class", "id")
    pairs = class_pairs(reps, tile_rows)
    copied = members.groupBy("class").count().where("count > 1").select("class")
    copies = members.join(copied, "class")
    within = copies.alias("x").join(copies.alias("y"), (F.col("x.class") == F.col("y.class")) & (F.col("x.key") < F.col("y.key"))).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
    # Only classes of several records need other members than their least key.
    others = copies.join(names_of, "class").select("id", "key")
    grown = pairs
    for side in ("a", "b"):
        of = others.select(F.col("id").alias(side), F.col("key").alias("_key"))
        grown = grown.join(of, side, "left").withColumn(side, F.coalesce("_key", side)).drop("_key")
    return grown.select("a", "b").unionByName(within).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicate_groups(events: DataFrame, directory: DataFrame, key: str, date: str, provider: str, description: str, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(key, group_id) of every record: the least key among those that pairs of near_duplicates connect it with.

    Works on classes: copies, however many, are never expanded into pairs. Records without a full date or words
    are groups of their own; null keys are left out; repeated keys count once.
    """
    reps, members = representatives(events, directory, key, date, provider, description)
    labels = groups(reps, "id", class_pairs(reps, tile_rows))
    by_class = reps.select("class", "id").join(labels, "id").select("class", "group_id")
    grouped = members.distinct().join(by_class, "class").groupBy("key").agg(F.min("group_id").alias("group_id"))
    all_ = events.select(F.col(f"`{key}`").cast("long").alias("_key")).where("_key IS NOT NULL").distinct()
    return all_.join(grouped, F.col("_key") == F.col("key"), "left").select(F.col("_key").alias(key), F.coalesce("group_id", "_key").alias("group_id"))


def groups(keys: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """(key, group_id) of every key: the least key that pairs connect it with, its own if none do.

    Labels sink to the least in reach and skip ahead through labels of labels; each round is written to
    the shared folder. Rounds end when no label changes.
    """
    both = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        least = both.join(labels.toDF("b", "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        sunk = labels.join(least, "a").select("a", "label", F.least("label", "near").alias("next"))
        ahead = labels.toDF("next", "jump")
        moved = cut(sunk.join(ahead, "next", "left").select("a", "label", F.least("next", F.coalesce("jump", "next")).alias("next")))
        done = moved.where("next < label").isEmpty()
        labels = moved.select("a", F.col("next").alias("label"))
        if done:
            break
    every = keys.select(F.col(f"`{key}`").alias("_key")).where("_key IS NOT NULL").distinct()
    return every.join(labels, F.col("_key") == F.col("a"), "left").select(F.col("_key").alias(key), F.coalesce("label", "_key").alias("group_id"))
