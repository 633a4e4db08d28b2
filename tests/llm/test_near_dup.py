import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartloom.llm import names, near_dup
from chartloom.session import table

ROW = "event_id BIGINT, date STRING, provider STRING, description STRING"
DIRECTORY = [(1, "person", "Thandi P. Hespawitz, PT"), (2, "person", "Kofi B. Ostvorello, LCSW"), (3, "organization", "Cindargate Community Hospital")]


def pairs(spark, rows, tile_rows=near_dup.TILE_ROWS):
    events = spark.createDataFrame(rows, ROW)
    directory = spark.createDataFrame(DIRECTORY, "entity_id BIGINT, kind STRING, canonical_name STRING")
    return {(r.a, r.b) for r in near_dup.near_duplicates(events, directory, "event_id", "date", "provider", "description", tile_rows).collect()}


def brute(rows):
    linked = {}
    for provider in {r[2] for r in rows}:
        hits = sorted((*hit, e, kind, name) for e, kind, name in DIRECTORY if not names.names_nobody(provider) and (hit := names.read(provider, kind, name)))
        linked[provider] = (provider, *(hits[0][2:] if hits else (None, None, None)))
    days = {}
    out = set()
    for i, date, provider, text in rows:
        for form in ("%m/%d/%Y", "%Y-%m-%d"):
            try:
                days[i] = dt.datetime.strptime(date, form).date()
            except (ValueError, TypeError):
                pass
    for a in rows:
        for b in rows:
            if a[0] is not None and b[0] is not None and a[0] < b[0] and a[0] in days and b[0] in days and abs((days[a[0]] - days[b[0]]).days) <= 1 and near_dup.alike(near_dup.words(a[3]), near_dup.words(b[3])) and near_dup.same_party(linked[a[2]], linked[b[2]]):
                out.add((a[0], b[0]))
    return out


def made(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randrange(5, 25))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = [w for w in rng.choice(bases) if rng.random() > 0.12] + [rng.choice(vocabulary) for _ in range(rng.randrange(3))]
        rng.shuffle(words)
        day = dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(20))
        date = rng.choice([day.strftime("%m/%d/%Y"), day.isoformat(), "2020", None] if rng.random() < 0.2 else [day.strftime("%m/%d/%Y"), day.isoformat()])
        provider = rng.choice(["Thandi P. Hespawitz, PT", "thandi hespawitz", "Kofi Ostvorello", "Unknown", None, "Jane Other", "Other, J."])
        rows.append((i, date, provider, rng.choice([" ".join(words), " ".join(words), None, ""]) if rng.random() < 0.1 else " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("tile_rows", [1, 6, 30, near_dup.TILE_ROWS])
def test_against_all_pairs(spark, seed, tile_rows):
    rows = made(seed)
    assert pairs(spark, rows, tile_rows) == brute(rows)


def test_a_crowded_day(spark):
    """Most records are of one day; its tiles meet pair by pair."""
    rows = [(i, "01/05/2020" if i % 4 else date, provider, text) for i, date, provider, text in made(7, 500)]
    assert pairs(spark, rows, 20) == brute(rows)


def test_copies_across_block_bounds(spark):
    rows = [(i, f"2020-01-{1 + i % 4:02d}", "N/A", "same few words here") for i in range(12)] + [(3, "2020-01-04", "N/A", "same few words here")]
    assert pairs(spark, rows) == brute(rows[:-1])


def test_dates(spark):
    said = {"2016-04-16": "2016-04-16", "10/26/15": "2015-10-26", "04-07-2018": "2018-04-07", "Aug 24, 2019": "2019-08-24", "May 5, 2017": "2017-05-05", "September 5, 2017": "2017-09-05", "2018-11-04T00:00:00": "2018-11-04", "1/5/2024": "2024-01-05", "5 Mar 2020": "2020-03-05", " 6/2/2024 ": "2024-06-02"}
    unsaid = ["04/2021", "2015", "circa 2015", "??/01/2016", "undated", "", "02/30/2020", "13/01/2020", "2020-1", "garbage 1/2/2020"]
    df = spark.createDataFrame([(k,) for k in [*said, *unsaid]] + [(None,)], "d STRING").withColumn("x", near_dup.full_day("d"))
    got = {r.d: str(r.x) if r.x else None for r in df.collect()}
    assert got == {**said, **dict.fromkeys([*unsaid, None])}


def test_pivots_lose_no_pair():
    rng = random.Random(5)
    sets = [frozenset(rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(rng.randrange(1, 40))) for _ in range(120)]
    sets += [frozenset(f"w{i}" for i in range(k, k + 2_000)) for k in (0, 100)]
    prints = near_dup.fingerprints(sets)
    table = near_dup.pivot_table(prints)
    size = np.array([len(s) for s in sets])
    most = np.minimum((size[:, None] + size[None, :]) // 4, 255).astype(np.uint8)
    i, j = near_dup.survivors(table, slice(0, 122), table, slice(0, 122), most)
    kept = set(zip(i.tolist(), j.tolist()))
    assert all((a, b) in kept for a in range(122) for b in range(122) if near_dup.alike(sets[a], sets[b]))
    assert len(kept) < 122 * 122 / 2


def test_a_coordinate_is_a_distance():
    prints = near_dup.fingerprints([frozenset("abcdefgh"), frozenset("ghij")])
    bits = np.unpackbits(prints.view(np.uint8).reshape(2, -1), axis=1)
    width = near_dup.BITS // near_dup.PIVOTS
    for r in range(near_dup.PIVOTS):
        pivot = np.zeros(near_dup.BITS, np.uint8)
        pivot[r * width : (r + 1) * width] = 1
        assert ((bits != pivot).sum(axis=1) == bits.sum(axis=1) + width - 2 * near_dup.pivot_table(prints)[r]).all()


def test_very_long_and_odd_texts(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, "2020-01-01", None, long), (2, "2020-01-02", "", long + " more"), (3, "2020-01-01", None, "..."), (4, "2020-01-01", None, "É 🙂 ß"), (5, "2020-01-01", None, "é ß"), (None, "2020-01-01", None, "é ß")]
    assert pairs(spark, rows) == {(1, 2), (4, 5)} and pairs(spark, []) == set()


def test_groups(spark):
    keys = spark.createDataFrame([(i,) for i in [*range(12), None, 3]], "event_id BIGINT")
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (4, 5), (10, 11), (5, 10)], "a BIGINT, b BIGINT")
    got = {r.event_id: r.group_id for r in near_dup.groups(keys, "event_id", links).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4, 10: 4, 11: 4, 6: 6, 7: 7, 8: 8}
    assert near_dup.groups(keys, "event_id", links.limit(0)).where(F.col("event_id") != F.col("group_id")).count() == 0


def test_long_chain(spark):
    keys = spark.range(200).withColumnRenamed("id", "k")
    chain = spark.range(199).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.group_id for r in near_dup.groups(keys, "k", chain).collect()} == {0}


def test_the_events(spark, sf):
    events, directory = table(spark, sf, "medical_events"), table(spark, sf, "directory")
    args = ("event_id", "date", "provider", "description")
    whole = {tuple(r) for r in near_dup.near_duplicates(events, directory, *args).collect()}
    assert whole == {tuple(r) for r in near_dup.near_duplicates(events, directory, *args, tile_rows=3).collect()} and whole


def test_groups_of_records_equal_those_of_pairs(spark):
    rows = [*made(3), (500, "2020-01-02", "N/A", "one more"), (501, "2020-01-02", "N/A", "one more"), (501, "2020-01-02", "N/A", "one more"), (502, None, "x", "y"), (None, "2020-01-02", "N/A", "one more")]
    events = spark.createDataFrame(rows, ROW)
    directory = spark.createDataFrame(DIRECTORY, "entity_id BIGINT, kind STRING, canonical_name STRING")
    links = near_dup.near_duplicates(events, directory, "event_id", "date", "provider", "description")
    want = {tuple(r) for r in near_dup.groups(events, "event_id", links).collect()}
    assert {tuple(r) for r in near_dup.near_duplicate_groups(events, directory, "event_id", "date", "provider", "description").collect()} == want
