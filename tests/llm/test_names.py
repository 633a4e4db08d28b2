import pytest

from chartloom.llm import linking, names

DIRECTORY = [(1, "person", "Thandi P. Hespawitz, PT"), (2, "person", "Elizabeth T. Venngidge, PsyD"), (3, "person", "Thomas K. Krevoway, NP"), (4, "person", "Thomas W. Krevoway, PhD"), (5, "person", "Robert B. Rusklander, LCSW"),
             (6, "organization", "Saint Willombrook Surgical Center"), (7, "organization", "Cindargate Community Hospital"), (8, "organization", "Cindargate Memorial Hospital"), (9, "organization", "Willomford County Imaging and Diagnostic Center"), (10, "person", "Noor A. Ivorlythe, PT")]


def match(value, directory=DIRECTORY):
    """The entity that a value refers to, by reading it as each of the directory."""
    hits = [(*hit, e) for e, kind, name in directory if value is not None and not names.names_nobody(value) and (hit := names.read(value, kind, name))]
    costs = sorted((c, e) for n, c, e in hits if n == min(hits)[0])
    return costs[0][1] if costs and costs[0][0] <= linking.LEVELS[-1] and (len(costs) == 1 or costs[1][0] - costs[0][0] >= linking.APART) else None


@pytest.mark.parametrize(("value", "entity"), [
    ("thandi hespawitz", 1), ("HESPAWITZ, THANDI P", 1), ("Hespawitz, T. PT", 1), ("Dr. T Hespawitz", 1), ("TP Hespawitz", 1), ("Thandi P. Hesp", 1), ("thamdi hespawtirz", 1), ("Hespawitz Thandi", 1), ("Thandi Hespaw1tz P.T.", 1),
    ("Beth Venngidge", 2), ("Venngidge, L. PsyD", 2), ("Thomas K Krevoway NP", 3), ("T.W. Krevoway", 4), ("BB Rusklander", 5), ("Bob Rusklander-LCSW", 5),
    ("St. Willombrook Surg Ctr", 6), ("The Saint Willombrook Surgical Center - Outpatient", 6), ("S.W.S.C.", 6), ("Surgical Center of Saint Willombrook", 6), ("cindargate comm. hospital", 7), ("Cindargate Mem'l Hosp", 8), ("at Willomford Co Imag. & Dx Cntr, Inc.", 9),
])
def test_linked(value, entity):
    assert match(value) == entity


@pytest.mark.parametrize("value", ["", None, "-", "N/A", "illegible", "Unknown", "see above", "T. Krevoway", "Thomas Krevoway", "Dr. Soren Ivorlythe", "Cindardale Community Hospital", "Cindargate Neurology Group", "Thomas B. Krevoway", "Zandra Hespawitz", "???", "x" * 5000, "🙂", "1234"])
def test_left_alone(value):
    assert match(value) is None


def test_distance():
    assert [names.distance(a, b) for a, b in (("abc", "abc"), ("abc", "acb"), ("abc", "ab"), ("abc", "xyz"), ("", "ab"), ("abcdef", "a"))] == [0, 1, 1, 3, 2, 4]
    assert names.close("pernrnawitz", "pemmawitz") == 0.5
    assert names.deletions("ab") == {"ab", "a", "b"}


def links(spark, values, directory=DIRECTORY):
    rows = spark.createDataFrame([(v,) for v in values], "v STRING")
    table = spark.createDataFrame(directory, "entity_id BIGINT, kind STRING, canonical_name STRING")
    return {r.spelling: r.entity_id for r in linking.link(rows, "v", table).collect()}


def test_link_merges_and_matches_again(spark):
    # "Hespawtirzz" is three edits from the name and one from a spelling that is linked before it.
    got = links(spark, ["Thandi Hespawtirz", "Thandi Hespawtirzz", "Thandi P. Hsqawi", "Soren Ivorlythe", None, "", "N/A", "swsc", "swsc", "Thandi P. Hespawitz, PT"])
    assert got == {"Thandi Hespawtirz": 1, "Thandi Hespawtirzz": 1, "Thandi P. Hsqawi": 1, "swsc": 6, "Thandi P. Hespawitz, PT": 1}


def test_link_of_empty_tables_and_odd_directories(spark):
    assert links(spark, []) == {}
    assert links(spark, ["a b"], []) == {}
    odd = [(None, "person", "A Bcdefg"), (1, None, "Some Place Clinic"), (2, "person", None), (3, "person", ""), (4, "person", "Solo"), (5, "person", "Ann B. Twinname, MD"), (6, "person", "Ann B. Twinname, MD")]
    assert links(spark, ["some place clinic", "Ann Twinname"], odd) == {"some place clinic": 1}


def test_blocks_lose_no_reading():
    values = ["thandi hespawitz", "thamdi hespawtirz", "Thandi P. Hesp", "swsc", "cindargate comm. hospital", "Cindrgte Memorial Hospital", "Hesqawlz, Thandi", "Ventgidge Beth", "x" * 50, "a b", "Saint Wilombrok Surgical Ctr"]
    for v in values:
        for _, kind, name in DIRECTORY:
            if names.read(v, kind, name):
                assert names.value_keys(v) & set(names.entity_keys(kind, name)), (v, name)


def test_short_surnames(spark):
    directory = [(1, "person", "Ana Li, MD"), (2, "person", "Robert K. Wong, MD"), (3, "person", "Ming Li, DO")]
    assert links(spark, ["A. Li", "Bob Wong", "Wong, R.", "Li", "Ana Lee", "Mingg Li"], directory) == {"A. Li": 1, "Bob Wong": 2, "Wong, R.": 2, "Mingg Li": 3}


def test_merges_lead_on_until_none_is_left(spark):
    values = ["Thandi Hespawitz", "Thandi Hespawits", "Thandi Hesbawits", "Thandi Hesbawids", "Zoe Other"]
    rows = spark.createDataFrame([(v,) for v in values], "v STRING")
    table = spark.createDataFrame(DIRECTORY, "entity_id BIGINT, kind STRING, canonical_name STRING")
    got = {r.spelling: (r.merge_round, r.level) for r in linking.link(rows, "v", table).collect()}
    # Each spelling is one edit from the one before; the later ones are only near to what was merged.
    assert got == {"Thandi Hespawitz": (1, 0.8), "Thandi Hespawits": (1, 0.8), "Thandi Hesbawits": (2, 0.8), "Thandi Hesbawids": (3, 0.8)}


def test_large_directory_with_one_hot_surname(spark):
    directory = [(i, "person", f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}ra Hotnameson") for i in range(600)] + [(999, "person", "Thandi P. Hespawitz, PT")]
    got = links(spark, ["aara hotnameson", "Hotnameson", "zzra hotnamesen", "thandi hespawitz"], directory)
    assert got["thandi hespawitz"] == 999 and got["aara hotnameson"] == 0 and "Hotnameson" not in got
