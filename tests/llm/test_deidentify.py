import random

import pytest
from pyspark.sql import functions as F

from chartloom.llm import deidentify as d
from chartloom.llm import names, surrogates

PEOPLE = ["Gideon Ablevubbel", "Thomas Brindvombry", "Elkhubbel, Nathaniel", "Noor M. Crommaduk", "Rebecca B. Rusklombry", "Lucía B. Holbrimore, MD", "Daniel Ostvibbon", "James Ostvombry", "Uma Rusklibbon", "Thandi Crommubbel", "Ablevombry, Wren", "Ann Ostvaduk"]


@pytest.fixture(scope="module")
def lexicon():
    return d.Lexicon.of(PEOPLE)


def found(lexicon, text):
    return [(x.kind, text[x.start : x.end]) for x in d.find(text, lexicon)]


@pytest.mark.parametrize(("text", "items"), [
    ("Referred by Dr. Ostvackrun for a second opinion.", [("name", "Ostvackrun")]),
    ("PATIENT: Daniel Ostvibbon; SSN 955-17-1649 verified.", [("name", "Daniel Ostvibbon"), ("id_number", "955-17-1649")]),
    ("Spoke with Elkhubbel,\nNathaniel by phone.", [("name", "Elkhubbel,\nNathaniel")]),
    ("Form completed by GIDEON ABLEVUBBEL and Thomas B. Brindvombry-Crommaduk.", [("name", "GIDEON ABLEVUBBEL"), ("name", "Thomas B. Brindvombry-Crommaduk")]),
    ("P. Ruskladuk signed the release form.", [("name", "P. Ruskladuk")]),
    ("Mrs. Unheardofname was seen on time.", [("name", "Unheardofname")]),
    ("WAS DRIVEN HERE BY NOOR CROMMADUK.", [("name", "NOOR CROMMADUK")]),
    ("Call back at 1-916-555-0183 or (784) 555-0142, cell +1 737 555 0154 x9.", [("phone", "1-916-555-0183"), ("phone", "(784) 555-0142"), ("phone", "+1 737 555 0154")]),
    ("Left a message on 555-0133, 3315550185, 583-555-O111 and (791)5550103.", [("phone", "555-0133"), ("phone", "3315550185"), ("phone", "583-555-O111"), ("phone", "(791)5550103")]),
    ("Email: mateo+claim (at) postnook.example; or a_b @ x.test, c.d at inboxfield dot example dot org now", [("email", "mateo+claim (at) postnook.example"), ("email", "a_b @ x.test"), ("email", "c.d at inboxfield dot example dot org")]),
    ("SS# 941385113, MRN 00892027, medical record no. 00362080, plan member number BTK0947598, licence D725-2281-6166", [("id_number", "941385113"), ("id_number", "00892027"), ("id_number", "00362080"), ("id_number", "BTK0947598"), ("id_number", "D725-2281-6166")]),
    ("Lives at 5532 Wharf Avenue with family, then PO BOX 4703 and RR 3 Box 6473, Silvekridge.", [("address", "5532 Wharf Avenue"), ("address", "PO BOX 4703"), ("address", "RR 3 Box 6473")]),
    ("Moved to One Hundred Six East Quarry Hwy, or 12 SW Thistle Dr, Apt 4B, Nortekford WV 01234.", [("address", "One Hundred Six East Quarry Hwy"), ("address", "12 SW Thistle Dr, Apt 4B, Nortekford WV 01234")]),
    ("MAIL COPIES TO 4447 22ND COURT.", [("address", "4447 22ND COURT")]),
])
def test_found(lexicon, text, items):
    got = found(lexicon, text)
    assert [k for k, _ in got] == [k for k, _ in items]
    assert all(text.index(t) == x.start for (_, t), x in zip(items, d.find(text, lexicon)))


@pytest.mark.parametrize("text", [
    "SSN XXX-XX-3314 on file.", "Claim file 25-307182 was opened.", "Lot 935-16-152 given in the deltoid.", "Accession 3205-10-6853 was resulted.", "Order 123456789 placed, exhibit 12345678.",
    "Walks two blocks along Brindle Ave to the store.", "Kept in Fowler position with a Foley catheter.", "Screened for Parkinson and Alzheimer disease.", "Positive Phalen and Tinel signs; Babinski absent.",
    "Transferred from Harrowtdale Community Hospital by van.", "Blood pressure 158/65, pulse 76, weight 229 pounds.", "See Ex. 12F@26 for details.", "", None, "   ", "x" * 100_000, "1" * 5_000,
])
def test_not_found(lexicon, text):
    assert d.find(text, lexicon) == []


def test_typed_numbers():
    values = {"967283022": [0], "SSN:909 47 1883 / card seen": [4], "  937-17-6305": [2], "was XXX-XX-1180, now 963-O6-4933": [21], "966358609 or 945-14-6O53": [0, 13], "last four 5781": [], "file 34-0706": [], None: [], "": [], "pending": []}
    assert {v: [x.start for x in d.find_typed(v)] for v in values} == values


TEXT = "field STRING, record_id BIGINT, text STRING"


def listed(spark, people=PEOPLE):
    return d.name_words([spark.createDataFrame([(n,) for n in people], "n STRING")])


def tables(spark, rows, key=b"k", people=PEOPLE, **more):
    return d.deidentify(spark.createDataFrame(rows, TEXT), listed(spark, people), key, **more)


def test_surrogates_keep_type_distinctness_and_coreference(spark):
    rows = [("t", 1, "Daniel Ostvibbon called 555-0133 from 5532 Wharf Avenue."), ("t", 2, "Mr. Ostvibbon and DANIEL OSTVIBBON wrote; 555-0134."), ("t", 3, "Uma Rusklibbon, 555-0133, a.b@x.test"), ("t", 3, "Uma Rusklibbon, 555-0133, a.b@x.test"), ("t", 4, None), ("t", None, "Uma Rusklibbon"), ("ssn", 5, "967-28-3022")]
    made = tables(spark, rows)
    got = {(r.field, r.record_id): r for r in d.replaced(made).collect()}
    assert got["t", 1].redacted == "[NAME] called [PHONE] from [ADDRESS]." and got["ssn", 5].redacted == "[ID_NUMBER]"
    first, last = got["t", 1].pseudonymized.split()[:2]
    assert got["t", 2].pseudonymized.startswith(f"Mr. {last} and {first.upper()} {last.upper()} wrote")
    assert first.endswith("o") and got["t", 3].pseudonymized.split()[0].endswith("a")
    phone = got["t", 1].pseudonymized.split()[3]
    assert phone == got["t", 3].pseudonymized.split(", ")[1] and phone != got["t", 2].pseudonymized.split()[-1][:-1] and phone[3] == "-"
    assert "Ostvibbon" not in got["t", 1].pseudonymized and got["ssn", 5].pseudonymized[3] == "-"
    parts = made.surrogates.collect()
    for kind in {p.part_kind for p in parts}:
        own = [p for p in parts if p.part_kind == kind]
        assert len({p.surrogate for p in own}) == len(own)
    assert d.items(made).count() == 10


@pytest.mark.parametrize(("size", "share"), [(2, 1), (10, 1), (676, 1), (1000, 0.9)])
def test_permutation_of_a_dense_form(size, share):
    used = random.Random(1).sample(range(size), int(size * share))
    made = [surrogates.permuted(b"k", "t", x, size) for x in used]
    assert len(set(made)) == len(used) and max(made) < size and all(a != b for a, b in zip(used, made))


def test_parts_of_a_form_that_is_nearly_full(spark):
    emails = [a + b for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"][:608]
    numbers = [f"{i:03d}" for i in range(900)]
    names_ = [a + e + c for a in "bcdfghjklmnpqrstvwxyz" for e in "aeiou" for c in "bcdfghjklmnpqrstvwxyz"][: 21 * 5 * 19]
    rows = [("email", x) for x in emails] + [("number", x) for x in numbers] + [("surname", x) for x in names_]
    got = surrogates.assign(spark.createDataFrame([(*r, 0) for r in rows], "part_kind STRING, item STRING, evidence INT"), b"key").collect()
    assert len(got) == len(rows) == len({(r.part_kind, r.surrogate) for r in got})
    assert all(r.item != r.surrogate and len(r.item) == len(r.surrogate) and r.item.isdigit() == r.surrogate.isdigit() for r in got)
    assert {(r.part_kind, r.surrogate) for r in got if r.is_real} == {(r.part_kind, r.surrogate) for r in got} & set(rows)


@pytest.mark.parametrize(("text", "items"), [
    ("Пациент Иван Петров пришел.", ["Иван Петров"]), ("見 王小明 先生,王小明。", ["王小明", "王小明"]), ("Mr Łukasz Ščerba called Şerife.", ["Łukasz Ščerba"]),
    ("حضر محمد الحداد اليوم", ["محمد الحداد"]), ("Jose\u0301 Marti\u0301n and José Martín left.", ["Jose\u0301 Marti\u0301n", "José Martín"]),
])
def test_names_in_other_scripts_keep_their_script(spark, text, items):
    people = ["Иван Петров", "王小明", "Łukasz Ščerba", "محمد الحداد", "José Martín"]
    assert [text[x.start : x.end] for x in d.find(text, d.Lexicon.of(people))] == items
    made = tables(spark, [("t", 1, text)], people=people)
    for r in made.surrogates.collect():
        assert r.surrogate != r.item and {surrogates.script(c) for c in r.surrogate} == {surrogates.script(c) for c in names.plain(r.item)}
    row = d.replaced(made).first()
    assert row.n_items == len(items) and not any(x in row.pseudonymized for x in items)


def test_parts_of_addresses():
    split = lambda kind, text: [(k, text[a:b]) for k, _, a, b in d.parts(kind, text)]
    assert split("email", "a.b7@mail.postnook.example") == [("email", "a.b7"), ("host", "mail"), ("host", "postnook")]
    assert split("email", "c.d at inboxfield dot example dot org") == [("email", "c.d"), ("host", "inboxfield"), ("host", "example")]
    assert split("address", "One Hundred Six East Elm Hwy, Nortekford WV 01234") == [("ones", "One"), ("ones", "Six"), ("place", "Elm"), ("place", "Nortekford"), ("state", "WV"), ("number", "01234")]
    assert surrogates.dressed("x.y7", "a.b1") == "x.y7" and surrogates.dressed("5550199", "(555)-O133") == "(555)-0199"


def test_phones_of_other_countries(lexicon):
    assert found(lexicon, "Call +44 20 7946 0958 or +49 (30) 1234567.") == [("phone", "+44 20 7946 0958"), ("phone", "+49 (30) 1234567")]


def test_gender_is_learned_from_mentions(spark):
    rows = [("t", i, f"Mrs. Wren Ablevombry came. Noor Crommaduk said he slept. Zeb{i}ka Brindvombry came.") for i in range(3)]
    got = {r.item: r.surrogate for r in tables(spark, rows, people=[*PEOPLE, "Wren Ablevombry"]).surrogates.collect()}
    assert got["wren"].endswith("a") and got["noor"].endswith("o") and got["ablevombry"]


def test_words_are_classified_as_by_the_lexicon(spark, lexicon):
    rng = random.Random(4)
    known = [w for n in PEOPLE for w, _ in d.words_of(n)] + list(names.NICKNAMES)
    words = set(known) | {"", "-", "a-b", "ostvaduk", "rusklvombry-crommaduk", "crommvombry", "x" * 50}
    for w in rng.choices(known, k=200):
        i, j = sorted(rng.choices(range(len(w) + 1), k=2))
        words |= {w[:i] + w[i + 1 :], w[:i] + rng.choice("abz") + w[i:], w[:i] + w[j:], w[:i] + "-" + w[i:]}
    got = {r.word: r.flags for r in d.classified(spark.createDataFrame([(w,) for w in words], "word STRING"), listed(spark)).collect()}
    assert got == {w: f for w in words if (f := lexicon(w))}


def test_words_that_are_joined_find_the_same(spark, sf):
    rows = [("t", i, f"{a} met {b[:-1]}e. Spoke with Elkhubbel, Natahniel; P. Ruskladuk 555-0133.") for i, (a, b) in enumerate(zip(PEOPLE, PEOPLE[1:]))]
    rows += [("t", 90, None), ("t", 91, "none here"), ("t", 92, rows[0][2]), ("ssn", 5, "967-28-3022"), ("t", 93, "Uma Rusklibbon " * 5_000)]
    shared, joined = (sorted(map(str, d.detect(spark.createDataFrame(rows, TEXT), listed(spark), shared_words=n).collect())) for n in (d.SHARED_WORDS, 0))
    assert shared == joined and len(shared) > 5_000
    texts = spark.read.parquet(f"{sf}/medical_events.parquet").select(F.lit("t").alias("field"), F.col("event_id").alias("record_id"), F.col("source_text").alias("text"))
    people = spark.read.parquet(f"{sf}/claimants.parquet").select("full_name")
    lexicon = d.name_words([people])
    assert sorted(map(str, d.detect(texts, lexicon).collect())) == sorted(map(str, d.detect(texts, lexicon, shared_words=0).collect()))


def test_key_changes_surrogates_and_empty_tables(spark):
    rows = [("t", 1, "Uma Rusklibbon, 555-0133")]
    one, same, other = ({r.item: r.surrogate for r in tables(spark, rows, k).surrogates.collect()} for k in (b"a", b"a", b"b"))
    assert one == same and one != other
    none = tables(spark, [])
    assert d.items(none).count() == 0 and d.replaced(none).count() == 0


def test_unchanged_outside_items(spark):
    text = "🙂 é Uma Rusklibbon\r\n(555-0133) x"
    row = d.replaced(tables(spark, [("t", 1, text)])).first()
    assert row.redacted == "🙂 é [NAME]\r\n([PHONE]) x"
    assert row.pseudonymized.startswith("🙂 é ") and row.pseudonymized.endswith(") x") and len(row.pseudonymized.split("\r\n(")[1]) == len("555-0133) x")


def test_lists_of_names_of_any_size(spark):
    people = [f"Given{i}q Surname{i}" for i in range(3_000)]
    names_ = spark.createDataFrame([(n,) for n in people] + [(None,), ("",), ("Solo",)], "n STRING")
    texts = spark.createDataFrame([("t", i, f"then Surname{i} came") for i in range(3_000)], TEXT)
    assert d.detect(texts, d.name_words([names_, names_])).count() == 3_000
    empty = d.name_words([names_.limit(0)])
    assert d.detect(texts, empty).count() == 0 and d.detect(texts.limit(0), empty).count() == 0
