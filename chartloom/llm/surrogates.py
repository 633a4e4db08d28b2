"""Keyed surrogates for the parts of personal items: permutations of all values of a form."""

from __future__ import annotations

import functools
import hashlib
import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.session import cut

#: Rounds of the Feistel network.
ROUNDS = 10
#: Given names of known gender that the model of endings is fitted on, at most: those of the least hashes.
GENDER_NAMES = 50_000
#: How many more of a name's mentions must speak for one gender than for the other, as a share of all.
GENDER_SHARE = 0.6

# Number words, and the states that an address names.
ONES = "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen"
TENS = "twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety"
STATES = "al|ak|az|ar|ca|co|ct|de|fl|ga|hi|id|il|in|ia|ks|ky|la|me|md|ma|mi|mn|ms|mo|mt|ne|nv|nh|nj|nm|ny|nc|nd|oh|ok|or|pa|ri|sc|sd|tn|tx|ut|vt|va|wa|wv|wi|wy|dc|pr"
_LISTS = {"ones": tuple(ONES.split("|")), "tens": tuple(TENS.split("|")), "state": tuple(STATES.split("|"))}

# Given names by the gender they are usually read as; the first labels of the model of endings.
FEMALE = frozenset("abigail amara deborah eleanor elizabeth florence frances guadalupe hana harriet imani ingrid irene jacqueline jennifer judith katherine lucia margaret patricia priya rebecca susan thandi uma vera victoria ximena yara zeynep mary linda barbara maria nancy karen lisa sandra ana carmen rosa".split())
MALE = frozenset("alexander andrew anthony benjamin charles christopher daniel dmitri edward francisco gerald gideon gregory henry james joseph kofi lawrence leonard mateo matthew michael nathaniel oluwa owen pavel philip quentin raymond richard robert samuel soren steven theodore thomas timothy william john david jose juan carlos luis paul mark".split())

# Vowels of the scripts whose names are rebuilt from vowels and consonants, and endings by gender.
VOWELS = {"LATIN": "aeiou", "CYRILLIC": "аеиоуыэюя", "GREEK": "αεηιουω"}
LETTERS = {"LATIN": "abcdefghijklmnopqrstuvwxyz", "CYRILLIC": "абвгдежзиклмнопрстуфхцчшщъыьэюя", "GREEK": "αβγδεζηθικλμνξοπρστυφχψω"}
ENDINGS = {"LATIN": {"f": "a", "m": "o", "": "e"}, "CYRILLIC": {"f": "а", "m": "о", "": "е"}, "GREEK": {"f": "α", "m": "ο", "": "ε"}}


# ---------------------------------------------------------------- permutations


def _drawn(key: bytes, tag: str, i: int, value: int, below: int) -> int:
    size = (below.bit_length() + 7) // 8 + 16
    return int.from_bytes(hashlib.shake_256(b"\0".join((len(key).to_bytes(4, "big"), key, tag.encode("utf-8", "replace"), b"%d" % i, b"%d" % value))).digest(size), "big") % below


def _rounds(key: bytes, tag: str, x: int, sides: tuple[int, int], back: bool) -> int:
    """A Feistel network on pairs (left, right) below ``sides``; ``back`` undoes it."""
    left, right = divmod(x, sides[1])
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        sign = -1 if back else 1
        if i % 2:
            right = (right + sign * _drawn(key, tag, i, left, sides[1])) % sides[1]
        else:
            left = (left + sign * _drawn(key, tag, i, right, sides[0])) % sides[0]
    return left * sides[1] + right


def permuted(key: bytes, tag: str, x: int, size: int) -> int:
    """Another number below ``size`` than x, by a keyed permutation without fixed points.

    The network permutes the least rectangle of at least ``size`` numbers; walking on until the result is
    below ``size`` makes it a permutation E of those. The result is E(E⁻¹(x) + 1): one cycle through all
    numbers, so none stays, no two meet, and pairs that are known tell nothing of the rest.
    """
    if size < 2:
        return x
    a = math.isqrt(size - 1) + 1
    sides = (a, -(-size // a))
    x = _rounds(key, tag, x, sides, True)
    while x >= size:
        x = _rounds(key, tag, x, sides, True)
    x = _rounds(key, tag, (x + 1) % size, sides, False)
    while x >= size:
        x = _rounds(key, tag, x, sides, False)
    return x


# ---------------------------------------------------------------- forms


@functools.lru_cache(maxsize=100_000)
def script(c: str) -> str:
    return unicodedata.name(c, "?").split()[0]


@functools.lru_cache(maxsize=100_000)
def _class(c: str, name: bool) -> tuple[str, str]:
    """(name of the class, its characters) of a character; those of one class stand for each other."""
    if c.isdigit() and c.isascii():
        return "9", "0123456789"
    for of in LETTERS:
        if c in LETTERS[of]:
            if not name:
                return of, LETTERS[of]
            vowel = c in VOWELS[of]
            return f"{of}{'V' if vowel else 'C'}", "".join(x for x in sorted(set(LETTERS[of])) if (x in VOWELS[of]) == vowel)
    kind = unicodedata.category(c)
    if kind[0] not in "LN":
        return c, c
    if "㐀" <= c <= "鿿" or "가" <= c <= "힣":
        block = range(0x4E00, 0xA000) if "一" <= c <= "鿿" else range(0xAC00, 0xD7A4) if c >= "가" else range(0x3400, 0x4DC0)
    else:
        block = range(ord(c) & ~127, (ord(c) | 127) + 1)
    # Letters of the same script in the same block that a change of case and of form leaves alone.
    fit = "".join(x for x in map(chr, block) if unicodedata.category(x) == kind and script(x) == script(c) and x.lower() == x and unicodedata.normalize("NFKD", x) == unicodedata.normalize("NFKD", x[0]))
    return f"U{block[0]:x}{kind}", fit if c in fit else c


def _in_form(key: bytes, tag: str, item: str, name: bool) -> str:
    """Another value of the same form: digits for digits, vowels for vowels where it is a name, signs kept."""
    classes = [_class(c, name) for c in item]
    size, x = 1, 0
    for c, (_, chars) in zip(item, classes):
        size *= len(chars)
        x = x * len(chars) + chars.index(c)
    x = permuted(key, "\1".join((tag, *(n for n, _ in classes))), x, size)
    out = []
    for _, chars in reversed(classes):
        x, k = divmod(x, len(chars))
        out.append(chars[k])
    return "".join(reversed(out))


def surrogate(key: bytes, kind: str, item: str, gender: str = "") -> str:
    """The surrogate of a part in plain form: of its script and length, and pronounceable where it is a name.

    Parts of one kind have distinct surrogates: within a form by permutation, and forms keep their shape. A full
    given name has a last letter more, by which its gender is read; an item made of signs alone is kept.
    """
    if kind in _LISTS:
        return _LISTS[kind][permuted(key, kind, _LISTS[kind].index(item), len(_LISTS[kind]))] if item in _LISTS[kind] else item
    made = _in_form(key, kind, item, kind in ("given", "surname", "place"))
    ending = ENDINGS.get(script(item[-1])) if kind == "given" and len(item) > 1 else None
    return made + ending[gender] if ending else made


def dressed(plain: str, written: str) -> str:
    """The surrogate in the form of what it replaces: its separators, its case."""
    if any(c.isdigit() for c in written):
        fresh = iter(c for c in plain if c.isalnum())
        text = "".join(next(fresh, "") if c.isalnum() else c for c in written)
        return text.upper() if written.upper() == written else text
    if written.isupper() and len(written) > 1:
        return plain.upper()
    return plain[:1].upper() + plain[1:] if written[:1].isupper() else plain


# ---------------------------------------------------------------- gender


class Endings:
    """Naive Bayes on the last one to three letters of given names."""

    def __init__(self, labelled: Iterable[tuple[str, str]]) -> None:
        self.counts: dict[str, Counter] = {"f": Counter(), "m": Counter()}
        self.all: Counter = Counter()
        for name, gender in labelled:
            self.all[gender] += 1
            self.counts[gender].update(name[-n:] for n in (1, 2, 3))

    def gender(self, name: str) -> str:
        """f or m where one is three times as likely, else none."""
        if not self.all["f"] or not self.all["m"]:
            return ""
        score = 0.0
        for n in (1, 2, 3):
            f, m = ((self.counts[g][name[-n:]] + 0.5) / (self.all[g] + 1) for g in ("f", "m"))
            score += math.log(f / m)
        return "f" if score > math.log(3) else "m" if score < -math.log(3) else ""


def said(evidence: int, mentions: int) -> str:
    """The gender that a name's mentions speak for."""
    return ("f" if evidence > 0 else "m") if abs(evidence) >= max(2, GENDER_SHARE * mentions) else ""


def gender(name: str, evidence: int, mentions: int, endings: Endings) -> str:
    if name in FEMALE or name in MALE:
        return "f" if name in FEMALE else "m"
    return said(evidence, mentions) or endings.gender(name)


# ---------------------------------------------------------------- assignment


def assign(wanted: DataFrame, key: bytes) -> DataFrame:
    """(part_kind, item, surrogate, is_real): the surrogate of each distinct part in (part_kind, item, evidence).

    ``evidence`` is above 0 where a mention speaks for a woman's name, below for a man's, else 0 or null;
    what all mentions say is summed for each part. Names that lists and mentions leave open are
    judged by their endings, from those that are known.

    A part of a form is permuted among all values of the form, so no two parts of a kind have the same
    surrogate and none is its own; a check of all surrogates raises an error otherwise. ``is_real`` tells where
    a surrogate is also a part that occurs, which no assignment can avoid once over half of a form is in use.
    """
    speaks = F.when(F.col("evidence") != 0, 1).otherwise(0)
    parts = cut(wanted.groupBy("part_kind", "item").agg(F.coalesce(F.sum("evidence"), F.lit(0)).cast("int").alias("evidence"), F.sum(speaks).cast("int").alias("mentions")))
    known = parts.where(f"part_kind = 'given' AND abs(evidence) >= greatest(2, {GENDER_SHARE} * mentions)").orderBy(F.xxhash64("item"), "item").limit(GENDER_NAMES)
    labelled = {**{n: "f" for n in FEMALE}, **{n: "m" for n in MALE}}
    labelled |= {r["item"]: said(r["evidence"], r["mentions"]) for r in known.select("item", "evidence", "mentions").collect() if r["item"] not in labelled}
    endings = Endings(labelled.items())

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, items, evidence, mentions = (batch.column(i).to_pylist() for i in range(4))
            made = [surrogate(key, k, x, gender(x, e, m, endings) if k == "given" and len(x) > 1 else "") for k, x, e, m in zip(kinds, items, evidence, mentions)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string())], names=["part_kind", "item", "surrogate"])

    drawn = cut(parts.where("item <> ''").mapInArrow(draw, "part_kind STRING, item STRING, surrogate STRING"))
    again = drawn.groupBy("part_kind", "surrogate").count().where("count > 1")
    if not again.isEmpty():
        raise RuntimeError("two parts have one surrogate")
    real = drawn.select("part_kind", F.col("item").alias("surrogate"), F.lit(True).alias("is_real"))
    return drawn.join(real, ["part_kind", "surrogate"], "left").select("part_kind", "item", "surrogate", F.coalesce("is_real", F.lit(False)).alias("is_real"))
