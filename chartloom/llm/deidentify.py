"""Personal items in free text: where they are, of which kind, and the text with surrogates in their stead."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm import names
from chartloom.llm.surrogates import ONES, STATES, TENS, assign, dressed
from chartloom.session import cut

#: Words of the texts that bear on names, up to which they go to every worker; more are joined to the texts.
SHARED_WORDS = 300_000
#: Letters up to which a word may be a name with slips in it; longer ones are names only as they stand.
LONGEST_TYPO = 40
#: Words that a worker holds before it hands them on.
HELD_WORDS = 200_000

_D = r"[\dOoIl]"

PHONE = re.compile(rf"(?<![\w.#/-])(?:(?:\+\s?1|1)[\s.-]{{1,2}})?(?:\({_D}{{3}}\)\s?|{_D}{{3}}[\s.-]{{1,2}}){_D}{{3}}[\s.-]{_D}{{4}}(?![\w-])|(?<![\w.#/+-])(?:\+?1[\s.-]?)?\({_D}{{3}}\){_D}{{7}}(?!\w)|(?<![\w.#/+-])\+?1?[2-9]{_D}{{9}}(?![\w-])|(?<![\w.#/+-]){_D}{{3}}-{_D}{{4}}(?![\w-])|(?<![\w.#/+-])\+\s?[2-9]\d{{0,2}}(?:[\s.-]{{0,2}}\(?\d{{1,5}}\)?){{2,6}}(?![\w-])")
EMAIL = re.compile(
    r"(?<![\w.+-])([A-Za-z0-9][\w.+'-]*)"
    r"(?:\s?@\s?|\s?[(\[{]\s?at\s?[)\]}]\s?|\s+at\s+(?=[\w-]+\s+dot\s))"
    r"[A-Za-z0-9][\w-]*(?:(?:\s?[(\[{]\s?dot\s?[)\]}]\s?|\s+dot\s+|\.|\s\.\s)[A-Za-z]{2,})+",
    re.IGNORECASE,
)
SOCIAL = re.compile(rf"(?<![\w.#/–-]){_D}{{3}}([-–—.\s]){_D}{{2}}\1{_D}{{4}}(?![\w–-])|(?<![\w#/+–-])\d{_D}{{7}}\d(?![\w–-])")
LICENCE = re.compile(rf"(?<![\w-])[A-Z]{_D}{{3}}-{_D}{{4}}-{_D}{{4}}(?![\w-])")
MEMBER = re.compile(rf"(?<![\w-])[A-Z]{{2,4}}{_D}{{6,10}}(?![\w-])")
RECORD = re.compile(rf"(?<![\w.-])\d{_D}{{5,9}}(?![\w-])")
RECORD_CUE = re.compile(r"(?:\b[mn]{2}r|\bmrn?|\bmr\s?n|med\w*\s+rec\w*|\brecord|\bchart)\W{0,3}(?:\s?(?:no|num|number|nr|id)\b\.?)?\W{0,3}$", re.IGNORECASE)
MEMBER_CUE = re.compile(r"(?:member|plan|subscriber|policy|insur\w*|licen[cs]e|medicaid|medicare)\b[^.;]{0,30}$", re.IGNORECASE)
#: Numbers behind these words name things, not persons.
THING_CUE = re.compile(r"\b(?:lot|accession|specimen|order|claim|file|exhibit|ex|invoice|tracking|batch|case|ref|sample|serial|model|device|kit|docket|ticket|folio|pag\w*)\b[\s.:#]{0,3}(?:(?:no|num|number|nr|id|file)\b[\s.:#]{0,3})?$", re.IGNORECASE)

# Words that end a street's name, and those of an address that stay as they are.
STREETS = "street|st|avenue|ave|road|rd|boulevard|blvd|lane|ln|drive|dr|court|ct|terrace|ter|highway|hwy|place|pl|way|circle|cir|parkway|pkwy|trail|trl|square|sq|loop|alley|pike|turnpike|plaza|crossing|row|path|run"
KEPT = frozenset(STREETS.split("|")) | frozenset("n s e w ne nw se sw north south east west apt unit suite ste no number rural star post office box po p o rr rfd hc route rt r f d h c hundred thousand and st nd rd th".split())
_NUMBER_WORD = rf"(?:(?:{ONES}|{TENS})(?:[\s-](?:{ONES}))?(?:\s(?:hundred|thousand)(?:\s(?:and\s)?(?:{TENS}|{ONES})(?:[\s-](?:{ONES}))?)?)?)"
_NAME = r"(?:(?!(?:the|a|an|of|in|at|to|and|or|with|for|on|by|from|per|was|is|has|views?|minutes?|hours?|days?|weeks?|months?|years?|pounds?|feet|mg|cm|sessions?|repetitions|percent|items|blocks)\b)(?:[A-ZÀ-Ý][\w'’]*\.?|\d{1,3}(?i:st|nd|rd|th)))"
_NAME_CAPS = _NAME.replace("(?:the", "(?i:the")
_HOUSE = rf"(?:\d{{1,6}}[A-Za-z]?(?:-\d{{1,4}})?|(?i:{_NUMBER_WORD}))"
_STREET = rf"(?<![\w.,/#-]){_HOUSE}\s+(?:[NSEW]{{1,2}}\.?\s+)?{_NAME_CAPS}(?:\s+{_NAME_CAPS}){{0,2}}?\s+(?i:{STREETS})\b"
_BOX = r"(?<![\w.])(?i:p\.?\s?o\.?\s?box|post\s+office\s+box|box)\s+(?:no\.?\s+|number\s+|#\s?)?\d[\dO]*"
_ROUTE = r"(?<![\w.])(?i:r\.?\s?r\.?|r\.?\s?f\.?\s?d\.?|h\.?c\.?|rural\s+route|star\s+route|route|rt\.?)\s+(?:no\.?\s+|#\s?)?\d+[A-Za-z]?,?\s+(?i:box)\s+\d[\dO]*"
_CITY = r"(?:,?\s+(?:(?i:apt|unit|suite|ste|#)\.?\s?\w+,?\s+)?[A-ZÀ-Ý][\w'’-]+(?:\s[A-ZÀ-Ý][\w'’-]+)?,?\s+[A-Z]{2}(?:\s+\d{5}(?:-\d{4})?)?\b)?"
ADDRESS = re.compile(rf"(?:{_ROUTE}|{_BOX}|{_STREET}(?:\.(?=,))?){_CITY}")
_PLACES = frozenset(STREETS.split("|")) | {"box"}
_SPOKEN = re.compile(r"[a-z]+").findall
#: What any number has that identifies a person: digits and separators in a row.
_NUMBER = re.compile(rf"\d{_D}*(?:[\s().–—-]{{0,2}}{_D}){{5}}")



def _ranges(categories: str) -> str:
    """A character class of all characters up to U+FFFF of some general categories."""
    wanted, out, begin = categories.split(), [], None
    for n in range(0xC0, 0x10001):
        inside = n < 0x10000 and unicodedata.category(chr(n)) in wanted
        if inside and begin is None:
            begin = n
        elif not inside and begin is not None:
            out.append(f"{chr(begin)}-{chr(n - 1)}")
            begin = None
    return "".join(out)


#: A word that begins with a capital, or with a letter of a script without capitals; marks may follow a letter.
_CAPITAL = re.compile(rf"[A-Z{_ranges('Lu Lt Lo')}][\w\u0300-\u036f{_ranges('Mn Mc')}’'-]*")
_ASCII_CAPITAL = re.compile(r"[A-Z][\w’'-]*")
#: Scripts that write names without a space between words, and the letters of such a name.
_UNSPACED = re.compile(r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]{2,}")
_WHOLE = (2, 6)
_LINK = re.compile(r"\s+")
_COMMA = re.compile(r",\s+")
_INITIAL = re.compile(r"\s+[A-ZÀ-Ý]\.?\s+(?=[A-ZÀ-Ý])")
_TITLES = frozenset("Dr Mr Mrs Ms Miss Prof Sr Sra Srta Doctor Nurse Señor Señora DR MR MRS MS MISS PROF DOCTOR".split())
_INITIAL_BEFORE = re.compile(r"(?<![\w.])([A-ZÀ-Ý]\.(?:\s?[A-ZÀ-Ý]\.)?\s{1,2})$")

# Capitalised words that follow a given name without being a surname, or make an organisation's or a street's name.
NO_SURNAME = frozenset(
    ("the and or per was is has had will reports report denies history patient claimant client individual interpreter referred shares letter form email ssn "
     "community hospital regional medical center centre clinic county memorial heights valley river lake family practice surgical imaging diagnostic behavioral health "
     "neurology group orthopedic associates physical therapy rehabilitation pain spine institute saint ave avenue street st road rd blvd boulevard lane ln drive dr court ct ter "
     "terrace hwy highway way place ridge disease syndrome sign signs test maneuver position catheter score scale procedure fracture january february march april may june july "
     "august september october november december monday tuesday wednesday thursday friday saturday sunday md do phd psyd np pa pt lcsw od dpm rn apt box po rr exhibit page of in on "
     "he she it they his her no not we our this that when while after before with without").split()
)


#: What a word is, as bits: a given name, one edit or a few from one, a surname, a whole name.
GIVEN, NEAR, TYPED, SURNAME, WHOLE = 1, 2, 4, 8, 16


def words_of(full: str) -> Iterator[tuple[str, int]]:
    """(plain word, GIVEN, SURNAME or WHOLE) of a full name: "Given M. Surname[-Surname][, degree]", "Surname, Given",
    or a name in a script that sets no spaces."""
    left, _, right = full.partition(",")
    words = left.split()
    if len(words) == 1 and right.strip():
        first, last = right.split()[0], words[0]
    elif len(words) > 1:
        first, last = words[0], words[-1]
    else:
        if words and _UNSPACED.fullmatch(words[0]) and _WHOLE[0] <= len(words[0]) <= _WHOLE[1]:
            yield names.plain(words[0]), WHOLE
        return
    if given := names.plain(first.strip(".")):
        yield given, GIVEN
    for part in names.plain(last).split("-"):
        if len(part) > 2 or part and not part.isascii():
            yield part, SURNAME


def edits_allowed(given: str) -> int:
    return 1 if len(given) < 5 else 2


class Known(Protocol):
    def __call__(self, word: str) -> int: ...


@dataclass(frozen=True)
class Lexicon:
    """Given names and surnames of lists of full names, and the parts that surnames are made of.

    Serves lists that one machine holds, and tells the tables of ``name_words`` and ``classified`` what is right.
    """

    given: frozenset[str]
    surnames: frozenset[str]
    starts: frozenset[str]
    ends: frozenset[str]
    whole: frozenset[str]

    @classmethod
    def of(cls, full_names: Iterable[str]) -> Lexicon:
        of: dict[int, set[str]] = {GIVEN: set(), SURNAME: set(), WHOLE: set()}
        for full in full_names:
            for word, role in words_of(full):
                of[role].add(word)
        given, surnames = of[GIVEN], of[SURNAME]
        firsts = {g for g in given if (len(g) > 2 or not g.isascii()) and g not in surnames} | set(names.NICKNAMES)
        firsts |= {n for g in list(firsts) for n in names.NICKNAMES.get(g, "").split() if len(n) > 3}
        starts: dict[str, set[str]] = {}
        ends: dict[str, set[str]] = {}
        for s in surnames:
            for k in range(3, len(s) - 2):
                starts.setdefault(s[:k], set()).add(s[k:])
                ends.setdefault(s[k:], set()).add(s[:k])
        return cls(frozenset(firsts), frozenset(surnames), frozenset(p for p, x in starts.items() if len(x) > 1), frozenset(e for e, x in ends.items() if len(x) > 1), frozenset(of[WHOLE]))

    def surname(self, word: str) -> bool:
        """Known, or made of a start and an end that each occur in several known surnames."""
        for part in word.split("-"):
            if part in self.surnames:
                continue
            if len(part) < 6 or not any(part[:k] in self.starts and part[k:] in self.ends for k in range(3, len(part) - 2)):
                return False
        return True

    @functools.lru_cache(maxsize=100_000)  # noqa: B019
    def __call__(self, word: str) -> int:
        flags = GIVEN * (word in self.given) | SURNAME * self.surname(word) | WHOLE * (word in self.whole)
        if 3 < len(word) <= LONGEST_TYPO:
            for g in self.given:
                d = names.distance(word, g, 2)
                flags |= NEAR * (d <= 1 and len(g) > 4 and len(word) > 4) | TYPED * (d <= edits_allowed(g))
        return flags


@dataclass(frozen=True)
class Item:
    kind: str
    start: int
    end: int


def _numbers(text: str, at: list[Item]) -> None:
    for kind, pattern in (("id_number", LICENCE), ("id_number", SOCIAL), ("phone", PHONE), ("id_number", MEMBER), ("id_number", RECORD)):
        for m in pattern.finditer(text):
            a, b = m.span()
            if any(a < x.end and x.start < b for x in at) or sum(c.isdigit() for c in m[0]) < 6:
                continue
            before = text[max(0, a - 40) : a]
            if THING_CUE.search(before):
                continue
            if pattern is RECORD and not RECORD_CUE.search(before):
                continue
            if pattern is MEMBER and not (MEMBER_CUE.search(before) or re.fullmatch(r"[A-Z]{3}\d{7}", m[0])):
                continue
            at.append(Item(kind, a, b))


def _capitals(text: str) -> Iterator[re.Match]:
    return (_ASCII_CAPITAL if text.isascii() else _CAPITAL).finditer(text)


def _bare(word: str) -> str:
    return word.rstrip("'’-")


def words_in(text: str) -> set[str]:
    """All words of a text, in plain form, that ``find`` may ask about."""
    found = {names.plain(_bare(m[0])) for m in _capitals(text)}
    if not text.isascii():
        for m in _UNSPACED.finditer(text):
            found.update(names.plain(m[0][i : i + n]) for n in range(_WHOLE[0], _WHOLE[1] + 1) for i in range(len(m[0]) - n + 1))
    return found


def _names(text: str, known: Known, at: list[Item]) -> None:
    caps = text.isupper()
    taken = sorted((x.start, x.end) for x in at)
    words = [m for m in _capitals(text) if not any(a <= m.start() < b for a, b in taken)]
    end = -1
    for i, m in enumerate(words):
        word = _bare(m[0])
        a = m.start()
        low = names.plain(word)
        flags = known(low)
        if a < end or len(word) < 3 and not flags & GIVEN and not (flags & SURNAME and not low.isascii()):
            continue
        b = a + len(word)
        following = words[i + 1] if i + 1 < len(words) else None
        if flags & GIVEN:
            # Given [I.] Surname
            gap = _INITIAL.match(text, b) or _LINK.match(text, b)
            if gap and following is not None and gap.end() != following.start() and i + 2 < len(words) and gap.end() == words[i + 2].start():
                following = words[i + 2]
            if gap and following is not None and gap.end() == following.start():
                last = _bare(following[0])
                plain = names.plain(last)
                # A word no list holds is a surname by its capital alone, which not all scripts have.
                unlisted = len(last) > 3 and plain not in NO_SURNAME and not caps and (word.isupper() if last.isupper() else last[0].isupper())
                if known(plain) & SURNAME or unlisted:
                    end = following.start() + len(last)
                    at.append(Item("name", a, end))
                    continue
        if flags & SURNAME and low not in NO_SURNAME:
            end = b
            comma = _COMMA.match(text, b)
            if comma and following is not None and comma.end() == following.start():
                first = _bare(following[0])
                if known(names.plain(first)) & (GIVEN | NEAR):
                    end = following.start() + len(first)
            before = _INITIAL_BEFORE.search(text, max(0, a - 8), a)
            # A given name typed wrongly stands before a surname too.
            if before:
                a = before.start(1)
            elif i and _LINK.fullmatch(text, words[i - 1].end(), a) and not caps:
                typed = names.plain(_bare(words[i - 1][0]))
                if len(typed) > 3 and typed not in NO_SURNAME and known(typed) & TYPED:
                    a = words[i - 1].start()
            at.append(Item("name", a, end))
            continue
        if i and words[i - 1][0] in _TITLES and not text[words[i - 1].end() : a].strip(" .\r\n\t") and low not in NO_SURNAME and len(word) > 3 and not flags & GIVEN:
            end = b
            at.append(Item("name", a, b))


def _whole_names(text: str, known: Known, at: list[Item]) -> None:
    """Names in scripts without spaces: at each place the longest that a list holds."""
    for m in _UNSPACED.finditer(text):
        a = m.start()
        while a < m.end() - 1:
            b = next((a + n for n in range(_WHOLE[1], _WHOLE[0] - 1, -1) if a + n <= m.end() and known(names.plain(text[a : a + n])) & WHOLE), None)
            if b and not any(a < x.end and x.start < b for x in at):
                at.append(Item("name", a, b))
            a = b or a + 1


def find(text: str | None, known: Known) -> list[Item]:
    """Personal items of a text in order of place; none overlap. ``known`` tells what a plain word is."""
    if not text:
        return []
    at: list[Item] = []
    spoken = set(_SPOKEN(text.lower()))
    if "@" in text or ("at" in spoken and ("dot" in spoken or re.search(r"[(\[{]\s?at\b", text, re.IGNORECASE))):
        at += [Item("email", *m.span()) for m in EMAIL.finditer(text)]
    if not _PLACES.isdisjoint(spoken):
        at += [Item("address", *m.span()) for m in ADDRESS.finditer(text) if not any(m.start() < x.end and x.start < m.end() for x in at)]
    if _NUMBER.search(text):
        _numbers(text, at)
    if not text.isascii():
        _whole_names(text, known, at)
    _names(text, known, at)
    return sorted(at, key=lambda x: x.start)


_TYPED = re.compile(rf"(?<!\d){_D}{{3}}[\s.–—-]?{_D}{{2}}[\s.–—-]?{_D}{{4}}(?!\d)")


def find_typed(value: str | None) -> list[Item]:
    """Complete social security numbers in a field made for one, whatever stands around them."""
    return [Item("id_number", *m.span()) for m in _TYPED.finditer(value or "") if sum(c.isdigit() for c in m[0]) >= 6]


# ---------------------------------------------------------------- parts

_FEMALE_CUE = re.compile(r"\b(?:mrs|ms|miss|sra|srta|señora|señorita|madam)\.?\s+$", re.IGNORECASE)
_MALE_CUE = re.compile(r"\b(?:mr|sr|señor|sir)\.?\s+$", re.IGNORECASE)
_PRONOUN = re.compile(r"\b(?:(she|her|hers|herself)|he|him|his|himself)\b", re.IGNORECASE)
_STOP = re.compile(r"[.!?](?:\s|$)")
_TOKEN = re.compile(r"\d[\dO]*|[^\W\d_]+")
_ALL_STATES = frozenset(STATES.split("|"))
_ALL_ONES, _ALL_TENS = frozenset(ONES.split("|")), frozenset(TENS.split("|"))


def evidence(text: str, start: int, end: int) -> int:
    """1 where a name stands as a woman's, -1 as a man's: by its title, or by the first pronoun in the rest of its sentence."""
    before = text[max(0, start - 12) : start]
    if _FEMALE_CUE.search(before):
        return 1
    if _MALE_CUE.search(before):
        return -1
    after = text[end : end + 400]
    stop = _STOP.search(after, 1)
    m = _PRONOUN.search(after, 0, stop.start() if stop else len(after))
    return 0 if not m else 1 if m[1] else -1


def parts(kind: str, text: str) -> list[tuple[str, str, int, int]]:
    """(kind of part, its plain form, start, end) of the parts of an item that get surrogates.

    A name's parts are replaced one by one, so a person keeps one surrogate in full and by surname alone.
    Numbers are one part, in the same form whatever separators they are written with. Of an email address the
    part before the host and the host's labels are replaced, but the last; of a postal address all but
    the words that every address has.
    """
    if kind == "name":
        words = [(_bare(m[0]), m.start()) for m in re.finditer(r"[^\W\d_](?:[\w’'-]|[\u0300-\u036f])*", text)]
        swapped = "," in text
        out = []
        for i, (word, a) in enumerate(words):
            last = i == 0 if swapped else i == len(words) - 1
            at = a
            for piece in word.split("-") if last else [word]:
                if piece:
                    out.append(("surname" if last else "given", names.plain(piece), at, at + len(piece)))
                at += len(piece) + 1
        return out
    if kind in ("phone", "id_number"):
        plain = re.sub(r"[\W_]+", "", names.plain(text))
        return [(kind, plain.replace("o", "0") if kind == "phone" or text[:1].isdigit() else plain, 0, len(text))]
    if kind == "email":
        m = re.match(r"[\w.+'-]+", text)
        if not m:
            return []
        labels = [x for x in re.finditer(r"[A-Za-z0-9-]+", text[m.end() :]) if x[0].lower() not in ("at", "dot")][:-1]
        return [("email", names.plain(m[0]), 0, m.end())] + [("host", x[0].lower(), m.end() + x.start(), m.end() + x.end()) for x in labels]
    out = []
    for m in _TOKEN.finditer(text):
        word = names.plain(m[0])
        if m[0].isupper() and word in _ALL_STATES and re.match(r"\W*(?:\d{5}|$)", text[m.end() :]):
            out.append(("state", word, m.start(), m.end()))
        elif word not in KEPT:
            out.append(("number" if word[0].isdigit() else "ones" if word in _ALL_ONES else "tens" if word in _ALL_TENS else "place", word.replace("o", "0") if word[0].isdigit() else word, m.start(), m.end()))
    return out


@dataclass(frozen=True)
class Tables:
    """items: field, record_id, kind, start_char, end_char, parts; surrogates: part_kind, item, surrogate; texts: field, record_id, text."""

    items: DataFrame
    surrogates: DataFrame
    texts: DataFrame


PARTS = "ARRAY<STRUCT<part_kind: STRING, item: STRING, start: INT, end: INT, evidence: INT>>"


# ---------------------------------------------------------------- lexicon, as tables


def _flat(run, columns: int):  # noqa: ANN001, ANN202
    """A function on batches from one that yields rows for each value of the first column."""

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int32(), pa.string())
        for batch in given:
            rows = [r for x in batch.column(0).to_pylist() for r in run(x)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(columns)], names=["word", "role", "key"][:columns])

    return batches


def name_words(lists: list[DataFrame]) -> DataFrame:
    """(word, role): the distinct given names, parts of surnames and whole names in one-column tables of full names."""
    rows = lists[0]
    for more in lists[1:]:
        rows = rows.unionAll(more)
    distinct = rows.toDF("n").where("n <> ''").distinct().mapInArrow(_flat(words_of, 2), "word STRING, role INT")
    roles = distinct.groupBy("word").agg(F.bit_or("role").alias("role"))
    listed = rows.sparkSession.createDataFrame([(g, s) for g, short in names.NICKNAMES.items() for s in ["", *short.split()]], "given STRING, short STRING")
    given = roles.where(f"role & {GIVEN} <> 0 AND role & {SURNAME} = 0 AND (length(word) > 2 OR word RLIKE '[^\\x00-\\x7f]')").select("word")
    # A listed name is a given name, and so are the longer of its short forms, whether a list holds it or not.
    always = listed.select(F.explode(F.array("given", F.when(F.length("short") > 3, F.col("short")).otherwise(F.col("given")))).alias("word"))
    return cut(given.unionAll(always).distinct().select("word", F.lit(GIVEN).alias("role")).unionAll(roles.where(f"role & {SURNAME + WHOLE} <> 0").select("word", F.col("role").bitwiseAND(F.lit(SURNAME + WHOLE)).cast("int").alias("role"))).groupBy("word").agg(F.bit_or("role").alias("role")))


def _near_keys(word: str) -> Iterator[tuple[str, int, str]]:
    if 3 <= len(word) <= LONGEST_TYPO + 2:
        for key in names.deletions(word, 2):
            yield word, 0, key


def classified(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, flags) of the distinct words that the lexicon knows, or that are near its given names or made
    of parts of its surnames; the same bits as those of ``Lexicon``.

    All by joins: words and given names meet in what is left of them without up to two letters.
    """
    has = lambda bit: f"role & {bit} <> 0"
    listed = words.join(lexicon.where(has(GIVEN + WHOLE)).select("word", F.col("role").bitwiseAND(F.lit(GIVEN + WHOLE)).cast("int").alias("bits")), "word")

    # Surnames: each part is known, or begins and ends as several known ones do.
    surnames = lexicon.where(has(SURNAME)).select(F.col("word").alias("part"))
    pieces = words.select("word", F.explode(F.split("word", "-")).alias("part"))
    splits = lambda df: df.select("part", F.explode(F.expr("CASE WHEN length(part) >= 6 THEN sequence(3, length(part) - 3) END")).alias("k")).select("part", F.expr("left(part, k)").alias("start"), F.expr("substring(part, k + 1)").alias("rest"))
    known = splits(surnames)
    starts = known.groupBy("start").agg(F.min("rest").alias("a"), F.max("rest").alias("b")).where("a <> b").select("start")
    ends = known.groupBy("rest").agg(F.min("start").alias("a"), F.max("start").alias("b")).where("a <> b").select("rest")
    made = splits(pieces.select("part").distinct()).join(starts, "start").join(ends, "rest").select("part")
    fit = surnames.unionAll(made).distinct().withColumn("ok", F.lit(True))
    surname = pieces.join(fit, "part", "left").groupBy("word").agg(F.every(F.coalesce("ok", F.lit(False))).alias("ok")).where("ok").select("word", F.lit(SURNAME).alias("bits"))

    # Given names with slips in them.
    keyed = lambda df: df.select("word").mapInArrow(_flat(_near_keys, 3), "word STRING, role INT, key STRING").drop("role")
    met = keyed(words.where(f"length(word) BETWEEN 4 AND {LONGEST_TYPO}")).join(keyed(lexicon.where(has(GIVEN))).withColumnRenamed("word", "given"), "key").select("word", "given").distinct()

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for word, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                d = names.distance(word, g, 2)
                bits.append(NEAR * (d <= 1 and len(g) > 4 and len(word) > 4) | TYPED * (d <= edits_allowed(g)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.int32())], names=["word", "bits"])

    near = met.mapInArrow(judged, "word STRING, bits INT").where("bits <> 0")
    return listed.unionAll(surname).unionAll(near).groupBy("word").agg(F.bit_or("bits").alias("flags"))


def _all_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: set[str] = set()

    def handed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string())], names=["word"])
        held.clear()
        return out

    for batch in batches:
        for text in batch.column(0).to_pylist():
            held |= words_in(text)
            if len(held) > HELD_WORDS:
                yield handed()
    yield handed()


def _read(fields: list, ids: pa.RecordBatch, texts: list, known_of, typed: tuple[str, ...]) -> pa.RecordBatch:  # noqa: ANN001
    struct = pa.struct([("part_kind", pa.string()), ("item", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("evidence", pa.int32())])
    at, kinds, starts, ends, inner = [], [], [], [], []
    for i, text in enumerate(texts):
        for x in find_typed(text) if fields[i] in typed else find(text, known_of(i)):
            at.append(i)
            kinds.append(x.kind)
            starts.append(x.start)
            ends.append(x.end)
            cue = evidence(text, x.start, x.end) if x.kind == "name" else 0
            inner.append([{"part_kind": k, "item": s, "start": a + x.start, "end": b + x.start, "evidence": cue if k == "given" else 0} for k, s, a, b in parts(x.kind, text[x.start : x.end])])
    rows = ids.take(pa.array(at, pa.int64()))
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(inner, pa.list_(struct))], names=["field", "record_id", "kind", "start_char", "end_char", "parts"])


FOUND = f"field STRING, record_id BIGINT, kind STRING, start_char INT, end_char INT, parts {PARTS}"


def detect(texts: DataFrame, lexicon: DataFrame, typed: tuple[str, ...] = ("ssn",), shared_words: int = SHARED_WORDS) -> DataFrame:
    """(field, record_id, kind, start_char, end_char, parts) of every personal item in (field, record_id, text).

    ``lexicon`` is a table of ``name_words``, of any size. All distinct words of the texts that may belong to names
    are held against it on the cluster. Words that it bears on go to every worker where they are at
    most ``shared_words``; else they are joined to their texts. Both ways find the same.

    Fields named in ``typed`` hold a social security number as somebody wrote it. Null and empty texts
    have no items; texts of any length are read whole. Repeated rows give repeated items.
    """
    spark = texts.sparkSession
    rows = texts.select("field", F.col("record_id").cast("long").alias("record_id"), "text").where("record_id IS NOT NULL AND text <> ''")
    written = rows.where(~F.col("field").isin(*typed)) if typed else rows
    words = cut(written.select("text").mapInArrow(_all_words, "word STRING").where("word <> ''").distinct())
    flags = cut(classified(words, lexicon))
    if flags.limit(shared_words + 1).count() <= shared_words:
        shared = spark.sparkContext.broadcast({r["word"]: r["flags"] for r in flags.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = functools.partial(_looked_up, shared.value)
            for batch in batches:
                yield _read(batch.column(0).to_pylist(), batch.select([0, 1]), batch.column(2).to_pylist(), lambda i: known, typed)

        return rows.mapInArrow(run, FOUND)

    # The words of each text, by the hash of the text, so that copies are looked up once.
    def own_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(h, w) for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in words_in(text)]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.binary()), pa.array([w for _, w in found], pa.string())], names=["h", "word"])

    hashed = written.select(F.unhex(F.md5("text")).alias("h"), "text").dropDuplicates(["h"])
    of_text = hashed.mapInArrow(own_words, "h BINARY, word STRING").join(flags, "word").groupBy("h").agg(F.collect_list(F.struct("word", "flags")).alias("known"))
    joined = rows.withColumn("h", F.unhex(F.md5("text"))).join(of_text, "h", "left").select("field", "record_id", "text", "known")

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(3).to_pylist()
            yield _read(batch.column(0).to_pylist(), batch.select([0, 1]), batch.column(2).to_pylist(), lambda i: functools.partial(_looked_up, {x["word"]: x["flags"] for x in own[i] or ()}), typed)  # noqa: B023

    return joined.mapInArrow(run_joined, FOUND)


def _looked_up(flags: dict[str, int], word: str) -> int:
    return flags.get(word, 0)


def deidentify(texts: DataFrame, lexicon: DataFrame, key: bytes, typed: tuple[str, ...] = ("ssn",), shared_words: int = SHARED_WORDS) -> Tables:
    """Items of all texts and the surrogates of their parts. ``key`` is the secret of the surrogates: the same key gives
    a part the same surrogate in any text and run, but for the last letter of a given name whose gender other texts tell."""
    found = cut(detect(texts, lexicon, typed, shared_words).dropDuplicates(["field", "record_id", "kind", "start_char"]))
    surrogates = assign(found.select(F.explode("parts").alias("p")).select("p.part_kind", "p.item", "p.evidence"), key)
    return Tables(found, surrogates, texts)


def items(tables: Tables) -> DataFrame:
    """(field, record_id, kind, start_char, end_char, parts): the items, each part with its surrogate."""
    exploded = tables.items.select("field", "record_id", "kind", "start_char", "end_char", F.explode_outer("parts").alias("p")).select("field", "record_id", "kind", "start_char", "end_char", "p.part_kind", "p.item", "p.start", "p.end")
    joined = exploded.join(tables.surrogates.drop("is_real"), ["part_kind", "item"], "left")
    return joined.groupBy("field", "record_id", "kind", "start_char", "end_char").agg(F.sort_array(F.collect_list(F.when(F.col("item").isNotNull(), F.struct("start", "end", "part_kind", "surrogate")))).alias("parts"))


def replaced(tables: Tables) -> DataFrame:
    """(field, record_id, n_items, redacted, pseudonymized) of every text with items: typed placeholders, and surrogates, in their stead."""
    by_text = items(tables).groupBy("field", "record_id").agg(F.sort_array(F.collect_list(F.struct("start_char", "end_char", "kind", "parts"))).alias("items"))
    rows = tables.texts.select("field", F.col("record_id").cast("long").alias("record_id"), "text").where("record_id IS NOT NULL AND text <> ''").dropDuplicates(["field", "record_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masked, dressed_up = [], []
            for text, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b, at = [], [], 0
                for x in found:
                    a += [text[at : x["start_char"]], f"[{x['kind'].upper()}]"]
                    for p in x["parts"]:
                        b += [text[at : p["start"]], dressed(p["surrogate"], text[p["start"] : p["end"]])]
                        at = p["end"]
                    b.append(text[at : x["end_char"]])
                    at = x["end_char"]
                masked.append("".join(a) + text[at:])
                dressed_up.append("".join(b) + text[at:])
            counts = pa.array([len(x) for x in batch.column(3).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts, pa.array(masked, pa.string()), pa.array(dressed_up, pa.string())], names=["field", "record_id", "n_items", "redacted", "pseudonymized"])

    joined = rows.join(by_text, ["field", "record_id"]).select("field", "record_id", "text", "items")
    return joined.mapInArrow(run, "field STRING, record_id BIGINT, n_items INT, redacted STRING, pseudonymized STRING")
