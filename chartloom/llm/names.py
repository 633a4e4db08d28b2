"""Names of persons and organisations as people type them: parsing, comparing, and reading one as another."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

#: Letters up to which words are compared with slips; longer ones count as they stand.
LONGEST = 40

# Words that name nobody, titles, degrees, words around organisations' names.
FILLERS = frozenset(
    "n/a|na|n.a.|none|nil|null|unknown|unknown provider|unknown facility|unknown location|not specified|unspecified|not stated|not available|"
    "not listed|not recorded|not given|no provider|provider|see above|see below|see chart|as above|same|same as above|same provider|illegible|"
    "unreadable|unclear|various|multiple|other|pending|tbd|tba|to be determined|blank|signature illegible|on file|staff|self|?|??|x|xx|xxx".split("|")
)
TITLES = frozenset("dr doctor mr mrs ms miss prof professor sra srta senor senora".split())
DEGREES = frozenset("md do phd psyd np pa pac pt lcsw od dpm rn dds dmd lpc lmft msw crnp fnp aprn otr dpt ot slp bcba edd mph jd cnp".split())
AROUND = frozenset("the at of and inc llc llp pc pllc ltd corp outpatient inpatient main campus".split())

# Short forms of given names.
NICKNAMES = {
    "abigail": "abby abbie gail", "alexander": "alex al sandy xander sasha", "andrew": "andy drew", "anthony": "tony ant", "barbara": "barb babs",
    "benjamin": "ben benny benji", "catherine": "cathy cate kate", "charles": "chuck charlie chas", "christopher": "chris topher kit", "cynthia": "cindy",
    "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie debby", "donald": "don donny", "dorothy": "dot dottie", "edward": "ed eddie ted ned",
    "eleanor": "ellie nell nora elly", "elizabeth": "liz beth betty lizzie eliza betsy libby bess", "florence": "flo flossie florrie", "frances": "fran frannie frankie fanny",
    "francisco": "frank paco pancho cisco", "gerald": "gerry jerry", "gideon": "gid", "gregory": "greg gregg", "guadalupe": "lupe lupita", "harriet": "hattie harri",
    "henry": "hank harry hal", "imani": "mani", "irene": "rene renie", "jacqueline": "jackie jacky jacqui", "james": "jim jimmy jamie", "jennifer": "jen jenny jenn",
    "john": "jack johnny", "joseph": "joe joey jo", "judith": "judy judi", "katherine": "kathy kate katie kat kay kitty kathie", "kenneth": "ken kenny",
    "lawrence": "larry lars", "leonard": "len lenny leo", "lucia": "lucy", "margaret": "peggy maggie meg marge margie peg", "mateo": "teo", "matthew": "matt matty",
    "michael": "mike mick mickey", "nathaniel": "nate nat nathan", "nicholas": "nick nicky", "oluwa": "olu", "patricia": "pat patty tricia trish patti", "philip": "phil pip",
    "quentin": "quent", "raymond": "ray", "rebecca": "becky becca", "richard": "rick dick rich ricky richie", "robert": "bob bobby rob robbie bert", "ronald": "ron ronny",
    "samuel": "sam sammy", "stephen": "steve", "steven": "steve stevie", "susan": "sue susie suzy", "theodore": "ted teddy theo", "thomas": "tom tommy", "timothy": "tim timmy",
    "victoria": "vicky vicki tori vic", "walter": "walt wally", "william": "bill billy will willie liam", "ximena": "xime mena",
}
_NICK = {full: tuple(short.split()) for full, short in NICKNAMES.items()}

# Short forms of words in organisations' names that don't follow from their letters.
SHORT_FORMS = {"dx": "diagnostic", "tx": "therapy", "co": "county", "st": "saint", "ste": "saint", "mt": "mount", "ft": "fort", "xray": "imaging", "pt": "physical", "bh": "behavioral"}
# Other spellings of such words.
ALSO_SPELLED = {"center": "centre", "behavioral": "behavioural", "orthopedic": "orthopaedic", "pediatric": "paediatric", "gynecology": "gynaecology"}

_APART = re.compile(r"[^a-z0-9]+")
_DOTTED = re.compile(r"\b((?:[a-z]\.\s?){1,5}[a-z])\b\.?")
_STRAY_DOT = re.compile(r"(?<=[a-z][a-z])\.(?=[a-z]\b)")
_SPACED_CREDENTIAL = re.compile(r"\bpa\s*-\s*c\b")


def plain(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    bare = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return bare if bare.isascii() else unicodedata.normalize("NFC", bare)


def names_nobody(value: str | None) -> bool:
    """Null, empty, without letters, or a filler."""
    if value is None:
        return True
    text = " ".join(value.lower().split()).strip(" .-–—()[]*_/:;,")
    return text in FILLERS or " ".join(value.lower().split()) in FILLERS or not any(c.isalpha() for c in text)


def _read(token: str) -> str:
    """Undoes digits that scanning put in place of letters."""
    return token.replace("1", "l").replace("0", "o").replace("5", "s") if any(c.isalpha() for c in token) else token


@functools.lru_cache(maxsize=200_000)
def tokens(value: str) -> tuple[str, ...]:
    text = _SPACED_CREDENTIAL.sub("pac", plain(value).replace("'", "").replace("’", ""))
    text = _STRAY_DOT.sub("", text)
    text = _DOTTED.sub(lambda m: m[1].replace(".", "").replace(" ", "") if "." in m[1] else m[0], text)
    return tuple(_read(t) for t in _APART.split(text) if t)


def squeezed(word: str) -> str:
    """Without the usual confusions of scanning and typing: rn for m, doubled letters."""
    word = word.replace("rn", "m").replace("vv", "w")
    return re.sub(r"(.)\1+", r"\1", word)


@functools.lru_cache(maxsize=400_000)
def distance(a: str, b: str, most: int = 3) -> int:
    """Edits (insert, delete, replace, swap of neighbors) between two words, or most + 1."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(max(len(a), len(b)), most + 1)
    older: list[int] = []
    old = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        older, old = old, row
    return min(old[-1], most + 1)


def close(a: str, b: str, most: int = 2) -> float:
    """Edits between words as read, less where only a usual confusion stands between them."""
    d = distance(a, b, most + 1)
    if d > 0:
        s, t = squeezed(a), squeezed(b)
        if (e := distance(s, t, most + 1)) < d:
            d = max(e, 0.5)
    return d


def deletions(word: str, most: int = 1) -> set[str]:
    """The word and all that up to ``most`` deletions leave of it: words within ``most`` edits share one."""
    found = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        found = found | last
    return found


def same_given(typed: str, full: str) -> float | None:
    """Cost of reading a typed given name as the full one; None where it can't be."""
    if typed == full:
        return 0.0
    nicks = _NICK.get(full, ())
    if typed in nicks:
        return 0.1
    d = close(typed, full, 2)
    if d <= (1 if len(full) <= 4 else 2):
        return 0.3 + 0.3 * d
    if any(len(n) >= 4 and distance(typed, n, 1) <= 1 for n in nicks):
        return 0.7
    if len(typed) >= 3 and any(len(n) == 3 and distance(typed, n, 1) <= 1 and typed[0] == n[0] for n in nicks):
        return 0.9
    if len(typed) >= 4 and full.startswith(typed):
        return 0.6
    return None


@dataclass(frozen=True)
class Person:
    given: str
    middle: str
    surname: str
    degree: str

    def read(self, rest: tuple[str, ...]) -> float | None:
        """Cost of reading the words beside the surname as this person's; None where they name another."""
        words = [t for t in rest if t not in TITLES]
        cost = 0.0
        at = max((i for i, t in enumerate(words) if t in DEGREES), default=-1)
        # A degree's letters alone beside the surname may be the initials.
        if at >= 0 and not (len(words) == 1 and len(words[0]) == 2 and words[0] != self.degree):
            cost += 0.6 if self.degree and words[at] != self.degree else 0.0
            words = words[:at] + words[at + 1 :]
        names = [t for t in words if len(t) > 2 or (len(t) == 2 and (t == self.given or t in _NICK.get(self.given, ())))]
        initials = "".join(t for t in words if t not in names)
        if not names:
            if not initials:
                return cost + 1.2
            if initials[0] != self.given[:1]:
                if not any(n[0] == initials[0] for n in _NICK.get(self.given, ())):
                    return None
                cost += 0.2
            if len(initials) > 1 and self.middle and initials[1] != self.middle:
                return None
            return cost + (0.2 if len(initials) > 1 and self.middle else 0.5)
        read = same_given(names[0], self.given)
        if read is None and len(names) > 1:
            read = same_given(names[1], self.given)
        if read is None:
            return None
        if len(names) > 2:
            return None
        if initials and self.middle and initials[0] != self.middle:
            return None
        if len(names) == 2 and not initials:
            other = names[1] if same_given(names[0], self.given) is not None else names[0]
            if self.middle and other[0] != self.middle:
                return None
            cost += 0.3
        return cost + read


# ---------------------------------------------------------------- organisations


def organisation_words(value: str) -> tuple[str, ...]:
    """The words that name an organisation, short forms written out; "Clinic of X" counts as "X Clinic"."""
    read = list(tokens(value))
    if "of" in read[1:-1]:
        at = read.index("of", 1)
        read = read[at + 1 :] + read[:at]
    while read and read[-1] in ("co", "company"):
        read.pop()
    return tuple(w for w in (SHORT_FORMS.get(t, t) for t in read) if w not in AROUND and not w.isdigit())


@functools.lru_cache(maxsize=200_000)
def abbreviates(typed: str, word: str) -> float | None:
    """Cost of reading a typed word as a word of an organisation's name; None where it can't be."""
    if typed == word:
        return 0.0
    d = min(close(typed, w, 2) for w in (word, ALSO_SPELLED.get(word, word)))
    if d <= (2 if len(word) >= 7 else 1) and len(typed) >= 4:
        return 0.2 * d
    short = squeezed(typed)
    if len(typed) >= 2 and typed[0] == word[0] and len(typed) < len(word):
        rest = iter(squeezed(word))
        if all(c in rest for c in short):
            return 0.1
        if len(typed) >= 4 and any(distance(short, squeezed(word)[:n], 1) <= 1 for n in range(3, min(len(word), len(short) + 2))):
            return 0.3
        if len(typed) >= 3:
            for skip in range(1, len(short)):
                rest = iter(squeezed(word))
                if all(c in rest for c in short[:skip] + short[skip + 1 :]):
                    return 0.4
    return None


@dataclass(frozen=True)
class Organisation:
    words: tuple[str, ...]

    @property
    def place(self) -> int:
        """Position of the word that tells it from others: the first that isn't Saint."""
        return 1 if len(self.words) > 2 and self.words[0] == "saint" else 0

    @property
    def acronym(self) -> str:
        return "".join(w[0] for w in self.words)

    def read(self, typed: tuple[str, ...]) -> float | None:
        if len(typed) != len(self.words):
            return None
        cost = 0.0
        for i, (t, w) in enumerate(zip(typed, self.words)):
            if i == self.place:
                c = same_place(t, w)
            elif w == "saint":
                c = 0.0 if t == "saint" else 0.2 if close(t, w, 2) <= 1 else None
            else:
                c = abbreviates(t, w)
            if c is None:
                return None
            cost += c
        return cost


@functools.lru_cache(maxsize=200_000)
def same_place(typed: str, place: str) -> float | None:
    """One slip of the hand, or two that aren't both replaced letters: those make another place's name."""
    d = close(typed, place, 2)
    if d <= 1:
        return 0.3 * d
    if d <= 2 and len(place) >= 7 and not (len(typed) == len(place) and sum(a != b for a, b in zip(typed, place)) == 2 and sorted(typed) != sorted(place) and not _swapped(typed, place)):
        return 0.8
    return None


def _swapped(a: str, b: str) -> bool:
    at = [i for i, (x, y) in enumerate(zip(a, b)) if x != y]
    return len(at) == 2 and at[1] == at[0] + 1 and a[at[0]] == b[at[1]] and a[at[1]] == b[at[0]]


# ---------------------------------------------------------------- reading a value as an entity


@functools.lru_cache(maxsize=100_000)
def person(canonical: str) -> Person | None:
    words = [t for t in tokens(canonical) if t not in TITLES]
    degree = words.pop() if len(words) > 1 and words[-1] in DEGREES else ""
    if len(words) < 2:
        return None
    if "," in canonical and tokens(canonical.split(",")[0]) and len(tokens(canonical.split(",")[0])) == 1 and not degree:
        words = words[1:] + words[:1]
    middle = words[1][0] if len(words) > 2 else ""
    return Person(words[0], middle, words[-1], degree)


@functools.lru_cache(maxsize=100_000)
def organisation(canonical: str) -> Organisation | None:
    words = organisation_words(canonical)
    return Organisation(words) if words else None


@functools.lru_cache(maxsize=20_000)
def near(word: str) -> frozenset[str]:
    """What slips of up to two letters leave of a word that is known; others meet it there."""
    return frozenset(deletions(word, 2) | deletions(squeezed(word), 1)) if len(word) <= LONGEST else frozenset((word,))


@functools.lru_cache(maxsize=100_000)
def typed_near(word: str, left_out: int) -> frozenset[str]:
    if left_out == 0 or len(word) > LONGEST:
        return frozenset((word, squeezed(word)))
    return frozenset(deletions(word, left_out) | deletions(squeezed(word), 1))


@functools.lru_cache(maxsize=200_000)
def step(word: str, target: str) -> int | None:
    """Letters to be left out of a word until it meets a known one; None where more than two."""
    return next((n for n in (0, 1, 2) if not near(target).isdisjoint(typed_near(word, n))), None)


@dataclass(frozen=True)
class Value:
    """A value as typed, taken apart."""

    words: tuple[str, ...]
    named: tuple[str, ...]
    last: int

    @property
    def surnames(self) -> list[tuple[int, str]]:
        return [(i, w) for i, w in enumerate(self.words) if len(w) >= 2]

    @property
    def places(self) -> list[str]:
        return [w for w in self.named[:2] if len(w) >= 4] if len(self.named) > 1 else []

    @property
    def acronym(self) -> str:
        return self.words[0] if len(self.words) == 1 and 3 <= len(self.words[0]) <= 6 else ""

    @property
    def begun(self) -> str:
        """The last word, where it may be the start of a surname cut off."""
        return self.words[self.last] if self.last > 0 and len(self.words[self.last]) >= 3 else ""

    def without(self, i: int) -> tuple[str, ...]:
        return self.words[:i] + self.words[i + 1 :]


@functools.lru_cache(maxsize=50_000)
def value(typed: str) -> Value:
    words = tuple(t for t in tokens(typed) if t not in TITLES)
    return Value(words, organisation_words(typed), max((i for i, t in enumerate(words) if t not in DEGREES), default=-1))


def entity_keys(kind: str, canonical: str) -> Iterator[str]:
    """Blocks that an entity enters."""
    if kind == "person":
        if p := person(canonical):
            yield from (f"s:{k}" for k in near(p.surname))
            for n in range(3, len(p.surname)):
                start = p.surname[:n]
                yield from (f"b:{k}" for k in (deletions(start) if 4 < n <= LONGEST else (start,)))
    elif o := organisation(canonical):
        yield from (f"o:{k}" for k in near(o.words[o.place]))
        yield f"a:{o.acronym}"


def value_keys(typed: str) -> set[str]:
    """Blocks that a value enters: it meets all entities there that it may be read as."""
    v = value(typed)
    keys = {f"s:{k}" for _, w in v.surnames for k in (typed_near(w, 2) if len(w) >= 5 else (w,))}
    keys |= {f"o:{k}" for w in v.places for k in typed_near(w, 2)}
    if v.acronym:
        keys.add(f"a:{v.acronym}")
    if v.begun:
        keys |= {f"b:{k}" for k in (deletions(v.begun) if 4 < len(v.begun) <= LONGEST else (v.begun,))}
    return keys


def read(typed: str, kind: str, canonical: str) -> tuple[int, float] | None:
    """(letters left out, cost) of reading a value as an entity; None where it can't be.

    The surname, or the place of an organisation, is looked for as it stands, then with one and two letters
    left out. Words of up to four letters are surnames only as they stand, and beside something that fits.
    """
    v = value(typed)
    found: dict[int, float] = {}

    def keep(n: int | None, cost: float | None) -> None:
        if n is not None and cost is not None:
            found[n] = min(cost, found.get(n, 99.0))

    if kind != "person":
        if o := organisation(canonical):
            if v.acronym and v.acronym == o.acronym:
                keep(0, 0.5)
            for place in v.places:
                if (n := step(place, o.words[o.place])) is not None:
                    keep(n, o.read(v.named))
    elif p := person(canonical):
        for i, word in v.surnames:
            if len(word) < 5:
                if word == p.surname and (beside := p.read(v.without(i))) is not None and beside < 1.2:
                    keep(0, beside)
            elif (n := step(word, p.surname)) is not None and (d := close(word, p.surname, 2)) <= 2:
                beside = p.read(v.without(i))
                keep(n, None if beside is None else 0.5 * d + beside)
        if v.begun and len(v.begun) <= len(p.surname):
            begun = v.begun
            d = 0 if p.surname.startswith(begun) else min(close(begun, p.surname[:n], 1) for n in range(max(3, len(begun) - 1), len(begun) + 2))
            if d <= 1 and (beside := p.read(v.without(v.last))) is not None and beside < 1:
                keep(1, 0.9 + 0.5 * d + beside)
    first = min(found, default=None)
    return None if first is None else (first, found[first])
