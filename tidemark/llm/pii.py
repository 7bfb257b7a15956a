"""Operator 9: personal data becomes type-consistent surrogates.

Each entity is mapped by a keyed bijection within its own type and form, so equal
entities get equal surrogates in every document (coreference) and distinct ones
get distinct ones over the whole corpus (distinctness), with no table of entities
to join and nothing that depends on a document's other entities:

* The digits of a phone, card, account or social security number, the octets or groups
  of an address, and the letters and digits of a mailbox are permuted within their
  form. A permutation is f^-1(f(x) + 1) for a keyed Feistel network f: a single cycle,
  so no value is its own surrogate. Values that a type excludes are stepped over along
  the cycle, which leaves a permutation of the others: the collision check. Forms of more
  than 256 bits are permuted as rows of symbols, in time linear in their length.
* A common name (``NAMES``: given names by script and gender, surnames) becomes one of
  the rarer names of its kind (``STAND_INS``). Any other name is numbered among all names
  up to its length, the number permuted within the length and spelled as syllables of its
  script before its own last letter, which carries gender. No stand-in is such a word,
  names with letters beyond the script's are permuted letter by letter, and so are those of
  more than 256 bits, which get a doubled consonant before their last letter: images of
  the four ways never meet.

Kept as they are: separators, letter case, country codes and trunk zeros, the script of
digits, a card's first digit (two of cards that start with 2) and whether its check
digit holds, an account's country and its valid check digits, an IPv6 address's first
group (its surrogate is written in the short form), private and public address ranges,
mail domains reserved for examples, top-level domains, a name's script and title.
Mentions that differ only in case or separators get the same surrogate.

Persons are found after a title, by a given name of the stock before a capitalised
word, and wherever the document repeats a word so found; a given name that is a stand-in counts
only in a document where a person is found otherwise. Of the words after the first,
those that the document also has in lower case end the name; a name in capitals ends after two words. Names in scripts without
letter case stay.

The key comes from ``spark.tidemark.surrogates.key``; where that is unset, it is drawn
once for each driver process, so that runs that have to agree must set it.

Cases: null texts stay null; empty texts stay empty; long texts are scanned whole,
in time linear in their length; repeated rows get equal texts; an empty table
gives no rows; other columns are carried by the stage and ignored by the query.
"""

from __future__ import annotations

import re
import secrets
from hashlib import blake2b, sha256, shake_256
from ipaddress import IPv6Address
from math import isqrt, log2

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, per_row, table

KEY_SETTING = "spark.tidemark.surrogates.key"
ROUNDS = 6
KINDS = ["email", "phone", "card", "iban", "ip", "ssn", "person"]

# What starts a person's name, the letters of the scripts, and common names.
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Professor", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Mlle", "Señor", "Señora", "Sr", "Sra", "Signor", "Signora", "Господин", "Госпожа", "Κύριος", "Κυρία"]
CLASSES = ["aeiou", "bcdfghjklmnpqrstvwxyz", "0123456789", "àâäáãåæèéêëìíîïòóôöõøœùúûü", "çñßýÿ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ"]
NAMES = {
    "men": "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Peter Paul Hans Jürgen Pierre Juan José Luca Ahmed Wei Raj Ivan",
    "women": "Mary Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Anna Emma Alice Laura Julia Ann Ursula Monika Claire Sophie Carmen Giulia Fatima Mei Priya",
    "surnames": "Smith Johnson Williams Brown Jones Miller Davis Garcia Wilson Anderson Taylor Martin Lee Thompson Müller Schmidt Dubois García Rossi Zhang Wang Kim Tanaka Singh",
    "men, Cyrillic": "Иван Пётр Алексей Дмитрий",
    "women, Cyrillic": "Анна Мария Елена Ольга",
    "surnames of men, Cyrillic": "Иванов Петров Смирнов Кузнецов",
    "surnames of women, Cyrillic": "Иванова Петрова Смирнова Кузнецова",
    "men, Greek": "Γιώργος Νίκος",
    "women, Greek": "Μαρία Ελένη",
}
STAND_INS = {
    "men": "Adrian Basil Cedric Desmond Edgar Felix Gilbert Harvey Irving Jasper Lionel Malcolm Neville Oswald Percy Quentin Rupert Silas Tobias Ulrich Vernon Wilbur Xavier Yorick",
    "women": "Agatha Beatrix Cordelia Delphine Edith Flora Gwendolyn Hester Imogen Josephine Leonora Mabel Nerissa Ottilie Penelope Rosalind Sybil Thelma Unity Viola Winifred Yvette Zelda Astrid",
    "surnames": "Abernathy Blackwood Carrington Dunmore Ellsworth Fairfax Galloway Hawthorne Ingram Jessop Kingsley Lockhart Merriweather Northcott Osgood Pemberton Quimby Ravenscroft Silverton Thackeray Underhill Vandermeer Whitlock Yardley",
    "men, Cyrillic": "Аркадий Всеволод Григорий Ярослав",
    "women, Cyrillic": "Августа Варвара Клавдия Прасковья",
    "surnames of men, Cyrillic": "Быстров Звонарёв Лаптев Шустов",
    "surnames of women, Cyrillic": "Быстрова Звонарёва Лаптева Шустова",
    "men, Greek": "Λεωνίδας Φώτης",
    "women, Greek": "Ισμήνη Φρόσω",
}
#: Words between a title and a name.
PARTICLES = ["van", "von", "der", "den", "de", "la", "le", "di", "da", "del", "dos", "ter", "ten", "bin", "al"]
RESERVED, RESERVED_TOPS = ("example.com", "example.org", "example.net"), ("example", "test", "invalid")
#: Bits up to which a form's values are numbered.
NUMBERED = 256

_CLASS_OF = {c: group for group in CLASSES for c in group}
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![A-Za-z0-9-])"
PHONE = (
    r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?\(0\)[ .-]?[0-9]{1,5}(?:[ .-][0-9]{2,4}){1,4}|(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|(?:\+1[ .-])?[2-9][0-9]{2}[ .-][0-9]{3}[ .-][0-9]{4}"
    r"|\+(?=(?:[0-9][ .-]?){7,15}(?![0-9]))[0-9]{1,3}[ .-][0-9]{1,4}(?:[ .-][0-9]{2,4}){1,5}|\+[0-9]{8,15}|(?=(?:[0-9]\x20?){9,11}(?![ ]?[0-9]))0[1-9][0-9]{0,3}(?:\x20[0-9]{2,4}){2,4})(?![0-9])"
)
CARD = (
    r"(?<![\w.+-])(?:[0-9]{4}(?:[ -]?[0-9]{4}){3}|(?:[3-6][0-9]{3}|2[2-7][0-9]{2})(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}"
    r"|3[0-9]{3}[ -][0-9]{6}[ -][0-9]{4,5})(?![\w]|[.-][0-9])"
)
IBAN = r"(?<![\w-])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![\w-])"
IP = r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\w]|\.[0-9])"
_HEX = r"[0-9A-Fa-f]{1,4}"
IP6 = rf"(?<![\w:.])(?=[0-9A-Fa-f]{{1,4}}:)(?:(?:{_HEX}:){{7}}{_HEX}|{_HEX}(?::{_HEX}){{0,6}}::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?!\w|:[\w:]|\.[0-9])"
SSN = r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"
ENTITY = re.compile(f"(?P<email>{EMAIL})|(?P<ip>{IP}|{IP6})|(?P<ssn>{SSN})|(?P<phone>{PHONE})|(?P<iban>{IBAN})|(?P<card>{CARD})")
_NAME = r"\p{Lu}[\p{L}\p{M}]*+(?:['’-]\p{L}[\p{L}\p{M}]*+)*+"
TITLED = regex.compile(rf"\b(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\.?\x20+(?:(?:{'|'.join(PARTICLES)})\x20+){{0,3}}+({_NAME}(?:\x20+{_NAME})*+)")
#: Two capitalised words, or more, of the scripts that the stock has.
GIVEN = re.compile(r"(?<!\w)([A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ][a-zß-öø-ÿά-ώа-яё]+)(?=\x20[A-ZÀ-ÖØ-ÞΆ-ΏΑ-ΩА-ЯЁ]\w)")
CAPITALS = re.compile(r"(?<!\w)([A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ]{2,})(?=\x20([A-ZÀ-ÖØ-ÞΆ-ΏΑ-ΩА-ЯЁ]{2,})(?!\w))")
NAME_RUN = regex.compile(rf"{_NAME}(?:\x20+{_NAME})*+")
WORD = regex.compile(_NAME)
DIGIT = re.compile("[0-9]")
#: Decimal digits of other scripts; they are read as ASCII ones and written back in their script.
OTHER_DIGIT = re.compile(r"(?![0-9])\d")


class Cycle:
    """A keyed permutation of range(n) with a single cycle."""

    def __init__(self, key: bytes, tweak: str, n: int):
        self.key, self.tweak, self.n = key, tweak.encode(), n
        self.a = max(1, isqrt(n))
        self.b = -(-n // self.a)

    def _f(self, r: int, x: int, m: int) -> int:
        h = blake2b(b"%b|%d|%d" % (self.tweak, r, x), key=self.key, digest_size=32)
        return int.from_bytes(h.digest(), "big") % m

    def _there(self, x: int) -> int:
        while True:
            u, v = divmod(x, self.b)
            for r in range(ROUNDS):
                if r % 2:
                    v = (v + self._f(r, u, self.b)) % self.b
                else:
                    u = (u + self._f(r, v, self.a)) % self.a
            if (x := u * self.b + v) < self.n:
                return x

    def _back(self, x: int) -> int:
        while True:
            u, v = divmod(x, self.b)
            for r in reversed(range(ROUNDS)):
                if r % 2:
                    v = (v - self._f(r, u, self.b)) % self.b
                else:
                    u = (u - self._f(r, v, self.a)) % self.a
            if (x := u * self.b + v) < self.n:
                return x

    def next(self, x: int) -> int:
        return self._back((self._there(x) + 1) % self.n)


class RowCycle:
    """The same over rows of symbols, each below its own size: the halves are changed by turns,
    with a stream made from the other half, and the single cycle is counting in these digits."""

    def __init__(self, key: bytes, tweak: str, sizes: list[int]):
        self.head = shake_256(key + f"{tweak}|{sizes}".encode()).digest(32)
        self.sizes, self.half = np.array(sizes, np.int64), len(sizes) // 2

    def _turned(self, x: np.ndarray, rounds: range, sign: int) -> np.ndarray:
        x = x.copy()
        parts = slice(0, self.half), slice(self.half, None)
        for r in rounds:
            own, other = parts[r % 2], parts[1 - r % 2]
            stream = shake_256(self.head + bytes([r]) + x[other].astype("<u4").tobytes()).digest(8 * len(x[own]))
            x[own] = (x[own] + sign * (np.frombuffer(stream, "<u8") % self.sizes[own].astype(np.uint64)).astype(np.int64)) % self.sizes[own]
        return x

    def next(self, x: np.ndarray) -> np.ndarray:
        x = self._turned(x, range(ROUNDS), 1)
        for i in reversed(range(len(x))):
            x[i] = (x[i] + 1) % self.sizes[i]
            if x[i]:
                break
        return self._turned(x, range(ROUNDS)[::-1], -1)


def _wide(sizes: list[int]) -> bool:
    return len(sizes) > NUMBERED or sum(map(log2, sizes)) > NUMBERED


def reserved(domain: str) -> bool:
    """Is it a domain that is kept for examples?"""
    before, _, top = domain.lower().rpartition(".")
    return bool(before) and (top in RESERVED_TOPS or domain.lower() in RESERVED or domain.lower().endswith(tuple(f".{x}" for x in RESERVED)))


def _rank(values: list[int], sizes: list[int]) -> int:
    x = 0
    for v, s in zip(values, sizes, strict=True):
        x = x * s + v
    return x


def _unranked(x: int, sizes: list[int]) -> list[int]:
    out = []
    for s in reversed(sizes):
        x, v = divmod(x, s)
        out.append(v)
    return out[::-1]


def _permuted(key: bytes, tweak: str, values: list[int], sizes: list[int], valid=lambda v: True) -> list[int]:
    """The next valid value along the form's cycle; ``values`` are valid themselves."""
    if _wide(sizes):
        rows, row = RowCycle(key, tweak, sizes), np.array(values, np.int64)
        while not valid(new := (row := rows.next(row)).tolist()):
            pass
        return new
    n = 1
    for s in sizes:
        n *= s
    cycle, x = Cycle(key, f"{tweak}|{sizes}", n), _rank(values, sizes)
    x = cycle.next(x)
    while not valid(new := _unranked(x, sizes)):
        x = cycle.next(x)
    return new


def _letters(key: bytes, tweak: str, text: str, fixed: set[int] = frozenset(), valid=lambda text: True) -> str:
    """Letters and digits within their classes; case and all else stay."""
    lower = [c.lower() if len(c.lower()) == 1 else c for c in text]
    at = [i for i, c in enumerate(lower) if c in _CLASS_OF and i not in fixed]
    if not at:
        return text
    groups = [_CLASS_OF[lower[i]] for i in at]

    def spelled(values: list[int]) -> str:
        out = list(text)
        for i, g, v in zip(at, groups, values, strict=True):
            upper = g[v].upper()
            out[i] = upper if text[i] != lower[i] and len(upper) == 1 else g[v]
        return "".join(out)

    values = [g.index(lower[i]) for g, i in zip(groups, at, strict=True)]
    return spelled(_permuted(key, tweak, values, [len(g) for g in groups], lambda v: valid(spelled(v))))


def _email(key: bytes, text: str) -> str:
    box, _, domain = text.rpartition("@")
    if not reserved(domain):
        name, _, top = domain.rpartition(".")
        domain = f"{_letters(key, 'domain', name, valid=lambda n: not reserved(f'{n}.{top}'))}.{top}"
    return f"{_letters(key, 'mailbox', box)}@{domain}"


def _digits(key: bytes, tweak: str, text: str, at: list[int], low: list[int], high: list[int] | None = None) -> str:
    """The digits at ``at``, each from ``low`` to below ``high`` (10 if not given)."""
    high = high or [10] * len(at)
    new = _permuted(key, tweak, [int(text[i]) - m for i, m in zip(at, low, strict=True)], [h - m for h, m in zip(high, low, strict=True)])
    out = list(text)
    for i, v, m in zip(at, new, low, strict=True):
        out[i] = str(v + m)
    return "".join(out)


def _phone(key: bytes, text: str) -> str:
    at = [m.start() for m in DIGIT.finditer(text)]
    if text[0] == "+":
        code = re.match(r"\+1(?=\d{10}$|\D)|\+\d{1,3}(?=\D)|\+\d{2}", text)
        at = [i for i in at if i >= code.end() and text[i - 1 : i + 2] != "(0)"]
    low, high = [0] * len(at), [10] * len(at)
    if text[0] == "0":  # the trunk prefix stays, and no other zero follows it
        at, low, high = at[1:], [1, *low[2:]], high[1:]
    elif text[at[0]] >= "2":  # numbers that start with 0 or 1 stay apart
        low[0] = 2
    else:
        high[0] = 2
    return _digits(key, "phone", text, at, low, high)


def luhn(digits: str) -> int:
    """The check digit that follows these digits."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + (k % 2 == 0))
        total += d - 9 * (d > 9)
    return -total % 10


def _card(key: bytes, text: str) -> str:
    at = [m.start() for m in DIGIT.finditer(text)]
    plain = "".join(text[i] for i in at)
    offset = (int(plain[-1]) - luhn(plain[:-1])) % 10
    inner = at[2 if plain[0] == "2" else 1 : -1]
    out = _digits(key, "card", text, inner, [0] * len(inner))
    check = (luhn("".join(out[i] for i in at[:-1])) + offset) % 10
    return out[: at[-1]] + str(check) + out[at[-1] + 1 :]


def _iban_rest(text: str) -> int:
    """1 for a valid account number."""
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def _iban(key: bytes, text: str) -> str:
    new = text[:4] + _letters(key, f"iban{text[:2]}", text[4:])
    check = 98 - _iban_rest(new[:2] + "00" + new[4:])
    return f"{new[:2]}{check:02d}{new[4:]}"


def _ip6(key: bytes, text: str) -> str:
    """The first group, which tells the range, stays; so does letter case."""
    g = [int(x, 16) for x in IPv6Address(text).exploded.split(":")]
    new = g[:1] + _permuted(key, f"ip6{g[0]}", g[1:], [1 << 16] * 7)
    out = IPv6Address(b"".join(x.to_bytes(2, "big") for x in new)).compressed
    return out.upper() if text != text.lower() else out


def _ip(key: bytes, text: str) -> str:
    if ":" in text:
        return _ip6(key, text)
    o = [int(x) for x in text.split(".")]
    private = lambda a, b: a in (10, 127, 0) or a >= 224 or (a, b) in ((192, 168), (169, 254)) or a == 172 and 16 <= b < 32
    if private(o[0], o[1]):
        keep = 1 if o[0] not in (192, 169, 172) else 2
        return ".".join(map(str, o[:keep] + _permuted(key, f"ip{o[:keep]}", o[keep:], [256] * (4 - keep))))
    return ".".join(map(str, _permuted(key, "ip", o, [256] * 4, lambda v: not private(v[0], v[1]))))


def _ssn(key: bytes, text: str) -> str:
    at = [m.start() for m in DIGIT.finditer(text)]
    return _digits(key, "ssn", text, at, [0] * 9)


_STOCK = {name.lower(): (kind, i) for kind, names in NAMES.items() for i, name in enumerate(names.split())}
_TITLES = frozenset(TITLES)
_GIVEN, _GIVEN_STAND_INS = ({name for kind, names in stock.items() if "surnames" not in kind for name in names.split()} for stock in (NAMES, STAND_INS))
#: By script: all its letters, then the consonants and vowels of syllables. The first vowel
#: of a word in extended Latin has an accent, so that plain words are never its images.
SCRIPTS = {
    "latin": (CLASSES[0] + CLASSES[1], CLASSES[1], CLASSES[0], CLASSES[0]),
    "extended": (CLASSES[0] + CLASSES[1] + CLASSES[3] + CLASSES[4], CLASSES[1], CLASSES[0], CLASSES[3]),
    "cyrillic": (CLASSES[5] + CLASSES[6] + "ёъь", CLASSES[6], CLASSES[5], CLASSES[5]),
    "greek": (CLASSES[7] + CLASSES[8] + "άέήίόύώς", CLASSES[8], CLASSES[7], CLASSES[7]),
}


def spelled_name(key: bytes, word: str) -> str:
    """A lower-case word of one script, spelled anew: its letters but the last are
    numbered among all of up to this length, permuted within the length, and written as
    consonants and vowels; three syllables at least, and as many as the numbers need."""
    script = next((s for s, (letters, *_) in SCRIPTS.items() if all(c in letters for c in word)), None)
    if script is None or len(word) < 2:
        return _letters(key, "person", word, {len(word) - 1} if len(word) > 2 else frozenset())
    letters, consonants, vowels, first = SCRIPTS[script]
    base, m = len(letters), len(word) - 1
    if m * log2(base) > NUMBERED:
        return _letters(key, f"person {script}", word, {m})[:-1] + 2 * consonants[0] + word[-1]
    shorter = sum(base**j for j in range(1, m))
    new = shorter + Cycle(key, f"person {script} {m}", base**m).next(_rank([letters.index(c) for c in word[:-1]], [base] * m))
    syllables, room = 1, len(consonants) * len(first)
    while syllables < 3 or room < shorter + base**m:
        syllables, room = syllables + 1, room * len(consonants) * len(vowels)
    sizes = [len(consonants), len(first), *[len(consonants), len(vowels)] * (syllables - 1)]
    kinds = [consonants, first, *[consonants, vowels] * (syllables - 1)]
    return "".join(k[v] for k, v in zip(kinds, _unranked(new, sizes), strict=True)) + word[-1]


def _person(key: bytes, text: str) -> str:
    """Each part of a name on its own: capitals throughout, or first letters."""
    out = []
    for part in re.split("(['’-])", text):
        lower = part.lower()
        if lower in _STOCK:
            kind, i = _STOCK[lower]
            names = STAND_INS[kind].split()
            new = names[Cycle(key, f"stock {kind}", len(names)).next(i)]
        elif len(part) < 2:
            new = part
        else:
            new = spelled_name(key, lower)
            new = new[0].upper() + new[1:] if part[0] != lower[0] else new
        out.append(new.upper() if len(part) > 1 and part.isupper() else new)
    return "".join(out)


MAKERS = {"email": _email, "phone": _phone, "card": _card, "iban": _iban, "ip": _ip, "ssn": _ssn, "person": _person}


def is_ip6(text: str) -> bool:
    """Told from names in code (``a::b``): a valid address with a digit and a first group of four."""
    try:
        IPv6Address(text)
    except ValueError:
        return False
    return text.index(":") == 4 and DIGIT.search(text) is not None


def _holds(kind: str, text: str) -> bool:
    """What a pattern can't tell."""
    if kind == "ip":
        return ":" not in text or is_ip6(text)
    return kind != "iban" or _iban_rest(text) == 1


def names_in(text: str) -> set[str]:
    """The words of persons' names, as found by title or given name. Each run of capitalised
    words is gone through once."""
    titled = [m.span(1) for m in TITLED.finditer(text)] if any(t in text for t in TITLES) else []
    given = {m.start(): m[1] for m in GIVEN.finditer(text) if m[1] in _GIVEN or m[1] in _GIVEN_STAND_INS}
    pairs = [(m[1], m[2]) for m in CAPITALS.finditer(text) if m[1].title() in _GIVEN]
    if not titled and not pairs and _GIVEN.isdisjoint(given.values()):
        return set()
    names, common = {w for pair in pairs for w in pair}, None

    def within(words, begins) -> None:
        """begins(word): a name begins here, whatever was before."""
        nonlocal common
        named = first = False
        for m in words:
            word = m[0]
            if word in _TITLES:
                first = named
            elif begins(m):
                names.add(word)
                named, first = True, False
            elif named:
                if not first and word.lower() not in _STOCK:
                    if common is None:
                        common = set(regex.findall(r"\b\p{Ll}+\b", text))
                    if word.lower() in common:
                        named = False
                        continue
                names.add(word)
                first = False

    for start, end in titled:
        words = list(WORD.finditer(text, start, end))
        begin = next((m.start() for m in words if m[0] not in _TITLES), -1)
        within(words, lambda m, begin=begin: m.start() == begin)
    end = 0
    for start in given:
        if start >= end:
            end = NAME_RUN.match(text, start).end()
            within(WORD.finditer(text, start, end), lambda m: m.start() in given)
    return names


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in order, without overlaps."""
    found = []
    if "@" in text or DIGIT.search(text):
        found = [(m.start(), m.end(), m.lastgroup) for m in ENTITY.finditer(text) if _holds(m.lastgroup, m[0])]
    names = names_in(text)
    if names:
        starts, ends = (np.array([x[k] for x in found], np.int64) for k in (0, 1))
        # a word is looked up once, whatever the number of names
        for m in WORD.finditer(text):
            if m[0] in names and (not m.start() or not re.match(r"\w", text[m.start() - 1])):
                k = int(np.searchsorted(ends, m.start(), "right"))
                if k == len(starts) or starts[k] >= m.end():
                    found.append((m.start(), m.end(), "person"))
    return sorted(found)


def canonical(kind: str, text: str) -> str:
    """Mentions of one entity have one canonical form."""
    if kind == "ip":
        return IPv6Address(text).exploded if ":" in text else text
    if kind == "iban":
        return text.replace(" ", "")
    return text.lower() if kind in ("email", "person") else re.sub(r"\D", "", text)


_drawn: list[bytes] = []


def drawn_key() -> bytes:
    """This process's own key; executors get it with the work."""
    if not _drawn:
        _drawn.append(secrets.token_bytes(32))
    return _drawn[0]


def configured_key(spark: SparkSession) -> bytes:
    """The key of the session's configuration, or the driver's own."""
    given = spark.conf.get(KEY_SETTING, None)
    return blake2b(given.encode(), digest_size=32).digest() if given else drawn_key()


class Surrogates:
    """Surrogates with a key; keeps the latest ones at hand."""

    def __init__(self, key: bytes | None = None, held: int = 50_000):
        self.key, self.held, self.known = key or drawn_key(), held, {}

    def one(self, kind: str, text: str) -> str:
        at = (kind, text)
        if at not in self.known:
            if len(self.known) >= self.held:
                self.known.clear()
            self.known[at] = MAKERS[kind](self.key, text)
        return self.known[at]

    def replaced(self, text: str | None) -> tuple[str | None, list[tuple[int, int, str]]]:
        """The text with surrogates, and the spans in the original."""
        if not text:
            return text, []
        plain = text if text.isascii() else OTHER_DIGIT.sub(lambda m: str(int(m[0])), text)
        if not (spans := entities(plain)):
            return text, []
        out, at = [], 0
        for s, e, kind in spans:
            new = self.one(kind, plain[s:e])
            if text[s:e] != plain[s:e]:
                zero = next(ord(c) - int(c) for c in text[s:e] if OTHER_DIGIT.match(c))
                new = DIGIT.sub(lambda m, zero=zero: chr(zero + int(m[0])), new)
            out += [text[at:s], new]
            at = e
        return "".join(out) + text[at:], spans


def counted(spans: list[tuple[int, int, str]]) -> list[int]:
    kinds = [k for _, _, k in spans]
    return [kinds.count(k) for k in KINDS]


def anonymise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", key: bytes | None = None) -> DataFrame:
    """Per row: doc_id, the new text, a count for each kind, the spans found."""
    key = key or configured_key(docs.sparkSession)

    def rows(batch):
        made = Surrogates(key)
        out = []
        for i, t in batch:
            new, spans = made.replaced(t)
            listed = ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
            out.append((i, new, *counted(spans), listed, sha256((new or "").encode("utf-8", "surrogatepass")).hexdigest()))
        return out

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return per_row(docs, f"doc_id long, text string, {counts}, spans string, text_sha256 string", rows, [doc_id, text])


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymise(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, key: bytes | None = None) -> DataFrame:
    """Texts get surrogates. ``n_chars`` follows the text where it told the text's length."""
    key = key or configured_key(spark)

    def rows(batch):
        made = Surrogates(key)
        return [(made.replaced(t)[0],) for (t,) in batch]

    out = add_columns(docs, "text string", rows, ["text"])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
