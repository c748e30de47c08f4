"""Surrogates for personal data: keyed, of the same kind and form, and distinct."""

from __future__ import annotations

import hmac
import ipaddress
import re
import sys
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A part of a name: a capital or caseless letter first, further parts after a hyphen or an apostrophe.
_NAME = r"[^\W\d_a-z](?:[^\W\d_]+|(?=['’]))(?:['’-][^\W\d_a-z][^\W\d_]+)*"
#: What a secret stands behind; only the value is replaced.
_BEFORE_SECRET = r"(?i:\b(?:[\w-]*(?:api|access|secret|private)[_-]?key|token|secret|passw(?:or)?d|pwd)\b[\"']?\s*[=:]\s*[\"']?)"
KINDS = (
    ("secret", _BEFORE_SECRET + r"[\w+/.~=-]{8,}|\b(?:AKIA[0-9A-Z]{12,}|gh[pousr]_\w{16,}|sk-[\w-]{16,})"),
    ("email", r"(?<![\w.+-])[\w+-]+(?:\.[\w+-]+)*@[\w-]+(?:\.[\w-]+)+"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d?\d)(?![\d.]*\d)"),
    ("card", r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)"),
    ("phone", r"(?<![\w.])\+\d{1,3} ?\(?\d{2,4}\)?(?:[ -]?\d{2,4}){2,4}(?!\d)"),
    ("ssn", r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"),
    ("name", rf"\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Señor|Señora|Monsieur|Madame)\.? {_NAME}(?: {_NAME})?"),
)
LETTERS = re.compile(r"[^\W\d_]+")
TITLES = ("Mr", "Ms", "Dr", "Herr", "Frau", "Señor", "Monsieur", "Madame")
#: What every entity of a kind holds. Kinds whose signs a text lacks cannot match and are not looked for in it.
SIGNS = {
    "secret": lambda t: "=" in t or ":" in t or "AKIA" in t or "_" in t or "sk-" in t,
    "email": lambda t: "@" in t,
    "ip": re.compile(r"\d\.\d").search,
    "card": re.compile(r"\d(?:[ -]?\d){12}").search,
    "phone": lambda t: "+" in t,
    "ssn": re.compile(r"\d-\d\d-\d").search,
    "name": lambda t: any(title in t for title in TITLES),
}
#: Patterns by the kinds they look for; like MET no function cache, which could not travel.
PATTERNS: dict[tuple[str, ...], re.Pattern] = {}


def found(text: str) -> Iterator[re.Match]:
    """All entities, from the left, the first of KINDS where several begin."""
    kinds = tuple(k for k, _ in KINDS if SIGNS[k](text))
    if not kinds:
        return iter(())
    if kinds not in PATTERNS:
        PATTERNS[kinds] = re.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS if k in kinds))
    return PATTERNS[kinds].finditer(text)


#: Letters change within their class, which keeps script and the sound of a name; upper case likewise.
LOWER = ("aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóú", "äöü", "èêàâôù", "αεηιουω", "άέήίόύώ", "βγδζθκλμνξπρστφχψ", "аеёиоуыэюяіїє", "бвгґджзйклмнпрстфхцчшщ", "ъь")
CLASSES = ("0123456789", *LOWER, *[k.upper() for k in LOWER])
CLASS_OF = {c: k for k in CLASSES for c in k}

#: Common given names by script and gender. A name of one row is replaced by another one of it.
GIVEN_NAMES = tuple(
    tuple(row.split())
    for row in (
        "Alice Amelia Anna Barbara Charlotte Clara Diana Elena Emma Eva Grace Hannah Helen Ingrid Isabel Jane Julia Karin Laura Lucia Maria Marie Martha Monika Nina Nora Olivia Paula Rosa Sofia Susan Vera",
        "Adam Albert Andreas Anton Arthur Carlos Charles Daniel David Diego Edward Emil Felix Frank Georg Henry Hugo Jack James Jan John Jorge Karl Louis Luis Mark Martin Oscar Paul Peter Robert Thomas",
        "Анна Вера Дарья Елена Ирина Мария Нина Ольга София Татьяна",
        "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Павел Сергей Юрий",
        "Άννα Ελένη Ειρήνη Ζωή Κατερίνα Μαρία Σοφία Χριστίνα",
        "Αλέξανδρος Γιώργος Δημήτρης Κώστας Νίκος Πέτρος Στέλιος Χρήστος",
    )
)
ROW_OF = {name: i for i, row in enumerate(GIVEN_NAMES) for name in row}


#: Classes of the characters met so far; a function cache could not travel to the executors.
MET = dict(CLASS_OF)


def _class_of(c: str) -> str:
    """All letters or digits that may stand for this one; every one of them has the same class. Empty for other characters.

    Letters outside CLASSES change within their category (upper case, lower case, other)
    and block of 256 characters, digits of other scripts among their ten.
    """
    if c not in MET:
        MET[c] = _other_class(c)
    return MET[c]


def _other_class(c: str) -> str:
    if not c.isalnum():
        return ""
    category = unicodedata.category(c)
    if category == "Nd":
        return "".join(chr(ord(c) - unicodedata.decimal(c) + i) for i in range(10))
    own = _block(ord(c) >> 8, category)
    if len(own) > 1:
        return own
    # The only one of its block changes with those of other blocks.
    blocks = (_block(i, category) for i in range((sys.maxunicode >> 8) + 1))
    return "".join(b for b in blocks if len(b) == 1)


def _block(number: int, category: str) -> str:
    chars = map(chr, range(number << 8, (number + 1) << 8))
    return "".join(c for c in chars if c not in CLASS_OF and unicodedata.category(c) == category and c.isalnum())


def _turns(values: list[int], sizes: list[int], key: bytes, tweak: str, back: bool = False) -> list[int]:
    """A keyed permutation of all value lists with these sizes, or its inverse: a Feistel network over mixed radices."""
    half = len(values) // 2
    values = list(values)
    for turn in range(6)[:: -1 if back else 1]:
        fixed, moved = (range(half), range(half, len(values)))[:: 1 if turn % 2 == 0 else -1]
        seed = f"{tweak}|{turn}|{','.join(str(values[i]) for i in fixed)}".encode()
        for i in moved:
            draw = int.from_bytes(hmac.digest(key, seed + b"|" + str(i).encode(), "sha256")[:8], "big")
            values[i] = (values[i] + (-draw if back else draw)) % sizes[i]
    return values


def _shuffle(values: list[int], sizes: list[int], key: bytes, tweak: str) -> list[int]:
    """A keyed permutation that leaves no list of values as it is: one step along a keyed order of all lists."""
    values = _turns(values, sizes, key, tweak)
    for i in reversed(range(len(values))):
        values[i] = (values[i] + 1) % sizes[i]
        if values[i]:
            break
    return _turns(values, sizes, key, tweak, back=True)


def _letters(text: str, kind: str, key: bytes, classes: list[str] | None = None) -> str:
    """Letters and digits replaced within their class; everything else, and so the form, stays."""
    classes = classes or [_class_of(c) for c in text]
    places = [i for i, k in enumerate(classes) if k]
    if not places:
        return text
    form = "".join(k[0] if k else c for c, k in zip(text, classes))
    moved = _shuffle([classes[i].index(text[i]) for i in places], [len(classes[i]) for i in places], key, f"{kind}|{form}")
    out = list(text)
    for i, v in zip(places, moved):
        out[i] = classes[i][v]
    return "".join(out)


def _network(octets: list[int]) -> tuple[bool, ...]:
    """What an address is for: public, private, loopback, link-local, multicast or reserved."""
    a = ipaddress.IPv4Address(bytes(octets))
    return a.is_global, a.is_private, a.is_loopback, a.is_link_local, a.is_multicast, a.is_reserved


def _octets(value: str, key: bytes) -> str:
    """An address for the same use and in the same form.

    Octets keep their leading zeros, so that 1, 01 and 001 stay apart. An address that is not
    public keeps its first two octets. The walk goes on until it meets an address for the same use.
    """
    parts = value.split(".")
    old = [int(p) for p in parts]
    use = _network(old)
    kept = 0 if use[0] else 2
    padded = [len(p) > 1 and p[0] == "0" for p in parts]
    sizes = [10 ** (len(p) - 1) if z else 256 for p, z in zip(parts, padded)][kept:]
    form = ".".join([*parts[:kept], *[str(len(p)) if z else "" for p, z in zip(parts[kept:], padded[kept:])]])
    moved = old
    while True:
        moved = old[:kept] + _shuffle(moved[kept:], sizes, key, f"ip|{form}")
        if moved == old or _network(moved) == use:
            return ".".join(str(v).zfill(len(p)) if z else str(v) for p, z, v in zip(parts, padded, moved))


def _phone(rest: str, country: str, key: bytes) -> str:
    """The number after the country code: the first digit of each group stays 0, 1 or neither, as in area codes."""
    classes = [_class_of(c) for c in rest]
    for i, c in enumerate(rest):
        if c in "0123456789" and (i == 0 or not rest[i - 1].isdigit()):
            classes[i] = c if c in "01" else "23456789"
    return _letters(rest, f"phone{country}", key, classes)


def _luhn(digits: str) -> int:
    """What is missing to the check digit of these leading digits."""
    total = sum(int(d) if i % 2 else (2 * int(d) - 9 * (int(d) > 4)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _name(name: str, key: bytes) -> str:
    """A part of a name: a common given name becomes another one of its script and gender.

    Other parts change letter by letter and never into a common given name; of these the title and the
    last letter carry the gender. Scripts without case have no such letter.
    """
    if name in ROW_OF:
        row = GIVEN_NAMES[ROW_OF[name]]
        order = sorted(row, key=lambda n: hmac.digest(key, f"given|{n}".encode(), "sha256"))
        return order[(order.index(name) + 1) % len(order)]
    last = name[-1] if unicodedata.category(name[-1]) in ("Lu", "Ll", "Lt") else ""
    new = name
    while True:
        new = _letters(new[: len(new) - len(last)], f"name{last}", key) + last
        if new not in ROW_OF:
            return new


def surrogate(value: str, kind: str, key: bytes) -> str:
    """The replacement of an entity: the same everywhere, and another for every other entity of its kind and form."""
    if kind == "ip":
        return _octets(value, key) if value.isascii() else _letters(value, kind, key)
    if kind == "email":
        local, domain = value.rsplit("@", 1)
        labels = domain.split(".")
        # The last two labels say what the address is; names below them may be personal.
        below = "".join(f"{label}." for label in labels[:-2])
        return _letters(f"{local}@{below}", "email", key) + ".".join(labels[-2:])
    if kind == "card":
        digits = re.sub(r"\D", "", value)
        if _luhn(digits[:-1]) == int(digits[-1]):
            at = [i for i, c in enumerate(value) if c.isdigit()][-1]
            # The first four digits name the issuer.
            start = [i for i, c in enumerate(value) if c.isdigit()][4]
            front = value[:start] + _letters(value[start:at], f"card{value[:start]}", key)
            return front + _class_of(value[at])[_luhn(re.sub(r"\D", "", front))]
        # Numbers without a valid check digit stay without one: the next of the walk is taken.
        while True:
            value = _letters(value, "number", key)
            digits = re.sub(r"\D", "", value)
            if _luhn(digits[:-1]) != int(digits[-1]):
                return value
    if kind == "phone":
        country, rest = re.match(r"(\+\d{1,3})(.*)", value, re.S).groups()
        return country + _phone(rest, country, key)
    if kind == "name":
        title, *names = value.split(" ")
        # Every part of a name is replaced by itself, so that parts agree.
        return " ".join([title, *[LETTERS.sub(lambda m: _name(m.group(), key), n) for n in names]])
    if kind == "secret":
        before = re.match(_BEFORE_SECRET, value)
        front = before.group() if before else ""
        return front + _letters(value[len(front) :], "secret", key)
    return _letters(value, kind, key)


def _mentions(text: str, names: dict[str, str], taken: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Further places of the parts of names, outside the entities that are found already."""
    found, i = [], 0
    for m in LETTERS.finditer(text):
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if m.group() in names and not (i < len(taken) and taken[i][0] < m.end()):
            found.append((m.start(), m.end(), "name", names[m.group()]))
    return found


def replace(text: str | None, key: bytes) -> tuple[str | None, list[tuple[int, int, str, str]]]:
    """The text with surrogates, and (start, end, kind, surrogate) of each entity in the old text.

    A name that stands after a title is replaced wherever its parts stand in the text, also
    before a possessive or a hyphen; parts of one letter and lower-case ones are not looked for.
    """
    if text is None:
        return None, []
    spans: list[tuple[int, int, str, str]] = []
    back: dict[tuple[str, str], str] = {}
    names: dict[str, str] = {}
    for m in found(text):
        kind, old = m.lastgroup, m.group()
        new = surrogate(old, kind, key)
        if back.setdefault((kind, new), old) != old:
            raise ValueError("two entities with one surrogate")  # the permutation excludes this
        spans.append((m.start(), m.end(), kind, new))
        if kind == "name":
            parts = zip(LETTERS.findall(old.split(" ", 1)[1]), LETTERS.findall(new.split(" ", 1)[1]))
            names |= {a: b for a, b in parts if len(a) > 1 and not a[0].islower()}
    if names:
        spans = sorted(spans + _mentions(text, names, spans))
    out, at = [], 0
    for start, end, _, new in spans:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]]), spans


def replace_personal_data(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text (with surrogates), entities of every row.

    A replacement is a keyed permutation of the values of one kind and form: equal
    entities agree in all documents, and two different ones never meet, without any
    table of all entities. Null texts stay null, empty ones empty, both without
    entities; repeated rows come out each; other columns are not read.
    """
    secret = key.encode("utf-8")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [replace(None if pd.isna(t) else t, secret) for t in b["text"]]
            rows = [[{"start": s, "stop": e, "kind": k, "surrogate": v} for s, e, k, v in spans] for _, spans in done]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64").array, "text": [t for t, _ in done], "entities": rows})

    schema = "doc_id long, text string, entities array<struct<start: int, stop: int, kind: string, surrogate: string>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, schema)
