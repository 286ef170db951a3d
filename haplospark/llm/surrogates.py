"""Personal data replaced by keyed surrogates of the same type and format.

Each type of entity is read as a number below the count of its possible forms,
and a keyed permutation (a Feistel network, walked until the result is a form
again) gives the surrogate: digits stay digits, vowels vowels, a script its
script, card and IBAN check sums hold, networks stay private or public. Given
names come from a list of the same gender and script, permuted by the key.
Mentions of one entity in other formats or cases share its canonical form. In a
document a surrogate that equals another entity there, or is taken, is drawn
again; when redraws fail, given names go through their whole list, and then all
kinds go on with longer forms, so different entities of a document always get
different surrogates. An entity that was never drawn again has the same
surrogate in all documents; where one had to be, only within its document.

Defined cases: a null text stays null and has no entities; an empty one is
itself; rows that repeat get equal results; texts of any length are one row's
work; columns other than ``keep`` and the text are not read; kept columns of
the output's names are not kept. Digits and letters of every script are changed
within their script; a letter that has no other near it in its alphabet stays.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, count, product

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haplospark.llm.common import fresh, table, text_slices

KEY = b"change this key per corpus"
ROUNDS = 8

# Given names by script and gender; titles by gender.
GIVEN = {
    ("latin", "f"): "Alice Anna Barbara Carmen Clara Claire Elena Emily Emma Eva Hannah Helena Ines Isabel Jane Julia Karin Laura Lucia Maria Marie Martha Mary Monika Nina Olivia Paula Rosa Sarah Sofia Susan Ursula".split(),
    ("latin", "m"): "Adam Alan Andreas Antonio Bernd Carlos Charles Daniel David Diego Edward Frank George Hans Henri Jack Jacques James Javier John Jorge Karl Louis Luis Michael Paul Pedro Peter Pierre Robert Thomas William".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Иван Игорь Олег Павел Пётр".split(),
    ("greek", "f"): "Άννα Ελένη Ειρήνη Μαρία".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Κώστας Νίκος".split(),
}
TITLES = {"f": "Mrs Ms Miss Frau Señora Doña Madame Mme Mlle Г-жа Κυρία".split(), "m": "Mr Sir Herr Señor Don Monsieur Г-н Κύριος".split(), "": "Dr Prof".split()}
#: Letters that take each other's place, by script; other letters stay.
LETTERS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "àáâäèéêëìíîïòóôöùúûü", "çñ", "аеёиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ"]
PLACE = {c: (letters, i) for letters in [*LETTERS, "0123456789"] for i, c in enumerate(letters)}
#: Letters of other scripts and marks take the place of letters of the same kind in their row of so many code points.
ROW = 128


class Places(dict):
    """PLACE, and by rule what it lacks: decimal digits of every script among themselves, other letters in their row."""

    def __missing__(self, c: str) -> tuple[str, int] | None:
        self[c] = None
        if c.isdecimal():
            zero = ord(c) - int(c)
            self[c] = ("".join(chr(zero + d) for d in range(10)), int(c))
        elif c.isalpha() and c == c.lower():
            first, kind = ord(c) // ROW * ROW, unicodedata.category(c)
            row = "".join(x for x in map(chr, range(first, first + ROW)) if x not in PLACE and unicodedata.category(x) == kind and x == x.lower() and (kind != "Ll" or len(x.upper()) == 1 and x.upper().lower() == x))
            self[c] = (row, row.index(c)) if c in row and len(row) > 1 else None
        return self[c]


PLACES = Places(PLACE)
HEX = {c: ("0123456789abcdef", i) for i, c in enumerate("0123456789abcdef")}
def ranges(test: Callable[[str], bool]) -> list[tuple[int, int]]:
    """Runs of code points whose characters pass the test."""
    found: list[tuple[int, int]] = []
    for i in range(0x30000):
        if test(chr(i)):
            found[-1:] = [(found[-1][0], i)] if found and found[-1][1] == i - 1 else [*found[-1:], (i, i)]
    return found


KNOWN = {name: (group, i) for group, names in GIVEN.items() for i, name in enumerate(names)}

#: A name's first letter: any capital, or a letter of a script without case; the latter may be a name alone.
_first = "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges(lambda c: c.isalpha() and (c.isupper() or unicodedata.category(c) == "Lo")))
_alone = "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges(lambda c: unicodedata.category(c) == "Lo"))
_name = rf"(?:[{_first}][^\W\d_]+|[{_alone}])(?:-[^\W\d_]+)*"
_octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "email": r"(?<![\w.%+-])[\w.%+-]+@[\w-]+(?:\.[\w-]+)+",
    "access_key": r"\bAKIA[0-9A-Z]{16}\b",
    "secret": r"(?i:(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*[\"']?)(?P<value>[^\s\"']{5,}[^\s\"'.,;:!?)])",
    "hex": r"\b[0-9a-f]{32,}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": rf"(?<![\d.]){_octet}(?:\.{_octet}){{3}}(?![\d.]*\d)",
    "ipv6": r"(?i:(?<![\w:])(?:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?=[0-9a-f:]*[0-9a-f]{2}[0-9a-f:]*::|[0-9a-f:]*::[0-9a-f:]*[0-9a-f]{2})[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,5}::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,5})?)(?![\w:]))",
    "phone": r"(?<![\w.,-])0\d{2,4}[ -]\d{3,4}[ -]\d{3,4}(?![\d-])|(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
    "national_id": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "person": rf"\b(?:{'|'.join(t for ts in TITLES.values() for t in ts)})\.? (?P<names>{_name}(?: {_name})?)|\b(?P<given>{'|'.join(KNOWN)}) (?P<family>{_name})",
}
ENTITY = re.compile("|".join(f"(?P<{k}>{v})" for k, v in PATTERNS.items()))
#: A text without a match of this has no entity; checked by Arrow over whole columns.
MAYBE = r"@|[0-9a-fA-F]{1,4}:[0-9a-fA-F]{0,4}:|[A-Z]{2}\p{Nd}{2}|\p{Nd}[ .\-]?\p{Nd}[ .\-]?\p{Nd}|AKIA|[0-9a-f]{32}|(?i:password|passwd|pwd|secret|token|api[_-]?key)|" + "|".join(f"{t}[. ]" for ts in TITLES.values() for t in ts) + "|" + "|".join(f"{g} " for g in KNOWN)


WORD = re.compile(r"(?<!\w)[^\W\d_]+(?:-[^\W\d_]+)*(?!\w)")


def permute(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of the numbers below size."""
    if size < 2:
        return x
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, n_bytes = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = x >> half, x & mask
        for r in range(ROUNDS):
            digest = hashlib.blake2b(right.to_bytes(n_bytes, "little") + tweak.encode() + bytes([r]), key=key[:64], digest_size=min(64, n_bytes + 8)).digest()
            if n_bytes + 8 > 64:
                digest = hashlib.shake_256(digest).digest(n_bytes)
            left, right = right, left ^ (int.from_bytes(digest, "little") & mask)
        x = left << half | right
        if x < size:
            return x


def same_form(text: str, key: bytes, tweak: str, place: dict = PLACES) -> str:
    """Every letter and digit of ``place`` changed within its group; all else stays."""
    value, size, at = 0, 1, [place[c] if place is PLACES else place.get(c) for c in text]
    for p in at:
        if p:
            value, size = value * len(p[0]) + p[1], size * len(p[0])
    value = permute(value, size, key, tweak + "".join("." if p else c for c, p in zip(text, at)))
    out = []
    for c, p in zip(reversed(text), reversed(at)):
        if p:
            value, digit = divmod(value, len(p[0]))
            c = p[0][digit]
        out.append(c)
    return "".join(reversed(out))


def in_format(like: str, canonical: str) -> str:
    """Letters and digits of ``canonical`` in the places and cases of ``like``."""
    left = iter(canonical)
    script = lambda c, d: chr(ord(c) - int(c) + int(d)) if c.isdecimal() and d.isdecimal() else d
    return "".join((d.upper() if c.isupper() and not d.isupper() else script(c, d)) if c.isalnum() and (d := next(left, c)) else c for c in like)


def luhn(digits: str) -> int:
    """The check digit that should follow."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def network(x: int) -> int:
    a, b = x >> 24, x >> 16 & 255
    return 1 if a == 10 else 2 if a == 172 and 16 <= b < 32 else 3 if a == 192 and b == 168 else 4 if a in (0, 127) or a >= 224 else 0


def script_of(name: str) -> str:
    c = name[0]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def canonical(kind: str, text: str) -> str:
    if kind in ("phone", "card", "national_id", "iban"):
        return "".join(str(int(c)) if c.isdecimal() else c for c in text if c.isalnum())
    return text.lower() if kind in ("email", "ipv6") else ".".join(str(int(o)) for o in text.split(".")) if kind == "ip" else text


def name_surrogate(name: str, key: bytes, tweak: str) -> str:
    """A known given name: another of its gender and script. Else a made-up name of its letters' kinds."""
    if name in KNOWN:
        group, i = KNOWN[name]
        return GIVEN[group][permute(i, len(GIVEN[group]), key, f"given{tweak}")]
    return in_format(name, same_form(name.lower(), key, f"family{tweak}"))


def surrogate(kind: str, text: str, key: bytes, attempt: int) -> str:
    """text: canonical."""
    tweak = f"{kind}{attempt}"
    if kind == "email":
        local, domain = text.rsplit("@", 1)
        labels = domain.split(".")
        changed = same_form("@".join([local, *labels[:-2]]), key, tweak).split("@")
        return f"{changed[0]}@{'.'.join([*changed[1:], *labels[-2:]])}"
    if kind == "access_key":
        return "AKIA" + same_form(text[4:].lower(), key, tweak).upper()
    if kind == "hex" or kind == "secret" and re.fullmatch("[0-9a-f]{8,}", text):
        return same_form(text, key, tweak, HEX)
    if kind == "secret":
        return in_format(text, "".join(c for c in same_form(text.lower(), key, tweak) if c.isalnum()))
    if kind == "ipv6":  # the first group tells local from public addresses
        head, tail = text.split(":", 1)
        return f"{head}:{same_form(tail, key, tweak + head, HEX)}"
    if kind == "ip":
        octets = [int(o) for o in text.split(".")]
        first = x = int.from_bytes(bytes(octets), "big")
        while True:
            x = permute(x, 1 << 32, key, tweak)
            if network(x) == network(first):
                return ".".join(map(str, x.to_bytes(4, "big")))
    if kind == "card":
        off = (int(text[-1]) - luhn(text[:-1])) % 10
        body = text[0] + same_form(text[1:-1], key, tweak + text[0])
        return body + str((luhn(body) + off) % 10)
    if kind == "iban":
        rest = same_form(text[4:].lower(), key, tweak + text[:2]).upper()
        valid = iban_check(text[:2], text[4:]) == text[2:4]
        return text[:2] + (iban_check(text[:2], rest) if valid else text[2:4]) + rest
    if kind == "phone":
        keep = 1 if text.startswith("0") or text.startswith("1") and len(text) == 11 else 2 if len(text) > 10 else 0
        fixed = text[:keep]
        if len(text) - keep == 10:  # area and exchange codes begin with 2 to 9
            rest, out = text[keep:], ""
            lead = [rest[0], rest[3]]
            value, size = 0, 1
            for i, c in enumerate(rest):
                low = 2 if i in (0, 3) and min(lead) >= "2" else 0
                value, size = value * (10 - low) + int(c) - low, size * (10 - low)
            value = permute(value, size, key, tweak + fixed + str(min(lead) >= "2"))
            for i in range(9, -1, -1):
                low = 2 if i in (0, 3) and min(lead) >= "2" else 0
                value, d = divmod(value, 10 - low)
                out = str(d + low) + out
            return fixed + out
        return fixed + same_form(text[keep:], key, tweak + fixed)
    return same_form(text, key, tweak)


@lru_cache(1 << 16)
def _surrogate(kind: str, text: str, key: bytes, attempt: int) -> str:
    return name_surrogate(text, key, str(attempt)) if kind == "name" else surrogate(kind, text, key, attempt)


def further(kind: str, text: str, key: bytes) -> Iterator[str]:
    """What follows when redraws fail, without end: the rest of a given name's list, then names of the same script
    and ending with syllables put in; other kinds with digits put after them, emails before the sign."""
    first = _surrogate(kind, text, key, 0)
    if kind != "name":
        head, tail = (first[: (at := first.rindex("@"))], first[at:]) if kind == "email" else (first, "")
        yield from (f"{head}{i}{tail}" for i in count())
    stems = [first]
    if text in KNOWN:
        names = GIVEN[KNOWN[text][0]]
        stems = names[(at := names.index(first)) :] + names[:at]
        yield from stems
    vowels, consonants = {"latin": LETTERS[:2], "cyrillic": LETTERS[4:6], "greek": LETTERS[6:8]}[script_of(text)]
    order = lambda x: hashlib.blake2b(x.encode(), key=key[:64]).digest()
    syllables = sorted({c + v for c in consonants for v in vowels}, key=order)
    for size in count(1):
        for middle in product(syllables, repeat=size):
            yield from (x[:-1] + "".join(middle) + x[-1] for x in stems)


def entities(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end); a person gives one span for each name."""
    for m in ENTITY.finditer(text):
        kind = m.lastgroup if m.lastgroup in PATTERNS else next(k for k in PATTERNS if m.group(k) is not None)
        if kind == "secret":
            yield kind, *m.span("value")
        elif kind == "person":
            for part in ("names", "given", "family"):
                if m.group(part):
                    for n in re.finditer(r"\S+", m.group(part)):
                        yield "name", m.start(part) + n.start(), m.start(part) + n.end()
        else:
            yield kind, *m.span()


def mentions(text: str, names: set[str]) -> Iterator[tuple[int, int]]:
    """Where one of the names stands as a word, or as a part of a hyphenated one that is none itself."""
    for m in WORD.finditer(text):
        if m.group() in names:
            yield m.span()
        elif "-" in m.group():
            yield from ((m.start() + p.start(), m.start() + p.end()) for p in re.finditer(r"[^-]+", m.group()) if p.group() in names)


def replaced(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with surrogates, and the spans of the entities in the text as it was."""
    found = list(entities(text))
    forms = {(k, canonical(k, text[a:b])) for k, a, b in found}
    # a name also goes where it stands alone
    names = {x for k, x in forms if k == "name"}
    if names:
        starts, ends = [a for _, a, _ in found], [b for _, _, b in found]
        for a, b in mentions(text, names):
            i = bisect_right(starts, a)
            if not (i and ends[i - 1] > a or i < len(starts) and starts[i] < b):
                found.append(("name", a, b))
        found.sort(key=lambda x: x[1])
    originals, used, chosen = {x for _, x in forms}, set(), {}
    for kind, x in sorted(forms):
        drawn = chain((_surrogate(kind, x, key, attempt) for attempt in range(65)), further(kind, x, key))
        y = next(y for y in drawn if y not in originals and y not in used)
        used.add(y)
        chosen[kind, x] = y
    out, at = [], 0
    for kind, a, b in found:
        x = canonical(kind, text[a:b])
        y = chosen[kind, x]
        out += [text[at:a], in_format(text[a:b], y) + y[len(x) :] if kind in ("phone", "card", "national_id", "iban") else in_case(text[a:b], y) if kind == "email" else y]
        at = b
    return "".join([*out, text[at:]]), found


def in_case(like: str, text: str) -> str:
    return "".join(d.upper() if c.isupper() else d for c, d in zip(like, text)) + text[len(like) :]


def with_surrogates(docs: DataFrame, keep: list[str], key: bytes = KEY, text: str = "text") -> DataFrame:
    """keep, text, entities array<struct<kind, start, end>> (in the text as it was)."""
    keep = [c for c in keep if c.lower() not in (text.lower(), "entities")]
    whole, new_text, found_in = (fresh(docs, c) for c in ("whole_text", "new_text", "found_in"))
    rows = docs.select(*keep, F.col(text).cast("string").alias(whole))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, whole):
                column = part.column(whole)
                maybe = pc.fill_null(pc.match_substring_regex(column, MAYBE), False)
                new, spans = iter([replaced(t, key) for t in column.filter(maybe).to_pylist()]), []
                texts = []
                for flag in maybe.to_pylist():
                    changed, found = next(new) if flag else (None, [])
                    texts.append(changed)
                    spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
                out = pc.if_else(maybe, pa.array(texts, pa.string()), column)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), out, pa.array(spans, span)], names=[*keep, new_text, found_in])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != whole), f"`{new_text}` string", f"`{found_in}` array<struct<kind:string,start:int,end:int>>"])
    return rows.mapInArrow(run, schema).select(*keep, F.col(new_text).alias(text), F.col(found_in).alias("entities"))


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_surrogates(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", F.size("entities").cast("long").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct(F.col("entities.kind"))), ",").alias("kinds"), "text")
