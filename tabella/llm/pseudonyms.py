"""Personal data replaced by format-preserving pseudonyms: keyed Feistel permutations within each format.

A value is found by pattern, validated (check digits, ranges, the calendar), numbered within the set of valid values of its
format and permuted there by a Feistel network with cycle walking. So a card stays a valid card of the same length, a date a
date in the same notation, and equal values get equal pseudonyms in all documents without any shared table. Whoever holds the
key can undo it; nobody else can.

A date has one pseudonym in all notations: year first (``-`` or ``/``), day first and, where the day is after the 12th, month
first. Days after the 12th stay after it, the others don't pass it, so that the notation reads as before; undoing restores the
date, perhaps with leading zeros. Addresses that differ in case only are linked. What stays in clear: the host of an e-mail
address and the country of an IBAN or phone, dates with month names or two-digit years, numbers without a country code other
than ten digits in three groups, IBANs in lower case, IPv6 addresses and social security numbers without hyphens.

Every pattern starts at the beginning of a run of its characters only, so the search is linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from datetime import date
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
KINDS = ("email", "iban", "ip", "card", "ssn", "phone", "date")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*[A-Za-z0-9]@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", re.A),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", re.A),
    "ip": re.compile(rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)", re.A),
    "card": re.compile(r"(?<![\d+])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?:\1\d{1,3})?|\d{4}([ -])\d{6}\2\d{5}|\d{13,19})(?!\d)", re.A),
    "ssn": re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", re.A),
    "phone": re.compile(r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]?\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d+])\+\d{1,3}[ .-]\d(?:[ .-]\d{2,4}){2,4}(?!\d)", re.A),
    "date": re.compile(r"(?<![\d/.-])(?:\d{4}([/-])\d{2}\1\d{2}|\d{1,2}([/.-])\d{1,2}\2\d{4})(?![\d/-]|\.\d)", re.A),
}
_ANY = re.compile(r"[0-9@]")
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27,
    "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18,
    "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
_FIRST, _LAST = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()


@cache
def _days(late: bool) -> tuple[int, ...]:
    """The days after the 12th of a month, or those up to it. Only the former can be written month first without being read day first."""
    return tuple(n for n in range(_FIRST, _LAST + 1) if (date.fromordinal(n).day > 12) == late)


class Permutation:
    """A keyed permutation of 0 .. size - 1, its own for every ``tweak``."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, i: int, tweak: bytes, half: int, bits: int) -> int:
        n = -(-bits // 8)
        told = tweak + i.to_bytes(1, "big") + half.to_bytes(n, "big")
        out = hashlib.blake2b(told, key=self.key, digest_size=min(64, n)).digest()
        return int.from_bytes(out, "big") & ((1 << bits) - 1)

    def _walk(self, value: int, size: int, tweak: bytes, rounds: range, back: bool) -> int:
        bits = max(1, -(-max(1, (size - 1).bit_length()) // 2))
        mask = (1 << bits) - 1
        while True:
            left, right = value >> bits, value & mask
            for i in rounds:
                if back:
                    left, right = right ^ self._round(i, tweak, left, bits), left
                else:
                    left, right = right, left ^ self._round(i, tweak, right, bits)
            value = left << bits | right
            if value < size:
                return value

    def apply(self, value: int, size: int, tweak: str) -> int:
        return self._walk(value, size, f"{tweak}/{size}/".encode(), range(ROUNDS), False)

    def undo(self, value: int, size: int, tweak: str) -> int:
        return self._walk(value, size, f"{tweak}/{size}/".encode(), range(ROUNDS - 1, -1, -1), True)


def luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = sum(d if i % 2 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _refill(shape: str, chars: str, old: str = r"\d") -> str:
    """``shape`` with its matches of ``old`` replaced one by one."""
    it = iter(chars)
    return re.sub(old, lambda _: next(it), shape, flags=re.A)


def _classes(text: str) -> tuple[str, int, int]:
    """The character classes of a text, and its number and the size of the set of texts of those classes."""
    shape, value, size = [], 0, 1
    for c in text:
        low, n, name = (48, 10, "0") if "0" <= c <= "9" else (97, 26, "a") if "a" <= c <= "z" else (65, 26, "A") if "A" <= c <= "Z" else (0, 0, c)
        shape.append(name)
        if n:
            value, size = value * n + ord(c) - low, size * n
    return "".join(shape), value, size


def _spell(shape: str, value: int) -> str:
    out = []
    for c in reversed(shape):
        low, n = {"0": (48, 10), "a": (97, 26), "A": (65, 26)}.get(c, (0, 0))
        if n:
            value, d = divmod(value, n)
            c = chr(low + d)
        out.append(c)
    return "".join(reversed(out))


def _card(text, move):
    digits = re.sub(r"\D", "", text)
    if luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    new = digits
    while True:
        body = str(move(int(new[:-1]), 10 ** (len(digits) - 1), "card")).zfill(len(digits) - 1)
        new = body + str(luhn(body))
        # One-digit cards are no valid value, and a long card must not begin to hold a short one, or stop to: step over those.
        if len(set(new)) > 1 and _holds_short(new) == _holds_short(digits):
            return _refill(text, new)


def _holds_short(digits):
    return len(digits) > 16 and luhn(digits[:15]) == int(digits[15])


def _ssn(text, move):
    a, g, s = map(int, text.split("-"))
    if not 0 < a < 900 or a == 666 or not g or not s:
        return None
    n = move(((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1, 898 * 99 * 9999, "ssn")
    a, g, s = n // 9999 // 99 + 1, n // 9999 % 99 + 1, n % 9999 + 1
    return f"{a + (a >= 666):03d}-{g:02d}-{s:04d}"


def _ip(text, move):
    n = 0
    for part in text.split("."):
        n = n * 256 + int(part)
    n = move(n, 2**32, "ip")
    return ".".join(str(n >> k & 255) for k in (24, 16, 8, 0))


def _phone(text, move):
    code = re.match(r"\+1(?!\d)|\+\d{1,3}(?=[ .(-])|\+1(?=\d{10}$)", text, re.A)
    start = code.end() if code else 1 if text[0] == "+" else 0
    rest = text[start:]
    digits = re.sub(r"\D", "", rest)
    if not 7 <= len(digits) <= 14 or (text[0] != "+" and len(digits) != 10):
        return None
    return text[:start] + _refill(rest, str(move(int(digits), 10 ** len(digits), "phone")).zfill(len(digits)))


def _iban(text, move):
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or not "02" <= plain[2:4] <= "98" or _mod97(plain[4:] + plain[:4]) != 1:
        return None
    shape, value, size = _classes(plain[4:])
    body = _spell(shape, move(value, size, f"iban{plain[:2]}{shape}"))
    check = 98 - _mod97(body + plain[:2] + "00")
    return _refill(text, f"{plain[:2]}{check:02d}{body}", "[A-Z0-9]")


def _email(text, move):
    local, _, host = text.partition("@")
    shape, value, size = _classes(local.lower())
    new = _spell(shape, move(value, size, f"email{shape}@{host.lower()}"))
    return "".join(n.upper() if c.isupper() else n for c, n in zip(local, new)) + "@" + host


def _date(text, move):
    mark = re.search(r"[/.-]", text)[0]
    parts = text.split(mark)
    a, b, c = map(int, parts)
    year_first = len(parts[0]) == 4
    month_first = not year_first and b > 12
    try:
        day = date(a, b, c) if year_first else date(c, a, b) if month_first else date(c, b, a)
    except ValueError:
        return None
    n = day.toordinal()
    if not _FIRST <= n <= _LAST:
        return None
    late = day.day > 12
    days = _days(late)  # of one class, so that the new date can be written, and read, the same way
    day = date.fromordinal(days[move(bisect_left(days, n), len(days), "late" if late else "early")])
    if year_first:
        return f"{day.year:04d}{mark}{day.month:02d}{mark}{day.day:02d}"
    wide = all(len(x) == 2 for x in parts[:2])
    two = (day.month, day.day) if month_first else (day.day, day.month)
    return mark.join([*(f"{x:02d}" if wide else str(x) for x in two), str(day.year)])


_MAKE = {"email": _email, "iban": _iban, "ip": _ip, "card": _card, "ssn": _ssn, "phone": _phone, "date": _date}


def _ends(kind: str, m: re.Match) -> Iterator[int]:
    """Where a match may end, by the order in which it is tried; the words behind a value can look like its last group.

    A card of four fours is tried without a tail and an IBAN at the length of its country before the whole match, since
    these readings don't depend on what follows: the pseudonym is then read as the value was. Phones lose groups from the end.
    """
    text = m[0]
    if kind == "card" and m[1] and len(text) > 19:
        yield m.start() + 19
    elif kind == "iban" and text[:2] in IBAN_LENGTHS:
        at = [i for i, c in enumerate(text, 1) if c != " "][IBAN_LENGTHS[text[:2]] - 1 :]
        if len(at) > 1 and text[at[0]] == " ":
            yield m.start() + at[0]
    yield m.end()
    if kind == "phone":
        yield from (m.start() + g.start() for g in reversed(list(re.finditer(r"[ .-]", text))))


def replace(text: str, permutation: Permutation, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with every valid value replaced, and the (kind, start, end) of each in the original text.

    Kinds come in the order of ``KINDS``; a place taken by an earlier kind is not read again. Where no reading of a match is
    valid, the search goes on behind its first character. A pseudonym with which a reading refused before would become valid
    (digits just in front of a card, one case in ten) is permuted again, so that it can be undone.
    """
    if not _ANY.search(text):
        return text, []
    move = permutation.undo if back else permutation.apply
    found: list[tuple[int, int, str, str]] = []
    rest = text  # with the places that are taken blotted out
    for kind in KINDS:
        make, at = _MAKE[kind], 0
        refused: list[tuple[int, int]] = []
        while m := PATTERNS[kind].search(rest, at):
            start, at = m.start(), m.start() + 1
            for end in _ends(kind, m):
                new = make(rest[start:end], move)
                if new is None:
                    refused.append((start, end))
                    continue
                near = [(a, b) for a, b in refused if b > start]
                while any(make((rest[a:start] + new + rest[end:b])[: b - a], move) is not None for a, b in near):
                    new = make(new, move)
                found.append((start, end, kind, new))
                refused, at = [], end
                break
        taken, last = [], 0
        for start, end, was, _ in found:
            if was == kind:
                taken += [rest[last:start], "\0" * (end - start)]
                last = end
        rest = "".join([*taken, rest[last:]]) if taken else rest
    found.sort()
    out, last = [], 0
    for start, end, _, new in found:
        out += [text[last:start], new]
        last = end
    return "".join([*out, text[last:]]), [(kind, start, end) for start, end, kind, _ in found]


def pseudonymize(docs: DataFrame, key: str | bytes, text: str = "text", spans: str | None = None, back: bool = False) -> DataFrame:
    """``docs`` with the values of its text column replaced; ``back`` undoes it with the same key.

    Every whole text is read. Null stays null, an empty text stays empty. All other columns, however named, stay as they are; ``spans``
    names an optional column with an array of (kind, start, end) in the original text, ends exclusive. The key must be
    secret and the same wherever values are to stay linked.
    """
    secret = key.encode() if isinstance(key, str) else key

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        permutation = Permutation(secret)
        for texts in batches:
            done = [(None, []) if t is None else replace(t, permutation, back) for t in texts]
            yield pd.DataFrame({"text": [t for t, _ in done], "spans": [[{"kind": k, "start": s, "end": e} for k, s, e in found] for _, found in done]})

    struct = "struct<text: string, spans: array<struct<kind: string, start: int, end: int>>>"
    made = F.pandas_udf(run, struct)(F.col(text))
    both = docs.select("*", made.alias("_pseudonym"))
    columns = [F.col("_pseudonym.text").alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return both.select(*columns, *([F.col("_pseudonym.spans").alias(spans)] if spans else []))
