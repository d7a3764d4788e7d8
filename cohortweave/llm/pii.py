"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass their validation, and local parts of mail addresses, are
replaced by a keyed permutation of their own format: a Feistel network over the
values of that format.  Separators, length, letter case and check digits stay valid, and equal
values get equal pseudonyms in all documents, so records stay linked while the
values are gone without the key.  Where a match fails its validation, its shorter ends at
a border of groups are tried, then the search goes on from inside it.

A text is read in its task; there is no shuffle and no shared table.  The scan is
linear in the text.

Cases: a null text stays null and has no finding; an empty text stays empty; repeated rows and
equal ids are treated row by row; numbers that fail their validation are left
alone; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortweave.llm.common import bound_batches, pick

ROUNDS = 10
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
#: Lengths of account numbers by country.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27,
    "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24,
}

KINDS = ("email", "iban", "ssn", "phone", "card", "ip", "date")
PATTERNS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,24}(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": (
        r"(?<![\w+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\w)"
        r"|(?<![\w+])\+\d{1,3}(?:[ -]?\(\d{1,4}\))?(?:[ -]?\d{2,4}){2,5}(?!\w|\.\d)"
        r"|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\w)"
        r"|(?<![\w.-])\d{3}([.-])\d{3}\1\d{4}(?![\w-])"
    ),
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)",
    "date": (
        r"(?<![\w-])\d{4}-\d{2}-\d{2}(?![\w-])"
        r"|(?<![\w/.])\d{1,2}/\d{1,2}/\d{4}(?![\w/])"
        r"|(?<![\w/.])\d{1,2}\.\d{1,2}\.\d{4}(?!\w|\.\d)"
    ),
}
_COMPILED = {kind: re.compile(PATTERNS[kind]) for kind in KINDS}


class Feistel:
    """A keyed permutation of 0..a*b-1 for any a and b, one per format."""

    def __init__(self, key: bytes):
        self._key = key

    def permute(self, value: int, a: int, b: int, form: str) -> int:
        left, right = divmod(value, b)
        for turn in range(ROUNDS):
            if turn % 2:
                right = (right + self._noise(form, turn, left)) % b
            else:
                left = (left + self._noise(form, turn, right)) % a
        return left * b + right

    def _noise(self, form: str, turn: int, half: int) -> int:
        return int.from_bytes(hmac.digest(self._key, f"{form}:{turn}:{half}".encode(), "sha256"), "big")

    def within(self, value: int, a: int, b: int, form: str, valid: Callable[[int], bool]) -> int:
        """A permutation of the valid values only: walks on until it meets one."""
        value = self.permute(value, a, b, form)
        while not valid(value):
            value = self.permute(value, a, b, form)
        return value

    def characters(self, text: str, form: str) -> str:
        """Letters to letters of their case and digits to digits; all else stays.

        A Feistel network whose halves are characters: each character of one half moves by its own part of
        a key stream drawn from the other half.  So values of any length change throughout, in linear time.
        """
        sizes = [26 if "a" <= c.lower() <= "z" else 10 if "0" <= c <= "9" else 1 for c in text]
        bases = ["a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else c for c in text]
        places = [ord(c) - ord(base) for c, base in zip(text, bases)]
        half = len(text) // 2
        form = form + ":" + "".join(bases)
        for turn in range(ROUNDS):
            moved, other = (range(half, len(text)), places[:half]) if turn % 2 else (range(half), places[half:])
            seed = hmac.digest(self._key, f"{form}:{turn}:".encode() + bytes(other), "sha256")
            stream = hashlib.shake_256(seed).digest(8 * len(moved))
            for k, i in enumerate(moved):
                places[i] = (places[i] + int.from_bytes(stream[8 * k : 8 * k + 8], "big")) % sizes[i]
        return "".join(chr(ord(base) + place) for base, place in zip(bases, places))


def luhn_digit(digits: str) -> str:
    """Check digit that completes a card number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_check(country: str, account: str) -> str:
    moved = account + country + "00"
    return f"{98 - int(''.join(str(int(c, 36)) for c in moved)) % 97:02d}"


def _refill(shape: str, characters: str) -> str:
    """``shape`` with its letters and digits replaced in turn."""
    fresh = iter(characters)
    return "".join(next(fresh) if c.isascii() and c.isalnum() else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isascii() and c.isdigit())


def _email(f: Feistel, found: str) -> str | None:
    local, _, host = found.rpartition("@")
    # the host is part of the form, so equal names at two hosts are not linked
    return f.characters(local, "email:" + host.lower()) + "@" + host


def _iban(f: Feistel, found: str) -> str | None:
    plain = found.replace(" ", "")
    country, check, account = plain[:2], plain[2:4], plain[4:]
    if len(plain) != IBAN_LENGTHS.get(country) or iban_check(country, account) != check:
        return None
    fresh = f.characters(account, "iban:" + country)
    return _refill(found, country + iban_check(country, fresh) + fresh)


def _ssn(f: Feistel, found: str) -> str | None:
    def valid(n: int) -> bool:
        area, rest = divmod(n, 1_000_000)
        return 0 < area < 900 and area != 666 and rest // 10_000 > 0 and rest % 10_000 > 0

    value = int(_digits(found))
    return _refill(found, f"{f.within(value, 1000, 1_000_000, 'ssn', valid):09d}") if valid(value) else None


def _phone(f: Feistel, found: str) -> str | None:
    digits = _digits(found)
    if not 10 <= len(digits) <= 15:
        return None
    # the last ten digits are the number, before them a country's
    country, own = digits[:-10], digits[-10:]
    return _refill(found, country + f.characters(own, "phone:" + country))


def _card(f: Feistel, found: str) -> str | None:
    digits = _digits(found)
    if len(digits) < 13:
        return None
    if luhn_digit(digits[:-1]) != digits[-1]:
        return None
    fresh = f.characters(digits[:-1], "card")
    return _refill(found, fresh + luhn_digit(fresh))


def _ip(f: Feistel, found: str) -> str | None:
    parts = [int(p) for p in found.split(".")]
    if max(parts) > 255:
        return None
    value = int.from_bytes(bytes(parts), "big")
    return ".".join(str(p) for p in f.permute(value, 1 << 16, 1 << 16, "ip").to_bytes(4, "big"))


def _date(f: Feistel, found: str) -> str | None:
    separator = next(c for c in found if not c.isdigit())
    parts = found.split(separator)
    order = (0, 1, 2) if separator == "-" else (2, 1, 0) if separator == "." or int(parts[0]) > 12 else (2, 0, 1)
    year, month, day = (int(parts[i]) for i in order)
    try:
        value = (date(year, month, day) - FIRST_DAY).days
    except ValueError:
        return None
    days = (LAST_DAY - FIRST_DAY).days + 1
    if not 0 <= value < days:
        return None
    # the same form for all ways of writing; days beyond 12 stay so where that tells day from month
    late = order == (2, 1, 0) and separator == "/"

    def valid(n: int) -> bool:
        return n < days and (not late or (FIRST_DAY + timedelta(n)).day > 12)

    fresh = FIRST_DAY + timedelta(f.within(value, 271, 271, "date-late" if late else "date", valid))
    written = {order[0]: f"{fresh.year:04d}", order[1]: str(fresh.month), order[2]: str(fresh.day)}
    return separator.join(written[i].zfill(len(parts[i]) if len(parts[i]) > 1 else 1) for i in range(3))


_RULES: dict[str, Callable[[Feistel, str], str | None]] = {
    "email": _email, "iban": _iban, "ssn": _ssn, "phone": _phone, "card": _card, "ip": _ip, "date": _date,
}


#: Kinds whose matches may run on into the groups that follow a value.
_OPEN_ENDED = ("iban", "phone", "card")


def _valid(kind: str, text: str, feistel: Feistel) -> Iterator[tuple[int, int, str]]:
    """(start, end, pseudonym) of the valid values of a kind, from left to right."""
    at = 0
    while match := _COMPILED[kind].search(text, at):
        start, stop = match.span()
        at = start + 1
        ends = [stop]
        if kind in _OPEN_ENDED:
            ends += [e for e in range(stop - 1, start, -1) if text[e] in " -" and text[e - 1].isalnum()]
        for end in ends:
            fresh = _RULES[kind](feistel, text[start:end])
            if fresh is not None:
                yield start, end, fresh
                at = end
                break


def pseudonymised(text: str | None, feistel: Feistel) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of what they replaced in the given text."""
    if not text or not ("@" in text or re.search("[0-9]", text)):
        return text, []
    found: list[tuple[int, int, str, str]] = []
    for kind in KINDS:
        if kind == "email" and "@" not in text:
            continue
        found += [(start, stop, kind, fresh) for start, stop, fresh in _valid(kind, text, feistel)]
    # where findings overlap, the one that begins first counts, then the one of the earlier kind
    found.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    out, spans, end = [], [], 0
    for start, stop, kind, fresh in found:
        if start >= end:
            out += [text[end:start], fresh]
            spans.append((kind, start, stop))
            end = stop
    return "".join([*out, text[end:]]), spans


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, ``text`` with pseudonyms and ``found`` (kind, start, end) of all documents (doc_id, text)."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("text string, found array<struct<kind:string,start:int,end:int>>")
    def replaced(texts: pd.Series) -> pd.DataFrame:
        feistel = Feistel(key)
        rows = [pseudonymised(t, feistel) for t in texts]
        found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans] for _, spans in rows]
        return pd.DataFrame({"text": [t for t, _ in rows], "found": found})

    return (
        pick(docs, "doc_id", "text")
        .select("doc_id", replaced("text").alias("_out"))
        .select("doc_id", "_out.text", "_out.found")
    )
