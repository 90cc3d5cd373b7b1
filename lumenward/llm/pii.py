"""Personal data replaced by format-preserving pseudonyms.

Numbers and dates that pass their own validation (check digits, ranges, the calendar) are numbered within the set
of all valid values of their format and permuted there by a keyed Feistel network with cycle walking. A pseudonym
is again valid and looks the same; equal values get equal pseudonyms in every document and in every spelling;
whoever has the key can undo it.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenward.llm import common

#: A stand-in: production passes a secret of its own.
KEY = b"lumenward public demonstration key"
ROUNDS = 10
KINDS = ("email", "iban", "card", "date", "ssn", "phone", "ip")
FIRST_DAY, END_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal()


def _round(key: bytes, tweak: str, number: int, value: int, size: int) -> int:
    data = f"{tweak}|{number}|{size}|{value}".encode()
    return int.from_bytes(hashlib.blake2b(data, key=key[:64], digest_size=size.bit_length() // 8 + 16).digest(), "big") % size


def permute(x: int, size: int, key: bytes, tweak: str, undo: bool = False) -> int:
    """A keyed permutation of range(size), or its inverse.

    A Feistel network over pairs (x // b, x % b) with a * b >= size; results beyond size walk on, and as
    a * b < size + 2 * sqrt(size) + 1, few do.
    """
    if size < 2:
        return x
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    while True:
        left, right = divmod(x, b)
        for r in reversed(range(ROUNDS)) if undo else range(ROUNDS):
            sign = -1 if undo else 1
            if r % 2 == 0:
                left = (left + sign * _round(key, tweak, r, right, a)) % a
            else:
                right = (right + sign * _round(key, tweak, r, left, b)) % b
        x = left * b + right
        if x < size:
            return x


def luhn(digits: str) -> int:
    """The sum of a number with its check digit, modulo 10: 0 if it is valid."""
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10


def iban_rest(text: str) -> int:
    """1 if the IBAN is valid."""
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _letters(text: str, key: bytes, tweak: str, undo: bool) -> str:
    """Letters and digits of a lower-case ASCII string permuted within their classes; all else stays."""
    sizes = [10 if c.isdigit() else 26 if "a" <= c <= "z" else 1 for c in text]
    x = 0
    for c, n in zip(text, sizes, strict=True):
        x = x * n + (int(c) if n == 10 else ord(c) - 97 if n == 26 else 0)
    shape = "".join({10: "0", 26: "a"}.get(n, c) for c, n in zip(text, sizes, strict=True))
    x = permute(x, math.prod(sizes), key, f"{tweak}|{shape}", undo)
    out = []
    for c, n in zip(reversed(text), reversed(sizes), strict=True):
        x, at = divmod(x, n)
        out.append(str(at) if n == 10 else chr(97 + at) if n == 26 else c)
    return "".join(reversed(out))


def _email(text: str, key: bytes, undo: bool) -> str | None:
    """The part before the @, whatever its case; the domain stays and is part of the format."""
    name, _, domain = text.partition("@")
    if not name.isascii() or len(name) > 64:
        return None
    new = _letters(name.lower(), key, f"email|{domain.lower()}", undo)
    return "".join(n.upper() if c.isupper() else n for c, n in zip(name, new, strict=True)) + "@" + domain


def _digits(text: str, new: str) -> str:
    """text with its letters and digits replaced in order."""
    to = iter(new)
    return "".join(next(to) if c.isalnum() else c for c in text)


def _card(text: str, key: bytes, undo: bool) -> str | None:
    """13 to 19 digits that pass the Luhn sum and begin with 2 to 6; the first digit stays, the last follows."""
    d = re.sub(r"\D", "", text)
    if not 13 <= len(d) <= 19 or d[0] not in "23456" or luhn(d) or len(set(d)) == 1:
        return None
    middle = len(d) - 2
    body = d[0] + str(permute(int(d[1:-1]), 10**middle, key, f"card|{len(d)}|{d[0]}", undo)).zfill(middle)
    return _digits(text, body + str(-luhn(body + "0") % 10))


def _iban(text: str, key: bytes, undo: bool) -> str | None:
    """An IBAN with right check digits; the country stays, the check digits follow."""
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or iban_rest(plain) != 1:
        return None
    body = _letters(plain[4:].lower(), key, f"iban|{plain[:2]}", undo).upper()
    check = 98 - iban_rest(plain[:2] + "00" + body)
    return _digits(text, f"{plain[:2]}{check:02d}{body}")


def _ssn(text: str, key: bytes, undo: bool) -> str | None:
    """A US social security number: area not 000, 666 or 900 on, group not 00, serial not 0000."""
    area, group, serial = (int(p) for p in re.findall(r"\d+", text))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x, serial = divmod(permute(x, 898 * 99 * 9999, key, "ssn", undo), 9999)
    area, group = divmod(x, 99)
    area += 1 + (area + 1 >= 666)
    return _digits(text, f"{area:03d}{group + 1:02d}{serial + 1:04d}")


def _phone(text: str, key: bytes, undo: bool) -> str | None:
    """A North American number, or an international one after a plus sign; the country code's digits stay.

    A ten-digit number whose area or office code begins with 0 or 1 counts if it is written with +1 or
    parentheses; its pseudonym is of the same kind.
    """
    d = re.sub(r"\D", "", text)
    home = d[1:] if len(d) == 11 and d[0] == "1" else d
    if len(home) == 10 and (len(d) == 11 or not text.startswith("+")):
        if home[0] in "01" or home[3] in "01":
            if text[0] not in "+(":
                return None
            while True:  # walk on until the kind is the same
                home = str(permute(int(home), 10**10, key, "phone|other", undo)).zfill(10)
                if home[0] in "01" or home[3] in "01":
                    return _digits(text, d[: len(d) - 10] + home)
        x = ((int(home[:3]) - 200) * 800 + int(home[3:6]) - 200) * 10_000 + int(home[6:])
        x, line = divmod(permute(x, 800 * 800 * 10_000, key, "phone|1", undo), 10_000)
        area, office = divmod(x, 800)
        return _digits(text, d[: len(d) - 10] + f"{area + 200}{office + 200}{line:04d}")
    if text.startswith("+") and d[0] not in "01" and 9 <= len(d) <= 15:
        rest = len(d) - 2
        return _digits(text, d[:2] + str(permute(int(d[2:]), 10**rest, key, f"phone|{d[:2]}|{len(d)}", undo)).zfill(rest))
    return None


#: First value and number of values of an address part by its width.
_PARTS = {1: (0, 10), 2: (10, 90), 3: (100, 156)}


def _ip(text: str, key: bytes, undo: bool) -> str | None:
    """An IPv4 address; the parts' widths stay. A part of 256 or more, or with a leading zero, is none."""
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    ranges = [_PARTS[len(p)] for p in parts]
    x = 0
    for p, (low, n) in zip(parts, ranges, strict=True):
        x = x * n + int(p) - low
    x = permute(x, math.prod(n for _, n in ranges), key, "ip|" + "".join(str(len(p)) for p in parts), undo)
    out = []
    for low, n in reversed(ranges):
        x, at = divmod(x, n)
        out.append(str(low + at))
    return ".".join(reversed(out))


def _fits(value: int, form: str) -> bool:
    """Whether a day or month can be written in a form: `1` one digit, `0` a zero and a digit, `2` two digits, `*` any two."""
    return form == "*" or (value < 10) == (form != "2")


@lru_cache(maxsize=64)
def _days(late: bool, day: str, month: str) -> tuple[list[int], dict[int, int]]:
    """All days that can be written so, and the place of each; late: only those that cannot be day-month-year."""
    dates = ((d, datetime.date.fromordinal(d)) for d in range(FIRST_DAY, END_DAY))
    found = [d for d, t in dates if (not late or t.day > 12) and _fits(t.day, day) and _fits(t.month, month)]
    return found, {d: i for i, d in enumerate(found)}


def _date(text: str, key: bytes, undo: bool) -> str | None:
    """A calendar date from 1900 to 2099, in the order year-month-day, day-month-year or month-day-year.

    A number pair that could be either order is read as day-month-year. Dates that can only be month-day-year
    are permuted among those of their kind, so that their pseudonyms read the same way. Where day or month has
    one digit only, widths and leading zeros stay; two digits each are one format in all orders.
    """
    a, b, c = re.findall(r"\d+", text)
    year_first = len(a) == 4
    late = not year_first and int(b) > 12
    year, month, day = (a, b, c) if year_first else (c, a, b) if late else (c, b, a)
    try:
        at = datetime.date(int(year), int(month), int(day)).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= at < END_DAY:
        return None
    form = (lambda p: "*") if len(day) == len(month) == 2 else lambda p: "1" if len(p) == 1 else "0" if p[0] == "0" else "2"
    days, place = _days(late, form(day), form(month))
    new = days[permute(place[at], len(days), key, f"date|{late:d}{form(day)}{form(month)}", undo)]
    to = datetime.date.fromordinal(new)
    y, m, d = str(to.year), f"{to.month:0{len(month)}d}", f"{to.day:0{len(day)}d}"
    out = iter((y, m, d) if year_first else (m, d, y) if late else (d, m, y))
    return re.sub(r"\d+", lambda _: next(out), text)


_MAKERS: dict[str, Callable[[str, bytes, bool], str | None]] = {"email": _email, "iban": _iban, "card": _card, "date": _date, "ssn": _ssn, "phone": _phone, "ip": _ip}
_EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-])")
_NUMBERS = {
    "iban": re.compile(r"(?<![\w/-])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w-])"),
    "card": re.compile(r"(?<![\w.+/-])[2-6][0-9]{3}(?:[ -]?[0-9]{3,6}){2,4}(?![\w/-]|\.[0-9])"),
    "date": re.compile(r"(?<![\w./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![\w/-]|\.[0-9])"),
    "ssn": re.compile(r"(?<![\w./-])[0-9]{3}([- ])[0-9]{2}\1[0-9]{4}(?![\w/-]|\.[0-9])"),
    "phone": re.compile(r"(?<![\w.+/-])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w/-]|\.[0-9])|(?<![\w.+/-])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![\w/-]|\.[0-9])"),
    "ip": re.compile(r"(?<![\w./-])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w/-]|\.[0-9])"),
}
#: Kinds written in groups: if a match fails, fewer of its groups are tried, as a neighbour may have been taken in.
_GROUPED = ("iban", "card")
_GROUP = re.compile(r"[0-9A-Z]+")
#: Where a number can be: from a digit on, all characters that any pattern above may use.
_REGION = re.compile(r"[0-9][0-9A-Z ()./+-]{6,}")
#: Characters before a region's first digit that may belong to a number.
_BEFORE = 3


@lru_cache(maxsize=200_000)
def pseudonym(kind: str, value: str, key: bytes = KEY, undo: bool = False) -> str | None:
    """The pseudonym of a value, the value of a pseudonym, or None if the value is not valid."""
    return _MAKERS[kind](value, key, undo)


def _longest(kind: str, pattern: re.Pattern, match: str, key: bytes, undo: bool) -> tuple[int, str] | None:
    """How much of a match is a valid value, whole groups from its beginning, and the pseudonym."""
    new = pseudonym(kind, match, key, undo)
    if new is not None or kind not in _GROUPED:
        return new and (len(match), new)
    for stop in [g.end() for g in _GROUP.finditer(match)][-2::-1]:
        if match[stop] == " " and pattern.fullmatch(match[:stop]) and (new := pseudonym(kind, match[:stop], key, undo)):
            return stop, new
    return None


def _first(kind: str, pattern: re.Pattern, text: str, at: int, key: bytes, undo: bool) -> tuple[int, int] | None:
    """(start, stop) of the first valid value of a grouped kind from a place on."""
    while (m := pattern.search(text, at)) is not None:
        if (got := _longest(kind, pattern, m.group(), key, undo)) is not None:
            return m.start(), m.start() + got[0]
        at = _GROUP.search(text, m.start()).end()
    return None


def findings(text: str, key: bytes = KEY, undo: bool = False) -> list[tuple[int, int, str, str]]:
    """(start, stop, kind, pseudonym) of the valid values in a text, in order; of overlapping ones the first kind.

    Where a pattern took in a neighbouring group, a value is found among fewer groups. Its pseudonym is then the
    first in the permutation's cycle that is found at the same place, so that it can be undone; only there can
    equal values get different pseudonyms.
    """
    found: list[tuple[int, int, str, str]] = []

    def take(kind: str, pattern: re.Pattern, a: int, b: int) -> None:
        lead = lead_stop = 0  # where tries that failed began, and what they reached over
        while (m := pattern.search(text, a, b)) is not None:
            if m.start() >= lead_stop:
                lead = m.start()
            got = _longest(kind, pattern, m.group(), key, undo)
            if got is None:
                a = _GROUP.search(text, m.start()).end() if kind in _GROUPED else m.end()
                lead_stop = max(lead_stop, m.end())
                continue
            stop, new = m.start() + got[0], got[1]
            if kind in _GROUPED and (lead < m.start() or stop < m.end()):
                low, high = max(0, lead - _BEFORE), min(len(text), m.end() + 1)
                seen = lambda new: _first(kind, pattern, text[low : m.start()] + new + text[stop:high], lead - low, key, undo)  # noqa: B023, E731
                while seen(new) != (m.start() - low, stop - low):
                    new = pseudonym(kind, new, key, undo)
            a, lead_stop = stop, 0
            at = bisect_left(found, (m.start(), stop))  # found is sorted and disjoint here
            if (at == 0 or found[at - 1][1] <= m.start()) and (at == len(found) or stop <= found[at][0]):
                found.insert(at, (m.start(), stop, kind, new))

    if "@" in text:
        take("email", _EMAIL, 0, len(text))
    emails = len(found)
    for region in _REGION.finditer(text):
        a, b = max(0, region.start() - _BEFORE), min(len(text), region.end() + 1)
        inside = [f for f in found[:emails] if f[0] < b and a < f[1]] if emails else []
        kept, found = found, inside
        for kind, pattern in _NUMBERS.items():
            take(kind, pattern, a, b)
        kept += [f for f in found if f[2] != "email"]
        found = kept
    return sorted(found)


def replaced(text: str, found: list[tuple[int, int, str, str]]) -> str:
    """text with its findings replaced; they must be in order and disjoint."""
    out, at = [], 0
    for a, b, _, new in found:
        if a < at:
            raise ValueError(f"findings overlap at {a}")
        out += (text[at:a], new)
        at = b
    return "".join((*out, text[at:]))


def pseudonymised(spark: SparkSession, text: Column, key: bytes = KEY) -> Column:
    """struct<text, found>: the text with pseudonyms, and where they replaced what kind. Row-local."""

    @F.pandas_udf("struct<text:string,found:array<struct<kind:string,start:int,stop:int,pseudonym:string>>>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            own = [findings(t, key) for t in texts]
            spans = [[{"kind": k, "start": a, "stop": b, "pseudonym": p} for a, b, k, p in f] for f in own]
            yield pd.DataFrame({"text": [replaced(t, f) if f else t for t, f in zip(texts, own, strict=True)], "found": spans})

    return apply(common.text_of(text))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: how many values of each kind, their places and pseudonyms, and the new text's digest.

    Null and empty texts: no values, the digest of the empty text. Repeated rows and null ids: a row each.
    Empty table: no rows. Other columns of documents are not read.
    """
    common.arrow_batches(spark)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    done = docs.select("doc_id", pseudonymised(spark, F.col("text")).alias("__p")).select("doc_id", "__p.text", "__p.found")
    counts = [F.expr(f"size(filter(found, f -> f.kind = '{k}'))").alias(f"n_{k}") for k in KINDS]
    return done.select("doc_id", F.size("found").alias("n_found"), *counts, F.sha2(F.col("text"), 256).alias("text_sha256"), "found")
