"""Format-preserving pseudonyms for personal numbers, dates, addresses and secrets.

A value is validated, ranked within its format (all values of its layout), sent through
a keyed Feistel permutation of that range and written back in the same layout. So a
value has one pseudonym in every document, different values have different ones, a card
number still has its check digit, and a date is a date.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clustercat.llm.common import located, small_batches

ROUNDS = 10
# With more free characters than this a value is permuted place by place, in linear time.
LONG = 128
LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"

PATTERN = re.compile(
    r"""
    (?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_+-])?@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24})
    |(?P<iban>\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b)
    |(?P<access>\b(?:AKIA|ASIA)[A-Z0-9]{16}\b)
    |(?P<token>\b(?:gh[pousr]_|sk-|xox[abp]-)[A-Za-z0-9-]{16,})
    |(?P<secret>(?<![A-Za-z0-9])(?i:password|passwd|pwd|secret|token|api_?key)[ ]?[=:][ ]?["']?)(?P<secret_value>[A-Za-z0-9+/_-]{8,})
    |(?P<ip>(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9]))
    |(?P<date>(?<![0-9])(?:[0-9]{4}([-/.])[0-9]{1,2}\9[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\10[0-9]{4})(?![0-9]))
    |(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))
    |(?P<phone>\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9]|\.[0-9])
      |(?<![0-9(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9]|\.[0-9]))
    |(?P<card>(?<![0-9])(?:[0-9]{12,19}|[0-9]{4}(?P<gap>[ -])[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{1,7}
      |[0-9]{4}(?P<gap2>[ -])[0-9]{6}(?P=gap2)[0-9]{4,5})(?![0-9]|\.[0-9]))
    """,
    re.VERBOSE,
)
KINDS = ("email", "iban", "access", "token", "secret", "ip", "date", "ssn", "phone", "card")
# Every value has one of these: a digit, an at sign, the mark behind a secret's name, or the start of a token or access key.
HINT = re.compile(r"[0-9@=:]|gh[pousr]_|sk-|xox[abp]-|AKIA|ASIA")


def luhn_digit(payload: str) -> int:
    """The digit that makes ``payload`` and it pass the Luhn test."""
    total = 0
    for place, digit in enumerate(reversed(payload)):
        twice = int(digit) * (2 if place % 2 == 0 else 1)
        total += twice - 9 if twice > 9 else twice
    return -total % 10


def iban_valid(value: str) -> bool:
    moved = value[4:] + value[:4]
    return len(value) >= 15 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


class Permutation:
    """Keyed permutation of ``range(size)`` without fixed points, for any size from 2 on.

    A Feistel network on the two parts of a number in base ``half`` walks until it falls
    into the range. The result is the inverse of the network, one step, and the network:
    one cycle through the whole range in a secret order, so nothing is its own pseudonym.
    """

    def __init__(self, key: bytes, name: str, size: int):
        root = math.isqrt(size)
        self.size, self.half = size, root + (root * root < size)
        self.key, self.name = key, name.encode()
        # One digest is enough for short halves; a wider one needs more of them, or its upper part would stay.
        self.digests = max(1, -(-((self.half - 1).bit_length() + 64) // 256))

    def _round(self, number: int, side: int) -> int:
        message = b"%b|%d|%d|%d" % (self.name, self.size, number, side)
        parts = [hmac.new(self.key, message, hashlib.sha256).digest()]
        parts += [hmac.new(self.key, b"%b|%d" % (message, n), hashlib.sha256).digest() for n in range(1, self.digests)]
        return int.from_bytes(b"".join(reversed(parts)), "big")

    def _forward(self, value: int) -> int:
        while True:
            left, right = divmod(value, self.half)
            for number in range(ROUNDS):
                left, right = right, (left + self._round(number, right)) % self.half
            value = left * self.half + right
            if value < self.size:
                return value

    def _backward(self, value: int) -> int:
        while True:
            left, right = divmod(value, self.half)
            for number in reversed(range(ROUNDS)):
                left, right = (right - self._round(number, left)) % self.half, left
            value = left * self.half + right
            if value < self.size:
                return value

    def apply(self, value: int) -> int:
        return self._backward((self._forward(value) + 1) % self.size)

    def undo(self, value: int) -> int:
        return self._backward((self._forward(value) - 1) % self.size)


def _permute_places(key: bytes, name: str, places: np.ndarray, sizes: np.ndarray, back: bool) -> np.ndarray:
    """Keyed permutation of all rows of numbers below ``sizes``, without fixed points, in time linear in their count.

    The network's halves are those of the row, and a round adds to each place of one half a number drawn from the
    other half. Between the network and its inverse the first place takes one step.
    """
    cut = len(places) // 2
    sides = (slice(0, cut), slice(cut, None))

    def network(row: np.ndarray, inverse: bool) -> np.ndarray:
        row = row.copy()
        for number in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            to, of = sides[number % 2], sides[1 - number % 2]
            seed = hmac.new(key, b"%b|places|%d|%b" % (name.encode(), number, row[of].astype(np.uint8).tobytes()), hashlib.sha256)
            drawn = np.frombuffer(hashlib.shake_256(seed.digest()).digest(8 * len(row[to])), "<u8") % sizes[to].astype(np.uint64)
            row[to] = (row[to] + (-1 if inverse else 1) * drawn.astype(np.int64)) % sizes[to]
        return row

    row = network(places, False)
    row[0] = (row[0] + (-1 if back else 1)) % sizes[0]
    return network(row, True)


def _alphabets(value: str, hexadecimal: bool = False) -> list[str | None]:
    """The characters that may stand at each place; None where the value's own stays."""
    if hexadecimal and all(c in HEX for c in value):
        return [HEX] * len(value)
    kinds = (DIGITS, LOWER, UPPER)
    return [next((k for k in kinds if c in k), None) for c in value]


def permute_text(key: bytes, name: str, value: str, alphabets: list[str | None], back: bool = False) -> str:
    """The value with its free characters permuted as one number of mixed radix, or as places if they are many."""
    layout = "".join("-" if a is None else a[0] for a in alphabets)
    free = [i for i, a in enumerate(alphabets) if a]
    if len(free) > LONG:
        places = np.array([alphabets[i].index(value[i]) for i in free], np.int64)
        sizes = np.array([len(alphabets[i]) for i in free], np.int64)
        out = list(value)
        for i, place in zip(free, _permute_places(key, name + layout, places, sizes, back).tolist()):
            out[i] = alphabets[i][place]
        return "".join(out)
    rank, size = 0, 1
    for c, alphabet in zip(value, alphabets):
        if alphabet:
            rank, size = rank * len(alphabet) + alphabet.index(c), size * len(alphabet)
    if size < 2:
        return value
    permutation = Permutation(key, name + layout, size)
    rank = permutation.undo(rank) if back else permutation.apply(rank)
    out = []
    for c, alphabet in zip(reversed(value), reversed(alphabets)):
        if alphabet:
            rank, digit = divmod(rank, len(alphabet))
            c = alphabet[digit]
        out.append(c)
    return "".join(reversed(out))


def _digits_again(layout: str, digits: str) -> str:
    """``layout`` with its digits replaced in order."""
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in layout)


def _number(key: bytes, name: str, value: str, fixed: int = 0, back: bool = False) -> str:
    """All digits but the first ``fixed`` permuted."""
    digits = re.sub(r"[^0-9]", "", value)
    free = digits[fixed:]
    if not free:
        return value
    permutation = Permutation(key, f"{name}{digits[:fixed]}", 10 ** len(free))
    rank = permutation.undo(int(free)) if back else permutation.apply(int(free))
    return _digits_again(value, digits[:fixed] + str(rank).zfill(len(free)))


def _era(year: int) -> tuple[str, int, int]:
    """Name, first day and number of days of the years a date is permuted within: 1900 to 2099, or its century."""
    first, last = (1900, 2099) if 1900 <= year < 2100 else (max(year // 100 * 100, 1), year // 100 * 100 + 99)
    day = datetime.date(first, 1, 1).toordinal()
    return "" if first == 1900 else str(first), day, datetime.date(last, 12, 31).toordinal() + 1 - day


def _date(key: bytes, value: str, back: bool) -> str | None:
    mark = next(c for c in value if not c.isdigit())
    parts = value.split(mark)
    year_first = len(parts[0]) == 4
    year, month, day = parts if year_first else (parts[2], parts[1], parts[0])
    # Where day and month can only be the other way round, the month comes first.
    month_first = not year_first and int(month) > 12
    if month_first:
        month, day = day, month
    try:
        number = datetime.date(int(year), int(month), int(day)).toordinal()
    except ValueError:
        return None
    era, first_day, days = _era(int(year))
    number -= first_day
    # A layout is an order of the parts and how wide they are.
    wide = len(month) == len(day) == 2
    if wide:
        fits = lambda d: not year_first and (d.day > 12) != month_first and month_first
    else:
        fits = lambda d: not (len(str(d.month)) <= len(month) and len(str(d.day)) <= len(day)) or (month_first and d.day <= 12)
        if len(month) > len(str(int(month))) or len(day) > len(str(int(day))):  # a padded part keeps two digits
            fits = lambda d: not ((len(month) == 2 or d.month < 10) and (len(day) == 2 or d.day < 10)) or (month_first and d.day <= 12)
    permutation = Permutation(key, f"date{era}", days)
    while True:  # all layouts share one permutation and walk along it to the next date that reads the same in theirs
        number = permutation.undo(number) if back else permutation.apply(number)
        found = datetime.date.fromordinal(first_day + number)
        if not fits(found):
            break
    y, m, d = f"{found.year:04d}", str(found.month).zfill(len(month)), str(found.day).zfill(len(day))
    if year_first:
        return mark.join((y, m, d))
    return mark.join((m, d, y) if month_first else (d, m, y))


@lru_cache(maxsize=100_000)
def pseudonym(key: bytes, kind: str, value: str, back: bool = False, unvalidated: bool = False) -> str | None:
    """The value's pseudonym (or with ``back`` the value of a pseudonym); None if it isn't valid for its kind.

    With ``unvalidated`` card and account numbers that fail their check are permuted too.
    """
    if kind == "card":
        digits = re.sub(r"[^0-9]", "", value)
        if luhn_digit(digits[:-1]) != int(digits[-1]):
            # Not a card, but it may still identify someone.
            return _number(key, "number", value, back=back) if unvalidated else None
        free = _number(key, f"card{len(digits)}", digits[:-1], fixed=1, back=back)
        return _digits_again(value, free + str(luhn_digit(free)))
    if kind == "iban":
        packed = value.replace(" ", "")
        if not iban_valid(packed):
            return permute_text(key, "account", value, [None] * 2 + _alphabets(value[2:]), back) if unvalidated else None
        body = permute_text(key, f"iban{packed[:2]}", packed[4:], _alphabets(packed[4:]), back)
        moved = body + packed[:2] + "00"
        check = 98 - int("".join(str(int(c, 36)) for c in moved)) % 97
        letters = iter(packed[:2] + f"{check:02d}" + body)
        return "".join(c if c == " " else next(letters) for c in value)
    if kind == "ip":
        parts = [int(p) for p in value.split(".")]
        if max(parts) > 255:
            return None
        permutation = Permutation(key, "ip", 1 << 32)
        rank = int.from_bytes(bytes(parts), "big")
        rank = permutation.undo(rank) if back else permutation.apply(rank)
        return ".".join(map(str, rank.to_bytes(4, "big")))
    if kind == "date":
        return _date(key, value, back)
    if kind == "ssn":
        return _number(key, "ssn", value, back=back)
    if kind == "phone":
        digits = re.sub(r"[^0-9]", "", value)
        if not 7 <= len(digits) <= 16:
            return None
        country = re.match(r"\+([0-9]{1,3})(?=[ .(-])", value)
        fixed = len(country[1]) if country else 0
        return _number(key, f"phone{len(digits)}", value, fixed, back)
    if kind == "email":
        name, _, domain = value.rpartition("@")
        return f"{permute_text(key, 'email' + domain.lower(), name, _alphabets(name), back)}@{domain}"
    if kind == "access":
        alphabet = UPPER + DIGITS
        return permute_text(key, "access" + value[:4], value, [None] * 4 + [alphabet] * 16, back)
    if kind == "token":
        start = re.match(r"gh[pousr]_|sk-|xox[abp]-", value).end()
        return permute_text(key, "token" + value[:start], value, [None] * start + _alphabets(value[start:]), back)
    return permute_text(key, "secret", value, _alphabets(value, hexadecimal=True), back)


def pseudonymise(text: str, key: bytes, back: bool = False, unvalidated: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its values replaced, and ``kind, start, length`` of each in the new text."""
    if not HINT.search(text):
        return text, []
    out, spans, at, size = [], [], 0, 0
    for m in PATTERN.finditer(text):
        kind = next(k for k in KINDS if m[k] is not None)
        start, end = m.span("secret_value") if kind == "secret" else m.span()
        # A long value isn't remembered.
        make = pseudonym if end - start <= 2 * LONG else pseudonym.__wrapped__
        new = make(key, kind, text[start:end], back, unvalidated)
        if new is None:
            continue
        out += [text[at:start], new]
        size += start - at
        spans.append((kind, size, len(new)))
        size += len(new)
        at = end
    return "".join([*out, text[at:]]), spans


def pseudonymise_documents(
    docs: DataFrame, key: bytes, id_column: str = "doc_id", text_column: str = "text", unvalidated: bool = False
) -> DataFrame:
    """One row per row of ``docs``: ``id, text, values`` and its locator; ``values`` lists ``kind, start, length``.

    Whole texts are read. A null text stays null and has no values; an empty one stays empty; repeated
    rows and ids are rows of their own; other columns are ignored; an empty table gives no rows.
    Addresses and dates that cannot exist and card and account numbers that fail their check stay as
    they are; with ``unvalidated`` those numbers are permuted too. A telephone number has one pseudonym
    in all layouts, a date in all that start with the year.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))
        for batch in batches:
            texts, found = [], []
            for text in batch.column(0):
                text = text.as_py()
                new, spans = (None, []) if text is None else pseudonymise(text, key, unvalidated=unvalidated)
                texts.append(new)
                found.append([{"kind": k, "start": s, "length": n} for k, s, n in spans])
            arrays = [pa.array(texts, pa.string()), pa.array(found, values)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *arrays], [*batch.schema.names[1:], "text", "values"])

    small_batches(docs)
    source = located(docs.select(F.col(text_column).cast("string").alias("text"), F.col(id_column).alias("id")))
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, _cc_file long, _cc_row long, text string, values array<struct<kind string, start int, length int>>"
    return source.select("text", "id", "_cc_file", "_cc_row").mapInArrow(convert, schema)
