"""Personal data: values that pass their checks are replaced by pseudonyms of the same format.

A value is turned into a number below the count of all values of its format, that number is permuted by a keyed Feistel
network (walking on until the result is in range), and the result is written in the same format: a card number stays a
card number with a right check digit, a date a date. Equal values get equal pseudonyms in all documents, whatever
separators they are written with, and the key's owner can turn them back; only a card or IBAN whose pseudonym would be
misread together with digits next to it gets another one there. One pass over the table, no shuffle.
"""

from __future__ import annotations

import bisect
import calendar
import hashlib
import ipaddress
import re
from collections import Counter
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

ROUNDS = 10
#: Characters that are permuted together at most.
LONG = 256
#: Dates from and to.
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


class Feistel:
    """A keyed permutation of 0 .. n-1 for every n; tweak keeps formats apart."""

    def __init__(self, key: bytes):
        self.key = key
        self._permute = lru_cache(maxsize=100_000)(self._walk)

    def _mix(self, tweak: str, n: int, turn: int, half: int, bits: int) -> int:
        size = -(-bits // 8)
        out, block = b"", 0
        while len(out) < size:
            out += hashlib.blake2b(f"{tweak}|{n}|{turn}|{half}|{block}".encode(), key=self.key, digest_size=64).digest()
            block += 1
        return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)

    def _walk(self, tweak: str, n: int, x: int, back: bool) -> int:
        if n < 2:
            return x
        half = -(-(n - 1).bit_length() // 2)
        while True:
            a, b = x >> half, x & ((1 << half) - 1)
            for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if back:
                    a, b = b ^ self._mix(tweak, n, turn, a, half), a
                else:
                    a, b = b, a ^ self._mix(tweak, n, turn, b, half)
            x = a << half | b
            if x < n:
                return x

    def permute(self, tweak: str, n: int, x: int, back: bool = False) -> int:
        return self._permute(tweak, n, x, back)


def luhn(digits: str) -> int:
    """The digit that has to follow."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (2 if i % 2 == 0 else 1)
        total += v - 9 if v > 9 else v
    return -total % 10


def refill(pattern: str, chars: str, keep: str) -> str:
    """chars in the places of pattern that are in keep; the rest of pattern as it is."""
    own = iter(chars)
    return "".join(next(own) if c in keep else c for c in pattern)


def by_class(value: str, f: Feistel, tweak: str, back: bool) -> str:
    """Letters and digits permuted together, each place within its class; other characters stay. Over LONG characters, LONG at a time."""
    if len(value) > LONG:
        return "".join(by_class(value[i : i + LONG], f, f"{tweak}{i}/", back) for i in range(0, len(value), LONG))
    sets = [next((s for s in (DIGITS, LOWER, UPPER) if c in s), c) for c in value]
    n, x = 1, 0
    for c, s in zip(value, sets, strict=True):
        n, x = n * len(s), x * len(s) + s.index(c)
    x = f.permute(f"{tweak}{''.join(str(len(s)) + ',' for s in sets)}", n, x, back)
    out = []
    for s in reversed(sets):
        x, r = divmod(x, len(s))
        out.append(s[r])
    return "".join(reversed(out))


def card(value: str, f: Feistel, back: bool = False) -> str | None:
    d = re.sub(r"\D", "", value)
    if not 13 <= len(d) <= 19 or luhn(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
        return None
    body = str(f.permute(f"card{len(d)}", 10 ** (len(d) - 1), int(d[:-1]), back)).zfill(len(d) - 1)
    return refill(value, body + str(luhn(body)), DIGITS)


def iban(value: str, f: Feistel, back: bool = False) -> str | None:
    s = value.replace(" ", "")
    number = lambda x: int("".join(str(int(c, 36)) for c in x))
    if not 15 <= len(s) <= 34 or number(s[4:] + s[:4]) % 97 != 1:
        return None
    body = by_class(s[4:], f, "iban" + s[:2], back)
    check = 98 - number(body + s[:2] + "00") % 97
    return refill(value, s[:2] + f"{check:02d}" + body, DIGITS + UPPER)


def social(value: str, f: Feistel, back: bool = False) -> str | None:
    a, g, s = map(int, value.split("-"))
    if a in (0, 666) or a >= 900 or not g or not s:
        return None
    own = a - 1 - (a > 666)
    x = f.permute("social", 898 * 99 * 9999, (own * 99 + g - 1) * 9999 + s - 1, back)
    x, s = divmod(x, 9999)
    a, g = divmod(x, 99)
    a = a + 1 + (a >= 665)
    return f"{a:03d}-{g + 1:02d}-{s + 1:04d}"


def phone(value: str, f: Feistel, back: bool = False) -> str | None:
    d = re.sub(r"\D", "", value)
    lead, d = (d[:-10], d[-10:]) if len(d) >= 10 else ("", "")
    if not d or lead not in ("", "1") or d[0] in "01" or d[3] in "01":
        return None
    x = (int(d[:3]) - 200) * 800 * 10**4 + (int(d[3:6]) - 200) * 10**4 + int(d[6:])
    x = f.permute("phone", 800 * 800 * 10**4, x, back)
    x, line = divmod(x, 10**4)
    a, b = divmod(x, 800)
    return refill(value, f"{lead}{a + 200:03d}{b + 200:03d}{line:04d}", DIGITS)


def address(value: str, f: Feistel, back: bool = False) -> str | None:
    try:
        x = int(ipaddress.IPv4Address(value))
    except ValueError:
        return None
    return str(ipaddress.IPv4Address(f.permute("ip", 2**32, x, back)))


def email(value: str, f: Feistel, back: bool = False) -> str | None:
    """The part before the @ and the domain but for its ending."""
    own, _, domain = value.rpartition("@")
    name, dot, end = domain.rpartition(".")
    return f"{by_class(own, f, 'mail', back)}@{by_class(name, f, 'domain', back)}{dot}{end}" if dot else None


def day(value: str, f: Feistel, back: bool = False) -> str | None:
    """Dates written year-month-day, or day and month before the year (the month first only where that alone is a date)."""
    parts = re.split(r"([-/.])", value)
    if len(parts) != 5 or parts[1] != parts[3]:
        return None
    n = [int(parts[i]) for i in (0, 2, 4)]
    order = (0, 1, 2) if len(parts[0]) == 4 else (2, 1, 0)
    y, m, d = (n[i] for i in order)
    if m > 12 and order == (2, 1, 0):
        order = (2, 0, 1)
        y, m, d = (n[i] for i in order)
    if not (FIRST_DAY.year <= y <= LAST_DAY.year and 1 <= m <= 12 and 1 <= d <= calendar.monthrange(y, m)[1]):
        return None
    # only days after the 12th tell the month first apart: in all ways of writing they stay such, so a date has one pseudonym
    days = _days(d > 12)
    new = FIRST_DAY + timedelta(days[f.permute("late" if d > 12 else "early", len(days), bisect.bisect_left(days, (date(y, m, d) - FIRST_DAY).days), back)])
    out = [""] * 3
    for i, v in zip(order, (f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"), strict=True):
        out[i] = v
    return f"{out[0]}{parts[1]}{out[1]}{parts[3]}{out[2]}"


@lru_cache(maxsize=2)
def _days(late: bool) -> list[int]:
    return [i for i in range((LAST_DAY - FIRST_DAY).days + 1) if ((FIRST_DAY + timedelta(i)).day > 12) == late]


def token(value: str, f: Feistel, back: bool = False) -> str | None:
    """Long random strings: hexadecimal ones stay such."""
    if re.fullmatch(r"[0-9a-f]+", value):
        n = f.permute(f"hex{len(value)}", 16 ** len(value), int(value, 16), back)
        return f"{n:0{len(value)}x}"
    return value[:4] + by_class(value[4:], f, "token", back)


KINDS: dict[str, tuple[str, Callable[..., str | None]]] = {
    "email": (r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", email),
    "token": (r"(?<![0-9A-Za-z])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32}|AKIA[0-9A-Z]{16}|ghp_[0-9A-Za-z]{36})(?![0-9A-Za-z])", token),
    "iban": (r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,4})?(?![0-9A-Za-z])", iban),
    "card": (r"(?<![0-9A-Za-z.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])", card),
    "date": (r"(?<![0-9./-])(?:[0-9]{4}([-/.])[0-9]{2}\3[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\4[0-9]{4})(?![0-9]|[./-][0-9])", day),
    "social": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", social),
    "phone": (r"(?<![0-9A-Za-z])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])", phone),
    "ip": (r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])", address),
}
FINDERS = {k: re.compile(p.replace(r"\3", r"\1").replace(r"\4", r"\2")) for k, (p, _) in KINDS.items()}
#: What every value has: a digit or an @. Lines without one are not searched.
HINT = re.compile(r"[0-9@]")


#: Kinds of no fixed length: of what the pattern takes, pieces that end before a separator are tried too, the longest first.
PIECES = ("iban", "card")
#: Characters from which a piece can reach a place, and more.
REACH = 64


#: What stands before the @ of an address, from its end; and from the @ on.
OWN, DOMAIN = re.compile(r"[A-Za-z0-9._%+-]"), re.compile(r"@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")


def _email(text: str, at: int) -> tuple[int, int] | None:
    """The first address from at on. Grown from its @ both ways: a long run without one is passed over once."""
    while (k := text.find("@", at)) >= 0:
        a = k
        while a > at and OWN.match(text, a - 1):
            a -= 1
        while a < k and not text[a].isalnum():
            a += 1
        if a < k and (m := DOMAIN.match(text, k)):
            return a, m.end()
        at = k + 1
    return None


def _find(kind: str, text: str, at: int) -> tuple[int, int] | None:
    if kind == "email":
        return _email(text, at)
    m = FINDERS[kind].search(text, at)
    return m.span() if m else None


def _pick(kind: str, text: str, at: int, taken: list[tuple[int, int]], f: Feistel, back: bool) -> tuple[int, int, str] | None:
    """The first value of a kind from at on: start, end, replacement. After a failed start the search goes on one character behind it."""
    find, write = FINDERS[kind], KINDS[kind][1]
    while m := _find(kind, text, at):
        a, ends = m[0], [m[1]]
        if kind in PIECES:
            ends += [i for i in range(m[1] - 1, a, -1) if text[i] in " -" and find.fullmatch(text, a, i)]
        for b in ends:
            new = None if _over(taken, a, b) else write(text[a:b], f, back)
            if new is not None:
                return a, b, new
        at = a + 1
    return None


def _settle(kind: str, text: str, at: int, a: int, b: int, new: str, taken: list[tuple[int, int]], f: Feistel, back: bool) -> str:
    """Permutes on until the replacement, among the digits around it, is read as the same stretch: so it can be undone."""
    base = max(0, at - 1, a - REACH)
    before, behind, own = text[base:a], text[b : b + REACH], [(x - base, y - base) for x, y in taken if y > base and x < b + REACH]
    for _ in range(1000):
        got = _pick(kind, before + new + behind, at - base if at > base else 0, own, f, back)
        if got is not None and got[:2] == (a - base, b - base):
            break
        new = KINDS[kind][1](new, f, back) or new
    return new


def pseudonymise(text: str, f: Feistel, back: bool = False) -> tuple[str, Counter]:
    """The text with each value that passes its check replaced, and how many of each kind. back undoes it."""
    counts: Counter = Counter()
    if not HINT.search(text):
        return text, counts
    found: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []
    for kind in KINDS:
        at = 0
        while got := _pick(kind, text, at, taken, f, back):
            a, b, new = got
            found.append((a, b, _settle(kind, text, at, a, b, new, taken, f, back) if kind in PIECES else new))
            counts[kind] += 1
            at = b
        taken = sorted((a, b) for a, b, _ in found)
    out, last = [], 0
    for a, b, new in sorted(found):
        out += [text[last:a], new]
        last = b
    return "".join([*out, text[last:]]), counts


def _over(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether a .. b overlaps one of the stretches taken, which are in order and apart."""
    i = bisect.bisect_left(taken, (b, -1))
    return i > 0 and taken[i - 1][1] > a


def protect(docs: DataFrame, key: bytes, text: str = "text", back: bool = False) -> DataFrame:
    """docs with the values in text replaced, and counts: n_<kind> for each kind, n_pii for all.

    Null text stays null, with counts of 0. Values that fail their check (a card's digit, a date that is none) stay. Equal values
    are replaced alike in all rows, dates in any way of writing. Hexadecimal in capitals, IPv6 addresses and telephone numbers of
    other forms than the North American one are not values here. Texts are searched whole, of any length. No rows: no rows. Other columns stay; one
    named like a count is replaced. With back, and the same key, pseudonyms become the values again.
    """
    names = [f"n_{k}" for k in KINDS]
    kept = docs.drop(*names, "n_pii")
    (probe,) = fresh(kept, "probe_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key)
        for batch in batches:
            texts, counts = [], []
            for t in batch.column(probe).to_pylist():
                new, own = (None, Counter()) if t is None else pseudonymise(t, f, back)
                texts.append(new)
                counts.append(own)
            rest = [c for c in batch.schema.names if c != probe]
            arrays = [pa.array(texts, pa.string()) if c == text else batch.column(c) for c in rest]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array([c[k] for c in counts], pa.int64()) for k in KINDS)], [*rest, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), *(f"{n} bigint" for n in names)])
    out = kept.withColumn(probe, F.col(text)).mapInArrow(run, schema)
    return out.withColumn("n_pii", sum((F.col(n) for n in names[1:]), F.col(names[0])))
