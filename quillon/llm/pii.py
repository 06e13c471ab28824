"""PII: format-preserving Feistel pseudonyms for validated numbers, addresses and dates."""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import small_batches

ROUNDS = 8

# Kinds in their order and their patterns; the first kind that takes a place keeps it.
KINDS = ("email", "iban", "card", "ssn", "phone", "date", "ip")
# The length of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> re.Pattern:
    """By country its number of signs, grouped by fours or not: what follows an IBAN is never part of it."""
    each = []
    for n, countries in IBAN_LENGTHS.items():
        rest = rf"(?:\x20?[A-Z0-9]{{{n % 4}}})" if n % 4 else ""
        each.append(rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{n // 4 - 1}}}{rest}")
    return re.compile(rf"(?<![A-Za-z0-9])(?:{'|'.join(each)})(?![A-Za-z0-9])")


PATTERNS = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9-])"),
    "iban": _iban_pattern(),
    "card": re.compile(
        r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{5})(?![0-9A-Za-z])"
    ),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "phone": re.compile(
        r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[\x20.-]?)?\([0-9]{2,4}\)[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])"
        r"|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[\x20.-]?[0-9]{2,4}){2,5}(?![0-9])|(?<![0-9A-Za-z.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9.-]*[0-9])"
    ),
    "date": re.compile(r"(?<![0-9/.-])(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4})(?![0-9]|[/.-][0-9])"),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"),
}
#: Kinds that the digits of a telephone number with a country code are not.
NOT_IN_PHONES = ("card", "ssn")
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1), dt.date(2099, 12, 31)
DATE_FORMATS = ("%Y{0}%m{0}%d", "%d{0}%m{0}%Y", "%m{0}%d{0}%Y")
# Country calling codes of one and of two digits; all others have three.
CODES = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)


class Feistel:
    """Keyed permutations of 0 .. n - 1: a balanced Feistel network over the next even number of bits, walked until within range."""

    def __init__(self, key: bytes) -> None:
        self.key = key

    def permute(self, value: int, n: int, tweak: str) -> int:
        return self._walk(value, n, tweak, range(ROUNDS))

    def restore(self, value: int, n: int, tweak: str) -> int:
        return self._walk(value, n, tweak, reversed(range(ROUNDS)))

    def _walk(self, value: int, n: int, tweak: str, rounds) -> int:
        if n < 2:
            return value
        half = ((n - 1).bit_length() + 1) // 2
        order, mask = list(rounds), (1 << half) - 1
        back = order[0] != 0
        while True:
            left, right = value >> half, value & mask
            for i in order:
                if back:
                    left, right = right ^ self._round(left, i, n, tweak, mask), left
                else:
                    left, right = right, left ^ self._round(right, i, n, tweak, mask)
            value = (left << half) | right
            if value < n:
                return value

    def _round(self, part: int, i: int, n: int, tweak: str, mask: int) -> int:
        seen = hashlib.blake2b(f"{tweak}|{n}|{i}|{part}".encode(), key=self.key, digest_size=32).digest()
        return int.from_bytes(seen, "big") & mask


def luhn_sum(digits: str) -> int:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))


def iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _date(text: str) -> tuple[str, dt.date] | None:
    mark = next(c for c in text if not c.isdigit())
    for form in DATE_FORMATS:
        try:
            day = dt.datetime.strptime(text, form.format(mark)).date()
        except ValueError:
            continue
        if FIRST_DAY <= day <= LAST_DAY:
            return form.format(mark), day
    return None


def _country_code(digits: str) -> str:
    return next((digits[:n] for n in (1, 2) if digits[:n] in CODES), digits[:3])


def _form(kind: str, text: str):
    """What a pseudonym has in common with its value beside the kind: the order of a date's parts."""
    found = _date(text) if kind == "date" else None
    return found[0] if found else None


def valid(kind: str, text: str) -> bool:
    """Whether a match is what its form says: check digits, ranges and lengths hold."""
    digits = re.sub("[^0-9]", "", text)
    if kind == "card":
        return luhn_sum(digits) % 10 == 0 and len(set(digits)) > 1
    if kind == "iban":
        plain = text.replace(" ", "")
        return iban_rest(plain) == 1
    if kind == "ssn":
        return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
    if kind == "phone":
        return 7 <= len(digits) <= 15
    if kind == "date":
        return _date(text) is not None
    if kind == "ip":
        return all(int(p) < 256 and (p == "0" or p[0] != "0") for p in text.split("."))
    return True


class Pseudonyms:
    """Replaces a valid value by another of its form; the same value always by the same, different ones by different."""

    def __init__(self, key: bytes, back: bool = False) -> None:
        cipher = Feistel(key)
        self.move = cipher.restore if back else cipher.permute

    def _signs(self, text: str, tweak: str, start: int = 0) -> str:
        """Digits become digits and letters letters of their case, from ``start`` on."""
        bases = []
        for c in text[start:]:
            base = 10 if "0" <= c <= "9" else 26 if c.isascii() and c.isalpha() else 0
            bases.append(base)
        size, number = 1, 0
        for c, base in zip(text[start:], bases, strict=True):
            if base:
                number = number * base + (int(c) if base == 10 else ord(c.lower()) - 97)
                size *= base
        number = self.move(number, size, f"{tweak}:{len(text)}:{''.join('.da'[(b > 0) + (b > 10)] for b in bases)}")
        out = []
        for c, base in zip(reversed(text[start:]), reversed(bases), strict=True):
            if base:
                number, own = divmod(number, base)
                out.append(str(own) if base == 10 else chr(own + (97 if c.islower() else 65)))
            else:
                out.append(c)
        return text[:start] + "".join(reversed(out))

    def of(self, kind: str, text: str) -> str:
        """The pseudonym: the first of the value's successors that reads as a value of the same kind and form.

        Walking on until then keeps the map one to one among such values.  A
        telephone number of other digits is one in any form, so it is not walked on.
        """
        if kind == "phone":
            return self._next(kind, text)
        form, new = _form(kind, text), self._next(kind, text)
        while new != text and not (_form(kind, new) == form and find(new) == [(KINDS.index(kind), 0, len(new))]):
            new = self._next(kind, new)
        return new

    def _next(self, kind: str, text: str) -> str:
        if kind == "card":
            digits = re.sub("[^0-9]", "", text)
            body = self._signs(digits[:-1], kind)
            new = iter(body + str(-luhn_sum(body + "0") % 10))
            return "".join(next(new) if c.isdigit() else c for c in text)
        if kind == "iban":
            plain = text.replace(" ", "")
            body = self._signs(plain[4:], kind + plain[:2])
            new = iter(f"{plain[:2]}{98 - iban_rest(plain[:2] + '00' + body):02d}{body}")
            return "".join(c if c == " " else next(new) for c in text)
        if kind == "ssn":
            area, group, serial = (int(p) for p in text.split("-"))
            number = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
            number, serial = divmod(self.move(number, 898 * 99 * 9999, kind), 9999)
            area, group = divmod(number, 99)
            return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"
        if kind == "date":
            form, day = _date(text)
            n = (LAST_DAY - FIRST_DAY).days + 1
            day = FIRST_DAY + dt.timedelta(days=self.move((day - FIRST_DAY).days, n, kind))
            while form.startswith("%m") and day.day <= 12:  # it would read as day and month
                day = FIRST_DAY + dt.timedelta(days=self.move((day - FIRST_DAY).days, n, kind))
            return day.strftime(form)
        if kind == "ip":
            number = 0
            for part in text.split("."):
                number = number * 256 + int(part)
            number = self.move(number, 2**32, kind)
            return ".".join(str(number >> s & 255) for s in (24, 16, 8, 0))
        if kind == "phone":
            digits = re.sub("[^0-9]", "", text)
            code = _country_code(digits) if text[0] == "+" else ""
            new = iter(code + self._signs(digits[len(code) :], kind))
            return "".join(next(new) if c.isdigit() else c for c in text)
        local, _, domain = text.rpartition("@")
        name, _, top = domain.rpartition(".")
        return f"{self._signs(local, kind)}@{self._signs(name, kind + 'host')}.{top}"


def find(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of each valid value in order; where kinds overlap the first of KINDS stands."""
    taken: list[tuple[int, int, int]] = []
    phones = [m.span() for m in PATTERNS["phone"].finditer(text) if m[0][0] == "+" and valid("phone", m[0])] if "+" in text else []
    phone_ends = [end for _, end in phones]
    for k, kind in enumerate(KINDS):
        if kind == "email" and "@" not in text:
            continue
        starts, ends = [t[1] for t in taken], [t[2] for t in taken]
        fresh = []
        for m in PATTERNS[kind].finditer(text):
            before = bisect_left(starts, m.end())
            if phones and kind in NOT_IN_PHONES and (at := bisect_right(phone_ends, m.start())) < len(phones) and phones[at][0] < m.end():
                continue
            if valid(kind, m[0]) and (before == 0 or ends[before - 1] <= m.start()):
                fresh.append((k, m.start(), m.end()))
        if fresh:
            taken = sorted(taken + fresh, key=lambda s: s[1])
    return taken


def pseudonymize(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with every private value of ``text`` replaced, and ``private_spans`` (kind, start, end in the given text) and ``n_private``.

    Values: e-mail addresses, IBANs (check digits), card numbers (Luhn), social
    security numbers, telephone numbers, calendar dates and IPv4 addresses.
    Each is permuted by a Feistel network keyed with ``key`` within the values
    of its form: check digits stay right, dates stay dates, a value has one
    pseudonym in all documents, and the key's owner can go back.  A telephone
    number's country code stays, and its other digits have one pseudonym however
    they are grouped; digits of a number with a country code are of no other kind.  The
    same line written with and without its country code has two pseudonyms, and
    national numbers that begin with 0 or lack separators are not found.  An
    IBAN's country gives its length; countries without IBANs have none.  Dates move as days, so one day's forms agree, but for
    month-first dates that would read day first: these move on until they do not.
    Numbers that fail validation are left alone.

    A null text stays null with no spans.  Texts without such values are
    unchanged.  Rows repeated whole are treated alike; other columns pass
    through, but for incoming ones of the two names, which are replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("private_spans", "n_private")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    fields = [f"{c} {f.dataType.simpleString()}" for c, f in zip(names, docs.schema, strict=True)]
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches):
        pseudonyms = Pseudonyms(key)
        for batch in batches:
            texts, spans = [], []
            for text in batch.column(at).to_pylist():
                found = find(text) if text else []
                spans.append([{"kind": KINDS[k], "start": s, "end": e} for k, s, e in found])
                if found:
                    bits, last = [], 0
                    for k, s, e in found:
                        bits += [text[last:s], pseudonyms.of(KINDS[k], text[s:e])]
                        last = e
                    text = "".join(bits) + text[last:]
                texts.append(text)
            columns = [pa.array(texts, batch.column(i).type) if i == at else batch.column(i) for i in range(len(names))]
            counts = pa.array([len(s) for s in spans], pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, pa.list_(span)), counts], names=[*names, "private_spans", "n_private"])

    schema = ", ".join([*fields, "private_spans array<struct<kind:string,start:int,end:int>>", "n_private long"])
    out = docs.toDF(*names).mapInArrow(run, schema)
    return out.select(*[F.col(i).alias(c) for i, c in zip(names, docs.columns, strict=True)], "private_spans", "n_private")
