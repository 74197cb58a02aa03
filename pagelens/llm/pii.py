"""Format-preserving pseudonyms for personal data.

What is found and validated is replaced by another value of the same format, by a keyed permutation of the format's values: a
Feistel network over the values' numbers, walked until it lands inside the format. Equal values get equal pseudonyms in every
document, different values different ones, and with the key `reveal` turns them back exactly. No value is its own pseudonym.

Kinds: `card` (13 to 19 digits with an issuer's prefix and a valid check digit; the pseudonym's is valid too), `phone` (8 to 15
digits, with separators or a leading +; digits are permuted by their number and put back into the layout, so that one number in
several layouts stays one; ten bare digits are no phone), `ip` (octets up to 255), `date` (days that exist, in the layout they had; a
pseudonym stays within the years 1-1899, 1900-2099 or 2100-9999, and day and month keep their number of digits, so that a day in
several layouts stays one and comes back exactly), `ssn`, `iban` (valid check digits before and after), `email` (letters and digits of
the name), `secret` (32 or more hex digits after a word such as token or key).

There is no built-in key: callers give one, and the query and the pipeline take `spark.pagelens.pii.key` from the session or, where it
is unset, a random key of that run, whose pseudonyms nobody can turn back and which link within the run alone.

Defined cases: a null or empty text stays as it is with no finds; digits that fail validation stay, where a run of their groups
is no card either; texts of any length are worked on whole; repeated rows are judged one by one and alike; an empty table gives no
rows; other columns are left alone, and where one has the name of a count the counts' names get another underscore in front.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import secrets
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import chunked, column, mapped

KINDS = ("card", "phone", "ip", "date", "ssn", "iban", "email", "secret")
ROUNDS = 8

_LIKELY = re.compile(r"[0-9][0-9.\-/ ()]{4}|[0-9a-fA-F]{20}|@")
_FIND = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9]))"
    r"|(?P<secret>(?i:(?:token|secret|key|password|passwd|pwd)[\"']?\s*[=:]\s*[\"']?)(?P<hex>[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z]))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9]))"
    r"|(?P<iso>(?<![\w.-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![\w-]))"
    r"|(?P<dmy>(?<![\w./-])[0-9]{1,2}(?P<sep>[./])[0-9]{1,2}(?P=sep)[0-9]{4}(?!\w|[./][0-9]))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w]|[.-][0-9]))"
    r"|(?P<phone>(?<![\w.+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?!\w|[.-][0-9])|(?<![\w+])\+[0-9]{8,15}(?!\w))"
)
_CARD = re.compile(r"4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|6(?:011|5)|3(?:0[0-5]|[68])|35")
#: First years of the spans that dates stay within.
SPANS = (1, 1900, 2100, 10000)


def luhn(digits: str) -> int:
    """The check sum of digits; 0 where it is valid."""
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10


class Permutation:
    """A keyed permutation of 0 .. n-1 for any n, without fixed points where n > 1."""

    def __init__(self, key: bytes, label: str, n: int):
        self.n, self.half = n, max(1, ((n - 1).bit_length() + 1) // 2)
        self.key = hashlib.blake2b(f"{label}/{n}".encode(), key=key[:64], digest_size=32).digest()

    def _f(self, i: int, x: int) -> int:
        out, size = b"", (self.half + 7) // 8
        block = x.to_bytes(size, "big")
        for j in range((size + 31) // 32):
            out += hashlib.blake2b(bytes((i, j)) + block, key=self.key, digest_size=32).digest()
        return int.from_bytes(out[:size], "big") & ((1 << self.half) - 1)

    def _walk(self, x: int, back: bool) -> int:
        mask = (1 << self.half) - 1
        while True:
            a, b = x >> self.half, x & mask
            if back:
                for i in reversed(range(ROUNDS)):
                    a, b = b ^ self._f(i, a), a
            else:
                for i in range(ROUNDS):
                    a, b = b, a ^ self._f(i, b)
            x = a << self.half | b
            if x < self.n:
                return x

    def __call__(self, x: int, step: int = 1) -> int:
        return self._walk((self._walk(x, False) + step) % self.n, True)


def _spread(value: str, classes: Callable[[str], str]) -> tuple[int, int]:
    n, x = 1, 0
    for ch in value:
        if alphabet := classes(ch):
            x, n = x * len(alphabet) + alphabet.index(ch), n * len(alphabet)
    return x, n


def _fill(value: str, x: int, classes: Callable[[str], str]) -> str:
    out = []
    for ch in reversed(value):
        if alphabet := classes(ch):
            x, r = divmod(x, len(alphabet))
            ch = alphabet[r]
        out.append(ch)
    return "".join(reversed(out))


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HEX = {**dict.fromkeys("abcdef" + DIGITS, DIGITS + "abcdef"), **dict.fromkeys("ABCDEF", DIGITS + "ABCDEF")}
_digit = lambda ch: DIGITS if ch in DIGITS else ""
_any = lambda ch: next((a for a in (DIGITS, LOWER, UPPER) if ch in a), "")


def _exists(y: int, m: int, d: int) -> bool:
    try:
        datetime.date(y, m, d)
    except ValueError:
        return False
    return True


class Pseudonyms:
    """Replaces what it finds; keeps the pseudonyms of the last values, up to `limit` of them."""

    def __init__(self, key: bytes, step: int = 1, limit: int = 100_000):
        self.key, self.step, self.limit = key, step, limit
        self.known: dict[tuple[str, str], str | None] = {}

    def permuted(self, label: str, x: int, n: int) -> int:
        return Permutation(self.key, label, n)(x, self.step)

    def _format(self, label: str, value: str, classes: Callable[[str], str]) -> str:
        x, n = _spread(value, classes)
        return _fill(value, self.permuted(f"{label}/{len(value)}", x, n), classes)

    @staticmethod
    def _is_card(value: str) -> bool:
        digits = re.sub("[ -]", "", value)
        return not (len(set(re.findall("[ -]", value))) > 1 or not _CARD.match(digits) or luhn(digits) or len(set(digits)) == 1)

    def _part(self, value: str) -> tuple[int, int] | None:
        """The longest, then the first run of whole groups of 13 to 19 digits that is a card, where all of value is none."""
        if self._is_card(value):
            return None
        at = [m.span() for m in re.finditer("[0-9]+", value)]
        runs = [(a, b) for i, (a, _) in enumerate(at) for _, b in at[i:] if 13 <= sum(ch in DIGITS for ch in value[a:b]) <= 19 and self._is_card(value[a:b])]
        return max(runs, key=lambda r: (sum(ch in DIGITS for ch in value[slice(*r)]), -r[0]), default=None)

    def part(self, value: str) -> str | None:
        """value with the card in it replaced; walked until the new card is what would be found, so that it can be turned back."""
        if not (found := self._part(value)):
            return None
        a, b = found
        while True:
            value = value[:a] + self.card(value[a:b]) + value[b:]
            if self._part(value) == found:
                return value

    def card(self, value: str) -> str | None:
        digits = re.sub("[ -]", "", value)
        if not self._is_card(value):
            return None
        head = _CARD.match(digits)[0]  # the issuer's prefix stays, so that a pseudonym is valid
        body = digits[len(head) : -1]
        new = head + str(self.permuted(f"card/{head}", int(body), 10 ** len(body))).zfill(len(body))
        new += str(-luhn(new + "0") % 10)
        it = iter(new)
        return "".join(next(it) if ch in DIGITS else ch for ch in value)

    def phone(self, value: str) -> str | None:
        n = sum(ch in DIGITS for ch in value)
        if not 8 <= n <= 15:
            return None
        code = re.match(r"\+[0-9]{1,3}(?=[ .(-])[ .-]?|\+1(?=[0-9]{10}$)|", value)[0]
        rest = value[len(code) :]
        x, n = _spread(rest, _digit)
        while True:  # a layout that cards have too: walked until it is none
            x = self.permuted(f"phone/{n}", x, n)
            new = code + _fill(rest, x, _digit)
            if not re.fullmatch("[0-9](?:[ -]?[0-9]){12,}", new) or not self._is_card(new) and not self._part(new):
                return new

    def ip(self, value: str) -> str | None:
        parts = value.split(".")
        if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
            return None
        x = self.permuted("ip", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _day(self, y: str, m: str, d: str) -> tuple[int, int, int] | None:
        y, m, d = int(y), int(m), int(d)
        if not _exists(y, m, d):
            return None
        first, end = next((a, b) for a, b in zip(SPANS, SPANS[1:]) if y < b)
        months, days = ((1, 9), (10, 3))[m > 9], ((1, 9), (10, 22))[d > 9]
        n = (end - first) * months[1] * days[1]
        x = ((y - first) * months[1] + m - months[0]) * days[1] + d - days[0]
        while True:  # one cycle holds all of the grid, so that this permutes the days that exist
            x = self.permuted(f"date/{first}/{months[1]}/{days[1]}", x, n)
            rest, d = divmod(x, days[1])
            y, m = divmod(rest, months[1])
            y, m, d = y + first, m + months[0], d + days[0]
            if _exists(y, m, d):
                return y, m, d

    def iso(self, value: str) -> str | None:
        day = self._day(*value.split("-"))
        return day and "{:04}-{:02}-{:02}".format(*day)

    def dmy(self, value: str) -> str | None:
        """Day first with dots, month first with slashes; each part keeps its width."""
        sep = "." if "." in value else "/"
        a, b, y = value.split(sep)
        day = self._day(y, b, a) if sep == "." else self._day(y, a, b)
        if not day:
            return None
        y, m, d = day
        one, two = (d, m) if sep == "." else (m, d)
        return f"{one:0{len(a)}}{sep}{two:0{len(b)}}{sep}{y:04}"

    def ssn(self, value: str) -> str | None:
        a, b, c = map(int, value.split("-"))
        if a in (0, 666) or a >= 900 or not b or not c:
            return None
        area = a - 1 - (a > 666)
        x = self.permuted("ssn", (area * 99 + b - 1) * 9999 + c - 1, 898 * 99 * 9999)
        x, c = divmod(x, 9999)
        area, b = divmod(x, 99)
        return f"{area + 1 + (area + 1 >= 666):03}-{b + 1:02}-{c + 1:04}"

    def iban(self, value: str) -> str | None:
        flat = value.replace(" ", "")
        check = lambda s: int("".join(str(int(ch, 36)) for ch in s)) % 97
        if not 15 <= len(flat) <= 34 or check(flat[4:] + flat[:4]) != 1:
            return None
        body = self._format(f"iban/{flat[:2]}", flat[4:], _any)
        new = flat[:2] + f"{98 - check(body + flat[:2] + '00'):02}" + body
        it = iter(new)
        return "".join(ch if ch == " " else next(it) for ch in value)

    def email(self, value: str) -> str:
        name, _, host = value.rpartition("@")
        return self._format(f"email/{host.lower()}", name, _any) + "@" + host

    def secret(self, value: str) -> str:
        start = re.search(r"[=:]\s*[\"']?", value).end()
        head, hexes = value[:start], value[start:]
        upper = any(ch in UPPER for ch in hexes)
        return head + self._format("secret", hexes, lambda ch: DIGITS + ("ABCDEF" if upper else "abcdef"))

    def __call__(self, text: str, counts: dict[str, int] | None = None) -> str:
        if not text or not _LIKELY.search(text):
            return text

        def new(m: re.Match) -> str:
            kind, value = m.lastgroup, m[0]
            kind = "secret" if kind == "hex" or m["secret"] else "dmy" if kind == "sep" else kind
            if (kind, value) not in self.known:
                if len(self.known) >= self.limit:
                    self.known.clear()
                self.known[kind, value] = getattr(self, kind)(value)
            got = self.known[kind, value]
            if got is None and kind == "card":
                got = self.part(value)
            if got is None and kind == "card" and not value.isdigit():
                kind, got = "phone", self.phone(value)
            if got is None:
                return value
            if counts is not None:
                kind = "date" if kind in ("iso", "dmy") else kind
                counts[kind] = counts.get(kind, 0) + 1
            return got

        return _FIND.sub(new, text)


def count_names(columns: list[str]) -> list[str]:
    """Names of the counts of KINDS that no column has."""
    prefix = "n_"
    while {prefix + k for k in KINDS} & set(columns):
        prefix = "_" + prefix
    return [prefix + k for k in KINDS]


def pseudonymize(docs: DataFrame, text: str = "text", *, key: bytes, counts: bool = False) -> DataFrame:
    """docs with personal data in the text replaced. All columns stay; with counts, a column n_<kind> for each kind follows."""
    if not key:
        raise ValueError("a key is needed")
    names = count_names(docs.columns) if counts else []
    src = docs.select("*", *[F.lit(0).cast("long").alias(k) for k in names])

    def run(batches):
        pen = Pseudonyms(key)
        for batch in chunked(batches, text):
            i = batch.schema.get_field_index(text)
            new, seen = [], []
            for t in batch.column(i).to_pylist():
                c: dict[str, int] = {}
                new.append(pen(t, c))
                seen.append(c)
            out = batch.set_column(i, batch.schema.field(i), pa.array(new, batch.schema.field(i).type))
            for name, k in zip(names, KINDS):
                j = out.schema.get_field_index(name)
                out = out.set_column(j, out.schema.field(j), pa.array([c.get(k, 0) for c in seen], pa.int64()))
            yield out

    return src.mapInArrow(run, src.schema)


def reveal(text: str, key: bytes) -> str:
    """The text before pseudonymize; pseudonyms are of the same formats, so they are found again."""
    return Pseudonyms(key, step=-1)(text)


def session_key(spark: SparkSession) -> bytes:
    """spark.pagelens.pii.key, or a random key of this call."""
    given = spark.conf.get("spark.pagelens.pii.key", None)
    return given.encode() if given else secrets.token_bytes(32)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymize(docs, key=session_key(spark), counts=True)
