"""Format-preserving pseudonyms for private values, by a keyed Feistel permutation."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import few_rows, passing, texts_of

ROUNDS = 10
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
# Letters that are exchanged for each other; any other character stays.
CLASSES = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"]
HEX = ["0123456789abcdef"]


class Permuter:
    """Keyed permutations of whole numbers below a size. No number stays the same."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _f(self, tweak: str, turn: int, value: int) -> int:
        message = f"{tweak}/{turn}/{value}".encode()
        return int.from_bytes(hashlib.blake2b(message, key=self.key, digest_size=64).digest(), "big")

    def _feistel(self, value: int, a: int, b: int, tweak: str, back: bool) -> int:
        left, right = divmod(value, b)
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if turn % 2:
                right = (right + sign * self._f(tweak, turn, left)) % b
            else:
                left = (left + sign * self._f(tweak, turn, right)) % a
        return left * b + right

    def _walk(self, value: int, size: int, tweak: str, back: bool) -> int:
        """The Feistel network over two halves a * b >= size, repeated until below it."""
        a = math.isqrt(size - 1) + 1
        b = -(-size // a)
        tweak = f"{tweak}/{size}"
        while True:
            value = self._feistel(value, a, b, tweak, back)
            if value < size:
                return value

    def _shift(self, size: int, tweak: str) -> int:
        return 1 + self._f(f"{tweak}/{size}", -1, 0) % (size - 1)

    def forth(self, value: int, size: int, tweak: str) -> int:
        """A keyed shift between a permutation and its inverse: a permutation
        without fixed points. One value alone stays."""
        if size < 2:
            return value
        at = (self._walk(value, size, tweak, False) + self._shift(size, tweak)) % size
        return self._walk(at, size, tweak, True)

    def back(self, value: int, size: int, tweak: str) -> int:
        if size < 2:
            return value
        at = (self._walk(value, size, tweak, False) - self._shift(size, tweak)) % size
        return self._walk(at, size, tweak, True)

    def characters(self, text: str, classes: list[str], kind: str) -> str:
        """Each character exchanged within its class; case stays where it is."""
        place = [next(((c, c.index(x)) for c in classes if x in c), None) for x in text.lower()]
        if len(place) != len(text):
            return text
        size = math.prod(len(p[0]) for p in place if p)
        value = 0
        for p in place:
            if p:
                value = value * len(p[0]) + p[1]
        shape = "".join("-" if p is None else str(classes.index(p[0])) for p in place)
        value = self.forth(value, size, f"{kind}/{shape}")
        out = []
        for p, x in zip(reversed(place), reversed(text)):
            if p is None:
                out.append(x)
                continue
            value, i = divmod(value, len(p[0]))
            out.append(p[0][i].upper() if x.isupper() else p[0][i])
        return "".join(reversed(out))


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced one by one."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def luhn(digits: str) -> int:
    """Check digit that completes ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def card(p: Permuter, text: str) -> str | None:
    digits = _digits(text)
    if luhn(digits[:-1]) != int(digits[-1]) or not digits.strip("0"):
        return None
    n = len(digits) - 1
    body = f"{p.forth(int(digits[:-1]), 10**n, 'card'):0{n}d}"
    return _refill(text, body + str(luhn(body)))


def phone(p: Permuter, text: str) -> str | None:
    """The country code after a + stays."""
    code = re.match(r"\+\d{1,3}(?!\d)", text)
    head = code.group() if code else ""
    body = _digits(text[len(head):])
    if not 6 <= len(body) <= 15 - max(0, len(head) - 1):
        return None
    return head + _refill(text[len(head):], f"{p.forth(int(body), 10**len(body), 'phone'):0{len(body)}d}")


def social(p: Permuter, text: str) -> str | None:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    value, serial = divmod(p.forth(value, 898 * 99 * 9999, "social"), 9999)
    area, group = divmod(value, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _iban_check(country: str, account: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


def iban(p: Permuter, text: str) -> str | None:
    plain = text.replace(" ", "")
    country, check, account = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or _iban_check(country, account) != int(check):
        return None
    account = p.characters(account, CLASSES, f"iban/{country}")
    it = iter(f"{country}{_iban_check(country, account):02d}{account}")
    return "".join(" " if c == " " else next(it) for c in text)


def address(p: Permuter, text: str) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255:
        return None
    value = p.forth(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip")
    return ".".join(map(str, value.to_bytes(4, "big")))


def mail(p: Permuter, text: str) -> str | None:
    """The domain stays."""
    local, _, domain = text.rpartition("@")
    return f"{p.characters(local, CLASSES, 'mail/' + domain.lower())}@{domain}"


def secret(p: Permuter, text: str) -> str | None:
    """Hexadecimal keys; all letters take the case of the key's letters."""
    if text.isdigit() or text.isalpha():
        return None
    out = p.characters(text.lower(), HEX, "key")
    return out.upper() if text != text.lower() else out


def day(p: Permuter, text: str) -> str | None:
    """Calendar dates of 1900 to 2099: y-m-d, d.m.y and d/m/y, or m/d/y if only that is one."""
    sep = "-" if "-" in text else "." if "." in text else "/"
    parts = text.split(sep)
    orders = ["ymd"] if sep == "-" else ["dmy"] if sep == "." else ["dmy", "mdy"]
    for order in orders:
        named = dict(zip(order, parts))
        try:
            found = date(int(named["y"]), int(named["m"]), int(named["d"]))
        except ValueError:
            continue
        if FIRST_DAY <= found <= LAST_DAY:
            new = FIRST_DAY + timedelta(p.forth((found - FIRST_DAY).days, (LAST_DAY - FIRST_DAY).days + 1, "day"))
            bare = any(len(named[c]) == 1 for c in "md")
            fill = {"y": f"{new.year:04d}", "m": str(new.month) if bare else f"{new.month:02d}", "d": str(new.day) if bare else f"{new.day:02d}"}
            return sep.join(fill[c] for c in order)
    return None


# Kinds in the order in which they are tried at a place.
KINDS: list[tuple[str, str, Callable[[Permuter, str], str | None]]] = [
    ("mail", r"(?<![\w.+-])[\w.+-]{1,256}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9])", mail),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", iban),
    ("key", r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])", secret),
    ("ip", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])", address),
    ("day", r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9])", day),
    ("social", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", social),
    ("card", r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])", card),
    ("phone", r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])"
              r"|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}(?![0-9])", phone),
]


class Pseudonymiser:
    def __init__(self, key: bytes):
        self.permuter = Permuter(key)
        self.kinds = [(name, re.compile(pattern), make) for name, pattern, make in KINDS]
        self.digits = re.compile("[0-9]")

    def _values(self, text: str) -> list[tuple[int, int, int, str, str]]:
        """Valid values as (start, rank of the kind, end, kind, pseudonym)."""
        out = []
        for rank, (kind, pattern, make) in enumerate(self.kinds):
            at = 0
            while m := pattern.search(text, at):
                new, end = make(self.permuter, m.group()), m.end()
                # words behind an IBAN look like groups of it
                while new is None and kind == "iban" and (end := text.rfind(" ", m.start(), end)) >= 0:
                    new = make(self.permuter, text[m.start():end])
                if new is not None:
                    out.append((m.start(), rank, end, kind, new))
                # behind a run that isn't valid a value can still begin
                at = end if new is not None else self._behind(text, m.start(), m.end())
        return sorted(out)

    @staticmethod
    def _behind(text: str, start: int, end: int) -> int:
        """The end of the first run of letters and digits from ``start``."""
        at = start + 1
        while at < end and text[at].isalnum():
            at += 1
        return at

    def replace(self, text: str) -> tuple[str, list[tuple[str, int, str]]]:
        """The new text, and (kind, start in it, pseudonym) of each value. Of values
        that overlap the first counts, of those that begin together the first kind."""
        if "@" not in text and not self.digits.search(text):
            return text, []
        out, found, done, size = [], [], 0, 0
        for start, _, end, kind, new in self._values(text):
            if start < done:
                continue
            out += [text[done:start], new]
            size += start - done
            found.append((kind, size, new))
            size += len(new)
            done = end
        out.append(text[done:])
        return "".join(out), found


def pseudonymise(docs: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with their private values replaced: (doc_id, text, found).

    Values are e-mail addresses, IBANs (mod 97), hexadecimal keys of 32 digits or
    more, IPv4 addresses, calendar dates, US social security numbers, card numbers
    (Luhn) and telephone numbers; numbers that aren't valid stay. Each is permuted
    within its format by a Feistel network keyed by ``key`` (:class:`Permuter`):
    the pseudonym is valid again, never the value itself, and the same wherever the
    value occurs, however it is spaced, so equal values stay linked across
    documents. Country codes, mail domains, separators and case stay. ``found``
    has kind, start in the new text (in characters) and pseudonym.

    Works on whole texts, row by row, without a shuffle. Null texts stay null with
    nothing found, empty ones empty; rows are kept one for one, with repeated and
    null ids. Extra columns are ignored. An empty table gives no rows.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = Pseudonymiser(key)
        for batch in passing(batches):
            column = batch.column("text")
            done = [worker.replace(t.decode("utf-8", "replace")) for t in texts_of(column)]
            null = column.is_null().to_pylist()
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"),
                pa.array([None if n else t for (t, _), n in zip(done, null)], pa.string()),
                pa.array([[dict(zip(("kind", "start", "pseudonym"), f)) for f in found] for _, found in done],
                         pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("pseudonym", pa.string())]))),
            ], names=["doc_id", "text", "found"])

    rows = few_rows(docs).select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    value = T.StructType().add("kind", "string").add("start", "integer").add("pseudonym", "string")
    schema = T.StructType([rows.schema["doc_id"]]).add("text", "string").add("found", T.ArrayType(value))
    return rows.mapInArrow(add, schema)
