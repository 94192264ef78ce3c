"""Format-preserving pseudonyms for personal numbers, dates and addresses in texts.

What a pattern finds and a rule validates (check digits, number ranges, the calendar) is mapped by
a keyed Feistel network to another valid value of the same form: equal values get equal
pseudonyms in all documents, different values different ones, and the key holder can invert it.
Separators, letter case and everything outside the values stay as they are.

A Feistel network permutes the numbers below some size; where a permuted value is not valid it is
permuted again until it is (cycle walking), which keeps the map one-to-one on the valid values.

Values that run together are told apart by their own form: an account number ends at its country's
length, a card where its usual groups end; then other ends at group borders are tried, and the search
goes on at the next digits.  So equal values get equal pseudonyms whatever stands beside them.  Only
where digits beside a value by chance make one with it too, reading the new text may part them
otherwise; the spans tell which were replaced.

The key is a secret of the caller; the query takes it from the setting `KEY_CONF`, or a fixed one
made for tests.  Defined cases: null texts stay null, texts without values stay as they are.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cdcgold.llm.arrow import add_columns

KEY_CONF = "spark.cdcgold.pseudonyms.key"
TEST_KEY = "key of the tests"
ROUNDS = 10


class Feistel:
    """A keyed permutation of the numbers below `size`, another one for every domain name."""

    def __init__(self, key: bytes, domain: str, size: int) -> None:
        self.size = size
        self.right = max(2, 1 << ((size - 1).bit_length() + 1) // 2)
        self.left = -(-size // self.right)
        self.seed = hashlib.blake2b(f"{domain}/{size}".encode(), key=key[:64], digest_size=32).digest()

    def _round(self, i: int, value: int) -> int:
        data = value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big")
        return int.from_bytes(hashlib.blake2b(data, key=self.seed, salt=bytes([i]), digest_size=16).digest(), "big")

    def _once(self, x: int, back: bool) -> int:
        a, b = divmod(x, self.right)
        order = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
        for i in order:
            sign = -1 if back else 1
            if i % 2:
                b = (b + sign * self._round(i, a)) % self.right
            else:
                a = (a + sign * self._round(i, b)) % self.left
        return a * self.right + b

    def permute(self, x: int, valid: Callable[[int], bool] | None = None, back: bool = False) -> int:
        """x must be valid itself, so the walk ends at a valid number."""
        while True:
            x = self._once(x, back)
            if x < self.size and (valid is None or valid(x)):
                return x


def luhn(digits: str) -> int:
    """The check digit that follows these digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 if i % 2 else 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def _refill(form: str, digits: str) -> str:
    """The digits in the places of the digits of `form`."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in form)


_FIRST, _LAST = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
_DIGITS = re.compile(r"[0-9]")
_KINDS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "date": r"(?<![\d./-])(?:\d{4}-\d\d-\d\d|\d\d(?P<sep>[./])\d\d(?P=sep)\d{4})(?![./-]?\d)",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\w)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+1[ .-]?)?(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .-])[2-9]\d\d[ .-]\d{4}(?!\w|-\d)"
    r"|(?<![\w+])\+1[2-9]\d\d[2-9]\d{6}(?!\w)"
    r"|(?<![\w+])\+[2-9]\d{0,2}(?:[ ./-]?\(\d{1,5}\))?(?:[ ./-]?\d){5,13}(?!\w|-\d)",
    "card": r"(?<![\w.])\d(?:[ -]?\d){12}",
}
KINDS = tuple(_KINDS)
_KIND = {k: re.compile(v, re.ASCII) for k, v in _KINDS.items()}
_PATTERNS = re.compile("|".join(f"(?P<{k}>{v})" for k, v in _KINDS.items()), re.ASCII)
_NO_MAIL = re.compile("|".join(f"(?P<{k}>{v})" for k, v in _KINDS.items() if k != "email"), re.ASCII)
#: A run of what the first part of an address may hold, and whether it is one, by what stands behind it.
_RUN = re.compile(r"[A-Za-z0-9._%+-]*(?P<host>@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})?", re.ASCII)
#: Calling codes of two digits; 1 and 7 have one, all others three.
_CALLING = frozenset(
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86"
    " 90 91 92 93 94 95 98".split()
)
#: Length of an account number by country.
_IBAN = {
    k: int(n)
    for n, ks in (
        x.split(":")
        for x in (
            "15:NO 16:BE 18:DK,FI,FO,FK,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,CR,HR,LI,LV"
            " 22:BG,BH,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG"
            " 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV"
            " 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
        ).split()
    )
    for k in ks.split(",")
}
_GROUP = re.compile(r"[0-9]{1,19}(?![0-9])")
#: Groups of digits in which cards are written, besides all digits in one.
_LAYOUTS = frozenset({(4, 4, 4, 4), (4, 6, 5), (4, 6, 4)})
#: Digit groups up to a place.
_LEAD = re.compile(r"(?<![\w.-])(?:[0-9]{1,19}[ -])+\Z", re.ASCII)
_CARD_STOP = re.compile(r"\w|\.\d", re.ASCII)


def _is_card(value: str) -> bool:
    digits = "".join(_DIGITS.findall(value))
    return luhn(digits[:-1]) == int(digits[-1]) and len(set(digits)) > 1


def _card_ends(text: str, start: int) -> list[tuple[int, int]]:
    """(rank, end) of the runs of whole digit groups with 13 to 19 digits, as cards are written first.

    Rank 0 is a usual layout with a usual first digit, 1 a usual layout, 2 any other.
    """
    out, groups, marks, at = [], [], set(), start
    while (m := _GROUP.match(text, at)) is not None:
        at = m.end()
        groups.append(at - m.start())
        n = sum(groups)
        if n > 19:
            break
        if n >= 13 and not _CARD_STOP.match(text, at):
            usual = len(groups) == 1 or (tuple(groups) in _LAYOUTS and len(marks) == 1)
            rank = int(text[start] not in "3456") if usual else 2
            out.append((rank, at, min(groups[:-1], default=n) >= 3))
        if text[at : at + 1] not in (" ", "-"):
            break
        marks.add(text[at])
        at += 1
    # numbers in a row are no card wherever they happen to pass the check: small groups count only as a whole
    whole = max((x[1] for x in out), default=0) if not (start > 1 and text[start - 1] in " -" and text[start - 2] in "0123456789") else 0
    return sorted(((r, e) for r, e, large in out if large or e == whole), key=lambda x: (x[0], -x[1]))


def _cards(text: str, start: int) -> Iterator[int]:
    """Where a card that begins at `start` may end; not over the beginning of a better one."""
    if text[start - 1 : start] == "-" and not _LEAD.search(text[max(0, start - 64) : start]):
        return
    for rank, end in _card_ends(text, start):
        if not _is_card(text[start:end]):
            continue
        later = [i for i in range(start + 1, end) if text[i - 1] in " -"] if rank else []
        if not any(r < rank and _is_card(text[i:e]) for i in later for r, e in _card_ends(text, i)):
            yield end


def _ibans(text: str, start: int, stop: int) -> Iterator[int]:
    """Ends of an account number at borders of its groups, that of its country's length first."""
    ends = [stop, *(i for i in range(stop - 1, start, -1) if text[i] == " ")]
    size = {e: e - start - text.count(" ", start, e) for e in ends}
    own = _IBAN.get(text[start : start + 2])
    yield from sorted((e for e in ends if 15 <= size[e] <= 34), key=lambda e: (size[e] != own, -e))


class Pseudonyms:
    def __init__(self, key: str) -> None:
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()
        self._made: dict[tuple[str, int], Feistel] = {}

    def _permute(self, domain: str, size: int, x: int, valid: Callable[[int], bool] | None, back: bool) -> int:
        made = self._made.setdefault((domain, size), None) or Feistel(self.key, domain, size)
        self._made[domain, size] = made
        return made.permute(x, valid, back)

    def _card(self, value: str, back: bool) -> str | None:
        digits = "".join(_DIGITS.findall(value))
        if not _is_card(value):
            return None
        body, n = digits[1:-1], len(digits) - 2
        # the first digit tells the kind of card; a number of one repeated digit is not valid
        made = digits[0]

        def valid(x: int) -> bool:
            whole = made + str(x).zfill(n)
            return len(set(whole + str(luhn(whole)))) > 1

        new = made + str(self._permute(f"card {made}", 10**n, int(body), valid, back)).zfill(n)
        return _refill(value, new + str(luhn(new)))

    def _phone(self, value: str, back: bool) -> str | None:
        digits = "".join(_DIGITS.findall(value))
        if value[0] == "+" and digits[0] != "1":
            return self._phone_abroad(value, digits, back)
        own = digits[-10:]
        new = self._permute("phone", 10**10, int(own), lambda x: x >= 2 * 10**9 and x // 10**6 % 10 >= 2, back)
        return _refill(value, digits[:-10] + str(new).zfill(10))

    def _phone_abroad(self, value: str, digits: str, back: bool) -> str | None:
        """The calling code stays, and a zero at the front of the rest, in brackets or not."""
        if not 8 <= len(digits) <= 15 + ("(0)" in value):
            return None
        k = 1 if digits[0] == "7" else 2 if digits[:2] in _CALLING else 3
        k += digits[k] == "0"
        own, low = digits[k:], 10 ** (len(digits) - k - 1)
        zero = own[0] == "0"
        new = self._permute(f"phone {digits[:k]}", low * 10, int(own), lambda x: (x < low) == zero, back)
        return _refill(value, digits[:k] + str(new).zfill(len(own)))

    def _ssn(self, value: str, back: bool) -> str | None:
        def valid(x: int) -> bool:
            area, group, serial = x // 10**6, x // 10**4 % 100, x % 10**4
            return 0 < area < 900 and area != 666 and group > 0 and serial > 0

        own = int(value.replace("-", ""))
        return _refill(value, str(self._permute("ssn", 10**9, own, valid, back)).zfill(9)) if valid(own) else None

    def _ip(self, value: str, back: bool) -> str | None:
        parts = value.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None

        def valid(x: int) -> bool:
            a = x >> 24
            return 0 < a < 224 and a not in (10, 127) and x >> 16 not in (0xC0A8, 0xA9FE) and x >> 20 != 0xAC1

        own = int.from_bytes(bytes(map(int, parts)), "big")
        if not valid(own):
            return None  # no address of one person
        return ".".join(map(str, self._permute("ip", 1 << 32, own, valid, back).to_bytes(4, "big")))

    def _date(self, value: str, back: bool) -> str | None:
        iso, sep = value[4] == "-", value[2]
        parts = (value[:4], value[5:7], value[8:]) if iso else (value[6:], value[3:5], value[:2])
        year, month, day = map(int, parts)
        # a slash date that is none with its day first has its month first
        turned = sep == "/" and not iso and month > 12
        if turned:
            month, day = day, month
        try:
            own = dt.date(year, month, day).toordinal()
        except ValueError:
            return None
        if not _FIRST <= own <= _LAST:
            return None
        # it stays such a date, so that none other has its pseudonym
        valid = (lambda x: dt.date.fromordinal(_FIRST + x).day > 12) if turned else None
        new = dt.date.fromordinal(_FIRST + self._permute("date", _LAST - _FIRST + 1, own - _FIRST, valid, back))
        return new.isoformat() if iso else new.strftime("%m/%d/%Y" if turned else f"%d{sep}%m{sep}%Y")

    def _iban(self, value: str, back: bool) -> str | None:
        own = value.replace(" ", "")
        if not 15 <= len(own) <= 34 or self._mod97(own) != 1:
            return None
        digits = "".join(_DIGITS.findall(own[4:]))
        if not digits:
            return None
        form = _DIGITS.sub("0", own[:2] + own[4:])
        new = str(self._permute(f"iban {form}", 10 ** len(digits), int(digits), None, back)).zfill(len(digits))
        body = _refill(own[4:], new)
        check = f"{98 - self._mod97(own[:2] + '00' + body):02d}"
        whole = iter(own[:2] + check + body)
        return "".join(c if c == " " else next(whole) for c in value)

    @staticmethod
    def _mod97(iban: str) -> int:
        return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97

    def _email(self, value: str, back: bool) -> str:
        name, _, host = value.partition("@")
        sizes = [10 if c.isdigit() else 26 if c.isalpha() else 1 for c in name]
        base = ["0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in name]
        x, whole = 0, 1
        for c, zero, size in zip(name, base, sizes, strict=True):
            x, whole = x * size + ord(c) - ord(zero), whole * size
        x = self._permute(f"email {''.join(base)}", whole, x, None, back)
        out = []
        for zero, size in zip(reversed(base), reversed(sizes), strict=True):
            x, digit = divmod(x, size)
            out.append(chr(ord(zero) + digit))
        return "".join(reversed(out)) + "@" + host

    def _value(self, kind: str, text: str, start: int, stop: int, back: bool) -> tuple[int, str] | None:
        """End and pseudonym of the value that begins here, null if no end makes it a valid one."""
        ends = _cards(text, start) if kind == "card" else _ibans(text, start, stop) if kind == "iban" else [stop]
        for end in ends:
            new = getattr(self, f"_{kind}")(text[start:end], back)
            if new is not None:
                return end, new
        return None

    def _at(self, text: str, start: int, back: bool, mail: bool) -> tuple[str, int, str] | None:
        """Kind, end and pseudonym of the value that begins here; where a kind fails, the next ones are tried."""
        m = (_PATTERNS if mail else _NO_MAIL).match(text, start)
        if not m:
            return None
        found = m.groupdict()
        first = next(i for i, k in enumerate(KINDS) if found.get(k))
        for kind in KINDS[first:]:
            m = _KIND[kind].match(text, start)
            if m and (made := self._value(kind, text, start, m.end(), back)):
                return kind, *made
        return None

    def _found(self, text: str, back: bool) -> Iterator[tuple[str, int, int, str]]:
        """Values in order; the pattern is tried only near digits and addresses.

        A value begins at the digit, plus, bracket or letter run before the mark found.  Where it is not
        valid, the search goes on behind its first mark, so a value inside or behind it is found.
        """
        at, end, mail = 0, 0, False  # a run that is no address is read once, not from each of its characters
        while (mark := _NEXT.search(text, at)) is not None:
            begin = mark.start()
            while begin > at and (
                text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "._%+-")
            ):
                begin -= 1
            at = mark.end()
            for start in range(begin, at):
                if start >= end:
                    run = _RUN.match(text, start)
                    mail = run["host"] is not None
                    end = max(start + 1, run.start("host") if mail else run.end())
                if made := self._at(text, start, back, mail):
                    kind, at, new = made
                    yield kind, start, at, new
                    break

    def apply(self, text: str | None, back: bool = False) -> tuple[str | None, list[dict]]:
        """The text with pseudonyms, and the replaced spans of the old text."""
        if not text or not (("@" in text) or _DIGITS.search(text)):
            return text, []
        out, found, at = [], [], 0
        for kind, start, stop, new in self._found(text, back):
            found.append({"kind": kind, "start": start, "stop": stop})
            out += [text[at:start], new]
            at = stop
        return "".join([*out, text[at:]]), found


#: Parts of a text without digits and @ are passed over in one step.
_NEXT = re.compile(r"[0-9@+(]")


def pseudonymise(docs: DataFrame, key: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, the text with pseudonyms, how many values were replaced, and the spans by kind."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        made = Pseudonyms(key)
        out, spans = zip(*[made.apply(x.as_py()) for x in batch.column("_text")], strict=True)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        return {
            "text": pa.array(out, pa.string()),
            "n_replaced": pa.array(map(len, spans), pa.int64()),
            "spans": pa.array(spans, kind),
        }

    schema = "text string, n_replaced long, spans array<struct<kind:string,start:long,stop:long>>"
    return add_columns(rows, run, schema, "_text", ["doc_id"])
