"""Format-preserving pseudonyms for personal numbers, dates and addresses (operator 2).

Candidates are found by pattern and validated: card numbers by their check
digit, account numbers by theirs, dates by the calendar, social security
numbers and network addresses by their ranges. The digits (or letters) that may
vary are read as one number of a mixed radix and permuted by a keyed Feistel
network, walking on until the result is valid in the same format. So a
pseudonym looks like its original, has its length, passes the same check, and
equal values get equal pseudonyms in every document. The permutation has an
inverse under the same key (``restore``).

Kept as they are: a card's first digit, a phone number's punctuation and
country code, an address's last label, the words in front of a secret.

A candidate that fails its check is tried at its shorter forms (account numbers
first at the length of their country), and the search goes on behind its first
character, so values inside or behind it are found too. Where a value inside a
failed account number changes, that number's check may pass by chance, one time
in 97, and ``restore`` then does not give that passage back.

One pass without a shuffle. Defined results: a null text stays null and holds
nothing; a candidate that fails its check at every form stays; equal values are linked
whatever row they stand in; very long texts are read whole; other columns pass
through, an input column ``n_pii`` is replaced.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re
import string
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from churnscope.llm.bpe import slices
from churnscope.llm.common import drop_clashing, read, released

ROUNDS = 10
#: Characters permuted as one number; longer strings are cut.
BLOCK = 48
#: The registered query's key; production runs pass their own.
DEMO_KEY = b"churnscope demonstration key"

#: Cheap test that a text may hold a candidate.
MAYBE = re.compile(r"[0-9@=:]|AKIA")
CANDIDATE = re.compile(
    r"""
    (?P<secret>\b(?i:password|passwd|pwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}["']?(?P<value>[A-Za-z0-9+/_-]{6,}))
    |(?P<email>(?<![\w.+%-])[A-Za-z0-9_][\w.+%-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})
    |(?P<access>\bAKIA[0-9A-Z]{16}\b)
    |(?P<iban>\b[A-Z]{2}[0-9]{2}(?:\ ?[A-Z0-9]{4}){2,7}(?:\ ?[A-Z0-9]{1,3})?\b)
    |(?P<iso>(?<![\w./-])(?:19|20)[0-9]{2}(?P<s1>[-/.])[0-9]{1,2}(?P=s1)[0-9]{1,2}(?:(?=[Tt][0-9]{2})|(?![\w/-]|\.[0-9])))
    |(?P<day>(?<![\w./-])[0-9]{1,2}(?P<s2>[-/.])[0-9]{1,2}(?P=s2)(?:19|20)[0-9]{2}(?:(?=[Tt][0-9]{2})|(?![\w/-]|\.[0-9])))
    |(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
    |(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9]))
    |(?P<phone>(?<![\w+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-]|\.[0-9])
        |(?<![\w+])\+[1-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,5}\)?){2,5}(?![\w-]|\.[0-9]))
    |(?P<card>(?<![\w.-])(?:[0-9]{13,19}|[0-9]{4}(?P<s3>[\ -])[0-9]{4}(?P=s3)[0-9]{4}(?P=s3)[0-9]{1,7}|[0-9]{4}(?P<s4>[\ -])[0-9]{6}(?P=s4)[0-9]{4,5})(?![\w-]|\.[0-9]))
    """,
    re.X | re.A,
)
#: Characters of an account number by country.
IBAN_LENGTH = {
    country: size
    for size, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
        22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
        27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
KINDS = ("secret", "email", "access", "iban", "iso", "day", "ssn", "ip", "phone", "card")
DAY_ONE, DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


class Feistel:
    """Keyed permutations of 0..size-1, one for each tweak."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key).digest()

    def _round(self, tweak: bytes, r: int, half: int, n_bytes: int, mask: int) -> int:
        h = hashlib.blake2b(half.to_bytes(n_bytes, "big") + bytes([r]) + tweak, key=self.key, digest_size=n_bytes)
        return int.from_bytes(h.digest(), "big") & mask

    def permute(self, value: int, size: int, tweak: bytes, back: bool = False, valid: Callable[[int], bool] = lambda v: True) -> int:
        """The image of ``value`` among those values below ``size`` that are ``valid``, as it is itself."""
        bits = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
        mask, n_bytes = (1 << bits) - 1, (bits + 7) // 8
        while True:
            left, right = value >> bits, value & mask
            for r in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
                if back:
                    left, right = right ^ self._round(tweak, r, left, n_bytes, mask), left
                else:
                    left, right = right, left ^ self._round(tweak, r, right, n_bytes, mask)
            value = left << bits | right
            if value < size and valid(value):
                return value

    def mixed(self, digits: list[int], radixes: list[int], tweak: bytes, back: bool) -> list[int]:
        """A number of mixed radix, permuted; the radixes are part of the tweak."""
        out = []
        for at in range(0, len(digits), BLOCK):
            part, radix = digits[at : at + BLOCK], radixes[at : at + BLOCK]
            value, size = 0, 1
            for d, r in zip(part, radix):
                value, size = value * r + d, size * r
            value = self.permute(value, size, tweak + repr((at, radix)).encode(), back)
            found = []
            for r in reversed(radix):
                value, d = divmod(value, r)
                found.append(d)
            out += reversed(found)
        return out

    def characters(self, text: str, classes: list[str], tweak: bytes, back: bool) -> str:
        """Each character that is in one of the classes moves within its class; the others stay."""
        own = [next((c for c in classes if ch in c), "") for ch in text]
        spots = [k for k, c in enumerate(own) if c]
        moved = self.mixed([own[k].index(text[k]) for k in spots], [len(own[k]) for k in spots], tweak, back)
        out = list(text)
        for k, d in zip(spots, moved):
            out[k] = own[k][d]
        return "".join(out)


LETTERS = [string.digits, string.ascii_lowercase, string.ascii_uppercase]
HEX = string.digits + "abcdef"


def refilled(form: str, characters: str) -> str:
    """``form`` with its letters and digits replaced in order."""
    it = iter(characters)
    return "".join(next(it) if c.isalnum() else c for c in form)


def check_digit(digits: str) -> int:
    """The last digit that completes a card number."""
    total = sum(d if k % 2 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def card(f: Feistel, s: str, back: bool) -> str | None:
    plain = re.sub(r"\D", "", s)
    if check_digit(plain[:-1]) != int(plain[-1]) or not 13 <= len(plain) <= 19 or plain[0] == "0":
        return None
    body = plain[0] + f.characters(plain[1:-1], [string.digits], b"card" + plain[:1].encode(), back)
    return refilled(s, body + str(check_digit(body)))


def iban_check(country: str, account: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in f"{account}{country}00")) % 97


def is_iban(plain: str) -> bool:
    return 15 <= len(plain) <= 34 and iban_check(plain[:2], plain[4:]) == int(plain[2:4])


def own_length(s: str) -> int:
    """Where the form of an account number's country ends in ``s``; 0 where it does not end there or is not known."""
    size = IBAN_LENGTH.get(s[:2], 0)
    ends = [k for k in range(1, len(s) + 1) if s[k - 1] != " " and s[k : k + 1] in ("", " ")]
    return next((k for k in ends if len(s[:k].replace(" ", "")) == size), 0)


def iban(f: Feistel, s: str, back: bool) -> str | None:
    plain = s.replace(" ", "")
    if not is_iban(plain):
        return None
    country, first = plain[:2], own_length(s)
    while True:  # a number of another length than its country's must not read as one of that length
        account = f.characters(plain[4:], [string.digits, string.ascii_uppercase], b"iban" + country.encode(), back)
        plain = f"{country}{iban_check(country, account):02d}{account}"
        new = refilled(s, plain)
        if first in (0, len(s)) or not is_iban(new[:first].replace(" ", "")):
            return new


def date(f: Feistel, s: str, back: bool) -> str | None:
    """Year first, or day first; month first where only that makes a date. Stays in its form, padding included."""
    a, sep, b, _, c = re.split(r"([-/.])", s)
    first = len(a) == 4
    forms = [("ymd", (a, b, c))] if first else [("dmy", (c, b, a)), ("mdy", (c, a, b))]

    def parts(v: int, form: str) -> list[str]:
        d = datetime.date.fromordinal(DAY_ONE + v)
        return [str({"y": d.year, "m": d.month, "d": d.day}[x]) for x in form]

    for form, (y, m, d) in forms:
        try:
            value = datetime.date(int(y), int(m), int(d)).toordinal() - DAY_ONE
        except ValueError:
            continue
        if not 0 <= value < DAYS:
            return None
        written = [a, b, c]
        short = [x for x in range(3) if len(written[x]) == 1]
        padded = any(len(w) == 2 and w[0] == "0" for w in written)

        def valid(v: int) -> bool:
            p = parts(v, form)
            if form == "mdy" and int(p[1]) <= 12:  # it would read as day first
                return False
            here = [len(x) for x in p]
            if padded and short:  # one part padded, one not: both stay below ten
                return here.count(1) == 2
            if padded:
                return min(here) == 1
            return here == [len(w) for w in written]

        value = f.permute(value, DAYS, f"date{form}{padded}{[len(w) for w in written]}".encode(), back, valid)
        return sep.join(p.zfill(len(w)) for p, w in zip(parts(value, form), written))
    return None


def ssn(f: Feistel, s: str, back: bool) -> str | None:
    area, group, serial = map(int, s.split("-"))
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return None
    value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    value, serial = divmod(f.permute(value, 898 * 99 * 9999, b"ssn", back), 9999)
    area, group = divmod(value, 99)
    area += 1
    return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


def address(f: Feistel, s: str, back: bool) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    low, room = {1: 0, 2: 10, 3: 100}, {1: 10, 2: 90, 3: 156}
    moved = f.mixed([int(p) - low[len(p)] for p in parts], [room[len(p)] for p in parts], b"ip", back)
    return ".".join(str(low[len(p)] + m) for p, m in zip(parts, moved))


def phone(f: Feistel, s: str, back: bool) -> str | None:
    digits = re.sub(r"\D", "", s)
    if not 7 <= len(digits) <= 15:
        return None
    m = re.match(r"\+?1(?=\D*[0-9]{3}\D*[0-9]{3}\D*[0-9]{4}$)|\+[1-9][0-9]{0,2}(?=[ .(-])", s)
    code = re.sub(r"\D", "", m[0]) if m else ""
    rest = digits[len(code) :]
    if len(rest) == 10:  # area and exchange keep to leading digits of their kind
        lead = [("01", "23456789")[c >= "2"] if k in (0, 3) else string.digits for k, c in enumerate(rest)]
    else:
        lead = [string.digits] * len(rest)
    moved = f.mixed([c.index(d) for c, d in zip(lead, rest)], [len(c) for c in lead], f"phone{''.join(lead[k][0] for k in (0, 3) if len(rest) == 10)}".encode(), back)
    return refilled(s, code + "".join(c[d] for c, d in zip(lead, moved)))


def email(f: Feistel, s: str, back: bool) -> str | None:
    name, _, ending = s.rpartition(".")
    return f"{f.characters(name, LETTERS, b'email', back)}.{ending}"


def access(f: Feistel, s: str, back: bool) -> str | None:
    return s[:4] + f.characters(s[4:], [string.digits + string.ascii_uppercase], b"access", back)


def secret(f: Feistel, s: str, back: bool) -> str | None:
    return f.characters(s, [HEX] if set(s) <= set(HEX) else LETTERS, b"hex" if set(s) <= set(HEX) else b"secret", back)


CHANGE = {"secret": secret, "email": email, "access": access, "iban": iban, "iso": date, "day": date, "ssn": ssn, "ip": address, "phone": phone, "card": card}


def forms(kind: str, s: str) -> list[int]:
    """The lengths at which a candidate is tried: whole, then without its last groups; an account number first at its country's."""
    if kind not in ("iban", "phone"):
        return [len(s)]
    ends = [len(s), *(k for k in range(len(s) - 1, 0, -1) if s[k] in " .-" and s[k - 1] not in " .-")]
    first = own_length(s) if kind == "iban" else 0
    return [first, *(k for k in ends if k != first)] if first else ends


def pseudonymise_text(text: str, f: Feistel, back: bool = False, kinds: frozenset[str] = frozenset(KINDS)) -> tuple[str, int]:
    """The text with pseudonyms, and how many values it held."""
    if not MAYBE.search(text):
        return text, 0
    n, at, copied, out = 0, 0, 0, []
    while m := CANDIDATE.search(text, at):
        kind = m.lastgroup if m.lastgroup in CHANGE else next(k for k in KINDS if m[k] is not None)
        start, whole = (m.start("value"), m["value"]) if kind == "secret" else (m.start(), m[0])
        if kind not in kinds:
            at = m.end()
            continue
        for size in forms(kind, whole):
            new = CHANGE[kind](f, whole[:size], back)
            if new is not None:
                break
        if new is None:
            at = m.start() + 1
            continue
        n += 1
        out += [text[copied:start], new]
        at = copied = start + size
    return "".join([*out, text[copied:]]), n


@functools.lru_cache(maxsize=4)
def network(key: bytes) -> Feistel:
    return Feistel(key)


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", back: bool = False, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``docs`` with the values in ``text`` replaced, and ``n_pii``, their number."""
    docs = drop_clashing(docs, ["n_pii"])
    out, wanted = T.StructType([*docs.schema.fields, T.StructField("n_pii", T.LongType())]), frozenset(kinds)
    spot = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = network(key)
        for batch in batches:
            at = 0
            for texts in slices(batch.column(spot)):
                found = [(None, 0) if t is None else pseudonymise_text(t, f, back, wanted) for t in texts]
                columns = [*batch.slice(at, len(texts)).columns, pa.array([n for _, n in found], pa.int64())]
                columns[spot] = pa.array([t for t, _ in found], batch.column(spot).type)
                yield pa.RecordBatch.from_arrays(columns, names=[x.name for x in out])
                at += len(texts)

    return docs.mapInArrow(released(run, "pseudonyms"), out)


def restore(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """The originals again, by the same key."""
    return pseudonymise(docs, key, text, back=True)


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)
