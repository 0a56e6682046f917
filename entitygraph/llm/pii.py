"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from entitygraph.llm.common import small_batches, texts_of

#: Kinds in the order in which spans with equal starts are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE_KINDS = KINDS[:4]

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# A leftmost match can begin at the start of a run of digits only, so no run is tried from within.
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_iban = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
_ssn = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: Secrets: keys with a telling form, passwords in addresses, and long runs that a validator must find random.
#: Lengths are part of the forms: chat tokens end at 72 characters and service keys at 120, beyond which a run is no such key (long runs are judged
#: by their randomness all the same); a login of more than 64 characters on either side of the colon is taken for a path.
_marked = re.compile(
    r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,72}|sk-[A-Za-z0-9_-]{20,120}|AIza[0-9A-Za-z_-]{35}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})(?![A-Za-z0-9])|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
)
_login = re.compile(r"(?<=://)[^\s/:@]{1,64}:[^\s/:@]{1,64}(?=@)")
_run = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}")
_hex = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_not_digits = re.compile(r"[^0-9]+")

#: Words that raise the score when they stand near a span, by kind.
CONTEXT: dict[str, frozenset[str]] = {
    "email": frozenset(["mail", "email", "contact", "write"]),
    "ip": frozenset(["ip", "address", "host", "server"]),
    "card": frozenset(["card", "credit", "visa", "mastercard", "payment"]),
    "phone": frozenset(["phone", "tel", "call", "mobile", "fax"]),
    "iban": frozenset(["iban", "account", "bank", "konto", "cuenta", "compte"]),
    "ssn": frozenset(["ssn", "social", "security"]),
    "secret": frozenset(["token", "secret", "key", "apikey", "password", "passwd", "pwd", "bearer", "credential", "credentials", "auth", "authorization", "access"]),
}
#: Words that lower the score when they stand near a span, by kind.
OTHERWISE: dict[str, frozenset[str]] = {
    "ip": frozenset(["version", "release", "section", "chapter"]),
    "card": frozenset(["isbn", "issn", "order", "tracking"]),
    "phone": frozenset(["isbn", "issn", "order", "tracking"]),
    "ssn": frozenset(["isbn", "issn", "order", "tracking", "part"]),
    "secret": frozenset(["commit", "checksum", "sha", "md", "digest", "revision", "uuid"]),
}
#: The lengths of IBANs by country.
IBAN_LENGTHS: dict[str, int] = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_word = re.compile(r"[A-Za-z]+")
#: Code points before and after a span in which context words count.
NEAR = 40
#: Score of a proposed span, of a confirmed one, and what a context word adds.  Added kinds need THRESHOLD.
PROPOSED, CONFIRMED, NEARBY, THRESHOLD = 0.3, 0.7, 0.3, 0.6
#: Added kinds whose check is a checksum; of the others a context word must stand near.
CHECKSUM = frozenset(["card", "iban"])


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def mod97(iban: str) -> bool:
    code = iban.replace(" ", "")
    number = "".join(str(int(c, 36)) for c in code[4:] + code[:4])
    return len(code) == IBAN_LENGTHS.get(code[:2]) and int(number) % 97 == 1


def entropy(text: str) -> float:
    """Bits a character, by the text's own frequencies."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def random_run(text: str) -> bool:
    """Whether a run looks drawn at random: a hexadecimal number of 32 digits or more, or digits in letters of both cases."""
    if _hex.fullmatch(text):
        return len(text) >= 32 and any(map(str.isalpha, text)) and any(map(str.isdigit, text)) and entropy(text) >= 3.0
    digits = sum(map(str.isdigit, text))
    mixed = any(map(str.islower, text)) and any(map(str.isupper, text))
    return mixed and 10 * digits >= len(text) and entropy(text) >= 3.5


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outwards."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _local:
            start -= 1
        if start < at and (m := _domain.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping numbers of their country's length, single spaces left out, that pass mod 97."""
    end = 0
    for m in _iban.finditer(text):
        length = IBAN_LENGTHS.get(m.group()[:2])
        if length and m.start() >= end and (whole := _rest_of_iban(length).match(text, m.end())) and mod97(text[m.start() : whole.end()]):
            end = whole.end()
            yield m.start(), end


@lru_cache(maxsize=None)
def _rest_of_iban(length: int) -> re.Pattern:
    return re.compile(rf"(?: ?[A-Z0-9]){{{length - 4}}}(?![A-Za-z0-9])")


def octet(part: str) -> bool:
    value = part.lstrip("0")
    return len(value) < 3 or len(value) == 3 and int(value) <= 255


def context(text: str, kind: str, start: int, end: int) -> int:
    """1 where words near a span speak for its kind, -1 where others speak against it, 0 where neither or both do."""
    around = {w.lower() for w in _word.findall(text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR])}
    return (not around.isdisjoint(CONTEXT[kind])) - (not around.isdisjoint(OTHERWISE.get(kind, ())))


def secrets(text: str) -> Iterator[tuple[int, int, str, float]]:
    """Spans of secrets: those of a telling form are confirmed, random runs proposed; none within an earlier one."""
    taken = [(m.start(), m.end()) for m in _marked.finditer(text)]
    if "://" in text:
        taken += [(m.start(), m.end()) for m in _login.finditer(text)]
    yield from ((a, b, "secret", CONFIRMED) for a, b in taken)
    for m in _run.finditer(text):
        if random_run(m.group()) and not any(a < m.end() and m.start() < b for a, b in taken):
            yield m.start(), m.end(), "secret", PROPOSED


def find(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of every span, by start and then by the order of KINDS; offsets are code points."""
    found = []
    if "@" in text:
        found += [(a, b, "email", CONFIRMED) for a, b in emails(text)]
    for m in _ip.finditer(text):
        if all(map(octet, m.group().split("."))):
            found.append((m.start(), m.end(), "ip", CONFIRMED))
    for m in _card.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _not_digits.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card", CONFIRMED))
    if "+" in text:
        for m in _phone.finditer(text):
            if 10 <= len(_not_digits.sub("", m.group())) <= 15:
                found.append((m.start(), m.end(), "phone", CONFIRMED))
    found += ((a, b, "iban", CONFIRMED) for a, b in ibans(text))
    for m in _ssn.finditer(text):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000":
            found.append((m.start(), m.end(), "ssn", PROPOSED))
    found += secrets(text)
    out = []
    for a, b, kind, score in found:
        score = max(0.0, min(1.0, score + NEARBY * context(text, kind, a, b)))
        if kind in BASE_KINDS or score >= THRESHOLD:
            out.append((a, b, kind, score))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


SPAN = "struct<kind:string,start:int,stop:int,score:double>"
_arrow_span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))


def find_spans(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with ``spans``: an array of (kind, start, stop, score), code points, end exclusive.

    Base kinds (email, ip, card, phone) are kept whenever their checks hold; added
    kinds (iban, ssn, secret) need the threshold.  A null or empty text has no spans.
    Rows are independent: ties and repeated rows give repeated results, an empty
    table an empty one; other columns are not read.  Scans are linear in the text.
    """
    small_batches(docs.sparkSession)
    source = docs.select(*keep, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema) + f", spans array<{SPAN}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": k, "start": a, "stop": b, "score": s} for a, b, k, s in find(t)] for t in texts_of(batch, text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(spans, _arrow_span)], names=[*keep, "spans"])

    return source.mapInArrow(run, schema)
