"""Personal data: patterns propose, checksums confirm, nearby words weigh.

Regular expressions propose e-mail addresses, IPv4 addresses, card numbers, phone
numbers and IBANs.  Validators confirm them: number ranges for addresses, Luhn for
cards, digit counts for phones, mod-97 and the country's length for IBANs (of the
countries of the IBAN registry; another prefix is no IBAN).  A word such
as "card" or "Telefon" shortly before or after the span raises its score; one that
points elsewhere ("order", "version") lowers it.  A kind with a least score (IBANs: 0.7,
that is, none beside a word against it unless one speaks for it) is reported from that score
on; the base kinds are reported whatever theirs is, with it.

Defined results: a null or empty text has no spans.  Proposals of one kind are leftmost
and non-overlapping, and a failed one is dropped, not retried; only IBANs are searched
anew from just after a failed one's country and check digits.  Repeated rows are scanned
alike.  Every scan is linear in the text: address and number patterns start only
where a run starts.  Other columns pass through; a column that has the output's name is
replaced.
"""

from __future__ import annotations

import re
import string

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + ("iban",)
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8}
CONTEXT = 40          # code points looked at on either side
STEP = 0.2            # score step of a context word
LEAST = {"iban": 0.7}  # least score reported, by kind; any for the others

# fixed values: words that speak for or against a kind, in four languages
FOR = {
    "email": "mail email e-mail correo contact contacto kontakt courriel write",
    "ip": "ip address host server client login adresse dirección connected",
    "card": "card visa mastercard amex credit debit karte carte tarjeta payment pay",
    "phone": "phone tel telephone call mobile fax telefon téléphone teléfono móvil handy",
    "iban": "iban account bank konto compte cuenta transfer überweisung",
}
AGAINST = {
    "email": "", "ip": "version release build", "card": "order serial isbn tracking invoice",
    "phone": "order version isbn", "iban": "order serial",
}
# fixed values: IBAN length by country, every country of the registry
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27,
    "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23,
    "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21,
    "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22,
    "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only start at the start of a run of digits: elsewhere the run's start would
# have matched before, or failed for the same reason
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_IBAN_REST = {c: re.compile(rf"(?:\x20?[A-Z0-9]){{{n - 4}}}") for c, n in IBAN_LENGTH.items()}
_WORD = re.compile(r"[^\W\d_][\w-]*")
_FOR = {k: frozenset(v.split()) for k, v in FOR.items()}
_AGAINST = {k: frozenset(v.split()) for k, v in AGAINST.items()}

_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                             ("score", pa.float64())]))


def luhn(digits: str) -> bool:
    """The Luhn check over a string of ASCII digits."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def mod97(iban: str) -> bool:
    """The IBAN check: country length, and the moved number is 1 modulo 97."""
    if len(iban) != IBAN_LENGTH.get(iban[:2]):
        return False
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each ``@``."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        free = m.end() if m else at + 1
        if m:
            out.append((start, free))
        at = text.find("@", free)
    return out


def ibans(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping IBANs.  The country's length ends one, as upper-case words or
    a further IBAN may follow; after a prefix that begins none, the search goes on."""
    out, at = [], 0
    while m := _IBAN.search(text, at):
        at = m.end()
        rest = _IBAN_REST[m[0][:2]].match(text, at) if m[0][:2] in _IBAN_REST else None
        if rest and not text[rest.end():rest.end() + 1].isalnum() and mod97((m[0] + rest[0]).replace(" ", "")):
            out.append((m.start(), at := rest.end()))
    return out


def scan_text(text: str | None) -> list[dict]:
    """Spans of one text by kind as listed, then start (code points, end exclusive)."""
    if not text:
        return []
    found = [("email", s, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() >= 13 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    found += [("iban", *span) for span in ibans(text)]
    scored = ((k, s, e, _score(text, k, s, e)) for k, s, e in found)
    return [{"kind": k, "start": s, "end": e, "score": x} for k, s, e, x in scored if x >= LEAST.get(k, 0.0)]


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - CONTEXT):start] + " " + text[end:end + CONTEXT]
    words = {w.lower() for w in _WORD.findall(near)}
    score = BASE_SCORE[kind] + STEP * bool(words & _FOR[kind]) - STEP * bool(words & _AGAINST[kind])
    return round(min(1.0, max(0.0, score)), 2)


@F.arrow_udf(from_arrow_type(_ARROW))
def _scan(texts: pa.Array) -> pa.Array:
    return pa.array([scan_text(t.as_py()) for t in texts], type=_ARROW)


def find_pii(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``df`` with the array ``out`` of spans (kind, start, end, score) of each text."""
    return df.withColumn(out, _scan(F.col(text).cast("string")))
