"""Secret scan with structural confirmation.

Three base patterns (an assignment to a password-like name, an access key id, a run of
hex digits) are reported as they match.  Further candidates are reported only after
their structure has been confirmed by decoding and parsing:

* ``pem``      a PEM private-key block whose body decodes to a key;
* ``der``      base64 or hex text that decodes to a DER private key (PKCS#1, SEC1, DSA,
               PKCS#8, encrypted PKCS#8): every nested length must fit exactly.  The key
               inside PKCS#8 is parsed as its algorithm says (another algorithm's: as
               PKCS#1 or SEC1), and an encrypted one must name a password-based scheme with
               its parameters, so digests and made-up frames are not reported;
* ``openssh``  base64 text of an OpenSSH private key: magic and length-prefixed strings;
* ``jwt``      a signed token: header and claims are JSON objects however they are laid
               out, the header names a registered signing algorithm, and the signature
               decodes.  One of another length than the algorithm's is reported as cut.

A PEM block with an encrypted body must name its cipher and an initial vector of whole
8-byte blocks, and its body must be whole 8-byte blocks too (the least block of the ciphers).

Defined results: a null or empty text has no spans.  Matches of one kind never overlap;
different kinds may.  Repeated rows are scanned alike.  Every pattern is linear in the
text, also for very long texts.  Other columns pass through; a column that has the
output's name is replaced.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

BASE_KINDS = ("assign", "access", "hex")
KINDS = BASE_KINDS + ("pem", "der", "openssh", "jwt")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                     r"""([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ASSIGN_HINT = re.compile(r"pass(?:word|wd)|secret|token|api_?key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
# header values run to the line end (a line break, or one escaped as in JSON).  The scan is
# linear: a run is taken whole (lookahead, then reference), every body splits in one way only,
# and none goes past another marker
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----"
                  r"((?:(?=([A-Za-z0-9-]+))\3: (?=((?:(?!\\n|-----(?:BEGIN|END) )[^\n])*))\4(?:\n|\\n)"
                  r"|(?![A-Za-z0-9-]+: )(?=([A-Za-z0-9+/=]+))\5|\s|\\n|\\(?!n))*)-----END \1-----")
_DER64 = re.compile(r"(?<![A-Za-z0-9+/_-])M[A-P][A-Za-z0-9+/_-]{30,}={0,2}")
_DERHEX = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{46,}(?![0-9A-Fa-f])")
_SSH64 = re.compile(r"(?<![A-Za-z0-9+/])b3BlbnNzaC1rZXktdjE[A-Za-z0-9+/]+={0,2}")
# a header is a JSON object: its first byte is a brace or white space, whatever follows
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(?:e[w-z0-9_-]|C[Q-Za-v]|D[Q-Za-f]|I[A-P])[A-Za-z0-9_-]{12,}"
                  r"\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
_SSH_MAGIC = b"openssh-key-v1\0"

# fixed values: object identifiers of key algorithms, their DER content in hex
RSA_OIDS = ("2a864886f70d010101", "2a864886f70d01010a")
EC_OIDS = ("2a8648ce3d0201",)
NUMBER_OIDS = ("2a8648ce380401", "2a864886f70d010301", "2a8648ce3e0201")              # DSA, DH: the key is a number
RAW_OIDS = {"2b656e": 32, "2b656f": 56, "2b6570": 32, "2b6571": 57}                   # X25519, X448, Ed25519, Ed448
PBES2_OID = "2a864886f70d01050d"
PBE_OIDS = ("2a864886f70d010501", "2a864886f70d010503", "2a864886f70d010504", "2a864886f70d010506",
            "2a864886f70d01050a", "2a864886f70d01050b", "2a864886f70d010c0101", "2a864886f70d010c0102",
            "2a864886f70d010c0103", "2a864886f70d010c0104", "2a864886f70d010c0105", "2a864886f70d010c0106")
# fixed values: signing algorithms and their signatures' bytes; an RSA one's are its modulus's, 128 at least
SIGNATURE_BYTES = {
    "HS256": (32,), "HS384": (48,), "HS512": (64,), "ES256": (64,), "ES256K": (64,), "ES384": (96,), "ES512": (132,),
    "EdDSA": (64, 114), "Ed25519": (64,), "Ed448": (114,),
    "RS256": None, "RS384": None, "RS512": None, "PS256": None, "PS384": None, "PS512": None,
}
# fixed values: ciphers of encrypted PEM bodies
PEM_CIPHERS = ("DES-CBC", "DES-EDE3-CBC", "AES-128-CBC", "AES-192-CBC", "AES-256-CBC", "CAMELLIA-128-CBC",
               "CAMELLIA-192-CBC", "CAMELLIA-256-CBC", "SEED-CBC", "IDEA-CBC", "BF-CBC", "CAST5-CBC", "RC2-CBC")
_PROC_TYPE = re.compile(r"(?:^|\n)\s*Proc-Type: 4,ENCRYPTED\s*(?:\n|$)")
_DEK_INFO = re.compile(r"(?:^|\n)\s*DEK-Info: ([A-Z0-9-]+),((?:[0-9A-Fa-f]{16})+)\s*(?:\n|$)")

_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                             ("detail", pa.string())]))


def unbase64(text: str) -> bytes | None:
    """Decoded standard or URL-safe base64, None when it is not valid."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(b: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER elements that fill ``b[at:end]`` exactly, else None."""
    items = []
    while at < end:
        if at + 2 > end:
            return None
        tag, size, at = b[at], b[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size = int.from_bytes(b[at:at + n], "big")
            if size < 0x80 or size >> (8 * (n - 1)) == 0:
                return None                       # DER wants the shortest form
            at += n
        if at + size > end:
            return None
        items.append((tag, at, at + size))
        at += size
    return items


def _sequence(b: bytes, item: tuple[int, int, int]) -> list[tuple[int, int, int]]:
    """The elements of a DER sequence, none when it is no sequence or does not fit."""
    return der_items(b, *item[1:]) or [] if item[0] == 0x30 else []


def _identifier(b: bytes, items: list[tuple[int, int, int]]) -> str | None:
    """Hex content of the object identifier that opens the elements, else None."""
    return b[items[0][1]:items[0][2]].hex() if items and items[0][0] == 6 else None


def _holds_key(b: bytes, oid: str) -> bool:
    """Whether the bytes inside a PKCS#8 frame are a private key of its algorithm."""
    if oid in RAW_OIDS:
        return len(b) == RAW_OIDS[oid] + 2 and b[:2] == bytes([4, RAW_OIDS[oid]])
    if oid in NUMBER_OIDS:
        items = der_items(b, 0, len(b))
        return bool(items) and [t for t, _, _ in items] == [2] and len(b) > 16
    kind = der_key(b)
    return kind in (("pkcs1",) if oid in RSA_OIDS else ("sec1",) if oid in EC_OIDS else ("pkcs1", "sec1"))


def _password_based(b: bytes, scheme: list[tuple[int, int, int]]) -> bool:
    """Whether an algorithm's elements are a password-based scheme with its parameters."""
    oid = _identifier(b, scheme)
    given = _sequence(b, scheme[1]) if len(scheme) == 2 else []
    if oid == PBES2_OID:      # how the key is derived, then the cipher, either an algorithm
        return len(given) == 2 and all(_identifier(b, _sequence(b, x)) for x in given)
    return oid in PBE_OIDS and [t for t, _, _ in given] == [4, 2]      # salt and rounds


def der_key(b: bytes) -> str | None:
    """Which private-key structure the bytes are, exactly and whole; None if none."""
    top = der_items(b, 0, len(b))
    if not top or len(top) != 1:
        return None
    parts = _sequence(b, top[0])
    if len(parts) < 2:
        return None
    tags = [t for t, _, _ in parts]
    version = int.from_bytes(b[parts[0][1]:parts[0][2]], "big") if tags[0] == 2 else None
    if (tags, version) in (([2] * 9, 0), ([2] * 9 + [0x30], 1)):
        return "pkcs1"
    if tags == [2] * 6 and version == 0 and parts[1][2] - parts[1][1] >= 64:
        return "dsa"
    if tags[:2] == [2, 4] and version == 1 and tags[2:] in ([], [0xA0], [0xA1], [0xA0, 0xA1]):
        return "sec1"
    if tags[:3] == [2, 0x30, 4] and version in (0, 1) and set(tags[3:]) <= {0xA0, 0xA1, 0x81}:
        oid = _identifier(b, _sequence(b, parts[1]))
        return "pkcs8" if oid and _holds_key(b[parts[2][1]:parts[2][2]], oid) else None
    if tags == [0x30, 4] and parts[1][2] > parts[1][1] and _password_based(b, _sequence(b, parts[0])):
        return "pkcs8-encrypted"
    return None


def ssh_key(b: bytes) -> str | None:
    """Cipher name of an OpenSSH private key whose nested lengths all fit, else None."""
    if not b.startswith(_SSH_MAGIC):
        return None
    at = len(_SSH_MAGIC)

    def string() -> bytes | None:
        nonlocal at
        size = int.from_bytes(b[at:at + 4], "big")
        if at + 4 + size > len(b):
            return None
        at += 4 + size
        return b[at - size:at]

    cipher, kdf, options = string(), string(), string()
    count, at = int.from_bytes(b[at:at + 4], "big"), at + 4
    if None in (cipher, kdf, options) or not 1 <= count <= 16:
        return None
    keys = [string() for _ in range(count + 1)]
    return cipher.decode("ascii", "replace") if None not in keys and at == len(b) else None


def signed_token(text: str) -> str | None:
    """Algorithm of a signed token with JSON header and claims, else None.  A signature that
    is not as long as the algorithm's is told in the answer: the token was cut."""
    parts = text.split(".")
    try:
        head, claims = (json.loads(unbase64(x) or b"") for x in parts[:2])
    except (ValueError, RecursionError):
        return None
    alg = head.get("alg") if isinstance(head, dict) and isinstance(claims, dict) else None
    signature = unbase64(parts[2])
    if not isinstance(alg, str) or alg not in SIGNATURE_BYTES or not signature:
        return None
    sizes = SIGNATURE_BYTES[alg]
    whole = len(signature) in sizes if sizes else len(signature) >= 128
    return alg if whole else alg + " cut"


def _pem_body(body: str) -> str | None:
    body = body.replace("\\n", "\n")
    raw = unbase64("".join("".join(x for x in body.split("\n") if ": " not in x).split()))
    if not raw:
        return None
    dek = _DEK_INFO.search(body) if _PROC_TYPE.search(body) else None
    encrypted = dek and dek[1] in PEM_CIPHERS and len(raw) % 8 == 0
    return der_key(raw) or ssh_key(raw) or ("legacy-encrypted" if encrypted else None)


def scan_text(text: str | None) -> list[dict]:
    """Spans of one text by start, then kind as listed (code points, end exclusive)."""
    if not text:
        return []
    out = []
    add = lambda kind, m, detail: out.append((m.start(), KINDS.index(kind), m.end(), detail))
    if _ASSIGN_HINT.search(text.lower()):
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 12:
                add("assign", m, m[1].lower())
    for m in _ACCESS.finditer(text):
        if m.end() - m.start() >= 18:
            add("access", m, None)
    for m in _HEX.finditer(text):
        add("hex", m, None)
    confirmed = [("jwt", _JWT, lambda m: signed_token(m[0])),
                 ("der", _DER64, lambda m: der_key(unbase64(m[0]) or b"")),
                 ("der", _DERHEX, lambda m: der_key(bytes.fromhex(m[0])) if len(m[0]) % 2 == 0 else None),
                 ("openssh", _SSH64, lambda m: ssh_key(unbase64(m[0]) or b""))]
    if "-----BEGIN " in text:
        confirmed.append(("pem", _PEM, lambda m: _pem_body(m[2])))
    for kind, pattern, confirm in confirmed:
        for m in pattern.finditer(text):
            if found := confirm(m):
                add(kind, m, found)
    return [{"kind": KINDS[k], "start": s, "end": e, "detail": d} for s, k, e, d in sorted(out, key=lambda x: x[:3])]


@F.arrow_udf(from_arrow_type(_ARROW))
def _scan(texts: pa.Array) -> pa.Array:
    return pa.array([scan_text(t.as_py()) for t in texts], type=_ARROW)


def find_secrets(df: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """``df`` with the array ``out`` of spans (kind, start, end, detail) of each text."""
    return df.withColumn(out, _scan(F.col(text).cast("string")))
