"""Secrets and personal data: base spans against plain regular expressions, structure checks."""

import base64
import hashlib
import json
import re
import time

import pytest

from seatwise.llm import pii, queries, secrets

from .conftest import LONG, SF


def luhn_by_hand(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_secrets(t):
    out = [("assign", *m.span()) for m in re.finditer(
        r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t)
        if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def base_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn_by_hand(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


@pytest.mark.parametrize("query,base,kinds", [(queries.op1_secrets, base_secrets, secrets.BASE_KINDS),
                                              (queries.op8_pii, base_pii, pii.BASE_KINDS)])
def test_base_spans_on_documents(spark, texts, query, base, kinds):
    rows = {r.doc_id: r for r in query(spark, SF).collect()}
    assert rows.keys() == texts.keys()
    for i, t in texts.items():
        want = base(t)
        assert rows[i].base_sha256 == digest(want)
        assert [rows[i][f"n_{k}"] for k in kinds] == [sum(w[0] == k for w in want) for k in kinds]
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(rows[i].spans.split(","))


TRICKY = ["a@b.c@d.e", "x@y @z.de u@v.w.", "1.2.3.4.5.6.7.8", "999.1.1.1 1.1.1.999", "+1 (555) 555-5555 +1+2 345 678 90",
          "4111 1111 1111 1111", "4111-1111-1111-1112", "0" * 40, "1" * 4000 + ".2.3.4", "a" * 5000 + "@", "@" * 2000,
          "Kelvin toKen=abcdefghijklmn ſecret=abcdefghijklmn", "TOKEN : 'abcdefghijklmnop", "api_key=short",
          "apikey = \"0123456789abcdef0123\"", "AKIA" + "A" * 14, "AKIAAKIAAKIAAKIAAK", "\U0001f600 password=aaaaaaaaaaaaaaa"]


@pytest.mark.parametrize("t", TRICKY)
def test_base_spans_on_tricky_texts(t):
    assert [(s["kind"], s["start"], s["end"]) for s in secrets.scan_text(t) if s["kind"] in secrets.BASE_KINDS] == base_secrets(t)
    assert [(s["kind"], s["start"], s["end"]) for s in pii.scan_text(t) if s["kind"] in pii.BASE_KINDS] == base_pii(t)


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | len(n.to_bytes((n.bit_length() + 7) // 8, "big"))]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


INT = lambda n: der(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))
PKCS1 = der(0x30, INT(0) + b"".join(INT(3 ** (40 + i)) for i in range(8)))
SEC1 = der(0x30, INT(1) + der(4, bytes(range(32))))
PKCS8 = der(0x30, INT(0) + der(0x30, der(6, b"\x2a\x86\x48")) + der(4, PKCS1))


def ssh_string(b):
    return len(b).to_bytes(4, "big") + b


SSH = b"openssh-key-v1\0" + ssh_string(b"none") + ssh_string(b"none") + ssh_string(b"") + (1).to_bytes(4, "big") + ssh_string(b"p" * 51) + ssh_string(b"k" * 136)


def token(head, claims=b'{"sub":"1"}', sign=b"signature"):
    return ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (head, claims, sign))


def kinds(t):
    return [s["kind"] for s in secrets.scan_text(t)]


def test_structures_are_confirmed():
    for key, name in ((PKCS1, "pkcs1"), (SEC1, "sec1"), (PKCS8, "pkcs8")):
        assert secrets.der_key(key) == name
        text = base64.b64encode(key).decode()
        assert "der" in kinds(f"the key is {text} so")
        assert "der" in kinds(f"hex {key.hex().upper()} end")
        pem = f"-----BEGIN PRIVATE KEY-----\n{text}\n-----END PRIVATE KEY-----"
        assert "pem" in kinds(pem)
        # any changed length breaks the nesting
        assert secrets.der_key(key[:-1]) is None and secrets.der_key(key + b"\0") is None
        assert "der" not in kinds(base64.b64encode(key[:-1]).decode())
    assert "openssh" in kinds(base64.b64encode(SSH).decode())
    assert secrets.ssh_key(SSH[:-1]) is None
    good = token(json.dumps({"alg": "HS256"}).encode())
    assert kinds(f"Bearer {good}") == ["jwt"]
    assert kinds(token(b'{"alg":"none"}')) == kinds(token(b'{"x":1}')) == kinds(token(b'{"alg":"RS256"')) == []


@pytest.mark.parametrize("cipher", ["AES-128-CBC", "DES-EDE3-CBC", "AES-256-CBC"])
@pytest.mark.parametrize("eol", ["\n", "\r\n", "\\n"])
def test_encrypted_pem_with_header_lines(cipher, eol):
    body = base64.b64encode(bytes(range(7, 255)) * 3).decode()
    lines = [body[i:i + 64] for i in range(0, len(body), 64)]
    pem = eol.join(["-----BEGIN RSA PRIVATE KEY-----", "Proc-Type: 4,ENCRYPTED",
                    f"DEK-Info: {cipher},0123456789ABCDEF", "", *lines, "-----END RSA PRIVATE KEY-----"])
    text = f"see {pem} and {pem}."
    found = [(text[s["start"]:s["end"]], s["detail"]) for s in secrets.scan_text(text) if s["kind"] == "pem"]
    assert found == [(pem, "legacy-encrypted")] * 2
    # headers alone confirm nothing
    assert "pem" not in kinds(eol.join(pem.split(eol)[:4] + ["not a key!", "-----END RSA PRIVATE KEY-----"]))


def test_pem_scan_is_linear():
    begin = "-----BEGIN PRIVATE KEY-----\n"
    for text in (begin + "Header-Name: x-y\n" * 20_000, (begin + "A: -") * 20_000, (begin.strip() + "\nA: b-c\n") * 20_000,
                 begin + "Header-Name: x-y\\n" * 20_000, begin + "\\nAbc" * 50_000,
                 begin + "A" * 300_000, begin + "A-" * 150_000, begin + "Header-Name: " + "x" * 300_000):
        started = time.process_time()
        assert "pem" not in kinds(text)
        assert time.process_time() - started < 10


def test_iban_context_and_score():
    found = pii.scan_text("Konto: DE89 3704 0044 0532 0130 00 bitte")
    assert [s["kind"] for s in found if s["kind"] == "iban"] == ["iban"]
    iban = next(s for s in found if s["kind"] == "iban")
    assert iban["score"] == 1.0
    assert not [s for s in pii.scan_text("DE89 3704 0044 0532 0130 01") if s["kind"] == "iban"]
    near = pii.scan_text("my card 4111111111111111")[0]["score"]
    plain = pii.scan_text("zz 4111111111111111")[0]["score"]
    away = pii.scan_text("order 4111111111111111")[0]["score"]
    assert near > plain > away


# an example account of every country of the registry
IBANS = """
AD1200012030200359100100 AE070331234567890123456 AL47212110090000000235698741 AT611904300234573201 AZ21NABZ00000000137010001944
BA391290079401028494 BE68539007547034 BG80BNBG96611020345678 BH67BMAG00001299123456 BI4210000100010000332045181
BR1800360305000010009795493C1 BY13NBRB3600900000002Z00AB00 CH9300762011623852957 CR05015202001026284066 CY17002001280000001200527600
CZ6508000000192000145399 DE89370400440532013000 DJ2100010000000154000100186 DK5000400440116243 DO28BAGR00000001212453611324
EE382200221020145685 EG380019000500000000263180002 ES9121000418450200051332 FI2112345600000785 FK88SC123456789012 FO6264600001631634
FR1420041010050500013M02606 GB29NWBK60161331926819 GE29NB0000000101904917 GI75NWBK000000007099453 GL8964710001000206
GR1601101250000000012300695 GT82TRAJ01020000001210029690 HN88CABF00000000000250005469 HR1210010051863000160
HU42117730161111101800000000 IE29AIBK93115212345678 IL620108000000099999999 IQ98NBIQ850123456789012 IS140159260076545510730339
IT60X0542811101000000123456 JO94CBJO0010000000000131000302 KW81CBKU0000000000001234560101 KZ86125KZT5004100100
LB62099900000001001901229114 LC55HEMM000100010012001200023015 LI21088100002324013AA LT121000011101001000 LU280019400644750000
LV80BANK0000435195001 LY83002048000020100120361 MC5811222000010123456789030 MD24AG000225100013104168 ME25505000012345678951
MK07250120000058984 MN121234123456789123 MR1300020001010000123456753 MT84MALT011000012345MTLCAST001S
MU17BOMM0101101030300200000MUR NI45BAPR00000013000003558124 NL91ABNA0417164300 NO9386011117947 OM810180000001299123456
PK36SCBL0000001123456702 PL61109010140000071219812874 PS92PALS000000000400123456702 PT50000201231234567890154
QA58DOHB00001234567890ABCDEFG RO49AAAA1B31007593840000 RS35260005601001611379 RU0304452522540817810538091310419
SA0380000000608010167519 SC18SSCB11010000000000001497USD SD2129010501234001 SE4550000000058398257466 SI56263300012039086
SK3112000000198742637541 SM86U0322509800000000270100 SO211000001001000100141 ST23000100010051845310146
SV62CENR00000000000000700025 TL380080012345678910157 TN5910006035183598478831 TR330006100519786457841326
UA213223130000026007233566001 VA59001123000012345678 VG96VPVG0000012345678901 XK051212012345678906 YE15CBYE0001018861234567891234
""".split()


def spans(t, kind="iban"):
    return [t[s["start"]:s["end"]] for s in pii.scan_text(t) if s["kind"] == kind]


def test_ibans_of_every_country():
    assert {i[:2] for i in IBANS} == set(pii.IBAN_LENGTH)
    for iban in IBANS:
        printed = " ".join(iban[i:i + 4] for i in range(0, len(iban), 4))
        assert spans(f"to {iban}.") == [iban] and spans(f"to {printed} today") == [printed]
        wrong = iban[:2] + f"{(int(iban[2:4]) + 1) % 100:02d}" + iban[4:]
        assert spans(f"to {wrong}.") == []
    assert spans("ZZ12 3456 7890 1234 5678 90") == []


def test_ibans_one_after_the_other():
    de, gb = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    assert spans(f"{de} {gb}") == [de, gb] and spans(f"{gb} {de} {gb}") == [gb, de, gb]
    assert spans(f"AB12 {de}") == [de]                  # an unknown country
    assert spans(f"DE12 {gb}") == spans(f"DE12 3456 {gb}") == [gb]   # a known one that fails
    assert spans(f"{de} AND MORE {gb}") == [de, gb]
    assert spans(f"{de}{gb}") == spans(f"X{de}") == spans(f"{de}5") == spans(f"{de}é") == []
    every = " ".join(IBANS)
    assert spans(every) == spans(every.replace(" ", ", ")) == IBANS
    many = [de] * 20_000
    started = time.process_time()
    assert spans(" ".join(many)) == many and spans("AB12 DE89 " * 50_000) == []
    assert time.process_time() - started < 20


@pytest.mark.parametrize("find,out", [(secrets.find_secrets, "secrets"), (pii.find_pii, "pii")])
def test_odd_rows(odd, clashing, none, find, out):
    rows = find(odd).collect()
    assert len(rows) == odd.count()
    assert all(r[out] == [] for r in rows if not r.text)
    assert find(none).count() == 0
    clash = find(clashing)
    assert clash.count() == odd.count() and dict(clash.dtypes)["size"] == "string"
    assert pii.scan_text(LONG) == secrets.scan_text(None) == []


RSA = der(6, bytes.fromhex("2a864886f70d010101")) + der(5, b"")
PBES2 = der(6, bytes.fromhex("2a864886f70d01050d")) + der(0x30, der(0x30, der(6, b"\x2a\x86\x48")) + der(0x30, der(6, b"\x60\x86\x48")))
PBES1 = der(6, bytes.fromhex("2a864886f70d010503")) + der(0x30, der(4, b"saltsalt") + INT(2048))


def pkcs8(algorithm, inner):
    return der(0x30, INT(0) + der(0x30, algorithm) + der(4, inner))


def test_digests_and_made_up_frames_are_no_keys():
    digest_info = bytes.fromhex("3031300d060960864801650304020105000420") + bytes(range(32))
    for frame in (digest_info, pkcs8(RSA, bytes(range(1, 33))), pkcs8(RSA, SEC1),
                  pkcs8(der(6, bytes.fromhex("2b6570")), bytes(range(32))),
                  der(0x30, der(0x30, der(6, bytes.fromhex("2a864886f70d01050d"))) + der(4, b"x" * 64)),
                  der(0x30, der(0x30, PBES1) + der(4, b""))):
        assert secrets.der_key(frame) is None
        assert "der" not in kinds(f"hex {frame.hex()} end") + kinds(f"b64 {base64.b64encode(frame).decode()} end")


@pytest.mark.parametrize("key,name", [
    (pkcs8(RSA, PKCS1), "pkcs8"), (pkcs8(der(6, bytes.fromhex("2a8648ce3d0201")), SEC1), "pkcs8"),
    (pkcs8(der(6, bytes.fromhex("2b6570")), der(4, bytes(range(32)))), "pkcs8"),
    (pkcs8(der(6, bytes.fromhex("2a8648ce380401")), INT(3 ** 90)), "pkcs8"),
    (der(0x30, INT(0) + b"".join(INT(3 ** (400 + i)) for i in range(5))), "dsa"),
    (der(0x30, der(0x30, PBES2) + der(4, b"x" * 64)), "pkcs8-encrypted"),
    (der(0x30, der(0x30, PBES1) + der(4, b"x" * 64)), "pkcs8-encrypted")])
def test_keys_of_each_algorithm(key, name):
    assert secrets.der_key(key) == name
    assert "der" in kinds(f"hex {key.hex()} end") and "der" in kinds(f"b64 {base64.b64encode(key).decode()} end")


@pytest.mark.parametrize("head,body", [
    ("Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF", "QUJD"),
    ("Proc-Type: 4,ENCRYPTED", "QUJD" * 40), ("Proc-Type: 4,ENCRYPTED\nDEK-Info: ROT-13,0123456789ABCDEF", "QUJD" * 40),
    ("Proc-Type: 4,ENCRYPTED\nDEK-Info: DES-EDE3-CBC,0123456789", "QUJD" * 40),
    ("DEK-Info: DES-EDE3-CBC,0123456789ABCDEF", "QUJD" * 40)])
def test_encrypted_pem_needs_cipher_vector_and_blocks(head, body):
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{head}\n\n{body}\n-----END RSA PRIVATE KEY-----"
    assert "pem" not in kinds(pem)


def test_tokens_by_algorithm_and_layout():
    def details(t):
        return [s["detail"] for s in secrets.scan_text(t) if s["kind"] == "jwt"]
    for head in (b'{\n "alg":"HS256"}', b'{ "typ":"JWT", "alg":"HS256"}', b'\n{"alg":"HS256"}', b'\t{"alg":"HS256"}',
                 b' {"alg":"HS256"}', b'\r\n{"alg":"HS256"}', b'{"alg":"HS256"}'):
        assert details(f"Bearer {token(head, sign=bytes(32))}") == ["HS256"]
    assert details(token(b'{"alg":"HS256"}', sign=bytes(31))) == ["HS256 cut"]
    assert details(token(b'{"alg":"RS256"}', sign=bytes(256))) == ["RS256"]
    assert details(token(b'{"alg":"ES512"}', sign=bytes(132))) == ["ES512"]
    assert details(token(b'{"alg":"banana"}')) == details(token(b'{"alg":["HS256"]}')) == details(token(b'{"alg":"none"}')) == []


def test_context_decides_about_ibans():
    iban = "DE89 3704 0044 0532 0130 00"
    def score(t):
        return [s["score"] for s in pii.scan_text(t) if s["kind"] == "iban"]
    assert score(iban) == [0.8] and score(f"Konto {iban}") == [1.0]
    assert score(f"serial {iban}") == [] and score(f"serial, account {iban}") == [0.8]
    assert [s["kind"] for s in pii.scan_text("order 4111111111111111")] == ["card"]      # base kinds stay


def test_scores_stand_beside_spans(spark):
    rows = queries.op8_pii(spark, SF).collect()
    assert all(len(r.scores) == (len(r.spans.split(",")) if r.spans else 0) for r in rows)
    assert all(0.0 <= x <= 1.0 for r in rows for x in r.scores) and len({x for r in rows for x in r.scores}) > 2
