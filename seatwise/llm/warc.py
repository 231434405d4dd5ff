"""Legacy archive converter: ARC files to WARC files.

``write_arc`` stores pages as ARC archives (version 1: five fields in a record's header
line; version 2: ten), each part opened by its version block.  ``read_arc`` parses them:
the version block names the fields of the header lines, and each record's declared length
says where it ends.  ``to_warc`` synthesises equivalent WARC records: ids, timestamps,
types, digests; a payload of at least ``MIN_REVISIT`` bytes that occurs again is stored
once (response) and referred to by the others (revisit).  ``write_warc`` and ``read_warc``
store and read these; a warcinfo record opens each file.

Archives are folders of gzip part files, written by Spark and split by record count, so
a part stays small and is read by one task; plain files are read as well.  The query's
archive has parts of both versions in turn.  A record's id is derived from its place in the
ARC archive, so a retried task gives it the same id.

Defined results: a null html is an empty payload; a null url is written as ``-``;
spaces and line breaks in urls are percent-encoded (header lines are space-separated).
Pages with equal ids are separate records.  Of equal payloads the largest page id is the
response (of equal ids, one of them); a null id is the smallest.  An empty table gives
empty archives.  A damaged archive (a header line with a wrong number of fields, a length
beyond the file) is an error that names the place.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..session import scratch_path
from .common import cut, free_name, remove

MIN_REVISIT = 1000             # bytes from which on equal payloads become revisits
RECORDS_PER_FILE = 4000        # an archive part holds at most so many records
IP = "0.0.0.0"                 # the crawl's addresses are not known
DATE = "20000101000000"        # nor are its times, unless a column gives them
SOFTWARE = "seatwise archive converter"
_ID_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")   # fixed value: the URL namespace

# fixed values: the fields that the two versions of the format declare
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_PAGE = "X-Page-Id"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


# ---- ARC -------------------------------------------------------------------------

def _placed(df: DataFrame, records_per_file: int) -> tuple[DataFrame, Column, Column]:
    """``df`` as the text writer will store it: whether a row opens a file, and a number
    that is one higher in the task's next file and in the next task.  Rows reach the writer
    in the task's order, and it starts a file every ``records_per_file`` of them."""
    row, = free_name(df, "row")
    at = F.col(row).bitwiseAND((1 << 33) - 1)          # the place within the task
    return (df.withColumn(row, F.monotonically_increasing_id()), at % records_per_file == 0,
            F.shiftright(row, 33) + F.floor(at / records_per_file))


def write_arc(pages: DataFrame, path: str, version: int | None = 1, page_id: str = "page_id", url: str = "url",
              html: str = "html", date: str | None = None, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write pages as ARC archive parts below ``path``.  A record's content is an HTTP
    response: headers (with the page id) and the html in UTF-8.  Records are separated by
    a line break, as the format has it.  Every part is opened by its version block; without
    a ``version``, parts have the two versions in turn."""
    pages, opens, part = _placed(pages, records_per_file)
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    has_id = F.col(page_id).isNotNull()
    content = F.concat(F.lit(_HTTP), F.when(has_id, F.concat(F.lit(f"{_PAGE}: "), F.col(page_id), F.lit("\r\n")))
                       .otherwise(F.lit("")), F.lit("\r\n"), body)
    link = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("-")), r"\r|\n", "%0A"), r"\s", "%20")
    fields = [F.when(F.length(link) == 0, F.lit("-")).otherwise(link), F.lit(IP),
              F.coalesce(F.col(date).cast("string"), F.lit(DATE)) if date else F.lit(DATE), F.lit("text/html")]
    more = [F.lit("200"), F.md5(F.encode(body, "UTF-8")), F.lit("-"), F.lit("0"), F.lit("pages.arc")]
    second = part % 2 == 1 if version is None else F.lit(version == 2)
    # a null is left out
    head = F.concat_ws(" ", *fields, F.when(second, F.concat_ws(" ", *more)), F.octet_length(content).cast("string"))
    block = F.when(second, arc_version_block(2) + "\n").otherwise(arc_version_block(1) + "\n")
    (pages.select(F.concat(F.when(opens, block).otherwise(""), head, F.lit("\n"), content).alias("value"))
     .write.option("lineSep", "\n").option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path))


def arc_version_block(version: int) -> str:
    """The block that opens an ARC file of a version."""
    about = f"{version} 0 seatwise\n{ARC_FIELDS[version]}\n"
    kind = "text/plain" if version == 1 else "text/plain 200 - - 0 pages.arc"
    return f"filedesc://pages.arc {IP} {DATE} {kind} {len(about)}\n{about}"


def arc_records(data: bytes, name: str, version: int | None = None) -> Iterator[tuple[int, dict, bytes]]:
    """(offset, header fields, content) of each record of one ARC file.  The version block, where
    the file has one, declares the fields; parts without one have those of ``version``."""
    fields = ARC_FIELDS[version].split() if version else None
    at = 0
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        stop = data.find(b"\n", at)
        line = data[at:stop if stop >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r").split(" ")
        block = line[0].startswith("filedesc:")
        if stop < 0 or not line[-1].isdigit() or not block and (fields is None or len(line) != len(fields)):
            raise ValueError(f"{name}: no record header at byte {at}")
        end = stop + 1 + int(line[-1])
        if end > len(data):
            raise ValueError(f"{name}: the record at byte {at} is cut off")
        content = data[stop + 1:end]
        if block:
            declared = content.decode("utf-8", "replace").split("\n")
            number = declared[0].split(" ")[0]
            fields = declared[1].split() if len(declared) > 1 and declared[1].strip() else \
                ARC_FIELDS.get(int(number) if number.isdigit() else 0)
            if not fields:
                raise ValueError(f"{name}: unknown ARC version {number!r}")
        else:
            yield at, dict(zip(fields, line)), content
        at = end


_RECORD = pa.schema([("record_id", pa.string()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("page_id", pa.int64()),
                     ("http", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                     ("payload_digest", pa.string()), ("digest32", pa.string())])


def _plain(data: bytes) -> bytes:
    """A file's bytes, unpacked if they are gzip."""
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 500) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _split_http(content: bytes) -> tuple[str, bytes]:
    head, _, payload = content.partition(b"\r\n\r\n")
    return head.decode("utf-8", "replace"), payload


def _page_of(http: str) -> int | None:
    m = re.search(rf"^{_PAGE}: (-?\d+)\r?$", http, re.M)
    return int(m[1]) if m else None


def read_arc(spark: SparkSession, path: str, version: int | None = None, payloads: bool = True) -> DataFrame:
    """The records of the ARC files below ``path``: record_id, url, ip, date, page_id, http
    (the headers), payload (null unless asked for), payload_bytes, payload_digest
    (lower-case hex SHA-1) and digest32 (the same as WARC writes it)."""
    def parse(batches):
        def rows():
            for b in batches:
                for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                    base = name.rsplit("/", 1)[-1]
                    for at, head, content in arc_records(_plain(data.as_py()), name, version):
                        http, payload = _split_http(content)
                        sha = hashlib.sha1(payload)
                        yield (f"urn:uuid:{uuid.uuid5(_ID_SPACE, f'{base} {at}')}", head["URL"], head["IP-address"],
                               head["Archive-date"], _page_of(http), http, payload if payloads else None,
                               len(payload), sha.hexdigest(), base64.b32encode(sha.digest()).decode())
        return _batches(rows(), _RECORD)
    return _files(spark, path).mapInArrow(parse, from_arrow_schema(_RECORD))


# ---- WARC ------------------------------------------------------------------------

def to_warc(records: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """The same records with ``record_type`` (response or revisit) and ``refers_to_id``,
    the record id of the response that a revisit repeats.  ``digests`` may be the same
    records read without payloads, to count equal ones from."""
    # one row per payload that occurs again: aggregated before anything is joined
    stored = ((records if digests is None else digests).filter(F.col("payload_bytes") >= MIN_REVISIT)
              .groupBy("payload_digest", "payload_bytes")
              .agg(F.max(F.struct("page_id", "record_id")).alias("of"), F.count("*").alias("n")).filter("n > 1")
              .select("payload_digest", "payload_bytes", F.col("of")["record_id"].alias("of_id")))
    r = records.join(stored, ["payload_digest", "payload_bytes"], "left")
    again = F.col("of_id").isNotNull() & (F.col("record_id") != F.col("of_id"))
    return (r.withColumn("record_type", F.when(again, "revisit").otherwise("response"))
            .withColumn("refers_to_id", F.when(again, F.col("of_id"))).drop("of_id"))


def _warcinfo() -> Column:
    """A warcinfo record that opens a WARC file, with the two line breaks that end it.  Its id
    is made from that of the file's first record."""
    about = f"software: {SOFTWARE}\r\nformat: WARC File Format 1.1\r\n"
    name = F.regexp_replace(F.md5(F.concat(F.lit("warcinfo "), "record_id")),
                            "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-3$3-a$4-$5")
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:"), name,
                    F.lit(f">\r\nWARC-Date: {datetime.now(timezone.utc):%Y-%m-%dT%H:%M:%SZ}\r\n"
                          f"Content-Type: application/warc-fields\r\nContent-Length: {len(about)}\r\n\r\n{about}\r\n\r\n"))


def write_warc(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write ``to_warc`` records as WARC/1.1 files below ``path``, each opened by a warcinfo
    record.  Two line breaks end a record, which is Spark's line separator here."""
    records, opens, _ = _placed(records, records_per_file)
    when = F.concat(*[x for a, n, sep in ((1, 4, "-"), (5, 2, "-"), (7, 2, "T"), (9, 2, ":"), (11, 2, ":"), (13, 2, "Z"))
                      for x in (F.substring("date", a, n), F.lit(sep))])
    revisit = F.col("record_type") == "revisit"
    block = F.concat("http", F.lit("\r\n\r\n"), F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string")))
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: <"), "record_id", F.lit(">")), F.concat(F.lit("WARC-Date: "), when),
        F.concat(F.lit("WARC-Target-URI: "), "url"), F.concat(F.lit("WARC-IP-Address: "), "ip"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest32"),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <"), "refers_to_id", F.lit(">\r\nWARC-Profile: "
                                 "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")))
    (records.withColumn("block", block)
     .select(F.concat(F.when(opens, _warcinfo()).otherwise(""), head, F.lit("\r\n\r\n"), "block").alias("value"))
     .write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path))


def warc_records(data: bytes, name: str) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of each record of one WARC file."""
    at = 0
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"{name}: no WARC record at byte {at}")
        head = dict(x.split(": ", 1) for x in data[at:stop].decode("utf-8", "replace").split("\r\n")[1:])
        end = stop + 4 + int(head["Content-Length"])
        if data[end:end + 4] != b"\r\n\r\n":
            raise ValueError(f"{name}: the record at byte {at} does not end where its length says")
        yield head, data[stop + 4:end]
        at = end + 4


_READ = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()),
                   ("date", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()),
                   ("payload_digest", pa.string()), ("refers_to_id", pa.string())])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files below ``path``, but the warcinfo ones: a response's
    payload is measured and digested anew and must have the digest its header states; of a
    revisit, the digest is the stated one and ``payload_bytes`` is null (its payload is
    elsewhere)."""
    def parse(batches):
        def rows():
            for b in batches:
                for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                    for head, block in warc_records(_plain(data.as_py()), name):
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        http, payload = _split_http(block)
                        revisit = head["WARC-Type"] == "revisit"
                        stated = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        if not revisit and hashlib.sha1(payload).hexdigest() != stated:
                            raise ValueError(f"{name}: {head['WARC-Record-ID']} has another digest than stated")
                        yield (head["WARC-Record-ID"].strip("<>"), head["WARC-Type"], head["WARC-Target-URI"],
                               head["WARC-Date"], _page_of(http), None if revisit else len(payload), stated,
                               head.get("WARC-Refers-To", "").strip("<>") or None)
        return _batches(rows(), _READ)
    return _files(spark, path).mapInArrow(parse, from_arrow_schema(_READ))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``read_warc`` records with ``refers_to`` (the page id of the response a revisit
    names) and the payload size taken from there."""
    named = records.filter("refers_to_id is not null").select(F.col("refers_to_id").alias("record_id")).distinct()
    target = (records.filter("record_type = 'response'").join(named, "record_id", "left_semi").groupBy(F.col("record_id").alias("refers_to_id"))
              .agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("of_bytes")))
    return (records.join(target, "refers_to_id", "left")
            .withColumn("payload_bytes", F.coalesce("payload_bytes", "of_bytes")).drop("of_bytes"))


def archive_round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages written as ARC (parts of both versions in turn), converted to WARC, read back:
    one row per page.  The archives are below ``spark.checkpoint.dir`` and are removed once
    they have been read."""
    spark = pages.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arc, None, page_id=page_id, url=url, html=html)
    write_warc(to_warc(read_arc(spark, arc), read_arc(spark, arc, payloads=False)), warc)
    records = cut(read_warc(spark, warc))
    remove(spark, arc, warc)
    return resolve_revisits(records)
