"""WARC archives and their chunked record table.

Archives are written by Spark's text writer with the record terminator as line separator, which gives
plain WARC files (gzip as a whole) on any file system Spark reaches. A payload beyond the chunk size
becomes a segmented record: the first segment and continuation records.

The reader streams an archive through a byte parser. Payloads come out as (record, chunk number)
rows with the digest so far, so that memory is bounded by the chunk size and the longest line, whatever a
record's size.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narae.llm.shared import scratch_path, tidy

CHUNK = 1 << 20
#: Payloads of fewer bytes are never deduplicated.
LEAST = 0
#: Places that copies of one page are dealt to while they look up their response.
SALTS = 8
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:narae:page:"
#: Stands for a page without id.
NO_PAGE = "urn:narae:none"
END = b"\r\n\r\n"
#: Names of archives that Spark reads whole, and of all others.
WHOLE, SPLIT = "*.gz", "{*[^z],*[^g]z,*[^.]gz,gz,z}"
#: Bytes of a header at most.
MOST_HEAD = 1 << 16
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: fifteen hex digits are twelve base-32 digits."""
    digits = [F.lpad(F.conv(F.substring(digest, at, 15), 16, 32), size, "0") for at, size in ((1, 12), (16, 12), (31, 8))]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


def assign_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that repeat the payload of a smaller page_id.

    Only identifiers and digests are shuffled, and copies are reduced to their smallest page_id
    before the shuffle; then copies of one page go to SALTS places. Pages without id follow any page
    with one; if none has one, all are responses.
    """
    digests = pages.select("page_id", "digest", "n").where(F.col("n") >= least)
    first = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies"))
    first = first.where("copies > 1 and refers_to is not null").select("digest", "refers_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    digests = digests.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    later = ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return digests.join(first, ["digest", "salt"]).where(later).select("page_id", "digest", "refers_to").distinct()


def write_warc(pages: DataFrame, path: str, least: int = LEAST, chunk: int = CHUNK) -> None:
    """One record a row of (page_id, url, html); a null html is an empty payload.

    Equal payloads of at least ``least`` bytes: the one with the smallest page_id is a response, the
    others are revisits, without payload but with its digest and length. Repeated rows of that
    page_id are responses too. A null url has no target line; line breaks in one are escaped.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    revisits = assign_revisits(rows, least)
    same = F.col("a.page_id").eqNullSafe(F.col("b.page_id")) & (F.col("a.digest") == F.col("b.digest"))
    rows = rows.alias("a").join(revisits.alias("b"), same, "left").select("a.*", "b.refers_to")

    # A payload becomes its chunks at once; what follows carries one chunk a row.
    last = F.greatest(F.ceil(F.col("n") / chunk).cast("int") - 1, F.lit(0))
    parts = F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(F.col("payload"), k * chunk + 1, F.lit(chunk)))
    parts = F.when(F.col("refers_to").isNull(), parts).otherwise(F.array(F.lit(b"")))
    rows = rows.select("page_id", "url", "n", "refers_to", base32_sha1(F.col("digest")).alias("digest"), last.alias("last"), F.posexplode(parts).alias("k", "part"))

    nl = "\r\n"
    name = lambda c, more="": F.coalesce(F.concat(F.lit(f"<{URN}"), F.url_encode(c.cast("string")), F.lit(more)), F.lit(f"<{NO_PAGE}{more}"))
    ident = F.concat(name(F.col("page_id")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{nl}Content-Type: text/html; charset=utf-8{nl}Content-Length: "), F.col("n").cast("string"), F.lit(nl * 2))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    target = F.coalesce(F.concat(F.lit("WARC-Target-URI: "), uri, F.lit(nl)), F.lit(""))
    common = F.concat(F.lit(f"WARC-Date: {DATE}{nl}"), target, F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(nl))
    http_type = F.lit(f"Content-Type: application/http; msgtype=response{nl}")
    body_type = lambda length: F.concat(F.lit("Content-Length: "), length.cast("string"), F.lit(nl * 2))
    first_length = F.octet_length(http) + F.octet_length("part")
    segment = F.when(F.col("last") > 0, F.lit(f"WARC-Segment-Number: 1{nl}")).otherwise(F.lit(""))
    response = F.concat(F.lit(f"WARC/1.1{nl}WARC-Type: response{nl}WARC-Record-ID: "), ident, F.lit(nl), common, segment, http_type, body_type(first_length), http)
    revisit = F.concat(
        F.lit(f"WARC/1.1{nl}WARC-Type: revisit{nl}WARC-Record-ID: "), ident, F.lit(nl), common, F.lit(f"WARC-Profile: {PROFILE}{nl}WARC-Refers-To: "), name(F.col("refers_to")),
        F.lit(f">{nl}"), http_type, body_type(F.octet_length(http)), http,
    )
    total = F.when(F.col("k") == F.col("last"), F.concat(F.lit("WARC-Segment-Total-Length: "), (F.octet_length(http) + F.col("n")).cast("string"), F.lit(nl))).otherwise(F.lit(""))
    more = F.concat(
        F.lit(f"WARC/1.1{nl}WARC-Type: continuation{nl}WARC-Record-ID: "), name(F.col("page_id"), "#"), (F.col("k") + 1).cast("string"),
        F.lit(f">{nl}WARC-Date: {DATE}{nl}WARC-Segment-Origin-ID: "), ident, F.lit(f"{nl}WARC-Segment-Number: "), (F.col("k") + 1).cast("string"), F.lit(nl), total, body_type(F.octet_length("part")),
    )
    value = F.when(F.col("refers_to").isNotNull(), revisit.cast("binary")).otherwise(
        F.concat(F.when(F.col("k") == 0, response).otherwise(more).cast("binary"), F.col("part"))
    )
    rows.select(value.cast("string").alias("value")).write.option("lineSep", END.decode()).option("compression", "gzip").text(path)


class Parser:
    """Bytes in, chunk rows out. Holds a header or less than a chunk at any time."""

    def __init__(self, chunk: int = CHUNK, keep_data: bool = True):
        self.chunk, self.keep_data = chunk, keep_data
        self.head = bytearray()
        self.left = self.trailer = 0
        self.rows: list[dict] = []
        self.record: dict | None = None

    def feed(self, data: bytes) -> None:
        view = memoryview(data)
        while len(view):
            if self.trailer:
                n = min(self.trailer, len(view))
                if bytes(view[:n]) != END[len(END) - self.trailer :][:n]:
                    raise ValueError("a record does not end with its terminator")
                self.trailer -= n
                view = view[n:]
            elif self.left:
                part = view[: self.left]
                self.left -= len(part)
                view = view[len(part) :]
                self._body(part)
                if not self.left:
                    self._end_block()
            else:
                seen = len(self.head)
                if not seen and view[0] in b"\r\n":  # blank lines between records
                    view = view[1:]
                    continue
                self.head += view[:MOST_HEAD]
                at = self.head.find(END, max(0, seen - 3))
                if at < 0:
                    if len(self.head) > MOST_HEAD:
                        raise ValueError("a WARC header without end")
                    view = view[MOST_HEAD:]
                    continue
                view = view[at + 4 - seen :]
                self._header(bytes(self.head[:at]))
                self.head.clear()

    def close(self) -> None:
        if self.head or self.left or self.trailer or self.record and not self.record["done"]:
            raise ValueError("the archive ends within a record")

    def _header(self, head: bytes) -> None:
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC header: {lines[0][:60]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        self.left = int(fields["content-length"])
        kind = fields["warc-type"]
        if kind == "continuation":
            if not self.record or self.record["id"] != _page(fields["warc-segment-origin-id"]):
                raise ValueError("a continuation without its record")
        else:
            declared = fields.get("warc-payload-digest", "")
            self.record = {
                "whole": "warc-segment-number" not in fields, "headed": "application/http" in fields.get("content-type", "") and kind in ("response", "revisit"),
                "id": _page(fields["warc-record-id"]), "type": kind, "refers": _page(fields["warc-refers-to"]) if "warc-refers-to" in fields else None,
                "declared": declared.removeprefix("sha1:") if declared.startswith("sha1:") else "", "http": bytearray(), "length": None, "sha1": hashlib.sha1(), "at": 0, "no": 0, "part": bytearray(), "done": False,
            }
        if not self.left:
            self._end_block()

    def _body(self, part: memoryview) -> None:
        """Takes in bytes of a block; ``left`` counts those that follow them."""
        r = self.record
        if r["length"] is None:
            if not r["headed"]:
                r["length"] = len(part) + self.left
            else:
                part = self._http(r, part)
        while len(part):
            some = part[: self.chunk - len(r["part"])]
            r["sha1"].update(some)
            r["part"] += some
            part = part[len(some) :]
            if len(r["part"]) == self.chunk and r["at"] + self.chunk < r["length"]:
                self._chunk(False)

    def _http(self, r: dict, part: memoryview) -> memoryview:
        """The payload's bytes in a part of a block that starts with an HTTP header."""
        seen = len(r["http"])
        r["http"] += part
        at = r["http"].find(END, max(0, seen - 3))
        if at < 0 and self.left and len(r["http"]) <= MOST_HEAD:
            return part[:0]
        if at < 0:  # there is none: all of the block is payload
            part = memoryview(bytes(r["http"]))
            r["length"] = len(part) + self.left
        else:
            lines = (line.partition(":") for line in r["http"][:at].decode("latin-1").split("\r\n")[1:])
            declared = {k.strip().lower(): v.strip() for k, _, v in lines}.get("content-length", "")
            part = part[at + 4 - seen :]
            alone = r["whole"] and r["type"] != "revisit"
            r["length"] = int(declared) if declared.isdigit() and not alone else len(part) + self.left
        r["http"] = bytearray()
        return part

    def _end_block(self) -> None:
        self.trailer = len(END)
        r = self.record
        if r["length"] is None:  # an empty block
            r["length"] = 0
        whole = r["at"] + len(r["part"]) == r["length"]
        if r["type"] == "revisit" or whole:
            self._chunk(True)
            r["done"] = True
            if whole and r["type"] != "revisit" and r["declared"] and self.rows[-1]["digest"] != r["declared"]:
                raise ValueError(f"record {r['id']}: its payload has another digest than declared")

    def _chunk(self, last: bool) -> None:
        r = self.record
        revisit = r["type"] == "revisit"
        self.rows.append({
            "record_id": r["id"], "record_type": r["type"], "refers_to": r["refers"], "chunk_no": r["no"], "byte_offset": r["at"], "byte_length": len(r["part"]), "data": bytes(r["part"]) if self.keep_data else None,
            "digest": r["declared"] if revisit else base64.b32encode(r["sha1"].digest()).decode(), "payload_bytes": r["length"], "last": last,
        })
        r["at"] += len(r["part"])
        r["no"] += 1
        r["part"] = bytearray()


def _page(urn: str) -> str | None:
    name = urn.strip("<>")
    return None if name == NO_PAGE else unquote_plus(name.removeprefix(URN))


CHUNKS = (
    "record_id string, record_type string, refers_to string, chunk_no int, byte_offset long, byte_length long, "
    "data binary, digest string, payload_bytes long, last boolean"
)
_KINDS = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.bool_()]


def read_warc(spark, path: str, chunk: int = CHUNK, keep_data: bool = True) -> DataFrame:
    """The chunked record table of the archives below ``path``.

    A row is a chunk: digest is that of the payload up to its end (of the whole payload in the last
    row, which is also checked against the declared one). A revisit is one row without data, with the
    digest and length of the payload it stands for. Damaged archives raise.

    Archives of others are read as well: blocks without an HTTP header are payload as a whole, and lengths
    and digests that are not declared are not checked. Spark holds one line (up to a line feed) at a time. Archives
    without gzip may be split by Spark: the lines of each go to one task, in order. Segments must follow their record
    in the same archive.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(chunk, keep_data)
        for batch in batches:
            parser.feed(b"\n".join(batch.column(0).to_pylist()) + b"\n")
            while parser.rows:
                yield _batch(parser, 16 if keep_data else 4096)
        parser.close()
        yield _batch(parser, len(parser.rows))

    # A line is what stands before a line feed, carriage returns included, and an archive ends with one: joined,
    # lines are its bytes. Whole-file gzip is never split, so a task sees each archive from its start, in order.
    # Spark splits any other file, so its lines are put in order first; sorting spills.
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true")
    value = F.col("value").cast("binary").alias("value")
    whole = lines.option("pathGlobFilter", WHOLE).text(path).select(value)
    split = lines.option("pathGlobFilter", SPLIT).text(path)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")]
    ordered = split.select(value, *place).repartition("file").sortWithinPartitions("file", "block", "line").select("value")
    return whole.mapInArrow(tidy(rows), CHUNKS).unionByName(ordered.mapInArrow(tidy(rows), CHUNKS))


def _batch(parser: Parser, most: int) -> pa.RecordBatch:
    out, parser.rows = parser.rows[:most], parser.rows[most:]
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], k) for n, k in zip(names, _KINDS)], names=names)


def warc_digest(pages: DataFrame, least: int = LEAST, chunk: int = CHUNK) -> DataFrame:
    """Writes ``pages`` as archives in the shared folder, reads them back: one row a record.

    No pages give no rows.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path, least, chunk)
    kind = pages.schema["page_id"].dataType
    done = read_warc(spark, path, chunk, keep_data=False).where("last")
    return done.select(F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
