"""WARC archives: one gzip member per record, written by Spark and read back sequentially.

Writing goes through Spark's text sink, which can reach any store that the
cluster can: a line is a record's gzip member without its last byte, and the
line separator is that byte. The last byte of a member is the high byte of the
uncompressed length, zero below 16 MiB; a longer record keeps its last byte and
the separator is then zero padding after the member, which gzip readers skip.

Archives are bounded: records are dealt to as many files as their payloads need
at ``ARCHIVE_BYTES`` each. Spark reads a file as one binary row, which limits
archives from elsewhere to 2 GB each; from there on a file moves in chunks. The
reader takes one chunk after the other, inflates a member at a time, takes the
block by its Content-Length, and verifies the payload digest. A revisit has no
payload of its own: what it says of its payload is held against the record that
it refers to, by a join on record ids.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.shared import Scratch, beside, table

MIN_REVISIT_BYTES = 1000
RECORDS = "record_id string, record_type string, target_uri string, refers_to string, content_length long, payload_bytes long, payload_digest string, verified boolean, payload binary"
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def member(record_type: str, record_id: str, uri: str, payload: bytes, digest_hex: str, length: int, refers_to: str | None, date: str | None = None) -> bytes:
    """A record as a gzip member; a revisit has no payload of its own but its digest and length. ``date``: that of writing unless given."""
    block = b"" if record_type == "revisit" else payload
    digest = base64.b32encode(bytes.fromhex(digest_hex)).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {date or datetime.now(UTC).strftime('%Y-%m-%dT%H:%M:%SZ')}",
        f"WARC-Target-URI: {''.join(c for c in uri if c >= ' ')}",
        "Content-Type: text/html",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
    ]
    if record_type == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{refers_to}>", f"WARC-Refers-To-Payload-Length: {length}"]
    head.append(f"Content-Length: {len(block)}")
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def headers_of(head: bytes) -> dict[str, str]:
    """Header values by lower-cased name, whatever the space after the colon; a line that begins with space goes on with the one before."""
    version, *lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("a member does not start with a WARC version")
    found: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            found[name] += f" {line.strip()}"
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
    if not found.get("content-length", "").isdigit():
        raise ValueError("a record does not state its length")
    return found


def _sha1(stated: str | None) -> str | None:
    """A stated SHA-1 as hexadecimal digits, be it in these or in base 32; null of other digests."""
    kind, _, value = (stated or "").partition(":")
    if kind.lower().replace("-", "") != "sha1":
        return None
    try:
        return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()
    except ValueError:
        return None


def record_of(headers: dict[str, str], block: bytes) -> tuple:
    """A row of ``RECORDS``: the payload is the block, of an HTTP message what follows its head."""
    inside = lambda name: (headers.get(name) or "").strip().removeprefix("<").removesuffix(">") or None
    kind, http = headers.get("warc-type", ""), headers.get("content-type", "").lower().startswith("application/http")
    payload = block.partition(b"\r\n\r\n")[2] if http else block
    stated = _sha1(headers.get("warc-payload-digest"))
    length, verified = len(payload), None
    if kind == "revisit":
        told = headers.get("warc-refers-to-payload-length", "")
        length = int(told) if told.isdigit() else None
    elif stated is not None:
        verified = hashlib.sha1(payload).hexdigest() == stated
    elif (whole := _sha1(headers.get("warc-block-digest"))) is not None:
        verified = hashlib.sha1(block).hexdigest() == whole
    return inside("warc-record-id"), kind, headers.get("warc-target-uri"), inside("warc-refers-to"), len(block), length, stated, verified, payload


def read_records(chunks: Iterator[bytes], step: int = 1 << 16) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-cased name, block) of each record of an archive that comes in chunks.

    No more is inflated at once than ``step`` bytes of input give. The block is
    framed by Content-Length; a truncated or overlong record raises ValueError.
    """
    pending = b""
    source = iter(chunks)

    def refill() -> bool:
        nonlocal pending
        while not (pending := pending.lstrip(b"\0")):
            if (chunk := next(source, None)) is None:
                return False
            pending = chunk
        return True

    while refill():
        inflate, data, headers, start, length = zlib.decompressobj(31), bytearray(), None, 0, 0
        while not inflate.eof:
            if not pending:
                pending = next(source, b"")
                if not pending:
                    raise ValueError("the archive ends within a member")
            data += inflate.decompress(pending[:step])
            pending = inflate.unused_data + pending[step:] if inflate.eof else pending[step:]
            if headers is None and (end := data.find(b"\r\n\r\n")) >= 0:
                headers = headers_of(bytes(data[:end]))
                start, length = end + 4, int(headers["content-length"])
        if headers is None or len(data) != start + length + 4 or data[start + length :] != b"\r\n\r\n":
            raise ValueError("a record does not have the length it states")
        yield headers, bytes(data[start : start + length])


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes a record per row of ``pages`` (page_id, url, html) to archives of about ``archive_bytes`` of payload.

    Of records with equal payloads of at least ``min_revisit_bytes`` the one
    with the largest page_id is the response, the others revisit it; rows that
    repeat that page_id are responses too. A null html is empty, a null url is
    an empty URI. A null page_id revisits a page with an id, where there is one.
    Records are named after their page_id. Extra columns are ignored, whatever
    their names; an empty table gives archives without records.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("length"), F.monotonically_increasing_id().alias("place"))
    repeated = (
        rows.where(F.col("length") >= min_revisit_bytes)
        .groupBy("digest", "length")
        .agg(F.count("*").alias("n"), F.max("page_id").alias("first_id"))
        .where("n > 1 and first_id is not null")
        .select("digest", "length", "first_id")
    )
    repeated = Scratch(pages.sparkSession, "warc").save(repeated, "repeated")
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")  # one for all tasks and their repetitions
    told = rows.join(beside(repeated), ["digest", "length"], "left").withColumn("revisit", F.coalesce(~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull(), F.lit(False)))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, url, text, digest, length, first, revisit in zip(batch["page_id"], batch["url"], batch["html"], batch["digest"], batch["length"], batch["first_id"], batch["revisit"]):
                name = lambda x: f"urn:page:{x}"
                own = name(page) if page is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, url + digest)}"
                data = member("revisit" if revisit else "response", own, url, (text or "").encode("utf-8", "surrogatepass"), digest, length, name(first) if revisit else None, date)
                out.append(data[:-1] if data[-1] == 0 else data)
            yield pd.DataFrame({"value": out})

    payload = F.when(~F.col("revisit"), F.col("html"))
    told = told.select(F.col("page_id").cast("string").alias("page_id"), "url", payload.alias("html"), "digest", "length", F.col("first_id").cast("string").alias("first_id"), "revisit", "place")
    size = told.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    told = told.repartition(max(1, -(-size // archive_bytes)), F.xxhash64("place"))  # pages that repeat spread too
    told.mapInPandas(encode, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\0").mode("overwrite").text(folder)


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False, chunk: int = CHUNK) -> DataFrame:
    """A row per record of the archives in ``folder``, its payload digest verified; for revisits that is left open (null), see ``resolve``.

    Archives from elsewhere are read too: records of any type (warcinfo, request,
    metadata and others), payloads of HTTP messages without their head. Where a
    record states no SHA-1 of its payload, that of its block is verified; where it
    states none, ``verified`` is null, as is a revisit's length that is not
    stated, and what other headers leave out. Payloads are empty bytes where a record has none. Empty files have no
    records; a damaged archive raises ValueError.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        pieces = ((path, bytes(piece)) for batch in batches for path, piece in zip(batch["path"], batch["piece"]))
        rows, size = [], 0
        for _, own in itertools.groupby(pieces, key=lambda x: x[0]):
            for headers, block in read_records(piece for _, piece in own):
                row = record_of(headers, block)
                rows.append(row if with_payload else (*row[:-1], None))
                size += len(block) if with_payload else 200
                if size > 1 << 23:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").load(folder).where("length > 0")
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / chunk)))
    pieces = files.select("path", "content", steps.alias("k")).select("path", F.substring("content", (F.col("k") * chunk + 1).cast("int"), F.lit(chunk)).alias("piece"))
    return pieces.mapInPandas(decode, RECORDS)


def resolve(records: DataFrame) -> DataFrame:
    """``records`` with ``verified`` also for revisits: whether the record that they refer to is there and has the payload that they state."""
    targets = records.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes")).agg(F.bool_and("verified").alias("_whole"))
    # a target that many revisit may be told twice where rows repeat; one agreeing is enough
    told = records.where("record_type = 'revisit'").select("refers_to", "payload_digest", "payload_bytes").distinct().join(targets, "refers_to")
    fits = (F.col("_digest") == F.col("payload_digest")) & (F.col("_bytes") == F.coalesce("payload_bytes", "_bytes")) & F.col("_whole")
    length = F.coalesce("payload_bytes", F.lit(-1))  # not every writer states it
    kept = told.where(fits).select("refers_to", "payload_digest", length.alias("_length")).distinct().withColumn("_fits", F.lit(True))
    out = records.withColumn("_length", length).join(kept, ["refers_to", "payload_digest", "_length"], "left")
    return out.withColumn("verified", F.when(F.col("record_type") == "revisit", F.coalesce("_fits", F.lit(False))).otherwise(F.col("verified"))).select(records.columns)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    folder = f"{scratch.path}/archives"
    write_archives(table(spark, sf_dir, "pages"), folder)
    page = lambda c: F.regexp_extract(c, "^urn:page:(.*)$", 1).try_cast("long")
    records = resolve(scratch.save(read_archives(spark, folder).drop("payload"), "records"))
    scratch.drop("archives")
    checked = F.when(F.col("verified"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload does not have its digest")))
    return records.select(page("record_id").alias("page_id"), "payload_bytes", checked.alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))


SQL = f"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} AND first_id <> page_id THEN first_id END AS refers_to
FROM g
"""

QUERIES = {"op8_warc": op8_warc}
ORACLES = {"op8_warc": SQL}
