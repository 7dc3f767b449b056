"""WARC archives: writing, reading, and deduplication by revisit records.

Archives are gzipped files of WARC/1.1 records that Spark's text writer lays down (each record ends with two empty
lines, the writer's separator), so the usual commit of a task makes them whole. Reading streams a file's text in one task
and cuts records by their Content-Length alone, so payloads may hold anything, the marks of a record too.

Revisit resolution: headers, not payloads, are shuffled by payload digest; each digest's original is chosen, and archives
are written anew, in which all other records of it are revisit records with fresh headers that refer to it.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, discard, reachable, shared_folder, table, text_of, written

# Fixed values of the format.
CRLF = "\r\n"
END = CRLF + CRLF
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Opens each record, up to the minor version's number.
OPENING = "WARC/1."
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "

#: What read_archives gives.
RECORD = (
    "file string, place long, record_id string, record_type string, target_uri string, record_date string, payload_digest string, "
    "refers_to string, item string, length long, payload_bytes long, intact boolean, payload binary"
)
_NAMES = tuple(f.split()[0] for f in RECORD.split(", "))
_ARROW = pa.schema(
    [
        (name, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[kind])
        for name, kind in (f.split() for f in RECORD.split(", "))
    ]
)


def _line(name: str, value: Column | str) -> Column:
    """A header line; nothing where the value is null. Line breaks in values are percent-encoded."""
    value = F.lit(value) if isinstance(value, str) else value.cast("string")
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(CRLF)), F.lit(""))


def _record(kind: str, record_id: Column, date: Column, uri: Column, digest: Column, item: Column, payload_bytes: Column, payload: Column, refers: dict[str, Column]) -> Column:
    """A record without its ending empty lines. payload: the bytes to write, as a string; payload_bytes: those of the full one."""
    http = F.concat(F.lit(HTTP), payload_bytes.cast("string"), F.lit(END))
    length = F.octet_length(http) + F.octet_length(payload)
    more = [_line("WARC-Profile", PROFILE), *[_line(k, v) for k, v in refers.items()]] if kind == "revisit" else []
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", record_id),
        _line("WARC-Date", date),
        _line("WARC-Target-URI", uri),
        _line("WARC-Payload-Digest", digest),
        *more,
        _line("X-Item", item),
        _line("Content-Type", "application/http; msgtype=response"),
        _line("Content-Length", length),
        F.lit(CRLF),
        http,
        payload,
    )


def _laid_down(records: DataFrame, folder: str) -> None:
    """records: one column, a record a row. Files that are there stay; the folder must not exist."""
    records.write.option("lineSep", END).option("compression", "gzip").text(folder)


def _now() -> str:
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str | None = None) -> None:
    """Writes a response record for each row of pages to folder, in UTF-8, with the row's id in the field X-Item.

    Null payloads count as empty; null ids and urls have no header; line breaks in urls are percent-encoded. Rows that repeat get records of
    their own. A very long payload is one row of one task. Without rows the folder has no record. Other columns are not read.
    """
    text = text_of(pages, payload_col)
    place = F.md5(F.concat_ws(":", F.lit(uuid.uuid4().hex), F.monotonically_increasing_id().cast("string")))
    rows = pages.select(place.alias("place"), text.alias("payload"), F.sha1(text.cast("binary")).alias("sha"), pages[url_col].alias("uri"), pages[id_col].alias("item"))
    groups = [F.substring("place", at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    ident = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *groups), F.lit(">"))
    size = F.octet_length("payload")
    record = _record("response", ident, F.lit(date or _now()), F.col("uri"), F.concat(F.lit("sha1:"), "sha"), F.col("item"), size, F.col("payload"), {})
    _laid_down(rows.select(record.alias("value")), folder)


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out.setdefault(name.strip().lower().decode("utf-8", "replace"), value.strip().decode("utf-8", "replace"))
    return out


def _cut(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, int, dict[str, str], bytes, bool]]:
    """(file, place in it, header fields, block, whether the block is whole) of each record.

    pieces: (file, text between two openings), in a file's order. A record ends where its Content-Length says, so
    openings inside a block are put back.
    """
    name, place, parts, have, need, head, fields = None, 0, [], 0, 0, 0, {}

    def done() -> tuple[str, int, dict[str, str], bytes, bool]:
        whole = b"".join(parts)
        return name, place, fields, whole[head : head + need], len(whole) >= head + need

    for file, piece in pieces:
        if file != name:
            if parts:
                yield done()
            name, place, parts = file, -1, []
        elif parts and have < head + need:
            parts += [OPENING.encode(), piece]
            have += len(OPENING) + len(piece)
            continue
        elif parts:
            yield done()
            parts = []
        at = piece.find(END.encode())
        if at < 0:
            continue  # what comes before a file's first record, and headers that never end
        place, parts, have, head, fields = place + 1, [piece], len(piece), at + len(END), _fields(piece[:at])
        size = fields.get("content-length", "")
        need = int(size) if size.isascii() and size.isdigit() else 0
    if parts:
        yield done()


def _entry(file: str, place: int, fields: dict[str, str], block: bytes, whole: bool, payloads: bool) -> tuple:
    at = block.find(END.encode()) if "application/http" in fields.get("content-type", "") else -len(END)
    payload = block[at + len(END) :] if at != -1 else b""
    kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    own = hashlib.sha1(payload).hexdigest()
    if kind == "revisit":
        intact = whole
    else:
        intact, digest = whole and digest in (None, own), own
    ident = lambda key: fields.get(key, "").strip("<>") or None
    return (
        file, place, ident("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-date"), digest, ident("warc-refers-to"),
        fields.get("x-item"), len(block), len(payload), intact, payload if payloads else None,
    )


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record of the gzipped archives in folder (columns of RECORD); payload is null unless asked for.

    payload_digest: lowercase hex SHA-1 of the payload that is there; of a revisit, what its header says. intact: the block is as long as its header
    says and the payload has the header's digest. place: the record's number in its file.

    A file is read by one task, in a stream of which it holds one record at a time: a very long payload is held once whole. Empty
    folders give no rows. Records cut short are not intact.
    """
    reachable(spark)
    text = spark.read.option("lineSep", OPENING).text(folder)
    pieces = text.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat() -> Iterator[tuple[str, bytes]]:
            for batch in batches:
                files, values = batch.column(0), batch.column(1)
                for i in range(batch.num_rows):
                    yield files[i].as_py(), values[i].as_py() or b""

        rows, held = [], 0
        for record in _cut(flat()):
            rows.append(_entry(*record, payloads))
            held += 256 + (len(record[3]) if payloads else 0)
            if held > BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    return pieces.mapInArrow(cut, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


def dedup_archives(spark: SparkSession, source: str, target: str, least_bytes: int = 1000, order: Column | None = None, date: str | None = None) -> None:
    """Writes the records of the archives in source to target, with one full response for each payload of least_bytes or more.

    Of responses with equal payloads that of the largest order stays (null last; ties: the largest record id), by default of the
    latest date; the others, and revisits of that payload, become revisits that refer to it, whatever they referred to. Revisits whose payload isn't in source keep what they refer to. Smaller
    payloads stay responses. Records of other types, and those not intact, are left out. Headers are written anew, with `date`.

    Headers alone are shuffled by digest, pre-aggregated, so a payload that a third of all records hold is one
    row a task. The originals then meet the records: while they are few (Spark's own limit for broadcasts) payloads stay where they
    are; beyond, records are joined by digest, and adaptive execution splits a digest that many hold.
    """
    rank = F.col("record_date") if order is None else order
    heads = written(read_archives(spark, source, payloads=False).filter("intact and record_type in ('response', 'revisit')"))
    real = (F.col("record_type") == "response") & (F.col("payload_bytes") >= least_bytes)
    first = F.max(F.when(real, F.struct(rank.isNotNull().alias("some"), rank.alias("rank"), "record_id", "target_uri", "record_date"))).alias("first")
    originals = written(
        heads.filter("payload_digest is not null").groupBy("payload_digest").agg(first, F.count(F.lit(1)).alias("records")).filter("records > 1 and first is not null")
        .select("payload_digest", F.col("first.record_id").alias("to_id"), F.col("first.target_uri").alias("to_uri"), F.col("first.record_date").alias("to_date"))
    )
    full = read_archives(spark, source).filter("intact and record_type in ('response', 'revisit')").join(originals, "payload_digest", "left")
    again = (F.col("record_type") == "revisit") | (F.col("to_id").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("to_id")))
    bracket = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    refers = {
        "WARC-Refers-To": bracket(F.coalesce("to_id", "refers_to")),
        "WARC-Refers-To-Target-URI": F.col("to_uri"),
        "WARC-Refers-To-Date": F.col("to_date"),
    }
    common = (bracket(F.col("record_id")), F.lit(date or _now()), F.col("target_uri"), F.concat(F.lit("sha1:"), "payload_digest"), F.col("item"), F.col("payload_bytes"))
    response = _record("response", *common, F.coalesce(F.col("payload").cast("string"), F.lit("")), {})
    revisit = _record("revisit", *common, F.lit(""), refers)
    _laid_down(full.select(F.when(again, revisit).otherwise(response).alias("value")), target)
    discard(heads, originals)


def resolved(records: DataFrame) -> DataFrame:
    """records (of read_archives) with those of revisits resolved: full_bytes, the bytes of the full payload, and to_item, the original's item.

    For other records full_bytes is that of their own and to_item null; for revisits whose original isn't there both are null.
    Record ids must differ; a revisit of a missing record keeps its row.
    """
    revisit = F.col("record_type") == "revisit"
    originals = records.filter(~revisit).select(F.col("record_id").alias("refers_to"), F.col("payload_bytes").alias("to_bytes"), F.col("item").alias("to_item"))
    found = records.filter(revisit).join(originals, "refers_to", "left").withColumn("full_bytes", F.col("to_bytes")).drop("to_bytes")
    own = records.filter(~revisit).withColumns({"full_bytes": F.col("payload_bytes"), "to_item": F.lit(None).cast("string")})
    return own.unionByName(found)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, deduped = (f"{shared_folder(spark)}/{uuid.uuid4().hex}" for _ in range(2))
    write_archives(table(spark, sf_dir, "pages"), raw)
    dedup_archives(spark, raw, deduped, order=F.col("item").cast("long"))
    heads = written(read_archives(spark, deduped, payloads=False).drop("payload"))
    return resolved(heads).select(
        F.col("item").cast("long").alias("page_id"),
        F.col("full_bytes").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.col("to_item").cast("long").alias("refers_to"),
    )


SQL = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
q as (select *, max(page_id) over (partition by payload_digest) as last from p)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and page_id <> last then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id <> last then last end as refers_to
from q
"""
