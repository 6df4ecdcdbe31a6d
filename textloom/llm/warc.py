"""WARC archives with an index first: offset, length, URL and digest per record, then coalesced range reads.

write_archives() leaves gzip members, one a record, in a folder that every executor can reach, and a Parquet
index of them. read_records() takes any selection of index rows, sorts it by archive and offset, merges
neighbouring byte ranges and reads each merged range at once.

Deduplication: of records with equal payloads of at least min_bytes, the one with the smallest page_id is the
response and the others revisit it. Cases: a null html is an empty payload; a null url leaves out the target
URI; a null page_id never is the one referred to; rows that tie for the smallest page_id are all responses;
extra columns are ignored; an empty table gives an empty index. Archives of failed tasks are never in the index.
"""

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import HOT, written

MIN_BYTES = 100
#: An archive is closed once it has so many bytes.
ARCHIVE_BYTES = 1 << 30
#: Ranges are merged over at most so many unread bytes, and within windows of so many bytes.
MAX_GAP, MAX_RANGE = 1 << 16, 1 << 23
#: Bytes of archives that a task reads.
PART_BYTES = 1 << 24
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id bigint, url string, payload_digest string, payload_bytes bigint, record_type string, refers_to bigint, archive string, offset bigint, length bigint"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, header_digest string, payload binary"


def classified(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload, its digest and length, record_type and refers_to of every page.

    The groups of equal payloads are counted from digests alone; only digests that occur twice meet the pages again. Those
    of over one HOT-th of all pages (HOT at most) meet them by broadcast, so that the pages of a common payload stay where
    they are.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2(F.encode("payload", "UTF-8"), 256), "payload_bytes": F.octet_length("payload").cast("bigint")})
    groups = rows.where(F.col("payload_bytes") >= min_bytes).groupBy(F.col("payload_digest").alias("of_digest")).agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    several = written(groups.where((F.col("n") > 1) & F.col("first_id").isNotNull()), "digests")
    is_hot = F.col("n") > max(1, pages.count() // HOT)
    hot, others = several.where(is_hot).drop("n"), several.where(~is_hot).drop("n")
    same = F.col("payload_digest") == F.col("of_digest")
    apart = rows.join(F.broadcast(hot.select("of_digest")), same, "left_anti").join(others, same, "left")
    joined = rows.join(F.broadcast(hot), same).unionByName(apart)
    revisits = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(
        "page_id", "url", "payload", "payload_digest", "payload_bytes",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.when(revisits, F.col("first_id")).alias("refers_to"),
    )


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record_bytes(row: dict) -> bytes:
    """One WARC record as a gzip member."""
    revisit = row["record_type"] == "revisit"
    block = HTTP if revisit else HTTP + row["payload"].encode()
    url = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in row["url"]) if row["url"] is not None else None
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", _record_id(row["page_id"])), ("WARC-Date", DATE)]
    fields += [("WARC-Target-URI", url)] * (url is not None) + [("WARC-Payload-Digest", f"sha256:{row['payload_digest']}")]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(row["refers_to"])), ("X-Refers-To-Page", str(row["refers_to"]))]
    fields += [("X-Page", str(row["page_id"]))] * (row["page_id"] is not None)
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def parse_record(member: bytes) -> dict:
    """The fields and the payload (None for a revisit) of a gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = None if fields["WARC-Type"] == "revisit" else block.partition(b"\r\n\r\n")[2]
    number = lambda key: int(fields[key]) if key in fields else None
    return {"page_id": number("X-Page"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page"), "header_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "payload": payload}


def write_archives(pages: DataFrame, root: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write a record for each page under root (a URI that pyarrow can open), and return the index, kept in root/index.

    A task that is run again writes archives of new names; the index names those of the attempt that Spark committed.
    """
    kept = ["page_id", "url", "payload_digest", "payload_bytes", "record_type", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]):
        store, base = pafs.FileSystem.from_uri(root)
        out, at, name = None, 0, ""
        for batch in batches:
            places = []
            for row in batch.to_pylist():
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    else:
                        store.create_dir(f"{base}/archives", recursive=True)
                    name, at = f"archives/{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                member = record_bytes(row)
                out.write(member)
                places.append((name, at, len(member)))
                at += len(member)
            columns = [batch.column(c) for c in kept]
            columns += [pa.array([p[0] for p in places], pa.string()), pa.array([p[1] for p in places], pa.int64()), pa.array([p[2] for p in places], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "archive", "offset", "length"])
        if out is not None:
            out.close()

    rows = classified(pages, min_bytes).withColumn("payload", F.when(F.col("record_type") == "response", F.col("payload")))
    rows.select(*kept, "payload").mapInArrow(run, INDEX).write.parquet(f"{root}/index")
    return read_index(pages.sparkSession, root)


def read_index(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{root}/index")


def byte_ranges(index: DataFrame, max_gap: int = MAX_GAP, max_range: int = MAX_RANGE) -> DataFrame:
    """archive, begin, end and the records (offset, length) of each merged range.

    A range ends where more than max_gap bytes are not wanted or a window of max_range bytes of the archive does,
    so neither a range nor its list of records grows with the archives.
    """
    in_order = Window.partitionBy("archive").orderBy("offset")
    before = F.lag(F.col("offset") + F.col("length")).over(in_order)
    window = F.floor(F.col("offset") / max_range)
    fresh = before.isNull() | (F.col("offset") - before > max_gap) | (window != F.lag(window).over(in_order))
    marked = index.select("archive", "offset", "length", fresh.cast("int").alias("fresh"))
    numbered = marked.withColumn("number", F.sum("fresh").over(in_order))
    grouped = numbered.groupBy("archive", "number").agg(F.min("offset").alias("begin"), F.max(F.col("offset") + F.col("length")).alias("end"), F.collect_list(F.struct("offset", "length")).alias("records"))
    return grouped.drop("number")


def read_records(index: DataFrame, root: str, max_gap: int = MAX_GAP, max_range: int = MAX_RANGE) -> DataFrame:
    """The records that index (all of it or any selection) names, as page_id, url, record_type, refers_to, header_digest and payload."""

    def run(batches):
        store, base = pafs.FileSystem.from_uri(root)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("header_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for r in batch.to_pylist():
                with store.open_input_file(f"{base}/{r['archive']}") as source:
                    data = source.read_at(r["end"] - r["begin"], r["begin"])
                found = (parse_record(data[x["offset"] - r["begin"] : x["offset"] - r["begin"] + x["length"]]) for x in r["records"])
                yield pa.RecordBatch.from_pylist(list(found), schema)

    size = index.agg(F.sum("length")).first()[0] or 0
    ranges = byte_ranges(index, max_gap, max_range).repartition(1 + size // PART_BYTES, "archive", "begin")  # small rows, large reads
    return ranges.mapInArrow(run, RECORD)


def payload_facts(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of records as read, revisits by what they refer to.

    A response's digest and length come from its payload, and intact says whether the digest is that of its header;
    a revisit takes the length of the response that it names, and is intact if that response's payload has its digest.
    """
    facts = records.select(
        "page_id", "record_type", "refers_to", "header_digest",
        F.when(F.col("record_type") == "response", F.sha2("payload", 256)).alias("own_digest"), F.octet_length("payload").cast("bigint").alias("own_bytes"),
    )
    responses = facts.where(F.col("record_type") == "response").groupBy(F.col("page_id").alias("at_page"), F.col("own_digest").alias("at_digest")).agg(F.max("own_bytes").alias("at_bytes"))
    joined = facts.join(responses, (F.col("refers_to") == F.col("at_page")) & (F.col("header_digest") == F.col("at_digest")), "left")
    return joined.select(
        "page_id", F.coalesce("own_bytes", "at_bytes").alias("payload_bytes"), F.coalesce("own_digest", "at_digest").alias("payload_digest"), "record_type", "refers_to",
        (F.coalesce("own_digest", "at_digest") == F.col("header_digest")).alias("intact"),
    )


