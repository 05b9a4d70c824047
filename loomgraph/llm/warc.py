"""WARC: records are written by Spark's text sink and found again by boundary chains.

An archive is cut into blocks, and a task scans its blocks for the magic `WARC/`. Every hit that parses as a record
header is a candidate, and names its successor by its Content-Length. Payloads may hold whole records, so candidates
are only true if the chain from the file's start reaches them: inside a block chains are followed at once, which
leaves, for each candidate at which a chain may enter the block, the place where it leaves; pointer jumping over these
then halves the way from the file's start in every round, and what it reaches is read, the rest is payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, small_batches, stash, with_least, with_one

VERSION = "WARC/1.1"
#: Bytes of a block; read beyond it for a header, and more if that runs on; and of a payload that are held at once.
BLOCK, HEADER, HELD = 8 << 20, 1 << 16, 4 << 20
#: Blocks of a task at most, but for a table so small that cores would lie idle.
TOGETHER = 8
#: Payloads of fewer bytes are never replaced by a revisit.
SMALLEST = 0
END = "\r\n\r\n"
HEAD = re.compile(rb"WARC/\d\.\d\r\n(?:[^\r\n]+\r\n)+\r\n")
OPEN = re.compile(rb"WARC/\d\.\d\r\n(?:[^\r\n]+\r\n)*(?:[^\r\n]+\r?|\r)?\Z")
HTTP = re.compile(rb"HTTP/\d(?:\.\d)? \d{3}[^\r\n]*\r\n(?:[^\r\n]+\r\n)*\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# -- writing


def sha1_base32(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the digest of the last column, html, to a batch; null html is empty."""
    for batch in batches:
        rows = [(x.as_buffer() if x.is_valid else b"") for x in batch.column(batch.num_columns - 1)]
        digest = [base64.b32encode(hashlib.sha1(r).digest()).decode() for r in rows]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digest, pa.string())], [*batch.schema.names, "digest"])


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, size and digest, without html."""
    for batch in sha1_base32(batches):
        yield batch.select(["page_id", "size", "digest"])


def write_archives(pages: DataFrame, path: str, smallest: int = SMALLEST) -> int:
    """A record for each row of pages (page_id, url, html): of equal payloads of at least `smallest` bytes that with
    the least page_id is a response, the others revisit it without repeating it. Returns the count of records.

    Rows without page_id have no place among the others: their records are responses with an empty id. Repeated rows of
    one page_id are all responses if theirs is the least. Which page is first is settled on ids and digests alone; html
    only meets it by page_id. The text sink joins records by the two line ends that close each, so that files are plain
    WARC and a task that is lost is written anew by the sink's own commit protocol.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    ids = small_batches(rows).select("page_id", F.coalesce(F.octet_length("html"), F.lit(0)).alias("size"), "html")
    ids = stash(ids.mapInArrow(digested, "page_id long, size int, digest string"), "digests")
    first = with_least(ids.filter((F.col("size") >= smallest) & F.col("page_id").isNotNull()).select("digest", "page_id"), "digest", "page_id", "first")
    first = stash(first.filter("first < page_id").distinct(), "firsts")
    rows = rows.mapInArrow(sha1_base32, "page_id long, url string, html string, digest string").withColumn("html", F.coalesce("html", F.lit("")))
    size = F.octet_length("html")
    rows = rows.join(first, ["page_id", "digest"], "left").withColumn("size", size)
    revisit = F.col("first").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = lambda n: F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), n.cast("string"), F.lit(END))
    block = F.concat(http(F.col("size")), F.when(revisit, F.lit("")).otherwise(F.col("html")))
    clean = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    lines = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), urn(F.col("page_id")),
        F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: "), clean, F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), urn(F.col("first")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block,
    )
    rows.select(lines.alias("value")).write.option("lineSep", END).text(path)
    return ids.count()


# -- reading


def blocks(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """path, size, start of every block of the archives, TOGETHER in a task; only the files' names and lengths are read
    here."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size")).filter("size > 0")
    n = files.agg(F.coalesce(F.sum(F.ceil(F.col("size") / block)), F.lit(0))).first()[0]
    cut = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block).cast("long"))).alias("start"))
    return cut.repartition(max(1, spark.sparkContext.defaultParallelism * 2, n // TOGETHER), "path", "start")


def opened(path: str) -> pa.NativeFile:
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def record_at(data: bytes, at: int) -> tuple[dict[bytes, bytes], int, int] | None:
    """Header fields, the block's offset and its length, if a record header stands at `at`."""
    m = HEAD.match(data, at)
    if not m:
        return None
    fields = {}
    for line in m.group().split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip()
    length = fields.get(b"content-length", b"")
    return (fields, m.end(), int(length)) if length.isdigit() and b"warc-type" in fields else None


def record_in(f: pa.NativeFile, data: bytes, start: int, at: int, size: int) -> tuple[bytes, tuple[dict[bytes, bytes], int, int] | None]:
    """The record at `at` in data, which was read from `start`; data is read on while a header runs beyond it."""
    more = HEADER
    while not (record := record_at(data, at)) and start + len(data) < size and OPEN.match(data, at):
        data += f.read_at(min(more, size - start - len(data)), start + len(data))
        more *= 2
    return data, record


def found_in(path: str, start: int, size: int, block: int) -> list[tuple[int, int]]:
    """(offset, successor) of the candidates that begin in a block."""
    with opened(path) as f:
        data = f.read_at(min(block + HEADER, size - start), start)
        out, at = [], data.find(b"WARC/")
        while 0 <= at < block:
            data, record = record_in(f, data, start, at, size)
            if record:
                out.append((start + at, start + record[1] + record[2] + len(END)))
            at = data.find(b"WARC/", at + 1)
    return out


def candidates(cut: DataFrame, block: int = BLOCK) -> DataFrame:
    """path, start (of the block), at, next, leaves: `leaves` is where the chain from `at` leaves its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs = found_in(row["path"], row["start"], row["size"], block)
                leaves: dict[int, int] = {}
                for at, to in reversed(pairs):  # a chain only runs forward
                    leaves[at] = leaves.get(to, to)
                n = len(pairs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["path"]] * n, pa.string()), pa.array([row["start"]] * n, pa.int64()), pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64()), pa.array([leaves[a] for a, _ in pairs], pa.int64())],
                    ["path", "start", "at", "next", "leaves"],
                )

    return cut.mapInArrow(run, "path string, start long, at long, next long, leaves long")


def reachable(found: DataFrame, rounds: int = 64) -> DataFrame:
    """The candidates on the chain from their file's start.

    Entries are candidates to which a chain of another block leads. In each round those reached so far hand the mark to
    where their jumps lead, and all jumps double, so a file of n blocks takes about log2(n) rounds.
    """
    links = found.select("path", "at", F.col("leaves").alias("jump")).withColumn("inner", F.lit(False))
    entries = links.select("path", F.col("jump").alias("at")).union(links.filter("at = 0").select("path", "at")).distinct()
    jumps = stash(links.join(entries, ["path", "at"]).select("path", "at", "jump"), "jumps")
    marked = stash(jumps.filter("at = 0").select("path", "at"), "marked")
    count = marked.count()
    for _ in range(rounds):
        reached = marked.union(marked.join(jumps, ["path", "at"]).select("path", F.col("jump").alias("at"))).distinct()
        marked = stash(reached.join(jumps.select("path", "at"), ["path", "at"]), "marked")
        last, count = count, marked.count()
        if last == count:
            break
        on = jumps.select("path", F.col("at").alias("jump"), F.col("jump").alias("further"))
        jumps = stash(jumps.join(on, ["path", "jump"], "left").select("path", "at", F.coalesce("further", "jump").alias("jump")), "jumps")
    return marked


def read_archives(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """A row for each true record: path, at, record_type, page_id, refers_to, digest (as written), payload_bytes,
    payload_digest (both computed from the payload; for a revisit from what it refers to)."""
    cut = stash(blocks(spark, path, block), "blocks")
    found = stash(candidates(cut, block), "candidates")
    marked = reachable(found).withColumn("entry", F.lit(True))
    by_block = found.join(marked, ["path", "at"], "left").filter("entry").groupBy("path", "start").agg(F.min("at").alias("entry"))
    todo = by_block.join(cut, ["path", "start"]).select("path", "size", "start", "entry")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _records(row["path"], row["size"], row["start"], row["entry"], block)

    schema = "path string, at long, record_type string, page_id long, refers_to long, digest string, payload_bytes long, payload_digest string"
    rows = stash(todo.mapInArrow(run, schema), "records")
    whole = rows.filter("record_type = 'response' and page_id is not null").select(F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("d"))
    whole = whole.join(rows.select("refers_to").filter("refers_to is not null").distinct(), "refers_to", "left_semi").dropDuplicates(["refers_to"])
    rows = with_one(rows, whole, "refers_to", "page_id")
    revisit = F.col("record_type") == "revisit"
    return rows.select("path", "at", "record_type", "page_id", "refers_to", "digest", F.when(revisit, F.col("n")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.when(revisit, F.col("d")).otherwise(F.col("payload_digest")).alias("payload_digest"))


def _records(path: str, size: int, start: int, entry: int, block: int) -> pa.RecordBatch:
    """The records of a block from the chain's entry on."""
    urn = lambda v: int(m[1]) if v and (m := re.search(rb"urn:page:(-?\d+)", v)) else None
    out = []
    with opened(path) as f:
        data = f.read_at(min(start + block + HEADER, size) - start, start)
        at = entry
        while start <= at < min(start + block, size):
            data, record = record_in(f, data, start, at - start, size)
            if not record:
                break
            fields, head, length = record
            digest, total, skip = hashlib.sha1(), 0, None
            for a in range(0, length, HELD):
                first = start + head + a
                n = min(HELD, length - a)
                part = data[head + a : head + a + n] if head + a + n <= len(data) else f.read_at(n, first)
                if skip is None:
                    m = HTTP.match(part)
                    skip = m.end() if m and b"http" in fields.get(b"content-type", b"") else 0
                    part = part[skip:]
                digest.update(part)
                total += len(part)
            out.append((path, at, fields[b"warc-type"].decode("latin-1"), urn(fields.get(b"warc-record-id")), urn(fields.get(b"warc-refers-to")), fields.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha1:"), total, base64.b32encode(digest.digest()).decode()))
            at = start + head + length + len(END)
        if at != size and not record_in(f, f.read_at(min(HEADER, max(size - at, 0)), at), at, 0, size)[1]:
            raise ValueError(f"{path}: no record at {at} of {size}")
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    names = ["path", "at", "record_type", "page_id", "refers_to", "digest", "payload_bytes", "payload_digest"]
    columns = zip(*out, strict=True) if out else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def archived(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every row of pages, written to archives in the
    shared folder and read back. An empty table gives no rows."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    written = write_archives(pages, path)
    rows = read_archives(spark, path)
    if (read := rows.count()) != written:
        raise ValueError(f"{read} records read of {written} written")
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
