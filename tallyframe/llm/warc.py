"""Pages as WARC archives, and archives read back in parallel by verified record boundaries.

A byte range of an archive may begin inside a record, and a payload may hold whole records of its own, so
what looks like a record proves nothing. Each task lists the candidates of its range with the offset of
their successors, and where the chain from each leaves the range. Pointer jumping from the start of every
file over these, twice as far in each round, reaches the true boundaries; records are then read from those
that were reached, and from no other place.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import has_repeats, materialize, named, text_batches, tidy
from tallyframe.llm.token_files import _store
from tallyframe.sources.shared import shared_folder

#: Bytes of an archive after which a task begins another, and of a range that one task searches.
FILE_BYTES = 1 << 30
SPLIT_BYTES = 8 << 20
#: Ranges beyond this number share tasks.
MOST_TASKS = 50_000
_CHUNK = 1 << 16
_END = b"\r\n\r\n"
_PLAIN, _PACKED = b"WARC/1.", b"\x1f\x8b\x08"
_IDS = uuid.UUID("9b7cbd2e-0f0c-4c54-9c39-6d6c2bb0a6f1")
# Fixed values of the format.
_VERSION = "WARC/1.1"
_REVISIT = "http://netpreservation.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "application/http;msgtype=response"

_MANIFEST = "folder string, file string, bytes long, records long"
_FOUND = "folder string, file string, bytes long, begin long, end long, at long, next long, leaves long"
RECORD = (
    "folder string, file string, at long, next long, record_type string, record_id string, target_uri string, date string, "
    "refers_to_id string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary"
)


def payload_digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32, as archives state it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(fields: list[tuple[str, str | None]], block: bytes, packed: bool) -> bytes:
    """One record; fields without a value are left out. Packed: a gzip member of its own."""
    lines = [_VERSION, *(f"{name}: {value}" for name, value in fields if value is not None), f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode() + _END + block + _END
    if not packed:
        return raw
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _name(page_id: int | None, sha: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(_IDS, f'{page_id}:{sha.hex()}')}>"


def _target(url: str | None) -> str | None:
    """A URL without characters that would end a header line."""
    return url and re.sub(r"[\x00-\x20\x7f-\x9f  ]", lambda m: urllib.parse.quote(m[0]), url)


def _written(folder: str, packed: bool, date: str, file_bytes: int):
    """Rows (page_id, url, payload, sha, copy, first) to archives of the task; a row a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        out, file, size, count = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([{"folder": folder, "file": file, "bytes": size, "records": count}], schema)

        schema = pa.schema([("folder", pa.string()), ("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])
        for batch in batches:
            for i in range(len(batch)):
                page_id, url, payload, sha, copy, first = (column[i].as_py() for column in batch.columns)
                if out is not None and size >= file_bytes:
                    yield closed()
                    out = None
                if out is None:
                    file, size, count = f"pages-{uuid.uuid4().hex}.warc" + ".gz" * packed, 0, 0
                    out = store.open_output_stream(f"{path}/{file}", compression=None)
                    info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date),
                            ("WARC-Filename", file), ("Content-Type", "application/warc-fields")]
                    size += out.write(record_bytes(info, b"format: WARC File Format 1.1\r\n", packed))
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + _END
                fields = [
                    ("WARC-Type", "revisit" if copy else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>" if copy else _name(page_id, sha)),
                    ("WARC-Date", date), ("WARC-Target-URI", _target(url)), ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
                    ("WARC-Refers-To", _name(first, sha) if copy else None), ("WARC-Profile", _REVISIT if copy else None), ("Content-Type", _HTTP),
                    ("X-Page-Id", None if page_id is None else str(page_id)), ("X-Refers-To-Page-Id", str(first) if copy and first is not None else None),
                ]
                size += out.write(record_bytes(fields, http if copy else http + payload, packed))
                count += 1
        if out is not None:
            yield closed()

    return run


def write_warc(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, packed: bool = True,
    folder: str | None = None, date: str | None = None, file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Writes a record a page into archives of a shared folder; returns the manifest: folder, file, bytes, records.

    Of pages with equal payloads of at least min_bytes bytes, that of the smallest page_id is the response
    and holds the payload; the others revisit it. Shorter ones are all responses. Equality is that of
    SHA-256. A null payload is empty. Null page_ids come after all others. Of rows that share the smallest
    page_id, one is the response and the others revisit it. Repeated rows have a record each; a null url
    gives no target; no pages give no archives; other columns are ignored.

    packed: each record is a gzip member, as archives usually are. Payloads pass one shuffle, whose hot
    digests Spark splits. A task may run again: each attempt writes files of its own name, and the manifest
    names those that counted.
    """
    spark = text_batches(pages.sparkSession)
    folder = folder or shared_folder(spark, "warc")
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    body = F.coalesce(named(payload).cast("binary"), F.lit(b""))
    rows = pages.select(named(page_id).cast("long").alias("page_id"), named(url).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("payload", 256)))
    groups = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first"))
    groups = groups.where("n > 1").select(F.col("sha").alias("group"), "first")
    joined = rows.join(groups, F.col("sha") == F.col("group"), "left")
    copy = F.col("group").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    if has_repeats(pages, page_id):  # several rows may have the smallest page_id of a group
        marked = materialize(joined.withColumn("row", F.monotonically_increasing_id()), "warc-rows")
        one = marked.where(F.col("group").isNotNull() & ~copy).groupBy(F.col("group").alias("of")).agg(F.min("row").alias("one"))
        joined = marked.join(one, F.col("group") == F.col("of"), "left")
        copy = F.col("group").isNotNull() & (F.col("row") != F.col("one"))
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    records = joined.select("page_id", "url", "payload", "sha", copy.alias("copy"), "first")
    return materialize(records.mapInArrow(tidy(_written(folder, packed, date, file_bytes)), _MANIFEST), "warc-manifest")


def warc_files(spark: SparkSession, folder: str) -> DataFrame:
    """The archives of a folder as a manifest; the driver lists names and sizes only."""
    from pyarrow import fs

    store, path = _store(folder)
    found = store.get_file_info(fs.FileSelector(path, recursive=True))
    names = [(folder, f.path[len(path.rstrip("/")) + 1 :], f.size, None) for f in found if f.is_file and re.search(r"\.warc(\.gz)?$", f.path)]
    return spark.createDataFrame(names, _MANIFEST)


class _Head:
    """The header of a record: its fields by lower-case name, and the number of its bytes."""

    def __init__(self, fields: dict[str, str], size: int):
        self.fields, self.size = fields, size
        length = fields.get("content-length", "")
        self.length = int(length) if re.fullmatch(r"[0-9]{1,18}", length) else None


def _fields(lines: list[bytes]) -> dict[str, str] | None:
    """Header lines as fields; None if one of them is none. A line that begins with white space goes on."""
    out: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in (b" ", b"\t") and name:
            out[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            return None
        name = name.decode().lower()
        out[name] = value.strip().decode("utf-8", "replace")
    return out


def parse_head(read, size: int) -> _Head | None:
    """The header that begins at the start of what `read(n)`, the first n bytes, gives; None if none does.

    Reading stops at the first line that no header has, such as the next record's first, so candidates
    that lie close do not read the same bytes again and again.
    """
    want = 1024
    while True:
        data = read(min(want, size))
        end = data.find(_END)
        complete = data[: end if end >= 0 else max(0, data.rfind(b"\r\n"))]
        lines = complete.split(b"\r\n") if complete else []
        if not lines or not re.fullmatch(rb"WARC/1\.[0-9]", lines[0]):
            if lines or len(data) >= min(64, size):
                return None
        elif (fields := _fields(lines[1:])) is None:
            return None
        elif end >= 0:
            return _Head(fields, end + len(_END))
        if want >= size:
            return None
        want *= 4


def _plain_next(file, at: int, size: int) -> int | None:
    """Where a record that begins at `at` ends, if one does: behind its block and two line breaks."""
    head = parse_head(lambda n: file.read_at(n, at), size - at)
    if head is None or head.length is None:
        return None
    after = at + head.size + head.length + len(_END)
    return after if after <= size and file.read_at(len(_END), after - len(_END)) == _END else None


def _packed_next(file, at: int, size: int) -> int | None:
    """The same for a gzip member that holds a record; its content passes by in pieces."""
    unpacker, begin, place = zlib.decompressobj(31), b"", at
    try:
        while not unpacker.eof:
            data = unpacker.unconsumed_tail
            if not data:
                data = file.read_at(min(_CHUNK, size - place), place)
                place += len(data)
                if not data:
                    return None
            got = unpacker.decompress(data, 16 * _CHUNK)
            if len(begin) < len(_PLAIN):
                begin += got[: len(_PLAIN)]
                if len(begin) >= len(_PLAIN) and not begin.startswith(_PLAIN):
                    return None
    except zlib.error:
        return None
    return place - len(unpacker.unused_data) if begin.startswith(_PLAIN) else None


def candidates(file, begin: int, end: int, size: int) -> list[tuple[int, int, int | None]]:
    """(at, next, leaves) of what looks like a record and begins in [begin, end).

    leaves: the first offset at or behind `end` on the chain of successors; None where the chain breaks
    off inside the range.
    """
    magic, follow = (_PACKED, _packed_next) if file.read_at(3, 0) == _PACKED else (_PLAIN, _plain_next)
    found, place = [], begin
    while place < end:
        data = file.read_at(min((1 << 20) + len(magic) - 1, size - place), place)
        at = data.find(magic)
        while at >= 0 and place + at < end and at < 1 << 20:
            if (after := follow(file, place + at, size)) is not None:
                found.append((place + at, after))
            at = data.find(magic, at + 1)
        place += 1 << 20
    leaves: dict[int, int | None] = {}
    for at, after in reversed(found):
        leaves[at] = after if after >= end else leaves.get(after)
    return [(at, after, leaves[at]) for at, after in found]


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [column.split()[0] for column in _FOUND.split(", ")]
    schema = pa.schema([(n, pa.string() if n in ("folder", "file") else pa.int64()) for n in names])
    for batch in batches:
        for row in batch.to_pylist():
            store, path = _store(row["folder"])
            with store.open_input_file(f"{path}/{row['file']}") as file:
                found = candidates(file, row["begin"], row["end"], row["bytes"])
            yield pa.RecordBatch.from_pylist([row | {"at": a, "next": n, "leaves": e} for a, n, e in found], schema)


def _block_of(file, at: int, size: int, packed: bool) -> tuple[_Head, bytes, int]:
    """The record at a verified offset: header, block, and where the next one begins."""
    if not packed:
        head = parse_head(lambda n: file.read_at(n, at), size - at)
        return head, file.read_at(head.length, at + head.size), at + head.size + head.length + len(_END)
    unpacker, parts, place = zlib.decompressobj(31), [], at
    while not unpacker.eof:
        data = file.read_at(min(_CHUNK, size - place), place)
        place += len(data)
        parts.append(unpacker.decompress(data))
    raw = b"".join(parts)
    head = parse_head(lambda n: raw[:n], len(raw))
    return head, raw[head.size : head.size + head.length], place - len(unpacker.unused_data)


def _record(row: dict, at: int, after: int, head: _Head, block: bytes, with_payload: bool) -> dict:
    fields = head.fields
    kind, payload = fields.get("warc-type"), block
    declared = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    size = None
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(_END)
        told = re.search(rb"(?im)^content-length:\s*([0-9]+)\s*$", http)
        size = int(told[1]) if told else None
    if kind != "revisit":
        size, own = len(payload), payload_digest(payload)
        if kind == "response" and declared and re.fullmatch("[A-Z2-7]{32}", declared) and declared != own:
            raise ValueError(f"{row['file']} at {at}: the payload is not that of its digest")
        declared = own
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "folder": row["folder"], "file": row["file"], "at": at, "next": after, "record_type": kind, "record_id": fields.get("warc-record-id"),
        "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "refers_to_id": fields.get("warc-refers-to"),
        "page_id": number("x-page-id"), "refers_to": number("x-refers-to-page-id"), "payload_bytes": size, "payload_digest": declared,
        "payload": payload if with_payload and kind != "revisit" else None,
    }


def _read(with_payload: bool):
    """Rows (folder, file, bytes, at, end) to the records from a verified offset to the end of its range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in (column.split() for column in RECORD.split(", "))])
        for batch in batches:
            for row in batch.to_pylist():
                store, path = _store(row["folder"])
                out, held, at = [], 0, row["at"]
                with store.open_input_file(f"{path}/{row['file']}") as file:
                    packed = file.read_at(3, 0) == _PACKED
                    while at < row["end"]:
                        head, block, after = _block_of(file, at, row["bytes"], packed)
                        out.append(_record(row, at, after, head, block, with_payload))
                        held, at = held + len(block), after
                        if held > 4 << 20 or len(out) >= 512:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    """Short rows that each stand for a long read, one a task; a number keeps Spark from merging them by their size."""
    return rows.repartition(max(1, min(rows.count(), MOST_TASKS)))


def verified_starts(files: DataFrame, split_bytes: int = SPLIT_BYTES, rounds: int = 64) -> DataFrame:
    """folder, file, bytes, at and end: the first record that truly begins in each range, and the range's end.

    Pointer jumping: `jumps` leads from a candidate to where its chain leaves the range; in each round the
    offsets reached grow by those that they jump to, and jumps are joined with themselves, so they lead
    twice as far. The number of rounds grows with the logarithm of the ranges of a file. A chain that
    breaks off before the end of its file is an error.
    """
    real = files.where("bytes > 0").select("folder", "file", "bytes")
    begins = real.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("begin"))
    ranges = begins.withColumn("end", F.least(F.col("begin") + split_bytes, F.col("bytes")))
    found = materialize(_dealt(ranges).mapInArrow(tidy(_searched), _FOUND), "warc-candidates")
    key = ["folder", "file"]
    reached = real.select(*key, F.lit(0).cast("long").alias("at"))
    jumps = found.where("leaves is not null and leaves < bytes").select(*key, "at", F.col("leaves").alias("to"))
    for _ in range(rounds):
        if jumps.isEmpty():
            break
        onward = reached.join(jumps, [*key, "at"]).select(*key, F.col("to").alias("at"))
        reached = materialize(reached.unionByName(onward).distinct(), "warc-reached")
        further = jumps.select(*key, F.col("at").alias("to"), F.col("to").alias("beyond"))
        jumps = materialize(jumps.join(further, [*key, "to"]).select(*key, "at", F.col("beyond").alias("to")), "warc-jumps")
    else:
        raise RuntimeError("record boundaries did not settle")
    starts = materialize(reached.join(found, [*key, "at"], "left"), "warc-starts")
    broken = starts.where("leaves is null").first()
    if broken:
        raise ValueError(f"{broken['file']}: the chain of records breaks off behind offset {broken['at']}")
    return starts.select(*key, "bytes", "at", "end")


def read_warc(files: DataFrame, split_bytes: int = SPLIT_BYTES, payload: bool = True) -> DataFrame:
    """A row a record of the archives (folder, file, bytes), plain or of gzip members, in the columns of RECORD.

    payload_bytes and payload_digest (base32 SHA-1) are those of the payload, without the HTTP header; a
    revisit, which has none, gives those of the payload it stands for, from its headers. A response whose
    payload is not that of its stated digest is an error. payload=False leaves payloads out of the rows.
    Empty archives, and no archives, have no records.
    """
    text_batches(files.sparkSession)
    return _dealt(verified_starts(files, split_bytes)).mapInArrow(tidy(_read(payload)), RECORD)


def with_revisited(records: DataFrame) -> DataFrame:
    """The same records; a revisit has the payload of the response it refers to, if that is among them."""
    held = records.where("record_type = 'response'").select(F.col("record_id").alias("held_id"), F.col("payload").alias("held"))
    joined = records.join(held, F.col("refers_to_id") == F.col("held_id"), "left")
    return joined.withColumn("payload", F.coalesce("payload", "held")).select(*records.columns)
