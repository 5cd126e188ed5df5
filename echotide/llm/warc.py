"""WARC archives: a deterministic, sharded writer and a reader.

Records are put in order of id and digest and cut into ranges of ``range_rows``
records each, by their exact places, so ranges don't depend on partitions.  A range
is written in order and its file rolls when the compressed size reaches
``roll_bytes``; names follow from range and number.  Headers, record ids (UUID 5 of
id and digest) and digests are made anew from the records, so that equal input gives
equal files.

A run into a folder is a generation of its own, ``000000`` on.  A file is written
under a temporary name and then renamed; a task that runs again replaces its files
by equal ones.  The generation's manifest, with the records, bytes and SHA-256 of
each file, is written last and commits it; until then, and if it never is, readers
see the generation before.  On reading, files are checked against the manifest.

Of records with equal payloads of ``revisit_from`` bytes or more, that with the
largest id is the response and the others revisit it, without their payload.
Each record is one gzip member.  On reading, the digests of stored payloads are
checked.

Defined results: a null payload is the empty payload and a null url the empty
url; rows that repeat the largest id of a group are all responses; a record with
a null id revisits the group's response, or is a response if no id is known;
ids of any simple type are written as Spark casts them to text, null as ``-``
(texts that are ``-`` can't be told from it and are refused); rows that repeat an
id and a payload stay in one range; an empty table gives a manifest without files;
other columns are ignored.

Scale: groups of copies are found over digests alone, pre-aggregated; ids and
digests alone are put in order; payloads are shuffled once, to their ranges,
together with short notices of which of them are revisits.  The bounds of all
ranges, one short row each, are held by every worker.  Folders must be reachable
from every executor.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import pickle
import posixpath
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._order import placed
from ._store import discard, files_of, fresh_path, materialise, small_batches

_RECORDS = uuid.UUID("6c0f9b52-6c7e-5d0a-9d5c-2f0c7a6a7f11")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_MANIFEST = "file string, first string, last string, records bigint, bytes bigint, sha256 string"
_GENERATION = "{:06d}"


def classify(pages: DataFrame, *, id_col: str, url_col: str, payload_col: str, revisit_from: int) -> DataFrame:
    """Records (kind 1: page_id, url, payload, digest) and notices (kind 0: page_id, digest, refers_to).

    A notice says that the records of its id and digest are revisits; it sorts before them.  So groups of copies are
    found and told of over digests alone, and payloads need no join.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    url = F.coalesce(F.col(url_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    large = rows.where(F.octet_length("payload") >= revisit_from).select("page_id", "digest")
    groups = (
        large.groupBy(F.col("digest").alias("group"))
        .agg(F.max("page_id").alias("largest"), F.count("*").alias("n"))
        .where("n > 1 and largest is not null")
    )
    copies = large.join(groups, F.col("digest") == F.col("group")).where(~F.col("page_id").eqNullSafe(F.col("largest")))
    notices = copies.select("page_id", "digest", F.col("largest").alias("refers_to"), F.lit(0).alias("kind"))
    return rows.withColumn("kind", F.lit(1)).unionByName(notices, allowMissingColumns=True)


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_RECORDS, f'{page_id}:{digest}')}>"


def _b32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def record(page_id, url: str, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record: its header, an HTTP header and, for a response, the payload."""
    block = _HTTP if refers_to is not None else _HTTP + payload
    if page_id == "-":
        raise ValueError("an id must not be -")
    shown = "-" if page_id is None else page_id
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(shown, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{_b32(digest)}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        f"X-Page-ID: {shown}",
        f"X-Page-URL: {json.dumps(url)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


class _Roll:
    """Files of one range: opened under a temporary name, renamed when complete."""

    def __init__(self, root: str, generation: str, part: int, roll_bytes: int):
        self.files, self.folder = files_of(root)
        self.generation, self.part, self.roll_bytes, self.number = generation, part, roll_bytes, 0
        self.sink = None

    def add(self, data: bytes, page_id) -> None:
        if self.sink is None:
            self.name = f"{self.generation}/part-{self.part:06d}-{self.number:05d}.warc.gz"
            self.temporary = posixpath.join(self.folder, self.generation, "_temporary", uuid.uuid4().hex)
            self.sink = self.files.open_output_stream(self.temporary, compression=None)
            self.sha, self.bytes, self.records, self.first = hashlib.sha256(), 0, 0, page_id
        self.sink.write(data)
        self.sha.update(data)
        self.bytes, self.records, self.last = self.bytes + len(data), self.records + 1, page_id

    def full(self) -> bool:
        return self.sink is not None and self.bytes >= self.roll_bytes

    def close(self) -> dict[str, list]:
        self.sink.close()
        self.files.move(self.temporary, posixpath.join(self.folder, self.name))
        self.sink, self.number = None, self.number + 1
        shown = ["" if x is None else str(x) for x in (self.first, self.last)]
        return {
            "file": [self.name],
            "first": [shown[0]],
            "last": [shown[1]],
            "records": [self.records],
            "bytes": [self.bytes],
            "sha256": [self.sha.hexdigest()],
        }


def _sort_key(page_id, digest: bytes) -> tuple:
    """Orders as Spark does: null first, then by value, then by digest."""
    return (page_id is not None, page_id if page_id is not None else 0, digest)


@lru_cache(maxsize=1)
def _bounds(path: str) -> list[tuple]:
    """Where ranges begin, but the first; a worker keeps them over its tasks."""
    files, at = files_of(path)
    with files.open_input_stream(at, compression=None) as held:
        return pickle.loads(held.read())


def _cut(keys: DataFrame, range_rows: int) -> tuple[str, int]:
    """Writes the first key of each range, but the first, to the shared folder; its path and the number of ranges."""
    spark = keys.sparkSession
    counts = keys.groupBy("page_id", "digest").agg(F.count("*").alias("n"))
    at = placed(counts, [F.col("page_id").asc_nulls_first(), F.col("digest")], weight="n")
    part = F.floor(F.col("place") / range_rows)
    firsts = at.groupBy(part.alias("part")).agg(F.min(F.struct("place", "page_id", "digest")).alias("first"))
    rows = [r["first"] for r in firsts.where("part > 0").orderBy("part").collect()]
    folder = fresh_path(spark, "bounds")
    files, path = files_of(folder)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/bounds", compression=None) as out:
        out.write(pickle.dumps([_sort_key(r["page_id"], bytes(r["digest"])) for r in rows]))
    return f"{folder}/bounds", len(rows) + 1


def write(
    pages: DataFrame,
    root: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    revisit_from: int = 1000,
    roll_bytes: int = 64 << 20,
    range_rows: int = 5000,
    level: int = 6,
    date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Writes the archive to ``root`` and returns its manifest, which is also kept there."""
    spark = pages.sparkSession
    small_batches(spark)
    files, folder = files_of(root)
    known = _generations(root)
    generation = _GENERATION.format(known[-1] + 1 if known else 0)
    files.create_dir(posixpath.join(folder, generation, "_temporary"), recursive=True)
    rows = classify(pages, id_col=id_col, url_col=url_col, payload_col=payload_col, revisit_from=revisit_from)
    path, ranges = _cut(rows.where("kind = 1").select("page_id", "digest"), range_rows)

    @F.arrow_udf("int")
    def range_of(page_id: pa.Array, digest: pa.Array) -> pa.Array:
        bounds = _bounds(path)
        keys = (_sort_key(*k) for k in zip(page_id.to_pylist(), digest.to_pylist(), strict=True))
        return pa.array([bisect_right(bounds, k) for k in keys], pa.int32())

    dealt = rows.withColumn("part", range_of("page_id", "digest")).withColumn("shown", F.col("page_id").cast("string"))
    dealt = dealt.withColumn("refers_to", F.col("refers_to").cast("string"))
    dealt = dealt.repartition(ranges, "part").sortWithinPartitions("part", "page_id", "digest", "kind", "url")
    names = ("part", "kind", "shown", "url", "payload", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in names), strict=True))
        for part, held in itertools.groupby(rows, key=lambda r: r[0]):
            roll = _Roll(root, generation, part, roll_bytes)
            told: tuple = ()
            for _, kind, page_id, url, payload, digest, refers_to in held:
                if kind == 0:
                    told = page_id, digest, refers_to
                    continue
                of = told[2] if told[:2] == (page_id, digest) else None
                roll.add(member(record(page_id, url, payload, digest.hex(), of, date), level), page_id)
                if roll.full():
                    yield pa.RecordBatch.from_pydict(roll.close())
            if roll.sink is not None:
                yield pa.RecordBatch.from_pydict(roll.close())

    made = materialise(dealt.select(*names).mapInArrow(run, _MANIFEST), "manifest")
    files.delete_dir(posixpath.join(folder, generation, "_temporary"))
    made.coalesce(1).orderBy("file").write.json(f"{root.rstrip('/')}/_manifest/{generation}")
    discard(made)
    return manifest(spark, root)


def _generations(root: str) -> list[int]:
    """The committed generations, in order: those whose manifest is whole."""
    from pyarrow import fs

    files, folder = files_of(root)
    held = files.get_file_info(fs.FileSelector(posixpath.join(folder, "_manifest"), allow_not_found=True, recursive=True))
    return sorted(int(posixpath.basename(posixpath.dirname(f.path))) for f in held if f.base_name == "_SUCCESS")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The files of the last committed generation of an archive."""
    known = _generations(root)
    if not known:
        raise FileNotFoundError(f"no committed archive in {root}")
    return spark.read.schema(_MANIFEST).json(f"{root.rstrip('/')}/_manifest/{_GENERATION.format(known[-1])}")


class _Checked:
    """A stream that counts and digests what is read."""

    def __init__(self, stream):
        self.stream, self.bytes, self.sha = stream, 0, hashlib.sha256()

    def read(self, size: int) -> bytes:
        data = self.stream.read(size)
        self.bytes += len(data)
        self.sha.update(data)
        return data


def members(stream, piece: int = 1 << 14) -> Iterator[bytes]:
    """The contents of a stream's gzip members, one after the other."""
    inflate, out, rest = zlib.decompressobj(31), [], b""
    while data := rest or stream.read(piece):
        out.append(inflate.decompress(data))
        rest = inflate.unused_data
        if inflate.eof:
            yield b"".join(out)
            inflate, out = zlib.decompressobj(31), []
    if out:
        raise ValueError("the last record is cut off")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """The header and the payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    header = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(header["content-length"])]
    return header, block.partition(b"\r\n\r\n")[2]


_READ = pa.schema(
    [
        ("page_id", pa.string()),
        ("url", pa.string()),
        ("payload", pa.binary()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.string()),
    ]
)
_READ_SQL = (
    "page_id string, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string,"
    " refers_to string"
)


def read(spark: SparkSession, root: str, *, id_type: str = "bigint", payloads: bool = True) -> DataFrame:
    """Per record of the archive: page_id, url, payload (null for revisits, or if not wanted), payload_bytes,
    payload_digest, record_type, refers_to.  A file that isn't as the manifest has it is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = files_of(root)
        for batch in batches:
            for f in batch.to_pylist():
                with files.open_input_stream(posixpath.join(folder, f["file"]), compression=None) as stream:
                    checked, rows, n = _Checked(stream), [], 0
                    for data in members(checked):
                        rows.append(_row(data, payloads))
                        n += 1
                        if len(rows) == 256:
                            yield pa.RecordBatch.from_pylist(rows, schema=_READ)
                            rows = []
                    if (n, checked.bytes, checked.sha.hexdigest()) != (f["records"], f["bytes"], f["sha256"]):
                        raise ValueError(f"{f['file']} is not as the manifest has it")
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    names = manifest(spark, root).select("file", "records", "bytes", "sha256")
    got = names.repartitionByRange(max(1, min(10_000, names.count())), "file").mapInArrow(run, _READ_SQL)
    return got.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def _row(data: bytes, payloads: bool) -> dict:
    header, payload = parse(data)
    kind = header["warc-type"]
    digest = base64.b32decode(header["warc-payload-digest"].removeprefix("sha1:")).hex()
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"record {header['warc-record-id']} has another digest")
    refers_to = header.get("x-refers-to-page-id")
    return {
        "page_id": None if header["x-page-id"] == "-" else header["x-page-id"],
        "url": json.loads(header["x-page-url"]),
        "payload": payload if payloads and kind == "response" else None,
        "payload_bytes": int(header["x-payload-length"]),
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": refers_to,
    }


def archive(pages: DataFrame, root: str | None = None, **settings) -> DataFrame:
    """Writes ``pages`` to an archive, in the shared folder if no other is named, and reads it back."""
    spark = pages.sparkSession
    root = root or fresh_path(spark, "warc")
    id_type = pages.schema[settings.get("id_col", "page_id")].dataType.simpleString()
    write(pages, root, **settings)
    return read(spark, root, id_type=id_type, payloads=False)
