"""WAV recordings as tables: headers of files, and their samples in blocks.

Files are read by byte ranges, one block a task, so a recording of any length is
dealt out; 8 to 32-bit integer and 32 or 64-bit float samples are known.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TAKES = (
    "path string, samplerate int, channels int, bits int, coding int, frames bigint, data_at bigint,"
    " description string, date string, time string, time_reference bigint"
)
BLOCKS = "path string, block int, first bigint, samplerate int, channels int, order string, lead int, samples array<float>"


@dataclass
class Header:
    samplerate: int
    channels: int
    bits: int
    coding: int
    frames: int
    data_at: int
    description: str | None = None
    date: str | None = None
    time: str | None = None
    time_reference: int | None = None


def parse_header(read) -> Header:
    """Header of a RIFF file; ``read(at, n)`` gives bytes of it."""
    if read(0, 4) not in (b"RIFF", b"RF64") or read(8, 4) != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, found, bext, large = 12, None, {}, None
    while len(head := read(at, 8)) == 8:
        name, size = head[:4], struct.unpack("<I", head[4:])[0]
        if name == b"ds64":
            large = struct.unpack("<QQ", read(at + 8, 16))[1]
        elif name == b"fmt ":
            coding, channels, rate, _, _, bits = struct.unpack("<HHIIHH", read(at + 8, 16))
            if coding == 0xFFFE and size >= 26:
                coding = struct.unpack("<H", read(at + 32, 2))[0]
            found = rate, channels, bits, coding
        elif name == b"bext":
            body = read(at + 8, 346)
            text = lambda a, b: body[a:b].split(b"\0")[0].decode("latin-1").strip()
            bext = {"description": text(0, 256), "date": text(320, 330), "time": text(330, 338)}
            bext["time_reference"] = struct.unpack("<Q", body[338:346].ljust(8, b"\0"))[0]
        elif name == b"data":
            if found is None:
                raise ValueError("samples come before their format")
            size = large if size == 0xFFFFFFFF and large is not None else size
            frame = found[1] * found[2] // 8
            return Header(*found, size // frame, at + 8, **bext)
        at += 8 + size + size % 2
    raise ValueError("no samples")


def decode(data: bytes, bits: int, coding: int, channels: int) -> np.ndarray:
    """Samples in rows of channels, -1 to 1."""
    if coding == 3:
        x = np.frombuffer(data, "<f4" if bits == 32 else "<f8").astype(np.float32)
    elif bits == 8:
        x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    elif bits == 24:
        raw = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((raw[:, 2] << 24) | (raw[:, 1] << 16) | (raw[:, 0] << 8)) >> 8).astype(np.float32) / 2**23
    else:
        x = np.frombuffer(data, f"<i{bits // 8}").astype(np.float32) / 2.0 ** (bits - 1)
    return x.reshape(-1, channels)


def encode(x: np.ndarray, samplerate: int, bits: int = 16, floating: bool = False) -> bytes:
    """A RIFF file of integer samples, or of 32-bit floating ones."""
    rows = np.atleast_2d(x.T).T
    if floating:
        bits, data = 32, rows.astype("<f4").tobytes()
    else:
        full = np.clip(np.rint(rows * 2 ** (bits - 1)), -(2 ** (bits - 1)), 2 ** (bits - 1) - 1).astype(np.int64)
        data = full.astype("<i2").tobytes() if bits == 16 else full.astype("<i4").view(np.uint8).reshape(-1, 4)[:, : bits // 8].tobytes()
    frame = rows.shape[1] * bits // 8
    fmt = struct.pack("<HHIIHH", 3 if floating else 1, rows.shape[1], samplerate, samplerate * frame, frame, bits)
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(data)) + data


def located(path: str):
    """The file system of a path or address, and the path in it; blanks and the like are as they are."""
    from urllib.parse import quote

    from pyarrow import fs

    if not re.match(r"^\w+:", path):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(quote(path, safe="/:@?=&%+,;~!$'()*"))


def _open(path: str):
    files, name = located(path)
    return files.open_input_file(name)


def _reader(file):
    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    return read


#: Where W, Y, Z and X are among the channels of each order.
WYZX = {"ambix": (0, 1, 2, 3), "fuma": (0, 2, 3, 1)}


def takes(spark: SparkSession, paths: list[str], skip_bad: bool = False) -> DataFrame:
    """One row for each file, from its header; one that can't be read is an error, or left out."""

    def run(batches) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    with _open(path) as file:
                        rows.append({"path": path, **vars(parse_header(_reader(file)))})
                except (ValueError, OSError, struct.error):
                    if not skip_bad:
                        raise
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TAKES.split(", ")])

    table = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 1000)))
    return table.mapInPandas(run, TAKES)


@dataclass
class _Block(InputPartition):
    path: str
    block: int
    header: Header
    first: int
    frames: int
    lead: int = 0


class _WavReader(DataSourceReader):
    def __init__(self, paths: list[str], block_s: float, lead_s: float):
        self.paths, self.block_s, self.lead_s = paths, block_s, lead_s

    def partitions(self) -> list[_Block]:
        def header_of(path: str) -> Header:
            with _open(path) as file:
                return parse_header(_reader(file))

        with ThreadPoolExecutor(32) as pool:  # a few short reads a file
            headers = list(pool.map(header_of, self.paths))
        out = []
        for path, header in zip(self.paths, headers, strict=True):
            size, lead = max(1, round(self.block_s * header.samplerate)), round(self.lead_s * header.samplerate)
            out += [
                _Block(path, k, header, first, min(size, header.frames - first), min(lead, first))
                for k, first in enumerate(range(0, header.frames, size))
            ]
        return out

    def read(self, partition: _Block) -> Iterator[pa.RecordBatch]:
        h, lead = partition.header, partition.lead
        frame = h.channels * h.bits // 8
        with _open(partition.path) as file:
            data = _reader(file)(h.data_at + (partition.first - lead) * frame, (partition.frames + lead) * frame)
        x = decode(data, h.bits, h.coding, h.channels).ravel()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([partition.path]),
                pa.array([partition.block], pa.int32()),
                pa.array([partition.first], pa.int64()),
                pa.array([h.samplerate], pa.int32()),
                pa.array([h.channels], pa.int32()),
                pa.array([order_in(h.description)]),
                pa.array([lead], pa.int32()),
                pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.float32())),
            ],
            ["path", "block", "first", "samplerate", "channels", "order", "lead", "samples"],
        )


class WavSource(DataSource):
    """``spark.read.format("wav").option("block_s", 60).load(path)``; several paths are parted by commas.

    ``samples`` begin with ``lead`` frames from before the block (option ``lead_s``), for filters that must settle.
    """

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema) -> DataSourceReader:
        paths = [p for p in self.options["path"].split(",") if p]
        return _WavReader(paths, float(self.options.get("block_s", "60")), float(self.options.get("lead_s", "0")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WavSource)


def order_in(description: str | None) -> str:
    """``fuma`` where the tags of the first four tracks are W, X, Y, Z, else ``ambix``."""
    tags = dict(re.findall(r"zTRK([1-4])=([^\r\n]*)", description or ""))
    return "fuma" if [tags.get(k, "").strip().upper() for k in "1234"] == list("WXYZ") else "ambix"


def channel_order(description: Column) -> Column:
    """``fuma`` where the tags of the first four tracks are W, X, Y, Z, else ``ambix``."""
    tags = [F.upper(F.trim(F.regexp_extract(description, rf"zTRK{k}=([^\r\n]*)", 1))) for k in (1, 2, 3, 4)]
    return F.when(F.array(*tags) == F.array(*[F.lit(x) for x in "WXYZ"]), "fuma").otherwise("ambix")


def stamp_in(name: Column) -> Column:
    """Time in a file name: YYYYMMDD_HHMMSS, else YYMMDD_HHMMSS; null if there is none or it is no date."""
    long = F.try_to_timestamp(F.regexp_replace(F.regexp_extract(name, r"(\d{8}[_-]\d{6})", 1), "-", "_"), F.lit("yyyyMMdd_HHmmss"))
    short = F.try_to_timestamp(
        F.concat(F.lit("20"), F.regexp_replace(F.regexp_extract(name, r"(?:^|\D)(\d{6}[_-]\d{6})(?:\D|$)", 1), "-", "_")),
        F.lit("yyyyMMdd_HHmmss"),
    )
    return F.coalesce(long, short)


def session_takes(found: DataFrame, offsets: dict[str, float] | None = None, offset: float = 0.0, fallback: str | None = None) -> DataFrame:
    """Adds ``started``, ``day0`` and ``start``, seconds since the first day's midnight, with clock corrections.

    The time is that of the header, else of the name, else of the column ``fallback``.
    """
    told = F.try_to_timestamp(F.concat_ws(" ", "date", "time"), F.lit("yyyy-MM-dd HH:mm:ss"))
    rows = found.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("started", F.coalesce(told, stamp_in(F.col("name")), *([F.col(fallback)] if fallback else [])))
    first = rows.agg(F.to_date(F.min("started")).alias("day0"))
    own = F.coalesce(*[F.when(F.col("name") == k, F.lit(float(v))) for k, v in (offsets or {}).items()], F.lit(float(offset)))
    since = F.unix_timestamp("started") - F.unix_timestamp(F.col("day0").cast("timestamp"))
    return (
        rows.crossJoin(F.broadcast(first))
        .withColumn("start", since + own)
        .withColumn("duration", F.col("frames") / F.col("samplerate"))
    )
