"""ZIP archives by ranges: the central directory is read from the end of a file, and each member is a task that inflates it as a stream.

Neither an archive nor a member is held whole: a task keeps one chunk of
compressed bytes, one of text, and the lines of a batch. Members are stored or
deflated; large archives (ZIP64) are read, encrypted members are refused, and a
member whose checksum differs is an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cairnfield.sources import files

SCHEMA = "archive STRING, name STRING, pos BIGINT, value STRING"
_ARROW = pa.schema([("archive", pa.string()), ("name", pa.string()), ("pos", pa.int64()), ("value", pa.string())])
BATCH_BYTES = 4 << 20
# Fixed values of the format: signatures, and the longest comment after the end record.
END, END64, PLACE64, ENTRY, LOCAL, COMMENT = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04", 65_535
STORED, DEFLATED = 0, 8


class Member(NamedTuple):
    name: str
    method: int
    flags: int
    crc: int
    packed: int
    size: int
    offset: int


def _wide(extra: bytes, size: int, packed: int, offset: int) -> tuple[int, int, int]:
    """Sizes and offset with those that didn't fit taken from the extra field of large archives."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            numbers = list(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            return tuple(numbers.pop(0) if x == 0xFFFFFFFF and numbers else x for x in (size, packed, offset))
        at += 4 + n
    return size, packed, offset


def directory(source) -> list[Member]:
    """Members of an open archive, by its central directory."""
    whole = source.size()
    tail_at = max(0, whole - COMMENT - 22)
    source.seek(tail_at)
    tail = source.read(whole - tail_at)
    end = tail.rfind(END)
    if end < 0:
        raise ValueError("no ZIP archive: it has no end record")
    entries, size, start = struct.unpack_from("<HII", tail, end + 10)
    if 0xFFFF in (entries,) or 0xFFFFFFFF in (size, start):
        place = tail.rfind(PLACE64, 0, end)
        if place >= 0:
            source.seek(struct.unpack_from("<Q", tail, place + 8)[0])
            record = source.read(56)
            if record[:4] != END64:
                raise ValueError("broken ZIP archive: no end record where the locator points")
            entries, size, start = struct.unpack_from("<QQQ", record, 32)
    source.seek(start)
    raw, at, out = source.read(size), 0, []
    for _ in range(entries):
        if raw[at : at + 4] != ENTRY:
            raise ValueError("broken ZIP archive: bad header in the central directory")
        flags, method, _, _, crc, packed, full, n_name, n_extra, n_comment = struct.unpack_from("<HHHHIIIHHH", raw, at + 8)
        offset = struct.unpack_from("<I", raw, at + 42)[0]
        name = raw[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
        full, packed, offset = _wide(raw[at + 46 + n_name : at + 46 + n_name + n_extra], full, packed, offset)
        out.append(Member(name, method, flags, crc, packed, full, offset))
        at += 46 + n_name + n_extra + n_comment
    return out


def inflated(source, member: Member) -> Iterator[bytes]:
    """Chunks of a member's content."""
    if member.flags & 1:
        raise ValueError(f"{member.name}: encrypted")
    if member.method not in (STORED, DEFLATED):
        raise ValueError(f"{member.name}: unsupported compression method {member.method}")
    source.seek(member.offset)
    head = source.read(30)
    if head[:4] != LOCAL:
        raise ValueError(f"{member.name}: bad local header")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    source.seek(member.offset + 30 + n_name + n_extra)
    left, crc, unpack = member.packed, 0, zlib.decompressobj(-15)
    while left or (member.method == DEFLATED and unpack.unconsumed_tail):
        chunk = b""
        if member.method == DEFLATED and unpack.unconsumed_tail:
            chunk = unpack.decompress(unpack.unconsumed_tail, files.CHUNK)
        else:
            raw = source.read(min(files.CHUNK, left))
            if not raw:
                raise ValueError(f"{member.name}: cut off")
            left -= len(raw)
            chunk = unpack.decompress(raw, files.CHUNK) if member.method == DEFLATED else raw
        crc = zlib.crc32(chunk, crc)
        if chunk:
            yield chunk
    if member.method == DEFLATED and (chunk := unpack.flush()):
        crc = zlib.crc32(chunk, crc)
        yield chunk
    if crc != member.crc:
        raise ValueError(f"{member.name}: checksum differs")


class ArchiveMember(InputPartition):
    def __init__(self, archive: str, member: Member) -> None:
        super().__init__((archive, member.name))
        self.archive, self.member = archive, member


class MemberReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.suffix = options["path"], options.get("suffix", ".csv").lower()
        self.first = options.get("fallback", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in files.listed(self.path):
            system, own = files.store(path)
            with system.open_input_file(own) as source:
                members = [m for m in directory(source) if not m.name.endswith("/")]
            chosen = [m for m in members if m.name.lower().endswith(self.suffix)]
            out += [ArchiveMember(path, m) for m in chosen or (members[:1] if self.first else [])]
        return out

    def read(self, part: ArchiveMember) -> Iterator[pa.RecordBatch]:
        system, own = files.store(part.archive)
        with system.open_input_file(own) as source:
            held, size, pos = [], 0, 0
            for line in files.lines_of(inflated(source, part.member)):
                held.append(line)
                size += len(line) + 16
                if size >= BATCH_BYTES:
                    yield self._batch(part, held, pos)
                    pos, held, size = pos + len(held), [], 0
            if held:
                yield self._batch(part, held, pos)

    def _batch(self, part: ArchiveMember, held: list[str], pos: int) -> pa.RecordBatch:
        n = len(held)
        return pa.RecordBatch.from_arrays([pa.array([part.archive] * n), pa.array([part.member.name] * n), pa.array(range(pos, pos + n), pa.int64()), pa.array(held, pa.string())], schema=_ARROW)


class ZipLines(DataSource):
    """spark.read.format("zip_lines"): options path (an archive or a folder of them), suffix of members, fallback (the first member where none has the suffix)."""

    @classmethod
    def name(cls) -> str:
        return "zip_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MemberReader:
        return MemberReader(dict(self.options))


def read_zip_lines(spark: SparkSession, path: str, suffix: str = ".csv", **options) -> DataFrame:
    """archive, name, pos (from 0 in each member) and value of the lines of members whose names end so."""
    spark.dataSource.register(ZipLines)
    return spark.read.format("zip_lines").options(suffix=suffix, **options).load(path)
