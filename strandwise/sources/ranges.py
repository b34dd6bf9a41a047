"""Files by byte ranges: which files a path names, and the records that begin in a range of one.

Files are opened with pyarrow's file systems (local, hdfs, s3, gs, abfs), in the tasks.
"""

from __future__ import annotations

import fnmatch
import gzip
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs

#: Bytes read at a time.
BLOCK = 4 << 20


class Found(NamedTuple):
    uri: str
    size: int
    #: nanoseconds
    changed: int


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def files_of(path: str) -> list[Found]:
    """The files that a path names: a file, all files of a folder, or those that match a pattern in the last part of the path. Names that
    begin with "_" or "." are left out, as Spark does."""
    path = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
    pattern = None
    if any(c in path.rsplit("/", 1)[-1] for c in "*?["):
        path, pattern = path.rsplit("/", 1)
    system, inner = opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    scheme = path[: path.index("://") + 3] if "://" in path else ""
    entries = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    out = []
    for x in entries:
        below = x.path[len(inner) :].strip("/").split("/")
        if x.type == fs.FileType.File and (info.type == fs.FileType.File or not any(part[:1] in "_." for part in below)) and (pattern is None or fnmatch.fnmatch(below[0], pattern)):
            out.append(Found(scheme + x.path, x.size, x.mtime_ns or 0))
    return sorted(out)


def ranges_of(file: Found, split: int) -> list[tuple[int, int]]:
    """Byte ranges of a file; a compressed one can't be split."""
    if file.uri.endswith(".gz"):
        return [(0, 1 << 62)]
    return [(a, min(a + split, file.size)) for a in range(0, file.size, split)]


def blocks(uri: str, start: int) -> Iterator[bytes]:
    system, path = opened(uri)
    if uri.endswith(".gz"):
        with system.open_input_file(path) as raw, gzip.GzipFile(fileobj=raw) as file:
            while data := file.read(BLOCK):
                yield data
        return
    with system.open_input_file(path) as file:
        file.seek(start)
        while data := file.read(BLOCK):
            yield data


def fasta_records(uri: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(byte place, bytes from behind the ">" on) of the records whose ">" lies in [start, end). A record is read to its end, wherever that is."""
    # One byte before the range says whether a ">" at its start begins a line; the file's start does.
    first = max(start - 1, 0)
    buffer, at = bytearray(b"\n" if start == 0 else b""), first - (start == 0)
    begun, scanned = None, 0  # where the record that is being read begins in the buffer
    for data in blocks(uri, first):
        buffer += data
        while (x := buffer.find(b"\n>", scanned)) >= 0:
            if begun is not None:
                yield at + begun - 1, bytes(buffer[begun:x])
                begun = None
            if at + x + 1 >= end:
                return
            begun = scanned = x + 2
        # Only what may still be needed stays: the record, or the last byte.
        scanned = max(len(buffer) - 1, begun or 0)
        drop = begun if begun is not None else scanned
        del buffer[:drop]
        at, scanned, begun = at + drop, scanned - drop, 0 if begun is not None else None
    if begun is not None:
        yield at + begun - 1, bytes(buffer[begun:])


def lines_from(uri: str, start: int) -> Iterator[tuple[int, bytes]]:
    """(byte place, line without its break) of the lines that begin at start or later."""
    first = max(start - 1, 0)
    at, rest, skip = first, b"", start > 0
    for data in blocks(uri, first):
        *whole, rest = (rest + data).split(b"\n")
        for line in whole:
            if skip:
                skip = False
            else:
                yield at, line.removesuffix(b"\r")
            at += len(line) + 1
    if rest and not skip:
        yield at, rest.removesuffix(b"\r")


def fastq_records(uri: str, start: int, end: int) -> Iterator[tuple[int, list[bytes]]]:
    """(byte place, header, bases, quality) of the four-line records whose "@" lies in [start, end). A quality may begin with "@" as well; the
    line after next begins with "+" only where a header is."""
    ahead: list[tuple[int, bytes]] = []
    together = False
    for place, line in lines_from(uri, start):
        if not ahead and (place >= end or (together and not line)):
            if place >= end:
                return
            continue
        ahead.append((place, line))
        if len(ahead) < 4:
            continue
        if together or (ahead[0][1][:1] == b"@" and ahead[2][1][:1] == b"+"):
            if ahead[0][0] >= end:
                return
            if not (ahead[0][1][:1] == b"@" and ahead[2][1][:1] == b"+"):
                raise ValueError(f"{uri}: no record of four lines at byte {ahead[0][0]}")
            together = True
            yield ahead[0][0], [ahead[0][1][1:], ahead[1][1], ahead[3][1]]
            ahead = []
        else:
            ahead.pop(0)
            if ahead[0][0] >= end:
                return
    # An empty quality at the end of a file may have no line of its own.
    if len(ahead) == 3 and ahead[0][0] < end and ahead[0][1][:1] == b"@" and ahead[2][1][:1] == b"+" and not ahead[1][1]:
        yield ahead[0][0], [ahead[0][1][1:], b"", b""]


def header_parts(header: bytes) -> tuple[str, str]:
    """What comes before the first white space, and what comes after it."""
    found = header.decode(errors="replace")
    name = found.split(None, 1)[0] if found[:1].strip() else ""
    return name, found[len(name) :].strip()


def batched(rows: Iterator[tuple], schema: pa.Schema, sizes: int, most: int = 16 << 20, count: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Rows as batches of so many bytes in the column ``sizes``, or so many rows."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[sizes])
        if size >= most or len(held) >= count:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
