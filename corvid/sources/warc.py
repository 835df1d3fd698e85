"""WARC files as a Spark data source that reads a file in several tasks.

A gzipped WARC file is a row of gzip members, one a record as a rule. A file is cut into stretches of bytes; a task looks for
the first member that begins in its stretch and reads on to the last one that does, so each member is read once. Of a file
that is one member, or isn't gzipped, the task of the first stretch reads all, and the others none. Nothing but a record and
a batch is held in memory.
"""

from __future__ import annotations

import fnmatch
import gzip
import io
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Bytes of a file to a task, and of html to a batch, about.
SPLIT = 64 << 20
BATCH = 16 << 20
_READ = 1 << 20
#: Bytes that a member begins with; what they inflate to must begin as a record does.
_MEMBER, _RECORD = b"\x1f\x8b\x08", b"WARC/"
SCHEMA = "id string, url string, type string, html string"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within; raises if there is none for its scheme."""
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1)) if urlsplit(path).scheme else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of the file, of the files in or below the folder, or of those whose names the pattern in the last part names."""
    folder, name = posixpath.split(path)
    pattern = name if any(c in name for c in "*?[") else None
    system, inner = opened(folder if pattern else path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=pattern is None))
    keep = lambda f: f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")) and (pattern is None or fnmatch.fnmatch(f.base_name, pattern))
    return sorted((f.path, f.size) for f in found if keep(f))


class Member(io.RawIOBase):
    """The inflated bytes of the gzip member that begins at a place of a file; `end` is where it ended."""

    def __init__(self, file, start: int):
        self.file, self.start, self.at, self.end = file, start, start, None
        self.inflate, self.kept = zlib.decompressobj(31), b""
        file.seek(start)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.kept and self.end is None:
            raw = self.inflate.unconsumed_tail
            if not raw:
                raw = self.file.read(_READ)
                self.at += len(raw)
            try:
                self.kept = self.inflate.decompress(raw, _READ)
            except zlib.error:  # damaged: what came before counts, and members may begin anywhere after
                self.end = self.start + len(_MEMBER)
                break
            if self.inflate.eof or not (raw or self.kept):
                self.end = self.at - len(self.inflate.unused_data)
        n = min(len(into), len(self.kept))
        into[:n], self.kept = self.kept[:n], self.kept[n:]
        return n


def begins(file, place: int) -> bool:
    """Whether a member that begins there holds a record."""
    return io.BufferedReader(Member(file, place)).read(len(_RECORD)) == _RECORD


def first_member(file, start: int, stop: int) -> int | None:
    """The first place from start and before stop where a member begins."""
    at, tail = start, b""
    while at < stop:
        file.seek(at)
        got = file.read(min(_READ, stop - at) + len(_MEMBER) - 1)
        if not got:
            return None
        k = got.find(_MEMBER)
        while k >= 0 and at + k < stop:
            if begins(file, at + k):
                return at + k
            k = got.find(_MEMBER, k + 1)
        at += _READ
    return None


def records(stream) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """Headers, HTTP headers and body of each record; one that is cut off is passed over."""

    def headers() -> dict[str, str]:
        out = {}
        while (line := stream.readline().strip()) != b"":
            name, _, value = line.decode("utf-8", "replace").partition(":")
            out[name.strip().lower()] = value.strip()
        return out

    while line := stream.readline():
        if not line.startswith(_RECORD):
            continue
        record = headers()
        size = int(record.get("content-length", 0))
        body = stream.read(size)
        if len(body) < size:
            return
        head, _, rest = body.partition(b"\r\n\r\n")
        http = {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
        yield record, http, rest


class Stretch(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.type = options["path"], options.get("type", "response")
        self.split = int(options.get("split", SPLIT))

    def partitions(self) -> list[Stretch]:
        out = []
        for path, size in listed(self.path):
            step = self.split if self.split > 0 else max(size, 1)
            out += [Stretch(path, at, min(size, at + step)) for at in range(0, size, step)]
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path.rpartition("/")[0] if "*" in self.path else self.path)
        rows, size = [], 0
        with system.open_input_file(partition.path) as file:
            for record, http, body in self._within(file, partition):
                if record.get("warc-type") != self.type or (self.type == "response" and not http.get("content-type", "").startswith("text/html")):
                    continue
                rows.append((record.get("warc-record-id"), record.get("warc-target-uri", ""), self.type, body.decode("utf-8", "ignore")))
                size += len(body)
                if size > BATCH:
                    yield self._pack(rows)
                    rows, size = [], 0
        yield self._pack(rows)

    def _within(self, file, stretch: Stretch) -> Iterator[tuple]:
        file.seek(0)
        if file.read(2) != _MEMBER[:2]:
            if stretch.start == 0:
                file.seek(0)
                yield from records(io.BufferedReader(file))
            return
        at = first_member(file, stretch.start, stretch.stop)
        while at is not None and at < stretch.stop:
            member = Member(file, at)
            yield from records(stream := io.BufferedReader(member, _READ))
            while stream.read(_READ):  # what is left of a member that was cut off
                pass
            after = member.end
            file.seek(after)
            at = after if file.read(3) == _MEMBER else first_member(file, after, stretch.stop)

    def _pack(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.string()) for k in range(4)], ["id", "url", "type", "html"])


class Done(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class WarcWriter(DataSourceWriter):
    """A gzipped file a task, a member a record; files get their names, which readers look for, once all tasks are done."""

    def __init__(self, options):
        self.path = options["path"]

    def write(self, rows: Iterator) -> Done:
        system, inner = opened(self.path)
        system.create_dir(inner, recursive=True)
        target = f"{inner}/_{uuid.uuid4().hex}.warc.gz"
        with system.open_output_stream(target, compression=None) as out:
            for r in rows:
                body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n{r['html'] or ''}".encode()
                head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: {r['id'] or ''}\r\nWARC-Target-URI: {r['url'] or ''}\r\nContent-Length: {len(body)}\r\n\r\n"
                out.write(gzip.compress(head.encode() + body + b"\r\n\r\n", mtime=0))
        return Done(target)

    def commit(self, messages: list[Done | None]) -> None:
        system, _ = opened(self.path)
        for m in messages:
            if m is not None:
                folder, name = posixpath.split(m.path)
                system.move(m.path, f"{folder}/{name[1:]}")

    def abort(self, messages: list[Done | None]) -> None:
        system, _ = opened(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.path)


class WarcSource(DataSource):
    """Options: `path`; `type` of the records, the only ones that are decoded (response: those with HTML); `split`, bytes to a
    task. 0 reads each file in one task: where a stretch begins inside a record that itself holds a gzipped WARC file,
    stored as it is, that file's records are taken for the outer file's."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("warc files are only added: write in mode append")
        return WarcWriter(self.options)
