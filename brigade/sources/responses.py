"""Stored responses as a data source: ``spark.read.format("responses")`` over WARC files, batch and stream, and a writer.

Files hold WARC records of type ``response``, plain or with each record a gzip member of its own
(``.warc.gz``). A plain file is read in ranges of ``splitBytes``, a compressed one as a whole, record by
record. A range begins at the first line in it that begins a record with a type and a length: for bodies
that hold whole records themselves set ``splitBytes`` above the files' sizes. Filters on host and status
are applied before bodies are taken up.
"""

from __future__ import annotations

import gzip
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

SCHEMA = "url string, host string, status int, status_text string, headers array<struct<name:string,value:string>>, resolved_url string, elapsed_ms long, fetched_at string, html string"
_HOST = re.compile(r"^https?://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
_MARK = b"WARC/1."


def _filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _files(uri: str) -> list[tuple[str, int]]:
    """(path, size) of the folder's files, or of the one file, in the order of their names."""
    from pyarrow import fs

    system, path = _filesystem(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return [(info.path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    hidden = lambda p: any(part[:1] in "._" for part in p[len(path) :].split("/") if part)
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not hidden(f.path) and f.path.endswith((".warc", ".warc.gz")))


def _fields(block: bytes) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in block.split(b"\n"):
        text = line.rstrip(b"\r").decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and out:  # a folded line goes on with the one before
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}")
        elif ":" in text:
            name, _, value = text.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def _unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0].strip() or b"0", 16)
        except ValueError:
            return body  # it wasn't chunked
        if not size:
            break
        out.append(body[end + 1 : end + 1 + size])
        at = body.find(b"\n", end + 1 + size) + 1
        if not at:
            break
    return b"".join(out)


def _head(source) -> tuple[list[tuple[str, str]], bytes]:
    """A record's fields and their bytes, up to the empty line."""
    lines = []
    while (line := source.readline()) not in (b"", b"\n", b"\r\n"):
        lines.append(line)
    return _fields(b"".join(lines)), b"".join(lines)


def records(source, start: int = 0, end: int | None = None) -> Iterator[tuple[dict, bytes]]:
    """(fields by lower-case names, content) of the records that begin from ``start`` and before ``end``
    of a file with readline, read, seek and tell."""
    source.seek(start)
    if start:  # to the first record that begins here; a content's own line may look like one, so its length must fit
        source.seek(start - 1)
        source.readline()
    while end is None or source.tell() < end:
        at = source.tell()
        line = source.readline()
        if not line:
            return
        if not line.startswith(_MARK):
            continue
        fields, _ = _head(source)
        named = {n.lower(): v for n, v in fields}
        if not named.get("content-length", "").isdigit() or "warc-type" not in named:
            source.seek(at + len(line))
            continue
        yield named, source.read(int(named["content-length"]))


def parsed(named: dict, content: bytes, wants=lambda host, status: True) -> tuple | None:
    """A row of SCHEMA from a response record; None for other records and those that aren't wanted."""
    url = named.get("warc-target-uri", "").strip("<>")
    if named.get("warc-type") != "response" or not url:
        return None
    found = _HOST.match(url)
    host = found[1].lower() if found else ""
    cut = re.search(rb"\r?\n\r?\n", content)
    head, body = (content[: cut.start()], content[cut.end() :]) if cut else (content, b"")
    first, _, rest = head.partition(b"\n")
    line = first.decode("latin-1").strip().split(" ", 2)
    status = int(line[1]) if len(line) > 1 and line[1].isdigit() and len(line[1]) < 6 else None
    if not wants(host, status):
        return None
    headers = _fields(rest)
    lower = {n.lower(): v for n, v in headers}
    if "chunked" in lower.get("transfer-encoding", "").lower():
        body = _unchunked(body)
    if "gzip" in lower.get("content-encoding", "").lower():
        try:
            body = gzip.decompress(body)
        except (OSError, EOFError):
            pass
    charset = _CHARSET.search(lower.get("content-type", ""))
    try:
        html = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        html = body.decode("utf-8", "replace")
    elapsed = named.get("warc-elapsed-ms", "")
    return url, host, status, line[2] if len(line) > 2 else "", [{"name": n, "value": v} for n, v in headers], named.get("warc-resolved-uri"), int(elapsed) if elapsed.isdigit() else None, named.get("warc-date"), html


@dataclass
class Part(InputPartition):
    path: str
    start: int
    end: int | None

    def __init__(self, path: str, start: int, end: int | None):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class _Reading:
    """What batch and stream share: the split of files and the reading of a part."""

    def __init__(self, options: dict):
        self.uri = options["path"]
        self.split = int(options.get("splitBytes", 64 << 20))
        self.hosts: set[str] | None = None
        self.statuses: set[int] | None = None

    def split_up(self, files: list[tuple[str, int]]) -> list[Part]:
        out = []
        for path, size in files:
            if path.endswith(".gz"):
                out.append(Part(path, 0, None))
            else:
                out += [Part(path, at, min(at + self.split, size)) for at in range(0, max(size, 1), self.split)]
        return out

    def wants(self, host: str, status: int | None) -> bool:
        return (self.hosts is None or host in self.hosts) and (self.statuses is None or status in self.statuses)

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(self.uri)
        rows, size = [], 0
        with system.open_input_file(part.path) as raw:
            source = io.BufferedReader(raw, 1 << 20) if not part.path.endswith(".gz") else gzip.GzipFile(fileobj=raw)
            for named, content in records(source, part.start, part.end):
                row = parsed(named, content, self.wants)
                if row is not None:
                    rows.append(row)
                    size += len(content)
                    if size > 4 << 20 or len(rows) >= 4096:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)


_TYPES = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])), pa.string(), pa.int64(), pa.string(), pa.string()]
_NAMES = ["url", "host", "status", "status_text", "headers", "resolved_url", "elapsed_ms", "fetched_at", "html"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _TYPES)], names=_NAMES)


class Reader(_Reading, DataSourceReader):
    def pushFilters(self, filters: list[Filter]):
        """Takes equality and lists on host and status, and that they aren't null; yields the others."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("host",):
                self.hosts = values if self.hosts is None else self.hosts & values
            elif values is not None and f.attribute == ("status",):
                self.statuses = values if self.statuses is None else self.statuses & values
            elif not (isinstance(f, IsNotNull) and f.attribute == ("host",)):
                yield f

    def partitions(self) -> list[Part]:
        return self.split_up(_files(self.uri))


class StreamReader(_Reading, DataSourceStreamReader):
    """New files as they appear, in the order of their names, which must rise: the offset is the last name
    read. A file must be complete when it gets its name."""

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max((p for p, _ in _files(self.uri)), default="")}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.split_up([(p, n) for p, n in _files(self.uri) if start["after"] < p <= end["after"]])

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    draft: str
    name: str
    rows: int


class Writer(DataSourceWriter):
    """Each task writes a file under a hidden name; files get their names when all tasks are through."""

    def __init__(self, options: dict, overwrite: bool):
        self.uri, self.overwrite = options["path"], overwrite
        self.compressed = options.get("compression", "") == "gzip"
        self.job = uuid.uuid4().hex

    def write(self, rows) -> Written:
        system, path = _filesystem(self.uri)
        task = TaskContext.get()
        name = f"{self.job}-{task.partitionId():06d}.warc{'.gz' if self.compressed else ''}"
        draft = f"{path}/_drafts-{self.job}/{task.taskAttemptId()}-{name}"
        system.create_dir(draft.rpartition("/")[0], recursive=True)
        n = 0
        with system.open_output_stream(draft, compression=None) as out:
            for row in rows:
                record = _record(row.asDict())
                out.write(gzip.compress(record, mtime=0) if self.compressed else record)
                n += 1
        return Written(draft, name, n)

    def commit(self, messages) -> None:
        system, path = _filesystem(self.uri)
        done = [m for m in messages if m is not None]
        old = [p for p, _ in _files(self.uri)] if self.overwrite and done else []
        for m in done:
            if m.rows:
                system.move(m.draft, f"{path}/{m.name}")
        for p in old:
            system.delete_file(p)
        self._clean(system, path)

    def abort(self, messages) -> None:
        self._clean(*_filesystem(self.uri))

    def _clean(self, system, path: str) -> None:
        from pyarrow import fs

        drafts = f"{path}/_drafts-{self.job}"
        if system.get_file_info(drafts).type == fs.FileType.Directory:
            system.delete_dir(drafts)


def _record(row: dict) -> bytes:
    """A response record of a row that has url, status and html, and may have SCHEMA's other columns."""
    body = (row.get("html") or "").encode()
    plain = lambda v: re.sub(r"[\r\n]+", " ", str(v))
    left = ("content-length", "content-type", "transfer-encoding", "content-encoding")
    headers = [(h["name"], h["value"]) for h in row.get("headers") or [] if h["name"] and h["name"].lower() not in left]
    types = [h["value"] for h in row.get("headers") or [] if h["name"] and h["name"].lower() == "content-type"]
    kind = re.sub(r";?\s*charset\s*=[^;]*", "", types[-1]) if types else "text/html"
    lines = [f"HTTP/1.1 {row.get('status') or 0} {plain(row.get('status_text') or '')}".rstrip(" "), f"Content-Type: {plain(kind)}; charset=utf-8", *(f"{plain(n)}: {plain(v)}" for n, v in headers)]
    content = "\r\n".join(lines).encode() + b"\r\n\r\n" + body
    named = [("WARC-Type", "response"), ("WARC-Target-URI", row["url"]), ("WARC-Date", row.get("fetched_at")), ("WARC-Resolved-URI", row.get("resolved_url")), ("WARC-Elapsed-Ms", row.get("elapsed_ms")), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(content))]
    return b"WARC/1.0\r\n" + "".join(f"{n}: {plain(v)}\r\n" for n, v in named if v is not None).encode() + b"\r\n" + content + b"\r\n\r\n"


class Responses(DataSource):
    @classmethod
    def name(cls) -> str:
        return "responses"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Responses)
