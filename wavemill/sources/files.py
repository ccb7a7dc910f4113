"""Archives, arrays and audio files as data sources of their own.

They reach folders that every executor has mounted at the same place (a path or
a ``file:`` URI); for other stores the readers in ``media`` go through Spark.

``archive_members``: ``archive, member, content`` of zip and tar files.  The
driver reads directories and headers only; members are dealt to tasks by their
sizes, so one archive is read by several tasks, each of which seeks to its own
members.  A compressed tar cannot be entered in the middle and is one task.

``npy_segments``: ``path, segment, samples`` of ``.npy`` files, read by rows
through a memory map.

``wav_files``: writes rows ``name, samples`` as WAV files below a folder.  Tasks
write under temporary names; the files get their names when all tasks are done,
and an ended job leaves none.
"""

from __future__ import annotations

import fnmatch
import os
import tarfile
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .media import encode_wav

#: Bytes of members, or of segments, that a task reads on average.
TASK_BYTES = 32 << 20


def local(path: str) -> str:
    if "://" not in path and not path.startswith("file:"):
        return path
    parts = urlparse(path)
    if parts.scheme != "file":
        raise ValueError(f"{path}: only folders that all executors have mounted")
    return unquote(parts.path)


def found(path: str, patterns: tuple[str, ...]) -> list[str]:
    """The file itself, or the matching files under a folder, sorted."""
    path = local(path)
    if os.path.isfile(path):
        return [path]
    if not os.path.isdir(path):
        raise FileNotFoundError(path)
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if any(fnmatch.fnmatch(f, p) for p in patterns))


@dataclass
class Members(InputPartition):
    archive: str
    kind: str
    members: list[tuple]


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.bytes = options["path"], int(options.get("taskbytes", TASK_BYTES))

    def _dealt(self, archive: str, kind: str, members: list[tuple], size) -> Iterator[Members]:
        held, total = [], 0
        for m in members:
            held.append(m)
            total += size(m)
            if total >= self.bytes:
                yield Members(archive, kind, held)
                held, total = [], 0
        if held:
            yield Members(archive, kind, held)

    def partitions(self) -> list[Members]:
        out: list[Members] = []
        for a in found(self.path, ("*.zip", "*.tar", "*.tar.gz", "*.tgz")):
            if zipfile.is_zipfile(a):
                with zipfile.ZipFile(a) as z:
                    names = [(m.filename, m.compress_size) for m in z.infolist() if not m.is_dir()]
                out += self._dealt(a, "zip", names, lambda m: m[1])
            else:
                with open(a, "rb") as f:
                    packed = f.read(2) == b"\x1f\x8b"
                if packed:
                    out.append(Members(a, "stream", []))
                    continue
                with tarfile.open(a, "r:") as t:
                    places = [(m.name, m.offset_data, m.size) for m in t if m.isreg() and not m.issparse()]
                out += self._dealt(a, "tar", places, lambda m: m[2])
        return out or [Members("", "none", [])]

    def read(self, partition: Members) -> Iterator[tuple]:
        if partition.kind == "zip":
            with zipfile.ZipFile(partition.archive) as z:
                for name, _ in partition.members:
                    yield partition.archive, name, z.read(name)
        elif partition.kind == "tar":
            with open(partition.archive, "rb") as f:
                for name, at, size in partition.members:
                    f.seek(at)
                    yield partition.archive, name, f.read(size)
        elif partition.kind == "stream":
            with tarfile.open(partition.archive, "r|gz") as t:
                for m in t:
                    if m.isreg():
                        yield partition.archive, m.name, t.extractfile(m).read()


class ArchiveMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return "archive string, member string, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(dict(self.options))


@dataclass
class Rows(InputPartition):
    path: str
    start: int
    stop: int


class NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.bytes = options["path"], int(options.get("taskbytes", TASK_BYTES))

    def partitions(self) -> list[Rows]:
        out = []
        for p in found(self.path, ("*.npy",)):
            a = np.load(p, mmap_mode="r", allow_pickle=False)
            n = len(a) if a.ndim > 1 else 1
            step = max(1, self.bytes // max(1, a.nbytes // max(1, n)))
            out += [Rows(p, k, min(n, k + step)) for k in range(0, n, step)]
        return out or [Rows("", 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition.path:
            a = np.load(partition.path, mmap_mode="r", allow_pickle=False)
            a = a if a.ndim > 1 else a[None]
            for k in range(partition.start, partition.stop):
                x = np.asarray(a[k], np.float64).ravel()
                yield pa.RecordBatch.from_arrays([pa.array([partition.path]), pa.array([k], pa.int64()), pa.array([x], pa.list_(pa.float64()))], ["path", "segment", "samples"])


class NpySegments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy_segments"

    def schema(self) -> str:
        return "path string, segment long, samples array<double>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return NpyReader(dict(self.options))


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class WavWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.folder, self.rate = local(options["path"]), int(options.get("rate", 16_000))
        self.pending = os.path.join(self.folder, f".pending-{uuid.uuid4().hex}")

    def write(self, rows: Iterator[Row]) -> Written:
        place, out = os.path.join(self.pending, uuid.uuid4().hex), []
        os.makedirs(place, exist_ok=True)
        for k, r in enumerate(rows):
            if r["name"] is None or r["samples"] is None:
                continue
            name = os.path.normpath(r["name"])
            if os.path.isabs(name) or name.split(os.sep)[0] == "..":
                raise ValueError(f"{name} leaves the folder")
            with open(held := os.path.join(place, f"{k:08}.wav"), "wb") as f:
                f.write(encode_wav(np.asarray(r["samples"], np.float64), self.rate))
            out.append((held, name))
        return Written(out)

    def _clear(self) -> None:
        for d, _, names in os.walk(self.pending, topdown=False):
            for f in names:
                os.remove(os.path.join(d, f))
            os.rmdir(d)

    def commit(self, messages: list[Written | None]) -> None:
        """Only the files of the attempts that count get their names."""
        done = [x for m in messages if m for x in m.files]
        names = [n for _, n in done]
        if len(set(names)) < len(names):
            self._clear()
            raise ValueError("two rows have one name")
        for held, name in done:
            target = os.path.join(self.folder, name)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            os.replace(held, target)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()


class WavFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav_files"

    def schema(self) -> str:
        return "name string, samples array<double>"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WavWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the sources known to a session by their names."""
    for source in (ArchiveMembers, NpySegments, WavFiles):
        spark.dataSource.register(source)
