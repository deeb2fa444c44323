"""Files as a Spark data source: ``spark.read.format("lodestone_files")`` and ``readStream``.

    spark.dataSource.register(FileSource)
    spark.read.format("lodestone_files").option("extensions", "md,html").load("/data/docs")
    spark.readStream.format("lodestone_files").load("/data/docs")      # new and changed files, as they come

Options: ``path``; ``extensions`` (comma-separated); ``recursive`` (true); ``content`` (true; false lists only);
``partitions`` (16); ``per_batch`` (1,000 files of a streaming batch, about: files of one time stay together);
``cache``, a folder for contents that were read: a file of the same path, size and time is read from
there the next time.

The driver lists names, sizes and times; tasks read the contents, files dealt out by size, the largest first. A stream's
offset is the modification time (microseconds) up to which files were given, so it is a number in the
checkpoint and not a list that grows; a file changed later comes again. A file whose time is younger than ``settle``
seconds (2) waits, for others of the same time may still be written.

Paths are those that the workers' own file system opens: shared folders of a cluster, or a mounted store.
``files.listing`` goes through Spark's binary reader for s3a.

Defined results: a folder that isn't there raises SourceError; a file that goes or can't be read between listing and reading has null
content and its ``problem``; an empty folder gives an empty result; links are not followed to folders.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from lodestone.errors import SourceError

SCHEMA = "name string, path string, size bigint, modified_at timestamp, content binary, problem string"
#: (path, size, microseconds of the last change)
File = tuple[str, int, int]


@dataclass
class Files(InputPartition):
    files: list[File]


class Listing:
    """What the options ask for."""

    def __init__(self, options: dict):
        if not options.get("path"):
            raise SourceError("a path is needed")
        self.path = options["path"].removeprefix("file://")
        self.extensions = tuple("." + x.strip().lower().lstrip(".") for x in options.get("extensions", "").split(",") if x.strip())
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.content = options.get("content", "true").lower() == "true"
        self.partitions, self.per_batch = int(options.get("partitions", 16)), int(options.get("per_batch", 1000))
        self.settle, self.cache = float(options.get("settle", 2)), options.get("cache", "").removeprefix("file://")

    def files(self) -> Iterator[File]:
        folders = [self.path]
        if not os.path.isdir(self.path):
            raise SourceError(f"{self.path} can't be listed")
        while folders:
            with os.scandir(folders.pop()) as entries:
                for e in entries:
                    if e.is_dir(follow_symlinks=False):
                        folders += [e.path] if self.recursive else []
                    elif e.is_file() and (not self.extensions or e.name.lower().endswith(self.extensions)):
                        at = e.stat()
                        yield e.path, at.st_size, at.st_mtime_ns // 1000

    def dealt(self, files: list[File]) -> list[Files]:
        """Files in as many partitions as the options say: the largest first, each to the one with the least bytes."""
        parts = [(0, i, []) for i in range(max(1, min(self.partitions, len(files))))]
        for f in sorted(files, key=lambda f: (-f[1], f[0])):
            size, i, held = heapq.heappop(parts)
            held.append(f)
            heapq.heappush(parts, (size + f[1], i, held))
        return [Files(held) for _, _, held in sorted(parts, key=lambda p: p[1])]

    def _kept(self, file: File) -> str:
        return os.path.join(self.cache, hashlib.sha256("\0".join(map(str, file)).encode()).hexdigest())

    def _content(self, file: File) -> bytes:
        if self.cache and os.path.exists(kept := self._kept(file)):
            with open(kept, "rb") as f:
                return f.read()
        with open(file[0], "rb") as f:
            content = f.read()
        if self.cache and len(content) == file[1]:
            os.makedirs(self.cache, exist_ok=True)
            own = f"{self._kept(file)}.{os.getpid()}.{time.time_ns()}"
            with open(own, "wb") as f:
                f.write(content)
            os.replace(own, self._kept(file))  # whole or not at all, whoever else writes it
        return content

    def rows(self, files: list[File]) -> Iterator[tuple]:
        for path, size, changed in files:
            content = problem = None
            if self.content:
                try:
                    content = self._content((path, size, changed))
                except OSError as e:
                    problem = f"{type(e).__name__}: {e.strerror}"
            yield os.path.basename(path), path, size, datetime.fromtimestamp(changed / 1e6, timezone.utc), content, problem


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.listing = Listing(options)

    def partitions(self) -> list[Files]:
        return self.listing.dealt(list(self.listing.files()))

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.listing.rows(partition.files)


class StreamReader(DataSourceStreamReader):
    """Batches by modification time; the files between two offsets are listed again, so a batch can be repeated."""

    def __init__(self, options: dict):
        self.listing, self.at = Listing(options), -1

    def initialOffset(self) -> dict:
        return {"changed": -1}

    def latestOffset(self) -> dict:
        until = (time.time() - self.listing.settle) * 1e6
        times = sorted(c for _, _, c in self.listing.files() if self.at < c <= until)
        if times:
            self.at = times[min(len(times), self.listing.per_batch) - 1]
        return {"changed": self.at}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        self.at = max(self.at, end["changed"])  # also after a restart
        found = [f for f in self.listing.files() if start["changed"] < f[2] <= end["changed"]]
        return self.listing.dealt(found) if found else []

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.listing.rows(partition.files)

    def commit(self, end: dict) -> None:
        """Nothing to do: the offset says it all."""


class FileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lodestone_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options))

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(dict(self.options))
