"""Landing folders as a Python data source, for batch and stream.

Tasks list the folder themselves, each its own share of the names, so that no name goes
through the driver and files of no bytes are there like all others.  The stream keeps, for
each share, which names it has handed out; a batch that runs again hands out the same
files.

    spark.dataSource.register(LandingSource)
    spark.read.format("landing").option("head", 4).load(folder)

Options: ``path``; ``head``, bytes to read of the beginning of each file (0); ``max_bytes``,
size above which a file is not opened (none); ``shares``, into how many parts the names are
dealt (16); and for streams ``log``, the folder of what was handed out, which belongs to one
stream and lies beside its checkpoint.
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
)

NAME = "landing"
SCHEMA = "path STRING, filename STRING, size_bytes BIGINT, modified_us BIGINT, head BINARY"

#: Rows of an Arrow batch, and batches of names in a share's log before they are merged.
_ROWS, _LOGGED = 1000, 64


def _as_uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def _opened(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(_as_uri(folder))


def _of_share(path: str, shares: int) -> int:
    return zlib.crc32(path.encode("utf-8", "surrogateescape")) % shares


def listed(folder: str, share: int, shares: int) -> Iterator:
    """Files of one share, with all that lies below the folder.

    The folder and the folders directly below it are listed by every share, which keeps the
    files of its own names; what lies deeper is listed by one share for each folder there.
    """
    from pyarrow import fs

    source, root = _opened(folder)

    def inside(path: str, recursive: bool) -> list:
        return source.get_file_info(fs.FileSelector(path, recursive=recursive, allow_not_found=True))

    def files(path: str, depth: int) -> Iterator:
        for info in inside(path, False):
            own = _of_share(info.path, shares) == share
            if info.type == fs.FileType.File:
                if own:
                    yield info
            elif depth < 1:
                yield from files(info.path, depth + 1)
            elif own:
                yield from (x for x in inside(info.path, True) if x.type == fs.FileType.File)

    return files(root, 0)


@dataclass
class Share(InputPartition):
    """One part of the names, between two offsets of a stream."""

    number: int
    start: int = 0
    end: int = 0


class _Files:
    """What batch and stream have in common."""

    def __init__(self, options: dict):
        self.folder = options["path"]
        self.head = int(options.get("head", 0))
        self.most = int(options["max_bytes"]) if "max_bytes" in options else None
        self.shares = int(options.get("shares", 16))
        self.log = options.get("log")

    def batches(self, infos: Iterator) -> Iterator:
        """Arrow batches of files with their beginnings, where these are wanted."""
        import pyarrow as pa

        source, _ = _opened(self.folder)
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            paths, names, sizes, times, heads = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(paths, pa.string()),
                    pa.array(names, pa.string()),
                    pa.array(sizes, pa.int64()),
                    pa.array(times, pa.int64()),
                    pa.array(heads, pa.binary()),
                ],
                ["path", "filename", "size_bytes", "modified_us", "head"],
            )

        for info in infos:
            beginning = None
            if self.head and (self.most is None or info.size <= self.most):
                with source.open_input_stream(info.path) as stream:
                    beginning = stream.read(self.head)
            changed = None if info.mtime_ns is None else info.mtime_ns // 1000
            rows.append((info.path, info.base_name, info.size, changed, beginning))
            if len(rows) == _ROWS:
                yield batch()
                rows = []
        if rows:
            yield batch()


class LandingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = _Files(options)

    def partitions(self) -> list[Share]:
        return [Share(number) for number in range(self.files.shares)]

    def read(self, partition: Share) -> Iterator:
        return self.files.batches(listed(self.files.folder, partition.number, self.files.shares))


class LandingStream(DataSourceStreamReader):
    """Offsets are times of listings; the log says which names each listing found new.

    A task writes the names of its share under the offset before it hands any of them out.
    Where that entry is there already, the batch is running again and takes the names from
    it.  Tasks of this source must not be run twice at once (no speculative execution).
    """

    def __init__(self, options: dict):
        self.files = _Files(options)
        if not self.files.log:
            raise ValueError("a stream of files needs the option 'log'")

    def initialOffset(self) -> dict:
        return {"listed": 0}

    def latestOffset(self) -> dict:
        return {"listed": time.time_ns()}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        if start["listed"] == end["listed"]:
            return []
        self._keep_shares()
        return [Share(n, start["listed"], end["listed"]) for n in range(self.files.shares)]

    def _keep_shares(self) -> None:
        """The number of shares that the log was made with, which can't change."""
        store, root = _opened(self.files.log)
        place = f"{root}/shares"
        store.create_dir(root, recursive=True)
        if store.get_file_info(place).is_file:
            self.files.shares = int(_text(store, place))
        else:
            _put(store, place, str(self.files.shares))

    def read(self, partition: Share) -> Iterator:
        from pyarrow import fs

        store, root = _opened(self.files.log)
        own = f"{root}/share-{partition.number:04d}"
        store.create_dir(own, recursive=True)
        entries = sorted(
            int(info.base_name)
            for info in store.get_file_info(fs.FileSelector(own))
            if info.base_name.isdigit()
        )
        if partition.end in entries:
            wanted = set(json.loads(_text(store, f"{own}/{partition.end}")))
        else:
            wanted = None
        before = [entry for entry in entries if entry <= partition.start]
        found = listed(self.files.folder, partition.number, self.files.shares)
        if wanted is None:
            seen = {name for entry in before for name in json.loads(_text(store, f"{own}/{entry}"))}
            new = [info for info in found if info.path not in seen]
            _put(store, f"{own}/{partition.end}", json.dumps([info.path for info in new]))
            if len(before) > _LOGGED:
                _put(store, f"{own}/{before[-1]}", json.dumps(sorted(seen)))
                for entry in before[:-1]:
                    store.delete_file(f"{own}/{entry}")
        else:
            new = [info for info in found if info.path in wanted]
        return self.files.batches(iter(new))


def _text(store, path: str) -> str:
    with store.open_input_stream(path) as stream:
        return stream.read().decode("utf-8")


def _put(store, path: str, text: str) -> None:
    """Write a small file so that it is there as a whole or not at all."""
    folder, _, name = path.rpartition("/")
    private = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(private) as stream:
        stream.write(text.encode("utf-8"))
    store.move(private, path)


class LandingSource(DataSource):
    """Files of a folder and of all folders below it, empty ones included."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LandingReader:
        return LandingReader(self.options)

    def streamReader(self, schema) -> LandingStream:
        return LandingStream(self.options)


def scan(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    """``path, filename, size_bytes, modified_us, head`` of every file as it is now."""
    spark.dataSource.register(LandingSource)
    return spark.read.format(NAME).options(**_shares(spark, options)).load(folder)


def stream(spark: SparkSession, folder: str, log: str, **options: object) -> DataFrame:
    """The same for files as they arrive, each handed out once for a ``log``."""
    spark.dataSource.register(LandingSource)
    return spark.readStream.format(NAME).options(log=log, **_shares(spark, options)).load(folder)


def _shares(spark: SparkSession, options: dict) -> dict[str, str]:
    named = {"shares": 2 * spark.sparkContext.defaultParallelism, **options}
    return {key: str(value) for key, value in named.items()}
