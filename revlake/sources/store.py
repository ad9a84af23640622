"""Object stores that are not file systems, as sources, streams and a sink of Spark's Python Data Source API.

A store tells its folders, lists one of them, and reads objects of one. The driver asks for folders only; listing and
reading run in tasks, one folder a partition of a listing, and contents are dealt anew by keys, so that a large folder is
read by many tasks. ArchiveStore is one such store: objects are members of zip archives on any file system that Arrow knows.
"""

from __future__ import annotations

import datetime
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage

LISTING = "folder string, key string, size long, mtime timestamp"
UTC = datetime.timezone.utc
EPOCH = datetime.datetime(1970, 1, 1, tzinfo=UTC)
#: Bytes of contents that one Arrow batch holds, beyond its last object.
BATCH_BYTES = 16 << 20


class Store:
    """What a store has to tell; times are aware datetimes in UTC."""

    def folders(self) -> list[str]:
        raise NotImplementedError

    def list(self, folder: str) -> Iterator[tuple[str, int, datetime.datetime]]:
        """(key, size, mtime) of a folder's objects; contents are not read."""
        raise NotImplementedError

    def read(self, folder: str, keys: list[str]) -> Iterator[bytes]:
        """The contents of the keys, in their order."""
        raise NotImplementedError


class ArchiveStore(Store):
    """Zip archives below a root; only the directory at an archive's end is read for a listing. Times have
    two seconds' resolution; of equal keys in one archive the last is read."""

    def __init__(self, root: str):
        self.fs, self.root = arrow_fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")

    def folders(self):
        found = self.fs.get_file_info(arrow_fs.FileSelector(self.root, allow_not_found=True))
        return sorted(f.base_name for f in found if f.base_name.endswith(".zip"))

    def open(self, folder):
        return zipfile.ZipFile(self.fs.open_input_file(f"{self.root}/{folder}"))

    def list(self, folder):
        with self.open(folder) as archive:
            for info in archive.infolist():
                yield info.filename, info.file_size, datetime.datetime(*info.date_time, tzinfo=UTC)

    def read(self, folder, keys):
        with self.open(folder) as archive:
            for key in keys:
                yield archive.read(key)


@dataclass
class Folder(InputPartition):
    name: str
    since: datetime.datetime | None = None
    until: datetime.datetime | None = None


def rows_of(store: Store, part: Folder, tests: list) -> Iterator[tuple]:
    for key, size, mtime in store.list(part.name):
        row = {"folder": part.name, "key": key, "size": size, "mtime": mtime}
        if (part.since is None or mtime >= part.since) and (part.until is None or mtime < part.until) and all(passes(t, row) for t in tests):
            yield part.name, key, size, mtime


KNOWN = (EqualTo, In, StringStartsWith, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)


def passes(test, row: dict) -> bool:
    """Whether a pushed filter holds; no column of a listing is null."""
    have, want = row[test.attribute[0]], test.value
    if isinstance(test, EqualTo):
        return have == want
    if isinstance(test, In):
        return have in want
    if isinstance(test, StringStartsWith):
        return have.startswith(want)
    # strings as Spark orders them, by UTF-8 bytes
    a, b = (have.encode(), want.encode()) if isinstance(have, str) else (have, want)
    if isinstance(test, GreaterThan):
        return a > b
    if isinstance(test, GreaterThanOrEqual):
        return a >= b
    return a < b if isinstance(test, LessThan) else a <= b


def pushable(test) -> bool:
    """Comparisons of strings and sizes are taken over; those of times stay Spark's, whose session zone they depend on."""
    return isinstance(test, KNOWN) and test.attribute[0] in ("folder", "key", "size") and test.value is not None and None not in (test.value if isinstance(test, In) else ())


class ListingReader(DataSourceReader):
    """Filters on folder drop whole partitions before any listing; those on key and size drop rows in the task."""

    def __init__(self, store: Store):
        self.store, self.tests = store, []

    def pushFilters(self, filters):
        for test in filters:
            if pushable(test):
                self.tests.append(test)
            else:
                yield test

    def partitions(self):
        own = [t for t in self.tests if t.attribute[0] == "folder"]
        return [Folder(f) for f in self.store.folders() if all(passes(t, {"folder": f}) for t in own)]

    def read(self, partition):
        # with no folder left Spark still asks once, without a partition
        return rows_of(self.store, partition, self.tests) if partition else iter(())


class ListingStream(DataSourceStreamReader):
    """Offsets are times: a batch is what changed in [start, end), found by the tasks, so nothing listed passes the driver.

    end is the time of asking less the option settle (seconds until a written object shows, 10), or the option until if that is
    earlier. An object that is written again is found again; a replayed batch gives the same rows but for such ones.
    """

    def __init__(self, store: Store, options: dict):
        self.store, self.options = store, options

    def initialOffset(self):
        return {"us": micros(datetime.datetime.fromisoformat(self.options.get("since", EPOCH.isoformat())))}

    def latestOffset(self):
        now = datetime.datetime.now(UTC) - datetime.timedelta(seconds=float(self.options.get("settle", 10)))
        until = self.options.get("until")
        return {"us": max(self.initialOffset()["us"], min(micros(now), micros(datetime.datetime.fromisoformat(until)) if until else micros(now)))}

    def partitions(self, start, end):
        since, until = (EPOCH + datetime.timedelta(microseconds=o["us"]) for o in (start, end))
        return [Folder(f, since, until) for f in self.store.folders()]

    def read(self, partition):
        return rows_of(self.store, partition, [])


def micros(t: datetime.datetime) -> int:
    return ((t if t.tzinfo else t.replace(tzinfo=UTC)) - EPOCH) // datetime.timedelta(microseconds=1)


class StoreSource(DataSource):
    """S1, ST1. The listing of a store, in batch and as a stream; a subclass names itself and says how to connect."""

    def connect(self) -> Store:
        raise NotImplementedError

    def schema(self):
        return LISTING

    def reader(self, schema):
        return ListingReader(self.connect())

    def streamReader(self, schema):
        return ListingStream(self.connect(), dict(self.options))


@dataclass
class Written(WriterCommitMessage):
    path: str | None
    name: str


class ArchiveWriter(DataSourceWriter):
    """Each task writes an archive beside the root; commit moves them in, so that a lost or failed task leaves nothing to be listed."""

    def __init__(self, root: str):
        self.root, self.attempt = root, f".{uuid.uuid4().hex}"

    def write(self, rows):
        store, name = ArchiveStore(self.root), f"{uuid.uuid4().hex}.zip"
        path, archive = f"{store.root}/{self.attempt}/{name}", None
        for row in rows:
            if archive is None:
                store.fs.create_dir(f"{store.root}/{self.attempt}")
                out = store.fs.open_output_stream(path)
                archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
            archive.writestr(zipfile.ZipInfo(row["key"], row["mtime"].timetuple()[:6]), bytes(row["content"]))
        if archive is not None:
            archive.close()
            out.close()
        return Written(None if archive is None else path, name)

    def commit(self, messages):
        store = ArchiveStore(self.root)
        for m in messages:
            if m and m.path:
                store.fs.move(m.path, f"{store.root}/{m.name}")
        self.abort(messages)  # what attempts that do not count have left

    def abort(self, messages):
        """Deletes what this write has not moved in."""
        store = ArchiveStore(self.root)
        if store.fs.get_file_info(f"{store.root}/{self.attempt}").type != arrow_fs.FileType.NotFound:
            store.fs.delete_dir(f"{store.root}/{self.attempt}")


class ArchiveSource(StoreSource):
    """Format "archives": zip archives below the option path. Rows (key, mtime, content) can be appended."""

    @classmethod
    def name(cls):
        return "archives"

    def connect(self):
        return ArchiveStore(self.options["path"])

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("archives are only appended to")
        return ArchiveWriter(self.options["path"])


def register(spark: SparkSession, source: type[StoreSource] = ArchiveSource) -> None:
    """Makes a store's format known to the session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)


def with_contents(listing: DataFrame, store: Store) -> DataFrame:
    """S2. Adds content to (folder, key, ...) rows, read where the tasks run; a folder's keys are dealt to all of them."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in listing.schema)}, content binary"

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for folder, own in rows.groupby("folder", sort=False):
                start, held, size = 0, [], 0
                for content in store.read(folder, list(own["key"])):
                    held.append(content)
                    size += len(content)
                    if size >= BATCH_BYTES:
                        yield own.iloc[start : start + len(held)].assign(content=held)
                        start, held, size = start + len(held), [], 0
                if held:
                    yield own.iloc[start:].assign(content=held)

    return listing.repartition(F.col("folder"), F.xxhash64("key") % 64).sortWithinPartitions("folder").mapInPandas(fetch, schema)
