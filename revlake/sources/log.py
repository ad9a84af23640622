"""Published tables: a log of numbered entries, each of which names all folders that belong to the table.

A writer puts its files into a folder of its own, then claims the next number of the log; a number can be claimed once,
and who loses it reads the newer entry and tries again on top of that. A reader sees one entry, whole. What a failed
attempt wrote is in no entry, so it is never seen and never in the way.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries that stay below the newest one, for readers that still use them.
KEPT_ENTRIES = 20


def _files(spark: SparkSession, path: str):
    """The file system of a path, by the names that Hadoop gives it."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    return hadoop, where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def entries(spark: SparkSession, path: str) -> list[int]:
    hadoop, where, fs = _files(spark, f"{path}/_log")
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and n[0].isdigit())


def live(spark: SparkSession, path: str, number: int | None = None) -> tuple[int, dict[str, str]]:
    """The newest entry's number (0: none yet) and its parts: name to folder, below the path."""
    known = entries(spark, path)
    if not known:
        return 0, {}
    number = known[-1] if number is None else number
    _, where, fs = _files(spark, f"{path}/_log/{number:012d}.json")
    source = fs.open(where)
    try:
        return number, json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
    finally:
        source.close()


def claim(spark: SparkSession, path: str, number: int, parts: dict[str, str]) -> bool:
    """Writes an entry unless its number is taken: the file gets its name once it is whole, and never another's name."""
    hadoop, target, fs = _files(spark, f"{path}/_log/{number:012d}.json")
    own = hadoop.Path(f"{path}/_log/_{uuid.uuid4().hex}")
    out = fs.create(own)
    out.write(bytearray(json.dumps(parts).encode()))
    out.close()
    try:
        context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
        context.rename(own, target, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as error:
        fs.delete(own, False)
        if "FileAlreadyExists" not in error.java_exception.toString():
            raise
        return False
    return True


def commit(spark: SparkSession, path: str, change: Callable[[dict[str, str]], dict[str, str]]) -> dict[str, str]:
    """Publishes what change makes of the parts; again on newer parts as long as another writer was first."""
    while True:
        number, parts = live(spark, path)
        new = change(dict(parts))
        if claim(spark, path, number + 1, new):
            for old in entries(spark, path)[: -KEPT_ENTRIES - 1]:
                hadoop, where, fs = _files(spark, f"{path}/_log/{old:012d}.json")
                fs.delete(where, False)
            return new


def write(df: DataFrame, path: str, *by: str) -> str:
    """Writes to a folder that nobody else writes to; its name below the path."""
    folder = f"data/{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(f"{path}/{folder}")
    return folder


def read(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """The rows of all parts, or of those named; a folder that several names share is read once."""
    parts = live(spark, path)[1]
    folders = sorted({f for n, f in parts.items() if names is None or n in names})
    if not folders:
        raise ValueError(f"nothing is published at {path}")
    return spark.read.parquet(*[f"{path}/{f}" for f in folders])


def publish(df: DataFrame, path: str, batch: str) -> None:
    """A complete table in place of the one before it."""
    folder = write(df, path)
    commit(df.sparkSession, path, lambda parts: {batch: folder})


def publish_increment(df: DataFrame, path: str, batch: str) -> None:
    """Adds one batch; the same batch again takes the place of its first try, unless compaction has merged that already."""
    spark = df.sparkSession
    parts = live(spark, path)[1]
    if batch in parts and list(parts.values()).count(parts[batch]) > 1:
        return
    folder = write(df, path)
    commit(spark, path, lambda now: now | {batch: folder})


def compact(spark: SparkSession, path: str) -> None:
    """All batches in one folder, which keeps their names; batches that come meanwhile stay beside it, replaced ones win."""
    before = live(spark, path)[1]
    if len(set(before.values())) < 2:
        return
    folder = write(read(spark, path, list(before)), path)

    def swap(now: dict[str, str]) -> dict[str, str]:
        if any(now.get(name) != old for name, old in before.items()):
            return now  # one of the merged batches was written again: what was merged is out of date
        return now | dict.fromkeys(before, folder)

    commit(spark, path, swap)


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes folders that no entry of the log names. Not while writers are at work: their folders are not named yet."""
    hadoop, where, fs = _files(spark, f"{path}/data")
    named = {f.split("/")[1] for n in entries(spark, path) for f in live(spark, path, n)[1].values()}
    gone = [s.getPath() for s in fs.listStatus(where) if s.getPath().getName() not in named] if fs.exists(where) else []
    for old in gone:
        fs.delete(old, True)
    return len(gone)


def bucket_of(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def create_buckets(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """A table in buckets of a key; each bucket is a part, so that a merge can exchange it alone."""
    folder = write(df.withColumn("bucket", bucket_of(key, buckets)).repartition(buckets, "bucket"), path, "bucket")
    found = sorted(r[0] for r in df.select(bucket_of(key, buckets)).distinct().collect())  # at most as many as there are buckets
    commit(df.sparkSession, path, lambda parts: {f"bucket {b}": f"{folder}/bucket={b}" for b in found})


def merge_buckets(new: DataFrame, path: str, key: str, buckets: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    """merge(old, new) for the buckets that hold a key of new; files of all others keep their names. Gives those buckets.

    If another writer has exchanged one of these buckets meanwhile, the merge is done again on what it left.
    """
    spark = new.sparkSession
    touched = sorted(r[0] for r in new.select(bucket_of(key, buckets)).distinct().collect())  # at most as many as there are buckets
    while touched:
        before = live(spark, path)[1]
        names = [f"bucket {b}" for b in touched]
        there = [n for n in names if n in before]
        old = read(spark, path, there) if there else new.limit(0)
        rows = merge(old, new).withColumn("bucket", bucket_of(key, buckets))
        folder = write(rows.repartition(len(touched), "bucket"), path, "bucket")
        left = {r[0] for r in spark.read.parquet(f"{path}/{folder}").select("bucket").distinct().collect()}
        lost = False

        def swap(now: dict[str, str]) -> dict[str, str]:
            nonlocal lost
            lost = any(now.get(n) != before.get(n) for n in names)
            return now if lost else {n: f for n, f in now.items() if n not in names} | {f"bucket {b}": f"{folder}/bucket={b}" for b in touched if b in left}

        commit(spark, path, swap)
        if not lost:
            break
    return touched
