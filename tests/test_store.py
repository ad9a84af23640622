"""A store that is no file system: listing, filters, contents, streams and the sink."""

import datetime
import tempfile

import pytest
from pyspark.sql import functions as F

from revlake.sources import store as S

UTC = datetime.timezone.utc
OBJECTS = [("a/1.txt", "2024-01-01 00:00:00", b"one"), ("a/2.md", "2024-01-02 00:00:00", b""), ("b/é.txt", "2024-01-03 00:00:02", b"x" * 5000), ("b/\U0001f600", "2024-01-04 00:00:00", b"\x00\xff")]


def put(spark, path, objects):
    S.register(spark)
    rows = spark.createDataFrame(objects, "key string, mtime string, content binary").withColumn("mtime", F.col("mtime").cast("timestamp"))
    rows.repartition(3).write.format("archives").option("path", path).mode("append").save()


@pytest.fixture()
def path(spark):
    root = tempfile.mkdtemp(prefix="spark-") + "/store"
    put(spark, root, OBJECTS)
    return root


def test_listing_and_contents(spark, path):
    rows = spark.read.format("archives").load(path)
    want = sorted((k, len(c), datetime.datetime.fromisoformat(t)) for k, t, c in OBJECTS)
    assert sorted((r.key, r["size"], r.mtime) for r in rows.collect()) == want
    read = S.with_contents(rows, S.ArchiveStore(path)).collect()
    assert sorted((r.key, bytes(r.content)) for r in read) == sorted((k, c) for k, _, c in OBJECTS)
    assert S.with_contents(rows.filter("key = 'none'"), S.ArchiveStore(path)).count() == 0


def test_a_write_leaves_archives_only(path):
    import os

    assert all(n.endswith(".zip") for n in os.listdir(path)) and os.listdir(path)


def test_contents_leave_in_bounded_batches(spark, path, monkeypatch):
    monkeypatch.setattr(S, "BATCH_BYTES", 1)
    rows = spark.read.format("archives").load(path).repartition(1)
    assert sorted((r.key, bytes(r.content)) for r in S.with_contents(rows, S.ArchiveStore(path)).collect()) == sorted((k, c) for k, _, c in OBJECTS)


@pytest.mark.parametrize(
    "where",
    ["key = 'a/2.md'", "key like 'b/%'", "key in ('a/1.txt', 'c')", "key > 'b/é.txt'", "key <= 'b/é.txt'", "size >= 3 and key < 'b'", "mtime > timestamp '2024-01-02 00:00:00'", "key is null", "not key = 'a/1.txt'", "size = 0 or key = 'a/1.txt'", "folder > 'z'", "folder like '%zip' and size < 3"],
)
def test_filters_give_what_spark_gives(spark, path, where):
    rows = spark.read.format("archives").load(path)
    every = spark.createDataFrame(rows.collect(), rows.schema)
    assert sorted(rows.filter(where).collect()) == sorted(every.filter(where).collect())


def test_a_folder_that_no_row_can_come_from_is_never_listed():
    class Counted(S.Store):
        listed = []

        def folders(self):
            return ["a", "b", "c"]

        def list(self, folder):
            self.listed.append(folder)
            yield f"{folder}/1", 1, datetime.datetime(2024, 1, 1, tzinfo=UTC)

    reader = S.ListingReader(Counted())
    left = list(reader.pushFilters([S.GreaterThan(("folder",), "b"), S.EqualTo(("key",), "c/1"), S.EqualTo(("mtime",), None)]))
    assert left == [S.EqualTo(("mtime",), None)]  # Spark tests what the reader does not
    assert [r[1] for p in reader.partitions() for r in reader.read(p)] == ["c/1"]
    assert Counted.listed == ["c"]


def test_pushed_filters_leave_the_plan(spark, path, capsys):
    spark.read.format("archives").load(path).filter("key like 'b/%' and size > 3").explain()
    plan = capsys.readouterr().out
    assert "BatchScan" in plan and "StartsWith" not in plan.split("BatchScan")[0]


def test_a_stream_finds_each_object_once_over_a_restart(spark, path):
    out = tempfile.mkdtemp(prefix="spark-")

    def run(**options):
        rows = spark.readStream.format("archives").options(path=path, **options).load()
        rows.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/out").awaitTermination()
        return sorted(r.key for r in spark.read.schema(S.LISTING).parquet(f"{out}/out").collect())

    assert run(until="2024-01-03T00:00:00") == ["a/1.txt", "a/2.md"]
    put(spark, path, [("c", "2024-02-01 00:00:00", b"new")])
    assert run() == sorted([*(k for k, _, _ in OBJECTS), "c"])
    assert run() == sorted([*(k for k, _, _ in OBJECTS), "c"])


def test_since_and_bounds_of_offsets():
    stream = S.ListingStream(S.Store(), {"since": "2024-01-02T00:00:00", "until": "2024-01-01T00:00:00"})
    assert stream.latestOffset() == stream.initialOffset()  # never before the first one


def test_a_failed_write_lists_nothing(spark, path):
    before = spark.read.format("archives").load(path).count()
    bad = spark.range(4).select(F.col("id").cast("string").alias("key"), F.current_timestamp().alias("mtime"), F.when(F.col("id") < 3, F.encode(F.lit("x"), "UTF-8")).otherwise(F.expr("cast(raise_error('no') as binary)")).alias("content"))
    with pytest.raises(Exception):
        bad.repartition(2).write.format("archives").option("path", path).mode("append").save()
    assert spark.read.format("archives").load(path).count() == before
    with pytest.raises(Exception, match="appended"):
        bad.limit(0).write.format("archives").option("path", path).mode("overwrite").save()


def test_a_store_without_folders(spark):
    S.register(spark)
    root = tempfile.mkdtemp(prefix="spark-") + "/none"
    assert spark.read.format("archives").load(root).filter("folder = 'x'").count() == 0
