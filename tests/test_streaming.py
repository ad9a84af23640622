"""Streams give what their batch twins give, survive a restart, and time out."""

import os
import random

import pytest
from pyspark.sql import functions as F

from revlake.operators.lifecycle import upsert
from revlake.sources import files, log
from revlake.streaming import streams as S


def drain(stream, path, mode, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", path).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


@pytest.fixture()
def source(spark, tmp_path):
    def make(df, parts=3):
        path = str(tmp_path / "in")
        df.repartition(parts).write.parquet(path)
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)

    return make


def test_counters_equal_batch(spark, sf, source, tmp_path):
    items = spark.read.parquet(f"{sf}/events.parquet").select(F.to_date("ts").alias("job_id"), F.when(F.col("event_type") == "error", "FAILED").otherwise("PROCESSED").alias("outcome"), F.lit(1).alias("n_chunks"))
    got = drain(S.job_counters_stream(source(items)), str(tmp_path / "c"), "complete", "counters")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, S.job_counters_stream(items).collect()))


def test_first_event_wins(spark, source, tmp_path):
    rows = spark.createDataFrame([("a", 0), ("a", 5), ("b", 7), ("a", 9)], "key string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = drain(S.dedupe_stream(source(rows, 1), "key"), str(tmp_path / "c"), "append", "dedupe")
    assert sorted(r.key for r in got.collect()) == ["a", "b"]


def test_lifecycle_state(spark, source, tmp_path):
    rows = [(1, 1, "approve", False, False), (1, 2, "cancel", False, False), (1, 3, "approve", False, False), (2, 1, "approve", True, False), (2, 2, "withdraw", False, False)]
    df = spark.createDataFrame([(*r, "PENDING_APPROVAL") for r in rows], "request_id long, seq long, event string, is_own boolean, is_ended boolean, initial string")
    got = drain(S.lifecycle_stream(source(df, 1)), str(tmp_path / "c"), "append", "lifecycle")
    assert sorted((r.request_id, r.seq, r.status, r.rejected) for r in got.collect()) == [(1, 1, "APPROVED", False), (1, 2, "CANCELLED", False), (1, 3, "CANCELLED", True), (2, 1, "PENDING_APPROVAL", True), (2, 2, "WITHDRAWN", False)]


def test_lifecycle_of_many_requests(spark, source, tmp_path):
    """Neighbouring requests share a key of the state, over batches: far fewer keys than requests, each request with its own status."""
    rows = [(k, seq, event, False, False, "PENDING_APPROVAL") for k in range(-50, 3000) for seq, event in ((1, "approve" if k % 2 else "reject"), (2, "cancel"))]
    df = spark.createDataFrame(rows, "request_id long, seq long, event string, is_own boolean, is_ended boolean, initial string")
    path = str(tmp_path / "in")
    for seq in (1, 2):
        df.filter(F.col("seq") == seq).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = S.lifecycle_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) < 10
    got = spark.read.parquet(str(tmp_path / "out")).filter("seq = 2").collect()
    assert {(r.request_id, r.status, r.rejected) for r in got} == {(k, "CANCELLED" if k % 2 else "REJECTED", k % 2 == 0) for k in range(-50, 3000)}


def test_answers_fold_without_a_python_call_for_each(spark, tmp_path):
    """Answers from batches in any order; what follows a reset counts, a final text goes before tokens."""
    rows = [("a", 1, "token", "x"), ("a", 2, "reset", ""), ("a", 4, "token", "z"), ("a", 3, "token", "y"), ("b", 1, "token", "p"), ("b", 2, "final", "whole"), ("c", 1, "final", "old"), ("c", 2, "reset", ""), ("d", 2, "reset", ""), ("d", 1, "token", "q"), ("d", 3, "token", "r")]
    df = spark.createDataFrame(rows, "message_id string, seq long, kind string, text string")
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for odd in (1, 0):
        df.filter(F.col("seq") % 2 == odd).coalesce(1).write.mode("append").parquet(path)
    stream = S.fold_answer_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path))
    assert "pyspark" not in stream._jdf.queryExecution().logical().toString().lower()
    q = stream.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("append").parquet(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    newest = spark.read.parquet(out).groupBy("message_id").agg(F.max_by("content", "version").alias("content"), F.max("version").alias("n"))
    assert {(r.message_id, r.content, r.n) for r in newest.collect()} == {("a", "yz", 4), ("b", "whole", 2), ("c", None, 2), ("d", "r", 3)}


def test_claims_time_out(spark, tmp_path):
    path = str(tmp_path / "in")
    stream = lambda: spark.readStream.schema("revision_id long, event string, ts timestamp").parquet(path)
    batches = [[(1, "claim", 0), (2, "claim", 0)], [(2, "done", 600)], [(3, "claim", 7200)], [(3, "done", 7300)]]
    out = str(tmp_path / "out")
    for rows in batches:  # each pass is a restart from the checkpoint
        spark.createDataFrame(rows, "revision_id long, event string, s long").select("revision_id", "event", F.timestamp_seconds(F.col("s") + 1_000_000).alias("ts")).coalesce(1).write.mode("append").parquet(path)
        S.claim_timeout_stream(stream()).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out).awaitTermination(120)
    assert [r.revision_id for r in spark.read.parquet(out).collect()] == [1]


def test_store_discovery_and_publication(spark, tmp_path):
    root = tmp_path / "store"
    for name, text in (("FIN-POL-0001/rev-001/a.txt", "one"), ("FIN-POL-0001/rev-002/a.txt", "two"), ("loose.pdf", "x")):
        os.makedirs((root / name).parent, exist_ok=True)
        (root / name).write_text(text)
    listed = files.scan_store(spark, str(root))
    assert {(r.key, r.size) for r in listed.collect()} == {("FIN-POL-0001/rev-001/a.txt", 3), ("FIN-POL-0001/rev-002/a.txt", 3), ("loose.pdf", 1)}
    parsed = files.parse_registry(files.with_content_type(files.read_contents(spark, str(root))), {"text/plain": files.plain_text})
    assert {(r.key.split("/")[-1], r.text, r.error) for r in parsed.collect()} == {("a.txt", "one", None), ("a.txt", "two", None), ("loose.pdf", None, "NO_PARSER")}
    out = str(tmp_path / "pub")
    S.ingest_stream(S.discover_stream(spark, str(root)), lambda b: b.select("path", "hash"), out, str(tmp_path / "ck")).awaitTermination(120)
    assert log.read(spark, out).count() == 3


def test_files_that_are_too_long_to_be_held_are_discovered(spark, tmp_path, monkeypatch):
    import hashlib

    monkeypatch.setattr(S, "WHOLE_BYTES", 1000)
    root, out, state = tmp_path / "in [1]% \u00e9", str(tmp_path / "out"), str(tmp_path / "state")
    os.makedirs(root / "a b")
    sizes, want, batches = [1, 2, 999, 1000, 1001, 5000, 20_000], {}, []
    for n, size in enumerate(sizes):
        name = f"a b/{n}#?.bin" if n % 2 else f"{n}.gz"
        data = random.Random(n).randbytes(size)
        (root / name).write_bytes(data)
        want[name.split("/")[-1]] = (size, hashlib.sha256(data).hexdigest(), int((root / name).stat().st_mtime))
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)  # longer contents are an error
    try:
        work = lambda b: batches.append(b.count()) or b.select("path", "size", F.unix_timestamp("mtime").alias("at"), "hash")
        S.ingest_stream(S.discover_stream(spark, str(root).replace("[", "\\[").replace("]", "\\]"), 2), work, out, state).awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    got = log.read(spark, out).collect()
    assert {r.path.split("/")[-1]: (r.size, r.hash, r.at) for r in got} == want and len(got) == len(want)
    assert sum(batches) == len(want) and max(batches) == 2  # a file is in one batch, whichever way it is read


def test_micro_batches_add_up(spark, tmp_path):
    out, state, src = (str(tmp_path / x) for x in ("out", "state", "in"))
    for n in range(3):  # three runs, one of them of two batches
        spark.range(n * 10, n * 10 + 10).repartition(1 + n % 2).write.mode("append").parquet(src)
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(src)
        S.ingest_stream(stream, lambda b: b, out, state).awaitTermination(120)
    assert sorted(r.id for r in log.read(spark, out).collect()) == list(range(30))
    log.publish_increment(spark.range(100, 101), out, "000000000001")  # a batch that is tried again takes its own place
    assert log.read(spark, out).filter("id = 100").count() == 1
    log.write(spark.range(5), out)  # written, but in no entry
    assert log.read(spark, out).filter("id < 5").count() == 5


def test_snapshots_take_turns(spark, tmp_path):
    out = str(tmp_path / "snap")
    for n in (3, 5):
        log.publish(spark.range(n), out, f"b{n}")
        assert log.read(spark, out).count() == n


def test_gold_file(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"questions": [{"id": "q1", "question": "how?", "type": "fact", "expectedFacts": ["5 days"], "noAnswer": false}]}')
    assert files.read_gold(spark, str(tmp_path / "g.json")).first().expectedFacts == ["5 days"]
    spark.createDataFrame([('{"questions": [{"id": "a"}, {"id": "b"}]}',), ('{"questions": []}',), ('{"questions": [{"id": "c"}]}',)], "value string").repartition(2).write.text(str(tmp_path / "parts"))
    assert sorted(r.id for r in files.read_gold(spark, str(tmp_path / "parts"), parts=True).collect()) == ["a", "b", "c"]
    (tmp_path / "e.json").write_text('{"questions": []}')
    with pytest.raises(ValueError):
        files.read_gold(spark, str(tmp_path / "e.json"))


def claims_by_brute_force(events, minutes=30):
    done = [(k, t) for k, e, t in events if e == "done"]
    return sorted((k, t) for k, e, t in events if e == "claim" and not any(k == j and t <= u <= t + minutes * 60 for j, u in done))


def test_claims_in_any_order(spark, tmp_path):
    """Two claims of a key, completions that come before their claim or too late, claims at one time: each has its own answer."""
    rng = random.Random(3)
    events = [(k, rng.choice(["claim", "claim", "done"]), 1_000_000 + rng.randrange(40) * 300) for k in range(12) for _ in range(12)]
    events += [(50, "claim", 1_000_000), (50, "claim", 1_000_600), (50, "done", 1_002_000), (51, "claim", 1_000_000), (51, "claim", 1_000_000), (52, "done", 1_000_000), (52, "claim", 1_000_000), (53, "done", 1_001_800), (53, "claim", 1_000_000)]
    want, late = claims_by_brute_force(events), 14_400
    for turn in range(2):
        rng.shuffle(events)
        src, out = str(tmp_path / f"in{turn}"), str(tmp_path / f"out{turn}")
        parts = [events[k::3] for k in range(3)] + [[(-1, "end", 1_000_000 + 100_000)]]
        for part in parts:  # each pass is a restart from the checkpoint
            spark.createDataFrame(part, "revision_id long, event string, s long").select("revision_id", "event", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(src)
            stream = spark.readStream.schema("revision_id long, event string, ts timestamp").parquet(src)
            S.claim_timeout_stream(stream, late=f"{late} seconds").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"c{turn}")).trigger(availableNow=True).start(out).awaitTermination(120)
        got = spark.read.parquet(out).select("revision_id", F.unix_seconds("claimed_at")).collect()
        assert sorted(map(tuple, got)) == want


def test_a_failed_retry_leaves_what_is_published(spark, tmp_path):
    out = str(tmp_path / "t")
    log.publish_increment(spark.range(5), out, "0")
    bad = spark.range(3).select(F.expr("raise_error('no such luck')").cast("long").alias("id"))
    for attempt in range(2):
        with pytest.raises(Exception, match="no such luck"):
            log.publish_increment(bad, out, "0")
        with pytest.raises(Exception, match="no such luck"):
            log.publish(bad, out, "0")
        assert sorted(r.id for r in log.read(spark, out).collect()) == list(range(5))
    log.publish_increment(spark.range(7), out, "0")
    assert log.read(spark, out).count() == 7
    assert log.vacuum(spark, out) >= 4 and log.read(spark, out).count() == 7


def test_writers_that_meet(spark, tmp_path, monkeypatch):
    """Another writer claims the number first, or writes what is being merged."""
    out, claim = str(tmp_path / "t"), log.claim
    log.publish_increment(spark.range(2), out, "a")
    log.publish_increment(spark.range(2, 4), out, "b")
    others = [lambda: log.publish_increment(spark.range(4, 6), out, "c"), lambda: log.publish_increment(spark.range(10, 11), out, "a")]

    def late(*args):
        if others:
            monkeypatch.setattr(log, "claim", claim)
            others.pop(0)()
            monkeypatch.setattr(log, "claim", late)
        return claim(*args)

    monkeypatch.setattr(log, "claim", late)
    log.compact(spark, out)  # meets c, and then the new a
    monkeypatch.setattr(log, "claim", claim)
    assert sorted(r.id for r in log.read(spark, out).collect()) == [2, 3, 4, 5, 10]
    log.compact(spark, out)
    assert len(set(log.live(spark, out)[1].values())) == 1 and log.read(spark, out).count() == 5
    log.publish_increment(spark.range(99), out, "b")  # a replay of what is merged changes nothing
    assert log.read(spark, out).count() == 5
    assert not log.claim(spark, out, log.entries(spark, out)[-1], {})


def test_a_merge_exchanges_only_its_buckets(spark, tmp_path):
    out = str(tmp_path / "t")
    rows = spark.range(1000).selectExpr("id as key", "id * 2 as v")
    log.create_buckets(rows, out, "key", 16)
    before = log.live(spark, out)[1]
    new = spark.createDataFrame([(5, -1), (2000, -2)], "key long, v long")
    touched = log.merge_buckets(new, out, "key", 16, lambda old, new: upsert(old, new, "key", keep=()))
    after = log.live(spark, out)[1]
    assert 1 <= len(touched) <= 2 and {n for n in before if before[n] != after[n]} == {f"bucket {b}" for b in touched}
    got = {r.key: r.v for r in log.read(spark, out).collect()}
    assert got == {k: 2 * k for k in range(1000)} | {5: -1, 2000: -2}
    log.merge_buckets(spark.createDataFrame([(5, 0)], "key long, v long"), out, "key", 16, lambda old, new: old.join(new, "key", "left_anti"))
    assert log.read(spark, out).count() == 1000


def test_latencies_of_many_values_are_exact(spark):
    # more values than the buffer of an approximate percentile holds; nulls count as events only
    rows = spark.range(60_000).select((F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 2 * 86400)).alias("ts"), F.when(F.col("id") % 50 > 1, F.pmod(F.xxhash64("id"), F.lit(10**12)) / 7.0).alias("value"))
    got = {r.start: r for r in S.latency_windows(S.latency_counts_stream(rows)).collect()}
    want = rows.groupBy(F.window("ts", "1 day").start.alias("start")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95")).collect()
    assert len(got) == len(want) == 2
    for r in want:
        assert (got[r.start].n, got[r.start].p95) == (r.n, r.p95) and abs(got[r.start].mean / r["mean"] - 1) < 1e-12
    one = spark.sql("select timestamp '2024-01-01' as ts, cast(null as double) as value union all select timestamp '2024-01-02', 3.0 union all select timestamp '2024-01-02', 3.0")
    assert sorted((r.n, r["mean"], r.p95) for r in S.latency_windows(S.latency_counts_stream(one)).collect() if r.n == 2) == [(2, 3.0, 3.0)]


def test_claims_time_out_without_python(spark, tmp_path):
    """many claims of many keys need no Python call for a key or timer, and a key's state is met in stretches of the minutes."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    at = F.timestamp_seconds(1_000_000 + F.col("id") * 60)
    spark.range(3000).select((F.col("id") % 2).alias("revision_id"), F.when(F.col("id") % 80 < 40, "claim").otherwise("done").alias("event"), at.alias("ts")).coalesce(1).write.parquet(path)
    spark.range(1).select(F.lit(-1).cast("long").alias("revision_id"), F.lit("end").alias("event"), F.timestamp_seconds(F.lit(2_000_000)).alias("ts")).write.mode("append").parquet(path)
    stream = S.claim_timeout_stream(spark.readStream.schema("revision_id long, event string, ts timestamp").parquet(path))
    assert "Pandas" not in stream._jdf.queryExecution().logical().toString()
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out).awaitTermination(120)
    events = [(k % 2, "claim" if k % 80 < 40 else "done", 1_000_000 + k * 60) for k in range(3000)]
    assert sorted(map(tuple, spark.read.parquet(out).select("revision_id", F.unix_seconds("claimed_at")).collect())) == claims_by_brute_force(events)


def test_contents_of_other_files_are_not_read(spark, tmp_path):
    """a file that was not asked for is too long to be read."""
    for name, text in (("a[1].txt", "one"), ("long.txt", "x" * 5000)):
        (tmp_path / name).write_text(text)
    keys = spark.createDataFrame([("a[1].txt",), ("gone.txt",)], "key string")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)
    try:
        got = files.read_contents(spark, str(tmp_path), keys).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert [(r.key, bytes(r.content)) for r in got] == [("a[1].txt", b"one")]
