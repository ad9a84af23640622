"""Structured Streaming forms of the incremental work; each takes a streaming (or a static) DataFrame."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from revlake.operators.jobs import job_rollup
from revlake.operators.leave import MOVES
from revlake.sources.log import publish_increment

#: A file up to this size is held whole to be hashed; others are read in pieces of so many bytes.
WHOLE_BYTES, PIECE_BYTES = 64 << 20, 4 << 20
#: The state store that keeps its keys on disk.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Neighbouring ids that share a key of the state where a Python call for each would cost more than its work.
BLOCK_KEYS = 1024


def open_file(path: str):
    """A stream of a file by the name that Hadoop gives it: scheme:/path or scheme://store/path."""
    scheme, store, name = re.fullmatch(r"([^:/]+):(?://([^/]*))?(/.*)", path, re.DOTALL).groups()
    if scheme == "file":
        return open(name, "rb")
    found, top = arrow_fs.FileSystem.from_uri(f"{scheme.replace('s3a', 's3')}://{store or ''}/")
    return found.open_input_stream(top.rstrip("/") + name)


def opens(spark: SparkSession, root: str) -> bool:
    """Whether Arrow knows the store of a root, and connects to it."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(root)
        store = where.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().toString()
        if store.startswith("file:"):
            return True
        found, top = arrow_fs.FileSystem.from_uri(f"{store.replace('s3a:', 's3:').rstrip('/')}/")
        found.get_file_info(top or "/")
        return True
    except (Py4JJavaError, pa.ArrowException, OSError):
        return False


def hash_in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the SHA-256 of files (path, ...), of which a piece is held at a time."""

    def one(path: str) -> str:
        own = hashlib.sha256()
        with open_file(path) as source:
            while piece := source.read(PIECE_BYTES):
                own.update(piece)
        return own.hexdigest()

    for some in batches:
        yield some.append_column("hash", pa.array([one(p) for p in some.column("path").to_pylist()], pa.string()))


def discover_stream(spark: SparkSession, root: str, run_limit: int = 200) -> DataFrame:
    """ST1. New files below root, at most run_limit a trigger. Files of over WHOLE_BYTES are hashed in pieces by the task that has them, where Arrow opens their store."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("maxFilesPerTrigger", run_limit).load(root)
    told = [F.col("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")]
    if not opens(spark, root):
        return files.select(*told, F.sha2("content", 256).alias("hash"))
    whole = files.filter(F.col("length") <= WHOLE_BYTES).select(*told, F.sha2("content", 256).alias("hash"))
    return whole.unionByName(files.filter(F.col("length") > WHOLE_BYTES).select(*told).mapInArrow(hash_in_pieces, "path string, size long, mtime timestamp, hash string"))


def ingest_stream(stream: DataFrame, process: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """ST2. Each micro-batch is processed and added whole to what is published (read_published); a replayed batch takes its own place."""

    def one(batch: DataFrame, number: int) -> None:
        publish_increment(process(batch), path, f"{number:012d}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_counters_stream(items: DataFrame) -> DataFrame:
    """ST3. Running counters by job (update or complete mode)."""
    return job_rollup(items)


def latency_stream(events: DataFrame, value: str = "value", late: str = "1 hour", width: str = "1 day", slide: str | None = None) -> DataFrame:
    """ST4. Count, mean and p95 by event-time window; the percentile is approximate in a stream."""
    own = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide))
    return own.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.percentile_approx(value, 0.95, 10000).alias("p95")).select(F.col("window.start").alias("start"), "n", "mean", "p95")


def latency_counts_stream(events: DataFrame, value: str = "value", late: str = "1 hour", width: str = "1 day", slide: str | None = None) -> DataFrame:
    """ST4, exact. (start, value, n): how often each value came in a window, so that no state holds a whole window; latency_windows reads what it gives."""
    own = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), F.col(value).alias("value"))
    return own.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "value", "n")


def latency_windows(counts: DataFrame) -> DataFrame:
    """(start, n, mean, p95) of (start, value, n), exact. Null values count as events only.

    The 95th percentile is the least value that so many do not pass. Values are ranked in bins of a hundredth of a window's
    range, and whole bins by their counts, so no window is sorted in one task.
    """
    all_of = counts.groupBy("start").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).alias("known"), F.sum(F.col("value") * F.col("n")).alias("total"), F.min("value").alias("least"), F.max("value").alias("most"))
    width = F.when(F.col("most") > F.col("least"), (F.col("most") - F.col("least")) / 100)
    binned = counts.filter("value is not null").join(all_of.select("start", "known", "least", "most"), "start")
    binned = binned.withColumn("bin", F.coalesce(F.floor((F.col("value") - F.col("least")) / width), F.lit(0)))
    upto = F.sum("own").over(Window.partitionBy("start").orderBy("bin"))
    bins = binned.groupBy("start", "bin", "known").agg(F.sum("n").alias("own")).withColumn("upto", upto)
    at = bins.filter((100 * F.col("upto") >= 95 * F.col("known")) & (100 * (F.col("upto") - F.col("own")) < 95 * F.col("known"))).select("start", "bin", (F.col("upto") - F.col("own")).alias("before"))
    reached = F.col("before") + F.sum("n").over(Window.partitionBy("start", "bin").orderBy("value"))
    found = binned.join(at, ["start", "bin"]).withColumn("reached", reached).filter(100 * F.col("reached") >= 95 * F.col("known")).groupBy("start").agg(F.min("value").alias("p95"))
    return all_of.join(found, "start", "left").select("start", "n", (F.col("total") / F.col("known")).alias("mean"), "p95")


def dedupe_stream(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """ST5. The first event of each key within the watermark."""
    rows = events.withWatermark("ts", late)
    return rows.dropDuplicatesWithinWatermark([key]) if events.isStreaming else rows.dropDuplicates([key])


def claim_timeout_stream(events: DataFrame, minutes: int = 30, late: str = "1 minute") -> DataFrame:
    """ST6. events: (revision_id, event, ts), event claim or done. One row for each claim without a done at its time or within the minutes.

    A claim is decided once the watermark has passed its last minute, by all events of its key up to then, in whatever
    order they came; each of several claims of a key has its own answer. Times count in milliseconds. A join of the stream
    with itself, in stretches of the minutes: a claim has one, a completion is known in its own and the one before, so a
    key's state is met in small parts and no Python is called.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    span = F.expr(f"interval {minutes} minutes")
    stretch = lambda at: F.floor(F.unix_millis(at) / F.lit(minutes * 60_000))
    own = events.withColumn("ts", F.date_trunc("millisecond", "ts")).withWatermark("ts", late)
    only = lambda kind: own.filter(F.least(F.coalesce(F.col("event") == kind, F.lit(False)), F.col("ts").isNotNull()))  # noqa: E731  kept above the watermark, which all events move
    claims = only("claim").select("revision_id", F.col("ts").alias("claimed_at"), stretch(F.col("ts")).alias("stretch"))
    done = only("done").select(F.col("revision_id").alias("done_id"), F.col("ts").alias("done_at"), F.explode(F.array(stretch(F.col("ts")) - 1, stretch(F.col("ts")))).alias("known"))
    met = (F.col("revision_id") == F.col("done_id")) & (F.col("stretch") == F.col("known")) & (F.col("done_at") >= F.col("claimed_at")) & (F.col("done_at") <= F.col("claimed_at") + span)
    return claims.join(done, met, "left").filter("done_at is null").select("revision_id", "claimed_at")


def lifecycle_stream(events: DataFrame) -> DataFrame:
    """ST7. events: (request_id, seq, event, is_own, is_ended, initial). One row an event: the status after it, or that it was rejected.

    Requests with neighbouring ids, BLOCK_KEYS at most, are one key of the state, so a Python call serves many of them.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["request_id", "seq"])
        known = dict(zip(state.get[0], zip(state.get[1], state.get[2]))) if state.exists else {}
        after_all, rejected = [], []
        for request, seq, event, is_own, is_ended, initial in zip(*(rows[c].tolist() for c in ("request_id", "seq", "event", "is_own", "is_ended", "initial"))):
            status, seen = known.get(request) or (initial, -1)
            after = MOVES.get((status, event))
            own = event in ("approve", "reject") and is_own
            legal = after is not None and not own and not (event == "cancel" and is_ended) and seq > seen
            status = after if legal else status
            known[request] = status, max(seen, seq)
            after_all.append(status)
            rejected.append(not legal)
        state.update((list(known), [s for s, _ in known.values()], [n for _, n in known.values()]))
        yield pd.DataFrame({"request_id": rows["request_id"].to_numpy(), "seq": rows["seq"].to_numpy(), "status": after_all, "rejected": rejected})

    blocks = events.withColumn("block", F.floor(F.col("request_id") / BLOCK_KEYS)).groupBy("block")
    return blocks.applyInPandasWithState(run, "request_id long, seq long, status string, rejected boolean", "ids array<long>, statuses array<string>, seen array<long>", "append", GroupStateTimeout.NoTimeout)


def conversation_stream(messages: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """ST8. Activity sessions of each conversation."""
    own = messages.withWatermark("created_at", late).groupBy("conv_id", F.session_window("created_at", gap).alias("s"))
    return own.agg(F.count("*").alias("n")).select("conv_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def fold_answer_events(events: DataFrame) -> DataFrame:
    """ST9. events: (message_id, seq, kind, text). Tokens since the last reset, unless a final text comes after it."""
    w = Window.partitionBy("message_id")
    rows = events.withColumn("reset", F.max(F.when(F.col("kind") == "reset", F.col("seq"))).over(w)).filter("reset is null or seq > reset")
    item = F.when(F.col("kind") == "token", F.struct("seq", "text"))
    own = rows.groupBy("message_id").agg(F.max_by(F.when(F.col("kind") == "final", F.col("text")), F.when(F.col("kind") == "final", F.col("seq"))).alias("final"), F.sort_array(F.collect_list(item)).alias("tokens"))
    return own.select("message_id", F.coalesce("final", F.array_join(F.transform("tokens", lambda t: t["text"]), "")).alias("content"))


def fold_answer_stream(events: DataFrame) -> DataFrame:
    """ST9 as a stream, in update mode. events: (message_id string, seq long, kind, text). A row whenever a message has changed: its content, and how many events it has seen.

    The row of the highest version is the message as it stands; content is null where nothing came after a reset. Events may
    come in any order. A message's tokens are its state, an aggregate's buffer.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    seq, of = F.col("seq"), lambda kind: F.col("kind") == kind
    own = events.groupBy("message_id").agg(
        F.count("*").alias("version"),
        F.max(F.when(of("reset"), seq)).alias("reset"),
        F.max(F.when(of("final"), seq)).alias("last"),
        F.max_by(F.when(of("final"), F.col("text")), F.when(of("final"), seq)).alias("final"),
        F.collect_list(F.when(of("token"), F.struct("seq", "text"))).alias("tokens"),
    )
    after = lambda at: F.col("reset").isNull() | (at > F.col("reset"))
    tokens = F.array_sort(F.filter("tokens", lambda t: after(t["seq"])))
    joined = F.when(F.size(tokens) > 0, F.array_join(F.transform(tokens, lambda t: t["text"]), ""))
    return own.select("message_id", "version", F.when(F.col("last").isNotNull() & after(F.col("last")), F.col("final")).otherwise(joined).alias("content"))
