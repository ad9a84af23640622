"""Queries over sources, sinks and running streams; what they write lies in the shared folder, under a name of its own."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from revlake.functions import text as T
from revlake.lineage import shared_dir
from revlake.operators import evaluation as E
from revlake.operators import jobs as J
from revlake.operators import structure as S
from revlake.sources import adapters as A
from revlake.sources import files, log, store
from revlake.streaming import streams

from .base import ORACLES, query
from .context import evaluated
from .leave import lifecycle_events


def fresh(spark):
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


@query()
def s1_scan_store(spark, d):
    """The files of the given tables; their contents are not read."""
    return files.scan_store(spark, d).select(F.regexp_extract("key", "[^/]+$", 0).alias("file"), "size")


@query()
def s2_read_contents(spark, d):
    """The files of two of the tables, hashed where the tasks run."""
    keys = files.scan_store(spark, d).filter(F.col("key").rlike("(labels|benchmark).parquet$"))
    return files.read_contents(spark, d, keys).select(F.regexp_extract("key", "[^/]+$", 0).alias("file"), "hash")


@query(
    """select doc_id || case doc_id % 3 when 0 then '.txt' when 1 then '.md' else '.bin' end as key, case doc_id % 3 when 0 then sha256(text) when 1 then sha256('md ' || text) end as text, case when doc_id % 3 = 2 then 'NO_PARSER' end as error from documents"""
)
def s9_parse_registry(spark, d):
    """Documents as files of three types, one of which has no parser."""
    ext = F.element_at(F.array(*map(F.lit, [".txt", ".md", ".bin"])), (F.col("doc_id") % 3 + 1).cast("int"))
    stored = A.table(spark, d, "documents").select(F.concat(F.col("doc_id"), ext).alias("key"), F.encode("text", "UTF-8").alias("content"))
    marked = lambda df: files.plain_text(df).withColumn("text", F.concat(F.lit("md "), "text"))
    parsed = files.parse_registry(files.with_content_type(stored), {"text/plain": files.plain_text, "text/markdown": marked})
    return parsed.withColumn("text", F.sha2("text", 256))


@query("select 'q' || item_id as id, text as question, case when item_id % 2 = 0 then 'fact' else 'revision' end as type, [text[1:20]] as facts, item_id % 2 = 1 as no_answer from benchmark")
def s10_read_gold(spark, d):
    """Gold questions written as JSON objects of 500 questions each and read back."""
    path, k = fresh(spark), F.col("item_id")
    one = F.struct(F.concat(F.lit("q"), k).alias("id"), F.col("text").alias("question"), F.when(k % 2 == 0, "fact").otherwise("revision").alias("type"), F.array(F.substring("text", 1, 20)).alias("expectedFacts"), (k % 2 == 1).alias("noAnswer"))
    A.table(spark, d, "benchmark").groupBy(F.floor(k / 500)).agg(F.to_json(F.struct(F.collect_list(one).alias("questions"))).alias("value")).select("value").write.text(path)
    return files.read_gold(spark, path, parts=True).select("id", "question", "type", F.col("expectedFacts").alias("facts"), F.col("noAnswer").alias("no_answer"))


@query("select revision_id, chunk_index, sha256(revision_id || ':' || chunk_index) as chunk_key, case when chunk_index > 0 then sha256(revision_id || ':0') end as parent_key, false as is_current from chunks", "chunks")
def s12_write_chunks(spark, d):
    """Chunks written as the sink writes them, in two runs, and read back; the first chunk of a revision is the others' parent."""
    path = fresh(spark)
    rows = A.chunks(spark, d).select("revision_id", "chunk_index", F.when(F.col("chunk_index") > 0, 0).alias("parent_index"))
    for run, part in (("a", "revision_id % 2 = 0"), ("b", "revision_id % 2 = 1"), ("b", "revision_id % 2 = 1")):
        files.write_chunks(rows.filter(part), path, run)
    return spark.read.parquet(path).select("revision_id", "chunk_index", "chunk_key", "parent_key", "is_current")


@query("select 'r1' as run_id, count(*) as questions, count(recall_1) as answerable, (select count(*) from evals where refusal_correct) as refused from evals", "evals")
def s15_write_eval(spark, d):
    """An evaluation's run and results, written and read back."""
    path, results = fresh(spark), evaluated(spark, d)
    files.write_eval(E.summarise_retrieval(results), results, path, "r1")
    refused = spark.read.parquet(f"{path}/results").filter("run_id = 'r1'").agg(F.count_if("refusal_correct").alias("refused"))
    return spark.read.parquet(f"{path}/runs").select("run_id", "questions", "answerable").join(refused)


@query("select doc_id, [length(t), instr(t, 'a'), case when t = ' ' then 1 else 0 end]::float[] as embedding from (select doc_id, case when trim(text, ' ' || chr(10)) = '' then ' ' else left(text, 30400) end as t from documents)")
def s16_embed(spark, d):
    """Vectors by a provider's batch function: length, where the first a stands, and whether the text was blank."""
    provider = lambda texts: [[len(t), t.find("a") + 1, t == " "] for t in texts]
    return J.embed(A.table(spark, d, "documents").select("doc_id", "text"), provider, 3, "text").select("doc_id", "embedding")


@query("select doc_id from documents")
def m2_cost_guard(spark, d):
    """More documents than the threshold, which a provider that costs nothing may embed; a paid one is refused."""
    docs = A.table(spark, d, "documents").select("doc_id")
    try:
        J.cost_guard(docs, 10)
    except ValueError:
        return J.cost_guard(docs, 10, paid=False)
    return docs


def run_to_end(stream, spark, mode="append"):
    """A stream's rows once it has read all that is there."""
    path = fresh(spark)
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query()
def st1_discover(spark, d):
    """The files of the given tables, found by a stream of at most three files a trigger."""
    return run_to_end(streams.discover_stream(spark, d, 3), spark).select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "size", "hash")


@query("select doc_id, sha256(lower(text)) as hash from documents")
def st2_ingest(spark, d):
    """Documents written as ten files and ingested three files a batch, of which one fails at first; then batches are merged."""
    path = fresh(spark)
    docs = A.table(spark, d, "documents").select("doc_id", "text")
    docs.repartition(10).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 3).parquet(f"{path}/in")
    tries = []

    def work(batch):
        tries.append(1)
        rows = batch.select("doc_id", F.sha2(F.lower("text"), 256).alias("hash"))
        return rows.select("doc_id", F.expr("raise_error('no such luck')").cast("string").alias("hash")) if len(tries) == 2 else rows

    try:
        streams.ingest_stream(stream, work, f"{path}/out", f"{path}/state").awaitTermination()
    except StreamingQueryException:  # the second batch; what the first one published is still there
        streams.ingest_stream(stream, work, f"{path}/out", f"{path}/state").awaitTermination()
    log.compact(spark, f"{path}/out")
    return log.read(spark, f"{path}/out")


def run_complete(stream, spark):
    """The whole result of a running aggregation, published anew by each batch, once it has read all that is there."""
    path = fresh(spark)
    stream.writeStream.outputMode("complete").foreachBatch(lambda rows, n: log.publish(rows, f"{path}/out", str(n))).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return log.read(spark, f"{path}/out")


def run_updates(stream, spark):
    """What a running aggregation gave out, batch by batch, until it has read all that is there."""
    path = fresh(spark)
    stream.writeStream.outputMode("update").foreachBatch(lambda rows, n: log.publish_increment(rows, f"{path}/out", f"{n:012d}")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return log.read(spark, f"{path}/out")


def event_stream(spark, rows, key):
    """Rows as a stream of files, each key within one file."""
    path = fresh(spark)
    rows.repartition(4, key).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


ORACLES["st7_lifecycle"] = ORACLES["l8_fold_lifecycle"]


@query()
def st7_lifecycle(spark, d):
    """The state machine of requests as keyed state, two of a request's three events before the third: status after all events, and how many were rejected."""
    requests = A.requests(spark, d).select("request_id", "employee_id", "end_date", F.col("status").alias("initial"))
    own, ended = F.coalesce(F.col("actor_id") == F.col("employee_id"), F.lit(False)), F.coalesce(F.col("end_date") < F.col("day"), F.lit(False))
    rows = lifecycle_events(spark, d).join(requests, "request_id").select("request_id", "seq", "event", own.alias("is_own"), ended.alias("is_ended"), "initial")
    path = fresh(spark)
    for part in ("seq < 3", "seq = 3"):
        rows.filter(part).repartition(4, "request_id").write.mode("append").parquet(path)
    files_a_batch = -(-len(spark.read.parquet(path).inputFiles()) // 2)
    after = run_to_end(streams.lifecycle_stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)), spark)
    return after.groupBy("request_id").agg(F.max_by("status", "seq").alias("status"), F.count_if("rejected").cast("int").alias("n_rejected"))


@query(
    """with e as (select user_id, event_type, date_trunc('millisecond', ts::timestamp) as ts from events)
    select user_id as revision_id, ts as claimed_at from e c where event_type = 'view' and not exists (select 1 from e d where d.user_id = c.user_id and d.event_type = 'purchase' and d.ts between c.ts and c.ts + interval 30 minute)"""
)
def st6_claim_timeout(spark, d):
    """Views are claims and purchases complete them: claims that nothing completed within 30 minutes. Four files, one a batch, and a last event that lets all timers end."""
    kind = F.when(F.col("event_type") == "view", "claim").otherwise("done")
    rows = A.table(spark, d, "events").filter("event_type in ('view', 'purchase')").select(F.col("user_id").alias("revision_id"), kind.alias("event"), F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("ts"))
    path, n = fresh(spark), 4
    at = F.unix_micros("ts")
    low, high = rows.agg(F.min(at), F.max(at)).first()
    if low is None:
        return spark.createDataFrame([], "revision_id long, claimed_at timestamp")
    for k in range(n):
        rows.filter(F.floor((at - low) * n / F.lit(high - low + 1)) == k).write.mode("append").parquet(path)
    spark.range(1).select(F.lit(-1).cast("long").alias("revision_id"), F.lit("end").alias("event"), F.timestamp_micros(F.lit(high + 7_200_000_000)).alias("ts")).write.mode("append").parquet(path)
    files_a_batch = -(-len(spark.read.parquet(path).inputFiles()) // (n + 1))
    return run_to_end(streams.claim_timeout_stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)), spark)


@query("select doc_id, ceil(length(text) / 3.8)::int as plain, len(string_split(text, ' '))::int as words from documents")
def y5_token_counter(spark, d):
    """The closed form of a token count beside a user's own counter."""

    @F.pandas_udf("int")
    def words(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(t.split(" ")))

    docs = A.table(spark, d, "documents")
    return docs.select("doc_id", T.token_count(F.col("text")).alias("plain"), T.token_count(F.col("text"), words).alias("words"))


@query("select doc_id, sha256('Said: ' || text) as answer from documents")
def y6_generate_answers(spark, d):
    """A user's answer function over a prompt table."""
    prompts = A.table(spark, d, "documents").select("doc_id", F.col("text").alias("prompt"))
    return J.generate_answers(prompts, lambda texts: [f"Said: {t}" for t in texts]).select("doc_id", F.sha2("answer", 256).alias("answer"))


@query("select doc_id, length(text) as n, sha256(text) as parsed from documents where trim(text, ' ' || chr(10)) <> ''")
def y3_parser(spark, d):
    """A document's elements by the line parser, beside the text that it was given."""
    docs = A.table(spark, d, "documents")
    elements = S.build_elements(docs).select("doc_id").distinct()
    return docs.join(elements, "doc_id", "left_semi").select("doc_id", F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("parsed"))


def archived(spark, d, path, part="true"):
    """Documents as members of zip archives, each a minute younger than the one before (500,000 of them, so that none is of the future); keys begin with the rest of the number by 8."""
    docs = A.table(spark, d, "documents").filter(part)
    key = F.concat(F.col("doc_id") % 8, F.lit("/"), F.col("doc_id"), F.lit(".txt"))
    mtime = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01 00:00:00+00").cast("timestamp")) + 60 * (F.col("doc_id") % 500000))
    store.register(spark)
    docs.select(key.alias("key"), mtime.alias("mtime"), F.encode("text", "UTF-8").alias("content")).write.format("archives").option("path", path).mode("append").save()
    return path


STORED = "select doc_id % 8 || '/' || doc_id || '.txt' as key, strlen(text) as size, timestamp '2024-01-01' + to_minutes(doc_id % 500000) as mtime{more} from documents"


@query(STORED.format(more="") + " where doc_id % 8 = 3 and strlen(text) > 500")
def s1_store_listing(spark, d):
    """Documents in a store that is no file system: a prefix of keys and a least size, both tested by the store's reader."""
    rows = spark.read.format("archives").load(archived(spark, d, fresh(spark)))
    return rows.filter(F.col("key").startswith("3/") & (F.col("size") > 500)).select("key", "size", "mtime")


@query(STORED.format(more=", sha256(text) as hash"))
def s2_store_contents(spark, d):
    """All objects of the store, listed and then read where the tasks run."""
    path = archived(spark, d, fresh(spark))
    rows = store.with_contents(spark.read.format("archives").load(path), store.ArchiveStore(path))
    return rows.select("key", "size", "mtime", F.sha2("content", 256).alias("hash"))


@query(STORED.format(more=""))
def st1_store_stream(spark, d):
    """The store as a stream: one run up to the hundredth minute, and one that goes on from its offsets to what came later."""
    path, out = archived(spark, d, fresh(spark), "doc_id % 500000 < 100"), fresh(spark)
    for until in ("2024-01-01T01:40:00", None):
        source = spark.readStream.format("archives").option("path", path)
        rows = (source.option("until", until) if until else source).load()
        rows.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/out").awaitTermination()
        if until:
            archived(spark, d, path, "doc_id % 500000 >= 100")
    return spark.read.schema(rows.schema).parquet(f"{out}/out").select("key", "size", "mtime")
