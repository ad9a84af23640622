"""Queries that run streams of several batches to their end, and over the batch twin of one."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from revlake.sources import adapters as A
from revlake.streaming import streams as S

from .base import ORACLES, query
from .stores import event_stream, fresh, run_complete, run_to_end, run_updates


def events(spark, d):
    return A.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("select job_id, count(*) as found, count(*) filter (outcome = 'PROCESSED') as processed, count(*) filter (outcome = 'SKIPPED') as skipped, count(*) filter (outcome = 'FAILED') as failed, coalesce(sum(n_chunks), 0)::bigint as chunks from items group by 1", "items")
def st3_job_counters(spark, d):
    return run_complete(S.job_counters_stream(event_stream(spark, A.job_items(spark, d), "event_id")), spark)


@query("select date_trunc('day', ts) as start, count(*) as n, round(avg(value), 9) as mean, percentile_disc(0.95) within group (order by value) as p95 from events group by 1")
def st4_latency_windows(spark, d):
    counts = run_complete(S.latency_counts_stream(event_stream(spark, events(spark, d), "event_id")), spark)
    return S.latency_windows(counts).withColumn("mean", F.round("mean", 9))


@query("select distinct user_id || '-' || event_type as key from events")
def st5_dedupe(spark, d):
    rows = events(spark, d).select(F.concat_ws("-", "user_id", "event_type").alias("key"), "ts", "event_id")
    return run_to_end(S.dedupe_stream(event_stream(spark, rows, "event_id"), "key", late="3650 days"), spark).select("key")


@query(
    """with g as (select *, case when created_at - lag(created_at) over (partition by conv_id order by created_at) < interval 90 second then 0 else 1 end as new from msgs), s as (select *, sum(new) over (partition by conv_id order by created_at rows unbounded preceding) as k from g)
    select conv_id, min(created_at) as start, max(created_at) + interval 90 second as "end", count(*) as n from s group by conv_id, k""",
    "msgs",
)
def st8_conversation_sessions(spark, d):
    return run_complete(S.conversation_stream(event_stream(spark, A.messages(spark, d), "turn"), "90 seconds", "3650 days"), spark)


@query(
    """with e as (select user_id || '-' || ts::date as message_id, row_number() over (partition by user_id, ts::date order by ts, event_id) as seq, case event_type when 'signup' then 'reset' when 'error' then 'final' else 'token' end as kind, event_id || ' ' as text from events),
    k as (select *, max(seq) filter (kind = 'reset') over (partition by message_id) as r from e)
    select message_id, coalesce(arg_max(text, seq) filter (kind = 'final'), string_agg(text, '' order by seq) filter (kind = 'token'), '') as content from k where r is null or seq > r group by 1""",
)
def st9_fold_answer_events(spark, d):
    kind = F.when(F.col("event_type") == "signup", "reset").when(F.col("event_type") == "error", "final").otherwise("token")
    e = A.table(spark, d, "events").select(F.concat_ws("-", "user_id", F.to_date("ts")).alias("message_id"), F.struct("ts", "event_id").alias("seq"), kind.alias("kind"), F.concat("event_id", F.lit(" ")).alias("text"))
    return S.fold_answer_events(e)


ORACLES["st9_fold_answer_stream"] = ORACLES["st9_fold_answer_events"]


@query()
def st9_fold_answer_stream(spark, d):
    """The same answers from a stream of two batches, in which the events of a message are interleaved."""
    kind = F.when(F.col("event_type") == "signup", "reset").when(F.col("event_type") == "error", "final").otherwise("token")
    key = F.concat_ws("-", "user_id", F.to_date("ts"))
    seq = F.row_number().over(Window.partitionBy("message_id").orderBy("ts", "event_id")).cast("long")
    e = A.table(spark, d, "events").withColumn("message_id", key).select("message_id", seq.alias("seq"), kind.alias("kind"), F.concat("event_id", F.lit(" ")).alias("text"))
    path = fresh(spark)
    for odd in (1, 0):
        e.filter(F.col("seq") % 2 == odd).write.mode("append").parquet(path)
    files_a_batch = -(-len(spark.read.parquet(path).inputFiles()) // 2)
    rows = run_updates(S.fold_answer_stream(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)), spark)
    return rows.groupBy("message_id").agg(F.max_by("content", "version").alias("content")).filter("content is not null")
