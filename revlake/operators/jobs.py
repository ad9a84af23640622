"""Ingestion runs: outcomes, roll-ups, embedding batches and audits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlake.config import DEFAULT, Config
from revlake.functions import text as T
from revlake.functions.words import Words, words_of
from revlake.operators.structure import text_guards


def job_rollup(items: DataFrame) -> DataFrame:
    """A10."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    return items.groupBy("job_id").agg(F.count("*").alias("found"), n("PROCESSED").alias("processed"), n("SKIPPED").alias("skipped"), n("FAILED").alias("failed"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks"))


def job_status(items: DataFrame, most_errors: int = 10, most_chars: int = 4000) -> DataFrame:
    """A11. items: (job_id, item_id, outcome, error). Status, and the first failures as a bounded summary."""
    counts = items.groupBy("job_id").agg(F.count_if(F.col("outcome") == "FAILED").alias("failed"), F.count_if(F.col("outcome") != "FAILED").alias("good"))
    w = Window.partitionBy("job_id").orderBy("item_id")
    first = items.filter("outcome = 'FAILED'").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most_errors)
    errors = first.groupBy("job_id").agg(F.substring(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "error"))), lambda x: x["error"]), "\n"), 1, most_chars).alias("error_summary"))
    status = F.when(F.col("failed") == 0, "COMPLETED").when(F.col("good") > 0, "PARTIALLY_COMPLETED").otherwise("FAILED")
    return counts.join(errors, "job_id", "left").select("job_id", status.alias("status"), "error_summary")


def job_duration(items: DataFrame) -> DataFrame:
    """A12. Milliseconds from the first to the last item."""
    return items.groupBy("job_id").agg((F.unix_millis(F.max("ts").cast("timestamp")) - F.unix_millis(F.min("ts").cast("timestamp"))).alias("duration_ms"))


def latest(df: DataFrame, by: str, *order: str) -> DataFrame:
    """W10. The latest row of each group."""
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("n_", F.row_number().over(w)).filter("n_ = 1").drop("n_")


def recent_traces(traces: DataFrame, n: int, source: str | None = None) -> DataFrame:
    """F7. The newest n, of one source if asked."""
    rows = traces if source is None else traces.filter(F.col("source") == source)
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def process_revisions(claimed: DataFrame, known: DataFrame) -> DataFrame:
    """K1. claimed: (revision_id, text); known: (revision_id, content_hash, n_chunks). The outcome of each, errors as columns.

    A revision fails in its own row only: PARSE errors give FAILED, an unchanged hash with chunks SKIPPED.
    """
    rows = text_guards(claimed).withColumn("new_hash", T.content_hash(F.coalesce("text", F.lit("")))).join(known, "revision_id", "left")
    same = F.coalesce((F.col("new_hash") == F.col("content_hash")) & (F.col("n_chunks") > 0), F.lit(False))
    outcome = F.when(F.col("error") == "EMPTY", "SKIPPED").when(F.col("error").isNotNull(), "FAILED").when(same, "SKIPPED").otherwise("PROCESSED")
    reason = F.when(F.col("error") == "EMPTY", "NO_CONTENT").when(F.col("error").isNull() & same, "UNCHANGED_CONTENT")
    return rows.select("revision_id", outcome.alias("outcome"), reason.alias("skip_reason"), F.when(outcome == "FAILED", "PARSE").alias("stage"), F.when(outcome == "FAILED", F.col("error")).alias("error"))


def cost_guard(df: DataFrame, threshold: int = DEFAULT.cost_threshold, paid: bool = True, allowed: bool = False) -> DataFrame:
    """M2. Refuses more than the threshold for a paid provider; reads one row more than that at most."""
    if paid and not allowed and df.limit(threshold + 1).count() > threshold:
        raise ValueError(f"more than {threshold} documents for a paid provider")
    return df


def embed(df: DataFrame, fn: Callable[[list[str]], list], width: int, text: str = "content", out: str = "embedding", cfg: Config = DEFAULT) -> DataFrame:
    """S16, Y1. Vectors by a user's batch function: blank texts become one space, long ones are cut, order is kept.

    A batch that returns another number of vectors, or another width, fails.
    """
    batch, most = cfg.embed_batch, int(cfg.embed_max_tokens * 3.8)

    @F.pandas_udf("array<float>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            clean = [(t or "")[:most] if (t or "").strip() else " " for t in texts]
            got: list = []
            for k in range(0, len(clean), batch):
                own = fn(clean[k : k + batch])
                if len(own) != len(clean[k : k + batch]) or any(len(v) != width for v in own):
                    raise ValueError("the provider returned other vectors than asked for")
                got += [np.asarray(v, np.float32) for v in own]
            yield pd.Series(got, dtype=object)

    return df.withColumn(out, run(F.col(text)))


def slots(word: str, width: int, hashes: int) -> tuple[list[int], list[float]]:
    """The components that a term touches, and with which sign."""
    out = []
    for k in range(hashes):
        h = 2166136261
        for byte in f"{k}:{word}".encode():
            h = (h ^ byte) * 16777619 & 0xFFFFFFFF
        out.append((h % width, 1.0 if h >> 16 & 1 else -1.0))
    return [i for i, _ in out], [s for _, s in out]


#: Words over this length are hashed one by one.
LONG_WORD = 64


def slots_of(words: Words, width: int, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """slots of the different words of a batch, (words, hashes) each."""
    short = np.flatnonzero(words.size <= LONG_WORD)
    short = short[np.argsort(-words.size[short], kind="stable")]  # those that go on stand first
    start, size = words.start[short], words.size[short]
    h = np.empty((len(words.size), hashes), np.uint32)
    for k in range(hashes):
        own = 2166136261
        for byte in f"{k}:".encode():
            own = (own ^ byte) * 16777619 & 0xFFFFFFFF
        own = np.full(len(short), own, np.uint32)
        for place in range(size[0] if len(short) else 0):
            n = np.searchsorted(-size, -place)  # words longer than that
            own[:n] = (own[:n] ^ words.data[start[:n] + place]) * np.uint32(16777619)
        h[short, k] = own
    at, sign = (h % np.uint32(width)).astype(np.int64), np.where(h >> 16 & 1, 1.0, -1.0)
    for n in np.flatnonzero(words.size > LONG_WORD):
        word = words.data[words.start[n] : words.start[n] + words.size[n]].tobytes().decode()
        at[n], sign[n] = slots(word, width, hashes)
    return at, sign


def hash_vectors(texts: list[str], width: int = 64, hashes: int = 4) -> np.ndarray:
    """M1 for a batch: signed hashes of each term, weighing 1 + ln(tf), normalised; a text without terms is the first unit vector."""
    words = words_of(pa.array(texts, pa.large_string()))
    pair, count = np.unique(words.row * max(1, len(words.size)) + words.number, return_counts=True)
    row, word = pair // max(1, len(words.size)), pair % max(1, len(words.size))
    at, sign = slots_of(words, width, hashes)
    weight = sign[word] * (1 + np.log(count))[:, None]
    out = np.bincount((row[:, None] * width + at[word]).ravel(), weight.ravel(), len(texts) * width).reshape(len(texts), width)
    norm = np.linalg.norm(out, axis=1)
    out[norm == 0, 0] = 1.0
    return out / np.where(norm == 0, 1.0, norm)[:, None]


def hash_embed(df: DataFrame, text: str = "content", width: int = 64, out: str = "embedding") -> DataFrame:
    """M1. Hashing vectoriser of whole texts, in double precision; null is an empty text. Flagged as not semantic."""

    @F.pandas_udf("array<double>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            yield pd.Series(list(hash_vectors([t or "" for t in texts], width)), dtype=object)

    return df.withColumn(out, run(F.col(text))).withColumn("is_semantic", F.lit(False))


def term_weights(df: DataFrame, key: str, text: str) -> DataFrame:
    """A16. (key, term, weight): 1 + ln(tf)."""
    return df.select(key, F.explode(T.terms(F.col(text))).alias("term")).groupBy(key, "term").agg((1 + F.log(F.count("*"))).alias("weight"))


def audit_tool_calls(calls: DataFrame, write: str = "apply", prerequisite: str = "validate") -> DataFrame:
    """W11. calls: (turn_id, seq, tool, ok, signature). Verdict of each call in its turn.

    A write needs an earlier successful prerequisite; an identical write is refused. Refused calls satisfy nothing.
    """
    w = Window.partitionBy("turn_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ready = F.coalesce(F.max((F.col("tool") == prerequisite) & F.col("ok")).over(w), F.lit(False))
    rows = calls.withColumn("ready", ready).withColumn("free", (F.col("tool") == write) & F.col("ready"))
    again = F.row_number().over(Window.partitionBy("turn_id", "tool", "signature", "free").orderBy("seq")) > 1
    verdict = F.when(F.col("tool") != write, "ALLOWED").when(~F.col("ready"), "MISSING_PREREQUISITE").when(again, "DUPLICATE").otherwise("ALLOWED")
    return rows.withColumn("verdict", verdict).drop("ready", "free")


def generate_answers(prompts: DataFrame, fn: Callable[[list[str]], list[str]]) -> DataFrame:
    """Y6. Answers of a prompt table by a user's batch function."""

    @F.pandas_udf("string")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            yield pd.Series(fn(texts.tolist()), dtype=object)

    return prompts.withColumn("answer", run("prompt"))


def corpus_summary(docs: DataFrame, *by: str) -> DataFrame:
    """A20. Documents, active ones and repeated texts by group."""
    text = docs.groupBy("content_hash").agg(F.count("*").alias("copies"))
    return docs.join(text, "content_hash").groupBy(*by).agg(F.count("*").alias("n"), F.count_if("is_active").alias("active"), F.count_if(F.col("copies") > 1).alias("repeated"))


def running_share(value: Column, total: Column) -> Column:
    """C14. A ratio as a percentage with one decimal."""
    return F.format_string("%.1f%%", 100 * F.coalesce(F.try_divide(value, total), F.lit(0.0)))
