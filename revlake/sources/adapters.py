"""The engine's tables, derived from the given ones; each is a plan over Parquet scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlake.functions.text import token_count

# fixed values: the document types
TYPES = ["POLICY", "PROCEDURE", "STANDARD", "GUIDELINE", "MANUAL", "WORKFLOW", "FAQ", "FORM"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Chunks of a revision have ids of their own below this: a text has fewer than 2 ** 30 lines that are not blank.
CHUNKS = 1 << 30


def code(document_id: Column) -> Column:
    """DOC-AA-0000 on: the ten thousands as two letters, and as more of them where two are too few."""
    n = F.floor(document_id / 10000).cast("long")
    letters = [F.char(65 + F.floor(n / 26**k).cast("long") % 26) for k in range(8)]
    more = [F.when(n >= 26**k, letters[k]).otherwise("") for k in range(7, 1, -1)]
    return F.concat(F.lit("DOC-"), *more, letters[1], letters[0], F.lit("-"), F.lpad((document_id % 10000).cast("string"), 4, "0"))


def revisions(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    """One row a revision. Without text its column is never read."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    d = F.expr("doc_id div 3")
    status = (
        F.when(d % 17 == 0, "PENDING").when(F.col("quality") == 1, "READY").when(F.col("quality") == 0, "FAILED").when(F.col("doc_id") % 5 == 0, "PENDING").otherwise("READY")
    )
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("revision_id"),
        d.alias("document_id"),
        code(d).alias("document_code"),
        (F.col("doc_id") % 3 + 1).cast("int").alias("revision_number"),
        status.alias("status"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("created_at"),
        "source",
        "lang",
        "n_chars",
        F.coalesce("toxic", F.lit(0)).alias("toxic"),
        *(["text"] if text else []),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    revs = revisions(spark, sf_dir)
    kinds = F.array(*map(F.lit, TYPES))
    return revs.groupBy("document_id").agg(
        F.first("document_code").alias("document_code"),
        F.min_by("source", "revision_number").alias("department"),
        (F.max("toxic") == 0).alias("is_active"),
        F.min("created_at").alias("created_at"),
    ).withColumn("document_type", F.element_at(kinds, (F.col("document_id") % 8 + 1).cast("int"))).withColumn("title", F.concat(F.lit("Document "), F.col("document_code")))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a line: heading (first line, and a deeper one every ten) or paragraph, 40 lines a page."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("revision_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    level = F.when(F.col("line_no") == 0, 1).when(F.col("line_no") % 10 == 0, 3)
    return lines.withColumn("level", level).withColumn("type", F.when(F.col("level").isNull(), "paragraph").otherwise("heading")).withColumn("page", F.expr("int(line_no div 40 + 1)"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a non-blank line; numbered within its document's row, so nothing is shuffled.

    The first line is the title of all, every tenth one that of the lines from it on; both are lines of their own too.
    """
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line_no"), x.alias("content")))
    kept = F.filter(lines, lambda e: F.trim(e["content"]) != "")
    own = F.split("text", "\n")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("revision_id"), own.alias("lines"), F.posexplode(kept).alias("chunk_index", "e"))
    line = F.col("e.line_no")
    return rows.select(
        (F.col("revision_id") * CHUNKS + F.col("chunk_index")).alias("chunk_id"),
        "revision_id",
        F.expr("revision_id div 3").alias("document_id"),
        code(F.expr("revision_id div 3")).alias("document_code"),
        "chunk_index",
        F.get("lines", 0).alias("section_title"),
        F.when(line >= 10, F.get("lines", line - line % 10)).alias("subsection_title"),
        F.col("e.content").alias("content"),
        F.expr("int(e.line_no div 40 + 1)").alias("page"),
        token_count(F.col("e.content")).alias("tokens"),
        F.when(F.col("chunk_index") % 9 == 8, "ADMINISTRATIVE").otherwise("CONTENT").alias("section_role"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", at.alias("created_at"))


def job_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "view", "SKIPPED").otherwise("PROCESSED")
    return table(spark, sf_dir, "events").select(
        F.to_date("ts").alias("job_id"), "event_id", "ts", "user_id", "event_type", outcome.alias("outcome"), F.col("value").alias("latency_ms"), F.get_json_object("props", "$.k").cast("long").alias("n_chunks")
    )


def employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    five, three = F.array(*map(F.lit, [1, 2, 3, 4, 5])), F.array(*map(F.lit, [1, 2, 3]))
    kinds = F.array(*map(F.lit, ["PERMANENT", "FIXED_TERM", "CONTRACTOR", "INTERN"]))
    return table(spark, sf_dir, "customer").select(
        k.alias("employee_id"),
        F.col("c_name").alias("employee_number"),
        F.when(k % 5 == 0, three).otherwise(five).alias("working_days"),
        F.element_at(kinds, (k % 4 + 1).cast("int")).alias("employment_type"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "Head of Unit").otherwise("Analyst").alias("title"),
        (k % 29 != 0).alias("is_active"),
        F.when(k % 13 == 0, F.to_date(F.lit("1998-09-30"))).alias("probation_end"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    kinds = F.array(*map(F.lit, ["ANNUAL", "SICK", "UNPAID", "PARENTAL", "COMPASSIONATE", "STUDY"]))
    start = F.to_date("o_orderdate")
    rejected = F.when(F.col("o_orderpriority").startswith("1"), "WITHDRAWN").when(F.col("o_orderpriority").startswith("2"), "CANCELLED").otherwise("REJECTED")
    return table(spark, sf_dir, "orders").select(
        o.alias("request_id"),
        F.col("o_custkey").alias("employee_id"),
        start.alias("start_date"),
        F.date_add(start, (o % 9).cast("int")).alias("end_date"),
        F.element_at(kinds, (o % 6 + 1).cast("int")).alias("leave_type"),
        F.when(o % 10 == 0, "AFTERNOON").otherwise("FULL_DAY").alias("start_portion"),
        F.lit("FULL_DAY").alias("end_portion"),
        F.when(F.col("o_orderstatus") == "F", "APPROVED").when(F.col("o_orderstatus") == "O", "PENDING_APPROVAL").otherwise(rejected).alias("status"),
    )
