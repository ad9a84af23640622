"""File stores, gold files and sinks."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlake.functions import text as T

#: Files that are named to a reader one by one.
MOST_PATHS = 10_000
GOLD = "id string, question string, type string, expectedCode string, expectedRevision int, expectedSection string, expectedFacts array<string>, noAnswer boolean, supersededAnswer string"


def scan_store(spark: SparkSession, root: str) -> DataFrame:
    """S1. (key, size, mtime) of every file below root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    key = F.regexp_replace("path", r"^.*?\Q" + root.rstrip("/").split("://")[-1] + r"\E/", "")
    return files.select(key.alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def read_contents(spark: SparkSession, root: str, keys: DataFrame | None = None) -> DataFrame:
    """S2. (key, content, hash), read where the tasks run; only of the given keys if there are any."""
    paths = root
    if keys is not None:  # contents of other files are not read where the names are few
        named = [r[0] for r in scan_store(spark, root).join(keys.select("key"), "key", "left_semi").select("key").limit(MOST_PATHS + 1).collect()]
        if len(named) <= MOST_PATHS:
            paths = [f"{root.rstrip('/')}/" + re.sub(r"([\[\]{}*?\\])", r"\\\1", k) for k in named]
    if paths == []:
        return spark.createDataFrame([], "key string, content binary, hash string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    key = F.regexp_replace("path", r"^.*?\Q" + root.rstrip("/").split("://")[-1] + r"\E/", "")
    rows = files.select(key.alias("key"), "content")
    rows = rows if keys is None else rows.join(keys.select("key"), "key", "left_semi")
    return rows.withColumn("hash", F.sha2("content", 256))


def with_content_type(df: DataFrame, key: str = "key") -> DataFrame:
    """S3."""
    return df.withColumn("content_type", T.content_type(F.col(key)))


def parse_registry(df: DataFrame, parsers: dict[str, Callable[[DataFrame], DataFrame]], kind: str = "content_type", key: str = "key") -> DataFrame:
    """S9. Rows go to the parser of their content type, which returns (key, text); rows of no known type get an error."""
    out = df.filter(~F.col(kind).isin(list(parsers))).select(key, F.lit(None).cast("string").alias("text"), F.lit("NO_PARSER").alias("error"))
    for name, parse in parsers.items():
        out = out.unionByName(parse(df.filter(F.col(kind) == name)).select(key, "text", F.lit(None).cast("string").alias("error")))
    return out


def plain_text(df: DataFrame) -> DataFrame:
    return df.select("key", F.decode("content", "UTF-8").alias("text"))


def read_gold(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """S10. Gold questions of a JSON file {"questions": [...]}; an empty one is an error. parts: many files, with such an object a line."""
    rows = spark.read.schema(f"questions array<struct<{', '.join(f'{c.strip().split(" ", 1)[0]}: {c.strip().split(" ", 1)[1]}' for c in GOLD.split(','))}>>").json(path, multiLine=not parts)
    out = rows.select(F.inline("questions"))
    if out.isEmpty():
        raise ValueError("the gold dataset has no questions")
    return out


def write_chunks(chunks: DataFrame, path: str, batch: str) -> None:
    """S12. Chunks of one run below their own partition; parents are known by hash, so no order is needed."""
    parent = F.when(F.col("parent_index").isNotNull(), F.sha2(F.concat_ws(":", "revision_id", "parent_index"), 256))
    rows = chunks.withColumns({"chunk_key": F.sha2(F.concat_ws(":", "revision_id", "chunk_index"), 256), "parent_key": parent, "is_current": F.lit(False), "batch": F.lit(batch)})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def write_eval(run: DataFrame, results: DataFrame, path: str, run_id: str) -> None:
    """S15. The run's metrics and its question rows, by run."""
    for name, df in (("runs", run), ("results", results)):
        df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}/{name}")
