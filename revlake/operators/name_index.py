"""Substring search over stored trigrams: the postings of a pattern's trigrams are intersected, and what is left is verified."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of trigrams and of rows, and rows that share a block of a trigram's postings.
BUCKETS, BLOCK_ROWS = 64, 16_384


@dataclass(frozen=True)
class NameIndex:
    """Postings (gram, keys) and the rows themselves, both by bucket, below a folder."""

    spark: SparkSession
    path: str
    key: str
    columns: tuple[str, ...]


def bucket_of(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def grams(text: Column) -> Column:
    """The distinct runs of three characters of a lower-cased text."""
    low = F.lower(text)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.substr(low, i, F.lit(3))))


def store_names(rows: DataFrame, path: str, key: str, columns: tuple[str, ...]) -> NameIndex:
    """F3. rows: a long key and the columns that are searched. A common trigram is dealt into blocks by its rows' keys."""
    rows = rows.select(key, *columns)
    parts = max(1, -(-rows.count() // BLOCK_ROWS))
    rows.withColumn("bucket", bucket_of(F.col(key))).repartition(BUCKETS, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows")
    every = F.array_distinct(F.concat(*[F.coalesce(grams(F.col(c)), F.array().cast("array<string>")) for c in columns]))
    posts = rows.select(F.col(key).alias("key"), F.explode(every).alias("gram")).filter(F.length("gram") == 3)
    posts = posts.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts))).groupBy("gram", "part").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    posts.withColumn("bucket", bucket_of(F.col("gram"))).repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/posts")
    return NameIndex(rows.sparkSession, path, key, tuple(columns))


def wanted_grams(needle: str) -> list[str]:
    """Trigrams that every match holds: those of the runs between % and _ (a backslash takes the meaning of what follows it)."""
    runs, now = [], ""
    for part in re.findall(r"\\.|[^\\]|\\$", needle, re.S):
        if part in ("%", "_"):
            runs.append(now)
            now = ""
        else:
            now += part[-1]
    return sorted({low[i : i + 3] for run in [*runs, now] for low in [run.lower()] for i in range(len(low) - 2)})


def candidates(index: NameIndex, needle: str) -> DataFrame | None:
    """Keys of rows that hold all trigrams of the needle, from the buckets of these alone; None if it has none."""
    asked = wanted_grams(needle)
    if not asked:
        return None
    spark = index.spark
    found = spark.createDataFrame([(g,) for g in asked], "gram string").withColumn("bucket", bucket_of(F.col("gram")))
    buckets = sorted({r["bucket"] for r in found.collect()})
    posts = spark.read.parquet(f"{index.path}/posts").filter(F.col("bucket").isin(buckets) & F.col("gram").isin(asked))
    return posts.select(F.explode("keys").alias(index.key), "gram").groupBy(index.key).agg(F.count("*").alias("n")).filter(F.col("n") == len(asked)).select(index.key)


def search_names(index: NameIndex, needle: str) -> DataFrame:
    """F3. Rows with the needle in any column, whatever its case; % and _ keep their meaning.

    Only buckets of rows that hold a candidate are read. A needle without a run of three characters scans all rows.
    """
    rows = index.spark.read.parquet(f"{index.path}/rows")
    held = functools.reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{needle}%") for c in index.columns])
    some = candidates(index, needle)
    if some is not None:
        buckets = [r[0] for r in some.select(bucket_of(F.col(index.key))).distinct().collect()]  # at most BUCKETS
        rows = rows.filter(F.col("bucket").isin(buckets)).join(some, index.key, "left_semi")
    return rows.filter(held).select(index.key, *index.columns)
