"""Listings stored in their order, in blocks of rows with their bounds: a page far down, or the page after a key, reads one block."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlake.lineage import cut

BLOCK_ROWS = 10_000


@dataclass(frozen=True)
class Pages:
    """A stored listing: rows with their place, by block; bounds (block, first, last, n)."""

    spark: SparkSession
    path: str
    by: tuple[str, ...]
    descending: bool
    block_rows: int


def store_pages(df: DataFrame, path: str, by: tuple[str, ...], descending: bool = False, block_rows: int = BLOCK_ROWS) -> Pages:
    """T2. by: the columns that order the rows, the last of them a key. Nulls are the least values.

    Rows are dealt by ranges and sorted there; the driver holds one number a partition.
    """
    spark = df.sparkSession
    order = [F.desc_nulls_last(c) if descending else F.asc_nulls_first(c) for c in by]
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    begin, total = [], 0
    for r in sorted(ranged.groupBy("part").count().collect()):
        begin.append((r["part"], total))
        total += r["count"]
    begins = spark.createDataFrame(begin, "part int, begin long")
    place = F.col("begin") + F.col("at").bitwiseAND((1 << 33) - 1)
    rows = ranged.join(F.broadcast(begins), "part").withColumn("place", place).drop("part", "at", "begin").withColumn("block", F.floor(F.col("place") / block_rows))
    blocks = max(1, -(-total // block_rows))
    rows.repartition(min(blocks, 1000), "block").sortWithinPartitions("block", "place").write.mode("overwrite").partitionBy("block").parquet(f"{path}/rows")
    key = F.struct(*by)
    stored = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    stored.groupBy("block").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/bounds")
    return Pages(spark, path, tuple(by), descending, block_rows)


def rows_of(pages: Pages) -> DataFrame:
    return pages.spark.read.parquet(f"{pages.path}/rows")


def page(pages: Pages, number: int, size: int) -> DataFrame:
    """T2. The rows of a page (from 1), with their place; only the one or two blocks that hold it are read."""
    low, high = (number - 1) * size, number * size - 1
    blocks = list(range(low // pages.block_rows, high // pages.block_rows + 1))
    return rows_of(pages).filter(F.col("block").isin(blocks) & F.col("place").between(low, high)).drop("block").orderBy("place")


def after(pages: Pages, key: tuple, size: int) -> DataFrame:
    """T2. The rows that follow a key (values of by, which need not be there): bounds name the block, the rest is read on demand.

    A block is read at a time until the page is full, so a page costs one block, or two where it crosses an edge.
    """
    bounds = pages.spark.read.parquet(f"{pages.path}/bounds")
    kind = bounds.schema["low"].dataType
    at = F.struct(*[F.lit(v).cast(kind[c].dataType).alias(c) for c, v in zip(pages.by, key)])
    beyond = (F.col("low") < at) if pages.descending else (F.col("high") > at)
    blocks = [r["block"] for r in bounds.filter(beyond).orderBy("block").limit(2 + size // pages.block_rows).collect()]
    own = F.struct(*pages.by)
    rows = rows_of(pages).filter(F.col("block").isin(blocks)).filter(own < at if pages.descending else own > at)
    return rows.drop("block").orderBy("place").limit(size)
