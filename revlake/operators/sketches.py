"""Quantiles from stored sketches: counts of values by buckets of equal ratio, which add up over any range of days.

A bucket holds the values whose logarithm to the base (1 + error) / (1 - error) rounds up to its number, so its middle is
within that error of every value in it; and so is a quantile, whatever was merged, in whatever order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlake.sources import log

#: The relative error of a quantile; the least size of a value that is not counted as zero.
ERROR, LEAST = 0.01, 1e-9


def base(error: float) -> float:
    return (1 + error) / (1 - error)


def bucket(value: Column, error: float = ERROR) -> Column:
    """(sign, number): negative values count by their size; sizes below LEAST are zero."""
    size = F.abs(value)
    sign = F.when(size < LEAST, 0).when(value < 0, -1).otherwise(1)
    return F.struct(sign.cast("int").alias("sign"), F.when(size < LEAST, 0).otherwise(F.ceil(F.log(size) / math.log(base(error)))).cast("int").alias("number"))


def middle(sign: Column, number: Column, error: float = ERROR) -> Column:
    return sign * F.pow(F.lit(base(error)), number) * 2 / (base(error) + 1)


def sketch(df: DataFrame, value: str, *by: str, error: float = ERROR) -> DataFrame:
    """(by, sign, number, n, total): nulls and values that are no numbers are left out. Counted before the shuffle."""
    rows = df.select(*by, F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v) and abs(v) <> double('infinity')").withColumn("b", bucket(F.col("v"), error))
    return rows.groupBy(*by, "b.sign", "b.number").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


def store(df: DataFrame, path: str, value: str, day: str, error: float = ERROR) -> None:
    """A6, ST4. Publishes the sketches of the days in df; a day that comes again takes the place of its first time."""
    spark = df.sparkSession
    folder = log.write(sketch(df.withColumn("day", F.to_date(day)), value, "day", error=error), path, "day")
    days = [r[0] for r in df.select(F.to_date(day)).distinct().collect() if r[0]]  # one value a day
    log.commit(spark, path, lambda parts: parts | {str(d): f"{folder}/day={d}" for d in days})


def quantiles(sketches: DataFrame, ps: tuple[float, ...], *by: str, error: float = ERROR) -> DataFrame:
    """(by, n, mean, p..): nearest-rank quantiles of sketches added up by some columns, or of all of them.

    A group has as many buckets as its values' range has, some thousands at most, however many values there are.
    """
    rows = sketches.groupBy(*by, "sign", "number").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    order = Window.partitionBy(*[F.col(c) for c in by] or [F.lit(0)]).orderBy("sign", F.col("sign") * F.col("number"))
    every = Window.partitionBy(*[F.col(c) for c in by] or [F.lit(0)])
    rows = rows.withColumns({"upto": F.sum("n").over(order), "all": F.sum("n").over(every), "v": middle(F.col("sign"), F.col("number"), error)})
    cols = [F.min_by("v", F.when(F.col("upto") >= F.greatest(F.ceil(F.lit(p) * F.col("all")), F.lit(1)), F.col("upto"))).alias(f"p{round(p * 100)}") for p in ps]
    return rows.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"), *cols)


def read_quantiles(spark: SparkSession, path: str, first: str, last: str, ps: tuple[float, ...] = (0.5, 0.95, 0.99), error: float = ERROR) -> DataFrame:
    """A6 for any range of days: only the sketches of these days are read."""
    parts = log.live(spark, path)[1]
    days = [d for d in parts if first <= d <= last]
    rows = log.read(spark, path, days) if days else log.read(spark, path).limit(0)
    return quantiles(rows, ps, error=error)
