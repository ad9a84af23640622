"""Helpers that the training-data operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlake.lineage import cut, shared_dir  # noqa: F401  (shared by the operators)

#: A word: a run of anything but the space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Characters that a Python task works on at once; bounds its memory whatever a batch holds.
SLICE_CHARS = 4_000_000


def free_name(name: str, taken: list[str]) -> str:
    """name, or with underscores added until it is none of those taken (Spark compares names without case)."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name


def row_key(columns: list[str]) -> Column:
    """128 bits that tell rows apart by all their columns; a null is a value of its own, in whichever column it stands."""
    marked = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return F.concat(F.hex(F.xxhash64(*marked)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), *reversed(marked))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(texts: list[str | None], most: int = SLICE_CHARS):
    """Ranges (from, to) of texts with about so many characters, at least one text each."""
    start = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t or "") > most:
            yield start, k
            start = k
            size = 0
        size += len(t or "")
    if len(texts) > start:
        yield start, len(texts)


def hook(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union-find over arrays: joins the trees of a[i] and b[i]; every root is the smallest index of its tree."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        np.minimum.at(parent, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long) as (node, component), component being the smallest node.

    Alternates large-star and small-star steps until the edges no longer change; each round is a grouped minimum
    (combined before its shuffle) and an equi join, and is written to the shared folder. No node's neighbours are
    ever gathered. Rounds go on until nothing changes, about the logarithm of the nodes. The root of a large component
    is a hot key of the join only on the side that AQE splits. Loops (a = b), repeated edges and nulls are ignored; no
    edges give no rows.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        now = cut(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", "m"))
            .filter("a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .distinct()
        )
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
