"""Nearest neighbours by randomly rotated one-bit codes.

A vector is rotated at random and keeps one bit a rotated component, its norm and how well the bits point its way. An
inner product is estimated from the packed bits of a vector and the query's rotated components in four bits, by counting
common bits; the scalars undo the shortening. The estimate's error is bounded with high probability, so only vectors
whose upper bound reaches the k-th exact product found so far are scored on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import cut, free_name
from .topk import usable

#: Rows of a block; components that a block holds at most; blocks of a shard and queries of a chunk, which one task meets.
BLOCK_ROWS, BLOCK_VALUES = 8_192, 1 << 22
SHARD_BLOCKS, CHUNK_QUERIES = 16, 4_096
#: Least number of bits of a code. More bits than components make the estimate of short vectors tighter.
LEAST_BITS = 256
#: The error bound, in standard deviations of the estimate.
DEVIATIONS = 4.0
PLANES = 4
CODES = "shard int, block int, width int, ids binary, bits binary, norm binary, lean binary, vectors binary, asks binary"


@lru_cache(maxsize=4)
def rotation(width: int, seed: int) -> np.ndarray:
    """A random rotation into as many components as a code has bits: orthonormal rows."""
    bits = max(LEAST_BITS, -(-width // 64) * 64)
    return np.ascontiguousarray(np.linalg.qr(np.random.default_rng((seed, width)).standard_normal((bits, width)))[0].T)


def encode(m: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: its bits in 64-bit words, its norm, and the cosine of its direction and its bits' direction."""
    most = np.abs(m).max(axis=1)
    unit = m / most[:, None]
    short = np.linalg.norm(unit, axis=1)
    turned = (unit / short[:, None]) @ rotation(m.shape[1], seed)
    bits = np.packbits(turned > 0, axis=1, bitorder="little").view(np.uint64)
    with np.errstate(over="ignore"):
        return bits, most * short, np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])


def build_codes(rows: DataFrame, seed: int = 11, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows: (id long, vector array, asks boolean). One row a block (CODES); every row is in one block, with its vector."""
    kind = rows.schema["vector"].dataType.elementType
    exact = np.float64 if kind == DoubleType() else np.float32
    parts = max(1, -(-rows.count() // block_rows))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, block = TaskContext.get().partitionId(), 0
        for some in batches:
            for width, same in some.groupby(some["vector"].map(len), sort=False):
                step = max(1, min(block_rows, BLOCK_VALUES // width))
                for k in range(0, len(same), step):
                    own = same.iloc[k : k + step]
                    m = np.array(own["vector"].tolist(), exact).reshape(len(own), width)
                    bits, norm, lean = encode(m.astype(np.float64), seed)
                    row = (part, block, width, own["id"].to_numpy(np.int64).tobytes(), bits.tobytes(), norm.tobytes(), lean.tobytes(), m.tobytes(), own["asks"].to_numpy(bool).tobytes())
                    block += 1
                    yield pd.DataFrame([row], columns=[c.split()[0] for c in CODES.split(", ")])

    return rows.repartition(parts).mapInPandas(pack, CODES)


class Block:
    """A block's codes, unpacked, and the parts of the estimate that depend on the vector alone."""

    def __init__(self, row, exact):
        n = len(row.ids) // 8
        self.part, self.block = row.shard, row.block
        self.ids = np.frombuffer(row.ids, np.int64)
        self.bits = np.ascontiguousarray(np.frombuffer(row.bits, np.uint64).reshape(n, -1).T)
        self.size = self.bits.shape[0] * 64
        self.ones = np.bitwise_count(self.bits).sum(axis=0, dtype=np.int64)
        self.vectors = np.ascontiguousarray(np.frombuffer(row.vectors, exact).reshape(n, -1).T.astype(np.float64))
        norm, lean = np.frombuffer(row.norm, np.float64), np.frombuffer(row.lean, np.float64)
        with np.errstate(over="ignore"):
            self.scale = norm / (lean * np.sqrt(self.size))
            self.spread = norm * norm * (1 - lean * lean).clip(0) / (lean * lean * max(1, self.size - 1))
            self.coarse = self.scale * self.scale

    def estimate(self, q: Query) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products with q, and the bounds of their errors."""
        common = np.zeros(len(self.ids), np.int64)
        for j in range(PLANES):
            for w in range(len(self.bits)):
                common += np.bitwise_count(self.bits[w] & q.planes[j, w]).astype(np.int64) << j
        with np.errstate(over="ignore", invalid="ignore"):
            signed = q.low * (2 * self.ones - self.size) + q.step * (2.0 * common - q.total)
            return self.scale * signed, DEVIATIONS * np.sqrt(q.square * self.spread + q.lost * self.coarse)

    def products(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact inner products, summed component by component, so that equal vectors get equal ones."""
        with np.errstate(over="ignore", invalid="ignore"):
            return np.multiply(self.vectors[:, at], q[:, None], order="C").sum(axis=0)


class Query:
    """A query's rotated components, rounded to PLANES bits, one bit of all components a plane."""

    def __init__(self, vector: np.ndarray, seed: int):
        self.vector = vector
        with np.errstate(over="ignore", invalid="ignore"):
            turned = vector @ rotation(len(vector), seed)
            self.low = float(turned.min())
            self.step = (float(turned.max()) - self.low) / (2**PLANES - 1) or 1.0
            level = np.clip(np.nan_to_num((turned - self.low) / self.step + 0.5), 0, 2**PLANES - 1).astype(np.uint8)
            self.total = int(level.sum(dtype=np.int64))
            self.square = float(vector @ vector)
            self.lost = float(((turned - self.low - level * self.step) ** 2).sum())
        self.planes = np.stack([np.packbits(level >> j & 1, bitorder="little").view(np.uint64) for j in range(PLANES)])


def search(blocks: list[Block], q: Query, own: tuple[int, int, int], k: int, floor: float) -> tuple[np.ndarray, np.ndarray, int]:
    """The k largest products with rows of the blocks, ties to the smaller id; and how many rows were scored exactly.

    own: block and place of the query's row, which is no candidate. floor: a k-th product known from elsewhere.
    """
    scores, ids, scored = np.zeros(0), np.zeros(0, np.int64), 0
    for b in blocks:
        about, error = b.estimate(q)
        chosen = np.zeros(len(b.ids), bool)
        best = np.argpartition(-about, min(k, len(about) - 1))[:k]  # a floor of this block's own, from its likeliest rows
        chosen[best] = True
        mine = own[2] if own[:2] == (b.part, b.block) else -1
        sure = np.concatenate([scores, b.products(q.vector, best[best != mine])])
        if len(sure) >= k:
            floor = max(floor, float(np.partition(sure, -k)[-k]))
        chosen |= ~(about + error < floor)
        if mine >= 0:
            chosen[mine] = False
        at = np.flatnonzero(chosen)
        scored += len(at)
        scores, ids = np.concatenate([scores, b.products(q.vector, at)]), np.concatenate([ids, b.ids[at]])
        order = np.lexsort((ids, -scores))[:k]
        scores, ids = scores[order], ids[order]
    return scores, ids, scored


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id: str = "vec_id", vector: str = "embedding", seed: int = 11, block_rows: int = BLOCK_ROWS, chunk: int = CHUNK_QUERIES, counts: bool = False) -> DataFrame:
    """(query_id, rank, id, score): the k rows of largest inner product of each query row, found among all other rows.

    queries: which rows are queries. Scores are double-precision products of the original vectors, summed in order.
    Approximate: a row is missed if its estimate errs by over DEVIATIONS standard deviations, so nearly never; whatever
    is returned is scored exactly. Ties go to the smaller id. Null and zero vectors, those with null or non-finite
    components, and rows without an id take no part; vectors meet those of their own width only. Only a query's own
    row is no candidate: other rows of its id are, and rows that repeat an id are queries of their own, each with its
    own ranks. Fewer than k candidates: all of them; an empty table: no rows. An id called query_id, rank or score gets
    an underscore at its end; other columns are not read. counts: adds how many rows were scored exactly, of all.

    The codes are stored once. Chunks of queries meet one shard of blocks, whose k-th product is their floor in all
    other shards; each pair of chunk and shard is a task of bounded size that keeps k rows a query. The work is that of
    all queries against all rows, at some 40 bytes of code a pair.
    """
    v = F.col(vector)
    kind = vectors.schema[vector].dataType
    if not (isinstance(kind, ArrayType) and kind.elementType.typeName() in ("float", "double")):
        v = v.cast("array<double>")
    rows = vectors.select(F.col(id).cast("long").alias("id"), v.alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("vector")) & F.exists("vector", lambda x: x != 0))
    exact = np.float64 if rows.schema["vector"].dataType.elementType == DoubleType() else np.float32
    codes = cut(build_codes(rows, seed, block_rows))

    def asking(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            for b in some.itertuples():
                at = np.flatnonzero(np.frombuffer(b.asks, bool))
                m = np.frombuffer(b.vectors, exact).reshape(-1, b.width)[at].astype(np.float64)
                yield pd.DataFrame({"q_part": b.shard, "q_block": b.block, "place": at, "id": np.frombuffer(b.ids, np.int64)[at], "width": b.width, "q": [x.tobytes() for x in m]})

    asked = cut(codes.select("shard", "block", "width", "ids", "vectors", "asks").mapInPandas(asking, "q_part int, q_block int, place int, id long, width int, q binary"))
    chunks, last = max(1, -(-asked.count() // chunk)), codes.agg(F.max("shard")).first()[0] or 0
    joined = max(1, min(SHARD_BLOCKS, (last + 1) // (2 * codes.sparkSession.sparkContext.defaultParallelism)))
    shards = last // joined + 1
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("q_part", "q_block", "place"), F.lit(chunks)).cast("int"))
    codes = codes.withColumn("group", F.floor(F.col("shard") / joined).cast("int"))

    def tile(some: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        for width, mine in asks.groupby("width", sort=False):
            blocks = [Block(b, exact) for b in some[some["width"] == width].itertuples()]
            for a in mine.itertuples() if blocks else ():
                scores, ids, scored = search(blocks, Query(np.frombuffer(a.q, np.float64), seed), (a.q_part, a.q_block, a.place), k, a.floor)
                out.append(pd.DataFrame({"q_part": a.q_part, "q_block": a.q_block, "place": a.place, "id": a.id, "vec": ids, "score": scores, "scored": np.where(np.arange(len(ids)) == 0, scored, 0)}))
        return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in hits.split(", ")])

    hits = "q_part int, q_block int, place int, id long, vec long, score double, scored long"
    own = ["q_part", "q_block", "place"]

    def met(groups: DataFrame, asks: DataFrame, first: int, to: int) -> DataFrame:
        left = groups.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        right = asks.withColumn("group", F.explode(F.sequence(F.lit(first), F.lit(to))))
        return left.groupBy("group", "chunk").cogroup(right.groupBy("group", "chunk")).applyInPandas(tile, hits)

    found = met(codes.filter("group = 0"), asked.withColumn("floor", F.lit(float("-inf"))), 0, 0)
    if shards > 1:
        found = cut(found)
        kth = found.groupBy(*own).agg(F.when(F.count("*") >= k, F.min("score")).otherwise(float("-inf")).alias("floor"))
        floored = asked.join(kth, own, "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        found = found.unionByName(met(codes.filter("group > 0"), floored, 1, shards - 1))
    rank = F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("score"), "vec"))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    extra = []
    if counts:
        done = found.groupBy(*own).agg(F.sum("scored").alias("exactly"))
        ranked, extra = ranked.join(done, own), ["exactly"]
    return ranked.select(F.col("id").alias("query_id"), F.col("rank").cast("int"), F.col("vec").alias(free_name(id, ["query_id", "rank", "score"])), "score", *extra)
