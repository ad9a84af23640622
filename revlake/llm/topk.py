"""Exact top-k inner-product search by block-at-a-time pruning.

Vectors are put, by id ranges, into blocks that keep the largest and smallest value of each term (component) and a
forward index of their rows; blocks make up shards, which keep the same maxima. A query bounds each block by its summed
term maxima, visits blocks from the highest bound down and scores them through the forward index until no bound reaches
its k-th score. It first searches the shard of its highest bound; only shards whose bound reaches the k-th score found
there get the query at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name

#: Rows of a block; rows of a shard, and queries of a chunk, that one task holds at once.
BLOCK_ROWS = 256
SHARD_ROWS = 16_384
CHUNK_QUERIES = 2_048
#: Shards whose maxima meet a chunk of queries in one tile.
PART_SHARDS = 1_024
NO_FLOOR = -(2**63)
NO_ID = np.iinfo(np.int64).max


def usable(vector: Column) -> Column:
    """Not null, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def build_blocks(rows: DataFrame, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows: (id long, vector array<long>). One row a block: shard, width, ids, rows (64-bit, packed), high, low."""
    parts = max(1, -(-rows.count() // shard_rows))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = TaskContext.get().partitionId()
        for some in batches:
            for width, same in some.groupby(some["vector"].map(len), sort=False):
                out = []
                for k in range(0, len(same), block_rows):
                    part = same.iloc[k : k + block_rows]
                    m = np.array(part["vector"].tolist(), np.int64).reshape(len(part), width)
                    out.append((shard, width, part["id"].to_numpy(np.int64).tobytes(), m.tobytes(), m.max(0).tobytes(), m.min(0).tobytes()))
                yield pd.DataFrame(out, columns=["shard", "width", "ids", "rows", "high", "low"])

    ranged = rows.repartitionByRange(parts, "id").sortWithinPartitions("id")
    return ranged.mapInPandas(pack, "shard int, width int, ids binary, rows binary, high binary, low binary")


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T over integers; through doubles where that is exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def search(blocks: list[tuple], own: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (scores, ids) of each query over blocks (ids, rows, high, low), NO_ID where there are fewer, and the blocks scored.

    floor: k-th scores known from elsewhere; rows below them need not be found.
    """
    least, scored = np.iinfo(np.int64).min, np.zeros(len(q), np.int64)
    scores, ids = np.full((len(q), k), least, np.int64), np.full((len(q), k), NO_ID, np.int64)
    floor = np.full(len(q), least) if floor is None else floor
    bounds = times(np.maximum(q, 0), np.stack([b[2] for b in blocks])) + times(np.minimum(q, 0), np.stack([b[3] for b in blocks]))
    order = np.argsort(-bounds, axis=1, kind="stable")
    for turn in range(len(blocks)):
        at = order[:, turn]
        # a bound equal to the k-th score may still hold a smaller id; bounds fall, so a query that stops stays stopped
        bound = bounds[np.arange(len(q)), at]
        going = np.flatnonzero(((bound >= scores[:, -1]) | (ids[:, -1] == NO_ID)) & (bound >= floor))
        if not len(going):
            break
        for b in np.unique(at[going]):
            who = going[at[going] == b]
            scored[who] += 1
            found = times(q[who], blocks[b][1])
            names = np.broadcast_to(blocks[b][0], found.shape)
            other = names != own[who, None]
            found, names = np.where(other, found, least), np.where(other, names, NO_ID)
            all_scores, all_ids = np.hstack([scores[who], found]), np.hstack([ids[who], names])
            best = np.lexsort((all_ids, ~all_scores), axis=1)[:, :k]
            scores[who], ids[who] = np.take_along_axis(all_scores, best, 1), np.take_along_axis(all_ids, best, 1)
    return scores, ids, scored


def bounds_of(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each query and shard: no inner product is above the summed term maxima."""
    return times(np.maximum(q, 0), high) + times(np.minimum(q, 0), low)


def numbers(packed: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.int64).reshape(-1, width)


def topk(vectors: DataFrame, queries: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding", scale: float = 256.0, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, counts: bool = False) -> DataFrame:
    """(query_id, rank, id, score): the k largest integer inner products of each query row against all other rows.

    queries: which rows are queries. Vectors are quantised to floor(scale * x). Ties go to the smaller id. A query
    never meets rows of its own id. Null vectors, and those with null or non-finite components, take no part, nor do
    rows without an id; vectors meet those of their own width only. Repeated rows are candidates of their own, and
    one query; rows of one id with different vectors are queries whose results are ranked together under that id.
    Products are 64-bit. Fewer than k candidates: all of them; an empty table: no rows. An id called query_id, rank or
    score gets an underscore at its end. counts: adds the blocks that the query scored, of all.

    Chunks of queries meet groups of shard maxima (two numbers a component for SHARD_ROWS rows), and then only the
    shards that can still matter, in tiles of bounded size; a tile keeps its k best, which are ranked per query.
    """
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.when(usable(F.col(vector)), quantised(F.col(vector), scale)).alias("vector"), queries.alias("asks"))
    rows = rows.filter("id is not null and vector is not null")
    blocks = cut(build_blocks(rows.select("id", "vector"), shard_rows, block_rows))
    asked = rows.filter("asks").select("id", "vector").distinct()
    chunks = max(1, -(-asked.count() // CHUNK_QUERIES))

    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: np.asarray(x, np.int64).tobytes())

    asked = cut(asked.select("id", F.size("vector").alias("width"), pack("vector").alias("q"), F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("chunk")))

    def maxima(some: pd.DataFrame) -> pd.DataFrame:
        out = []
        for width, same in some.groupby("width", sort=False):
            high, low = numbers(same["high"], width).max(0), numbers(same["low"], width).min(0)
            out.append((some["shard"].iloc[0], width, len(same), high.tobytes(), low.tobytes()))
        return pd.DataFrame(out, columns=["shard", "width", "blocks", "high", "low"])

    shards = cut(blocks.select("shard", "width", "high", "low").groupBy("shard").applyInPandas(maxima, "shard int, width int, blocks int, high binary, low binary"))
    last = shards.agg(F.max("shard")).first()[0] or 0
    part = F.floor(F.col("shard") / PART_SHARDS).cast("int")
    grid = shards.withColumn("part", part).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    spread = F.explode(F.sequence(F.lit(0), F.lit(last // PART_SHARDS)))

    def meet(pick):
        def run(some: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
            out = []
            for width, mine in asks.groupby("width", sort=False):
                own = some[some["width"] == width]
                if len(own):
                    bound = bounds_of(numbers(mine["q"], width), numbers(own["high"], width), numbers(own["low"], width))
                    i, j = pick(bound, mine, own["shard"].to_numpy())
                    floor = mine["floor"].to_numpy() if "floor" in mine else np.zeros(len(mine), np.int64)
                    out.append(pd.DataFrame({"id": mine["id"].to_numpy()[i], "q": mine["q"].to_numpy()[i], "width": width, "shard": own["shard"].to_numpy()[j], "bound": bound[i, j], "floor": floor[i]}))
            return pd.concat(out) if out else pd.DataFrame({"id": [], "q": [], "width": [], "shard": [], "bound": [], "floor": []})

        return run

    def best(bound: np.ndarray, mine: pd.DataFrame, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.arange(len(bound)), bound.argmax(1)

    def reached(bound: np.ndarray, mine: pd.DataFrame, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # a bound equal to the floor may still hold a smaller id
        return np.nonzero((bound >= mine["floor"].to_numpy()[:, None]) & (shard != mine["seen"].to_numpy()[:, None]))

    def tile(some: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        for width, mine in asks.groupby("width", sort=False):
            same = some[some["width"] == width]
            if not len(same):
                continue
            get = lambda x: np.frombuffer(x, np.int64)
            packed = [(get(b.ids), get(b.rows).reshape(-1, width), get(b.high), get(b.low)) for b in same.sort_values("ids").itertuples()]
            scores, ids, scored = search(packed, mine["id"].to_numpy(np.int64), numbers(mine["q"], width), k, mine["floor"].to_numpy(np.int64))
            i, j = np.nonzero((ids != NO_ID) | (np.arange(k) == 0))  # the first place stays, for the count
            found = ids[i, j]
            out.append(pd.DataFrame({"id": mine["id"].to_numpy()[i], "q": mine["q"].to_numpy()[i], "vec": np.where(found == NO_ID, -1, found), "score": scores[i, j], "place": np.where(found == NO_ID, -1, j), "scored": np.where(j == 0, scored[i], 0)}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "q": [], "vec": [], "score": [], "place": [], "scored": []})

    def searched(sent: DataFrame) -> DataFrame:
        """A shard's queries in chunks, each beside the shard's blocks; shards that nobody asks are not read again."""
        parts = sent.groupBy("shard").agg(F.ceil(F.count("*") / CHUNK_QUERIES).cast("int").alias("parts"))
        left = blocks.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        right = sent.join(parts.toDF("p_shard", "p_parts"), F.col("shard") == F.col("p_shard")).select("id", "q", "width", "shard", "floor", F.pmod(F.xxhash64("id", "q"), F.col("p_parts")).cast("int").alias("part"))
        return left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInPandas(tile, hits)

    pairs = "id long, q binary, width int, shard int, bound long, floor long"
    hits = "id long, q binary, vec long, score long, place int, scored long"
    first = grid.groupBy("part", "chunk").cogroup(asked.withColumn("part", spread).groupBy("part", "chunk")).applyInPandas(meet(best), pairs)
    first = first.groupBy("id", "q", "width").agg(F.max_by("shard", F.struct("bound", -F.col("shard"))).alias("shard")).withColumn("floor", F.lit(NO_FLOOR))
    first = cut(first)
    begun = cut(searched(first))
    # the k-th score so far, if there are k
    floors = begun.groupBy("id", "q").agg(F.coalesce(F.min(F.when(F.col("place") == k - 1, F.col("score"))), F.lit(NO_FLOOR)).alias("floor"))
    known = asked.join(first.select("id", "q", F.col("shard").alias("seen")).distinct(), ["id", "q"]).join(floors, ["id", "q"], "left").withColumn("floor", F.coalesce("floor", F.lit(NO_FLOOR)))
    more = grid.groupBy("part", "chunk").cogroup(known.withColumn("part", spread).groupBy("part", "chunk")).applyInPandas(meet(reached), pairs)
    found = begun.unionByName(searched(cut(more)))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "vec"))
    ranked = found.filter("place >= 0").withColumn("rank", rank).filter(F.col("rank") <= k)
    out = ranked.select(F.col("id").alias("query_id"), F.col("rank").cast("int"), F.col("vec").alias(free_name(id, ["query_id", "rank", "score"])), "score")
    if counts:
        out = out.join(found.groupBy(F.col("id").alias("query_id")).agg(F.sum("scored").alias("scored")), "query_id").join(shards.agg(F.sum("blocks").alias("blocks")))
    return out
