"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are rotated at random and split into low-dimensional blocks. If two are within a squared distance, then
some block is within its share of it: so each block is joined by range (a grid over its first coordinate, then the
block's distance), and the candidates are verified exactly. A pair counts in the first block that gives it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, free_name, hook
from .topk import usable

#: Blocks that a vector is split into: a row visits two cells a block, so more blocks cost more copies of it.
BLOCKS = 4
#: Rows of a cell, at home or visiting, that are compared in one tile; cells with more are split into tiles.
TILE_ROWS = 3_000
SLACK = 1e-9


@functools.lru_cache(maxsize=8)
def rotation(width: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(42).normal(size=(width, width)))
    return q * np.sign(np.diag(r))


def split(unit: np.ndarray, blocks: int) -> np.ndarray:
    """(rows, blocks, width of a block): the rotated coordinates, padded with zeros."""
    width = unit.shape[1]
    each = -(-width // blocks)
    out = np.zeros((len(unit), blocks * each))
    out[:, :width] = unit @ rotation(width)
    return out.reshape(len(unit), blocks, each)


def units(packed: pd.Series) -> np.ndarray:
    """Unit vectors, in double precision, of vectors of one width."""
    v = np.frombuffer(b"".join(packed), np.float32).reshape(len(packed), -1).astype(np.float64)
    return v / np.linalg.norm(v, axis=1)[:, None]


def linked(u: np.ndarray, a: np.ndarray, b: np.ndarray, block: int, blocks: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (one of a, one of b, different) with cosine >= least whose first close block is this one."""
    budget = (2 - 2 * least + SLACK) / blocks
    parts = split(u, blocks)
    # in single precision with a margin for its rounding; what passes is verified in double precision
    pa, pb = parts[a, block].astype(np.float32), parts[b, block].astype(np.float32)
    na, nb = (pa**2).sum(1) / 2 - np.float32((budget + 1e-5) / 2), (pb**2).sum(1) / 2
    step = max(1, (1 << 19) // max(1, len(b)))
    for k in range(0, len(a), step):
        i, j = np.nonzero(pa[k : k + step] @ pb.T >= na[k : k + step, None] + nb)
        i, j = a[k + i], b[j]
        keep = i < j if a is b else np.ones(len(i), bool)
        i, j = i[keep], j[keep]
        for c in range(0, len(i), 1 << 15):
            x, y = i[c : c + (1 << 15)], j[c : c + (1 << 15)]
            x, y = x[(hit := np.einsum("ij,ij->i", u[x], u[y]) >= least)], y[hit]
            gap = (parts[x] - parts[y]) ** 2
            total = gap[:, :, 0].copy()
            for d in range(1, gap.shape[2]):  # in one order, so that every tile gets the same sums
                total += gap[:, :, d]
            first = np.argmax(total <= budget, axis=1)
            own = (total <= budget).any(1) & (first == block)
            if own.any():
                yield x[own], y[own]


#: A cell of the grid, and a tile of a cell.
CELL = ["label", "width", "block", "cell"]
TILE = [*CELL, "kind", "i", "j"]


def tiles(spread: DataFrame, tile_rows: int) -> DataFrame:
    """Deals the rows of cells to tiles: at most about tile_rows of a side meet as many of the other.

    Home rows and visitors are split by their own numbers of parts: home part i meets home part j in tile (0, i, j) and
    visitor part j in tile (1, i, j). A cell of one part a side is one tile. Visitors of cells without home rows go.
    """
    count = lambda c: F.ceil(F.count_if(c) / tile_rows).cast("int")
    parts = spread.groupBy(*CELL).agg(count(F.col("home")).alias("homes"), count(~F.col("home")).alias("visits")).filter("homes > 0")
    placed = spread.join(parts, CELL).withColumn("part", F.pmod(F.xxhash64("node"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("visits"))).cast("int"))
    tile = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    each, guests = F.sequence(F.lit(0), F.col("homes") - 1), F.sequence(F.lit(0), F.greatest("visits", F.lit(1)) - 1)
    dealt = (
        F.when((F.col("homes") == 1) & (F.col("visits") <= 1), F.array(tile(0, F.lit(0), F.lit(0))))
        .when(~F.col("home"), F.transform(each, lambda t: tile(1, t, F.col("part"))))
        .otherwise(
            F.concat(
                F.transform(each, lambda t: tile(0, F.least(t, "part"), F.greatest(t, "part"))),
                F.filter(F.transform(guests, lambda t: tile(1, F.col("part"), t)), lambda t: F.col("visits") > 0),
            )
        )
    )
    return placed.withColumn("tile", F.explode(dealt)).select(*CELL, "tile.kind", "tile.i", "tile.j", "part", "node", "copies", "packed", "home")


def links(classes: DataFrame, least: float, blocks: int, tile_rows: int) -> DataFrame:
    """classes: (node long, copies long, packed binary, label, width). Gives (node, root, links) by tile."""
    reach = float(np.sqrt((2 - 2 * least + SLACK) / blocks)) + 1e-9

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            for _, same in some.groupby("width", sort=False):
                first = np.floor(split(units(same["packed"]), blocks)[:, :, 0] / reach).astype(np.int64)
                for block in range(blocks):
                    for shift in (0, 1):  # at home, and as a visitor of the next cell
                        yield same.assign(block=block, cell=first[:, block] + shift, home=shift == 0)

    spread = cut(classes.mapInPandas(cells, "node long, copies long, packed binary, label string, width int, block int, cell long, home boolean"))

    def search(some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values(["node", "home"], kind="stable").reset_index(drop=True)
        head = some.iloc[0]
        home, part = some["home"].to_numpy(bool), some["part"].to_numpy()
        u, copies = units(some["packed"]), some["copies"].to_numpy(np.int64)
        at = np.arange(len(some))
        if head["kind"] == 1:
            meets = [(at[home], at[~home])]
        elif head["i"] == head["j"]:
            own = at[home]
            meets = [(own, own), (own, at[~home])]  # visitors are here only if the cell is one tile
        else:
            meets = [(at[part == head["i"]], at[part == head["j"]])]
        parent, count = np.arange(len(some)), np.zeros(len(some), np.int64)
        for a, b in meets:
            for x, y in linked(u, a, b, int(head["block"]), blocks, least) if len(a) and len(b) else ():
                np.add.at(count, x, copies[y])
                np.add.at(count, y, copies[x])
                parent = hook(parent, x, y)
        node, told = some["node"].to_numpy(), np.flatnonzero(count)
        return pd.DataFrame({"node": node[told], "root": node[parent[told]], "links": count[told]})

    # dealt out by tile: the join's partitioning by cell would leave all tiles of a cell in one task
    return tiles(spread, tile_rows).repartition(*TILE).groupBy(*TILE).applyInPandas(search, "node long, root long, links long")


def dedup(vectors: DataFrame, least: float = 0.93, id: str = "vec_id", vector: str = "embedding", label: str = "label", blocks: int = BLOCKS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(id, n_links, component_id, kept): links of cosine >= least between vectors of one label.

    n_links counts the other rows linked directly, component_id is the smallest id reachable. Equal vectors of a
    label are one node with a number of copies, so they never form pairs; a node is told by label and vector, not by
    an id, so rows of one id with different vectors are judged apart. Vectors that are null, zero, or hold null
    or non-finite components, and rows whose label or id is null, link with nothing (component: their own id); so do
    vectors of different widths. Repeated rows count as rows of their own. An empty table gives no rows. Other columns
    are not read; if the id is called like one of the operator's columns, that one gets an underscore at its end.
    Cosines are computed in double precision from the stored floats.
    """
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vector"), F.col(label).cast("string").alias("label"))
    fit = F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("vector", F.when(fit, F.col("vector")))

    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: np.asarray(x, np.float32).tobytes() if x is not None else None)

    rows = cut(rows.select("id", "label", pack("vector").alias("packed")))
    classes = rows.filter("packed is not null").groupBy("label", "packed").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    # numbered as they are written: from then on a class keeps its number
    classes = cut(classes.withColumn("width", F.expr("int(length(packed) div 4)")).withColumn("node", F.monotonically_increasing_id()))
    found = cut(links(classes.select("node", "copies", "packed", "label", "width"), least, blocks, tile_rows))
    near = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "near_node")
    counts = found.groupBy(F.col("node").alias("count_node")).agg(F.sum("links").alias("links"))
    named = (
        classes.join(counts, F.col("node") == F.col("count_node"), "left")
        .join(near, F.col("node") == F.col("near_node"), "left")
        .select("label", "packed", "first", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"))
    )
    least_id = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(least_id, "component").select(F.col("label").alias("l_"), F.col("packed").alias("p_"), "n", "component_id")
    linked_rows = rows.filter("packed is not null").join(named, (F.col("label") == F.col("l_")) & (F.col("packed") == F.col("p_"))).select("id", "n", "component_id")
    alone = rows.filter("packed is null").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component_id"))
    name = lambda c: free_name(c, [id])
    return linked_rows.union(alone).select(
        F.col("id").alias(id), F.col("n").alias(name("n_links")), F.col("component_id").alias(name("component_id")), (F.col("id") == F.col("component_id")).alias(name("kept"))
    )
