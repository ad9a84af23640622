"""SimHash near-duplicates by vantage-point trees.

Distinct fingerprints are dealt to the leaves of a vantage-point tree over Hamming distance. A fingerprint within
the link distance of a boundary also visits the shards across it, where the triangle bound cannot rule out a
partner. A tree of a bounded sample deals first; leaves that are still large are parted again by Spark, as often as it
takes, and many visitors of a leaf are met in parts. Each leaf is searched exactly, by the same tree over its own rows,
and gives a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, free_name, hook, row_key

#: Rows that the first tree is built on at most (it has up to a quarter as many leaves; larger ones are parted again).
TREE_SAMPLE = 8192
#: Fingerprints at home in a leaf, about; at most twice as many, and four times as many visitors in one part.
LEAF_ROWS = 20_000
#: Below so many rows, pairs of a node are compared directly.
DIRECT_ROWS = 1024


def fingerprint(text: str | None, words: int = 3) -> int:
    """64 bits, one set where it is set in over half of the shingles' XXH64 (seed 42); signed."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[k:] for k in range(words)))) if len(w) >= words else [b" ".join(w)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[k : k + (1 << 15)].astype(">u8").view(np.uint8)).reshape(-1, 64)
        counts += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, text: str | Column = "text", out: str = "fp", words: int = 3) -> DataFrame:
    """Adds the signed 64-bit fingerprint of whole texts: words split at ASCII white space, A-Z lower-cased."""

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return docs.withColumn(out, fp(F.col(text) if isinstance(text, str) else text))


def distance(a: np.ndarray, b: np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


class Tree:
    """A vantage-point tree over 64-bit fingerprints; inner nodes split at the median distance from a vantage point."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.nodes: list[tuple] = []
        self.leaves = 0
        self.root = self.grow(np.unique(sample), leaves)

    def grow(self, rows: np.ndarray, leaves: int) -> int:
        if leaves > 1 and len(rows) > 1:
            spread = [(float(distance(rows, v).std()), k) for k, v in enumerate(rows[:: max(1, len(rows) // 8)][:8])]
            vantage = rows[:: max(1, len(rows) // 8)][max(spread)[1]]
            d = distance(rows, vantage)
            radius = int(np.sort(d)[(len(d) - 1) // 2])
            if radius == d.max():
                radius -= 1
            if (d <= radius).any():
                inner = self.grow(rows[d <= radius], leaves // 2)
                outer = self.grow(rows[d > radius], leaves - leaves // 2)
                self.nodes.append((vantage, radius, inner, outer))
                return len(self.nodes) - 1
        self.leaves += 1
        return -self.leaves

    def route(self, rows: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each leaf, the indices of rows at home there and of rows that visit it.

        Rows within reach of each other meet once: at the node that parts them, the inner one visits the outer side.
        """
        none = np.empty(0, np.int64)
        todo = [(self.root, np.arange(len(rows)), none)]
        while todo:
            node, home, visit = todo.pop()
            if not len(home) and not len(visit):
                continue
            if node < 0:
                yield -node - 1, home, visit
                continue
            vantage, radius, inner, outer = self.nodes[node]
            d, dv = distance(rows[home], vantage), distance(rows[visit], vantage)
            todo.append((inner, home[d <= radius], visit[dv <= radius + reach]))
            across = home[(d <= radius) & (d > radius - reach)]
            todo.append((outer, home[d > radius], np.concatenate([visit[dv > radius - reach], across])))


def close_pairs(rows: np.ndarray, home: np.ndarray, visit: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within reach: among the home rows, and between home rows and visitors."""
    if not len(home):
        return
    if len(home) > DIRECT_ROWS:
        tree = Tree(rows[home][:: max(1, len(home) // 512)], len(home) // (DIRECT_ROWS // 2))
        if tree.root >= 0:
            # visitors are routed beside the home rows, as visitors only
            none = np.empty(0, np.int64)
            todo = [(tree.root, home, visit)]
            while todo:
                node, h, v = todo.pop()
                if not len(h):
                    continue
                if node < 0:
                    yield from direct_pairs(rows, h, v, reach)
                    continue
                vantage, radius, inner, outer = tree.nodes[node]
                d, dv = distance(rows[h], vantage), distance(rows[v], vantage) if len(v) else none
                todo.append((inner, h[d <= radius], v[dv <= radius + reach]))
                across = h[(d <= radius) & (d > radius - reach)]
                todo.append((outer, h[d > radius], np.concatenate([v[dv > radius - reach], across])))
            return
    yield from direct_pairs(rows, home, visit, reach)


def direct_pairs(rows: np.ndarray, home: np.ndarray, visit: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    others = np.concatenate([home, visit])
    far = rows[others]
    step = max(1, (1 << 20) // max(1, len(far)))
    for k in range(0, len(home), step):
        near = np.bitwise_count(rows[home[k : k + step], None] ^ far[None, k:]) <= reach
        i, j = np.nonzero(near)
        apart = i != j
        if apart.any():
            yield home[k + i[apart]], others[k + j[apart]]


def parted(dealt: DataFrame, leaf_rows: int, reach: int) -> DataFrame:
    """dealt: (leaf string, home boolean, fp long). Parts leaves of over 2 * leaf_rows home rows at a vantage point until none is left.

    The vantage point is a home row, the radius the median distance from it (of 65 counts); all leaves of a round are
    parted at once by equi joins, so a leaf is never gathered.
    """
    small, rest = None, dealt
    while True:
        sizes = rest.filter("home").groupBy("leaf").agg(F.count("*").alias("homes"), F.min_by("fp", F.xxhash64("fp")).alias("vantage")).filter(F.col("homes") > 2 * leaf_rows)
        sizes = cut(sizes)
        done = rest.join(sizes.select("leaf"), "leaf", "left_anti")
        small = done if small is None else small.unionByName(done)
        if sizes.isEmpty():
            return small
        apart = cut(rest.join(sizes, "leaf").withColumn("d", F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage")))))
        counts = apart.filter("home").groupBy("leaf", "d").agg(F.count("*").alias("n"), F.first("homes").alias("homes"))
        by_distance = Window.partitionBy("leaf").orderBy("d")  # 65 rows a leaf at most
        counts = counts.withColumn("upto", F.sum("n").over(by_distance.rowsBetween(Window.unboundedPreceding, 0)))
        middle = counts.groupBy("leaf").agg(F.min(F.when(2 * F.col("upto") >= F.col("homes"), F.col("d"))).alias("middle"), F.max("d").alias("most"))
        radius = middle.select("leaf", F.when(F.col("middle") == F.col("most"), F.col("middle") - 1).otherwise(F.col("middle")).alias("radius"))
        side = lambda name, home: F.struct(F.concat("leaf", F.lit(name)).alias("leaf"), home.alias("home"))
        d, r, home = F.col("d"), F.col("radius"), F.col("home")
        inner = F.when(F.when(home, d <= r).otherwise(d <= r + reach), side(".0", home))
        outer = F.when(d > F.when(home & (d > r), r).otherwise(r - reach), side(".1", home & (d > r)))
        rest = cut(apart.join(radius, "leaf").select("fp", F.explode(F.array_compact(F.array(inner, outer))).alias("to")).select("to.leaf", "to.home", "fp"))


def links(classes: DataFrame, reach: int = 3, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """classes: (fp long), distinct. Returns (a, b): a spanning forest, by leaf, of all links within reach."""
    classes = classes.select("fp")
    leaves = max(1, min(-(-classes.count() // leaf_rows), TREE_SAMPLE // 4))
    # a bounded sample shapes the tree; which leaf a row falls into never decides whether a link is found
    sample = classes.orderBy(F.xxhash64("fp"), "fp").limit(TREE_SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree = Tree(sample, leaves)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            rows = some["fp"].to_numpy(np.int64).view(np.uint64)
            for leaf, home, visit in tree.route(rows, reach):
                at = np.concatenate([home, visit])
                yield pd.DataFrame({"leaf": str(leaf), "home": np.arange(len(at)) < len(home), "fp": some["fp"].to_numpy()[at]})

    def search(some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values(["home", "fp"], ascending=[False, True])
        fp, home = some["fp"].to_numpy(np.int64), int(some["home"].sum())
        parent = np.arange(len(fp))
        for a, b in close_pairs(fp.view(np.uint64), np.arange(home), np.arange(home, len(fp)), reach):
            parent = hook(parent, a, b)
        tied = np.flatnonzero(parent != np.arange(len(fp)))
        return pd.DataFrame({"a": fp[tied], "b": fp[parent[tied]]})

    dealt = parted(cut(classes.mapInPandas(deal, "leaf string, home boolean, fp long")), leaf_rows, reach)
    visits = dealt.groupBy("leaf").agg(F.count_if(~F.col("home")).alias("visits"))
    parts = F.greatest(F.ceil(F.col("visits") / (4 * leaf_rows)).cast("int"), F.lit(1))
    part = F.when(F.col("home"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("fp"), parts).cast("int")))
    placed = dealt.join(visits, "leaf").select("leaf", "home", "fp", F.explode(part).alias("part"))
    return placed.groupBy("leaf", "part").applyInPandas(search, "a long, b long")


def groups(marked: DataFrame, best: Column, reach: int, leaf_rows: int) -> DataFrame:
    """marked: (fp, ...). (fp, first): the least best of all rows whose fingerprint is reachable from fp."""
    classes = cut(marked.groupBy("fp").agg(F.min(best).alias("best")))
    near = components(links(classes, reach, leaf_rows))
    named = classes.join(near, F.col("fp") == F.col("node"), "left").select("fp", "best", F.coalesce("component", "fp").alias("component"))
    first = named.groupBy("component").agg(F.min("best").alias("first"))
    return named.join(first, "component").select("fp", "first")


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", reach: int = 3, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Near-duplicate classes of whole texts: (key, fp long, component_id long).

    component_id is the smallest key reachable over links of at most reach differing bits; documents of one
    fingerprint are one node, so copies never form pairs. Null and wordless texts have fingerprint 0 and link like
    others. Repeated keys give repeated rows. Rows whose key is null keep their row and link like others; their
    component is the smallest key of their group (null if it has none). An empty table gives no rows. Other columns
    are not read; if the key is called fp or component_id, the operator's column gets an underscore at its end. A
    fingerprint that many rows share is a hot key of the last join only, on the side that AQE splits.
    """
    marked = cut(fingerprints(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("body")), "body").select("key", "fp"))
    named = groups(marked, F.col("key"), reach, leaf_rows).withColumnRenamed("fp", "fp_")
    name = lambda c: free_name(c, [key])
    return marked.join(named, F.col("fp") == F.col("fp_"), "left").select(F.col("key").alias(key), F.col("fp").alias(name("fp")), F.col("first").alias(name("component_id")))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", reach: int = 3, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """The rows of docs, all columns, of which one stays for each near-duplicate group: that of the smallest key.

    Rows without a key come after those with one; ties (one key on several rows) are settled by a hash of the whole
    row, and of wholly equal rows one stays. So a row is never dropped for a key that it shares with another text. An
    empty table stays empty. Rows are told apart by 128 bits of hash, in which a null counts as a value of its column.
    """
    own, mark = (free_name(c, docs.columns) for c in ("row_key", "fp"))
    rows = docs.withColumn(own, row_key(docs.columns))
    marked = cut(fingerprints(rows, text, mark).select(F.col(key).cast("long").alias("key"), F.col(own).alias("own"), F.col(mark).alias("fp")))
    firsts = groups(marked, F.struct(F.col("key").isNull(), "key", "own"), reach, leaf_rows)
    return rows.dropDuplicates([own]).join(firsts.select(F.col("first.own").alias(own)).distinct(), own, "left_semi").drop(own)
