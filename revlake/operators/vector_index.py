"""Approximate vector search over product-quantised inverted lists.

Unit vectors are listed under their nearest centre, and what is left of them is coded in one byte for each of a few
subspaces. A query reads the codes of its nearest lists, estimates every row there through a table of its own, and the
best rows are fetched and scored exactly. The number of lists grows with the root of the rows, so the share of codes
that a query reads falls. New rows are coded with the stored centres, without another fit.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlake.lineage import cut
from revlake.sources import log

from .retrieval import cosine, topk, vector_topk

#: Rows that the centres are fitted on at most, rows of the sample for each centre, and centres of a subspace.
FIT_ROWS, ROWS_A_CENTRE, CODES = 65_536, 32, 256
#: Rows of a block of codes, buckets of lists, queries whose exact neighbours settle probes and candidates, candidates for each row wanted.
BLOCK_ROWS, BUCKETS, PROBE_SAMPLE, FETCHED = 8_192, 32, 256, 16


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centres of rows; a centre that loses all its rows moves to the row that is worst served."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        nearest, far = assigned(x, centres)
        count = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        centres = sums / np.maximum(count, 1)[:, None]
        for empty, row in zip(np.flatnonzero(count == 0), np.argsort(-far)):
            centres[empty] = x[row]
    return centres


def assigned(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: its nearest centre, and the squared distance from it up to the row's own length."""
    nearest, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    for a in range(0, len(x), 4096):
        d = (centres * centres).sum(1) - 2 * x[a : a + 4096] @ centres.T
        nearest[a : a + 4096] = d.argmin(1)
        far[a : a + 4096] = d.min(1)
    return nearest, far


def units(vectors: pd.Series) -> np.ndarray:
    m = np.array(vectors.tolist(), np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1), 1e-300)[:, None]


@dataclass(frozen=True)
class Books:
    """The centres of lists, and of each subspace of what is left: of a fixed size, sent to every task."""

    centres: np.ndarray
    subs: list[np.ndarray]

    def parts(self, m: np.ndarray) -> list[np.ndarray]:
        return np.array_split(m, len(self.subs), axis=1)

    def code(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nearest, _ = assigned(m, self.centres)
        return nearest, np.stack([assigned(p, s)[0] for p, s in zip(self.parts(m - self.centres[nearest]), self.subs)], 1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Of one query: what each code of each subspace adds to its inner product."""
        return np.stack([np.pad(s @ p[0], (0, CODES - len(s))) for p, s in zip(self.parts(q[None]), self.subs)])


@dataclass(frozen=True)
class VectorLists:
    """Stored lists by their folder; the centres are a part of it."""

    spark: SparkSession
    path: str

    def books(self) -> Books:
        rows = self.spark.read.parquet(f"{self.path}/books").orderBy("n").collect()  # the fitted centres
        read = lambda r: np.frombuffer(r["values"], np.float64).reshape(r["rows"], -1)
        return Books(read(rows[0]), [read(r) for r in rows[1:]])

    def table(self, kind: str) -> DataFrame:
        folders = sorted(set(log.live(self.spark, self.path)[1].values()))
        found = None
        for f in folders:
            own = self.spark.read.option("basePath", f"{self.path}/{f}/{kind}").parquet(f"{self.path}/{f}/{kind}")
            found = own if found is None else found.unionByName(own)
        return found


def build_lists(chunks: DataFrame, path: str, subspaces: int = 16, seed: int = 7, fit_rows: int = FIT_ROWS) -> VectorLists:
    """R1b. chunks: (id, vector). Fits on at most fit_rows rows (the first by a hash) and lists every row.

    As many lists as the root of the rows, as far as the sample has ROWS_A_CENTRE rows for each. Null vectors are left
    out; all have one width.
    """
    spark = chunks.sparkSession
    rows = chunks.filter("vector is not null").select("id", "vector")
    n = rows.count()
    sample = units(rows.orderBy(F.xxhash64("id"), "id").limit(fit_rows).toPandas()["vector"]) if n else np.zeros((1, 1))
    centres = kmeans(sample, max(1, min(int(n**0.5), len(sample) // ROWS_A_CENTRE)), seed)
    left = sample - centres[assigned(sample, centres)[0]]
    subs = [kmeans(p, min(CODES, max(1, len(sample) // 4)), seed + 1 + j) for j, p in enumerate(np.array_split(left, min(subspaces, sample.shape[1]), axis=1))]
    books = [(j, len(m), m.tobytes()) for j, m in enumerate([centres, *subs])]
    spark.createDataFrame(books, "n int, rows int, values binary").write.mode("overwrite").parquet(f"{path}/books")
    index = VectorLists(spark, path)
    add_rows(index, rows)
    return index


def add_rows(index: VectorLists, chunks: DataFrame) -> None:
    """R1b. Codes new rows with the stored centres and publishes them beside the others; nothing else is written."""
    books, path = index.books(), f"{index.path}/data/{uuid.uuid4().hex}"

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            if len(some):
                own, codes = books.code(units(some["vector"]))
                yield pd.DataFrame({"id": some["id"], "list": own, "code": [c.tobytes() for c in codes], "vector": some["vector"]})

    kind = chunks.schema["vector"].dataType.simpleString()
    rows = chunks.filter("vector is not null").select("id", "vector").mapInPandas(code, f"id long, list int, code binary, vector {kind}")
    rows = cut(rows.withColumn("bucket", F.pmod("list", F.lit(BUCKETS))))

    def pack(some: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"list": [some["list"].iloc[0]], "n": [len(some)], "ids": [some["id"].to_numpy(np.int64).tobytes()], "codes": [b"".join(some["code"])], "bucket": [some["bucket"].iloc[0]]})

    sizes = rows.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"))
    dealt = rows.drop("vector").join(sizes, "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    dealt.groupBy("list", "part").applyInPandas(pack, "list int, n int, ids binary, codes binary, bucket int").repartition(BUCKETS, "bucket").write.partitionBy("bucket").parquet(f"{path}/codes")
    rows.select("id", "list", "vector", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).alias("bucket")).repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "id").write.partitionBy("bucket").parquet(f"{path}/vectors")
    folder = path.removeprefix(f"{index.path}/")
    log.commit(index.spark, index.path, lambda parts: parts | {folder: folder})


def probed(queries: DataFrame, books: Books, probes: int) -> DataFrame:
    """(query_id, vector, list, place): each query beside its nearest lists."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            if len(some):
                near = np.argsort(-(units(some["vector"]) @ books.centres.T), axis=1, kind="stable")[:, :probes]
                take = np.repeat(np.arange(len(some)), near.shape[1])
                yield pd.DataFrame({"query_id": some["query_id"].to_numpy()[take], "vector": some["vector"].to_numpy()[take], "list": near.ravel(), "place": np.tile(np.arange(near.shape[1]) + 1, len(some))})

    kind = queries.schema["vector"].dataType.simpleString()
    return queries.filter("vector is not null").select("query_id", "vector").mapInPandas(run, f"query_id long, vector {kind}, list int, place int")


def estimated(asked: DataFrame, index: VectorLists, books: Books, most: int) -> DataFrame:
    """asked: (query_id, vector, list, place). (query_id, id, about, place): the likeliest rows of each list, by their codes."""
    buckets = sorted(r[0] for r in asked.select(F.pmod("list", F.lit(BUCKETS))).distinct().collect())  # at most BUCKETS
    codes = index.table("codes").filter(F.col("bucket").isin(buckets))
    blocks = codes.select("list", F.monotonically_increasing_id().alias("block"), "ids", "codes")
    blocks = cut(blocks)
    met = asked.join(blocks.select("list", F.col("block").alias("met")), "list")

    def tile(some: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        for b in some.itertuples():
            ids = np.frombuffer(b.ids, np.int64)
            own = np.frombuffer(b.codes, np.uint8).reshape(len(ids), -1)
            for q, a in zip(units(asks["vector"]) if len(asks) else (), asks.itertuples()):
                t = books.tables(q)
                about = float(q @ books.centres[a.list]) + t[np.arange(len(t)), own].sum(1)
                best = np.argpartition(-about, min(most, len(about)) - 1)[:most]
                out.append(pd.DataFrame({"query_id": a.query_id, "id": ids[best], "about": about[best], "place": a.place}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "about": [], "place": []})

    return blocks.groupBy("block").cogroup(met.groupBy("met")).applyInPandas(tile, "query_id long, id long, about double, place int")


def fetched(found: DataFrame, queries: DataFrame, index: VectorLists, most: int, k: int) -> DataFrame:
    """The likeliest rows of each query, scored exactly."""
    best = topk(found, most, F.desc("about"), "id").select("query_id", "id")
    exact = F.round(cosine(F.col("asked"), F.col("vector")), 9).alias("score")
    rows = best.join(queries.select("query_id", F.col("vector").alias("asked")), "query_id").join(index.table("vectors").select("id", "vector"), "id")
    return topk(rows.select("query_id", "id", exact), k, F.desc("score"), "id")


def tune(queries: DataFrame, index: VectorLists, k: int, recall: float = 0.95, probes: int = 4) -> dict[str, int]:
    """Stores how many lists and candidates a search needs: raised from probes lists, and FETCHED candidates for each row wanted, until that share of the exact neighbours of the queries is found.

    queries: at most PROBE_SAMPLE of them are used, the first by a hash; their exact neighbours come from one scan of
    all vectors, which searches then do without.
    """
    books, spark = index.books(), index.spark
    lists, fetch = len(books.centres), FETCHED * k
    tried = cut(queries.orderBy(F.xxhash64("query_id"), "query_id").limit(PROBE_SAMPLE).select("query_id", "vector"))
    vectors = index.table("vectors")
    want = cut(vector_topk(tried, vectors.select("id", "vector"), k).select("query_id", "id"))
    total = want.count()
    places = want.join(vectors.select("id", "list"), "id").join(probed(tried, books, lists).select("query_id", "list", "place"), ["query_id", "list"])
    found = {r["place"]: r["count"] for r in places.groupBy("place").count().collect()}  # a row a list at most
    probes = min(probes, lists)
    while probes < lists and sum(n for p, n in found.items() if p <= probes) < (1 + recall) / 2 * total:
        probes += 1
    while total:
        best = topk(estimated(probed(tried, books, probes), index, books, fetch), fetch, F.desc("about"), "id")
        if best.join(want, ["query_id", "id"], "left_semi").count() >= recall * total or fetch >= vectors.count():
            break
        fetch *= 2
    spark.createDataFrame([(probes, fetch)], "probes int, fetch int").write.mode("overwrite").parquet(f"{index.path}/settings/k={k}")
    return {"probes": probes, "fetch": fetch}


def vector_topk_approx(queries: DataFrame, index: VectorLists, k: int, counts: bool = False) -> DataFrame:
    """R1b. (query_id, id, score, rank): the nearest rows by exact cosine among those that lists and codes put forward.

    As many lists and candidates as tune found for that k. counts: adds how many codes the query's lists hold (codes_read),
    of all (codes).
    """
    books, known = index.books(), index.spark.read.parquet(f"{index.path}/settings/k={k}").first()
    asked = cut(probed(queries, books, known["probes"]))
    found = fetched(estimated(asked, index, books, known["fetch"]), queries, index, known["fetch"], k)
    if counts:
        size = index.table("codes").groupBy("list").agg(F.sum("n").alias("n"))
        share = asked.join(size, "list", "left").groupBy("query_id").agg(F.sum("n").alias("codes_read"))
        found = found.join(share.join(size.agg(F.sum("n").alias("codes"))), "query_id")
    return found
