"""Near-duplicates, repeats and search against brute force, on small fixtures with every odd case."""

import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from revlake.llm import embedding_dedup, queries, simhash_dedup, substring_dedup, topk
from revlake.llm.common import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    random.seed(3)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    want = {n: r for n, r in roots({x for e in edges for x in e}, edges).items() if n != r}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_texts(n):
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randrange(900)}" for _ in range(200)) for _ in range(n)]
    near = []
    for k, t in enumerate(base):
        w = t.split(" ")
        for _ in range(3):
            w = list(w)
            w[rng.randrange(200)] = f"z{k}"
            near.append(" ".join(w))
    return base + near + base[:10] + ["", "A b", "a B", "\u00c4 x y z"]


def test_simhash_by_brute_force(spark, monkeypatch):
    texts = near_texts(40)
    rows = [(i * 3, t, "x", i) for i, t in enumerate(texts)] + [(100000, None, "x", 0), (100001, None, "x", 0), (None, texts[0], "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, rep long").repartition(3)
    fps = {d: fingerprint(t) for d, t, *_ in rows if d is not None}
    ids = sorted(fps)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 3]
    want = roots(ids, edges)
    assert len(edges) > 60
    for leaf, sample in ((20_000, 8192), (12, 8192), (3, 8)):  # one leaf, a tree with many boundaries, and leaves that Spark parts again
        monkeypatch.setattr(simhash_dedup, "TREE_SAMPLE", sample)
        got = simhash_dedup.dedup(docs, leaf_rows=leaf).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.doc_id is not None:
                assert (r.fp % 2**64, r.component_id) == (fps[r.doc_id], want[r.doc_id])
    assert simhash_dedup.dedup(docs.limit(0)).count() == 0


def test_simhash_keeps_one_row_of_a_group(spark):
    texts = near_texts(3)
    x, y = texts[0], texts[1]
    near = x.rsplit(" ", 1)[0] + " other"  # one shingle differs
    assert (fingerprint(x) ^ fingerprint(near)).bit_count() <= 3 and (fingerprint(x) ^ fingerprint(y)).bit_count() > 3
    rows = [(0, x, "s"), (1, x, "s"), (1, y, "s"), (2, y, "s"), (3, near, "s"), (None, y, "s"), (4, texts[2], "s"), (4, texts[2], "s"), (None, "lone words here", "t"), (None, None, "u"), (None, None, "u")]
    docs = spark.createDataFrame([(*r, 1, 1) for r in rows], "doc_id long, text string, source string, fp int, k1 int")
    got = simhash_dedup.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(map(repr, (tuple(r)[:3] for r in got.collect()))) == sorted(map(repr, [(0, x, "s"), (1, y, "s"), (4, texts[2], "s"), (None, "lone words here", "t"), (None, None, "u")]))
    assert simhash_dedup.keep_one(docs.limit(0)).count() == 0


def test_simhash_leaf_recursion():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 2**63, 4000).astype(np.uint64)
    rows[2000:] = rows[:2000] ^ (np.uint64(1) << rng.integers(0, 63, 2000).astype(np.uint64))
    rows = np.unique(rows)
    home, visit = np.arange(3000), np.arange(3000, len(rows))
    got = {(min(a, b), max(a, b)) for x, y in simhash_dedup.close_pairs(rows, home, visit, 3) for a, b in zip(x.tolist(), y.tolist())}
    want = {(i, int(j) + i + 1) for i in range(3000) for j in np.flatnonzero(np.bitwise_count(rows[i] ^ rows[i + 1 :]) <= 3)}
    assert got == want


def brute_strip(rows, words=13):
    cut = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in cut:
        for i in range(len(w) - words + 1):
            k = tuple(w[i : i + words])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in cut:
        gone = [False] * len(w)
        for i in range(len(w) - words + 1):
            if first[tuple(w[i : i + words])] < d:
                gone[i : i + words] = [True] * words
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


def repeats(n):
    rng = random.Random(9)
    shared = [" ".join(f"p{k}_{j}" for j in range(30)) for k in range(4)]
    rows = []
    for d in range(n):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            part = rng.choice(shared).split(" ")
            a = rng.randrange(15)
            w[at:at] = part[a : a + rng.randrange(5, 30)]
        rows.append((d, rng.choice([" ", "\n", "  ", "\t"]).join(w)))
    rows += [(n, rows[3][1]), (n + 1, rows[3][1]), (n + 1, rows[3][1]), (n + 2, ""), (n + 3, None), (n + 4, "\u2003a \u00a0b " * 30), (n + 5, "\u2003a \u00a0b " * 40), (n + 6, " x" * 20000)]
    return rows


def test_substring_by_brute_force(spark):
    rows = repeats(150)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, id string, body int").repartition(3)
    for size in (4 << 20, 3000):  # one segment and bucket, and many
        got = substring_dedup.dedup(docs, segment_bytes=size, bucket_bytes=size)
        assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()) == brute_strip(rows)
    spans = {r.doc_id: r for r in got.collect()}
    assert all(sum(s.end - s.start for s in r.repeats) == r.n_removed for r in spans.values())
    assert substring_dedup.dedup(docs.limit(0)).count() == 0


def test_substring_null_keys_come_last(spark):
    text = " ".join(map(str, range(40)))
    got = substring_dedup.dedup(spark.createDataFrame([(None, text), (5, text)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == {5: 0, None: 40}


def test_substring_query_on_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = {d: (n, r, hashlib.sha256(k.encode()).hexdigest()) for d, n, r, k in brute_strip(rows)}
    assert {r.doc_id: tuple(r)[1:] for r in queries.op6_substring_dedup(spark, sf).collect()} == want


def vectors(n, width=16):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(n, width))
    v[n // 2 :] = v[: n - n // 2] + rng.normal(size=(n - n // 2, width)) * rng.choice([0.0, 0.1, 0.25, 0.4], (n - n // 2, 1))
    rows = [(i, [float(np.float32(x)) for x in v[i]], int(i % 3)) for i in range(n)]
    rows += [(n, rows[0][1], 0), (n + 1, rows[0][1], 0), (n + 1, rows[0][1], 0), (n + 2, None, 0), (n + 3, [0.0] * width, 0), (n + 4, [float("nan")] * width, 0), (n + 5, [None] * width, 1), (n + 6, rows[0][1], None), (n + 7, [float("inf")] * width, 2), (n + 8, [1.0, 2.0], 0)]
    return rows


def test_embedding_by_brute_force(spark):
    rows = vectors(300)
    rows += [(5, rows[1][1], 1), (5, rows[7][1], 1), (4, rows[1][1], 1)]  # ids that repeat with other vectors
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, packed string, node int").repartition(3)
    good = [(k, np.array(r[1], float), r[2]) for k, r in enumerate(rows) if r[1] and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    edges = [(a, b) for n, (a, x, l) in enumerate(good) for b, y, m in good[n + 1 :] if l == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93]
    assert len(edges) > 40
    count = np.bincount(np.array(edges).ravel(), minlength=len(rows))
    root = roots(range(len(rows)), edges)
    least = {}
    for k, r in root.items():
        least[r] = min(least.get(r, rows[k][0]), rows[k][0])
    want = sorted((rows[k][0], int(count[k]), least[root[k]], rows[k][0] == least[root[k]]) for k in range(len(rows)))
    for tile in (3000, 7):
        got = embedding_dedup.dedup(df, tile_rows=tile)
        assert sorted(tuple(r) for r in got.collect()) == want
    assert embedding_dedup.dedup(df.limit(0)).count() == 0


def test_embedding_tiles_are_bounded(spark):
    # cell 1: few at home, many visitors; cell 2: many at home, no visitors; cell 3: visitors only; cell 4: one tile
    sides = {(1, True): 3, (1, False): 500, (2, True): 200, (3, False): 400, (4, True): 5, (4, False): 4}
    rows, rep = [], 0
    for (cell, home), n in sides.items():
        rows += [(rep + k, 1, b"", "x", 4, 0, cell, home) for k in range(n)]
        rep += n
    spread = spark.createDataFrame(rows, "node long, copies long, packed binary, label string, width int, block int, cell long, home boolean")
    groups = {}
    for r in embedding_dedup.tiles(spread, 20).collect():
        groups.setdefault((r.cell, r.kind, r.i, r.j), []).append(r)
    assert max(map(len, groups.values())) <= 80
    assert {g[0] for g in groups} == {1, 2, 4} and len([g for g in groups if g[0] == 4]) == 1
    met = set()
    for (cell, kind, i, j), some in groups.items():
        for a in some:
            for b in some:
                own = kind == 0 and b.home and a.node < b.node and (i == j or a.part != b.part)
                if a.home and (own or ((kind == 1 or i == j) and not b.home)):
                    assert (a.node, b.node) not in met
                    met.add((a.node, b.node))
    assert len(met) == 3 + 3 * 500 + 200 * 199 // 2 + 10 + 20


def test_topk_by_brute_force(spark, monkeypatch):
    rows = [(i, v, l) for i, v, l in vectors(400)] + [(None, [1.0] * 16, 0), (900, [40.0] * 16, 0), (901, [-40.0] * 16, 0), (50, [0.5] * 16, 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, rank int").repartition(3)
    q = {}
    for i, v, _ in rows:
        if i is not None and v is not None and None not in v and np.isfinite(v).all():
            q.setdefault(i, []).append([int(np.floor(256 * np.float64(np.float32(x)))) for x in v])
    want = []
    for a in [k for k in q if k % 50 == 0]:
        asks = {tuple(x) for x in q[a]}
        scores = sorted((-sum(x * y for x, y in zip(own, w)), b) for own in asks for b in q if b != a for w in q[b] if len(w) == len(own))[:5]
        want += [(a, k + 1, b, -s) for k, (s, b) in enumerate(scores)]
    for shard, block in ((16_384, 256), (50, 8)):
        got = topk.topk(df, F.col("vec_id") % 50 == 0, shard_rows=shard, block_rows=block)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    monkeypatch.setattr(topk, "CHUNK_QUERIES", 3)
    monkeypatch.setattr(topk, "PART_SHARDS", 2)
    assert sorted(tuple(r) for r in topk.topk(df, F.col("vec_id") % 50 == 0, shard_rows=50, block_rows=8).collect()) == sorted(want)
    assert topk.topk(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_leaves_out_shards(spark):
    # ids follow the direction of the vectors, so a query's own shard gives a k-th score that no other shard reaches
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in np.eye(8)[i // 100] * 9 + rng.normal(size=8) * 0.1]) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.topk(df, F.col("vec_id") % 50 == 0, shard_rows=100, block_rows=10, counts=True).collect()
    assert len(got) == 16 * 5 and all(r.scored <= 30 for r in got) and got[0].blocks >= 80


def test_topk_of_large_components():
    rng = np.random.default_rng(3)
    m = rng.integers(-(2**40), 2**40, (30, 4))
    scores, ids, _ = topk.search([(np.arange(30), m, m.max(0), m.min(0))], np.array([0]), m[:1] // 2**21, 3)
    want = sorted(((-(int((m[:1] // 2**21 @ m[k])[0])), k) for k in range(1, 30)))[:3]
    assert [(int(-s), int(i)) for s, i in zip(scores[0], ids[0])] == want
