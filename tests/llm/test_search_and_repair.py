"""One-bit codes, conversation repair and collocations against brute force, with every odd case."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter
from functools import reduce
from operator import add, mul

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from revlake.llm import bit_codes, conversations, phrases, queries

TABLES = "documents embeddings conversations".split()


@pytest.mark.parametrize("name", ["op11_ann", "op12_conversation_repair", "op13_collocations"])
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cur = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in cur.description]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(cur.fetchall(), key=repr)


def nearest(rows, k):
    """The k nearest of each query row, by brute force: rows are (id, vector or None, asks)."""
    own = [(n, r[0], [float(x) for x in r[1]], r[2]) for n, r in enumerate(rows) if r[0] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    out = []
    for n, i, v, asks in own:
        if asks:
            found = sorted((-reduce(add, map(mul, v, w)), j) for m, j, w, _ in own if m != n and len(w) == len(v))[:k]
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(found)]
    return sorted(out)


def test_codes_find_the_nearest(spark):
    rng = np.random.default_rng(2)
    m = rng.standard_normal((3000, 48)) * rng.lognormal(0, 1, (3000, 1))
    m[100:1100] = m[5]  # a third of all rows is one vector
    rows = [(k, m[k].tolist(), k % 20 == 0) for k in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, asks boolean")
    got = bit_codes.nearest(df, F.col("asks"), block_rows=256, chunk=64, counts=True)
    scored = got.agg(F.avg("exactly")).first()[0]
    found = sorted(map(tuple, got.drop("exactly").collect()))
    want = nearest(rows, 20)
    assert len(found) == len(want) and len(set(found) & set(want)) >= 0.99 * len(want)
    assert scored < 2400  # of 3000, a third of which are copies that no bound can part


def test_estimates_keep_their_bounds():
    rng = np.random.default_rng(5)
    for width in (1, 3, 64, 300):
        m = rng.standard_normal((2000, width)) * 3
        bits, norm, lean = bit_codes.encode(m, 11)
        row = type("Row", (), {"shard": 0, "block": 0, "ids": np.arange(2000).tobytes(), "bits": bits.tobytes(), "norm": norm.tobytes(), "lean": lean.tobytes(), "vectors": m.tobytes()})
        block = bit_codes.Block(row, np.float64)
        misses = []
        for q in rng.standard_normal((40, width)):
            about, error = block.estimate(bit_codes.Query(q, 11))
            misses.append(np.abs(about - m @ q) > error * (1 + 1e-9) + 1e-9)
        assert np.mean(misses) < 0.002, width


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (20, [0.5, 0.5], 1), (20, [2.0, 0.0], 1), (3, [0.0, 0.0], 0), (4, None, 0), (5, [None, 1.0], 0), (6, [nan, 1.0], 0), (7, [inf, 1.0], 0), (None, [1.0, 1.0], 0), (8, [], 0), (9, [1.0, 2.0, 3.0], 1), (40, [-1.0, 0.0], 1), (10, [1.0, 1.0], 0), (11, [1e300, 1e300], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "query_id long, embedding array<double>, asks int, score string")
    got = bit_codes.nearest(df, F.col("asks") == 1, id="query_id")
    assert got.columns == ["query_id", "rank", "query_id_", "score"]
    assert sorted(map(tuple, got.collect())) == nearest([(i, v, a == 1) for i, v, a in rows], 20)
    assert bit_codes.nearest(df.limit(0), F.col("asks") == 1, id="query_id").count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "vec_id long, embedding array<float>")
    assert list(map(tuple, bit_codes.nearest(few, F.col("vec_id") == 0).collect())) == [(0, 1, 1, 11.0)]


def edits(codes):
    """The cheapest edits row by row: (cost, audit)."""

    def inserted(ways):
        for s in (0, 1, 2, 3, 2):
            if s in ways:
                to, way = conversations.NEXT[s], (ways[s][0] + 5, ways[s][1] + "I")
                ways[to] = min(ways.get(to, way), way)
        return ways

    now = inserted({0: (0, "")})
    for c in codes:
        after = {}
        for s, (cost, audit) in now.items():
            more = 5 * c.isupper()
            steps = [(s, 2, "D")] + ([(conversations.NEXT[s], 1 + more, "R")] if c != "-" else [])
            if (s, c.lower()) in conversations.MOVES:
                steps.append((conversations.MOVES[s, c.lower()], more, "K"))
            for to, add, edit in steps:
                after[to] = min(after.get(to, (cost + add, audit + edit)), (cost + add, audit + edit))
        now = inserted(after)
    return min(now[s] for s in (0, 3) if s in now)


def test_search_gives_the_cheapest_and_least_edits():
    for n in range(4):
        for codes in map("".join, itertools.product("suaxSUA-", repeat=n)):
            assert conversations.cheapest(codes, 0, (0, 3)) == edits(codes)
    rng = random.Random(1)
    for _ in range(300):
        codes = "".join(rng.choices("suaxUA-", k=rng.randrange(40)))
        want = edits(codes)
        assert conversations.cheapest(codes, 0, (0, 3)) == want
        assert re.fullmatch("[KRDI]*", want[1])
        a, b = sorted(rng.choices(range(len(codes) + 1), k=2))
        tables = [{(s, t): w for s in range(4) for t in range(4) if (w := conversations.cheapest(part, s, (t,)))} for part in (codes[:a], codes[a:b], codes[b:])]
        assert min(w for (s, t), w in conversations.composed(tables).items() if s == 0 and t in (0, 3)) == want


def repair(rows):
    """rows of one conversation (turn, role, text) after damage, in order: what op12 returns of it."""
    word = "[^\x20\x09-\x0d]"
    seen, codes, counts = set(), "", Counter()
    for _, role, text in rows:
        letters = re.findall(word, text)
        fault = "blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        c = role[:1] if role[:1] in ("s", "u", "a") else "x"
        codes += "-" if fault in ("blank", "duplicate") else c.upper() if fault else c
    cost, audit = edits(codes) if rows else (0, "")
    out, at, state = [], 0, 0
    for e in audit:
        if e == "D":
            at += 1
            continue
        role, text = ("user" if state != 2 else "assistant", "") if e == "I" else rows[at][1:]
        if e == "R":
            role = "user" if state != 2 else "assistant"
        state = conversations.MOVES[state, role[:1]]
        at += e != "I"
        out.append((e, role, text))
    turns = {r[0] for r in rows} - {None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in out).encode()).hexdigest()
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit), digest, out


def damage(rows):
    """All conversations (conv, turn, role, text), damaged and in order."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if f == 0:
            continue
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        own += [(turn, "user" if f == 4 else role, text)] * (2 if f == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest())
    return {conv: sorted(own, key=key) for conv, own in out.items()}


def check_repair(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, audit string")
    given = conversations.damaged(df)
    audited = conversations.audits(given).cache()
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    want = {None if c is None else str(c): repair(own) for c, own in damage(rows).items()}
    assert {r[0]: tuple(r)[1:] for r in audited.select(*names).collect()} == {c: w[0] for c, w in want.items()}
    assert dict(map(tuple, conversations.digests(given, audited).collect())) == {c: w[1] for c, w in want.items()}
    kept = {}
    for r in conversations.repaired(given, audited).orderBy("place").collect():
        kept.setdefault(r.conv, []).append((r.edit, r.role, r.text))
    assert kept == {c: w[2] for c, w in want.items() if w[2]}


def test_repair_of_odd_conversations(spark):
    rng = random.Random(8)
    texts, roles = ["Well.", "well", "", " \t", None, "Yes!", "　", "a.\x0b", "Ä? "], ["user", "assistant", "system", None, "", "tool", "User"]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(150) for t in range(rng.randrange(1, 9))]
    rows += [(None, t, "user", "Hm.") for t in (None, 1, 1)] + [(7, None, "user", "first."), (7, 2**62, "assistant", "far."), (9, -(2**62) - 5, "user", "low.")]
    rows += rows[:60]  # repeated rows
    check_repair(spark, rows)
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.audits(conversations.damaged(none)).count() == 0


def test_repair_of_a_long_conversation(spark):
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["One.", "Two", f"Own {t}.", f"Own {t}"])) for t in range(2500)]
    rows += [(2, 5, "user", "Same.")] * 700 + [(3, 1, "user", "Hi."), (3, 2, "assistant", "Ho.")]
    check_repair(spark, rows)


def collocations(docs, least, most):
    counts, total = Counter(), Counter()
    for lang, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for k in range(1, 6):
                counts.update((lang or "und", tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    known = {g: f for g, f in counts.items() if f >= least and len(g[1]) > 1}
    dropped = {(lang, p) for (lang, g), f in known.items() for p in (g[1:], g[:-1]) if counts[lang, p] == f}
    rows = {}
    for (lang, g), a in known.items():
        n = total[lang]
        score, k = min((1000 * a * n // (counts[lang, g[:k]] * counts[lang, g[k:]]), k) for k in range(1, len(g)))
        if (lang, g) not in dropped:
            rows.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), counts[lang, g[:k]], counts[lang, g[k:]], n))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n, -s) for lang, own in rows.items() for i, (s, a, p, l, r, n) in enumerate(sorted(own)[:most]))


def sample_texts():
    rng = random.Random(6)
    words = [f"w{k}" for k in range(60)] + ["Ä", "ä", "A", "a", "　", "x\x00y"]
    weights = [1 / (k + 1) for k in range(len(words))]
    docs = [(rng.choice(["en", "de", None, "und"]), "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for w in rng.choices(words, weights, k=rng.randrange(60)))) for _ in range(600)]
    return docs + [("en", "alpha beta gamma delta epsilon zeta eta")] * 40 + [("en", None), ("de", ""), ("fr", "one two"), ("en", "ha " * 300)]


@pytest.mark.parametrize("most,share", [(5, 0.01), (12, 0.25), (2000, 0.25)])
def test_collocations_by_brute_force(spark, monkeypatch, most, share):
    """Small targets settle early, after one round or two; the rests of phrases then begin with words that were not expanded."""
    monkeypatch.setattr(phrases, "STARTS", 50)
    docs = sample_texts()
    df = spark.createDataFrame([(*d, 1) for d in docs], "lang string, text string, rank int").repartition(5)
    got = phrases.collocations(df, 20, most, first_share=share)
    assert sorted(map(tuple, got.collect())) == collocations(docs, 20, most)


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([("en", None), (None, ""), ("de", " .,")], "lang string, text string")
    assert phrases.collocations(df).count() == 0
    assert phrases.collocations(df.limit(0)).count() == 0


def test_words_do_not_depend_on_slices(monkeypatch):
    texts = [t for _, t in sample_texts()]
    whole = phrases.Text(texts, ["en"] * len(texts), 13)
    monkeypatch.setattr(phrases, "STRETCH_BYTES", 64)
    assert (phrases.Text(texts, ["en"] * len(texts), 13).hash == whole.hash).all()
    alone = np.concatenate([phrases.Text([t], ["en"], 13).hash for t in texts])
    assert (alone == whole.hash).all()
