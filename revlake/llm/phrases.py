"""Phrase collocations by best-first branch-and-bound growth over prefix counts.

Cutting a phrase after its first word bounds the score of all that begins with that word by 1000 * n / f(word). So first
words are expanded by falling bound, the rarest first; a phrase grows to the right only while its prefix is frequent. A
language is settled when its last wanted score, among phrases that survive, is above the bound of every word that is
not expanded yet: the second round takes exactly the words that can still reach the scores of the first.

Texts are tokenised in tasks, where a word is a 64-bit hash (seeds are changed until no frequent word shares its hash
with another word, so nothing is merged), and a phrase is the string of its words' hashes. Only counts are shuffled.
Frequent words and phrases are known to the tasks by bit filters of fixed size: what a filter lets pass wrongly is
counted too and then falls out by its exact count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices
from .substring_dedup import mixed, powers

LONGEST = 5
#: Bytes that are hashed at once, starts that are counted at once, bits of a filter, share of the frequent occurrences in the first round.
STRETCH_BYTES, STARTS, FILTER_BITS, FIRST_SHARE = 1 << 20, 1 << 19, 26, 0.25
U = np.uint64
# fixed values: what ends a piece, and what parts its words
ENDS, GAPS = b".,;:!?\x0a\x0b\x0c\x0d", b" \x09"
KIND = np.zeros(256, np.uint8)
KIND[list(GAPS)], KIND[list(ENDS)] = 1, 2
GRAMS = "gram binary, k long, n long"
NEIGHBOURS = GRAMS + ", before long, after long"


class Text:
    """The words of some texts: their hashes, the pieces that they stand in, and where they stand in the joined bytes."""

    def __init__(self, texts: list[str | None], langs: list[str], seed: int):
        self.langs = langs
        raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]  # lower-cases A-Z alone
        self.joined = b"\n".join([*raw, b""])
        buffer = np.frombuffer(self.joined, np.uint8)
        kind = KIND[buffer]
        edge = np.diff(np.concatenate([[True], kind > 0]).view(np.int8))
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[self.start]
        self.doc = np.searchsorted(np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1), self.start, side="right")
        letters = np.random.default_rng(seed).integers(1, 2**63, 256, U)
        base = 0x9E3779B97F4A7C15
        own, k = np.zeros(len(self.start), U), 0
        while k < len(own):
            to = max(k + 1, int(np.searchsorted(self.end, self.start[k] + STRETCH_BYTES)))
            at, end = int(self.start[k]), int(self.end[to - 1])
            sums = np.concatenate([np.zeros(1, U), np.cumsum(letters[buffer[at:end]] * powers(base, end - at))])
            back = powers(pow(base, -1, 1 << 64), end - at)
            s, e = self.start[k:to] - at, self.end[k:to] - at
            own[k:to] = (sums[e] - sums[s]) * back[s] + (e - s).astype(U)
            k = to
        salt = np.array([xxhash.xxh64_intdigest(x.encode(), seed) for x in langs], U)
        h = mixed(own ^ salt[self.doc])
        self.hash = np.where(h == 0, U(1), h)  # 0 means that there is no word


def folded(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of rows of words."""
    out = np.zeros(len(columns[0]), U)
    for c in columns:
        out = mixed(out * U(0xD6E8FEB86659FD93) + c)
    return out


def batch(columns: list[np.ndarray], k: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> pa.RecordBatch:
    """Distinct rows of the columns, counted; and the only word before and after them, 0 if there are several or none."""
    order = np.argsort(k, kind="stable")
    differ = lambda c: c[order][1:] != c[order][:-1]
    new = differ(k)
    if any((differ(c) & ~new).any() for c in columns):  # two rows with one hash
        order = np.lexsort(columns)
        new = np.logical_or.reduce([differ(c) for c in columns])
    at = np.flatnonzero(np.concatenate([[True], new])[: len(k)])
    rows = np.stack([c[order[at]] for c in columns], axis=1) if len(at) else np.zeros((0, len(columns)), U)
    offsets = np.arange(len(at) + 1, dtype=np.int32) * (8 * len(columns))
    gram = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])
    out = {"gram": gram, "k": k[order[at]].view(np.int64), "n": np.diff(np.append(at, len(k)))}
    for name, side in (("before", before), ("after", after)):
        if side is not None:
            low, high = (f.reduceat(side[order], at) if len(at) else side[:0] for f in (np.minimum, np.maximum))
            out[name] = np.where(low == high, low, U(0)).view(np.int64)
    return pa.RecordBatch.from_pydict(out)


class Filter:
    """A bit a hash, of a size that does not depend on how many there are; it may say yes wrongly, never no."""

    def __init__(self, keys: DataFrame):
        place = F.shiftrightunsigned(keys["k"], 64 - FILTER_BITS)
        words = keys.select(F.shiftright(place, 6).alias("w"), F.expr("shiftleft(1L, int(k >>> " + str(64 - FILTER_BITS) + ") & 63)").alias("b")).groupBy("w").agg(F.expr("bit_or(b)").alias("b"))
        found = words.toPandas()  # at most 2 ** (FILTER_BITS - 6) rows
        bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
        bits[found["w"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64)
        self.bits = keys.sparkSession.sparkContext.broadcast(bits)

    def has(self, h: np.ndarray) -> np.ndarray:
        place = (h >> U(64 - FILTER_BITS)).astype(np.int64)
        return (self.bits.value[place >> 6] >> (place & 63) & 1).astype(bool)


def scan(docs: DataFrame, seed: int, job: Callable[[Text], Iterator[pa.RecordBatch]], kind: str) -> DataFrame:
    """docs: (lang, text). What job makes of all texts, a slice at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            langs, texts = some.column(0).to_pylist(), some.column(1).to_pylist()
            for a, b in slices(texts):
                yield from job(Text(texts[a:b], langs[a:b], seed))

    return docs.mapInArrow(run, kind)


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, word, gram, k, f) of every word."""

    def job(t: Text) -> Iterator[pa.RecordBatch]:
        h, first, n = np.unique(t.hash, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array([t.langs[d] for d in t.doc[first].tolist()], pa.string()),
            "word": pa.array([t.joined[a:b].decode("utf-8", "replace") for a, b in zip(t.start[first].tolist(), t.end[first].tolist())], pa.string()),
            "gram": pa.array([x.tobytes() for x in h], pa.binary()), "k": h.view(np.int64), "n": n,
        })

    rows = scan(docs, seed, job, "lang string, word string, gram binary, k long, n long")
    return rows.groupBy("lang", "word").agg(F.first("gram").alias("gram"), F.first("k").alias("k"), F.sum("n").alias("f"))


def pair_counts(docs: DataFrame, seed: int, first: Filter, word: Filter) -> DataFrame:
    """Pairs of frequent words that begin with one of those that are expanded."""

    def job(t: Text) -> Iterator[pa.RecordBatch]:
        known = word.has(t.hash)
        at = np.flatnonzero(known[:-1] & known[1:] & (t.piece[:-1] == t.piece[1:]))
        at = at[first.has(t.hash[at])]
        for s in range(0, len(at), STARTS):
            pair = [t.hash[at[s : s + STARTS]], t.hash[at[s : s + STARTS] + 1]]
            yield batch(pair, folded(pair))

    return scan(docs, seed, job, GRAMS).groupBy("gram").agg(F.first("k").alias("k"), F.sum("n").alias("n"))


def grown(docs: DataFrame, seed: int, first: Filter, word: Filter, pair: Filter) -> DataFrame:
    """Phrases of 2 to LONGEST words that begin with a frequent pair, and grow while their words and pairs can be frequent."""

    def job(t: Text) -> Iterator[pa.RecordBatch]:
        n, h = len(t.hash), t.hash
        if n < 2:
            return
        known, same = word.has(h), t.piece[:-1] == t.piece[1:]
        begins = first.has(h[:-1])
        frequent = np.zeros(n - 1, bool)
        at = np.flatnonzero(known[:-1] & known[1:] & same & begins)
        frequent[at] = pair.has(folded([h[at], h[at + 1]]))
        goes_on = known[:-1] & known[1:] & same & (frequent | ~begins)  # pairs of words not expanded now are not counted
        before = np.concatenate([[U(0)], np.where(same, h[:-1], U(0))])
        after = np.concatenate([np.where(same, h[1:], U(0)), [U(0)]])
        at = np.flatnonzero(frequent)
        for width in range(2, LONGEST + 1):
            if width > 2:
                at = at[at + width <= n]
                at = at[goes_on[at + width - 2]]
            for s in range(0, len(at), STARTS):
                i = at[s : s + STARTS]
                gram = [h[i + j] for j in range(width)]
                yield batch(gram, folded(gram), before[i], after[i + width - 1])

    rows = scan(docs, seed, job, NEIGHBOURS).groupBy("gram")
    ends = [f(c).alias(f"{name}_{c}") for c in ("before", "after") for name, f in (("low", F.min), ("high", F.max))]
    return rows.agg(F.sum("n").alias("n"), *ends)


def counts_of(docs: DataFrame, seed: int, wanted: DataFrame) -> DataFrame:
    """wanted: (gram, k). (gram, n) of those, wherever they stand."""
    asked = Filter(wanted)

    def job(t: Text) -> Iterator[pa.RecordBatch]:
        for width in range(2, LONGEST):
            at = np.flatnonzero(t.piece[: -width + 1] == t.piece[width - 1 :])
            for s in range(0, len(at), STARTS):
                i = at[s : s + STARTS]
                k = folded([t.hash[i + j] for j in range(width)])
                hit = asked.has(k)
                if hit.any():
                    yield batch([t.hash[i[hit] + j] for j in range(width)], k[hit])

    found = scan(docs, seed, job, GRAMS).groupBy("gram").agg(F.sum("n").alias("n"))
    return found.join(wanted.select("gram"), "gram", "left_semi")


def cuts_of(grams: DataFrame) -> DataFrame:
    """(gram, place, left, right, k): each phrase cut after each of its first words; k is the hash of the rest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            rows = [(g, j, g[: 8 * j], g[8 * j :]) for g in some["gram"] for j in range(1, len(g) // 8)]
            k = [folded(list(np.frombuffer(r, U)[:, None]))[0].astype(np.int64) for *_, r in rows]
            out = pd.DataFrame(rows, columns=["gram", "place", "left", "right"])
            yield out.assign(k=np.array(k, np.int64))

    return grams.select("gram").mapInPandas(run, "gram binary, place int, left binary, right binary, k long")


def scored(cuts: DataFrame, known: DataFrame, langs: DataFrame, words: DataFrame, found: DataFrame) -> DataFrame:
    """(gram, lang, a, score, l, r, n, stays): the least score of a phrase's cuts, of equal ones the first, in exact decimals."""
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    at = cuts.join(known.select(F.col("gram").alias("left"), F.col("f").alias("l")), "left").join(known.select(F.col("gram").alias("right"), F.col("f").alias("r")), "right")
    own = found.withColumn("first", F.expr("substring(gram, 1, 8)")).join(words.select(F.col("gram").alias("first"), "lang"), "first").join(langs, "lang")
    at = at.join(own.select("gram", "lang", "a", "n", "stays"), "gram").withColumns({"x": F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"), "y": wide("l") * wide("r")})
    best = F.min(F.struct(F.expr("x div y").alias("score"), "place", "l", "r")).alias("b")
    return at.groupBy("gram", "lang", "a", "n", "stays").agg(best).select("gram", "lang", "a", "n", "stays", "b.score", "b.l", "b.r")


def collocations(docs: DataFrame, least: int = 100, most: int = 2000, lang: str = "lang", text: str = "text", seed: int = 13, first_share: float = FIRST_SHARE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of 2 to 5 words of each language, by their least cut's score.

    Words and pieces are those of whole texts, A-Z lower-cased; a null language is und, a null text has no words. A
    phrase counts from least occurrences on, and not where a longer phrase of up to 5 words holds it as often: then
    every occurrence has one and the same word before or after it, which is counted beside it. Ties go to the larger
    count, then to the phrase in UTF-8 order. Repeated rows count again; an empty table, and a language without such
    phrases, give no rows; other columns are not read. A text takes some ten times its size in the task that reads it.
    """
    docs = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    while True:
        every = cut(word_counts(docs, seed))
        words = cut(every.filter(F.col("f") >= least))
        if every.groupBy("k").agg(F.count("*").alias("c"), F.max("f").alias("f")).filter(F.col("c") > 1).filter(F.col("f") >= least).isEmpty():
            break
        seed += 1  # a frequent word shares its hash
    langs = cut(every.groupBy("lang").agg(F.sum("f").alias("n")))
    word = Filter(words)
    # the rarest words first, in steps of a power of two, up to a share of all frequent occurrences
    step = words.withColumn("step", F.floor(F.log2("f")))
    mass = step.groupBy("lang", "step").agg(F.sum("f").alias("mass"))
    rarer = F.coalesce(F.sum("mass").over(Window.partitionBy("lang").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = mass.withColumn("rarer", rarer).withColumn("all", F.sum("mass").over(Window.partitionBy("lang"))).filter(F.col("rarer") <= F.col("all") * first_share)
    front = cut(step.join(begun.select("lang", "step"), ["lang", "step"], "left_semi").select("lang", "gram", "k", "f"))
    known, found, expanded, ranked = words.select("gram", "f"), None, None, None
    while not front.isEmpty():
        first = Filter(front)
        pairs = cut(pair_counts(docs, seed, first, word).filter(F.col("n") >= least))
        own = grown(docs, seed, first, word, Filter(pairs)).filter(F.col("n") >= least).withColumn("first", F.expr("substring(gram, 1, 8)"))
        one = lambda side: (F.col(f"low_{side}") == F.col(f"high_{side}")) & (F.col(f"low_{side}") != 0)
        stays = (F.length("gram") == 8 * LONGEST) | ~(one("before") | one("after"))
        own = cut(own.join(front.select(F.col("gram").alias("first")), "first", "left_semi").select("gram", F.col("n").alias("a"), stays.alias("stays")))
        expanded = front if expanded is None else expanded.unionByName(front)
        found = own if found is None else found.unionByName(own)
        known = known.unionByName(own.select("gram", F.col("a").alias("f")))
        cuts = cut(cuts_of(own))
        needed = cut(cuts.filter(F.length("right") > 8).select(F.col("right").alias("gram"), "k").distinct().join(known, "gram", "left_anti"))
        if not needed.isEmpty():  # rests that begin with a word that is not expanded yet
            known = known.unionByName(counts_of(docs, seed, needed).withColumnRenamed("n", "f"))
        known = cut(known.distinct())
        new = cut(scored(cuts, known, langs, words, own))
        ranked = new if ranked is None else ranked.unionByName(new)
        place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score")))
        last = ranked.filter("stays").withColumn("place", place).filter(F.col("place") == most).select("lang", F.col("score").alias("last"))
        bound = F.expr("cast(1000 as decimal(4,0)) * cast(n as decimal(19,0)) div cast(f as decimal(19,0))")
        rest = words.join(expanded.select("gram"), "gram", "left_anti").join(langs, "lang").join(last, "lang", "left")
        front = cut(rest.filter(F.col("last").isNull() | (bound >= F.col("last"))).select("lang", "gram", "k", "f"))
    out = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    if ranked is None:
        return docs.sparkSession.createDataFrame([], "lang string, rank int, phrase string, a long, l long, r long, n long, score long")
    by = Window.partitionBy("lang")
    best = ranked.filter("stays").withColumn("rank", F.rank().over(by.orderBy(F.desc("score"), F.desc("a")))).filter(F.col("rank") <= most)
    # words only of those that can be among the first, all ties with the last one included
    spelt = best.select("gram", F.posexplode(F.transform(F.sequence(F.lit(0), F.expr("length(gram) div 8 - 1")), lambda j: F.substr("gram", j * 8 + 1, F.lit(8)))).alias("j", "w"))
    spelt = spelt.join(words.select(F.col("gram").alias("w"), "word"), "w").groupBy("gram").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rank = F.row_number().over(by.orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("int")
    return best.drop("rank").join(spelt, "gram").withColumn("rank", rank).filter(F.col("rank") <= most).select(*out)
