"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length. A source's budget is whole rounds over all its documents plus a
rest; of the rest, each length first gives its even share, then long lengths are taken while they fit, and what then
remains is filled by bounded-knapsack dynamic programming over the lengths left. Which documents of a length are
taken is decided by a seeded order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, free_name

#: Parts by which the seeded order of one source and length is counted, so that none is ranked in one task: at least so
#: many, and so many that a part of a source and length that is all of the table has that many rows.
PARTS, PART_ROWS = 256, 1_000_000
#: Lengths above it are taken greedily, so that no table is longer than a few times this.
LONG_WORDS = 1_000_000


def word_count(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def with_targets(totals: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """totals: (source, words), a row a source. Adds target: shares of all words by weight, none above most times its words.

    Sources weigh weights, repeating, in code-point order, null last. What a full source cannot take is shared again
    among the others: the words a unit of weight gets only grow, so the rounds end when it stays. A round is one
    aggregate; the driver holds a number for each partition of the sources, never the sources.
    """
    ordered = [F.col("source").isNull(), F.col("source")]
    placed = cut(totals.repartitionByRange(*ordered).withColumn("part", F.spark_partition_id()))
    begin, at = [], 0
    for r in sorted(placed.groupBy("part").count().collect()):
        begin.append((r["part"], at))
        at += r["count"]
    begin = placed.sparkSession.createDataFrame(begin, "part int, begin long")
    place = F.col("begin") + F.row_number().over(Window.partitionBy("part").orderBy(*ordered)) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    placed = cut(placed.join(begin, "part").select("source", "words", weight.alias("weight")))
    unit, stopped = None, -1
    while True:
        full = F.lit(False) if unit is None else F.col("weight") * unit > most * F.col("words")
        free = F.when(~full & (F.col("words") > 0), F.col("weight"))
        left, shares, now = placed.agg(F.sum("words") - F.coalesce(F.sum(F.when(full, most * F.col("words"))), F.lit(0)), F.sum(free), F.count_if(full)).first()
        if not shares or now == stopped:  # no further source is full
            break
        unit, stopped = left / shares, now
    share = F.col("weight") * F.lit(float(unit or 0))
    return placed.select("source", "words", F.when(F.col("words") == 0, 0.0).otherwise(F.least(share, F.lit(float(most)) * F.col("words"))).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, long_words: int = LONG_WORDS) -> np.ndarray:
    """How many documents of each length to take, their lengths adding up to the budget or to the nearest sum that they make.

    Lengths above long_words are first taken from the longest down while they fit; the others then fill what is left.
    If that leaves more than half of the shortest long document still there, or more, one such document is taken beyond.
    """
    long = lengths > long_words
    if not (long & (counts > 0)).any():
        return filled(lengths, counts, budget)
    take, rest = np.zeros_like(counts), max(0, budget)
    for k in np.flatnonzero(long)[np.argsort(-lengths[long], kind="stable")]:
        take[k] = min(int(counts[k]), rest // int(lengths[k]))
        rest -= int(take[k]) * int(lengths[k])
    short = np.where(long, 0, counts)
    within = filled(lengths, short, rest)
    left = np.flatnonzero(long & (counts > take))
    if len(left):
        k = left[np.argmin(lengths[left])]
        missing, beyond = rest - int((lengths * within).sum()), int(lengths[k]) - rest
        if beyond < missing:  # it is longer than all that is left
            take[k] += 1
            return take
    return take + within


def filled(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """The nearest sum by bounded-knapsack dynamic programming; its table is a few times the greatest length long."""
    size = int((lengths * counts).sum())
    if budget <= 0 or not size:
        return np.zeros_like(counts)
    if budget >= size:
        return counts.copy()
    take = np.array([int(c) * budget // size for c in counts.tolist()], np.int64)
    rest = budget - int((lengths * take).sum())
    longest = int(lengths[counts > 0].max())
    for k in np.argsort(-lengths, kind="stable"):  # down to a few documents of the greatest length
        if rest <= 4 * longest:
            break
        if lengths[k] > 0:
            more = min(int(counts[k] - take[k]), (rest - 2 * longest) // int(lengths[k]))
            take[k] += more
            rest -= more * int(lengths[k])
    top = rest + min(rest, int(lengths[counts > take].max(initial=0)))  # the nearest sum may lie above
    first, steps = np.full(top + 1, -1, np.int32), []  # by which step a sum can be made first
    first[0] = 0
    for k in np.argsort(-lengths, kind="stable"):
        length, have, part = int(lengths[k]), int(counts[k] - take[k]), 1
        while have > 0 and 0 < length * part <= top and first[rest] < 0:
            n = min(part, have)
            if length * n <= top:
                steps.append((k, n))
                new = np.flatnonzero((first[: top + 1 - length * n] >= 0) & (first[length * n :] < 0))
                first[new + length * n] = len(steps)
            have -= n
            part *= 2
    made = np.flatnonzero(first >= 0)
    at = int(made[np.lexsort((made, np.abs(made - rest)))[0]])
    while at > 0:
        k, n = steps[first[at] - 1]
        take[k] += n
        at -= n * int(lengths[k])
    return take


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, seed: int = 7, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(key, source, size, source_size, target, reps): how often each document is taken.

    Sources in code-point order, null last, weigh weights, repeating; targets share all words, stopping at most times
    a source's words. A document's size is its words; documents without words, and null texts, have size 0 and reps 0.
    No document is taken more than most times. Documents above LONG_WORDS words are fitted greedily. Ties in the seeded order (repeated rows) are settled by row_number,
    which of equal rows is of no consequence. Reruns agree. An empty table gives no rows. Other columns are not read;
    where key or source are called like one of the operator's own columns, that one gets an underscore at its end.
    """
    # three narrow columns, read again by each step below instead of the texts
    sized = cut(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(text).alias("size")))
    parts_of = max(PARTS, -(-sized.count() // PART_ROWS))
    lengths = sized.groupBy("source", "size").count()
    totals = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).alias("words"))
    plan = cut(with_targets(totals, weights, most).select(F.col("source").alias("plan_source"), F.col("words").alias("source_size"), "target"))

    def budget(some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values("size")
        size, count = some["size"].to_numpy(np.int64), some["count"].to_numpy(np.int64)
        words, want = int(some["source_size"].iloc[0]), round(float(some["target"].iloc[0]))
        rounds = min(most, want // words) if words else 0
        more = fit(size, count, want - rounds * words) if words and rounds < most else np.zeros_like(count)
        return pd.DataFrame({"fit_source": some["source"], "fit_size": size, "rounds": rounds, "more": more})

    named = lengths.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    fits = named.groupBy("source").applyInPandas(budget, "fit_source string, fit_size long, rounds long, more long")

    order = F.xxhash64(F.lit(seed), F.col("key").cast("string"))
    dealt = sized.withColumn("order", order).withColumn("part", F.pmod(F.shiftright("order", 20), F.lit(parts_of)))
    parts = dealt.groupBy("source", "size", "part").count()
    before = parts.withColumn("before", F.sum("count").over(Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    before = (
        before.join(fits, F.col("source").eqNullSafe(F.col("fit_source")) & (F.col("size") == F.col("fit_size")))
        .join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
        .select(F.col("source").alias("s_"), F.col("size").alias("n_"), F.col("part").alias("p_"), F.coalesce("before", F.lit(0)).alias("before"), "rounds", "more", "source_size", "target")
    )
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("order", "key")))
    name = lambda c: free_name(c, [key, source])
    return ranked.join(before, F.col("source").eqNullSafe(F.col("s_")) & (F.col("size") == F.col("n_")) & (F.col("part") == F.col("p_"))).select(
        F.col("key").alias(key),
        F.col("source").alias(source),
        F.col("size").alias(name("size")),
        F.col("source_size").alias(name("source_size")),
        F.col("target").alias(name("target")),
        F.when(F.col("size") == 0, 0).otherwise(F.col("rounds") + (F.col("rank") + F.col("before") <= F.col("more")).cast("long")).cast("long").alias(name("reps")),
    )
