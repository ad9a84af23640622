"""Repair of conversation structure: cheapest edits by a bidirectional Dijkstra search over the edit lattice.

A node of the lattice is how many rows are read and which state the repaired roles are in; keeping, re-roling, deleting
and inserting are edges. A forward heap grows from the start and a reverse heap from the accepting ends; where they
meet, every crossing of least cost is finished, and the least concatenated audit of all of them is taken.

Rows are ordered by Spark: equal rows of one turn are counted, a range partitioning deals a conversation of any length to
many tasks, and each gives the cheapest edits between all pairs of states of its stretch; stretches are then composed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

BLANKS = " \t\n\x0b\x0c\r"
#: Rows that one search reads; a longer conversation is composed of such stretches.
STRETCH = 256
# fixed values: the costs of the edits, and of a truncated row that stays
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States of the repaired roles: nothing yet, after a system row, after a user row, after an assistant row; and the
#: state that an initial leads to. Nothing yet and after an assistant row are accepting.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTING = (0, 3)
#: The state that a re-roled or inserted row leads to; it is a user row but after a user row.
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}


def edges_from(codes: str, i: int, s: int):
    """(node, cost, edit) of what can follow; codes: a letter a row, - where it must go, upper case where it is truncated."""
    yield (i, NEXT[s]), INSERT, "I"
    if i < len(codes):
        c = codes[i]
        yield (i + 1, s), DELETE, "D"
        if c != "-":
            more = TRUNCATED if c.isupper() else 0
            yield (i + 1, NEXT[s]), REROLE + more, "R"
            to = MOVES.get((s, c.lower()))
            if to is not None:
                yield (i + 1, to), more, "K"


@lru_cache(maxsize=20_000)
def cheapest(codes: str, start: int, goals: tuple[int, ...]) -> tuple[int, str] | None:
    """The least cost of edits from a state to one of the goals, and the least audit of that cost.

    Labels of one node and cost are never prefixes of each other (a longer one holds more inserts), so the least label
    of a node stays least in whatever it is part of. A heap takes equal costs in the order of rows read, so that edges
    without cost are done before the node that they lead to.
    """
    n, into = len(codes), {}
    for node in ((i, s) for i in range(n + 1) for s in range(4)):
        for to, cost, edit in edges_from(codes, *node):
            into.setdefault(to, []).append((node, cost, edit))
    forward, reverse = [(0, 0, "", start)], []
    done = ({}, {(n, g): (0, "") for g in goals})
    known = ({(0, start): (0, "")}, dict(done[1]))
    best = (float("inf"), "")

    def settle(side: int, cost: int, label: str, node: tuple[int, int]) -> None:
        """Crossings through a node that one heap has settled, and what lies beyond it."""
        nonlocal best
        done[side][node] = (cost, label)
        other = done[1 - side]
        steps = edges_from(codes, *node) if side == 0 else into.get(node, ())
        for to, more, edit in [(node, 0, ""), *steps]:
            text = label + edit if side == 0 else edit + label
            if to in other:
                rest = other[to]
                best = min(best, (cost + more + rest[0], text + rest[1] if side == 0 else rest[1] + text))
            if to != node and (to not in known[side] or (cost + more, text) < known[side][to]):
                known[side][to] = (cost + more, text)
                heappush(*((forward, (cost + more, to[0], text, to[1])) if side == 0 else (reverse, (cost + more, -to[0], text, to[1]))))

    for g in goals:
        settle(1, 0, "", (n, g))
    while forward and forward[0][0] + (reverse[0][0] if reverse else 0) <= best[0]:
        side = 0 if not reverse or forward[0][0] <= reverse[0][0] else 1
        cost, i, label, s = heappop((forward, reverse)[side])
        node = (abs(i), s)
        if node not in done[side]:
            settle(side, cost, label, node)
    return best if best[0] < float("inf") else None


def composed(tables: list[dict]) -> dict:
    """Cheapest edits of stretches in a row: (from, to) -> (cost, audit); neighbours are joined, again and again."""
    while len(tables) > 1:
        joined = []
        for a, b in zip(tables[::2], tables[1::2]):
            out: dict = {}
            for (s, m), (cost, audit) in a.items():
                for t in range(4):
                    if (m, t) in b:
                        found = (cost + b[m, t][0], audit + b[m, t][1])
                        out[s, t] = min(out.get((s, t), found), found)
            joined.append(out)
        tables = joined + (tables[-1:] if len(tables) % 2 else [])
    return tables[0]


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies): rows with faults by crc32(conv:turn) % 20; nulls count as one space.

    0: no copies are left; 1: the text is emptied; 2: it loses its . ! and ?; 3: two copies; 4: the role is user.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn)).cast("binary")) % 20
    body = F.when(fault == 1, "").when(fault == 2, F.translate(blank(text), ".!?", "")).otherwise(blank(text))
    copies = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("long")
    return df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.when(fault == 4, "user").otherwise(blank(role)).alias("role"), body.alias("text"), copies.alias("copies"))


def order_by(*more: str) -> list[Column]:
    return [F.col("conv"), *map(F.col, more), F.col("turn").isNotNull(), F.col("turn"), F.col("role"), F.col("h")]


def hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("h", F.sha2("text", 256)).withColumn("conv", F.col("conv").cast("string"))


def faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, h, n, blank, again, truncated): equal rows of a turn are one, counted n times; the text is its hash.

    again: its role and text stand in an earlier turn. Blank comes before again, again before truncated. A text that
    many rows share is counted before its shuffle, and is a hot key of the join on the side that AQE splits only.
    """
    blank = F.btrim("text", F.lit(BLANKS)) == ""
    cut_off = ~F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1)).isin(".", "!", "?")
    own = hashed(rows.withColumns({"blank": blank, "truncated": cut_off})).groupBy("conv", "turn", "role", "h").agg(F.sum("copies").alias("n"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"))
    own = cut(own)
    first = own.filter("n > 0 and not blank").groupBy(F.col("conv").alias("conv_"), F.col("role").alias("role_"), F.col("h").alias("h_")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("x"), "turn")).alias("first"))
    met = own.join(first, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("role") == F.col("role_")) & (F.col("h") == F.col("h_")), "left")
    again = F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    return met.select("conv", "turn", "role", "h", "n", "blank", again.alias("again"), (F.col("truncated") & ~F.col("blank") & ~again).alias("truncated"))


def stretches(facts: DataFrame) -> DataFrame:
    """Each conversation in its order, by tasks that hold ranges of rows: whole ones with their edits, others in stretches.

    (conv, part, seq, whole, first, last, illegal, cost, audit, costs, audits): first is empty if the row before is in
    the same task; costs and audits are the table of a
    stretch, from state times four plus to state, -1 where there is no way.
    """
    letter = F.substring("role", 1, 1)
    known = F.when(letter.isin("s", "u", "a"), letter).otherwise("x")
    code = F.when(F.col("blank") | F.col("again"), "-").when(F.col("truncated"), F.upper(known)).otherwise(known)
    rows = facts.filter("n > 0").select("conv", "turn", "role", "h", "n", known.alias("letter"), code.alias("code"))
    rows = rows.repartitionByRange(*order_by()).sortWithinPartitions(*order_by()).select("conv", "n", "letter", "code")
    kind = "conv string, part int, seq long, whole boolean, first string, last string, illegal long, cost long, audit string, costs array<int>, audits array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, conv, codes, first, last, illegal, alone = TaskContext.get().partitionId(), 0, None, None, "", "", 0, False
        out: list[tuple] = []

        def close(ends: bool) -> None:
            nonlocal seq
            whole = alone and ends
            if whole:
                cost, audit = cheapest(codes, 0, ACCEPTING)
                out.append((conv, part, seq, True, first, last, illegal, cost, audit, None, None))
            else:
                ways = [cheapest(codes, s, (t,)) or (-1, "") for s in range(4) for t in range(4)]
                out.append((conv, part, seq, False, first, last, illegal, 0, "", [w[0] for w in ways], [w[1] for w in ways]))
            seq += 1

        for some in batches:
            for name, n, letter, code in zip(some["conv"], some["n"].tolist(), some["letter"], some["code"]):
                if codes is None or name != conv:
                    if codes is not None:
                        close(True)
                    # the first conversation of a task may have begun in another one
                    alone, conv, codes, first, last, illegal = codes is not None, name, "", letter, "", 0
                illegal += (last + letter not in ("su", "ua", "au")) if last else 0
                illegal += n - 1  # a letter never follows itself
                last = letter
                while n:
                    room = STRETCH - len(codes)
                    more = code + "-" * (min(n, room) - 1) if room else ""
                    codes, n, code = codes + more, n - len(more), "-" if more else code
                    if n:
                        alone = False
                        close(False)
                        codes, first, illegal = "", "", 0  # its pair with the row before is counted
            yield pd.DataFrame(out, columns=[c.split()[0] for c in kind.split(", ")])
            out.clear()
        if codes is not None:
            close(False)  # the last one may go on in the next task
        yield pd.DataFrame(out, columns=[c.split()[0] for c in kind.split(", ")])

    return rows.mapInPandas(run, kind)


def audits(rows: DataFrame) -> DataFrame:
    """rows: (conv, turn, role, text, copies). One row a conversation: its faults and its cheapest edits.

    (conv string, gaps, blank, duplicate, truncated, illegal, cost, audit). The edits are K, R, D and I, the least string
    among the cheapest. Rows go by turn, nulls first; rows of one turn by role and by the hash of their text. A null
    conversation is one of its own; one without rows (copies 0) has zeros and an empty audit. Roles other than those
    starting with s, u and a cannot be kept. A conversation's audit is one string, a letter a row; its table while
    stretches are composed holds sixteen. An empty table gives no rows.
    """
    facts = cut(faults(rows))
    there = F.col("n") > 0
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    stats = facts.groupBy("conv").agg(
        F.max(F.when(there, F.col("turn"))).alias("high"), F.min(F.when(there, F.col("turn"))).alias("low"), F.count_distinct(F.when(there, F.col("turn"))).alias("turns"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(there & ~F.col("blank"), F.col("n") - 1 + F.col("again").cast("long")).otherwise(0)).alias("duplicate"),
        F.sum(F.when(there & F.col("truncated"), 1).otherwise(0)).cast("long").alias("truncated"),
    )
    gaps = F.coalesce((wide("high") - wide("low") + 1 - wide("turns")).try_cast("long"), F.lit(0))
    stats = stats.select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated")
    parts = cut(stretches(facts))

    def join(some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values(["part", "seq"])
        tables = [{(k // 4, k % 4): (int(c), a) for k, (c, a) in enumerate(zip(costs, audits)) if c >= 0} for costs, audits in zip(some["costs"], some["audits"])]
        cost, audit = min(found for (s, t), found in composed(tables).items() if s == 0 and t in ACCEPTING)
        pairs = zip(["", *some["last"]], some["first"])
        illegal = int(some["illegal"].sum()) + sum(bool(a and b) and a + b not in ("su", "ua", "au") for a, b in pairs)
        return pd.DataFrame({"name": [some["conv"].iloc[0]], "illegal": [illegal], "cost": [cost], "audit": [audit]})

    found = parts.filter("whole").select(F.col("conv").alias("name"), "illegal", "cost", "audit")
    split = parts.filter("not whole").select("conv", "part", "seq", "first", "last", "illegal", "costs", "audits")
    found = found.unionByName(split.groupBy("conv").applyInPandas(join, "name string, illegal long, cost long, audit string"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return stats.join(found, F.col("conv").eqNullSafe(F.col("name")), "left").select(*stats.columns, zero("illegal"), zero("cost"), F.coalesce("audit", F.lit("")).alias("audit"))


def edited(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """Rows beside their edits: by conversation, its audit first and then its rows in order, each conversation in one task."""
    texts = hashed(rows).filter("copies > 0").select("conv", F.lit(1).alias("ord"), "turn", "role", "h", "text", "copies", F.lit("").alias("audit"))
    heads = audited.select("conv", F.lit(0).alias("ord"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit("").alias("h"), F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"), "audit")
    return heads.unionByName(texts).repartition("conv").sortWithinPartitions(*order_by("ord")).select("conv", "ord", "role", "text", "copies", "audit")


def applied(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(conv, None, None, None) where a conversation begins, then (conv, edit, role, text) of every row that it is left with."""

    def step(edit: str, role: str, text: str):
        nonlocal state
        new = "user" if NEXT[state] == 2 else "assistant"
        state = MOVES[state, role[:1]] if edit == "K" else NEXT[state]
        return conv, edit, role if edit == "K" else new, "" if edit == "I" else text

    conv, audit, at, state = None, "", 0, 0
    for some in batches:
        for name, ord, role, text, copies, edits in some.itertuples(index=False):
            if ord == 0:
                while at < len(audit):  # inserts at the end of the one before
                    yield step("I", "", "")
                    at += 1
                conv, audit, at, state = name, edits, 0, 0
                yield conv, None, None, None
                continue
            for _ in range(copies):
                while audit[at] == "I":
                    yield step("I", "", "")
                    at += 1
                if audit[at] != "D":
                    yield step(audit[at], role, text)
                at += 1
    while at < len(audit):
        yield step("I", "", "")
        at += 1


def repaired(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """(conv, place, edit, role, text): the rows of each conversation after its edits (K, R or I), numbered from 0.

    audited: what audits gave for the same rows. A conversation streams through one task, a batch of rows at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size, place = [], 0, 0
        for conv, edit, role, text in applied(batches):
            if edit is None:
                place = 0
                continue
            out.append((conv, place, edit, role, text))
            place, size = place + 1, size + 40 + len(text)
            if size > 1_000_000:
                yield pd.DataFrame(out, columns=["conv", "place", "edit", "role", "text"])
                out, size = [], 0
        yield pd.DataFrame(out, columns=["conv", "place", "edit", "role", "text"])

    return edited(rows, audited).mapInPandas(run, "conv string, place long, edit string, role string, text string")


def digests(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """(conv, sha256): of each repaired conversation's role:text, joined by newlines; of nothing where no row is left.

    One hash over a whole conversation is a sequential thing: its rows stream through one task, a batch at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, conv, digest, begun = [], None, None, False
        for name, edit, role, text in applied(batches):
            if edit is None:
                if digest is not None:
                    out.append((conv, digest.hexdigest()))
                conv, digest, begun = name, hashlib.sha256(), False
            else:
                digest.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
                begun = True
            if len(out) >= 5_000:
                yield pd.DataFrame(out, columns=["conv", "sha256"])
                out = []
        if digest is not None:
            out.append((conv, digest.hexdigest()))
        yield pd.DataFrame(out, columns=["conv", "sha256"])

    return edited(rows, audited).mapInPandas(run, "conv string, sha256 string")
