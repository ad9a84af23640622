"""Secret scans by a trigram inverted index, in DataFrame operations only.

From each rule's pattern a Boolean trigram query is derived: alternatives of trigrams that a match must hold. A
document's entries of the index (which of the asked trigrams it holds) stay in its own row: the rarest trigram of every
alternative is looked up first, the others only where one of those is held. The entries are intersected with the
queries, and only documents that satisfy a rule's query are searched with its pattern; no text is ever shuffled. Rules
without mandatory trigrams scan every document.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass
from re import _constants as op  # the standard library's own pattern tree
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: Strings that one stretch of a pattern may expand to; beyond it the stretch is cut.
MOST_STRINGS = 64
ANY = frozenset({frozenset()})


@dataclass(frozen=True)
class Rule:
    """A match counts if its group has at least so many characters. base: one of the three kinds that are always on."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


# The three base kinds, in the order of their listing, then public token formats. A run of 24 or more
# is the same match as a run of any length that is then dropped below 24; likewise for AKIA and 16 more.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)


def grams(strings: set[str]) -> frozenset:
    return frozenset(frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings)


def both(a: frozenset, b: frozenset) -> frozenset:
    return frozenset(x | y for x in a for y in b)


def expand(nodes) -> tuple[set[str] | None, frozenset]:
    """Of a pattern tree: all its strings (lower case) if they are few, else None; and its trigram query."""
    now, query, exact = {""}, ANY, True
    for kind, arg in nodes:
        own: set[str] | None = None
        need = ANY
        if kind is op.LITERAL:
            own = {chr(arg).lower()}
        elif kind is op.IN and all(k is op.LITERAL for k, _ in arg) and len(arg) <= 8:
            own = {chr(c).lower() for _, c in arg}
        elif kind is op.SUBPATTERN:
            own, need = expand(arg[-1])
        elif kind is op.BRANCH:
            parts = [expand(x) for x in arg[1]]
            own = set().union(*(p[0] for p in parts)) if all(p[0] is not None for p in parts) else None
            need = frozenset().union(*(grams(p[0]) if p[0] is not None else p[1] for p in parts))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            least, most, inner = arg
            own, need = expand(inner)
            if least == 0:
                own, need = (own | {""} if own is not None and most == 1 else None), ANY
            elif (least, most) != (1, 1):
                need, own = (grams(own) if own is not None else need), None
        if own is not None and len(now) * len(own) <= MOST_STRINGS:
            now = {a + b for a in now for b in own}
            continue
        query, now, exact = both(query, both(grams(now), grams(own) if own is not None else need)), {""}, False
    return (now, grams(now)) if exact else (None, both(query, grams(now)))


def trigram_query(pattern: str) -> list[frozenset]:
    """Alternatives, each a set of lower-case trigrams that a match must hold; none if nothing is mandatory."""
    query = expand(_parser.parse(pattern))[1]
    fewest = [q for q in query if not any(other < q for other in query)]  # an alternative that asks for more adds nothing
    return [] if frozenset() in query else sorted(fewest, key=sorted)


def rarity(gram: str) -> tuple[int, str]:
    """Orders trigrams by how seldom they are expected: the letters of English by frequency, anything else is rarer."""
    common = "etaoinshrdlcumwfgypbvkjxqz"
    return (-sum(common.find(c) if c in common else 40 for c in gram), gram)


def candidates(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """rows: any columns beside body_. Adds hits_: the kinds of the rules whose trigram query the row satisfies."""
    asked = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    if not asked:
        return rows.withColumn("hits_", F.array().cast("array<string>"))
    every = sorted({g for q in asked.values() for alt in q for g in alt})
    number = {g: k for k, g in enumerate(every)}
    rare = sorted({min(alt, key=rarity) for q in asked.values() for alt in q})
    held = lambda grams: F.array_compact(F.array(*[F.when(F.contains("low_", F.lit(g)), F.lit(number[g])) for g in grams]))
    found = rows.withColumn("low_", F.lower("body_")).withColumn("rare_", held(rare))
    found = found.withColumn("grams_", F.when(F.size("rare_") == 0, F.col("rare_")).otherwise(F.concat("rare_", held([g for g in every if g not in rare]))))

    def satisfied(query: list[frozenset]) -> Column:
        return functools.reduce(Column.__or__, [F.size(F.array_intersect("grams_", F.array(*[F.lit(number[g]) for g in sorted(alt)]))) == len(alt) for alt in query])

    hits = F.array_compact(F.array(*[F.when(satisfied(q), F.lit(kind)) for kind, q in asked.items()]))
    return found.withColumn("hits_", F.when(F.size("grams_") == 0, F.array().cast("array<string>")).otherwise(hits)).drop("low_", "rare_", "grams_")


def matches(body: Column, rule: Rule, order: int) -> Column:
    """Leftmost non-overlapping matches as an array of (start, ord, kind, end), in code points, end exclusive."""
    whole = F.regexp_extract_all(body, F.lit(rule.pattern), 0)
    group = F.regexp_extract_all(body, F.lit(rule.pattern), rule.group)
    gaps = F.slice(F.split(body, rule.pattern, -1), 1, F.size(whole))
    kind = "struct<start:long,ord:int,kind:string,end:long>"
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{kind}>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["whole"])
        span = F.array(F.struct(start.cast("long").alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), end.cast("long").alias("end")))
        return F.struct(end.cast("long").alias("at"), F.when(F.length(x["group"]) >= rule.least, F.concat(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    zipped = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), group.alias("group"))
    none = F.array().cast(f"array<{kind}>")
    return F.when(F.rlike(body, F.lit(rule.pattern)), F.aggregate(zipped, begin, step, lambda a: a["found"])).otherwise(none)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep..., body, spans): spans is array<(start long, ord int, kind string, end long)> by start, then listing.

    Whole texts are searched; a null text is an empty one in body. Every row is judged by itself, so repeated rows and
    null keys give one row each; a very long text is one row like others. Spans of different kinds may overlap; those
    of one kind do not. An empty table gives no rows. Other columns are not read; where key or keep are themselves
    called body or spans, the operator's own column of that name gets an underscore at its end.
    """
    own = [key, *keep]
    rows = docs.select(F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(own)]).alias("own_"), F.coalesce(F.col(text), F.lit("")).alias("body_"))
    found = candidates(rows, rules)
    none = F.array().cast("array<struct<start:long,ord:int,kind:string,end:long>>")
    spans = [
        F.when(F.array_contains("hits_", r.kind), matches(F.col("body_"), r, k)).otherwise(none) if trigram_query(r.pattern) else matches(F.col("body_"), r, k)
        for k, r in enumerate(rules)
    ]
    body, name = free_name("body", own), free_name("spans", own)
    return found.select(*[F.col(f"own_.c{k}").alias(c) for k, c in enumerate(own)], F.col("body_").alias(body), F.array_sort(F.concat(*spans)).alias(name))


def joined_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(body: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by a mark; overlapping spans become one."""
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        between = F.substring(body, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        more = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(between, F.lit(mark)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), more.alias("out"))

    def end(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(body, (acc["at"] + 1).cast("int"), F.length(body)))

    return F.when(F.size(spans) == 0, body).otherwise(F.aggregate(spans, begin, step, end))
