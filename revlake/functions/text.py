"""Column expressions over text; no Python runs per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s"
# fixed values: words that may stay lower-case in a title
MINOR_WORDS = ["a", "an", "and", "as", "at", "but", "by", "for", "from", "in", "nor", "of", "on", "or", "per", "the", "to", "up", "via", "with"]
# fixed values: what makes a question lean on the turn before it
REFERENTIAL = ["it", "its", "this", "that", "these", "those", "they", "them", "their", "there", "he", "she", "his", "her"]
STARTERS = ["what about", "how about", "and for", "and what", "what if", "why", "and", "but", "also", "then"]
# fixed values: phrases of an answer that declines
REFUSALS = [
    "could not find enough information",
    "couldn't find enough information",
    "not enough information",
    "do not contain enough information",
    "don't contain enough information",
    "no information about",
    "does not appear in the available documents",
    "not covered by the available documents",
    "unable to find",
]
# fixed values: titles of administrative sections
ADMINISTRATIVE = ["document control", "revision history", "version history", "approval history", "table of contents", "distribution list", "references", "related documents"]

# fixed values: patterns of headings, list items, codes, citations, rewrites and storage keys
MARKED = r"^(#{1,6})\s+"
NUMBERED = r"^(\d+(?:\.\d+)*)[.)]?\s+(.{2,120})$"
CAPITALS = r"^[A-Z0-9][A-Z0-9 &/,'()\-.]{2,80}$"
LABEL = r"^[A-Za-z][A-Za-z ]{0,30}:\s+\S"
LIST_ITEM = r"^\s*(?:[-*•·]|\(?\d+[.)]|[a-z][.)])\s+\S"
DOCUMENT_CODE = r"\b[A-Z]{2,6}(?:-[A-Z]{2,8})+-\d{1,4}\b"
ERROR_CODE = r"\bORA-\d{4,5}\b"
CITED = r"\[(\d{1,2})\]"
FRAMING = r"(?i)^(?:standalone question|rewritten question|question)\s*:\s*"
KEY = r"^([A-Za-z0-9._-]+)/rev-(\d{1,4})/(.+)$"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def normalize_whitespace(c: Column) -> Column:
    """One kind of line end and of blank, no zero-width characters, at most one empty line."""
    for pattern, by in ((r"\r\n?", "\n"), (" ", " "), ("[​‌‍﻿]", ""), (r"[ \t]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n")):
        c = F.regexp_replace(c, pattern, by)
    return trimmed(c)


def dehyphenate(c: Column) -> Column:
    return F.regexp_replace(c, r"([a-z])-\n([a-z])", "$1$2")


def normalize_for_comparison(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def terms(c: Column) -> Column:
    """Normalised words, with repeats; none for a text without any."""
    return F.filter(F.split(normalize_for_comparison(c), " "), lambda w: w != "")


def index_terms(c: Column, stop: tuple[str, ...] = (), stem: bool = False) -> Column:
    """Terms for a text index: without stop words, and with plural, past and gerund ends of longer words cut off, if asked."""
    words = terms(F.coalesce(c, F.lit("")))
    words = F.filter(words, lambda w: ~w.isin(*stop)) if stop else words
    return F.transform(words, lambda w: F.when(F.length(w) > 4, F.regexp_replace(w, "(?:ies|ing|ed|es|s)$", "")).otherwise(w)) if stem else words


def jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(terms(a)), F.array_distinct(terms(b))
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(both / (F.size(x) + F.size(y) - both))


def containment(candidate: Column, reference: Column) -> Column:
    """Share of the candidate's words, with repeats, that the reference holds."""
    return array_containment(terms(candidate), terms(reference))


def array_containment(words: Column, ref: Column) -> Column:
    covered = F.size(F.filter(words, lambda w: F.array_contains(ref, w)))
    return F.when(F.size(words) == 0, 0.0).otherwise(covered / F.size(words))


def printable_ratio(c: Column) -> Column:
    odd = F.length(F.regexp_replace(c, "[^\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\xA0]", ""))
    return F.when(F.length(c) == 0, 0.0).otherwise((F.length(c) - odd) / F.length(c))


def file_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def content_hash(c: Column) -> Column:
    return F.sha2(F.lower(normalize_whitespace(c)), 256)


def token_count(c: Column, counter: Callable[[Column], Column] | None = None) -> Column:
    """The closed form for long texts, 3.8 characters a token; or a user's own counter (Y5)."""
    if counter is not None:
        return F.coalesce(counter(c), F.lit(0))
    return F.ceil(F.length(c) / F.lit(3.8)).cast("int")


def truncate_to_tokens(c: Column, budget: int) -> Column:
    """The longest prefix within the budget, cut at a blank if that keeps over 80% of it."""
    cut = F.substring(c, 1, int(budget * 3.8))
    last = F.length(cut) - F.instr(F.reverse(cut), " ")
    word = F.when((F.instr(cut, " ") > 0) & (last > F.length(cut) * 0.8), F.substring(cut, F.lit(1), last)).otherwise(cut)
    return F.when(token_count(c) <= budget, c).otherwise(word)


def excerpt(c: Column, most: int = 320) -> Column:
    clean = F.regexp_replace(normalize_whitespace(c), r"\n+", " ")
    cut = F.substring(clean, 1, most)
    last = F.length(cut) - F.instr(F.reverse(cut), " ")
    body = F.when((F.instr(cut, " ") > 0) & (last > most * 0.6), F.substring(cut, F.lit(1), last)).otherwise(cut)
    return F.when(F.length(clean) <= most, clean).otherwise(F.concat(F.rtrim(body), F.lit("…")))


def heading_level(c: Column) -> Column:
    """1 to 6, or 0 for a line that is no heading."""
    line = trimmed(c)
    marks = F.regexp_extract(line, MARKED, 1)
    number = F.regexp_extract(line, NUMBERED, 1)
    body = F.regexp_extract(line, NUMBERED, 2)
    numbered = (number != "") & ~body.rlike(r"[.:;]$") & (F.size(F.split(body, " ")) <= 12)
    capitals = line.rlike(CAPITALS) & (F.size(F.split(line, " ")) <= 10) & ~line.rlike(r"[.]$")
    return (
        F.when((line == "") | (F.length(line) > 120), 0)
        .when(marks != "", F.length(marks))
        .when(numbered, F.least(F.size(F.split(number, r"\.")) + 1, F.lit(6)))
        .when(capitals | title_case(line), 2)
        .otherwise(0)
    )


def title_case(line: Column) -> Column:
    words = F.filter(F.split(line, r"\s+"), lambda w: w != "")
    letters = F.transform(words, lambda w: F.regexp_replace(w, "[^A-Za-z]", ""))
    heavy = F.filter(letters, lambda w: ~F.lower(w).isin(MINOR_WORDS))
    upper = F.filter(heavy, lambda w: w.rlike("^[A-Z]"))
    return (
        (F.length(line) <= 70)
        & ~line.rlike(r"[.,;:!?]$")
        & ~line.rlike(r"\s{3,}")
        & ~line.rlike(LABEL)
        & F.size(words).between(1, 9)
        & line.rlike("^[A-Z]")
        & ~F.array_contains(letters, "")
        & (F.size(heavy) > 0)
        & (F.size(upper) >= 0.8 * F.size(heavy))
    )


def is_list_item(c: Column) -> Column:
    return c.rlike(LIST_ITEM)


def is_table_row(c: Column) -> Column:
    line = trimmed(c)
    return line.startswith("|") & line.endswith("|") & (F.size(F.split(line, r"\|")) >= 3)


def split_columns(c: Column) -> Column:
    return F.filter(F.transform(F.split(trimmed(c), r"\s{3,}"), F.trim), lambda x: x != "")


def is_column_row(c: Column) -> Column:
    return F.size(split_columns(c)) >= 3


def section_role(title: Column) -> Column:
    return F.when(F.lower(F.trim(title)).isin(ADMINISTRATIVE), "ADMINISTRATIVE").otherwise("CONTENT")


def extract_codes(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.upper(c), F.lit(DOCUMENT_CODE), 0))


def extract_error_codes(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.upper(c), F.lit(ERROR_CODE), 0))


def needs_rewrite(query: Column, has_history: Column) -> Column:
    q = F.lower(trimmed(query))
    words = F.split(F.regexp_replace(q, r"[^a-z\s]", " "), r"\s+")
    leans = F.arrays_overlap(words, F.array(*map(F.lit, REFERENTIAL))) | q.contains("the same")
    return has_history & ((F.size(F.split(q, r"\s+")) <= 6) | q.rlike("^(?:" + "|".join(STARTERS) + ") ") | leans)


def clean_rewrite(raw: Column, fallback: Column) -> Column:
    c = F.regexp_replace(trimmed(raw), "^[\"'`]|[\"'`]$", "")
    c = trimmed(F.regexp_replace(c, FRAMING, ""))
    return F.when((c == "") | (F.length(c) > 400), fallback).otherwise(c)


def classify_answer(answer: Column, has_context: Column, n_citations: Column, tools: Column) -> Column:
    refused = F.lower(answer).rlike("|".join(REFUSALS))
    return F.when(refused, "INSUFFICIENT_CONTEXT").when(tools, "ANSWERED").when(~has_context | (n_citations == 0), "INSUFFICIENT_CONTEXT").otherwise("ANSWERED")


def used_citations(answer: Column, indices: Column) -> Column:
    """Of the citation numbers, those in brackets in the answer; all of them if none is."""
    named = F.transform(F.regexp_extract_all(answer, F.lit(CITED), 1), lambda x: x.cast("int"))
    used = F.filter(indices, lambda i: F.array_contains(named, i))
    return F.when(F.size(used) == 0, indices).otherwise(used)


def contains_fact(answer: Column, fact: Column) -> Column:
    f, digits = normalize_for_comparison(fact), F.regexp_replace(fact, r"[^\d]", "")
    inside = normalize_for_comparison(answer).contains(f)
    return (f != "") & (inside | ((F.length(digits) >= 2) & F.regexp_replace(answer, r"[^\d]", "").contains(digits)))


def content_type(key: Column) -> Column:
    # fixed values: content types by extension
    kinds = {"pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "txt": "text/plain", "md": "text/markdown", "markdown": "text/markdown"}
    ext = F.lower(F.regexp_extract(key, r"([^.]*)$", 1))
    out = F.lit("application/octet-stream")
    for e, kind in kinds.items():
        out = F.when(ext == e, kind).otherwise(out)
    return out


def key_part(key: Column, part: int) -> Column:
    """1 code, 2 revision (text), 3 file of a storage key; empty if it is none."""
    return F.regexp_extract(key, KEY, part)


def title_from_file(name: Column) -> Column:
    base = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"\.[^.]+$", ""), "[-_]+", " "), r"\s+", " "))
    return F.array_join(F.transform(F.split(base, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def type_from_code(code: Column) -> Column:
    # fixed values: document types by the second segment of a code
    kinds = {"POL": "POLICY", "PROC": "PROCEDURE", "STD": "STANDARD", "GUIDE": "GUIDELINE", "MAN": "MANUAL", "WF": "WORKFLOW", "FAQ": "FAQ"}
    segment = F.upper(F.coalesce(F.get(F.split(code, "-"), 1), F.lit("")))
    out = F.lit("POLICY")
    for s, kind in kinds.items():
        out = F.when(segment == s, kind).otherwise(out)
    return out


def canonical_key(code: Column, revision: Column, name: Column) -> Column:
    safe = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_")
    return F.concat_ws("/", safe(code), F.concat(F.lit("rev-"), F.lpad(revision.cast("string"), 3, "0")), safe(name))


def numeric_value(fact: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(fact, ",", ""), r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over code points below 256 of a text (others by their low byte), as a long."""
    codes = F.transform(F.split(c, ""), lambda x: F.ascii(x))
    step = lambda acc, x: (acc.bitwiseXOR(x.cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), step)
