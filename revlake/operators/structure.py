"""Documents to lines, elements, sections and chunks.

What depends only on neighbouring rows is a window or an array expression. Where a rule carries state from line to
line (elements, chunk packing), the document's own row holds its array and a small fold runs where that row is.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

from revlake.config import DEFAULT, Config
from revlake.functions import text as T

#: Documents whose blocks are Python objects at once.
FOLDED = 64
ELEMENT = "array<struct<type:string,level:int,text:string,items:array<string>,ordered:boolean,rows:array<array<string>>>>"


def to_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """P1. (key, line_no, line) of the normalised text."""
    clean = T.normalize_whitespace(T.dehyphenate(F.col(text)))
    return docs.select(key, F.posexplode(F.split(clean, "\n")).alias("line_no", "line"))


def classify_lines(text: Column) -> Column:
    """Each line as (line, level, is_list, is_table, cells): the tests that need no state."""
    lines = F.split(text, "\n")
    return F.transform(
        lines,
        lambda x: F.struct(x.alias("line"), T.heading_level(x).alias("level"), T.is_list_item(T.trimmed(x)).alias("list"), T.is_table_row(x).alias("table"), F.when(T.is_column_row(x), T.split_columns(x)).alias("cells")),
    )


# fixed values: patterns of table rules, markers of list items and what continues an item
RULE_CELL, MARKER, ORDERED = ":?-{2,}:?", r"^(?:[-*•·]|\(?\d+[.)]|[a-z][.)])\s+", r"\(?\d+[.)]|[a-z][.)]\s"
GOES_ON = "[a-z(]"


def fold_elements(lines: list) -> list[tuple]:
    """The grouping rules over one document's classified lines."""
    out: list[tuple] = []
    open_ = {"paragraph": [], "list": None, "table": [], "columns": []}

    def close(*kinds: str) -> None:
        for kind in kinds:
            held = open_[kind]
            if kind == "paragraph" and held:
                out.append(("paragraph", None, " ".join(held), None, None, None))
            elif kind == "list" and held and held[1]:
                out.append(("list", None, None, held[1], held[0], None))
            elif kind == "table" and held or kind == "columns" and len(held) > 1:
                out.append(("table", None, None, None, None, held))
            elif kind == "columns" and held:
                out.append(("paragraph", None, " ".join(held[0]), None, None, None))
            open_[kind] = None if kind == "list" else []

    for row in lines:
        line = row["line"].strip()
        if not line:
            close("paragraph", "columns")
        elif row["cells"] is not None and not row["table"]:
            close("paragraph", "list", "table")
            open_["columns"].append(list(row["cells"]))
        elif row["table"]:
            close("columns", "paragraph", "list")
            cells = [c.strip() for c in line[1:-1].split("|")]
            if not all(re.fullmatch(RULE_CELL, c) for c in cells):
                open_["table"].append(cells)
        elif row["level"]:
            close("columns", "table", "paragraph", "list")
            out.append(("heading", int(row["level"]), re.sub(T.MARKED, "", line), None, None, None))
        elif row["list"]:
            close("columns", "table", "paragraph")
            ordered = re.match(ORDERED, line) is not None
            if open_["list"] and open_["list"][0] != ordered:
                close("list")
            open_["list"] = open_["list"] or (ordered, [])
            open_["list"][1].append(re.sub(MARKER, "", line).strip())
        elif open_["list"] and open_["list"][1] and re.match(GOES_ON, line):
            close("columns", "table")
            open_["list"][1][-1] += " " + line
        else:
            close("columns", "table", "list")
            open_["paragraph"].append(line)
    close("columns", "table", "paragraph", "list")
    return out


def build_elements(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """P2, S7, Y3. (key, position, type, level, text, items, ordered, rows): headings, lists, tables and paragraphs.

    The line tests are expressions; only the fold is Python, on the document's own row.
    """

    @F.pandas_udf(ELEMENT)
    def fold(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: fold_elements(x) if x is not None else None)

    own = docs.select(key, F.posexplode(fold(classify_lines(F.coalesce(F.col(text), F.lit("")))))).withColumnRenamed("pos", "position")
    return own.select(key, "position", "col.*")


def text_guards(docs: DataFrame, text: str = "text") -> DataFrame:
    """S7, K1. Adds the error of texts that are empty or below 0.85 printable, else null."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("error", F.when(T.trimmed(t) == "", "EMPTY").when(T.printable_ratio(t) < 0.85, "NOT_PRINTABLE"))


class _Elements(HTMLParser):
    """Headings, paragraphs, lists and tables of a page; a container inside another adds its text to that one."""

    HOLDERS = {*(f"h{n}" for n in range(1, 7)), "p", "li", "td", "th"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple] = []
        self.open: list[tuple[str, list[str]]] = []
        self.lists: list[tuple[bool, list[str]]] = []
        self.tables: list[list[list[str]]] = []
        self.row: list[str] | None = None

    def add(self, kind: str, level: int | None = None, text: str | None = None, items: list | None = None, ordered: bool | None = None, rows: list | None = None) -> None:
        self.found.append((kind, level, text, items, ordered, rows))

    def shut(self) -> None:
        """Closes the innermost container and hands its text on."""
        tag, parts = self.open.pop()
        text = re.sub(r"\s+", " ", "".join(parts)).strip()
        if self.open:
            self.open[-1][1].append(f" {text}" if text else "")
        elif tag in ("td", "th"):
            if self.row is not None:
                self.row.append(text)
        elif text and tag == "li" and self.lists:
            self.lists[-1][1].append(text)
        elif text:
            self.add("heading" if tag[0] == "h" else "paragraph", int(tag[1]) if tag[0] == "h" else None, f"- {text}" if tag == "li" else text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.HOLDERS:
            self.open.append((tag, []))
        elif tag == "br" and self.open:
            self.open[-1][1].append(" ")
        elif tag in ("ul", "ol"):
            self.lists.append((tag == "ol", []))
        elif tag == "table":
            self.tables.append([])
        elif tag == "tr":
            self.row = []

    def handle_endtag(self, tag: str) -> None:
        if tag in self.HOLDERS and any(t == tag for t, _ in self.open):
            while self.open[-1][0] != tag:  # what was left open inside
                self.shut()
            self.shut()
        elif tag in ("ul", "ol") and self.lists:
            ordered, items = self.lists.pop()
            if items:
                self.add("list", items=items, ordered=ordered)
        elif tag == "table" and self.tables:
            rows = self.tables.pop()
            if rows:
                self.add("table", rows=rows)
        elif tag == "tr":
            if self.tables and self.row:
                self.tables[-1].append(self.row)
            self.row = None

    def handle_data(self, data: str) -> None:
        if self.open and self.cdata_elem is None:
            self.open[-1][1].append(data)

    def close(self) -> None:
        super().close()
        while self.open:
            self.shut()


def parse_html(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """S8. The elements of each page: (key, position, type, level, text, items, ordered, rows), as of build_elements.

    Text outside of headings, paragraphs, list items and cells is not content. Null html has no elements.
    """
    kind = "array<struct<type:string,level:int,text:string,items:array<string>,ordered:boolean,rows:array<array<string>>>>"

    @F.pandas_udf(kind)
    def parse(texts: pd.Series) -> pd.Series:
        out = []
        for page in texts:
            p = _Elements()
            p.feed(page or "")
            p.close()
            out.append(p.found)
        return pd.Series(out, dtype=object)

    return pages.select(key, F.posexplode(parse(html)).alias("position", "e")).select(key, "position", "e.*")


def reconstruct_lines(glyphs: DataFrame, *by: str) -> DataFrame:
    """P5. glyphs: (by..., x, y, width, height, text). Runs whose baselines lie within max(2, height / 2) are a line."""
    down = Window.partitionBy(*by).orderBy(F.desc("y"), "x")
    gap = F.lag("y").over(down) - F.col("y")
    new = F.when(gap.isNull() | (gap > F.greatest(F.lit(2.0), F.col("height") / 2)), 1).otherwise(0)
    rows = glyphs.withColumn("new_", new).withColumn("line", F.sum("new_").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    runs = F.array_sort(F.collect_list(F.struct("x", "width", "height", "text")))
    start = F.struct(F.lit(None).cast("double").alias("end"), F.lit("").alias("out"))

    def join(acc: Column, r: Column) -> Column:
        wide = (r["x"] - acc["end"]) > 1.5 * r["height"]
        return F.struct((r["x"] + r["width"]).cast("double").alias("end"), F.when(acc["end"].isNull(), r["text"]).otherwise(F.concat(acc["out"], F.when(wide, "    ").otherwise(" "), r["text"])).alias("out"))

    return rows.groupBy(*by, "line").agg(runs.alias("runs"), F.max("height").alias("height")).select(*by, "line", "height", F.aggregate("runs", start, join, lambda a: a["out"]).alias("text"))


def mark_headings(lines: DataFrame, by: str, size: str = "height", text: str = "text") -> DataFrame:
    """P6. Adds level: lines at 1.22 or 1.06 times the body size (the quarter-point bucket with most text); never over 90 characters."""
    bucket = F.round(F.col(size) * 4) / 4
    weights = lines.filter(F.col(size) > 0).groupBy(by, bucket.alias("bucket")).agg(F.sum(F.length(text)).alias("n"))
    body = weights.groupBy(by).agg(F.max_by("bucket", F.struct("n", -F.col("bucket"))).alias("body"))
    level = F.when((F.length(text) > 90) | (F.col(size) <= 0), 0).when(F.col(size) >= 1.22 * F.col("body"), 1).when(F.col(size) >= 1.06 * F.col("body"), 2).otherwise(0)
    return lines.join(body, by, "left").withColumn("level", F.coalesce(level, F.lit(0)))


def strip_running_lines(lines: DataFrame, doc: str = "revision_id", page: str = "page", pos: str = "line_no", text: str = "line") -> DataFrame:
    """P7. Drops first and last two lines of pages that, digits aside, stand on 60% of the document's pages (of two: both)."""
    w = Window.partitionBy(doc, page)
    rows = lines.withColumn("first_", F.row_number().over(w.orderBy(pos))).withColumn("last_", F.row_number().over(w.orderBy(F.desc(pos))))
    rows = rows.withColumn("edge_", (F.col("first_") <= 2) | (F.col("last_") <= 2)).withColumn("key_", F.regexp_replace(F.trim(text), r"\d+", "#"))
    pages = lines.groupBy(doc).agg(F.count_distinct(page).alias("pages_"))
    keys = rows.filter("edge_ and key_ <> ''").groupBy(doc, "key_").agg(F.count_distinct(page).alias("n_")).join(pages, doc)
    running = keys.filter("pages_ > 1 and n_ >= case when pages_ = 2 then 2 else ceil(0.6 * pages_) end").select(doc, "key_", F.lit(True).alias("runs_"))
    return rows.join(running, [doc, "key_"], "left").filter("not (edge_ and coalesce(runs_, false))").select(*lines.columns)


def flag_sparse_pages(pages: DataFrame, text: str = "text", area: float = 595.0 * 842.0, cfg: Config = DEFAULT) -> DataFrame:
    """P8. Adds needs_ocr: under 180 characters that are no blanks, or too few for the area."""
    n = F.length(F.regexp_replace(F.col(text), r"\s+", ""))
    return pages.withColumn("needs_ocr", (n < cfg.ocr_min_chars) | (n / area < cfg.ocr_min_density))


def rollup_method(pages: DataFrame, key: str, method: str = "method") -> DataFrame:
    """P9."""
    kinds = F.collect_set(method)
    return pages.groupBy(key).agg(F.when(F.size(kinds) == 0, "NATIVE_TEXT").when(F.size(kinds) == 1, F.element_at(kinds, 1)).otherwise("MIXED").alias("method"))


def elements_to_text(elements: DataFrame, key: str) -> DataFrame:
    """P10. elements as of build_elements; (key, text), tables as pipe rows."""
    bar = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    head = F.element_at("rows", 1)
    table = F.array_join(F.concat(F.array(bar(head), bar(F.transform(head, lambda _: F.lit("---")))), F.transform(F.slice("rows", 2, 1 << 30), bar)), "\n")
    items = F.array_join(F.transform("items", lambda x, i: F.concat(F.when(F.col("ordered"), F.concat((i + 1).cast("string"), F.lit(". "))).otherwise("- "), x)), "\n")
    shown = F.when(F.col("type") == "table", table).when(F.col("type") == "list", items).otherwise(F.col("text"))
    own = elements.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("position", shown.alias("shown")))).alias("all"))
    return own.select(key, F.array_join(F.transform("all", lambda x: x["shown"]), "\n\n").alias("text"))


def assign_sections(elements: DataFrame, key: str = "revision_id", pos: str = "line_no", text: str = "line") -> DataFrame:
    """P11. Adds section, subsection and heading path that hold at each element."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    opens = (F.col("type") == "heading") & (F.col("level") <= 2)
    rows = elements.withColumn("section", F.last(F.when(opens, F.col(text)), ignorenulls=True).over(w)).withColumn("group_", F.sum(opens.cast("int")).over(w))
    inner = Window.partitionBy(key, "group_").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    deeper = (F.col("type") == "heading") & (F.col("level") > 2)
    rows = rows.withColumn("subsection", F.last(F.when(deeper, F.col(text)), ignorenulls=True).over(inner))
    return rows.withColumn("path", F.concat_ws(" > ", "section", "subsection")).drop("group_")


def with_embedding_text(chunks: DataFrame) -> DataFrame:
    """P16. Headers that exist, then the body."""
    return chunks.withColumn("embedding_text", F.concat_ws("\n", "title", "department", "section", "subsection", "content"))


def dedupe_chunks(chunks: DataFrame, index: str = "chunk_index") -> DataFrame:
    """P17. The first of equal chunks (type and content hash) of a revision."""
    w = Window.partitionBy("revision_id", "chunk_type", "content_hash").orderBy(index)
    return chunks.withColumn("n_", F.row_number().over(w)).filter("n_ = 1").drop("n_")


def append_figures(elements: DataFrame, figures: DataFrame) -> DataFrame:
    """P18. Figure texts become paragraphs at the end of their page."""
    last = elements.groupBy("revision_id", "page").agg(F.max("line_no").alias("after"))
    own = figures.join(last, ["revision_id", "page"]).select("revision_id", "page", (F.col("after") + F.col("figure_no") / 1000.0).alias("line_no"), F.concat(F.lit("[Figure] "), "text").alias("line"), F.lit("paragraph").alias("type"))
    return elements.select("revision_id", "page", F.col("line_no").cast("double").alias("line_no"), "line", "type").unionByName(own)


def overlap_tail(text: Column, budget: int) -> Column:
    """P15. The last sentences whose tokens fit the budget together."""
    sentences = F.reverse(F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != ""))
    start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        n = T.token_count(s)
        full = acc["full"] | (acc["used"] + n > budget)
        return F.struct(F.when(full, acc["used"]).otherwise(acc["used"] + n).alias("used"), full.alias("full"), F.when(full, acc["out"]).otherwise(F.concat(F.array(s), acc["out"])).alias("out"))

    return F.array_join(F.aggregate(sentences, start, step, lambda a: a["out"]), " ")


def tokens_of(text: str) -> int:
    return math.ceil(len(text) / 3.8)


def split_block(kind: str, text: str, cfg: Config) -> list[str]:
    """P14. An oversize block in parts: tables repeat their two head rows, lists split between items, prose at separators."""
    if tokens_of(text) <= cfg.chunk_max:
        return [text]
    if kind in ("table", "list"):
        lines = text.split("\n")
        head = lines[:2] if kind == "table" else []
        out, now = [], list(head)
        for line in lines[len(head) :]:
            if len(now) > len(head) and tokens_of("\n".join([*now, line])) > cfg.chunk_target:
                out.append("\n".join(now))
                now = list(head)
            now.append(line)
        return [*out, "\n".join(now)]
    most, out, now = cfg.chunk_target * 3, [], ""
    for part in re.split(r"(?<=\n\n)|(?<=[.!?]\s)", text):
        while len(part) > most:
            cut = part.rfind(" ", 0, most)
            cut = cut + 1 if cut > 0 else most
            out += [now] if now else []
            out, now, part = [*out, part[:cut]], "", part[cut:]
        if now and len(now) + len(part) > most:
            out.append(now)
            now = ""
        now += part
    return [x.strip() for x in [*out, now] if x.strip()]


def tail_of(text: str, budget: int) -> str:
    """P15 for one text: its last sentences that fit the budget together."""
    kept: list[str] = []
    for sentence in reversed(re.split(r"(?<=[.!?])\s+", text)):
        if tokens_of(sentence) > budget:
            break
        budget -= tokens_of(sentence)
        kept.insert(0, sentence)
    return " ".join(kept)


@dataclass
class Part:
    """A stretch of blocks under one heading."""

    section: str | None
    subsection: str | None
    role: str
    blocks: list

    @property
    def text(self) -> str:
        return "\n\n".join(b["text"] for b in self.blocks)

    @property
    def path(self) -> str | None:
        return " > ".join(x for x in (self.section, self.subsection) if x) or None

    def row(self, kind: str, text: str, pages: list, parent: int | None = None, path: str | None = None) -> dict:
        return {"chunk_type": kind, "section": self.section, "subsection": self.subsection, "path": path or self.path, "role": self.role, "content": text, "tokens": tokens_of(text), "page_start": min(pages), "page_end": max(pages), "parent_index": parent}


def pack_small(parts: list[Part]) -> list[dict]:
    """Small parts in one chunk; of several, each title stands above its text and the path names all."""
    if not parts:
        return []
    pages = [b["page"] for p in parts for b in p.blocks]
    if len(parts) == 1:
        return [parts[0].row("CHILD", parts[0].text, pages)]
    titled = "\n\n".join(f"{p.section}\n{p.text}" if p.section else p.text for p in parts)
    return [{**parts[0].row("CHILD", titled, pages, path=" | ".join(p.section for p in parts if p.section)), "subsection": None}]


def pack_large(part: Part, at: int, last: dict | None, cfg: Config) -> list[dict]:
    """A larger part: its parent if it is over the target, then its blocks packed to the target; at: the next chunk's number."""
    out: list[dict] = []
    parent = None
    if tokens_of(part.text) > cfg.chunk_target:
        parent = at
        out.append(part.row("PARENT", part.text[: int(cfg.parent_max * 3.8)], [b["page"] for b in part.blocks]))
    groups: list[list[tuple[str, int]]] = [[]]
    size = 0
    for b in part.blocks:
        for text in split_block(b["kind"], b["text"], cfg):
            n, whole = tokens_of(text), b["kind"] in ("table", "list")  # these may go over the target rather than be torn
            if groups[-1] and size + n > (cfg.chunk_max if whole else cfg.chunk_target):
                groups.append([])
                size = 0
            groups[-1].append((text, b["page"]))
            size += n
    before = ""
    for k, group in enumerate(groups):
        body, pages = "\n\n".join(t for t, _ in group), [p for _, p in group]
        n = sum(tokens_of(t) for t, _ in group)
        last = out[-1] if out else last
        # what little is left at the end goes to the chunk before it, if that is of this section
        if k == len(groups) - 1 and n < cfg.chunk_min and last and last["chunk_type"] == "CHILD" and last["section"] == part.section and last["tokens"] + n <= cfg.chunk_max:
            last["content"] += "\n\n" + body
            last["tokens"], last["page_end"] = tokens_of(last["content"]), max(last["page_end"], *pages)
            break
        tail = tail_of(before, cfg.chunk_overlap) if before else ""
        out.append(part.row("CHILD", f"{tail}\n\n{body}" if tail else body, pages, parent))
        before = body
    return out


def pack(blocks: list, cfg: Config) -> list[dict]:
    """P13 for one document. blocks: (section, subsection, role, kind, text, page) in order.

    Sections of at most the least size are packed together while they have one role and fit the target; they never
    join a larger section, which is packed by itself.
    """
    parts = [Part(*head, list(own)) for head, own in itertools.groupby(blocks, key=lambda b: (b["section"], b["subsection"], b["role"]))]
    out: list[dict] = []
    small: list[Part] = []
    waiting = 0
    for part in parts:
        n = tokens_of(part.text)
        if not part.text.strip():
            continue
        if n > cfg.chunk_min or (small and (small[0].role != part.role or waiting + n > cfg.chunk_target)):
            out += pack_small(small)
            small, waiting = [], 0
        if n > cfg.chunk_min:
            out += pack_large(part, len(out), out[-1] if out else None, cfg)
        else:
            small.append(part)
            waiting += n
    return out + pack_small(small)


def chunk(elements: DataFrame, cfg: Config = DEFAULT, key: str = "revision_id", chunker: Callable[[list[dict], Config], list[dict]] = pack) -> DataFrame:
    """P13, Y4. elements: (key, position, section, subsection, role, kind, text, page). Structure-aware chunks and their parents.

    Gives (key, chunk_index, chunk_type, section, subsection, path, role, content, tokens, page_start, page_end,
    parent_index). The blocks of a document are gathered into its own row; the fold needs no other document. chunker: a
    user's own function of a document's blocks, in order, which gives its chunks as dicts of these columns.
    """
    kind = "array<struct<chunk_type:string,section:string,subsection:string,path:string,role:string,content:string,tokens:int,page_start:int,page_end:int,parent_index:int>>"

    out = to_arrow_type(DataType.fromDDL(kind))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), FOLDED):  # only so many documents are Python objects at once
                some = batch.slice(a, FOLDED)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([chunker(b, cfg) for b in some.column(1).to_pylist()], out)], [key, "chunks"])

    block = F.struct("position", "section", "subsection", "role", "kind", "text", "page")
    own = elements.groupBy(key).agg(F.sort_array(F.collect_list(block)).alias("blocks"))
    own = own.mapInArrow(fold, StructType([own.schema[key], StructField("chunks", DataType.fromDDL(kind))]))
    return own.select(key, F.posexplode("chunks")).select(key, F.col("pos").alias("chunk_index"), "col.*")
