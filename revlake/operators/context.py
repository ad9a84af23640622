"""From ranked hits to a cited, budgeted context; and the history of a conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlake.config import DEFAULT, Config
from revlake.functions import text as T

#: Tokens that a source's header takes, and the share of words above which a hit says nothing new (fixed values).
HEADER_TOKENS, COVERED = 40, 0.85


def gathered(hits: DataFrame, columns: list[str], order: str = "rank") -> DataFrame:
    """The few hits of each query as one ordered array; what is folded is bounded by the search's own limit."""
    item = F.struct(F.col(order).alias("o_"), *columns)
    return hits.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("hits"))


def dedupe_candidates(hits: DataFrame) -> DataFrame:
    """R9. Drops repeated chunks and hits of whose words 0.85 stand in one kept before. hits: (query_id, rank, chunk_id, content, ...)."""
    kind = "array<struct<chunk_id:bigint,words:array<string>>>"

    def step(kept: Column, h: Column) -> Column:
        covered = F.exists(kept, lambda k: (k["chunk_id"] == h["chunk_id"]) | ((F.size(h["words"]) > 0) & (T.array_containment(h["words"], k["words"]) >= COVERED)))
        return F.when(covered, kept).otherwise(F.concat(kept, F.array(F.struct(h["chunk_id"].cast("long").alias("chunk_id"), h["words"].alias("words")))))

    own = gathered(hits.withColumn("words", T.terms(F.col("content"))), ["chunk_id", "words"])
    kept = own.select("query_id", F.explode(F.aggregate("hits", F.array().cast(kind), step)).alias("k")).select("query_id", F.col("k.chunk_id").alias("chunk_id"))
    first = hits.withColumn("n_", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("rank"))).filter("n_ = 1").drop("n_")
    return first.join(kept, ["query_id", "chunk_id"], "left_semi")


def merge_adjacent(hits: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """R10. Merges neighbours of one revision and section while their tokens fit max(600, budget // 3).

    hits: (query_id, rank, score, revision_id, chunk_index, section_title, tokens, content, chunk_id). Runs come from
    gaps and islands; the limit is folded within a run. The best score and the first chunk's identity stay.
    """
    most = max(600, cfg.token_budget // 3)
    w = Window.partitionBy("query_id", "revision_id").orderBy("chunk_index")
    new = (F.col("chunk_index") != F.lag("chunk_index").over(w) + 1) | ~F.col("section_title").eqNullSafe(F.lag("section_title").over(w))
    rows = hits.withColumn("run", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.struct("chunk_index", "chunk_id", F.col("tokens").cast("long").alias("tokens"), F.col("score").cast("double").alias("score"), "content")
    runs = rows.groupBy("query_id", "revision_id", "run", "section_title").agg(F.sort_array(F.collect_list(item)).alias("items"))
    kind = "array<struct<chunk_index:int,chunk_id:bigint,tokens:bigint,score:double,content:string,first_index:int>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["tokens"] + x["tokens"] <= most)
        own = F.struct(x["chunk_index"].cast("int").alias("chunk_index"), x["chunk_id"].cast("long").alias("chunk_id"), x["tokens"].alias("tokens"), x["score"].alias("score"), x["content"].alias("content"), x["chunk_index"].cast("int").alias("first_index"))
        joined = F.struct(
            x["chunk_index"].cast("int").alias("chunk_index"), last["chunk_id"].alias("chunk_id"), (last["tokens"] + x["tokens"]).alias("tokens"), F.greatest(last["score"], x["score"]).alias("score"),
            F.concat(last["content"], F.lit("\n\n"), x["content"]).alias("content"), last["first_index"].alias("first_index"),
        )
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(own)))

    merged = runs.select("query_id", "revision_id", "section_title", F.explode(F.aggregate("items", F.array().cast(kind), step)).alias("m")).select("query_id", "revision_id", "section_title", "m.*")
    return merged.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "chunk_id")))


def fit_context(hits: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """R11, W8. In rank order, what fits the budget (tokens + 40 each) is taken and numbered; what does not is skipped."""

    def step(acc: Column, h: Column) -> Column:
        cost = h["tokens"].cast("long") + HEADER_TOKENS
        fits = (F.size(acc["taken"]) < cfg.final_k) & (acc["used"] + cost <= cfg.token_budget)
        return F.struct(F.when(fits, acc["used"] + cost).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["taken"], F.array(h["chunk_id"].cast("long")))).otherwise(acc["taken"]).alias("taken"))

    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("taken"))
    own = gathered(hits, ["chunk_id", "tokens"]).select("query_id", F.posexplode(F.aggregate("hits", start, step, lambda a: a["taken"])).alias("p", "chunk_id"))
    return own.select("query_id", "chunk_id", (F.col("p") + 1).alias("citation")).join(hits, ["query_id", "chunk_id"])


def source_header(df: DataFrame) -> Column:
    """R12. The line above a source."""
    pages = F.when(F.col("page_end").isNotNull() & (F.col("page_end") != F.col("page_start")), F.format_string("Pages %d-%d", "page_start", "page_end")).when(F.col("page_start").isNotNull(), F.format_string("Page %d", "page_start"))
    return F.concat_ws(
        " | ",
        F.concat(F.lit("["), "citation", F.lit("] "), "document_code", F.lit(" - "), "title"),
        F.concat(F.lit("Revision "), "revision_number", F.coalesce(F.concat(F.lit(", effective "), F.date_format("effective_date", "yyyy-MM-dd")), F.lit(""))),
        F.concat(F.lit("Section: "), F.coalesce("path", "section_title")),
        pages,
        F.when(F.col("method") == "OCR", "Source text recovered by OCR"),
        F.when(~F.col("is_current"), "SUPERSEDED REVISION"),
    )


def render_context(fitted: DataFrame) -> DataFrame:
    """R12. (query_id, context, n_sources): headers and texts, joined by rules."""
    block = F.struct("citation", F.concat(source_header(fitted), F.lit("\n"), "content").alias("block"))
    own = fitted.groupBy("query_id").agg(F.sort_array(F.collect_list(block)).alias("b"))
    return own.select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n---\n\n").alias("context"), F.size("b").alias("n_sources"))


def build_citations(fitted: DataFrame) -> DataFrame:
    """J16, R13, C14. One row a citation: where it comes from, an excerpt and its score to six decimals."""
    return fitted.select("query_id", "citation", "chunk_id", "document_code", "revision_number", "page", F.col("section_title").alias("section"), T.excerpt(F.col("content")).alias("excerpt"), F.round("score", 6).alias("score"))


def build_prompts(queries: DataFrame, contexts: DataFrame) -> DataFrame:
    """R14. One user prompt a query; without sources it says so."""
    text = F.when(F.col("context").isNull(), F.concat(F.lit("No source was found.\n\nQuestion: "), "query")).otherwise(F.concat(F.lit("<sources>\n"), "context", F.lit("\n</sources>\n\nQuestion: "), "query"))
    return queries.join(contexts, "query_id", "left").select("query_id", text.alias("prompt"))


def recent_turns(messages: DataFrame, turns: int = DEFAULT.history_turns) -> DataFrame:
    """W4. The last 2n user and assistant messages of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.filter("role in ('user', 'assistant')").withColumn("back", F.row_number().over(w)).filter(F.col("back") <= 2 * turns).drop("back")


def bound_history(messages: DataFrame, cap: int, budget: int = DEFAULT.history_tokens) -> DataFrame:
    """W5. From the newest backwards while the running tokens fit; each message counts and keeps at most cap tokens."""
    rows = messages.filter("trim(text) <> ''").withColumn("text", T.truncate_to_tokens(F.col("text"), cap)).withColumn("tokens", T.token_count(F.col("text")))
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum("tokens").over(w)).filter(F.col("running") <= budget)


def conversation_summary(messages: DataFrame) -> DataFrame:
    """A15. Count, last time and title (the first user message, 90 characters)."""
    title = F.min_by(F.when(F.col("role") == "user", F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 90)), F.when(F.col("role") == "user", F.col("turn")))
    return messages.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.max("created_at").alias("last_at"), title.alias("title"))


def merge_metadata(old: Column, new: Column) -> Column:
    """C12. Both maps in one; where a key is in both, the new value holds. A null map is an empty one."""
    empty = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def finalise_messages(messages: DataFrame, answers: DataFrame) -> DataFrame:
    """K9. answers: (conv_id, turn, answer, label, and if given citations and metadata), a row a message.

    The answer, its label and its citations are set; metadata is merged into what the message has.
    """
    own = answers.withColumnsRenamed({"citations": "new_citations", "metadata": "new_metadata"})
    rows = messages.join(own, ["conv_id", "turn"], "left").withColumn("text", F.coalesce("answer", "text")).withColumn("answer_status", F.coalesce("label", F.lit("NONE")))
    if "new_citations" in own.columns:
        before = F.col("citations") if "citations" in messages.columns else F.lit(None)
        rows = rows.withColumn("citations", F.when(F.col("label").isNotNull(), F.col("new_citations")).otherwise(before))
    if "new_metadata" in own.columns:
        before = F.col("metadata") if "metadata" in messages.columns else F.lit(None).cast("map<string,string>")
        rows = rows.withColumn("metadata", merge_metadata(before, F.col("new_metadata")))
    return rows.drop("answer", "label", "new_citations", "new_metadata")


def snapshot_citations(citations: DataFrame, *by: str) -> DataFrame:
    """K11. citations: rows of build_citations. One array of by's citations as they are shown now; readers never join again."""
    shown = [c for c in citations.columns if c not in by and c != "citation"]
    return citations.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("citation", *shown))).alias("citations"))


def delete_conversations(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """K10. Takes the named conversations out of every table."""
    return {name: df.join(ids, "conv_id", "left_anti") for name, df in tables.items()}
