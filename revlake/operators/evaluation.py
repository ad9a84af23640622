"""Scoring of retrieval and answers against gold questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlake.functions import text as T


def latency_summary(df: DataFrame, value: str, *by: str) -> DataFrame:
    """A6. Nearest-rank p50, p95, p99 and the mean; 0 where there is nothing."""
    cols = [F.coalesce(F.expr(f"percentile_disc({p}) within group (order by {value})"), F.lit(0.0)).alias(f"p{round(p * 100)}") for p in (0.5, 0.95, 0.99)]
    return df.groupBy(*by).agg(*cols, F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"))


def document_ranks(hits: DataFrame) -> DataFrame:
    """W3. Documents (code, revision) of each query in the order of their first hit."""
    own = hits.groupBy("query_id", "document_code", "revision_number").agg(F.min("rank").alias("first"), F.max("is_current").alias("is_current"))
    return own.withColumn("document_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "document_code", "revision_number")))


def evaluate_retrieval(gold: DataFrame, hits: DataFrame, vectors: DataFrame | None = None, allow_non_semantic: bool = False) -> DataFrame:
    """E1, F9, F10, A19. Each question's ranks and flags, and whether the vectors that hits came from have a meaning.

    gold: (query_id, question_type, expected_code, expected_revision, expected_section). vectors: (is_semantic), those
    behind the dense candidates; a single one without meaning is refused unless that is allowed, and then every row says so.

    hits: (query_id, rank, document_code, revision_number, is_current, section_title). One row a question; questions
    without an expected document pass if nothing, or at least three documents, come up in the top five.
    """
    semantic = vectors is None or vectors.filter(~F.coalesce("is_semantic", F.lit(False))).isEmpty()
    if not (semantic or allow_non_semantic):
        raise ValueError("vectors without meaning give no figures of retrieval quality; pass allow_non_semantic=True to see them all the same")
    docs = document_ranks(hits)
    joined = docs.join(gold.select("query_id", "question_type", "expected_code", "expected_revision"), "query_id")
    exact = F.when(F.col("question_type") == "revision", F.col("revision_number") == F.col("expected_revision")).otherwise(F.col("is_current"))
    right = joined.groupBy("query_id").agg(
        F.min(F.when((F.col("document_code") == F.col("expected_code")) & exact, F.col("document_rank"))).alias("hit_rank"),
        F.max(F.when(F.col("document_code") == F.col("expected_code"), exact)).alias("revision_correct"),
        F.count_if(F.col("document_rank") <= 5).alias("top_documents"),
    )
    section = hits.join(gold.select("query_id", "expected_code", "expected_section"), "query_id").filter("document_code = expected_code")
    section = section.groupBy("query_id").agg(F.max(F.lower(F.coalesce("section_title", F.lit(""))).contains(F.lower("expected_section"))).alias("section_hit"))
    rows = gold.join(right, "query_id", "left").join(section, "query_id", "left")
    none = F.col("expected_code").isNull()
    top = F.coalesce("top_documents", F.lit(0))
    refusal = F.when(none, (top == 0) | (top >= 3))
    recall = [F.when(~none, F.coalesce(F.col("hit_rank") <= k, F.lit(False))).alias(f"recall_{k}") for k in (1, 3, 5)]
    return rows.select(
        "query_id", "question_type", "hit_rank", F.when(~none, F.coalesce(1 / F.col("hit_rank"), F.lit(0.0))).alias("reciprocal_rank"), *recall,
        F.when(~none, F.coalesce("section_hit", F.lit(False))).alias("section_hit"), F.when(~none, F.col("revision_correct")).alias("revision_correct"), refusal.alias("refusal_correct"), F.lit(semantic).alias("semantic"),
    )


def ratio(flag: Column) -> Column:
    return F.coalesce(F.avg(flag.cast("double")), F.lit(0.0))


def summarise_retrieval(results: DataFrame, *by: str) -> DataFrame:
    """A7, A8. Counts and metrics, over all questions or by type; 0 where nothing is scored."""
    metrics = [ratio(F.col(f"recall_{k}")).alias(f"recall_{k}") for k in (1, 3, 5)]
    return results.groupBy(*by).agg(
        F.count("*").alias("questions"), F.count("recall_1").alias("answerable"), *metrics, F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)).alias("mrr"),
        ratio(F.col("section_hit")).alias("section_accuracy"), ratio(F.col("revision_correct")).alias("current_accuracy"), ratio(F.col("refusal_correct")).alias("no_answer_accuracy"),
    )


def evaluation_report(results: DataFrame, most: int = 20) -> DataFrame:
    """E4. The first misses, by question."""
    return results.filter("recall_5 = false or refusal_correct = false").orderBy("query_id").limit(most)


def evaluate_answers(gold: DataFrame, answers: DataFrame) -> DataFrame:
    """E2, F17. gold: (query_id, facts, expected_code, expected_revision, old_value); answers: (query_id, answer, status, codes, revisions)."""
    a = F.coalesce("answer", F.lit(""))
    rows = gold.join(answers, "query_id", "left")
    found = F.filter("facts", lambda f: T.contains_fact(a, f))
    pairs = F.arrays_zip("codes", "revisions")
    cited = F.coalesce(F.exists(pairs, lambda p: p["codes"] == F.col("expected_code")), F.lit(False))
    exact = F.coalesce(F.exists(pairs, lambda p: (p["codes"] == F.col("expected_code")) & (p["revisions"] == F.col("expected_revision"))), F.lit(False))
    older = F.coalesce(F.exists(pairs, lambda p: (p["codes"] == F.col("expected_code")) & (p["revisions"] < F.col("expected_revision"))), F.lit(False))
    leaked = F.coalesce(F.col("old_value").isNotNull() & T.contains_fact(a, F.col("old_value")), F.lit(False))
    refused = F.coalesce(F.col("status") != "ANSWERED", F.lit(True))
    none = F.col("expected_code").isNull()
    out = rows.select(
        "query_id", none.alias("no_answer"), F.size("facts").alias("n_facts"), F.size(found).alias("n_found"), cited.alias("cited_document"), exact.alias("cited_revision"), older.alias("cited_older"), leaked.alias("leaked_old"), refused.alias("refused"),
    )
    good = F.when(F.col("no_answer"), F.col("refused")).otherwise(~F.col("refused") & (F.col("n_found") == F.col("n_facts")) & F.col("cited_document") & ~F.col("leaked_old"))
    return out.withColumn("passed", good)


def summarise_answers(results: DataFrame) -> DataFrame:
    """A9."""
    scored = ~F.col("no_answer")
    return results.agg(
        F.count("*").alias("questions"), F.count_if(~F.col("refused")).alias("answered"), F.count_if("refused").alias("refused"),
        F.coalesce(F.avg(F.when(scored & (F.col("n_facts") > 0), F.col("n_found") / F.col("n_facts"))), F.lit(0.0)).alias("fact_recall"),
        ratio(F.when(scored, F.col("cited_document"))).alias("citation_document"), ratio(F.when(scored, F.col("cited_revision"))).alias("citation_revision"),
        ratio(F.when(scored, F.col("cited_older"))).alias("superseded_rate"), ratio(F.when(~scored, F.col("refused"))).alias("no_answer_accuracy"), ratio(F.col("passed")).alias("pass_rate"),
    )


def fact_changes(facts: DataFrame) -> DataFrame:
    """W6. facts: (document_id, revision_number, fact, value). Values that differ from the revision before."""
    before = F.lag("value").over(Window.partitionBy("document_id", "fact").orderBy("revision_number"))
    return facts.withColumn("previous", before).filter("value <> previous").withColumn("change", F.concat_ws(" ", "fact", F.lit("changed from"), "previous", F.lit("to"), "value"))


def build_gold(facts: DataFrame, docs: DataFrame, no_answer: DataFrame, share: float = 0.12) -> DataFrame:
    """E3, U5. facts: (document_id, revision_number, fact, value, rendered); docs: (document_id, document_code, is_active, content_hash).

    A question for each fact of a document's newest revision that has it, if its text shows the value (rendered). Documents that
    are inactive, or repeat the content of one with a smaller id, are left out. Besides, a seeded share of questions without answer.
    """
    newest = facts.groupBy("document_id", "fact").agg(F.max_by("value", "revision_number").alias("expected"), F.max_by("rendered", "revision_number").alias("rendered"), F.max("revision_number").alias("expected_revision"))
    old = fact_changes(facts.select("document_id", "revision_number", "fact", "value")).groupBy("document_id", "fact").agg(F.max_by("previous", "revision_number").alias("old_value"))
    active = docs.filter("is_active").select("document_id", "document_code", "content_hash")
    first = active.groupBy("content_hash").agg(F.min("document_id").alias("document_id"))
    own = active.join(first, ["content_hash", "document_id"], "left_semi").select("document_id", "document_code")
    rows = newest.filter("rendered").join(own, "document_id").join(old, ["document_id", "fact"], "left")
    asked = rows.select(F.concat_ws(":", "document_code", "fact").alias("question"), "document_code", "expected", "expected_revision", "old_value")
    n = max(4, -(-rows.count() * round(share * 100) // 100))  # a scalar, so that the choice is a bounded top-n
    kept = no_answer.orderBy(F.md5("question"), "question").limit(n).select("question")
    return asked.unionByName(kept, allowMissingColumns=True)


def seeded_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """T6. The first n by a seeded hash, with the order itself."""
    return df.withColumn("order", F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))).orderBy("order").limit(n)
