"""Documents, revisions and chunks over their life: store reconciliation, activation, failures, listings and checks."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlake.functions import text as T
from revlake.lineage import cut


def activate(revs: DataFrame) -> DataFrame:
    """W1. Adds is_current and the resulting status: per document the highest successfully processed revision is current."""
    done = F.col("status").isin("READY", "SUPERSEDED")
    best = F.max(F.when(done, F.col("revision_number"))).over(Window.partitionBy("document_id"))
    current = F.coalesce(done & (F.col("revision_number") == best), F.lit(False))
    return revs.withColumn("is_current", current).withColumn("status", F.when(F.col("is_current"), "READY").when(done, "SUPERSEDED").otherwise(F.col("status")))


def parse_storage_key(files: DataFrame, key: str = "key") -> DataFrame:
    """S4. code, revision and file of keys that are well formed; others are dropped."""
    part = functools.partial(T.key_part, F.col(key))
    return files.select("*", part(1).alias("code"), part(2).try_cast("int").alias("revision"), part(3).alias("file_name")).filter("revision >= 1")


def reconcile_store(files: DataFrame, revs: DataFrame) -> DataFrame:
    """S6. files: (key, size, mtime, hash); revs: (key, size, mtime, hash, status). One action a key.

    Unchanged if size and time agree, or else if the hash does; vanished keys are only reported. The hash of a file
    is compared only where size or time differ, so a caller can leave it null elsewhere.
    """
    f, r = files.alias("f"), revs.alias("r")
    same = F.col("f.size").eqNullSafe(F.col("r.size")) & F.col("f.mtime").eqNullSafe(F.col("r.mtime"))
    action = (
        F.when(F.col("r.key").isNull(), "REGISTER")
        .when(F.col("f.key").isNull(), F.when(F.col("r.status") == "FAILED", "IGNORE").otherwise("MISSING"))
        .when(same | F.coalesce(F.col("f.hash") == F.col("r.hash"), F.lit(False)), "UNCHANGED")
        .otherwise("REQUEUE")
    )
    return f.join(r, F.col("f.key") == F.col("r.key"), "full").select(F.coalesce("f.key", "r.key").alias("key"), action.alias("action"))


def upsert(current: DataFrame, incoming: DataFrame, key: str, keep: tuple[str, ...] = ("id", "created_at"), now: Column | None = None) -> DataFrame:
    """S11, Y7. New rows win by business key; the columns in keep stay those of an existing row.

    now: sets updated_at of rows that are new or differ in any other column.
    """
    c, n = current.alias("c"), incoming.alias("n")
    pick = lambda name: F.coalesce(f"c.{name}", f"n.{name}") if name in (key, *keep) else F.when(F.col(f"n.{key}").isNotNull(), F.col(f"n.{name}")).otherwise(F.col(f"c.{name}"))
    names = [x for x in current.columns if now is None or x != "updated_at"]
    columns = [pick(x).alias(x) for x in names]
    if now is not None:
        same = [F.col(f"c.{x}").eqNullSafe(F.col(f"n.{x}")) for x in names if x not in keep]
        kept = F.col(f"n.{key}").isNull() | functools.reduce(Column.__and__, same)
        columns.append(F.when(kept, F.col("c.updated_at") if "updated_at" in current.columns else F.lit(None)).otherwise(now).alias("updated_at"))
    return c.join(n, F.col(f"c.{key}") == F.col(f"n.{key}"), "full").select(*columns)


def replace_revision_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """S13. The chunks of revisions in new are replaced, others untouched."""
    return chunks.join(new.select("revision_id").distinct(), "revision_id", "left_anti").unionByName(new)


def missing_files(revs: DataFrame, files: DataFrame) -> DataFrame:
    """J6, U2. Revisions not failed whose key is not listed."""
    return revs.filter("status <> 'FAILED'").join(files, "key", "left_anti")


def with_status(docs: DataFrame, revs: DataFrame, status: str) -> DataFrame:
    """F4, J5. Documents that have a revision in a status."""
    return docs.join(revs.filter(F.col("status") == status), "document_id", "left_semi")


def search_documents(docs: DataFrame, needle: str, columns: tuple[str, ...] = ("document_code", "title")) -> DataFrame:
    """F3. Case-insensitive substring in any of the columns; % and _ keep their meaning."""
    return docs.filter(functools.reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{needle}%") for c in columns]))


def next_revision(revs: DataFrame) -> DataFrame:
    """A5."""
    return revs.groupBy("document_id").agg((F.coalesce(F.max("revision_number"), F.lit(0)) + 1).alias("next_revision"))


def status_counts(revs: DataFrame) -> DataFrame:
    """A2."""
    return revs.groupBy("status").agg(F.count("*").alias("n"))


def document_summary(docs: DataFrame, revs: DataFrame) -> DataFrame:
    """J3, J4. Documents with their current revision and their counts: one grouped pass over activated revisions."""
    own = revs.groupBy("document_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "PENDING").alias("pending"),
        F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.max(F.when(F.col("is_current"), F.col("revision_number"))).alias("current_revision"),
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "pending", "failed")]
    return docs.join(own, "document_id", "left").select(*docs.columns, *zero, "current_revision")


def current_violations(revs: DataFrame) -> DataFrame:
    """A17. Documents that have not exactly one current revision."""
    return revs.groupBy("document_id").agg(F.count_if("is_current").alias("n_current")).filter("n_current <> 1")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """A18."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def claim_pending(revs: DataFrame, n: int, worker: str, now: Column) -> DataFrame:
    """W9. The oldest n pending revisions, by a bounded top-n, as they are once worker has claimed them."""
    attempts = F.coalesce("attempts", F.lit(0)) if "attempts" in revs.columns else F.lit(0)
    oldest = revs.filter("status = 'PENDING'").orderBy("created_at", "revision_id").limit(n)
    return oldest.withColumns({"status": F.lit("PROCESSING"), "attempts": attempts + 1, "claimed_at": now, "claimed_by": F.lit(worker)})


def unclaimed(rows: DataFrame, when: Column) -> DataFrame:
    """Clears the claim columns that the rows have, where the condition holds."""
    return rows.withColumns({c: F.when(~when, F.col(c)) for c in ("claimed_at", "claimed_by") if c in rows.columns})


def release_stale(revs: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """K3. PROCESSING claims older than the limit become PENDING, without their claim."""
    old = (F.col("status") == "PROCESSING") & (F.col("claimed_at") < now - F.make_dt_interval(mins=F.lit(minutes)))
    rows = revs.withColumn("released", F.coalesce(old, F.lit(False))).withColumn("status", F.when(F.col("released"), "PENDING").otherwise(F.col("status")))
    return unclaimed(rows, F.col("released"))


def fail_abandoned(jobs: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """K3. jobs: (job_id, status, started_at, completed_at, error_summary). RUNNING jobs older than the limit have FAILED."""
    old = F.coalesce((F.col("status") == "RUNNING") & (F.col("started_at") < now - F.make_dt_interval(mins=F.lit(minutes))), F.lit(False))
    summary = F.coalesce("error_summary", F.lit("The job was abandoned: its process ended before it was complete."))
    return jobs.withColumns({"status": F.when(old, "FAILED").otherwise(F.col("status")), "completed_at": F.when(old, now).otherwise(F.col("completed_at")), "error_summary": F.when(old, summary).otherwise(F.col("error_summary"))})


def apply_failures(revs: DataFrame, outcomes: DataFrame, most: int = 4000) -> DataFrame:
    """K2, C15. Failed revisions get their bounded error and lose their claim; predecessors are untouched."""
    bad = outcomes.filter("outcome = 'FAILED'").select("revision_id", F.substring("error", 1, most).alias("error"), F.lit(True).alias("failed"))
    rows = revs.join(bad, "revision_id", "left").withColumn("failed", F.coalesce("failed", F.lit(False)))
    return unclaimed(rows.withColumn("status", F.when(F.col("failed"), "FAILED").otherwise(F.col("status"))), F.col("failed")).drop("failed")


def requeue(revs: DataFrame, ids: DataFrame) -> DataFrame:
    """K4. The named revisions become PENDING, whatever they were."""
    marked = ids.select("revision_id").distinct().withColumn("named", F.lit(True))
    return revs.join(marked, "revision_id", "left").withColumn("status", F.when(F.col("named"), "PENDING").otherwise(F.col("status"))).drop("named")


def set_active(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """K5. changes: (document_id, active)."""
    return docs.join(changes, "document_id", "left").withColumn("is_active", F.coalesce("active", "is_active")).drop("active")


def document_detail(docs: DataFrame, revs: DataFrame) -> DataFrame:
    """K6. Each document with its revisions nested, newest first."""
    own = revs.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("revision_number", "status")), asc=False).alias("revisions"))
    return docs.join(own, "document_id", "left")


def revision_history(revs: DataFrame, summary: str = "summary") -> DataFrame:
    """K12. Number and summary per revision, oldest first."""
    item = F.struct("revision_number", F.coalesce(summary, F.lit("Revised.")).alias("summary"))
    return revs.groupBy("document_id").agg(F.sort_array(F.collect_list(item)).alias("history"))


def revision_preview(elements: DataFrame, pages: int) -> DataFrame:
    """K7. The text of the first pages, and whether there are more."""
    line = F.struct("line_no", "line")
    texts = F.sort_array(F.collect_list(F.when(F.col("page") <= pages, line)))
    return elements.groupBy("revision_id").agg(F.array_join(F.transform(texts, lambda x: x["line"]), "\n").alias("preview"), (F.max("page") > pages).alias("truncated"))


def changed_revisions(revs: DataFrame) -> DataFrame:
    """M3. revs: (..., new_hash, old_hash, n_chunks, status). Whether a revision must be embedded again."""
    same = F.col("new_hash").eqNullSafe(F.col("old_hash")) & (F.coalesce("n_chunks", F.lit(0)) > 0) & (F.col("status") != "FAILED")
    return revs.withColumn("action", F.when(same, "SKIP").otherwise("EMBED"))


def facets(docs: DataFrame, *columns: str) -> DataFrame:
    """A4. Distinct values of each column, without nulls."""
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    return docs.select(pairs).filter("value is not null").distinct()


def corpus_counts(docs: DataFrame, revs: DataFrame, chunks: DataFrame) -> DataFrame:
    """A1. One filtered aggregate a table; three rows of one make one."""
    d = docs.agg(F.count("*").alias("documents"), F.count_if("is_active").alias("active_documents"))
    r = revs.agg(F.count("*").alias("revisions"), F.count_if("is_current").alias("current_revisions"), F.count_if(F.col("status") == "FAILED").alias("failed_revisions"))
    c = chunks.agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"))
    return d.join(r).join(c)


def paginate(df: DataFrame, page: int, size: int, *order: Column | str) -> DataFrame:
    """T2. A page with the totals beside; page 1 at least."""
    page = max(1, page)
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset((page - 1) * size).limit(size)
    return rows.join(total).withColumn("pages", F.ceil(F.col("total") / size)).withColumn("page", F.lit(page))


def safe_order(df: DataFrame, column: str, descending: bool, allowed: dict[str, str], default: str, tie: str) -> DataFrame:
    """T3. Sorts by an allow-listed name, else by the default."""
    c = F.col(allowed.get(column, default))
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), tie)


def validate(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """V1. rules: what must hold, by name. One row a violation; an unknown (null) result is none."""
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


def validate_vectors(df: DataFrame, width: int, vector: str = "embedding") -> DataFrame:
    """V2. Adds whether a vector has the width and only finite components."""
    v = F.col(vector)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.withColumn("is_valid", F.coalesce((F.size(v) == width) & ~odd, F.lit(False)))


def authorised(items: DataFrame, perms: DataFrame, on: str = "document_id") -> DataFrame:
    """F8. perms: (on, effect, level) that apply to the reader. No DENY, and public or an ALLOW that can read."""
    denied = perms.filter("effect = 'DENY'").select(on).distinct()
    allowed = perms.filter("effect = 'ALLOW' and level in ('READ', 'WRITE', 'OWNER')").select(on).distinct().withColumn("may", F.lit(True))
    return items.join(denied, on, "left_anti").join(allowed, on, "left").filter("is_public or may").drop("may")


def effective_principals(members: DataFrame) -> DataFrame:
    """J13, U3. members: (child, parent). All (child, ancestor), cycles included, by joins until nothing is new."""
    edges = cut(members.select("child", "parent").filter("child is not null and parent is not null").distinct())
    known = fresh = edges.select("child", F.col("parent").alias("ancestor"))
    while not fresh.isEmpty():
        step = fresh.join(edges.select(F.col("child").alias("ancestor"), "parent"), "ancestor").select("child", F.col("parent").alias("ancestor")).distinct()
        fresh = cut(step.join(known, ["child", "ancestor"], "left_anti"))
        known = known.unionByName(fresh)
    return known


def revisions_with_document(revs: DataFrame, docs: DataFrame) -> DataFrame:
    """J2. Revisions beside the columns of their document."""
    return revs.join(docs.select("document_id", "title", "department", "document_type", "is_active"), "document_id")


def count_where(df: DataFrame, **conditions: Column) -> DataFrame:
    """A3. One row of filtered counts, by one pass."""
    return df.agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])


def revision_stats(chunks: DataFrame) -> DataFrame:
    """A14. Chunks, tokens and pages of each revision."""
    return chunks.groupBy("revision_id").agg(F.count("*").alias("n_chunks"), F.sum("tokens").alias("tokens"), F.max("page").alias("pages"))


def listing(df: DataFrame, most: int, *order: Column | str) -> DataFrame:
    """T4. The first rows in an order, bounded."""
    return df.orderBy(*order).limit(most)


def admin_stats(corpus: DataFrame, items: DataFrame, messages: DataFrame) -> DataFrame:
    """K8. One row: corpus counts, the latest job with its failures, conversations and messages."""
    job = items.groupBy("job_id").agg(F.count_if(F.col("outcome") == "FAILED").alias("failed_items")).agg(F.max("job_id").alias("latest_job"), F.max_by("failed_items", "job_id").alias("latest_failed"))
    talk = messages.agg(F.count_distinct("conv_id").alias("conversations"), F.count("*").alias("messages"))
    return corpus.join(job).join(talk)
