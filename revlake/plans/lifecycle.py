"""Queries over the lifecycle of documents and revisions."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from revlake.functions import text as T
from revlake.lineage import shared_dir
from revlake.operators import lifecycle as L
from revlake.operators import name_index as N
from revlake.operators import pages as P
from revlake.sources import adapters as A
from revlake.sources import log

from .base import ORACLES, query
from .text import WS


def ten_o_clock():
    return F.to_timestamp(F.lit("2024-01-01 10:00:00"))


def shown(df, column):
    """Writes an array of two-field rows as text, which SQL engines compare alike."""
    first, second = df.schema[column].dataType.elementType.names
    return df.withColumn(column, F.array_join(F.transform(column, lambda x: F.concat_ws(":", x[first].cast("string"), x[second])), ","))


@query("select revision_id, document_id, status, is_current from active", "active")
def w1_activate(spark, d):
    return L.activate(A.revisions(spark, d)).select("revision_id", "document_id", "status", "is_current")


def keys(revs):
    return T.canonical_key(F.col("document_code"), F.col("revision_number"), F.concat("source", F.lit(".txt")))


KEYS = "document_code || '/rev-' || lpad(revision_number::varchar, 3, '0') || '/' || source || '.txt'"


@query(f"select revision_id, {KEYS} as key from revs", "revs")
def c19_canonical_key(spark, d):
    revs = A.revisions(spark, d)
    return revs.select("revision_id", keys(revs).alias("key"))


@query(
    f"""with k as (select revision_id, case when revision_id % 7 = 0 then 'loose-' || source || '.txt' when revision_id % 11 = 0 then document_code || '/rev-000/x' else {KEYS} end as key from revs)
    select key, regexp_extract(key, '^([A-Za-z0-9._-]+)/rev-(\\d{{1,4}})/(.+)$', 1) as code, regexp_extract(key, '/rev-(\\d{{1,4}})/', 1)::int as revision,
    regexp_extract(key, '/rev-\\d{{1,4}}/(.+)$', 1) as file_name from k where regexp_matches(key, '^[A-Za-z0-9._-]+/rev-\\d{{1,4}}/.+$') and regexp_extract(key, '/rev-(\\d{{1,4}})/', 1)::int > 0""",
    "revs",
)
def s4_parse_storage_key(spark, d):
    revs = A.revisions(spark, d)
    k = F.when(F.col("revision_id") % 7 == 0, F.concat(F.lit("loose-"), "source", F.lit(".txt"))).when(F.col("revision_id") % 11 == 0, F.concat("document_code", F.lit("/rev-000/x")))
    return L.parse_storage_key(revs.select(F.coalesce(k, keys(revs)).alias("key")))


@query(
    """select revision_id, case revision_id % 4 when 0 then 'application/pdf' when 1 then 'text/plain' when 2 then 'text/markdown' else 'application/octet-stream' end as content_type from revs""",
    "revs",
)
def s3_content_type(spark, d):
    ext = F.element_at(F.array(*map(F.lit, ["a.PDF", "b.txt", "c.md", "d.exe"])), (F.col("revision_id") % 4 + 1).cast("int"))
    return A.revisions(spark, d).select("revision_id", T.content_type(F.concat("document_code", F.lit("/"), ext)).alias("content_type"))


@query(
    """with n as (select p_partkey, string_split(p_name, ' ') as w, p_name from part)
    select p_partkey, array_to_string(list_transform(w, lambda x: upper(x[1]) || x[2:]), ' ') as title,
    case p_partkey % 3 when 0 then 'POLICY' when 1 then 'GUIDELINE' else 'MANUAL' end as document_type from n"""
)
def s5_infer_metadata(spark, d):
    code = F.element_at(F.array(*map(F.lit, ["FIN-POL-1", "IT-guide-2", "HR-MAN-3"])), (F.col("p_partkey") % 3 + 1).cast("int"))
    name = F.concat(F.regexp_replace("p_name", " ", "-"), F.lit(".txt"))
    return A.table(spark, d, "part").select("p_partkey", T.title_from_file(name).alias("title"), T.type_from_code(code).alias("document_type"))


@query(
    f"""with r as (select revision_id, {KEYS} as key, n_chars as size, status from revs where revision_id % 37 <> 0),
    f as (select revision_id, {KEYS} as key, n_chars + (revision_id % 43 = 0)::int as size from revs where revision_id % 41 <> 0)
    select coalesce(f.key, r.key) as key, case when r.key is null then 'REGISTER' when f.key is null then case when r.status = 'FAILED' then 'IGNORE' else 'MISSING' end
    when f.size = r.size then 'UNCHANGED' else 'REQUEUE' end as action from f full join r on f.key = r.key""",
    "revs",
)
def s6_reconcile_store(spark, d):
    revs = A.revisions(spark, d)
    base = revs.select("revision_id", keys(revs).alias("key"), F.col("n_chars").alias("size"), F.lit(0).alias("mtime"), "status")
    files = base.filter("revision_id % 41 <> 0").withColumn("size", F.col("size") + (F.col("revision_id") % 43 == 0).cast("int")).withColumn("hash", F.col("size").cast("string"))
    return L.reconcile_store(files, base.filter("revision_id % 37 <> 0").withColumn("hash", F.col("size").cast("string")))


@query(
    """with c as (select document_code as code, document_id as id, title, department from docs where document_id % 5 <> 0),
    n as (select document_code as code, document_id + 1000000 as id, case when document_id % 2 = 0 then title || ' v2' else title end as title, department from docs where document_id % 3 = 0)
    select coalesce(c.code, n.code) as code, coalesce(c.id, n.id) as id, coalesce(n.title, c.title) as title, case when n.code is not null then n.department else c.department end as department,
    case when n.code is not null and (c.code is null or c.title <> n.title or c.department is distinct from n.department) then timestamp '2024-01-01 10:00:00' end as updated_at from c full join n on c.code = n.code""",
    "revs docs",
)
def s11_upsert(spark, d):
    docs = A.documents(spark, d).select(F.col("document_code").alias("code"), F.col("document_id").alias("id"), "title", "department")
    new = docs.filter("id % 3 = 0").withColumn("title", F.when(F.col("id") % 2 == 0, F.concat("title", F.lit(" v2"))).otherwise(F.col("title"))).withColumn("id", F.col("id") + 1000000)
    return L.upsert(docs.filter("id % 5 <> 0"), new, "code", ("id",), ten_o_clock())


@query("select chunk_id, case when revision_id % 10 = 0 then 0 else tokens end as tokens from chunks where revision_id % 10 <> 0 or chunk_index < 2", "chunks")
def s13_replace_chunks(spark, d):
    chunks = A.chunks(spark, d).select("chunk_id", "revision_id", "chunk_index", "tokens")
    new = chunks.filter("revision_id % 10 = 0 and chunk_index < 2").withColumn("tokens", F.lit(0))
    # revisions that come without chunks lose theirs
    gone = chunks.filter("revision_id % 10 = 0").join(new, "revision_id", "left_anti")
    return L.replace_revision_chunks(chunks, new).join(gone, "chunk_id", "left_anti").select("chunk_id", "tokens")


ORACLES["s13_merge_buckets"] = ORACLES["s13_replace_chunks"]


@query()
def s13_merge_buckets(spark, d):
    """The same replacement in a published table in buckets of revisions: only files of buckets that hold one of them are written anew."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    chunks = A.chunks(spark, d).select("chunk_id", "revision_id", "chunk_index", "tokens")
    log.create_buckets(chunks, path, "revision_id", 32)
    gone = chunks.filter("revision_id % 10 = 0").select("revision_id").distinct()
    new = chunks.filter("revision_id % 10 = 0 and chunk_index < 2").withColumn("tokens", F.lit(0))
    marked = gone.join(new, "revision_id", "left").select(chunks.columns)  # a revision without chunks is one row of nulls
    log.merge_buckets(marked, path, "revision_id", 32, lambda old, now: L.replace_revision_chunks(old, now).filter("chunk_id is not null"))
    return log.read(spark, path).select("chunk_id", "tokens")


ORACLES["s11_merge_buckets"] = ORACLES["s11_upsert"]


@query()
def s11_merge_buckets(spark, d):
    """The same upsert in a published table in buckets of keys."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    docs = A.documents(spark, d).select(F.col("document_code").alias("code"), F.col("document_id").alias("id"), "title", "department")
    new = docs.filter("id % 3 = 0").withColumn("title", F.when(F.col("id") % 2 == 0, F.concat("title", F.lit(" v2"))).otherwise(F.col("title"))).withColumn("id", F.col("id") + 1000000)
    log.create_buckets(docs.filter("id % 5 <> 0").withColumn("updated_at", F.lit(None).cast("timestamp")), path, "code", 16)
    log.merge_buckets(new.withColumn("updated_at", F.lit(None).cast("timestamp")), path, "code", 16, lambda old, now: L.upsert(old, now, "code", ("id",), ten_o_clock()))
    return log.read(spark, path)


@query(f"select revision_id, {KEYS} as key from revs where status <> 'FAILED' and revision_id % 41 = 0", "revs")
def j6_missing_files(spark, d):
    revs = A.revisions(spark, d)
    keyed = revs.select("revision_id", "status", keys(revs).alias("key"))
    return L.missing_files(keyed, keyed.filter("revision_id % 41 <> 0").select("key")).select("revision_id", "key")


@query("select document_id, document_code from docs where exists (select 1 from revs where revs.document_id = docs.document_id and status = 'FAILED')", "revs docs")
def f4_with_status(spark, d):
    return L.with_status(A.documents(spark, d), A.revisions(spark, d), "FAILED").select("document_id", "document_code")


@query("select document_id, document_code from docs where document_code ilike '%aa-00_1%' or title ilike '%aa-00_1%'", "revs docs")
def f3_search_documents(spark, d):
    return L.search_documents(A.documents(spark, d), "aa-00_1").select("document_id", "document_code")


ORACLES["f3_search_index"] = ORACLES["f3_search_documents"]


@query()
def f3_search_index(spark, d):
    """The same search over stored trigrams."""
    index = N.store_names(A.documents(spark, d), f"{shared_dir(spark)}/{uuid.uuid4().hex}", "document_id", ("document_code", "title"))
    return N.search_names(index, "aa-00_1").select("document_id", "document_code")


@query("select document_id, max(revision_number) + 1 as next_revision from revs group by 1", "revs")
def a5_next_revision(spark, d):
    return L.next_revision(A.revisions(spark, d))


@query("select status, count(*) as n from revs group by 1", "revs")
def a2_status_counts(spark, d):
    return L.status_counts(A.revisions(spark, d))


@query(
    """select docs.document_id, document_code, total, pending, failed, current_revision from docs left join (select document_id, count(*) as total, count(*) filter (status = 'PENDING') as pending,
    count(*) filter (status = 'FAILED') as failed, max(revision_number) filter (is_current) as current_revision from active group by 1) a using (document_id)""",
    "revs docs active",
)
def j3_document_summary(spark, d):
    return L.document_summary(A.documents(spark, d).select("document_id", "document_code"), L.activate(A.revisions(spark, d)))


@query("select document_id, count(*) filter (is_current) as n_current from active group by 1 having n_current <> 1", "active")
def a17_current_violations(spark, d):
    return L.current_violations(L.activate(A.revisions(spark, d)))


@query("select lang, source, count(*) as n from revs group by 1, 2 having n > 1", "revs")
def a18_duplicate_keys(spark, d):
    return L.duplicate_keys(A.revisions(spark, d), "lang", "source")


@query("select revision_id, document_id, created_at, 'PROCESSING' as status, (revision_id % 2 + 1)::int as attempts, 'w1' as claimed_by, timestamp '2024-01-01 10:00:00' as claimed_at from revs where status = 'PENDING' order by created_at, revision_id limit 200", "revs")
def w9_claim_pending(spark, d):
    revs = A.revisions(spark, d).withColumn("attempts", (F.col("revision_id") % 2).cast("int"))
    return L.claim_pending(revs, 200, "w1", ten_o_clock()).select("revision_id", "document_id", "created_at", "status", "attempts", "claimed_by", "claimed_at")


@query(
    """select revision_id, coalesce(p and created_at < timestamp '2024-01-01 10:00:00' - interval 30 minute, false) as released,
    case when p and created_at < timestamp '2024-01-01 09:30:00' then 'PENDING' when p then 'PROCESSING' else status end as status,
    case when not (p and created_at < timestamp '2024-01-01 09:30:00') then created_at end as claimed_at from (select *, revision_id % 4 = 0 as p from revs)""",
    "revs",
)
def k3_release_stale(spark, d):
    revs = A.revisions(spark, d).withColumn("claimed_at", F.col("created_at")).withColumn("status", F.when(F.col("revision_id") % 4 == 0, "PROCESSING").otherwise(F.col("status")))
    return L.release_stale(revs, ten_o_clock()).select("revision_id", "released", "status", "claimed_at")


@query(
    """with j as (select job_id, min(ts)::timestamp as started_at, max(ts)::timestamp as last_at, day(job_id) % 3 = 0 as running, count(*) filter (outcome = 'FAILED') as failed from items group by 1), o as (select *, running and started_at < timestamp '2024-01-15' - interval 30 minute as old from j)
    select job_id, case when old then 'FAILED' when running then 'RUNNING' else 'COMPLETED' end as status, case when old then timestamp '2024-01-15' when not running then last_at end as completed_at,
    case when old then case when failed > 100 then 'failed items' else 'The job was abandoned: its process ended before it was complete.' end when failed > 100 then 'failed items' end as error_summary from o""",
    "items",
)
def k3_fail_abandoned(spark, d):
    running = F.day("job_id") % 3 == 0
    jobs = A.job_items(spark, d).groupBy("job_id").agg(F.min("ts").cast("timestamp").alias("started_at"), F.max("ts").cast("timestamp").alias("last_at"), F.count_if(F.col("outcome") == "FAILED").alias("n"))
    jobs = jobs.withColumns({"status": F.when(running, "RUNNING").otherwise("COMPLETED"), "completed_at": F.when(~running, F.col("last_at")), "error_summary": F.when(F.col("n") > 100, "failed items")})
    return L.fail_abandoned(jobs, F.to_timestamp(F.lit("2024-01-15"))).select("job_id", "status", "completed_at", "error_summary")


@query(
    """select revision_id, case when revision_id % 6 = 0 then 'FAILED' else status end as status, case when revision_id % 6 = 0 then left(repeat('error ' || revision_id || ' ', 900), 4000) end as error,
    case when revision_id % 6 <> 0 and status = 'PENDING' then 'w1' end as claimed_by from revs""",
    "revs",
)
def k2_apply_failures(spark, d):
    revs = A.revisions(spark, d).withColumn("claimed_by", F.when(F.col("status") == "PENDING", "w1"))
    bad = revs.select("revision_id", F.when(F.col("revision_id") % 6 == 0, "FAILED").otherwise("PROCESSED").alias("outcome"), F.repeat(F.concat(F.lit("error "), "revision_id", F.lit(" ")), F.lit(900)).alias("error"))
    return L.apply_failures(revs, bad).select("revision_id", "status", "error", "claimed_by")


@query("select revision_id, case when revision_id % 9 = 0 then 'PENDING' else status end as status from revs", "revs")
def k4_requeue(spark, d):
    revs = A.revisions(spark, d)
    return L.requeue(revs, revs.filter("revision_id % 9 = 0")).select("revision_id", "status")


@query("select document_id, case when document_id % 10 = 0 then false else is_active end as is_active from docs", "revs docs")
def k5_set_active(spark, d):
    docs = A.documents(spark, d)
    return L.set_active(docs, docs.filter("document_id % 10 = 0").select("document_id", F.lit(False).alias("active"))).select("document_id", "is_active")


@query("select document_id, document_code, string_agg(revision_number || ':' || status, ',' order by revision_number desc) as revisions from active group by 1, 2", "active")
def k6_document_detail(spark, d):
    revs = L.activate(A.revisions(spark, d))
    return shown(L.document_detail(A.documents(spark, d).select("document_id", "document_code"), revs), "revisions")


@query("select document_id, string_agg(revision_number || ':' || case when lang = 'en' then 'Revised.' else lang end, ',' order by revision_number) as history from revs group by 1", "revs")
def k12_revision_history(spark, d):
    return shown(L.revision_history(A.revisions(spark, d).withColumn("summary", F.when(F.col("lang") != "en", F.col("lang")))), "history")


@query("select revision_id, coalesce(string_agg(line, chr(10) order by line_no) filter (page <= 1), '') as preview, max(page) > 1 as truncated from elements group by 1", "elements")
def k7_revision_preview(spark, d):
    return L.revision_preview(A.elements(spark, d), 1)


@query(
    f"""with h as (select revision_id, status, sha256(lower({WS.format("text")})) as new_hash, lag(sha256(lower({WS.format("text")}))) over (partition by document_id, lang order by revision_number) as before, (select count(*) from chunks c where c.revision_id = revs.revision_id) as n from revs)
    select revision_id, new_hash, case when (case when revision_id % 3 = 0 then new_hash else before end) = new_hash and n > 0 and status <> 'FAILED' then 'SKIP' else 'EMBED' end as action from h""",
    "revs chunks",
)
def m3_changed_revisions(spark, d):
    """What is stored: for every third revision its own hash, for others that of the revision before it in its language."""
    revs = A.revisions(spark, d, text=True).withColumn("new_hash", T.content_hash(F.col("text"))).drop("text")
    before = F.lag("new_hash").over(Window.partitionBy("document_id", "lang").orderBy("revision_number"))
    revs = revs.withColumn("old_hash", F.when(F.col("revision_id") % 3 == 0, F.col("new_hash")).otherwise(before))
    n = A.chunks(spark, d).groupBy("revision_id").agg(F.count("*").alias("n_chunks"))
    return L.changed_revisions(revs.join(n, "revision_id", "left")).select("revision_id", "new_hash", "action")


@query("select distinct 'department' as facet, department as value from docs where department is not null union select distinct 'document_type', document_type from docs", "revs docs")
def a4_facets(spark, d):
    return L.facets(A.documents(spark, d), "department", "document_type")


@query(
    """select (select count(*) from docs) as documents, (select count(*) from docs where is_active) as active_documents, (select count(*) from active) as revisions,
    (select count(*) from active where is_current) as current_revisions, (select count(*) from active where status = 'FAILED') as failed_revisions, (select count(*) from chunks) as chunks, (select sum(tokens) from chunks) as tokens""",
    "revs docs active chunks",
)
def a1_corpus_counts(spark, d):
    return L.corpus_counts(A.documents(spark, d), L.activate(A.revisions(spark, d)), A.chunks(spark, d))


@query("select document_id, document_code, (select count(*) from docs) as total, ceil((select count(*) from docs) / 20)::bigint as pages, 3 as page from docs order by document_code limit 20 offset 40", "revs docs")
def t2_paginate(spark, d):
    return L.paginate(A.documents(spark, d).select("document_id", "document_code"), 3, 20, "document_code")


@query("select chunk_id, tokens, place from (select chunk_id, tokens, row_number() over (order by tokens, chunk_id) - 1 as place from chunks) where place between 400 and 419", "chunks")
def t2_stored_page(spark, d):
    """Page 21 of the chunks by their tokens, from a listing stored in blocks."""
    pages = P.store_pages(A.chunks(spark, d).select("tokens", "chunk_id"), f"{shared_dir(spark)}/{uuid.uuid4().hex}", ("tokens", "chunk_id"))
    return P.page(pages, 21, 20)


@query("select document_id, document_code from docs where document_code < 'DOC-AA-0031' order by document_code desc limit 20", "revs docs")
def t2_page_after(spark, d):
    """The twenty documents before a code, from a listing stored from the last one on."""
    docs = A.documents(spark, d).select("document_code", "document_id")
    pages = P.store_pages(docs, f"{shared_dir(spark)}/{uuid.uuid4().hex}", ("document_code",), descending=True, block_rows=16)
    return P.after(pages, ("DOC-AA-0031",), 20).select("document_id", "document_code")


@query("select document_id, department from docs order by department desc nulls last, document_id limit 30", "revs docs")
def t3_safe_order(spark, d):
    return L.safe_order(A.documents(spark, d).select("document_id", "department"), "dept", True, {"dept": "department", "id": "document_id"}, "document_id", "document_id").limit(30)


@query("select revision_id, unnest(list_filter([case when n_chars > 15000 then 'length' end, case when lang not in ('en', 'de', 'fr') then 'language' end, case when status = 'FAILED' then 'status' end], lambda x: x is not null)) as rule from revs", "revs")
def v1_validate(spark, d):
    rules = {"length": F.col("n_chars") <= 15000, "language": F.col("lang").isin("en", "de", "fr"), "status": F.col("status") != "FAILED"}
    return L.validate(A.revisions(spark, d), rules, "revision_id")


@query("select vec_id, coalesce(len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0, false) as is_valid from embeddings")
def v2_validate_vectors(spark, d):
    return L.validate_vectors(A.table(spark, d, "embeddings"), 64).select("vec_id", "is_valid")


@query("select document_id from docs where document_id % 5 <> 0 and (document_id % 4 = 0 or document_id % 3 = 0)", "revs docs")
def f8_authorised(spark, d):
    docs = A.documents(spark, d).select("document_id", (F.col("document_id") % 4 == 0).alias("is_public"))
    perms = docs.filter("document_id % 5 = 0").select("document_id", F.lit("DENY").alias("effect"), F.lit("READ").alias("level"))
    return L.authorised(docs, perms.union(docs.filter("document_id % 3 = 0").select("document_id", F.lit("ALLOW"), F.lit("WRITE")))).select("document_id")


@query("select 'u' || c_custkey as child, 'n' || c_nationkey as ancestor from customer union select 'u' || c_custkey, 'r' || n_regionkey from customer join nation on n_nationkey = c_nationkey union select 'n' || n_nationkey, 'r' || n_regionkey from nation")
def j13_effective_principals(spark, d):
    name = lambda p, c: F.concat(F.lit(p), F.col(c))
    users = A.table(spark, d, "customer").select(name("u", "c_custkey").alias("child"), name("n", "c_nationkey").alias("parent"))
    return L.effective_principals(users.union(A.table(spark, d, "nation").select(name("n", "n_nationkey"), name("r", "n_regionkey"))))
