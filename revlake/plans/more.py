"""Queries over listings, counts and candidate rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlake.operators import context as C
from revlake.operators import lifecycle as L
from revlake.operators import retrieval as R
from revlake.sources import adapters as A

from .base import CTE, NEEDS, query
from .context import fitted
from .lifecycle import a1_corpus_counts
from .text import WS


@query("select revision_id, revs.document_id, revision_number, title, department, document_type, is_active from revs join docs using (document_id)", "revs docs")
def j2_revisions_with_document(spark, d):
    return L.revisions_with_document(A.revisions(spark, d).select("revision_id", "document_id", "revision_number"), A.documents(spark, d))


@query("select count(*) filter (status = 'PENDING') as pending, count(*) filter (status = 'READY' and n_chars > 1000) as long_ready, count(*) filter (toxic = 1) as toxic from revs", "revs")
def a3_count_where(spark, d):
    c = F.col
    return L.count_where(A.revisions(spark, d), pending=c("status") == "PENDING", long_ready=(c("status") == "READY") & (c("n_chars") > 1000), toxic=c("toxic") == 1)


@query("select revision_id, count(*) as n_chunks, sum(tokens)::bigint as tokens, max(page) as pages from chunks group by 1", "chunks")
def a14_revision_stats(spark, d):
    return L.revision_stats(A.chunks(spark, d))


@query("select conv_id, max(created_at) as last_at from msgs group by 1 order by last_at desc, conv_id limit 50", "msgs")
def t4_listing(spark, d):
    last = A.messages(spark, d).groupBy("conv_id").agg(F.max("created_at").alias("last_at"))
    return L.listing(last, 50, F.desc("last_at"), "conv_id")


@query(
    """select (select count(*) from docs) as documents, (select count(*) from docs where is_active) as active_documents, (select count(*) from active) as revisions, (select count(*) from active where is_current) as current_revisions,
    (select count(*) from active where status = 'FAILED') as failed_revisions, (select count(*) from chunks) as chunks, (select sum(tokens) from chunks) as tokens, (select max(job_id) from items) as latest_job,
    (select count(*) filter (outcome = 'FAILED') from items where job_id = (select max(job_id) from items)) as latest_failed, (select count(distinct conv_id) from msgs) as conversations, (select count(*) from msgs) as messages""",
    "revs docs active chunks items msgs",
)
def k8_admin_stats(spark, d):
    return L.admin_stats(a1_corpus_counts(spark, d), A.job_items(spark, d), A.messages(spark, d))


@query(
    "select chunk_id, chunks.document_id, chunk_index, section_title, tokens, page, section_role, revision_id, revision_number, is_current, docs.document_code, title, department from chunks join (select revision_id, revision_number, coalesce(is_current, false) as is_current from active) using (revision_id) join docs on docs.document_id = chunks.document_id",
    "revs docs active chunks",
)
def f11_candidate_columns(spark, d):
    return R.candidate_columns(A.chunks(spark, d), L.activate(A.revisions(spark, d)), A.documents(spark, d))


EXCERPT = """case when length(c) <= 320 then c else rtrim(case when instr(left(c, 320), ' ') > 0 and 320 - instr(reverse(left(c, 320)), ' ') > 192 then left(c, (320 - instr(reverse(left(c, 320)), ' '))::int) else left(c, 320) end) || '…' end"""
CTE["cited"] = f"""cited as (select query_id, citation, chunk_id, document_code, revision_number, page, section_title as section, {EXCERPT} as excerpt, round(score, 6) as score
    from (select fits.*, regexp_replace({WS.format("content")}, '\\n+', ' ', 'g') as c from fits) join (select revision_id, document_code, revision_number from active) using (revision_id))"""
NEEDS["cited"] = [*NEEDS["fits"], "fits", "revs", "active"]


@query("select * from cited", "cited")
def j16_build_citations(spark, d):
    return C.build_citations(fitted(spark, d))


@query("select query_id, string_agg(citation || '|' || document_code || '|' || section || '|' || excerpt || '|' || printf('%.6f', score), chr(10) order by citation) as citations from cited group by 1", "cited")
def k11_snapshot_citations(spark, d):
    """What answers keep: the citations as they were shown."""
    own = C.snapshot_citations(C.build_citations(fitted(spark, d)), "query_id")
    line = lambda c: F.concat_ws("|", c["citation"], c["document_code"], c["section"], c["excerpt"], F.format_string("%.6f", c["score"]))
    return own.select("query_id", F.array_join(F.transform("citations", line), "\n").alias("citations"))
