"""Queries over leave records and ingestion jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlake.functions import dates as D
from revlake.functions import text as T
from revlake.operators import jobs as J
from revlake.operators import leave as V
from revlake.sources import adapters as A

from .base import CTE, NEEDS, query
from .retrieval import TERMS

AS_OF = "1998-06-30"
CTE["types"] = """types(leave_type, fixed_days, uses_balance, allows_past, documents_after, eligible) as (values ('ANNUAL', null, true, false, null, ['PERMANENT', 'FIXED_TERM']), ('SICK', 10, true, true, 3, ['PERMANENT', 'FIXED_TERM', 'INTERN']),
    ('UNPAID', 0, false, false, null, ['PERMANENT', 'FIXED_TERM', 'CONTRACTOR', 'INTERN']), ('PARENTAL', 20, true, false, null, ['PERMANENT']), ('COMPASSIONATE', 5, true, true, null, ['PERMANENT', 'FIXED_TERM']), ('STUDY', 5, true, false, null, ['PERMANENT']))"""
CTE["days"] = """days as (select *, case when not list_contains(working_days, isodow(date)) then 'WEEKEND' when strftime(date, '%m-%d') in ('01-01', '05-01', '12-25', '12-26') then 'PUBLIC_HOLIDAY' else 'WORKING' end as reason
    from (select request_id, employee_id, working_days, unnest(generate_series(start_date, end_date, interval 1 day))::date as date from reqs join emps using (employee_id)))"""
CTE["rdays"] = """rdays as (select r.*, n_working, floor((n_working - 0.5 * case when n_working = 0 then 0 when n_working = 1 then (start_portion <> 'FULL_DAY')::int else (start_portion <> 'FULL_DAY')::int end) * 2 + 0.5) / 2 as requested_days
    from reqs r join (select request_id, count(*) filter (reason = 'WORKING') as n_working from days group by 1) using (request_id))"""
CTE["ents"] = """ents as (select employee_id, title, working_days, leave_type, uses_balance, coalesce(fixed_days::double, case when len(working_days) >= 5 then base else floor(base * len(working_days) / 5 * 2 + 0.5) / 2 end) as entitlement
    from (select *, case when regexp_matches(title, '(?i)head|director|chief|lead|principal|manager') then 31 else 20 end::double as base from emps) join types on list_contains(eligible, employment_type))"""
CTE["bals"] = f"""bals as (select employee_id, leave_type, entitlement, floor(entitlement * 181 / 365 * 2 + 0.5) / 2 as accrued, coalesce(taken, 0) as taken, coalesce(scheduled, 0) as scheduled, coalesce(pending, 0) as pending,
    case when uses_balance then floor((entitlement - coalesce(taken, 0) - coalesce(scheduled, 0) - coalesce(pending, 0)) * 2 + 0.5) / 2 else 0 end as available from ents left join (select employee_id, leave_type,
    sum(case when status = 'APPROVED' and end_date < date '{AS_OF}' then requested_days else 0 end) as taken, sum(case when status = 'APPROVED' and end_date >= date '{AS_OF}' then requested_days else 0 end) as scheduled,
    sum(case when status <> 'APPROVED' then requested_days else 0 end) as pending from rdays where year(start_date) = 1998 and status in ('SUBMITTED', 'PENDING_APPROVAL', 'APPROVED') group by 1, 2) using (employee_id, leave_type))"""
NEEDS |= {"days": ["emps", "reqs"], "rdays": ["emps", "reqs", "days"], "ents": ["emps", "types"], "bals": ["emps", "reqs", "types", "days", "rdays", "ents"]}


def as_of():
    return F.to_date(F.lit(AS_OF))


def counted(spark, d):
    """Requests with their days."""
    people = A.employees(spark, d).select("employee_id", "working_days")
    return V.request_days(A.requests(spark, d).join(people, "employee_id")).drop("working_days")


@query("select employee_id, leave_type, entitlement from ents", "ents")
def l1_entitlements(spark, d):
    return V.entitlements(A.employees(spark, d), V.leave_types(spark)).select("employee_id", "leave_type", "entitlement")


@query("select * from bals", "bals")
def l2_balances(spark, d):
    return V.balances(A.employees(spark, d), counted(spark, d), V.leave_types(spark), as_of()).select("employee_id", "leave_type", "entitlement", "accrued", "taken", "scheduled", "pending", "available")


@query("select request_id, date, reason from days", "days")
def l3_working_days(spark, d):
    rows = A.requests(spark, d).join(A.employees(spark, d).select("employee_id", "working_days"), "employee_id")
    return V.working_days(rows).select("request_id", "date", "reason")


@query("select request_id, n_working::int as n_working, requested_days from rdays", "rdays")
def l4_request_days(spark, d):
    return counted(spark, d).select("request_id", "n_working", "requested_days")


CTE["valids"] = f"""valids as (select r.request_id, r.requested_days, case when r.end_date < r.start_date then ['INVALID_DATE_RANGE'] else list_filter([case when not is_active then 'EMPLOYEE_INACTIVE' end, case when n_working = 0 then 'NO_WORKING_DAYS' end,
    case when not list_contains(eligible, employment_type) then 'LEAVE_TYPE_NOT_ELIGIBLE' end, case when r.leave_type = 'ANNUAL' and r.start_date <= probation_end then 'PROBATION_RESTRICTION' end,
    case when r.start_date < date '{AS_OF}' and not allows_past then 'DATE_IN_PAST' end, case when r.start_date - date '{AS_OF}' > 400 then 'TOO_FAR_IN_FUTURE' end,
    case when n_working > 0 and not allows_past and r.start_date >= date '{AS_OF}' and r.start_date - date '{AS_OF}' < case when requested_days <= 5 then 8 else 31 end then 'INSUFFICIENT_NOTICE' end,
    case when requested_days > 10 then 'EXCEEDS_MAX_CONSECUTIVE' end, case when exists (select 1 from reqs o where o.employee_id = r.employee_id and o.request_id <> r.request_id and o.status in ('SUBMITTED', 'PENDING_APPROVAL', 'APPROVED')
    and r.start_date <= o.end_date and o.start_date <= r.end_date) then 'OVERLAPPING_REQUEST' end, case when t.uses_balance and requested_days > coalesce(available, 0) then 'INSUFFICIENT_BALANCE' end,
    case when requested_days > documents_after then 'DOCUMENTATION_REQUIRED' end], lambda x: x is not null) end as violations, coalesce(available, 0) as available
    from rdays r join emps using (employee_id) join types t on t.leave_type = r.leave_type left join bals b on b.employee_id = r.employee_id and b.leave_type = r.leave_type where r.request_id % 3 = 0)"""
NEEDS["valids"] = [*NEEDS["bals"], "bals"]


def validated(spark, d):
    """One third of the requests taken as candidates against all of them."""
    existing = counted(spark, d)
    candidates = A.requests(spark, d).filter("request_id % 3 = 0").drop("status")
    return V.validate_requests(candidates, A.employees(spark, d), existing, V.leave_types(spark), as_of())


@query("select request_id, requested_days, array_to_string(violations, ',') as violations, len(list_filter(violations, lambda v: v <> 'DOCUMENTATION_REQUIRED')) = 0 as valid from valids", "valids")
def l5_validate_requests(spark, d):
    return validated(spark, d).select("request_id", "requested_days", F.array_join("violations", ",").alias("violations"), "valid")


@query(
    """select request_id, case when len(list_filter(violations, lambda v: v <> 'DOCUMENTATION_REQUIRED')) = 0 then 'valid' else 'not valid' end || '; ' || printf('%.1f day(s), %.1f available before', requested_days, available)
    || case when len(violations) > 0 then '; ' || array_to_string(violations, ', ') else '' end as said from valids""",
    "valids",
)
def f18_describe_validation(spark, d):
    rows = validated(spark, d)
    return rows.select("request_id", V.describe_validation(rows).alias("said"))


@query("select make_date(y, m, dd) as date, name as holiday from (select distinct year(o_orderdate) as y from orders) cross join (values (1, 1, 'New Year''s Day'), (5, 1, 'Labour Day'), (12, 25, 'Christmas Day'), (12, 26, 'Boxing Day')) h(m, dd, name)")
def l6_holidays(spark, d):
    return V.holidays(A.table(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct())


@query(
    """with recursive c as (select request_id, employee_id, leave_type, start_date, end_date, requested_days, first_value(request_id) over (partition by employee_id, leave_type, start_date order by request_id) as original_id from rdays where status in ('APPROVED', 'PENDING_APPROVAL')),
    o as materialized (select c.*, coalesce(case when uses_balance then floor(entitlement * 2 + 0.5) / 2 else 0 end, 0) as have, row_number() over (partition by employee_id order by request_id) as i from c left join ents using (employee_id, leave_type) where original_id = request_id),
    f as (select distinct employee_id, 0::bigint as i, null::bigint as request_id, false as ok, []::struct(s date, e date, t varchar, d double)[] as taken from o union all
    select employee_id, i, request_id, ok, case when ok then list_append(taken, {'s': start_date, 'e': end_date, 't': leave_type, 'd': requested_days::double}) else taken end from (select o.*, taken,
    len(list_filter(taken, lambda x: start_date <= x.e and x.s <= end_date)) = 0 and requested_days <= have - coalesce(list_sum(list_transform(list_filter(taken, lambda x: x.t = leave_type), lambda x: x.d)), 0) as ok
    from f join o on o.employee_id = f.employee_id and o.i = f.i + 1))
    select c.request_id, c.employee_id, original_id as result_id, case when not ok then 'REJECTED' when leave_type = 'SICK' then 'APPROVED' else 'PENDING_APPROVAL' end as status from c join f on f.request_id = original_id""",
    "emps reqs types days rdays ents",
)
def l7_apply_requests(spark, d):
    rows = counted(spark, d).filter("status in ('APPROVED', 'PENDING_APPROVAL')")
    own = rows.select("request_id", "employee_id", "leave_type", F.col("request_id").alias("seq"), F.concat_ws("-", "leave_type", "start_date").alias("idempotency_key"), "start_date", "end_date", "requested_days", (F.col("leave_type") != "SICK").alias("needs_approval"))
    have = V.balances(A.employees(spark, d), rows.limit(0), V.leave_types(spark), as_of()).select("employee_id", "leave_type", "available")
    return V.apply_requests(own, have)


CTE["levents"] = """levents as (select request_id, e.seq, ['withdraw', 'approve', 'reject', 'cancel'][(request_id + e.seq) % 4 + 1] as event, case when request_id % 11 = 0 then employee_id else -1 end as actor_id, start_date + e.seq::int as day from reqs cross join (values (1), (2), (3)) e(seq))"""


def lifecycle_events(spark, d):
    names = F.array(*map(F.lit, ["withdraw", "approve", "reject", "cancel"]))
    rows = A.requests(spark, d).withColumn("seq", F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 2, 3)])))
    return rows.select("request_id", "seq", F.element_at(names, ((F.col("request_id") + F.col("seq")) % 4 + 1).cast("int")).alias("event"), F.when(F.col("request_id") % 11 == 0, F.col("employee_id")).otherwise(-1).alias("actor_id"), F.date_add("start_date", F.col("seq").cast("int")).alias("day"))


@query(
    """with recursive st as (select request_id, 0 as seq, status, employee_id, end_date, 0 as bad from reqs union all
    select request_id, st.seq + 1, coalesce(nxt, status), employee_id, end_date, bad + (nxt is null)::int from (select st.*, case when status in ('SUBMITTED', 'PENDING_APPROVAL') and event = 'withdraw' then 'WITHDRAWN'
    when status in ('SUBMITTED', 'PENDING_APPROVAL') and event = 'approve' and actor_id <> employee_id then 'APPROVED' when status in ('SUBMITTED', 'PENDING_APPROVAL') and event = 'reject' and actor_id <> employee_id then 'REJECTED'
    when status = 'APPROVED' and event = 'cancel' and end_date >= day then 'CANCELLED' end as nxt from st join levents e on e.request_id = st.request_id and e.seq = st.seq + 1) st)
    select request_id, status, bad as n_rejected from st where seq = 3""",
    "reqs levents",
)
def l8_fold_lifecycle(spark, d):
    return V.fold_lifecycle(A.requests(spark, d), lifecycle_events(spark, d))


@query("select employee_id, leave_type from emps join types on list_contains(eligible, employment_type)", "emps types")
def l9_eligible_types(spark, d):
    return V.eligible_types(A.employees(spark, d), V.leave_types(spark)).select("employee_id", "leave_type")


@query("select a.request_id, b.request_id as other_id from reqs a join reqs b on a.employee_id = b.employee_id and a.request_id <> b.request_id and a.start_date <= b.end_date and b.start_date <= a.end_date where a.status <> 'REJECTED' and b.status in ('SUBMITTED', 'PENDING_APPROVAL', 'APPROVED')", "reqs")
def j10_overlaps(spark, d):
    r = A.requests(spark, d)
    return V.overlaps(r.filter("status <> 'REJECTED'"), r.filter(F.col("status").isin(V.OPEN)))


@query("select request_id from reqs where end_date >= date '1998-06-01' and start_date <= date '1998-06-30'", "reqs")
def f6_overlapping(spark, d):
    return V.overlapping(A.requests(spark, d), F.to_date(F.lit("1998-06-01")), F.to_date(F.lit("1998-06-30"))).select("request_id")


@query("select employee_id as ask_id, case when employee_id % 4 = 3 then null else employee_id end as employee_id from emps", "emps")
def j14_resolve_employee(spark, d):
    e = A.employees(spark, d).withColumn("email", F.concat(F.lit("e"), "employee_id", F.lit("@example.com")))
    k = F.col("employee_id") % 4
    value = F.when(k == 0, F.col("employee_id").cast("string")).when(k == 1, F.upper("employee_number")).when(k == 2, F.upper("email")).otherwise("nobody")
    return V.resolve_employee(e.select(F.col("employee_id").alias("ask_id"), value.alias("value")), e)


@query("select request_id, start_date, (select count(*) > 3 from reqs where employee_id = 1) as has_more from reqs where employee_id = 1 order by start_date desc, request_id limit 3", "reqs")
def t5_leave_history(spark, d):
    return V.leave_history(A.requests(spark, d), 1, 1, 3).select("request_id", "start_date", "has_more")


@query("select o_orderkey, o_orderkey % 5 not in (0, 3) as valid from orders")
def v3_valid_date(spark, d):
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, "1998-02-30").when(k == 3, F.concat("o_orderkey", F.lit("x"))).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return A.table(spark, d, "orders").select("o_orderkey", D.valid_date(text).alias("valid"))


@query("select job_id, count(*) as found, count(*) filter (outcome = 'PROCESSED') as processed, count(*) filter (outcome = 'SKIPPED') as skipped, count(*) filter (outcome = 'FAILED') as failed, coalesce(sum(n_chunks), 0)::bigint as chunks from items group by 1", "items")
def a10_job_rollup(spark, d):
    return J.job_rollup(A.job_items(spark, d))


@query(
    """select job_id, case when f = 0 then 'COMPLETED' when g > 0 then 'PARTIALLY_COMPLETED' else 'FAILED' end as status, error_summary from (select job_id, count(*) filter (outcome = 'FAILED') as f, count(*) filter (outcome <> 'FAILED') as g from items group by 1)
    left join (select job_id, left(string_agg('item ' || event_id || ' failed', chr(10) order by event_id), 4000) as error_summary from (select *, row_number() over (partition by job_id order by event_id) as n from items where outcome = 'FAILED') where n <= 10 group by 1) using (job_id)""",
    "items",
)
def a11_job_status(spark, d):
    return J.job_status(A.job_items(spark, d).select("job_id", F.col("event_id").alias("item_id"), "outcome", F.concat(F.lit("item "), "event_id", F.lit(" failed")).alias("error")))


@query("select job_id, date_diff('millisecond', min(date_trunc('millisecond', ts)), max(date_trunc('millisecond', ts))) as duration_ms from items group by 1", "items")
def a12_job_duration(spark, d):
    return J.job_duration(A.job_items(spark, d))


@query("select user_id, event_id, outcome from items qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1", "items")
def w10_latest(spark, d):
    return J.latest(A.job_items(spark, d), "user_id", "ts", "event_id").select("user_id", "event_id", "outcome")


@query("select event_id, ts from events where event_type = 'purchase' order by ts desc, event_id desc limit 50")
def f7_recent_traces(spark, d):
    return J.recent_traces(A.table(spark, d, "events").withColumn("source", F.col("event_type")), 50, "purchase").select("event_id", "ts")


@query("select doc_id as revision_id, case when trim(text) = '' then 'SKIPPED' when doc_id % 3 = 0 then 'SKIPPED' else 'PROCESSED' end as outcome, case when trim(text) = '' then 'NO_CONTENT' when doc_id % 3 = 0 then 'UNCHANGED_CONTENT' end as skip_reason, null::varchar as stage, null::varchar as error from documents")
def k1_process_revisions(spark, d):
    docs = A.table(spark, d, "documents").select(F.col("doc_id").alias("revision_id"), "text")
    known = docs.select("revision_id", F.when(F.col("revision_id") % 3 == 0, T.content_hash(F.col("text"))).otherwise("other").alias("content_hash"), F.lit(1).alias("n_chunks"))
    return J.process_revisions(docs, known)


@query("select chunk_id, k as slot, round(vector[k + 1], 6) + 0 as value, false as is_semantic from cvec cross join range(64) r(k)", "chunks cvec")
def m1_hash_embed(spark, d):
    rows = J.hash_embed(A.chunks(spark, d).select("chunk_id", "content"))
    return rows.select("chunk_id", "is_semantic", F.posexplode("embedding").alias("slot", "value")).withColumns({"slot": F.col("slot").cast("long"), "value": F.round("value", 6) + 0.0})


@query(f"select doc_id, term, round(1 + ln(count(*)), 9) as weight from (select doc_id, unnest({TERMS.format('text')}) as term from documents) group by 1, 2")
def a16_term_weights(spark, d):
    return J.term_weights(A.table(spark, d, "documents"), "doc_id", "text").withColumn("weight", F.round("weight", 9))


CTE["calls"] = """calls as (select user_id || '-' || ts::date as turn_id, row_number() over (partition by user_id, ts::date order by ts, event_id) as seq, event_id, case event_type when 'view' then 'validate' when 'purchase' then 'apply' when 'click' then 'balance'
    when 'signup' then 'withdraw' else 'validate' end as tool, event_type <> 'error' as ok, (event_id % 3)::varchar as signature from events)"""


@query(
    """with r as (select *, coalesce(bool_or(tool = 'validate' and ok) over (partition by turn_id order by seq rows between unbounded preceding and 1 preceding), false) as ready from calls)
    select event_id, case when tool <> 'apply' then 'ALLOWED' when not ready then 'MISSING_PREREQUISITE' when row_number() over (partition by turn_id, tool, signature, ready and tool = 'apply' order by seq) > 1 then 'DUPLICATE' else 'ALLOWED' end as verdict from r""",
    "calls",
)
def w11_audit_tool_calls(spark, d):
    e = A.table(spark, d, "events")
    tool = F.when(F.col("event_type") == "view", "validate").when(F.col("event_type") == "purchase", "apply").when(F.col("event_type") == "click", "balance").when(F.col("event_type") == "signup", "withdraw").otherwise("validate")
    calls = e.select(F.concat_ws("-", "user_id", F.to_date("ts")).alias("turn_id"), F.struct("ts", "event_id").alias("seq"), "event_id", tool.alias("tool"), (F.col("event_type") != "error").alias("ok"), (F.col("event_id") % 3).cast("string").alias("signature"))
    return J.audit_tool_calls(calls).select("event_id", "verdict")


@query("select source, lang, count(*) as n, count(*) filter (toxic = 0) as active, count(*) filter (copies > 1) as repeated from (select *, count(*) over (partition by text) as copies from revs) group by 1, 2", "revs")
def a20_corpus_summary(spark, d):
    revs = A.revisions(spark, d, text=True).withColumn("content_hash", F.sha2("text", 256)).withColumn("is_active", F.col("toxic") == 0)
    return J.corpus_summary(revs.drop("text"), "source", "lang")


@query("select event_type, printf('%.1f%%', 100.0 * count(*) filter (user_id % 2 = 0) / count(*)) as share from events group by 1")
def c14_percent(spark, d):
    own = A.table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("user_id") % 2 == 0).alias("a"), F.count("*").alias("b"))
    return own.select("event_type", J.running_share(F.col("a"), F.col("b")).alias("share"))
