"""Leave records: working days, entitlements, balances, request validation and lifecycle, for all employees at once."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlake.config import DEFAULT, Config
from revlake.functions import dates as D

# fixed values: leave types as (code, days or null for the annual allowance, uses a balance, allows the past, documents after days, employment types)
LEAVE_TYPES = [
    ("ANNUAL", None, True, False, None, ["PERMANENT", "FIXED_TERM"]),
    ("SICK", 10, True, True, 3, ["PERMANENT", "FIXED_TERM", "INTERN"]),
    ("UNPAID", 0, False, False, None, ["PERMANENT", "FIXED_TERM", "CONTRACTOR", "INTERN"]),
    ("PARENTAL", 20, True, False, None, ["PERMANENT"]),
    ("COMPASSIONATE", 5, True, True, None, ["PERMANENT", "FIXED_TERM"]),
    ("STUDY", 5, True, False, None, ["PERMANENT"]),
]
# fixed values: yearly holidays as (month, day, name)
HOLIDAYS = [(1, 1, "New Year's Day"), (5, 1, "Labour Day"), (12, 25, "Christmas Day"), (12, 26, "Boxing Day")]
OPEN = ["SUBMITTED", "PENDING_APPROVAL", "APPROVED"]
SENIOR = "(?i)head|director|chief|lead|principal|manager"


def leave_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEAVE_TYPES, "leave_type string, fixed_days int, uses_balance boolean, allows_past boolean, documents_after int, eligible array<string>")


def holidays(years: DataFrame) -> DataFrame:
    """L6. years: (year). Four fixed days a year."""
    each = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(d).alias("d"), F.lit(n).alias("holiday")) for m, d, n in HOLIDAYS])
    return years.select("year", F.inline(each)).select(F.make_date("year", "m", "d").alias("date"), "holiday")


def eligible_types(employees: DataFrame, types: DataFrame) -> DataFrame:
    """L9. Every employee with every type of the (six-row) table that their employment allows."""
    return employees.join(F.broadcast(types), F.expr("array_contains(eligible, employment_type)"))


def annual_days(title: Column, working_days: Column, cfg: Config = DEFAULT) -> Column:
    base = F.when(title.rlike(SENIOR), cfg.senior_days).otherwise(cfg.standard_days)
    return F.when(F.size(working_days) >= 5, base.cast("double")).otherwise(D.round_half_day(base * F.size(working_days) / 5))


def entitlements(employees: DataFrame, types: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """L1. Days of each employee and eligible type."""
    return eligible_types(employees, types).withColumn("entitlement", F.coalesce(F.col("fixed_days").cast("double"), annual_days(F.col("title"), F.col("working_days"), cfg)))


def working_days(ranges: DataFrame) -> DataFrame:
    """L3, J12. ranges: (..., start_date, end_date, working_days). One row a day: WEEKEND before PUBLIC_HOLIDAY before WORKING."""
    rows = ranges.filter("end_date >= start_date").withColumn("date", F.explode(F.sequence("start_date", "end_date")))
    fixed = F.lit(False)
    for m, d, _ in HOLIDAYS:
        fixed = fixed | ((F.month("date") == m) & (F.dayofmonth("date") == d))
    reason = F.when(~F.array_contains("working_days", D.iso_weekday(F.col("date"))), "WEEKEND").when(fixed, "PUBLIC_HOLIDAY").otherwise("WORKING")
    return rows.withColumn("reason", reason)


def day_counts(start: Column, end: Column, days: Column) -> Column:
    """The working dates of one range, as an array in its own row."""
    fixed = lambda x: F.concat_ws("-", F.month(x), F.dayofmonth(x)).isin([f"{m}-{d}" for m, d, _ in HOLIDAYS])
    return F.when(end < start, F.array().cast("array<date>")).otherwise(F.filter(F.sequence(start, end), lambda x: F.array_contains(days, D.iso_weekday(x)) & ~fixed(x)))


def request_days(requests: DataFrame) -> DataFrame:
    """L4, W7. Adds n_working and requested_days; halves count on the first and last working day, on a single day the start's."""
    dates = day_counts(F.col("start_date"), F.col("end_date"), F.col("working_days"))
    rows = requests.withColumn("n_working", F.size(dates))
    start, end = F.col("start_portion") != "FULL_DAY", F.col("end_portion") != "FULL_DAY"
    halves = F.when(F.col("n_working") == 0, 0).when(F.col("n_working") == 1, (start | end).cast("int")).otherwise(start.cast("int") + end.cast("int"))
    return rows.withColumn("requested_days", D.round_half_day(F.col("n_working") - halves * 0.5))


def balances(employees: DataFrame, requests: DataFrame, types: DataFrame, as_of: Column, cfg: Config = DEFAULT) -> DataFrame:
    """L2, A13. requests: with requested_days; employees may have carried_over. One row an employee and eligible type."""
    year = (F.col("start_date") >= D.year_start(as_of)) & (F.col("start_date") <= D.year_end(as_of))
    used = requests.filter(year & F.col("status").isin(OPEN))
    approved = F.col("status") == "APPROVED"
    part = lambda cond: F.sum(F.when(cond, F.col("requested_days")).otherwise(0.0))
    sums = used.groupBy("employee_id", "leave_type").agg(part(approved & (F.col("end_date") < as_of)).alias("taken"), part(approved & (F.col("end_date") >= as_of)).alias("scheduled"), part(~approved).alias("pending"))
    rows = entitlements(employees, types, cfg).join(sums, ["employee_id", "leave_type"], "left").fillna(0.0, ["taken", "scheduled", "pending"])
    carried = F.least(F.coalesce("carried_over", F.lit(0)), F.lit(cfg.carry_over_days)) if "carried_over" in employees.columns else F.lit(0)
    valid = as_of <= F.add_months(D.year_start(as_of), cfg.carry_over_months)
    rows = rows.withColumn("carry", F.when(valid, carried).otherwise(0).cast("double")).withColumn("accrued", D.round_half_day(F.col("entitlement") * D.accrual_fraction(as_of)))
    left = D.round_half_day(F.col("entitlement") + F.col("carry") - F.col("taken") - F.col("scheduled") - F.col("pending"))
    return rows.withColumn("available", F.when(F.col("uses_balance"), left).otherwise(0.0))


#: Days of a bin of the interval join.
BIN_DAYS = 32


def overlaps(requests: DataFrame, existing: DataFrame, bin_days: int = BIN_DAYS) -> DataFrame:
    """J10. Pairs of an employee's requests whose dates overlap.

    Both meet in the bins of days that they touch, so the requests of one employee are spread over as many keys as their
    dates span; of the bins that a pair shares, the one in which the later of the two begins gives it, once.
    """
    number = lambda c: F.floor(F.unix_date(c) / bin_days)

    def binned(df: DataFrame, name: str) -> DataFrame:
        own = df.filter("start_date is not null and end_date is not null").select("employee_id", "request_id", "start_date", "end_date")
        spread = F.sequence(number(F.least("start_date", "end_date")), number(F.greatest("start_date", "end_date")))
        return own.withColumn("bin", F.explode(spread)).alias(name)

    a, b = binned(requests, "a"), binned(existing, "b")
    on = (F.col("a.employee_id") == F.col("b.employee_id")) & (F.col("a.bin") == F.col("b.bin")) & (F.col("a.start_date") <= F.col("b.end_date")) & (F.col("b.start_date") <= F.col("a.end_date")) & (F.col("a.request_id") != F.col("b.request_id"))
    owner = F.col("a.bin") == number(F.greatest("a.start_date", "b.start_date"))
    return a.join(b, on & owner).select(F.col("a.request_id").alias("request_id"), F.col("b.request_id").alias("other_id"))


def overlapping(requests: DataFrame, start: Column, end: Column) -> DataFrame:
    """F6. Requests that touch a window."""
    return requests.filter((F.col("end_date") >= start) & (F.col("start_date") <= end))


def resolve_employee(asked: DataFrame, employees: DataFrame) -> DataFrame:
    """J14. asked: (ask_id, value). By id first, then number, then email."""
    keys = F.inline(F.array(*[F.struct(F.lit(k).alias("priority"), F.lower(F.col(c).cast("string")).alias("key")) for k, c in enumerate(("employee_id", "employee_number", "email"))]))
    known = employees.select("employee_id", keys)
    found = asked.join(known, F.lower("value") == F.col("key"))
    best = found.groupBy("ask_id").agg(F.min(F.struct("priority", "employee_id")).alias("b"))
    return asked.join(best, "ask_id", "left").select("ask_id", F.col("b.employee_id").alias("employee_id"))


def validate_requests(candidates: DataFrame, employees: DataFrame, existing: DataFrame, types: DataFrame, as_of: Column, cfg: Config = DEFAULT) -> DataFrame:
    """L5. Every candidate with all its violations, in the rules' order; an inverted range stops at once.

    candidates: (request_id, employee_id, leave_type, start_date, end_date, start_portion, end_portion); existing: the
    same with status and requested_days. valid: no violation of severity ERROR. Documentation is a warning only.
    """
    people = employees.select("employee_id", "working_days", "employment_type", "is_active", "probation_end")
    rows = request_days(candidates.join(people, "employee_id")).join(F.broadcast(types), "leave_type")
    own = balances(employees, existing, types, as_of, cfg).select("employee_id", "leave_type", "available")
    clash = overlaps(candidates, existing.filter(F.col("status").isin(OPEN))).select("request_id").distinct().withColumn("clash", F.lit(True))
    rows = rows.join(own, ["employee_id", "leave_type"], "left").join(clash, "request_id", "left")
    ahead = F.datediff("start_date", as_of)
    notice = F.when(F.col("requested_days") <= cfg.short_request, cfg.notice_short).otherwise(cfg.notice_long)
    rules = {
        "EMPLOYEE_INACTIVE": ~F.col("is_active"),
        "NO_WORKING_DAYS": F.col("n_working") == 0,
        "LEAVE_TYPE_NOT_ELIGIBLE": ~F.array_contains("eligible", F.col("employment_type")),
        "PROBATION_RESTRICTION": (F.col("leave_type") == "ANNUAL") & (F.col("start_date") <= F.col("probation_end")),
        "DATE_IN_PAST": (ahead < 0) & ~F.col("allows_past"),
        "TOO_FAR_IN_FUTURE": ahead > cfg.horizon_days,
        "INSUFFICIENT_NOTICE": (F.col("n_working") > 0) & ~F.col("allows_past") & (ahead >= 0) & (ahead < notice),
        "EXCEEDS_MAX_CONSECUTIVE": F.col("requested_days") > cfg.max_consecutive,
        "OVERLAPPING_REQUEST": F.coalesce("clash", F.lit(False)),
        "INSUFFICIENT_BALANCE": F.col("uses_balance") & (F.col("requested_days") > F.coalesce("available", F.lit(0.0))),
        "DOCUMENTATION_REQUIRED": F.col("requested_days") > F.col("documents_after"),
    }
    inverted = F.col("end_date") < F.col("start_date")
    found = F.when(inverted, F.array(F.lit("INVALID_DATE_RANGE"))).otherwise(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])))
    rows = rows.withColumn("violations", found).withColumn("requested_days", F.when(inverted, 0.0).otherwise(F.col("requested_days")))
    return rows.withColumn("valid", F.size(F.filter("violations", lambda v: v != "DOCUMENTATION_REQUIRED")) == 0)


def describe_validation(results: DataFrame) -> Column:
    """F18. A result as one readable text."""
    change = F.format_string("%.1f day(s), %.1f available before", "requested_days", F.coalesce("available", F.lit(0.0)))
    return F.concat_ws("; ", F.when(F.col("valid"), "valid").otherwise("not valid"), change, F.when(F.size("violations") > 0, F.array_join("violations", ", ")))


def apply_requests(candidates: DataFrame, allowance: DataFrame) -> DataFrame:
    """L7. Applies candidates in order, one employee and type at a time: each acceptance lowers what the next one finds.

    candidates: (request_id, employee_id, leave_type, seq, idempotency_key, start_date, end_date, requested_days,
    needs_approval); allowance: (employee_id, leave_type, available). A repeated key returns the earlier request; one that
    ends before it starts is rejected. What was accepted never overlaps, so a search in order finds a clash. A task reads
    its employees one after another, in order, so many employees cost no Python call each, and of one only what was found is held.
    """
    first = Window.partitionBy("employee_id", "idempotency_key").orderBy("seq")
    rows = candidates.join(allowance, ["employee_id", "leave_type"], "left").repartition("employee_id")
    rows = rows.withColumn("original_id", F.first("request_id").over(first)).sortWithinPartitions("employee_id", F.asc_nulls_last("seq"))
    read = ["request_id", "employee_id", "original_id", "leave_type", "start_date", "end_date", "requested_days", "available", "needs_approval"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, starts, ends, given, now = {}, [], [], {}, ()
        for some in batches:
            columns = [c.cast(pa.int32()) if pa.types.is_date32(c.type) else c for c in map(some.column, read)]
            results, told = [], []
            for request, employee, original, kind, start, end, days, available, asks in zip(*(c.to_pylist() for c in columns)):
                if now != (employee,):
                    left, starts, ends, given, now = {}, [], [], {}, (employee,)
                results.append(original)
                if request is None or original != request:
                    told.append(given.get(original, "REJECTED"))
                    continue
                days = math.nan if days is None else days
                have = left.setdefault(kind, 0.0 if available is None or available != available else available)
                at = bisect.bisect_right(starts, end)
                if end < start or (at and ends[at - 1] >= start) or days > have:
                    status = "REJECTED"
                else:
                    status = "PENDING_APPROVAL" if asks else "APPROVED"
                    left[kind] = have - days
                    starts.insert(at, start)
                    ends.insert(at, end)
                given[request] = status
                told.append(status)
            ids = [some.column("request_id").cast(pa.int64()), some.column("employee_id").cast(pa.int64()), pa.array(results, pa.int64())]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(told, pa.string())], ["request_id", "employee_id", "result_id", "status"])

    return rows.select(*read).mapInArrow(run, "request_id long, employee_id long, result_id long, status string")


#: Which events a request's status admits, and what it becomes (fixed values).
MOVES = {
    ("SUBMITTED", "withdraw"): "WITHDRAWN",
    ("PENDING_APPROVAL", "withdraw"): "WITHDRAWN",
    ("SUBMITTED", "approve"): "APPROVED",
    ("PENDING_APPROVAL", "approve"): "APPROVED",
    ("SUBMITTED", "reject"): "REJECTED",
    ("PENDING_APPROVAL", "reject"): "REJECTED",
    ("APPROVED", "cancel"): "CANCELLED",
}


def next_status(status: Column, event: Column, own: Column, ended: Column) -> Column:
    """The status after an event, or null where it is illegal: decisions on one's own request, cancelling what has ended."""
    out = F.lit(None).cast("string")
    for (before, name), after in MOVES.items():
        legal = (status == before) & (event == name)
        legal = legal & ~own if name in ("approve", "reject") else legal & ~ended if name == "cancel" else legal
        out = F.when(legal, after).otherwise(out)
    return out


def fold_lifecycle(requests: DataFrame, events: DataFrame) -> DataFrame:
    """L8. events: (request_id, seq, event, actor_id, day). Final status and rejected events of each request."""
    item = F.struct("seq", "event", "actor_id", "day")
    own = events.groupBy("request_id").agg(F.sort_array(F.collect_list(item)).alias("events"))
    rows = requests.join(own, "request_id", "left")
    start = F.struct(F.col("status").alias("status"), F.array().cast("array<bigint>").alias("rejected"))

    def step(acc: Column, e: Column) -> Column:
        after = next_status(acc["status"], e["event"], F.coalesce(e["actor_id"] == F.col("employee_id"), F.lit(False)), F.coalesce(F.col("end_date") < e["day"], F.lit(False)))
        return F.struct(F.coalesce(after, acc["status"]).alias("status"), F.when(after.isNull(), F.concat(acc["rejected"], F.array(e["seq"].cast("long")))).otherwise(acc["rejected"]).alias("rejected"))

    folded = F.aggregate(F.coalesce("events", F.array().cast("array<struct<seq:bigint,event:string,actor_id:bigint,day:date>>")), start, step)
    return rows.select("request_id", folded.alias("f")).select("request_id", F.col("f.status").alias("status"), F.size("f.rejected").alias("n_rejected"))


def leave_history(requests: DataFrame, employee_id: int, page: int, size: int, order: str = "newest") -> DataFrame:
    """T5. A page of an employee's requests with has_more, in one of three orders."""
    orders = {"newest": [F.desc("start_date")], "oldest": [F.asc("start_date")], "longest": [F.desc(F.datediff("end_date", "start_date"))]}
    own = requests.filter(F.col("employee_id") == employee_id)
    rows = own.orderBy(*orders[order], "request_id").offset((page - 1) * size).limit(size)
    return rows.join(own.agg((F.count("*") > page * size).alias("has_more")))
