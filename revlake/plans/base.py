"""A registry of queries, each with the SQL that gives the same rows; and the SQL of the derived tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# the adapters of revlake.sources.adapters, as common table expressions
CTE = {
    "revs": """revs as (select d.doc_id as revision_id, d.doc_id // 3 as document_id,
        'DOC-' || chr((65 + (d.doc_id // 3) // 260000 % 26)::int) || chr((65 + (d.doc_id // 3) // 10000 % 26)::int) || '-' || lpad(((d.doc_id // 3) % 10000)::varchar, 4, '0') as document_code,
        (d.doc_id % 3 + 1)::int as revision_number,
        case when (d.doc_id // 3) % 17 = 0 then 'PENDING' when l.quality = 1 then 'READY' when l.quality = 0 then 'FAILED' when d.doc_id % 5 = 0 then 'PENDING' else 'READY' end as status,
        timestamp '2024-01-01' + to_minutes(d.doc_id) as created_at, d.source, d.lang, d.n_chars, coalesce(l.toxic, 0) as toxic, d.text
        from documents d left join labels l using (doc_id))""",
    "docs": """docs as (select document_id, min(document_code) as document_code, arg_min(source, revision_number) as department, max(toxic) = 0 as is_active,
        min(created_at) as created_at, ['POLICY','PROCEDURE','STANDARD','GUIDELINE','MANUAL','WORKFLOW','FAQ','FORM'][document_id % 8 + 1] as document_type,
        'Document ' || min(document_code) as title from revs group by document_id)""",
    "active": """active as (select * exclude (status, best, done), done and revision_number = best as is_current,
        case when done and revision_number = best then 'READY' when done then 'SUPERSEDED' else status end as status
        from (select *, status in ('READY', 'SUPERSEDED') as done, max(revision_number) filter (status in ('READY', 'SUPERSEDED')) over (partition by document_id) as best from revs))""",
    "elements": """elements as (select *, case when line_no = 0 then 1 when line_no % 10 = 0 then 3 end as level,
        case when line_no % 10 = 0 then 'heading' else 'paragraph' end as type, (line_no // 40 + 1)::int as page
        from (select doc_id as revision_id, unnest(string_split(text, chr(10))) as line, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::int as line_no from documents))""",
    "chunks": """chunks as (select revision_id * 1073741824 + chunk_index as chunk_id, *, case when chunk_index % 9 = 8 then 'ADMINISTRATIVE' else 'CONTENT' end as section_role
        from (select e.revision_id, e.revision_id // 3 as document_id, (row_number() over (partition by e.revision_id order by line_no) - 1)::int as chunk_index,
        'DOC-' || chr((65 + (e.revision_id // 3) // 260000 % 26)::int) || chr((65 + (e.revision_id // 3) // 10000 % 26)::int) || '-' || lpad(((e.revision_id // 3) % 10000)::varchar, 4, '0') as document_code,
        split_part(d.text, chr(10), 1) as section_title, case when line_no >= 10 then split_part(d.text, chr(10), line_no // 10 * 10 + 1) end as subsection_title, e.line as content, e.page, ceil(length(e.line) / 3.8)::int as tokens
        from elements e join documents d on d.doc_id = e.revision_id where trim(line) <> ''))""",
    "msgs": "msgs as (select *, timestamp '2024-01-01' + to_hours(conv_id) + to_minutes(turn) as created_at from conversations)",
    "items": """items as (select ts::date as job_id, event_id, ts, user_id, event_type, case event_type when 'error' then 'FAILED' when 'view' then 'SKIPPED' else 'PROCESSED' end as outcome,
        value as latency_ms, json_extract_string(props, '$.k')::bigint as n_chunks from events)""",
    "emps": """emps as (select c_custkey as employee_id, c_name as employee_number, case when c_custkey % 5 = 0 then [1, 2, 3] else [1, 2, 3, 4, 5] end as working_days,
        ['PERMANENT', 'FIXED_TERM', 'CONTRACTOR', 'INTERN'][c_custkey % 4 + 1] as employment_type, case when c_mktsegment = 'MACHINERY' then 'Head of Unit' else 'Analyst' end as title,
        c_custkey % 29 <> 0 as is_active, case when c_custkey % 13 = 0 then date '1998-09-30' end as probation_end from customer)""",
    "reqs": """reqs as (select o_orderkey as request_id, o_custkey as employee_id, o_orderdate::date as start_date, o_orderdate::date + (o_orderkey % 9)::int as end_date,
        ['ANNUAL', 'SICK', 'UNPAID', 'PARENTAL', 'COMPASSIONATE', 'STUDY'][o_orderkey % 6 + 1] as leave_type, case when o_orderkey % 10 = 0 then 'AFTERNOON' else 'FULL_DAY' end as start_portion,
        'FULL_DAY' as end_portion, case when o_orderstatus = 'F' then 'APPROVED' when o_orderstatus = 'O' then 'PENDING_APPROVAL' when o_orderpriority like '1%' then 'WITHDRAWN'
        when o_orderpriority like '2%' then 'CANCELLED' else 'REJECTED' end as status from orders)""",
}
NEEDS = {"docs": ["revs"], "active": ["revs"], "chunks": ["elements"]}


def with_tables(names: str, sql: str) -> str:
    """Puts the named derived tables, and those they need, before a query; sql may go on with its own."""
    order: list[str] = []
    for n in names.split():
        order += [x for x in (*NEEDS.get(n, []), n) if x not in order]
    own = ",\n".join(CTE[n] for n in order)
    text = sql.strip()
    for start in ("with recursive ", "with "):
        if text.startswith(start):
            return f"with recursive {own},\n{text[len(start) :]}"
    return f"with recursive {own}\n{text}"


def query(oracle: str = "", tables: str = ""):
    """Registers a function as a query under its name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = with_tables(tables, oracle) if tables else oracle
        return f

    return add
