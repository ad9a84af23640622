"""Queries over text expressions and document structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlake.functions import dates as D
from revlake.functions import text as T
from revlake.operators import structure as S
from revlake.operators.context import merge_metadata
from revlake.operators.retrieval import cosine
from revlake.sources import adapters as A

from .base import CTE, query
from .retrieval import NORM, TERMS

WS = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\\r\\n?', chr(10), 'g'), chr(160), ' ', 'g'), '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


def docs(spark, d):
    return A.table(spark, d, "documents")


@query(f"select doc_id, sha256({WS.format('text')}) as clean, sha256(lower({WS.format('text')})) as content_hash, sha256(text) as file_hash from documents")
def c7_hashes(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(T.normalize_whitespace(F.col("text")), 256).alias("clean"), T.content_hash(F.col("text")).alias("content_hash"), T.file_hash(F.col("text")).alias("file_hash"))


@query("select doc_id, sha256(regexp_replace(text, '([a-z])[.]?\\n([a-z])', '\\1\\2', 'g')) as joined from (select doc_id, replace(text, chr(10), chr(10)) as text from documents)")
def c2_dehyphenate(spark, d):
    broken = F.regexp_replace("text", r"([a-z])[.]?\n([a-z])", "$1-\n$2")
    return docs(spark, d).select("doc_id", F.sha2(T.dehyphenate(broken), 256).alias("joined"))


@query(f"select doc_id, sha256({NORM.format('text')}) as norm, len({TERMS.format('text')})::int as n from documents")
def c3_normalize_for_comparison(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(T.normalize_for_comparison(F.col("text")), 256).alias("norm"), F.size(T.terms(F.col("text"))).alias("n"))


@query(
    f"""with t as (select conv_id, turn, {TERMS.format('text')} as w from conversations), p as (select a.conv_id, a.turn, a.w as x, b.w as y from t a join t b on a.conv_id = b.conv_id and a.turn = b.turn + 1)
    select conv_id, turn, round(case when len(x) = 0 or len(y) = 0 then 0 else len(list_intersect(x, y)) / len(list_distinct(x || y)) end, 9) as jaccard,
    round(case when len(x) = 0 then 0 else len(list_filter(x, lambda w: list_contains(y, w))) / len(x) end, 9) as containment from p"""
)
def c4_similarity(spark, d):
    t = A.table(spark, d, "conversations").select("conv_id", "turn", "text")
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prior"))
    return t.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.jaccard(F.col("text"), F.col("prior")), 9).alias("jaccard"), F.round(T.containment(F.col("text"), F.col("prior")), 9).alias("containment"))


@query("select doc_id, round((length(text) - length(regexp_replace(text, '[^\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{A0}]', '', 'g'))) / length(text), 9) as ratio from documents where length(text) > 0")
def c6_printable_ratio(spark, d):
    return docs(spark, d).filter("length(text) > 0").select("doc_id", F.round(T.printable_ratio(F.col("text")), 9).alias("ratio"))


@query("select doc_id, ceil(length(text) / 3.8)::int as tokens, sum(ceil(length(text) / 3.8)::int) over (partition by source)::bigint as source_tokens from documents")
def c8_token_count(spark, d):
    t = docs(spark, d).select("doc_id", "source", T.token_count(F.col("text")).alias("tokens"))
    total = t.groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    return t.join(total, "source").select("doc_id", "tokens", "source_tokens")


@query(
    """with t as (select doc_id, text, left(text, 190) as cut, 190 - instr(reverse(left(text, 190)), ' ') as last from documents)
    select doc_id, case when length(text) <= 190 then text when instr(cut, ' ') > 0 and last > 152 then left(cut, last::int) else cut end as truncated from t"""
)
def c9_truncate_to_tokens(spark, d):
    return docs(spark, d).select("doc_id", T.truncate_to_tokens(F.col("text"), 50).alias("truncated"))


@query("select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def c10_cosine(spark, d):
    e = A.table(spark, d, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 9).alias("cosine"))


@query(
    """with o as (select o_orderkey, o_orderdate::date as d, o_totalprice from orders)
    select o_orderkey, floor(o_totalprice / 1000 * 2 + 0.5) / 2 as half, isodow(d)::int as weekday, (d + interval 1 month)::date as next_month, (make_date(year(d), 12, 31) - d)::int as left_days,
    round((d - make_date(year(d), 1, 1) + 1) / (make_date(year(d), 12, 31) - make_date(year(d), 1, 1) + 1), 9) as accrued from o"""
)
def c13_dates(spark, d):
    day = F.to_date("o_orderdate")
    return A.table(spark, d, "orders").select(
        "o_orderkey", D.round_half_day(F.col("o_totalprice") / 1000).alias("half"), D.iso_weekday(day).alias("weekday"), F.add_months(day, 1).alias("next_month"), D.days_between(day, D.year_end(day)).alias("left_days"), F.round(D.accrual_fraction(day), 9).alias("accrued")
    )


@query(
    """with k as (select event_id, json_extract_string(props, '$.k')::int as k, event_type from events)
    select event_id, k, json_object('k', k, 'type', event_type)::varchar as built, 'k=' || k || ',source=' || event_type || ',type=' || event_type as merged from k"""
)
def c12_json(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    old = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("source"), F.lit("store")))
    merged = merge_metadata(old, F.create_map(F.lit("source"), F.col("event_type"), F.lit("type"), F.col("event_type")))
    told = F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return A.table(spark, d, "events").select("event_id", k.alias("k"), F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("type"))).alias("built"), told.alias("merged"))


@query("select p_partkey, list_reduce(list_transform(string_split(p_name, ''), lambda c: ascii(c)::bigint), lambda a, x: (xor(a, x) * 16777619) & 4294967295, 2166136261::bigint) as hash from part")
def c16_fnv1a(spark, d):
    return A.table(spark, d, "part").select("p_partkey", T.fnv1a(F.col("p_name")).alias("hash"))


@query("select doc_id, try_cast(nullif(regexp_extract(replace(text, ',', ''), '-?\\d+(?:\\.\\d+)?'), '') as double) as value from documents")
def c18_numeric_value(spark, d):
    return docs(spark, d).select("doc_id", T.numeric_value(F.col("text")).alias("value"))


LEANING = "[" + ",".join(f"'{w}'" for w in T.REFERENTIAL) + "]"
MINOR = "[" + ",".join(f"'{w}'" for w in T.MINOR_WORDS) + "]"
CTE["sentences"] = "sentences as (select doc_id, (generate_subscripts(string_split(text, '. '), 1) - 1)::int as line_no, unnest(string_split(text, '. ')) as line from documents)"
CTE["lines10"] = "lines10 as (select doc_id, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::int as line_no, unnest(string_split(text, chr(10))) as line from documents)"


@query(f"select doc_id, (generate_subscripts(string_split({WS.format('text')}, chr(10)), 1) - 1)::int as line_no, unnest(string_split({WS.format('text')}, chr(10))) as line from documents")
def p1_to_lines(spark, d):
    return S.to_lines(docs(spark, d))


@query(
    f"""with w as (select doc_id, line_no, line, array_to_string(list_transform(string_split(replace(line, 'ß', 's'), ' '), lambda x: upper(x[1]) || x[2:]), ' ') as title from sentences),
    v as (select doc_id, line_no, case line_no % 5 when 0 then '## ' || line when 1 then line_no || '.' || doc_id || ' ' || line when 2 then upper(regexp_replace(line, '[^ -~]', '', 'g')) when 3 then title else line end as line from w),
    t as (select *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') as l from v),
    p as (select *, regexp_extract(l, '^(\\d+(?:\\.\\d+)*)[.)]?\\s+(.{{2,120}})$', 1) as num, regexp_extract(l, '^(\\d+(?:\\.\\d+)*)[.)]?\\s+(.{{2,120}})$', 2) as body, list_filter(regexp_split_to_array(l, '\\s+'), lambda x: x <> '') as ws from t),
    q as (select *, list_transform(ws, lambda x: regexp_replace(x, '[^A-Za-z]', '', 'g')) as letters from p),
    r as (select *, list_filter(letters, lambda x: not list_contains({MINOR}, lower(x))) as heavy from q)
    select doc_id, line_no, (case when l = '' or length(l) > 120 then 0 when regexp_matches(l, '^#{{1,6}}\\s+') then length(regexp_extract(l, '^(#{{1,6}})\\s+', 1))
    when num <> '' and not regexp_matches(body, '[.:;]$') and len(string_split(body, ' ')) <= 12 then least(len(string_split(num, '.')) + 1, 6)
    when regexp_matches(l, '^[A-Z0-9][A-Z0-9 &/,''()\\-.]{{2,80}}$') and len(string_split(l, ' ')) <= 10 and not regexp_matches(l, '[.]$') then 2
    when length(l) <= 70 and not regexp_matches(l, '[.,;:!?]$') and not regexp_matches(l, '\\s{{3,}}') and not regexp_matches(l, '^[A-Za-z][A-Za-z ]{{0,30}}:\\s+\\S') and len(ws) between 1 and 9 and regexp_matches(l, '^[A-Z]')
    and not list_contains(letters, '') and len(heavy) > 0 and len(list_filter(heavy, lambda x: regexp_matches(x, '^[A-Z]'))) >= 0.8 * len(heavy) then 2 else 0 end)::int as level from r""",
    "sentences",
)
def p3_heading_level(spark, d):
    """Every sentence of every text, shaped as one of five kinds of line."""
    lines = docs(spark, d).select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("line_no", "line"))
    title = F.array_join(F.transform(F.split(F.replace("line", F.lit("ß"), F.lit("s")), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")
    k = F.col("line_no") % 5
    shaped = F.when(k == 0, F.concat(F.lit("## "), "line")).when(k == 1, F.concat("line_no", F.lit("."), "doc_id", F.lit(" "), "line")).when(k == 2, F.upper(F.regexp_replace("line", "[^ -~]", ""))).when(k == 3, title).otherwise(F.col("line"))
    return lines.select("doc_id", "line_no", T.heading_level(shaped).alias("level"))


@query(
    """with v as (select doc_id, line_no, case line_no % 4 when 0 then '- ' || line when 1 then '| ' || replace(line, ' ', ' | ') || ' |' when 2 then replace(line, ' ', '    ') else line end as line from lines10)
    select doc_id, line_no, regexp_matches(line, '^\\s*(?:[-*•·]|\\(?\\d+[.)]|[a-z][.)])\\s+\\S') as is_list, coalesce(l[1] = '|' and l[-1] = '|' and len(string_split(l, '|')) >= 3, false) as is_table,
    len(list_filter(regexp_split_to_array(l, '\\s{3,}'), lambda x: trim(x) <> ''))::int as cells from (select *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') as l from v)""",
    "lines10",
)
def p4_line_tests(spark, d):
    lines = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    k = F.col("line_no") % 4
    shaped = F.when(k == 0, F.concat(F.lit("- "), "line")).when(k == 1, F.concat(F.lit("| "), F.replace("line", F.lit(" "), F.lit(" | ")), F.lit(" |"))).when(k == 2, F.replace("line", F.lit(" "), F.lit("    "))).otherwise(F.col("line"))
    rows = lines.withColumn("line", shaped)
    return rows.select("doc_id", "line_no", T.is_list_item(F.col("line")).alias("is_list"), T.is_table_row(F.col("line")).alias("is_table"), F.size(T.split_columns(F.col("line"))).alias("cells"))


@query()
def p2_build_elements(spark, d):
    return S.build_elements(docs(spark, d)).select("doc_id", "position", "type", "level", "text")


def unescaped(text: str) -> str:
    """SQL of a text whose entities are those of the given pages, some of them cut off before their end."""
    for name, mark in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("#x27", "''"), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        text = f"regexp_replace({text}, '&{name};?', '{mark}', 'g')"
    return text


SHOWN = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


CTE["shown"] = f"""shown as (with p as (select page_id, regexp_extract_all(html, '<li><a [^>]*>([^<]*)</a></li>', 1) as items, regexp_extract(html, '<h1>([^<]*)</h1>', 1) as h1, regexp_extract(html, '</h1>(.*)$', 1, 's') as rest from pages),
    q as (select *, regexp_replace(regexp_replace(regexp_replace(rest, '\\s*</p>', '', 'g'), '<(p|br)>', ' ', 'g'), '<[^>]*>', '', 'g') as body from p)
    select page_id, {unescaped("array_to_string(items, '|')")} as items, {SHOWN.format(unescaped("h1"))} as h1, {SHOWN.format(unescaped("body"))} as body from q)"""


@query(
    """select page_id, 0 as position, 'list' as type, null::int as level, null as text, items from shown union all
    select page_id, 1, 'heading', 1, h1, null from shown union all select page_id, 2, 'paragraph', null, body, null from shown""",
    "shown",
)
def s8_parse_html(spark, d):
    """A navigation list, a heading, and one paragraph that is never closed, so that all further ones are inside it."""
    return S.parse_html(A.table(spark, d, "pages")).select("page_id", "position", "type", "level", "text", F.array_join("items", "|").alias("items"))


@query("select page_id, sha256('- ' || replace(items, '|', chr(10) || '- ') || chr(10) || chr(10) || h1 || chr(10) || chr(10) || body) as text from shown", "shown")
def s8_html_to_text(spark, d):
    """The elements of each page put together again as text."""
    return S.elements_to_text(S.parse_html(A.table(spark, d, "pages")), "page_id").withColumn("text", F.sha2("text", 256))


@query("select doc_id, case when regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' then 'EMPTY' end as error from documents")
def s7_text_guards(spark, d):
    return S.text_guards(docs(spark, d)).select("doc_id", "error")


@query(
    """with w as (select doc_id, line_no // 40 as page, line_no, unnest(string_split(line, ' ')) as text, generate_subscripts(string_split(line, ' '), 1) - 1 as k from lines10)
    select doc_id, page, (line_no % 40 + 1)::bigint as line, (case when line_no = 0 then 16 else 10 end)::double as height, string_agg(text, ' ' order by k) as text from w group by 1, 2, 3, 4""",
    "lines10",
)
def p5_reconstruct_lines(spark, d):
    """Every word of every line is a glyph run, on pages of 40 lines."""
    lines = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    words = lines.select("doc_id", "line_no", F.posexplode(F.split("line", " ")).alias("k", "text"))
    height = F.when(F.col("line_no") == 0, 16.0).otherwise(10.0)
    glyphs = words.select("doc_id", F.expr("line_no div 40").alias("page"), (F.col("k") * 60.0).alias("x"), (800.0 - 12 * (F.col("line_no") % 40)).alias("y"), F.lit(55.0).alias("width"), height.alias("height"), "text")
    return S.reconstruct_lines(glyphs, "doc_id", "page")


@query(
    """with w as (select doc_id, line_no, unnest(string_split(line, ' ')) as text, generate_subscripts(string_split(line, ' '), 1) - 1 as k from lines10)
    select doc_id, (line_no + 1)::bigint as line, (case when line_no = 0 then 16 else 10 end)::double as height, string_agg(text, ' ' order by k) as text from w group by 1, 2, 3""",
    "lines10",
)
def p5_reconstruct_all_lines(spark, d):
    """As p5_reconstruct_lines, on one page."""
    lines = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    words = lines.select("doc_id", "line_no", F.posexplode(F.split("line", " ")).alias("k", "text"))
    height = F.when(F.col("line_no") == 0, 16.0).otherwise(10.0)
    glyphs = words.select("doc_id", (F.col("k") * 60.0).alias("x"), (800.0 - 12 * F.col("line_no")).alias("y"), F.lit(55.0).alias("width"), height.alias("height"), "text")
    return S.reconstruct_lines(glyphs, "doc_id")


@query(
    """with s as (select doc_id, line_no, line, case when line_no = 0 then 16 when line_no % 7 = 3 then 10.7 else 10.0 end as height from lines10),
    b as (select doc_id, arg_max(bucket, (n, -bucket)) as body from (select doc_id, round(height * 4) / 4 as bucket, sum(length(line)) as n from s group by 1, 2) group by 1)
    select doc_id, line_no, (case when length(line) > 90 then 0 when height >= 1.22 * body then 1 when height >= 1.06 * body then 2 else 0 end)::int as level from s join b using (doc_id)""",
    "lines10",
)
def p6_mark_headings(spark, d):
    lines = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    rows = lines.withColumn("height", F.when(F.col("line_no") == 0, 16.0).when(F.col("line_no") % 7 == 3, 10.7).otherwise(10.0))
    return S.mark_headings(rows, "doc_id").select("doc_id", "line_no", "level")


@query(
    """with l as (select doc_id, line_no, line_no // 5 as page, case when line_no % 5 = 0 then 'Page ' || line_no else line end as line from lines10),
    e as (select *, row_number() over (partition by doc_id, page order by line_no) <= 2 or row_number() over (partition by doc_id, page order by line_no desc) <= 2 as edge, regexp_replace(trim(line), '\\d+', '#', 'g') as key from l),
    p as (select doc_id, count(distinct page) as pages from l group by 1),
    r as (select doc_id, key from e join p using (doc_id) where edge and key <> '' group by 1, 2, pages having pages > 1 and count(distinct page) >= case when pages = 2 then 2 else ceil(0.6 * pages) end)
    select doc_id, line_no from e where not (edge and exists (select 1 from r where r.doc_id = e.doc_id and r.key = e.key))""",
    "lines10",
)
def p7_strip_running_lines(spark, d):
    lines = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("page", F.expr("line_no div 5"))
    rows = lines.withColumn("line", F.when(F.col("line_no") % 5 == 0, F.concat(F.lit("Page "), "line_no")).otherwise(F.col("line")))
    return S.strip_running_lines(rows, "doc_id").select("doc_id", "line_no")


@query("with n as (select doc_id, length(regexp_replace(text, '\\s+', '', 'g')) as n from documents) select doc_id, n < 180 or n / (595.0 * 842.0) < 0.0004 as needs_ocr from n")
def p8_flag_sparse_pages(spark, d):
    return S.flag_sparse_pages(docs(spark, d)).select("doc_id", "needs_ocr")


@query("select source, case when count(distinct m) = 0 then 'NATIVE_TEXT' when count(distinct m) = 1 then max(m) else 'MIXED' end as method from (select source, case when doc_id % 3 = 0 and source < 'src15' then 'OCR' when source < 'src3' then 'NATIVE_TEXT' end as m from documents) group by 1")
def p9_rollup_method(spark, d):
    m = F.when((F.col("doc_id") % 3 == 0) & (F.col("source") < "src15"), "OCR").when(F.col("source") < "src3", "NATIVE_TEXT")
    return S.rollup_method(docs(spark, d).select("source", m.alias("method")), "source")


@query(
    """with e as (select doc_id, line_no, case line_no % 3 when 0 then '| ' || w[1] || ' | ' || coalesce(w[2], '') || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| x | ' || line_no || ' |'
    when 1 then '1. ' || w[1] || chr(10) || '2. b' else line end as shown from (select *, string_split(line, ' ') as w from lines10))
    select doc_id, sha256(string_agg(shown, chr(10) || chr(10) order by line_no)) as text from e group by 1""",
    "lines10",
)
def p10_elements_to_text(spark, d):
    lines = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "text"))
    k, w = F.col("position") % 3, F.split("text", " ")
    rows = F.array(F.array(F.get(w, 0), F.coalesce(F.get(w, 1), F.lit(""))), F.array(F.lit("x"), F.col("position").cast("string")))
    e = lines.select("doc_id", "position", "text", F.when(k == 0, "table").when(k == 1, "list").otherwise("paragraph").alias("type"), rows.alias("rows"), F.array(F.get(w, 0), F.lit("b")).alias("items"), F.lit(True).alias("ordered"))
    return S.elements_to_text(e, "doc_id").withColumn("text", F.sha2("text", 256))


@query(
    """with s as (select *, last_value(case when level <= 2 then line end ignore nulls) over w as section, sum((coalesce(level, 9) <= 2)::int) over w as g from elements window w as (partition by revision_id order by line_no rows unbounded preceding))
    select revision_id, line_no, section, subsection, section || coalesce(' > ' || subsection, '') as path from (select *, last_value(case when level > 2 then line end ignore nulls) over (partition by revision_id, g order by line_no rows unbounded preceding) as subsection from s)""",
    "elements",
)
def p11_assign_sections(spark, d):
    return S.assign_sections(A.elements(spark, d)).select("revision_id", "line_no", "section", "subsection", "path")


@query(
    """select revision_id, line_no, case when lower(trim(line)) in ('document control', 'revision history', 'version history', 'approval history', 'table of contents', 'distribution list', 'references', 'related documents')
    or line_no % 20 = 10 then 'ADMINISTRATIVE' else 'CONTENT' end as role from elements where type = 'heading'""",
    "elements",
)
def p12_section_role(spark, d):
    """The headings of all documents; every second deeper one is replaced by an administrative title."""
    e = A.elements(spark, d).filter("type = 'heading'")
    titles = F.array(*[F.lit(f" {t.title()} ") for t in T.ADMINISTRATIVE])
    title = F.when(F.col("line_no") % 20 == 10, F.get(titles, (F.col("revision_id") % 8).cast("int"))).otherwise(F.col("line"))
    return e.select("revision_id", "line_no", T.section_role(title).alias("role"))


@query()
def p13_chunk(spark, d):
    """Sections by first lines, subsections by every tenth line; every fifth document ends in a revision history."""
    e = S.assign_sections(A.elements(spark, d)).filter("type = 'paragraph' and trim(line) <> ''")
    late = (F.col("revision_id") % 5 == 0) & (F.col("line_no") % 10 > 7)
    section = F.when(late, "Revision History").otherwise(F.col("section"))
    rows = e.select("revision_id", F.col("line_no").alias("position"), section.alias("section"), F.when(~late, F.col("subsection")).alias("subsection"), T.section_role(section).alias("role"), F.lit("paragraph").alias("kind"), F.col("line").alias("text"), "page")
    return S.chunk(rows).withColumn("content", F.sha2("content", 256))


@query("select revision_id, (row_number() over (partition by revision_id order by page) - 1)::int as chunk_index, page, sha256(content) as content from (select revision_id, page, string_agg(line, chr(10) order by line_no) as content from elements where trim(line) <> '' group by 1, 2)", "elements")
def y4_chunker(spark, d):
    """A user's own chunker: a chunk a page."""

    def pages(blocks, cfg):
        out = {}
        for b in blocks:
            out.setdefault(b["page"], []).append(b["text"])
        return [{"chunk_type": "CHILD", "content": "\n".join(texts), "tokens": sum(map(len, texts)), "page_start": p, "page_end": p} for p, texts in out.items()]

    none = F.lit(None).cast("string")
    rows = A.elements(spark, d).filter("trim(line) <> ''").select("revision_id", F.col("line_no").alias("position"), none.alias("section"), none.alias("subsection"), F.lit("CONTENT").alias("role"), F.lit("paragraph").alias("kind"), F.col("line").alias("text"), "page")
    return S.chunk(rows, chunker=pages).select("revision_id", F.col("chunk_index").cast("int").alias("chunk_index"), F.col("page_start").alias("page"), F.sha2("content", 256).alias("content"))


@query(
    """with p as (select doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) as ps from documents),
    s as (select doc_id, s, k, sum(ceil(length(s) / 3.8)) over (partition by doc_id order by k desc rows unbounded preceding) as used from (select doc_id, unnest(ps) as s, generate_subscripts(ps, 1) as k from p) where s <> '')
    select p.doc_id, coalesce(string_agg(s, ' ' order by k) filter (used <= 100), '') as tail from p left join s using (doc_id) group by 1""",
)
def p15_overlap_tail(spark, d):
    return docs(spark, d).select("doc_id", S.overlap_tail(F.col("text"), 100).alias("tail"))


@query("select chunk_id, sha256('Doc ' || revision_id || chr(10) || section_title || chr(10) || content) as embedding_text from chunks", "chunks")
def p16_with_embedding_text(spark, d):
    c = A.chunks(spark, d).withColumns({"title": F.concat(F.lit("Doc "), "revision_id"), "department": F.lit(None).cast("string"), "section": F.col("section_title"), "subsection": F.lit(None).cast("string")})
    return S.with_embedding_text(c).select("chunk_id", F.sha2("embedding_text", 256).alias("embedding_text"))


@query("select min(chunk_id) as chunk_id from (select *, sha256(lower(content)) as h from chunks) group by revision_id, h", "chunks")
def p17_dedupe_chunks(spark, d):
    c = A.chunks(spark, d).withColumn("chunk_type", F.lit("CHILD")).withColumn("content_hash", F.sha2(F.lower("content"), 256))
    return S.dedupe_chunks(c).select("chunk_id")


@query(
    """select revision_id, page, line_no::double as line_no, line from elements union all select e.revision_id, e.page, max(line_no) + 0.001, '[Figure] ' || 'scan ' || e.revision_id from elements e where e.revision_id % 10 = 0 and page = 1 group by 1, 2""",
    "elements",
)
def p18_append_figures(spark, d):
    e = A.elements(spark, d)
    figures = e.filter("revision_id % 10 = 0 and page = 1 and line_no = 0").select("revision_id", "page", F.lit(1).alias("figure_no"), F.concat(F.lit("scan "), "revision_id").alias("text"))
    return S.append_figures(e, figures).select("revision_id", "page", "line_no", "line")


@query(
    f"""with c as (select *, regexp_replace(text, '\\s+', ' ', 'g') as t from conversations), q as (select conv_id, turn, t, lower(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) as q, turn > 0 as h from c)
    select conv_id, turn, h and (len(string_split(q, ' ')) <= 6 or regexp_matches(q, '^(?:what about|how about|and for|and what|what if|why|and|but|also|then) ')
    or list_has_any(regexp_split_to_array(regexp_replace(q, '[^a-z\\s]', ' ', 'g'), '\\s+'), {LEANING}) or contains(q, 'the same')) as rewrite from q"""
)
def f13_needs_rewrite(spark, d):
    return A.table(spark, d, "conversations").select("conv_id", "turn", T.needs_rewrite(F.regexp_replace("text", r"\s+", " "), F.col("turn") > 0).alias("rewrite"))


@query(
    """with q as (select conv_id, turn, regexp_replace(case when turn % 2 = 0 then '"Question: ' || text || '"' else text end, '^\\s+|\\s+$', '', 'g') as q from conversations),
    c as (select conv_id, turn, regexp_replace(regexp_replace(regexp_replace(q, '^["''`]|["''`]$', '', 'g'), '^(?:standalone question|rewritten question|question)\\s*:\\s*', '', 'i'), '^\\s+|\\s+$', '', 'g') as c from q)
    select conv_id, turn, case when c = '' or length(c) > 400 then 'fallback' else c end as clean from c"""
)
def f14_clean_rewrite(spark, d):
    raw = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('"Question: '), "text", F.lit('"'))).otherwise(F.col("text"))
    return A.table(spark, d, "conversations").select("conv_id", "turn", T.clean_rewrite(raw, F.lit("fallback")).alias("clean"))


@query("select item_id, ['AB-POL-' || item_id % 10000] as codes, ['ORA-0' || lpad((item_id % 1000)::varchar, 4, '0')] as errors from benchmark")
def f12_extract_codes(spark, d):
    said = F.concat("text", F.lit(" see ab-pol-"), F.col("item_id") % 10000, F.lit(" and ORA-0"), F.lpad((F.col("item_id") % 1000).cast("string"), 4, "0"), F.lit(" AB-POL-"), F.col("item_id") % 10000)
    return A.table(spark, d, "benchmark").select("item_id", T.extract_codes(said).alias("codes"), T.extract_error_codes(said).alias("errors"))
