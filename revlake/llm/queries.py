"""The registered queries of this subpackage: production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bit_codes, conversations, embedding_dedup, mixing, phrases, secret_scan, sentencepiece_codec, simhash_dedup, substring_dedup, token_counts, topk, toxicity, url_filter
from .common import cut, table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepiece_codec.round_trip(docs, path)
    return coded.select(
        "doc_id",
        F.expr("length(ids) div 4").cast("long").alias("n_pieces"),
        F.sha2("ids", 256).alias("ids_sha256"),
        (F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), "▁", " ")).alias("round_trip"),
    )


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


#: Verdict, host and path of the url rules.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.learn(docs, table(spark, sf_dir, "labels")), out="score")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.answers(docs, public_tokenizers.path("byte_bpe_50k.json"), (1024,))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return counted.select("doc_id", n_bytes, "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), F.col("fits_1024").alias("fitting_chars"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("reps")).alias("taken"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secret_scan.joined_spans(base), 256).alias("base_sha256"), secret_scan.joined_spans(F.col("spans")).alias("spans"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_codes.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    rows = conversations.damaged(given)
    audited = cut(conversations.audits(rows))
    hashes = conversations.digests(rows, audited).select(F.col("conv").alias("name"), F.col("sha256").alias("repaired_sha256"))
    out = audited.join(hashes, F.col("conv").eqNullSafe(F.col("name")))
    return out.select(F.col("conv").cast(given.schema["conv_id"].dataType).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_topk, op3_url_filter, op4_toxicity, op5_token_counts, op6_substring_dedup, op7_mixing, op8_secret_scan, op9_embedding_dedup, op10_simhash_dedup, op11_ann, op12_conversation_repair, op13_collocations)}
ORACLES = {
    "op2_topk": """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) q from embeddings
                   where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select a.vec_id query_id, b.vec_id, list_dot_product(a.q, b.q)::bigint score
              from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
        select query_id, rank::int rank, vec_id, score from r where rank <= 5""",
    "op11_ann": """
        with v as (select vec_id, embedding::double[] e from embeddings where embedding is not null
                   and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s as (select a.vec_id query_id, b.vec_id, list_dot_product(a.e, b.e) score from v a join v b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id and len(a.e) = len(b.e)),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
        select query_id, rank::int rank, vec_id, score from r where rank <= 20""",
}


def repair_sql() -> str:
    """The SQL of op12: row by row, the cheapest (cost, audit, text) of each state; 0 nothing yet, 1 after a system row, 2 after a user row, 3 after an assistant row."""
    crc = "xor(list_reduce(list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: ascii(c)::bigint), lambda a, x: list_reduce(range(8), lambda v, b: xor(v >> 1, (v & 1) * 3988292384), xor(a, x)), 4294967295::bigint), 4294967295)"

    def way(state: str, cost: str | int, edit: str, role: str = "", text: str = "''", where: str = "true") -> str:
        line = f"chr(10) || {role} || ':' || {text}" if role else "''"
        return f"case when {state} is not null and {where} then {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 't': {state}.t || {line}}} end"

    free, more = "not (blank or dup)", "case when trunc then 5 else 0 end"
    read = []
    for to, keeps, role, froms in ((0, [], "", []), (1, [(0, "s")], "", []), (2, [(0, "u"), (1, "u"), (3, "u")], "'user'", [0, 1, 3]), (3, [(2, "a")], "'assistant'", [2])):
        ways = [way(f"s{to}", 2, "D")]
        ways += [way(f"s{s}", more, "K", "role", "text", f"{free} and c = '{c}'") for s, c in keeps]
        ways += [way(f"s{s}", f"1 + {more}", "R", role, "text", free) for s in froms]
        read.append(f"least({', '.join([*ways, 'null'])}) as n{to}")
    user = f"least(n2, {', '.join(way(f'n{s}', 5, 'I', chr(39) + 'user' + chr(39)) for s in (0, 1, 3))})"
    both = f"n0 as s0, n1 as s1, n2 as s2, least(n3, {way('n2', 5, 'I', chr(39) + 'assistant' + chr(39))}) as s3"
    none = "null::struct(c bigint, a varchar, t varchar)"
    inserted = lambda rows: f"select conv_id, i, {both} from (select conv_id, i, n0, n1, {user} as n2, n3 from ({rows}))"
    start = f"select conv_id, 0::bigint as i, {{'c': 0::bigint, 'a': '', 't': ''}} as n0, {none} as n1, {none} as n2, {none} as n3 from (select distinct conv_id from conversations)"
    step = f"select s.conv_id, r.i, {', '.join(read)} from s join r on r.conv_id is not distinct from s.conv_id and r.i = s.i + 1"
    return f"""
        with recursive k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc} % 20 as f from conversations),
        d as (select conv_id, turn, case when f = 4 then 'user' else role end as role, case f when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(range(case f when 0 then 0 when 3 then 2 else 1 end)) as copy from k),
        o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as i, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as again, left(role, 1) as c,
              rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as t from d),
        r as (select conv_id, turn, role, text, i, c, t = '' as blank, t <> '' and again > 1 as dup, t <> '' and again = 1 and right(t, 1) not in ('.', '!', '?') as trunc, lag(c) over (partition by conv_id order by i) || c as pair from o),
        s as ({inserted(start)} union all {inserted(step)}),
        e as (select conv_id, least(s0, s3) as e from s qualify row_number() over (partition by conv_id order by i desc) = 1),
        f as (select conv_id, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) filter (blank) as blank, count(*) filter (dup) as duplicate, count(*) filter (trunc) as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal from r group by 1)
        select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, e.e.c as cost, e.e.a as audit, sha256(e.e.t[2:]) as repaired_sha256
        from e left join f on f.conv_id is not distinct from e.conv_id"""


ORACLES["op12_conversation_repair"] = repair_sql()

ORACLES["op13_collocations"] = """
    with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n-\\r]')) as piece from documents),
    w as (select lang, list_filter(string_split(replace(piece, chr(9), ' '), ' '), lambda x: x <> '') as w from p),
    i as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j : j + k - 1], ' '))) as g from w, range(1, 6) t(k) where len(w) >= k),
    f as materialized (select lang, k, g, count(*) as f from i group by 1, 2, 3 having k = 1 or count(*) >= 100),
    n as (select lang, sum(f)::hugeint as n from f where k = 1 group by 1),
    c as materialized (select lang, k, g, f, string_split(g, ' ') as w from f where k > 1 and f >= 100),
    x as (select c.lang, c.g, c.f, cut, array_to_string(w[1 : cut], ' ') as a, array_to_string(w[cut + 1 :], ' ') as b from c, range(1, 5) t(cut) where cut < k),
    s as (select x.lang, x.g, x.f as a, n, cut, l.f as l, r.f as r, (1000::hugeint * x.f * n) // (l.f::hugeint * r.f::hugeint) as score from x join n using (lang) join f l on l.lang = x.lang and l.g = x.a join f r on r.lang = x.lang and r.g = x.b),
    b as (select * from s qualify row_number() over (partition by lang, g order by score, cut) = 1),
    d as (select lang, f, unnest([array_to_string(w[1 : k - 1], ' '), array_to_string(w[2 :], ' ')]) as g from c where k > 2),
    o as (select b.* from b where not exists (select 1 from d where d.lang = b.lang and d.g = b.g and d.f = b.a))
    select lang, row_number() over (partition by lang order by score desc, a desc, g)::int as rank, g as phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from o qualify rank <= 2000"""
